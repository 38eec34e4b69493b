"""Operators 2, 7 and 9, and the pipeline."""

import math
from fractions import Fraction

import brute
import numpy as np
import pytest
from test_texts import _encode, check_packing

import corpus_pipeline
from corpusflow.llm import bit_sliced, boosting, quality_model, quality_rules, secrets, toxicity
from corpusflow.llm.common import crc_part

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("slices", [1, 2, 6, 12])
def test_block_search_equals_brute_force(slices):
    rng = np.random.default_rng(slices)
    x = rng.integers(-200, 200, (300, 7))
    x[50:90] = x[3]  # ties
    x[100] = 0
    ids = rng.permutation(1000)[:300]
    block = bit_sliced.Block(ids, x, slices)
    for q in (0, 3, 51, 100, 299):
        got = block.search(int(ids[q]), x[q], 5)
        want = sorted((-int(x[j] @ x[q]), int(ids[j])) for j in range(300) if ids[j] != ids[q])[:5]
        assert list(zip((-got[1]).tolist(), got[0].tolist())) == want


def test_search_on_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (50, [0.25, -1.0]), (1, [1.0, 0.5]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]),
            (6, []), (7, [1.0]), (None, [9.0, 9.0]), (1, [1.0, 0.5]), (8, [-0.001, 0.999])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = bit_sliced.vectors(table)
    got = bit_sliced.top_k(v, v.where("id % 50 = 0"), 2).orderBy("query_id", "rank").collect()
    as_int = lambda r: [int(np.floor(256 * float(np.float32(c)))) for c in r]
    usable = [(i, as_int(x)) for i, x in rows if i in (0, 50, 1, 6, 7, 8)]  # shorter ones multiply as far as they go
    for q in (0, 50):
        own = dict(usable)[q]
        want = sorted((-sum(a * b for a, b in zip(own, x)), i) for i, x in usable if i != q)[:2]
        assert [(-r["score"], r["vec_id"]) for r in got if r["query_id"] == q] == want
    assert bit_sliced.top_k(v.limit(0), v.limit(0)).count() == 0


@pytest.mark.parametrize("values", [[1.0, 2**23], [1e8, 2**31 - 1.0], [1e18, 3.5], [1e30, 1e-3], [1e300, -1e300]])
def test_search_on_large_components(spark, values):
    rng = np.random.default_rng(7)
    x = rng.choice([*values, *(-v for v in values), 0.0, 1.0, 2.0], size=(70, 3)).tolist()
    table = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    v = bit_sliced.vectors(table)
    exact = [[math.floor(Fraction(c) * 256) for c in r] for r in x]
    fits = lambda s: max(-2**63, min(s, 2**63 - 1))
    got = [tuple(r) for r in bit_sliced.top_k(v, v.where("id % 10 = 0"), 4).orderBy("query_id", "rank").collect()]
    want = []
    for q in range(0, 70, 10):
        best = sorted((-sum(a * b for a, b in zip(exact[q], exact[i])), i) for i in range(70) if i != q)[:4]
        want += [(q, k + 1, i, fits(-s)) for k, (s, i) in enumerate(best)]
    assert got == want


def test_search_does_not_wrap(spark):
    table = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1e8, 1.0]), (2, [3.0, 1.0]), (3, [2.0, 1.0])], "vec_id long, embedding array<double>")
    v = bit_sliced.vectors(table)
    got = bit_sliced.top_k(v, v.where("id = 0"), 3).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(1, 6553600065536), (2, 262144), (3, 196608)]


def test_order_keys_sort_as_integers():
    v = sorted({s * (1 << k) + d for k in range(0, 700, 7) for s in (1, -1) for d in (-1, 0, 1)})
    assert sorted(v, key=bit_sliced.order_key) == v


def test_search_query_matches_sql(spark):
    import duckdb

    got = bit_sliced.op2_bit_sliced(spark, SMALL).toPandas().sort_values(["query_id", "rank"]).reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SMALL}/embeddings.parquet'")
    want = con.execute(bit_sliced.ORACLE).fetchdf().sort_values(["query_id", "rank"]).reset_index(drop=True)
    assert got.equals(want[got.columns])


def test_trees_learn_and_calibrate():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    forest = boosting.fit(x[:2000], y[:2000])
    assert ((forest.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97
    xs, ys = boosting.isotonic(forest.margin(x[:2000]), y[:2000])
    assert (np.diff(xs) >= 0).all() and (np.diff(ys) >= 0).all() and 0 < ys[0] and ys[-1] < 1
    for none in (np.zeros((0, 5)), np.ones((4, 5))):
        assert np.allclose(boosting.fit(none, np.zeros(len(none))).probability(x[:3]), 1 / (len(none) + 2))


@pytest.mark.parametrize("query, label, modulus, rest, least", [
    (quality_model.op9_quality_model, "quality", 3, 1, 0.95), (toxicity.op7_toxicity, "toxic", 4, 2, 0.9)])
def test_held_out_accuracy(spark, query, label, modulus, rest, least):
    import zlib

    got = query(spark, MEDIUM).toPandas()
    assert len(got) == 1000 and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % modulus == rest for i in got["doc_id"]]).all()
    both = got[got["held_out"]].merge(brute.read(MEDIUM, "labels"), on="doc_id")
    assert (both["predicted"] == both[label]).mean() >= least


def test_models_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, None, 1), (8, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    held = lambda c: crc_part(c, 99) == 98
    for rows in (labels, labels.limit(0)):
        forest = quality_model.train(odd, rows, held)
        got = quality_model.score(odd, forest).toPandas()
        assert len(got) == 11 and got["score"].between(0, 1).all()
        tox = toxicity.score(odd, toxicity.train(odd, rows, held)).toPandas()
        assert len(tox) == 11 and tox["score"].between(0, 1).all()
    assert quality_model.score(none, forest).count() == 0


def test_toxic_features():
    f = dict(zip(toxicity.FEATURES, toxicity.features("You are such an IDIOT!! 1di0t", {"such": 1.0}, {})))
    assert f["built_in_density"] > 0 and f["near_second_density"] > 0 and f["learned_hits"] == 1
    assert toxicity.disguised("id10t") == "idlot" or toxicity.disguised("id1ot")
    assert toxicity.disguised("i.d.i.o.t") == "idiot" and toxicity.disguised("hello") is None


def test_pipeline_matches_brute_force(spark):
    """Every stage of a run on the smallest table, repeated in plain Python."""
    out = corpus_pipeline.run(spark, SMALL).toPandas()
    docs = brute.read(SMALL, "documents")
    good = {r["doc_id"] for r in quality_rules.apply_rules(spark.read.parquet(f"{SMALL}/documents.parquet")).where("kept").collect()}
    assert not any(brute.base_rules(t)[-1] for i, t in zip(docs["doc_id"], docs["text"]) if i in good)
    rows = {r.doc_id: r for r in docs.itertuples() if r.doc_id in good}
    near = brute.near_duplicates({i: r.text for i, r in rows.items()}, 5)
    rows = {i: r for i, r in rows.items() if near[i][1] == i}
    texts = {}
    for i, r in rows.items():
        parts, at = [], 0
        for a, b in sorted((a, b) for a, b, _ in secrets.find(r.text)[1]):
            if a >= at:
                parts += [r.text[at:a], "[SECRET]"]
            at = max(at, b)
        texts[i] = "".join([*parts, r.text[at:]])
    order = list(texts)
    sizes = [len(brute.words(texts[i])) for i in order]
    taken = {i: t[2] for i, t in zip(order, brute.mix_taken([(i, rows[i].source, n) for i, n in zip(order, sizes)]))}
    copies = []
    for i, n in zip(order, sizes):
        for p in (0, 1):
            k = max(0, min(n, taken[i] - p * n))
            if k:
                copies.append((i, texts[i] if k == n else " ".join(brute.WORD.findall(texts[i])[:k])))
    ids = _encode([t for _, t in copies])
    total = {}
    for (i, _), x in zip(copies, ids):
        total[i] = total.get(i, 0) + len(x)
    assert out.groupby("doc_id")["length"].sum().to_dict() == total
    once = {i: x for (i, _), x in zip(copies, ids) if sum(j == i for j, _ in copies) == 1}
    check_packing(out[out["doc_id"].isin(once)].assign(offset=0, sequence_id=range(int(out["doc_id"].isin(once).sum()))), once) if once else None
    lengths = out.groupby("sequence_id")["length"].sum()
    assert (lengths <= 2048).all()


def test_stages_on_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, SMALL)
            assert got.columns == docs.columns, name
            got.count()


def test_query_chunks_are_not_broadcast(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(600, 6))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    found = bit_sliced.top_k(rows, rows.where("id % 5 = 0"), 4, block_rows=20, chunk_rows=16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan  # before: the copies for all 30 blocks, held by the driver
    whole = np.floor(256 * x).astype(np.int64)
    score, want = whole @ whole.T, []
    for i in range(0, 600, 5):
        order = sorted((j for j in range(600) if j != i), key=lambda j: (-score[i, j], j))[:4]
        want += [(i, r + 1, j, int(score[i, j])) for r, j in enumerate(order)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == want
