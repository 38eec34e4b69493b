import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.config import DEFAULT
from corpusflow.operators import search


def brute(Q, X, k):
    out = {}
    for i, q in enumerate(Q):
        d = [float(np.add.accumulate((q - x) * (q - x))[-1]) for x in X]  # index-order sum
        order = sorted(range(len(X)), key=lambda j: (d[j], j))[:k]
        out[i] = [(j, d[j]) for j in order]
    return out


def frames(spark, Q, X):
    q = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(Q)], "query_id long, embedding array<double>")
    c = spark.createDataFrame([(j, [float(v) for v in r]) for j, r in enumerate(X)], "id long, embedding array<double>")
    return q, c


def check(spark, Q, X, k, settings=DEFAULT):
    q, c = frames(spark, Q, X)
    got = search.knn(q, c, k, settings=settings).collect()
    exp = brute(Q, X, k)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, r.id, r.distance))
    for i in range(len(Q)):
        g = [(idx, d) for _, idx, d in sorted(by.get(i, []))]
        assert [j for j, _ in g] == [j for j, _ in exp[i]]
        assert np.allclose([d for _, d in g], [d for _, d in exp[i]], atol=0, rtol=0)


def test_exact_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(size=(300, 8))
    Q = rng.normal(size=(25, 8))
    check(spark, Q, X, 7)


def test_hot_cell_and_ties(spark):
    # a third of the collection is one repeated vector: equal distances, ties by id
    rng = np.random.default_rng(2)
    X = np.vstack([rng.normal(size=(200, 4)), np.tile(rng.normal(size=(1, 4)), (100, 1))])
    Q = np.vstack([X[250:252], rng.normal(size=(5, 4))])
    check(spark, Q, X, 12, DEFAULT.with_(block_rows=16))


def test_k_above_rows_returns_all(spark):
    rng = np.random.default_rng(3)
    X = rng.normal(size=(6, 3))
    Q = rng.normal(size=(2, 3))
    q, c = frames(spark, Q, X)
    assert search.knn(q, c, 50).count() == 12


def test_empty_collection_and_no_queries(spark):
    q = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, embedding array<double>")
    c = spark.createDataFrame([], "id long, embedding array<double>")
    assert search.knn(q, c, 5).count() == 0
    c2 = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<double>")
    q2 = spark.createDataFrame([], "query_id long, embedding array<double>")
    assert search.knn(q2, c2, 5).count() == 0


def test_per_row_k(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(50, 5))
    q = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=5)], k) for i, k in enumerate([0, 1, 3, 10])],
                              "query_id long, embedding array<double>, k int")
    c = spark.createDataFrame([(j, [float(v) for v in r]) for j, r in enumerate(X)], "id long, embedding array<double>")
    got = search.knn(q, c, F.col("k")).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in got} == {1: 1, 2: 3, 3: 10}


def test_wrong_dimension_raises(spark):
    q = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "query_id long, embedding array<double>")
    c = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 1.0])], "id long, embedding array<double>")
    with pytest.raises(Exception):
        search.knn(q, c, 1).collect()


def test_approx_recall_reported(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    idx = search.build_index(e, "vec_id", "embedding")
    q = e.withColumnRenamed("vec_id", "query_id")
    exact = search.search(idx, q, 10).select("query_id", "id")
    approx = search.search(idx, q, 10, exact=False, n_probe=4).select("query_id", "id")
    recall = approx.join(exact, ["query_id", "id"]).count() / exact.count()
    assert 0 < recall <= 1
    # rank is complete and monotone for the exact path
    full = search.search(idx, q, 10)
    assert full.groupBy("query_id").agg(F.max("rank").alias("m")).filter("m != 10").count() == 0


def test_nest_results(spark):
    hits = spark.createDataFrame([(1, 2, "b", 0.5), (1, 1, "a", 0.1)], "query_id long, rank long, id string, distance double")
    r = search.nest_results(hits).first()
    assert r.ids == ["a", "b"] and r.distances == [0.1, 0.5]


def test_index_save_and_load(spark, tmpdir_path):
    rng = np.random.default_rng(6)
    X = rng.normal(size=(120, 6))
    Q = rng.normal(size=(9, 6))
    q, c = frames(spark, Q, X)
    idx = search.build_index(c, "id", "embedding", DEFAULT.with_(block_rows=16))
    search.save_index(idx, f"{tmpdir_path}/idx")
    again = search.load_index(spark, f"{tmpdir_path}/idx", DEFAULT.with_(block_rows=16))
    a = sorted(map(tuple, search.search(idx, q, 5).collect()))
    b = sorted(map(tuple, search.search(again, q, 5).collect()))
    assert a == b and len(a) == 45


def test_approx_recall_grows_with_probes(spark):
    rng = np.random.default_rng(7)
    X = rng.normal(size=(400, 8))
    Q = rng.normal(size=(30, 8))
    q, c = frames(spark, Q, X)
    idx = search.build_index(c, "id", "embedding", DEFAULT.with_(block_rows=25))  # 16 cells
    cells = idx.centroids.shape[0]
    exact = {(r.query_id, r.id) for r in search.search(idx, q, 10).collect()}
    recalls = []
    for p in [1, 4, cells]:
        got = {(r.query_id, r.id) for r in search.search(idx, q, 10, exact=False, n_probe=p).collect()}
        recalls.append(len(got & exact) / len(exact))
    assert recalls == sorted(recalls) and recalls[-1] == 1.0


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_registered_approx_recall(spark, size):
    from corpusflow.plans import retrieval

    base = f"/root/testdata/{size}"
    exact = {(r.query_id, r.vec_id) for r in retrieval.knn_batch(spark, base).select("query_id", "vec_id").collect()}
    got = {(r.query_id, r.vec_id) for r in retrieval.knn_approx(spark, base).select("query_id", "vec_id").collect()}
    assert len(got & exact) >= 0.9 * len(exact)


def test_second_pass_sends_only_rows_within_the_first_bound(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 8)) + 20
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<double>")
    idx = search.build_index(rows, settings=search.DEFAULT.with_(block_rows=50))
    sent = []
    keep = search._probe
    monkeypatch.setattr(search, "_probe", lambda *a: sent.append(keep(*a)) or sent[-1])
    q = rows.where("id < 60").withColumnRenamed("id", "query_id")
    got = sorted((r.query_id, r["rank"], r.id) for r in search.search(idx, q, 10).collect())
    far = ((x[:60, None] - x[None]) ** 2).sum(axis=2)
    want = sorted((i, r + 1, int(j)) for i in range(60) for r, j in enumerate(np.argsort(far[i], kind="stable")[:10]))
    assert got == want
    assert sent[1].count() < 60 * 10 * 3  # before: 10 of every block that a query looks at


def test_queries_that_look_everywhere_are_sent_to_groups_of_cells(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    sent, grouped = [], search._grouped_udf

    def spied(per):
        sent.append(per)
        return grouped(per)

    monkeypatch.setattr(search, "_grouped_udf", spied)
    index = search.build_index(df, settings=search.DEFAULT.with_(block_rows=8), n_cells=128)
    hits = search.search(index, df.withColumnRenamed("id", "query_id"), 5).collect()
    assert sent == [1, 4]  # pass 2 sends a query to 32 groups at most
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    best = np.argsort(far, axis=1, kind="stable")[:, :5]
    assert len(hits) == 3000 and all(r["id"] == best[r["query_id"], r["rank"] - 1] for r in hits)


def test_few_queries_are_sent_once_and_not_for_every_sub_block(spark, monkeypatch):
    from dataclasses import replace

    rng = np.random.default_rng(10)
    x = rng.normal(size=(1000, 8))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<double>")
    idx = search.build_index(rows, settings=DEFAULT.with_(block_rows=25), n_cells=2)  # some 20 sub-blocks a cell
    sent, keep = [], search._probe
    monkeypatch.setattr(search, "_probe", lambda *a: sent.append(keep(*a)) or sent[-1])
    q = rows.where("id < 30").withColumnRenamed("id", "query_id")
    far = ((x[:30, None] - x[None]) ** 2).sum(axis=2)
    want = sorted((i, r + 1, int(j)) for i in range(30) for r, j in enumerate(np.argsort(far[i], kind="stable")[:10]))
    for most, copies in ((DEFAULT.broadcast_max_bytes, False), (0, True)):
        small = replace(idx, settings=idx.settings.with_(broadcast_max_bytes=most))
        assert sorted((r.query_id, r["rank"], r.id) for r in search.search(small, q, 10).collect()) == want
        for df in sent:
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert ("explode(sequence(" in plan) == copies  # before: copies, broadcast by an estimate that left them out
            physical = df._jdf.queryExecution().executedPlan().toString()
            assert ("BroadcastHashJoin" in physical) != copies
        sent.clear()


def test_a_task_sends_the_nearest_rows_of_all_its_blocks(spark, monkeypatch):
    from dataclasses import replace

    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(size=(1000, 8)), np.tile(rng.normal(size=(1, 8)), (300, 1))])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<double>")
    idx = search.build_index(rows, settings=DEFAULT.with_(block_rows=25), n_cells=2)
    idx = replace(idx, blocks=idx.blocks.coalesce(1))
    sent, keep = [], search._probe
    monkeypatch.setattr(search, "_probe", lambda *a: sent.append(keep(*a)) or sent[-1])
    q = rows.where("id < 30 or id = 1000").withColumnRenamed("id", "query_id")
    hits = sorted((r.query_id, r["rank"], r.id, r.distance) for r in search.search(idx, q, 10).collect())
    some = [*range(30), 1000]
    exp = brute(x[some], x, 10)
    assert hits == [(i, r + 1, j, d) for k, i in enumerate(some) for r, (j, d) in enumerate(exp[k])]
    assert sent[0].where("query_id < 30").count() == 30 * 10  # before: 10 of each of some 25 blocks
    assert sent[0].where("query_id = 1000").count() == 300  # ties are settled by id over all tasks
