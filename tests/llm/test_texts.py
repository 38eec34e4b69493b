"""Operators 1, 3, 4 and 5, against plain Python."""

import math
import zlib
from collections import Counter

import brute
import numpy as np
import pytest

from corpusflow.llm import compact_windows, context_mixing, odd_sketch, packing
from corpusflow.llm.components import components
from corpusflow.llm.shingles import words

SMALL = "/root/testdata/sf0.001"


def test_words_lower_ascii_only():
    for t in ["ÀB İß\tX\nq", "", None, "  ", "a\x0bB\x85C"]:
        assert words(t) == brute.words(t)


def test_compact_windows_cover_every_subsequence_once():
    rng = np.random.default_rng(0)
    v = rng.integers(0, 60, 80).astype(np.uint64)
    one, two = compact_windows._values(v, 0), compact_windows._values(v, 1)
    least, got = 7, {}
    lo, c, d, hi = compact_windows.joined_windows(two, *compact_windows.windows(one, np.array([0]), np.array([80]), least), least)
    for a, x, y, h in zip(lo, c, d, hi):
        for i in range(a, min(x, y) + 1):
            for j in range(max(x, y), h):
                if j - i + 1 >= least:
                    assert (i, j) not in got
                    got[i, j] = (x, y)
    for i in range(80):
        for j in range(i + least - 1, 80):
            assert got[i, j] == (i + int(np.argmin(one[i:j + 1])), i + int(np.argmin(two[i:j + 1])))


def test_repeated_passages_are_found(spark, none):
    docs = brute.read(SMALL, "documents")
    runs = {}
    for i, t in zip(docs["doc_id"], docs["text"]):
        w = brute.words(t)
        for k in range(len(w) - 49):
            runs.setdefault(tuple(w[k:k + 50]), set()).add(i)
    groups = [g for g in runs.values() if len(g) > 1]
    got = compact_windows.op1_compact_windows(spark, SMALL).toPandas().set_index("doc_id")
    for g in groups:
        assert len({got["class_id"][i] for i in g}) == 1
    texts = docs.set_index("doc_id")["text"]
    exact = {i for g in groups for i in g}
    for r in got[~got.index.isin(exact)].itertuples():  # anything else shares most shingles with its partner
        n = max(len(brute.shingles(texts[r.Index], 5) & brute.shingles(texts[r.other_id], 5)), 1)
        assert n >= 30
    assert compact_windows.by_document(compact_windows.repeated_passages(none)).count() == 0


def test_passages_of_odd_rows(spark, odd):
    assert compact_windows.by_document(compact_windows.repeated_passages(odd)).count() == 0
    rng = np.random.default_rng(1)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    p = word(70)
    near = [*p[:30], "changed", *p[31:]]
    rows = [(1, " ".join(word(90) + p + word(40))), (2, " ".join(p + word(300))), (3, " ".join(word(200) + near)),
            (4, " ".join(word(60) + p[:45] + word(60))), (5, " ".join(word(200))), (5, " ".join(word(200))), (None, " ".join(p))]
    got = compact_windows.by_document(compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {1: 1, 2: 1, 3: 1}
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in got}
    assert spans[2] == [(0, 70)] and spans[1] == [(90, 160)]


def _one_word_replaced(rng, n, k):
    """Two texts of unrelated words around a passage of ``n`` words whose word ``k`` differs."""
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    p = word(n)
    return [" ".join(word(60) + x + word(60)) for x in (p, [*p[:k], "changed", *p[k + 1:]])]


def test_one_replaced_word_at_every_position(spark):
    rng = np.random.default_rng(3)
    rows = []
    for n in (50, 52, 60, 75, 95, 100):
        for k in range(1, n - 1):  # without its first or last word a passage is a shorter one
            rows += [(len(rows) + x, t) for x, t in enumerate(_one_word_replaced(rng, n, k))]
    links = compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r["a"], r["b"]) for r in links}
    assert all(b == a + 1 and a % 2 == 0 for a, b in got)
    assert len(got) >= 0.99 * len(rows) / 2
    assert all(s["similarity"] >= 0.8 and s["a_to"] - s["a_from"] >= 50 for r in links for s in r["spans"])


def test_shared_keys_hide_no_exact_passage(spark):
    rng = np.random.default_rng(4)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    rows, places = [], {}
    for k in range(0, 300, 3):
        p, q = word(60), word(52)
        texts = [[*word(30), *p, *word(30), *q[3:48], *word(30)], [*word(20), *p, *word(40), *q, *word(9), *q], [*word(50), *q, *word(20)]]
        rows += [(k + i, " ".join(t)) for i, t in enumerate(texts)]
        places |= {k: [(30, 90)], k + 1: [(20, 80), (120, 172), (181, 233)], k + 2: [(50, 102)]}
    links = compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in compact_windows.by_document(links).collect()}
    assert {i: [tuple(s) for s in r["spans"]] for i, r in got.items()} == places
    assert all(r["class_id"] == i // 3 * 3 and r["n_links"] == (2 if i % 3 == 1 else 1) for i, r in got.items())


def test_a_key_hides_no_similar_passage(spark):
    rng = np.random.default_rng(7)
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**9, n)]
    rows, wanted = [], []
    for _ in range(8):
        # sixty texts have the line; two after two also the words around it, but for one on either side
        line = word(40)
        for _ in range(30):
            own = [*word(12), *line, *word(12)]
            rows.append((len(rows), " ".join(word(20) + own + word(20))))
            own[11], own[52] = word(2)
            rows.append((len(rows), " ".join(word(20) + own + word(20))))
            wanted.append((len(rows) - 2, len(rows) - 1))
    links = compact_windows.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), percent=70).collect()
    assert {(r["a"], r["b"]) for r in links} == set(wanted)


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 7), (200, 201), (5, 5), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = brute.components({x for e in edges[:-2] for x in e}, edges[:-2])
    assert got == want


def test_near_duplicates_match_brute_force(spark, odd, none):
    docs = brute.read(SMALL, "documents").set_index("doc_id")["text"].to_dict()
    got = odd_sketch.op3_odd_sketch(spark, SMALL).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.itertuples()} == brute.near_duplicates(docs)
    assert (got["kept"] == (got["doc_id"] == got["component_id"])).all()
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in odd_sketch.near_duplicates(odd).collect()}
    assert {(1, 11, 1, True), (2, 11, 1, False), (3, 0, 3, True), (6, 1, 6, True), (7, 1, 6, False)} <= rows
    assert any(r[0] is None and r[2] is None and r[3] for r in rows)
    kept = odd_sketch.distinct_documents(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 8, 9]
    assert odd_sketch.near_duplicates(none).count() == 0


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 500, dtype=np.uint64)
    far = []
    for _ in range(40):
        a, b = (np.concatenate([base[:400], rng.integers(0, 2**63, 50, dtype=np.uint64)]) for _ in range(2))
        x, y = odd_sketch.minhash(a), odd_sketch.minhash(b)
        assert abs((x == y).mean() - 0.8) < 0.08
        far.append(int(np.bitwise_count((odd_sketch.sketch(x) ^ odd_sketch.sketch(y)).view(np.uint64)).sum()))
    assert max(far) <= odd_sketch.max_xor(odd_sketch.LIKELY) and abs(np.mean(far) - odd_sketch.max_xor(0.8)) < 15


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(odd_sketch, "BLOCK", 4)
    rng = np.random.default_rng(2)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
    rows = []
    for k in range(40):
        w = list(base)
        for x in rng.integers(0, 120, 1 + k % 5):
            w[x] = f"c{k}-{x}"
        rows.append((k, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in odd_sketch.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_duplicates(dict(rows))


def test_near_duplicates_of_one_id_with_several_texts(spark):
    rng = np.random.default_rng(12)
    a, b = ([f"w{k}" for k in rng.integers(0, 9999, 120)] for _ in range(2))
    edited = lambda w: [*w[:60], "edit", *w[61:]]
    rows = [(7, a), (7, b), (7, b), (8, edited(b)), (9, edited(a)), (7, []), (3, ["q", "r"])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in odd_sketch.near_duplicates(df).collect()}
    assert got == {(7, 7, True), (8, 7, False), (9, 7, False), (3, 3, True)}
    rows = [(5, a), (9, a), (9, b), (6, edited(b))]  # the classes of 9 are named by 5 and by 9
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    assert {r["component_id"] for r in odd_sketch.near_duplicates(df).collect()} == {5}


def _encode(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.public_tokenizer())
    return [[*e.ids, packing.END_ID] for e in t.encode_batch(list(texts), add_special_tokens=False)]


def test_ids_of_texts_with_added_tokens():
    rng = np.random.default_rng(11)
    bits = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "word", "é", "日本", " a", "'s", "12", "\t", ""]
    texts = ["".join(rng.choice(bits, rng.integers(0, 12))) for _ in range(3000)]
    got = packing.encoder(packing.public_tokenizer())(texts)
    assert [[*g.tolist(), packing.END_ID] for g in got] == _encode(texts)
    assert sum("<|endoftext|>" in t for t in texts) > 500


def check_packing(pieces, ids, size=2048):
    """Every id once, right digests, gapless sequences; returns the padding share."""
    for d, own in pieces.groupby("doc_id"):
        at, full = 0, np.array(ids[d], dtype="<u4")
        for r in own.sort_values("start").itertuples():
            assert r.start == at and r.length > 0 and r.doc_tokens == len(full)
            assert r.ids_crc32 == zlib.crc32(full[r.start:r.start + r.length].tobytes())
            at += r.length
        assert at == len(full)
    lengths = []
    for _, own in pieces.groupby("sequence_id"):
        at = 0
        for r in own.sort_values("offset").itertuples():
            assert r.offset == at
            at += r.length
        assert at <= size
        lengths.append(at)
    padded = sum(n if n & (n - 1) == 0 else size for n in lengths)
    return padded / sum(lengths) - 1


def test_packing_round_trip(spark, odd, none):
    docs = brute.read(SMALL, "documents")
    ids = dict(zip(docs["doc_id"], _encode(docs["text"].fillna(""))))
    got = packing.op4_packing(spark, SMALL).toPandas()
    assert set(got["doc_id"]) == set(ids) and check_packing(got, ids) == 0
    odd_pieces = packing.pack_documents(odd.where("doc_id > 1"), packing.public_tokenizer()).toPandas()
    rows = odd.where("doc_id > 1").select("doc_id", "text").toPandas()
    check_packing(odd_pieces, dict(zip(rows["doc_id"], _encode(rows["text"].fillna("")))))
    assert len(packing.pack_documents(odd, packing.public_tokenizer()).where("doc_id is null").collect()) >= 1
    assert packing.pack_documents(none, packing.public_tokenizer()).count() == 0


def test_encoder_equals_tokenizers():
    docs = list(brute.read(SMALL, "documents")["text"]) + ["", " ", "a  b", " x", "x ", "a \n b", "a  b", "½ ²x <|endoftext|> it's"]
    encode = packing.Encoder(packing.public_tokenizer(), keep=500)
    got = [list(x) for at in range(0, len(docs), 16) for x in encode(docs[at:at + 16])]
    assert got == [x[:-1] for x in _encode(docs)]


@pytest.mark.parametrize("seed", range(20))
def test_pack_any_lengths(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.choice([1, 5, 100, 700, 2047, 2048, 2049, 5000], rng.integers(1, 80)).tolist()
    used, seen = Counter(), Counter()
    for d, start, n, s, offset in sorted(packing.pack(lengths, 2048), key=lambda p: (p[3], p[4])):
        assert offset == used[s] and n > 0
        used[s] += n
        seen[d] += n
    assert dict(seen) == dict(enumerate(lengths))
    assert all(n == 2048 or n & (n - 1) == 0 for n in used.values())


def test_costs_are_balanced():
    lengths = [1500] * 8 + [300] * 8 + [248] * 8
    cost = Counter()
    for _, _, n, s, _ in packing.pack(lengths, 2048):
        cost[s] += n + n * n / 2048
    assert max(cost.values()) < 1.2 * min(cost.values())


def test_a_piece_is_cut_only_where_no_sequence_has_room():
    lengths = [1500] * 100 + [500] * 360 + [400] * 60
    lengths.append(-sum(lengths) % 2048)
    used, cost = [0] * (sum(lengths) // 2048), [0.0] * (sum(lengths) // 2048)
    parts = {}
    for d, _, n, s, _ in packing.pack(lengths, 2048):
        parts.setdefault(d, []).append((s, n))
    for d in sorted(parts, key=lambda d: (-lengths[d], d)):
        fits = [(cost[s], s) for s in range(len(used)) if 2048 - used[s] >= lengths[d]]
        assert parts[d] == [(min(fits)[1], lengths[d])] if fits else len(parts[d]) > 1
        for s, n in parts[d]:
            used[s] += n
            cost[s] += n + n * n / 2048
    assert set(used) == {2048}


def test_language_model(spark, odd, none):
    docs = brute.read(SMALL, "documents").set_index("doc_id")["text"]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs.index}
    counts = Counter(w for i, t in docs.items() if not held[i] for w in [*brute.words(t), ""])
    n, v = sum(counts.values()), len(counts)
    got = context_mixing.op5_context_mixing(spark, SMALL).toPandas()
    assert len(got) == len(docs) and (got["train_tokens"] == n).all()
    for r in got.itertuples():
        tokens = [*brute.words(docs[r.doc_id]), ""]
        assert (r.n_tokens, r.n_known, r.held_out) == (len(tokens), sum(t in counts for t in tokens), held[r.doc_id])
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens), rel_tol=1e-9)
        assert r.score < 0 and 0 < r.bits_per_byte < 8
    # rarer words by the join give the same numbers
    from corpusflow.llm.common import crc_part, load
    from pyspark.sql import functions as F

    few = context_mixing.score(load(spark, SMALL, "documents"), crc_part(F.col("doc_id"), 7) != 2, top_words=50).toPandas()
    both = got.merge(few, on="doc_id")
    assert (both["n_known_x"] == both["n_known_y"]).all()
    assert np.allclose(both["base_score_x"], both["base_score_y"]) and np.allclose(both["score_x"], both["score_y"])


def test_language_model_on_odd_rows(odd, none):
    from pyspark.sql import functions as F

    got = context_mixing.score(odd, F.lit(True)).toPandas()
    assert len(got) == 11 and got[got["doc_id"].isin([3, 4, 5])]["n_tokens"].eq(1).all()
    assert context_mixing.score(none, F.lit(True)).count() == 0


def test_bits_sum_to_one():
    """The probabilities of all first bytes after any prefix add up to one."""
    lengths, nodes, bits = context_mixing.byte_code(np.random.default_rng(0).random(256))
    assert math.isclose(sum(2.0 ** -int(x) for x in lengths), 1.0)
    assert len({tuple(zip(nodes[b, :lengths[b]], bits[b, :lengths[b]])) for b in range(256)}) == 256


def test_driver_holds_codes_of_the_counts_only(spark):
    import tracemalloc

    vocabulary = spark.createDataFrame([(w, 0, 5) for w in ("", "alpha", "beta", "gamma")], "word string, profile int, c long")
    tracemalloc.start()
    _, counts, _ = context_mixing.train(vocabulary)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    zeros, ones = counts.at(np.arange(1 << 16))
    assert 90 < zeros.sum() + ones.sum() < 2000 and (counts.codes > 0).any(axis=1).all()


def test_frequent_words_reach_the_driver_packed(spark, monkeypatch):
    from pyspark.sql import DataFrame

    def refused(*_):
        raise AssertionError("rows of words on the driver")

    monkeypatch.setattr(DataFrame, "toPandas", refused)
    docs = spark.createDataFrame([(i, "the same five words here " * (i + 1)) for i in range(9)], "doc_id long, text string")
    rows = context_mixing.score(docs, context_mixing.F.col("doc_id") < 6).collect()
    assert len(rows) == 9 and all(r["score"] < 0 and r["n_known"] == r["n_tokens"] for r in rows)
    part = context_mixing.Known()
    part.parts.append(part.pack(np.array([0, 3]), ["", "word"], np.array([-1.0, -2.0]), np.array([-3.0, -4.0])))
    assert part.found[0] == {"": (-1.0, -3.0)} and part.found[3] == {"word": (-2.0, -4.0)}


def test_language_model_reads_words_in_order(spark):
    """Contexts cross words: a training text's words in another order cost more, and only the score changes."""
    rng = np.random.default_rng(5)
    follow = {i: rng.permutation(40)[:3] for i in range(40)}
    texts = []
    for _ in range(300):
        at, out = int(rng.integers(40)), []
        for _ in range(30):
            out.append(f"word{at}")
            at = int(rng.choice(follow[at]))
        texts.append(" ".join(out))
    shuffled = [" ".join(rng.permutation(t.split())) for t in texts[200:]]
    docs = spark.createDataFrame([*enumerate(texts), *enumerate(shuffled, 1000)], "doc_id long, text string")
    from pyspark.sql import functions as F

    got = context_mixing.score(docs, F.col("doc_id") < 200).toPandas().set_index("doc_id").sort_index()
    plain, mixed = got.loc[200:299], got.loc[1000:1099]
    assert np.allclose(plain["base_score"].to_numpy(), mixed["base_score"].to_numpy())
    assert (plain["score"].to_numpy() - mixed["score"].to_numpy() > 1).mean() > 0.95
    # three followers of 40 words each: order 0 costs log10(40) a word, one word back log10(3)
    assert plain["score"].mean() / 31 > -math.log10(40) * 0.75


def test_words_of_a_code_cost_what_a_plain_loop_gives():
    rng = np.random.default_rng(6)
    tokens = [[f"w{i}" for i in rng.integers(0, 12, size=n)] for n in (0, 1, 7, 40)]
    code = context_mixing.WordCode(["", *(f"w{i}" for i in range(8))], np.arange(9) + 1.0, 3.0)
    symbols, contexts = code.laid_out(tokens, [0, 1, 0, 3])
    assert symbols.tolist() == [s for t in tokens for s in [*(code.symbol.get(w, 9) for w in t), 0]]
    flat = rng.integers(0, 50, size=(2, context_mixing.STARTS[-1])).astype(float)
    counts = context_mixing.Counts(context_mixing.Counts.coded(flat))
    model = context_mixing.Model(code, rng.random((16, 7)), np.sort(rng.random((16, 33)), axis=1))
    got = model.sequence_cost(counts, symbols, contexts, step=5)
    token, slots, bit = code.sequence_slots(symbols, contexts)
    lengths, nodes, bits = context_mixing.byte_code(np.append(np.arange(9) + 1.0, 3.0))
    zeros, ones = counts.at(slots)
    want, k = np.zeros(len(symbols)), 0
    for i, s in enumerate(symbols):
        for step in range(lengths[s]):
            assert (token[k], slots[0, k], bit[k]) == (i, nodes[s, step], bits[s, step])
            x, gate = context_mixing.predict(zeros[:, [k]], ones[:, [k]])
            p = context_mixing.refine((model.weights[gate[0]] * x[:, 0]).sum(keepdims=True), gate, model.apm)[0]
            want[i] += math.log10(p if bit[k] else 1 - p)
            k += 1
    assert k == len(bit) and np.allclose(got, want, rtol=1e-4)
    # equal last words, equal contexts; a text's start is told from any word
    one = code.laid_out([["w1", "w2", "w3", "w4"], ["w5", "w1", "w2", "w3", "w4"]], [0, 0])[1]
    assert (one[:, 3] == one[:, 9]).all() and (one[3:, 0] != one[3:, 6]).all()


def test_windows_are_found_among_few_positions():
    rng = np.random.default_rng(14)
    tokens = [rng.integers(0, most, n).astype(np.uint64) for most, n in ((10**6, 3000), (7, 400), (1, 120), (50, 12), (10**6, 5))]
    for least in (1, 6, 46):
        got = compact_windows.keyed_windows(tokens, least, bands=3)
        want = []
        ends = np.cumsum([len(t) for t in tokens])
        flat = np.concatenate(tokens)
        for band in range(3):
            one, two = (compact_windows._values(flat, 2 * band + j) for j in (0, 1))
            for doc, (s, e) in enumerate(zip(ends - [len(t) for t in tokens], ends)):
                open_ = [(s, e)]
                while open_:
                    lo, hi = open_.pop()
                    if hi - lo < least or lo == hi:
                        continue
                    c = lo + int(np.argmin(one[lo:hi]))
                    open_ += [(lo, c), (c + 1, hi)]
                    a, b = lo, hi
                    while b - a >= least:
                        d = a + int(np.argmin(two[a:b]))
                        want.append((doc, c - s, a - s, b - s, band, int(flat[c]), int(flat[d])))
                        if d == c:
                            break
                        a, b = (d + 1, b) if d < c else (a, d)
        # one row a key and place: of repeated ones the first that was found stays
        assert {(r[0], r[1], r[2], r[3]) for r in want} >= set(got[["doc", "at", "lo", "hi"]].itertuples(index=False, name=None))
        assert len(got) == len({(r[0], r[1], r[4], r[5], r[6]) for r in want})
    values = compact_windows._values(tokens[0], 0)
    at, low = compact_windows._minima(values, 46)
    assert len(at) < 3000 / 8  # before: all positions were looked at on every level
    assert at.tolist() == sorted({i + int(np.argmin(values[i:i + 46])) for i in range(3000 - 45)})
    assert low.tolist() == [*values[at].tolist(), int(values[-1])]
