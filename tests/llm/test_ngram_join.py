"""Operator 11, against plain Python."""

import random

import brute
import numpy as np
import pytest

from corpusflow.llm import ngram_join


def links(sets, percent=85):
    """All pairs of keys whose sets share a member and link."""
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    out = set()
    for a, b in {(a, b) for x in by.values() for a in x for b in x if a < b}:
        n = len(sets[a] & sets[b])
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            out.add((a, b))
    return out


def check(spark, rows):
    """``rows`` of (id, text), ids repeating freely."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    sets = {k: brute.shingles(t, 4) for k, (_, t) in enumerate(rows)}
    ids = [i for i, _ in rows]
    comp = brute.components(set(ids), [(ids[a], ids[b]) for a, b in links({k: s for k, s in sets.items() if ids[k] is not None})])
    want = sorted((i, len(sets[k]), comp[i]) for k, (i, _) in enumerate(rows))
    assert sorted(map(tuple, ngram_join.jaccard_components(df).collect())) == want
    return comp


def sample(rng, n):
    return np.unique(np.array([rng.getrandbits(64) for _ in range(n)], dtype=np.uint64))


def varied(rng, s, out, new):
    keep = s.tolist()
    rng.shuffle(keep)
    return np.unique(np.array(keep[out:] + [rng.getrandbits(64) for _ in range(new)], dtype=np.uint64))


def test_linked_sets_share_a_key():
    rng, bands, seen = random.Random(2), ngram_join.Bands(), 0
    for _ in range(3000):
        a = sample(rng, rng.choice([1, 3, 5, 6, 7, 8, 11, 12, 13, 14, 15, 20, 30, 60, 150, 400]))
        k = rng.randint(0, max(1, len(a) // 7))
        out = rng.randint(0, min(k, len(a) - 1))
        b = varied(rng, a, out, k - out)
        n = len(np.intersect1d(a, b))
        if 100 * n >= 85 * (len(a) + len(b) - n) and not np.array_equal(a, b):
            seen += 1
            assert len(np.intersect1d(bands.keys(a), bands.keys(b))), (len(a), len(b), n)
    assert seen > 1000


def test_trie_join_is_the_join():
    rng = random.Random(4)
    for _ in range(150):
        base = [sample(rng, rng.choice([2, 5, 10, 40, 200])) for _ in range(3)]
        pick = lambda: varied(rng, s := rng.choice(base), rng.randint(0, len(s) // 6), rng.randint(0, len(s) // 12 + 1))
        rows = [pick() for _ in range(rng.randint(1, 25))]
        rows.append(rows[0])
        roots = [rng.randint(0, 2) for _ in rows]
        queries = [pick() for _ in range(rng.randint(1, 10))]
        asked = [rng.randint(0, 3) for _ in queries]
        x, y = ngram_join.trie_join(roots, rows, asked, queries, 85)
        sets, asks = [set(r.tolist()) for r in rows], [set(q.tolist()) for q in queries]
        want = {(q, r) for q in range(len(queries)) for r in range(len(rows))
                if asked[q] == roots[r] and 100 * len(asks[q] & sets[r]) >= 85 * len(asks[q] | sets[r])}
        assert len(x) == len(want) and set(zip(x.tolist(), y.tolist())) == want


def text(rng, n):
    return [f"w{rng.randrange(10_000)}" for _ in range(n)]


def edit(rng, w, share):
    return [f"e{rng.randrange(10**9)}" if rng.random() < share else x for x in w]


def test_components_of_many_kinds(spark):
    rng = random.Random(6)
    passage = text(rng, 60)
    docs = []
    for _ in range(12):
        w = text(rng, rng.choice([3, 6, 9, 14, 40, 120, 400]))
        for _ in range(rng.randint(1, 12)):
            docs.append(edit(rng, w, rng.choice([0, 0.003, 0.01, 0.02, 0.04])))
    for _ in range(60):  # a passage that many share, and nothing else
        docs.append(text(rng, rng.randint(5, 200)) + passage + text(rng, rng.randint(5, 200)))
    w = text(rng, 90)
    docs += [w[:k] for k in range(60, 91)]  # a chain: neighbours link, ends do not
    docs += [w + w] * 5
    rng.shuffle(docs)
    rows = [(1000 - k, " ".join(d)) for k, d in enumerate(docs)]
    comp = check(spark, rows)
    assert len(set(comp.values())) > 60


def test_group_whose_centre_is_hidden(spark, monkeypatch):
    """Members link with one text in the middle of the group, hardly with each other; blocks are small here."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "STAR", 8)
    rng = random.Random(8)
    w = text(rng, 300)
    docs = [edit(rng, w, 0.019) for _ in range(40)] + [w] + [edit(rng, w, 0.035) for _ in range(40)]
    check(spark, [(k, " ".join(d)) for k, d in enumerate(docs)])


def test_one_id_with_several_texts(spark):
    rng = random.Random(9)
    a, b, c = text(rng, 200), text(rng, 200), text(rng, 50)
    rows = [(7, a), (7, b), (7, b), (8, edit(rng, b, 0.005)), (9, edit(rng, a, 0.005)), (3, c), (7, c), (2, c[:20]), (11, ["A", "b"]), (1, ["a", "B"])]
    check(spark, [(i, " ".join(t)) for i, t in rows])


def test_odd_rows(spark, odd, none):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(odd).collect()}
    assert (None, 5, None) in got and (3, 0, 3) in got and (4, 0, 4) in got and (5, 0, 5) in got
    assert (2, 11, 1) in got and (7, 1, 6) in got and (8, 4, 8) in got
    assert ngram_join.jaccard_components(odd).count() == odd.count()
    assert ngram_join.jaccard_components(none).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 1000])
def test_packed_numbers(n):
    v = np.random.default_rng(n).integers(0, 2**48, n).astype(np.uint64)
    assert (ngram_join._unpack(ngram_join._pack(v)) == v).all()


def test_bitmaps_never_rule_a_link_out():
    rng = random.Random(13)
    for _ in range(400):
        a = sample(rng, rng.choice([1, 5, 40, 300, 3000]))
        out = rng.randint(0, len(a) - 1)
        b = varied(rng, a, out, rng.randint(0, out + 1))
        apart = len(np.setxor1d(a, b))
        whole = [ngram_join.parity(a), ngram_join.parity(b)]
        for pair in (whole, [ngram_join.folded(x) for x in whole], [whole[0], ngram_join.folded(whole[1])]):
            x, y = ngram_join._same_length(pair)
            assert int(np.bitwise_count(x ^ y).sum()) <= apart


def test_folded_bitmaps_rule_out_sets_that_share_nothing():
    rng = np.random.default_rng(21)
    for n in (120, 250, 500, 1000):
        sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for _ in range(40)]
        folded = [ngram_join.folded(ngram_join.parity(s)) for s in sets]
        far = [int(np.bitwise_count(np.bitwise_xor(*ngram_join._same_length([folded[i], folded[j]]))).sum()) for i in range(40) for j in range(i)]
        assert min(far) > 2 * n * 15 // 115
