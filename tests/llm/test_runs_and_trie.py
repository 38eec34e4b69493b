"""Operators 12 and 13, against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from corpusflow.llm import periodic_runs, prefix_trie

SMALL = "/root/testdata/sf0.001"


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            part = w[i:j + q]
            if len(part) >= max(6, 4 * q) and not any(
                    all(part[k] == part[k + r] for k in range(len(part) - r)) for r in range(1, q)):
                out.append((i, len(part), q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_rebuilt(w, doc_id):
    n = len(w)
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def plain_op13(doc_id, text):
    w = plain_rebuilt(brute.WORD.findall(text or ""), doc_id)
    runs = plain_runs(w)
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(400):
        docs = []
        for _ in range(rng.randint(1, 4)):
            w = [str(rng.randint(1, rng.choice([1, 2, 3, 9]))) for _ in range(rng.randint(0, 60))]
            if len(w) > 8 and rng.random() < 0.5:
                a, p = rng.randrange(len(w)), rng.randint(1, 7)
                w = [w[i] if i < a else w[min(a + (i - a) % p, i)] for i in range(len(w))]
            docs.append(w)
        assert periodic_runs.runs_of(docs) == [plain_runs(w) for w in docs]


def test_runs_stay_in_their_text():
    assert periodic_runs.runs_of([["a"] * 4, ["a"] * 5, [], ["a"] * 6]) == [[], [], [], [(0, 6, 1)]]
    assert periodic_runs.runs_of([["a"] * 200_001]) == [[(0, 200_001, 1)]]
    assert periodic_runs.collapsed(list("xabababab"), [(1, 8, 2)]) == ["x", "a", "b"]


@pytest.mark.parametrize("size", [1, 5, 200, 997])
def test_rebuilt_words(size):
    w = [str(i) for i in range(size)]
    for i in range(300):
        assert periodic_runs.rebuilt(w, i) == plain_rebuilt(w, i)


def test_periodic_runs_of_all_documents(spark):
    docs = brute.read(SMALL, "documents")
    got = {r[0]: tuple(r[1:]) for r in periodic_runs.op13_periodic_runs(spark, SMALL).collect()}
    assert got == {i: plain_op13(i, t) for i, t in zip(docs["doc_id"].tolist(), docs["text"])}


def test_periodic_runs_of_odd_rows(odd, none):
    rows = periodic_runs.periodic_runs(odd).collect()
    texts = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in odd.select("doc_id", "text").collect()))
    assert len(rows) == len(texts)
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[None]["runs"] == [] and by_id[None]["n_words"] == 8
    assert [tuple(x) for x in by_id[8]["runs"]] == [(0, 120_000, 4)] and by_id[8]["collapsed"] == "alpha beta gamma delta"
    assert by_id[3]["n_words"] == 0 and by_id[3]["collapsed"] == ""
    assert periodic_runs.periodic_runs(none).count() == 0


def plain_trie(rows):
    said = defaultdict(list)
    md = lambda r: int(hashlib.md5(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).hexdigest(), 16)
    half = lambda v: v - 2**64 if v >= 2**63 else v
    for c, t, r, x in rows:
        if c is not None:
            said[c].append((c, t, r or "", x or ""))
    for v in said.values():
        v.sort(key=lambda r: (r[1] is not None, r[1] or 0, half(md(r) >> 64), half(md(r) % 2**64)))
    full = {}
    for c, v in said.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        full[c] = tuple(r[2:] for r in said.get(base, [])[:h]) + tuple(r[2:] for r in v[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(full):
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
        ends[full[c]].append(c)
    kids = defaultdict(list)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) if kids[k] else 1
        saved[k] = (len(members[k]) - 1) * len(k[-1][1] if k else "") + sum(saved[x] for x in kids[k])
    return sorted((m[0], len(k), members[k[:-1]][0] if k else -1, len(m), len(kids[k]), leaves[k], saved[k],
                   hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, m in members.items())


def got(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def trie(df):
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt_paths(df))


TURNS = "conv_id long, turn long, role string, text string"


def test_trie_of_odd_conversations(spark):
    rows = [(None, 1, "user", "lost"), (0, None, "user", "first"), (0, 0, None, None), (0, 0, "user", ""), (0, 0, "user", ""),
            (0, 3, "user", "x" * 5000), (7, 0, "user", "first"), (7, 1, None, "é"), (8, 0, "user", "first"), (8, 1, None, "é"),
            (-3, 0, "a", "b"), (-3, 1, "ab", ""), (250, 0, "user", "orphan of no base"), (250, 1, "user", "more"), (107, 5, "", "")]
    df = spark.createDataFrame(rows, TURNS)
    for c in ("conv", "x", "y", "depth", "hx", "n", "h", "task", "place"):
        df = df.withColumn(c, F.lit("clash"))
    assert got(trie(df)) == plain_trie(rows)
    assert trie(df.limit(0)).count() == 0


def test_deep_and_wide_trie(spark):
    """Several bands of bands, one conversation with most rows, and many equal conversations."""
    rng = random.Random(5)
    rows = [(300, t, "user", str(t % 7)) for t in range(700)] + [(302, t, "user", str(t % 7)) for t in range(600)]
    rows += [(c, t, "user", "again") for c in range(400, 700) for t in range(3)]
    rows += [(c, t, rng.choice("ab"), rng.choice("xy")) for c in range(40) for t in range(rng.randint(1, 30))]
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    assert got(trie(df)) == plain_trie(rows)


def test_rollup_does_not_depend_on_the_band(spark):
    paths = [(c, d, hash((c // 2 if d < 9 else c, d)) if d else 0, d) for c in range(6) for d in range(20)]
    p = spark.createDataFrame(paths, "conv long, depth long, hx long, hy long")
    nodes = p.groupBy("hx", "hy").agg(F.min("conv").alias("conv"), F.max("depth").alias("depth")).withColumn("one", F.lit(1).cast("long"))
    sums = [sorted(map(tuple, prefix_trie.rollup(p, nodes, ["one"], 19, b).collect())) for b in (2, 3, 16, 64)]
    assert sums[0] == sums[1] == sums[2] == sums[3]
    assert max(x[2] for x in sums[0]) == nodes.count()


def test_long_id_lists_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    df = spark.range(-20, 3000).selectExpr("id % 2 as k", "id as v").repartition(7)
    want = {k: hashlib.sha256(",".join(str(v) for v in range(-20, 3000) if (v - k) % 2 == 0 and (v >= 0 or k <= 0)).encode()).hexdigest()
            for k in (0,)}
    found = {r["k"]: r["ends"] for r in prefix_trie.ordered_hashes(df, ["k"], "v").collect()}
    assert found[0] == want[0]


def test_a_stored_table_leaves_no_shuffle_files(spark):
    import glob
    import time

    from corpusflow.llm import common

    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def shuffled():
        return {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}

    old = shuffled()
    df = common.stored(spark.range(10000).groupBy(F.pmod("id", F.lit(97)).alias("k")).count().repartition(3), "counts")
    for _ in range(50):  # files are removed beside the next steps
        if not shuffled() - old:
            break
        time.sleep(0.1)
    assert not shuffled() - old  # before: they stayed until the driver's next garbage collection
    assert df.count() == 97 and spark.conf.get(common._CLEANUP, None) is None
