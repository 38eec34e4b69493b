"""Operators 6, 8 and 10, against plain Python and SQL."""

import hashlib
import itertools
import math
import random
import time

import brute
import duckdb
import pytest

from corpusflow.llm import mix_tree, quality_rules, secrets

SMALL = "/root/testdata/sf0.001"


def test_rules_match_brute_force(spark):
    got = quality_rules.op6_quality_rules(spark, SMALL).toPandas().set_index("doc_id")
    docs = brute.read(SMALL, "documents").set_index("doc_id")
    want = {i: brute.base_rules(t) for i, t in docs["text"].items()}
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert {i: tuple(r) for i, r in zip(got.index, got[cols].itertuples(index=False))} == want
    assert not (got["kept"] & got["base_failed"]).any()
    good = brute.read(SMALL, "labels").set_index("doc_id")["quality"]
    both = got.join(good, how="inner")
    assert both.loc[(both["quality"] == 1) & ~both["base_failed"], "kept"].all()


def test_rules_on_odd_rows(odd, none):
    got = quality_rules.apply_rules(odd).toPandas()
    assert len(got) == 11
    by = {(-1 if r.doc_id != r.doc_id else int(r.doc_id)): r for r in got.itertuples()}
    assert by[3].n_words == by[4].n_words == by[5].n_words == 0 and not by[3].kept
    assert by[8].n_words == 120_000 and by[8].n_repeat_words == 120_000 and by[8].base_failed
    assert quality_rules.keep_good(odd).columns == odd.columns
    assert quality_rules.apply_rules(none).count() == 0


def test_kept_rows_are_unchanged(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = quality_rules.keep_good(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    fine = quality_rules.apply_rules(docs).where("kept").select("doc_id").toPandas()["doc_id"]
    want = docs.toPandas()
    want = want[want["doc_id"].isin(fine)].sort_values("doc_id").reset_index(drop=True)
    assert kept.equals(want)


def test_unknown_measure_is_an_error():
    with pytest.raises(ValueError):
        quality_rules.compile_rules((quality_rules.Rule("nope", 1),))


def test_mix_matches_sql_and_steps(spark):
    got = mix_tree.op8_source_mix(spark, SMALL).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    want = con.execute(mix_tree.ORACLE).fetchdf().sort_values("doc_id").reset_index(drop=True)
    assert got.equals(want[got.columns])
    docs = brute.read(SMALL, "documents").sort_values("doc_id")
    rows = [(i, s, len(brute.words(t))) for i, s, t in zip(docs["doc_id"], docs["source"], docs["text"])]
    steps = brute.mix_taken(rows)
    assert [(r.source_size, r.taken) for r in got.itertuples()] == [(a, c) for a, _, c in steps]
    assert all(abs(r.target - b) < 1e-6 for r, (_, b, _) in zip(got.itertuples(), steps))
    assert (got["taken"] <= 2 * got["size"]).all()


def test_tree_splits_blocks_exactly(spark):
    quotas = spark.createDataFrame([(0, 1000), (1, 0), (2, 17), (3, 333)], "_no int, blocks long")
    for shards in (1, 2, 5, 16):
        got = {r["_no"]: list(r["ends"]) for r in mix_tree.split_tree(quotas, shards, "s").collect()}
        assert {k: v[-1] for k, v in got.items()} == {0: 1000, 1: 0, 2: 17, 3: 333}
        assert all(len(v) == shards and v == sorted(v) for v in got.values())
        loads = [sum(v[k] - (v[k - 1] if k else 0) for v in got.values()) for k in range(shards)]
        assert max(loads) - min(loads) <= shards  # even shards
        again = {r["_no"]: list(r["ends"]) for r in mix_tree.split_tree(quotas, shards, "s").collect()}
        assert got == again


def test_spans_cover_what_is_taken(spark):
    rows = mix_tree.sized(spark.read.parquet(f"{SMALL}/documents.parquet"))
    plan = mix_tree.plan(rows, shards=4, block_words=64).select("size", "source_size", "target", "source", "spans").collect()
    per = {}
    for r in plan:
        for p in (0, 1):
            own = sorted((s["start"], s["n"]) for s in r["spans"] if s["pass"] == p)
            at = 0
            for a, n in own:
                assert a == at and n > 0
                at += n
            assert at <= r["size"]
        assert all(0 <= s["shard"] < 4 for s in r["spans"])
        per.setdefault(r["source"], [0, r["target"]])[0] += sum(s["n"] for s in r["spans"])
    assert all(taken == int(target) for taken, target in per.values())


def test_mix_on_odd_rows(odd, none):
    out = mix_tree.mixed(odd)
    assert out.columns == odd.columns
    got = out.toPandas()
    assert not got["doc_id"].isin([3, 4, 5]).any()  # nothing to take
    assert (got["n_chars"] == got["text"].str.len()).all()
    assert mix_tree.mixed(none).count() == 0
    rows = mix_tree.sized(odd.select("doc_id", "source", "text"))
    narrow = mix_tree.plan(rows).select("doc_id", "source", "size", "spans").collect()
    want = brute.mix_taken([(r["doc_id"], r["source"], r["size"]) for r in narrow])
    assert sum(s["n"] for r in narrow for s in r["spans"]) == sum(w[2] for w in want)


def test_mix_comes_by_the_drawn_shards(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = mix_tree.mixed(docs, shards=4, shard="shard").collect()
    plan = {r["doc_id"]: r["spans"] for r in mix_tree.plan(mix_tree.sized(docs), shards=4).select("doc_id", "spans").collect()}
    want = sorted((i, next(s["shard"] for s in x if s["pass"] == p)) for i, x in plan.items() for p in {s["pass"] for s in x})
    assert sorted((r["doc_id"], r["shard"]) for r in out) == want
    shards = [r["shard"] for r in out]
    assert shards == sorted(shards) and set(shards) == {0, 1, 2, 3}
    for k in range(4):
        sources = [r["source"] for r in out if r["shard"] == k]
        assert sources != sorted(sources)  # shuffled, not source after source


def test_secrets_match_brute_force(spark, odd, none):
    docs = brute.read(SMALL, "documents").set_index("doc_id")["text"]
    got = secrets.op10_secret_scan(spark, SMALL).toPandas()
    assert len(got) == len(docs)
    for r in got.itertuples():
        want = brute.base_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    kinds = secrets.scan(odd).toPandas()
    assert len(kinds) == 11 and kinds["n_assign"].sum() == 1
    assert secrets.scan(none).count() == 0


def test_secret_cases():
    cases = ["token=abc token=secret:abcdefgh", "API_KEY = 'abcdefgh' Password:x", "x AKIA" + "A" * 15 + " AKIA" + "B" * 16,
             "f" * 23 + "g" + "0" * 24, "toKen=abcdefgh", "ſecret=abcdefgh", "passwd\" : \"a.b/c=d-e\"", ""]
    for t in cases:
        assert secrets.joined(secrets.base_spans(t)) == brute.base_spans(t), t


def test_guess_cost_orders_values():
    cheap = ["password123", "changeme", "qwertyuiop", "aaaaaaaaaaaa", "20240115", "P@ssw0rd1"]
    dear = ["k8Jx-29sPq_11", "hT7$gQ2!vZ", "xK92mfw83jslq"]
    assert max(map(secrets.guess_cost, cheap)) < 8 < min(map(secrets.guess_cost, dear))
    assert secrets.guess_cost("") == 0
    long = secrets.guess_cost("xK9" * 5000)
    assert long > 100


def test_values_in_context_are_added_and_redacted(spark):
    text = "pwd: k8Jx-29sPq_11 then login = changeme12 and token=abcdef123"
    base, spans = secrets.find(text)
    assert [text[a:b] for a, b, k in spans if k == "guess"] == ["k8Jx-29sPq_11"]
    docs = spark.createDataFrame([(1, text, 7), (2, None, 8)], "doc_id long, text string, extra int")
    out = secrets.redact(docs, "#").orderBy("doc_id").collect()
    assert out[0]["text"] == "pwd: # then login = changeme12 and #" and out[1]["text"] is None and out[0]["extra"] == 7


def test_values_of_one_class_and_after_a_scheme_are_found():
    guessed = lambda t: [t[a:b] for a, b, k in secrets.find(t)[1] if k == "guess"]
    for name in ("pwd: ", "passphrase: ", "login = "):
        assert guessed(f"x {name}qzvkxjwpltmrhgbn.") == ["qzvkxjwpltmrhgbn"]
    assert guessed("pin: 4839571846") == ["4839571846"]
    assert guessed("Authorization: Bearer q7Zt-x2Lw9vKd4") == guessed("auth: Basic q7Zt-x2Lw9vKd4") == ["q7Zt-x2Lw9vKd4"]
    for prose in ("login: information", "pin: placement", "auth: required for everybody", "secret = unbelievable", "login: Government"):
        assert guessed(prose) == [], prose


def plain_cost(value, ranks):
    """The cheapest of all segmentations, tried one by one."""
    if not value:
        return 0.0
    low = value.lower()
    plain = low.translate(secrets.LEET)
    n, cut = len(value), secrets.CUT

    def kinds(a, b):
        part = low[a:b]
        # only a value's leading brute-force run has no cut before it
        yield sum(secrets._char_cost(c) for c in value[a:b]) - (cut if a == 0 else 0)
        if b - a >= 2 and plain[a:b] in ranks:
            yield (ranks[plain[a:b]] + (0 if value[a:b].islower() else cut) + cut * sum(x != y for x, y in zip(part, plain[a:b])))
        for same, cost in ((lambda x, y: x == y, secrets._char_cost(part[0]) + math.log10(b - a)),
                           (lambda x, y: x + y in secrets.WALKS, math.log10(47) + math.log10(4) * math.log2(b - a)),
                           (lambda x, y: ord(y) - ord(x) == 1, math.log10(26) + math.log10(b - a)),
                           (lambda x, y: ord(y) - ord(x) == -1, math.log10(26) + math.log10(b - a))):
            inside = all(same(x, y) for x, y in zip(part, part[1:]))
            maximal = (a == 0 or not same(low[a - 1], low[a])) and (b == n or not same(low[b - 1], low[b]))
            if b - a >= 3 and inside and maximal:
                yield cost
        if (a, b) in dates:
            yield math.log10(365 * 60 if b - a > 4 else 100)

    dates = {m.span() for m in secrets.DATE.finditer(low)}
    best = math.inf
    for cuts in itertools.product([0, 1], repeat=max(0, n - 1)):
        at = [0, *(k + 1 for k, c in enumerate(cuts) if c), n]
        best = min(best, sum(min(kinds(a, b)) + cut for a, b in zip(at, at[1:])))
    return best


def test_guess_cost_is_the_cheapest_segmentation():
    ranks = {"pass": 0.5, "word": 0.9, "password": 0.3, "no": 1.1, "at": 1.4, "ass": 2.0}
    rng = random.Random(5)
    bits = ["pass", "P4ss", "word", "no", "1999", "12", "abc", "cba", "qwe", "aaa", "zz", "!", "X", "7", "at"]
    for _ in range(120):
        value = "".join(rng.choice(bits) for _ in range(rng.randint(0, 5)))[:11]
        want = plain_cost(value, ranks)
        assert secrets.guess_cost(value, ranks, 8) == pytest.approx(want), value
        for enough in (1.0, 3.0, 6.0):
            assert (secrets.guess_cost(value, ranks, 8, enough=enough) >= enough) == (want >= enough - 1e-12), value


def test_crowded_and_long_texts_take_linear_time():
    started = time.time()
    text = "\n".join(f"password: hunter{k}zz and pin = x{k}" for k in range(100_000))
    base, spans = secrets.find(text)
    assert len(base) == 100_000 and len(spans) >= len(base)
    assert len(secrets.find("login = " + "xK9q" * 100_000)[1]) == 1
    assert time.time() - started < 60
