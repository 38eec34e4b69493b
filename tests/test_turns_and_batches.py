"""Id ledger, logged searches, conversation turns, the batch sink and video text."""

import json
import os

import pytest
from pyspark.sql import functions as F

from corpusflow.config import DEFAULT
from corpusflow.operators import frames, history, prompt, search
from corpusflow.sources import batches, storage
from corpusflow.streaming import ingest, ledger, turns

REQUESTS = "query_id long, conversation_id long, query string"


def test_id_ranges_follow_each_other_and_survive_replays(spark, tmpdir_path):
    at = lambda b, n: ledger.reserve(spark, f"{tmpdir_path}/ids", b, n, start=100)
    assert [at(0, 5), at(1, 0), at(2, 7), at(7, 1)] == [100, 105, 105, 112]
    assert [at(2, 7), at(0, 5), at(8, 2)] == [105, 100, 113]
    with pytest.raises(ValueError):
        at(2, 8)


def test_a_batch_is_in_all_tables_or_in_none(spark, tmpdir_path, monkeypatch):
    a, b = spark.range(3), spark.range(10, 12)
    assert ledger.write_batch(spark, tmpdir_path, 0, {"x": a, "y": b})
    with monkeypatch.context() as m:
        m.setattr(storage, "create_text", lambda *a: (_ for _ in ()).throw(OSError("stopped before the commit")))
        with pytest.raises(OSError):
            ledger.write_batch(spark, tmpdir_path, 1, {"x": a, "y": b})
    read = lambda name, **k: sorted(r.id for r in ledger.read_table(spark, tmpdir_path, name, "id long", **k).collect())
    assert read("x") == [0, 1, 2] and read("y") == [10, 11] and read("z") == []
    assert ledger.write_batch(spark, tmpdir_path, 1, {"x": spark.range(50, 51)})
    assert not ledger.write_batch(spark, tmpdir_path, 1, {"x": spark.range(60, 61)})
    assert read("x") == [0, 1, 2, 50] and read("x", before=1) == [0, 1, 2] and read("y") == [10, 11]


def replay(requests, settings=DEFAULT):
    """Turn by turn: conversation -> messages, and the prompt of every query."""
    said, prompts, top = {}, {}, 0
    for batch in requests:
        new = sorted(q for q, c, t in batch if c is None and t and t.strip())
        ids = {q: top + k + 1 for k, q in enumerate(new)}
        top += len(new)
        for q, c, t in sorted(batch):
            if not t or not t.strip():
                continue
            own = said.setdefault(ids.get(q, c), [])
            told = "\n".join(f"{r}: {x}" for r, x in own[-settings.memory_limit:])
            prompts[q] = (f"### Previous Conversation:\n{told}\n\n### System:\n\n\n### Context:\nfound {t}\n\n### User:\n{t}\n\n### Assistant:\n")
            own.append(("user", t))
            if "fail" not in t:
                own.append(("assistant", t.strip()))
    return {c: m for c, m in said.items()}, prompts


def echo():
    """A class of its own, so that workers get it by value."""

    class Echo:
        def generate(self, prompts, settings):
            asked = [p.rsplit("### User:\n", 1)[1].split("\n\n### Assistant:\n")[0] for p in prompts]
            if any("fail" in a for a in asked):
                raise RuntimeError("no answer")
            return [[w if i == 0 else " " + w for i, w in enumerate(a.split(" "))] for a in asked]

    return Echo()


def test_turns_equal_a_step_by_step_replay(spark, tmpdir_path):
    given = [[(1, None, "hello there"), (2, 50, "a b"), (3, 50, "second of fifty"), (4, None, "x"), (5, 50, "third")],
             [(6, 50, "later"), (7, 1, "to the first new one"), (8, 2, "fail please"), (9, 2, "again"), (10, None, None), (11, 4, "  ")],
             [(12, 2, "last"), (13, None, "new again"), (14, 50, "and on")]]
    context = lambda q: q.select("query_id", F.concat(F.lit("found "), "query").alias("context"))
    run = lambda: [turns.answer_batch(spark.createDataFrame(b, REQUESTS), tmpdir_path, k, context, echo()) for k, b in enumerate(given)]
    assert run() == [True] * 3
    rows = ledger.read_table(spark, tmpdir_path, "messages", turns.MESSAGES).collect()
    assert run() == [False] * 3  # a replay writes nothing
    assert ledger.read_table(spark, tmpdir_path, "messages", turns.MESSAGES).count() == len(rows)
    want, prompts = replay(given)
    got = {}
    for r in sorted(rows, key=lambda r: r.id):
        got.setdefault(r.conversation_id, []).append((r.role, r.content))
        assert (r.prompt == prompts[r.query_id]) if r.role == "user" else r.prompt is None
    assert got == want and len({r.id for r in rows}) == len(rows)
    opened = ledger.read_table(spark, tmpdir_path, "conversations", turns.CONVERSATIONS)
    assert sorted(map(tuple, opened.collect())) == [(1, 1), (2, 4), (3, 13)]


def test_turns_after_a_failure_before_the_commit(spark, tmpdir_path, monkeypatch):
    context = lambda q: q.select("query_id", F.lit(None).cast("string").alias("context"))
    one = lambda k, rows: turns.answer_batch(spark.createDataFrame(rows, REQUESTS), tmpdir_path, k, context, echo())
    one(0, [(1, None, "first")])
    with monkeypatch.context() as m:
        m.setattr(ledger, "write_batch", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            one(1, [(2, 1, "second"), (3, None, "other")])
    one(1, [(2, 1, "second"), (3, None, "other")])
    rows = sorted((r.id, r.conversation_id, r.content) for r in ledger.read_table(spark, tmpdir_path, "messages", turns.MESSAGES).collect())
    assert rows == [(1, 1, "first"), (2, 1, "first"), (3, 1, "second"), (4, 1, "second"), (5, 2, "other"), (6, 2, "other")]
    assert not one(0, []) and one(2, [])


def test_logged_search_stream(spark, tmpdir_path):
    docs = spark.createDataFrame([(f"d{i}", [float(i), 1.0]) for i in range(12)], "id string, embedding array<double>")
    idx = search.build_index(docs, "id", "embedding")
    src = os.path.join(tmpdir_path, "req")
    for k, rows in enumerate([[(5, "a", 3), (2, "b", None)], [(1, "c", 90)]]):
        spark.createDataFrame(rows, REQUESTS.replace("conversation_id long, query string", "query string, n_results int")).coalesce(1).write.parquet(f"{src}/{k}")
    stream = spark.readStream.schema("query_id long, query string, n_results int").option("maxFilesPerTrigger", 1).parquet(f"{src}/*")

    class Two:
        dimension = 2

    embed = lambda c: F.array(F.length(c).cast("double"), F.lit(1.0))
    with pytest.MonkeyPatch.context() as m:
        m.setattr(ingest.embedding, "embed_column", lambda c, e=None: embed(c))
        for run in range(2):
            ingest.start_logged_search(stream, idx, f"{tmpdir_path}/log", f"{tmpdir_path}/ck{run}").awaitTermination()
    log = ledger.read_table(spark, f"{tmpdir_path}/log", "log", ingest.LOG).orderBy("id").collect()
    assert [r.id for r in log] == [1, 2, 3]
    assert {(r.query, r.num_results, r.effective_k, r.returned) for r in log} == {("a", 3, 10, 10), ("b", 5, 10, 10), ("c", 90, 50, 12)}
    assert all(r.query_response_time >= 0 for r in log)
    assert ledger.read_table(spark, f"{tmpdir_path}/log", "hits", ingest.HITS).count() == 32


def test_batches_are_counted_cut_and_committed_once(spark, tmpdir_path):
    df = spark.range(0, 1003, numPartitions=4).withColumn("text", F.concat(F.lit("t"), "id"))
    assert batches.write_batches(df, tmpdir_path, "one", 100) == 1003
    assert batches.write_batches(df, tmpdir_path, "one", 100) == 1003  # a replay
    assert batches.write_batches(df.limit(0), tmpdir_path, "none", 100) == 0
    assert batches.total(spark, tmpdir_path) == 1003
    sizes = [n for _, n in batches.jobs(spark, tmpdir_path)["one"]["files"]]
    assert max(sizes) == 100 and sum(sizes) == 1003 and len(sizes) == 12
    got = batches.read_batches(spark, tmpdir_path, df.schema)
    assert got.count() == 1003 and got.select("id").distinct().count() == 1003 and got.exceptAll(df).count() == 0
    assert batches.read_batches(spark, f"{tmpdir_path}/x", df.schema).count() == 0
    with pytest.raises(Exception):
        df.write.format(batches.FORMAT).mode("overwrite").save(tmpdir_path)


def test_a_failed_job_lists_nothing(spark, tmpdir_path):
    bad = spark.range(0, 300, numPartitions=3).select(F.when(F.col("id") == 250, F.raise_error(F.lit("broken row"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception):
        batches.write_batches(bad, tmpdir_path, "job", 10)
    assert batches.jobs(spark, tmpdir_path) == {} and batches.read_batches(spark, tmpdir_path, "id long").count() == 0
    assert batches.write_batches(spark.range(300), tmpdir_path, "job", 10) == 300
    assert batches.read_batches(spark, tmpdir_path, "id long").select("id").distinct().count() == 300
    # a list that exists wins over a repeated attempt's files
    text = storage.read_text(spark, f"{tmpdir_path}/jobs/job.json")
    batches.write_batches(spark.range(5), tmpdir_path, "job", 10)
    assert storage.read_text(spark, f"{tmpdir_path}/jobs/job.json") == text and json.loads(text)["rows"] == 300


def test_video_text_of_a_small_table(spark):
    rows = [("v", k, 50.0 if k != 1 else 10.0, 600 if k != 2 else 5, [float(k // 4), 1.0, 2.0 * (k % 3)]) for k in range(8)]
    rows += [("dark", 0, None, 900, [1.0, 2.0, 0.0]), ("bare", 0, 90.0, 900, [1.0, 2.0, 0.0])]
    f = spark.createDataFrame(rows, "video_id string, frame_no long, brightness double, edge_count long, hist array<double>")
    toks = spark.createDataFrame([(v, k, t, c, w) for v, k, *_ in rows if v != "bare" for t, c, w in ((0, 99.0, f" w{k} "), (1, 60.0, "low"), (2, 90.0, "x"), (3, 80.0, "end"))],
                                 "video_id string, frame_no long, token_no int, conf double, text string")
    kept = frames.dedup_sequence(f.where("video_id = 'v' and frame_no not in (1, 2)"), "video_id", "frame_no", "hist", 0.9)
    want = sorted(r.frame_no for r in frames.cap_frames(kept, "video_id", "frame_no", 3).collect())
    got = {r.video_id: r for r in frames.video_text(f.where("video_id <> 'none'"), toks, max_frames=3, total_col=None, threshold=0.9).collect()}
    # 8 frames and max_frames 3: every second frame is looked at
    seen = [k for k in (0, 4, 6)]
    assert set(got) == {"v"} and got["v"].text.split("\n") == [f"w{k} end" for k in seen[:got["v"].n_frames]]
    assert want and frames.video_text(f.limit(0), toks).count() == 0 and frames.video_text(f, toks.limit(0)).count() == 0


def test_replay_writes_no_file(spark, tmpdir_path):
    import glob

    for _ in range(2):
        assert batches.write_batches(spark.range(50), tmpdir_path, "again", 10) == 50
    listed = {n for n, _ in batches.jobs(spark, tmpdir_path)["again"]["files"]}
    assert len(glob.glob(f"{tmpdir_path}/files/again/*.parquet")) == len(listed)


def test_batches_for_python_are_bounded_in_bytes(spark):
    from pyspark.sql import functions as F

    from corpusflow.plans.retrieval import _prep
    from corpusflow.session import BATCH_BYTES

    _prep(spark)
    df = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
    sizes = [r.n for r in df.mapInPandas(lambda it: (f.assign(n=f["t"].str.len().sum())[["n"]].head(1) for f in it), "n long").collect()]
    assert sum(sizes) == 40 << 20 and max(sizes) <= BATCH_BYTES + (1 << 20)
