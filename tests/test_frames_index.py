import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusflow.operators import frames as G
from corpusflow.operators import index


@pytest.mark.parametrize("total", [0, 1, 99, 100, 199, 200, 250])
def test_stride_counts(spark, total):
    df = spark.range(total).select(F.lit(1).alias("video_id"), F.col("id").alias("frame_no"))
    got = G.stride_sample(df, "video_id", "frame_no", None, 100).count()
    interval = max(1, total // 100)
    assert got == len([n for n in range(total) if n % interval == 0])


def corr(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    da, db = a - a.mean(), b - b.mean()
    den = math.sqrt((da * da).sum() * (db * db).sum())
    return 1.0 if den == 0 else (da * db).sum() / den


def test_dedup_invariant_and_edge_cases(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=16)
    hs = [base, base, base + 0.01 * rng.normal(size=16), rng.normal(size=16), np.ones(16), np.ones(16)]
    drift = [base + 0.3 * i * np.ones(16) + 0.2 * i * np.arange(16) for i in range(6)]
    rows = [(1, i, [float(x) for x in h]) for i, h in enumerate(hs)] + \
           [(2, i, [float(x) for x in h]) for i, h in enumerate(drift)] + [(3, 0, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "video_id long, frame_no long, hist array<double>")
    kept = G.dedup_sequence(df, threshold=0.9).collect()
    by = {}
    for r in kept:
        by.setdefault(r.video_id, []).append((r.frame_no, r.hist))
    for v, fr in by.items():
        fr.sort()
        for (_, a), (_, b) in zip(fr, fr[1:]):
            assert not corr(b, a) > 0.9  # each kept frame differs from the last kept one
    assert [f for f, _ in sorted(by[1])][:2] == [0, 3]
    assert len(by[3]) == 1
    # constant histograms correlate as 1.0 (identical, so the second is dropped)
    pair = spark.createDataFrame([([1.0, 1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert pair.select(G.hist_similarity(F.col("a"), F.col("b")).alias("c")).first().c == 1.0


def ref_resize(w, h):
    wr = 800 / w if w < 800 else 1
    hr = 600 / h if h < 600 else 1
    s = max(wr, hr)
    if (w < 800 or h < 600) and s > 1:
        return int(w * s), int(h * s)
    return w, h


def test_image_and_frame_resize_edges(spark):
    sizes = [(800, 600), (799, 600), (400, 900), (1980, 10), (1981, 10), (1, 1)]
    df = spark.createDataFrame(sizes, "w long, h long")
    got = df.select(G.image_resize_plan(F.col("w"), F.col("h")).alias("p")).collect()
    assert [(r.p.new_width, r.p.new_height) for r in got] == [ref_resize(w, h) for w, h in sizes]
    fr = df.select(G.frame_resize_plan(F.col("w"), F.col("h")).alias("p")).collect()
    assert [(r.p.new_width, r.p.new_height) for r in fr][4] == (1980, 10)


def test_ocr_text(spark):
    toks = spark.createDataFrame([
        (1, 0, 0, 61.0, "  Hello "), (1, 0, 1, 60.0, "low"), (1, 0, 2, 90.0, "x"), (1, 0, 3, 95.0, "world"),
        (1, 1, 0, 10.0, "gone"), (1, 2, 0, 99.0, "next")], "video_id long, frame_no long, token_no long, conf double, text string")
    r = G.ocr_text(toks).first()
    assert r.text == "Hello world\nnext" and r.n_frames == 2


def test_insert_if_absent_idempotent(spark, tmpdir_path):
    path = f"{tmpdir_path}/coll"
    rows = spark.createDataFrame([("a_0", "x", 0), ("a_1", "y", 1)], "id string, document string, chunk_index int")
    assert index.add_to_collection(rows, path) == 2
    assert index.add_to_collection(rows, path) == 0  # run twice = once
    longer = spark.createDataFrame([("a_0", "CHANGED", 0), ("a_2", "z", 2), ("a_2", "z2", 2)],
                                   "id string, document string, chunk_index int")
    assert index.add_to_collection(longer, path) == 1  # only the new tail id
    stored = {r.id: r.document for r in spark.read.parquet(path).collect()}
    assert stored["a_0"] == "x" and set(stored) == {"a_0", "a_1", "a_2"}


def test_dimension_guard(spark, tmpdir_path):
    props = f"{tmpdir_path}/props"
    assert index.ensure_dimension(spark, props, 64, "hash") == "created"
    assert index.ensure_dimension(spark, props, 64, "hash") == "ok"
    with pytest.raises(index.CollectionDimensionError):
        index.ensure_dimension(spark, props, 32, "other")
    assert index.ensure_dimension(spark, props, 32, "other", allow_reset=True,
                                  collection_path=f"{tmpdir_path}/c") == "reset"


def test_reset_keeps_the_columns(spark, tmpdir_path):
    from corpusflow.operators import index

    props, coll = f"{tmpdir_path}/props", f"{tmpdir_path}/coll"
    index.ensure_dimension(spark, props, 2, "m")
    rows = spark.createDataFrame([("a", [1.0, 2.0], "x")], "id string, embedding array<double>, document string")
    index.add_to_collection(rows, coll)
    assert index.ensure_dimension(spark, props, 3, "n", allow_reset=True, collection_path=coll) == "reset"
    index.add_to_collection(rows, coll)
    back = spark.read.parquet(coll)
    assert set(back.columns) == {"id", "embedding", "document"} and back.count() == 1
