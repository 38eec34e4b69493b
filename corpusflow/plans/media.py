"""Registered frame / OCR / size-planning queries (G1-G11) over stand-in tables.

``events``: user_id = video, (ts, event_id) = frame order, value = brightness,
props.k * 10 = edge pixels. ``embeddings``: label = video, vec_id = frame
order, embedding = histogram. ``documents``: lines = frames, words = OCR
tokens, confidence from md5(word). Sizes come from ``part`` and ``lineitem``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.config import DEFAULT
from corpusflow.functions.partitions import spread
from corpusflow.operators import frames as G
from corpusflow.plans.retrieval import _prep
from corpusflow.sources.tables import read_table

STRIDE_MAX = 10  # max_frames used by the events stand-in (videos there have < 100 frames)
DEDUP_THRESHOLD = 0.2  # random histograms rarely correlate above the default 0.9


def event_frames_table(spark, base) -> DataFrame:
    _prep(spark)
    ev = read_table(spark, base, "events")
    f = ev.select(F.col("user_id").alias("video_id"), "ts", "event_id", F.col("value").alias("brightness"),
                  (F.get_json_object("props", "$.k").cast("long") * 10).alias("edge_count"))
    return G.number_frames(f, "video_id", ["ts", "event_id"], "frame_no")


def frame_stride(spark, base):
    """G1: stride sampling with max_frames = 10."""
    f = G.stride_sample(event_frames_table(spark, base), "video_id", "frame_no", None, STRIDE_MAX)
    return f.select("video_id", "frame_no", "event_id")


def frame_relevance(spark, base):
    """G1 then G2/G3: sampled frames that are bright and detailed enough."""
    f = G.stride_sample(event_frames_table(spark, base), "video_id", "frame_no", None, STRIDE_MAX)
    return f.filter(G.relevant(F.col("brightness"), F.col("edge_count"))).select("video_id", "frame_no", "event_id")


def frame_cap(spark, base):
    """G1, G2/G3 then G7: at most max_frames kept frames per video, earliest first."""
    f = G.stride_sample(event_frames_table(spark, base), "video_id", "frame_no", None, STRIDE_MAX)
    f = f.filter(G.relevant(F.col("brightness"), F.col("edge_count")))
    return G.cap_frames(f, "video_id", "frame_no", STRIDE_MAX).select("video_id", "frame_no")


def histogram_bins(spark, base):
    """Per video, counts of brightness values in 256 unit bins."""
    _prep(spark)
    ev = read_table(spark, base, "events").select(F.col("user_id").alias("video_id"), "value")
    return G.histogram(ev, ["video_id"], "value", 256)


def _hist_frames(spark, base) -> DataFrame:
    _prep(spark)
    e = read_table(spark, base, "embeddings").select(F.col("label").alias("video_id"), "vec_id",
                                                      F.col("embedding").alias("hist"))
    return G.number_frames(e, "video_id", ["vec_id"], "seq")


def histogram_corr(spark, base):
    """Correlation of each frame's histogram with the previous frame of its video."""
    f = _hist_frames(spark, base)
    p = G.consecutive_pairs(f, "video_id", "seq", ["vec_id", "hist"])
    return p.select("video_id", "vec_id", "prev_vec_id",
                    F.round(G.hist_similarity(F.col("hist"), F.col("prev_hist")), 6).alias("corr"))


def sequence_dedup(spark, base):
    """G1 + G6 + G7: stride (max 100), drop frames similar to the last kept one, cap at 100."""
    f = _hist_frames(spark, base)
    f = G.stride_sample(f, "video_id", "seq", None, DEFAULT.max_frames)
    kept = G.dedup_sequence(f, "video_id", "seq", "hist", DEDUP_THRESHOLD)
    return G.cap_frames(kept, "video_id", "seq", DEFAULT.max_frames).select("video_id", "vec_id")


def ocr_token_text(spark, base):
    """Document lines as frames and words as OCR tokens."""
    _prep(spark)
    d = spread(read_table(spark, base, "documents").select("doc_id", "text"))
    lines = d.select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("frame_no", "line"))
    toks = lines.select("video_id", "frame_no", F.posexplode(F.split("line", " ")).alias("token_no", "text"))
    toks = toks.withColumn("conf", F.conv(F.substring(F.md5(F.col("text")), 1, 2), 16, 10).cast("int")
                           * F.lit(100.0) / F.lit(255.0))
    return G.ocr_text(toks, "video_id", "frame_no", "token_no")


def video_text(spark, base):
    """Embeddings are frames (histogram, brightness and edges from its first bins), documents their recognised words."""
    f = _hist_frames(spark, base).withColumnRenamed("seq", "frame_no")
    f = f.withColumns({"brightness": F.abs(F.col("hist")[0].cast("double")) * 400, "edge_count": F.abs(F.col("hist")[1].cast("double")) * 8000})
    d = spread(read_table(spark, base, "documents").select("doc_id", "text"))
    words = d.select(F.col("doc_id").alias("vec_id"), F.posexplode(F.split("text", "[ \n]")).alias("token_no", "text"))
    words = words.withColumn("conf", F.conv(F.substring(F.md5(F.col("text")), 1, 2), 16, 10).cast("int") * F.lit(100.0) / F.lit(255.0))
    toks = words.join(f.select("vec_id", "video_id", "frame_no"), "vec_id").drop("vec_id")
    return G.video_text(f, toks, threshold=DEDUP_THRESHOLD)


def image_resize_plan(spark, base):
    """Sizes derived from part, plus edge sizes."""
    _prep(spark)
    p = read_table(spark, base, "part").select(
        F.col("p_partkey").alias("image_id"), ((F.col("p_partkey") * 37) % 1000 + 1).alias("width"),
        ((F.col("p_size") * 29 + F.col("p_partkey")) % 900 + 1).alias("height"))
    edge = spark.createDataFrame([(-1, 800, 600), (-2, 799, 600), (-3, 400, 900), (-4, 1980, 10),
                                  (-5, 1981, 10), (-6, 1, 1)], "image_id long, width long, height long")
    s = p.unionByName(edge)
    return s.select("image_id", "width", "height", G.image_resize_plan(F.col("width"), F.col("height")).alias("p")) \
            .select("image_id", "width", "height", "p.*")


def frame_resize_plan(spark, base):
    """Frame sizes derived from lineitem, plus edge sizes."""
    _prep(spark)
    li = read_table(spark, base, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame_id"),
        ((F.col("l_partkey") * 13) % 4000 + 1).alias("width"),
        ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 3000 + 1).alias("height"))
    edge = spark.createDataFrame([(-1, 1980, 1980), (-2, 1981, 10), (-3, 10, 1981), (-4, 3961, 2)],
                                 "frame_id long, width long, height long")
    s = li.unionByName(edge)
    return s.select("frame_id", "width", "height", G.frame_resize_plan(F.col("width"), F.col("height")).alias("p")) \
            .select("frame_id", "width", "height", "p.*")


def video_stats(spark, base):
    """Per customer (video) frames = its orders, fps from the key; fps 0 is rejected."""
    _prep(spark)
    o = read_table(spark, base, "orders").groupBy(F.col("o_custkey").alias("video_id")).agg(
        F.count(F.lit(1)).alias("frames"))
    o = o.withColumn("fps", (F.col("video_id") % 4) * 10)
    d = G.video_stats(F.col("frames"), F.col("fps"))
    return o.select("video_id", "fps", "frames", F.round(d, 6).alias("duration"), d.isNotNull().alias("ok"))
