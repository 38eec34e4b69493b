"""Frame-feature and OCR-token tables, re-aimed as DataFrame jobs.

Pixels, decoding and OCR stay outside Spark; their outputs arrive as rows:
``frames(video_id, frame_no, width, height, brightness, edge_count, hist)``
and ``ocr_tokens(video_id, frame_no, token_no, conf, text)``.

The only order-dependent step is G6 (drop a frame similar to the last *kept*
one). It runs as one pandas fold per video *after* G1 stride sampling, which
bounds a video to at most ``2 * max_frames - 1`` rows whatever its length, so
no group can grow with the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.config import DEFAULT, Settings
from corpusflow.functions.sequence import seq_within
from corpusflow.functions.text import py_strip
from corpusflow.functions.vectors import pearson
from corpusflow.session import materialize


def number_frames(df: DataFrame, video: str, order_cols: list[str], out: str = "frame_no") -> DataFrame:
    """Frame number inside each video by time order (skew-safe, see ``seq_within``)."""
    return seq_within(df, video, order_cols, out)


def stride_sample(frames: DataFrame, video: str = "video_id", frame_col: str = "frame_no",
                  total_col: str | None = None, max_frames: int = DEFAULT.max_frames) -> DataFrame:
    """G1: keep frames with ``frame_no mod max(1, total // max_frames) = 0``.

    ``total`` is the video's frame count (from its header when given, else
    counted - a partial aggregate, then joined back on the video key).
    """
    if total_col is None:
        totals = frames.groupBy(video).agg(F.count(F.lit(1)).alias("_total"))
        frames = frames.join(totals, video)
        total_col = "_total"
    interval = F.greatest(F.lit(1), F.floor(F.col(total_col) / F.lit(max_frames)))
    out = frames.filter(F.pmod(F.col(frame_col), interval) == 0)
    return out.drop("_total")


def relevant(brightness: Column, edge_count: Column, settings: Settings = DEFAULT) -> Column:
    """Bright enough and detailed enough."""
    return (brightness >= F.lit(settings.min_brightness)) & (edge_count >= F.lit(settings.min_edges))


def histogram(values: DataFrame, key_cols: list[str], value_col: str, bins: int = 256) -> DataFrame:
    """Counts per integer bin ``[0, bins)`` (values outside are dropped, like calcHist)."""
    b = F.floor(F.col(value_col)).cast("int")
    return (values.filter((F.col(value_col) >= 0) & (F.col(value_col) < bins))
            .groupBy(*key_cols, b.alias("bin")).agg(F.count(F.lit(1)).alias("n")))


def dense_histogram(hist_long: DataFrame, key_cols: list[str], bins: int = 256) -> DataFrame:
    """Long (bin, n) rows → one dense ``array<double>`` per key."""
    g = hist_long.groupBy(*key_cols).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_m"))
    return g.select(*key_cols, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)),
                                           lambda i: F.coalesce(F.col("_m")[i], F.lit(0)).cast("double")).alias("hist"))


def hist_similarity(h1: Column, h2: Column) -> Column:
    """Pearson correlation of two histograms; a constant histogram counts as 1.0."""
    return pearson(h1, h2)


def consecutive_pairs(frames: DataFrame, video: str, seq_col: str, cols: list[str]) -> DataFrame:
    """Each frame with the previous one of its video, via an equi-join on ``(video, seq - 1)``."""
    prev = frames.select(video, (F.col(seq_col) + 1).alias(seq_col), *[F.col(c).alias(f"prev_{c}") for c in cols])
    return frames.join(prev, [video, seq_col], "inner")


def _seq_sum(v: np.ndarray) -> float:
    """Plain left-to-right float64 sum (Python's ``sum`` compensates, numpy's pairs)."""
    return float(np.add.accumulate(v)[-1]) if len(v) else 0.0


def _dedup_fn(video: str, frame_col: str, hist_col: str, threshold: float):
    def corr(a: np.ndarray, b: np.ndarray) -> float:
        # same arithmetic as the expression path: index-order sums, float64
        n = len(a)
        ma = _seq_sum(a) / n
        mb = _seq_sum(b) / n
        da, db = a - ma, b - mb
        cov = _seq_sum(da * db)
        va = _seq_sum(da * da)
        vb = _seq_sum(db * db)
        den = np.sqrt(va * vb)
        return 1.0 if den == 0 else cov / den

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(frame_col, kind="stable")
        keep, last = [], None
        for h in pdf[hist_col]:
            h = np.asarray(h, dtype=np.float64)
            if last is None or not corr(h, last) > threshold:
                keep.append(True)
                last = h
            else:
                keep.append(False)
        return pdf.loc[keep, [video, frame_col]]

    return fold


def dedup_sequence(frames: DataFrame, video: str = "video_id", frame_col: str = "frame_no",
                   hist_col: str = "hist", threshold: float = DEFAULT.similarity_threshold) -> DataFrame:
    """Drop frames similar (correlation > threshold) to the last kept frame of their video.

    Expects stride-sampled input (G1), so each group is bounded. Returns the
    kept ``(video, frame)`` keys joined back to the input rows.
    """
    keys = frames.select(video, frame_col, hist_col)
    schema = f"{video} {frames.schema[video].dataType.simpleString()}, " \
             f"{frame_col} {frames.schema[frame_col].dataType.simpleString()}"
    kept = keys.groupBy(video).applyInPandas(_dedup_fn(video, frame_col, hist_col, threshold), schema)
    return frames.join(kept, [video, frame_col], "left_semi")


def cap_frames(frames: DataFrame, video: str = "video_id", frame_col: str = "frame_no",
               max_frames: int = DEFAULT.max_frames) -> DataFrame:
    """The first ``max_frames`` kept frames per video (pre-limited per task)."""
    w = Window.partitionBy(video).orderBy(frame_col)
    return frames.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_frames).drop("_r")


def ocr_text(tokens: DataFrame, video: str = "video_id", frame_col: str = "frame_no", token_col: str = "token_no",
             settings: Settings = DEFAULT) -> DataFrame:
    """Confident tokens (conf > 60) stripped, longer than one character,
    joined by spaces per frame; frames without such tokens dropped; frames
    joined by newlines per video."""
    from corpusflow.operators.prompt import ordered_join

    t = tokens.withColumn("_t", py_strip(F.col("text")))
    t = t.filter((F.col("conf") > F.lit(settings.min_text_confidence)) & (F.length("_t") > 1))
    per_frame = t.groupBy(video, frame_col).agg(ordered_join(F.col(token_col), F.col("_t"), " ").alias("frame_text"))
    return per_frame.groupBy(video).agg(F.count(F.lit(1)).alias("n_frames"),
                                        ordered_join(F.col(frame_col), F.col("frame_text"), "\n").alias("text"))


def video_text(frames: DataFrame, tokens: DataFrame, video: str = "video_id", frame_col: str = "frame_no", total_col: str | None = None,
               threshold: float | None = None, max_frames: int | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """The text of every video, from frame features to joined tokens.

    ``frames`` has ``brightness, edge_count, hist`` per numbered frame, ``tokens``
    the recognised words of all frames. Wide columns are read late: the sampled and
    relevant frames are chosen on narrow columns, histograms are read for those
    only, and tokens for the kept frames only. Both are semi-joins on (video, frame)
    with the chosen keys, at most ``2 * max_frames`` a video, which are broadcast as
    long as they fit ``broadcast_max_bytes`` and shuffled beyond. Videos without a
    kept frame with text have no row; null features make a frame irrelevant.
    """
    most = max_frames or settings.max_frames
    keys = frames.select(video, frame_col, "brightness", "edge_count", *([total_col] if total_col else []))
    keys = stride_sample(keys, video, frame_col, total_col, most).filter(relevant(F.col("brightness"), F.col("edge_count"), settings))
    chosen = _checked(materialize(keys.select(video, frame_col)), settings)
    hists = frames.select(video, frame_col, "hist").join(chosen, [video, frame_col], "left_semi")
    kept = dedup_sequence(hists, video, frame_col, "hist", settings.similarity_threshold if threshold is None else threshold)
    kept = cap_frames(kept.select(video, frame_col), video, frame_col, most)
    own = tokens.join(_checked(materialize(kept), settings), [video, frame_col], "left_semi")
    return ocr_text(own, video, frame_col, "token_no", settings)


def _checked(keys: DataFrame, settings: Settings) -> DataFrame:
    """``keys`` marked for a broadcast where their number allows it."""
    return F.broadcast(keys) if keys.count() * 64 <= settings.broadcast_max_bytes else keys


def image_resize_plan(width: Column, height: Column, settings: Settings = DEFAULT) -> Column:
    """Upscale to at least min size by the larger ratio, int truncation, never shrink."""
    w, h = width.cast("double"), height.cast("double")
    wr = F.when(w < settings.min_width, F.lit(float(settings.min_width)) / w).otherwise(F.lit(1.0))
    hr = F.when(h < settings.min_height, F.lit(float(settings.min_height)) / h).otherwise(F.lit(1.0))
    scale = F.greatest(wr, hr)
    small = (w < settings.min_width) | (h < settings.min_height)
    up = small & (scale > 1)
    return F.struct(F.when(up, F.floor(w * scale)).otherwise(width).cast("long").alias("new_width"),
                    F.when(up, F.floor(h * scale)).otherwise(height).cast("long").alias("new_height"),
                    up.alias("resized"))


def frame_resize_plan(width: Column, height: Column, settings: Settings = DEFAULT) -> Column:
    """Frames over the maximum side are scaled to it (sizes round half to even)."""
    w, h = width.cast("double"), height.cast("double")
    big = (width > settings.max_dimension) | (height > settings.max_dimension)
    scale = F.lit(float(settings.max_dimension)) / F.greatest(w, h)
    return F.struct(F.when(big, F.bround(w * scale, 0)).otherwise(width).cast("long").alias("new_width"),
                    F.when(big, F.bround(h * scale, 0)).otherwise(height).cast("long").alias("new_height"),
                    big.alias("resized"))


def video_stats(frames: Column, fps: Column) -> Column:
    """duration = frames / fps; fps 0 gives null (the row goes to rejects)."""
    return F.try_divide(frames.cast("double"), fps.cast("double"))


def strip_image_metadata(images: DataFrame, keep: tuple[str, ...] = ("origin", "height", "width", "nChannels",
                                                                     "mode", "data")) -> DataFrame:
    """Keep only pixel data and size; every other (metadata) column is dropped."""
    cols = [c for c in images.columns if c in keep]
    return images.select(*cols)
