"""Near-duplicate documents: banded MinHash candidates, odd-sketch estimates, exact confirmation.

A document is the set of its word shingles. ``SAMPLES`` MinHash values give the
bands; the same values, folded into a parity bitmap, give an odd sketch, whose
XOR population count with another sketch estimates a high similarity closely.
Candidates that the sketch does not rule out are confirmed on the full sets.

Equal sets are one class from the start, joined by fingerprint. In a band
bucket every member is first compared with the smallest id only; components
then shrink the bucket, and members in different components are compared in
blocks, whose number grows with the bucket, so no bucket is one task's work.
A block first reports a spanning forest of its likely links, and only where such
a link fails all the others. No pair that a bucket holds stays unexamined.

A pair at similarity 0.8 shares no band with probability 3e-6, and the sketch
threshold loses it with about the same; more similar pairs are safer still. Set
sizes that rule a similarity out are left out as well. Defined results: null or blank texts
have no shingles and are linked with nothing; a null id takes no part and
forms no component (``component_id`` null, kept); rows repeating an id share
its class; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import load, stored
from corpusflow.llm.components import components
from corpusflow.llm.shingles import group_bounds, hash_words, hashed_docs, mix, shingle_hashes, whole_groups, words

BANDS, ROWS = 32, 5
#: MinHash values; the first ``BANDS * ROWS`` make the bands, all of them the sketch.
SAMPLES = 640
BITS = 2048
#: Estimates below this are taken for misses; 4.6 standard deviations below 0.8.
LIKELY = 0.72
#: Members of a bucket compared in one block with those of another.
BLOCK = 256
_A = (mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def max_xor(similarity: float, samples: int = SAMPLES, bits: int = BITS) -> int:
    """Largest XOR population count whose estimate 1 + bits/(4 samples) ln(1 - 2 count/bits) is ``similarity`` or more."""
    return math.floor(bits * (1 - math.exp(-4 * samples * (1 - similarity) / bits)) / 2)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """``SAMPLES`` 32-bit MinHash values of a non-empty set, in bounded memory."""
    low = np.full(SAMPLES, 0xFFFFFFFF, dtype=np.uint32)
    folded = (shingles >> np.uint64(32)).astype(np.uint32)
    part = np.empty((SAMPLES, 128), dtype=np.uint32)  # stays in the cache
    for at in range(0, len(folded), 128):
        x = folded[None, at:at + 128]
        np.multiply(x, _A[:, None], out=part[:, :x.shape[1]])
        np.minimum(low, part[:, :x.shape[1]].min(axis=1), out=low)
    return low.astype(np.uint64)


def sketch(low: np.ndarray) -> np.ndarray:
    """Odd sketch: every (sample, value) flips one of ``BITS`` bits; as signed 64-bit words."""
    places = mix(low + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(BITS)
    odd = np.bincount(places.astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def bands(low: np.ndarray) -> np.ndarray:
    rows = low[:BANDS * ROWS].reshape(BANDS, ROWS)
    key = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for k in range(ROWS):
        key = mix(key + rows[:, k])
    return key.view(np.int64)


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """``id, n_shingles, fp`` (fingerprint of the set, null if empty), ``sketch`` and ``bands``."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at:at + 256]
                rows = []
                for h in hashed_docs(part["text"]):
                    s = np.unique(shingle_hashes(h, size))
                    if not len(s):
                        rows.append((0, None, None, None))
                        continue
                    low = minhash(s)
                    rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sketch(low), bands(low)))
                out = pd.DataFrame(rows, columns=["n_shingles", "fp", "sketch", "bands"])
                out.insert(0, "id", part["id"].to_numpy())
                yield out

    return docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInPandas(
        run, "id string, n_shingles long, fp binary, sketch array<long>, bands array<long>"
    ).withColumn("id", F.col("id").cast("long"))


def _xor_count(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets have 100 * intersection >= ``percent`` * union.

    Where an id of ``docs`` has several texts, one pair of them is enough. Both
    joins use the same exchange of the texts.
    """
    left = pairs.join(docs.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(docs.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        @lru_cache(maxsize=64)
        def shingles(text: str) -> np.ndarray:
            return np.unique(shingle_hashes(hash_words(words(text)), size))

        for pdf in frames:
            fine = []
            for x, y in zip(pdf["text_a"], pdf["text_b"]):
                s, t = shingles(x), shingles(y)
                n = len(np.intersect1d(s, t, assume_unique=True))
                fine.append(100 * n >= percent * (len(s) + len(t) - n))
            yield pdf.loc[fine, ["a", "b"]]

    return both.mapInPandas(run, "a long, b long")


def _block_pairs(limit: int, forest: bool, percent: int):
    """Likely pairs of a block whose members have different labels; a spanning forest of them, or all."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = ["key", "i", "j"]
        for pdf in whole_groups(frames, keys):
            bounds = group_bounds(pdf, keys)
            ids, labels, sides, others, sizes, places = (pdf[c].to_numpy() for c in ("id", "label", "side", "other", "n_shingles", "band"))
            every = np.array(pdf["bands"].tolist(), dtype=np.int64)
            sketches = np.array(pdf["sketch"].tolist(), dtype=np.int64).view(np.uint64)
            found = []
            for s, e in zip(bounds[:-1], bounds[1:]):
                left, right = s + np.flatnonzero(sides[s:e] == 0), s + np.flatnonzero(sides[s:e] == 1)
                if not len(left) or not len(right):
                    continue
                far = np.bitwise_count(sketches[left][:, None] ^ sketches[right][None]).sum(axis=2, dtype=np.int32)
                near = (far <= limit) & (labels[left][:, None] != labels[right][None])
                n, m = sizes[left][:, None], sizes[right][None]
                near &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
                # two members outside the largest component meet twice
                near &= ~others[right][None] | (ids[left][:, None] < ids[right][None])
                i, j = np.nonzero(near)
                # a pair that shares several buckets is examined in the first of them
                first = (every[left[i]] == every[right[j]]).argmax(axis=1) == places[s]
                i, j = i[first], j[first]
                if forest:
                    root: dict[int, int] = {}

                    def top(x: int) -> int:
                        while x in root:
                            x = root[x]
                        return x

                    for k in np.argsort(far[i, j], kind="stable"):
                        x, y = top(labels[left[i[k]]]), top(labels[right[j[k]]])
                        if x != y:
                            root[max(x, y)] = min(x, y)
                            found.append((ids[left[i[k]]], ids[right[j[k]]]))
                else:
                    found += zip(ids[left[i]], ids[right[j]])
            if found:
                out = pd.DataFrame(found, columns=["a", "b"])
                yield pd.DataFrame({"a": out.min(axis=1), "b": out.max(axis=1)})

    return run


def _across(members: DataFrame, labels: DataFrame, sketches: DataFrame, limit: int, forest: bool, percent: int) -> DataFrame:
    """Likely pairs ``a, b`` in the buckets whose members lie in several components.

    Only the members outside a bucket's largest component (``other``) look for
    partners among all its members, in blocks of ``BLOCK`` by ``BLOCK``.
    """
    m = members.join(labels, "id", "left").select("key", "band", "id", F.coalesce("component", "id").alias("label"))
    m = stored(m, "labelled")
    open_ = m.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n")).where("main.n < n").select(
        "key", F.col("main.label").alias("main"), F.ceil(F.col("n") / BLOCK).alias("parts"),
        F.ceil((F.col("n") - F.col("main.n")) / BLOCK).alias("other_parts"))
    rows = m.join(open_, "key").join(sketches, "id").withColumn("other", F.col("label") != F.col("main"))
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    blocks = F.transform(upto("other_parts"), lambda i: F.struct(i.alias("i"), part("parts").alias("j"), F.lit(1).alias("side")))
    asks = F.transform(upto("parts"), lambda j: F.struct(part("other_parts").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    rows = rows.withColumn("at", F.explode(F.when(F.col("other"), F.concat(blocks, asks)).otherwise(blocks))).select(
        "key", "at.*", "band", "id", "label", "other", "n_shingles", "sketch", "bands")
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    return dealt.mapInPandas(_block_pairs(limit, forest, percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = 4, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs`` (integer ids)."""
    sig = stored(signatures(docs, size), "signatures")
    classes = sig.where("fp is not null and id is not null").groupBy("fp").agg(F.min("id").alias("first"))
    classes = stored(classes, "classes")
    # one row per class: an id with several texts may stand for several classes
    own = sig.select("id", "n_shingles", "sketch", "bands", F.col("fp").alias("f")).join(
        classes, (F.col("f") == F.col("fp")) & (F.col("id") == F.col("first"))).select("f", "id", "n_shingles", "sketch", "bands")
    own = stored(own.dropDuplicates(["f"]).drop("f"), "class-signatures")
    # and links all of them
    again = stored(sig.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(
        F.col("id").alias("own")), "repeated-ids")
    repeats = sig.join(again, F.col("id") == F.col("own")).select("id", "fp").join(classes, "fp").where("id <> first").select(
        F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    sketches = own.select("id", "n_shingles", "sketch", "bands")
    members = own.select("id", F.posexplode("bands").alias("band", "key"))
    shared = members.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("a")).where("n > 1")
    members = stored(members.join(shared.select("key", "a"), "key"), "members")
    limit = max_xor(LIKELY)
    stars = members.where("id <> a").select("a", F.col("id").alias("b")).distinct()
    stars = stars.join(sketches.select(F.col("id").alias("a"), F.col("sketch").alias("s"), F.col("n_shingles").alias("n")), "a").join(
        sketches.select(F.col("id").alias("b"), F.col("sketch").alias("t"), F.col("n_shingles").alias("m")), "b")
    stars = stars.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).where(_xor_count("s", "t") <= limit).select("a", "b")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null")
    stars = stored(stars, "stars")
    links = stored(confirm(stars, texts, size, percent).union(repeats).distinct(), "links")
    tested, labels = stars, stored(components(links), "labels")
    members = members.select("key", "band", "id")
    for forest in (True, False):
        found = stored(_across(members, labels, sketches, limit, forest, percent), "likely")
        more = stored(found.join(tested, ["a", "b"], "left_anti"), "untested")
        if forest:
            # a component without a likely link to another one in any bucket has none in the next round either
            ends = found.select(F.col("a").alias("id")).union(found.select("b")).distinct()
            ends = ends.join(labels, "id", "left").select(F.coalesce("component", "id").alias("end")).distinct()
            label = F.coalesce("component", "id")
            members = members.join(labels, "id", "left").withColumn("label", label).join(
                ends, F.col("label") == F.col("end"), "left_semi").select("key", "band", "id")
            members = stored(members, "members")
        if more.isEmpty():
            continue
        linked = stored(confirm(more, texts, size, percent).distinct(), "links")
        tested = tested.union(more)
        if not linked.isEmpty():
            links = links.union(linked)
            labels = stored(components(links), "labels")
    named = classes.join(labels, F.col("first") == F.col("id"), "left").select(
        F.col("fp").alias("f"), F.coalesce("component", "first").alias("component"))
    out = sig.select("id", "n_shingles", "fp").join(named, F.col("fp") == F.col("f"), "left")
    if not again.isEmpty():  # its rows without words are in an id's component too
        of_id = out.join(again, F.col("id") == F.col("own")).groupBy("own").agg(F.min("component").alias("of_id"))
        out = out.join(of_id, F.col("id") == F.col("own"), "left").withColumn("component", F.coalesce("of_id", "component"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def distinct_documents(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are kept, one per group, with their own columns.

    Of rows repeating an id that is kept one stays, whichever Spark meets first;
    rows without an id all stay.
    """
    classes = stored(near_duplicates(docs, size, percent), "near-duplicates")
    gone = classes.where("not kept").select(F.col("doc_id").cast("long").alias("_gone")).distinct()
    out = docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone"), "left_anti")
    again = classes.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(
        F.col("doc_id").alias("_again"))
    if again.isEmpty():
        return out
    repeats = F.col("doc_id").cast("long") == F.col("_again")
    return out.join(again, repeats, "left_anti").unionByName(out.join(again, repeats, "left_semi").dropDuplicates(["doc_id"]))


def op3_odd_sketch(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


#: All pairs of documents that share a shingle, confirmed, and their components.
ORACLE = """
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from w),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
e as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 80 * (x.n + y.n - i)),
u as (select a, b from e union all select b, a from e),
r as (select doc_id as id, doc_id as c from documents union select u.b, r.c from r join u on u.a = r.id where r.c < u.b),
m as (select id, min(c) as c from r group by id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.c as component_id, d.doc_id = m.c as kept
from documents d left join n using (doc_id) join m on m.id = d.doc_id
"""
