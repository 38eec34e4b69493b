"""Trie of conversation prefixes, with subtree totals rolled up in depth bands.

A node is a distinct sequence of first turns; its key is two 64-bit sums over
``(place, role and text)`` hashes, so keys are running sums and no conversation
has to pass through one task: turns are range-partitioned by (conversation,
turn), summed per task, and the sums carried over by a table of two rows per task.

Totals of subtrees: the depths are cut into bands of ``BAND`` levels. Every node
adds its values to itself and its ancestors in its band only, which it finds as
the path of one of its members. The band roots then form a trie of ``1/BAND`` of
the depth, whose totals are found in the same way, and every band root's total
is added to its ancestors in the band above. A node is thus copied at most
``2 * BAND`` times, and a trie of depth D takes log(D)/log(BAND) rounds of two joins.

Defined results: rows without conv_id are left out; null role or text is empty;
turns come in order of ``turn``, null first, and turns with equal numbers in
order of a hash of role and text (md5, halves as signed integers); other columns are ignored; an empty table has
no node. ``c - c % 100`` takes the remainder's sign from c.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions.partitions import parallelism
from corpusflow.llm.common import load, stored
from corpusflow.llm.shingles import group_bounds, mix

BAND = 16
#: Ids of one row of an ordered id list.
CHUNK = 4096
_SEEDS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))


def _running(name: str):
    """Numbers rows per ``conv`` within the task and sums ``(place, x, y)`` hashes, in ``name`` order."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        last, n = None, 0
        sums = [np.uint64(0), np.uint64(0)]
        for pdf in frames:
            if not len(pdf):
                continue
            conv = pdf["conv"].to_numpy()
            bounds = group_bounds(pdf, ["conv"])
            size = np.diff(bounds)
            goes_on = last is not None and conv[0] == last
            if not goes_on:
                n, sums = 0, [np.uint64(0), np.uint64(0)]
            begin = np.zeros(len(size), dtype=np.int64)
            begin[0] = n
            place = np.arange(len(pdf)) - np.repeat(bounds[:-1] - begin, size)
            out = pdf.assign(task=task, place=place)
            if name == "pos":
                at = pdf["pos"].to_numpy().astype(np.uint64)
                for k, (c, seed) in enumerate(zip(("hx", "hy"), _SEEDS)):
                    h = mix(mix(pdf["x"].to_numpy().view(np.uint64) + seed * (at + np.uint64(1))) ^ pdf["y"].to_numpy().view(np.uint64))
                    total = np.cumsum(h)
                    before = np.concatenate([[np.uint64(0)], total])[bounds[:-1]]
                    carry = np.zeros(len(size), dtype=np.uint64)
                    carry[0] = sums[k]
                    total = total - np.repeat(before - carry, size)
                    out[c] = total.view(np.int64)
                    sums[k] = total[-1]
            last, n = conv[-1], int(place[-1]) + 1
            yield out

    return run


def _carried(spark, part: DataFrame, sums: list[str]) -> DataFrame:
    """``task, conv`` with what the tasks before hold of the same conversation: rows ``n0`` and wrapped ``sums``.

    Only a task's first conversation can have rows before it: the table has at most one row a task.
    """
    ends = part.groupBy("task", "conv").agg(F.max(F.struct("place", *sums)).alias("end"))
    both = Window.partitionBy("conv")
    ends = ends.select("task", "conv", (F.col("end.place") + 1).alias("n"), *(F.col(f"end.{c}").alias(c) for c in sums)).withColumn(
        "tasks", F.count("*").over(both)).where("tasks > 1").drop("tasks")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, {}
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                if r.conv != last:
                    last, state = r.conv, dict.fromkeys(["n", *sums], 0)
                rows.append((r.task, r.conv, *(state[c] for c in ("n", *sums))))
                for c in ("n", *sums):
                    state[c] = (state[c] + int(getattr(r, c)) + 2**63) % 2**64 - 2**63
            yield pd.DataFrame(rows, columns=["task0", "conv0", "n0", *(f"{c}0" for c in sums)])

    schema = "task0 int, conv0 long, n0 long" + "".join(f", {c}0 long" for c in sums)
    return ends.repartition("conv").sortWithinPartitions("conv", "task").mapInPandas(run, schema)


def _with_carry(part: DataFrame, sums: list[str]) -> DataFrame:
    before = _carried(part.sparkSession, part, sums)
    return part.join(F.broadcast(before), (F.col("task") == F.col("task0")) & (F.col("conv") == F.col("conv0")), "left")


def rebuilt_paths(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's rebuilt conversations: their ids, and one row per conversation and depth above 0.

    A row has ``conv, depth``, the node's key ``hx, hy``, its parent's ``px, py``
    and ``chars``, the code points of the last text.
    """
    spark = conversations.sparkSession
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    said = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    half = lambda a: F.conv(F.substring(said, a, 16), 16, -10).cast("long")  # noqa: E731 - as signed 64 bits
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", half(1).alias("x"), half(17).alias("y"), F.length(text).cast("long").alias("chars"))
    tasks = parallelism(spark)
    dealt = turns.repartitionByRange(tasks, "conv", "turn", "x", "y").sortWithinPartitions("conv", "turn", "x", "y").drop("turn")
    part = stored(dealt.mapInPandas(_running("turn"), "conv long, x long, y long, chars long, task int, place long"), "turns")
    own = _with_carry(part, []).select(
        "conv", "x", "y", "chars", (F.col("place") + F.coalesce("n0", F.lit(0))).alias("i"))
    crc = F.crc32(F.col("conv").cast("string").cast("binary"))
    sizes = part.groupBy("task", "conv").agg(F.max("place").alias("p")).groupBy("conv").agg((F.sum("p") + F.count("*")).alias("n"))
    convs = sizes.select("conv", "n", (crc % 6).alias("h"), (F.col("conv") - F.col("conv") % 100).alias("base"))
    has = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = stored(convs.join(has, "base", "left").select(
        "conv", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("k")), "conversations")
    # at most five rows a base, for at most a hundred conversations
    heads = own.where("i < 5").withColumnRenamed("conv", "from").join(
        convs.where("k > 0"), (F.col("from") == F.col("base")) & (F.col("i") < F.col("k"))).select(
        "conv", F.col("i").alias("pos"), "x", "y", "chars")
    tails = own.join(convs.select(F.col("conv").alias("c"), "h", "k"), F.col("conv") == F.col("c")).where("i >= h").select(
        "conv", (F.col("i") - F.col("h") + F.col("k")).alias("pos"), "x", "y", "chars")
    rows = heads.union(tails).repartitionByRange(tasks, "conv", "pos").sortWithinPartitions("conv", "pos")
    part = stored(rows.mapInPandas(
        _running("pos"), "conv long, pos long, x long, y long, chars long, task int, place long, hx long, hy long"), "paths")
    zero = F.lit(0).cast("long")
    keys = _with_carry(part, ["hx", "hy"]).select(
        "conv", (F.col("pos") + 1).alias("depth"), "hx", "hy", F.coalesce("hx0", zero).alias("hx0"), F.coalesce("hy0", zero).alias("hy0"),
        "x", "y", "chars")

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # the parent's key is the own one without the last term
        for pdf in frames:
            at, x, y = (pdf[c].to_numpy().view(np.uint64) for c in ("depth", "x", "y"))
            for own_key, carry, parent, seed in zip(("hx", "hy"), ("hx0", "hy0"), ("px", "py"), _SEEDS):
                full = pdf[own_key].to_numpy().view(np.uint64) + pdf[carry].to_numpy().view(np.uint64)
                pdf[own_key] = full.view(np.int64)
                pdf[parent] = (full - mix(mix(x + seed * at) ^ y)).view(np.int64)
            yield pdf[["conv", "depth", "hx", "hy", "px", "py", "chars"]]

    paths = keys.mapInPandas(run, "conv long, depth long, hx long, hy long, px long, py long, chars long")
    return convs.select("conv"), stored(paths, "nodes-of-paths")


def rollup(paths: DataFrame, nodes: DataFrame, values: list[str], deepest: int, band: int = BAND) -> DataFrame:
    """Sums of ``values`` over every node's subtree, as ``hx, hy`` and the values.

    ``paths`` has ``conv, depth, hx, hy`` for every depth from 0 on of the
    conversations in ``nodes``, which has one row per node: ``hx, hy, depth``,
    a member ``conv`` and the values.
    """
    key, at = ["hx", "hy"], lambda c: F.floor(F.col(c) / band)
    p = paths.select(F.col("conv").alias("pc"), F.col("depth").alias("pd"), *key, at("depth").alias("pb"))
    n = nodes.select("conv", F.col("depth").alias("d"), at("depth").alias("b"), *values)
    sums = [F.sum(v).alias(v) for v in values]
    inside = n.join(p, (F.col("conv") == F.col("pc")) & (F.col("b") == F.col("pb")) & (F.col("pd") <= F.col("d"))).groupBy(*key).agg(*sums)
    if deepest < band:
        return inside
    inside = stored(inside, "band-totals")
    up = lambda df: df.where(F.col("depth") % band == 0).withColumn("depth", at("depth"))
    roots = up(nodes.select("conv", "depth", *key)).join(inside, key)
    totals = stored(rollup(up(paths), roots, values, deepest // band, band), "root-totals")
    lifted = roots.drop(*values).join(totals, key).where("depth > 0").select("conv", (F.col("depth") - 1).alias("b"), *values)
    above = lifted.join(p, (F.col("conv") == F.col("pc")) & (F.col("b") == F.col("pb"))).select(*key, *values)
    return inside.select(*key, *values).unionByName(above).groupBy(*key).agg(*sums)


def ordered_hashes(members: DataFrame, key: list[str], value: str) -> DataFrame:
    """``key`` and ``ends``: SHA-256 of each key's values in ascending order, comma-joined.

    Values are first joined to rows of up to ``CHUNK`` in range partitions; the
    hash of a key, sequential by nature, then streams over those rows.
    """
    fields = ", ".join(f"{k} long" for k in key)

    def chunks(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            bounds, v, ks, rows = group_bounds(pdf, key), pdf[value].to_numpy(), pdf[key].to_numpy(), []
            for s, e in zip(bounds[:-1], bounds[1:]):
                for a in range(s, e, CHUNK):
                    rows.append((*ks[s], v[a], ",".join(map(str, v[a:min(a + CHUNK, e)].tolist()))))
            yield pd.DataFrame(rows, columns=[*key, "first", "part"])

    def hashes(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, h = None, None
        for pdf in frames:
            rows = []
            for *k, part in pdf[[*key, "part"]].itertuples(index=False, name=None):
                if k != now:
                    if now is not None:
                        rows.append((*now, h.hexdigest()))
                    now, h = k, hashlib.sha256(part.encode())
                else:
                    h.update(b"," + part.encode())
            yield pd.DataFrame(rows, columns=[*key, "ends"])
        if now is not None:
            yield pd.DataFrame([(*now, h.hexdigest())], columns=[*key, "ends"])

    dealt = members.select(*key, value).repartitionByRange(parallelism(members.sparkSession), *key, value).sortWithinPartitions(*key, value)
    parts = dealt.mapInPandas(chunks, f"{fields}, first long, part string")
    return parts.repartition(*key).sortWithinPartitions(*key, "first").mapInPandas(hashes, f"{fields}, ends string")


def prefix_trie(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """Every node of the trie of :func:`rebuilt_paths`, with the contract's columns."""
    key = ["hx", "hy"]
    zero = F.lit(0).cast("long")
    root = convs.select("conv", zero.alias("depth"), zero.alias("hx"), zero.alias("hy"),
                        F.lit(None).cast("long").alias("px"), F.lit(None).cast("long").alias("py"), zero.alias("chars"))
    every = paths.unionByName(root)
    nodes = every.groupBy(*key).agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), *(
        F.max(c).alias(c) for c in ("depth", "px", "py", "chars")))
    nodes = stored(nodes, "trie-nodes")
    children = nodes.where("px is not null").groupBy(F.col("px").alias("hx"), F.col("py").alias("hy")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", zero)).withColumn(
        "n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars")), "trie-counts")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = rollup(every.select("conv", "depth", *key), nodes, ["n_leaves", "saved_tokens"], int(deepest))
    ends = every.groupBy("conv").agg(F.max(F.struct("depth", *key)).alias("end")).select("conv", "end.hx", "end.hy")
    hashes = ordered_hashes(ends, key, "conv")
    parents = nodes.select(F.col("hx").alias("px"), F.col("hy").alias("py"), F.col("conv").alias("parent_conv_id"))
    out = nodes.select(*key, F.col("conv").alias("conv_id"), "depth", "px", "py", "n_convs", "n_children")
    return out.join(sums, key).join(hashes, key, "left").join(parents, ["px", "py"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(*rebuilt_paths(load(spark, sf_dir, "conversations")))


#: crc32 bit by bit; nodes are list prefixes; subtrees are walked along the smallest member's path.
ORACLE = """
with i as (select conv_id as c, turn, coalesce(role, '') as r, coalesce(text, '') as t, md5(strlen(r) || ':' || r || t) as x
      from conversations where conv_id is not null),
o as (select c, list({'r': r, 't': t} order by turn nulls first, x < '8', x) as t from i group by all),
h as (select c, t, xor(list_reduce([4294967295::bigint] || list_transform(string_split(c::varchar, ''), lambda s: ascii(s)::bigint),
      lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 6 as h from o),
w as (select h.c, coalesce(list_slice(b.t, 1, h.h), []) || coalesce(list_slice(h.t, h.h + 1, len(h.t)), []) as t
      from h left join o b on b.c = h.c - h.c % 100),
p as (select c, d, t[1:d] as k, len(t) = d as e, case when d > 0 then length(t[d].t) else 0 end as n
      from (select c, t, unnest(range(0, len(t) + 1)) as d from w)),
m as (select k, d, min(c) as c, count(*) as q, any_value(n) as n, count(*) filter (e) as z,
      sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (e), '')) as ends from p group by all),
f as (select m.*, (select count(*) from m x where x.d = m.d + 1 and x.k[1:m.d] = m.k) as kids,
      (select min(x.c) from m x where x.d = m.d - 1 and x.k = m.k[1:m.d - 1]) as up from m),
s as (select a.k, a.d, sum((b.kids = 0)::int) as leaves, sum((b.q - 1) * b.n) as saved
      from f a join p on p.k = a.k and p.d = a.d join f b on b.c = p.c and b.d >= a.d group by all)
select f.c as conv_id, f.d::bigint as depth, f.up as parent_conv_id, f.q as n_convs, f.kids::bigint as n_children, s.leaves::bigint as n_leaves,
       s.saved::bigint as saved_tokens, f.ends as ends_sha256
from f join s on s.k = f.k and s.d = f.d
"""
