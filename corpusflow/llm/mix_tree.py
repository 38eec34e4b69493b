"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

DataFrame expressions only. Every source gets a target number of words; its
documents stand in a seeded permuted order on an axis of words, once per pass,
and the target is the axis' length. The axis is cut into blocks. A binary tree
over the output shards splits the sources' exact block counts: at each node
the left half draws its blocks without replacement from the node's blocks, so
the sources' shares in every shard are multivariate hypergeometric and the
counts add up exactly. Each shard then owns a range of permuted block slots of
every source, disjoint from the other shards', and is shuffled locally. ``mixed``
keeps a document's copy whole: it goes to the shard that its first taken word is
drawn for, and the rest of its words with it.

Rows are dealt over (source, hash bucket), never over the source alone, so a
source with a third of all rows is spread over ``BUCKETS`` tasks. What is
gathered per source is one row for each bucket; the tree is a row per shard.

Defined results: a null or blank text has size 0 and is taken 0 times; a null
source is a source of its own, ordered last; a null id hashes as the empty
text; repeated rows are separate documents; other columns are ignored by
``plan`` (and kept by ``mixed``); an empty table gives an empty table. Reruns
give equal results: order, draws and shuffles depend on the seed and ids only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.llm.common import SPACE, WORD, load, stored

WEIGHTS = (3, 1, 2)
#: Hash buckets of a source: the unit of dealing rows to tasks.
BUCKETS = 4096
#: Primes for permuting block numbers; a count of blocks below 2**31 lacks one of them as divisor.
PRIMES = (1_000_003, 999_983, 998_244_353, 7_368_787)


def sized(docs: DataFrame, seed: str = "mix", text: str = "text") -> DataFrame:
    """``docs`` with ``size`` (words), ``_key`` (permuted order) and ``_bucket`` added."""
    key = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 16)
    return (docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))
            .withColumn("_key", key)
            .withColumn("_bucket", F.conv(F.substring("_key", 1, 3), 16, 10).cast("int")))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size`` to targets: weighted shares of 150 % of all words, two passes at most.

    Sources are filled in the order of size over weight. In that order the ones
    that reach their cap are a prefix, so cutting at the cap and resharing the
    excess until no target is above needs two running sums. The comparisons are
    exact in integers. One row per source.
    """
    if any(6 % w for w in weights):
        raise ValueError("weights must divide 6")
    names = Window.orderBy(F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy(F.lit(0))
    w = totals.withColumn("_no", F.row_number().over(names) - 1)
    w = w.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), F.pmod("_no", F.lit(len(weights))).cast("int") + 1).cast("long"))
    order = Window.orderBy(F.col("source_size") * (F.lit(6) / F.col("_w")).cast("long"), "_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything)
    left_w = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    left_t = 3 * total - 4 * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    w = w.withColumn("_full", 4 * F.col("source_size") * left_w < left_t * F.col("_w"))
    free = 3 * total - 4 * F.coalesce(F.sum(F.when(F.col("_full"), F.col("source_size"))).over(everything), F.lit(0))
    open_w = F.sum(F.when(~F.col("_full"), F.col("_w")).otherwise(0)).over(everything)
    share = (F.col("_w") * free).cast("double") / (2 * open_w).cast("double")
    return w.withColumn("target", F.when(F.col("_full"), (2 * F.col("source_size")).cast("double")).otherwise(
        F.least(share, (2 * F.col("source_size")).cast("double")))).select("source", "source_size", "_no", "target")


def _uniform(*parts) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(1 << 53))


def _draw(counts: Column, left: Column, seed: str, node: Column) -> Column:
    """Blocks of every source that go left: ``left`` draws without replacement from all of ``counts``.

    The blocks are passed in the sources' order and each goes left with the
    chance (places left) / (blocks left), which is sampling without replacement.
    """
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    start = F.struct(total.alias("n"), left.cast("long").alias("k"), F.array().cast("array<bigint>").alias("out"))

    def source(state, count):
        begin = F.struct(state["n"].alias("n"), state["k"].alias("k"))
        picks = F.when(count > 0, F.sequence(F.lit(1).cast("long"), count)).otherwise(F.array().cast("array<bigint>"))
        end = F.aggregate(picks, begin, lambda s, i: F.struct(
            (s["n"] - 1).alias("n"),
            (s["k"] - (_uniform(F.lit(seed), node, s["n"]) * s["n"] < s["k"]).cast("long")).alias("k")))
        return F.struct(end["n"].alias("n"), end["k"].alias("k"), F.concat(state["out"], F.array(state["k"] - end["k"])).alias("out"))

    return F.aggregate(counts, start, source)["out"]


def split_tree(quotas: DataFrame, shards: int, seed: str) -> DataFrame:
    """``_no, blocks`` (a row per source) to ``_no, ends``: each shard's last block slot + 1, in shard order."""
    node = quotas.agg(F.sort_array(F.collect_list(F.struct("_no", "blocks"))).alias("all")).select(
        F.transform("all", lambda x: x["_no"]).alias("nos"), F.transform("all", lambda x: x["blocks"]).alias("counts"),
        F.lit(0).alias("lo"), F.lit(shards).alias("hi"))
    width = shards
    while width > 1:
        width = -(-width // 2)
        half = F.floor((F.col("hi") - F.col("lo")) / 2).cast("int")
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
        places = F.floor(total * half / (F.col("hi") - F.col("lo")))
        node = node.withColumn("left", F.when(half > 0, _draw(F.col("counts"), places, seed, F.concat_ws(":", "lo", "hi"))))
        rest = F.zip_with("counts", "left", lambda a, b: a - b)
        node = node.select("nos", F.explode(F.when(half > 0, F.array(
            F.struct(F.col("left").alias("counts"), F.col("lo"), (F.col("lo") + half).alias("hi")),
            F.struct(rest.alias("counts"), (F.col("lo") + half).alias("lo"), F.col("hi")))).otherwise(F.array(
                F.struct("counts", "lo", "hi")))).alias("c")).select("nos", "c.*")
    slots = node.select(F.col("lo").alias("shard"), F.explode(F.arrays_zip("nos", "counts")).alias("q")).select(
        "shard", F.col("q.nos").alias("_no"), F.col("q.counts").alias("n"))
    ends = slots.withColumn("end", F.sum("n").over(Window.partitionBy("_no").orderBy("shard")))
    return ends.groupBy("_no").agg(F.sort_array(F.collect_list(F.struct("shard", "end"))).alias("e")).select(
        "_no", F.transform("e", lambda x: x["end"]).alias("ends"))


def plan(rows: DataFrame, again: DataFrame | None = None, shards: int = 16, block_words: int = 4096, max_blocks: int = 1_000_000,
         seed: str = "mix") -> DataFrame:
    """``rows`` (from ``sized``) with ``source_size``, ``target`` and ``spans``.

    A span is a run of a document's words in one block of one pass: ``pass,
    start, n, shard``. ``again`` may give the narrow columns of the same rows
    where ``rows`` is wide, so that totals don't read the texts. Blocks have
    ``block_words`` words, or more where there would be over ``max_blocks``.
    """
    narrow = (again if again is not None else rows).select("source", "_bucket", "size")
    buckets = narrow.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("_words").over(
        Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    buckets = stored(buckets, "mix-buckets")
    goal = targets(buckets.groupBy("source").agg(F.sum("_words").alias("source_size")))
    goal = goal.withColumn("_take", F.floor("target")).withColumn(
        "_block", F.greatest(F.lit(block_words), F.ceil(F.sum("_take").over(Window.partitionBy(F.lit(0))) / max_blocks)).cast("long"))
    goal = goal.withColumn("blocks", F.ceil(F.col("_take") / F.col("_block")))
    goal = stored(goal, "mix-targets")
    goal = goal.join(split_tree(goal.select("_no", "blocks"), shards, seed), "_no", "left")
    known = buckets.alias("b").join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source"))).select(
        F.col("b.source").alias("_s"), F.col("b._bucket").alias("_b"), "_before", "source_size", "target", "_take", "_block", "blocks", "ends")
    joined = rows.join(known, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).drop("_s", "_b")
    local = Window.partitionBy("source", "_bucket").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    joined = joined.withColumn("_at", F.col("_before") + F.coalesce(F.sum("size").over(local), F.lit(0)))

    prime = F.lit(PRIMES[-1])
    for p in PRIMES[-2::-1]:
        prime = F.when(F.col("blocks") % p != 0, F.lit(p)).otherwise(prime)
    shift = F.crc32(F.concat_ws(":", F.lit(seed), F.col("source")).cast("binary"))

    def spans(p):
        a = p * F.col("source_size") + F.col("_at")
        n = F.least(F.col("size"), F.greatest(F.col("_take") - a, F.lit(0)))
        size = F.col("_block")

        def span(b):
            lo = F.greatest(b * size, a)
            slot = F.pmod(b * prime + shift, F.col("blocks"))
            return F.struct(p.cast("int").alias("pass"), (lo - a).alias("start"), (F.least((b + 1) * size, a + n) - lo).alias("n"),
                            F.size(F.filter("ends", lambda e: e <= slot)).alias("shard"))

        return F.when(n > 0, F.transform(F.sequence(F.floor(a / size), F.floor((a + n - 1) / size)), span)).otherwise(
            F.array().cast("array<struct<pass:int,start:bigint,n:bigint,shard:int>>"))

    out = F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long")), spans))
    return joined.withColumn("spans", F.when(F.col("size") > 0, out).otherwise(
        F.array().cast("array<struct<pass:int,start:bigint,n:bigint,shard:int>>"))).drop(
            "_at", "_before", "_take", "_block", "blocks", "ends")


def mixed(docs: DataFrame, shards: int = 16, seed: str = "mix", shard: str | None = None) -> DataFrame:
    """The mix as documents with the columns of ``docs``, shard after shard, shuffled inside each.

    A shard is a run of partitions, cut by the seeded order, so none depends on
    the sources' sizes. ``shard`` names a column to add with the shard's number.

    A document comes once per pass that takes words of it, with its text as it
    is; where a target ends inside a document, that copy has the taken words
    only, one space between them. ``n_chars``, if there, follows the text.
    """
    cols = docs.columns
    # the text travels once, beside the other columns
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols if c != "text"]).alias("_row"), "doc_id", "source", "text")
    rows = sized(own, seed)
    narrow = stored(sized(docs.select("doc_id", "source", "text"), seed).select("source", "_bucket", "size"), "mix-sizes")
    whole = plan(rows, narrow, shards, seed=seed)
    copies = whole.withColumn("_pass", F.explode(F.array_distinct(F.transform("spans", lambda x: x["pass"]))))
    taken = F.aggregate(F.filter("spans", lambda x: x["pass"] == F.col("_pass")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    text = F.when(taken >= F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), taken.cast("int")), " "))
    copies = copies.withColumn("_text", text).withColumn("_order", F.xxhash64(F.lit(seed), "_key", "_pass")).withColumn(
        "_shard", F.filter("spans", lambda x: x["pass"] == F.col("_pass"))[0]["shard"])
    fields = [F.col("_text").alias("text") if c == "text" else F.length("_text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
              else F.col("_row").getField(c).alias(c) for c in cols]
    out = copies.select(F.struct(*fields).alias("_out"), "_shard", "_order").repartitionByRange("_shard", "_order")
    return out.sortWithinPartitions("_shard", "_order").select("_out.*", *([F.col("_shard").alias(shard)] if shard else []))


def op8_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = sized(load(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", "size", "_key", "_bucket")
    out = plan(stored(docs, "mix-sizes"))
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


#: The same mix in SQL; the splitting tree decides which shard a word goes to, not how many are taken.
ORACLE = """
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
                  substr(md5('mix:' || coalesce(doc_id::varchar, '')), 1, 16) as k from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
n as (select *, row_number() over (order by source is null, source collate "binary") - 1 as no from s),
w as (select *, case no % 3 when 0 then 3 when 1 then 1 else 2 end as w from n),
f as (select *, 4 * source_size * (sum(w) over () - coalesce(sum(w) over o, 0))
             < (3 * sum(source_size) over () - 4 * coalesce(sum(source_size) over o, 0)) * w as full_
      from w window o as (order by source_size * (6 // w), no rows between unbounded preceding and 1 preceding)),
t as (select *, case when full_ then (2 * source_size)::double else least((2 * source_size)::double,
        (w * (3 * sum(source_size) over () - 4 * sum(case when full_ then source_size else 0 end) over ()))::double
        / nullif((2 * sum(case when full_ then 0 else w end) over ()), 0)::double) end as target from f),
a as (select d.*, t.source_size, t.target,
             coalesce(sum(d.size) over (partition by d.source order by d.k, d.size rows between unbounded preceding and 1 preceding), 0) as before
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (greatest(0, least(size, floor(target) - before)) + greatest(0, least(size, floor(target) - source_size - before)))::bigint as taken
from a
"""
