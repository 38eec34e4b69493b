"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is a built-in Spark expression over the document's own text, so
the whole operator is one map over the scan: no shuffle, no user function, and
a lost task is simply read again.

Defined results for odd input: a null or blank text has no words, all measures
0 and ratios 0, and fails the base rule. Equal rows get equal verdicts. Input
columns whose names clash with a measure are replaced by the measure when the
caller asks for ``keep_columns``; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import SPACE_CHARS, WORD, load

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = tuple(
    "the of and to in a is that for it as was with be by on not are this at from or have an they which you "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er so "
    "le la les et de un une du des en que qui dans pour par sur pas au avec ce il est sont ne "
    "el los las y del que una por con para se su al lo como más pero sus este ha".split()
)
#: Their spellings in lower case, with a capital, and in capitals.
CAPITALS = tuple(sorted({v for w in STOP_WORDS for v in (w, w.capitalize(), w.upper())}))
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``low <= measure <= high``, where the measure is one of ``MEASURES``."""

    measure: str
    low: float = float("-inf")
    high: float = float("inf")


#: The thresholds. Ratios are per word, per character or per line, as named.
RULES = (
    Rule("n_words", 50, 1_000_000),
    Rule("repeat_word_ratio", high=0.5),
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_ratio", high=0.15),
    Rule("stop_word_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.4),
)


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _repeat_words() -> Column:
    """Words inside a 3-word window that occurs at least twice (first included).

    ``_packed`` has for every window its 64-bit hash with the low bits replaced
    by its position, sorted as plain longs; windows with equal full hashes are
    neighbours there. Those are marked, put back in text order, and a marked
    window adds the words up to the next marked one, three at most.
    """
    place = lambda x: F.pmod(x, F.col("_m"))
    full = lambda x: F.get(F.col("_h"), place(x).cast("int"))
    marked = F.sort_array(F.transform(
        F.filter(F.col("_packed"), lambda x, k: (full(F.get(F.col("_packed"), k - 1)) == full(x))
                 | (full(F.get(F.col("_packed"), k + 1)) == full(x))), place))
    # transform over a one-element array stands for "let b = marked"
    covered = F.transform(F.array(marked), lambda b: F.aggregate(
        F.transform(b, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(b, k + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda a, x: a + x))
    return F.get(covered, 0)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of ``MEASURES`` added (or replaced)."""
    base = docs.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    spaced = F.col("_t")
    for c in SPACE_CHARS[1:]:
        spaced = F.replace(spaced, F.lit(c), F.lit(" "))
    base = base.withColumn("_w", F.filter(F.split(spaced, " "), lambda w: w != ""))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD))
    base = base.withColumns({"_lines": lines, "n_words": F.size("_w").cast("long")})
    hashes = F.when(F.col("n_words") >= 3, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size("_w") - 3, F.lit(0))),
        lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))))
    base = base.withColumns({
        "_h": F.coalesce(hashes, F.array().cast("array<bigint>")),
        "_m": F.when(F.col("n_words") < (1 << 24), F.lit(1 << 24)).otherwise(F.lit(1 << 31)).cast("long")})
    # most documents repeat no window: a linear distinct tells, and nothing is sorted for them
    base = base.withColumn("_packed", F.when(
        F.size(F.array_distinct("_h")) < F.size("_h"),
        F.sort_array(F.transform("_h", lambda h, i: h - F.pmod(h, F.col("_m")) + i))))
    base = base.withColumns({
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": (F.length("_t") - F.length(_without(F.col("_t"), SYMBOLS))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(F.col("_packed").isNull(), 0).otherwise(_repeat_words()).cast("long"),
        "n_stop_words": F.size(F.filter("_w", lambda w: w.isin(*CAPITALS))).cast("long"),
    })

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return base.withColumns({
        "mean_word_chars": ratio("word_chars", "n_words"),
        "symbol_ratio": ratio("n_symbols", "word_chars"),
        "stop_word_ratio": ratio("n_stop_words", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
        "repeat_word_ratio": ratio("n_repeat_words", "n_words"),
    }).drop("_t", "_w", "_lines", "_h", "_m", "_packed")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words",
            "mean_word_chars", "symbol_ratio", "stop_word_ratio", "dup_line_ratio", "repeat_word_ratio")


def compile_rules(rules=RULES) -> tuple[Column, Column]:
    """The table as two expressions: names of the broken rules, and whether none is broken."""
    checks = []
    for r in rules:
        if r.measure not in MEASURES:
            raise ValueError(f"unknown measure {r.measure}")
        c = F.lit(False)
        if r.low != float("-inf"):
            c = c | (F.col(r.measure) < r.low)
        if r.high != float("inf"):
            c = c | (F.col(r.measure) > r.high)
        checks.append(F.when(c, F.lit(r.measure)))
    broken = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    return broken, F.size(broken) == 0


def apply_rules(docs: DataFrame, rules=RULES, text: str = "text", keep_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep_columns``, the measures, ``base_failed``, ``broken_rules`` and ``kept`` of every row."""
    broken, fine = compile_rules(rules)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    cols = list(dict.fromkeys([*keep_columns, text]))
    out = measures(docs.select(*cols), text).withColumns({"base_failed": failed, "broken_rules": broken})
    # the running number is never negative; it keeps Catalyst from pushing a filter on the verdict, and with it
    # all the measures again, below every projection
    kept = ~F.col("base_failed") & (F.size("broken_rules") == 0) & (F.monotonically_increasing_id() >= 0)
    return out.withColumn("kept", kept).select(*keep_columns, *MEASURES, "base_failed", "broken_rules", "kept")


def keep_good(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns unchanged."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("text"))
    good = apply_rules(packed, rules, "text", ("_row",)).where("kept")
    return good.select("_row.*")


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return apply_rules(load(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_rule(r: Rule) -> str:
    parts = [f"{r.measure} >= {r.low}"] * (r.low != float("-inf")) + [f"{r.measure} <= {r.high}"] * (r.high != float("inf"))
    return " and ".join(parts) or "true"


ORACLE = f"""
with w as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from documents),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from w, unnest(range(1, len(w) - 1)) u(i)),
r as (select doc_id, i from g qualify count(*) over (partition by doc_id, g) > 1),
p as (select doc_id, count(distinct i + o) as n from r, (values (0), (1), (2)) v(o) group by doc_id),
m as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(p.n, 0)::bigint as n_repeat_words, len(l) as n_lines,
        len(list_filter(w, lambda x: x in ({", ".join(f"'{w}'" for w in CAPITALS)}))) as n_stop_words
      from w left join p using (doc_id)),
a as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
        case when n_words > 0 then word_chars / n_words else 0.0 end as mean_word_chars,
        case when word_chars > 0 then n_symbols / word_chars else 0.0 end as symbol_ratio,
        case when n_words > 0 then n_stop_words / n_words else 0.0 end as stop_word_ratio,
        case when n_lines > 0 then n_dup_lines / n_lines else 0.0 end as dup_line_ratio,
        case when n_words > 0 then n_repeat_words / n_words else 0.0 end as repeat_word_ratio from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and {" and ".join(_sql_rule(r) for r in RULES)} as kept from a
"""
