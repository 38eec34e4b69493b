"""Secret scan with a password guess-cost dynamic programme.

Three base patterns find assignments, access keys and long hex runs. The method
then looks at every value in a credential context (``pwd: ...``, ``login =
...``), segments it at minimum guess cost into dictionary words, dates, repeats,
keyboard walks, sequences and brute-force runs, and reports values that would
take an attacker more than ``min_log10_guesses`` guesses. Placeholders such as
``pwd: changeme123`` cost little and stay out. The dictionary is common password
parts, then the words and word parts of the public tokenizer by rank, so that
prose after such a name costs little too. Values of under six characters are not
looked at: they can't cost that much.

One map over the scan, no shuffle; each document is scanned whole, and a lost
task is read again. Defined results: a null text counts as empty, has no span
and the digest of the empty string; equal rows get equal results; positions are
code points, ends exclusive; other columns are neither read nor returned; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Sequence
from functools import lru_cache
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import by_frame, load

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "guess")

#: A name that announces a credential, a separator, and the value after it.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|(?:access|private|auth|encryption|signing)[_-]?key"""
    r"""|credentials?|authorization|bearer|login|auth|pin)["']?\x20{0,4}(?::=|=>|[:=])\x20{0,4}["']?(?:(?:bearer|basic|token|digest)\x20{1,4})?([^\s"'`<>,;()]+)""",
    re.IGNORECASE | re.ASCII)

#: Common password parts by rank.
COMMON = (
    "password passwd pass admin root user test guest login welcome letmein qwerty monkey dragon master secret "
    "token key api example sample demo changeme change default dummy foo bar baz hello world love iloveyou "
    "sunshine princess football baseball shadow superman batman trustno abc access server database mysql "
    "oracle postgres service account private public none null true false required optional string value "
    "your my the and here insert placeholder redacted hidden summer winter spring autumn monday friday"
).split()
KEYBOARD = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("4@310!5$7", "aaeloisst")
DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?|(?:0?[1-9]|[12]\d|3[01])([-/._])(?:0?[1-9]|1[0-2])\2(?:(?:19|20)\d\d|\d\d)")


def _walks() -> set[str]:
    """Adjacent key pairs, both ways: along a row, and straight or slantwise to the row below."""
    pairs = {a + b for row in KEYBOARD for a, b in pairwise(row)}
    for up, down in pairwise(KEYBOARD):
        pairs |= {a + b for i, a in enumerate(up) for b in down[max(0, i - 1):i + 1]}
    return pairs | {p[::-1] for p in pairs}


WALKS = _walks()
RANK = {w: math.log10(i + 2) for i, w in enumerate(COMMON)}
#: Word parts of the tokenizer shorter than this are cheaper to guess by brute force.
SHORTEST = 3
#: Choosing where to cut: every segment multiplies the guesses by two.
CUT = math.log10(2)


@lru_cache(maxsize=1)
def dictionary() -> tuple[dict[str, float], int]:
    """Word to log10 of its rank, and the longest word's length; read once per worker process."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    ranks = dict(RANK)
    for token in sorted(vocab, key=vocab.get):
        word = token.removeprefix("Ġ").lower()
        if len(word) >= SHORTEST and word.isascii() and word.isalpha() and word not in ranks:
            ranks[word] = math.log10(len(ranks) + 2)
    return ranks, max(map(len, ranks))


def _char_cost(c: str) -> float:
    return 1.0 if "0" <= c <= "9" else math.log10(26) if c.isalpha() else math.log10(33)


def _runs(value: str, same) -> list[tuple[int, int]]:
    """Maximal runs of at least three characters whose neighbours satisfy ``same``."""
    out, start = [], 0
    for i in range(1, len(value) + 1):
        if i == len(value) or not same(value[i - 1], value[i]):
            if i - start >= 3:
                out.append((start, i))
            start = i
    return out


def guess_cost(value: str, ranks: dict[str, float] | None = None, longest: int | None = None, enough: float = math.inf) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` takes.

    Time and memory grow linearly with the value: a word has ``longest``
    characters at most, and the other kinds of segment are maximal runs. Where no
    segmentation can stay below ``enough`` any more, some number of at least
    ``enough`` is returned.
    """
    if ranks is None:
        ranks, longest = dictionary()
    longest = longest or max(map(len, ranks))
    low = value.lower()
    n = min(len(value), len(low))
    plain = low.translate(LEET)
    ends: dict[int, list[tuple[int, float]]] = {}
    starts: dict[int, list[tuple[int, float]]] = {}

    def add(a: int, b: int, cost: float) -> None:
        ends.setdefault(b, []).append((a, cost))
        starts.setdefault(a, []).append((b, cost))

    for a, b in _runs(low, str.__eq__):
        add(a, b, _char_cost(low[a]) + math.log10(b - a))
    for a, b in _runs(low, lambda x, y: x + y in WALKS):
        add(a, b, math.log10(47) + math.log10(4) * math.log2(b - a))
    for step in (1, -1):
        for a, b in _runs(low, lambda x, y, step=step: ord(y) - ord(x) == step):
            add(a, b, math.log10(26) + math.log10(b - a))
    for m in DATE.finditer(low):
        add(*m.span(), math.log10(365 * 60 if len(m[0]) > 4 else 100))
    best = [0.0] * (n + 1)
    brute = [0.0] + [math.inf] * n  # cheapest where the last segment is a brute-force run
    reach = 0  # end of the last run that can still lead below ``enough``
    for i in range(1, n + 1):
        for b, c in starts.get(i - 1, ()):
            if best[i - 1] + c + CUT < enough:
                reach = max(reach, b)
        brute[i] = min(brute[i - 1], best[i - 1] + CUT) + _char_cost(value[i - 1])
        cost = brute[i]
        for j in range(max(0, i - longest), i - 1):
            word = ranks.get(plain[j:i])
            if word is not None:
                part = value[j:i]
                cost = min(cost, best[j] + word + CUT + (0 if part.islower() else CUT)
                           + CUT * sum(x != y for x, y in zip(low[j:i], plain[j:i])))
        for j, c in ends.get(i, ()):
            cost = min(cost, best[j] + c + CUT)
        best[i] = cost
        if cost >= enough and i >= reach and min(best[max(0, i - longest):i + 1]) >= enough:
            return cost
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns' whole matches."""
    out = []
    if ":" in text or "=" in text:  # both patterns with a separator are slow to search for
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return out


def guess_spans(text: str, base: Sequence[tuple[int, int, str]], min_log10_guesses: float) -> list[tuple[int, int, str]]:
    """Costly values in credential contexts that no base span covers."""
    out = []
    if ":" not in text and "=" not in text:
        return out
    ordered, at, covered = sorted(base), 0, 0
    for m in CONTEXT.finditer(text):
        value = m[1].rstrip(".:!?")
        a, b = m.start(1), m.start(1) + len(value)
        while at < len(ordered) and ordered[at][0] <= a:  # matches come by start
            covered = max(covered, ordered[at][1])
            at += 1
        if len(value) < 6 or b <= covered:
            continue
        if guess_cost(value, enough=min_log10_guesses) >= min_log10_guesses:
            out.append((a, b, "guess"))
    return out


def joined(spans: Sequence[tuple[int, int, str]]) -> str:
    """``kind:start:end`` by start, then by kind as listed, then by end."""
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{k}:{a}:{b}" for a, b, k in ordered)


def find(text: str | None, min_log10_guesses: float = 8.0) -> tuple[list, list]:
    base = base_spans(text or "")
    return base, base + guess_spans(text or "", base, min_log10_guesses)


def scan(docs: DataFrame, min_log10_guesses: float = 8.0) -> DataFrame:
    """Counts, digest and spans of every document; ``docs`` needs ``doc_id`` and ``text``."""

    def frame(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for text in pdf["text"]:
            base, spans = find(text, min_log10_guesses)
            n = {k: 0 for k in KINDS}
            for *_, k in spans:
                n[k] += 1
            rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(),
                         joined(spans), n["guess"]))
        out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])
        out.insert(0, "doc_id", pdf["doc_id"].to_numpy())
        return out

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        by_frame(frame), "doc_id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long"
    ).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def redact(docs: DataFrame, mark: str = "[SECRET]", min_log10_guesses: float = 8.0) -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``; other columns unchanged."""

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        spans = sorted((a, b) for a, b, _ in find(text, min_log10_guesses)[1])
        if not spans:
            return text
        parts, at = [], 0
        for a, b in spans:
            if a >= at:
                parts += [text[at:a], mark]
            at = max(at, b)
        return "".join([*parts, text[at:]])

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return texts.map(clean, na_action="ignore").astype(object)

    return docs.withColumn("text", cleaned("text")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents"))
