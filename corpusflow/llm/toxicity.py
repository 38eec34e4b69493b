"""Toxicity scores: boosted trees over dense features, with isotonic calibration.

The features are densities of lexicon words (a small built-in list, and words
and word beginnings learned from the labelled documents), hits near a second
person, capitals, punctuation and obfuscated spellings. Lexicon and trees are
fitted on at most ``sample_rows`` labelled documents; the calibration uses
out-of-fold margins of the same rows. All documents are scored in one map over
the scan; their texts are never shuffled.

Defined results: null and blank texts have all features 0 and get the score of
such a text; equal texts get equal scores; labels, language, source and ids are
no inputs; without labels the score is the prior 0.5; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.boosting import Forest, fit, isotonic, labelled_sample
from corpusflow.llm.common import by_frame, crc_part, load
from corpusflow.llm.shingles import words

#: Insults that need no learning.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown clowns "
    "fool imbecile jerk bastard bitch hate kill ugly freak pig rat vermin filth".split())
SECOND = frozenset(
    "you your yours yourself u ur ya du dich dir dein deine euch ihr tu te toi ton ta tes vous votre vos tú ti tus usted vosotros".split())
EDGES = "\"'`.,;:!?()[]{}<>«»„“”’…*_~-"
LEET = str.maketrans("013457@$!|+", "oleastasilt")
REPEATED = re.compile(r"([^\W\d_])\1{2,}")
PREFIXES = (4, 5, 6)
NEAR = 5
FEATURES = (
    "log_words", "built_in_density", "learned_density", "learned_hits", "weight_density", "top_weight", "window_density",
    "second_density", "near_second_density", "capital_share", "shouted_share", "bang_density", "question_density",
    "punct_run_density", "obfuscated_density", "disguised_hits",
)


def plain(token: str) -> str:
    return token.strip(EDGES)


def disguised(token: str) -> str | None:
    """The word behind digits, symbols, separators or stretched letters; None for an ordinary spelling."""
    core = token.strip("\"'`.,;:?()[]{}<>«»")
    if not core or core.isalpha() and not REPEATED.search(core):
        return None
    letters = sum(map(str.isalpha, core))
    if letters < 2 or letters == len(core) and not REPEATED.search(core):
        return None
    bare = core.rstrip("!").translate(LEET)
    return REPEATED.sub(r"\1", "".join(c for c in bare if c.isalpha()))


#: Judgements of tokens that a worker keeps at most.
KEEP = 500_000


def judge(token: str, lexicon: dict[str, float]) -> tuple | None:
    """(built-in, learned weight, disguised, disguised hit, second person) of a token; None where all are 0."""
    w = plain(token)
    score = lexicon.get(w, 0.0)
    for k in PREFIXES:
        if len(w) > k:
            score = max(score, lexicon.get(w[:k] + "~", 0.0))
    mask = None if w.isalpha() and not REPEATED.search(w) else disguised(token)
    masked = mask is not None and mask != w
    known = (w in INSULTS, score, masked, masked and (mask in INSULTS or mask in lexicon), w in SECOND)
    return known if any(known) else None


def features(text: str | None, lexicon: dict[str, float], judged: dict) -> list[float]:
    """The values of ``FEATURES``; all 0 without a word. ``judged`` keeps tokens' judgements between texts."""
    raw = words(text)
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    telling = {}
    for token in set(raw):
        known = judged.get(token, False)
        if known is False:
            known = judged[token] = judge(token, lexicon)
        if known is not None:
            telling[token] = known
    built = learned = weight = top = masked = hidden = 0.0
    hits: list[int] = []
    seconds: list[int] = []
    for i, token in enumerate(raw) if telling else ():
        if token not in telling:
            continue
        a, score, m, found, second = telling[token]
        built += a
        learned += score > 0
        weight += score
        top = max(top, score)
        masked += m
        hidden += found
        if a or score or found:
            hits.append(i)
        if second:
            seconds.append(i)
    near = 0
    if hits and seconds:
        at = np.searchsorted(seconds, hits)
        s = np.array([-10**9, *seconds, 10**9])
        near = int(np.sum(np.minimum(np.array(hits) - s[at], s[at + 1] - np.array(hits)) <= NEAR))
    window = 0
    if hits:
        h = np.array(hits)
        window = int((np.searchsorted(h, h + 50) - np.arange(len(h))).max())
    chars = Counter(text)
    letters = sum(k for c, k in chars.items() if c.isalpha())
    upper = sum(k for c, k in chars.items() if c.isupper())
    shouted = sum(len(w) > 2 and w.isupper() for w in text.split()) if upper * 5 > letters else 0
    runs = text.count("!!") + text.count("??") + text.count("?!")
    return [
        math.log(n), built / n, learned / n, min(learned, 50.0), weight / n, top, window / 50, len(seconds) / n, near / n,
        upper / max(letters, 1), shouted / n, chars["!"] / n, chars["?"] / n, runs / n, masked / n, hidden,
    ]


def matrix(texts: Iterable, lexicon: dict[str, float]) -> np.ndarray:
    judged, rows = {}, []
    for t in texts:
        if len(judged) > KEEP:
            judged = {}
        rows.append(features(t, lexicon, judged))
    return np.array(rows, dtype=np.float64).reshape(-1, len(FEATURES))


def forms(text: str | None) -> set[str]:
    """Distinct words of a text and, marked with ``~``, their beginnings."""
    found = {plain(w) for w in set(words(text))}
    return {f for w in found if w for f in (w, *(w[:k] + "~" for k in PREFIXES if len(w) > k))}


def learn_lexicon(sample: DataFrame, size: int = 400, least: int = 5, ratio: float = 8.0) -> dict[str, float]:
    """Log-odds of the ``size`` forms that mark toxic documents most; each in ``least`` of them or more."""

    def frame(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            bad, good = Counter(), Counter()
            for text, y in zip(pdf["text"], pdf["y"]):
                (bad if y > 0.5 else good).update(forms(text))
            all_ = sorted({*bad, *good})
            if all_:
                yield pd.DataFrame({"form": all_, "bad": [bad[f] for f in all_], "good": [good[f] for f in all_]})

    totals = sample.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    bad, good = float(totals[0] or 0), float(totals[1] or 0)
    if not bad or not good:
        return {}
    counts = sample.mapInPandas(frame, "form string, bad long, good long").groupBy("form").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")).where(F.col("bad") >= least)
    odds = F.log(((F.col("bad") + 0.5) / (bad + 1)) / ((F.col("good") + 0.5) / (good + 1)))
    best = counts.withColumn("odds", odds).where(F.col("odds") >= math.log(ratio)).orderBy(
        F.col("odds").desc(), "form").limit(size).collect()
    return {r["form"]: float(r["odds"]) for r in best}


@dataclass(frozen=True)
class Model:
    lexicon: dict
    forest: Forest
    xs: np.ndarray
    ys: np.ndarray

    def score(self, texts: Iterable) -> np.ndarray:
        return np.interp(self.forest.margin(matrix(texts, self.lexicon)), self.xs, self.ys)


def train(docs: DataFrame, labels: DataFrame, held_out, label: str = "toxic", sample_rows: int = 20_000, folds: int = 3) -> Model:
    sample = labelled_sample(docs, labels, label, held_out, sample_rows)
    lexicon = learn_lexicon(sample)

    def frame(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"x": list(matrix(pdf["text"], lexicon)), "y": pdf["y"].to_numpy()})

    rows = sample.mapInPandas(by_frame(frame), "x array<double>, y double").toPandas()
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    y = rows["y"].to_numpy(dtype=np.float64)
    order = np.lexsort([*x.T, y])  # the order in which tasks end must not matter
    x, y = x[order], y[order]
    settings = {"trees": 60, "depth": 3}
    margin = np.zeros(len(y))
    fold = np.arange(len(y)) % folds
    for k in range(folds):
        margin[fold == k] = fit(x[fold != k], y[fold != k], **settings).margin(x[fold == k])
    xs, ys = isotonic(margin, y) if len(y) else (np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    return Model(lexicon, fit(x, y, **settings), xs, ys)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row."""

    def frame(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "score": model.score(pdf["text"])})

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(
        by_frame(frame), "doc_id string, score double").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    held = lambda c: crc_part(c, 4) == 2
    model = train(docs, load(spark, sf_dir, "labels"), held)
    return score(docs, model).select("doc_id", held(F.col("doc_id")).alias("held_out"), "score",
                                     (F.col("score") >= 0.3).cast("int").alias("predicted"))
