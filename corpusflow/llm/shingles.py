"""Word shingles as 64-bit hashes, and small helpers for grouped Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd

from corpusflow.llm.common import WORD

_WORD = re.compile(WORD)
_P = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Lower-cased (A-Z) words of a text."""
    # bytes.lower changes A-Z only, and takes a fraction of str.translate's time
    return _WORD.findall(text.encode().lower().decode()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_words(tokens: list[str]) -> np.ndarray:
    """64-bit hashes that depend on the words alone, equal in every process."""
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    return pd.util.hash_array(np.array(tokens, dtype=object), categorize=True)


def shingle_hashes(hashed: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; with fewer words, of the whole sequence; empty without words."""
    n = len(hashed)
    if n == 0:
        return hashed
    take = min(n, size)
    out = np.full(n - take + 1, take, dtype=np.uint64)
    for k in range(take):
        out = out * _P + hashed[k:n - take + 1 + k]
    return mix(out)


def hashed_docs(texts: Iterable[str | None]) -> list[np.ndarray]:
    """Word hashes of several texts, hashed together."""
    tokens = [words(t) for t in texts]
    ends = np.cumsum([len(t) for t in tokens])
    flat = hash_words([w for t in tokens for w in t])
    return np.split(flat, ends[:-1]) if tokens else []


def whole_groups(frames: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches regrouped so that no run of rows with equal ``keys`` is cut.

    The rows come sorted by ``keys``; the last run of a batch waits for the next one.
    """
    held: list[pd.DataFrame] = []
    for pdf in frames:
        if not len(pdf):
            continue
        changed = np.zeros(len(pdf), dtype=bool)
        for k in keys:
            v = pdf[k].to_numpy()
            changed[1:] |= v[1:] != v[:-1]
            if held:
                changed[0] |= v[0] != held[-1][k].iloc[-1]
        starts = np.flatnonzero(changed)
        if held and not len(starts):
            held.append(pdf)
            continue
        if not held and (not len(starts)):
            held = [pdf]
            continue
        cut = starts[-1]
        done = [*held, pdf.iloc[:cut]]
        held = [pdf.iloc[cut:]]
        whole = pd.concat([d for d in done if len(d)], ignore_index=True) if any(len(d) for d in done) else None
        if whole is not None:
            yield whole
    if held:
        yield pd.concat(held, ignore_index=True)


def group_bounds(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Start of every run of equal keys, and the number of rows."""
    changed = np.zeros(len(pdf), dtype=bool)
    changed[0] = True
    for k in keys:
        v = pdf[k].to_numpy()
        changed[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(changed), len(pdf))
