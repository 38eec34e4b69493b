"""Cost-balanced packing of tokenised documents into fixed-length sequences.

Documents are tokenised and packed inside the task that reads them: tasks hold
``group_tokens`` ids at a time, so nothing is shuffled, memory is bounded and a
lost task repeats its own split only. In a group, full sequences are cut off
documents longer than a sequence; the remaining pieces go in descending order to
the open sequence with the lowest attention cost (linear plus quadratic in the
pieces' lengths) among those with room. The number of sequences is the fewest
that hold the group's ids, so a piece that no sequence has room for is cut over
the roomiest ones. What is left in the group's last partly filled sequence is
dealt into sequences whose lengths are powers of two, which need no padding.

Defined results: null text is empty and packs as its end id alone; every input
row is packed, so repeated rows appear as often as they come (with the same
``doc_id`` and ``start``); extra columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import heapq
import json
import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import load

END_ID = 1
SCHEMA = ("doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_cost double")


def _added_tokens(path: str) -> dict[str, int]:
    """Tokens that the file's tokenizer takes out of a text before it looks at words."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f).get("added_tokens", ()) if t["content"]}


def _ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id from a byte-level BPE file, whose merges must come in id order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    # the file writes printable bytes as themselves and the others as the characters from 256 on
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [model["vocab"][a + b] for a, b in merges]
    if order != sorted(order):
        raise ValueError("merges are not in the order of their ids")
    tokens = [c for c in byte] + [a + b for a, b in merges]
    return {bytes(byte[c] for c in t): model["vocab"][t] for t in tokens}


class Encoder:
    """Ids of whole texts from a byte-level BPE file of the ``tokenizers`` library.

    A single space between two other characters always begins a new word of
    such a tokenizer, so a text's ids are those of its space-led chunks in a
    row. Chunks repeat much; their ids are kept, ``keep`` chunks at most. A text
    with other white space beside a space is encoded whole. New chunks go
    through ``tiktoken`` with the file's own vocabulary: the same ids, several
    times faster on short strings. Where a text spells an added token of the file,
    it is cut there and the token's own id stands between the parts.
    """

    def __init__(self, path: str, keep: int = 1_000_000):
        import tiktoken
        from public_tokenizers import PATTERN

        ranks = _ranks(path)
        self.encode = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.width = np.zeros(max(ranks.values()) + 1, dtype=np.int64)  # bytes of each token
        self.width[list(ranks.values())] = [len(t) for t in ranks]
        self.keep, self.known = keep, {}
        self.added = _added_tokens(path)
        # the longest first where one token begins with another
        names = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def _learn(self, chunks: list[str]) -> None:
        """Encode new chunks in one call and cut the ids where the chunks end."""
        ids = np.array(self.encode(" " + " ".join(chunks)), dtype="<u4")
        ends = np.cumsum([1 + len(c.encode()) for c in chunks])
        cuts = np.searchsorted(np.cumsum(self.width[ids]), ends) + 1
        data, at = ids.tobytes(), 0
        for c, cut in zip(chunks, cuts.tolist()):
            self.known[c] = data[4 * at:4 * cut]
            at = cut

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > self.keep:
            self.known = {}
        known, split = self.known, [t.split(" ") for t in texts]
        new = {c for chunks in split for c in chunks[1:] if c not in known}
        alone = {c for c in new if c and not c[0].isspace() and not c[-1].isspace()}
        if alone:
            self._learn(sorted(alone))
        out = []
        for text, (first, *chunks) in zip(texts, split):
            parts = [known.get(c) for c in chunks]
            if self.cut and self.cut.search(text):
                ids = [[self.added[p]] if p in self.added else self.encode(p) for p in self.cut.split(text) if p]
                out.append(np.array([i for p in ids for i in p], dtype="<u4"))
            elif chunks and (not first or first[-1].isspace()) or None in parts:
                out.append(np.array(self.encode(text), dtype="<u4"))
            else:
                out.append(np.frombuffer(array("I", self.encode(first)).tobytes() + b"".join(parts), dtype="<u4"))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(path)


class _Rooms:
    """Open sequences in a heap by cost for each remaining room, and a tree of the cheapest over ranges of room."""

    def __init__(self, size: int):
        self.half = 1 << size.bit_length()
        self.heaps = [[] for _ in range(self.half)]
        self.tree = [(math.inf, -1, -1)] * (2 * self.half)  # cost, sequence, room

    def _update(self, room: int) -> None:
        heap, k = self.heaps[room], self.half + room
        self.tree[k] = (*heap[0], room) if heap else (math.inf, -1, -1)
        while k > 1:
            k //= 2
            self.tree[k] = min(self.tree[2 * k], self.tree[2 * k + 1])

    def put(self, room: int, cost: float, sequence: int) -> None:
        heapq.heappush(self.heaps[room], (cost, sequence))
        self._update(room)

    def take(self, room: int) -> int:
        _, sequence = heapq.heappop(self.heaps[room])
        self._update(room)
        return sequence

    def cheapest(self, least: int) -> int | None:
        """Take the cheapest sequence with ``least`` room or more."""
        k, best = self.half + least, self.tree[self.half + least]
        while k > 1:
            if k % 2 == 0:
                best = min(best, self.tree[k + 1])
            k //= 2
        return self.take(best[2]) if best[1] >= 0 else None

    def roomiest(self) -> int:
        k = 1
        while k < self.half:
            k = 2 * k + (self.tree[2 * k + 1][1] >= 0)
        return k - self.half


def pack(lengths: list[int], size: int, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; each id in exactly one.

    ``lengths`` are the documents' id counts, all positive. Deterministic: ties
    go to the earlier document and the lower sequence.
    """
    pieces, rest, sequence = [], [], 0
    for d, n in enumerate(lengths):
        full = n // size
        for k in range(full):
            pieces.append((d, k * size, size, sequence, 0))
            sequence += 1
        if n % size:
            rest.append((n % size, d, full * size))
    if not rest:
        return pieces
    rest.sort(key=lambda r: (-r[0], r[1]))
    total = sum(r[0] for r in rest)
    count = -(-total // size)
    room, cost = [size] * count, [0.0] * count
    if total % size:
        room[-1] = total % size  # exactly enough room altogether, so every sequence ends full
    price = lambda n: linear * n + quadratic * n * n
    used = [0] * count
    lots = _Rooms(size)
    for s in range(count):
        lots.put(room[s], 0.0, s)
    for n, d, start in rest:
        s = lots.cheapest(n)
        parts, left = [(s, n)] if s is not None else [], n
        while s is None and left:  # cut over the sequences with most room
            r = lots.roomiest()
            t = lots.take(r)
            parts.append((t, min(left, r)))
            left -= parts[-1][1]
        for s, take in parts:
            pieces.append((d, start, take, sequence + s, used[s]))
            start += take
            used[s] += take
            cost[s] += price(take)
            if used[s] < room[s]:
                lots.put(room[s] - used[s], cost[s], s)
    if total % size:
        pieces = _powers_of_two(pieces, sequence + count - 1, total % size)
    return pieces


def _powers_of_two(pieces: list[tuple], last: int, length: int) -> list[tuple]:
    """Deal the short last sequence into sequences whose lengths are powers of two."""
    bounds, at = [], 0
    for bit in reversed(range(length.bit_length())):
        if length >> bit & 1:
            bounds.append((at, at + (1 << bit)))
            at += 1 << bit
    out = [p for p in pieces if p[3] != last]
    for d, start, n, _, offset in (p for p in pieces if p[3] == last):
        for k, (a, b) in enumerate(bounds):
            lo, hi = max(a, offset), min(b, offset + n)
            if lo < hi:
                out.append((d, start + lo - offset, hi - lo, last + k, lo - a))
    return out


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, linear: float = 1.0, quadratic: float = 1.0 / 2048,
                   group_tokens: int = 4_000_000) -> DataFrame:
    """One row per piece; ``docs`` needs ``doc_id`` and ``text``.

    ``sequence_id`` is the task's number in its upper 31 bits and a counter in
    the lower 32. ``tokenizer`` is a file present on every executor.
    """

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, first = encoder(tokenizer), TaskContext.get().partitionId() << 32
        ids: list[np.ndarray] = []
        docs: list = []
        held = 0

        def flush() -> pd.DataFrame:
            nonlocal first, held
            pieces = pack([len(x) for x in ids], size, linear, quadratic)
            out = pd.DataFrame(pieces, columns=["d", "start", "length", "sequence_id", "offset"])
            out["doc_id"] = [docs[d] for d in out["d"]]
            out["doc_tokens"] = [len(ids[d]) for d in out["d"]]
            out["ids_crc32"] = [zlib.crc32(ids[d][a:a + n]) for d, a, n in zip(out["d"], out["start"], out["length"])]
            price = linear * out["length"] + quadratic * out["length"].astype(float) ** 2
            out["sequence_cost"] = price.groupby(out["sequence_id"]).transform("sum")
            out["sequence_id"] += first
            first += int(max(p[3] for p in pieces)) + 1
            ids.clear()
            docs.clear()
            held = 0
            return out.drop(columns="d")[[c.split()[0] for c in SCHEMA.split(", ")]]

        for pdf in frames:
            texts = pdf["text"].fillna("").tolist()
            for lo in range(0, len(texts), 256):
                for doc_id, got in zip(pdf["doc_id"].iloc[lo:lo + 256], encode(texts[lo:lo + 256])):
                    ids.append(np.append(got, np.uint32(END_ID)).astype("<u4"))
                    docs.append(doc_id)
                    held += len(got) + 1
                if held >= group_tokens:
                    yield flush()
        if ids:
            yield flush()

    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, SCHEMA)
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"), public_tokenizer())
