"""N-gram Jaccard join: globally ordered n-gram sets in tries, traversed together and pruned by length bounds.

The n-grams of all documents have one order, that of their 64-bit hashes. Two
sets that link differ in at most ``k`` n-grams, where ``k`` follows from their
sizes, so of ``k + 1`` ranges of the order at least one holds the same n-grams
in both. Every set therefore has a key for each range (a few more ranges allow
it to leave its emptiest ones out), once for partners up to its own size band
and once for those of the next band; small sets have keys of the whole and of
all but one n-gram. Linked sets thus always share a key, and sets that share
common lines or passages rarely do.

Sets that share a key are joined in tries: the sets of a group become one trie,
and a set is matched with all of them at once, the overlap with a common prefix
being counted once. A subtree goes when the overlap so far and what is left on
either side cannot reach the threshold. First a set is joined with the best
connected member of its keys, then the best connected member of every key that
still holds several components with all others; what the other members of open
keys leave is found in blocks. Before sets are sent to a join, parity bitmaps rule
pairs out: the XOR of two has no more bits than their sets differ in n-grams, so no
link is lost, and hardly a pair but the links is left. Blocks report a spanning
forest first, so copies are not expanded into pairs.

Keys travel packed, sorted, and combined per task, so a key of a third of all
sets costs each reducer one entry per task. Classes of equal sets travel as one
48-bit tag; tags that clash only add candidates.

Defined results: null or blank texts have no n-grams and link with nothing; a
null id takes no part (``component_id`` null); rows repeating an id share its
component and link by each of their texts; other columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.partitions import parallelism, spread
from corpusflow.llm.common import load, stored
from corpusflow.llm.components import components
from corpusflow.llm.shingles import hashed_docs, mix, shingle_hashes, whole_groups

PERCENT = 85
#: Keys combined in a task before they are sent.
FLUSH = 500_000
#: Keys compared in one range of the key space.
RANGE = 2_000_000
#: Members of a block of bitmaps, and of one part of a star of sets.
BLOCK = 1024
STAR = 512
#: Longest parity bitmap; larger sets are ruled out less often.
MOST_BITS = 2**15
#: Pairs of a query and a trie's root or row followed at once.
PAIRS = 2**15
#: N-grams of a trie edge looked at between two bound checks.
STEP = 64
#: N-grams joined in one go.
BATCH = 400_000
#: Words of bitmaps compared at once.
SLICE = 2**19


class Bands:
    """Size bands: linked sets lie in the same band or in neighbours."""

    def __init__(self, percent: int = PERCENT):
        self.percent, self.upper = percent, [1]
        while self.upper[-1] < 2**40:
            u = self.upper[-1]
            self.upper.append(max(u + 1, u * 100 // percent))

    def most(self, upper: int) -> int:
        """Most n-grams that linked sets of up to ``upper`` do not share."""
        return 2 * upper * (100 - self.percent) // (100 + self.percent)

    def keys(self, s: np.ndarray) -> np.ndarray:
        """64-bit keys of a sorted set; linked, different sets share at least one."""
        n, out, small = len(s), [], False
        g = int(np.searchsorted(self.upper, n))
        terms = mix(s)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(terms)])
        high = s >> np.uint64(32)
        for upper in self.upper[g:g + 2]:
            k = self.most(upper)
            small |= k == 1
            if k < 2:
                continue
            spare = max(1, k // 32)
            m = k + 1 + 2 * spare
            ends = np.searchsorted((high * np.uint64(m)) >> np.uint64(32), np.arange(m + 1))
            kept = np.ones(m, dtype=bool)
            kept[np.argsort(np.diff(ends), kind="stable")[:spare]] = False
            place = mix(np.arange(m, dtype=np.uint64) + (np.uint64(upper) << np.uint64(24)))
            out.append(mix((sums[ends[1:]] - sums[ends[:-1]]) ^ place)[kept])
        if small:
            out.append(mix(np.append(sums[-1] - terms, sums[-1]) + np.uint64(1)))
        return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def _pack(v: np.ndarray) -> bytes:
    """The low 48 bits of 64-bit integers, byte plane by byte plane."""
    return v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(b, dtype=np.uint8).reshape(6, -1).T
    return out.view("<u8").ravel()


def _full_key(r: np.ndarray | int, low: np.ndarray) -> np.ndarray:
    return mix(low + mix(np.atleast_1d(np.asarray(r, dtype=np.uint64))))


def ordered_sets(texts: Iterable[str | None], size: int) -> list[np.ndarray]:
    return [np.unique(shingle_hashes(h, size)) for h in hashed_docs(texts)]


def fingerprint(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def tag(fp: bytes) -> int:
    return int.from_bytes(fp[:6], "little")


_PACKED = "r long, kind int, x binary, y binary, z binary"


def _packed_keys(size: int, percent: int, ranges: int):
    """Per flush: set rows (kind 2), members of keys the task repeats (1), and one entry a key and range (0)."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bands, spread_to = Bands(percent), TaskContext.get().partitionId()
        held: dict[int, np.ndarray] = {}

        def flush() -> pd.DataFrame:
            keys = np.concatenate(list(held.values()))
            tags = np.repeat(np.fromiter(held, dtype=np.uint64, count=len(held)), [len(k) for k in held.values()])
            order = np.lexsort((tags, keys))
            keys, tags = keys[order], tags[order]
            first = np.ones(len(keys), dtype=bool)
            first[1:] = keys[1:] != keys[:-1]
            again = np.append(~first[1:], False)  # the next entry has the same key
            where = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
            low = keys & np.uint64(2**48 - 1)
            rows = []
            if not first.all():
                rows.append((spread_to % ranges, 1, _full_key(where[~first], low[~first]).tobytes(), tags[~first].tobytes(), b""))
            keys, low, tags, where, again = keys[first], low[first], tags[first], where[first], again[first]
            cuts = np.flatnonzero(np.diff(where)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)]):
                rows.append((int(where[a]), 0, _pack(low[a:b]), _pack(tags[a:b]), np.packbits(again[a:b]).tobytes()))
            held.clear()
            return pd.DataFrame(rows, columns=["r", "kind", "x", "y", "z"])

        n = 0
        for pdf in frames:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at:at + 256]
                sets = ordered_sets(part["text"], size)
                prints = [fingerprint(s) for s in sets]
                ids = part["doc_id"]
                known = ids.notna().to_numpy()
                number = np.array([int(i) if k else 0 for i, k in zip(ids, known)], dtype=np.int64)
                counts = np.array([len(s) for s in sets], dtype=np.int64)
                yield pd.DataFrame([(spread_to % ranges, 2, np.stack([number, known, counts]).tobytes(),
                                     b"".join(p or bytes(16) for p in prints), b"")], columns=["r", "kind", "x", "y", "z"])
                for s, p, k in zip(sets, prints, known):
                    if p and k and (c := tag(p)) not in held:
                        held[c] = bands.keys(s)
                        n += len(held[c])
                if n >= FLUSH:
                    yield flush()
                    n = 0
        if n:
            yield flush()

    return run


_ENTRIES = "kind int, key long, c long, id long, n_shingles long, fp binary"


def _entries(kind: int, **columns) -> pd.DataFrame:
    out = pd.DataFrame({"kind": kind, **columns}, columns=["kind", "key", "c", "id", "n_shingles", "fp"])
    return out.astype(dict.fromkeys(["key", "c", "id", "n_shingles"], "Int64"))


def _repeated(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Unpacks set rows (2) and members (1), and keeps the entries (0) of keys that another set has too."""
    for pdf in whole_groups(frames, ["r", "kind"]):
        for (r, kind), rows in pdf.groupby(["r", "kind"], sort=False):
            if kind == 2:
                for x, y in zip(rows["x"], rows["y"]):
                    ids, known, counts = np.frombuffer(x, dtype=np.int64).reshape(3, -1)
                    fps = [y[16 * i:16 * i + 16] if n else None for i, n in enumerate(counts)]
                    yield _entries(2, c=[tag(f) if f else None for f in fps], n_shingles=counts, fp=fps,
                                   id=pd.arrays.IntegerArray(ids.copy(), known == 0))
            elif kind == 1:
                for x, y in zip(rows["x"], rows["y"]):
                    yield _entries(1, key=np.frombuffer(x, dtype=np.int64), c=np.frombuffer(y, dtype=np.int64))
            else:
                low, tags = (np.concatenate([_unpack(b) for b in rows[k]]) for k in ("x", "y"))
                again = np.concatenate([np.unpackbits(np.frombuffer(z, dtype=np.uint8), count=len(x) // 6).astype(bool)
                                        for x, z in zip(rows["x"], rows["z"])])
                order = np.lexsort((tags, low))
                low, tags, again = low[order], tags[order], again[order]
                new_key = np.append(True, low[1:] != low[:-1])
                new_set = new_key | np.append(True, tags[1:] != tags[:-1])
                starts = np.flatnonzero(new_key)
                # copies met by several tasks are one entry, and alone no reason to keep a key
                several = (np.add.reduceat(new_set.astype(np.int64), starts) > 1) | np.maximum.reduceat(again, starts)
                keep = new_set & np.repeat(several, np.diff(np.append(starts, len(low))))
                yield _entries(0, key=_full_key(int(r), low[keep]).view(np.int64), c=tags[keep].view(np.int64))


class Forest:
    """Tries of sorted sets, one per root; a node is an edge of n-grams, owned by the first row below it."""

    def __init__(self, roots: list, rows: list[np.ndarray]):
        order = sorted(range(len(rows)), key=lambda i: (roots[i], rows[i].astype(">u8").tobytes()))
        self.rows, self.row = [rows[i] for i in order], order
        self.start = np.cumsum([0, *(len(r) for r in self.rows)])
        flat = np.concatenate(self.rows) if rows else np.empty(0, dtype=np.uint64)
        self.every, self.token = np.unique(flat, return_inverse=True)
        up, owner, begin, end, ends_at = [], [], [], [], []
        self.root: dict = {}
        path: list[int] = []  # nodes of the row before, from its root

        def node(parent: int, row: int, a: int, b: int) -> int:
            up.append(parent), owner.append(row), begin.append(a), end.append(b)
            return len(up) - 1

        for i, s in enumerate(self.rows):
            root = roots[order[i]]
            if root not in self.root:
                self.root[root] = node(-1, i, 0, 0)
                path, common = [self.root[root]], 0
            else:
                before = self.rows[i - 1]
                m = min(len(before), len(s))
                apart = np.flatnonzero(before[:m] != s[:m])
                common = int(apart[0]) if len(apart) else m
            while begin[path[-1]] >= common and len(path) > 1:
                path.pop()
            top = path[-1]
            if end[top] > common:  # the edge splits; its lower part keeps the children
                fork = node(up[top], owner[top], begin[top], common)
                up[top], begin[top] = fork, common
                path[-1] = fork
            if len(s) > common:
                path.append(node(path[-1], i, common, len(s)))
            ends_at.append(path[-1])
        self.up, self.owner, self.begin, self.end = (np.array(x, dtype=np.int64) for x in (up, owner, begin, end))
        self.ends_at = np.array(ends_at, dtype=np.int64)
        n, length = len(up), np.diff(self.start)
        self.shortest, self.longest = np.full(n, 2**62), np.zeros(n, dtype=np.int64)
        np.minimum.at(self.shortest, self.ends_at, length)
        np.maximum.at(self.longest, self.ends_at, length)
        for v in np.argsort(-self.end, kind="stable"):  # children end deeper than their parents
            if self.up[v] >= 0:
                self.shortest[self.up[v]] = min(self.shortest[self.up[v]], self.shortest[v])
                self.longest[self.up[v]] = max(self.longest[self.up[v]], self.longest[v])
        self.child_order, self.child_start = self._lists(self.up, n)
        self.leaf_order, self.leaf_start = self._lists(self.ends_at, n)

    @staticmethod
    def _lists(of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions by value, and where each value's positions start."""
        order = np.argsort(of, kind="stable")
        return order, np.searchsorted(of[order], np.arange(n + 1))


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...`` (``count[i]`` numbers) for all i."""
    return np.arange(int(count.sum())) + np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count)


def trie_join(roots: list, rows: list[np.ndarray], asked: list, queries: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of queries and rows of the same root that link; sets are sorted and not empty."""
    t = Forest(roots, rows)
    sizes = pd.Series(roots).value_counts() if roots else {}
    found, part, n = [(np.empty(0, dtype=np.int64),) * 2], [], 0
    for i, r in enumerate(asked):
        if r in t.root:
            part.append(i)
            n += int(sizes[r])
        if part and (n >= PAIRS or i == len(asked) - 1):
            x, y = _traversed(t, [t.root[asked[k]] for k in part], [queries[k] for k in part], percent)
            found.append((np.array(part, dtype=np.int64)[x], y))
            part, n = [], 0
    if part:
        x, y = _traversed(t, [t.root[asked[k]] for k in part], [queries[k] for k in part], percent)
        found.append((np.array(part, dtype=np.int64)[x], y))
    return tuple(np.concatenate([f[k] for f in found]) for k in (0, 1))


def _traversed(t: Forest, roots: list[int], queries: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Queries and rows that link, from a root of the forest for each query."""
    size = np.array([len(q) for q in queries], dtype=np.int64)
    stop, width = np.cumsum(size), len(t.every) + 1
    flat = np.concatenate(queries)
    # the number of an n-gram, or of the next larger one of the forest: only equal ones are hits
    number = np.searchsorted(t.every, flat)
    known = t.every[np.minimum(number, len(t.every) - 1)] == flat
    of = np.repeat(np.arange(len(queries)), size)
    asks = of[known] * width + number[known]
    cut_known = np.concatenate([[0], np.cumsum(known)])  # known n-grams before a place of ``flat``
    order_of = of * width + number
    q, v = np.arange(len(queries)), np.array(roots, dtype=np.int64)
    at, overlap = np.zeros(len(q), dtype=np.int64), np.zeros(len(q), dtype=np.int64)
    found_q, found_row = [], []
    while len(q):
        take = np.minimum(t.end[v] - at, STEP)
        base = t.start[t.owner[v]] + at
        sought = np.repeat(q, take) * width + t.token[_ranges(base, take)]
        place = np.searchsorted(asks, sought)
        hit = asks[np.minimum(place, len(asks) - 1)] == sought if len(asks) else np.zeros(len(sought), dtype=bool)
        total = np.concatenate([[0], np.cumsum(hit)])
        cut = np.cumsum(take)
        overlap = overlap + total[cut] - total[cut - take]
        at = at + take
        # the query's n-grams beyond the last one seen that the forest knows
        after = np.searchsorted(order_of, q * width + t.token[np.maximum(base + take - 1, 0)], side="right")
        left = np.where(at > 0, cut_known[stop[q]] - cut_known[np.minimum(after, stop[q])], cut_known[stop[q]] - cut_known[stop[q] - size[q]])
        need = -(-percent * (size[q] + t.shortest[v]) // (100 + percent))
        alive = overlap + np.minimum(left, t.longest[v] - at) >= need
        q, v, at, overlap = q[alive], v[alive], at[alive], overlap[alive]
        done = at == t.end[v]
        n_leaves = np.where(done, t.leaf_start[v + 1] - t.leaf_start[v], 0)
        leaf = t.leaf_order[_ranges(t.leaf_start[v], n_leaves)]
        lq, lo = np.repeat(q, n_leaves), np.repeat(overlap, n_leaves)
        fine = 100 * lo >= percent * (size[lq] + np.diff(t.start)[leaf] - lo)
        found_q.append(lq[fine])
        found_row.append(np.array(t.row, dtype=np.int64)[leaf[fine]])
        n_below = np.where(done, t.child_start[v + 1] - t.child_start[v], 0)
        below = t.child_order[_ranges(t.child_start[v], n_below)]
        go = ~done
        q, at, overlap = (np.concatenate([x[go], np.repeat(x, n_below)]) for x in (q, at, overlap))
        v = np.concatenate([v[go], below])
    return np.concatenate(found_q), np.concatenate(found_row)


def _joined(size: int, percent: int):
    """Links ``a, b`` (ids) of groups ``g, part``: rows of side 0 with those of side 1 that have another label."""

    def links(held: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(held, ignore_index=True)
        sets = ordered_sets(pdf["text"], size)
        some = np.array([len(s) > 0 for s in sets])
        group = list(zip(pdf["g"], pdf["i"], pdf["j"]))
        side, ids, label = pdf["side"].to_numpy(), pdf["id"].to_numpy(), pdf["label"].to_numpy()
        asks, below = np.flatnonzero(some & (side == 0)), np.flatnonzero(some & (side == 1))
        x, y = trie_join([group[k] for k in below], [sets[k] for k in below],
                         [group[k] for k in asks], [sets[k] for k in asks], percent)
        x, y = asks[x], below[y]
        new = (label[x] != label[y]) & (ids[x] != ids[y])
        a, b = ids[x][new], ids[y][new]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in whole_groups(frames, ["g", "i", "j"]):
            group = pdf.groupby(["g", "i", "j"], sort=False).ngroup().to_numpy()
            cut = np.flatnonzero(np.diff(group)) + 1
            for part in np.split(np.arange(len(pdf)), cut):
                rows = pdf.iloc[part]
                held.append(rows)
                n += int(rows["text"].str.len().sum()) // 6
                if n >= BATCH:
                    yield links(held)
                    held, n = [], 0
        if held:
            yield links(held)

    return run


def _links(rows: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``rows``: ``g, i, j, side, c, label``. A group's texts meet once, in one task."""
    # written first, so that its size is known: few rows are sent to the texts, and the texts stay where they are
    full = stored(rows, "ngram-groups").join(texts, "c").select("g", "i", "j", "side", "label", "id", "text")
    dealt = full.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "side", "id")
    return dealt.mapInPandas(_joined(size, percent), "a long, b long").distinct()


def parity(s: np.ndarray) -> bytes:
    """A set folded into a bitmap in which every n-gram flips one bit: the XOR of two has no more bits than the sets' difference."""
    bits = min(MOST_BITS, max(64, 1 << (2 * len(s) - 1).bit_length()))
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _same_length(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, folded to the shortest one's length."""
    shortest = min(map(len, bitmaps))
    out = []
    for b in bitmaps:
        v = np.frombuffer(b, dtype=np.uint8)
        while len(v) > shortest:
            v = v[:len(v) // 2] ^ v[len(v) // 2:]
        out.append(v)
    return np.stack(out).view(np.uint64)


def folded(bitmap: bytes) -> bytes:
    """Half of a bitmap (eight bytes at least): XORs of such rule less out, and never a link.

    A bit or more is left for every n-gram. With half a bit the XOR of sets that
    share nothing has about as many bits as linked ones may have.
    """
    return _same_length([bitmap, bytes(max(8, len(bitmap) // 2))])[0].tobytes()


def _marks(texts: DataFrame, size: int) -> DataFrame:
    """``c, n, bits, few``: size, bitmap and folded bitmap of every set."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at:at + 256]
                sets = ordered_sets(part["text"], size)
                rows = [(c, len(s), parity(s)) for c, s in zip(part["c"], sets) if len(s)]
                yield pd.DataFrame([(*r, folded(r[2])) for r in rows], columns=["c", "n", "bits", "few"])

    return stored(texts.select("c", "text").mapInPandas(run, "c long, n long, bits binary, few binary").distinct(), "ngram-marks")


def _possible(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` (``hub, c`` and others) whose bitmaps do not rule a link out."""
    m = lambda a: marks.select(F.col("c").alias(f"{a}_c"), F.col("n").alias(f"{a}_n"), F.col("bits").alias(f"{a}_bits"))
    both = pairs.join(m("x"), F.col("hub") == F.col("x_c")).join(m("y"), F.col("c") == F.col("y_c"))
    # sizes rule out first, in the JVM
    names = pairs.columns
    both = both.where(100 * F.least("x_n", "y_n") >= percent * F.greatest("x_n", "y_n"))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            most = (pdf["x_n"] + pdf["y_n"]) * (100 - percent) // (100 + percent)
            far = [int(np.bitwise_count(np.bitwise_xor(*_same_length([x, y]))).sum()) for x, y in zip(pdf["x_bits"], pdf["y_bits"])]
            yield pdf.loc[np.array(far, dtype=np.int64) <= most.to_numpy(), names]

    return both.mapInPandas(run, pairs.schema).distinct()


def _stars(pairs: DataFrame) -> DataFrame:
    """Groups of a hub and up to ``STAR`` or so of its members, from ``hub, c`` and their labels."""
    n = pairs.groupBy("hub").agg(F.ceil(F.count("*") / STAR).alias("parts"), F.first("hub_label").alias("label"))
    i = F.pmod(F.xxhash64("c"), F.col("parts"))
    zero = F.lit(0).cast("long")
    members = pairs.join(n.select("hub", "parts"), "hub").select(
        F.col("hub").alias("g"), i.alias("i"), zero.alias("j"), F.lit(1).alias("side"), "c", "label")
    hubs = n.select(F.col("hub").alias("g"), F.explode(F.sequence(zero, F.col("parts") - 1)).alias("i"), zero.alias("j"),
                    F.lit(0).alias("side"), F.col("hub").alias("c"), "label")
    return members.unionByName(hubs)


def _block_pairs(percent: int, forest: bool):
    """Pairs of a block that bitmaps and labels leave; a spanning forest of their labels, or all."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys = ["g", "i", "j"]
        for pdf in whole_groups(frames, keys):
            for _, block in pdf.groupby(keys, sort=False):
                side, c, label, n = (block[k].to_numpy() for k in ("side", "c", "label", "n"))
                bits = _same_length(block["bits"].tolist())
                x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                step = max(1, SLICE // (max(len(y), 1) * bits.shape[1]))
                root: dict[int, int] = {}
                for at in range(0, len(x), step):
                    part = x[at:at + step]
                    far = np.bitwise_count(bits[part][:, None] ^ bits[y][None]).sum(axis=2, dtype=np.int64)
                    fine = far <= (n[part][:, None] + n[y][None]) * (100 - percent) // (100 + percent)
                    i, j = np.nonzero(fine & (label[part][:, None] != label[y][None]))
                    if forest:
                        order = np.argsort(far[i, j], kind="stable")
                        i, j = i[order], j[order]
                        joins = _joining(label[part[i]], label[y[j]], root)
                        i, j = i[joins], j[joins]
                    if len(i):
                        a, b = c[part[i]], c[y[j]]
                        yield pd.DataFrame({"hub": np.minimum(a, b), "c": np.maximum(a, b)})

    return run


def _joining(a: np.ndarray, b: np.ndarray, root: dict[int, int]) -> list[int]:
    """Numbers of the pairs that join two trees of ``root``, which grows by them."""

    def top(v: int) -> int:
        while v in root:
            v = root[v]
        return v

    out = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append(k)
    return out


def _across(members: DataFrame, marks: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Possible pairs ``hub, c`` of the keys ``key, c, label`` that hold several labels.

    Only the members outside a key's largest label look for partners among all
    its members, in blocks of ``BLOCK`` by ``BLOCK`` folded bitmaps; the whole ones
    then look at what is left.
    """
    zero = F.lit(0).cast("long")
    sizes = members.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("n")).where("main.n < n").select(
        F.col("key").alias("g"), F.col("main.label").alias("main"), F.ceil(F.col("n") / BLOCK).alias("parts"),
        F.ceil((F.col("n") - F.col("main.n")) / BLOCK).alias("other_parts"))
    m = members.join(sizes, F.col("key") == F.col("g"))
    upto = lambda n: F.sequence(zero, F.col(n) - 1)
    part = lambda n: F.pmod(F.xxhash64("c"), F.col(n))
    below = F.transform(upto("other_parts"), lambda i: F.struct(i.alias("i"), part("parts").alias("j"), F.lit(1).alias("side")))
    asks = F.transform(upto("parts"), lambda j: F.struct(part("other_parts").alias("i"), j.alias("j"), F.lit(0).alias("side")))
    at = F.explode(F.when(F.col("label") != F.col("main"), F.concat(below, asks)).otherwise(below))
    rows = m.withColumn("at", at).select("g", "at.i", "at.j", "at.side", "c", "label").join(
        marks.select("c", "n", F.col("few").alias("bits")).distinct(), "c")
    dealt = rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    found = dealt.mapInPandas(_block_pairs(percent, forest), "hub long, c long").distinct()
    return _possible(found, marks, percent)


def _texts(docs: DataFrame, nodes: DataFrame, repeated: bool) -> DataFrame:
    """``c, id, text`` of the classes in ``nodes``; of an id with several texts all of them."""
    own = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("text is not null")
    out = own.join(nodes.select("c", F.col("first").alias("id")), "id").select("c", "id", "text")
    if repeated:
        out = out.groupBy("c", "id", F.xxhash64("text"), F.length("text")).agg(F.min("text").alias("text"))
    return stored(out.select("c", "id", "text"), "ngram-texts")


def _labelled(nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``c, label``: the component of a class; classes that share a tag have a label of their own."""
    if labels is not None:
        nodes = nodes.join(labels, F.col("first") == F.col("id"), "left").withColumn("first", F.coalesce("component", "first"))
    low, high = F.min("first"), F.max("first")
    return nodes.groupBy("c").agg(F.when(low == high, low).otherwise(-F.lit(2**62) - F.col("c")).alias("label"))


def _open(members: DataFrame) -> DataFrame:
    """The rows of keys that hold several labels, with the best connected member as ``hub, hub_label``."""
    hub = F.max(F.struct("degree", "c", "label")).alias("h")
    keys = members.groupBy("key").agg(hub, F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return members.join(keys.select("key", F.col("h.c").alias("hub"), F.col("h.label").alias("hub_label")), "key")


def _all_links(members: DataFrame, nodes: DataFrame, texts: DataFrame, links: DataFrame, size: int, percent: int) -> DataFrame:
    """Labels ``id, component`` once every pair of sets that share a key is linked, ruled out, or in one component."""
    marks = _marks(texts, size)
    degree = members.groupBy("c").agg(F.sum("n").alias("degree"))
    members = stored(members.join(degree, "c").select("key", "c", "degree"), "ngram-degrees")
    # the best connected member of any of a set's keys
    first = _open(members.join(_labelled(nodes, None), "c")).where("c <> hub")
    best = F.max(F.struct("hub", "hub_label")).alias("h")
    first = first.groupBy("c", "label").agg(best).select("c", "label", F.col("h.hub").alias("hub"), F.col("h.hub_label").alias("hub_label"))
    first = stored(_possible(first, marks, percent), "ngram-first")
    tested = first.select("hub", "c")
    links = stored(links.union(_links(_stars(first), texts, size, percent)), "ngram-links")
    labels = stored(components(links), "ngram-labels")
    # the hubs of all keys that are still open
    members = stored(_open(members.join(_labelled(nodes, labels), "c")), "ngram-open")
    again = members.where("label <> hub_label").select("hub", "hub_label", "c", "label").distinct()
    again = stored(_possible(again.join(tested, ["hub", "c"], "left_anti"), marks, percent), "ngram-second")
    tested = tested.union(again.select("hub", "c"))
    if not again.isEmpty():
        links = stored(links.union(_links(_stars(again), texts, size, percent)), "ngram-links")
        labels = stored(components(links), "ngram-labels")
    # the hubs are done: what the other members hold of several components is compared in blocks of bitmaps
    members = members.where("c <> hub").select("key", "c")
    for forest in (True, False):
        rest = _across(members.join(_labelled(nodes, labels), "c"), marks, percent, forest)
        both = tested.union(tested.select(F.col("c").alias("hub"), F.col("hub").alias("c")))
        rest = stored(rest.join(both, ["hub", "c"], "left_anti").withColumns({"hub_label": F.lit(0), "label": F.lit(1)}), "ngram-rest")
        if rest.isEmpty():
            break
        tested = tested.union(rest.select("hub", "c"))
        links = stored(links.union(_links(_stars(rest), texts, size, percent)), "ngram-links")
        labels = stored(components(links), "ngram-labels")
    return labels


def jaccard_components(docs: DataFrame, size: int = 4, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` (integer ids)."""
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    # about 0.07 keys a character; ranges follow the size of the table
    chars = narrow.agg(F.sum(F.length("text"))).first()[0] or 0
    tasks = max(parallelism(spark), int(chars * 0.07 / RANGE) + 1)
    packed = spread(narrow).mapInPandas(_packed_keys(size, percent, 2 * tasks), _PACKED)
    entries = packed.repartition(tasks, "r", "kind").sortWithinPartitions("r", "kind").mapInPandas(_repeated, _ENTRIES)
    entries = stored(entries, "ngram-entries")
    sets = entries.where("kind = 2").select("id", "c", "n_shingles", "fp")
    known = sets.where("fp is not null and id is not null")
    classes = stored(known.groupBy("fp").agg(F.min("c").alias("c"), F.min("id").alias("first")), "ngram-classes")
    shared = entries.where("kind < 2").select("key", "c").distinct()
    counts = shared.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(shared.join(counts, "key"), "ngram-members")
    nodes = stored(members.select("c").distinct().join(classes, "c").select("c", "first").distinct(), "ngram-nodes")
    # an id with several texts links their classes
    again = known.groupBy("id").agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high")).where("n > 1")
    again = stored(again, "ngram-repeats")
    links = known.join(again.where("low < high").select("id"), "id").join(classes.select("fp", "first"), "fp").where(
        "id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    texts = _texts(docs, nodes, not again.isEmpty())
    labels = _all_links(members, nodes, texts, links, size, percent)
    found = known.join(classes.select("fp", "first"), "fp").join(
        labels.withColumnRenamed("id", "leaf"), F.col("first") == F.col("leaf"), "left").groupBy("id").agg(
        F.min(F.coalesce("component", "first")).alias("component")).select(F.col("id").alias("own"), "component")
    return sets.join(found, F.col("id") == F.col("own"), "left").select(
        F.col("id").alias("doc_id"), "n_shingles", F.coalesce("component", "id").alias("component_id"))


def op11_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(load(spark, sf_dir, "documents"))


#: All pairs of documents that share an n-gram, tested, and their components.
ORACLE = """
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as s from w),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all),
e as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 85 * (x.n + y.n - i)),
u as (select a, b from e union all select b, a from e),
r as (select doc_id as id, doc_id as c from documents union select u.b, r.c from r join u on u.a = r.id where r.c < u.b),
m as (select id, min(c) as c from r group by id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.c as component_id
from documents d left join n using (doc_id) join m on m.id = d.doc_id
"""
