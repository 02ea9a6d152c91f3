"""Benchmark decontamination: CGK random walks, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and items are sequences of words (lower case, without punctuation around them).  A text is contaminated by
an item of n words if some stretch of it is within floor(max_edits * n) word edits of the item.

The CGK embedding of a sequence walks over it with 3n steps, staying on a word or moving on by a random bit of
(step, word); sequences within few edits come out at few differing places.  Bit sampling takes a few places of
each of many walks as a key; a window of n words that shares a key with an item of n words is a candidate, and
the exact edit distance (free ends within the bound) decides.  Every start in every text is considered; before
the walk an exact count removes windows that cannot be within the bound: where an occurrence begins, k edits leave
at least n - 1 - 2k of the item's word pairs inside the window (a replaced or deleted word costs two pairs, an
inserted one a pair and the pair it pushes out at the end).

Items come to the executors in blocks of bounded size, each one pass over the texts without a shuffle of text.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import fresh, slices, written

MAX_EDITS = 0.2
#: Least words of an item that is looked for (a bound of less than one edit is an exact match of its words).
MIN_WORDS = 1
WALKS, SAMPLED = 40, 2
#: Items per block, and their words together; the block is what an executor holds.
BLOCK_ITEMS, BLOCK_WORDS = 4096, 1 << 20
MEMORY_WORDS = 200_000
_EDGE = string.punctuation + "“”„‘’«»¿¡…–—"
_HIT = "doc_id long, item_id long, start long, n_words long, edits long"


def words_of(text: str | None) -> list[str]:
    return [w for w in (r.strip(_EDGE) for r in (text or "").lower().split()) if w]


class Vocabulary(dict):
    """Raw word to its number in the items (0: in none, -1: only punctuation), remembered up to a bound."""

    def __init__(self, index: dict[str, int]):
        super().__init__()
        self.index = index

    def __missing__(self, raw: str) -> int:
        w = raw.strip(_EDGE)
        i = self.index.get(w, 0) if w else -1
        if len(self) < MEMORY_WORDS:
            self[raw] = i
        return i


def edits_within(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int]:
    """Least edits from `item` to any part of `stretch`, and where that part begins."""
    m = len(stretch)
    cost, begin, at = np.zeros(m + 1, np.int64), np.arange(m + 1), np.arange(m + 1)
    for i, w in enumerate(item.tolist(), 1):
        step = np.empty(m + 1, np.int64)
        step[0], origin = i, begin.copy()
        replace, delete = cost[:-1] + (stretch != w), cost[1:] + 1
        step[1:] = np.minimum(replace, delete)
        origin[1:] = np.where(replace <= delete, begin[:-1], begin[1:])
        # insertions run along the row: the best of step[j] + (distance from j)
        from_left = np.minimum.accumulate(step - at)
        source = np.maximum.accumulate(np.where(step - at == from_left, at, 0))
        cost, begin = from_left + at, origin[source]
    best = int(np.argmin(cost))
    return int(cost[best]), int(begin[best])


class Block:
    """Lookup tables of some items."""

    def __init__(self, items: list[tuple[int, list[str]]], max_edits: float, walks: int, sampled: int):
        self.index = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        self.size = len(self.index) + 1
        self.ids = [i for i, _ in items]
        self.items = [np.array([self.index[w] for w in ws], np.int64) for _, ws in items]
        self.lens = np.array([len(x) for x in self.items], np.int64)
        self.bound = np.floor(self.lens * max_edits + 1e-9).astype(np.int64)
        self.max_edits, self.walks, self.sampled = max_edits, walks, sampled
        self.lengths = np.unique(self.lens)  # at most 63 different ones
        bit = {int(n): 1 << i for i, n in enumerate(self.lengths)}
        pairs: dict[int, int] = {}
        for x in self.items:
            for k in (x[:-1] * self.size + x[1:]).tolist():
                pairs[k] = pairs.get(k, 0) | bit[len(x)]
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_lengths = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        need = self.lengths - 1 - 2 * np.floor(self.lengths * max_edits + 1e-9).astype(np.int64)
        self.need = np.maximum(need, 1)
        rng = np.random.default_rng(77)
        longest = int(self.lengths[-1])
        # one random bit per walk, step and word, by hashing; steps beyond are never asked
        self.salt = rng.integers(1, 1 << 62, (walks, 3 * longest), dtype=np.int64) | 1
        self.places = rng.random((walks, sampled))
        self.weights = rng.integers(1, 1 << 62, (walks, sampled + 1), dtype=np.int64) | 1
        flat = np.concatenate(self.items)
        starts = np.cumsum(self.lens) - self.lens
        keys = self.keys(flat, starts, self.lens)
        self.item_keys = [np.sort(k) for k in keys]
        self.item_order = [np.argsort(k, kind="stable") for k in keys]

    def keys(self, flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """LSH keys (walks x windows) of the windows flat[start : start + len].

        All walks of all windows of one length go step by step together; a walk leaves once it has passed its last
        sampled place (the tail of a walk is mostly padding and is not sampled).
        """
        out = np.zeros((self.walks, len(starts)), np.int64)
        for n in np.unique(lens).tolist():
            wanted = np.floor(self.places * (3 * n) / 2).astype(np.int64)
            order = np.argsort(-wanted.max(axis=1), kind="stable")  # the longest walks first
            wanted, salt, weights = wanted[order], self.salt[order], self.weights[order]
            last = wanted.max(axis=1)
            active = [int((last >= j).sum()) for j in range(int(last[0]) + 1)]
            width = len(active) + 1
            which = np.flatnonzero(lens == n)
            for part in np.array_split(which, -(-len(which) // 4096)):
                at = starts[part][:, None] + np.arange(width)
                words = np.where(np.arange(width) < n, flat[np.minimum(at, len(flat) - 1)] + 1, 0).ravel()
                spot = np.tile(np.arange(len(part)) * width, (self.walks, 1))
                key = np.repeat(n * weights[:, self.sampled], len(part)).reshape(self.walks, len(part))
                for j, a in enumerate(active):
                    word = words.take(spot[:a])
                    for r, s in zip(*np.nonzero(wanted[:a] == j), strict=True):
                        key[r] += (word[r] + 1) * weights[r, s]
                    word += 7
                    word *= salt[:a, j][:, None]
                    word >>= 40
                    word &= 1
                    spot[:a] += word
                out[order[:, None], part[None, :]] = key
        return out

    def windows(self, flat: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) of the windows that hold enough of the items' word pairs."""
        starts, lens = [], []
        if len(flat) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = np.flatnonzero((flat[:-1] > 0) & (flat[1:] > 0) & (doc[:-1] == doc[1:]))
        wanted = flat[known] * self.size + flat[known + 1]
        at = np.searchsorted(self.pair_keys, wanted)
        at[at == len(self.pair_keys)] = 0
        hit = self.pair_keys[at] == wanted
        known, masks = known[hit], self.pair_lengths[at[hit]]
        if not len(known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, n in enumerate(self.lengths.tolist()):
            if n == 1:
                continue
            p = known[(masks >> i) & 1 == 1]
            need = int(self.need[i])
            if len(p) < need:
                continue
            # the need-th pair from each pair on must lie inside n words; windows then start up to there
            last = p[need - 1:]
            first = p[:len(last)]
            close = last - first <= n - 2
            if not close.any():
                continue
            lo, hi = np.maximum(last[close] - (n - 2), 0), first[close]
            covered = np.zeros(len(flat) + 1, np.int64)
            np.add.at(covered, lo, 1)
            np.add.at(covered, hi + 1, -1)
            s = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
            starts.append(s)
            lens.append(np.full(len(s), n))
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(lens)

    def hits(self, flat: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document number, item id, start, item words, edits), the best place per document and item."""
        starts, lens = self.windows(flat, doc)
        if not len(starts) and self.lengths[0] > 1:
            return []
        # windows past a document's end stop there
        ends = np.searchsorted(doc, doc[starts], side="right")
        begins = np.searchsorted(doc, doc[starts], side="left")
        padded = np.concatenate([flat, np.full(int(self.lengths[-1]) + 1, -2)])
        pairs: set[tuple[int, int]] = set()
        for a in range(0, len(starts), 50_000):
            part, n = starts[a:a + 50_000], lens[a:a + 50_000]
            for w, keys in enumerate(self.keys(padded, part, n)):
                lo, hi = np.searchsorted(self.item_keys[w], keys, "left"), np.searchsorted(self.item_keys[w], keys, "right")
                for i in np.flatnonzero(hi > lo).tolist():
                    pairs.update((a + i, int(x)) for x in self.item_order[w][lo[i]:hi[i]] if self.lens[x] == n[i])
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for x in np.flatnonzero(self.lens == 1).tolist():  # an item of one word is looked up
            spots = np.flatnonzero(flat == self.items[x][0])
            own, at = np.unique(doc[spots], return_index=True)
            best.update(((d, x), (0, s)) for d, s in zip(own.tolist(), spots[at].tolist(), strict=True))
        found = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        for x in np.unique(found[:, 1]).tolist():
            k, n, item = int(self.bound[x]), int(self.lens[x]), self.items[x]
            which = found[found[:, 1] == x, 0]
            # windows that are the item: nothing later in their document can be better
            same = (starts[which] + n <= ends[which]) & (padded[starts[which][:, None] + np.arange(n)] == item).all(axis=1)
            own, at = np.unique(doc[starts[which[same]]], return_index=True)
            best.update(((d, x), (0, s)) for d, s in zip(own.tolist(), starts[which[same]][at].tolist(), strict=True))
            which = which[~np.isin(doc[starts[which]], own)]
            own = np.unique(item)
            inside = np.zeros(self.size, bool)
            inside[own] = True
            lo, hi = np.maximum(begins[which], starts[which] - k), np.minimum(ends[which], starts[which] + n + 2 * k)
            for a, z in zip(lo.tolist(), hi.tolist(), strict=True):
                d = int(doc[a])
                if best.get((d, x), (1, 0))[0] == 0:
                    continue
                # at least n - k of the item's words stand in the stretch, and at most k different ones do not
                if inside[flat[a:z]].sum() < n - k or len(own) - len(np.intersect1d(own, flat[a:z])) > k:
                    continue
                edits, at = edits_within(item, flat[a:z])
                if edits <= k and (edits, a + at) < best.get((d, x), (k + 1, 0)):
                    best[d, x] = (edits, a + at)
        first = {d: int(np.searchsorted(doc, d)) for d, _ in best}
        return [(d, self.ids[x], at - first[d], int(self.lens[x]), e) for (d, x), (e, at) in best.items()]


def _blocks(items: DataFrame, key: str, text: str, min_words: int, max_edits: float, walks: int, sampled: int) -> Iterator[Block]:
    """Items in blocks, shortest first; only one block at a time is held."""
    n = F.size(F.split(F.trim(F.col("text")), r"\s+"))
    rows = (items.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).filter("id is not null and text is not null")
            .orderBy(n, "id", "text").toLocalIterator())
    held: list[tuple[int, list[str]]] = []
    total, lengths = 0, set()
    for r in rows:
        w = words_of(r["text"])
        if len(w) < min_words:
            continue
        if held and (len(held) >= BLOCK_ITEMS or total + len(w) > BLOCK_WORDS or len(lengths | {len(w)}) > 62):
            yield Block(held, max_edits, walks, sampled)
            held, total, lengths = [], 0, set()
        held.append((r["id"], w))
        total += len(w)
        lengths.add(len(w))
    if held:
        yield Block(held, max_edits, walks, sampled)


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
                 max_edits: float = MAX_EDITS, min_words: int = MIN_WORDS, walks: int = WALKS, sampled: int = SAMPLED) -> DataFrame:
    """(doc_id, item_id, start, n_words, edits): every document and item it holds, at its best place found.

    `start` counts the text's words.  Null texts hold nothing; rows without a key are reported under a null id;
    rows with equal keys give one row per item, the best.  Items that are null, without id or shorter than
    `min_words` are not looked for; equal items are found each.  Without items or documents there are no rows.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    out = spark.createDataFrame([], _HIT)
    for block in _blocks(items, item_key, item_text, min_words, max_edits, walks, sampled):
        shared = spark.sparkContext.broadcast(block)  # bounded: BLOCK_ITEMS items of BLOCK_WORDS words together

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = Vocabulary(shared.value.index)
            get = known.__getitem__
            for batch, texts in slices(batches, "text", 8 << 20):
                counts, parts = [], []
                for t in texts:
                    x = np.fromiter(map(get, t.lower().split()), np.int64)
                    x = x[x >= 0]
                    parts.append(x)
                    counts.append(len(x))
                flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                hits = shared.value.hits(flat, np.repeat(np.arange(len(counts)), counts))
                ids = batch.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([v[i] if i else ids[v[0]] for v in hits], pa.int64()) for i in range(5)],
                                                 names=["doc_id", "item_id", "start", "n_words", "edits"])

        out = out.union(narrow.mapInArrow(run, _HIT))
    return (out.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "start", "n_words")).alias("b"))
            .select("doc_id", "item_id", "b.start", "b.n_words", "b.edits"))


def without_contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", keep_unkeyed: bool = True) -> DataFrame:
    """`docs` without the contaminated rows, decided row by row: of rows with equal ids only those that hold an item go.

    Rows without an id stay with `keep_unkeyed`; without it they are decided like others.
    """
    (row,) = fresh(docs, "row")
    rows = written(docs.sparkSession, docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    asked = rows.filter(F.col(f"`{key}`").isNotNull()) if keep_unkeyed else rows
    bad = contaminated(asked, items, row, text).select(F.col("doc_id").alias(row)).distinct()
    return rows.join(bad, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
