"""Periodic runs of words by multi-scale minimizers.

A run is a stretch of words with smallest period q, at least `min_words` and `exponent` * q words long, that no
neighbouring word extends keeping period q.  Words are `[^\\x20\\x09-\\x0D]+`.  All runs are found, exactly:

* Periods below `SHORT` by direct lag scans: stretches where words q apart are equal.
* Longer ones by scales k = SHORT, 2 SHORT, ...: a scale looks for periods from k to 2k - 1.  Every k words in
  sequence (a gram) have a hash, doubled up from scale to scale.  Each window of k grams selects its gram of least
  hash; inside a run of period q >= k the windows q apart are equal, so what they select is q apart, too.  Selected
  grams that are equal and from k to 2k - 1 words apart are seeds: the lag at that place is walked to both sides,
  word by word, as far as it holds.
* Grams that lie in a known run with a period of at most k / 3 are never selected.  The others repeat more than
  k / 3 words apart (else they would have such a period and lie in such a run, found at a lower scale), so a selected
  gram has at most five equal ones within 2k words: seeds stay in proportion to the words, never all pairs.  And no
  run is missed: were all its grams of such periods, neighbours would share theirs (Fine and Wilf) and the whole run
  would have it.  One gram of its first period that is not is in a window that fits, as does the window q further.
* A stretch found with a multiple of its smallest period has the same place and length as the run itself and goes.

Hashes only propose: a run is always walked on the words themselves, and equal grams have equal hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tremor.llm.common import appended, fresh, slices, with_fields, without

WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD)
#: Periods from here on are found by minimizers; a power of two above the least length of a run.
SHORT = 32
MIN_WORDS = 24
EXPONENT = 3
RUN = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())])
_MIX = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(2 ** 64 - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 mixed bits of 64 bits (splitmix finisher)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stretches(equal: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and behind-last place of every stretch of at least `least` true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]])))
    a, b = edges[::2], edges[1::2]
    long = b - a >= least
    return a[long], b[long]


def _walk(ids: np.ndarray, at: int, lag: int, low: int, high: int) -> tuple[int, int]:
    """The stretch around `at`, inside ids[low:high], of places whose word equals the one `lag` further."""
    right, step = at, 256
    while right + lag < high:
        stop = min(right + step, high - lag)
        same = ids[right:stop] == ids[right + lag:stop + lag]
        if not same.all():
            right += int(same.argmin())
            break
        right, step = stop, 2 * step
    left, step = at, 256
    while left > low:
        stop = max(left - step, low)
        same = (ids[stop:left] == ids[stop + lag:left + lag])[::-1]
        if not same.all():
            left -= int(same.argmin())
            break
        left, step = stop, 2 * step
    return left, right


def _selected(grams: np.ndarray, usable: np.ndarray, window: int) -> np.ndarray:
    """Places of the least usable gram (the leftmost of equals) of any `window` neighbouring places."""
    n = len(grams)
    bits = np.uint64(max(n, 1).bit_length())
    keys = np.where(usable, (grams >> bits << bits) | np.arange(n, dtype=np.uint64), _NONE)
    blocks = -(-n // window) + 1
    padded = np.full(blocks * window, _NONE)
    padded[:n] = keys
    tiles = padded.reshape(blocks, window)
    ahead = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(tiles, axis=1).ravel()
    least = np.minimum(ahead[:(blocks - 1) * window], behind[window - 1:blocks * window - 1])
    least = least[least != _NONE]
    chosen = np.zeros(n, bool)
    chosen[(least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] = True
    return np.flatnonzero(chosen)


def _seeds(names: np.ndarray, places: np.ndarray, k: int, partners: int) -> np.ndarray:
    """(lag, place) of equal grams from k to 2k - 1 words apart, by lag, then place."""
    order = np.argsort(names[places], kind="stable")
    at, name = places[order], names[places][order]
    found = []
    for t in range(1, partners + 1):
        lag = at[t:] - at[:-t]
        hit = (name[t:] == name[:-t]) & (lag >= k) & (lag < 2 * k)
        found.append(np.column_stack([lag[hit], at[:-t][hit]]))
    seeds = np.concatenate(found)
    return seeds[np.lexsort((seeds[:, 1], seeds[:, 0]))]


def runs_of(ids: np.ndarray, sizes: np.ndarray, min_words: int = MIN_WORDS, exponent: int = EXPONENT) -> np.ndarray:
    """(document, start, length, period) of every run, sorted so, of documents given as numbers for their words,
    one document behind the other."""
    if exponent < 3 or min_words > SHORT:
        raise ValueError(f"runs of exponent 3 or more and of at most {SHORT} words' least length")
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    found: list[np.ndarray] = [np.zeros((0, 4), np.int64)]
    for q in range(1, min(SHORT, len(ids))):
        equal = (ids[q:] == ids[:-q]) & (owner[q:] == owner[:-q])
        a, b = _stretches(equal, max(min_words, exponent * q) - q)
        if len(a):
            found.append(np.column_stack([owner[a], a, b + q - a, np.full(len(a), q)]))
    runs = _smallest(np.concatenate(found))
    k, words, at, where = SHORT // 2, ids, np.arange(len(ids)), begin
    # hashes of grams of one word, doubled up to k words; a gram never reaches over its document's end
    names, size = _mixed((words.astype(np.uint64) + np.uint64(1)) * _MIX), 1
    while True:
        while size < k:
            names = _doubled(names, size)
            size *= 2
        k *= 2
        live = sizes >= exponent * k
        if not live.any():
            break
        if not live.all():  # only documents that can hold a run of this scale go on
            keep = np.repeat(live, sizes)
            names, words, at = names[keep], words[keep], at[keep]
            where, sizes = where[live], sizes[live]
        names = _doubled(names, size)
        size = k
        begin = np.cumsum(sizes) - sizes
        n = len(words)
        left = np.repeat(begin + sizes, sizes) - np.arange(n)
        usable = left >= k
        usable &= ~_inside(runs[runs[:, 3] * 3 <= k], at, k)
        seeds = _seeds(names, _selected(names, usable, k), k, 5)
        runs = _smallest(np.concatenate([runs, _grown(words, seeds, begin, sizes, where, owner, min_words, exponent)]))
    runs[:, 1] -= np.searchsorted(owner, runs[:, 0])
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _doubled(names: np.ndarray, size: int) -> np.ndarray:
    """Hashes of grams of twice `size` words (those that reach over the end mean nothing)."""
    return _mixed(names * _MIX + np.concatenate([names[size:], np.zeros(min(size, len(names)), np.uint64)]))


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Each place and length once, with the smallest period found."""
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1]))]
    again = (runs[1:, 1] == runs[:-1, 1]) & (runs[1:, 2] == runs[:-1, 2])
    return runs[np.concatenate([[True], ~again])] if len(runs) else runs


def _inside(runs: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Whether the gram of k words at each place lies in one of `runs`."""
    if not len(runs):
        return np.zeros(len(at), bool)
    runs = runs[runs[:, 2] >= k]
    first, last = runs[:, 1], runs[:, 1] + runs[:, 2] - k
    depth = np.zeros(len(at) + 1, np.int64)
    np.add.at(depth, np.searchsorted(at, first), 1)
    np.add.at(depth, np.searchsorted(at, last, "right"), -1)
    return np.cumsum(depth[:-1]) > 0


def _grown(words, seeds, begin, sizes, where, owner, min_words: int, exponent: int) -> np.ndarray:
    """Runs around the seeds; a seed inside the stretch just walked with its lag is passed over."""
    out, i, lags, places = [], 0, seeds[:, 0], seeds[:, 1]
    docs = np.searchsorted(begin, places, "right") - 1
    inside = places + lags < begin[docs] + sizes[docs]  # equal grams of two documents are no seed
    lags, places, docs = lags[inside], places[inside], docs[inside]
    while i < len(lags):
        lag, d = int(lags[i]), int(docs[i])
        low = int(begin[d])
        a, b = _walk(words, int(places[i]), lag, low, low + int(sizes[d]))
        if b + lag - a >= max(min_words, exponent * lag):
            start = int(where[d]) + a - low
            out.append((owner[start], start, b + lag - a, lag))
        same = int(np.searchsorted(lags, lag, "right"))
        i += max(1, int(np.searchsorted(places[i:same], b)))
    return np.array(out, np.int64).reshape(-1, 4)


def analysed(texts: list[str], min_words: int, exponent: int) -> tuple[list[int], np.ndarray, list[str]]:
    """Number of words, runs (document, start, length, period) and text without repeats, of every text."""
    split = [_WORD.findall(t) for t in texts]
    known: dict[str, int] = {}
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ids = np.fromiter((known.setdefault(w, len(known)) for words in split for w in words), np.int64, int(sizes.sum()))
    runs = runs_of(ids, sizes, min_words, exponent)
    joined = []
    cut = np.searchsorted(runs[:, 0], np.arange(len(split) + 1))
    for d, words in enumerate(split):
        own = runs[cut[d]:cut[d + 1]]
        if len(own):
            depth = np.zeros(len(words) + 1, np.int64)
            np.add.at(depth, own[:, 1] + own[:, 3], 1)
            np.add.at(depth, own[:, 1] + own[:, 2], -1)
            words = compress(words, (np.cumsum(depth[:-1]) == 0).tolist())
        joined.append(" ".join(words))
    return sizes.tolist(), runs, joined


def find_runs(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS, exponent: int = EXPONENT, n: str = "n_words",
              runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """`docs` with the number of words, all runs (start, length, period; by start, then period) of each whole text,
    and the text without the words that a run holds after its first period, joined by single spaces.

    Null and empty texts have no words, no runs and ''.  Rows are judged one by one, whatever their ids; columns
    named like the new ones are replaced; nothing is shuffled.
    """
    docs = without(docs, *[c for c in (n, runs, collapsed) if c != text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text):
            sizes, found, joined = analysed(texts, min_words, exponent)
            structs = pa.StructArray.from_arrays([pa.array(found[:, c]) for c in (1, 2, 3)], RUN.fieldNames())
            cut = np.searchsorted(found[:, 0], np.arange(len(texts) + 1)).astype(np.int32)
            yield appended(batch, [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(cut), structs), pa.array(joined, pa.string())],
                           [n, runs, collapsed])

    fields = [StructField(n, LongType()), StructField(runs, ArrayType(RUN)), StructField(collapsed, StringType())]
    return docs.mapInArrow(run, with_fields(docs, *fields))


def greatest(runs: Column) -> Column:
    """The run of greatest exact length / period (ties: as sorted); null where there is none."""
    none = F.lit(None).cast(RUN)
    return F.reduce(runs, none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` whose texts of one id in ten end in a repetition: with h = crc32(id as text), h % 10 = 0 and
    g = h // 10, each word i >= a = g % n becomes word a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8).

    Null ids, null texts and texts without words stay as they are.
    """
    def whole(a: Column, b: Column) -> Column:
        return F.floor(a / b).cast("int")  # exact: below 2^32

    names = [f"`{c}`" for c in docs.columns]
    words, size, a, p, g = (F.col(c) for c in fresh(docs, "words", "size", "a", "p", "g"))
    w, s, f, t, k = fresh(docs, "words", "size", "a", "p", "g")
    h = F.crc32(F.col(f"`{key}`").cast("string"))
    x = docs.withColumn(k, F.floor(h / 10))
    x = x.withColumn(w, F.when(h % 10 == 0, F.regexp_extract_all(F.col(f"`{text}`"), F.lit("(" + WORD + ")"), F.lit(1))))
    x = x.withColumn(s, F.size(words)).withColumn(f, F.when(size > 0, g % size).cast("int"))
    x = x.withColumn(t, whole(size - a, 3 + g % 8) + 1)
    turns = whole(size - a, p) + 1
    again = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), turns)), F.lit(1), size - a)
    changed = F.concat_ws(" ", F.slice(words, F.lit(1), a), again)
    return x.withColumn(text, F.when(size > 0, changed).otherwise(F.col(f"`{text}`"))).select(*names)
