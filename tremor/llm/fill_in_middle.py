"""Fill-in-the-middle: documents cut at line ends and rearranged, the cuts looked up in a learned rank index.

A document is its lines (`[^\\n]*\\n|[^\\n]+`); a cut is given as a rank, the number of lines before it.  The
offsets of all line ends of a slice of documents are one sorted array, kept as a piecewise-linear learned index:
segments of ranks with a base and a slope each, whose prediction of every offset they hold is off by at most
`ERROR`, and the residuals, one byte a rank.  Segments start as whole documents and are halved, all at once, while
they miss the bound, so evenly long lines need few segments and any others still meet it (a segment of two ranks
is exact).  A cut is predicted from its segment and then corrected by its residual, which is exact.

Draws come from the sha256 of seed and id alone: the same under any partitioning, retry or engine.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from tremor.llm.common import appended, slices, with_fields, without

#: Largest miss of a segment's prediction, in code points: residuals fit a signed byte.
ERROR = 127
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass
class RankIndex:
    """Offset by rank: linear segments of bounded error, and every rank's residual."""

    first: np.ndarray  # first rank of every segment
    base: np.ndarray
    slope: np.ndarray
    residual: np.ndarray

    @classmethod
    def fit(cls, offsets: np.ndarray, starts: np.ndarray, error: int = ERROR) -> RankIndex:
        """Segments over sorted `offsets`, none across one of `starts` (the ranks where a document begins)."""
        n = len(offsets)
        open_, done = np.asarray(starts, np.int64), []
        ends = np.append(open_[1:], n)
        while len(open_):
            size = ends - open_
            base = offsets[open_]
            slope = (offsets[ends - 1] - base) / np.maximum(size - 1, 1)
            # the ranks of the open segments, one behind the other
            at = np.cumsum(size) - size
            own = np.repeat(np.arange(len(open_)), size)
            step = np.arange(len(own)) - at[own]
            miss = np.abs(offsets[open_[own] + step] - (base[own] + np.rint(slope[own] * step).astype(np.int64)))
            good = np.maximum.reduceat(miss, at) <= error
            done.append((open_[good], base[good], slope[good]))
            left, right = open_[~good], ends[~good]
            middle = (left + right) // 2
            open_, ends = np.concatenate([left, middle]), np.concatenate([middle, right])
        first, base, slope = (np.concatenate(c) for c in zip(*done, strict=True))
        order = np.argsort(first)
        index = cls(first[order], base[order], slope[order], np.zeros(n, np.int16))
        index.residual = (offsets - index.predict(np.arange(n))).astype(np.int8 if error <= 127 else np.int64)
        return index

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.first, ranks, "right") - 1
        return self.base[s] + np.rint(self.slope[s] * (ranks - self.first[s])).astype(np.int64)

    def offset(self, ranks: np.ndarray) -> np.ndarray:
        return self.predict(ranks) + self.residual[ranks]


def boundaries(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets (code points, in the joined texts) of every document's start and line ends, the rank of every
    document's start and its number of lines."""
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(sizes) - sizes
    ends = np.flatnonzero(chars == 10) + 1
    # a last line without its newline ends with the text
    loose = np.array([bool(t) and t[-1] != "\n" for t in texts], bool)
    ends = np.sort(np.concatenate([ends, (begin + sizes)[loose]]))
    lines = np.searchsorted(ends, begin + sizes, "right") - np.searchsorted(ends, begin, "right")
    starts = np.cumsum(lines + 1) - (lines + 1)
    offsets = np.empty(len(ends) + len(texts), np.int64)
    is_start = np.zeros(len(offsets), bool)
    is_start[starts] = True
    offsets[starts], offsets[~is_start] = begin, ends
    return offsets, starts, lines


def draws(key, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from seed and id; a null id draws as an empty text."""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def rearranged(texts: list[str], keys: list, seed: int, rate: int, spm: int) -> list[tuple]:
    """(n, form, prefix_chars, middle_chars, output) of every text."""
    offsets, starts, lines = boundaries(texts)
    drawn = np.array([draws(k, seed) for k in keys], np.int64).reshape(-1, 4)
    picks = np.sort(drawn[:, :2] % (lines[:, None] + 1), axis=1)
    cuts = (RankIndex.fit(offsets, starts).offset(starts[:, None] + picks) - offsets[starts][:, None]).tolist() if texts else []
    out = []
    for t, n, (a, b), (_, _, h3, h4) in zip(texts, lines.tolist(), cuts, drawn.tolist(), strict=True):
        if not t or h3 % 100 >= rate or PREFIX in t or SUFFIX in t or MIDDLE in t:
            out.append((n, PLAIN, None, None, t))
        elif h4 % 100 < spm:
            out.append((n, SPM, a, b - a, "".join([SUFFIX, t[b:], PREFIX, t[:a], MIDDLE, t[a:b]])))
        else:
            out.append((n, PSM, a, b - a, "".join([PREFIX, t[:a], SUFFIX, t[b:], MIDDLE, t[a:b]])))
    return out


ADDED = {"n": LongType(), "form": StringType(), "prefix_chars": LongType(), "middle_chars": LongType(), "output": StringType()}


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """`docs` with n (lines), form (plain, psm or spm), prefix_chars, middle_chars and output, the rearranged text.

    `rate` percent of the documents are rearranged, `spm` percent of these suffix first.  Null and empty texts are
    plain, with output '' and no lines; so is a text that holds a sentinel.  Rows of one id draw alike, a null id
    draws as an empty one.  Columns named like the new ones are replaced (not key or text); nothing is shuffled.
    """
    if {key.lower(), text.lower()} & set(ADDED):
        raise ValueError("key and text must not be named like an added column")
    docs = without(docs, *ADDED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text):
            keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
            columns = zip(*rearranged(texts, keys, seed, rate, spm), strict=True)
            yield appended(batch, [pa.array(c, pa.string() if t == StringType() else pa.int64())
                                   for c, t in zip(columns, ADDED.values(), strict=True)], list(ADDED))

    return docs.mapInArrow(run, with_fields(docs, *[StructField(n, t) for n, t in ADDED.items()]))


def restored(output: Column, form: Column) -> Column:
    """The text before `fill_in_middle`, from its output and form alone (a text holds no sentinel unless plain)."""
    p = F.split(output, "|".join(re.escape(s) for s in (PREFIX, SUFFIX, MIDDLE)), -1)
    return (F.when(form == PSM, F.concat(p[1], p[3], p[2])).when(form == SPM, F.concat(p[2], p[3], p[1])).otherwise(output))
