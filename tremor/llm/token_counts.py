"""Unigram token counts by trie-shared dynamic programming.

The pieces and scores of a SentencePiece file are taken as a unigram model: a text's tokens are those of the
segmentation with the greatest sum of scores (of equal sums, the one whose last piece begins first, as the
library decides).  Texts are cut into pre-tokens at their spaces, which no piece crosses.  The distinct pre-tokens
of a slice form a trie, walked depth first: the forward score and token count of a prefix are computed once and
shared by every pre-token below it; a terminal node's count is the pre-token's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField

from tremor.llm.common import appended, slices, with_fields, without
from tremor.llm.piece_codec import _SPACED
from tremor.llm.pieces import NORMAL, SPACE, Pieces, load_pieces

MEMORY_WORDS = 200_000
MEMORY_WORD_CHARS = 48


class UnigramCounter:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.score = {t: pieces.scores[i] for i, t in enumerate(pieces.texts) if pieces.types[i] == NORMAL}
        if any(SPACE in t.lstrip(SPACE) for t in self.score):
            raise ValueError("a piece joins a character to a following space")
        self.longest = max(map(len, self.score), default=1)
        #: a character that no piece is alone becomes its bytes, at this score
        self.unknown = min(self.score.values(), default=0.0) - 10.0
        self.memory: dict[str, int] = {}

    def terminals(self, words: list[str]) -> list[int]:
        """Token counts of distinct words, given in sorted order."""
        score, count, out, last = [0.0], [0], [], ""
        pieces, longest, unknown = self.score, self.longest, self.unknown
        for word in words:
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del score[shared + 1:], count[shared + 1:]
            for end in range(shared + 1, len(word) + 1):
                best, tokens = -np.inf, 0
                for start in range(max(0, end - longest), end):
                    own = pieces.get(word[start:end])
                    if own is not None and score[start] + own > best:
                        best, tokens = score[start] + own, count[start] + 1
                if word[end - 1] not in pieces and score[end - 1] + unknown > best:
                    best, tokens = score[end - 1] + unknown, count[end - 1] + len(word[end - 1].encode("utf-8"))
                score.append(best)
                count.append(tokens)
            out.append(count[len(word)])
            last = word
        return out

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of whole texts."""
        per_text = []
        for t in texts:
            if "  " in t or SPACE in t or t[:1] == " " or t[-1:] == " ":
                per_text.append(_SPACED.findall(SPACE + t.replace(" ", SPACE)))
            else:
                per_text.append([SPACE + w for w in t.split(" ")] if t else [])
        known = self.memory
        if len(known) > MEMORY_WORDS:
            known.clear()
        new = sorted({w for words in per_text for w in words}.difference(known))
        found = dict(zip(new, self.terminals(new), strict=True))
        known.update((w, n) for w, n in found.items() if len(w) <= MEMORY_WORD_CHARS)
        found = {w: n for w, n in found.items() if len(w) > MEMORY_WORD_CHARS}
        if found:
            return np.array([sum(found[w] if w in found else known[w] for w in words) for words in per_text], np.int64)
        get = known.__getitem__
        return np.array([sum(map(get, words)) for words in per_text], np.int64)


_counters: dict[Pieces, UnigramCounter] = {}


def count_tokens(docs: DataFrame, model_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """`docs` with `out`, the token count of each whole text (null or empty: 0).

    A column named like `out` is replaced; empty tables and repeated rows are fine; nothing is shuffled.
    """
    docs = without(docs, out) if out != text else docs
    model = docs.sparkSession.sparkContext.broadcast(load_pieces(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.value not in _counters:
            _counters[model.value] = UnigramCounter(model.value)
        for batch, texts in slices(batches, text):
            yield appended(batch, [pa.array(_counters[model.value].counts(texts))], [out])

    return docs.mapInArrow(run, with_fields(docs, StructField(out, LongType())))
