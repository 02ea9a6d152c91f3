"""SentencePiece encoding and decoding in vectorised merge rounds.

A text is cut into words at its spaces (no piece of the model joins a character to a following space; checked
when the tables are built), and words inside a word again wherever two neighbouring characters stand together
in no piece: no merge can cross such a place, so the cuts change nothing.  Every distinct word not seen before
by the worker goes through the rounds: flat numpy arrays of symbols, the minimum pair rank per segment, all
leftmost merges of that rank at once over all segments, compaction, until no segment has a pair left.

Equal to the library's one-merge-at-a-time order because a round merges several pairs of one segment only when
the merged piece is `safe`: its rank is unique and no piece that could grow out of it ranks better.  Otherwise
only the segment's leftmost pair is merged in that round.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField

from tremor.llm.common import appended, slices, with_fields, without
from tremor.llm.pieces import BYTE, CONTROL, NORMAL, SPACE, Pieces, load_pieces

NO_PAIR = np.int64(1) << 40
#: Distinct words a worker remembers; past it the memory starts anew (results do not depend on it).
MEMORY_WORDS = 150_000
MEMORY_WORD_CHARS = 48
_SPACED = re.compile(f"{SPACE}+[^{SPACE}]*")


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of `wanted` in the sorted `keys`, and which of them are there."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def _flat_ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated ranges start .. start + len - 1."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lens - starts, lens)


def _one_by_one(err: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (err.end - err.start), err.end


codecs.register_error("tremor.piece", _one_by_one)


class PieceCodec:
    """Encoder and decoder tables of one model; holds the worker's memory of encoded words."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        normal = {t: i for i, t in enumerate(pieces.texts) if pieces.types[i] == NORMAL}
        symbols = dict(normal)
        for t in normal:
            for ch in t:
                symbols.setdefault(ch, len(pieces.texts) + len(symbols))
        self.size = max(symbols.values(), default=0) + 1
        # ranks: 0 is the best score; equal scores share a rank
        order = {s: r for r, s in enumerate(sorted({pieces.scores[i] for i in normal.values()}, reverse=True))}
        rank = {t: order[pieces.scores[i]] for t, i in normal.items()}
        shared = {}
        for r in rank.values():
            shared[r] = shared.get(r, 0) + 1
        unsafe, pairs, inside = set(), {}, set()
        for t, i in normal.items():
            inside.update(zip(t, t[1:], strict=False))
            for k in range(1, len(t)):
                a, b = t[:k], t[k:]
                if a in symbols and b in symbols:
                    pairs[symbols[a] * self.size + symbols[b]] = i
                    unsafe.update(x for x in (a, b) if x in rank and rank[x] >= rank[t])
        if any(b == SPACE and a != SPACE for a, b in inside):
            raise ValueError("a piece joins a character to a following space")
        keys = sorted(pairs)
        self.pair_keys = np.array(keys or [-1], np.int64)
        self.pair_made = np.array([pairs[k] for k in keys] or [0], np.int64)
        by_id = {i: t for t, i in normal.items()}
        self.pair_rank = np.array([rank[by_id[pairs[k]]] for k in keys] or [NO_PAIR], np.int64)
        self.pair_safe = np.array([by_id[pairs[k]] not in unsafe and shared[rank[by_id[pairs[k]]]] == 1 for k in keys] or [False])
        chars = sorted((ord(t), s) for t, s in symbols.items() if len(t) == 1)
        self.char_keys = np.array([c for c, _ in chars] or [-1], np.int64)
        self.char_symbols = np.array([s for _, s in chars] or [0], np.int64)
        self.inside = np.array(sorted((ord(a) << 21) | ord(b) for a, b in inside) or [-1], np.int64)
        self.byte_ids = np.array(pieces.byte_ids, np.int32)
        self.memory: dict[str, bytes] = {}
        # decoding: the bytes of every piece, a space for the space symbol, nothing for controls
        raw = [b"" if k == CONTROL else bytes([int(t[3:5], 16)]) if k == BYTE else " ⁇ ".encode() if k != NORMAL
               else t.replace(SPACE, " ").encode() for t, k in zip(pieces.texts, pieces.types, strict=True)]
        self.out_len = np.array([len(x) for x in raw], np.int64)
        self.out_at = np.cumsum(self.out_len) - self.out_len
        self.out_bytes = np.frombuffer(b"".join(raw), np.uint8)

    # -- encoding ---------------------------------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """The words of a text, each without the space symbol it begins with."""
        if not text:
            return []
        if self.pieces.prefix and "  " not in text and SPACE not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        spaced = text.replace(" ", SPACE)
        if self.pieces.prefix:
            spaced = SPACE + spaced
        elif spaced[0] != SPACE:
            raise ValueError("models without a leading space are not supported")
        return [w[1:] for w in _SPACED.findall(spaced)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian 32-bit) of each word with its leading space symbol, all words together."""
        if not words:
            return []
        joined = SPACE + SPACE.join(words)
        code = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        lens = np.array([len(w) + 1 for w in words], np.int64)
        starts = np.cumsum(lens) - lens
        at, known = _lookup(self.char_keys, code)
        # a character outside every piece is a symbol of its own that joins nothing
        syms = np.where(known, self.char_symbols[at], self.size + code)
        cut = np.ones(len(code), bool)
        if len(code) > 1:
            cut[1:] = ~_lookup(self.inside, (code[:-1] << 21) | code[1:])[1]
        cut[starts] = True
        out_syms, out_count = self._merge(syms, np.flatnonzero(cut))
        # segments in order make words: count symbols per word, then expand unknown characters to bytes
        word_of_segment = np.searchsorted(starts, np.flatnonzero(cut), side="right") - 1
        per_word = np.bincount(word_of_segment, weights=out_count, minlength=len(words)).astype(np.int64)
        ids, per_symbol = self._to_ids(out_syms)
        ends = np.cumsum(per_word)
        symbol_ends = np.concatenate([[0], np.cumsum(per_symbol)])
        bounds = np.concatenate([[0], symbol_ends[ends]]) * 4
        raw = ids.astype("<i4").tobytes()
        bounds = bounds.tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _to_ids(self, syms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols, and how many ids each gives (several bytes for a character without a piece)."""
        n = len(self.pieces.texts)
        odd = np.flatnonzero(syms >= n)
        counts = np.ones(len(syms), np.int64)
        if not len(odd):
            return syms.astype(np.int32), counts
        extra = syms[odd]
        code = extra - self.size
        inner = extra < self.size  # a character that only stands inside pieces
        if inner.any():
            back = np.argsort(self.char_symbols)
            code[inner] = self.char_keys[back[np.searchsorted(self.char_symbols, extra[inner], sorter=back)]]
        utf8 = np.frombuffer("".join(map(chr, code.tolist())).encode("utf-8"), np.uint8)
        counts[odd] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        ids = np.empty(int(counts.sum()), np.int32)
        at = np.cumsum(counts) - counts
        plain = np.ones(len(syms), bool)
        plain[odd] = False
        ids[at[plain]] = syms[plain]
        ids[_flat_ranges(at[odd], counts[odd])] = self.byte_ids[utf8]
        return ids, counts

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index in the pair tables, -1 where two symbols make no piece."""
        real = (left < self.size) & (right < self.size)
        at, there = _lookup(self.pair_keys, np.where(real, left * self.size + right, -2))
        return np.where(there, at, -1)

    def _merge(self, syms: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over all segments; final symbols in segment order, and their number per segment."""
        total = len(starts)
        lens = np.diff(np.append(starts, len(syms)))
        name = np.arange(total)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        pair = np.full(len(syms), -1, np.int64)
        if len(syms) > 1:
            pair[:-1] = self._pairs(syms[:-1], syms[1:])
        pair[starts + lens - 1] = -1
        while len(name):
            starts = np.cumsum(lens) - lens
            rank = np.where(pair >= 0, self.pair_rank[pair], NO_PAIR)
            best = np.minimum.reduceat(rank, starts)
            over = best == NO_PAIR
            if over.any():
                gone = np.repeat(over, lens)
                done.append((name[over], lens[over], syms[gone]))
                keep = ~gone
                syms, pair, rank = syms[keep], pair[keep], rank[keep]
                name, lens, best = name[~over], lens[~over], best[~over]
                if not len(name):
                    break
            seg = np.repeat(np.arange(len(name)), lens)
            hit = np.flatnonzero(rank == best[seg])
            hit_seg = seg[hit]
            first = np.ones(len(hit), bool)
            first[1:] = hit_seg[1:] != hit_seg[:-1]
            # neighbouring hits overlap: of a run, take every second one from its left end
            fresh_run = first.copy()
            fresh_run[1:] |= hit[1:] != hit[:-1] + 1
            run_start = np.maximum.accumulate(np.where(fresh_run, np.arange(len(hit)), 0))
            even = (np.arange(len(hit)) - run_start) % 2 == 0
            hit = hit[np.where(self.pair_safe[pair[hit]], even, first)]
            syms[hit] = self.pair_made[pair[hit]]
            keep = np.ones(len(syms), bool)
            keep[hit + 1] = False
            lens = lens - np.bincount(seg[hit], minlength=len(name))
            now = hit - np.arange(len(hit))  # positions of the merged symbols after compaction
            syms, pair, seg = syms[keep], pair[keep], seg[keep]
            # pairs change on both sides of every merged symbol
            left = now[now > 0] - 1
            for at in (left, now):
                inner = (at + 1 < len(seg))
                at = at[inner]
                same = seg[at] == seg[at + 1]
                pair[at[same]] = self._pairs(syms[at[same]], syms[at[same] + 1])
                pair[at[~same]] = -1
            if now[-1] == len(syms) - 1:
                pair[-1] = -1
        names = np.concatenate([d[0] for d in done])
        counts = np.concatenate([d[1] for d in done])
        flat = np.concatenate([d[2] for d in done])
        at = np.cumsum(counts) - counts
        order = np.argsort(names, kind="stable")
        return flat[_flat_ranges(at[order], counts[order])], counts[order]

    def encode_texts(self, texts: list[str], end: bool = True) -> list[bytes]:
        """Ids of whole texts (little-endian 32-bit), with the model's end id behind each if `end`."""
        per_text = [self.words(t) for t in texts]
        known = self.memory
        if len(known) > MEMORY_WORDS:
            known.clear()
        wanted = {w for words in per_text for w in words}
        new = [w for w in wanted if w not in known]
        found = dict(zip(new, self.encode_words(new), strict=True))
        known.update((w, v) for w, v in found.items() if len(w) <= MEMORY_WORD_CHARS)
        found = {w: v for w, v in found.items() if len(w) > MEMORY_WORD_CHARS}
        tail = np.array([self.pieces.end_id], "<i4").tobytes() if end else b""
        get = known.__getitem__
        out = []
        for words in per_text:
            if found:
                out.append(b"".join([known[w] if w in known else found[w] for w in words]) + tail)
            else:
                out.append(b"".join(map(get, words)) + tail)
        return out

    # -- decoding ---------------------------------------------------------------------------------------

    def decode_texts(self, encoded: Iterable[bytes]) -> list[str]:
        """Texts of id sequences; every byte that is part of no character gives U+FFFD."""
        encoded = list(encoded)
        ids = np.frombuffer(b"".join(encoded), "<i4")
        counts = np.array([len(e) // 4 for e in encoded], np.int64)
        ends = np.cumsum(counts)
        lens = self.out_len[ids]
        raw = self.out_bytes[_flat_ranges(self.out_at[ids], lens)].tobytes()
        done = np.concatenate([[0], np.cumsum(lens)])
        bounds = np.concatenate([[0], done[ends]]).tolist()
        return [self._strip(ids[a:b], raw[x:y].decode("utf-8", "tremor.piece"))
                for a, b, x, y in zip((ends - counts).tolist(), ends.tolist(), bounds, bounds[1:], strict=False)]

    def _strip(self, ids: np.ndarray, text: str) -> str:
        """Without the space that encoding put before the text."""
        if not self.pieces.prefix or not text.startswith(" "):
            return text
        for i in ids[:64].tolist():
            if self.pieces.types[i] != CONTROL:
                return text[1:] if self.pieces.texts[i].startswith(SPACE) else text
        return text


_codecs: dict[Pieces, PieceCodec] = {}


def _codec(pieces: Pieces) -> PieceCodec:
    if pieces not in _codecs:
        _codecs[pieces] = PieceCodec(pieces)
    return _codecs[pieces]


def encode_decode(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """`df` with `ids` (array<int>, the end id last) and `decoded` (the text those ids decode to).

    A null text counts as empty: its ids are the end id alone.  Input columns named like the two new ones are
    replaced.  Any number of rows, repeated rows and an empty table are fine; no shuffle, memory bounded by a
    slice of about a megabyte of text (or one longer text).
    """
    df = without(df, *[c for c in (ids, decoded) if c != text])
    model = df.sparkSession.sparkContext.broadcast(load_pieces(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for batch, texts in slices(batches, text):
            encoded = codec.encode_texts(texts)
            offsets = np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])]).astype(np.int32)
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(encoded))])
            yield appended(batch, [pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(codec.decode_texts(encoded), pa.string())],
                           [ids, decoded])

    return df.mapInArrow(run, with_fields(df, StructField(ids, ArrayType(IntegerType())), StructField(decoded, StringType())))


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """doc_id with the number of ids and the SHA-256 of the decimal ids and of the decoded text."""
    return df.select("doc_id", F.size(ids).cast("long").alias("n_tokens"),
                     F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256).alias("ids_sha256"),
                     F.sha2(F.col(decoded), 256).alias("decoded_sha256"))
