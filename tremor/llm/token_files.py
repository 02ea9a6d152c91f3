"""Token ids of a corpus as ORC files in document order.

Every row of the files is one document: its key, ids (end id last; integer run-length encoded by the format),
their number, the file's ordinal and the number of ids before the document in that file.  Stripes are read in
parallel, row indexes and Bloom filters on the key prune stripes and row groups by metadata alone.

Documents are dealt to files by key range, so file ordinal and position give the global order without a global
sort; a document's global start is its file's start (a running sum of one number per file) plus its own.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

#: Bytes of text encoded at once: each distinct word among them is looked up once.
CHUNK_BYTES = 16 << 20
#: Words a worker remembers from chunk to chunk, and the longest of them; results do not depend on it.
MEMORY_WORDS = 900_000
MEMORY_WORD_BYTES = 48
#: Bytes of words put together into one text for the library (longer texts cost it more a byte), and such texts in one call.
JOINED_BYTES = 2048
JOINED_CALLS = 16
#: Where blanks stand alone a text is cut at every space and line feed; elsewhere only at lone spaces.
_BLANK = r"[\s\x1c-\x1f\x85\u180e\u200b]"
_CUT = re.compile(rf"(?<!^)(?<!{_BLANK}) (?!{_BLANK}|$)")
#: The same blanks but space and line feed, for Arrow's expressions (RE2).
_OTHER_BLANK = (r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
#: Texts with blanks in which not every space and line feed begins a token of its own.
_UNEVEN = rf"^ | \z|  | \n|\n |\n\n\n|\n\n\z|{_OTHER_BLANK}"
#: Words with a blank behind their first character.
_ODD = rf"(?s).[ \n]|{_OTHER_BLANK}"
_MARKS = ".,!?;:"
_BEFORE_MARKS = rf"(?s)^.*[^{_MARKS}]"
#: Digits, and letters below U+0250: letters in every version of Unicode.
_ENDS_ALNUM = r"[0-9A-Za-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]\z"
_STRING, _IDS = pa.large_string(), pa.large_list(pa.int32())


def _lists(ids: np.ndarray, lens: np.ndarray) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(lens)]).astype(np.int64), pa.array(ids, pa.int32()))


class WordEncoder:
    """The tokenizers library over words, each distinct word encoded once while it is remembered.

    The byte-level pre-tokenizer always begins a token at a space, or ends one at a line feed, that stands alone
    between two non-blanks, so cutting a text there changes no id (nor between two line feeds, or before one that
    ends the text).  Nor does cutting between a letter or digit and the marks that end a word.

    A word stands for itself with a space before it; one that begins with a line feed stands for itself alone.
    The first word of a text is taken as one behind a line feed, whose ids are left out afterwards.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        pre = getattr(self.tokenizer.pre_tokenizer, "__getstate__", lambda: b"")()
        if b"ByteLevel" not in bytes(pre) or b'"use_regex":true' not in bytes(pre) or self.tokenizer.normalizer is not None:
            raise ValueError("a byte-level tokenizer without normalisation is needed")
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        #: Ids whose token begins with a space or a line feed (byte-level alphabet): no other byte is shown as these.
        self.begins = np.zeros(max(self.tokenizer.get_vocab().values(), default=0) + 1, bool)
        self.begins[[i for t, i in vocab.items() if t[:1] in ("\u0120", "\u010a")]] = True
        added = (re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.uneven = "|".join([_UNEVEN, *added])  # two line feeds before an added token are one token
        self.line_feed = self._whole("\n")
        self.known, self.known_ids = pa.array([], _STRING), pa.array([], _IDS)

    def encode_texts(self, texts: list[str], end_id: int) -> list[bytes]:
        """Ids of whole texts (little-endian 32-bit), `end_id` behind each."""
        ids, ends = self.encode(pa.array(texts, _STRING), end_id)
        return [part.astype("<i4").tobytes() for part in np.split(ids, ends[:-1])] if len(texts) else []

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, `end_id` behind each text's (a null text is empty), and where each text's end."""
        parts = self._cut(pc.fill_null(texts.cast(_STRING), ""))
        words, row_ends = parts.flatten().dictionary_encode(), parts.offsets.to_numpy() - parts.offsets[0].as_py()
        del parts
        taken = self._word_ids(words.dictionary).take(words.indices)
        ids, bounds = taken.flatten().to_numpy(), taken.offsets.to_numpy() - taken.offsets[0].as_py()
        row_bounds = bounds[row_ends]
        keep = np.ones(len(ids), bool)
        for i in range(len(self.line_feed)):
            keep[row_bounds[:-1] + i] = False
        lens = np.diff(row_bounds) - len(self.line_feed)
        ends = np.cumsum(lens)
        return np.insert(ids[keep], ends, np.int32(end_id)), ends + np.arange(1, len(ends) + 1)

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        """Every text's words."""
        uneven = pc.match_substring_regex(texts, self.uneven)
        even = texts.filter(pc.invert(uneven))
        line, none = pa.scalar("\n", _STRING), pa.scalar("", _STRING)
        parts = pc.split_pattern(pc.binary_join_element_wise(line, pc.replace_substring(even, "\n", " \n"), none), " ")
        if len(even) == len(texts):
            return parts
        others = [_CUT.split(t) for t in texts.filter(uneven).to_pylist()]
        others = pa.array([["\n" + first, *rest] for first, *rest in others], parts.type)
        mask = uneven.to_numpy(zero_copy_only=False)
        place = np.where(mask, len(even) + np.cumsum(mask) - 1, np.cumsum(~mask) - 1)
        return pa.concat_arrays([parts, others]).take(pa.array(place))

    def _word_ids(self, words: pa.Array) -> pa.LargeListArray:
        """Ids of distinct words, from those of the words without the marks that end them and those of the marks."""
        bases = pc.ascii_rtrim(words, _MARKS)
        cut = pc.and_(pc.match_substring_regex(bases, _ENDS_ALNUM), pc.invert(pc.match_substring_regex(words, _ODD)))
        bases = pc.if_else(cut, bases, words).dictionary_encode()
        n_marks = pc.subtract(pc.binary_length(words), pc.binary_length(bases.dictionary.take(bases.indices))).to_numpy()
        marked = np.flatnonzero(n_marks)
        tails = pc.replace_substring_regex(words.take(pa.array(marked)), _BEFORE_MARKS, "").dictionary_encode()
        mark_ids = [[], *map(self._whole, tails.dictionary.to_pylist())]
        pool = pa.concat_arrays([self._remembered(bases.dictionary), pa.array(mark_ids, _IDS)])
        place = np.full((len(words), 2), len(bases.dictionary), np.int64)
        place[:, 0] = bases.indices.to_numpy()
        place[marked, 1] += tails.indices.to_numpy() + 1
        both = pool.take(pa.array(place.ravel()))
        return pa.LargeListArray.from_arrays(both.offsets[::2], both.values)

    def _remembered(self, words: pa.Array) -> pa.LargeListArray:
        """Ids of distinct words, new ones encoded.  When the memory is full only the words at hand stay in it."""
        if len(words) * 8 < len(self.known):  # few words: looking all the others through costs more than encoding these
            return self._encoded(words)
        at = pc.index_in(words, value_set=self.known)
        new = words.filter(pc.is_null(at))
        ids = pa.concat_arrays([self.known_ids, self._encoded(new)])
        known = pa.concat_arrays([self.known, new])
        place = pc.fill_null(at, 0).to_numpy().astype(np.int64)
        place[pc.is_null(at).to_numpy(zero_copy_only=False)] = np.arange(len(self.known), len(known))
        out = ids.take(pa.array(place))
        if len(known) > MEMORY_WORDS:
            known, ids = words.slice(0, MEMORY_WORDS), out.slice(0, MEMORY_WORDS)
        short = pc.less_equal(pc.binary_length(known), MEMORY_WORD_BYTES)
        self.known, self.known_ids = known.filter(short), ids.filter(short)
        return out

    def _encoded(self, words: pa.Array) -> pa.LargeListArray:
        """Ids of words from the library, many words to a call; words with blanks inside one by one."""
        if not len(words):
            return pa.array([], _IDS)
        odd = pc.match_substring_regex(words, _ODD)
        plain = words.filter(pc.invert(odd))
        group = np.cumsum(pc.binary_length(plain).to_numpy().astype(np.int64) + 1) // JOINED_BYTES
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(plain)]])
        joined = pc.binary_join(pa.ListArray.from_arrays(bounds.astype(np.int32), plain), pa.scalar(" ", _STRING)).to_pylist()
        joined, found = [f" {j}".replace(" \n", "\n") for j in joined], []
        for at in range(0, len(joined), JOINED_CALLS):  # the library's results are large
            found += [np.array(f.ids, np.int32) for f in self.tokenizer.encode_batch_fast(joined[at:at + JOINED_CALLS], add_special_tokens=False)]
        if any(np.count_nonzero(self.begins[f]) != n for f, n in zip(found, np.diff(bounds).tolist(), strict=True)):
            found = [self._one(w) for w in plain.to_pylist()]  # a vocabulary that does not show where words begin
            lens = np.array([len(f) for f in found], np.int64)
            ids = np.concatenate([np.empty(0, np.int32), *found])
        else:
            ids = np.concatenate([np.empty(0, np.int32), *found])
            lens = np.diff(np.flatnonzero(self.begins[ids]), append=len(ids))
        out = _lists(ids, lens)
        mask = odd.to_numpy(zero_copy_only=False)
        if not mask.any():
            return out
        others = pa.array([self._one(w) for w in words.filter(odd).to_pylist()], _IDS)
        place = np.where(mask, len(plain) + np.cumsum(mask) - 1, np.cumsum(~mask) - 1)
        return pa.concat_arrays([out, others]).take(pa.array(place))

    def _one(self, word: str) -> np.ndarray:
        return np.array(self.line_feed + self._whole(word[1:]) if word[:1] == "\n" else self._whole(" " + word), np.int32)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in order, in batches of about `limit` bytes of text: larger ones cut, smaller ones put together."""
    held, size = [], 0
    for batch in batches:
        lens = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy()
        upto, at = np.cumsum(lens.astype(np.int64) + 16), 0
        while at < len(upto):
            before = int(upto[at - 1]) if at else 0
            end = min(int(np.searchsorted(upto, before + limit - size)) + 1, len(upto))
            held.append(batch.slice(at, end - at))
            size, at = size + int(upto[end - 1]) - before, end
            if size >= limit:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


_encoders: dict[str, WordEncoder] = {}


def _encoder(tokenizer_json: str) -> WordEncoder:
    if tokenizer_json not in _encoders:
        _encoders[tokenizer_json] = WordEncoder(tokenizer_json)
    return _encoders[tokenizer_json]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode every whole text and write the files in ascending order of `key`.

    Rows with a null key come first; rows with equal keys are ordered (and may be dealt apart) by their text's
    hash, equal rows by a number of their own, so that no group of copies fills one file; a null text is empty and
    gives the end id alone.  An empty table writes a readable empty file.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("row")]
    rows = (docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("row"))
            .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text"))
    schema = StructType([StructField("doc_id", LongType()), StructField("ids", ArrayType(IntegerType())), StructField("n_tokens", LongType()),
                         StructField("file_no", IntegerType()), StructField("before", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file_no, before = _encoder(model.value), TaskContext.get().partitionId(), 0
        for batch in chunks(batches, "text"):
            ids, ends = encoder.encode(batch.column(1), end_id)
            lens = np.diff(ends, prepend=0)
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(lens),
                 pa.array(np.full(len(lens), file_no, np.int32)), pa.array(before + ends - lens)], names=schema.names)
            before += int(ends[-1])

    (rows.mapInArrow(run, schema).write.option("orc.bloom.filter.columns", "doc_id").option("orc.create.index", "true")
     .option("compression", "zstd").orc(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows: doc_id, ids, n_tokens, file_no, before.  Filters on doc_id prune by index and Bloom filter."""
    return spark.read.schema("doc_id long, ids array<int>, n_tokens long, file_no int, before long").orc(path)


def starts(files: DataFrame) -> DataFrame:
    """(file_no, file_start): ids in all files before each; one row per file, so the running sum stays small."""
    totals = files.groupBy("file_no").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("file_no", F.coalesce(F.sum("total").over(before), F.lit(0)).cast("long").alias("file_start"))


def token_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, all from the ids in the files."""
    schema = "doc_id long, n_tokens long, ids_crc32 long, file_no int, before long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(1)
            offsets = ids.offsets.to_numpy().astype(np.int64)
            raw = memoryview(np.ascontiguousarray(ids.values.to_numpy().astype("<u4", copy=False))).cast("B")
            bounds = (offsets * 4).tolist()
            crc = [zlib.crc32(raw[x:y]) for x, y in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(crc, pa.int64()), b.column(2), b.column(3)],
                                             names=["doc_id", "n_tokens", "ids_crc32", "file_no", "before"])

    rows = files.select("doc_id", "ids", "file_no", "before").mapInArrow(run, schema)
    return (rows.join(starts(files), "file_no")
            .select("doc_id", (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"))
