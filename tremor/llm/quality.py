"""Document quality: kernel ridge by random Fourier features over document statistics, calibrated isotonically.

Every whole text becomes a short row of statistics (lengths, shares of character classes, repetition of words, word
pairs and lines, entropy, compressibility).  Random Fourier features z(x) = sqrt(2) cos(xW + b), W drawn with the
bandwidth of a Gaussian kernel, make that kernel an inner product, so ridge regression in it needs only the sums
Z'Z and Z'y.  Every partition of the labelled rows sums its own and Spark adds these up by matrix row; the solver
sees one (features + 1)^2 matrix however many rows there are.  The ridge score is calibrated by isotonic regression
on labelled rows that gave no sums: rows are counted on Spark by score bin, neighbouring bins that break the order
are pooled, and scores are read off the line through the pools.

Nothing is sampled: all labelled rows outside the held-out fold count.  Features are rounded to 1 / 1024, so their
sums are exact whole numbers in any order, and a repeated or retried fit gives the same model.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from tremor.llm.common import appended, fresh, slices, with_fields, without, written

FEATURES = 256
#: Width of the Gaussian kernel, in standard deviations of one statistic times the root of their number.
BANDWIDTH = 2.0
#: Ridge against the mean square of a feature.
RIDGE = 1e-4
THRESHOLD = 0.3
BINS = 4096
#: Share of the ridge score in the result: orders texts that the calibration holds for equal.
SLOPE = 0.01
UNIT = 1024

# classes of UTF-8 bytes: control, blank, newline, digit, upper, lower, stop, other ASCII mark, beyond ASCII
_CLASSES = 9
_CLASS = np.zeros(256, np.int64)
for _i, _bytes in enumerate([b" \t\r", b"\n", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), b".,;:!?'\"()-",
                             b"#$%&*+/<=>@[\\]^_`{|}~", bytes(range(128, 256))]):
    _CLASS[list(_bytes)] = _i + 1
NAMES = ["log_bytes", "log_words", "log_lines", "control", "blank", "newline", "digit", "upper", "lower", "stop", "mark", "beyond", "entropy",
         "squeezed", "word_size", "word_spread", "short_words", "long_words", "capital_words", "distinct_words", "top_word", "twice_in_row",
         "distinct_pairs", "edge_marks", "line_size", "distinct_lines", "short_lines", "ended_lines"]


def _of_words(text: str) -> list[float]:
    """Statistics of the words and lines of a text that has some."""
    words = text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    n, m = len(words), len(lines)
    sizes = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [np.log1p(sizes.mean()), np.log1p(sizes.std()), (sizes <= 3).mean(), (sizes > 20).mean(), sum(map(str.istitle, words)) / n,
            len(counts) / n, max(counts.values()) / n, sum(map(str.__eq__, words, words[1:])) / n, pairs / max(n - 1, 1),
            sum(not w[-1].isalnum() for w in words) / n, np.log1p(len(text) / m), len(set(lines)) / m,
            sum(len(x) < 30 for x in lines) / m, sum(x.rstrip()[-1] in ".!?\"'" for x in lines) / m]


def statistics_of(texts: list[str]) -> np.ndarray:
    """One row of NAMES per whole text, finite for any text; an empty text gives zeros."""
    raw = [t.encode("utf-8") for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    every = np.frombuffer(b"".join(raw), np.uint8)
    owner = np.repeat(np.arange(len(raw)), size)
    bytes_ = np.bincount(owner * 256 + every, minlength=256 * len(raw)).reshape(-1, 256)
    total = np.maximum(size, 1)[:, None]
    classes = np.stack([bytes_[:, _CLASS == c].sum(1) for c in range(_CLASSES)], 1) / total
    share = bytes_ / total
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1) / 8
    squeezed = np.array([len(zlib.compress(b, 1)) / len(b) if b else 0.0 for b in raw])
    words = np.array([_of_words(t) if t.strip() else [0.0] * 14 for t in texts], float).reshape(-1, 14)
    n_words = np.array([len(t.split()) for t in texts])
    return np.column_stack([np.log1p(size), np.log1p(n_words), np.log1p(bytes_[:, 10]), classes, entropy, squeezed, words])


def statistics(docs: DataFrame, text: str = "text", out: str = "statistics") -> DataFrame:
    """`docs` with the statistics of each whole text (null: as empty); a column named `out` is replaced."""
    docs = without(docs, out) if out != text else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text):
            yield appended(batch, [_lists(statistics_of(texts))], [out])

    return docs.mapInArrow(run, with_fields(docs, StructField(out, ArrayType(DoubleType()))))


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))


def _matrix(batch: pa.RecordBatch, column: str) -> np.ndarray:
    values = batch.column(batch.schema.get_field_index(column))
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), len(NAMES))


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo five; a null id counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5


@dataclass
class Model:
    """Standardisation, Fourier map, ridge weights and the calibration's knots; `constant` where none was fitted."""

    constant: float = 0.5
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    turn: np.ndarray | None = None
    phase: np.ndarray | None = None
    weight: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        """Fourier features and a constant, in whole 1 / UNIT."""
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2) * np.cos(np.round(x @ self.turn + self.phase, 9))  # the last digits of a product vary with the batch
        return np.rint(np.column_stack([z, np.ones(len(x))]) * UNIT)

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return np.round(self.features(x) @ self.weight / UNIT, 9)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.knots is None:
            return np.full(len(x), self.constant)
        raw = np.clip(self.ridge(x), -0.5, 1.5)
        return np.clip((1 - SLOPE) * np.interp(raw, *self.knots) + SLOPE * (raw + 0.5) / 2, 0, 1)


def _normal_sums(rows: DataFrame, model: Model, column: str, label: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Z'Z, Z'y and the number of rows, summed by partition, then by matrix row on Spark."""
    d = FEATURES + 1
    schema = StructType([StructField("row", IntegerType()), StructField("sums", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 1))  # whole numbers below 2^53: exact for 2^31 rows
        for batch in batches:
            z = model.features(_matrix(batch, column))
            y = batch.column(batch.schema.get_field_index(label)).to_numpy(zero_copy_only=False)
            total += z.T @ np.column_stack([z, y * UNIT])
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([r.tobytes() for r in total])], schema.names)

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(d + 1)
        for r in group.column("sums"):
            total += np.frombuffer(r.as_py())
        return pa.table({"row": group.column("row")[:1], "sums": pa.array([total.tobytes()])})

    parts = rows.mapInArrow(run, schema).groupBy("row").applyInArrow(add, schema).collect()  # `d` rows, whatever the input
    both = np.zeros((d, d + 1))
    for r in parts:
        both[r["row"]] = np.frombuffer(r["sums"])
    return both[:, :d], both[:, d], int(round(both[d - 1, d - 1] / UNIT ** 2))


def pooled(x: np.ndarray, count: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: pool neighbours that break the order; places and shares of label 1 of the pools."""
    pools: list[list[float]] = []
    for place, n, k in zip(x.tolist(), count.tolist(), ones.tolist(), strict=True):
        pools.append([place * n, n, k])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    p = np.array(pools)
    return p[:, 0] / p[:, 1], p[:, 2] / p[:, 1]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", column: str = "statistics",
        bandwidth: float = BANDWIDTH, ridge: float = RIDGE, seed: int = 1) -> Model:
    """Fit on labelled rows of `docs` (with statistics) outside the held-out fold.

    Several labels of one id: 1 only if all say so.  Null ids and null labels are left out.  If a class is missing
    (or gives no calibration row), every score is the share of label 1, or 0.5 without labels.
    """
    spark = docs.sparkSession
    marked = (labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label"))
              .filter("id is not null and label in (0, 1)").groupBy("id").agg(F.min("label").alias("label")).filter(fold(F.col("id")) != 0))
    rows = (docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{column}`").alias("x")).join(marked, "id")
            .select("x", F.col("label").cast("double").alias("y"), (F.xxhash64("id") % 4 == 0).alias("curve")))
    rows = written(spark, rows, "labelled")
    parts = [F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(len(NAMES))] + [F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(len(NAMES))]
    r = rows.agg(F.count("*").alias("n"), F.sum("y").alias("ones"), *parts).first()
    if not r["n"]:
        return Model()
    model = Model(constant=r["ones"] / r["n"])
    if not 0 < r["ones"] < r["n"]:
        return model
    # rounded: sums of doubles depend on their order in the last digits
    model.mean = np.array([float(f"{r[f'm{i}']:.6g}") for i in range(len(NAMES))])
    model.scale = np.array([float(f"{max(r[f's{i}'], 1e-3):.6g}") for i in range(len(NAMES))])
    draw = np.random.default_rng(seed)
    model.turn = draw.standard_normal((len(NAMES), FEATURES)) / (bandwidth * np.sqrt(len(NAMES)))
    model.phase = draw.uniform(0, 2 * np.pi, FEATURES)
    zz, zy, n = _normal_sums(rows.filter("not curve"), model, "x", "y")
    if not n:
        return model
    penalty = np.full(FEATURES + 1, ridge * n * UNIT ** 2)
    penalty[-1] = 1e-9 * n * UNIT ** 2  # the constant is not shrunk
    model.weight = np.linalg.solve(zz + np.diag(penalty), zy)
    schema = StructType([StructField("bin", IntegerType()), StructField("y", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.rint((np.clip(model.ridge(_matrix(batch, "x")), -0.5, 1.5) + 0.5) / 2 * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(batch.schema.get_field_index("y"))], schema.names)

    bins = (rows.filter("curve").mapInArrow(run, schema).groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
            .orderBy("bin").collect())  # at most BINS + 1 rows
    count, ones = np.array([b["n"] for b in bins]), np.array([b["ones"] for b in bins])
    if bins and 0 < ones.sum() < count.sum():
        model.knots = pooled(np.array([b["bin"] for b in bins]) / BINS * 2 - 0.5, count, ones)
    return model


def score(docs: DataFrame, model: Model, column: str = "statistics", threshold: float = THRESHOLD, out: str = "score",
          predicted: str = "predicted") -> DataFrame:
    """`docs` (with statistics) with `out` (0 to 1, higher: label 1 likelier) and `predicted` (1 from the threshold on).

    Equal texts score alike, empty ones too; columns named like the new ones are replaced; nothing is shuffled.
    """
    docs = without(docs, *[c for c in (out, predicted) if c != column])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield appended(batch, [pa.array(model.score(_matrix(batch, column)))], [out])

    scored = docs.mapInArrow(run, with_fields(docs, StructField(out, DoubleType())))
    return scored.withColumn(predicted, (F.col(out) >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """`docs` with score and predicted, fitted on `labels`: the texts are read once, the statistics written."""
    (column,) = fresh(docs, "statistics")
    known = written(docs.sparkSession, statistics(docs, text, column), "statistics")
    return score(known, fit(known, labels, key, label, column), column).drop(column)
