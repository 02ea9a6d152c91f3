"""Toxicity by class-conditional Kneser-Ney language models.

Two character models of words, one of toxic and one of ordinary labelled documents, and a third of both together.
The third interpolates down through continuation counts in the Kneser-Ney way; each class's absolutely discounted
counts back off to it with the same context, so the backoff counts are shared: an expression that a class has
hardly seen is judged alike by both, and only counts that differ speak.  The counts are numbers of documents that
hold an n-gram in any word, so one long document with words of its own speaks once.

A word's evidence is the difference r of its two log-likelihoods, weighted by what the counts behind it can tell
from chance: with v the variance of r (the sum of those of the binomial shares on the way through the word) it is
r^5 / (r^4 + (z^2 v)^2).  A ratio that many documents stand behind counts whole however mild it is; one within z
standard errors of none is what a sample gives by itself, such as a language that one class happens to hold a
little more of.  More labelled documents lower v and let milder words speak.  z is 4, as hundreds of thousands of
ratios are looked at.  A document's evidence is the sum over its words, every occurrence, normalised by their
number (plus `SHORT`, which keeps a handful of words from deciding); punctuation alone says nothing.  A logistic
curve fitted on documents that gave no counts turns it into a score.

The fit uses a bounded sample: at most `max_docs` labelled documents, whole texts, per class, the smallest by
hash of their id, exact copies once.  Counts are summed on Spark; the driver receives only n-grams of `cutoff` or
more occurrences, whose number the sample bounds.  Scoring reads every whole text once, without a shuffle.
"""

from __future__ import annotations

import math
import string
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

from tremor.llm.common import appended, slices, with_fields, without, written

MAX_DOCS = 4000
ORDER = 6
CUTOFF = 2
#: Weight of the shared estimate against a class's own counts, in documents of the smaller class; the larger class
#: has as many more as it has documents, or what neither has seen would look like the smaller one.
STRENGTH = 10.0
#: Standard errors at which half of a word's log-ratio counts.
ERRORS = 4.0
SHORT = 15.0
#: Weight of ordinary documents against toxic ones when the curve is fitted, at most.
MAX_PRIOR = 20.0
THRESHOLD = 0.3
MEMORY_WORDS = 150_000
#: Beyond any character a text holds: the ends of a word.
HEAD, TAIL = "\x02", "\x03"
_EDGE = string.punctuation + "“”„‘’«»¿¡…–—"


def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo four; a null id counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 4


@dataclass
class Model:
    """(Log-ratio toxic / ordinary, its variance): of every n-gram's estimate, and of the backoff weight behind every context."""

    order: int
    errors: float
    ngram: dict[str, tuple[float, float]] = field(default_factory=dict)
    backoff: dict[str, tuple[float, float]] = field(default_factory=dict)
    slope: float = 0.0
    offset: float = -20.0
    key: str = ""

    def ratio(self, form: str) -> tuple[float, float]:
        """Difference of the two log-likelihoods of one word, and its variance."""
        s, total, spread, n = HEAD + form + TAIL, 0.0, 0.0, self.order
        known, behind = self.ngram.get, self.backoff.get
        for i in range(2, len(s) + 1):
            g = s[i - n if i > n else 0:i]
            r, v = known(g) or behind(g[:-1], (0.0, 0.0))
            total += r
            spread += v
        return total, spread

    def word(self, form: str) -> float:
        """A word's log-ratio, weighted by its certainty; punctuation alone is no word and says nothing."""
        r, v = self.ratio(form) if form else (0.0, 0.0)
        return r ** 5 / (r ** 4 + (self.errors ** 2 * v) ** 2) if abs(r) > 1e-9 else 0.0

    def evidence(self, texts: list[str], words: Words) -> np.ndarray:
        """Length-normalised evidence of whole texts, every occurrence of a word counted."""
        split = [t.lower().split() for t in texts]
        get = words.__getitem__
        return np.array([math.fsum(map(get, s)) / (len(s) + SHORT) for s in split])

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * evidence + self.offset, -40, 40)))


class Words(dict):
    """Evidence of raw words (in lower case, judged without punctuation around them), remembered up to a bound."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, raw: str) -> float:
        r = self.model.word(raw.strip(_EDGE))
        if len(self) < MEMORY_WORDS and len(raw) < 48:
            self[raw] = r
        return r


def _ngrams(word: str, order: int) -> list[str]:
    """Every n-gram of 1 to `order` characters of a word, its ends included (but none of its beginning alone)."""
    s = HEAD + word + TAIL
    return [s[a:i + 1] for i in range(1, len(s)) for a in range(max(0, i + 1 - order), i + 1)]


def _ngram_counts(docs: DataFrame, order: int) -> DataFrame:
    """(g, toxic, ordinary): documents of each class that hold an n-gram, so that no document speaks twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for batch, texts in slices(batches, "text"):
            counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
            for t, label in zip(texts, batch.column(batch.schema.get_field_index("label")).to_pylist(), strict=True):
                held: set[str] = set()
                for w in {w.strip(_EDGE) for w in t.lower().split()} - {""}:
                    grams = known.get(w)
                    if grams is None:
                        grams = _ngrams(w, order)
                        if len(known) < MEMORY_WORDS // 10 and len(w) < 24:
                            known[w] = grams
                    held.update(grams)
                counts[label].update(held)
            grams = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), *[pa.array([c[g] for g in grams], pa.int64()) for c in reversed(counts)]],
                                             names=["g", "toxic", "ordinary"])

    schema = StructType([StructField(c, LongType() if c != "g" else StringType()) for c in ("g", "toxic", "ordinary")])
    return docs.mapInArrow(run, schema).groupBy("g").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


class Context(NamedTuple):
    """Sums of a context's counts (t: toxic, o: ordinary, s: both) and numbers of what follows it."""

    size: int
    t: int
    o: int
    s: int
    kt: int
    ko: int
    ks: int


def _rows(df: DataFrame) -> Iterator[tuple]:
    """Rows of a bounded table, column by column over Arrow."""
    return zip(*[c.to_pylist() for c in df.toArrow().columns], strict=True)


def _discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5


def _estimates(raw: DataFrame, order: int, cutoff: int, strength: dict[str, float], errors: float) -> Model:
    """Both models from a written table of raw n-gram counts; `strength` of the shared estimate by class."""
    spark = raw.sparkSession
    size, n_toxic, n_ordinary = F.length("g"), F.col("toxic"), F.col("ordinary")
    # shorter n-grams count the different characters before them, unless they begin a word
    before = (raw.filter(size > 1).groupBy(F.expr("substring(g, 2)").alias("g"))
              .agg(F.count_if(n_toxic > 0).alias("bt"), F.count_if(n_ordinary > 0).alias("bo"), F.count("*").alias("bs")))
    whole = (size == order) | F.col("g").startswith(HEAD)
    counts = written(spark, raw.join(before, "g", "left").select(
        "g", (n_toxic + n_ordinary).alias("n"), size.alias("size"),
        F.when(whole, n_toxic).otherwise(F.coalesce("bt", F.lit(0))).alias("t"),
        F.when(whole, n_ordinary).otherwise(F.coalesce("bo", F.lit(0))).alias("o"),
        F.when(whole, n_toxic + n_ordinary).otherwise(F.coalesce("bs", F.lit(0))).alias("s")), "ngrams")
    discount = {c: {r["size"]: _discount(r["a"], r["b"]) for r in
                    counts.groupBy("size").agg(F.count_if(F.col(c) == 1).alias("a"), F.count_if(F.col(c) == 2).alias("b")).collect()}
                for c in "tos"}
    prefix = F.expr("substring(g, 1, size - 1)")
    contexts = counts.groupBy(prefix.alias("c"), "size").agg(
        F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in "tos"], *[F.count_if(F.col(c) > 0).alias("k" + c) for c in "tos"])
    context = {c: Context(*rest) for c, *rest in _rows(contexts.filter(F.col("n") >= cutoff).select("c", *Context._fields))}
    model = Model(order, errors, key=uuid.uuid4().hex)
    p: dict[str, float] = {}

    def both(g: str) -> float:
        """The shared estimate of an n-gram that may be in no table."""
        if not g:
            return 1 / 256
        r = context.get(g[:-1])
        return p[g] if g in p else both(g[1:]) * (discount["s"][len(g)] * r.ks / r.s if r is not None and r.s else 1.0)

    def rest(c: str, r: Context) -> float:
        """What a class leaves to the shared estimate behind a context."""
        return (discount[c][r.size] * getattr(r, "k" + c) + strength[c]) / (getattr(r, c) + strength[c])

    def measured(r: Context, of_t: float, of_o: float) -> tuple[float, float]:
        """Log-ratio of two estimates behind a context, and its variance: that of two binomial shares."""
        spread = (1 - of_t) / (of_t * (r.t + strength["t"])) + (1 - of_o) / (of_o * (r.o + strength["o"]))
        return math.log(of_t / of_o), max(spread, 0.0)

    for g, k, t, o, n in _rows(counts.filter(F.col("n") >= cutoff).orderBy("size").select("g", "size", "t", "o", "s")):
        r, d = context[g[:-1]], discount["s"][k]
        p[g] = (max(n - d, 0) + d * r.ks * both(g[1:])) / r.s if r.s else both(g[1:])
        if k > 1 and (k == order or g[0] == HEAD):
            of_t, of_o = (max(own - discount[c][k], 0) / (getattr(r, c) + strength[c]) + rest(c, r) * p[g] for c, own in (("t", t), ("o", o)))
            model.ngram[g] = measured(r, of_t, of_o)
    model.backoff = {c: measured(r, rest("t", r), rest("o", r)) for c, r in context.items() if c and (r.size == order or c[0] == HEAD)}
    return model


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve (Newton steps; a small ridge on the standardised slope)."""
    scale = float(np.abs(x).mean()) or 1.0
    design, beta = np.column_stack([x / scale, np.ones(len(x))]), np.zeros(2)
    ridge = np.diag([0.05, 1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        w = weight * np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve(design.T @ (design * w[:, None]) + ridge, design.T @ (weight * (y - p)) - ridge @ beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_docs: int = MAX_DOCS,
        order: int = ORDER, cutoff: int = CUTOFF, strength: float = STRENGTH, errors: float = ERRORS) -> Model | None:
    """Fit on labelled documents outside the held-out fold; None where a class has none.

    Several labels of one id: toxic if one says so.  Null ids, null labels and null texts are left out.
    """
    spark = docs.sparkSession
    marked = (labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("int").alias("label"))
              .filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
              .filter(fold(F.col("id")) != 2))
    marked = written(spark, marked, "labels")
    sizes = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    first = [F.xxhash64("id"), F.col("id")]
    chosen = marked.filter("label = 0").orderBy(*first).limit(max_docs).union(marked.filter("label = 1").orderBy(*first).limit(max_docs))
    chosen = written(spark, chosen, "chosen")  # at most 2 * max_docs ids
    sample = (docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).filter("text is not null")
              .join(F.broadcast(chosen), "id"))
    sample = written(spark, sample.withColumn("print", F.xxhash64("text")).dropDuplicates(["print", "label"])
                     .withColumn("curve", F.xxhash64("print", F.lit("curve")) % 4 == 0), "sample")
    counted = sample.filter("not curve")
    size = {r["label"]: r["count"] for r in counted.groupBy("label").count().collect()}
    if not size.get(0) or not size.get(1):
        return None
    shared = {c: strength * size[label] / min(size.values()) for c, label in (("t", 1), ("o", 0))}
    model = _estimates(written(spark, _ngram_counts(counted, order), "raw"), order, cutoff, shared, errors)
    schema = StructType([StructField("x", DoubleType()), StructField("label", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(model)
        for batch, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(model.evidence(texts, known)), batch.column(batch.schema.get_field_index("label"))],
                                             names=["x", "label"])

    points = sample.filter("curve").select("text", "label").mapInArrow(run, schema).collect()  # a bounded sample
    y = np.array([r["label"] for r in points], float)
    if not 0 < y.sum() < len(y):
        return None
    prior = min(MAX_PRIOR, sizes[0] / sizes[1])
    model.slope, model.offset = _curve(np.array([r["x"] for r in points]), y, np.where(y > 0, 1.0, prior))
    return model


_words: dict[str, Words] = {}


def score(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD, out: str = "score",
          predicted: str = "predicted") -> DataFrame:
    """`docs` with `out` (0 to 1) and `predicted` (1 if the score reaches the threshold).

    Null texts count as empty; without evidence the score is the curve's value at zero.  Without a model (no
    labels of a class) every score is 0.  Columns named like the new ones are replaced.
    """
    docs = without(docs, *[c for c in (out, predicted) if c != text])
    if model is None:
        return docs.withColumn(out, F.lit(0.0)).withColumn(predicted, F.lit(0))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the fit's sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        if m.key not in _words:
            _words.clear()
            _words[m.key] = Words(m)
        for batch, texts in slices(batches, text):
            yield appended(batch, [pa.array(m.score(m.evidence(texts, _words[m.key])))], [out])

    scored = docs.mapInArrow(run, with_fields(docs, StructField(out, DoubleType())))
    return scored.withColumn(predicted, (F.col(out) >= threshold).cast("int"))
