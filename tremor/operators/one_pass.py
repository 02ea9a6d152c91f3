"""The whole experiment grid in one crossing into Python.

Each example crosses once: its fields are normalized, perturbed under every (perturbation, level) of the grid (code
points, words and draws shared between the grid rows) and all inputs of a slice of examples are given to the
predictors in batches that run across grid rows.  What comes back is one row per example:

* `cells`, array of (g, m, prediction, score): grid row g (0 is the clean input) and model m, grid row by grid row;
* `texts`, array of (text, premise, hypothesis) by grid row, if asked for.

Exploding to one row per prediction (`long_rows`) or per clean/perturbed pair (`paired_rows`) is left to the JVM.
The grid and the models are configuration: they travel in the closure and come back as small numbers.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from tremor.functions import fixed
from tremor.functions.kernels import Perturber, StopWords, join_fields, normalized
from tremor.operators.config import BROADCAST_ROWS

FIELDS = ("text", "premise", "hypothesis")
CELL = StructType([StructField("g", IntegerType()), StructField("m", IntegerType()), StructField("prediction", StringType()), StructField("score", DoubleType())])
TEXTS = StructType([StructField(c, StringType()) for c in FIELDS])
CLEAN = ("clean", 0.0)
#: Characters of input, over all grid rows, that are perturbed and scored at once.
SLICE_CHARS = 1 << 22
#: Predictors kept loaded in one worker process; the one longest unused leaves (and is closed, if it can be).
KEPT = 4


# ---- predictors --------------------------------------------------------------------------------

def unpacked(out) -> tuple[str, float]:
    """Label and score of one model output: a dict, a (label, score) tuple or a bare label."""
    if isinstance(out, dict):
        return str(out["label"] if "label" in out else out), float(out.get("score", 0.0))
    if isinstance(out, tuple):
        return str(out[0]), float(out[1])
    return str(out), 1.0


@dataclass(frozen=True)
class Predictor:
    """One model: `factory()` loads it in a worker, once, and gives `predict(list of texts) -> list of outputs`."""

    name: str
    factory: Callable[[], Callable[[list], list]]
    batch_size: int = 32
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def models(self) -> tuple[str, ...]:
        return (self.name,)

    def load(self) -> Callable[[list[str]], tuple[list[str], list[float]]]:
        predict, size = self.factory(), self.batch_size

        def run(texts: list[str]) -> tuple[list[str], list[float]]:
            out = []
            for i in range(0, len(texts), size):
                part = texts[i:i + size]
                got = [unpacked(o) for o in predict(part)]
                if len(got) != len(part):
                    raise ValueError(f"the predictor gave {len(got)} outputs for {len(part)} inputs")
                out += got
            return [o[0] for o in out], [o[1] for o in out]

        run.close = getattr(predict, "close", lambda: None)
        return run


@dataclass(frozen=True)
class RuleModels:
    """Stop-word-share models: label '1' iff the share reaches a model's threshold; one count serves them all."""

    thresholds: tuple[tuple[str, float], ...]
    words: frozenset = frozenset(fixed.RULE_STOPWORDS)

    @property
    def key(self) -> tuple:
        return self.thresholds, self.words

    @property
    def models(self) -> tuple[str, ...]:
        return tuple(name for name, _ in self.thresholds)

    def load(self) -> Callable[[list[str]], tuple[list[str], list[float]]]:
        words, limits = StopWords(self.words), [t for _, t in self.thresholds]

        def run(texts: list[str]) -> tuple[list[str], list[float]]:
            labels, scores = [], []
            for n, hits in zip(*words.counts(texts), strict=True):
                share = hits / n
                for limit in limits:
                    hit = share >= limit
                    labels.append("1" if hit else "0")
                    scores.append(share if hit else 1.0 - share)
            return labels, scores

        return run


_kept: OrderedDict[object, Callable] = OrderedDict()


def loaded(predictor) -> Callable:
    """The predictor as loaded in this process: at its first use, and again only if it had to leave."""
    if predictor.key not in _kept:
        _kept[predictor.key] = predictor.load()
        while len(_kept) > KEPT:
            _, old = _kept.popitem(last=False)
            getattr(old, "close", lambda: None)()
    _kept.move_to_end(predictor.key)
    return _kept[predictor.key]


# ---- the crossing ------------------------------------------------------------------------------

def grid_rows(grid) -> list[tuple[str, float]]:
    """(perturbation, level) rows without the clean one, each once, from pairs or from a small table."""
    if isinstance(grid, DataFrame):
        rows = grid.select("perturbation", F.col("level").cast("double")).limit(BROADCAST_ROWS + 1).collect()
        if len(rows) > BROADCAST_ROWS:
            raise ValueError(f"a grid of more than {BROADCAST_ROWS} rows")
        grid = [tuple(r) for r in rows]
    return list(dict.fromkeys((p, float(lv)) for p, lv in grid if p != "clean"))


def _slices(batch: pa.RecordBatch, times: int) -> Iterator[pa.RecordBatch]:
    """Row ranges of about SLICE_CHARS characters over all grid rows (a longer example is a range of its own)."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in FIELDS:
        size += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate((size * times).tolist()):
        total += n
        if total >= SLICE_CHARS:
            yield batch.slice(at, i + 1 - at)
            at, total = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


def crossed(examples: DataFrame, grid, predictors: Sequence = (), perturber: Perturber | None = None, with_text: bool = False,
            normalize: bool = True, keep: Sequence[str] = ("task", "language", "id", "label")) -> DataFrame:
    """`keep` columns of the examples plus `cells` and (if `with_text`) `texts`, one row per example.

    A null field stays null (a pair has no text); with `normalize` a present one is normalized first, and an
    example with no field at all scores as the empty text.
    """
    from tremor.operators.perturb import make_perturber

    p = perturber or make_perturber()
    rows = [CLEAN, *grid_rows(grid)]
    predictors = list(predictors)
    n_models = [len(x.models) for x in predictors]
    columns = list(dict.fromkeys([*keep, "id", "language", *FIELDS]))
    source = examples.select(*columns)
    out = [f for f in source.schema.fields if f.name in keep]
    out.append(StructField("cells", ArrayType(CELL)))
    if with_text:
        out.append(StructField("texts", ArrayType(TEXTS)))
    schema = StructType(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, len(rows)):
                yield _one_slice(batch, rows, p, [loaded(x) for x in predictors], n_models, keep, with_text, normalize)

    return source.mapInArrow(run, schema)


def _one_slice(batch, rows, p, scorers, n_models, keep, with_text, normalize) -> pa.RecordBatch:
    n, g = batch.num_rows, len(rows)
    ids = batch.column("id").cast(pa.string()).to_pylist()
    langs = batch.column("language").to_pylist()
    sides = {}
    for side in FIELDS:
        values = batch.column(side).to_pylist()
        if normalize:
            values = [None if v is None else normalized(v) for v in values]
        sides[side] = [p.variants(v, i, lg, rows, side) for v, i, lg in zip(values, ids, langs, strict=True)]
    labels, scores = [], []
    if scorers:
        inputs = [join_fields(sides["premise"][i][k], sides["hypothesis"][i][k], sides["text"][i][k]) for i in range(n) for k in range(g)]
        got = [s(inputs) for s in scorers]
        labels = _interleaved([x[0] for x in got], n_models, n * g)
        scores = _interleaved([x[1] for x in got], n_models, n * g)
    m = sum(n_models)
    cells = pa.StructArray.from_arrays([
        pa.array(np.tile(np.repeat(np.arange(g, dtype=np.int32), m), n)), pa.array(np.tile(np.arange(m, dtype=np.int32), n * g)),
        pa.array(labels, pa.string()), pa.array(scores, pa.float64())], CELL.fieldNames())
    arrays = [batch.column(c) for c in batch.schema.names if c in keep]
    names = [c for c in batch.schema.names if c in keep]
    arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * g * m), cells))
    names.append("cells")
    if with_text:
        flat = pa.StructArray.from_arrays([pa.array([v for x in sides[c] for v in x], pa.string()) for c in FIELDS], list(FIELDS))
        arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * g), flat))
        names.append("texts")
    return pa.RecordBatch.from_arrays(arrays, names)


def _interleaved(parts: list[list], widths: list[int], n: int) -> list:
    """Outputs of several predictors, input by input: all models of the first input, then of the next."""
    if len(parts) == 1:
        return parts[0]
    return [v for i in range(n) for part, w in zip(parts, widths, strict=True) for v in part[i * w:(i + 1) * w]]


# ---- out of the crossing, in the JVM -----------------------------------------------------------

def _named(values, kind: str, at: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), at)


def run_columns(grid, predictors, g: Column, m: Column) -> list[Column]:
    """model, perturbation and level of grid row g and model m."""
    rows, models = [CLEAN, *grid_rows(grid)], [name for x in predictors for name in x.models]
    return [_named(models, "string", m).alias("model"), _named([r[0] for r in rows], "string", g).alias("perturbation"),
            _named([r[1] for r in rows], "double", g).alias("level")]


def long_rows(x: DataFrame, grid, predictors, text: bool = False) -> DataFrame:
    """One row per prediction, clean ones (level 0.0) included; with `text` the fields of its input."""
    keys = [c for c in x.columns if c not in ("cells", "texts")]
    out = x.select(*keys, *(["texts"] if text else []), F.inline("cells"))
    texts = [F.get("texts", F.col("g")).alias("fields")] if text else []
    return out.select(*run_columns(grid, predictors, F.col("g"), F.col("m")), *keys, "prediction", "score", *texts)


def paired_rows(x: DataFrame, grid, predictors) -> DataFrame:
    """One row per (example, model, grid row) with the clean and the perturbed prediction."""
    keys = [c for c in x.columns if c not in ("cells", "texts")]
    m = sum(len(p.models) for p in predictors)
    cells = F.col("cells")
    noisy = F.transform(F.slice(cells, m + 1, F.greatest(F.size(cells) - m, F.lit(0))), lambda c: F.struct(
        c["g"].alias("g"), c["m"].alias("m"), F.get(cells, c["m"])["prediction"].alias("pred_clean"), F.get(cells, c["m"])["score"].alias("score_clean"),
        c["prediction"].alias("pred_pert"), c["score"].alias("score_pert")))
    out = x.select(*keys, F.inline(noisy))
    return out.select(*run_columns(grid, predictors, F.col("g"), F.col("m")), *keys, "pred_clean", "score_clean", "pred_pert", "score_pert")
