"""Approximate nearest neighbours over shifted space-filling curves.

Vectors are projected (a seeded random rotation per curve), shifted and ordered along a Hilbert curve; Spark
range-partitions each ordering and every vector gets its rank.  A query looks at all vectors within a window of
ranks around its own on every curve: windows are cut into blocks of ranks, a block's candidates meet a bounded
chunk of the queries that reach it, and the blocks' best are merged and reranked by exact cosine.

The window is fitted, alike at every size: for a bounded sample of queries the true neighbours are found by brute
force over all vectors, in blocks, and the window is the least that would have reached `recall` of them on some
curve.  Vectors that lie along few directions get narrow windows; directionless ones need a large share of the
ranks, and get it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.llm.common import written

CURVES = 4
DIMS, BITS = 8, 7
BLOCK = 2048
#: Queries that a block's candidates meet at once, about; and the most ranks that such a chunk spans.
CHUNK_QUERIES, CHUNK_RANKS = 1024, 1 << 16
SAMPLE_QUERIES = 256
RECALL = 0.97


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer cells (rows of d coordinates below 2**bits; d * bits under 63)."""
    x, d = cells.astype(np.int64).copy(), cells.shape[1]
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations from the coarsest level down
        for i in range(d):
            hit = (x[:, i] & q) != 0
            x[hit, 0] ^= q - 1
            swap = (x[~hit, 0] ^ x[~hit, i]) & (q - 1)
            x[~hit, 0] ^= swap
            x[~hit, i] ^= swap
        q >>= 1
    for i in range(1, d):  # Gray code
        x[:, i] ^= x[:, i - 1]
    flip, q = np.zeros(len(x), np.int64), 1 << (bits - 1)
    while q > 1:
        flip[(x[:, d - 1] & q) != 0] ^= q - 1
        q >>= 1
    x ^= flip[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


def curve_keys(vectors: np.ndarray, curve: int) -> np.ndarray:
    """Keys of unit vectors on one curve: rotated, cut to a few dimensions, shifted, put into cells."""
    dim = vectors.shape[1]
    rng = np.random.default_rng(1000 + curve)
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0][:, :min(DIMS, dim)]
    at = vectors @ turn * (np.sqrt(dim) / 8) + 0.5 + (rng.random(turn.shape[1]) - 0.5) / 4
    return hilbert_keys(np.clip(at * (1 << BITS), 0, (1 << BITS) - 1), BITS)


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest component near one: its cosines stay the same to the
    last bit, and no square leaves the range of doubles."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = _scaled(vectors)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): rows with a key and a vector of finite components that isn't zero, in double precision.

    Vectors must have one length: that of most of them (of equally many, the longer); others are left out.
    """
    v = F.col("v")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = (vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
            .filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(good, F.lit(False))))
    most = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows if most is None else rows.filter(F.size(v) == most["n"])


def ranks(vectors: DataFrame, curves: int = CURVES) -> DataFrame:
    """(curve, rank, vec_id, v): every vector's place on each curve, from 0."""
    spark = vectors.sparkSession

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in range(0, len(b), 4096):
                rows = b.slice(part, 4096)
                values = np.stack(rows.column(1).to_numpy(zero_copy_only=False))
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), c, np.int32)), pa.array(curve_keys(_unit(values), c)),
                                                      *rows.columns], names=["curve", "key", "vec_id", "v"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(b), part, np.int32)),
                                              pa.array(np.arange(seen, seen + len(b))), b.column(2), b.column(3)],
                                             names=["curve", "part", "place", "vec_id", "v"])
            seen += len(b)

    order = ["curve", "key", "vec_id"]
    rows = (vectors.mapInArrow(keyed, "curve int, key long, vec_id long, v array<double>").repartitionByRange(*order)
            .sortWithinPartitions(*order).mapInArrow(numbered, "curve int, part int, place long, vec_id long, v array<double>"))
    rows = written(spark, rows, "curves")
    # a partition's first rank on a curve: rows of the curve in the partitions before, less its place in its own
    sizes = rows.groupBy("curve", "part").agg(F.count("*").alias("n"), F.min("place").alias("low"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("curve", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("start"))
    return written(spark, rows.join(starts, ["curve", "part"]).select("curve", (F.col("start") + F.col("place")).alias("rank"), "vec_id", "v"),
                   "ranks")


def _best(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """Each query's k best among the vectors by (cosine, smaller id), itself left out."""
    order = np.argsort(ids, kind="stable")
    ids, unit, queries, vectors = ids[order], _unit(vectors[order]), _scaled(queries), _scaled(vectors)
    out = []
    for at in range(0, len(queries), 256):
        score = _unit(queries[at:at + 256]) @ unit.T
        score[query_ids[at:at + 256, None] == ids[None, :]] = -np.inf
        rough = np.partition(score, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
        for i, row in enumerate(score):
            good = np.flatnonzero((row >= rough[i] - 1e-9) & np.isfinite(row))
            exact = np.array([float(np.dot(queries[at + i], vectors[order[j]])) / (np.linalg.norm(queries[at + i]) * np.linalg.norm(vectors[order[j]])) for j in good])
            take = np.lexsort((ids[good], -exact))[:k]
            out.append(pd.DataFrame({"query_id": query_ids[at + i], "vec_id": ids[good[take]], "score": exact[take]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


_FOUND = "query_id long, vec_id long, score double"


def _meet(queries: DataFrame, vectors: DataFrame, on: list[str], k: int) -> DataFrame:
    """Per group (bounded on both sides) each query's best."""

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        return _best(np.stack(q["v"]), q["vec_id"].to_numpy(), np.stack(c["v"]), c["vec_id"].to_numpy(), k)

    queries = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns]).toDF(*queries.columns)  # attributes of its own
    return queries.groupBy(*on).cogroup(vectors.groupBy(*on)).applyInPandas(run, _FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fit_window(placed: DataFrame, is_query: Column, k: int, recall: float = RECALL, sample: int = SAMPLE_QUERIES) -> int:
    """The least window of ranks that reaches `recall` of the sampled queries' true neighbours on some curve."""
    one = placed.filter("curve = 0")
    chosen = one.filter(is_query).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("vec_id", "v")
    chosen = written(placed.sparkSession, chosen, "sample")
    blocks = one.select("vec_id", "v", F.floor(F.col("rank") / BLOCK).alias("block"))
    last = one.agg(F.floor(F.max("rank") / BLOCK).alias("n")).first()["n"]
    asked = chosen.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last or 0))))
    true = written(placed.sparkSession, _top(_meet(asked, blocks, ["block"], k), k), "true")
    here = placed.select("curve", "rank", "vec_id")
    gaps = (true.select("query_id", "vec_id").join(here, "vec_id").withColumnRenamed("rank", "there")
            .join(here.select("curve", "rank", F.col("vec_id").alias("query_id")), ["query_id", "curve"])
            .groupBy("query_id", "vec_id").agg(F.min(F.abs(F.col("rank") - F.col("there"))).alias("gap")))
    least = gaps.agg(F.percentile("gap", recall).alias("w")).first()["w"]
    return int(np.ceil(least or 0)) + 1


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", curves: int = CURVES,
            recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found by cosine, ties to the smaller id.

    `is_query` is a condition on vec_id.  Null keys, and vectors that are null, empty, zero or hold null or
    non-finite components, take no part.  Equal vectors have ranks of their own, so a hot vector is spread.
    Repeated keys count as rows; a result names a key once.  An empty table gives no rows.
    """
    placed = ranks(usable(vectors, key, vector), curves)
    window = fit_window(placed, is_query, k, recall)
    size = placed.filter("curve = 0").agg(F.count("*").alias("rows"), F.count_if(is_query).alias("queries")).first()
    span = min(CHUNK_RANKS, max(BLOCK, CHUNK_QUERIES * size["rows"] // max(1, size["queries"])))
    queries = placed.filter(is_query).withColumn("chunk", F.floor(F.col("rank") / span))
    lo, hi = F.floor((F.col("chunk") * span - window) / BLOCK), F.floor(((F.col("chunk") + 1) * span - 1 + window) / BLOCK)
    hi = F.least(hi, F.lit(size["rows"] // BLOCK))
    asked = queries.select("curve", "chunk", "vec_id", "v", F.explode(F.sequence(F.greatest(lo, F.lit(0)), hi)).alias("block"))
    candidates = placed.withColumn("block", F.floor(F.col("rank") / BLOCK))
    low = F.floor((F.col("block") * BLOCK - window) / span)
    high = F.least(F.floor(((F.col("block") + 1) * BLOCK - 1 + window) / span), F.lit(size["rows"] // span))
    used = queries.select("curve", "chunk").distinct()
    spread = candidates.select("curve", "block", "vec_id", "v", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)).alias("chunk"))
    found = _meet(asked, spread.join(used, ["curve", "chunk"], "left_semi"), ["curve", "block", "chunk"], k)
    return _top(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
