"""SimHash near-duplicates by multi-index hashing.

Fingerprints are 64 bits of the word shingles' XXH64 (majority per bit).  A fingerprint is cut into segments;
each segment's value is a table key, and every fingerprint looks up the small Hamming ball around its own value
in each segment.  With radii r_i where the sum of (r_i + 1) exceeds the bound, two fingerprints within the bound
meet in at least one segment; the complete distance is verified inside the join.  Only distinct fingerprints
are searched, so any number of exact copies is one entry.

A table bucket of more than `hot_bucket` distinct fingerprints is not paired; its members, and whoever looks it
up, meet over balls of the whole fingerprint instead (for a bound of two: two fingerprints are within two bits
exactly if their balls of radius one share a point, and a point is shared by at most 65).  Nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from tremor.llm.common import appended, fresh, slices, with_fields, without, written
from tremor.llm.graph import components

BITS = 64


def simhash(texts: list[str], shingle: int, seed: int) -> np.ndarray:
    """Fingerprints of whole texts (unsigned 64-bit); a text without words has fingerprint zero."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    one = xxhash.xxh64_intdigest
    for i, t in enumerate(texts):
        words = t.encode("utf-8").lower().split()  # bytes: only A-Z and the six ASCII blanks count
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            hashes.append(one(joined, seed))
            counts[i] = 1
            continue
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-1]])[:len(words) - shingle + 1].tolist()
        hashes += [one(joined[a:b], seed) for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist(), strict=True)]
        counts[i] = len(starts)
    out = np.zeros(len(texts), np.uint64)
    some = counts > 0
    if some.any():
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = (np.cumsum(counts) - counts)[some]
        ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > counts[some][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = 3, seed: int = 42) -> DataFrame:
    """`df` with the 64-bit fingerprint of its whole texts (a long, two's complement); null texts count as empty."""
    df = without(df, out) if out != text else df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text):
            yield appended(batch, [pa.array(simhash(texts, shingle, seed).view(np.int64))], [out])

    return df.mapInArrow(run, with_fields(df, StructField(out, LongType())))


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def _segments(max_bits: int, count: int) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of each segment; radii share out the bound: sum(radius + 1) = max_bits + 1."""
    widths = [BITS // count + (i < BITS % count) for i in range(count)]
    spare = max(0, max_bits + 1 - count)
    radii = [spare // count + (i < spare % count) for i in range(count)]
    used = [i for i in range(count) if i <= max_bits]  # more segments than needed: some may be left out
    return [(sum(widths[:i]), widths[i], radii[i]) for i in used]


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def _exploded(fp: Column, ball: list[int]) -> Column:
    return F.explode(F.array(*[fp.bitwiseXOR(F.lit(_signed(m))) for m in ball]))


def links(fps: DataFrame, max_bits: int = 2, segments: int = 2, hot_bucket: int = 4096) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (column fp) that connect all within `max_bits` of each other.

    Outside hot buckets every such pair is a row; inside them the pairs of a star per shared point, which
    connect the same fingerprints.  Repeated rows possible (a pair that meets twice).
    """
    if max_bits % 2 or not 1 <= segments <= max_bits + 1:
        raise ValueError("an even bound and at most bound + 1 segments")
    fp, parts = F.col("fp"), _segments(max_bits, segments)

    def value(col: Column, k: int) -> Column:
        shift, width, _ = parts[k]
        return F.shiftrightunsigned(col, shift).bitwiseAND(F.lit(_signed((1 << width) - 1)))

    entries = [fps.select(F.lit(k).alias("seg"), value(fp, k).alias("val"), fp.alias("b")) for k in range(len(parts))]
    probes = [fps.select(F.lit(k).alias("seg"), _exploded(value(fp, k), _ball(parts[k][1], parts[k][2])).alias("val"), fp.alias("a"))
              for k in range(len(parts))]
    table, ask = entries[0], probes[0]
    for e, p in zip(entries[1:], probes[1:], strict=True):
        table, ask = table.union(e), ask.union(p)
    spark = fps.sparkSession
    hot = written(spark, table.groupBy("seg", "val").agg(F.count("*").alias("n")).filter(F.col("n") > hot_bucket).select("seg", "val"), "hot")
    within = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    if hot.isEmpty():
        return ask.join(table.hint("merge"), ["seg", "val"]).filter(within & (F.col("a") < F.col("b"))).select("a", "b")
    found = (ask.join(table.join(hot, ["seg", "val"], "left_anti").hint("merge"), ["seg", "val"]).filter(within & (F.col("a") != F.col("b")))
             .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    around = ask.join(hot, ["seg", "val"], "left_semi").select("a").distinct()
    whole = _ball(BITS, max_bits // 2)
    points = around.select(F.col("a").alias("b"), _exploded(F.col("a"), whole).alias("point"))
    first = points.groupBy("point").agg(F.min("b").alias("a"), F.max("b").alias("z")).filter("a < z").drop("z")
    star = points.join(first.hint("merge"), "point").filter(within & (F.col("a") < F.col("b"))).select("a", "b")
    return found.union(star.distinct())


def near_duplicates(prints: DataFrame, key: str = "doc_id", fingerprint: str = "fingerprint", max_bits: int = 2, segments: int = 2,
                    hot_bucket: int = 4096, component: str = "component_id") -> DataFrame:
    """`prints` with `component`: the smallest `key` among all rows whose fingerprint can be reached over links.

    Rows with a null key take part; a component of null keys only has a null id.  Empty table: empty result.
    `prints` is read several times: pass a written table.  Tables that grow with the rows are merged, never broadcast:
    the driver holds none of them.
    """
    spark = prints.sparkSession
    prints = without(prints, component)
    distinct = written(spark, prints.groupBy(F.col(f"`{fingerprint}`").alias("fp")).agg(F.min(f"`{key}`").alias("least")), "fps")
    root = components(links(distinct.select("fp"), max_bits, segments, hot_bucket))
    linked = distinct.join(root.hint("merge"), F.col("fp") == F.col("node")).select("fp", "root", "least")
    best = linked.groupBy("root").agg(F.min("least").alias("best"))
    ids = written(spark, distinct.join(linked.join(best.hint("merge"), "root").select("fp", "best").hint("merge"), "fp", "left")
                  .select("fp", F.coalesce("best", "least").alias("id")), "component")
    fp, cid = fresh(prints, "fp", "id")
    ids = ids.select(F.col("fp").alias(fp), F.col("id").alias(cid))
    return (prints.join(ids.hint("merge"), F.col(f"`{fingerprint}`") == F.col(fp))
            .select(*[F.col(f"`{c}`") for c in prints.columns], F.col(cid).alias(component)))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """`docs` with one row of each component of near duplicates: the smallest key's (rows without a key last);
    of rows with equal keys, one."""
    spark = docs.sparkSession
    row, fp, cid = fresh(docs, "row", "fingerprint", "component_id")
    rows = written(spark, docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    prints = written(spark, fingerprints(rows.select(row, key, text), text, fp, shingle).select(row, key, fp), "prints")
    ids = near_duplicates(prints, row, fp, max_bits, component=cid)
    first = F.min(F.struct(F.col(key).isNull(), F.col(key), F.col(row))).getField(row)
    keep = written(spark, ids.groupBy(cid).agg(first.alias(row)).select(row), "keep")
    return rows.join(keep.hint("shuffle_hash"), row, "left_semi").drop(row)  # texts are dealt once, not sorted
