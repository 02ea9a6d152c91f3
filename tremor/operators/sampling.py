"""Splits, limits and per-group samples (W1-W4) without global sorts or single-task windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.functions import fixed, rng

#: A draw has 31 bits: a high digit of 15 and a low one of 16.
DIGIT_BITS = 16
#: Copies of one row that one generator gives at most.
CHUNK = 1 << 16


def split_hash(df: DataFrame, fraction: float = fixed.VALIDATION_FRACTION, seed=fixed.DEFAULT_SEED,
               id_col: str = "id") -> DataFrame:
    """split = 'validation' iff u(seed, 'split', id) < fraction (approximate size, no shuffle)."""
    k = rng.row_key(seed, "split", id_col)
    return df.withColumn("split", F.when(rng.draw(k, 0) < rng.threshold(fraction), F.lit("validation"))
                         .otherwise(F.lit("train")))


def _cut(hist: DataFrame, group: str, digit: str, need: Column) -> DataFrame:
    """(group, digit, take): the digit in which a group's running count reaches its `need`, and how many of that
    digit's rows belong below.  `hist` has one row per digit: at most 2^16 a group, whatever the input."""
    every = Window.partitionBy(group)
    upto = every.orderBy(digit).rowsBetween(Window.unboundedPreceding, 0)
    x = hist.withColumns({"_need": need, "_upto": F.sum("_c").over(upto)})
    before = F.col("_upto") - F.col("_c")
    return x.filter((F.col("_upto") >= F.col("_need")) & (before < F.col("_need"))).select(group, digit, (F.col("_need") - before).alias("_take"))


def split_exact(df: DataFrame, fraction: float = fixed.VALIDATION_FRACTION, seed=fixed.DEFAULT_SEED,
                group: str = "task", id_col: str = "id") -> DataFrame:
    """Exactly ceil(fraction * N) rows per group go to 'validation': the smallest (u, id).

    Radix selection: a histogram of the high digit of the draw names the digit in which the last validation row lies,
    a second one, of the low digit within it, the draw itself; what is left is a filter, `u` below or above that draw.
    Only rows on the very draw need more: those of a few ids, or of one id's copies.  They are counted by content
    (equal rows collapse before any shuffle), a digit of the content's hash finds the place among them as before, and
    a content's copies are dealt out by number again.  Nothing is sorted or ranked but histograms and, in many small
    groups, the contents of one digit; nothing runs before the result is asked for.

    Rows that a null group holds are all 'train'.
    """
    columns = df.columns if "split" in df.columns else [*df.columns, "split"]
    df = df.drop("split")
    u, hi, lo, cut, take, m = fresh(df, "u", "hi", "lo", "cut", "take", "m")
    h, d, before, v = fresh(df, "h", "d", "before", "v")
    x = df.withColumn(u, rng.draw(rng.row_key(seed, "split", id_col), 0))
    digits = x.select(group, F.shiftright(u, DIGIT_BITS).alias(hi), u)
    total = F.sum("_c").over(Window.partitionBy(group))
    first = _cut(digits.groupBy(group, hi).agg(F.count(F.lit(1)).alias("_c")), group, hi, F.ceil(F.lit(float(fraction)) * total))
    # one row per group, a configuration-level key (the tasks of `scan_task`): a shuffle join would be one hot task
    inside = (digits.join(F.broadcast(first.withColumnRenamed("_take", take)), [group, hi])
              .groupBy(group, F.col(u).alias(lo)).agg(F.count(F.lit(1)).alias("_c"), F.any_value(take).alias(take)))
    second = F.broadcast(_cut(inside, group, lo, F.col(take)).select(group, F.col(lo).alias(cut), F.col("_take").alias(take)))
    x = x.join(second, group, "left")
    side = F.when(F.col(u) < F.col(cut), F.lit("validation")).otherwise(F.lit("train"))
    rest = x.filter(F.col(cut).isNull() | (F.col(u) != F.col(cut))).select(*df.columns, side.alias("split"))

    content = [F.col(f"`{c}`") for c in df.columns]
    tied = (x.filter(F.col(u) == F.col(cut)).groupBy(*df.columns).agg(F.count(F.lit(1)).alias(m), F.any_value(take).alias(take))
            .withColumn(h, F.xxhash64(*content)).withColumn(d, F.shiftrightunsigned(h, 64 - DIGIT_BITS)))
    by_digit = tied.groupBy(group, id_col, d).agg(F.sum(m).alias("_c"))
    run = Window.partitionBy(group).orderBy(id_col, d).rowsBetween(Window.unboundedPreceding, -1)
    g2, id2, d2 = fresh(df, "g2", "id2", "d2")
    by_digit = by_digit.select(F.col(group).alias(g2), F.col(id_col).alias(id2), F.col(d).alias(d2), F.coalesce(F.sum("_c").over(run), F.lit(0)).alias(before))
    own = Window.partitionBy(group, id_col, d).orderBy(h, *content).rowsBetween(Window.unboundedPreceding, -1)
    same = (F.col(group) == F.col(g2)) & F.col(id_col).eqNullSafe(F.col(id2)) & (F.col(d) == F.col(d2))
    ranked = tied.join(by_digit, same).withColumn(
        v, F.greatest(F.lit(0), F.least(F.col(m), F.col(take) - F.col(before) - F.coalesce(F.sum(m).over(own), F.lit(0)))))
    (n,) = fresh(df, "n")
    copies = repeated(ranked.select(*df.columns, m, v), m, n)
    side = F.when(F.col(n) < F.col(v), F.lit("validation")).otherwise(F.lit("train"))
    return rest.unionByName(copies.select(*df.columns, side.alias("split"))).select(*columns)


def repeated(df: DataFrame, times: str, out: str) -> DataFrame:
    """Every row `times` times, numbered from 0 in `out`; the copies of one row come out of many tasks."""
    (chunk,) = fresh(df, "chunk")
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(times) - 1) / CHUNK).cast("bigint"))
    x = df.filter(F.col(times) > 0).withColumn(chunk, F.explode(chunks))
    x = x.repartition(*[F.col(f"`{c}`") for c in x.columns])
    last = F.least(F.col(times), (F.col(chunk) + 1) * CHUNK) - 1
    return x.withColumn(out, F.explode(F.sequence(F.col(chunk) * CHUNK, last))).drop(chunk)


def with_row_keys(df: DataFrame, out: str = "id", prefix: str = "row-") -> DataFrame:
    """`df` with a key of its own for every row in `out` (a column of that name is replaced).

    The key is the hash of the row's content and the row's number among equal rows: the same in any order, partitioning
    or retry, without a sort.  Equal rows are counted (they collapse before the shuffle, so a group of copies is never
    gathered) and come out again by number; being equal, it does not matter which is which.
    """
    cols = [c for c in df.columns if c.lower() != out.lower()]
    m, n = fresh(df, "m", "n")
    marked = F.concat_ws("\x1f", *[F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in cols])
    x = repeated(df.groupBy(*[F.col(f"`{c}`") for c in cols]).agg(F.count(F.lit(1)).alias(m)), m, n)
    key = F.concat(F.lit(prefix), F.md5(marked), F.lit("-"), F.col(n).cast("string"))
    return x.withColumn(out, key).select(*[F.col(f"`{c}`") for c in df.columns], *([out] if out.lower() not in [c.lower() for c in df.columns] else []))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns that clash with none of `df`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while "_" + name in taken:
            name = "_" + name
        out.append("_" + name)
    return out


def first_per_group(df: DataFrame, keys, order, n: int) -> DataFrame:
    """First n rows per group; Spark plans a WindowGroupLimit below the shuffle, so each map task keeps at most
    n rows per group before anything moves (a hot group costs no more than a cold one)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def limit_per_task(df: DataFrame, n: int | None, key: str = "task") -> DataFrame:
    """First n examples per task by id; n None or <= 0 keeps everything."""
    if n is None or n <= 0:
        return df
    return first_per_group(df, [key], [F.col("id")], n)


def seeded_sample(df: DataFrame, keys, n: int, seed=fixed.DEFAULT_SEED, id_col: str = "id") -> DataFrame:
    """min(n, group size) rows per group, chosen by the counter-based draw u(seed, 'sample', id)."""
    k = rng.row_key(seed, "sample", id_col)
    x = df.withColumn("_s", rng.draw(k, 0))
    return first_per_group(x, keys, [F.col("_s"), F.col(id_col)], n).drop("_s")
