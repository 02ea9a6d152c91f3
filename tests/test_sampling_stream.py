"""Exact split sizes, limits, and the streaming path's restart from its checkpoint."""

import math

from pyspark.sql import functions as F

from tremor.operators import sampling
from tremor.plans import views as V
from tremor.session import scratch_path
from tremor.sources import tables
from tremor.streaming import stream as ST


def test_split_exact_sizes(spark, sf_small):
    ex = V.task_examples(spark, sf_small)
    out = sampling.split_exact(ex, fraction=0.1).groupBy("task").agg(
        F.count_if(F.col("split") == "validation").alias("v"), F.count(F.lit(1)).alias("n")).collect()
    for r in out:
        assert r.v == math.ceil(0.1 * r.n)


def test_split_exact_is_smallest_draws(spark, sf_small):
    ex = V.examples(spark, sf_small)
    a = {r.id for r in sampling.split_exact(ex, 0.25).filter("split = 'validation'").collect()}
    b = {r.id for r in sampling.split_exact(ex.repartition(3), 0.25).filter("split = 'validation'").collect()}
    assert a == b


def test_limit_semantics(spark, sf_small):
    ex = V.task_examples(spark, sf_small)
    assert sampling.limit_per_task(ex, 0).count() == ex.count()
    assert sampling.limit_per_task(ex, None).count() == ex.count()
    got = sampling.limit_per_task(ex, 3).groupBy("task").count().collect()
    assert all(r["count"] == 3 for r in got)


def test_stream_restart_emits_nothing_new(spark, sf_small):
    out, ckpt = scratch_path(spark, "t-stream-out"), scratch_path(spark, "t-stream-ckpt")
    labels = tables.table(spark, sf_small, "labels")

    def run():
        s = ST.scored_stream(ST.document_stream(spark, sf_small), labels, "char_swap", 0.1, "m", 0.2)
        ST.run_available(s, out, ckpt)
        return spark.read.parquet(out).count()

    first = run()
    assert first == labels.join(tables.table(spark, sf_small, "documents"), "doc_id").count()
    assert run() == first


def test_split_exact_with_a_hot_group_of_copies(spark):
    rows = [("t", "dup", f"copy{i % 3}") for i in range(900)] + [("t", f"u{i}", "x") for i in range(100)]
    df = spark.createDataFrame(rows, "task string, id string, text string").repartition(5)
    for frac in (0.05, 0.5, 0.95):
        out = sampling.split_exact(df, fraction=frac)
        assert out.count() == 1000
        assert out.filter("split = 'validation'").count() == math.ceil(frac * 1000)
    out = sampling.split_exact(df, fraction=0.5)
    assert sorted(map(tuple, out.select("id", "text").collect())) == sorted((r[1], r[2]) for r in rows)


def _plain_split(rows, fraction):
    """Ids of the validation rows by sorting (draw, id), with multiplicity."""
    from collections import Counter

    from tremor.functions import rng

    draw = lambda i: int(rng.np_draws(rng.py_row_key(42, "split", i), 1)[0])
    ids = sorted((r[0] for r in rows), key=lambda i: (draw(i), i))
    return Counter(ids[:math.ceil(fraction * len(ids))])


def test_split_exact_equals_sorting(spark, monkeypatch):
    """Single ids, groups of copies at and around the cut (equal and unequal rows), all fractions; copies come out of
    small chunks here."""
    import random
    from collections import Counter

    monkeypatch.setattr(sampling, "CHUNK", 4)
    r = random.Random(3)
    for fraction in (0.0, 0.1, 0.37, 1.0):
        rows = [(str(r.randint(0, 40)), r.choice("ab"), "t") for _ in range(150)] + [("hot", r.choice("xyz"), "t") for _ in range(150)]
        df = spark.createDataFrame(rows, "id string, text string, task string")
        out = sampling.split_exact(df, fraction).collect()
        assert Counter((x.id, x.text) for x in out) == Counter(x[:2] for x in rows)
        assert Counter(x.id for x in out if x.split == "validation") == _plain_split(rows, fraction)
        again = sampling.split_exact(df.repartition(7), fraction).collect()
        assert Counter(map(tuple, out)) == Counter(map(tuple, again))


def test_split_exact_odd_tables(spark):
    df = spark.createDataFrame([("1", None, None), ("1", None, "t"), (None, "x", "t"), (None, "x", "t")], "id string, u string, task string")
    out = sampling.split_exact(df.withColumn("m", F.lit(1)).withColumn("_h", F.lit(2)), 0.5).collect()
    assert len(out) == 4 and sum(x.split == "validation" for x in out if x.task == "t") == 2
    assert sampling.split_exact(df.limit(0)).collect() == []


def test_split_runs_nothing_before_it_is_asked(spark):
    df = spark.range(1000).selectExpr("string(id) as id", "concat('t', id % 2) as task")
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    out = sampling.split_exact(df)
    assert len(tracker.getJobIdsForGroup(None)) == before
    p = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in p and "RDDScan" not in p


def test_constant_ids_get_keys_split_and_pair(spark):
    """A table whose rows all fall back to one id: keys of their own, a split of about 10/90, and pairs without error."""
    from tremor.operators import one_pass as OP
    from tremor.operators import pairs as PR

    rows = [(f"text {i % 700}",) for i in range(1400)] + [("copy",)] * 600 + [(None,), ("",)]
    bare = spark.createDataFrame(rows, "text string")
    ex = tables.standardize(bare, "bare", row_keys=True)
    keys = [r.id for r in ex.collect()]
    assert len(set(keys)) == len(rows) and ex.columns == tables.EXAMPLE_COLUMNS
    other = tables.standardize(bare.repartition(5), "bare", row_keys=True)
    assert sorted(map(str, other.collect())) == sorted(map(str, ex.collect()))
    share = sampling.split_hash(ex).filter("split = 'validation'").count() / len(rows)
    assert 0.07 < share < 0.13 and sampling.split_exact(ex).filter("split = 'validation'").count() == math.ceil(0.1 * len(rows))
    ps = V.rule_models()
    runs = OP.long_rows(OP.crossed(ex, [("char_swap", 0.1)], ps), [("char_swap", 0.1)], ps)
    assert PR.pair_join(runs).count() == 2 * len(rows)
    assert {r.id for r in tables.standardize(bare, "bare").select("id").distinct().collect()} == {"-1"}


def test_stream_reads_a_folder_of_files(spark, sf_small, tmp_path):
    """A table may be one file or a folder of files; both are streamed."""
    tables.table(spark, sf_small, "documents").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out, ckpt = scratch_path(spark, "t-stream-out"), scratch_path(spark, "t-stream-ckpt")
    labels = tables.table(spark, sf_small, "labels")
    ST.run_available(ST.scored_stream(ST.document_stream(spark, str(tmp_path)), labels, "char_swap", 0.1, "m", 0.2), out, ckpt)
    assert spark.read.parquet(out).count() == labels.join(tables.table(spark, sf_small, "documents"), "doc_id").count() > 0
