"""Number of files a sink leaves, files a scan opens, tasks of any name from files."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from tremor.sources import files, tables

RUNS = ("id string, text string, label string, prediction string, score double, level double, language string, model string, "
        "task string, perturbation string")


def test_a_directory_is_one_file_unless_it_is_large(spark, tmp_path):
    """From 40 partitions into 3 directories; one of them holds nine tenths of the rows and is cut by its bytes."""
    df = spark.range(0, 4000, 1, 40).selectExpr("string(id) as id", "concat_ws('', transform(sequence(1, 8), i -> md5(concat(id, '-', i)))) as text", "'1' as label", "'1' as prediction", "0.5 as score",
                                                "0.1 as level", "'en' as language", "'m' as model", "'t' as task",
                                                "case when id % 20 = 0 then 'a' when id % 20 = 1 then 'b' else 'c' end as perturbation")
    counts = {}
    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    for size in ("64MB", "100KB"):
        old = {n: spark.conf.get(n) for n in names}
        for n in names:
            spark.conf.set(n, size)
        try:
            path = files.write_predictions(df, str(tmp_path / size))
        finally:
            for n in names:
                spark.conf.set(n, old[n])
        counts[size] = {p: len(glob.glob(f"{path}/model=m/task=t/perturbation={p}/*.csv")) for p in "abc"}
        assert files.read_predictions(spark, path).count() == 4000
    assert counts["64MB"] == {"a": 1, "b": 1, "c": 1}
    assert counts["100KB"]["c"] > 1 and sum(counts["100KB"].values()) <= 3 + int(spark.conf.get("spark.sql.shuffle.partitions"))


def _opened(df):
    """Files that the scans of an executed plan read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    out = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.metrics().contains("numFiles"):
            out += leaf.metrics().apply("numFiles").value()
    return out


def test_a_task_filter_opens_its_files_only(spark, tmp_path):
    for model in ("m1", "org_m2"):
        for name in ("news_clean_en", "news_char_swap_0.1_en", "news_char_swap_0.1_hi", "nli_clean_en", "newsy_clean_en", "a b_clean_en"):
            os.makedirs(tmp_path / model, exist_ok=True)
            with open(tmp_path / model / f"{name}_preds.csv", "w") as f:
                f.write('id,text,label,prediction,score\n01,"a ""q""\nb",1,0,0.5\n')
    every = files.scan_legacy_predictions(spark, str(tmp_path))
    assert every.count() == 12 and every.filter("id = '01'").count() == 12
    news = files.scan_legacy_predictions(spark, str(tmp_path), task="news")
    assert {(r.task, r.perturbation, r.language, r.model) for r in news.collect()} == {
        ("news", p, lg, m) for m in ("m1", "org_m2") for p, lg in (("clean", "en"), ("char_swap_0.1", "en"), ("char_swap_0.1", "hi"))}
    assert _opened(files.scan_legacy_predictions(spark, str(tmp_path), task="news")) == 6
    assert _opened(files.scan_legacy_predictions(spark, str(tmp_path), task="news", language="hi")) == 2
    assert files.scan_legacy_predictions(spark, str(tmp_path), task="a b").count() == 2
    assert files.list_files(spark, str(tmp_path), "*_preds.csv").count() == 12


def test_named_reports_round_trip(spark, tmp_path):
    rows = [("org/m", "t_x", "char swap", 0.1, "en"), ("m2", "t", "a", 0.5, "hi"), ("m2", "t", "a", 0.5, "en")]
    report = spark.createDataFrame(rows, "model string, task string, perturbation string, level double, language string")
    report = report.withColumns({f: F.lit(0.25) for f in files.METRIC_FIELDS})
    root = files.write_legacy_reports(report, str(tmp_path / "reports"))
    assert os.path.isfile(f"{root}/m2/t_a_0.5.json") and os.path.isfile(f"{root}/metrics/t_clean_metrics.json")
    with open(f"{root}/m2/t_a_0.5.json") as f:
        assert set(json.load(f)) == {"en", "hi"}
    got = files.scan_report_files(spark, root)
    assert sorted(r.language for r in got.collect()) == ["en", "en", "hi"]


def test_tasks_from_files(spark, tmp_path):
    for split, rows in (("train", [("x", 1, "en"), ("y", 0, None)]), ("validation", [("z", 1, "hi")])):
        spark.createDataFrame(rows, "sentence string, label int, language string").write.json(str(tmp_path / "task.json" / split))
    schema = "sentence string, label int, language string"
    t = tables.load_task(spark, str(tmp_path / "task.json"), "mytask", schema=schema)
    assert t.columns == tables.EXAMPLE_COLUMNS
    assert sorted((r.text, r.split, r.label, r.task) for r in t.collect()) == [("x", "train", "1", "mytask"), ("y", "train", "0", "mytask"), ("z", "validation", "1", "mytask")]
    assert len({r.id for r in t.collect()}) == 3
    assert [r.text for r in tables.pick_split(t).collect()] == ["z"]
    only = tables.load_task(spark, str(tmp_path / "task.json"), "mytask", schema=schema, languages=["unknown", "hi"])
    assert sorted(r.text for r in only.collect()) == ["y", "z"]
    pairs = spark.createDataFrame([("7", "p", "h", 1)], "idx string, sentence1 string, sentence2 string, label int")
    pairs.write.parquet(str(tmp_path / "pairs.parquet"))
    r = tables.load_task(spark, str(tmp_path / "pairs.parquet"), "wnli", "nli").first()
    assert (r.id, r.premise, r.hypothesis, r.text, r.split) == ("7", "p", "h", None, "train")
    with pytest.raises(ValueError, match="schema"):
        tables.load_task(spark, str(tmp_path / "x.csv"), "t")
