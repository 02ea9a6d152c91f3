"""Sink/scan round trips: quotes, newlines, non-ASCII; malformed report files; legacy path metadata."""

import os

from pyspark.sql import functions as F

from tremor.session import scratch_path
from tremor.sources import files


def _runs(spark):
    rows = [("m", "t", "clean", 0.0, "hi", "1", 'a "quoted", text\nwith newline', "1", "1", 0.5),
            ("m", "t", "char_swap", 0.1, "hi", "1", " घर, leading space", "1", "0", 0.25),
            ("m", "t", "char_swap", 0.1, "hi", "2", "", "0", "0", 1.0)]
    return spark.createDataFrame(rows, "model string, task string, perturbation string, level double, "
                                       "language string, id string, text string, label string, prediction string, "
                                       "score double")


def test_prediction_csv_round_trip(spark):
    df = _runs(spark)
    path = files.write_predictions(df, scratch_path(spark, "t-preds"), "csv")
    back = files.read_predictions(spark, path, "csv").select(*df.columns)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    scanned = files.scan_predictions(spark, path).select(*df.columns)
    assert sorted(map(tuple, scanned.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_jsonl_unescaped_non_ascii(spark):
    df = spark.createDataFrame([("1", "घर \"x\"", "t", "train")], "id string, text string, task string, split string")
    path = files.write_jsonl(df, scratch_path(spark, "t-json"), ("task", "split"))
    raw = "".join(open(os.path.join(r, f), encoding="utf-8").read()
                  for r, _, fs in os.walk(path.replace("file:", "")) for f in fs if f.endswith(".json"))
    assert "घर" in raw
    back = files.read_jsonl(spark, path, "id string, text string, task string, split string").collect()[0]
    assert back.text == "घर \"x\""


def test_report_scan_skips_bad_files(spark):
    rep = spark.createDataFrame(
        [("m", "t", "char_swap", 0.1, "en", 0.9, 0.8, 0.1, 0.111, 0.9, 0.8, 0.1, 0.111, 0.95)],
        "model string, task string, perturbation string, level double, language string, acc_clean double, "
        "acc_perturbed double, abs_drop_acc double, rel_drop_acc double, f1_clean double, f1_perturbed double, "
        "abs_drop_f1 double, rel_drop_f1 double, consistency double")
    path = files.write_report_files(rep, scratch_path(spark, "t-rep"))
    local = path.replace("file:", "")
    os.makedirs(os.path.join(local, "m"), exist_ok=True)
    open(os.path.join(local, "m", "t_stats.json"), "w").write('{"train": {"count": 3}}')
    open(os.path.join(local, "m", "t_clean_metrics.json"), "w").write('{"en": {"accuracy": 0.5}}')
    open(os.path.join(local, "m", "broken.json"), "w").write('{"en": {"acc_clean": 0.')
    rows = files.scan_report_files(spark, path).collect()
    assert len(rows) == 1 and rows[0].language == "en" and rows[0].acc_perturbed == 0.8
    long = files.report_long(files.scan_report_files(spark, path)).collect()[0]
    assert (long.model, long.task, long.perturbation, long.level) == ("m", "t", "char_swap", 0.1)
    assert abs(long.rel_drop - 11.1) < 1e-9


def test_legacy_path_metadata(spark):
    paths = ["res/modelA/snp_char_swap_0.1.json", "res/metrics/xnli_clean_metrics.json",
             "res/modelA/notes.json", "res/modelB/copa_0.3.json"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    meta = files.parse_report_path(F.col("path"))
    got = {r.path: (r.model, r.task, r.perturbation, r.level)
           for r in df.select("path", *[v.alias(k) for k, v in meta.items()]).collect()}
    assert got[paths[0]] == ("modelA", "snp", "char_swap", 0.1)
    assert got[paths[1]] == ("unknown", "xnli", "clean", 0.0)
    assert got[paths[2]][1] is None
    assert got[paths[3]] == ("modelB", "copa", "", 0.3)


def test_scan_legacy_predictions(spark, tmp_path):
    folder = tmp_path / "res" / "google%2Fmuril"
    folder.mkdir(parents=True)
    (folder / "snp_char_swap_hi_preds.csv").write_text('id,text,label,prediction,score\n007,"a ""b""\nc",1,0,0.5\n', encoding="utf-8")
    (tmp_path / "res" / "xnli_clean_en_preds.csv").write_text("id,text,label,prediction,score\n1,x,1,1,0.9\n", encoding="utf-8")
    (tmp_path / "res" / "notes.csv").write_text("id\n1\n", encoding="utf-8")
    got = {r.id: r for r in files.scan_legacy_predictions(spark, str(tmp_path / "res")).collect()}
    assert (got["007"].task, got["007"].perturbation, got["007"].language, got["007"].text) == ("snp", "char_swap", "hi", 'a "b"\nc')
    assert got["007"].model == "google/muril" and got["1"].perturbation == "clean" and len(got) == 2


def test_report_scan_keeps_every_language(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "snp_char_swap_0.1.json").write_text('{"en": {"acc_clean": 0.9, "acc_perturbed": 0.8}, "hi": {"acc_perturbed": 0.7}}', encoding="utf-8")
    (tmp_path / "m" / "other.json").write_text('{"en": {"acc_perturbed": 0.1}}', encoding="utf-8")
    assert sorted(r.language for r in files.scan_report_files(spark, str(tmp_path)).collect()) == ["en", "hi"]
    assert files.scan_report_files(spark, str(tmp_path), reports_only=False).count() == 3


def test_confusion_counts_nulls(spark):
    from tremor.operators import metrics as M

    df = spark.createDataFrame([("m", "1", None), ("m", None, "1"), ("m", "1", "1"), (None, "0", "0")], "model string, label string, prediction string")
    got = {(r.model, r.true_label, r.pred_label): r.n for r in M.confusion(df, ["model"]).collect()}
    assert got == {("m", "1", None): 1, ("m", None, "1"): 1, ("m", "1", "1"): 1, ("m", None, None): 0, (None, "0", "0"): 1}


def test_prediction_files_are_packed_tighter_than_at_best_speed(spark, tmp_path):
    """gzip files of texts are smaller than zlib's first level makes them, and read back whole."""
    import glob
    import gzip
    import os
    import random

    draw = random.Random(7)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 9))) for _ in range(400)]
    rows = [("m", "t", "clean", 0.0, "en", str(i), " ".join(draw.choices(words, k=150)), "0", "1", 0.5) for i in range(300)]
    df = spark.createDataFrame(rows, "model string, task string, perturbation string, level double, language string, id string, text string, label string, "
                                     "prediction string, score double")
    path = files.write_predictions(df.coalesce(1), str(tmp_path / "p"), as_they_lie=True, compression="gzip")
    part, = glob.glob(f"{path}/model=m/task=t/perturbation=clean/*.csv.gz")
    with gzip.open(part) as f:
        fast = gzip.compress(f.read(), 1)
    assert os.path.getsize(part) < 0.98 * len(fast)
    assert sorted(map(str, files.read_predictions(spark, path).select(*df.columns).collect())) == sorted(map(str, df.collect()))
