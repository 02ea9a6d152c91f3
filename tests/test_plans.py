"""Plan checks: pushdown, broadcast of the small grids, no Python on the stored-analysis path, bounded windows."""

import re

from tremor.plans import views as V
from tremor.plans.stored import stored_runs, stored_texts
from tremor.operators import metrics as M
from tremor.operators import pairs as PR
from tremor.operators import reports as RP
from tremor.operators import sampling


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def executed(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


def exchanges(p):
    return len(re.findall(r"\bExchange (?:hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)", p))


def test_paired_crosses_into_python_once(spark, sf_small):
    """All tasks, grid rows and models in one Python stage; the grid and the models are no joins."""
    p = plan(V.paired(spark, sf_small))
    assert p.count("MapInArrow") == 1 and "ArrowEvalPython" not in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    one_row = spark.createDataFrame([("char_swap", 0.1)], "perturbation string, level double")
    assert "CartesianProduct" not in plan(V.paired(spark, sf_small, grid_df=one_row))


def test_several_predictors_cross_once(spark, sf_small):
    from tremor.plans import experiment as X

    p = plan(X.experiment_plugin(spark, sf_small))
    assert p.count("MapInArrow") == 1 and "ArrowEvalPython" not in p


def test_pairing_needs_no_exchange_and_no_text(spark, sf_small):
    """On the bucketed table rows are paired where they lie; without a text column asked for, none is read."""
    x = PR.pair_join(stored_runs(spark, sf_small)).select("id", "prediction_clean", "prediction_pert")
    p = executed(x)
    assert exchanges(p) == 0 and "Join" not in p and "SortAggregate" not in p
    assert "texts" not in p and "ReadSchema: struct<task:string,language:string,id:string,cells" in p


def test_summaries_take_one_scan_and_two_exchanges(spark, sf_small):
    for df in (M.stats_from_counts(PR.comparison_counts(stored_runs(spark, sf_small))), PR.coverage(stored_runs(spark, sf_small))):
        p = executed(df)
        assert exchanges(p) <= 2 and p.count("FileScan") == 1 and "SortAggregate" not in p and "Join" not in p


def test_no_text_below_the_top_k(spark, sf_small):
    """Error cases are chosen from narrow rows; the texts are scanned apart and joined to what is chosen."""
    p = executed(RP.error_cases(PR.pair_join(stored_runs(spark, sf_small)), texts=stored_texts(spark, sf_small)))
    assert "SortAggregate" not in p and p.count("FileScan") == 2
    scans = re.findall(r"ReadSchema: struct<([^\n]*)", p)
    assert sorted("texts" in s for s in scans) == [False, True] and sorted("cells" in s for s in scans) == [False, True]


def test_metrics_with_matrix_take_two_exchanges(spark, sf_small):
    p = executed(M.confusion(stored_runs(spark, sf_small), ["model", "task", "perturbation", "level", "language"]))
    assert exchanges(p) == 2 and p.count("FileScan") == 1 and "Join" not in p


def test_stored_analysis_is_jvm_only(spark, sf_small):
    r = stored_runs(spark, sf_small)
    for df in (PR.pair_join(r), RP.error_cases(PR.pair_join(r))):
        p = plan(df)
        assert "ArrowEvalPython" not in p and "BatchEvalPython" not in p


def test_topk_uses_group_limit(spark, sf_small):
    r = stored_runs(spark, sf_small)
    df = sampling.first_per_group(RP.flips(PR.pair_join(r)), RP.GROUP, ["id"], 5)
    df.collect()
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString() or \
        "WindowGroupLimit" in df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_pushed_to_scan(spark, sf_small):
    from pyspark.sql import functions as F
    r = stored_runs(spark, sf_small).filter((F.col("perturbation") != "clean") & (F.col("level") > 0))
    p = plan(r)
    assert "PartitionFilters" in p and "PushedFilters" in p


def test_low_cardinality_joins_are_broadcast(spark, sf_small):
    """Any sort-merge join must be keyed by a row-level id; joins on task/model/label keys are broadcasts."""
    from tremor.plans import q_analysis as QA
    from tremor.plans import q_text as QT

    for df in (QA.label_map(spark, sf_small), QA.split_exact(spark, sf_small), QT.split_pick(spark, sf_small)):
        df.collect()
        p = df._jdf.queryExecution().executedPlan().toString()
        for keys in re.findall(r"SortMergeJoin \[([^\]]*)\]", p):
            assert re.search(r"\bid#", keys), keys


def test_stored_writes_are_not_sorted(spark):
    """A bucket is a task: perturbed text is not sorted (and spilled) on its way to the stored table."""
    from tremor import session

    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    with session.unsorted_writes(spark):
        spark.sql("CREATE TABLE t_unsorted (k INT, v INT) USING parquet CLUSTERED BY (k) INTO 2 BUCKETS")
        p = spark.sql("EXPLAIN INSERT INTO t_unsorted SELECT 1, 2").first()[0]
    spark.sql("DROP TABLE t_unsorted")
    assert "Sort" not in p and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_predictions_are_stored_without_texts(spark, sf_small):
    """Metrics and roll-ups write no text, unless a table with texts is there: then that one is read."""
    from tremor.plans import stored

    key = (spark.sparkContext.applicationId, sf_small)
    stored.forget(spark, sf_small)
    narrow = stored_runs(spark, sf_small, text=False)
    assert key not in stored._examples and "texts" not in stored.stored_examples(spark, sf_small, text=False).columns
    wide = stored_runs(spark, sf_small)
    assert sorted(map(str, narrow.collect())) == sorted(map(str, wide.drop("text").collect()))
    assert "texts" in stored.stored_examples(spark, sf_small, text=False).columns
    stored.forget(spark, sf_small)
    assert key not in stored._narrow and key not in stored._examples


def test_pairs_with_texts_sort_no_text(spark, sf_small):
    from tremor.plans import q_analysis as QA

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = QA.pair_join(spark, sf_small)
        p = executed(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in p and "SortMergeJoin" not in p and exchanges(p) == 0


def test_sink_of_predictions_moves_no_text(spark, sf_small, monkeypatch):
    """The runs go from the crossing into their files; only raw examples are dealt (the label and turn joins)."""
    from tremor.plans import q_files as QF

    plans, write = [], QF.files.write_predictions
    monkeypatch.setattr(QF.files, "write_predictions", lambda runs, *a, **k: (plans.append(plan(runs)), write(runs, *a, **k))[1])
    monkeypatch.setattr(QF.files, "balanced", None)  # (would range the perturbed texts)
    out = QF.sink_preds(spark, sf_small)
    assert sorted(map(str, out.collect())) == sorted(map(str, QF.scan_preds(spark, sf_small).select(*out.columns).collect()))
    assert len(plans) == 2 and all("MapInArrow" in p and "Exchange" not in p.split("MapInArrow")[0] for p in plans)


def test_stored_texts_are_dealt_once_and_unsorted(spark, sf_small):
    """On the way to their bucket documents meet one exchange and no sort; their labels come to them as narrow rows."""
    from tremor.plans import stored

    crossed, plans = stored.OP.crossed, []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    stored.forget(spark, sf_small)
    try:
        stored.OP.crossed = lambda x, *a, **k: (plans.append(plan(x)), crossed(x, *a, **k))[1]
        stored.stored_examples(spark, sf_small, text=False)
    finally:
        stored.OP.crossed = crossed
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        stored.forget(spark, sf_small)
    above, found = [], []
    for line in plans[0].splitlines():
        depth = len(re.match(r"[\s:+-]*", line)[0])
        above = [(d, x) for d, x in above if d < depth] + [(depth, line[depth:])]
        if "documents.parquet" in line and "text:string" in line and "IsNull(lang)" not in line:
            found.append([x.split()[0] for _, x in above])
    assert len(found) == 1 and found[0].count("Exchange") == 1 and "Sort" not in found[0] and "SortMergeJoin" not in found[0]


def test_dealt_examples_are_the_raw_ones(spark, tmp_path):
    """Null and repeated ids, languages and labels: the rows of the plain joins, each in the partition of its bucket."""
    from pyspark.sql import functions as F

    docs = [(1, "a", "en"), (1, "a", "en"), (1, "b", "de"), (2, "c", None), (2, "c", "fr"), (3, None, "en"), (None, "d", "en"), (None, "e", None), (4, "f", ""), (5, "g", "es")]
    labels = [(1, 0), (1, 1), (2, 1), (3, None), (4, 0), (9, 1), (None, 1)]
    turns = [(1, 0, "user", "x"), (1, 1, "assistant", "yy"), (2, 0, "user", None), (2, 1, "assistant", "z"), (None, 0, "user", "n"), (None, 1, "assistant", "n")]
    for name, rows, schema in (("documents", docs, "doc_id long, text string, lang string"), ("labels", labels, "doc_id long, quality long"),
                               ("conversations", turns, "conv_id long, turn long, role string, text string"), ("benchmark", [(1, "q"), (None, None)], "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    keys = ["task", "language", "id"]
    raw, dealt = V.raw_examples(spark, str(tmp_path)), V.dealt_examples(spark, str(tmp_path), keys)
    assert dealt.select(*raw.columns).schema.simpleString() == raw.schema.simpleString()
    assert sorted(map(str, dealt.select(*raw.columns).collect())) == sorted(map(str, raw.collect())) and raw.count() == 17
    at = dealt.select("*", F.spark_partition_id().alias("p")).groupBy("p").agg(F.collect_set(F.pmod(F.hash(*keys), F.lit(8))).alias("b")).collect()
    assert all(len(r.b) == 1 for r in at)


def test_stored_texts_are_packed_together(spark, tmp_path):
    """The versions of a text lie in one page, and the page's codec finds one in the other."""
    import glob

    import pyarrow.parquet as pq

    from tremor.plans import stored

    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen".split()
    rows = [("quality", "en", str(i), " ".join(words[(i * k) % 14] + str(i * k) for k in range(1, 300)), None, None, "1") for i in range(20)]
    df = spark.createDataFrame(rows, "task string, language string, id string, text string, premise string, hypothesis string, label string")
    name = stored.write_examples(spark, df.repartition(1), [("codemix", 0.5), ("paraphrase", 0.5), ("vowel_drop", 0.0)], V.rule_models(), f"{tmp_path}/t", 1)
    files = glob.glob(f"{tmp_path}/t/*.parquet")
    text = [pq.ParquetFile(f).metadata.row_group(0).column(j) for f in files for j in range(9) if pq.ParquetFile(f).metadata.row_group(0).column(j).path_in_schema.endswith(".text")]
    assert spark.table(name).count() == 20 and {c.compression for c in text} == {"ZSTD"}
    assert 3 * sum(c.total_compressed_size for c in text) < sum(c.total_uncompressed_size for c in text)
    spark.sql(f"DROP TABLE {name}")
