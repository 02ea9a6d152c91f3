import corpus_pipeline
from tremor.llm import toxicity
from tremor.llm.simhash import simhash
from tests_llm_plain import brute_lines, near_groups


def test_stages_against_plain_versions(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = corpus_pipeline.written(spark, stage(spark, docs, sf_small), "test")
        assert docs.columns == columns
        after = {r.doc_id: r for r in docs.collect()}
        ids = {r.doc_id for r in before}
        assert len(after) == docs.count() and set(after) <= ids
        if name == "toxicity":
            labels = spark.read.parquet(f"{sf_small}/labels.parquet")
            scored = toxicity.score(spark.createDataFrame(before), toxicity.fit(spark.createDataFrame(before), labels))
            assert set(after) == {r.doc_id for r in scored.collect() if r.score < 0.3}
        elif name == "line_dedup":
            assert {k: r.text for k, r in after.items()} == brute_lines([(r.doc_id, r.text) for r in before])
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif name == "near_duplicates":
            prints = simhash([r.text for r in before], 3, 42)
            assert set(after) == near_groups([(r.doc_id, int(p)) for r, p in zip(before, prints, strict=True)])
        else:
            from tremor.llm.decontaminate import contaminated

            hits = contaminated(spark.createDataFrame(before), spark.read.parquet(f"{sf_small}/benchmark.parquet")).collect()
            assert set(after) == ids - {h.doc_id for h in hits}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_small)
    assert last.columns == [*columns, "ids", "decoded"] and all(r.decoded == r.text for r in last.collect())


def test_stages_take_odd_rows(spark, sf_small):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, row string"
    rows = [(None, None, None, None, None, None, None), (1, "", "en", "s", 0, 1.0, "r"), (1, "", "en", "s", 0, 1.0, "r"), (2, "some words " * 30_000, None, "s", 9, 0.0, "r")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.written(spark, stage(spark, docs, sf_small), "odd")
            assert docs.columns == [f.split()[0] for f in schema.split(", ")]
        assert len(corpus_pipeline.add_token_ids(spark, docs, sf_small).collect()) == (2 if data else 0)
