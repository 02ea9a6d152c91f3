import random

import numpy as np

from tremor.llm.decontaminate import contaminated, edits_within, without_contaminated, words_of
from tremor.llm.queries import op7_decontamination


def plain(item, text):
    d = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(text, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return min(d)


def test_edits_within():
    rng = random.Random(5)
    for _ in range(300):
        a, b = [rng.randint(0, 3) for _ in range(rng.randint(1, 7))], [rng.randint(0, 3) for _ in range(rng.randint(0, 12))]
        edits, at = edits_within(np.array(a), np.array(b, np.int64))
        assert edits == plain(a, b) and plain(a, b[at:]) == edits


def _edited(rng, words, edits, pool):
    w = list(words)
    for _ in range(edits):
        i, what = rng.randrange(len(w)), rng.random()
        w[i:i + 1] = [rng.choice(pool)] if what < 0.5 else [] if what < 0.75 else [w[i], rng.choice(pool)]
    return w


def test_planted_edits_are_found(spark):
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(8, 50)))) for i in range(40)]
    docs = []
    for d in range(160):
        body, item = [rng.choice(pool) for _ in range(rng.randint(0, 200))], items[d % 40][1].split()
        at = rng.randint(0, len(body))
        docs.append((d, " ".join(body[:at] + _edited(rng, item, int(0.2 * len(item)) * (d % 4) // 3, pool) + body[at:])))
    docs += [(d, " ".join(rng.choice(pool) for _ in range(150))) for d in range(160, 200)]
    got = {(r.doc_id, r.item_id): r.edits for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                                                 spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(d, i): e for d, t in docs for i, x in items if (e := plain(x.split(), t.split())) <= len(x.split()) // 5}
    assert all(got[k] == want[k] for k in got)
    assert len(got) >= 0.97 * len(want)


def test_query_equals_brute_force(spark, sf_small):
    docs = [(r.doc_id, words_of(r.text)) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    items = [(r.item_id, words_of(r.text)) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    numbers = {w: i for i, w in enumerate({w for _, ws in docs + items for w in ws})}
    want = {(d, i) for d, t in docs for i, x in items if x and set(x) & set(t)
            and edits_within(np.array([numbers[w] for w in x]), np.array([numbers[w] for w in t], np.int64))[0] <= len(x) // 5}
    assert {(r.doc_id, r.item_id) for r in op7_decontamination(spark, sf_small).collect()} == want


def test_odd_tables(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, None, "q"), (1, "", "q"), (2, item.upper() + "!", "q"), (2, "x " + item, "q"), (None, item, "q"), (3, "... !!!", "q"),
                                  (4, "pad " * 50_000 + item, "q"), (5, "one two three", None)], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(None, item), (7, None), (8, ""), (9, "one two"), (10, item), (11, item)], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.start, r.edits) for r in contaminated(docs, items).collect())
    assert [g for g in got if g[1] != 9] == [(0, 10, 0, 0), (0, 11, 0, 0), (2, 10, 0, 0), (2, 11, 0, 0), (4, 10, 50_000, 0), (4, 11, 50_000, 0)]
    assert [g for g in got if g[1] == 9] == [(0, 9, 0, 0), (2, 9, 0, 0), (4, 9, 50_000, 0), (5, 9, 0, 0)]
    left = without_contaminated(docs, items)
    assert left.columns == docs.columns and sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 1, 3]
    assert contaminated(docs.limit(0), items).collect() == [] and contaminated(docs, items.limit(0)).collect() == []


def test_rows_are_decided_one_by_one(spark, tmp_path):
    import corpus_pipeline

    item = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(10, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(2, "clean text", "a"), (2, "x " + item, "b"), (None, item, "c"), (None, "clean too", "d"), (None, None, "e")],
                                 "doc_id long, text string, row string")
    left = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and sorted(r.row for r in left.collect()) == ["a", "d", "e"]
    kept = without_contaminated(docs, spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert sorted(r.row for r in kept.collect()) == ["a", "c", "d", "e"]


def test_short_items_by_their_exact_words(spark):
    """Items of one to four words: every text that holds the words in order, and its first such place."""
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(pool) for _ in range(i % 4 + 1))) for i in range(16)]
    docs = [(d, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))) for d in range(80)]
    want = set()
    for d, t in docs:
        for i, x in items:
            w, x = t.split(), x.split()
            spots = [a for a in range(len(w) - len(x) + 1) if w[a:a + len(x)] == x]
            want |= {(d, i, spots[0], len(x), 0)} if spots else set()
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(r[c] for c in ("doc_id", "item_id", "start", "n_words", "edits")) for r in got.collect()} == want
