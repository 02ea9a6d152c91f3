import random

import duckdb
import pytest

from tremor.llm.line_dedup import dedup_lines
from tremor.llm.queries import _LINE_SQL, op9_line_dedup


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def brute(rows, min_words=5):
    """rows of (id, text) in table order; cleaned texts."""
    seen = []
    for r, (k, t) in enumerate(rows):
        for p, line in enumerate(t.split("\n") if t is not None else []):
            seen.append(((k is not None, k or 0, r, p), [w for w in line.split(" ") if w], line))
    seen.sort(key=lambda s: s[0])
    out = {r: None if t is None else [] for r, (_, t) in enumerate(rows)}
    before = []
    for at, words, line in seen:
        gone = bool(words) and any(words == w or max(len(words), len(w)) >= min_words and abs(len(words) - len(w)) <= 1 and distance(words, w) <= 1
                                   for w in before)
        if words:
            before.append(words)
        if not gone:
            out[at[2]].append((at[3], line))
    return [None if v is None else "\n".join(line for _, line in sorted(v)) for v in out.values()]


def check(spark, rows, tmp_path, **kw):
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    rows = [tuple(r) for r in df.collect()]
    got = [r.text for r in dedup_lines(df, **kw).collect()]
    key = [f"{k}|{v}" for (k, _), v in zip(rows, brute(rows, **kw), strict=True)]
    assert sorted(f"{r.doc_id}|{r.text}" for r in dedup_lines(df, **kw).collect()) == sorted(key) and len(got) == len(rows)


def test_random_lines(spark, tmp_path):
    rng = random.Random(3)
    words = "a b c d the of x".split()
    pool = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(60)]

    def line():
        w = rng.choice(pool).split(" ")
        for _ in range(rng.randint(0, 2)):
            at, what = rng.randrange(len(w) + 1), rng.random()
            w = w[:at] + ([rng.choice(words)] if what < 0.6 else []) + w[at + (what > 0.3):]
        return " ".join(w)

    check(spark, [(i % 37, "\n".join(line() for _ in range(rng.randint(0, 8)))) for i in range(40)], tmp_path)


def test_a_hot_template(spark, tmp_path):
    check(spark, [(i, f"this line holds number {i} and no more\nsame words here for all of us\n\nown {i} line {i * i} of {i + 7} words {i}")
                  for i in range(40)], tmp_path)


@pytest.mark.parametrize("rows", [[], [(None, None), (None, ""), (1, "\n\n"), (1, "a b c d e\na b c d e\n  \na  b c d e"), (1, "a b c d e"),
                                       (1, "a b c d e"), (2, "x " * 3_000), (3, "x " * 2_999 + "y"), (4, "é ü ñ ß ø"), (None, "a b c d E f")]])
def test_odd_rows(spark, tmp_path, rows):
    check(spark, rows, tmp_path)


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e\nz", 5, "r", "p"), (2, "a b c d f", 6, "q", None)], "doc_id long, text string, row int, parts string, h1 string")
    out = dedup_lines(df, lines="n_lines", kept="parts")
    assert out.columns == ["doc_id", "text", "row", "h1", "n_lines", "parts"]
    assert sorted(map(tuple, out.collect())) == [(1, "a b c d e\nz", 5, "p", 2, 2), (2, "", 6, None, 1, 0)]


def test_no_python_in_the_plan(spark, sf_small):
    plan = op9_line_dedup(spark, sf_small)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "RDD"))


def test_query_equals_sql(spark, sf_small):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_small}/documents.parquet'")
    assert sorted(map(tuple, op9_line_dedup(spark, sf_small).collect())) == sorted(con.sql(_LINE_SQL).fetchall())
