"""Lexicon tables against the word kernels: same draws, same replacements, odd texts, hot tokens."""

import pytest

from tremor.functions import fixed
from tremor.functions import kernels as K
from tremor.operators import lexicon as LX
from tremor.operators.perturb import make_perturber

TEXTS = [("1", "en", "a good, bad  (good) house!"), ("2", "EN", "good"), ("3", "english", "good bad"), ("4", "xx", "good  bad"), ("5", None, "good  bad"),
         ("6", "en", ""), ("7", "en", None), ("8", "en", " \t "), ("9", "en", "nothing  here "), ("10", "hi", "अच्छा घर।"), ("11", "en", "good " * 4000)]


def _tables(kind):
    return {"en": {"good": ["fine/ok", "nice", "great"], "bad": ["poor"], "house": ["home"]}, "hi": {"अच्छा": ["good"], "घर": ["house/home", "flat"]}}


@pytest.mark.parametrize("kind", ["codemix", "paraphrase"])
@pytest.mark.parametrize("hot", [1000, 4])
def test_equals_the_kernels(spark, kind, hot, monkeypatch):
    monkeypatch.setattr(LX, "HOT", hot)
    words = _tables(kind)
    rows = [(lang, w, r) for lang, t in words.items() for w, r in t.items()] + [("en", "empty", [])]
    lexicon = spark.createDataFrame(rows, "lang string, key string, replacements array<string>").repartition(3)
    df = spark.createDataFrame(TEXTS, "id string, language string, text string")
    p = make_perturber(codemix={lg: {w: r[0] for w, r in t.items()} for lg, t in words.items()}, synonyms=words)
    for level in (0.0, 0.5, 1.0):
        out = LX.substituted(df, lexicon, kind, level)
        assert out.columns == ["id", "language", "text", "text_perturbed"] and "Python" not in out._jdf.queryExecution().executedPlan().toString()
        got = {r.id: r.text_perturbed for r in out.collect()}
        want = {i: p.apply(t, i, lang, kind, level) for i, lang, t in TEXTS}
        assert got == want


def test_odd_tables(spark):
    df = spark.createDataFrame(TEXTS, "id string, language string, text string")
    none = spark.createDataFrame([], "lang string, key string, replacements array<string>")
    assert {r.id: r.text_perturbed for r in LX.substituted(df, none, "codemix", 1.0).collect()} == {i: t for i, _, t in TEXTS}
    assert LX.substituted(df.limit(0), none, "paraphrase", 1.0).collect() == []
    twice = spark.createDataFrame([("en", "bad", ["poor"])] * 3, none.schema)
    assert {r.id: r.text_perturbed for r in LX.substituted(df, twice, "codemix", 1.0).collect()}["1"] == "a good, poor (good) house!"
    same = LX.substituted(df, twice, "paraphrase", 1.0, strategy="none").collect()
    assert all(r.text == r.text_perturbed for r in same)
    with pytest.raises(ValueError, match="unknown kind"):
        LX.substituted(df, twice, "other", 1.0)
    assert K.steps_of("clean") == [] and fixed.CODEMIX_STRIP


@pytest.mark.parametrize("kind", ["codemix", "paraphrase"])
def test_words_are_not_searched_for_in_a_map(spark, kind):
    """A text of many distinct words costs as much a word as a short one: no map or list is looked through by word."""
    words = [f"w{i}," for i in range(3000)]
    lexicon = spark.range(3000).selectExpr("'en' AS lang", "concat('w', id) AS key", "array(concat('a', id, '/b'), concat('c', id)) AS replacements")
    df = spark.createDataFrame([("1", "en", " ".join(words)), (None, "en", "w1  w2"), ("3", "en", " w1 ")], "id string, language string, text string")
    out = LX.substituted(df, lexicon, kind, 0.5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "map_from_entries" not in plan and "map<" not in plan
    p = make_perturber(codemix={"en": {f"w{i}": f"a{i}/b" for i in range(3000)}}, synonyms={"en": {f"w{i}": [f"a{i}/b", f"c{i}"] for i in range(3000)}})
    got = {r.id: r.text_perturbed for r in out.collect()}
    assert got == {"1": p.apply(" ".join(words), "1", "en", kind, 0.5), None: "w1 w2", "3": p.apply(" w1 ", "3", "en", kind, 0.5)}
    with pytest.raises(Exception, match="two rows with one key"):
        LX.substituted(df.filter("id = '1'").union(df.filter("id = '1'")), lexicon, kind, 1.0).collect()
