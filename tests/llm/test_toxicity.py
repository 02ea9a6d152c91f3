import functools
import math
import random
import zlib

import numpy as np
import pytest

from tremor.llm import toxicity
from tremor.llm.queries import op4_toxicity


def _table(spark, n=160):
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [f"{a}{b}" for a in ("ta", "mo", "ri", "sel") for b in ("lo", "nu", f"{chr(97 + i % 26)}e")]
        rows.append((i, " ".join(words + ["grok", "Grokish!", "zorp,"] * bad)))
        labels.append((i, int(bad)))
    return (spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_held_out_documents_are_told_apart(spark):
    docs, labels = _table(spark)
    out = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    held = [r for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 20 and all(r.predicted == int(r.doc_id % 4 == 0) for r in held)
    assert all(0 <= r.score <= 1 for r in out)


def test_held_out_labels_are_never_read(spark):
    docs, labels = _table(spark)
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    a, b = (sorted(map(tuple, toxicity.score(docs, toxicity.fit(docs, x)).select("doc_id", "score").collect())) for x in (labels, flipped))
    assert a == b


def test_fit_is_repeatable_and_scores_do_not_depend_on_partitions(spark):
    docs, labels = _table(spark)
    a = sorted(map(tuple, toxicity.score(docs, toxicity.fit(docs, labels)).select("doc_id", "score").collect()))
    many = docs.repartition(7)
    b = sorted(map(tuple, toxicity.score(many, toxicity.fit(many, labels.repartition(3))).select("doc_id", "score").collect()))
    assert a == b


@pytest.mark.parametrize("label_rows", [[], [(1, None), (None, 1)], [(0, 1), (0, 0), (4, 1)]])
def test_odd_tables(spark, label_rows):
    rows = [(None, None, 7, "x"), (1, "", 7, "x"), (1, "", 7, "x"), (2, "word " * 60_000, None, None), (3, "\n\t", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, label string")
    model = toxicity.fit(docs, spark.createDataFrame(label_rows, "doc_id long, toxic int"))
    out = toxicity.score(docs, model)
    assert out.columns == ["doc_id", "text", "label", "score", "predicted"]
    assert len(out.collect()) == len(rows) and {r.predicted for r in out.collect()} == {0}
    assert toxicity.score(docs.limit(0), model).collect() == []


def test_odd_rows_with_a_model(spark):
    docs, labels = _table(spark)
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "grok zorp grokish " * 50_000), (2, "grok")], "doc_id long, text string")
    got = toxicity.score(odd, toxicity.fit(docs, labels)).collect()
    assert len(got) == 4 and got[0].score == got[1].score and got[2].score > got[0].score


def test_query(spark, sf_small):
    out = op4_toxicity(spark, sf_small).collect()
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3)


def test_mild_words_and_repeats_count(spark):
    """A word some 10 times likelier in toxic texts speaks, and so does each of its occurrences."""
    fill = [f"{a}{b}" for a in ("ta", "mo", "ri", "sel") for b in ("lo", "nu", "pe")]
    rows, labels = [], []
    for i in range(800):
        bad = i % 4 == 0
        mild = ["blixum"] * (i % 16 == 0 if bad else i % 40 == 1)
        rows.append((i, " ".join([*fill, f"own{i}", *mild, *["grok"] * bad])))
        labels.append((i, int(bad)))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    none, once, often = model.evidence(["talo monu", "talo monu blixum", "talo monu " + "blixum " * 40], toxicity.Words(model))
    assert 1.0 < model_ratio(model, "blixum") < 3.0 and model.word("blixum") > 0
    assert none < once < often


def model_ratio(model, form):
    """Unweighted log-ratio of a word."""
    return model.ratio(form)[0]


def plain_models(documents, order, cutoff, strength):
    """A word's log-ratio and variance, straight from the definition: `documents` are (set of words, label)."""
    raw = {}
    for words, label in documents:
        held = set()
        for s in (toxicity.HEAD + w + toxicity.TAIL for w in words):
            held |= {s[start:end] for end in range(2, len(s) + 1) for start in range(max(0, end - order), end)}
        for g in held:
            t, o = raw.get(g, (0, 0))
            raw[g] = (t + label, o + 1 - label)
    sizes = {"t": sum(label for _, label in documents), "o": sum(1 - label for _, label in documents)}
    strength = {c: strength * n / min(sizes.values()) for c, n in sizes.items()}
    tables = {"t": {}, "o": {}, "s": {}}
    for g, (t, o) in raw.items():
        longer = [raw[h] for h in raw if h[1:] == g and len(h) > 1] if len(g) < order and g[0] != toxicity.HEAD else None
        tables["t"][g] = t if longer is None else sum(a > 0 for a, _ in longer)
        tables["o"][g] = o if longer is None else sum(b > 0 for _, b in longer)
        tables["s"][g] = t + o if longer is None else len(longer)
    discount = {}
    for c, counts in tables.items():
        for k in range(1, order + 1):
            ones, twos = (sum(n == m for g, n in counts.items() if len(g) == k) for m in (1, 2))
            discount[c, k] = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
    after = {}
    for g in raw:
        after.setdefault(g[:-1], []).append(g)
    seen = {g for g, n in raw.items() if sum(n) >= cutoff}
    held = {c for c, gs in after.items() if sum(sum(raw[g]) for g in gs) >= cutoff}

    def left(c, context):
        """Sum and number of what a class has behind a context."""
        n = [tables[c][g] for g in after[context]]
        return sum(n), sum(x > 0 for x in n)

    def shared(g):
        if not g:
            return 1 / 256
        total, kinds = left("s", g[:-1]) if g[:-1] in held else (0, 0)
        if not total:
            return shared(g[1:])
        d = discount["s", len(g)]
        own = max(tables["s"][g] - d, 0) if g in seen else 0
        return (own + d * kinds * shared(g[1:])) / total

    def share(c, g):
        """A class's estimate of what follows a context (of all that it leaves to the shared one, if g is unseen)."""
        (total, kinds), d = left(c, g[:-1]), discount[c, len(g)]
        rest = (d * kinds + strength[c]) / (total + strength[c])
        p = max(tables[c][g] - d, 0) / (total + strength[c]) + rest * shared(g) if g in seen else rest
        return p, (1 - p) / (p * (total + strength[c]))

    def ratio(form):
        s = toxicity.HEAD + form + toxicity.TAIL
        r = v = 0.0
        for g in (s[max(0, i - order):i] for i in range(2, len(s) + 1)):
            if g[:-1] in held:
                (of_t, v_t), (of_o, v_o) = share("t", g), share("o", g)
                r, v = r + math.log(of_t) - math.log(of_o), v + max(v_t + v_o, 0.0)
        return r, v

    return ratio


def test_scores_equal_a_plain_version(spark):
    """Counts, both models, evidence and score of a small random table, recomputed without the module's tables."""
    rng = random.Random(5)
    usual, bad = (["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(40)] for letters in ("abcde", "bdegk"))
    rows, labels = [(None, "no id"), (900, None), (901, "")], []
    for i in range(200):
        toxic = i % 5 == 0
        words = [rng.choice(usual + bad * (2 if toxic else 0)) + rng.choice(["", "", "!", ","]) for _ in range(rng.randint(1, 25))]
        rows.append((i, " ".join(words).title() if i % 7 == 0 else " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, rows[5]], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    prints = {r.doc_id: r.curve for r in docs.filter("text is not null").selectExpr(
        "doc_id", "xxhash64(xxhash64(text), 'curve') % 4 = 0 as curve").collect()}
    marked = {k: v for k, v in labels if zlib.crc32(str(k).encode()) % 4 != 2}
    sample = {(t, marked[k]): prints[k] for k, t in rows if k in marked}
    documents = [({w.strip(toxicity._EDGE) for w in t.lower().split()} - {""}, label) for (t, label), curve in sample.items() if not curve]
    ratio = functools.cache(plain_models(documents, toxicity.ORDER, toxicity.CUTOFF, toxicity.STRENGTH))

    def evidence(text):
        words = [w.strip(toxicity._EDGE) for w in text.lower().split()]
        known = [ratio(w) for w in words if w]
        return sum(r ** 5 / (r ** 4 + (toxicity.ERRORS ** 2 * v) ** 2) for r, v in known if r) / (len(words) + toxicity.SHORT)

    curve = [(evidence(t), label) for (t, label), c in sample.items() if c]
    x, y = (np.array(c, float) for c in zip(*curve, strict=True))
    n_toxic = sum(marked.values())
    weight = np.where(y > 0, 1.0, min(toxicity.MAX_PRIOR, (len(marked) - n_toxic) / n_toxic))
    scale = np.abs(x).mean()
    rest = weight * (y - 1 / (1 + np.exp(-(model.slope * x + model.offset))))
    # the curve's penalised likelihood is flat at the fitted values
    assert abs((rest * x).sum() / scale - 0.05 * model.slope * scale) < 1e-6 and abs(rest.sum() - 1e-3 * model.offset) < 1e-6
    for r in toxicity.score(docs, model).collect():
        expected = 1 / (1 + math.exp(-(model.slope * evidence(r.text or "") + model.offset)))
        assert abs(r.score - expected) < 1e-9 and r.predicted == int(r.score >= 0.3)


def test_counts_are_of_documents(spark):
    """A long document with sixty words of one stem counts an n-gram once, as a short one does."""
    rows = [("zu zu zul zula " + " ".join(f"zula{i}" for i in range(60)), 1), ("Zu!", 0), ("zu", 0), ("", 0), ("...", 1)]
    counts = {r.g: (r.toxic, r.ordinary) for r in toxicity._ngram_counts(spark.createDataFrame(rows, "text string, label int"), 3).collect()}
    assert counts["zu"] == counts[toxicity.HEAD + "zu"] == (1, 2) and counts["ul"] == (1, 0) and max(map(max, counts.values())) == 2
    assert sorted(toxicity._ngrams("ab", 3)) == sorted(["\x02a", "a", "\x02ab", "ab", "b", "ab\x03", "b\x03", "\x03"])


def test_what_neither_class_holds_says_nothing_whatever_their_sizes(spark):
    """One class has ten times the documents; unseen words and punctuation are no evidence for the smaller one."""
    rows = [(i, " ".join([f"{a}{b}" for a in ("ta", "mo", "ri") for b in ("lo", "nu", "pe")] + ["grok"] * (i % 11 == 0))) for i in range(700)]
    rows = [(i, f"{t} own{i}") for i, t in rows]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"),
                         spark.createDataFrame([(i, int(i % 11 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    assert model.word("grok") > 2 and model.word("") == 0 and all(abs(model.word(w)) < 0.2 for w in ("xyzzy", "qqq", "talo", "own77"))
