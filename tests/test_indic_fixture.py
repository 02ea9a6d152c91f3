"""Differential check on a small multilingual fixture (hi/mr/bn/en + unknown), written with the driver schemas.

The driver tables hold en/fr/de/es only; this fixture exercises the original Hindi/Marathi code-mix lexicons,
the Hindi/Bengali synonym lexicons and the Indic vowel sets in both engines.
"""

import tempfile

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as E
from tools.check_oracles import digest

TEXTS = [
    ("hi", "मेरा घर बहुत अच्छा है। जल्दी आना, दोस्त! किताब और फोन यहाँ हैं।"),
    ("hi", "यह एक अच्छा दिन है।  बुरा   समय   भी   आता है; खुश रहो।"),
    ("mr", "हे पुस्तक खूप छान आहे. घर चांगले आहे, मित्र वाईट नाही."),
    ("bn", "ভালো বই, খারাপ দিন। আমি ভালো আছি।"),
    ("hindi", "घर घर घर अच्छा अच्छा"),
    ("bangla", "ভালো খারাপ ভালো"),
    ("en", "This is a good test.   The person was happy,\tand the text is small."),
    ("hi", "घर\u00a0अच्छा\u3000है\u0085दोस्त\u001cकिताब\u000bफोन\u200bसमय"),
    ("en", "  leading and trailing   spaces  "),
    ("xx", "unknown language text with घर and good"),
    ("hi", "एक"),
    ("en", "a"),
]


@pytest.fixture(scope="module")
def fixture_dir():
    d = tempfile.mkdtemp(prefix="tremor-indic-")
    n = len(TEXTS)
    pq.write_table(pa.table({
        "doc_id": pa.array(range(n), pa.int64()), "text": [t for _, t in TEXTS], "lang": [lg for lg, _ in TEXTS],
        "source": ["fixture"] * n, "n_chars": pa.array([len(t) for _, t in TEXTS], pa.int64())}),
        f"{d}/documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(range(n), pa.int64()),
                             "quality": pa.array([i % 2 for i in range(n)], pa.int32()),
                             "toxic": pa.array([0] * n, pa.int32())}), f"{d}/labels.parquet")
    conv = [(0, 0, "user", "घर कहाँ है?"), (0, 1, "assistant", "घर बहुत अच्छा है और पास है।"),
            (1, 0, "user", "Is the text good?"), (1, 1, "assistant", "Yes.")]
    pq.write_table(pa.table({"conv_id": pa.array([c[0] for c in conv], pa.int64()),
                             "turn": pa.array([c[1] for c in conv], pa.int64()),
                             "role": [c[2] for c in conv], "text": [c[3] for c in conv]}), f"{d}/conversations.parquet")
    pq.write_table(pa.table({"item_id": pa.array([0, 1], pa.int64()), "text": ["अच्छा", "good"]}),
                   f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="module")
def con(fixture_dir):
    c = duckdb.connect()
    for t in ("documents", "labels", "conversations", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{fixture_dir}/{t}.parquet')")
    return c


NAMES = ["noise_delete", "noise_swap", "noise_vowel", "noise_chain", "codemix", "paraphrase", "lang_alias",
         "normalize", "perturb_all", "score_rule", "experiment", "pair_join", "error_cases"]


@pytest.mark.parametrize("name", NAMES)
def test_fixture_matches_oracle(spark, fixture_dir, con, name):
    df = E.queries()[name](spark, fixture_dir)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    ocols = [x[0] for x in res.description]
    orows = res.fetchall()
    assert len(rows) == len(orows) and digest(rows, df.columns)[0] == digest(orows, ocols)[0]


def test_fixture_codemix_changes_indic_text(spark, fixture_dir):
    out = {r.id: r.text_perturbed for r in E.queries()["codemix"](spark, fixture_dir).collect()}
    assert any(w in out["0"] for w in ("house", "good", "fast", "friend", "book", "phone"))
    unknown = next(i for i, (lg, _) in enumerate(TEXTS) if lg == "xx")
    assert out[str(unknown)] == " ".join(TEXTS[unknown][1].split()) == TEXTS[unknown][1]  # unknown: unchanged
