import random
import re

import pytest
import xxhash

from tremor.llm.graph import components
from tremor.llm.queries import op5_simhash
from tremor.llm.simhash import fingerprints, links, near_duplicates, one_of_each, simhash


def brute_print(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(rows):
    """rows: (key, fp); returns key -> least key, by plain search."""
    todo, out = set(range(len(rows))), {}
    while todo:
        seen, front = set(), [todo.pop()]
        while front:
            i = front.pop()
            seen.add(i)
            near = [j for j in todo if (rows[i][1] ^ rows[j][1]).bit_count() <= 2]
            todo.difference_update(near)
            front += near
        least = min((rows[i][0] for i in seen if rows[i][0] is not None), default=None)
        out.update((i, least) for i in seen)
    return [out[i] for i in range(len(rows))]


def test_fingerprints():
    texts = ["", " \t\n", "One", "one two", "a b c", "a b c d", "É É É é \x85 x", "x " * 5000, "A\x0bB\x0cC D E   f"]
    assert simhash(texts, 3, 42).tolist() == [brute_print(t) for t in texts]


def test_query_equals_brute_force(spark, sf_small):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op5_simhash(spark, sf_small).collect()}
    rows = [(r.doc_id, brute_print(r.text)) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    want = brute_components(rows)
    assert got == {k: (f"{f:016x}", c) for (k, f), c in zip(rows, want, strict=True)}


@pytest.mark.parametrize("hot", [4096, 1])
@pytest.mark.parametrize("max_bits,segments", [(2, 2), (2, 3), (2, 1), (4, 2)])
def test_links_join_all_near_pairs(spark, hot, max_bits, segments):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = {0, (1 << 64) - 1, *base}
    for b in base:
        for _ in range(12):
            fps.add(b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 4))))
    fps = sorted(fps)
    sign = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in sign], "fp long")
    if segments == 1 and max_bits > 2:
        return
    got = links(df, max_bits, segments, hot).collect()
    assert all((a ^ b & (1 << 64) - 1).bit_count() <= max_bits or ((a ^ b) & (1 << 64) - 1).bit_count() <= max_bits for a, b in got)
    parent = {f: f for f in sign}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        parent[top(a)] = top(b)
    for i, a in enumerate(sign):
        for b in sign[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= max_bits:
                assert top(a) == top(b)


def test_components_of_a_path_and_a_star(spark):
    n = 60
    path = [(i, i + 1) for i in range(n)]
    random.Random(1).shuffle(path)
    star = [(500, 501 + i) for i in range(40)]
    rows = [*path, *star, (None, 3), (900, 900), (901, 902), (901, 902)]
    got = dict(components(spark.createDataFrame(rows, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(n + 1)}, **{500 + i: 500 for i in range(41)}, 900: 900, 901: 901, 902: 901}


def test_odd_rows(spark):
    schema = "doc_id long, text string, fingerprint string, row int, component_id long"
    rows = [(None, None, "x", 1, 9), (3, "", "x", 1, 9), (3, "", "x", 1, 9), (5, "a b c d e", "x", 1, 9), (5, "a b c d e", "x", 1, 9),
            (2, "A B c d e", "x", 1, 9), (None, "only one here so it stays", None, None, None), (8, "w " * 30_000, "x", 1, 9)]
    df = spark.createDataFrame(rows, schema)
    kept = one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, (r.text or "")[:5]) for r in kept.collect()) == [(-1, "only "), (2, "A B c"), (3, ""), (8, "w w w")]
    empty = spark.createDataFrame([], schema)
    assert one_of_each(empty).collect() == [] and near_duplicates(fingerprints(empty)).collect() == []


def test_growing_tables_are_never_broadcast(spark, monkeypatch):
    """The driver holds no table that grows with the rows, however small its files look."""
    from tremor.llm import graph, simhash as module

    plans, plain = [], graph.written

    def spy(session, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(session, df, name)

    monkeypatch.setattr(graph, "written", spy)
    monkeypatch.setattr(module, "written", spy)
    rows = [(i, (1 << i) - 1) for i in range(40)] + [(100, 0)]  # a chain: several rounds
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, fingerprint long"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert {r.component_id for r in out.collect()} == {0}
    assert len(plans) > 6 and not [p for p in plans if "BroadcastHashJoin" in p]


def test_rows_to_keep_are_not_broadcast(spark):
    docs = spark.createDataFrame([(i, f"one two three {i // 2}") for i in range(8)], "doc_id long, text string")
    out = one_of_each(docs)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in out.collect()) == [0, 2, 4, 6]
