import re
from collections import Counter, defaultdict

from tremor.llm import url_filter
from tremor.llm.queries import op6_url_filter


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host):])[0]


def rule(host, path):
    best = None
    for what, text in url_filter.RULES:
        h, _, tail = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + tail) and (best is None or len(text) > len(best[1])):
            best = (what, text)
    return best


def brute(rows, rounds=300, d=url_filter.DAMPING):
    parsed = {i: (*parse(u), rule(*parse(u))) for i, u, _ in rows}
    pages, seeds, links = Counter(), defaultdict(lambda: [0, 0]), Counter()
    for i, _, html in rows:
        h, _, r = parsed[i]
        if h:
            pages[h] += 1
            seeds[h][0] += r is not None and r[0] == "allow"
            seeds[h][1] += r is not None and r[0] == "block"
            for x in re.findall(r"(?i)\bhref\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)", html or ""):
                t = parse("x:" + re.sub(r"^[^/]*:", "", x))[0]
                if t and t != h:
                    links[h, t] += 1
    out, into = Counter(), Counter()
    for (a, b), n in links.items():
        out[a] += n
        into[b] += n
    start = {h: ((1 - d) * seeds[h][0] / n, (1 - d) * seeds[h][1] / n) for h, n in pages.items()}
    score = dict(start)
    for _ in range(rounds if links else 0):
        new = defaultdict(lambda: [0.0, 0.0], {h: list(s) for h, s in start.items()})
        for (a, b), n in links.items():
            new[b][0] += d * score.get(a, (0, 0))[0] * n / out[a]
            new[a][1] += d * score.get(b, (0, 0))[1] * n / into[b]
        score = {h: tuple(s) for h, s in new.items()}
    bad = {h for h, (t, b) in score.items() if b - t > url_filter.THRESHOLD}
    return {i: (h, p, r and r[1], r[0] if r else "block" if h in bad else "allow") for i, (h, p, r) in parsed.items()}


def test_query_equals_brute_force(spark, sf_small):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_small}/pages.parquet").collect()]
    assert {r.page_id: tuple(r)[1:] for r in op6_url_filter(spark, sf_small).collect()} == brute(rows)


URLS = [None, "", "no scheme", "http://COM", "http://com/", "http://a.com?x/en/", "https://www.example.com/en/1", "http://x.example.com/en/1", "http://example.com/en",
        "http://notexample.com/en/2", "http://b.net/es/1", "http://b.net/de/1", "http://c.org/x#y?z", "http://d.org/", "a://b://c/d", "http://e.org/", "HTTP://É.NET/fr/\nx",
        "http://f.org/p?q"]
LINKS = {13: '<a href="http://b.net/de/9">', 15: "<a HREF = '//d.org/1'> <a href=/own> <a href=http://c.org/x>", 6: '<a href="https://f.org/y">'}


def test_odd_urls_and_links(spark):
    rows = [(i, u, LINKS.get(i)) for i, u in enumerate(URLS)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, src string")
    out = url_filter.judge(df)
    assert out.columns == ["page_id", "url", "src", "host", "path", "rule", "verdict"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert got == brute(rows)
    assert got[11][3] == "block" and got[12][3] == "allow"
    assert url_filter.judge(df.limit(0)).collect() == []


def test_repeated_pages_and_a_hot_host(spark):
    rows = [(i % 40, f"http://hot.net/{'es' if i % 3 else 'de'}/{i % 40}", "<a href='http://z.org/'>") for i in range(120)]
    got = url_filter.judge(spark.createDataFrame([*rows, (None, None, None)], "page_id long, url string, html string")).collect()
    assert len(got) == 121 and {r.verdict for r in got if r.host} == {"block"}


def test_propagation_runs_until_nothing_changes(spark):
    """A chain of forty hosts before a blocked one, and a ring: more rounds than any fixed number would do."""
    rows = [(i, f"http://h{i}.org/", f"<a href='http://h{i + 1}.org/'>") for i in range(40)] + [(40, "http://h40.net/es/", "<a href='http://h0.org/'>")]
    rows += [(100 + i, f"http://r{i}.org/", f"<a href='//r{(i + 1) % 3}.org/'><a href='//h40.net/'>") for i in range(3)]
    rows[39] = (39, "http://h39.org/", "<a href='http://h40.net/x'>")
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df).collect()} == brute(rows)
    seeds = spark.createDataFrame([(f"h{i}", 0.0, float(i == 9)) for i in range(10)], "host string, allowed double, blocked double")
    links = spark.createDataFrame([(f"h{i}", f"h{i + 1}", 1.0, 1.0) for i in range(9)], "src string, dst string, share double, back double")
    got = {r.host: r.distrust for r in url_filter.propagate(seeds, links).collect()}
    assert all(abs(got[f"h{i}"] - 0.15 * 0.85 ** (9 - i)) < 1e-9 for i in range(10))
