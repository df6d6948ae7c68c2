"""URL rules, link extraction and PageRank against plain versions."""

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from recallscope.llm.host_trust import DAMPING, host_trust, links, personalised_pagerank, url_host, url_path
from recallscope.llm.queries import URL_RULES, op9_host_trust
from tests.conftest import SF001

URLS = ["https://A.Example.NET/en/x?q#f", "http://example.net", "http://example.net/", "http://x.org?fr/", "ftp://h.org/fr/a?b", None, "", "no scheme",
        "://host/p", "http://a://b/c", "http://u@Host.com:80/de/", "http://example.com/de", "http://example.com/de/#", "http://notexample.com/de/",
        "http://É.net/Ä?x", "http:///only/path", "http://org/fr/", "http://a.net\n/b"]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule(host, path, rules):
    fits = [(len(h + p), v == "block", h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits and host else None


def test_urls_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(URLS)], "page_id int, url string, html string")
    got = pages.select("page_id", url_host(pages.url).alias("h"), url_path(pages.url).alias("p")).collect()
    assert [(r.h, r.p) for r in got] == [split(u) for u in URLS]
    rules = spark.createDataFrame(URL_RULES + [("net", "/", "block")], "host string, path string, verdict string")
    for r in host_trust(pages, rules).collect():
        host, path = split(r.url)
        fit = rule(host, path, URL_RULES)
        assert (r.host, r.path, r.rule) == (host, path, fit and fit[1])
        if fit:
            assert r.verdict == ("block" if fit[0] else "allow")
    assert {r.verdict for r in host_trust(pages, rules.limit(0)).collect()} == {"allow"}
    assert host_trust(pages.limit(0), rules).collect() == []


def test_links(spark):
    html = ('<a href="http://B.org/x">1</a><A HREF=\'//c.org?y\'>2</a><a href=https://b.org>3</a><a href="/rel">4</a>'
            '<a href="mailto:x@d.org">5</a><a href="http://a.org/self">6</a><a href="#top">7</a><a nothref>8</a>')
    pages = spark.createDataFrame([("a.org", html), ("a.org", '<a href="http://b.org">'), ("", html), ("z.org", None)], "host string, html string")
    assert Counter(map(tuple, links(pages).collect())) == Counter([("a.org", "b.org", 3), ("a.org", "c.org", 1)])


def power(edges, seeds, rounds=200):
    out = defaultdict(float)
    for s, _, n in edges:
        out[s] += n
    rank = {h: 1.0 for h in seeds}
    for _ in range(rounds):
        new, moved = defaultdict(float), 0.0
        for s, d, n in edges:
            new[d] += DAMPING * rank.get(s, 0.0) * n / out[s]
            moved += rank.get(s, 0.0) * n / out[s]
        for h in seeds:
            new[h] += 1 - DAMPING + DAMPING * (1 - moved / len(seeds))
        rank = dict(new)
    return rank


EDGES = [("s1", "a", 2), ("s1", "b", 1), ("a", "b", 1), ("b", "c", 5), ("c", "a", 1), ("d", "bad", 1), ("e", "bad", 3), ("e", "s1", 1),
         ("f", "d", 1), ("bad", "g", 1), ("s2", "dead", 1)]


def test_pagerank(spark):
    edges = spark.createDataFrame(EDGES, "src string, dst string, n long")
    seeds = spark.createDataFrame([("s1",), ("s2",), ("s2",)], "host string")
    got = {r.host: r.rank for r in personalised_pagerank(edges, seeds, rounds=100, settled=1e-10).collect()}
    want = {h: r for h, r in power(EDGES, ["s1", "s2"]).items() if r}
    assert set(got) == {h for h in want} and all(abs(got[h] - want[h]) < 1e-6 for h in want)
    assert abs(sum(got.values()) - 2) < 1e-9  # no mass is lost
    alone = personalised_pagerank(edges.limit(0), seeds).collect()
    assert Counter(map(tuple, alone)) == Counter([("s1", 1.0), ("s2", 1.0)])
    assert personalised_pagerank(edges, seeds.limit(0)).collect() == []


def test_distrust_runs_against_the_links(spark):
    """Hosts that link to a blocked host are blocked, hosts a blocked one links to are not,
    and trust outweighs."""
    out = defaultdict(list)
    for s, d, n in EDGES:
        out[s] += [d] * n
    name = lambda h: f"{h}.test"
    pages = [(i, f"http://{name(h)}/x", "".join(f'<a href="http://{name(d)}/">' for d in out[h]), "note")
             for i, h in enumerate("s1 s2 a b c d e f g bad dead".split())]
    rules = [("s1.test", "/", "allow"), ("s2.test", "/", "allow"), ("bad.test", "/", "block")]
    df = spark.createDataFrame(pages + pages[:2] + [(99, None, None, None)], "page_id int, url string, html string, trust string").withColumn("__fit", F.lit(1))
    got = host_trust(df, spark.createDataFrame(rules, "host string, path string, verdict string"))
    rows = got.collect()
    assert len(rows) == len(pages) + 3 and got.columns == ["page_id", "url", "__fit", "host", "path", "rule", "verdict", "trust", "distrust"]
    verdict = {r.host: r.verdict for r in rows}
    assert {h for h, v in verdict.items() if v == "block"} == {name(h) for h in ("bad", "d", "e", "f")}
    back = power([(d, s, n) for s, d, n in EDGES], ["bad"])
    for r in rows:
        assert abs(r.distrust - back.get(r.host.removesuffix(".test"), 0.0)) < 1e-4


def test_query(spark):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF001}/pages.parquet").collect()}
    rows = op9_host_trust(spark, SF001).collect()
    assert len(rows) == len(pages)
    for r in rows:
        fit = rule(r.host, r.path, URL_RULES)
        assert (r.host, r.path) == split(pages[r.page_id]) and r.rule == (fit and fit[1])
        assert r.verdict == ("block" if fit and fit[0] else "allow")


def test_seeds_without_pages(spark):
    """Hosts that are only linked to are seeds where a rule decides them: blocked ones,
    subdomains of a ruled domain and trusted ones, but not those with a rule for some paths only."""
    out = {"a.test": ["x.bad.net"], "b.test": ["good.org"], "good.test": ["b.test"], "c.test": ["part.com"], "d.test": ["a.test"]}
    pages = spark.createDataFrame([(i, f"http://{h}/x", "".join(f'<a href="http://{d}/p">' for d in to)) for i, (h, to) in enumerate(out.items())],
                                  "page_id int, url string, html string")
    rules = spark.createDataFrame([("bad.net", "/", "block"), ("good.org", "/", "allow"), ("part.com", "/only/", "block")],
                                  "host string, path string, verdict string")
    rows = {r.host: r for r in host_trust(pages, rules).collect()}
    assert set(rows) == set(out)  # no row for a host without pages
    assert {h for h, r in rows.items() if r.verdict == "block"} == {"a.test", "d.test"}
    back = power([("x.bad.net", "a.test", 1), ("a.test", "d.test", 1)], ["x.bad.net"])
    # a chain that returns to its seed still moves by 2 x 0.85 ** 30 of a seed after ROUNDS
    assert all(abs(rows[h].distrust - back.get(h, 0.0)) < 0.016 for h in rows)
