from normlake.llm.url_filter import filter_urls, host_edges, host_trust

URLS = [
    (1, "http://WWW.Example.ORG/es/1?x#y", None), (2, "https://example.org/en/12", None), (3, "https://example.org/en/2", None), (4, "ftp://a.com/fr/", None), (5, "http://b.com/de/1", None),
    (6, "http://org", None), (7, None, None), (8, "no scheme", ""), (9, "http://notorg/", None), (10, "http://x.net/a?u=http://y.org/", None), (11, "", None), (11, "", None), (None, "http://c.com/fr/x://y", None),
    (12, "http://h.net?q", None), (13, "http://multi\nline.org/p\nq", None),
]
EXPECTED = {
    1: ("www.example.org", "/es/1", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"), 3: ("example.org", "/en/2", "org/", "allow"), 4: ("a.com", "/fr/", "com/fr/", "allow"),
    5: ("b.com", "/de/1", "com/de/", "block"), 6: ("org", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"), 9: ("notorg", "/", None, "allow"), 10: ("x.net", "/a", None, "allow"),
    11: ("", "", None, "allow"), None: ("c.com", "/fr/x://y", "com/fr/", "allow"), 12: ("h.net", "", None, "allow"), 13: ("multi\nline.org", "/p\nq", "org/", "allow"),
}


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' AS host", "'x' AS rule", "'x' AS trust")


def test_rules(spark):
    got = filter_urls(pages(spark, URLS)).collect()
    assert len(got) == len(URLS)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == EXPECTED[r.page_id], r


def test_distrust_runs_against_links(spark):
    rows = [(1, "http://bad.com/de/1", ""), (2, "http://friend.net/a", '<a href="http://bad.com/x">'), (3, "http://good.org/", '<a href="http://fine.net/">'), (4, "http://fine.net/", ""),
            (5, "http://nobody.net/", "<a href='/local'>")]
    got = {r.page_id: r.verdict for r in filter_urls(pages(spark, rows)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}
    trust = {r.host: r for r in host_trust(pages(spark, rows)).collect()}
    assert trust["fine.net"].trust > 0 and trust["friend.net"].distrust > 0


def test_pagerank_against_plain_python(spark):
    rows = [(i, f"http://h{i % 7}.{'org' if i % 3 else 'com'}/de/", "".join(f'<a href="http://h{(i * k) % 7}.{"org" if (i * k) % 3 else "com"}/">' for k in range(1, 5))) for i in range(40)]
    edges = {(r.src, r.dst): r.weight for r in host_edges(pages(spark, rows)).collect()}
    counts = {}
    for i, url, _ in rows:
        host = url.split("/")[2]
        if host.endswith("org"):
            counts[host] = counts.get(host, 0) + 1
    seed = {h: c / sum(counts.values()) for h, c in counts.items()}
    rank = dict(seed)
    for _ in range(10):
        new = {h: 0.15 * s for h, s in seed.items()}
        for (a, b), w in edges.items():
            if a in rank:
                new[b] = new.get(b, 0) + 0.85 * rank[a] * w / sum(x for (s, _), x in edges.items() if s == a)
        rank = new
    got = {r.host: r.trust for r in host_trust(pages(spark, rows)).collect()}
    assert all(abs(got.get(h, 0) - v) < 1e-9 for h, v in rank.items())


def test_empty_table(spark):
    assert filter_urls(pages(spark, [])).collect() == []
