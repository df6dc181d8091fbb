import re

from sensorspark.llm import url_filters as u

SCHEMA = "page_id long, url string, site string, rule string"
URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.NET/en/1?x", "http://a.example.net/EN/", "http://example.net", "http://net/x", "http://xnet/x", "http://example.com/de/5#f", "http://my.example.com/de", "http://notexample.com/de/",
    "http://a.org/fr/", "http://a.org/de/?u=http://b.net/", "http://cheap-pills.example.org/", "http://www.cheap-pills.example.com/de/9", "http://x.com/casino", "http://pills.com/", "ftp://files.com/a.torrent", "http://ads.b.com/", "http://b.com/?q=casino", "x://y://net/", "http://é.net/\n/x", "http://example.net?en/",
]


def brute(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    best = (None, None, "allow")
    for rule, verdict, _, explicit, regex, _ in u.compile_rules():
        if re.search(regex.replace("$", r"\Z"), host + path):
            best = (rule, None, verdict) if explicit else (None, rule, verdict)
    return (host, path, *best)


def test_verdicts_match_trying_every_rule(spark):
    df = spark.createDataFrame([(i, x, "s", "r") for i, x in enumerate([*URLS, *URLS[5:9]])], SCHEMA)
    got = {r.page_id: (r.host, r.path, r.rule, r.pattern, r.verdict) for r in u.judge(df).collect()}
    assert got == {i: brute(x) for i, x in enumerate([*URLS, *URLS[5:9]])}
    assert got[4] == ("www.example.net", "/en/1", "example.net/en/", None, "allow") and got[7][2] == "net/"
    assert u.judge(df.limit(0)).count() == 0


def test_without_broadcast_and_with_other_rules(spark, monkeypatch):
    monkeypatch.setattr(u, "BROADCAST_RULES", 0)
    df = spark.createDataFrame([(1, "http://a.b.com/x/y"), (1, "http://a.b.com/x/y"), (None, "http://z.com/")], "page_id long, url string")
    out = u.judge(df, host_rules=[("com/", "block"), ("b.com/x/", "allow")], patterns=[("*z*", "block")]).collect()
    assert sorted((r.page_id or 0, r.rule, r.verdict) for r in out) == [(0, "com/", "block"), (1, "b.com/x/", "allow"), (1, "b.com/x/", "allow")]


def test_index_tokens_stand_whole_in_every_url_that_fits():
    assert u._pattern_rule("*cheap-pills.*")[1] == ["pills"] and u._pattern_rule("*casino*")[1] == [] and u._host_rule("example.net/en/")[1] == ["example", "net"]


def by_hand(url):
    """The contract's four rules, written out."""
    rest = (url or "").partition("://")[2]
    cut = min([rest.find(x) for x in "/?#" if x in rest], default=len(rest))
    host, tail = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(x) for x in "?#" if x in tail], default=len(tail))]
    best = None
    for name, start, verdict in (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")):
        if (host == name or host.endswith("." + name)) and path.startswith(start) and (best is None or len(name + start) > len(best[0])):
            best = (name + start, verdict)
    return host, path, best


def test_the_four_rules_by_hand(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    long = ["http://a.net/" + "x/" * 200_000, "http://" + "sub." * 50_000 + "example.com/de/", "http://" + "a" * 300_000, "http://b.org/fr/?" + "q=1&" * 100_000]
    more = spark.createDataFrame([(10**6 + i, u) for i, u in enumerate([*URLS, *long])], "page_id long, url string")
    rows = pages.unionByName(more)
    got = {r.page_id: r for r in u.judge(rows).collect()}
    assert len(got) == rows.count() > 250
    for r in rows.collect():
        host, path, best = by_hand(r.url)
        g = got[r.page_id]
        assert (g.host, g.path, g.rule) == (host, path, best and best[0]) and (best is None or g.verdict == best[1])


def test_rows_of_hot_sites_are_spread_and_keep_their_verdicts(spark, monkeypatch):
    urls = ["http://a.net/x"] * 300 + [None] * 200 + ["http://casino.com/"] * 100 + [f"http://s{i}.example.com/de/{i}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    monkeypatch.setattr(u, "HOT_SHARE", 20)
    got = {r.page_id: (r.host, r.path, r.rule, r.pattern, r.verdict) for r in u.judge(df).collect()}
    assert got == {i: brute(x) for i, x in enumerate(urls)}
    plan = u.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "key#" in plan and "salt#" in plan
