from urllib.parse import quote, unquote, urlparse, urlunparse
from urllib.robotparser import RobotFileParser

from pagelens.operators import robots

BODIES = {
    "a.example.com": "User-agent: *\nDisallow: /private\nAllow: /private/ok\n\nUser-agent: Mozilla\nDisallow: /m\nDisallow:\n",
    "b.example.com": "# c\nDisallow: /ignored\nUser-agent: bot\n\nUser-agent: *\nDisallow: /x # note\n  \nAllow: /\n",
    "c.example.com": "User-agent: mybot\nUser-agent: other\nDisallow: /two\nUser-agent: *\nDisallow: /\n",
}
PATHS = ["/", "/private", "/private/ok/1", "/m/1", "/x", "/two/a", "/ignored", "/a b"]
AGENTS = ["Mozilla/5.0 (X11)", "MyBot/1.0", "bot/2"]


def test_can_fetch_matches_stdlib(spark):
    rob = spark.createDataFrame([(h, 200, b) for h, b in BODIES.items()], "host string, status_code int, body string")
    rules = robots.robots_rules(rob)
    urls = spark.createDataFrame([(f"https://{h}{p}",) for h in BODIES for p in PATHS], "url string")
    for agent in AGENTS:
        got = {r.url: r.allowed for r in robots.can_fetch(urls, rules, agent).collect()}
        for h, body in BODIES.items():
            rp = RobotFileParser()
            rp.parse(body.splitlines())
            for p in PATHS:
                u = f"https://{h}{p}"
                assert got[u] == rp.can_fetch(agent, u), (agent, u)


def test_summary_empty_disallow_takes_next_word(spark):
    rob = spark.createDataFrame([("h", 200, "Disallow:\nfoo: bar\nSitemap: https://h/s.xml\n"), ("g", 404, "x")],
                                "host string, status_code int, body string")
    got = {r.host: r for r in robots.robots_summary(rob).collect()}
    assert got["h"].disallow_rules == ["foo:"] and got["h"].sitemaps == ["https://h/s.xml"]
    assert got["g"].exists is False and got["g"].disallow_count == 0


def test_several_agents_in_one_pass(spark):
    body = "User-agent: *\nDisallow: /a\n\nUser-agent: one\nDisallow: /b\n"
    rules = robots.robots_rules(spark.createDataFrame([("h.example", 200, body)], "host string, status_code int, body string"))
    urls = ["https://h.example/a?", "https://h.example/b#", "https://h.example", "https://other.example/a", "https://h.example/%62x?q=1#f"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {(r.url, r.agent): r.allowed for r in robots.can_fetch_agents(df, rules, ["One/1", "two"]).collect()}
    blocked = {(urls[0], "two"), (urls[1], "one"), (urls[4], "one")}
    assert got == {(u, a): (u, a) not in blocked for u in urls for a in ("one", "two")}


def test_url_keys(spark):
    urls = ["https://h/a?", "https://h/a?#", "https://h/a#", "https://h/a?#f", "https://h/a?x#f?", "https://h", "//h/p", "/p?q", "a#b#c", "https://h/a?b?"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r.k for r in df.select(robots.url_key(df.url).alias("k")).collect()] == [
        quote(urlunparse(("", "", *urlparse(unquote(u))[2:]))) or "/" for u in urls]
