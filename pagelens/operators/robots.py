"""robots.txt summary, rule table, URL filter and sitemap discovery.

Rule grouping follows the standard-library robots parser: a group is one or more User-agent
lines followed by rules; a blank line after agents drops the group, a blank line after rules ends
it, a User-agent after rules starts a new group; rules before any agent are ignored; whitespace-
or comment-only lines are not blank. The first group naming ``*`` is the default group (a later
``*`` group is dropped). A URL is checked against the first non-default group whose agent is a
substring of the crawler's token (lower-cased text before the first "/"), else the default group;
the first rule in file order whose path is a prefix decides; no match allows.

Lines are exploded per host (no shuffle); grouping is a gaps-and-islands computation with running
sums over each host's lines, a window partitioned by host. A robots file is bounded in size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens import dims
from pagelens.functions import html as H
from pagelens.functions.urls import _split

DISALLOW_RX = r"(?im)^\s*Disallow:\s*(\S*)"
SITEMAP_RX = r"(?im)^\s*Sitemap:\s*(\S+)"
PLAIN_RX = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#%]*(/(?!/)[A-Za-z0-9_.~/\-]*)\z"
PREFIX_RX = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?"
LINE_BREAK_RX = r"\r\n|[\n\r\x{0b}\f\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"


def robots_summary(robots: DataFrame) -> DataFrame:
    """Exists (status 200), disallow values (an empty Disallow captures the next line's first
    word, as the pattern's \\s* crosses the line end), declared sitemaps, counts."""
    ok = F.col("status_code") == 200
    dis = F.when(ok, F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(DISALLOW_RX), 1)).otherwise(F.array().cast("array<string>"))
    sm = F.when(ok, F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(SITEMAP_RX), 1)).otherwise(F.array().cast("array<string>"))
    return robots.select(
        "host", ok.alias("exists"), dis.alias("disallow_rules"), F.size(dis).cast("bigint").alias("disallow_count"),
        sm.alias("sitemaps"),
    )


def pct_quote(c: Column) -> Column:
    """Python ``urllib.parse.quote`` with the default safe set ("/"): form encoding with the five signs that the two treat
    otherwise put right ("+" itself is encoded, so every "+" there is a blank)."""
    out = F.url_encode(c)
    for encoded, sign in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(encoded), F.lit(sign))
    return out


def pct_unquote(c: Column) -> Column:
    """Percent-decoding (UTF-8); text that does not decode stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def _norm_rule_path(p: Column) -> Column:
    """Rule path as the parser stores it: unquoted, re-assembled without empty delimiters, quoted."""
    s = _split(p)
    rebuilt = F.concat(
        F.when(s["raw_s"] != "", F.concat(s["raw_s"], F.lit(":"))).otherwise(F.lit("")),
        F.when(s["n"] != "", F.concat(F.lit("//"), s["n"])).otherwise(F.lit("")),
        s["p"],
        F.when(s["q"] != "", F.concat(F.lit("?"), s["q"])).otherwise(F.lit("")),
        F.when(s["f"] != "", F.concat(F.lit("#"), s["f"])).otherwise(F.lit("")),
    )
    return pct_quote(rebuilt)


def robots_rules(robots: DataFrame) -> DataFrame:
    """(host, entry, agents, is_default, rule_no, allow, path) for every rule of every kept
    group; hosts without status 200 or without groups have no rows (everything allowed)."""
    lines = robots.filter(F.col("status_code") == 200).select(
        "host", F.posexplode(F.split(F.coalesce("body", F.lit("")), LINE_BREAK_RX, -1)).alias("ln", "raw")
    )
    stripped = H.strip(F.regexp_replace(F.col("raw"), "#.*$", ""))
    kv = F.split(stripped, ":", 2)
    key = F.lower(H.strip(F.get(kv, 0)))
    val = pct_unquote(H.strip(F.coalesce(F.get(kv, 1), F.lit(""))))
    kind = (
        F.when(F.col("raw") == "", "blank")
        .when((stripped == "") | (F.size(kv) < 2), "other")
        .when(key == "user-agent", "agent")
        .when(key.isin("disallow", "allow"), "rule")
        .when(key.isin("crawl-delay", "request-rate"), "ruleish")
        .otherwise("other")
    )
    ev = lines.select("host", "ln", kind.alias("kind"), key.alias("key"), val.alias("val")).filter(F.col("kind") != "other")
    w = Window.partitionBy("host").orderBy("ln")
    ev = ev.withColumn("prev", F.lag("kind").over(w))
    starts_entry = (F.col("kind") == "agent") & (F.col("prev").isNull() | (F.col("prev") != "agent"))
    ev = ev.withColumn("seg", F.sum(F.when(starts_entry | (F.col("kind") == "blank"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seg_w = Window.partitionBy("host", "seg")
    ev = ev.withColumn("seg_head", F.first("kind").over(seg_w.orderBy("ln")))
    ev = ev.filter(F.col("seg_head") == "agent")
    agents = ev.filter(F.col("kind") == "agent").groupBy("host", "seg").agg(F.collect_list(F.struct("ln", "val")).alias("a"))
    agents = agents.select("host", "seg", F.transform(F.array_sort("a"), lambda x: x["val"]).alias("agents"))
    rules = ev.filter(F.col("kind").isin("rule", "ruleish")).select(
        "host", "seg", "ln", (F.col("key") == "allow").alias("allow"), F.col("val").alias("path"), (F.col("kind") == "rule").alias("is_path_rule")
    )
    entries = rules.groupBy("host", "seg").agg(F.count(F.lit(1)).alias("n")).join(agents, ["host", "seg"])
    has_star = F.array_contains("agents", "*")
    first_star = F.min(F.when(has_star, F.col("seg"))).over(Window.partitionBy("host"))
    entries = entries.withColumn("is_default", has_star & (F.col("seg") == first_star)).filter(~has_star | F.col("is_default"))
    out = rules.filter("is_path_rule").join(entries.select("host", "seg", "agents", "is_default"), ["host", "seg"])
    # an empty Disallow allows everything
    allow = F.col("allow") | (F.col("path") == "")
    return out.select(
        "host", F.col("seg").alias("entry"), "agents", "is_default",
        F.row_number().over(Window.partitionBy("host", "seg").orderBy("ln")).alias("rule_no"),
        allow.alias("allow"), _norm_rule_path(F.col("path")).alias("path"),
    )


def agent_token(user_agent: str) -> str:
    return user_agent.split("/")[0].lower()


def url_key(url: Column) -> Column:
    """What a URL is matched as: unquoted, path + params + query + fragment (delimiters of empty parts
    left out), re-quoted; "/" if empty. Rare steps run only on URLs that need them."""
    from pagelens.operators.parse import let

    def key(x):
        rest = F.regexp_replace(F.when(x.contains("%"), pct_unquote(x)).otherwise(x), PREFIX_RX, "")
        trimmed = let(rest, lambda r: F.when(r.contains("?"), F.regexp_replace(r, r"(?s)^([^?#]*)\?(#|\z)", "$1$2")).otherwise(r))
        trimmed = let(trimmed, lambda r: F.when(r.endswith("#"), F.regexp_replace(r, r"(?s)^([^#]*)#\z", "$1")).otherwise(r))
        # a path that begins with two slashes is written with an empty host before it
        return let(pct_quote(trimmed), lambda q: F.when(q == "", F.lit("/")).when(q.startswith("//"), F.concat(F.lit("//"), q)).otherwise(q))

    # most URLs are a scheme, a host and a path of safe signs: that path is the key
    return F.coalesce(F.nullif(F.regexp_extract(url, PLAIN_RX, 1), F.lit("")), let(url, key))


def host_rules(rules: DataFrame, user_agents: list[str]) -> DataFrame:
    """The rule groups that apply to the ``user_agents`` on each host, as one row per host:
    (host, rules MAP<agent token, STRUCT<paths ARRAY<STRUCT<path, rule_no, allow>>, lengths ARRAY<INT>, ordered>>): the first
    rule of each path, sorted by path, the lengths that paths have, and the same rules in file order with the start
    that they ask for ("" of "*"). The first non-default group whose agent is
    a substring of the crawler's token wins, else the default group. A row holds groups of one robots file, so its
    size is bounded by the file."""
    tokens = sorted({agent_token(a) for a in user_agents})
    ent = rules.select("host", "entry", "agents", "is_default").distinct().withColumn("token", F.explode(F.array(*[F.lit(t) for t in tokens])))
    named = ~F.col("is_default") & F.exists("agents", lambda a: F.contains(F.col("token"), F.lower(a)))
    pick = ent.groupBy("host", "token").agg(
        F.coalesce(F.min(F.when(named, F.col("entry"))), F.min(F.when(F.col("is_default"), F.col("entry")))).alias("entry"))
    active = rules.join(pick, ["host", "entry"])
    first = active.groupBy("host", "token", "path").agg(F.min(F.struct("rule_no", "allow")).alias("r"))
    group = first.groupBy("host", "token").agg(F.array_sort(F.collect_list(F.struct("path", "r.rule_no", "r.allow"))).alias("paths"))
    lengths = F.array_sort(F.array_distinct(F.transform("paths", lambda r: F.char_length(r["path"]))))
    ordered = F.array_sort(F.transform("paths", lambda r: F.struct(
        r["rule_no"].alias("rule_no"), F.when(r["path"] == "*", F.lit("")).otherwise(r["path"]).alias("start"), r["allow"].alias("allow"))))
    group = group.select("host", "token", F.struct("paths", lengths.alias("lengths"), ordered.alias("ordered")).alias("rules"))
    return group.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("token", "rules"))).alias("rules"))


def rule_of(paths: Column, path: Column) -> Column:
    """The rule of exactly that path among rules sorted by path, found by halving; null if there is none."""
    halves = F.sequence(F.lit(0), F.length(F.bin(F.size(paths).cast("bigint"))))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        low = F.get(paths, mid)["path"] <= path
        return F.struct(F.when(low, mid).otherwise(acc["lo"]).alias("lo"), F.when(low, acc["hi"]).otherwise(mid).alias("hi"))

    at = F.aggregate(halves, F.struct(F.lit(0).alias("lo"), F.size(paths).alias("hi")), halve, lambda acc: F.get(paths, acc["lo"]))
    return F.when(at["path"] == path, at)


#: Groups of so few paths are tried one by one, which is cheaper than looking up the starts of the URL; the result is the same.
FEW_RULES = 16


def first_allow(rules: Column, key: Column) -> Column:
    """What the first rule in file order says whose path is "*" or a prefix of the key; null if there is none.

    The prefixes of the key that are as long as some path are looked up among the sorted paths, so a host
    with many rules costs its number of lengths times the logarithm of its number of rules."""
    starts = F.transform(F.filter(rules["lengths"], lambda n: n <= F.char_length(key)), lambda n: F.left(key, n))
    found = F.transform(F.concat(F.array(F.lit("*")), starts), lambda p: rule_of(rules["paths"], p))
    looked_up = F.transform(F.filter(found, lambda r: r.isNotNull()), lambda r: F.struct(r["rule_no"].alias("rule_no"), r["allow"].alias("allow")))
    tried = F.filter(rules["ordered"], lambda r: F.startswith(key, r["start"]))
    return F.when(F.size(rules["paths"]) <= FEW_RULES, F.get(tried, 0)["allow"]).otherwise(F.array_min(looked_up)["allow"])


def can_fetch_agents(urls: DataFrame, rules: DataFrame, user_agents: list[str], url_col: str = "url") -> DataFrame:
    """D3: every URL row once for each user agent, with ``agent`` (its token) and ``allowed``.

    URL rows meet their host's applicable rule groups in one equi-join on host (AQE broadcasts the
    per-host table when it is small and splits a host that holds a large share of the URLs), and
    the first rule in file order whose path is a prefix of the URL key decides; no rule or no
    robots row allows. The URL side is read once, its key is made once, and it is never regrouped.
    """
    from pagelens.functions.urls import netloc
    from pagelens.operators.parse import members

    tokens = sorted({agent_token(a) for a in user_agents})
    of_token = [F.element_at("rules", F.lit(t)).alias(f"_rules{i}") for i, t in enumerate(tokens)]
    hr = host_rules(rules, user_agents).select(F.col("host").alias("_rhost"), *of_token)
    # host and key are made before the join: a URL that is not asked for further does not move
    u = urls.withColumns({"_host": F.lower(netloc(F.col(url_col))), "_key": url_key(F.col(url_col))})
    j = u.join(hr, u["_host"] == hr["_rhost"], "left")

    def verdict(i, token):
        allow = first_allow(F.col(f"_rules{i}"), F.col("_key"))
        return F.struct(F.lit(token).alias("agent"), F.coalesce(allow, F.lit(True)).alias("allowed"))

    each = F.array(*[verdict(i, t) for i, t in enumerate(tokens)])
    # the outer form: no filter on the verdicts is inferred, which would compute them twice
    return members(j, [F.col(c) for c in urls.columns], each, "_v").select(*urls.columns, "_v.agent", "_v.allowed")


def can_fetch(urls: DataFrame, rules: DataFrame, user_agent: str = dims.DEFAULT_USER_AGENT, url_col: str = "url") -> DataFrame:
    """D3 for one user agent: adds ``allowed`` to every URL row."""
    return can_fetch_agents(urls, rules, [user_agent], url_col).drop("agent")


def sitemaps(summary: DataFrame, status: DataFrame) -> DataFrame:
    """candidates = declared sitemaps, then /sitemap.xml and /sitemap_index.xml of the host;
    duplicates keep their first place; exists = status 200; found = first existing candidate.
    ``summary`` from D1 plus ``base`` (scheme://netloc); ``status``: (url, status_code)."""
    cands = F.concat(
        F.col("sitemaps"),
        F.array(F.concat("base", F.lit("/sitemap.xml")), F.concat("base", F.lit("/sitemap_index.xml"))),
    )
    c = summary.select("host", F.posexplode(F.array_distinct(cands)).alias("cand_no", "url"))
    j = c.join(status, "url", "left")
    code = F.when(F.col("status_code") < 400, F.col("status_code"))
    checked = j.select("host", "cand_no", "url", (F.coalesce(F.col("status_code"), F.lit(0)) == 200).alias("exists"), code.alias("status_code"))
    return checked


def sitemap_found(checked: DataFrame) -> DataFrame:
    return checked.groupBy("host").agg(
        F.min_by(F.when(F.col("exists"), F.col("url")), F.when(F.col("exists"), F.col("cand_no"))).alias("found"),
        F.count(F.lit(1)).alias("checked"),
    )
