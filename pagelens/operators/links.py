"""Links: extraction, counts, external domains, mailto/tel, social profiles, link graph and the
unique-link table (C9-C12, C24, D5, E1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens import dims
from pagelens.functions import html as H
from pagelens.functions.urls import cut_fragment, netloc
from pagelens.functions.markup import element_text
from pagelens.operators.parse import attr, exploded, let, page_cols, rel_tokens, tags


@page_cols
def anchors(linked: Column | None = None, texts: Column | None = None) -> Column:
    """<a> tags that carry an href: array<struct<i, href (stripped), url, bad, text, nofollow>>."""
    a = F.filter(tags(["a"], linked), lambda s: F.map_contains_key(s["a"], "href"))
    return F.transform(
        a,
        lambda s: F.struct(
            s["i"].alias("i"),
            H.strip(attr(s, "href")).alias("href"),
            s["url"].alias("url"),
            s["bad"].alias("bad"),
            F.substring(element_text(texts, s), 1, dims.LINK_TEXT_CHARS).alias("text"),
            F.exists(rel_tokens(s), lambda r: F.lower(r) == "nofollow").alias("nofollow"),
        ),
    )


def _usable(anc: Column) -> Column:
    return F.filter(
        anc,
        lambda x: (x["href"] != "") & ~x["href"].startswith("#") & ~F.lower(x["href"]).startswith("javascript:"),
    )


def mailto(anc: Column) -> Column:
    """mailto targets, prefix cut, document order, duplicates kept."""
    sel = F.filter(_usable(anc), lambda x: F.lower(x["href"]).startswith("mailto:"))
    return F.transform(sel, lambda x: F.substr(x["href"], F.lit(8)))


def tel(anc: Column) -> Column:
    sel = F.filter(_usable(anc), lambda x: ~F.lower(x["href"]).startswith("mailto:") & F.lower(x["href"]).startswith("tel:"))
    return F.transform(sel, lambda x: F.substr(x["href"], F.lit(5)))


def followed(anc: Column) -> Column:
    """The anchors that lead to a page: neither mailto nor tel."""
    return F.filter(_usable(anc), lambda x: ~F.lower(x["href"]).startswith("mailto:") & ~F.lower(x["href"]).startswith("tel:"))


@page_cols
def page_links(anc: Column, base: Column | None = None) -> Column:
    """Resolved, fragment-free links, first occurrence of each URL kept, in document order:
    array<struct<url, text, nofollow, internal>>."""
    resolved = F.transform(
        followed(anc), lambda x: F.struct(cut_fragment(x["url"]).alias("url"), x["text"].alias("text"), x["nofollow"].alias("nofollow")))
    base_net = netloc(base)

    def first_only(res):
        # first occurrence per URL: sorted by (url, place), a link is the first of its URL where the one before has
        # another; sorted back by place (a map lookup per link would be a linear search each)
        placed = F.sort_array(F.transform(res, lambda x, k: F.struct(x["url"].alias("url"), k.alias("k"))))
        firsts = let(placed, lambda p: F.filter(p, lambda x, j: (j == 0) | (F.get(p, j - 1)["url"] != x["url"])))
        return F.transform(F.sort_array(F.transform(firsts, lambda x: x["k"])), lambda k: F.get(res, k))

    uniq = let(resolved, first_only)
    return let(base_net, lambda bn: F.transform(
        uniq,
        lambda x: F.struct(
            x["url"].alias("url"), x["text"].alias("text"), x["nofollow"].alias("nofollow"),
            (netloc(x["url"]) == bn).alias("internal"),
        ),
    ))


def links_section(anc: Column, links: Column) -> Column:
    return let(mailto(anc), lambda mt: let(tel(anc), lambda tl: _links_record(links, mt, tl)))


def _links_record(links: Column, mt: Column, tl: Column) -> Column:
    internal = F.filter(links, lambda x: x["internal"])
    external = F.filter(links, lambda x: ~x["internal"])
    strip_flag = lambda arr: F.transform(arr, lambda x: F.struct(x["url"].alias("url"), x["text"].alias("text"), x["nofollow"].alias("nofollow")))
    return F.struct(
        F.size(links).cast("bigint").alias("total"),
        strip_flag(internal).alias("internal"),
        strip_flag(external).alias("external"),
        F.size(internal).cast("bigint").alias("internal_count"),
        F.size(external).cast("bigint").alias("external_count"),
        external_domains(links).alias("unique_external_domains"),
        F.size(F.filter(links, lambda x: x["nofollow"])).cast("bigint").alias("nofollow_count"),
        F.size(mt).cast("bigint").alias("mailto_count"),
        F.size(tl).cast("bigint").alias("tel_count"),
        mt.alias("mailto"),
        tl.alias("tel"),
    )


def external_domains(links: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(links, lambda x: ~x["internal"]), lambda x: netloc(x["url"]))))


def social_links(links: Column) -> Column:
    """platform -> first link (internal links before external) whose netloc, with "www." removed,
    contains one of the platform's domains. array<struct<platform, url>> in discovery order."""
    ordered = F.concat(F.filter(links, lambda x: x["internal"]), F.filter(links, lambda x: ~x["internal"]))
    hosts = F.transform(ordered, lambda x, k: F.struct(x["url"].alias("url"), F.replace(netloc(x["url"]), F.lit("www."), F.lit("")).alias("h"), k.alias("k")))
    return let(hosts, _social_hits)


def _social_hits(hosts: Column) -> Column:
    found = []
    for name, domains in dims.social_platforms():
        hit = F.get(F.filter(hosts, lambda x: F.exists(F.array(*[F.lit(d) for d in domains]), lambda d: F.instr(x["h"], d) > 0)), 0)
        found.append(F.struct(F.lit(name).alias("platform"), hit["url"].alias("url"), hit["k"].alias("k")))
    # discovery order = order in which the dictionary got the key: by link position, then by the
    # order of the domain list for links that hit several platforms
    hits = F.filter(F.array(*found), lambda s: s["url"].isNotNull())
    ordered_hits = F.array_sort(hits, lambda l, r: F.when(l["k"] < r["k"], -1).when(l["k"] > r["k"], 1).otherwise(0))
    return F.transform(ordered_hits, lambda s: F.struct(s["platform"].alias("platform"), s["url"].alias("url")))


# --------------------------------------------------------------------------- relational forms


def link_table(df: DataFrame, links_col: str = "links", key: str = "page_id", extra: list[str] | None = None) -> DataFrame:
    """One row per (page, link) with its rank in the page (no shuffle)."""
    cols = [key] + (extra or [])
    return exploded(df, cols, F.col(links_col), "rank", "l").select(
        *cols, "rank", F.col("l.url").alias("url"), F.col("l.text").alias("text"),
        F.col("l.nofollow").alias("nofollow"), F.col("l.internal").alias("internal"),
    )


def link_graph(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """Edges page -> internal link (fragment cut) whose netloc equals the seed's netloc.

    ``links``: (page_id, rank, url, internal); ``seeds``: (page_id, seed_url). The seed table has
    one row per page, so the join is an equi-join on page_id.
    """
    e = links.filter(F.col("internal")).join(seeds, "page_id")
    e = e.select("page_id", "rank", cut_fragment(F.col("url")).alias("dst"), F.col("seed_url"))
    return e.filter(netloc(F.col("dst")) == netloc(F.col("seed_url"))).select("page_id", "rank", "dst")


def unique_links(links: DataFrame, order_cols: list[str]) -> DataFrame:
    """Distinct link URLs across pages: where first seen, and the attributes of the last sighting.

    ``order_cols`` give the global sighting order (e.g. page order, then link rank). One
    ``groupBy(url)`` with partial aggregation; a URL linked from a third of all pages still
    aggregates map-side first, so no task receives its raw sightings.
    """
    o = F.struct(*[F.col(c) for c in order_cols])
    return links.groupBy("url").agg(
        F.min(o).alias("first_seen"),
        F.max_by(F.struct("text", "nofollow"), o).alias("last"),
        F.count(F.lit(1)).alias("sightings"),
    ).select("url", "first_seen", F.col("last.text").alias("text"), F.col("last.nofollow").alias("nofollow"), "sightings")
