"""Title, meta tags, document-level meta, Open Graph / Twitter maps and headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.functions import html as H
from pagelens.functions.markup import element_text
from pagelens.operators.parse import attr, let, page_cols, rel_tokens, tags, truthy

META_NAMES = ["description", "keywords", "author", "viewport", "robots", "generator"]


@page_cols
def title(els: Column | None = None, texts: Column | None = None) -> Column:
    """Text of the first <title>; null without a tag, '' when empty."""
    first = F.get(tags(["title"], els), 0)
    return F.when(first.isNotNull(), element_text(texts, first))


def text_length(c: Column) -> Column:
    return F.coalesce(F.char_length(c), F.lit(0))


def _first_meta(metas: Column, name: str) -> Column:
    hit = F.get(F.filter(metas, lambda m: F.lower(attr(m, "name")) == name), 0)
    content = attr(hit, "content")
    return F.when(truthy(content), H.strip(content))


@page_cols
def meta_tags(els: Column | None = None) -> Column:
    """struct of description, keywords, author, viewport, robots, generator: the first <meta> with
    that name decides (case-insensitive name); empty content gives null, blank content ''."""
    return let(tags(["meta"], els), lambda metas: F.struct(*[_first_meta(metas, n).alias(n) for n in META_NAMES]))


@page_cols
def meta_document(linked: Column | None = None) -> Column:
    """language, canonical (raw href), favicon (resolved), charset."""
    return let(tags(["html", "link", "meta"], linked), _meta_document)


def _icon(links: Column) -> Column:
    return F.get(F.filter(links, lambda s: F.lower(F.coalesce(attr(s, "rel"), F.lit(""))).contains("icon")), 0)


@page_cols
def icon_refs(linked: Column | None = None) -> Column:
    """The elements whose URL the meta section resolves: the first icon."""
    return F.array_compact(F.array(_icon(tags(["link"], linked))))


def _meta_document(tg: Column) -> Column:
    html_tag = F.get(F.filter(tg, lambda s: s["name"] == "html"), 0)
    links = F.filter(tg, lambda s: s["name"] == "link")
    canonical = F.get(F.filter(links, lambda s: F.array_contains(rel_tokens(s), "canonical")), 0)
    icon = _icon(links)
    charset = F.get(F.filter(tg, lambda s: (s["name"] == "meta") & F.map_contains_key(s["a"], "charset")), 0)
    can_href = attr(canonical, "href")
    icon_href = attr(icon, "href")
    return F.struct(
        attr(html_tag, "lang").alias("language"),
        F.when(truthy(can_href), can_href).alias("canonical"),
        F.when(truthy(icon_href), icon["url"]).alias("favicon"),
        attr(charset, "charset").alias("charset"),
    )


def _prefixed_map(els: Column, key_attr: str, prefix: str) -> Column:
    metas = tags(["meta"], els)
    sel = F.filter(metas, lambda m: F.coalesce(attr(m, key_attr), F.lit("")).startswith(prefix))
    entries = F.transform(
        sel, lambda m: F.struct(F.replace(attr(m, key_attr), F.lit(prefix), F.lit("")).alias("key"), attr(m, "content").alias("value"))
    )
    kept = F.filter(entries, lambda e: (e["key"] != "") & truthy(e["value"]))
    return F.map_from_entries(kept)


@page_cols
def open_graph(els: Column | None = None) -> Column:
    """og:* properties (key without every "og:"), last duplicate wins."""
    return _prefixed_map(els, "property", "og:")


@page_cols
def twitter_card(els: Column | None = None) -> Column:
    return _prefixed_map(els, "name", "twitter:")


@page_cols
def headings(els: Column | None = None, texts: Column | None = None) -> Column:
    """struct h1..h6 of non-empty heading texts in document order."""
    out = []
    for lvl in range(1, 7):
        found = F.transform(tags([f"h{lvl}"], els), lambda s: element_text(texts, s))
        out.append(F.filter(found, lambda t: t != "").alias(f"h{lvl}"))
    return F.struct(*out)


@page_cols
def meta_section(els: Column | None = None, texts: Column | None = None, linked: Column | None = None) -> Column:
    """The page's ``meta`` record."""
    return let(title(els, texts), lambda t: let(meta_tags(els), lambda mt: let(meta_document(linked), lambda md: _meta_record(els, t, mt, md))))


def _meta_record(els: Column, t: Column, mt: Column, md: Column) -> Column:
    return F.struct(
        t.alias("title"),
        F.when(truthy(t), F.char_length(t)).otherwise(0).alias("title_length"),
        mt["description"].alias("description"),
        F.when(truthy(mt["description"]), F.char_length(mt["description"])).otherwise(0).alias("description_length"),
        mt["keywords"].alias("keywords"),
        mt["author"].alias("author"),
        mt["viewport"].alias("viewport"),
        mt["robots"].alias("robots"),
        mt["generator"].alias("generator"),
        md["language"].alias("language"),
        md["canonical"].alias("canonical"),
        md["favicon"].alias("favicon"),
        md["charset"].alias("charset"),
        open_graph(els).alias("open_graph"),
        twitter_card(els).alias("twitter_card"),
    )
