"""Images, media, scripts and stylesheets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens import dims
from pagelens.functions.markup import within
from pagelens.operators.parse import attr, let, page_cols, rel_tokens, tags, truthy


def _or(a: Column, b: Column) -> Column:
    """Python ``a or b`` over optional strings."""
    return F.when(truthy(a), a).otherwise(b)


@page_cols
def images(linked: Column | None = None) -> Column:
    """Every <img> in order: src (or data-src; data URIs summarised; resolved), alt, width, height."""
    def one(s):
        src = _or(attr(s, "src"), _or(attr(s, "data-src"), F.lit("")))
        shown = (
            F.when(src.startswith("data:"), F.format_string("[inline data-uri, %d chars]", F.char_length(src)))
            .when(src != "", s["url"])
        )
        return F.struct(shown.alias("src"), attr(s, "alt").alias("alt"), attr(s, "width").alias("width"), attr(s, "height").alias("height"))

    return F.transform(tags(["img"], linked), one)


def image_section(items: Column) -> Column:
    return let(items, lambda it: F.struct(
        F.size(it).cast("bigint").alias("count"),
        F.size(F.filter(it, lambda x: ~truthy(x["alt"]))).cast("bigint").alias("missing_alt_count"),
        it.alias("items"),
    ))


@page_cols
def videos(linked: Column | None = None) -> Column:
    """Sorted distinct sources of <video src> and of <source src> inside a <video>."""
    def build(vids):
        own = F.transform(F.filter(vids, lambda v: truthy(attr(v, "src"))), lambda v: v["url"])
        nested = F.flatten(F.transform(vids, lambda v: F.transform(
            F.filter(within(linked, v), lambda s: (s["name"] == "source") & truthy(attr(s, "src"))), lambda s: s["url"])))
        return F.array_sort(F.array_distinct(F.concat(own, nested)))

    return let(tags(["video"], linked), build)


@page_cols
def audios(linked: Column | None = None) -> Column:
    """Sorted distinct <audio src> (child <source> elements are not read)."""
    a = F.filter(tags(["audio"], linked), lambda s: truthy(attr(s, "src")))
    return F.array_sort(F.array_distinct(F.transform(a, lambda s: s["url"])))


@page_cols
def players(linked: Column | None = None) -> Column:
    """iframes whose src names a video player, document order, duplicates kept."""
    return F.transform(_player_frames(linked), lambda s: s["url"])


def _player_frames(linked: Column) -> Column:
    fr = F.filter(tags(["iframe"], linked), lambda s: F.map_contains_key(s["a"], "src"))
    return F.filter(fr, lambda s: F.exists(F.array(*[F.lit(m) for m in dims.PLAYER_MARKERS]), lambda m: F.instr(attr(s, "src"), m) > 0))


@page_cols
def media_section(linked: Column | None = None) -> Column:
    return F.struct(videos(linked).alias("videos"), audios(linked).alias("audios"), players(linked).alias("embedded_players"))


@page_cols
def media_refs(linked: Column | None = None) -> Column:
    """The elements whose URL the media section resolves."""
    return F.concat(F.filter(linked, lambda s: s["name"].isin("video", "audio", "source") & truthy(attr(s, "src"))), _player_frames(linked))


def _is_sheet(s: Column) -> Column:
    return (s["name"] == "link") & F.array_contains(rel_tokens(s), "stylesheet") & truthy(attr(s, "href"))


@page_cols
def script_refs(linked: Column | None = None) -> Column:
    """The elements whose URL the scripts section resolves."""
    return F.filter(linked, lambda s: (s["name"] == "script") | _is_sheet(s))


@page_cols
def scripts_styles(linked: Column | None = None) -> Column:
    """External scripts (src present, even empty), inline scripts (src missing or empty),
    stylesheets (rel token "stylesheet" with an href), inline <style> count."""
    def build(tg):
        scripts = F.filter(tg, lambda s: s["name"] == "script")
        ext = F.transform(F.filter(scripts, lambda s: F.map_contains_key(s["a"], "src")), lambda s: s["url"])
        sheets = F.filter(tg, _is_sheet)
        return F.struct(
            ext.alias("external_scripts"),
            F.size(F.filter(scripts, lambda s: ~truthy(attr(s, "src")))).cast("bigint").alias("inline_script_count"),
            F.transform(sheets, lambda s: s["url"]).alias("external_stylesheets"),
            F.size(F.filter(tg, lambda s: s["name"] == "style")).cast("bigint").alias("inline_style_count"),
        )

    return let(tags(["script", "link", "style"], linked), build)
