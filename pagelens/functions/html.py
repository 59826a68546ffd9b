"""HTML as column expressions.

A page's HTML is split into an ordered array of raw tokens by one regular expression
(``regexp_extract_all``); every per-page section is then a higher-order function over that
array. Nothing leaves the row, so the page report needs no shuffle at all.

Token kinds: ``comment``, ``decl`` (doctype / processing instruction), ``start`` (a start tag;
script and style start tags carry their whole raw body), ``end`` and ``text``.
"""

from __future__ import annotations

import html.entities
import zlib
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One token per match. Raw-text elements come before tags so "</p>" inside a script string is not
# a tag; the quoted-attribute alternative keeps ">" inside quotes; a bare "<" is text.
TOKEN_RX = (
    r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
    r"|<[!/?a-z][^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*+>|<[!/?a-z][^>]*>|[^<]+|<"
)
# Same grammar for RE2 (DuckDB oracle): no possessive quantifier.
TOKEN_RX_RE2 = TOKEN_RX.replace(")*+>", ")*>")

TAG_NAME_RX = r"^</?([a-zA-Z][^\t\n\r\f />\x00]*)"
ATTR_RX = r"([^\s=/>\"'<]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+))?"

# Python's str.isspace() set, written so Java and RE2 read it the same way.
WS_CLASS = r"[\t\n\x{0b}\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

#: A start tag from its beginning; quoted values may hold ">".
QUOTED_TAG_RX = r"(?s)^<[!/?a-zA-Z][^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*+>"

#: Numeric references 128-159 mean Windows-1252 characters where that has one (standard library codec).
WINDOWS_1252 = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}

ENTITY_RX = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)"

# elements whose content is not page text
_HIDDEN_RX = (
    r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
    r"|<noscript\b[^>]*>.*?(?:</noscript\s*>|\z)|<template\b[^>]*>.*?(?:</template\s*>|\z)"
    r"|<[!/?a-z][^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*+>|<[!/?a-z][^>]*>"
)


# --------------------------------------------------------------------------- strings


def strip(c: Column) -> Column:
    """Python ``str.strip()``: Unicode whitespace on both ends."""
    return F.regexp_replace(c, f"^{WS_CLASS}+|{WS_CLASS}+$", "")


def squeeze(c: Column) -> Column:
    """Collapse whitespace runs to one space and strip."""
    return strip(F.regexp_replace(c, f"{WS_CLASS}+", " "))


ENTS = "_ents"  # column holding the named references in buckets (added by ``with_entities``)
#: Buckets of the named references: about one name in two buckets.
ENT_BUCKETS = 4096


@lru_cache(maxsize=1)
def _entity_buckets() -> list[list[tuple[str, str]]]:
    # The HTML5 named character references, taken from the Python standard library table, by the checksum of their name.
    buckets: list[list[tuple[str, str]]] = [[] for _ in range(ENT_BUCKETS)]
    for name, value in sorted(html.entities.html5.items()):
        buckets[zlib.crc32(name.encode()) % ENT_BUCKETS].append((name, value))
    return buckets


def entity_table(spark) -> "DataFrame":
    """One row, one column: the HTML5 named references, in an array of buckets."""
    return spark.createDataFrame([(_entity_buckets(),)], f"{ENTS} array<array<struct<name:string,value:string>>>")


def with_entities(df: "DataFrame") -> "DataFrame":
    """Attach the named references to every row: a broadcast of a single row (some 100 kB), so the
    join is a map-side nested loop against one row, never a shuffle."""
    if ENTS in df.columns:
        return df
    return df.crossJoin(F.broadcast(entity_table(df.sparkSession)))


def entity(name: Column) -> Column:
    """What a named reference (without "&") stands for; null if there is none of that name. Only the names of its bucket are tried."""
    bucket = F.get(F.col(ENTS), F.pmod(F.crc32(name.cast("binary")), F.lit(ENT_BUCKETS)).cast("int"))
    return F.get(F.filter(bucket, lambda e: e["name"] == name), 0)["value"]


def _codepoint_char(cp: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32")


def _decode_ref(ref: Column) -> Column:
    body = F.substr(ref, F.lit(2))  # without the "&"
    # more than eight significant hex digits are beyond every code point (and beyond what conv takes)
    hexa = F.regexp_extract(body, r"^#[xX]0*([0-9a-fA-F]*)", 1)
    num = F.when(
        body.rlike("^#[xX]"), F.when(F.length(hexa) > 8, F.lit(float(1 << 33))).when(hexa == "", F.lit(0.0)).otherwise(F.conv(hexa, 16, 10).cast("double"))
    ).when(body.startswith("#"), F.regexp_extract(body, r"^#([0-9]+)", 1).cast("double"))
    numeric = (
        F.when((num == 0) | ((num >= 0xD800) & (num <= 0xDFFF)) | (num > 0x10FFFF), F.lit("�"))
        .when((num >= 0x80) & (num <= 0x9F), F.element_at(F.create_map(*[F.lit(x) for kv in WINDOWS_1252.items() for x in kv]), num.cast("int")))
        .when(((num >= 0x1) & (num <= 0x8)) | (num == 0xB) | ((num >= 0xE) & (num <= 0x1F))
              | ((num >= 0x7F) & (num <= 0x9F)), F.lit(""))
        .otherwise(_codepoint_char(num.cast("bigint")))
    )
    # legacy names (at most six letters, written without a semicolon) also count as the start of a longer one, the longest first
    starts = F.transform(F.sequence(F.lit(6), F.lit(2), F.lit(-1)), lambda k: F.when(
        k < F.length(body), F.concat(entity(F.left(body, k)), F.substr(body, k + 1))))
    named = F.coalesce(entity(body), F.get(F.array_compact(starts), F.lit(0)), ref)
    return F.when(body.startswith("#"), numeric).otherwise(named)


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (``transform`` over a one-element array)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unescape(c: Column) -> Column:
    """Decode named, decimal and hex character references; unknown ones stay as written."""

    def dec(s):
        parts = F.split(s, ENTITY_RX, -1)
        refs = F.transform(F.regexp_extract_all(s, F.lit(ENTITY_RX), 0), _decode_ref)
        joined = F.array_join(F.zip_with(parts, refs, lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")
        return F.when(s.contains("&"), joined).otherwise(s)

    return bind(c, dec)


# --------------------------------------------------------------------------- tokens


def tokenize(html: Column) -> Column:
    """Ordered raw tokens of a page (array<string>); joined they give back the page."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKEN_RX), 0)


def _is_letter(c: Column) -> Column:
    return ((c >= "a") & (c <= "z")) | ((c >= "A") & (c <= "Z"))


def token_kind(t: Column) -> Column:
    """Kind from the first characters only (a failed anchored pattern would rescan long text)."""
    c1, c2, c3 = F.substring(t, 1, 1), F.substring(t, 2, 1), F.substring(t, 3, 1)
    return (
        F.when(c1 != "<", "text")
        .when(t.startswith("<!--") & t.endswith("-->") & (F.length(t) >= 7), "comment")
        .when((c2 == "/") & _is_letter(c3), "end")
        .when(_is_letter(c2), "start")
        .when(c2.isin("!", "?", "/") & t.endswith(">"), "decl")
        .otherwise("text")
    )


def tag_name(t: Column) -> Column:
    """Lower-cased tag name of a start/end tag token; '' for every other token."""
    c1, c2, c3 = F.substring(t, 1, 1), F.substring(t, 2, 1), F.substring(t, 3, 1)
    is_tag = (c1 == "<") & (_is_letter(c2) | ((c2 == "/") & _is_letter(c3)))
    return F.when(is_tag, F.lower(F.regexp_extract(t, TAG_NAME_RX, 1))).otherwise(F.lit(""))


def classify(tok: Column) -> Column:
    """array<struct<i INT, t STRING, kind STRING, name STRING>> with 0-based positions."""

    def one(t, i):
        return F.struct(i.alias("i"), t.alias("t"), token_kind(t).alias("kind"), tag_name(t).alias("name"))

    return F.transform(tok, one)


def open_tag(t: Column) -> Column:
    """The start tag of a token (script/style tokens carry their body); a ">" inside quotes does not end it."""
    whole = F.regexp_extract(t, QUOTED_TAG_RX, 0)
    return F.when(whole != "", whole).otherwise(F.regexp_extract(t, r"(?s)^<[^>]*>", 0))


def attr_map(t: Column) -> Column:
    """Attributes of a start tag: lower-cased names, unquoted and decoded values; last duplicate wins.

    A name without a value maps to ''.
    """
    tag = open_tag(t)
    rest = F.regexp_replace(F.regexp_replace(tag, r"^<[a-zA-Z][^\t\n\r\f />\x00]*", ""), r"/?>$", "")
    keys = F.transform(F.regexp_extract_all(rest, F.lit(ATTR_RX), 1), lambda k: F.lower(k))
    vals = F.transform(
        F.regexp_extract_all(rest, F.lit(ATTR_RX), 2),
        lambda v: unescape(F.regexp_replace(v, r"""(?s)^(["'])(.*)\1$""", "$2")),
    )
    return F.map_from_arrays(keys, vals)


def raw_body(t: Column) -> Column:
    """Body of a script/style token ('' when the element was not closed)."""
    return bind(open_tag(t), lambda tag: F.regexp_extract(F.substr(t, F.length(tag) + 1), r"(?is)^(.*)</[a-z]+\s*>$", 1))


# --------------------------------------------------------------------------- page text


def visible_text(html: Column) -> Column:
    """Page text: script/style/noscript/template and comments dropped, text nodes joined by one
    space, entities decoded, whitespace collapsed and stripped."""
    no_tags = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN_RX, " ")
    return squeeze(unescape(no_tags))
