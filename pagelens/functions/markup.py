"""A page's markup as columns: tokens, elements with their extent, text nodes and visible text.

Where an element ends depends on every tag before it, and whether a "<" is markup depends on the element it
stands in; neither is a per-token expression. So one pass over each page keeps that state: a tokenizer that knows
raw text (script, style, ...), text-only elements (textarea) and CDATA sections, and one stack of open elements with
the implied end tags of HTML. It runs as an Arrow function over batches of pages and hands back plain nested
columns; all analysis of them stays in Spark expressions.

Elements carry nested-set numbers, so containment needs no search: ``i``..``end`` in tokens, ``k`` (own place) and
``n`` (descendants, which follow directly) in the element array, ``t0``..``t1`` in the array of text nodes.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens import dims

# One token per match: comment, CDATA section, tag (">" inside quotes does not end it), tag with unbalanced quotes, text.
_TOKEN = re.compile(
    r"""<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[!/?a-zA-Z][^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*+>|<[!/?a-zA-Z][^>]*>|[^<]+|<""", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\t\n\r\f />\x00]*)")
_ATTR = re.compile(r"""([^\s=/>"'<]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_VOID = frozenset(dims.VOID_ELEMENTS)
_RAW, _TEXT_ONLY = frozenset(dims.RAW_TEXT_ELEMENTS), frozenset(dims.TEXT_ONLY_ELEMENTS)
_HIDDEN = frozenset(dims.HIDDEN_ELEMENTS)
_IMPLIED = {start: (frozenset(ends), frozenset(within)) for starts, ends, within in dims.IMPLIED_ENDS for start in starts}
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW | _TEXT_ONLY}


def tokens(page: str) -> list[tuple[str, str, str]]:
    """(kind, name, raw) of every token; the raws joined are the page. A raw-text element is one token, body and end tag
    included, up to its end tag or the end of the page; the body of a text-only element is one text token."""
    out, at, n = [], 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        raw, end = m.group(), m.end()
        kind, name = "text", ""
        if raw[0] == "<" and len(raw) > 1:
            named = _NAME.match(raw)
            if named:
                kind, name = "end" if raw[1] == "/" else "start", named[1].lower()
            else:
                kind = "comment" if raw.startswith("<!--") and raw.endswith("-->") and len(raw) > 6 or raw.startswith("<![CDATA[") else "decl"
        if kind == "start" and name in _RAW:
            close = _CLOSE[name].search(page, end)
            end = close.end() if close else n
            raw = page[at:end]
        out.append((kind, name, raw))
        if kind == "start" and name in _TEXT_ONLY:
            close = _CLOSE[name].search(page, end)
            body = close.start() if close else n
            if body > end:
                out.append(("text", "", page[end:body]))
                end = body
        at = end
    return out


def _open_tag(raw: str) -> str:
    m = _TOKEN.match(raw)
    return m.group() if m else raw


def attributes(tag: str) -> dict[str, str]:
    """Lower-cased names, decoded values; '' without a value; the last of equal names holds."""
    named = _NAME.match(tag)
    rest = tag[named.end():] if named else ""
    rest = rest[:-2] if rest.endswith("/>") else rest[:-1] if rest.endswith(">") else rest
    out = {}
    for name, value in _ATTR.findall(rest):
        if value and value[0] in "\"'" and len(value) > 1 and value[-1] == value[0]:
            value = value[1:-1]
        out[name.lower()] = html.unescape(value) if "&" in value else value
    return out


def _read_tag(raw: str) -> tuple[str, bool, dict[str, str]]:
    """Name ('' for a comment or declaration), whether it is an end tag, and the attributes of a start tag."""
    named = _NAME.match(raw)
    if not named:
        return "", False, {}
    return (named[1].lower(), True, {}) if raw[1] == "/" else (named[1].lower(), False, attributes(raw))


#: Short tags recur (<td>, </a>); a bounded number of them is remembered, the result is the same.
_recent_tag, _SHORT_TAG = lru_cache(maxsize=4096)(_read_tag), 128


def parse(page: str) -> tuple[int, str, list[str], list[tuple]]:
    """Number of tokens, visible text, text nodes, and elements (i, end, k, n, t0, t1, name, attributes, body).

    A start tag first ends what it implies (``dims.IMPLIED_ENDS``); an end tag ends the innermost open element of its name and
    all inside it; stray end tags are ignored; what is left open ends with the page. Text nodes are decoded and
    stripped, empty ones left out; tokens of text that touch are one node. Tokens are those of ``tokens``, read in the same pass."""
    texts: list[str] = []
    shown: list[str] = []
    elements: list[list] = []
    stack: list[int] = []
    hidden = 0
    pending: list[str] = []

    def flush() -> None:
        text = html.unescape(pending[0] if len(pending) == 1 else "".join(pending)).strip()
        pending.clear()
        if text:
            texts.append(text)
            if not hidden:
                shown.append(text)

    def close(depth: int, i: int) -> None:
        nonlocal hidden
        last, count = len(elements) - 1, len(texts)
        for k in stack[depth:]:
            e = elements[k]
            e[1], e[3], e[5] = i, last - k, count
            hidden -= e[6] in _HIDDEN
        del stack[depth:]

    i, at, n = 0, 0, len(page)
    while at < n:
        start, at = at, n
        for m in _TOKEN.finditer(page, start):
            raw = m.group()
            if raw[0] != "<" or len(raw) == 1:
                pending.append(raw)
                i += 1
                continue
            if pending:
                flush()
            name, is_end, attrs = _recent_tag(raw) if len(raw) <= _SHORT_TAG else _read_tag(raw)
            if is_end:
                for depth in range(len(stack) - 1, -1, -1):
                    if elements[stack[depth]][6] == name:
                        close(depth, i)
                        break
            elif name:
                if name in _IMPLIED:
                    ends, within = _IMPLIED[name]
                    first = None
                    for depth in range(len(stack) - 1, -1, -1):
                        held = elements[stack[depth]][6]
                        if held in within:
                            break
                        if held in ends:
                            first = depth
                    if first is not None:
                        close(first, i)
                k, count = len(elements), len(texts)
                if name in _RAW:
                    end = _CLOSE[name].search(page, m.end())
                    elements.append([i, i, k, 0, count, count, name, attrs, page[m.end():end.start() if end else n]])
                    at = end.end() if end else n
                    i += 1
                    break
                elements.append([i, i, k, 0, count, count, name, attrs, None])
                if name not in _VOID:
                    stack.append(k)
                    hidden += name in _HIDDEN
                if name in _TEXT_ONLY:
                    end = _CLOSE[name].search(page, m.end())
                    at = end.start() if end else n
                    i += 1
                    if at > m.end():
                        pending.append(page[m.end():at])
                        i += 1
                    break
            i += 1
    if pending:
        flush()
    close(0, i)
    return i, re.sub(r"\s+", " ", " ".join(shown)), texts, elements


# --------------------------------------------------------------------------- columns

_NUMBERS = ["i", "end", "k", "n", "t0", "t1"]
ELEMENT = "struct<" + ",".join(f"{n}:int" for n in _NUMBERS) + ",name:string,a:map<string,string>,body:string>"
PAGE = f"struct<ntok:int,text:string,texts:array<string>,els:array<{ELEMENT}>>"
TOKENS = "array<struct<kind:string,name:string,raw:string>>"


def _lists(sizes: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(list(accumulate(sizes, initial=0)), pa.int32()), values)


#: Characters of markup whose Python objects are held at once; a batch of pages is worked off in slices of about so many.
SLICE_CHARS = 1 << 18


def _sliced(pages: pa.Array, one) -> pa.Array:
    """``one`` (a list of pages to an array) over slices of a batch, so that memory follows the largest page and not the batch."""
    out, held, size = [], [], 0
    for p in pages:
        page = p.as_py() or ""
        if held and size + len(page) > SLICE_CHARS:
            out.append(one(held))
            held, size = [], 0
        held.append(page)
        size += len(page)
    out.append(one(held))
    return pa.concat_arrays(out)


def _parsed(pages: pa.Array) -> pa.Array:
    return _sliced(pages, _parsed_slice)


def _parsed_slice(pages: list[str]) -> pa.Array:
    rows = [parse(p) for p in pages]
    flat = [e for r in rows for e in r[3]]
    cols = list(zip(*flat)) if flat else [()] * 9
    fields = [pa.array(c, pa.int32()) for c in cols[:6]]
    fields.append(pa.array(cols[6], pa.string()))
    offsets = list(accumulate(map(len, cols[7]), initial=0))
    fields.append(pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([x for a in cols[7] for x in a], pa.string()),
                                          pa.array([x for a in cols[7] for x in a.values()], pa.string())))
    fields.append(pa.array(cols[8], pa.string()))
    els = pa.StructArray.from_arrays(fields, [*_NUMBERS, "name", "a", "body"])
    return pa.StructArray.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()),
         _lists([len(r[2]) for r in rows], pa.array([t for r in rows for t in r[2]], pa.string())), _lists([len(r[3]) for r in rows], els)],
        ["ntok", "text", "texts", "els"])


def _tokenized(pages: pa.Array) -> pa.Array:
    return _sliced(pages, _tokenized_slice)


def _tokenized_slice(pages: list[str]) -> pa.Array:
    rows = [tokens(p) for p in pages]
    flat = [t for r in rows for t in r]
    return _lists([len(r) for r in rows], pa.StructArray.from_arrays([pa.array([t[c] for t in flat], pa.string()) for c in range(3)], ["kind", "name", "raw"]))


def parse_page(page: Column) -> Column:
    """struct<ntok, text (visible), texts (nodes), els (elements)> of a page."""
    return F.arrow_udf(_parsed, PAGE)(page)


def page_tokens(page: Column) -> Column:
    """array<struct<kind, name, raw>>: the tokens of a page in order."""
    return F.arrow_udf(_tokenized, TOKENS)(page)


def element_text(texts: Column, e: Column) -> Column:
    """Text of an element: its stripped text nodes joined with nothing between (``get_text(strip=True)``)."""
    return F.array_join(F.slice(texts, e["t0"] + 1, e["t1"] - e["t0"]), "")


def within(els: Column, e: Column) -> Column:
    """The elements inside ``e``: the ``n`` that follow it, so all containments of a page cost its nesting, not its square."""
    return F.slice(els, e["k"] + 2, e["n"])
