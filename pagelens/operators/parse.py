"""Per-page parse context: elements, text nodes and visible text, computed once per row.

Every section builder reads ``els``, ``texts`` and ``text`` (see ``functions.markup``), ``final_url``, ``html`` and
``headers``. The page goes through one Arrow function; its result is a stored column of the row, so however many
sections read it, each page is parsed once.
"""

from __future__ import annotations

import functools
import inspect

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import html as H
from pagelens.functions import markup
from pagelens.functions.urls import resolve_each

_DEFAULT_COLS = {"els": "els", "linked": "linked", "texts": "texts", "text": "text", "base": "final_url"}


def page_cols(fn):
    """Fill ``els`` / ``linked`` / ``texts`` / ``text`` / ``base`` arguments left as None with the context columns."""
    sig = inspect.signature(fn)
    names = [n for n in sig.parameters if n in _DEFAULT_COLS]

    @functools.lru_cache(maxsize=4)
    def from_page(application: str) -> Column:
        return fn(**{n: F.col(_DEFAULT_COLS[n]) for n in names})

    @functools.wraps(fn)
    def wrapper(*args, **kwargs):
        if not args and not kwargs and SparkContext._active_spark_context is not None:
            return from_page(SparkContext._active_spark_context.applicationId)  # names all its inputs: built once
        bound = sig.bind_partial(*args, **kwargs)
        for n in names:
            if bound.arguments.get(n) is None:
                bound.arguments[n] = F.col(_DEFAULT_COLS[n])
        return fn(*bound.args, **bound.kwargs)

    return wrapper


def parsed(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Add ``els``, ``texts``, ``text`` and ``ntok`` to a page table, and (where it has ``final_url``) ``linked``: the elements with
    their URL resolved (``url``) and what is wrong with it (``bad``)."""
    out = pages.withColumn("_page", markup.parse_page(F.col(html_col)))
    out = out.select("*", "_page.els", "_page.texts", "_page.text", "_page.ntok").drop("_page")
    return out.withColumn("linked", linked(F.col("els"), F.col("final_url"))) if "final_url" in out.columns else out


def reference(e: Column) -> Column:
    """The URL an element refers to, as written; null where it has none."""
    src = attr(e, "src")
    return (
        F.when(e["name"] == "a", H.strip(attr(e, "href")))
        .when(e["name"] == "link", attr(e, "href"))
        .when(e["name"] == "form", attr(e, "action"))
        .when(e["name"] == "img", F.coalesce(F.when(truthy(src), src), attr(e, "data-src"), F.lit("")))
        .when(e["name"].isin("script", "video", "audio", "source", "iframe"), src)
    )


def linked(els: Column, base: Column) -> Column:
    """Every element with ``url`` and ``bad``: each reference of a page is resolved once, for all sections."""
    keep = ["i", "end", "k", "n", "name", "a", "t0", "t1"]
    return resolve_each(base, els, reference, lambda e, url, bad: F.struct(*[e[c].alias(c) for c in keep], url.alias("url"), bad.alias("bad")))


def first_error(items: Column) -> Column:
    """The first thing wrong among items with ``bad``; null if nothing is."""
    return F.get(F.filter(F.transform(items, lambda x: x["bad"]), lambda b: b.isNotNull()), 0)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    An array expression referenced inside a higher-order function's lambda is evaluated again on
    every call; binding it first keeps per-page work linear."""
    return F.element_at(F.transform(F.array(value), body), 1)


@page_cols
def tags(names: list[str], els: Column | None = None) -> Column:
    """Elements of the given names, document order."""
    return F.filter(els, lambda x: x["name"].isin(*names) if len(names) > 1 else x["name"] == names[0])


def exploded(df: DataFrame, keys: list, array: Column, *names: str) -> DataFrame:
    """The keys with the fields of every member of an array of structs, and its place first where a name is given for it.

    The outer form and the test on the place stand for an inner explode: from that one the optimizer infers a filter on the
    array, which it pushes below the projections and so computes the array a second time."""
    rows = df.select(*keys, F.posexplode_outer(array).alias(names[0], names[1]))
    return rows.filter(F.col(names[0]).isNotNull())


def members(df: DataFrame, keys: list, array: Column, name: str) -> DataFrame:
    """The keys with every member of an array (see ``exploded``)."""
    return exploded(df, keys, array, "_at", name).drop("_at")


def attr(s: Column, key: str) -> Column:
    return F.element_at(s["a"], F.lit(key))


def truthy(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def rel_tokens(s: Column) -> Column:
    r = H.strip(F.coalesce(attr(s, "rel"), F.lit("")))
    return F.filter(F.split(r, f"{H.WS_CLASS}+", -1), lambda x: x != "")
