"""Forms, tables and structured data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.functions.markup import within
from pagelens.operators.parse import attr, let, page_cols, tags, truthy


@page_cols
def forms(linked: Column | None = None, base: Column | None = None) -> Column:
    """Per <form>: action (resolved, else the page URL), method (upper, default GET), the
    input/textarea/select fields inside it in order, and whether one is a password field."""
    def one(f):
        ins = F.filter(within(linked, f), lambda x: x["name"].isin("input", "textarea", "select"))
        typed = F.transform(
            ins,
            lambda x: F.struct(
                attr(x, "name").alias("name"),
                F.when(x["name"] == "input", F.coalesce(attr(x, "type"), F.lit("text"))).otherwise(x["name"]).alias("type"),
            ),
        )
        action = attr(f, "action")
        method = attr(f, "method")
        return F.struct(
            F.when(truthy(action), f["url"]).otherwise(base).alias("action"),
            F.upper(F.when(truthy(method), method).otherwise(F.lit("GET"))).alias("method"),
            F.size(typed).cast("bigint").alias("input_count"),
            typed.alias("inputs"),
            F.exists(typed, lambda x: x["type"] == "password").alias("has_password_field"),
        )

    return F.transform(tags(["form"], linked), one)


@page_cols
def tables(els: Column | None = None) -> Column:
    """Per <table>: number of <tr> inside (nested tables included) and the number of <td>/<th>
    inside its first row."""
    def one(t):
        rows = F.filter(within(els, t), lambda x: x["name"] == "tr")

        def of(r):
            cells = F.size(F.filter(within(els, F.get(r, 0)), lambda c: c["name"].isin("td", "th")))
            return F.struct(F.size(r).cast("bigint").alias("rows"), F.when(F.size(r) == 0, F.lit(0)).otherwise(cells).cast("bigint").alias("columns_approx"))

        return let(rows, of)

    return F.transform(tags(["table"], els), one)


@page_cols
def jsonld_blocks(els: Column | None = None) -> Column:
    """Parsed JSON-LD blocks (bad JSON dropped): array<variant>."""
    scr = F.filter(tags(["script"], els), lambda s: attr(s, "type") == "application/ld+json")
    parsed = F.transform(scr, lambda s: F.try_parse_json(s["body"]))
    return F.filter(parsed, lambda v: v.isNotNull())


def _types_of(item: Column) -> Column:
    as_list = F.try_variant_get(item, '$["@type"]', "array<string>")
    as_one = F.try_variant_get(item, '$["@type"]', "string")
    return F.coalesce(as_list, F.when(as_one.isNotNull(), F.array(as_one)), F.array().cast("array<string>"))


def jsonld_types(blocks: Column) -> Column:
    """@type of each top-level object, or of each member of a top-level array; sorted distinct."""
    items = F.transform(
        blocks, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    )
    flat = F.flatten(F.transform(items, lambda arr: F.flatten(F.transform(arr, _types_of))))
    return F.array_sort(F.array_distinct(flat))


@page_cols
def microdata_types(els: Column | None = None) -> Column:
    vals = F.transform(F.filter(els, lambda x: F.map_contains_key(x["a"], "itemtype")), lambda x: attr(x, "itemtype"))
    return F.array_sort(F.array_distinct(vals))


@page_cols
def structured_data(els: Column | None = None) -> Column:
    return let(jsonld_blocks(els), lambda blocks: let(microdata_types(els), lambda micro: F.struct(
        F.size(blocks).cast("bigint").alias("json_ld_count"),
        jsonld_types(blocks).alias("json_ld_types"),
        micro.alias("microdata_types"),
        ((F.size(blocks) > 0) | (F.size(micro) > 0)).alias("has_structured_data"),
    )))
