"""URLs as column expressions: seed normalisation, parts, and reference resolution.

Resolution follows Python's ``urllib.parse.urljoin`` (RFC 3986 merge with its particular
handling of empty segments and empty query/fragment), written with ``regexp_extract``,
``CASE`` and an ``aggregate`` stack over path segments, so it runs inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.dims import USES_NETLOC, USES_RELATIVE

# scheme ":" ; "//" netloc ; path ; "?" query ; "#" fragment
URL_RX = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
SCHEME_PREFIX_RX = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"


def normalize_url(c: Column) -> Column:
    """Seed normalisation: strip, then prefix ``https://`` unless a ``scheme://`` is present."""
    from pagelens.functions.html import strip

    s = strip(c)
    return F.when(s.rlike(SCHEME_PREFIX_RX), s).otherwise(F.concat(F.lit("https://"), s))


#: The start of ``URL_RX``, which matches every text: scheme and netloc without a look at the rest.
AUTHORITY_RX = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?"
#: References whose resolution is known as they stand: absolute ones with a host of the web, whose scheme and parts are not
#: rewritten, and paths from the root (those with "/." go the long way). No tabs or line ends (they are cut out), no empty query or fragment.
_AS_IS_RX = r"^https?://[^/?#\t\r\n\[\]]+(?:/[^?#\t\r\n]*)?(?:\?[^#\t\r\n]+)?(?:#[^\t\r\n]+)?\z"
_FROM_ROOT_RX = r"^/(?!/)[^?#\t\r\n]*(?:\?[^#\t\r\n]+)?(?:#[^\t\r\n]+)?\z"


def _part(c: Column, g: int) -> Column:
    return F.regexp_extract(c, AUTHORITY_RX if g <= 2 else URL_RX, g)


def scheme(c: Column) -> Column:
    return F.lower(_part(c, 1))


def netloc(c: Column) -> Column:
    """Network location as written (port and user info kept, case kept); '' when absent."""
    return _part(c, 2)


def hostname(c: Column) -> Column:
    """Lower-cased host without user info and port; null when empty."""
    n = F.regexp_replace(netloc(c), r"^.*@", "")
    h = F.when(n.startswith("["), F.regexp_extract(n, r"^\[([^\]]*)\]", 1)).otherwise(
        F.regexp_replace(n, r":[^:]*$", "")
    )
    h = F.lower(h)
    return F.when(h == "", F.lit(None).cast("string")).otherwise(h)


def cut_fragment(c: Column) -> Column:
    return F.substring_index(c, "#", 1)


def _let(value: Column, body) -> Column:
    # evaluate once, use many times (see operators.parse.let)
    return F.element_at(F.transform(F.array(value), body), 1)


def _split(c: Column) -> Column:
    """struct<s (lower-cased), raw_s, n, p, q, f> of a URL; each part '' when absent. The input is
    evaluated once however complex it is."""
    return _let(c, lambda x: F.struct(
        F.lower(_part(x, 1)).alias("s"), _part(x, 1).alias("raw_s"), _part(x, 2).alias("n"),
        _part(x, 3).alias("p"), _part(x, 4).alias("q"), _part(x, 5).alias("f"),
    ))


def _unsplit(sch: Column, net: Column, path: Column, query: Column, frag: Column) -> Column:
    def build(p):
        fixed = F.when((net != "") & (p != "") & ~p.startswith("/"), F.concat(F.lit("/"), p)).otherwise(p)
        body = (
            F.when(net != "", F.concat(F.lit("//"), net, fixed))
            .when(p.startswith("//"), F.concat(F.lit("//"), p))
            .when((sch != "") & sch.isin(*USES_NETLOC) & ((p == "") | p.startswith("/")), F.concat(F.lit("//"), p))
            .otherwise(p)
        )
        u = F.concat(F.when(sch != "", F.concat(sch, F.lit(":"))).otherwise(F.lit("")), body,
                     F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
                     F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise(F.lit("")))
        return u

    return _let(path, build)


def _remove_dots(segments: Column) -> Column:
    empty = F.array().cast("array<string>")

    def step(acc, s):
        popped = F.when(F.size(acc) == 0, acc).otherwise(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        return F.when(s == "..", popped).when(s == ".", acc).otherwise(F.concat(acc, F.array(s)))

    def build(segs):
        resolved = F.aggregate(segs, empty, step)
        last = F.element_at(segs, -1)
        resolved = F.when(last.isin(".", ".."), F.concat(resolved, F.array(F.lit("")))).otherwise(resolved)
        return _let(F.array_join(resolved, "/"), lambda j: F.when(j == "", F.lit("/")).otherwise(j))

    return _let(segments, build)


def _merge_segments(base_path: Column, ref_path: Column) -> Column:
    """Segments of a relative path merged onto the base directory (empty inner segments dropped)."""
    base_parts = F.split(base_path, "/", -1)
    base_dir = _let(base_parts, lambda bp: F.when(F.element_at(bp, -1) != "", F.slice(bp, 1, F.greatest(F.size(bp) - 1, F.lit(0)))).otherwise(bp))

    def tidy(rel):
        n = F.size(rel)
        return F.when(
            n > 2,
            F.concat(F.slice(rel, 1, 1), F.filter(F.slice(rel, 2, F.greatest(n - 2, F.lit(0))), lambda s: s != ""), F.slice(rel, -1, 1)),
        ).otherwise(rel)

    return _let(F.concat(base_dir, F.split(ref_path, "/", -1)), tidy)


def _joined(base: Column, b: Column, ref: Column) -> Column:
    """``urljoin`` with the base also given in parts (``_split``)."""

    def with_parts(r, ref_raw):
        r_s = F.when(r["raw_s"] == "", b["s"]).otherwise(r["s"])
        segments = F.when(r["p"].startswith("/"), F.split(r["p"], "/", -1)).otherwise(_merge_segments(b["p"], r["p"]))
        merged = _unsplit(r_s, b["n"], _remove_dots(segments), r["q"], r["f"])
        keep_base_path = _unsplit(r_s, b["n"], b["p"], F.when(r["q"] != "", r["q"]).otherwise(b["q"]), r["f"])
        return (
            F.when((r_s != b["s"]) | ~r_s.isin(*USES_RELATIVE), ref_raw)
            .when(r["n"] != "", _unsplit(r_s, r["n"], r["p"], r["q"], r["f"]))
            .when(r["p"] == "", keep_base_path)
            .otherwise(merged)
        )

    joined = _let(F.regexp_replace(ref, r"[\t\r\n]", ""), lambda rr: _let(_split(rr), lambda r: with_parts(r, ref)))
    return (
        F.when(F.coalesce(base, F.lit("")) == "", ref)
        .when(F.coalesce(ref, F.lit("")) == "", base)
        .otherwise(joined)
    )


def resolve(base: Column, ref: Column) -> Column:
    """``urljoin(base, ref)``."""
    return _let(_split(base), lambda b: _joined(base, b, ref))


def url_error(c: Column) -> Column:
    """What ``urlsplit`` says of a URL that it cannot read (brackets of an IPv6 host); null for every other URL."""

    def of(n):
        opened, closed = n.contains("["), n.contains("]")
        host = F.regexp_extract(n, r"\[([^\]]*)\]", 1)
        return F.when(opened != closed, F.lit("Invalid IPv6 URL")).when(
            opened & ~host.rlike(r"^[0-9A-Fa-f.]*:[0-9A-Fa-f:.]*(%.+)?$") & ~host.startswith("v"),
            F.concat(F.lit("'"), host, F.lit("' does not appear to be an IPv4 or IPv6 address")))

    return F.when(c.contains("[") | c.contains("]"), _let(netloc(c), of))


def resolve_each(base: Column, items: Column, ref, into) -> Column:
    """``into(item, url, error)`` for every item of an array: its reference ``ref(item)`` resolved against ``base``, and why it could
    not be. The resolution stands once in the plan and the base is split once a row, however many items there are."""

    def joined(s, root, r):
        # the first two are what ``_joined`` gives for such references, read off them
        known = F.when(root.isNotNull() & r.rlike(_FROM_ROOT_RX) & ~r.contains("/."), F.concat(root, r)).when(root.isNotNull() & r.rlike(_AS_IS_RX), r)
        return F.coalesce(known, _joined(base, s, r))

    def each(b, root, bad):
        def one(x):
            return _let(F.struct(ref(x).alias("r")), lambda s: into(
                x, F.when(s["r"].isNotNull(), joined(b, root, s["r"])), F.when(s["r"] != "", F.coalesce(bad, url_error(s["r"])))))

        return F.transform(items, one)

    def with_root(b, bad):
        # the base up to its path, for bases of the web with a host
        root = F.when(b["s"].isin("http", "https") & (b["n"] != ""), F.concat(b["s"], F.lit("://"), b["n"]))
        return _let(F.struct(root.alias("root")), lambda x: each(b, x["root"], bad))

    return _let(F.struct(_split(base).alias("b"), url_error(base).alias("bad")), lambda x: with_root(x["b"], x["bad"]))


def resolve_link(base: Column, ref: Column) -> Column:
    """Resolved reference without its fragment (what link extraction stores)."""
    return cut_fragment(resolve(base, ref))
