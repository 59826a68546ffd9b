"""Operator 8, licence scans: Dice coefficient over word bigrams, with size bounds. DataFrame functions only.

Units are every line of a text, the whole text, and the word windows of the whole text that name a
licence best, across line breaks. A unit is normalised (A-Z lowered, every run of other characters than
a-z and 0-9 one space) and compared with licence templates by 2 |A and B| / (|A| + |B|), where A and B
are the sets of word bigrams. A coefficient of t or more needs |B| between t/(2-t) |A| and (2-t)/t |A|, so
a unit joins only templates of such a size: the templates are listed under each size they can match, and
units look up their own. That list is small, its size depending on the templates alone.

A match also shares t/(2-t) |B| bigrams with the template, so it holds one of any |B| - t/(2-t) |B| + 1 of
them: the longest, which are seldom found elsewhere, are its anchors, and a text without an anchor is
passed over. In the others every window of at most (2-t)/t |B| bigrams near an anchor is compared. Only
windows that start and end with a new bigram of the template are looked at, as others have a shorter one
that is as good. Of windows that overlap the best stays (the longest, then the first). Units are counted
by their different normalised texts, so a line that matches and a better window in it are two.

Defined cases: a null text has no units; units of fewer than two words have no bigrams and match
nothing; a line that is the whole text is one unit; every row is returned with its own matches, whatever
its id (null and repeated ids are told apart by a row number); an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.common import lower_ascii, prepare, written

THRESHOLD = (80, 100)

#: Short notices by which texts name their licence.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
            "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("proprietary", "All rights reserved."),
)

#: Paragraphs of licence files and source headers.
TEXTS = (
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "This file is licensed under the MIT License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
            "in the documentation and/or other materials provided with the distribution."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
                 "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
                 "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl-2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(lower_ascii(text), "[^a-z0-9]+", " "))


def bigrams(norm: Column) -> Column:
    """The set of word bigrams of a normalised text."""
    words = F.split(norm, " ")
    pairs = F.transform(F.array(words), lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat_ws(" ", a, b)))[0]
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def by_size(spark, templates, threshold: tuple[int, int]) -> DataFrame:
    """The templates under each size of a unit that they can match: size, license, grams."""
    num, den = threshold
    t = spark.createDataFrame([(a, b) for a, b in templates], "license string, body string")
    t = t.select("license", bigrams(normalised(F.col("body"))).alias("grams")).filter("size(grams) > 0")
    low = F.ceil(F.size("grams") * num / (2 * den - num)).cast("int")
    return t.select("license", "grams", F.explode(F.sequence(low, F.floor(F.size("grams") * (2 * den - num) / num).cast("int"))).alias("size"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def anchored(templates, threshold: tuple[int, int]) -> list[tuple[list[str], list[str], int]]:
    """The bigrams of each template, its anchors, and the most bigrams of a window that can match it."""
    num, den = threshold
    out = []
    for _, body in templates:
        w = re.sub("[^a-z0-9]+", " ", body.translate({c: c + 32 for c in range(65, 91)})).split()
        grams = sorted({f"{a} {b}" for a, b in zip(w, w[1:])}, key=lambda g: (-len(g), g))
        if grams:
            shared = -(-len(grams) * num // (2 * den - num))
            out.append((grams, grams[: len(grams) - shared + 1], len(grams) * (2 * den - num) // num))
    return out


def _pattern(anchors: set[str]) -> str:
    """Matches the blank before an anchor, which is group 1 (anchors may overlap); texts have a blank at both ends."""
    return " (?=(" + "|".join(f"{c}(?:" + "|".join(sorted(a[1:] for a in anchors if a[0] == c)) + ")" for c in sorted({a[0] for a in anchors})) + ") )"


def _windows(words: Column, hits: Column, templates: Column, threshold: tuple[int, int]) -> Column:
    """The windows of an array of words that match a template best, none overlapping another: array of normalised texts.

    ``templates`` is an array of (grams, anchors, most), ``hits`` the anchors the text has.
    """
    num, den = threshold

    def best_from(grams: Column, start: Column, t: Column) -> Column:
        """dice (negative), length (negative) and start of the best window that starts here; dice 0 if none matches."""
        size = F.size(t["grams"])

        def step(acc: Column, x: Column) -> Column:
            a, c = acc["a"] + x["new"], acc["c"] + x["both"]
            dice = 2.0 * c / (a + size)
            better = (x["both"] == 1) & (2 * c * den >= (a + size) * num) & (dice > acc["dice"])
            return F.struct((acc["n"] + 1).alias("n"), a.alias("a"), c.alias("c"), F.when(better, dice).otherwise(acc["dice"]).alias("dice"), F.when(better, acc["n"] + 1).otherwise(acc["length"]).alias("length"))

        def seen(s: Column) -> Column:
            new = lambda g, k: (F.array_position(s, g) == k + 1).cast("int")
            return F.transform(s, lambda g, k: F.struct(new(g, k).alias("new"), F.when(F.array_contains(t["grams"], g), new(g, k)).otherwise(0).alias("both")))

        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("a"), F.lit(0).alias("c"), F.lit(0.0).alias("dice"), F.lit(0).alias("length"))
        return F.aggregate(_let(F.slice(grams, start + 1, t["most"]), seen), zero, step, lambda acc: F.struct((-acc["dice"]).alias("dice"), (-acc["length"]).alias("length"), start.alias("start")))

    def of_template(grams: Column, t: Column) -> Column:
        where = lambda among: F.filter(F.transform(grams, lambda g, k: F.when(F.array_contains(among, g), k)), lambda k: k.isNotNull())
        starts = _let(where(t["anchors"]), lambda pins: F.filter(where(t["grams"]), lambda k: F.exists(pins, lambda p: (p >= k) & (p < k + t["most"]))))
        return F.filter(F.transform(starts, lambda k: best_from(grams, k, t)), lambda x: x["dice"] < 0)

    def chosen(acc: Column, x: Column) -> Column:
        # a window of n bigrams has n + 1 words
        overlaps = F.exists(acc, lambda y: (y["start"] <= x["start"] - x["length"]) & (x["start"] <= y["start"] - y["length"]))
        return F.when(overlaps, acc).otherwise(F.concat(acc, F.array(x)))

    every = _let(F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b)),
                 lambda grams: F.flatten(F.transform(F.filter(templates, lambda t: F.arrays_overlap(t["anchors"], hits)), lambda t: of_template(grams, t))))
    best = F.aggregate(F.array_sort(every), F.array().cast("array<struct<dice:double,length:int,start:int>>"), chosen)
    return F.array_distinct(F.transform(best, lambda x: F.array_join(F.slice(words, x["start"] + 1, 1 - x["length"]), " ")))


def license_scan(docs: DataFrame, templates=TEMPLATES + TEXTS, threshold: tuple[int, int] = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_matches (units with a licence), license and dice (of the best match, null if none), licenses (all that
    reach the threshold in a unit, sorted), best (the best licence of each unit, sorted)."""
    spark = prepare(docs.sparkSession)
    num, den = threshold
    sizes = by_size(spark, templates, threshold)
    known = anchored(templates, threshold)
    pattern = _pattern({a for _, anchors, _ in known for a in anchors})
    known = spark.createDataFrame([(known,)], "templates array<struct<grams:array<string>,anchors:array<string>,most:int>>")
    rows = docs.select(F.monotonically_increasing_id().alias("id"), F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    # one pass over the text: lines normalised, and the whole text, which is its lines with words joined by spaces
    lines = F.transform(F.split(F.regexp_replace(lower_ascii(F.col("text")), "[^a-z0-9\n]+", " "), "\n"), lambda x: F.trim(x))
    parts = _let(lines, lambda x: F.filter(x, lambda y: y != ""))
    rows = rows.select("id", "doc", _let(parts, lambda x: F.struct(x.alias("lines"), F.array_join(x, " ").alias("whole"))).alias("x"))
    found = lambda x: F.array_distinct(F.regexp_extract_all(F.concat(F.lit(" "), x["whole"], F.lit(" ")), F.lit(pattern), F.lit(1)))
    rows = rows.select("id", "doc", _let(F.col("x"), lambda x: F.struct(x["lines"].alias("lines"), x["whole"].alias("whole"), found(x).alias("hits"))).alias("x"))
    rows = rows.crossJoin(F.broadcast(known))

    def units_of(x: Column) -> Column:
        windows = _let(F.split(x["whole"], " "), lambda w: _windows(w, x["hits"], F.col("templates"), threshold))
        return F.array_distinct(F.concat(F.array(x["whole"]), x["lines"], windows))

    none = F.array().cast("array<string>")
    # stored with a row number, which is the key from here on: null and repeated ids are rows of their own
    rows = written(rows.select("id", "doc", _let(F.col("x"), lambda x: F.when(F.size(x["hits"]) > 0, units_of(x)).otherwise(none)).alias("units")), "license-units")
    units = rows.filter(F.size("units") > 0).select("id", F.explode("units").alias("norm"))
    # a size bound that needs no bigrams: distinct bigrams are fewer than words
    # and, as a chain of n distinct words has n - 1 distinct bigrams at least, not fewer than distinct words less one
    smallest, largest = sizes.agg(F.min("size"), F.max("size")).first()
    units = units.filter(F.regexp_count("norm", F.lit(" ")) >= smallest).filter(F.size(F.array_distinct(F.split("norm", " "))) - 1 <= largest).withColumn("grams", bigrams(F.col("norm")))
    pairs = units.withColumn("size", F.size("grams")).join(F.broadcast(sizes.withColumnRenamed("grams", "template")), "size")
    both = F.size(F.array_intersect("grams", "template"))
    total = F.col("size") + F.size("template")
    found = pairs.withColumn("both", both).filter(2 * F.col("both") * den >= total * num).select("id", "norm", "license", (2.0 * F.col("both") / total).alias("dice"))
    found = found.groupBy("id", "norm").agg(F.max(F.struct("dice", "license")).alias("top"), F.collect_set("license").alias("all"))
    found = found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("top").alias("top"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("all")))), ",").alias("licenses"),
                                    F.array_join(F.sort_array(F.collect_set("top.license")), ",").alias("best"))
    out = rows.select("id", "doc").join(found, "id", "left")
    return out.select(F.col("doc").alias(id_col), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_matches"), F.col("top.license").alias("license"), F.col("top.dice").alias("dice"),
                      F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("best", F.lit("")).alias("best"))
