"""Operator 2, personal data: candidate gradient boosting. DataFrame functions only.

Base rules find e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers; their spans
always stay. Beside them, high-recall generators propose overlapping spans: any run of digits and
separators, national phone numbers, dotted quads with blanks, and addresses with a written-out "at" and
"dot". Boosted trees (Spark ML) score each candidate from its format (digits, groups, signs, check sum,
range) and its context (the characters before and after, words that announce such data). They are
trained on candidates labelled by whether they overlap a valid base span of their kind or, with blanks
and a written-out "at" and "dot" undone, are one by the base rules. Per kind the
lowest threshold with the asked precision is calibrated on candidates not used in training;
candidates above it are selected, the best of those that overlap, where no base span lies.

Every text is searched, and every candidate trains (two thirds, by digests of text and place) or calibrates (the
rest), and is scored. Texts without digits or at-signs are
passed over by one cheap test. Nothing is grouped but the candidates of one document.

Defined cases: a null or empty text has no spans; ids may be null or repeated, rows are kept apart by
a row number stored with them; if the candidates have labels of one kind only there is nothing to
learn, and the base spans stand alone; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelens.llm.common import before_each, cut, let, pieces, prepare, sums_before, text_of, written

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive repeats and the tests of what stands before make them linear; they match the same.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators: name -> kinds proposed, pattern.
GENERATORS = {
    "run": (("card", "phone"), r"(?<![0-9])\+?\(?[0-9](?:[\x20().-]{0,3}[0-9]){6,20}"),
    "national": (("phone",), r"(?<![0-9])(?:\(?[0-9]{3}\)?[\x20.-]?)?[0-9]{3}[.-][0-9]{4}(?![0-9])"),
    "dotted": (("ip",), r"(?<![0-9.])[0-9]{1,3}(?:\x20?\.\x20?[0-9]{1,3}){3}(?![0-9])"),
    "written": (("email",), r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|[(\[]at[)\]]|\x20at\x20)\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]]|\x20dot\x20)\x20?[A-Za-z0-9-]++)++"),
}
ANNOUNCES = r"(?i)(phone|call|tel|fax|mobile|mail|contact|card|credit|account|address|server|host|ip)\W*$"
PRECISION = 0.97
CONTEXT = 24
FEATURES = ("kind_no", "generator_no", "digits", "length", "groups", "plus", "paren", "dot", "dash", "blank", "at", "luhn", "in_range",
            "before_letter", "before_sign", "after_letter", "after_sign", "announced", "repeated", "written_at", "written_dot", "dot_blank", "word_end")


def matches(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap: array of (start, end, value, before, after), in code points."""
    both = F.transform(F.array(F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("v"))), lambda s: F.arrays_zip(
        F.slice(s["p"], 1, F.size(s["v"])).alias("p"), s["v"].alias("v"), F.slice(s["p"], 2, F.size(s["v"])).alias("q")))[0]
    def placed(found: Column) -> Column:
        # a match starts where all pieces and matches before it and its own piece end
        return let(sums_before(F.transform(found, lambda x: F.char_length(x["p"]) + F.char_length(x["v"]))), lambda at: F.transform(found, one(at)))

    def one(at: Column):
        def build(x: Column, i: Column) -> Column:
            start = at[i] + F.char_length(x["p"])
            return F.struct(start.alias("start"), (start + F.char_length(x["v"])).alias("end"), x["v"].alias("value"),
                            F.right(x["p"], F.lit(CONTEXT)).alias("before"), F.left(x["q"], F.lit(CONTEXT)).alias("after"))

        return build

    return let(both, placed)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 40 digits passes the check; false for longer ones."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.when(F.char_length(digits).between(1, 40), F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0).otherwise(F.lit(False))


def small_parts(value: Column) -> Column:
    """Whether every dotted part is at most 255."""
    parts = F.transform(F.split(F.regexp_replace(value, " ", ""), r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.char_length(p) <= 3) & (F.coalesce(F.try_to_number(p, F.lit("999")).cast("int"), F.lit(0)) <= 255))


def valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return small_parts(value)
    n = F.char_length(digits_of(value))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits_of(value))).otherwise(F.lit(False))
    return n.between(9, 15)


WRITTEN_AT, WRITTEN_DOT = r"\x20?[(\[]at[)\]]\x20?|\x20at\x20", r"\x20?[(\[]dot[)\]]\x20?|\x20dot\x20"
#: A written-out address ends in a word, unlike "at 5.30".
WORD_END = r"\.[A-Za-z]{2,}$"


def plain_address(value: Column) -> Column:
    """An address with its written-out at and dot as signs. Blanks beside a sign stay: they are ends of sentences."""
    return F.regexp_replace(F.regexp_replace(value, WRITTEN_AT, "@"), WRITTEN_DOT, ".")


def normal_valid(kind_no: Column, value: Column) -> Column:
    """Whether the normalised value is a valid base span; for addresses and dotted quads, whose forms differ from the base ones."""
    mail = plain_address(value)
    quad = F.regexp_replace(value, " ", "")
    whole = lambda kind: "^(?:" + BASE[kind] + ")$"
    return (F.when(kind_no == KINDS.index("email"), mail.rlike(whole("email")) & mail.rlike(WORD_END))
            .when(kind_no == KINDS.index("ip"), quad.rlike(whole("ip")) & small_parts(value)).otherwise(F.lit(False)))


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("kind_no"), x["start"].alias("start"), x["end"].alias("end")))


def _base(text: Column, kind: str) -> Column:
    return _spans(F.filter(matches(text, BASE[kind]), lambda x: valid(kind, x["value"])), kind)


def _candidates(text: Column) -> Column:
    out = []
    for no, (kinds, pattern) in enumerate(GENERATORS.values()):
        for kind in kinds:
            out.append(_proposed(text, pattern, KINDS.index(kind), no))
    return F.concat(*out)


def _proposed(text: Column, pattern: str, kind_no: int, generator_no: int) -> Column:
    return F.transform(matches(text, pattern), lambda x: F.struct(
        F.lit(kind_no).alias("kind_no"), F.lit(generator_no).alias("generator_no"), *[x[c].alias(c) for c in ("start", "end", "value", "before", "after")]))


def _features(c: DataFrame) -> DataFrame:
    """Adds the columns FEATURES (kind_no and generator_no are there) as doubles."""
    v, before, after = F.col("value"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    d = digits_of(v)
    has = lambda s: v.contains(s).cast("double")
    number = {
        "digits": F.char_length(d), "length": F.char_length(v), "groups": F.size(F.split(v, "[^0-9A-Za-z]+")), "plus": has("+"), "paren": has("("), "dot": has("."), "dash": has("-"),
        "blank": has(" "), "at": has("@"), "luhn": luhn(d), "in_range": F.when(F.col("kind_no") == 1, small_parts(v)).otherwise(F.lit(False)),
        "before_letter": before.rlike("[A-Za-z0-9_]$"), "before_sign": before.rlike(r"[^A-Za-z0-9_\s]$"), "after_letter": after.rlike("^[A-Za-z0-9_]"), "after_sign": after.rlike(r"^[^A-Za-z0-9_\s.,;]"),
        "announced": before.rlike(ANNOUNCES), "repeated": F.when(F.char_length(d) > 0, F.size(F.array_distinct(F.split(d, ""))) / F.char_length(d)).otherwise(0),
        "written_at": v.rlike(WRITTEN_AT), "written_dot": v.rlike(WRITTEN_DOT), "dot_blank": v.rlike(r"\x20\.|\.\x20"), "word_end": plain_address(v).rlike(WORD_END),
    }
    return c.withColumns({k: e.cast("double") for k, e in number.items()})


def _model(train: DataFrame):
    from pyspark.ml.classification import GBTClassifier

    return GBTClassifier(featuresCol="vector", labelCol="label", maxIter=12, maxDepth=4, stepSize=0.3, maxBins=64, seed=3, minInstancesPerNode=3).fit(train)


def _thresholds(scored: DataFrame, precision: float) -> DataFrame:
    """kind_no, threshold: the lowest score (in hundredths) from which on the precision is reached."""
    bins = scored.groupBy("kind_no", F.floor(F.col("score") * 100).alias("bin")).agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n"))
    above = W.partitionBy("kind_no").orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, 0)  # at most 101 rows a kind
    bins = bins.withColumn("share", F.sum("good").over(above) / F.sum("n").over(above))
    # every bin from the threshold up has to reach it
    worst = bins.withColumn("worst", F.min("share").over(above)).filter(F.col("worst") >= precision)
    return worst.groupBy("kind_no").agg((F.min("bin") / 100).alias("threshold"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """One row per document: id, base (array of spans: kind_no, start, end) and added (the same, selected by the trees)."""
    spark = prepare(docs.sparkSession)
    text = F.col("text")
    # a text without any of these cannot hold a match of any pattern
    may = text.rlike(r"[0-9@]|[(\[](?:at|dot)[)\]]|\x20(?:at|dot)\x20")
    none = F.array().cast("array<struct<kind_no:int,start:int,end:int>>")
    base = F.concat(*[_base(text, k) for k in KINDS])
    rows = docs.select(F.col(id_col).alias("id"), text_of(F.col(text_col)).alias("text")).select(
        "id", F.monotonically_increasing_id().alias("row"), F.xxhash64("text").alias("h"), F.when(may, base).otherwise(none).alias("base"), F.when(may, _candidates(text)).alias("candidates"))
    rows = written(rows, "pii-rows")
    c = rows.filter("size(candidates) > 0").select("row", "h", "base", F.explode("candidates").alias("c")).select("row", "h", "base", "c.*").distinct()
    overlaps = lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start"))
    known = F.exists("base", lambda b: overlaps(b) & (b["kind_no"] == F.col("kind_no"))) | normal_valid(F.col("kind_no"), F.col("value"))
    c = c.withColumn("label", known.cast("double")).withColumn("on_base", F.exists("base", overlaps)).drop("base")
    c = _features(c).withColumn("draw", F.xxhash64("h", "kind_no", "start", "end", "generator_no"))
    c = written(c.select("row", "start", "end", "label", "on_base", "draw", *FEATURES), "pii-candidates")
    train, held = c.filter("draw % 3 <> 0"), c.filter("draw % 3 = 0")
    empty = rows.select("id", "base", none.alias("added"))
    labels = train.agg(F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    if labels["lo"] is None or labels["lo"] == labels["hi"]:
        return empty.withColumnRenamed("id", id_col)
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform
    model = _model(assembled(train).select("vector", "label"))
    score = lambda df: model.transform(assembled(df)).withColumn("score", vector_to_array("probability")[1]).drop("vector", "rawPrediction", "probability", "prediction")
    limits = F.broadcast(written(_thresholds(score(held), precision), "pii-thresholds"))  # a row for each kind
    chosen = score(c.filter("NOT on_base")).join(limits, "kind_no").filter(F.col("score") >= F.col("threshold"))
    chosen = chosen.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", F.col("kind_no").cast("int").alias("kind_no"), F.round("score", 6).alias("score")))).alias("l"))
    better = lambda y, x: (y["start"] < x["end"]) & (y["end"] > x["start"]) & (F.struct(y["score"], y["end"] - y["start"], -y["kind_no"], -y["start"]) > F.struct(x["score"], x["end"] - x["start"], -x["kind_no"], -x["start"]))
    alone = F.flatten(F.transform(islands(F.col("l")), lambda l: F.filter(l, lambda x: ~F.exists(l, lambda y: better(y, x)))))
    best = F.transform(alone, lambda x: F.struct(x["kind_no"].alias("kind_no"), x["start"].alias("start"), x["end"].alias("end")))
    chosen = chosen.select("row", F.array_distinct(best).alias("added"))
    return rows.join(chosen, "row", "left").select(F.col("id").alias(id_col), "base", F.coalesce("added", none).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:end by kind, then start, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(name, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def ends_before(spans: Column) -> Column:
    """For each of the spans, sorted by start, the largest end of those before it (0 for the first)."""
    return before_each(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0))


def islands(spans: Column) -> Column:
    """Spans sorted by start, cut into arrays such that only spans of one array overlap."""
    firsts = let(ends_before(spans), lambda ends: F.filter(F.transform(spans, lambda s, i: F.when(s["start"] >= ends[i], i)), lambda i: i.isNotNull()))
    return let(firsts, lambda fs: F.transform(fs, lambda f, k: F.slice(spans, f + 1, F.coalesce(F.get(fs, k + 1), F.size(spans)) - f)))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets (overlapping spans: the first one's kind)."""
    name = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind_no"].alias("kind_no"))))

    def replaced(parts: Column, order: Column, ends: Column) -> Column:
        fresh = F.transform(order, lambda s, i: F.when(s["start"] >= ends[i], F.concat(cut(parts, ends[i], s["start"]), F.element_at(name, s["kind_no"] + 1))))
        last = F.coalesce(F.array_max(F.transform(order, lambda s: s["end"])), F.lit(0))
        return F.concat(F.array_join(fresh, ""), cut(parts, last, F.char_length(text)))

    return let(pieces(text), lambda parts: let(order, lambda order: let(ends_before(order), lambda ends: replaced(parts, order, ends))))
