"""Personal data and the terms that give it away; DataFrame operations only.

Patterns find personal values. Corpus statistics then say how much a term that stands near a value tells about the entity
that the value names: the pointwise mutual information of term and entity, as a share of the entity's own information. Both are
counted over different texts, and a lower confidence bound stands for the conditional probability, so that what occurs
together once or twice tells nothing. Terms above a threshold are spans too, to be generalised or removed with the values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.components import drop_rows, join_groups
from loam.session import materialise, texts

#: Kinds in the order of the results. The patterns are those of the contract with a start condition, which saves
#: attempts inside a run but loses no match, and possessive repeats, which never need to give back.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Words of the statistics: runs of letters and digits with a letter.
WORD = r"(?<![\p{L}\p{N}])\p{N}*+\p{L}[\p{L}\p{N}]*+"
#: Words on each side of a value, on its line, that count as standing near it; matches that are summed at a time;
#: code points of a place where spans of terms and values meet.
NEAR, STEP, CELL = 8, 64, 32
SPAN = "struct<o:int,kind:string,s:int,e:int,value:string>"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda x: (F.length(part(x)) < 3) | ((F.length(part(x)) == 3) & (part(x) <= "255")))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _bind(x: Column, f) -> Column:
    """``f(x)`` with ``x`` evaluated once, however often ``f`` and the lambdas in it use it."""
    return F.transform(F.array(x), f)[0]


def located(text: Column, pattern: str) -> Column:
    """``s, e, value`` of every match of a pattern, in code points: matches and the pieces between them alternate.

    Positions are summed in blocks of ``STEP`` matches and then over the blocks, so that no long array is copied once a
    match."""
    raw = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    none = F.from_json(F.lit("[]"), "array<struct<s:int,e:int,value:string>>")
    nones = F.from_json(F.lit("[]"), "array<array<struct<s:int,e:int,value:string>>>")

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + F.char_length(x["piece"])
        e = s + F.coalesce(F.char_length(x["value"]), F.lit(0))
        more = F.concat(a["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["value"].alias("value"))))
        return F.struct(e.alias("at"), F.when(x["value"].isNotNull(), more).otherwise(a["out"]).alias("out"))

    def block(r: Column, i: Column) -> Column:
        return F.aggregate(F.slice(r, i + 1, F.lit(STEP)), F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def moved(x: Column, by: Column) -> Column:
        return F.struct((x["s"] + by).alias("s"), (x["e"] + by).alias("e"), x["value"].alias("value"))

    def join(a: Column, b: Column) -> Column:
        own = F.transform(b["out"], lambda x: moved(x, a["at"]))
        return F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["out"], F.array(own)).alias("out"))

    def whole(r: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(r) - 1, F.lit(STEP)), lambda i: block(r, i))
        return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), nones.alias("out")), join, lambda a: F.flatten(a["out"]))

    return _bind(raw, whole)


def _of_kind(o: int, kind: str, matches: Column) -> Column:
    ok = F.filter(matches, lambda x: _valid(kind, x["value"]))
    return F.transform(ok, lambda x: F.struct(F.lit(o).alias("o"), F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """Spans of personal values, by kind as in PATTERNS, then start. Null texts have none."""
    t = F.coalesce(text, F.lit(""))
    none = F.from_json(F.lit("[]"), f"array<{SPAN}>")
    kinds = []
    for o, (kind, p) in enumerate(PATTERNS.items()):
        spans = _of_kind(o, kind, located(t, p))
        here = F.contains(t, F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
        kinds.append(F.when(here & t.rlike(p), spans).otherwise(none))
    return F.concat(*kinds)


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def entities(kind: Column, value: Column) -> Column:
    """What a value identifies, as ``entity, wide``: itself in its normal form, and the wider entity that recurs where single
    values are rare: the domain of an address, the network (two parts) of an ip, the issuer (six digits) of a card, the
    exchange (all but four digits) of a phone number."""
    low, digits = F.lower(value), F.regexp_replace(value, "[^0-9]", "")
    own = F.when(kind.isin("card", "phone"), F.concat(kind, F.lit(":"), digits)).otherwise(low)
    wide = (
        F.when(kind == "email", F.concat(F.lit("@"), F.substring_index(low, "@", -1)))
        .when(kind == "ip", F.concat(F.substring_index(value, ".", 2), F.lit(".*")))
        .when(kind == "card", F.concat(F.lit("issuer:"), F.left(digits, F.lit(6))))
        .otherwise(F.concat(F.lit("exchange:"), F.left(digits, F.length(digits) - 4)))
    )
    return F.array(F.struct(own.alias("entity"), F.lit(False).alias("wide")), F.struct(wide.alias("entity"), F.lit(True).alias("wide")))


def _words(text: Column) -> Column:
    """Words of a text in lower case, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.lower(w))


def _distinct_words(text: str) -> Column:
    return F.array_distinct(_words(F.col(text)))


def _near(kind: str) -> Column:
    """``kind, value, terms`` of each value of one kind in column ``text``."""
    text, pattern = F.col("text"), PATTERNS[kind]
    raw = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("v"))

    def one(r: Column, v: Column, i: Column) -> Column:
        left = _words(F.substring_index(F.get(r["p"], i), "\n", -1))
        right = _words(F.substring_index(F.get(r["p"], i + 1), "\n", 1))
        last = _bind(left, lambda w: F.slice(w, F.greatest(F.size(w) - NEAR, F.lit(0)) + 1, F.lit(NEAR)))
        return F.struct(F.lit(kind).alias("kind"), v.alias("value"), F.array_distinct(F.concat(last, F.slice(right, 1, NEAR))).alias("terms"))

    def around(r: Column) -> Column:  # an invalid match keeps its place, so that pieces and matches stay in step
        return F.filter(F.transform(r["v"], lambda v, i: F.when(_valid(kind, v), one(r, v, i))), lambda x: x.isNotNull())

    none = F.from_json(F.lit("[]"), "array<struct<kind:string,value:string,terms:array<string>>>")
    return F.when(F.exists("base", lambda x: x["kind"] == kind), _bind(raw, around)).otherwise(none)


def contexts(some: DataFrame) -> DataFrame:
    """``row_id, kind, entity, wide, terms``: for each occurrence of a value and each entity of it the different words near it.

    Near are ``NEAR`` words on each side, on the value's line, up to the next match of the same kind. They come from the
    pieces between matches, so each piece of a text is read twice at most, however many values a line holds."""
    each = some.select("row_id", F.explode(F.concat(*(_near(kind) for kind in PATTERNS))).alias("x"))
    each = each.select("row_id", "x.kind", F.explode(entities(F.col("x.kind"), F.col("x.value"))).alias("y"), F.col("x.terms").alias("terms"))
    return each.select("row_id", "kind", "y.entity", "y.wide", "terms")


def found(docs: DataFrame) -> DataFrame:
    """``row_id, doc_id, text, base``: personal values of every row (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long"), text.alias("text"))
    return d.withColumn("base", base_spans(F.col("text")))


def _bounded(df: DataFrame, broadcast_bytes: int, row_bytes: int = 64) -> DataFrame:
    """``df``, marked for a broadcast if its rows fit."""
    return F.broadcast(df) if df.count() * row_bytes <= broadcast_bytes else df


def different(every: DataFrame, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Rows of ``found`` (a written table) with the first of equal texts alone: copies are no evidence. Only hashes are shuffled."""
    narrow = materialise(every.select("row_id", F.xxhash64("text", F.char_length("text")).alias("h")), "hashes")
    more = materialise(narrow.groupBy("h").agg(F.count("*").alias("n"), F.min("row_id").alias("first")).filter("n > 1"), "copies")
    gone = join_groups(narrow, more, "h", "n", narrow.count()).filter("row_id <> first").select("row_id")
    return drop_rows(every, gone, "row_id", broadcast_bytes)


def lower_bound(k: Column, n: Column, z: float) -> Column:
    """Wilson's lower bound of a proportion: ``k`` of ``n``, ``z`` standard deviations."""
    p = k / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def revealing_terms(texts_: DataFrame, some: DataFrame, threshold: float = 0.5, least_contexts: int = 3, z: float = 1.645, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``term, value, kind, share``: terms that reveal a protected entity (``value``: see entities) of a kind.

    ``texts_`` are different texts and ``some`` those rows of ``found`` among them that have base spans. p(entity | term) is the
    lower bound, at ``z`` standard deviations, of the share of the texts with the term in which it stands near the entity; share =
    log(p(entity | term) / p(entity)) / -log p(entity) is the part of the entity's information that the term gives at least. A
    term reveals an entity if share and p(entity | term) reach ``threshold`` and it stands near the entity in ``least_contexts``
    different contexts. An entity of fewer contexts is revealed by nothing: one context is no estimate.

    As p(entity | term) has a lower bound, revealing terms occur at most 1 / threshold times as often as they stand near
    values, whatever the size of the corpus. The words of the corpus are summed in tasks; those that stand near values
    are broadcast up to ``broadcast_bytes``, else joined to the sums."""
    near = materialise(contexts(some).withColumn("context", F.xxhash64("terms")), "contexts")
    values = near.groupBy(F.col("entity").alias("value")).agg(F.min("kind").alias("kind"), F.countDistinct("row_id").alias("n_value"))
    pairs = near.select("row_id", F.col("entity").alias("value"), "context", F.explode("terms").alias("term"))
    both = pairs.groupBy("value", "term").agg(F.countDistinct("row_id").alias("n_both"), F.countDistinct("context").alias("contexts")).filter(F.col("contexts") >= least_contexts)
    values = materialise(values, "values")
    size = values.agg(F.sum(F.octet_length("value") + 64)).first()[0] or 0
    both = materialise(both.join(F.broadcast(values) if size <= broadcast_bytes else values, "value").drop("contexts"), "pairs")
    terms = materialise(both.select("term").distinct(), "terms")
    size = terms.agg(F.sum(F.octet_length("term") + 48)).first()[0]
    if size is None:
        return both.select("term", "value", "kind", F.lit(0.0).alias("share")).limit(0)
    words = texts_.select(F.explode(_distinct_words("text")).alias("term"))
    if size <= broadcast_bytes:
        n_term = words.join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term"))
    else:
        n_term = words.groupBy("term").agg(F.count("*").alias("n_term")).join(terms, "term", "left_semi")
    n = float(texts_.count())
    x = both.join(n_term, "term").withColumn("_p", lower_bound(F.col("n_both"), F.col("n_term"), z))
    share = F.when(F.col("n_value") < n, F.log(F.col("_p") * n / F.col("n_value")) / F.log(n / F.col("n_value"))).otherwise(0.0)
    return x.filter(F.col("_p") >= threshold).select("term", "value", "kind", share.alias("share")).filter(F.col("share") >= threshold)


def private_spans(
    docs: DataFrame, threshold: float = 0.5, least_contexts: int = 3, remove_from: float = 0.8, broadcast_bytes: int = 64 << 20, every_row: bool = False
) -> DataFrame:
    """``row_id, doc_id, text, base, terms`` for each row of ``docs`` (doc_id, text).

    ``base`` are the personal values. ``terms`` are words that reveal an entity, of kind ``term_email``, ``term_ip``, ... (to be
    generalised to that kind of entity) or ``term_removed`` (share of ``remove_from`` or more): with ``every_row`` in all rows, as they disclose the person where
    the value is absent too; else only in rows that hold the value. Words that overlap a value are part of it.
    Null texts are empty texts; repeated rows get the same spans each; an empty table gives no row.

    Rows are written once with their values. Words meet the revealing terms where they lie, by broadcast up to
    ``broadcast_bytes``, else in a shuffle of narrow rows. Texts are not shuffled, unless the rows with hits are too
    many for a broadcast of that size."""
    every = materialise(found(docs), "found")
    some = materialise(every.filter(F.size("base") > 0), "private")
    once = different(every, broadcast_bytes)
    reveal = revealing_terms(once, once.filter(F.size("base") > 0), threshold, least_contexts, broadcast_bytes=broadcast_bytes)
    reveal = materialise(reveal, "reveal")
    none = F.from_json(F.lit("[]"), f"array<{SPAN}>")
    if not reveal.limit(1).count():
        return every.withColumn("terms", none)
    told = term_spans(every, some, reveal, remove_from, broadcast_bytes, every_row)
    if (told.agg(F.sum(F.size("terms") * 40 + 64)).first()[0] or 0) <= broadcast_bytes:
        told = F.broadcast(told)
    return every.join(told, "row_id", "left").select("row_id", "doc_id", "text", "base", F.coalesce("terms", none).alias("terms"))


def term_spans(every: DataFrame, some: DataFrame, reveal: DataFrame, remove_from: float, broadcast_bytes: int, every_row: bool) -> DataFrame:
    """``row_id, terms`` of the rows that hold revealing terms: their spans outside personal values, in order.

    First the different words of each row meet the terms, then only rows with such a word are cut into positions. Spans
    meet values by row and place, so a text of many values costs no more than their number."""
    if every_row:
        terms = materialise(reveal.groupBy("term").agg(F.max("share").alias("share"), F.max_by("kind", F.struct("share", "kind")).alias("of")), "revealing")
        words = every.select("row_id", F.explode(_distinct_words("text")).alias("term"))
        told = words.join(_bounded(terms, broadcast_bytes), "term")
    else:
        named = some.select("row_id", F.explode("base").alias("x")).select("row_id", F.explode(entities(F.col("x.kind"), F.col("x.value"))).alias("y"))
        told = named.select("row_id", F.col("y.entity").alias("value")).distinct().join(reveal, "value").groupBy("row_id", "term").agg(F.max("share").alias("share"), F.max_by("kind", F.struct("share", "kind")).alias("of"))
    told = materialise(told, "told")
    of = every.join(_bounded(told.select("row_id").distinct(), broadcast_bytes), "row_id")
    places = materialise(of.select("row_id", F.explode(located(F.col("text"), WORD)).alias("x")).select("row_id", "x.s", "x.e", F.lower("x.value").alias("term")).join(told, ["row_id", "term"]), "places")
    cell = lambda s, e: F.explode(F.sequence(F.floor(s / CELL), F.floor((e - 1) / CELL))).alias("cell")
    values = some.select("row_id", F.explode("base").alias("b")).select("row_id", F.col("b.s").alias("bs"), F.col("b.e").alias("be"), cell(F.col("b.s"), F.col("b.e")))
    own = places.select("row_id", "s", "e", cell(F.col("s"), F.col("e"))).join(values, ["row_id", "cell"]).filter("bs < e and s < be")
    kind = F.when(F.col("share") >= remove_from, F.lit("term_removed")).otherwise(F.concat(F.lit("term_"), F.col("of")))
    span = F.struct("s", F.lit(len(PATTERNS)).alias("o"), kind.alias("kind"), "e", F.col("term").alias("value"))
    rows = places.join(own.select("row_id", "s").distinct(), ["row_id", "s"], "left_anti").groupBy("row_id").agg(F.sort_array(F.collect_list(span)).alias("x"))
    again = F.transform("x", lambda x: F.struct(x["o"].alias("o"), x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["value"].alias("value")))
    return materialise(rows.select("row_id", again.alias("terms")), "hits")


def cleaned_text() -> Column:
    """The text of a row of private_spans with every span replaced; where spans overlap the first one counts."""
    ordered = F.array_sort(F.transform(F.concat("base", "terms"), lambda x: F.struct(x["s"].alias("s"), x["o"].alias("o"), x["e"].alias("e"), x["kind"].alias("kind"))))
    put = lambda x: F.when(x["kind"] == "term_removed", F.lit("")).otherwise(F.concat(F.lit("["), x["kind"], F.lit("]")))
    none = F.from_json(F.lit("[]"), "array<string>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    step = lambda a, x: F.when(x["s"] < a["at"], a).otherwise(
        F.struct(x["e"].alias("at"), F.concat(a["out"], F.array(F.substr(F.col("text"), a["at"] + 1, x["s"] - a["at"]), put(x))).alias("out"))
    )
    done = lambda a: F.concat(F.array_join(a["out"], ""), F.substr(F.col("text"), a["at"] + 1, F.char_length("text")))
    return F.when(F.size(ordered) == 0, F.col("text")).otherwise(F.aggregate(ordered, start, step, done))


def sanitised(spans: DataFrame) -> DataFrame:
    """``doc_id, text`` with every span of private_spans replaced: values by their kind in brackets, terms by that of what they
    reveal (``[term_email]``), and revealing terms of the higher threshold by nothing."""
    return spans.select("doc_id", cleaned_text().alias("text"))


def op5_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal values of every document as the contract counts and hashes them, and all spans with revealing terms.

    One row for each row of ``documents``; null texts are empty and have no span, repeated rows have theirs each, an empty
    table gives no row. ``n_values`` are the values of all kinds, ``n_terms`` the spans of terms,
    and ``sanitised_sha256`` hashes the text with all of them replaced."""
    x = private_spans(texts(spark, sf_dir), every_row=True)
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    gone = lambda s: s["kind"] == "term_removed"
    return x.select(
        "doc_id", *(n(k) for k in PATTERNS), F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.concat("base", F.filter("terms", lambda s: ~gone(s)), F.filter("terms", gone))).alias("spans"),
        F.size("base").cast("long").alias("n_values"), F.size("terms").cast("long").alias("n_terms"), F.sha2(cleaned_text(), 256).alias("sanitised_sha256"),
    )
