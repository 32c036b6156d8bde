"""Personal data: base patterns, and information-theoretic sanitisation of the terms that give it away.

Base spans are the leftmost matches of four patterns (e-mail, IP address, card, phone), kept only if they are valid; a
match that fails is dropped and the search goes on after it. The patterns are written so that Java's matcher never looks
at a character more than a few times, and positions come from the pieces between matches, so long texts cost in
proportion to their length.

The method adds terms: words near a protected value, as the corpus shows them. For a value e and a term t,
PMI(e; t) = log(N c(e,t) / (c(e) c(t))), where c counts documents (for c(e,t), those with t within CONTEXT characters of
e), and t discloses e by the share PMI(e; t) / IC(e) with IC(e) = log(N / c(e)). Terms that disclose DISCLOSURE or more of
a value are removed wherever they stand in a document that holds the value. No value or pair is too rare to be measured: the
share of t's documents that have e near, c(e,t) / c(t), is taken as it is for pairs of SUPPORT documents or more; for rarer
ones it is shrunk to what chance gives, (c(e,t) + p(e)) / (c(t) + 1) with p(e) = c(e) / N, so that one meeting counts for
less in a small corpus, where most words are rare, than in a large one.
All are events of a document: to hold e, to hold t, to hold t near e. With context=None "near" is "in the same document", and
the measure is PMI as such; with a context it is at most that, as terms further away do not count for e.
All counts are over all documents; pairs are formed only from the bounded surroundings of values, counted after a partial
count on each task, and joined on keys that the join may split.

Only DataFrame functions are used. Defined cases: null and empty texts have no spans and stay as they are; repeated rows
and rows with null or equal ids are each reported, and rows with equal texts count as separate documents; an empty table
gives no rows; other columns are ignored, and passed through by :func:`sanitise`.
"""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, packed, unpacked

#: Characters on each side of a value whose words count as seen with it; share of a value's information; documents of a
#: pair from which its counts are taken as they are.
CONTEXT, DISCLOSURE, SUPPORT = 60, 0.9, 5
KINDS = ("email", "ip", "card", "phone")
#: The base patterns: possessive, and begun only where a match can begin, which leaves the leftmost matches the same.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MARK = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
#: A term: three letters or more.
TERM = r"\p{L}{3,}+"
_STEP = 512


def _maybe(kind: str, text: Column) -> Column:
    """A cheap test that holds for every text with a match."""
    return {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: inside a lambda the optimizer would write it out, and so run it, for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, 2 * d).otherwise(d)
        return total + twice - F.when(twice > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        return _let(_digits(match), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _running(sizes: Column, both=operator.add) -> Column:
    """Running sums (or what both makes of two, of longs from 0 on) of an array of longs, in blocks, so that the work stays near linear for long arrays."""

    def plain(a: Column) -> Column:
        empty = F.array().cast("array<bigint>")
        return F.aggregate(a, empty, lambda acc, x: F.concat(acc, F.array(both(x, F.when(F.size(acc) > 0, F.element_at(acc, -1)).otherwise(F.lit(0).cast("bigint"))))))

    def summed(inner: Column) -> Column:
        before = plain(F.concat(F.array(F.lit(0).cast("bigint")), F.transform(inner, lambda x: F.element_at(x, -1))))
        return F.flatten(F.zip_with(inner, F.slice(before, F.lit(1), F.size(inner)), lambda x, b: F.transform(x, lambda v: both(v, b))))

    places = F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / F.lit(_STEP)).cast("int"))
    blocks = F.transform(places, lambda b: plain(F.slice(sizes, b * _STEP + 1, _STEP)))
    return F.when(F.size(sizes) > 0, _let(blocks, summed)).otherwise(F.array().cast("array<bigint>"))


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _matched(df: DataFrame, kind: str, pattern: str, text: str, where: Column) -> DataFrame:
    """Adds <kind>_m, the matches, and <kind>_p, the pieces around them."""
    df = df.withColumn(f"{kind}_m", F.when(where, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(_none("array<string>")))
    return df.withColumn(f"{kind}_p", F.when(F.size(f"{kind}_m") > 0, F.split(text, pattern, -1)).otherwise(_none("array<string>")))


def _before(m: Column, p: Column) -> Column:
    """The piece before each match."""
    return F.slice(p, F.lit(1), F.size(m))


def _after(m: Column, p: Column) -> Column:
    return F.slice(p, F.lit(2), F.size(m))


def _spans(df: DataFrame, kind: str, wanted) -> DataFrame:
    """Adds <kind>_s: array of (start, end, value) in code points, of matches for which wanted(match) holds."""
    m, p = F.col(f"{kind}_m"), F.col(f"{kind}_p")

    def spans(x: Column) -> Column:
        ends = _let(x["sizes"], lambda sizes: _running(sizes))
        made = F.zip_with(x["m"], ends, lambda v, e: F.struct((e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))
        return F.filter(made, lambda s: wanted(s["value"]))

    sizes = F.zip_with(m, _before(m, p), lambda v, b: (F.length(b) + F.length(v)).cast("bigint"))
    return df.withColumn(f"{kind}_s", _let(F.struct(m.alias("m"), sizes.alias("sizes")), spans))


def _base(docs: DataFrame) -> DataFrame:
    """Adds the matches, pieces and valid spans of each kind."""
    for kind in KINDS:
        docs = _matched(docs, kind, PATTERNS[kind], "text", F.coalesce(_maybe(kind, F.col("text")), F.lit(False)))
        docs = _spans(docs, kind, lambda v, kind=kind: _valid(kind, v))
    return docs


def _values(df: DataFrame) -> Column:
    """The protected values of a row, once each."""

    def named(kind: str) -> Column:
        return F.transform(F.col(f"{kind}_s"), lambda s: F.concat(F.lit(f"{kind}:"), s["value"]))

    return F.array_distinct(F.concat(*[named(k) for k in KINDS]))


def _near(kind: str, context: int | None) -> Column:
    """(value, words near it) for every valid match of a kind; without a context, all words of the text but for the matches."""
    m, p = F.col(f"{kind}_m"), F.col(f"{kind}_p")

    def words(side: Column) -> Column:
        return F.regexp_extract_all(F.lower(side), F.lit(TERM), F.lit(0))

    def whole_left(piece: Column) -> Column:  # the first word of a cut piece may be a part of one
        return F.when(F.length(piece) > context, F.regexp_replace(F.right(piece, F.lit(context)), r"^\p{L}++", "")).otherwise(piece)

    def whole_right(piece: Column) -> Column:
        return F.when(F.length(piece) > context, F.regexp_replace(F.left(piece, F.lit(context)), r"(?<!\p{L})\p{L}++$", "")).otherwise(piece)

    sides = F.zip_with(_before(m, p), _after(m, p), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    found = F.filter(F.zip_with(m, sides, lambda x, s: F.struct(x.alias("raw"), s.alias("s"))), lambda x: _valid(kind, x["raw"]))
    if context is None:
        everything = F.array_distinct(words(F.array_join(p, " ")))
        return F.transform(found, lambda x: F.struct(F.concat(F.lit(f"{kind}:"), x["raw"]).alias("value"), everything.alias("terms")))
    terms = lambda s: F.concat(words(whole_left(s["left"])), words(whole_right(s["right"])))
    return F.transform(found, lambda x: F.struct(F.concat(F.lit(f"{kind}:"), x["raw"]).alias("value"), terms(x["s"]).alias("terms")))


def disclosing_terms(docs: DataFrame, found: DataFrame, support: int = SUPPORT) -> DataFrame:
    """Rows (value, term): terms that disclose a value. found has a row for each document with values: values, near."""
    n = docs.count()
    c_e = found.select(F.explode("values").alias("value")).groupBy("value").agg(F.count("*").alias("c_e"))
    pairs = found.select(F.explode(F.array_distinct(F.flatten(F.transform("near", lambda x: F.transform(x["terms"], lambda t: F.struct(x["value"].alias("value"), t.alias("term"))))))).alias("x"))
    c_et = cut(pairs.groupBy("x.value", "x.term").agg(F.count("*").alias("c_et")))
    words = docs.where(F.col("text").isNotNull()).select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term"))
    c_t = words.groupBy("term").agg(F.count("*").alias("c_t"))
    every = c_et.join(c_e, "value").join(c_t, "term")
    ic = F.log(F.lit(float(n)) / F.col("c_e"))
    chance = F.col("c_e") / F.lit(float(n))
    share = F.when(F.col("c_et") >= support, F.col("c_et") / F.col("c_t")).otherwise((F.col("c_et") + chance) / (F.col("c_t") + 1))
    pmi = F.log(share / chance)
    return cut(every.where((F.col("c_e") < n) & (pmi >= DISCLOSURE * ic)).select("value", "term"))


def _with_terms(docs: DataFrame, context: int | None, support: int) -> tuple[DataFrame, DataFrame]:
    """Documents with a row number and their matches; and rows (_row, terms): terms to remove from a document."""
    rows = cut(_base(docs.withColumn("_row", F.monotonically_increasing_id())))
    near = F.concat(*[_near(k, context) for k in KINDS])
    found = cut(rows.where(F.greatest(*[F.size(f"{k}_s") for k in KINDS]) > 0).select("_row", _values(rows).alias("values"), near.alias("near")))
    bad = disclosing_terms(rows, found, support)
    held = found.select("_row", F.explode("values").alias("value"))
    return rows, cut(held.join(bad, "value").groupBy("_row").agg(F.collect_set("term").alias("terms")))


def _with_term_spans(rows: DataFrame, terms: DataFrame) -> DataFrame:
    both = rows.join(terms, "_row", "left")
    both = _matched(both, "term", TERM, "text", F.col("terms").isNotNull())
    return _spans(both, "term", lambda v: F.array_contains(F.col("terms"), F.lower(v)))


def find(docs: DataFrame, context: int | None = CONTEXT, support: int = SUPPORT) -> DataFrame:
    """Rows (doc_id, email, ip, card, phone, term): arrays of (start, end, value), base spans and added terms.

    context=None takes all words of a document as near its values; support=1 takes the counts of every pair as they are.
    """
    both = _with_term_spans(*_with_terms(docs.select("doc_id", "text"), context, support))
    return both.select("doc_id", *[F.col(f"{k}_s").alias(k) for k in (*KINDS, "term")])


def _joined(kinds: tuple[str, ...]) -> Column:
    def named(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*[named(k) for k in kinds]), ",")


def _united(rows: DataFrame, kinds: tuple[str, ...]) -> Column:
    """(start, end, next, mark): spans of these kinds in order, overlapping ones as one, and where the next begins. The mark
    is that of the span that begins first, of the longest if several do."""

    def named(kind: str) -> Column:
        return F.transform(F.col(f"{kind}_s"), lambda s: F.struct(s["start"].cast("bigint").alias("start"), (-s["end"]).cast("bigint").alias("less"), F.lit(MARK[kind]).alias("mark")))

    def heads(x: Column) -> Column:
        reach = F.concat(F.array(F.lit(0).cast("bigint")), x["ends"])
        made = F.zip_with(x["spans"], F.slice(reach, F.lit(1), F.size(x["spans"])), lambda s, r: F.struct(s["start"].alias("start"), s["mark"].alias("mark"), r.alias("before")))
        return F.struct(F.filter(made, lambda h: h["start"] >= h["before"]).alias("heads"), F.element_at(reach, -1).alias("last"))

    def bounded(x: Column) -> Column:
        n = F.size(x["heads"])
        ends = F.concat(F.transform(F.slice(x["heads"], F.lit(2), n), lambda h: h["before"]), F.array(x["last"]))
        nexts = F.concat(F.transform(F.slice(x["heads"], F.lit(2), n), lambda h: h["start"]), F.array(F.length("text").cast("bigint")))
        both = F.zip_with(ends, nexts, lambda e, n: F.struct(e.alias("end"), n.alias("next")))
        return F.zip_with(x["heads"], both, lambda h, b: F.struct(h["start"].alias("start"), b["end"].alias("end"), b["next"].alias("next"), h["mark"].alias("mark")))

    spans = F.array_sort(F.concat(*[named(k) for k in kinds]))
    reached = _let(spans, lambda x: F.struct(x.alias("spans"), _running(F.transform(x, lambda s: -s["less"]), F.greatest).alias("ends")))
    return _let(_let(reached, heads), bounded)


def _marked(text: Column, spans: Column) -> Column:
    """text with a mark for each of the united spans, cut in blocks, so that the work stays near linear for long texts."""

    def block(some: Column) -> Column:
        base = F.get(some, F.lit(0))["start"]
        whole = F.substring(text, (base + 1).cast("int"), (F.element_at(some, -1)["next"] - base).cast("int"))
        pieces = lambda c: F.array_join(F.transform(some, lambda u: F.concat(u["mark"], F.substring(c, (u["end"] - base + 1).cast("int"), (u["next"] - u["end"]).cast("int")))), "")
        return _let(whole, pieces)

    places = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / F.lit(_STEP)).cast("int"))
    blocks = F.transform(places, lambda b: _let(F.slice(spans, b * _STEP + 1, _STEP), block))
    return F.concat(F.substring(text, F.lit(1), F.get(spans, F.lit(0))["start"].cast("int")), F.array_join(blocks, ""))


def sanitise(docs: DataFrame, context: int | None = CONTEXT, support: int = SUPPORT) -> DataFrame:
    """The documents with the spans that :func:`find` reports replaced by marks, in one pass; all columns stay."""
    names = docs.columns
    rows, terms = _with_terms(packed(docs), context, support)
    out = _with_term_spans(rows, terms)
    out = out.withColumn("united", F.when(F.greatest(*[F.size(f"{k}_s") for k in (*KINDS, "term")]) > 0, _united(out, (*KINDS, "term"))))
    out = out.withColumn("text", F.when(F.col("united").isNotNull(), _let(F.col("united"), lambda u: _marked(F.col("text"), u))).otherwise(F.col("text")))
    return unpacked(out, names)


def query(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find(docs.withColumn("doc_id", F.col("doc_id").cast("long")))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(KINDS), 256).alias("base_sha256"), _joined((*KINDS, "term")).alias("spans"), F.size("term").cast("long").alias("n_term"))
