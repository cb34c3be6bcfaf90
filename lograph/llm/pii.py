"""Personal data: found by pattern, and by what the corpus shows to point at it. Spark's own expressions only.

Protected entities are e-mail addresses, IP addresses, card and phone numbers. All words of a document that holds an
entity are terms that may disclose it, at any distance. With ``df`` counting documents, the information a term gives about an
entity is ``PMI(t; e) = log(df(t, e) N / (df(t) df(e)))``, and an entity holds ``IC(e) = log(N / df(e))``. A pair is a candidate
if ``PMI >= DISCLOSED * IC`` and chance alone would bring them together in so many different texts with a
probability of at most ``CHANCE`` (see :func:`surprise`); all pairs take part, also those of entities of a single text.

False discoveries are held to a share of ``FALSE`` on texts held out from the entities: each text with entities gets a decoy, a text without any,
which takes its entities for its own. Decoy pairs are measured as real ones are. Pairs disclose from the least surprise
at which decoy pairs are no more than ``FALSE`` of as many real ones (see :func:`least_surprise`). A word that stands in one text only agrees perfectly with an
entity of that text, but decoys have as many such words, so these tell nothing until real pairs outnumber them.

Every occurrence of a disclosing term in a document that holds its entity becomes a span like the entities
themselves. :func:`sanitised` puts the name of the kind in place of each span (terms are generalised to "a word").

Document frequencies count whole documents, both of a term and of a term with an entity. A pair with ``PMI >= DISCLOSED * IC``
has ``df(t) <= df(e) (N / df(e))^(1 - DISCLOSED)``, as ``df(t, e) <= df(e)``: other pairs of words and entities are never built.

Patterns are written so that no start is tried twice inside a run of characters: long runs stay linear. Texts
are cut into pieces of ``PIECE`` code points for access by position.

Cases: a null or empty text has no spans. Copies of a text count as documents, but as one text where chance
is judged. Spans of different kinds may overlap; a term never overlaps an entity. Repeated rows get equal
results, and no column but the text matters. Extra columns are kept; :func:`marked` replaces those named like its results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograph.llm.text import let, matches
from lograph.session import written

#: The patterns of each kind. Possessive runs match the same as greedy ones here.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that a text may hold a kind at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
KINDS = [*PATTERNS, "term"]
TERM = r"\p{L}{3,}+"
DISCLOSED, CHANCE, FALSE = 0.7, 0.01, 0.05
#: Steps of surprise at which false discoveries are counted, per doubling.
STEPS = 64
PIECE = 4096
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,value:string>"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def weight(i: Column) -> Column:
        digit = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, digit).otherwise(digit * 2 - F.when(digit > 4, F.lit(9)).otherwise(F.lit(0)))

    total = F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), lambda s, i: s + weight(i))
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == "card":
        return let(digits(value), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def spans_of(kind: str, text: Column) -> Column:
    found = matches(text, PATTERNS[kind])
    kept = F.filter(found, lambda m: valid(kind, m["value"]))
    spans = F.transform(kept, lambda m: F.struct(
        m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value"),
    ))
    return F.when(text.rlike(HINTS[kind]), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def entity(span: Column) -> Column:
    """The same for all spellings of an entity."""
    value = F.when(span["kind"].isin("card", "phone"), digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat_ws(":", span["kind"], value)


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns, and ``spans`` (the entities by start and kind), ``held`` (the text, if it has any), ``free`` (the text, if it has none) and ``digest``."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumn("__text", whole).withColumn(
        "spans", F.array_sort(F.concat(*[spans_of(kind, F.col("__text")) for kind in PATTERNS])),
    ).withColumn("digest", F.sha2("__text", 256))
    some = (F.size("spans") == 0) & (F.col("__text") != "")
    return found.withColumn("held", F.when(F.size("spans") > 0, F.col("__text"))).withColumn("free", F.when(some, F.col("__text"))).drop("__text")


def holding(found: DataFrame) -> DataFrame:
    """Each text with entities once: ``digest``, ``copies``, ``held``, ``spans``. ``found`` is the table of :func:`entities`."""
    texts = found.filter(F.size("spans") > 0).groupBy("digest")
    return written(texts.agg(F.count(F.lit(1)).alias("copies"), F.first("held").alias("held"), F.first("spans").alias("spans")), "texts")


def surprise(support: Column, given: Column) -> Column:
    """How much more than chance ``support`` texts together at a PMI of ``given`` are: a bound of the negative logarithm of the probability.

    With ``m`` expected, chance makes ``k`` or more with a probability of at most ``m^k / k!``. PMI is ``log(k / m)``, and Stirling's
    formula bounds the factorial from below.
    """
    return support * (given - 1) + F.log(2 * math.pi * support) / 2


def decoys(texts: DataFrame, found: DataFrame) -> DataFrame:
    """For each text with entities (if there is any text for it) one without, under the entities of the first: ``digest``, ``copies``, ``held``, ``spans``.

    Texts are dealt to as many buckets as there are texts with entities; the first of a bucket is the decoy of those that fall into it.
    """
    buckets = F.lit(max(1, texts.count()))
    place = lambda seed: F.pmod(F.xxhash64("digest", F.lit(seed)), buckets)
    free = found.filter("free is not null").select("digest", "free", place(1).alias("__bucket"))
    firsts = free.groupBy("__bucket").agg(F.min("digest").alias("__of"))
    chosen = free.join(firsts, "__bucket").filter("digest = __of").groupBy("__bucket").agg(F.first("free").alias("held"))
    return texts.select(F.concat(F.lit("decoy "), "digest").alias("digest"), F.lit(1).cast("bigint").alias("copies"), "spans", place(2).alias("__bucket")).join(chosen, "__bucket").drop("__bucket")


def near_pairs(both: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """Of real texts and decoys (``both``) the candidate pairs of entities and terms, real ones and those of decoys, per text: ``digest``, ``decoy``, ``entity``, ``term``, ``surprise``."""
    total = F.lit(float(docs.count()))
    there = both.select("decoy", "digest", "copies", F.explode(F.array_distinct(F.transform("spans", entity))).alias("entity"))
    holders = there.filter("not decoy").groupBy("entity").agg(F.sum("copies").alias("df_entity"))
    most = F.col("df_entity") * F.pow(total / F.col("df_entity"), F.lit(1 - DISCLOSED)) * (1 + 1e-9)
    there = written(there.join(holders.withColumn("most", most), "entity").filter(F.col("df_entity") < total), "there")
    widest = there.agg(F.max("most")).first()[0] or 0.0
    in_docs = docs.select(F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("term"))
    df_term = in_docs.groupBy("term").agg(F.count(F.lit(1)).alias("df_term")).filter(F.col("df_term") <= widest)
    words = both.select("digest", F.explode(terms(F.col("held"))).alias("term")).join(written(df_term, "terms"), "term")
    near = there.join(words, "digest").filter(F.col("df_term") <= F.col("most")).select("decoy", "digest", "copies", "entity", "df_entity", "term", "df_term")
    near = written(near, "near")
    pairs = near.groupBy("decoy", "entity", "term", "df_entity", "df_term").agg(F.sum("copies").alias("together"), F.count(F.lit(1)).alias("support"))
    held = F.log(total / F.col("df_entity"))
    given = F.log(F.col("together") * total / (F.col("df_term") * F.col("df_entity")))
    pairs = pairs.withColumn("surprise", surprise(F.col("support"), given)).filter((given >= DISCLOSED * held) & (F.col("surprise") >= -math.log(CHANCE)))
    return near.select("decoy", "digest", "entity", "term").join(pairs.select("decoy", "entity", "term", "surprise"), ["decoy", "entity", "term"])


def least_surprise(pairs: DataFrame, weight: float = 1.0) -> DataFrame:
    """One row, ``least``: the least surprise from which on decoy pairs are at most ``FALSE`` of the real ones; null if there is none.

    ``pairs`` has ``entity``, ``term``, ``decoy`` and ``surprise``; a decoy pair stands for ``weight`` of them. Pairs are counted in steps
    of surprise that grow with it, so some thousand rows are left to compare.
    """
    one = pairs.select("decoy", "entity", "term", "surprise").distinct()
    steps = one.groupBy(F.floor(F.log2("surprise") * STEPS).alias("step")).agg(
        F.count_if(~F.col("decoy")).alias("real"), F.count_if(F.col("decoy")).alias("false"),
    )
    listed = steps.agg(F.array_sort(F.collect_list(F.struct((-F.col("step")).alias("down"), "real", "false"))).alias("steps"))
    zero = F.lit(0).cast("bigint")
    start = F.struct(zero.alias("real"), zero.alias("false"), F.lit(None).cast("bigint").alias("least"))

    def add(a: Column, s: Column) -> Column:
        real, false = a["real"] + s["real"], a["false"] + s["false"]
        good = (weight * false <= FALSE * real) & (real > 0)
        return F.struct(real.alias("real"), false.alias("false"), F.when(good, -s["down"]).otherwise(a["least"]).alias("least"))

    return listed.select(F.pow(F.lit(2.0), F.aggregate("steps", start, add, lambda a: a["least"]) / STEPS).alias("least"))


def disclosing(texts: DataFrame, docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """Per text (by its ``digest``) the terms that disclose an entity of it.

    ``texts`` is the table of :func:`holding`, ``found`` that of :func:`entities`, ``docs`` has all texts.
    """
    both = texts.withColumn("decoy", F.lit(False)).unionByName(decoys(texts, found).withColumn("decoy", F.lit(True)))
    both = written(both, "with_decoys")
    pairs = written(near_pairs(both, docs, text), "candidates")
    real, false = both.agg(F.count_if(~F.col("decoy")), F.count_if(F.col("decoy"))).first()
    least = least_surprise(pairs, real / max(1, false))
    return written(pairs.filter(~F.col("decoy") & (F.col("surprise") >= least.scalar())).select("digest", "term").distinct(), "disclosing")


def with_terms(found: DataFrame, texts: DataFrame, named: DataFrame) -> DataFrame:
    """``found`` with the spans of the disclosing terms of each text added to ``spans``: all their occurrences outside entities.

    Spans depend on the text alone, so they are worked out once per text and joined by its digest.
    """
    words = texts.join(named.select("digest").distinct(), "digest", "left_semi").select("digest", F.explode(matches(F.col("held"), TERM)).alias("m"))
    words = words.select("digest", F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.lower("m.value").alias("term"))
    spans = words.join(named, ["digest", "term"]).groupBy("digest").agg(F.collect_list(F.struct(
        F.col("start"), F.lit(KINDS.index("term")).alias("rank"), F.col("end"), F.lit("term").alias("kind"), F.col("term").alias("value"),
    )).alias("__added"))
    clear = lambda m: ~F.exists("spans", lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"]))
    spans = texts.select("digest", "spans").join(spans, "digest").select(F.col("digest").alias("__of"), F.filter("__added", clear).alias("__added"))
    joined = found.join(spans, F.col("digest") == F.col("__of"), "left")
    both = F.when(F.col("__added").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", F.col("__added").cast(f"array<{SPAN}>"))))
    return joined.select(*[c for c in found.columns if c != "spans"], F.col("spans").alias("base_spans"), both.alias("spans"))


def span_list(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def marked(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text, with ``base_spans``, ``spans`` and ``digest``: the whole method."""
    found = written(entities(docs, text).drop(text), "entities")
    texts = holding(found)
    return with_terms(found.drop("held", "free"), texts, disclosing(texts, docs, found, text))


def replaced(text: Column, spans: Column) -> Column:
    """The text with the name of its kind in place of each span; overlapping spans leave one name, that of the first."""
    def piece(part: Column, k: Column) -> Column:
        begin = k.cast("bigint") * PIECE
        end = begin + F.length(part)
        inside = F.filter(spans, lambda s: (s["start"] < end) & (s["end"] > begin))

        def step(a: Column, s: Column) -> Column:
            start, stop = F.greatest(s["start"] - begin, F.lit(0).cast("bigint")), F.least(s["end"] - begin, F.length(part).cast("bigint"))
            between = F.substring(part, (a["at"] + 1).cast("int"), F.greatest(start - a["at"], F.lit(0)).cast("int"))
            # A span that began in an earlier piece, or inside the span before it, has its name there.
            name = F.when((s["start"] >= begin) & (start >= a["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit(""))
            return F.struct(F.greatest(a["at"], stop).alias("at"), F.concat(a["out"], between, name).alias("out"))

        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
        return F.aggregate(inside, start, step, lambda a: F.concat(a["out"], F.substring(part, (a["at"] + 1).cast("int"), F.lit(PIECE))))

    whole = F.array_join(F.transform(pieces(text), piece), "")
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def sanitised(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with all spans replaced in the text. Spans are joined by the digest of the text."""
    plans = marked(docs.select(text), text).filter(F.size("spans") > 0).groupBy(F.col("digest").alias("__of")).agg(F.first("spans").alias("__spans"))
    none = F.array().cast(f"array<{SPAN}>")
    whole = F.coalesce(F.col(text), F.lit(""))
    joined = docs.join(written(plans, "plans"), F.sha2(whole, 256) == F.col("__of"), "left")
    return joined.select(*[
        F.when(F.col("__spans").isNull(), F.col(text)).otherwise(replaced(whole, F.coalesce("__spans", none))).alias(c) if c == text else F.col(c)
        for c in docs.columns
    ])
