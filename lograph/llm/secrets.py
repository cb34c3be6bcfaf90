"""Secrets in texts: found by pattern, and told from copied examples by who owns them across the corpus.

1. Base. Assignments, access key ids and long hex strings are found by pattern in every text.
2. Candidates. Their values, and further tokens that could be one: known key forms, long tokens of mixed case and digits, and every other
   token with letters and digits, which counts only if its value is assigned somewhere in the corpus.
3. Ownership. Per value (by its SHA-256) the corpus is asked in how many different repositories and under how many different owners it
   stands. Each (value, owner, repository) is counted once, folded before it is shuffled.
4. Verdict. A value of ``WIDE_OWNERS`` owners or ``WIDE_REPOS`` repositories is a widely copied example, as is one that names itself a placeholder.
   A value of fewer that looks random (letters and digits, ``LIVE_BITS`` bits a character) is live. The rest is plain.
5. Spans. All occurrences of live values outside base spans are added, so a key that is assigned in one file is also found where it
   stands bare. Base spans stay whatever the verdict, which is counted beside them.

All of it is Spark's own expressions. A row is known by a number of its own from step 1 on, so texts are read twice and never shuffled.

Cases: a null or empty text has no spans. A null owner or repository is one of its own. Copies of a document in one repository count once. Rows
that repeat get equal results. Extra columns come along; those named like results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograph.llm.text import let, matches
from lograph.session import written

#: The patterns of the base kinds, and the fewest characters that each must have.
PATTERNS = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "(?<![0-9a-f])[0-9a-f]++",
}
LEAST = {"assign": 6, "access": 20, "hex": 24}
HINTS = {"assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}
KINDS = [*PATTERNS, "live"]
#: A token with a digit in it: no start is tried twice inside a run of characters.
CHARS = "A-Za-z0-9+/_.=-"
TOKEN = f"(?<![{CHARS}])[A-Za-z+/_.=-]*+[0-9][{CHARS}]*+"
#: Prefixes that issuers publish for their keys.
FORM = "^(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20}|glpat-|xox[abprs]-|[sr]k_live_|AIza[A-Za-z0-9_-]{30}|eyJ[A-Za-z0-9_-]{8,}\\.eyJ)"
MIXED = "^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])[A-Za-z0-9+_=-]{24,}$"
PLACEHOLDER = "(?i)example|sample|dummy|changeme|placeholder|redacted|your[_-]|x{4}|0{6}|123456"
WIDE_OWNERS, WIDE_REPOS, LIVE_CHARS, LIVE_BITS = 4, 12, 8, 2.5
SPAN = "struct<start:bigint,rank:int,end:bigint,kind:string,value:string>"
RESULTS = ["base_spans", "spans", "n_live", "n_example"]


def value_of(kind: str, match: Column) -> Column:
    """What is secret in a match: the assigned value, without dots at its end."""
    value = F.regexp_extract(match, PATTERNS["assign"], 2) if kind == "assign" else match
    return F.regexp_replace(value, "[.]+$", "")


def spans_of(kind: str, text: Column) -> Column:
    found = matches(text, PATTERNS[kind])
    own = (lambda m: F.regexp_extract(m, PATTERNS["assign"], 2)) if kind == "assign" else (lambda m: m)
    kept = F.filter(found, lambda m: F.length(own(m["value"])) >= LEAST[kind])
    spans = F.transform(kept, lambda m: F.struct(
        m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), value_of(kind, m["value"]).alias("value"),
    ))
    return F.when(text.rlike(HINTS[kind]), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def bits(value: Column) -> Column:
    """Shannon entropy of the characters of a value, per character."""
    n = F.length(value).cast("double")

    def part(c: Column) -> Column:
        share = (n - F.length(F.replace(value, c, F.lit("")))) / n
        return -share * F.log2(share)

    return F.when(n > 0, F.aggregate(F.array_distinct(F.filter(F.split(value, ""), lambda c: c != "")), F.lit(0.0), lambda s, c: s + part(c))).otherwise(0.0)


def tokens(text: Column) -> Column:
    """Tokens of ``LIVE_CHARS`` and more characters, with letters and digits."""
    found = F.transform(matches(text, TOKEN), lambda m: F.struct(
        m["start"].alias("start"), F.lit(KINDS.index("live")).alias("rank"), (m["start"] + F.length(F.regexp_replace(m["value"], "[.]+$", ""))).alias("end"),
        F.lit("live").alias("kind"), F.regexp_replace(m["value"], "[.]+$", "").alias("value"),
    ))
    return F.filter(found, lambda s: (F.length(s["value"]) >= LIVE_CHARS) & s["value"].rlike("[A-Za-z]"))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text, with ``base_spans``, ``__row`` and ``__tokens`` (those outside base spans). Written."""
    whole = F.coalesce(F.col(text), F.lit(""))
    names = [c for c in docs.columns if c != text and c not in RESULTS]
    found = docs.select(*names, whole.alias("__text")).withColumn(
        "base_spans", F.array_sort(F.concat(*[spans_of(kind, F.col("__text")) for kind in PATTERNS])),
    )
    free = lambda t: ~F.exists("base_spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    bare = F.filter(tokens(F.col("__text")), free)
    return written(found.select(*names, "base_spans", bare.alias("__tokens"), F.monotonically_increasing_id().alias("__row")), "candidates")


def verdicts(found: DataFrame, owner: str, repo: str) -> DataFrame:
    """Per value of a candidate: ``key``, ``n_repos``, ``n_owners`` and ``verdict`` (live, example or plain). ``found`` is the table of :func:`candidates`."""
    spans = found.select(
        F.col(owner).alias("owner"), F.col(repo).alias("repo"),
        F.explode(F.concat(
            F.transform("base_spans", lambda s: F.struct(s["value"].alias("value"), F.lit(True).alias("named"))),
            F.transform("__tokens", lambda s: F.struct(s["value"].alias("value"), (s["value"].rlike(FORM) | s["value"].rlike(MIXED)).alias("named"))),
        )).alias("s"),
    ).select("owner", "repo", F.col("s.value").alias("value"), F.col("s.named").alias("named"))
    places = spans.groupBy("value", "owner", "repo").agg(F.max("named").alias("named"))
    owners = places.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"), F.max("named").alias("named"))
    values = owners.groupBy("value").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"), F.max("named").alias("named")).filter("named")
    random = (F.length("value") >= LIVE_CHARS) & F.col("value").rlike("[A-Za-z]") & F.col("value").rlike("[0-9]") & (bits(F.col("value")) >= LIVE_BITS)
    wide = (F.col("n_owners") >= WIDE_OWNERS) | (F.col("n_repos") >= WIDE_REPOS) | F.col("value").rlike(PLACEHOLDER)
    verdict = F.when(wide, "example").when(random, "live").otherwise("plain")
    return written(values.select(F.sha2("value", 256).alias("key"), "n_repos", "n_owners", verdict.alias("verdict")), "verdicts")


def marked(docs: DataFrame, text: str = "text", owner: str = "source", repo: str = "doc_id") -> DataFrame:
    """All columns but the text, with ``base_spans``, ``spans``, and how many of them are of ``n_live`` and of ``n_example`` values.

    ``owner`` and ``repo`` name the columns of the owner of a document and of its repository.
    """
    found = candidates(docs, text)
    known = verdicts(found, owner, repo)
    listed = found.filter("size(base_spans) + size(__tokens) > 0").select("__row", F.explode(F.concat("base_spans", "__tokens")).alias("s"))
    judged = listed.withColumn("of", F.sha2("s.value", 256)).join(known, F.col("of") == F.col("key")).filter("verdict <> 'plain'")
    per_row = judged.groupBy(F.col("__row").alias("__of")).agg(
        F.collect_list(F.when((F.col("verdict") == "live") & (F.col("s.kind") == "live"), F.col("s"))).alias("__added"),
        F.count_if(F.col("verdict") == "live").alias("n_live"), F.count_if((F.col("verdict") == "example") & (F.col("s.kind") != "live")).alias("n_example"),
    )
    joined = found.join(per_row, F.col("__row") == F.col("__of"), "left")
    names = [c for c in found.columns if c not in ("__row", "__tokens", "base_spans")]
    spans = F.when(F.coalesce(F.size("__added"), F.lit(0)) > 0, F.array_sort(F.concat("base_spans", "__added"))).otherwise(F.col("base_spans"))
    zero = F.lit(0).cast("bigint")
    return joined.select(*names, "base_spans", spans.alias("spans"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_example", zero).alias("n_example"))
