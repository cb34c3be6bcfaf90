"""Quality rules with risk-controlled cutoffs, in Spark's own expressions only.

Each rule rejects documents whose value lies above a cutoff. For every stratum (language) and rule the
cutoffs of a fixed grid are tested from the most lenient on against the labelled holdout: good
documents (label 1) that pass the base checks. A cutoff is certified if the exact binomial test rejects "the
share of good documents above it is more than the rule's share of the risk": P(X <= k; n, risk) is at most the
level. The level is split evenly over strata and rules (Bonferroni); inside one grid testing stops at the first
cutoff that fails, which needs no further split (fixed sequence). The strictest certified cutoff applies.

So with probability of at least ``1 - DELTA``, in every stratum at most ``RISK`` of all good documents are rejected by
the rules. A stratum with too few labels, or one with labels but no certified cutoff, keeps all its documents.

Cases: a null or empty text has no words and fails the base check. A null language is a stratum of its own. Labels
that repeat count once, a document labelled both good and bad counts as bad, null labels and labels of
documents that are not there count nowhere. Without labels nothing but the base check rejects. Repeated rows
are judged alike. Extra columns come along with :func:`judged`, but for those named like a result or a column in between (``HELPERS``, ``cut_*``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lograph.llm.text import WORD, let, words

#: Base checks: fewer words, or a larger share of repeated words, fail.
LEAST_WORDS, MOST_REPEATED = 50, 0.5
#: Good documents of a stratum that all rules together may reject, and the chance that any stratum exceeds it.
RISK, DELTA = 0.01, 0.05
HELPERS = frozenset("n_words word_chars n_symbols n_lines n_dup_lines n_repeat_words base_failed kept stratum good labelled q __m __l".split())
#: By rule: its share of the risk, and the grid of cutoffs from lenient to strict.
RULES: dict[str, tuple[float, tuple[float, ...]]] = {
    "symbols": (0.7, (0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.03, 0.02)),
    "dup_lines": (0.1, (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3)),
    "repeats": (0.1, (0.5, 0.45, 0.4, 0.35, 0.3)),
    "word_length": (0.1, (20.0, 15.0, 12.0, 10.0, 9.0, 8.0, 7.0)),
}


def repeated_words(of: Column) -> Column:
    """Words that lie in a window of three words found twice or more, the first included.

    Windows (as 64-bit hashes) are sorted together with their places; equal neighbours mark the places.
    ``of`` should be a bound array.
    """
    windows = F.when(F.size(of) >= 3, F.transform(
        F.sequence(F.lit(0), F.size(of) - 3), lambda i: F.struct(F.xxhash64(of[i], of[i + 1], of[i + 2]).alias("h"), i.alias("at")),
    )).otherwise(F.array().cast("array<struct<h:bigint,at:int>>"))
    found = let(F.array_sort(windows), lambda s: F.filter(
        s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False)),
    ))
    places = F.array_sort(F.transform(found, lambda x: x["at"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("total"))
    return F.aggregate(
        places, start, lambda a, p: F.struct(p.alias("last"), (a["total"] + F.least(F.lit(3), p - a["last"])).alias("total")), lambda a: a["total"],
    )


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns, and ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines``, ``n_dup_lines``, ``n_repeat_words`` and ``base_failed``."""
    docs = docs.drop(*[c for c in docs.columns if c in HELPERS or c.startswith("cut_")])
    whole = F.coalesce(F.col(text), F.lit(""))
    symbols = F.length(F.regexp_replace(whole, "[^#*$%&|<>]+", "")).cast("bigint")
    lines = F.filter(F.split(whole, "\\n"), lambda x: x.rlike(WORD))
    measured = let(words(F.col(text)), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        repeated_words(w).alias("n_repeat_words"),
    ))
    counted = docs.withColumns({
        "__m": measured, "n_symbols": symbols,
        "__l": let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("all"), F.size(F.array_distinct(x)).cast("bigint").alias("kinds"))),
    })
    out = counted.select(
        *docs.columns, F.col("__m.n_words").alias("n_words"), F.col("__m.word_chars").alias("word_chars"), "n_symbols",
        F.col("__l.all").alias("n_lines"), (F.col("__l.all") - F.col("__l.kinds")).alias("n_dup_lines"), F.col("__m.n_repeat_words").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 100 * MOST_REPEATED * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def rule_values() -> dict[str, Column]:
    """The value of each rule out of the columns of :func:`features`; 0 where nothing is there to measure."""
    share = lambda part, whole: F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))
    return {
        "symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"), "word_length": share("word_chars", "n_words"),
    }


def log_binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """log P(X <= k) for X binomial (n, p), summed term by term in logarithms."""
    odds = F.log(F.lit(p / (1 - p)))
    first = n * F.log(F.lit(1 - p))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + odds
        top = F.greatest(term, a["sum"])
        return F.struct(term.alias("term"), (top + F.log(F.exp(term - top) + F.exp(a["sum"] - top))).alias("sum"))

    start = F.struct(first.alias("term"), first.alias("sum"))
    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, add, lambda a: a["sum"])


def cutoffs(measured: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Per stratum: ``good`` (size of the holdout) and for each rule the certified cutoff ``cut_<rule>`` (null: none).

    ``measured`` has the columns of :func:`features`; ``labels`` has ``doc_id`` and ``quality``.
    """
    good = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("labelled")).agg(
        F.min("quality").alias("q"),
    ).filter("q = 1")
    held = measured.filter(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("labelled"))
    values = rule_values()
    above = [
        F.sum((values[rule] > cut).cast("bigint")).alias(f"{rule}_{i}") for rule, (_, grid) in RULES.items() for i, cut in enumerate(grid)
    ]
    counts = held.groupBy(F.col(stratum).alias("stratum")).agg(F.count(F.lit(1)).alias("good"), *above)
    # Strata are one row each; their number is the size of the family of tests.
    level = F.log(F.lit(delta) / (F.count(F.lit(1)).over(Window.partitionBy()) * len(RULES)))
    tested = counts.withColumn("level", level)

    def certified(rule: str) -> Column:
        share, grid = RULES[rule]
        limit = risk * share
        steps = F.array(*[F.struct(F.lit(cut).alias("cut"), F.col(f"{rule}_{i}").alias("k")) for i, cut in enumerate(grid)])
        start = F.struct(F.lit(True).alias("open"), F.lit(None).cast("double").alias("cut"))

        def test(a: Column, s: Column) -> Column:
            # At or above the expected number nothing can be certified, and no sum is needed.
            passed = F.when(~a["open"] | (s["k"] >= limit * F.col("good")), F.lit(False)).otherwise(
                log_binomial_cdf(s["k"], F.col("good"), limit) <= F.col("level")
            )
            return let(passed, lambda ok: F.struct(ok.alias("open"), F.when(ok, s["cut"]).otherwise(a["cut"]).alias("cut")))

        return F.aggregate(steps, start, test, lambda a: a["cut"]).alias(f"cut_{rule}")

    return tested.select("stratum", "good", *[certified(rule) for rule in RULES])


def judged(measured: DataFrame, cuts: DataFrame, stratum: str = "lang") -> DataFrame:
    """All columns of ``measured`` and ``kept``: neither base check nor rule rejects the document."""
    values = rule_values()
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | F.coalesce(values[rule] > F.col(f"cut_{rule}"), F.lit(False))
    joined = measured.join(cuts, F.col(stratum).eqNullSafe(F.col("stratum")), "left")
    return joined.select(*measured.columns, (~(F.col("base_failed") | rejected)).alias("kept"))
