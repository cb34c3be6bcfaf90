"""Mixing sources to target weights by entropy balancing.

A document of size ``s`` gets the rate ``min(cap, exp(lambda * x))`` with ``x`` its size over the mean
size of its source: of all rates within the cap that meet the source's token target these are the
closest, in relative entropy, to taking each document once. The multiplier of a source solves a convex
dual problem in one variable. Newton steps for all sources run together as Spark aggregates over the
table of (source, size, documents), which stands for all documents since equal sizes share a rate.

Rates become whole copies by systematic rounding: documents of a source in the order of size, each
gets the whole numbers that its stretch of the running sum of rates passes. The error of a source's
tokens stays below one largest document.

Cases: a null size counts as 0 and a null source is a source of its own, ordered last. Documents of
size 0 have rate 1 and take no tokens. An empty table gives an empty table. Ties of size are ordered by
a hash of the row and then by the id; equal rows stand next to each other, and either order gives
the same multiset. Further columns come along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lograph.llm.text import n_words
from lograph.operators.running import positioned, with_running
from lograph.session import written

#: No document is taken more often than this.
CAP = 3
WEIGHTS = (1, 2, 3)
#: Newton ends when every source is this close to its target, relative to it, or after ``STEPS`` steps.
CLOSE = 1e-9
STEPS = 60
#: Rates are held in units of this, as whole numbers: their sums do not depend on the order of adding.
UNIT = 1_000_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source: ``source_size``, ``docs`` and ``target``.

    ``sizes`` has ``source`` and ``size``. Sources in the order of their names, null last, weigh ``weights``,
    repeating. All tokens are shared by weight; no target goes above ``cap`` times the source, the
    excess is shared among the others. That is a common share per weight, found by sorting sources
    by the share at which they hit the cap. The windows run over one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    limit = (cap * F.col("source_size")).cast("double")
    by_limit = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # The share if exactly the sources before this one were at their limit.
    share = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    shares = by_source.withColumn("weight", weight).withColumn("share", share)
    fits = F.col("share") <= limit / F.col("weight")
    common = F.first(F.when(fits, F.col("share")), ignorenulls=True).over(
        by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return shares.select(
        "source", "source_size", "docs", F.coalesce(F.least(limit, common * F.col("weight")), limit).alias("target"),
    )


def balance(histogram: DataFrame, targets: DataFrame, cap: int = CAP) -> DataFrame:
    """Per source the multiplier ``lam``, by Newton steps kept inside a bracket that closes around the root.

    ``histogram`` has ``source``, ``size``, ``docs``. A source at its cap (or of size 0) needs no root: its rate is
    the cap. One written table of one row per source carries the state from step to step.
    """
    spark = histogram.sparkSession
    open_ = (F.col("target") < cap * F.col("source_size") * (1 - 1e-12)) & (F.col("target") > 0)
    state = written(
        targets.select(
            "source", "target", (F.col("source_size") / F.col("docs")).alias("mean"), open_.alias("open"),
            F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
            F.lit(False).alias("done"),
        ), "mixing",
    )
    x = F.col("size") / F.col("mean")
    rate = F.when(F.col("lam") * x < F.log(F.lit(float(cap))), F.exp(F.col("lam") * x)).otherwise(F.lit(float(cap)))
    for _ in range(STEPS):
        running = state.filter("open and not done").select(F.col("source").alias("of"), "mean", "lam")
        sums = histogram.filter("size > 0").join(running, F.col("source").eqNullSafe(F.col("of"))).groupBy("of").agg(
            F.sum(F.col("docs") * rate * F.col("size")).alias("taken"),
            F.sum(F.when(rate < cap, F.col("docs") * rate * F.col("size") * x).otherwise(F.lit(0.0))).alias("slope"),
        )
        miss = F.col("taken") - F.col("target")
        lo = F.when(miss < 0, F.greatest("lo", "lam")).otherwise(F.col("lo"))
        hi = F.when(miss > 0, F.least("hi", "lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - F.when(F.col("slope") > 0, miss / F.col("slope"))
        # Without a bound on one side yet, steps double outwards; inside a bracket the middle replaces a bad step.
        middle = F.when(lo.isNull(), hi - 1 - F.abs(hi)).when(hi.isNull(), lo + 1 + F.abs(lo)).otherwise((lo + hi) / 2)
        bad = newton.isNull() | (newton <= F.coalesce(lo, F.lit(float("-inf")))) | (newton >= F.coalesce(hi, F.lit(float("inf"))))
        bad = bad | (F.abs(newton - F.col("lam")) > 2 + 2 * F.abs(F.col("lam")))
        done = F.abs(miss) <= CLOSE * F.col("target")
        stepped = state.join(sums, state["source"].eqNullSafe(sums["of"]), "left")
        state = written(
            stepped.select(
                "source", "target", "mean", "open",
                F.when(F.col("taken").isNull() | done, F.col("lam")).when(bad, middle).otherwise(newton).alias("lam"),
                F.when(F.col("taken").isNull(), F.col("lo")).otherwise(lo).alias("lo"),
                F.when(F.col("taken").isNull(), F.col("hi")).otherwise(hi).alias("hi"),
                (F.col("done") | F.coalesce(done, F.lit(False))).alias("done"),
            ), "mixing",
        )
        if state.filter("open and not done").isEmpty():
            break
    return state.select("source", "mean", "open", "target", F.round("lam", 12).alias("lam"))


def mix(
    docs: DataFrame, size: str = "size", source: str = "source", doc_id: str = "doc_id",
    weights: tuple[int, ...] = WEIGHTS, cap: int = CAP,
) -> DataFrame:
    """The narrow table of the mix: id, source, size, ``source_size``, ``target``, ``rate``, ``copies``.

    ``docs`` needs the three named columns only; it is read once.
    """
    narrow = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size"),
    )
    ordered = positioned(
        narrow.withColumn("mark", F.xxhash64("doc_id", "source")), ["source", "size", "mark", "doc_id"], "pos",
    )
    histogram = written(ordered.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")), "mixing")
    targets = written(source_targets(ordered.select("source", "size"), weights, cap), "mixing")
    tilts = balance(histogram, targets, cap).alias("t").join(
        targets.select(F.col("source").alias("s2"), "source_size"), F.col("t.source").eqNullSafe(F.col("s2"))
    )
    x = F.col("size") / F.col("mean")
    tilted = F.when(F.col("lam") * x < F.log(F.lit(float(cap))), F.exp(F.col("lam") * x)).otherwise(F.lit(float(cap)))
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("open"), tilted).otherwise(F.lit(float(cap)))
    rated = ordered.alias("o").join(
        tilts.select(F.col("t.source").alias("of"), "mean", "open", "lam", "target", "source_size"), F.col("o.source").eqNullSafe(F.col("of"))
    ).select(
        "doc_id", F.col("o.source").alias("source"), "size", "pos", "source_size", "target", rate.alias("rate"),
        F.round(rate * UNIT).cast("bigint").alias("units"),
    )
    running = with_running(
        rated.withColumn("named", F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))),
        ["named"], ["pos"], {"before": ("sum", F.col("units"))},
    )
    # Half a unit of rate comes first, so that a source is rounded to the nearest on the whole.
    passed = lambda sum_: F.floor((sum_ + UNIT // 2) / UNIT)
    copies = F.least(F.lit(cap), passed(F.col("before") + F.col("units")) - passed(F.col("before"))).cast("int")
    return running.select("doc_id", "source", "size", "source_size", "target", "rate", copies.alias("copies"))


def sized(docs: DataFrame) -> DataFrame:
    """Documents with their number of words as ``size``, without the text."""
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
