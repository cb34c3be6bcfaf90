"""Root cause and impact along the dependency graph. An edge points from the caller to its dependency.

Chains first: a resource with one way in and one way out only passes a walk on. Each such resource finds the head of its chain by doubling of
pointers, so a chain of a thousand takes ten rounds, and becomes one link with its length. Resources that nothing leaves, and those that
nothing enters, are set aside before, so that side branches of one hop cut no chain.

Then hop by hop: each round joins what came nearer in the last round with the links and keeps what comes nearer by that. The
loops on the driver only count rounds. Each round is written to the shared folder and read back, which cuts the lineage, survives lost executors
and tells the next join how large the frontier is: a small one is broadcast, so the links stay where they are, a large one is shuffled.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograph.operators.reports import role
from lograph.session import written


class Walk(NamedTuple):
    """``seen``: arn, depth, via; ``links``: arn, next in walking direction; ``inner``: arn, head, first, dist of resources inside chains."""

    seen: DataFrame
    links: DataFrame
    inner: DataFrame
    rounds: int


def _degrees(links: DataFrame) -> DataFrame:
    ends = links.select("arn", F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(
        links.select(F.col("next").alias("arn"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return ends.groupBy("arn").agg(F.sum("out").alias("n_out"), F.sum("in").alias("n_in"))


def _chains(live: DataFrame, starts: DataFrame) -> tuple[DataFrame, int]:
    """Resources inside chains: ``head`` before the chain, ``first`` of the chain, ``dist`` from the head; and the rounds it took.

    A ring that nothing enters is left out.
    """
    inside = _degrees(live).where("n_in = 1 and n_out = 1").join(starts, "arn", "left_anti").select("arn")
    before = live.select(F.col("next").alias("arn"), F.col("arn").alias("head")).join(inside, "arn")
    heads = inside.select(F.col("arn").alias("head"), F.lit(False).alias("ends"))
    pointers = before.join(heads, "head", "left").select(
        "arn", "head", F.col("arn").alias("first"), F.lit(1).cast("bigint").alias("dist"), F.coalesce("ends", F.lit(True)).alias("done"))
    pointers, rounds, settled = written(pointers, "chains"), 0, -1
    while True:
        now = pointers.agg(F.count_if("done").alias("done"), F.count(F.lit(1)).alias("all")).first()
        if now["done"] in (now["all"], settled):
            return pointers.where("done").drop("done"), rounds
        settled, rounds = now["done"], rounds + 1
        ahead = pointers.select(F.col("arn").alias("head"), *[F.col(c).alias(f"{c}2") for c in ("head", "first", "dist", "done")])
        moved = pointers.where("not done").join(ahead, "head").select(
            "arn", F.col("head2").alias("head"), F.col("first2").alias("first"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("done2").alias("done"))
        pointers = written(pointers.where("done").unionByName(moved), "chains")


def _walk(edges: DataFrame, starts: DataFrame, max_hops: int | None, reverse: bool) -> Walk:
    near, far = ("target_arn", "source_arn") if reverse else ("source_arn", "target_arn")
    links = written(edges.select(F.col(near).alias("arn"), F.col(far).alias("next")).where("arn is not null and next is not null").distinct(), "links")
    starts = written(starts.select("arn").where("arn is not null").distinct(), "starts")
    hops = links.where("arn <> next")
    around = written(_degrees(hops), "degrees")
    entered = around.where("n_in > 0").select("arn").unionByName(starts).distinct()
    live = hops.join(entered, "arn", "left_semi").join(around.where("n_out > 0").select(F.col("arn").alias("next")), "next", "left_semi")
    live = written(live.select("arn", "next"), "live")
    inner, rounds = _chains(live, starts)
    inside = inner.select("arn", "head", "dist", F.lit(True).alias("inside"))
    # A link from a resource inside a chain starts at the head; a link into one is no link of its own.
    short = live.join(inner.select(F.col("arn").alias("next")), "next", "left_anti").join(inside, "arn", "left").select(
        F.coalesce("head", "arn").alias("arn"), "next", (F.coalesce("dist", F.lit(0)) + 1).alias("hops"))
    short = written(short.groupBy("arn", "next").agg(F.min("hops").alias("hops")), "short")
    frontier = written(starts.select("arn", F.lit(0).cast("bigint").alias("depth")), "frontier")
    best = frontier
    while not frontier.isEmpty():
        rounds += 1
        step = short.join(frontier, "arn").select(F.col("next").alias("arn"), (F.col("depth") + F.col("hops")).alias("depth"))
        step = step.groupBy("arn").agg(F.min("depth").alias("depth"))
        known = best.select(F.col("arn").alias("of"), F.col("depth").alias("at"))
        nearer = step.join(known, (F.col("arn") == F.col("of")) & (F.col("at") <= F.col("depth")), "left_anti")
        frontier = written(nearer if max_hops is None else nearer.where(F.col("depth") <= max_hops), "frontier")
        best = best.unionByName(frontier)
    best = best.groupBy("arn").agg(F.min("depth").alias("depth"))
    passed = inner.join(best.select(F.col("arn").alias("head"), F.col("depth").alias("at")), "head").select("arn", (F.col("at") + F.col("dist")).alias("depth"))
    found = best.unionByName(passed)
    ends = hops.join(found, "arn").join(around.where("n_out = 0").select(F.col("arn").alias("next")), "next", "left_semi")
    ends = ends.groupBy(F.col("next").alias("arn")).agg((F.min("depth") + 1).alias("depth")).join(starts, "arn", "left_anti")
    found = found.unionByName(ends)
    found = written(found if max_hops is None else found.where(F.col("depth") <= max_hops), "found")
    # Of the ways that are as short the one from the smallest resource.
    before = hops.join(found.select("arn", F.col("depth").alias("at")), "arn").join(found.select(F.col("arn").alias("next"), "depth"), "next")
    via = before.where("at + 1 = depth").groupBy(F.col("next").alias("arn")).agg(F.min("arn").alias("via"))
    seen = written(found.join(via, "arn", "left").select("arn", "via", F.col("depth").cast("int").alias("depth")), "seen")
    return Walk(seen, links, inner, rounds)


def reachable(edges: DataFrame, starts: DataFrame, max_hops: int | None = None, reverse: bool = False) -> DataFrame:
    """Resources reached from the starts, with the fewest hops and, on such a path, the smallest predecessor.

    ``starts``: arn. With ``reverse`` the edges are walked from dependency to caller. ``max_hops`` asks for the neighbourhood
    only; without it the walk ends when a hop finds nothing new.
    """
    return _walk(edges, starts, max_hops, reverse).seen


def root_cause_trace(edges: DataFrame, health: DataFrame, surface: str, max_hops: int | None = None) -> DataFrame:
    """Chain from the root cause to the surface error, root first.

    Candidates are the resources in error that the surface depends on, itself included. A root is a
    candidate none of whose own dependencies is in error; in a cycle of errors every candidate counts.
    The deepest root is taken, then the smallest id. ``health``: arn, status.
    """
    spark = edges.sparkSession
    seen, links, inner, _ = _walk(edges, spark.range(1).select(F.lit(surface).alias("arn")), max_hops, reverse=False)
    failing = health.where(F.col("status") == "error").select("arn")
    candidates = seen.join(failing, "arn", "left_semi")
    # Only the links that leave a candidate can clear or blame it.
    blamed = (
        links.where("arn <> next").join(candidates.select("arn"), "arn", "left_semi")
        .join(failing.select(F.col("arn").alias("next")), "next", "left_semi")
        .groupBy("arn").agg(F.lit(True).alias("blamed"))
    )
    ranked = candidates.join(blamed, "arn", "left")
    best = ranked.orderBy(F.col("blamed").asc_nulls_first(), F.desc("depth"), "arn").limit(1).select("arn", "via", "depth").first()
    if best is None:
        return spark.createDataFrame([], "position bigint, arn string, hops_from_surface bigint, role string")
    deepest = best["depth"]
    # Back to the surface, one lookup per link: a chain is passed in one step, and all that lies in it comes with it.
    steps, passed, here = [], [], best
    while True:
        chain = inner.where(F.col("arn") == here["arn"]).first()
        if chain:
            passed.append((chain["first"], chain["dist"], here["depth"] - chain["dist"]))
            before = chain["head"]
        else:
            steps.append((here["arn"], here["depth"]))
            before = here["via"]
        if before is None:
            break
        here = seen.where(F.col("arn") == before).first()
    inside = spark.createDataFrame(passed, "first string, upto bigint, base int").join(inner, "first").where("dist <= upto")
    chain = spark.createDataFrame(steps, "arn string, depth int").unionByName(inside.select("arn", (F.col("base") + F.col("dist")).cast("int").alias("depth")))
    position = F.lit(deepest) - F.col("depth")
    return chain.select(
        position.cast("bigint").alias("position"), "arn", F.col("depth").cast("bigint").alias("hops_from_surface"),
        role(position, F.lit(deepest + 1)).alias("role"),
    )


def affected_resources(edges: DataFrame, root: str, max_hops: int | None = None) -> DataFrame:
    """Resources that depend on the root, directly or not, with their distance."""
    start = edges.sparkSession.range(1).select(F.lit(root).alias("arn"))
    return reachable(edges, start, max_hops, reverse=True).where("depth > 0").select(
        "arn", F.col("depth").cast("bigint").alias("hops")
    )
