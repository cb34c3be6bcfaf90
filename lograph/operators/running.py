"""Running aggregates that hold up when one key owns a large share of the rows.

A plain window over a key puts all rows of that key in one task. Here the order column is cut into
blocks of a bounded number of positions, so a task sees at most one block of one key:

1. aggregate per (key, block), partially before the shuffle;
2. a window over that small table gives each block what came before it;
3. a window inside (key, block) adds what came before the row.

The order column is a list position, unique per input row. :func:`positioned` makes one; positions
that are given (a sequence number, an event id) should be dense, so that blocks are well filled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lograph.session import written

BLOCK = "__block"
BLOCK_ROWS = 1 << 20


def positioned(rows: DataFrame, order: list[str], name: str = "seq") -> DataFrame:
    """Rows with a position that follows ``order``, from a range sort over all tasks.

    The position grows from task to task and counts rows inside a task, so blocks are full. It is
    written once, since a second run of the sort might cut the ranges elsewhere.
    """
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ordered.withColumn(name, F.monotonically_increasing_id()), "positioned")


def with_block(rows: DataFrame, seq: str = "seq", block_rows: int = BLOCK_ROWS) -> DataFrame:
    return rows.withColumn(BLOCK, F.expr(f"{seq} div {block_rows}"))


def latest(value: Column, order: Column) -> Column:
    """Last non-null value by order, as a mergeable aggregate."""
    return F.max_by(value, F.when(value.isNotNull(), order))


def earlier(*keys: str, order: list[str]) -> Window:
    """Rows before the current one."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def with_running(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    values: dict[str, tuple[str, Column]],
    block_rows: int = BLOCK_ROWS,
    base: DataFrame | None = None,
) -> DataFrame:
    """Add, per name, an aggregate over the earlier rows of the same key.

    ``values`` maps a column name to a kind and an expression. Kinds: ``sum`` (0 before the first
    row), ``max`` (null before) and ``last`` (last non-null value). ``order[0]`` is the position.
    ``base`` has one row per key; its columns come along and rows of other keys drop out. It meets
    the block table, so that the rows themselves need no join by key.
    """
    fold = {
        "sum": lambda v: F.sum(v),
        "max": lambda v: F.max(v),
        "last": lambda v: F.last(v, ignorenulls=True),
    }
    where = F.struct(*order)
    blocked = with_block(rows, order[0], block_rows)
    per_block = blocked.groupBy(*keys, BLOCK).agg(
        *[
            (latest(expr, where) if how == "last" else fold[how](expr)).alias(f"__{name}")
            for name, (how, expr) in values.items()
        ]
    )
    before_block = earlier(*keys, order=[BLOCK])
    carried = per_block.select(
        *keys, BLOCK, *[fold[how](F.col(f"__{name}")).over(before_block).alias(f"__{name}") for name, (how, _) in values.items()]
    )
    extra = []
    if base is not None:
        extra = [c for c in base.columns if c not in keys]
        carried = carried.join(base, keys)
    before_row = earlier(*keys, BLOCK, order=order)
    # The window comes first: its sort order also serves the join by (key, block).
    inside = blocked.select("*", *[fold[how](expr).over(before_row).alias(f"__in_{name}") for name, (how, expr) in values.items()])

    def combined(name: str, how: str) -> Column:
        here, carry = F.col(f"__in_{name}"), F.col(f"__{name}")
        if how == "sum":
            return F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))
        return F.greatest(here, carry) if how == "max" else F.coalesce(here, carry)

    return inside.join(carried, [*keys, BLOCK]).select(
        *[F.col(c) for c in [*rows.columns, *extra]], *[combined(name, how).alias(name) for name, (how, _) in values.items()]
    )


def numbered(rows: DataFrame, order: list[str], name: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Number rows from 0 in the given order, without one sort over everything in one task.

    Only the block counts, one row per ``block_rows`` positions, pass through a single task.
    """
    blocked = with_block(rows, order[0], block_rows)
    counts = blocked.groupBy(BLOCK).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(
        BLOCK,
        F.coalesce(
            F.sum("__n").over(Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("__offset"),
    )
    position = F.row_number().over(Window.partitionBy(BLOCK).orderBy(*order)) - 1
    return blocked.join(offsets, BLOCK).select(
        *[F.col(c) for c in rows.columns], (F.col("__offset") + position).cast("bigint").alias(name)
    )
