import random

import pytest
from pyspark.sql import functions as F

from lograph.operators.running import numbered, with_running


@pytest.mark.parametrize("block_rows", [1, 3, 1000])
def test_running_values_match_a_loop_with_one_hot_key(spark, block_rows):
    rng = random.Random(block_rows)
    rows = [(i, "hot" if rng.random() < 0.6 else f"k{rng.randrange(4)}", rng.choice([None, 0, 1, 2, 3])) for i in range(120)]
    frame = spark.createDataFrame(rows, "seq bigint, k string, v bigint")
    v = F.col("v")
    got = with_running(frame, ["k"], ["seq"], {"s": ("sum", v), "m": ("max", v), "l": ("last", v)}, block_rows)
    want, seen = [], {}
    for seq, k, value in rows:
        total, top, last = seen.get(k, (0, None, None))
        want.append((seq, total, top, last))
        if value is not None:
            seen[k] = (total + value, value if top is None else max(top, value), value)
        else:
            seen[k] = (total, top, last)
    assert sorted(got.select("seq", "s", "m", "l").collect()) == want


def test_position_breaks_ties_inside_a_row(spark):
    frame = spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (2, 0, "a")], "seq bigint, pos int, k string")
    got = with_running(frame, ["k"], ["seq", "pos"], {"n": ("sum", F.lit(1))}, 1)
    assert sorted(got.select("seq", "pos", "n").collect()) == [(1, 0, 0), (1, 1, 1), (2, 0, 2)]


@pytest.mark.parametrize("block_rows", [1, 4, 1000])
def test_numbers_are_dense_and_ordered(spark, block_rows):
    rng = random.Random(7)
    rows = [(rng.randrange(60), f"x{i}") for i in range(50)]
    got = numbered(spark.createDataFrame(rows, "seq bigint, name string"), ["seq", "name"], "n", block_rows)
    assert [(r["seq"], r["name"]) for r in got.orderBy("n").collect()] == sorted(rows)
    assert [r["n"] for r in got.orderBy("n").collect()] == list(range(50))


def test_scratch_is_the_applications_own_and_can_be_cleared(spark):
    from lograph import session

    path = session.scratch_path(spark, "t")
    assert spark.sparkContext.applicationId in path and path != session.scratch_path(spark, "t")
    kept = session.scratch_root
    session.scratch_root = lambda s: path
    try:
        spark.range(3).write.parquet(f"{path}/rows")
        session.clear_scratch(spark)
    finally:
        session.scratch_root = kept
    from lograph.sources.snapshots import read_or_empty
    assert read_or_empty(spark, f"{path}/rows", "id bigint").count() == 0
