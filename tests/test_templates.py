import random

from pyspark.sql import functions as F

from lograph.operators import templates as T

LINES = "file_name string, line string"


def test_templates_keep_what_all_lines_of_a_leaf_share(spark):
    lines = spark.createDataFrame([
        ("a", "user bob logged in from 10.0.0.1"), ("a", "user amy logged in from 10.0.0.2"), ("b", "user amy logged  in from host"),
        ("b", "ERROR disk 7 full"), ("b", "ERROR disk 9 full"), ("b", ""), ("c", None), ("c", " \t "), ("c", "one")], LINES)
    got = {r["template"]: (r["lines"], r["files"], r["wildcards"], r["error_lines"]) for r in T.mined_templates(lines, 1).collect()}
    assert got == {"user <*> logged in from <*>": (3, 2, 2, 0), "ERROR disk # full": (2, 1, 0, 2), "": (3, 2, 0, 0), "one": (1, 1, 0, 0)}
    deep = {r["template"] for r in T.mined_templates(lines, 2).collect()}
    assert deep == {"user bob logged in from #.#.#.#", "user amy logged in from <*>", "ERROR disk # full", "", "one"}
    assert T.mined_templates(lines.limit(0)).count() == 0


def test_templates_do_not_depend_on_how_lines_are_dealt(spark):
    rng = random.Random(2)
    rows = [(f"f{rng.randrange(5)}", " ".join(rng.choice(["a", "b", "7", "x-1", "é"]) for _ in range(rng.randint(0, 5)))) for _ in range(400)]
    lines = spark.createDataFrame(rows, LINES)
    one = sorted(map(tuple, T.mined_templates(lines.coalesce(1)).collect()))
    rng.shuffle(rows)
    assert sorted(map(tuple, T.mined_templates(spark.createDataFrame(rows, LINES).repartition(13)).collect())) == one
    assert sum(r[5] for r in one) == 400
    mined = T.mined_templates(lines)
    digest = T.template_digest(lines, mined)
    assert digest.where("template is null").count() == 0 and digest.agg(F.sum("lines")).first()[0] == 400
