import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lograph.operators import search as S

LINES = "file_name string, line_no bigint, line string"


def words(line):
    return [w for w in re.split(r"[^\w]+", (line or "").lower()) if w]


def plain_scores(rows, query):
    files, asked = {}, set(words(query))
    for name, _, line in rows:
        files.setdefault(name, []).extend(words(line))
    average = sum(map(len, files.values())) / len(files)
    counts = {name: Counter(found) for name, found in files.items()}
    out = {}
    for term in asked:
        df = sum(term in c for c in counts.values())
        weight = math.log(1 + (len(files) - df + 0.5) / (df + 0.5))
        for name, c in counts.items():
            if c[term]:
                part = c[term] * (S.K1 + 1) / (c[term] + S.K1 * (1 - S.B + S.B * len(files[name]) / average))
                out[name] = out.get(name, 0) + weight * part
    return out


def plain_hits(rows, query):
    asked, out = words(query), Counter()
    for name, _, line in rows:
        found = words(line)
        out[name] += sum(found[i:i + len(asked)] == asked for i in range(len(found)))
    return {name: n for name, n in out.items() if n}


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """Three batches of files, indexed one after another, the second one twice."""
    rng, root = random.Random(4), str(tmp_path_factory.mktemp("index"))
    vocabulary = [f"w{i}" for i in range(40)] + ["ERROR", "timeout", "disk-full", "été"]
    rows = []
    old, S.BLOCK = S.BLOCK, 4
    for batch in range(3):
        part = []
        for f in range(20):
            weights = [rng.random() ** 3 for _ in vocabulary]
            for n in range(rng.randint(1, 12)):
                part.append((f"b{batch}/f{f}.log", n, " ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 8)))))
        part.append((f"b{batch}/empty.log", 0, None))
        rows += part
        for _ in range(2 if batch == 1 else 1):
            S.index_batch(spark.createDataFrame(part, LINES), root, f"b{batch}")
    yield root, rows
    S.BLOCK = old


@pytest.mark.parametrize("query", ["timeout", "ERROR w3", "disk full w1 w2 w39", "Été w7 w7", "nothing"])
def test_scores_equal_brute_force_with_and_without_skipping(spark, index, query):
    root, rows = index
    want = plain_scores(rows, query)
    got = [(r["file_name"], r["score"]) for r in S.search_files(spark, root, query).collect()]
    assert {n: pytest.approx(s) for n, s in got} == want
    best = sorted(want.items(), key=lambda x: (-x[1], x[0]))
    for top in (1, 5, 200):
        found = [r["score"] for r in S.search_files(spark, root, query, top).collect()]
        assert found == pytest.approx([s for _, s in best[:top]])


def test_blocks_below_the_threshold_are_skipped(spark, index):
    root, rows = index
    postings = S.read_index(spark, root, "postings", S.POSTINGS).where(F.col("term") == "timeout")
    weights = spark.createDataFrame([("timeout", 1.0)], "term string, weight double")
    average = F.lit(20.0)
    worth = S._worth_scoring(postings, weights, average, 1)
    assert 0 < worth.count() < postings.select("batch", "block").distinct().count()


def test_phrases_are_found_by_their_places(spark, index):
    root, rows = index
    for query in ("disk full", "w1 w2", "timeout timeout", "disk full disk"):
        got = {r["file_name"]: r["hits"] for r in S.search_files(spark, root, query, phrase=True).collect()}
        assert got == plain_hits(rows, query)



def test_phrase_of_a_common_word_is_not_counted_in_one_task(spark, tmp_path):
    """The places of a word in every line are not gathered in one task by that word, and a word twice in the query counts twice."""
    rows = [(f"f{i % 50}.log", i, f"from killed from n{i}" if i % 3 else f"from n{i}") for i in range(6000)]
    S.index_batch(spark.createDataFrame(rows, LINES), str(tmp_path), "b")
    found = S.search_files(spark, str(tmp_path), "from killed from", phrase=True).select("file_name", "hits")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" not in plan and "ExistingRDD" not in plan
    assert {r["file_name"]: r["hits"] for r in found.collect()} == plain_hits(rows, "from killed from")
