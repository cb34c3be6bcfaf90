"""Ranked search over log files: an inverted index with positions, extended batch by batch, BM25 scores, and blocks that are skipped by their maxima.

A batch of logs becomes three tables under the index folder, each with a folder per batch: ``files`` (number and length of each file),
``postings`` (per term and block of ``BLOCK`` files: which of them hold it how often, with the most occurrences and the least length), and ``places`` (where
in a file a term stands, a row per stretch of lines). Postings and places lie in hash buckets of terms, so a query reads the buckets of its terms.
A file is in one batch; a batch that is indexed again replaces itself.

A query for the best files first scores the blocks with the greatest bounds (the sum of the best scores that each term can have there). The worst
of the best files so far is then a threshold: no other block below it is scored. The result is the same as that of scoring all.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lograph.operators.running import positioned
from lograph.session import written

BLOCK, STRETCH, BUCKETS = 128, 4096, 32
#: BM25: how fast occurrences saturate, how much length counts.
K1, B = 1.2, 0.75
WORD_BREAK = r"[^\p{L}\p{N}_]+"
FILES = "file_no bigint, file_name string, length bigint, batch string"
POSTINGS = "term string, block bigint, entries array<struct<file_no:bigint,times:bigint,length:bigint>>, most bigint, shortest bigint, batch string, bucket int"
PLACES = "term string, file_no bigint, places array<struct<line_no:bigint,at:int>>, batch string, bucket int"


def words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(line, F.lit(""))), WORD_BREAK), "")


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def index_batch(lines: DataFrame, root: str, batch: str) -> None:
    """Index the lines (file_name, line_no, line) of files that no other batch has. ``line_no`` is unique in a file."""
    def put(rows: DataFrame, name: str) -> None:
        kept = rows.withColumn("bucket", bucket_of(F.col("term"))) if "term" in rows.columns else rows
        kept = kept.repartition("bucket").sortWithinPartitions("bucket", "term") if "term" in rows.columns else kept
        writer = kept.write.mode("overwrite")
        (writer.partitionBy("bucket") if "term" in rows.columns else writer).parquet(f"{root}/{name}/batch={batch}")

    there = lines.select("file_name", "line_no", F.posexplode(words(F.col("line"))).alias("at", "term"))
    counts = written(there.groupBy("file_name", "term").agg(F.count(F.lit(1)).alias("times")), "counts")
    lengths = lines.select("file_name").distinct().join(
        counts.groupBy("file_name").agg(F.sum("times").alias("length")), "file_name", "left").withColumn("length", F.coalesce("length", F.lit(0)))
    files = positioned(lengths, ["file_name"], "file_no")
    put(files.select("file_no", "file_name", "length"), "files")
    found = counts.join(files, "file_name").withColumn("block", F.expr(f"file_no div {BLOCK}"))
    entry = F.struct("file_no", "times", "length")
    put(found.groupBy("term", "block").agg(
        F.array_sort(F.collect_list(entry)).alias("entries"), F.max("times").alias("most"), F.min("length").alias("shortest")), "postings")
    stretched = there.join(files.select("file_name", "file_no"), "file_name").withColumn("stretch", F.expr(f"line_no div {STRETCH}"))
    put(stretched.groupBy("term", "file_no", "stretch").agg(
        F.array_sort(F.collect_list(F.struct("line_no", F.col("at").cast("int").alias("at")))).alias("places")).drop("stretch"), "places")


def read_index(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("basePath", f"{root}/{name}").parquet(f"{root}/{name}")


def query_terms(query: str) -> list[str]:
    """The words of a query, in order, as :func:`words` finds them in lines."""
    return [w for w in re.split(r"[^\w]+", query.lower()) if w]


def _part(times: Column, length: Column, average: Column) -> Column:
    """What a term adds to the score of a file, but for its weight."""
    return times * (K1 + 1) / (times + K1 * (1 - B + B * length / average))


def _scored(blocks: DataFrame, weights: DataFrame, average: Column) -> DataFrame:
    """Score of every file of the given blocks of postings."""
    rows = blocks.select("batch", "term", F.inline("entries")).join(weights, "term")
    return rows.groupBy("batch", "file_no").agg(F.sum(F.col("weight") * _part(F.col("times"), F.col("length"), average)).alias("score"))


def search_files(spark: SparkSession, root: str, query: str, top: int | None = None, phrase: bool = False) -> DataFrame:
    """``file_name`` and BM25 ``score`` of the files that hold a word of the query, best first; with ``top`` only so many.

    With ``phrase`` the words must follow each other in a line, and ``hits`` counts how often they do; files without are left out.
    """
    asked = query_terms(query)
    terms = sorted(set(asked))
    files = read_index(spark, root, "files", FILES)
    buckets = spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term"))).distinct()
    held = F.col("bucket").isin([r[0] for r in buckets.collect()]) & F.col("term").isin(terms)
    postings = read_index(spark, root, "postings", POSTINGS).where(held)
    total = files.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("average")).first()
    n, average = F.lit(float(total["n"])), F.lit(total["average"] or 1.0)
    df = postings.groupBy("term").agg(F.sum(F.size("entries")).alias("df"))
    weights = written(df.select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("weight")), "weights")
    names = files.select("batch", "file_no", "file_name")
    if phrase:
        places = read_index(spark, root, "places", PLACES).where(held).select("batch", "term", "file_no", F.inline("places"))
        # Where each term stands in the query, looked up row by row: a join on the term would put all places of a common term into one task.
        order = F.create_map(*[x for t in terms for x in (F.lit(t), F.array(*[F.lit(i) for i, a in enumerate(asked) if a == t]))])
        starts = places.select("batch", "file_no", "line_no", "at", F.explode(order[F.col("term")]).alias("nth")).groupBy(
            "batch", "file_no", "line_no", (F.col("at") - F.col("nth")).alias("start")).agg(F.count(F.lit(1)).alias("there"))
        hits = starts.where(F.col("there") == len(asked)).groupBy("batch", "file_no").agg(F.count(F.lit(1)).alias("hits"))
        ranked = _scored(postings, weights, average).join(hits, ["batch", "file_no"]).join(names, ["batch", "file_no"]).select("file_name", "score", "hits")
    else:
        if top is not None:
            postings = postings.join(_worth_scoring(postings, weights, average, top), ["batch", "block"])
        ranked = _scored(postings, weights, average).join(names, ["batch", "file_no"]).select("file_name", "score")
    ordered = ranked.orderBy(F.desc("score"), "file_name")
    return ordered if top is None else ordered.limit(top)


def _worth_scoring(postings: DataFrame, weights: DataFrame, average: Column, top: int) -> DataFrame:
    """Blocks (batch, block) that may hold one of the best files."""
    best = F.col("weight") * _part(F.col("most"), F.col("shortest"), average)
    # A little above the sum: it must not fall below a score by the order in which numbers are added.
    bounds = written(postings.join(weights, "term").groupBy("batch", "block").agg((F.sum(best) * (1 + 1e-9)).alias("bound")), "bounds")
    first = bounds.orderBy(F.desc("bound"), "batch", "block").limit(max(4, 2 * -(-top // BLOCK))).select("batch", "block")
    scores = _scored(postings.join(first, ["batch", "block"]), weights, average).orderBy(F.desc("score")).limit(top)
    worst = scores.agg(F.when(F.count(F.lit(1)) == top, F.min("score")).alias("worst"))
    return bounds.where(F.col("bound") >= F.coalesce(worst.scalar(), F.lit(0.0))).select("batch", "block")
