"""File scans: which logs exist, under which reference.

Listing, paging and retries belong to the file system connector; the same scan works on local and on
object storage paths. Spark leaves out empty files and names that begin with ``_`` or ``.``, also for
folders.
"""

from __future__ import annotations

from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lograph.fixed_values import LOG_SUFFIXES
from lograph.functions.arn import reference_id


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Lower-cased suffix with its dot; empty without one."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.](\.[^.]+)$", 1))


def is_log(path: Column, suffixes: list[str] = LOG_SUFFIXES) -> Column:
    """Whether a path names a log, for listings that come as a table."""
    return suffix(path).isin(suffixes) & ~file_name(path).startswith(".")


def any_case(suffixes: list[str]) -> str:
    """File name pattern of the suffixes in upper and lower case, so that listing already leaves others out."""
    names = ["".join(f"[{c.lower()}{c.upper()}]" for c in s[1:]) for s in suffixes]
    return "*.{" + ",".join(names) + "}"


def _binary(spark: SparkSession, root: str | list[str], glob: str, after: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
    if after:
        reader = reader.option("modifiedAfter", after)
    return reader.option("pathGlobFilter", glob).load(root).where(~file_name(F.col("path")).startswith("."))


def scan_files(
    spark: SparkSession, root: str, suffixes: list[str] = LOG_SUFFIXES, glob: str | None = None, after: str | None = None
) -> DataFrame:
    """Metadata of the logs under a folder: path, modificationTime, length. No content is read."""
    return _binary(spark, root, glob or any_case(suffixes), after).select("path", "modificationTime", "length")


def scan_content(
    spark: SparkSession, root: str | list[str], suffixes: list[str] = LOG_SUFFIXES, limit: int | None = None, after: str | None = None
) -> DataFrame:
    """Logs with their bytes. A ``limit``, if asked for, is pushed into the scan, so larger files are never read.

    ``after`` (``2024-01-31T00:00:00``) lets the listing leave out files that did not change since.
    """
    found = _binary(spark, root, any_case(suffixes), after).where("length > 0")
    return found if limit is None else found.where(F.col("length") <= limit)


def qualified(spark: SparkSession, root: str) -> str:
    """The root as the file system spells it in listings."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def plain_path(path: Column) -> Column:
    """A path as listings spell it, out of the encoded form that file metadata has."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def path_groups(files: DataFrame, size: int = 10_000) -> Iterator[list[str]]:
    """Paths of files in groups, for readers that take a list. The driver lists files in any case; it holds no content."""
    group: list[str] = []
    for row in files.select("path").toLocalIterator():
        group.append(row["path"])
        if len(group) == size:
            yield group
            group = []
    if group:
        yield group


def modified_since(files: DataFrame, since: Column) -> DataFrame:
    return files.where(F.col("modificationTime") >= since)


def first_per_name(files: DataFrame) -> DataFrame:
    """Only the first path of each file name. Off by default elsewhere: it drops files."""
    rest = [c for c in files.columns if c != "path"]
    firsts = files.groupBy(file_name(F.col("path")).alias("name")).agg(
        F.min("path").alias("path"), *[F.min_by(c, "path").alias(c) for c in rest]
    )
    return firsts.select(*files.columns)


def log_references(files: DataFrame, source_type: str, identifier: str, region: str = "", prefix: str | None = None) -> DataFrame:
    """References of the files of one source; the key is the path below the source folder.

    A file that does not lie below the folder is an error, since its key would be wrong.
    """
    root = F.lit(qualified(files.sparkSession, identifier) + "/")
    key = F.when(F.startswith("path", root), F.substring(F.col("path"), F.length(root) + 1, F.length("path"))).otherwise(
        F.raise_error(F.concat(F.lit("not below the source folder: "), "path")))
    return files.select(
        F.lit(source_type).alias("source_type"), F.lit(identifier).alias("identifier"), F.lit(region).alias("region"),
        F.lit(prefix).cast("string").alias("prefix"), key.alias("key"),
        F.col("modificationTime").cast("timestamp_ntz").alias("timestamp"), F.col("length").alias("size_bytes"),
        reference_id(F.lit(source_type), F.lit(identifier), key).alias("unique_id"), "path",
    )


def discover(spark: SparkSession, sources: list[dict]) -> tuple[DataFrame, DataFrame]:
    """References over all sources, and a status row per source. An unreachable source stops no other."""
    found, status = [], []
    for source in sources:
        try:
            files = scan_files(spark, source["identifier"], glob=source.get("prefix"))
            found.append(log_references(
                files, source["source_type"], source["identifier"], source.get("region", ""), source.get("prefix")))
            status.append((source["identifier"], True, None))
        except PySparkException as problem:
            status.append((source["identifier"], False, problem.getCondition() or type(problem).__name__))
        except Py4JJavaError as problem:  # what the file system reports: access denied, no answer
            status.append((source["identifier"], False, problem.java_exception.getClass().getName()))
    refs = found[0] if found else None
    for more in found[1:]:
        refs = refs.unionByName(more)
    if refs is None:
        from lograph.schemas import LOG_REFS
        refs = spark.createDataFrame([], LOG_REFS)
    return refs, spark.createDataFrame(status, "identifier string, reachable boolean, problem string")
