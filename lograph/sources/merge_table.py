"""A stored table with one row per key that is only added to: runs in hash buckets, with Bloom filters, merged from time to time.

A batch of rows (new keys, or new states of known ones) becomes a run, and of all rows of a key the one of the newest version counts.

* **Buckets.** A key's hash gives its bucket. A run has a folder per bucket, sorted by key.
* **Filters.** Each bucket of a run has a Bloom filter, two bytes a key: blocks of 32,768 bits, and all bits of a key lie in one block. A lookup joins
  its keys with the blocks of the buckets that it needs, and reads a bucket of a run only if some key may be in it.
* **Manifests.** A version is a small file that lists its runs. It is made by one exclusive create, after its run is written, so a lost job leaves
  nothing half-read behind, and of two writers of one version the second is told so and runs again.
* **Merges.** ``fan`` runs of one level become one run of the next. A table of ``n`` batches has at most ``fan`` runs on each of ``log(n)`` levels, and a
  row is rewritten once per level. A merge that is lost changes nothing.
* **Old versions.** The last ``keep`` versions stay, and those that a lease of a reader names; runs that none of them lists are deleted.

A stream names itself with each batch: a batch that is in the table already adds nothing. The file system needs an exclusive create.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lograph.session import written
from lograph.sources import store_files as S

#: Bits of a filter's block (what Spark's bitmap functions take), bits per key, and hashes per key.
BLOCK_BITS, KEY_BITS, HASHES = 1 << 15, 16, 6
VERSION = "version"


@dataclass
class MergeTable:
    """The table in a folder. ``schema`` has the key and the further columns.

    A new table takes the number of ``buckets`` given (one for every few gigabytes it will hold), a stored one keeps its schema, key and buckets.
    """

    spark: SparkSession
    root: str
    schema: str = ""
    key: str = ""
    buckets: int = 16
    fan: int = 4
    keep: int = 16
    columns: list[str] = field(init=False)

    def __post_init__(self) -> None:
        stored = self.manifest()
        if stored["version"]:
            self.schema, self.key, self.buckets = stored["schema"], stored["key"], stored["buckets"]
        self.columns = self.spark.createDataFrame([], self.schema).columns

    # Versions

    def manifest(self, version: int | None = None) -> dict:
        """The newest version that is whole, or the given one; version 0 is the empty table."""
        for name in reversed(S.names(self.spark, f"{self.root}/log")):
            if version is None or name == f"{version:020d}.json":
                try:
                    return json.loads(S.read(self.spark, f"{self.root}/log/{name}"))
                except json.JSONDecodeError:
                    continue  # its writer has not ended
        return {"version": 0, "schema": self.schema, "key": self.key, "buckets": self.buckets, "runs": [], "streams": {}}

    def commit(self, manifest: dict, **changes) -> int:
        """The version after ``manifest``, with the given changes."""
        version = manifest["version"] + 1
        text = json.dumps({**manifest, **changes, "version": version})
        if not S.create(self.spark, f"{self.root}/log/{version:020d}.json", text):
            raise RuntimeError(f"another writer made version {version} of {self.root}; run the batch again")
        return version

    @contextmanager
    def lease(self) -> Iterator[dict]:
        """The newest version, whose runs stay as long as the lease is held."""
        there = lambda version: f"{version:020d}.json" in S.names(self.spark, f"{self.root}/log")
        with S.lease(self.spark, self.root, lambda: self.manifest()["version"], there) as version:
            yield self.manifest(version)

    def vacuum(self) -> None:
        """Delete versions that are neither among the last ``keep`` nor leased, and runs that no version left lists.

        A run whose writer has not committed is younger than all versions, and stays.
        """
        leased = S.leased(self.spark, self.root)
        versions = [int(n.split(".")[0]) for n in S.names(self.spark, f"{self.root}/log") if n.endswith(".json")]
        gone = [v for v in versions[:-self.keep] if v not in leased]
        if not gone:
            return
        live = {run["name"] for v in versions if v not in gone for run in self.manifest(v)["runs"]}
        for version in gone:
            S.delete(self.spark, f"{self.root}/log/{version:020d}.json")
        for name in S.names(self.spark, f"{self.root}/runs"):
            run = name.removeprefix("run=")
            if run not in live and int(run.split("-")[0]) <= max(gone):
                S.delete(self.spark, f"{self.root}/runs/{name}")
                S.delete(self.spark, f"{self.root}/filters/{name}")

    # Writing

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def write_run(self, rows: DataFrame, version: int, level: int) -> list[dict]:
        """Write rows (with their version) as a run; its entry for the manifest, or nothing if there are no rows."""
        name = f"{version:020d}-{uuid.uuid4().hex}"
        path = f"{self.root}/runs/run={name}"
        dealt = rows.withColumn("bucket", self.bucket()).repartition("bucket").sortWithinPartitions("bucket", self.key)
        dealt.write.partitionBy("bucket").parquet(path)
        written_rows = self.spark.read.schema(f"{self.schema}, {VERSION} bigint, bucket int").parquet(path)
        n = written_rows.count()
        if not n:
            return []
        blocks = max(1, -(-n * KEY_BITS // (self.buckets * BLOCK_BITS)))
        spots = written_rows.select("bucket", block_of(self.key, F.lit(blocks)).alias("block"), F.explode(bits_of(self.key)).alias("bit"))
        spots.groupBy("bucket", "block").agg(F.bitmap_construct_agg("bit").alias("bits")).repartition("bucket").write.partitionBy("bucket").parquet(
            f"{self.root}/filters/run={name}")
        return [{"name": name, "level": level, "rows": n, "blocks": blocks}]

    def append(self, rows: DataFrame, stream: str | None = None, batch: int | None = None, known: dict | None = None) -> int:
        """Add rows as the newest ones of their keys (one row per key); returns the version. Merges what is due.

        A ``batch`` of a ``stream`` that the table has is not added again. ``known`` is the version that the rows were made from: if another
        writer was faster, nothing is added.
        """
        known = known or self.manifest()
        if stream in known["streams"] and known["streams"][stream] >= batch:
            return known["version"]
        version = known["version"] + 1
        run = self.write_run(rows.select(*self.columns).withColumn(VERSION, F.lit(version).cast("bigint")), version, 0)
        streams = known["streams"] if stream is None else {**known["streams"], stream: batch}
        self.commit(known, runs=[*known["runs"], *run], streams=streams)
        return self.merge()

    def merge(self) -> int:
        """Merge levels that are full; returns the version."""
        while True:
            known = self.manifest()
            levels: dict[int, list[dict]] = {}
            for run in known["runs"]:
                levels.setdefault(run["level"], []).append(run)
            full = [level for level, runs in sorted(levels.items()) if len(runs) >= self.fan]
            if not full:
                self.vacuum()
                return known["version"]
            old = levels[full[0]]
            rows = self.stored(old).repartition("bucket")
            merged = self.write_run(newest(rows, ["bucket", self.key]).drop("bucket"), known["version"] + 1, full[0] + 1)
            names = {run["name"] for run in old}
            self.commit(known, runs=[*[run for run in known["runs"] if run["name"] not in names], *merged])

    # Reading

    def stored(self, runs: list[dict], pairs: list[tuple[str, int]] | None = None) -> DataFrame:
        """All rows of runs, or of the given buckets of runs only, with ``version``, ``run`` and ``bucket``."""
        schema = f"{self.schema}, {VERSION} bigint, run string, bucket int"
        folder = f"{self.root}/runs"
        paths = [f"{folder}/run={run['name']}" for run in runs] if pairs is None else [f"{folder}/run={run}/bucket={b}" for run, b in pairs]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", folder).parquet(*paths)

    def newest(self, manifest: dict | None = None) -> DataFrame:
        """The row of each key. A table of one run needs no shuffle."""
        runs = (manifest or self.manifest())["runs"]
        rows = self.stored(runs)
        return (rows if len(runs) < 2 else newest(rows, [self.key])).select(*self.columns)

    def where(self, condition: Column, manifest: dict | None = None) -> DataFrame:
        """Keys whose newest row meets a condition. The condition goes to the scan; only keys with such a row are looked up."""
        manifest = manifest or self.manifest()
        hits = self.stored(manifest["runs"]).where(condition).select(self.key)
        return self.lookup(hits, manifest).where(condition)

    def lookup(self, keys: DataFrame, manifest: dict | None = None) -> DataFrame:
        """The newest rows of the keys that the table has. ``keys`` has the key column; repeats do not matter."""
        runs = (manifest or self.manifest())["runs"]
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        maybe, pairs = self.places(keys, runs)
        rows = self.stored(runs, pairs).join(maybe.select(self.key).distinct(), self.key)
        return newest(rows, [self.key]).select(*self.columns)

    def places(self, keys: DataFrame, runs: list[dict]) -> tuple[DataFrame, list[tuple[str, int]]]:
        """Which keys may be in which bucket of which run, by the filters; and those buckets. One entry per bucket of a run comes to the driver at most."""
        asked = written(keys.select(self.key).where(F.col(self.key).isNotNull()).distinct().withColumn("bucket", self.bucket()), "asked")
        touched = [r["bucket"] for r in asked.select("bucket").distinct().collect()]
        blocks = F.create_map(*[F.lit(x) for run in runs for x in (run["name"], run["blocks"])])
        probes = asked.withColumn("run", F.explode(F.array(*[F.lit(run["name"]) for run in runs])))
        probes = probes.withColumn("block", block_of(self.key, blocks[F.col("run")]))
        filters = self.spark.read.schema("block bigint, bits binary, run string, bucket int").option("basePath", f"{self.root}/filters").parquet(
            *[f"{self.root}/filters/run={run['name']}" for run in runs]).where(F.col("bucket").isin(touched))
        maybe = probes.join(filters, ["run", "bucket", "block"]).where(F.forall(bits_of(self.key), lambda bit: has_bit(F.col("bits"), bit)))
        maybe = written(maybe.select(self.key, "run", "bucket"), "maybe")
        return maybe, [(r["run"], r["bucket"]) for r in maybe.select("run", "bucket").distinct().collect()]


def is_stored(spark: SparkSession, root: str) -> bool:
    """Whether a folder holds such a table."""
    return bool(S.names(spark, f"{root}/log"))


def schema_of(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the row of the newest version, with that version."""
    rest = [c for c in rows.columns if c not in (*keys, "run", "bucket")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), VERSION).alias("row")).select(*keys, *[F.col("row")[c].alias(c) for c in rest])


def block_of(key: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), blocks).cast("bigint")


def bits_of(key: str) -> Column:
    """The bits of a key in its block."""
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(2 + i)), F.lit(BLOCK_BITS)).cast("bigint") for i in range(HASHES)])


def has_bit(bits: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.get(F.array(*[F.lit(1 << i) for i in range(8)]), (bit % 8).cast("int")).bitwiseAND(byte) != 0
