"""Session settings and the shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # A repeated JSON key keeps its last value, as the common JSON readers do.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Hot join keys are split at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows go to Python by bytes, not by number: texts may be long.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    # Sessions of a key are merged in each task before they are shuffled.
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    # Stream state lives on local disk with change logs in the checkpoint, not on the heap.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set what the operators rely on. The values stay set: a returned DataFrame runs later."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def build_session(app: str = "lograph", master: str | None = None, **conf: str) -> SparkSession:
    """A configured session; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return configure(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder that every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it gets a temporary folder of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lograph-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables, inside the shared folder."""
    return f"{shared_folder(spark)}/lograph-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables. Results that were not written yet can be read no more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Paths of the tables written in each open scope, the innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def written(frame: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The same rows as a table in the shared folder: computed once for all that read it after.

    Inside a :func:`scratch_scope` the table is deleted at the end of the scope; with ``keep`` at the end of the scope around that one.
    """
    spark = frame.sparkSession
    path = scratch_path(spark, name)
    scopes = _SCOPES.get()
    if len(scopes) > keep:
        scopes[-1 - keep].append(path)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """What is written inside and not kept is deleted at the end: what still reads it must have been written by then."""
    outer = _SCOPES.get()
    paths: list[str] = []
    token = _SCOPES.set((*outer, paths))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        free_shuffles(spark)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more; it waits for the garbage collector."""
    gc.collect()
    spark._jvm.System.gc()
