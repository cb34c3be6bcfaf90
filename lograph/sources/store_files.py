"""Small text files of a stored table, through Spark's own file systems: manifests, and leases of the versions that readers hold."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    place, system = _path(spark, folder)
    if not system.exists(place):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(place))


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that must not be there yet; false if it is. Of two writers one gets it."""
    place, system = _path(spark, path)
    try:
        stream = system.create(place, False)
    except Py4JJavaError as problem:
        if "AlreadyExists" in problem.java_exception.getClass().getName() or system.exists(place):
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def read(spark: SparkSession, path: str) -> str:
    place, system = _path(spark, path)
    stream = system.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    place, system = _path(spark, path)
    system.delete(place, True)


@contextmanager
def lease(spark: SparkSession, root: str, newest: Callable[[], int], there: Callable[[int], bool]) -> Iterator[int]:
    """The newest version of a table, which stays as long as the lease is held. Version 0 is the empty table."""
    name = f"{root}/leases/{uuid.uuid4().hex}"
    while True:
        version = newest()
        create(spark, name, str(version))
        # The version may have been dropped between reading and leasing it.
        if not version or there(version):
            break
        delete(spark, name)
    try:
        yield version
    finally:
        delete(spark, name)


def leased(spark: SparkSession, root: str) -> set[int]:
    """Versions that some reader holds. A lease that is not written to its end holds none yet: its reader looks again."""
    held = (read(spark, f"{root}/leases/{name}") for name in names(spark, f"{root}/leases"))
    return {int(text) for text in held if text}
