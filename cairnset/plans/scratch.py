"""Intermediate tables in the folder that all executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from ..errors import DatasetError
from ..sources.files import delete

#: Bytes of one batch of rows that goes to a Python worker, about: a batch of long texts would else take a worker's memory.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@cache
def _own_folder() -> str:
    """For sessions of one machine that name no shared folder, as in tests."""
    return "file://" + tempfile.mkdtemp(prefix="cairnset-")


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of one's own only where all executors are threads of this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise DatasetError(f"spark.checkpoint.dir must name a folder that all executors share; the master is {master}")
    return _own_folder()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Plans made in it send batches of at most BATCH_BYTES to Python, unless the session asks for smaller ones."""
    before = spark.conf.get(_BATCH)
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


class Scratch:
    """save() writes a table and reads it back, which cuts its lineage; drop(), keep() and close() remove what was written.

    A lost executor then costs a read, not a recomputation.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.tables: dict[str, DataFrame] = {}

    def inner(self, name: str) -> Scratch:
        """A part of it with tables of its own, for what shall not touch its owner's."""
        out = object.__new__(Scratch)
        out.spark, out.root, out.tables = self.spark, f"{self.root}/{name}-{uuid.uuid4().hex[:8]}", {}
        return out

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        with small_batches(self.spark):
            df.write.parquet(path)
        out = self.tables[path] = self.spark.read.schema(df.schema).parquet(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path in [p for p, t in self.tables.items() if any(t is x for x in tables)]:
            delete(self.spark, path)
            del self.tables[path]

    def keep(self, *tables: DataFrame) -> None:
        """Drop all tables but these."""
        self.drop(*(t for t in self.tables.values() if not any(t is x for x in tables)))

    def close(self) -> None:
        delete(self.spark, self.root)
        self.tables.clear()
