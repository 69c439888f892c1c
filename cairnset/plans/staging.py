"""Staged rows: appended over time, the last of each key wins when they are committed."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import DatasetError
from ..functions import keys as K
from ..layout import DatasetID, Layout
from ..operators import frames
from ..operators.positions import job, with_position
from ..schema import DatasetSchema, dumps
from ..sources import files
from .persist import SPLIT, from_rows, persist
from .scratch import Scratch

SEQUENCE = "_seq"


def staged_path(layout: Layout, id: DatasetID) -> str:
    return f"{layout.temporary(id)}/rows"


def stage(df: DataFrame, id: DatasetID, schema: DatasetSchema, layout: Layout, sequence: int | None = None) -> None:
    """Append rows (split and the schema's columns). Later sequences win; by default, the time in microseconds.

    Each call writes a folder of its own and then renames it, so any number of writers may work at once, and a reader sees whole
    batches only.
    """
    sequence = time.time_ns() // 1000 if sequence is None else sequence
    df = frames.enforce(frames.conform(df, schema, (SPLIT,)), schema)
    df = df.withColumn(SEQUENCE, F.lit(sequence).cast("long"))
    own = uuid.uuid4().hex
    df.write.parquet(f"{layout.temporary(id)}/pending/{own}")
    files.rename(df.sparkSession, f"{layout.temporary(id)}/pending/{own}", f"{staged_path(layout, id)}/{own}")
    state_schema(df.sparkSession, id, schema, layout)


def state_schema(spark: SparkSession, id: DatasetID, schema: DatasetSchema, layout: Layout) -> None:
    """Write the staged rows' schema, if none is there."""
    path = f"{layout.temporary(id)}/schema.json"
    if not files.exists(spark, path):
        files.publish_text(spark, path, dumps(schema))


def staged(spark: SparkSession, id: DatasetID, layout: Layout) -> DataFrame:
    if not files.exists(spark, staged_path(layout, id)):
        raise DatasetError(f"{id} has no staged rows")
    return spark.read.option("recursiveFileLookup", "true").parquet(staged_path(layout, id))


def latest(df: DataFrame, keys: list[str], order: list[Any]) -> DataFrame:
    """The last row of each key by `order`, which should tell rows of a key apart. One shuffle; each task first keeps its own best rows."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() if isinstance(c, str) else c for c in order]))
    return df.withColumn("_nth", nth).where("_nth = 1").drop("_nth")


def upserted(spark: SparkSession, id: DatasetID, schema: DatasetSchema, layout: Layout) -> DataFrame:
    rows = staged(spark, id, layout)
    tie = F.xxhash64(*[F.col(n) for n in schema.names]).desc()
    return latest(rows, [SPLIT, *schema.primary_keys], [SEQUENCE, tie]).drop(SEQUENCE)


def commit(spark: SparkSession, id: DatasetID, schema: DatasetSchema, layout: Layout, **options: Any) -> dict[str, int]:
    """Persist the staged rows as a version, then drop them."""
    counts = persist(upserted(spark, id, schema, layout), id, schema, layout, **options)
    files.delete(spark, layout.temporary(id))
    return counts


def scan_sorted(df: DataFrame, keys: list[str], split: str = SPLIT, lexicographic: bool = False) -> DataFrame:
    """Rows in order of split and keys: typed, or as the text split//k1/k2 (10 before 2)."""
    return df.orderBy(K.lexicographic(df, split, keys)) if lexicographic else df.orderBy(split, *keys)


def jobs(df: DataFrame, keys: list[str], size: int = 16384, split: str = SPLIT) -> DataFrame:
    """df with job_id: runs of at most `size` rows of a split in key order."""
    scratch = Scratch(df.sparkSession, "jobs")
    return with_position(df, split, keys, scratch, "_idx").withColumn("job_id", job(F.col("_idx"), size)).drop("_idx")


def run_jobs(df: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame], result: str, size: int = 16384, split: str = SPLIT) -> DataFrame:
    """(split, job_id, and the columns of result): work() over each job's rows in key order, on the executors.

    result: the columns that work() returns, as DDL. A job has at most `size` rows, so it fits a task. What jobs return is
    gathered by ordering on split and job_id.
    """
    numbered = jobs(df, keys, size, split)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[split].iloc[0], pdf["job_id"].iloc[0]
        out = work(pdf.sort_values([split, *keys]).drop(columns="job_id").reset_index(drop=True))
        out.insert(0, "job_id", at[1])
        out.insert(0, split, at[0])
        return out

    return numbered.groupBy(split, "job_id").applyInPandas(run, f"`{split}` string, job_id long, {result}")


class StagingWriter:
    """Rows one by one: checked at once, staged in batches by a few threads. A context manager; leaving it flushes.

    A full buffer waits while more than `pending` batches are being written. A failed batch raises at the next call.
    """

    def __init__(self, spark: SparkSession, id: DatasetID, schema: DatasetSchema, layout: Layout, buffer: int = 1000, threads: int = 4, pending: int = 8, timeout: float = 300.0):
        self.spark, self.id, self.schema, self.layout = spark, id, schema, layout
        self.buffer, self.timeout = buffer, timeout
        self.rows: list[tuple[str, dict[str, Any]]] = []
        self.pool = ThreadPoolExecutor(threads, thread_name_prefix=f"stage-{uuid.uuid4().hex[:6]}")
        self.slots = threading.BoundedSemaphore(pending)
        self.futures: list[Future] = []
        self.sequence = time.time_ns() // 1000
        state_schema(spark, id, schema, layout)

    def add(self, split: str, row: Mapping[str, Any]) -> None:
        from ..operators.rows import parse

        parse(row, self.schema)
        self.rows.append((split, dict(row)))
        if len(self.rows) >= self.buffer:
            self._submit()

    def _submit(self) -> None:
        for f in [f for f in self.futures if f.done()]:
            self.futures.remove(f)
            f.result()
        if not self.rows:
            return
        if not self.slots.acquire(timeout=self.timeout):
            raise DatasetError(f"no batch of staged rows was written in {self.timeout} s")
        rows, self.rows = self.rows, []
        self.sequence += 1
        sequence = self.sequence

        def run() -> None:
            try:
                # of a key's rows in one batch, the last wins
                last = {(s, *(r[k] for k in self.schema.primary_keys)): (s, r) for s, r in rows}
                stage(from_rows(self.spark, last.values(), self.schema), self.id, self.schema, self.layout, sequence)
            finally:
                self.slots.release()

        self.futures.append(self.pool.submit(run))

    def flush(self) -> None:
        self._submit()
        for f in self.futures:
            f.result(self.timeout)
        self.futures.clear()

    def __enter__(self) -> StagingWriter:
        return self

    def __exit__(self, kind: Any, *_: Any) -> None:
        try:
            if kind is None:
                self.flush()
        finally:
            self.pool.shutdown(wait=True)
