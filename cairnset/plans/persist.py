"""Persisting a dataset: validate, check keys, sort, move blobs, write an index per split, then schema and marker."""

from __future__ import annotations

import uuid
from abc import ABC, abstractmethod
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DatasetError
from ..layout import DatasetID, Layout, check_split
from ..operators import blobs, frames, positions, rows
from ..schema import DatasetSchema, dumps
from ..sources import files

SPLIT = "split"
INDEX = "_idx"
#: Rows of a task at most, about; positions.TASK_BYTES bounds their bytes. Also rows of a partition of keys and sizes.
ROWS_PER_PARTITION = 1_000_000


def from_rows(spark: SparkSession, examples: Iterable[tuple[str, dict[str, Any]]], schema: DatasetSchema) -> DataFrame:
    """(split, dict) rows as a DataFrame, each checked against the schema and its objects encoded. For what fits the driver."""
    data = [(split, *rows.parse(row, schema).values()) for split, row in examples]
    return spark.createDataFrame(data, T.StructType([T.StructField(SPLIT, T.StringType(), False), *schema.struct()]))


def from_rdd(spark: SparkSession, rdd: Any, schema: DatasetSchema) -> DataFrame:
    """An RDD of (split, dict) as a DataFrame; checked and encoded on the executors."""
    struct = T.StructType([T.StructField(SPLIT, T.StringType(), False), *schema.struct()])
    return spark.createDataFrame(rdd.map(lambda x: (x[0], *rows.parse(x[1], schema).values())), struct)


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., n) for keys of several rows; _n if a key is named n. One shuffle with partial counts; only the keys are read."""
    n = "_n" if "n" in keys else "n"
    return df.groupBy(*keys).agg(F.count("*").alias(n)).where(F.col(n) > 1)


def refuse_repeated(df: DataFrame, keys: Sequence[str]) -> None:
    if again := repeated_keys(df, keys).limit(3).collect():
        raise DatasetError(f"keys of several rows, among them {[tuple(r)[:-1] for r in again]}")


def key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows and distinct_keys."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_keys"))


def split_counts(df: DataFrame, split: str = SPLIT) -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("n"))


def persist(
    source: DataFrame | Iterable[tuple[str, dict[str, Any]]],
    id: DatasetID,
    schema: DatasetSchema,
    layout: Layout,
    mode: str = "error",
    split: str = SPLIT,
    blob_rows: int | None = 50,
    blob_bytes: int | None = None,
    rows_per_partition: int = ROWS_PER_PARTITION,
    bytes_per_partition: int = positions.TASK_BYTES,
    spark: SparkSession | None = None,
) -> dict[str, int]:
    """Write a version of a dataset; rows per split.

    source: a DataFrame with the schema's columns and `split`, or (split, dict) rows. mode: error or overwrite, if
    the version exists. Nothing of the version is visible before its keys are checked and its rows are written.
    A task gets rows_per_partition rows and bytes_per_partition bytes at most, and one row.
    """
    if mode not in ("error", "overwrite"):
        raise ValueError(f"mode is error or overwrite, not {mode!r}")
    spark = spark or (source.sparkSession if isinstance(source, DataFrame) else SparkSession.active())
    if files.exists(spark, layout.schema(id)) and mode == "error":
        raise DatasetError(f"{id} exists; mode='overwrite' replaces it")
    df = source if isinstance(source, DataFrame) else from_rows(spark, source, schema)
    if split != SPLIT:
        df = df.withColumnRenamed(split, SPLIT)
    df = frames.enforce(frames.conform(df, schema, (SPLIT,)), schema)
    keys = [SPLIT, *schema.primary_keys]

    attempt = f"{layout.temporary(id)}/persist-{uuid.uuid4().hex}"
    try:
        sized = _written(df.select(*keys, frames.row_bytes(df).alias("_bytes")), f"{attempt}/sized")
        total, most = sized.groupBy(*keys).agg(F.count("*").alias("_n")).agg(F.sum("_n"), F.max("_n")).first()
        if most and most > 1:  # before blobs are written
            refuse_repeated(sized, keys)
        placed = positions.with_place(positions.key_ordered(sized, SPLIT, schema.primary_keys, (total or 0) // ROWS_PER_PARTITION + 1))
        share = -(-bytes_per_partition // rows_per_partition)  # so that no task gets more than rows_per_partition rows
        cut = positions.cuts(_written(placed, f"{attempt}/keys"), SPLIT, schema.primary_keys, F.col("_bytes") + share, bytes_per_partition)
        counts = _write(df, schema, layout, id, attempt, blob_rows, blob_bytes, cut)
        if files.exists(spark, layout.dataset(id)):
            files.delete(spark, layout.success(id))
            for old in files.children(spark, layout.dataset(id)):
                if old.endswith(".parquet"):
                    files.delete(spark, f"{layout.dataset(id)}/{old}")
        for name in counts:
            files.rename(spark, f"{attempt}/{name}.parquet", layout.split(id, name))
        files.write_text(spark, layout.schema(id), dumps(schema))
        files.write_text(spark, layout.success(id), "")
    finally:
        files.delete(spark, attempt)
    return counts


class Persistor(ABC):
    """What an extension for another way to write versions implements."""

    @abstractmethod
    def persist(self, source: DataFrame | Iterable[tuple[str, dict[str, Any]]], id: DatasetID, schema: DatasetSchema, layout: Layout, **options: Any) -> dict[str, int]:
        """Write a version; rows per split."""


class SparkPersistor(Persistor):
    def __init__(self, spark: SparkSession):
        self.spark = spark

    def persist(self, source: DataFrame | Iterable[tuple[str, dict[str, Any]]], id: DatasetID, schema: DatasetSchema, layout: Layout, **options: Any) -> dict[str, int]:
        return persist(source, id, schema, layout, spark=self.spark, **options)


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _write(df: DataFrame, schema: DatasetSchema, layout: Layout, id: DatasetID, attempt: str, blob_rows: int | None, blob_bytes: int | None, cut: list[Row]) -> dict[str, int]:
    ordered = positions.dealt(df, SPLIT, schema.primary_keys, cut)
    if schema.blob_columns:  # each value is read once, here, and only its pointer goes on
        ordered = blobs.write_blobs(ordered, schema.blob_columns, layout.blobs(id.name), SPLIT, blob_rows, blob_bytes)
    placed = _written(positions.with_place(ordered), f"{attempt}/placed")
    refuse_repeated(placed, [SPLIT, *schema.primary_keys])  # again, on what was written: the source may give other rows each time
    counts = {check_split(r[SPLIT]): r.n for r in split_counts(placed).orderBy(SPLIT).collect()}  # a row for each split
    indexed = positions.numbered(placed, SPLIT, INDEX)
    for name in counts:
        indexed.where(F.col(SPLIT) == name).drop(SPLIT).select(INDEX, *schema.names).write.option("compression", "zstd").parquet(f"{attempt}/{name}.parquet")
    return counts
