"""Reading a split of a dataset: a lazy DataFrame, and rows by position."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..errors import DatasetError
from ..functions import pointers
from ..layout import DatasetID, Layout
from ..operators.blobs import resolve
from ..operators.filters import compile_filter
from ..operators.rows import load
from ..schema import DatasetSchema, loads, loose
from .files import exists, read_text, total_bytes

INDEX = "_idx"
#: Positions in a range whose matches are counted when a filtered dataset is looked up by position.
RANGE = 1 << 16


class Dataset:
    """One split. Filters apply before positions, so position i is that of the i-th row that passes."""

    def __init__(self, spark: SparkSession, layout: Layout, id: DatasetID, split: str, columns: Sequence[str] | None = None, filters: Any = None, raw: bool = False, cache: str | None = None):
        """cache: a folder of each executor that blob files are copied to before they are read, for repeated look-ups."""
        self.cache = cache
        self.spark, self.layout, self.id, self.split_name, self.raw = spark, layout, id, split, raw
        self.path = layout.split(id, split)
        if not exists(spark, self.path):
            raise DatasetError(f"{id} has no split {split!r}")
        self.full_schema = loads(read_text(spark, layout.schema(id)), raw=raw)
        if columns is not None and (unknown := [c for c in columns if c not in self.full_schema.by_name]):
            raise DatasetError(f"{id} has no columns {unknown}")
        self.columns = [n for n in self.full_schema.names if columns is None or n in columns]
        self.filter = None if filters is None else compile_filter(filters)
        self._length: int | None = None

    @property
    def schema(self) -> DatasetSchema:
        return self.full_schema

    def index(self) -> DataFrame:
        """The stored index with declared types; older files may hold wider ones, and have no positions."""
        stored = self.spark.read.parquet(self.path)
        have = set(stored.columns)
        own = [F.col(f.name).cast(loose(f.spark_type())).alias(f.name) if f.name in have else F.lit(None).cast(loose(f.spark_type())).alias(f.name) for f in self.full_schema.fields]
        return stored.select(*([F.col(INDEX)] if INDEX in have else []), *own)

    def pointers(self) -> DataFrame:
        """Filtered and projected rows with blob pointers unresolved, and positions if stored."""
        df = self.index()
        if self.filter is not None:
            df = df.where(self.filter)
        return df.select(*[c for c in df.columns if c == INDEX], *self.columns)

    def _resolved(self, df: DataFrame) -> DataFrame:
        return resolve(df, [c for c in self.full_schema.blob_columns if c in self.columns], self.layout.blobs(self.id.name), self.cache)

    @property
    def df(self) -> DataFrame:
        """Lazy: filter, projection and casts reach the scan; blobs of selected columns are read last."""
        return self._resolved(self.pointers().select(*self.columns))

    def metadata(self) -> DataFrame:
        """The columns that are not in blob files."""
        return self.pointers().select(*[c for c in self.columns if c in self.full_schema.plain_columns])

    def arrow_table(self):
        return self.df.toArrow()

    def __len__(self) -> int:
        if self._length is None:
            rows = self.index()
            self._length = (rows if self.filter is None else rows.where(self.filter)).count()
        return self._length

    def _positioned(self) -> DataFrame:
        """Pointers with stored positions; for older files, key order decides."""
        df = self.pointers()
        if INDEX in df.columns:
            return df
        from ..operators.positions import with_position
        from ..plans.scratch import Scratch

        ordered = self.index() if self.filter is None else self.index().where(self.filter)
        numbered = with_position(ordered.withColumn("_all", F.lit(0)), "_all", list(self.full_schema.primary_keys), Scratch(self.spark, "positions"), INDEX)
        return numbered.select(INDEX, *self.columns)

    def slice(self, start: int, stop: int) -> DataFrame:
        """Rows at positions start to stop - 1, with _idx; order by it if order matters.

        Without a filter this is a range on the stored position, which the scan prunes by. With one, matches are
        counted for each range of stored positions, so that only the ranges that hold the wanted rows are ranked.
        """
        df = self._positioned()
        if self.filter is not None and INDEX in self.pointers().columns:
            df = self._ranked(df, start, stop)
        return self._resolved(df.where((F.col(INDEX) >= start) & (F.col(INDEX) < stop)))

    def _ranked(self, df: DataFrame, start: int, stop: int) -> DataFrame:
        from pyspark.sql import Window

        counts = df.groupBy(F.floor(F.col(INDEX) / RANGE).alias("_range")).agg(F.count("*").alias("_n"))
        before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.withColumn("_before", F.coalesce(before, F.lit(0))).where((F.col("_before") < stop) & (F.col("_before") + F.col("_n") > start))
        rows = df.withColumn("_range", F.floor(F.col(INDEX) / RANGE)).join(counts, "_range")
        nth = F.row_number().over(Window.partitionBy("_range").orderBy(INDEX)) - 1 + F.col("_before")
        return rows.withColumn(INDEX, nth).select(INDEX, *self.columns)

    def __getitem__(self, i: int) -> dict[str, Any]:
        """Row i, with objects decoded; negative positions count from the end."""
        if i < 0:
            i += len(self)
        found = self.slice(i, i + 1).drop(INDEX).collect() if i >= 0 else []
        if not found:
            raise IndexError(i)
        return load(found[0].asDict(recursive=True), self.full_schema)

    def rows(self) -> Iterator[dict[str, Any]]:
        """All rows in order, decoded, a partition at a time."""
        ordered = self._positioned().orderBy(INDEX)
        for r in self._resolved(ordered).drop(INDEX).toLocalIterator():
            yield load(r.asDict(recursive=True), self.full_schema)

    def size(self) -> int:
        """Bytes of the split's index files and of the blob files that any of its rows refers to."""
        return total_bytes(self.spark, self.path) + self.blob_bytes()

    def blob_bytes(self) -> int:
        columns = self.full_schema.blob_columns
        folder = self.layout.blobs(self.id.name)
        if not columns or not exists(self.spark, folder):
            return 0
        refers = self.index().select(F.explode(F.array(*columns)).alias("p")).where("p is not null").select(pointers.unpack(F.col("p")).getField("file_id").alias("file_id")).distinct()
        lengths = self.spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file_id"), "length")
        return lengths.join(refers, "file_id", "left_semi").agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]

    def join(self, other: Dataset, how: str = "inner") -> DataFrame:
        """An extension: the two datasets' rows with equal primary keys; further columns of other that clash get its name as prefix."""
        keys = list(self.full_schema.primary_keys)
        if keys != list(other.full_schema.primary_keys):
            raise DatasetError(f"different primary keys: {keys} and {list(other.full_schema.primary_keys)}")
        right = other.df
        for c in set(self.columns) & set(right.columns) - set(keys):
            right = right.withColumnRenamed(c, f"{other.id.name}_{c}")
        return self.df.join(right, keys, how)


def build_dataset(spark: SparkSession, kind: str, name: str, version: str, split: str, store: str = "", columns: Sequence[str] | None = None, raw: bool = False, filters: Any = None, config: Config | None = None) -> Dataset:
    """A split of a dataset in a configured store; kind: object_store or filesystem."""
    config = config or Config.load(spark)
    found = config.store(kind, store)
    if kind == "object_store":
        config.client.apply(spark)
    return Dataset(spark, found.layout(), DatasetID(name, version), split, columns, filters, raw, config.download.folder or None)
