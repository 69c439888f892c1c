"""Positions of rows in key order, jobs, and blob file layout.

A window over a whole split would put it into one task. Instead rows are range-partitioned by (split, keys), sorted in
their partitions and written; a row's position is its place in its partition plus the rows of its split in the
partitions before, which is a table of one row per partition and split.

Rows with long values are dealt by bytes, not by their number: their keys and sizes are put in order first, and the keys at
which another TASK_BYTES begin cut the rows into partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import Scratch

_PLACE = (1 << 33) - 1  # monotonically_increasing_id: the partition above bit 33, the row in it below
#: Bytes of the rows that a task gets where they are dealt by bytes, about; a row is never cut, so a task has that and one row at most.
TASK_BYTES = 64 << 20
#: What a row weighs beside its bytes there, so that a task gets a million rows at most.
ROW_BYTES = 67


def key_ordered(df: DataFrame, split: str, keys: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Rows range-partitioned and sorted by (split, keys)."""
    by = [split, *keys]
    return (df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)).sortWithinPartitions(*by)


def with_place(ordered: DataFrame) -> DataFrame:
    """With _part and _place, the partition and the row in it; to be written before it is used twice."""
    return ordered.withColumn("_id", F.monotonically_increasing_id()).select("*", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(_PLACE).alias("_place")).drop("_id")


def starts(placed: DataFrame, split: str, measures: Sequence[str] = ()) -> DataFrame:
    """For each (split, _part): _shift, to be added to _place for the position; before_m, the sum of each measure before."""
    per = placed.groupBy(split, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"), *(F.sum(m).alias(f"_sum_{m}") for m in measures))
    before = Window.partitionBy(split).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = (F.coalesce(F.sum(f"_sum_{m}").over(before), F.lit(0)).alias(f"before_{m}") for m in measures)
    return per.select(F.col(split).alias("_split"), F.col("_part").alias("_p"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), *sums)


def numbered(placed: DataFrame, split: str, index: str = "_idx") -> DataFrame:
    """placed (already written) with each row's position in its split."""
    s = starts(placed, split)
    return placed.join(s, (F.col(split) == F.col("_split")) & (F.col("_part") == F.col("_p"))).withColumn(index, F.col("_place") + F.col("_shift")).drop("_split", "_p", "_shift", "_part", "_place")


def cuts(placed: DataFrame, split: str, keys: Sequence[str], weight: Column, task: int, may: Column | None = None) -> list[Row]:
    """Keys at which rows are cut into runs that weigh `task` and a row at most; a row for each run but the first comes to the driver.

    placed: keys and sizes, already written. may: whether a run may begin at the row, if it isn't one of the key before; a run
    then ends at the next such row.
    """
    by = [split, *keys]
    may = F.lit(True) if may is None else may & ~F.lag(F.struct(*by)).over(Window.partitionBy("_part").orderBy("_place")).eqNullSafe(F.struct(*by))
    p = placed.select(*by, "_part", "_place", weight.cast("long").alias("_w"), may.alias("_may"), F.lit(0).alias("_all"))
    within = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("_within", F.coalesce(F.sum("_w").over(within), F.lit(0)))
    p = p.where("_may").join(starts(p.drop("_within"), "_all", ["_w"]), F.col("_part") == F.col("_p"))
    run = F.floor((F.col("_within") + F.col("before__w")) / F.lit(task))
    firsts = p.groupBy(run.alias("_run")).agg(F.min(F.struct(*by)).alias("_first")).where("_run > 0")
    return [r[0] for r in firsts.orderBy("_run").select("_first").collect()]


def dealt(df: DataFrame, split: str, keys: Sequence[str], cut: Sequence[Row]) -> DataFrame:
    """Rows sorted by (split, keys) in partitions that begin at the keys of cuts(), in order. Each row finds its own by bisection."""
    by = [split, *keys]
    part = F.lit(0)
    if cut:
        literals = F.array(*(F.struct(*(F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(by, row))) for row in cut))
        own = F.struct(*by)
        halves = F.array(*(F.lit(1 << i) for i in reversed(range(len(cut).bit_length()))))
        part = F.aggregate(halves, part, lambda at, step: F.when(F.get(literals, at + step - 1) <= own, at + step).otherwise(at))
    return df.repartitionById(len(cut) + 1, part).sortWithinPartitions(*by)


def with_position(df: DataFrame, split: str, keys: Sequence[str], scratch: Scratch, index: str = "_idx", partitions: int | None = None) -> DataFrame:
    """df with each row's position in its split, from 0, in key order."""
    return numbered(scratch.save(with_place(key_ordered(df, split, keys, partitions)), "placed"), split, index)


def job(position: Column, rows: int = 16384) -> Column:
    """Number of the job that a row belongs to, in its split."""
    return F.floor(position / F.lit(rows)).cast("long")


def blob_layout(df: DataFrame, split: str, keys: Sequence[str], sizes: Column, rows: int, scratch: Scratch) -> DataFrame:
    """df with file_no, offset and size: blob files of so many rows, in key order, as one writer lays them out.

    A file's rows may lie in several partitions, so offsets are differences of sums over the whole split: the sum before the
    row less that before its file's first row.
    """
    placed = scratch.save(with_place(key_ordered(df.withColumn("size", sizes), split, keys)), "placed")
    within = Window.partitionBy(split, "_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    s = starts(placed, split, ["size"])
    out = placed.join(s, (F.col(split) == F.col("_split")) & (F.col("_part") == F.col("_p")))
    out = out.withColumn("_idx", F.col("_place") + F.col("_shift")).withColumn("_total", F.col("_before") + F.col("before_size"))
    out = out.withColumn("file_no", job(F.col("_idx"), rows))
    first = F.min("_total").over(Window.partitionBy(split, "file_no"))
    return out.withColumn("offset", (F.col("_total") - first).cast("long")).drop("_split", "_p", "_shift", "before_size", "_part", "_place", "_before", "_total", "_idx")


def _passages(sizes: np.ndarray, limit: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """What a writer does with these rows, for each number of bytes that its open file may have before: bytes; at, closed, open.

    The first row with at >= limit less the open bytes closes that file; closed is the files closed then until the last row, open
    the bytes in the file left open, -1 if none is. There are as many entries as rows with bytes in the first `limit` bytes.
    """
    ends, n = np.cumsum(sizes), len(sizes)
    i = np.flatnonzero(sizes[: np.searchsorted(ends, limit) + 1])
    at, j, closed, going = ends[i], i + 1, np.ones(len(i), np.int64), np.arange(len(i))
    while len(going := going[j[going] < n]):
        last = np.searchsorted(ends, ends[j[going] - 1] + limit)
        going, last = going[last < n], last[last < n]
        closed[going] += 1
        j[going] = last + 1
    return int(ends[-1]), at, closed, np.where(j == n, -1, ends[-1] - ends[j - 1])


def _files(sizes: np.ndarray, limit: int, opened: int, closed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """file_no, offset and whether the file's first row, of rows before which `closed` files were closed and one has `opened` bytes (-1: none)."""
    ends, n, before = np.cumsum(sizes), len(sizes), max(opened, 0)
    firsts, at = [0] if opened < 0 else [], limit - before
    while (j := int(np.searchsorted(ends, at)) + 1) < n:
        firsts.append(j)
        at = ends[j - 1] + limit
    first = np.zeros(n, bool)
    first[firsts] = True
    begun, starts_at = np.cumsum(first), ends - sizes
    base = np.concatenate([[-before], starts_at[firsts]]).astype(np.int64)
    return closed + begun - (opened < 0), starts_at - base[begun], first


def rolled(placed: DataFrame, split: str, size: str, limit: int) -> DataFrame:
    """placed (already written) with file_no, offset and _first: blob files closed once they have `limit` bytes, as one writer a split makes them.

    Where a file begins depends on all rows before. But a partition's rows lead from the bytes in the open file to others in few ways,
    which are found for all partitions at once; one pass over these per split tells what each partition begins with.
    """
    kind = placed.schema[split].dataType.simpleString()
    sizes = lambda t: t.column(size).fill_null(0).to_numpy().astype(np.int64)

    def passages(t: pa.Table) -> pa.Table:
        total, *ways = _passages(sizes(t.sort_by("_place")), limit)
        return pa.table([t.column(split)[:1], t.column("_part")[:1], pa.array([total], pa.int64()), *(pa.array([w], pa.list_(pa.int64())) for w in ways)], ["_split", "_part", "_total", "_at", "_closed", "_open"])

    def entries(t: pa.Table) -> pa.Table:
        t, opened, closed, out = t.sort_by("_part"), -1, 0, []
        for i in range(t.num_rows):
            out.append((opened, closed))
            at, before = t.column("_at")[i].values.to_numpy(), max(opened, 0)
            if (k := int(np.searchsorted(at, limit - before))) < len(at):
                closed, opened = closed + t.column("_closed")[i].values[k].as_py(), t.column("_open")[i].values[k].as_py()
            else:
                opened = before + t.column("_total")[i].as_py()
        return pa.table([t.column("_split"), t.column("_part"), *(pa.array(x, pa.int64()) for x in zip(*out))], ["_split", "_part", "_open", "_closed"])

    def lay(t: pa.Table, entry: pa.Table) -> pa.Table:
        t = t.sort_by("_place")
        for name, values in zip(("file_no", "offset", "_first"), _files(sizes(t), limit, entry.column("_open")[0].as_py(), entry.column("_closed")[0].as_py())):
            t = t.append_column(name, pa.array(values))
        return t

    per = placed.select(split, "_part", "_place", size).groupBy(split, "_part").applyInArrow(passages, f"_split {kind}, _part long, _total long, _at array<long>, _closed array<long>, _open array<long>")
    begins = per.groupBy("_split").applyInArrow(entries, f"_split {kind}, _part long, _open long, _closed long")
    out = T.StructType([*(T.StructField(f.name, f.dataType) for f in placed.schema), T.StructField("file_no", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("_first", T.BooleanType())])
    return placed.groupBy(split, "_part").cogroup(begins.groupBy("_split", "_part")).applyInArrow(lay, out)


def rows_per_file(average: Column, target: int = 256_000_000, least: int = 16) -> Column:
    """Rows of a blob file of about `target` bytes; `least` where values have no size."""
    return F.when(average > 0, F.greatest(F.lit(least), F.floor(F.lit(float(target)) / average))).otherwise(F.lit(least)).cast("long")
