"""What the operators share: word splitting and hashing, local and distributed components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import Scratch


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of texts that a Python worker handles before it gives rows back, about.
PART = 2 << 20


def parts(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about PART bytes of a column of texts, or one row that is longer; at the end memory is given back."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // PART)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
            if b > a:
                yield batch.slice(int(a), int(b - a))
    tidy()


def tidy() -> None:
    """Give freed memory back to the system: workers wait for further tasks and would else hold what their largest one took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def free(name: str, taken: Iterable[str]) -> str:
    """The name, or with underscores after it, if columns have it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def prefix(taken: Iterable[str]) -> str:
    """Underscores that no column's name begins with."""
    return "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in taken), default=0))


def col(name: str) -> Column:
    """A column by its whole name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8, A-Z lower-cased; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place where it can."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of runs of n words; the whole sequence as one if it is shorter; none if empty."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    out = np.full(len(hashes) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - n + 1 + k])
    return np.unique(out)


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on an integer key so that both sides are plain exchanges, which adaptive execution can split.

    An aggregate by the key would else be joined where it stands, and one hot key would stay in one task.
    """
    k = F.col(key).bitwiseXOR(F.lit(1))
    return left.withColumn("_k", k).join(right.withColumn("_k", k).drop(key), "_k", how).drop("_k")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), for each node of an edge.

    Alternating large-star and small-star steps until all edges lead to roots. Every step is an aggregate
    with partial results and a join that adaptive execution can split, so a node that half of all edges
    share is no bottleneck. Only a counter comes to the driver.
    """
    e = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        # a forest of stars: no node has two parents, and no parent has one
        twice = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        if not twice.unionAll(e.select("v").distinct().join(e.select("u"), F.col("v") == F.col("u"), "left_semi")).limit(1).count():
            break
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = spread_join(both, both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "u")
        large = large.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, e = e, scratch.save(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        scratch.drop(before)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def forest(n: int, neighbours) -> np.ndarray:
    """Labels 0..n-1 -> label of its component's first member; neighbours(p, rest) gives those of rest that p links with.

    Each member is a pivot once, against those that no component has yet.
    """
    label, rest = np.full(n, -1, np.int64), np.arange(n)
    for start in range(n):
        if label[start] >= 0:
            continue
        label[start] = start
        rest = rest[rest != start]
        queue = [start]
        while queue and len(rest):
            hit = neighbours(queue.pop(), rest)
            if hit.any():
                label[rest[hit]] = start
                queue.extend(rest[hit].tolist())
                rest = rest[~hit]
    return label
