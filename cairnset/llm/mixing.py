"""Mixing sources to target weights.

Tokens (words) are summed per source; targets follow by water-filling; each document is emitted
floor(rate) times, and once more if a hash-seeded coin falls below the fraction. The coin is the document's
own, so reruns and any partitioning agree.

Defined cases: a null text has size 0; null is a source of its own, last; a source of size 0 has target and
rate 0; equal rows share a coin, and a null doc_id is hashed as an empty string. If every source is capped,
each takes its cap. Other columns pass through mix() unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, col, free

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"


def coin(doc_id: Column) -> Column:
    """Uniform in [0, 1), from 13 hex digits of an MD5."""
    text = F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)


def targets(sizes: DataFrame, weights: list[int], cap: int) -> DataFrame:
    """(source, source_size, target) from (source, size): shares of all sizes by repeated weights, at most cap * source_size.

    Sources are few: one row each after the aggregate. In the order of cap * size / weight the capped
    sources come first; a source is capped if the total, less the caps before it, shared among it and those
    after it by weight, exceeds its cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("n", n)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod("n", F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("most", F.col("source_size") * cap)
    everyone = Window.partitionBy()
    order = Window.orderBy((F.col("most").cast("double") / F.col("weight")), "n").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", F.sum("source_size").over(everyone))
    per = per.withColumn("left", F.col("total") - F.coalesce(F.sum("most").over(order), F.lit(0)))
    per = per.withColumn("shared", F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(order), F.lit(0)))
    # integers, so that the test is exact; once one is not capped, none after it is
    per = per.withColumn("capped", F.col("weight").cast("decimal(38,0)") * F.col("left") >= F.col("most").cast("decimal(38,0)") * F.col("shared"))
    free_left, free_weight = F.max(F.when(~F.col("capped"), F.col("left"))).over(everyone), F.max(F.when(~F.col("capped"), F.col("shared"))).over(everyone)
    target = F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.col("weight").cast("double") * free_left.cast("double") / free_weight.cast("double"))
    return per.select("source", "source_size", target.alias("target"))


def rates(docs: DataFrame, scratch: Scratch, weights: list[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, copies), one for each document."""
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = scratch.save(sized, "sized")
    # written, so that its size is known: small enough it is broadcast, else joined by exchanges that can be split
    goal = scratch.save(targets(sized, list(weights), cap), "targets")
    out = sized.join(goal.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    return out.withColumn("copies", copies("doc_id"))


def copies(doc_id: str) -> Column:
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return F.floor(rate) + F.when(coin(F.col(doc_id)) < rate - F.floor(rate), 1).otherwise(0)


def mix(docs: DataFrame, scratch: Scratch, weights: list[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """The mixed corpus: docs' rows, each as often as it is taken."""
    sized = scratch.save(docs.select("source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sized")
    goal = scratch.save(targets(sized, list(weights), cap), "targets")
    of, share = free("of", docs.columns), free("share", docs.columns)
    goal = goal.select(F.col("source").alias(of), F.struct("source_size", "target").alias(share))
    out = docs.join(goal, F.col("source").eqNullSafe(F.col(of)))
    rate = F.when(F.col(share)["source_size"] > 0, F.col(share)["target"] / F.col(share)["source_size"]).otherwise(0.0)
    n = F.floor(rate) + F.when(coin(F.col("doc_id")) < rate - F.floor(rate), 1).otherwise(0)
    out = out.withColumn(free("copy", out.columns), F.explode(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n))))
    return out.select(*map(col, docs.columns))
