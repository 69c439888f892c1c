"""URL filters by a sort-merge range join.

A host becomes its labels in reverse, each closed by a dot, so that a rule's host and all its subdomains are
the interval [key, key with '/' for its last dot). Intervals nest or are disjoint. A sweep over the sorted
keys meets a rule's opening, at which the stack is its ancestors' and its own rules, and its closing, at which the
stack is its ancestors'; each url takes the stack of the last such event at or before its key, and of that the
longest rule whose path its own starts with. Urls and events are range-sorted together, each event once; equal keys
are told apart by a number, so a host with a third of all rows is dealt to many ranges. Each range is swept on its own, and
begins with the stack that the last event before it left, of which there is one row for each range. Built-in functions only.

Defined cases: a null url, or one without '://', has an empty host and path and meets no rule; rules with a
null host, path or verdict are ignored; of equal rules, block wins; of rules equally long, that with the
longer host. Repeated rows are judged one by one. Other columns are not read. The rules that are active on one host must
fit a row.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.positions import with_place
from .common import Scratch

STACK = "array<struct<size:int,depth:int,host:string,path:string,verdict:string>>"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    found = F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit(""))
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def key(name: Column) -> Column:
    return F.concat(F.concat_ws(".", F.reverse(F.split(name, "[.]", -1))), F.lit("."))


def sweep_events(rules: DataFrame) -> DataFrame:
    """(key, stack) at each opening and closing of a rule host's interval, from rules (host, path, verdict)."""
    rules = rules.where("host is not null and path is not null and verdict is not null")
    rules = rules.groupBy("host", "path").agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict")).getField("verdict").alias("verdict"))
    own = rules.groupBy("host").agg(F.collect_list(F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("depth"), "host", "path", "verdict")).alias("rules"))
    # a host's ancestors among the rule hosts: itself without 1, 2, ... of its first labels
    labels = F.split("host", "[.]", -1)
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    chain = own.select("host", F.posexplode(tails).alias("up", "of"))
    chain = chain.join(own.select(F.col("host").alias("of"), "rules"), "of")
    stacks = chain.groupBy("host").agg(F.flatten(F.collect_list("rules")).alias("open"), F.flatten(F.collect_list(F.when(F.col("up") > 0, F.col("rules")))).alias("close"))
    k = key(F.col("host"))
    return stacks.select(
        F.explode(F.array(F.struct(k.alias("key"), F.col("open").alias("stack")), F.struct(F.concat(F.substring(k, F.lit(1), F.length(k) - 1), F.lit("/")).alias("key"), F.col("close").alias("stack")))).alias("e")
    ).select("e.key", "e.stack")


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", columns: tuple[str, ...] = ("page_id",), scratch: Scratch | None = None) -> DataFrame:
    """The named columns of pages with host, path, rule and verdict; rules has host, path and verdict."""
    scratch = (scratch or Scratch(pages.sparkSession, "urls")).inner("sweep")
    urls = pages.select(F.struct(*columns).alias("own"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    urls = urls.select("*", key(F.col("host")).alias("key"), F.lit(1).alias("url"), F.xxhash64(F.monotonically_increasing_id()).alias("nth"), F.lit(None).cast(STACK).alias("stack"))
    events = sweep_events(rules).select("key", F.lit(0).alias("url"), F.lit(0).cast("long").alias("nth"), F.col("stack").cast(STACK).alias("stack"))
    by = ["key", "url", "nth"]
    placed = scratch.save(with_place(urls.unionByName(events, allowMissingColumns=True).repartitionByRange(*by).sortWithinPartitions(*by)), "placed")
    # a row for each range: what the ranges before it leave
    left = placed.groupBy("_part").agg(F.max_by("stack", F.when(F.col("url") == 0, F.col("_place"))).alias("left"))
    left = left.select(F.col("_part").alias("_p"), F.last("left", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    sweep = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = placed.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("url = 1").join(left, F.col("_part") == F.col("_p"))
    fits = F.filter(F.coalesce("active", "carried"), lambda r: F.startswith(F.col("path"), r["path"]))
    swept = swept.select("own", "host", "path", F.array_max(fits).alias("best"))
    return swept.select("own.*", "host", "path", F.concat("best.host", "best.path").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))
