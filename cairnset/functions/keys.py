"""Key functions: hash, shard, and the order of keys as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARDS = 32


def key_text(df: DataFrame, keys: Sequence[str]) -> Column:
    """Keys joined by slashes, as Python writes them: True and False for booleans."""
    kinds = {f.name: f.dataType for f in df.schema}

    def one(name: str) -> Column:
        return F.initcap(F.col(name).cast("string")) if isinstance(kinds[name], T.BooleanType) else F.col(name).cast("string")

    return F.concat_ws("/", *map(one, keys))


def key_hash(df: DataFrame, keys: Sequence[str]) -> Column:
    """SHA-256 of the key's text, in hex. For names only: keys that hold slashes may share a hash."""
    return F.sha2(key_text(df, keys), 256)


def shard(hashed: Column, shards: int = SHARDS) -> Column:
    """The hash as a number, modulo the shards (a power of two up to 256, so the last byte decides)."""
    return (F.conv(F.right(hashed, F.lit(2)), 16, 10).cast("int") % shards).cast("int")


def shard_name(dataset: str, hashed: Column) -> Column:
    return F.format_string("%s_shard%02d", F.lit(dataset), shard(hashed))


def lexicographic(df: DataFrame, split: str, keys: Sequence[str]) -> Column:
    """Sorts as `split//k1/k2` does as text: 10 before 2."""
    return F.concat(F.col(split).cast("string"), F.lit("//"), key_text(df, keys))
