"""DataFrames against a schema: columns and types on the driver, nulls by expressions in the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError
from ..schema import DatasetSchema, Field, loose


def conform(df: DataFrame, schema: DatasetSchema, extra: tuple[str, ...] = ()) -> DataFrame:
    """df's columns in schema order after `extra`; unset optional ones null. Missing, further and ill-typed columns are errors."""
    have = {f.name: f.dataType for f in df.schema}
    if missing := [f.name for f in schema.fields if f.required and f.name not in have]:
        raise SchemaError(f"Error at path : Example missing keys {missing}")
    if more := [n for n in have if n not in schema.by_name and n not in extra]:
        raise SchemaError(f"Error at path : columns that the schema lacks: {more}")
    for f in schema.fields:
        if f.name in have and loose(have[f.name]) != loose(f.spark_type()):
            raise SchemaError(f"Error at path {f.name}: expected {f.spark_type().simpleString()}, got {have[f.name].simpleString()}")
    return df.select(*(F.col(f"`{n}`") for n in extra), *(F.col(f.name) if f.name in have else F.lit(None).cast(f.spark_type()).alias(f.name) for f in schema.fields))


def _bad(f: Field, value: Column, path: str) -> list[tuple[str, Column]]:
    """(path, condition) of each null that f forbids in value or below it; conditions are never null."""
    out = [(path, value.isNull())] if f.required else []
    if f.kind == "record":
        for g in f.fields:
            out += [(p, value.isNotNull() & c) for p, c in _bad(g, value[g.name], f"{path}.{g.name}")]
    elif f.kind == "array":
        for i, p in enumerate(_paths(f.element, f"{path}.elem")):
            out.append((p, F.coalesce(F.exists(value, _nth(f.element, i)), F.lit(False))))
    return out


def _paths(f: Field, path: str) -> list[str]:
    """The paths of _bad(), in its order."""
    below = [x for g in f.fields for x in _paths(g, f"{path}.{g.name}")] if f.kind == "record" else _paths(f.element, f"{path}.elem") if f.kind == "array" else []
    return [path] * f.required + below


def _nth(f: Field, i: int):
    """The i-th condition as a function of an array's element."""
    return lambda x: _bad(f, x, "")[i][1]


def violations(df: DataFrame, schema: DatasetSchema) -> DataFrame:
    """(path, nulls) for each place where the schema forbids null, counted in one pass."""
    places = [x for f in schema.fields for x in _bad(f, F.col(f.name), f.name)]
    if not places:
        return df.sparkSession.createDataFrame([], "path string, nulls long")
    counts = df.agg(*(F.count_if(c).alias(str(i)) for i, (_, c) in enumerate(places)))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(p).alias("path"), F.col(str(i)).alias("nulls")) for i, (p, _) in enumerate(places)))).alias("x")).select("x.path", "x.nulls")


def _bytes(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value).cast("long"), F.lit(0))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.aggregate(value, F.lit(0).cast("long"), lambda total, x: total + 8 + _bytes(x, kind.elementType)), F.lit(0))
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind), F.lit(0).cast("long"))
    return F.lit(8).cast("long")


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values, about."""
    return sum((_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(0).cast("long"))


def enforce(df: DataFrame, schema: DatasetSchema) -> DataFrame:
    """df, whose evaluation fails at a null that the schema forbids. No pass of its own."""
    checked = {}
    for f in schema.fields:
        out = F.col(f.name)
        for path, bad in reversed(_bad(f, F.col(f.name), f.name)):
            out = F.when(bad, F.raise_error(F.lit(f"Error at path {path}: null in a required field"))).otherwise(out)
        checked[f.name] = out
    return df.withColumns(checked)
