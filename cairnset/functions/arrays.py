"""Arrays stored as .npy bytes, seen from Spark."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..codecs import NumpyCodec


def decode_npy(data: Column) -> Column:
    """struct<shape array<int>, values array<double>> of .npy bytes, row by row in C order; null for null."""

    @F.pandas_udf("shape array<int>, values array<double>")
    def decoded(column: pd.Series) -> pd.DataFrame:
        codec = NumpyCodec(None, "float64")
        arrays = [None if x is None else codec.decode(bytes(x)) for x in column]
        return pd.DataFrame({"shape": [None if a is None else np.array(a.shape, np.int32) for a in arrays], "values": [None if a is None else a.astype(np.float64).ravel() for a in arrays]})

    return decoded(data)


def encode_npy(values: Column, dtype: str = "float64", shape: tuple[int, ...] | None = None) -> Column:
    """.npy bytes of an array of numbers, reshaped if a shape is given."""

    @F.pandas_udf("binary")
    def encoded(column: pd.Series) -> pd.Series:
        codec = NumpyCodec(shape, dtype)
        return pd.Series([None if x is None else codec.encode(np.asarray(x, dtype).reshape(shape or (len(x),))) for x in column], dtype=object)

    return encoded(values)


def fits_length(values: Column, length: int) -> Column:
    """Whether an array has so many elements, by built-in functions; -1: any."""
    return values.isNotNull() if length == -1 else F.coalesce(F.size(values) == length, F.lit(False))
