"""Blob pointers: version (1 byte), file's uuid (16), offset (8, little endian), size (4, little endian)."""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the stored format.
FORMAT, VERSION, SIZE = struct.Struct("<c16sQI"), b"\x01", 29


def pack_value(file_id: uuid.UUID, offset: int, size: int) -> bytes:
    return FORMAT.pack(VERSION, file_id.bytes, offset, size)


def unpack_value(pointer: bytes) -> tuple[uuid.UUID, int, int]:
    version, file_id, offset, size = FORMAT.unpack(pointer)
    if version != VERSION:
        raise ValueError(f"unknown version of a blob pointer: {version!r}")
    return uuid.UUID(bytes=file_id), offset, size


def _little_endian(value: Column, n: int) -> Column:
    digits = F.lpad(F.hex(value.cast("long")), 2 * n, "0")
    return F.unhex(F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n)))))


def pack(file_id: Column, offset: Column, size: Column) -> Column:
    """A pointer from a uuid's text and two numbers, by built-in functions."""
    return F.concat(F.lit(VERSION), F.unhex(F.regexp_replace(file_id, "-", "")), _little_endian(offset, 8), _little_endian(size, 4))


def _number(pointer: Column, at: int, n: int) -> Column:
    swapped = F.concat(*(F.hex(F.substring(pointer, at + i, 1)) for i in reversed(range(n))))
    return F.conv(swapped, 16, 10).cast("long")


def unpack(pointer: Column) -> Column:
    """struct<file_id string, offset long, size long>; null for null; an error for another version or length."""
    digits = F.lower(F.hex(F.substring(pointer, 2, 16)))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    file_id = F.concat_ws("-", *(F.substring(digits, a, n) for a, n in cuts))
    good = (F.octet_length(pointer) == SIZE) & (F.substring(pointer, 1, 1) == F.lit(VERSION))
    parts = F.struct(file_id.alias("file_id"), _number(pointer, 18, 8).alias("offset"), _number(pointer, 26, 4).alias("size"))
    return F.when(pointer.isNull(), F.lit(None)).when(good, parts).otherwise(F.raise_error(F.lit("not a blob pointer of version 1")))
