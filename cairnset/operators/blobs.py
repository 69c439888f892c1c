"""Blob files: values of a column one after another, and pointers to them.

Writing and resolving stream over Arrow batches on the executors. Files are named by a fresh uuid, so a
retried or speculative task never writes to another attempt's file; what a lost attempt leaves is referred to by nothing.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.pointers import pack_value, unpack_value
from ..sources.cache import FileCache, copy_out
from ..sources.files import arrow_options, arrow_store


class BlobWriter:
    """add(column, data) -> pointer. Each column has an open file, closed once it has `rows` rows or `size` bytes or more."""

    def __init__(self, folder: str, rows: int | None = None, size: int | None = None, options: dict | None = None):
        self.store, self.folder = arrow_store(folder, options)
        self.rows, self.size = rows, size
        self.open: dict[str, list] = {}  # column -> [file's uuid, stream, bytes, rows]

    def add(self, column: str, data: bytes | None) -> bytes | None:
        if data is None:
            return None
        f = self.open.get(column)
        if f is None:
            f = self.open[column] = [uuid.uuid4(), None, 0, 0]
        if data and f[1] is None:  # a file of empty values only is never made
            self.store.create_dir(self.folder, recursive=True)
            f[1] = self.store.open_output_stream(f"{self.folder}/{f[0]}", compression=None)
        pointer = pack_value(f[0], f[2], len(data))
        if data:
            f[1].write(data)
        f[2] += len(data)
        f[3] += 1
        if self.rows and f[3] >= self.rows or self.size and f[2] >= self.size:
            self._finish(column)
        return pointer

    def _finish(self, column: str) -> None:
        stream = self.open.pop(column)[1]
        if stream is not None:
            stream.close()

    def close(self) -> None:
        for column in list(self.open):
            self._finish(column)


class BlobReader:
    """Reads values by pointer; keeps the last few files open. cache: a folder of the executor that whole files are first copied to."""

    OPEN = 16

    def __init__(self, folder: str, options: dict | None = None, cache: str | None = None):
        self.store, self.folder = arrow_store(folder, options)
        self.cache = FileCache(cache) if cache else None
        self.files: OrderedDict = OrderedDict()

    def _open(self, file_id: str):
        path = f"{self.folder}/{file_id}"
        if self.cache is None:
            return self.store.open_input_file(path)
        return pa.OSFile(self.cache.get(path, lambda to: copy_out(self.store, path, to)))

    def read(self, pointer: bytes | None) -> bytes | None:
        if pointer is None:
            return None
        file_id, offset, size = unpack_value(pointer)
        if not size:
            return b""
        f = self.files.get(file_id)
        if f is None:
            f = self.files[file_id] = self._open(file_id)
            if len(self.files) > self.OPEN:
                self.files.popitem(last=False)[1].close()
        self.files.move_to_end(file_id)
        f.seek(offset)
        data = f.read(size)
        if len(data) != size:
            raise OSError(f"blob file {file_id} ends before {offset} + {size}")
        return data

    def close(self) -> None:
        for f in self.files.values():
            f.close()
        self.files.clear()


def write_blobs(df: DataFrame, columns: Sequence[str], folder: str, split: str | None = None, rows: int | None = 50, size: int | None = None) -> DataFrame:
    """df with the values of binary columns replaced by pointers; in row order, so sort before. Rows of different splits share no file."""
    if not columns:
        return df
    at, options = [df.columns.index(c) for c in columns], arrow_options(df.sparkSession, folder)
    split_at = df.columns.index(split) if split else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writers: dict = {}
        try:
            for batch in batches:
                splits = batch.column(split_at).to_pylist() if split_at is not None else [""] * batch.num_rows
                arrays = list(batch.columns)
                for i, name in zip(at, columns):
                    out = []
                    for s, value in zip(splits, batch.column(i)):
                        if s not in writers:
                            writers[s] = BlobWriter(folder, rows, size, options)
                        out.append(writers[s].add(name, value.as_py()))
                    arrays[i] = pa.array(out, batch.schema.field(i).type)
                yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
        finally:
            for w in writers.values():
                w.close()

    return df.mapInArrow(run, df.schema)


def resolve(df: DataFrame, columns: Sequence[str], folder: str, cache: str | None = None) -> DataFrame:
    """df with pointers replaced by their values. Done last, over selected columns only; each file is read in order of offset.

    cache: see BlobReader; for files that are read again and again, as by look-ups of single rows.
    """
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    at, options = [df.columns.index(c) for c in columns], arrow_options(df.sparkSession, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = BlobReader(folder, options, cache)
        try:
            for batch in batches:
                arrays = list(batch.columns)
                for i in at:
                    pointers = batch.column(i).to_pylist()
                    values: list = [None] * len(pointers)
                    for k in sorted((k for k, p in enumerate(pointers) if p is not None), key=lambda k: (pointers[k][1:17], int.from_bytes(pointers[k][17:25], "little"))):
                        values[k] = reader.read(pointers[k])
                    arrays[i] = pa.array(values, batch.schema.field(i).type)
                yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
        finally:
            reader.close()

    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    return df.mapInArrow(run, schema)
