"""Rows with long values are dealt to tasks by bytes."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnset import BytesField, Dataset, DatasetID, DatasetSchema, Layout, LongField, StringField, persist, queries
from cairnset.functions import pointers
from cairnset.operators import frames, positions
from cairnset.plans import persist as persist_module
from cairnset.plans.scratch import Scratch

MB = 1 << 20


@pytest.fixture(scope="module")
def long_texts(tmp_path_factory):
    """Documents: 1,000 short texts, then 40 of 4 MB."""
    return str(tmp_path_factory.mktemp("long"))


@pytest.fixture(scope="module")
def documents(spark, long_texts):
    times = F.when(F.col("id") < 1000, 1).otherwise(MB).cast("int")
    df = spark.range(1040).select(F.col("id").alias("doc_id"), F.repeat(F.lpad(F.col("id").cast("string"), 4, "0"), times).alias("text"), F.lit("en").alias("lang"), F.lit("src3").alias("source"))
    df.write.parquet(f"{long_texts}/documents.parquet")
    return df


def most_in_a_file(spark, sf_dir):
    """A file has 50 rows at most, 200 MB here; a task closes its files, so a smaller one shows where a task ended."""
    layout, id = queries._persisted(sf_dir, "documents", spark.sparkContext.applicationId)
    folder = layout.blobs(id.name).removeprefix("file://")
    return max(os.path.getsize(f"{folder}/{f}") for f in os.listdir(folder) if not f.startswith("."))


def test_pointer_columns_of_long_texts(spark, long_texts, documents):
    found = {tuple(r) for r in queries.pointer_columns(spark, long_texts).collect()}
    assert found == {(i, "en", "src3") for i in range(1040)}
    assert most_in_a_file(spark, long_texts) <= 68 * MB


def test_blob_raw_of_long_texts(spark, long_texts, documents):
    """Reads what the other query wrote, or writes it."""
    found = {tuple(r) for r in queries.blob_raw(spark, long_texts).collect()}
    assert found == {tuple(r) for r in documents.select("doc_id", F.md5("text")).collect()}
    assert most_in_a_file(spark, long_texts) <= 68 * MB


@pytest.mark.parametrize("rows, size", [(None, 1000), (7, 1 << 30), (7, 1)])
def test_partitions_by_rows_and_bytes(spark, tmp_path, rows, size):
    """Keys of several types, nulls and empty values; positions stay those of the order."""
    schema = DatasetSchema([StringField("a"), LongField("b"), BytesField("body", required=False)], ["a", "b"])
    data = [("test" if i % 3 else "train", {"a": "xÿ☃"[i % 2 :], "b": -i, "body": None if i % 5 == 0 else b"z" * (i % 4) * 100}) for i in range(200)]
    layout, id = Layout(str(tmp_path)), DatasetID("d", "1.0.0")
    persist(data, id, schema, layout, spark=spark, bytes_per_partition=size, **({"rows_per_partition": rows} if rows else {}))
    for split in ("test", "train"):
        want = sorted(((r["a"], r["b"], r["body"]) for s, r in data if s == split), key=lambda r: r[:2])
        assert [(r["a"], r["b"], r["body"]) for r in Dataset(spark, layout, id, split).rows()] == want


def test_row_bytes(spark):
    df = spark.createDataFrame([("ab☃", bytearray(7), [["x", None], None], (3, "yz")), (None, None, None, None)], "s string, b binary, a array<array<string>>, r struct<n:int,t:string>")
    assert [r[0] for r in df.select(frames.row_bytes(df)).collect()] == [5 + 7 + (8 + 16 + 1 + 8) + 8 + 2, 8]


def laid_out(texts, limit=100_000):
    """(file_no, offset) of each text, as one writer lays them out."""
    file_no = offset = 0
    for text in texts:
        yield file_no, offset
        offset += len(text)
        if offset >= limit:
            file_no, offset = file_no + 1, 0


def test_blob_layout_bytes_of_many_tasks_is_that_of_one_writer(spark, tmp_path, monkeypatch):
    """Empty and long texts, many rows of a key, files over several partitions; no task writes much more than its share."""
    r, rows, tables = random.Random(5), [], []
    for lang, n in (("de", 400), ("en", 1500), ("fr", 1)):
        rows += [(lang, i // 40 if i < 200 else i, "x" * r.choice([0, 0, 1, 900, 30_000, r.randrange(60_000), 150_000 * (r.random() < 0.05)])) for i in range(n)]
    r.shuffle(rows)
    spark.createDataFrame(rows, "lang string, doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    save = Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: tables.append((name, save(self, df, name))) or tables[-1][1])
    monkeypatch.setattr(positions, "TASK_BYTES", MB, raising=False)
    monkeypatch.setattr(persist_module, "ROWS_PER_PARTITION", 150)  # of keys and sizes
    found = queries.blob_layout_bytes(spark, str(tmp_path)).select("lang", "doc_id", "size", "file_no", "offset").collect()
    want = []
    for lang in ("de", "en", "fr"):
        own = sorted(((i, len(text), text) for x, i, text in rows if x == lang), key=lambda x: x[:2])
        want += [(lang, i, size, *at) for (i, size, _), at in zip(own, laid_out(text for _, _, text in own))]
    assert sorted(map(tuple, found)) == sorted(want)
    written = next(t for name, t in tables if name == "pointers").groupBy(F.input_file_name()).agg(F.sum(pointers.unpack(F.col("body"))["size"])).collect()
    assert max(x[1] for x in written) < 1.5 * MB


def test_passages_and_files_of_any_cut():
    r = random.Random(1)
    for _ in range(500):
        limit, sizes = r.choice([1, 3, 10, 50]), [r.choice([0, 0, 1, 2, 5, r.randrange(80)]) for _ in range(r.randint(1, 60))]
        ends = sorted({0, len(sizes), *(r.randrange(len(sizes)) for _ in range(r.randrange(6)))})
        opened, closed, found = -1, 0, []
        for a, b in zip(ends, ends[1:]):
            part = np.array(sizes[a:b], np.int64)
            file_no, offset, _ = positions._files(part, limit, opened, closed)
            found += zip(file_no.tolist(), offset.tolist())
            total, at, closes, opens = positions._passages(part, limit)
            k = int(np.searchsorted(at, limit - max(opened, 0)))
            opened, closed = (int(opens[k]), closed + int(closes[k])) if k < len(at) else (max(opened, 0) + total, closed)
        assert found == list(laid_out(["x" * n for n in sizes], limit))
