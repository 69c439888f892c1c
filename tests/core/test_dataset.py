import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnset import (
    ArrayField,
    BytesField,
    Config,
    Dataset,
    DatasetError,
    DatasetID,
    DatasetSchema,
    IntField,
    Layout,
    LongField,
    NumpyField,
    RecordField,
    SchemaError,
    StagingWriter,
    StringField,
    build_dataset,
    commit,
    from_rdd,
    jobs,
    persist,
    stage,
    stage_stream,
)
from cairnset.functions import keys, pointers
from cairnset.layout import bucket_key
from cairnset.operators import blobs, frames
from cairnset.operators.filters import compile_filter
from cairnset.plans.staging import upserted

BYTES = DatasetSchema([IntField("foo"), StringField("bar"), BytesField("bytescol", required=False)], ["bar", "foo"])
ID = DatasetID("things", "0.0.1")


def bytes_rows(n, seed=3):
    r = random.Random(seed)
    return [("train" if i % 2 else "test", {"foo": r.randrange(10000), "bar": str(uuid.UUID(int=r.getrandbits(128))), "bytescol": b"0"}) for i in range(n)]


@pytest.mark.parametrize("n, per", [(4, 1_000_000), (2000, 256)])
def test_persist_and_read_back(spark, tmp_path, n, per):
    layout, rows = Layout(str(tmp_path)), bytes_rows(n)
    assert persist(rows, ID, BYTES, layout, rows_per_partition=per, spark=spark) == {"test": n // 2, "train": n // 2}
    for split in ("test", "train"):
        want = sorted((r["bar"], r["foo"]) for s, r in rows if s == split)
        d = Dataset(spark, layout, ID, split)
        assert [(r["bar"], r["foo"]) for r in d.rows()] == want and len(d) == n // 2
        assert d[0]["bytescol"] == b"0" and (d[1]["bar"], d[1]["foo"]) == want[1] and d[-1]["bar"] == want[-1][0]
        assert {(r.bar, r.foo) for r in d.slice(1, 2).collect()} == set(want[1:2])
        assert d.blob_bytes() == n // 2
        with pytest.raises(IndexError):
            d[n]
    assert sum(f.stat().st_size for f in (tmp_path / "__COLUMN_CONCATENATED_FILES__").iterdir() if not f.name.startswith(".")) == n


def test_repeated_keys_are_found_before_anything_is_visible(spark, tmp_path):
    rows = bytes_rows(50)
    rows[20] = rows[0]
    with pytest.raises(DatasetError):
        persist(rows, ID, BYTES, Layout(str(tmp_path)), spark=spark)
    assert not (tmp_path / "things" / "0.0.1").exists()
    rows[20] = ("train", rows[0][1])  # the same key in another split is another key
    assert sum(persist(rows, ID, BYTES, Layout(str(tmp_path)), spark=spark).values()) == 50


def test_versions_are_not_overwritten_by_default(spark, tmp_path):
    layout = Layout(str(tmp_path))
    persist(bytes_rows(4), ID, BYTES, layout, spark=spark)
    with pytest.raises(DatasetError):
        persist(bytes_rows(6, 4), ID, BYTES, layout, spark=spark)
    persist([("train", r) for _, r in bytes_rows(6, 4)], ID, BYTES, layout, mode="overwrite", spark=spark)
    assert len(Dataset(spark, layout, ID, "train")) == 6
    with pytest.raises(DatasetError):
        Dataset(spark, layout, ID, "test")


def test_null_and_empty_blobs(spark, tmp_path):
    layout = Layout(str(tmp_path), blobs_in_dataset=True)
    rows = [("a", {"foo": i, "bar": "x", "bytescol": b}) for i, b in enumerate([None, b"", b"abc", b"", None])]
    persist(rows, ID, BYTES, layout, spark=spark)
    assert [r["bytescol"] for r in Dataset(spark, layout, ID, "a").rows()] == [None, b"", b"abc", b"", None]
    persist([("a", {"foo": 1, "bar": "x", "bytescol": b""})], DatasetID("things", "0.0.2"), BYTES, layout, spark=spark)
    empty = Dataset(spark, layout, DatasetID("things", "0.0.2"), "a")
    assert empty[0]["bytescol"] == b"" and empty.blob_bytes() == 0
    assert empty.size() > 0


def test_from_rdd_and_empty(spark, tmp_path):
    df = from_rdd(spark, spark.sparkContext.parallelize(bytes_rows(10)), BYTES)
    assert sum(persist(df, ID, BYTES, Layout(str(tmp_path))).values()) == 10
    assert persist(df.limit(0), DatasetID("none", "1.0.0"), BYTES, Layout(str(tmp_path))) == {}
    with pytest.raises(Exception, match="Error at path foo"):
        from_rdd(spark, spark.sparkContext.parallelize([("a", {"foo": "x", "bar": "y"})]), BYTES).collect()


def test_numpy_by_index_with_filters(spark, tmp_path):
    schema = DatasetSchema([StringField("foo"), NumpyField("np_arr", (4, 4), "float64")], ["foo"])
    layout = Layout(str(tmp_path))
    persist([("train", {"foo": f"bar{i}", "np_arr": np.eye(4) * i}) for i in range(300)], ID, schema, layout, blob_rows=10, rows_per_partition=70, spark=spark)
    order = sorted(f"bar{i}" for i in range(300))
    wanted = [f"bar{i}" for i in range(100)]
    d = Dataset(spark, layout, ID, "train", filters=[("foo", "in", wanted)])
    assert len(d) == 100
    assert d[7]["foo"] == sorted(wanted)[7] and (d[7]["np_arr"] == np.eye(4) * int(d[7]["foo"][3:])).all()
    assert [r["foo"] for r in Dataset(spark, layout, ID, "train", columns=["foo"]).rows()] == order
    assert sorted(r.foo for r in d.slice(98, 200).collect()) == sorted(wanted)[98:]
    built = build_dataset(spark, "filesystem", "things", "0.0.1", "train", "here", columns=["foo"], config=Config.from_dict({"filesystems": {"here": {"root": str(tmp_path)}}}))
    assert built[0] == {"foo": order[0]}
    for kind, store in (("filesystem", "there"), ("object_store", ""), ("other", "")):
        with pytest.raises(ValueError):
            build_dataset(spark, kind, "things", "0.0.1", "train", store, config=Config.from_dict({}))
    raw = Dataset(spark, layout, ID, "train", raw=True)
    assert raw[0]["np_arr"].startswith(b"\x93NUMPY")
    blob_files = [f for f in (tmp_path / "__COLUMN_CONCATENATED_FILES__").iterdir() if not f.name.startswith(".")]
    assert raw.size() == sum(f.stat().st_size for f in (tmp_path / "things/0.0.1/train.parquet").iterdir() if not f.name.startswith(".")) + sum(f.stat().st_size for f in blob_files)


def test_scan_is_pruned(spark, tmp_path):
    layout = Layout(str(tmp_path))
    persist(bytes_rows(20), ID, BYTES, layout, spark=spark)
    d = Dataset(spark, layout, ID, "train", columns=["foo"], filters=[("foo", ">", 5)])
    plan = d.df._jdf.queryExecution().toString()
    assert "ReadSchema: struct<foo:int>" in plan and "GreaterThan(foo,5)" in plan


def test_wider_stored_types_are_cast(spark, tmp_path):
    layout = Layout(str(tmp_path))
    persist([("a", {"foo": 1, "bar": "x", "bytescol": None})], ID, BYTES, layout, spark=spark)
    spark.sql("select 7L as foo, 'y' as bar, cast(null as binary) as bytescol union all select 3L, 'b', null").coalesce(1).write.mode("overwrite").parquet(layout.split(ID, "a"))
    d = Dataset(spark, layout, ID, "a")
    assert d.df.schema["foo"].dataType.simpleString() == "int" and d[0]["foo"] == 3 and d[1]["bar"] == "y"


NULLS = [(1, "a"), (2, None), (3, "b")]


@pytest.mark.parametrize(
    "filters, ids",
    [
        ([("s", "in", ["a"])], [1]),
        ([("s", "in", ["a", None])], [1, 2]),
        ([("s", "not in", ["a"])], [2, 3]),
        ([("s", "not in", ["a", None])], [3]),
        ([("s", "!=", "a")], [3]),
        ([[("s", "=", "a"), ("i", ">", 5)], [("i", "<=", 2), ("i", ">=", 2)]], [2]),
        ([("s", "in", [])], []),
        ("i = 3", [3]),
        (lambda: F.col("i") < 2, [1]),
    ],
)
def test_filters(spark, filters, ids):
    df = spark.createDataFrame(NULLS, "i int, s string")
    assert sorted(r.i for r in df.where(compile_filter(filters() if callable(filters) else filters)).collect()) == ids


@pytest.mark.parametrize("bad", [[("s", "like", "a")], [("s", "in", "a")], [], [[]]])
def test_bad_filters(bad):
    with pytest.raises(ValueError):
        compile_filter(bad)


def test_frames(spark):
    schema = DatasetSchema([LongField("k"), RecordField("r", [IntField("a"), ArrayField(IntField("xs"), required=False)], required=False), StringField("o", required=False)], ["k"])
    df = spark.sql("select 1L as k, named_struct('a', 1, 'xs', array(1, null)) as r union all select 2L, null union all select null, named_struct('a', null, 'xs', null)")
    whole = frames.conform(df, schema)
    assert whole.columns == ["k", "r", "o"]
    assert {r.path: r.nulls for r in frames.violations(whole, schema).collect()} == {"k": 1, "r.a": 1, "r.xs.elem": 1}
    with pytest.raises(Exception, match="Error at path r"):
        frames.enforce(whole.where("k = 1"), schema).collect()
    with pytest.raises(Exception, match="Error at path k: null"):
        frames.enforce(whole.where("k is null"), schema).collect()
    assert frames.enforce(whole.where("k = 2"), schema).count() == 1
    for bad in (df.drop("k"), df.withColumn("z", F.lit(1)), df.withColumn("k", F.lit(1))):
        with pytest.raises(SchemaError, match="Error at path"):
            frames.conform(bad, schema)


def test_keys(spark):
    import hashlib

    df = spark.createDataFrame([("train", "a", 10, True), ("train", "a", 2, False)], "split string, s string, i int, b boolean")
    text = keys.key_text(df, ["split", "s", "i", "b"])
    hashed = keys.key_hash(df, ["split", "s", "i", "b"])
    for r in df.select(text.alias("t"), hashed.alias("h"), keys.shard(hashed).alias("n")).collect():
        want = hashlib.sha256(r.t.encode()).hexdigest()
        assert r.t in ("train/a/10/True", "train/a/2/False") and r.h == want and r.n == int(want, 16) % 32
    assert [r.i for r in df.orderBy(keys.lexicographic(df, "split", ["s", "i"])).collect()] == [10, 2]


def test_pointers(spark):
    rows = [(str(uuid.UUID(int=i * 7919 << 90 | i)), o, s) for i, (o, s) in enumerate([(0, 0), (100, 100), (2**40 + 3, 2**32 - 1)])]
    df = spark.createDataFrame(rows, "f string, o long, s long").withColumn("p", pointers.pack(F.col("f"), F.col("o"), F.col("s")))
    for r in df.select("*", pointers.unpack(F.col("p")).alias("u")).collect():
        assert tuple(r.u) == (r.f, r.o, r.s) == tuple(map(lambda x: str(x) if isinstance(x, uuid.UUID) else x, pointers.unpack_value(bytes(r.p))))
        assert bytes(r.p) == pointers.pack_value(uuid.UUID(r.f), r.o, r.s) and len(r.p) == 29
    with pytest.raises(ValueError):
        pointers.unpack_value(b"\x02" + bytes(28))
    with pytest.raises(Exception, match="version 1"):
        spark.range(1).select(pointers.unpack(F.lit(b"\x02" + bytes(28)))).collect()


@pytest.mark.parametrize("rows, size, values, offsets", [(None, 10, [b"foo"] * 5, [0, 3, 6, 9, 0]), (None, 10, [b"0123456789"] * 3, [0, 0, 0]), (1, None, [b"foo"] * 3, [0, 0, 0]), (None, None, [b"foo"] * 3, [0, 3, 6])])
def test_blob_writer(tmp_path, rows, size, values, offsets):
    w = blobs.BlobWriter(str(tmp_path / "blobs"), rows, size)
    found = [(w.add("col0", v), w.add("col1", v)) for v in values]
    w.close()
    assert [pointers.unpack_value(a)[1] for a, _ in found] == offsets == [pointers.unpack_value(b)[1] for _, b in found]
    assert all(pointers.unpack_value(a)[0] != pointers.unpack_value(b)[0] for a, b in found)
    r = blobs.BlobReader(str(tmp_path / "blobs"))
    assert [r.read(a) for a, _ in found] == values
    with pytest.raises(OSError):
        r.read(pointers.pack_value(pointers.unpack_value(found[0][0])[0], 10**6, 5))
    r.close()


def test_no_data_makes_no_files(tmp_path):
    blobs.BlobWriter(str(tmp_path / "blobs")).close()
    assert not (tmp_path / "blobs").exists()


@pytest.mark.parametrize("n, size, want", [(0, 5, []), (1, 5, [("a", 0, 1)]), (10, 10, [("a", 0, 10)]), (10, 5, [("a", 0, 5), ("a", 1, 5)]), (11, 5, [("a", 0, 5), ("a", 1, 5), ("a", 2, 1)])])
def test_jobs(spark, n, size, want):
    df = spark.createDataFrame([("a", i) for i in range(n)] + [("b", 3)], "split string, k int")
    got = jobs(df, ["k"], size).groupBy("split", "job_id").count().orderBy("split", "job_id").collect()
    assert [tuple(r) for r in got] == want + [("b", 0, 1)]


def test_staging(spark, tmp_path):
    layout = Layout(str(tmp_path))
    first = spark.createDataFrame([("a", 1, "x", b"1"), ("a", 2, "x", b"2")], "split string, foo int, bar string, bytescol binary")
    stage(first, ID, BYTES, layout, 1)
    stage(first.where("foo = 1").withColumn("bytescol", F.lit(b"new")), ID, BYTES, layout, 2)
    assert upserted(spark, ID, BYTES, layout).count() == 2
    with StagingWriter(spark, ID, BYTES, layout, buffer=2) as w:
        for i in range(5):
            w.add("b", {"foo": i % 4, "bar": "y", "bytescol": str(i).encode()})
        with pytest.raises(SchemaError):
            w.add("b", {"foo": 1})
    assert commit(spark, ID, BYTES, layout) == {"a": 2, "b": 4}
    assert [r["bytescol"] for r in Dataset(spark, layout, ID, "a").rows()] == [b"new", b"2"]
    assert [r["bytescol"] for r in Dataset(spark, layout, ID, "b").rows()] == [b"4", b"1", b"2", b"3"]
    with pytest.raises(DatasetError):
        upserted(spark, ID, BYTES, layout)


def test_stream_into_staging(spark, tmp_path):
    layout, source = Layout(str(tmp_path / "root")), str(tmp_path / "in")
    schema = DatasetSchema([LongField("k"), StringField("v", required=False)], ["k"])
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "split string, k long, v string").write.parquet(source)
    stream = spark.readStream.schema("split string, k long, v string").parquet(source)
    stage_stream(stream, ID, schema, layout, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    spark.createDataFrame([("a", 2, "later")], "split string, k long, v string").write.mode("append").parquet(source)
    stage_stream(stream, ID, schema, layout, str(tmp_path / "cp"), availableNow=True).awaitTermination()
    assert commit(spark, ID, schema, layout) == {"a": 2}
    assert [r["v"] for r in Dataset(spark, layout, ID, "a").rows()] == ["x", "later"]


def test_join(spark, tmp_path):
    layout, other = Layout(str(tmp_path)), DatasetID("others", "1.0.0")
    schema = DatasetSchema([LongField("k"), StringField("v", required=False)], ["k"])
    persist([("a", {"k": k, "v": f"l{k}"}) for k in range(4)], ID, schema, layout, spark=spark)
    persist([("a", {"k": k, "v": f"r{k}"}) for k in range(2, 6)], other, schema, layout, spark=spark)
    joined = Dataset(spark, layout, ID, "a").join(Dataset(spark, layout, other, "a"))
    assert sorted(tuple(r) for r in joined.collect()) == [(2, "l2", "r2"), (3, "l3", "r3")] and joined.columns == ["k", "v", "others_v"]


def test_ids_and_paths():
    assert str(DatasetID.parse("a_1/1.2.3")) == "a_1/1.2.3"
    for bad in ("a", "a/1.2", "a b/1.2.3", "a/v1.2.3"):
        with pytest.raises(ValueError):
            DatasetID.parse(bad)
    with pytest.raises(ValueError):
        Layout("/r").split(ID, "../x")
    with pytest.raises(ValueError):
        Layout("/r", blobs_in_dataset=True).blobs()
    assert bucket_key("s3://b/k/l") == ("b", "k/l") and bucket_key("s3a://b") == ("b", "")
    with pytest.raises(ValueError):
        bucket_key("/b/k")
    assert Layout("s3://b/s3://b", trim="s3://b", replacement="/mnt").blobs() == "/mnt/s3://b/__COLUMN_CONCATENATED_FILES__"
