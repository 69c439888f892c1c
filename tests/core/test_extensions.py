"""Stores, caches, metadata stores, jobs, publishing, and what extensions implement."""

import multiprocessing
import os
import threading
import time

import pandas as pd
import pytest
from pyarrow import fs

from cairnset import *
from cairnset.errors import DatasetError, SchemaError
from cairnset.layout import DatasetID, Layout
from cairnset.plans import scratch
from cairnset.plans.metadata import KeyValueMetadata, MemoryClient, Note, TableMetadata
from cairnset.sources import files
from cairnset.sources.cache import FileCache, ahead, locked, retried
from cairnset.sources.storage import HadoopStorage, LocalStorage
from cairnset.testing import FolderObjectStore, MemoryTracker

SCHEMA = DatasetSchema([LongField("n"), StringField("s", required=False)], ["n"])
ID = DatasetID("d", "1.0.0")


def test_paths_of_every_kind_reach_arrow(monkeypatch):
    made = []
    monkeypatch.setattr(fs, "S3FileSystem", lambda **options: made.append(options) or "store")
    for scheme in ("s3", "s3a", "s3n"):
        assert files.arrow_store(f"{scheme}://bucket/a/b/", {"region": "r", "request_timeout": 2.0}) == ("store", "bucket/a/b")
    assert made == [{"region": "r", "request_timeout": 2.0}] * 3
    files.arrow_store("s3a://bucket/a", {"attempts": 4})
    assert isinstance(made[-1]["retry_strategy"], fs.AwsStandardS3RetryStrategy)
    assert files.arrow_store("file:///x/y z")[1] == files.arrow_store("file:/x/y z")[1] == files.arrow_store("/x/y z")[1] == "/x/y z"
    assert files.arrow_store("x/y")[1] == os.path.abspath("x/y")


def test_settings_of_hadoop_reach_arrow(spark):
    Client("eu-1", 20, 1.5, 3, 7).apply(spark)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.s3a.access.key", "k")
    try:
        got = files.arrow_options(spark, "s3a://bucket/x")
        assert got["region"] == "eu-1" and got["access_key"] == "k" and got["request_timeout"] == 1.5 and got["connect_timeout"] == 3 and got["attempts"] == 7
        assert conf.get("fs.s3a.connection.maximum") == "20" and files.arrow_options(spark, "/local") == {}
    finally:
        for name in ("endpoint.region", "connection.maximum", "connection.timeout", "connection.establish.timeout", "attempts.maximum", "access.key"):
            conf.unset(f"fs.s3a.{name}")


def test_configuration():
    c = Config.from_dict({"object_store": {"root": "s3a://b/r"}, "client": {"region": "x"}, "download": {"folder": "/c", "attempts": 9}, "tracker": {"url": "u"}})
    assert (c.client.region, c.download.folder, c.download.attempts, c.section("tracker")) == ("x", "/c", 9, {"url": "u"})
    with pytest.raises(ValueError):
        c.section("other")


def test_clusters_need_a_shared_folder(spark, monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda name, default: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(DatasetError):
        scratch.shared_folder(Session)
    for Session.sparkContext.master in ("local", "local[8]", "local[*]"):
        assert scratch.shared_folder(Session).startswith("file:///")
    Session.sparkContext.master = "local-cluster[3,2,1024]"
    with pytest.raises(DatasetError):
        scratch.shared_folder(Session)


def test_scratch_drops_what_is_not_kept(spark):
    outer = scratch.Scratch(spark, "t")
    own, mine = outer.inner("x"), outer.save(spark.range(3), "mine")
    a, b = own.save(spark.range(4), "a"), own.save(spark.range(5), "b")
    paths = {id(t): p for p, t in own.tables.items()}
    own.keep(a)
    assert a.count() == 4 and mine.count() == 3 and not files.exists(spark, paths[id(b)])
    outer.close()
    assert not files.exists(spark, outer.root)


@pytest.mark.parametrize("make", [lambda spark, tmp: (HadoopStorage(spark), f"file://{tmp}"), lambda spark, tmp: (LocalStorage(), str(tmp)), lambda spark, tmp: (FolderObjectStore(str(tmp)), "s3a://bucket/k")])
def test_storages(spark, tmp_path, make):
    store, root = make(spark, tmp_path / "store")
    assert not store.exists(f"{root}/a/b")
    store.write_bytes(f"{root}/a/b", b"\0\xff1")
    assert store.exists(f"{root}/a/b") and store.read_bytes(f"{root}/a/b") == b"\0\xff1"
    store.fetch_file(f"{root}/a/b", str(tmp_path / "out/b"))
    store.put_file(str(tmp_path / "out/b"), f"{root}/c")
    assert store.read_bytes(f"{root}/c") == b"\0\xff1"
    with open(store.cached(f"{root}/c", str(tmp_path / "cache")), "rb") as f:
        assert f.read() == b"\0\xff1"
    assert store.cached(f"{root}/c", "") == f"{root}/c"


def test_broken_store_leaves_no_part_in_the_cache(tmp_path):
    store = FolderObjectStore(str(tmp_path / "store"))
    store.write_bytes("s3a://b/k", b"x")
    store.broken.add("s3a://b/k")
    with pytest.raises(OSError):
        store.cached("s3a://b/k", str(tmp_path / "cache"))
    store.broken.clear()
    for _ in range(3):
        assert open(store.cached("s3a://b/k", str(tmp_path / "cache")), "rb").read() == b"x"
    assert store.fetched.count("s3a://b/k") == 4  # three attempts that failed and one


def _fetch(folder, source, log, ready):
    def slow(to):
        with open(log, "a") as f:
            f.write("x")
        time.sleep(0.3)
        with open(source, "rb") as a, open(to, "wb") as b:
            b.write(a.read())

    ready.wait()
    assert open(FileCache(folder).get(source, slow), "rb").read() == b"data"


def test_processes_fetch_a_file_once(tmp_path):
    (tmp_path / "source").write_bytes(b"data")
    context = multiprocessing.get_context("spawn")
    ready = context.Barrier(4)
    workers = [context.Process(target=_fetch, args=(str(tmp_path / "cache"), str(tmp_path / "source"), str(tmp_path / "log"), ready)) for _ in range(4)]
    for w in workers:
        w.start()
    for w in workers:
        w.join(120)
        assert w.exitcode == 0
    assert (tmp_path / "log").read_text() == "x"


def test_lock_times_out(tmp_path):
    with locked(str(tmp_path / "l")):
        with pytest.raises(DatasetError):
            with locked(str(tmp_path / "l"), 0.1):
                pass
    with locked(str(tmp_path / "l"), 0.1):
        pass


def test_retries():
    left = [OSError(), OSError()]

    def call():
        if left:
            raise left.pop()
        return 5

    assert retried(call, 3, 0) == 5
    left = [OSError(), OSError()]
    with pytest.raises(OSError):
        retried(call, 2, 0)


def test_look_ahead_keeps_order_and_bound():
    busy, most, lock = [0], [0], threading.Lock()

    def fetch(i):
        with lock:
            busy[0] += 1
            most[0] = max(most[0], busy[0])
        time.sleep(0.01 * (i % 3))
        with lock:
            busy[0] -= 1
        return i * 2

    assert list(ahead(fetch, range(30), lambda i: 10, threads=8, most=40)) == [2 * i for i in range(30)]
    assert 1 < most[0] <= 4
    assert list(ahead(fetch, [1], lambda i: 100, most=40)) == [2] and list(ahead(fetch, [], lambda i: 1)) == []


def test_blobs_through_a_cache(spark, tmp_path):
    schema = DatasetSchema([LongField("n"), BytesField("b")], ["n"])
    layout = Layout(str(tmp_path / "data"))
    persist([("train", {"n": i, "b": b"%d" % i}) for i in range(20)], ID, schema, layout, spark=spark)
    for _ in range(2):
        rows = Dataset(spark, layout, ID, "train", cache=str(tmp_path / "cache")).df.orderBy("n").collect()
        assert [bytes(r.b) for r in rows] == [b"%d" % i for i in range(20)]
    assert any(not n.endswith(".lock") for n in os.listdir(tmp_path / "cache"))


def notes():
    return [Note(s, (k, f"x{k % 3}"), f"at/{k}", k) for k in range(1, 40) for s in ("train", "test")]


@pytest.mark.parametrize("shards, page", [(32, 1000), (3, 2), (1, 1)])
def test_key_value_metadata(shards, page):
    client = MemoryClient()
    store = KeyValueMetadata(client, shards, page, wait=0)
    store.save(ID, notes())
    store.save(ID, [Note("train", (7, "x1"), "later", 70)])
    store.save(DatasetID("other", "1.0.0"), [Note("train", (1,), "no", 1)])
    got = list(store.scan_sorted(ID))
    want = sorted(notes(), key=Note.key_text)
    assert [n.key_text() for n in got] == [n.key_text() for n in want] and next(n for n in got if n.keys == (7, "x1") and n.split == "train").location == "later"
    failing, real = [3], client.page

    def page_(*args):
        failing[0] -= 1
        if failing[0] % 2 == 0:
            raise OSError("throttled")
        return real(*args)

    client.page = page_
    assert list(store.scan_sorted(ID)) == got


def test_table_metadata(spark, tmp_path):
    store = TableMetadata(spark, Layout(str(tmp_path)), ["long", "string"])
    assert list(store.scan_sorted(ID)) == []
    store.save(ID, notes())
    store.save(ID, [Note("train", (7, "x1"), "later", 70)])
    got = list(store.scan_sorted(ID))
    assert [(n.split, n.keys) for n in got] == sorted((n.split, n.keys) for n in notes()) and [n.size for n in got if n.location == "later"] == [70]


def test_jobs_run_in_order(spark):
    rows = spark.createDataFrame([("a", i) for i in range(25)] + [("b", 1)], "split string, n long").repartition(5)
    out = run_jobs(rows, ["n"], lambda pdf: pd.DataFrame({"first": [pdf.n.iloc[0]], "n": [len(pdf)]}), "first long, n long", 10)
    assert sorted(map(tuple, out.collect())) == [("a", 0, 0, 10), ("a", 1, 10, 10), ("a", 2, 20, 5), ("b", 0, 1, 1)]


def test_publishing(spark, tmp_path):
    layout, tracker = Layout(str(tmp_path)), MemoryTracker()
    with pytest.raises(DatasetError):
        publish(spark, ID, layout, tracker)
    SparkPersistor(spark).persist([("train", {"n": 1, "s": None})], ID, SCHEMA, layout)
    publish(spark, ID, layout, tracker, {"owner": "me"})
    assert tracker.logged == [("d_1.0.0", layout.assets(ID), {"owner": "me", "version": "1.0.0", "uri": layout.assets(ID)})]


def test_visitor():
    class Names(SchemaVisitor):
        def record(self, f, inner):
            return {f.name: inner}

        def other(self, f, inner):
            return f.name

    schema = DatasetSchema([LongField("n"), RecordField("r", [IntField("a"), ArrayField(StringField("b"))])], ["n"])
    assert Names().visit_schema(schema) == ["n", {"r": ["a", "b"]}]
    with pytest.raises(SchemaError):
        SchemaVisitor().visit(LongField("n"))


def test_tags_come_back():
    tagged = DatasetSchema([LongField("n", tags={"unit": "m", "A_metatype": "mine"}), BytesField("b", tags={"codec": "x", "numpy": 1}), RecordField("r", [IntField("a", tags={"deep": [1]})], tags={"t": 1})], ["n"])
    again = loads(dumps(tagged))
    assert again == tagged and again.by_name["r"].fields[0].tags == {"deep": [1]}
    assert again != DatasetSchema([LongField("n"), *tagged.fields[1:]], ["n"])
    for bad in ("_metatype", "type"):
        with pytest.raises(ValueError):
            LongField("n", tags={bad: "x"})


def test_writers_at_once_lose_no_row(spark, tmp_path):
    """Eight threads, each with a writer of four, on one version."""
    layout, errors = Layout(str(tmp_path)), []

    def work(t):
        try:
            with StagingWriter(spark, ID, SCHEMA, layout, buffer=7) as w:
                for i in range(40):
                    w.add("train" if i % 2 else "test", {"n": 1000 * t + i, "s": str(t)})
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(t,)) for t in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert commit(spark, ID, SCHEMA, layout) == {"test": 160, "train": 160}
    assert Dataset(spark, layout, ID, "train").df.count() == 160


def test_a_source_that_changes_is_refused(spark, tmp_path):
    """Keys are checked on the rows that were written, too."""
    from pyspark.sql import functions as F

    calls = spark.range(100).withColumn("n", (F.rand() * 40).cast("long")).select(F.lit("train").alias("split"), "n", F.lit("x").alias("s"))
    with pytest.raises(DatasetError):
        persist(calls, ID, SCHEMA, Layout(str(tmp_path)))
