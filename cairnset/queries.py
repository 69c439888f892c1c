"""Queries over the test tables, each through the engine, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import arrays, keys, pointers
from .layout import DatasetID, Layout, bucket_key
from .operators import blobs, frames, positions
from .operators.filters import compile_filter
from .plans import persist as P
from .plans import staging
from .plans.scratch import Scratch
from .schema import ArrayField, BytesField, DatasetSchema, DoubleField, IntField, LongField, NumpyField, RecordField, StringField
from .sources.dataset import Dataset

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_schema() -> DatasetSchema:
    return DatasetSchema([LongField("doc_id"), BytesField("body", required=False), StringField("lang", required=False), StringField("source", required=False)], ["doc_id"])


def events_schema() -> DatasetSchema:
    return DatasetSchema([LongField("event_id"), LongField("user_id", required=False), StringField("event_type", required=False), DoubleField("value", required=False)], ["event_id"])


def events_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("event_id") % 2 == 0, "train").otherwise("test")
    return table(spark, sf_dir, "events").select(split.alias(P.SPLIT), *events_schema().names)


@cache
def _persisted(sf_dir: str, kind: str, session: str) -> tuple[Layout, DatasetID]:
    """A table as a dataset, written once a session."""
    spark = SparkSession.active()
    layout, id = Layout(Scratch(spark, kind).root), DatasetID(kind, "1.0.0")
    if kind == "events":
        P.persist(events_rows(spark, sf_dir), id, events_schema(), layout)
    else:
        rows = table(spark, sf_dir, "documents").select(F.col("lang").alias(P.SPLIT), "doc_id", F.col("text").cast("binary").alias("body"), "lang", "source")
        P.persist(rows, id, documents_schema(), layout)
    return layout, id


def dataset(spark: SparkSession, sf_dir: str, kind: str, split: str, **options) -> Dataset:
    layout, id = _persisted(sf_dir, kind, spark.sparkContext.applicationId)
    return Dataset(spark, layout, id, split, **options)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persist events, then read two columns of the rows of one split that pass a filter."""
    return dataset(spark, sf_dir, "events", "train", columns=["event_id", "event_type"], filters=[("event_type", "in", ["click", "view", "purchase"])]).df


_EVENTS = "select event_id, user_id, event_type, value from events where event_id % 2 = 0"


@query(_EVENTS)
def scan_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset(spark, sf_dir, "events", "train").df


@query("select event_id, event_type from events where event_id % 2 = 0")
def project_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset(spark, sf_dir, "events", "train", columns=["event_type", "event_id"]).df


@query("select doc_id, lang, source from documents where lang = 'en'")
def project_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset(spark, sf_dir, "documents", "en").metadata()


@query("select event_id, event_type from events where event_id % 2 = 0 and event_type in ('click', 'view', 'purchase')")
def filter_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)


@query(
    f"with e as ({_EVENTS}) select 'eq' as op, event_id from e where event_type = 'click' union all select 'ne', event_id from e where event_type <> 'click' union all "
    "select 'lt', event_id from e where value < 10 union all select 'gt', event_id from e where value > 90 union all select 'le', event_id from e where user_id <= 5 union all "
    "select 'ge', event_id from e where user_id >= 50 union all select 'in', event_id from e where event_type is null or event_type = 'view' union all select 'not in', event_id from e where event_type is null or event_type not in ('click', 'view')"
)
def filter_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = {
        "eq": ("event_type", "=", "click"),
        "ne": ("event_type", "!=", "click"),
        "lt": ("value", "<", 10),
        "gt": ("value", ">", 90),
        "le": ("user_id", "<=", 5),
        "ge": ("user_id", ">=", 50),
        "in": ("event_type", "in", ["view", None]),
        "not in": ("event_type", "not in", ["click", "view"]),
    }
    found = dataset(spark, sf_dir, "events", "train").df
    # one scan: each row says which of the filters it passes
    passed = F.array_compact(F.array(*(F.when(compile_filter([t]), F.lit(op)) for op, t in terms.items())))
    return found.select(F.explode(passed).alias("op"), "event_id")


@query(f"select event_id from ({_EVENTS}) where (event_type = 'click' and value > 50) or (event_type = 'view' and value < 20)")
def filter_dnf(spark: SparkSession, sf_dir: str) -> DataFrame:
    either = [[("event_type", "=", "click"), ("value", ">", 50)], [("event_type", "=", "view"), ("value", "<", 20)]]
    return dataset(spark, sf_dir, "events", "train", columns=["event_id"], filters=either).df


@query(f"select event_id, value from ({_EVENTS}) where user_id % 7 = 3 or value < 5")
def filter_expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset(spark, sf_dir, "events", "train", columns=["event_id", "value"], filters="user_id % 7 = 3 or value < 5").df


@query("select 'train' as split, count(*) as n from events where event_id % 2 = 0 union all select 'test', count(*) from events where event_id % 2 = 1 union all select 'train click', count(*) from events where event_id % 2 = 0 and event_type = 'click'")
def dataset_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = dataset(spark, sf_dir, "events", "train", filters=[("event_type", "=", "click")])
    rows = [("train", len(dataset(spark, sf_dir, "events", "train"))), ("test", len(dataset(spark, sf_dir, "events", "test"))), ("train click", len(clicks))]
    return spark.createDataFrame(rows, "split string, n long")


@query(
    f"with p as (select *, row_number() over (order by event_id) - 1 as idx from ({_EVENTS})), c as (select *, row_number() over (order by event_id) - 1 as idx from ({_EVENTS}) where event_type = 'click') "
    "select 'all' as rows, idx, event_id, event_type from p where idx in (0, 17, 250) union all select 'click', idx, event_id, event_type from c where idx in (0, 5, 33)"
)
def get_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    everything = dataset(spark, sf_dir, "events", "train", columns=["event_id", "event_type"])
    clicks = dataset(spark, sf_dir, "events", "train", columns=["event_id", "event_type"], filters=[("event_type", "=", "click")])
    rows = [(name, i, r["event_id"], r["event_type"]) for name, d, at in (("all", everything, (0, 17, 250)), ("click", clicks, (0, 5, 33))) for i in at for r in [d[i]]]
    return spark.createDataFrame(rows, "rows string, idx long, event_id long, event_type string")


@query(f"select idx, event_id, value from (select *, row_number() over (order by event_id) - 1 as idx from ({_EVENTS})) where idx between 100 and 199")
def get_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset(spark, sf_dir, "events", "train", columns=["event_id", "value"]).slice(100, 200).withColumnRenamed("_idx", "idx")


@query("select case when event_id % 2 = 0 then 'train' else 'test' end as split, count(*) as n from events group by 1")
def persist_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "persist")
    counts = P.persist(events_rows(spark, sf_dir), DatasetID("events", "1.0.1"), events_schema(), Layout(scratch.root))
    scratch.close()
    return spark.createDataFrame(list(counts.items()), "split string, n long")


@query("select o_orderstatus as split, o_orderkey, row_number() over (partition by o_orderstatus order by o_orderkey) - 1 as idx from orders")
def pk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("split"), "o_orderkey")
    return positions.with_position(rows, "split", ["o_orderkey"], Scratch(spark, "order"), "idx")


@query("select count(*) as rows, count(distinct (l_orderkey, l_linenumber)) as distinct_keys from lineitem")
def key_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.key_counts(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).select(F.col("rows").cast("long").alias("rows"), "distinct_keys")


@query("select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_HASH = "sha256((case when event_id % 2 = 0 then 'train' else 'test' end) || '/' || event_id)"


@query(f"select event_id, {_HASH} as hash from events")
def key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_rows(spark, sf_dir)
    return rows.select("event_id", keys.key_hash(rows, [P.SPLIT, "event_id"]).alias("hash"))


@query(f"select event_id, ('0x' || right({_HASH}, 2))::int % 32 as shard, printf('events_shard%02d', ('0x' || right({_HASH}, 2))::int % 32) as name from events")
def key_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_rows(spark, sf_dir)
    hashed = keys.key_hash(rows, [P.SPLIT, "event_id"])
    return rows.select("event_id", keys.shard(hashed).alias("shard"), keys.shard_name("events", hashed).alias("name"))


@query(
    "with e as (select event_id, case when event_id % 2 = 0 then 'train' else 'test' end as split from events) "
    "select split, event_id, row_number() over (order by split, event_id) - 1 as typed, row_number() over (order by split || '//' || event_id) - 1 as lexicographic from e"
)
def scan_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_rows(spark, sf_dir).select(P.SPLIT, "event_id")
    rows = rows.withColumn("_text", keys.lexicographic(rows, P.SPLIT, ["event_id"])).withColumn("_all", F.lit(0))
    scratch = Scratch(spark, "sorted")
    typed = positions.with_position(rows, "_all", [P.SPLIT, "event_id"], scratch, "typed")
    return positions.with_position(typed, "_all", ["_text"], scratch, "lexicographic").select(P.SPLIT, "event_id", "typed", "lexicographic")


@query("select split, event_id, (row_number() over (partition by split order by event_id) - 1) // 500 as job_id from (select event_id, case when event_id % 2 = 0 then 'train' else 'test' end as split from events)")
def shuffle_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.jobs(events_rows(spark, sf_dir).select(P.SPLIT, "event_id"), ["event_id"], 500)


@query("select lang, greatest(16, floor(256000000.0::double / avg(strlen(text))))::bigint as rows_per_file from documents group by lang")
def rowgroup_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(positions.rows_per_file(F.avg(F.octet_length("text"))).alias("rows_per_file"))


@query(
    "with n as (select lang, doc_id, strlen(text)::bigint as size, (row_number() over (partition by lang order by doc_id) - 1) // 50 as file_no from documents) "
    'select lang, doc_id, size, file_no, coalesce(sum(size) over (partition by lang, file_no order by doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from n'
)
def blob_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id", "text")
    out = positions.blob_layout(rows, "lang", ["doc_id"], F.octet_length("text").cast("long"), 50, Scratch(spark, "layout"))
    return out.select("lang", "doc_id", "size", "file_no", "offset")


@query(
    "with recursive d as (select lang, doc_id, strlen(text)::bigint as size, row_number() over (partition by lang order by doc_id) as n from documents), "
    'w(lang, doc_id, size, n, file_no, "offset") as (select lang, doc_id, size, n, 0::bigint, 0::bigint from d where n = 1 union all '
    'select d.lang, d.doc_id, d.size, d.n, w.file_no + case when w."offset" + w.size >= 100000 then 1 else 0 end, case when w."offset" + w.size >= 100000 then 0 else w."offset" + w.size end '
    'from w join d on d.lang = w.lang and d.n = w.n + 1) select lang, doc_id, size, file_no, "offset" from w'
)
def blob_layout_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are closed once they have 100,000 bytes, as the blob writer closes them when one writes a language; tasks begin where a file does."""
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id", F.octet_length("text").cast("long").alias("size"), F.col("text").cast("binary").alias("body"))
    scratch, by = Scratch(spark, "bytes"), ["doc_id", "size"]  # by size too, so that rows of a key are in the same order each time
    sizes = scratch.save(rows.drop("body"), "sizes")
    placed = scratch.save(positions.with_place(positions.key_ordered(sizes, "lang", by, sizes.count() // P.ROWS_PER_PARTITION + 1)), "placed")
    laid = scratch.save(positions.rolled(placed, "lang", "size", 100_000), "layout")
    cut = positions.cuts(laid, "lang", by, F.coalesce("size", F.lit(0)) + positions.ROW_BYTES, positions.TASK_BYTES, F.col("_first"))
    scratch.drop(sizes, placed, laid)
    ordered = positions.dealt(rows, "lang", by, cut).drop("size")
    written = blobs.write_blobs(ordered, ["body"], scratch.path("blobs"), "lang", None, 100_000).withColumn("_at", F.monotonically_increasing_id())
    p = scratch.save(written, "pointers").select("lang", "doc_id", "_at", pointers.unpack(F.col("body")).alias("p"))
    firsts = p.groupBy(F.col("lang").alias("_l"), F.col("p.file_id").alias("_f")).agg(F.min("_at").alias("_at"))
    firsts = positions.with_position(firsts, "_l", ["_at"], scratch, "file_no").drop("_at")
    out = p.join(firsts, (F.col("lang") == F.col("_l")) & (F.col("p.file_id") == F.col("_f")))
    return out.select("lang", "doc_id", F.col("p.size").alias("size"), "file_no", F.col("p.offset").alias("offset"))


def splits(spark: SparkSession, sf_dir: str) -> list[str]:
    """Of the documents: their languages, a few."""
    return [r.lang for r in table(spark, sf_dir, "documents").select("lang").distinct().orderBy("lang").collect()]


@query("select lang, doc_id, text, strlen(text)::bigint as n_bytes from documents")
def blob_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [dataset(spark, sf_dir, "documents", lang, columns=["doc_id", "body"]).df.withColumn("lang", F.lit(lang)) for lang in splits(spark, sf_dir)]
    return reduce(DataFrame.unionByName, found).select("lang", "doc_id", F.decode("body", "UTF-8").alias("text"), F.octet_length("body").cast("long").alias("n_bytes"))


@query("select doc_id, md5(text) as digest from documents where source = 'src3'")
def blob_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects as bytes, without codecs; only the blobs of rows that pass the filter are read."""
    found = [dataset(spark, sf_dir, "documents", lang, columns=["doc_id", "body"], filters=[("source", "=", "src3")], raw=True).df for lang in splits(spark, sf_dir)]
    return reduce(DataFrame.unionByName, found).select("doc_id", F.md5("body").alias("digest"))


@query("select doc_id, lang, source from documents where lang = 'en'")
def pointer_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blob columns alone are pointers, 29 bytes each; with the keys they join the others again."""
    found = dataset(spark, sf_dir, "documents", "en", columns=["doc_id", "body"])
    own = found.pointers().where(F.octet_length("body") == 29).select("doc_id")
    return own.join(dataset(spark, sf_dir, "documents", "en").metadata(), "doc_id").select("doc_id", "lang", "source")


@query("select split, job_id, count(*) as n, min(event_id) as first, max(event_id) as last from (select split, event_id, (row_number() over (partition by split order by event_id) - 1) // 500 as job_id from (select event_id, case when event_id % 2 = 0 then 'train' else 'test' end as split from events)) group by all")
def job_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs run on the executors; each returns one row."""
    import pandas as pd

    rows = events_rows(spark, sf_dir).select(P.SPLIT, "event_id")
    work = lambda pdf: pd.DataFrame({"n": [len(pdf)], "first": [pdf["event_id"].iloc[0]], "last": [pdf["event_id"].iloc[-1]]})
    return staging.run_jobs(rows, ["event_id"], work, "n long, first long, last long", 500)


@query("select split, key, row_number() over (order by split || '//' || key) - 1 as pos, location, size from (select case when c_custkey % 2 = 0 then 'train' else 'test' end as split, c_custkey::varchar as key, 'at/' || c_custkey as location, c_custkey * 3 as size from customer)")
def metadata_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of staged rows in a key-value store, spread over shards, merged in order of their keys as text."""
    from .plans.metadata import KeyValueMetadata, MemoryClient, Note

    store, id = KeyValueMetadata(MemoryClient(), page=100), DatasetID("customers", "1.0.0")
    rows = table(spark, sf_dir, "customer").select("c_custkey").toLocalIterator()
    store.save(id, (Note("train" if r.c_custkey % 2 == 0 else "test", (r.c_custkey,), f"at/{r.c_custkey}", r.c_custkey * 3) for r in rows))
    return spark.createDataFrame([(n.split, str(n.keys[0]), i, n.location, n.size) for i, n in enumerate(store.scan_sorted(id))], "split string, key string, pos long, location string, size long")


@query("select doc_id, '00112233-4455-6677-8899-aabbccddeeff' as file_id, doc_id * 65537 as \"offset\", strlen(text)::bigint as size, 29 as length from documents")
def pointer_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    packed = rows.select("doc_id", pointers.pack(F.lit("00112233-4455-6677-8899-aabbccddeeff"), F.col("doc_id") * 65537, F.octet_length("text")).alias("p"))
    return packed.select("doc_id", pointers.unpack(F.col("p")).alias("u"), F.octet_length("p").alias("length")).select("doc_id", "u.*", "length")


@query("select lang, sum(strlen(text))::bigint as blob_bytes from documents group by lang")
def dataset_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of blob files only: the index's bytes depend on its encoding."""
    return spark.createDataFrame([(lang, dataset(spark, sf_dir, "documents", lang).blob_bytes()) for lang in splits(spark, sf_dir)], "lang string, blob_bytes long")


@query("select vec_id, len(embedding)::int as n, len(embedding) = 64 as fits, list_sum(embedding[1:1])::double as first from embeddings")
def numpy_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays to .npy bytes and back."""
    rows = table(spark, sf_dir, "embeddings")
    stored = rows.select("vec_id", arrays.fits_length(F.col("embedding"), 64).alias("fits"), arrays.encode_npy(F.col("embedding")).alias("npy"))
    decoded = stored.select("vec_id", "fits", arrays.decode_npy(F.col("npy")).alias("a"))
    return decoded.select("vec_id", F.element_at("a.shape", 1).alias("n"), "fits", F.element_at("a.values", 1).alias("first"))


@query("select vec_id, (pos - 1)::int as pos, embedding[pos]::float as value from (select vec_id, embedding, generate_subscripts(embedding, 1) as pos from embeddings)")
def array_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "value"))


@query("select 'doc_id' as path, count(*) filter (d.doc_id is null) as nulls from documents d union all select 'quality', count(*) filter (quality is null) from documents d left join labels using (doc_id) union all select 'toxic', count(*) filter (toxic is null) from documents d left join labels using (doc_id)")
def validate_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    schema = DatasetSchema([LongField("doc_id"), IntField("quality"), IntField("toxic")], ["doc_id"])
    return frames.violations(frames.conform(rows, schema), schema)


@query("select event_id, null::double as score, null::varchar as note from events")
def optional_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = DatasetSchema([LongField("event_id"), DoubleField("score", required=False), StringField("note", required=False)], ["event_id"])
    return frames.conform(table(spark, sf_dir, "events").select("event_id"), schema)


@query("select c_custkey, c_name, n_name, n_regionkey from customer join nation on c_nationkey = n_nationkey")
def nested_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record column through the engine: written, read, and taken apart."""
    nation = RecordField("nation", [StringField("n_name"), IntField("n_regionkey")])
    schema = DatasetSchema([LongField("c_custkey"), StringField("c_name"), nation], ["c_custkey"])
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select(F.lit("all").alias(P.SPLIT), "c_custkey", "c_name", F.struct("n_name", "n_regionkey").alias("nation"))
    layout, id = Layout(Scratch(spark, "nested").root), DatasetID("customers", "1.0.0")
    P.persist(rows, id, schema, layout)
    return Dataset(spark, layout, id, "all").df.select("c_custkey", "c_name", "nation.n_name", "nation.n_regionkey")


@query(
    "select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem "
    "qualify row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc) = 1"
)
def stage_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key, with a full tie-break."""
    found = staging.latest(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("select event_id, max(value) as value from (select event_id, value from events union all select event_id, value + 1000 from events where event_id % 3 = 0) group by event_id")
def stage_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows staged twice and committed: the later ones win."""
    schema = DatasetSchema([LongField("event_id"), DoubleField("value", required=False)], ["event_id"])
    layout, id = Layout(Scratch(spark, "staged").root), DatasetID("staged", "1.0.0")
    rows = table(spark, sf_dir, "events").select(F.lit("all").alias(P.SPLIT), "event_id", "value")
    staging.stage(rows, id, schema, layout, 1)
    staging.stage(rows.where("event_id % 3 = 0").withColumn("value", F.col("value") + 1000), id, schema, layout, 2)
    staging.commit(spark, id, schema, layout)
    return Dataset(spark, layout, id, "all").df


@query("select event_id, e.user_id, e.value, c.value as clicks_value from events e join (select event_id, value from events where event_type = 'click') c using (event_id) where event_id % 2 = 0")
def join_on_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: datasets with the same keys, joined on them."""
    schema = DatasetSchema([LongField("event_id"), DoubleField("value", required=False)], ["event_id"])
    layout, id = Layout(Scratch(spark, "clicks").root), DatasetID("clicks", "1.0.0")
    P.persist(events_rows(spark, sf_dir).where("event_type = 'click'").select(P.SPLIT, "event_id", "value"), id, schema, layout)
    left = dataset(spark, sf_dir, "events", "train", columns=["event_id", "user_id", "value"])
    return left.join(Dataset(spark, layout, id, "train"))


@query(
    "select * from (values (0, 'doc_id', 'bigint', true, false), (1, 'vector', 'binary', true, true), (2, 'tags', 'array<string>', true, false), (3, 'meta', 'struct<n:int,x:double>', false, false)) t(pos, name, type, required, blob)"
)
def schema_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .schema import dumps, loads

    meta = RecordField("meta", [IntField("n"), DoubleField("x", required=False)], required=False)
    schema = loads(dumps(DatasetSchema([LongField("doc_id"), NumpyField("vector", (64,), "float32"), ArrayField(StringField("tags")), meta], ["doc_id"])))
    return spark.createDataFrame([(i, f.name, f.spark_type().simpleString(), f.required, f.blob) for i, f in enumerate(schema.fields)], "pos int, name string, type string, required boolean, blob boolean")


@query(
    "select * from (values ('split', 's3a://bucket/root/d/1.2.3/train.parquet'), ('schema', 's3a://bucket/root/d/1.2.3/avro_schema.json'), ('assets', 's3a://bucket/root/d/1.2.3/assets'), "
    "('blobs', 's3a://bucket/root/__COLUMN_CONCATENATED_FILES__'), ('own blobs', 's3a://bucket/root/d/__COLUMN_CONCATENATED_FILES__'), ('temporary', 's3a://bucket/root/__TEMP_FILES__/d/1.2.3'), ('mounted', '/mnt/root/d/1.2.3/assets'), ('bucket', 'bucket'), ('key', 'root')) t(what, path)"
)
def path_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, id = "s3a://bucket/root", DatasetID.parse("d/1.2.3")
    layout, mounted = Layout(root), Layout(root, trim="s3a://bucket", replacement="/mnt")
    bucket, key = bucket_key(root)
    rows = [("split", layout.split(id, "train")), ("schema", layout.schema(id)), ("assets", layout.assets(id)), ("blobs", layout.blobs()), ("own blobs", Layout(root, True).blobs("d")), ("temporary", layout.temporary(id)), ("mounted", mounted.assets(id)), ("bucket", bucket), ("key", key)]
    return spark.createDataFrame(rows, "what string, path string")
