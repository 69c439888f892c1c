"""The operators' queries over the whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import knn, minhash, mixing, packing, pq, secrets, suffix, toxicity, urls, warc
from .common import Scratch

#: (host, path, verdict)
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_duplicates(read(spark, sf_dir, "embeddings"), Scratch(spark, "op1"), least=0.98)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), Scratch(spark, "op2"), n_words=2, percent=80)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.rates(read(spark, sf_dir, "documents"), Scratch(spark, "op3"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(read(spark, sf_dir, "documents"), Scratch(spark, "op4"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"), Scratch(spark, "op5"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ", ".join(str(r) for r in URL_RULES)
    rules = spark.sql(f"select * from values {values} as rules(host, path, verdict)")
    return urls.judge(read(spark, sf_dir, "pages"), rules, scratch=Scratch(spark, "op6"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), Scratch(spark, "op7"), tokenizer())


def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"), Scratch(spark, "op8"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return knn.top_k(rows.where("vec_id % 50 = 0"), rows, Scratch(spark, "op9"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), Scratch(spark, "op10"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return toxicity.scored(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_embedding_near_dedup, op2_minhash_near_dedup, op3_source_mixing, op4_suffix_dedup, op5_secret_scan, op6_url_filter, op7_best_fit_packing, op8_warc_round_trip, op9_exact_top_k, op10_toxicity)
    return {f.__name__: f for f in found}


_MIX = """
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents
), per as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as n from sized group by source
), weighed as (
  select *, [5, 2, 1][(n % 3 + 1)::int]::bigint as weight, source_size * 3 as most from per
), ordered as (
  select *, sum(source_size) over () - coalesce(sum(most) over before, 0) as rest, sum(weight) over () - coalesce(sum(weight) over before, 0) as shared
  from weighed window before as (order by most::double / weight, n rows between unbounded preceding and 1 preceding)
), judged as (
  select *, weight::hugeint * rest >= most::hugeint * shared as capped from ordered
), goal as (
  select source, source_size, case when capped then most::double else weight::double
    * (max(case when not capped then rest end) over ())::double / (max(case when not capped then shared end) over ())::double end as target
  from judged
), rated as (
  select doc_id, size, source_size, target, case when source_size > 0 then target / source_size else 0.0 end as rate,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, '')), 1, 13))::bigint::double / 4503599627370496.0 as coin
  from sized join goal on sized.source is not distinct from goal.source
)
select doc_id, size, source_size, target, (size * (floor(rate) + case when coin < rate - floor(rate) then 1 else 0 end))::bigint as taken from rated
"""

_URLS = """
with parts as (
  select page_id, coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', ['host', 'path'], 's'), {'host': '', 'path': ''}) as p from pages
), urls as (
  select page_id, translate(coalesce(p.host, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, coalesce(p.path, '') as path from parts
), rules(rule_host, rule_path, verdict) as (
  values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
)
select page_id, host, path, rule_host || rule_path as rule, coalesce(verdict, 'allow') as verdict
from urls left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
qualify row_number() over (partition by page_id order by length(rule_host || rule_path) desc nulls last) = 1
"""

_NEAR_TEXTS = """
with recursive ws as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents
), runs as (
  select doc_id, case when len(w) < 2 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end as r from ws
), sets as (
  select distinct doc_id, unnest(r) as shingle from runs
), sizes as (
  select doc_id, count(*) as n from sets group by doc_id
), common as (
  select a.doc_id as a, b.doc_id as b, count(*) as n from sets a join sets b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all
), links as (
  select a, b from common c join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c.n >= 80 * (x.n + y.n - c.n)
), reach(node, root) as (
  select a, a from links union select b, root from reach join links on a = node
), least as (
  select node, min(root) as root from reach group by node
)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(root, d.doc_id) as component_id, d.doc_id = coalesce(root, d.doc_id) as kept
from documents d left join sizes using (doc_id) left join least on node = d.doc_id
"""

_WARC = """
with keyed as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), firsts as (
  select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end as first_id from keyed
)
select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from firsts
"""

_TOP_K = """
with floored as (
  select vec_id, list_transform(embedding, lambda x: floor(x::double * 256)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(embedding) > 0
), scored as (
  select q.vec_id as query_id, d.vec_id, list_inner_product(q.v, d.v)::bigint as score
  from floored q join floored d on q.vec_id % 50 = 0 and q.vec_id <> d.vec_id
), ranked as (
  select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

_NEAR_VECTORS = """
with recursive able as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from able a join able b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.98
), reach(node, root) as (
  select a, a from links union select b, root from reach join links on a = node
), least as (
  select node, min(root) as root from reach group by node
), counts as (
  select a, count(*) as n from links group by a
)
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(root, vec_id) as component_id, vec_id = coalesce(root, vec_id) as kept
from embeddings left join least on node = vec_id left join counts on a = vec_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_near_dedup": _NEAR_VECTORS,
        "op2_minhash_near_dedup": _NEAR_TEXTS,
        "op3_source_mixing": _MIX,
        "op6_url_filter": _URLS,
        "op8_warc_round_trip": _WARC,
        "op9_exact_top_k": _TOP_K,
    }
