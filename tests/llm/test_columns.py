"""Further columns with any names, 64-bit ids beside nulls: the same results from all ten operators and all stages of the pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairnset.llm import knn, minhash, mixing, packing, pq, secrets, suffix, toxicity, urls, warc
from cairnset.llm.common import Scratch
from cairnset.llm.queries import tokenizer

SF = "/root/testdata/sf0.001"
NAMES = """score predicted passages rated _rated _text text_ _base _spans _tokens _assign _access _hex _random _chunks _goal _of _copy of share copy nth _nth _k
rep group hash bucket length size part doc key url_ stack own cell n kind id vector row far i j chunks mine k1 k2 bands sketch component node a b u v m
context at known begin end spans wanted pid seq gap offset slot sequence_id rank query_id grp list code missed digest first refers_to payload toxic found
n_shingles component_id kept n_links n_bytes n_removed n_spans kept_sha256 host path rule verdict target taken source_size copies piece start ids_crc32 _part _place active carried best""".split()
BIG = 2**53 + 1


def widened(df):
    """df with a column of each name that it lacks."""
    return df.select("*", *((F.lit(i) if i % 2 else F.lit("x")).alias(n) for i, n in enumerate(NAMES) if n not in df.columns), F.lit(1).alias("dot.ted"))


def rows(df, columns=None):
    return sorted((tuple(r) for r in (df if columns is None else df.select(*columns)).collect()), key=str)


def documents(spark):
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    texts = [" ".join(words[i % 5 :]) + f" {'token=abcdef1234' if i % 3 else ''} {i % 4}" for i in range(24)] + [None, "", " ".join(words[1:]) + "  1", "x " * 200]
    data = [(BIG + i, t, f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)] + [(None, texts[0], "s1")]
    return spark.createDataFrame(data, "doc_id long, text string, source string")


def vectors(spark):
    data = [(BIG + i if i % 9 else None, [float(i % 4), 1.0 + (i % 3) * 0.01, float(i % 2)], i % 2) for i in range(40)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")


def pages(spark):
    data = [(BIG + i if i else None, f"http://a{i % 3}.example.com/en/{i}", "z" * (100 + i % 4)) for i in range(20)]
    return spark.createDataFrame(data, "page_id long, url string, html string")


def rules(spark):
    return spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block")], "host string, path string, verdict string")


def top(spark, df):
    return knn.top_k(df.where("vec_id % 5 = 0"), df, Scratch(spark, "t"))


OPERATORS = {
    "op1": (vectors, lambda spark, df: pq.near_duplicates(df, Scratch(spark, "t"))),
    "op2": (documents, lambda spark, df: minhash.near_duplicates(df, Scratch(spark, "t"), 2)),
    "op3": (documents, lambda spark, df: mixing.rates(df, Scratch(spark, "t"))),
    "op4": (documents, lambda spark, df: suffix.remove_repeats(df, Scratch(spark, "t"))),
    "op5": (documents, lambda spark, df: secrets.scan(df, Scratch(spark, "t"))),
    "op6": (pages, lambda spark, df: urls.judge(df, rules(spark))),
    "op7": (documents, lambda spark, df: packing.pack(df, Scratch(spark, "t"), tokenizer(), 64).drop("sequence_id", "offset")),
    "op8": (pages, lambda spark, df: warc.round_trip(df, Scratch(spark, "t"))),
    "op9": (vectors, top),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operators(spark, name):
    table, operator = OPERATORS[name]
    plain = operator(spark, table(spark))
    found = rows(plain)
    assert rows(operator(spark, widened(table(spark))), plain.columns) == found
    ids = {r[0] for r in found}
    assert name == "op9" or ids == {r[0] for r in table(spark).select(table(spark).columns[0]).collect()}  # not rounded


def test_toxicity(spark):
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = spark.createDataFrame([(BIG, "ordinary words"), (None, "ordinary words")], "doc_id long, text string").withColumn("source", F.lit("s"))
    plain = real.unionByName(ids)
    model = toxicity.train(widened(plain), widened(labels), Scratch(spark, "t"))
    want = rows(toxicity.scored(plain, toxicity.train(plain, labels, Scratch(spark, "t")), ["doc_id"]).select("doc_id", "score", "predicted"))
    assert rows(toxicity.scored(widened(plain), model, ["doc_id"]).select("doc_id", "score", "predicted")) == want
    assert {BIG, None} <= {r[0] for r in want}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, name):
    stage, plain = dict(corpus_pipeline.STAGES)[name], documents(spark)
    wide = widened(plain)
    out = stage(spark, wide, SF)
    if name == "packing":
        found = ["doc_id", "piece", "start", "length", "ids_crc32"]
        assert rows(out, found) == rows(stage(spark, plain, SF), found)
        return
    assert out.columns == wide.columns
    assert rows(out, plain.columns) == rows(stage(spark, plain, SF))
    for r in out.collect():  # what was in the columns is still there
        assert all(r[n] == (i if i % 2 else "x") for i, n in enumerate(NAMES) if n in wide.columns and n not in plain.columns)
