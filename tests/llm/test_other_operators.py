import hashlib
import io
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairnset.llm import knn, pq, urls, warc
from cairnset.llm.common import Scratch
from cairnset.llm.queries import URL_RULES, oracle_sql, queries
from cairnset.sources.files import total_bytes

from . import brute

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"


def cosine(a, b):
    a, b = np.array(a, float), np.array(b, float)
    return float(a @ b / math.sqrt(a @ a) / math.sqrt(b @ b))


def able(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


# --- embedding near-duplicates


def brute_vectors(rows, least):
    good = [(i, v, k) for i, v, k in rows if i is not None and k is not None and able(v) and any(v)]
    links = [(a, b) for n, (a, v, k) in enumerate(good) for b, w, m in good[:n] if k == m and len(v) == len(w) and cosine(v, w) >= least]
    counts = {i: 0 for i, _, _ in rows}
    for ab in links:
        for x in ab:
            counts[x] += 1
    found = brute.components([i for i, _, _ in rows if i is not None], links)
    return {i: (counts[i], found.get(i)) for i in counts}


def near(spark, rows, least=0.98):
    out = pq.near_duplicates(spark.createDataFrame(rows, VECTORS), Scratch(spark, "t"), least).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    return {r.vec_id: (r.n_links, r.component_id) for r in out}


@pytest.mark.parametrize("hot", [False, True])
def test_vectors_near(spark, monkeypatch, hot):
    """Clusters with links on both sides of the threshold; hot: small chunks deal each list to many cells."""
    if hot:
        monkeypatch.setattr(pq, "chunks_of", lambda n: F.ceil(n / 7))
    r = np.random.default_rng(1)
    rows = []
    for c in range(12):
        centre = r.normal(size=16)
        for _ in range(20):
            v = centre + r.normal(size=16) * r.choice([0.02, 0.1, 0.2]) * np.linalg.norm(centre) / 4
            rows.append((len(rows), [float(np.float32(x)) for x in v * r.uniform(0.1, 10)], int(c % 2)))
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(30)]
    assert near(spark, rows) == brute_vectors(rows, 0.98)


def test_vectors_disk(spark, monkeypatch):
    """Vectors that probe many lists: tables, files and shuffles together stay under six times the vectors, and every link is found."""
    monkeypatch.setattr(pq, "delete", lambda *_: None, raising=False)
    monkeypatch.setattr(Scratch, "keep", lambda *_: None)
    r = np.random.default_rng(3)
    x = r.normal(size=(6000, 64)).astype("float32")
    for a, b, noise in zip(range(0, 600), range(3000, 3600), r.choice([0, 0.1, 0.19, 0.21], 600)):
        x[b] = x[a] + r.normal(size=64) * noise
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, VECTORS).localCheckpoint()

    def shuffled():
        jvm = spark.sparkContext._jvm
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before, scratch = shuffled(), Scratch(spark, "disk")
    got = {i.vec_id: (i.n_links, i.component_id) for i in pq.near_duplicates(frame, scratch).collect()}
    written = total_bytes(spark, scratch.root)
    assert written + shuffled() - before < 6 * x.nbytes
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.98, 1) & (np.arange(6000)[:, None] % 3 == np.arange(6000) % 3))
    counts, found = np.bincount(np.concatenate([a, b]), minlength=6000), brute.components(range(6000), list(zip(a.tolist(), b.tolist())))
    assert counts.sum() > 600 and got == {i: (counts[i], found[i]) for i in range(6000)}


def test_vectors_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 0.0]
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, one, None), (8, one, 1), (9, [2.0, 0.0], 1), (10, one, 2), (11, [-0.0, 1.0], 1), (12, [0.0, 3.0], 1), (13, [1.0], 1), (14, [-1.0, 0.0], 1), (15, [1e-30, 0.0], 1), (16, [1e30, 0.0], 1)]
    want = {i: (0, i) for i in range(1, 17)} | {i: (3, 8) for i in (8, 9, 15, 16)} | {11: (1, 11), 12: (1, 11)}
    assert near(spark, rows) == want
    assert near(spark, []) == {} and near(spark, [(1, None, 1)]) == {1: (0, 1)}


# --- exact top k


def brute_top(queries_, rows, k, scale):
    floors = lambda v: [math.floor(x * scale) for x in v]
    good = [(i, floors(v)) for i, v, _ in rows if i is not None and able(v)]
    out = []
    for q, v in ((i, floors(v)) for i, v, _ in queries_ if i is not None and able(v)):
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def top(spark, queries_, rows, k=5, scale=256.0):
    a, b = (spark.createDataFrame(x, VECTORS) for x in (queries_, rows))
    return sorted(tuple(r) for r in knn.top_k(a, b, Scratch(spark, "t"), k, scale).collect())


@pytest.mark.parametrize("small", [False, True])
def test_top_k(spark, monkeypatch, small):
    """Ties, repeated vectors and clusters; small: blocks of a few rows."""
    if small:
        monkeypatch.setattr(knn, "QUERY_BLOCK", 7)
        monkeypatch.setattr(knn, "CANDIDATE_BLOCK", 40)
    r = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=8) * r.choice([0.1, 1, 3])], 0) for i in range(300)]
    rows += [(400 + i, rows[i % 5][1], 0) for i in range(60)]
    asked = [x for x in rows if x[0] % 10 == 0]
    assert top(spark, asked, rows) == brute_top(asked, rows, 5, 256.0)


def test_top_k_sends_only_what_is_needed(spark):
    """Clusters far apart: a query's neighbours are in its own, so a candidate goes to few of the groups."""
    r = np.random.default_rng(7)
    centres = r.normal(size=(24, 8))
    centres *= 20 / np.linalg.norm(centres, axis=1)[:, None]
    rows = [(i, [float(np.float32(x)) for x in centres[i % 24] + r.normal(size=8) * 0.05], 0) for i in range(960)]
    asked = [x for x in rows if x[0] % 7 == 0]
    scratch = Scratch(spark, "t")
    a, b = (spark.createDataFrame(x, VECTORS) for x in (asked, rows))
    got = sorted(tuple(x) for x in knn.top_k(a, b, scratch, 5, 256.0).collect())
    assert got == brute_top(asked, rows, 5, 256.0)
    sent = next(t for path, t in scratch.tables.items() if "/sent-" in path)
    pairs = sent.groupBy("grp").count().collect()
    assert len(pairs) > 3 and sum(x["count"] for x in pairs) < 0.5 * len(rows) * len(pairs)


def test_top_k_repeated_queried_ids(spark):
    """Rows of one queried id, equal ones and others, are more than k and nearer than all candidates."""
    r = np.random.default_rng(3)
    vector = lambda: [float(np.float32(x)) for x in r.normal(size=8)]
    rows = [(50, vector(), 0)] * 6 + [(i, vector(), 0) for i in range(39)]
    assert top(spark, rows[:1], rows) == brute_top(rows[:1], rows, 5, 256.0)
    # the rows of an id in cells of their own
    rows = [(50, [10.0 + i, 1.0], 0) for i in range(7) for _ in range(i + 1)] + [(i, [-10.0 - i, 1.0], 0) for i in range(30)]
    asked = [x for x in rows if x[0] in (50, 7)]
    assert top(spark, asked, rows) == brute_top(asked, rows, 5, 256.0)


def test_top_k_defined_cases(spark):
    rows = [(1, [1.0, 2.0], 0), (2, None, 0), (3, [], 0), (4, [float("nan"), 1.0], 0), (5, [None, 1.0], 0), (6, [0.0, 0.0], 0), (7, [3.0], 0), (None, [1.0, 1.0], 0)]
    assert top(spark, rows, rows) == brute_top(rows, rows, 5, 256.0)
    assert top(spark, rows, []) == [] and top(spark, [], rows) == [] and top(spark, rows[:1], rows[:1]) == []


# --- url filters


URLS = [None, "", "no url", "http://EXAMPLE.com/en/x", "http://www.example.com/en/x?y#z", "https://www.example.com/fr/", "http://a.net/fr/#x", "http://net/es/", "x://net?/es/", "http://badexample.com/en/", "http://example.com", "http://x.www.example.com/en/", "a://b://c.net/fr/", "http://example.com./en/", "http://.com/", "http://münchen.net/es/ü", "http://example.com:80/en/", "http://com/", "\nhttp://net/fr/\nx"]


def brute_url(url, rules, otherwise="allow"):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, otherwise))
    return host, path, best[2], best[3]


def test_urls(spark):
    r = random.Random(3)
    names = ["a", "b", "com", "net", "ab"]
    rules = URL_RULES + [(".".join(r.choices(names, k=r.randint(1, 3))), r.choice(["", "/", "/a", "/a/b"]), r.choice(["allow", "block"])) for _ in range(40)]
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    found = URLS + ["http://" + ".".join(r.choices(names, k=r.randint(1, 5))) + r.choice(["", "/", "/a", "/a/b/c", "/ab"]) for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(found)) + [(0, None)], "page_id long, url string").withColumn("rule", F.lit(1))
    out = urls.judge(pages, spark.createDataFrame(rules + [(None, "/", "allow"), ("com", None, "allow")], "host string, path string, verdict string")).collect()
    assert len(out) == len(found) + 1
    for x in out:
        assert (x.host, x.path, x.rule, x.verdict) == brute_url(found[x.page_id], rules), found[x.page_id]
    none = urls.judge(pages, spark.createDataFrame([], "host string, path string, verdict string"), "block")
    assert {(x.rule, x.verdict) for x in none.collect()} == {(None, "block")}


# --- archives


def test_archives(spark):
    rows = [(i, f"http://x/{i} \n", "z" * (99 + i % 2) + str(i % 4) if i % 5 else None) for i in range(40)] + [(50, None, "é" * 60), (51, "u", "é" * 60), (2**60, "u", "é" * 60), (None, "u", "q"), (-5, "u", "é" * 60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    out = warc.round_trip(pages, Scratch(spark, "t")).collect()
    first = {}
    for i, _, h in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        first.setdefault(h or "", i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = i is not None and len(data) >= 100 and first[h or ""] != i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[h or ""] if again else None))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0), Scratch(spark, "t")).count() == 0


def archive(n=50, target=1 << 20):
    r = random.Random(4)
    payloads = [bytes(r.choices(range(256), k=r.randint(0, 3000))) for _ in range(n)]
    records = [warc.encode_record(i, f"http://h/{i}", p, hashlib.sha256(p).hexdigest(), None) for i, p in enumerate(payloads)]
    archives, out = [], b""
    for piece, _ in warc.encode_archive(records, target):
        if not piece:
            archives.append(out)
            out = b""
        out += piece
    return payloads, archives


def test_archive_round_trip_and_rollover():
    payloads, archives = archive()
    got = [b for a in archives for _, b in warc.read_archive(io.BytesIO(a))]
    assert got == payloads and len(archives) == 1
    assert struct.unpack("<I", archives[0][:4])[0] == warc.SKIPPABLE


@pytest.mark.parametrize("damage", [lambda a: a[:-3], lambda a: b"\0" + a[1:], lambda a: a[:20], lambda a: a[: len(a) // 2] + bytes([a[len(a) // 2] ^ 255]) + a[len(a) // 2 + 1 :]])
def test_damaged_archives_are_refused(damage):
    with pytest.raises(Exception):
        list(warc.read_archive(io.BytesIO(damage(archive()[1][0]))))


@pytest.mark.parametrize("change", [(b"WARC/1.1", b"WARC/9.9"), (b"Content-Length: 3", b"Content-Length: 4"), (b"WARC-Type", b"WARC-Tape"), (b"WARC-Date: ", b"WARC-Date "), (b"Content-Type: text/html", b"WARC-Type: response")])
def test_bad_records_are_refused(change):
    good = warc.encode_record(1, None, b"abc", "0", None)
    assert warc.decode_record(good)[1] == b"abc"
    with pytest.raises(ValueError):
        warc.decode_record(good.replace(*change))


def test_wrong_digests_are_refused():
    headers, block = warc.decode_record(warc.encode_record(1, None, b"abc", "0" * 64, None))
    with pytest.raises(ValueError):
        warc.checked_row(headers, block)


# --- queries with SQL


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    found = con.execute(oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r)) for r in df.select(*columns).collect())


# --- the pipeline


def test_pipeline(spark):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    scratch, rows = Scratch(spark, "t"), docs
    for name, stage in corpus_pipeline.STAGES:
        before, rows = rows, scratch.save(stage(spark, rows, SF), name)
        kept[name] = rows
        if name != "packing":
            assert rows.columns == docs.columns
        if name == "near_duplicates":
            near = brute.near_texts([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in rows.collect()} == {c for _, c in near.values()}
        if name == "secrets":
            texts = {r.doc_id: r.text for r in before.collect()}
            for r in rows.collect():
                assert (r.text == texts[r.doc_id]) == (not brute.secrets(texts[r.doc_id])[3] and "[SECRET]" not in r.text)
                assert not brute.secrets(r.text)[3]
    assert docs.count() - kept["toxicity"].count() < 30
    mixed = [r for r in kept["mixing"].collect()]
    counts = {}
    for r in mixed:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    packed = kept["packing"].collect()
    assert {d: sum(r.piece == 0 for r in packed if r.doc_id == d) for d in counts} == counts
    places = {}
    for r in packed:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 2048 and sorted(o for o, _ in p)[0] == 0 for p in places.values())



def test_pipeline_keeps_rows_without_id(spark):
    docs = spark.createDataFrame([(None, "alpha beta gamma delta epsilon"), (1, "alpha beta gamma delta epsilon"), (2, "alpha beta gamma delta epsilon"), (1, "other words stand here now")], "doc_id long, text string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "None"]
