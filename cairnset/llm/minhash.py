"""MinHash near-duplicates with odd sketches.

Each text's shingle set gives N_HASHES MinHash samples. Bands of ROWS samples make buckets; the samples,
folded by parity into SKETCH_BITS bits, make an odd sketch, whose XOR population count estimates high
similarities well. Members of a bucket whose sketches are near enough are candidates; links are confirmed
on full shingle sets.

Parameters: 32 bands of 5 samples miss a pair of similarity 0.8 with probability (1 - 0.8**5)**32 = 3e-6.
MAX_POP lets through estimates down to 0.62, five standard deviations below 0.8.

Defined cases: a text without words, and a null text, has an empty set and links with nothing. Equal sets
link. Rows that share a doc_id are one node with the links of all of them, and each row is returned (one without
words with its doc_id as component).
Rows without doc_id link with nothing (component_id null, kept true). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHashes, components, forest, mix, parts, shingle_hashes, spread_join, words

BANDS, ROWS, SKETCH_BITS = 32, 5, 512
N_HASHES = BANDS * ROWS
MAX_POP = 97
#: Bytes of sets that one task compares with each other or with as many more, about.
SET_CHUNK = 4 << 20
#: Members of one chunk of a bucket or group.
CHUNK = 2048

_rng = np.random.default_rng(20240611)
_MULTIPLY = (_rng.integers(0, 2**32, N_HASHES, np.uint32) | np.uint32(1))[:, None]
_ADD = _rng.integers(0, 2**32, N_HASHES, np.uint32)[:, None]


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """Samples by multiplication and addition modulo 2^32 of the (mixed) shingle hashes' upper halves."""
    out = np.full(N_HASHES, np.iinfo(np.uint32).max, np.uint32)
    upper = (shingles >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(upper), 512):  # stays in cache, and bounds memory for very long texts
        x = upper[at : at + 512] * _MULTIPLY
        x += _ADD
        np.minimum(out, x.min(1), out)
    return out.astype(np.uint64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity bitmap of the set {(i, sample i)} as SKETCH_BITS / 64 words."""
    with np.errstate(over="ignore"):
        at = mix(samples + np.arange(N_HASHES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(SKETCH_BITS)
    odd = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def band_keys(samples: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
        for r in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + samples.reshape(BANDS, ROWS)[:, r])
    return key


def _signatures(n_words: int):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in parts(batches, 1):
            ids, sizes, keys1, keys2, bands, sketches = [], [], [], [], [], []
            with np.errstate(over="ignore"):
                for doc_id, text in zip(batch.column(0), batch.column(1)):
                    s = shingle_hashes(hashes.of(words(text.as_py())), n_words)
                    ids.append(doc_id.as_py())
                    sizes.append(len(s))
                    if len(s):
                        d = xxhash.xxh3_128_digest(s)
                        m = minhashes(s)
                        keys1.append(int.from_bytes(d[:8], "little", signed=True))
                        keys2.append(int.from_bytes(d[8:], "little", signed=True))
                        bands.append(band_keys(m).view(np.int64))
                        sketches.append(odd_sketch(m).view(np.int64))
                    else:
                        for x in (keys1, keys2, bands, sketches):
                            x.append(None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys1, pa.int64()), pa.array(keys2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "k1", "k2", "bands", "sketch"],
            )

    return run


def spanning(pdf: pd.DataFrame, neighbours) -> pd.DataFrame:
    """Edges (a, b) that join what is linked in one cell, sorted by rep; neighbours as in forest().

    A cell of two chunks leaves the links inside of a chunk to one cell of that chunk, and else only joins the chunks'
    components, so the edges of a group are few more than its members, into however many chunks it is dealt.
    """
    reps, n = pdf.rep.to_numpy(), len(pdf)
    i, j, chunks = (int(pdf[c].iloc[0]) for c in ("i", "j", "chunks"))
    whole = forest(n, neighbours)
    if i == j:
        a = np.flatnonzero(whole != np.arange(n))
        return pd.DataFrame({"a": reps[a], "b": reps[whole[a]]})
    inside, edges = np.arange(n), []
    for c in (i, j):
        own = np.flatnonzero(pdf.mine.to_numpy() == c)
        inside[own] = own[forest(len(own), lambda p, rest: neighbours(own[p], own[rest]))]
        if j == i + 1 and (c == i or j == chunks - 1):
            a = own[inside[own] != own]
            edges.append((a, inside[a]))
    roots = np.flatnonzero(inside == np.arange(n))
    roots = roots[whole[roots] != roots]
    edges.append((roots, whole[roots]))
    a, b = (np.concatenate(x) for x in zip(*edges))
    return pd.DataFrame({"a": reps[a], "b": reps[b]})


def _near_sketches(pdf: pd.DataFrame) -> pd.DataFrame:
    """Edges of one cell of a bucket: members whose sketches are near. A rep may have several sets."""
    pdf = pdf.drop_duplicates(["rep", "k1"]).sort_values(["rep", "k1"])
    sketches = np.stack(pdf.sketch.to_numpy()).view(np.uint64)
    return spanning(pdf, lambda p, rest: np.bitwise_count(sketches[rest] ^ sketches[p]).sum(1, dtype=np.int64) <= MAX_POP)


def _similar_sets(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Edges of one cell of a group: members whose full sets are similar."""
        pdf = pdf.drop_duplicates(["rep", "digest"]).sort_values(["rep", "digest"])
        sets = [np.frombuffer(x, np.uint64) for x in pdf.shingles]
        sizes = np.array([len(x) for x in sets])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        values, column = np.unique(np.concatenate(sets), return_inverse=True)
        mask = np.zeros(len(values), np.int32)

        def linked(p: int, rest: np.ndarray) -> np.ndarray:
            out = np.zeros(len(rest), bool)
            fits = np.flatnonzero((sizes[rest] * 100 >= percent * sizes[p]) & (sizes[p] * 100 >= percent * sizes[rest]))
            if not len(fits):
                return out
            mine = column[ends[p] : ends[p + 1]]
            mask[mine] = 1
            near = rest[fits]
            total = sizes[near].sum()
            starts = np.cumsum(sizes[near]) - sizes[near]
            where = np.arange(total) + np.repeat(ends[near] - starts, sizes[near])
            both = np.add.reduceat(mask[column[where]], starts)
            mask[mine] = 0
            out[fits] = 100 * both >= percent * (sizes[near] + sizes[p] - both)
            return out

        return spanning(pdf, linked)

    return run


def chunks_of(n: Column) -> Column:
    """Number of chunks for n members."""
    return F.ceil(n / F.lit(float(CHUNK)))


def cells(members: DataFrame, group: str, chunks: str, key: str = "rep") -> DataFrame:
    """Members dealt to cells (group, i, j), so that any two of a group meet in one of them; mine is a member's own chunk.

    chunks is the column with the group's number of chunks; a member goes to one chunk by its key's hash, and
    each pair of chunks makes a cell (a group of one chunk has one cell), so no task gets a whole large group.
    """
    c = F.col(chunks)
    mine = F.pmod(F.xxhash64(key, F.lit(7)), c)
    return (
        members.withColumn("mine", mine)
        .withColumn("_other", F.explode(F.when(c == 1, F.array(F.lit(0).cast("long"))).otherwise(F.filter(F.sequence(F.lit(0).cast("long"), c - 1), lambda x: x != F.col("mine")))))
        .withColumn("i", F.least("mine", "_other"))
        .withColumn("j", F.greatest("mine", "_other"))
        .drop("_other")
    )


def near_duplicates(docs: DataFrame, scratch: Scratch, n_words: int = 5, percent: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept): components of texts whose sets of n_words-word shingles are similar.

    Linked: 100 * |intersection| >= percent * |union|. component_id is the smallest doc_id that links reach.
    """
    scratch = scratch.inner("near")
    signed = scratch.save(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
            _signatures(n_words), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch array<long>"
        ),
        "signatures",
    )
    # one representative for each distinct set
    one = scratch.save(
        signed.where("k1 is not null and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "one"
    )

    # buckets of two or more; those near their first member's sketch need no more comparisons if that is all
    # by the sets' keys, as a doc_id may be the rep of several sets; only edges are of reps
    banded = one.select("rep", "k1", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by("k1", "rep").alias("leader")).where("n > 1")
    members = scratch.save(spread_join(banded.drop("rep"), shared, "bucket"), "members")
    sketches = one.select("k1", "rep", "sketch")
    pop = F.aggregate(F.zip_with("sketch", "lead", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    stars = members.where("k1 <> leader").select("leader", "k1").distinct().join(sketches, "k1")
    stars = spread_join(stars, sketches.select(F.col("k1").alias("leader"), F.col("rep").alias("lead_rep"), F.col("sketch").alias("lead")), "leader")
    stars = scratch.save(stars.select("leader", "k1", "lead_rep", "rep", (pop <= MAX_POP).alias("near")), "stars")
    mixed = members.join(stars.where("not near"), ["leader", "k1"], "left_semi").select("bucket").distinct()
    rest = spread_join(members, mixed, "bucket", "left_semi").join(sketches, "k1").withColumn("chunks", chunks_of(F.col("n")))
    rest = cells(rest.select("bucket", "rep", "k1", "sketch", "chunks"), "bucket", "chunks", "k1")
    near = rest.groupBy("bucket", "i", "j").applyInPandas(_near_sketches, "a long, b long")
    groups = components(scratch, stars.where("near").select(F.col("lead_rep").alias("a"), F.col("rep").alias("b")).unionAll(near))

    # full sets of the candidates; a group too large for a task is dealt to cells
    # a merge join at every size: the groups grow with the input, so the plan must not depend on their being small
    grouped = groups.select(F.col("node").alias("rep"), F.col("component").alias("group")).hint("merge")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).join(grouped, "rep")

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHashes()
        for batch in parts(batches, 1):
            found, digests = [], []
            with np.errstate(over="ignore"):
                for text in batch.column(1):
                    s = shingle_hashes(hashes.of(words(text.as_py())), n_words)
                    digests.append(int.from_bytes(xxhash.xxh3_64_digest(s), "little", signed=True))
                    found.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(digests, pa.int64()), pa.array(found, pa.binary())], ["rep", "group", "digest", "shingles"])

    sets = scratch.save(texts.select("rep", "text", "group").mapInArrow(full_sets, "rep long, group long, digest long, shingles binary"), "sets")
    scratch.keep(signed, one, sets)
    sets = sets.where("octet_length(shingles) > 0")
    sizes = sets.groupBy("group").agg(F.greatest(F.ceil(F.sum(F.octet_length("shingles")) / SET_CHUNK), chunks_of(F.count("*"))).alias("chunks"))
    links = cells(spread_join(sets, sizes, "group"), "group", "chunks").groupBy("group", "i", "j").applyInPandas(_similar_sets(percent), "a long, b long")
    # sets of one doc_id are one node, which has the links of all
    keyed = signed.where("k1 is not null and doc_id is not null").select("doc_id", "k1", "k2")
    several = keyed.groupBy("doc_id").agg(F.min("k1").alias("least"), F.max("k1").alias("most")).where("least <> most").select("doc_id")
    own = spread_join(keyed, several, "doc_id").distinct().join(one.select("k1", "k2", "rep"), ["k1", "k2"]).select("doc_id", F.col("rep").alias("a"))
    own = spread_join(own, own.groupBy("doc_id").agg(F.min("a").alias("b")), "doc_id").select("a", "b")
    found = components(scratch, links.unionByName(own))
    classes = scratch.save(
        one.select("k1", "k2", "rep").join(found, F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("component_id")), "classes"
    )
    scratch.keep(signed, classes)
    # joined on the set's key, so that no row multiplies
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("k1")).alias("k1"), "k2").join(classes, ["k1", "k2"], "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
