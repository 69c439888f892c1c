"""Best-fit packing of token sequences in bulk-synchronous rounds.

A round takes the pieces of a band of lengths, longest bands first, and all gaps that one of them could fit. Pieces and
gaps are range-sorted together by size; a sweep in that order counts, for each piece, the pieces before it and the
places before it in gaps too small for it. The successor of piece i, the first gap from its size on, is what the sweep has
not passed yet; where several pieces want the same gap, ranks decide: piece i gets place i + max(places passed - rank) over
the pieces up to i. The running maxima of the partitions are put together from one row each. A gap counts as many
places as pieces of the band surely fit it, and one if only some fit. Pieces beyond the last place, the longest, open new
sequences, each filled with them in order while they fit. Then gaps are updated, and the next round follows. There are eight bands, whatever
the corpus's size.

A sequence takes at most `capacity` tokens, so what is grouped by sequence is bounded, and all other steps are sorts, joins on unique
numbers and sums; nothing but counts of bands and a row for each partition comes to the driver.

Ids are those of `tokenizers`. Texts that hold a special token's string, or very long white space, are given to that library;
all others to a faster encoder made of the same file, whose ids are equal there.

Defined cases: a null or empty text is one piece of the id 0. Ties (equal lengths) go by the pieces' row numbers;
repeated rows are packed each, as documents of their own. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions, parts

CAPACITY, END = 2048, 0


# A fixed value: how byte-level tokenizers cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The faster encoder's expression backtracks in white space, and fails from about a million characters of it.
LONG_RUN = 100_000
#: What PATTERN's \s is.
SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


class Encoder:
    """A tokenizer's file; it must be of a byte-level tokenizer whose ids follow its merges, so that ids are ranks."""

    def __init__(self, path: str):
        from tiktoken import Encoding
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, cut = data["model"], data["pre_tokenizer"] or {}
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex") or data["normalizer"] or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError(f"{path} is not of a plain byte-level tokenizer")
        vocabulary = model["vocab"]
        if any(vocabulary["".join(m if isinstance(m, list) else m.split(" "))] != 256 + i for i, m in enumerate(model["merges"])):
            raise ValueError(f"the ids in {path} don't follow its merges")
        # printable bytes stand for themselves, the others for characters from 256 on, in order
        plain = [b for b in range(256) if chr(b).isprintable() and b != 32]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.special = [t["content"] for t in data["added_tokens"]]
        ranks = {bytes(byte_of[c] for c in token): n for token, n in vocabulary.items() if token not in self.special}
        self.fast = Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.library = Tokenizer.from_file(path)
        self.long = re.compile(SPACE + "{%d}" % LONG_RUN)

    def ids(self, text: str) -> list[int]:
        if any(t in text for t in self.special) or len(text) >= LONG_RUN and self.long.search(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@cache
def encoder(path: str) -> Encoder:
    """One for each process."""
    return Encoder(path)


def pieces(ids: bytes, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter if there are several."""
    n = len(ids) // 4
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _tokenize(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        names, types = ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        if with_ids:
            names, types = [*names, "ids"], [*types, pa.binary()]
        for batch in parts(batches, 1):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = np.array([*model.ids(text.as_py() or ""), END], "<u4").tobytes()
                key = doc_id.as_py()
                for k, (s, n) in enumerate(pieces(ids, capacity)):
                    own = ids[4 * s : 4 * (s + n)]
                    rows.append((key, k, s, n, zlib.crc32(own), own)[: len(names)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(names), types)], names)

    return run


def bands(capacity: int) -> list[tuple[int, int]]:
    """(lo, hi): lengths over lo and up to hi, longest first; of the long ones equally many fit a sequence, the last band is of all that are short."""
    edges = [capacity]
    for k in (2, 3, 4, 8, 16, 32, 64):
        if edges[-1] > capacity // k > 0:
            edges.append(capacity // k)
    return [(lo, hi) for hi, lo in zip(edges, [*edges[1:], 0])]


_NONE = -(1 << 62)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, id, n, size) of a partition in order, with its number and, as it counts, the pieces and places before each and the most places over pieces."""
    part, pieces_, places, most = TaskContext.get().partitionId(), 0, 0, _NONE
    for batch in batches:
        if not batch.num_rows:
            continue
        piece, n = batch.column(0).to_numpy() == 0, batch.column(2).to_numpy()
        own, width = piece.astype(np.int64), np.where(piece, 0, n)
        i, c = pieces_ + np.cumsum(own) - own, places + np.cumsum(width) - width
        d = np.maximum(np.maximum.accumulate(np.where(piece, c - i, _NONE)), most)
        pieces_, places, most = int(i[-1] + own[-1]), int(c[-1] + width[-1]), int(d[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), part, np.int32)), *batch.columns, pa.array(i), pa.array(c), pa.array(d)], ["part", "kind", "id", "n", "size", "i", "c", "d"])


def _open(number: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(pid, length, seq, offset) of pieces (pid, length) in order: a sequence takes them while they fit."""
        seq, used = number << 52 | TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            seqs, offsets = [], []
            for n in batch.column(1).to_pylist():
                if used + n > capacity:
                    seq, used = seq + 1, 0
                seqs.append(seq)
                offsets.append(used)
                used += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seqs, pa.int64()), pa.array(offsets, pa.int64())], ["pid", "length", "seq", "offset"])

    return run


#: Pieces of a task that opens sequences, about: each leaves one that is not full, for later rounds.
OPENED = 20_000


#: Pieces and gaps of one range of a sweep, about: rows of five numbers.
SWEPT = 50_000


def fit(pieces_: DataFrame, gaps: DataFrame | None, band: tuple[int, int], capacity: int, number: int, scratch: Scratch, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """One round, the number-th, in so many ranges: (places (pid, length, seq, offset), gaps (seq, gap) after it)."""
    spark, (lo, hi) = scratch.spark, band
    rows = pieces_.where((F.col("length") > lo) & (F.col("length") <= hi)).select(F.lit(0).alias("kind"), F.col("pid").alias("id"), F.col("length").alias("n"), F.col("length").alias("size"))
    if gaps is not None:
        n = F.greatest(F.lit(1), F.floor(F.col("gap") / F.lit(hi))).cast("long")
        rows = rows.unionAll(gaps.where(F.col("gap") > lo).select(F.lit(1), "seq", n, F.least("gap", F.lit(hi)).cast("long")))
    # pieces come before gaps of their size, which fit them
    by = ["size", "kind", "id"]
    rows = rows.repartitionByRange(ranges or partitions(spark), *by).sortWithinPartitions(*by)
    swept = scratch.save(rows.mapInArrow(_sweep, "part int, kind int, id long, n long, size long, i long, c long, d long"), "swept")
    per = swept.groupBy("part").agg(F.count_if(F.col("kind") == 0).alias("i"), F.coalesce(F.sum(F.when(F.col("kind") == 1, F.col("n"))), F.lit(0)).alias("c"), F.max("d").alias("d"))
    starts, count, places, most = [], 0, 0, _NONE
    for r in sorted(per.collect(), key=lambda r: r.part):  # one row for each partition
        starts.append((r.part, count, places, most))
        most = max(most, r.d + places - count) if r.d > _NONE else most
        count, places = count + r.i, places + r.c
    starts = spark.createDataFrame(starts, "_p int, bi long, bc long, bd long")
    ranked = swept.join(F.broadcast(starts), F.col("part") == F.col("_p"))
    i, c = F.col("i") + F.col("bi"), F.col("c") + F.col("bc")
    pieces_ = ranked.where("kind = 0").select(F.col("id").alias("pid"), F.col("n").alias("length"), (i + F.greatest(F.col("d") + F.col("bc") - F.col("bi"), "bd")).alias("slot"))
    new = pieces_.where(F.col("slot") >= places).select("pid", "length").coalesce(max(1, count // OPENED))
    out = new.mapInArrow(_open(number, capacity), "pid long, length long, seq long, offset long")
    last = min(places, count + most) - 1
    if gaps is not None and last >= 0:
        held = ranked.where("kind = 1").select(F.col("id").alias("seq"), F.explode(F.when(c <= last, F.sequence(c, F.least(c + F.col("n") - 1, F.lit(last))))).alias("slot")).join(gaps, "seq")
        found = pieces_.where(F.col("slot") < places).join(held, "slot")
        before = F.sum("length").over(Window.partitionBy("seq").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
        out = found.select("pid", "length", "seq", (capacity - F.col("gap") + F.coalesce(before, F.lit(0))).alias("offset")).unionAll(out)
    out = scratch.save(out, "placed")
    changes = out.select("seq", (-F.col("length")).alias("gap")).unionAll(out.where((F.col("offset") == 0)).select("seq", F.lit(capacity).cast("long")))
    changes = changes if gaps is None else changes.unionAll(gaps)
    after = scratch.save(changes.groupBy("seq").agg(F.sum("gap").alias("gap")).where("gap > 0"), "gaps")
    scratch.drop(*(t for t in (swept, gaps) if t is not None))
    return out, after


def pack(docs: DataFrame, scratch: Scratch, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]), one for each piece.

    tokenizer: the path of a byte-level tokenizer's file, on every executor. ids: little-endian 32-bit numbers.
    """
    scratch = scratch.inner("pack")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = scratch.save(rows.mapInArrow(_tokenize(tokenizer, capacity, with_ids), schema).withColumn("pid", F.monotonically_increasing_id()), "pieces")
    counts = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    places, gaps = [], None
    for number, (lo, hi) in enumerate(bands(capacity)):
        if own := sum(c for n, c in counts.items() if lo < n <= hi):
            # no more gaps than sequences, which longer pieces have opened
            opened = min(sum(c for n, c in counts.items() if n > hi), 2 * sum(n * c for n, c in counts.items() if n > hi) // capacity)
            placed, gaps = fit(rows, gaps, (lo, hi), capacity, number, scratch, 1 + (own + opened) // SWEPT)
            places.append(placed)
    if not places:
        return rows.drop("pid").select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    every = reduce(DataFrame.unionAll, places).select("pid", F.col("seq").alias("sequence_id"), "offset")
    return rows.join(every, "pid").drop("pid")
