"""Removal of repeated strings of at least LENGTH bytes, by interval expansion on a Burrows-Wheeler transform.

Every run of LENGTH bytes has an anchor, its GRAM-byte run with the least hash, and equal runs have equal
anchors. So all runs that could be equal meet at anchors of one hash, in the bytes around them (their
contexts); anchors that occur once cannot repeat anything. Equal contexts are repeats of the first of them as
a whole. Different contexts of one hash go to one Burrows-Wheeler transform, where breadth-first backward
extension of intervals sets the common prefixes of neighbouring suffixes by increasing length and stops at
LENGTH: what is not set by then separates nothing, so the suffixes between two set boundaries begin with the
same LENGTH bytes, and all but the first of them (in document order) are repeats.

Skew: each batch of texts sends one row of an anchor hash to be counted, the rest is known to be shared and is dealt
at random. Hashes with more than MOST contexts do not go to one transform: each of their runs becomes a
row, and equal runs are found by grouping on their bytes with partial aggregates. Contexts count as equal if the 64-bit hashes of
both their anchors and themselves are.

Defined cases: a null text is empty. Null doc_ids come after all others. Rows that share a doc_id are
documents of their own, ordered by their text's hash, if their texts differ, and one document if they are equal
(each row gets the same result). Texts shorter than LENGTH stay whole. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .anchors import anchors, gram_hashes
from .common import Scratch, mix, spread_join

LENGTH, GRAM = 100, 32
#: Contexts of one anchor hash that go to one transform; bytes of a transform, about.
MOST, TRANSFORM = 20_000, 1 << 17
#: Bytes of texts whose anchors are found at a time.
GROUP = 1 << 19
_RIGHT = 8  # bits of a context's length after its anchor's start; before it there are as many


def blob(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes one after another, and where each ends."""
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])


def context_hashes(data: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of data[at - left : at + right], from those of GRAM bytes that cover it and its extent."""
    h = gram_hashes(data, GRAM)
    out = left.astype(np.uint64) << np.uint64(8) | right.astype(np.uint64)
    for step in range(0, LENGTH - GRAM + 1, GRAM):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[at - np.maximum(left - step, 0)])
    for step in (*range(0, LENGTH - GRAM + 1, GRAM), LENGTH - GRAM):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[at + np.minimum(step, right - GRAM)])
    return out


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, hash, context, doc, part, at, known) of each anchor.

    at: its position and its context's extent. key deals rows out: one row of each hash in the batch has the hash
    itself as key (and no hash apart from it), the others are known to be shared. known: 0 for that row; 1: the
    batch has other contexts of this hash; 2: a copy of a context of this batch that comes before.
    """
    for batch in batches:
        parts = []
        rows = [(i, t) for i, t in enumerate(x.as_py() for x in batch.column(2)) if t and len(t) >= LENGTH]
        at = 0
        while at < len(rows):
            group, size = [], 0
            while at < len(rows) and (size < GROUP or not group):
                group.append(rows[at])
                size += len(rows[at][1])
                at += 1
            data, ends = blob([t for _, t in group])
            with np.errstate(over="ignore"):
                where, h = anchors(data, ends, LENGTH, GRAM)
                text = np.searchsorted(ends, where, "right")
                starts = np.concatenate([[0], ends[:-1]])[text]
                left = np.minimum(where - starts, LENGTH - GRAM)
                right = np.minimum(ends[text] - where, LENGTH)
                c = context_hashes(data, where, left, right) if len(where) else h
            packed = (where - starts) << (2 * _RIGHT) | left << _RIGHT | right
            parts.append((h, c, np.array([i for i, _ in group])[text], packed))
        if not parts:
            continue
        h, c, row, packed = map(np.concatenate, zip(*parts))
        doc = batch.column(0).to_numpy(zero_copy_only=False)[row]
        part = batch.column(1).to_numpy(zero_copy_only=False)[row]
        absent = np.array(batch.column(3).to_numpy(zero_copy_only=False), bool)[row]
        order = np.lexsort((packed, part, doc, absent, c, h))
        h, c, doc, part, packed, absent = (x[order] for x in (h, c, doc, part, packed, absent))
        first = np.diff(h, prepend=~h[:1]) != 0
        same = ~first
        same[1:] &= np.diff(c) == 0
        copy = same.copy()  # equal rows are one document's
        copy[1:] &= (np.diff(doc) != 0) | (np.diff(part) != 0) | (np.diff(packed) != 0) | (np.diff(absent.astype(np.int8)) != 0)
        again = same & ~copy
        # a row equal to the one before is what that one is
        kind = np.where(copy, 2, np.where(first, 0, 1))
        if again.any():
            source = np.maximum.accumulate(np.where(again, 0, np.arange(len(h))))
            kind = np.where(again, np.where(kind[source] == 2, 2, 1), kind)
        shared = np.zeros(len(h), bool)  # of the rows that are counted: the batch has more of this hash
        shared[:-1] = first[:-1] & ~first[1:]
        with np.errstate(over="ignore"):
            spread = mix(c ^ mix(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + packed.astype(np.uint64)))
        counted = kind == 0
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.where(counted, h, spread).view(np.int64)),
                pa.array(np.where(counted, 0, h.view(np.int64)), mask=counted),
                pa.array(c.view(np.int64)),
                pa.array(doc, mask=absent),
                pa.array(part),
                pa.array(packed),
                pa.array(np.where(counted & shared, 1, kind).astype(np.int8), pa.int8()),
            ],
            ["key", "hash", "context", "doc", "part", "at", "known"],
        )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, doc, part, at, text) for each anchor of a text: the bytes around it."""
    for batch in batches:
        out, size = ([], [], [], [], []), 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["hash", "doc", "part", "at", "text"])

        for doc, part, text, wanted in zip(*(batch.column(i) for i in range(4))):
            doc, part, text = doc.as_py(), part.as_py(), text.as_py()
            for w in wanted.as_py():
                at = w["at"] >> (2 * _RIGHT)
                left, right = w["at"] >> _RIGHT & 255, w["at"] & 255
                for x, v in zip(out, (w["hash"], doc, part, w["at"], text[at - left : at + right])):
                    x.append(v)
            size += len(wanted)
            if size > 20_000:
                yield flush()
                out, size = ([], [], [], [], []), 0
        if size:
            yield flush()


def sorted_suffixes(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` symbols at least; symbols under 512, from seven a word by doubling."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(8, np.uint64)])
    word = np.zeros(n, np.uint64)
    for k in range(7):
        word = word << np.uint64(9) | padded[k : k + n]
    known = 7
    while True:
        order = np.argsort(word)
        if known >= depth:
            return order
        new = np.ones(n, np.int64)
        new[1:] = word[order[1:]] != word[order[:-1]]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(new)
        word = rank << np.uint64(32)
        word[: n - known] |= rank[known:]
        known *= 2


def prefix_boundaries(symbols: np.ndarray, suffixes: np.ndarray, least: int) -> np.ndarray:
    """For suffixes in order: True where one shares fewer than `least` symbols with the one before.

    Symbol 0 separates texts and is never extended by, so this holds between suffixes that have no 0 in their
    first `least` symbols. Breadth-first over the intervals of strings that no boundary has yet been set for: the interval of
    ω, extended by each symbol c that stands before one of its suffixes, gives the intervals of cω, and the
    end of each is a boundary of common prefix |ω| if it is new. Only the intervals with a new boundary go on, to
    the next length. An interval is extended by mapping its members to the suffixes that begin one symbol before them.
    """
    n = len(suffixes)
    before = symbols[suffixes - 1]  # the transform; the text begins with a 0, which is never extended by
    rank = np.empty(n, np.int64)
    rank[np.argsort(before, kind="stable")] = np.arange(n)  # where the suffix with one symbol more stands
    initial = symbols[suffixes]
    boundary = np.zeros(n + 1, bool)
    boundary[0] = True
    begin, end = np.array([0]), np.array([n])
    owner = np.zeros(n, np.int32)
    for _ in range(least):
        size = end - begin
        total = int(size.sum())
        if not total:
            break
        which = np.repeat(np.arange(len(size), dtype=np.int32), size)
        members = np.arange(total) + np.repeat(begin - (np.cumsum(size) - size), size)
        able = before[members] != 0
        to = rank[members[able]]
        owner[to] = which[able]
        if total > n // 6:
            mark = np.zeros(n, bool)
            mark[to] = True
            to = np.flatnonzero(mark)
        else:
            to = np.sort(to)
        if not len(to):
            break
        mine, first = owner[to], initial[to]
        cut = np.flatnonzero((np.diff(to) != 1) | (np.diff(mine) != 0) | (np.diff(first.astype(np.int16)) != 0)) + 1
        starts, stops = to[np.concatenate([[0], cut])], to[np.concatenate([cut - 1, [len(to) - 1]])] + 1
        new = ~boundary[stops]
        boundary[stops] = True
        begin, end = starts[new], stops[new]
    return boundary[:n]


def repeated_runs(texts: list[bytes], order: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, begin, end) of maximal runs that strings of `length` bytes cover which occur earlier.

    order[i] ranks text i's first byte; bytes of equal rank are the same byte, in texts that are windows
    of one document.
    """
    lengths = np.array([len(t) for t in texts])
    firsts = np.cumsum(lengths + 1) - lengths  # one 0 before each text
    symbols = np.frombuffer(b"\0" + b"\0".join(texts) + b"\0", np.uint8).astype(np.int16)
    symbols += 1
    symbols[np.concatenate([firsts - 1, [len(symbols) - 1]])] = 0
    suffixes = sorted_suffixes(symbols, length)
    group = np.cumsum(prefix_boundaries(symbols, suffixes, length))
    of = np.repeat(np.arange(-1, len(texts)), np.concatenate([[1], lengths[:-1] + 1, [lengths[-1] + 1]]))  # each symbol's text
    of = of[suffixes]
    valid = of >= 0
    offset = suffixes - firsts[of]
    valid &= offset + length <= lengths[of]
    group, of, offset = group[valid], of[valid], offset[valid]
    if not len(group):
        return (np.zeros(0, np.int64),) * 3
    rank = order[of] + offset
    start = np.flatnonzero(np.diff(group, prepend=-1))
    earliest = np.minimum.reduceat(rank, start)
    late = rank > np.repeat(earliest, np.diff(np.append(start, len(group))))
    at = np.sort(firsts[of[late]] + offset[late])
    cut = np.flatnonzero(np.diff(at, prepend=-length - 1) > length)  # texts are further apart than that, as a string ends in its text
    begin, end = at[cut], at[np.append(cut[1:] - 1, len(at) - 1)[: len(cut)]] + length
    text = np.searchsorted(firsts, begin, "right") - 1
    return text, begin - firsts[text], end - firsts[text]


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, part, begin, end) of repeats, from contexts sorted by hash; a hash's contexts share a transform."""
    held: list[pa.RecordBatch] = []
    size = 0

    def solve(rows: pa.RecordBatch) -> pa.RecordBatch:
        absent = np.array(rows.column(1).is_null())
        doc, part, at = (rows.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        begin = (at >> (2 * _RIGHT)) - (at >> _RIGHT & 255)
        # a rank for each text's first byte that leaves room for those after it and keeps those of one document in step
        by = np.lexsort((begin, part, doc, absent))
        same = (np.diff(doc[by]) == 0) & (np.diff(part[by]) == 0) & (np.diff(absent[by].astype(np.int8)) == 0)
        step = np.where(same, np.minimum(np.diff(begin[by]), 1 << 10), 1 << 10)
        order = np.empty(len(by), np.int64)
        order[by] = np.concatenate([[0], np.cumsum(step)])
        text, a, b = repeated_runs(rows.column(4).to_pylist(), order, LENGTH)
        return pa.RecordBatch.from_arrays([rows.column(1).take(pa.array(text)), pa.array(part[text]), pa.array(begin[text] + a), pa.array(begin[text] + b)], ["doc", "part", "begin", "end"])

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        total = np.concatenate([[0], np.cumsum(pc.binary_length(batch.column(4)).to_numpy())])
        hashes = batch.column(0).to_numpy()
        starts = np.flatnonzero(np.diff(hashes)) + 1  # of further hashes
        if held and held[-1].column(0)[-1].as_py() != hashes[0]:
            starts = np.append(0, starts)
        at = 0
        while len(starts := starts[np.searchsorted(total[starts], total[at] + TRANSFORM - size) :]):
            if starts[0] > at:
                held.append(batch.slice(at, starts[0] - at))
            yield solve(joined())
            held, size, at = [], 0, int(starts[0])
            starts = starts[1:]
        held.append(batch.slice(at))
        size += int(total[-1] - total[at])
    if held:
        yield solve(joined())


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, doc, part, begin) for each run of LENGTH bytes of a context."""
    for batch in batches:
        rows: tuple[list, ...] = ([], [], [], [])
        for doc, part, at, text in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
            begin = (at >> (2 * _RIGHT)) - (at >> _RIGHT & 255)
            for i in range(len(text) - LENGTH + 1):
                for x, v in zip(rows, (text[i : i + LENGTH], doc, part, begin + i)):
                    x.append(v)
            if len(rows[0]) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.binary(), pa.int64(), pa.int64(), pa.int64()))], ["run", "doc", "part", "begin"])
                rows = ([], [], [], [])
        if rows[0]:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.binary(), pa.int64(), pa.int64(), pa.int64()))], ["run", "doc", "part", "begin"])


def _identified(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, part, text): text as bytes; part tells apart rows without doc_id or with one that others have too."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")).alias("text"))
    own = F.xxhash64("text")
    several = scratch.save(rows.where("doc is not null").groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc").alias("_again")), "several")
    if not several.limit(1).count():
        return rows.select("doc", F.when(F.col("doc").isNull(), own).otherwise(0).alias("part"), "text")
    joined = rows.join(several, F.col("doc") == F.col("_again"), "left")
    return joined.select("doc", F.when(F.col("doc").isNull() | F.col("_again").isNotNull(), own).otherwise(0).alias("part"), "text")


def repeats(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, part, begin, end): byte runs, which may overlap, that repeat earlier ones; rows (doc, part, text)."""
    found = rows.select(F.coalesce("doc", F.lit(0)).alias("doc"), "part", "text", F.col("doc").isNull().alias("absent"))
    found = found.mapInArrow(_anchor_rows, "key long, hash long, context long, doc long, part long, at long, known tinyint")
    found = found.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1 or known > 0")
    known = F.col("known") * F.when(F.col("hash").isNull(), 0).otherwise(1)
    found = scratch.save(found.select(F.coalesce("hash", "key").alias("hash"), "context", "doc", "part", "at", known.alias("known")), "anchors")

    # the first of each context (of each batch) and its copies
    place = (F.col("doc").isNull(), F.col("doc"), F.col("part"), F.col("at"))
    nth = F.rank().over(Window.partitionBy("hash", "context").orderBy(*place))
    found = scratch.save(found.where("known < 2").withColumn("nth", nth).select("hash", "doc", "part", "at", "nth").unionByName(found.where("known = 2").select("hash", "doc", "part", "at", F.lit(2).alias("nth"))), "ranked")
    at = F.shiftrightunsigned("at", 2 * _RIGHT)
    left, right = F.shiftrightunsigned("at", _RIGHT).bitwiseAND(255), F.col("at").bitwiseAND(255)
    copies = found.where("nth > 1").where(left + right >= LENGTH).select("doc", "part", (at - left).alias("begin"), (at + right).alias("end"))
    firsts = found.where("nth = 1").select("hash", "doc", "part", "at").distinct()
    several = firsts.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    firsts = spread_join(firsts, several, "hash").withColumn("hash", F.when(F.col("n") <= MOST, F.col("hash")))

    # their texts
    wanted = firsts.groupBy("doc", "part").agg(F.collect_list(F.struct("hash", "at")).alias("wanted"))
    wanted = wanted.select(F.col("doc").alias("_doc"), F.col("part").alias("_part"), "wanted")
    with_text = rows.join(wanted, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("part") == F.col("_part"))).select("doc", "part", "text", "wanted")
    contexts = scratch.save(with_text.mapInArrow(_contexts, "hash long, doc long, part long, at long, text binary").distinct(), "contexts")
    spans = "doc long, part long, begin long, end long"
    small = contexts.where("hash is not null").repartition("hash").sortWithinPartitions("hash").mapInArrow(_expand, spans)
    large = scratch.save(contexts.where("hash is null").mapInArrow(_windows, "run binary, doc long, part long, begin long"), "windows")
    first = large.groupBy("run").agg(F.min(F.struct(F.col("doc").isNull(), "doc", "part", "begin")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("run").alias("_run"), "first")
    late = F.struct(F.col("doc").isNull(), "doc", "part", "begin") > F.col("first")
    large = large.join(first, F.col("run") == F.col("_run")).where(late).select("doc", "part", "begin", (F.col("begin") + LENGTH).alias("end"))
    return copies.unionByName(small).unionByName(large)


def merged(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of the union of runs."""
    out: list[list[int]] = []
    for i in np.lexsort((end, begin)):
        if out and begin[i] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], int(end[i]))
        else:
            out.append([int(begin[i]), int(end[i])])
    return [(a, b) for a, b in out]


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, digests, texts = [], [], [], [], []
            for text, found in zip(batch.column(1), batch.column(2)):
                text, found = text.as_py(), found.as_py() or []
                spans = merged(np.array([f["begin"] for f in found]), np.array([f["end"] for f in found]))
                stops = [0, *(x for s in spans for x in s), len(text)]
                left = b"".join(text[a:b] for a, b in zip(stops[::2], stops[1::2]))
                n_bytes.append(len(text))
                n_removed.append(len(text) - len(left))
                n_spans.append(len(spans))
                digests.append(hashlib.sha256(left).hexdigest())
                texts.append(left if with_text else None)
            columns = [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(texts, pa.binary())] * with_text, names + ["kept"] * with_text)

    return run


def remove_repeats(docs: DataFrame, scratch: Scratch, with_text: bool = False) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]), one for each document; kept: the remaining bytes."""
    rows = _identified(docs, scratch)
    spans = scratch.save(repeats(rows, scratch), "spans")
    spans = spans.groupBy(F.col("doc").alias("_doc"), F.col("part").alias("_part")).agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    out = rows.join(spans, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("part") == F.col("_part")), "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return out.select("doc", "text", "spans").mapInArrow(_cut(with_text), schema)
