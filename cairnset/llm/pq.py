"""Embedding near-duplicates by product quantisation.

Unit vectors go to the inverted list of their nearest coarse centre; their residuals are coded by one of 256
codewords in each of M subspaces. A vector probes its own list and every list that can hold a neighbour: if
|x - y| <= r and y is nearer to centre c than to x's centre h, then (|x-c|^2 - |x-h|^2) / (2 |c-h|) <= r. In
each list, the codes' words, looked up, give y's reconstruction and x's distance to it; with y's coding error e,
every neighbour has a distance of at most r + e. What passes is scored by exact cosine in doubles. So probes and
distances are sufficient: the result is that of brute force (the tests measure recall 1).

A vector may probe half of all lists, so vectors aren't sent to the lists that they probe. They are sorted by
label and list once, into blocks of files in the shared folder: codes, whole vectors, and bits of the lists that each
vector probes. A task takes one block's vectors through the codes of blocks from there on, where both of a pair probe the
other's list, and reads of those blocks only the whole vectors that the codes leave. So each vector is written
a fixed number of times, whatever number of lists it probes; its bits take a byte for eight lists, at most COLUMNS / 8 bytes.

The model is fitted on at most SAMPLE vectors; every vector is indexed. Lists grow with the square root of the vectors.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and rows without
label or vec_id, link with nothing; so do vectors of different lengths. Equal vectors are compared once and
count as often as they occur; rows that share a vec_id count one by one and are one node. Other columns are not read.
"""

from __future__ import annotations

import io
import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import arrow_options, arrow_store, delete
from .common import Scratch, components, tidy
from .minhash import chunks_of
from .vectors import finite, kmeans, matrix, nearest, sample

SAMPLE, SUBSPACES, CODEWORDS = 16384, 8, 256
#: Numbers of one block of distances to all centres.
BLOCK = 1 << 20
#: Chunks of one block of files, and bytes of its vectors as doubles, at most about.
CHUNKS, BLOCK_BYTES = 8, 8 << 20
#: Rows whose distances to others are taken at once: whole lists until FEW are together, at most MOST.
FEW, MOST = 256, 1024
#: Columns of a block's bits of probes, at most: neighbouring lists share one if there are more.
COLUMNS = 1024
#: Tasks' shares of pairs of blocks, about, besides one for each block; tasks at most.
SHARES, TASKS = 4096, 2048


class Model:
    def __init__(self, x: np.ndarray, n: int):
        width = x.shape[1]
        self.m = min(SUBSPACES, width)
        self.cuts = np.linspace(0, width, self.m + 1).astype(int)
        self.coarse = kmeans(x, max(1, min(round(math.sqrt(n) / 4), len(x))))
        residual = x - self.coarse[nearest(x, self.coarse)]
        self.words = [kmeans(residual[:, a:b], CODEWORDS, 4) for a, b in zip(self.cuts, self.cuts[1:])]

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the lengths of what they miss."""
        residual = x - self.coarse[home]
        codes = np.empty((len(x), self.m), np.uint8)
        missed = np.zeros(len(x))
        for k, (a, b) in enumerate(zip(self.cuts, self.cuts[1:])):
            codes[:, k] = nearest(residual[:, a:b], self.words[k])
            missed += ((residual[:, a:b] - self.words[k][codes[:, k]]) ** 2).sum(1)
        return codes, np.sqrt(missed)

    def decode(self, codes: np.ndarray, home: np.ndarray) -> np.ndarray:
        """The vectors that the codes stand for."""
        return self.coarse[home] + np.concatenate([w[codes[:, k]] for k, w in enumerate(self.words)], 1)

    @property
    def shared(self) -> int:
        """Lists of one column of bits."""
        return math.ceil(len(self.coarse) / COLUMNS)

    def probes(self, x: np.ndarray, home: np.ndarray, radius: float) -> np.ndarray:
        """Bits of a row for each column of lists: which unit vectors may have a neighbour in one of them; eight vectors a byte."""
        c2, out = (self.coarse**2).sum(1), []
        for at in range(0, len(x), step := max(1, BLOCK // len(c2))):
            own = home[at : at + step]
            d2 = 1 + c2 - 2 * x[at : at + step] @ self.coarse.T
            homes, of = np.unique(own, return_inverse=True)
            apart = np.sqrt(np.maximum(c2[homes][:, None] + c2 - 2 * self.coarse[homes] @ self.coarse.T, 1e-30))[of]
            near = ((d2 - d2[np.arange(len(own)), own][:, None]) / (2 * apart) <= radius + 1e-7) | (apart < 1e-6)
            out.append(np.logical_or.reduceat(near, np.arange(0, len(c2), self.shared), axis=1))
        return np.packbits(np.concatenate(out).T, axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _padded(values: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Rows of these sizes, one after the other in values, as doubles padded with zeros to the width."""
    if (sizes == width).all():
        return values.astype(np.float64).reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _index(model: Model, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector with its list, code and the length that its code misses."""
        step = max(1, BLOCK // max(width, len(model.coarse)))
        for batch in (whole.slice(at, step) for whole in batches for at in range(0, whole.num_rows, step)):
            vector = batch.column("vector")
            x = _unit(_padded(vector.flatten().to_numpy(), np.diff(vector.offsets.to_numpy()), width))
            home = nearest(x, model.coarse)
            codes, missed = model.encode(x, home)
            more = [pa.array(home.astype("int32")), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(missed)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "list", "code", "missed"])
        tidy()

    return run


def _write(model: Model, width: int, radius: float, folder: str, options: dict, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's rows, sorted, as blocks of at most `most`; a row for each: where it stands, its name, its first and last kind."""
        system, base = arrow_store(folder, options)
        system.create_dir(base, recursive=True)
        part, nth, held = TaskContext.get().partitionId(), 0, []

        def flush() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            kind, vector = t["kind"].to_pylist(), t["vector"].chunk(0)
            starts = [k for k in range(len(kind)) if not k or kind[k] != kind[k - 1]]
            columns = {c: t[c].to_numpy() for c in ("rep", "n", "list", "missed")}
            name, out = uuid.uuid4().hex, io.BytesIO()
            code = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(len(kind), model.m)
            text = np.frombuffer(json.dumps([(kind[k], k) for k in starts]).encode(), np.uint8)
            values, size = vector.flatten().to_numpy(), np.diff(vector.offsets.to_numpy())
            np.savez(out, kinds=text, code=code, size=size, **columns)
            probes = model.probes(_unit(_padded(values, size, width)), columns["list"], radius)
            for suffix, data in (("codes", out.getbuffer()), ("vectors", values.tobytes()), ("probes", probes.tobytes())):
                with system.open_output_stream(f"{base}/{name}.{suffix}", compression=None) as stream:
                    stream.write(data)
            return pa.RecordBatch.from_pylist([{"part": part, "nth": nth, "name": name, "first": kind[0], "last": kind[-1]}])

        for batch in batches:
            while batch.num_rows:
                room = most - sum(b.num_rows for b in held)
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(b.num_rows for b in held) == most:
                    yield flush()
                    nth += 1
        if held:
            yield flush()
        tidy()

    return run


class Block:
    """A block of files: codes in memory, vectors and bits of probes read where they are asked for."""

    def __init__(self, store: tuple, name: str, width: int, dtype: str):
        (self.system, base), self.width, self.dtype = store, width, np.dtype(dtype)
        self.path = f"{base}/{name}"
        with self.system.open_input_stream(f"{base}/{name}.codes", compression=None) as stream:
            data = np.load(io.BytesIO(stream.read()))
        self.rep, self.n, self.list, self.missed, self.code, self.size = (data[c] for c in ("rep", "n", "list", "missed", "code", "size"))
        starts = json.loads(data["kinds"].tobytes())
        self.kinds = {kind: (a, b) for (kind, a), b in zip(starts, [*(k for _, k in starts[1:]), len(self.rep)])}
        self.at = np.concatenate([[0], np.cumsum(self.size, dtype=np.int64)]) * self.dtype.itemsize

    def _read(self, suffix: str, a: int, b: int) -> bytes:
        with self.system.open_input_file(f"{self.path}.{suffix}") as file:
            return file.read_at(int(b - a), int(a))

    def vectors(self, a: int, b: int) -> np.ndarray:
        """Unit vectors of the rows a to b."""
        return _unit(_padded(np.frombuffer(self._read("vectors", self.at[a], self.at[b]), self.dtype), self.size[a:b], self.width))

    def probes(self, a: int, b: int) -> np.ndarray:
        """Bits of the columns a to b."""
        row = -(-len(self.rep) // 8)
        return np.frombuffer(self._read("probes", a * row, b * row), np.uint8).reshape(-1, row)


def _pieces(lists: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of sorted lists' rows: whole lists until FEW rows are together, at most MOST rows."""
    start = 0
    for end in [*(np.flatnonzero(np.diff(lists)) + 1).tolist(), len(lists)]:
        if end - start >= FEW or end == len(lists):
            yield from ((at, min(end, at + MOST)) for at in range(start, end, MOST))
            start = end


def _rows(bits: np.ndarray, columns: np.ndarray, a: int, b: int) -> np.ndarray:
    """Whether a row from a to b has a bit in one of the columns."""
    return np.unpackbits(np.bitwise_or.reduce(bits[columns], axis=0), count=b)[a:].view(bool)


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of a[i] and b[i]; root holds each member's least one."""
    while True:
        a, b = root[a], root[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def _links(model: Model, width: int, least: float, radius: float, folder: str, options: dict, names: list[str], dtype: str):
    # what rounding may add: to products of single precision, and of double precision
    rough, fine = (width + 16) * 2.0**-22, (width + 16) * 2.0**-51

    def share(store: tuple, i: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
        """Links of block i with the blocks from low to high: counts for each vector, and only spanning edges."""
        left = Block(store, names[i], width, dtype)
        x = left.vectors(0, len(left.rep))
        single = x.astype(np.float32)
        mine = left.probes(0, -(-len(model.coarse) // model.shared))
        root, counts = np.arange(len(x)), np.zeros(len(x), np.int64)

        def meet(right: Block, a: int, b: int, start: int, end: int, groups: list) -> Iterator[pa.RecordBatch]:
            """The rows start to end of a block with groups of those of this one, both only if each may be a neighbour of the other's list."""
            same = right is left
            wanted = _rows(mine, np.unique(right.list[start:end] // model.shared), a, b)
            y = model.decode(right.code[start:end], right.list[start:end])
            y2 = (y**2).sum(1)
            # a neighbour's distance to y's reconstruction is at most the radius and what the code misses
            bound = ((1 + y2 - (radius + 1e-7 + right.missed[start:end]) ** 2) / 2 - rough * (1 + y2)).astype(np.float32)
            y, whole = y.astype(np.float32), None
            first, met = np.full(end - start, -1), np.zeros(end - start, np.int64)
            for low_row, high_row, wants in groups:
                if same and low_row >= end:
                    break
                rows = low_row + np.flatnonzero(wanted[low_row - a : high_row - a])
                cols = np.flatnonzero(wants[start:end])
                if not len(rows) or not len(cols):
                    continue
                near = single[rows] @ y[cols].T >= bound[cols]
                if same and high_row > start:
                    near &= start + cols > rows[:, None]
                if not near.any():
                    continue
                if whole is None:
                    whole = x[start:end] if same else right.vectors(start, end)
                some, to = near.any(1), near.any(0)
                near, rows, to = near[np.ix_(some, to)], rows[some], cols[to]
                cosine = x[rows] @ whole[to].T
                u, v = np.nonzero(near & (np.abs(cosine - least) <= fine))
                for part in range(0, len(u), max(1, BLOCK // width)):  # these in one order of summation, whatever the block
                    uu, vv = u[part : part + max(1, BLOCK // width)], v[part : part + max(1, BLOCK // width)]
                    cosine[uu, vv] = np.einsum("ij,ij->i", x[rows[uu]], whole[to[vv]])
                u, v = np.nonzero(near & (cosine >= least))
                u, v = rows[u], to[v]
                if not len(u):
                    continue
                counts[:] += np.bincount(u, right.n[start + v], len(x)).astype(np.int64)
                if same:
                    counts[:] += np.bincount(start + v, left.n[u], len(x)).astype(np.int64)
                    _merge(root, u, start + v)
                else:
                    met += np.bincount(v, left.n[u], end - start).astype(np.int64)
                    seen, where = np.unique(v, return_index=True)
                    first[seen] = np.where(first[seen] < 0, u[where], first[seen])
                    _merge(root, u, first[v])
            if (hit := np.flatnonzero(first >= 0)).size:
                yield pa.RecordBatch.from_arrays([right.rep[start + hit], left.rep[first[hit]], met[hit]], ["a", "b", "n"])

        for j in range(low, high):
            right = left if j == i else Block(store, names[j], width, dtype)
            from_column = int(left.list.min()) // model.shared
            other = right.probes(from_column, int(left.list.max()) // model.shared + 1)
            for kind in left.kinds.keys() & right.kinds.keys():
                (a, b), (start, end) = left.kinds[kind], right.kinds[kind]
                groups = []
                for low_row, high_row in _pieces(left.list[a:b]):
                    columns = np.unique(left.list[a + low_row : a + high_row] // model.shared) - from_column
                    groups.append((a + low_row, a + high_row, _rows(other, columns, 0, end)))
                for low_row, high_row in _pieces(right.list[start:end]):
                    yield from meet(right, a, b, start + low_row, start + high_row, groups)
        if (hit := np.flatnonzero(counts)).size:
            yield pa.RecordBatch.from_arrays([left.rep[hit], left.rep[root[hit]], counts[hit]], ["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = arrow_store(folder, options)
        for batch in batches:
            for i, low, high in zip(*(c.to_pylist() for c in batch.columns)):
                yield from share(store, i, low, high)
        tidy()

    return run


def _shares(blocks: list) -> list[tuple[int, int, int]]:
    """(i, low, high): block i with the blocks from low to high; all pairs of blocks that may hold the same kind."""
    ends, end = [], len(blocks)
    for i in range(len(blocks) - 1, -1, -1):
        while blocks[end - 1].first > blocks[i].last:
            end -= 1
        ends.append(end)
    ends.reverse()
    step = max(1, math.ceil(sum(e - i for i, e in enumerate(ends)) / SHARES))
    return [(i, low, min(e, low + step)) for i, e in enumerate(ends) for low in range(i, e, step)]


def near_duplicates(vectors: DataFrame, scratch: Scratch, least: float = 0.98) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each vector."""
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kept = "array<float>" if single else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kept).alias("vector"), F.col("label").cast("string").alias("label"))
    able = finite(F.col("vector")) & F.exists("vector", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # a kind: what may be compared; -0.0 and 0.0 are grouped as equal
    rows = rows.withColumn("kind", F.when(able, F.concat_ws(":", F.size("vector"), "label"))).withColumn("key", F.when(able, F.xxhash64("vector", "label")))
    good = rows.where("kind is not null")
    reps = scratch.save(good.groupBy("kind", "key", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "reps")
    total, width, chunks = reps.agg(F.count("*"), F.max(F.size("vector")), chunks_of(F.count("*"))).first()
    if not total:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    model = Model(_unit(matrix(sample(reps, "rep", "vector", SAMPLE), width)), total)
    radius = math.sqrt(max(0.0, 2 - 2 * least))
    folder, dtype = scratch.path("blocks"), "float32" if single else "float64"
    options = arrow_options(spark, folder)
    many = max(math.ceil(chunks / CHUNKS), math.ceil(total * width * 8 / BLOCK_BYTES), min(chunks, spark.sparkContext.defaultParallelism))
    index = reps.select("kind", "key", "rep", "n", "vector").mapInArrow(_index(model, width), f"kind string, key long, rep long, n long, vector {kept}, list int, code binary, missed double")
    index = index.repartitionByRange(many, "kind", "list", "key").sortWithinPartitions("kind", "list", "key")
    blocks = scratch.save(index.mapInArrow(_write(model, width, radius, folder, options, 2 * math.ceil(total / many)), "part long, nth long, name string, first string, last string"), "blocks")
    blocks = blocks.orderBy("part", "nth").collect()
    shares = _shares(blocks)
    work = spark.createDataFrame(shares, "i long, low long, high long").repartition(min(len(shares), TASKS))
    links = scratch.save(work.mapInArrow(_links(model, width, least, radius, folder, options, [r.name for r in blocks], dtype), "a long, b long, n long"), "links")
    delete(spark, folder)
    found = components(scratch, links.select("a", "b"))
    counts = links.groupBy("a").agg(F.sum("n").alias("links"))
    # rows find their class by hash; vectors go along only where different ones have the same
    shared = scratch.save(reps.groupBy("kind", "key").count().where("count > 1").select(F.col("kind").alias("k"), F.col("key").alias("h")), "shared")

    def named(t: DataFrame) -> DataFrame:
        return t.join(shared, (F.col("kind") == F.col("k")) & (F.col("key") == F.col("h")), "left").withColumn("vector", F.when(F.col("h").isNotNull(), F.col("vector"))).drop("k", "h")

    classes = named(reps).join(counts, F.col("rep") == F.col("a"), "left").join(found, F.col("rep") == F.col("node"), "left")
    classes = classes.select(F.col("kind").alias("k"), F.col("key").alias("h"), F.col("vector").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    classes = scratch.save(classes, "classes")
    scratch.keep(classes, shared)
    out = named(rows.select("vec_id", "kind", "key", "vector")).join(classes, (F.col("key") == F.col("h")) & (F.col("kind") == F.col("k")) & F.col("vector").eqNullSafe(F.col("v")), "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
