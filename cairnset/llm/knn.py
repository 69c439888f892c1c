"""Exact top-k by inner product as a Voronoi kNN join.

With M the greatest length of a candidate, (x, sqrt(M^2 - |x|^2)) and (q, 0) turn greatest inner products
into smallest distances: |q' - x'|^2 = |q|^2 + M^2 - 2 q.x. Pivots split queries and candidates into cells.
Summaries per cell (queries: greatest distance to the pivot; candidates: the k + 1 vec_ids with the smallest
distances to it, one row each) bound the distance of each query cell's k-th neighbour; a candidate is replicated only to the query
groups whose bound it can meet (triangle inequality, and the distance to the bisecting hyperplane). Groups
are neighbouring query cells that need much the same candidate cells, so that a candidate goes to few groups without
going to queries that can't need it; they are solved in blocks of queries and candidates, so a group of any size is
dealt to many tasks, and each block keeps k rows a query. Pivots grow with the square root of the candidates.

Components are floor(scale * x); scores are exact 64-bit sums. The bounds are doubles with a relative
tolerance, so no true neighbour is lost.

Defined cases: vectors that are null, empty or hold null or non-finite components, and rows without vec_id,
take no part; vectors of different lengths are compared as if padded with zeros; rows that share a vec_id
are not candidates of each other, and each of them is a candidate for others. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions, spread_join
from .vectors import finite, kmeans, matrix, nearest, sample

SAMPLE = 8192
#: Queries and candidates of one block.
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 4096
#: A cell joins a group if their candidates together are at most this many times those of either.
ALIKE = 1.25
#: Numbers of one block of distances.
BLOCK = 1 << 20


def pivots_for(n: int) -> int:
    return max(64, round(n**0.5 / 2))


def _raised(x: np.ndarray, most2: float, query: bool) -> np.ndarray:
    rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(most2 - (x**2).sum(1), 0))
    return np.hstack([x, rest[:, None]])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0))


def bounds(cells: dict[int, float], few: dict[int, list], between: np.ndarray, k: int) -> np.ndarray:
    """For each query cell with queries, (greatest distance to the pivot, bound on that of the k-th neighbour); -1 for others."""
    reach = np.full((len(between), 2), -1.0)
    cell, id_, far = (np.array(x) for x in zip(*((j, f.id, f.far) for j, rows in few.items() for f in rows)))
    for c, own in cells.items():
        upper = own + between[c, cell] + far
        order = np.argsort(upper, kind="stable")
        first = np.sort(np.unique(id_[order], return_index=True)[1])  # of each id, whose rows may be in several cells, the least
        reach[c] = own, upper[order[first[k]]] if len(first) > k else np.inf
    return reach


def grouped_cells(cells: dict[int, int], needs: dict[int, np.ndarray], sizes: np.ndarray, between: np.ndarray) -> dict[int, int]:
    """A group for each query cell; cells: queries in each; needs: which candidate cells each may need; sizes: rows of those."""
    group: dict[int, int] = {}
    left = sorted(cells)
    while left:
        start, need, load = left[0], needs[left[0]].copy(), cells[left[0]]
        number = len(set(group.values()))
        group[start] = number
        for c in sorted(left[1:], key=lambda c: between[start, c]):
            both = need | needs[c]
            if load + cells[c] <= QUERY_BLOCK and sizes[both].sum() <= ALIKE * min(sizes[need].sum(), sizes[needs[c]].sum()):
                group[c], need, load = number, both, load + cells[c]
        left = [c for c in left if c not in group]
    return group


def _deal(pivots: np.ndarray, width: int, most2: float, query: bool):
    def run(batches):
        for pdf in batches:
            x = _raised(matrix(pdf.vector, width), most2, query)
            own = nearest(x, pivots)
            yield pdf.assign(cell=own.astype("int32"), far=np.sqrt(((x - pivots[own]) ** 2).sum(1)))

    return run


def _smallest(k: int):
    """For each cell the k ids with the smallest distances, each by its nearest row."""

    def run(batches):
        kept = None
        for pdf in batches:
            kept = pd.concat([kept, pdf]).sort_values(["cell", "far"]).drop_duplicates(["cell", "id"]).groupby("cell").head(k)
        if kept is not None:
            yield kept

    return run


def _replicate(pivots: np.ndarray, width: int, most2: float, reach: np.ndarray, group: np.ndarray):
    """reach: for each query cell, the greatest distance of its queries to their pivot, and to a k-th neighbour; -1: no query."""

    def run(batches):
        live = np.flatnonzero(reach[:, 0] >= 0)
        between = distances(pivots, pivots[live])
        slack = 1e-6 * (1 + np.sqrt(most2))
        step = max(1, BLOCK // len(live))
        for pdf in (whole.iloc[at : at + step] for whole in batches for at in range(0, len(whole), step)):
            x = _raised(matrix(pdf.vector, width), most2, False)
            own = pdf.cell.to_numpy()
            far = pdf.far.to_numpy()
            d = distances(x, pivots[live])
            # nearest query of the cell: by the triangle, and a query is on its pivot's side of the hyperplane
            gap = between[own]
            plane = np.where(gap > 0, (d**2 - far[:, None] ** 2) / (2 * np.maximum(gap, 1e-30)), 0)
            bound = np.maximum(d - reach[live, 0], plane)
            need = bound <= reach[live, 1] + slack
            out = np.zeros((len(x), group.max() + 1), bool)
            for k, g in enumerate(group[live]):
                out[:, g] |= need[:, k]
            at, to = np.nonzero(out)
            yield pd.DataFrame({"id": pdf.id.to_numpy()[at], "vector": pdf.vector.to_numpy()[at], "grp": to.astype("int32")})

    return run


def _solve(width: int, k: int):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.array([], "int64"), "vec_id": np.array([], "int64"), "score": np.array([], "int64"), "row": np.array([], "int64")})
        right = right.sort_values("id", kind="stable")
        ids = right.id.to_numpy()
        q, x = matrix(left.vector, width), matrix(right.vector, width)
        exact = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * width < 2**53
        scores = (q @ x.T).astype(np.int64) if exact else q.astype(np.int64) @ x.astype(np.int64).T
        out = []
        for row, query, s in zip(left.row.to_numpy(), left.id.to_numpy(), scores):
            mine = np.flatnonzero(ids != query)
            s = s[mine]
            if len(s) > k:
                least = np.partition(s, len(s) - k)[len(s) - k]
                more, same = np.flatnonzero(s > least), np.flatnonzero(s == least)
                keep = np.concatenate([more, same[: k - len(more)]])  # ids ascend
            else:
                keep = np.arange(len(s))
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[mine[keep]], "score": s[keep], "row": row}))
        return pd.concat(out)

    return run


def top_k(queries: DataFrame, candidates: DataFrame, scratch: Scratch, k: int = 5, scale: float = 256.0) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) from two tables (vec_id, embedding)."""

    def cleaned(rows: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        rows = rows.select(F.col("vec_id").cast("long").alias("id"), v.alias("vector")).where(finite(F.col("vector")) & F.col("id").isNotNull())
        return rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x * scale).cast("double")))

    data, asked = scratch.save(cleaned(candidates), "data"), scratch.save(cleaned(queries).withColumn("row", F.monotonically_increasing_id()), "asked")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    most2, width, total = data.agg(F.max(square), F.max(F.size("vector")), F.count("*")).first()
    n_queries, q_width = asked.agg(F.count("*"), F.max(F.size("vector"))).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not total or not n_queries:
        return scratch.spark.createDataFrame([], schema)
    width = max(width, q_width)
    pivots = kmeans(_raised(matrix(sample(data, "id", "vector", SAMPLE), width), most2, False), pivots_for(total))

    data = scratch.save(data.mapInPandas(_deal(pivots, width, most2, False), "id long, vector array<double>, cell int, far double"), "dealt")
    asked = scratch.save(asked.mapInPandas(_deal(pivots, width, most2, True), "id long, vector array<double>, row long, cell int, far double"), "dealt")
    # summaries: k + 1 ids a cell at most, as one may be the query's own; first of each task, then of slices
    firsts = data.select("cell", "id", "far").mapInPandas(_smallest(k + 1), "cell int, id long, far double").groupBy("cell", "id").agg(F.min("far").alias("far"))
    nearest_few = firsts.groupBy("cell", F.pmod(F.xxhash64("id"), F.lit(partitions(scratch.spark))).alias("slice")).agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "id"))), 1, k + 1).alias("few"))
    few = {r.cell: r.few for r in nearest_few.groupBy("cell").agg(F.slice(F.array_sort(F.flatten(F.collect_list("few"))), 1, k + 1).alias("few")).collect()}
    cells = {r.cell: (r.far, r.n) for r in asked.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}
    held = {r.cell: (r.far, r.n) for r in data.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}
    between = distances(pivots, pivots)
    reach = bounds({c: far for c, (far, _) in cells.items()}, few, between, k)
    sizes, radius = (np.array([held.get(j, (-np.inf, 0))[i] for j in range(len(pivots))]) for i in (1, 0))
    needs = {c: between[c] - radius <= reach[c].sum() for c in cells}
    found = grouped_cells({c: n for c, (_, n) in cells.items()}, needs, sizes, between)
    group = np.array([found.get(c, 0) for c in range(len(pivots))])

    sent = scratch.save(data.mapInPandas(_replicate(pivots, width, most2, reach, group), "id long, vector array<double>, grp int"), "sent")
    cell_groups = scratch.spark.createDataFrame([(int(c), int(g)) for c, g in found.items()], "cell int, grp int")  # a row for each cell
    grouped = asked.join(F.broadcast(cell_groups), "cell")
    sizes = sent.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(CANDIDATE_BLOCK)).alias("cs")).join(grouped.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(QUERY_BLOCK)).alias("qs")), "grp")
    sizes = scratch.save(sizes, "sizes")
    zero = F.lit(0).cast("long")
    ours = spread_join(grouped, sizes, "grp").select("grp", "id", "row", "vector", F.pmod(F.xxhash64("row"), F.col("qs")).alias("qb"), F.explode(F.sequence(zero, F.col("cs") - 1)).alias("cb"))
    theirs = spread_join(sent, sizes, "grp").select("grp", "id", "vector", F.pmod(F.xxhash64("id"), F.col("cs")).alias("cb"), F.explode(F.sequence(zero, F.col("qs") - 1)).alias("qb"))
    found = ours.groupBy("grp", "qb", "cb").cogroup(theirs.groupBy("grp", "qb", "cb")).applyInPandas(_solve(width, k), "query_id long, vec_id long, score long, row long")
    order = Window.partitionBy("query_id", "row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
