"""Exact top-k inner products as a Voronoi k-nearest-neighbour join.

With one more coordinate, sqrt(M - |x|^2) for data and 0 for queries (M the
largest squared norm), the largest inner products are the smallest distances.
Pivots are the rows with the smallest hashes of their ids, about the square root
of the number of rows, `MOST_PIVOTS` at most. Each row belongs to the cell of its
nearest pivot. Two passes:

1. Each query meets one chunk of its own cell; its k-th best score there bounds
   how far its k best rows can lie.
2. From these bounds follows, for each group of queries and each pivot, how far
   from the pivot a row of its cell must lie at least to be needed. By the
   triangle inequality all other rows stay away. Groups are solved locally, in
   blocks of queries and chunks of data, by a matrix product, and merged.

Queries are grouped by pivots. How many groups there are is chosen from the
cells' histograms of distances, so that the fewest rows are sent: many groups
where the bounds prune, few where they can't (as in many dimensions without
clusters, where one copy of the data is the least that can be sent).

Components become floor(256 * x). Shorter vectors count as ending in zeros.
Vectors null or with null or non-finite components take no part. Scores are
exact while they fit a long. A row with a null vec_id is neither query nor
candidate; other ids are any 64-bit integers. Repeated data rows are
different candidates; a query never meets a row of its own id. Repeated query
rows are each answered, with equal results if their vectors are equal. Empty
tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, table

MOST_PIVOTS, BLOCK, CHUNK, BINS = 512, 4096, 16384, 64
EXACT = 2.0**53


def quantised(rows: DataFrame) -> DataFrame:
    x = F.col("embedding").cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(v))
    return rows.where(fine).select("vec_id", F.transform(x, lambda v: F.floor(F.lit(256.0) * v)).alias("vec"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of a list column as rows, padded with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Pivots:
    """Distances to pivots in the space with the extra coordinate."""

    def __init__(self, points: np.ndarray, most: float):
        self.most = most
        self.points = points.astype(float)
        self.extra = np.sqrt(np.maximum(0, most - (self.points**2).sum(axis=1)))
        both = np.c_[self.points, self.extra]
        self.apart = np.sqrt(np.maximum(0, ((both[:, None] - both[None]) ** 2).sum(axis=2)))

    def distances(self, x: np.ndarray, data: bool) -> np.ndarray:
        x = x.astype(float)
        norm = (x**2).sum(axis=1)
        extra = np.sqrt(np.maximum(0, self.most - norm)) if data else np.zeros(len(x))
        far = norm[:, None] + (self.points**2).sum(axis=1)[None] - 2 * x @ self.points.T + (extra[:, None] - self.extra[None]) ** 2
        return np.sqrt(np.maximum(0, far))

    def nearest(self, x: np.ndarray, data: bool) -> tuple[np.ndarray, np.ndarray]:
        far = self.distances(x, data)
        at = far.argmin(axis=1)
        return at, far[np.arange(len(x)), at]


def histograms(pivots: Pivots, dims: int, data: bool, width: float):
    """(pivot, bin, n): rows by distance from their pivot."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                at, far = pivots.nearest(matrix(b.column("vec"), dims), data)
                cell = at * BINS + np.minimum((far / width).astype(np.int64), BINS - 1)
                n = np.bincount(cell, minlength=len(pivots.points) * BINS)
                k = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(k // BINS), pa.array(k % BINS), pa.array(n[k])], ["pivot", "bin", "n"])

    return run


def solver(dims: int, k: int):
    """The k best rows of each query of a block in a chunk."""

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        right = right.sort_values("vec_id", kind="stable")
        q, x = (np.frombuffer(b"".join(f.vec), np.int64).reshape(len(f), dims) for f in (left, right))
        whole = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * dims < EXACT
        ids, own, key_of = right.vec_id.to_numpy(), left.vec_id.to_numpy(), left.q.to_numpy()
        out = []
        for i in range(0, len(q), 256):
            score = (q[i : i + 256].astype(float) @ x.T.astype(float)).astype(np.int64) if whole else q[i : i + 256] @ x.T
            mine = ids[None, :] == own[i : i + 256, None]
            key = np.where(mine, np.iinfo(np.int64).min, score)
            best = np.argsort(-key, axis=1, kind="stable")[:, : k + int(mine.sum(axis=1).max(initial=0))]
            row = np.repeat(np.arange(len(key)), best.shape[1])
            col = best.ravel()
            ok = ~mine[row, col]
            found = pd.DataFrame({"q": key_of[i + row[ok]], "query_id": own[i + row[ok]], "vec_id": ids[col[ok]], "score": score[row[ok], col[ok]]})
            out.append(found.groupby("q").head(k))
        return pd.concat(out)

    return solve


def grouped(apart: np.ndarray, used: np.ndarray, groups: int) -> np.ndarray:
    """A group for each pivot: centres are chosen farthest first among the used ones, each pivot goes to the nearest."""
    centres = [int(used[0])]
    far = apart[centres[0]].copy()
    while len(centres) < min(groups, len(used)):
        centres.append(int(used[far[used].argmax()]))
        far = np.minimum(far, apart[centres[-1]])
    return apart[:, centres].argmin(axis=1)


class Plan:
    """Which rows go to which groups of queries: group of each pivot, least[g, i] (the least distance from pivot i that is needed), and what that sends."""

    def __init__(self, pivots: Pivots, least: np.ndarray, n_query: np.ndarray, hist: np.ndarray, width: float, groups: int | None = None):
        used = np.flatnonzero(n_query)
        above = np.cumsum(hist[:, ::-1], axis=1)[:, ::-1]  # rows of a cell from a bin on
        cells = np.arange(len(hist))
        fewest = max(1, -(-int(n_query.sum()) // BLOCK))
        choices = [groups] if groups else sorted({min(len(used), fewest << s) for s in range(10)})
        best = None
        for g in choices:
            group = grouped(pivots.apart, used, g)
            merged = np.full((group.max() + 1, len(hist)), np.inf)
            np.minimum.at(merged, group[used], least[used])
            bins = np.clip(np.floor(merged / width), 0, BINS - 1)
            sent = np.where(np.isfinite(merged), above[cells[None], np.where(np.isfinite(bins), bins, 0).astype(int)], 0).sum(axis=1)
            blocks = np.maximum(1, -(-np.bincount(group, n_query, len(sent)).astype(int) // BLOCK))
            if best is None or (sent * blocks).sum() < best[0]:
                best = (sent * blocks).sum(), group, merged, sent
        self.total, self.group, self.least, self.sent = best
        self.rows = int(hist.sum())
        self.share = float(self.sent.sum() / max(1, self.rows * len(self.sent)))  # of the rows, in the mean over groups, as estimated
        self.blocks = np.maximum(1, -(-np.bincount(self.group, n_query, len(self.sent)).astype(int) // BLOCK))
        self.chunks = np.maximum(1, -(-self.sent.astype(int) // CHUNK))


def top_k(rows: DataFrame, query: F.Column, k: int = 5, pivots: int | None = None, groups: int | None = None, seen: list | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row that `query` holds for. `seen` gets the Plan."""
    spark = rows.sparkSession
    layout = "query_id long, rank int, vec_id long, score long"
    vectors = quantised(rows.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))  # without nulls ids stay 64-bit integers everywhere
    asked = vectors.where(query).groupBy("vec_id", "vec").agg(F.count("*").alias("times"))
    asked = saved(asked.withColumn("q", F.xxhash64("vec_id", "vec")))
    norm = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    n, dims, most = vectors.agg(F.count("*"), F.max(F.size("vec")), F.max(norm)).first()
    if not n or not asked.limit(1).count():
        return spark.createDataFrame([], layout)
    dims = max(1, dims)
    pivots = pivots or int(min(MOST_PIVOTS, max(16, np.sqrt(n))))
    points = vectors.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(pivots).select("vec").toArrow()
    cells = Pivots(matrix(points.column("vec"), dims), most)
    width = max(1e-9, 2.0 * np.sqrt(most) / BINS * (1 + 1e-9))
    slack = 1e-6 * (1 + np.sqrt(most))

    def histogram(frame, data):
        found = frame.mapInArrow(histograms(cells, dims, data, width), "pivot long, bin long, n long").groupBy("pivot", "bin").agg(F.sum("n").alias("n")).toPandas()  # pivots x bins
        out = np.zeros((len(cells.points), BINS), np.int64)
        out[found["pivot"], found["bin"]] = found["n"]
        return out

    hist, n_query = histogram(vectors, True), histogram(asked.select("vec"), False).sum(axis=1)
    first = np.maximum(1, -(-hist.sum(axis=1) // CHUNK))  # chunks of a cell in the first pass

    def to_cells(data: bool):
        def run(batches):
            for b in batches:
                if b.num_rows:
                    x = matrix(b.column("vec"), dims)
                    at, _ = cells.nearest(x, data)
                    ids = b.column("vec_id").to_numpy()
                    keep = np.flatnonzero(n_query[at] > 0)
                    take = pa.array(keep)
                    part = ids[keep] % first[at[keep]]
                    names = ["vec_id"] if data else ["q", "vec_id"]
                    yield pa.RecordBatch.from_arrays([pa.array(at[keep]), pa.array(part), *(b.column(c).take(take) for c in names), pa.array([x[i].tobytes() for i in keep], pa.binary())], ["g", "c", *names, "vec"])

        return run

    packed = asked.mapInArrow(to_cells(False), "g long, c long, q long, vec_id long, vec binary")
    near = vectors.mapInArrow(to_cells(True), "g long, c long, vec_id long, vec binary")
    close = packed.groupBy("g", "c").cogroup(near.groupBy("g", "c")).applyInPandas(solver(dims, k), "q long, query_id long, vec_id long, score long")
    reach = close.groupBy("q").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    bounded = saved(asked.join(reach.withColumnRenamed("q", "r_q"), F.col("q") == F.col("r_q"), "left").drop("r_q"))

    def bounds(batches):
        """(pivot of the query, pivot, the least distance of a needed row from the latter), the smallest of each batch."""
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("vec"), dims)
                far = cells.distances(x, False)
                score = b.column("least").to_numpy(zero_copy_only=False).astype(float)
                radius = np.sqrt(np.maximum(0, (x.astype(float) ** 2).sum(axis=1) + most - 2 * score))
                need = far - np.where(np.isnan(radius), np.inf, radius)[:, None] - slack
                at = far.argmin(axis=1)
                least = np.full((len(cells.points),) * 2, np.inf)
                np.minimum.at(least, at, need)
                i, j = np.nonzero(np.isfinite(least) | (least == -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(least[i, j])], ["i", "j", "least"])

    found = bounded.select("vec", "least").mapInArrow(bounds, "i long, j long, least double").groupBy("i", "j").agg(F.min("least").alias("least")).toPandas()  # pivots x pivots
    least = np.full((len(cells.points),) * 2, np.inf)
    least[found["i"], found["j"]] = found["least"]
    plan = Plan(cells, least, n_query, hist, width, groups)
    if seen is not None:
        seen.append(plan)

    def send_queries(batches):
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("vec"), dims)
                g = plan.group[cells.nearest(x, False)[0]]
                key = b.column("q").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(key % plan.blocks[g]), pa.array(plan.chunks[g]), b.column("q"), b.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary())], ["g", "b", "chunks", "q", "vec_id", "vec"])

    def send_data(batches):
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("vec"), dims)
                at, far = cells.nearest(x, True)
                ids = b.column("vec_id").to_numpy()
                bytes_ = pa.array([r.tobytes() for r in x], pa.binary())
                for g in range(len(plan.sent)):
                    rows_ = np.flatnonzero(far >= plan.least[g][at])
                    take = pa.array(rows_)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows_), g)), pa.array(ids[rows_] % plan.chunks[g]), pa.array(np.full(len(rows_), plan.blocks[g])), b.column("vec_id").take(take), bytes_.take(take)], ["g", "c", "blocks", "vec_id", "vec"])

    queries = asked.mapInArrow(send_queries, "g long, b long, chunks long, q long, vec_id long, vec binary").withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    data = vectors.mapInArrow(send_data, "g long, c long, blocks long, vec_id long, vec binary").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    local = queries.groupBy("g", "b", "c").cogroup(data.groupBy("g", "b", "c")).applyInPandas(solver(dims, k), "q long, query_id long, vec_id long, score long")
    best = Window.partitionBy("q", "query_id").orderBy(F.desc("score"), "vec_id")
    ranked = local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    again = ranked.join(asked.where("times > 1").select(F.col("q").alias("a_q"), "times"), F.col("q") == F.col("a_q"), "left")
    return again.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("times", F.lit(1).cast("long"))))).select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vec FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.vec, c.vec) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
