"""Exact top-k inner products by dual-tree search over cover trees.

Vectors become integers, floor(scale * x).  Queries and candidates are dealt into blocks;
for each pair of a query block and a candidate block one task builds a cover tree on
either side and walks both together.  For a pair of nodes with centres p, c and covering
radii r, s no inner product exceeds p.c + |p| s + |c| r + r s, so the pair is pruned when
that is below the worst k-th score of the query node's group; what is left at the leaves
is scored exactly in integers.  Each pair returns k rows a query at most, and a ranking by
query merges them.

Edge cases: vectors that are null, or hold null or non-finite components, take no part; so
do candidates of another length than the query's; a query never meets rows of its own
vec_id; a vec_id that repeats asks once, and its rows are candidates each; ties go to the smaller vec_id; null vec_ids take no
part; other columns are not read.  Scores are exact while they fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class CoverTree:
    """Nodes over a permutation of the points: centre, covering radius, bounds, children.

    A node's points are dealt to centres that cover them within half its radius, chosen
    greedily as the points farthest from the centres so far.
    """

    def __init__(self, x: np.ndarray, leaf: int = 48, fan: int = 12):
        self.x = x
        self.order = np.arange(len(x))
        self.lo, self.hi, self.centre, self.radius, self.kids = [], [], [], [], []
        self._grow(0, len(x), leaf, fan)
        self.lo, self.hi, self.centre = (np.array(v) for v in (self.lo, self.hi, self.centre))
        self.radius = np.array(self.radius)
        self.norm = np.sqrt((x[self.centre] ** 2).sum(1))

    def _distances(self, points: np.ndarray, centre: int) -> np.ndarray:
        d = self.x[points] - self.x[centre]
        return np.sqrt((d * d).sum(1))

    def _grow(self, lo: int, hi: int, leaf: int, fan: int) -> int:
        root = len(self.lo)
        todo = [(lo, hi, None, root)]
        while todo:
            lo, hi, centre, at = todo.pop()
            points = self.order[lo:hi]
            if centre is None:
                mean = self.x[points].mean(0)
                centre = int(points[((self.x[points] - mean) ** 2).sum(1).argmin()])
            near = self._distances(points, centre)
            radius = float(near.max())
            while len(self.lo) <= at:
                for v in (self.lo, self.hi, self.centre, self.radius, self.kids):
                    v.append([])
            self.lo[at], self.hi[at], self.centre[at], self.radius[at], self.kids[at] = lo, hi, centre, radius, []
            if hi - lo <= leaf or radius == 0:
                continue
            owner, centres = np.zeros(len(points), np.int64), [centre]
            while len(centres) < fan and near.max() > radius / 2:
                new = int(points[near.argmax()])
                d = self._distances(points, new)
                owner[d < near] = len(centres)
                near = np.minimum(near, d)
                centres.append(new)
            order = np.argsort(owner, kind="stable")
            self.order[lo:hi] = points[order]
            stops = lo + np.searchsorted(owner[order], np.arange(len(centres) + 1))
            for i, c in enumerate(centres):
                if stops[i] < stops[i + 1]:
                    kid = len(self.lo)
                    for v in (self.lo, self.hi, self.centre, self.radius, self.kids):
                        v.append([])
                    self.kids[at].append(kid)
                    todo.append((int(stops[i]), int(stops[i + 1]), c, kid))
        return root


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1]) < 2.0**52:
        return np.rint(q @ x.T).astype(np.int64)
    return (q.astype(np.int64).astype(object) @ x.astype(np.int64).astype(object).T).astype(np.int64)


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), np.iinfo(np.int64).min + 1)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.full = np.zeros(n, np.int64)

    def worst(self, rows: np.ndarray) -> float:
        """The least k-th score of a group; minus infinity while one has fewer than k."""
        return float(self.score[rows, -1].min()) if (self.full[rows] >= self.k).all() else -np.inf

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        mask = ids[None, :] != own[:, None]
        low = np.iinfo(np.int64).min + 1  # its negative is a number too
        s = np.concatenate([self.score[rows], np.where(mask, scores, low)], 1)
        i = np.concatenate([self.id[rows], np.where(mask, ids[None, :], np.iinfo(np.int64).max)], 1)
        if s.shape[1] > 4 * self.k:  # all columns with a score of the k-th best or more are kept
            kth = np.partition(s, s.shape[1] - self.k, 1)[:, s.shape[1] - self.k]
            width = int((s >= kth[:, None]).sum(1).max())
            if width < s.shape[1] // 2:
                cols = np.argpartition(-s, width - 1, 1)[:, :width] if width < s.shape[1] else np.arange(s.shape[1])[None, :]
                s, i = np.take_along_axis(s, cols, 1), np.take_along_axis(i, cols, 1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        self.full[rows] = np.minimum(self.k, self.full[rows] + mask.sum(1))


def dual_search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> Best:
    """The k best of x for each row of q, by a walk over both trees, the likeliest pairs first."""
    best = Best(len(q), k)
    if not len(q) or not len(x):
        return best
    a, b = CoverTree(q), CoverTree(x)

    def bound(i: int, js: np.ndarray) -> np.ndarray:
        dot = b.x[b.centre[js]] @ a.x[a.centre[i]]
        top = dot + a.norm[i] * b.radius[js] + b.norm[js] * a.radius[i] + a.radius[i] * b.radius[js]
        return top * (1 + 1e-9) + 1e-6 * (1 + np.abs(top))

    stack = [(float(bound(0, np.array([0]))[0]), 0, 0)]
    while stack:
        top, i, j = stack.pop()
        rows = a.order[a.lo[i] : a.hi[i]]
        if top < best.worst(rows):
            continue
        split_x = b.kids[j] and (not a.kids[i] or b.hi[j] - b.lo[j] >= a.hi[i] - a.lo[i])
        if split_x:
            js = np.array(b.kids[j])
            tops = bound(i, js)
            stack += [(float(tops[m]), i, int(js[m])) for m in np.argsort(tops)]  # the best on top
        elif a.kids[i]:
            stack += [(float(bound(c, np.array([j]))[0]), c, j) for c in a.kids[i]]
        else:
            points = b.order[b.lo[j] : b.hi[j]]
            best.add(rows, _scores(q[rows], x[points]), x_ids[points], q_ids[rows])
    return best


def _matrix(t) -> np.ndarray:
    lists = t.column("v").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def exact_top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, query_block: int = 2048, block: int = 16384) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query.

    vectors: vec_id, embedding.  Queries are the rows whose vec_id is divisible by every.
    """
    good = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    rows = vectors.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"), F.size("embedding").alias("dim")).where("dim > 0")
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"])
    n, nq = (x.n for x in (rows.agg(F.count("*").alias("n")).first(), queries.agg(F.count("*").alias("n")).first()))
    cs, qs = max(1, -(-n // block)), max(1, -(-nq // query_block))
    # blocks by position, so that equal ids or vectors never share one block
    q = queries.withColumn("qb", F.pmod(F.monotonically_increasing_id(), F.lit(qs)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(cs - 1))))
    c = rows.withColumn("cb", F.pmod(F.monotonically_increasing_id(), F.lit(cs)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qs - 1))))

    def search(left, right):
        ids = left.column("vec_id").to_numpy()
        if left.num_rows and right.num_rows:
            best = dual_search(_matrix(left), ids, _matrix(right), right.column("vec_id").to_numpy(), k)
            at, col = np.nonzero(np.arange(k)[None, :] < best.full[:, None])
            return pa.table([pa.array(ids[at]), pa.array(best.id[at, col]), pa.array(best.score[at, col])], ["query_id", "vec_id", "score"])
        return pa.table([pa.array([], pa.int64())] * 3, ["query_id", "vec_id", "score"])

    keys = ["qb", "cb", "dim"]
    near = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
