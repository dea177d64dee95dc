"""Nearest neighbours by inner product with vantage-point trees (operator 10).

Inner products become distances: with M the largest norm, a vector x is placed at
(x, sqrt(M^2 - |x|^2)) and a query q at (q, 0), so that d^2 = |q|^2 + M^2 - 2 q.x falls as
the product rises.  A routing tree, fitted on a sample of at most ``SAMPLE`` rows, deals every
row to a leaf; leaves of more rows than a shard holds are dealt on by a hash of the id, so one
frequent vector fills no shard.  A task holds a shard, builds its vantage-point tree once and
searches it for the queries that are sent there, ``ASKED`` at a time as they stream by.  A query
visits a branch beyond a vantage point's radius only if its distance to that
sphere is at most ``factor`` times its distance to the k-th nearest so far; with factor 1
that is the triangle inequality and the search exact, less is faster and may miss some: how
many depends on the vectors, so the default is 1.  Distances are compared with room for their
rounding.  The same rule, with the sample's k-th nearest as the bound, chooses the shards a query is
sent to.  A row moves once; a query moves once for each shard it must visit, so shards grow with
the table, from ``SHARD`` rows to ``LARGEST``.

Scores are sums in double precision in the order of the components, on the vectors as they
are.  Equal vectors of a shard are one point of its tree.

Defined cases: vectors that are null, empty, zero, hold null or non-finite components, or
have another length than most take no part; a null id takes no part; repeated rows are
candidates each, repeated queries are one (the least vector, should they differ); fewer
candidates than k are all returned; ties go to the smaller id; extra columns are ignored; vectors
of any one length are searched whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnspark.llm.shared import below, drop, slices, written

SAMPLE, SHARD, LARGEST, LEAF = 8192, 4096, 65536, 128
#: Queries that a shard's tree is searched for at a time.
ASKED = 2048
#: Components the sample may hold in all, for wide vectors.
SAMPLE_COMPONENTS = 8 << 20
#: Exact; what less finds depends on the vectors (see the README).
K, FACTOR = 20, 1.0
#: Rounding of a distance, as a part of the largest that can be: squares are exact to some 1e-14 of it.
ROUNDING = 2e-7


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row, summed in the order of the components."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * x[:, j]
    return out


@dataclass
class Node:
    rows: np.ndarray | None = None  # of a leaf
    vantage: np.ndarray | None = None
    extra: float = 0.0
    radius: float = 0.0
    inside: Node | None = None
    outside: Node | None = None
    leaf: int = -1


@dataclass
class Tree:
    """A vantage-point tree over points; ``top`` is M."""

    points: np.ndarray
    top: float
    leaf_rows: int
    leaves: int = 0
    extra: np.ndarray = field(init=False)
    root: Node = field(init=False)

    def __post_init__(self) -> None:
        self.extra = np.sqrt(np.maximum(self.top**2 - (self.points**2).sum(axis=1), 0.0))
        self.root = self._grow(np.arange(len(self.points)), 0)

    def _grow(self, rows: np.ndarray, depth: int) -> Node:
        if len(rows) > self.leaf_rows and depth < 60:
            # of a few evenly spaced rows, the one whose distances spread most
            best, spread = None, 0.0
            for at in rows[np.linspace(0, len(rows) - 1, 5).astype(int)]:
                d = self._from(at, rows)
                if (s := float(d.std())) > spread:
                    best, spread = (at, d), s
            if best is not None:
                at, d = best
                radius = float(np.median(d))
                near = d <= radius
                if near.all():  # many at the median: split below it
                    near = d < radius
                if near.any() and not near.all():
                    radius = float(d[near].max())
                    return Node(None, self.points[at], float(self.extra[at]), radius, self._grow(rows[near], depth + 1), self._grow(rows[~near], depth + 1))
        self.leaves += 1
        return Node(rows, leaf=self.leaves - 1)

    def _from(self, at: int, rows: np.ndarray) -> np.ndarray:
        cross = self.points[rows] @ self.points[at] + self.extra[rows] * self.extra[at]
        return np.sqrt(np.maximum(2 * self.top**2 - 2 * cross, 0.0))

    def distance(self, node: Node, q: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(norms + self.top**2 - 2 * (q @ node.vantage), 0.0))

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        extra, out = np.sqrt(np.maximum(self.top**2 - (x**2).sum(axis=1), 0.0)), np.zeros(len(x), dtype=np.int64)

        def walk(node: Node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if node.rows is not None:
                out[rows] = node.leaf
                return
            cross = x[rows] @ node.vantage + extra[rows] * node.extra
            near = np.sqrt(np.maximum(2 * self.top**2 - 2 * cross, 0.0)) <= node.radius
            walk(node.inside, rows[near])
            walk(node.outside, rows[~near])

        walk(self.root, np.arange(len(x)))
        return out

    def reached(self, q: np.ndarray, bound: np.ndarray, factor: float) -> list[list[int]]:
        """The leaves that the relaxed rule lets each query visit, given a distance bound."""
        norms, out = (q**2).sum(axis=1), [[] for _ in range(len(q))]

        def walk(node: Node, rows: np.ndarray) -> None:
            if not len(rows):
                return
            if node.rows is not None:
                for r in rows:
                    out[r].append(node.leaf)
                return
            d = self.distance(node, q[rows], norms[rows]) - node.radius
            reach = factor * bound[rows] + ROUNDING * (np.sqrt(norms[rows]) + self.top)
            walk(node.inside, rows[d <= reach])
            walk(node.outside, rows[d >= -reach])

        walk(self.root, np.arange(len(q)))
        return out


class Search:
    """The k best points of a tree for a block of queries."""

    def __init__(self, tree: Tree, q: np.ndarray, k: int, factor: float, bound: np.ndarray | None = None):
        self.tree, self.q, self.k, self.factor = tree, q, k, factor
        self.norms = (q**2).sum(axis=1)
        self.bound = np.full(len(q), np.inf) if bound is None else bound.copy()
        self.least = np.full(len(q), -np.inf)  # score of the k-th best
        self.row, self.point, self.score = (np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.float64))
        self._walk(tree.root, np.arange(len(q)))

    def _walk(self, node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.rows is not None:
            return self._leaf(node.rows, rows)
        d = self.tree.distance(node, self.q[rows], self.norms[rows]) - node.radius
        within = d <= 0
        self._walk(node.inside, rows[within])
        self._walk(node.outside, rows[~within])
        # the far sides, with the bounds that the near sides have left
        reach = np.abs(d) <= self.factor * self.bound[rows] + ROUNDING * (np.sqrt(self.norms[rows]) + self.tree.top)
        self._walk(node.outside, rows[within & reach])
        self._walk(node.inside, rows[~within & reach])

    def _leaf(self, points: np.ndarray, rows: np.ndarray) -> None:
        x = self.tree.points[points]
        s = self.q[rows] @ x.T
        slack = 1e-9 * (1 + np.abs(s).max(initial=0.0))
        r, c = np.nonzero(s >= (self.least[rows] - slack)[:, None])
        if not len(r):
            return
        touched = np.zeros(len(self.q), dtype=bool)
        touched[rows[r]] = True
        old = touched[self.row]
        row = np.concatenate([self.row[old], rows[r]])
        point = np.concatenate([self.point[old], points[c]])
        score = np.concatenate([self.score[old], products(self.q[rows[r]], x[c])])
        order = np.lexsort((-score, row))
        row, point, score = row[order], point[order], score[order]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        kth = place == self.k - 1
        self.least[row[kth]] = score[kth]
        self.bound[row[kth]] = np.minimum(self.bound[row[kth]], np.sqrt(np.maximum(self.norms[row[kth]] + self.tree.top**2 - 2 * score[kth], 0.0)))
        keep = score >= self.least[row]  # ties with the k-th stay
        self.row, self.point, self.score = (np.concatenate([a[~old], b[keep]]) for a, b in ((self.row, row), (self.point, point), (self.score, score)))


class Shard:
    """A shard's distinct points in a tree, and the ids of each point."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, top: float):
        points, point = np.unique(x, axis=0, return_inverse=True)
        order = np.lexsort((ids, point := point.ravel()))
        self.ids, self.starts = ids[order], np.searchsorted(point[order], np.arange(len(points) + 1))
        self.tree = Tree(points, top, LEAF)

    def nearest(self, qid: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, factor: float) -> pa.RecordBatch:
        """query_id, vec_id, score: each query's k best here, itself left out."""
        # one more than k, as a query's own row is no candidate
        found = Search(self.tree, q, k + 1, factor, bound)
        # of equal vectors the k + 1 smallest ids can be among the nearest
        many = np.minimum(np.diff(self.starts)[found.point], k + 1)
        row, score = np.repeat(found.row, many), np.repeat(found.score, many)
        at = np.repeat(self.starts[found.point], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        own = self.ids[at]
        keep = qid[row] != own
        row, own, score = row[keep], own[keep], score[keep]
        order = np.lexsort((own, -score, row))
        row, own, score = row[order], own[order], score[order]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, dtype=int)
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        keep = place < k
        return pa.RecordBatch.from_arrays([pa.array(qid[row[keep]]), pa.array(own[keep]), pa.array(score[keep])], ["query_id", "vec_id", "score"])


def _usable(rows: DataFrame) -> DataFrame:
    x = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return x.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(fine & F.exists("v", lambda c: c != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(rows: DataFrame, every: int = 20, k: int = K, factor: float = FACTOR, shard: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score.  Queries are the rows whose id is divisible by ``every``."""
    spark = rows.sparkSession
    good = _usable(rows)
    sizes = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))).alias("top"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q"))
    most = sizes.orderBy(F.col("n").desc(), "d").limit(1).collect()
    if not most or not most[0].q:
        return good.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    dims, n, top = most[0].d, most[0].n, most[0].top
    good = good.filter(F.size("v") == dims)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shard = shard or min(LARGEST, max(SHARD, -(-n // tasks)))

    # the routing tree, from a bounded sample: the ids with the smallest hashes
    bound = max(256, min(sample, SAMPLE_COMPONENTS // dims))
    taken, order = good, F.xxhash64(F.lit(5), "vec_id")
    if n > bound:  # first about so many, by a bound on all 64 bits, then exactly
        share = min(1.0, (1.2 * bound + 1000) / n)
        taken = good.filter(below(order, share)).orderBy(order, "vec_id", "v").limit(bound)
    taken = taken.toPandas().sort_values("vec_id", kind="stable")
    ids, points = taken.vec_id.to_numpy(), np.stack(taken.v.to_list()) if len(taken) else np.zeros((0, dims))
    leaves = max(1, min(-(-n // shard), len(points) // 16))
    router = Tree(points, top, max(1, -(-len(points) // leaves)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(router.assign(_matrix(b.column(1))))], ["vec_id", "v", "leaf"])

    dealt = written(good.mapInArrow(deal, "vec_id long, v array<double>, leaf long"), "leaves")
    counts = {r.leaf: r["count"] for r in dealt.groupBy("leaf").count().collect()}  # at most a leaf per sampled row
    parts = {leaf: -(-c // shard) for leaf, c in sorted(counts.items())}
    first = dict(zip(parts, [sum(list(parts.values())[:i]) for i in range(len(parts))], strict=True))
    told = lambda x: F.element_at(F.create_map(*(F.lit(y).cast("long") for kv in x.items() for y in kv)), F.col("leaf"))
    own = dealt.select((told(first) + F.pmod(F.xxhash64("vec_id"), told(parts))).cast("int").alias("shard"), F.lit(0).alias("asks"), "vec_id", "v", F.lit(0.0).alias("bound"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if not b.num_rows:
                continue
            q, qid = _matrix(b.column(1)), b.column(0).to_numpy()
            # an upper bound on the distance to the k-th nearest: that within the sample, own rows apart
            s = q @ points.T if len(points) else np.zeros((len(q), 0))
            s[qid[:, None] == ids[None, :]] = -np.inf
            far = np.full(len(q), np.inf)
            if s.shape[1] >= k:
                kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                far = np.where(np.isfinite(kth), np.sqrt(np.maximum((q**2).sum(axis=1) + top**2 - 2 * kth, 0.0)), np.inf) * (1 + 1e-9)
            to = [[first[leaf] + p for leaf in reach if leaf in parts for p in range(parts[leaf])] for reach in router.reached(q, far, factor)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(far), pa.array(to, pa.list_(pa.int32()))], ["vec_id", "v", "bound", "shards"])

    queries = dealt.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    routed = queries.mapInArrow(route, "vec_id long, v array<double>, bound double, shards array<int>")
    asked = routed.select(F.explode("shards").alias("shard"), F.lit(1).alias("asks"), "vec_id", "v", "bound")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, held_ids, found = None, [], [], None
        for batch in batches:
            kinds = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(kinds)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(kinds)], strict=True):
                here, asks = divmod(int(kinds[start]), 2) if end > start else (None, 0)
                if here is None:
                    continue
                if here != at:
                    at, held, held_ids, found = here, [], [], None
                if not asks:
                    held.append(_matrix(batch.column(3).slice(start, end - start)))
                    held_ids.append(batch.column(2).slice(start, end - start).to_numpy())
                    continue
                if not held:
                    continue
                if found is None:
                    found = Shard(np.concatenate(held), np.concatenate(held_ids), top)
                for i in range(start, end, ASKED):
                    part = batch.slice(i, min(ASKED, end - i))
                    yield found.nearest(part.column(2).to_numpy(), _matrix(part.column(3)), part.column(4).to_numpy(), k, factor)

    both = own.unionByName(asked)
    both = both.repartitionById(min(tasks, sum(parts.values())), F.pmod("shard", F.lit(min(tasks, sum(parts.values()))))).sortWithinPartitions("shard", "asks")
    hits = both.mapInArrow(search, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
