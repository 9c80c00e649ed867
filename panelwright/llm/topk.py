"""Exact top-k inner products by dual-tree search over cover trees."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import cut
from panelwright.llm.vectors import by_dimension, usable

#: Points of a leaf of data and of queries at most (queries' are smaller, so that their groups are narrow), and how much less each level covers.
LEAF, QUERY_LEAF, SHRINK = 64, 8, 1.3
#: Rows of a block of queries and of data; points that blocks gather around at most (4,096 of 64 components are 2 MB).
QUERY_BLOCK, DATA_BLOCK, MOST_PIVOTS = 2048, 8192, 4096


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)))


class Tree:
    """A cover tree, top down. A node's children are centred on points more than its radius / SHRINK apart and each of its points is within that of a child's centre, whose child it becomes; single points are children like others. A node of up to `leaf` points is a leaf.

    Nodes stand in arrays: center, radius, norm; points lo to hi of x (which is reordered), children from first to last.
    """

    FIELDS = ("x", "ids", "center", "radius", "norm", "lo", "hi", "first", "last")

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> None:
        order = np.arange(len(x))
        nodes = [(0, len(x), order[0])]  # (lo, hi, the point it is centred on)
        radius, first, last = [], [], []
        at = 0
        while at < len(nodes):
            lo, hi, c = nodes[at]
            far = np.sqrt(((x[order[lo:hi]] - x[c]) ** 2).sum(1))
            radius.append(float(far.max()) * (1 + 1e-12))
            first.append(len(nodes))
            if hi - lo > leaf and radius[at] > 0:
                groups = self._net(x, order[lo:hi], radius[at] / SHRINK)
                if len(groups) > 1:
                    a = lo
                    for center, points in groups:
                        order[a : a + len(points)] = points
                        nodes.append((a, a + len(points), center))
                        a += len(points)
            last.append(len(nodes))
            at += 1
        lo, hi, c = (np.array(z) for z in zip(*nodes, strict=True))
        self.x, self.ids, self.center, self.radius, self.lo, self.hi = x[order], ids[order], x[c], np.array(radius), lo, hi
        self.norm, self.first, self.last = np.linalg.norm(self.center, axis=1), np.array(first), np.array(last)

    @staticmethod
    def _net(x: np.ndarray, left: np.ndarray, r: float) -> list[tuple[int, np.ndarray]]:
        """(centre, points) of groups whose centres are more than r apart and cover their points within r."""
        groups = []
        while len(left):
            some = left[:32]
            d = _distances(x[some], x[left])
            chosen: list[int] = []
            for i in range(len(some)):
                if all(d[j, i] > r for j in chosen):
                    chosen.append(i)
            near = d[chosen]
            near[np.arange(len(chosen)), chosen] = -1  # a centre is its own, whatever rounding says
            own, covered = near.argmin(0), near.min(0) <= r
            groups += [(some[c], left[covered & (own == k)]) for k, c in enumerate(chosen)]
            left = left[~covered]
        return groups

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(data)) as z:
            for f in cls.FIELDS:
                setattr(tree, f, z[f])
        return tree


def bound(center: np.ndarray, radius: float, norm: float, centers: np.ndarray, radii: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """No point within `radius` of `center` has a greater inner product with one within radii of centers; a little more for rounding."""
    best = centers @ center + radius * norms + radii * norm + radius * radii
    return best + 1e-9 * (np.abs(best) + norm * norms + 1)


class Search:
    """The k best of data for each query, scores descending, then ids ascending; floors are scores that each query's kth is known to reach.

    A query node meets a set of data nodes: those whose bound is below the worst kth score of its queries
    go; nodes wider than it are replaced by their children; then its own children take over what is left.
    At leaves the data nodes are scored best bound first, so that worst scores rise early.
    """

    def __init__(self, queries: Tree, data: Tree, k: int, floors: np.ndarray | None = None) -> None:
        self.q, self.d, self.k, self.scored = queries, data, k, 0
        n = len(queries.x)
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.floor = np.full(n, -np.inf) if floors is None else floors
        todo = [(0, np.array([0]))]
        while todo:
            todo += self.visit(*todo.pop())

    def worst(self, a: int) -> float:
        s = slice(self.q.lo[a], self.q.hi[a])
        return np.maximum(self.score[s, -1], self.floor[s]).min()

    def visit(self, a: int, b: np.ndarray) -> list[tuple[int, np.ndarray]]:
        q, d = self.q, self.d
        leaf = q.first[a] == q.last[a]
        while True:
            best = bound(q.center[a], q.radius[a], q.norm[a], d.center[b], d.radius[b], d.norm[b])
            b = b[best >= self.worst(a)]
            split = (d.first[b] < d.last[b]) & (leaf | (d.radius[b] >= q.radius[a]))
            if not split.any():
                break
            b = np.r_[b[~split], np.concatenate([np.arange(d.first[i], d.last[i]) for i in b[split]])]
        if not len(b):
            return []
        if not leaf:
            return [(c, b) for c in range(q.first[a], q.last[a])]
        best = bound(q.center[a], q.radius[a], q.norm[a], d.center[b], d.radius[b], d.norm[b])
        order = np.argsort(-best)
        b, best = b[order], best[order]
        upto = np.cumsum(d.hi[b] - d.lo[b])
        at = 0
        while at < len(b) and best[at] >= self.worst(a):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 1024, "right")))
            self.meet(a, np.concatenate([np.arange(d.lo[i], d.hi[i]) for i in b[at:to]]))
            at = to
        return []

    def meet(self, a: int, points: np.ndarray) -> None:
        rows = slice(self.q.lo[a], self.q.hi[a])
        s = self.q.x[rows] @ self.d.x[points].T
        self.scored += s.size
        s[self.q.ids[rows][:, None] == self.d.ids[points][None, :]] = -np.inf
        good = (s >= np.maximum(self.score[rows, -1], self.floor[rows])[:, None]) & (s > -np.inf)
        for i in np.flatnonzero(good.any(1)):
            some, row = np.flatnonzero(good[i]), i + self.q.lo[a]
            if len(some) > self.k:
                kth = np.partition(s[i, some], len(some) - self.k)[len(some) - self.k]
                some = some[s[i, some] >= kth]
            score, ids = np.r_[self.score[row], s[i, some]], np.r_[self.id[row], self.d.ids[points[some]]]
            order = np.lexsort((ids, -score))[: self.k]
            self.score[row], self.id[row] = score[order], ids[order]


FLOORS = "dim int, pivot int, salt int, floors array<double>"
BLOCKS = "side string, dim int, pivot int, salt int, center array<double>, radius double, tree binary"


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """The k best inner products of every query: (query_id, rank, vec_id, score), all long but rank.

    Components count as floor(scale * x); queries are the rows whose vec_id is divisible by `every`,
    candidates all rows with another vec_id. Ties go to smaller ids; a query with fewer candidates gets
    them all. Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows
    without an id; of rows that repeat a query's id one is the query, of candidates each counts. Rows that are
    equal in both are counted before they move, and k of them stand for any more, which no result could show. Vectors
    meet those of their own dimension. Other columns are not read; an empty table gives no rows.

    Rows gather around pivots, up to MOST_PIVOTS rows of the table chosen by a hash, each at its nearest; a
    pivot with more rows than a block takes several. Each block is indexed once in a cover tree. Every block
    of queries first searches one block of its own pivot, which gives each query a score that its kth
    reaches. Blocks of data whose pivot's bound is below the worst of these are not met at all; each other
    pair of blocks is a task of its own, a dual-tree search that starts from those scores and gives k rows
    a query. Exact as long as the sum of products of the scaled components stays under 2**53.
    """
    v = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    v = v.withColumn("e", F.transform("e", lambda x: F.floor(F.lit(float(scale)) * x).cast("double")))
    n = v.count()
    sample = v.orderBy(F.xxhash64("vec_id", "e")).limit(min(MOST_PIVOTS, -(-max(1, n) // DATA_BLOCK))).select("e").collect()
    pivots: dict[int, np.ndarray] = {}
    for x in sample:
        pivots.setdefault(len(x["e"]), []).append(x["e"])
    pivots = {d: np.array(p) for d, p in pivots.items()}

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            for at, x in by_dimension(batch.column(1)):
                p = pivots.get(x.shape[1], np.zeros((1, x.shape[1])))  # a rare dimension gathers around zero
                far = _distances(x, p)
                own = far.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.full(len(at), x.shape[1], np.int32)), pa.array(own.astype(np.int32)), pa.array(np.linalg.norm(x - p[own], axis=1))], ["vec_id", "e", "dim", "pivot", "far"])

    placed = v.mapInArrow(place, "vec_id long, e array<double>, dim int, pivot int, far double").groupBy("vec_id", "e", "dim", "pivot", "far").agg(F.count("*").alias("n"))
    placed = cut(placed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")))).drop("n"))
    is_query = F.col("vec_id") % every == 0
    around = placed.groupBy("dim", "pivot").agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.max("far").alias("radius"))
    near = {}  # a row a pivot, and one for each dimension without
    for r in around.collect():
        near.setdefault(r["dim"], []).append((r["pivot"], r["radius"]))
    rows = placed.join(around.select("dim", "pivot", "n", "q"), ["dim", "pivot"])
    salt = lambda count, most: F.pmod(F.xxhash64("vec_id", "e", "copy"), F.ceil(F.col(count) / most)).cast("int")
    data = rows.select(F.lit("d").alias("side"), "dim", "pivot", salt("n", DATA_BLOCK).alias("salt"), "vec_id", "e")
    queries = rows.where(is_query).dropDuplicates(["vec_id"]).select(F.lit("q").alias("side"), "dim", "pivot", salt("q", QUERY_BLOCK).alias("salt"), "vec_id", "e")

    def index(key, t):
        import pyarrow as pa

        side, dim, pivot, salt = (x.as_py() for x in key)
        (_, x), = by_dimension(t["e"])
        tree = Tree(x, np.asarray(t["vec_id"]), QUERY_LEAF if side == "q" else LEAF)
        return pa.table({"side": [side], "dim": pa.array([dim], pa.int32()), "pivot": pa.array([pivot], pa.int32()), "salt": pa.array([salt], pa.int32()), "center": [tree.center[0].tolist()], "radius": [tree.radius[0]], "tree": pa.array([tree.dump()], pa.binary())})

    trees = cut(data.unionByName(queries).groupBy("side", "dim", "pivot", "salt").applyInArrow(index, BLOCKS))
    q = trees.where("side = 'q'").select("dim", "pivot", "salt", "center", "radius", "tree")
    d = trees.where("side = 'd'").select("dim", F.col("pivot").alias("d_pivot"), F.col("salt").alias("d_salt"), F.col("tree").alias("d_tree"))

    def own(key, t):
        import pyarrow as pa

        at = {side: i for i, side in enumerate(t["side"].to_pylist())}
        found = Search(Tree.load(t["tree"][at["q"]].as_py()), Tree.load(t["tree"][at["d"]].as_py()), k)
        return pa.table({**{c: pa.array([x.as_py()], pa.int32()) for c, x in zip(("dim", "pivot", "salt"), key, strict=True)}, "floors": pa.array([found.score[:, -1].tolist()], pa.list_(pa.float64()))})

    at_home = q.select("dim", "pivot", "salt", F.lit("q").alias("side"), "tree")
    # a hash may leave a pivot's first blocks empty
    least = d.groupBy("dim", "d_pivot").agg(F.min("d_salt").alias("d_salt"))
    homes = d.join(least, ["dim", "d_pivot", "d_salt"]).select("dim", F.col("d_pivot").alias("pivot"), "d_tree").join(at_home.select("dim", "pivot", "salt"), ["dim", "pivot"])
    at_home = at_home.unionByName(homes.select("dim", "pivot", "salt", F.lit("d").alias("side"), F.col("d_tree").alias("tree")))
    floors = cut(at_home.groupBy("dim", "pivot", "salt").applyInArrow(own, FLOORS))

    def reached(batches):
        import pyarrow as pa

        for batch in batches:
            out = [[], [], [], []]
            for r in batch.to_pylist():
                dim, c = r["dim"], np.array(r["center"])
                which, radii = (np.array(x) for x in zip(*near[dim], strict=True))
                p = pivots.get(dim, np.zeros((1, dim)))[which]
                best = bound(c, r["radius"], float(np.linalg.norm(c)), p, radii * (1 + 1e-12), np.linalg.norm(p, axis=1))
                for x in which[best >= r["worst"]].tolist():
                    for o, y in zip(out, (dim, r["pivot"], r["salt"], x), strict=True):
                        o.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int32()) for o in out], ["dim", "pivot", "salt", "d_pivot"])

    groups = q.drop("tree").join(floors.select("dim", "pivot", "salt", F.array_min("floors").alias("worst")), ["dim", "pivot", "salt"])
    pairs = cut(groups.mapInArrow(reached, "dim int, pivot int, salt int, d_pivot int").join(d.select("dim", "d_pivot", "d_salt"), ["dim", "d_pivot"]))
    key = ["dim", "pivot", "salt", "d_pivot", "d_salt"]
    none = F.lit(None).cast("array<double>")
    left = pairs.join(q.select("dim", "pivot", "salt", "tree").join(floors, ["dim", "pivot", "salt"]), ["dim", "pivot", "salt"]).select(*key, F.lit("q").alias("side"), "tree", "floors")
    right = pairs.join(d, ["dim", "d_pivot", "d_salt"]).select(*key, F.lit("d").alias("side"), F.col("d_tree").alias("tree"), none.alias("floors"))

    def search(key, t):
        import pyarrow as pa

        at = {side: i for i, side in enumerate(t["side"].to_pylist())}
        queries = Tree.load(t["tree"][at["q"]].as_py())
        found = Search(queries, Tree.load(t["tree"][at["d"]].as_py()), k, np.array(t["floors"][at["q"]].as_py(), float))
        row, col = np.nonzero(found.score > -np.inf)
        return pa.table({"query_id": queries.ids[row], "vec_id": found.id[row, col], "score": found.score[row, col].astype(np.int64)})

    found = left.unionByName(right).groupBy(*key).applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
