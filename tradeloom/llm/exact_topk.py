"""Exact top-k by inner product with a KD-tree per shard.

Shards are cut in space: medians of a bounded sample split the rows into cells, and a cell of more than ``SHARD_ROWS`` rows is dealt into shards of that size. Each
shard's KD-tree (median splits of the widest component, tight bounding boxes) is built once and kept as a row of a table in the shared folder. The
cells' boxes, of which there is a bounded number, go to the queries: a query travels first to the cell of the highest bound on its inner products, then, with the k-th score
of what it has found so far, to the next cells in the order of their bounds, in rounds, and never to a cell whose bound is below that score. In a task a shard's tree comes first
and its queries stream past it, so memory is a tree and a batch. A query walks the tree best first: of the open boxes it takes the one with the highest
bound on the inner product, and stops when that bound is below its k-th score. How many cells boxes rule out depends on the vectors: of clusters most, of evenly spread vectors of 64
components hardly any, as no box bounds them well.

Scores are exact: components are whole numbers, and products are taken in double precision only where they stay below 2**53, else in
Python's integers; bounds of cells are widened by more than their rounding.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.retrieval import CELL_SHARDS, cell_of, cut_cells, smallest_hashes
from . import common

SCALE = 1024
SHARD_ROWS = 8192
LEAF = 64
#: Cells that a query may meet in the second round, and how many times as many in each round after it.
ROUND_SHARDS, ROUND_GROWTH = 16, 16
#: Lengths of vectors that are cut into cells, the most frequent ones; others are one cell. And numbers of the samples that cells are cut by, all lengths together.
LENGTHS, SAMPLED = 64, 4_000_000
LONG = (-(1 << 63), (1 << 63) - 1)


class Tree:
    """A KD-tree over whole-number points, in arrays: boxes, children, and the range of points of each leaf."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        self.lo, self.hi, self.children, self.span = [], [], [], []
        if len(points):
            self._add(points, 0, len(points), leaf)
        self.points = points[self.order]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def _add(self, points: np.ndarray, start: int, stop: int, leaf: int) -> int:
        own = points[self.order[start:stop]]
        lo, hi = own.min(axis=0), own.max(axis=0)
        node = len(self.span)
        self.lo.append(lo)
        self.hi.append(hi)
        self.span.append((start, stop))
        self.children.append(None)
        axis = int(np.argmax(hi - lo)) if own.shape[1] else 0
        if stop - start > leaf and own.shape[1] and hi[axis] > lo[axis]:
            middle = (stop - start) // 2
            part = np.argpartition(own[:, axis], middle)
            self.order[start:stop] = self.order[start:stop][part]
            self.children[node] = (self._add(points, start, start + middle, leaf), self._add(points, start + middle, stop, leaf))
        return node

    def search(self, query: np.ndarray, bounds: np.ndarray, names: np.ndarray, own: int, floor: float, k: int) -> list[tuple[float, int]]:
        """The best ``(score, position)`` of at least ``floor``: highest scores first, ties by ``names``; the point at ``own`` is left out."""
        best_s, best_p, kth = np.empty(0), np.empty(0, dtype=np.int64), floor
        heap = [(-bounds[0], 0)] if len(bounds) else []
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < kth:
                break
            if self.children[node] is not None:
                for c in self.children[node]:
                    if bounds[c] >= kth:
                        heapq.heappush(heap, (-bounds[c], c))
                continue
            start, stop = self.span[node]
            s = self.points[start:stop] @ query
            at = start + np.flatnonzero(s >= kth)
            at = at[at != own]
            if not len(at):
                continue
            best_s, best_p = np.concatenate([best_s, s[at - start]]), np.concatenate([best_p, at])
            if len(best_s) > k:
                top = np.lexsort((names[best_p], -best_s))[:k]
                best_s, best_p = best_s[top], best_p[top]
            if len(best_s) == k:
                kth = max(kth, best_s.min())
        return sorted(zip(best_s.tolist(), best_p.tolist()), key=lambda x: (-x[0], names[x[1]]))


def whole(embedding: pd.Series) -> np.ndarray:
    """floor(1024 x) of each component, as doubles."""
    return np.floor(SCALE * np.array(embedding.tolist(), dtype=np.float64).reshape(len(embedding), -1))


class Shard:
    """A shard's tree with its rows and ids."""

    def __init__(self, points: pd.DataFrame):
        x = whole(points["embedding"])
        self.tree = Tree(x)
        self.rows, self.ids = points["row"].to_numpy()[self.tree.order], points["vec_id"].to_numpy()[self.tree.order]
        self.place = {r: i for i, r in enumerate(self.rows.tolist())}
        self.largest = max(np.abs(x).max(initial=0), 1)

    def found(self, queries: pd.DataFrame, k: int) -> Iterator[tuple]:
        """Rows ``query_row``, ``query_id``, ``row``, ``vec_id``, ``score``: the best of this shard for each query, of at least its floor."""
        q = whole(queries["embedding"])
        exact = self.largest * max(np.abs(q).max(initial=0), 1) * max(q.shape[1], 1) >= 2.0**53
        if not exact:
            bounds = np.maximum(q, 0) @ self.tree.hi.T + np.minimum(q, 0) @ self.tree.lo.T
        for i, (own, name, floor) in enumerate(zip(queries["row"], queries["vec_id"], queries["floor"])):
            at = self.place.get(own, -1)
            if exact:
                v = [int(c) for c in q[i]]
                scored = ((min(max(sum(c * int(u) for c, u in zip(v, p)), LONG[0]), LONG[1]), j) for j, p in enumerate(self.tree.points) if j != at)
                best = sorted(scored, key=lambda t: (-t[0], self.ids[t[1]]))[:k]
            else:
                best = self.tree.search(q[i], bounds[i], self.ids, at, -np.inf if pd.isna(floor) else float(floor), k)
            for score, j in best:
                yield own, name, self.rows[j], self.ids[j], int(score)


FOUND = ["query_row", "query_id", "row", "vec_id", "score"]


@dataclass
class Cut:
    """The cells of the vectors of one length: how they are cut, the shards of each, and the boxes of those that hold rows."""

    nodes: list
    subs: np.ndarray | None = None
    full: np.ndarray | None = None
    lo: np.ndarray | None = None
    hi: np.ndarray | None = None

    @property
    def cells(self) -> int:
        return sum(isinstance(x, int) for x in self.nodes)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """What no product of a query and a row of a cell exceeds, widened by rounding; of cells without rows minus infinity."""
        out = np.full((len(q), self.cells), -np.inf)
        most = np.maximum(q, 0) @ self.hi.T + np.minimum(q, 0) @ self.lo.T
        size = np.abs(q) @ np.maximum(np.abs(self.hi), np.abs(self.lo)).T
        out[:, self.full] = most + size * 1e-12 * max(q.shape[1], 1) + 1
        return out


def _cuts(base: DataFrame, sizes: DataFrame) -> dict[int, Cut]:
    """The cells of each length that has more rows than a shard."""
    many = sizes.where("shards > 1").orderBy(F.desc("shards"), "dims").limit(LENGTHS).collect()
    out = {}
    for r in many:
        rows = smallest_hashes(base.where(F.col("dims") == r["dims"]), "row", r["shards"] * SHARD_ROWS, max(128, SAMPLED // (r["dims"] * len(many)))).select("embedding")
        nodes = cut_cells(whole(rows.toPandas()["embedding"]), r["shards"])
        out[r["dims"]] = Cut(nodes)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dims, g in b.groupby("dims", sort=False):
                cell, n = np.unique(cell_of(out[dims].nodes, whole(g["embedding"])), return_counts=True)
                yield pd.DataFrame({"dims": np.full(len(cell), dims), "cell": cell, "n": n})

    if out:  # a row for each cell; a cell of many rows, equal ones too, is many shards
        held = base.where(F.col("dims").isin(list(out))).select("dims", "embedding").mapInPandas(count, "dims int, cell long, n long").groupBy("dims", "cell").agg(F.sum("n").alias("n")).collect()
        for dims, cut in out.items():
            cut.subs = np.ones(cut.cells, dtype=np.int64)
            for r in held:
                if r["dims"] == dims:
                    cut.subs[r["cell"]] = -(-r["n"] // SHARD_ROWS)
    return out


def _placed(points: DataFrame, cuts: dict[int, Cut]) -> DataFrame:
    """Rows (``dims``, ``shards``, ``row``, ``vec_id``, ``embedding``) with their ``shard``."""
    vector = points.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dims, g in b.groupby("dims", sort=False):
                if cut := cuts.get(dims):
                    cell = cell_of(cut.nodes, whole(g["embedding"]))
                    g = g.assign(shard=cell * CELL_SHARDS + g["hash"].to_numpy() % cut.subs[cell])
                yield g[["dims", "shard", "row", "vec_id", "embedding"]]

    hashed = points.select("dims", F.expr("pmod(xxhash64(row, 3), shards)").alias("shard"), F.expr(f"pmod(xxhash64(row, 3), {LONG[1]})").alias("hash"), "row", "vec_id", "embedding")
    return hashed.mapInPandas(run, f"dims int, shard long, row long, vec_id long, embedding {vector}") if cuts else hashed.drop("hash")


def _boxed(trees: DataFrame, cuts: dict[int, Cut]) -> None:
    """Give the cuts the boxes of their cells, from those of their shards: a row for each cell and component."""
    for dims, cut in cuts.items():
        own = trees.where(F.col("dims") == dims).select(F.expr(f"cast(shard div {CELL_SHARDS} as int)").alias("cell"), "lo", "hi")
        sides = own.select("cell", F.posexplode(F.arrays_zip("lo", "hi")).alias("i", "b")).groupBy("cell", "i").agg(F.min("b.lo").alias("lo"), F.max("b.hi").alias("hi")).toPandas().sort_values(["cell", "i"])
        cut.full = np.sort(sides["cell"].unique()).astype(np.int64)
        cut.lo, cut.hi = (sides[c].to_numpy().reshape(len(cut.full), dims) for c in ("lo", "hi"))


def _sent(asks: DataFrame, cuts: dict[int, Cut], first: int, stop: int) -> DataFrame:
    """Queries (``dims``, ``shards``, ``row``, ``vec_id``, ``embedding``, ``floor``) with the shards of the cells that they go to: of those from ``first`` to ``stop`` in the order of their bounds the ones whose bound reaches the floor."""
    vector = asks.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dims, g in b.groupby("dims", sort=False):
                cut = cuts.get(dims)
                if cut is None:
                    if not first:
                        n = g["shards"].to_numpy()
                        yield g.iloc[np.repeat(np.arange(len(g)), n)].assign(shard=np.concatenate([np.arange(k) for k in n]))[COLUMNS]
                    continue
                bounds = cut.bounds(whole(g["embedding"]))
                order = np.argsort(-bounds, axis=1, kind="stable")[:, first:stop]
                top = np.take_along_axis(bounds, order, axis=1)
                floor = g["floor"].astype(float).fillna(-np.inf).to_numpy()[:, None]
                q, at = np.nonzero((top >= floor) & (top > -np.inf))
                cell = order[q, at]
                for sub in range(int(cut.subs[cell].max(initial=0))):
                    has = cut.subs[cell] > sub
                    yield g.iloc[q[has]].assign(shard=cell[has] * CELL_SHARDS + sub)[COLUMNS]

    return asks.mapInPandas(run, f"dims int, shard long, row long, vec_id long, embedding {vector}, floor double")


COLUMNS = ["dims", "shard", "row", "vec_id", "embedding", "floor"]


def _planted(points: DataFrame) -> DataFrame:
    """``dims``, ``shard``, ``tree`` (bytes), ``lo`` and ``hi`` (its box) of each shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def tree(parts: list[pd.DataFrame]) -> pd.DataFrame:
            own = pd.concat(parts, ignore_index=True)
            planted = Shard(own)
            return pd.DataFrame({"dims": own["dims"][:1], "shard": own["shard"][:1], "tree": [pickle.dumps(planted, protocol=5)], "lo": [planted.tree.lo[0]], "hi": [planted.tree.hi[0]]})

        parts, last = [], None
        for b in batches:
            for key, g in b.groupby(["dims", "shard"], sort=False):
                if parts and key != last:
                    yield tree(parts)
                    parts = []
                parts.append(g)
                last = key
        if parts:
            yield tree(parts)

    ordered = points.repartition("dims", "shard").sortWithinPartitions("dims", "shard", "row")
    return ordered.select("dims", "shard", "row", "vec_id", "embedding").mapInPandas(run, "dims int, shard long, tree binary, lo array<double>, hi array<double>")


def _met(trees: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Each query (``dims``, ``shard``, ``row``, ``vec_id``, ``embedding``, ``floor``) searched in its shard."""
    vector = queries.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, shard = None, None
        for b in batches:
            for own, g in b.groupby(["dims", "shard"], sort=False):
                if g["tree"].iat[0] is not None:
                    key, shard, g = own, pickle.loads(g["tree"].iat[0]), g.iloc[1:]
                if own == key and len(g):
                    yield pd.DataFrame(list(shard.found(g, k)), columns=FOUND)

    first = trees.select("dims", "shard", "tree", F.lit(-1).cast("long").alias("row"), F.lit(-1).cast("long").alias("vec_id"), F.lit(None).cast(vector).alias("embedding"), F.lit(None).cast("double").alias("floor"))
    rows = first.unionByName(queries.select("dims", "shard", F.lit(None).cast("binary").alias("tree"), "row", "vec_id", "embedding", "floor"))
    # a shard's tree sorts before its queries
    ordered = rows.repartition("dims", "shard").sortWithinPartitions("dims", "shard", "row")
    return ordered.mapInPandas(run, "query_row long, query_id long, row long, vec_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: str, k: int = 10) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: for every row where the SQL condition ``is_query`` holds, the ``k`` rows other than
    itself of the highest inner products of floor(1024 x), ties to the smaller ``vec_id``; all, if there are fewer.

    Input: ``vec_id`` (a whole number), ``embedding``; other columns are ignored. Rows whose id is null, and vectors that are null, empty or hold
    null or non-finite components, take no part. A query finds vectors of its own length, whatever lengths others have. Rows of a repeated
    id are rows of their own: each is a query, and finds the others. Scores beyond a long are cut to its range. An empty table gives an
    empty result.
    """
    spark = vectors.sparkSession
    common.bound_batches(spark)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    base = vectors.where(F.col("vec_id").isNotNull() & finite & (F.size("embedding") > 0))
    base = base.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.size("embedding").alias("dims"), F.coalesce(F.expr(is_query), F.lit(False)).alias("asks")).withColumn("row", F.monotonically_increasing_id())
    base = common.written(base, "vectors")
    sizes = common.written(base.groupBy("dims").agg(F.expr(f"cast(ceil(count(*) / {SHARD_ROWS}) as long)").alias("shards"), F.count_if("asks").alias("asked")).where("asked > 0"), "sizes")
    if sizes.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cuts = _cuts(base, sizes)
    dealt = base.join(sizes.drop("asked"), "dims")
    trees = common.written(_planted(_placed(dealt, cuts)), "trees")
    _boxed(trees, cuts)
    most = max([1, *(cut.cells for cut in cuts.values())])
    asks = dealt.where("asks").select("dims", "shards", "row", "vec_id", "embedding")
    found, first, stop = None, 0, 1
    while first < most:
        floors = asks.withColumn("floor", F.lit(None).cast("double"))
        if found is not None:
            least = common.again(found).groupBy(F.col("query_row").alias("row")).agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("floor"))
            floors = asks.join(least, "row", "left").select("dims", "shards", "row", "vec_id", "embedding", "floor")
        met = _met(trees, _sent(floors, cuts, first, stop), k)
        found = common.written(_best(met if found is None else found.unionByName(met), k).drop("rank"), "found")
        first, stop = stop, (1 + ROUND_SHARDS if stop == 1 else stop * ROUND_GROWTH)
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for every hundredth vector."""
    return top_k(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id % 100 = 0", 10)


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.w AS DOUBLE[]), CAST(c.w AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 10
"""
