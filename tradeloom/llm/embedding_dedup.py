"""Near-duplicate embeddings by spherical-cap filters that miss no pair.

Vectors are rotated by one fixed random rotation and cut into four blocks. Each block has random unit vectors, and a filter is a choice of
one of them in each of the two blocks of a half (a structured product code); its region holds the vectors that score highest with both. The
middle of two vectors at the least cosine is within sqrt((1 - cosine) / 2) of both, so in one half the squares are at most half of that. A
vector is list-decoded to every filter of each half whose region may come that near: a score behind the best by no more than the distance
allows, bounded plane by plane, with the squares of the blocks added. So both vectors are in the filter of their middle. There is no fixed
list, beam or number of directions; the lists are as long as the bound makes them. Vectors meet in filters of their label and length, and
meetings are verified by cosine in double precision.

No pairs are shuffled or written. Vectors that no other vector meets drop out by a count. In each filter the remaining vectors are
compared in blocks; a link is counted only in the smallest filter that both vectors share, so the counts of the filters add up to
the exact number of links found. A filter with more vectors than a block is dealt out as pairs of blocks, so a hot filter is no hot
task. Equal vectors are one class with a multiplicity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCKS = 4
#: Parts of the blocks that have filters of their own.
HALVES = 2
BLOCK_ROWS = 1024
COSINE = 0.98
SEED = 20_240_501


def directions_per_block(vectors: int) -> int:
    """Random vectors in each block of the code. Filters grow with their square, lists and decoding with them; comparing falls with the square. The
    cube root keeps these costs in step."""
    return max(16, round(0.43 * max(vectors, 1) ** (1 / 3)))


def product_code(dims: int, per_block: int, seed: int = SEED) -> list[np.ndarray]:
    """The unit vectors of each block. A vector with fewer components than blocks has as many blocks as components."""
    rng = np.random.default_rng(seed)
    out = []
    for part in np.array_split(np.arange(dims), min(BLOCKS, dims)):
        r = rng.standard_normal((per_block, len(part)))
        r /= np.linalg.norm(r, axis=1, keepdims=True)
        out.append(np.unique(np.sign(r), axis=0) if len(part) == 1 else r)
    return out


def list_decode(unit: np.ndarray, code: list[np.ndarray], cosine: float = COSINE) -> np.ndarray:
    """For each unit vector the ids of all filters whose region may hold the middle of it and a vector at ``cosine`` or more: an array of arrays.
    Two such vectors share a filter."""
    halves = np.array_split(np.arange(len(code)), min(HALVES, len(code)))
    reach = (1 - cosine) / 2 / len(halves) + 1e-9
    rows, names, at = [], [], 0
    for h, blocks in enumerate(halves):
        row, cost, ids = np.arange(len(unit)), np.zeros(len(unit)), np.zeros(len(unit), dtype=np.int64)
        for k in blocks:
            size, width = code[k].shape
            p = unit[:, at : at + width] @ code[k].T
            at += width
            apart = np.linalg.norm(code[k][:, None] - code[k][None], axis=2)
            np.fill_diagonal(apart, 1)
            # the squared distance to a region is at least that to the farthest of the planes that bound it
            far = np.column_stack([np.maximum((p - p[:, [c]]) / apart[c], 0).max(axis=1) for c in range(size)]) ** 2
            who, cell = np.nonzero(far <= reach)
            count = np.bincount(who, minlength=len(unit))
            times = count[row]
            of = np.repeat(np.arange(len(row)), times)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times) + (np.cumsum(count) - count)[row[of]]
            total = cost[of] + far[who[nth], cell[nth]]
            near = total <= reach
            of, nth, cost = of[near], nth[near], total[near]
            row, ids = row[of], ids[of] * size + cell[nth]
        rows.append(row)
        names.append(ids + (h << 30))
    row, ids = np.concatenate(rows), np.concatenate(names)
    ids = ids[np.argsort(row, kind="stable")]
    ends = np.cumsum(np.bincount(row, minlength=len(unit)))
    out = np.empty(len(unit), dtype=object)
    out[:] = [ids[s:e] for s, e in zip([0, *ends[:-1]], ends)]
    return out


@lru_cache(maxsize=8)
def _rotated_code(dims: int, per_block: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The fixed rotation of a vector length, which spreads the energy evenly over the blocks, and its code."""
    return np.linalg.qr(np.random.default_rng(SEED + 1).standard_normal((dims, dims)))[0], product_code(dims, per_block)


def _valid(vectors: DataFrame) -> DataFrame:
    """Rows that can link: label and id not null; no null or non-finite component; not zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & some)


def _decoded(classes: DataFrame, per_block: int, cosine: float) -> DataFrame:
    """``cid``, ``copies``, ``label``, ``filters`` of each class; its vector and its filters also as bytes, which cost Python nothing to read.
    Floats travel as floats: they are the same numbers as doubles."""
    classes = classes.select("cid", "copies", "label", "embedding")
    label, kind = classes.schema["label"].dataType.simpleString(), _bytes_of(classes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, b in batch.groupby(batch["embedding"].map(len), sort=False):
                rotation, code = _rotated_code(dims, per_block)
                x = np.array(b["embedding"].tolist(), dtype=np.float64)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                lists = list_decode(x / np.linalg.norm(x, axis=1, keepdims=True) @ rotation, code, cosine)
                filters = [v + (dims << 32) for v in lists]
                yield b[["cid", "copies", "label"]].assign(filters=filters, vector=[np.asarray(v, dtype=kind).tobytes() for v in b["embedding"]], names=[v.astype("<i4").tobytes() for v in lists])

    return classes.mapInPandas(run, f"cid long, copies long, label {label}, filters array<bigint>, vector binary, names binary")


def _bytes_of(vectors: DataFrame) -> str:
    """The type of components as bytes."""
    return "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"


def _units(vectors: pd.Series, kind: str) -> np.ndarray:
    """Vectors of one length, from bytes, at length one."""
    x = np.frombuffer(b"".join(vectors), dtype=kind).reshape(len(vectors), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _linked_in_filter(x: np.ndarray, g: pd.DataFrame, cosine: float) -> pd.DataFrame | None:
    """The links of one pair of blocks of one filter: for each class the rows linked to it here, and a root that joins linked classes."""
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    if not near.any():
        return None
    if g["i"].iat[0] != g["j"].iat[0]:
        near &= g["own"].to_numpy()[:, None] != g["own"].to_numpy()[None, :]
    rows = np.flatnonzero(near.any(axis=1))
    if not len(rows):
        return None
    g, near = g.iloc[rows], near[np.ix_(rows, rows)]
    f, lists = g["filter"].iat[0] & 0xFFFFFFFF, [np.frombuffer(v, dtype="<i4") for v in g["names"]]
    names, counts = np.unique(np.concatenate([v[v < f] for v in lists]), return_counts=True)
    names = names[counts > 1]
    if len(names):
        has = np.zeros((len(g), len(names)), dtype=np.float32)
        for row, v in enumerate(lists):
            has[row, np.flatnonzero(np.isin(names, v, assume_unique=True))] = 1
        near &= ~((has @ has.T) > 0)
    ids, m = g["cid"].to_numpy(), g["copies"].to_numpy()
    rows = np.flatnonzero(near.any(axis=1))
    if not len(rows):
        return None
    near = near[np.ix_(rows, rows)]
    ids, m = ids[rows], m[rows]
    root = ids.copy()
    while True:
        low = np.where(near, root[None, :], np.iinfo(np.int64).max).min(axis=1)
        low = np.minimum(low, root)
        if (low == root).all():
            break
        root = low
    return pd.DataFrame({"cid": ids, "links": near.astype(np.int64) @ m, "root": root})


def _starts(b: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where runs of equal keys begin, and the end."""
    turn = np.ones(len(b) + 1, dtype=bool)
    turn[1:-1] = False
    for k in keys:
        v = b[k].to_numpy()
        turn[1:-1] |= v[1:] != v[:-1]
    return np.flatnonzero(turn)


def _compare(rows: DataFrame, cosine: float, kind: str) -> DataFrame:
    keys = ["label", "filter", "i", "j"]

    def linked(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """The links of whole cells. All vectors of one length are read at once."""
        b = b.assign(dims=b["filter"] // (1 << 32))
        ends = _starts(b, ["dims"])
        for s, e in zip(ends[:-1], ends[1:]):
            part = b.iloc[s:e]
            x, cells = _units(part["vector"], kind), _starts(part, keys)
            for c, d in zip(cells[:-1], cells[1:]):
                if d - c > 1 and (found := _linked_in_filter(x[c:d], part.iloc[c:d], cosine)) is not None:
                    yield found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for b in batches:
            if rest is not None:
                b = pd.concat([rest, b], ignore_index=True)
            last = _starts(b, keys)[-2] if len(b) else 0
            found, rest = list(linked(b.iloc[:last])), b.iloc[last:]
            if found:
                yield pd.concat(found, ignore_index=True)
        if rest is not None:
            yield from linked(rest)

    ordered = rows.repartition("label", "filter", "i", "j").sortWithinPartitions("label", "filter", "i", "j", "cid")
    return ordered.mapInPandas(run, "cid long, links long, root long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per input row: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Input: ``vec_id``, ``embedding``, ``label``; other columns are ignored. Rows whose id or label is null, and vectors that are null, empty,
    zero or hold null or non-finite components, link with nothing (an empty table gives an empty result): no links, their own component, kept (null id: component null, not
    kept). Equal vectors of one label are linked, whatever their ids; a repeated id is a vector of its own in the counts. Vectors of
    each length link among themselves.
    """
    spark = vectors.sparkSession
    common.bound_batches(spark)
    base = vectors.select("vec_id", "embedding", "label")
    classes = _valid(base).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = common.written(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors")
    lists = common.written(_decoded(classes, directions_per_block(classes.count()), cosine), "filters")
    slim = lists.select("label", "cid", F.explode("filters").alias("filter"))
    # written, so that its size is known: one row a filter, broadcast if Spark finds it small, else joined by shuffles
    met = common.written(slim.groupBy("label", "filter").agg(F.count("*").alias("n")).where("n > 1"), "met")
    slim = slim.join(met, ["label", "filter"]).withColumn("blocks", F.expr(f"cast((n + {BLOCK_ROWS - 1}) div {BLOCK_ROWS} as int)"))
    slim = slim.withColumn("own", F.expr("cast(pmod(xxhash64(cid), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    slim = slim.select("label", "filter", "cid", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = slim.join(lists.select("cid", "copies", "vector", "names"), "cid")
    found = common.written(_compare(rows, cosine, _bytes_of(base)), "links")
    comp = common.components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    answer = classes.join(counts, "cid", "left").join(comp, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("component", "cid"))
    least = answer.groupBy("root").agg(F.min("rep").alias("component_id"))
    answer = answer.join(least, "root").select("label", "embedding", F.expr("copies - 1 + coalesce(links, 0)").alias("n_links"), "component_id")
    out = base.join(answer, ["label", "embedding"], "left")
    alone = F.col("vec_id").isNull() | F.col("component_id").isNull()
    comp_id = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.when(alone, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("vec_id") == comp_id, F.lit(False)).alias("kept"))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links, component and whether it is kept."""
    return near_duplicates(common.table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
