"""Mixing sources to target weights by balanced sampling with the cube method.

A source's target over its size gives the copies each of its documents should have. The whole part is certain; the fraction is an
inclusion probability. The flight phase moves these probabilities: of three undecided documents it finds the direction that changes
neither the expected number of documents nor the expected number of words (the null space of the two constraints), and goes along it, to one
side or the other with odds that keep the expectation, until a probability reaches 0 or 1. Blocks of a source fly on their own, in
parallel; each leaves at most two documents undecided, and ``LANDING`` of all sizes that it does not touch. These fly again, many blocks'
rests together, until a source is one block. What its last flight leaves is the landing problem. Every rounding of these is tried; of those whose number of documents is within one of the expected number, that with
the nearest number of words is taken. No decision of a flight is changed.

Blocks hold a bounded number of documents, chosen by a hash, so a hot source is many blocks. Random choices come from a generator seeded by
source and block, over rows in a fixed order, so reruns agree. Only ids, sizes and hashes are shuffled, never texts.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Weights of the sources in their order, repeating.
WEIGHTS = (1, 2, 3)
CAP = 3
#: Documents of a block of the first flight, and blocks whose rests fly together.
BLOCK = 4096
REST_BLOCKS = 512
#: Documents of a block, evenly spread over its sizes, that stay out of its flight.
LANDING = 12
WORD = r"[^\x20\x09-\x0D]+"
EDGE = 1e-9


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: all 0 or 1 but for at most two."""
    p, size = p.tolist(), size.tolist()
    open_, rest = [], [k for k in range(len(p)) if EDGE < p[k] < 1 - EDGE]
    for k in range(len(p)):
        p[k] = 0.0 if p[k] <= EDGE else 1.0 if p[k] >= 1 - EDGE else p[k]
    draws = iter(rng.random(len(rest) + 3).tolist())
    at = 0
    while True:
        while len(open_) < 3 and at < len(rest):
            open_.append(rest[at])
            at += 1
        if len(open_) < 3:
            break
        a, b, c = open_
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if u == (0, 0, 0):
            u = (1, -1, 0)
        up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(open_, u) if x)
        down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(open_, u) if x)
        step = up if next(draws) * (up + down) < down else -down
        still = []
        for k, x in zip(open_, u):
            v = p[k] + step * x
            p[k] = 0.0 if v <= EDGE else 1.0 if v >= 1 - EDGE else v
            if 0.0 < p[k] < 1.0:
                still.append(k)
        open_ = still
    return np.array(p)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The undecided probabilities (``LANDING`` + 2 at most) rounded: of the roundings whose number of documents is within one of its expectation, that whose
    words come nearest to theirs; ties to the nearer number of documents, then to the first documents."""
    undecided = np.flatnonzero((p > 0) & (p < 1))
    if not len(undecided):
        return p
    own, words = p[undecided], size[undecided]
    sides = (np.arange(1 << len(undecided))[:, None] >> np.arange(len(undecided)) & 1).astype(np.float64)
    documents_off, words_off = np.abs(sides.sum(axis=1) - own.sum()), np.abs(sides @ words - own @ words)
    out = p.copy()
    out[undecided] = sides[np.lexsort((documents_off, words_off, documents_off >= 1))[0]]
    return out


def _fly(key: tuple, g: pd.DataFrame, last: bool) -> pd.DataFrame:
    """One block's flight, and for the last one the landing. Some documents of all sizes stay out of the flight, so that what comes after can end on them."""
    by, up = (["size", "draw", "doc_id", "h"], [False, True, True, True]) if last else (["draw", "doc_id", "h", "size"], True)
    g = g.sort_values(by, ascending=up, kind="stable", na_position="last", ignore_index=True)
    name = "" if key[0] is None else str(key[0])
    rng = np.random.default_rng([zlib.crc32(name.encode("utf-8", "surrogatepass")), key[0] is None, int(key[1])])
    size, p = (g["size"] * g["rows"]).to_numpy(dtype=np.float64), g["p"].to_numpy(dtype=np.float64)
    flies = np.ones(len(p), dtype=bool)
    flies[np.argsort(size, kind="stable")[np.unique((np.arange(LANDING) + 0.5) * len(p) // LANDING).astype(int)]] = False
    out = p.copy()
    out[flies] = flight(p[flies], size[flies], rng)
    return g.assign(p=landing(out, size) if last else out)


def _flier(last: bool):
    def fly(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return _fly(key, g, last)

    return fly


def source_targets(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``units``, ``target``.

    Sources are weighed in the order of their names by code point, null last. Targets share the words of all sources by weight; one that
    exceeds ``cap`` times its source's size stops there, and what it leaves is shared anew among the others.
    """
    per = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("units"))
    per = per.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    per = common.written(per, "sources")
    # A row per partition of the sources, as many as the session shuffles into; not one per source.
    starts, seen = [], 0
    for r in per.groupBy("part").count().orderBy("part").collect():
        starts.append((r["part"], seen))
        seen += r["count"]
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("within") + F.col("start")) % len(weights) + 1).cast("int"))
    numbered = per.withColumn("within", within).join(per.sparkSession.createDataFrame(starts, "part int, start long"), "part")
    ranked = common.written(numbered.select("source", "source_size", "units", weight.alias("weight")), "weights")
    most = F.col("source_size") * cap
    # In the order of size over weight, sources stop as long as the next one's share of what is left exceeds what it may take: a running sum, by ranges of the order.
    ranged = common.written(ranked.select("source_size", "weight", (most / F.col("weight")).alias("ratio")).repartitionByRange("ratio").withColumn("part", F.spark_partition_id()), "ratios")
    offsets, words, left = [], 0, 0
    for r in ranged.groupBy("part").agg(F.sum(most).alias("words"), F.sum("weight").alias("weight")).orderBy("part").collect():  # a row per range
        offsets.append((r["part"], words, left))
        words, left = words + r["words"], left + r["weight"]
    total, level = words // cap, 0.0
    before = Window.partitionBy("part").orderBy("ratio", "source_size", "weight").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.join(ranged.sparkSession.createDataFrame(offsets, "part int, words_before long, weight_before long"), "part").withColumn("gone", F.col("words_before") + F.coalesce(F.sum(most).over(before), F.lit(0))).withColumn("used", F.col("weight_before") + F.coalesce(F.sum("weight").over(before), F.lit(0)))
    goes_on = most < F.col("weight") * ((total - F.col("gone")).cast("double") / (left - F.col("used")).cast("double"))
    last = summed.where(~goes_on).agg(F.min(F.struct("part", "ratio", "source_size", "weight", "gone", "used")).alias("r")).first()["r"]
    if last:
        level = (total - last["gone"]) / (left - last["used"])
    return ranked.select("source", "source_size", "units", F.least(F.col("weight") * F.lit(float(level)), most.cast("double")).alias("target"))


def sized_units(docs: DataFrame) -> DataFrame:
    """Distinct rows ``doc_id``, ``source``, ``size`` (words), ``h`` (hash of the text) with ``rows``, the number of equal ones."""
    slim = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("h"))
    return slim.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("rows"))


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``h``, ``rows``, ``source_size``, ``target``, ``copies`` for each unit of ``sized_units``.

    Input: ``doc_id``, ``text``, ``source``, any of them null; other columns are ignored. Equal rows (same id, source and text) are decided
    together. A null text has size 0; a source without words has target 0, and its documents one copy each. No document has over ``cap`` copies.
    Documents of equal size are told apart by a hash of id and text. A text of any length is counted where it is read; an empty table gives
    an empty result.
    """
    kind = docs.schema["doc_id"].dataType
    units = common.written(sized_units(docs.withColumn("doc_id", F.col("doc_id").cast("string"))), "units")  # ids as text: pandas would make longs beside nulls doubles
    targets = common.written(source_targets(units, weights, cap), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0)
    plan = units.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    whole = F.floor(rate + EDGE).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("p", F.greatest(F.lit(0.0), rate - whole)).withColumn("draw", F.xxhash64("doc_id", "h", F.lit(17)))
    blocks = f"cast(ceil(units / {BLOCK}) as long)"
    plan = plan.withColumn("block", F.expr(f"pmod(xxhash64(doc_id, h, 29), {blocks})"))
    most = targets.agg(F.max(F.expr(blocks))).first()[0] or 1
    done = [plan.where(f"p <= {EDGE}").withColumn("p", F.lit(0.0))]
    flying, schema = plan.where(f"p > {EDGE}"), plan.schema
    while True:
        last = most <= 1
        flown = flying.groupBy("source", "block").applyInPandas(_flier(last), schema)
        flown = common.written(flown, "flight")
        done.append(flown if last else flown.where("p = 0 or p = 1"))
        if last:
            break
        flying, most = flown.where("p > 0 and p < 1").withColumn("block", F.expr(f"block div {REST_BLOCKS}")), math.ceil(most / REST_BLOCKS)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "source", "size", "h", "rows", "source_size", "target", (F.col("whole") + F.col("p").cast("long")).alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The documents, each repeated as often as the mix takes it; columns as given."""
    names = docs.columns
    plan = copies(docs, weights, cap).where("copies > 0").select(F.col("doc_id").alias("__tl_id"), F.col("source").alias("__tl_source"), F.col("h").alias("__tl_h"), F.col("copies").alias("__tl_copies"))
    keyed = docs.withColumn("__tl_hash", F.xxhash64("text"))
    met = keyed.join(plan.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__tl_id")) & F.col("source").eqNullSafe(F.col("__tl_source")) & (F.col("__tl_hash") == F.col("__tl_h")))
    return met.withColumn("__tl_copy", F.explode(F.expr("sequence(1L, __tl_copies)"))).select(*names)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, its source's size and target, and the words the mix takes of it."""
    plan = copies(common.table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    each = plan.withColumn("_row", F.explode(F.expr("sequence(1L, rows)")))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
