"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits. Two fingerprints that differ in at most two bits differ in at most one bit in one of their 32-bit halves.
The anchors of a half are the words of a covering code: the perfect (31, 26) Hamming code, whose covering radius is 1, times the free
32nd bit. A fingerprint's home anchor in a half is the code word within that radius. It is replicated to every anchor within
covering radius plus threshold (1 + 1) of its half: at most 17. Home rows meet replicas at the anchor, where the whole fingerprints are
compared; so every pair within two bits meets, whichever half holds the lesser difference.

Work: distinct fingerprints only, 2 home rows and at most 34 replicas of 16 bytes each. Copies of a text share a fingerprint and are
never paired. The join is an equi-join whose hot anchors adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SEED = 42
THRESHOLD = 2
#: Positions 1..31 of the Hamming code; parity check k covers the positions whose number has bit k.
POSITIONS = range(1, 32)
CHECKS = [sum(1 << (p - 1) for p in POSITIONS if p >> k & 1) for k in range(5)]
LOW31 = (1 << 31) - 1


def fingerprint(text: str | None, width: int = 3, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a whole text, unsigned: see ``fingerprints``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) >= width else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65_536):
        block = hashes[i : i + 65_536]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fp)`` for every row, ``fp`` the fingerprint as a signed long.

    Words are runs of bytes other than ASCII white space, after lower-casing A-Z only; a shingle is three words, repeats included; a text
    with fewer words is one shingle; a null or blank text has fingerprint zero. Bit i is set if it is set in over half the hashes.
    """

    def compute(texts: list[str | None]) -> dict:
        return {"fp": np.fromiter(map(fingerprint, texts), dtype=np.uint64, count=len(texts)).view(np.int64)}

    return common.computed(docs, id_col, text_col, compute, {"fp": "long"})


def _parity(x: Column, mask: int) -> Column:
    return F.bit_count(x.bitwiseAND(F.lit(mask))) % 2


def _half(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * k).bitwiseAND(F.lit((1 << 32) - 1))


def _syndrome(half: Column) -> Column:
    return sum((_parity(half, m) * (1 << k) for k, m in enumerate(CHECKS)), F.lit(0)).cast("long")


def anchors(fps: DataFrame, replicas: bool) -> DataFrame:
    """Rows ``(anchor, fp)``: the two home anchors of each fingerprint, or every anchor within radius 2 of each half."""
    halves = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), _half(F.col("fp"), k).alias("h")) for k in (0, 1)))).alias("x"))
    halves = halves.select("fp", "x.k", "x.h").withColumn("s", _syndrome(F.col("h")))
    shift = "case when {0} > 0 then shiftleft(1L, cast({0} as int) - 1) else 0L end"
    home = f"h ^ {shift.format('s')}"
    if not replicas:
        return halves.select(F.expr(f"shiftleft(k, 40) | ({home})").alias("anchor"), "fp")
    pairs = f"transform(filter(sequence(1L, 31L), a -> s > 0 and a < (a ^ s) and (a ^ s) <= 31), a -> h ^ {shift.format('a')} ^ {shift.format('(a ^ s)')})"
    every = f"concat(array({home}, ({home}) ^ {1 << 31}L), {pairs})"
    return halves.select(F.explode(F.expr(f"transform({every}, c -> shiftleft(k, 40) | c)")).alias("anchor"), "fp")


def links(fps: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints, a below b, that differ in at most ``threshold`` (2 at most) bits; a pair may come up to four times."""
    if threshold > 2:
        raise ValueError("the covering holds for two differing bits at most")
    home, copies = anchors(fps, False).withColumnRenamed("fp", "a"), anchors(fps, True).withColumnRenamed("fp", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold)
    return home.alias("x").join(copies.alias("y"), (F.col("x.anchor") == F.col("y.anchor")) & near).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, ``fp``, ``component_id``.

    ``component_id`` is the smallest non-null id reachable over links of fingerprints with two or fewer differing bits, the row's own
    fingerprint included; null only where no row of the component has an id. Repeated rows get equal answers; an empty table gives an empty result.
    A text of any length is read whole, in the task that holds it.
    """
    return _found(docs, id_col, text_col).select(id_col, "fp", "component_id")


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``near_duplicates``, and ``wins``: whether the row has its component's smallest id and, of the rows of the component with that id, the least fingerprint."""
    fps = common.written(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = common.written(fps.groupBy("fp").agg(F.min(id_col).alias("rep")), "classes")
    comp = components_of(classes.select("fp"))
    found = classes.join(comp, classes.fp == comp.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    least = found.groupBy("root").agg(F.min(F.when(F.col("rep").isNotNull(), F.struct("rep", "fp"))).alias("least"))
    ids = found.join(least, "root").select("fp", F.col("least.rep").alias("component_id"), (F.col("least.fp") == F.col("fp")).alias("first"))
    wins = F.coalesce(F.col("first") & (F.col(id_col) == F.col("component_id")), F.lit(False))
    return fps.join(ids, "fp").select(id_col, "fp", "component_id", wins.alias("wins"))


def components_of(fps: DataFrame) -> DataFrame:
    """``(node, component)`` of the linked fingerprints."""
    return common.components(links(fps))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one kept of each component: the row with the smallest id, one of them if that id repeats. An id that repeats with
    different texts wins in each component for itself. Rows without an id are kept only where no row of the component has one, one for
    each fingerprint. Columns as given."""
    names = docs.columns
    found = common.written(_found(docs, id_col, text_col), "found")
    winners = found.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__tl_id")).agg(F.count("*").alias("__tl_n"), F.max("wins").alias("__tl_wins")).where("__tl_wins").select("__tl_id", "__tl_n")
    # A hash join built from the ids: texts are neither sorted nor held.
    held = lambda n: docs.join(winners.where(n).hint("shuffle_hash"), F.col(id_col) == F.col("__tl_id"))
    out = held("__tl_n = 1").select(*names)
    if not winners.where("__tl_n > 1").isEmpty():
        # Rows of a repeated id are told apart by their fingerprints.
        pairs = found.where("wins").select(F.col(id_col).alias("__tl_id"), F.col("fp").alias("__tl_fp")).distinct()
        repeated = _with_fingerprint(held("__tl_n > 1").select(*names), text_col).withColumn("__tl_id", F.col(id_col))
        out = out.unionByName(repeated.join(pairs, ["__tl_id", "__tl_fp"], "left_semi").dropDuplicates(["__tl_id", "__tl_fp"]).select(*names))
    lone = found.where(F.col(id_col).isNull() & F.col("component_id").isNull()).select(F.col("fp").alias("__tl_fp")).distinct()
    if not lone.isEmpty():
        nameless = _with_fingerprint(docs.where(F.col(id_col).isNull()), text_col)
        out = out.unionByName(nameless.join(lone, "__tl_fp").dropDuplicates(["__tl_fp"]).select(*names))
    return out


def _with_fingerprint(docs: DataFrame, text_col: str) -> DataFrame:
    at, docs_names = docs.columns.index(text_col), list(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter(map(fingerprint, b.column(at).to_pylist()), dtype=np.uint64, count=b.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fp)], names=[*docs_names, "__tl_fp"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__tl_fp", T.LongType())]))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = near_duplicates(common.table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
