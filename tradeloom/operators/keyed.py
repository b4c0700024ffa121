"""Tables kept by key: a batch reads and rewrites only the partitions that its keys fall in, and a Bloom filter tells most new keys without reading any.

A table is a folder of Parquet files, partitioned by ``key_part``, a hash of its key modulo ``PARTS``. Beside it lies a folder with a row per partition, whose
bits are the Bloom filter of the partition's keys. One writer at a time; a batch that is written again after a failure changes nothing more: the filter is written before the rows,
so it never lacks a key that the table has, and partitions are replaced as wholes, from a copy in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.storage import exists, scratch, written
from ..plans.tables import table
from .ingest import _one_of_each, fingerprint, replace_partition
from .kept import _OLD_NEW, _versions

#: Partitions of a table (choose them so that one is some hundred megabytes), bits of a partition's filter and bits that a key sets.
PARTS, BITS, PROBES = 64, 1 << 17, 5
#: Bits at most that all of the filters of a batch's doubted keys have: 8 MB, as they are sent to all executors.
ASKED_BITS = 1 << 26


def part_of(keys: list[str], parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def _places(keys: list[str], bits: int = BITS) -> Column:
    """The bits that a key sets: two other hashes, stepped."""
    first, step = (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(bits)) for seed in ("first", "step"))
    return F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: ((first + i * (2 * step + 1)) % bits).cast("int"))


def key_filter(df: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """``key_part``, ``bits``: the Bloom filter of the keys of each partition that ``df`` has, as ``bits / 64`` numbers in order."""
    set_bits = df.select("key_part", F.explode(_places(keys, bits)).alias("p")).select("key_part", F.expr("p div 64").cast("int").alias("word"), F.expr("shiftleft(1L, p % 64)").alias("bits"))
    blank = df.select("key_part").distinct().select("key_part", F.explode(F.sequence(F.lit(0), F.lit(bits // 64 - 1))).alias("word"), F.lit(0).cast("long").alias("bits"))
    words = set_bits.union(blank).groupBy("key_part", "word").agg(F.bit_or("bits").alias("bits"))
    return words.groupBy("key_part").agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("words")).select("key_part", F.col("words.bits").alias("bits"))


def maybe_kept(df: DataFrame, filters: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """``df`` with ``maybe``: false for a key that its partition's filter rules out. The filters, of bounded size, go to the rows."""
    there = F.forall(_places(keys, bits), lambda p: F.getbit(F.get(F.col("bits"), F.floor(p / 64).cast("int")), p % 64) == 1)
    return df.join(F.broadcast(filters), "key_part", "left").withColumn("maybe", F.coalesce(there, F.lit(False))).drop("bits")


def rows(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows."""
    return spark.read.parquet(path).drop("key_part")


def touched(df: DataFrame) -> list[int]:
    """The partitions that a batch falls in; no more than the table has."""
    return sorted(r[0] for r in df.select("key_part").distinct().collect())


def partitions(spark: SparkSession, path: str, parts: list[int]) -> DataFrame:
    """The rows of some partitions: the others are not listed, let alone read."""
    return spark.read.parquet(path).where(F.col("key_part").isin(parts))


def kept_of(asked: DataFrame, path: str, keys: list[str], parts: int = PARTS) -> DataFrame:
    """Keys of the table among which are all of ``asked`` that it has. The partitions of ``asked`` are read, and a filter of its keys rules out nearly all others where they are
    read, so that what a batch shuffles does not grow with the table."""
    counts = {r["key_part"]: r["count"] for r in asked.groupBy("key_part").count().collect()}
    bits = 64
    while bits < 16 * max(counts.values(), default=0) and 2 * bits * parts <= ASKED_BITS:
        bits *= 2
    known = partitions(asked.sparkSession, path, sorted(counts)).select("key_part", *keys)
    return maybe_kept(known, key_filter(asked, keys, bits), keys, bits).where("maybe").drop("maybe")


def _note(new: DataFrame, path: str, keys: list[str]) -> None:
    """Add the keys of ``new`` to the filters of their partitions. A table that has none yet, as it was written otherwise, gets them for all of its keys."""
    spark, place = new.sparkSession, f"{path}-filter"
    known = exists(spark, place)
    fresh = key_filter(new if known or not exists(spark, path) else new.select("key_part", *keys).unionByName(spark.read.parquet(path).select("key_part", *keys)), keys)
    if known:
        old = spark.read.parquet(place).where(F.col("key_part").isin(touched(new))).select(F.col("key_part"), F.col("bits").alias("old"))
        fresh = fresh.join(old, "key_part", "left").select("key_part", F.coalesce(F.zip_with("bits", "old", lambda a, b: a.bitwiseOR(b)), "bits").alias("bits"))
    replace_partition(written(fresh, "filter"), place, "key_part")


def ingest(new: DataFrame, path: str, keys: list[str], order: list[str] | None = None, parts: int = PARTS) -> DataFrame:
    """Append what the table does not have, each key once, its first row by ``order``; returns the rows appended. Keys that the filters rule out are appended
    unseen; for the others only their partitions are read, and of these only the keys, of which those that the batch has are met with it."""
    spark = new.sparkSession
    batch = _one_of_each(new, keys, order or [], False).withColumn("key_part", part_of(keys, parts))
    if exists(spark, path):
        filters = f"{path}-filter"
        batch = maybe_kept(batch, spark.read.parquet(filters), keys) if exists(spark, filters) else batch.withColumn("maybe", F.lit(True))
        batch = written(batch, "batch")
        doubted = batch.where("maybe")
        batch = batch.where("not maybe").unionByName(doubted.join(kept_of(doubted, path, keys, parts), ["key_part", *keys], "left_anti")).drop("maybe")
    batch = written(batch, "additions")
    if not batch.isEmpty():
        _note(batch, path, keys)
        batch.repartition("key_part").write.mode("append").partitionBy("key_part").parquet(path)
    return batch.drop("key_part")


def upsert(new: DataFrame, path: str, keys: list[str], order: list[str] | None = None, parts: int = PARTS) -> None:
    """Put the rows of ``new`` in place of those of equal keys; of a key that repeats the last by ``order`` counts. Only the partitions of the batch's keys are read and rewritten."""
    spark = new.sparkSession
    last = written(_one_of_each(new, keys, order or [], True).withColumn("key_part", part_of(keys, parts)), "batch")
    if last.isEmpty():
        return
    whole = last
    if exists(spark, path):
        old = partitions(spark, path, touched(last))
        whole = old.join(last.select("key_part", *keys), ["key_part", *keys], "left_anti").select(*old.columns).unionByName(last)
    whole = written(whole, "partitions")
    _note(last, path, keys)
    replace_partition(whole.repartition("key_part"), path, "key_part")


@query(_OLD_NEW + " SELECT k, v FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT k, v + 5 FROM new")
def keyed_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by key, written in two batches and then changed by a third, of which the last row of each key counts."""
    old, new = _versions(spark, sf_dir)
    path = scratch(spark, "keyed")
    upsert(old.where("k % 5 < 3"), path, ["k"])
    upsert(old.where("k % 5 >= 2"), path, ["k"])
    upsert(new, path, ["k"], ["v"])
    return rows(spark, path)


@query("""WITH f AS (SELECT event_id, sha256(concat_ws('|', event_type, CAST(user_id AS VARCHAR), coalesce(props, 'null'))) AS fingerprint FROM events)
SELECT fingerprint, coalesce(min(event_id) FILTER (event_id % 2 = 0), min(event_id)) AS event_id FROM f GROUP BY fingerprint""")
def keyed_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by fingerprint in two batches, the second of which has all of the first: each fingerprint is kept once, as it came first."""
    e = table(spark, sf_dir, "events", "event_id", "event_type", "user_id", "props")
    e = e.select(fingerprint("event_type", "user_id", "props").alias("fingerprint"), "event_id")
    path = scratch(spark, "keyed")
    ingest(e.where("event_id % 2 = 0"), path, ["fingerprint"], ["event_id"])
    ingest(e, path, ["fingerprint"], ["event_id"])
    return rows(spark, path)
