"""Micro-batch ingestion, and extensions that Structured Streaming gives: windows, late data, sessions, as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import fingerprint
from ..operators.keyed import ingest, rows
from ..plans.registry import query
from ..plans.storage import scratch
from ..plans.tables import table

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of events as they arrive in a folder."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest_stream(events: DataFrame, target: str, checkpoint: str):
    """Append what ``target``, a table kept by key, does not have yet, by fingerprint, batch by batch until the folder is read. A batch reads only the partitions of keys that may be there, and a batch that is run again appends nothing."""

    def add(batch: DataFrame, _: int) -> None:
        ingest(batch.withColumn("fingerprint", fingerprint("event_type", "user_id", "props")), target, ["fingerprint"], ["event_id"])

    return events.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


@query("SELECT DISTINCT sha256(concat_ws('|', event_type, CAST(user_id AS VARCHAR), coalesce(props, 'null'))) AS fingerprint, event_type, user_id FROM events")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as files that arrive in a folder, some of them twice, ingested batch by batch."""
    folder, target, checkpoint = (scratch(spark, f"ingest-{x}") for x in ("in", "out", "checkpoint"))
    e = table(spark, sf_dir, "events").select(*(c.split()[0] for c in EVENT.split(", ")))
    for some in ("event_id % 2 = 0", "event_id % 3 > 0"):
        e.where(some).write.mode("append").parquet(folder)
        ingest_stream(stream(spark, folder), target, checkpoint).awaitTermination()
    e.where("event_id % 6 = 3").write.mode("append").parquet(folder)
    ingest_stream(stream(spark, folder), target, checkpoint).awaitTermination()
    return rows(spark, target).select("fingerprint", "event_type", "user_id")


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type; on a stream, with what comes later than ``late`` left out."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("starts"), "event_type", "events", "total")


@query("SELECT date_trunc('hour', ts) AS starts, event_type, count(*) AS events, CAST(round(sum(CAST(round(value * 100) AS BIGINT)) / 100.0::DOUBLE, 2) AS DOUBLE) AS total FROM events GROUP BY ALL")
def ext_tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: hourly windows. The same function serves a stream."""
    e = table(spark, sf_dir, "events", "ts", "event_type", "value")
    cents = e.withColumn("value", F.round(F.col("value") * 100).cast("long"))
    return tumbling(cents).withColumn("total", F.round(F.col("total") / F.lit(100.0), 2))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM g)
SELECT user_id, min(ts) AS starts, count(*) AS events FROM s GROUP BY user_id, n""")
def ext_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sessions of a user with gaps under half an hour."""
    e = table(spark, sf_dir, "events", "ts", "user_id")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("starts"), "events")


@query("SELECT r_name AS region, n_name AS nation, count(*) AS suppliers, GROUPING(r_name, n_name) AS level FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def ext_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: subtotals by region and nation."""
    s, n, r = table(spark, sf_dir, "supplier", "s_nationkey"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.rollup(F.col("r_name").alias("region"), F.col("n_name").alias("nation")).agg(F.count("*").alias("suppliers"), F.grouping_id().alias("level"))


@query("""SELECT o_orderkey, e.event_id AS event_id FROM (SELECT o_orderkey, o_custkey, TIMESTAMP '2024-01-02' + to_days(CAST(o_orderkey % 27 AS INTEGER)) AS at FROM orders) o ASOF JOIN (SELECT user_id, max(event_id) AS event_id, ts FROM events GROUP BY user_id, ts) e ON o.o_custkey = e.user_id AND o.at >= e.ts""")
def ext_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: each order's newest event at or before it. Orders and events of a customer are read in one sorted run: no pairs are made."""
    from pyspark.sql.window import Window

    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select("o_orderkey", F.col("o_custkey").alias("k"), F.expr("TIMESTAMP '2024-01-02' + make_interval(0, 0, 0, cast(o_orderkey % 27 as int))").alias("at"), F.lit(None).cast("long").alias("e"))
    e = table(spark, sf_dir, "events", "user_id", "event_id", "ts").select(F.lit(None).cast("long").alias("o_orderkey"), F.col("user_id").alias("k"), F.col("ts").alias("at"), F.col("event_id").alias("e"))
    w = Window.partitionBy("k").orderBy("at", F.col("e").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    return o.unionByName(e).withColumn("event_id", F.last("e", ignorenulls=True).over(w)).where("o_orderkey is not null and event_id is not null").select("o_orderkey", "event_id")


@query("SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def ext_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: nations with customers and with rich suppliers."""
    return table(spark, sf_dir, "customer", F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier", "s_acctbal", "s_nationkey").where("s_acctbal > 5000").select("s_nationkey"))
