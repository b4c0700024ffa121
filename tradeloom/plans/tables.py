"""Input tables and their reading as a trading world: nations are countries, suppliers and customers companies, parts products, line items flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item as a bilateral flow: ``record_id``, ``src`` and ``dst`` (nation keys), ``part``, ``supplier``, ``customer``, ``year``, ``cents``.

    Values are whole cents, so that sums do not depend on their order.
    """
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_shipdate")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer", "c_custkey", F.col("c_nationkey").alias("dst"))
    s = table(spark, sf_dir, "supplier", "s_suppkey", F.col("s_nationkey").alias("src"))
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("record_id"), "src", "dst", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("c_custkey").alias("customer"),
        F.year("l_shipdate").alias("year"), F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long").alias("cents"),
    )


#: The same as SQL, to begin a statement with.
TRADE = """WITH trade AS (
  SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS record_id, s_nationkey AS src, c_nationkey AS dst, l_partkey AS part, l_suppkey AS supplier, c_custkey AS customer,
         CAST(year(l_shipdate) AS INTEGER) AS year, CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT) AS cents
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
)"""


def pair_flows(flows: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``cents`` of each ordered pair of countries, those with themselves included."""
    return flows.groupBy("src", "dst").agg(F.sum("cents").alias("cents"))


def dependency(pairs: DataFrame) -> DataFrame:
    """Edges ``src``, ``dst``, ``rel`` (id), ``cents``, ``ratio``: a pair's flow as a share of all that its destination takes; no self edges. ``pairs``: from ``pair_flows``."""
    totals = pairs.groupBy("dst").agg(F.sum("cents").alias("total")).where("total > 0")
    rel = F.format_string("%03d-%03d", "src", "dst")
    return pairs.where("src <> dst").join(totals, "dst").select(rel.alias("rel"), "src", "dst", "cents", F.round(F.col("cents") / F.col("total"), 6).alias("ratio"))


#: The same as SQL, after ``TRADE``.
DEPENDENCY = """, pairs AS (SELECT src, dst, CAST(sum(cents) AS BIGINT) AS cents FROM trade GROUP BY src, dst),
totals AS (SELECT dst, sum(cents) AS total FROM pairs GROUP BY dst HAVING sum(cents) > 0),
edges AS (SELECT printf('%03d-%03d', src, pairs.dst) AS rel, src, pairs.dst AS dst, cents, round(cents / CAST(total AS DOUBLE), 6) AS ratio FROM pairs JOIN totals ON pairs.dst = totals.dst WHERE src <> pairs.dst)"""
