"""Joins: outer with computed keys, existence, proximity and fuzzy names."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..plans.registry import query
from ..plans.tables import table


@query("""SELECT o_orderkey, coalesce(c_nationkey, -1) AS nation_key, coalesce(n_name, 'UNKNOWN') AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0 LEFT JOIN nation ON coalesce(c_nationkey, -1) = n_nationkey""")
def left_join_coalesce_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two left joins, the second on a computed key."""
    o, c, n = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_acctbal").where("c_acctbal > 0"), table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    keyed = o.join(c, o.o_custkey == c.c_custkey, "left").withColumn("nation_key", F.coalesce("c_nationkey", F.lit(-1)))
    return keyed.join(n, keyed.nation_key == n.n_nationkey, "left").select("o_orderkey", "nation_key", F.coalesce("n_name", F.lit("UNKNOWN")).alias("nation"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '1997-01-01')")
def semi_join_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an order since 1997."""
    c, o = table(spark, sf_dir, "customer", "c_custkey", "c_name"), table(spark, sf_dir, "orders", "o_custkey", "o_orderdate").where("o_orderdate >= '1997-01-01'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2000-06-01')")
def anti_join_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order since June 2000."""
    c, o = table(spark, sf_dir, "customer", "c_custkey", "c_name"), table(spark, sf_dir, "orders", "o_custkey", "o_orderdate").where("o_orderdate >= '2000-06-01'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti")


@query("SELECT l_suppkey AS supplier, l_partkey AS part, count(*) AS links FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that a baseline declares more than once."""
    return table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey").groupBy(F.col("l_suppkey").alias("supplier"), F.col("l_partkey").alias("part")).agg(F.count("*").alias("links")).where("links > 1")


#: A degree of latitude in kilometres, rounded down so that a band is never too narrow.
DEGREE_KM = 111.0


def within(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """Pairs of ``(a, a_lat, a_lon)`` and ``(b, b_lat, b_lon)`` at most ``km`` apart, with ``km``: an equi-join on bands of latitude and cells of longitude.

    Right rows go to the cells they could reach: three bands, and in each as many cells as the distance spans at the band's far edge (all of
    them near the poles). The exact distance decides.
    """
    band = math.ceil(km / DEGREE_KM * 100) / 100
    wide = 10.0
    lat_cell = lambda c: F.floor((c + 90) / band).cast("int")
    cells = int(360 / wide)
    l = left.withColumn("band", lat_cell(F.col("a_lat"))).withColumn("cell", F.pmod(F.floor((F.col("a_lon") + 180) / wide), F.lit(cells)).cast("int"))  # noqa: E741
    r = right.withColumn("band", F.explode(F.sequence(lat_cell(F.col("b_lat")) - 1, lat_cell(F.col("b_lat")) + 1)))
    edge = F.greatest(F.abs(F.col("band") * band - 90), F.abs((F.col("band") + 1) * band - 90))
    reach = F.when(edge >= 89, cells).otherwise(F.least(F.lit(cells), F.ceil(km / DEGREE_KM / F.cos(F.radians(F.least(edge, F.lit(89.0)))) / wide)))
    own = F.floor((F.col("b_lon") + 180) / wide)
    r = r.withColumn("cell", F.explode(F.array_distinct(F.transform(F.sequence(own - reach, own + reach), lambda x: F.pmod(x, F.lit(cells)).cast("int")))))
    d = F.round(fn.haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")), 3)
    return l.join(r, ["band", "cell"]).withColumn("km", d).where(F.col("km") <= km).select("a", "b", "km")


@query("""WITH a AS (SELECT n_nationkey AS a, CAST((n_nationkey * 37) % 180 - 90 AS DOUBLE) AS a_lat, CAST((n_nationkey * 73) % 360 - 180 AS DOUBLE) AS a_lon FROM nation), b AS (SELECT s_suppkey AS b, CAST((s_suppkey * 37) % 180 - 90 AS DOUBLE) AS b_lat, CAST((s_suppkey * 73) % 360 - 180 AS DOUBLE) AS b_lon FROM supplier),
h AS (SELECT a, b, pow(sin(radians(b_lat - a_lat) / 2), 2) + cos(radians(a_lat)) * cos(radians(b_lat)) * pow(sin(radians(b_lon - a_lon) / 2), 2) AS x FROM a, b), d AS (SELECT a, b, round(2 * 6371.0088 * atan2(sqrt(x), sqrt(1 - x)), 3) AS km FROM h)
SELECT a AS crisis, b AS port, km FROM d WHERE km <= 500""")
def haversine_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ports within 500 km of a crisis, at places derived from keys."""
    at = lambda k: (((F.col(k) * 37) % 180 - 90).cast("double"), ((F.col(k) * 73) % 360 - 180).cast("double"))
    (alat, alon), (blat, blon) = at("n_nationkey"), at("s_suppkey")
    a = table(spark, sf_dir, "nation", "n_nationkey").select(F.col("n_nationkey").alias("a"), alat.alias("a_lat"), alon.alias("a_lon"))
    b = table(spark, sf_dir, "supplier", "s_suppkey").select(F.col("s_suppkey").alias("b"), blat.alias("b_lat"), blon.alias("b_lon"))
    return within(a, b, 500).select(F.col("a").alias("crisis"), F.col("b").alias("port"), "km")


def single_similar(left: DataFrame, right: DataFrame, block: list[str], least: float) -> DataFrame:
    """Of each left name the right name of at least that similarity, if there is exactly one: ``left_id``, ``right_id``, ``score``. Both sides: ``id``, ``name``, and the columns of ``block``.

    Names are only compared within a block, and only where their lengths allow the similarity. Rows of equal names are one name with their number, so copies make no pairs; what is left is
    quadratic in a block's different names. Of a row's matches those of its own id are taken off; where one other is left, it is the one of the least or of the greatest id.
    """
    la, lb = F.length("a"), F.length("b")
    alike = lambda df: df.where(F.least(la, lb) >= F.greatest(la, lb) * least).withColumn("score", F.round(fn.similarity(F.col("a"), F.col("b")), 6)).where(F.col("score") >= least)
    asked, known = left.where("id is not null").select(F.col("id").alias("left_id"), F.col("name").alias("a"), *block), right.where("id is not null").select("id", F.col("name").alias("b"), *block)
    names = known.groupBy("b", *block).agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    near = alike(asked.select("a", *block).distinct().join(names, block)).groupBy("a", *block).agg(F.sum("n").alias("n"), F.min(F.struct(F.col("lo").alias("id"), "score")).alias("first"), F.max(F.struct(F.col("hi").alias("id"), "score")).alias("last"))
    met = asked.join(near, ["a", *block]).groupBy("left_id").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    own = alike(asked.join(known.withColumnRenamed("id", "left_id"), ["left_id", *block])).groupBy("left_id").agg(F.count("*").alias("own"))
    one = met.join(own, "left_id", "left").where(F.col("n") - F.coalesce("own", F.lit(0)) == 1).withColumn("other", F.when(F.col("first.id") != F.col("left_id"), F.col("first")).otherwise(F.col("last")))
    return one.select("left_id", F.col("other.id").alias("right_id"), "other.score")


@query("""WITH n AS (SELECT p_partkey AS id, p_brand, p_size, regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '', 'g') AS name FROM part),
s AS (SELECT a.id AS left_id, b.id AS right_id, round(1 - levenshtein(a.name, b.name) / CAST(greatest(length(a.name), length(b.name)) AS DOUBLE), 6) AS score FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.id <> b.id)
SELECT left_id, min(right_id) AS right_id, min(score) AS score FROM s WHERE score >= 0.75 GROUP BY left_id HAVING count(*) = 1""")
def fuzzy_name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of one brand and size whose names are alike, where only one is."""
    n = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size").select(F.col("p_partkey").alias("id"), F.regexp_replace(F.lower("p_name"), r"[^\p{L}\p{N}]+", "").alias("name"), "p_brand", "p_size")
    return single_similar(n, n, ["p_brand", "p_size"], 0.75)
