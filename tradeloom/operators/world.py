"""The world baseline: flows, dependency ratios, newest metrics, snapshots, manifests, and typed edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.numbering import numbered
from ..plans.registry import query
from ..plans.storage import written
from ..plans.tables import DEPENDENCY, TRADE, dependency, pair_flows, table, trade


def latest_per_key(records: DataFrame, keys: list[str], newest: list[str], columns: list[str]) -> DataFrame:
    """The newest record of each key, by the greatest ``newest``; an aggregation, so that it combines on the map side and no key is sorted as a whole."""
    best = F.max(F.struct(*newest, *(c for c in columns if c not in newest))).alias("best")
    return records.groupBy(*keys).agg(best).select(*keys, *(F.col(f"best.{c}").alias(c) for c in columns))


@query(TRADE + """, pairs AS (SELECT src, dst, year, sum(cents) AS cents FROM trade GROUP BY ALL),
totals AS (SELECT dst, year, sum(cents) AS total FROM pairs GROUP BY ALL HAVING sum(cents) > 0)
SELECT a.n_name AS exporter, b.n_name AS importer, pairs.year AS year, CAST(pairs.cents AS DOUBLE) / 100 AS flow, CAST(total AS DOUBLE) / 100 AS importer_total, round(CAST(pairs.cents AS DOUBLE) / CAST(total AS DOUBLE), 6) AS dependency_ratio
FROM pairs JOIN totals ON pairs.dst = totals.dst AND pairs.year = totals.year JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = pairs.dst WHERE src <> pairs.dst""")
def trade_flow_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each pair's flow in a year and its share of what the importer takes. The pairs come from one partial aggregation; the rest works on at most nations squared by years."""
    pairs = trade(spark, sf_dir).groupBy("src", "dst", "year").agg(F.sum("cents").alias("cents"))
    totals = pairs.groupBy("dst", "year").agg(F.sum("cents").alias("total")).where("total > 0")
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    a, b = n.select(F.col("n_nationkey").alias("src"), F.col("n_name").alias("exporter")), n.select(F.col("n_nationkey").alias("dst"), F.col("n_name").alias("importer"))
    out = pairs.where("src <> dst").join(totals, ["dst", "year"]).join(a, "src").join(b, "dst")
    return out.select("exporter", "importer", "year", (F.col("cents").cast("double") / 100).alias("flow"), (F.col("total").cast("double") / 100).alias("importer_total"), F.round(F.col("cents").cast("double") / F.col("total").cast("double"), 6).alias("dependency_ratio"))


@query(TRADE + """, s AS (SELECT src AS nation, CAST(sum(cents) AS BIGINT) AS supply_cents FROM trade GROUP BY src), d AS (SELECT dst AS nation, CAST(sum(cents) AS BIGINT) AS demand_cents FROM trade GROUP BY dst)
SELECT coalesce(s.nation, d.nation) AS nation, coalesce(supply_cents, 0) AS supply_cents, coalesce(demand_cents, 0) AS demand_cents FROM s FULL JOIN d ON s.nation = d.nation""")
def country_supply_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each country supplies and takes: each flow counts for both of its ends, in one aggregation."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("nation"), F.col("cents").alias("s"), F.lit(0).cast("long").alias("d")), F.struct(F.col("dst").alias("nation"), F.lit(0).cast("long").alias("s"), F.col("cents").alias("d"))))
    pairs = pair_flows(trade(spark, sf_dir)).select(ends.alias("e"))
    return pairs.groupBy(F.col("e.nation").alias("nation")).agg(F.sum("e.s").alias("supply_cents"), F.sum("e.d").alias("demand_cents"))


@query(TRADE + " SELECT src, dst, CAST(sum(cents) AS BIGINT) AS cents, count(*) AS records FROM trade WHERE year = (SELECT max(year) FROM trade) GROUP BY src, dst")
def latest_period_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of the newest period of all. One pass aggregates by period; the newest is chosen among the aggregates."""
    by_year = trade(spark, sf_dir).groupBy("year", "src", "dst").agg(F.sum("cents").alias("cents"), F.count("*").alias("records"))
    newest = by_year.agg(F.max("year").alias("year"))
    return by_year.join(newest, "year").select("src", "dst", "cents", "records")


@query(TRADE + """, newest AS (SELECT * FROM trade WHERE year = (SELECT max(year) FROM trade)), pairs AS (SELECT src, dst, CAST(sum(cents) AS BIGINT) AS pair_cents FROM newest GROUP BY ALL)
SELECT newest.src AS src, newest.dst AS dst, record_id, cents, pair_cents FROM newest JOIN pairs ON newest.src = pairs.src AND newest.dst = pairs.dst""")
def trade_pair_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records behind each newest pair flow, one row for each link: no pair's records are gathered in one place."""
    flows = trade(spark, sf_dir)
    last = flows.agg(F.max("year")).first()[0]  # one number; the filter then reaches the scan
    newest = flows.where(F.col("year") == F.lit(last))
    return newest.join(pair_flows(newest).withColumnRenamed("cents", "pair_cents"), ["src", "dst"]).select("src", "dst", "record_id", "cents", "pair_cents")


@query(TRADE + """, y AS (SELECT src, dst, year, sum(cents) AS cents, count(*) AS n FROM trade WHERE src <> dst GROUP BY ALL)
SELECT src, dst, count(*) AS n_observations, min(year) AS first_year, max(year) AS last_year, string_agg(CAST(year AS VARCHAR) || ':' || CAST(cents AS VARCHAR), '|' ORDER BY year) AS observations FROM y GROUP BY src, dst""")
def bilateral_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One edge per ordered pair with its yearly observations in order. The lists hold years, not records."""
    y = trade(spark, sf_dir).where("src <> dst").groupBy("src", "dst", "year").agg(F.sum("cents").alias("cents"))
    seen = F.sort_array(F.collect_list(F.struct("year", "cents")))
    g = y.groupBy("src", "dst").agg(F.count("*").alias("n_observations"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), seen.alias("o"))
    return g.select("src", "dst", "n_observations", "first_year", "last_year", F.array_join(F.transform("o", lambda x: F.concat_ws(":", x["year"], x["cents"])), "|").alias("observations"))


@query("SELECT event_type, user_id, event_id, ts, value, props FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_event_per_user_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest record of each source and natural key."""
    return latest_per_key(table(spark, sf_dir, "events"), ["event_type", "user_id"], ["ts", "event_id"], ["event_id", "ts", "value", "props"])


@query("SELECT user_id, event_type AS metric, CAST(ts AS DATE) AS period, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY CAST(ts AS DATE) DESC NULLS LAST, event_id) AS rn FROM events) WHERE rn = 1")
def newest_metric_tiebreak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each entity's newest value of a metric: the latest period, none oldest, then the smallest id."""
    e = table(spark, sf_dir, "events").withColumn("period", F.to_date("ts")).withColumn("order", -F.col("event_id"))
    return latest_per_key(e, ["user_id", "event_type"], ["period", "order"], ["period", "event_id", "value"]).withColumnRenamed("event_type", "metric")


@query("SELECT o_custkey AS customer, arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS first_name FROM orders GROUP BY o_custkey")
def first_name_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first name seen for a key stays."""
    return table(spark, sf_dir, "orders", "o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey").groupBy(F.col("o_custkey").alias("customer")).agg(F.min_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("first_name"))


#: Ids, or hashes, that are hashed together in a snapshot's fingerprint.
LEAF = 4096


@query("""WITH leaf AS (SELECT event_type, event_id // 4096 AS part, sha256('|' || string_agg(CAST(event_id AS VARCHAR), '|' ORDER BY CAST(event_id AS VARCHAR))) AS h, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type, CAST(sum(n) AS BIGINT) AS records, sha256('|' || string_agg(h, '|' ORDER BY h)) AS fingerprint FROM leaf GROUP BY event_type""")
def snapshot_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint of the ids of each source's snapshot, whatever their order: sorted ids are hashed by ranges, then the sorted hashes by ranges of
    ranges, until one is left. However many ids there are and however they lie, no group has more than ``LEAF`` members (ids are unique)."""

    def digest(c: str):
        return F.sha2(F.concat(F.lit("|"), F.array_join(F.sort_array(F.collect_list(c)), "|")), 256)

    e = table(spark, sf_dir, "events", "event_type", "event_id").select("event_type", F.expr(f"event_id div {LEAF}").alias("part"), F.col("event_id").cast("string").alias("id"))
    level, top = e.groupBy("event_type", "part").agg(digest("id").alias("h"), F.count("*").alias("n")), e.agg(F.max(F.abs("part"))).first()[0] or 0
    while True:  # six times at most, for ids of any size
        top //= LEAF
        level = level.groupBy("event_type", F.expr(f"part div {LEAF}").alias("part")).agg(digest("h").alias("h"), F.sum("n").alias("n"))
        if not top:
            return level.select("event_type", F.col("n").alias("records"), F.col("h").alias("fingerprint"))


@query("""WITH k AS (SELECT event_type, user_id, max(ts) AS ts FROM events GROUP BY ALL), m AS (SELECT event_type, count(*) AS keys FROM k GROUP BY ALL), t AS (SELECT event_type, count(*) AS records FROM events GROUP BY ALL)
SELECT CAST(sum(records) AS BIGINT) AS records, CAST(sum(keys) AS BIGINT) AS natural_keys, count(*) AS sources, string_agg(t.event_type, ',' ORDER BY t.event_type) AS source_list, 5 - count(*) AS missing, CASE WHEN count(*) >= 5 THEN 'READY' ELSE 'PARTIAL' END AS index_status, (SELECT strftime(max(ts), '%Y-%m-%d') FROM events) AS newest FROM t JOIN m ON t.event_type = m.event_type""")
def world_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-row manifest of a world version. The list of sources comes from one row per source."""
    e = table(spark, sf_dir, "events", "event_type", "user_id", "ts")
    keys = e.groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.max("ts").alias("ts"))
    by = keys.groupBy("event_type").agg(F.sum("n").alias("records"), F.count("*").alias("keys"), F.max("ts").alias("ts"))
    return by.agg(
        F.sum("records").alias("records"), F.sum("keys").alias("natural_keys"), F.count("*").alias("sources"), F.array_join(F.sort_array(F.collect_list("event_type")), ",").alias("source_list"), (5 - F.count("*")).alias("missing"),
        F.when(F.count("*") >= 5, "READY").otherwise("PARTIAL").alias("index_status"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("newest"),
    )


@query(TRADE + """, e AS (SELECT src AS nation, 'SUPPLY' AS metric, sum(cents) AS v FROM trade GROUP BY src UNION ALL SELECT dst, 'DEMAND', sum(cents) FROM trade GROUP BY dst)
SELECT 'country:' || CAST(n_nationkey AS VARCHAR) AS node_id, n_name AS display_name, metric, CAST(v AS DOUBLE) / 100 AS value, CASE WHEN v > 0 THEN 'READY' ELSE 'INSUFFICIENT_DATA' END AS status FROM e JOIN nation ON n_nationkey = nation""")
def world_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes with their metrics, one row per metric."""
    pairs = pair_flows(trade(spark, sf_dir))
    sides = pairs.select(F.explode(F.array(F.struct(F.col("src").alias("nation"), F.lit("SUPPLY").alias("metric")), F.struct(F.col("dst").alias("nation"), F.lit("DEMAND").alias("metric")))).alias("x"), "cents")
    m = sides.groupBy("x.nation", "x.metric").agg(F.sum("cents").alias("v"))
    n = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    return m.join(n, m.nation == n.n_nationkey).select(F.concat(F.lit("country:"), "n_nationkey").alias("node_id"), F.col("n_name").alias("display_name"), "metric", (F.col("v").cast("double") / 100).alias("value"), F.when(F.col("v") > 0, "READY").otherwise("INSUFFICIENT_DATA").alias("status"))


@query("""SELECT 'LOCATED_IN' AS type, 'supplier:' || s_suppkey AS source, 'country:' || s_nationkey AS target FROM supplier
UNION SELECT 'LOCATED_IN', 'customer:' || c_custkey, 'country:' || c_nationkey FROM customer
UNION SELECT 'PART_OF', 'region:' || n_regionkey, 'country:' || n_nationkey FROM nation
UNION SELECT 'SUPPLIES', 'supplier:' || l_suppkey, 'part:' || l_partkey FROM lineitem
UNION SELECT 'CLASSIFIED_AS', 'part:' || p_partkey, 'class:' || regexp_replace(regexp_replace(upper(p_type), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') FROM part""")
def semantic_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges by mapping rules, each once for (type, source, target)."""
    return typed_edges(spark, sf_dir).select("type", "source", "target")


def slug(c):
    return F.regexp_replace(F.regexp_replace(F.upper(c), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def typed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``type``, ``source``, ``target``, ``source_type``, ``target_type``, distinct."""

    def rule(name: str, df: DataFrame, a: str, source, b: str, target) -> DataFrame:
        return df.select(F.lit(name).alias("type"), F.concat(F.lit(f"{a}:"), source).alias("source"), F.concat(F.lit(f"{b}:"), target).alias("target"), F.lit(a).alias("source_type"), F.lit(b).alias("target_type"))

    s, c, n, li, p = (table(spark, sf_dir, x) for x in ("supplier", "customer", "nation", "lineitem", "part"))
    edges = rule("LOCATED_IN", s, "supplier", F.col("s_suppkey"), "country", F.col("s_nationkey"))
    edges = edges.unionByName(rule("LOCATED_IN", c, "customer", F.col("c_custkey"), "country", F.col("c_nationkey")))
    edges = edges.unionByName(rule("PART_OF", n, "region", F.col("n_regionkey"), "country", F.col("n_nationkey")))
    edges = edges.unionByName(rule("SUPPLIES", li, "supplier", F.col("l_suppkey"), "part", F.col("l_partkey")))
    return edges.unionByName(rule("CLASSIFIED_AS", p, "part", F.col("p_partkey"), "class", slug("p_type"))).distinct()


@query("SELECT n_nationkey AS id, n_name AS name FROM nation UNION SELECT s_nationkey, NULL FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)")
def set_union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of key sets, named where a name is known."""
    n, s = table(spark, sf_dir, "nation", F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), table(spark, sf_dir, "supplier", F.col("s_nationkey").alias("id"))
    keys = n.select("id").unionByName(s).distinct()
    return keys.join(n, "id", "left")


@query(TRADE + DEPENDENCY + """, f AS (SELECT l_orderkey AS o, l_linenumber AS l, s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey),
p AS (SELECT src, dst, min((o, l, src, dst)) AS first FROM f WHERE src <> dst GROUP BY src, dst)
SELECT 'trade-flow:' || row_number() OVER (ORDER BY first) AS relationship_id, rel, cents, ratio FROM p JOIN edges ON p.src = edges.src AND p.dst = edges.dst""")
def trade_flow_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trade edge with a dense ordinal in its id, in the order in which pairs of countries come up in the records."""
    flows = trade(spark, sf_dir)
    place = F.struct(F.split_part("record_id", F.lit("-"), F.lit(1)).cast("long").alias("o"), F.split_part("record_id", F.lit("-"), F.lit(2)).cast("long").alias("l"))
    pairs = written(flows.groupBy("src", "dst").agg(F.sum("cents").alias("cents"), F.min(place).alias("first")), "first-flows")
    edges = dependency(pairs.select("src", "dst", "cents")).join(pairs.select("src", "dst", "first"), ["src", "dst"])
    given = numbered(edges, ["first", "src", "dst"], "n")
    return given.select(F.concat(F.lit("trade-flow:"), "n").alias("relationship_id"), "rel", "cents", "ratio")
