"""Queries of the sinks, registries, validations and small reads, each through the operator itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..plans.numbering import numbered
from ..plans.registry import query
from ..plans.storage import scratch, written
from ..plans.tables import TRADE, pair_flows, table, trade
from . import baseline, graph, ingest, ontology, provenance, resolve, retrieval, simulate, validation

# sinks


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as kept rows, those of every third customer; and new rows: every second order with another total, each key twice."""
    o = table(spark, sf_dir, "orders", F.col("o_orderkey").alias("k"), "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("v"))
    new = o.where("k % 2 = 0").select("k", (F.col("v") + 1).alias("v"))
    return o.where("o_custkey % 3 = 0").select("k", "v"), new.unionByName(new.withColumn("v", F.col("v") + 5))


_OLD_NEW = "WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders), old AS (SELECT k, v FROM o WHERE c % 3 = 0), new AS (SELECT k, v + 1 AS v FROM o WHERE k % 2 = 0)"


@query(_OLD_NEW + " SELECT k, v FROM new WHERE k NOT IN (SELECT k FROM old)")
def sink_insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the new rows is appended: keys that are not kept yet, of each the first by value."""
    old, new = _versions(spark, sf_dir)
    return ingest.insert_absent(new, old, ["k"], ["v"])


@query(_OLD_NEW + " SELECT k, v FROM old WHERE k NOT IN (SELECT k FROM new) UNION ALL SELECT k, v + 5 FROM new")
def sink_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept rows with the new ones in their places; of a repeated key the last by value counts."""
    old, new = _versions(spark, sf_dir)
    return ingest.upsert(old, new, ["k"], ["v"])


@query("SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey IN (3, 9) THEN 'new' ELSE 'old' END AS state FROM customer")
def sink_replace_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by nation in which the partitions of two nations were written anew."""
    c, path = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), scratch(spark, "by-nation")
    ingest.replace_partition(c.withColumn("state", F.lit("old")), path, "c_nationkey")
    ingest.replace_partition(c.where("c_nationkey in (3, 9)").withColumn("state", F.lit("new")), path, "c_nationkey")
    return spark.read.parquet(path).select("c_custkey", "c_nationkey", "state")


@query("SELECT coalesce(max(o_orderkey % 97), 0) + 1 AS version_number FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F'")
def sink_next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number after a world's last version."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus").where("o_orderstatus = 'F'")
    return ingest.next_version(o.select(F.col("o_custkey").cast("string").alias("world_id"), (F.col("o_orderkey") % 97).alias("version_number")), "7")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 10 = 0 OR o_orderdate > TIMESTAMP '1996-06-01'")
def sink_drop_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that have not expired, or never do."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate")
    return ingest.drop_expired(o.select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")).alias("expires_at")), "1996-06-01 00:00:00").select("o_orderkey")


@query("SELECT o_custkey AS run_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS turn, o_orderkey AS state FROM orders")
def sink_turn_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of runs, appended turn by turn and read back; a turn that is written again adds nothing."""
    from pyspark.sql.window import Window

    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    turns = o.select(F.col("o_custkey").alias("run_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("turn"), F.col("o_orderkey").alias("state"))
    path = scratch(spark, "turns")
    baseline.append_turns(turns.where("turn <= 5"), path)
    baseline.append_turns(turns.where("turn >= 4"), path)
    return spark.read.parquet(path).select("run_id", "turn", "state")


@query("""SELECT o_orderkey, sha256('{"a":' || o_custkey || ',"k":{"n":"' || o_orderpriority || '","z":[1,' || o_orderkey || ']}}') AS result_hash FROM orders""")
def sink_result_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of a result as JSON with sorted keys and no spaces, whatever the order of its fields."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    result = F.struct(F.struct(F.array(F.lit(1), F.col("o_orderkey")).alias("z"), F.col("o_orderpriority").alias("n")).alias("k"), F.col("o_custkey").alias("a"))
    return o.withColumn("result", result).select("o_orderkey", validation.result_hash("result", o.withColumn("result", result).schema["result"].dataType).alias("result_hash"))


# projections and filters


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN trim(c_name) WHEN c_custkey % 3 = 1 THEN c_mktsegment END AS name, CASE WHEN c_custkey % 4 <> 3 THEN CAST(1000 * c_custkey AS BIGINT) END AS amount FROM customer")
def synonym_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first name of several columns that is not blank, and numbers with thousands commas; what is no number is null."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k, F.when(k % 3 == 0, F.concat(F.lit("  "), "c_name", F.lit(" "))).otherwise(" ").alias("a"), F.when(k % 3 == 1, F.col("c_mktsegment")).alias("b"), F.when(k % 4 == 3, "n/a").otherwise(F.concat(k, F.lit(",000"))).alias("n"))
    return c.select("c_custkey", fn.first_text("a", "b").alias("name"), fn.number(F.col("n")).cast("long").alias("amount"))


@query("SELECT event_id, CASE WHEN event_id % 3 <> 2 THEN date_trunc('second', ts) END AS at FROM events")
def multi_format_instant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as ISO text or as milliseconds; what is neither is null."""
    e = table(spark, sf_dir, "events", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    given = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 3 == 1, (F.unix_timestamp("ts") * 1000).cast("string")).otherwise("soon")
    return e.withColumn("given", given).select("event_id", fn.flexible_instant("given").alias("at"))


@query("SELECT event_id, concat_ws('; ', CASE WHEN event_id % 50 = 1 THEN 'parameters are too long' END, CASE WHEN event_id % 4 = 0 THEN 'parameters must be an object' END, CASE WHEN event_id % 4 = 1 THEN 'credential parameter: apiKey' WHEN event_id % 4 = 2 THEN 'credential parameter: X_TOKEN' END) AS faults FROM events")
def parameter_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests' parameters with their faults: no object, too long, or a field that looks like a credential; nested fields may."""
    k = F.col("event_id")
    filler = F.when(k % 50 == 1, F.repeat(F.lit("x"), 33_000)).otherwise("x")
    given = F.when(k % 4 == 0, F.concat(F.lit("[1, "), k, F.lit("]"))).when(k % 4 == 1, F.concat(F.lit('{"apiKey": 1, "page": "'), filler, F.lit('"}'))).when(k % 4 == 2, F.lit('{"page": {"key": 1}, "X_TOKEN": null}')).otherwise(F.concat(F.lit('{"page": {"password": "'), filler, F.lit('"}}')))
    e = table(spark, sf_dir, "events", "event_id").withColumn("given", F.when((k % 50 == 1) & (k % 4 == 0), F.concat(F.lit('["'), filler, F.lit('"]'))).when((k % 50 == 1) & (k % 4 == 2), F.concat(F.lit('{"X_TOKEN": "'), filler, F.lit('"}'))).otherwise(given))
    return e.select("event_id", F.array_join(validation.parameters_faults("given"), "; ").alias("faults"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records of statistics and company facts."""
    k = F.col("c_custkey")
    system = F.element_at(F.array(*map(F.lit, ["ILOSTAT", "UN_WPP", "WORLD_BANK", "SEC", "HS"])), (k % 5 + 1).cast("int"))
    sex = F.element_at(F.array(F.lit("SEX_T"), F.lit("both sexes"), F.lit("F")), (k % 3 + 1).cast("int"))
    dims = F.map_filter(F.create_map(F.lit("sex"), sex, F.lit("age"), F.when(k % 7 == 0, "5-9"), F.lit("classif1"), F.when(k % 11 == 0, "X")), lambda _, v: v.isNotNull())
    return table(spark, sf_dir, "customer").select(k.cast("string").alias("record_id"), system.alias("source_system"), F.when(system == "SEC", "SEC_XBRL_FACT").otherwise("STAT").alias("record_type"), F.when(k % 13 != 0, F.concat("c_mktsegment", F.lit(" (x)-"), F.col("c_nationkey"))).alias("classification_code"), F.when(k % 2 == 0, "us-gaap").alias("classification_version"), dims.alias("dimensions"))


@query("""WITH r AS (SELECT c_custkey AS k, ['ILOSTAT', 'UN_WPP', 'WORLD_BANK', 'SEC', 'HS'][c_custkey % 5 + 1] AS system, ['SEX_T', 'BOTH SEXES', 'F'][c_custkey % 3 + 1] AS sex, regexp_replace(regexp_replace(upper(c_mktsegment || ' (x)-' || c_nationkey), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS code FROM customer),
t AS (SELECT *, CASE system WHEN 'ILOSTAT' THEN sex = 'SEX_T' AND k % 11 <> 0 WHEN 'UN_WPP' THEN k % 7 <> 0 AND sex = 'BOTH SEXES' ELSE true END AS is_total FROM r)
SELECT CAST(k AS VARCHAR) AS record_id, is_total, CASE WHEN k % 13 = 0 OR system = 'HS' THEN NULL WHEN system = 'SEC' THEN 'SEC_' || CASE WHEN k % 2 = 0 THEN 'US_GAAP' ELSE 'XBRL' END || '_' || code WHEN is_total THEN system || '_' || code END AS metric FROM t""")
def metric_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each record measures, and whether it is a total and no breakdown."""
    return _records(spark, sf_dir).select("record_id", baseline.is_total().alias("is_total"), baseline.metric().alias("metric"))


_TYPED = """WITH e AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 <> 0 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'x1' ELSE CAST(s_suppkey AS VARCHAR) END END AS n, CASE WHEN s_suppkey % 5 = 0 THEN '2024-02-30' ELSE '2024-02-28' END AS d, CASE WHEN s_suppkey % 2 = 0 THEN 'http://a/' || s_suppkey END AS u FROM supplier)"""


@query(_TYPED + """ SELECT CAST(id AS VARCHAR) AS id, property, problem FROM (SELECT id, 'n' AS property, CASE WHEN n IS NULL THEN 'missing' WHEN n = 'x1' THEN 'not a integer' END AS problem FROM e UNION ALL SELECT id, 'd', CASE WHEN d = '2024-02-30' THEN 'not a date' END FROM e UNION ALL SELECT id, 'u', CASE WHEN u IS NULL THEN 'missing' END FROM e) WHERE problem IS NOT NULL""")
def typed_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities whose attributes lack a required property or hold a value of another kind."""
    catalogue = spark.createDataFrame([("S", "n", "INTEGER", True), ("S", "d", "DATE", False), ("S", "u", "URI", True), ("T", "z", "INTEGER", True)], "entity_type string, property string, kind string, required boolean")
    return ontology.property_violations(_suppliers(spark, sf_dir).select(F.col("k").cast("string").alias("id"), F.lit("S").alias("entity_type"), F.to_json(F.struct("n", "d", "u", F.lit(1).alias("other"))).alias("attributes")), catalogue)


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    n = F.when(k % 4 != 0, F.when(k % 3 == 0, "x1").otherwise(k.cast("string")))
    return table(spark, sf_dir, "supplier", "s_suppkey").select(k.alias("k"), n.alias("n"), F.when(k % 5 == 0, "2024-02-30").otherwise("2024-02-28").alias("d"), F.when(k % 2 == 0, F.concat(F.lit("http://a/"), k)).alias("u"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS id, concat_ws('; ', CASE WHEN s_suppkey % 6 = 0 THEN '$.kind is not one of the allowed values' END, CASE WHEN s_suppkey % 4 = 0 THEN '$.change must be at most 1' END, CASE WHEN s_suppkey % 5 = 0 THEN '$.reason is required' END, CASE WHEN s_suppkey % 7 = 0 THEN '$.extra is not allowed' END) AS faults FROM supplier
WHERE s_suppkey % 4 = 0 OR s_suppkey % 5 = 0 OR s_suppkey % 6 = 0 OR s_suppkey % 7 = 0""")
def schema_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions whose payload does not keep to its schema."""
    k = F.col("s_suppkey")
    payload = F.to_json(F.struct(F.when(k % 6 == 0, "LOVE").otherwise("SUPPLY").alias("kind"), F.when(k % 4 == 0, 2.5).otherwise(0.5).alias("change"), F.when(k % 5 != 0, "r").alias("reason"), F.when(k % 7 == 0, 1).alias("extra")))
    schema = {"type": "object", "required": ["kind", "change", "reason"], "additionalProperties": False, "properties": {"kind": {"type": "string", "enum": ["SUPPLY", "DEMAND"]}, "change": {"type": "number", "minimum": -1, "maximum": 1}, "reason": {"type": "string"}}}
    found = ontology.schema_violations(table(spark, sf_dir, "supplier", "s_suppkey").select(k.alias("id"), payload.alias("payload")), schema)
    order = ["$.kind is not one of the allowed values", "$.change must be at most 1", "$.reason is required", "$.extra is not allowed"]
    return found.select("id", F.array_join(F.filter(F.array(*map(F.lit, order)), lambda x: F.array_contains("faults", x)), "; ").alias("faults"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0 OR (o_orderkey % 5 = 1 AND o_orderkey % 2 = 1)")
def validity_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose interval ends without a start or before it."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").withColumn("valid_from", F.when(k % 5 != 0, F.to_date("o_orderdate"))).withColumn("valid_to", F.when(k % 5 <= 1, F.date_add(F.to_date("o_orderdate"), F.when(k % 2 == 1, -1).otherwise(1))))
    return ontology.validity_violations(o).select("o_orderkey")


@query("""SELECT event_id, type, source_type, target_type FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'LOCATED_IN' ELSE 'PART_OF' END AS type, CASE event_id % 2 WHEN 0 THEN 'supplier' ELSE 'region' END AS source_type, 'country' AS target_type FROM events) WHERE NOT (type = 'LOCATED_IN' AND source_type = 'supplier') AND NOT (type = 'PART_OF' AND source_type = 'region')""")
def grammar_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that the grammar does not have."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events", "event_id").select(k, F.when(k % 3 == 0, "LOCATED_IN").otherwise("PART_OF").alias("type"), F.when(k % 2 == 0, "supplier").otherwise("region").alias("source_type"), F.lit("country").alias("target_type"))
    return ontology.grammar_violations(e, spark.createDataFrame(ontology.GRAMMAR, "type string, source_type string, target_type string")).select("event_id", "type", "source_type", "target_type")


# validation of simulations


@query("""WITH c AS (SELECT s_suppkey % 90 AS company, CASE WHEN s_suppkey % 8 <> 0 THEN 'I' END AS industry, CASE WHEN s_suppkey % 6 = 0 THEN -1.0 ELSE 1.0 END AS production FROM supplier), l AS (SELECT DISTINCT l_suppkey AS supplier, l_partkey % 120 AS customer FROM lineitem),
f AS (SELECT CAST(company AS VARCHAR) AS key, 'industry is required' AS fault FROM c WHERE industry IS NULL UNION ALL SELECT CAST(company AS VARCHAR), 'production is no amount' FROM c WHERE production < 0
UNION ALL SELECT CAST(company AS VARCHAR), 'company ids must be unique' FROM c GROUP BY company HAVING count(*) > 1 UNION ALL SELECT supplier || '>' || customer, 'self-referencing link' FROM l WHERE supplier = customer
UNION ALL SELECT DISTINCT CAST(supplier AS VARCHAR), 'links must reference known companies' FROM l WHERE supplier NOT IN (SELECT company FROM c) UNION ALL SELECT DISTINCT CAST(customer AS VARCHAR), 'links must reference known companies' FROM l WHERE customer NOT IN (SELECT company FROM c)
UNION ALL SELECT '*', 'too many companies' FROM c HAVING count(*) > 5000 UNION ALL SELECT '*', 'too many links' FROM l HAVING count(*) > 20000) SELECT key, fault, count(*) AS n FROM f GROUP BY ALL""")
def baseline_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of a baseline of companies and their links."""
    k = F.col("s_suppkey")
    figures = [F.lit(1.0).alias(c) for c in ("capacity", "inventory", "demand", "unit_price", "unit_cost", "workforce", "wage", "productivity")]
    c = table(spark, sf_dir, "supplier", "s_suppkey").select((k % 90).alias("company"), F.when(k % 8 != 0, "I").alias("industry"), F.when(k % 6 == 0, -1.0).otherwise(1.0).alias("production"), *figures)
    l = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey").select(F.col("l_suppkey").alias("supplier"), (F.col("l_partkey") % 120).alias("customer")).distinct()  # noqa: E741
    l = l.withColumns({"per_output": F.lit(1.0), "max_flow": F.lit(1.0), "unit_cost": F.lit(1.0)})  # noqa: E741
    return validation.baseline_faults(c, l).groupBy("key", "fault").agg(F.count("*").alias("n"))


@query(TRADE + """, p AS (SELECT src, dst, sum(cents) AS cents FROM trade GROUP BY ALL), e AS (SELECT src || '-' || dst AS rel, src, dst, CASE WHEN (src + dst) % 9 = 0 THEN 'LOVES' ELSE 'TRADE_FLOW' END AS type, CASE WHEN src % 7 = 0 THEN NULL WHEN dst % 7 = 0 THEN 1.5 ELSE 0.5 END AS ratio, CASE WHEN dst % 11 <> 0 THEN 'p' END AS provenance FROM p), n AS (SELECT n_nationkey AS entity, CASE WHEN n_nationkey % 10 <> 0 THEN 'T' END AS entity_type FROM nation WHERE n_nationkey <> 5)
SELECT CAST(entity AS VARCHAR) AS key, 'entity type is required' AS fault FROM n WHERE entity_type IS NULL UNION ALL SELECT rel, 'self-referencing edge' FROM e WHERE src = dst UNION ALL SELECT rel, 'unsupported type' FROM e WHERE type = 'LOVES' UNION ALL SELECT rel, 'ratio is required' FROM e WHERE ratio IS NULL UNION ALL SELECT rel, 'ratio must be within 0 and 1' FROM e WHERE ratio > 1
UNION ALL SELECT rel, 'parameters require provenance' FROM e WHERE provenance IS NULL UNION ALL SELECT DISTINCT CAST(src AS VARCHAR), 'edges must reference known entities' FROM e WHERE src = 5 UNION ALL SELECT DISTINCT CAST(dst AS VARCHAR), 'edges must reference known entities' FROM e WHERE dst = 5""")
def graph_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of a relationship graph."""
    n = table(spark, sf_dir, "nation", "n_nationkey").where("n_nationkey <> 5").select(F.col("n_nationkey").alias("entity"), F.when(F.col("n_nationkey") % 10 != 0, "T").alias("entity_type"), F.lit("m").alias("metrics"), F.lit("o").alias("origins"))
    ratio = F.when(F.col("src") % 7 == 0, None).when(F.col("dst") % 7 == 0, 1.5).otherwise(0.5)
    e = pair_flows(trade(spark, sf_dir)).select(F.concat_ws("-", "src", "dst").alias("rel"), "src", "dst", F.when((F.col("src") + F.col("dst")) % 9 == 0, "LOVES").otherwise("TRADE_FLOW").alias("type"), ratio.alias("ratio"), F.when(F.col("dst") % 11 != 0, "p").alias("provenance"))
    return validation.graph_faults(n, e)


@query("""WITH s AS (SELECT o_custkey % 3 AS branch, o_custkey AS entity, CAST(1 + o_orderkey % 7 AS INTEGER) AS turn FROM orders) SELECT 'a' AS key, 'branch names must be unique' AS fault, 1 AS n UNION ALL SELECT CAST(entity AS VARCHAR), 'turn is outside of the run', count(*) FROM s WHERE turn > 6 GROUP BY entity
UNION ALL SELECT branch || '|' || entity || '|' || turn, 'duplicate shock in a turn', 1 FROM s GROUP BY branch, entity, turn HAVING count(*) > 1 UNION ALL SELECT CAST(entity AS VARCHAR), 'shocks must reference known entities', 1 FROM s WHERE entity % 10 = 0 GROUP BY entity
UNION ALL SELECT CAST(branch AS VARCHAR), 'too many shocks', 1 FROM s GROUP BY branch HAVING count(*) > 20000""")
def branch_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of branches and their shocks."""
    b = spark.createDataFrame([(0, "A"), (1, " a"), (2, "C")], "branch int, name string")
    s = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select((F.col("o_custkey") % 3).alias("branch"), F.col("o_custkey").alias("entity"), (1 + F.col("o_orderkey") % 7).cast("int").alias("turn"))
    known = table(spark, sf_dir, "customer", F.col("c_custkey").alias("entity")).where("entity % 10 <> 0")
    return validation.branch_faults(b, s, known, 6).groupBy("key", "fault").agg(F.count("*").alias("n"))


@query("""SELECT key, fault FROM (SELECT CAST(s_suppkey AS VARCHAR) AS key, unnest([CASE WHEN s_suppkey % 2 = 0 THEN 'unknown contract' END, CASE WHEN s_suppkey % 3 = 0 THEN 'unknown metric' END, CASE WHEN s_suppkey % 5 = 0 THEN 'change must be in percent' END, CASE WHEN s_suppkey % 7 = 0 OR s_suppkey % 9 = 0 THEN 'change is out of bounds' END, CASE WHEN s_suppkey % 4 = 0 THEN 'not confident enough' END]) AS fault FROM supplier) WHERE fault IS NOT NULL""")
def scenario_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of scenarios that a reader of questions gave."""
    k = F.col("s_suppkey")
    c = table(spark, sf_dir, "supplier", "s_suppkey").select(k.alias("id"), F.when(k % 2 != 0, "v2").alias("contract"), F.when(k % 3 == 0, "LOVE").otherwise("SUPPLY").alias("metric"), F.when(k % 5 != 0, "PERCENT").alias("change_type"), F.when(k % 7 == 0, 1.5).when(k % 9 == 0, 0.0).otherwise(-0.5).alias("change"), F.when(k % 4 == 0, 0.2).otherwise(0.9).alias("confidence"))
    return validation.scenario_faults(c, ["SUPPLY", "DEMAND"])


@query("""SELECT item_id, CAST(('0x' || substr(sha256(text), 1, 14))::UBIGINT AS BIGINT) AS seed, branch, policy, branch = 'C' AS mitigates FROM benchmark, (VALUES ('A', 'NONE'), ('B', 'RECORDED_POLICY'), ('C', 'OBSERVED_ALTERNATIVE_SUPPLY')) b(branch, policy)""")
def scenario_branching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three branches of every question, of one seed."""
    return validation.scenario_branches(table(spark, sf_dir, "benchmark", "item_id", F.col("text").alias("question"))).select("item_id", "seed", "branch", "policy", "mitigates")


@query("SELECT CAST(o_orderkey % 6 AS INTEGER) AS turn, o_custkey AS company, round(product(CASE WHEN o_orderkey % 2 = 0 THEN 0.5::DOUBLE ELSE 1 END), 9) AS supply, round(product(1.0::DOUBLE), 9) AS demand, round(product(0.9::DOUBLE), 9) AS capacity, round(product(CASE WHEN o_orderkey % 3 = 0 THEN 1.1::DOUBLE ELSE 1 END), 9) AS price FROM orders GROUP BY ALL")
def shock_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product of each multiplier over a company's shocks of a turn."""
    k = F.col("o_orderkey")
    s = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select((k % 6).cast("int").alias("turn"), F.col("o_custkey").alias("company"), F.when(k % 2 == 0, 0.5).otherwise(1.0).alias("supply"), F.lit(1.0).alias("demand"), F.lit(0.9).alias("capacity"), F.when(k % 3 == 0, 1.1).otherwise(1.0).alias("price"))
    return simulate.combined_shocks(s).select("turn", "company", *(F.round(c, 9).alias(c) for c in ("supply", "demand", "capacity", "price")))


# reads


@query("SELECT 'w' || o_custkey AS world_id, o_orderkey AS version_number FROM orders WHERE o_custkey = 7 AND o_orderkey % 3 <> 0 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def latest_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A world's newest version that has a baseline: a path into JSON decides."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate").select(F.concat(F.lit("w"), "o_custkey").alias("world_id"), F.col("o_orderkey").alias("version_number"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 3 != 0, '{"baselineStatus": "READY"}').otherwise('{"x": 1}').alias("state"))
    worlds = table(spark, sf_dir, "customer", F.concat(F.lit("w"), "c_custkey").alias("world_id"), F.col("c_name").alias("name"))
    return baseline.latest_world(o, worlds, "w7").select("world_id", "version_number")


@query("SELECT c_custkey AS branch_id, o_orderkey AS run_id, turns FROM customer LEFT JOIN (SELECT o_orderkey, o_custkey, string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber) AS turns FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) ON o_custkey = c_custkey")
def branch_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches with their runs, if any, and each run's turns in order."""
    b, r, t = table(spark, sf_dir, "customer", F.col("c_custkey").alias("branch_id")), table(spark, sf_dir, "orders", F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("branch_id")), table(spark, sf_dir, "lineitem", F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("turn"), F.col("l_suppkey").alias("state"))
    return baseline.runs_with_turns(b, r, t).select("branch_id", "run_id", F.when(F.col("turns").isNotNull(), F.array_join(F.transform("turns", lambda x: x["turn"].cast("string")), ",")).alias("turns"))


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(pos AS INTEGER) AS pos FROM (VALUES (0, 12), (1, 3), (3, 140), (4, 1)) asked(pos, k) JOIN customer ON c_custkey = k")
def given_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of given ids with their places; an unknown id has none."""
    c = table(spark, sf_dir, "customer", F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    return baseline.with_places(c, ["12", "3", "nobody", "140", "1"])


@query("SELECT 'supplier:' || s_suppkey AS id, s_name AS name, CAST(row_number() OVER (ORDER BY s_name, s_suppkey) AS INTEGER) AS place FROM supplier WHERE s_nationkey = 3 UNION ALL SELECT 'x', 'x', 0 WHERE false")
def graph_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities of one version in the order of type and key, with their places."""
    s = table(spark, sf_dir, "supplier")
    entities = s.select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("entity_type"), F.format_string("%s|%010d", "s_name", "s_suppkey").alias("natural_key"), F.col("s_nationkey").cast("string").alias("world_version_id"))
    return graph.read_version(entities, "3", ["entity_type", "natural_key"]).select("id", "name", "place")


@query("SELECT doc_id, evidence, uri FROM (SELECT item_id AS doc_id, CASE WHEN item_id % 3 <> 0 THEN '00000000-0000-0000-0000-' || lpad(CAST(item_id AS VARCHAR), 12, '0') END AS evidence, 'u' || item_id AS uri FROM benchmark UNION SELECT item_id, NULL, 'v' FROM benchmark WHERE item_id % 2 = 0)")
def evidence_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence references anywhere in JSON attributes; ids that are none are null."""
    k = F.col("item_id")
    ref = F.struct(F.when(k % 3 != 0, F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(k.cast("string"), 12, "0"))).otherwise("bad").alias("evidenceId"), F.concat(F.lit("u"), k).alias("sourceUri"))
    body = F.to_json(F.struct(F.struct(F.array(ref, ref).alias("list")).alias("a"), F.when(k % 2 == 0, F.struct(F.lit("v").alias("sourceUri"))).alias("b")))
    found = graph.evidence_refs(table(spark, sf_dir, "benchmark", "item_id").select(k.alias("id"), body.alias("attributes")))
    return found.select(F.col("id").cast("long").alias("doc_id"), F.col("evidence_id").alias("evidence"), F.col("source_uri").alias("uri"))


@query("SELECT c_custkey AS id, unnest(list_distinct(list_filter([lower(c_name), lower(c_mktsegment), 'k' || c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 's' || c_nationkey END], lambda x: x IS NOT NULL))) AS alias FROM customer")
def search_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name by which a node is found, each once."""
    return baseline.search_documents(_nodes(spark, sf_dir))[0]


@query("SELECT c_custkey AS id, c_name || ' K' || c_custkey || ' ' || c_mktsegment AS text FROM customer")
def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of a node's fields for the full-text index."""
    return baseline.search_documents(_nodes(spark, sf_dir))[1]


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    attributes = F.to_json(F.struct(F.array("c_mktsegment").alias("aliases"), F.when(k % 2 == 0, F.concat(F.lit("s"), "c_nationkey")).alias("symbol")))
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.concat(F.lit("K"), k).alias("natural_key"), F.col("c_name").alias("name"), attributes.alias("attributes"))


@query("SELECT o_orderkey AS chunk_id, o_custkey % 5 AS source_id FROM orders WHERE o_orderkey % 2 = 0 AND (o_orderkey % 10 = 4 OR o_custkey % 5 <> o_orderkey % 5)")
def misplaced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose evidence is of another source than they say, or of none."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    chunks = o.select(k.alias("chunk_id"), F.when(k % 2 == 0, k).alias("evidence_id"), (F.col("o_custkey") % 5).alias("source_id"))
    return baseline.misplaced_chunks(chunks, o.where(k % 10 != 4).select(k.alias("evidence_id"), (k % 5).alias("source_id"))).select("chunk_id", "source_id")


@query("SELECT c_custkey AS record_id, 'source_system=S' || chr(10) || 'record_type=T' || chr(10) || 'natural_key=' || c_name || chr(10) || 'value=' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN chr(10) || 'a=' || c_mktsegment || chr(10) || 'b=1' ELSE chr(10) || 'b=1' END AS text FROM customer")
def index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as lines for the text index; what is null has no line."""
    none = F.lit(None).cast("string")
    dims = F.map_filter(F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment"))), lambda _, v: v.isNotNull())
    r = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("record_id"), F.lit("S").alias("source_system"), F.lit("T").alias("record_type"), F.col("c_name").alias("natural_key"), none.alias("country_code"), none.alias("classification_code"), none.alias("unit_code"), F.col("c_nationkey").cast("string").alias("value"), dims.alias("dimensions"))
    return baseline.index_text(r)


@query("SELECT count(*) FILTER (o_orderkey % 100 <> 0) AS indexed, count(*) FILTER (o_orderkey % 100 = 0) AS failed FROM orders")
def index_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records were indexed and how many failed."""
    return baseline.outcomes(_results(spark, sf_dir))


@query("SELECT o_orderkey AS record_id, 'x' || o_custkey AS error FROM orders WHERE o_orderkey % 100 = 0")
def index_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that failed."""
    return baseline.failures(_results(spark, sf_dir))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderkey") % 100 == 0, F.concat(F.lit("x"), "o_custkey")).alias("error"))


# resolution


@query("""WITH r AS (SELECT 's' || s_suppkey AS entity_id, lower('K' || s_suppkey % 40) AS v FROM supplier UNION ALL SELECT 't' || s_suppkey, 'lei' || s_suppkey % 70 FROM supplier), c AS (SELECT c_custkey AS candidate, 'k' || c_custkey % 60 AS v FROM customer UNION ALL SELECT c_custkey, 'lei' || c_custkey % 90 FROM customer WHERE c_custkey % 2 = 0),
m AS (SELECT candidate, count(DISTINCT entity_id) AS matches, min(entity_id) AS entity_id FROM c LEFT JOIN r ON c.v = r.v GROUP BY candidate) SELECT candidate, matches, CASE WHEN matches = 1 THEN entity_id END AS entity_id, CASE WHEN matches = 0 THEN 'NEW' WHEN matches = 1 THEN 'MATCHED' ELSE 'CONFLICT' END AS status FROM m""")
def match_trusted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by the entities that their keys point to: none, one, or a conflict."""
    s, c = table(spark, sf_dir, "supplier", "s_suppkey"), table(spark, sf_dir, "customer", "c_custkey")
    k, q = F.col("s_suppkey"), F.col("c_custkey")
    key = lambda df, name, ident, scheme, value: df.select(ident.alias(name), F.lit("C").alias("entity_type"), F.lit(scheme).alias("scheme"), value.alias("value"))
    known = key(s, "entity_id", F.concat(F.lit("s"), k), "natural-key", F.concat(F.lit("K"), k % 40)).unionByName(key(s, "entity_id", F.concat(F.lit("t"), k), "LEI", F.concat(F.lit("LEI"), k % 70)))
    asked = key(c, "candidate", q, "NATURAL_KEY", F.concat(F.lit(" k"), q % 60)).unionByName(key(c.where("c_custkey % 2 = 0"), "candidate", q, "lei", F.concat(F.lit("lei"), q % 90)))
    return resolve.match_keys(asked, known)


_NAMES = r"""WITH raw AS (SELECT p_partkey AS id, 'T' || p_size % 4 AS entity_type, regexp_replace(p_name || ' ' || p_type || ' ' || p_brand, '#', '', 'g') AS base FROM part),
n AS (SELECT id, entity_type, base, regexp_replace(regexp_replace(lower(base), '[!-/:-@\[-`{-~\s]+', '', 'g'), '(incorporated|inc|corp|corporation|company|co|ltd|limited|llc|plc)+$', '') AS b FROM raw), q AS (SELECT id, entity_type, CASE WHEN id % 3 = 0 THEN b ELSE 'x' || substr(b, 2) END AS a FROM n)"""


@query(_NAMES + """, s AS (SELECT q.id AS candidate, n.id AS entity_id, 1 - levenshtein(a, b) / CAST(greatest(length(a), length(b)) AS DOUBLE) AS score FROM q JOIN n ON q.entity_type = n.entity_type AND abs(length(a) - length(b)) <= 3 WHERE length(a) >= 3 AND length(b) >= 3),
g AS (SELECT candidate, count(DISTINCT CASE WHEN score = 1 THEN entity_id END) AS same, count(DISTINCT entity_id) AS near, arg_max(entity_id, score) AS entity_id, max(score) AS score FROM s WHERE score >= 0.96 GROUP BY candidate) SELECT candidate, entity_id, round(score, 6) AS score FROM g WHERE same = 1 OR (same = 0 AND near = 1)""")
def match_similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are those of one entity, or nearly those of just one, against all of their type."""
    base = F.regexp_replace(F.concat_ws(" ", "p_name", "p_type", "p_brand"), "#", "")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("T"), F.col("p_size") % 4).alias("entity_type"), base.alias("base"))
    plain = fn.company_name("base")
    asked = p.select(F.col("id").alias("candidate"), "entity_type", F.when(F.col("id") % 3 == 0, F.concat(F.upper("base"), F.lit(", Inc."))).otherwise(F.concat(F.lit("x"), F.substring(plain, 2, 1000))).alias("name"))
    return resolve.match_names(asked, p.select(F.col("id").alias("entity_id"), "entity_type", F.concat("base", F.lit(" Co., Ltd")).alias("name"))).select("candidate", "entity_id", F.round("score", 6).alias("score"))


@query(r"SELECT c_custkey, regexp_replace(regexp_replace(lower(c_name || CASE c_custkey % 4 WHEN 0 THEN ', Inc.' WHEN 1 THEN ' Co., Ltd.' WHEN 2 THEN ' Group Holdings' ELSE ' Corporation' END), '[!-/:-@\[-`{-~\s]+', '', 'g'), '(incorporated|inc|corp|corporation|company|co|ltd|limited|llc|plc)+$', '') AS name FROM customer")
def company_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company names for comparison, without legal forms."""
    k = F.col("c_custkey")
    form = F.when(k % 4 == 0, ", Inc.").when(k % 4 == 1, " Co., Ltd.").when(k % 4 == 2, " Group Holdings").otherwise(" Corporation")
    return table(spark, sf_dir, "customer", "c_custkey", "c_name").select("c_custkey", fn.company_name(fn.nfkc(F.concat("c_name", form))).alias("name"))


# provenance


@query("SELECT DISTINCT 'k' || s_suppkey % 60 AS source_key, s_suppkey % 60 IN (SELECT n_nationkey FROM nation) AS taken FROM supplier")
def source_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New sources, each once, and those whose key is taken."""
    key = lambda c: F.concat(F.lit("k"), c).alias("source_key")
    new, taken = provenance.register_source(table(spark, sf_dir, "nation", "n_nationkey").select(key(F.col("n_nationkey"))), table(spark, sf_dir, "supplier", "s_suppkey").select(key(F.col("s_suppkey") % 60)))
    return new.withColumn("taken", F.lit(False)).unionByName(taken.distinct().withColumn("taken", F.lit(True)))


@query("SELECT o_orderkey AS id, concat_ws('; ', CASE WHEN o_orderkey % 4 = 0 THEN 'payload is required' END, CASE WHEN o_orderkey % 6 = 0 THEN 'confidence must be within 0 and 1' END, CASE WHEN o_orderkey % 9 = 0 THEN 'invalid validity' END) AS faults FROM orders WHERE o_orderkey % 4 = 0 OR o_orderkey % 6 = 0 OR o_orderkey % 9 = 0")
def evidence_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence with its faults."""
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    e = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select(k.alias("id"), F.when(k % 4 != 0, "p").alias("payload"), F.when(k % 6 == 0, 1.5).otherwise(0.5).alias("confidence"), d.alias("valid_from"), F.when(k % 9 == 0, F.date_sub(d, 1)).otherwise(d).alias("valid_to"))
    return provenance.evidence_faults(e).select("id", F.array_join("faults", "; ").alias("faults"))


@query("SELECT o_orderkey AS link_id, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS place FROM orders WHERE o_custkey = 7")
def links_of_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subject's links, oldest first, with their places."""
    from pyspark.sql.window import Window

    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("subject_id"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("link_id"))
    return provenance.links_of(o, "7").select("link_id", F.row_number().over(Window.partitionBy("subject_id").orderBy("created_at", "link_id")).alias("place"))


@query("SELECT DISTINCT 'normalized-record:' || o_custkey AS evidence_key, 'S' AS source_system, substr(sha256('normalized-record:' || o_custkey), 1, 32) AS evidence_id FROM orders")
def record_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One evidence for each record, of an id that its key gives."""
    return provenance.evidence_for_records(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("record_id"), F.lit("S").alias("source_system")))


@query("SELECT 'order:' || o_orderkey AS subject_id, '/value' AS path, substr(sha256('normalized-record:' || o_custkey), 1, 32) AS evidence_id, '{\"rule\":\"trade\",\"version\":\"2\"}' AS transformation FROM orders")
def stamped_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of values to their records' evidence, with the rule and its version."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("order:"), "o_orderkey").alias("subject_id"), F.lit("/value").alias("path"), F.col("o_custkey").alias("record_id"))
    return provenance.stamped(o, "trade", "2")


# worlds


@query("SELECT 'f' || o_custkey AS fingerprint, bool_and(NOT (o_orderstatus = 'F' AND o_orderkey % 2 = 0)) AS is_new FROM orders GROUP BY o_custkey")
def snapshot_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each fingerprint whether no ready version with counts has it yet."""
    m = table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), "o_custkey").alias("fingerprint"), F.when(F.col("o_orderstatus") == "F", "READY").otherwise("PARTIAL").alias("index_status"), F.when(F.col("o_orderkey") % 2 == 0, 1).alias("records"))
    return baseline.new_snapshots(m.select("fingerprint").distinct(), m)


@query("SELECT o_custkey AS version, count(*) AS expected, count(*) FILTER (o_orderkey % 50 <> 0) AS loaded, count(*) = count(*) FILTER (o_orderkey % 50 <> 0) AS whole FROM orders GROUP BY o_custkey")
def snapshot_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all records that a version names are found again."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("version"), F.col("o_orderkey").alias("record_id"))
    return baseline.reload_check(o, o.where("record_id % 50 <> 0").select("record_id"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey % 40 AS s, o_custkey % 30 AS d, o_orderkey % 3 AS kind, 'P' || o_orderkey % 9 AS good FROM orders), f AS (SELECT CASE WHEN kind = 0 THEN d ELSE s END AS a, CASE WHEN kind = 0 THEN s ELSE d END AS b, good FROM o WHERE s <> d AND good <> 'P0')
SELECT 'PRODUCES' AS type, 'country:X:' || a AS source, 'product:' || good AS target FROM f UNION SELECT 'SUPPLIES', 'product:' || good, 'country:X:' || b FROM f UNION SELECT 'DEPENDS_ON', 'country:X:' || b, 'product:' || good FROM f UNION SELECT 'SHIPS_VIA', 'product:' || good, 'mode:1' FROM o WHERE s <> d AND good <> 'P0' AND kind = 1
UNION SELECT 'HAS_INDICATOR', 'country:X:' || c_nationkey, 'indicator:WORLD_BANK_' || c_mktsegment FROM customer UNION SELECT 'PARENT_OF', 'product:' || p_size, 'product:' || p_partkey FROM part WHERE p_size <> p_partkey UNION SELECT 'LOCATED_IN', 'port:' || s_suppkey, 'country:X:' || s_nationkey FROM supplier WHERE s_suppkey % 2 = 0 UNION SELECT 'CLASSIFIED_AS', 'company:CIK:' || s_suppkey, 'industry:' || s_nationkey FROM supplier
UNION SELECT 'TRADE_FLOW', 'country:X:' || a, 'country:X:' || b FROM (SELECT CASE WHEN kind = 0 THEN d ELSE s END AS a, CASE WHEN kind = 0 THEN s ELSE d END AS b FROM o WHERE s <> d)""")
def semantic_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed edges of canonical records by the mapping rules."""
    none = F.lit(None).cast("string")

    def record(df: DataFrame, system: str, kind: str, key: Column, code: Column, country: Column, partner: Column = none, **dims: Column) -> DataFrame:
        d = F.map_filter(F.create_map(*(x for k, v in dims.items() for x in (F.lit(k), v.cast("string")))), lambda _, v: v.isNotNull()) if dims else F.create_map().cast("map<string,string>")
        return df.select(F.lit(system).alias("source_system"), F.lit(kind).alias("record_type"), key.cast("string").alias("natural_key"), code.cast("string").alias("classification_code"), none.alias("classification_version"), country.alias("country"), partner.alias("partner"), d.alias("dimensions"))

    place = lambda c: F.concat(F.lit("country:X:"), c)
    o, c, p, s = (table(spark, sf_dir, t) for t in ("orders", "customer", "part", "supplier"))
    good, kind = F.when(F.col("o_orderkey") % 9 == 0, "TOTAL").otherwise(F.concat(F.lit("P"), F.col("o_orderkey") % 9)), F.col("o_orderkey") % 3
    r = record(o, "UN_COMTRADE", "TRADE_FLOW", F.col("o_orderkey"), good, place(F.col("o_custkey") % 40), place(F.col("o_custkey") % 30), flowCode=F.when(kind == 0, "m").otherwise("X"), motCode=F.when(kind == 1, "1").when(kind == 2, "0"))
    r = r.unionByName(record(c, "WORLD_BANK", "MACRO_INDICATOR", F.col("c_custkey"), F.col("c_mktsegment"), place(F.col("c_nationkey")))).unionByName(record(p, "HS", "HS_CLASSIFICATION", F.col("p_partkey"), F.col("p_partkey"), none, parent=F.col("p_size")))
    r = r.unionByName(record(s, "UNLOCODE", "LOCATION_CODE", F.col("s_suppkey"), none, place(F.col("s_nationkey")), function=F.when(F.col("s_suppkey") % 2 == 0, "1---").otherwise("-2--"))).unionByName(record(s, "SEC", "SEC_FILING", F.col("s_suppkey"), none, none, cik=F.col("s_suppkey"), sic=F.col("s_nationkey")))
    return baseline.semantic(r)


@query("""WITH a AS (SELECT n_nationkey AS a, CAST((n_nationkey * 37) % 180 - 90 AS DOUBLE) AS a_lat, CAST((n_nationkey * 73) % 360 - 180 AS DOUBLE) AS a_lon FROM nation), b AS (SELECT s_suppkey AS b, CAST((s_suppkey * 37) % 180 - 90 AS DOUBLE) AS b_lat, CAST((s_suppkey * 73) % 360 - 180 AS DOUBLE) AS b_lon FROM supplier),
h AS (SELECT a, b, pow(sin(radians(b_lat - a_lat) / 2), 2) + cos(radians(a_lat)) * cos(radians(b_lat)) * pow(sin(radians(b_lon - a_lon) / 2), 2) AS x FROM a, b) SELECT 'AFFECTS' AS type, 'crisis:e' || a AS source, 'port:' || b AS target FROM h WHERE round(2 * 6371.0088 * atan2(sqrt(x), sqrt(1 - x)), 3) <= 500""")
def crisis_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crises and the ports within 500 km of them."""
    at = lambda c, m, w, s: ((F.col(c) * m) % w - s).cast("double").cast("string")
    row = lambda df, system, kind, key, c: df.select(F.lit(system).alias("source_system"), F.lit(kind).alias("record_type"), key.alias("natural_key"), F.create_map(F.lit("latitude"), at(c, 37, 180, 90), F.lit("longitude"), at(c, 73, 360, 180)).alias("dimensions"))
    n, s = table(spark, sf_dir, "nation", "n_nationkey"), table(spark, sf_dir, "supplier", "s_suppkey")
    return baseline.affects(row(n, "USGS", "EARTHQUAKE", F.concat(F.lit("e"), "n_nationkey"), "n_nationkey").unionByName(row(s, "WPI", "PORT", F.col("s_suppkey").cast("string"), "s_suppkey")))


@query("SELECT CAST(c_custkey AS VARCHAR) AS natural_key, CASE WHEN c_custkey % 3 = 0 THEN 'country:ISO-3166-1-alpha-3:AAA' WHEN c_custkey % 3 = 1 THEN CASE WHEN c_nationkey < 20 THEN 'country:ISO-3166-1-alpha-3:N' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') ELSE 'country:ISO-3166-1-alpha-2:' || c_nationkey END ELSE 'country:UN-M49:' || c_nationkey END AS country, CASE WHEN c_custkey % 3 = 0 THEN 'country:ISO-3166-1-alpha-3:BBB' WHEN c_custkey % 3 = 2 THEN 'country:UN-M49:9' END AS partner FROM customer")
def country_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries and partners of records as nodes: letters that trade records give, numbers, and two letters mapped to three."""
    k, n = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    dims = F.map_filter(F.create_map(F.lit("reporterIso"), F.when(k % 3 == 0, "AAA"), F.lit("partnerIso"), F.when(k % 3 == 0, "BBB"), F.lit("partnerCode"), F.lit("9")), lambda _, v: v.isNotNull())
    r = table(spark, sf_dir, "customer").select(k.cast("string").alias("natural_key"), F.when(k % 3 == 1, "X").otherwise("UN_COMTRADE").alias("source_system"), n.alias("country_code"), F.lit("ISO-3166-1-alpha-2").alias("country_code_scheme"), dims.alias("dimensions"))
    alpha3 = table(spark, sf_dir, "nation", "n_nationkey").where("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("alpha2"), F.concat(F.lit("N"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("iso3"))
    return baseline.with_country(r, alpha3).select("natural_key", "country", "partner")


# graph search and evaluation


@query("""WITH p AS (SELECT item_id, [substr(text, 1, 3), 'b', 'c'] AS names, ['X', 'Y'] AS types, item_id % 3 AS citations FROM benchmark)
SELECT item_id, substr('q ' || names[1] || ' b c X Y', 1, 2000) AS expanded, CASE WHEN item_id % 4 = 0 THEN 'No entity of this world version matched.' WHEN item_id % 4 = 1 THEN 'Matched ' || names[1] || ', but found no path.' ELSE 'Best path: ' || names[1] || ' --X-- b --Y-- c. Based on ' || item_id || ' evidence references' || CASE WHEN citations > 0 THEN ' and ' || citations || ' text citations' ELSE '' END || '.' END AS answer FROM p""")
def graph_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with what their best path adds to them, and the path told."""
    k = F.col("item_id")
    names, types = F.array(F.substring("text", 1, 3), F.lit("b"), F.lit("c")), F.array(F.lit("X"), F.lit("Y"))
    none = F.array().cast("array<string>")
    told = validation.answer(F.when(k % 4 == 0, none).when(k % 4 == 1, F.slice(names, 1, 1)).otherwise(names), F.when(k % 4 <= 1, none).otherwise(types), k, k % 3)
    return table(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", validation.expanded_query(F.lit("q"), names, types).alias("expanded"), told.alias("answer"))


@query("SELECT metric, strategy, round(v - coalesce(old, 0), 6) AS delta FROM (SELECT o_orderpriority AS strategy, o_orderstatus AS metric, CAST(count(*) AS DOUBLE) / 7 AS v, CASE WHEN o_orderstatus <> 'P' THEN CAST(max(o_custkey) AS DOUBLE) / 7 END AS old FROM orders GROUP BY o_orderpriority, o_orderstatus)")
def evaluation_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures less those of an earlier run; what that lacks counts as 0."""
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("strategy"), F.col("o_orderstatus").alias("metric"))
    return retrieval.quality_delta(g.agg((F.count("*") / 7).alias("value")), g.agg((F.max("o_custkey") / 7).alias("value")).where("metric <> 'P'"))


@query("SELECT quantile_disc(l_extendedprice, 0.95) AS p95 FROM lineitem")
def latency_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at the nearest rank of 95 %."""
    return retrieval.nearest_rank(table(spark, sf_dir, "lineitem", "l_extendedprice"), "l_extendedprice", 0.95)


@query("WITH f AS (SELECT o_custkey AS query_id, o_orderkey % 5 AS doc, min(o_orderkey) AS first FROM orders GROUP BY ALL) SELECT query_id, doc, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first) AS INTEGER) AS rank FROM f")
def distinct_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a ranking of chunks, each once, in the order of their first chunk."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), (F.col("o_orderkey") % 5).alias("doc"), F.col("o_orderkey").alias("rank"))
    return retrieval.documents_of(o, "query_id", "doc")


@query("SELECT count(*) AS cases, round(avg(p), 6) AS path_precision, round(avg(r), 6) AS path_recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS f1 FROM (SELECT c, round(h / CAST(np AS DOUBLE), 6) AS p, round(h / CAST(ne AS DOUBLE), 6) AS r FROM (SELECT c_nationkey AS c, count(DISTINCT c_mktsegment) AS ne, count(DISTINCT CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'none' END) AS np, count(DISTINCT CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END) AS h FROM customer GROUP BY ALL))")
def path_macro_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the cases' precision, recall and F1."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("case_id"), F.col("c_mktsegment").alias("types"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("none").alias("found"))
    return graph.macro_mean(graph.path_scores(c.select("case_id", "types"), c.select("case_id", F.col("found").alias("types"))))


_CUT = "CASE WHEN ideal < n AND cut > cur + 600 THEN cut ELSE ideal END AS stop FROM (SELECT *, cur + length(regexp_extract(substr(text, CAST(cur + 1 AS BIGINT), CAST(ideal - cur AS BIGINT)), '(?s)^(.*)[ \n]', 1)) AS cut FROM x)"


@query(rf"""WITH RECURSIVE w AS (SELECT doc_id, text, length(text) AS n FROM (SELECT doc_id, replace(text, '#', '+') AS text FROM documents) WHERE text IS NOT NULL AND length(text) > 0),
x AS (SELECT doc_id, text, n, 0 AS cur, least(1200, n) AS ideal FROM w UNION ALL SELECT doc_id, text, n, following, least(following + 1200, n) FROM (SELECT doc_id, text, n, stop, greatest(cur + 1, stop - 160) AS following FROM (SELECT *, {_CUT})) WHERE stop < n),
p AS (SELECT doc_id, cur, substr(text, CAST(cur + 1 AS BIGINT), CAST(stop - cur AS BIGINT)) AS part FROM (SELECT *, {_CUT}))
SELECT doc_id, begins, ends FROM (SELECT doc_id, CAST(cur + length(part) - length(regexp_replace(part, '^\s+', '')) AS INTEGER) AS begins, CAST(cur + length(regexp_replace(part, '\s+$', '')) AS INTEGER) AS ends FROM p) WHERE ends > begins""")
def chunk_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that end at a break beyond their half, trimmed, of whole documents with their headings' marks replaced: they are one section each."""
    d = table(spark, sf_dir, "documents", "doc_id", F.replace("text", F.lit("#"), F.lit("+")).alias("text"))
    return retrieval.chunks(d).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("begins"), F.col("ends"))


@query(rf"""WITH RECURSIVE w AS (SELECT doc_id, text, length(text) AS n FROM (SELECT doc_id, replace(text, '#', '+') AS text FROM documents) WHERE text IS NOT NULL AND length(text) > 0),
x AS (SELECT doc_id, text, n, 0 AS cur, least(1200, n) AS ideal FROM w UNION ALL SELECT doc_id, text, n, following, least(following + 1200, n) FROM (SELECT doc_id, text, n, stop, greatest(cur + 1, stop - 160) AS following FROM (SELECT *, {_CUT})) WHERE stop < n),
p AS (SELECT doc_id, cur, substr(text, CAST(cur + 1 AS BIGINT), CAST(stop - cur AS BIGINT)) AS part FROM (SELECT *, {_CUT})),
c AS (SELECT *, row_number() OVER (ORDER BY doc_id, begins) AS id FROM (SELECT doc_id, CAST(cur + length(part) - length(regexp_replace(part, '^\s+', '')) AS INTEGER) AS begins, CAST(cur + length(regexp_replace(part, '\s+$', '')) AS INTEGER) AS ends, regexp_replace(part, '^\s+|\s+$', '', 'g') AS content FROM p) WHERE ends > begins),
q AS (SELECT item_id, term, count(*) AS tf_q FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM benchmark) GROUP BY ALL), d AS (SELECT id, term, count(*) AS tf_d FROM (SELECT id, unnest(regexp_extract_all(lower(content), '[\p{{L}}\p{{N}}]+')) AS term FROM c) GROUP BY ALL),
n AS (SELECT id, sum(tf_d) AS length FROM d GROUP BY id), kw AS (SELECT item_id, d.id AS id, round(sum(least(tf_q, tf_d)) / sqrt(CAST(any_value(length) AS DOUBLE)), 6) AS score FROM q JOIN d ON q.term = d.term JOIN n ON n.id = d.id GROUP BY item_id, d.id),
top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM kw) SELECT item_id, doc_id, begins, ends, score, CAST(rank AS INTEGER) AS rank FROM top JOIN c ON c.id = top.id WHERE rank <= 10""")
def chunk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best chunks of all documents for each benchmark text: chunks are numbered in their order and searched as documents are."""
    d = table(spark, sf_dir, "documents", "doc_id", F.replace("text", F.lit("#"), F.lit("+")).alias("text"))
    c = written(retrieval.chunks(d).select(F.col("doc_id").cast("long").alias("doc_id"), "begins", "ends", F.col("content").alias("text")), "chunks")
    places = written(numbered(c.select("doc_id", "begins"), ["doc_id", "begins"], "chunk"), "chunk-numbers")
    found = retrieval.keyword_top(c.join(places, ["doc_id", "begins"]), table(spark, sf_dir, "benchmark", "item_id", "text"), "chunk", "item_id", 10)
    return found.join(places, "chunk").join(c.select("doc_id", "begins", "ends"), ["doc_id", "begins"]).select("item_id", "doc_id", "begins", "ends", "score", "rank")
