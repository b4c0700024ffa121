"""Ontology: the grammar of edges, typed properties, personal keys and validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import variant
from ..plans.registry import query
from ..plans.tables import table
from .world import typed_edges

# The edges our tables may hold, by type, source and target.
GRAMMAR = [("LOCATED_IN", "supplier", "country"), ("LOCATED_IN", "customer", "country"), ("PART_OF", "region", "country"), ("SUPPLIES", "supplier", "part"), ("CLASSIFIED_AS", "part", "industry")]
# Keys that name a person.
PERSONAL_KEYS = "name firstname lastname fullname email phone phonenumber address birthdate ssn passport nationalid".split()


def grammar_violations(edges: DataFrame, grammar: DataFrame) -> DataFrame:
    """Edges whose (type, source type, target type) the grammar does not have."""
    return edges.join(grammar, ["type", "source_type", "target_type"], "left_anti")


@query("""WITH e AS (SELECT DISTINCT 'supplier' AS source_type, 'LOCATED_IN' AS type, 'country' AS target_type, 's' || s_suppkey AS k FROM supplier UNION SELECT 'customer', 'LOCATED_IN', 'country', 'c' || c_custkey FROM customer UNION SELECT 'region', 'PART_OF', 'country', 'n' || n_nationkey FROM nation
UNION SELECT 'supplier', 'SUPPLIES', 'part', l_suppkey || '-' || l_partkey FROM lineitem UNION SELECT 'part', 'CLASSIFIED_AS', 'class', 'p' || p_partkey FROM part)
SELECT type, source_type, target_type, count(*) AS edges, type <> 'CLASSIFIED_AS' AS allowed FROM e GROUP BY ALL""")
def grammar_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges by kind, and whether the grammar allows the kind."""
    kinds = typed_edges(spark, sf_dir).groupBy("type", "source_type", "target_type").agg(F.count("*").alias("edges"))
    known = spark.createDataFrame(GRAMMAR, "type string, source_type string, target_type string").withColumn("known", F.lit(True))
    return kinds.join(known, ["type", "source_type", "target_type"], "left").select("type", "source_type", "target_type", "edges", F.coalesce("known", F.lit(False)).alias("allowed"))


def property_fits(value: Column, kind: Column) -> Column:
    """Whether a JSON value, as ``get_json_object`` gives it, is of one of the ten kinds of property."""
    t = lambda name: kind == name
    return (
        F.when(t("INTEGER"), value.rlike(r"^-?\d+(\.0+)?$"))
        .when(t("NUMBER"), value.try_cast("double").isNotNull())
        .when(t("BOOLEAN"), value.isin("true", "false"))
        .when(t("DATE"), value.rlike(r"^\d{4}-\d{2}-\d{2}$") & value.try_cast("date").isNotNull())
        .when(t("DATE_TIME"), value.rlike(r"^\d{4}-\d{2}-\d{2}T[0-9:.]+Z$") & value.try_cast("timestamp").isNotNull())
        .when(t("UUID"), value.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"))
        .when(t("URI"), value.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$"))
        .when(t("OBJECT"), value.rlike(r"^\{"))
        .when(t("ARRAY"), value.rlike(r"^\["))
        .otherwise(t("STRING") & value.isNotNull())
    )


def property_violations(entities: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``id``, ``property``, ``problem`` of entities (``id``, ``entity_type``, ``attributes`` as JSON) against declared properties (``entity_type``, ``property``, ``kind``, ``required``). Undeclared attributes are accepted."""
    attrs = F.from_json("attributes", "map<string,string>")
    j = entities.withColumn("a", attrs).join(catalogue, "entity_type").withColumn("v", F.col("a")[F.col("property")])
    problem = F.when(F.col("v").isNull() & F.col("required"), "missing").when(F.col("v").isNotNull() & ~property_fits(F.col("v"), F.col("kind")), F.concat(F.lit("not a "), F.lower("kind")))
    return j.select("id", "property", problem.alias("problem")).where("problem is not null")


def validity_violations(df: DataFrame) -> DataFrame:
    """Rows whose interval ends without a start or before it."""
    return df.where(F.col("valid_to").isNotNull() & (F.col("valid_from").isNull() | (F.col("valid_to") < F.col("valid_from"))))


def schema_violations(rows: DataFrame, schema: dict, column: str = "payload") -> DataFrame:
    """``id`` and the faults of a JSON column against a schema, for the rows that have any."""
    v = F.try_parse_json(column)
    found = F.when(v.isNull(), F.array(F.lit("$ is no JSON"))).otherwise(variant.schema_faults(v, schema))
    return rows.select(F.col("id").cast("string").alias("id"), found.alias("faults")).where("size(faults) > 0")


def personal_keys(rows: DataFrame, id_col: str, json_col: str, deny: list[str] | None = None) -> DataFrame:
    """``id_col``, ``personal`` for every row: the keys anywhere in a JSON column that, in lower case and without other marks, are on the deny list, each once, sorted. Rows of an id count together; what is no JSON has none."""
    listed = F.array(*map(F.lit, deny or PERSONAL_KEYS))
    found = rows.select(F.col(id_col).alias("id"), F.lit(None).cast("string").alias("key"))
    for level in variant.levels(rows, id_col, json_col):
        found = found.unionByName(level.where("key is not null").select("id", F.regexp_replace(F.lower("key"), "[^a-z]", "").alias("key")).where(F.array_contains(listed, F.col("key"))))
    return found.groupBy("id").agg(F.sort_array(F.collect_set("key")).alias("personal")).withColumnRenamed("id", id_col)


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'fullname' WHEN 1 THEN 'email' WHEN 2 THEN 'email,phone' ELSE '' END AS personal FROM events""")
def pii_key_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose JSON names a person anywhere, also by keys written with escapes; texts that look like keys are none."""
    forms = [
        F.concat(F.lit('{"Full-Name": "x", "in": '), "props", F.lit("}")), F.lit('{"a": {"E_Mail": 1, "list": [{"email": [2]}]}}'), F.concat(F.lit(r'[[{"\u0065mail": '), "props", F.lit(r', "b": {"Ph\u006Fne": null}}]]')),
        F.concat(F.lit(r'{"note": "\"email\": 1, \"phone\": 2", "in": '), "props", F.lit("}")), F.col("props"),
    ]
    body = F.element_at(F.array(*forms), (F.col("event_id") % 5 + 1).cast("int"))
    found = personal_keys(table(spark, sf_dir, "events", "event_id", "props").withColumn("body", body), "event_id", "body")
    return found.select("event_id", F.array_join("personal", ",").alias("personal"))
