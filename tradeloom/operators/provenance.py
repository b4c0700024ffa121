"""Provenance: sources, evidence, assumptions, and links of subjects to exactly one origin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.tables import table

POINTER = r"^(/([^/~]|~[01])*)*$"


def register_source(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New sources to append, and those whose ``source_key`` is taken."""
    return new.dropDuplicates(["source_key"]).join(existing.select("source_key"), "source_key", "left_anti"), new.join(existing.select("source_key"), "source_key", "left_semi")


def evidence_faults(evidence: DataFrame) -> DataFrame:
    """Evidence with its faults: no payload, confidence outside 0 to 1, an interval that ends before it starts."""
    faults = F.filter(F.array(F.when(F.col("payload").isNull(), "payload is required"), F.when(~F.col("confidence").between(0, 1), "confidence must be within 0 and 1"), F.when(F.col("valid_to") < F.col("valid_from"), "invalid validity")), lambda x: x.isNotNull())
    return evidence.withColumn("faults", faults).where(F.size("faults") > 0)


def valid_links(links: DataFrame) -> DataFrame:
    """Links with exactly one of evidence and assumption and a JSON pointer as path, each once."""
    one = F.col("evidence_id").isNotNull() != F.col("assumption_id").isNotNull()
    return links.where(one & F.col("path").rlike(POINTER)).dropDuplicates(["subject_id", "path", "evidence_id", "assumption_id"])


def links_of(links: DataFrame, subject: str) -> DataFrame:
    """The links of a subject, oldest first."""
    return links.where(F.col("subject_id") == subject).orderBy("created_at", "link_id")


def evidence_for_records(records: DataFrame) -> DataFrame:
    """One evidence for each normalised record, of an id that its key gives."""
    return records.select(F.concat(F.lit("normalized-record:"), "record_id").alias("evidence_key"), "source_system").dropDuplicates(["evidence_key"]).withColumn("evidence_id", F.substring(F.sha2("evidence_key", 256), 1, 32))


@query("""WITH l AS (SELECT 'order:' || l_orderkey AS subject_id, CASE WHEN l_linenumber = 5 THEN 'lines/x' ELSE '/lines/' || l_linenumber END AS path, CASE WHEN l_linenumber % 3 <> 0 THEN sha256('normalized-record:' || l_orderkey || '-' || l_linenumber) END AS evidence_id, CASE WHEN l_linenumber % 3 = 0 OR l_linenumber = 2 THEN 'assumed' END AS assumption_id FROM lineitem)
SELECT DISTINCT subject_id, path, substr(evidence_id, 1, 32) AS evidence_id, assumption_id FROM l WHERE ((evidence_id IS NULL) <> (assumption_id IS NULL)) AND starts_with(path, '/')""")
def provenance_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid links of every order's values to their origins."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber")
    n = F.col("l_linenumber")
    key = F.concat(F.lit("normalized-record:"), F.concat_ws("-", "l_orderkey", "l_linenumber"))
    links = li.select(
        F.concat(F.lit("order:"), "l_orderkey").alias("subject_id"), F.when(n == 5, "lines/x").otherwise(F.concat(F.lit("/lines/"), n)).alias("path"),
        F.when(n % 3 != 0, F.substring(F.sha2(key, 256), 1, 32)).alias("evidence_id"), F.when((n % 3 == 0) | (n == 2), "assumed").alias("assumption_id"),
    )
    return valid_links(links)


def stamped(values: DataFrame, rule: str, version: str) -> DataFrame:
    """Links of values (``subject_id``, ``path``, ``record_id``) to their record's evidence, with the rule that made them and its version."""
    key = F.concat(F.lit("normalized-record:"), "record_id")
    how = F.to_json(F.struct(F.lit(rule).alias("rule"), F.lit(version).alias("version")))
    return values.select("subject_id", "path", F.substring(F.sha2(key, 256), 1, 32).alias("evidence_id"), how.alias("transformation"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n FROM lineitem WHERE l_linenumber NOT IN (5, 2)) SELECT '/lines/' || n AS path, count(*) FILTER (n % 3 <> 0) AS with_evidence, count(*) FILTER (n % 3 = 0) AS assumed FROM l GROUP BY n""")
def provenance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many values of each kind have evidence, and how many rest on assumptions."""
    links = provenance_links(spark, sf_dir)
    return links.groupBy("path").agg(F.count("evidence_id").alias("with_evidence"), F.count("assumption_id").alias("assumed"))


@query("""WITH t AS (SELECT n_nationkey, count(s_suppkey) AS suppliers, sum(CASE WHEN s_acctbal > 0 THEN 1 ELSE 0 END) AS solvent FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL), c AS (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY ALL)
SELECT n_nationkey AS nation, concat_ws(',', CASE WHEN suppliers < 3 THEN 'suppliers' END, CASE WHEN solvent < 3 THEN 'solvent' END, CASE WHEN coalesce(customers, 0) < 60 THEN 'customers' END) AS missing, suppliers >= 3 AND solvent >= 3 AND coalesce(customers, 0) >= 60 AS ready FROM t LEFT JOIN c ON c_nationkey = n_nationkey""")
def scenario_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries whose data suffice for a scenario, and what the others lack."""
    n, s, c = table(spark, sf_dir, "nation", "n_nationkey"), table(spark, sf_dir, "supplier", "s_nationkey", "s_acctbal"), table(spark, sf_dir, "customer", "c_nationkey")
    sup = s.groupBy("s_nationkey").agg(F.count("*").alias("suppliers"), F.count_if(F.col("s_acctbal") > 0).alias("solvent"))
    cus = c.groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    j = n.join(sup, n.n_nationkey == sup.s_nationkey, "left").join(cus, n.n_nationkey == cus.c_nationkey, "left").na.fill(0, ["suppliers", "solvent", "customers"])
    lacks = F.filter(F.array(*(F.when(F.col(k) < least, k) for k, least in (("suppliers", 3), ("solvent", 3), ("customers", 60)))), lambda x: x.isNotNull())
    return j.select(F.col("n_nationkey").alias("nation"), F.array_join(lacks, ",").alias("missing"), (F.size(lacks) == 0).alias("ready"))
