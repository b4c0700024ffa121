"""Faults of requests, baselines, graphs, branches and scenarios. Each function gives one row per fault."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The largest baselines, and edges that carry quantities.
MOST_COMPANIES, MOST_LINKS, MOST_SHOCKS, MOST_TURNS, MOST_PARAMETER_BYTES = 5_000, 20_000, 20_000, 120, 32 * 1024
QUANTITATIVE = ["TRADE_FLOW", "SUPPLIES", "DEPENDS_ON", "PRODUCES", "SHIPS_VIA"]
_CREDENTIAL = re.compile(r"key|token|secret|password|credential|authorization", re.I)


def parameters_faults(column: str) -> Column:
    """Faults of runs' parameters, a column of JSON texts, as an array: too long, no object, fields of the outermost object that look like credentials."""
    c = F.col(column)
    keys = F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    named = F.transform(F.filter(keys, lambda k: k.rlike(f"(?i){_CREDENTIAL.pattern}")), lambda k: F.concat(F.lit("credential parameter: "), k))
    first = F.array_compact(F.array(F.when(F.octet_length(c) > MOST_PARAMETER_BYTES, "parameters are too long"), F.when(F.json_object_keys(c).isNull(), "parameters must be an object")))
    return F.concat(first, named)


def sorted_fields(c: Column, kind: T.DataType) -> Column:
    """A column with the fields of its structs, at any depth, in the order of their names."""
    if isinstance(kind, T.StructType):
        return F.struct(*(sorted_fields(c[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: sorted_fields(x, kind.elementType))
    return c


def result_hash(column: str, kind: T.DataType) -> Column:
    """SHA-256 of a column of structs as JSON with sorted keys and no spaces."""
    return F.sha2(F.to_json(sorted_fields(F.col(column), kind)), 256)


def faults(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """``key``, ``fault`` for every rule, a condition that should not hold, that holds for a row."""
    found = F.filter(F.array(*(F.when(c, F.lit(m)) for m, c in rules.items())), lambda x: x.isNotNull())
    return df.select(F.col(key).cast("string").alias("key"), F.explode(found).alias("fault"))


def repeated(df: DataFrame, key: Column, what: str) -> DataFrame:
    return df.groupBy(key.cast("string").alias("key")).agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit(what).alias("fault"))


def too_many(df: DataFrame, most: int, what: str) -> DataFrame:
    n = df.agg(F.count("*").alias("n"))
    return n.where((F.col("n") > most) | (F.col("n") == 0)).select(F.lit("*").alias("key"), F.when(F.col("n") == 0, f"no {what}").otherwise(f"too many {what}").alias("fault"))


def unknown(df: DataFrame, column: str, ids: DataFrame, id_col: str, what: str) -> DataFrame:
    return df.join(ids.select(F.col(id_col).alias(column)), column, "left_anti").select(F.col(column).cast("string").alias("key"), F.lit(what).alias("fault")).distinct()


def not_amount(c: str, positive: bool = False) -> Column:
    v = F.col(c)
    low = v <= 0 if positive else v < 0
    return v.isNull() | F.isnan(v) | (v == float("inf")) | low


def baseline_faults(companies: DataFrame, links: DataFrame) -> DataFrame:
    """Of companies (``company``, ``industry`` and their figures) and links (``supplier``, ``customer`` and theirs)."""
    figures = {f"{c} is no amount": not_amount(c, c in ("unit_price", "productivity")) for c in ("production", "capacity", "inventory", "demand", "unit_price", "unit_cost", "workforce", "wage", "productivity")}
    pair = F.concat_ws(">", "supplier", "customer")
    l = links.withColumn("pair", pair)  # noqa: E741
    out = faults(companies, "company", {"industry is required": F.col("industry").isNull(), **figures}).unionByName(repeated(companies, F.col("company"), "company ids must be unique"))
    out = out.unionByName(faults(l, "pair", {"self-referencing link": F.col("supplier") == F.col("customer"), "per_output is no amount": not_amount("per_output", True), "max_flow is no amount": not_amount("max_flow"), "unit_cost is no amount": not_amount("unit_cost")}))
    out = out.unionByName(repeated(links, pair, "duplicate link"))
    for end in ("supplier", "customer"):
        out = out.unionByName(unknown(links, end, companies, "company", "links must reference known companies"))
    return out.unionByName(too_many(companies, MOST_COMPANIES, "companies")).unionByName(too_many(links, MOST_LINKS, "links").where("fault not like 'no %'"))


def graph_faults(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Of nodes (``entity``, ``entity_type``, ``metrics``, ``origins``) and edges (``rel``, ``src``, ``dst``, ``type``, ``ratio``, ``provenance``)."""
    out = faults(nodes, "entity", {"entity type is required": F.col("entity_type").isNull(), "metrics require provenance": F.col("metrics").isNull() | F.col("origins").isNull()}).unionByName(repeated(nodes, F.col("entity"), "entity ids must be unique"))
    ratio = F.col("ratio")
    out = out.unionByName(faults(edges, "rel", {"self-referencing edge": F.col("src") == F.col("dst"), "unsupported type": ~F.col("type").isin(QUANTITATIVE), "ratio is required": ratio.isNull(), "ratio must be within 0 and 1": F.isnan(ratio) | ~ratio.between(0, 1), "parameters require provenance": F.col("provenance").isNull()}))
    for end in ("src", "dst"):
        out = out.unionByName(unknown(edges, end, nodes, "entity", "edges must reference known entities"))
    return out.unionByName(too_many(nodes, MOST_COMPANIES, "entities")).unionByName(too_many(edges, MOST_LINKS, "edges").where("fault not like 'no %'"))


def branch_faults(branches: DataFrame, shocks: DataFrame, entities: DataFrame, turns: int) -> DataFrame:
    """Of two or three branches (``branch``, ``name``) and their shocks (``branch``, ``entity``, ``turn``)."""
    n = branches.agg(F.count("*").alias("n")).where("n not between 2 and 3").select(F.lit("*").alias("key"), F.lit("two or three branches are needed").alias("fault"))
    out = n.unionByName(repeated(branches, F.lower(F.trim("name")), "branch names must be unique"))
    out = out.unionByName(faults(shocks, "entity", {"turn is outside of the run": ~F.col("turn").between(1, min(turns, MOST_TURNS))})).unionByName(repeated(shocks, F.concat_ws("|", "branch", "entity", "turn"), "duplicate shock in a turn"))
    many = shocks.groupBy("branch").agg(F.count("*").alias("n")).where(F.col("n") > MOST_SHOCKS).select(F.col("branch").cast("string").alias("key"), F.lit("too many shocks").alias("fault"))
    return out.unionByName(many).unionByName(unknown(shocks, "entity", entities, "entity", "shocks must reference known entities"))


def scenario_faults(candidates: DataFrame, metrics: list[str]) -> DataFrame:
    """Of structured scenarios (``id``, ``contract``, ``metric``, ``change_type``, ``change``, ``confidence``) that a reader of questions gave."""
    c = F.col("change")
    return faults(candidates, "id", {"unknown contract": ~F.col("contract").eqNullSafe("v2"), "unknown metric": ~F.col("metric").isin(metrics), "change must be in percent": ~F.col("change_type").eqNullSafe("PERCENT"), "change is out of bounds": c.isNull() | (c == 0) | ~c.between(-1, 1), "not confident enough": F.col("confidence").isNull() | (F.col("confidence") < 0.5)})


def scenario_branches(scenarios: DataFrame) -> DataFrame:
    """Branches A (as it is), B (a policy that is recorded) and C (observed alternative supply) of each scenario, of one seed: seven bytes of a hash of its question."""
    seed = F.conv(F.substring(F.sha2("question", 256), 1, 14), 16, 10).cast("long")
    three = F.explode(F.array(*(F.struct(F.lit(n).alias("branch"), F.lit(p).alias("policy"), F.lit(n == "C").alias("mitigates")) for n, p in (("A", "NONE"), ("B", "RECORDED_POLICY"), ("C", "OBSERVED_ALTERNATIVE_SUPPLY")))))
    return scenarios.withColumn("seed", seed).select("*", three.alias("b")).select("*", "b.*").drop("b")


def expanded_query(question, names, types) -> Column:
    """A question with the names and edge types of the best paths, each once, cut at 2,000 characters."""
    return F.substring(F.array_join(F.array_distinct(F.concat(F.array(question), names, types)), " "), 1, 2000)


def answer(names, types, references, citations) -> Column:
    """A path as a sentence with what it rests on. ``names`` and ``types`` are arrays, ``types`` shorter by one; empty ``names``: nothing was found."""
    steps = F.zip_with(names, types, lambda n, t: F.when(t.isNotNull(), F.concat_ws(" ", n, F.concat(F.lit("--"), t, F.lit("--")))).otherwise(n))
    cites = F.when(citations > 0, F.concat(F.lit(" and "), citations.cast("string"), F.lit(" text citations"))).otherwise("")
    found = F.concat(F.lit("Best path: "), F.array_join(steps, " "), F.lit(". Based on "), references.cast("string"), F.lit(" evidence references"), cites, F.lit("."))
    return F.when(F.size(names) == 0, "No entity of this world version matched.").when(F.size(types) == 0, F.concat(F.lit("Matched "), F.get(names, 0), F.lit(", but found no path."))).otherwise(found)
