"""Paths from roots: trails, which use no edge twice, and the first paths in preorder without making the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.registry import query
from ..plans.storage import written
from ..plans.tables import DEPENDENCY, TRADE, dependency, pair_flows, table, trade
from .graph import _places, top_edges


def _sides(edges: DataFrame) -> DataFrame:
    """Edges (``id``, ``type``, ``source``, ``target``) as they are seen from each end; one that ends where it begins is seen once."""
    there = edges.select(F.col("source").alias("at"), F.col("target").alias("to"), "id", "type")
    return there.unionByName(edges.where("source <> target").select(F.col("target").alias("at"), F.col("source").alias("to"), "id", "type"))


def trails(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """Every path of 1 to ``depth`` edges from ``roots`` (``node``), along or against the edges, that uses no edge twice; nodes may repeat, and parallel edges give paths of their own: ``nodes``, ``edges`` (ids), ``types``, ``hops``.

    Each level is an equi-join of the open trails with the edges' ends, written in the shared folder. The result itself may be large: it has every trail.
    """
    sides = _sides(edges)
    open_ = roots.select(F.array("node").alias("nodes"), F.array().cast("array<string>").alias("edges"), F.array().cast("array<string>").alias("types"))
    out = None
    for level in range(1, depth + 1):
        step = open_.withColumn("at", F.element_at("nodes", -1)).join(sides, "at").where(~F.array_contains("edges", F.col("id")))
        open_ = step.select(F.concat("nodes", F.array("to")).alias("nodes"), F.concat("edges", F.array("id")).alias("edges"), F.concat("types", F.array("type")).alias("types"))
        open_ = written(open_, "trails") if level < depth else open_
        out = open_ if out is None else out.unionByName(open_)
    return out.select("nodes", "edges", "types", F.size("edges").alias("hops"))


def preorder_paths(edges: DataFrame, roots: DataFrame, depth: int, limit: int) -> DataFrame:
    """The first ``limit`` simple paths of up to ``depth`` edges from each root, as a walk in depth finds them that takes a node's edges by type and then by id: ``root``, ``place`` (from 1), ``nodes``, ``types``, ``hops``.

    Preorder compares paths edge by edge, a path before its continuations. Every path that is known is a result, so one that has ``limit`` known ones before it is out, and with it
    all that would continue it. So each level goes on with ``limit`` paths a root at most. A walk at a node needs ``limit`` edges to nodes that it has not visited; of the edges to any
    one neighbour no more than ``limit`` count, and it has visited ``depth`` neighbours at most, so a node's first ``limit * (depth + 1)`` edges are enough, whatever hub it is. A level
    makes at most ``limit * limit * (depth + 1)`` rows a root.
    """
    order = F.struct("type", "id")
    pairs = Window.partitionBy("at", "to").orderBy("type", "id")
    sides = _sides(edges).where("at <> to").withColumn("_n", F.row_number().over(pairs)).where(F.col("_n") <= limit)
    sides = sides.withColumn("_n", F.row_number().over(Window.partitionBy("at").orderBy("type", "id"))).where(F.col("_n") <= limit * (depth + 1))
    sides = written(sides.select("at", "to", order.alias("edge")), "first-edges")
    best = Window.partitionBy("root").orderBy("steps")
    open_ = roots.select(F.col("node").alias("root"), F.array("node").alias("nodes"), F.array().cast("array<struct<type:string,id:string>>").alias("steps")).distinct()
    kept = None
    for _ in range(depth):
        step = open_.withColumn("at", F.element_at("nodes", -1)).join(sides, "at").where(~F.array_contains("nodes", F.col("to")))
        more = step.select("root", F.concat("nodes", F.array("to")).alias("nodes"), F.concat("steps", F.array("edge")).alias("steps"), F.lit(True).alias("open"))
        known = more if kept is None else more.unionByName(kept.withColumn("open", F.lit(False)))
        level = written(known.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit), "preorder")
        kept, open_ = level.select("root", "nodes", "steps"), level.where("open").select("root", "nodes", "steps")
    return level.select("root", "place", "nodes", F.col("steps.type").alias("types"), F.size("steps").alias("hops"))


_MESH = TRADE + DEPENDENCY + """, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY cents DESC, rel) AS rn FROM edges) WHERE rn <= 2),
e AS (SELECT 'S' || rel AS id, 'SUPPLIES' AS type, 'country:' || src AS source, 'country:' || dst AS target FROM top UNION ALL SELECT 'D' || rel, 'DEPENDS_ON', 'country:' || dst, 'country:' || src FROM top UNION ALL SELECT 'P' || n_nationkey, 'PART_OF', 'country:' || n_nationkey, 'region:' || n_regionkey FROM nation)"""


def _mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two largest flows into each country, as a supply and as a dependency, and countries in regions: parallel edges and cycles."""
    top = written(top_edges(dependency(pair_flows(trade(spark, sf_dir))), 2), "mesh")
    place = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    supplies = top.select(F.concat(F.lit("S"), "rel").alias("id"), F.lit("SUPPLIES").alias("type"), place("country", "src").alias("source"), place("country", "dst").alias("target"))
    depends = top.select(F.concat(F.lit("D"), "rel").alias("id"), F.lit("DEPENDS_ON").alias("type"), place("country", "dst").alias("source"), place("country", "src").alias("target"))
    part = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").select(F.concat(F.lit("P"), "n_nationkey").alias("id"), F.lit("PART_OF").alias("type"), place("country", "n_nationkey").alias("source"), place("region", "n_regionkey").alias("target"))
    return supplies.unionByName(depends).unionByName(part)


_TRAILS = _MESH.replace("WITH trade", "WITH RECURSIVE trade", 1) + """, u AS (SELECT source AS a, target AS b, id, type FROM e UNION ALL SELECT target, source, id, type FROM e WHERE source <> target),
t AS (SELECT ['region:0'] AS nodes, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS types UNION ALL SELECT list_append(nodes, b), list_append(ids, id), list_append(types, type) FROM t JOIN u ON nodes[-1] = a WHERE NOT list_contains(ids, id) AND len(ids) < 3)"""


@query(_TRAILS + " SELECT array_to_string(nodes, '>') AS path, array_to_string(ids, '>') AS edges, array_to_string(types, '>') AS types, CAST(len(ids) AS INTEGER) AS hops FROM t WHERE len(ids) > 0")
def graph_trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trail of up to three edges from a region: paths through parallel edges, and back to a node that was visited, are paths of their own."""
    t = trails(_mesh(spark, sf_dir), spark.sql("SELECT 'region:0' AS node"), 3)
    return t.select(F.array_join("nodes", ">").alias("path"), F.array_join("edges", ">").alias("edges"), F.array_join("types", ">").alias("types"), "hops")


@query(_TRAILS + " SELECT array_to_string(nodes, '>') AS path, array_to_string(ids, '>') AS edges, CAST(len(ids) AS INTEGER) AS hops FROM t WHERE len(ids) > 0 ORDER BY len(ids), nodes, ids LIMIT 100")
def graph_trails_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred trails by length, then by their nodes, then by their edges: a limit that is the feature."""
    t = trails(_mesh(spark, sf_dir), spark.sql("SELECT 'region:0' AS node"), 3)
    return t.orderBy("hops", "nodes", "edges").limit(100).select(F.array_join("nodes", ">").alias("path"), F.array_join("edges", ">").alias("edges"), "hops")


@query("""WITH RECURSIVE e AS (SELECT 'PART_OF' AS type, 'region:' || n_regionkey || '>country:' || n_nationkey AS id, 'region:' || n_regionkey AS source, 'country:' || n_nationkey AS target FROM nation
  UNION ALL SELECT 'LOCATED_IN', 'supplier:' || s_suppkey || '>country:' || s_nationkey, 'supplier:' || s_suppkey, 'country:' || s_nationkey FROM supplier),
u AS (SELECT source AS a, target AS b, id, type FROM e UNION ALL SELECT target, source, id, type FROM e),
p AS (SELECT 'region:' || r_regionkey AS root, ['region:' || r_regionkey] AS nodes, CAST([] AS VARCHAR[]) AS steps, CAST([] AS VARCHAR[]) AS types FROM region
  UNION ALL SELECT root, list_append(nodes, b), list_append(steps, type || ' ' || id), list_append(types, type) FROM p JOIN u ON nodes[-1] = a WHERE NOT list_contains(nodes, b) AND len(steps) < 3),
r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY steps) AS place FROM p WHERE len(steps) > 0)
SELECT root, CAST(place AS INTEGER) AS place, array_to_string(nodes, '>') AS path, array_to_string(types, '>') AS types, CAST(len(steps) AS INTEGER) AS hops FROM r WHERE place <= 100""")
def graph_paths_preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred paths from each region as a walk in depth finds them: a limit that is the feature, and that the walk keeps at every level."""
    edges = _places(spark, sf_dir).withColumn("id", F.concat_ws(">", "source", "target"))
    roots = table(spark, sf_dir, "region", "r_regionkey").select(F.concat(F.lit("region:"), "r_regionkey").alias("node"))
    p = preorder_paths(edges, roots, 3, 100)
    return p.select("root", "place", F.array_join("nodes", ">").alias("path"), F.array_join("types", ">").alias("types"), "hops")
