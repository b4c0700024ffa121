"""The typed graph: grammar, bounded simple paths, ranking, evaluation, expansion and node search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import variant
from ..plans.numbering import numbered
from ..plans.registry import query
from ..plans.storage import written
from ..plans.tables import DEPENDENCY, TRADE, dependency, pair_flows, table, trade


def simple_paths(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """All paths of 1 to ``depth`` edges from ``roots`` (``node``) that visit no node twice, against or along the edges: ``nodes``, ``types``, ``hops``.

    ``edges``: ``type``, ``source``, ``target``. Each level is an equi-join of the open paths with the edges. All paths are made: where only
    the first are wanted, or a hub multiplies them, see ``paths.preorder_paths``.
    """
    both = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "type").union(edges.select("target", "source", "type"))
    open_ = roots.select(F.array("node").alias("nodes"), F.array().cast("array<string>").alias("types"))
    out = None
    for _ in range(depth):
        step = open_.withColumn("a", F.element_at("nodes", -1)).join(both, "a").where(~F.array_contains("nodes", F.col("b")))
        open_ = step.select(F.concat("nodes", F.array("b")).alias("nodes"), F.concat("types", F.array("type")).alias("types"))
        out = open_ if out is None else out.unionByName(open_)
    return out.select("nodes", "types", F.size("types").alias("hops"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, countries and suppliers, and what lies in what."""
    n, s = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey"), table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    part = n.select(F.lit("PART_OF").alias("type"), F.concat(F.lit("region:"), "n_regionkey").alias("source"), F.concat(F.lit("country:"), "n_nationkey").alias("target"))
    return part.unionByName(s.select(F.lit("LOCATED_IN").alias("type"), F.concat(F.lit("supplier:"), "s_suppkey").alias("source"), F.concat(F.lit("country:"), "s_nationkey").alias("target")))


_PATHS = """WITH RECURSIVE e AS (SELECT 'PART_OF' AS type, 'region:' || n_regionkey AS source, 'country:' || n_nationkey AS target FROM nation UNION ALL SELECT 'LOCATED_IN', 'supplier:' || s_suppkey, 'country:' || s_nationkey FROM supplier),
u AS (SELECT source AS a, target AS b, type FROM e UNION ALL SELECT target, source, type FROM e),
p AS (SELECT ['{root}'] AS nodes, CAST([] AS VARCHAR[]) AS types UNION ALL SELECT list_append(nodes, b), list_append(types, type) FROM p JOIN u ON nodes[-1] = a WHERE NOT list_contains(nodes, b) AND len(types) < {depth})"""
_SHOWN = " SELECT array_to_string(nodes, '>') AS path, array_to_string(types, '>') AS types, CAST(len(types) AS INTEGER) AS hops FROM p WHERE len(types) > 0"


def _shown(p: DataFrame) -> DataFrame:
    return p.select(F.array_join("nodes", ">").alias("path"), F.array_join("types", ">").alias("types"), "hops")


@query(_PATHS.format(root="region:0", depth=2) + _SHOWN)
def graph_paths_2hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every simple path of two hops at most from a region."""
    return _shown(simple_paths(_places(spark, sf_dir), spark.sql("SELECT 'region:0' AS node"), 2))


@query(_PATHS.format(root="supplier:1", depth=3) + _SHOWN + " ORDER BY hops, nodes LIMIT 100")
def graph_paths_3hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred paths by length, then by their nodes: a limit that is the feature."""
    p = simple_paths(_places(spark, sf_dir), spark.sql("SELECT 'supplier:1' AS node"), 3)
    return _shown(p.orderBy("hops", "nodes").limit(100))


def rank_paths(paths: DataFrame, terms: list[str], grounded: Column) -> DataFrame:
    """Paths with ``score``: the share of the terms that their nodes hold, 0.15 if ``grounded``, and 0.05 by hops, to six places."""
    words = F.array_distinct(F.split(F.lower(F.array_join("nodes", ":")), ":"))
    overlap = F.size(F.array_intersect(words, F.array(*map(F.lit, terms)))) / float(max(1, len(terms)))
    return paths.withColumn("score", F.round(overlap + F.when(grounded, 0.15).otherwise(0.0) + 0.05 / F.col("hops"), 6))


@query(_PATHS.format(root="supplier:1", depth=3) + """, s AS (SELECT nodes, types, len(list_intersect(list_distinct(string_split(lower(array_to_string(nodes, ':')), ':')), ['region', '1', 'country'])) / 3.0::DOUBLE + CASE WHEN types[-1] = 'PART_OF' THEN 0.15::DOUBLE ELSE 0 END + 0.05::DOUBLE / len(types) AS score FROM p WHERE len(types) > 0)
SELECT array_to_string(nodes, '>') AS path, CAST(len(types) AS INTEGER) AS hops, round(score, 6) AS score FROM s ORDER BY round(score, 6) DESC, len(types), nodes LIMIT 20""")
def path_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best paths for a question."""
    p = simple_paths(_places(spark, sf_dir), spark.sql("SELECT 'supplier:1' AS node"), 3)
    r = rank_paths(p, ["region", "1", "country"], F.element_at("types", -1) == "PART_OF")
    return r.orderBy(F.desc("score"), "hops", "nodes").limit(20).select(F.array_join("nodes", ">").alias("path"), "hops", "score")


def path_scores(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """Precision, recall and F1 of relationship sequences (``case_id``, ``types``) for each case."""
    e, p = expected.distinct(), predicted.distinct()
    hit = e.join(p, ["case_id", "types"]).groupBy("case_id").agg(F.count("*").alias("hits"))
    n = e.groupBy("case_id").agg(F.count("*").alias("n_expected")).join(p.groupBy("case_id").agg(F.count("*").alias("n_predicted")), "case_id", "full").join(hit, "case_id", "left").na.fill(0)
    precision, recall = F.when(F.col("n_predicted") > 0, F.col("hits") / F.col("n_predicted")).otherwise(0.0), F.when(F.col("n_expected") > 0, F.col("hits") / F.col("n_expected")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return n.select("case_id", F.round(precision, 6).alias("path_precision"), F.round(recall, 6).alias("path_recall"), F.round(f1, 6).alias("f1"))


def macro_mean(scores: DataFrame) -> DataFrame:
    """The means over cases of what ``path_scores`` gives."""
    return scores.agg(F.count("*").alias("cases"), *(F.round(F.avg(c), 6).alias(c) for c in ("path_precision", "path_recall", "f1")))


def read_version(entities: DataFrame, version: str, order: list[str]) -> DataFrame:
    """The entities of a world version with ``place``, their number in an order, and sorted by it. Numbers come by ranges, so that a version of any size is sorted by many tasks."""
    return numbered(entities.where(F.col("world_version_id") == version), order).withColumn("place", F.col("place").cast("int")).orderBy("place")


@query(_PATHS.format(root="region:0", depth=2) + """, pred AS (SELECT DISTINCT CAST(len(types) AS INTEGER) AS case_id, array_to_string(types, '>') AS types FROM p WHERE len(types) > 0),
want(case_id, types) AS (VALUES (1, 'PART_OF'), (1, 'SUPPLIES'), (2, 'PART_OF>LOCATED_IN'), (2, 'PART_OF>PART_OF'), (3, 'PART_OF')), ids AS (SELECT case_id FROM pred UNION SELECT case_id FROM want),
n AS (SELECT case_id, (SELECT count(*) FROM pred WHERE pred.case_id = ids.case_id) AS np, (SELECT count(*) FROM want WHERE want.case_id = ids.case_id) AS nw, (SELECT count(*) FROM want JOIN pred USING (case_id, types) WHERE want.case_id = ids.case_id) AS h FROM ids),
m AS (SELECT case_id, CASE WHEN np > 0 THEN h / CAST(np AS DOUBLE) ELSE 0 END AS pr, CASE WHEN nw > 0 THEN h / CAST(nw AS DOUBLE) ELSE 0 END AS re FROM n)
SELECT case_id, round(pr, 6) AS path_precision, round(re, 6) AS path_recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM m""")
def path_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found against expected relationship sequences."""
    p = simple_paths(_places(spark, sf_dir), spark.sql("SELECT 'region:0' AS node"), 2)
    want = spark.createDataFrame([(1, "PART_OF"), (1, "SUPPLIES"), (2, "PART_OF>LOCATED_IN"), (2, "PART_OF>PART_OF"), (3, "PART_OF")], "case_id int, types string")
    return path_scores(want, p.select(F.col("hops").alias("case_id"), F.array_join("types", ">").alias("types")))


@query(TRADE + DEPENDENCY + """, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY cents DESC, rel) AS rn FROM edges) WHERE rn <= 3),
h1 AS (SELECT rel, src, dst FROM top WHERE src = 9), h2 AS (SELECT DISTINCT t.rel, t.src, t.dst FROM top t JOIN h1 ON t.src = h1.dst), used AS (SELECT rel FROM h1 UNION SELECT rel FROM h2)
SELECT used.rel AS rel, coalesce(b.ratio, p.ratio) AS ratio, b.rel IS NOT NULL AS from_baseline FROM used JOIN top p ON used.rel = p.rel LEFT JOIN (SELECT * FROM top WHERE ratio >= 0.045) b ON used.rel = b.rel""")
def subgraph_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges on paths of two hops from a shocked country, with the baseline's parameters where it has the edge."""
    top = written(top_edges(dependency(pair_flows(trade(spark, sf_dir))), 3), "edges")
    h1 = top.where("src = 9").select("rel", "src", "dst")
    h2 = top.select("rel", "src", "dst").join(h1.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    used = h1.select("rel").union(h2.select("rel")).distinct()
    baseline = top.where("ratio >= 0.045").select(F.col("rel").alias("b_rel"), F.col("ratio").alias("b_ratio"))
    return used.join(top, "rel").join(baseline, F.col("rel") == F.col("b_rel"), "left").select("rel", F.coalesce("b_ratio", "ratio").alias("ratio"), F.col("b_rel").isNotNull().alias("from_baseline"))


def top_edges(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest flows into each destination."""
    from pyspark.sql.window import Window

    return edges.withColumn("rn", F.row_number().over(Window.partitionBy("dst").orderBy(F.desc("cents"), "rel"))).where(F.col("rn") <= k).drop("rn")


@query("""WITH q AS (SELECT 'red widget' AS q UNION ALL SELECT 'nation_1'), n AS (SELECT 'part:' || p_partkey AS id, lower(p_name) AS name FROM part UNION ALL SELECT 'country:' || n_nationkey, lower(n_name) FROM nation UNION ALL SELECT 'segment:' || c_custkey, lower(c_mktsegment) FROM customer),
c AS (SELECT q, id, CASE WHEN name = q THEN 100 WHEN contains(name, q) THEN 80 ELSE 0 END AS score FROM q JOIN n ON contains(name, q) UNION ALL SELECT q, id, 20 FROM q JOIN n ON list_contains(string_split(name, ' '), q)),
m AS (SELECT q, id, max(score) AS score FROM c GROUP BY ALL) SELECT q AS query, id, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rn FROM m) WHERE rn <= 20""")
def node_match_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best nodes for each of a few stated searches: an exact name, a name that contains it, a word of it; the best of several ways counts."""
    from pyspark.sql.window import Window

    p, n, c = table(spark, sf_dir, "part", "p_partkey", "p_name"), table(spark, sf_dir, "nation", "n_nationkey", "n_name"), table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    nodes = p.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.lower("p_name").alias("name")).union(n.select(F.concat(F.lit("country:"), "n_nationkey"), F.lower("n_name"))).union(c.select(F.concat(F.lit("segment:"), "c_custkey"), F.lower("c_mktsegment")))
    asked = nodes.withColumn("query", F.explode(F.array(F.lit("red widget"), F.lit("nation_1"))))
    alias = F.when(F.col("name") == F.col("query"), 100).when(F.contains("name", "query"), 80)
    word = F.when(F.array_contains(F.split("name", " "), F.col("query")), 20)
    best = asked.withColumn("score", F.greatest(alias, word)).where("score is not null").groupBy("query", "id").agg(F.max("score").alias("score"))
    return best.withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where("rn <= 20").select("query", "id", "score")


#: Fixed value: tokens of a search.
SEARCH_TOKENS = 16


def search_tokens(c) -> Column:
    """A search's tokens: lower-cased runs between white space of two or more characters, or of one beyond ASCII; the first sixteen different ones."""
    parts = F.filter(F.split(F.trim(F.lower(c)), r"\s+"), lambda t: (F.length(t) >= 2) | t.rlike(r"[^\x00-\x7F]"))
    return F.slice(F.array_distinct(parts), 1, SEARCH_TOKENS)


def search_query(c) -> Column:
    """A search normalised as its tokens between OR. Full-width forms are folded by ``functions.text.nfkc_casefold`` beforehand where they matter."""
    return F.array_join(search_tokens(c), " OR ")


@query(r"""WITH t AS (SELECT item_id, unnest(regexp_split_to_array(trim(lower(text)), '\s+')) AS t, generate_subscripts(regexp_split_to_array(trim(lower(text)), '\s+'), 1) AS i FROM benchmark),
d AS (SELECT item_id, t, min(i) AS i FROM t WHERE length(t) >= 2 OR regexp_matches(t, '[^\x00-\x7F]') GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS rn FROM d)
SELECT item_id, string_agg(t, ' OR ' ORDER BY i) AS query FROM r WHERE rn <= 16 GROUP BY item_id""")
def search_query_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text as a search's tokens between OR."""
    return table(spark, sf_dir, "benchmark", "item_id", "text").select("item_id", search_query("text").alias("query"))


def evidence_refs(documents: DataFrame, column: str = "attributes") -> DataFrame:
    """Evidence references found anywhere in a JSON column: ``id``, ``evidence_id``, ``source_id``, ``source_uri``, distinct. Ids that are no UUIDs are null; so is a source that is no text."""
    rows = documents.select(F.col("id").cast("string").alias("id"), F.col(column).alias("body"))
    names = ("evidenceId", "dataSourceId", "sourceUri")

    def refs(df: DataFrame, v) -> DataFrame:
        there = [variant.child(v, n) for n in names]
        text = [F.when(variant.kind(c) == "STRING", F.try_variant_get(c, "$", "string")) for c in there]
        ids = [F.when(t.rlike(variant.UUID), t) for t in text[:2]]
        return df.where((variant.kind(v) == "OBJECT") & F.coalesce(*there).isNotNull()).select("id", ids[0].alias("evidence_id"), ids[1].alias("source_id"), text[2].alias("source_uri"))

    found = refs(rows.withColumn("value", F.try_parse_json("body")), F.col("value"))
    for level in variant.levels(rows, "id", "body"):
        found = found.unionByName(refs(level, F.col("value")))
    return found.distinct()
