"""Simulation: shocks that spread over dependency edges across parallel branches, and the row-wise parts of a supply-chain turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.storage import written
from ..plans.tables import DEPENDENCY, TRADE, dependency, pair_flows, table, trade
from .graph import top_edges

# Edge types that pass a change on, and whether observed alternative supply softens it.
RULES = {"TRADE_FLOW": True, "SUPPLIES": True, "DEPENDS_ON": False, "PRODUCES": False, "SHIPS_VIA": False}


def active_by_turn(shocks: DataFrame, turns: int) -> DataFrame:
    """Shocks at each of their turns: ``turn`` in ``[turn, turn + duration)``, up to ``turns``."""
    last = F.least(F.col("turn") + F.col("duration") - 1, F.lit(turns))
    return shocks.where(F.col("turn") <= turns).withColumn("at", F.explode(F.sequence(F.col("turn"), last))).drop("turn").withColumnRenamed("at", "turn").drop("duration")


@query("""WITH s AS (SELECT s_suppkey AS entity, CAST(1 + s_suppkey % 6 AS INTEGER) AS t, CAST(1 + s_suppkey % 4 AS INTEGER) AS d, round(-0.1::DOUBLE - (s_suppkey % 5) / 20.0::DOUBLE, 6) AS change FROM supplier)
SELECT entity, CAST(turn AS INTEGER) AS turn, change FROM (SELECT entity, unnest(generate_series(t, least(t + d - 1, 6))) AS turn, change FROM s)""")
def active_shocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shocks by the turns they last."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier", "s_suppkey").select(k.alias("entity"), (1 + k % 6).cast("int").alias("turn"), (1 + k % 4).cast("int").alias("duration"), F.round(F.lit(-0.1) - (k % 5) / F.lit(20.0), 6).alias("change"))
    return active_by_turn(s, 6).select("entity", "turn", "change")


def alternatives(edges: DataFrame) -> DataFrame:
    """``rel`` and ``alternative``: of each edge what its destination's other suppliers give, at most 1: the destination's total less its own source's edges."""
    into = edges.groupBy("dst").agg(F.sum("ratio").alias("all"))
    own = edges.groupBy("dst", "src").agg(F.sum("ratio").alias("own"))
    return edges.join(into, "dst").join(own, ["dst", "src"]).select("rel", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("all") - F.col("own"))), 6).alias("alternative"))


@query(TRADE + DEPENDENCY + """, a AS (SELECT e.rel AS rel, sum(o.ratio) AS other FROM edges e JOIN edges o ON o.dst = e.dst AND o.src <> e.src GROUP BY e.rel) SELECT edges.rel AS rel, round(least(1.0::DOUBLE, coalesce(other, 0)), 6) AS alternative FROM edges LEFT JOIN a ON a.rel = edges.rel""")
def alternative_supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed alternative supply of every edge: two aggregations in place of a self-join."""
    return alternatives(dependency(_pairs(spark, sf_dir)))


def propagate(edges: DataFrame, shocks: DataFrame, depth: int) -> DataFrame:
    """The trace of shocks: ``branch``, ``turn``, ``depth``, ``path``, ``rel``, ``type``, ``src``, ``dst``, ``metric``, ``input``, ``propagated``.

    ``edges``: ``rel``, ``src``, ``dst``, ``ratio``, and if wanted ``type`` (types without a rule pass nothing on) and ``alternative`` (taken where
    ``mitigates``); ``shocks``: ``branch``, ``turn``, ``src``, ``metric``, ``change``, ``mitigates``, and ``ord``, their order (theirs by ``src`` if absent).
    Shocks are taken in their order, edges breadth first and by their ids; each fires once for a branch, turn and metric, on the first path
    that reaches it, and passes on the change as it received it times its share. A level is one join and one aggregation, written before the
    next begins; a path, which begins with its shock's place, carries the order, so nothing is ranked globally.
    """
    kind = F.col("type") if "type" in edges.columns else F.lit("TRADE_FLOW")
    other = F.col("alternative") if "alternative" in edges.columns else F.lit(0.0)
    e = edges.select("rel", F.col("src"), F.col("dst"), F.col("ratio"), kind.alias("type"), other.alias("alternative")).where(F.col("type").isin(list(RULES)))
    key = ["branch", "turn", "metric"]
    place = F.format_string("%010d", F.col("ord")) if "ord" in shocks.columns else F.col("src").cast("string")
    frontier = shocks.select(*key, "mitigates", "src", "change", F.array(place).alias("path"))
    fired = trace = None
    for level in range(1, depth + 1):
        share = F.col("ratio") * F.when(F.col("mitigates") & F.col("type").isin([k for k, soft in RULES.items() if soft]), 1 - F.col("alternative")).otherwise(1.0)
        step = frontier.join(e, "src")
        if fired is not None:
            step = step.join(fired, [*key, "rel"], "left_anti")
        step = step.withColumn("path", F.concat("path", F.array("rel"))).withColumn("propagated", F.col("change") * share)
        first = step.groupBy(*key, "rel").agg(F.min(F.struct("path", "type", "src", "dst", F.col("change").alias("input"), "propagated", "mitigates")).alias("f"))
        rows = first.select(*key, "rel", F.lit(level).alias("depth"), "f.*")
        rows = written(rows, "level") if level < depth else rows
        trace = rows if trace is None else trace.unionByName(rows)
        done = rows.select(*key, "rel")
        fired = done if fired is None else fired.unionByName(done)
        frontier = rows.select(*key, "mitigates", F.col("dst").alias("src"), F.col("propagated").alias("change"), "path")
    return trace.drop("mitigates")


def changes(trace: DataFrame, shocks: DataFrame) -> DataFrame:
    """``branch``, ``turn``, ``entity``, ``metric``, ``change``: a shocked entity's own change (its last shock's), then what reaches it in order, held between -1 and 1 at every step. An entity's steps of a
    turn are folded in one row: as many as edges lead to it, as each fires once."""
    key = ["branch", "turn", "entity", "metric"]
    got = trace.groupBy("branch", "turn", F.col("dst").alias("entity"), "metric").agg(F.sort_array(F.collect_list(F.struct("depth", "path", "propagated"))).alias("steps"))
    own = shocks.groupBy("branch", "turn", F.col("src").alias("entity"), "metric").agg(F.max_by("change", "ord").alias("own") if "ord" in shocks.columns else F.max("change").alias("own"))
    both = got.join(own, key, "full")
    held = F.aggregate(F.coalesce("steps", F.array().cast("array<struct<depth:int,path:array<string>,propagated:double>>")), F.coalesce("own", F.lit(0.0)), lambda a, x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), a + x["propagated"])))
    return both.select(*key, held.alias("change"))


def states(nodes: DataFrame, changed: DataFrame, turns: int) -> DataFrame:
    """``branch``, ``turn``, ``entity``, ``metric``, ``value``: the baseline (``entity``, ``metric``, ``value``) times 1 + change, from each turn that changes it on: a metric keeps its last shocked value when the shock is over.
    Every node stands in every branch, so rows grow with nodes times branches, which the model has, and times ``turns``."""
    from pyspark.sql.window import Window

    branches = changed.select("branch").distinct()
    grid = nodes.join(branches).withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(turns))))
    w = Window.partitionBy("branch", "entity", "metric").orderBy("turn")  # at most ``turns`` rows
    j = grid.join(changed, ["branch", "turn", "entity", "metric"], "left")
    last = F.last("change", ignorenulls=True).over(w)
    return j.select("branch", "turn", "entity", "metric", F.when(last.isNull(), F.col("value")).otherwise(F.greatest(F.lit(0.0), F.col("value") * (1 + last))).alias("value"), F.col("change").isNotNull().alias("affected"))


def missing_metrics(changed: DataFrame, nodes: DataFrame) -> DataFrame:
    """Changes of metrics that their entity does not have."""
    return changed.join(nodes.select("entity", "metric"), ["entity", "metric"], "left_anti")


def totals(state: DataFrame, changed: DataFrame) -> DataFrame:
    """Sums of supply and demand, and the entities' metrics affected, by branch and turn."""
    of = lambda m: F.round(F.sum(F.when(F.col("metric") == m, F.col("value")).otherwise(0.0)), 6)
    hit = changed.groupBy("branch", "turn").agg(F.count("*").alias("affected"))
    return state.groupBy("branch", "turn").agg(of("SUPPLY").alias("supply"), of("DEMAND").alias("demand")).join(hit, ["branch", "turn"], "left").na.fill(0, ["affected"])


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of pairs of countries, computed once: all levels and branches work on this small table."""
    return written(pair_flows(trade(spark, sf_dir)), "pairs")


def _edges(pairs: DataFrame) -> DataFrame:
    return written(top_edges(dependency(pairs), 3), "edges")


def _shocks(spark: SparkSession, branches: str = "(1, false)", turn: int = 1) -> DataFrame:
    """Two shocks, which compete for edges."""
    return spark.sql(f"SELECT branch, {turn} AS turn, ord, src, 'SUPPLY' AS metric, change, mitigates FROM VALUES {branches} AS t(branch, mitigates), VALUES (0, 9, -0.3D), (1, 3, -0.2D) AS s(ord, src, change)")


_SHOCKS = "s(ord, src, change) AS (VALUES (0, 9, -0.3::DOUBLE), (1, 3, -0.2::DOUBLE))"
_LEVEL = """a{n} AS (SELECT * FROM (SELECT {n} AS depth, list_append(f.path, t.rel) AS path, t.rel AS rel, t.src AS src, t.dst AS dst, f.p AS p0, f.p * t.ratio AS p, row_number() OVER (PARTITION BY t.rel ORDER BY list_append(f.path, t.rel)) AS rn FROM a{m} f JOIN top t ON t.src = f.dst WHERE t.rel NOT IN (SELECT rel FROM done{m})) WHERE rn = 1), done{n} AS (SELECT rel FROM done{m} UNION ALL SELECT rel FROM a{n})"""
_TOP = TRADE + DEPENDENCY + f""", top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY cents DESC, rel) AS rn FROM edges) WHERE rn <= 3), {_SHOCKS},
a1 AS (SELECT 1 AS depth, [printf('%010d', ord), rel] AS path, rel, top.src AS src, dst, change AS p0, change * ratio AS p FROM top JOIN s ON s.src = top.src), done1 AS (SELECT rel FROM a1),
{_LEVEL.format(n=2, m=1)}, {_LEVEL.format(n=3, m=2)},
trace AS (SELECT depth, rel, src, dst, p0, p FROM a1 UNION ALL SELECT depth, rel, src, dst, p0, p FROM a2 UNION ALL SELECT depth, rel, src, dst, p0, p FROM a3)"""


@query(_TOP + " SELECT rel, src, dst, round(p, 9) AS propagated FROM a1")
def propagate_depth1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges that two shocks reach at once."""
    return propagate(_edges(_pairs(spark, sf_dir)), _shocks(spark), 1).select("rel", "src", "dst", F.round("propagated", 9).alias("propagated"))


@query(_TOP + " SELECT depth, rel, src, dst, round(p0, 9) AS input, round(p, 9) AS propagated FROM trace")
def propagate_depth3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace of two shocks over three levels; an edge that both reach fires for the first."""
    return propagate(_edges(_pairs(spark, sf_dir)), _shocks(spark), 3).select("depth", "rel", "src", "dst", F.round("input", 9).alias("input"), F.round("propagated", 9).alias("propagated"))


@query(_TOP.replace("WHERE rn <= 3", "") + " SELECT depth, rel, src, dst, round(p0, 9) AS input, round(p, 9) AS propagated FROM trace")
def propagate_all_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trace of two shocks over three levels along all edges, however small."""
    trace = propagate(written(dependency(_pairs(spark, sf_dir)), "edges"), _shocks(spark), 3)
    return trace.select("depth", "rel", "src", "dst", F.round("input", 9).alias("input"), F.round("propagated", 9).alias("propagated"))


@query(TRADE + DEPENDENCY + f""", top0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY cents DESC, rel) AS rn FROM edges) WHERE rn <= 3), {_SHOCKS}, b(branch, m) AS (VALUES (1, 0), (2, 0), (3, 1)),
alt AS (SELECT e.rel AS rel, round(least(1.0::DOUBLE, coalesce(sum(o.ratio), 0)), 6) AS alternative FROM top0 e LEFT JOIN top0 o ON o.dst = e.dst AND o.src <> e.src GROUP BY e.rel),
top AS (SELECT branch, top0.rel AS rel, src, dst, ratio * CASE WHEN m = 1 THEN 1 - alternative ELSE 1 END AS share FROM top0 JOIN alt ON alt.rel = top0.rel, b),
c1 AS (SELECT branch, [printf('%010d', ord), rel] AS path, rel, dst, change * share AS p FROM top JOIN s ON s.src = top.src),
c2 AS (SELECT * FROM (SELECT t.branch AS branch, t.rel AS rel, t.dst AS dst, c1.p * t.share AS p, row_number() OVER (PARTITION BY t.branch, t.rel ORDER BY list_append(c1.path, t.rel)) AS rn FROM c1 JOIN top t ON t.src = c1.dst AND t.branch = c1.branch WHERE t.rel NOT IN (SELECT rel FROM c1)) WHERE rn = 1)
SELECT branch, dst AS entity, round(sum(p), 6) AS change FROM (SELECT branch, dst, p FROM c1 UNION ALL SELECT branch, dst, p FROM c2 UNION ALL SELECT branch, src, change FROM s, b) GROUP BY branch, dst""")
def branch_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two shocks in three branches: as it is, with a recorded policy, and with observed alternative supply."""
    e = _edges(_pairs(spark, sf_dir))
    e = e.join(alternatives(e), "rel")
    s = _shocks(spark, "(1, false), (2, false), (3, true)")
    return changes(propagate(e, s, 2), s).select("branch", "entity", F.round("change", 6).alias("change"))


_TOTALS = _TOP + """, ch AS (SELECT entity, sum(p) AS change FROM (SELECT dst AS entity, p FROM a1 UNION ALL SELECT dst, p FROM a2 UNION ALL SELECT src, change FROM s) GROUP BY entity), base AS (SELECT src AS entity, 'SUPPLY' AS metric, sum(cents) / 100.0::DOUBLE AS v FROM pairs GROUP BY src UNION ALL SELECT dst, 'DEMAND', sum(cents) / 100.0::DOUBLE FROM pairs GROUP BY dst),
st AS (SELECT turn, metric, CASE WHEN metric = 'SUPPLY' AND turn >= 2 AND change IS NOT NULL THEN greatest(0, v * (1 + change)) ELSE v END AS v FROM base CROSS JOIN (SELECT unnest([1, 2, 3]) AS turn) LEFT JOIN ch ON ch.entity = base.entity)
SELECT turn, round(sum(CASE WHEN metric = 'SUPPLY' THEN v ELSE 0 END), 0) AS supply, round(sum(CASE WHEN metric = 'DEMAND' THEN v ELSE 0 END), 0) AS demand, CASE WHEN turn = 2 THEN (SELECT count(*) FROM ch) ELSE 0 END AS affected FROM st GROUP BY turn"""


@query(_TOTALS)
def turn_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of three turns, the second of them shocked; what was shocked stays so."""
    pairs = _pairs(spark, sf_dir)
    s = _shocks(spark, turn=2)
    ch = written(changes(propagate(_edges(pairs), s, 2), s), "changes")
    side = lambda c, m: pairs.groupBy(F.col(c).alias("entity")).agg((F.sum("cents") / F.lit(100.0)).alias("value")).withColumn("metric", F.lit(m))
    nodes = side("src", "SUPPLY").unionByName(side("dst", "DEMAND"))
    return totals(states(nodes, ch, 3), ch).select("turn", F.round("supply", 0).alias("supply"), F.round("demand", 0).alias("demand"), "affected")


def modifier(seed, turn, entity) -> Column:
    """A number in 0.995 to 1.005 that seed, turn and entity give: the first eight bytes of a hash."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", seed, turn, entity), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    return F.lit(0.995) + h / F.lit(18446744073709551615.0) * F.lit(0.01)


@query("SELECT s_suppkey AS company, turn, round(0.995::DOUBLE + CAST(('0x' || substr(sha256('42:' || turn || ':' || s_suppkey), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551615.0::DOUBLE * 0.01::DOUBLE, 9) AS modifier FROM supplier, (VALUES (1), (2), (3)) t(turn)")
def seeded_modifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every company's modifier in three turns."""
    s = table(spark, sf_dir, "supplier", "s_suppkey").withColumn("turn", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return s.select(F.col("s_suppkey").alias("company"), "turn", F.round(modifier(F.lit("42"), F.col("turn"), F.col("s_suppkey")), 9).alias("modifier"))


def combined_shocks(shocks: DataFrame) -> DataFrame:
    """The product of each multiplier over a company's shocks of a turn."""
    return shocks.groupBy("turn", "company").agg(*(F.product(c).alias(c) for c in ("supply", "demand", "capacity", "price")))


@query("""WITH c AS (SELECT s_suppkey AS company, 100 + s_suppkey % 50 AS base, 120 + s_suppkey % 40 AS capacity, 90 + s_suppkey % 70 AS demand, 10 + s_suppkey % 7 AS price, 6 + s_suppkey % 3 AS cost, 20 AS workforce, CASE WHEN s_suppkey % 5 = 0 THEN 0.5::DOUBLE ELSE 1 END AS shock FROM supplier),
m AS (SELECT *, 0.995::DOUBLE + CAST(('0x' || substr(sha256('42:1:' || company), 1, 16))::UBIGINT AS DOUBLE) / 18446744073709551615.0::DOUBLE * 0.01::DOUBLE AS modifier FROM c),
p AS (SELECT *, round(least(base * shock * modifier, capacity::DOUBLE, demand::DOUBLE), 6) AS production FROM m), s AS (SELECT *, least(demand::DOUBLE, production) AS sales FROM p)
SELECT company, round(production, 4) AS production, round(sales, 4) AS sales, round(sales * price, 3) AS revenue, round(sales * price - production * cost - workforce * 10, 3) AS profit, round(demand * (0.85::DOUBLE + 0.15::DOUBLE * sales / demand), 4) AS next_demand FROM s""")
def industrial_turn1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn of companies without input links: columns alone."""
    k = F.col("s_suppkey")
    c = table(spark, sf_dir, "supplier", "s_suppkey").select(k.alias("company"), (100 + k % 50).alias("base"), (120 + k % 40).alias("capacity"), (90 + k % 70).alias("demand"), (10 + k % 7).alias("price"), (6 + k % 3).alias("cost"), F.lit(20).alias("workforce"), F.when(k % 5 == 0, 0.5).otherwise(1.0).alias("shock"))
    p = c.withColumn("production", F.round(F.least(F.col("base") * F.col("shock") * modifier(F.lit("42"), F.lit("1"), F.col("company")), F.col("capacity").cast("double"), F.col("demand").cast("double")), 6)).withColumn("sales", F.least(F.col("demand").cast("double"), F.col("production")))
    return p.select(
        "company", F.round("production", 4).alias("production"), F.round("sales", 4).alias("sales"), F.round(F.col("sales") * F.col("price"), 3).alias("revenue"),
        F.round(F.col("sales") * F.col("price") - F.col("production") * F.col("cost") - F.col("workforce") * 10, 3).alias("profit"), F.round(F.col("demand") * (0.85 + 0.15 * F.col("sales") / F.col("demand")), 4).alias("next_demand"),
    )
