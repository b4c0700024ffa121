"""Entity resolution: trusted keys first, then names that are the same or nearly so, never ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..plans.registry import query
from ..plans.tables import table

# Schemes whose equal values mean equal entities.
TRUSTED = "CIK LEI ISIN DUNS CORP_CODE STOCK_CODE BUSINESS_NUMBER ISO_ALPHA2 ISO_ALPHA3 UN_M49 UNLOCODE WPI HS ISIC INDICATOR_CODE NATURAL_KEY".split()


def scheme(c) -> Column:
    """A key's scheme in one spelling."""
    return F.translate(F.upper(F.trim(c)), "-", "_")


def key_value(c) -> Column:
    """A key's value in one spelling; compatibility forms are folded by ``functions.text.nfkc_casefold`` beforehand where they matter."""
    return F.lower(F.trim(c))


def untrusted(keys: DataFrame) -> DataFrame:
    return keys.where(~scheme(F.col("scheme")).isin(*TRUSTED))


def _key_sets(rows: DataFrame, who: str) -> DataFrame:
    """``who`` with ``keys``, the sorted set of its keys; those with a part missing point to nothing and are left out, so a set may be empty."""
    parts = F.struct("entity_type", scheme("scheme").alias("scheme"), key_value("value").alias("value"))
    whole = F.col("entity_type").isNotNull() & F.col("scheme").isNotNull() & F.col("value").isNotNull()
    return rows.groupBy(who).agg(F.sort_array(F.collect_set(F.when(whole, parts))).alias("keys"))


def match_keys(candidates: DataFrame, registered: DataFrame) -> DataFrame:
    """For each candidate (``candidate``, ``entity_type``, ``scheme``, ``value``): ``matches``, the registered entities its keys point to, ``entity_id`` if that is one, and ``status`` NEW, MATCHED or CONFLICT.

    Candidates of the same keys are answered together, and entities of the same keys are counted together: a key that many have on both sides makes a pair for each two sets, not for each two rows.
    """
    asked = _key_sets(candidates, "candidate")
    known = _key_sets(registered.where("entity_id is not null"), "entity_id").groupBy("keys").agg(F.count("*").alias("n"), F.min("entity_id").alias("entity_id"))
    pairs = asked.select(F.col("keys").alias("asked")).distinct().select("asked", F.explode("asked").alias("key")).join(known.select("n", "entity_id", F.explode("keys").alias("key")), "key")
    hits = pairs.select("asked", "n", "entity_id").distinct().groupBy("asked").agg(F.sum("n").alias("matches"), F.min("entity_id").alias("entity_id"))
    g = asked.join(hits, F.col("keys") == F.col("asked"), "left").select("candidate", F.coalesce("matches", F.lit(0)).cast("long").alias("matches"), "entity_id")
    return g.select("candidate", "matches", F.when(F.col("matches") == 1, F.col("entity_id")).alias("entity_id"), F.when(F.col("matches") == 0, "NEW").when(F.col("matches") == 1, "MATCHED").otherwise("CONFLICT").alias("status"))


def _keys(name: str, least: float, registered: bool) -> Column:
    """Keys that names within the similarity share. A registered name of length n is cut into one more piece than the edits that its length allows, so
    one piece is whole in the other name, shifted by no more than the edits: the other name has a key for every such length, piece and shift."""
    lengths = f"array(length({name}))" if registered else f"sequence(cast(ceil({least}D * length({name})) as int), cast(floor(length({name}) / {least}D) as int))"
    edits = f"cast(floor((1 - {least}D) * floor(n / {least}D) + 1e-9D) as int)"
    start, stop = (f"cast({i} * n div ({edits} + 1) as int)" for i in ("i", "(i + 1)"))
    shifts = "array(0)" if registered else f"filter(sequence(-{edits}, {edits}), d -> {start} + d >= 0)"
    piece = f"named_struct('n', n, 'i', i, 'piece', substring({name}, {start} + 1 + d, {stop} - {start}))"
    return F.expr(f"array_distinct(flatten(flatten(transform({lengths}, n -> transform(sequence(0, {edits}), i -> transform({shifts}, d -> {piece}))))))")


def match_names(candidates: DataFrame, registered: DataFrame, least: float = 0.96) -> DataFrame:
    """Candidates (``candidate``, ``entity_type``, ``name``) whose name is that of one registered entity, or nearly that of just one: ``candidate``, ``entity_id``, ``score``.

    Nearly equal names are met by keys that no such pair can miss (see ``_keys``), then compared. Names under three letters are skipped. Each different name is met once, with the least and the
    greatest entity that has it: these are equal where there is one entity, so copies make no pairs.
    """
    c = candidates.select("candidate", "entity_type", fn.company_name(fn.nfkc("name")).alias("a")).where(F.length("a") >= 3)
    r = registered.select("entity_id", "entity_type", fn.company_name(fn.nfkc("name")).alias("b")).where(F.length("b") >= 3)
    names = r.groupBy("entity_type", "b").agg(F.min("entity_id").alias("lo"), F.max("entity_id").alias("hi"))
    left = c.select("entity_type", "a").distinct().withColumn("key", F.explode(_keys("a", least, False)))
    pairs = left.join(names.withColumn("key", F.explode(_keys("b", least, True))), ["entity_type", "key"]).select("entity_type", "a", "b", "lo", "hi").distinct()
    scored = pairs.withColumn("score", fn.similarity(F.col("a"), F.col("b"))).where(F.col("score") >= least)
    same = F.col("score") == 1
    every = [F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("score").alias("score")]
    by_name = scored.groupBy("entity_type", "a").agg(F.min(F.when(same, F.col("lo"))).alias("same_lo"), F.max(F.when(same, F.col("hi"))).alias("same_hi"), *every)
    g = c.join(by_name, ["entity_type", "a"]).groupBy("candidate").agg(F.min("same_lo").alias("same_lo"), F.max("same_hi").alias("same_hi"), *every)
    return g.where("same_lo = same_hi or (same_lo is null and lo = hi)").select("candidate", F.coalesce("same_lo", "lo").alias("entity_id"), "score")


@query("""WITH k AS (SELECT 'supplier:' || s_suppkey AS entity, 'NATURAL_KEY' AS scheme, lower(trim(s_name)) AS value FROM supplier UNION ALL SELECT 'supplier:' || s_suppkey, 'STOCK_CODE', CAST(s_suppkey % 60 AS VARCHAR) FROM supplier UNION ALL SELECT 'customer:' || c_custkey, 'NATURAL_KEY', lower(trim(c_name)) FROM customer),
g AS (SELECT scheme, value, count(DISTINCT entity) AS owners, min(entity) AS owner FROM k GROUP BY ALL) SELECT scheme, value, owner, owners, owners > 1 AS conflict FROM g""")
def resolve_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key with its owner, and the keys that several entities claim."""
    s, c = table(spark, sf_dir, "supplier", "s_suppkey", "s_name"), table(spark, sf_dir, "customer", "c_custkey", "c_name")
    sup = F.concat(F.lit("supplier:"), "s_suppkey").alias("entity")
    k = s.select(sup, F.lit("natural-key").alias("scheme"), F.col("s_name").alias("value")).union(s.select(sup, F.lit("stock-code"), (F.col("s_suppkey") % 60).cast("string"))).union(c.select(F.concat(F.lit("customer:"), "c_custkey"), F.lit("NATURAL_KEY"), "c_name"))
    owned = k.select("entity", scheme("scheme").alias("scheme"), key_value("value").alias("value")).distinct().groupBy("scheme", "value").agg(F.count("*").alias("owners"), F.min("entity").alias("owner"))
    return owned.select("scheme", "value", "owner", "owners", (F.col("owners") > 1).alias("conflict"))
