"""Connected components, and the resolution of records that are linked through trusted keys in several steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.storage import dropped, written
from ..plans.tables import table
from .resolve import TRUSTED, key_value, match_keys, scheme


def connected(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (the smallest node that it reaches) for each end of the undirected links ``a``, ``b``.

    Every node has a label, at first the smallest of its neighbourhood. In a round a node is offered its neighbours' labels; the least offer goes to the node
    and to the node that its label names, so whole trees are joined at a time; then each label becomes its label's label, which halves chains. Offers
    are minima, which combine before the shuffle, so a hub is no hot group. Each round is a table in the shared folder; the round before is deleted.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    both = written(both, "neighbours")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    mark = lambda df: df.agg(F.sum(F.xxhash64("node", "label").cast("decimal(38,0)"))).first()[0]
    seen = mark(labels)
    for _ in range(rounds):
        offers = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("offer")), "b").groupBy(F.col("a").alias("node")).agg(F.min("offer").alias("offer"))
        held = labels.join(offers, "node")
        hooked = held.where("offer < label").select(F.col("label").alias("node"), F.col("offer").alias("label"))
        least = held.select("node", F.least("label", "offer").alias("label")).union(hooked).groupBy("node").agg(F.min("label").alias("label"))
        least = written(least, "labels")
        up = least.select(F.col("node").alias("label"), F.col("label").alias("top"))
        after = written(least.join(up, "label").select("node", F.col("top").alias("label")), "labels")
        dropped(least)
        dropped(labels)
        labels, before, seen = after, seen, mark(after)
        if seen == before:
            return labels.select("node", F.col("label").alias("component"))
    raise RuntimeError(f"components did not settle within {rounds} rounds")


def resolve_records(candidates: DataFrame, registered: DataFrame) -> DataFrame:
    """``candidate``, ``status``, ``entity_id``, ``leader``, ``claims`` of candidates with keys (``candidate``, ``entity_type``, ``scheme``, ``value``) against registered keys (``entity_type``, ``scheme``, ``value``, ``entity_id``).

    A candidate with a key of an untrusted scheme is UNTRUSTED and links nothing; one whose own keys belong to several entities is REFUSED and links
    nothing. Of the others, those that share a key, or have one of the same entity, are one thing, in any number of steps: MATCHED with the one registered
    entity among them, NEW (named by ``leader``, the smallest candidate) if there is none, and in CONFLICT, all of them, if there are several. ``claims`` counts the entities. So
    the outcome does not depend on the order in which records arrive.
    """
    shape = [scheme("scheme").alias("scheme"), key_value("value").alias("value")]
    keyed = written(candidates.select("candidate", "entity_type", *shape).where("candidate is not null and value is not null").distinct(), "keyed")
    owned = registered.select("entity_type", *shape, "entity_id")
    foreign = keyed.groupBy("candidate").agg(F.max((~F.coalesce(F.col("scheme").isin(*TRUSTED), F.lit(False))).cast("int")).alias("foreign")).where("foreign = 1").select("candidate", F.lit("UNTRUSTED").alias("status"), F.lit(0).cast("long").alias("claims"))
    able = keyed.join(foreign.select("candidate"), "candidate", "left_anti")
    refused = match_keys(able, owned).where("matches > 1").select("candidate", F.lit("REFUSED").alias("status"), F.col("matches").alias("claims"))
    out = written(foreign.unionByName(refused), "refused")
    live = keyed.join(out.select("candidate"), "candidate", "left_anti")
    known = owned.join(live.select("entity_type", "scheme", "value").distinct(), ["entity_type", "scheme", "value"], "left_semi")
    key = F.concat_ws("|", F.lit("k"), "entity_type", "scheme", "value")
    links = live.select(F.concat(F.lit("c|"), F.col("candidate").cast("string")).alias("a"), key.alias("b")).union(known.select(F.concat(F.lit("e|"), "entity_id"), key))
    found = connected(links)
    name = F.substr("node", F.lit(3))
    ends = found.where("node like 'e|%'").groupBy("component").agg(F.count("*").alias("claims"), F.min(name).alias("entity_id"))
    mine = live.select("candidate").distinct().withColumn("node", F.concat(F.lit("c|"), F.col("candidate").cast("string"))).join(found, "node")
    first = mine.groupBy("component").agg(F.min("candidate").alias("leader"))
    n = F.coalesce("claims", F.lit(0).cast("long"))
    met = mine.join(first, "component").join(ends, "component", "left")
    settled = met.select("candidate", F.when(n == 0, "NEW").when(n == 1, "MATCHED").otherwise("CONFLICT").alias("status"), F.when(n == 1, F.col("entity_id")).alias("entity_id"), F.when(n == 0, F.col("leader")).alias("leader"), n.alias("claims"))
    return settled.unionByName(out, allowMissingColumns=True)


_CANDIDATES = """c AS (SELECT c_custkey AS k, (c_custkey - 1) // 12 AS b, (c_custkey - 1) % 12 AS i FROM customer),
k AS (SELECT k AS candidate, 'LEI' AS scheme, 'l' || b || '-' || i // 3 AS value FROM c UNION ALL SELECT k, 'DUNS', 'd' || b || '-' || (i + 1) // 3 FROM c WHERE i % 4 <> 3
  UNION ALL SELECT k, 'CORP_CODE', 'c' || b FROM c WHERE i = 5 AND b % 2 = 0 OR i = 2 AND b % 10 = 4 UNION ALL SELECT k, 'STOCK_CODE', 's' || (b + 1) FROM c WHERE i = 9 AND b % 6 = 0 OR i = 2 AND b % 10 = 4),
r AS (SELECT 'supplier:' || s_suppkey AS entity, 'CORP_CODE' AS scheme, 'c' || s_suppkey AS value FROM supplier UNION ALL SELECT 'supplier:' || s_suppkey, 'STOCK_CODE', 's' || s_suppkey FROM supplier),
d AS (SELECT candidate, count(DISTINCT entity) AS n FROM k JOIN r ON k.scheme = r.scheme AND k.value = r.value GROUP BY candidate),
refused AS (SELECT candidate, n FROM d WHERE n > 1 AND candidate % 29 <> 0),
live AS (SELECT * FROM k WHERE candidate % 29 <> 0 AND candidate NOT IN (SELECT candidate FROM refused)),
owned AS (SELECT live.candidate AS candidate, entity FROM live JOIN r ON live.scheme = r.scheme AND live.value = r.value),
step AS (SELECT x.candidate AS a, y.candidate AS b FROM live x JOIN live y ON x.scheme = y.scheme AND x.value = y.value UNION SELECT x.candidate, y.candidate FROM owned x JOIN owned y ON x.entity = y.entity),
reach AS (SELECT DISTINCT candidate AS root, candidate AS node FROM live UNION SELECT root, b FROM reach JOIN step ON a = node)"""


@query("WITH RECURSIVE " + _CANDIDATES + """, met AS (SELECT root, min(node) AS leader, count(DISTINCT entity) AS claims, min(entity) AS entity FROM reach LEFT JOIN owned ON owned.candidate = node GROUP BY root)
SELECT root AS candidate, CASE WHEN claims = 0 THEN 'NEW' WHEN claims = 1 THEN 'MATCHED' ELSE 'CONFLICT' END AS status, CASE WHEN claims = 1 THEN entity END AS entity_id, CASE WHEN claims = 0 THEN leader END AS leader, claims FROM met
UNION ALL SELECT candidate, 'REFUSED', NULL, NULL, n FROM refused UNION ALL SELECT c_custkey, 'UNTRUSTED', NULL, NULL, 0 FROM customer WHERE c_custkey % 29 = 0""")
def resolve_transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a candidate whose keys link it to others, several steps away, and to suppliers, the registered entities."""
    k = F.col("c_custkey")
    b, i = F.expr("(c_custkey - 1) div 12"), (k - 1) % 12
    both = (i == 2) & (b % 10 == 4)
    given = [
        (F.lit(" lei"), F.concat(F.lit(" L"), b, F.lit("-"), F.floor(i / 3)), F.lit(True)), (F.lit("Duns "), F.concat(F.lit("d"), b, F.lit("-"), F.floor((i + 1) / 3)), i % 4 != 3),
        (F.lit("corp-code"), F.concat(F.lit("C"), b), ((i == 5) & (b % 2 == 0)) | both), (F.lit("STOCK_CODE"), F.concat(F.lit("s"), b + 1), ((i == 9) & (b % 6 == 0)) | both), (F.lit("EMAIL"), F.lit("a@example.com"), k % 29 == 0),
    ]
    keys = F.filter(F.array(*(F.when(when, F.struct(s.alias("scheme"), v.alias("value"))) for s, v, when in given)), lambda x: x.isNotNull())
    candidates = table(spark, sf_dir, "customer", "c_custkey").select(k.alias("candidate"), F.lit("COMPANY").alias("entity_type"), F.explode(keys).alias("key")).select("candidate", "entity_type", "key.*")
    s = F.col("s_suppkey")
    own = F.array(*(F.struct(F.lit(n).alias("scheme"), F.concat(F.lit(p), s).alias("value")) for n, p in (("CORP_CODE", "c"), ("STOCK_CODE", "s"))))
    registered = table(spark, sf_dir, "supplier", "s_suppkey").select(F.concat(F.lit("supplier:"), s).alias("entity_id"), F.lit("COMPANY").alias("entity_type"), F.explode(own).alias("key")).select("entity_id", "entity_type", "key.*")
    return resolve_records(candidates, registered)
