"""Search of nodes by names and texts through trigrams: a search meets the names that share a rare trigram with it, not every name."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as fn
from ..plans.registry import query
from ..plans.storage import written
from ..plans.tables import table
from .graph import search_tokens

# The least share of a name's trigrams that a search must have, and what the kinds of match count.
NEAR, SAME, INSIDE, SIMILAR, WORDS = 0.6, 100.0, 80.0, 50.0, 20.0


def words(c) -> Column:
    """The runs between white space."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_grams(ws) -> Column:
    """The different trigrams of words, each with two spaces before and one behind."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(ws, one)))


def pieces(c, size: int) -> Column:
    """The different runs of ``size`` characters of a text."""
    last = F.length(c) - size + 1
    return F.when(last < 1, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(c, i, F.lit(size)))))


def near_share(name_words, name_grams, search_words) -> Column:
    """The greatest share of a name's trigrams that a run of as many words of the search has."""
    n = F.size(name_words)
    last = F.greatest(F.size(search_words) - n, F.lit(0))
    shares = F.transform(F.sequence(F.lit(0), last), lambda i: F.size(F.array_intersect(name_grams, word_grams(F.slice(search_words, i + 1, n)))) / F.size(name_grams))
    return F.array_max(shares)


def name_index(names: DataFrame, least: float = NEAR) -> DataFrame:
    """``key``, ``name``: under which keys a name (lower-cased, each once) is found.

    A search that has the share ``least`` of a name's g trigrams lacks g - ceil(least * g) of them at most, so it has one of any g - ceil(least * g) + 1: the name is
    kept under its rarest ones, ties by their letters. A search that holds the name has each of its runs of three characters: it is kept under the rarest of these, or as
    a whole where it is shorter.
    """
    given = names.select("name", word_grams(words(F.col("name"))).alias("grams"), pieces(F.col("name"), 3).alias("runs"))
    kinds = F.concat(F.transform("grams", lambda g: F.concat(F.lit("w"), g)), F.transform("runs", lambda g: F.concat(F.lit("r"), g)))
    each = written(given.select("name", F.size("grams").alias("g"), F.explode(kinds).alias("key")), "name-grams")
    common = each.groupBy("key").agg(F.count("*").alias("n"))
    listed = each.join(common, "key").groupBy("name", "g").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"))  # the trigrams of one name
    of = lambda kind: F.transform(F.filter("keys", lambda k: F.startswith(k["key"], F.lit(kind))), lambda k: k["key"])
    spare = F.col("g") - F.ceil(F.col("g") * least - 1e-9) + 1
    kept = listed.select("name", F.concat(F.slice(of("w"), F.lit(1), spare.cast("int")), F.slice(of("r"), 1, 1)).alias("keys"))
    short = names.where(F.length("name") < 3).select(F.concat(F.lit("s"), "name").alias("key"), "name")
    return kept.select(F.explode("keys").alias("key"), "name").unionByName(short)


def near_names(names: DataFrame, searches: DataFrame, least: float = NEAR) -> DataFrame:
    """``search``, ``name``, ``score`` of names (``name``) and searches (``search``), lower-cased, each once: a name that is the search 100, one that stands in it 80, and 50 times the share of its trigrams in
    a run of as many words of the search, from ``least`` on; the best of these. Exact: no pair that scores is missed."""
    s = F.col("search")
    keys = F.concat(F.transform(word_grams(words(s)), lambda g: F.concat(F.lit("w"), g)), F.transform(pieces(s, 3), lambda g: F.concat(F.lit("r"), g)), F.transform(F.concat(pieces(s, 1), pieces(s, 2)), lambda g: F.concat(F.lit("s"), g)))
    met = searches.select("search", F.explode(F.array_distinct(keys)).alias("key")).join(name_index(names, least), "key").select("search", "name").distinct()
    share = near_share(words(F.col("name")), word_grams(words(F.col("name"))), words(s))
    score = F.greatest(F.when(F.col("name") == s, SAME), F.when(F.contains(s, F.col("name")), INSIDE), F.when(share >= least, SIMILAR * share))
    return met.select("search", "name", score.alias("score")).where("score is not null")


def with_all_words(texts: DataFrame, searches: DataFrame) -> DataFrame:
    """``search``, ``id``, ``score``: texts (``id``, ``text``) that have all words of a search, by their share of the text's different words. A search meets the texts that have the rarest of its words."""
    has = written(texts.select("id", F.array_distinct(fn.tokens("text")).alias("has")), "text-words")
    asked = searches.select("search", search_tokens(F.col("search")).alias("asked")).where("size(asked) > 0")
    each = asked.select("search", "asked", F.explode("asked").alias("word"))
    holders = has.select("id", F.explode("has").alias("word"))
    common = holders.join(each.select("word").distinct(), "word", "left_semi").groupBy("word").agg(F.count("*").alias("n"))
    rare = each.join(common, "word", "left").groupBy("search", "asked").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("r")).where("r.n > 0").select("search", "asked", F.col("r.word").alias("word"))
    met = holders.join(rare, "word").select("search", "asked", "id").join(has, "id").where(F.size(F.array_except("asked", "has")) == 0)
    return met.select("search", "id", (WORDS * F.size("asked") / F.size("has")).alias("score"))


def match_nodes(nodes: DataFrame, searches: DataFrame, k: int = 20) -> DataFrame:
    """``search``, ``id``, ``score``, ``rank``: the ``k`` best nodes (``id``, ``name``, a row for each name; and ``text`` if there is one) for each search (``search``), by ``near_names`` and ``with_all_words``, the best of both, ties to the smaller id.

    Names that many nodes bear are compared once; of the nodes of a name only the ``k`` first can be among the best by it.
    """
    asked = searches.select(F.lower("search").alias("search")).where("search is not null").distinct()
    named = nodes.select("id", F.lower("name").alias("name")).where(F.trim("name") != "").distinct()
    first = named.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("id"))).where(F.col("_n") <= k).drop("_n")
    found = near_names(named.select("name").distinct(), asked).join(first, "name").select("search", "id", "score")
    if "text" in nodes.columns:
        found = found.unionByName(with_all_words(nodes.select("id", "text").where("text is not null").distinct(), asked))
    best = found.groupBy("search", "id").agg(F.round(F.max("score"), 6).alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("search").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


_NODES = """n AS (SELECT 'part:' || p_partkey AS id, lower(p_name) AS name, lower(p_name || ' ' || p_brand || ' ' || p_type) AS text FROM part UNION ALL SELECT 'country:' || n_nationkey, lower(n_name), NULL FROM nation UNION ALL SELECT 'supplier:' || s_suppkey, lower(s_name), NULL FROM supplier),
s AS (SELECT DISTINCT 'find ' || lower(substr(p_name, 1, 2) || substr(p_name, 4)) || ' from nation_' || (p_partkey % 25) AS search FROM part WHERE p_partkey % 20 = 0 UNION SELECT lower(p_type || ' ' || split_part(p_name, ' ', 2)) FROM part WHERE p_partkey % 20 = 0)"""
_GRAMS = "list_distinct(flatten(list_transform({ws}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query("WITH " + _NODES + f""", d AS (SELECT DISTINCT name, regexp_split_to_array(trim(name), '\\s+') AS ws FROM n), g AS (SELECT name, len(ws) AS k, {_GRAMS.format(ws='ws')} AS grams FROM d),
sw AS (SELECT search, regexp_split_to_array(trim(search), '\\s+') AS ws FROM s), w0 AS (SELECT search, ws, k, unnest(range(0, greatest(len(ws) - k, 0) + 1)) AS i FROM sw, (SELECT DISTINCT k FROM g)), w AS (SELECT search, k, {_GRAMS.format(ws='ws[i + 1:i + k]')} AS grams FROM w0),
sh AS (SELECT search, name, max(len(list_intersect(g.grams, w.grams)) / CAST(len(g.grams) AS DOUBLE)) AS share FROM g JOIN w ON g.k = w.k GROUP BY search, name),
a AS (SELECT search, id, greatest(CASE WHEN sh.name = search THEN 100 END, CASE WHEN contains(search, sh.name) THEN 80 END, CASE WHEN share >= 0.6 THEN 50 * share END) AS score FROM sh JOIN n ON n.name = sh.name),
t AS (SELECT id, list_distinct(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) AS has FROM n WHERE text IS NOT NULL), q AS (SELECT search, list_distinct(list_filter(ws, lambda x: length(x) >= 2)) AS asked FROM sw),
b AS (SELECT search, id, 20.0 * len(asked) / len(has) AS score FROM q JOIN t ON len(list_intersect(asked, has)) = len(asked)),
m AS (SELECT search, id, round(max(score), 6) AS score FROM (SELECT * FROM a WHERE score IS NOT NULL UNION ALL SELECT * FROM b) GROUP BY search, id), r AS (SELECT *, row_number() OVER (PARTITION BY search ORDER BY score DESC, id) AS rank FROM m)
SELECT search, id, CAST(score AS DOUBLE) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20""")
def match_nodes_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best parts, countries and suppliers for searches made of every twentieth part: names with a letter missing beside a country's, and words of its kind."""
    p = table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type")
    n, s = table(spark, sf_dir, "nation", "n_nationkey", "n_name"), table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    none = F.lit(None).cast("string").alias("text")
    nodes = p.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("text"))
    nodes = nodes.unionByName(n.select(F.concat(F.lit("country:"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), none)).unionByName(s.select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), none))
    some, name = p.where("p_partkey % 20 = 0"), F.col("p_name")
    typo = F.concat(F.lit("find "), F.substring(name, 1, 2), F.expr("substring(p_name, 4)"), F.lit(" from nation_"), F.col("p_partkey") % 25)
    kind = F.concat_ws(" ", "p_type", F.split_part(name, F.lit(" "), F.lit(2)))
    return match_nodes(nodes, some.select(typo.alias("search")).union(some.select(kind)))
