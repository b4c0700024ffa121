"""Positions of terms: whole phrases, and ranking by the shortest stretches that hold all terms of a search.

A search meets the documents that hold the rarest of its terms; of common terms nothing is shuffled. Where that term stands says where a phrase would begin, and the documents' own
terms, in their order, say whether it does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..plans.registry import query
from ..plans.storage import written
from ..plans.tables import table


def postings(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``term``, ``doc_id``, ``places``: where the given terms (``term``) stand in each document, counted from 0. Only they leave the documents."""
    each = docs.select(doc_id, F.posexplode(fn.tokens("text")).alias("place", "term")).join(terms, "term", "left_semi")
    return each.groupBy("term", doc_id).agg(F.sort_array(F.collect_list("place")).alias("places"))


def rarest_terms(docs: DataFrame, searches: DataFrame, search_id: str) -> DataFrame:
    """``search_id``, ``terms`` (as they follow each other), ``term``, ``offset``: of each search (``search_id``, ``text``) the term that the fewest documents hold, ties by its letters, and where it stands first. A search
    without terms, or with one that no document has, is left out: it finds nothing."""
    asked = searches.select(search_id, fn.tokens("text").alias("terms")).where("size(terms) > 0")
    each = asked.select(search_id, "terms", F.explode(F.array_distinct("terms")).alias("term"))
    held = docs.select(F.explode(F.array_distinct(fn.tokens("text"))).alias("term")).join(each.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    rare = each.join(held, "term", "left").groupBy(search_id, "terms").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")).alias("r"))
    return rare.where("r.n > 0").select(search_id, "terms", F.col("r.term").alias("term"), (F.array_position("terms", F.col("r.term")) - 1).cast("int").alias("offset"))


def _met(docs: DataFrame, searches: DataFrame, doc_id: str, search_id: str) -> DataFrame:
    """Searches with the documents that hold their rarest term: its ``places`` there, and the document's ``tokens``."""
    rare = written(rarest_terms(docs, searches, search_id), "rarest")
    found = postings(docs, rare.select("term").distinct(), doc_id).join(rare, "term")
    return found.join(docs.select(doc_id, fn.tokens("text").alias("tokens")), doc_id)


def phrase_matches(docs: DataFrame, searches: DataFrame, doc_id: str = "doc_id", search_id: str = "item_id") -> DataFrame:
    """``search_id``, ``doc_id``, ``first``, ``matches``: the documents (``doc_id``, ``text``) that have a search's terms one after the other, where first, and how often (matches may overlap)."""
    begins = F.transform("places", lambda p: p - F.col("offset"))
    real = F.filter(begins, lambda b: (b >= 0) & (F.slice("tokens", F.greatest(b, F.lit(0)) + 1, F.size("terms")) == F.col("terms")))
    return _met(docs, searches, doc_id, search_id).withColumn("begins", real).where("size(begins) > 0").select(search_id, doc_id, F.array_min("begins").alias("first"), F.size("begins").alias("matches"))


def cover_ranks(docs: DataFrame, searches: DataFrame, doc_id: str = "doc_id", search_id: str = "item_id") -> DataFrame:
    """``search_id``, ``doc_id``, ``covers``, ``shortest``, ``score`` of the documents that hold all different terms of a search. A cover is a stretch of the document that holds them all and none shorter within it; ``score`` is the
    sum of 1 / length over the covers, to six places.

    The places of the terms are merged in their order with the last place of each term: a cover ends where the earliest of these moves on.
    """
    met = _met(docs, searches, doc_id, search_id).withColumn("asked", F.array_distinct("terms")).where(F.size(F.array_except("asked", "tokens")) == 0)
    hits = F.filter(F.transform("tokens", lambda t, i: F.struct(i.alias("at"), F.array_position("asked", t).cast("int").alias("term"))), lambda x: x["term"] > 0)
    start = F.struct(F.transform("asked", lambda _: F.lit(-1)).alias("last"), F.lit(-1).alias("begin"), F.lit(0).alias("covers"), F.lit(2147483647).alias("shortest"), F.lit(0.0).alias("score"))

    def step(acc, x):
        last = F.transform(acc["last"], lambda v, i: F.when(i == x["term"] - 1, x["at"]).otherwise(v))
        begin = F.array_min(last)
        new, length = begin > acc["begin"], x["at"] - begin + 1
        return F.struct(last.alias("last"), F.greatest(begin, acc["begin"]).alias("begin"), (acc["covers"] + new.cast("int")).alias("covers"), F.least(acc["shortest"], F.when(new, length)).alias("shortest"), (acc["score"] + F.when(new, 1.0 / length).otherwise(0.0)).alias("score"))

    return met.select(search_id, doc_id, F.aggregate(hits, start, step).alias("c")).select(search_id, doc_id, "c.covers", "c.shortest", F.round("c.score", 6).alias("score"))


_TERMS = r"""t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 1) - 1 AS place FROM documents),
s AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term, generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), 1) - 1 AS place FROM benchmark),
u AS (SELECT DISTINCT item_id, term FROM s), n AS (SELECT item_id, count(*) AS n FROM u GROUP BY item_id), dt AS (SELECT DISTINCT doc_id, term FROM t),
whole AS (SELECT u.item_id AS item_id, doc_id, any_value(n) AS n FROM u JOIN dt ON u.term = dt.term JOIN n ON n.item_id = u.item_id GROUP BY u.item_id, doc_id HAVING count(*) = any_value(n))"""


@query("WITH " + _TERMS + """, m AS (SELECT item_id, count(*) AS m FROM s GROUP BY item_id),
b AS (SELECT whole.item_id AS item_id, whole.doc_id AS doc_id, t.place - s.place AS begin, count(*) AS hits FROM whole JOIN s ON s.item_id = whole.item_id JOIN t ON t.doc_id = whole.doc_id AND t.term = s.term GROUP BY ALL)
SELECT b.item_id AS item_id, doc_id, CAST(min(begin) AS INTEGER) AS first, CAST(count(*) AS INTEGER) AS matches FROM b JOIN m ON m.item_id = b.item_id WHERE hits = m GROUP BY b.item_id, doc_id""")
def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that have a benchmark text, whole, term after term."""
    return phrase_matches(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


@query("WITH " + _TERMS + """, h AS (SELECT whole.item_id AS item_id, whole.doc_id AS doc_id, n, t.term AS term, place FROM whole JOIN u ON u.item_id = whole.item_id JOIN t ON t.doc_id = whole.doc_id AND t.term = u.term),
l AS (SELECT h.item_id AS item_id, h.doc_id AS doc_id, n, h.place AS place, max(CASE WHEN h.term = u.term THEN h.place END) OVER (PARTITION BY h.item_id, h.doc_id, u.term ORDER BY h.place) AS last FROM h JOIN u ON u.item_id = h.item_id),
c AS (SELECT item_id, doc_id, place, min(last) AS begin FROM l GROUP BY item_id, doc_id, place, n HAVING count(last) = n), k AS (SELECT item_id, doc_id, min(place) - begin + 1 AS length FROM c GROUP BY item_id, doc_id, begin)
SELECT item_id, doc_id, CAST(count(*) AS INTEGER) AS covers, CAST(min(length) AS INTEGER) AS shortest, round(sum(1.0::DOUBLE / length), 6) AS score FROM k GROUP BY item_id, doc_id""")
def cover_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold all terms of a benchmark text, ranked by how close together."""
    return cover_ranks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
