"""Retrieval: chunks, postings, keyword and vector ranking, fusion, reranking, extractive answers and their evaluation."""

from __future__ import annotations

import functools
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as fn
from ..plans.registry import query
from ..plans.storage import bound_batches, spread, written
from ..plans.tables import table

# The chunker's window and overlap, the fusion's constant.
WINDOW, OVERLAP, RRF = 1200, 160, 60
#: Distinct (search, term) pairs that are sent to the documents; beyond, documents and searches are joined by terms.
SENT_TERMS = 1_000_000
#: Scores held at a time beside a task's best, and vectors of a shard.
CELLS, SHARD_ROWS = 500_000, 16384
#: Searches whose vectors are sent to all rows; beyond, rows are cut into shards.
SENT_VECTORS = 4096


def candidate_limit(k: int) -> int:
    """How many candidates each ranking gives for ``k`` results."""
    return min(max(4 * k, 20), 100)


@query(r"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM t GROUP BY term")
def posting_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary with document and occurrence counts: counts by term and document combine before they are shuffled by term."""
    p = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(fn.tokens("text")).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    return p.groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"))


def keyword_scores(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str) -> DataFrame:
    """``query_id``, ``doc_id``, ``score``: the terms that query and document share, by the lesser count, over the root of the document's length. Only terms that some query has leave the documents."""
    q = queries.select(query_id, F.explode(fn.tokens("text")).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("tf_q"))
    known = q.select("term").distinct()
    d = docs.select(doc_id, fn.tokens("text").alias("tokens")).withColumn("length", F.size("tokens")).select(doc_id, "length", F.explode("tokens").alias("term"))
    d = d.join(known, "term", "left_semi").groupBy(doc_id, "length", "term").agg(F.count("*").alias("tf_d"))
    s = d.join(q, "term").groupBy(query_id, doc_id).agg(F.sum(F.least("tf_q", "tf_d")).alias("shared"), F.first("length").alias("length"))
    return s.select(query_id, doc_id, F.round(F.col("shared") / F.sqrt(F.greatest(F.col("length"), F.lit(1)).cast("double")), 6).alias("score"))


def ranked(scores: DataFrame, by: str, item: str, k: int) -> DataFrame:
    """The ``k`` best of each ``by`` with their ``rank``. Ties go to the smaller item; ranks are limited before the shuffle too."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), item))).where(F.col("rank") <= k)


_KEYWORD = r"""WITH q AS (SELECT item_id, term, count(*) AS tf_q FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM benchmark) GROUP BY ALL),
d AS (SELECT doc_id, term, count(*) AS tf_d FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY ALL), n AS (SELECT doc_id, sum(tf_d) AS length FROM d GROUP BY ALL),
kw AS (SELECT item_id, d.doc_id AS doc_id, round(sum(least(tf_q, tf_d)) / sqrt(CAST(any_value(length) AS DOUBLE)), 6) AS score FROM q JOIN d ON q.term = d.term JOIN n ON n.doc_id = d.doc_id GROUP BY item_id, d.doc_id),
top AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM kw)"""


def _best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` best of each column, by the score rounded to six places; equal ones from the top."""
    order = np.argsort(-np.floor(score * 1e6 + 0.5), axis=0, kind="stable")[:k]
    return order.ravel(), np.tile(np.arange(score.shape[1]), len(order))


def keyword_top(docs: DataFrame, queries: DataFrame, doc_id: str, query_id: str, k: int) -> DataFrame:
    """``query_id``, ``doc_id``, ``score``, ``rank``: the ``k`` best documents of each query by ``keyword_scores``, ties to the smaller id, scores above 0 alone.

    The queries' terms go to the documents, whose terms lie together: nothing is shuffled by term, and a task gives on its ``k`` best for each query,
    so common terms cost no pairs. With a count of 2 or more a term is as many features (once, twice, ...), so shared terms by
    the lesser count are sums over the queries that its features list: a sparse product, in which a document meets the queries that share a term with it. Where there are more than ``SENT_TERMS`` terms, or ids are no whole numbers, the join decides.
    """
    asked = queries.select(query_id, F.explode(fn.tokens("text")).alias("term")).groupBy(query_id, "term").agg(F.count("*").alias("tf")).limit(SENT_TERMS + 1)
    kinds = [docs.schema[doc_id].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()]
    terms = asked.collect() if set(kinds) <= {"int", "bigint"} else None  # SENT_TERMS rows at most
    if terms is None or len(terms) > SENT_TERMS:
        return ranked(keyword_scores(docs, queries, doc_id, query_id).where("score > 0"), query_id, doc_id, k)
    names = sorted({r[0] for r in terms})
    column = {q: i for i, q in enumerate(names)}
    first: dict[str, int] = {}
    most: Counter = Counter()
    for r in terms:
        most[r["term"]] = max(most[r["term"]], r["tf"])
    rows = 0
    for t, n in most.items():
        first[t] = rows
        rows += n
    at = np.array(sorted((first[r["term"]] + i, column[r[0]]) for r in terms for i in range(r["tf"])), dtype=np.int64).reshape(-1, 2)
    begins = np.searchsorted(at[:, 0], np.arange(rows + 1))  # a row of queries for each feature, one after the other
    shared = docs.sparkSession.sparkContext.broadcast((first, dict(most), begins, at[:, 1].copy(), np.array(names, dtype=np.int64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, most, begins, queries_of, names = shared.value
        held, size = [], 0

        def best() -> np.ndarray:
            """Rows (query, id, shared, length) of the ``k`` best of each query so far."""
            every = np.concatenate(held) if held else np.empty((0, 4), dtype=np.int64)
            order = np.lexsort((every[:, 1], -np.floor(every[:, 2] / np.sqrt(np.maximum(every[:, 3], 1)) * 1e6 + 0.5), every[:, 0]))
            every = every[order]
            starts = np.flatnonzero(np.concatenate([[True], every[1:, 0] != every[:-1, 0]])) if len(every) else np.empty(0, dtype=np.int64)
            place = np.arange(len(every)) - np.repeat(starts, np.diff(np.append(starts, len(every))))
            return every[place < k]

        for b in batches:
            for name, text in zip(b["id"].tolist(), b["body"]):
                words = re.findall(r"[^\W_]+", text.lower()) if text else []
                features = np.array([i for w, n in Counter(words).items() if w in first for i in range(first[w], first[w] + min(n, most[w]))], dtype=np.int64)
                lengths = begins[features + 1] - begins[features]
                hits = queries_of[np.repeat(begins[features] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
                q, n = np.unique(hits, return_counts=True)
                held.append(np.column_stack([q, np.full(len(q), name), n, np.full(len(q), len(words))]))
                size += len(q)
                if size > CELLS + k * len(names):
                    held = [best()]
                    size = len(held[0])
        got = best()
        yield pd.DataFrame({query_id: names[got[:, 0]], doc_id: got[:, 1], "shared": got[:, 2], "length": got[:, 3]})

    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("id"), F.col("text").alias("body"))
    found = spread(slim).mapInPandas(run, f"{query_id} {kinds[1]}, {doc_id} {kinds[0]}, shared long, length long")
    return ranked(found.select(query_id, doc_id, F.round(F.col("shared") / F.sqrt(F.greatest("length", F.lit(1)).cast("double")), 6).alias("score")), query_id, doc_id, k)


def _keyword(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return keyword_top(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"), "doc_id", "item_id", k)


@query(_KEYWORD + " SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 10")
def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark text."""
    return _keyword(spark, sf_dir, 10)


def _units(x: pd.Series) -> np.ndarray:
    v = np.array(x.tolist(), dtype=np.float64)
    return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)


#: Numbers of the sample that cells are cut by, and its rows for a cell at least: so there are SAMPLED / (64 * length) cells at most, and their boxes are few.
SAMPLED, CELL_SAMPLE = 4_000_000, 64


def smallest_hashes(rows: DataFrame, key: str, n: int, wanted: int) -> DataFrame:
    """``wanted`` of about ``n`` rows, those whose keys have the smallest hashes. Rows beyond twice as many are dropped where they are read, so that a table of any size sends few to be ranked."""
    place = F.pmod(F.xxhash64(key, F.lit(9)), F.lit(1 << 30))
    return rows.where(place < F.lit(min(1.0, 2 * wanted / max(n, 1)) * (1 << 30))).orderBy(place, key).limit(wanted)


def cut_cells(sample: np.ndarray, cells: int) -> list[tuple]:
    """A tree of median splits of the component that varies most: nodes (component, threshold, left, right), or the number of a cell."""
    nodes: list = []

    def split(rows: np.ndarray, wanted: int) -> int:
        at = len(nodes)
        nodes.append(None)
        axis = int(np.argmax(rows.var(axis=0))) if len(rows) else 0
        if wanted > 1 and len(rows) >= 2 * CELL_SAMPLE and np.ptp(rows[:, axis]) > 0:
            middle = float(np.median(rows[:, axis]))
            low = rows[:, axis] < middle
            nodes[at] = (axis, middle, split(rows[low], wanted // 2), split(rows[~low], wanted - wanted // 2))
        else:
            nodes[at] = len([x for x in nodes if isinstance(x, int)])
        return at

    split(sample, cells)
    return nodes


def cell_of(nodes: list, rows: np.ndarray) -> np.ndarray:
    """The cell of each row."""
    out = np.zeros(len(rows), dtype=np.int64)
    todo = [(0, np.arange(len(rows)))]
    while todo:
        at, some = todo.pop()
        if isinstance(nodes[at], int):
            out[some] = nodes[at]
        elif len(some):
            axis, middle, left, right = nodes[at]
            low = rows[some, axis] < middle
            todo += [(left, some[low]), (right, some[~low])]
    return out


def cell_bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray, center: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """What no product of a query (rows of ``q``, of length 1) and a row of a cell exceeds: by the cell's box, and by the ball around its middle."""
    box = np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T
    return np.minimum(box, q @ center.T + radius)


def _searched(rows: DataFrame, asked: DataFrame, k: int, own: bool) -> DataFrame:
    """``query_id``, ``vec_id``, ``score``: the ``k`` best of each shard for each of its queries. ``rows``: ``shard``, ``id``, ``embedding``; ``asked``: the same of queries. In a task a shard's rows come first and are one matrix, then its
    queries stream past it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, parts, ids, matrix = None, [], None, None
        for b in batches:
            for (key, asks), g in b.groupby(["shard", "asks"]):
                if key != shard:
                    shard, parts, matrix = key, [], None
                if not asks:
                    parts.append(g)
                    continue
                if matrix is None:
                    own_rows = pd.concat(parts).sort_values("id") if parts else g.iloc[:0]
                    ids, matrix = own_rows["id"].to_numpy(), _units(own_rows["embedding"]) if parts else None
                if matrix is None:
                    continue
                step = max(1, 4 * CELLS // len(ids))
                for first in range(0, len(g), step):
                    some = g.iloc[first : first + step]
                    score = matrix @ _units(some["embedding"]).T
                    names = some["id"].to_numpy()
                    if not own:
                        score[ids[:, None] == names[None, :]] = -np.inf
                    r, c = _best(score, k)
                    found = pd.DataFrame({"query_id": names[c], "vec_id": ids[r], "score": score[r, c]})
                    yield found[found["score"] > -np.inf]

    both = rows.select("shard", F.lit(0).alias("asks"), "id", "embedding").unionByName(asked.select("shard", F.lit(1).alias("asks"), "id", "embedding"))
    dealt = both.repartition("shard").sortWithinPartitions("shard", "asks")
    return dealt.mapInPandas(run, "query_id long, vec_id long, score double").withColumn("score", F.round("score", 6))


#: Shards of a cell have numbers from so many times the cell's.
CELL_SHARDS = 1 << 20


def _sent(asked: DataFrame, bounds, subs: np.ndarray, pilot: bool) -> DataFrame:
    """Queries (``id``, ``embedding``, ``floor``) with the shards they go to: those of the cell of the highest bound, or of all other cells whose bound reaches their floor."""
    vector = asked.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            top = bounds(_units(b["embedding"]))
            best = top.argmax(axis=1)
            goes = np.zeros(top.shape, dtype=bool)
            if not pilot:
                goes = top >= np.where(b["floor"].isna(), -np.inf, b["floor"].astype(float) - 2e-6).reshape(-1, 1)  # scores are rounded to six places
            goes[np.arange(len(b)), best] = pilot
            q, cell = np.nonzero(goes)
            for sub in range(int(subs[cell].max(initial=0))):
                has = subs[cell] > sub
                yield pd.DataFrame({"shard": cell[has] * CELL_SHARDS + sub, "id": b["id"].to_numpy()[q[has]], "embedding": b["embedding"].to_numpy()[q[has]]})

    return asked.mapInPandas(run, f"shard long, id long, embedding {vector}")


def _passed(vectors: DataFrame, ids: np.ndarray, asked: np.ndarray, k: int, own: bool) -> DataFrame:
    """``query_id``, ``vec_id``, ``score``: the ``k`` best of each task's rows for each of some searches, whose vectors (rows of ``asked``, of length 1) go to the rows: no rows are moved."""
    shared = vectors.sparkSession.sparkContext.broadcast((ids, asked))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, asked = shared.value
        held, size, floor = [], 0, np.full(len(ids), -np.inf)
        step = max(1, CELLS // len(ids))

        def best() -> pd.DataFrame:
            every = pd.concat(held).sort_values(["q", "order", "vec_id"], ascending=[True, False, True])
            return every[every.groupby("q").cumcount() < k]

        for b in batches:
            for first in range(0, len(b), step):
                some = b.iloc[first : first + step]
                names = some["vec_id"].to_numpy()
                score = _units(some["embedding"]) @ asked.T
                if not own:
                    score[names[:, None] == ids[None, :]] = -np.inf
                order = np.floor(score * 1e6 + 0.5)
                r, q = np.nonzero((order >= floor) & (score > -np.inf))
                held.append(pd.DataFrame({"q": q, "vec_id": names[r], "score": score[r, q], "order": order[r, q]}))
                size += len(q)
                if size > 4 * k * len(ids):
                    held = [best()]
                    size = len(held[0])
                    last = held[0].groupby("q")["order"].agg(["size", "min"])
                    floor[last.index[last["size"] == k]] = last["min"][last["size"] == k]
        if held:
            got = best()
            yield pd.DataFrame({"query_id": ids[got["q"].to_numpy()], "vec_id": got["vec_id"], "score": got["score"]})

    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInPandas(run, "query_id long, vec_id long, score double")
    return found.withColumn("score", F.round("score", 6))


def vector_top(vectors: DataFrame, queries: DataFrame, k: int, own: bool = False, rows: int | None = None) -> DataFrame:
    """``query_id``, ``vec_id``, ``score`` (cosine), ``rank``: the ``k`` nearest rows (``vec_id``, ``embedding``) of each of a stated query set (``query_id``, ``embedding``); a
    row of the query's id only if ``own``. Ids are whole numbers, vectors of one length and not null. ``rows``: how many there are, where that is known without computing them.

    More than ``SHARD_ROWS`` rows are cut into cells by medians of a bounded sample; larger cells are dealt into shards of that size. Each query first meets the cell that may hold its
    best, then, with its k-th score so far, the other cells whose box or ball may hold one as good: no others are sent it. Exact at any distribution; where vectors lie evenly, few cells are ruled out.
    """
    n = vectors.count() if rows is None else rows
    shards = max(1, -(-n // SHARD_ROWS))
    bound_batches(vectors.sparkSession)
    given = vectors.select(F.col("vec_id").cast("long").alias("id"), "embedding")
    asked = queries.select(F.col("query_id").cast("long").alias("id"), "embedding")
    if shards == 1:
        return ranked(_searched(given.withColumn("shard", F.lit(0)), asked.withColumn("shard", F.lit(0)), k, own), "query_id", "vec_id", k)
    given, asked = written(given, "vectors"), written(asked, "asked")
    width = given.select(F.size("embedding")).first()
    sample = _units(smallest_hashes(given, "id", n, max(2 * CELL_SAMPLE, SAMPLED // max(width[0], 1))).toPandas()["embedding"]) if width else np.zeros((0, 1))
    nodes = cut_cells(sample, shards)
    cells = len([x for x in nodes if isinstance(x, int)])
    where = cell_of(nodes, sample)
    center = np.array([sample[where == c].mean(axis=0) if (where == c).any() else np.zeros(sample.shape[1]) for c in range(cells)])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["cell"] = cell_of(nodes, _units(b["embedding"])).astype(np.int32)
            yield b

    def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lo, hi, far, n = np.full(center.shape, np.inf), np.full(center.shape, -np.inf), np.full(cells, -np.inf), np.zeros(cells, dtype=np.int64)
        for b in batches:
            x, c = _units(b["embedding"]), b["cell"].to_numpy()
            np.minimum.at(lo, c, x)
            np.maximum.at(hi, c, x)
            np.maximum.at(far, c, np.sqrt(((x - center[c]) ** 2).sum(axis=1)))
            n += np.bincount(c, minlength=cells)
        held = np.flatnonzero(far >= 0)
        if len(held):  # a split without rows has none
            yield pd.DataFrame({"cell": held, "lo": list(lo[held]), "hi": list(hi[held]), "far": far[held], "n": n[held]})

    vector = given.schema["embedding"].dataType.simpleString()
    placed = written(given.mapInPandas(place, f"id long, embedding {vector}, cell int"), "cells")
    at = written(placed.mapInPandas(boxes, "cell long, lo array<double>, hi array<double>, far double, n long"), "boxes")
    least, most = (at.select("cell", F.posexplode(c).alias("i", "v")).groupBy("cell", "i").agg(f("v").alias("v")).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("i", "v")))["v"].alias(c)) for c, f in (("lo", F.min), ("hi", F.max)))
    box = least.join(most, "cell").join(at.groupBy("cell").agg(F.max("far").alias("far"), F.sum("n").alias("n")), "cell").orderBy("cell").collect()  # one row for each cell that holds any
    full = np.array([r["cell"] for r in box], dtype=np.int64)
    lo, hi, far = np.array([r["lo"] for r in box]), np.array([r["hi"] for r in box]), np.array([r["far"] for r in box])

    subs = np.ones(cells, dtype=np.int64)
    subs[full] = [-(-r["n"] // SHARD_ROWS) for r in box]  # a cell of many rows, equal ones too, is many shards

    def bounds(q: np.ndarray) -> np.ndarray:
        out = np.full((len(q), cells), -np.inf)
        out[:, full] = cell_bounds(q, lo, hi, center[full], far) + 1e-9
        return out

    parts = placed.sparkSession.createDataFrame(list(enumerate(subs.tolist())), "cell int, subs long")
    sharded = placed.join(F.broadcast(parts), "cell").select((F.col("cell") * F.lit(CELL_SHARDS) + F.pmod(F.xxhash64("id", F.lit(3)), F.col("subs"))).alias("shard"), "id", "embedding")  # a row for each cell
    none = asked.withColumn("floor", F.lit(None).cast("double"))
    first = written(_searched(sharded, _sent(none, bounds, subs, True), k, own), "first")
    best = ranked(first, "query_id", "vec_id", k)
    floors = best.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    going = written(_sent(asked.join(floors, "id", "left"), bounds, subs, False), "sent")
    return ranked(first.unionByName(_searched(sharded, going, k, own)), "query_id", "vec_id", k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int, own: bool = False, rows: int | None = None) -> DataFrame:
    """As ``vector_top``; up to ``SENT_VECTORS`` queries are sent to the rows, which then lie where they are and are computed once."""
    bound_batches(vectors.sparkSession)
    few = queries.select("query_id", "embedding").limit(SENT_VECTORS + 1).toPandas()
    if 0 < len(few) <= SENT_VECTORS:
        return ranked(_passed(vectors, few["query_id"].to_numpy(dtype=np.int64), _units(few["embedding"]), k, own), "query_id", "vec_id", k)
    return vector_top(vectors, queries, k, own, rows)


_VECTOR = """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS v FROM v),
vs AS (SELECT q.vec_id AS query_id, u.vec_id AS vec_id, round(list_inner_product(q.v, u.v), 6) AS score, q.label = u.label AS relevant FROM u q JOIN u ON q.vec_id <> u.vec_id WHERE q.vec_id % 20 = 0),
vt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM vs)"""


def _vector_top(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return vector_top(e, e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), k)


@query(_VECTOR + " SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM vt WHERE rank <= 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors for every twentieth."""
    return _vector_top(spark, sf_dir, 10)


def fuse(*rankings: DataFrame, by: str, item: str, constant: int = RRF) -> DataFrame:
    """``by``, ``item``, ``score``: the sum of 1 / (constant + rank) over the rankings that have the item."""
    all_ = None
    for r in rankings:
        r = r.select(by, item, (1.0 / (constant + F.col("rank"))).alias("part"))
        all_ = r if all_ is None else all_.unionByName(r)
    return all_.groupBy(by, item).agg(F.round(F.sum("part"), 9).alias("score"))


def _text_vectors(texts: DataFrame, id_col: str) -> DataFrame:
    """Vectors of texts by hashed terms, with a hash that SQL has too; blank texts have none."""
    v = hashing_embedding(texts.where(F.col("text").rlike(r"[\p{L}\p{N}]")), id_col, "text", digest="md5")
    return v.withColumn(id_col, F.col(id_col).cast("long"))


def _rankings(d: DataFrame, b: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The ``most`` best documents of each search by keywords, and by vectors: ``item_id``, ``doc_id``, ``rank``. Texts are embedded once, where they are read, if the searches can be sent to them."""
    vector = nearest(_text_vectors(d, "doc_id").withColumnRenamed("doc_id", "vec_id"), _text_vectors(b, "item_id").withColumnRenamed("item_id", "query_id"), most, own=True, rows=d.count())
    return keyword_top(d, b, "doc_id", "item_id", most), vector.select(F.col("query_id").alias("item_id"), F.col("vec_id").alias("doc_id"), "rank")


def hybrid(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """``item_id``, ``doc_id``, ``score``, ``rank`` of the benchmark's texts as searches for ``k`` results: all candidates of the keyword and the vector ranking of all
    documents, fused by reciprocal ranks."""
    d, b = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    most = candidate_limit(k)
    return ranked(fuse(*_rankings(d, b, most), by="item_id", item="doc_id"), "item_id", "doc_id", 2 * most)


_HYBRID = _KEYWORD + r""", tok AS (SELECT 'd' AS kind, doc_id AS id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents)
  UNION ALL SELECT 'q', item_id, unnest(t), generate_subscripts(t, 1) FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM benchmark)),
hashed AS (SELECT kind, id, ('0x' || substr(md5(term), 1, 15))::UBIGINT AS h, pos FROM tok),
buckets AS (SELECT kind, id, CAST(h % 384 AS INTEGER) AS bucket, sum(CASE WHEN (h // 384) % 2 = 1 THEN 1 ELSE -1 END / sqrt(CAST(pos AS DOUBLE))) AS w FROM hashed GROUP BY ALL),
norms AS (SELECT kind, id, sqrt(sum(w * w)) AS n FROM buckets GROUP BY ALL), unit AS (SELECT b.kind AS kind, b.id AS id, bucket, CASE WHEN n > 0 THEN w / n ELSE 0 END AS w FROM buckets b JOIN norms m ON b.kind = m.kind AND b.id = m.id),
cosines AS (SELECT q.id AS item_id, d.id AS doc_id, round(sum(q.w * d.w), 6) AS score FROM (SELECT * FROM unit WHERE kind = 'q') q JOIN (SELECT * FROM unit WHERE kind = 'd') d ON q.bucket = d.bucket GROUP BY ALL),
near AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM cosines),
fused AS (SELECT item_id, doc_id, round(sum(p), 9) AS score FROM (SELECT item_id, doc_id, 1.0::DOUBLE / (60 + rank) AS p FROM top WHERE rank <= {most} UNION ALL SELECT item_id, doc_id, 1.0::DOUBLE / (60 + rank) FROM near WHERE rank <= {most}) GROUP BY ALL),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM fused) WHERE rank <= {k})"""


@query(_HYBRID.replace("{most}", "40").replace("{k}", "10") + " SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM hits")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark text by keywords and vectors together."""
    return hybrid(spark, sf_dir, 10).where("rank <= 10")


def reranked(hits: DataFrame, queries: DataFrame, docs: DataFrame, section: Column, k: int) -> DataFrame:
    """``item_id``, ``doc_id``, ``score``, ``rank``: hits anew by their score, the share of the query's terms in the text, 0.2 if the whole query stands in it as a
    phrase, and 0.1 times the share of its terms in the section. Texts are joined to hits only."""
    j = hits.select("item_id", "doc_id", "score").join(queries.select("item_id", F.col("text").alias("asked")), "item_id").join(docs.withColumn("section", section), "doc_id")
    qt, dt, st = (F.array_distinct(fn.tokens(c)) for c in ("asked", "text", "section"))
    n = F.greatest(F.size(qt), F.lit(1)).cast("double")
    phrase = F.contains(F.lower("text"), F.regexp_replace(F.lower("asked"), r"^\s+|\s+$", ""))
    score = F.col("score") + F.size(F.array_intersect(qt, dt)) / n + F.when(phrase, 0.2).otherwise(0.0) + F.lit(0.1) * F.size(F.array_intersect(qt, st)) / n
    return ranked(j.select("item_id", "doc_id", F.round(score, 6).alias("score")), "item_id", "doc_id", k)


def heading() -> Column:
    """A document's first line as its section."""
    return F.coalesce(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(""))


_RERANK = r""", pairs AS (SELECT c.item_id AS item_id, c.doc_id AS doc_id, score, list_distinct(regexp_extract_all(lower(b.text), '[\p{L}\p{N}]+')) AS qt, list_distinct(regexp_extract_all(lower(d.text), '[\p{L}\p{N}]+')) AS dt,
  list_distinct(regexp_extract_all(lower(split_part(d.text, chr(10), 1)), '[\p{L}\p{N}]+')) AS st, contains(lower(d.text), regexp_replace(lower(b.text), '^\s+|\s+$', '', 'g')) AS phrase FROM {hits} c JOIN benchmark b ON b.item_id = c.item_id JOIN documents d ON d.doc_id = c.doc_id),
anew AS (SELECT item_id, doc_id, round(score + len(list_intersect(qt, dt)) / CAST(greatest(len(qt), 1) AS DOUBLE) + CASE WHEN phrase THEN 0.2::DOUBLE ELSE 0 END + 0.1::DOUBLE * len(list_intersect(qt, st)) / CAST(greatest(len(qt), 1) AS DOUBLE), 6) AS score FROM pairs),
final AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM anew) WHERE rank <= 5)"""


@query(_KEYWORD + _RERANK.replace("{hits}", "(SELECT * FROM top WHERE rank <= 20)") + " SELECT item_id, doc_id, score FROM final")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of twenty keyword candidates, reranked by terms, the whole phrase and the heading."""
    d, b = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    return reranked(_keyword(spark, sf_dir, candidate_limit(5)), b, d, heading(), 5).select("item_id", "doc_id", "score")


def sentences(c) -> Column:
    return F.split(c, r"(?<=[.!?。！？])\s+")


def best_sentence(asked, text) -> Column:
    """The text's sentence that shares most terms with the question, the first of equals, as a struct ``overlap``, ``sentence``."""
    qt = F.array_distinct(fn.tokens(asked))
    each = F.transform(sentences(text), lambda s, i: F.struct(F.size(F.array_intersect(qt, fn.tokens(s))).alias("overlap"), (-i).alias("i"), s.alias("sentence")))
    return F.array_max(each)


# Fixed value: the answer where nothing supports one.
REFUSAL = "The indexed evidence does not support an answer."


def answers(hits: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``item_id``, ``answer``: the best sentence of each of the three best hits with its number; a refusal where there is no hit or the best scores 0."""
    j = hits.where("rank <= 3 and score > 0").join(queries.select("item_id", F.col("text").alias("asked")), "item_id").join(docs, "doc_id")
    s = j.select("item_id", "rank", F.regexp_replace(best_sentence("asked", "text")["sentence"], r"^\s+|\s+$", "").alias("sentence")).where("sentence <> ''")
    told = s.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("rank", "sentence"))).alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat(x["sentence"], F.lit(" ["), x["rank"].cast("string"), F.lit("]"))), " ")
    return queries.select("item_id").join(told.select("item_id", text.alias("answer")), "item_id", "left").select("item_id", F.coalesce("answer", F.lit(REFUSAL)).alias("answer"))


@query(_HYBRID.replace("{most}", "20").replace("{k}", "40") + _RERANK.replace("{hits}", "hits") + r""", s AS (SELECT f.item_id AS item_id, rank, list_distinct(regexp_extract_all(lower(b.text), '[\p{L}\p{N}]+')) AS qt, regexp_split_to_array(regexp_replace(d.text, '([.!?。！？])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM final f JOIN benchmark b ON b.item_id = f.item_id JOIN documents d ON d.doc_id = f.doc_id WHERE rank <= 3 AND score > 0),
e AS (SELECT item_id, rank, qt, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS i FROM s), o AS (SELECT item_id, rank, i, sentence, len(list_intersect(qt, list_distinct(regexp_extract_all(lower(sentence), '[\p{L}\p{N}]+')))) AS overlap FROM e),
w AS (SELECT item_id, rank, regexp_replace(sentence, '^\s+|\s+$', '', 'g') AS sentence FROM (SELECT *, row_number() OVER (PARTITION BY item_id, rank ORDER BY overlap DESC, i) AS rn FROM o) WHERE rn = 1),
told AS (SELECT item_id, string_agg(sentence || ' [' || rank || ']', ' ' ORDER BY rank) AS answer FROM w WHERE sentence <> '' GROUP BY item_id)
SELECT benchmark.item_id AS item_id, coalesce(answer, 'The indexed evidence does not support an answer.') AS answer FROM benchmark LEFT JOIN told ON told.item_id = benchmark.item_id""")
def extract_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each search's answer: a cited sentence of each of the three best hits of the reranked hybrid search."""
    d, b = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    return answers(reranked(hybrid(spark, sf_dir, 5), b, d, heading(), 5), b, d)


def ranking_metrics(rankings: DataFrame, k: int) -> DataFrame:
    """``recall_at_k`` and ``mrr`` of rankings (``query_id``, ``rank``, ``relevant``): the share of queries with a relevant result in the first ``k``, and the mean of 1 / first relevant rank."""
    first = rankings.groupBy("query_id").agg(F.min(F.when(F.col("relevant") & (F.col("rank") <= k), F.col("rank"))).alias("r"))
    return first.agg(F.count("*").alias("queries"), F.round(F.avg(F.when(F.col("r").isNotNull(), 1.0).otherwise(0.0)), 6).alias("recall_at_k"), F.round(F.avg(F.coalesce(1.0 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))


def nearest_rank(values: DataFrame, column: str, share: float) -> DataFrame:
    """The value at position ceil(share * n) in order, of those that are not null: equal values are counted together, ranges of values by partition, so that no
    task sees more than its range."""
    counts = values.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).repartitionByRange(column).withColumn("part", F.spark_partition_id())
    counts = written(counts, "counts")
    parts = counts.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()  # one row for each partition
    at, before = max(1, -(-int(share * sum(r["n"] for r in parts) * 10**9) // 10**9)), 0
    for r in parts:
        if before + r["n"] >= at:
            inside = F.sum("n").over(Window.partitionBy("part").orderBy(column))
            return counts.where(F.col("part") == r["part"]).withColumn("upto", inside).where(F.col("upto") >= at - before).agg(F.min(column).alias(f"p{int(share * 100)}"))
        before += r["n"]
    return values.select(column).where("false").agg(F.max(column).alias(f"p{int(share * 100)}"))


def documents_of(hits: DataFrame, by: str, document: str) -> DataFrame:
    """``by``, ``document``, ``rank``: the documents of ranked hits, each once, in the order of its first hit."""
    first = hits.groupBy(by, document).agg(F.min("rank").alias("first"))
    return first.select(by, document, F.row_number().over(Window.partitionBy(by).orderBy("first", document)).alias("rank"))


def quality_delta(current: DataFrame, legacy: DataFrame) -> DataFrame:
    """``strategy``, ``metric``, ``delta`` of two sets of figures; what the legacy set lacks counts as 0."""
    return current.join(legacy.withColumnRenamed("value", "old"), ["strategy", "metric"], "left").select("strategy", "metric", F.round(F.col("value") - F.coalesce("old", F.lit(0.0)), 6).alias("delta"))


@query(_VECTOR + """, f AS (SELECT query_id, min(CASE WHEN relevant AND rank <= 5 THEN rank END) AS r FROM vt WHERE rank <= 10 GROUP BY ALL)
SELECT count(*) AS queries, round(avg(CASE WHEN r IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_k, round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr FROM f""")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at five and mean reciprocal rank of vector search, with equal labels as relevance."""
    labels = table(spark, sf_dir, "embeddings", "vec_id", "label")
    top = _vector_top(spark, sf_dir, 10).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id")
    return ranking_metrics(top.withColumn("relevant", F.col("label") == F.col("own")), 5)


def strategy_metrics(rankings: dict[str, DataFrame], relevant: DataFrame, k: int) -> DataFrame:
    """``strategy``, ``queries``, ``recall_at_k``, ``mrr`` of several rankings (``item_id``, ``doc_id``, ``rank``) against the relevant pairs (``item_id``, ``doc_id``)."""
    out = None
    for name, hits in rankings.items():
        r = hits.select(F.col("item_id").alias("query_id"), "doc_id", "rank").join(relevant.select(F.col("item_id").alias("query_id"), "doc_id", F.lit(True).alias("relevant")), ["query_id", "doc_id"], "left")
        m = ranking_metrics(r.withColumn("relevant", F.coalesce("relevant", F.lit(False))), k).withColumn("strategy", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out.select("strategy", "queries", "recall_at_k", "mrr")


@query(_HYBRID.replace("{most}", "20").replace("{k}", "40") + _RERANK.replace("{hits}", "hits") + """, rel AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
rs AS (SELECT 'ftsOnly' AS strategy, item_id, doc_id, rank FROM top WHERE rank <= 5 UNION ALL SELECT 'vectorOnly', item_id, doc_id, rank FROM near WHERE rank <= 5 UNION ALL SELECT 'hybridRrf', item_id, doc_id, rank FROM hits WHERE rank <= 5 UNION ALL SELECT 'hybridReranked', item_id, doc_id, rank FROM final),
f AS (SELECT strategy, rs.item_id AS item_id, min(CASE WHEN rel.doc_id IS NOT NULL THEN rank END) AS r FROM rs LEFT JOIN rel ON rel.item_id = rs.item_id AND rel.doc_id = rs.doc_id GROUP BY strategy, rs.item_id)
SELECT strategy, count(*) AS queries, round(avg(CASE WHEN r IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_at_k, round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr FROM f GROUP BY strategy""")
def retrieval_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords alone, vectors alone, both fused, and fused and reranked, judged by whether documents hold the benchmark text."""
    d, b = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    keyword, vector = (written(x, "ranking") for x in _rankings(d, b, candidate_limit(5)))
    fused = written(ranked(fuse(keyword, vector, by="item_id", item="doc_id"), "item_id", "doc_id", 2 * candidate_limit(5)), "fused")
    every = {"ftsOnly": keyword, "vectorOnly": vector, "hybridRrf": fused, "hybridReranked": reranked(fused, b, d, heading(), 5)}
    hits = written(functools.reduce(DataFrame.unionByName, (h.where("rank <= 5").select(F.lit(n).alias("strategy"), "item_id", "doc_id", "rank") for n, h in every.items())), "strategies")
    texts = hits.select("item_id", "doc_id").distinct().join(b.select("item_id", F.col("text").alias("asked")), "item_id").join(d, "doc_id")
    relevant = written(texts.where(F.contains("text", "asked")).select("item_id", "doc_id"), "relevant")
    return strategy_metrics({n: hits.where(F.col("strategy") == n) for n in every}, relevant, 5)


@query("SELECT doc_id, sha256(concat_ws('|', CAST(doc_id AS VARCHAR), coalesce(lang, 'null'), coalesce(source, 'null'), coalesce(text, 'null'), 'simple', '1')) AS fingerprint FROM documents")
def doc_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What makes an indexed document the same: its fields, the normaliser and its version."""
    from .ingest import fingerprint

    return table(spark, sf_dir, "documents", "doc_id", "lang", "source", "text").select("doc_id", fingerprint("doc_id", "lang", "source", "text", F.lit("simple"), F.lit("1")).alias("fingerprint"))


@query("""WITH w AS (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 161, 0) // 1040)) AS ordinal FROM documents WHERE text IS NOT NULL), c AS (SELECT doc_id, ordinal, ordinal * 1040 AS begins, least(ordinal * 1040 + 1200, length(text)) AS ends, substr(text, CAST(ordinal * 1040 + 1 AS BIGINT), 1200) AS content FROM w)
SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(begins AS INTEGER) AS begins, CAST(ends AS INTEGER) AS ends, substr(sha256(concat_ws(':', doc_id, ordinal, begins, ends)), 1, 32) AS chunk_id, sha256(content) AS content_hash FROM c WHERE content <> ''""")
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed overlapping windows over every text, exploded where the text is."""
    step = WINDOW - OVERLAP
    n = F.length("text")
    ordinals = F.expr(f"sequence(0, cast(greatest(length(text) - {OVERLAP + 1}, 0) div {step} as int))")
    c = table(spark, sf_dir, "documents", "doc_id", "text").where("text is not null").select("doc_id", "text", F.explode(ordinals).alias("ordinal")).withColumn("begins", F.col("ordinal") * step).withColumn("ends", F.least(F.col("begins") + WINDOW, n))
    c = c.withColumn("content", F.expr(f"substring(text, begins + 1, {WINDOW})")).where("content <> ''")
    return c.select("doc_id", "ordinal", "begins", "ends", F.substring(F.sha2(F.concat_ws(":", "doc_id", "ordinal", "begins", "ends"), 256), 1, 32).alias("chunk_id"), F.sha2("content", 256).alias("content_hash"))


_HEADING = re.compile(r"^(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")


def split_sections(text: str) -> list[tuple[list[str], int, int]]:
    """Sections of a Markdown text: the headings above each, and its range without the heading lines."""
    out, path, at, begin = [], [], 0, 0
    for line in text.splitlines(keepends=True):
        if m := _HEADING.match(line.rstrip("\r\n")):
            out.append((list(path), begin, at))
            path = [*path[: len(m[1]) - 1], m[2]]
            begin = at + len(line)
        at += len(line)
    out.append((list(path), begin, at))
    return [(p, b, e) for p, b, e in out if text[b:e].strip()]


def windows(text: str, begin: int, end: int, size: int = WINDOW, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Windows of a range: cut at the last line break or space, if that lies beyond half a window; the next begins ``overlap`` before."""
    out, at = [], begin
    while at < end:
        stop = min(at + size, end)
        if stop < end:
            cut = max(text.rfind("\n", at, stop), text.rfind(" ", at, stop))
            stop = cut if cut > at + size // 2 else stop
        out.append((at, stop))
        if stop >= end:
            break
        at = max(at + 1, stop - overlap)
    return out


def _trimmed(text: str, begin: int, end: int) -> tuple[int, int]:
    part = text[begin:end]
    begin += len(part) - len(part.lstrip())
    return begin, begin + len(part.strip())


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``chunk_id``, ``ordinal``, ``section`` (headings), ``begins``, ``ends``, ``content`` of every text; blank chunks have no number."""

    names = ["id", "chunk_id", "ordinal", "section", "begins", "ends", "content"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["id"], b["body"]):
                n = 0
                for path, s, e in split_sections(t or ""):
                    for x, y in windows(t, s, e):
                        x, y = _trimmed(t, x, y)
                        if y > x:
                            rows.append((i, hashlib.sha256(f"{i}:{n}:{x}:{y}".encode()).hexdigest()[:32], n, path, x, y, t[x:y]))
                            n += 1
                if len(rows) >= 5000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    bound_batches(docs.sparkSession)
    slim = spread(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("body")))
    return slim.mapInPandas(run, "id string, chunk_id string, ordinal int, section array<string>, begins int, ends int, content string").withColumnRenamed("id", id_col)


def hashing_embedding(docs: DataFrame, id_col: str, text_col: str, dims: int = 384, digest: str = "blake2b") -> DataFrame:
    """``id_col``, ``embedding``: terms hashed to signed buckets, weighted by 1 / root of their position, of length 1. ``digest``: blake2b, or md5 (a hash that SQL has)."""

    def hashed(word: str) -> tuple[int, int]:
        if digest == "md5":
            h = int(hashlib.md5(word.encode()).hexdigest()[:15], 16)
            return h % dims, 1 if h // dims % 2 else -1
        h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
        return h % dims, 1 if h >> 63 else -1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, int]] = {}
        for b in batches:
            out = []
            for text in b["body"]:
                words = re.findall(r"[^\W_]+", (text or "").lower() if digest == "md5" else (text or "").casefold())
                if len(known) > 200_000:
                    known.clear()
                places = [known.get(w) or known.setdefault(w, hashed(w)) for w in words]
                v = np.zeros(dims)
                if places:
                    bucket, sign = np.array(places).T
                    v = np.bincount(bucket, weights=sign / np.sqrt(np.arange(1, len(words) + 1)), minlength=dims)
                n = np.linalg.norm(v)
                out.append(v / n if n else v)
            yield pd.DataFrame({"id": b["id"], "embedding": out})

    kind = "array<double>" if digest == "md5" else "array<float>"
    bound_batches(docs.sparkSession)
    slim = spread(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("body")))
    return slim.mapInPandas(run, f"id string, embedding {kind}").withColumnRenamed("id", id_col)
