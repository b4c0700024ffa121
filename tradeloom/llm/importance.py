"""Resampling of documents towards the distribution of a target text, by importance weights of hashed word n-grams.

Features are the runs of one to three words. A task takes its documents in chunks of bounded size, gives each different word of a chunk a number
and sorts the chunk's positions by the numbers of the words that follow: a suffix array, to the depth of the longest feature, in which a suffix
ends with its document. Neighbours that share their first n words (their longest common prefix has n words or more) are one run: all occurrences of one n-gram. A run is
hashed once; for the counts its bucket gains the run's length, for the scores the bucket is scattered back to the run's positions. Both passes
read whole texts; what they shuffle is one row per bucket and task, and one row of numbers per document. The table of gains has ``BUCKETS``
numbers, whatever the input.

Of a longer text, pieces of ``PIECE`` bytes go one after another, each with the last words of the one before, so no feature is lost or counted
twice and memory stays bounded by the text itself. A document without a word, or without a text, has weight 0 and no features; it is scored, but
never drawn. A null id draws as the id ``null``; rows of equal ids are rows of their own, with the same draw. Empty documents give an empty result, an empty
target counts nothing (T = 0).
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

BUCKETS = 10_000
#: Words of the longest feature.
LONGEST = 3
#: Words of a chunk, and bytes of a piece of a longer text. A chunk has fewer than 2**21 different words, which the packed keys need.
CHUNK_WORDS, PIECE = 1 << 20, 4 << 20
#: Percent drawn, of the documents of at least so many words.
PERCENT, LEAST_WORDS = 5, 20
SEED = 42

#: Bytes of words, lower-cased; all others are spaces. Bytes beyond ASCII belong to words, so whole UTF-8 sequences do.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _shifts(longest: int) -> np.ndarray:
    """[length, byte of the register, its value]: what a CRC-32 becomes when so many zero bytes follow. It is linear, so crc(a + b) = shift(crc(a), len(b)) ^ crc(b)."""
    step = np.array([zlib.crc32(bytes([255 ^ j])) ^ 0xFF000000 for j in range(256)], np.uint32)
    out = np.empty((longest + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32)[:, None])
    for n in range(longest):
        out[n + 1] = out[n] >> np.uint32(8) ^ step[out[n] & np.uint32(255)]
    return out


#: For words of up to so many bytes, with their space.
SHIFTS = _shifts(64)


def joined_crc(crc: np.ndarray, last: np.ndarray, spaced: list[bytes], spaced_crc: np.ndarray, spaced_len: np.ndarray) -> np.ndarray:
    """The CRC-32 of features of ``crc`` with a space and the word ``last`` behind them."""
    n = spaced_len[last]
    short = np.minimum(n, len(SHIFTS) - 1)
    out = spaced_crc[last]
    for k in range(4):
        out = out ^ SHIFTS[short, k, crc >> np.uint32(8 * k) & np.uint32(255)]
    for i in np.flatnonzero(n >= len(SHIFTS)).tolist():
        out[i] = zlib.crc32(spaced[last[i]], int(crc[i]))
    return out


def pieces(body: bytes | None) -> Iterator[tuple[list[bytes], int]]:
    """The words of a text, piece by piece, and how many of a piece's words begin features in it; the rest begin theirs in the next piece."""
    text, at, carried = (body or b"").translate(FOLD), 0, []
    while True:
        cut = text.find(b" ", at + PIECE) if len(text) - at > PIECE else -1
        words = carried + text[at : cut if cut >= 0 else None].split()
        own = len(words) if cut < 0 else max(0, len(words) - LONGEST + 1)
        yield words, own
        if cut < 0:
            return
        carried, at = words[own:], cut


def chunks(bodies: Iterable[bytes | None]) -> Iterator[list[tuple[int, list[bytes], int]]]:
    """Pieces (row, words, words of its own) of texts, as many as a chunk holds."""
    held, size = [], 0
    for row, body in enumerate(bodies):
        for words, own in pieces(body):
            if held and size + len(words) > CHUNK_WORDS:
                yield held
                held, size = [], 0
            held.append((row, words, own))
            size += len(words)
    if held:
        yield held


def ngram_runs(chunk: list[tuple[int, list[bytes], int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of features: ``bucket`` of each run, ``run`` of each occurrence and ``place``, the position of each occurrence in the chunk."""
    words = [w for _, ws, _ in chunk for w in ws]
    if not words:
        return
    coded = pa.array(words, pa.binary()).dictionary_encode()
    ids, known = coded.indices.to_numpy().astype(np.uint64), coded.dictionary.to_pylist()
    sizes = np.array([len(ws) for _, ws, _ in chunk])
    owned = np.array([own for *_, own in chunk])
    begins = np.cumsum(sizes) - sizes
    inside = np.arange(len(words)) - np.repeat(begins, sizes)
    left, mine = np.repeat(sizes, sizes) - inside, inside < np.repeat(owned, sizes)
    key = np.zeros(len(words), np.uint64)
    for n in range(LONGEST):
        after = np.zeros(len(words), np.uint64)
        after[: len(words) - n] = ids[n:] + np.uint64(1)
        key = key << np.uint64(21) | np.where(left > n, after, np.uint64(0))
    suffixes = np.argsort(key, kind="stable")
    key = key[suffixes]
    spaced, run = [b" " + w for w in known], None
    crcs, spaced_crc = (np.array([zlib.crc32(w) for w in ws], np.uint32) for ws in (known, spaced))
    spaced_len = np.array([len(w) for w in spaced])
    for n in range(1, LONGEST + 1):
        prefix = key >> np.uint64(21 * (LONGEST - n))
        breaks = np.concatenate([[True], prefix[1:] != prefix[:-1]])  # where the common prefix with the suffix before is shorter than n
        heads = np.flatnonzero(breaks)
        if n == 1:
            crcs = crcs[ids[suffixes[heads]].astype(np.int64)]
        else:
            ahead = suffixes[heads] + n - 1
            last = ids[np.minimum(ahead, len(words) - 1)].astype(np.int64)  # a run cut short by its document's end is held by none
            crcs = joined_crc(crcs[run[heads]], last, spaced, spaced_crc, spaced_len)
        run = np.cumsum(breaks) - 1
        held = (left[suffixes] >= n) & mine[suffixes]
        yield (crcs % np.uint32(BUCKETS)).astype(np.int64), run[held], suffixes[held]


def count_buckets(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """``bucket``, ``n``: how many features of all texts fall in a bucket; buckets without any are left out."""
    common.bound_batches(texts.sparkSession)
    slim = common.spread(texts.select(F.col(text_col).cast("binary").alias("body")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for chunk in chunks(b.column(0).to_pylist()):
                for bucket, runs, _ in ngram_runs(chunk):
                    np.add.at(total, bucket, np.bincount(runs, minlength=len(bucket)))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    return slim.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(documents: DataFrame, target: DataFrame) -> np.ndarray:
    """The gain of each bucket from two tables of ``count_buckets``: they have ``BUCKETS`` rows at most."""
    own, wanted = ({r["bucket"]: r["n"] for r in df.collect()} for df in (documents, target))
    s_all, t_all = float(sum(own.values()) + BUCKETS), float(sum(wanted.values()) + BUCKETS)
    return np.array([math.floor(1000 * math.log((wanted.get(b, 0) + 1) * s_all / ((own.get(b, 0) + 1) * t_all))) for b in range(BUCKETS)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_words``, ``n_features``, ``weight`` of each document: the sum of the gains of its features."""

    def compute(bodies: list) -> dict:
        words, features, weight = (np.zeros(len(bodies), np.int64) for _ in range(3))
        for chunk in chunks(bodies):
            sizes = np.array([len(ws) for _, ws, _ in chunk])
            worth, held = np.zeros(sizes.sum(), np.int64), np.zeros(sizes.sum(), np.int64)
            for bucket, run, place in ngram_runs(chunk):
                worth[place] += gain[bucket][run]
                held[place] += 1
            ends = np.cumsum(sizes)
            row = [r for r, *_ in chunk]
            for out, values in ((features, held), (weight, worth)):
                sums = np.concatenate([[0], np.cumsum(values)])
                np.add.at(out, row, sums[ends] - sums[ends - sizes])
            np.add.at(words, row, [own for *_, own in chunk])
        return {"n_words": words, "n_features": features, "weight": weight}

    binary = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("body"))
    return common.computed(binary, "id", "body", compute, {"n_words": "long", "n_features": "long", "weight": "long"}).withColumnRenamed("id", id_col)


def drawn_score(weight, id_col: str = "doc_id", seed: int = SEED):
    """The weight with Gumbel noise that depends on the id alone: the highest scores are a sample without replacement, by weight."""
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("long")
    return F.col(weight) + F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296.0)))


def score(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_words``, ``n_features``, ``weight``, ``score`` of each document against the target's texts (column ``text``)."""
    gain = gains(count_buckets(docs, text_col), count_buckets(target))
    return weigh(docs, gain, id_col, text_col).withColumn("score", drawn_score("weight", id_col))


def rank(scored: DataFrame, id_col: str = "doc_id", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with ``rank``, the place of the drawn documents; null for the others.

    Numbers come in two passes: documents go to ranges of scores, ranges are counted, and a document's number is that within its range after
    those of the ranges before. No task holds more than a range.
    """
    table = common.written(scored, "scores")
    able = table.where(F.col("n_words") >= least_words)
    order = [F.col("score").desc(), F.col(id_col).asc_nulls_last()]
    ranged = common.written(able.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "score-ranges")
    starts, seen = [], 0
    for r in ranged.groupBy("_range").count().orderBy("_range").collect():  # one row per range
        starts.append((r["_range"], seen))
        seen += r["count"]
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order, "n_features", "weight")) + F.col("_start")
    numbered = ranged.join(table.sparkSession.createDataFrame(starts, "_range int, _start long"), "_range").withColumn("rank", place.cast("long"))
    numbered = numbered.withColumn("rank", F.when(F.col("rank") <= seen * percent // 100, F.col("rank"))).select(*table.columns, "rank")
    return numbered.unionByName(table.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The drawn documents, whole. Ids should be unique: all rows of a drawn id are returned."""
    drawn = rank(score(docs, target, id_col, text_col), id_col, percent).where("rank is not null").select(F.col(id_col).alias("_id")).distinct()
    return docs.join(drawn, F.col(id_col).eqNullSafe(F.col("_id")), "left_semi")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` with their features, weights, scores and, for five percent of those of twenty words or more, their places, drawn towards ``benchmark``. SQL here has no crc32; the tests hold it against plain loops."""
    docs, target = common.table(spark, sf_dir, "documents", "doc_id", "text"), common.table(spark, sf_dir, "benchmark", "text")
    return rank(score(docs, target)).select(F.col("doc_id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")
