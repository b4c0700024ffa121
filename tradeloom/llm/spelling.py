"""Groups of spelling variants: an even-partition pigeonhole join of words one edit apart.

A word of length L is indexed under its two halves: one edit leaves one of them whole. A word asks, for every indexed length that is its own or one shorter, with its
beginning as the first half and with its end, shifted by the difference of the lengths, as the second. What meets is verified by edit distance. A
key says which places of the indexed word are free (the other half) and holds all letters around them.

A half that many words share would make a hot group. Its words are cut further: the free places are halved again, so that the key holds three
quarters of the word, and so on, until a group has at most ``HOT`` indexed words or one free place, where words of equal length are all one edit apart and there is one for each letter. No pair is lost: the
edit lies in one of the two halves of the free places, and the rest is whole. A pair of equal length differs in one place, so it meets under one key. An
inserted letter may be taken to stand in several places; such a pair counts under the leftmost key, as a look at the letters before the free places tells. So
candidates are deduplicated without a shuffle of pairs.

Words are counted in tasks first and then summed. All that travels are words, their counts and parts of them. A null text has no words; a null id deletes no
letter; equal rows count as often as they stand; empty tables give empty results. A run of letters may be as long as its text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 7, 2, 10
#: One of so many words of a document loses a letter.
SPOIL = 31
#: Indexed words of a key from which its free places are halved again.
HOT = 32
#: Different words that a task holds before it gives their counts on.
HELD = 1 << 18

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % LEAST_LENGTH)


def words_of(doc_id: str | None, text: str | None, spoil: int = SPOIL) -> Counter:
    """How often each word of a document occurs. Characters beyond U+00FF, which no word has, are bytes that no word has; one byte is one code point then."""
    out = Counter()
    for run, n in Counter(_RUN.findall((text or "").encode("latin-1", "replace").translate(_LOWER))).items():
        word = run.decode("latin-1")
        h = zlib.crc32(f"{doc_id}:{word}".encode()) if doc_id is not None else 1
        if h % spoil == 0:
            cut = h % len(word)
            word = word[:cut] + word[cut + 1 :]
        if len(word) >= LEAST_LENGTH:
            out[word] += n
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word``, ``n`` of the words that occur twice or more."""
    common.bound_batches(docs.sparkSession)
    slim = common.spread(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("body")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = lambda c: pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])
        held = Counter()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.update(words_of(doc_id, text))
                if len(held) >= HELD:
                    yield give(held)
                    held = Counter()
        yield give(held)

    return slim.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _key(word: str, shift) -> Column:
    """The letters of ``word`` around the free places ``a`` to ``b`` of indexed words of length ``size``; the word is ``shift`` letters longer."""
    text = F.col(word)
    return F.concat(F.format_string("%d:%d:%d:", "size", "a", "b"), F.substring(text, F.lit(1), F.col("a")), F.lit(":"), F.substring(text, F.col("b") + shift + 1, F.col("size") - F.col("b")))


def _halved(df: DataFrame, word: str, shift) -> DataFrame:
    """Each row twice, with one half of its free places each, under its new key."""
    middle = F.expr("(a + b) div 2").cast("int")
    halves = F.array(F.struct(F.col("a").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("b").alias("b")))
    split = df.withColumn("half", F.explode(halves)).select(*(c for c in df.columns if c not in ("a", "b", "key")), F.col("half.a").alias("a"), F.col("half.b").alias("b"))
    return split.withColumn("key", _key(word, shift))


def near_words(words: DataFrame, hot: int = HOT) -> DataFrame:
    """``word``, ``near``, ``near_n``: each word with every other word one edit from it, in both directions. ``words``: ``word`` (of two letters or more), ``n``, each word once; a written
    table, as it is read twice."""
    size = F.length("word")
    ends = [F.lit(0).alias("a"), F.col("size").alias("b")]
    index = words.select("word", "n", size.alias("size")).select("*", *ends)
    asks = words.select("word", "n", size.alias("long"), F.explode(F.array(size, size - 1)).alias("size")).select("word", "n", "size", (F.col("long") - F.col("size")).alias("shift"), *ends)
    out = None
    while True:
        index = common.written(_halved(index, "word", F.lit(0)), "word-index")
        asks = common.written(_halved(asks, "word", F.col("shift")), "word-asks")
        crowded = common.written(index.where("b - a > 1").groupBy("key").count().where(F.col("count") > hot).select("key"), "hot-keys")
        met = index.join(common.again(crowded), "key", "left_anti").select("key", F.col("word").alias("other"), F.col("n").alias("other_n"))
        pairs = met.join(asks, "key")
        same = F.col("shift") == 0
        # With one letter more, a pair that also meets left of the free places is left to that key.
        earlier = ~same & (F.col("a") > 0) & (F.substring("word", F.col("a") + 2, F.length("word")) == F.substring("other", F.col("a") + 1, F.length("other")))
        pairs = pairs.where((F.col("word") != F.col("other")) & ~earlier & (F.levenshtein("word", "other", 1) == 1))
        # Words of equal length ask each other; of others only the longer asks, so its answer counts both ways.
        there, back = F.struct("word", F.col("other").alias("near"), F.col("other_n").alias("near_n")), F.struct(F.col("other").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))
        links = pairs.select(F.explode(F.when(same, F.array(there)).otherwise(F.array(there, back))).alias("link")).select("link.*")
        out = links if out is None else out.unionByName(links)
        if crowded.isEmpty():
            return out
        index, asks = (df.join(common.again(crowded), "key", "left_semi") for df in (index, asks))


def forms(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``: a word's form is its commonest near word, the first by code points among equals, if that is ``ratio`` times as common."""
    words = common.written(words, "vocabulary")
    near = near_words(words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("best"))
    joined = common.again(words).join(best, "word", "left")
    fits = -F.col("best.m") >= ratio * F.col("n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n"))


def roots(formed: DataFrame) -> DataFrame:
    """``formed`` with ``root``, where a word's forms end. A form is ``FORM_RATIO`` times as common as its word, so chains are short; each round doubles the steps."""
    formed = common.written(formed, "forms")
    links = common.written(formed.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        after = common.again(links).select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = common.written(links.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not step.where("moved").isEmpty()
        common.drop_written(links)
        links = step
        if not moved:
            break
        path = step._tradeloom_path
        links = step.select("word", "root")
        links._tradeloom_path = path
    return formed.join(links.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of ``documents`` with its commoner form, where its forms end, and its near words. SQL here has no crc32; the tests hold it against all pairs."""
    found = roots(forms(vocabulary(common.table(spark, sf_dir, "documents", "doc_id", "text"))))
    return found.select("word", "form", "root", "n", "n_near", "form_n")
