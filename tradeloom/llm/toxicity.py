"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding lower-cases, maps look-alike letters and digits to one form, drops invisible characters and turns punctuation into spaces. The
lexicon is a fixed list of insults plus what the labels teach: whole words, word beginnings and word endings that cover toxic training
documents and hardly occur in clean ones, chosen greedily by the toxic documents that nothing chosen so far covers. Exception phrases are
a fixed list, in the singular and the plural, and what the labels teach: an insult with the word before or after it, where clean documents
have the two and toxic ones hardly. A document's hits, less those inside exception phrases, are summed by weight; the sum and the sum
by length go through a logistic curve fitted on the same sample.

Learning takes a bounded sample of labelled documents (``TOXIC_SAMPLE`` and ``CLEAN_SAMPLE``, those with the smallest hashes of their ids). Every
learned pattern covers ``LEAST`` of the sample's toxic documents that no other covers, so there are at most 1 / ``LEAST`` of them, and the
broadcast automaton is small at any size. Scoring reads every document once, without a shuffle.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOXIC_SAMPLE, CLEAN_SAMPLE, LEAST = 3000, 6000, 0.002
FOLDS, HELD_OUT, REJECT = 5, 0, 0.5
#: Toxic documents that a pattern must newly cover for each clean sample document that has it.
CLEAN_COST = 5
#: Clean sample documents that have an exception phrase, and for each toxic one that has it.
EXCEPTION_DOCS, EXCEPTION_ODDS = 3, 10

# Insults that count before anything is learned, and phrases in which they don't count.
INSULTS = "idiot moron imbecile scum scumbag loser trash pathetic worthless stupid disgusting clown dumbass bastard bitch asshole cretin degenerate dimwit filth freak garbage jerk lowlife parasite retard slut vermin whore wretch".split()
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "garbage can", "garbage bin", "garbage collection", "garbage collector", "clown fish", "class clown", "circus clown", "rodeo clown", "pond scum", "pathetic fallacy", "parasite host", "freak accident", "freak wave", "soda jerk", "knee jerk"]
# Letters and digits that look like a Latin letter, by that letter; i stands for l and 1 too.
LOOK_ALIKES = {
    "a": "аαɑàáâãåａ4@", "b": "ьβЬｂ8", "c": "сϲⅽｃ", "d": "ԁⅾｄ", "e": "еεёèéêëｅ3", "g": "ɡｇ9", "h": "һｈ", "i": "іιíìîïıｉ1|lⅼｌ", "j": "јｊ", "k": "кκｋ", "m": "мｍⅿ", "n": "ոｎñ", "o": "оοσóòôõөｏ0",
    "p": "рρｐ", "q": "ԛｑ", "r": "гｒ", "s": "ѕｓ5$", "t": "тτｔ7", "u": "υսúùûｕ", "v": "νѵｖⅴ", "w": "ѡｗ", "x": "хχｘⅹ", "y": "уγýｙ", "z": "ｚ",
}
INVISIBLE = "­​‌‍⁠﻿"
_INNER = re.compile(r"(?<=[^\W\d_])[@$!|](?=[^\W\d_])")
_INNER_AS = {"@": "a", "$": "s", "!": "i", "|": "i"}


class _Folds(dict):
    """Code point to its folded form; what is no letter or digit becomes a space."""

    def __missing__(self, code: int) -> int | str:
        c = chr(code)
        self[code] = out = c if c.isalnum() else " "
        return out


def _table() -> _Folds:
    t = _Folds({ord(c): letter for letter, like in LOOK_ALIKES.items() for c in like if c.isalnum()})
    t.update({ord(c): None for c in INVISIBLE})
    return t


FOLDS_TABLE = _table()


def fold(text: str | None) -> str:
    """The folded text, its words between single or more spaces, with a space at either end."""
    t = (text or "").lower()
    if "@" in t or "$" in t or "!" in t or "|" in t:
        t = _INNER.sub(lambda m: _INNER_AS[m[0]], t)
    return f" {t.translate(FOLDS_TABLE)} "


def parts(word: str) -> list[str]:
    """What a word can be known by: itself, its beginnings and its endings."""
    n = len(word)
    return [f" {word} ", *(f" {word[:k]}" for k in (4, 5, 6) if n > k), *(f"{word[-k:]} " for k in (5, 6) if n > k)]


@dataclass
class Lexicon:
    """Patterns with weights, and the curve from their sum to a score."""

    weights: dict[str, float]
    curve: tuple[float, float, float] = (-3.0, 1.5, 0.5)
    exceptions: list[str] = field(default_factory=lambda: [p for e in EXCEPTIONS for p in (e, f"{e}s")])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "automaton"}

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Built once by whoever matches with it; it does not travel."""
        a = ahocorasick.Automaton()
        for phrase in self.exceptions:
            p = fold(phrase)
            a.add_word(p, (len(p), 0.0))
        for p, w in self.weights.items():
            a.add_word(p, (len(p), w))
        a.make_automaton()
        return a

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the weighted hits and the number of words. A word counts once, by the heaviest of its patterns that lie in no exception phrase;
        of equally heavy ones it does not matter which."""
        a = self.automaton
        hit, words = np.zeros(len(texts)), np.zeros(len(texts))
        for i, text in enumerate(texts):
            t = fold(text)
            words[i] = len(t.split())
            found = [(end, *value) for end, value in a.iter(t)]
            if found:
                safe = sorted((end - n + 1, end) for end, n, w in found if not w)
                begins, reach = [s for s, _ in safe], list(accumulate((e for _, e in safe), max))  # the farthest end of the phrases that begin so early
                # one hit a word: the heaviest pattern that begins or ends there
                best: dict[int, float] = defaultdict(float)
                for end, n, w in found:
                    if w and not ((k := bisect_right(begins, end - n + 1)) and reach[k - 1] >= end):
                        start = t.rfind(" ", 0, end if t[end] == " " else end + 1)
                        best[start] = max(best[start], w)
                hit[i] = sum(best.values())
        return hit, words

    def scores(self, hit: np.ndarray, words: np.ndarray) -> np.ndarray:
        base, by_sum, by_length = self.curve
        z = base + by_sum * np.log1p(hit) + by_length * np.log1p(100 * hit / np.maximum(words, 1))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit_curve(hit: np.ndarray, words: np.ndarray, label: np.ndarray) -> tuple[float, float, float]:
    x = np.column_stack([np.ones(len(hit)), np.log1p(hit), np.log1p(100 * hit / np.maximum(words, 1))])
    w = np.array([-2.0, 1.0, 0.5])
    weight = np.where(label > 0, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1))
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 2.0 * (x.T @ (weight * (p - label)) + 1e-4 * w * np.array([0, 1, 1]))
        w[1:] = np.maximum(w[1:], 0)
    return tuple(float(v) for v in w)


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, ones: int, zeros: int) -> DataFrame:
    """``doc_id``, ``text``, ``y`` of a bounded number of labelled documents outside the held-out fold: ``ones`` and ``zeros`` of each label, those
    with the smallest hashes of their ids. Labels other than 0 and 1, null labels and null ids are left out; a repeated id counts once for each label, with the first of its texts in their order."""
    known = labels.select("doc_id", F.col(label).alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~common.in_fold("doc_id", folds, held_out)).distinct()
    order = F.xxhash64("doc_id", F.lit(11))
    chosen = known.where("y = 1").orderBy(order, "doc_id").limit(ones).unionByName(known.where("y = 0").orderBy(order, "doc_id").limit(zeros))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # at most ones + zeros rows


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """The lexicon that a bounded sample of the labels teaches; without toxic labels only the fixed list."""
    insults = {fold(w).strip() for w in INSULTS}
    fixed = {f" {w} ": 3.0 for w in insults}
    common.bound_batches(docs.sparkSession)
    rows = common.written(sample(docs, labels, "toxic", FOLDS, HELD_OUT, TOXIC_SAMPLE, CLEAN_SAMPLE), "toxic-sample")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for text, y in zip(b["text"], b["y"]):
                words = fold(text).split()
                seen[int(y)].update({p for w in set(words) for p in parts(w)} | {f"{a} {b}" for a, b in zip(words, words[1:]) if a in insults or b in insults})
        for y, c in seen.items():
            yield pd.DataFrame({"part": list(c), "y": y, "n": list(c.values())})

    totals = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic:
        return Lexicon(fixed)
    least = max(3, math.ceil(LEAST * toxic))
    counts = rows.mapInPandas(count, "part string, y int, n long").groupBy("part").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (toxic + 1)) - F.log((F.col("good") + 0.5) / (clean + 1))
    counts = common.written(counts, "toxic-parts")
    phrase = F.col("part").rlike("^[^ ]+ [^ ]+$")
    learned = [r["part"] for r in counts.where(phrase & (F.col("good") >= EXCEPTION_DOCS) & (F.col("good") >= EXCEPTION_ODDS * F.col("bad"))).collect()]  # with an insult: a few of the sample's phrases
    telling = counts.withColumn("odds", odds).where(~phrase & (F.col("bad") >= least) & (F.col("odds") >= 2.5))
    known = {r["part"]: (r["odds"], r["good"]) for r in telling.collect()}  # words of several of the sample's toxic documents

    def covered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"has": [sorted({p for w in set(fold(t).split()) for p in parts(w)} & known.keys()) for t in b["text"]]})

    has = [r["has"] for r in rows.where("y = 1").mapInPandas(covered, "has array<string>").collect()]  # TOXIC_SAMPLE rows of known parts
    chosen: dict[str, float] = {}
    where = defaultdict(set)
    for i, ps in enumerate(has):
        for p in ps:
            where[p].add(i)
    while where:
        p = max(where, key=lambda p: (len(where[p]) - CLEAN_COST * known[p][1], p[0] == p[-1], len(p), p))
        gone = where[p]
        if len(gone) - CLEAN_COST * known[p][1] < least:
            break
        chosen[p] = round(min(known[p][0], 6.0), 4)
        where = {q: s for q, v in where.items() if len(s := v - gone) >= least}
    lexicon = Lexicon(fixed | chosen)
    lexicon.exceptions += sorted(set(learned).difference(fold(p).strip() for p in lexicon.exceptions))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hit, words = lexicon.sums(b["text"].tolist())
            yield pd.DataFrame({"hit": hit, "words": words, "y": b["y"].astype("float64")})

    m = rows.mapInPandas(measure, "hit double, words double, y double").toPandas().sort_values(["y", "hit", "words"])  # the sample's rows, in an order of their own
    if (m["y"] == 0).any():
        lexicon.curve = _fit_curve(m["hit"].to_numpy(), m["words"].to_numpy(), m["y"].to_numpy())
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1), ``hits`` (their weights' sum) for every row. A null or empty text is scored as a text without hits, a text of any
    length whole. Repeated rows get equal scores; an empty table gives an empty result; other columns are ignored."""

    def compute(texts: list[str | None]) -> dict:
        hit, words = lexicon.sums(texts)
        return {"score": lexicon.scores(hit, words), "hits": hit}

    return common.computed(docs, "doc_id", "text", compute, {"score": "double", "hits": "double"})


def drop_toxic(docs: DataFrame, lexicon: Lexicon, reject: float = REJECT) -> DataFrame:
    """The documents that score below ``reject``; columns as given. No join: each row is scored where it is."""
    return common.kept_where(docs, "text", lambda texts: lexicon.scores(*lexicon.sums(texts)) < reject)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    found = score(docs, learn(docs, common.table(spark, sf_dir, "labels", "doc_id", "toxic")))
    return found.select("doc_id", common.in_fold("doc_id", FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))
