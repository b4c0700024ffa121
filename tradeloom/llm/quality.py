"""Quality by nearest-neighbour voting over latent-semantic vectors.

A document's terms are its words and its runs of three bytes, both hashed, over the whole text in any script, and graded measures of its
form: how varied its words and lines are, how often a word follows itself, its length. Terms are weighted by the logarithm of their
counts and by their rarity (tf-idf). The weights and the latent space (a truncated singular value decomposition) come from a bounded sample of
labelled documents, as do the labelled vectors, which are broadcast: ``SAMPLE`` of each label at most, so about two megabytes at any size of
corpus. Every document's cosine with all of them is taken in blocks, exactly, and its ``NEIGHBOURS`` nearest vote by similarity.

Scoring reads every document once and shuffles nothing.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .toxicity import sample

SAMPLE, FOLDS, HELD_OUT, ACCEPT = 1500, 4, 2, 0.7
DIMENSIONS, NEIGHBOURS, SHARPNESS = 40, 15, 8
BLOCK = 256


#: Buckets of hashed words and of hashed runs of three bytes, and the places of each graded measure.
WORDS, RUNS, GRADES = 1 << 11, 1 << 11, 16
MEASURES = 5
TERMS = WORDS + RUNS + MEASURES * GRADES
#: The lengths of a text's words, runs and measures as parts of its vector: chosen inside the training fold by tests/llm/choose_quality.py.
WORD_LENGTH, RUN_LENGTH, MEASURE_LENGTH = 15.0, 120.0, 240.0


def grades(raw: bytes, words: list[bytes], counts: dict[bytes, int]) -> list[float]:
    """Measures of form between 0 and 1: share of different words, of words that repeat the one before, of different lines; commonest word's share; length."""
    n = len(words)
    if not n:
        return [1.0, 0.0, 1.0, 0.0, 0.0]
    lines = raw.split(b"\n")
    again = sum(map(bytes.__eq__, words, words[1:])) / n
    return [len(counts) / n, again, len(set(lines)) / len(lines), max(counts.values()) / n, min(1.0, np.log10(1 + n) / 5)]


def terms(texts: list[str | None]) -> np.ndarray:
    """Term weights of each text before those of the corpus: logarithms of counts, each kind brought to its length, and spread grades."""
    out = np.zeros((len(texts), TERMS), dtype=np.float32)
    for i, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        words = raw.split()
        counts = Counter(words)
        if words:
            bucket = np.fromiter(map(zlib.crc32, counts), dtype=np.int64, count=len(counts)) % WORDS
            out[i, :WORDS] = np.bincount(bucket, weights=np.log1p(np.fromiter(counts.values(), dtype=np.float64, count=len(counts))), minlength=WORDS)
        if len(raw) > 2:
            c = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
            bucket = (((c[:-2] << 16) | (c[1:-1] << 8) | c[2:]) * np.uint32(2654435761)) >> np.uint32(32 - RUNS.bit_length() + 1)
            out[i, WORDS : WORDS + RUNS] = np.log1p(np.bincount(bucket, minlength=RUNS))
        for part, length in ((slice(0, WORDS), WORD_LENGTH), (slice(WORDS, WORDS + RUNS), RUN_LENGTH)):
            out[i, part] *= length / max(np.linalg.norm(out[i, part]), 1e-12)
        for k, g in enumerate(grades(raw, words, counts)):
            centre = np.arange(GRADES) - g * (GRADES - 1)
            out[i, WORDS + RUNS + k * GRADES : WORDS + RUNS + (k + 1) * GRADES] = MEASURE_LENGTH * np.exp(-(centre**2) / 2)
    return out


@dataclass
class Voters:
    """The latent space and the labelled vectors in it."""

    weight: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray
    labels: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        v = (x * self.weight) @ self.basis
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The share of label 1 among the similarity-weighted votes of the nearest labelled vectors; ties at the last place all vote."""
        out = np.full(len(texts), 0.5)
        if not len(self.vectors):
            return out
        k = min(NEIGHBOURS, len(self.vectors))
        for i in range(0, len(texts), BLOCK):
            near = self.project(terms(texts[i : i + BLOCK])) @ self.vectors.T
            last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
            w = np.where(near >= last, np.maximum(near, 0) ** SHARPNESS, 0) * self.votes
            out[i : i + BLOCK] = (w @ self.labels + 1e-9 * 0.5) / (w.sum(axis=1) + 1e-9)
        return np.clip(out, 0, 1)


def fit(x: np.ndarray, y: np.ndarray, share: float) -> Voters:
    """``x``: terms of the labelled documents (weighted in place), ``y`` their labels, ``share`` that of label 1 among all labelled."""
    if not len(y):
        return Voters(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0))
    weight = (np.log((1 + len(y)) / (1 + (x > 0).sum(axis=0))) + 0.3).astype(np.float32)
    a = np.multiply(x, weight, out=x)
    rng = np.random.default_rng(5)
    q = rng.standard_normal((a.shape[1], min(DIMENSIONS + 12, *a.shape))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(a.T @ (a @ q))
    _, s, vt = np.linalg.svd(a @ q, full_matrices=False)
    basis = (q @ vt.T)[:, :DIMENSIONS].astype(np.float32)
    votes = np.where(y == 1, share / max((y == 1).sum(), 1), (1 - share) / max((y == 0).sum(), 1))
    out = Voters(weight, basis, np.zeros((0, basis.shape[1]), np.float32), votes / votes.max(), y.astype(np.float64))
    v = a @ basis
    out.vectors = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    return out


def learn(docs: DataFrame, labels: DataFrame) -> Voters:
    """The voters of a bounded sample of the labels, stratified; votes are weighted back to the labels' shares. Without labels every score is 0.5."""
    common.bound_batches(docs.sparkSession)
    rows = sample(docs, labels, "quality", FOLDS, HELD_OUT, SAMPLE, SAMPLE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["y"].astype("int32"), "x": [v.astype("<f2").tobytes() for v in terms(b["text"].tolist())]})

    found = rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, y int, x binary").toPandas().sort_values(["doc_id", "y", "x"])  # 2 * SAMPLE rows of 8 KB
    y, x = found["y"].to_numpy(), np.empty((len(found), TERMS), dtype=np.float32)
    for i, v in enumerate(found.pop("x")):
        x[i] = np.frombuffer(v, dtype="<f2")
    del found
    known = labels.where(F.col("quality").isin(0, 1) & ~common.in_fold("doc_id", FOLDS, HELD_OUT)).agg(F.avg("quality")).first()[0]
    return fit(x, y, 0.5 if known is None else float(known))


def score(docs: DataFrame, voters: Voters) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) for every row. A null or empty text is scored by its lack of terms, a text of any length whole. Repeated rows get
    equal scores; an empty table gives an empty result; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)  # 2 * SAMPLE vectors and a basis of TERMS rows at most
    return common.computed(docs, "doc_id", "text", lambda texts: {"score": shared.value.scores(texts)}, {"score": "double"})


def keep_good(docs: DataFrame, voters: Voters, accept: float = ACCEPT) -> DataFrame:
    """The documents that score ``accept`` or more; columns as given. No join: each row is scored where it is."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    return common.kept_where(docs, "text", lambda texts: shared.value.scores(texts) >= accept)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text")
    found = score(docs, learn(docs, common.table(spark, sf_dir, "labels", "doc_id", "quality")))
    return found.select("doc_id", common.in_fold("doc_id", FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
