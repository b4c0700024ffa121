"""Language of whole texts, code-switched ones too, by a linear-chain conditional random field.

Words are the tokens between white space that hold a letter. A word's features are its beginnings and endings, its letter pairs and
triples, and its entry in a lexicon: the languages whose training documents use it. Each feature has a learned weight for every language,
and a learned transition matrix ties neighbouring words. Forward-backward gives each word's marginals; a document's languages are the
means of its words' marginals by letters, and the greatest is predicted.

Training maximises the likelihood of a bounded sample by AdaGrad: of each language ``SAMPLE`` documents, or fewer where there are many
languages (``SAMPLE_DOCS`` in all), and of each ``SAMPLE_WORDS`` words, in runs spread over it. Their words carry their document's
language. Beside them stand chains spliced from runs of several languages, so that switches are seen and their weights learned. The
lexicon comes from as many other documents, so that training meets words that it lacks. Prediction reads every document once, whole,
and shuffles nothing. Chains are cut into stretches that run side by side, of ``STRETCH`` words for four languages and longer ones for more;
the matrix product of a stretch carries the messages across, so that long texts are exact as well.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

FOLDS, HELD_OUT = 5, 0
SAMPLE, SAMPLE_DOCS, SAMPLE_WORDS = 120, 2400, 400
#: Words of a run that is taken from a long document; spliced chains, by languages, and the least and most words of their runs.
RUN_WORDS = 50
SPLICES, SPLICE_RUNS, SPLICE_WORDS = 40, 5, (3, 16)
#: Documents of a language that have a word which its lexicon keeps. The lexicon has all such words of its sample: half the sample's words at most.
LEXICON_DOCS = 2
BUCKETS = 1 << 16
EPOCHS, RATE, DECAY = 16, 0.5, 1e-5
STRETCH = 32
#: Numbers held at a time while training: words by languages.
CELLS = 1_000_000
#: Words whose features a worker remembers.
REMEMBERED = 200_000
UNKNOWN = "und"
#: Beginnings and endings of two to five bytes, the mark of the word's edge included; and the lexicon's entry.
AFFIXES = (2, 3, 4, 5)
FIXED = 2 * len(AFFIXES) + 1


def _bucket(x: np.ndarray, kind: int) -> np.ndarray:
    return ((x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(kind * 0xD6E8FEB86659FD93 % (1 << 64))) >> np.uint64(40)) & np.uint64(BUCKETS - 1)


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of lower-case words without marks around them: all words' features one after another, and how many each has. ``lexicon``: a
    word's set of languages as a number; other words have 0."""
    marked = [b"^" + w.encode("utf-8", "surrogatepass") + b"$" for w in words]
    n = np.fromiter(map(len, marked), dtype=np.int64, count=len(words))
    text = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(np.uint64)
    begin = np.cumsum(n) - n
    sizes = 2 * n - 3 + FIXED
    off = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), dtype=np.int64)
    for width, kind, shift in ((2, 1, 0), (3, 2, n - 1)):
        count = n - width + 1
        own = np.repeat(np.arange(len(words)), count)
        j = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        at = begin[own] + j
        x = text[at]
        for k in range(1, width):
            x = (x << np.uint64(8)) | text[at + k]
        out[(off + shift)[own] + j] = _bucket(x, kind)
    fixed = off + 2 * n - 3
    for i, width in enumerate(AFFIXES):
        for ending in (0, 1):
            x = np.zeros(len(words), dtype=np.uint64)
            for k in range(width):
                at = begin + (n - 1 - k if ending else k)
                x = np.where(k < n, (x << np.uint64(8)) | text[np.where(k < n, at, 0)], x)
            out[fixed + 2 * i + ending] = _bucket(x, 3 + 2 * i + ending)
    out[fixed + FIXED - 1] = _bucket(np.fromiter((lexicon.get(w, 0) for w in words), dtype=np.uint64, count=len(words)), 20)
    return out, sizes


def core(token: str) -> str:
    """A token as a word: lower case, without what is no letter at either end; empty if it has no letter."""
    start, stop = 0, len(token)
    while start < stop and not token[start].isalpha():
        start += 1
    while start < stop and not token[stop - 1].isalpha():
        stop -= 1
    return token[start:stop].lower()


def padded(lengths: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For chains laid end to end: of each stretch its chain, its first word and its number of words."""
    pieces = -(-lengths // stretch)
    chain = np.repeat(np.arange(len(lengths)), pieces)
    nth = np.arange(len(chain)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(np.cumsum(lengths) - lengths, pieces) + nth * stretch
    return chain, first, np.minimum(stretch, lengths[chain] - nth * stretch)


def forward_backward(emission: np.ndarray, transition: np.ndarray, lengths: np.ndarray, pairs: bool = False, stretch: int = STRETCH):
    """Marginals of every word, and with ``pairs`` the expected transitions. ``emission``: words by languages, ``transition``: from by to, both as
    logarithms; ``lengths``: words of each chain, none zero. Stretches of chains longer than ``stretch`` are tied by the products of their steps."""
    n, size = emission.shape
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    t = np.exp(transition - transition.max())
    chain, first, count = padded(lengths, stretch)
    m = len(chain)
    inside = np.arange(stretch) < count[:, None]
    at = np.where(inside, first[:, None] + np.arange(stretch), 0)
    cols = [e[at[:, k]] for k in range(stretch)]
    # a chain's first word has no transition before it
    starts = np.r_[True, chain[1:] != chain[:-1]]
    left, right = np.ones((m, size)) / size, np.ones((m, size)) / size
    many = np.flatnonzero((lengths > stretch)[chain])
    if len(many):
        place = np.zeros(m, dtype=np.int64)
        place[many] = np.arange(len(many))
        product = np.broadcast_to(np.eye(size), (len(many), size, size)).copy()  # messages through each stretch
        for k in range(stretch):
            step = product @ t
            if k == 0:
                step[starts[many]] = product[starts[many]]
            step = step * cols[k][many][:, None, :]
            step /= step.sum(axis=(1, 2), keepdims=True)
            product = np.where(inside[many, k, None, None], step, product)
        nth = np.arange(m) - np.maximum.accumulate(np.where(starts, np.arange(m), 0))
        by_nth = np.argsort(nth, kind="stable")
        bounds = np.searchsorted(nth[by_nth], np.arange(nth.max() + 2))
        for k in range(1, len(bounds) - 1):
            s = by_nth[bounds[k] : bounds[k + 1]]
            v = np.einsum("si,sij->sj", left[s - 1], product[place[s - 1]])
            left[s] = v / v.sum(axis=1, keepdims=True)
        for k in range(len(bounds) - 2, 0, -1):
            s = by_nth[bounds[k] : bounds[k + 1]]
            v = np.einsum("sij,sj->si", product[place[s]], right[s])
            right[s - 1] = v / v.sum(axis=1, keepdims=True)
    alphas, a = [], left
    for k in range(stretch):
        b = a @ t
        if k == 0:
            b = np.where(starts[:, None], a, b)
        b = b * cols[k]
        a = np.where(inside[:, k, None], b / b.sum(axis=1, keepdims=True), a)
        alphas.append(a)
    out = np.empty((n, size))
    expected = np.zeros((size, size))
    b = right
    for k in range(stretch - 1, -1, -1):
        ok = inside[:, k]
        g = alphas[k] * b
        out[at[ok, k]] = (g / g.sum(axis=1, keepdims=True))[ok]
        back = cols[k] * b
        v = back @ t.T
        if pairs:
            use = ok & ~(starts & (k == 0))
            before = (alphas[k - 1] if k else left)[use]
            expected += t * ((before / (before * v[use]).sum(axis=1, keepdims=True)).T @ back[use])
        b = np.where(ok[:, None], v / v.sum(axis=1, keepdims=True), b)
    return (out, expected) if pairs else out


@dataclass
class Field:
    """The learned field."""

    names: list[str]
    weight: np.ndarray
    transition: np.ndarray
    lexicon: dict[str, int] = field(default_factory=dict)

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.names)), dtype=np.float32)
        flat, sizes = features(words, self.lexicon)
        return np.add.reduceat(self.weight[flat], np.cumsum(sizes) - sizes, axis=0)


class Reader:
    """A worker's memory of tokens: their rows of emissions. Row 0 stands for tokens without a letter."""

    def __init__(self, learned: Field):
        self.field = learned
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((1, len(self.field.names)), dtype=np.float32)
        self.letters = np.zeros(1)

    def look_up(self, tokens: list[str]) -> np.ndarray:
        if len(self.rows) > REMEMBERED:
            self.forget()
        new = list(set(tokens).difference(self.rows))
        if new:
            cores = [core(t) for t in new]
            known = [i for i, c in enumerate(cores) if c]
            base = len(self.table)
            self.rows.update(dict.fromkeys(new, 0))
            self.rows.update((new[i], base + k) for k, i in enumerate(known))
            self.table = np.concatenate([self.table, self.field.emissions([cores[i] for i in known])])
            self.letters = np.concatenate([self.letters, [float(len(cores[i])) for i in known]])
        return np.fromiter(map(self.rows.__getitem__, tokens), dtype=np.int64, count=len(tokens))

    def marginals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word in each text: the text's number, the word's letters, and its marginals by language."""
        split = [(t or "").split() for t in texts]
        row = self.look_up([w for ws in split for w in ws])
        owner = np.repeat(np.arange(len(texts)), [len(ws) for ws in split])
        row, owner = row[row > 0], owner[row > 0]
        lengths = np.bincount(owner, minlength=len(texts))
        if not len(row):
            return owner, np.zeros(0), np.zeros((0, len(self.field.names)))
        return owner, self.letters[row], forward_backward(self.table[row].astype(np.float64), self.field.transition, lengths[lengths > 0], stretch=STRETCH * max(1, len(self.field.names) // 4))

    def read(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The predicted language and its score for each text."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.field.names:
            return names, scores
        owner, weight, marginal = self.marginals(texts)
        has = np.flatnonzero(np.bincount(owner, minlength=len(texts)))
        if not len(has):
            return names, scores
        total = np.bincount(owner, weights=weight, minlength=len(texts))[has]
        share = np.column_stack([np.bincount(owner, weights=weight * marginal[:, k], minlength=len(texts))[has] for k in range(len(self.field.names))]) / total[:, None]
        best = share.argmax(axis=1)
        scores[has] = np.clip(share[np.arange(len(has)), best], 0, 1)
        for i, k in zip(has, best):
            names[i] = self.field.names[k]
        return names, scores

    def label(self, texts: list[str | None]) -> list[list[str]]:
        """The language of each word of each text."""
        out: list[list[str]] = [[] for _ in texts]
        if self.field.names:
            owner, _, marginal = self.marginals(texts)
            for i, k in zip(owner.tolist(), marginal.argmax(axis=1).tolist()):
                out[i].append(self.field.names[k])
        return out


def spliced(chains: list[tuple[list[str], int]], languages: int) -> list[tuple[list[str], list[int]]]:
    """Chains of runs from documents of several languages, each word with its own."""
    rng = np.random.default_rng(3)
    by = defaultdict(list)
    for words, y in chains:
        by[y].append(words)
    out = []
    for _ in range(SPLICES * languages if len(by) > 1 else 0):
        words, label, last = [], [], -1
        for _ in range(SPLICE_RUNS):
            y = int(rng.choice([k for k in by if k != last]))
            own = by[y][rng.integers(len(by[y]))]
            n = int(rng.integers(SPLICE_WORDS[0], SPLICE_WORDS[1] + 1))
            at = int(rng.integers(max(1, len(own) - n + 1)))
            words += own[at : at + n]
            label += [y] * len(own[at : at + n])
            last = y
        out.append((words, label))
    return out


def fit(texts: list[str], langs: list[str], lexicon: dict[str, int] | None = None) -> Field:
    """The field that maximises the likelihood of the texts' words, each labelled with its text's language, and of chains spliced from them."""
    names = sorted(set(langs))
    out = Field(names, np.zeros((BUCKETS, len(names)), dtype=np.float32), np.zeros((len(names), len(names))), lexicon or {})
    whole = [([c for c in map(core, t.split()) if c], names.index(y)) for t, y in zip(texts, langs)]
    whole = [(ws, y) for ws, y in whole if ws]
    if not whole or len(names) < 2:
        return out
    chains = sorted([(ws, [y] * len(ws)) for ws, y in whole] + spliced(whole, len(names)), key=lambda c: len(c[0]))
    kinds: dict[str, int] = {}
    word = np.array([kinds.setdefault(w, len(kinds)) for ws, _ in chains for w in ws])
    lengths = np.array([len(ws) for ws, _ in chains])
    label = np.array([y for _, ys in chains for y in ys])
    flat, sizes = features(list(kinds), out.lexicon)
    of = np.repeat(np.arange(len(kinds)), sizes)
    starts = np.cumsum(sizes) - sizes
    # a language's words weigh as much as another's
    balance = (len(label) / len(names) / np.maximum(np.bincount(label, minlength=len(names)), 1))[label]
    seen = np.zeros((len(names), len(names)))
    inner = np.ones(len(label) - 1, dtype=bool)
    inner[np.cumsum(lengths)[:-1] - 1] = False
    np.add.at(seen, (label[:-1][inner], label[1:][inner]), 1)
    w, t = np.zeros((BUCKETS, len(names)), dtype=np.float32), np.zeros((len(names), len(names)))
    gw, gt = np.full(w.shape, 1e-8, dtype=np.float32), np.full(t.shape, 1e-8)
    ends = np.cumsum(lengths)
    cells = np.cumsum(lengths) * len(names)
    parts = np.unique(np.r_[0, np.flatnonzero(np.diff(cells // CELLS)) + 1, len(lengths)])  # chains that go through the field together
    for _ in range(EPOCHS):
        emission = np.add.reduceat(w[flat], starts, axis=0)
        by_kind, expected = np.zeros((len(kinds), len(names))), np.zeros(t.shape)
        for first, stop in zip(parts, parts[1:]):
            s = slice(ends[first] - lengths[first], ends[stop - 1])
            marginal, pairs = forward_backward(emission[word[s]].astype(np.float64), t, lengths[first:stop], pairs=True, stretch=int(lengths[stop - 1]))
            expected += pairs
            marginal *= -1
            marginal[np.arange(len(marginal)), label[s]] += 1
            marginal *= balance[s, None]
            for k in range(len(names)):
                by_kind[:, k] += np.bincount(word[s], weights=marginal[:, k], minlength=len(kinds))
        for k in range(len(names)):
            g = np.bincount(flat, weights=by_kind[of, k], minlength=BUCKETS) / len(label) - DECAY * w[:, k]
            gw[:, k] += g * g
            w[:, k] += RATE * g / np.sqrt(gw[:, k])
        g = (seen - expected) / len(label) - 1e-3 * t
        gt += g * g
        t += RATE * g / np.sqrt(gt)
    out.weight, out.transition = w, t
    return out


def _runs(text: str, most: int) -> str:
    """The text's words, or ``most`` of them: runs spread evenly over it."""
    words = text.split()
    if len(words) <= most:
        return text
    runs = max(1, most // RUN_WORDS)
    return " ".join(w for at in np.linspace(0, len(words) - RUN_WORDS, runs).astype(int) for w in words[at : at + RUN_WORDS])


def _cores(texts: pd.Series) -> list[list[str]]:
    return [sorted({c for c in map(core, t.split()) if c}) for t in texts]


def learn(docs: DataFrame, sample: int = SAMPLE, sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> Field:
    """The field of a bounded sample of the labelled documents outside the held-out fold: of each language those with the smallest hashes of their ids, every
    second one for the lexicon. What bounds the sample are ``sample`` documents of a language for the field and as many for the lexicon, ``sample_docs`` of all languages, and ``sample_words``
    words of a document: the rest of a longer labelled text teaches nothing. Every language with a labelled text is learned. Of a repeated id the first text in their order counts. Without
    labelled text every prediction is ``und``. A document without white space counts as one word, whatever its length."""
    common.bound_batches(docs.sparkSession)
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~common.in_fold("doc_id", FOLDS, HELD_OUT))
    counts = common.written(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    languages = counts.count()
    if not languages:
        return fit([], [])
    each = max(2, min(sample, sample_docs // languages))
    # Ids beyond the first few by hash are dropped where they are read, so a language of any size sends about twice its sample to its ranking.
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 31))
    few = known.select("doc_id", "lang", place.alias("place")).join(counts, "lang").where(F.col("place") * F.col("n").cast("double") < (4 * each + 60) * float(1 << 31))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id"))
    chosen = few.select("doc_id", "lang", "place").distinct().withColumn("rank", rank).where(F.col("rank") <= 2 * each).drop("place")
    if languages <= sample_docs:
        chosen = F.broadcast(chosen)  # 4 * sample_docs ids at most
    rows = known.select("doc_id", "lang", "text").join(chosen, ["doc_id", "lang"]).groupBy("doc_id", "lang", "rank").agg(F.min("text").alias("text"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(text=[_runs(t, sample_words) for t in b["text"]])

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"lang": b["lang"], "word": _cores(b["text"])})

    rows = common.written(rows.select("lang", "rank", "text").mapInPandas(cut, "lang string, rank int, text string"), "language-sample")
    words = rows.where(F.col("rank") % 2 == 0).select("lang", "text").mapInPandas(entries, "lang string, word array<string>").select("lang", F.explode("word").alias("word"))
    kept = words.groupBy("lang", "word").agg(F.count("*").alias("n")).where(F.col("n") >= LEXICON_DOCS).groupBy("word").agg(F.array_sort(F.collect_set("lang")).alias("langs"), F.sum("n").alias("n"))
    lexicon = {r["word"]: zlib.crc32("\0".join(r["langs"]).encode()) for r in kept.collect()}  # a word of the sample counts twice or more
    taught = rows.where(F.col("rank") % 2 == 1).select("lang", "text").toPandas().sort_values(["lang", "text"])  # sample_docs texts of sample_words words
    return fit(taught["text"].tolist(), taught["lang"].tolist(), lexicon)


_READERS: dict[str, Reader] = {}


def _by_reader(learned: Field, spark: SparkSession):
    """A function from texts to what a worker's reader says of them, a bounded number of characters at a time."""
    shared, key = spark.sparkContext.broadcast(learned), uuid.uuid4().hex  # BUCKETS rows of a float for each language, and the lexicon

    def each(texts: list[str | None]) -> Iterator[tuple[Reader, list]]:
        if key not in _READERS:  # a worker keeps the reader of the last field it served
            _READERS.clear()
            _READERS[key] = Reader(shared.value)
        first = 0
        while first < len(texts):
            stop, chars = first, 0
            while stop < len(texts) and (stop == first or chars + len(texts[stop] or "") <= 1 << 19):
                chars += len(texts[stop] or "")
                stop += 1
            yield _READERS[key], texts[first:stop]
            first = stop

    return each


def predict(docs: DataFrame, learned: Field) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` for every row. A text that is null or has no letter is ``und`` with score 0; languages of equal shares go to the
    first name. A text of any length is read whole. Repeated rows get equal answers; an empty table gives an empty result; other columns
    are ignored."""
    each = _by_reader(learned, docs.sparkSession)

    def compute(texts: list[str | None]) -> dict:
        found = [reader.read(some) for reader, some in each(texts)]
        return {"lang_pred": [n for names, _ in found for n in names], "score": np.concatenate([np.zeros(0), *(s for _, s in found)])}

    return common.computed(docs, "doc_id", "text", compute, {"lang_pred": "string", "score": "double"})


def label_words(docs: DataFrame, learned: Field) -> DataFrame:
    """``doc_id``, ``word_langs`` for every row: the language of each word, that is of each token with a letter, in order. Null texts have none."""
    each = _by_reader(learned, docs.sparkSession)
    return common.computed(docs, "doc_id", "text", lambda texts: {"word_langs": [x for reader, some in each(texts) for x in reader.label(some)]}, {"word_langs": "array<string>"})


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    docs = common.table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", common.in_fold("doc_id", FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score")
