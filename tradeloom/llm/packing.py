"""Order-preserving packing into fixed windows by dynamic programming.

Documents are tokenised and laid end to end, in the order of their partition. Windows are cut where the dynamic programme says:
after a document (free), after a sentence (a small truncation penalty), or at a fixed grid inside a sentence (a larger one). It minimises
padding plus penalties over all such cuts: cost(j) = min over i in [j - size, j) of cost(i) + pad(j - i) + penalty(j), where a window of n
tokens is padded by size - n, or not at all if n is a power of two. For the padded windows the term in i is cost(i) + i, whose minimum
over the sliding range comes from a monotone queue; the windows of a power of two are as many further look-ups as there are powers. So
the work is linear in the candidate cuts.

Each partition is packed on its own, without a shuffle: a partition's stream is held in stretches of ``STRETCH`` tokens, each packed
to optimality, and the tail of a stretch is carried into the next. Memory is a stretch and the longest document's ids.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 1024
#: Cuts inside a sentence are offered at every so many tokens from the start of a stretch.
GRID = 64
SENTENCE_PENALTY = 2
INSIDE_PENALTY = 24
STRETCH = 1 << 19
END_ID = 0


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of whole texts, equal to those of ``tokenizers`` for a byte-level vocabulary file.

    The vocabulary is encoded by ``tiktoken``, which gives the same ids in a quarter of the time; a text that holds a special token's
    string goes to ``tokenizers``. The tests hold both against ``tokenizers``.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, added = spec["model"]["vocab"], {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *added.values()]) + 1
        if size > 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.special = list(added)
        as_byte = {c: b for b, c in byte_characters().items()}
        ranks = {bytes(as_byte[c] for c in word): i for word, i in vocab.items() if word not in added}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.ends = np.zeros(size, dtype=bool)
        for word, i in vocab.items():
            self.ends[i] = word.endswith((".", "!", "?", "\u010a"))

    def encode(self, text: str) -> np.ndarray:
        if any(x in text for x in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint16)
        return self.fast.encode_to_numpy(text).astype(np.uint16)


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next unused one from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def window_cuts(ends: np.ndarray, penalties: np.ndarray, size: int = WINDOW) -> list[int]:
    """The cheapest window ends among candidate cuts.

    ``ends``: increasing cut positions, the last of them the end of the stretch, with no gap above ``size`` (from 0 on). A window costs
    its padding (none at a power of two) and its cut's penalty; the last position has none. Ties go to the longest window.
    """
    places = np.concatenate([[0], ends])
    steps = _steps_of_a_power(places, size)
    position, penalty = places.tolist(), [0, *penalties.tolist()]
    penalty[-1] = 0
    cost, came = [0] * len(position), [0] * len(position)
    queue: deque[int] = deque([0])
    for j in range(1, len(position)):
        at = position[j]
        while position[queue[0]] < at - size:
            queue.popleft()
        i = queue[0]
        best = cost[i] + size - (at - position[i])
        for k in steps.get(j, ()):
            if cost[k] < best or (cost[k] == best and k < i):
                best, i = cost[k], k
        cost[j], came[j] = best + penalty[j], i
        key = cost[j] + at
        while queue and cost[queue[-1]] + position[queue[-1]] > key:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(position) - 1
    while j > 0:
        cuts.append(position[j])
        j = came[j]
    return cuts[::-1]


def _steps_of_a_power(places: np.ndarray, size: int) -> dict[int, list[int]]:
    """For each place the places that lie a power of two up to ``size`` before it, both by index."""
    out: dict[int, list[int]] = {}
    for p in (1 << k for k in range(size.bit_length()) if 1 << k <= size):
        before = np.searchsorted(places, places - p)
        for j in np.flatnonzero((places >= p) & (places[before] == places - p)).tolist():
            out.setdefault(j, []).append(int(before[j]))
    return out


class Stretch:
    """Documents laid end to end, packed when there are enough tokens."""

    def __init__(self, ends: np.ndarray, size: int, first: int):
        self.ends, self.size, self.sequence = ends, size, first
        self.docs: list[tuple[object, int, int, np.ndarray]] = []  # id, tokens of its document, ids before it, ids still to place
        self.tokens = 0

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids), 0, ids))
        self.tokens += len(ids)

    def pack(self, last: bool) -> list[tuple]:
        """Pieces of the windows; unless ``last``, the windows at the end stay, as more tokens may change their cuts."""
        if not self.tokens:
            return []
        ids = np.concatenate([d[3] for d in self.docs])
        doc_ends = np.cumsum([len(d[3]) for d in self.docs])
        penalty = np.full(len(ids) + 1, -1, dtype=np.int32)
        penalty[GRID::GRID] = INSIDE_PENALTY
        penalty[1:][self.ends[ids]] = SENTENCE_PENALTY
        penalty[doc_ends] = 0
        at = np.flatnonzero(penalty >= 0)
        at = at[at > 0]
        cuts = window_cuts(at, penalty[at], self.size)
        if not last:
            settled = [c for c in cuts if c <= len(ids) - 4 * self.size]
            cuts = settled or cuts[:1]
        out, begin, d = [], 0, 0
        starts = doc_ends - [len(x[3]) for x in self.docs]
        for cut in cuts:
            p = begin
            while p < cut:
                doc_id, total, before, _ = self.docs[d]
                stop = min(cut, int(doc_ends[d]))
                piece = ids[p:stop].astype("<u4")
                out.append((doc_id, before + p - int(starts[d]), stop - p, zlib.crc32(piece.tobytes()), total, self.sequence, p - begin, piece))
                p = stop
                if stop == doc_ends[d]:
                    d += 1
            self.sequence += 1
            begin = cut
        rest = []
        for k in range(d, len(self.docs)):
            doc_id, total, before, own = self.docs[k]
            done = max(0, begin - int(starts[k]))
            rest.append((doc_id, total, before + done, own[done:]))
        self.docs, self.tokens = rest, len(ids) - begin
        return out


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def pack(docs: DataFrame, path: str | None = None, size: int = WINDOW, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``, and with
    ``with_ids`` the piece's ``ids``.

    A document's ids end with id 0, so that a null or empty text is one id. Every id lies in one piece. Ids of documents may be null or
    repeat: each row is packed by itself. A document of any length is cut into as many windows as it takes. Sequence ids are unique; they
    number the windows of a partition from its number shifted by 40 bits. An empty table gives an empty result, other columns are ignored.
    """
    common.bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path or tokenizer_path())
        stretch = Stretch(enc.ends, size, TaskContext.get().partitionId() << 40)
        kind = None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows))
            arrays = [pa.array(columns[0], type=kind), *(pa.array(c, type=pa.int64()) for c in columns[1:7])]
            if with_ids:
                arrays.append(pa.array(columns[7], type=pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names=NAMES[: len(arrays)])

        for b in batches:
            kind = b.column(0).type
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                stretch.add(doc_id, np.append(enc.encode(text or ""), np.uint16(END_ID)))
                if stretch.tokens >= STRETCH and (rows := stretch.pack(False)):
                    yield batch(rows)
        if rows := stretch.pack(True):
            yield batch(rows)

    schema = f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in NAMES[1:7]) + (", ids array<int>" if with_ids else "")
    return slim.mapInArrow(run, schema)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document."""
    return pack(common.table(spark, sf_dir, "documents", "doc_id", "text"))
