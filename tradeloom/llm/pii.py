"""Personal data in texts, by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs the labelers, and a classifier learns from the weighed votes.

Base spans come from four plain rules (``base_spans``) and always stay. Candidates are the base spans and what looser patterns find: numbers inside longer
runs that a base rule drops as a whole, phone numbers without a plus sign, addresses written with ``[at]`` and ``[dot]``. Seven labelers (grammar,
arithmetic, gazetteer, context, surroundings, overlap, variety) vote yes, no or nothing on each. How often each combination of votes occurs is
counted over all documents: 4 kinds x 3**7 combinations at most, whatever the input. Expectation-maximisation over these counts estimates how a
labeler votes on true and on false candidates of a kind, and so the odds of each combination. A logistic classifier over votes, shapes and neighbouring words then
learns these odds from a sample of candidates (``SAMPLE`` of each kind, by hash), and decides on all of them. A candidate it accepts
is added if it touches no base span and no better candidate.

Texts are read once, in Python, where only the numbers, the addresses and their neighbours are looked at; each rule takes time in proportion to the text, also on long runs of digits
or letters. What is written is one row per document with its candidates. A null or empty text has no spans; a null id stays null; equal
rows are found alike, row by row; empty tables give empty results. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import bisect
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Candidates of a kind that teach the classifier, its weights, and the odds from which a candidate counts.
SAMPLE, DIM, ACCEPT = 2_000, 1 << 13, 0.5
ROUNDS = 60

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_DIGIT = re.compile("[0-9]")
#: No candidate of an address is without one of these.
_ADDRESS_SIGNS = ("@", "[at]", "(at)", "{at}", " dot ")

# Patterns of candidates, each of bounded length.
_AT, _DOT = r"(?:@|\[at\]|\(at\)|\{at\})", r"(?:\.|\[dot\]|\(dot\)|\{dot\})"
_LOOSE = (
    re.compile(rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{{1,64}}+ ?(?:{_AT} ?[a-z0-9-]{{1,63}}(?: ?{_DOT} ?[a-z0-9-]{{1,63}}){{1,8}}| at [a-z0-9-]{{1,63}}(?: dot [a-z0-9-]{{1,63}}){{1,8}})"),
    re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|\(\.\))[0-9]{1,3}){3}(?![0-9]|\.[0-9])|(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])"),
    re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ ./-][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"),
    re.compile(r"(?<![0-9+(])(?:\+ ?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|(?<![0-9+(])\+[0-9]{9,15}(?![0-9])"),
)

# Top-level domains that addresses often have, first digits of countries' calling codes, and words that name a kind of number or address or another number.
DOMAINS = frozenset("com org net edu gov mil int info biz name io co me tv app dev eu uk de fr es it nl be ch at pl se no dk fi pt gr cz ie ru ua tr us ca mx br ar cl au nz jp cn in kr za".split())
CODES = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
CUES = (
    frozenset("mail email e-mail contact write address correo courriel adresse".split()),
    frozenset("ip ipv4 host server address addr client peer adresse".split()),
    frozenset("card visa mastercard amex credit debit payment karte carte tarjeta kreditkarte".split()),
    frozenset("phone tel telephone call mobile cell fax whatsapp telefon handy telefono teléfono téléphone".split()),
)
OTHER = frozenset("version v ver release build isbn issn doi order invoice sku id ref serial page pages section figure table chapter total price token key hash commit".split())
_BARE = re.compile(r"[^\W_]+(?:-[^\W_]+)?")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def _octet(part: str) -> bool:
    """At most 255, leading zeros allowed."""
    bare = part.lstrip("0")
    return len(bare) <= 3 and int(bare or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the plain rules: leftmost and non-overlapping for each kind, failing matches dropped, by kind and then by start."""
    out = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((EMAIL, start, m.end()))
            last = m.end()
        at = text.find("@", m.end() if m else at + 1)
    out += [(IP, *m.span()) for m in _IP.finditer(text) if all(map(_octet, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m.group())
            if 13 <= len(d) <= 19 and _luhn(d):
                out.append((CARD, *m.span()))
    out += [(PHONE, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    return out


_RULES = (re.compile(r"[A-Za-z0-9._%+-]+@" + _DOMAIN.pattern), _IP, _CARD, _PHONE)


def _grammar(kind: int, s: str) -> int:
    return 1 if _RULES[kind].fullmatch(s) else -1


def _arithmetic(kind: int, s: str, d: str) -> int:
    if kind == EMAIL:
        name, _, domain = s.rpartition("@")
        return 0 if not name else 1 if len(name) <= 64 and len(domain) <= 253 and ".." not in name and name[0] != "." != name[-1] else -1
    if kind == IP:
        return 1 if ":" in s else 1 if all(_octet(p) and (p == "0" or p[:1] != "0") for p in re.findall("[0-9]+", s)) else -1
    if kind == CARD:
        return 1 if 13 <= len(d) <= 19 and _luhn(d) else -1
    return 1 if 9 <= len(d) <= 15 else -1


def _gazetteer(kind: int, s: str, d: str) -> int:
    if kind == EMAIL:
        tail = re.split(r"[^a-z]+", s.lower())[-1]
        return 1 if tail in DOMAINS else 0
    if kind == IP:
        first = re.match("[0-9]+", s)
        return 0 if ":" in s or not first else 1 if 1 <= int(first.group()[-3:]) <= 223 else -1
    if kind == CARD:  # ranges of issuers, with the lengths of their numbers
        two, three, four, n = int(d[:2]), int(d[:3]), int(d[:4]), len(d)
        known = d[0] == "4" and n in (13, 16, 19) or n == 16 and (51 <= two <= 55 or 2221 <= four <= 2720) or n == 15 and two in (34, 37) or n >= 16 and (four == 6011 or two in (35, 62, 65) or 644 <= three <= 649) or n >= 14 and (two in (36, 38, 39) or 300 <= three <= 305)
        return 1 if known else -1
    return 0 if s[0] != "+" else 1 if d.startswith(CODES) else -1


def _variety(d: str, s: str) -> int:
    """Digits that all are alike, or count up, name nothing."""
    body = d if len(d) >= 8 else s
    return -1 if len(set(body)) <= 2 or body in "01234567890123456789" else 1


def _neighbours(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    before, after = text[max(0, start - 80) : start].lower(), text[end : end + 40].lower()
    return _BARE.findall(before)[-6:], _BARE.findall(after)[:2]


def _feature(*parts) -> int:
    return zlib.crc32(":".join(map(str, parts)).encode("utf-8", "surrogatepass")) % DIM


LABELERS = 7


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, list[int]]]:
    """(kind, start, end, votes, features) of each candidate, by kind and start. Votes are digits to the base of three: 0 for no, 1 for none, 2 for yes."""
    found, low = set(base), text.lower()
    numbers = _DIGIT.search(text) is not None
    for kind, pattern in enumerate(_LOOSE):
        if numbers if kind != EMAIL else any(x in low for x in _ADDRESS_SIGNS):
            found.update((kind, *m.span()) for m in pattern.finditer(text))
    # The widest base span that reaches beyond a place, for each kind: spans of a kind do not overlap, so a pointer each is enough.
    spans = [[(s, e) for k, s, e in base if k == kind] for kind in range(len(KINDS))]
    at, out = [0] * len(KINDS), []
    for start, end, kind in sorted((s, e, k) for k, s, e in found):
        inside = 0
        for other, own in enumerate(spans):
            while at[other] < len(own) and own[at[other]][1] <= start:
                at[other] += 1
            if other != kind and at[other] < len(own) and own[at[other]][0] <= start and own[at[other]][1] >= end and own[at[other]] != (start, end):
                inside = -1
        s = text[start:end]
        d = _digits(s)
        before, after = _neighbours(text, start, end)
        left, right = text[start - 1 : start], text[end : end + 1]
        cue = 1 if not CUES[kind].isdisjoint(before) else -1 if not OTHER.isdisjoint(before[-3:]) else 0
        loose = not (left.isalnum() or right.isalnum()) and left not in ("=", "_", "/", '"') and right not in ("_", "/", '"')
        votes = (_grammar(kind, s), _arithmetic(kind, s, d), _gazetteer(kind, s, d), cue, 1 if loose else -1, inside, _variety(d, s))
        features = [_feature(kind, "bias"), _feature(kind, "digits", len(d)), _feature(kind, "length", min(len(s), 64) // 4), _feature(kind, "left", left), _feature(kind, "right", right), _feature(kind, "signs", "".join(sorted({c for c in s if not c.isalnum()})))]
        features += [_feature(kind, "vote", i, v) for i, v in enumerate(votes)] + [_feature(kind, "before", re.sub("[0-9]", "9", w)) for w in before[-2:]] + [_feature(kind, "after", re.sub("[0-9]", "9", w)) for w in after]
        out.append((kind, start, end, sum((v + 1) * 3**i for i, v in enumerate(votes)), features))
    return out


_ROWS = "base_kind array<int>, base_start array<int>, base_end array<int>, kind array<int>, start array<int>, stop array<int>, votes array<int>, features array<array<int>>"


def read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id`` and, as arrays, its base spans and its candidates."""
    common.bound_batches(docs.sparkSession)
    slim = common.spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")))
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base = base_spans(text or "")
                found = candidates(text or "", base)
                rows.append(([list(x) for x in zip(*base)] or [[]] * 3) + ([list(x) for x in zip(*found)] or [[]] * 5))
            columns = list(zip(*rows)) or [[]] * 8
            arrays = [pa.array(c, ints) for c in columns[:7]] + [pa.array(columns[7], pa.list_(ints))]
            yield pa.RecordBatch.from_arrays([b.column(0), *arrays], names=["id", *(f.split()[0] for f in _ROWS.split(", "))])

    return slim.mapInArrow(run, f"id {slim.schema['id'].dataType.simpleString()}, {_ROWS}")


def reliabilities(counts: dict[tuple[int, int], int]) -> tuple[dict[int, tuple[float, np.ndarray]], dict[tuple[int, int], float]]:
    """From how often a kind's candidates got a combination of votes: for each kind the share of true candidates and how each labeler votes (labeler, false or
    true, vote), and for each combination the odds that it is true. It begins with the majority of the votes; a labeler that would vote yes
    more readily on false candidates than on true ones counts for nothing."""
    learned, odds = {}, {}
    for kind in sorted({k for k, _ in counts}):
        codes = sorted(v for k, v in counts if k == kind)
        n = np.array([counts[kind, v] for v in codes], float)
        votes = np.array([[v // 3**i % 3 for i in range(LABELERS)] for v in codes])
        yes, no = (votes == 2).sum(1), (votes == 0).sum(1)
        true = (yes + 0.5) / (yes + no + 1)
        for _ in range(ROUNDS):
            share = (n @ true + 1) / (n.sum() + 2)
            says = np.empty((LABELERS, 2, 3))
            for i in range(LABELERS):
                for y, p in enumerate((1 - true, true)):
                    says[i, y] = [n @ (p * (votes[:, i] == v)) + 0.5 for v in range(3)]
                says[i] /= says[i].sum(1, keepdims=True)
                if says[i, 1, 2] * says[i, 0, 0] < says[i, 0, 2] * says[i, 1, 0]:
                    says[i] = says[i].mean(0)
            each = np.log(says[np.arange(LABELERS)[:, None], :, votes.T]).sum(0) + np.log([1 - share, share])
            new = 1 / (1 + np.exp(np.clip(each[:, 0] - each[:, 1], -50, 50)))
            done, true = np.abs(new - true).max() < 1e-9, new
            if done:
                break
        learned[kind] = (float(share), says)
        odds |= {(kind, v): float(p) for v, p in zip(codes, true)}
    return learned, odds


def fit(features: list[list[int]], odds: list[float], rounds: int = 300, keep: float = 1e-3) -> np.ndarray:
    """Weights of a logistic classifier for rows of feature numbers and the odds that they are true (gradient steps scaled by feature)."""
    w = np.zeros(DIM)
    if not features:
        return w
    size = np.array([len(f) for f in features])
    row, col, y = np.repeat(np.arange(len(features)), size), np.concatenate([np.array(f, np.int64) for f in features]), np.array(odds)
    seen = np.full(DIM, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], len(y)), -50, 50)))
        g = np.bincount(col, (p - y)[row], DIM) / len(y) + keep * w / len(y)
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen)
    return w


def learn(found: DataFrame) -> np.ndarray:
    """The classifier's weights from a table of ``read``: all counts of votes, and a sample of candidates with the smallest hashes."""
    each = found.select("id", F.explode(F.arrays_zip("kind", "start", "stop", "votes", "features")).alias("c")).select("id", "c.*")
    counts = {(r["kind"], r["votes"]): r["count"] for r in each.groupBy("kind", "votes").count().collect()}  # bounded by the combinations
    odds = reliabilities(counts)[1]
    rows = []
    place = F.pmod(F.xxhash64(F.col("id").cast("string"), "start", "stop"), F.lit(1 << 30))
    for kind in range(len(KINDS)):
        # Candidates beyond a few times the sample are dropped where they are read, so that a table of any size sends few to be ranked.
        share = min(1.0, 4 * SAMPLE / max(1, sum(n for (k, _), n in counts.items() if k == kind)))
        some = each.where((F.col("kind") == kind) & (place < F.lit(share * (1 << 30)))).select("votes", "features", place.alias("place"))
        rows += [(r["features"], odds[kind, r["votes"]]) for r in some.orderBy("place", "votes", "features").limit(SAMPLE).collect()]
    return fit([f for f, _ in rows], [p for _, p in rows])


def chosen(base: list[tuple[int, int, int]], found: list[tuple], weights: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, odds) of the base spans (odds 1) and of the accepted candidates that touch none of them and no better one, by kind and start."""
    starts, ends = [], []  # of the stretches that base spans cover, in order
    for s, e in sorted((s, e) for _, s, e in base):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    scored = []
    for kind, start, end, _, features in sorted(found, key=lambda c: (c[1], c[2], c[0])):
        i = bisect.bisect_right(ends, start)
        if i == len(ends) or starts[i] >= end:
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, float(weights[np.asarray(features)].sum())))))
            if p >= ACCEPT:
                scored.append((start, end, kind, p))
    out, group, until = [(*span, 1.0) for span in base], [], -1
    for c in [*scored, (math.inf, math.inf, 0, 0.0)]:
        if c[0] >= until:  # nothing of the group reaches here
            kept = []
            for start, end, kind, p in sorted(group, key=lambda g: (-g[3], g[2], g[0])):
                if all(end <= s or start >= e for s, e in kept):
                    kept.append((start, end))
                    out.append((kind, start, end, p))
            group = []
        group.append(c)
        until = max(until, c[1])
    return sorted(out)


def _listed(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[s[0]]}:{s[1]}:{s[2]}" for s in spans)


def decide(found: DataFrame, weights: np.ndarray) -> DataFrame:
    """``id``, ``base`` and ``spans`` as lists ``kind:start:end`` between commas, for each row of ``read``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, spans = [], []
            for bk, bs, be, k, s, e, v, f in zip(*(c.to_pylist() for c in b.columns[1:])):
                own = list(zip(bk, bs, be))
                base.append(_listed(own))
                spans.append(_listed(chosen(own, list(zip(k, s, e, v, f)), weights)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, pa.string()), pa.array(spans, pa.string())], names=["id", "base", "spans"])

    return found.mapInArrow(run, f"id {found.schema['id'].dataType.simpleString()}, base string, spans string")


def redact(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """The documents, whole, with each span replaced by its kind in capitals between angle brackets; null texts stay null. Of overlapping spans the whole stretch is replaced once, by the first one's kind."""
    common.bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def masked(text: str | None) -> str | None:
        if text is None:
            return None
        base = base_spans(text)
        out, last = [], 0
        for start, end, kind in sorted((s, e, k) for k, s, e, _ in chosen(base, candidates(text, base), weights)):
            if start >= last:
                out += [text[last:start], f"<{KINDS[kind].upper()}>"]
            last = max(last, end)
        return "".join([*out, text[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.set_column(at, b.schema.field(at), pa.array([masked(t) for t in b.column(at).to_pylist()], b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, the digest of the base spans and all spans of every document. SQL cannot express the method; the tests hold the base against plain patterns and the estimates against enumeration."""
    found = common.written(read(common.table(spark, sf_dir, "documents", "doc_id", "text")), "pii")
    each = decide(found, learn(found))
    count = lambda kind: F.regexp_count("base", F.lit(f"{kind}:")).cast("long").alias(f"n_{kind}")
    return each.select(F.col("id").alias("doc_id"), *map(count, KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
