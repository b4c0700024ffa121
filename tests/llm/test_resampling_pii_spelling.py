"""Operators 11 to 13 against plain versions of their contracts, and odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tradeloom.llm import importance, pii, spelling

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
ODD = [(None, "the words of a text without an id, " * 9), (1, None), (2, ""), (3, " \n\t"), (3, "twice the same id"), (4, "same row"), (4, "same row"), (5, "x" * 300_000), (6, "a bb " * 60_000), (7, "é ü 漢字 😀 words " * 30)]


def documents(spark, rows=ODD):
    """Documents with a column that clashes with names used inside."""
    return spark.createDataFrame([(i, t, "b", 1) for i, t in rows], "doc_id long, text string, body string, n int")


# --- 11 ---------------------------------------------------------------------------------------------------------------------------------


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)], len(words)


def plain_resample(docs, target, percent=5):
    found = [(i, *plain_features(t)) for i, t in docs]
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    own, wanted = Counter(bucket(f) for _, fs, _ in found for f in fs), Counter(bucket(f) for t in target for f in plain_features(t)[0])
    s, t = own.total(), wanted.total()
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s + 10_000) / ((own[b] + 1) * (t + 10_000))))
    rows = []
    for i, fs, n in found:
        weight = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    place = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted((tuple(r[:4]) + (place.get(id(r)),) for r in rows), key=str)


def test_resampling_is_the_plain_computation(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = [tuple(r) for r in importance.op11_importance_resampling(spark, SMALL).collect()]
    assert sorted(got, key=str) == plain_resample(rows, target)
    assert sum(r[4] is not None for r in got) == sum(plain_features(t)[1] >= 20 for _, t in rows) * 5 // 100 > 0


def test_resampling_of_odd_rows(spark):
    docs, target = documents(spark, ODD * 5), spark.createDataFrame([("a bb a",), (None,), ("words",)], "text string")
    got = importance.rank(importance.score(docs, target), percent=50).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == plain_resample(ODD * 5, ["a bb a", None, "words"], 50)
    whole = importance.resample(docs, target, percent=50)
    assert whole.columns == docs.columns and whole.count() == 10  # all rows of each id drawn
    empty = docs.where("false")
    assert importance.rank(importance.score(empty, target)).count() == 0
    assert {r.weight for r in importance.score(documents(spark, [(2, "")]), target.where("false")).collect()} == {0}


def test_runs_hold_every_feature_once_at_any_size_of_pieces(monkeypatch):
    rng, words = random.Random(5), [b"a", b"bb", b"C1", b"d-e", "é".encode(), b"x" * 70, b"q" * 63, b"q" * 64]
    for _ in range(120):
        monkeypatch.setattr(importance, "PIECE", rng.choice([1, 3, 10, 50]))
        monkeypatch.setattr(importance, "CHUNK_WORDS", rng.choice([1, 5, 30, 1000]))
        texts = [b" ".join(rng.choices(words, k=rng.choice([0, 1, 2, 3, 40]))) for _ in range(6)]
        want = Counter(zlib.crc32(f.encode()) % 10_000 for t in texts for f in plain_features(t.decode())[0])
        got, hashed = Counter(), 0
        for chunk in importance.chunks(texts):
            for bucket, run, place in importance.ngram_runs(chunk):
                assert len(set(place.tolist())) == len(place)
                got.update(bucket[run].tolist())
                hashed += len(bucket)
        assert got == want


# --- 12 ---------------------------------------------------------------------------------------------------------------------------------


def plain_luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_base(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m.group())) <= 19 and plain_luhn(digits(m.group()))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m.group())) <= 15]


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)


def test_base_spans_are_those_of_the_plain_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choices("aA_@@..-- +019().5%é", k=rng.randint(0, 40)))
        assert pii.base_spans(t) == plain_base(t)


@pytest.mark.parametrize("text", ["1" * 1_000_000, "a" * 1_000_000, "a@" * 500_000, "+1" + " " * 1_000_000, "1 " * 500_000, "a.b-c@" * 150_000])
def test_long_runs_take_time_in_proportion(text):
    import time

    began = time.process_time()
    pii.candidates(text, pii.base_spans(text))
    assert time.process_time() - began < 10


def test_every_document_has_its_base_spans_and_more(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = pii.op12_pii(spark, "/root/testdata/sf0.01").collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        base = plain_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in base) for kind in range(4)]
        spans = r.spans.split(",") if r.spans else []
        assert set(listed(base).split(",")) - {""} <= set(spans)
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s.split(":")[0]), int(s.split(":")[1])))


def test_planted_spans_are_added_and_other_numbers_are_not(spark):
    rng, rows, want, clean = random.Random(8), [], {}, set()
    card = lambda: next(c for c in iter(lambda: "4" + "".join(rng.choices("0123456789", k=15)), None) if plain_luhn(c))
    for i in range(400):
        phone, number = f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}", card()
        match i % 4:
            case 0:  # the base rules see one number of too many digits
                text, spans = f"word {phone} {number} word", {("phone", phone), ("card", number)}
            case 1:
                text, spans = f"please call {phone} or write ann.b{i}@mail{i}.example.com now", {("phone", phone), ("email", f"ann.b{i}@mail{i}.example.com")}
            case 2:
                text, spans = f"host 10.{i % 200}.3.{i % 90} and card {number} there", {("ip", f"10.{i % 200}.3.{i % 90}"), ("card", number)}
            case _:
                text, spans = f"release 3.{i}.2 of page {i}, order 2024-{i % 12 + 1:02d}-11, key a{rng.randint(10**20, 10**21)}f, sum 1{i},000.00", set()
                clean.add(i)
        rows.append((i, text))
        want[i] = spans
    found = pii.common.written(pii.read(documents(spark, rows)), "pii-test")
    texts = dict(rows)
    for r in pii.decide(found, pii.learn(found)).collect():
        got = {(k, texts[r.id][int(s) : int(e)]) for k, s, e in (x.split(":") for x in r.spans.split(",") if x)}
        assert got == want[r.id], texts[r.id]
        assert not (r.id in clean and got)


def test_reliabilities_find_the_labelers_that_err():
    """Votes drawn from known reliabilities: the estimates come near them, and to the true labels."""
    rng, right = np.random.default_rng(2), np.array([0.95, 0.9, 0.6, 0.85, 0.9, 0.55, 0.8])
    true = rng.random(20_000) < 0.4
    votes = np.where(rng.random((20_000, 7)) < right, true[:, None], ~true[:, None]) * 2
    codes = (votes * 3 ** np.arange(7)).sum(1)
    learned, odds = pii.reliabilities({(2, int(c)): int(n) for c, n in zip(*np.unique(codes, return_counts=True))})
    share, says = learned[2]
    assert abs(share - 0.4) < 0.02
    assert np.abs(says[:, 1, 2] - right).max() < 0.03
    assert np.mean((np.array([odds[2, int(c)] for c in codes]) > 0.5) == true) > 0.97


def test_one_step_of_estimation_is_bayes_rule():
    """At the fixed point, the odds of a combination are those that the estimated reliabilities give by enumeration."""
    counts = {(0, sum(v * 3**i for i, v in enumerate(c))): n for c, n in (((2, 2, 2, 1, 2, 1, 2), 50), ((0, 2, 0, 1, 0, 1, 2), 20), ((0, 0, 0, 0, 0, 1, 0), 30), ((2, 2, 1, 2, 2, 1, 2), 9))}
    (share, says), odds = pii.reliabilities(counts)[0][0], pii.reliabilities(counts)[1]
    for (_, code), p in odds.items():
        yes, no = share, 1 - share
        for i in range(7):
            yes, no = yes * says[i, 1, code // 3**i % 3], no * says[i, 0, code // 3**i % 3]
        assert abs(p - yes / (yes + no)) < 1e-3


def test_chosen_spans_do_not_overlap():
    rng, weights = random.Random(4), np.zeros(pii.DIM)
    for f in range(50):
        weights[f] = rng.uniform(-1, 2)
    for _ in range(500):
        place = lambda: (s := rng.randrange(60), s + rng.randint(1, 12))
        base = [(rng.randrange(4), *place()) for _ in range(rng.randint(0, 3))]
        found = [(rng.randrange(4), *place(), 0, [rng.randrange(50)]) for _ in range(rng.randint(0, 12))]
        got = pii.chosen(base, found, weights)
        added = [(s, e) for *_, s, e, p in got if p < 1]
        assert all(e <= s2 or e2 <= s for i, (s, e) in enumerate(added) for s2, e2 in [*added[:i], *((b[1], b[2]) for b in base)])
        for k, s, e, _, f in found:  # what is left out is unlikely, or meets something
            if weights[f[0]] >= 0 and not any(x[:3] == (k, s, e) for x in got):
                assert any(s < x[2] and x[1] < e for x in got)


def test_personal_data_of_odd_rows(spark):
    docs = documents(spark, [*ODD, (8, "😀 a@b.co 😀 1.2.3.4"), (9, "+1 (200) 555-1234 " * 2000)])
    found = pii.common.written(pii.read(docs), "pii-odd")
    weights = pii.learn(found)
    got = {r.id: r for r in pii.decide(found, weights).collect()}
    assert got[8].base == "email:2:8,ip:11:18" and got[2].spans == "" and found.count() == docs.count()
    hidden = {r.doc_id: r.text for r in pii.redact(docs, weights).collect()}
    assert hidden[8] == "😀 <EMAIL> 😀 <IP>" and hidden[1] is None and hidden[9] == "<PHONE> " * 2000
    nothing = pii.common.written(pii.read(docs.where("false")), "pii-none")
    assert pii.decide(nothing, pii.learn(nothing)).count() == 0


# --- 13 ---------------------------------------------------------------------------------------------------------------------------------


def plain_words(rows):
    out = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{i}:{w}".encode()) if i is not None else 1
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                out[w] += 1
    return {w: n for w, n in out.items() if n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    return sum(x != y for x, y in zip(a, b)) == 1 if len(a) == len(b) else len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(words):
    near = defaultdict(set)
    for a in words:
        for b in words:
            if one_edit(a, b):
                near[a].add(b)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda y: (-words[y], y), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def test_variants_are_those_of_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in spelling.op13_spelling_variants(spark, SMALL).collect())
    words = plain_words(rows)
    by_length = defaultdict(dict)
    for w, n in words.items():
        by_length[len(w)][w] = n
    assert {g[0]: g[3] for g in got} == words
    near = {a: {b for m in (len(a) - 1, len(a), len(a) + 1) for b in by_length[m] if one_edit(a, b)} for a in list(words)[:400]}
    found = {g[0]: g for g in got}
    for w, others in near.items():
        best = min(others, key=lambda y: (-words[y], y), default=None)
        form = best if best and words[best] >= 10 * words[w] else None
        assert found[w][1:2] + found[w][4:] == (form, len(others), words.get(form))


def test_crowded_halves_lose_and_repeat_no_pair(spark):
    """Few letters and long common beginnings, so that keys are crowded at several levels, with letters that repeat."""
    rng = random.Random(6)
    words = {"".join(rng.choices("abé", k=rng.randint(7, 9))): rng.choice([2, 3, 30, 300, 3000]) for _ in range(700)}
    words |= {"prefix" * 6 + "".join(rng.choices("ab", k=rng.randint(3, 7))): rng.choice([2, 25, 400]) for _ in range(150)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    for hot in (1, 4, spelling.HOT, 10_000):
        links = [tuple(r) for r in spelling.near_words(spelling.common.written(table, "test-words"), hot).collect()]
        assert len(links) == len(set(links))
        assert {(a, b) for a, b, _ in links} == {(a, b) for a in words for b in words if one_edit(a, b)}
    got = spelling.roots(spelling.forms(table)).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got)) == plain_variants(words)


def test_chains_of_forms_end_in_one_root(spark):
    chain = [("abcdefg" + "h" * k, 10 ** (6 - k)) for k in range(6)]
    got = {r.word: r.root for r in spelling.roots(spelling.forms(spark.createDataFrame(chain, "word string, n long"))).collect()}
    assert set(got.values()) == {"abcdefg"} and len(got) == 6


def test_words_of_odd_rows(spark):
    rows = [*ODD, (10, "ÀÉÎÕÜßÿ ÀÉÎÕÜßÿ Résumés RÉSUMÉS résumés × a÷b÷c÷d÷e"), (None, "Letters letters LETTERS lettres lettres"), (11, "preĀfix longwordsālongwords")]
    got = spelling.roots(spelling.forms(spelling.vocabulary(documents(spark, rows)))).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got)) == plain_variants(plain_words(rows))
    empty = spelling.vocabulary(documents(spark).where("false"))
    assert spelling.roots(spelling.forms(empty)).count() == 0
