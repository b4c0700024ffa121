"""The training-data operators against brute force, round trips and planted cases, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import random
import zlib

import numpy as np
import pytest

from tradeloom.llm import arc_convert, common, embedding_dedup, exact_topk, html_render, language_id, mixing, packing, quality, simhash_dedup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), "x") for i, t, lang, source in rows], DOCS)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def union_find(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, 2000 + i) for i in range(1, 60)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = union_find(links, {x for e in links for x in e})
    assert got == {n: c for n, c in want.items() if any(n in e and e[0] != e[1] for e in links)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 embeddings


def brute_links(rows):
    ok = [(i, np.array(v, dtype=np.float64), y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for a in range(len(ok)):
        for b in range(a):
            (i, x, y), (j, u, z) = ok[a], ok[b]
            if y == z and len(x) == len(u) and x @ u / np.linalg.norm(x) / np.linalg.norm(u) >= 0.98:
                links.append((i, j))
    return links


def test_embedding_links(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((40, 16)).astype(np.float32)
    rows, n = [], 0
    for i, v in enumerate(base):
        for k in range(1 + i % 5):
            rows.append((n, (v + 0.01 * k * rng.standard_normal(16).astype(np.float32)).tolist(), i % 3))
            n += 1
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, rows[0][1], 7), (n + 2, None, 1), (n + 3, [0.0] * 16, 1), (n + 4, [float("nan")] + [1.0] * 15, 1), (n + 5, rows[0][1], None), (n + 6, [None] + [1.0] * 15, 1), (None, rows[0][1], rows[0][2]), (n + 8, [], 1)]
    frame = spark.createDataFrame([(*r, "e") for r in rows], "vec_id long, embedding array<float>, label int, kept string")
    got = embedding_dedup.near_duplicates(frame).collect()
    links = brute_links(rows)
    want = union_find(links, {r[0] for r in rows if r[0] is not None})
    degree = {i: sum(i in e for e in links) for i in want}
    assert len(got) == len(rows)
    for r in got:
        if r["vec_id"] is None:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, False)
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (degree[r["vec_id"]], want[r["vec_id"]], want[r["vec_id"]] == r["vec_id"])
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_embedding_links_of_doubles_and_named_labels(spark):
    """Doubles that differ below a float's precision stay different, and labels may be of any type."""
    v, w = [1.0, 2.0, 3.0, 4.0], [1.0 + 1e-12, 2.0, 3.0, 4.0]
    frame = spark.createDataFrame([(1, v, "a"), (2, w, "a"), (3, v, "b"), (4, [1e300, -1e300, 0.0, 0.0], "a"), (5, [1.0, -1.0, 0.0, 0.0], "a")], "vec_id long, embedding array<double>, label string")
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(frame).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False)]


def test_filters_find_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal(x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    code = embedding_dedup.product_code(64, embedding_dedup.directions_per_block(50_000))
    a, b = embedding_dedup.list_decode(x, code), embedding_dedup.list_decode(y, code)
    assert np.mean([bool(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist())]) >= 0.99


def test_filters_miss_no_pair_at_any_size():
    """Every pair at the threshold shares a filter, with uneven components and the codes of large inputs too."""
    rng = np.random.default_rng(4)
    for power in (0.0, 0.5, 1.0):
        for vectors in (10**4, 10**6, 10**8):
            x = rng.standard_normal((600, 64)) * np.arange(1, 65) ** -power
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            z = rng.standard_normal(x.shape) * np.arange(1, 65) ** -power
            z -= (z * x).sum(axis=1, keepdims=True) * x
            y = 0.98 * x + np.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
            code = embedding_dedup.product_code(64, embedding_dedup.directions_per_block(vectors))
            a, b = embedding_dedup.list_decode(x, code), embedding_dedup.list_decode(y, code)
            assert all(set(p) & set(q) for p, q in zip(a.tolist(), b.tolist()))


def test_embeddings_of_every_length_link(spark):
    rng = np.random.default_rng(5)
    rows = []
    for dims in (1, 2, 3, 5, 16, 16, 16, 64):
        for v in rng.standard_normal((12, dims)):
            rows += [(len(rows) + k, (v + 0.05 * k * rng.standard_normal(dims)).tolist(), 0) for k in range(3)]
    links = brute_links(rows)
    want = union_find(links, range(len(rows)))
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (sum(i in e for e in links), want[i]) for i in want}


# 2 archives


def test_archives(spark):
    big = "x" * 1500
    rows = [(1, "http://a b/\n", big), (2, "http://c", big), (3, None, big), (4, "u", None), (5, "u", "é" * 700), (6, "v", "é" * 700), (None, "w", big), (7, "z", "short"), (8, "z", "short"), (9, "\r\n\r\nx", "a\r\n\r\nWARC/1.0\r\n\r\n" * 100), (10, "q", ""), (11, "q", "y" * 3_000_000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    got = {r["page_id"]: r for r in arc_convert.archived(frame).collect()}
    assert len(got) == len(rows)
    for i, _, page in rows:
        assert got[i]["payload_bytes"] == len((page or "").encode())
    kinds = {i: (r["record_type"], r["refers_to"]) for i, r in got.items()}
    assert kinds == {1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), None: ("revisit", 3), 4: ("response", None), 5: ("revisit", 6), 6: ("response", None), 7: ("response", None), 8: ("response", None), 9: ("response", None), 10: ("response", None), 11: ("response", None)}
    assert arc_convert.archived(frame.limit(0)).count() == 0


def test_archives_of_named_pages_repeated_rows_and_small_files(spark, monkeypatch):
    """Ids of any type come back, record ids are unique, files end by bytes, and one of equal rows is the response."""
    monkeypatch.setattr(arc_convert, "BATCH_BYTES", 20_000)
    monkeypatch.setattr(arc_convert, "ARCHIVE_BYTES", 60_000)
    big = "x" * 4000
    rows = [(f"p {i}/é\n", f"http://{i}", f"{i} {big}") for i in range(60)] + [("", "u", big), ("b", "u", big), ("a", "u", big), ("b", "u", big), (None, None, big)]
    frame = spark.createDataFrame(rows, "page_id string, url string, html string").coalesce(1)
    got = arc_convert.archived(frame).collect()
    assert sorted(str(r["page_id"]) for r in got) == sorted(str(r[0]) for r in rows) and len({r["record_id"] for r in got}) == len(rows)
    shared = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] == 4000)
    assert shared == sorted([("", "revisit", "b"), ("a", "revisit", "b"), ("None", "revisit", "b"), ("b", "response", None), ("b", "revisit", "b")])
    path = common.scratch(spark, "arc")
    arc_convert.write_arc(frame, path)
    sizes = [len(f["content"]) for f in spark.read.format("binaryFile").load(path).collect()]
    assert len(sizes) > 3 and arc_convert.read_arc(spark, path).count() == len(rows)


def test_arc_versions_and_broken_archives():
    v1 = b"1 0 x\nURL IP-address Archive-date Content-type Archive-length\n"
    v2 = b"2 0 x\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    one = b"filedesc://a 0.0.0.0 2001 text/plain %d\n" % len(v1) + v1 + b"\nhttp://x 1.2.3.4 20010203040506 text/html 5\nhello\nhttp://with space/ 1.2.3.4 20010203 text/html 3\na\nb\n"
    two = b"filedesc://a 0.0.0.0 2001 text/plain 200 - - 0 a %d\n" % len(v2) + v2 + b"\nhttp://x 1.2.3.4 20010203040506 text/html 200 sum - 7 f.arc 2\n\n\n\n"
    assert [(h["URL"], c) for h, c in arc_convert.arc_records(one)] == [("http://x", b"hello"), ("http://with space/", b"a\nb")]
    assert [(h["Result-code"], h["Filename"], c) for h, c in arc_convert.arc_records(two)] == [("200", "f.arc", b"\n\n")]
    with pytest.raises(arc_convert.ArchiveError):
        list(arc_convert.arc_records(b"http://x 1.2.3.4 2001 text/html 5\nhello\n"))
    with pytest.raises(arc_convert.ArchiveError):
        list(arc_convert.arc_records(one[:-6]))
    assert arc_convert.iso_date("20010203040506") == "2001-02-03T04:05:06Z" and arc_convert.iso_date("2001") == "2001-01-01T00:00:00Z" and arc_convert.iso_date("") == "1970-01-01T00:00:00Z"


# 3 packing


def test_packing_round_trip(spark, small):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    rng = random.Random(5)
    odd = ["", None, " ", "a  b \n c  ", "<|endoftext|> hi <|endoftext|>", "it's  the   end.\n\n ok", "x" * 3000, words(rng, 9000), "ünï cödé   x"]
    texts = odd + [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").limit(60).collect()]
    frame = docs_frame(spark, [(i if i else None, t, None, None) for i, t in enumerate(texts)] + [(3, texts[3], None, None)])
    rows = packing.pack(frame, with_ids=True).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
    for i, t in enumerate(texts):
        want = tok.encode(t or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[i if i else None], key=lambda r: r["start"])
        if i == 3:
            assert sum(r["length"] for r in pieces) == 2 * len(want)
            continue
        assert [x for r in pieces for x in r["ids"]] == want and {r["doc_tokens"] for r in pieces} == {len(want)}
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert packing.pack(frame.limit(0)).count() == 0


def padding(n, size):
    return 0 if n.bit_count() == 1 else size - n


def test_window_cuts_are_optimal():
    """Against every choice of cuts, by the contract: a window of a power of two is not padded, wherever it stands."""
    rng = random.Random(2)
    for size in (16, 20):
        for _ in range(250):
            ends, at = [], 0
            for _ in range(rng.randint(1, 14)):
                at += rng.randint(1, 16)
                ends.append(at)
            penalties = [rng.choice([0, 1, 3]) for _ in ends]
            best = {0: 0}
            for n, j in enumerate(ends):
                best[j] = min(best[i] + padding(j - i, size) for i in best if j - i <= size) + (0 if n == len(ends) - 1 else penalties[n])
            cuts = packing.window_cuts(np.array(ends), np.array(penalties), size)
            got = sum(padding(j - i, size) + (0 if j == ends[-1] else penalties[ends.index(j)]) for i, j in zip([0, *cuts], cuts))
            assert got == best[ends[-1]] and all(b - a <= size for a, b in zip([0, *cuts], cuts)) and cuts[-1] == ends[-1]
    assert packing.window_cuts(np.array([512, 576, 1536, 1600, 2112]), np.array([0, 500, 0, 500, 0])) == [512, 1536, 2112]


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    tok, enc, rng = Tokenizer.from_file(packing.tokenizer_path()), packing.encoder(packing.tokenizer_path()), random.Random(11)
    alphabet = list("abcXYZ 019.,!?'\"\n\t-_<>|@é漢字ñßя\u0301\u200b\u00a0😀") + ["'s", "  ", "<|endoftext|>", "\r\n"]
    for _ in range(600):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 60)))
        assert enc.encode(text).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_packing_wastes_little(spark, small):
    rows = packing.op3_packing(spark, small).groupBy("sequence_id").sum("length").collect()
    lengths = [r[1] for r in rows]
    assert sum(padding(n, 1024) for n in lengths) <= 0.01 * sum(lengths)


def test_packing_of_a_long_document_and_clashing_names(spark):
    frame = spark.createDataFrame([(7, "one two three. " * 200_000, 1, 2), (8, "x", 1, 2)], "doc_id long, text string, start int, body int")
    rows = packing.pack(frame).collect()
    by = sorted((r["start"], r["length"]) for r in rows if r["doc_id"] == 7)
    assert all(a + n == b for (a, n), (b, _) in zip(by, by[1:])) and by[-1][0] + by[-1][1] == rows[0]["doc_tokens"] > 500_000


# 4 mixing


def test_mixing(spark):
    rng = random.Random(4)
    sources = ["b", "a", None, "é", "A", "empty"]
    rows = [(i, words(rng, rng.choice([1, 5, 40, 400])) if s != "empty" else "", "en", s) for i in range(900) for s in [rng.choices(sources, [9, 3, 2, 2, 1, 1])[0]]]
    rows += [(None, "some words here", "en", "a"), (5000, None, "en", "b")] + [(6000, "same row", "en", "b")] * 3
    frame = docs_frame(spark, rows)
    plan = [r.asDict() for r in mixing.copies(frame).collect()]
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted([s for s in sizes if s is not None]) + [None]
    weight, total, full = {s: 1 + k % 3 for k, s in enumerate(order)}, sum(sizes.values()), set()
    while True:
        level = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and weight[s] * level > 3 * sizes[s]}
        if not more:
            break
        full |= more
    want = {s: 3 * sizes[s] if s in full else weight[s] * level for s in order}
    assert sum(r["rows"] for r in plan) == len(rows)
    taken = dict.fromkeys(order, 0)
    for r in plan:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["size"] * r["rows"] * r["copies"]
    for s in order:
        assert abs(taken[s] - want[s]) <= 0.01 * want[s] + 5
    again = mixing.copies(frame.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["h"])
    assert sorted((key(r), r["copies"]) for r in again) == sorted((key(r), r["copies"]) for r in plan)
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns and mixed.count() == sum(r["rows"] * r["copies"] for r in plan)
    assert mixing.mix(frame.limit(0)).count() == 0


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 500, 600).astype(float), np.full(600, 0.37)
    out = mixing.flight(p, size, rng)
    assert ((out > 0) & (out < 1)).sum() <= 2 and out.sum() == pytest.approx(p.sum()) and (out * size).sum() == pytest.approx((p * size).sum())
    mean = np.mean([mixing.flight(p[:9], size[:9], np.random.default_rng(k)) for k in range(3000)], axis=0)
    assert np.abs(mean - 0.37).max() < 0.05


def test_landing_keeps_both_totals():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 14):
        size, p = rng.integers(1, 400, n).astype(float), rng.random(n)
        p[:1] = 1.0 if n > 7 else p[:1]
        out = mixing.landing(p, size)
        assert set(out) <= {0.0, 1.0} and (n <= 7 or out[0] == 1.0) and abs(out.sum() - p.sum()) < 1
        open_ = np.flatnonzero(p < 1)
        best = min(abs(sum(size[k] for b, k in enumerate(open_) if m >> b & 1) - (p * size)[open_].sum()) for m in range(1 << len(open_)) if abs(m.bit_count() - p[open_].sum()) < 1)
        assert abs((out * size).sum() - (p * size).sum()) == pytest.approx(best)


def test_mixing_keeps_the_number_of_documents(spark):
    """Of a source's fractional copies, as many documents as expected are taken."""
    rng = random.Random(14)
    rows = [(i, words(rng, rng.choice([1, 9, 80])), "en", f"s{i % 4}") for i in range(6000)]
    plan = mixing.copies(docs_frame(spark, rows)).collect()
    for s in {r["source"] for r in plan}:
        own = [r for r in plan if r["source"] == s]
        rate = own[0]["target"] / own[0]["source_size"]
        assert abs(sum(r["copies"] for r in own) - rate * len(own)) <= 1.5 and abs(sum(r["copies"] * r["size"] for r in own) - own[0]["target"]) <= 0.001 * own[0]["target"]


def test_mixing_carries_clashing_names_and_long_texts(spark):
    frame = spark.createDataFrame([(i, "w " * (200_000 if i == 3 else 5), "a" if i % 2 else "b", i) for i in range(20)], "doc_id int, text string, source string, size int")
    plan = mixing.copies(frame).collect()
    assert max(r["size"] for r in plan) == 200_000 and mixing.mix(frame).where("size <> doc_id").count() == 0


# 5 language


def test_language(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    field = language_id.learn(docs)
    odd = docs_frame(spark, [(None, None, None, None), (1, "", None, None), (2, "123 ... !!", None, None), (3, "x", None, None), (3, "x", None, None), (4, "\n".join(["das ist die und der"] * 4000), "zz", "s")])
    got = language_id.predict(odd, field).collect()
    assert [(r["doc_id"], r["lang_pred"], r["score"]) for r in got[:3]] == [(None, "und", 0.0), (1, "und", 0.0), (2, "und", 0.0)]
    assert got[3][1:] == got[4][1:] and got[5]["lang_pred"] == "de" and all(0 <= r["score"] <= 1 for r in got)
    assert language_id.predict(odd.limit(0), field).count() == 0
    pred = language_id.op5_language_id(spark, small).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert pred.where("lang = lang_pred").count() >= 0.9 * pred.count()
    nothing = language_id.learn(docs.where("false"))
    assert language_id.predict(odd, nothing).select("lang_pred").distinct().collect() == [("und",)]


def test_language_of_every_word(spark, small):
    """Planted switches between runs of held-out documents are found word by word."""
    docs = spark.read.parquet(f"{small}/documents.parquet").where("lang is not null and length(text) between 200 and 20000").select("doc_id", "text", "lang")
    field = language_id.learn(docs)
    assert (np.diag(field.transition) > field.transition.max(axis=1) - 1e-9).all()  # staying is likelier than any switch, and learned
    rng, by = random.Random(1), {}
    for r in docs.collect():
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0:
            by.setdefault(r["lang"], []).append([w for w in r["text"].split() if language_id.core(w)])
    texts, want = [], []
    for _ in range(60):
        text, langs = [], []
        for y in rng.sample(sorted(by), min(3, len(by))):
            run = rng.choice(by[y])[:10]
            text, langs = text + run, langs + [y] * len(run)
        texts.append(" ".join(text))
        want.append(langs)
    got = {r["doc_id"]: r["word_langs"] for r in language_id.label_words(docs_frame(spark, [*((i, t, None, None) for i, t in enumerate(texts)), (-1, None, None, None), (-2, " 12 ", None, None)]), field).collect()}
    pairs = [(a, b) for i, langs in enumerate(want) for a, b in zip(got[i], langs, strict=True)]
    assert len(by) > 1 and sum(a == b for a, b in pairs) >= 0.9 * len(pairs) and got[-1] == got[-2] == []


def test_every_language_is_learned_whatever_its_texts(spark):
    """Seventy languages, one of them with long documents alone."""
    rows = []
    for k in range(70):
        stem = chr(97 + k % 26) + chr(97 + k // 26 * 7 % 26) + "q"
        for j in range(6):
            n = 9000 if k == 69 else 25
            rows.append((100 * k + j, " ".join(f"{stem}{chr(97 + (i * 5 + j) % 26)}{stem}" for i in range(n)), f"l{k:02}", "s"))
    docs = docs_frame(spark, rows)
    field = language_id.learn(docs)
    assert len(field.names) == 70
    got = language_id.predict(docs, field).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.95 * len(rows) and got.where("lang = 'l69' and lang_pred = 'l69'").count() == 6


def test_a_token_of_a_megabyte_is_read_at_once():
    import time

    began = time.time()
    assert language_id.core("a" + "." * 1_000_000 + "b").startswith("a.") and language_id.core("." * 1_000_000) == "" and language_id.core("«1Été2»") == "été"
    field = language_id.fit(["das ist gut", "this is good"] * 5, ["de", "en"] * 5)
    reader = language_id.Reader(field)
    assert reader.read(["a" + "." * 1_000_000 + "b"])[0][0] in ("de", "en") and reader.read(["é" * 500_000])[1][0] > 0
    assert time.time() - began < 5


def test_forward_backward():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 5, 70, 33, 32, 64])
    e, t = 3 * rng.standard_normal((lengths.sum(), 3)), rng.standard_normal((3, 3))
    got, pairs = language_id.forward_backward(e, t, lengths, True)
    at, want_pairs = 0, np.zeros((3, 3))
    for n in lengths:
        x, m = np.exp(e[at : at + n]), np.exp(t)
        a, b = [x[0]], [np.ones(3)]
        for k in range(1, n):
            a.append((a[-1] @ m) * x[k])
            a[-1] /= a[-1].sum()
        for k in range(n - 1, 0, -1):
            b.insert(0, m @ (x[k] * b[0]))
            b[0] /= b[0].sum()
        want = np.array(a) * np.array(b)
        assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
        for k in range(1, n):
            p = a[k - 1][:, None] * m * (x[k] * b[k])[None]
            want_pairs += p / p.sum()
        at += n
    assert np.allclose(pairs, want_pairs)


# 6 top-k


@pytest.mark.parametrize("scale", [1.0, 1e12])
def test_topk(spark, monkeypatch, scale):
    monkeypatch.setattr(exact_topk, "SHARD_ROWS", 20)
    monkeypatch.setattr(exact_topk, "ROUND_SHARDS", 2)
    monkeypatch.setattr(exact_topk, "ROUND_GROWTH", 2)
    rng = np.random.default_rng(1)
    rows = [(i, (scale * rng.integers(-2, 3, 6)).tolist()) for i in range(220)] + [(None, [1.0] * 6), (1000, None), (1001, [float("inf")] * 6), (1002, [None] * 6)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int")
    got = [tuple(r) for r in exact_topk.top_k(frame, "vec_id % 20 = 0", 7).orderBy("query_id", "rank").collect()]
    ok = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows[:220]]
    want = []
    for i, v in ok:
        if i % 20 == 0:
            best = sorted(((-max(min(sum(a * b for a, b in zip(v, u)), 2**63 - 1), -(2**63)), j) for j, u in ok if j != i))[:7]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == want
    assert exact_topk.top_k(frame.limit(0), "vec_id % 20 = 0").count() == 0


def test_topk_of_every_length(spark):
    """Vectors of each length are queries and candidates among themselves; repeated ids are rows of their own."""
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-3, 4, (2, 3, 5)[i % 3]).astype(float).tolist()) for i in range(90)] + [(0, [1.0, 1.0]), (0, [1.0, 1.0]), (20, [])]
    got = sorted(tuple(r) for r in exact_topk.top_k(spark.createDataFrame([(*r, "x") for r in rows], "vec_id int, embedding array<double>, row string"), "vec_id % 20 = 0", 4).collect())
    want = []
    for a, (i, v) in enumerate(rows):
        if i % 20 == 0 and v:
            best = sorted((-sum(int(1024 * x) * int(1024 * y) for x, y in zip(v, u)), j) for b, (j, u) in enumerate(rows) if b != a and len(u) == len(v))[:4]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert got == sorted(want)


@pytest.mark.parametrize("spread, part", [(0.05, 0.5), (5.0, 1.01)])
def test_topk_sends_queries_to_cells_that_may_hold_better_ones(spark, monkeypatch, spread, part):
    """The rows of a brute force; of clusters, fewer pairs of queries and shards than all."""
    monkeypatch.setattr(exact_topk, "SHARD_ROWS", 150)
    monkeypatch.setattr(exact_topk, "ROUND_SHARDS", 4)
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(16, 12))
    x = (centers[rng.integers(0, 16, 2400)] + spread * rng.normal(size=(2400, 12))).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    sent, real = [], exact_topk._sent
    monkeypatch.setattr(exact_topk, "_sent", lambda *a: sent.append(common.written(real(*a), "sent")) or sent[-1])
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in exact_topk.top_k(frame, "vec_id % 40 = 0", 5).collect()}
    w = np.floor(1024 * x.astype(float))
    for i in range(0, 2400, 40):
        s = w @ w[i]
        s[i] = -np.inf
        assert [got[i, k + 1] for k in range(5)] == [(j, int(s[j])) for j in np.lexsort((np.arange(2400), -s))[:5]]
    shards = 60 * 16
    assert sum(df.count() for df in sent) <= part * shards * 1.3


# 7 toxicity


def test_toxicity(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        text = words(rng, 60).split()
        if i % 3 == 0:
            text.insert(rng.randint(0, 60), "zzork" + rng.choice(["", "a", "el"]))
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, 1, int(i % 3 == 0)))
    docs, known = docs_frame(spark, rows), spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(docs, known)
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, lexicon).collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in held)
    odd = docs_frame(spark, [(None, None, None, None), (1, "", None, None), (2, "you are an 1D10T!", None, None), (3, "уou аre аn іdiоt", None, None), (4, "a trash can by the door", None, None), (5, "TRASH", None, None), (5, "TRASH", None, None), (6, "fine words " * 20_000, None, None)])
    s = [r["score"] for r in toxicity.score(odd, lexicon).collect()]
    assert s[0] == s[1] and s[0] < 0.5 and s[2] >= 0.5 and s[3] >= 0.5 and s[4] < 0.5 and s[5] >= 0.5 and s[5] == s[6] and s[7] < 0.5
    kept = toxicity.drop_toxic(odd, lexicon)
    assert kept.columns == odd.columns and [r["doc_id"] for r in kept.collect()] == [None, 1, 4, 6]
    assert toxicity.score(odd.limit(0), lexicon).count() == 0
    fixed = toxicity.learn(docs, known.limit(0))
    assert toxicity.score(odd, fixed).where("score >= 0.5").count() == 4


def test_hits_against_a_plain_matcher():
    """The automaton's sums are those of looking for every pattern at every place."""
    rng = random.Random(16)
    lexicon = toxicity.Lexicon({" idiot ": 3.0, " idi": 1.5, "iot ": 2.0, " trash ": 2.5, " scum": 1.0, "ous ": 0.5})
    vocabulary = ["idiot", "1d10t", "idiots", "patriot", "trash", "can", "cans", "TRASH", "scum", "pond", "fam0us", "ｔrash", "the", "a", "…", "scu\u200bm"]

    def plain(text):
        t, best = toxicity.fold(text), {}
        places = lambda p: [k for k in range(len(t)) if t.startswith(p, k)]
        safe = [(k, k + len(p)) for p in map(toxicity.fold, lexicon.exceptions) for k in places(p)]
        for p, w in lexicon.weights.items():
            for k in places(p):
                if not any(s <= k and k + len(p) <= e for s, e in safe):
                    word = max(j for j in range(k + len(p) - 1) if t[j] == " ") if p.endswith(" ") else k
                    best[word] = max(best.get(word, 0), w)
        return sum(best.values())

    texts = [None, "", *(" ".join(rng.choices(vocabulary, k=rng.randint(1, 30))) for _ in range(400))]
    assert lexicon.sums(texts)[0].tolist() == [plain(t) for t in texts]
    assert lexicon.sums(["two trash cans and a trash can"])[0][0] == 0


def test_exceptions_are_learned_from_clean_documents(spark):
    rng = random.Random(17)
    rows = [(i, f"{words(rng, 20)} " + ("you stupid idiot" if i % 4 == 0 else "the garbage truck came" if i % 4 == 1 else "fine"), "en", "s") for i in range(400)]
    known = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs_frame(spark, rows), known)
    assert "garbage truck" in lexicon.exceptions and lexicon.sums(["a garbage truck", "you garbage"])[0].tolist() == [0.0, 3.0]


def test_toxicity_carries_clashing_names_and_long_texts(spark):
    frame = spark.createDataFrame([(1, "fine words " * 100_000 + "moron", 5), (2, "you moron, you idiot", 6)], "doc_id int, text string, score int")
    lexicon = toxicity.Lexicon({" moron ": 3.0, " idiot ": 3.0})
    assert {r["doc_id"]: r["hits"] for r in toxicity.score(frame, lexicon).collect()} == {1: 3.0, 2: 6.0} and toxicity.drop_toxic(frame, lexicon, 2.0).where("score = 4 + doc_id").count() == 2


def test_samples_hold_a_repeated_id_once(spark):
    docs = docs_frame(spark, [(1, f"text {k}", "en", "s") for k in range(500)] + [(2, None, "en", "s"), (3, "other", "en", "s")])
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    got = toxicity.sample(docs, labels, "toxic", 5, 9, 10, 10)
    assert sorted(tuple(r) for r in got.select("doc_id", "y", "text").collect()) == [(1, 1, "text 0"), (2, 0, None), (3, 0, "other")]


# 8 SimHash


def test_fingerprint_by_definition():
    import xxhash

    for text in [None, "", " \n", "One", "a b", "The cat SAT on É the mat the cat sat on", "x " * 500]:
        ws = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split() if w]
        sh = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] if ws else []
        hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
        assert simhash_dedup.fingerprint(text) == sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_covering_finds_every_pair(spark):
    rng = random.Random(8)
    fps = [rng.getrandbits(64) for _ in range(60)] + [0, (1 << 64) - 1]
    near = set(fps)
    for x in fps:
        for d in (1, 2, 2, 3):
            y = x
            for b in rng.sample(range(64), d):
                y ^= 1 << b
            near.add(y)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in near]
    got = {tuple(sorted((a % (1 << 64), b % (1 << 64)))) for a, b in simhash_dedup.links(spark.createDataFrame(signed, "fp long")).collect()}
    assert got == {(a, b) for a in near for b in near if a < b and (a ^ b).bit_count() <= 2}


def test_simhash_documents(spark):
    rng = random.Random(9)
    texts = [words(rng, 300) for _ in range(30)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    for i in range(10):
        rows.append((100 + i, texts[i], "en", "t"))
        w = texts[i].split()
        w[150] = "changed"
        rows.append((200 + i, " ".join(w), "en", "t"))
    rows += [(300, None, "en", "s"), (301, "", "en", "s"), (None, texts[0], "en", "s"), (None, "alone here", "en", "s"), (5, texts[5], "en", "s"), (400, words(rng, 30_000), "en", "s")]
    frame = docs_frame(spark, rows)
    got = simhash_dedup.near_duplicates(frame).collect()
    fp = {i: simhash_dedup.fingerprint(t) for i, (_, t, _, _) in enumerate(rows)}
    links = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2]
    root = union_find(links, fp)
    least = {}
    for k, c in root.items():
        i = rows[k][0]
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted((str(rows[k][0]), str(least.get(c))) for k, c in root.items())
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == want
    kept = simhash_dedup.deduplicate(frame)
    assert kept.columns == frame.columns
    assert sorted(str(r["doc_id"]) for r in kept.select("doc_id").collect()) == sorted([str(x) for x in least.values()] + ["None"])
    assert simhash_dedup.deduplicate(frame.limit(0)).count() == 0


def test_simhash_keeps_one_of_every_component_where_ids_repeat(spark):
    rng = random.Random(12)
    a, b, c, d = (words(rng, 300) for _ in range(4))
    rows = [(1, a, "en", "s"), (2, a, "en", "s"), (1, b, "en", "s"), (3, b, "en", "s"), (4, c, "en", "s"), (5, c, "en", "s"), (5, d, "en", "s"), (6, d, "en", "s"), (6, d, "en", "s")]
    # 1 is the smallest id of two components; 5 wins over d only, though it also has a row of c
    kept = simhash_dedup.deduplicate(docs_frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(1, a), (1, b), (4, c), (5, d)])
    rows = [(7, a, "en", "s"), (7, b, "en", "s"), (6, b, "en", "s"), (7, c, "en", "s"), (7, c, "en", "s")]
    kept = simhash_dedup.deduplicate(docs_frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([(7, a), (6, b), (7, c)])


# 9 quality


def test_quality(spark):
    rng = random.Random(10)
    rows, labels = [], []
    for i in range(240):
        good = i % 3 != 0
        text = words(rng, 80) if good else rng.choice([" | ".join(words(rng, 40).split()), " ".join([words(rng, 1)] * 60), words(rng, 60).upper().replace(" ", "!! ")])
        rows.append((i, text, "en", "s"))
        labels.append((i, int(good), 0))
    docs, known = docs_frame(spark, rows), spark.createDataFrame(labels + [(None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    voters = quality.learn(docs, known)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, voters).collect()}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((got[i] >= 0.7) == (i % 3 != 0) for i in held) and all(0 <= s <= 1 for s in got.values())
    odd = docs_frame(spark, [(None, None, None, None), (1, "", None, None), (2, words(rng, 30_000), None, None), (2, "a b", None, None), (2, "a b", None, None)])
    s = [r["score"] for r in quality.score(odd, voters).collect()]
    assert s[0] == s[1] and s[3] == s[4]
    assert quality.keep_good(docs, voters).columns == docs.columns and quality.score(odd.limit(0), voters).count() == 0
    assert [r["score"] for r in quality.score(odd, quality.learn(docs, known.limit(0))).collect()] == [0.5] * 5


def test_votes_against_all_neighbours():
    """Scores are those of sorting every labelled vector by its cosine."""
    rng = random.Random(18)
    texts = [words(rng, rng.randint(1, 60)) + (" !!" * rng.randint(0, 30)) for _ in range(200)]
    y = np.array([int("!!" not in t) for t in texts])
    voters = quality.fit(quality.terms(texts), y, 0.8)
    asked = [words(rng, 30), "a !! b !!", "", None, "漢字 かな", "Привет мир", words(rng, 5000)]
    v = voters.project(quality.terms(asked)).astype(float)
    for got, x in zip(voters.scores(asked), v):
        near = voters.vectors.astype(float) @ x
        last = np.sort(near)[-quality.NEIGHBOURS]
        weight = [max(c, 0) ** quality.SHARPNESS * m if c >= last - 1e-6 else 0 for c, m in zip(near, voters.votes)]
        assert got == pytest.approx(np.dot(weight, y) / max(sum(weight), 1e-9), abs=2e-3)
    cyrillic, chinese = quality.terms(["Привет мир", "漢字 かな"])
    assert cyrillic[: quality.WORDS] @ chinese[: quality.WORDS] == 0


def test_quality_of_documents_with_named_ids(spark):
    rng = random.Random(19)
    docs = spark.createDataFrame([(f"d{i}", words(rng, 40) if i % 2 else "!! " * 40, i) for i in range(120)], "doc_id string, text string, y int")
    known = spark.createDataFrame([(f"d{i}", i % 2) for i in range(120)], "doc_id string, quality int")
    voters = quality.learn(docs, known)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, voters).collect()}
    assert all((got[f"d{i}"] >= 0.7) == bool(i % 2) for i in range(120)) and quality.keep_good(docs, voters).where("y % 2 = 0").count() == 0


# 10 HTML


def test_rendering():
    page = """<html><head><title>T</title><style>x</style></head><body><h1>Head</h1>intro <b>bold</b>text<p>One<p>Two &amp; three<br>four<ul><li>a<li>b<ol><li>x<li>y</ol></ul>
<table><tr><th>Name<th>Qty<tr><td>Apple pie<td>3<tr><td rowspan=2>R<td>1<tr><td>2</table><div style="display: none">no</div><p hidden>no<pre>
 a  b
   c</pre><div>tail &lt;x&gt;</div><scr"""
    assert html_render.render(page).split("\n") == ["Head", "", "intro boldtext", "", "One", "", "Two & three", "four", "", "* a", "* b", "  1. x", "  2. y", "", "Name       Qty", "Apple pie  3", "R          1", "           2", "", " a  b", "   c", "", "tail <x>"]
    assert html_render.render(None) == html_render.render("") == html_render.render("<p>  </p>") == ""
    assert html_render.render("<div>" * 5000 + "deep") == "deep"
    assert html_render.render("<!-- a --><script>var t='</p>'; x</script>see<noscript> this</noscript><a href='>'>link</a> &copy;") == "see thislink ©"


def test_rendering_hides_by_attributes_alone():
    shown = ['<a title="The hidden truth">text</a>', '<b data-x="a hidden gem">text</b>', "<i class='a hidden b'>text</i>", '<i data-style="display:none">text</i>', '<i title="style=display:none">text</i>', '<i style="content:\'display:none\'">text</i>', '<i style="display:none;display:inline">text</i>', "<dialog open>text</dialog>"]
    assert [html_render.render(x) for x in shown] == ["text"] * len(shown)
    unseen = ["<i hidden>no</i>", "<i hidden=''>no</i>", "<i a=b HIDDEN class=c>no</i>", "<i style='color:red; DISPLAY : none !important'>no</i>", "<i style=display:none>no</i>", '<i style="visibility:hidden">no</i>', '<dialog class="open">no</dialog>']
    assert [html_render.render(x) for x in unseen] == [""] * len(unseen)


def test_rendering_of_visible_parts_of_hidden_elements():
    assert html_render.render('<div style="visibility:hidden">no<b style="visibility:visible">yes</b><p>no<table><tr><td>no<td style="visibility: visible">cell</table></div>after') == "yes\n\ncell\nafter"
    assert html_render.render('<ul style="visibility:collapse"><li>no<li style="visibility:visible">two</ul><img alt=x style="visibility:hidden">') == "* two"
    assert html_render.render('<div style="visibility:visible"><pre style="visibility:hidden">no <i style="visibility:visible">yes</i></pre></div>').strip() == "yes"


def test_rendering_of_numbered_lists():
    assert html_render.render("<ol start=3><li>a<li value=7>b<li>c</ol>") == "3. a\n7. b\n8. c"
    assert html_render.render("<ol reversed><li>a<li>b<li>c</ol>") == "3. a\n2. b\n1. c"
    assert html_render.render("<ol reversed start=5><li>a<li value=2>b<li>c</ol><ol start=x><li>d</ol>") == "5. a\n2. b\n1. c\n\n1. d"


def test_rendering_of_deep_and_wide_pages():
    """Nothing is lost below the deepest level, in wide cells or in very long pages."""
    for tag in ("div", "blockquote", "span", "ul><li", "table><tr><td"):
        assert "".join(html_render.render(f"<{tag}>w" * 3000 + "end").split()).replace("*", "").endswith("wend")
    page = "<table>" + "<tr><td>" + "x" * 5000 + "<td>y<tr><td>a<td>b</table>" + "<p>tail words</p>" * 50_000
    got = html_render.render(page).split("\n")
    assert got[0] == "x" * 5000 + "  y" and got[1].split() == ["a", "b"] and got.count("tail words") == 50_000


def test_rendering_of_formulas_drawings_and_lists():
    assert html_render.render("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> b") == "a x=2 b"
    assert html_render.render("<p>a <svg><title>t</title><defs><text>no</text></defs><g><text>one <tspan>two</tspan></text></g><text/></svg> b") == "a one two b"
    options = "<option>x<option{}>y<option>z"
    assert html_render.render(f"<p>a <select>{options.format('')}</select> b") == "a x b"
    assert html_render.render(f"<p>a <select>{options.format(' selected')}</select> b") == "a y b"
    assert html_render.render(f"<p>a <select multiple>{options.format('')}</select> b") == "a x y z b"
    assert html_render.render("<p>a <select hidden><option>x</select> b") == "a b"


def test_rendering_keeps_every_visible_word(spark, small):
    """Against a plain walk with the standard library's parser."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.off = [], 0

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("head", "script", "style")

        def handle_endtag(self, tag):
            self.off -= tag in ("head", "script", "style") and self.off > 0

        def handle_data(self, data):
            if not self.off:
                self.out.append(data)

    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_render.extract(pages).collect()}
    for r in pages.collect():
        if r["html"] and r["html"].endswith("</html>"):
            p = Plain()
            p.feed(r["html"])
            squeeze = lambda t: "".join(c for c in t if not c.isspace() and c not in "*")
            assert squeeze(got[r["page_id"]]) == squeeze("".join(p.out))
    odd = spark.createDataFrame([(None, None, "u"), (1, "", "u"), (1, "<b>x", "u"), (1, "<b>x", "u")], "page_id long, html string, text string")
    assert [tuple(r) for r in html_render.extract(odd).collect()] == [(None, ""), (1, ""), (1, "x"), (1, "x")]
    assert html_render.extract(odd.limit(0)).count() == 0


