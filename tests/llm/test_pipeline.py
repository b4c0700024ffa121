"""The pipeline's stages against plain versions of them, each on what the stage before kept."""

import zlib

import numpy as np

import corpus_pipeline
from tradeloom.llm import mixing, packing, quality, simhash_dedup, toxicity


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "toxicity", "simhash_near_dedup", "mixing", "packing"]
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())

    voters = quality.learn(docs, labels)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = [i for i, t in rows if voters.scores([t])[0] >= quality.ACCEPT]
    good = stages["quality"](spark, docs, small).cache()
    assert ids(good) == sorted(want) and good.columns == names and 0 < len(want) < len(rows)
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2}
    assert len(bad & set(want)) <= 0.1 * len(bad)

    lexicon = toxicity.learn(good, labels)
    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    want = [i for i, t in rows if lexicon.scores(*lexicon.sums([t]))[0] < toxicity.REJECT]
    clean = stages["toxicity"](spark, good, small).cache()
    assert ids(clean) == sorted(want) and clean.columns == names

    rows = [(r["doc_id"], simhash_dedup.fingerprint(r["text"])) for r in clean.collect()]
    root = dict.fromkeys((i for i, _ in rows))
    root = {i: i for i in root}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in rows:
        for j, b in rows:
            if i < j and (a ^ b).bit_count() <= 2:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    single = stages["simhash_near_dedup"](spark, clean, small).cache()
    assert ids(single) == sorted({find(i) for i in root}) and single.columns == names

    plan = {r["doc_id"]: r["copies"] for r in mixing.copies(single).collect()}
    mixed = stages["mixing"](spark, single, small).cache()
    assert mixed.columns == names and ids(mixed) == sorted(i for i, n in plan.items() for _ in range(n))

    enc = packing.encoder(packing.tokenizer_path())
    text = {r["doc_id"]: r["text"] for r in mixed.collect()}
    got = {}
    for r in stages["packing"](spark, mixed, small).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    for i, t in text.items():
        all_ids = np.append(enc.encode(t), np.uint16(0)).astype("<u4")
        assert sum(n for _, n, _ in got[i]) == plan[i] * len(all_ids)
        assert all(zlib.crc32(all_ids[s : s + n].tobytes()) == c for s, n, c in got[i])


def test_run(spark, small):
    out = corpus_pipeline.run(spark, small)
    sizes = out.groupBy("sequence_id").sum("length").collect()
    assert sizes and max(r[1] for r in sizes) <= 1024


def test_stages_on_odd_documents(spark, small):
    """Each stage on nulls, empty texts, repeated rows and repeated ids: exactly the rows that its own scores or a plain version choose."""
    rows = [(None, None, None, None, None), (1, "", None, None, 0), (2, None, "en", "s", None), (2, None, "en", "s", None), (3, "plain words here", None, None, 16), (3, "plain words here", None, None, 16), (4, "you idiot, you moron", "en", "t", 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    key = lambda r: (str(r[0]), str(r[1]))
    stages = dict(corpus_pipeline.STAGES)
    got = {name: sorted(map(key, stage(spark, docs, small).select("doc_id", "text" if name != "packing" else "start").collect())) for name, stage in stages.items()}
    voters = quality.learn(docs, labels)
    assert got["quality"] == sorted(key(r) for r in rows if voters.scores([r[1]])[0] >= quality.ACCEPT)
    assert got["toxicity"] == sorted(key(r) for r in rows if r[0] != 4)
    assert got["simhash_near_dedup"] == sorted([("1", ""), ("3", "plain words here"), ("4", "you idiot, you moron")])
    copies = {key((r["doc_id"], None if r["size"] == 0 and r["doc_id"] != 1 else {1: "", 3: rows[4][1], 4: rows[6][1]}[r["doc_id"]])): r["copies"] * r["rows"] for r in mixing.copies(docs).collect()}
    assert got["mixing"] == sorted(k for k, n in copies.items() for _ in range(n))
    assert sorted(i for i, _ in got["packing"]) == sorted(str(r[0]) for r in rows)
    for name, stage in stages.items():
        empty = stage(spark, docs.limit(0), small)
        assert empty.count() == 0 and (name == "packing" or empty.columns == docs.columns)


def test_clashing_columns(spark, small):
    """Columns named like those that the stages make inside are carried along untouched."""
    from pyspark.sql import functions as F

    names = ["id", "body", "fp", "component_id", "rep", "h", "size", "rows", "copies", "target", "units", "block", "draw", "p", "score", "hits", "y", "offset"]
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(40)
    for i, n in enumerate(names):
        docs = docs.withColumn(n, F.col("doc_id") + i)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        if name != "packing":
            assert out.columns == docs.columns
            assert out.where(" or ".join(f"{n} <> doc_id + {i}" for i, n in enumerate(names))).count() == 0
        else:
            assert out.count() > 0
