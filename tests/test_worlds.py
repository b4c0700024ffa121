"""Vector search by cells, keyword search by a sparse product, and entities of records."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradeloom.operators import retrieval, worlds


def plain_nearest(x, asked, k):
    u = x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
    out = {}
    for i in asked:
        s = np.floor(u @ u[i] * 1e6 + 0.5) / 1e6
        s[i] = -9
        for r, j in enumerate(np.lexsort((np.arange(len(x)), -s))[:k]):
            out[(i, r + 1)] = (int(j), round(float(s[j]), 6))
    return out


@pytest.mark.parametrize("kind", ["clusters", "even", "few different", "equal"])
def test_cells_rule_out_shards_and_no_row(spark, monkeypatch, kind):
    rng = np.random.default_rng(1)
    centers = rng.normal(size=(30, 16))
    x = {"clusters": centers[rng.integers(0, 30, 3000)] + 0.15 * rng.normal(size=(3000, 16)), "even": rng.normal(size=(3000, 16)), "few different": centers[rng.integers(0, 5, 3000)], "equal": np.ones((3000, 16))}[kind]
    x[20] = 0
    sent = []
    monkeypatch.setattr(retrieval, "SHARD_ROWS", 200)
    real = retrieval.written
    monkeypatch.setattr(retrieval, "written", lambda df, name: sent.append(real(df, name)) or sent[-1] if name == "sent" else real(df, name))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in retrieval.vector_top(rows, rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 10).collect()}
    assert got == plain_nearest(x, range(0, 3000, 50), 10)
    pairs = sent[0].count() + 60
    assert pairs < 60 * 15 * (0.7 if kind == "clusters" else 1.5)


def test_cells_of_splits_without_rows(spark, monkeypatch):
    """Small splits of the written tables, of which some hold no rows."""
    monkeypatch.setattr(retrieval, "SHARD_ROWS", 300)
    x = np.random.default_rng(4).normal(size=(900, 4))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in retrieval.vector_top(rows, rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 3).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == plain_nearest(x, range(0, 900, 50), 3)


def test_median_cells_hold_all_rows():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5000, 8))
    nodes = retrieval.cut_cells(x, 16)
    cells = retrieval.cell_of(nodes, x)
    n = np.bincount(cells)
    assert len(n) == 16 and n.min() > 250
    assert len({c for c in nodes if isinstance(c, int)}) == 16
    assert retrieval.cut_cells(np.zeros((5000, 3)), 8) == [0] and retrieval.cell_of([0], np.zeros((0, 3))).shape == (0,)


def test_keyword_search_is_the_join(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "CELLS", 50)  # the best so far are cut to k often
    rng = random.Random(2)
    words = ["a", "b", "c", "dd", "e1", "ß", "İx", "zz"]
    text = lambda n: " ".join(rng.choices(words, k=rng.randint(0, n)))
    docs = spark.createDataFrame([(i, text(12) if i % 9 else None) for i in range(300)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, text(6)) for i in range(25)] + [(99, None), (98, "never")], "item_id long, text string")
    got = retrieval.keyword_top(docs, asked, "doc_id", "item_id", 7)
    want = retrieval.ranked(retrieval.keyword_scores(docs, asked, "doc_id", "item_id").where("score > 0"), "item_id", "doc_id", 7)
    shown = lambda df: sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    assert shown(got) == shown(want) and got.count() > 100


def test_the_first_record_names_an_entity(spark):
    rows = [
        ("r2", "2024-01-01", "HS", "HS", "x", "10", {"description": "later id"}), ("r1", "2024-01-01", "HS", "HS", "y", "10", {"description": "first"}), ("r0", "2024-02-01", "HS", "HS", "z", "10", {}),
        ("r3", "2024-01-01", "UNLOCODE", "L", "p", "AB", {"function": "1-3", "name": "Port", "latitude": "1.5"}), ("r4", "2024-01-01", "UNLOCODE", "L", "q", "CD", {"function": "-2-"}),
        ("r5", "2024-01-01", "OPENDART", "P", "c", None, {"corpCode": "7", "corpName": "K", "industryCode": "264"}), ("r6", "2024-01-01", "SEC", "F", "d", None, {"cik": "9"}),
    ]
    given = spark.createDataFrame(rows, "record_id string, created_at string, source_system string, record_type string, natural_key string, classification_code string, dimensions map<string,string>")
    for c in ("unit_code", "value", "country_code", "country_code_scheme", "period_start"):
        given = given.withColumn(c, F.lit(None).cast("string"))
    got = {r.natural_key: (r.entity_type, r.name, r.attributes, r.record_id) for r in worlds.entities(given).collect()}
    assert got == {
        "product:HS:10": ("PRODUCT", "first", {"classificationCode": "10"}, "r1"), "port:UNLOCODE:AB": ("PORT", "Port", {"unLocode": "AB", "latitude": "1.5"}, "r3"),
        "company:DART_CORP_CODE:7": ("COMPANY", "K", {"jurisdiction": "KR"}, "r5"), "industry:OPENDART:DART:264": ("INDUSTRY", "DART:264", {"classificationCode": "DART:264"}, "r5"),
    }
