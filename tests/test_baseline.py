"""The world baseline out of ingested records, and the validation of requests, baselines, graphs, branches and scenarios."""

import json

import pytest
from pyspark.sql import functions as F

from tradeloom.operators import baseline, validation
from tradeloom.plans.storage import written
from tradeloom.sources import adapters


def records(spark):
    def page(x, csv=False):
        return spark.createDataFrame([(bytearray(x.encode() if csv else json.dumps(x).encode()), None, "v1", 1)], "content binary, content_encoding string, source_version string, page_number int")

    trade = lambda r, p, flow, cmd, v, mot="1": {"reporterCode": r, "partnerCode": p, "reporterISO": {"410": "KOR", "158": "TWN", "842": "USA"}[r], "partnerISO": {"410": "KOR", "158": "TWN", "842": "USA"}[p], "period": "2023", "flowCode": flow, "cmdCode": cmd, "primaryValue": v, "motCode": mot}
    given = {
        "UN_COMTRADE": page({"data": [trade("158", "410", "X", "8542", 35), trade("410", "842", "M", "8542", 20), trade("410", "158", "M", "TOTAL", 45), {**trade("158", "410", "X", "9999", 1000), "period": "2020"}]}),
        "WORLD_BANK": page([{}, [{"indicator": {"id": "NY.GDP"}, "country": {"value": "Korea"}, "countryiso3code": "KOR", "date": d, "value": v} for d, v in (("2022", 1), ("2023", 2))]]),
        "SEC": page({"cik": 77, "entityName": "Acme Semiconductor Inc.", "facts": {"us-gaap": {"Assets": {"label": "A", "units": {"USD": [{"end": "2023-12-31", "val": 9, "accn": "a"}]}}}}}),
        "OPENDART": page({"corp_code": "5", "corp_name": "아크메", "corp_name_eng": "ACME SEMICONDUCTOR CO., LTD.", "induty_code": "264"}),
        "HS": page([{"id": "8542", "text": "circuits", "parent": "85"}]),
        "WPI": page("INDEX_NO,PORT_NAME,COUNTRY_CODE\n100,Busan,KR\n", True),
    }
    out = None
    for source, pages in given.items():
        good, bad = adapters.ingest(source, pages)
        assert bad.count() == 0
        out = good if out is None else out.unionByName(good)
    out = out.withColumn("record_id", F.col("fingerprint")).withColumn("run_id", F.lit("r")).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    out = written(out, "records")
    return out.unionByName(out.withColumn("created_at", F.lit("2023-01-01").cast("timestamp")).withColumn("value", F.lit("999")))


def test_world(spark):
    r = records(spark)
    alpha3 = spark.createDataFrame([("KR", "KOR")], "alpha2 string, iso3 string")
    w = baseline.build(r, alpha3)
    kor, twn, usa = (f"country:ISO-3166-1-alpha-3:{c}" for c in ("KOR", "TWN", "USA"))
    edges = {(e["src"], e["dst"]): e for e in w["edges"].collect()}
    assert edges[(twn, kor)]["flow"] == 80 and edges[(usa, kor)]["flow"] == 20 and edges[(twn, kor)]["ratio"] == pytest.approx(0.8) and edges[(twn, kor)]["records"] == 2
    nodes = {n["entity"]: n["metrics"] for n in w["nodes"].collect()}
    assert nodes[kor] == {"DEMAND": 100.0, "WORLD_BANK_NY_GDP": 2.0} and nodes[twn] == {"SUPPLY": 80.0} and nodes["company:DART_CORP_CODE:5"] == {"SEC_US_GAAP_ASSETS": 9.0}
    m = w["manifest"].first()
    assert m["status"] == "READY" and m["edges"] == 2 and m["note"] is None and w["edge_records"].count() == 3
    s = {tuple(x) for x in baseline.semantic(baseline.with_country(baseline.snapshot(r), alpha3)).collect()}
    assert {("HAS_INDICATOR", kor, "indicator:WORLD_BANK_NY_GDP"), ("PARENT_OF", "product:85", "product:8542"), ("PRODUCES", usa, "product:8542"), ("SUPPLIES", "product:8542", kor), ("DEPENDS_ON", kor, "product:8542"), ("SHIPS_VIA", "product:8542", "mode:1"), ("LOCATED_IN", "port:100", kor), ("CLASSIFIED_AS", "company:DART_CORP_CODE:5", "industry:264"), ("HAS_INDICATOR", "company:CIK:77", "indicator:SEC_US_GAAP_ASSETS")} <= s
    assert ("PRODUCES", twn, "product:TOTAL") not in s
    text = baseline.index_text(r.where("source_system = 'HS'")).first()["text"]
    assert "classification_code=8542" in text and "parent=85" in text


def test_small_reads(spark):
    v = spark.createDataFrame([("w", 1, '{"baselineStatus": "READY"}', "2024-01-01"), ("w", 2, "{}", "2024-02-01")], "world_id string, version_number int, state string, created_at string")
    assert baseline.latest_world(v, spark.createDataFrame([("w", "W")], "world_id string, name string"), "w").first()["version_number"] == 1
    e = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, x int")
    assert [r["id"] for r in baseline.in_given_order(e, ["c", "zz", "a"]).collect()] == ["c", "a"]
    m = spark.createDataFrame([("f", "READY", 3), ("g", "PARTIAL", 3)], "fingerprint string, index_status string, records int")
    assert not baseline.snapshot_is_new(m, "f") and baseline.snapshot_is_new(m, "g")
    aliases, docs = baseline.search_documents(spark.createDataFrame([("1", "K", "Taiwan Semi", '{"aliases": ["TSMC", " "], "symbol": "2330"}')], "id string, natural_key string, name string, attributes string"))
    assert {r["alias"] for r in aliases.collect()} == {"taiwan semi", "k", "2330", "tsmc"} and "TSMC" in docs.first()["text"]
    c = spark.createDataFrame([("c1", "e1", "s1"), ("c2", "e1", "s2"), ("c3", None, "s2")], "chunk_id string, evidence_id string, source_id string")
    assert [r["chunk_id"] for r in baseline.misplaced_chunks(c, spark.createDataFrame([("e1", "s1")], "evidence_id string, source_id string")).collect()] == ["c2"]
    results = spark.createDataFrame([("a", None), ("b", "x")], "record_id string, error string")
    assert tuple(baseline.outcomes(results).first()) == (1, 1) and [tuple(r) for r in baseline.failures(results).collect()] == [("b", "x")]
    b = baseline.runs_with_turns(spark.createDataFrame([("A",), ("B",)], "branch_id string"), spark.createDataFrame([("r", "A")], "run_id string, branch_id string"), spark.createDataFrame([("r", 2, "y"), ("r", 1, "x")], "run_id string, turn int, state string"))
    assert {r["branch_id"]: r["turns"] and [t["turn"] for t in r["turns"]] for r in b.collect()} == {"A": [1, 2], "B": None}


def test_faults(spark):
    figures = "production double, capacity double, inventory double, demand double, unit_price double, unit_cost double, workforce double, wage double, productivity double"
    ok = (1.0,) * 9
    c = spark.createDataFrame([("a", "x", *ok), ("b", None, *ok), ("b", "x", *ok), ("d", "x", -1.0, *ok[1:])], f"company string, industry string, {figures}")
    l = spark.createDataFrame([("a", "b", 1.0, 1.0, 1.0), ("a", "b", 1.0, 1.0, 1.0), ("a", "a", 0.0, 1.0, 1.0), ("a", "zz", 1.0, 1.0, 1.0)], "supplier string, customer string, per_output double, max_flow double, unit_cost double")  # noqa: E741
    got = {tuple(r) for r in validation.baseline_faults(c, l).collect()}
    assert got == {("b", "industry is required"), ("b", "company ids must be unique"), ("d", "production is no amount"), ("a>b", "duplicate link"), ("a>a", "self-referencing link"), ("a>a", "per_output is no amount"), ("zz", "links must reference known companies")}
    n = spark.createDataFrame([("x", "T", "m", "o"), ("y", None, "m", None)], "entity string, entity_type string, metrics string, origins string")
    e = spark.createDataFrame([("r", "x", "y", "TRADE_FLOW", 1.5, "p"), ("q", "x", "x", "LOVES", None, None)], "rel string, src string, dst string, type string, ratio double, provenance string")
    assert {r["fault"] for r in validation.graph_faults(n, e).collect()} == {"entity type is required", "metrics require provenance", "ratio must be within 0 and 1", "self-referencing edge", "unsupported type", "ratio is required", "parameters require provenance"}
    b = spark.createDataFrame([(1, "A"), (2, "a ")], "branch int, name string")
    s = spark.createDataFrame([(1, "x", 1), (1, "x", 1), (1, "zz", 9)], "branch int, entity string, turn int")
    assert {r["fault"] for r in validation.branch_faults(b, s, n, 3).collect()} == {"branch names must be unique", "turn is outside of the run", "duplicate shock in a turn", "shocks must reference known entities"}
    q = spark.createDataFrame([("1", "v2", "SUPPLY", "PERCENT", -0.5, 0.9), ("2", "v1", "LOVE", "ABS", 0.0, 0.1)], "id string, contract string, metric string, change_type string, change double, confidence double")
    assert {r["key"] for r in validation.scenario_faults(q, ["SUPPLY"]).collect()} == {"2"} and validation.scenario_faults(q, ["SUPPLY"]).count() == 5
    given = spark.createDataFrame([('{"apiKey": 1, "page": 2}',), ('{"a": "' + "x" * 40000 + '"}',), ("[1]",)], "p string")
    assert [r[0] for r in given.select(validation.parameters_faults("p")).collect()] == [["credential parameter: apiKey"], ["parameters are too long"], ["parameters must be an object"]]


def test_scenarios_and_answers(spark):
    b = validation.scenario_branches(spark.createDataFrame([("what if",)], "question string")).collect()
    import hashlib

    assert [r["branch"] for r in b] == ["A", "B", "C"] and {r["seed"] for r in b} == {int.from_bytes(hashlib.sha256(b"what if").digest()[:7], "big")} and [r["mitigates"] for r in b] == [False, False, True]
    p = spark.createDataFrame([(["a", "b"], ["X"], 2, 1), (["a"], [], 0, 0), ([], [], 0, 0)], "names array<string>, types array<string>, refs int, cites int")
    assert [r[0] for r in p.select(validation.answer(F.col("names"), F.col("types"), F.col("refs"), F.col("cites"))).collect()] == ["Best path: a --X-- b. Based on 2 evidence references and 1 text citations.", "Matched a, but found no path.", "No entity of this world version matched."]
    assert p.select(validation.expanded_query(F.lit("q"), F.col("names"), F.col("types"))).first()[0] == "q a b X"
    r = spark.createDataFrame([((1, [1, 2]),)], "r struct<b:int,a:array<int>>")
    assert r.select(validation.result_hash("r", r.schema["r"].dataType)).first()[0] == hashlib.sha256(b'{"a":[1,2],"b":1}').hexdigest()
