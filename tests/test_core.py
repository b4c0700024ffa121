"""Sources, validation, resolution, ontology, graph, retrieval, simulation and streaming on small cases worked out by hand."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tradeloom.functions import text as fn
from tradeloom.operators import graph, ingest, joins, ontology, provenance, resolve, retrieval, simulate
from tradeloom.sources import adapters, payloads
from tradeloom.streaming import events


def pages(spark, *contents, encoding=None):
    return spark.createDataFrame([(bytearray(c), encoding, "v1", i + 1) for i, c in enumerate(contents)], "content binary, content_encoding string, source_version string, page_number int")


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in files.items():
            z.writestr(name, body)
    return out.getvalue()


J = lambda x: json.dumps(x).encode()
SAMPLES = {
    "SEC": (J({"cik": "77", "name": "Acme", "tickers": ["AC"], "filings": {"recent": {"accessionNumber": ["0-1"], "filingDate": ["2024-05-06"], "reportDate": ["2024-03-31"], "form": ["10-Q"], "primaryDocument": ["a.htm"]}}}), "SEC_FILING", "77:0-1"),
    "OPENDART": (J({"status": "000", "list": [{"corp_code": "0012", "corp_name": "가나", "corp_cls": "Y", "report_nm": "R", "rcept_no": "20240102000001", "rcept_dt": "20240102"}]}), "OPENDART_FILING", "0012:20240102000001"),
    "UN_COMTRADE": (J({"data": [{"reporterCode": 410, "partnerCode": 842, "period": "2022", "flowCode": "M", "cmdCode": "8542", "classificationCode": "H6", "primaryValue": 12.5, "qtyUnitAbbr": "kg"}]}), "TRADE_FLOW", "410:842:2022:M:8542"),
    "WORLD_BANK": (J([{"page": 1}, [{"indicator": {"id": "X.Y"}, "country": {"value": "Chad"}, "countryiso3code": "TCD", "date": "2020", "value": 5, "unit": "", "decimal": 0}, {"indicator": {"id": "X.Y"}, "countryiso3code": "TCD", "date": "2021", "value": None}]]), "MACRO_INDICATOR", "TCD:X.Y:2020"),
    "USGS": (J({"metadata": {"api": "1.14"}, "features": [{"id": "q1", "properties": {"mag": 5.5, "place": "sea", "time": 1700000000000, "net": "us", "type": "earthquake"}, "geometry": {"coordinates": [1.5, 2.5, 10]}}]}), "EARTHQUAKE", "q1"),
    "UNLOCODE": (zipped({"x/part1.csv": ',KR,PUS,"Busan, port",Busan,26,1234----,AI,2401,,3506N 12904E,\n', "readme.txt": "x"}), "LOCATION_CODE", "KRPUS"),
    "WPI": (b"INDEX_NO,PORT_NAME,COUNTRY_CODE,LATITUDE,LONGITUDE\r\n100,Alpha,KR,1,2\r\n,none,KR,1,2\r\n", "PORT", "100"),
    "HS": (J({"results": [{"code": "8542", "description": "circuits", "parent": "85"}]}), "HS_CLASSIFICATION", "HS2022:8542"),
    "ISIC": (b"Code,Description,Level\n26,Computers,Division\n", "ISIC_CLASSIFICATION", "ISIC4:26"),
    "UN_WPP": (b"LocID,ISO3_code,ISO2_code,Location,VarID,Variant,Time,TPopulation1July\n410,KOR,KR,Korea,2,Medium,2030,\"51,000\"\n", "POPULATION_TARGET", "410:2030:null:null:2"),
    "ILOSTAT": (b"ref_area,indicator,source,sex,classif1,classif2,time,obs_value\nKOR,UNE,BA,SEX_T,AGE,,2023Q1,2.5\n", "LABOR_INDICATOR", "KOR:UNE:2023Q1:SEX_T:AGE:null"),
    "KOSIS": (J([{"TBL_ID": "T1", "TBL_NM": "t", "PRD_DE": "202301", "PRD_SE": "M", "ITM_ID": "I", "ITM_NM": "i", "UNIT_NM": "u", "DT": "1,234.5", "C1": "00", "C1_NM": "all"}]), "KOREAN_STATISTIC", "T1:202301:I:00:null:null"),
    "OECD": (b"DATAFLOW,REF_AREA,FREQ,MEASURE,UNIT_MEASURE,TIME_PERIOD,OBS_VALUE,CURRENCY,VERSION\nD,KOR,Q,GDP,CUR,2023-Q2,10.5,USD,1.0\n", "OECD_STATISTIC", "KOR:GDP:2023-Q2:Q:null:null"),
}


@pytest.mark.parametrize("source", sorted(SAMPLES))
def test_each_source_gives_one_valid_record(spark, source):
    content, kind, key = SAMPLES[source]
    good, bad = adapters.ingest(source, pages(spark, content))
    rows = good.collect()
    assert [(r["record_type"], r["natural_key"]) for r in rows] == [(kind, key)] and bad.count() == 0
    assert rows[0]["source_record"] and rows[0]["value"] and len(rows[0]["fingerprint"]) == 64
    twice, _ = adapters.ingest(source, pages(spark, content, content))
    assert twice.count() == 1


def test_fields_of_sources(spark):
    one = lambda s: adapters.ingest(s, pages(spark, SAMPLES[s][0]))[0].first()
    r = one("UN_COMTRADE")
    assert (r["value"], r["currency_code"], str(r["period_start"]), str(r["period_end"]), r["country_code_scheme"]) == ("12.5", "USD", "2022-01-01", "2022-12-31", "UN-M49")
    r = one("UN_WPP")
    assert (r["value"], r["unit_code"], r["country_code"]) == ("51000", "thousands", "KOR")
    r = one("KOSIS")
    assert (r["value"], str(r["period_start"])) == ("1234.5", "2023-01-01")
    r = one("USGS")
    assert (r["value"], str(r["observed_at"]), r["dimensions"]["depthKm"]) == ("5.5", "2023-11-14 22:13:20", "10")
    assert str(one("OECD")["period_start"]) == "2023-01-01" and one("UNLOCODE")["dimensions"]["name"] == "Busan, port"
    facts = J({"cik": 77, "entityName": "Acme", "facts": {"us-gaap": {"Assets": {"label": "A", "units": {"USD": [{"end": "2023-12-31", "val": 9, "accn": "a", "fy": 2023}], "shares": [{"start": "2023-01-01", "end": "2023-12-31", "val": 2, "accn": "b"}]}}}}})
    rows = {r["unit_code"]: r for r in adapters.ingest("SEC", pages(spark, facts))[0].collect()}
    assert rows["USD"]["natural_key"] == "77:us-gaap:Assets:USD:a:null:2023-12-31:null" and rows["USD"]["currency_code"] == "USD" and str(rows["USD"]["period_start"]) == "2023-12-31"
    assert rows["shares"]["currency_code"] is None and str(rows["shares"]["period_start"]) == "2023-01-01"
    profile = J({"corp_code": "1", "corp_name": "가", "corp_name_eng": "Ga", "stock_code": "005"})
    assert adapters.ingest("OPENDART", pages(spark, profile))[0].first()["record_type"] == "OPENDART_COMPANY_PROFILE"
    with pytest.raises(Exception, match="KOSIS error: no key"):
        adapters.ingest("KOSIS", pages(spark, J({"err": "20", "errMsg": "no key"})))[0].collect()


def test_payloads():
    import gzip

    assert payloads.text(payloads.decoded(gzip.compress("﻿é".encode()))) == "é" and payloads.text(b"\x93x\x94") == "“x”"
    assert list(payloads.csv_rows('a,b,c\r\n"x, ""y""", 2 \r\n\r\n')) == [{"a": 'x, "y"', "b": "2", "c": ""}]
    with pytest.raises(payloads.PayloadError):
        list(payloads.unzipped(zipped({"../evil.csv": "x"})))


def test_rejection(spark):
    good, bad = adapters.ingest("WPI", pages(spark, b"INDEX_NO,COUNTRY_CODE\n1,KR\n2,Korea\n"))
    assert good.count() == 1 and [r["errors"] for r in bad.collect()] == [["country code does not match scheme"]]


def test_sinks(spark, tmp_path):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, ingest.insert_absent(new, old, ["k"]).collect())) == [(3, "d")]
    assert sorted(map(tuple, ingest.upsert(old, new.distinct(), ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    path = str(tmp_path / "t")
    ingest.replace_partition(old, path, "k")
    ingest.replace_partition(new.distinct(), path, "k")
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    v = spark.createDataFrame([("w", 1), ("w", 4)], "world_id string, version_number int")
    assert ingest.next_version(v, "w").first()[0] == 5 and ingest.next_version(v, "x").first()[0] == 1


def test_text_functions(spark):
    df = spark.createDataFrame([("2024", "1,234.5", "https://h/p?api_key=1&q=2&X-Token=3", "ＴＳＭＣ ß")], "d string, n string, u string, t string")
    r = df.select(fn.flexible_date("d").alias("d"), fn.number("n").alias("n"), fn.redacted("u").alias("u"), fn.nfkc_casefold("t").alias("t"), fn.company_name(F.lit("Acme, Inc. Ltd")).alias("c"), fn.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("h")).first()
    assert str(r["d"]) == "2024-01-01" and float(r["n"]) == 1234.5 and r["u"] == "https://h/p?api_key=REDACTED&q=2&X-Token=REDACTED" and r["t"] == "tsmc ss" and r["c"] == "acme" and abs(r["h"] - 111.195) < 0.001
    q = spark.createDataFrame([("  ＴＳＭＣ   대만 팹 대만  영향  ",)], "q string").select(graph.search_query(fn.nfkc_casefold("q")).alias("q")).first()[0]
    assert q == "tsmc OR 대만 OR 팹 OR 영향"


def test_proximity_is_exact(spark):
    rng = random.Random(3)
    a = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(120)]
    b = [(i, rng.choice([-89.9, 89.5, 0.0, rng.uniform(-90, 90)]), rng.choice([179.9, -179.9, rng.uniform(-180, 180)])) for i in range(120)]
    left, right = spark.createDataFrame(a, "a int, a_lat double, a_lon double"), spark.createDataFrame(b, "b int, b_lat double, b_lon double")
    got = {(r["a"], r["b"]) for r in joins.within(left, right, 900).collect()}
    plain = left.crossJoin(right).where(F.round(fn.haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")), 3) <= 900)
    assert got == {(r["a"], r["b"]) for r in plain.collect()} and joins.within(left, right, 900).count() == len(got)


def test_resolution(spark):
    known = spark.createDataFrame([("COMPANY", "CIK", "77", "e1"), ("COMPANY", "LEI", "xyz", "e2")], "entity_type string, scheme string, value string, entity_id string")
    asked = spark.createDataFrame([("a", "COMPANY", "cik", " 77 "), ("b", "COMPANY", "cik", "77"), ("b", "COMPANY", "lei", "XYZ"), ("c", "COMPANY", "cik", "1")], "candidate string, entity_type string, scheme string, value string")
    assert sorted(map(tuple, resolve.match_keys(asked, known).collect())) == [("a", 1, "e1", "MATCHED"), ("b", 2, None, "CONFLICT"), ("c", 0, None, "NEW")]
    assert resolve.untrusted(spark.createDataFrame([("a", "nickname"), ("a", "iso-alpha2")], "candidate string, scheme string")).count() == 1
    names = spark.createDataFrame([("e1", "COMPANY", "Samsung Electronics Co., Ltd."), ("e2", "COMPANY", "Hyundai Heavy Industries Corp"), ("e3", "COMPANY", "Twin"), ("e4", "COMPANY", "TWIN Inc")], "entity_id string, entity_type string, name string")
    c = spark.createDataFrame([("a", "COMPANY", "SAMSUNG ELECTRONICS"), ("b", "COMPANY", "Hyundai Heavy Industriess"), ("c", "COMPANY", "Twin Corp"), ("d", "COMPANY", "ab")], "candidate string, entity_type string, name string")
    assert {(r["candidate"], r["entity_id"]) for r in resolve.match_names(c, names, 0.95).collect()} == {("a", "e1"), ("b", "e2")}


def test_ontology(spark):
    cat = spark.createDataFrame([("X", "n", "INTEGER", True), ("X", "u", "URI", False), ("X", "d", "DATE", False)], "entity_type string, property string, kind string, required boolean")
    e = spark.createDataFrame([("1", "X", '{"n": 5, "u": "http://a", "extra": 1}'), ("2", "X", '{"n": "x", "d": "2024-02-30"}'), ("3", "X", "{}")], "id string, entity_type string, attributes string")
    assert {tuple(r) for r in ontology.property_violations(e, cat).collect()} == {("2", "n", "not a integer"), ("2", "d", "not a date"), ("3", "n", "missing")}
    schema = {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "number", "minimum": 0, "maximum": 1}, "k": {"type": "string", "enum": ["x"]}}}
    rows = spark.createDataFrame([("1", '{"a": 0.5}'), ("2", '{"a": 2, "k": "y", "z": 1}'), ("3", "[]"), ("4", "nope")], "id string, payload string")
    assert {r["id"]: len(r["faults"]) for r in ontology.schema_violations(rows, schema).collect()} == {"2": 3, "3": 1, "4": 1}
    v = spark.createDataFrame([(1, "2024-01-01", "2023-01-01"), (2, None, "2024-01-01"), (3, "2024-01-01", None)], "id int, valid_from string, valid_to string")
    assert {r["id"] for r in ontology.validity_violations(v).collect()} == {1, 2}
    g = spark.createDataFrame([("A", "x", "y")], "type string, source_type string, target_type string")
    assert ontology.grammar_violations(spark.createDataFrame([("A", "x", "y"), ("A", "y", "x")], g.schema), g).count() == 1


def test_provenance(spark):
    links = spark.createDataFrame([("s", "/a", "e", None), ("s", "/a", "e", None), ("s", "/a", "e", "x"), ("s", "a", "e", None), ("s", "/a~1b", None, "x")], "subject_id string, path string, evidence_id string, assumption_id string")
    assert provenance.valid_links(links).count() == 2
    new, taken = provenance.register_source(spark.createDataFrame([("a",)], "source_key string"), spark.createDataFrame([("a",), ("b",)], "source_key string"))
    assert [r[0] for r in new.collect()] == ["b"] and [r[0] for r in taken.collect()] == ["a"]


def test_paths(spark):
    e = spark.createDataFrame([("OPERATES", "c", "f"), ("EMPLOYS", "c", "d"), ("MEMBER_PROFILE_OF", "h", "d")], "type string, source string, target string")
    p = {tuple(r["nodes"]): r["types"] for r in graph.simple_paths(e, spark.sql("SELECT 'f' AS node"), 3).collect()}
    assert p[("f", "c", "d", "h")] == ["OPERATES", "EMPLOYS", "MEMBER_PROFILE_OF"] and len(p) == 3
    want, got = spark.createDataFrame([("q", "A>B"), ("q", "C")], "case_id string, types string"), spark.createDataFrame([("q", "A>B"), ("q", "D")], "case_id string, types string")
    assert tuple(graph.path_scores(want, got).first()) == ("q", 0.5, 0.5, 0.5)
    refs = graph.evidence_refs(spark.createDataFrame([("n", '{"a": [{"evidenceId": "00000000-0000-0000-0000-000000000001", "sourceUri": "u"}, {"dataSourceId": "bad"}]}'), ("m", "{")], "id string, attributes string"))
    assert sorted(map(str, map(tuple, refs.collect()))) == sorted(map(str, [("n", "00000000-0000-0000-0000-000000000001", None, "u"), ("n", None, None, None)]))


def test_retrieval_figures(spark):
    r = spark.createDataFrame([("q1", 1, True), ("q1", 2, False), ("q2", 1, False), ("q2", 2, True)], "query_id string, rank int, relevant boolean")
    assert tuple(retrieval.ranking_metrics(r, 2).first()) == (2, 1.0, 0.75)
    t = spark.createDataFrame([(10.0,), (30.0,)], "ms double")
    assert retrieval.nearest_rank(t, "ms", 0.5).first()[0] == 10.0 and retrieval.nearest_rank(t, "ms", 0.95).first()[0] == 30.0
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "item string, rank int").withColumn("q", F.lit(1)), spark.createDataFrame([("y", 1), ("z", 2)], "item string, rank int").withColumn("q", F.lit(1))
    fused = retrieval.fuse(a, b, by="q", item="item")
    assert [r["item"] for r in fused.orderBy(F.desc("score"), "item").collect()] == ["y", "x", "z"]
    text = "# Supply shock\n" + "word " * 400 + "\n## Employment\njobs fell\n"
    c = retrieval.chunks(spark.createDataFrame([("d", text), ("e", None)], "doc_id string, text string")).collect()
    assert all(text[r["begins"] : r["ends"]] == r["content"] for r in c) and c[-1]["section"] == ["Supply shock", "Employment"] and c[0]["section"] == ["Supply shock"]
    assert [r["ordinal"] for r in c] == list(range(len(c)))
    v = retrieval.hashing_embedding(spark.createDataFrame([("d", "a b")], "doc_id string, text string"), "doc_id", "text").first()["embedding"]
    assert len(v) == 384 and abs(sum(x * x for x in v) - 1) < 1e-5
    assert retrieval.candidate_limit(3) == 20 and retrieval.candidate_limit(10) == 40 and retrieval.candidate_limit(50) == 100


def graph_case(spark, mitigates):
    e = spark.createDataFrame([("r1", "tw", "kr", 0.35, "TRADE_FLOW"), ("r2", "us", "kr", 0.2, "TRADE_FLOW")], "rel string, src string, dst string, ratio double, type string")
    e = e.join(simulate.alternatives(e), "rel")
    s = spark.createDataFrame([(1, 1, "tw", "SUPPLY", -0.5, mitigates)], "branch int, turn int, src string, metric string, change double, mitigates boolean")
    n = spark.createDataFrame([("tw", "SUPPLY", 900.0), ("kr", "SUPPLY", 650.0), ("us", "DEMAND", 1.0)], "entity string, metric string, value double")
    ch = simulate.changes(simulate.propagate(e, s, 3), s)
    return {(r["entity"], r["turn"]): r["value"] for r in simulate.states(n, ch, 3).where("metric = 'SUPPLY'").collect()}, simulate.missing_metrics(ch, n)


def test_shock_golden(spark):
    plain, missing = graph_case(spark, False)
    assert plain[("kr", 1)] == pytest.approx(536.25) and plain[("tw", 1)] == pytest.approx(450.0) and plain[("kr", 3)] == pytest.approx(536.25) and missing.count() == 0
    soft, _ = graph_case(spark, True)
    assert soft[("kr", 1)] == pytest.approx(559.0)


def test_cycles_fire_once_and_changes_are_held(spark):
    e = spark.createDataFrame([("a", "x", "y", 1.0), ("b", "y", "x", 1.0), ("c", "x", "z", 1.0), ("d", "y", "z", 1.0)], "rel string, src string, dst string, ratio double")
    s = spark.createDataFrame([(1, 1, "x", "SUPPLY", -0.7, False)], "branch int, turn int, src string, metric string, change double, mitigates boolean")
    t = simulate.propagate(e, s, 3)
    assert sorted(r["rel"] for r in t.collect()) == ["a", "b", "c", "d"]
    assert {r["entity"]: round(r["change"], 6) for r in simulate.changes(t, s).collect()} == {"x": -1.0, "y": -0.7, "z": -1.0}


def test_first_shock_takes_a_common_edge(spark):
    """Shocks on A (edge r9) and then on B (edge r1) both reach X; its edge r5 fires for A's, and a type without a rule passes nothing on."""
    e = spark.createDataFrame([("r9", "A", "X", 1.0, "TRADE_FLOW"), ("r1", "B", "X", 1.0, "SUPPLIES"), ("r5", "X", "Y", 0.5, "DEPENDS_ON"), ("r6", "X", "Z", 0.5, "LOVES")], "rel string, src string, dst string, ratio double, type string")
    s = spark.createDataFrame([(1, 1, 0, "A", "SUPPLY", -1.0, False), (1, 1, 1, "B", "SUPPLY", -0.2, False)], "branch int, turn int, ord int, src string, metric string, change double, mitigates boolean")
    t = {r["rel"]: (r["input"], r["propagated"]) for r in simulate.propagate(e, s, 3).collect()}
    assert t == {"r9": (-1.0, -1.0), "r1": (-0.2, -0.2), "r5": (-1.0, -0.5)}
    assert {r["entity"]: round(r["change"], 6) for r in simulate.changes(simulate.propagate(e, s, 3), s).collect()} == {"A": -1.0, "B": -0.2, "X": -1.0, "Y": -0.5}


def test_names_against_every_pair(spark):
    """The keys miss no pair within the similarity: long names with edits at both ends too."""
    rng = random.Random(9)
    letters = "abcdefg"
    long = "".join(rng.choices(letters, k=57))
    names = [long, "x" + long[1:-1] + "x"]
    for n in (3, 10, 24, 25, 26, 49, 50, 51, 80):
        base = "".join(rng.choices(letters, k=n))
        names.append(base)
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(1, 4)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], ["z"], [w[k], "y"]])
            names.append("".join(w))
    df = spark.createDataFrame([(i, "T", n) for i, n in enumerate(names)], "id int, entity_type string, name string")
    keys_a, keys_b = df.select("id", F.explode(resolve._keys("name", 0.96, False)).alias("key")), df.select(F.col("id").alias("other"), F.explode(resolve._keys("name", 0.96, True)).alias("key"))
    met = {tuple(r) for r in keys_a.join(keys_b, "key").select("id", "other").distinct().collect()}
    near = df.alias("a").crossJoin(df.alias("b")).where(fn.similarity(F.col("a.name"), F.col("b.name")) >= 0.96).select("a.id", "b.id")
    assert {tuple(r) for r in near.collect()} <= met


def test_shock_combination(spark):
    s = spark.createDataFrame([(1, "a", 0.5, 1.0, 1.0, 2.0), (1, "a", 0.5, 1.0, 1.0, 1.5)], "turn int, company string, supply double, demand double, capacity double, price double")
    assert tuple(simulate.combined_shocks(s).first())[2:] == (0.25, 1.0, 1.0, 3.0)


def test_stream_ingests_each_record_once(spark, small, tmp_path):
    e = spark.read.parquet(f"{small}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    folder = str(tmp_path / "in")
    e.repartition(3).write.parquet(folder)
    e.limit(50).write.mode("append").parquet(folder)
    target = str(tmp_path / "out")
    events.ingest_stream(events.stream(spark, folder), target, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(target).count() == e.select("event_type", "user_id", "props").distinct().count()
    q = events.tumbling(events.stream(spark, folder, 10)).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(events) FROM w").first()[0] == e.count() + 50
