"""Queries that read every source's format: the tables are written as its payloads, and its adapter reads them."""

from __future__ import annotations

import gzip
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.storage import bound_batches, scratch
from ..plans.tables import table
from . import adapters, payloads

#: Rows of a page.
PAGE = 200
SHOWN = ["record_type", "natural_key", "country_code", "country_code_scheme", "classification_code", "currency_code", "unit_code", "period_start", "period_end"]


def paged(rows: DataFrame, body: Column, key: str, pack: str | None = None, whole: str = "v1") -> DataFrame:
    """Pages of a source from ``rows`` with ``key``, ``PAGE`` of them each; ``body`` puts a page together from ``lines``, the sorted structs ``line`` of its rows."""
    number = F.expr(f"cast({key} div {PAGE} as int)").alias("page_number")
    grouped = rows.groupBy(number).agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col("line")))).alias("s"))
    pages = grouped.select("page_number", F.transform("s", lambda x: x["line"]).alias("lines")).select("page_number", body.alias("body"))
    pages = pages.select(F.col("body").cast("binary").alias("content"), F.lit(pack if pack == "gzip" else None).cast("string").alias("content_encoding"), F.lit(whole).alias("source_version"), "page_number")
    return packed(pages, pack) if pack else pages


def packed(pages: DataFrame, how: str) -> DataFrame:
    """Pages with their content compressed: gzip, or a zip archive with a file beside the rows."""

    def one(content: bytes) -> bytes:
        if how == "gzip":
            return gzip.compress(content, mtime=0)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("readme.txt", "x")
            z.writestr("list/part1.csv", content)
        return out.getvalue()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(content=[one(c) for c in b["content"]])

    bound_batches(pages.sparkSession)
    return pages.mapInPandas(run, pages.schema)


def csv_body(header: str) -> Column:
    return F.concat(F.lit(header + "\r\n"), F.array_join("lines", "\r\n"), F.lit("\r\n"))


def shown(records: DataFrame, *dimensions: str, value: bool = True) -> DataFrame:
    """The canonical columns, and some dimensions as columns of their own."""
    return records.select(*SHOWN, *(["value"] if value else []), *(F.col("dimensions")[d].alias(d) for d in dimensions))


def _line(*parts: Column) -> Column:
    return F.concat_ws(",", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).alias("line")


def _sql(kind: str, key: str, tail: str, country="NULL", scheme="NULL", code="NULL", currency="NULL", unit="NULL", start="NULL", end="NULL", value: str | None = None, **dimensions: str) -> str:
    text = lambda x: f"CAST({x} AS VARCHAR)"
    columns = [f"'{kind}' AS record_type", f"{key} AS natural_key", f"{text(country)} AS country_code", f"{text(scheme)} AS country_code_scheme", f"{text(code)} AS classification_code", f"{text(currency)} AS currency_code", f"{text(unit)} AS unit_code", f"CAST({start} AS DATE) AS period_start", f"CAST({end} AS DATE) AS period_end"]
    columns += [f"{text(value)} AS value"] if value else []
    return f"SELECT {', '.join(columns + [f'{text(v)} AS {k}' for k, v in dimensions.items()])} {tail}"


@query(_sql("SEC_FILING", "o_custkey || ':' || o_orderkey", "FROM orders JOIN customer ON o_custkey = c_custkey", "'US'", "'ISO-3166-1-alpha-2'", "CASE WHEN o_orderkey % 3 = 0 THEN '10-K' ELSE '8-K' END", start="o_orderdate", end="o_orderdate", companyName="c_name"))
def source_sec_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings out of parallel arrays: a customer's orders, one page for each customer."""
    o, c = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate"), table(spark, sf_dir, "customer", "c_custkey", "c_name")
    seen = F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("a"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.when(F.col("o_orderkey") % 3 == 0, "10-K").otherwise("8-K").alias("f")))).alias("s")
    g = o.groupBy("o_custkey").agg(seen).join(c, F.col("o_custkey") == F.col("c_custkey"))
    arrays = F.struct(*(F.col(f"s.{f}").alias(n) for n, f in (("accessionNumber", "a"), ("filingDate", "d"), ("reportDate", "d"), ("form", "f"), ("primaryDocument", "a"))))
    body = F.to_json(F.struct(F.col("o_custkey").cast("string").alias("cik"), F.col("c_name").alias("name"), F.struct(arrays.alias("recent")).alias("filings")))
    pages = g.select(body.cast("binary").alias("content"), F.lit(None).cast("string").alias("content_encoding"), F.lit("v1").alias("source_version"), F.lit(1).alias("page_number"))
    return shown(adapters.sec(pages), "companyName", value=False)


@query(_sql("SEC_XBRL_FACT", "l_partkey || ':us-gaap:' || l_returnflag || ':' || u || ':' || l_orderkey || '-' || l_linenumber || ':' || CASE WHEN l_linenumber % 2 = 0 THEN strftime(l_shipdate, '%Y-%m-%d') ELSE 'null' END || ':' || strftime(l_shipdate, '%Y-%m-%d') || ':null'",
            "FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN 'USD' ELSE 'shares' END AS u FROM lineitem)", "'US'", "'ISO-3166-1-alpha-2'", "l_returnflag", "CASE WHEN u = 'USD' THEN u END", "u", "l_shipdate", "l_shipdate", "CAST(round(l_extendedprice * 100) AS BIGINT)", label="'L ' || l_returnflag", form="'10-Q'"))
def source_sec_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts four levels deep: a part's line items by flag and status, one page for each part."""
    li = table(spark, sf_dir, "lineitem", "l_partkey", "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    one = F.struct(F.when(F.col("l_linenumber") % 2 == 0, day).alias("start"), day.alias("end"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("val"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("accn"), F.lit("10-Q").alias("form"))
    # Observations are made before the rows meet, and a part's rows meet once for all levels.
    seen = li.select("l_partkey", "l_returnflag", F.col("l_linestatus").eqNullSafe("O").alias("usd"), one.alias("o")).repartition("l_partkey")
    units = F.map_filter(F.create_map(F.lit("USD"), F.collect_list(F.when(F.col("usd"), F.col("o"))), F.lit("shares"), F.collect_list(F.when(~F.col("usd"), F.col("o")))), lambda _, o: F.size(o) > 0)
    by_concept = seen.groupBy("l_partkey", "l_returnflag").agg(units.alias("units"))
    concept = F.struct(F.col("l_returnflag"), F.struct(F.concat(F.lit("L "), "l_returnflag").alias("label"), F.col("units")).alias("d"))
    by_part = by_concept.groupBy("l_partkey").agg(F.map_from_entries(F.collect_list(concept)).alias("concepts"))
    body = F.to_json(F.struct(F.col("l_partkey").alias("cik"), F.lit("P").alias("entityName"), F.create_map(F.lit("us-gaap"), F.col("concepts")).alias("facts")))
    pages = by_part.select(body.cast("binary").alias("content"), F.lit(None).cast("string").alias("content_encoding"), F.lit("v1").alias("source_version"), F.lit(1).alias("page_number"))
    return shown(adapters.sec(pages), "label", "form")


@query(_sql("OPENDART_FILING", "o_custkey || ':' || o_orderkey", "FROM orders", "'KR'", "'ISO-3166-1-alpha-2'", "o_orderpriority", start="o_orderdate", end="o_orderdate", market="o_orderstatus", corpNameEng="NULL") + " UNION ALL "
       + _sql("OPENDART_COMPANY_PROFILE", "CAST(s_suppkey AS VARCHAR)", "FROM supplier", "'KR'", "'ISO-3166-1-alpha-2'", "'COMPANY_PROFILE'", market="NULL", corpNameEng="s_name || ' Ltd'"))
def source_opendart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of filings, and company profiles."""
    o, s = table(spark, sf_dir, "orders"), table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    line = F.struct(F.col("o_custkey").alias("corp_code"), F.lit("n").alias("corp_name"), F.col("o_orderstatus").alias("corp_cls"), F.col("o_orderpriority").alias("report_nm"), F.col("o_orderkey").alias("rcept_no"), F.date_format("o_orderdate", "yyyyMMdd").alias("rcept_dt"))
    lists = paged(o.select("o_orderkey", line.alias("line")), F.to_json(F.struct(F.lit("000").alias("status"), F.col("lines").alias("list"))), "o_orderkey")
    profile = F.to_json(F.struct(F.col("s_suppkey").cast("string").alias("corp_code"), F.col("s_name").alias("corp_name"), F.concat("s_name", F.lit(" Ltd")).alias("corp_name_eng"))).alias("line")
    profiles = paged(s.select("s_suppkey", profile), F.explode("lines"), "s_suppkey")
    return shown(adapters.opendart(lists.unionByName(profiles)), "market", "corpNameEng", value=False)


@query(_sql("TRADE_FLOW", "(l_suppkey % 900 + 100) || ':' || (l_partkey % 900 + 100) || ':' || year(l_shipdate) || ':' || CASE WHEN l_linenumber % 2 = 0 THEN 'M' ELSE 'X' END || ':' || l_orderkey || '-' || l_linenumber", "FROM lineitem", "l_suppkey % 900 + 100", "'UN-M49'", "l_orderkey || '-' || l_linenumber", "'USD'", "'kg'", "date_trunc('year', l_shipdate)",
            "date_trunc('year', l_shipdate) + INTERVAL 1 YEAR - INTERVAL 1 DAY", "CASE l_linenumber % 3 WHEN 0 THEN CAST(round(l_extendedprice * 100) AS BIGINT) WHEN 1 THEN CAST(l_quantity AS BIGINT) ELSE l_suppkey END", partnerCode="l_partkey % 900 + 100", flowCode="CASE WHEN l_linenumber % 2 = 0 THEN 'M' ELSE 'X' END"))
def source_un_comtrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade records, whose value is the first of three."""
    li, n = table(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    line = F.struct(
        (F.col("l_suppkey") % 900 + 100).alias("reporterCode"), (F.col("l_partkey") % 900 + 100).alias("partnerCode"), F.year("l_shipdate").cast("string").alias("period"), F.when(n % 2 == 0, "M").otherwise("X").alias("flowCode"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("cmdCode"),
        F.when(n % 3 == 0, F.round(F.col("l_extendedprice") * 100).cast("long")).alias("primaryValue"), F.when(n % 3 == 1, F.col("l_quantity").cast("long")).alias("netWgt"), F.col("l_suppkey").alias("qty"), F.lit("kg").alias("qtyUnitAbbr"),
    )
    return shown(adapters.un_comtrade(paged(li.select("l_orderkey", line.alias("line")), F.to_json(F.struct(F.col("lines").alias("data"))), "l_orderkey")), "partnerCode", "flowCode")


@query(_sql("MACRO_INDICATOR", "'AAA:I' || c_nationkey || ':' || (1990 + c_custkey % 30)", "FROM customer WHERE c_custkey % 5 <> 0", "'AAA'", "'ISO-3166-1-alpha-3'", "'I' || c_nationkey", unit="NULLIF(c_mktsegment, 'BUILDING')", start="make_date(CAST(1990 + c_custkey % 30 AS INTEGER), 1, 1)", end="make_date(CAST(1990 + c_custkey % 30 AS INTEGER), 12, 31)", value="c_custkey", countryName="c_name"))
def source_world_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators in a page's second element; those without a value are left out."""
    k = F.col("c_custkey")
    line = F.struct(F.struct(F.concat(F.lit("I"), "c_nationkey").alias("id")).alias("indicator"), F.struct(F.col("c_name").alias("value")).alias("country"), F.lit("AAA").alias("countryiso3code"), (1990 + k % 30).cast("string").alias("date"), F.when(k % 5 != 0, k).alias("value"), F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise(F.col("c_mktsegment")).alias("unit"))
    body = F.concat(F.lit('[{"page": 1},'), F.to_json("lines"), F.lit("]"))
    return shown(adapters.world_bank(paged(table(spark, sf_dir, "customer").select("c_custkey", line.alias("line")), body, "c_custkey")), "countryName")


@query(_sql("EARTHQUAKE", "'e' || event_id", "FROM events", unit="'Mw'", start="ts", value="user_id", place="event_type", longitude="event_id % 180", depthKm="event_id % 7"))
def source_usgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their places and times in milliseconds."""
    k = F.col("event_id")
    line = F.struct(F.concat(F.lit("e"), k).alias("id"), F.struct(F.col("user_id").alias("mag"), F.col("event_type").alias("place"), F.unix_millis("ts").alias("time")).alias("properties"), F.struct(F.array(k % 180, k % 90, k % 7).alias("coordinates")).alias("geometry"))
    body = F.to_json(F.struct(F.struct(F.lit("1.14").alias("api")).alias("metadata"), F.col("lines").alias("features")))
    e = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return shown(adapters.usgs(paged(e.select("event_id", line.alias("line")), body, "event_id")), "place", "longitude", "depthKm")


@query(_sql("LOCATION_CODE", "'KR' || s_suppkey", "FROM supplier", "'KR'", "'ISO-3166-1-alpha-2'", "'KR' || s_suppkey", name="s_name || ', port'", function="CASE WHEN s_suppkey % 2 = 0 THEN '1---' ELSE '-2--' END"))
def source_unlocode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zipped location files: without a header, names with commas, a file of another kind beside."""
    name = F.concat(F.lit('"'), "s_name", F.lit(', port"'))
    line = _line(F.lit(""), F.lit("KR"), F.col("s_suppkey"), name, F.col("s_name"), F.lit("26"), F.when(F.col("s_suppkey") % 2 == 0, "1---").otherwise("-2--"), F.lit("AI"), F.lit("n.d."), F.lit(""), F.lit("3506N 12904E"), F.lit(""))
    return shown(adapters.unlocode(paged(table(spark, sf_dir, "supplier").select("s_suppkey", line), F.array_join("lines", "\n"), "s_suppkey", "zip")), "name", "function", value=False)


@query(_sql("PORT", "CAST(s_suppkey AS VARCHAR)", "FROM supplier WHERE s_suppkey % 9 <> 0", "CASE WHEN s_suppkey % 4 <> 0 THEN 'KR' END", "CASE WHEN s_suppkey % 4 <> 0 THEN 'ISO-3166-1-alpha-2' END", "s_suppkey", name="s_name || ' \"main\"'", latitude="s_suppkey % 90"))
def source_wpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ports in two spellings of the header, with quotes in names; rows without an index are left out."""
    k = F.col("s_suppkey")
    line = _line(F.when(k % 9 != 0, k), F.concat(F.lit('"'), "s_name", F.lit(' ""main"""')), F.when(k % 4 != 0, "KR"), k % 90, F.lit(" 1 "))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", line)
    a = paged(s.where("s_suppkey % 2 = 0"), csv_body("INDEX_NO,PORT_NAME,COUNTRY_CODE,LATITUDE,LONGITUDE"), "s_suppkey")
    b = paged(s.where("s_suppkey % 2 = 1"), csv_body("World Port Index Number,Main Port Name,Country Code,Latitude,Longitude"), "s_suppkey")
    return shown(adapters.wpi(a.unionByName(b)), "name", "latitude", value=False)


@query(_sql("HS_CLASSIFICATION", "'HS2022:' || p_partkey", "FROM part", code="p_partkey", description="p_name", parent="p_size"))
def source_hs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classification whose rows are a page, or stand under its results."""
    p = table(spark, sf_dir, "part")
    one = lambda c, t: F.struct(F.col("p_partkey").cast("string").alias(c), F.col("p_name").alias(t), F.col("p_size").alias("parent")).alias("line")
    a = paged(p.where("p_partkey % 2 = 0").select("p_partkey", one("id", "text")), F.to_json("lines"), "p_partkey")
    b = paged(p.where("p_partkey % 2 = 1").select("p_partkey", one("code", "description")), F.to_json(F.struct(F.col("lines").alias("results"))), "p_partkey")
    return shown(adapters.hs(a.unionByName(b)), "description", "parent", value=False)


@query(_sql("ISIC_CLASSIFICATION", "'ISIC4:' || p_partkey", "FROM part", code="p_partkey", description="p_type", level="p_size"))
def source_isic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A classification as delimited rows."""
    p = table(spark, sf_dir, "part")
    return shown(adapters.isic(paged(p.select("p_partkey", _line(F.col("p_partkey"), F.col("p_type"), F.col("p_size"))), csv_body("Code,Description,Level"), "p_partkey")), "description", "level", value=False)


@query(_sql("POPULATION_TARGET", "(c_custkey % 900 + 100) || ':' || (2000 + c_nationkey) || ':null:' || c_custkey || ':POP_TOTAL'", "FROM customer", "CASE WHEN c_custkey % 2 = 0 THEN 'ABC' ELSE CAST(c_custkey % 900 + 100 AS VARCHAR) END", "CASE WHEN c_custkey % 2 = 0 THEN 'ISO-3166-1-alpha-3' ELSE 'UN-M49' END", "'POP_TOTAL'", unit="'thousands'",
            start="make_date(2000 + c_nationkey, 1, 1)", end="make_date(2000 + c_nationkey, 12, 31)", value="1000 * c_custkey", location="c_name"))
def source_un_wpp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed population rows with thousands commas: the country's letters, or else its number."""
    k = F.col("c_custkey")
    line = _line(k % 900 + 100, F.when(k % 2 == 0, "ABC"), F.col("c_name"), k, 2000 + F.col("c_nationkey"), F.concat(F.lit('"'), k, F.lit(',000"')))
    return shown(adapters.un_wpp(paged(table(spark, sf_dir, "customer").select("c_custkey", line), csv_body("LocID,ISO3_code,Location,Age,Time,PopTotal"), "c_custkey", "gzip")), "location")


@query(_sql("LABOR_INDICATOR", "CASE WHEN c_custkey % 3 = 0 THEN 'X01' ELSE 'KOR' END || ':UNE:' || (2000 + c_nationkey) || 'Q1:' || CASE WHEN c_custkey % 2 = 0 THEN 'SEX_T' ELSE 'null' END || ':' || c_custkey || ':null'", "FROM customer", "CASE WHEN c_custkey % 3 <> 0 THEN 'KOR' END", "CASE WHEN c_custkey % 3 <> 0 THEN 'ISO-3166-1-alpha-3' END", "'UNE'",
            start="make_date(2000 + c_nationkey, 1, 1)", value="c_custkey", sex="CASE WHEN c_custkey % 2 = 0 THEN 'SEX_T' END"))
def source_ilostat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed labour rows with quarters."""
    k = F.col("c_custkey")
    line = _line(F.when(k % 3 == 0, "X01").otherwise("KOR"), F.lit("UNE"), F.lit("BA"), F.when(k % 2 == 0, "SEX_T"), k, F.lit(""), F.concat(2000 + F.col("c_nationkey"), F.lit("Q1")), k)
    return shown(adapters.ilostat(paged(table(spark, sf_dir, "customer").select("c_custkey", line), csv_body("ref_area,indicator,source,sex,classif1,classif2,time,obs_value"), "c_custkey", "gzip")), "sex")


@query(_sql("KOREAN_STATISTIC", "'T:' || strftime(o_orderdate, '%Y%m') || ':' || o_orderkey || ':00:null:null'", "FROM orders", "'KR'", "'ISO-3166-1-alpha-2'", "o_orderkey", unit="CASE WHEN o_orderkey % 2 = 0 THEN 'won' ELSE 'KRW' END", start="date_trunc('month', o_orderdate)", value="1000 * o_custkey", itemName="o_orderpriority"))
def source_kosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics by month, values with commas, the unit's English name first."""
    k = F.col("o_orderkey")
    line = F.struct(F.lit("T").alias("TBL_ID"), F.date_format("o_orderdate", "yyyyMM").alias("PRD_DE"), k.cast("string").alias("ITM_ID"), F.col("o_orderpriority").alias("ITM_NM"), F.when(k % 2 == 0, " ").otherwise("KRW").alias("UNIT_NM_ENG"), F.lit("won").alias("UNIT_NM"), F.concat("o_custkey", F.lit(",000")).alias("DT"), F.lit("00").alias("C1"))
    return shown(adapters.kosis(paged(table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line")), F.to_json("lines"), "o_orderkey")), "itemName")


@query(_sql("OECD_STATISTIC", "'KOR:GDP:' || strftime(o_orderdate, '%Y-%m') || ':M:' || o_orderkey || ':null'", "FROM orders", "'KOR'", "'ISO-3166-1-alpha-3'", "'GDP'", "CASE WHEN o_orderkey % 2 = 0 THEN 'USD' END", "'CUR'", "date_trunc('year', o_orderdate)", value="o_custkey", activity="o_orderkey"))
def source_oecd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics as delimited rows; the year begins the period's name."""
    k = F.col("o_orderkey")
    line = _line(F.lit("D"), F.lit("KOR"), F.lit("M"), k, F.lit("GDP"), F.lit("CUR"), F.date_format("o_orderdate", "yyyy-MM"), F.col("o_custkey"), F.when(k % 2 == 0, "USD"))
    return shown(adapters.oecd(paged(table(spark, sf_dir, "orders").select("o_orderkey", line), csv_body("DATAFLOW,REF_AREA,FREQ,ACTIVITY,MEASURE,UNIT_MEASURE,TIME_PERIOD,OBS_VALUE,CURRENCY"), "o_orderkey")), "activity")


@query("SELECT c_custkey AS k, c_name || CASE c_custkey % 3 WHEN 2 THEN ', \"é\"' ELSE ', \"x\"' END AS name, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END AS segment FROM customer")
def payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited rows out of payloads with a byte order mark, compressed, and in a Latin character set: quotes, blanks around cells, blank lines, short rows."""
    k = F.col("c_custkey")
    line = F.concat(k.cast("string"), F.lit(',"'), "c_name", F.when(k % 3 == 2, ', ""é""" ').otherwise(', ""x""" '), F.when(k % 2 == 0, F.lit("\r\n  ")).otherwise(F.concat(F.lit(" , "), "c_mktsegment"))).alias("line")
    c = table(spark, sf_dir, "customer").select("c_custkey", line)
    head = csv_body("k, name ,segment")
    marked = paged(c.where("c_custkey % 3 = 0"), F.concat(F.lit("﻿"), head), "c_custkey")
    pages = marked.unionByName(paged(c.where("c_custkey % 3 = 1"), head, "c_custkey", "gzip")).unionByName(paged(c.where("c_custkey % 3 = 2"), F.encode(head, "iso-8859-1"), "c_custkey"))
    raw = F.col("raw")
    return payloads.raw_rows(pages, "csv").select(raw["k"].cast("long").alias("k"), raw["name"].alias("name"), raw["segment"].alias("segment"))


@query("SELECT CAST(row_number() OVER (ORDER BY 'conv_id=' || conv_id || '/') AS INTEGER) AS page_number, string_agg(coalesce(text, '') || chr(10), '' ORDER BY turn) AS body FROM conversations GROUP BY conv_id")
def source_page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a fetched page in a file of its own, numbered by the files' names and read back."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    folder = scratch(spark, "pages")
    payloads.write_page_files(c.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_last("turn")).select("conv_id", "text"), folder)
    return payloads.page_files(spark, folder, "1").select("page_number", F.decode("content", "UTF-8").alias("body"))
