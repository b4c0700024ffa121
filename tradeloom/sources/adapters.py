"""Thirteen sources, read into one canonical record.

A page's rows become maps of text (``raw``); a source is a table of which names give which field. ``records`` puts the canonical columns
together, so that each adapter says only what is its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from . import payloads

CANONICAL = ["record_type", "natural_key", "country_code", "country_code_scheme", "classification_code", "classification_version", "currency_code", "unit_code", "period_start", "period_end", "observed_at", "data_version", "dimensions", "value", "source_record"]
ALPHA2, ALPHA3, M49 = "ISO-3166-1-alpha-2", "ISO-3166-1-alpha-3", "UN-M49"


def pick(*names: str, of: str = "raw") -> Column:
    """The first of a row's fields that is not blank, trimmed."""
    return fn.first_text(*(F.col(of)[n] for n in names))


def key(*parts) -> Column:
    """A natural key; a missing part is the word null."""
    return F.concat_ws(":", *(F.coalesce(p.cast("string") if isinstance(p, Column) else F.lit(p), F.lit("null")) for p in parts))


def whole_key(*parts) -> Column:
    """A natural key that needs all of its parts."""
    return F.concat(*(x for p in parts for x in (F.lit(":"), p))).substr(2, 1 << 20)


def year_end(start: Column) -> Column:
    return F.date_sub(F.add_months(start, 12), 1)


def json_value(v: Column) -> Column:
    """A text as JSON: numbers with or without commas and truth values as they are, else text."""
    bare = F.translate(v, ",", "")
    return F.when(bare.try_cast("decimal(38,9)").isNotNull(), F.regexp_replace(bare, r"^(-?)0+(?=\d)", "$1")).when(v.isin("true", "false"), v).otherwise(F.to_json(F.struct(v.alias("text"))))


def value_of(*names: str, of: str = "raw") -> Column:
    """The first of a row's fields that is there, as JSON."""
    return json_value(F.coalesce(*(F.col(of)[n] for n in names)))


def records(rows: DataFrame, **fields) -> DataFrame:
    """Canonical records; ``dimensions`` is given as a dictionary, and what is null in it is left out."""
    out = []
    kinds = {"period_start": "date", "period_end": "date", "observed_at": "timestamp", "dimensions": "map<string,string>"}
    for name in CANONICAL:
        f = fields.get(name)
        if name == "dimensions":
            f = F.map_filter(F.create_map(*(x for k, v in (f or {}).items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull()) if f else F.create_map().cast("map<string,string>")
        f = F.lit(f) if not isinstance(f, Column) else f
        out.append(f.cast(kinds.get(name, "string")).alias(name))
    return rows.select("page_number", *out)


def _json_rows(pages: DataFrame, path: str | None) -> DataFrame:
    """A page's rows as maps: its array at ``path``, or the page itself. What is nested in a row stays JSON text."""
    p = payloads.json_pages(pages)
    array = F.get_json_object("body", path) if path else F.col("body")
    return p.withColumn("raw", F.explode(F.from_json(array, "array<map<string,string>>"))).withColumn("row", F.to_json("raw"))


def _may_have(name: str) -> Column:
    """Whether a body may have a field of this name: false only if its text lacks it, even behind an escape. Cheaper than parsing a page to find out."""
    return F.contains("body", F.lit(name)) | F.contains("body", F.lit("\\u"))


def sec(pages: DataFrame) -> DataFrame:
    """Filings, whose fields stand in parallel arrays, and facts, four levels deep. Pages are read once for both: each goes on twice, as its filings (``filed``) and as its facts."""
    recent = ["accessionNumber", "filingDate", "reportDate", "form", "primaryDocument"]
    f = F.from_json("body", f"cik string, name string, sic string, sicDescription string, tickers string, filings struct<recent:struct<{','.join(f'{c}:array<string>' for c in recent)}>>")
    g = F.from_json("body", "cik string, entityName string, facts map<string,map<string,struct<label:string,description:string,units:map<string,array<map<string,string>>>>>>")
    p = payloads.json_pages(pages).select("page_number", "source_version", F.when(_may_have("filings"), f).alias("f"), F.when(_may_have("facts"), g).alias("g"))
    filed = F.col("filed")
    p = p.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("filed")).where((filed & F.col("f.filings").isNotNull()) | (~filed & F.col("g.facts").isNotNull()))
    x = F.arrays_zip(*(F.col(f"f.filings.recent.{c}").alias(c) for c in recent))
    kept = ["page_number", "source_version", "filed", "f", "x", F.col("g.cik").alias("cik"), F.col("g.entityName").alias("entityName")]
    u = p.select("*", F.posexplode_outer(F.when(filed, x)).alias("filing", "x")).where(~filed | F.col("filing").isNotNull()).select(*kept, F.explode_outer(F.when(~filed, F.col("g.facts"))).alias("taxonomy", "concepts"))
    # Each level keeps only what the next ones need; what is used more than once becomes a column.
    kept = [*kept[:5], "cik", "entityName", "taxonomy"]
    u = u.select(*kept, F.explode_outer("concepts").alias("concept", "definition")).select(*kept, "concept", "definition.label", F.explode_outer("definition.units").alias("unit", "observations"))
    kept += ["concept", "label", "unit"]
    u = u.select(*kept, F.posexplode_outer("observations").alias("observation", "raw")).where(filed | F.col("observation").isNotNull())
    u = u.select(*kept, "raw", pick("start").alias("start"), pick("end").alias("end"), pick("frame").alias("frame"), F.col("raw")["val"].alias("val"))
    start, end, day = F.col("start"), F.col("end"), F.col("x.filingDate")
    a = dict(
        record_type="SEC_FILING", natural_key=whole_key(F.col("f.cik"), F.col("x.accessionNumber")), classification_code=F.col("x.form"), classification_version="EDGAR", period_start=fn.flexible_date(day), period_end=fn.flexible_date(day),
        dimensions={"cik": F.col("f.cik"), "companyName": F.col("f.name"), "sic": F.col("f.sic"), "sicDescription": F.col("f.sicDescription"), "tickers": F.col("f.tickers")}, value=F.to_json("x"), source_record=F.to_json("x"),
    )
    b = dict(
        record_type="SEC_XBRL_FACT", natural_key=key(F.col("cik"), F.col("taxonomy"), F.col("concept"), F.col("unit"), pick("accn"), start, end, F.col("frame")), classification_code=F.col("concept"), classification_version=F.col("taxonomy"),
        currency_code=F.when(F.col("unit").rlike("^[A-Z]{3}$"), F.col("unit")), unit_code=F.col("unit"), period_start=fn.flexible_date(F.coalesce(start, end)), period_end=fn.flexible_date(end),
        dimensions={"cik": F.col("cik"), "entityName": F.col("entityName"), "label": F.col("label"), "fiscalYear": pick("fy"), "fiscalPeriod": pick("fp"), "form": pick("form"), "filed": pick("filed"), "frame": F.col("frame")}, value=json_value(F.col("val")), source_record=F.to_json("raw"),
    )

    def either(a: dict, b: dict) -> dict:
        column = lambda v: v if isinstance(v, Column) else F.lit(v)
        return {k: F.when(filed, column(a.get(k))).otherwise(column(b.get(k))) for k in [*a, *(k for k in b if k not in a)] if k != "dimensions"}

    return records(u, country_code="US", country_code_scheme=ALPHA2, data_version=F.col("source_version"), dimensions=either(a["dimensions"], b["dimensions"]), **either(a, b))


def opendart(pages: DataFrame) -> DataFrame:
    """Filings, or one company profile where the page has an English name."""
    rows = _json_rows(pages, "$.list")
    filed = fn.flexible_date(pick("rcept_dt"))
    a = records(rows, record_type="OPENDART_FILING", natural_key=key(pick("corp_code"), pick("rcept_no")), country_code="KR", country_code_scheme=ALPHA2, classification_code=pick("report_nm"), classification_version="OpenDART", period_start=filed, period_end=filed, data_version=F.col("source_version"), dimensions={"corpCode": pick("corp_code"), "corpName": pick("corp_name"), "market": pick("corp_cls")}, value=F.col("row"), source_record=F.col("row"))
    one = payloads.json_pages(pages).where(F.get_json_object("body", "$.corp_name_eng").isNotNull()).withColumn("raw", F.from_json("body", "map<string,string>")).where(pick("corp_code").isNotNull() & pick("corp_name").isNotNull())
    b = records(one, record_type="OPENDART_COMPANY_PROFILE", natural_key=pick("corp_code"), country_code="KR", country_code_scheme=ALPHA2, classification_code="COMPANY_PROFILE", classification_version="OpenDART", data_version=F.col("source_version"), dimensions={"corpCode": pick("corp_code"), "corpName": pick("corp_name"), "corpNameEng": pick("corp_name_eng"), "stockCode": pick("stock_code"), "ceoName": pick("ceo_nm"), "industryCode": pick("induty_code")}, value=F.col("body"), source_record=F.col("body"))
    return a.unionByName(b)


def un_comtrade(pages: DataFrame) -> DataFrame:
    rows = _json_rows(pages, "$.data")
    start = fn.flexible_date(pick("period"))
    return records(
        rows, record_type="TRADE_FLOW", natural_key=whole_key(pick("reporterCode"), pick("partnerCode"), pick("period"), pick("flowCode"), pick("cmdCode")), country_code=pick("reporterCode"), country_code_scheme=M49, classification_code=pick("cmdCode"), classification_version=pick("classificationCode", "clCode"),
        currency_code="USD", unit_code=pick("qtyUnitAbbr", "qtyUnitCode"), period_start=start, period_end=year_end(start), data_version=pick("isReported", "isAggregate"),
        dimensions={"reporterName": pick("reporterDesc", "reporterISO"), "reporterIso": pick("reporterISO"), "partnerCode": pick("partnerCode"), "partnerName": pick("partnerDesc", "partnerISO"), "partnerIso": pick("partnerISO"), "flowCode": pick("flowCode"), "customsCode": pick("customsCode"), "motCode": pick("motCode")},
        value=value_of("primaryValue", "netWgt", "qty"), source_record=F.col("row"),
    )


def world_bank(pages: DataFrame) -> DataFrame:
    """The second element of a page holds the rows; those without a value are left out."""
    rows = _json_rows(pages, "$[1]").where(F.col("raw")["value"].isNotNull())
    start, indicator = fn.flexible_date(pick("date")), F.get_json_object(F.col("raw")["indicator"], "$.id")
    return records(rows, record_type="MACRO_INDICATOR", natural_key=key(pick("countryiso3code"), indicator, pick("date")), country_code=pick("countryiso3code"), country_code_scheme=ALPHA3, classification_code=indicator, classification_version="World-Bank-v2", unit_code=pick("unit"), period_start=start, period_end=year_end(start), data_version=pick("lastupdated"), dimensions={"countryName": F.get_json_object(F.col("raw")["country"], "$.value"), "decimal": pick("decimal")}, value=value_of("value"), source_record=F.col("row"))


def usgs(pages: DataFrame) -> DataFrame:
    p = payloads.json_pages(pages).withColumn("version", F.coalesce(F.get_json_object("body", "$.metadata.api"), F.lit("1")))
    rows = p.select("page_number", "version", F.explode(F.from_json(F.get_json_object("body", "$.features"), "array<struct<id:string,properties:map<string,string>,geometry:struct<coordinates:array<string>>>>")).alias("f")).withColumn("raw", F.col("f.properties"))
    when, at = fn.flexible_instant(F.col("raw")["time"]), lambda i: F.get(F.col("f.geometry.coordinates"), i)
    return records(rows, record_type="EARTHQUAKE", natural_key=F.col("f.id"), unit_code="Mw", period_start=F.to_date(when), observed_at=when, data_version=F.col("version"), dimensions={"network": pick("net"), "place": pick("place"), "longitude": at(0), "latitude": at(1), "depthKm": at(2), "eventType": pick("type")}, value=value_of("mag"), source_record=F.to_json("f"))


def unlocode(pages: DataFrame) -> DataFrame:
    rows = payloads.raw_rows(pages, "zip").where(pick("Country", "country").isNotNull() & pick("Location", "location").isNotNull())
    place = F.concat(pick("Country", "country"), pick("Location", "location"))
    return records(rows, record_type="LOCATION_CODE", natural_key=place, country_code=pick("Country", "country"), country_code_scheme=ALPHA2, classification_code=place, classification_version="UNLOCODE", period_start=fn.flexible_date(pick("Date", "date")), data_version=F.col("source_version"), dimensions={"name": pick("Name", "name"), "subdivision": pick("Subdivision", "SubDiv"), "function": pick("Function"), "status": pick("Status"), "coordinates": pick("Coordinates")}, value=F.col("row"), source_record=F.col("row"))


def wpi(pages: DataFrame) -> DataFrame:
    index, cc = pick("World Port Index Number", "INDEX_NO", "WPI Number", "PORT_INDEX_NO"), pick("Country Code", "COUNTRY_CODE", "ISO_COUNTRY")
    rows = payloads.raw_rows(pages, "csv").where(index.isNotNull())
    return records(rows, record_type="PORT", natural_key=index, country_code=cc, country_code_scheme=F.when(cc.isNotNull(), ALPHA2), classification_code=index, classification_version="WPI", data_version=F.col("source_version"), dimensions={"name": pick("Main Port Name", "PORT_NAME"), "region": pick("Region Name", "REGION_NAME"), "latitude": pick("Latitude", "LATITUDE"), "longitude": pick("Longitude", "LONGITUDE")}, value=F.col("row"), source_record=F.col("row"))


def hs(pages: DataFrame, version: str = "HS2022") -> DataFrame:
    """The rows are the page, or stand under its results."""
    rows = _json_rows(pages, None).unionByName(_json_rows(pages.where(~F.col("content").cast("string").rlike(r"^\s*\[")), "$.results"))
    code = pick("id", "code", "cmdCode")
    return records(rows.where(code.isNotNull()), record_type="HS_CLASSIFICATION", natural_key=key(version, code), classification_code=code, classification_version=version, data_version=version, dimensions={"description": pick("text", "description"), "parent": pick("parent")}, value=F.col("row"), source_record=F.col("row"))


def isic(pages: DataFrame, version: str = "ISIC4") -> DataFrame:
    code = pick("Code", "code", "ISIC4code", "ISIC Rev. 4 code")
    rows = payloads.raw_rows(pages, "csv").where(code.isNotNull())
    return records(rows, record_type="ISIC_CLASSIFICATION", natural_key=key(version, code), classification_code=code, classification_version=version, data_version=version, dimensions={"description": pick("Description", "description", "Title"), "level": pick("Level", "level")}, value=F.col("row"), source_record=F.col("row"))


def un_wpp(pages: DataFrame) -> DataFrame:
    loc, iso3, year = pick("Location code", "LocID", "SDMX_code"), pick("ISO3_code"), pick("Year", "Time")
    rows = payloads.raw_rows(pages, "csv").where(loc.isNotNull() & year.isNotNull())
    indicator, start = F.coalesce(pick("Indicator", "VarID"), F.lit("POP_TOTAL")), fn.flexible_date(year)
    country = F.coalesce(iso3, F.when(loc.rlike(r"^\d{3}$"), loc))
    return records(rows, record_type="POPULATION_TARGET", natural_key=key(loc, year, pick("Sex"), pick("Age"), indicator), country_code=country, country_code_scheme=F.when(iso3.isNotNull(), ALPHA3).when(country.isNotNull(), M49), classification_code=indicator, classification_version="WPP2024", unit_code=F.coalesce(pick("Unit"), F.lit("thousands")), period_start=start, period_end=year_end(start), data_version=F.col("source_version"), dimensions={"locationId": loc, "location": pick("Location"), "iso2": pick("ISO2_code"), "sex": pick("Sex"), "age": pick("Age"), "variant": pick("Variant")}, value=value_of("Value", "PopTotal", "TPopulation1July", "MidPeriodPop"), source_record=F.col("row"))


def ilostat(pages: DataFrame) -> DataFrame:
    area, indicator, time = pick("ref_area"), pick("indicator"), pick("time")
    rows = payloads.raw_rows(pages, "csv").where(area.isNotNull() & indicator.isNotNull() & time.isNotNull())
    country = F.when(area.rlike("^[A-Z]{3}$"), area)
    return records(rows, record_type="LABOR_INDICATOR", natural_key=key(area, indicator, time, pick("sex"), pick("classif1"), pick("classif2")), country_code=country, country_code_scheme=F.when(country.isNotNull(), ALPHA3), classification_code=indicator, classification_version=pick("source"), unit_code=pick("unit_measure"), period_start=fn.flexible_date(F.regexp_replace(time, "[^0-9].*", "")), data_version=pick("last_status"), dimensions={"refArea": area, "frequency": pick("freq"), "sex": pick("sex"), "classif1": pick("classif1"), "classif2": pick("classif2"), "obsStatus": pick("obs_status")}, value=value_of("obs_value"), source_record=F.col("row"))


def kosis(pages: DataFrame) -> DataFrame:
    """A page that is an error envelope fails the read."""
    body = payloads.json_pages(pages)
    bad = F.get_json_object("body", "$.err").isNotNull()
    checked = body.withColumn("body", F.when(bad, F.raise_error(F.concat(F.lit("KOSIS error: "), F.coalesce(F.get_json_object("body", "$.errMsg"), F.lit("")))).cast("string")).otherwise(F.col("body")))
    rows = checked.withColumn("raw", F.explode(F.from_json("body", "array<map<string,string>>"))).withColumn("row", F.to_json("raw"))
    return records(rows, record_type="KOREAN_STATISTIC", natural_key=key(pick("TBL_ID"), pick("PRD_DE"), pick("ITM_ID"), pick("C1"), pick("C2"), pick("C3")), country_code="KR", country_code_scheme=ALPHA2, classification_code=pick("ITM_ID"), classification_version=pick("TBL_ID"), unit_code=pick("UNIT_NM_ENG", "UNIT_NM"), period_start=fn.flexible_date(pick("PRD_DE")), data_version=pick("LST_CHN_DE"), dimensions={"tableName": pick("TBL_NM"), "itemName": pick("ITM_NM"), "periodicity": pick("PRD_SE"), "c1": pick("C1"), "c1Name": pick("C1_NM"), "c2": pick("C2"), "c2Name": pick("C2_NM")}, value=value_of("DT"), source_record=F.col("row"))


def oecd(pages: DataFrame) -> DataFrame:
    area, period, measure, unit = pick("REF_AREA", "Reference area"), pick("TIME_PERIOD", "Time period"), pick("MEASURE", "Measure"), pick("UNIT_MEASURE", "Unit of measure")
    rows = payloads.raw_rows(pages, "csv").where(period.isNotNull())
    country = F.when(area.rlike("^[A-Z]{3}$"), area)
    return records(rows, record_type="OECD_STATISTIC", natural_key=key(area, measure, period, pick("FREQ"), pick("ACTIVITY"), pick("SEX")), country_code=country, country_code_scheme=F.when(country.isNotNull(), ALPHA3), classification_code=measure, classification_version=pick("DATAFLOW"), currency_code=pick("CURRENCY"), unit_code=unit, period_start=fn.flexible_date(F.regexp_replace(period, "-.*$", "")), data_version=pick("VERSION", "LAST_UPDATED"), dimensions={"refArea": area, "frequency": pick("FREQ"), "subject": pick("SUBJECT"), "activity": pick("ACTIVITY"), "sex": pick("SEX"), "priceBase": pick("PRICE_BASE")}, value=value_of("OBS_VALUE", "Observation value"), source_record=F.col("row"))


ADAPTERS = {"SEC": sec, "OPENDART": opendart, "UN_COMTRADE": un_comtrade, "WORLD_BANK": world_bank, "USGS": usgs, "UNLOCODE": unlocode, "WPI": wpi, "HS": hs, "ISIC": isic, "UN_WPP": un_wpp, "ILOSTAT": ilostat, "KOSIS": kosis, "OECD": oecd}


def ingest(source: str, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A source's pages as ``(accepted, rejected)``: canonical records with their fingerprint, each once, and those with faults."""
    from ..operators.ingest import errors, fingerprint

    r = ADAPTERS[source](pages).withColumn("source_system", F.lit(source)).withColumn("errors", errors())
    dims = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("dimensions"))))
    good = r.where(F.size("errors") == 0).drop("errors").withColumn("fingerprint", fingerprint("source_system", "natural_key", "data_version", "period_start", dims, "value"))
    return good.dropDuplicates(["fingerprint"]), r.where(F.size("errors") > 0)
