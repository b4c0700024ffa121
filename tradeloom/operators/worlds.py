"""Entities of the mapping rules, and queries of whole world versions built from records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..plans.registry import query
from ..plans.tables import table
from . import baseline
from .baseline import STATISTICS, dim
from .retrieval import chunks

RECORD = "record_id source_system record_type natural_key classification_code classification_version unit_code value country_code country_code_scheme period_start period_end created_at data_version dimensions".split()


def entities(records: DataFrame) -> DataFrame:
    """``natural_key``, ``entity_type``, ``name``, ``attributes`` (a map), ``record_id`` of what records name: companies, countries, indicators, industries, products, ports, transport modes and crises. Of several
    records that name an entity the first, by ``created_at`` and then by id, says its name and attributes: a minimum of structs, which combines before the shuffle."""
    system, kind, code = F.col("source_system"), F.col("record_type"), F.col("classification_code")
    named = F.coalesce(code, kind)

    def rule(when: Column, entity_type: str, key: Column, name: Column, **attributes: Column) -> Column:
        held = F.map_filter(F.create_map(*(x for n, v in attributes.items() for x in (F.lit(n), v.cast("string")))), lambda _, v: v.isNotNull()) if attributes else F.create_map().cast("map<string,string>")
        listed = F.array_sort(F.map_entries(held))
        return F.when(when & key.isNotNull() & name.isNotNull(), F.struct(F.lit(entity_type).alias("entity_type"), key.alias("natural_key"), name.alias("name"), listed.alias("attributes")))

    tag = lambda prefix, *c: F.concat(F.lit(f"{prefix}:"), *c)
    value = F.col("value").try_cast("double")
    sic = F.when(system == "SEC", tag("SIC", dim("sic"))).when(system == "OPENDART", tag("DART", dim("industryCode")))
    unit = F.coalesce("unit_code", F.lit("UNSPECIFIED"))
    trade = system == "UN_COMTRADE"
    good = F.when((system == "HS") | (trade & (F.upper(code) != "TOTAL")), F.nullif(F.trim(code), F.lit("")))
    port = (system == "WPI") | ((system == "UNLOCODE") & F.contains(dim("function"), F.lit("1")))
    mode = F.when(trade & (dim("motCode") != "0"), dim("motCode"))
    scheme, place = F.nullif(F.trim("country_code_scheme"), F.lit("")), F.nullif(F.trim("country_code"), F.lit(""))
    rules = [
        rule(system == "SEC", "COMPANY", tag("company:CIK", dim("cik")), F.coalesce(dim("entityName"), dim("companyName")), jurisdiction=F.lit("US")),
        rule(system == "OPENDART", "COMPANY", tag("company:DART_CORP_CODE", dim("corpCode")), dim("corpName"), jurisdiction=F.lit("KR")),
        rule(F.lit(True), "COUNTRY", tag("country", scheme, F.lit(":"), place), F.coalesce(dim("countryName"), place), countryCode=place, codeScheme=scheme),
        rule(system.isin(STATISTICS) & value.isNotNull(), "STATISTICAL_INDICATOR", tag("indicator", F.sha2(F.concat_ws(":", system, "natural_key"), 256)), F.concat_ws(" ", system, named), metricCode=named, sourceSystem=system, unit=unit, value=F.col("value"), period=F.col("period_start")),
        rule(sic.isNotNull(), "INDUSTRY", tag("industry", system, F.lit(":"), sic), F.coalesce(dim("sicDescription"), dim("description"), sic), classificationCode=sic),
        rule(good.isNotNull(), "PRODUCT", tag("product:HS", good), F.coalesce(dim("description"), good), classificationCode=good),
        rule(port, "PORT", tag("port", system, F.lit(":"), code), F.coalesce(dim("name"), code), unLocode=F.when(system == "UNLOCODE", code).otherwise(tag("WPI", code)), latitude=dim("latitude").try_cast("double"), longitude=dim("longitude").try_cast("double")),
        rule(mode.isNotNull(), "TRANSPORT_MODE", tag("transport-mode", mode), F.concat(F.lit("Transport mode "), mode), modeCode=mode),
        rule(kind == "EARTHQUAKE", "CRISIS_EVENT", tag("crisis", "natural_key"), F.coalesce(dim("place"), F.col("natural_key")), magnitude=dim("magnitude").try_cast("double")),
    ]
    each = records.select("created_at", "record_id", F.explode(F.array_compact(F.array(*rules))).alias("e"))
    first = each.groupBy("e.natural_key", "e.entity_type").agg(F.min(F.struct("created_at", "record_id", F.col("e.name").alias("name"), F.col("e.attributes").alias("attributes"))).alias("f"))
    return first.select("natural_key", "entity_type", "f.name", F.map_from_entries("f.attributes").alias("attributes"), "f.record_id")


def _record(df: DataFrame, **given: Column | str) -> DataFrame:
    """Canonical records from a table: what is not given is null, ``dimensions`` empty."""
    kinds = {"value": "string", "period_start": "date", "period_end": "date", "created_at": "timestamp", "dimensions": "map<string,string>"}
    return df.select(*((given[c] if isinstance(given.get(c), Column) else F.lit(given.get(c)) if c in given else F.create_map() if c == "dimensions" else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in RECORD))


def _dims(**given: Column) -> Column:
    return F.map_filter(F.create_map(*(x for k, v in given.items() for x in (F.lit(k), v.cast("string")))), lambda _, v: v.isNotNull())


def _named_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, p, o, s, n = (table(spark, sf_dir, t) for t in ("customer", "part", "orders", "supplier", "nation"))
    k, q, m, u, e = F.col("c_custkey"), F.col("p_partkey"), F.col("o_orderkey"), F.col("s_suppkey"), F.col("n_nationkey")
    at = lambda key, day: F.expr("timestamp '2024-01-01'") + F.make_interval(days=(key % day).cast("int"))
    key = lambda prefix, c: F.concat(F.lit(prefix), F.lpad(c.cast("string"), 10, "0"))
    out = _record(c, record_id=key("a", k), source_system="WORLD_BANK", record_type="MACRO", natural_key=F.concat(F.lit("w"), k % 100), classification_code=F.when(k % 7 != 0, F.col("c_mktsegment")), unit_code=F.when(k % 5 != 0, "USD"), value=k, country_code=F.col("c_nationkey"), country_code_scheme="X", created_at=at(k, 3))
    out = out.unionByName(_record(p, record_id=key("b", q), source_system="HS", record_type="HS", natural_key=q, classification_code=q % 50, created_at=at(q, 5), dimensions=_dims(description=F.when(q % 4 != 0, F.col("p_name")))))
    out = out.unionByName(_record(o, record_id=key("c", m), source_system="UN_COMTRADE", record_type="TRADE_FLOW", natural_key=m, classification_code=F.when(m % 9 == 0, "TOTAL").otherwise((m % 60).cast("string")), created_at=at(m, 7), dimensions=_dims(motCode=m % 4)))
    out = out.unionByName(_record(s, record_id=key("d", u), source_system="SEC", record_type="SEC_FILING", natural_key=u, created_at=at(u, 2), dimensions=_dims(cik=u % 40, entityName=F.when(u % 3 != 0, F.col("s_name")), companyName=F.lit("other"), sic=F.col("s_nationkey"), sicDescription=F.when(u % 2 == 0, F.concat(F.lit("d"), u)))))
    out = out.unionByName(_record(s, record_id=key("e", u), source_system="UNLOCODE", record_type="LOCATION", natural_key=u, classification_code=F.concat(F.lit("L"), u % 20), created_at=at(u, 3), dimensions=_dims(function=F.when(u % 2 == 0, "1---").otherwise("-2--"), name=F.col("s_name"), latitude=u % 90)))
    return out.unionByName(_record(n, record_id=key("f", e), source_system="USGS", record_type="EARTHQUAKE", natural_key=e, created_at=at(e, 3), dimensions=_dims(place=F.when(e % 2 == 0, F.col("n_name")), magnitude=F.lit("5.5"))))


_PAD = "'{0}' || lpad(CAST({1} AS VARCHAR), 10, '0')"


@query(f"""WITH e AS (
  SELECT 'COUNTRY' AS t, 'country:X:' || c_nationkey AS k, CAST(c_nationkey AS VARCHAR) AS name, 'codeScheme=X;countryCode=' || c_nationkey AS a, c_custkey % 3 AS d, {_PAD.format('a', 'c_custkey')} AS r FROM customer
  UNION ALL SELECT 'STATISTICAL_INDICATOR', 'indicator:' || sha256('WORLD_BANK:w' || c_custkey % 100), 'WORLD_BANK ' || CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment ELSE 'MACRO' END,
    'metricCode=' || CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment ELSE 'MACRO' END || ';sourceSystem=WORLD_BANK;unit=' || CASE WHEN c_custkey % 5 <> 0 THEN 'USD' ELSE 'UNSPECIFIED' END || ';value=' || c_custkey, c_custkey % 3, {_PAD.format('a', 'c_custkey')} FROM customer
  UNION ALL SELECT 'PRODUCT', 'product:HS:' || p_partkey % 50, CASE WHEN p_partkey % 4 <> 0 THEN p_name ELSE CAST(p_partkey % 50 AS VARCHAR) END, 'classificationCode=' || p_partkey % 50, p_partkey % 5, {_PAD.format('b', 'p_partkey')} FROM part
  UNION ALL SELECT 'PRODUCT', 'product:HS:' || o_orderkey % 60, CAST(o_orderkey % 60 AS VARCHAR), 'classificationCode=' || o_orderkey % 60, o_orderkey % 7, {_PAD.format('c', 'o_orderkey')} FROM orders WHERE o_orderkey % 9 <> 0
  UNION ALL SELECT 'TRANSPORT_MODE', 'transport-mode:' || o_orderkey % 4, 'Transport mode ' || o_orderkey % 4, 'modeCode=' || o_orderkey % 4, o_orderkey % 7, {_PAD.format('c', 'o_orderkey')} FROM orders WHERE o_orderkey % 4 <> 0
  UNION ALL SELECT 'COMPANY', 'company:CIK:' || s_suppkey % 40, CASE WHEN s_suppkey % 3 <> 0 THEN s_name ELSE 'other' END, 'jurisdiction=US', s_suppkey % 2, {_PAD.format('d', 's_suppkey')} FROM supplier
  UNION ALL SELECT 'INDUSTRY', 'industry:SEC:SIC:' || s_nationkey, CASE WHEN s_suppkey % 2 = 0 THEN 'd' || s_suppkey ELSE 'SIC:' || s_nationkey END, 'classificationCode=SIC:' || s_nationkey, s_suppkey % 2, {_PAD.format('d', 's_suppkey')} FROM supplier
  UNION ALL SELECT 'PORT', 'port:UNLOCODE:L' || s_suppkey % 20, s_name, 'latitude=' || CAST(CAST(s_suppkey % 90 AS DOUBLE) AS VARCHAR) || ';unLocode=L' || s_suppkey % 20, s_suppkey % 3, {_PAD.format('e', 's_suppkey')} FROM supplier WHERE s_suppkey % 2 = 0
  UNION ALL SELECT 'CRISIS_EVENT', 'crisis:' || n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE CAST(n_nationkey AS VARCHAR) END, 'magnitude=5.5', n_nationkey % 3, {_PAD.format('f', 'n_nationkey')} FROM nation),
f AS (SELECT *, row_number() OVER (PARTITION BY t, k ORDER BY d, r) AS n FROM e) SELECT k AS natural_key, t AS entity_type, name, a AS attributes, r AS record_id FROM f WHERE n = 1""")
def semantic_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of all kinds, each as the first record that names it says."""
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return entities(_named_records(spark, sf_dir)).withColumn("attributes", shown)


def _world_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trade records, of which some are newer versions of others, in two periods; customers as statistics of their countries."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    m, k = F.col("o_orderkey"), F.col("c_custkey")
    day = lambda key: F.expr("timestamp '2024-01-01'") + F.make_interval(days=(key % 5).cast("int"))
    year = lambda when: F.when(when, F.lit("2023-01-01")).otherwise("2022-01-01").cast("date")
    flows = _record(
        o, record_id=F.concat(F.lit("t"), F.lpad(m.cast("string"), 10, "0")), source_system="UN_COMTRADE", record_type="TRADE_FLOW", natural_key=F.floor(m / 2), value=F.col("o_totalprice").cast("long"), country_code=F.col("o_custkey") % 25, country_code_scheme="UN-M49",
        period_start=year(m % 3 != 0), created_at=day(m), data_version="1", dimensions=_dims(partnerCode=m % 24, flowCode=F.when(m % 2 == 0, "M").otherwise("x")),
    )
    stats = _record(
        c, record_id=F.concat(F.lit("s"), F.lpad(k.cast("string"), 10, "0")), source_system="WORLD_BANK", record_type="MACRO", natural_key=k, classification_code=F.col("c_mktsegment"), value=F.when(k % 6 == 0, -1).otherwise(k), country_code=F.col("c_nationkey"), country_code_scheme="UN-M49",
        period_end=year(k % 2 == 0), created_at=day(k), data_version="2",
    )
    return flows.unionByName(stats).withColumn("run_id", F.lit("r"))


_WORLD = """WITH t AS (SELECT 't' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS id, o_orderkey // 2 AS nk, CAST(trunc(o_totalprice) AS BIGINT) AS v, 'country:UN-M49:' || o_custkey % 25 AS a, 'country:UN-M49:' || o_orderkey % 24 AS b, o_orderkey % 2 = 0 AS imports, o_orderkey % 3 <> 0 AS newer, o_orderkey % 5 AS d FROM orders),
ts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nk ORDER BY d DESC, id DESC) AS n FROM t) WHERE n = 1),
f AS (SELECT id, v, CASE WHEN imports THEN b ELSE a END AS src, CASE WHEN imports THEN a ELSE b END AS dst FROM ts WHERE newer OR NOT EXISTS (SELECT 1 FROM ts WHERE newer)),
p AS (SELECT src, dst, sum(v) AS flow, count(*) AS n FROM f GROUP BY src, dst), d AS (SELECT dst, sum(flow) AS total FROM p GROUP BY dst),
o AS (SELECT 's' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS id, 'country:UN-M49:' || c_nationkey AS entity, 'WORLD_BANK_' || regexp_replace(upper(c_mktsegment), '[^A-Z0-9]+', '_', 'g') AS metric, c_custkey AS v, c_custkey % 2 = 0 AS newer FROM customer WHERE c_custkey % 6 <> 0),
ob AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, metric ORDER BY newer DESC, id) AS n FROM o) WHERE n = 1)"""


@query(_WORLD + """ SELECT src AS entity, 'SUPPLY' AS metric, CAST(sum(flow) AS DOUBLE) AS value, 'aggregate' AS origin FROM p GROUP BY src UNION ALL SELECT dst, 'DEMAND', CAST(sum(flow) AS DOUBLE), 'aggregate' FROM p GROUP BY dst UNION ALL SELECT entity, metric, CAST(v AS DOUBLE), id FROM ob""")
def baseline_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node's metrics with where each value is from: the observation, or a sum of flows."""
    nodes = baseline.build(_world_records(spark, sf_dir))["nodes"]
    return nodes.select("entity", "origins", F.explode("metrics").alias("metric", "value")).select("entity", "metric", F.col("value").cast("double").alias("value"), F.col("origins")[F.col("metric")].alias("origin"))


@query(_WORLD + " SELECT f.id AS record_id, f.src AS src, f.dst AS dst, CAST(f.v AS DOUBLE) AS value, round(p.flow / CAST(total AS DOUBLE), 9) AS ratio, p.n AS records FROM f JOIN p ON f.src = p.src AND f.dst = p.dst JOIN d ON d.dst = p.dst WHERE f.src <> f.dst AND total > 0")
def baseline_edge_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record that contributes to an edge, with the edge's ratio and its number of records."""
    built = baseline.build(_world_records(spark, sf_dir))
    edges = built["edges"].select("src", "dst", F.round("ratio", 9).alias("ratio"), "records")
    return built["edge_records"].join(edges, ["src", "dst"]).select("record_id", "src", "dst", F.col("value").cast("double").alias("value"), "ratio", "records")


@query("""WITH o AS (SELECT o_custkey, string_agg('order ' || o_orderkey || chr(10), '' ORDER BY o_orderkey) AS b, 'order ' || max(o_orderkey) || chr(10) AS last FROM orders GROUP BY o_custkey),
t AS (SELECT c_custkey AS id, c_mktsegment AS s1, '# ' || c_mktsegment || chr(10) AS h1, 'About ' || c_name || chr(10) AS b1, '## Orders ##' || chr(10) AS h2, coalesce(b, '') AS b2, '#### Last' || chr(10) AS h3, coalesce(last, '') AS b3, '# Nation ' || c_nationkey AS h4, chr(10) || '#hash ' || c_custkey AS b4, c_nationkey AS n FROM customer LEFT JOIN o ON o_custkey = c_custkey),
p AS (SELECT id, 1 AS i, s1 AS section, length(h1) AS start, b1 AS body FROM t UNION ALL SELECT id, 2, s1 || '/Orders', length(h1 || b1 || h2), b2 FROM t UNION ALL SELECT id, 3, s1 || '/Orders/Last', length(h1 || b1 || h2 || b2 || h3), b3 FROM t
  UNION ALL SELECT id, 4, 'Nation ' || n, length(h1 || b1 || h2 || b2 || h3 || b3 || h4) + 1, substr(b4, 2) FROM t)
SELECT CAST(id AS VARCHAR) AS id, CAST(row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS INTEGER) AS ordinal, section, CAST(start AS INTEGER) AS begins, CAST(start + length(regexp_replace(body, '\\s+$', '')) AS INTEGER) AS ends, regexp_replace(body, '\\s+$', '') AS content FROM p WHERE body <> ''""")
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a Markdown page: its chunks with the headings above them."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    lines = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))  # a customer's orders
    line = lambda k: F.concat(F.lit("order "), k, F.lit("\n"))
    listed, last = F.coalesce(F.array_join(F.transform("keys", line), ""), F.lit("")), F.coalesce(line(F.array_max("keys")), F.lit(""))
    text = F.concat(F.lit("# "), "c_mktsegment", F.lit("\nAbout "), "c_name", F.lit("\n## Orders ##\n"), listed, F.lit("#### Last\n"), last, F.lit("# Nation "), "c_nationkey", F.lit("\n#hash "), "c_custkey")
    pages = c.join(lines, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", text.alias("text"))
    return chunks(pages, "c_custkey").select(F.col("c_custkey").alias("id"), "ordinal", F.array_join("section", "/").alias("section"), "begins", "ends", "content")


@query("SELECT s_suppkey, s_name, CAST(row_number() OVER (ORDER BY s_name, s_suppkey) AS BIGINT) AS place FROM supplier")
def catalogue_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalogue in the order of its names, with places."""
    from ..plans.numbering import numbered

    return numbered(table(spark, sf_dir, "supplier", "s_suppkey", "s_name"), ["s_name", "s_suppkey"]).orderBy("place")
