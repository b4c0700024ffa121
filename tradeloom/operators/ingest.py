"""Validation, fingerprints, insert-if-absent and quarantine of normalised records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as fn
from ..plans.registry import query
from ..plans.tables import table
from .world import slug

# What a country code must look like under each scheme.
COUNTRY_PATTERNS = {"ISO-3166-1-alpha-2": "^[A-Z]{2}$", "ISO-3166-1-alpha-3": "^[A-Z]{3}$", "UN-M49": r"^\d{3}$"}


def errors(present: set[str] | None = None) -> Column:
    """All faults of a canonical record, in the order of the rules; an empty array if there are none. ``present``: its columns, if some are missing."""
    has = lambda c: present is None or c in present
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    rules = [F.when(blank("record_type"), "recordType is required"), F.when(blank("natural_key"), "naturalKey is required"), F.when(F.length("record_type") > 80, "recordType exceeds 80 characters"), F.when(F.length("natural_key") > 512, "naturalKey exceeds 512 characters"), F.when(F.col("value").isNull(), "value is required")]
    if has("dimensions"):
        rules.append(F.when(F.col("dimensions").isNull(), "dimensions must be an object"))
    if has("period_end"):
        rules.append(F.when(F.col("period_end").isNotNull() & (F.col("period_start").isNull() | (F.col("period_end") < F.col("period_start"))), "invalid period"))
    if has("country_code"):
        fits = F.lit(False)
        for scheme, pattern in COUNTRY_PATTERNS.items():
            fits = F.when(F.col("country_code_scheme") == scheme, F.col("country_code").rlike(pattern)).otherwise(fits)
        rules.append(F.when(F.col("country_code").isNotNull() & ~fits, "country code does not match scheme"))
    if has("currency_code"):
        rules.append(F.when(~F.col("currency_code").rlike("^[A-Z]{3}$"), "currency must be ISO-4217 alpha-3"))
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def fingerprint(*columns) -> Column:
    """SHA-256 of the columns as text between bars, null written out."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c, F.lit("null")) for c in columns)), 256)


def _one_of_each(df: DataFrame, keys: list[str], order: list[str], last: bool) -> DataFrame:
    """One row of each key: the first, or the last, by ``order`` and then by the other columns; an aggregation, which combines on the map side."""
    rest = [c for c in [*order, *(c for c in df.columns if c not in order)] if c not in keys]
    row = F.struct(*rest) if rest else F.struct(F.lit(1).alias("_"))
    best = df.groupBy(*keys).agg((F.max if last else F.min)(row).alias("_row"))
    return best.select(*(F.col(f"_row.{c}").alias(c) if c in rest else F.col(c) for c in df.columns))


def insert_absent(new: DataFrame, existing: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """What of ``new`` ``existing`` does not have, each key once, its first row by ``order``: the rows to append."""
    return _one_of_each(new, keys, order or [], False).join(existing.select(*keys), keys, "left_anti").select(*new.columns)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those of equal keys; of a key that repeats in ``new`` the last row by ``order`` counts."""
    last = _one_of_each(new, keys, order or [], True)
    return existing.join(last.select(*keys), keys, "left_anti").select(*existing.columns).unionByName(last)


def next_version(versions: DataFrame, world: str) -> DataFrame:
    """The number after a world's last version; 1 for a new world."""
    return versions.where(F.col("world_id") == world).agg((F.coalesce(F.max("version_number"), F.lit(0)) + 1).alias("version_number"))


def replace_partition(df: DataFrame, path: str, partition: str) -> None:
    """Write ``df`` over the partitions that it holds; the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def drop_expired(df: DataFrame, now: str, column: str = "expires_at") -> DataFrame:
    """The rows that have not expired at ``now``, or never do."""
    return df.where(F.col(column).isNull() | (F.col(column) > F.to_timestamp(F.lit(now))))


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as records, some of which break rules."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    code = F.when(k % 3 == 0, F.upper(F.substring("n_name", 1, 2))).when(k % 3 == 1, F.upper(F.substring("n_name", 1, 3))).otherwise(F.lpad(F.col("n_nationkey").cast("string"), 3, "0"))
    scheme = F.when(k % 7 == 0, "ISO-3166-1-alpha-3").when(k % 3 == 0, "ISO-3166-1-alpha-2").when(k % 3 == 1, "ISO-3166-1-alpha-3").otherwise("UN-M49")
    start = F.lit("2024-01-10").cast("date")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        k.alias("id"), F.lit("CUSTOMER").alias("record_type"), F.when(k % 11 != 0, F.col("c_name")).alias("natural_key"), F.when(k % 13 != 0, F.col("c_acctbal")).alias("value"), code.alias("country_code"), scheme.alias("country_code_scheme"),
        F.when(k % 17 == 0, "usd").otherwise("USD").alias("currency_code"), start.alias("period_start"), F.when(k % 19 == 0, F.date_sub(start, 1)).otherwise(start).alias("period_end"),
    )


_CUSTOMERS = """WITH r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 11 <> 0 THEN c_name END AS natural_key, CASE WHEN c_custkey % 13 <> 0 THEN c_acctbal END AS value,
  CASE WHEN c_custkey % 3 = 0 THEN upper(substr(n_name, 1, 2)) WHEN c_custkey % 3 = 1 THEN upper(substr(n_name, 1, 3)) ELSE lpad(CAST(n_nationkey AS VARCHAR), 3, '0') END AS code,
  CASE WHEN c_custkey % 7 = 0 THEN 'ISO-3166-1-alpha-3' WHEN c_custkey % 3 = 0 THEN 'ISO-3166-1-alpha-2' WHEN c_custkey % 3 = 1 THEN 'ISO-3166-1-alpha-3' ELSE 'UN-M49' END AS scheme
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
e AS (SELECT id, concat_ws('; ', CASE WHEN natural_key IS NULL THEN 'naturalKey is required' END, CASE WHEN value IS NULL THEN 'value is required' END, CASE WHEN id % 19 = 0 THEN 'invalid period' END,
  CASE WHEN NOT regexp_matches(code, CASE scheme WHEN 'ISO-3166-1-alpha-2' THEN '^[A-Z]{2}$' WHEN 'ISO-3166-1-alpha-3' THEN '^[A-Z]{3}$' ELSE '^[0-9]{3}$' END) THEN 'country code does not match scheme' END,
  CASE WHEN id % 17 = 0 THEN 'currency must be ISO-4217 alpha-3' END) AS errors FROM r)"""


@query(_CUSTOMERS + " SELECT id, errors FROM e")
def validate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with all its faults."""
    r = _customers(spark, sf_dir)
    return r.select("id", F.array_join(errors(set(r.columns)), "; ").alias("errors"))


@query(_CUSTOMERS + " SELECT id, 'page[' || CAST(id // 1000 AS VARCHAR) || '].record[' || CAST(ord AS VARCHAR) || ']' AS locator, errors AS message FROM (SELECT *, row_number() OVER (PARTITION BY id // 1000 ORDER BY id) - 1 AS ord FROM e) WHERE errors <> ''")
def reject_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invalid records with their place: the page, and the position in it. Pages are bounded, so are the windows."""
    r = _customers(spark, sf_dir)
    page = F.expr("id div 1000")
    placed = r.select("id", F.array_join(errors(set(r.columns)), "; ").alias("message"), page.alias("page")).withColumn("ord", F.row_number().over(Window.partitionBy("page").orderBy("id")) - 1)
    return placed.where("message <> ''").select("id", F.format_string("page[%d].record[%d]", "page", "ord").alias("locator"), "message")


@query("""WITH f AS (SELECT event_id, event_type, sha256(concat_ws('|', event_type, CAST(user_id AS VARCHAR), coalesce(props, 'null'))) AS fingerprint FROM events)
SELECT fingerprint, min(event_id) AS first_id, count(*) AS copies FROM f GROUP BY fingerprint""")
def record_fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by fingerprint: the first is inserted, the others are skipped."""
    e = table(spark, sf_dir, "events", "event_id", "event_type", "user_id", "props")
    return e.groupBy(fingerprint("event_type", "user_id", "props").alias("fingerprint")).agg(F.min("event_id").alias("first_id"), F.count("*").alias("copies"))


@query("""WITH f AS (SELECT event_type, event_id // 1000 AS page, sha256(concat_ws('|', event_type, CAST(user_id AS VARCHAR), coalesce(props, 'null'))) AS fingerprint, value FROM events)
SELECT event_type AS run, count(DISTINCT page) AS pages, count(*) AS raw, count(DISTINCT fingerprint) AS normalized, count(*) FILTER (value IS NULL OR value < 1) AS rejected FROM f GROUP BY event_type""")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, raw, distinct normalised and rejected records of each run. Distinct values are counted through sub-aggregations, so a hot run is split."""
    e = table(spark, sf_dir, "events", "event_id", "event_type", "user_id", "props", "value").select(F.col("event_type").alias("run"), F.expr("event_id div 1000").alias("page"), fingerprint("event_type", "user_id", "props").alias("f"), (F.col("value").isNull() | (F.col("value") < 1)).alias("bad"))
    prints = e.groupBy("run", "f").agg(F.count("*").alias("raw"), F.count_if("bad").alias("rejected")).groupBy("run").agg(F.sum("raw").alias("raw"), F.count("*").alias("normalized"), F.sum("rejected").alias("rejected"))
    pages = e.select("run", "page").distinct().groupBy("run").agg(F.count("*").alias("pages"))
    return prints.join(pages, "run").select("run", "pages", "raw", "normalized", "rejected")


@query("SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value IS NOT NULL AND isfinite(value) AND value >= 0 AS usable FROM events")
def event_props_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values out of JSON dimensions, and the finite, non-negative ones marked."""
    v = F.col("value")
    usable = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")) & (v >= 0)
    return table(spark, sf_dir, "events", "event_id", "event_type", "props", "value").select("event_id", "event_type", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.coalesce(usable, F.lit(False)).alias("usable"))


@query("SELECT * FROM (SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50)")
def newest_50(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest fifty: a limit that is the feature."""
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50)


@query("SELECT o_custkey AS customer, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS oldest_order, min(o_orderdate) AS oldest FROM orders GROUP BY o_custkey")
def oldest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest evidence of each source."""
    o = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate")
    return o.groupBy(F.col("o_custkey").alias("customer")).agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("oldest_order"), F.min("o_orderdate").alias("oldest"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(date_trunc('year', o_orderdate) AS DATE) WHEN 1 THEN CAST(date_trunc('month', o_orderdate) AS DATE) WHEN 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed FROM orders""")
def multi_format_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written in four ways, and one that is none, read by one expression."""
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    written = F.when(k == 0, F.date_format(d, "yyyy")).when(k == 1, F.date_format(d, "yyyyMM")).when(k == 2, F.date_format(d, "yyyyMMdd")).when(k == 3, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).otherwise("n.d.")
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", fn.flexible_date(written).alias("parsed"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS starts, CAST(CAST(o_orderdate AS DATE) + 1 AS TIMESTAMP) AS ends FROM orders")
def period_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed days as half-open instants."""
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", d.cast("timestamp").alias("starts"), F.date_add(d, 1).cast("timestamp").alias("ends"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(upper(p_type || ' (' || p_brand || ')'), '[^A-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS metric FROM part")
def metric_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as metric codes."""
    return table(spark, sf_dir, "part", "p_partkey", "p_type", "p_brand").select("p_partkey", slug(F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")"))).alias("metric"))


@query(r"SELECT page_id, regexp_replace(split_part(url, '#', 1) || CASE WHEN contains(split_part(url, '#', 1), '?') THEN '&' ELSE '?' END || 'api_key=abc&x=1&Access_Token=t', '(?i)([?&][^=&#]*(?:key|token|secret)[^=&#]*)=[^&#]*', '\1=REDACTED', 'g') AS url FROM pages")
def uri_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request addresses without their credentials."""
    bare = F.split_part("url", F.lit("#"), F.lit(1))
    full = F.concat(bare, F.when(F.contains(bare, F.lit("?")), "&").otherwise("?"), F.lit("api_key=abc&x=1&Access_Token=t"))
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", fn.redacted(full).alias("url"))
