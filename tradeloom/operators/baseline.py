"""A world version out of canonical records: the newest of each key, its flows and metrics as nodes and dependency edges, typed edges, and the manifest.

Records carry ``record_id``, ``run_id``, ``source_system``, ``created_at`` beside the canonical columns (see ``sources.adapters``).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as fn
from ..plans.storage import written
from .joins import within
from .resolve import match_names
from .world import latest_per_key, slug

# Sources of statistics, and what marks a row as a total.
STATISTICS = ["WORLD_BANK", "OECD", "KOSIS", "ILOSTAT", "UN_WPP"]
TOTAL_SEX_LABOR, TOTAL_SEX_POPULATION = ["SEX_T", "TOTAL", "T"], ["BOTH SEXES", "BOTH", "TOTAL"]


def dim(name: str) -> Column:
    return F.col("dimensions")[name]


def amount() -> Column:
    """The value as a finite number that is not negative, else null."""
    v = F.col("value").try_cast("double")
    return F.when(~F.isnan(v) & (v < float("inf")) & (v >= 0), v)


def snapshot(records: DataFrame) -> DataFrame:
    """The newest record of each source and natural key; of equally new ones that of the greatest id."""
    rest = [c for c in records.columns if c not in ("source_system", "natural_key", "dimensions")]
    packed = records.withColumn("dims", F.array_sort(F.map_entries("dimensions")))
    out = latest_per_key(packed, ["source_system", "natural_key"], ["created_at", "record_id"], [*rest, "dims"])
    return out.withColumn("dimensions", F.map_from_entries("dims")).drop("dims")


def is_total() -> Column:
    """Whether a row of labour or population statistics is a total and no breakdown; true for other sources."""
    labor = (dim("sex").isNull() | F.upper(dim("sex")).isin(TOTAL_SEX_LABOR)) & dim("classif1").isNull() & dim("classif2").isNull()
    people = dim("age").isNull() & (dim("sex").isNull() | F.upper(dim("sex")).isin(TOTAL_SEX_POPULATION))
    return F.when(F.col("source_system") == "ILOSTAT", labor).when(F.col("source_system") == "UN_WPP", people).otherwise(True)


def metric() -> Column:
    """What a record measures: its source and code for statistics, taxonomy and concept for company facts; null for other records."""
    named = F.when(F.col("source_system").isin(STATISTICS) & is_total(), F.concat_ws("_", "source_system", F.nullif(slug("classification_code"), F.lit(""))))
    facts = F.when(F.col("record_type") == "SEC_XBRL_FACT", slug(F.concat_ws("_", F.lit("SEC"), F.coalesce("classification_version", F.lit("XBRL")), "classification_code")))
    return F.when(F.col("classification_code").isNotNull(), F.coalesce(named, facts))


def with_country(records: DataFrame, alpha3: DataFrame | None = None) -> DataFrame:
    """Records with ``country`` and ``partner`` as node ids. Trade records say their ISO codes; ``alpha3`` (``alpha2``, ``iso3``) maps two-letter codes."""
    iso = lambda name: F.when(dim(name).rlike("^[A-Z]{3}$"), F.concat(F.lit("country:ISO-3166-1-alpha-3:"), dim(name)))
    own = F.when(F.col("source_system") == "UN_COMTRADE", F.coalesce(iso("reporterIso"), F.concat(F.lit("country:UN-M49:"), "country_code"))).otherwise(F.concat(F.lit("country:"), "country_code_scheme", F.lit(":"), "country_code"))
    other = F.when(F.col("source_system") == "UN_COMTRADE", F.coalesce(iso("partnerIso"), F.concat(F.lit("country:UN-M49:"), dim("partnerCode"))))
    out = records.withColumn("country", own).withColumn("partner", other)
    if alpha3 is None:
        return out
    two = alpha3.select(F.concat(F.lit("country:ISO-3166-1-alpha-2:"), "alpha2").alias("country"), F.concat(F.lit("country:ISO-3166-1-alpha-3:"), "iso3").alias("three"))
    return out.join(two, "country", "left").withColumn("country", F.coalesce("three", "country")).drop("three")


def flows(records: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``value``, ``record_id`` of the newest period's trade records; imports run from the partner. Each record decides its direction by itself."""
    t = records.where(F.col("source_system") == "UN_COMTRADE").withColumn("amount", amount()).where("amount is not null and country is not null and partner is not null")
    newest = t.agg(F.max("period_start").alias("newest"))
    t = t.join(F.broadcast(newest), F.col("newest").isNull() | (F.col("period_start") == F.col("newest")))  # one row
    imports = F.upper(dim("flowCode")) == "M"
    return t.select(F.when(imports, F.col("partner")).otherwise(F.col("country")).alias("src"), F.when(imports, F.col("country")).otherwise(F.col("partner")).alias("dst"), F.col("amount").alias("value"), "record_id")


def observed(records: DataFrame) -> DataFrame:
    """``entity``, ``metric``, ``value``, ``record_id``, ``name``: of each entity's metric the newest observation, without a period oldest, ties to the smallest id. A filer's facts go to the one company profile whose English name is its own or nearly so."""
    r = records.withColumn("metric", metric()).withColumn("amount", amount()).where("metric is not null and amount is not null")
    countries = r.where(F.col("record_type") != "SEC_XBRL_FACT").select(F.col("country").alias("entity"), "metric", "amount", "record_id", "period_start", "period_end", F.coalesce(dim("countryName"), dim("location"), F.col("country_code")).alias("name")).where("entity is not null")
    facts = r.where(F.col("record_type") == "SEC_XBRL_FACT").withColumn("cik", dim("cik")).where("cik is not null")
    filers = facts.groupBy("cik").agg(F.min(dim("entityName")).alias("name")).select(F.col("cik").alias("candidate"), F.lit("COMPANY").alias("entity_type"), "name")
    profiles = records.where("record_type = 'OPENDART_COMPANY_PROFILE'").select(F.concat(F.lit("company:DART_CORP_CODE:"), dim("corpCode")).alias("entity_id"), F.lit("COMPANY").alias("entity_type"), dim("corpNameEng").alias("name")).where("name is not null")
    met = match_names(filers, profiles).select(F.col("candidate").alias("cik"), "entity_id")
    companies = facts.join(met, "cik", "left").select(F.coalesce("entity_id", F.concat(F.lit("company:CIK:"), "cik")).alias("entity"), "metric", "amount", "record_id", "period_start", "period_end", F.coalesce(dim("entityName"), F.col("cik")).alias("name"))
    every = countries.unionByName(companies)
    period = F.coalesce("period_end", "period_start", F.lit("0001-01-01").cast("date"))
    best = every.groupBy("entity", "metric").agg(F.min(F.struct((-F.unix_date(period)).alias("age"), "record_id", "amount", "name")).alias("b"))
    return best.select("entity", "metric", F.col("b.amount").alias("value"), F.col("b.record_id").alias("record_id"), F.col("b.name").alias("name"))


def build(records: DataFrame, alpha3: DataFrame | None = None) -> dict[str, DataFrame]:
    """``metrics`` (entity, metric, value), ``nodes`` (with maps of values and origins), ``edges`` (with flow, ratio and number of records), ``edge_records`` (one row per contributing record) and ``manifest`` of a world version."""
    snap = written(with_country(snapshot(records), alpha3), "snapshot")
    f = flows(snap)
    pairs = written(f.groupBy("src", "dst").agg(F.sum("value").alias("flow"), F.count("*").alias("records")), "pairs")
    side = lambda c, m: pairs.groupBy(F.col(c).alias("entity")).agg(F.sum("flow").alias("value")).select("entity", F.lit(m).alias("metric"), "value", F.lit(None).cast("string").alias("record_id"), F.col("entity").alias("name"))
    metrics = written(side("src", "SUPPLY").unionByName(side("dst", "DEMAND")).unionByName(observed(snap)), "metrics")
    nodes = metrics.groupBy("entity").agg(F.min("name").alias("display_name"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("metrics"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", F.coalesce("record_id", F.lit("aggregate")))))).alias("origins"))
    total = pairs.groupBy("dst").agg(F.sum("flow").alias("total")).where("total > 0")
    edges = pairs.where("src <> dst").join(total, "dst").select(F.sha2(F.concat_ws("|", F.lit("trade-flow"), "src", "dst"), 256).alias("rel"), "src", "dst", F.lit("TRADE_FLOW").alias("type"), "flow", (F.col("flow") / F.col("total")).alias("ratio"), "records")
    sources = snap.groupBy("source_system").agg(F.count("*").alias("n"), F.max("data_version").alias("version"))
    manifest = sources.agg(F.sum("n").alias("records"), F.sort_array(F.collect_list(F.struct("source_system", "version", "n"))).alias("sources"))
    have = nodes.agg(F.count("*").alias("nodes")).join(edges.agg(F.count("*").alias("edges")))
    manifest = manifest.join(have).withColumn("status", F.when(F.col("nodes") > 0, "READY").otherwise("INSUFFICIENT_DATA")).withColumn("note", F.when((F.col("nodes") > 0) & (F.col("edges") == 0), "no quantitative relationships"))
    return {"metrics": metrics, "nodes": nodes, "edges": edges, "edge_records": f, "manifest": manifest}


def semantic(records: DataFrame) -> DataFrame:
    """Typed edges ``type``, ``source``, ``target`` by mapping rules, each once. Records carry ``country`` and ``partner`` (see ``with_country``)."""

    def rule(df: DataFrame, name, source, target) -> DataFrame:
        return df.select(F.lit(name).alias("type"), source.alias("source"), target.alias("target")).where("source is not null and target is not null and source <> target")

    tag = lambda kind, c: F.concat(F.lit(f"{kind}:"), c)
    system = F.col("source_system")
    code, cik, corp = F.col("classification_code"), dim("cik"), dim("corpCode")
    company = F.coalesce(tag("company:CIK", cik), tag("company:DART_CORP_CODE", corp))
    r = records.withColumn("metric", metric())
    out = rule(r.where(system.isin(STATISTICS) & F.col("metric").isNotNull()), "HAS_INDICATOR", F.col("country"), tag("indicator", F.col("metric")))
    out = out.unionByName(rule(r.where("record_type = 'SEC_XBRL_FACT'"), "HAS_INDICATOR", company, tag("indicator", F.col("metric"))))
    out = out.unionByName(rule(r, "CLASSIFIED_AS", company, tag("industry", F.coalesce(dim("sic"), dim("industryCode")))))
    port = r.where((system == "WPI") | ((system == "UNLOCODE") & F.contains(dim("function"), F.lit("1"))))
    out = out.unionByName(rule(port, "LOCATED_IN", tag("port", F.col("natural_key")), F.col("country")))
    out = out.unionByName(rule(r.where(system == "HS"), "PARENT_OF", tag("product", dim("parent")), tag("product", code)))
    flows_of = r.where((system == "UN_COMTRADE") & (F.col("country") != F.col("partner")))
    goods = flows_of.where(F.upper(code) != "TOTAL")
    imports = F.upper(dim("flowCode")) == "M"
    exporter, importer, product = F.when(imports, F.col("partner")).otherwise(F.col("country")), F.when(imports, F.col("country")).otherwise(F.col("partner")), tag("product", code)
    out = out.unionByName(rule(flows_of, "TRADE_FLOW", exporter, importer))
    for name, a, b in (("PRODUCES", exporter, product), ("SUPPLIES", product, importer), ("DEPENDS_ON", importer, product)):
        out = out.unionByName(rule(goods, name, a, b))
    out = out.unionByName(rule(goods.where(dim("motCode") != "0"), "SHIPS_VIA", product, tag("mode", dim("motCode"))))
    return out.distinct()


def snapshot_is_new(manifests: DataFrame, fingerprint: str) -> bool:
    """Whether no ready version has this fingerprint with its counts."""
    return manifests.where((F.col("fingerprint") == fingerprint) & (F.col("index_status") == "READY") & F.col("records").isNotNull()).isEmpty()


def latest_world(versions: DataFrame, worlds: DataFrame, world: str) -> DataFrame:
    """A world's newest version that has a baseline."""
    mine = versions.join(worlds.where(F.col("world_id") == world).select("world_id", "name"), "world_id")
    return mine.where(F.get_json_object("state", "$.baselineStatus").isNotNull()).orderBy(F.desc("created_at"), F.desc("version_number")).limit(1)


def runs_with_turns(branches: DataFrame, runs: DataFrame, turns: DataFrame) -> DataFrame:
    """Branches of a scenario with their runs, if any, and each run's turns in order (120 at most)."""
    t = turns.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("turn", "state"))).alias("turns"))
    return branches.join(runs, "branch_id", "left").join(t, "run_id", "left")


def append_turns(turns: DataFrame, path: str) -> None:
    """Append snapshots (``run_id``, ``turn``, ``state``) of turns that the table does not have yet."""
    try:
        have = turns.sparkSession.read.schema(turns.schema).parquet(path)
        turns = turns.join(have.select("run_id", "turn"), ["run_id", "turn"], "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    turns.write.mode("append").parquet(path)


def with_places(entities: DataFrame, ids: list[str]) -> DataFrame:
    """The entities of the given ids with ``pos``, their places; unknown ids are left out."""
    return entities.join(entities.sparkSession.createDataFrame(list(enumerate(ids)), "pos int, id string"), "id")


def in_given_order(entities: DataFrame, ids: list[str]) -> DataFrame:
    """The entities of the given ids, in their order."""
    return with_places(entities, ids).orderBy("pos").drop("pos")


def index_text(records: DataFrame) -> DataFrame:
    """A record as lines of key=value for the text index."""
    fields = ["source_system", "record_type", "natural_key", "country_code", "classification_code", "unit_code", "value"]
    lines = [F.concat(F.lit(f"{c}="), F.col(c)) for c in fields]
    extra = F.array_join(F.transform(F.array_sort(F.map_entries("dimensions")), lambda e: F.concat_ws("=", e["key"], e["value"])), "\n")
    return records.select("record_id", F.concat_ws("\n", *lines, F.nullif(extra, F.lit(""))).alias("text"))


def search_documents(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(aliases, documents)`` of nodes (``id``, ``natural_key``, ``name``, ``attributes`` as JSON): names to find a node by, each once, and the text of all its fields."""
    listed = F.coalesce(F.from_json(F.get_json_object("attributes", "$.aliases"), "array<string>"), F.array().cast("array<string>"))
    names = F.array_compact(F.concat(F.array("name", "natural_key", F.get_json_object("attributes", "$.symbol")), listed))
    aliases = nodes.select("id", F.explode(names).alias("a")).select("id", fn.first_text(F.lower("a")).alias("alias")).where("alias is not null").dropDuplicates()
    return aliases, nodes.select("id", F.concat_ws(" ", "name", "natural_key", F.array_join(listed, " ")).alias("text"))


def misplaced_chunks(chunks: DataFrame, evidence: DataFrame) -> DataFrame:
    """Chunks whose evidence is of another source than they say, or of none."""
    e = evidence.select("evidence_id", F.col("source_id").alias("own"))
    return chunks.join(e, "evidence_id", "left").where("evidence_id is not null and not (own <=> source_id)").drop("own")


def outcomes(results: DataFrame) -> DataFrame:
    """How many records (``record_id``, ``error``) were indexed and how many failed."""
    return results.agg(F.count_if(F.col("error").isNull()).alias("indexed"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def failures(results: DataFrame) -> DataFrame:
    """Every record that failed, with its error."""
    return results.where("error is not null").select("record_id", "error")


def new_snapshots(fingerprints: DataFrame, manifests: DataFrame) -> DataFrame:
    """``fingerprint``, ``is_new``: whether no ready version has it with its counts."""
    ready = manifests.where((F.col("index_status") == "READY") & F.col("records").isNotNull()).select("fingerprint", F.lit(True).alias("had")).distinct()
    return fingerprints.join(ready, "fingerprint", "left").select("fingerprint", F.col("had").isNull().alias("is_new"))


def reload_check(named: DataFrame, records: DataFrame) -> DataFrame:
    """``version``, ``expected``, ``loaded``, ``whole``: whether all records that a version names (``version``, ``record_id``) are there."""
    found = named.join(records.select("record_id", F.lit(1).alias("found")).distinct(), "record_id", "left")
    return found.groupBy("version").agg(F.count("*").alias("expected"), F.count("found").alias("loaded")).withColumn("whole", F.col("expected") == F.col("loaded"))


def affects(records: DataFrame, km: float = 500) -> DataFrame:
    """``type``, ``source``, ``target``: earthquakes and the ports within ``km`` of them."""
    at = lambda kind, name: records.where(F.col("record_type") == kind).select(F.col("natural_key").alias(name), dim("latitude").try_cast("double").alias(f"{name}_lat"), dim("longitude").try_cast("double").alias(f"{name}_lon")).dropna()
    near = within(at("EARTHQUAKE", "a"), at("PORT", "b"), km)
    return near.select(F.lit("AFFECTS").alias("type"), F.concat(F.lit("crisis:"), "a").alias("source"), F.concat(F.lit("port:"), "b").alias("target")).distinct()
