"""JSON read as VARIANT and walked level by level in the JVM. A text that is no JSON, or in which an object has a key twice, has no value."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import written

# What formats look like, before they are read as dates and times.
UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
_DATE, _TIME, _URI = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$", r"^[A-Za-z][\w+.-]*:\S+$"


def kind(v) -> Column:
    """The kind of a variant: OBJECT, ARRAY, STRING, BOOLEAN, NUMBER or NULL; null for no value."""
    t = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    return F.when(t.isin("OBJECT", "ARRAY", "STRING", "BOOLEAN"), t).when(t == "VOID", "NULL").when(t.isNotNull(), "NUMBER")


def child(v, key: str) -> Column:
    """An object's member as a variant; null if there is none. The key holds one kind of quotes at most."""
    return F.try_variant_get(v, f"$['{key}']" if "'" not in key else f'$["{key}"]', "variant")


def levels(df: DataFrame, id_col: str, json_col: str) -> Iterator[DataFrame]:
    """``id``, ``key``, ``value`` (variant) of what objects and arrays hold, level by level from the outermost, until a level holds neither; ``key`` is null in arrays. A level's
    containers are written once, and only they go on to the next."""
    v = F.try_parse_json(json_col)
    at = df.select(F.col(id_col).alias("id"), v.alias("v")).where(kind("v").isin("OBJECT", "ARRAY"))
    while True:
        held = at.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer())).select("id", "key", "value")
        held = written(held, "json-level")
        yield held
        at = held.where(kind("value").isin("OBJECT", "ARRAY")).select("id", F.col("value").alias("v"))
        if at.isEmpty():
            return


def schema_faults(v: Column, schema: dict, path: str = "$") -> Column:
    """Faults of a variant against a schema of type, properties, required, additionalProperties, minProperties, minimum, maximum, format and enum: an array of texts. One expression, as deep as the schema."""
    k = kind(v)
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    when = lambda fault, said: F.when(F.coalesce(fault, F.lit(False)), F.lit(said) if isinstance(said, str) else said)
    rules = []
    if "enum" in schema:
        allowed = [F.when(k == "STRING", text == x) if isinstance(x, str) else F.when(k == "NUMBER", number == float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else F.to_json(v) == json.dumps(x, separators=(",", ":")) for x in schema["enum"]]
        rules.append(when(~F.greatest(F.lit(False), *(F.coalesce(a, F.lit(False)) for a in allowed)), f"{path} is not one of the allowed values"))
    if "minimum" in schema:
        rules.append(when((k == "NUMBER") & (number < schema["minimum"]), f"{path} must be at least {schema['minimum']}"))
    if "maximum" in schema:
        rules.append(when((k == "NUMBER") & (number > schema["maximum"]), f"{path} must be at most {schema['maximum']}"))
    if form := schema.get("format"):
        looks = {"uuid": text.rlike(UUID), "uri": text.rlike(_URI), "date": text.rlike(_DATE) & text.try_cast("date").isNotNull(), "date-time": (text.rlike(_TIME) & text.try_cast("timestamp").isNotNull()) | (text.rlike(_DATE) & text.try_cast("date").isNotNull())}
        if form in looks:
            rules.append(when((k == "STRING") & ~F.coalesce(looks[form], F.lit(False)), f"{path} is no {form}"))
    for name in schema.get("required", []):
        there = child(v, name)
        rules.append(when((k == "OBJECT") & (there.isNull() | (kind(there) == "NULL")), f"{path}.{name} is required"))
    keys = F.json_object_keys(F.to_json(v))
    if "minProperties" in schema:
        rules.append(when((k == "OBJECT") & (F.size(keys) < schema["minProperties"]), f"{path} has too few properties"))
    found = [F.array_compact(F.array(*rules)) if rules else F.array().cast("array<string>")]
    known = schema.get("properties", {})
    if schema.get("additionalProperties") is False:
        foreign = F.array_except(keys, F.array(*map(F.lit, known)).cast("array<string>"))
        found.append(F.when(k == "OBJECT", F.transform(foreign, lambda x: F.concat(F.lit(f"{path}."), x, F.lit(" is not allowed")))).otherwise(F.array().cast("array<string>")))
    for name, inner in known.items():
        there = child(v, name)
        found.append(F.when((k == "OBJECT") & there.isNotNull() & (kind(there) != "NULL"), schema_faults(there, inner, f"{path}.{name}")).otherwise(F.array().cast("array<string>")))
    every = F.concat(*found)
    if wanted := schema.get("type"):
        fits = {"number": k == "NUMBER", "integer": (k == "NUMBER") & (number == F.floor(number)), "null": k == "NULL"}.get(wanted, k == wanted.upper() if wanted in ("object", "array", "string", "boolean") else F.lit(True))
        every = F.when(~F.coalesce(fits, F.lit(False)), F.array(F.lit(f"{path} must be {wanted}"))).otherwise(every)
    return every
