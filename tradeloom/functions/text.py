"""Column expressions and Arrow functions for text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = r"[\p{L}\p{N}]+"


def tokens(c) -> Column:
    """Letter and digit runs of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})"), 1)


def first_text(*columns) -> Column:
    """The first of several columns that is not blank, trimmed."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in columns))


def number(c) -> Column:
    """A number written with or without thousands commas; null if it is none."""
    return F.regexp_replace(c, ",", "").try_cast("decimal(38,9)")


def flexible_date(c) -> Column:
    """Dates written as yyyy, yyyyMM, yyyyMMdd or with an ISO date in front; null if they are none of these."""
    c = F.col(c) if isinstance(c, str) else c
    shaped = F.when(c.rlike(r"^\d{4}$"), F.concat(c, F.lit("-01-01"))).when(c.rlike(r"^\d{6}$"), F.concat_ws("-", c.substr(1, 4), c.substr(5, 2), F.lit("01"))).when(c.rlike(r"^\d{8}$"), F.concat_ws("-", c.substr(1, 4), c.substr(5, 2), c.substr(7, 2))).otherwise(c.substr(1, 10))
    other = F.when(shaped.rlike(r"^\d{4}-\d{2}-\d{2}$"), shaped.try_cast("date"))
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), c.substr(1, 10).try_cast("date")).otherwise(other)


def flexible_instant(c) -> Column:
    """ISO timestamps, or milliseconds since 1970; null if they are neither."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T"), c.try_cast("timestamp")), F.timestamp_millis(F.when(c.rlike(r"^-?\d{1,18}$"), c.try_cast("long"))))


def redacted(c) -> Column:
    """A URI with the values of parameters that look like credentials replaced."""
    return F.regexp_replace(c, r"(?i)([?&][^=&#]*(?:key|token|secret)[^=&#]*)=[^&#]*", "$1=REDACTED")


def similarity(a, b) -> Column:
    """1 - edit distance / longer length; 1 for two empty texts."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


# Legal forms dropped from the end of a company's name.
LEGAL_FORMS = "incorporated inc corp corporation company co ltd limited llc plc".split()


def company_name(c) -> Column:
    """A company's name for comparison: lower case, without punctuation and white space, then without legal forms at its end. Compatibility forms are folded by ``nfkc`` beforehand."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[\p{Punct}\s]+", ""), f"({'|'.join(LEGAL_FORMS)})+$", "")


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility-normalised text: Spark has no built-in for it."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def nfkc_casefold(s: pd.Series) -> pd.Series:
    """Compatibility-normalised, case-folded text: Spark has no built-in for it."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance on a sphere of radius 6371.0088 km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.atan2(F.sqrt(a), F.sqrt(1 - a))
