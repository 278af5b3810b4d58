"""The canonical posting record: column order, types, defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.functions.dates import parse_date
from jobloom.functions.text import strip

# fixed values: column order, type and default of the 30 columns
_STRING, _BOOL, _INT, _MONEY = "string", "boolean", "int", "decimal(12,2)"
COLUMNS: list[tuple[str, str, object]] = [
    ("id", _STRING, ""),
    ("title", _STRING, ""),
    ("company", _STRING, ""),
    ("description", _STRING, ""),
    ("location_raw", _STRING, ""),
    ("district", _STRING, ""),
    ("country", _STRING, "Rwanda"),
    ("is_remote", _BOOL, False),
    ("is_hybrid", _BOOL, False),
    ("rwanda_eligible", _BOOL, True),
    ("eligibility_reason", _STRING, ""),
    ("confidence_score", _INT, 0),
    ("sector", _STRING, ""),
    ("job_level", _STRING, ""),
    ("experience_years", _STRING, ""),
    ("employment_type", _STRING, ""),
    ("education_level", _STRING, ""),
    ("salary_min", _MONEY, None),
    ("salary_max", _MONEY, None),
    ("currency", _STRING, ""),
    ("salary_disclosed", _BOOL, False),
    ("posted_date", _STRING, ""),
    ("deadline", _STRING, ""),
    ("scraped_at", "timestamp", None),
    ("source", _STRING, ""),
    ("source_url", _STRING, ""),
    ("source_job_id", _STRING, ""),
    ("is_active", _BOOL, True),
    ("last_checked", "timestamp", None),
    ("duplicate_hash", _STRING, ""),
]
NAMES = [n for n, _, _ in COLUMNS]
_TYPES = {
    _STRING: T.StringType(), _BOOL: T.BooleanType(), _INT: T.IntegerType(),
    _MONEY: T.DecimalType(12, 2), "timestamp": T.TimestampType(),
}
POSTING_SCHEMA = T.StructType([T.StructField(n, _TYPES[t]) for n, t, _ in COLUMNS])
# the three columns the store fills in itself when a row is loaded
STAMPED = ("scraped_at", "is_active", "last_checked")


def to_decimal(c: Column | str) -> Column:
    """``''``, null, NaN and unreadable numbers become null."""
    c = F.col(c) if isinstance(c, str) else c
    number = F.nullif(F.trim(c.cast("string")), F.lit("")).try_cast("double")
    return F.when(~F.isnan(number), number).try_cast(_MONEY)


def _typed(df: DataFrame, name: str, kind: str, default: object) -> Column:
    if name not in df.columns:
        return F.lit(default).cast(kind).alias(name)
    c = F.col(name)
    if kind == _MONEY:
        out = to_decimal(c)
    elif kind == _STRING:
        # a missing value is empty; the default only stands in for a missing column
        out = F.coalesce(strip(c.cast("string")), F.lit(""))
    elif kind == _INT:
        out = F.coalesce(c.try_cast("double").try_cast("int"), F.lit(0))
    elif kind == _BOOL:
        out = F.coalesce(c.try_cast("boolean"), F.lit(default))
    else:
        out = c.try_cast(kind)
    return out.alias(name)


def enforce(df: DataFrame) -> DataFrame:
    """The 30 columns in order and type; missing ones get defaults, others are dropped."""
    return df.select(*[_typed(df, n, t, d) for n, t, d in COLUMNS])


def load_rows(df: DataFrame, as_of: Column) -> DataFrame:
    """Rows as stored: dates parsed, amounts decimal, load-time columns stamped."""

    def text(name: str, default: str) -> Column:
        return (F.col(name).cast("string") if name in df.columns else F.lit(default)).alias(name)

    def flag(name: str, default: bool) -> Column:
        return (F.coalesce(F.col(name).cast("boolean"), F.lit(default)) if name in df.columns else F.lit(default)).alias(name)

    out = []
    for name, kind, default in COLUMNS:
        if name in ("posted_date", "deadline"):
            raw = F.col(name) if name in df.columns else F.lit(None)
            out.append(parse_date(raw.cast("string")).alias(name))
        elif name == "currency":
            out.append(text(name, "RWF"))
        elif name == "is_active":
            out.append(F.lit(True).alias(name))
        elif name in STAMPED:
            out.append(as_of.cast("timestamp").alias(name))
        elif kind == _MONEY:
            out.append((to_decimal(name) if name in df.columns else F.lit(None).cast(_MONEY)).alias(name))
        elif kind == _BOOL:
            out.append(flag(name, bool(default)))
        elif kind == _INT:
            out.append((F.col(name).cast("int") if name in df.columns else F.lit(0)).alias(name))
        else:
            out.append(text(name, str(default)))
    return df.select(*out)
