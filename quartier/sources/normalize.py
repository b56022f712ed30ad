"""Normalisers of raw string tables, and readers that prune and page."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import safe_date
from ..functions.keys import normalize_key, resolve_key
from ..functions.numbers import degree_days

#: Violation codes that mean pests.
PEST_CODES = ("04K", "04L", "08A")


def _first(df: DataFrame, *names: str) -> Column:
    """The first non-blank value among those columns that exist."""
    held = [F.when(F.trim(F.col(n).cast("string")) != "", F.col(n).cast("string")) for n in names if n in df.columns]
    return F.coalesce(*held) if held else F.lit(None).cast("string")


def _whole(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("int"))


def _flag(raw: Column, key: Column) -> Column:
    """Whether a key was given but can't be used."""
    return raw.isNotNull() & key.isNull()


def resolve_columns(df: DataFrame, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """Selects each target from the first of its aliases that exists, comparing names without case and spaces."""
    plain = lambda s: re.sub(r"[\s_]+", "", s).lower()
    there = {}
    for c in df.columns:
        there.setdefault(plain(c), c)
    out, missing = [], []
    for target, aliases in wanted.items():
        found = next((there[plain(a)] for a in (*aliases,) if plain(a) in there), None)
        if found is None:
            missing.append(f"{target} (tried {', '.join(aliases)})")
        else:
            out.append(F.col(f"`{found}`").alias(target))
    if missing:
        raise ValueError(f"no column for {'; '.join(missing)}; the table has {', '.join(df.columns)}")
    return df.select(*out)


def read_strings(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A delimited file with a header: every column a string, names trimmed and in lower case."""
    df = spark.read.csv(path, header=True, inferSchema=False, sep=sep)
    return df.toDF(*[c.strip().lower() for c in df.columns])


def read_page(df: DataFrame, where: str | None = None, order: Sequence[str] = (), select: Sequence[str] = (), limit: int | None = None, offset: int = 0) -> DataFrame:
    """Filter, order, skip, cut and select, in this order."""
    if where:
        df = df.where(where)
    if order:
        df = df.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order])
    if offset:
        df = df.offset(offset)
    if limit is not None:
        df = df.limit(limit)
    return df.select(*select) if select else df


def retain_last(df: DataFrame, date: str, days: int = 1095, today: Column | None = None) -> DataFrame:
    """Rows of the last ``days`` days."""
    return df.where(F.col(date) >= F.date_sub(F.current_date() if today is None else today, days))


def normalize_inspections(df: DataFrame) -> DataFrame:
    """Typed inspections; rows without an id go, keys that can't be used are null and flagged."""
    raw = _first(df, "bbl")
    lon, lat = _first(df, "longitude", "x_coordinate", "x_coord"), _first(df, "latitude", "y_coordinate", "y_coord")
    both = lon.isNotNull() & lat.isNotNull()
    return df.select(
        _first(df, "job_ticket_or_work_order_id", "inspectionid", "inspection_id", "unique_key").alias("inspection_id"),
        safe_date(_first(df, "inspection_date", "inspectiondate")).alias("inspection_date"),
        normalize_key(raw).alias("bbl"),
        _flag(raw, normalize_key(raw)).alias("raw_bbl_missing"),
        _first(df, "bin").alias("bin"),
        _whole(_first(df, "boro_code", "boro")).alias("borough"),
        _whole(_first(df, "block")).alias("block"),
        _whole(_first(df, "lot")).alias("lot"),
        F.coalesce(_first(df, "result"), F.lit("")).alias("result"),
        _first(df, "inspection_type", "inspectiontype").alias("inspection_type"),
        _whole(_first(df, "jobprogress", "job_progress")).alias("job_progress"),
        F.when(both, lon.try_cast("double")).alias("lon"),
        F.when(both, lat.try_cast("double")).alias("lat"),
    ).where(F.col("inspection_id").isNotNull())


def normalize_complaints(df: DataFrame, category: str, column: str = "complaint_type") -> DataFrame:
    """Points of one category at day precision; rows without place or date go."""
    out = df.where(F.col(column) == category).select(
        safe_date(_first(df, "created_date")).alias("created_date"),
        _first(df, "longitude").try_cast("double").alias("lon"),
        _first(df, "latitude").try_cast("double").alias("lat"),
    )
    return out.dropna(subset=["created_date", "lon", "lat"])


def normalize_restaurants(df: DataFrame, pest_codes: Sequence[str] = PEST_CODES) -> DataFrame:
    """Restaurant violations with a composite key and a pest flag; rows without restaurant or date go."""
    day, raw = F.substring(_first(df, "inspection_date"), 1, 10), _first(df, "bbl")
    code = F.coalesce(F.upper(F.trim(_first(df, "violation_code"))), F.lit(""))
    return df.select(
        F.concat(_first(df, "camis"), F.lit("_"), day, F.lit("_"), code).alias("record_id"),
        _first(df, "camis").alias("camis"),
        normalize_key(raw).alias("bbl"),
        _flag(raw, normalize_key(raw)).alias("raw_bbl_missing"),
        safe_date(day).alias("inspection_date"),
        F.nullif(code, F.lit("")).alias("violation_code"),
        code.isin(*pest_codes).alias("is_pest_violation"),
        _first(df, "grade").alias("grade"),
        _whole(_first(df, "score")).alias("score"),
    ).where(F.col("record_id").isNotNull())


def normalize_permits(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Permits of differently named sources in one table, tagged by source; rows without number or date go."""
    out = None
    for source, df in sources.items():
        raw, issued = _first(df, "bbl", "bin__s_bbl"), _first(df, "issuance_date", "issued_date", "filing_date")
        number = _first(df, "job__", "job_filing_number", "initial_cost")
        rows = df.select(
            F.concat(F.lit(f"{source}_"), number, F.lit("_"), F.substring(issued, 1, 10)).alias("permit_key"),
            normalize_key(raw).alias("bbl"),
            _flag(raw, normalize_key(raw)).alias("raw_bbl_missing"),
            _first(df, "bin", "bin_").alias("bin"),
            _first(df, "borough", "boro").alias("borough"),
            safe_date(issued).alias("issuance_date"),
            safe_date(_first(df, "expiration_date")).alias("expiration_date"),
            _first(df, "job_type", "job__type").alias("job_type"),
            _first(df, "work_type").alias("work_type"),
            F.lit("now" if "now" in source else "legacy").alias("source"),
        ).where(F.col("permit_key").isNotNull())
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources")
    return out


def normalize_lots(df: DataFrame, pad_landuse: bool = True) -> DataFrame:
    """Lots under their effective key; rows without a usable key go."""
    key, billing = normalize_key(_first(df, "bbl", "parid")), normalize_key(_first(df, "appbbl"))
    number = lambda c: _first(df, c).try_cast("double")
    landuse = F.substring(F.trim(_first(df, "landuse")), 1, 2)
    return df.select(
        resolve_key(key, billing).alias("bbl"),
        *[F.floor(F.abs(number(c))).cast("int").alias(c) for c in ("unitsres", "unitstotal", "yearbuilt")],
        (F.lpad(landuse, 2, "0") if pad_landuse else landuse).alias("landuse"),
        F.trim(_first(df, "bldgclass")).alias("bldgclass"),
        billing.alias("appbbl"),
        F.trim(_first(df, "nta2020", "nta", "ntacode")).alias("nta2020"),
        number("latitude").alias("latitude"),
        number("longitude").alias("longitude"),
    ).where(F.col("bbl").isNotNull())


#: Names that daily weather columns go by.
WEATHER_NAMES = {"time": "date", "tavg": "tavg_c", "temp": "tavg_c", "tmin": "tmin_c", "tmax": "tmax_c", "prcp": "prcp_mm", "snow": "snow_mm"}


def normalize_weather(df: DataFrame, base: float = 18.0) -> DataFrame:
    """Daily weather with degree days; days without any measurement go."""
    df = df.withColumnsRenamed({a: b for a, b in WEATHER_NAMES.items() if a in df.columns and b not in df.columns})
    measured = [c for c in df.columns if c != "date"]
    heating, cooling = degree_days(F.col("tavg_c").cast("double"), base)
    return df.dropna(how="all", subset=measured).withColumns({"date": F.col("date").cast("date"), "hdd": heating, "cdd": cooling})
