"""Catalogue cleaning, typing, imputation and column selection."""

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F, types as T

from floodframe import constants as K
from floodframe.functions.dates import calendar_columns, parse_date_robust
from floodframe.functions.numbers import clamp
from floodframe.functions.risk import land_cover_name
from floodframe.operators.ranking import quantile_row, seeded_hash, shuffled_rank


# ---- dates and coordinates ----------------------------------------------------

def date_column_scores(df: DataFrame) -> DataFrame:
    """Share of values that parse as dates, for every column whose name suggests a date; one pass."""
    names = [c for c in df.columns if any(k in c.lower() for k in K.DATE_KEYWORDS)]
    shares = [F.avg(parse_date_robust(F.col(f"`{c}`").cast("string")).isNotNull().cast("int")).alias(c) for c in names]
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("valid_fraction"))
        for i, c in enumerate(names)
    ])
    return df.agg(*shares).select(F.inline(rows))


def detect_date_column(df: DataFrame) -> str:
    """First suggestively named column with more than half of its values parsing as dates."""
    best = (
        date_column_scores(df).where(F.col("valid_fraction") > K.DATE_VALID_FRACTION)
        .orderBy("position").first()
    )
    if best is None:
        raise ValueError("no start-date column found")
    return best["column_name"]


def resolve_coords(df: DataFrame) -> DataFrame:
    """``latitude`` and ``longitude`` as doubles from any known alias; text and NaN become null."""
    def first_named(names):
        for c in df.columns:
            if c.lower() in names:
                return c
        raise ValueError(f"none of the columns {names} found")

    def number(c):
        return F.nanvl(F.col(f"`{c}`").try_cast("double"), F.lit(None).cast("double"))

    lat, lon = first_named(K.LATITUDE_NAMES), first_named(K.LONGITUDE_NAMES)
    return df.withColumns({"latitude": number(lat), "longitude": number(lon)})


def filter_valid_events(df: DataFrame) -> DataFrame:
    """Rows with coordinates on the globe and a start date."""
    return df.where(
        F.col("latitude").between(-90, 90)
        & F.col("longitude").between(-180, 180)
        & F.col("flood_start_date").isNotNull()
    )


def with_event_defaults(df: DataFrame) -> DataFrame:
    """Positive target, and ``Unknown`` as flood type where the column is absent."""
    columns = {"target": F.lit(1)}
    if "flood_type" not in df.columns:
        columns["flood_type"] = F.lit("Unknown")
    return df.withColumns(columns)


def filter_bad_periods(
    df: DataFrame, periods: Sequence[tuple[date, date]] = K.BAD_PERIODS, day: str = "flood_start_date"
) -> DataFrame:
    """Drop events dated inside a period of corrupt source data (bounds included); undated events stay.

    The handful of configured periods becomes part of the filter, so it reaches the scan.
    """
    for start, end in periods:
        if start > end:
            raise ValueError(f"bad period runs backwards: {start} > {end}")
    bad = F.lit(False)
    for start, end in periods:
        bad = bad | F.col(day).between(F.lit(start), F.lit(end))
    return df.where(F.coalesce(~bad, F.lit(True)))


def with_calendar(df: DataFrame, day: str = "flood_start_date") -> DataFrame:
    return df.withColumns(calendar_columns(F.col(day)))


def with_coverage(df: DataFrame, day: str = "flood_start_date") -> DataFrame:
    """Flags for dates before a source began, and the source versions in force."""
    d = F.col(day)
    before = lambda cut: d < F.lit(cut)
    return df.withColumns({
        "pre_rain_era": before(K.RAIN_START),
        "pre_moisture_era": ~before(K.RAIN_START) & before(K.MOISTURE_V008_START),
        "imerg_coverage_note": F.when(before(K.RAIN_START), "pre_imerg_era").otherwise(""),
        "event_day_source": F.when(before(K.RAIN_START), "none").when(before(K.RAIN_EARLY_START), "late").when(d.isNotNull(), "early"),
        "smap_version_used": F.when(before(K.MOISTURE_V008_START), "v007").when(d.isNotNull(), "v008"),
    })


def with_lineage(df: DataFrame) -> DataFrame:
    """Processing stamps."""
    return df.withColumns({
        "data_extraction_timestamp": F.current_timestamp(),
        "pipeline_version": F.lit(K.PIPELINE_VERSION),
        "processing_date": F.current_timestamp(),
        "processing_version": F.lit(K.PROCESSING_VERSION),
        "data_sources": F.lit(K.DATA_SOURCES),
        "max_latency_hours": F.lit(K.MAX_LATENCY_HOURS),
    })


def with_region_flags(df: DataFrame, day: str = "flood_start_date", elevation: str = "gee_elevation_mean") -> DataFrame:
    """Season and climate-belt indicators."""
    month, lat = F.month(day), F.col("latitude")
    high = F.coalesce(F.col(elevation), F.lit(0.0))
    spring = month.isin(3, 4, 5, 6)
    flags = {
        "snowmelt_risk_spring": (high > 1000) & spring,
        "snow_region": (high > 800) & (F.abs(lat) > 35),
        "is_snowmelt_season": spring,
        "is_monsoon_season": month.isin(6, 7, 8, 9),
        "is_ice_season": month.isin(12, 1, 2, 3),
        "tropical_region": F.abs(lat) < 23.5,
        "temperate_region": (F.abs(lat) >= 23.5) & (F.abs(lat) < 50),
        "northern_region": lat > 50,
    }
    return df.withColumns({name: F.coalesce(test.cast("int"), F.lit(0)) for name, test in flags.items()})


def with_severity_label(df: DataFrame, severity: str = "severity", day: str = "flood_start_date") -> DataFrame:
    return df.withColumns({
        "y_binary": F.when(F.coalesce(F.col(severity), F.lit(0.0)) >= K.SEVERITY_CUT, 1).otherwise(0),
        "event_year": F.year(day),
    })


def with_land_cover_type(df: DataFrame, code: str = "Land_Cover") -> DataFrame:
    name = land_cover_name(F.col(code)) if code in df.columns else F.lit("Unknown")
    return df.withColumn("Land_Cover_Type", name)


# ---- columns ------------------------------------------------------------------------

def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def drop_leaky(df: DataFrame) -> DataFrame:
    """Drop columns known to leak the outcome."""
    return df.drop(*[c for c in df.columns if c in K.LEAKY_COLUMNS or K.LEAKY_SUBSTRING in c.lower()])


def _not_finite(c: str) -> Column:
    return F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))


def null_not_finite(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN and infinities to null in floating-point columns."""
    floating = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    chosen = [c for c in floating if columns is None or c in columns]
    return df.withColumns({c: F.when(~_not_finite(c), F.col(c)) for c in chosen})


def null_invalid_zeros(df: DataFrame, columns: Sequence[str], valid: Sequence[str] = K.ZERO_IS_VALID) -> DataFrame:
    """Zero to null in the columns where zero is no measurement."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in columns if c not in valid})


def clean_label(df: DataFrame, label: str = "target_future") -> DataFrame:
    """Label to 0/1: rounded half to even, clipped; rows without a usable label go."""
    y = F.col(label).try_cast("double")
    y = F.when(~(F.isnan(y) | y.isin(float("inf"), float("-inf"))), clamp(F.bround(y, 0), 0.0, 1.0))
    return df.withColumn(label, y.cast("int")).where(F.col(label).isNotNull())


def enforce_schema(
    df: DataFrame, columns: Sequence[str], fill: float | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Exactly ``keep`` and ``columns``, in order, as doubles; absent columns hold ``fill``."""
    present = set(df.columns)
    return df.select(
        *keep,
        *[
            (F.col(f"`{c}`").try_cast("double") if c in present else F.lit(fill).cast("double")).alias(c)
            for c in columns
        ],
    )


def feature_frames(df: DataFrame, roles: Mapping[str, Sequence[str]] = K.FEATURE_ROLES, keep: Sequence[str] = ()):
    """One frame of coerced features per role."""
    return {role: enforce_schema(df, columns, keep=keep) for role, columns in roles.items()}


def sparse_column_report(
    df: DataFrame,
    threshold: float = K.SPARSE_FRACTION,
    protect: Sequence[str] = K.SPARSE_PROTECTED,
) -> DataFrame:
    """Null and zero shares of every unprotected column and whether it is to go; one pass over the data."""
    names = [c for c in df.columns if c not in protect and not c.endswith(K.SPARSE_PROTECTED_SUFFIX)]
    aggregates = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(names):
        v = F.col(f"`{c}`").try_cast("double") if dict(df.dtypes)[c] in _CASTABLE else F.lit(None).cast("double")
        v = F.nanvl(v, F.lit(None).cast("double"))
        aggregates += [
            F.count(v).alias(f"_c{i}"),
            F.count_if(F.abs(F.coalesce(v, F.lit(0.0))) < K.NEAR_ZERO).alias(f"_z{i}"),
        ]
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"_c{i}").alias("present"), F.col(f"_z{i}").alias("zero_or_null"))
        for i, c in enumerate(names)
    ])
    n, filled, empty = F.col("_n"), F.col("present"), F.col("zero_or_null")
    gone = (filled == 0) | (empty == n) | ((n - filled) / n > threshold) | (empty / n > threshold)
    return df.agg(*aggregates).select("_n", F.inline(rows)).select(
        "column_name",
        ((n - filled) / n).alias("null_fraction"),
        (empty / n).alias("zero_fraction"),
        gone.alias("dropped"),
    )


_CASTABLE = {"tinyint", "smallint", "int", "bigint", "float", "double", "string"}


def drop_sparse_columns(
    df: DataFrame, threshold: float = K.SPARSE_FRACTION, protect: Sequence[str] = K.SPARSE_PROTECTED
) -> DataFrame:
    """Drop columns that are empty, all but zero, or mostly null or zero.

    The report has one row per column, which is all that reaches the driver.
    """
    report = sparse_column_report(df, threshold, protect)
    return df.drop(*[r["column_name"] for r in report.where("dropped").collect()])


def impute_median(df: DataFrame, columns: Sequence[str], stats: DataFrame | None = None) -> DataFrame:
    """Fill nulls with the exact column median; ``stats`` is a one-row frame of medians from other data."""
    row = stats if stats is not None else quantile_row(df, columns, 0.5)
    medians = row.select(F.struct(*columns)).scalar()
    return (
        df.withColumn("_medians", medians)
        .withColumns({c: F.coalesce(F.col(c).cast("double"), F.col("_medians").getField(c)) for c in columns})
        .drop("_medians")
    )


# ---- rows ------------------------------------------------------------------------------

def limit_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First ``n`` rows in the given order."""
    return df.orderBy(*order).limit(n)


def sample_rows(df: DataFrame, n: int, key: str, seed: int = K.SEED) -> DataFrame:
    """Repeatable sample of ``n`` rows: the first in a seeded hash order, whatever the partitioning."""
    return shuffled_rank(df, key, seed).where(F.col("shuffle_rank") <= n).select(*df.columns)

