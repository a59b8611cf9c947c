"""Date parsing and calendar columns."""

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from floodframe import constants as K

_UNICODE_DASHES = "–—−"  # en dash, em dash, minus sign


def normalize_dashes(col: Column) -> Column:
    """Trim white space and turn typographic dashes into ``-``."""
    return F.translate(F.regexp_replace(col, r"^\s+|\s+$", ""), _UNICODE_DASHES, "---")


def parse_date_robust(col: Column) -> Column:
    """String to DATE: ISO, then day first, then month first, then spreadsheet day number."""
    text = F.regexp_replace(normalize_dashes(col.cast("string")), r"[T\s].*$", "")
    dashed = F.regexp_replace(text, "[/.]", "-")
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    year_first = F.when(dashed.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(dashed, "yyyy-M-d"))
    year_last = dashed.rlike(r"^\d{1,2}-\d{1,2}-\d{4}$")
    day_first = F.when(year_last, F.try_to_date(dashed, "d-M-yyyy"))
    month_first = F.when(year_last, F.try_to_date(dashed, "M-d-yyyy"))
    compact = F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd"))
    serial = F.when(
        text.rlike(r"^\d{1,7}(\.\d+)?$"),
        F.date_add(F.lit("1899-12-30").cast("date"), F.floor(text.try_cast("double")).cast("int")),
    )
    return F.coalesce(iso, year_first, day_first, month_first, compact, serial)


def pick_date_column(columns: Sequence[str]) -> str | None:
    """The column holding the event date, judged by its normalised name."""
    known = [(c.strip().lower().replace(" ", "_"), c) for c in columns]
    known = [(name, c) for name, c in known if name in K.DATE_NAMES]
    for wanted in K.DATE_PREFERRED:
        for name, original in known:
            if name == wanted:
                return original
    return known[0][1] if known else None


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """DATE from separate parts; null if they form no date."""
    part = lambda c: c.cast("string")
    complete = year.isNotNull() & month.isNotNull() & day.isNotNull()
    return F.when(complete, F.try_to_date(F.concat_ws("-", part(year), part(month), part(day)), "y-M-d"))


def classify_release(day: Column) -> dict[str, Column]:
    """Model version, product and model name in force on a day."""
    earlier = day < F.lit(K.MODEL_TRANSITION)
    names = ("model_version", "product_type", "model_name")
    return {
        name: F.when(earlier, old).when(day.isNotNull(), new)
        for name, old, new in zip(names, K.RELEASES["before"], K.RELEASES["after"])
    }


def half_month_part(day: Column) -> Column:
    """1 for days 1-15, 2 for the rest of the month."""
    return F.when(F.dayofmonth(day) <= 15, 1).when(day.isNotNull(), 2)


def cyclic(part: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a calendar part, rounded against floating-point drift."""
    angle = F.lit(2.0) * F.pi() * (part / F.lit(period))
    return F.round(F.sin(angle), 10), F.round(F.cos(angle), 10)


def calendar_columns(day: Column) -> dict[str, Column]:
    """month, day_of_year (-1 without a date) and their cyclic forms (null without a date)."""
    month_sin, month_cos = cyclic(F.month(day), 12.0)
    doy_sin, doy_cos = cyclic(F.dayofyear(day), 365.0)
    return {
        "month": F.coalesce(F.month(day), F.lit(-1)),
        "day_of_year": F.coalesce(F.dayofyear(day), F.lit(-1)),
        "month_sin": month_sin, "month_cos": month_cos,
        "doy_sin": doy_sin, "doy_cos": doy_cos,
    }
