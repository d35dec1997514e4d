"""Cleaning, parsing, dating and labelling of columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaymetrics.core import col, ratio

# --- text and codes ---------------------------------------------------------------


def clean_string(c: str | Column) -> Column:
    """Trimmed text, with empty text as null."""
    t = F.trim(col(c).cast("string"))
    return F.when(t != "", t)


def zone_code(c: str | Column) -> Column:
    """Zone codes as canonical integer text; what is not a number becomes null."""
    text = col(c).cast("string")
    return text.try_cast("double").try_cast("bigint").cast("string")


def safe_double(c: str | Column) -> Column:
    return col(c).cast("string").try_cast("double")


def parse_flag(c: str | Column) -> Column:
    """Y / N to a boolean; anything else is unknown."""
    t = F.upper(F.trim(col(c).cast("string")))
    return F.when(t == "Y", True).when(t == "N", False)


def parse_boolean(c: str | Column) -> Column:
    t = F.trim(F.lower(col(c).cast("string")))
    return F.when(t.isin("true", "t", "1", "yes", "y"), True).when(
        t.isin("false", "f", "0", "no", "n"), False
    )


def map_code(c: str | Column, mapping: Mapping[str, str], default: str | None) -> Column:
    """Code to class; codes outside the map take the explicit default."""
    out = None
    for code, label in mapping.items():
        cond = col(c) == code
        value = F.lit(label).cast("string")
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(F.lit(default).cast("string"))


def parse_rate(c: str | Column) -> Column:
    """Ad valorem duty text as a fraction: "Free" is zero, compound rates are null."""
    t = F.trim(col(c))
    number = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)\s*%$", 1)
    return F.when(F.lower(t) == "free", F.lit(0.0)).when(
        number != "", number.try_cast("double") / 100.0
    )


# --- dates and clocks -------------------------------------------------------------


def to_utc(c: str | Column, tz: str) -> Column:
    """Local wall time to UTC; clock-change gaps and repeated hours become null."""
    local = col(c).cast("timestamp")
    utc = F.to_utc_timestamp(local, tz)
    hour = F.expr("interval 1 hour")
    exists = F.from_utc_timestamp(utc, tz) == local
    repeated = (F.from_utc_timestamp(utc + hour, tz) == local) | (
        F.from_utc_timestamp(utc - hour, tz) == local
    )
    return F.when(exists & ~repeated, utc)


def on_quarter_hour(c: str | Column) -> Column:
    """Exactly on a 15-minute mark (whole milliseconds are looked at, as reported)."""
    t = col(c)
    millis = F.floor(F.extract(F.lit("SECOND"), t) * 1000)
    return (F.minute(t) % 15 == 0) & (millis == 0)


def on_increment(c: str | Column, step: float, tolerance: float = 1e-8) -> Column:
    x = col(c).cast("double")
    return F.abs(F.bround(x / step) * step - x) <= tolerance


def iso_weekday(c: str | Column) -> Column:
    return F.weekday(col(c)) + 1


def calendar_parts(ts: str | Column) -> dict[str, Column]:
    t = col(ts)
    return {
        "service_date": F.to_date(t),
        "year": F.year(t),
        "month": F.month(t),
        "day_of_week": iso_weekday(t),
        "hour": F.hour(t),
        "minute": F.minute(t),
        "is_weekend": iso_weekday(t) >= 6,
    }


def effective_availability(ts: str | Column, day: str | Column) -> Column:
    """The exact instant if known, else the last microsecond of the day (UTC)."""
    end = col(day).cast("timestamp") + F.expr(
        "interval 23 hours 59 minutes 59.999999 seconds"
    )
    return F.coalesce(col(ts).cast("timestamp"), end)


def label_regime(
    d: str | Column, intervals: Sequence[tuple[str, date, date]], default: str | None
) -> Column:
    """Label of the first closed interval containing the date."""
    out = F
    for label, lo, hi in intervals:
        out = out.when(col(d).between(F.lit(lo), F.lit(hi)), F.lit(label))
    return out.otherwise(F.lit(default))


def add_months(d: str | Column, n: int | Column) -> Column:
    return F.add_months(col(d), n)


# --- numbers ----------------------------------------------------------------------


def bucketize(c: str | Column, edges: Sequence[float], labels: Sequence | None = None) -> Column:
    """Half-open buckets [edge, next edge); below the first edge is bucket 0."""
    x = col(c)
    names = list(labels) if labels is not None else list(range(len(edges) + 1))
    out = F.when(x.isNull(), F.lit(None))
    for edge, name in zip(edges, names, strict=False):
        out = out.when(x < F.lit(float(edge)), F.lit(name))
    return out.otherwise(F.lit(names[len(edges)]))


def safe_log(c: str | Column) -> Column:
    x = col(c).cast("double")
    return F.when(x > 0, F.ln(x))


def transform(current: Column, previous: Column, kind: str) -> Column:
    """Series transforms; null on a missing or unusable base."""
    if kind == "level":
        return current.cast("double")
    if kind == "difference":
        return (current - previous).cast("double")
    if kind == "percent_change":
        return (ratio(current, previous) - 1.0) * 100.0
    if kind == "annualized_percent_change":
        return (F.pow(ratio(current, previous), 4.0) - 1.0) * 100.0
    if kind == "log_change":
        return (safe_log(current) - safe_log(previous)) * 100.0
    raise ValueError(f"unsupported transformation: {kind}")


# --- trade values -----------------------------------------------------------------

# fixed values: column names of the public trade files and of the staged schema
TRADE_NAMES = {
    "con_val_mo": "customs_value",
    "dut_val_mo": "dutiable_value",
    "cal_dut_mo": "calculated_duties",
    "con_cha_mo": "import_charges",
    "con_qy1_mo": "quantity",
    "unit_qy1": "quantity_unit",
}


def stage_trade(df: DataFrame, rename: Mapping[str, str] | None = None) -> DataFrame:
    """Raw flows to the staged schema; a line with no unit has no quantity, not zero."""
    out = df.withColumnsRenamed(dict(rename or {}))
    unit = F.col("unit_qy1")
    none_collected = unit.isNull() | unit.isin("-", "", "X")
    return out.withColumns(
        {
            "con_qy1_mo": F.when(~none_collected, F.col("con_qy1_mo")),
            "unit_qy1": F.when(none_collected, F.lit("")).otherwise(unit),
            "quantity_not_collected": none_collected,
        }
    )


def value_measures(df: DataFrame) -> DataFrame:
    """Value and unit-value concepts, each separately named; every ratio is guarded."""
    out = df.withColumnsRenamed(TRADE_NAMES)
    v, d, ch = F.col("customs_value"), F.col("calculated_duties"), F.col("import_charges")
    q, dv = F.col("quantity"), F.col("dutiable_value")

    def per(num: Column, den: Column) -> Column:
        return F.when(den > 0, num / den)

    return out.withColumns(
        {
            "cif_value": v + ch,
            "customs_unit_value": per(v, q),
            "landed_unit_value_duty_inclusive": per(v + d, q),
            "landed_unit_value_full": per(v + ch + d, q),
            "realised_duty_rate_on_dutiable": per(d, dv),
            "realised_duty_rate_on_customs": per(d, v),
            "freight_share_of_customs_value": per(ch, v),
        }
    )


# --- daily signals ----------------------------------------------------------------


def signal_flags(
    df: DataFrame, wet: float = 1.0, heavy: float = 10.0, freezing: float = 0.0
) -> DataFrame:
    """Daily weather-like flags by thresholds, with range sanity."""
    hi, lo = F.col("temperature_max_c"), F.col("temperature_min_c")
    rain, snow = F.col("precipitation_mm"), F.col("snowfall_mm")
    return df.withColumns(
        {
            "temperature_midrange_c": (hi + lo) / 2.0,
            "wet_day": rain >= wet,
            "heavy_precipitation_day": rain >= heavy,
            "snow_day": snow > 0,
            "freezing_day": lo <= freezing,
            "wet_or_snow_day": (rain >= wet) | (snow > 0),
            "range_valid": (hi >= lo) & (rain >= 0) & (snow >= 0),
        }
    )
