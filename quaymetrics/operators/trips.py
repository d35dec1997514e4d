"""Raw trip records of two sources to one clean schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quaymetrics.core import col
from quaymetrics.functions.columns import (
    clean_string,
    iso_weekday,
    on_increment,
    on_quarter_hour,
    parse_boolean,
    parse_flag,
    safe_double,
    to_utc,
    zone_code,
)


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_S, _B, _D, _L = T.StringType(), T.BooleanType(), T.DoubleType(), T.LongType()
_N = T.TimestampNTZType()

# Column names and types of the two raw layouts and of the clean trip.
SOURCE_A_RAW = _schema(
    trip_id=_S, trip_start_timestamp=_S, trip_end_timestamp=_S, trip_seconds=_L, trip_miles=_D,
    pickup_census_tract=_S, dropoff_census_tract=_S, pickup_community_area=_L,
    dropoff_community_area=_L, fare=_D, tip=_D, additional_charges=_D, trip_total=_D,
    shared_trip_authorized=_B, trips_pooled=_L, pickup_centroid_latitude=_D,
    pickup_centroid_longitude=_D, dropoff_centroid_latitude=_D, dropoff_centroid_longitude=_D,
)
SOURCE_B_RAW = _schema(
    hvfhs_license_num=_S, dispatching_base_num=_S, originating_base_num=_S, request_datetime=_N,
    on_scene_datetime=_N, pickup_datetime=_N, dropoff_datetime=_N, PULocationID=_L,
    DOLocationID=_L, trip_miles=_D, trip_time=_L, base_passenger_fare=_D, tolls=_D, bcf=_D,
    sales_tax=_D, congestion_surcharge=_D, airport_fee=_D, tips=_D, driver_pay=_D,
    shared_request_flag=_S, shared_match_flag=_S, access_a_ride_flag=_S, wav_request_flag=_S,
    wav_match_flag=_S, cbd_congestion_fee=_D,
)
CLEAN_TRIP = _schema(
    source=_S, source_dataset_id=_S, trip_id=_S, record_id_is_surrogate=_B, provider_id=_S,
    dispatching_base_id=_S, request_datetime=_N, pickup_datetime=_N, dropoff_datetime=_N,
    pickup_datetime_utc=T.TimestampType(), dropoff_datetime_utc=T.TimestampType(),
    source_timezone=_S, service_date=T.DateType(), service_year=T.IntegerType(),
    service_month=T.ByteType(), service_day_of_week=T.ByteType(), pickup_zone_id=_S,
    dropoff_zone_id=_S, zone_type=_S, pickup_census_tract=_S, dropoff_census_tract=_S,
    trip_seconds=_L, trip_miles=_D, fare=_D, tips=_D, tolls=_D, taxes_and_surcharges=_D,
    additional_charges=_D, total_amount=_D, driver_pay=_D, airport_fee=_D, shared_requested=_B,
    shared_matched=_B, trips_pooled=_L, airport_trip=_B, pickup_zone_missing=_B,
    dropoff_zone_missing=_B, pickup_census_tract_missing_or_suppressed=_B,
    dropoff_census_tract_missing_or_suppressed=_B,
    reported_timestamp_rounding_minutes=T.ShortType(), reported_fare_rounding_increment=_D,
    reported_tip_rounding_increment=_D, pickup_on_15_minute_grid=_B, fare_on_declared_grid=_B,
)
AIRPORTS_A = ("56", "76")
AIRPORTS_B = ("1", "132", "138")
SCHEMA_VERSION = "1.0.0"
DATASET_A = "m6dm-c72p"
UNKNOWN_ZONE = "__MISSING_OR_OUTSIDE__"


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Optional columns the input lacks, as typed nulls."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name not in df.columns}
    return df.withColumns(missing) if missing else df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns, order and types; absent columns are null."""
    full = ensure_columns(df, schema)
    return full.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def check_clean(df: DataFrame) -> None:
    got = {f.name: f.dataType for f in df.schema}
    want = {f.name: f.dataType for f in CLEAN_TRIP}
    if got != want:
        wrong = sorted(n for n in got.keys() | want.keys() if got.get(n) != want.get(n))
        raise ValueError(f"not a clean trip table, see columns {wrong}")


def _wall(c: str) -> Column:
    return col(c).cast("string").try_cast("timestamp_ntz")


def _clock(local_pickup: str, local_dropoff: str, tz: str) -> dict[str, Column]:
    p, d = F.col(local_pickup), F.col(local_dropoff)
    return {
        "pickup_datetime": p,
        "dropoff_datetime": d,
        "pickup_datetime_utc": to_utc(p, tz),
        "dropoff_datetime_utc": to_utc(d, tz),
        "source_timezone": F.lit(tz),
        "service_date": F.to_date(p),
        "service_year": F.year(p),
        "service_month": F.month(p),
        "service_day_of_week": iso_weekday(p),
        "pickup_on_15_minute_grid": on_quarter_hour(p),
    }


def _select_clean(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    return df.select(
        *[
            cols.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in CLEAN_TRIP
        ]
    )


def normalize_source_a(raw: DataFrame) -> DataFrame:
    """Trips published on a 15-minute grid with suppressed census tracts."""
    df = ensure_columns(raw, SOURCE_A_RAW).withColumns(
        {
            "_p": _wall("trip_start_timestamp"),
            "_d": _wall("trip_end_timestamp"),
            "_pz": zone_code("pickup_community_area"),
            "_dz": zone_code("dropoff_community_area"),
            "_pt": clean_string("pickup_census_tract"),
            "_dt": clean_string("dropoff_census_tract"),
            "_pooled": col("trips_pooled").cast("string").try_cast("bigint"),
            "_fare": safe_double("fare"),
        }
    )
    pz, dz = F.col("_pz"), F.col("_dz")
    return _select_clean(
        df,
        {
            **_clock("_p", "_d", "America/Chicago"),
            "source": F.lit("chicago_tnp"),
            "source_dataset_id": F.lit(DATASET_A),
            "trip_id": clean_string("trip_id"),
            "record_id_is_surrogate": F.lit(False),
            "pickup_zone_id": pz,
            "dropoff_zone_id": dz,
            "zone_type": F.lit("chicago_community_area"),
            "pickup_census_tract": F.col("_pt"),
            "dropoff_census_tract": F.col("_dt"),
            "trip_seconds": col("trip_seconds").cast("string").try_cast("bigint"),
            "trip_miles": safe_double("trip_miles"),
            "fare": F.col("_fare"),
            "tips": safe_double("tip"),
            "additional_charges": safe_double("additional_charges"),
            "total_amount": safe_double("trip_total"),
            "shared_requested": parse_boolean("shared_trip_authorized"),
            "shared_matched": F.col("_pooled") > 1,
            "trips_pooled": F.col("_pooled"),
            "airport_trip": pz.isin(*AIRPORTS_A) | dz.isin(*AIRPORTS_A),
            "pickup_zone_missing": pz.isNull(),
            "dropoff_zone_missing": dz.isNull(),
            "pickup_census_tract_missing_or_suppressed": F.col("_pt").isNull(),
            "dropoff_census_tract_missing_or_suppressed": F.col("_dt").isNull(),
            "reported_timestamp_rounding_minutes": F.lit(15),
            "reported_fare_rounding_increment": F.lit(2.5),
            "reported_tip_rounding_increment": F.lit(1.0),
            "fare_on_declared_grid": on_increment(F.col("_fare"), 2.5),
        },
    )


def normalize_source_b(raw: DataFrame, source_row: Column | None = None) -> DataFrame:
    """Trips with itemised fees and no record id.

    `source_row` makes the surrogate id unique. By default it is the position in the source
    file, which needs no ordering of the table and is the same on every retry.
    """
    row = (
        source_row
        if source_row is not None
        else F.concat_ws("#", F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    )

    def fee(name: str) -> Column:
        return F.coalesce(safe_double(name), F.lit(0.0))

    def known(c: Column) -> Column:
        return F.coalesce(c, F.lit("unknown"))

    taxes = reduce(
        lambda a, b: a + b,
        [fee(n) for n in ("bcf", "sales_tax", "congestion_surcharge", "cbd_congestion_fee")],
    )
    df = ensure_columns(raw.withColumn("_row", row), SOURCE_B_RAW).withColumns(
        {
            "_p": _wall("pickup_datetime"),
            "_d": _wall("dropoff_datetime"),
            "_pz": zone_code("PULocationID"),
            "_dz": zone_code("DOLocationID"),
            "_taxes": taxes,
        }
    )
    pz, dz = F.col("_pz"), F.col("_dz")
    extra = F.col("_taxes") + fee("tolls") + fee("airport_fee")
    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    trip_id = F.concat(
        F.lit("nyc_hvfhv:"),
        known(clean_string("hvfhs_license_num")),
        F.lit(":"),
        F.date_format("_p", stamp),
        F.lit(":"),
        F.date_format("_d", stamp),
        F.lit(":"),
        known(pz),
        F.lit(":"),
        known(dz),
        F.lit(":"),
        F.col("_row").cast("string"),
    )
    return _select_clean(
        df,
        {
            **_clock("_p", "_d", "America/New_York"),
            "source": F.lit("nyc_hvfhv"),
            "source_dataset_id": F.lit(f"fhvhv-{SCHEMA_VERSION}"),
            "trip_id": trip_id,
            "record_id_is_surrogate": F.lit(True),
            "provider_id": clean_string("hvfhs_license_num"),
            "dispatching_base_id": clean_string("dispatching_base_num"),
            "request_datetime": _wall("request_datetime"),
            "pickup_zone_id": pz,
            "dropoff_zone_id": dz,
            "zone_type": F.lit("nyc_taxi_zone"),
            "trip_seconds": col("trip_time").cast("string").try_cast("bigint"),
            "trip_miles": safe_double("trip_miles"),
            "fare": safe_double("base_passenger_fare"),
            "tips": safe_double("tips"),
            "tolls": safe_double("tolls"),
            "taxes_and_surcharges": F.col("_taxes"),
            "additional_charges": extra,
            "total_amount": fee("base_passenger_fare") + fee("tips") + extra,
            "driver_pay": safe_double("driver_pay"),
            "airport_fee": safe_double("airport_fee"),
            "shared_requested": parse_flag("shared_request_flag"),
            "shared_matched": parse_flag("shared_match_flag"),
            "airport_trip": (fee("airport_fee") > 0)
            | pz.isin(*AIRPORTS_B)
            | dz.isin(*AIRPORTS_B),
            "pickup_zone_missing": pz.isNull(),
            "dropoff_zone_missing": dz.isNull(),
        },
    )


NORMALIZERS = {"chicago_tnp": normalize_source_a, "nyc_hvfhv": normalize_source_b}


def normalize_trips(raw: DataFrame, source: str, **options) -> DataFrame:
    if source not in NORMALIZERS:
        raise ValueError(f"unknown trip source {source!r}")
    return NORMALIZERS[source](raw, **options)


def union_sources(*clean: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), clean)
