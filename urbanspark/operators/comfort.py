"""Thermal comfort series: weather defaults, wind by nearest direction, means and classes of the index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from .spatialjoin import nearest_value

# What a missing reading counts as.
DEFAULTS = {"ta": 20.0, "rh": 50.0, "ghi": 0.0, "ws": 1.0, "pressure": 1013.25, "wdir": 0.0}


def weather_defaults(rows: DataFrame) -> DataFrame:
    """Readings without a number take their default; pressure comes in pascals; directions run from 0 to 360; dni, dhi stay null."""
    num = lambda c: F.when(~F.isnan(c), F.col(c))
    out = {c: F.coalesce(num(c) / 100.0 if c == "pressure" else num(c), F.lit(v)) for c, v in DEFAULTS.items() if c in rows.columns}
    out |= {"wdir": F.pmod(out["wdir"], F.lit(360.0))} if "wdir" in out else {}
    return rows.withColumns(out)


def time_range(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Inclusive; an end at midnight means the whole day."""
    stop = F.to_timestamp(F.lit(end))
    stop = F.when(F.date_trunc("day", stop) == stop, stop + F.expr("interval 86399 seconds")).otherwise(stop)
    return rows.where(F.col("ts").between(F.to_timestamp(F.lit(start)), stop))


def wind_direction(rows: DataFrame, directions: list[float] = dims.WIND_DIRECTIONS, circular: bool = False) -> DataFrame:
    return nearest_value(rows, "wdir", directions, circular, "raster_dir")


def clean_wind(speed: Column, nodata: float = -9999.0) -> Column:
    bad = F.isnan(speed) | (F.abs(speed) == float("inf")) | (speed < 0) | (speed <= -9000.0) | (speed == nodata)
    return F.when(~bad, speed)


def scaled_wind(speed: Column, measured: Column, reference: Column | float) -> Column:
    return speed * F.greatest(measured, F.lit(0.01)) / reference


def pixel_mean(rows: DataFrame, value: str = "utci", keys: tuple[str, ...] = ("row", "col")) -> DataFrame:
    """Mean over time, readings without a number left out."""
    return rows.groupBy(*keys).agg(F.avg(F.when(~F.isnan(value), F.col(value))).alias(f"mean_{value}"))


def day_range(rows: DataFrame, value: str, first: int = 7, last: int = 19) -> DataFrame:
    """vmin and vmax over day hours; one apart where all are equal."""
    day = rows.where(F.hour("ts").between(first, last) & ~F.isnan(value)).agg(F.min(value).alias("vmin"), F.max(value).alias("vmax"))
    return day.withColumn("vmax", F.when(F.col("vmax") == F.col("vmin"), F.col("vmin") + 1).otherwise(F.col("vmax")))


def stress_class(value: Column) -> Column:
    """How many of the index's boundaries a value has reached, 0 (extreme cold) to 9 (extreme heat)."""
    return sum((F.when(value >= b, 1).otherwise(0) for b in dims.UTCI_BREAKS), F.lit(0))


def summary(rows: DataFrame, day: tuple[int, int] = (7, 19), hot: float = 32.0) -> DataFrame:
    """Means by day and night and hours above a limit, per cell, of (ts, row, col, utci)."""
    light = F.hour("ts").between(*day)
    return rows.groupBy("row", "col").agg(F.avg("utci").alias("mean"), F.avg(F.when(light, F.col("utci"))).alias("day_mean"), F.avg(F.when(~light, F.col("utci"))).alias("night_mean"), F.count_if(F.col("utci") > hot).alias("hot_hours"))


def hour_of_name(name: Column) -> Column:
    """The hour in a raster's file name, ..._YYYYMMDD_HHMM..."""
    return F.regexp_extract(name, r"_(\d{8})_(\d{2})\d{2}", 2).cast("int")
