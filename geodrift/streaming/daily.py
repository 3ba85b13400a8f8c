"""New daily files as a stream of clean rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geodrift.functions.columns import compact_date, present

#: Fixed: the columns of daily files in their published order.
HEADER = ("site", "YYMMMDD", "yyyy.yyyy", "__MJD", "week", "d", "reflon", "_e0(m)", "__east(m)", "____n0(m)", "_north(m)", "u0(m)", "____up(m)", "_ant(m)", "sig_e(m)", "sig_n(m)", "sig_u(m)")


def new_rows(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """(station, date, east, north, up, sige, sign, sigu) of files as they arrive.

    A stream reads each file once and cannot look at another line of it, so the
    published column order is used in place of the header.
    """
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(folder)
    fields = F.split(F.trim("value"), r"\s+")
    at = {name: F.get(fields, k) for k, name in enumerate(HEADER)}

    def number(name: str):
        return present(at[name].try_cast("double"))

    rows = lines.where("trim(value) <> '' AND NOT contains(value, 'YYMMMDD')")
    return rows.select(
        F.upper(at["site"]).alias("station"), compact_date(at["YYMMMDD"]).alias("date"), (number("__east(m)") + number("_e0(m)")).alias("east"), (number("_north(m)") + number("____n0(m)")).alias("north"),
        (number("____up(m)") + number("u0(m)")).alias("up"), number("sig_e(m)").alias("sige"), number("sig_n(m)").alias("sign"), number("sig_u(m)").alias("sigu"),
    )


def latest_days(rows: DataFrame, late: str = "30 days", window: str = "30 days") -> DataFrame:
    """Rows and mean position by station and window of days, closed once the watermark has passed."""
    timed = rows.withColumn("at", F.col("date").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("station", F.window("at", window)).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in ("east", "north", "up")])
