"""Readers of white-space separated text files; each gives a fixed schema with NULL for missing."""

from __future__ import annotations

from datetime import date as Date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geodrift.functions.columns import compact_date, decimal_year_date, padded_grid_point, present, wrapped_longitude
from geodrift.functions.geodesy import point_wkb
from geodrift.operators.reshape import with_lookup
from geodrift.operators.series import date_range, zeroed


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(fields, file) of the lines that are not blank."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_name").alias("file"))
    return lines.where("line <> ''").select(F.split("line", r"\s+").alias("fields"), "file")


def _number(column: Column) -> Column:
    return present(column.try_cast("double"))


def read_catalogue(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Station catalogue: name, latitude, longitude (wrapped), height; other lines give NULL numbers."""
    f = F.col("fields")
    return _lines(spark, path).select(f.getItem(0).alias("name"), _number(F.get(f, 1)).alias("lat"), wrapped_longitude(_number(F.get(f, 2))).alias("lon"), _number(F.get(f, 3)).alias("alt"))


def read_daily(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw daily files: (station, fields, header); the header line of each file names its columns.

    Headers are one row a file; they are joined by file, so files may differ.
    """
    lines = _lines(spark, path)
    station = F.upper(F.regexp_extract("file", r"^([^._]+)", 1))
    named = F.exists("fields", lambda x: x.isin("YYMMMDD", "__east(m)"))
    headers = lines.where(named).groupBy("file").agg(F.first("fields").alias("header"))
    return lines.where(~named).join(headers, "file").select(station.alias("station"), "fields", "header")


def _field(name: str) -> Column:
    return F.try_element_at("fields", F.nullif(F.array_position("header", F.lit(name)), F.lit(0)).cast("int"))


def clean_daily(raw: DataFrame, start: Date | str | None = None, end: Date | str | None = None, coords: str = "enu") -> DataFrame:
    """East, north and up in metres (whole and fraction added) with their errors, in a date range."""
    if coords == "xyz":
        columns = {c: _number(_field(c)) for c in "xyz"}
    elif coords == "enu":
        both = {"east": ("__east(m)", "_e0(m)"), "north": ("_north(m)", "____n0(m)"), "up": ("____up(m)", "u0(m)")}
        columns = {c: _number(_field(a)) + _number(_field(b)) for c, (a, b) in both.items()}
        columns |= {"sige": _number(_field("sig_e(m)")), "sign": _number(_field("sig_n(m)")), "sigu": _number(_field("sig_u(m)"))}
    else:
        raise ValueError(f"coordinates are enu or xyz, not {coords!r}")
    rows = raw.select("station", compact_date(_field("YYMMMDD")).alias("date"), *[v.alias(k) for k, v in columns.items()])
    return date_range(rows, start, end)


def read_enu(spark: SparkSession, path: str | list[str], start: Date | str | None = None, end: Date | str | None = None, zero_by: str = "mean") -> DataFrame:
    """Clean series of all stations of the files, zeroed per station after the date filter."""
    return zeroed(clean_daily(read_daily(spark, path), start, end), by=zero_by)


def read_lookup(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Grid points with their coordinates; ids filled to six digits."""
    f = F.col("fields")
    return _lines(spark, path).select(padded_grid_point(f.getItem(0)).alias("grid_point"), _number(F.get(f, 1)).alias("longitude"), _number(F.get(f, 2)).alias("latitude"))


def read_grid(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Grid series; the grid point is the file's name up to the first underscore."""
    names = ("decimal_year", "east", "north", "up", "sigma_east", "sigma_north", "sigma_up")
    f = F.col("fields")
    numbers = [_number(F.get(f, k)).alias(c) for k, c in enumerate(names)]
    return _lines(spark, path).select(F.regexp_extract("file", "^([^_]+)_", 1).alias("grid_point"), *numbers, F.get(f, 7).try_cast("int").alias("rapid_flag"))


def gridded(series: DataFrame, lookup: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Grid series with coordinates, date and point geometry."""
    joined = with_lookup(series, lookup)
    return joined.withColumns({"datetime": decimal_year_date(F.col("decimal_year")), "geometry": point_wkb("longitude", "latitude")}).drop(*drop)


def file_dates(names: DataFrame, column: str = "path", pattern: str = r"(\d{8})", form: str = "yyyyMMdd") -> DataFrame:
    """Rows with ref_date and sec_date, the first two dates in the file's name."""
    found = F.regexp_extract_all(F.regexp_extract(column, r"([^/]*)$", 1), F.lit(pattern), F.lit(1))
    return names.withColumns({"ref_date": F.try_to_date(F.get(found, 0), form), "sec_date": F.try_to_date(F.get(found, 1), form)})


def analysis_range(dated: DataFrame) -> tuple[Date, Date]:
    """First and last date over both acquisitions; more than one reference date is an error."""
    row = dated.agg(F.count_distinct("ref_date").alias("n"), F.least(F.min("ref_date"), F.min("sec_date")).alias("a"), F.greatest(F.max("ref_date"), F.max("sec_date")).alias("b")).first()
    if row.n > 1:
        raise ValueError("the rasters have more than one reference date")
    return row.a, row.b


def listed_files(pages: DataFrame, column: str = "html", pattern: str = r"\d{6}_IGS14\.tenv8") -> DataFrame:
    """Distinct file names in listing pages."""
    return pages.select(F.explode(F.regexp_extract_all(column, F.lit(pattern), F.lit(0))).alias("file")).distinct()


def plate_code(text: Column) -> Column:
    """Two letters before ``Plate Fixed``; NULL where there are none."""
    return F.nullif(F.regexp_extract(text, "([A-Z]{2}) Plate Fixed", 1), F.lit(""))
