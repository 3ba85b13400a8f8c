"""Station series, rasters and frames made of the star-schema test tables, for the driver's queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, date, value): a series per supplier, one mean value a day."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("station"), F.col("l_shipdate").cast("date").alias("date"), "l_quantity")
    return rows.groupBy("station", "date").agg(F.avg("l_quantity").alias("value"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, date, value): a series per region, one mean value a day."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("date"), "l_quantity")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    joined = lines.join(supplier, lines.l_suppkey == supplier.s_suppkey).join(nation, supplier.s_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    return joined.groupBy(F.col("r_name").alias("station"), "date").agg(F.avg("l_quantity").alias("value"))


def tidy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tidy rows per supplier: both instruments by line number, quality from two other columns."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("station"), F.col("l_shipdate").cast("date").alias("date"), "l_linenumber", "l_quantity", "l_discount", "l_tax")
    kind = F.when(F.col("l_linenumber") % 2 == 1, "los_gps").otherwise("los_insar")
    values = lines.select("station", "date", kind.alias("measurement"), F.col("l_quantity").alias("value"))
    quality = lines.where("l_linenumber = 2").select("station", "date", F.expr("stack(2, 'similarity', l_discount, 'temporal_coherence', l_tax) AS (measurement, value)"))
    return values.unionByName(quality)


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, lon, lat): a station per supplier."""
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(key.cast("string").alias("name"), (key * 37 % 640 / 10.0 - 0.05).alias("lon"), (key * 91 % 5000 / 10.0 - 0.05).alias("lat"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_id, ring, is_north_america): a skewed quadrilateral per nation."""
    x, y = F.col("n_nationkey") % 5 * 12.0, F.floor(F.col("n_nationkey") / 5) * 90.0
    corners = [(x, y), (x + 13.0, y + 20.0), (x + 11.0, y + 95.0), (x - 2.0, y + 70.0)]
    ring = F.array(*[F.struct(a.cast("double").alias("x"), b.cast("double").alias("y")) for a, b in corners])
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("frame_id"), ring.alias("ring"), (F.col("n_regionkey") <= 2).alias("is_north_america"))


def raster(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(meta, tiles): a raster per label, row vec_id, column the place in the embedding, pixels of one unit.

    A tile is one row of 64 pixels here; rows of other labels are missing (NULL).
    """
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("raster_id"), F.col("vec_id").cast("int").alias("tile_row"), F.col("embedding").cast("array<double>").alias("values"))
    tiles = rows.select("raster_id", F.lit(1).alias("band"), "tile_row", F.lit(0).alias("tile_col"), "values")
    height = rows.agg(F.max("tile_row") + 1).first()[0]
    fixed = {"x0": F.lit(0.0), "dx": F.lit(1.0), "y0": F.lit(0.0), "dy": F.lit(1.0), "height": F.lit(height), "width": F.lit(64), "nodata": F.lit(None).cast("double"), "units": F.lit("radians"), "crs": F.lit("EPSG:4326")}
    meta = rows.select("raster_id").distinct().select("raster_id", F.concat(F.lit("20200101_2021010"), F.col("raster_id"), F.lit(".tif")).alias("path"), F.lit(1).alias("band"), *[v.alias(k) for k, v in fixed.items()])
    return meta, tiles
