"""Rasters as tiles: pixels are found by tile number and offset, never by scanning.

``meta`` has a row per raster and band, ``tiles`` a row per tile with its values
in row order.  Tiles have ``tile_size`` pixels, (rows, columns) or one number for
both; those at the right and lower edges are cut to the raster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geodrift.functions.columns import metres
from geodrift.functions.geodesy import projected

TILE_SIZE = 256
#: Points or windows that may be broadcast to the tiles.
BROADCAST_ROWS = 100_000


def masked(value: Column, nodata: Column) -> Column:
    """NULL for the raster's nodata value; for NaN as nodata, for every value that is no finite number."""
    invalid = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(F.when(nodata.isNull(), F.isnan(value)).when(F.isnan(nodata), invalid).otherwise((value == nodata) | F.isnan(value)), F.lit(None)).otherwise(value)


TileSize = int | tuple[int, int]


def _shape(tile_size: TileSize) -> tuple[int, int]:
    return (tile_size, tile_size) if isinstance(tile_size, int) else tile_size


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


#: Each raster in the system that its meta row names.
OWN_CRS = None


def pixel_of(points: DataFrame, meta: DataFrame, lon: str = "lon", lat: str = "lat", crs: str | None = OWN_CRS, place: Callable[[Column], Column] = F.floor) -> DataFrame:
    """Points with each raster's meta columns and the pixel (row, col) they fall on.

    Each raster is met in its own reference system, the ``crs`` of its meta row;
    without that column, or with ``crs`` given, in one for all.
    """
    own = crs is None and "crs" in meta.columns
    systems = [r.crs for r in meta.select("crs").distinct().collect()] if own else [crs or "EPSG:4326"]  # a handful of codes
    placed = points.withColumn("_all", F.array(*[projected(F.col(lon), F.col(lat), c or "EPSG:4326") for c in systems]))
    both = placed.crossJoin(_small(meta))  # meta has one row per raster and band, points one per station: the result is wanted whole
    number = F.array_position(F.array(*[F.coalesce(F.lit(c), F.lit("")) for c in systems]), F.coalesce("crs", F.lit(""))).cast("int") if own else F.lit(1)
    both = both.withColumn("_xy", F.try_element_at("_all", number)).drop("_all")
    return both.withColumns({"col": place((F.col("_xy.x") - F.col("x0")) / F.col("dx")).cast("int"), "row": place((F.col("_xy.y") - F.col("y0")) / F.col("dy")).cast("int")}).drop("_xy")


def sample(points: DataFrame, meta: DataFrame, tiles: DataFrame, *, key: str = "name", lon: str = "lon", lat: str = "lat", crs: str | None = OWN_CRS, tile_size: TileSize = TILE_SIZE, keep_nodata: bool = False) -> DataFrame:
    """(key, raster_id, band, value) of the pixel under each point, NULL outside and for nodata."""
    th, tw = _shape(tile_size)
    at = pixel_of(points, meta, lon, lat, crs)
    inside = F.col("row").between(0, F.col("height") - 1) & F.col("col").between(0, F.col("width") - 1)
    wanted = at.withColumns({"tile_row": F.when(inside, F.floor(F.col("row") / th)).cast("int"), "tile_col": F.when(inside, F.floor(F.col("col") / tw)).cast("int")})
    joined = wanted.join(tiles, ["raster_id", "band", "tile_row", "tile_col"], "left")
    wide = F.least(F.lit(tw), F.col("width") - F.col("tile_col") * tw)
    value = F.try_element_at("values", (F.col("row") % th) * wide + F.col("col") % tw + 1)
    return joined.select(key, "raster_id", "band", (value if keep_nodata else masked(value, F.col("nodata"))).alias("value"))


def pixels(meta: DataFrame, tiles: DataFrame, tile_size: TileSize = TILE_SIZE) -> DataFrame:
    """(raster_id, band, row, col, value) of every pixel, nodata as NULL."""
    th, tw = _shape(tile_size)
    joined = tiles.join(_small(meta.select("raster_id", "band", "width", "nodata")), ["raster_id", "band"])
    wide = F.least(F.lit(tw), F.col("width") - F.col("tile_col") * tw)
    opened = joined.select("raster_id", "band", "tile_row", "tile_col", "nodata", wide.alias("wide"), F.posexplode("values").alias("pos", "v"))
    return opened.select(
        "raster_id", "band", (F.col("tile_row") * th + F.floor(F.col("pos") / F.col("wide"))).cast("int").alias("row"),
        (F.col("tile_col") * tw + F.col("pos") % F.col("wide")).cast("int").alias("col"), masked(F.col("v"), F.col("nodata")).alias("value"),
    )


def raster_slice(cells: DataFrame, rows: slice | int | None = None, cols: slice | int | None = None, bands: list[int] | None = None) -> DataFrame:
    """Cells of a numpy-style slice: start, stop and step of rows and columns, and bands."""
    for name, part in (("row", rows), ("col", cols)):
        if isinstance(part, int):
            cells = cells.where(F.col(name) == part)
        elif part is not None:
            start, step = part.start or 0, part.step or 1
            if start < 0 or step < 0 or (part.stop is not None and part.stop < 0):
                raise ValueError("rows and columns count from the start")
            cells = cells.where((F.col(name) >= start) & ((F.col(name) - start) % step == 0))
            cells = cells if part.stop is None else cells.where(F.col(name) < part.stop)
    return cells if bands is None else cells.where(F.col("band").isin(bands))


def window(points: DataFrame, meta: DataFrame, tiles: DataFrame, *, buffer_pixels: int = 0, key: str = "name", lon: str = "lon", lat: str = "lat", crs: str | None = OWN_CRS, tile_size: TileSize = TILE_SIZE, place: Callable[[Column], Column] = F.rint) -> DataFrame:
    """(key, raster_id, band, row, col, value) of the pixels about each point, clipped to the raster."""
    th, tw = _shape(tile_size)
    at = pixel_of(points, meta, lon, lat, crs, place)
    b = buffer_pixels
    near = at.withColumn("_r", F.explode(F.sequence(F.col("row") - b, F.col("row") + b))).withColumn("_c", F.explode(F.sequence(F.col("col") - b, F.col("col") + b)))
    near = near.where(F.col("_r").between(0, F.col("height") - 1) & F.col("_c").between(0, F.col("width") - 1))
    near = near.withColumns({"tile_row": F.floor(F.col("_r") / th).cast("int"), "tile_col": F.floor(F.col("_c") / tw).cast("int")})
    joined = near.join(tiles, ["raster_id", "band", "tile_row", "tile_col"])
    wide = F.least(F.lit(tw), F.col("width") - F.col("tile_col") * tw)
    value = F.try_element_at("values", (F.col("_r") % th) * wide + F.col("_c") % tw + 1)
    return joined.select(key, "raster_id", "band", F.col("_r").alias("row"), F.col("_c").alias("col"), masked(value, F.col("nodata")).alias("value"))


def insar_samples(points: DataFrame, meta: DataFrame, tiles: DataFrame, dates: DataFrame, *, quality: dict[str, tuple[DataFrame, DataFrame]] | None = None, crs: str | None = OWN_CRS, tile_size: TileSize = TILE_SIZE) -> DataFrame:
    """(station, date, los_insar, similarity, temporal_coherence): displacements in metres, quality where given.

    ``dates`` has (raster_id, sec_date).  The units of the first raster by id hold for all.
    """
    units = meta.orderBy("raster_id").select("units").first()
    first_units = F.lit(units.units if units else None)
    moved = sample(points, meta, tiles, crs=crs, tile_size=tile_size).join(_small(dates), "raster_id")
    out = moved.select(F.col("name").alias("station"), F.col("sec_date").alias("date"), metres(F.col("value"), first_units).alias("los_insar"))
    for name in ("similarity", "temporal_coherence"):
        if quality and name in quality:
            found = sample(points, *quality[name], crs=crs, tile_size=tile_size).select(F.col("name").alias("station"), F.col("value").alias(name))
            out = out.join(found, "station", "left")
        else:
            out = out.withColumn(name, F.lit(None).cast("double"))
    return out


def los_vectors(points: DataFrame, meta: DataFrame, tiles: DataFrame, *, crs: str | None = OWN_CRS, tile_size: TileSize = TILE_SIZE) -> DataFrame:
    """(station, e, n, u) from a raster of three bands."""
    values = sample(points, meta, tiles, crs=crs, tile_size=tile_size)
    bands = {c: F.max(F.when(F.col("band") == k, F.col("value"))).alias(c) for k, c in enumerate("enu", 1)}
    return values.groupBy(F.col("name").alias("station")).agg(*bands.values())


def stack_shape(meta: DataFrame) -> DataFrame:
    """(n_rasters, height, width) of a stack, singleton dimensions kept."""
    return meta.agg(F.countDistinct("raster_id", "band").alias("n_rasters"), F.max("height").alias("height"), F.max("width").alias("width"))


def with_common_nodata(meta: DataFrame) -> DataFrame:
    """Meta rows with the stack's nodata value in ``stack_nodata``, NULL unless all agree."""
    agreed = meta.agg(F.when(F.countDistinct("nodata") == 1, F.max("nodata")).alias("stack_nodata"))
    return meta.crossJoin(F.broadcast(agreed))  # one row by construction
