"""Stations against raster footprints and polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geodrift.functions.geodesy import geodesic_distance, projected

#: Rows of polygons (or raster footprints) that may be broadcast; more are met by grid cells.
BROADCAST_ROWS = 10_000


def in_bounds(points: DataFrame, meta: DataFrame, crs: str = "EPSG:4326", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Points strictly inside the footprint of each raster of ``meta``, with its raster_id.

    Points are projected to ``crs`` for the test; their longitude and latitude stay.
    The footprints are one row a raster and are counted before they are broadcast.
    """
    x_end, y_end = F.col("x0") + F.col("dx") * F.col("width"), F.col("y0") + F.col("dy") * F.col("height")
    boxes = meta.select("raster_id", F.least("x0", x_end).alias("left"), F.greatest("x0", x_end).alias("right"), F.least("y0", y_end).alias("bottom"), F.greatest("y0", y_end).alias("top"))
    placed = points.withColumn("_xy", projected(F.col(lon), F.col(lat), crs))
    inside = (F.col("_xy.x") > F.col("left")) & (F.col("_xy.x") < F.col("right")) & (F.col("_xy.y") > F.col("bottom")) & (F.col("_xy.y") < F.col("top"))
    if boxes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return placed.join(F.broadcast(boxes), inside).select(*points.columns, "raster_id")
    # cells of the footprints' median size: a point meets the footprints of its own cell
    edge = boxes.agg(F.median(F.col("right") - F.col("left")).alias("w"), F.median(F.col("top") - F.col("bottom")).alias("h")).first()

    def cell(value: str | Column, side: float) -> Column:
        return F.floor((F.col(value) if isinstance(value, str) else value) / F.lit(max(side, 1e-9)))

    spread = boxes.withColumn("_cx", F.explode(F.sequence(cell("left", edge.w), cell("right", edge.w)))).withColumn("_cy", F.explode(F.sequence(cell("bottom", edge.h), cell("top", edge.h))))
    met = placed.withColumns({"_cx": cell(F.col("_xy.x"), edge.w), "_cy": cell(F.col("_xy.y"), edge.h)})
    return met.join(spread, ["_cx", "_cy"]).where(inside).select(*points.columns, "raster_id")


def close_to(value: Column, target: float, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    return F.abs(value - F.lit(target)) <= F.lit(absolute + relative * abs(target))


def with_valid_pixel(sampled: DataFrame, column: str = "value", bad_values: tuple[float, ...] = (0.0,)) -> DataFrame:
    """Samples that exist, are numbers and are near none of the bad values."""
    keep = F.col(column).isNotNull() & ~F.isnan(column)
    for bad in bad_values:
        keep = keep & ~close_to(F.col(column), bad)
    return sampled.where(keep)


def ring_contains(ring: Column, x: Column, y: Column) -> Column:
    """Whether a closed or open ring of struct(x, y) holds a point, by crossings of a ray to the right."""
    n = F.size(ring)

    def crosses(a: Column, b: Column) -> Column:
        # the two ends lie on different sides of the ray, so they differ in y and the division is safe
        reach = F.when((a["y"] > y) != (b["y"] > y), (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])
        return F.coalesce((x < reach).cast("int"), F.lit(0))

    edges = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    count = F.aggregate(edges, F.lit(0), lambda acc, i: acc + crosses(F.try_element_at(ring, i), F.try_element_at(ring, F.when(i == n, 1).otherwise(i + 1))))
    return F.coalesce((n >= 3) & (count % 2 == 1), F.lit(False))


def frame_overlap(points: DataFrame, frames: DataFrame, cell_degrees: float = 1.0, x: str = "lon", y: str = "lat") -> DataFrame:
    """(frame_id, name, x, y) of points inside the North American frames.

    Frames are spread over the grid cells of their bounding boxes, so points meet
    only the frames of their own cell; the bounding box and then the ring decide.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    boxed = frames.where("is_north_america").select("frame_id", "ring", F.array_min(xs).alias("x_from"), F.array_max(xs).alias("x_to"), F.array_min(ys).alias("y_from"), F.array_max(ys).alias("y_to"))

    def cell(value: str | Column) -> Column:
        return F.floor((F.col(value) if isinstance(value, str) else value) / F.lit(cell_degrees))

    spread = boxed.withColumn("_cx", F.explode(F.sequence(cell("x_from"), cell("x_to")))).withColumn("_cy", F.explode(F.sequence(cell("y_from"), cell("y_to"))))
    placed = points.select("name", F.col(x).alias("x"), F.col(y).alias("y"), cell(F.col(x)).alias("_cx"), cell(F.col(y)).alias("_cy"))
    inside = F.col("x").between(F.col("x_from"), F.col("x_to")) & F.col("y").between(F.col("y_from"), F.col("y_to")) & ring_contains(F.col("ring"), F.col("x"), F.col("y"))
    return placed.join(spread, ["_cx", "_cy"]).where(inside).select("frame_id", "name", "x", "y")


def station_pairs_distance(pairs: DataFrame, stations: DataFrame) -> DataFrame:
    """(name1, name2, metres) on the ellipsoid for named pairs."""
    places = stations.select("name", "lon", "lat")
    one = pairs.join(places.toDF("name1", "lon1", "lat1"), "name1")
    both = one.join(places.toDF("name2", "lon2", "lat2"), "name2")
    return both.select("name1", "name2", geodesic_distance("lon1", "lat1", "lon2", "lat2").alias("metres"))


def station_lon_lat(stations: DataFrame, name: str) -> tuple[float, float]:
    """Longitude and latitude of a station; an unknown name raises with the closest ones."""
    import difflib

    found = stations.where(F.col("name") == name.upper()).select("lon", "lat").first()
    if found is None:
        # a catalogue has one short row a station; names are the only column collected
        close = difflib.get_close_matches(name.upper(), [r.name for r in stations.select("name").collect()], n=5)
        raise ValueError(f"no station {name!r}; closest: {', '.join(close) or 'none'}")
    return found.lon, found.lat
