"""The comparison of GPS and InSAR, and the gridded series, as whole plans."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from geodrift.operators.raster import insar_samples, los_vectors, sample
from geodrift.operators.rates import calculate_rates
from geodrift.operators.reshape import missing_stations, relative_to, stations_without_overlap, tidy, with_insar
from geodrift.operators.series import excluded, line_of_sight, unseen_stations
from geodrift.operators.spatial import in_bounds, with_valid_pixel
from geodrift.sources import fetch
from geodrift.sources.geotiff import read_rasters, single_band
from geodrift.sources.sinks import write_csv, write_geoparquet
from geodrift.sources.text import analysis_range, file_dates, gridded, read_catalogue, read_enu, read_grid, read_lookup


def compare(
    spark: SparkSession, *, timeseries_files: str | list[str], los_enu_file: str, catalogue: str | None = None, series: str | list[str] | None = None, cache: str | None = None, fetcher: fetch.Fetcher = fetch.http, output_dir: str | None = None, date_pattern: str = r"(\d{8})", date_format: str = "yyyyMMdd",
    reference_station: str | None = None, temporal_coherence_file: str | None = None, similarity_file: str | None = None, exclude_stations: str | list[str] | None = None,
) -> dict[str, DataFrame]:
    """Combined (tidy) rows, rates, skipped stations and, with a reference station, relative rows; CSV files if ``output_dir`` is given.

    Without ``catalogue`` or ``series`` the catalogue and the series of the
    selected stations come from the data service into ``cache``, which driver and
    executors must share; a series that cannot be had is skipped with a warning
    and listed in ``failed``.  Every raster is sampled in its own reference system.
    """
    folder = Path(cache) if cache else fetch.cache_dir()
    if catalogue is None:
        catalogue = str(folder / "llh.out")
        if not Path(catalogue).exists():
            fetch.download_catalogue(Path(catalogue), fetcher)
    meta, tiles = single_band(*read_rasters(spark, timeseries_files))
    dates = file_dates(meta.select("raster_id", "path"))
    if (date_pattern, date_format) != (r"(\d{8})", "yyyyMMdd"):
        dates = file_dates(meta.select("raster_id", "path"), pattern=date_pattern, form=date_format)
    start, end = analysis_range(dates)
    row = meta.orderBy("raster_id").select("path", "crs").first()
    # only the first raster's pixels tell which stations have any
    first, first_tiles = single_band(*read_rasters(spark, row.path)) if row else (meta, tiles)
    bounded = excluded(in_bounds(read_catalogue(spark, catalogue), first, (row and row.crs) or "EPSG:4326").drop("raster_id"), exclude_stations)
    valid = with_valid_pixel(sample(bounded, first, first_tiles)).select("name")
    stations = bounded.join(valid, "name", "left_semi")
    failed: list[str] = []
    if series is None:
        names = [r.name for r in stations.select("name").orderBy("name").collect()]  # stations on one raster
        series, failed = fetch.download_all_series(names, folder / "series", fetcher=fetcher)
        if not series:
            raise RuntimeError("no series of any selected station could be had")
    loaded = read_enu(spark, series, start, end)
    vectors = los_vectors(stations, *read_rasters(spark, los_enu_file))
    gps = line_of_sight(loaded, vectors)
    quality = {k: single_band(*read_rasters(spark, p)) for k, p in (("temporal_coherence", temporal_coherence_file), ("similarity", similarity_file)) if p}
    insar = insar_samples(stations, meta, tiles, dates.select("raster_id", "sec_date"), quality=quality)
    merged = with_insar(gps, insar)
    combined = tidy(merged)
    out = {"combined": combined, "rates": calculate_rates(combined), "missing": missing_stations(stations, loaded), "unseen": unseen_stations(vectors), "failed": spark.createDataFrame([(x,) for x in failed], "name string")}
    if reference_station:
        out["without_overlap"] = stations_without_overlap(merged, reference_station=reference_station)
        out["relative"] = relative_to(merged, reference_station=reference_station)
    if output_dir:
        for name in ("combined", "rates", "relative"):
            if name in out:
                write_csv(out[name], f"{output_dir}/{name}.csv")
    return out


def grid_to_geoparquet(spark: SparkSession, *, lookup: str, series: str | list[str], output: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """Grid series with coordinates, dates and points, written as GeoParquet."""
    table = gridded(read_grid(spark, series), read_lookup(spark, lookup), drop)
    if table.isEmpty():
        raise RuntimeError(f"no grid series in {series}")
    write_geoparquet(table, output)
    return spark.read.parquet(output)
