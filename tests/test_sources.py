"""Readers, sinks, rasters and downloads on small files."""

import json
import struct
import zlib
from datetime import date

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from geodrift.functions import columns as C
from geodrift.operators import raster, series
from geodrift.plans.cli import date_format, main
from geodrift.plans.comparison import compare
from geodrift.sources import fetch, geotiff, sinks, text
from geodrift.streaming import daily

HEAD = "site YYMMMDD yyyy.yyyy __MJD week d reflon _e0(m) __east(m) ____n0(m) _north(m) u0(m) ____up(m) _ant(m) sig_e(m) sig_n(m) sig_u(m)"


def line(site, day, e, n, u):
    return f"{site} {day} 2000.0 51544 1042 6 -105.2 10 {e} 20 {n} 5 {u} 0.0 0.001 0.002 0.003"


def test_catalogue(spark, tmp_path):
    (tmp_path / "llh.out").write_text("P123 36.6 -105.2 2100.0\n\n  ABCD -10.0 359.5 5.0\nXX bad 181 -\n")
    rows = {r.name: r for r in text.read_catalogue(spark, str(tmp_path / "llh.out")).collect()}
    assert rows["ABCD"].lon == -0.5 and rows["P123"].alt == 2100.0 and rows["XX"].lat is None and rows["XX"].lon == -179
    wrap = [r[0] for r in spark.createDataFrame([(x,) for x in (180.0, -180.0, 540.0)], "x double").select(C.wrapped_longitude(F.col("x"))).collect()]
    assert wrap == [180, -180, -180]


def test_scalars(spark):
    days = spark.createDataFrame([("94JAN02",), ("68DEC31",), ("69JAN01",), ("junk",), (None,)], "d string").select(C.compact_date(F.col("d"))).collect()
    assert [r[0] for r in days] == [date(1994, 1, 2), date(2068, 12, 31), date(1969, 1, 1), None, None]
    years = spark.createDataFrame([(2014.5,), (2020.9999,)], "y double").select(C.decimal_year_date(F.col("y"))).collect()
    assert [r[0] for r in years] == [date(2014, 7, 3), date(2020, 12, 31)]
    assert C.SENTINEL_1_WAVELENGTH == 0.055465764662349676
    got = spark.sql("SELECT 2.0D v").select(C.metres(F.col("v"), F.lit("radians")), C.metres(F.col("v"), F.lit("meters")), C.metres(F.col("v"), F.lit(None))).first()
    assert got[0] == pytest.approx(2 * 0.0044138253091923615) and got[1] == got[2] == 2
    assert [r[0] for r in spark.createDataFrame([("7",), ("1234567",)], "s string").select(C.padded_grid_point(F.col("s"))).collect()] == ["000007", "1234567"]


def test_daily_series(spark, tmp_path):
    rows = [line("aaaa", d, e, 1, 2) for d, e in (("00JAN01", 0.5), ("00JAN02", 1.5), ("00JAN03", "nan"))]
    (tmp_path / "aaaa.tenv3").write_text("\n".join([HEAD, *rows]) + "\n")
    (tmp_path / "BBBB.tenv3").write_text("\n".join([HEAD, line("BBBB", "00JAN02", 3, 4, 5)]))
    got = {(r.station, r.date): r for r in text.read_enu(spark, str(tmp_path / "*.tenv3")).collect()}
    assert got["AAAA", date(2000, 1, 1)].east == -0.5 and got["AAAA", date(2000, 1, 3)].east is None and got["BBBB", date(2000, 1, 2)].up == 0
    raw = text.clean_daily(text.read_daily(spark, str(tmp_path / "*.tenv3")), "2000-01-02", "2000-01-02").collect()
    assert sorted((r.station, r.east, r.north, r.sigu) for r in raw) == [("AAAA", 11.5, 21.0, 0.003), ("BBBB", 13.0, 24.0, 0.003)]
    with pytest.raises(ValueError):
        text.clean_daily(text.read_daily(spark, str(tmp_path / "*.tenv3")), coords="abc")
    stream = daily.new_rows(spark, str(tmp_path))
    query = stream.writeStream.format("memory").queryName("days").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("days").where("station = 'AAAA'").count() == 3
    late = daily.latest_days(stream)
    assert late.isStreaming and "window" in late.columns


def test_grid_to_geoparquet(spark, tmp_path):
    data = {"lookup": b"7 -105.5 36.25\n8 10 20\n", "list": b"<a>000007_IGS14.tenv8</a> 000007_IGS14.tenv8 000009_IGS14.tenv8"}

    def fetcher(url):
        return data["lookup"] if url == fetch.LOOKUP_URL else data["list"] if url == fetch.GRID_URL else b"2014.5 1 2 3 0.1 0.2 0.3 0\n2015.0 4 5 6 0.1 0.2 0.3 1\n"

    out = str(tmp_path / "grid.parquet")
    main(["grid", str(tmp_path / "raw"), "--geoparquet-path", out], spark, fetcher)
    rows = spark.read.parquet(out).orderBy("grid_point", "decimal_year").collect()
    assert len(rows) == 4 and rows[0].datetime == date(2014, 7, 3) and rows[2].longitude is None and rows[2].geometry is None
    assert struct.unpack("<BIdd", rows[0].geometry) == (1, 1, -105.5, 36.25) and rows[0].rapid_flag == 0
    part = next((tmp_path / "grid.parquet").glob("*.parquet"))
    assert json.loads(pq.read_schema(part).metadata[b"geo"])["primary_column"] == "geometry"


def tiff(bands, *, deflate=False, tile=None, planar=False, kind="f4", nodata=None, units=None, order="<"):
    """A baseline file of bands × rows × columns, in strips of two rows or in tiles."""
    bands = np.asarray(bands, np.dtype(order + kind))
    n, h, w = bands.shape
    planes = [bands[k : k + 1] for k in range(n)] if planar else [bands]
    blocks = []
    for plane in planes:
        for top in range(0, h, tile or 2):
            for left in range(0, w, tile or w):
                cut = plane[:, top : top + (tile or 2), left : left + (tile or w)]
                if tile:
                    cut = np.pad(cut, ((0, 0), (0, tile - cut.shape[1]), (0, tile - cut.shape[2])))
                raw = np.moveaxis(cut, 0, 2).tobytes()
                blocks.append(zlib.compress(raw) if deflate else raw)
    fields = [(256, "I", [w]), (257, "I", [h]), (258, "H", [bands.itemsize * 8] * n), (259, "H", [8 if deflate else 1]), (277, "H", [n]), (284, "H", [2 if planar else 1]), (339, "H", [{"f": 3, "i": 2, "u": 1}[kind[0]]] * n)]
    fields += [(322, "I", [tile]), (323, "I", [tile]), (324, "I", None), (325, "I", [len(b) for b in blocks])] if tile else [(273, "I", None), (278, "I", [2]), (279, "I", [len(b) for b in blocks])]
    fields += [(33550, "d", [0.5, 0.25, 0]), (33922, "d", [0, 0, 0, -10, 40, 0]), (34735, "H", [1, 1, 0, 1, 2048, 0, 1, 4326])]
    fields += [(42113, "s", nodata)] if nodata is not None else []
    fields += [(42112, "s", f'<GDALMetadata><Item name="UNITS">{units}</Item></GDALMetadata>')] if units else []
    numbers = {"H": 3, "I": 4, "d": 12, "s": 2}
    at = 8
    offsets = []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    extra, entries = b"", []
    start = at + 2 + 12 * len(fields) + 4
    for tag, code, value in sorted(fields, key=lambda f: f[0]):
        value = offsets if value is None else value
        raw = value.encode() + b"\0" if code == "s" else struct.pack(f"{order}{len(value)}{code}", *value)
        count = len(raw) if code == "s" else len(value)
        held = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", start + len(extra))
        extra += raw if len(raw) > 4 else b""
        entries.append(struct.pack(order + "HHI", tag, numbers[code], count) + held)
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + b"".join(blocks) + struct.pack(order + "H", len(fields)) + b"".join(entries) + b"\0" * 4 + extra


@pytest.mark.parametrize("options", [{}, {"deflate": True, "tile": 16}, {"planar": True, "kind": "i2", "order": ">"}, {"tile": 16, "kind": "f8", "planar": True}])
def test_tiff(options):
    bands = np.arange(3 * 5 * 21).reshape(3, 5, 21) % 200
    meta, got = geotiff.read_tiff(tiff(bands, nodata="7", units="radians", **options))
    assert np.array_equal(got, bands) and (meta["x0"], meta["dx"], meta["y0"], meta["dy"]) == (-10, 0.5, 40, -0.25)
    assert meta["nodata"] == 7 and meta["units"] == "radians" and meta["crs"] == "EPSG:4326"
    with pytest.raises(ValueError):
        geotiff.read_tiff(b"GIF89a..")


def test_rasters_and_windows(spark, tmp_path):
    band = np.arange(100 * 70, dtype=float).reshape(1, 100, 70)
    (tmp_path / "20200101_20200113.tif").write_bytes(tiff(band, nodata="5", kind="f8"))
    meta, tiles = geotiff.read_rasters(spark, str(tmp_path / "*.tif"), tile_size=32)
    cells = raster.pixels(meta, tiles, 32)
    got = np.full((100, 70), np.nan)
    for r in cells.collect():
        got[r.row, r.col] = np.nan if r.value is None else r.value
    assert np.isnan(got[0, 5]) and np.nansum(got) == band.sum() - 5
    assert raster.raster_slice(cells, slice(1, 10, 4), 3).count() == 3
    points = spark.createDataFrame([("a", -9.9, 39.9), ("b", 24.9, 15.1), ("c", 99.0, 0.0), ("d", -7.4, 39.9)], "name string, lon double, lat double")
    values = {r.name: r.value for r in raster.sample(points, meta, tiles, tile_size=32).collect()}
    assert values == {"a": 0, "b": band[0, 99, 69], "c": None, "d": None}
    assert {r.name: r.value for r in raster.sample(points, meta, tiles, tile_size=32, keep_nodata=True).collect()}["d"] == 5
    near = raster.window(points, meta, tiles, buffer_pixels=1, tile_size=32, place=F.floor)
    assert {(r.name, r["count"]) for r in near.groupBy("name").count().collect()} == {("a", 4), ("b", 4), ("d", 6)}
    dated = text.file_dates(meta)
    assert text.analysis_range(dated) == (date(2020, 1, 1), date(2020, 1, 13))
    zero = geotiff.read_rasters(spark, str(tmp_path / "*.tif"), nodata=0.0, tile_size=32)
    assert raster.pixels(*zero, 32).where("row = 0 AND col = 0").first().value is None
    assert raster.stack_shape(meta).first().asDict() == {"n_rasters": 1, "height": 100, "width": 70}
    assert raster.with_common_nodata(meta).first().stack_nodata == 5


def test_whole_comparison(spark, tmp_path):
    shape = (1, 40, 40)
    for k in range(1, 5):
        (tmp_path / f"20200101_2020{k + 1:02d}01.tif").write_bytes(tiff(np.full(shape, float(k)), units="radians"))
    (tmp_path / "los.tiff").write_bytes(tiff(np.stack([np.full((40, 40), v) for v in (0.5, 0.25, 0.8)])))
    (tmp_path / "coherence.tiff").write_bytes(tiff(np.full(shape, 0.9)))
    (tmp_path / "llh").write_text("AAAA 35 -5 1\nBBBB 36 -4 1\nFAR 80 80 1\nGONE 35 -6 1\n")
    days = [f"20{m}{d:02d}" for m in ("JAN", "FEB", "MAR", "APR", "MAY") for d in (1, 2)]
    for name in ("AAAA", "BBBB"):
        (tmp_path / f"{name}.tenv3").write_text("\n".join([HEAD, *[line(name, d, k, 2 * k, 0) for k, d in enumerate(days)]]))
    out = compare(
        spark, timeseries_files=str(tmp_path / "2020*.tif"), los_enu_file=str(tmp_path / "los.tiff"), catalogue=str(tmp_path / "llh"), series=str(tmp_path / "*.tenv3"),
        reference_station="AAAA", temporal_coherence_file=str(tmp_path / "coherence.tiff"), output_dir=str(tmp_path / "out"),
    )
    combined = out["combined"].collect()
    assert {r.station for r in combined} == {"AAAA", "BBBB"} and len(combined) == 2 * 9 * 4
    insar = {(r.station, r.date): r.value for r in combined if r.measurement == "los_insar" and r.value is not None}
    assert insar["BBBB", date(2020, 3, 1)] == pytest.approx(2 * 0.0044138253091923615) and len(insar) == 8
    rates = {r.station: r for r in out["rates"].collect()}
    assert rates["AAAA"].num_gps_points == 9 and rates["AAAA"].temporal_coherence == pytest.approx(0.9) and rates["AAAA"].similarity is None and rates["AAAA"].gps_velocity is None
    assert rates["AAAA"].insar_velocity == pytest.approx(rates["AAAA"].insar_velocity_l2, rel=0.1)
    assert [r.name for r in out["missing"].collect()] == ["GONE"] and all(r.relative_gps == 0 for r in out["relative"].collect())
    assert len(list((tmp_path / "out" / "combined.csv").glob("*.csv"))) > 0
    assert date_format("%Y-%m-%d") == (r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd")


def test_fetch(tmp_path):
    seen = []

    def fetcher(url):
        seen.append(url)
        if "bad" in url:
            raise OSError(url)
        return b"x NA Plate Fixed y"

    assert fetch.station_plate("p123", fetcher) == "NA"
    assert fetch.download_series("p123", tmp_path, fetcher=fetcher).name == "P123.tenv3" and len(seen) == 2
    assert fetch.download_series("p123", tmp_path, plate_fixed=True, fetcher=fetcher).name == "P123_NA.tenv3"
    assert fetch.download_series("p123", tmp_path, "xyz", fetcher=fetcher).name == "P123.txyz2"
    with pytest.raises(ValueError):
        fetch.series_url("p", "abc")
    with pytest.raises(ValueError):
        fetch.station_plate("p", lambda url: b"none")
    (tmp_path / "000001_IGS14.tenv8").write_text("kept")
    fetch.download_grid(tmp_path, ["000001_IGS14.tenv8", "000002_IGS14.tenv8"], fetcher=fetcher)
    assert (tmp_path / "000001_IGS14.tenv8").read_text() == "kept"
    with pytest.raises(OSError):
        fetch.download_grid(tmp_path, ["bad"], fetcher=fetcher)
    assert sinks.default_grid_name(date(2024, 5, 6)) == "unr_gridded_20240506.parquet"


def test_series_small(spark):
    df = spark.createDataFrame([("a", date(2020, 1, k), float(k)) for k in range(1, 5)], "station string, date date, value double")
    assert [r.smooth for r in series.moving_average(df, "value", 3).orderBy("date").collect()] == [None, None, 2, 3]
    assert [r.smooth for r in series.moving_average(df, "value", 0).orderBy("date").collect()] == [1, 2, 3, 4]
    assert series.excluded(df.withColumnRenamed("station", "name"), "A").count() == 0
    with pytest.raises(ValueError):
        series.zeroed(df, ("value",), "middle")


def packed_lzw(data):
    """An LZW stream of single bytes: the table is started anew before it grows past nine bits."""
    codes, n = [], 0
    for byte in data:
        if n % 200 == 0:
            codes.append(256)
        codes.append(byte)
        n += 1
    bits = "".join(f"{c:09b}" for c in [*codes, 257])
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))


def test_lzw():
    raw = bytes(range(256)) * 3
    assert geotiff.lzw(packed_lzw(raw)) == raw
    # codes of the published example "7 7 7 8 8 7 7 6 6": 256 7 258 8 8 258 6 6 257
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    bits += "0" * (-len(bits) % 8)
    assert geotiff.lzw(bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_predictors():
    r = np.random.default_rng(2)
    whole = r.integers(0, 60000, (4, 9, 2)).astype("<u2")
    differences = np.diff(whole, axis=1, prepend=np.zeros((4, 1, 2), "<u2")).astype("<u2")
    assert np.array_equal(geotiff._unpredicted(differences.tobytes(), np.dtype("<u2"), 2, 9, 2), whole)
    floats = r.normal(size=(4, 9, 1)).astype("<f4")
    planes = floats.astype(">f4").view(np.uint8).reshape(4, 9, 4).transpose(0, 2, 1).reshape(4, 36)
    coded = np.diff(planes, axis=1, prepend=np.zeros((4, 1), np.uint8)).astype(np.uint8)
    assert np.array_equal(geotiff._unpredicted(coded.tobytes(), np.dtype("<f4"), 3, 9, 1), floats)


def test_big_tiff():
    fields = [(256, 4, [3]), (257, 4, [2]), (258, 3, [8]), (259, 3, [1]), (273, 16, [16 + 8 + 20 * 7 + 8]), (277, 3, [1]), (279, 16, [6])]
    code = {3: "H", 4: "I", 16: "Q"}
    entries = b"".join(struct.pack("<HHQ", tag, kind, len(v)) + struct.pack(f"<{len(v)}{code[kind]}", *v).ljust(8, b"\0") for tag, kind, v in fields)
    data = b"II" + struct.pack("<HHHQ", 43, 8, 0, 16) + struct.pack("<Q", len(fields)) + entries + struct.pack("<Q", 0) + bytes(range(6))
    meta, bands = geotiff.read_tiff(data)
    assert bands.tolist() == [[[0, 1, 2], [3, 4, 5]]] and (meta["height"], meta["width"]) == (2, 3)


def test_each_raster_in_its_own_system(spark):
    from geodrift.functions.geodesy import projected

    points = spark.createDataFrame([("a", 3.1, 0.55), ("b", 2.9, 0.45)], "name string, lon double, lat double")
    utm = {r.name: r.xy for r in points.select("name", projected(F.col("lon"), F.col("lat"), "EPSG:32631").alias("xy")).collect()}
    left, top = utm["b"].x - 100, utm["a"].y + 100
    meta = spark.createDataFrame(
        [("degrees", "p", 1, 2.0, 0.5, 1.0, -0.5, 4, 4, None, None, "EPSG:4326"), ("metres", "q", 1, left, 10000.0, top, -10000.0, 4, 4, None, None, "EPSG:32631")],
        "raster_id string, path string, band int, x0 double, dx double, y0 double, dy double, height int, width int, nodata double, units string, crs string",
    )
    tiles = spark.createDataFrame([(k, 1, 0, 0, [float(x) for x in range(16)]) for k in ("degrees", "metres")], "raster_id string, band int, tile_row int, tile_col int, values array<double>")
    got = {(r.name, r.raster_id): r.value for r in raster.sample(points, meta, tiles).collect()}
    place = {n: int((xy.y - top) / -10000) * 4 + int((xy.x - left) / 10000) for n, xy in utm.items()}
    assert got == {("a", "degrees"): 2.0, ("b", "degrees"): 5.0, ("a", "metres"): place["a"], ("b", "metres"): place["b"]}


def test_bounds_by_cells(spark, monkeypatch):
    from geodrift.operators import spatial

    meta = spark.createDataFrame([(f"r{k}", k * 1.5, 0.5, 10.0 + k, -0.25, 8, 6 + k) for k in range(12)], "raster_id string, x0 double, dx double, y0 double, dy double, height int, width int")
    points = spark.createDataFrame([(f"p{i}", (i * 37 % 200) / 10 - 1, 7 + (i * 53 % 150) / 10) for i in range(200)], "name string, lon double, lat double")
    want = sorted(map(tuple, spatial.in_bounds(points, meta).collect()))
    monkeypatch.setattr(spatial, "BROADCAST_ROWS", 3)
    assert sorted(map(tuple, spatial.in_bounds(points, meta).collect())) == want and len(want) > 50


def test_comparison_downloads_what_it_lacks(spark, tmp_path):
    for k in range(1, 4):
        (tmp_path / f"20200101_2020{k + 1:02d}01.tif").write_bytes(tiff(np.full((1, 40, 40), float(k)), units="radians"))
    (tmp_path / "los.tiff").write_bytes(tiff(np.stack([np.full((40, 40), v) for v in (0.5, 0.25, 0.8)])))
    days = [f"20{m}{d:02d}" for m in ("JAN", "FEB", "MAR") for d in (1, 2)]

    def fetcher(url):
        if url == fetch.CATALOGUE_URL:
            return b"AAAA 35 -5 1\nBBBB 36 -4 1\nGONE 35 -6 1\n"
        name = url.rsplit("/", 1)[1][:4]
        if name == "GONE":
            raise OSError("not found")
        return "\n".join([HEAD, *[line(name, d, k, 2 * k, 0) for k, d in enumerate(days)]]).encode()

    with pytest.warns(UserWarning, match="GONE is skipped"):
        out = compare(spark, timeseries_files=str(tmp_path / "2020*.tif"), los_enu_file=str(tmp_path / "los.tiff"), cache=str(tmp_path / "cache"), fetcher=fetcher, reference_station="AAAA")
    assert {r.station for r in out["combined"].collect()} == {"AAAA", "BBBB"}
    assert [r.name for r in out["failed"].collect()] == ["GONE"] == [r.name for r in out["missing"].collect()] and out["without_overlap"].count() == 0


def test_registered_functions_and_views(spark):
    from geodrift.functions.registered import create_views, register_functions

    register_functions(spark)
    t = [0, 365, 400, 765, 1200]
    y = [0.0, 0.010, 0.013, 0.024, 0.030]
    series_table = spark.createDataFrame([("a", [x / 365.25 for x in t], y), ("b", None, None), ("c", [0.0], [1.0])], "station string, years array<double>, series array<double>")
    create_views(station_series=series_table)
    rows = {r.station: r for r in spark.sql("SELECT station, midas(years, series) AS m, tsia(years, series) AS s, robust_fit(years, series) AS l FROM station_series").collect()}
    assert rows["a"].m.velocity == pytest.approx(0.011007534246575341) and rows["a"].s.slope == pytest.approx(2.8767123287671234e-05 * 365.25)
    assert rows["a"].l.slope is not None and rows["b"].m.velocity is None and rows["c"].l.slope is None
