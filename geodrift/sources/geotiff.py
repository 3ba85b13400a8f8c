"""GeoTIFF files as raster tables.

Files are read by Spark as binaries and cut into tiles on the executors, one task
per group of files; ``meta`` reads directories alone.  Supported: classic and big
files, the first image of a file, strips or tiles, chunky or planar samples, no
compression, deflate or LZW, horizontal and float predictors, integers and floats.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geodrift.operators.raster import TILE_SIZE
from geodrift.schemas import RASTER_META, RASTER_TILES

#: Fixed TIFF values: field types by number, and tag numbers.
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, FORMAT = 284, 317, 322, 323, 324, 325, 339
PIXEL_SCALE, TIE_POINT, GEO_KEYS, GDAL_METADATA, GDAL_NODATA = 33550, 33922, 34735, 42112, 42113
KINDS = {1: "u", 2: "i", 3: "f"}


def tags_of(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the fields of the first directory."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    magic = struct.unpack(order + "H", data[2:4])[0] if order else None
    if magic not in (42, 43):
        raise ValueError("not a TIFF file")
    # a big file has wider offsets and counts, all else is alike
    head, count_of, offset, width = ("H", "HHI", "I", 4) if magic == 42 else ("Q", "HHQ", "Q", 8)
    first = struct.calcsize("=" + head)
    size = struct.calcsize("=" + count_of) + width
    at = struct.unpack_from(order + offset, data, 4 if magic == 42 else 8)[0]
    fields = {}
    for k in range(struct.unpack_from(order + head, data, at)[0]):
        place = at + first + size * k
        tag, kind, count = struct.unpack_from(order + count_of, data, place)
        if kind not in TYPES:
            continue
        held = struct.calcsize("=" + TYPES[kind]) * count
        start = place + size - width
        if held > width:
            start = struct.unpack_from(order + offset, data, start)[0]
        raw = data[start : start + held]
        fields[tag] = (raw.rstrip(b"\0").decode("latin-1"),) if kind == 2 else struct.unpack(f"{order}{count}{TYPES[kind]}", raw)
    return order, fields


def meta_of(fields: dict[int, tuple]) -> dict:
    """Place, shape, nodata, units and reference system by the directory alone."""
    scale, tie = fields.get(PIXEL_SCALE, (1.0, 1.0)), fields.get(TIE_POINT, (0, 0, 0, 0.0, 0.0, 0.0))
    keys = fields.get(GEO_KEYS, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    units = re.search(r'role="unittype"[^>]*>([^<]*)<|name="UNITS"[^>]*>([^<]*)<', fields.get(GDAL_METADATA, ("",))[0] or "", re.I)
    nodata = fields.get(GDAL_NODATA, ("",))[0]
    return {
        "x0": tie[3] - tie[0] * scale[0], "dx": scale[0], "y0": tie[4] + tie[1] * scale[1], "dy": -scale[1], "height": fields[HEIGHT][0], "width": fields[WIDTH][0],
        "nodata": float(nodata) if nodata not in (None, "") else None, "units": (units[1] or units[2]) if units else None, "crs": f"EPSG:{codes.get(3072) or codes.get(2048) or 4326}",
    }


def lzw(data: bytes) -> bytes:
    """Bytes of an LZW stream: codes of 9 to 12 bits from the highest bit on, 256 starts anew and 257 ends."""
    out, table, last, bits = [], [], b"", 9
    value = held = 0
    for byte in data:
        value, held = value << 8 | byte, held + 8
        if held < bits:
            continue
        held -= bits
        code, value = value >> held, value & ((1 << held) - 1)
        if code == 257:
            break
        if code == 256:
            table, last, bits = [bytes([k]) for k in range(256)] + [b"", b""], b"", 9
            continue
        word = table[code] if code < len(table) else last + last[:1]
        if last:
            table.append(last + word[:1])
        out.append(word)
        last = word
        bits = max(9, min(12, (len(table) + 1).bit_length()))
    return b"".join(out)


def _unpredicted(raw: bytes, kind: np.dtype, predictor: int, width: int, samples: int) -> np.ndarray:
    """Samples of a block, rows × width × samples, without its predictor."""
    if predictor == 3:  # bytes of a row by significance, highest first, as differences
        lines = np.frombuffer(raw, np.uint8)
        lines = lines[: len(lines) // (width * samples * kind.itemsize) * width * samples * kind.itemsize].reshape(-1, width * kind.itemsize, samples)
        planes = np.cumsum(lines, axis=1, dtype=np.uint8).reshape(len(lines), kind.itemsize, width * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(-1, width, samples)
    cells = np.frombuffer(raw, kind)
    cells = cells[: len(cells) // (width * samples) * width * samples].reshape(-1, width, samples)
    if predictor == 2:
        return np.cumsum(cells.astype(kind.newbyteorder("=")), axis=1, dtype=kind.newbyteorder("="))
    return cells


def read_tiff(data: bytes) -> tuple[dict, np.ndarray]:
    """(meta, array of bands × rows × columns as doubles)."""
    order, f = tags_of(data)

    def one(tag: int, default=None):
        return f[tag][0] if tag in f else default

    width, height, n = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    unpack = {1: bytes, 8: zlib.decompress, 32946: zlib.decompress, 5: lzw}.get(one(COMPRESSION, 1))
    if unpack is None or one(PREDICTOR, 1) not in (1, 2, 3):
        raise ValueError("only uncompressed, deflate and LZW files are read")
    kind = np.dtype(f"{order}{KINDS[one(FORMAT, 1)]}{one(BITS, 8) // 8}")
    tiled = TILE_OFFSETS in f
    offsets, counts = (f[TILE_OFFSETS], f[TILE_COUNTS]) if tiled else (f[STRIP_OFFSETS], f[STRIP_COUNTS])
    block_w, block_h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    planar = one(PLANAR, 1) == 2 and n > 1
    across, down = -(-width // block_w), -(-height // block_h)
    out = np.zeros((n, height, width))
    for k, (offset, count) in enumerate(zip(offsets, counts)):
        band, place = divmod(k, across * down) if planar else (None, k)
        top, left = place // across * block_h, place % across * block_w
        block = _unpredicted(unpack(data[offset : offset + count]), kind, one(PREDICTOR, 1), block_w, 1 if planar else n).astype(float)
        part = block[: min(block_h, height - top), : width - left]
        if planar:
            out[band, top : top + part.shape[0], left : left + part.shape[1]] = part[:, :, 0]
        else:
            out[:, top : top + part.shape[0], left : left + part.shape[1]] = np.moveaxis(part, 2, 0)
    return meta_of(f), out


def _name(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def read_rasters(spark: SparkSession, path: str | list[str], *, nodata: float | None = None, tile_size: int = TILE_SIZE) -> tuple[DataFrame, DataFrame]:
    """(meta, tiles) of all files; an explicit ``nodata``, 0 included, replaces the files' own."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def meta(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"]):
                _, fields = tags_of(bytes(content))
                found = meta_of(fields)
                found["nodata"] = found["nodata"] if nodata is None else nodata
                rows += [{"raster_id": _name(name), "path": name, "band": b + 1} | found for b in range(fields.get(SAMPLES, (1,))[0])]
            yield pd.DataFrame(rows, columns=["raster_id", "path", "band", "x0", "dx", "y0", "dy", "height", "width", "nodata", "units", "crs"])

    def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                _, bands = read_tiff(bytes(content))
                for b, band in enumerate(bands):
                    for i in range(0, band.shape[0], tile_size):
                        cut = [band[i : i + tile_size, j : j + tile_size].ravel() for j in range(0, band.shape[1], tile_size)]
                        yield pd.DataFrame({"raster_id": _name(name), "band": b + 1, "tile_row": i // tile_size, "tile_col": range(len(cut)), "values": cut})

    return files.mapInPandas(meta, RASTER_META), files.mapInPandas(tiles, RASTER_TILES)


def single_band(meta: DataFrame, tiles: DataFrame, band: int | dict[str, int] = 1) -> tuple[DataFrame, DataFrame]:
    """One band of each raster: the same for all, or one per raster_id."""
    if isinstance(band, int):
        return meta.where(F.col("band") == band), tiles.where(F.col("band") == band)
    wanted = F.create_map(*[F.lit(x) for pair in band.items() for x in pair])
    return tuple(df.where(F.col("band") == F.try_element_at(wanted, F.col("raster_id"))) for df in (meta, tiles))
