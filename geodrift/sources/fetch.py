"""Downloads by an injected ``fetcher(url) -> bytes``; no import has side effects."""

from __future__ import annotations

import os
import re
import sys
import warnings
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

#: Fixed addresses of the public data service.
SERVICE = "https://geodesy.unr.edu"
CATALOGUE_URL = f"{SERVICE}/NGLStationPages/llh.out"
LOOKUP_URL = f"{SERVICE}/grid_timeseries/grid_latlon_lookup.txt"
GRID_URL = f"{SERVICE}/grid_timeseries/time_variable_gridded/IGS14/"

Fetcher = Callable[[str], bytes]


def http(url: str) -> bytes:
    """Default fetcher."""
    from urllib.request import urlopen

    with urlopen(url) as response:  # noqa: S310
        return response.read()


def cache_dir(app: str = "geodrift") -> Path:
    """Folder for downloads: the XDG cache folder, or ~/Library/Caches on a Mac and ~/.cache elsewhere; it is not created here."""
    if sys.platform == "darwin" and not os.environ.get("XDG_CACHE_HOME"):
        return Path.home() / "Library" / "Caches" / app
    return Path(os.environ.get("XDG_CACHE_HOME") or Path.home() / ".cache") / app


def series_url(station: str, coords: str = "enu", plate: str | None = None) -> str:
    """Address of a station's daily file, fixed to a plate if one is named."""
    name = station.upper()
    if coords == "xyz":
        return f"{SERVICE}/gps_timeseries/txyz/IGS14/{name}.txyz2"
    if coords != "enu":
        raise ValueError(f"coordinates are enu or xyz, not {coords!r}")
    return f"{SERVICE}/gps_timeseries/tenv3/plates/{plate}/{name}.{plate}.tenv3" if plate else f"{SERVICE}/gps_timeseries/tenv3/IGS14/{name}.tenv3"


def station_plate(station: str, fetcher: Fetcher = http) -> str:
    """Plate code on the station's page."""
    page = fetcher(f"{SERVICE}/NGLStationPages/stations/{station.upper()}.sta").decode("utf-8", "replace")
    found = re.search("([A-Z]{2}) Plate Fixed", page)
    if not found:
        raise ValueError(f"no plate is named on the page of {station}")
    return found[1]


def _save(url: str, path: Path, fetcher: Fetcher) -> Path:
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    part.write_bytes(fetcher(url))
    part.replace(path)
    return path


def download_series(station: str, folder: Path, coords: str = "enu", plate_fixed: bool = False, fetcher: Fetcher = http) -> Path:
    """A station's file in ``folder``; the plate is looked up only if it is used."""
    plate = station_plate(station, fetcher) if plate_fixed and coords == "enu" else None
    url = series_url(station, coords, plate)
    name = station.upper()
    return _save(url, Path(folder) / (f"{name}_{plate}.tenv3" if plate else url.rsplit("/", 1)[1]), fetcher)


def download_all_series(stations: Iterable[str], folder: Path, workers: int = 5, fetcher: Fetcher = http) -> tuple[list[str], list[str]]:
    """(files, stations whose file could not be had); files that are there are kept, each failure is warned of."""

    def one(name: str) -> tuple[str, str | None]:
        there = Path(folder) / series_url(name).rsplit("/", 1)[1]
        try:
            return name, str(there if there.exists() else download_series(name, folder, fetcher=fetcher))
        except (OSError, ValueError) as fault:
            warnings.warn(f"station {name} is skipped: {fault}", stacklevel=2)
            return name, None

    with ThreadPoolExecutor(workers) as pool:
        found = list(pool.map(one, stations))
    return [path for _, path in found if path], [name for name, path in found if not path]


def download_catalogue(path: Path, fetcher: Fetcher = http) -> Path:
    return _save(CATALOGUE_URL, Path(path), fetcher)


def download_lookup(folder: Path, fetcher: Fetcher = http) -> Path:
    return _save(LOOKUP_URL, Path(folder) / LOOKUP_URL.rsplit("/", 1)[1], fetcher)


def remote_grid_files(fetcher: Fetcher = http) -> list[str]:
    """Distinct names of grid series, sorted."""
    return sorted(set(re.findall(r"\d{6}_IGS14\.tenv8", fetcher(GRID_URL).decode("utf-8", "replace"))))


def download_grid(folder: Path, names: Iterable[str] | None = None, workers: int = 8, fetcher: Fetcher = http) -> list[Path]:
    """Grid series in ``folder``; files that are there are kept; the first failure is raised."""
    wanted = [Path(folder) / n for n in (remote_grid_files(fetcher) if names is None else names)]
    with ThreadPoolExecutor(workers) as pool:
        list(pool.map(lambda p: _save(GRID_URL + p.name, p, fetcher), [p for p in wanted if not p.exists()]))
    return wanted
