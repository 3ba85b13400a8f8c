"""Results as CSV and GeoParquet."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from datetime import date
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, header: bool = True, single: bool = False) -> None:
    """CSV files under ``path``; ``single`` gathers a small report in one file."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", header).csv(path)


def geo_metadata(geometry: str = "geometry", kinds: tuple[str, ...] = ("Point",)) -> bytes:
    """GeoParquet footer entry for a column of well-known binary in longitude and latitude."""
    column = {"encoding": "WKB", "geometry_types": list(kinds)}
    return json.dumps({"version": "1.0.0", "primary_column": geometry, "columns": {geometry: column}}).encode()


def _with_footer(path: str, footer: bytes) -> None:
    """Rewrites one parquet file with a ``geo`` footer, row group by row group."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    folder, _, base = name.rpartition("/")
    part = f"{folder}/.{uuid.uuid4().hex}.tmp"
    with store.open_input_file(name) as source:
        file = pq.ParquetFile(source)
        schema = file.schema_arrow.with_metadata({**(file.schema_arrow.metadata or {}), b"geo": footer})
        with store.open_output_stream(part) as sink, pq.ParquetWriter(sink, schema) as writer:
            for k in range(file.num_row_groups):
                writer.write_table(file.read_row_group(k).replace_schema_metadata(schema.metadata))
    store.move(part, name)
    check = f"{folder}/.{base}.crc"  # a local Hadoop file system keeps a check sum of the old bytes
    if store.get_file_info(check).type == fs.FileType.File:
        store.delete_file(check)


def write_geoparquet(df: DataFrame, path: str, geometry: str = "geometry") -> None:
    """Parquet files under ``path`` with the ``geo`` footer.

    The files are rewritten where they lie, one task each; a task that runs again
    finds a whole file, old or new, so a lost executor does no harm.
    """
    df.write.mode("overwrite").parquet(path)
    footer = geo_metadata(geometry)
    files = df.sparkSession.read.parquet(path).inputFiles()
    if not files:
        return

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file in batch["file"]:
                _with_footer(unquote(file), footer)
            yield batch

    listed = df.sparkSession.createDataFrame([(f,) for f in files], "file string")
    listed.repartition(len(files)).mapInPandas(rewrite, "file string").count()


def default_grid_name(day: date) -> str:
    return f"unr_gridded_{day:%Y%m%d}.parquet"
