"""Documents clustered by a grid of cells, so that a box or a radius reads only the files and row groups near it.

A cell is a row of latitude and a column of longitude. Rows are partitions, and within them rows are sorted by cell, which
the statistics of Parquet then know. A cover is the cells that can hold a point; the exact test stands behind it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postflow.operators import query as Q

#: Degrees of a cell's sides. A cover has at most 180 / DEGREES rows, each with at most two runs of columns.
DEGREES = 5
ROWS, COLUMNS = 180 // DEGREES, 360 // DEGREES
FIELD = "geo.coordinates.coordinates"
PARTITION, CELL = "geo_row", "geo_cell"
_EARTH_KM = 6371.0088


def _place(value: float, low: float, n: int) -> int:
    return min(max(math.floor((value - low) / DEGREES), 0), n - 1)


def _placed(value: Column, low: float, n: int) -> Column:
    """The same as a column. Values beyond the ends belong to the outermost cells."""
    return F.least(F.greatest(F.floor((value - low) / DEGREES), F.lit(0)), F.lit(n - 1)).cast("int")


def with_cells(df: DataFrame, field: str = FIELD) -> DataFrame:
    """``df`` with ``geo_row`` and ``geo_cell``, null where there is no point."""
    lon, lat = F.get(F.col(field), F.lit(0)), F.get(F.col(field), F.lit(1))
    known = lon.isNotNull() & lat.isNotNull() & ~F.isnan(lon) & ~F.isnan(lat)
    row = F.when(known, _placed(lat, -90.0, ROWS))
    return df.withColumns({PARTITION: row, CELL: row * COLUMNS + _placed(lon, -180.0, COLUMNS)})


def write_clustered(df: DataFrame, path: str, field: str = FIELD, rows_per_file: int = 1_000_000) -> None:
    """Writes ``df`` clustered by cell. Ranges of cells are dealt by sampling, so a crowded cell is split over files."""
    placed = with_cells(df, field)
    spread = placed.repartitionByRange(PARTITION, CELL, F.xxhash64(*[c for c in ("id",) if c in df.columns] or [CELL]))
    spread.sortWithinPartitions(PARTITION, CELL).write.partitionBy(PARTITION).option("maxRecordsPerFile", rows_per_file).parquet(path)


def read_clustered(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table, with the columns of ``like`` and the two of the grid."""
    grid = [T.StructField(name, T.IntegerType()) for name in (CELL, PARTITION)]
    return spark.read.schema(T.StructType([*like.schema.fields, *grid])).parquet(path)


def runs(west: float, south: float, east: float, north: float) -> list[tuple[int, int, int]]:
    """The cells of a box as (row, first cell, last cell); two runs in a row if it crosses the date line."""
    if south > north:
        return []
    spans = [(west, east)] if west <= east else [(west, 180.0), (-180.0, east)]
    found = []
    for row in range(_place(south, -90.0, ROWS), _place(north, -90.0, ROWS) + 1):
        found += [(row, row * COLUMNS + _place(a, -180.0, COLUMNS), row * COLUMNS + _place(b, -180.0, COLUMNS)) for a, b in spans]
    return found


def near_cells(df: DataFrame, cover: list[tuple[int, int, int]]) -> DataFrame:
    """Rows in the cells of a cover: a filter on the partitions and on the sorted column, both of which prune the scan."""
    if not cover:
        return df.where("false")
    inside = F.lit(False)
    for _, first, last in cover:
        inside = inside | F.col(CELL).between(first, last)
    return df.where(F.col(PARTITION).isin(sorted({row for row, _, _ in cover})) & inside)


def around(lon: float, lat: float, km: float) -> tuple[float, float, float, float]:
    """A box (west, south, east, north) that holds all points within ``km``; west is larger than east across the date line."""
    angle = km / _EARTH_KM
    band = km / 111.0 + 1e-9
    south, north = lat - band, lat + band
    reach = math.sin(min(angle, math.pi / 2)) / max(math.cos(math.radians(lat)), 1e-12)
    if south <= -90 or north >= 90 or reach >= 1 or angle >= math.pi / 2:
        return -180.0, south, 180.0, north
    spread = math.degrees(math.asin(reach)) + 1e-9
    west, east = lon - spread, lon + spread
    return (west + 360 if west < -180 else west), south, (east - 360 if east > 180 else east), north


def in_box(df: DataFrame, west: float, south: float, east: float, north: float, field: str = FIELD) -> DataFrame:
    """:func:`query.geo_box` over a clustered table."""
    return Q.geo_box(near_cells(df, runs(west, south, east, north)), west, south, east, north, field)


def within_km(df: DataFrame, lon: float, lat: float, km: float, field: str = FIELD) -> DataFrame:
    """:func:`query.geo_distance` over a clustered table."""
    return Q.geo_distance(near_cells(df, runs(*around(lon, lat, km))), lon, lat, km, field)
