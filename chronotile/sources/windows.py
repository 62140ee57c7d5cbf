"""S6, ST1: aligned windows of two large rasters, each task fetching only the byte ranges of the strips or tiles that its windows touch.

``pair_windows(spark, before, after)`` reads one pair as a Python data source: its partitions are runs of windows, planned from the two
headers. ``window_rows(pairs)`` does the same for a table of pairs: a first step reads the headers where the rows are, a second one the
windows, dealt out by (pair, run), so that the windows of a large pair spread over all tasks. Files of any size work; a task holds two
windows and the last strips or tiles.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chronotile.sources import tiff
from chronotile.sources.rasters import UNREADABLE, Reader, as_rgb

SCHEMA = "pair_id long, height int, width int, y0 int, x0 int, h int, w int, before binary, after binary, error string"
#: Windows that one partition reads.
RUN = 16
BROKEN = (*UNREADABLE, OSError)


def starts(length: int, size: int, overlap: float) -> list[int]:
    """Where windows of at least 64 pixels begin along one side; the last one ends at the edge."""
    size = max(64, size)
    step = max(1, round(size * (1 - min(0.5, max(0.0, overlap)))))
    last = max(length - size, 0)
    return sorted({*range(0, last + 1, step), last})


def _band(low: int | None, high: int | None, at: list[int], size: int) -> list[int]:
    """Starts of the windows that meet the pixels from ``low`` to ``high``, all if these are not given."""
    return [k for k in at if (high is None or k <= high) and (low is None or k + size > low)]


def planned(height: int, width: int, size: int, overlap: float, area: tuple | None = None, run: int = RUN) -> list[list[tuple[int, int, int, int]]]:
    """Runs of windows (y0, x0, h, w) along the lines of windows. ``area`` (y0, x0, y1, x1, ends included) leaves out those that do not meet it."""
    size = max(64, size)
    y_low, x_low, y_high, x_high = area or (None,) * 4
    rows, columns = _band(y_low, y_high, starts(height, size, overlap), size), _band(x_low, x_high, starts(width, size, overlap), size)
    return [
        [(y0, x0, min(size, height - y0), min(size, width - x0)) for x0 in columns[k : k + run]]
        for y0 in rows
        for k in range(0, len(columns), run)
    ]


def _row(pair_id: int | None, places: tuple, before: bytes | None, after: bytes | None, error: str | None) -> tuple:
    return (pair_id, *places, before, after, error)


def read_run(pair_id: int | None, before: str, after: str, run: list[tuple[int, int, int, int]], opened=tiff.Ranges) -> Iterator[tuple]:
    """Rows of SCHEMA for the windows of a run. The image after is resized to the one before where they differ. What cannot be read gives
    one row with the reason."""
    try:
        one, two = Reader(opened(before)), Reader(opened(after))
        for y0, x0, h, w in run:
            a, b = one.window(y0, x0, h, w), two.scaled(one.height, one.width, y0, x0, h, w)
            yield _row(pair_id, (one.height, one.width, y0, x0, h, w), as_rgb(a).tobytes(), as_rgb(b).tobytes(), None)
    except BROKEN as e:
        yield _row(pair_id, (None,) * 6, None, None, str(e) or type(e).__name__)


class _Run(InputPartition):
    def __init__(self, windows: list[tuple[int, int, int, int]]) -> None:
        self.windows = windows


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.before, self.after = options["before"], options["after"]
        self.pair_id, self.size, self.overlap = int(options.get("pair_id", 0)), int(options.get("size", 512)), float(options.get("overlap", 0.25))
        self.area = tuple(json.loads(options["area"])) if options.get("area") else None

    def partitions(self) -> list[_Run]:
        try:
            first = Reader(tiff.Ranges(self.before))
        except BROKEN:
            return [_Run([(0, 0, 0, 0)])]  # its task meets the same fault and reports it
        return [_Run(x) for x in planned(first.height, first.width, self.size, self.overlap, self.area)]

    def read(self, partition: _Run) -> Iterator[tuple]:
        return read_run(self.pair_id, self.before, self.after, partition.windows)


class PairWindows(DataSource):
    """``spark.read.format("raster_pair_windows")`` with options before, after (paths or URIs), pair_id, size, overlap and area, a JSON list
    [y0, x0, y1, x1] of the pixels that matter: other windows are neither planned nor read."""

    @classmethod
    def name(cls) -> str:
        return "raster_pair_windows"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def pair_windows(spark: SparkSession, before: str, after: str, pair_id: int = 0, size: int = 512, overlap: float = 0.25, area: tuple | None = None) -> DataFrame:
    """One pair of files as SCHEMA, a row per window; ``area`` (y0, x0, y1, x1, ends included) restricts the scan."""
    spark.dataSource.register(PairWindows)
    read = spark.read.format("raster_pair_windows").option("before", before).option("after", after).option("pair_id", pair_id)
    return read.option("size", size).option("overlap", overlap).option("area", json.dumps(area) if area else "").load()


def window_rows(pairs: DataFrame, size: int = 512, overlap: float = 0.25, run: int = RUN) -> DataFrame:
    """Pairs (pair_id, before, after: paths or URIs) as SCHEMA, a row per window; each pair is planned from its header, its runs of windows are
    dealt out over all tasks. Null or unreadable files give one row with the reason; an empty table gives none."""

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for pair, before, after in zip(rows["pair_id"], rows["before"], rows["after"], strict=True):
                try:
                    first = Reader(tiff.Ranges(before))
                    runs = planned(first.height, first.width, size, overlap, run=run)
                except (*BROKEN, AttributeError):
                    runs = [[(0, 0, 0, 0)]]
                yield pd.DataFrame({"pair_id": pair, "before": before, "after": after, "run": range(len(runs)), "windows": [[v for w in x for v in w] for x in runs]})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for rows in batches:
            for pair, before, after, flat in zip(rows["pair_id"], rows["before"], rows["after"], rows["windows"], strict=True):
                if pd.isna(before) or pd.isna(after):
                    found = iter([_row(pair, (None,) * 6, None, None, "no path")])
                else:
                    found = read_run(pair, before, after, [tuple(x) for x in np.reshape(flat, (-1, 4)).tolist()])
                for row in found:
                    yield pd.DataFrame([row], columns=names).astype(dict.fromkeys(names[1:7], "Int32"))

    shape = "pair_id long, before string, after string, run int, windows array<int>"
    # Rows are dealt by file and run, so that one large pair reaches all tasks, and to a stated number of partitions: adaptive execution
    # would put the runs, few bytes each, into one.
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = pairs.select(F.col("pair_id").cast("long"), "before", "after").mapInPandas(plan, shape)
    return runs.repartition(parts, "before", "after", "run").select("pair_id", "before", "after", "windows").mapInPandas(read, SCHEMA)
