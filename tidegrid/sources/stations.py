"""A Spark data source for station measurement files: ``spark.read.format("station_files").load(folder)``.

Every file is a partition with a header of its own, so files of different variables can lie in one folder. The options
``stations`` (numbers with commas), ``start`` and ``end`` (both inclusive, UTC) say what is wanted: other rows are dropped
before their values are read, and files whose name tells station and years (as the supplier's downloads do,
``uurgeg_260_2011-2020.txt``) are not opened where they can't hold a row. They are options, and not filters that Spark pushes down,
as Spark 4.1 keeps a reader with the filters of one query for other queries of the same table.

Files are read through Arrow's file systems (local, HDFS, S3 and others by URL). For stores that only Spark reads there is
:func:`tidegrid.sources.weather.read_knmi_measurements`, which needs no such access.
"""

from __future__ import annotations

import fnmatch
import io
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType, TimestampType

#: Names of the supplier's files: hourly or daily, station, and the years of some.
NAMED = re.compile(r"(?:uur|etm)geg_(\d{3})(?:_(\d{4})-(\d{4}))?\.")
KEYS = ("STN", "YYYYMMDD", "HH", "H", "HR")
ROWS = 20_000


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URL, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[str]:
    """The files of a folder, a file, or a pattern in the last part of a path; in order, as they were written."""
    store, at = opened(path)
    head = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    folder, _, pattern = (at.rstrip("/"), "", "*") if info.type == fs.FileType.Directory else at.rpartition("/")
    found = [f.path for f in store.get_file_info(fs.FileSelector(folder or "/", recursive=False)) if f.type == fs.FileType.File]
    return [head + f for f in sorted(found) if fnmatch.fnmatch(f.rpartition("/")[2], pattern) and not f.rpartition("/")[2].startswith(("_", "."))]


def header(line: str) -> list[str]:
    """The columns that a header line names."""
    return [n.strip() for n in line.lstrip("# ").split(",")]


def lines(path: str) -> Iterator[str]:
    """A file's lines."""
    store, at = opened(path)
    with store.open_input_stream(at) as raw:
        yield from io.TextIOWrapper(raw, encoding="utf-8", errors="replace")


def names_in(path: str) -> list[str]:
    """The columns of a file: those of the last line that begins with ``#`` before its first row."""
    last: list[str] = []
    for line in lines(path):
        if line.startswith("#"):
            last = header(line)
        elif line.strip():
            break
    return last


@dataclass
class File(InputPartition):
    """One file."""

    path: str


def moment(text: str | None) -> datetime | None:
    """An option's time, in UTC."""
    return None if text is None else datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


class StationReader(DataSourceReader):
    """Reads the files that may hold rows."""

    def __init__(self, schema: StructType, options: Mapping[str, str]):
        self.path, self.schema = options["path"], schema
        freq = options.get("freq", "hourly")
        if freq not in ("hourly", "daily"):
            raise ValueError("freq must be hourly or daily")
        self.hourly = freq == "hourly"
        self.stations = {int(n) for n in options["stations"].split(",")} if options.get("stations") else None
        self.low, self.high = moment(options.get("start")), moment(options.get("end"))

    def partitions(self) -> Sequence[InputPartition]:
        """One for each file that may hold a row."""
        return [File(p) for p in listed(self.path) if self._may_hold(p.rpartition("/")[2])]

    def _may_hold(self, name: str) -> bool:
        told = NAMED.match(name)
        if not told:
            return True
        if self.stations is not None and int(told[1]) not in self.stations:
            return False
        if told[2] is None:
            return True
        first, last = (datetime(int(y) + k, 1, 1, tzinfo=timezone.utc) for k, y in ((0, told[2]), (1, told[3])))  # hour 24 is midnight
        return (self.high is None or first <= self.high) and (self.low is None or self.low <= last)

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        """Batches of rows, by the file's own header."""
        wanted = [f.name for f in self.schema.fields]
        kinds = [pa.int32() if f.name == "STN" else pa.timestamp("us", "UTC") if f.name == "TIME" else pa.float64() for f in self.schema.fields]
        at: dict[str, int] = {}
        out: list[list] = [[] for _ in wanted]
        number = lambda cells, name: float(t) if (k := at.get(name)) is not None and k < len(cells) and (t := cells[k].strip()) else None
        for line in lines(partition.path):
            if line.startswith("#"):
                at = {n: i for i, n in enumerate(header(line))}
                continue
            if not line.strip() or "STN" not in at:
                continue
            cells = line.split(",")
            station = int(cells[at["STN"]])
            if self.stations is not None and station not in self.stations:
                continue
            day = cells[at["YYYYMMDD"]].strip()
            time = datetime(int(day[:4]), int(day[4:6]), int(day[6:8]), tzinfo=timezone.utc)
            hour = next((n for n in KEYS[2:] if n in at), None) if self.hourly else None
            if hour is not None:
                time += timedelta(hours=int(cells[at[hour]]))
            if (self.low is not None and time < self.low) or (self.high is not None and time > self.high):
                continue
            for name, column in zip(wanted, out, strict=True):
                column.append(station if name == "STN" else time if name == "TIME" else number(cells, name))
            if len(out[0]) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], wanted)
                out = [[] for _ in wanted]
        if out and out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], wanted)


class StationFiles(DataSource):
    """``STN, TIME`` and all variables that a file has; where a file lacks one it is missing. Options: ``path``, ``freq``
    (``hourly``, where hour n ends the n-th hour of its day, or ``daily``), ``stations``, ``start``, ``end``. A given schema
    saves the look at all headers."""

    @classmethod
    def name(cls) -> str:
        """The format's name."""
        return "station_files"

    def schema(self) -> StructType:
        """The union of all headers, in order of the files."""
        found = dict.fromkeys(n for p in listed(self.options["path"]) for n in names_in(p) if n not in KEYS)
        return StructType([StructField("STN", IntegerType()), StructField("TIME", TimestampType()), *[StructField(n, DoubleType()) for n in found]])

    def reader(self, schema: StructType) -> DataSourceReader:
        """A reader of the path."""
        return StationReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(StationFiles)
