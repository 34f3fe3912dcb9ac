"""Monthly ZIP archives of trip CSVs, or the extracted CSV files, as a Spark data source.

``spark.read.format("zip_csv").schema("started_at string, ...").load(glob)`` plans one task per
(archive, member) or plain CSV file. Quoted values may hold line breaks, so neither is split, and a month's parallelism
is its number of members or files. Columns are found by name in each file, whatever their order there. Convert
the files to Parquet once (``hourgrid.plans.dataset.ingest_trips``) before reading them repeatedly.
All columns are read as text: a station id such as ``5329.10`` must keep its zero.
"""

from __future__ import annotations

import fnmatch
import posixpath
import sys
import zipfile
from collections.abc import Iterator
from contextlib import ExitStack

import pyarrow as pa
import pyarrow.csv
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

ARCHIVE_GLOB = "20????-*tripdata.zip"
CSV_GLOB = "*.csv"
BLOCK_BYTES = 8 << 20


def open_filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path for a URI as Spark writes it; a plain path is local or mounted everywhere."""
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    if "://" not in uri:
        return pyarrow.fs.LocalFileSystem(), uri
    return pyarrow.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def list_archives(location: str, pattern: str = ARCHIVE_GLOB) -> list[str]:
    """Files matching a glob in the last path segment, or ``pattern``, sorted; an error when there are none."""
    filesystem, path = open_filesystem(location)
    folder, last = posixpath.split(path)
    if any(c in last for c in "*?["):
        pattern = last
    else:
        folder = path
    entries = filesystem.get_file_info(pyarrow.fs.FileSelector(folder, allow_not_found=True))
    found = sorted(e.path for e in entries if e.is_file and fnmatch.fnmatch(e.base_name, pattern))
    if not found:
        raise FileNotFoundError(f"no archives match {pattern} in {folder}; land the monthly files first")
    return found


class Member(InputPartition):
    """A member of an archive, or a plain file, which has no name of its own."""

    def __init__(self, archive: str, name: str | None):
        self.archive = archive
        self.name = name


class ZipCsvReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema = schema
        self.location = options["path"]
        self.pattern = options.get("files", ARCHIVE_GLOB)

    def partitions(self) -> list[Member]:
        filesystem, _ = open_filesystem(self.location)
        members = []
        for archive in list_archives(self.location, self.pattern):
            if not archive.lower().endswith(".zip"):
                members.append(Member(archive, None))
                continue
            with filesystem.open_input_file(archive) as raw, zipfile.ZipFile(raw) as opened:
                members += [Member(archive, n) for n in opened.namelist() if n.lower().endswith(".csv")]
        return members

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        filesystem, _ = open_filesystem(self.location)
        names = [f.name for f in self.schema.fields]
        in_file = [n for n in names if n != "archive"]
        convert = pyarrow.csv.ConvertOptions(
            include_columns=in_file, column_types={n: pa.string() for n in in_file}, strings_can_be_null=False
        )
        with ExitStack() as stack:
            stream = stack.enter_context(filesystem.open_input_file(partition.archive))
            if partition.name is not None:
                stream = stack.enter_context(stack.enter_context(zipfile.ZipFile(stream)).open(partition.name))
            batches = pyarrow.csv.open_csv(
                stream,
                read_options=pyarrow.csv.ReadOptions(block_size=BLOCK_BYTES),
                parse_options=pyarrow.csv.ParseOptions(newlines_in_values=True),
                convert_options=convert,
            )
            archive = posixpath.basename(partition.archive)
            for batch in batches:
                columns = {n: batch.column(n) for n in in_file}
                columns["archive"] = pa.repeat(archive, batch.num_rows)
                yield pa.RecordBatch.from_pydict({n: columns[n] for n in names})


class ZipCsvSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_csv"

    def schema(self) -> str:
        return "started_at string, start_station_id string, start_station_name string, archive string"

    def reader(self, schema: StructType) -> ZipCsvReader:
        return ZipCsvReader(schema, self.options)


def ship_with_tasks() -> None:
    """Send this module's code along with the tasks: executors need pyarrow, not this package."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


def register(spark: SparkSession) -> None:
    ship_with_tasks()
    spark.dataSource.register(ZipCsvSource)
