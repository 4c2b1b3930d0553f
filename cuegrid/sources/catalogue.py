"""Folders of media files, and the documents that a probe left beside them, as a data source."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SUFFIXES = ("mp4", "MP4", "mkv", "MKV")  # fixed values: suffixes of media files
_COMPARED = {EqualTo: "eq", GreaterThan: "gt", GreaterThanOrEqual: "ge", LessThan: "lt", LessThanOrEqual: "le"}
_HOLDS = {"eq": lambda a, b: a == b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "lt": lambda a, b: a < b, "le": lambda a, b: a <= b}


class Files(InputPartition):
    """Files of one group: (path, length, mtime, the path of its probe document or None)."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("a catalogue needs a path")
        self.path, self.group, self.probe = options["path"], int(options.get("filesPerPartition", 1000)), options.get("probeSuffix", ".json")
        self.wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of length, mtime and path decide what is listed; all others are left to Spark."""
        for f in filters:
            at = getattr(f, "attribute", ())
            if type(f) in _COMPARED and len(at) == 1 and at[0] in ("path", "length", "mtime"):
                self.wanted.append((at[0], _COMPARED[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """The folder is listed once; documents are read by the tasks."""
        found = _listed(self.path)
        names = {path for path, *_ in found}
        rows = []
        for path, length, mtime in sorted(found):
            if not any(fnmatch.fnmatchcase(path, f"*.{s}") for s in SUFFIXES):
                continue
            said = {"path": path, "length": length, "mtime": mtime}
            if all(_HOLDS[how](said[c], v) for c, how, v in self.wanted):
                beside = path.rpartition(".")[0] + self.probe
                rows.append((path, length, mtime, beside if beside in names else None))
        if not rows and not self.wanted:
            raise FileNotFoundError(f"no media files in {self.path}")
        return [Files(rows[i : i + self.group]) for i in range(0, len(rows), self.group)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, length, mtime, beside in partition.rows:
            text = None
            if beside:
                where, name = _place(beside)
                with where.open_input_stream(name) as f:
                    text = f.read().decode("utf-8", "replace")
            yield path, length, mtime, text


def _place(path: str) -> tuple:
    """(file system, name there) of a path; one without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def _listed(path: str) -> list[tuple[str, int, int]]:
    from pyarrow import fs

    where, name = _place(path)
    scheme = path.partition(":/")[0] if ":/" in path else "file"
    rows = where.get_file_info(fs.FileSelector(name))
    return [(f"{scheme}://{f.path}", f.size, int(f.mtime.timestamp())) for f in rows if f.is_file]


class Catalogue(DataSource):
    """Format `catalogue`: (path, length, mtime, probe) of the media files in the folder `path`. `probe` is the text of the document of the same name with probeSuffix (.json), null where there is none.

    Files are dealt to partitions by filesPerPartition (1000). A folder without media files is an error, unless a filter left none. The path is of any store that pyarrow reads (local, HDFS, S3, GCS);
    ingest.media_files() lists the stores that only Spark reads, without documents."""

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return "path string, length long, mtime long, probe string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    """Makes spark.read.format("catalogue") known, and lets filters reach Python sources, in this session."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Catalogue)


def write_files(rows: DataFrame, to: str, name: str = "name", content: str = "content") -> None:
    """A file for each row, written by the tasks; a file that is there is replaced, so a task that runs again does no harm."""

    def put(batches):
        for pdf in batches:
            for n, c in zip(pdf[name], pdf[content]):
                where, at = _place(f"{to.rstrip('/')}/{n}")
                where.create_dir(at.rpartition("/")[0])
                with where.open_output_stream(at) as f:
                    f.write((c or "").encode())
            yield pdf[[name]]

    rows.select(name, content).mapInPandas(put, f"{name} string").count()
