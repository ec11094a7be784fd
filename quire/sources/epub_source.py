"""EPUB files as a data source of Spark: ``spark.read.format("epub").load(folder)``, and as a stream.

``EpubSource.register(spark)`` makes the format known. Files are listed once, on the driver, and dealt out by bytes: a partition takes files up to
``partitionBytes`` (128 MB), so a folder of many small books is few tasks, and a large book one of its own. A task opens a file where it
lies and reads the members it needs, one at a time; images only with ``images=true``. Filters on ``path`` (equality, IN, prefix) are taken
over, so that other files are not opened.

Option ``rows`` says what a row is: ``books`` (the columns of ``epub.read_epubs``: a book with its chapters, or its error) or ``files``
(path, position, name, markup, text: the files of the spine, in reading order; a file that is no EPUB has none). A stream gives the files
whose time of change is later than that of all files before; a file that is put back with an older time is not seen.

Paths are those that pyarrow's file systems open (local, HDFS, S3, GCS); where only Spark can read, ``epub.read_epubs`` does.
An empty folder gives no rows, files of other names are passed over, and folders within are searched.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from quire.sources import epub

PARTITION_BYTES = 128 << 20
FILES = "path string, position int, name string, markup binary, text string"
_FILES = pa.schema([("path", pa.string()), ("position", pa.int32()), ("name", pa.string()), ("markup", pa.binary()), ("text", pa.string())])
#: Bytes of a file that are digested at once.
PIECE = 1 << 20


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Found:
    path: str
    size: int
    changed: int


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def found(folder: str) -> list[Found]:
    """The EPUB files below a folder (or the one that it names), by path."""
    system, at = _opened(folder)
    info = system.get_file_info(at)
    files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else []
    return sorted((Found(f.path, f.size, f.mtime_ns or 0) for f in files if f.type == fs.FileType.File and f.path.lower().endswith(".epub")), key=lambda f: f.path)


def dealt(files: list[Found], most: int) -> list[Files]:
    """Files in order, up to so many bytes together."""
    out: list[Files] = []
    size = 0
    for f in files:
        if not out or size + f.size > most:
            out.append(Files([]))
            size = 0
        out[-1].paths.append(f.path)
        size += f.size
    return out


class _Reading:
    def __init__(self, options):
        self.folder = options.get("path")
        if not self.folder:
            raise ValueError("a path is needed")
        self.most = int(options.get("partitionbytes", PARTITION_BYTES))
        self.images = str(options.get("images", "false")).lower() == "true"
        self.whole_books = options.get("rows", "books") == "books"

    def rows(self, paths: Sequence[str]) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.folder)
        for path in paths:
            if self.whole_books:
                yield epub.book_row(path, lambda path=path: self._book(system, path, True))
                continue
            try:
                book = self._book(system, path, False)
            except ValueError:
                continue
            # a file at a time, so that no book's texts are in memory together
            for i, (name, markup) in enumerate(book.spine):
                text = epub.plain(epub.html_text(markup)[0])
                yield pa.RecordBatch.from_pylist([{"path": path, "position": i, "name": name, "markup": markup, "text": text}], _FILES)

    def _book(self, system: fs.FileSystem, path: str, digest: bool) -> epub.Book:
        with system.open_input_file(path) as f:
            book = epub.open_book(path, io.BufferedReader(f) if not f.seekable() else f, self.images)
            if digest:
                f.seek(0)
                h = hashlib.sha256()
                while piece := f.read(PIECE):
                    h.update(piece)
                book.source_hash = h.hexdigest()
        return book


class EpubReader(_Reading, DataSourceReader):
    def __init__(self, options):
        super().__init__(options)
        self.wanted: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == ("path",):
                self.wanted.append(f)
            else:
                yield f

    def _takes(self, path: str) -> bool:
        def one(f) -> bool:
            return path == f.value if isinstance(f, EqualTo) else path in f.value if isinstance(f, In) else path.startswith(f.value)

        return all(map(one, self.wanted))

    def partitions(self) -> list[Files]:
        return dealt([f for f in found(self.folder) if self._takes(f.path)], self.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from self.rows(partition.paths)


class EpubStream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:  # noqa: N802
        return {"changed": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"changed": max((f.changed for f in found(self.folder)), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return dealt([f for f in found(self.folder) if start["changed"] < f.changed <= end["changed"]], self.most)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        yield from self.rows(partition.paths)

    def commit(self, end: dict) -> None:
        return


class EpubSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "epub"

    @staticmethod
    def register(spark: SparkSession) -> None:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(EpubSource)

    def schema(self) -> str:
        return epub._BOOK if self.options.get("rows", "books") == "books" else FILES

    def reader(self, schema) -> EpubReader:
        return EpubReader(self.options)

    def streamReader(self, schema) -> EpubStream:  # noqa: N802
        return EpubStream(self.options)


def load(spark: SparkSession, folder: str, **options) -> DataFrame:
    """The books of a folder, through the source."""
    EpubSource.register(spark)
    return spark.read.format("epub").options(**options).load(folder)
