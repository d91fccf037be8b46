"""Archives and workbooks as partitioned data sources: only the members and files that a filter lets through are opened."""

from __future__ import annotations

import itertools
import json
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docloom.sources.files import IMAGE_ENDINGS, MOST_IMAGE, sheet_rows
from docloom.sources.immutable import mounted

#: Bytes of an archive that one partition reads.
SPLIT_BYTES = 64 * 1024 * 1024
#: Partitions over which very many archives, or shares of them, are dealt (at most twice as many); and the bytes that one reads of smaller ones at most.
OWN_PARTITIONS, TOGETHER_BYTES = 512, 4 * 1024 * 1024
BATCH_ROWS = 4096

CHECKS = {
    "=": lambda v, x: v == x,
    "in": lambda v, x: v in x,
    "starts": lambda v, x: v.startswith(x),
    "ends": lambda v, x: v.endswith(x),
    "contains": lambda v, x: x in v,
    ">": lambda v, x: v > x,
    ">=": lambda v, x: v >= x,
    "<": lambda v, x: v < x,
    "<=": lambda v, x: v <= x,
}


def passes(filters: list[tuple], **values) -> bool:
    """Whether a row of these column values, as far as they are known, can pass."""
    return all(CHECKS[check](values[column], value) for column, check, value in filters if column in values)


def files_under(path: str, ending: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of an ending under a folder, or of a file itself, in order of path."""
    if os.path.isfile(path):
        return [(path, os.path.getsize(path))]
    found = [(f"{top}/{n}", os.path.getsize(f"{top}/{n}")) for top, _, names in os.walk(path) for n in names if n.lower().endswith(ending)]
    return sorted(found)


@dataclass
class Piece:
    """A share of a file's content."""

    path: str
    number: int
    of: int


@dataclass
class Pieces(InputPartition):
    pieces: list[Piece]


def together(pieces: list[tuple[Piece, float]], most: float) -> list[Pieces]:
    """Pieces of (piece, bytes), in order, in partitions of about ``most`` bytes; a larger piece has its own."""
    out, size = [], 0.0
    for piece, n in pieces:
        if not out or size + n > most:
            out.append([])
            size = 0
        out[-1].append(piece)
        size += n
    return [Pieces(some) for some in out]


class _Reader(DataSourceReader):
    """Files of one ending; ``known`` are the columns that filters may name.

    Filters come with the options of a read and aren't pushed by Spark's planner: what it has pushed stays with a relation,
    and another query on the same frame would then miss rows.
    """

    known: tuple[str, ...] = ()
    ending = ""

    def __init__(self, options: dict, schema):
        self.options, self.root, self.fields = options, mounted(options["path"]), schema
        self.filters = json.loads(options.get("filters", "[]"))
        for column, check, _ in self.filters:
            if column not in self.known or check not in CHECKS:
                raise ValueError(f"no filter {check!r} on {column!r}; columns: {', '.join(self.known)}")

    def shown(self, path: str) -> str:
        return os.path.relpath(path, self.root) if os.path.isdir(self.root) else os.path.basename(path)

    def pieces(self, size: int) -> int:
        return 1

    def partitions(self) -> list[Pieces]:
        column = self.known[0]
        kept = [(p, n, self.pieces(n)) for p, n in files_under(self.root, self.ending) if passes(self.filters, **{column: self.shown(p)})]
        most = min(TOGETHER_BYTES, sum(n for _, n, _ in kept) / OWN_PARTITIONS)
        return together([(Piece(p, k, of), n / of) for p, n, of in kept for k in range(of)], most) or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        for path, some in itertools.groupby(partition.pieces, key=lambda p: p.path):
            yield from self.read_file(path, list(some))


class ArchiveReader(_Reader):
    """Members of ZIP files. A large archive is several partitions, each of which reads the directory and then its share of the members."""

    known, ending = ("archive", "name", "size"), ".zip"

    def pieces(self, size: int) -> int:
        return max(1, -(-size // int(self.options.get("splitbytes", SPLIT_BYTES))))

    def read_file(self, path: str, pieces: list[Piece]) -> Iterator[pa.RecordBatch]:
        of, numbers = pieces[0].of, {p.number for p in pieces}
        share = os.path.getsize(path) / of
        schema = pa.schema([("archive", pa.string()), ("pos", pa.int64()), ("name", pa.string()), ("size", pa.int64()), ("content", pa.binary())])
        with zipfile.ZipFile(path) as z:
            fine = [i for i in z.infolist() if not i.is_dir() and any(i.filename.lower().endswith(e) for e in IMAGE_ENDINGS) and i.file_size <= MOST_IMAGE]
            places = sorted(fine, key=lambda i: (i.filename.lower(), i.filename))
            for pos, member in enumerate(places):
                if min(int(member.header_offset / share), of - 1) not in numbers or not passes(self.filters, name=member.filename, size=member.file_size):
                    continue
                row = [[self.shown(path)], [pos], [member.filename], [member.file_size], [z.read(member)]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)


class WorkbookReader(_Reader):
    """Rows of the first sheet of XLSX files, each parsed as a stream."""

    known, ending = ("path",), ".xlsx"

    def read_file(self, path: str, pieces: list[Piece]) -> Iterator[pa.RecordBatch]:
        columns = [f.name for f in self.fields][2:]
        schema = pa.schema([("path", pa.string()), ("pos", pa.int64()), *((c, pa.string()) for c in columns)])
        held: list[list] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

        with zipfile.ZipFile(path) as z:
            for pos, values in enumerate(sheet_rows(z, columns)):
                held.append([self.shown(path), pos, *values])
                if len(held) == BATCH_ROWS:
                    yield batch()
                    held = []
        if held:
            yield batch()


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docloom_archives"

    def schema(self) -> str:
        return "archive string, pos long, name string, size long, content binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options, schema)


class Workbooks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docloom_workbooks"

    def schema(self) -> str:
        return "path string, pos long, " + ", ".join(f"`{c}` string" for c in self.options["columns"].split(","))

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options, schema)


def _read(spark: SparkSession, source: type[DataSource], path: str, filters: list[tuple], **options) -> DataFrame:
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(filters=json.dumps(filters), **options).load(path)


def read_archives(spark: SparkSession, path: str, filters: list[tuple] = (), split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(archive, pos, name, size, content): the images in the ZIP files under a mounted folder, by lower-case name.

    As ``files.archive_images``, but no archive is read whole: one over ``split_bytes`` is read in shares, each a member at a
    time. Of very many, a task takes several, TOGETHER_BYTES in all. ``filters``: (column, check, value) on archive, name and size with a check of CHECKS; archives and members
    that fail one are neither opened nor unpacked.
    """
    return _read(spark, Archives, path, list(filters), splitBytes=split_bytes)


def read_workbooks(spark: SparkSession, path: str, columns: list[str], filters: list[tuple] = ()) -> DataFrame:
    """(path, pos, columns): as ``files.workbook_rows``, of the XLSX files under a mounted folder; ``filters`` on path choose files."""
    return _read(spark, Workbooks, path, list(filters), columns=",".join(columns))
