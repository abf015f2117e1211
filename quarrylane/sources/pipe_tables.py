"""Markdown pipe tables as a Spark data source: ``spark.read.format("pipe_tables")``.

A table is a run of lines that start with a pipe, indented or not; where its second line is a
separator, the first is its header. Files are the partitions. Without options each row is (file,
table, line, header, cells), separators and headers left out; with ``lines`` ("324-356") or ``table`` (from 0)
it is one table with its header's names as columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import IntegerType, StringType, StructType

from quarrylane.session import ship

SEPARATOR = re.compile(r"\|?(?=[^-]*-)[\s:|-]+\|?")
PIPE = re.compile(r"(?<!\\)\|")
GENERIC = "file string, table int, line int, header array<string>, cells array<string>"


def cells_of(line: str) -> list[str]:
    """Cells of a row; an escaped pipe is part of its cell."""
    inner = line.strip().removeprefix("|")
    if inner.endswith("|") and not inner.endswith("\\|"):
        inner = inner[:-1]
    return [c.strip().replace("\\|", "|") for c in PIPE.split(inner)]


def tables_of(lines: Iterator[str]) -> Iterator[tuple[int, int, list[str], list[str]]]:
    """(table, line, header, cells) for each row of each table; lines count from 1, tables from 0."""
    number, run = 0, []

    def rows() -> Iterator[tuple[int, int, list[str], list[str]]]:
        has_header = len(run) > 1 and SEPARATOR.fullmatch(run[1][1].strip())
        header = cells_of(run[0][1]) if has_header else []
        for at, line in run[2:] if has_header else run:
            yield number, at, header, cells_of(line)

    for at, line in enumerate(lines, 1):
        if line.lstrip().startswith("|"):
            run.append((at, line))
        elif run:
            yield from rows()
            number, run = number + 1, []
    if run:
        yield from rows()


def files_of(path: str) -> tuple[fs.FileSystem, list[str]]:
    """A file, or the Markdown files of a folder, on any file system that Arrow opens."""
    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    if store.get_file_info(at).type == fs.FileType.Directory:
        found = store.get_file_info(fs.FileSelector(at, recursive=True))
        return store, sorted(f.path for f in found if f.is_file and f.path.endswith(".md"))
    return store, [at]


def lines_of(store: fs.FileSystem, path: str) -> Iterator[str]:
    with store.open_input_stream(path) as f:
        rest = b""
        while block := f.read(1 << 20):
            *whole, rest = (rest + bytes(block)).split(b"\n")
            yield from (w.decode("utf-8", "replace").removesuffix("\r") for w in whole)
        yield rest.decode("utf-8", "replace")


class OneFile(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PipeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        first, _, last = options.get("lines", "").partition("-")
        self.lines = (int(first), int(last or first)) if first else None
        self.table = int(options["table"]) if "table" in options else None
        self.named = self.lines is not None or self.table is not None

    def partitions(self) -> list[InputPartition]:
        return [OneFile(p) for p in files_of(self.path)[1]]

    def wanted(self, path: str) -> Iterator[tuple[int, int, list[str], list[str]]]:
        for row in tables_of(lines_of(files_of(self.path)[0], path)):
            if (self.table is None or row[0] == self.table) and (self.lines is None or self.lines[0] <= row[1] <= self.lines[1]):
                yield row

    def read(self, partition: OneFile) -> Iterator[tuple]:
        for table, line, header, cells in self.wanted(partition.path):
            if not self.named:
                yield partition.path, table, line, header, cells
            elif len(cells) > len(header):
                raise ValueError(f"{partition.path}:{line}: {len(cells)} cells under {len(header)} names")
            else:
                yield line, *cells, *[None] * (len(header) - len(cells))


class PipeTables(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pipe_tables"

    def schema(self) -> StructType | str:
        reader = PipeReader(self.options)
        if not reader.named:
            return GENERIC
        tables = {}
        for path in (p.path for p in reader.partitions()):
            tables |= {(path, t): tuple(header) for t, _, header, _ in reader.wanted(path)}
        if len(tables) != 1 or not (header := next(iter(tables.values()))):
            raise ValueError(f"{len(tables)} tables with rows there, or one without a header; one with a header is wanted")
        return self._named(header)

    @staticmethod
    def _named(header: tuple[str, ...]) -> StructType:
        kind, seen = StructType().add("line", IntegerType()), {"line"}
        for i, name in enumerate(header, 1):
            name = name or f"column_{i}"
            while name.lower() in seen:
                name += "_"
            seen.add(name.lower())
            kind = kind.add(name, StringType())
        return kind

    def reader(self, schema: StructType) -> DataSourceReader:
        return PipeReader(self.options)


def read_tables(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    """All rows of all tables, or with ``lines`` or ``table`` one table under its own names."""
    ship(spark)
    spark.dataSource.register(PipeTables)
    reader = spark.read.format("pipe_tables")
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load(path)
