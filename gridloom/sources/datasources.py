"""Office packages as Spark data sources: a task for each sheet, slide deck part or document.

``spark.read.format("office_xlsx").option("table", "cells").load(folder)`` and the
like, after ``register(spark)``. A task opens its file through Arrow's file
systems and seeks to the parts it needs; it never holds the whole package. Filters
on ``sheet``, ``sheet_idx``, ``slide`` and ``file_path`` decide which tasks there
are. Columns are pruned by the schema that a reader is given: only its columns are built
and sent (``.schema("file_path string, ref string")``).

Made for large packages. For very many small ones the readers over ``binaryFile``
(:mod:`.spreadsheets` and so on) list and read files in parallel, while here the
driver looks into each file's directory, some kilobytes a file.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from . import presentations, sheet_parts, wordprocessing
from .packages import Package

ROWS = 10_000
#: Tables of workbooks: the kind of their rows, and their columns.
BOOK_TABLES = {
    "cells": ("cell", "sheet string, ref string, t string, raw string, held string, style_index int, formula string"),
    **{name: (kind, ", ".join(x for x in ("sheet string, ref string" if kind in ("merge", "link", "sparkline") else "sheet string", sheet_parts.BODIES[kind]) if x)) for name, kind in (
        ("merges", "merge"), ("dimensions", "dim"), ("links", "link"), ("rules", "rule"), ("extension_rules", "extension"), ("views", "view"), ("sparklines", "sparkline"),
    )},
}


@dataclass
class Piece(InputPartition):
    """A file, or one sheet or slide of it."""

    file: str
    index: int | None = None
    name: str | None = None
    error: str | None = None


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def files(path: str, glob: str) -> list[str]:
    """Files of a folder and all folders in it, or the one file."""
    from pyarrow import fs

    store, at = _store(path)
    scheme = path[: len(path) - len(at)] if path.endswith(at) else ""
    info = store.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(scheme + f.path for f in found if f.is_file and fnmatch.fnmatch(f.base_name, glob))


def opened(file: str) -> Package:
    store, at = _store(file)
    return Package(store.open_input_file(at))


class Pieces(DataSourceReader):
    """Lists pieces, drops those that the filters rule out, and reads each by itself."""

    glob, by = "*", ()

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path, self.options = schema, options.get("path", ""), dict(options)
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in ("file_path", *self.by):
                name = f.attribute[0]
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def listed(self, package: Package) -> Iterator[tuple[int | None, str | None]]:
        yield None, None

    def rows(self, package: Package, piece: Piece) -> Iterator[dict]:
        raise NotImplementedError

    def keeps(self, column: str, value) -> bool:
        return column not in self.wanted or value in self.wanted[column]

    def partitions(self) -> list[Piece]:
        found = [f for f in files(self.path, self.glob) if self.keeps("file_path", f)]
        with ThreadPoolExecutor(16) as pool:
            pieces = [p for of in pool.map(self._pieces, found) for p in of]
        return pieces or [Piece("")]

    def _pieces(self, file: str) -> list[Piece]:
        try:
            return [Piece(file, i, n) for i, n in self.listed(opened(file)) if all(self.keeps(c, v) for c, v in zip(self.by, (i, n), strict=False))]
        except Exception as e:  # a broken file is one row, whatever is wrong with it
            return [] if any(c in self.wanted for c in self.by) else [Piece(file, error=str(e) or type(e).__name__)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target, held = to_arrow_schema(self.schema), []
        for row in self._safe(partition) if partition.file else ():
            held.append([row.get(f.name) for f in target])
            if len(held) == ROWS:
                yield self._batch(held, target)
                held = []
        if held:
            yield self._batch(held, target)

    def _safe(self, piece: Piece) -> Iterator[dict]:
        error = piece.error
        if error is None:
            try:
                for r in self.rows(opened(piece.file), piece):
                    yield r | {"file_path": piece.file}
            except Exception as e:
                error = str(e) or type(e).__name__
        if error is not None:
            yield {"file_path": piece.file, "error": error} | dict(zip(self.by, (piece.index, piece.name), strict=False))

    @staticmethod
    def _batch(rows: list[list], target: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)


class BookReader(Pieces):
    glob, by = "*.xlsx", ("sheet_idx", "sheet")

    def listed(self, package):
        return ((i, n) for i, n, _ in sheet_parts.listed(package))

    def rows(self, package, piece):
        import json

        kind = BOOK_TABLES[self.options.get("table", "cells")][0]
        names = [c.strip().split(" ")[0] for c in sheet_parts.TAGGED.split(",")]
        for r in sheet_parts.tagged(package, (kind,), piece.index):
            row = dict(zip(names, r, strict=True))
            row.pop("kind")
            yield row | json.loads(row.pop("body") or "{}")


class DeckReader(Pieces):
    glob, by = "*.pptx", ("slide",)
    columns = ("slide", "shape", "name", "placeholder", "trow", "tcol", "ord", "level", "auto_number", "text")

    def listed(self, package):
        return ((n, None) for n, _ in presentations.slide_parts(package))

    def rows(self, package, piece):
        return (dict(zip(self.columns, r, strict=True)) for r in presentations._texts(package, piece.index))


class DocumentReader(Pieces):
    glob = "*.docx"

    def rows(self, package, piece):
        names = [c.strip().split(" ")[0] for c in wordprocessing.RUNS.split(",")]
        return (dict(zip(names, r, strict=True)) for r in wordprocessing._runs(package))


class _Office(DataSource):
    kind: type[Pieces]

    def reader(self, schema: StructType) -> DataSourceReader:
        return self.kind(schema, self.options)


class OfficeBooks(_Office):
    """Option ``table``: one of :data:`BOOK_TABLES`, ``cells`` without it."""

    kind = BookReader

    @classmethod
    def name(cls) -> str:
        return "office_xlsx"

    def schema(self) -> str:
        table = self.options.get("table", "cells")
        if table not in BOOK_TABLES:
            raise ValueError(f"no table {table}; there are {', '.join(BOOK_TABLES)}")
        return f"file_path string, error string, sheet_idx int, {BOOK_TABLES[table][1]}"


class OfficeDecks(_Office):
    """Paragraphs of slides."""

    kind = DeckReader

    @classmethod
    def name(cls) -> str:
        return "office_pptx"

    def schema(self) -> str:
        return "file_path string, error string, slide int, shape int, name string, placeholder string, trow int, tcol int, ord int, level int, auto_number boolean, text string"


class OfficeDocuments(_Office):
    """Runs of documents."""

    kind = DocumentReader

    @classmethod
    def name(cls) -> str:
        return "office_docx"

    def schema(self) -> str:
        return f"file_path string, error string, {wordprocessing.RUNS}"


def register(spark: SparkSession) -> None:
    """Makes the formats known to the session, and lets Spark hand filters to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (OfficeBooks, OfficeDecks, OfficeDocuments):
        spark.dataSource.register(source)
