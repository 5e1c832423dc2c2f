"""Parts of ZIP packages: one row a part, read in parallel, with a cap on inflated sizes."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from typing import BinaryIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Bytes that an entry may have inflated; rows of a package that are held before they are handed on.
MOST_ENTRY_BYTES, HELD = 512 << 20, 50_000


class PackageError(ValueError):
    pass


class _Bounded:
    """An entry as it is inflated: no more than ``most`` bytes, and no entities."""

    def __init__(self, held, path: str, most: int):
        self.held, self.path, self.left, self.tail = held, path, most, b""

    def read(self, n: int = -1) -> bytes:
        data = self.held.read(n)
        self.left -= len(data)
        if self.left < 0:
            raise PackageError(f"{self.path} is too large")
        if b"<!DOCTYPE" in (seen := self.tail + data) or b"<!ENTITY" in seen:
            raise PackageError(f"{self.path} declares entities")
        self.tail = seen[-9:]
        return data


class Package:
    def __init__(self, data: bytes | BinaryIO, most: int = MOST_ENTRY_BYTES):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data) if isinstance(data, (bytes, bytearray, memoryview)) else data)
        except zipfile.BadZipFile as e:
            raise PackageError(f"not a package: {e}") from e
        self.most, self.names = most, set(self.zip.namelist())

    def read(self, path: str) -> bytes | None:
        if path not in self.names:
            return None
        with self.zip.open(path) as f:
            data = f.read(self.most + 1)  # counts what is inflated, whatever the directory says
        if len(data) > self.most:
            raise PackageError(f"{path} is larger than {self.most} bytes")
        return data

    def xml(self, path: str) -> ElementTree.Element | None:
        data = self.read(path)
        if data is None:
            return None
        if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
            raise PackageError(f"{path} declares entities")
        return ElementTree.fromstring(data)

    def elements(self, path: str, name: str | set[str]) -> Iterator[ElementTree.Element]:
        """Outermost elements of a name, or of some names, one after the other as they are read; each is gone when the next comes, and what is in none of them as it ends."""
        if path not in self.names:
            return
        names = {name} if isinstance(name, str) else name
        with self.zip.open(path) as f:
            open_, within = [], 0
            for event, e in ElementTree.iterparse(_Bounded(f, path, self.most), events=("start", "end")):
                if event == "start":
                    open_.append(e)
                    within += local(e) in names
                    continue
                open_.pop()
                if local(e) in names:
                    within -= 1
                    if not within:
                        yield e
                if not within and open_:
                    open_[-1].remove(e)

    def contents(self, path: str, holder: str, opened: dict[str, str | bool | None]) -> Iterator[ElementTree.Element]:
        """What the root's child ``holder`` has in it, one after the other as it is read; each is gone when the next comes.

        What ``opened`` names is not given out: its own content is (True), that of its first child of a name, or none.
        """
        found = False
        with self.zip.open(path) as f:
            open_ = []  # elements with True where content is given out, or the name of the child that has it
            for event, e in ElementTree.iterparse(_Bounded(f, path, self.most), events=("start", "end")):
                name, above = local(e), open_[-2 if event == "end" else -1] if len(open_) > (event == "end") else None
                if event == "start":
                    how = holder if above is None else opened.get(name) if above[1] is True else None
                    if above is not None and above[1] == name:
                        how, above[1], found = True, None, True
                    open_.append([e, how])
                    continue
                open_.pop()
                if above is not None and above[1] is True and name not in opened:
                    yield e
                if above is not None and (above[1] is True or len(open_) == 1):
                    above[0].remove(e)
        if not found:
            raise PackageError(f"{path} has no {holder}")

    def relations(self, part: str, external: bool = False) -> dict[str, str]:
        """Relationship id -> part path, inside the package only, or also ``external`` targets as they are."""
        folder, name = posixpath.split(part)
        root, out = self.xml(f"{folder}/_rels/{name}.rels" if folder else f"_rels/{name}.rels"), {}
        for r in root if root is not None else ():
            target = r.get("Target", "")
            if r.get("TargetMode") == "External":
                if external:
                    out[r.get("Id")] = target
            else:
                path = posixpath.normpath(target[1:] if target.startswith("/") else posixpath.join(folder, target))
                if not path.startswith(".."):
                    out[r.get("Id")] = path
        return out


def local(element) -> str:
    return element.tag.rpartition("}")[2]


def attribute(element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == name), None)


def child(element, name: str):
    return next((e for e in element if local(e) == name), None)


def frame(element) -> tuple:
    """Place of a drawn element: ``x, y, w, h``, a group's own space, degrees of its turn, and whether it is mirrored; nulls where it says nothing."""
    holder = next((c for c in element if local(c) in ("spPr", "grpSpPr")), element)
    held = child(holder, "xfrm")
    if held is None:
        return (None,) * 11
    lengths = [int(attribute(c, a)) if (c := child(held, tag)) is not None else None for tag, a in (("off", "x"), ("off", "y"), ("ext", "cx"), ("ext", "cy"), ("chOff", "x"), ("chOff", "y"), ("chExt", "cx"), ("chExt", "cy"))]
    return *lengths, int(attribute(held, "rot") or 0) / 60000, *(attribute(held, a) in ("1", "true") for a in ("flipH", "flipV"))


#: Columns of :func:`frame`.
FRAME = "x long, y long, w long, h long, ch_x long, ch_y long, ch_w long, ch_h long, rot double, flip_h boolean, flip_v boolean"


def shape_tree(element, group=None, count=None) -> Iterator[tuple]:
    """(ordinal, ordinal of the group, element) of drawn elements, groups before what they hold."""
    count = count if count is not None else iter(range(1 << 30))
    for e in element:
        if local(e) in ("sp", "pic", "cxnSp", "graphicFrame", "grpSp", "wsp", "wgp"):
            at = next(count)
            yield at, group, e
            if local(e) in ("grpSp", "wgp"):
                yield from shape_tree(e, at, count)


def below(element, name: str) -> Iterator:
    return (e for e in element.iter() if local(e) == name)


def read_packages(spark: SparkSession, path: str | DataFrame, glob: str, rows: Callable[[Package], Iterator[tuple]], schema: str, most: int = MOST_ENTRY_BYTES) -> DataFrame:
    """``file_path``, ``error`` and the rows that ``rows`` yields for each package.

    A broken package is one row with its error; one of more than ``HELD`` rows, of
    which some have been handed on when the fault shows, has that row last.

    ``path`` is a folder, or a table with the ``path`` and ``content`` of files.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    files = path if isinstance(path, DataFrame) else spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    files = files.select("path", "content")

    def of(file: str, content: bytes) -> Iterator[list[tuple]]:
        held, handed = [], False
        try:
            for r in rows(Package(content, most)):
                held.append((file, None, *r))
                if len(held) == HELD:
                    yield held
                    held, handed = [], True
        except Exception as e:  # whatever a broken file does, it costs its own row alone
            held = (held if handed else []) + [(file, str(e) or type(e).__name__, *[None] * len(names))]
        yield held

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                for found in of(file, content):
                    yield pd.DataFrame(found, columns=["file_path", "error", *names], dtype=object)

    return files.mapInPandas(work, f"file_path string, error string, {schema}")
