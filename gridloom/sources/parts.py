"""What packages of every kind hold: relationships, themes, media."""

from __future__ import annotations

import posixpath
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import media_type
from .packages import Package, attribute, below, child, local, read_packages

PACKAGES = "*.{xlsx,docx,pptx}"
# Slots of a theme in their order, and the first bytes of a PNG file.
SLOTS = ("dk1", "lt1", "dk2", "lt2", "accent1", "accent2", "accent3", "accent4", "accent5", "accent6", "hlink", "folHlink")
PNG = b"\x89PNG\r\n\x1a\n"


def _relations(package: Package):
    for rels in sorted(n for n in package.names if n.endswith(".rels")):
        folder, name = posixpath.split(rels)
        part = posixpath.join(posixpath.dirname(folder), name.removesuffix(".rels"))
        for rid, target in package.relations(part, external=True).items():
            yield part, rid, target


def relations(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """``part, id, target``: paths inside the package, external targets as they are."""
    return read_packages(spark, path, PACKAGES, _relations, "part string, id string, target string")


def _themes(package: Package):
    for part in sorted(n for n in package.names if "/theme/theme" in n and n.endswith(".xml")):
        root = package.xml(part)
        for scheme in below(root, "clrScheme"):
            found = {local(slot): next((attribute(c, "lastClr") or attribute(c, "val") for c in slot), None) for slot in scheme}
            for i, name in enumerate(SLOTS):
                yield part, "color", i, name, found.get(name)
        for i, kind in enumerate(("majorFont", "minorFont")):
            for font in below(root, kind):
                latin = child(font, "latin")
                yield part, "font", i, kind, attribute(latin, "typeface") if latin is not None else None


def themes(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """``part, kind, ord, slot, value``: the twelve colours and the two fonts of each theme."""
    return read_packages(spark, path, PACKAGES, _themes, "part string, kind string, ord int, slot string, value string")


def _media(package: Package):
    for part in sorted(n for n in package.names if "/media/" in n):
        yield part, package.zip.getinfo(part).file_size, *png_size(package.read(part)[:24])


def png_size(head: bytes) -> tuple[int | None, int | None]:
    """Width and height that a PNG file's first 24 bytes tell."""
    return struct.unpack(">II", head[16:24]) if head.startswith(PNG) and len(head) >= 24 else (None, None)


def media(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """``part, n_bytes, width, height, type`` of media files; their bytes stay in the package."""
    return read_packages(spark, path, PACKAGES, _media, "part string, n_bytes long, width int, height int").withColumn("type", media_type(F.col("part")))


def content(spark: SparkSession, path: str | DataFrame, names: list[str]) -> DataFrame:
    """``part, content`` of the named parts; no other part is inflated."""
    return read_packages(spark, path, PACKAGES, lambda p: ((n, p.read(n)) for n in names if n in p.names), "part string, content binary")
