"""The office formats as data sources, and the one pass over a sheet behind them."""

from __future__ import annotations

import zipfile

import pytest
from pyspark.sql import functions as F

from gridloom.plans import made
from gridloom.sources import datasources, presentations, sheet_parts, spreadsheets, wordprocessing
from gridloom.sources.packages import Package

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("office")
    for files in (made.workbooks(spark, SF), made.decks(spark, SF), made.documents(spark, SF)):
        for r in files.limit(4).collect() if files is not None else ():
            (root / r.path).write_bytes(r.content)
    (root / "broken.xlsx").write_bytes(b"PK no package")
    datasources.register(spark)
    return str(root)


def load(spark, folder, kind, **options):
    return spark.read.format(kind).options(**options).load(folder)


def same(a, b, columns):
    name = F.substring_index("file_path", "/", -1)
    rows = [sorted(map(repr, x.where("error is null").withColumn("file_path", name).select("file_path", *columns).collect())) for x in (a, b)]
    assert rows[0] == rows[1] and rows[0]


def test_a_task_a_sheet(spark, folder):
    cells = load(spark, folder, "office_xlsx")
    books = spreadsheets.sheets(spark, folder).where("error is null").count()
    assert cells.rdd.getNumPartitions() == books + 1  # and the broken file
    assert [r.error is not None for r in cells.where("error is not null").collect()] == [True]
    one = cells.where("sheet = 'segments'")
    assert one.rdd.getNumPartitions() == books / 2
    assert one.select("sheet_idx").distinct().collect() == [(1,)]
    assert cells.where("sheet_idx in (0) and sheet = 'segments'").rdd.getNumPartitions() == 1
    typed = spreadsheets.typed(cells.withColumn("kind", F.lit("cell")))
    same(typed.withColumn("error", F.lit(None)), spreadsheets.cells(spark, folder).withColumn("error", F.lit(None)), ["sheet_idx", "ref", "v_type", "v_num", "v_text", "formula"])


@pytest.mark.parametrize(("table", "reader"), [("merges", spreadsheets.merges), ("dimensions", spreadsheets.dimensions), ("rules", spreadsheets.format_rules), ("links", spreadsheets.hyperlinks), ("views", spreadsheets.views), ("sparklines", spreadsheets.sparklines)])
def test_tables_of_sheets(spark, folder, table, reader):
    plain = reader(spark, folder)
    same(load(spark, folder, "office_xlsx", table=table), plain, [c for c in plain.columns if c not in ("file_path", "error")])


def test_only_the_columns_of_the_schema(spark, folder):
    got = spark.read.format("office_xlsx").schema("ref string, file_path string").load(folder)
    assert got.columns == ["ref", "file_path"] and got.where("ref = 'A1'").count() == 8
    with pytest.raises(Exception, match="no table"):
        load(spark, folder, "office_xlsx", table="nothing").count()


def test_decks_and_documents(spark, folder):
    texts = load(spark, folder, "office_pptx")
    same(texts, presentations.paragraphs(spark, folder), ["slide", "shape", "ord", "text", "trow"])
    assert texts.where("slide = 1").rdd.getNumPartitions() == 4
    same(load(spark, folder, "office_docx"), wordprocessing.runs(spark, folder), ["block", "run", "text", "kind"])


def test_each_part_is_opened_once(spark, folder, monkeypatch):
    opened = []
    held = zipfile.ZipFile.open
    monkeypatch.setattr(zipfile.ZipFile, "open", lambda self, name, *a, **k: opened.append(getattr(name, "filename", name)) or held(self, name, *a, **k))
    with open(f"{folder}/{sorted(r.file_path for r in spreadsheets.sheets(spark, folder).where('error is null').collect())[0].rpartition('/')[2]}", "rb") as f:
        rows = list(sheet_parts.tagged(Package(f)))
    assert {k for k, *_ in rows} == {"cell", "dim", "merge", "rule", "link", "view", "sparkline"}
    sheets = [n for n in opened if n.startswith("xl/worksheets/sheet")]
    assert sorted(sheets) == sorted(set(sheets)) and len(sheets) == 2


def test_read_once(spark, folder, tmp_path):
    parts = sheet_parts.read_once(spark, folder, str(tmp_path / "parts"))
    same(sheet_parts.of_kind(parts, "rule"), spreadsheets.format_rules(spark, folder), ["sheet_idx", "cf_idx", "priority", "colors"])
    assert spreadsheets.typed(parts).count() == spreadsheets.cells(spark, folder).count()
    assert sheet_parts.of_kind(parts, "merge").where("error is not null").count() == 1
