"""Table-driven values of the scalar functions."""

from __future__ import annotations

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import a1, colors, criteria, dates, eras, formats, guides, kinds, labels, numbers, register, text
from gridloom.operators import joins, order_stats


def value(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


def values(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()[0])


def test_column_letters(spark):
    table = {1: "A", 26: "Z", 27: "AA", 702: "ZZ", 703: "AAA", 16384: "XFD"}
    assert values(spark, *[a1.column_letters(F.lit(n)) for n in table]) == list(table.values())
    every = spark.range(1, a1.MOST_COLUMNS + 1).select(F.col("id").cast("int").alias("n"))
    assert every.where(a1.column_number(a1.a1(F.lit(3), F.col("n"))) != F.col("n")).count() == 0


def test_references(spark):
    got = values(spark, *[f(F.lit(x)) for x in ("B12", "$AA$3", "c7", "12") for f in (a1.column_number, a1.row_number)])
    assert got == [2, 12, 27, 3, 3, 7, None, None]
    r = value(spark, a1.rectangle(F.lit("D9:B2")))
    assert (r.top, r.left, r.bottom, r.right) == (2, 2, 9, 4)
    inside = [a1.inside(a1.rectangles(F.lit("A1:B2  D4")), F.lit(r), F.lit(c)) for r, c in ((1, 2), (4, 4), (3, 1))]
    assert values(spark, *inside) == [True, True, False]
    assert values(spark, a1.sheet_of(F.lit("'It''s'!$B$2:$B$9")), a1.range_of(F.lit("'It''s'!$B$2:$B$9")), a1.sheet_of(F.lit("S!A1")), a1.sheet_of(F.lit("A1"))) == ["It's", "$B$2:$B$9", "S", None]


def test_arithmetic(spark):
    l = lambda x: F.lit(float(x))  # noqa: E731, E741
    got = values(
        spark, numbers.round_half_up(l(-2.5)), numbers.round_down(l(-2.7)), numbers.round_up(l(-2.1)), F.floor(l(-1.2)), numbers.modulo(l(-7), l(3)), numbers.modulo(l(7), l(-3)), numbers.divide(l(1), l(0)),
        numbers.modulo(l(1), l(0)), numbers.to_number(F.lit(" 12abc")), numbers.to_number(F.lit("x")), numbers.round_half_up(l(1234.5), -2), numbers.ceiling(l(7), l(0)), numbers.floor(l(7), l(3)),
    )
    assert got == [-2, -2, -3, -2, 2, -2, 0, None, 12, 0, 1200, 0, 6]
    assert values(spark, numbers.number_text(l(1)), numbers.number_text(l(12345678.9)), numbers.number_text(l(-0.25))) == ["1", "12345678.9", "-0.25"]


def test_text(spark):
    s = F.lit("abc")
    assert values(spark, text.trim(F.lit("  a  b ")), text.mid(s, 0, 2), text.find("z", s), text.search("B", s), text.right(s, 2), text.left(s, -1), text.concatenate(s, F.lit(None), F.lit(1))) == ["a b", "ab", None, 2, "bc", "", "abc1"]


def test_dates(spark):
    l = F.lit  # noqa: E741
    got = values(spark, dates.date(l(2024), l(1), l(1)), dates.date(l(2019), l(13), l(1)), dates.weekday(l(45298), 1), dates.weekday(l(45298), 2), dates.weekday(l(45298), 3), dates.from_serial(l(45292.75)))
    assert got == [45292, 43831, 1, 7, 6, datetime.date(2024, 1, 1)]


@pytest.mark.parametrize(
    ("x", "code", "shown"),
    [
        (1234567.891, "#,##0.00", "1,234,567.89"), (0.125, "0%", "13%"), (12345, "0.00E+00", "1.23E+04"), (2.25, "[h]:mm", "54:00"), (45292, "d-mmm-yy", "1-Jan-24"), (-5, "0;(0)", "(5)"), (-5, "0", "-5"),
        (0, '0;(0);"none"', "none"), (7, '"#"000', "#007"), (45292.5, "yyyy-mm-dd h:mm AM/PM", "2024-01-01 12:00 PM"), (45292.0625, "hh:mm:ss", "01:30:00"), (3, "General", "3"), (1234.5, '[$€-407] #,##0.0', "€ 1,234.5"), (2.5, "0", "3"),
    ],
)
def test_formats(spark, x, code, shown):
    assert value(spark, formats.format_value(F.lit(float(x)), code)) == shown


def test_colors(spark):
    stops = [(F.lit(0.0), "#FF0000"), (F.lit(10.0), "#00FF00")]
    got = values(spark, *[colors.scale_color(F.lit(x), stops) for x in (-1.0, 5.0, 11.0)], colors.tint(F.lit("#4472C4"), 0.0), colors.tint(F.lit("#000000"), 0.5), colors.tint(F.lit("#FFFFFF"), -0.5))
    assert got == ["#FF0000", "#808000", "#00FF00", "#4472C4", "#808080", "#808080"]


def test_criteria(spark):
    rows = spark.createDataFrame([(1.0, "1"), (5.0, "5"), (None, None), (3.0, "x")], "n double, s string")
    count = lambda c: rows.where(c).count()
    assert count(criteria.matches(F.col("n"), ">2", True)) == 2
    assert count(criteria.matches(F.col("s"), "", False)) == 1
    assert count(criteria.matches(F.col("s"), "<>x", False)) == 3
    assert count(criteria.number_rule(F.col("n"), "notBetween", 2, 4)) == 2
    assert count(criteria.text_rule(F.col("s"), "containsText", "X")) == 1
    assert values(spark, criteria.all_of(), criteria.any_of(), criteria.all_of(F.lit(None).cast("boolean"))) == [True, False, False]


def test_labels(spark):
    got = values(spark, labels.media_type(F.lit("a/b.PNG")), labels.media_type(F.lit("x")), labels.alignment(F.lit("both")), labels.field_kind(F.lit("  page \\* x")), labels.toggle(F.lit(True), F.lit("off")), labels.toggle(F.lit(False), F.lit("1")), labels.placeholders(F.lit("%1.%2)"), [F.lit(3), F.lit(7)]))
    assert got == ["image/png", "application/octet-stream", "justify", "PAGE", False, None, "3.7)"]


def test_sql_names(spark):
    assert {"a1_row", "a1_col", "col_letter", "excel_round", "excel_mod", "excel_divide", "js_number_text", "office_cells", "office_text"} <= set(register.register(spark))
    row = spark.sql("select a1_col('$AB$7') c, a1_row('ab7') r, col_letter(703) l, excel_round(-2.5D, 0) x, excel_mod(-7D, 3D) m, excel_divide(1D, 0D) d").collect()[0]
    assert tuple(row) == (28, 7, "AAA", -2.0, 2.0, 0.0)
    shown = spark.createDataFrame([(x,) for x in (1e-12, 0.000001, -0.0001, 123456789.125, 1e20, 1e21, 0.0, -7.0, 1200.0, 1.25e300)], "x double").select(F.expr("js_number_text(x)").alias("sql"), numbers.number_text(F.col("x")).alias("column")).collect()
    assert [r.sql for r in shown] == [r.column for r in shown]


def test_table_functions(spark):
    from .test_sources import DOCUMENT, WORKBOOK, package

    register.register(spark)
    spark.createDataFrame([("b", bytearray(package(WORKBOOK))), ("d", bytearray(package(DOCUMENT)))], "name string, content binary").createOrReplaceTempView("packages")
    cells = spark.sql("select sheet, ref, value from packages, lateral office_cells(content) where name = 'b' and ref in ('A1', 'D1', 'B7')").collect()
    assert sorted(map(tuple, cells)) == [("42", "B7", "7"), ("One", "A1", "plain"), ("One", "D1", "1.5")]
    texts = spark.sql("select block, text from packages, lateral office_text(content) where name = 'd' and text <> ''").collect()
    assert ("Hello new") in {r.text for r in texts}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([0.0, 1.0, 1.5, -2.0, 7.25, 9.0]), min_size=1, max_size=40), st.data())
def test_order_statistics(spark, numbers_, data):
    k = data.draw(st.integers(0, len(numbers_) - 1))
    df = spark.createDataFrame([(x,) for x in numbers_] + [(None,)], "v double")
    assert order_stats.kth_smallest(df, F.col("v"), k) == sorted(numbers_)[k]


def test_order_statistics_in_brackets(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "BRACKET", 50)
    df = spark.range(20_000).select(((F.col("id") * 7919) % 20_011).cast("double").alias("v"))
    every = sorted(r.v for r in df.collect())
    for k in (0, 3, 9_999, 17_000, 19_999):
        assert order_stats.kth_smallest(df, F.col("v"), k) == every[k]
    assert order_stats.kth_smallest(df, F.col("v"), 20_000) is None
    small = spark.createDataFrame([(x,) for x in (1.0, 2.0, 4.0, 8.0)], "v double")
    assert order_stats.nearest_percentile(small, F.col("v"), 50) == 4.0
    assert order_stats.top_threshold(spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "v double"), F.col("v"), 2) == 2.0


def test_salted_join(spark):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(2, 0)], "k int, i int")
    right = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "k int, s string")
    assert sorted(joins.salted(left, right, "k", 4).collect()) == sorted(left.join(right, "k").select("k", "i", "s").collect())


def test_color_changes(spark):
    c = F.lit("#156082")
    got = values(spark, colors.changed(c, [("shade", 0.0)]), colors.changed(c, [("shade", 1.0)]), colors.changed(c, [("tint", 0.0)]), colors.changed(c, [("tint", 1.0)]), colors.changed(c, [("lumMod", 1.0), ("alpha", 0.5)]), colors.changed(c, [("lumOff", 1.0)]), colors.changed(c, [("unknown", 3.0)]))
    assert got == ["#000000", "#156082", "#156082", "#FFFFFF", "#15608280", "#FFFFFF", "#156082"]


def test_eras(spark):
    days = {"2019-04-30": ("平成", 31), "2019-05-01": ("令和", 1), "1989-01-07": ("昭和", 64), "1912-07-30": ("大正", 1), "1867-05-05": ("明治", 1867)}
    got = values(spark, *[c for d in days for c in (eras.era_name(F.lit(d).cast("date")), eras.era_year(F.lit(d).cast("date")))])
    assert got == [x for pair in days.values() for x in pair]
    assert values(spark, eras.weekday_name(F.lit("2024-01-03").cast("date")), eras.weekday_name(F.lit("2024-01-07").cast("date"), True)) == ["水", "日曜日"]


def test_guides(spark):
    shape = spark.createDataFrame([(100.0, 50.0)], "w double, h double")
    steps = [("a", "pin 0 60000 50000"), ("x", "*/ ss a 100000"), ("y", "+- r 0 x"), ("z", "?: l x y"), ("s", "sin 10 5400000"), ("q", "at2 1 1"), ("n", "*/ 1 1 0"), ("c", "val 3cd4")]
    row = guides.guides(shape, "w", "h", steps).collect()[0]
    assert (row.a, row.x, row.y, row.z, row.n, row.c) == (50000, 25, 75, 75, None, 16_200_000)
    assert (round(row.s, 9), round(row.q, 3)) == (10, 2_700_000)
    with pytest.raises(ValueError, match="unknown operator"):
        guides.formula("pow 2 3", {})


def test_kinds(spark):
    none, text_, flag = F.lit(None).cast("double"), F.lit("12x"), F.lit(True)
    assert values(spark, kinds.value(none, text_), kinds.n(none, flag), kinds.t(F.lit(None)), kinds.is_error(none, F.lit(None)), kinds.log10(F.lit(-1.0)), kinds.first_true((F.lit(False), F.lit(1)), (F.lit(True), F.lit(2)))) == [12, 1, "", True, None, 2]


def test_number_text_and_large_numbers(spark):
    rows = [(1e-12, "1e-12"), (1.5e-7, "1.5e-7"), (0.000001, "0.000001"), (123456789.125, "123456789.125"), (1e20, "100000000000000000000"), (1e21, "1e+21"), (1.25e300, "1.25e+300"), (-0.5, "-0.5"), (0.0, "0"), (-7.0, "-7"), (0.1, "0.1"), (1200.0, "1200")]
    got = spark.createDataFrame([(r[0],) for r in rows], "x double").select("x", numbers.number_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in got] == [r[1] for r in rows]
    odd = spark.createDataFrame([(1e30,), (9.9999,), (None,), (0.005,)], "x double").select(formats.format_value(F.col("x"), "0.00").alias("f"), formats.format_value(F.col("x"), "0.00E+00").alias("e")).collect()
    assert [r.f for r in odd] == ["1" + "0" * 30 + ".00", "10.00", None, "0.01"]
    assert [r.e for r in odd] == ["1.00E+30", "1.00E+01", None, "5.00E-03"]


def test_criteria_take_plain_digits(spark):
    df = spark.createDataFrame([("1e5", 100000.0), ("nan", 1.0), ("5", 5.0)], "s string, n double")
    count = lambda c: df.where(c).count()
    assert count(criteria.matches(F.col("n"), "1e5", True)) == 0 and count(criteria.matches(F.col("s"), "1e5", False)) == 1
    assert count(criteria.matches(F.col("n"), "nan", True)) == 0 and count(criteria.matches(F.col("n"), "1_0", True)) == 0
    assert count(criteria.text_rule(F.col("s"), "between", "3", "9")) == 1 and count(criteria.text_rule(F.col("s"), "notBetween", "3", "9")) == 2
