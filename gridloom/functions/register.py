"""The functions as SQL names, for use in ``spark.sql``; scalar functions have SQL bodies, no Python in the rows."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..sources import sheet_parts, wordprocessing
from ..sources.packages import Package
from . import format_codes

_SQL = {
    "a1_row(ref string) returns int": "cast(nullif(regexp_extract(upper(replace(ref, '$', '')), '^[A-Z]{1,3}([0-9]+)$', 1), '') as int)",
    "a1_col(ref string) returns int": "aggregate(transform(filter(split(regexp_extract(upper(replace(ref, '$', '')), '^([A-Z]{1,3})', 1), ''), c -> c <> ''), c -> ascii(c)), 0, (a, c) -> a * 26 + c - 64)",
    "col_letter(n int) returns string": "concat(if(n > 702, char(65 + cast(floor((n - 703) / 676) as int) % 26), ''), if(n > 26, char(65 + cast(floor((n - 27) / 26) as int) % 26), ''), char(65 + (n - 1) % 26))",
    "excel_round(x double, d int) returns double": "floor(x * pow(10, d) + 0.5) / pow(10, d)",
    "excel_mod(a double, b double) returns double": "if(b <> 0, a - floor(try_divide(a, b)) * b, null)",
    # Digits of a number without zeros at their ends, and the place of its point before or after their first.
    "js_digits(x double) returns string": "regexp_replace(replace(substring_index(cast(abs(x) as string), 'E', 1), '.', ''), '^0+|0+$', '')",
    "js_point(x double) returns int": "length(substring_index(substring_index(cast(abs(x) as string), 'E', 1), '.', 1)) + coalesce(try_cast(regexp_extract(cast(abs(x) as string), 'E(-?[0-9]+)$', 1) as int), 0) - length(regexp_extract(replace(substring_index(cast(abs(x) as string), 'E', 1), '.', ''), '^0*', 0))",
    "js_number_text(x double) returns string": """case when x is null then null when isnan(x) then 'NaN' when x = 0 then '0' else concat(if(x < 0, '-', ''), case when abs(x) = double('infinity') then 'Infinity'
      when js_point(x) between length(js_digits(x)) and 21 then rpad(js_digits(x), js_point(x), '0') when js_point(x) between 1 and 21 then concat(left(js_digits(x), js_point(x)), '.', substr(js_digits(x), js_point(x) + 1))
      when js_point(x) between -5 and 0 then concat('0.', repeat('0', -js_point(x)), js_digits(x))
      else concat(left(js_digits(x), 1), if(length(js_digits(x)) > 1, concat('.', substr(js_digits(x), 2)), ''), 'e', if(js_point(x) > 0, '+', '-'), cast(abs(js_point(x) - 1) as string)) end) end""",
    "excel_divide(a double, b double) returns double": "coalesce(try_divide(a, b), 0)",
    "excel_format(x double, code string) returns string": format_codes.sql_body("x", "code"),
    "excel_format_text(x string, code string) returns string": f"transform(array(named_struct('x', x, 'spec', {format_codes.compiled('code')})), v -> {format_codes.shown_text('v.x', 'v.spec')})[0]",
}


@udtf(returnType="sheet string, ref string, value string, formula string, error string")
class OfficeCells:
    """Cells of a workbook's bytes, a row each: ``select * from files, lateral office_cells(content)``; a broken file is one row with its error."""

    def eval(self, content: bytes):
        try:
            for _, _, sheet, ref, kind, raw, held, _, formula, _ in sheet_parts.tagged(Package(content), ("cell",)):
                yield sheet, ref, held if kind in ("s", "inlineStr") else raw, formula, None
        except Exception as e:
            yield None, None, None, None, str(e) or type(e).__name__


@udtf(returnType="block int, text string, error string")
class OfficeText:
    """Paragraphs of a document's bytes; a broken file is one row with its error."""

    def eval(self, content: bytes):
        try:
            runs = (r for r in wordprocessing._runs(Package(content)) if r[9] == "text" and not r[12])
            for (block, *_), held in groupby(runs, key=lambda r: r[:5]):
                yield block, "".join(r[10] for r in held), None
        except Exception as e:
            yield None, None, str(e) or type(e).__name__


def register(spark: SparkSession) -> list[str]:
    """The names of the functions; ``office_cells`` and ``office_text`` are table functions."""
    spark.udtf.register("office_cells", OfficeCells)
    spark.udtf.register("office_text", OfficeText)
    for head, body in _SQL.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
    return [*(h.partition("(")[0] for h in _SQL), "office_cells", "office_text"]
