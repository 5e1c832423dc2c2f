"""Queries over packages made of the test tables: most readers and query tools against SQL over the tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import tools
from ..operators import documents as docs
from ..operators import packages as lookups
from ..sources import parts, presentations, spreadsheets, wordprocessing
from . import made
from .registry import Registry

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql

_ROWS = """with c as (select *, 'n' || c_nationkey || '.xlsx' as file_path, (row_number() over (partition by c_nationkey order by c_custkey) + 1)::int as r, (count(*) over (partition by c_nationkey) + 1)::int as last from customer),
s as (select c_nationkey, file_path, c_mktsegment, count(*) as n, row_number() over (partition by c_nationkey order by c_mktsegment)::int as r from c group by c_nationkey, file_path, c_mktsegment),
b as (select distinct c_nationkey, file_path, last from c)
"""
_DOCS = """with c as (select *, 'n' || c_nationkey || '.docx' as file_path, row_number() over (partition by c_nationkey order by c_custkey)::int as block from customer join nation on c_nationkey = n_nationkey),
s as (select file_path, c_mktsegment, count(*) as n, (row_number() over (partition by file_path order by c_mktsegment) - 1)::int as trow from c group by file_path, c_mktsegment),
b as (select file_path, n_name, count(*)::int + 1 as tbl_block from c group by file_path, n_name)
"""
_DECKS = """with s as (select *, 'r' || n_regionkey || '.pptx' as file_path, (row_number() over (partition by n_regionkey order by n_nationkey desc) - 1)::int as slide, count(*) over (partition by n_regionkey) as slide_count from nation)
"""
_fine = "error is null"


@_r.query(_ROWS + "select file_path, sheet_idx, name from b, (values (0, 'customers'), (1, 'segments')) v(sheet_idx, name)")
def office_sheets(spark, sf_dir):
    return tools.xlsx_get_sheet_names(spark, made.workbooks(spark, sf_dir))


@_r.query(_ROWS + "select file_path, false as broken, 2::bigint as n from b union all select 'broken.xlsx', true, 1")
def office_broken(spark, sf_dir):
    """A file that is no package costs one row, the others none."""
    found = spreadsheets.sheets(spark, made.workbooks(spark, sf_dir))
    return found.groupBy("file_path", F.col("error").isNotNull().alias("broken")).agg(F.count("*").alias("n"))


@_r.query(_ROWS + """select file_path, 0 as sheet_idx, x[1] || r as ref, x[2] as v_type, x[3]::double as v_num, x[4] as v_text, x[5]::boolean as v_bool, x[6] as v_err, x[7]::int as style_index, x[8] as formula from (select file_path, r, unnest([
  ['A', 'number', c_custkey::varchar, null, null, null, '0', null], ['B', 'text', null, c_name, null, null, '0', null], ['C', 'text', null, c_mktsegment, null, null, '0', null], ['D', 'number', c_acctbal::varchar, null, null, null, '1', null],
  ['E', 'number', (c_acctbal * 2)::varchar, null, null, null, '0', 'D' || r || '*2'], case when c_custkey % 3 = 0 then ['F', 'bool', null, null, (c_acctbal >= 0)::varchar, null, '0', null] end,
  case when c_custkey % 5 = 0 then ['G', 'error', null, null, null, '#N/A', '0', null] end, case when c_custkey % 7 = 0 then ['H', 'text', null, 'in ' || c_custkey, null, null, '0', null] end]) as x from c) where x is not null
union all select file_path, 0, chr(64 + i) || '1', 'text', null, (['key', 'name', 'segment', 'balance', 'twice'])[i], null, null, 0, null from b, (select unnest(range(1, 6))::int as i)
union all select file_path, 1, x[1] || r, x[2], x[3]::double, x[4], null, null, 0, null from (select file_path, r, unnest([['A', 'text', null, c_mktsegment], ['B', 'number', n::varchar, null], ['C', 'number', (case when n % 2 = 1 then 0 else n end)::varchar, null]]) as x from s)
""")
def office_cells(spark, sf_dir):
    """Typed cells of all sheets: shared, rich, inline and formula strings, numbers, booleans, errors."""
    return spreadsheets.cells(spark, made.workbooks(spark, sf_dir)).select("file_path", "sheet_idx", "ref", "v_type", "v_num", "v_text", "v_bool", "v_err", "style_index", "formula")


@_r.query(_ROWS + "select file_path, 'customers' as sheet, 'E' || r as ref, 'D' || r || '*2' as formula from c")
def office_formulas(spark, sf_dir):
    return tools.xlsx_get_formulas(spark, made.workbooks(spark, sf_dir), "0").select("file_path", "sheet", "ref", "formula")


@_r.query(_ROWS + """select file_path, 'customers' as sheet, last as max_row, (case when max(c_custkey % 7 = 0) then 8 when max(c_custkey % 5 = 0) then 7 when max(c_custkey % 3 = 0) then 6 else 5 end)::int as max_col,
  case when max(c_custkey % 7 = 0) then 'H' when max(c_custkey % 5 = 0) then 'G' when max(c_custkey % 3 = 0) then 'F' else 'E' end as max_col_letter from c group by file_path, last""")
def office_dimensions(spark, sf_dir):
    return tools.xlsx_get_sheet_dimensions(spark, made.workbooks(spark, sf_dir), "customers")


@_r.query(_ROWS + "select file_path, x[1] || r as ref, r as \"row\", x[2]::int as col, x[3] as v_type from (select file_path, r, unnest([['B', '2', 'text'], ['C', '3', 'text'], ['D', '4', 'number']]) as x from c where r <= 3)")
def office_range(spark, sf_dir):
    """D3:B2 of each book."""
    return tools.xlsx_get_cell_range(spark, made.workbooks(spark, sf_dir), "customers", "D3:B2").select("file_path", "ref", "row", "col", "v_type")


@_r.query(_ROWS + """, h as (select file_path, 'customers' as sheet, 'C' || r as ref, c_mktsegment as value from c where c_mktsegment ilike '%machin%' union all select file_path, 'segments', 'A' || r, c_mktsegment from s where c_mktsegment ilike '%machin%')
select *, count(*) over (partition by file_path) as match_count from h""")
def office_search(spark, sf_dir):
    return tools.xlsx_search_cells(spark, made.workbooks(spark, sf_dir), "Machin").select("file_path", "sheet", "ref", "value", "match_count")


@_r.query(_ROWS + "select file_path, 0 as sheet_idx, 'A' || (last + 2) || ':C' || (last + 3) as ref from b")
def office_merges(spark, sf_dir):
    return spreadsheets.merges(spark, made.workbooks(spark, sf_dir)).where(_fine).drop("error")


@_r.query(_ROWS + "select file_path, i as sheet_idx, 'balances' as name, case i when 0 then 'customers!$D$2:$D$' || last else 'segments!$B$1' end as formula from b, (values (0), (1)) v(i)")
def office_names(spark, sf_dir):
    """Names that each sheet sees: its own before the book's."""
    books = made.workbooks(spark, sf_dir)
    names = spreadsheets.defined_names(spark, books).where(_fine).withColumn("ord", F.coalesce("local_sheet", F.lit(-1)))
    return lookups.names_of_sheet(names, spreadsheets.sheets(spark, books).where(_fine).select("file_path", "sheet_idx"), ["file_path"])


@_r.query(_ROWS + "select file_path, (5 + sum(case when c_custkey % 4 <> 0 then 5 + (c_custkey % 3 = 0)::int else 0 end))::bigint as n, last::bigint - 1 - sum((c_custkey % 4 = 0)::int)::bigint as shown from c group by file_path, last")
def office_visible(spark, sf_dir):
    """Cells outside hidden rows and columns."""
    books = made.workbooks(spark, sf_dir)
    seen = spreadsheets.visible(spreadsheets.cells(spark, books), spreadsheets.dimensions(spark, books).where(_fine)).where("sheet_idx = 0")
    return seen.groupBy("file_path").agg(F.count("*").alias("n"), (F.count_distinct("row") - 1).alias("shown"))


@_r.query(_ROWS + """select file_path, 'D2:D' || last || ' F2:F' || last as sqref, t as type, p::int as priority, (case t when 'top10' then 3 end)::int as rank, (case t when 'top10' then 0 end)::int as dxf_id, case t when 'top10' then '' else 'min,max' end as stops,
  case t when 'top10' then '' else 'FFFF0000,FF00FF00' end as colors from b, (values ('top10', 2), ('colorScale', 1)) v(t, p)""")
def office_rules(spark, sf_dir):
    found = spreadsheets.format_rules(spark, made.workbooks(spark, sf_dir)).where(_fine)
    return found.select("file_path", "sqref", "type", "priority", "rank", "dxf_id", F.array_join("stop_types", ",").alias("stops"), F.array_join("colors", ",").alias("colors"))


@_r.query(_ROWS + "select file_path, 'B2' as ref, 'https://nation.test/' || c_nationkey as target from b")
def office_links(spark, sf_dir):
    return spreadsheets.hyperlinks(spark, made.workbooks(spark, sf_dir)).where(_fine).select("file_path", "ref", "target")


@_r.query(_ROWS + "select file_path, 0 as sheet_idx, 'T' || c_nationkey as name, 'A1:E' || last as ref, 1 as header_rows, 0 as totals_rows, 'S' as style, true as row_stripes, 'key,name' as columns from b")
def office_tables(spark, sf_dir):
    return spreadsheets.tables(spark, made.workbooks(spark, sf_dir)).where(_fine).select("file_path", "sheet_idx", "name", "ref", "header_rows", "totals_rows", "style", "row_stripes", F.array_join("columns", ",").alias("columns"))


@_r.query(_ROWS + "select file_path, 'B' || r as ref, case c_custkey % 2 when 0 then 'even' else 'odd' end as author, 'note ' || c_custkey as text from c where c_custkey % 6 = 0")
def office_comments(spark, sf_dir):
    return spreadsheets.comments(spark, made.workbooks(spark, sf_dir)).where(_fine).select("file_path", "ref", "author", "text")


@_r.query(_ROWS + """select file_path, f as format_code, nm as font, case f when 'General' then last * 5 - (last - 1) + (select count(*) filter (where c_custkey % 3 = 0) + count(*) filter (where c_custkey % 5 = 0) + count(*) filter (where c_custkey % 7 = 0) from c where c.file_path = b.file_path) + 3 * (select count(*) from s where s.file_path = b.file_path) else last - 1 end as n
from b, (values ('General', 'Calibri'), ('0.000', 'Mono')) v(f, nm)""")
def office_cell_styles(spark, sf_dir):
    """Cells by number format and font; a style that is missing is style 0."""
    books, keys = made.workbooks(spark, sf_dir), ["file_path", "style_index"]
    xfs = spreadsheets.cell_formats(spark, books).where(_fine).select(*keys, "font_id")
    codes = spreadsheets.number_formats(spark, books).where(_fine).select(*keys, F.coalesce("format_code", F.lit("General")).alias("format_code"))
    fonts = spreadsheets.fonts(spark, books).where(f"{_fine} and not differential").select("file_path", "font_id", F.col("name").alias("font"))
    styled = spreadsheets.cells(spark, books).select(*keys).join(xfs.join(codes, keys).join(fonts, ["file_path", "font_id"]), keys)
    return styled.groupBy("file_path", "format_code", "font").agg(F.count("*").alias("n"))


@_r.query(_ROWS + """select file_path, d as differential, i::int as font_id, nm as name, sz as size, bo as bold, it as italic, th::int as theme, ti as tint from b, (values (false, 0, 'Calibri', 11.0::double, null, null, null, null::double), (false, 1, 'Mono', 9.5, true, false, 4, -0.25), (true, 0, null, null, true, null, null, null)) v(d, i, nm, sz, bo, it, th, ti)""")
def office_fonts(spark, sf_dir):
    """Fonts of cells and of rules, their toggles and theme colours."""
    return spreadsheets.fonts(spark, made.workbooks(spark, sf_dir)).where(_fine).select("file_path", "differential", "font_id", "name", "size", "bold", "italic", "theme", "tint")


@_r.query(_ROWS + "select file_path, 1 as font_id, 'Mono' as name, 9.5::double as size from b")
def office_default_font(spark, sf_dir):
    return spreadsheets.default_font(spark, made.workbooks(spark, sf_dir)).where(_fine).drop("error")


@_r.query(_ROWS + """select file_path, d as differential, i::int as fill_id, p as pattern, f as foreground, g as background from b, (values (false, 0, 'none', null, null), (false, 1, 'solid', 'FFFFFF00', null), (true, 0, null, null, 'FFFF0000')) v(d, i, p, f, g)""")
def office_fills(spark, sf_dir):
    return spreadsheets.fills(spark, made.workbooks(spark, sf_dir)).where(_fine).drop("error")


@_r.query(_ROWS + "select file_path, 2 as fill_id, k::int as ord, k::double as position, case k when 1 then 'FF00FF00' end as rgb, (case k when 0 then 1 end)::int as theme from b, (values (0), (1)) v(k)")
def office_gradient_stops(spark, sf_dir):
    """Stops in the order of their positions, whatever their order in the file."""
    return spreadsheets.gradient_stops(spark, made.workbooks(spark, sf_dir)).where(_fine).select("file_path", "fill_id", "ord", "position", "rgb", "theme")


@_r.query(_ROWS + "select file_path, 1 as border_id, e as edge, t as style, g as rgb, x::int as indexed from b, (values ('left', 'thin', 'FF112233', null), ('bottom', 'double', null, 10)) v(e, t, g, x)")
def office_borders(spark, sf_dir):
    return spreadsheets.borders(spark, made.workbooks(spark, sf_dir)).where(_fine).select("file_path", "border_id", "edge", "style", "rgb", "indexed")


@_r.query(_ROWS + """select file_path, text, count(*) as n, bool_and(bold is not distinct from true) as bold from (
  select distinct file_path, c_mktsegment, unnest([c_mktsegment[:3], c_mktsegment[4:]]) as text, unnest([true, null]) as bold from c where c_custkey % 2 = 1) group by file_path, text""")
def office_string_runs(spark, sf_dir):
    """Runs of rich strings; phonetic text is none."""
    runs = spreadsheets.string_runs(spark, made.workbooks(spark, sf_dir)).where(_fine)
    rich = runs.where("run > 0").select("file_path", "idx").distinct()
    return runs.join(rich, ["file_path", "idx"]).groupBy("file_path", "text").agg(F.count("*").alias("n"), F.bool_and(F.coalesce("bold", F.lit(False))).alias("bold"))


@_r.query(_ROWS + "select file_path, i::int as sheet_idx, (1 - i)::int as frozen_rows, i = 0 as show_zeros, i = 1 as grid_lines, case i when 0 then 'A1:E' || last end as filter_ref from b, (values (0), (1)) v(i)")
def office_views(spark, sf_dir):
    return spreadsheets.views(spark, made.workbooks(spark, sf_dir)).where(_fine).select("file_path", "sheet_idx", "frozen_rows", "show_zeros", "grid_lines", "filter_ref")


@_r.query(_ROWS + "select file_path, chr(64 + i) || '1' as ref from b, (select unnest(range(1, 6))::int as i)")
def office_filter_headers(spark, sf_dir):
    """Cells with a filter button."""
    books = made.workbooks(spark, sf_dir)
    return spreadsheets.filter_headers(spreadsheets.cells(spark, books), spreadsheets.views(spark, books)).select("file_path", "ref")


@_r.query(_ROWS + "select file_path, 'C' || r as ref, case when n % 2 = 1 then '' else n::varchar end as text from s")
def office_hidden_zeros(spark, sf_dir):
    books = made.workbooks(spark, sf_dir)
    cells = spreadsheets.cells(spark, books).where("sheet_idx = 1 and col = 3").withColumn("text", tools.shown())
    return spreadsheets.hide_zeros(cells, spreadsheets.views(spark, books), "text").select("file_path", "ref", "text")


@_r.query(_ROWS + "select file_path, 'D1' as ref, count(*) as n, round(sum(c_acctbal), 2) as total, min(c_acctbal) as low, max(c_acctbal) as high from c group by file_path")
def office_sparkline_values(spark, sf_dir):
    """Values of each sparkline, on another sheet, and the extent of its axis."""
    books = made.workbooks(spark, sf_dir)
    values = spreadsheets.sparkline_values(spreadsheets.sparklines(spark, books), spreadsheets.sheets(spark, books), spreadsheets.cells(spark, books))
    return values.groupBy("file_path", "ref").agg(F.count("*").alias("n"), F.round(F.sum("v_num"), 2).alias("total"), F.min("v_num").alias("low"), F.max("v_num").alias("high"))


@_r.query(_ROWS + """select file_path, p as part, i as id, t as target from b, (values ('xl/workbook.xml', 'r1', 'xl/worksheets/sheet1.xml'), ('xl/workbook.xml', 'r2', 'xl/worksheets/sheet2.xml'), ('xl/worksheets/sheet1.xml', 't', 'xl/tables/table1.xml'), ('xl/worksheets/sheet1.xml', 'c', 'xl/comments1.xml')) v(p, i, t)
union all select file_path, 'xl/worksheets/sheet1.xml', 'x', 'https://nation.test/' || c_nationkey from b""")
def office_relations(spark, sf_dir):
    """Relationships; paths out of the package are none."""
    return parts.relations(spark, made.workbooks(spark, sf_dir)).where(_fine).select("file_path", "part", "id", "target")


@_r.query(_ROWS + "select file_path, k as kind, s as slot, x as value from b, (values ('color', 'dk1', '000000'), ('color', 'lt1', 'FFFFFF'), ('color', 'accent1', '4472C4'), ('font', 'majorFont', 'Head'), ('font', 'minorFont', 'Text')) v(k, s, x)")
def office_themes(spark, sf_dir):
    return parts.themes(spark, made.workbooks(spark, sf_dir)).where(f"{_fine} and value is not null").select("file_path", "kind", "slot", "value")


@_r.query(_ROWS + "select file_path, 'xl/media/image1.png' as part, 24::bigint as n_bytes, (16 + c_nationkey)::int as width, 9 as height, 'image/png' as type from b")
def office_media(spark, sf_dir):
    return parts.media(spark, made.workbooks(spark, sf_dir)).where(_fine).drop("error")


@_r.query(_DOCS + """select file_path, 0 as block, 'paragraph' as type, 'Head' as style, n_name as text, null::int as rows, null::int as cols from b union all select file_path, block, 'paragraph', null, c_name, null, null from c
union all select b.file_path, tbl_block, 'table', null, null, count(*)::int, 2 from b join s on s.file_path = b.file_path group by b.file_path, tbl_block""")
def office_structure(spark, sf_dir):
    """Body blocks; insertions are text, deletions and hidden runs none."""
    return tools.docx_get_structure(spark, made.documents(spark, sf_dir)).withColumn("rows", F.col("rows").cast("int"))


@_r.query(_DOCS + """, l as (select file_path, 0 as block, 0 as trow, n_name as line from b union all select file_path, block, 0, c_name from c union all select s.file_path, tbl_block, trow, c_mktsegment || chr(9) || n from s join b on b.file_path = s.file_path)
select file_path, string_agg(line || chr(10), '' order by block, trow) as text from l group by file_path""")
def office_text(spark, sf_dir):
    return tools.docx_extract_text(spark, made.documents(spark, sf_dir)).select("file_path", "text")


@_r.query(_DOCS + "select file_path, string_agg(c_mktsegment || '|' || n, ';' order by trow) as cells from s group by file_path")
def office_doc_tables(spark, sf_dir):
    found = tools.docx_get_tables(spark, made.documents(spark, sf_dir))
    return found.select("file_path", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("cells"))


@_r.query(_DOCS + """, h as (select file_path, block, 'paragraph' as type, null::int as trow, null::int as tcol, c_name as text from c where c_name like '%00012%' union all select s.file_path, tbl_block, 'cell', trow, 1, n::varchar from s join b on b.file_path = s.file_path where n::varchar like '%00012%')
select *, count(*) over (partition by file_path) as match_count from h""")
def office_doc_search(spark, sf_dir):
    return tools.docx_search_text(spark, made.documents(spark, sf_dir), "00012").select("file_path", "block", "type", "trow", "tcol", "text", "match_count")


@_r.query(_DOCS + "select file_path, 0 as section, 'header' as kind, 'first' as pages, 'word/header1.xml' as part, 'about ' || n_name as text from b")
def office_headers(spark, sf_dir):
    return wordprocessing.headers(spark, made.documents(spark, sf_dir)).where(_fine).drop("error")


@_r.query(_DOCS + "select file_path, 0 as section, 612.0::double as width, 792.0::double as height, 72.0::double as top, 36.0::double as bottom, 50.0::double as \"left\", 50.0::double as \"right\", true as own_first from b")
def office_sections(spark, sf_dir):
    return wordprocessing.sections(spark, made.documents(spark, sf_dir)).where(_fine).drop("error", "starts_on")


@_r.query(_DOCS + """, l as (select *, c_custkey % 3 as lvl from c), g as (select *, case lvl when 0 then 0 else count(*) filter (where lvl = 0) over w end + case lvl when 2 then count(*) filter (where lvl = 1) over w else 0 end as grp from l window w as (partition by file_path order by block rows between unbounded preceding and current row))
select file_path, block, lvl::int as level, (row_number() over (partition by file_path, lvl, grp order by block) - 1 + case lvl when 0 then 1 when 1 then 4 else 7 end)::int as counter, case lvl when 0 then 'decimal' when 1 then 'lowerLetter' else 'lowerRoman' end as format from g""")
def office_list_counters(spark, sf_dir):
    """Counters of real list items, from each level's start or its override."""
    files = made.documents(spark, sf_dir)
    items = wordprocessing.runs(spark, files).where(f"{_fine} and list_id is not null").groupBy("file_path", "block", "list_id", "level").agg(F.count("*").alias("runs"))
    levels = wordprocessing.numbering(spark, files).where(_fine).drop("error")
    joined = items.join(levels, ["file_path", "list_id", "level"], "left")
    return docs.list_counters(joined, ["file_path", "list_id"], "block", "level", F.col("start")).select("file_path", "block", "level", F.col("counter").cast("int").alias("counter"), "format")


@_r.query(_DECKS + "select file_path, slide, n_name as title, slide_count from s")
def office_slides(spark, sf_dir):
    return tools.pptx_get_slides(spark, made.decks(spark, sf_dir))


@_r.query(_DECKS + "select file_path, string_agg('=== Slide ' || (slide + 1) || ' ===' || chr(10) || n_name || chr(10) || 'key' || chr(10) || n_nationkey || chr(10) || 'square' || chr(9) || n_nationkey * n_nationkey, chr(10) || chr(10) order by slide) as text from s group by file_path")
def office_deck_text(spark, sf_dir):
    return tools.pptx_extract_text(spark, made.decks(spark, sf_dir)).select("file_path", "text")


@_r.query(_DECKS + ", h as (select file_path, slide, 'shape' as type, 'Title' as name, n_name as text from s where n_name like '%4%' union all select file_path, slide, 'shape', 'Body', 'key' || chr(10) || n_nationkey from s where n_nationkey::varchar like '%4%' union all select file_path, slide, 'table', 'Table', 'square' || chr(9) || n_nationkey * n_nationkey from s where (n_nationkey * n_nationkey)::varchar like '%4%') select *, count(*) over (partition by file_path) as match_count from h")
def office_deck_search(spark, sf_dir):
    return tools.pptx_search_text(spark, made.decks(spark, sf_dir), "4").select("file_path", "slide", "type", "name", "text", "match_count")


@_r.query(_DECKS + "select file_path, slide, shape::int as shape, kind, nm as name, ph as placeholder, case shape when 1 then n_nationkey * 100 end as x, case shape when 1 then 900 end as w from s, (values (0, 'sp', 'Title', 'title'), (1, 'sp', 'Body', 'body'), (2, 'graphicFrame', 'Table', null)) v(shape, kind, nm, ph) where slide = 0")
def office_slide_structure(spark, sf_dir):
    return tools.pptx_get_slide_structure(spark, made.decks(spark, sf_dir), 0).select("file_path", "slide", "shape", "kind", "name", "placeholder", "x", "w")


@_r.query(_DECKS + "select file_path, slide, t as text, bl as bullet, m as mark from s, lateral (values (n_name, null, null), ('key', null, null), (n_nationkey::varchar, 'buAutoNum', 'arabicPeriod'), ('square', null, null), ((n_nationkey * n_nationkey)::varchar, null, null)) v(t, bl, m)")
def office_deck_runs(spark, sf_dir):
    """Runs of the slides with their paragraphs' bullets."""
    return presentations.field_text(presentations.runs(spark, made.decks(spark, sf_dir)).where(_fine)).select("file_path", "slide", "text", "bullet", "mark")


@_r.query(_DECKS + "select file_path, slide, z::int as z, shape::int as shape, source::int as source, nm as name from s, (values (0, 0, 0, 'Logo'), (1, 0, 1, 'Title'), (2, 1, 1, 'Body'), (3, 2, 1, 'Table')) v(z, shape, source, nm)")
def office_drawn(spark, sf_dir):
    """Shapes in the order that they are drawn."""
    decks = made.decks(spark, sf_dir)
    return presentations.drawn(presentations.slides(spark, decks), presentations.elements(spark, decks)).select("file_path", "slide", "z", "shape", "source", "name")


@_r.query(_DECKS + "select file_path, slide, case when n_nationkey % 2 = 0 then 'CCCCCC' when n_regionkey % 2 = 0 then 'BBBBBB' else 'AAAAAA' end as color, case when n_nationkey % 2 = 0 then 'slide' when n_regionkey % 2 = 0 then 'layout' else 'master' end as source from s")
def office_backgrounds(spark, sf_dir):
    """Background of the slide, else of its layout, else of the master."""
    decks = made.decks(spark, sf_dir)
    return presentations.slide_backgrounds(presentations.slides(spark, decks), presentations.backgrounds(spark, decks)).select("file_path", "slide", "color", "source")


@_r.query(_DECKS + "select file_path, slide, p as placeholder, case p when 'title' then 11 else n_nationkey * 100 end::bigint as x, case p when 'title' then 500 else 900 end::bigint as w from s, (values ('title'), ('body')) v(p)")
def office_inherited_positions(spark, sf_dir):
    """Places of the slides' placeholders, their own or their layout's."""
    decks = made.decks(spark, sf_dir)
    return presentations.inherited_positions(presentations.slides(spark, decks), presentations.elements(spark, decks)).select("file_path", "slide", "placeholder", "x", "w")


@_r.query(_ROWS + "select 'n0.xlsx' as file_path, 'customers,segments' as available where false union all select file_path, 'customers,segments' from b")
def office_missing_sheet(spark, sf_dir):
    """Books without the asked sheet, and what they have."""
    found = tools.xlsx_missing_sheet(spark, made.workbooks(spark, sf_dir), "no such sheet")
    return found.select("file_path", F.array_join("available", ",").alias("available"))


@_r.query(_ROWS + "select file_path, 'D' || r as ref, regexp_replace(c_acctbal::varchar, '\\.0$', '') as text from c")
def office_cell_texts(spark, sf_dir):
    """Texts of number cells, in their shortest digits."""
    return spreadsheets.cells(spark, made.workbooks(spark, sf_dir)).where("sheet_idx = 0 and col = 4 and row > 1").select("file_path", "ref", tools.shown().alias("text"))


@_r.query(_ROWS + "select file_path, i as id, t as part from b, (values ('r1', 'xl/worksheets/sheet1.xml'), ('r2', 'xl/worksheets/sheet2.xml')) v(i, t)")
def office_targets(spark, sf_dir):
    """Parts that a workbook's relationships lead to."""
    found = parts.relations(spark, made.workbooks(spark, sf_dir)).where(f"{_fine} and part = 'xl/workbook.xml'").select("file_path", "id", "target")
    asked = found.select("file_path", "id", F.lit("xl").alias("folder"))
    raw = found.withColumn("target", F.regexp_replace("target", "^xl/", ""))
    return lookups.targets(asked, raw, ["file_path"], "id", "folder").select("file_path", "id", "part")
