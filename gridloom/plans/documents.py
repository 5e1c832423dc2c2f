"""Text, search and document-state queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import documents, grid, pagination
from .registry import Registry, table

_r = Registry()
QUERIES, ORACLE_SQL = _r.queries, _r.sql

_LINES = "select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as ord from documents"
_LEVEL = "case role when 'system' then 0 when 'user' then 1 else 2 end"


def _level():
    return F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)


@_r.query(f"""
with l as ({_LINES}) select doc_id, ord::int as ord, md5(line) as line_md5, count(*) over (partition by doc_id) as match_count from l where contains(lower(line), 'the ')
""")
def doc_search(spark, sf_dir):
    """Paragraphs with a text, whatever its case."""
    hits = documents.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text").where(grid.contains(F.col("line"), "THE "))
    return hits.select("doc_id", "ord", F.md5(F.col("line").cast("binary")).alias("line_md5"), F.count("*").over(Window.partitionBy("doc_id")).alias("match_count"))


@_r.query("select conv_id, string_agg(text, chr(10) order by turn) as text from conversations group by conv_id")
def doc_extract_text(spark, sf_dir):
    return documents.joined_text(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.col("text"))


@_r.query("""select conv_id, string_agg('=== Slide ' || (turn + 1) || ' ===' || chr(10) || text, chr(10) || chr(10) order by turn) as text from conversations group by conv_id""")
def deck_extract_text(spark, sf_dir):
    slide = F.concat(F.lit("=== Slide "), (F.col("turn") + 1).cast("string"), F.lit(" ===\n"), F.col("text"))
    return documents.joined_text(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], slide, "\n\n")


@_r.query(f"""
with l as ({_LINES}) select doc_id, count(*) as n_paragraphs, sum((line = '')::int)::bigint as n_empty, max(length(line))::int as longest, sum(contains(line, '|')::int)::bigint as n_tables from l group by doc_id
""")
def doc_structure(spark, sf_dir):
    line = F.col("line")
    return documents.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("doc_id").agg(
        F.count("*").alias("n_paragraphs"), F.count_if(line == "").alias("n_empty"), F.max(F.char_length(line)).alias("longest"), F.count_if(F.contains(line, F.lit("|"))).alias("n_tables"),
    )


@_r.query(f"""
with i as (select conv_id, turn, {_LEVEL} as lvl from conversations),
g as (select *, case lvl when 0 then 0 when 1 then count(*) filter (where lvl < 1) over w else count(*) filter (where lvl < 2) over w end as grp from i window w as (partition by conv_id order by turn rows between unbounded preceding and current row))
select conv_id, turn, lvl, row_number() over (partition by conv_id, lvl, grp order by turn)::int as counter from g
""")
def list_counters(spark, sf_dir):
    items = table(spark, sf_dir, "conversations").select("conv_id", "turn", _level().alias("lvl"))
    return documents.list_counters(items, ["conv_id"], "turn", "lvl", deepest=3).select("conv_id", "turn", "lvl", F.col("counter").cast("int").alias("counter"))


@_r.query(f"""
with i as (select conv_id, turn, {_LEVEL} as lvl, role <> 'system' as numbered from conversations),
g as (select *, count(*) filter (where not numbered) over (partition by conv_id order by turn rows between unbounded preceding and current row) as island from i)
select conv_id, turn, lvl, case when numbered then row_number() over (partition by conv_id, island, numbered, lvl order by turn)::int end as number from g
""")
def auto_number(spark, sf_dir):
    items = table(spark, sf_dir, "conversations").select("conv_id", "turn", _level().alias("lvl"), "role")
    return documents.auto_numbers(items, ["conv_id"], "turn", "lvl", F.col("role") != "system").select("conv_id", "turn", "lvl", "number")


@_r.query(f"""
with l as ({_LINES}) select doc_id, ord::int as ord, greatest(coalesce(lag(length(line) % 18) over (partition by doc_id order by ord), 0), length(line) % 12)::int as gap from l
""")
def para_margin_collapse(spark, sf_dir):
    """Space between paragraphs, their margins made from line lengths."""
    n = F.char_length("line")
    return documents.margin_gaps(documents.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text"), ["doc_id"], "ord", n % 12, n % 18).select("doc_id", "ord", F.col("gap").cast("int").alias("gap"))


@_r.query("""
with p as (select conv_id, turn, count(*) filter (where length(text) % 4 = 0) over (partition by conv_id order by turn rows between unbounded preceding and current row) + 1 as page from conversations)
select conv_id, turn, page, case when page = 1 then 'first' when page % 2 = 0 then 'even' else 'default' end as header from p
""")
def page_explicit_breaks(spark, sf_dir):
    found = documents.pages(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.char_length("text") % 4 == 0)
    return found.select("conv_id", "turn", "page", documents.header_kind(F.col("page"), True, True).alias("header"))


@_r.query("""
with p as (select p_partkey, (p_partkey * 7 % 4500 + 1)::int as n from part)
select p_partkey, n, case when n < 4000 then (['', 'M', 'MM', 'MMM'])[n // 1000 + 1] || (['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'])[n // 100 % 10 + 1] || (['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'])[n // 10 % 10 + 1]
    || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[n % 10 + 1] else n::varchar end as roman,
  repeat(chr(97 + (n - 1) % 26), (n - 1) // 26 + 1) as doubled, case when n > 702 then chr(97 + (n - 703) // 676 % 26) else '' end || case when n > 26 then chr(97 + (n - 27) // 26 % 26) else '' end || chr(97 + (n - 1) % 26) as letters from p
""")
def list_number_styles(spark, sf_dir):
    """Numbers of parts as list markers."""
    from ..functions.labels import letters, roman

    n = F.col("n")
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 7 % 4500 + 1).cast("int").alias("n")).select("p_partkey", "n", roman(n).alias("roman"), letters(n).alias("doubled"), letters(n, repeat=False).alias("letters"))


@_r.query("""
with recursive g("group", parent, off, ext, ch_off, ch_ext) as (values (1, null, 100.0, 200.0, 0.0, 400.0), (2, 1, 40.0, 80.0, 10.0, 40.0)),
s as (select n_nationkey as shape, n_nationkey::double as x, 10.0 as w, case n_nationkey % 3 when 0 then null else n_nationkey % 3 end as "group" from nation),
u as (select * from s union all select shape, g.off + (x - g.ch_off) * g.ext / g.ch_ext, w * g.ext / g.ch_ext, g.parent from u join g on u."group" = g."group")
select shape, round(x, 6)::double as x, round(w, 6)::double as w from u where "group" is null
""")
def shape_group_positions(spark, sf_dir):
    """Shapes in nested groups, moved and scaled up the tree."""
    from ..operators.packages import absolute_positions

    groups = spark.createDataFrame([(1, None, 100.0, 200.0, 0.0, 400.0), (2, 1, 40.0, 80.0, 10.0, 40.0)], "group int, parent int, off double, ext double, ch_off double, ch_ext double")
    key = F.col("n_nationkey")
    shapes = table(spark, sf_dir, "nation").select(key.alias("shape"), key.cast("double").alias("x"), F.lit(10.0).alias("w"), F.nullif(key % 3, F.lit(0)).alias("group"))
    found = absolute_positions(shapes, F.broadcast(groups))
    return found.select("shape", F.round("x", 6).alias("x"), F.round("w", 6).alias("w"))


@_r.query("""
with names as (select n_regionkey, n_nationkey as ord, case when n_nationkey % 2 = 0 then 'Name' else 'NAME' end || n_nationkey % 3 as name, case when n_nationkey % 4 = 0 then n_nationkey % 2 when n_nationkey % 5 = 0 then 1 end as local_sheet, n_name as formula from nation)
select n_regionkey, sheet_idx::int as sheet_idx, lower(name) as name, arg_max(formula, ord) as formula from names join range(2) s(sheet_idx) on local_sheet is null or local_sheet = sheet_idx group by all
""")
def lookup_defined_names(spark, sf_dir):
    """Names that each of two sheets of a region sees; later ones hold."""
    from ..operators.packages import names_of_sheet

    k = F.col("n_nationkey")
    local = F.when(k % 4 == 0, k % 2).when(k % 5 == 0, 1).cast("int")
    names = table(spark, sf_dir, "nation").select("n_regionkey", F.concat(F.when(k % 2 == 0, "Name").otherwise("NAME"), (k % 3).cast("string")).alias("name"), local.alias("local_sheet"), F.col("n_name").alias("formula"), k.alias("ord"))
    sheets = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.explode(F.array(F.lit(0), F.lit(1))).alias("sheet_idx"))
    return names_of_sheet(names, sheets, ["n_regionkey"]).select("n_regionkey", "sheet_idx", "name", "formula")


@_r.query(f"""
with recursive l as ({_LINES}),
b as (select doc_id, ord::int as ord, case when line = '' then 'break' when ord % 7 = 6 then 'table' else 'paragraph' end as kind, 12.0 * (len(line) // 60 + 1) as height, (ord % 3) * 5.0 as before, (ord % 4) * 6.0 as after, ord % 5 = 1 as keep_next, ord % 11 = 10 as break_before, ord % 2 as style, ord % 3 = 1 as contextual from l),
n as (select *, case kind when 'paragraph' then height + before + after when 'table' then height else 0 end as full_ from b),
w as (select *, case when keep_next then coalesce(lead(full_) over (partition by doc_id order by ord), 0) else 0 end as next_ from n),
f(doc_id, ord, page, y, last, style, para, held) as (
  select doc_id, -1, 1, 0.0::double, 0.0::double, -1, false, 0 from w group by doc_id
  union all
  select doc_id, ord, page + turn, case kind when 'break' then 0 else case when turn = 1 then 0 else top end + high + space end, space, case when kind = 'paragraph' then style else -1 end, kind = 'paragraph', case when kind = 'break' then 0 when turn = 1 then 1 else held + 1 end
  from (select *, case when kind = 'break' then 1 when opens and held > 0 then 1 when kind = 'paragraph' and held > 0 and not opens and top > 0 and top + high + next_ > 200 then 1 when kind = 'table' and held > 0 and top + high > 200 then 1 else 0 end as turn
    from (select *, y0 - case when kind = 'paragraph' then least(last0, lead_) else 0 end as top, case when kind = 'paragraph' then lead_ + height else height end as high, case when kind = 'paragraph' then after else 0 end as space
      from (select w.*, f.page, f.held, kind = 'paragraph' and break_before as opens, case when kind = 'paragraph' and break_before then 0 else f.y end as y0, case when kind = 'paragraph' and break_before then 0 else f.last end as last0,
          case when kind = 'paragraph' and not (f.para and not break_before and contextual and f.style = w.style) then before else 0 end as lead_
        from f join w on w.doc_id = f.doc_id and w.ord = f.ord + 1))))
select doc_id, ord, page from f where ord >= 0
""")
def page_overflow(spark, sf_dir):
    """Pages of paragraphs, tables and breaks with heights and spaces."""
    line, ord_ = F.col("line"), F.col("ord")
    lines = documents.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text")
    blocks = lines.select(
        "doc_id", "ord", F.when(line == "", "break").when(ord_ % 7 == 6, "table").otherwise("paragraph").alias("kind"), (12.0 * (F.floor(F.char_length(line) / 60) + 1)).alias("height"), ((ord_ % 3) * 5.0).alias("before"), ((ord_ % 4) * 6.0).alias("after"),
        (ord_ % 5 == 1).alias("keep_next"), ((ord_ % 11 == 10) & (line != "") & (ord_ % 7 != 6)).alias("break_before"), (ord_ % 2).alias("style"), (ord_ % 3 == 1).alias("contextual"),
    )
    return pagination.paginate(blocks, ["doc_id"], "ord", F.lit(200)).select("doc_id", "ord", "page")
