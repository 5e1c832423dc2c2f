"""Format codes as data: a code is read into a struct, and one expression shows any number or text under any such struct.

``compiled`` reads a code, ``shown`` applies it; both are SQL text over names, so
they serve columns of codes, literal codes (whose struct is folded into the plan)
and the SQL name ``excel_format`` alike. No plan grows with the number of codes,
and no row runs Python.

Brackets: elapsed hours, minutes and seconds count on beyond a day; a currency
(``[$x-407]``) shows its symbol; colours, conditions and locales show nothing.
``_x`` and ``*x`` show nothing. Sections are positive;negative;zero;text, and the
negative one gets the absolute value.
"""

from __future__ import annotations

from . import eras

_QUOTED = r'"[^"]*"?|\\.|\[[^\]]*\]?|_.|\*.'
#: What a number section is made of, and what a date code is made of.
_NUMBER = rf"(?is){_QUOTED}|General|[#0?.,]+|%|E[+-]0*|\\|."
DATE = rf"(?is){_QUOTED}|AM/PM|A/P|aaaa|aaa|y+|m+|d+|h+|s+|g+|e+|r+|\.0+|\\|."
PLAIN = r'"[^"]*"?|\\.|\[[^\]]*\]?|_.|\*.'
#: Between sections: a semicolon that is neither escaped nor inside quotes.
BETWEEN = r'(?<!\\);(?=(?:[^"]*"[^"]*")*[^"]*$)'
_ELAPSED = r"(?i)^\[(h+|m+|s+)\]$"

# A literal piece as it is shown.
_LITERAL = r"""case when t rlike '^"' then replace(t, '"', '') when t rlike r'^\\.' then substr(t, 2) when t rlike r'^\[\$' then regexp_extract(t, r'^\[\$([^\]-]*)', 1) when t rlike r'(?s)^(\[|[_*].)' then '' else t end"""


def _let(name: str, value: str, body: str) -> str:
    """``body`` with a name for ``value``, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _parts(code: str) -> str:
    return f"split({code}, r'{BETWEEN}')"


def is_date(code: str) -> str:
    """Elapsed parts, years, days, weekdays, halves of a day, or times; what is quoted, escaped or in brackets otherwise doesn't count."""
    plain = f"regexp_replace({code}, r'(?s){PLAIN}', '')"
    return rf"({code} rlike r'(?i)\[(h+|m+|s+)\]' or {plain} rlike r'(?i)[yd]|aaa|AM/PM|A/P|h+:m+|m+:s+')"


def _number_part(p: str) -> str:
    """A section: its pieces, of kinds n (the number), x (more of its digits), e (exponent), g (General), @ (text), blank (literal), and how to round."""
    kind = "case when t rlike '^[#0?.,]' then if(i = f, 'n', 'x') when t rlike '(?i)^E[+-]' then 'e' when lower(t) = 'general' then 'g' when t = '@' then '@' else '' end"
    part = rf"""named_struct(
      'pieces', transform(k, (t, i) -> named_struct('kind', {kind}, 'text', {_LITERAL}, 'code', t)),
      'decimals', length(regexp_extract(s, r'\.([0#?]+)', 1)), 'least', length(regexp_replace(s, r'\..*$|[#?,]', '')),
      'thousands', s rlike ',' and s rlike '[#0]', 'percent', size(filter(k, t -> t = '%')), 'exponent', coalesce(get(filter(k, t -> t rlike '(?i)^E[+-]'), 0), ''))"""
    with_digits = _let("s", "array_join(filter(k, t -> t rlike '^[#0?.,]'), '')", _let("f", "array_position(transform(k, t -> t rlike '^[#0?.,]'), true) - 1", part))
    return _let("k", f"regexp_extract_all({p}, r'{_NUMBER}', 0)", with_digits)


def _date_part(p: str) -> str:
    """The first section of a date code: tokens and a string of one sign a token, in which minutes (n) are told from months (m)."""
    sign = rf"""case when t rlike r'{_ELAPSED}' then upper(substr(t, 2, 1)) when t rlike r'(?s)^(\[|[_*].)' then 'b' when t rlike r'(?s)^("|\\.)' then 'L' when upper(t) in ('AM/PM', 'A/P') then 'p'
      when lower(t) in ('aaa', 'aaaa') then 'w' when lower(substr(t, 1, 1)) in ('y', 'm', 'd', 'h', 's', 'g') then lower(substr(t, 1, 1)) when lower(substr(t, 1, 1)) in ('e', 'r') then 'e' when t rlike r'^\.0+$' then 'f' when t = ':' then ':' when t rlike '^[-/. ]$' then '.' else 'L' end"""
    signs = f"array_join(transform(k, t -> {sign}), '')"
    return _let("k", f"regexp_extract_all({p}, r'{DATE}', 0)", rf"named_struct('tokens', k, 'signs', regexp_replace({signs}, r'(?<=[hH][:.b]{{0,30}})m|m(?=b{{0,30}}:b{{0,30}}[sS])', 'n'))")


def compiled(code: str) -> str:
    """Struct of a code; null for a null code."""
    return f"""case when {code} is not null then named_struct('general', lower(trim({code})) = 'general', 'date', {is_date(code)},
      'parts', transform({_parts(code)}, p -> {_number_part("p")}), 'day', {_date_part(f"{_parts(code)}[0]")}) end"""


def _rounded(v: str, part: str) -> str:
    """Digits of a number that is not negative: halves up on its decimal value."""
    whole = f"if(length(substring_index(d, '.', 1)) < {part}.least, lpad(substring_index(d, '.', 1), {part}.least, '0'), substring_index(d, '.', 1))"
    grouped = rf"if({part}.thousands, regexp_replace({whole}, r'(?<=\d)(?=(?:\d{{3}})+$)', ','), {whole})"
    return _let("d", f"format_string(concat('%.', {part}.decimals, 'f'), {v})", f"if({part}.decimals > 0, concat({grouped}, '.', substring_index(d, '.', -1)), {grouped})")


def _number(v: str, part: str) -> str:
    """The pieces of a section around the number ``v``, which is not negative."""
    scaled = f"({v} * pow(100d, {part}.percent))"
    power = f"format_string(concat('%.', {part}.decimals, 'e'), {scaled})"
    digits = f"if({part}.exponent = '', {_rounded(scaled, part)}, substring_index({power}, 'e', 1))"
    tail = _let("e", f"cast(substring_index({power}, 'e', -1) as int)", f"concat('E', if(e < 0, '-', if({part}.exponent rlike '[+]', '+', '')), lpad(cast(abs(e) as string), greatest(length({part}.exponent) - 2, length(cast(abs(e) as string))), '0'))")
    return f"array_join(transform({part}.pieces, p -> case p.kind when 'n' then {digits} when 'x' then '' when 'e' then {tail} when 'g' then {_general(v)} else p.text end), '')"


def _general(v: str) -> str:
    """The shortest digits of a number that is not negative; without an exponent from 1e-6 to 1e21."""
    plain = _let("w", f"cast(try_cast({v} as decimal(38, 17)) as string)", r"if(w rlike r'\.', regexp_replace(w, r'\.?0+$', ''), w)")
    short = rf"replace(regexp_replace(regexp_replace(cast(cast({v} as double) as string), r'\.0(?=E|$)', ''), r'E(\d)', 'e+$1'), 'E', 'e')"
    return f"case when {v} = 0 then '0' when {v} >= 1e-6d and {v} < 1e21d then {plain} else {short} end"


def _signed(x: str, spec: str) -> str:
    """A number under a code that is no date; a minus that no section gives is left out before zeros."""
    at = f"case when {x} < 0 and size({spec}.parts) > 1 then 1 when {x} = 0 and size({spec}.parts) > 2 then 2 else 0 end"
    held = f"named_struct('part', {spec}.parts[{at}], 'bare', {x} < 0 and size({spec}.parts) = 1)"
    text = f"named_struct('text', {_number(f'abs({x})', 'n.part')}, 'bare', n.bare, 'digits', exists(n.part.pieces, p -> p.kind in ('n', 'g')))"
    return f"transform(transform(array({held}), n -> {text}), u -> concat(if(u.bare and (not u.digits or u.text rlike '[1-9]'), '-', ''), u.text))[0]"


def _dated(x: str, spec: str) -> str:
    """A serial under a date code; all parts come from the same milliseconds, so a time never rounds into another day."""
    pad = lambda v, t="t": f"if(length({t}) > 1, lpad(cast({v} as string), greatest(2, length(cast({v} as string))), '0'), cast({v} as string))"
    day, second = "m.day", "(m.ms div 1000)"
    hour, elapsed = f"({second} div 3600)", "(m.total div 1000)"
    half = "exists(m.tokens, u -> upper(u) in ('AM/PM', 'A/P'))"
    clock = f"if({half}, if({hour} % 12 = 0, 12, {hour} % 12), {hour})"
    over = lambda v: f"concat(if(m.x < 0, '-', ''), lpad(cast({v} as string), greatest(length(t) - 2, length(cast({v} as string))), '0'))"
    era = lambda k: "case " + " ".join(f"when {day} >= date'{e[0]}' then '{e[k]}'" for e in eras.ERAS) + f" else '{eras.ERAS[-1][k]}' end"
    era_year = "case " + " ".join(f"when {day} >= date'{e[0]}' then year({day}) - {int(e[0][:4]) - 1}" for e in eras.ERAS) + f" else year({day}) end"
    weekday = f"element_at(array({', '.join(repr(w) for w in eras.WEEKDAYS)}), dayofweek({day}))"
    piece = f"""case k
      when 'y' then if(length(t) > 2, lpad(cast(year({day}) as string), 4, '0'), right(cast(year({day}) as string), 2))
      when 'm' then case length(t) when 1 then cast(month({day}) as string) when 2 then lpad(cast(month({day}) as string), 2, '0') when 3 then date_format({day}, 'MMM') when 4 then date_format({day}, 'MMMM') else left(date_format({day}, 'MMMM'), 1) end
      when 'd' then case length(t) when 1 then cast(day({day}) as string) when 2 then lpad(cast(day({day}) as string), 2, '0') when 3 then date_format({day}, 'EEE') else date_format({day}, 'EEEE') end
      when 'h' then {pad(clock)} when 'n' then {pad(f"({second} div 60 % 60)")} when 's' then {pad(f"({second} % 60)")}
      when 'f' then left(concat('.', lpad(cast(m.ms % 1000 as string), 3, '0'), repeat('0', length(t))), length(t))
      when 'H' then {over(f"({elapsed} div 3600)")} when 'M' then {over(f"({elapsed} div 60)")} when 'S' then {over(elapsed)}
      when 'p' then if({hour} < 12, substring_index(t, '/', 1), substring_index(t, '/', -1))
      when 'g' then case length(t) when 1 then {era(1)} when 2 then {era(2)} else {era(3)} end when 'e' then {pad(f"({era_year})")}
      when 'w' then if(length(t) = 4, concat({weekday}, '曜日'), {weekday}) when 'b' then regexp_extract(t, r'^\\[\\$([^\\]-]*)', 1) else {_LITERAL} end"""
    ms = f"cast(round({x} * 86400000d) as bigint)"
    days = f"cast(floor({ms} / 86400000) as int)"
    moment = f"named_struct('x', {x}, 'day', date_add(date'1899-12-30', {days}), 'ms', {ms} - {days} * 86400000L, 'total', abs({ms}), 'tokens', {spec}.day.tokens, 'signs', {spec}.day.signs)"
    return f"transform(array({moment}), m -> array_join(transform(m.tokens, (t, i) -> transform(array(substr(m.signs, i + 1, 1)), k -> {piece})[0]), ''))[0]"


def shown(x: str, spec: str) -> str:
    """A number under a compiled code; null for a null number."""
    sign = f"if({x} < 0, '-', '')"
    odd = f"case when isnan({x}) then 'NaN' when abs({x}) = double('infinity') then concat({sign}, 'Infinity') end"
    return f"""case when {x} is null then null when isnan({x}) or abs({x}) = double('infinity') then {odd} when {spec} is null or {spec}.general then concat({sign}, {_general(f"abs({x})")})
      when {spec}.date then {_dated(x, spec)} else {_signed(x, spec)} end"""


def shown_text(text: str, spec: str) -> str:
    """A text under a compiled code's fourth section, where ``@`` is the text; other codes leave it as it is."""
    return f"case when size({spec}.parts) >= 4 and {text} is not null then array_join(transform({spec}.parts[3].pieces, p -> case when p.kind = '@' then {text} when p.kind = '' then p.text else p.code end), '') else {text} end"


def sql_body(x: str, code: str) -> str:
    """The body of the SQL name."""
    return f"transform(array(named_struct('x', {x}, 'spec', {compiled(code)})), v -> {shown('v.x', 'v.spec')})[0]"
