"""The registered queries and the SQL that they are checked against."""

from . import charts, documents, formulas, general, looks, office, office_charts, office_slides, office_tables, rules, sheets

_modules = (sheets, rules, charts, documents, looks, formulas, general, office, office_charts, office_slides, office_tables)
QUERIES = {n: f for m in _modules for n, f in m.QUERIES.items()}
ORACLE_SQL = {n: s for m in _modules for n, s in m.ORACLE_SQL.items()}
