"""Compare a query with its SQL in DuckDB: columns, row count, values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def rows(records, names):
    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.6g}" if v else "0"
        if isinstance(v, bool) or v is None:
            return str(v)
        if hasattr(v, "as_tuple"):
            return f"{float(v):.6g}"
        if isinstance(v, int):
            return f"{float(v):.6g}" if abs(v) >= 10**6 else str(v)
        return str(v).removesuffix(" 00:00:00")

    out = []
    for r in records:
        out.append(tuple(plain(float(v)) if isinstance(v, int) and not isinstance(v, bool) else plain(v) for v in (r[n] for n in names)))
    return sorted(out)


def compare(spark, query, sql: str, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    got = [r.asDict() for r in df.collect()]
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {p.stem} as from '{p}'")
    relation = con.sql(sql)
    want = [dict(zip(relation.columns, r, strict=True)) for r in relation.fetchall()]
    assert sorted(df.columns) == sorted(relation.columns)
    names = sorted(df.columns)
    a, b = rows(got, names), rows(want, names)
    assert len(a) == len(b)
    assert a == b, next((x, y) for x, y in zip(a, b) if x != y)
