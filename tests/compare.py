"""A query's rows against its SQL's rows in DuckDB over the same files."""

import math
from pathlib import Path

import duckdb

SMALL = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    if hasattr(x, "hour") and hasattr(x, "year"):
        return str(x.replace(tzinfo=None))
    return x if x is None or isinstance(x, (bool, int)) else str(x)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def sql_rows(sql: str, folder: str = SMALL) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for f in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return sorted(names), rows_of(names, got.fetchall())


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), rows_of(df.columns, df.collect())


def difference(df, sql: str, folder: str = SMALL) -> str:
    """Empty if equal; else what differs."""
    (a, x), (b, y) = spark_rows(df), sql_rows(sql, folder)
    if a != b:
        return f"columns {a} and {b}"
    if len(x) != len(y):
        return f"{len(x)} and {len(y)} rows; first {x[:2]} and {y[:2]}"
    bad = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
    return f"{len(bad)} of {len(x)} rows differ, such as {bad[:2]}" if bad else ""
