"""Holds registered queries against their SQL in DuckDB: same columns, same rows in any order."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    return value.isoformat() if hasattr(value, "isoformat") else value


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if the query's rows are those of the SQL."""
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = query(spark, sf_dir)
    want = db.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(names) != sorted(found.columns):
        return f"columns {sorted(found.columns)}, not {sorted(names)}"
    a, b = rows_of(found.columns, found.collect()), rows_of(names, want.fetchall())
    if a == b:
        return ""
    return f"{sum(a.values())} and {sum(b.values())} rows; only in Spark {list((a - b).items())[:3]}; only in SQL {list((b - a).items())[:3]}"
