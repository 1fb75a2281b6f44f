"""Side-by-side comparison of a Spark result and its DuckDB statement."""

from __future__ import annotations

import math
from collections import Counter

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 9)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return str(v)


def compare(spark, con, folder: str, query, sql: str) -> list[str]:
    """Differences, empty when names, row counts, cells and column types agree."""
    got = query(spark, folder)
    rel = con.sql(sql)
    names, want_names = sorted(got.columns), sorted(rel.columns)
    if names != want_names:
        return [f"columns {names} != {want_names}"]
    rows = Counter(tuple(_cell(r[c]) for c in names) for r in got.collect())
    order = [rel.columns.index(c) for c in want_names]
    want = Counter(tuple(_cell(r[i]) for i in order) for r in rel.fetchall())
    problems = []
    if rows != want:
        missing, extra = list((want - rows).items()), list((rows - want).items())
        problems.append(f"{sum(rows.values())} rows against {sum(want.values())}; {len(missing)} missing, {len(extra)} extra")
        problems += [f"  missing {m}" for m in missing[:3]] + [f"  extra {e}" for e in extra[:3]]
    kinds = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
    for field in got.schema.fields:
        ours = kinds.get(field.dataType.simpleString(), field.dataType.simpleString())
        theirs = str(rel.types[rel.columns.index(field.name)])
        if ours != theirs:
            problems.append(f"  type of {field.name}: {ours} / {theirs}")
    return problems
