"""Compare a Spark result with its SQL twin on DuckDB: schema family and values, any order."""

from __future__ import annotations

import glob
import math
import os

import duckdb
from pyspark.sql import DataFrame


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(os.path.join(root, "*.parquet"))):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    return value


def _rows(rows, names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0)
                                             for v in r))


_FAMILY = {"long": "BIGINT", "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR",
           "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE"}


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    cur = con.execute(sql)
    duck_names = [d[0] for d in cur.description]
    duck_rows = cur.fetchall()
    types = {r[0]: str(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if sorted(df.columns) != sorted(duck_names):
        return f"columns {sorted(df.columns)} against {sorted(duck_names)}"
    for field in df.schema.fields:
        kind = _FAMILY.get(field.dataType.simpleString(), field.dataType.simpleString())
        if kind != types[field.name]:
            return f"type of {field.name}: {kind} against {types[field.name]}"
    spark_rows = _rows([tuple(r) for r in df.collect()], df.columns)
    want = _rows(duck_rows, duck_names)
    if len(spark_rows) != len(want):
        return f"{len(spark_rows)} rows against {len(want)}"
    bad = [(a, b) for a, b in zip(spark_rows, want, strict=True) if a != b]
    if bad:
        return (f"{len(bad)} of {len(want)} rows differ, columns {sorted(duck_names)}, "
                f"first {bad[0][0]} against {bad[0][1]}")
    return None
