"""Run a query on Spark and its SQL in DuckDB, and compare them exactly."""

import glob
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    table = [tuple(row[i] for i in order) for row in rows]
    return [names[i] for i in order], sorted(table, key=repr)


TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE"}


def compare(frame, con, sql):
    """Differences between the two results, as a list of texts; empty when they are the same."""
    got_names, got = _sorted(frame.columns, frame.collect())
    result = con.execute(sql)
    want_names, want = _sorted([d[0] for d in result.description], result.fetchall())
    got_types = {name: TYPES[kind] for name, kind in frame.dtypes}
    want_types = {d[0]: str(d[1]) for d in result.description}
    if got_types != want_types:
        return [f"types {got_types} != {want_types}"]
    if got_names != want_names:
        return [f"columns {got_names} != {want_names}"]
    if len(got) != len(want):
        return [f"{len(got)} rows != {len(want)}"]
    return [f"{g} != {w}" for g, w in zip(got, want) if g != w]
