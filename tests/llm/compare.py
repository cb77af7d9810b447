"""Rows of a Spark result and of DuckDB SQL in one form."""

from __future__ import annotations

import duckdb


def spark_rows(frame):
    names = sorted(frame.columns)
    return names, sorted((tuple(row[name] for name in names) for row in frame.collect()), key=repr)


def duckdb_rows(sql, sf_dir, table="documents"):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
        found = con.execute(sql)
        names = [column[0] for column in found.description]
        order = sorted(range(len(names)), key=lambda i: names[i])
        return sorted(names), sorted((tuple(row[i] for i in order) for row in found.fetchall()), key=repr)
