"""Spark rows against DuckDB's, as sorted text."""

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def _text(value):
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, decimal.Decimal):
        return f"{float(value):.6g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, list):
        return str([_text(v) for v in value])
    return str(value)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(_text(r[n]) for n in names) for r in df.collect())


def duck_rows(sql, sf_dir=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    names = sorted(columns)
    at = [columns.index(n) for n in names]
    return names, sorted(tuple(_text(r[i]) for i in at) for r in cursor.fetchall())
