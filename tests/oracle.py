"""Compares a query with its SQL on the same tables."""

import os

import duckdb


def _cell(x):
    if x is None or str(x) in ("nan", "NaT", "<NA>", "None"):
        return "null"
    if "bool" in str(type(x)):
        return str(bool(x))
    if isinstance(x, (int, float)) or "numpy" in str(type(x)) and not isinstance(x, str):
        return repr(round(float(x), 8))
    return str(x)


def rows_of(frame):
    return sorted(tuple(map(_cell, r)) for r in frame[sorted(frame.columns)].astype(object).values.tolist())


def expected(sql, sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf_dir}/{f}'")
    return con.execute(sql).df()


def check(frame, sql, sf_dir):
    want = expected(sql, sf_dir)
    assert sorted(frame.columns) == sorted(want.columns)
    got, want = rows_of(frame), rows_of(want)
    assert len(got) == len(want)
    assert got == want
