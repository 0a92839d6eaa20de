"""Equality of results as sets of rows."""

import math

import numpy as np


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, np.floating)):
        return round(float(v), 5) + 0.0
    if isinstance(v, np.integer):
        return int(v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


def same(df, con, sql):
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    want = rows(names, result.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) < 1e-4 for x, y in zip(a, b, strict=True)), (a, b)
