import math

import pandas as pd


def rows(df, *columns):
    """Sorted tuples of chosen columns."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def close(a, b, tol=1e-9):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, float) or isinstance(b, float):
        if math.isnan(a) or math.isnan(b):
            return math.isnan(a) and math.isnan(b)
        return abs(a - b) <= tol * max(1.0, abs(a), abs(b))
    return a == b


def same(left, right, key, tol=1e-9):
    """Frames agree on all columns, row by row of a unique key."""
    assert sorted(left.columns) == sorted(right.columns)
    order = sorted(left.columns)
    a = {tuple(r[k] for k in key): r for r in left.select(*order).collect()}
    b = {tuple(r[k] for k in key): r for r in right.select(*order).collect()}
    assert len(a) == len(b) and a.keys() == b.keys()
    for k, r in a.items():
        for c in order:
            assert close(r[c], b[k][c], tol), (k, c, r[c], b[k][c])


def series_frame(spark):
    """Three series; one holds two thirds of the rows; times repeat and values have gaps."""
    import random

    rng = random.Random(7)
    data, n = [], 0
    for series, size in (("hot", 640), ("mid", 220), ("tiny", 60)):
        for i in range(size):
            price = None if rng.random() < 0.08 else round(rng.uniform(5, 90), 2)
            data.append((series, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=7 * (i // 2)), n, price, float(rng.randint(1, 60))))
            n += 1
    return spark.createDataFrame(
        [(s, t.to_pydatetime(), i, p, v) for s, t, i, p, v in data],
        "series_id string, ts timestamp_ntz, id bigint, price double, volume double").repartition(5)
