"""Plans and layouts that keep the work of wide queries in step with their rows."""

import math
import statistics
from datetime import datetime, timedelta

import pytest

from helpers import close, rows, series_frame
from tradewind.operators import features, freight, series
from tradewind.plans.chain import Chain
from tradewind.sources.adapters import Tables


def test_lane_rates_shuffle_lines_once(spark, tmp_path):
    nations = [(i, f"N{i}", i % 5) for i in range(25)]
    tables = {
        "nation": (nations, "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(i, i % 25) for i in range(300)], "s_suppkey bigint, s_nationkey int"),
        "customer": ([(i, i % 25) for i in range(300)], "c_custkey bigint, c_nationkey int"),
        "orders": ([(i, i * 7 % 300) for i in range(20_000)], "o_orderkey bigint, o_custkey bigint"),
        "lineitem": ([(i % 20_000, i % 50, i * 11 % 300, i % 7, float(i % 40 + 1), float(i), datetime(1995, 1, 1) + timedelta(days=i % 900)) for i in range(30_000)],
                     "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp_ntz"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "12000")  # each dimension fits, orders and lines do not
    try:
        trend = freight.lane_trend(Tables(spark, str(tmp_path)).lane_rates)
        plan = trend._jdf.queryExecution().executedPlan().toString()
        found = rows(trend, "origin", "destination", "n")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning(o_orderkey" in plan
    assert "hashpartitioning(s_suppkey" not in plan
    expected = {}
    for order, _, supplier, *_ in tables["lineitem"][0]:
        lane = f"N{supplier % 25}", f"N{order * 7 % 300 % 25}"
        expected[lane] = expected.get(lane, 0) + 1
    assert found == sorted((*lane, n) for lane, n in expected.items())


def _plain(name, frame):
    """The statistic of a frame's values, worked out one by one; NaN is the greatest value."""
    held = sorted((v for v in frame if v is not None), key=lambda v: (math.isnan(v), v))
    if not held or name == "std" and len(held) < 2:
        return None
    if name in ("mean", "std") and any(not math.isfinite(v) for v in held):
        return None if name == "std" else math.nan if any(math.isnan(v) for v in held) else held[-1]
    half = held[(len(held) - 1) // 2], held[len(held) // 2]
    return {"min": held[0], "max": held[-1], "mean": sum(held) / len(held), "std": statistics.stdev(held) if name == "std" else None,
            "median": half[0] if half[0] == half[1] else sum(half) / 2}[name]


@pytest.mark.parametrize("hot_rows", [None, 70])
def test_frames_of_odd_values(spark, hot_rows):
    data, n = [], 0
    for key, size in ((None, 5), ("a", 170), ("b", 1), ("c", 30)):
        for i in range(size):
            x = None if n % 5 == 2 else math.nan if n % 31 == 7 else float(n * 37 % 11)
            data.append((key, i // 3, n, x, None if n % 4 == 1 else 2**53 + n * 13 % 7))
            n += 1
    df = spark.createDataFrame(data, "series_id string, ts int, id bigint, x double, n bigint").repartition(3)
    names = ("mean", "std", "min", "max", "median")
    wanted = {f"{c}_{f}_{k}_{whole}": (c, f, k, whole) for c in "xn" for f in names for k in (1, 4, 60) for whole in (False, True)}
    out = series.frame_statistics(df, wanted, **({"hot_rows": hot_rows} if hot_rows else {}))
    assert out.schema["n_max_4_False"].dataType.simpleString() == "bigint"
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == n
    for key in (None, "a", "b", "c"):
        own = [r for r in data if r[0] == key]
        for at, row in enumerate(own):
            for o, (c, f, k, whole) in wanted.items():
                frame = [r[3 if c == "x" else 4] for r in own[max(0, at - k + 1) : at + 1]]
                if f == "std" and (c == "n" or any(v is not None and math.isnan(v) for v in frame)):
                    continue  # NaN, or NULL of a single one; beyond 2**53 a deviation is rounding
                expected = None if whole and sum(v is not None for v in frame) != k else _plain(f, frame)
                exact = c == "n" and f in ("min", "max")
                assert got[row[2]][o] == expected if exact else close(got[row[2]][o], expected), (row, o, got[row[2]][o], expected)


def test_basic_features_take_one_shuffle_and_one_store(spark, monkeypatch):
    """Medians come from no map per row, the rows are shuffled once, and the wide rows are written once."""
    plans, stored = [], []
    table = Chain.table

    def noted(self, name, build):
        def built():
            df = build()
            stored.append(name)
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return df

        return table(self, name, built)

    monkeypatch.setattr(Chain, "table", noted)
    out = features.engineer_basic(series_frame(spark), "ts", ["price", "volume"])
    assert out.count() == 920 and stored == ["windows"]
    assert "percentile(" not in plans[0]
    assert plans[0].count("hashpartitioning(series_id") == 1 and plans[0].count("hashpartitioning(") == 1


def test_many_columns_are_aggregated_a_few_at_once(spark):
    columns = [f"c{i}" for i in range(30)]
    df = spark.range(50).selectExpr("CAST(id % 7 AS DOUBLE) AS y", *[f"CAST((id * {i + 3}) % 11 AS DOUBLE) AS c{i}" for i in range(30)])
    assert rows(features.fit_scaler(df, columns, at_once=4)) == rows(features.fit_scaler(df, columns))
    assert rows(features.select_by_f_test(df, "y", columns, 5, at_once=4)) == rows(features.select_by_f_test(df, "y", columns, 5))
