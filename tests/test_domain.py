import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import rows
from tradewind import dims
from tradewind.operators import disruption, esg, freight, sector, series, snapshot, strategy, vessels


def test_lane_volatility_edges(spark):
    at = dt.datetime(1998, 5, 20)
    df = spark.createDataFrame(
        [("A", "B", 100.0, at), ("A", "C", 0.0, at), ("A", "C", 0.0, at), ("A", "D", 1.0, at), ("A", "D", 1000.0, at), ("A", "E", 10.0, at), ("A", "E", 10.0, at)],
        "origin string, destination string, rate_40ft double, ts timestamp_ntz")
    got = {r["destination"]: r["volatility"] for r in freight.lane_volatility(df, "1998-06-01 00:00:00").collect()}
    assert got["B"] == 0.2 and got["C"] == 0.2 and got["E"] == 0.0 and got["D"] == pytest.approx(0.998, abs=1e-3)


def test_congested_area(spark):
    areas = dims.frame(spark, dims.AREAS, "area string, lat_lo double, lat_hi double, lon_lo double, lon_hi double")
    v = spark.createDataFrame([(i, 30.0, 32.5, 2.0) for i in range(3)], "mmsi int, latitude double, longitude double, speed double")
    got = {r["area"]: r for r in vessels.area_congestion(v, areas).collect()}
    assert got["Suez"]["congestion"] == pytest.approx(3 / 50 * 1.5) and got["Panama"]["vessel_count"] == 0 and len(got) == 4


def test_invalid_vessels(spark):
    v = spark.createDataFrame([("1", "x", 999.0, 0.0, 5.0), ("2", "x", 0.0, 0.0, -5.0), ("3", None, 0.0, 0.0, 5.0), ("4", "ok", 1.0, 1.0, 0.0)],
                              "mmsi string, vessel_name string, latitude double, longitude double, speed double")
    assert rows(v.where(vessels.valid_position()), "mmsi") == [("4",)]


def test_split_impact_equals_pairwise(spark):
    companies = spark.createDataFrame([("X", "X Inc", "Energy", "s", 0.5, 0.4, 3.0, 1e11)], "symbol string, company_name string, sector string, scenario string, supply_chain_complexity double, international_exposure double, inventory_turnover double, market_cap double")
    d = spark.createDataFrame([("s", "P", "port_congestion", 0.5, 6.0), ("s", "R", "route_blockage", 0.4, 5.0), ("s", "F", "rate_spike", 0.6, 7.0), ("s", "W", "weather", 0.5, 2.0)],
                              "scenario string, location string, disruption_type string, probability double, severity_score double")
    r = disruption.company_impact(companies, d).first()
    want = 3.0 * 1.0 + 2.0 * 0.6 + 4.2 * (2 - 0.6) * 1.2 + 1.0 - 5
    assert r["predicted_impact_score"] == pytest.approx(want)
    assert r["key_risk_factors"] == ["Freight rate spike: F", "Port congestion at P", "Route disruption: R"]


def test_disruption_days_cover_the_exact_window(spark):
    e = spark.createDataFrame([(dt.datetime(2024, 1, 10, 12), 2)], "start timestamp_ntz, duration_days int")
    times = [dt.datetime(2024, 1, 3, 11, 59), dt.datetime(2024, 1, 3, 12), dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 12, 12), dt.datetime(2024, 1, 12, 12, 1)]
    obs = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id int, ts timestamp_ntz")
    assert rows(disruption.label_disrupted(obs, e), "id", "label") == [(0, 0), (1, 1), (2, 1), (3, 1), (4, 0)]


def test_isolated_node_and_dependency(spark):
    edges = spark.createDataFrame([("a", "b", 0.8), ("c", "b", 0.4)], "src string, dst string, weight double")
    nodes = spark.createDataFrame([("a",), ("b",), ("z",)], "node string")
    got = {r["node"]: r["dependency"] for r in sector.dependency_scores(edges, 11, nodes).collect()}
    assert got["z"] == 0.3 and got["b"] == pytest.approx(0.36) and got["a"] == pytest.approx(0.4 / 11)


def test_esg_adjustment_flips_for_shorts(spark):
    fields = {r.field for r in esg.RULES} | {f for f, _, _ in esg.SDG_TERMS if not f.endswith("_pct")} | {"environmental", "social"}
    base = {f: 50.0 for f in fields} | {"overall": 20.0, "carbon_emissions": 10.0}
    scores = spark.createDataFrame([("A", *base.values())], "symbol string, " + ", ".join(f"{f} double" for f in base))
    chain = spark.createDataFrame([], "symbol string, living_wage_pct double, women_owned_pct double")
    signals = spark.createDataFrame([("A", "short", 1.0), ("A", "buy", 1.0), ("B", "buy", 1.0)], "symbol string, signal_type string, strength double")
    got = {(r["symbol"], r["signal_type"]): r for r in esg.adjust_signals(signals, scores, chain).collect()}
    f = 0.8 * 0.95
    assert got["A", "buy"]["esg_adjusted_strength"] == pytest.approx(1 + (f - 1) * 0.3)
    assert got["A", "short"]["esg_adjusted_strength"] == pytest.approx(1 + (2 - f - 1) * 0.3)
    assert got["A", "short"]["esg_positive_factors"] == ["ESG concerns support short thesis"]
    assert got["B", "buy"]["esg_adjusted_strength"] == 0.9 and got["B", "buy"]["esg_rationale"] is None


def test_momentum_cases(spark):
    data = [("a", i, i, x) for i, x in enumerate([10.0, 20.0, 30.0, 60.0])] + [("b", i, i, x) for i, x in enumerate([10.0, 15.0])] + [("c", 0, 0, 9.0)]
    df = spark.createDataFrame(data, "series_id string, ts int, id int, x double")
    assert rows(series.momentum(df, "x"), "series_id", "momentum") == [("a", 2.0), ("b", 0.5), ("c", 0.0)]


def test_drawdown_and_total_return(spark):
    df = spark.createDataFrame([("s", i, r) for i, r in enumerate([0.1, -0.5, 0.2])], "symbol string, day int, ret double")
    r = strategy.performance(df).first()
    assert r["total_return"] == pytest.approx(1.1 * 0.5 * 1.2 - 1) and r["max_drawdown"] == pytest.approx(-0.5)


def test_total_loss_ends_the_series(spark):
    df = spark.createDataFrame([("s", i, r) for i, r in enumerate([0.1, -1.2, 0.2])], "symbol string, day int, ret double")
    r = strategy.performance(df).first()
    assert r["total_return"] == -1.0 and r["max_drawdown"] == -1.0 and r["n"] == 3


def test_exits(spark):
    p = spark.createDataFrame([(1, 10, 89.0), (2, 10, 121.0), (3, -10, 111.0), (4, -10, 79.0), (5, 10, 100.0)], "id int, shares int, price double")
    long = F.col("shares") > 0
    out = strategy.exits(p, F.when(long, 90.0).otherwise(110.0), F.when(long, 120.0).otherwise(80.0), F.col("price"))
    assert rows(out, "id", "trigger") == [(1, "stop_loss"), (2, "take_profit"), (3, "stop_loss"), (4, "take_profit"), (5, None)]


def test_optimiser_respects_limits(spark):
    names = [f"s{i}" for i in range(30)]
    risk = {(a, a): 0.04 for a in names}
    df = spark.createDataFrame([("d1", n, 0.1 if i % 3 else -0.1) for i, n in enumerate(names)], "day string, symbol string, expected double")
    w = [r["weight"] for r in strategy.optimise(df, risk).collect()]
    assert max(map(abs, w)) <= 0.05 + 1e-9 and sum(w) <= 0.3 + 1e-9 and sum(map(abs, w)) <= 1 + 1e-9 and any(x < 0 for x in w)


def test_snapshot_ports(spark):
    df = spark.createDataFrame(
        [(1500.0, 650.0, 7.0, 1.1, 0.1, [("los_angeles", "high"), ("oakland", "low")])],
        "baltic_dry_index double, fuel_cost double, congestion_score double, supply_demand_ratio double, rate_volatility double, ports array<struct<name:string,level:string>>")
    r = snapshot.score_snapshots(df, "ports").first()
    assert r["disruption_score"] == pytest.approx(1.1) and r["risk_factors"][-1] == "High congestion at Los Angeles" and len(r["recommendations"]) == 3


def test_covariance_has_symmetric_diagonal(spark):
    df = spark.createDataFrame([(d, s, float((d * (7 if s == "a" else 3)) % 5)) for d in range(20) for s in "ab"], "day int, symbol string, ret double")
    got = {(r["left"], r["right"]): r["correlation"] for r in strategy.covariance(df, ["a", "b"], correlate=True).collect()}
    assert got["a", "a"] == pytest.approx(1) and got["b", "b"] == pytest.approx(1) and abs(got["a", "b"]) <= 1


def test_covariance_of_many_names_in_small_blocks(spark):
    """More names than any list would hold, gaps, dates without a partner; every block size gives the same pairs."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(f"s{k:03d}", day, None if rng.random() < 0.1 else float(rng.normal() * 0.02 + 5)) for k in range(40) for day in range(30) if rng.random() < 0.8]
    rows += [("lone", 99, 0.5), ("s000", 100, None)]
    df = spark.createDataFrame(rows, "symbol string, day int, ret double").repartition(4)
    by = {}
    for s, d, x in rows:
        by.setdefault(s, {})[d] = x
    want = {}
    for a in by:
        for b in by:
            if a <= b and by[a].keys() & by[b].keys():
                both = [(by[a][d], by[b][d]) for d in by[a].keys() & by[b].keys() if by[a][d] is not None and by[b][d] is not None]
                want[a, b] = float(np.cov(*zip(*both))[0, 1]) * 252 if len(both) > 1 else None
    for names, dates in ((256, 1024), (7, 11)):
        got = {(r["left"], r["right"]): r["covariance"] for r in strategy.covariance(df, names=names, dates=dates).collect()}
        assert got.keys() == want.keys()
        assert all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-9) for k, v in want.items())


def test_port_calls_do_not_gather_orders_by_port(spark):
    """The few ports are broadcast; orders are not shuffled by them."""
    import types

    from tradewind.catalog.domain import port_calls

    orders = spark.range(100).select(F.col("id").alias("o_orderkey"), (F.col("id") * 3).alias("o_custkey"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        calls = port_calls(types.SimpleNamespace(spark=spark, orders=orders))
        plan = calls._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan and calls.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
