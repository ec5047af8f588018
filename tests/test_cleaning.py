import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from helpers import rows
from tradewind.operators import clean, features, quality
from tradewind.operators.isolation import isolation_outliers


@pytest.fixture(scope="module")
def prices(spark):
    return spark.createDataFrame(
        [(1, 100.0, 1000.0, "A"), (2, 105.0, None, "A"), (3, None, 900.0, "B"), (4, 110.0, 1100.0, "B"), (5, 1000.0, 950.0, None), (6, 95.0, 1000.0, "A")],
        "id int, price double, volume double, symbol string")


def test_profile_and_score(prices):
    p = {r["column"]: r for r in quality.quality_profile(prices.drop("id")).collect()}
    assert p["price"]["nulls"] == 1 and p["price"]["high"] == 1000.0 and p["price"]["outliers"] == 0  # fewer than 10 values
    s = quality.quality_score(prices.drop("id")).first()
    assert s["missing"] == 3 and s["duplicates"] == 0
    assert s["score"] == pytest.approx(0.5 * (1 - 3 / 18) + 0.3 + 0.2)


def test_zero_deviation_flags_nothing(spark):
    df = spark.range(20).select(F.lit(1.0).alias("x"))
    assert df.where(clean.zscore_flags(df, ["x"])["x"]).count() == 0
    assert df.where(clean.modified_z_flags(df, ["x"])["x"]).count() == 0


def test_imputation(prices):
    assert clean.impute_numeric(prices, ["price"], "median").where("id = 3").first()["price"] == 105.0
    assert clean.impute_numeric(prices, ["volume"], "most_frequent").where("id = 2").first()["volume"] == 1000.0
    assert clean.impute_categories(prices, ["symbol"]).where("id = 5").first()["symbol"] == "A"
    with pytest.raises(ValueError):
        clean.impute_numeric(prices, ["price"], "guess")


@pytest.mark.parametrize("tile_rows", [7, 25, 1000])
def test_nearest_imputation_matches_brute_force(spark, tile_rows):
    rng = np.random.default_rng(5)
    data = rng.uniform(0, 10, (60, 3))
    data[rng.uniform(size=data.shape) < 0.2] = np.nan
    df = spark.createDataFrame([(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(data)], "id int, a double, b double, c double")
    got = {r["id"]: (r["a"], r["b"], r["c"]) for r in clean.impute_nearest(df, ["a", "b", "c"], "id", tile_rows=tile_rows).collect()}
    for i, row in enumerate(data):
        for c in range(3):
            if not np.isnan(row[c]):
                assert got[i][c] == row[c]
                continue
            found = []
            for jj, other in enumerate(data):
                both = ~np.isnan(row) & ~np.isnan(other)
                if not np.isnan(other[c]) and both.any():
                    found.append((np.sum((row[both] - other[both]) ** 2) / both.sum() * 3, jj, other[c]))
            want = [v for _, _, v in sorted(found)[:5]]
            assert got[i][c] == pytest.approx(np.mean(want)) if want else got[i][c] is None


def test_capping_touches_only_columns_with_outliers(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(100)] + [(1000.0, 50.0)], "a double, b double")
    out = clean.cap_outliers(df, ["a", "b"])
    assert out.agg(F.max("a")).first()[0] == 95.0 and out.agg(F.max("b")).first()[0] == 99.0


def test_types_and_validators(spark):
    df = spark.createDataFrame([("1.5", "2024-01-02", "x"), ("2", "2024-01-03", "1"), ("3", "2024-02-01", "2"), ("4", "2024-02-02", "3"), ("5", "2024-02-03", "y")], "n string, d string, m string")
    out = clean.coerce_types(df)
    assert dict(out.dtypes) == {"n": "double", "d": "timestamp_ntz", "m": "string"}

    def broken(s):
        raise RuntimeError("no")

    kept = clean.apply_validators(out, {"n": clean.on_pandas(broken), "absent": lambda c: c})
    assert rows(kept, "n") == rows(out, "n")


def test_rules(spark):
    df = spark.createDataFrame([(1, -5.0, "", "2024-01-01"), (2, 5.0, None, "bad"), (3, 1.0, "AAPL", "2024-05-05")], "id int, price double, symbol string, day string")
    found = rows(clean.validate_rules(df, "id", [clean.rule_minimum("price", 0), clean.rule_required("symbol"), clean.rule_length("symbol", 1), clean.rule_date("day")]))
    assert found == [(1, "price", "minimum"), (1, "symbol", "min_length"), (2, "day", "date_format"), (2, "symbol", "required")]


def test_scaler_fit_and_reuse(spark):
    df = spark.createDataFrame([(100.0,), (150.0,), (200.0,), (250.0,), (300.0,)], "price double")
    for method, first in (("standard", -np.sqrt(2)), ("minmax", 0.0), ("robust", -1.0)):
        fitted = features.fit_scaler(df, ["price"], method)
        assert features.transform_scaled(df, fitted).first()["price"] == pytest.approx(first)
        assert features.transform_scaled(df.limit(1), fitted).first()["price"] == pytest.approx(first)


def test_encoding_edges(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("c",)], "k string")
    assert rows(features.one_hot(df, "k")) == [(0, 0), (0, 0), (0, 1), (1, 0)]
    wide = spark.range(40).select(F.format_string("v%03d", 39 - F.col("id")).alias("k"))
    want = [(i,) for i in range(40)]
    assert sorted(tuple(r) for r in features.label_encode(wide, "k").collect()) == want
    numbered = {r["k"]: r["i"] for r in features.ordinal_dimension(wide, "k", "i").collect()}
    assert numbered == {f"v{i:03d}": i for i in range(40)}


def test_selection_falls_back_to_correlation(spark):
    df = spark.range(30).select(F.col("id").cast("double").alias("y"), (F.col("id") * 2.0).alias("x"))
    assert features.select_features(df, "y", ["x"], "f_test", 1).first()["feature"] == "x"  # r = 1 has no F value


def test_isolation_forest_finds_planted_rows(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 20, 500.0 + F.col("id")).otherwise(F.col("id") % 50).alias("x"), (F.col("id") % 37 * 1.0).alias("y"))
    out = isolation_outliers(df, ["x", "y"], ["id"], trees=40)
    assert out.where("id < 20 AND outlier").count() == 20
    assert 50 <= out.where("outlier").count() <= 100
    assert out.where("anomaly_score <= 0 OR anomaly_score >= 1").count() == 0


def test_step_forest_equals_trees_walked_one_by_one():
    from tradewind.operators import isolation

    rng = np.random.default_rng(3)
    pool = np.concatenate([rng.normal(size=300), [9.0, 9.0, -7.5]])
    cuts, scores = isolation.step_forest(pool, 20, 64, 5)
    again, size = np.random.default_rng(5), 64
    trees = [isolation.step_tree(np.sort(again.choice(pool, size, replace=False)), again, 6) for _ in range(20)]
    for x in [*pool, *cuts, -100.0, 100.0]:
        path = np.mean([paths[sum(c <= x for c in own)] for own, paths in trees])
        assert scores[np.searchsorted(cuts, x, side="right")] == pytest.approx(2 ** (-path / isolation._average_path(size)))
    assert all(len(paths) == len(own) + 1 and (np.diff(own) > 0).all() for own, paths in trees)
    assert scores[np.searchsorted(cuts, 9.0, side="right")] > scores[np.searchsorted(cuts, 0.0, side="right")]


@pytest.mark.parametrize("chunk", [50_000, 13])
def test_forest_of_each_series_finds_what_was_planted(spark, monkeypatch, chunk):
    from tradewind.operators import clean, isolation

    monkeypatch.setattr(isolation, "CHUNK", chunk)
    rng = np.random.default_rng(1)
    rows = [("a", i, i, float(x)) for i, x in enumerate(rng.normal(10, 1, 200))] + [("b", i, 1000 + i, float(x)) for i, x in enumerate(rng.normal(0, 0.1, 60))]
    planted = {("a", 500): 40.0, ("a", 501): -30.0, ("b", 502): 3.0}
    rows += [(k, 999, i, v) for (k, i), v in planted.items()]
    rows += [("short", i, 2000 + i, 1.0 if i else 50.0) for i in range(10)] + [("flat", i, 3000 + i, 5.0) for i in range(30)]
    rows += [("a", 0, 4000, None), ("b", 0, 4001, float("nan")), (None, 0, 4002, 1.0)]
    df = spark.createDataFrame(rows, "series_id string, ts int, id int, price double").repartition(6)
    found = clean.series_anomalies(df, "price").where("method = 'isolation_forest'").collect()
    marked = {(r["series_id"], r["id"]) for r in found}
    assert planted.keys() <= marked and {k for k, _ in marked} == {"a", "b"}
    for k, n in (("a", 202), ("b", 61)):
        own = [r for r in found if r["series_id"] == k]
        assert len(own) <= 0.1 * n + 1 and all(r["anomalies"] == len(own) for r in own)
    z = clean.series_anomalies(df.where("id < 4001"), "price").where("method = 'statistical'").collect()
    assert {(r["series_id"], r["id"]) for r in z} >= {("a", 500), ("b", 502)}


def test_feature_driver_without_order_or_target(spark):
    """Without a time column only row-wise features and encodings; many levels become numbers; nothing asked for is missing."""
    df = spark.createDataFrame([(i, float(i % 5), float(i), f"k{i % 3}", f"v{i:02d}") for i in range(24)], "id int, a double, b double, few string, many string")
    out = features.engineer(df, None, ["a", "b"], ["few", "many", "absent"])
    assert {"a_x_b", "a_div_b", "a_pow2", "row_mean", "row_skew", "few_k1", "few_k2", "many_encoded"} <= set(out.columns)
    assert not {"few", "many"} & set(out.columns) and not any("_lag_" in c for c in out.columns)
    assert rows(out, "id", "few_k1", "many_encoded")[0] == (0, 0, 0) and out.count() == 24


def test_scaler_leaves_constant_columns_alone(spark):
    df = spark.range(1000).select((F.col("id") * 1.0).alias("x"), F.sin(F.lit(0.5)).alias("c"))
    out = features.scale(df, ["x", "c"]).agg(F.max(F.abs("c")).alias("c"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).first()
    assert out["c"] < 1e-9 and abs(out["m"]) < 1e-9 and out["s"] == pytest.approx(1.0)
    ranked = features.select_by_f_test(df.withColumn("y", F.col("x") + F.rand(3)), "y", ["x", "c"], 5)
    assert [r["feature"] for r in ranked.collect()] == ["x"]


@pytest.mark.parametrize("sizes", [(12, 4), (2_000, 16)])
def test_nearest_imputation_by_cells_equals_all_pairs(spark, monkeypatch, sizes):
    """Many equal points, infinities, NaN, null and repeated keys; the cells give what all pairs give, and rows look in few of them."""
    from tradewind.operators import nearest

    monkeypatch.setattr(nearest, "PER_CELL", sizes[1])
    monkeypatch.setattr(nearest, "LEAST", 30)
    rng = np.random.default_rng(8)
    data = np.column_stack([rng.integers(0, 6, 900) / 2, rng.normal(0, 30, 900).round(1), rng.exponential(9, 900)]).tolist()
    data = [[None if rng.uniform() < 0.15 else v for v in row] for row in data]
    data[3][0], data[4][0], data[5][1], data[6][2] = float("inf"), float("-inf"), float("nan"), float("inf")
    rows = [(i, *r) for i, r in enumerate(data)]
    df = spark.createDataFrame(rows + rows[40:60] + [(None, None, 3.0, 1.0), (None, 1.0, 3.0, 1.0)], "id bigint, a double, b double, c double").repartition(5)
    got = clean.impute_nearest(df, ["a", "b", "c"], "id", tile_rows=sizes[0])
    monkeypatch.setattr(clean, "SPACES", 0)
    want = clean.impute_nearest(df, ["a", "b", "c"], "id")
    a, b = ([[None if v is None else repr(round(v, 9)) for v in r] for r in rows_of.collect()] for rows_of in (got, want))
    assert sorted(a, key=str) == sorted(b, key=str)
    points = rng.normal(0, 1, (4_000, 2))
    tree = nearest.grow_cells(points[:500], np.ones(500, bool), 5, 16)
    row, _, _ = nearest.reached(tree, points, 2, 5)
    assert len(row) < 8 * len(points)


def test_forest_of_a_short_series_stays_in_its_task(spark, monkeypatch):
    """No forest is stored or joined for series of one chunk, and its scores are those of the joined steps."""
    from tradewind.operators import isolation

    pool = np.random.default_rng(4).exponential(9, 90).round(1)
    for sample, x in ((256, pool), (64, pool), (64, np.append(pool, [0.0, 99.0]))):
        cuts, scores = isolation.step_forest(pool, 30, sample, 5)
        assert (isolation.forest_scores(x, pool, 30, sample, 5) == scores[np.searchsorted(cuts, x, side="right")]).all()

    def never(df):
        raise AssertionError("stored")

    monkeypatch.setattr(isolation, "checkpointed", never)
    df = spark.createDataFrame([("a", i, i, float(x)) for i, x in enumerate(pool)] + [("a", 90, 90, 500.0)], "series_id string, ts int, id int, price double")
    found = clean.series_anomalies(df, "price")
    assert found.where("method = 'isolation_forest' and id = 90").first()["anomalies"] >= 1
    assert "applyInArrow" not in str(found.where("method = 'statistical'")._jdf.queryExecution().optimizedPlan()) and found.where("method = 'statistical'").count() == 1


def test_cleaning_history_counts_each_state_once(spark, monkeypatch):
    from pyspark.sql import DataFrame

    counts, count = [], DataFrame.count
    df = spark.createDataFrame([(float(i % 7), "a" if i % 3 else None) for i in range(40)], "x double, k string")
    monkeypatch.setattr(DataFrame, "count", lambda self: counts.append(1) or count(self))
    steps: list = []
    clean.clean(df, history=steps)
    assert len(counts) <= 8
    monkeypatch.undo()
    assert [(r["rows_in"], r["rows_out"]) for s in steps for r in s.collect()] == [(40, 40), (40, 14), *[(14, 14)] * 5]


def test_series_anomalies_query_has_both_methods(spark, tmp_path):
    """One planted value a series; the query gives the rows of |z| > 3 and those of each series' forest."""
    from __spark_entry__ import queries

    rng = np.random.default_rng(6)
    events = [(211 * 11 * s + 1 + 11 * i, dt.datetime(2024, 1, 1, 0, i), s, "view", 900.0 if i == 7 else float(x), "") for s in (1, 2) for i, x in enumerate(rng.normal(50, 2, 60))]
    events += [(5_000_001 + 11 * i, dt.datetime(2024, 1, 1, 0, i), 3, "view", 9.0 * i, "") for i in range(10)]  # too short for a forest
    spark.createDataFrame(events, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    found = queries()["series_anomalies"](spark, str(tmp_path)).collect()
    assert {r["method"] for r in found} == {"statistical", "isolation_forest"} and {r["series_id"] for r in found} == {1, 2}
    for method in ("statistical", "isolation_forest"):
        for s in (1, 2):
            own = [r for r in found if (r["method"], r["series_id"]) == (method, s)]
            assert max(r["price"] for r in own) > 800 and all(r["anomalies"] == len(own) for r in own)
            assert len(own) == 1 if method == "statistical" else 2 <= len(own) <= 7
    halves = [rows(queries()[f"series_{h}_anomalies"](spark, str(tmp_path)), "series_id", "method", "ts", "anomalies") for h in ("statistical", "forest")]
    assert sorted(halves[0] + halves[1], key=str) == sorted([(r["series_id"], r["method"], r["ts"], r["anomalies"]) for r in found], key=str)


def test_trees_of_a_series_draw_from_all_its_rows(spark, monkeypatch):
    """The first 4,096 rows by hash are equal and the trees must reach the others; chunks of a series draw the same rows as the whole."""
    from tradewind.operators import isolation

    ids = spark.range(6_000).select(F.lit("a").alias("series_id"), F.col("id").cast("int").alias("ts"), "id")
    first = F.row_number().over(Window.partitionBy("series_id").orderBy(F.xxhash64(F.lit(42), "ts", "id"))) <= 4_096
    df = ids.withColumn("price", F.when(first, 5.0).otherwise(5.0 + F.col("id") % 400)).repartition(4)

    def found(**kw):
        some = df.withColumn("price", F.col("id") % 997 * 1.0) if kw else df
        return rows(isolation.series_outliers(some, "price", ["series_id"], ["ts", "id"], **kw).withColumn("score", F.round("score", 9)))

    whole, few = found(), found(trees=20, sample=16)  # 320 rows at most are drawn, of 6,000
    assert len({r[3] for r in whole}) > 50 and 5.0 not in {r[3] for r in whole}
    monkeypatch.setattr(isolation, "CHUNK", 500)
    assert found() == whole and found(trees=20, sample=16) == few and few


def test_rows_drawn_stand_for_any_of_the_series():
    """Few rows in random order are enough for trees that draw from many: each tree has different rows, all rows are alike."""
    from tradewind.operators import isolation

    rng, seen, n = np.random.default_rng(2), np.zeros(40), 40
    for seed in range(400):
        order = rng.permutation(n)
        drawn = [d for d in _drawn(isolation, order[:12].astype(float), 3, 4, seed, n)]
        assert all(len(set(d)) == 4 for d in drawn)
        for d in drawn:
            seen[np.array(d, int)] += 1
    assert abs(seen / 400 - 3 * 4 / n).max() < 0.12  # 0.3 a row


def _drawn(isolation, pool, trees, size, seed, n):
    """The values that each tree is grown from."""
    took, pieces = [], isolation._pieces
    try:
        isolation._pieces = lambda values, *a: took.append(values) or pieces(values, *a)
        list(isolation._grown(pool, trees, size, seed, n))
    finally:
        isolation._pieces = pieces
    return took


def test_nan_and_infinite_values_of_a_series_are_no_anomalies(spark):
    """NaN is left out as NULL is; a series of infinite range has no part and does not end the others."""
    data = [(k, i, i, float(i % 5)) for k in ("nan", "inf", "plain") for i in range(40)] + [(k, 40, 40, 90.0) for k in ("nan", "inf", "plain")]
    data += [("nan", 41, 41, float("nan")), ("inf", 41, 41, float("inf"))]
    found = clean.series_anomalies(spark.createDataFrame(data, "series_id string, ts int, id int, price double"), "price").collect()
    assert {(r["series_id"], r["id"]) for r in found if r["method"] == "statistical"} == {("nan", 40), ("plain", 40)}
    assert {("nan", 40), ("plain", 40)} <= {(r["series_id"], r["id"]) for r in found if r["method"] == "isolation_forest"}
    assert not any(r["series_id"] == "inf" or r["id"] == 41 for r in found)
