"""Series tests, isolation forest and model queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tradewind.catalog.registry import query
from tradewind.operators import isolation, ml
from tradewind.operators import series as S
from tradewind.operators import stationarity as ST
from tradewind.operators.disruption import label_disrupted
from tradewind.operators.ports import congestion_index
from tradewind.session import shared_folder


@query("unit_root_test")
def unit_root_test(t):
    return ST.unit_root(t.series, "price")


@query("unit_root_fixed_lag", """WITH x AS (SELECT series_id, price, price - lag(price) OVER w AS d, lag(price) OVER w AS l, row_number() OVER w AS pos FROM series WINDOW w AS (PARTITION BY series_id ORDER BY ts, id)),
    r AS (SELECT series_id, d AS y, l AS a, lag(d) OVER (PARTITION BY series_id ORDER BY pos) AS b FROM x),
    s AS (SELECT series_id, count(*) AS m, var_pop(y) AS yy, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS yb FROM r WHERE b IS NOT NULL GROUP BY series_id),
    f AS (SELECT *, aa * bb - ab * ab AS det, (ay * bb - ab * yb) / (aa * bb - ab * ab) AS beta, (yb * aa - ab * ay) / (aa * bb - ab * ab) AS other FROM s)
    SELECT series_id, CAST(1 AS BIGINT) AS used_lag, beta / sqrt((yy - beta * ay - other * yb) / (m - 3) * bb / det) AS statistic FROM f WHERE m >= 4""", uses="series", rnd="statistic")
def unit_root_fixed_lag(t):
    """The statistic at one lag; its normal equations are three sums of squares and three of products. Shorter series have none."""
    return ST.unit_root(t.series, "price", max_lag=1, choose=False).select("series_id", "used_lag", "statistic")


KPSS = """WITH m AS (SELECT series_id, avg(price) AS m, count(*) AS n FROM series GROUP BY series_id),
    e AS (SELECT s.series_id, n, price - m AS e, row_number() OVER w AS pos, sum(price - m) OVER (w ROWS UNBOUNDED PRECEDING) AS cs FROM series s JOIN m USING (series_id) WINDOW w AS (PARTITION BY s.series_id ORDER BY ts, id)),
    p AS (SELECT a.series_id, a.pos - b.pos AS i, sum(a.e * b.e) AS p FROM e a JOIN e b ON a.series_id = b.series_id AND b.pos <= a.pos GROUP BY ALL),
    g AS (SELECT series_id, any_value(n) AS n, sum(cs * cs) AS eta FROM e GROUP BY series_id),
    c AS (SELECT g.series_id, n, eta, max(p.p) FILTER (i = 0) AS p0, floor(pow(any_value(n), 2 / 9) + 1e-9) AS cov FROM g JOIN p USING (series_id) GROUP BY series_id, n, eta),
    l AS (SELECT c.series_id, c.n, eta, p0, p0 / c.n + coalesce(sum(2 * p.p / c.n) FILTER (i BETWEEN 1 AND cov), 0) AS s0, coalesce(sum(i * 2 * p.p / c.n) FILTER (i BETWEEN 1 AND cov), 0) AS s1 FROM c JOIN p USING (series_id) GROUP BY c.series_id, c.n, eta, p0),
    k AS (SELECT *, CAST(least(floor(1.1447 * pow(pow(s1 / s0, 2), 1 / 3) * pow(n, 1 / 3)), n - 1) AS BIGINT) AS lags FROM l),
    s AS (SELECT k.series_id, lags, (eta / (n * n)) / ((p0 + coalesce(sum(2 * p.p * (1 - i / (lags + 1))) FILTER (i BETWEEN 1 AND lags), 0)) / n) AS statistic FROM k JOIN p USING (series_id) GROUP BY k.series_id, lags, eta, n, p0)
    SELECT *, pv AS p_value, pv > 0.05 AS stationary FROM (SELECT *, CASE WHEN statistic <= 0.347 THEN 0.1 WHEN statistic <= 0.463 THEN 0.1 + (statistic - 0.347) / 0.116 * -0.05
        WHEN statistic <= 0.574 THEN 0.05 + (statistic - 0.463) / 0.111 * -0.025 WHEN statistic <= 0.739 THEN 0.025 + (statistic - 0.574) / 0.165 * -0.015 ELSE 0.01 END AS pv FROM s)"""


@query("level_stationarity_test", "SELECT series_id, lags, statistic, p_value, stationary FROM (" + KPSS.replace("OVER (w ROWS UNBOUNDED PRECEDING)", "OVER (PARTITION BY s.series_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING)") + ")", uses="series", rnd="statistic p_value")
def level_stationarity_test(t):
    return ST.level_stationarity(t.series, "price")


@query("outliers_isolation_forest")
def outliers_isolation_forest(t):
    rows = t.series_gaps.select("id", "price", "ratio")
    return isolation.isolation_outliers(rows, ["price", "ratio"], ["id"])


PORT_FEATURES = ["throughput", "vessel_arrivals", "congestion_index", "congestion_lag_1", "month"]


def port_training(t):
    rows = t.port_metrics.select(
        "port_name", "ts", "throughput", "vessel_arrivals", congestion_index().alias("congestion_index"), F.month("ts").alias("month"))
    lagged = S.lag_features(rows, ["congestion_index"], (1,), ["port_name"], ["ts"]).withColumnRenamed("congestion_index_lag_1", "congestion_lag_1")
    return S.lead_labels(lagged, "congestion_index", 1, "target", ["port_name"], ["ts"]).na.drop()


def port_model(t, trees: int = 100, depth: int = 10):
    return ml.train_regression(
        port_training(t), ml.forest_regressor(PORT_FEATURES, "target", trees, depth), "target", ["port_name", "ts"])


@query("train_port_congestion")
def train_port_congestion(t):
    return port_model(t)[1]


@query("port_feature_importance")
def port_feature_importance(t):
    return ml.importances(port_model(t)[0], PORT_FEATURES)


SHIP_FEATURES = ["value", "kind", "hour", "weekday"]


def route_training(t):
    hits = t.events.where("value > 300").select(F.col("ts").alias("start"), (F.col("event_id") % 4).cast("int").alias("duration_days"))
    rows = t.events.select(
        "event_id", "ts", "value", (F.length("event_type") * 1.0).alias("kind"), F.hour("ts").alias("hour"), F.weekday("ts").alias("weekday"))
    return label_disrupted(rows, hits, lead_days=1)


@query("train_route_disruption")
def train_route_disruption(t):
    return ml.train_classifier(route_training(t), ml.boosted_classifier(SHIP_FEATURES, "label"), "label", ["event_id"])[1]


RATE_FEATURES = ["price", "rate_change", "volatility", "volume"]


def rate_training(t):
    v = S.change_volatility(t.series, "price")
    return S.lead_labels(v, "volatility", 7, "target").na.drop(subset=[*RATE_FEATURES, "target"])


@query("train_rate_volatility")
def train_rate_volatility(t):
    return ml.train_regression(rate_training(t), ml.forest_regressor(RATE_FEATURES, "target", 100, 8), "target", ["id"])[1]


COMPANY_FEATURES = ["supply_chain_complexity", "international_exposure", "inventory_turnover", "beta"]


def company_training(t):
    rows = t.companies.join(t.company_impacts.select("symbol", "impact_score"), "symbol")
    return rows.select("symbol", *COMPANY_FEATURES, F.col("impact_score").alias("target"))


@query("train_company_impact")
def train_company_impact(t):
    return ml.train_regression(company_training(t), ml.linear_regressor(COMPANY_FEATURES, "target"), "target", ["symbol"])[1]


@query("company_impact_line", """SELECT sector, regr_slope(impact_score, supply_chain_complexity) AS slope, regr_intercept(impact_score, supply_chain_complexity) AS intercept,
    regr_r2(impact_score, supply_chain_complexity) AS r2, count(*) AS n FROM (SELECT c.sector, c.supply_chain_complexity, i.impact_score FROM companies c JOIN company_impacts i USING (symbol)) GROUP BY sector""",
       uses="companies company_impacts", rnd="slope intercept r2")
def company_impact_line(t):
    rows = t.companies.select("symbol", "sector", "supply_chain_complexity").join(t.company_impacts.select("symbol", "impact_score"), "symbol")
    return ml.simple_regression(rows, "supply_chain_complexity", "impact_score", ["sector"])


@query("cross_validation")
def cross_validation(t):
    return ml.cross_validate(company_training(t), ml.linear_regressor(COMPANY_FEATURES, "target"), "target", ["symbol"])


@query("classification_metrics", """WITH s AS (SELECT toxic = 1 AS y, n_chars > 1000 AS p FROM documents JOIN labels USING (doc_id)), c AS (SELECT count(*) AS n, count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp,
    count(*) FILTER (y AND NOT p) AS fn, count(*) FILTER (y = p) AS r FROM s) SELECT n, r / n AS accuracy, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall,
    2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0) AS f1 FROM c""", rnd="accuracy precision recall f1")
def classification_metrics(t):
    rows = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id").select("toxic", (F.col("n_chars") > 1000).cast("int").alias("guess"))
    return ml.classification_metrics(rows, "toxic", "guess")


@query("regression_metrics", """SELECT count(*) AS n, avg(pow(y - p, 2)) AS mse, avg(abs(y - p)) AS mae, 1 - sum(pow(y - p, 2)) / (var_pop(y) * count(y)) AS r2
    FROM (SELECT l_extendedprice AS y, l_quantity * 2000.0 AS p FROM lineitem)""", rnd="mse mae r2", places=2)
def regression_metrics(t):
    rows = t.lineitem.select("l_extendedprice", (F.col("l_quantity") * 2000.0).alias("guess"))
    return ml.regression_metrics(rows, "l_extendedprice", "guess")


@query("reloaded_model_scores", """SELECT symbol, slope * supply_chain_complexity + intercept AS score FROM companies
    CROSS JOIN (SELECT regr_slope(impact_score, supply_chain_complexity) AS slope, regr_intercept(impact_score, supply_chain_complexity) AS intercept FROM companies JOIN company_impacts USING (symbol))""",
       uses="companies company_impacts", rnd="score")
def reloaded_model_scores(t):
    """The training driver fits a line, it is saved, loaded again and scores every company."""
    rows = company_training(t)
    trainers = {"company_impact": lambda: (ml.linear_regressor(["supply_chain_complexity"], "target").fit(rows), None)}
    folder = f"{shared_folder(t.spark)}/models-{uuid.uuid4().hex}"
    ml.save_models(ml.train_all(trainers), folder)
    kept = ml.train_all(trainers, ml.load_models(["company_impact"], folder))
    return ml.predict(kept["company_impact"], t.companies.select("symbol", "supply_chain_complexity"), "score").select("symbol", "score")
