"""Window and time-series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewind.catalog.registry import query
from tradewind.functions import calendar
from tradewind.operators import series as S
from tradewind.operators import vessels

W = "PARTITION BY series_id ORDER BY ts, id"


def frame(k: int) -> str:
    return f"OVER ({W} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def full(expr: str, col: str, k: int) -> str:
    return f"CASE WHEN count({col}) {frame(k)} = {k} THEN {expr} {frame(k)} END"


def cols(pairs) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in pairs)


def names(pairs) -> str:
    return " ".join(n for n, _ in pairs)


LAGS = [(f"price_lag_{k}", f"lag(price, {k}) OVER ({W})") for k in (1, 3, 7, 14)]


@query("lag_features", f"SELECT id, {cols(LAGS)} FROM series", uses="series", rnd=names(LAGS))
def lag_features(t):
    return S.lag_features(t.series.select("series_id", "ts", "id", "price"), ["price"]).drop("series_id", "ts", "price")


LAGS2 = [(f"{c}_lag_{k}", f"lag({c}, {k}) OVER ({W})") for c in ("price", "volume") for k in (1, 7, 30)]


@query("lag_features_sorted", f"SELECT id, {cols(LAGS2)} FROM series", uses="series", rnd="price_lag_1")
def lag_features_sorted(t):
    out = S.lag_features(t.series, ["price", "volume"], (1, 7, 30))
    return out.select("id", *[n for n, _ in LAGS2])


FN = {"mean": "avg(price)", "std": "stddev_samp(price)", "min": "min(price)", "max": "max(price)",
      "median": "quantile_cont(price, 0.5)"}
ROLL = [(f"price_{f}_{k}", f"{e} {frame(k)}") for k in (7, 14, 30, 60) for f, e in FN.items()]


@query("rolling_features", f"SELECT id, {cols(ROLL)} FROM series", uses="series", rnd=names(ROLL))
def rolling_features(t):
    return S.rolling_features(t.series, ["price"]).select("id", *[n for n, _ in ROLL])


ROLLF = [(f"price_{f}_{k}", full(FN[f], "price", k)) for k in (7, 14, 30) for f in ("mean", "std", "min", "max")]


@query("rolling_features_full", f"SELECT id, {cols(ROLLF)} FROM series", uses="series", rnd=names(ROLLF))
def rolling_features_full(t):
    out = S.rolling_features(t.series, ["price"], (7, 14, 30), ("mean", "std", "min", "max"), only_full=True)
    return out.select("id", *[n for n, _ in ROLLF])


ROLLN = [(f"price_{f}_7", f"{e} {frame(7)}") for f, e in
         (("sum", "sum(price)"), ("count", "count(price)"), ("var", "var_samp(price)"))]


@query("rolling_by_name", f"SELECT id, {cols(ROLLN)} FROM series_gaps", uses="series_gaps", rnd="price_sum_7 price_var_7", places=4)
def rolling_by_name(t):
    out = S.rolling_features(t.series_gaps, ["price"], (7,), ("sum", "count", "var"))
    return out.select("id", *[n for n, _ in ROLLN])


@query("group_zscore", """SELECT id, (price - avg(price) OVER (PARTITION BY series_id))
    / (stddev_samp(price) OVER (PARTITION BY series_id) + 1e-8) AS price_zscore FROM series""", uses="series", rnd="price_zscore")
def group_zscore(t):
    return S.z_scores(t.series.select("series_id", "id", "price"), "price").select("id", "price_zscore")


@query("group_percentile_rank", """SELECT id, CASE WHEN price IS NOT NULL THEN
    (rank() OVER (PARTITION BY series_id ORDER BY price NULLS LAST) + (count(*) OVER (PARTITION BY series_id, price) - 1) / 2.0)
    / count(price) OVER (PARTITION BY series_id) END AS price_percentile FROM series_gaps""",
       uses="series_gaps", rnd="price_percentile")
def group_percentile_rank(t):
    return S.percentile_ranks(t.series_gaps.select("series_id", "id", "price"), "price").select("id", "price_percentile")


CHG = [("price_change", f"price - lag(price) OVER ({W})")] + [
    (f"price_volatility_{k}d", f"stddev_samp(price) {frame(k)}") for k in (7, 14, 30)]


@query("change_features", f"SELECT id, {cols(CHG)} FROM series", uses="series", rnd=names(CHG))
def change_features(t):
    return S.change_features(t.series, "price").select("id", *[n for n, _ in CHG])


FILLED = f"SELECT *, last_value(price IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS f FROM series_gaps"


@query("padded_pct_change", f"SELECT id, f / nullif(lag(f) OVER ({W}), 0) - 1 AS price_pct_change FROM ({FILLED})",
       uses="series_gaps", rnd="price_pct_change")
def padded_pct_change(t):
    return S.padded_change(t.series_gaps, "price").select("id", "price_pct_change")


ROC = [(f"price_roc_{k}", f"f / nullif(lag(f, {k}) OVER ({W}), 0) - 1") for k in (1, 5, 10)]


@query("rate_of_change", f"SELECT id, {cols(ROC)} FROM ({FILLED})", uses="series_gaps", rnd=names(ROC))
def rate_of_change(t):
    return S.padded_change(t.series_gaps, "price", (1, 5, 10), "price_roc").select("id", *[n for n, _ in ROC])


SMA = [(f"price_sma_{k}", full("avg(price)", "price", k)) for k in (5, 10, 20, 50)]


@query("simple_moving_averages", f"SELECT id, {cols(SMA)} FROM series", uses="series", rnd=names(SMA))
def simple_moving_averages(t):
    return S.moving_averages(t.series, "price").select("id", *[n for n, _ in SMA])


def ema_sql(src: str, col: str, spans, prefix: str, keep: str = "id") -> str:
    """Weighted fold over all earlier rows of the series, newest weight 1."""
    def one(s):
        q = 1 - 2 / (s + 1)
        fold = "list_reduce({}, lambda a, x: a * {} + x)"
        vals = f"list(CAST(coalesce({col}, 0) AS DOUBLE)) OVER ({W})"
        ones = f"list(CASE WHEN {col} IS NULL THEN 0e0 ELSE 1e0 END) OVER ({W})"
        return f"{fold.format(vals, q)} / nullif({fold.format(ones, q)}, 0) AS {prefix}{s}"

    return f"SELECT {keep}, {', '.join(one(s) for s in spans)} FROM {src}"


@query("exponential_moving_averages", ema_sql("series", "price", (5, 10, 20, 50), "price_ema_"), uses="series",
       rnd="price_ema_5 price_ema_10 price_ema_20 price_ema_50")
def exponential_moving_averages(t):
    return S.ema(t.series, "price").select("id", *[f"price_ema_{s}" for s in (5, 10, 20, 50)])


@query("exponential_average_gaps", ema_sql("series_gaps", "price", (5, 20), "price_ema_"), uses="series_gaps",
       rnd="price_ema_5 price_ema_20")
def exponential_average_gaps(t):
    return S.ema(t.series_gaps, "price", (5, 20)).select("id", "price_ema_5", "price_ema_20")


@query("relative_strength", f"""WITH d AS (SELECT *, price - lag(price) OVER ({W}) AS d FROM series),
    g AS (SELECT *, coalesce(greatest(d, 0.0), 0) AS gain, coalesce(greatest(-d, 0.0), 0) AS loss FROM d),
    m AS (SELECT id, {full('avg(gain)', 'gain', 14)} AS ag, {full('avg(loss)', 'loss', 14)} AS al FROM g)
    SELECT id, CASE WHEN al = 0 AND ag > 0 THEN 100.0 WHEN al = 0 THEN NULL ELSE 100 - 100 / (1 + ag / al) END AS price_rsi FROM m""",
       uses="series", rnd="price_rsi")
def relative_strength(t):
    return S.rsi(t.series, "price").select("id", "price_rsi")


@query("bollinger_bands", f"""WITH b AS (SELECT id, price, {full('avg(price)', 'price', 20)} AS m, {full('stddev_samp(price)', 'price', 20)} AS s FROM series)
    SELECT id, m + 2 * s AS bollinger_upper, m - 2 * s AS bollinger_lower, 4 * s AS bollinger_width,
    (price - (m - 2 * s)) / nullif(4 * s, 0) AS bollinger_position FROM b""", uses="series",
       rnd="bollinger_upper bollinger_lower bollinger_width bollinger_position")
def bollinger_bands(t):
    return S.bollinger(t.series, "price").select(
        "id", "bollinger_upper", "bollinger_lower", "bollinger_width", "bollinger_position")


@query("macd", f"""WITH e AS ({ema_sql('series', 'price', (12, 26), 'e', 'series_id, ts, id')}),
    m AS (SELECT *, e12 - e26 AS macd FROM e), s AS ({ema_sql('m', 'macd', (9,), 'sig', 'id, macd')})
    SELECT id, macd, sig9 AS macd_signal, macd - sig9 AS macd_histogram FROM s""", uses="series",
       rnd="macd macd_signal macd_histogram")
def macd(t):
    return S.macd(t.series, "price").select("id", "macd", "macd_signal", "macd_histogram")


@query("volume_indicators", f"""WITH v AS (SELECT *, {full('avg(volume)', 'volume', 20)} AS m,
        volume * sign(price - lag(price) OVER ({W})) AS flow FROM series)
    SELECT id, m AS volume_sma_20, volume / m AS volume_ratio,
        CAST(sum(flow) OVER ({W} ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS obv FROM v""",
       uses="series", rnd="volume_sma_20 volume_ratio")
def volume_indicators(t):
    return S.volume_features(t.series, "price", "volume").select("id", "volume_sma_20", "volume_ratio", "obv")


C6 = f"OVER ({W} ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"


@query("seasonal_decomposition", f"""WITH p AS (SELECT *, row_number() OVER ({W}) - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS n FROM series),
    t AS (SELECT *, CASE WHEN pos >= 6 AND pos < n - 6 THEN
        (sum(price) {C6} + (lag(price, 6) OVER ({W}) + lead(price, 6) OVER ({W})) / 2) / 12 END AS trend FROM p WHERE n >= 24),
    m AS (SELECT series_id, pos % 12 AS phase, avg(price - trend) AS pm FROM t GROUP BY ALL),
    c AS (SELECT series_id, avg(pm) AS c FROM m GROUP BY ALL)
    SELECT id, trend, pm - c AS seasonal, price - trend - (pm - c) AS residual
    FROM t JOIN m ON m.series_id = t.series_id AND phase = pos % 12 JOIN c ON c.series_id = t.series_id""",
       uses="series", rnd="trend seasonal residual")
def seasonal_decomposition(t):
    return S.decompose(t.series, "price").select("id", "trend", "seasonal", "residual")


@query("differencing", f"SELECT id, price - lag(price, 2) OVER ({W}) AS price_diff_2 FROM series", uses="series", rnd="price_diff_2")
def differencing(t):
    return S.differences(t.series, "price", 2).select("id", "price_diff_2")


@query("forward_fill", f"SELECT id, f AS filled FROM ({FILLED})", uses="series_gaps", rnd="filled")
def forward_fill(t):
    return S.fill(t.series_gaps, "price", "filled").select("id", "filled")


@query("backward_fill", f"""SELECT id, first_value(price IGNORE NULLS) OVER ({W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    AS filled FROM series_gaps""", uses="series_gaps", rnd="filled")
def backward_fill(t):
    return S.fill(t.series_gaps, "price", "filled", backward=True).select("id", "filled")


@query("label_shift", f"""SELECT id, coalesce(lead(price, 1) OVER ({W}), 0) AS next_1, coalesce(lead(price, 7) OVER ({W}), 0) AS next_7
    FROM series""", uses="series", rnd="next_1 next_7")
def label_shift(t):
    one = S.lead_labels(t.series, "price", 1, "next_1")
    return S.lead_labels(one, "price", 7, "next_7").select("id", "next_1", "next_7")


@query("rate_change_volatility", f"""WITH c AS (SELECT *, price / nullif(lag(price) OVER ({W}), 0) - 1 AS r FROM series)
    SELECT id, r AS rate_change, {full('stddev_samp(r)', 'r', 7)} AS volatility FROM c""", uses="series", rnd="rate_change volatility")
def rate_change_volatility(t):
    return S.change_volatility(t.series, "price").select("id", "rate_change", "volatility")


@query("series_volatility", f"""WITH c AS (SELECT *, price / nullif(lag(price) OVER ({W}), 0) - 1 AS r FROM series),
    k AS (SELECT * FROM c WHERE r IS NOT NULL), v AS (SELECT *, {full('stddev_samp(r)', 'r', 30)} AS v FROM k)
    SELECT series_id, stddev_samp(r) AS std_volatility, sqrt(sum(r * r)) AS realized_volatility,
    CASE WHEN count(r) > 30 THEN avg(v) ELSE 0.0 END AS rolling_volatility FROM v GROUP BY series_id""",
       uses="series", rnd="std_volatility realized_volatility rolling_volatility")
def series_volatility(t):
    return S.series_volatility(t.series, "price")


SPAN = "OVER (PARTITION BY service, client ORDER BY ts RANGE BETWEEN INTERVAL 1 {0} PRECEDING AND CURRENT ROW)"


@query("requests_in_window", f"""SELECT id, count(*) {SPAN.format('SECOND')} AS last_second, count(*) {SPAN.format('MINUTE')} AS last_minute,
    count(*) {SPAN.format('HOUR')} AS last_hour FROM request_log""",
       uses="request_log")
def requests_in_window(t):
    spans = {"last_second": 1, "last_minute": 60, "last_hour": 3600}
    return vessels.requests_before(t.request_log, ["service", "client"], "ts", spans).select("id", *spans)


@query("series_momentum", f"""WITH r AS (SELECT *, row_number() OVER ({W}) AS a, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC, id DESC) AS d FROM series),
    g AS (SELECT series_id, count(*) AS n, avg(price) FILTER (a <= 2) AS h2, avg(price) FILTER (d <= 2) AS t2,
        max(price) FILTER (a = 1) AS h1, max(price) FILTER (d = 1) AS t1 FROM r GROUP BY series_id)
    SELECT series_id, n, CASE WHEN n >= 4 AND h2 > 0 THEN (t2 - h2) / h2 WHEN n >= 2 AND n < 4 AND h1 > 0 THEN (t1 - h1) / h1 ELSE 0.0 END AS momentum
    FROM g""", uses="series", rnd="momentum")
def series_momentum(t):
    return S.momentum(t.series, "price")


@query("series_summary", """WITH a AS (SELECT series_id, ts, avg(price) AS x FROM series GROUP BY ALL)
    SELECT series_id, count(*) AS n, min(ts) AS start, max(ts) AS "end", avg(x) AS mean, stddev_samp(x) AS std, min(x) AS low, max(x) AS high,
    skewness(x) AS skew, kurtosis(x) AS kurtosis FROM a GROUP BY series_id""", uses="series", rnd="mean std low high skew kurtosis", places=5)
def series_summary(t):
    return S.series_summary(t.series, "price")


@query("inferred_frequency", """WITH d AS (SELECT DISTINCT origin, CAST(ts AS DATE) AS day FROM lane_rates),
    g AS (SELECT origin, epoch_us(CAST(day AS TIMESTAMP)) - lag(epoch_us(CAST(day AS TIMESTAMP))) OVER (PARTITION BY origin ORDER BY day) AS gap FROM d),
    c AS (SELECT origin, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY ALL)
    SELECT origin, arg_max(gap, n * 1000000000000000.0 - gap) AS modal_gap, count(*) AS distinct_gaps,
    CASE WHEN count(*) = 1 THEN min(gap) END AS regular_gap FROM c GROUP BY origin""", uses="lane_rates")
def inferred_frequency(t):
    days = t.lane_rates.select("origin", F.to_date("ts").alias("day"))
    return S.inferred_frequency(days, ["origin"], "day")


PARTS = "year(ts) AS year, month(ts) AS month, day(ts) AS day, isodow(ts) - 1 AS dayofweek, dayofyear(ts) AS dayofyear, quarter(ts) AS quarter, week(ts) AS week"


@query("calendar_parts", f"SELECT id, {PARTS} FROM series", uses="series")
def calendar_parts(t):
    return t.series.select("id", *[c.alias(n) for n, c in calendar.calendar_parts("ts").items()])


CYC = [(f"{n}_{f}", f"{f}(2 * pi() * {p} / {k})") for n, p, k in
       (("month", "month(ts)", 12), ("dayofweek", "(isodow(ts) - 1)", 7), ("dayofyear", "dayofyear(ts)", 365), ("day", "day(ts)", 31))
       for f in ("sin", "cos")]


@query("cyclic_encodings", f"SELECT id, {cols(CYC)} FROM series", uses="series", rnd=names(CYC))
def cyclic_encodings(t):
    return t.series.select("id", *[c.alias(n) for n, c in calendar.cyclic_parts("ts").items()])


FLAGS = """CAST(isodow({0}) >= 6 AS BIGINT) AS is_weekend, CAST(day({0}) = 1 AS BIGINT) AS is_month_start,
    CAST(CAST({0} AS DATE) = last_day({0}) AS BIGINT) AS is_month_end,
    CAST(CAST({0} AS DATE) = date_trunc('quarter', {0}) AS BIGINT) AS is_quarter_start,
    CAST(CAST({0} AS DATE) = last_day(date_trunc('quarter', {0}) + INTERVAL 2 MONTH) AS BIGINT) AS is_quarter_end"""


@query("calendar_flags", f"SELECT o_orderkey, {FLAGS.format('o_orderdate')} FROM orders")
def calendar_flags(t):
    return t.orders.select("o_orderkey", *[c.alias(n) for n, c in calendar.calendar_flags("o_orderdate").items()])


@query("prefixed_datetime_features", """SELECT id, year(ts) AS ts_year, month(ts) AS ts_month, day(ts) AS ts_day, isodow(ts) - 1 AS ts_dayofweek,
    quarter(ts) AS ts_quarter, hour(ts) AS ts_hour, sin(2 * pi() * month(ts) / 12) AS ts_month_sin, cos(2 * pi() * month(ts) / 12) AS ts_month_cos,
    sin(2 * pi() * day(ts) / 31) AS ts_day_sin, cos(2 * pi() * day(ts) / 31) AS ts_day_cos, CAST(isodow(ts) >= 6 AS BIGINT) AS ts_is_weekend,
    CAST(CAST(ts AS DATE) = last_day(ts) AS BIGINT) AS ts_is_month_end,
    CAST(CAST(ts AS DATE) = last_day(date_trunc('quarter', ts) + INTERVAL 2 MONTH) AS BIGINT) AS ts_is_quarter_end FROM series""",
       uses="series", rnd="ts_month_sin ts_month_cos ts_day_sin ts_day_cos")
def prefixed_datetime_features(t):
    return t.series.select("id", *[c.alias(n) for n, c in calendar.prefixed_features("ts").items()])


TEXT = """CASE event_id % 4 WHEN 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S')
    WHEN 1 THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN strftime(date_trunc('minute', ts), '%m/%d/%Y %H:%M')
    ELSE concat('soon ', event_id) END"""


@query("parse_arrival_time", f"""SELECT id, coalesce(try_strptime(txt, '%Y-%m-%d %H:%M:%S'), try_strptime(txt, '%Y-%m-%dT%H:%M:%S'),
    try_strptime(txt, '%m/%d/%Y %H:%M')) AS eta FROM (SELECT event_id AS id, {TEXT} AS txt FROM events)""")
def parse_arrival_time(t):
    n = F.col("event_id") % 4
    text = (
        F.when(n == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(n == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
        .when(n == 2, F.date_format("ts", "MM/dd/yyyy HH:mm"))
        .otherwise(F.concat(F.lit("soon "), F.col("event_id").cast("string"))))
    return t.events.select(F.col("event_id").alias("id"), calendar.parse_time(text).alias("eta"))
