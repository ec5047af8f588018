"""Trade signal, portfolio, backtest and sustainability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewind import dims
from tradewind.catalog.registry import query
from tradewind.operators import esg as E
from tradewind.operators import snapshot as N
from tradewind.operators import strategy as T
from tradewind.operators.freight import _day
from tradewind.sources.adapters import ESG_SECTIONS, VIEWS

j = F.array_join
CAPITAL = dims.LIMITS["capital"]

# --- trade signals ----------------------------------------------------------

FACTORS = ["Port congestion at A", "Route disruption: B", "Freight rate spike: C"]


def impacts(t):
    base = F.array(*[F.lit(x) for x in FACTORS])
    return t.company_impacts.withColumn("risk_factors", F.slice(base, F.lit(1), F.col("n_factors").cast("int")))


def company_signals(t):
    return T.company_signals(impacts(t), t.sector_impacts.select("scenario", "sector", "vulnerability_score"))


VIEWS["signals"] = (("company_impacts", "sector_impacts"), """
    SELECT *, CASE WHEN short THEN 'short' ELSE 'buy' END AS signal_type, least(1.0, abs(impact_score) / 10 * probability) AS strength,
        CASE WHEN short THEN -least(0.05, abs(impact_score) / 20) ELSE least(0.05, impact_score / 25) END AS target_weight,
        price AS entry_price, CASE WHEN short THEN price * 1.1 ELSE price * 0.9 END AS stop_loss, price * (1 + expected_return / 100) AS take_profit,
        CASE WHEN len(rf) > 3 THEN 'high' WHEN len(rf) > 1 THEN 'medium' ELSE 'low' END AS risk_level, array_to_string(rf, '; ') AS risk_factors,
        CASE WHEN esg < 40 THEN 'Poor ESG rating - proceed with caution' WHEN esg > 70 THEN 'Strong ESG profile supports investment thesis' END AS esg_note,
        CASE WHEN recovery_days < 30 THEN 'short' WHEN recovery_days < 90 THEN 'medium' ELSE 'long' END AS time_horizon
    FROM (SELECT c.*, v.vulnerability_score, impact_score < -3 AS short, CASE WHEN impact_score < -3 THEN impact_score * 0.5 ELSE impact_score * 0.3 END AS expected_return,
            coalesce(c.esg_score, 50) AS esg, coalesce(c.current_price, 100) AS price,
            (probability + least(1.0, abs(impact_score) / 10) + coalesce(data_quality, 0.7) + coalesce(liquidity_score, 0.8)
                + CASE WHEN coalesce(c.esg_score, 50) < 30 THEN 0.5 ELSE least(1.0, coalesce(c.esg_score, 50) / 100) END) / 5 AS confidence,
            list_filter([CASE WHEN n_factors > 0 THEN 'Port congestion at A' END, CASE WHEN n_factors > 1 THEN 'Route disruption: B' END, CASE WHEN n_factors > 2 THEN 'Freight rate spike: C' END,
                CASE WHEN coalesce(beta, 1) > 1.5 THEN 'High beta stock' END, CASE WHEN coalesce(debt_to_equity, 0.5) > 1 THEN 'High leverage' END], lambda x: x IS NOT NULL) AS rf
        FROM company_impacts c LEFT JOIN sector_impacts v ON v.scenario = c.scenario AND v.sector = c.sector WHERE impact_score < -3 OR impact_score > 2)
    WHERE confidence >= 0.6""")
SIGNAL = ["symbol", "sector", "signal_type", "strength", "target_weight", "expected_return", "confidence", "risk_level", "risk_factors", "entry_price", "stop_loss", "take_profit", "esg_note", "time_horizon"]


@query("company_trade_signals", f"SELECT {', '.join(SIGNAL)} FROM signals", uses="signals",
       rnd="strength target_weight expected_return confidence entry_price stop_loss take_profit")
def company_trade_signals(t):
    return company_signals(t).withColumn("risk_factors", j("risk_factors", "; ")).select(*SIGNAL)


@query("signal_support_texts", """SELECT symbol, concat_ws('; ', printf('Supply chain impact score: %.1f', impact_score), printf('Disruption probability: %.1f%%', probability * 100),
    concat('Sector: ', sector)) AS support FROM signals""", uses="signals")
def signal_support_texts(t):
    return company_signals(t).select("symbol", j(F.slice("supporting_factors", 1, 3), "; ").alias("support"))


@query("ranked_signals", "SELECT symbol, strength * confidence * abs(expected_return) AS score FROM signals ORDER BY score DESC, symbol", uses="signals", rnd="score")
def ranked_signals(t):
    return T.ranked_signals(company_signals(t)).select("symbol", (F.col("strength") * F.col("confidence") * F.abs("expected_return")).alias("score"))


ROTATE = """WITH rot AS (SELECT scenario, sector, CASE WHEN predicted_impact_30d > 2 THEN 'overweight' ELSE 'underweight' END AS signal_type, least(1.0, abs(predicted_impact_30d) / 10) AS strength,
        predicted_impact_30d AS expected_return, CAST(0.7 AS DOUBLE) AS confidence FROM sector_impacts WHERE abs(predicted_impact_30d) > 2),
    pr AS (SELECT symbol, sector, coalesce(current_price, 100) AS price, row_number() OVER (PARTITION BY sector ORDER BY market_cap DESC, symbol) AS up,
        row_number() OVER (PARTITION BY sector ORDER BY market_cap, symbol) AS down FROM companies)
    SELECT scenario, symbol, r.sector, CAST(up AS BIGINT) AS rank, 'buy' AS signal_type, strength * 0.8 AS strength, CAST(0.6 * 0.05 AS DOUBLE) AS target_weight, expected_return * 0.7 AS expected_return,
        confidence * 0.9 AS confidence, 'medium' AS risk_level, price AS entry_price, price * 0.92 AS stop_loss, price * (1 + expected_return / 200) AS take_profit
    FROM rot r JOIN pr ON pr.sector = r.sector AND up <= 3 WHERE signal_type = 'overweight'
    UNION ALL SELECT scenario, symbol, r.sector, down, 'short', strength * 0.7, -0.025, expected_return * 0.6, confidence * 0.8, 'high', price, price * 1.08, price * (1 + expected_return / 200)
    FROM rot r JOIN pr ON pr.sector = r.sector AND down <= 2 WHERE signal_type = 'underweight'"""


@query("sector_trade_signals", ROTATE, uses="sector_impacts companies", rnd="strength target_weight expected_return confidence entry_price stop_loss take_profit")
def sector_trade_signals(t):
    m = F.col("predicted_impact_30d")
    over = m > 2
    rot = t.sector_impacts.where(F.abs(m) > 2).select(
        "scenario", F.when(over, "overweight").otherwise("underweight").alias("signal_type"), F.col("sector").alias("source_sector"),
        F.col("sector").alias("target_sector"), F.least(F.lit(1.0), F.abs(m) / 10).alias("strength"), m.alias("expected_return"), F.lit(0.7).alias("confidence"))
    return T.sector_trade_signals(rot, t.companies)


CHECK = """SELECT *, CASE WHEN abs(target_weight) > 0.05 THEN 'Position size exceeds limit' WHEN 0.5 + abs(target_weight) > 1 THEN 'Would exceed gross exposure limit'
    WHEN abs(0.26 + target_weight) > 0.3 THEN 'Would exceed net exposure limit' WHEN risk_level = 'high' AND abs(target_weight) > 0.02 THEN 'High risk position too large'
    WHEN esg_note LIKE '%Poor ESG%' AND abs(target_weight) > 0.01 THEN 'Poor ESG score limits position size' WHEN confidence < 0.6 THEN 'Signal confidence below threshold' END AS reason FROM signals"""


def checked(t):
    return T.check_signals(company_signals(t), F.lit(0.5), F.lit(0.26))


@query("pre_trade_checks", f"SELECT symbol, reason, reason IS NULL AS approved FROM ({CHECK})", uses="signals")
def pre_trade_checks(t):
    return checked(t).select("symbol", "reason", "approved")


@query("position_risk_holding", """SELECT symbol, least(10.0, greatest(0.0, 5 + CASE WHEN signal_type = 'short' THEN 2 ELSE 0 END + CASE risk_level WHEN 'low' THEN -1 WHEN 'high' THEN 2 ELSE 0 END
    + abs(target_weight) * 20 - confidence * 2)) AS risk_score, CAST(CASE time_horizon WHEN 'short' THEN 30 WHEN 'medium' THEN 90 ELSE 180 END AS BIGINT) AS holding_days FROM signals""", uses="signals", rnd="risk_score")
def position_risk_holding(t):
    return company_signals(t).select("symbol", T.position_risk().alias("risk_score"), T.holding_days().alias("holding_days"))


@query("position_sizing", """SELECT symbol, CAST(CASE WHEN target_weight < 0 THEN -n ELSE n END AS BIGINT) AS shares, n * price AS dollars, CASE WHEN target_weight < 0 THEN -n ELSE n END * price / 1e6 AS sized_weight
    FROM (SELECT *, floor(1000000 * abs(target_weight) / price) AS n FROM signals)""", uses="signals", rnd="dollars sized_weight")
def position_sizing(t):
    return T.size_orders(company_signals(t), CAPITAL, "entry_price").select("symbol", "shares", "dollars", "sized_weight")


# Orders: every line item is an order for its part, sized by discount, in shipping order.
ORDERS = {
    "symbol": "concat('P', CAST(l_partkey AS {s}))", "seq": "l_shipdate", "k1": "l_orderkey", "k2": "l_suppkey", "k3": "CAST(l_linenumber AS BIGINT)",
    "target_weight": "CASE WHEN l_returnflag = 'R' THEN -(l_discount + 0.01) ELSE l_discount + 0.01 END / 10", "price": "l_extendedprice / l_quantity"}
VIEWS["order_flow"] = ((), "SELECT " + ", ".join(f"{e.format(s='VARCHAR')} AS {n}" for n, e in ORDERS.items()) + " FROM lineitem")
ORDER = ["seq", "symbol", "k1", "k2", "k3"]


def order_flow(t):
    return t.lineitem.selectExpr(*[f"{e.format(s='STRING')} AS {n}" for n, e in ORDERS.items()])


@query("order_booking", """WITH z AS (SELECT *, floor(1e6 * abs(target_weight) / price) * CASE WHEN target_weight < 0 THEN -1 ELSE 1 END AS ts FROM order_flow),
    f AS (SELECT z.*, p.shares AS held, p.entry_price AS entry, lag(ts) OVER (PARTITION BY z.symbol ORDER BY seq, z.symbol, k1, k2, k3) AS bf FROM z LEFT JOIN positions p ON p.symbol = z.symbol WHERE ts <> 0),
    b AS (SELECT *, ts - coalesce(bf, held, 0) AS traded FROM f)
    SELECT symbol, k1, k2, k3, CASE WHEN bf IS NULL AND held IS NULL THEN 'new_position' ELSE 'adjust_position' END AS action, CAST(ts AS BIGINT) AS target_shares, CAST(traded AS BIGINT) AS traded, abs(traded * price) AS turnover,
    CASE WHEN entry IS NULL THEN 0 ELSE (price - entry) * ts END AS unrealized_pnl, 1e6 - sum(abs(traded * price)) OVER (ORDER BY seq, symbol, k1, k2, k3 ROWS UNBOUNDED PRECEDING) AS cash FROM b WHERE traded <> 0""",
       uses="order_flow positions", rnd="turnover unrealized_pnl cash", places=1)
def order_booking(t):
    return T.book_orders(order_flow(t), t.positions, CAPITAL, ORDER).select(
        "symbol", "k1", "k2", "k3", "action", "target_shares", "traded", "turnover", "unrealized_pnl", "cash")


MTM = """mtm AS (SELECT p.*, coalesce(t.price, entry_price) AS current_price, (coalesce(t.price, entry_price) - entry_price) * shares AS unrealized_pnl, shares * coalesce(t.price, entry_price) / 1e6 AS weight
    FROM positions p LEFT JOIN (SELECT symbol, price, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, k1 DESC, k2 DESC, k3 DESC, price DESC) AS rn FROM ticks) t ON t.symbol = p.symbol AND rn = 1)"""


def marked(t):
    return T.mark_to_market(t.positions, t.ticks, CAPITAL, ["ts", "k1", "k2", "k3", "price"])


@query("mark_to_market", f"WITH {MTM} SELECT symbol, shares, entry_price, current_price, unrealized_pnl, weight FROM mtm", uses="positions ticks", rnd="entry_price current_price unrealized_pnl weight", places=4)
def mark_to_market(t):
    return marked(t).select("symbol", "shares", "entry_price", "current_price", "unrealized_pnl", "weight")


METRICS = """m AS (SELECT book, coalesce(sum(weight) FILTER (weight > 0), 0) AS long_exposure, coalesce(sum(-weight) FILTER (weight < 0), 0) AS short_exposure, sum(unrealized_pnl) / 1e6 AS total_return FROM mtm GROUP BY book),
    mm AS (SELECT *, long_exposure - short_exposure AS net_exposure, long_exposure + short_exposure AS gross_exposure FROM m)"""


@query("portfolio_metrics", f"""WITH {MTM}, {METRICS} SELECT *, total_return * 252 / 30 AS annualized_return, total_return / 0.15 AS sharpe_ratio, total_return - 0.05 AS alpha,
    CAST(20000 AS DOUBLE) AS var_95, CAST(30000 AS DOUBLE) AS expected_shortfall FROM mm""", uses="positions ticks",
       rnd="long_exposure short_exposure total_return net_exposure gross_exposure annualized_return sharpe_ratio alpha")
def portfolio_metrics(t):
    return T.portfolio_metrics(marked(t), CAPITAL)


@query("sector_allocation", f"WITH {MTM} SELECT book, sector, sum(abs(weight)) AS allocation FROM mtm GROUP BY ALL", uses="positions ticks", rnd="allocation")
def sector_allocation(t):
    return T.sector_allocation(marked(t))


@query("allocation_map", f"WITH {MTM} SELECT book, count(DISTINCT sector) AS sectors, sum(abs(weight)) FILTER (sector = 'ECONOMY') AS economy FROM mtm GROUP BY book", uses="positions ticks", rnd="economy")
def allocation_map(t):
    m = T.allocation_map(marked(t))
    return m.select("book", F.size("sector_allocation").alias("sectors"), F.col("sector_allocation")["ECONOMY"].alias("economy"))


@query("top_positions", f"WITH {MTM} SELECT symbol, sector, weight, unrealized_pnl FROM mtm ORDER BY abs(weight) DESC, symbol LIMIT 10", uses="positions ticks", rnd="weight unrealized_pnl", places=4)
def top_positions(t):
    return T.top_positions(marked(t))


@query("strategy_report", f"""WITH {MTM}, h AS (SELECT book, count(*) AS positions, count(*) FILTER (shares > 0) AS longs, count(*) FILTER (shares < 0) AS shorts, count(*) FILTER (unrealized_pnl > 0) / count(*) AS win_rate,
    avg(unrealized_pnl) FILTER (unrealized_pnl > 0) AS mean_win, avg(unrealized_pnl) FILTER (unrealized_pnl < 0) AS mean_loss FROM mtm GROUP BY book),
    d AS (SELECT p_brand AS book, count(*) AS trades, sum(l_extendedprice) AS traded_value, avg(l_extendedprice) AS mean_trade, count(*) FILTER (CAST(l_shipdate AS DATE) = DATE '1998-06-01') AS trades_today
    FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand) SELECT * FROM h LEFT JOIN d USING (book)""", uses="positions ticks", rnd="win_rate mean_win mean_loss traded_value mean_trade", places=2)
def strategy_report(t):
    books = t.part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("book"))
    trades = t.lineitem.join(books, "l_partkey").select("book", F.col("l_extendedprice").alias("value"), F.col("l_shipdate").alias("ts"))
    return T.strategy_report(marked(t), trades, "1998-06-01")


RISK = f"""WITH {MTM}, {METRICS}, a AS (SELECT book, sector, sum(abs(weight)) AS al FROM mtm GROUP BY ALL),
    f AS (SELECT book, 'violation' AS level, 'gross_exposure' AS rule, gross_exposure AS detail FROM mm WHERE gross_exposure > 1 UNION ALL SELECT book, 'violation', 'net_exposure', abs(net_exposure) FROM mm WHERE abs(net_exposure) > 0.3
    UNION ALL SELECT book, 'violation', 'single_position', abs(weight) FROM mtm WHERE abs(weight) > 0.05 UNION ALL SELECT book, 'warning', 'sector_concentration', al FROM a WHERE al > 0.3
    UNION ALL SELECT book, 'warning', 'volatility', 0.18 FROM mm)"""


def findings(t):
    m = marked(t)
    return T.risk_check(T.portfolio_metrics(m, CAPITAL), m, T.sector_allocation(m), 0.18)


@query("risk_findings", RISK + " SELECT *, CASE WHEN level = 'violation' THEN 'Reduce position sizes to comply with risk limits' ELSE 'Consider rebalancing to reduce concentration risk' END AS recommendation FROM f", uses="positions ticks", rnd="detail")
def risk_findings(t):
    return findings(t)


@query("risk_status", RISK + """ SELECT b.book, count(level) FILTER (level = 'violation') AS violations, count(level) FILTER (level = 'warning') AS warnings, CASE WHEN count(level) FILTER (level = 'violation') > 0 THEN 'VIOLATION' ELSE 'PASS' END AS status
    FROM (SELECT DISTINCT book FROM positions) b LEFT JOIN f ON f.book = b.book GROUP BY b.book""", uses="positions ticks")
def risk_status(t):
    return T.risk_status(findings(t), t.positions)


@query("stop_take_triggers", f"""WITH {MTM} SELECT symbol, CASE WHEN shares > 0 AND current_price <= entry_price * 1.2 THEN 'stop_loss' WHEN shares > 0 AND current_price >= entry_price * 2.5 THEN 'take_profit'
    WHEN shares < 0 AND current_price >= entry_price * 2.5 THEN 'stop_loss' WHEN shares < 0 AND current_price <= entry_price * 1.2 THEN 'take_profit' END AS trigger FROM mtm""", uses="positions ticks")
def stop_take_triggers(t):
    long = F.col("shares") > 0
    e = F.col("entry_price")
    low, high = e * 1.2, e * 2.5
    return T.exits(marked(t), F.when(long, low).otherwise(high), F.when(long, high).otherwise(low), F.col("current_price")).select("symbol", "trigger")


@query("market_impact", """SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, 0.0005 * (l_quantity / adv) * 10000 AS impact_bps, (0.0005 * (l_quantity / adv) + 0.001) * 10000 AS cost_bps
    FROM lineitem JOIN (SELECT l_partkey, avg(l_quantity) AS adv FROM lineitem GROUP BY l_partkey) USING (l_partkey)""", rnd="impact_bps cost_bps")
def market_impact(t):
    adv = t.lineitem.groupBy("l_partkey").agg(F.avg("l_quantity").alias("adv"))
    rows = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity").join(adv, "l_partkey")
    return rows.withColumns(T.market_impact(F.col("l_quantity"), F.col("adv"))).drop("l_quantity", "adv")


@query("weight_clamp", "SELECT symbol, least(0.05, greatest(-0.05, impact_score / 100)) AS weight FROM company_impacts", uses="company_impacts", rnd="weight")
def weight_clamp(t):
    return t.company_impacts.select("symbol", T.clamp_weight(F.col("impact_score") / 100).alias("weight"))


@query("balanced_portfolio", """WITH t AS (SELECT scenario, coalesce(sum(target_weight) FILTER (target_weight > 0), 0) AS l, coalesce(sum(-target_weight) FILTER (target_weight < 0), 0) AS s FROM signals GROUP BY scenario)
    SELECT symbol, least(0.05, greatest(-0.05, CASE WHEN target_weight > 0 THEN target_weight * least(l, s) / l ELSE coalesce(target_weight * least(l, s) / nullif(s, 0), 0) END)) AS weight FROM signals JOIN t USING (scenario)""", uses="signals", rnd="weight")
def balanced_portfolio(t):
    return T.balanced(company_signals(t).select("scenario", "symbol", "target_weight"), ["scenario"]).select("symbol", "weight")


@query("conviction_score", """WITH p AS (SELECT scenario, sector, max(probability) AS p FROM company_impacts GROUP BY ALL), s AS (SELECT sector, avg(vulnerability_score) / 10 AS v FROM sector_impacts GROUP BY sector)
    SELECT scenario, sector, v AS sector_term, least(1.0, greatest(0.0, list_avg(list_filter([p, v], lambda x: x IS NOT NULL)))) AS conviction FROM p LEFT JOIN s USING (sector)""", uses="company_impacts sector_impacts", rnd="sector_term conviction")
def conviction_score(t):
    terms = t.sector_impacts.groupBy("sector").agg((F.avg("vulnerability_score") / 10).alias("sector_term"))
    return T.conviction(t.company_impacts, terms, ["scenario"]).select("scenario", "sector", "sector_term", "conviction")


RETS = "rets AS (SELECT *, price / lag(price) OVER (PARTITION BY symbol, sector ORDER BY day) - 1 AS ret FROM prices)"


@query("performance_metrics", f"""WITH {RETS}, g AS (SELECT *, sum(ln(1 + ret)) OVER (PARTITION BY symbol, sector ORDER BY day ROWS UNBOUNDED PRECEDING) AS g FROM rets WHERE ret IS NOT NULL AND ret > -1),
    k AS (SELECT *, greatest(0, max(g) OVER (PARTITION BY symbol, sector ORDER BY day ROWS UNBOUNDED PRECEDING)) AS pk FROM g)
    SELECT symbol, sector, count(*) AS n, exp(sum(ln(1 + ret))) - 1 AS total_return, stddev_samp(ret) * sqrt(252) AS volatility, avg(ret) * 252 / nullif(stddev_samp(ret) * sqrt(252), 0) AS sharpe,
    least(0, min(exp(g - pk) - 1)) AS max_drawdown FROM k GROUP BY symbol, sector""", uses="prices", rnd="total_return volatility sharpe max_drawdown")
def performance_metrics(t):
    keys = ["symbol", "sector"]
    return T.performance(T.returns(t.prices, keys), keys)


VIEWS["brand_prices"] = (("prices",), "SELECT symbol, day, sum(price * volume) / sum(volume) AS price FROM prices GROUP BY ALL")


def brand_prices(t):
    return t.prices.groupBy("symbol", "day").agg((F.sum(F.col("price") * F.col("volume")) / F.sum("volume")).alias("price"))


WEIGHT = "((CAST(substr(symbol, 7) AS INT) + month(day)) % 5 - 2) / 50.0"


@query("backtest", f"""WITH a AS (SELECT symbol, day, lead(price) OVER (PARTITION BY symbol ORDER BY day) / price - 1 AS nr, {WEIGHT} AS w FROM brand_prices),
    b AS (SELECT *, abs(w - coalesce(lag(w) OVER (PARTITION BY symbol ORDER BY day), 0)) AS turn FROM a),
    d AS (SELECT day, sum(w * coalesce(nr, 0)) AS gross_return, sum(turn) AS turnover, avg(nr) AS benchmark_return, count(*) FILTER (turn > 0) AS trades FROM b GROUP BY day)
    SELECT *, CASE WHEN min(net_return) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) <= -1 THEN 0
        ELSE exp(sum(CASE WHEN net_return > -1 THEN ln(1 + net_return) END) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING)) END AS value
    FROM (SELECT *, gross_return - 0.001 * turnover AS net_return FROM d)""",
       uses="brand_prices", rnd="gross_return turnover benchmark_return net_return value")
def backtest(t):
    p = brand_prices(t)
    weights = p.select("symbol", "day", F.expr(WEIGHT).cast("double").alias("weight"))
    return T.backtest(weights, p)


def brand_returns(t):
    return T.returns(brand_prices(t))


BRET = "r AS (SELECT *, price / lag(price) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret FROM brand_prices)"


@query("return_covariance", f"""WITH {BRET} SELECT a.symbol AS "left", b.symbol AS "right", covar_samp(a.ret, b.ret) * 252 AS covariance FROM r a JOIN r b ON a.day = b.day AND a.symbol <= b.symbol
    GROUP BY ALL""", uses="brand_prices", rnd="covariance")
def return_covariance(t):
    return T.covariance(brand_returns(t))


@query("sector_correlation", f"""WITH {RETS}, s AS (SELECT sector, day, avg(ret) AS ret FROM rets GROUP BY ALL)
    SELECT a.sector AS "left", b.sector AS "right", corr(a.ret, b.ret) AS correlation FROM s a JOIN s b ON a.day = b.day AND a.sector <= b.sector GROUP BY ALL""", uses="prices", rnd="correlation")
def sector_correlation(t):
    r = T.returns(t.prices, ["symbol", "sector"])
    return T.covariance(r, column="sector", correlate=True)


@query("portfolio_weights")
def portfolio_weights(t):
    r = brand_returns(t)
    risk = {(x["left"], x["right"]): x["covariance"] for x in T.covariance(r).collect()}  # pairs of the book
    expected = r.where(F.col("ret").isNotNull()).select("day", "symbol", F.col("ret").alias("expected"))
    return T.optimise(expected, risk)


@query("blended_signal", """SELECT symbol, b AS blend, abs(b) >= 0.7 AS act FROM (SELECT symbol, probability * 0.4 + coalesce(esg_score, 0) / 100 * 0.3 + impact_score / 10 * 0.3 AS b FROM company_impacts)""", uses="company_impacts", rnd="blend")
def blended_signal(t):
    c = F.col
    return t.company_impacts.select("symbol", *[x.alias(n) for n, x in T.blended_signal(
        c("probability"), F.coalesce(c("esg_score"), F.lit(0.0)) / 100, c("impact_score") / 10).items()])


@query("risk_parity", f"""WITH {RETS}, v AS (SELECT symbol, sector, stddev_samp(ret) AS volatility FROM rets GROUP BY ALL), i AS (SELECT *, 1 / volatility AS inv FROM v WHERE volatility > 0),
    w AS (SELECT symbol, sector, volatility, least(0.05, inv / sum(inv) OVER ()) AS w FROM i), s AS (SELECT *, sum(w) OVER (PARTITION BY sector) AS sw FROM w)
    SELECT symbol, sector, volatility, w * CASE WHEN sw > 0.3 THEN 0.3 / sw ELSE 1 END AS weight FROM s""", uses="prices", rnd="volatility weight")
def risk_parity(t):
    r = T.returns(t.prices, ["symbol", "sector"]).groupBy("symbol", "sector").agg(F.stddev_samp("ret").alias("volatility"))
    return T.risk_parity(r.withColumn("run", F.lit("all")), ["run"]).drop("run")


@query("signal_decay", "SELECT event_id, value / 100 * greatest(0.0, 1 - date_diff('day', CAST(ts AS DATE), DATE '2024-01-31') / 30.0) AS strength FROM events", rnd="strength")
def signal_decay(t):
    age = F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts"))
    return t.events.select("event_id", T.decayed(F.col("value") / 100, age).alias("strength"))


SNAP = {"baltic_dry_index": "1000 + o_orderkey % 500", "fuel_cost": "450 + o_custkey % 300", "congestion_score": "(o_orderkey % 100) / 10e0", "supply_demand_ratio": "0.9e0 + (o_custkey % 30) / 100e0", "rate_volatility": "(o_orderkey % 60) / 100e0"}
VIEWS["snapshots"] = ((), "SELECT o_orderkey, " + ", ".join(f"{e} AS {n}" for n, e in SNAP.items()) + " FROM orders")
SCORE = "round(" + " + ".join(f"CASE WHEN {c} > {lim} THEN {pts} ELSE 0 END" for c, lim, pts, _, _ in N.RULES) + ", 10)"


def snapshots(t):
    return t.orders.selectExpr("o_orderkey", *[f"{e} AS {n}" for n, e in SNAP.items()])


@query("snapshot_scores", f"""SELECT o_orderkey, CAST({SCORE} AS DOUBLE) AS disruption_score, (CASE WHEN baltic_dry_index > 1200 THEN 1 ELSE 0 END + CASE WHEN supply_demand_ratio > 1.05 THEN 1 ELSE 0 END)::BIGINT AS opportunities,
    array_to_string(list_filter([CASE WHEN fuel_cost > 600 THEN concat('Elevated fuel costs at $', fuel_cost, '/ton') END, CASE WHEN congestion_score > 6 THEN concat('High port congestion (score: ', congestion_score, ')') END,
    CASE WHEN rate_volatility > 0.3 THEN concat('High rate volatility (index: ', rate_volatility, ')') END], lambda x: x IS NOT NULL), '; ') AS risk_factors, CAST(CASE WHEN {SCORE} > 0.5 THEN 3 WHEN {SCORE} > 0.3 THEN 2 ELSE 1 END AS BIGINT) AS recommendations FROM snapshots""", uses="snapshots", rnd="disruption_score")
def snapshot_scores(t):
    s = N.score_snapshots(snapshots(t))
    return s.select("o_orderkey", "disruption_score", F.size("opportunities").alias("opportunities"), j("risk_factors", "; ").alias("risk_factors"), F.size("recommendations").alias("recommendations"))


@query("market_signals", f"""SELECT o_orderkey, CASE WHEN s > 0.6 THEN 'STRONG_LONG' WHEN s > 0.4 THEN 'MODERATE_LONG' WHEN s < 0.2 THEN 'NEUTRAL_TO_SHORT' ELSE 'NEUTRAL' END AS overall_signal, c AS confidence, least(c * 100, 25.0) AS position_pct
    FROM (SELECT o_orderkey, s, CAST(CASE WHEN s > 0.6 THEN least(s, 0.9) WHEN s > 0.4 THEN s * 0.8 WHEN s < 0.2 THEN 0.3 ELSE 0 END AS DOUBLE) AS c FROM (SELECT o_orderkey, CAST({SCORE} AS DOUBLE) AS s FROM snapshots))""", uses="snapshots", rnd="confidence position_pct")
def market_signals(t):
    return N.score_snapshots(snapshots(t)).select("o_orderkey", *[c.alias(n) for n, c in N.market_signal().items()])


# --- sustainability ---------------------------------------------------------

def _merged_sql() -> str:
    parts = [f"arg_max(row({', '.join(fs)}), provider_rank) FILTER (has_{s}) AS r_{s}" for s, fs in ESG_SECTIONS.items()]
    out = [f"r_{s}[{i + 1}] AS {f}" for s, fs in ESG_SECTIONS.items() for i, f in enumerate(fs)]
    return f"""SELECT symbol, sources, {', '.join(out)} FROM (SELECT symbol, string_agg(provider, ',' ORDER BY provider_rank) AS sources, {', '.join(parts)} FROM esg_raw GROUP BY symbol)"""


MERGED = _merged_sql()


def merged(t):
    return E.merge_providers(t.esg_raw, ESG_SECTIONS)


@query("provider_merge", MERGED, uses="esg_raw")
def provider_merge(t):
    return merged(t).withColumn("sources", j("sources", ","))


def _mean(section: str) -> str:
    return "(" + " + ".join(f"coalesce({f}, 50)" for f in ESG_SECTIONS[section]) + ") / 5"


COMPOSITE = f"""SELECT symbol, sources, {_mean('environmental')} AS environmental, {_mean('social')} AS social, {_mean('governance')} AS governance,
    0.4 * {_mean('environmental')} + 0.3 * {_mean('social')} + 0.3 * {_mean('governance')} AS overall, CAST(least(100, len(string_split(sources, ',')) * 25) AS BIGINT) AS data_quality,
    coalesce(forced_labor_risk, 30) AS forced_labor_risk, coalesce(conflict_minerals, 80) AS conflict_minerals,
    greatest(coalesce(physical_climate_risk, 50), coalesce(transition_climate_risk, 50)) AS climate_risk FROM ({MERGED})"""


@query("composite_scores", COMPOSITE, uses="esg_raw", rnd="environmental social governance overall")
def composite_scores(t):
    s = E.storage_row(E.composite_scores(merged(t), ESG_SECTIONS))
    return s.select("symbol", F.col("data_sources").alias("sources"), "environmental", "social", "governance", "overall", "data_quality", "forced_labor_risk", "conflict_minerals", "climate_risk")


def _hit(r) -> str:
    c = f"{r.field} {'>' if r.above else '<'} {r.limit}"
    return f"coalesce({c}{' AND has_chain' if r.needs_chain else ''}, false)"


def _texts(kind: str) -> str:
    items = []
    for r in E.RULES:
        text = getattr(r, kind)
        if text:
            label = f"printf('{text}', {r.field})" if "%" in text else f"'{text}'"
            items.append(f"CASE WHEN {_hit(r)} THEN {label} END")
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


SDG = ", ".join(f"CASE WHEN {f} > {floor} THEN {f} * {w} END" for f, floor, w in E.SDG_TERMS)
ADJUST = f"""WITH j AS (SELECT g.symbol, g.signal_type, g.strength, e.symbol IS NOT NULL AS scored, s.symbol IS NOT NULL AS has_chain, e.* EXCLUDE (symbol), s.* EXCLUDE (symbol) FROM signals g LEFT JOIN esg_rated e ON e.symbol = g.symbol LEFT JOIN sustainability s ON s.symbol = g.symbol),
    a AS (SELECT *, {' * '.join(f'CASE WHEN {_hit(r)} THEN {r.factor}e0 ELSE 1e0 END' for r in E.RULES)} AS f, {_texts('positive')} AS pos, {_texts('negative')} AS neg, {_texts('risk')} AS rsk, list_avg(list_filter([{SDG}], lambda x: x IS NOT NULL)) AS sdg FROM j),
    b AS (SELECT *, signal_type = 'short' AND len(neg) > len(pos) AS flip FROM a),
    c AS (SELECT *, 1 + (CASE WHEN flip THEN 2 - f ELSE f END - 1) * 0.3 AS factor, CASE WHEN flip THEN list_append(pos, 'ESG concerns support short thesis') ELSE pos END AS pos2 FROM b)
    SELECT symbol, CASE WHEN scored THEN factor END AS esg_adjustment_factor, strength * CASE WHEN scored THEN factor ELSE 0.9 END AS esg_adjusted_strength, CASE WHEN NOT scored THEN 'No ESG data available' END AS esg_adjustment_reason,
    array_to_string(pos2, '; ') AS positive, array_to_string(neg, '; ') AS negative, array_to_string(rsk, '; ') AS risk, CASE WHEN scored THEN least(100, greatest(0, coalesce(sdg, 30))) END AS sdg_alignment_score,
    CASE WHEN scored THEN concat(concat_ws('. ', concat(CASE WHEN overall > 70 THEN 'Strong' WHEN overall < 40 THEN 'Weak' ELSE 'Moderate' END, printf(' ESG profile (score: %.0f)', overall)),
        CASE WHEN len(pos2) > 0 THEN concat('Strengths: ', array_to_string(pos2[1:3], ', ')) END, CASE WHEN len(neg) > 0 THEN concat('Concerns: ', array_to_string(neg[1:3], ', ')) END,
        CASE WHEN len(rsk) > 0 THEN concat('Risks: ', array_to_string(rsk[1:2], ', ')) END), '.') END AS esg_rationale FROM c"""


@query("esg_adjusted_signals", ADJUST, uses="signals esg_rated sustainability", rnd="esg_adjustment_factor esg_adjusted_strength sdg_alignment_score")
def esg_adjusted_signals(t):
    signals = company_signals(t).select("symbol", "signal_type", "strength")
    out = E.adjust_signals(signals, t.esg_rated, t.sustainability)
    return out.select(
        "symbol", "esg_adjustment_factor", "esg_adjusted_strength", "esg_adjustment_reason", j("esg_positive_factors", "; ").alias("positive"),
        j("esg_negative_factors", "; ").alias("negative"), j("esg_risk_factors", "; ").alias("risk"), "sdg_alignment_score", "esg_rationale")


@query("base_sustainability", """SELECT symbol, sector, CASE WHEN market_cap > 0 THEN least(1.0, ln(market_cap) / 10) END AS size_factor, 50 * CASE WHEN market_cap > 0 THEN least(1.0, ln(market_cap) / 10) END * CASE sector WHEN 'Information Technology' THEN 1.2 WHEN 'Health Care' THEN 1.1 WHEN 'Industrials' THEN 0.9
    WHEN 'Materials' THEN 0.8 WHEN 'Energy' THEN 0.7 ELSE 1.0 END AS base_score FROM (SELECT symbol, sector, nullif(greatest(market_cap, 0), 0) / 1e8 AS market_cap FROM companies)""", uses="companies", rnd="size_factor base_score")
def base_sustainability(t):
    rows = t.companies.select("symbol", "sector", (F.col("market_cap") / 1e8).alias("market_cap"))
    return E.base_sustainability(rows).drop("market_cap")


@query("benchmark_gaps", """SELECT symbol, sector, environmental - bench_e AS gap_e, social - bench_s AS gap_s, governance - bench_g AS gap_g FROM esg_scores JOIN sectors USING (sector_code)""", uses="esg_scores sectors", rnd="gap_e gap_s gap_g")
def benchmark_gaps(t):
    return E.against_benchmark(t.esg_scores, t.sectors)


@query("esg_report_totals", """SELECT count(*) AS companies, avg(overall) AS mean_overall, avg(environmental) AS mean_e, avg(social) AS mean_s, avg(governance) AS mean_g,
    count(*) FILTER (forced_labor_risk > 60 OR physical_climate_risk > 70 OR overall < 30) AS high_risk, count(*) FILTER (forced_labor_risk > 60) AS high_forced_labor,
    count(*) FILTER (supply_chain_transparency < 40) AS low_transparency, count(*) FILTER (conflict_minerals < 60) AS poor_conflict_minerals FROM esg_scores""", uses="esg_scores", rnd="mean_overall mean_e mean_s mean_g")
def esg_report_totals(t):
    return E.report_totals(t.esg_scores)


@query("esg_leaders_laggards", """(SELECT 'leaders' AS list, symbol, overall FROM esg_scores ORDER BY overall DESC, symbol LIMIT 5) UNION ALL (SELECT 'laggards', symbol, overall FROM esg_scores ORDER BY overall, symbol LIMIT 5)""".replace(
    "(SELECT 'leaders'", "SELECT * FROM (SELECT 'leaders'", 1).replace("UNION ALL (", "UNION ALL SELECT * FROM (", 1), uses="esg_scores")
def esg_leaders_laggards(t):
    return E.leaders_and_laggards(t.esg_scores)


@query("esg_highlights", "SELECT symbol, renewable_energy FROM esg_scores ORDER BY renewable_energy DESC, symbol LIMIT 3", uses="esg_scores")
def esg_highlights(t):
    return E.leading(t.esg_scores, "renewable_energy")


@query("esg_high_risk", "SELECT symbol, overall, forced_labor_risk, greatest(physical_climate_risk, transition_climate_risk) AS climate_risk FROM esg_scores WHERE forced_labor_risk > 60 OR physical_climate_risk > 70 OR overall < 30", uses="esg_scores")
def esg_high_risk(t):
    return E.high_risk(t.esg_scores)


@query("esg_sector_means", "SELECT sector_code, avg(overall) AS mean_overall, count(*) AS companies FROM esg_scores GROUP BY sector_code", uses="esg_scores", rnd="mean_overall")
def esg_sector_means(t):
    return E.sector_means(t.esg_scores)


@query("esg_sector_extremes", "SELECT arg_max(sector_code, m) AS best_sector, arg_min(sector_code, m) AS worst_sector FROM (SELECT sector_code, avg(overall) AS m FROM esg_scores GROUP BY sector_code)", uses="esg_scores")
def esg_sector_extremes(t):
    return E.sector_extremes(t.esg_scores)


@query("esg_source_coverage", "SELECT provider AS source, count(DISTINCT symbol) AS companies FROM esg_raw GROUP BY provider", uses="esg_raw")
def esg_source_coverage(t):
    return E.source_coverage(merged(t))


@query("esg_screening", "SELECT symbol, sector FROM companies WHERE symbol IN (SELECT symbol FROM esg_scores WHERE overall >= 70)", uses="companies esg_scores")
def esg_screening(t):
    return E.screen(t.companies.select("symbol", "sector"), t.esg_scores, 70.0)


@query("esg_trend_labels", """SELECT user_id, regr_slope(value, d) AS slope, count(*) AS n, CASE WHEN slope > 0.5 THEN 'improving' WHEN slope < -0.5 THEN 'declining' WHEN slope IS NOT NULL THEN 'stable' END AS trend
    FROM (SELECT user_id, value, CAST(date_diff('day', DATE '1995-01-01', CAST(ts AS DATE)) AS DOUBLE) AS d FROM events) GROUP BY user_id""", rnd="slope")
def esg_trend_labels(t):
    return E.score_trend(t.events, ["user_id"], "value", _day(F.col("ts")), 0.5)
