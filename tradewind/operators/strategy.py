"""Trade signals, risk checks, booking, portfolio metrics and backtests."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind import dims
from tradewind.functions.rowwise import clip, mean_of
from tradewind.operators.vessels import latest
from tradewind.plans.blocks import attach, is_hot, over_blocks, running
from tradewind.plans.topk import top_k
from tradewind.session import checkpointed

LIMITS = dims.LIMITS


def company_signals(impacts: DataFrame, sectors: DataFrame, limits=LIMITS) -> DataFrame:
    """Short below -3, buy above 2, kept from the conviction threshold on.

    ``impacts`` carries one row per company with its factor array; ``sectors``
    the vulnerability per sector, which may be missing.
    """
    known = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in dims.COMPANY_DEFAULTS.items()}
    df = impacts.withColumns(known).where((F.col("impact_score") < -3) | (F.col("impact_score") > 2))
    df = attach(df, sectors, ["scenario", "sector"], ["vulnerability_score"])
    x, p, esg = F.col("impact_score"), F.col("probability"), F.col("esg_score")
    short = x < -3
    magnitude = F.least(F.lit(1.0), F.abs(x) / 10)
    ret = F.when(short, x * 0.5).otherwise(x * 0.3)
    esg_term = F.when(esg < limits["esg_floor"], 0.5).otherwise(F.least(F.lit(1.0), esg / 100))
    confidence = (p + magnitude + F.col("data_quality") + F.col("liquidity_score") + esg_term) / 5
    factors = F.concat("risk_factors", F.array_compact(F.array(
        F.when(F.col("beta") > 1.5, F.lit("High beta stock")), F.when(F.col("debt_to_equity") > 1.0, F.lit("High leverage")))))
    price = F.col("current_price")
    support = F.array_compact(F.array(
        F.format_string("Supply chain impact score: %.1f", x), F.format_string("Disruption probability: %.1f%%", p * 100),
        F.concat(F.lit("Sector: "), F.col("sector")),
        F.when(F.col("vulnerability_score").isNotNull(), F.format_string("Sector vulnerability: %.1f", F.col("vulnerability_score")))))
    return df.withColumns({
        "signal_type": F.when(short, "short").otherwise("buy"),
        "strength": F.least(F.lit(1.0), F.abs(x) / 10 * p),
        "target_weight": F.when(short, -F.least(F.lit(limits["single"]), F.abs(x) / 20)).otherwise(F.least(F.lit(limits["single"]), x / 25)),
        "expected_return": ret,
        "confidence": confidence,
        "risk_factors": factors,
        "risk_level": F.when(F.size(factors) > 3, "high").when(F.size(factors) > 1, "medium").otherwise("low"),
        "entry_price": price,
        "stop_loss": F.when(short, price * 1.1).otherwise(price * 0.9),
        "take_profit": price * (1 + ret / 100),
        "supporting_factors": support,
        "esg_note": F.when(esg < 40, "Poor ESG rating - proceed with caution").when(esg > 70, "Strong ESG profile supports investment thesis"),
        "time_horizon": F.when(F.col("recovery_days") < 30, "short").when(F.col("recovery_days") < 90, "medium").otherwise("long"),
    }).where(F.col("confidence") >= limits["conviction"])


def ranked_signals(signals: DataFrame) -> DataFrame:
    return signals.orderBy(
        (F.col("strength") * F.col("confidence") * F.abs("expected_return")).desc(), "symbol")


def sector_trade_signals(rotations: DataFrame, companies: DataFrame, single: float = LIMITS["single"]) -> DataFrame:
    """Three leaders bought per overweight sector, two laggards sold per underweight sector."""
    priced = companies.withColumn("price", F.coalesce("current_price", F.lit(dims.COMPANY_DEFAULTS["current_price"])))
    cap = F.col("market_cap")
    leaders = top_k(priced, ["sector"], [cap.desc(), F.col("symbol")], 3, rank="rank")
    laggards = top_k(priced, ["sector"], [cap.asc(), F.col("symbol")], 2, rank="rank")

    def side(kind, sector, stocks, stype, strength, weight, ret, conf, stop, risk):
        r = rotations.where(F.col("signal_type") == kind).select(
            "scenario", F.col(sector).alias("sector"), "strength", "expected_return", "confidence")
        j = r.join(stocks.select("sector", "symbol", "price", "rank"), "sector")
        return j.select(
            "scenario", "symbol", "sector", "rank", F.lit(stype).alias("signal_type"), (F.col("strength") * strength).alias("strength"),
            F.lit(weight * single).alias("target_weight"), (F.col("expected_return") * ret).alias("expected_return"),
            (F.col("confidence") * conf).alias("confidence"), F.lit(risk).alias("risk_level"), F.col("price").alias("entry_price"),
            (F.col("price") * stop).alias("stop_loss"), (F.col("price") * (1 + F.col("expected_return") / 200)).alias("take_profit"))

    longs = side("overweight", "target_sector", leaders, "buy", 0.8, 0.6, 0.7, 0.9, 0.92, "medium")
    shorts = side("underweight", "source_sector", laggards, "short", 0.7, -0.5, 0.6, 0.8, 1.08, "high")
    return longs.unionByName(shorts)


def check_signals(signals: DataFrame, gross: Column, net: Column, limits=LIMITS) -> DataFrame:
    """First failing rule against the metrics before the batch, NULL when approved."""
    w = F.abs("target_weight")
    reason = (
        F.when(w > limits["single"], "Position size exceeds limit")
        .when(gross + w > limits["gross"], "Would exceed gross exposure limit")
        .when(F.abs(net + F.col("target_weight")) > limits["net"], "Would exceed net exposure limit")
        .when((F.col("risk_level") == "high") & (w > 0.02), "High risk position too large")
        .when(F.contains(F.coalesce("esg_note", F.lit("")), F.lit("Poor ESG")) & (w > 0.01), "Poor ESG score limits position size")
        .when(F.col("confidence") < limits["conviction"], "Signal confidence below threshold"))
    return signals.withColumns({"reason": reason, "approved": reason.isNull()})


def position_risk(signal_type: str = "signal_type") -> Column:
    base = (
        F.lit(5.0) + F.when(F.col(signal_type).isin("short", "sell"), 2.0).otherwise(0.0)
        + F.when(F.col("risk_level") == "low", -1.0).when(F.col("risk_level") == "high", 2.0).otherwise(0.0)
        + F.abs("target_weight") * 20 - F.col("confidence") * 2)
    return clip(base, 0, 10)


def holding_days(horizon: str = "time_horizon") -> Column:
    h = F.col(horizon)
    return F.when(h == "short", 30).when(h == "medium", 90).when(h == "long", 180).otherwise(60)


def size_orders(signals: DataFrame, value: float, price: str = "price") -> DataFrame:
    """Whole shares, dollars and weight of each order."""
    shares = F.floor(F.lit(value) * F.abs("target_weight") / F.col(price)).cast("bigint")
    signed = F.when(F.col("target_weight") < 0, -shares).otherwise(shares)
    return signals.withColumns({
        "shares": signed, "dollars": shares * F.col(price), "sized_weight": signed * F.col(price) / value})


def book_orders(signals: DataFrame, positions: DataFrame, capital: float, order: Sequence[str] = ("seq",), **kw) -> DataFrame:
    """Book approved orders in sequence: new or adjusting, turnover, cash left.

    The holding before an order is the target of the previous order of that
    symbol, else the position held at the start; cash is a running sum.
    """
    sized = size_orders(signals, capital).where(F.col("shares") != 0).withColumn("target_shares", F.col("shares"))
    # what follows from other columns is computed again at the end instead of being carried through the shuffles
    filled = sized.drop("shares", "dollars", "sized_weight")
    held = positions.select("symbol", F.col("shares").alias("_held"), F.col("entry_price").alias("_entry"))
    joined = filled.join(held, "symbol", "left")
    joined = over_blocks(joined, ["symbol"], order, lambda w: {"_before": F.lag("target_shares", 1).over(w)}, back=1, **kw)
    before = F.coalesce("_before", "_held", F.lit(0))
    traded = F.col("target_shares") - before
    spent = running(joined.where(traded != 0), [], list(order), {"_spent": ("sum", F.abs(traded * F.col("price")))}, **kw)
    booked = size_orders(spent, capital).withColumns({
        "action": F.when(F.col("_before").isNull() & F.col("_held").isNull(), "new_position").otherwise("adjust_position"),
        "traded": traded, "turnover": F.abs(traded * F.col("price")),
        "unrealized_pnl": F.when(F.col("_entry").isNull(), 0.0).otherwise((F.col("price") - F.col("_entry")) * F.col("target_shares")),
        "cash": F.lit(capital) - F.col("_spent"),
    })
    own = [c for c in signals.columns if c != "shares"]
    return booked.select(*dict.fromkeys([*own, "dollars", "sized_weight", "target_shares", "action", "traded", "turnover", "unrealized_pnl", "cash"]))


def mark_to_market(positions: DataFrame, ticks: DataFrame, value: float, order: Sequence[str]) -> DataFrame:
    """Latest price per symbol, PnL and weight; a symbol without price stays at its entry."""
    last = latest(ticks.select(*dict.fromkeys(["symbol", "price", *order])), ["symbol"], order).select("symbol", F.col("price").alias("_p"))
    price = F.coalesce("_p", "entry_price")
    return positions.join(last, "symbol", "left").withColumns({
        "current_price": price, "unrealized_pnl": (price - F.col("entry_price")) * F.col("shares"),
        "weight": F.col("shares") * price / value}).drop("_p")


def portfolio_metrics(positions: DataFrame, value: float, keys: Sequence[str] = ("book",)) -> DataFrame:
    w = F.col("weight")
    pnl = F.sum("unrealized_pnl")
    base = positions.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(w > 0, w)), F.lit(0.0)).alias("long_exposure"),
        F.coalesce(F.sum(F.when(w < 0, -w)), F.lit(0.0)).alias("short_exposure"), (pnl / value).alias("total_return"))
    r = F.col("total_return")
    return base.withColumns({
        "net_exposure": F.col("long_exposure") - F.col("short_exposure"), "gross_exposure": F.col("long_exposure") + F.col("short_exposure"),
        "annualized_return": r * 252 / 30, "sharpe_ratio": r / 0.15, "alpha": r - 0.05,
        "var_95": F.lit(value * 0.02), "expected_shortfall": F.lit(value * 0.03)})


def sector_allocation(positions: DataFrame, keys: Sequence[str] = ("book",)) -> DataFrame:
    return positions.groupBy(*keys, "sector").agg(F.sum(F.abs("weight")).alias("allocation"))


def allocation_map(positions: DataFrame, keys: Sequence[str] = ("book",)) -> DataFrame:
    """The allocation as one map per book; one entry per sector of the dimension."""
    return sector_allocation(positions, keys).groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("sector", "allocation")))).alias("sector_allocation"))


def top_positions(positions: DataFrame, k: int = 10) -> DataFrame:
    return positions.orderBy(F.abs("weight").desc(), "symbol").limit(k).select("symbol", "sector", "weight", "unrealized_pnl")


def strategy_report(positions: DataFrame, trades: DataFrame, as_of: str, keys: Sequence[str] = ("book",)) -> DataFrame:
    """Win rate, mean win and loss, position counts and trade totals."""
    pnl = F.col("unrealized_pnl")
    held = positions.groupBy(*keys).agg(
        F.count("*").alias("positions"), F.count_if(F.col("shares") > 0).alias("longs"), F.count_if(F.col("shares") < 0).alias("shorts"),
        F.try_divide(F.count_if(pnl > 0), F.count("*")).alias("win_rate"), F.avg(F.when(pnl > 0, pnl)).alias("mean_win"),
        F.avg(F.when(pnl < 0, pnl)).alias("mean_loss"))
    day = F.to_date(F.lit(as_of))
    done = trades.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.sum("value").alias("traded_value"), F.avg("value").alias("mean_trade"),
        F.count_if(F.to_date("ts") == day).alias("trades_today"))
    return held.join(done, list(keys), "left")


def risk_check(metrics: DataFrame, positions: DataFrame, allocation: DataFrame, volatility: float = 0.15, limits=LIMITS, key: str = "book") -> DataFrame:
    """One row per violation or warning, with the advice that goes with it."""
    def rows(df, cond, level, rule, detail):
        return df.where(cond).select(F.col(key), F.lit(level).alias("level"), F.lit(rule).alias("rule"), detail.alias("detail"))

    g, n = F.col("gross_exposure"), F.abs("net_exposure")
    out = rows(metrics, g > limits["gross"], "violation", "gross_exposure", g)
    out = out.unionByName(rows(metrics, n > limits["net"], "violation", "net_exposure", n))
    out = out.unionByName(rows(positions, F.abs("weight") > limits["single"], "violation", "single_position", F.abs("weight")))
    out = out.unionByName(rows(allocation, F.col("allocation") > limits["sector"], "warning", "sector_concentration", F.col("allocation")))
    out = out.unionByName(rows(metrics, F.lit(volatility) > limits["risk_budget"], "warning", "volatility", F.lit(volatility)))
    advice = F.when(F.col("level") == "violation", "Reduce position sizes to comply with risk limits").otherwise(
        "Consider rebalancing to reduce concentration risk")
    return out.withColumn("recommendation", advice)


def risk_status(findings: DataFrame, books: DataFrame, key: str = "book") -> DataFrame:
    counts = findings.groupBy(key).agg(
        F.count_if(F.col("level") == "violation").alias("violations"), F.count_if(F.col("level") == "warning").alias("warnings"))
    return books.select(key).distinct().join(counts, key, "left").fillna(0, ["violations", "warnings"]).withColumn(
        "status", F.when(F.col("violations") > 0, "VIOLATION").otherwise("PASS"))


def exits(positions: DataFrame, stop: Column, target: Column, price: Column) -> DataFrame:
    """Stop-loss and take-profit triggers, mirrored for shorts."""
    long = F.col("shares") > 0
    trigger = (
        F.when(long & (price <= stop), "stop_loss").when(long & (price >= target), "take_profit")
        .when(~long & (price >= stop), "stop_loss").when(~long & (price <= target), "take_profit"))
    return positions.withColumn("trigger", trigger)


def market_impact(size: Column, daily_volume: Column, factor: float = 0.0005, cost: float = 0.001) -> dict[str, Column]:
    """Linear impact and total cost in basis points."""
    impact = factor * F.try_divide(F.abs(size), daily_volume)
    return {"impact_bps": impact * 10_000, "cost_bps": (impact + cost) * 10_000}


def clamp_weight(weight: Column, single: float = LIMITS["single"]) -> Column:
    return clip(weight, -single, single)


def balanced(signals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scale the larger of the long and short sides to the smaller, then clamp."""
    w = F.col("target_weight")
    totals = signals.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(w > 0, w)), F.lit(0.0)).alias("_l"), F.coalesce(F.sum(F.when(w < 0, -w)), F.lit(0.0)).alias("_s"))
    goal = F.least("_l", "_s")
    scaled = F.when(w > 0, w * F.try_divide(goal, F.col("_l"))).otherwise(w * F.coalesce(F.try_divide(goal, F.col("_s")), F.lit(0.0)))
    return attach(signals, totals, list(keys), ["_l", "_s"]).withColumn("weight", clamp_weight(scaled)).drop("_l", "_s")


def conviction(predictions: DataFrame, sectors: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean of the strongest prediction and the sector term, within [0, 1]."""
    best = predictions.groupBy(*keys, "sector").agg(F.max("probability").alias("_p"))
    joined = best.join(sectors.select("sector", "sector_term"), "sector", "left")
    return joined.withColumn("conviction", clip(mean_of([F.col("_p"), F.col("sector_term")]), 0, 1)).drop("_p")


def returns(prices: DataFrame, keys=("symbol",), ts: str = "day", **kw) -> DataFrame:
    p = F.col("price")
    return over_blocks(prices, keys, [ts], lambda w: {"ret": F.try_divide(p, F.lag(p, 1).over(w)) - 1}, back=1, **kw)


def performance(rets: DataFrame, keys=("symbol",), ts: str = "day", periods: int = 252, **kw) -> DataFrame:
    """Total return, annual volatility, sharpe and deepest drawdown of each return series."""
    kw = {**kw, "hot": is_hot(rets, keys, kw.get("hot_rows")) if kw.get("hot") is None else kw["hot"]}
    r = rets.where(F.col("ret").isNotNull())
    growth = F.when(F.col("ret") > -1, F.log1p("ret"))
    lost = F.bool_or(F.col("ret") <= -1)  # a total loss leaves nothing to recover
    grown = running(r, keys, [ts], {"_g": ("sum", growth)}, **kw)
    peaks = running(grown, keys, [ts], {"_peak": ("max", F.col("_g"))}, **kw)
    fall = F.exp(F.col("_g") - F.greatest(F.col("_peak"), F.lit(0.0))) - 1
    vol = F.stddev_samp("ret") * F.sqrt(F.lit(float(periods)))
    return peaks.groupBy(*keys).agg(
        F.count("*").alias("n"), F.when(lost, -1.0).otherwise(F.exp(F.sum(growth)) - 1).alias("total_return"), vol.alias("volatility"),
        F.try_divide(F.avg("ret") * periods, vol).alias("sharpe"),
        F.when(lost, -1.0).otherwise(F.least(F.lit(0.0), F.min(fall))).alias("max_drawdown"))


def backtest(weights: DataFrame, prices: DataFrame, cost: float = 0.001, **kw) -> DataFrame:
    """Weights times the next return, less cost on turnover, against the mean of all symbols.

    The day series is short (one row per day), the symbols are spread by key.
    """
    p, days = F.col("price"), {k: v for k, v in kw.items() if k != "hot"}
    kw = {**kw, "hot": is_hot(prices, ["symbol"], kw.get("hot_rows")) if kw.get("hot") is None else kw["hot"]}
    ahead = over_blocks(prices, ["symbol"], ["day"], lambda w: {"next_ret": F.try_divide(F.lead(p, 1).over(w), p) - 1}, ahead=1, **kw)
    joined = ahead.join(weights, ["symbol", "day"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    moved = over_blocks(
        joined, ["symbol"], ["day"], lambda w: {"_turn": F.abs(F.col("weight") - F.coalesce(F.lag("weight", 1).over(w), F.lit(0.0)))},
        back=1, **kw)
    daily = moved.groupBy("day").agg(
        F.sum(F.col("weight") * F.coalesce("next_ret", F.lit(0.0))).alias("gross_return"), F.sum("_turn").alias("turnover"),
        F.avg("next_ret").alias("benchmark_return"), F.count_if(F.col("_turn") > 0).alias("trades"))
    net = daily.withColumn("net_return", F.col("gross_return") - cost * F.col("turnover"))
    # one row per day: a century of days is still a small frame, so no check is needed
    grown = running(net, [], ["day"], {
        "_g": ("sum", F.when(F.col("net_return") > -1, F.log1p("net_return"))),
        "_lost": ("max", (F.col("net_return") <= -1).cast("int")),
    }, **{**days, "hot": False})
    return grown.withColumn("value", F.when(F.col("_lost") == 1, 0.0).otherwise(F.exp("_g"))).drop("_g", "_lost")


def covariance(rets: DataFrame, symbols: Sequence[str] | None = None, annual: float = 252.0, column: str = "symbol", ts: str = "day", correlate: bool = False,
               names: int = 256, dates: int = 1024) -> DataFrame:
    """Covariance (or correlation) of every pair of symbols that share a date, over the dates on which both have a return.

    Symbols fall into blocks of about ``names``, dates into blocks of about
    ``dates``. A task multiplies two symbol blocks over one block of dates, and
    the sums of a pair add up over the date blocks. Any number of symbols will
    do: none is listed anywhere, and no pair of rows is joined. ``symbols``
    restricts the result to a stated list.
    """
    rows = rets.where(F.col(column).isNotNull() & F.col(ts).isNotNull())
    if symbols is not None:
        rows = rows.where(F.col(column).isin(list(symbols)))
    # written once: sizes, means and products all read it
    one = checkpointed(rows.groupBy(F.col(column).alias("_s"), F.col(ts).alias("_t")).agg(F.avg("ret").alias("_x")))
    sizes = one.agg(F.approx_count_distinct("_s").alias("s"), F.approx_count_distinct("_t").alias("t")).first()
    groups, spans = max(1, math.ceil(sizes["s"] / names)), max(1, math.ceil(sizes["t"] / dates))
    # the same shift on all dates leaves a covariance as it is and keeps its sums small
    means = one.groupBy("_s").agg(F.avg("_x").alias("_m"))
    placed = one.join(means, "_s").select(
        "_s", "_t", (F.col("_x") - F.col("_m")).alias("_x"), F.pmod(F.xxhash64("_s"), F.lit(groups)).cast("int").alias("_g"), F.pmod(F.xxhash64("_t"), F.lit(spans)).cast("int").alias("_d"))
    cells = placed.withColumn("_h", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumns({"_lo": F.least("_g", "_h"), "_hi": F.greatest("_g", "_h")})

    def products(cell: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        lo, hi = cell[0].as_py(), cell[1].as_py()
        known, who = np.unique(part.column("_s").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        when = part.column("_t").combine_chunks().dictionary_encode().indices.to_numpy()
        own = np.zeros(len(known), np.int64)
        own[who] = part.column("_g").to_numpy()
        x = part.column("_x").to_numpy(zero_copy_only=False).astype(float)
        value, held, there = (np.zeros((when.max() + 1, len(known))) for _ in range(3))
        there[when, who] = 1
        held[when, who] = ~np.isnan(x)
        value[when, who] = np.nan_to_num(x)
        a, b = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        shared = there[:, a].T @ there[:, b] > 0
        if lo == hi:
            shared &= a[:, None] <= b[None, :]
        i, j = np.nonzero(shared)
        squares = value * value
        sums = [held[:, a].T @ held[:, b], value[:, a].T @ held[:, b], held[:, a].T @ value[:, b], value[:, a].T @ value[:, b], squares[:, a].T @ held[:, b], held[:, a].T @ squares[:, b]]
        n, sa, sb, sab, saa, sbb = (m[i, j] for m in sums)
        left, right = a[i], b[j]
        turned = left > right  # names are sorted: the smaller number is the smaller name
        return pa.table({
            "left": known[np.minimum(left, right)].tolist(), "right": known[np.maximum(left, right)].tolist(), "n": n, "sa": np.where(turned, sb, sa), "sb": np.where(turned, sa, sb),
            "sab": sab, "saa": np.where(turned, sbb, saa), "sbb": np.where(turned, saa, sbb)})

    parts = cells.groupBy("_lo", "_hi", "_d").applyInArrow(products, "left string, right string, n double, sa double, sb double, sab double, saa double, sbb double")
    total = parts.groupBy("left", "right").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "sab", "saa", "sbb")])
    n, sa, sb = F.col("n"), F.col("sa"), F.col("sb")
    joint = F.col("sab") - F.try_divide(sa * sb, n)
    if correlate:
        spread = F.sqrt((F.col("saa") - F.try_divide(sa * sa, n)) * (F.col("sbb") - F.try_divide(sb * sb, n)))
        return total.select("left", "right", F.when(n >= 2, F.try_divide(joint, spread)).alias("correlation"))
    return total.select("left", "right", F.when(n >= 2, joint / (n - 1) * annual).alias("covariance"))


def optimise(expected: DataFrame, risk: dict[tuple[str, str], float], keys: Sequence[str] = ("day",), aversion: float = 2.0, limits=LIMITS) -> DataFrame:
    """Weights per rebalance date maximising mu'w - aversion/2 w'Cw inside the limits.

    Dates are solved in parallel; one date holds one row per symbol of the
    stated list behind ``risk``. Accelerated gradient steps, each with the
    exact projection onto the single, gross and net limits.
    """
    keys = list(keys)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in expected.schema.fields if f.name in keys)
    single, gross, net = limits["single"], limits["gross"], limits["net"]
    names = sorted({a for pair in risk for a in pair})
    index = {a: i for i, a in enumerate(names)}
    matrix = np.zeros((len(names) + 1, len(names) + 1))  # the last row stands for symbols without a covariance
    for (a, b), v in risk.items():
        matrix[index[a], index[b]] = matrix[index[b], index[a]] = v

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        at = np.array([index.get(a, len(names)) for a in pdf["symbol"]])
        mu, cov = pdf["expected"].to_numpy(dtype=float), matrix[np.ix_(at, at)]

        def shrunk(u):
            """Clip u after the least shrink towards zero that meets the gross limit; exact on its linear pieces."""
            size = np.abs(u)
            if np.minimum(size, single).sum() <= gross:
                return np.clip(u, -single, single)
            edges = np.unique(np.concatenate(([0.0], size, np.maximum(size - single, 0.0))))
            sums = np.clip(size[None, :] - edges[:, None], 0.0, single).sum(axis=1)
            k = int(np.flatnonzero(sums >= gross)[-1])
            cut = edges[k]
            if k + 1 < len(edges) and sums[k] > sums[k + 1]:
                cut += (sums[k] - gross) / (sums[k] - sums[k + 1]) * (edges[k + 1] - edges[k])
            return np.sign(u) * np.clip(size - cut, 0.0, single)

        def project(v):
            """Nearest point inside all limits: the multiplier of the net limit by bisection."""
            w = shrunk(v)
            if w.sum() <= net:
                return w
            low, high = 0.0, float(np.abs(v).max() + single + gross + abs(net)) * 2
            for _ in range(60):
                mid = (low + high) / 2
                w = shrunk(v - mid)
                low, high = (mid, high) if w.sum() > net else (low, mid)
            return shrunk(v - high)

        step = 1.0 / (aversion * max(np.linalg.eigvalsh(cov).max(), 0.0) + 1e-9)
        step = min(step, 1.0 / max(np.abs(mu).max(), 1e-9))
        w = ahead = np.zeros(len(at))
        t = 1.0
        for _ in range(2000):
            new = project(ahead + step * (mu - aversion * cov @ ahead))
            t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead = new + (t - 1) / t_new * (new - w)
            done = np.abs(new - w).max() < 1e-12
            w, t = new, t_new
            if done:
                break
        out = pdf[[*keys, "symbol"]].copy()
        out["weight"] = w
        return out[np.abs(w) > 0.001]

    return expected.groupBy(*keys).applyInPandas(solve, f"{fields}, symbol string, weight double")


def blended_signal(disruption: Column, momentum: Column, technical: Column, threshold: float = 0.7) -> dict[str, Column]:
    """0.4 disruption + 0.3 ESG momentum + 0.3 technical, acted on from the threshold."""
    blend = disruption * 0.4 + momentum * 0.3 + technical * 0.3
    return {"blend": blend, "act": F.abs(blend) >= threshold}


def risk_parity(vols: DataFrame, keys: Sequence[str], single: float = LIMITS["single"], sector_cap: float = LIMITS["sector"]) -> DataFrame:
    """Inverse-volatility weights, capped per position, then scaled down per sector."""
    keys = list(keys)
    usable = vols.where(F.col("volatility") > 0).withColumn("_inv", 1 / F.col("volatility"))
    total = usable.groupBy(*keys).agg(F.sum("_inv").alias("_t"))
    capped = attach(usable, total, keys, ["_t"]).withColumn("_w", F.least(F.lit(single), F.col("_inv") / F.col("_t")))
    sector = capped.groupBy(*keys, "sector").agg(F.sum("_w").alias("_sw"))
    shrink = F.when(F.col("_sw") > sector_cap, sector_cap / F.col("_sw")).otherwise(1.0)
    return attach(capped, sector, [*keys, "sector"], ["_sw"]).withColumn("weight", F.col("_w") * shrink).drop("_inv", "_t", "_w", "_sw")


def decayed(strength: Column, age_days: Column, life: float = 30.0) -> Column:
    return strength * F.greatest(F.lit(0.0), 1 - age_days / life)
