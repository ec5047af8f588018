"""Freight lanes: volatility, trends, forecasts and rate sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind import dims

LANE = ("origin", "destination")


def since(df: DataFrame, as_of: str, days: int, ts: str = "ts") -> DataFrame:
    """Rows of the last ``days`` days before ``as_of`` (inclusive at both ends)."""
    end = F.lit(as_of).cast("timestamp_ntz")
    return df.where((F.col(ts) >= end - F.make_dt_interval(F.lit(days))) & (F.col(ts) <= end))


def volatility_columns(rate: str = "rate_40ft") -> list[Column]:
    r = F.when(F.col(rate) != 0, F.col(rate))
    return [F.count("*").alias("n_rates"), F.count(r).alias("n_valid"), F.avg(r).alias("_mean"),
            F.stddev_pop(r).alias("_std")]


def volatility_of(df: DataFrame) -> DataFrame:
    """Coefficient of variation capped at 1; too few rates -> 0.2, mean <= 0 -> 0."""
    mean = F.col("_mean")
    value = (
        F.when((F.col("n_rates") < 2) | (F.col("n_valid") == 0), 0.2)
        .when(mean <= 0, 0.0)
        .otherwise(F.least(F.lit(1.0), F.try_divide(F.col("_std"), mean)))
    )
    return df.withColumn("volatility", value).withColumnRenamed("_mean", "mean_rate").drop("_std", "n_valid")


def lane_volatility(rates: DataFrame, as_of: str, days: int = 30, keys: Sequence[str] = LANE) -> DataFrame:
    """Volatility per lane over the window; partial aggregates go through the shuffle."""
    return volatility_of(since(rates, as_of, days).groupBy(*keys).agg(*volatility_columns()))


def watched_lane_volatility(lanes: DataFrame, rates: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """All wanted lanes, those without data at the default."""
    found = lane_volatility(rates, as_of, days)
    return lanes.join(found, list(LANE), "left").withColumns({
        "n_rates": F.coalesce("n_rates", F.lit(0)),
        "volatility": F.coalesce("volatility", F.lit(0.2)),
    })


def route_volatility_with_total(rates: DataFrame, as_of: str, days: int) -> DataFrame:
    """Volatility per route plus one row over all rates, in one pass."""
    grouped = since(rates, as_of, days).groupingSets([list(LANE), []], *LANE).agg(*volatility_columns(), F.grouping_id().alias("_g"))
    route = F.when(F.col("_g") == 0, F.concat_ws("-", *LANE)).otherwise("overall")
    return volatility_of(grouped).withColumn("route", route).drop("_g", *LANE)


def lane_trend(rates: DataFrame, keys: Sequence[str] = LANE) -> DataFrame:
    """Direction, strength (r2) and slope per day of the lane's rates."""
    day = _day(F.col("ts"))
    fit = rates.groupBy(*keys).agg(
        F.regr_slope("rate_40ft", day).alias("slope"), F.regr_r2("rate_40ft", day).alias("strength"),
        F.count("*").alias("n"))
    return fit.withColumn("direction", direction(F.col("slope"), 0.0))


def direction(slope: Column, tolerance: float, words=("up", "down", "flat")) -> Column:
    return (
        F.when(slope > tolerance, words[0]).when(slope < -tolerance, words[1])
        .when(slope.isNotNull(), words[2])
    )


def _day(ts: Column) -> Column:
    """Days since 1995-01-01 as a double (a near origin keeps the sums small)."""
    return F.datediff(F.to_date(ts), F.lit("1995-01-01").cast("date")).cast("double")


def seasonal_means(rates: DataFrame, keys: Sequence[str] = ("origin",)) -> DataFrame:
    return rates.groupBy(*keys, F.month("ts").alias("month")).agg(
        F.avg("rate_40ft").alias("mean_rate"), F.count("*").alias("n"))


def lane_forecast(rates: DataFrame, cut: str, horizon: int, step_days: int = 30, keys: Sequence[str] = LANE) -> DataFrame:
    """Linear trend with a 1.96 residual-deviation band and the holdout error.

    The line is fitted on rows up to ``cut``; the rows after it give the mean
    absolute percentage error. One pass fits, a second one scores the holdout.
    """
    edge = F.lit(cut).cast("timestamp_ntz")
    day = _day(F.col("ts"))
    fit = rates.where(F.col("ts") <= edge).groupBy(*keys).agg(
        F.regr_slope("rate_40ft", day).alias("slope"),
        F.regr_intercept("rate_40ft", day).alias("intercept"),
        F.sqrt(F.greatest(F.lit(0.0), F.var_pop("rate_40ft") * (1 - F.coalesce(F.regr_r2("rate_40ft", day), F.lit(0.0))))).alias("_dev"),
        F.count("*").alias("n_fit"),
    ).where(F.col("slope").isNotNull())
    line = F.col("intercept") + F.col("slope") * day
    error = F.abs(F.try_divide(F.col("rate_40ft") - line, F.col("rate_40ft")))
    held = rates.where(F.col("ts") > edge).join(fit, list(keys)).groupBy(*keys).agg(F.avg(error).alias("mape"))
    at = _day(edge) + F.col("step") * step_days
    mean = F.col("intercept") + F.col("slope") * at
    return (
        fit.join(held, list(keys), "left")
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        .select(*keys, "step", mean.alias("forecast"), (mean - 1.96 * F.col("_dev")).alias("low"),
                (mean + 1.96 * F.col("_dev")).alias("high"), "mape", "n_fit")
    )


# Shares of the 40-foot rate and the security charge, for a
# parsed quote and for an estimate.
QUOTE_SHARES = {"rate_20ft": 0.6, "rate_40ft_hc": 1.1, "base_rate": 0.8, "bunker_surcharge": 0.15}
ESTIMATE_SHARES = {"rate_20ft": 0.6, "rate_40ft_hc": 1.1, "base_rate": 0.75, "bunker_surcharge": 0.2}
SECURITY_CHARGE = 25.0


def rate_breakdown(df: DataFrame, shares: dict[str, float] = QUOTE_SHARES, rate: str = "rate_40ft") -> DataFrame:
    return df.withColumns({
        **{name: F.col(rate) * share for name, share in shares.items()},
        "security_surcharge": F.lit(SECURITY_CHARGE),
    })


def first_source(lanes: DataFrame, quotes: DataFrame, second: DataFrame, estimates: DataFrame) -> DataFrame:
    """Quote, else second source, else estimate table, else the default rate.

    Each source holds at most one row per lane, so the chain is three left joins.
    """
    keys = list(LANE)
    joined = (
        lanes.join(quotes.select(*keys, F.col("rate_40ft").alias("_q")), keys, "left")
        .join(second.select(*keys, F.col("rate_40ft").alias("_s")), keys, "left")
        .join(estimates.select(*keys, F.col("rate_40ft").alias("_e")), keys, "left")
    )
    quoted = F.col("_q").isNotNull() | F.col("_s").isNotNull()

    def share(name):
        return F.when(quoted, QUOTE_SHARES[name]).otherwise(ESTIMATE_SHARES[name])

    rate = F.coalesce("_q", "_s", "_e", F.lit(dims.DEFAULT_LANE_ESTIMATE))
    return joined.select(
        *keys, rate.alias("rate_40ft"), *[(rate * share(n)).alias(n) for n in QUOTE_SHARES],
        F.lit(SECURITY_CHARGE).alias("security_surcharge"),
        F.when(F.col("_q").isNotNull(), "quote").when(F.col("_s").isNotNull(), "second").otherwise("estimate").alias("source"),
    )


def collection_summary(lanes: DataFrame) -> DataFrame:
    """Counts of one collection run with the volatility alert."""
    return lanes.agg(
        F.count("*").alias("lanes"), F.sum("n_rates").alias("rates"),
        F.count_if(F.col("volatility") > 0.3).alias("high_volatility"), F.avg("volatility").alias("mean_volatility"))
