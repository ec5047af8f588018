"""Disruption scoring and its effect on companies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions.rowwise import clip
from tradewind.plans.blocks import attach
from tradewind.plans.topk import listed, top_k


@dataclass(frozen=True)
class Rule:
    """How one model output becomes a disruption record (all fixed values)."""

    kind: str
    score: str
    gain: float
    shift: float
    keep_above: float
    severity: tuple[float, float]
    lead_days: int
    duration: tuple[float, float]
    interval: float
    factor: str


RULES = (
    Rule("port_congestion", "congestion", 2.0, 0.5, 0.3, (10.0, 0.0), 1, (3.0, 7.0), 0.2, "Port congestion at "),
    Rule("route_blockage", "route_p", 1.0, 0.0, 0.3, (8.0, 2.0), 2, (1.0, 5.0), 0.15, "Route disruption: "),
    Rule("rate_spike", "volatility", 3.0, 0.0, 0.4, (20.0, 0.0), 3, (5.0, 10.0), 0.2, "Freight rate spike: "),
)


def _record(rule: Rule) -> Column:
    x = F.col(rule.score)
    probability = clip((x - rule.shift) * rule.gain, 0.0, 1.0)
    slope, base = rule.severity
    first, growth = rule.duration
    return F.struct(
        F.lit(rule.kind).alias("disruption_type"),
        probability.alias("probability"),
        F.least(F.lit(10.0), x * slope + base).alias("severity_score"),
        F.lit(rule.lead_days).alias("lead_days"),
        (F.lit(first) + growth * x).cast("int").alias("duration_days"),
        F.greatest(F.lit(0.0), probability - rule.interval).alias("ci_low"),
        F.least(F.lit(1.0), probability + rule.interval).alias("ci_high"),
        F.lit(rule.keep_above).alias("_floor"),
    )


def predicted_disruptions(scores: DataFrame, rules=RULES) -> DataFrame:
    """Probability, severity, start, duration and interval for each kind of score.

    All kinds come from one pass over the scores; records at or below the
    kind's probability floor are dropped.
    """
    records = F.inline(F.array(*[_record(r) for r in rules]))
    return scores.select("*", records).where(F.col("probability") > F.col("_floor")).drop("_floor")


def ranked_disruptions(disruptions: DataFrame, keep_above: float = 0.3) -> DataFrame:
    """Confidence cut, strongest first."""
    return disruptions.where(F.col("probability") > keep_above).orderBy(
        (F.col("probability") * F.col("severity_score")).desc(), "location", "disruption_type")


def feature_vector(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Named features with their documented defaults where a value is missing."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(d)) for c, d in defaults.items()})


# Defaults of the three feature vectors.
PORT_DEFAULTS = {
    "throughput_normalized": 0.6, "congestion_index": 0.7, "avg_wait_time": 3.0, "berth_utilization": 0.85,
    "seasonal_factor": 1.2}
ROUTE_DEFAULTS = {
    "avg_speed": 15.0, "avg_delay": 1.5, "on_time_share": 0.8, "weather_risk": 0.2, "political_risk": 0.1}
LANE_DEFAULTS = {"rate_trend": 0.05, "volume_trend": 1.2, "capacity_use": 0.8, "market_stress": 0.3}


def _multiplier(kind: str) -> Column:
    return {
        "port_congestion": F.col("supply_chain_complexity") * 2.0,
        "route_blockage": F.col("international_exposure") * 1.5,
        "rate_spike": (F.lit(2.0) - F.col("inventory_turnover") / 5.0) * 1.2,
        "other": F.lit(1.0),
    }[kind]


def company_impact(companies: DataFrame, disruptions: DataFrame, scope: str = "scenario") -> DataFrame:
    """Impact of every disruption of a scope on every company of that scope.

    The multiplier depends on the company and the disruption type only, so the
    sum over disruptions splits into one total per type. The disruptions shrink
    to one row per scope before the join: no company x disruption pairs arise.
    """
    kinds = [r.kind for r in RULES]
    weight = F.col("probability") * F.col("severity_score")
    known = F.col("disruption_type").isin(kinds)
    totals = disruptions.groupBy(scope).agg(
        *[F.sum(F.when(F.col("disruption_type") == k, weight)).alias(f"_w_{k}") for k in kinds],
        F.sum(F.when(~known, weight)).alias("_w_other"),
    )
    label = F.coalesce(*[
        F.when(F.col("disruption_type") == r.kind, F.concat(F.lit(r.factor), F.col("location"))) for r in RULES])
    leading = top_k(
        disruptions.where(known).withColumn("_label", label), [scope],
        [weight.desc(), F.col("location"), F.col("disruption_type")], 3, rank="_rank")
    factors = listed(leading, [scope], "_rank", "_label", "key_risk_factors")
    per_scope = attach(totals, factors, [scope], ["key_risk_factors"])

    names = [*kinds, "other"]
    total = sum((F.coalesce(F.col(f"_w_{k}"), F.lit(0.0)) * _multiplier(k) for k in names), F.lit(0.0))
    joined = attach(companies, per_scope, [scope], [*[f"_w_{k}" for k in names], "key_risk_factors"])
    score = clip(total - 5.0, -10.0, 10.0)
    mitigation = (
        (F.lit(1.0) - F.col("supply_chain_complexity")) * 0.4
        + F.col("inventory_turnover") / 10.0 * 0.3
        + F.col("market_cap") / 1e12 * 0.3
    )
    return joined.select(
        "symbol", "company_name", "sector", scope,
        F.col("supply_chain_complexity").alias("supply_chain_exposure"),
        F.col("international_exposure").alias("disruption_sensitivity"),
        score.alias("predicted_impact_score"),
        F.least(F.lit(50.0), F.abs(score) * 2.0).alias("revenue_at_risk_pct"),
        F.coalesce("key_risk_factors", F.array().cast("array<string>")).alias("key_risk_factors"),
        clip(mitigation, 0.0, 1.0).alias("mitigation_score"),
    )


def disruption_days(events: DataFrame, start: str = "start", days: str = "duration_days", lead_days: int = 7) -> DataFrame:
    """Event windows folded to one row per calendar day.

    Every window lasts at least ``lead_days`` (>= 1), so inside one day it is
    either whole, begins or ends. A day row keeps whether it is wholly covered,
    the earliest begin and the latest end: all that an existence test needs.
    """
    begin = F.col(start) - F.make_dt_interval(F.lit(lead_days))
    end = F.col(start) + F.make_dt_interval(F.col(days))
    first, last = F.to_date(begin), F.to_date(end)
    spread = events.select(
        begin.alias("_b"), end.alias("_e"), F.explode(F.sequence(first, last)).alias("day"))
    begins, ends = F.to_date("_b") == F.col("day"), F.to_date("_e") == F.col("day")
    return spread.groupBy("day").agg(
        F.bool_or(~begins & ~ends).alias("whole"),
        F.min(F.when(begins, F.col("_b"))).alias("begins_at"),
        F.max(F.when(ends, F.col("_e"))).alias("ends_at"),
    )


def label_disrupted(observations: DataFrame, events: DataFrame, ts: str = "ts", **kw) -> DataFrame:
    """Label 1 where an observation lies within [start - 7 d, start + duration] of any event."""
    days = disruption_days(events, **kw)
    joined = attach(
        observations.withColumn("day", F.to_date(ts)), days, ["day"], ["whole", "begins_at", "ends_at"])
    hit = (
        F.coalesce("whole", F.lit(False))
        | F.coalesce(F.col(ts) >= F.col("begins_at"), F.lit(False))
        | F.coalesce(F.col(ts) <= F.col("ends_at"), F.lit(False))
    )
    return joined.withColumn("label", hit.cast("int")).drop("day", "whole", "begins_at", "ends_at")
