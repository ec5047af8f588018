"""Rule-based reading of market snapshots and the signal that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column, limit, points, list it reports to, text.
RULES = (
    ("baltic_dry_index", 1200.0, 0.2, "opportunities", "High Baltic Dry Index suggests strong dry bulk demand"),
    ("fuel_cost", 600.0, 0.3, "risk_factors", "Elevated fuel costs at $%s/ton"),
    ("congestion_score", 6.0, 0.4, "risk_factors", "High port congestion (score: %s)"),
    ("supply_demand_ratio", 1.05, 0.2, "opportunities", "Tight capacity market (S/D ratio: %s)"),
    ("rate_volatility", 0.3, 0.1, "risk_factors", "High rate volatility (index: %s)"),
)
# Advice per score band.
ADVICE = {
    "high": ("Consider hedging fuel cost exposure", "Diversify shipping routes to avoid congested ports",
             "Monitor capacity utilization closely"),
    "raised": ("Increase monitoring frequency for key metrics", "Prepare contingency plans for route diversification"),
    "calm": ("Market conditions appear stable",),
}


def _texts(kind: str) -> list[Column]:
    out = []
    for column, limit, _, target, text in RULES:
        if target == kind:
            label = F.format_string(text, F.col(column).cast("string")) if "%s" in text else F.lit(text)
            out.append(F.when(F.col(column) > limit, label))
    return out


def _list(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def score_snapshots(df: DataFrame, ports: str | None = None) -> DataFrame:
    """Score, opportunities, risk factors and advice of each snapshot row.

    ``ports`` names an array of structs (name, level); every port at level
    'high' adds a risk factor.
    """
    score = sum((F.when(F.col(c) > limit, points).otherwise(0.0) for c, limit, points, _, _ in RULES), F.lit(0.0))
    risks = F.array_compact(F.array(*_texts("risk_factors")))
    if ports:
        high = F.filter(F.col(ports), lambda p: p["level"] == "high")
        risks = F.concat(risks, F.transform(
            high, lambda p: F.concat(F.lit("High congestion at "), F.initcap(F.replace(p["name"], F.lit("_"), F.lit(" "))))))
    s = F.col("disruption_score")
    return df.withColumns({
        "disruption_score": F.round(score, 10), "opportunities": F.array_compact(F.array(*_texts("opportunities"))), "risk_factors": risks,
    }).withColumn(
        "recommendations",
        F.when(s > 0.5, _list(ADVICE["high"])).when(s > 0.3, _list(ADVICE["raised"])).otherwise(_list(ADVICE["calm"])))


def market_signal(score: str = "disruption_score") -> dict[str, Column]:
    """Overall signal, confidence and position size in percent."""
    s = F.col(score)
    confidence = F.when(s > 0.6, F.least(s, F.lit(0.9))).when(s > 0.4, s * 0.8).when(s < 0.2, 0.3).otherwise(0.0)
    return {
        "overall_signal": F.when(s > 0.6, "STRONG_LONG").when(s > 0.4, "MODERATE_LONG").when(s < 0.2, "NEUTRAL_TO_SHORT").otherwise("NEUTRAL"),
        "confidence": confidence,
        "position_pct": F.least(confidence * 100, F.lit(25.0)),
    }
