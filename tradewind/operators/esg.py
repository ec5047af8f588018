"""Sustainability scores, their effect on signals, and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind import dims
from tradewind.functions.rowwise import clip, mean_of
from tradewind.operators.freight import direction
from tradewind.plans.blocks import attach
from tradewind.plans.topk import top_k

# Section weights, adjustment strength, default of a missing field.
WEIGHTS = {"environmental": 0.4, "social": 0.3, "governance": 0.3}
STRENGTH, MISSING = 0.3, 50.0
DEFAULTS = {"conflict_minerals": 80.0, "forced_labor_risk": 30.0}


def merge_providers(raw: DataFrame, sections: dict[str, tuple[str, ...]], key: str = "symbol") -> DataFrame:
    """Last provider with a section supplies that whole section; all providers are listed.

    ``max_by`` keeps one candidate per symbol, section and task. The provider
    list is bounded by the number of providers.
    """
    aggs = [
        F.max_by(F.struct(*fields), F.when(F.col(f"has_{name}"), F.col("provider_rank"))).alias(f"_{name}")
        for name, fields in sections.items()]
    listed = F.transform(F.array_sort(F.collect_set(F.struct("provider_rank", "provider"))), lambda p: p["provider"])
    merged = raw.groupBy(key).agg(*aggs, listed.alias("sources"))
    return merged.select(key, "sources", *[F.col(f"_{n}.{f}").alias(f) for n, fs in sections.items() for f in fs])


def composite_scores(merged: DataFrame, sections: dict[str, tuple[str, ...]]) -> DataFrame:
    """Section means over five fields (missing -> 50), weighted total, data quality of 25 per source."""
    filled = merged.withColumns({
        f: F.coalesce(F.col(f), F.lit(DEFAULTS.get(f, MISSING))) for fields in sections.values() for f in fields})
    means = {s: sum((F.col(f) for f in sections[s]), F.lit(0.0)) / len(sections[s]) for s in WEIGHTS}
    scored = filled.withColumns(means)
    return scored.withColumns({
        "overall": sum((F.col(s) * w for s, w in WEIGHTS.items()), F.lit(0.0)),
        "data_quality": F.least(F.lit(100), F.size("sources") * 25)})


def storage_row(scores: DataFrame) -> DataFrame:
    """Flat row for storage: worst climate risk, sources as one text."""
    return scores.withColumns({
        "climate_risk": F.greatest("physical_climate_risk", "transition_climate_risk"),
        "data_sources": F.array_join("sources", ",")}).drop("sources")


@dataclass(frozen=True)
class Adjust:
    """Threshold rule: strictly above or below ``limit`` multiplies the factor."""

    field: str
    above: bool
    limit: float
    factor: float
    positive: str | None = None
    negative: str | None = None
    risk: str | None = None
    needs_chain: bool = False

    def hit(self) -> Column:
        c = F.col(self.field)
        test = c > self.limit if self.above else c < self.limit
        if self.needs_chain:
            test = test & F.col("has_sustainability")
        return F.coalesce(test, F.lit(False))


# The adjustment rules in their order. The overall text carries the score.
RULES = (
    Adjust("overall", True, 70, 1.1, positive="High ESG score (%.0f)"),
    Adjust("overall", False, 30, 0.8, negative="Low ESG score (%.0f)"),
    Adjust("carbon_emissions", True, 75, 1.05, positive="Strong carbon management"),
    Adjust("carbon_emissions", False, 30, 0.95, negative="Poor carbon management"),
    Adjust("renewable_energy", True, 70, 1.03, positive="High renewable energy usage"),
    Adjust("labor_practices", True, 75, 1.04, positive="Strong labor practices"),
    Adjust("labor_practices", False, 35, 0.92, negative="Poor labor practices", risk="Labor practice risks"),
    Adjust("supply_chain_labor", False, 40, 0.90, negative="Supply chain labor concerns", risk="Supply chain labor risks"),
    Adjust("governance", True, 75, 1.06, positive="Strong governance"),
    Adjust("governance", False, 40, 0.88, negative="Weak governance", risk="Governance risks"),
    Adjust("supply_chain_transparency", True, 70, 1.03, positive="High supply chain transparency", needs_chain=True),
    Adjust("supply_chain_transparency", False, 30, 0.95, negative="Low supply chain transparency", needs_chain=True),
    Adjust("forced_labor_risk", True, 60, 0.85, negative="High forced labor risk", risk="Forced labor exposure", needs_chain=True),
    Adjust("supplier_diversity", True, 60, 1.02, positive="Good supplier diversity", needs_chain=True),
    Adjust("physical_climate_risk", True, 70, 0.95, risk="High physical climate risk"),
    Adjust("transition_climate_risk", True, 70, 0.93, risk="High transition climate risk"),
    Adjust("climate_adaptation", True, 70, 1.04, positive="Strong climate adaptation"),
)


def _factors(kind: str) -> Column:
    texts = []
    for rule in RULES:
        text = getattr(rule, kind)
        if text:
            label = F.format_string(text, F.col(rule.field)) if "%" in text else F.lit(text)
            texts.append(F.when(rule.hit(), label))
    return F.array_compact(F.array(*texts))


def adjust_signals(signals: DataFrame, scores: DataFrame, sustainability: DataFrame, key: str = "symbol") -> DataFrame:
    """Signal strength times the sustainability factor; no score row -> strength x 0.9.

    Each side holds one row per symbol, so both joins keep the signal count.
    """
    facts = scores.withColumn("_scored", F.lit(True)).drop(*[c for c in scores.columns if c in signals.columns and c != key])
    chain = sustainability.withColumn("_chain", F.lit(True))
    df = signals.join(facts, key, "left").join(chain, key, "left").withColumn(
        "has_sustainability", F.coalesce("_chain", F.lit(False)))
    factor = F.lit(1.0)
    for rule in RULES:
        factor = factor * F.when(rule.hit(), rule.factor).otherwise(1.0)
    df = df.withColumns({
        "esg_positive_factors": _factors("positive"), "esg_negative_factors": _factors("negative"),
        "esg_risk_factors": _factors("risk"), "_factor": factor})
    flipped = F.col("signal_type").isin("short", "sell") & (F.size("esg_negative_factors") > F.size("esg_positive_factors"))
    scored = F.coalesce("_scored", F.lit(False))
    final = 1 + (F.when(flipped, 2 - F.col("_factor")).otherwise(F.col("_factor")) - 1) * STRENGTH
    positives = F.when(flipped, F.array_append("esg_positive_factors", F.lit("ESG concerns support short thesis"))).otherwise(
        F.col("esg_positive_factors"))
    df = df.withColumns({
        "esg_adjustment_factor": F.when(scored, final),
        "esg_positive_factors": positives,
        "esg_adjusted_strength": F.col("strength") * F.when(scored, final).otherwise(0.9),
        "esg_adjustment_reason": F.when(~scored, "No ESG data available"),
        "sdg_alignment_score": F.when(scored, sdg_alignment()),
    })
    return df.withColumn("esg_rationale", F.when(scored, rationale())).drop("_factor", "_scored", "_chain")


# Field, floor and weight of each development-goal term.
SDG_TERMS = (
    ("renewable_energy", 60, 0.8), ("water_usage", 60, 0.7), ("carbon_emissions", 60, 0.9), ("labor_practices", 60, 0.8),
    ("living_wage_pct", 50, 0.6), ("women_owned_pct", 30, 0.7), ("transparency", 70, 0.6))


def sdg_alignment() -> Column:
    """Mean of the qualifying terms, 30 without any, within [0, 100]."""
    terms = [F.when(F.col(f) > floor, F.col(f) * w) for f, floor, w in SDG_TERMS]
    return clip(F.coalesce(mean_of(terms), F.lit(30.0)), 0, 100)


def rationale() -> Column:
    def part(title, column, k):
        return F.when(F.size(column) > 0, F.concat(F.lit(f"{title}: "), F.array_join(F.slice(column, 1, k), ", ")))

    overall = F.col("overall")
    level = F.when(overall > 70, "Strong").when(overall < 40, "Weak").otherwise("Moderate")
    return F.concat(F.concat_ws(
        ". ", F.format_string("%s ESG profile (score: %.0f)", level, overall), part("Strengths", "esg_positive_factors", 3),
        part("Concerns", "esg_negative_factors", 3), part("Risks", "esg_risk_factors", 2)), F.lit("."))


def base_sustainability(companies: DataFrame, cap: str = "market_cap", sector: str = "sector") -> DataFrame:
    """50 x min(1, ln(cap) / 10) x sector multiplier; NULL without a positive cap."""
    pairs = [x for name, m in dims.SUSTAINABILITY.items() for x in (F.lit(name), F.lit(m))]
    multiplier = F.coalesce(F.create_map(*pairs)[F.col(sector)], F.lit(1.0))
    size = F.when(F.col(cap) > 0, F.least(F.lit(1.0), F.log(F.col(cap)) / 10))
    return companies.withColumns({"size_factor": size, "base_score": 50 * size * multiplier})


def against_benchmark(scores: DataFrame, sectors: DataFrame) -> DataFrame:
    """Distance of each company from its sector's benchmark."""
    joined = scores.join(sectors.select("sector_code", "sector", "bench_e", "bench_s", "bench_g"), "sector_code")
    return joined.select(
        "symbol", "sector", (F.col("environmental") - F.col("bench_e")).alias("gap_e"),
        (F.col("social") - F.col("bench_s")).alias("gap_s"), (F.col("governance") - F.col("bench_g")).alias("gap_g"))


def report_totals(scores: DataFrame) -> DataFrame:
    """Averages and the risk counts of the report."""
    o = F.col("overall")
    return scores.agg(
        F.count("*").alias("companies"), F.avg(o).alias("mean_overall"), F.avg("environmental").alias("mean_e"),
        F.avg("social").alias("mean_s"), F.avg("governance").alias("mean_g"), F.count_if(is_high_risk()).alias("high_risk"),
        F.count_if(F.col("forced_labor_risk") > 60).alias("high_forced_labor"),
        F.count_if(F.col("supply_chain_transparency") < 40).alias("low_transparency"),
        F.count_if(F.col("conflict_minerals") < 60).alias("poor_conflict_minerals"))


def is_high_risk() -> Column:
    return (F.col("forced_labor_risk") > 60) | (F.col("physical_climate_risk") > 70) | (F.col("overall") < 30)


def leading(scores: DataFrame, field: str, k: int = 3) -> DataFrame:
    return scores.orderBy(F.col(field).desc(), "symbol").limit(k).select("symbol", field)


def leaders_and_laggards(scores: DataFrame, k: int = 5) -> DataFrame:
    best = scores.orderBy(F.col("overall").desc(), "symbol").limit(k).withColumn("list", F.lit("leaders"))
    worst = scores.orderBy(F.col("overall").asc(), "symbol").limit(k).withColumn("list", F.lit("laggards"))
    return best.unionByName(worst).select("list", "symbol", "overall")


def sector_means(scores: DataFrame) -> DataFrame:
    return scores.groupBy("sector_code").agg(F.avg("overall").alias("mean_overall"), F.count("*").alias("companies"))


def sector_extremes(scores: DataFrame) -> DataFrame:
    m = sector_means(scores)
    place = F.struct("mean_overall", "sector_code")
    return m.agg(F.max_by("sector_code", place).alias("best_sector"), F.min_by("sector_code", place).alias("worst_sector"))


def high_risk(scores: DataFrame) -> DataFrame:
    return scores.where(is_high_risk()).select(
        "symbol", "overall", "forced_labor_risk",
        F.greatest("physical_climate_risk", "transition_climate_risk").alias("climate_risk"))


def source_coverage(merged: DataFrame) -> DataFrame:
    return merged.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count("*").alias("companies"))


def screen(df: DataFrame, scores: DataFrame, floor: float, key: str = "symbol") -> DataFrame:
    """Rows of companies that reach a minimum score."""
    return df.join(scores.where(F.col("overall") >= floor).select(key), key, "left_semi")


def score_trend(scores: DataFrame, keys, score: str, t: Column, tolerance: float = 0.001) -> DataFrame:
    fit = scores.groupBy(*keys).agg(F.regr_slope(F.col(score), t).alias("slope"), F.count("*").alias("n"))
    return fit.withColumn("trend", direction(F.col("slope"), tolerance, ("improving", "declining", "stable")))
