"""Sector impact, propagation between sectors and rotation signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind import dims
from tradewind.functions.rowwise import clip
from tradewind.plans.blocks import attach
from tradewind.plans.topk import listed, top_k


def dependency_scores(edges: DataFrame, nodes: int, nodes_from: DataFrame | None = None, src="src", dst="dst") -> DataFrame:
    """0.6 x mean incoming weight + 0.4 x outgoing share, at most 1; an isolated node has 0.3."""
    incoming = edges.groupBy(F.col(dst).alias("node")).agg(F.count("*").alias("in_degree"), F.avg("weight").alias("mean_in"))
    outgoing = edges.groupBy(F.col(src).alias("node")).agg(F.count("*").alias("out_degree"))
    both = incoming.join(outgoing, "node", "full")
    if nodes_from is not None:
        both = nodes_from.join(both, "node", "left")
    score = F.coalesce("mean_in", F.lit(0.0)) * 0.6 + F.coalesce("out_degree", F.lit(0)) / float(nodes) * 0.4
    isolated = F.col("in_degree").isNull() & F.col("out_degree").isNull()
    return both.select(
        "node", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("mean_in", F.lit(0.0)).alias("mean_in"),
        F.coalesce("out_degree", F.lit(0)).alias("out_degree"),
        F.when(isolated, 0.3).otherwise(F.least(F.lit(1.0), score)).alias("dependency"))


def recovery_days(base: Column, vulnerability: Column) -> Column:
    return F.greatest(F.lit(7), (base * (1 + (vulnerability - 5) * 0.2)).cast("int"))


def mitigation(sector: Column, factors: Column) -> Column:
    """Three sector texts, then one per risk type present in the factors; first five."""
    own = F.lit(None).cast("array<string>")
    for name, texts in dims.MITIGATION.items():
        own = F.when(sector == name, F.array(*[F.lit(x) for x in texts])).otherwise(own)
    base = F.coalesce(own, F.array(*[F.lit(x) for x in dims.MITIGATION_DEFAULT]))
    joined = F.array_join(factors, "; ")
    extra = F.array_compact(F.array(*[
        F.when(F.contains(joined, F.lit(kind)), F.lit(text)) for kind, text in dims.MITIGATION_BY_RISK]))
    return F.slice(F.concat(base, extra), 1, 5)


def sector_impact(disruptions: DataFrame, sectors: DataFrame, sensitivity: DataFrame, edges: DataFrame,
                  caps: DataFrame, scope: str = "scenario") -> DataFrame:
    """Impact of all disruptions of a scope on each sector.

    Disruptions shrink to one row per (scope, type) first. Only those totals
    meet the eleven sectors, so the fan-out is fixed however many disruptions
    there are. Risk factors need at most five rows per (scope, type): within a
    type the order by weight is the same for every sector.
    """
    weight = F.col("probability") * F.col("severity_score")
    d = F.col("start_in_days")
    totals = disruptions.groupBy(scope, "disruption_type").agg(
        F.sum(F.when(d <= 0, weight)).alias("_now"),
        F.sum(F.when((d > 0) & (d <= 7), weight * 0.8)).alias("_week"),
        F.sum(F.when((d > 7) & (d <= 30), weight * 0.6)).alias("_month"))
    codes = [s[0] for s in dims.SECTORS]
    each = F.explode(F.array(*[F.lit(c) for c in codes])).alias("sector_code")

    def felt(df):
        spread = df.select("*", each)
        return spread.join(sensitivity, ["sector_code", "disruption_type"], "left").withColumn(
            "_s", F.coalesce("sensitivity", F.lit(dims.DEFAULT_SENSITIVITY)))

    zero = F.lit(0.0)
    sums = felt(totals).groupBy(scope, "sector_code").agg(
        *[F.coalesce(F.sum(F.col(c) * F.col("_s")), zero).alias(c) for c in ("_now", "_week", "_month")],
        F.count("*").alias("types"))
    strongest = top_k(
        disruptions.withColumn("_w", weight), [scope, "disruption_type"], [F.col("_w").desc(), F.col("location")], 5)
    reasons = felt(strongest).where(F.col("_w") * F.col("_s") > 2).withColumn(
        "_label", F.concat_ws(" at ", "disruption_type", "location"))
    named = listed(
        top_k(reasons, [scope, "sector_code"], [F.col("_w").desc(), F.col("location"), F.col("disruption_type")], 5, rank="_r"),
        [scope, "sector_code"], "_r", "_label", "key_risk_factors")

    mean_sensitivity = sensitivity.groupBy("sector_code").agg(F.avg("sensitivity").alias("_mean"))
    depend = dependency_scores(edges, len(codes), sectors.select(F.col("sector_code").alias("node"))).select(
        F.col("node").alias("sector_code"), "dependency")
    facts = sectors.select("sector_code", "sector", "recovery").join(mean_sensitivity, "sector_code").join(depend, "sector_code").join(
        caps, "sector_code", "left")
    joined = attach(sums.join(facts, "sector_code"), named, [scope, "sector_code"], ["key_risk_factors"])
    vulnerability = F.col("_mean") * 4 + F.col("dependency") * 3 + F.least(F.lit(3), F.col("types"))
    month = clip(F.col("_month") - 2, -10, 10)
    factors = F.coalesce("key_risk_factors", F.array().cast("array<string>"))
    return joined.select(
        scope, "sector_code", "sector", vulnerability.alias("vulnerability_score"),
        clip(F.col("_now") - 5, -10, 10).alias("current_impact"), clip(F.col("_week") - 3, -10, 10).alias("predicted_impact_7d"),
        month.alias("predicted_impact_30d"), F.col("dependency").alias("supply_chain_dependency"),
        factors.alias("key_risk_factors"), F.greatest(F.lit(10), (vulnerability * 20).cast("int")).alias("affected_companies_count"),
        (F.coalesce("market_cap", F.lit(100.0)) * F.abs(month) / 100).alias("market_cap_at_risk"),
        recovery_days(F.col("recovery"), vulnerability).alias("recovery_time_estimate"),
        mitigation(F.col("sector"), factors).alias("mitigation_strategies"))


def pair_correlation(pairs: DataFrame, edges: DataFrame, first="src", second="dst", out="correlation") -> DataFrame:
    """Listed pair, else share of the forward edge, else of the reverse edge, else the default."""
    listed_pair = F.lit(False)
    for a, b in dims.CORRELATED:
        listed_pair = listed_pair | ((F.col(first) == a) & (F.col(second) == b)) | ((F.col(first) == b) & (F.col(second) == a))
    forward = edges.select(F.col("src").alias(first), F.col("dst").alias(second), F.col("weight").alias("_f"))
    reverse = edges.select(F.col("dst").alias(first), F.col("src").alias(second), F.col("weight").alias("_b"))
    share = dims.EDGE_CORRELATION_SHARE
    return (
        pairs.join(forward, [first, second], "left").join(reverse, [first, second], "left")
        .withColumn(out, F.when(listed_pair, dims.PAIR_CORRELATION).otherwise(
            F.coalesce(F.col("_f") * share, F.col("_b") * share, F.lit(dims.NO_CORRELATION))))
        .drop("_f", "_b")
    )


def propagate(impacts: DataFrame, sectors: DataFrame, edges: DataFrame, scope: str = "scenario") -> DataFrame:
    """One hop along dependency edges: strong sources, strong edges, notable results."""
    hops = impacts.where(F.abs("current_impact") > 1).select(scope, F.col("sector_code").alias("src"), "current_impact").join(
        edges.where(F.col("weight") > 0.3), "src")
    moved = F.col("current_impact") * F.col("weight") * 0.7
    delays = sectors.select(F.col("sector_code").alias("dst"), "delay")
    kept = pair_correlation(hops.where(F.abs(moved) > 0.5), edges).join(delays, "dst", "left")
    return kept.select(
        scope, F.col("src").alias("source_code"), F.col("dst").alias("target_code"),
        (F.abs(moved) / 10).alias("impact_strength"),
        F.greatest(F.lit(1), (F.coalesce("delay", F.lit(5)) * (2 - F.col("weight"))).cast("int")).alias("propagation_delay"),
        F.lit("supply").alias("impact_type"), (F.col("weight") * 0.8).alias("confidence_level"),
        F.col("correlation").alias("historical_correlation"))


SIGNAL = ("signal_type", "source_sector", "target_sector", "strength", "expected_return", "risk_level", "confidence", "rationale")


def underweight_signals(impacts: DataFrame, scope: str = "scenario") -> DataFrame:
    month, vul = F.col("predicted_impact_30d"), F.col("vulnerability_score")
    return impacts.where(month < -3).select(
        scope, F.lit("underweight").alias("signal_type"), F.col("sector").alias("source_sector"), F.lit("").alias("target_sector"),
        F.least(F.lit(1.0), F.abs(month) / 10).alias("strength"), month.alias("expected_return"),
        F.when(vul > 7, "high").otherwise("medium").alias("risk_level"), F.lit(0.7).alias("confidence"),
        F.format_string("High vulnerability to supply chain disruptions (score: %.1f)", vul).alias("rationale"))


def overweight_signals(impacts: DataFrame, cross: DataFrame, scope: str = "scenario") -> DataFrame:
    """Resilient sectors that gain from the disruption of others, or are very resilient."""
    sources = impacts.where(F.col("predicted_impact_30d") < -2).select(scope, F.col("sector_code").alias("source_code"))
    gains = cross.where(F.col("impact_strength") > 0.3).join(sources, [scope, "source_code"], "left_semi").groupBy(
        scope, F.col("target_code").alias("sector_code")).agg(F.sum("impact_strength").alias("_gain"))
    calm = impacts.where((F.col("vulnerability_score") < 4) & (F.col("predicted_impact_30d") > -1))
    joined = attach(calm, gains, [scope, "sector_code"], ["_gain"]).withColumn("_gain", F.coalesce("_gain", F.lit(0.0)))
    gain, vul = F.col("_gain"), F.col("vulnerability_score")
    return joined.where((gain > 0.3) | (vul < 3)).select(
        scope, F.lit("overweight").alias("signal_type"), F.lit("").alias("source_sector"), F.col("sector").alias("target_sector"),
        F.least(F.lit(1.0), (gain + (5 - vul) / 5) / 2).alias("strength"), F.greatest(F.lit(2.0), 5 - vul).alias("expected_return"),
        F.when(vul < 3, "low").otherwise("medium").alias("risk_level"), (0.6 + gain * 0.2).alias("confidence"),
        F.lit("Low supply chain vulnerability and potential beneficiary of disruptions").alias("rationale"))


def pair_trades(impacts: DataFrame, scope: str = "scenario") -> DataFrame:
    """Three worst against three best sectors of a scope with a spread above 3.

    At most three rows per side and scope meet, as two short arrays of one row.
    """
    month = F.col("predicted_impact_30d")
    row = F.struct(month.alias("m"), F.col("sector").alias("s"))
    # eleven sectors per scope at most: the array is bounded by the dimension
    ordered = impacts.groupBy(scope).agg(F.array_sort(F.collect_list(row)).alias("_all"))
    n = F.size("_all")
    worst = ordered.select(scope, F.explode(F.slice("_all", 1, 3)).alias("w"), F.slice(F.col("_all"), F.greatest(F.lit(1), n - 2), F.lit(3)).alias("_best"))
    pairs = worst.select(scope, "w", F.explode("_best").alias("b")).where("w.s <> b.s AND b.m - w.m > 3")
    spread = F.col("b.m") - F.col("w.m")
    return pairs.select(
        scope, F.lit("pair_trade").alias("signal_type"), F.col("w.s").alias("source_sector"), F.col("b.s").alias("target_sector"),
        F.least(F.lit(1.0), spread / 10).alias("strength"), spread.alias("expected_return"), F.lit("medium").alias("risk_level"),
        F.lit(0.6).alias("confidence"),
        F.format_string("Pair trade: Short %s (impact: %.1f), Long %s (impact: %.1f)", "w.s", "w.m", "b.s", "b.m").alias("rationale"))


def rotation_signals(impacts: DataFrame, cross: DataFrame, scope: str = "scenario") -> DataFrame:
    """All three kinds, strongest first."""
    out = underweight_signals(impacts, scope).unionByName(overweight_signals(impacts, cross, scope)).unionByName(pair_trades(impacts, scope))
    return out.orderBy((F.col("strength") * F.col("confidence")).desc(), scope, "signal_type", "source_sector", "target_sector")


def sector_report(impacts: DataFrame, scope: str = "scenario") -> DataFrame:
    """Averages, extremes, counts and up to ten distinct risk factors per scope."""
    vul, month = F.col("vulnerability_score"), F.col("predicted_impact_30d")
    flat = F.array_sort(F.array_distinct(F.flatten(F.collect_list("key_risk_factors"))))  # 11 sectors x 5 factors at most
    return impacts.groupBy(scope).agg(
        F.avg(vul).alias("mean_vulnerability"), F.max_by("sector", F.struct(vul, "sector")).alias("most_vulnerable"),
        F.min_by("sector", F.struct(vul, "sector")).alias("least_vulnerable"), F.count_if(month < -2).alias("negative"),
        F.count_if(month > 1).alias("positive"), F.count_if(vul > 7).alias("high_risk"),
        F.sum("market_cap_at_risk").alias("cap_at_risk"), F.avg("recovery_time_estimate").alias("mean_recovery"),
        F.array_join(F.slice(flat, 1, 10), "; ").alias("risk_factors"))


def sdg_links(df: DataFrame, activity: str) -> DataFrame:
    """Goal numbers of each activity."""
    table = F.create_map(*[x for k, goals in dims.SDG.items() for x in (F.lit(k), F.array(*[F.lit(g) for g in goals]))])
    return df.select("*", F.explode(table[F.col(activity)]).alias("goal"))


def monthly_impact(disruptions: DataFrame, sensitivity: DataFrame, month: str = "month") -> DataFrame:
    """Impact sums per month and sector; totals per (month, type) meet the fixed sensitivities."""
    weight = F.col("probability") * F.col("severity_score")
    totals = disruptions.groupBy(month, "disruption_type").agg(F.sum(weight).alias("_w"))
    return totals.join(sensitivity, "disruption_type").groupBy(month, "sector_code").agg(
        F.sum(F.col("_w") * F.col("sensitivity")).alias("impact"))
