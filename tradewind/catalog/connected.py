"""The whole way from trained models to booked orders, stage by stage."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tradewind.catalog import analytics as A
from tradewind.catalog import trading as T
from tradewind.catalog.domain import INDEX
from tradewind.catalog.registry import query
from tradewind.operators.outlook import DEFAULTS, DROP, PLACES, Outlook
from tradewind.sources.adapters import VIEWS

AS_OF = "2001-11-26"
j = F.array_join

def _kept(sql: str, columns: str) -> str:
    """A stage as it is stored: scores to nine places."""
    return f"SELECT * REPLACE ({', '.join(f'round({c}, {PLACES}) AS {c}' for c in columns.split())}) FROM ({sql})"


def _over(sql: str) -> str:
    return sql.replace("JOIN disruptions d", "JOIN outlook d").replace("FROM disruptions", "FROM outlook")


VIEWS["port_months"] = (("port_metrics",), f"""
    SELECT *, lead(congestion_index) OVER (PARTITION BY port_name ORDER BY ts) AS next_congestion
    FROM (SELECT port_name, ts, {INDEX} AS congestion_index FROM port_metrics)""")
VIEWS["lane_months"] = (("lane_rates",), f"""
    SELECT *, shipments / avg(shipments) OVER (PARTITION BY location) AS load, lead(wobble) OVER (PARTITION BY location ORDER BY month) AS next_wobble,
        CASE WHEN lead(shipments) OVER (PARTITION BY location ORDER BY month) < shipments * {DROP}e0 THEN 1e0 WHEN lead(shipments) OVER (PARTITION BY location ORDER BY month) IS NOT NULL THEN 0e0 END AS dropped
    FROM (SELECT origin AS scenario, concat(origin, '/', r_name) AS location, date_trunc('month', ts) AS month, count(*) AS shipments, stddev_samp(rate_40ft) / avg(rate_40ft) AS wobble
        FROM lane_rates JOIN region ON r_regionkey = region_key GROUP BY ALL)""")
VIEWS["outlook_scores"] = (("port_months", "lane_months"), _kept(f"""
    SELECT l.scenario, l.location, coalesce(p.congestion, {DEFAULTS['congestion_index']}) AS congestion, least(1e0, greatest(0e0, m.rs * l.load + m.ri)) AS route_p, m.vs * coalesce(l.wobble, {DEFAULTS['wobble']}) + m.vi AS volatility,
        date_diff('day', DATE '{AS_OF}', CAST(l.month + INTERVAL 1 MONTH AS DATE)) AS opens_in
    FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY month DESC) AS rn FROM lane_months) l
    CROSS JOIN (SELECT regr_slope(dropped, load) AS rs, regr_intercept(dropped, load) AS ri, regr_slope(next_wobble, wobble) AS vs, regr_intercept(next_wobble, wobble) AS vi FROM lane_months) m
    LEFT JOIN (SELECT port_name, slope * congestion_index + base AS congestion FROM (SELECT *, row_number() OVER (PARTITION BY port_name ORDER BY ts DESC) AS rn FROM port_months)
        CROSS JOIN (SELECT regr_slope(next_congestion, congestion_index) AS slope, regr_intercept(next_congestion, congestion_index) AS base FROM port_months) WHERE rn = 1) p ON p.port_name = l.scenario
    WHERE l.rn = 1""", "congestion route_p volatility"))
VIEWS["outlook"] = (("outlook_scores",), _kept("SELECT k.* EXCLUDE (lead_days, ci_low, ci_high), s.opens_in + k.lead_days AS start_in_days FROM ("
                    + f"{A.PORT} UNION ALL {A.ROUTE} UNION ALL {A.RATE}".replace("lane_stress", "outlook_scores") + ") k JOIN outlook_scores s USING (scenario, location)", "probability severity_score"))


VIEWS["outlook_sectors"] = (("companies", "outlook", "sectors", "sensitivity", "edges"), _kept(_over(A.SECTOR), A.SECTOR_RND))
VIEWS["outlook_rotation"] = (("outlook_sectors", "edges", "sectors"), A.ROTATION.replace("sector_impacts", "outlook_sectors"))
VIEWS["outlook_companies"] = (("companies", "outlook", "outlook_sectors"), f"""
    SELECT c.*, round(i.predicted_impact_score, 9) AS impact_score, i.key_risk_factors AS factors, coalesce(p.probability, 0e0) AS probability, v.vulnerability_score, v.recovery_time_estimate AS recovery_days
    FROM ({_over(A.COMPANY)}) i JOIN companies c USING (symbol) LEFT JOIN (SELECT scenario, max(probability) AS probability FROM outlook GROUP BY scenario) p ON p.scenario = c.scenario
    LEFT JOIN outlook_sectors v ON v.scenario = c.scenario AND v.sector = c.sector""")
_ROTATED = T.ROTATE[T.ROTATE.index("pr AS ("):].replace("FROM rot r", "FROM outlook_rotation r")
_ROTATED = _ROTATED.replace("pr.sector = r.sector AND up", "pr.sector = r.target_sector AND up").replace("pr.sector = r.sector AND down", "pr.sector = r.source_sector AND down")
_ROTATED = re.sub(r"\br\.sector\b", "pr.sector", _ROTATED)
TRADE_RND = "strength target_weight expected_return confidence entry_price stop_loss take_profit"
VIEWS["outlook_trades"] = (("outlook_companies", "outlook_rotation", "companies"), f"""
    SELECT scenario, 'company' AS origin, symbol, sector, CASE WHEN short THEN 'short' ELSE 'buy' END AS signal_type, least(1.0, abs(impact_score) / 10 * probability) AS strength,
        CASE WHEN short THEN -least(0.05, abs(impact_score) / 20) ELSE least(0.05, impact_score / 25) END AS target_weight, expected_return, confidence,
        CASE WHEN n > 3 THEN 'high' WHEN n > 1 THEN 'medium' ELSE 'low' END AS risk_level, price AS entry_price, CASE WHEN short THEN price * 1.1 ELSE price * 0.9 END AS stop_loss,
        price * (1 + expected_return / 100) AS take_profit, CASE WHEN esg < 40 THEN 'Poor ESG rating - proceed with caution' WHEN esg > 70 THEN 'Strong ESG profile supports investment thesis' END AS esg_note,
        CASE WHEN recovery_days < 30 THEN 'short' WHEN recovery_days < 90 THEN 'medium' ELSE 'long' END AS time_horizon
    FROM (SELECT *, impact_score < -3 AS short, CASE WHEN impact_score < -3 THEN impact_score * 0.5 ELSE impact_score * 0.3 END AS expected_return, coalesce(esg_score, 50) AS esg, coalesce(current_price, 100) AS price,
            (probability + least(1.0, abs(impact_score) / 10) + coalesce(data_quality, 0.7) + coalesce(liquidity_score, 0.8) + CASE WHEN coalesce(esg_score, 50) < 30 THEN 0.5 ELSE least(1.0, coalesce(esg_score, 50) / 100) END) / 5 AS confidence,
            CASE WHEN factors = '' THEN 0 ELSE len(string_split(factors, '; ')) END + CASE WHEN coalesce(beta, 1) > 1.5 THEN 1 ELSE 0 END + CASE WHEN coalesce(debt_to_equity, 0.5) > 1 THEN 1 ELSE 0 END AS n
        FROM outlook_companies WHERE impact_score < -3 OR impact_score > 2) WHERE confidence >= 0.6
    UNION ALL SELECT scenario, 'sector', symbol, sector, signal_type, strength, target_weight, expected_return, confidence, risk_level, entry_price, stop_loss, take_profit, NULL, NULL FROM (WITH {_ROTATED})""")
_ESG = T.ADJUST.replace("FROM signals g", "FROM outlook_trades g").replace("SELECT g.symbol, g.signal_type, g.strength", "SELECT g.*")
ESG_RND = "esg_adjustment_factor esg_adjusted_strength sdg_alignment_score"
VIEWS["outlook_esg"] = (("outlook_trades", "esg_rated", "sustainability"),
                        _ESG.replace("    SELECT symbol, CASE WHEN scored", "    SELECT scenario, origin, symbol, CASE WHEN scored"))



def outlook(t) -> Outlook:
    return Outlook(t, AS_OF)


@query("pipeline_scores", "SELECT * FROM outlook_scores", uses="outlook_scores", rnd="congestion route_p volatility")
def pipeline_scores(t):
    return outlook(t).scores()


@query("pipeline_predictions", "SELECT scenario, location, disruption_type, probability, severity_score, duration_days, start_in_days FROM outlook", uses="outlook", rnd="probability severity_score")
def pipeline_predictions(t):
    return outlook(t).predictions()


@query("pipeline_sector_impact", "SELECT * FROM outlook_sectors", uses="outlook_sectors", rnd=A.SECTOR_RND)
def pipeline_sector_impact(t):
    return outlook(t).sector_impacts().withColumns({c: j(c, "; ") for c in ("key_risk_factors", "mitigation_strategies")})


@query("pipeline_rotation_signals", "SELECT * FROM outlook_rotation", uses="outlook_rotation", rnd=A.SIG_RND)
def pipeline_rotation_signals(t):
    return outlook(t).rotation_signals()


@query("pipeline_trade_signals", "SELECT * FROM outlook_trades", uses="outlook_trades", rnd=TRADE_RND)
def pipeline_trade_signals(t):
    return outlook(t).trade_signals()


@query("pipeline_esg_signals", "SELECT * FROM outlook_esg", uses="outlook_esg", rnd=ESG_RND)
def pipeline_esg_signals(t):
    return outlook(t).esg_signals().select(
        "scenario", "origin", "symbol", "esg_adjustment_factor", "esg_adjusted_strength", "esg_adjustment_reason", j("esg_positive_factors", "; ").alias("positive"),
        j("esg_negative_factors", "; ").alias("negative"), j("esg_risk_factors", "; ").alias("risk"), "sdg_alignment_score", "esg_rationale")


@query("pipeline_orders", """WITH a AS (SELECT t.*, e.esg_adjusted_strength, -round(e.esg_adjusted_strength * t.confidence * abs(t.expected_return), 9) AS priority FROM outlook_trades t JOIN outlook_esg e USING (scenario, origin, symbol)
        WHERE NOT (abs(target_weight) > 0.05 OR (risk_level = 'high' AND abs(target_weight) > 0.02) OR (coalesce(esg_note, '') LIKE '%Poor ESG%' AND abs(target_weight) > 0.01) OR confidence < 0.6)),
    z AS (SELECT *, floor(1e6 * abs(target_weight) / entry_price) * CASE WHEN target_weight < 0 THEN -1 ELSE 1 END AS ts FROM a),
    f AS (SELECT z.*, p.shares AS held, p.entry_price AS entry, lag(ts) OVER (PARTITION BY z.symbol ORDER BY priority, scenario, origin, z.symbol) AS bf FROM z LEFT JOIN positions p ON p.symbol = z.symbol WHERE ts <> 0),
    b AS (SELECT *, ts - coalesce(bf, held, 0) AS traded FROM f)
    SELECT scenario, origin, symbol, signal_type, CASE WHEN bf IS NULL AND held IS NULL THEN 'new_position' ELSE 'adjust_position' END AS action, CAST(ts AS BIGINT) AS target_shares, CAST(traded AS BIGINT) AS traded,
        abs(traded * entry_price) AS turnover, 1e6 - sum(abs(traded * entry_price)) OVER (ORDER BY priority, scenario, origin, symbol ROWS UNBOUNDED PRECEDING) AS cash FROM b WHERE traded <> 0""",
       uses="outlook_trades outlook_esg positions", rnd="turnover cash", places=2)
def pipeline_orders(t):
    return outlook(t).orders().select("scenario", "origin", "symbol", "signal_type", "action", "target_shares", "traded", "turnover", "cash")
