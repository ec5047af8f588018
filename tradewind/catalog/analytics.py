"""Disruption, sector, strategy and sustainability queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewind import dims
from tradewind.catalog.registry import query
from tradewind.operators import disruption as D
from tradewind.operators import freight
from tradewind.operators import sector as S
from tradewind.sources.adapters import VIEWS

j = F.array_join

# --- disruptions and companies ---------------------------------------------


def _kind(kind: str, x: str, p: str, sev: str, lead: int, dur: str, ci: float, floor: float) -> str:
    return f"""SELECT scenario, location, '{kind}' AS disruption_type, {p} AS probability, least(10.0, {sev}) AS severity_score,
        CAST({lead} AS BIGINT) AS lead_days, CAST(trunc({dur}) AS BIGINT) AS duration_days, greatest(0.0, {p} - {ci}) AS ci_low,
        least(1.0, {p} + {ci}) AS ci_high FROM lane_stress WHERE {p} > {floor}"""


PORT = _kind("port_congestion", "congestion", "least(1.0, greatest(0.0, (congestion - 0.5) * 2))", "congestion * 10", 1, "3 + 7 * congestion", 0.2, 0.3)
ROUTE = _kind("route_blockage", "route_p", "route_p", "route_p * 8 + 2", 2, "1 + 5 * route_p", 0.15, 0.3)
RATE = _kind("rate_spike", "volatility", "least(1.0, volatility * 3)", "volatility * 20", 3, "5 + 10 * volatility", 0.2, 0.4)
RND = "probability severity_score ci_low ci_high"
OUT = ["scenario", "location", "disruption_type", "probability", "severity_score", "lead_days", "duration_days", "ci_low", "ci_high"]

for _i, (_name, _sql) in enumerate({"port": PORT, "route": ROUTE, "rate": RATE}.items()):
    @query(f"{_name}_disruptions", _sql, uses="lane_stress", rnd=RND)
    def one_kind(t, _i=_i):
        return D.predicted_disruptions(t.lane_stress, D.RULES[_i : _i + 1]).select(*OUT)


@query("all_disruptions", f"{PORT} UNION ALL {ROUTE} UNION ALL {RATE}", uses="lane_stress", rnd=RND)
def all_disruptions(t):
    return D.predicted_disruptions(t.lane_stress).select(*OUT)


@query("ranked_disruptions", "SELECT location, disruption_type, probability * severity_score AS weight FROM disruptions WHERE probability > 0.3 ORDER BY weight DESC, location, disruption_type",
       uses="disruptions", rnd="weight")
def ranked_disruptions(t):
    return D.ranked_disruptions(t.disruptions).select("location", "disruption_type", (F.col("probability") * F.col("severity_score")).alias("weight"))


@query("feature_vector_defaults", """SELECT port_name, ts, coalesce(berth_utilization, 0.85) AS berth_utilization, coalesce(avg_waiting_time, 3.0) AS avg_wait_time,
    CAST(0.6 AS DOUBLE) AS throughput_normalized, CAST(0.7 AS DOUBLE) AS congestion_index, CAST(1.2 AS DOUBLE) AS seasonal_factor FROM port_metrics""", uses="port_metrics")
def feature_vector_defaults(t):
    missing = {c: F.lit(None).cast("double") for c in ("throughput_normalized", "congestion_index", "seasonal_factor")}
    rows = t.port_metrics.select("port_name", "ts", "berth_utilization", F.col("avg_waiting_time").alias("avg_wait_time")).withColumns(missing)
    return D.feature_vector(rows, D.PORT_DEFAULTS)


@query("route_lane_vectors", """SELECT origin, destination, coalesce(CASE WHEN n % 3 <> 0 THEN q END, 15.0) AS avg_speed, CAST(1.5 AS DOUBLE) AS avg_delay, CAST(0.8 AS DOUBLE) AS on_time_share,
    CAST(0.2 AS DOUBLE) AS weather_risk, CAST(0.1 AS DOUBLE) AS political_risk, CAST(0.05 AS DOUBLE) AS rate_trend, CAST(1.2 AS DOUBLE) AS volume_trend,
    CAST(0.8 AS DOUBLE) AS capacity_use, coalesce(CASE WHEN n % 2 = 0 THEN r / 1000 END, 0.3) AS market_stress
    FROM (SELECT origin, destination, count(*) AS n, avg(quantity) AS q, avg(rate_40ft) AS r FROM lane_rates GROUP BY ALL)""", uses="lane_rates", rnd="avg_speed market_stress")
def route_lane_vectors(t):
    g = t.lane_rates.groupBy("origin", "destination").agg(
        F.count("*").alias("n"), F.avg("quantity").alias("q"), F.avg("rate_40ft").alias("r"))
    blank = {c: F.lit(None).cast("double") for c in (*D.ROUTE_DEFAULTS, *D.LANE_DEFAULTS)}
    rows = g.withColumns({**blank, "avg_speed": F.when(F.col("n") % 3 != 0, F.col("q")), "market_stress": F.when(F.col("n") % 2 == 0, F.col("r") / 1000)})
    return D.feature_vector(rows, {**D.ROUTE_DEFAULTS, **D.LANE_DEFAULTS}).drop("n", "q", "r")


LABEL = """CASE disruption_type WHEN 'port_congestion' THEN concat('Port congestion at ', location) WHEN 'route_blockage' THEN concat('Route disruption: ', location)
    WHEN 'rate_spike' THEN concat('Freight rate spike: ', location) END"""
COMPANY = f"""WITH s AS (SELECT c.symbol, sum(d.probability * d.severity_score * CASE disruption_type WHEN 'port_congestion' THEN supply_chain_complexity * 2
        WHEN 'route_blockage' THEN international_exposure * 1.5 WHEN 'rate_spike' THEN (2 - inventory_turnover / 5) * 1.2 ELSE 1 END) AS total
        FROM companies c JOIN disruptions d USING (scenario) GROUP BY c.symbol),
    r AS (SELECT scenario, {LABEL} AS label, row_number() OVER (PARTITION BY scenario ORDER BY probability * severity_score DESC, location, disruption_type) AS rn FROM disruptions),
    f AS (SELECT scenario, string_agg(label, '; ' ORDER BY rn) AS factors FROM r WHERE rn <= 3 GROUP BY scenario),
    x AS (SELECT c.*, least(10.0, greatest(-10.0, coalesce(total, 0) - 5)) AS score, coalesce(factors, '') AS factors FROM companies c LEFT JOIN s USING (symbol) LEFT JOIN f ON f.scenario = c.scenario)
    SELECT symbol, company_name, sector, scenario, supply_chain_complexity AS supply_chain_exposure, international_exposure AS disruption_sensitivity, score AS predicted_impact_score,
        least(50.0, abs(score) * 2) AS revenue_at_risk_pct, factors AS key_risk_factors,
        least(1.0, greatest(0.0, (1 - supply_chain_complexity) * 0.4 + inventory_turnover / 10 * 0.3 + market_cap / 1e12 * 0.3)) AS mitigation_score FROM x"""


@query("company_impact", COMPANY, uses="companies disruptions", rnd="supply_chain_exposure disruption_sensitivity predicted_impact_score revenue_at_risk_pct mitigation_score")
def company_impact(t):
    return D.company_impact(t.companies, t.disruptions).withColumn("key_risk_factors", j("key_risk_factors", "; "))


@query("companies_by_impact", f"SELECT symbol, predicted_impact_score FROM ({COMPANY}) ORDER BY predicted_impact_score, symbol", uses="companies disruptions", rnd="predicted_impact_score")
def companies_by_impact(t):
    return D.company_impact(t.companies, t.disruptions).select("symbol", "predicted_impact_score").orderBy("predicted_impact_score", "symbol")


@query("disruption_labels", """WITH e AS (SELECT ts AS start, CAST(event_id % 4 AS INT) AS days FROM events WHERE value > 300)
    SELECT event_id, CAST(EXISTS (SELECT 1 FROM e WHERE o.ts BETWEEN e.start - INTERVAL 1 DAY AND e.start + to_days(e.days)) AS BIGINT) AS label FROM events o""")
def disruption_labels(t):
    hits = t.events.where("value > 300").select(F.col("ts").alias("start"), (F.col("event_id") % 4).cast("int").alias("duration_days"))
    return D.label_disrupted(t.events.select("event_id", "ts"), hits, lead_days=1).select("event_id", "label")


VIEWS["shipments"] = ((), "SELECT l_orderkey AS k1, l_partkey AS k2, l_suppkey AS k3, CAST(l_linenumber AS BIGINT) AS k4, l_shipdate AS ts FROM lineitem")


@query("shipment_disruption_labels", """WITH e AS (SELECT o_orderdate AS start, CAST(o_orderkey % 5 AS INT) AS days FROM orders WHERE o_totalprice > 499000)
    SELECT k1, k2, k3, k4, CAST(EXISTS (SELECT 1 FROM e WHERE s.ts BETWEEN e.start - INTERVAL 7 DAY AND e.start + to_days(e.days)) AS BIGINT) AS label FROM shipments s""", uses="shipments")
def shipment_disruption_labels(t):
    hits = t.orders.where("o_totalprice > 499000").select(F.col("o_orderdate").alias("start"), (F.col("o_orderkey") % 5).cast("int").alias("duration_days"))
    rows = t.lineitem.selectExpr("l_orderkey AS k1", "l_partkey AS k2", "l_suppkey AS k3", "l_linenumber AS k4", "l_shipdate AS ts")
    return D.label_disrupted(rows, hits).drop("ts")


@query("location_day_features", """WITH a AS (SELECT n_name AS location, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS day, count(*) AS orders, sum(o_totalprice) AS booked
        FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL),
    b AS (SELECT n_name AS location, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS day, count(*) AS shipments, avg(l_quantity) AS mean_quantity
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL)
    SELECT location, day, orders, booked, shipments, mean_quantity FROM a FULL JOIN b USING (location, day)""", rnd="booked mean_quantity", places=2)
def location_day_features(t):
    def place(key):
        return t.nation.select(F.col("n_nationkey").alias(key), F.col("n_name").alias("location"))

    def day(c):
        return F.to_date(c).cast("timestamp_ntz").alias("day")

    orders = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(place("c_nationkey"), "c_nationkey"), "o_custkey")
    booked = orders.groupBy("location", day("o_orderdate")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("booked"))
    lines = t.lineitem.join(t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey").join(place("s_nationkey"), "s_nationkey"), "l_suppkey")
    shipped = lines.groupBy("location", day("l_shipdate")).agg(F.count("*").alias("shipments"), F.avg("l_quantity").alias("mean_quantity"))
    return booked.join(shipped, ["location", "day"], "full")


@query("training_set", """WITH p AS (SELECT port_name AS location, ts, throughput, berth_utilization FROM port_metrics WHERE ts >= TIMESTAMP '2001-08-01' - INTERVAL 730 DAY AND ts <= TIMESTAMP '2001-08-01'),
    f AS (SELECT origin AS location, date_trunc('month', ts) AS ts, avg(rate_40ft) AS mean_rate, count(*) AS n FROM lane_rates
        WHERE ts >= TIMESTAMP '2001-08-01' - INTERVAL 730 DAY AND ts <= TIMESTAMP '2001-08-01' GROUP BY ALL)
    SELECT location, ts, throughput, berth_utilization, mean_rate, n FROM p FULL JOIN f USING (location, ts)""", uses="port_metrics lane_rates", rnd="throughput berth_utilization mean_rate", places=3)
def training_set(t):
    ports = freight.since(t.port_metrics, "2001-08-01 00:00:00", 730).select(F.col("port_name").alias("location"), "ts", "throughput", "berth_utilization")
    rates = freight.since(t.lane_rates, "2001-08-01 00:00:00", 730).groupBy(
        F.col("origin").alias("location"), F.date_trunc("month", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("rate_40ft").alias("mean_rate"), F.count("*").alias("n"))
    return ports.join(rates, ["location", "ts"], "full")


# --- sectors ----------------------------------------------------------------

CAPS = "caps AS (SELECT sector_code, sum(CAST(floor(market_cap) AS BIGINT)) / 1e9 AS market_cap FROM companies GROUP BY sector_code)"


def caps(t):
    return t.companies.groupBy("sector_code").agg(
        (F.sum(F.floor("market_cap").cast("bigint")) / 1e9).alias("market_cap"))


DEPEND = """dep AS (SELECT s.sector_code, CASE WHEN i.n IS NULL AND o.n IS NULL THEN 0.3 ELSE least(1.0, coalesce(i.w, 0) * 0.6 + coalesce(o.n, 0) / 11.0 * 0.4) END AS dependency
    FROM sectors s LEFT JOIN (SELECT dst, count(*) AS n, avg(weight) AS w FROM edges GROUP BY dst) i ON i.dst = s.sector_code
    LEFT JOIN (SELECT src, count(*) AS n FROM edges GROUP BY src) o ON o.src = s.sector_code)"""


def _mitigation() -> str:
    quoted = {k: "', '".join(v) for k, v in dims.MITIGATION.items()}
    own = " ".join(f"WHEN '{k}' THEN ['{v}']" for k, v in quoted.items())
    default = "', '".join(dims.MITIGATION_DEFAULT)
    extra = ", ".join(f"CASE WHEN contains(fs, '{k}') THEN '{x}' END" for k, x in dims.MITIGATION_BY_RISK)
    return f"array_to_string(list_slice(list_concat(CASE sector {own} ELSE ['{default}'] END, list_filter([{extra}], lambda x: x IS NOT NULL)), 1, 5), '; ')"


SECTOR = f"""WITH {CAPS}, {DEPEND}, b AS (SELECT d.scenario, s.sector_code, d.disruption_type, d.location, d.start_in_days AS days, d.probability * d.severity_score AS w,
        coalesce(v.sensitivity, 0.3) AS sens FROM disruptions d CROSS JOIN sectors s LEFT JOIN sensitivity v ON v.sector_code = s.sector_code AND v.disruption_type = d.disruption_type),
    g AS (SELECT scenario, sector_code, coalesce(sum(w * sens) FILTER (days <= 0), 0) AS cur, coalesce(sum(w * sens * 0.8) FILTER (days > 0 AND days <= 7), 0) AS wk,
        coalesce(sum(w * sens * 0.6) FILTER (days > 7 AND days <= 30), 0) AS mo, count(DISTINCT disruption_type) AS types FROM b GROUP BY ALL),
    r AS (SELECT scenario, sector_code, concat(disruption_type, ' at ', location) AS label, row_number() OVER (PARTITION BY scenario, sector_code ORDER BY w DESC, location, disruption_type) AS rn FROM b WHERE w * sens > 2),
    f AS (SELECT scenario, sector_code, string_agg(label, '; ' ORDER BY rn) AS fs FROM r WHERE rn <= 5 GROUP BY ALL),
    m AS (SELECT sector_code, avg(sensitivity) AS ms FROM sensitivity GROUP BY ALL),
    x AS (SELECT g.scenario, g.sector_code, s.sector, s.recovery, ms * 4 + dependency * 3 + least(3, types) AS vul, least(10.0, greatest(-10.0, cur - 5)) AS cur, least(10.0, greatest(-10.0, wk - 3)) AS wk,
        least(10.0, greatest(-10.0, mo - 2)) AS mo, dependency, coalesce(fs, '') AS fs, coalesce(market_cap, 100) AS cap
        FROM g JOIN sectors s USING (sector_code) JOIN m USING (sector_code) JOIN dep USING (sector_code) LEFT JOIN caps ON caps.sector_code = g.sector_code LEFT JOIN f ON f.scenario = g.scenario AND f.sector_code = g.sector_code)
    SELECT scenario, sector_code, sector, vul AS vulnerability_score, cur AS current_impact, wk AS predicted_impact_7d, mo AS predicted_impact_30d, dependency AS supply_chain_dependency,
        fs AS key_risk_factors, CAST(greatest(10, trunc(vul * 20)) AS BIGINT) AS affected_companies_count, cap * abs(mo) / 100 AS market_cap_at_risk,
        CAST(greatest(7, trunc(recovery * (1 + (vul - 5) * 0.2))) AS BIGINT) AS recovery_time_estimate, {_mitigation()} AS mitigation_strategies FROM x"""
SECTOR_USES = "companies disruptions sectors sensitivity edges"
SECTOR_RND = "vulnerability_score current_impact predicted_impact_7d predicted_impact_30d supply_chain_dependency market_cap_at_risk"


def _sector(t):
    return S.sector_impact(t.disruptions, t.sectors, t.sensitivity, t.edges, caps(t))


@query("sector_impact", SECTOR, uses=SECTOR_USES, rnd=SECTOR_RND)
def sector_impact(t):
    return _sector(t).withColumns({c: j(c, "; ") for c in ("key_risk_factors", "mitigation_strategies")})


@query("sectors_by_vulnerability", f"SELECT scenario, sector, vulnerability_score FROM ({SECTOR}) ORDER BY vulnerability_score DESC, scenario, sector", uses=SECTOR_USES, rnd="vulnerability_score")
def sectors_by_vulnerability(t):
    return _sector(t).select("scenario", "sector", "vulnerability_score").orderBy(F.col("vulnerability_score").desc(), "scenario", "sector")


@query("sector_report", f"""WITH s AS ({SECTOR}), u AS (SELECT DISTINCT scenario, unnest(string_split(key_risk_factors, '; ')) AS f FROM s WHERE key_risk_factors <> ''),
    n AS (SELECT scenario, f, row_number() OVER (PARTITION BY scenario ORDER BY f) AS rn FROM u), l AS (SELECT scenario, string_agg(f, '; ' ORDER BY rn) AS fs FROM n WHERE rn <= 10 GROUP BY scenario)
    SELECT s.scenario, avg(vulnerability_score) AS mean_vulnerability, arg_max(sector, round(vulnerability_score, 9)) AS most_vulnerable, arg_min(sector, round(vulnerability_score, 9)) AS least_vulnerable,
    count(*) FILTER (predicted_impact_30d < -2) AS negative, count(*) FILTER (predicted_impact_30d > 1) AS positive, count(*) FILTER (vulnerability_score > 7) AS high_risk,
    sum(market_cap_at_risk) AS cap_at_risk, avg(recovery_time_estimate) AS mean_recovery, coalesce(any_value(fs), '') AS risk_factors FROM s LEFT JOIN l ON l.scenario = s.scenario GROUP BY s.scenario""",
       uses=SECTOR_USES, rnd="mean_vulnerability cap_at_risk mean_recovery", places=4)
def sector_report(t):
    return S.sector_report(_sector(t))


PAIRS_IN = " OR ".join(f"(src = '{a}' AND dst = '{b}') OR (src = '{b}' AND dst = '{a}')" for a, b in dims.CORRELATED)


def cross_sql(src: str) -> str:
    return f"""SELECT scenario, src AS source_code, dst AS target_code, abs(current_impact * weight * 0.7) / 10 AS impact_strength,
        CAST(greatest(1, trunc(coalesce(delay, 5) * (2 - weight))) AS BIGINT) AS propagation_delay, 'supply' AS impact_type, weight * 0.8 AS confidence_level,
        CASE WHEN {PAIRS_IN} THEN 0.7 ELSE weight * 0.7 END AS historical_correlation
        FROM {src} i JOIN edges ON src = i.sector_code JOIN sectors t ON t.sector_code = dst WHERE abs(current_impact) > 1 AND weight > 0.3 AND abs(current_impact * weight * 0.7) > 0.5"""


CROSS_RND = "impact_strength confidence_level historical_correlation"


@query("cross_sector_impact", cross_sql("sector_impacts"), uses="sector_impacts edges sectors", rnd=CROSS_RND)
def cross_sector_impact(t):
    return S.propagate(t.sector_impacts, t.sectors, t.edges)


@query("cross_sector_impact_predicted", cross_sql(f"({SECTOR})"), uses=SECTOR_USES, rnd=CROSS_RND)
def cross_sector_impact_predicted(t):
    return S.propagate(_sector(t), t.sectors, t.edges)


@query("cross_impacts_by_strength", f"SELECT scenario, source_code, target_code, impact_strength FROM ({cross_sql('sector_impacts')}) ORDER BY impact_strength DESC, scenario, source_code, target_code",
       uses="sector_impacts edges sectors", rnd="impact_strength")
def cross_impacts_by_strength(t):
    return cross_sector_impact(t).select("scenario", "source_code", "target_code", "impact_strength").orderBy(
        F.col("impact_strength").desc(), "scenario", "source_code", "target_code")


@query("sector_pair_correlation", f"""WITH p AS (SELECT CAST(10 + 5 * (o_custkey % 11) AS VARCHAR) AS src, CAST(10 + 5 * (o_orderkey % 11) AS VARCHAR) AS dst, count(*) AS orders FROM orders GROUP BY ALL)
    SELECT p.src, p.dst, orders, CASE WHEN {PAIRS_IN.replace('src', 'p.src').replace('dst', 'p.dst')} THEN 0.7 ELSE coalesce(f.weight * 0.7, r.weight * 0.7, 0.25) END AS correlation
    FROM p LEFT JOIN edges f ON f.src = p.src AND f.dst = p.dst LEFT JOIN edges r ON r.src = p.dst AND r.dst = p.src""", uses="edges", rnd="correlation")
def sector_pair_correlation(t):
    code = lambda c: (10 + 5 * (F.col(c) % 11)).cast("string")
    pairs = t.orders.groupBy(code("o_custkey").alias("src"), code("o_orderkey").alias("dst")).agg(F.count("*").alias("orders"))
    return S.pair_correlation(pairs, t.edges)


@query("dependency_scores", """WITH e AS (SELECT origin AS src, destination AS dst, (count(*) % 10 + 1) / 10.0 AS weight FROM lane_rates GROUP BY ALL HAVING count(*) % 10 + 1 > 5),
    i AS (SELECT dst AS node, count(*) AS n, avg(weight) AS w FROM e GROUP BY dst), o AS (SELECT src AS node, count(*) AS n FROM e GROUP BY src)
    SELECT n_name AS node, coalesce(i.n, 0) AS in_degree, coalesce(i.w, 0) AS mean_in, coalesce(o.n, 0) AS out_degree,
    CASE WHEN i.n IS NULL AND o.n IS NULL THEN 0.3 ELSE least(1.0, coalesce(i.w, 0) * 0.6 + coalesce(o.n, 0) / 25.0 * 0.4) END AS dependency
    FROM nation LEFT JOIN i ON i.node = n_name LEFT JOIN o ON o.node = n_name""", uses="lane_rates", rnd="mean_in dependency")
def dependency_scores(t):
    g = t.lane_rates.groupBy(F.col("origin").alias("src"), F.col("destination").alias("dst")).agg(F.count("*").alias("n")).where("n % 10 + 1 > 5")
    edges = g.select("src", "dst", ((F.col("n") % 10 + 1) / 10.0).alias("weight"))
    return S.dependency_scores(edges, 25, t.nation.select(F.col("n_name").alias("node")))


def _one_place(value):
    """SQL text of a double to one place: its shortest decimal form, ties away from zero."""
    return f"CAST(CAST(round(CAST(CAST({value} AS VARCHAR) AS DECIMAL(30, 18)), 1) AS DECIMAL(30, 1)) AS VARCHAR)"


UNDER = """SELECT scenario, 'underweight' AS signal_type, sector AS source_sector, '' AS target_sector, least(1.0, abs(predicted_impact_30d) / 10) AS strength,
    predicted_impact_30d AS expected_return, CASE WHEN vulnerability_score > 7 THEN 'high' ELSE 'medium' END AS risk_level, CAST(0.7 AS DOUBLE) AS confidence,
    'High vulnerability to supply chain disruptions (score: ' || """ + _one_place("vulnerability_score") + """ || ')' AS rationale FROM sector_impacts WHERE predicted_impact_30d < -3"""
OVER = f"""SELECT s.scenario, 'overweight' AS signal_type, '' AS source_sector, sector AS target_sector, least(1.0, (coalesce(gain, 0) + (5 - vulnerability_score) / 5) / 2) AS strength,
    greatest(2.0, 5 - vulnerability_score) AS expected_return, CASE WHEN vulnerability_score < 3 THEN 'low' ELSE 'medium' END AS risk_level, 0.6 + coalesce(gain, 0) * 0.2 AS confidence,
    'Low supply chain vulnerability and potential beneficiary of disruptions' AS rationale FROM sector_impacts s LEFT JOIN (SELECT c.scenario, target_code, sum(impact_strength) AS gain FROM ({cross_sql('sector_impacts')}) c JOIN sector_impacts q
        ON q.scenario = c.scenario AND q.sector_code = c.source_code AND q.predicted_impact_30d < -2 WHERE impact_strength > 0.3 GROUP BY ALL) g
        ON g.scenario = s.scenario AND g.target_code = s.sector_code
    WHERE vulnerability_score < 4 AND predicted_impact_30d > -1 AND (coalesce(gain, 0) > 0.3 OR vulnerability_score < 3)"""
PAIR = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY predicted_impact_30d, sector) AS lo, row_number() OVER (PARTITION BY scenario ORDER BY predicted_impact_30d DESC, sector DESC) AS hi FROM sector_impacts)
    SELECT w.scenario, 'pair_trade' AS signal_type, w.sector AS source_sector, b.sector AS target_sector, least(1.0, (b.predicted_impact_30d - w.predicted_impact_30d) / 10) AS strength,
    b.predicted_impact_30d - w.predicted_impact_30d AS expected_return, 'medium' AS risk_level, CAST(0.6 AS DOUBLE) AS confidence,
    'Pair trade: Short ' || w.sector || ' (impact: ' || {_one_place("w.predicted_impact_30d")} || '), Long ' || b.sector || ' (impact: ' || {_one_place("b.predicted_impact_30d")} || ')' AS rationale
    FROM r w JOIN r b ON b.scenario = w.scenario AND b.sector <> w.sector AND b.predicted_impact_30d - w.predicted_impact_30d > 3 WHERE w.lo <= 3 AND b.hi <= 3"""
SIG_USES, SIG_RND = "sector_impacts edges sectors", "strength expected_return confidence"


@query("underweight_signals", UNDER, uses=SIG_USES, rnd=SIG_RND)
def underweight_signals(t):
    return S.underweight_signals(t.sector_impacts)


@query("overweight_signals", OVER, uses=SIG_USES, rnd=SIG_RND)
def overweight_signals(t):
    return S.overweight_signals(t.sector_impacts, cross_sector_impact(t))


@query("pair_trades", PAIR, uses=SIG_USES, rnd=SIG_RND)
def pair_trades(t):
    return S.pair_trades(t.sector_impacts)


ROTATION = f"{UNDER} UNION ALL {OVER} UNION ALL SELECT * FROM ({PAIR})"


@query("rotation_signals", f"SELECT * FROM ({ROTATION}) ORDER BY strength * confidence DESC", uses=SIG_USES, rnd=SIG_RND)
def rotation_signals(t):
    return S.rotation_signals(t.sector_impacts, cross_sector_impact(t))


@query("signal_rationale", f"SELECT scenario, source_sector, target_sector, rationale FROM ({PAIR})", uses=SIG_USES)
def signal_rationale(t):
    return S.pair_trades(t.sector_impacts).select("scenario", "source_sector", "target_sector", "rationale")


SDG_VALUES = ", ".join(f"('{k}', [{', '.join(map(str, g))}])" for k, g in dims.SDG.items())


@query("sdg_goals", f"""SELECT goal::BIGINT AS goal, count(*) AS companies FROM (SELECT unnest(goals) AS goal FROM customer JOIN (SELECT activity, goals, row_number() OVER () - 1 AS i
    FROM (VALUES {SDG_VALUES}) AS v(activity, goals)) ON i = c_custkey % {len(dims.SDG)}) GROUP BY goal""")
def sdg_goals(t):
    names = F.array(*[F.lit(k) for k in dims.SDG])
    rows = t.customer.select(F.element_at(names, (F.col("c_custkey") % len(dims.SDG) + 1).cast("int")).alias("activity"))
    return S.sdg_links(rows, "activity").groupBy("goal").agg(F.count("*").alias("companies"))


@query("monthly_sector_impact", """WITH d AS (SELECT date_trunc('month', o_orderdate) AS month, ['port_congestion', 'route_blockage', 'rate_spike'][o_orderkey % 3 + 1] AS disruption_type, (o_orderkey % 11) / 10.0 AS p, (o_custkey % 10) / 1.0 AS s FROM orders)
    SELECT month, v.sector_code, sum(p * s * sensitivity) AS impact FROM d JOIN sensitivity v USING (disruption_type) GROUP BY ALL""", uses="sensitivity", rnd="impact", places=4)
def monthly_sector_impact(t):
    return S.monthly_impact(_order_disruptions(t), t.sensitivity)


def _order_disruptions(t):
    kinds = F.array(*[F.lit(k) for k in ("port_congestion", "route_blockage", "rate_spike")])
    return t.orders.select(
        F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month"),
        F.element_at(kinds, (F.col("o_orderkey") % 3 + 1).cast("int")).alias("disruption_type"),
        (F.col("o_orderkey") % 11 / 10.0).alias("probability"), (F.col("o_custkey") % 10 / 1.0).alias("severity_score"))


@query("impact_correlation_change", """WITH d AS (SELECT date_trunc('month', o_orderdate) AS month, ['port_congestion', 'route_blockage', 'rate_spike'][o_orderkey % 3 + 1] AS disruption_type, (o_orderkey % 11) / 10.0 AS p, (o_custkey % 10) / 1.0 AS s FROM orders),
    m AS (SELECT month, v.sector_code, sum(p * s * sensitivity) AS impact FROM d JOIN sensitivity v USING (disruption_type) GROUP BY ALL),
    h AS (SELECT a.sector_code AS "left", b.sector_code AS "right", corr(a.impact, b.impact) FILTER (a.month < TIMESTAMP '1998-04-01') AS first_half,
        corr(a.impact, b.impact) FILTER (a.month >= TIMESTAMP '1998-04-01') AS second_half FROM m a JOIN m b ON a.month = b.month AND a.sector_code < b.sector_code GROUP BY ALL)
    SELECT *, second_half - first_half AS change FROM h""", uses="sensitivity", rnd="first_half second_half change")
def impact_correlation_change(t):
    """Correlation of the monthly impacts of every pair of sectors, before and after a date; a month has one row per sector."""
    monthly = S.monthly_impact(_order_disruptions(t), t.sensitivity)
    early = F.col("month") < F.lit("1998-04-01 00:00:00").cast("timestamp_ntz")
    pairs = monthly.toDF(*[{"sector_code": "left", "impact": "a"}.get(c, c) for c in monthly.columns]).join(
        monthly.toDF(*[{"sector_code": "right", "impact": "b"}.get(c, c) for c in monthly.columns]), "month").where("left < right")
    halves = pairs.groupBy("left", "right").agg(
        F.corr(F.when(early, F.col("a")), F.when(early, F.col("b"))).alias("first_half"), F.corr(F.when(~early, F.col("a")), F.when(~early, F.col("b"))).alias("second_half"))
    return halves.withColumn("change", F.col("second_half") - F.col("first_half"))
