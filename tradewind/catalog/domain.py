"""Vessel, port and freight queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewind import dims
from tradewind.catalog.registry import query
from tradewind.operators import freight, ports, vessels
from tradewind.sources.adapters import RATES_AS_OF, RATES_DAYS, VIEWS, _values

WINDOW = f"ts >= TIMESTAMP '{RATES_AS_OF}' - INTERVAL {RATES_DAYS} DAY AND ts <= TIMESTAMP '{RATES_AS_OF}'"
VOL = """CASE WHEN count(*) < 2 OR count(nullif(rate_40ft, 0)) = 0 THEN 0.2
    WHEN avg(nullif(rate_40ft, 0)) <= 0 THEN 0.0
    ELSE least(1.0, stddev_pop(nullif(rate_40ft, 0)) / avg(nullif(rate_40ft, 0))) END"""

VIEWS["distances"] = ((), _values(dims.DISTANCES, "origin, destination, distance"))
VIEWS["lane_estimates"] = ((), _values(dims.LANE_ESTIMATES, "origin, destination, rate_40ft"))
VIEWS["port_names"] = ((), _values([(i, p[0], p[1], p[2]) for i, p in enumerate(dims.PORTS)], "port_id, port, lat, lon"))
# Port calls: every order is a call on the lane given by its customer and order key.
VIEWS["port_calls"] = (("port_names",), f"""
    SELECT o_orderkey, a.port AS origin, b.port AS destination, a.lat AS lat1, a.lon AS lon1, b.lat AS lat2, b.lon AS lon2
    FROM orders JOIN port_names a ON a.port_id = o_custkey % {len(dims.PORTS)}
    JOIN port_names b ON b.port_id = o_orderkey % {len(dims.PORTS)}""")


def port_calls(t):
    places = t.spark.createDataFrame(
        [(i, *p) for i, p in enumerate(dims.PORTS)], "port_id bigint, port string, lat double, lon double")
    a = places.toDF("_a", "origin", "lat1", "lon1")
    b = places.toDF("_b", "destination", "lat2", "lon2")
    n = len(dims.PORTS)
    keyed = t.orders.select("o_orderkey", (F.col("o_custkey") % n).alias("_a"), (F.col("o_orderkey") % n).alias("_b"))
    # the fixed ports alone are broadcast: their few keys would gather all orders in as few tasks
    return keyed.join(F.broadcast(a), "_a").join(F.broadcast(b), "_b").drop("_a", "_b")


@query("lane_volatility", f"""SELECT origin, destination, count(*) AS n_rates, avg(nullif(rate_40ft, 0)) AS mean_rate,
    {VOL} AS volatility FROM lane_rates WHERE {WINDOW} GROUP BY origin, destination""",
       uses="lane_rates", rnd="mean_rate volatility")
def lane_volatility(t):
    return freight.lane_volatility(t.lane_rates, RATES_AS_OF, RATES_DAYS)


@query("lane_volatility_30d", f"""SELECT origin, destination, count(*) AS n_rates, avg(nullif(rate_40ft, 0)) AS mean_rate,
    {VOL} AS volatility FROM lane_rates WHERE {WINDOW.replace('365', '30')} GROUP BY origin, destination""",
       uses="lane_rates", rnd="mean_rate volatility")
def lane_volatility_30d(t):
    return freight.lane_volatility(t.lane_rates, RATES_AS_OF)


@query("watched_lane_volatility", f"""WITH lanes AS (SELECT DISTINCT origin, destination FROM lane_rates),
    found AS (SELECT origin, destination, count(*) AS n_rates, avg(nullif(rate_40ft, 0)) AS mean_rate, {VOL} AS volatility
    FROM lane_rates WHERE {WINDOW.replace('365', '30')} GROUP BY origin, destination)
    SELECT origin, destination, coalesce(n_rates, 0) AS n_rates, mean_rate, coalesce(volatility, 0.2) AS volatility
    FROM lanes LEFT JOIN found USING (origin, destination)""", uses="lane_rates", rnd="mean_rate volatility")
def watched_lane_volatility(t):
    lanes = t.lane_rates.select("origin", "destination").distinct()  # every lane ever seen
    return freight.watched_lane_volatility(lanes, t.lane_rates, RATES_AS_OF)


@query("route_volatility_overall", f"""SELECT concat(origin, '-', destination) AS route, count(*) AS n_rates,
    avg(nullif(rate_40ft, 0)) AS mean_rate, {VOL} AS volatility FROM lane_rates WHERE {WINDOW} GROUP BY origin, destination
    UNION ALL SELECT 'overall', count(*), avg(nullif(rate_40ft, 0)), {VOL} FROM lane_rates WHERE {WINDOW}""",
       uses="lane_rates", rnd="mean_rate volatility")
def route_volatility_overall(t):
    return freight.route_volatility_with_total(t.lane_rates, RATES_AS_OF, RATES_DAYS)


@query("collection_summary_freight", f"""SELECT count(*) AS lanes, CAST(sum(n) AS BIGINT) AS rates,
    count(*) FILTER (volatility > 0.3) AS high_volatility, avg(volatility) AS mean_volatility FROM (
    SELECT count(*) AS n, {VOL} AS volatility FROM lane_rates WHERE {WINDOW} GROUP BY origin, destination)""",
       uses="lane_rates", rnd="mean_volatility")
def collection_summary_freight(t):
    return freight.collection_summary(freight.lane_volatility(t.lane_rates, RATES_AS_OF, RATES_DAYS))


@query("lane_trend", """SELECT origin, destination, regr_slope(rate_40ft, d) AS slope, regr_r2(rate_40ft, d) AS strength,
    count(*) AS n, CASE WHEN slope > 0 THEN 'up' WHEN slope < 0 THEN 'down' WHEN slope = 0 THEN 'flat' END AS direction
    FROM (SELECT *, CAST(date_diff('day', DATE '1995-01-01', CAST(ts AS DATE)) AS DOUBLE) AS d FROM lane_rates)
    GROUP BY origin, destination""", uses="lane_rates", rnd="slope strength")
def lane_trend(t):
    return freight.lane_trend(t.lane_rates)


@query("lane_seasonality", """SELECT origin, month(ts) AS month, avg(rate_40ft) AS mean_rate, count(*) AS n
    FROM lane_rates GROUP BY origin, month(ts)""", uses="lane_rates", rnd="mean_rate")
def lane_seasonality(t):
    return freight.seasonal_means(t.lane_rates)


@query("lane_forecast", """WITH d AS (SELECT *, CAST(date_diff('day', DATE '1995-01-01', CAST(ts AS DATE)) AS DOUBLE) AS x FROM lane_rates),
    fit AS (SELECT origin, destination, regr_slope(rate_40ft, x) AS b, regr_intercept(rate_40ft, x) AS a, count(*) AS n_fit,
        sqrt(greatest(0.0, var_pop(rate_40ft) * (1 - coalesce(regr_r2(rate_40ft, x), 0)))) AS dev
        FROM d WHERE ts <= TIMESTAMP '2000-06-30' GROUP BY origin, destination HAVING regr_slope(rate_40ft, x) IS NOT NULL),
    held AS (SELECT origin, destination, avg(abs((rate_40ft - (a + b * x)) / nullif(rate_40ft, 0))) AS mape
        FROM d JOIN fit USING (origin, destination) WHERE ts > TIMESTAMP '2000-06-30' GROUP BY origin, destination),
    steps AS (SELECT unnest(range(1, 4)) AS step),
    line AS (SELECT origin, destination, step, dev, n_fit,
        a + b * (date_diff('day', DATE '1995-01-01', DATE '2000-06-30') + step * 30) AS forecast FROM fit, steps)
    SELECT origin, destination, step, forecast, forecast - 1.96 * dev AS low, forecast + 1.96 * dev AS high, mape, n_fit
    FROM line LEFT JOIN held USING (origin, destination)""", uses="lane_rates", rnd="forecast low high mape", places=4)
def lane_forecast(t):
    return freight.lane_forecast(t.lane_rates, "2000-06-30 00:00:00", 3)


@query("rate_source_chain", """WITH lanes AS (SELECT DISTINCT origin, destination FROM port_calls),
    q AS (SELECT origin, destination, max(o_totalprice) AS r FROM port_calls JOIN orders USING (o_orderkey)
        WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' GROUP BY ALL HAVING max(o_totalprice) > 400000),
    s AS (SELECT origin, destination, min(o_totalprice) AS r FROM port_calls JOIN orders USING (o_orderkey)
        WHERE o_orderstatus = 'F' GROUP BY ALL HAVING min(o_totalprice) > 12000),
    j AS (SELECT origin, destination, q.r IS NOT NULL AS is_q, s.r IS NOT NULL AS is_s,
        coalesce(q.r, s.r, e.rate_40ft, 2000.0) AS rate_40ft
        FROM lanes LEFT JOIN q USING (origin, destination) LEFT JOIN s USING (origin, destination)
        LEFT JOIN lane_estimates e USING (origin, destination))
    SELECT origin, destination, CAST(rate_40ft AS DOUBLE) AS rate_40ft, rate_40ft * 0.6 AS rate_20ft, rate_40ft * 1.1 AS rate_40ft_hc,
        rate_40ft * CASE WHEN is_q OR is_s THEN 0.8 ELSE 0.75 END AS base_rate,
        rate_40ft * CASE WHEN is_q OR is_s THEN 0.15 ELSE 0.2 END AS bunker_surcharge,
        CAST(25 AS DOUBLE) AS security_surcharge,
        CASE WHEN is_q THEN 'quote' WHEN is_s THEN 'second' ELSE 'estimate' END AS source FROM j""",
       uses="port_calls lane_estimates", rnd="rate_40ft rate_20ft rate_40ft_hc base_rate bunker_surcharge", places=3)
def rate_source_chain(t):
    calls = port_calls(t)
    lanes = calls.select("origin", "destination").distinct()
    priced = calls.select("o_orderkey", "origin", "destination").join(t.orders, "o_orderkey")
    quotes = (
        priced.where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").groupBy("origin", "destination")
        .agg(F.max("o_totalprice").alias("m")).where("m > 400000")
        .select("origin", "destination", F.col("m").alias("rate_40ft")))
    second = (
        priced.where("o_orderstatus = 'F'").groupBy("origin", "destination").agg(F.min("o_totalprice").alias("m"))
        .where("m > 12000").select("origin", "destination", F.col("m").alias("rate_40ft")))
    estimates = dims.frame(t.spark, dims.LANE_ESTIMATES, "origin string, destination string, rate_40ft double")
    return freight.first_source(lanes, quotes, second, estimates)


@query("route_distance", """SELECT origin, destination, concat(origin, '-', destination) AS route_id, count(*) AS vessels,
    CAST(coalesce(max(distance), 5000.0) AS DOUBLE) AS distance_nm, coalesce(max(distance), 5000.0) / 15.0 AS transit_hours,
    CAST(0.5 AS DOUBLE) AS congestion_level, CAST(0.3 AS DOUBLE) AS risk_score
    FROM port_calls LEFT JOIN distances USING (origin, destination) GROUP BY origin, destination""",
       uses="port_calls distances", rnd="transit_hours")
def route_distance(t):
    routes = port_calls(t).groupBy("origin", "destination").agg(F.count("*").alias("vessels"))
    table = dims.frame(t.spark, dims.DISTANCES, "origin string, destination string, distance double")
    return vessels.route_distance(routes, table)


@query("great_circle_distance", """SELECT o_orderkey, 2 * 3440.065 * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2)
    + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))) AS distance_nm FROM port_calls""",
       uses="port_calls", rnd="distance_nm", places=4)
def great_circle_distance(t):
    c = F.col
    return port_calls(t).select(
        "o_orderkey", vessels.great_circle_nm(c("lat1"), c("lon1"), c("lat2"), c("lon2")).alias("distance_nm"))


AREA_JOIN = """FROM areas LEFT JOIN vessel_positions v ON latitude BETWEEN lat_lo AND lat_hi
    AND longitude BETWEEN lon_lo AND lon_hi"""
CONGESTION = """CASE WHEN coalesce(avg(speed), 0) < 5 THEN least(least(count(mmsi) / 50.0, 1.0) * 1.5, 1.0)
    ELSE least(count(mmsi) / 50.0, 1.0) END"""


@query("area_congestion", f"""SELECT area, count(mmsi) AS vessel_count, coalesce(avg(speed), 0) AS avg_speed,
    {CONGESTION} AS congestion {AREA_JOIN} GROUP BY area""", uses="areas vessel_positions", rnd="avg_speed congestion")
def area_congestion(t):
    areas = dims.frame(t.spark, dims.AREAS, "area string, lat_lo double, lat_hi double, lon_lo double, lon_hi double")
    return vessels.area_congestion(t.vessel_positions, areas)


@query("area_congestion_hourly", f"""SELECT area, date_trunc('hour', v.ts) AS hour, count(mmsi) AS vessel_count,
    avg(speed) AS avg_speed, {CONGESTION} AS congestion {AREA_JOIN} WHERE mmsi IS NOT NULL
    GROUP BY area, date_trunc('hour', v.ts)""", uses="areas vessel_positions", rnd="avg_speed congestion")
def area_congestion_hourly(t):
    areas = dims.frame(t.spark, dims.AREAS, "area string, lat_lo double, lat_hi double, lon_lo double, lon_hi double")
    hourly = t.vessel_positions.withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return vessels.area_congestion(hourly, areas, ["hour"]).where("vessel_count > 0")


@query("vessels_in_area", f"""SELECT area, mmsi, seq {AREA_JOIN} WHERE mmsi IS NOT NULL""", uses="areas vessel_positions")
def vessels_in_area(t):
    return t.vessel_positions.select(F.explode(vessels.area_of()).alias("area"), "mmsi", "seq")


@query("collection_summary_vessels", f"""SELECT count(*) AS areas, CAST(sum(n) AS BIGINT) AS vessels,
    count(*) FILTER (c > 0.7) AS congested FROM (SELECT count(mmsi) AS n, {CONGESTION} AS c {AREA_JOIN} GROUP BY area)""",
       uses="areas vessel_positions")
def collection_summary_vessels(t):
    return area_congestion(t).agg(
        F.count("*").alias("areas"), F.sum("vessel_count").alias("vessels"),
        F.count_if(F.col("congestion") > 0.7).alias("congested"))


@query("valid_positions", """SELECT seq, mmsi, latitude, longitude, speed FROM vessel_positions WHERE latitude BETWEEN -90 AND 90
    AND longitude BETWEEN -180 AND 180 AND speed >= 0 AND length(CAST(mmsi AS VARCHAR)) > 0 AND length(vessel_name) > 0""",
       uses="vessel_positions", rnd="latitude longitude speed")
def valid_positions(t):
    return t.vessel_positions.where(vessels.valid_position()).select("seq", "mmsi", "latitude", "longitude", "speed")


@query("vessel_dedup_first_feed", """SELECT mmsi, CAST(source AS BIGINT) AS source, seq, latitude FROM (SELECT *, row_number() OVER (
    PARTITION BY mmsi ORDER BY source, seq) AS rn FROM vessel_positions) WHERE rn = 1""",
       uses="vessel_positions", rnd="latitude")
def vessel_dedup_first_feed(t):
    rows = t.vessel_positions.select("mmsi", "source", "seq", "latitude")
    return vessels.keep_first(rows, ["mmsi"], ["source", "seq"])


@query("latest_position", """SELECT mmsi, ts, seq, latitude, longitude FROM (SELECT *, row_number() OVER (
    PARTITION BY mmsi ORDER BY ts DESC, seq DESC) AS rn FROM vessel_positions) WHERE rn = 1""",
       uses="vessel_positions", rnd="latitude longitude")
def latest_position(t):
    rows = t.vessel_positions.select("mmsi", "ts", "seq", "latitude", "longitude")
    return vessels.latest(rows, ["mmsi"], ["ts", "seq"])


@query("vessel_selection", """SELECT seq, mmsi, vessel_type, ts FROM vessel_positions WHERE vessel_type IN ('view', 'click')
    AND latitude BETWEEN 0 AND 35 AND longitude BETWEEN 20 AND 110
    AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""", uses="vessel_positions")
def vessel_selection(t):
    return vessels.select_vessels(
        t.vessel_positions, ["view", "click"], (0, 35, 20, 110), "2024-01-05 00:00:00", "2024-01-20 00:00:00"
    ).select("seq", "mmsi", "vessel_type", "ts")


@query("route_selection_by_ports", """SELECT origin, destination, count(*) AS calls FROM port_calls
    WHERE origin IN ('Shanghai', 'Singapore', 'Busan') AND destination IN ('Los Angeles', 'Rotterdam') GROUP BY ALL""",
       uses="port_calls")
def route_selection_by_ports(t):
    calls = port_calls(t)
    return calls.where(
        F.col("origin").isin("Shanghai", "Singapore", "Busan") & F.col("destination").isin("Los Angeles", "Rotterdam")
    ).groupBy("origin", "destination").agg(F.count("*").alias("calls"))


INDEX = """coalesce(list_avg(list_filter([berth_utilization, least(avg_waiting_time / 48.0, CASE WHEN avg_waiting_time IS NULL THEN NULL ELSE 1.0 END),
    CASE WHEN queue_length IS NULL THEN NULL ELSE least(queue_length / 20.0, 1.0) END, storage_utilization], lambda x: x IS NOT NULL)), 0.5)"""
INDEX = INDEX.replace("least(avg_waiting_time / 48.0, CASE WHEN avg_waiting_time IS NULL THEN NULL ELSE 1.0 END)",
                      "CASE WHEN avg_waiting_time IS NULL THEN NULL ELSE least(avg_waiting_time / 48.0, 1.0) END")


@query("port_congestion_index", f"SELECT port_name, ts, {INDEX} AS congestion_index FROM port_metrics",
       uses="port_metrics", rnd="congestion_index")
def port_congestion_index(t):
    return t.port_metrics.select("port_name", "ts", ports.congestion_index().alias("congestion_index"))


@query("port_congestion_alerts", f"""SELECT * FROM (SELECT port_name, ts, {INDEX} AS congestion_index FROM port_metrics)
    WHERE congestion_index > 0.7""", uses="port_metrics", rnd="congestion_index")
def port_congestion_alerts(t):
    return ports.alerts(port_congestion_index(t))


@query("collection_summary_ports", f"""SELECT count(DISTINCT port_name) AS ports, count(*) AS records,
    count(*) FILTER (c > 0.7) AS congested FROM (SELECT port_name, {INDEX} AS c FROM port_metrics)""", uses="port_metrics")
def collection_summary_ports(t):
    return port_congestion_index(t).agg(
        F.count_distinct("port_name").alias("ports"), F.count("*").alias("records"),
        F.count_if(F.col("congestion_index") > 0.7).alias("congested"))


@query("port_efficiency_trend", """SELECT port_name, avg(throughput) AS mean_value, count(throughput) AS n,
    regr_slope(throughput, CAST(date_diff('day', DATE '1997-01-01', CAST(ts AS DATE)) AS DOUBLE)) AS slope
    FROM port_metrics WHERE ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-12-31' GROUP BY port_name""",
       uses="port_metrics", rnd="mean_value slope", places=4)
def port_efficiency_trend(t):
    return ports.efficiency_trend(t.port_metrics, "throughput", "1997-01-01 00:00:00", "1998-12-31 00:00:00")


@query("terminal_capacity_share", f"""WITH terminals AS ({_values(dims.TERMINALS, 'terminal_name, port_name, operator, capacity, berths, cranes')})
    SELECT terminal_name, operator, n AS calls, n / capacity * 1000000 AS calls_per_million_teu,
        CAST(berths AS BIGINT) AS berth_count, CAST(cranes AS BIGINT) AS crane_count FROM terminals
    LEFT JOIN (SELECT destination, count(*) AS n FROM port_calls GROUP BY destination) ON port_name = concat('Port of ', destination)""",
       uses="port_calls", rnd="calls_per_million_teu")
def terminal_capacity_share(t):
    calls = port_calls(t).groupBy(F.concat(F.lit("Port of "), F.col("destination")).alias("port_name")).agg(
        F.count("*").alias("calls"))
    return ports.terminals(t.spark).join(calls, "port_name", "left").select(
        "terminal_name", "operator", "calls",
        (F.col("calls") / F.col("capacity_teu") * 1000000).alias("calls_per_million_teu"), "berth_count", "crane_count")
