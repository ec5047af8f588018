"""Streaming queries, each drained once and compared with its batch twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tradewind.catalog.domain import AREA_JOIN, CONGESTION
from tradewind.catalog.registry import query
from tradewind.session import checkpointed
from tradewind.sources.adapters import VESSELS, _select
from tradewind.sources.versions import VersionedTable
from tradewind.streaming import live


def events(t):
    return live.read_files(t.spark, t.dir, "events.parquet")


@query("stream_area_congestion", f"""SELECT area, date_trunc('hour', v.ts) AS hour, count(mmsi) AS vessel_count, avg(speed) AS avg_speed, {CONGESTION} AS congestion {AREA_JOIN}
    WHERE mmsi IS NOT NULL GROUP BY area, date_trunc('hour', v.ts)""", uses="areas vessel_positions", rnd="avg_speed congestion")
def stream_area_congestion(t):
    positions = events(t).selectExpr(*_select(VESSELS))
    return live.run_once(live.hourly_congestion(positions), "complete")


@query("stream_closed_windows", f"""SELECT area, date_trunc('hour', v.ts) AS hour, count(mmsi) AS vessel_count, avg(speed) AS avg_speed, {CONGESTION} AS congestion {AREA_JOIN}
    WHERE mmsi IS NOT NULL GROUP BY area, date_trunc('hour', v.ts) HAVING date_trunc('hour', v.ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""",
       uses="areas vessel_positions", rnd="avg_speed congestion")
def stream_closed_windows(t):
    positions = events(t).selectExpr(*_select(VESSELS))
    return live.run_once(live.hourly_congestion(positions))


@query("stream_drop_repeats", "SELECT user_id, count(*) > 0 AS seen FROM events GROUP BY user_id")
def stream_drop_repeats(t):
    rows = events(t).select("user_id", "ts")
    first = live.run_once(live.drop_repeats(rows, ["user_id"], delay="60 days"))
    return first.groupBy("user_id").agg((F.count("*") == 1).alias("seen"))


VOL = """CASE WHEN count(*) < 2 OR count(nullif(value, 0)) = 0 THEN 0.2 WHEN avg(nullif(value, 0)) <= 0 THEN 0.0 ELSE least(1.0, stddev_pop(nullif(value, 0)) / avg(nullif(value, 0))) END"""


@query("stream_sliding_volatility", f"""SELECT window_start, event_type, count(*) AS n_rates, avg(nullif(value, 0)) AS mean_rate, {VOL} AS volatility
    FROM (SELECT *, date_trunc('day', ts) - to_days(CAST(i AS INT)) AS window_start FROM events, range(0, 30) AS r(i)) GROUP BY window_start, event_type""", rnd="mean_rate volatility")
def stream_sliding_volatility(t):
    rates = events(t).select("ts", "event_type", F.col("value").alias("rate_40ft"))
    return live.run_once(live.sliding_volatility(rates, ["event_type"]), "complete")


def by_days(t, batches: int = 4):
    """The events as a feed of several files that come in the order of their days, one a batch."""
    root = live.shared_folder(t.spark)
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    for k in range(batches):
        low, high = (F.lit(31 * x // batches) for x in (k, k + 1))
        t.events.where((day >= low if k else F.lit(True)) & (day < high if k + 1 < batches else F.lit(True))).coalesce(1).write.mode("append").parquet(f"{root}/feed")
    return live.read_files(t.spark, f"{root}/feed", "*.parquet", per_trigger=1)


@query("stream_closed_volatility", f"""SELECT * FROM (SELECT window_start, event_type, count(*) AS n_rates, avg(nullif(value, 0)) AS mean_rate, {VOL} AS volatility
    FROM (SELECT *, date_trunc('day', ts) - to_days(CAST(i AS INT)) AS window_start FROM events, range(0, 7) AS r(i)) GROUP BY window_start, event_type)
    WHERE window_start + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY""", rnd="mean_rate volatility", places=5)
def stream_closed_volatility(t):
    rates = by_days(t).select("ts", "event_type", F.col("value").alias("rate_40ft"))
    return live.run_once(live.closed_volatility(rates, ["event_type"], days=7))


@query("stream_alerts", """SELECT event_id, list_avg([least(value / 48.0, 1.0), least(event_id % 30 / 20.0, 1.0)]) AS congestion_index FROM events
    WHERE list_avg([least(value / 48.0, 1.0), least(event_id % 30 / 20.0, 1.0)]) > 0.7""", rnd="congestion_index")
def stream_alerts(t):
    none = F.lit(None).cast("double")
    metrics = events(t).select(
        "event_id", none.alias("berth_utilization"), F.col("value").alias("avg_waiting_time"), (F.col("event_id") % 30).alias("queue_length"),
        none.alias("storage_utilization"))
    return live.run_once(live.congestion_alerts(metrics).select("event_id", "congestion_index"))


@query("stream_upsert", """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def stream_upsert(t):
    return _upserted(t, events(t))


def _upserted(t, feed):
    root = live.shared_folder(t.spark)
    updates = feed.select("user_id", "event_id", "ts", "value")
    table = VersionedTable(t.spark, f"{root}/table", ["user_id"], ["ts", "event_id"], updates.schema)
    live.upsert_into(updates, table).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return table.read().select("user_id", "event_id", "value")


@query("stream_upsert_out_of_order", """SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def stream_upsert_out_of_order(t):
    """Three files, one a batch, the latest rows first: a batch of older rows must not replace newer ones."""
    root = live.shared_folder(t.spark)
    third = F.ntile(3).over(Window.partitionBy(F.pmod("event_id", F.lit(8))).orderBy(F.desc("ts")))
    parts = checkpointed(t.events.withColumn("part", third))
    for part in (1, 2, 3):
        parts.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{root}/feed")
    return _upserted(t, live.read_files(t.spark, f"{root}/feed", "*.parquet", per_trigger=1))


@query("stream_fresh_prices", """SELECT s.event_id, p.event_id AS price_id, p.value AS price FROM events s JOIN events p ON p.user_id = s.user_id AND p.ts BETWEEN s.ts - INTERVAL 5 MINUTE AND s.ts
    WHERE s.event_type = 'click' AND p.event_type = 'view'""")
def stream_fresh_prices(t):
    signals = events(t).where("event_type = 'click'").select(F.col("user_id").alias("symbol"), "ts", "event_id")
    prices = events(t).where("event_type = 'view'").select(
        F.col("user_id").alias("symbol"), "ts", F.struct("event_id", "value").alias("price"))
    out = live.fresh_prices(signals, prices)
    return live.run_once(out.select("event_id", F.col("price.event_id").alias("price_id"), F.col("price.value").alias("price")))
