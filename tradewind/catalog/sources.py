"""Table, feed, text and operational-log queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tradewind import dims
from tradewind.catalog.registry import query
from tradewind.operators import freight, oplog
from tradewind.sources import feeds, table_ops
from tradewind.session import shared_folder
from tradewind.sources.adapters import EVENTS_AS_OF, VIEWS
from tradewind.sources.versions import VersionedTable


@query("table_query", """SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice >= 100000
    AND o_totalprice < 400000 AND o_orderpriority <> '5-LOW' ORDER BY o_orderdate ASC, o_totalprice DESC, o_orderkey ASC LIMIT 100 OFFSET 20""")
def table_query(t):
    return table_ops.query_table(
        t.orders,
        {"o_orderstatus": {"$in": ["F", "P"]}, "o_totalprice": {"$gte": 100000, "$lt": 400000}, "o_orderpriority": {"$ne": "5-LOW"}},
        ["o_orderkey", "o_totalprice", "o_orderdate"], [("o_orderdate", 1), ("o_totalprice", -1), ("o_orderkey", 1)], 100, 20)


@query("predicate_operators", """SELECT c_custkey, c_mktsegment, c_nationkey::BIGINT AS c_nationkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'FURNITURE')
    AND c_acctbal > 0 AND c_acctbal <= 5000 AND c_nationkey = 7""")
def predicate_operators(t):
    return table_ops.query_table(
        t.customer, {"c_mktsegment": {"$nin": ["BUILDING", "FURNITURE"]}, "c_acctbal": {"$gt": 0, "$lte": 5000}, "c_nationkey": {"$odd": 7}},
        ["c_custkey", "c_mktsegment", "c_nationkey"])


@query("sorted_table", "SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
def sorted_table(t):
    return table_ops.query_table(t.supplier, projection=["s_suppkey", "s_name", "s_acctbal"], sort=[("s_acctbal", -1), ("s_suppkey", 1)])


@query("paged_table", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 50 OFFSET 150")
def paged_table(t):
    return table_ops.query_table(t.part, None, ["p_partkey", "p_name"], [("p_partkey", 1)], 50, 150)


@query("parametrised_sql", """SELECT o_orderpriority, count(*) AS orders, sum(o_totalprice) AS total FROM orders
    WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_totalprice > 200000 GROUP BY o_orderpriority""", rnd="total", places=1)
def parametrised_sql(t):
    return table_ops.query_text(
        t.spark, """SELECT o_orderpriority, count(*) AS orders, sum(o_totalprice) AS total FROM {orders}
        WHERE o_orderdate >= CAST(:since AS TIMESTAMP_NTZ) AND o_totalprice > :floor GROUP BY o_orderpriority""",
        {"since": "1997-01-01 00:00:00", "floor": 200000}, orders=t.orders)


@query("recent_window", f"""SELECT event_id, ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 24 HOUR AS last_day, ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 7 DAY AS last_week
    FROM events WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 14 DAY""")
def recent_window(t):
    as_of = F.lit(EVENTS_AS_OF).cast("timestamp_ntz")
    return freight.since(t.events, EVENTS_AS_OF, 14).select(
        "event_id", (F.col("ts") >= as_of - F.expr("INTERVAL 24 HOURS")).alias("last_day"),
        (F.col("ts") >= as_of - F.expr("INTERVAL 7 DAYS")).alias("last_week"))


@query("stamped_append", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ts ELSE TIMESTAMP '2024-02-01' END AS created_at,
    TIMESTAMP '2024-02-01' AS updated_at FROM events""")
def stamped_append(t):
    rows = t.events.select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("created_at"))
    return table_ops.stamped(rows, "2024-02-01 00:00:00")


@query("upsert", """WITH u AS (SELECT user_id AS id, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
    base AS (SELECT c_custkey AS id, c_acctbal AS value, TIMESTAMP '2023-12-31' AS ts FROM customer)
    SELECT id, value, ts FROM u WHERE rn = 1 UNION ALL SELECT id, value, ts FROM base WHERE id NOT IN (SELECT id FROM u)""")
def upsert(t):
    base = t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("value"), F.lit("2023-12-31 00:00:00").cast("timestamp_ntz").alias("ts"))
    updates = t.events.select(F.col("user_id").alias("id"), "value", "ts", "event_id")
    return table_ops.upsert(base, updates, ["ts", "event_id"])


@query("delete_keep", "SELECT id, kind, price FROM series_gaps WHERE NOT coalesce(kind = 'error' AND price < 50, false)", uses="series_gaps")
def delete_keep(t):
    return table_ops.delete_where(t.series_gaps.select("id", "kind", "price"), {"kind": "error", "price": {"$lt": 50}})[0]


@query("delete_count", "SELECT count(*) AS deleted FROM series_gaps WHERE kind = 'error' AND price < 50", uses="series_gaps")
def delete_count(t):
    return table_ops.delete_where(t.series_gaps.select("id", "kind", "price"), {"kind": "error", "price": {"$lt": 50}})[1]


@query("retention", f"SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 20 DAY")
def retention(t):
    return table_ops.retain(t.events.select("event_id", "ts"), "ts", EVENTS_AS_OF, 20)


@query("history_scan", f"""SELECT user_id, ts, value FROM events WHERE user_id IN (3, 5, 8, 13, 21) AND ts BETWEEN TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 90 DAY
    AND TIMESTAMP '{EVENTS_AS_OF}' ORDER BY user_id, ts""")
def history_scan(t):
    return table_ops.history(t.events.select("user_id", "ts", "value"), [3, 5, 8, 13, 21], EVENTS_AS_OF, symbol="user_id")


@query("stale_flags", f"""SELECT event_id, TIMESTAMP '{EVENTS_AS_OF}' - ts > INTERVAL 5 MINUTE AS stale_price,
    TIMESTAMP '{EVENTS_AS_OF}' - ts >= INTERVAL 24 HOUR AS stale_score FROM events""")
def stale_flags(t):
    return t.events.select(
        "event_id", table_ops.stale("ts", EVENTS_AS_OF, 5).alias("stale_price"),
        table_ops.stale("ts", EVENTS_AS_OF, 24 * 60, inclusive=True).alias("stale_score"))


def _feed(t, shape: int):
    """One document per event with a full and a bare vessel."""
    names = feeds.UPPER if shape == 1 else feeds.LOWER
    root = "data" if shape == 1 else "vessels"
    n = F.col("event_id")
    values = [
        F.col("user_id").cast("string"), n.cast("string"), F.concat(F.lit("Vessel "), F.col("user_id")), F.col("event_type"), F.lit("PA"),
        (n % 90).cast("string"), (n % 180).cast("string"), F.col("value").cast("string"), (n % 360).cast("string"), F.lit("Rotterdam"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("11.5"), (n % 400).cast("string"), (n % 60).cast("string"), (n * 10).cast("string")]
    whole = F.to_json(F.struct(*[v.alias(k) for k, v in zip(names, values)]))
    bare = F.to_json(F.struct(F.concat(F.lit("B"), n).alias(names[0]), F.lit("soon").alias(names[10]), F.lit("fast").alias(names[7])))
    body = F.concat(F.lit(f'{{"{root}":['), whole, F.lit(","), bare, F.lit("]}"))
    return t.events.select(n.alias("id"), F.lit("Singapore").alias("area"), body.alias("body"))


POSITIONS = """SELECT event_id AS id, CAST(user_id AS VARCHAR) AS mmsi, CAST(event_id AS VARCHAR) AS imo, concat('Vessel ', user_id) AS vessel_name,
    event_type AS vessel_type, 'PA' AS flag, CAST(event_id % 90 AS DOUBLE) AS latitude, CAST(event_id % 180 AS DOUBLE) AS longitude, value AS speed,
    CAST(event_id % 360 AS DOUBLE) AS course, 'Rotterdam' AS destination, date_trunc('second', ts) AS eta, CAST(11.5 AS DOUBLE) AS draught,
    event_id % 400 AS length, event_id % 60 AS width, CAST(event_id * 10 AS DOUBLE) AS cargo_capacity, 'Singapore' AS current_port FROM events
    UNION ALL SELECT event_id, concat('B', event_id), '', '', '', '', 0, 0, 0, 0, '', NULL, 0, 0, 0, 0, 'Singapore' FROM events"""


@query("position_feed_upper", POSITIONS)
def position_feed_upper(t):
    return feeds.parse_positions(_feed(t, 1), "body", "area", 1)


@query("position_feed_lower", POSITIONS)
def position_feed_lower(t):
    return feeds.parse_positions(_feed(t, 2), "body", "area", 2)


# Documents and pages with a trailing quantity, as port and rate pages have.
VIEWS["page_texts"] = ((), """SELECT doc_id AS id, concat(text, CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat(' Total ', n_chars * 1000, ' TEU and ',
    n_chars * 7, ' tonnes, ', n_chars, ' ships. BDI: ', n_chars, ' up +', doc_id % 50, ' (', doc_id % 9, '%) rate $', n_chars, ' FBX ', n_chars * 2, '.5') END) AS body FROM documents""")


def page_texts(t):
    n, d = F.col("n_chars"), F.col("doc_id")
    tail = F.concat(
        F.lit(" Total "), n * 1000, F.lit(" TEU and "), n * 7, F.lit(" tonnes, "), n, F.lit(" ships. BDI: "), n, F.lit(" up +"), d % 50,
        F.lit(" ("), d % 9, F.lit("%) rate $"), n, F.lit(" FBX "), n * 2, F.lit(".5"))
    return t.documents.select(d.alias("id"), F.concat("text", F.when(d % 3 == 0, "").otherwise(tail)).alias("body"))


def _max(pattern: str, flags: str, divisor: int) -> str:
    return f"list_max(list_transform(regexp_extract_all(body, '{pattern}', 1{flags}), lambda s: TRY_CAST(replace(s, ',', '') AS DOUBLE))) / {divisor}"


@query("port_page_numbers", f"""SELECT id, {_max('([0-9,]+)[ \\t\\n\\x0B\\f\\r]*TEU', ", 'i'", 12)} AS container_throughput_teu,
    {_max('([0-9,]+)[ \\t\\n\\x0B\\f\\r]*(?:tons?|tonnes?)', ", 'i'", 12)} AS cargo_volume_tons,
    {_max('([0-9,]+)[ \\t\\n\\x0B\\f\\r]*(?:vessels?|ships?)', ", 'i'", 365)} AS vessel_arrivals FROM page_texts""", uses="page_texts",
       rnd="container_throughput_teu cargo_volume_tons vessel_arrivals", places=3)
def port_page_numbers(t):
    return feeds.parse_port_text(page_texts(t), "body").drop("body")


@query("single_port_page", f"SELECT id, {_max('([0-9,]+)[ \\t\\n\\x0B\\f\\r]*TEU', '', 12)} AS container_throughput_teu FROM page_texts",
       uses="page_texts", rnd="container_throughput_teu", places=3)
def single_port_page(t):
    return feeds.parse_single_port_text(page_texts(t), "body").drop("body")


def _one(pattern: str, flags: str = "i", group: int = 1) -> str:
    return f"TRY_CAST(replace(replace(nullif(regexp_extract(body, '{pattern}', {group}, '{flags}'), ''), ',', ''), '%', '') AS DOUBLE)"


@query("index_quotes", f"""SELECT id, coalesce(v, 1200.0) AS index_value, CASE WHEN v IS NOT NULL THEN coalesce(p, 0) ELSE 0 END AS change_points,
    CASE WHEN v IS NOT NULL THEN coalesce(q, 0) ELSE 0 END AS change_percent, v IS NULL AS estimated FROM (SELECT id,
    {_one('BDI[ \\t\\n\\x0B\\f\\r:]*([0-9,]+(?:[.][0-9]+)?)')} AS v, {_one('BDI.*?([+-]?[0-9,]+(?:[.][0-9]+)?).*?([+-]?[0-9.]+%?)', 'is', 1)} AS p,
    {_one('BDI.*?([+-]?[0-9,]+(?:[.][0-9]+)?).*?([+-]?[0-9.]+%?)', 'is', 2)} AS q FROM page_texts)""", uses="page_texts")
def index_quotes(t):
    return feeds.parse_index(page_texts(t), "body", "BDI").drop("body")


@query("container_rate_quotes", f"""SELECT id, r AS rate_40ft, r * 0.6 AS rate_20ft, r * 1.1 AS rate_40ft_hc, r * 0.8 AS base_rate,
    r * 0.15 AS bunker_surcharge, CAST(25 AS DOUBLE) AS security_surcharge FROM (SELECT id, {_one('[$]([0-9,]+)', 'c')} AS r FROM page_texts) WHERE r IS NOT NULL""",
       uses="page_texts", rnd="rate_40ft rate_20ft rate_40ft_hc base_rate bunker_surcharge", places=4)
def container_rate_quotes(t):
    return feeds.parse_container_rate(page_texts(t), "body").drop("body")


@query("fbx_quotes", f"SELECT id, {_one('FBX[ \\t\\n\\x0B\\f\\r:]*([0-9,]+(?:[.][0-9]+)?)')} AS fbx FROM page_texts", uses="page_texts")
def fbx_quotes(t):
    return feeds.parse_fbx(page_texts(t), "body").drop("body")


def _hits(level: str) -> str:
    return "(" + " + ".join(f"len(string_split(lower(text), '{w}')) - 1" for w in dims.LEXICON[level]) + ")"


@query("text_congestion", f"""SELECT doc_id, CASE WHEN h + m + l = 0 THEN 0.5 ELSE least(1.0, (1.0 * h + 0.5 * m + 0.1 * l) / (h + m + l)) END AS congestion
    FROM (SELECT doc_id, {_hits('high')} AS h, {_hits('medium')} AS m, {_hits('low')} AS l FROM (SELECT doc_id, concat(text, CASE doc_id % 4 WHEN 0 THEN ' Delay, delays and a QUEUE'
    WHEN 1 THEN ' busy but normal traffic' WHEN 2 THEN '' ELSE ' smooth' END) AS text FROM documents))""", rnd="congestion")
def text_congestion(t):
    n = F.col("doc_id") % 4
    tail = F.when(n == 0, " Delay, delays and a QUEUE").when(n == 1, " busy but normal traffic").when(n == 2, "").otherwise(" smooth")
    return t.documents.select("doc_id", feeds.congestion_from_text(F.concat("text", tail)).alias("congestion"))


@query("page_congestion", f"""SELECT page_id, CASE WHEN h + m + l = 0 THEN 0.5 ELSE least(1.0, (1.0 * h + 0.5 * m + 0.1 * l) / (h + m + l)) END AS congestion
    FROM (SELECT page_id, {_hits('high').replace('text', 'html')} AS h, {_hits('medium').replace('text', 'html')} AS m, {_hits('low').replace('text', 'html')} AS l FROM pages)""", rnd="congestion")
def page_congestion(t):
    return t.pages.select("page_id", feeds.congestion_from_text(F.col("html")).alias("congestion"))


@query("log_filter", """SELECT event_id, date_trunc('second', ts) AS timestamp, CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, event_type AS logger,
    concat('value ', event_id) AS message FROM events WHERE event_id % 23 <> 0 AND event_type = 'error' AND date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-15'""")
def log_filter(t):
    line = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"), F.col("event_type").alias("logger"),
        F.concat(F.lit("value "), F.col("event_id")).alias("message")))
    broken = F.when(F.col("event_id") % 23 == 0, F.substring(line, 1, 20)).otherwise(line)
    log = feeds.parse_log_lines(t.events.select("event_id", broken.alias("line")), "line")
    return feeds.filter_log(log, "2024-01-05 00:00:00", "2024-01-15 00:00:00", "ERROR")


@query("json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, concat('{\"event_type\":\"', event_type, '\",\"k\":', json_extract(props, '$.k'), '}') AS record FROM events")
def json_fields(t):
    k = F.from_json("props", "k bigint")["k"]
    return t.events.select("event_id", k.alias("k"), F.to_json(F.struct("event_type", k.alias("k"))).alias("record"))


@query("json_result_records", """SELECT l_returnflag, concat('{"l_returnflag":"', l_returnflag, '","lines":', count(*), '}') AS record FROM lineitem GROUP BY l_returnflag""")
def json_result_records(t):
    g = t.lineitem.groupBy("l_returnflag").agg(F.count("*").alias("lines"))
    return g.select("l_returnflag", F.to_json(F.struct("l_returnflag", "lines")).alias("record"))


@query("operation_timing", """SELECT service, count(*) AS calls, sum(duration) AS total, min(duration) AS fastest, max(duration) AS slowest, avg(duration) AS mean
    FROM request_log GROUP BY service""", uses="request_log", rnd="total fastest slowest mean", places=4)
def operation_timing(t):
    return oplog.operation_timing(t.request_log)


@query("performance_summary", """WITH m AS (SELECT service, count(*) AS n, avg(duration) AS m FROM request_log GROUP BY service)
    SELECT count(*) AS operations, CAST(sum(n) AS BIGINT) AS calls, arg_min(service, m) AS fastest_operation, arg_max(service, m) AS slowest_operation, avg(m) AS mean_of_means FROM m""",
       uses="request_log", rnd="mean_of_means")
def performance_summary(t):
    return oplog.performance_summary(t.request_log)


@query("query_stats", """SELECT count(*) AS queries, avg(duration) FILTER (NOT cached) AS mean_time, count(*) FILTER (duration > 1 AND NOT cached) AS slow,
    count(*) FILTER (cached) AS cache_hits, count(*) FILTER (cached) / count(*) AS hit_rate, count(*) FILTER (duration > 1 AND NOT cached) / count(*) AS slow_rate FROM request_log""",
       uses="request_log", rnd="mean_time hit_rate slow_rate")
def query_stats(t):
    return oplog.query_stats(t.request_log)


@query("latency_summary", "SELECT service, count(*) AS requests, avg(duration) AS mean_response, avg(failed::INT) AS error_rate FROM request_log GROUP BY service",
       uses="request_log", rnd="mean_response error_rate")
def latency_summary(t):
    return oplog.latency_summary(t.request_log)


STATUS = "CASE event_id % 6 WHEN 0 THEN 'Error' WHEN 1 THEN 'down' WHEN 2 THEN 'WARNING' WHEN 3 THEN 'degraded' ELSE 'ok' END"


@query("health_severity", f"""SELECT event_type AS component, CASE WHEN lower(s) IN ('error', 'critical', 'down') THEN 'ERROR' WHEN lower(s) IN ('warning', 'degraded')
    THEN 'WARNING' ELSE 'INFO' END AS severity, count(*) AS events FROM (SELECT *, {STATUS} AS s FROM events) GROUP BY ALL""")
def health_severity(t):
    return oplog.health_counts(t.events.select(F.col("event_type").alias("component"), F.expr(STATUS).alias("status")), "component", "status")


@query("business_event_counts", "SELECT event_type AS event, count(*) AS events, max(ts) AS last_seen FROM events GROUP BY event_type")
def business_event_counts(t):
    rows = oplog.business_events(t.events, F.col("event_type"), {"user": F.col("user_id"), "value": F.col("value")})
    return oplog.event_counts(rows)


# --- written and read again -------------------------------------------------

def _folder(t) -> str:
    return f"{shared_folder(t.spark)}/written-{uuid.uuid4().hex}"


@query("table_snapshots", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in ("customer", "orders", "part", "supplier")))
def table_snapshots(t):
    return table_ops.snapshot({n: t.table(n) for n in ("customer", "orders", "part", "supplier")}, _folder(t), "2024-02-01 00:00:00").select("table_name", "row_count")


@query("restored_orders", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def restored_orders(t):
    """A snapshot is taken, every third order changes and new ones come, then the snapshot is restored."""
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice").withColumn("version", F.lit(0))
    table = VersionedTable(t.spark, _folder(t), ["o_orderkey"], ["version"], rows.schema, buckets=8)
    table.merge(rows)
    table.snapshot("before")
    table.merge(rows.where("o_orderkey % 3 = 0").withColumns({"o_totalprice": F.col("o_totalprice") * 2, "version": F.lit(1)}))
    table.merge(rows.withColumns({"o_orderkey": -F.col("o_orderkey") - 1, "version": F.lit(1)}))
    table.restore("before")
    return table.read().drop("version")


@query("merged_orders", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders")
def merged_orders(t):
    """The later version comes first, the older one after it."""
    rows = t.orders.select("o_orderkey", "o_totalprice").withColumn("version", F.lit(0))
    table = VersionedTable(t.spark, _folder(t), ["o_orderkey"], ["version"], rows.schema, buckets=8)
    table.merge(rows.where("o_orderkey % 3 = 0").withColumns({"o_totalprice": F.col("o_totalprice") * 2, "version": F.lit(1)}))
    table.merge(rows)
    return table.read().drop("version")


@query("daily_runs", "SELECT CAST(ts AS DATE) AS date, count(*) AS events, sum(event_id)::BIGINT AS ids FROM events GROUP BY ALL")
def daily_runs(t):
    """Two collection runs written by day, one of them read back by its days."""
    path = _folder(t)
    for run in (0, 1):
        table_ops.write_run(t.events.where(F.col("event_id") % 2 == run), path)
    return t.spark.read.parquet(path).groupBy("date").agg(F.count("*").alias("events"), F.sum("event_id").alias("ids"))


CSV = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz, l_returnflag string"


def _delimited(t):
    """Line items as text; those of line 7 have no number as quantity, those of line 6 no date."""
    path, columns = _folder(t), [c.split()[0] for c in CSV.split(", ")]
    rows = t.lineitem.select(*columns).withColumns({
        "l_quantity": F.when(F.col("l_linenumber") == 7, "many").otherwise(F.col("l_quantity").cast("string")),
        "l_shipdate": F.when(F.col("l_linenumber") == 6, "soon").otherwise(F.col("l_shipdate").cast("string"))})
    rows.write.csv(path, header=True)
    return table_ops.read_delimited(t.spark, path, CSV)


@query("delimited_rows", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber, l_quantity, l_shipdate, l_returnflag FROM lineitem WHERE l_linenumber < 6")
def delimited_rows(t):
    return _delimited(t)[0]


@query("delimited_rejects", "SELECT CASE l_linenumber WHEN 7 THEN 'l_quantity' ELSE 'l_shipdate' END AS bad, count(*) AS n FROM lineitem WHERE l_linenumber >= 6 GROUP BY ALL")
def delimited_rejects(t):
    return _delimited(t)[1].groupBy(F.array_join("bad_columns", ",").alias("bad")).agg(F.count("*").alias("n"))
