import datetime as dt
import tempfile

from pyspark.sql import functions as F

from helpers import rows
from tradewind.sources.versions import VersionedTable
from tradewind.streaming import live


def write_files(df, files):
    root = tempfile.mkdtemp(prefix="tradewind-feed-")
    df.repartition(files).write.parquet(f"{root}/in")
    return f"{root}/in"


def test_upsert_over_many_batches(spark):
    df = spark.range(200).selectExpr("id % 9 AS k", "id AS at", "id * 2 AS x")
    path = write_files(df, 4)
    root = live.shared_folder(spark)
    stream = live.read_files(spark, path, "*.parquet", per_trigger=1)
    table = VersionedTable(spark, f"{root}/table", ["k"], ["at"], stream.schema, buckets=4)
    live.upsert_into(stream, table).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    # the newest row of a key wins, in whichever batch it came
    assert rows(table.read(), "k", "at", "x") == sorted(((k, a, 2 * a) for k in range(9) for a in [max(x for x in range(200) if x % 9 == k)]), key=lambda r: tuple(map(str, r)))


def test_merges_in_any_order_snapshots_and_repeats(spark):
    schema = "k int, at int, x string"
    table = VersionedTable(spark, live.shared_folder(spark), ["k"], ["at"], spark.createDataFrame([], schema).schema, buckets=3)
    assert table.read().count() == 0
    table.merge(spark.createDataFrame([(1, 5, "new"), (2, 1, "b"), (None, 1, "null key")], schema), ("s", 0))
    table.snapshot("first")
    before = table.manifest.read()[1]["buckets"]
    table.merge(spark.createDataFrame([(1, 3, "late"), (1, 4, "late too")], schema), ("s", 1))
    assert rows(table.read(), "k", "x") == [(1, "new"), (2, "b"), (None, "null key")]
    after = table.manifest.read()[1]["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1  # only the bucket of key 1 was rewritten
    again = spark.createDataFrame([(2, 9, "twice")], schema)
    table.merge(again, ("s", 2))
    number = table.manifest.read()[0]
    table.merge(again.withColumn("at", F.lit(99)), ("s", 2))  # the same batch number: already applied
    assert table.manifest.read()[0] == number and rows(table.read().where("k = 2"), "at") == [(9,)]
    assert rows(table.read("first").where("k = 2"), "x") == [("b",)]
    table.restore("first")
    assert rows(table.read(), "k", "x") == [(1, "new"), (2, "b"), (None, "null key")]
    table.merge(spark.createDataFrame([], schema))
    assert table.read().count() == 3


def test_a_lost_race_is_merged_again(spark):
    schema = "k int, at int"
    table = VersionedTable(spark, live.shared_folder(spark), ["k"], ["at"], spark.createDataFrame([], schema).schema, buckets=2)
    other = VersionedTable(spark, table.root, ["k"], ["at"], table.schema, buckets=2)
    publish, raced = table.manifest.publish, []

    def late(entries, number):
        if not raced:
            raced.append(1)
            other.merge(spark.createDataFrame([(1, 7), (3, 1)], schema))
        return publish(entries, number)

    table.manifest.publish = late
    table.merge(spark.createDataFrame([(1, 2), (2, 2)], schema))
    assert rows(table.read(), "k", "at") == [(1, 7), (2, 2), (3, 1)]


def test_repeats_within_the_delay_are_dropped(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, base), (1, base + dt.timedelta(minutes=1)), (2, base)], "k int, ts timestamp_ntz")
    out = live.run_once(live.drop_repeats(live.read_files(spark, write_files(df, 1)), ["k"]))
    assert out.count() == 2


def test_alerts_are_stateless(spark):
    df = spark.createDataFrame([(1, 0.9, 40.0, 18, 0.8), (2, 0.1, 1.0, 0, 0.1)], "id int, berth_utilization double, avg_waiting_time double, queue_length int, storage_utilization double")
    out = live.run_once(live.congestion_alerts(live.read_files(spark, write_files(df, 2))))
    assert rows(out, "id") == [(1,)]


def test_closed_windows_keep_bounded_state_and_leave_late_rows_out(spark):
    """Six daily files and a late one: each window is sent once, state follows lanes and open windows, not rows."""
    root = live.shared_folder(spark)
    base = dt.datetime(2024, 1, 1)
    rates = {}
    for day in range(12):
        batch = [(lane, base + dt.timedelta(days=day, minutes=m), float(100 + (m * 7 + day * 13) % 50)) for lane in ("a", "b") for m in range(0, 1440, 12)]
        rates[day] = batch
        late = [("a", base + dt.timedelta(hours=1), 1e9)] if day == 9 else []
        spark.createDataFrame(batch + late, "lane string, ts timestamp_ntz, rate_40ft double").coalesce(1).write.mode("append").parquet(f"{root}/feed")
    feed = live.read_files(spark, f"{root}/feed", "*.parquet", per_trigger=1)
    progress = []
    got = live.run_once(live.closed_volatility(feed, ["lane"], days=3, delay="6 hours"), progress=progress).collect()
    assert len(got) == len({(r["window_start"], r["lane"]) for r in got})
    for r in got:
        days = [(r["window_start"] - base).days + i for i in range(3)]
        held = [x for d in days for lane, _, x in rates.get(d, []) if lane == r["lane"]]
        mean = sum(held) / len(held)
        std = (sum((x - mean) ** 2 for x in held) / len(held)) ** 0.5
        assert r["n_rates"] == len(held) and abs(r["mean_rate"] - mean) < 1e-6 and abs(r["volatility"] - std / mean) < 1e-9
    assert {r["window_start"] for r in got} >= {base + dt.timedelta(days=d) for d in range(-2, 8)}
    sizes = [op["numRowsTotal"] for p in progress for op in p["stateOperators"]]
    assert len(progress) >= 12 and max(sizes) <= 2 * 6 and sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"]) >= 1
