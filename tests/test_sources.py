import datetime as dt
import tempfile

from pyspark.sql import functions as F

from helpers import rows
from tradewind.sources import feeds, table_ops


def folder():
    return tempfile.mkdtemp(prefix="tradewind-test-")


def test_append_stamps_only_where_absent(spark):
    path = folder() + "/t"
    a = spark.createDataFrame([(1, dt.datetime(2020, 1, 1)), (2, None)], "id int, created_at timestamp_ntz")
    table_ops.append(a, path, "2024-02-01 00:00:00")
    table_ops.append(a.where("id = 1"), path, "2024-03-01 00:00:00")
    got = rows(spark.read.parquet(path), "id", "created_at", "updated_at")
    assert [g[1].year for g in got] == [2020, 2020, 2024] and {g[2].month for g in got} == {2, 3}


def test_upsert_last_update_wins(spark):
    base = spark.createDataFrame([("A", 1.0, 0), ("B", 2.0, 0)], "symbol string, x double, at int")
    new = spark.createDataFrame([("B", 5.0, 2), ("B", 4.0, 1), ("C", 6.0, 1)], "symbol string, x double, at int")
    assert rows(table_ops.upsert(base, new, ["at"]), "symbol", "x") == [("A", 1.0), ("B", 5.0), ("C", 6.0)]


def test_delete_keeps_unknown(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None), (3, 50.0)], "id int, x double")
    kept, gone = table_ops.delete_where(df, {"x": {"$lt": 10}})
    assert rows(kept, "id") == [(2,), (3,)] and gone.first()["deleted"] == 1
    path = table_ops.replace_table(kept, folder())
    assert spark.read.parquet(path).count() == 2


def test_snapshot_and_restore(spark):
    root, target = folder(), folder() + "/live"
    df = spark.range(7)
    manifest = table_ops.snapshot({"t": df}, root, "2024-01-01")
    assert rows(manifest, "table_name", "row_count") == [("t", 7)]
    table_ops.restore(spark, root, {"t": target})
    table_ops.restore(spark, root, {"t": target})
    assert spark.read.parquet(target).count() == 14
    table_ops.restore(spark, root, {"t": target}, overwrite=True)
    assert spark.read.parquet(target).count() == 7


def test_run_sink_is_partitioned_by_day(spark):
    path = folder() + "/run"
    df = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 5)), (2, dt.datetime(2024, 1, 2, 5))], "id int, ts timestamp_ntz")
    table_ops.write_run(df, path)
    plan = spark.read.parquet(path).where("date = '2024-01-02'")
    assert rows(plan, "id") == [(2,)] and "PartitionFilters: [isnotnull(date" in plan._jdf.queryExecution().toString()


def test_delimited_json_and_log_files(spark):
    root = folder()
    with open(f"{root}/a.csv", "w") as f:
        f.write("id,x\n1,2.5\n2,bad\n3,4\n")
    good, bad = table_ops.read_delimited(spark, f"{root}/a.csv", "id int, x double")
    assert rows(good, "id") == [(1,), (3,)]
    assert bad.count() >= 1 and all(r.bad_columns for r in bad.collect())
    table_ops.write_results(spark.range(3), f"{root}/res")
    assert spark.read.json(f"{root}/res").count() == 3
    with open(f"{root}/app.log", "w") as f:
        f.write('{"timestamp":"2024-01-05T10:00:00","level":"ERROR","logger":"x","message":"m"}\n{"timestamp":\n'
                '{"timestamp":"2024-03-05T10:00:00","level":"ERROR","logger":"x","message":"m"}\n')
    log = feeds.filter_log(feeds.read_log(spark, f"{root}/app.log"), "2024-01-01 00:00:00", "2024-02-01 00:00:00", "ERROR")
    feeds.export_log(log, f"{root}/out")
    assert log.count() == 1 and spark.read.json(f"{root}/out").count() == 1


def test_port_text_numbers(spark):
    df = spark.createDataFrame([("1,200 TEU then 24,000 teu. 365 vessels",), ("nothing",)], "t string")
    got = feeds.parse_port_text(df, "t").collect()
    assert got[0]["container_throughput_teu"] == 2000.0 and got[0]["vessel_arrivals"] == 1.0 and got[0]["cargo_volume_tons"] is None
    assert got[1]["container_throughput_teu"] is None
    assert feeds.parse_single_port_text(df, "t").first()["container_throughput_teu"] == 100.0


def test_lexicon_counts_substrings(spark):
    df = spark.createDataFrame([("Delays, delay and quick",), ("calm",), ("breakfast",)], "t string")
    got = [r[0] for r in df.select(feeds.congestion_from_text(F.col("t"))).collect()]
    assert got == [2.1 / 3, 0.5, 0.1]


def test_predicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, s string")
    q = lambda f: rows(table_ops.query_table(df, f), "n")
    assert q({"n": {"$gte": 2}}) == [(2,), (3,)] and q({"s": {"$nin": ["a"]}}) == [(2,)] and q({"n": {"$what": 1}}) == [(1,)]
    assert rows(table_ops.query_table(df, sort=[("n", -1)], limit=0, offset=None), "n") == [(1,), (2,), (3,)]
