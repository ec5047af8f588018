"""Structured Streaming forms of the live metrics.

Every function maps a streaming DataFrame to a streaming DataFrame (or starts a
query), so the same code runs from files, Kafka or any other source.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind import session
from tradewind.operators.freight import volatility_columns, volatility_of
from tradewind.operators.ports import congestion_index
from tradewind.operators.vessels import area_of, congestion_level
from tradewind.sources.versions import VersionedTable


def read_files(spark: SparkSession, folder: str, pattern: str = "*", per_trigger: int | None = None) -> DataFrame:
    """Stream of the files of a folder that match a pattern, with the schema of those already there."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def event_time(ts: str = "ts") -> Column:
    """Watermarks need an instant; stored times are zone-less UTC."""
    return F.col(ts).cast("timestamp")


def hourly_congestion(positions: DataFrame, ts: str = "ts", delay: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Vessel count, mean speed and congestion per area and tumbling window."""
    inside = positions.withColumn("at", event_time(ts)).withWatermark("at", delay).select(
        "at", "mmsi", "speed", F.explode(area_of()).alias("area"))
    counts = inside.groupBy(F.window("at", length), "area").agg(
        F.count("mmsi").alias("vessel_count"), F.avg("speed").alias("avg_speed"))
    return counts.select(
        "area", F.col("window.start").cast("timestamp_ntz").alias("hour"), "vessel_count", "avg_speed",
        congestion_level(F.col("vessel_count"), F.col("avg_speed")).alias("congestion"))


def drop_repeats(feed: DataFrame, keys: Sequence[str], ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """First arrival per key; later copies within the delay are dropped and state is freed after it."""
    return feed.withColumn("at", event_time(ts)).withWatermark("at", delay).dropDuplicatesWithinWatermark(list(keys)).drop("at")


def sliding_volatility(rates: DataFrame, keys: Sequence[str] = ("origin", "destination"), ts: str = "ts", length: str = "30 days",
                       slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Rate volatility per lane over a sliding window."""
    windowed = rates.withColumn("at", event_time(ts)).withWatermark("at", delay).groupBy(F.window("at", length, slide), *keys)
    return volatility_of(windowed.agg(*volatility_columns())).select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"), *keys, "n_rates", "mean_rate", "volatility")


def closed_volatility(rates: DataFrame, keys: Sequence[str] = ("origin", "destination"), rate: str = "rate_40ft", ts: str = "ts", days: int = 30,
                      delay: str = "1 day") -> DataFrame:
    """Rate volatility per lane over sliding windows of days, each sent once when it has closed.

    Rates fold into one row per lane and day first; when the watermark closes a
    day, its sums enter the ``days`` windows that hold it. What is kept is a row
    for each lane and open day and one for each lane and open window, however
    many rates arrive; a rate later than the delay is left out, as its day has
    been sent. The rows of a day are folded around the lane's first rate of it.
    """
    keys = list(keys)
    valid = F.when(F.col(rate) != 0, F.col(rate).cast("double"))
    daily = rates.withColumn("at", event_time(ts)).withWatermark("at", delay).groupBy(F.window("at", "1 day").alias("day"), *keys).agg(
        F.count("*").alias("_n"), F.count(valid).alias("_k"), F.coalesce(F.avg(valid), F.lit(0.0)).alias("_m"), F.coalesce(F.var_pop(valid), F.lit(0.0)).alias("_v"))
    k, m = F.col("_k"), F.col("_m")
    sums = daily.select(F.window_time("day").alias("at"), *keys, "_n", "_k", (k * m).alias("_s"), (k * (F.col("_v") + m * m)).alias("_q"))
    windows = sums.groupBy(F.window("at", f"{days} days", "1 day").alias("window"), *keys).agg(*[F.sum(c).alias(c) for c in ("_n", "_k", "_s", "_q")])
    mean = F.try_divide("_s", "_k")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.try_divide("_q", "_k") - mean * mean))
    return volatility_of(windows.select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"), *keys, F.col("_n").alias("n_rates"), F.col("_k").alias("n_valid"), mean.alias("_mean"), spread.alias("_std")))


def congestion_alerts(metrics: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Stateless alert filter."""
    return metrics.withColumn("congestion_index", congestion_index()).where(F.col("congestion_index") > threshold)


def fresh_prices(signals: DataFrame, prices: DataFrame, key: str = "symbol", minutes: int = 5, delay: str = "10 minutes") -> DataFrame:
    """Signals joined to the prices of the last five minutes; state is bounded by the time range."""
    s = signals.withColumn("s_at", event_time("ts")).withWatermark("s_at", delay)
    p = prices.select(F.col(key).alias("_key"), "price", event_time("ts").alias("p_at")).withWatermark("p_at", delay)
    recent = F.expr(f"p_at BETWEEN s_at - INTERVAL {minutes} MINUTES AND s_at")
    return s.join(p, (F.col(key) == F.col("_key")) & recent, "inner").drop("_key")


def upsert_into(updates: DataFrame, table: VersionedTable):
    """Keep one row per key, the last by the table's order, whatever files arrive first.

    Each batch rewrites only the buckets its keys fall into. A batch that is run
    again after a failure finds its number in the manifest and changes nothing.
    """
    stream = f"{table.root}/stream"

    def merge(batch: DataFrame, number: int) -> None:
        table.merge(batch, (stream, number))

    return updates.writeStream.foreachBatch(merge)


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the shared folder of the cluster."""
    return f"{session.shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def run_once(stream: DataFrame, mode: str = "append", progress: list | None = None) -> DataFrame:
    """Drain what is there and return the written rows (for batch twins and tests).

    Append mode writes parquet files exactly once; complete mode rewrites the
    result table per batch. ``progress`` takes up what each batch reports.
    """
    spark = stream.sparkSession
    root = shared_folder(spark)
    writer = stream.writeStream.option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{root}/rows").outputMode("append").start()
    else:
        query = writer.outputMode(mode).foreachBatch(_rewrite(f"{root}/rows")).start()
    query.awaitTermination()
    if progress is not None:
        progress += query.recentProgress
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def _rewrite(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return write
