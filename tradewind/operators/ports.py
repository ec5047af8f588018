"""Port metrics: composite congestion index, efficiency trend, terminals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind import dims
from tradewind.functions.rowwise import mean_of


def congestion_index(text_index: Column | None = None) -> Column:
    """Mean of the known parts {berth, wait / 48, queue / 20, storage, text}; none -> 0.5."""
    parts = [
        F.col("berth_utilization"),
        F.when(F.col("avg_waiting_time").isNotNull(), F.least(F.col("avg_waiting_time") / 48.0, F.lit(1.0))),
        F.when(F.col("queue_length").isNotNull(), F.least(F.col("queue_length") / 20.0, F.lit(1.0))),
        F.col("storage_utilization"),
    ]
    if text_index is not None:
        parts.append(text_index)
    return F.coalesce(mean_of(parts), F.lit(0.5))


def efficiency_trend(metrics: DataFrame, value: str, start: str, end: str) -> DataFrame:
    """Mean and slope per day of a port metric inside a window."""
    day = F.datediff(F.to_date("ts"), F.lit(start).cast("date")).cast("double")
    window = metrics.where(
        F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    return window.groupBy("port_name").agg(
        F.avg(value).alias("mean_value"), F.regr_slope(F.col(value), day).alias("slope"), F.count(value).alias("n"))


def terminals(spark) -> DataFrame:
    """The static terminal dimension."""
    return dims.frame(
        spark, dims.TERMINALS,
        "terminal_name string, port_name string, operator string, capacity_teu double, berth_count int, crane_count int",
    ).withColumns({
        "current_utilization": F.lit(dims.TERMINAL_UTILISATION),
        "max_vessel_size": F.lit(dims.TERMINAL_MAX_VESSEL),
        "specialization": F.array(F.lit("container")),
    })


def alerts(metrics: DataFrame, threshold: float = 0.7) -> DataFrame:
    return metrics.where(F.col("congestion_index") > threshold)
