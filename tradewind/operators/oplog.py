"""Operational tables as data: timings, query statistics, health, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def operation_timing(log: DataFrame, operation: str = "service", duration: str = "duration") -> DataFrame:
    return log.groupBy(operation).agg(
        F.count("*").alias("calls"), F.sum(duration).alias("total"), F.min(duration).alias("fastest"),
        F.max(duration).alias("slowest"), F.avg(duration).alias("mean"))


def performance_summary(log: DataFrame, operation: str = "service", duration: str = "duration") -> DataFrame:
    """Fastest and slowest operation by mean, and the mean of the means."""
    t = operation_timing(log, operation, duration)
    return t.agg(
        F.count("*").alias("operations"), F.sum("calls").alias("calls"),
        F.min_by(operation, F.struct("mean", operation)).alias("fastest_operation"),
        F.max_by(operation, F.struct("mean", operation)).alias("slowest_operation"), F.avg("mean").alias("mean_of_means"))


def query_stats(log: DataFrame, slow_above: float = 1.0) -> DataFrame:
    """Totals, cache hits and slow queries of a query log."""
    n = F.count("*")
    slow = F.count_if((F.col("duration") > slow_above) & ~F.col("cached"))
    hits = F.count_if(F.col("cached"))
    return log.agg(
        n.alias("queries"), F.avg(F.when(~F.col("cached"), F.col("duration"))).alias("mean_time"), slow.alias("slow"),
        hits.alias("cache_hits"), F.try_divide(hits, n).alias("hit_rate"), F.try_divide(slow, n).alias("slow_rate"))


def latency_summary(log: DataFrame, service: str = "service") -> DataFrame:
    return log.groupBy(service).agg(
        F.count("*").alias("requests"), F.avg("duration").alias("mean_response"),
        F.avg(F.col("failed").cast("double")).alias("error_rate"))


def health_severity(status: Column) -> Column:
    s = F.lower(status)
    return (
        F.when(s.isin("error", "critical", "down"), "ERROR").when(s.isin("warning", "degraded"), "WARNING").otherwise("INFO"))


def health_counts(events: DataFrame, component: str, status: str) -> DataFrame:
    return events.withColumn("severity", health_severity(F.col(status))).groupBy(component, "severity").agg(
        F.count("*").alias("events"))


def business_events(df: DataFrame, kind: Column, payload: dict[str, Column], ts: str = "ts") -> DataFrame:
    """Typed event rows: kind, time and a struct payload."""
    return df.select(kind.alias("event"), F.col(ts).alias("ts"), F.struct(*[c.alias(n) for n, c in payload.items()]).alias("payload"))


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event").agg(F.count("*").alias("events"), F.max("ts").alias("last_seen"))
