"""Vessel positions: validity, duplicates, area congestion, routes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind import dims
from tradewind.functions.rowwise import great_circle_nm
from tradewind.plans.blocks import over_time


def valid_position() -> Column:
    """Bounds and non-empty identity; an unknown value is invalid."""
    ok = (
        F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180) & (F.col("speed") >= 0)
        & (F.length(F.col("mmsi").cast("string")) > 0) & (F.length("vessel_name") > 0)
    )
    return F.coalesce(ok, F.lit(False))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in a stated order.

    ``min_by`` keeps one candidate per key and task, so a key with very many
    copies never gathers in one place.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(first.alias("_row")).select(*keys, "_row.*")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key; the mirror of :func:`keep_first`."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def area_of(lat: str = "latitude", lon: str = "longitude") -> Column:
    """Array of the watched areas that contain a position.

    The areas are a handful of fixed boxes, so the range join is a row-wise
    test in the scan stage and needs no join at all.
    """
    hits = [
        F.when(F.col(lat).between(a[1], a[2]) & F.col(lon).between(a[3], a[4]), F.lit(a[0])) for a in dims.AREAS]
    return F.array_compact(F.array(*hits))


def congestion_level(vessels: Column, mean_speed: Column) -> Column:
    """Vessels per 50 capped at 1, half as much again when traffic is slow."""
    base = F.least(vessels / 50.0, F.lit(1.0))
    return F.when(F.coalesce(mean_speed, F.lit(0.0)) < 5, F.least(base * 1.5, F.lit(1.0))).otherwise(base)


def area_congestion(positions: DataFrame, areas: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Vessel count, mean speed and congestion per area; empty areas stay."""
    inside = positions.select("*", F.explode(area_of()).alias("area"))
    counts = inside.groupBy("area", *extra_keys).agg(F.count("*").alias("_n"), F.avg("speed").alias("_v"))
    joined = areas.select("area").join(counts, "area", "left")
    n, v = F.coalesce("_n", F.lit(0)), F.coalesce("_v", F.lit(0.0))
    return joined.select(
        "area", *extra_keys, n.alias("vessel_count"), v.alias("avg_speed"), congestion_level(n, v).alias("congestion"))


def route_distance(routes: DataFrame, distances: DataFrame) -> DataFrame:
    """Table distance or the default, hours at cruising speed, fixed estimates."""
    d = F.coalesce("_d", F.lit(dims.DEFAULT_DISTANCE))
    return (
        routes.join(distances.withColumnRenamed("distance", "_d"), ["origin", "destination"], "left")
        .withColumns({
            "route_id": F.concat_ws("-", "origin", "destination"),
            "distance_nm": d,
            "transit_hours": d / dims.CRUISE_KNOTS,
            "congestion_level": F.lit(0.5),
            "risk_score": F.lit(0.3),
        })
        .drop("_d")
    )


def distance_from_area(lat: str = "latitude", lon: str = "longitude") -> dict[str, Column]:
    """Great-circle distance to the centre of each watched area."""
    return {
        f"nm_{a[0].lower().replace(' ', '_')}": great_circle_nm(
            F.col(lat), F.col(lon), F.lit((a[1] + a[2]) / 2), F.lit((a[3] + a[4]) / 2))
        for a in dims.AREAS
    }


def select_vessels(positions: DataFrame, types: Sequence[str], box, start: str, end: str) -> DataFrame:
    """Vessels of some types in a region and time range."""
    lat_lo, lat_hi, lon_lo, lon_hi = box
    return positions.where(
        F.col("vessel_type").isin(list(types)) & F.col("latitude").between(lat_lo, lat_hi)
        & F.col("longitude").between(lon_lo, lon_hi)
        & F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def requests_before(df: DataFrame, keys: Sequence[str], ts: str, seconds: dict[str, int], **kw) -> DataFrame:
    """Events of the same keys in the last n seconds at each event."""
    timed = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    return over_time(
        timed, keys, "_us",
        lambda w: {name: F.count("*").over(w.rangeBetween(-s * 1_000_000, 0)) for name, s in seconds.items()},
        max(seconds.values()), **kw,
    ).drop("_us")
