"""Calendar parts, cyclic encodings, flags and tolerant time parsing."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cycle(part: Column, length: float) -> tuple[Column, Column]:
    angle = part * (2 * math.pi / length)
    return F.sin(angle), F.cos(angle)


def calendar_parts(ts: str) -> dict[str, Column]:
    """Year, month, day, Monday-first weekday, day of year, quarter, ISO week."""
    c = F.col(ts)
    return {
        "year": F.year(c), "month": F.month(c), "day": F.dayofmonth(c), "dayofweek": F.weekday(c),
        "dayofyear": F.dayofyear(c), "quarter": F.quarter(c), "week": F.weekofyear(c),
    }


def cyclic_parts(ts: str) -> dict[str, Column]:
    c = F.col(ts)
    out = {}
    for name, part, length in (
        ("month", F.month(c), 12), ("dayofweek", F.weekday(c), 7), ("dayofyear", F.dayofyear(c), 365),
        ("day", F.dayofmonth(c), 31),
    ):
        out[f"{name}_sin"], out[f"{name}_cos"] = _cycle(part, length)
    return out


def calendar_flags(ts: str) -> dict[str, Column]:
    """Weekend, first and last day of month and quarter, as 0 / 1."""
    day = F.to_date(F.col(ts))
    quarter = F.trunc(day, "quarter")
    flags = {
        "is_weekend": F.weekday(day) >= 5,
        "is_month_start": F.dayofmonth(day) == 1,
        "is_month_end": day == F.last_day(day),
        "is_quarter_start": day == quarter,
        "is_quarter_end": day == F.last_day(F.add_months(quarter, 2)),
    }
    return {name: flag.cast("int") for name, flag in flags.items()}


def prefixed_features(ts: str) -> dict[str, Column]:
    """The same features under the column's name, with the hour."""
    parts, cycles, flags = calendar_parts(ts), cyclic_parts(ts), calendar_flags(ts)
    chosen = {k: parts[k] for k in ("year", "month", "day", "dayofweek", "quarter")} | {"hour": F.hour(F.col(ts))}
    chosen |= {k: cycles[k] for k in ("month_sin", "month_cos", "day_sin", "day_cos")}
    chosen |= {k: flags[k] for k in ("is_weekend", "is_month_end", "is_quarter_end")}
    return {f"{ts}_{k}": v for k, v in chosen.items()}


# The accepted arrival-time formats, tried in this order.
ARRIVAL_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy HH:mm")


def parse_time(text: Column, formats=ARRIVAL_FORMATS) -> Column:
    """First matching format, NULL when none matches."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats]).cast("timestamp_ntz")
