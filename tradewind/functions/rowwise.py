"""Row-wise expressions: everything here is a Column, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    """NULL stays NULL (``least``/``greatest`` alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x)))


def present(columns: Sequence[Column]) -> Column:
    """Array of the non-null values."""
    return F.array_compact(F.array(*columns))


def mean_of(columns: Sequence[Column]) -> Column:
    """Mean of the non-null values, NULL when there are none."""
    values = present(columns)
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values).cast("double"))


def row_statistics(columns: Sequence[str], prefix: str = "row") -> dict[str, Column]:
    """Mean, sample std, min, max, median and unbiased skew across columns, NULLs skipped."""
    values = F.array_sort(present([F.col(c).cast("double") for c in columns]))
    n = F.size(values).cast("double")
    mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), n)

    def moment(k: int) -> Column:
        return F.aggregate(F.transform(values, lambda x: F.pow(x - mean, F.lit(float(k)))), F.lit(0.0), lambda a, x: a + x)

    m2, m3 = moment(2), moment(3)
    middle = F.floor((n - 1) / 2).cast("int")
    upper = F.ceil((n - 1) / 2).cast("int")
    skew = F.when(
        n >= 3,
        F.when(m2 == 0, 0.0).otherwise(
            n * F.sqrt(n - 1) / (n - 2) * m3 / F.pow(F.when(m2 > 0, m2), F.lit(1.5))),
    )
    return {
        f"{prefix}_mean": mean,
        f"{prefix}_std": F.when(n > 1, F.sqrt(m2 / F.greatest(n - 1, F.lit(1.0)))),
        f"{prefix}_min": F.array_min(values),
        f"{prefix}_max": F.array_max(values),
        f"{prefix}_median": F.when(n > 0, (F.get(values, middle) + F.get(values, upper)) / 2),
        f"{prefix}_skew": skew,
    }


def pair_interactions(a: str, b: str) -> dict[str, Column]:
    """Product, ratio, difference and share of one pair of columns."""
    x, y = F.col(a), F.col(b)
    tiny = 1e-8
    return {
        f"{a}_x_{b}": x * y,
        f"{a}_div_{b}": F.try_divide(x, y + tiny),
        f"{a}_minus_{b}": x - y,
        f"{a}_share_{b}": F.try_divide(x, x + y + tiny),
    }


def auto_pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    """Each column with the next two."""
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 : i + 3]]


def leading_interactions(columns: Sequence[str], first: int = 5) -> dict[str, Column]:
    """Product and ratio over every pair of the first columns, no value -> 0."""
    lead = list(columns)[:first]
    out = {}
    for i, a in enumerate(lead):
        for b in lead[i + 1 :]:
            x, y = F.col(a), F.col(b)
            out[f"{a}_x_{b}"] = F.coalesce(x * y, F.lit(0.0))
            out[f"{a}_div_{b}"] = F.coalesce(F.try_divide(x, y + 1e-8), F.lit(0.0))
    return out


def polynomials(columns: Sequence[str], degree: int = 2, first: int = 3) -> dict[str, Column]:
    return {f"{c}_pow{d}": F.pow(F.col(c), F.lit(float(d))) for c in list(columns)[:first] for d in range(2, degree + 1)}


def great_circle_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance in nautical miles."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlon / 2), F.lit(2.0))
    return F.lit(2 * 3440.065) * F.asin(F.sqrt(h))


def numeric_columns(df: DataFrame) -> list[str]:
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [f.name for f in df.schema.fields
            if f.dataType.simpleString() in kinds or f.dataType.simpleString().startswith("decimal")]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]


def columns_present(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """The wanted columns that exist, in the wanted order."""
    return [c for c in wanted if c in df.columns]
