"""Data-quality profile, score and recommendations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.functions.rowwise import numeric_columns, text_columns


def profile_row(df: DataFrame) -> dict:
    """All per-column statistics of a frame in one aggregation pass."""
    numbers = numeric_columns(df)
    aggs = [F.count("*").alias("_rows")]
    for c in df.columns:
        aggs.append(F.count_if(F.col(c).isNull()).alias(f"{c}|nulls"))
    for c in numbers:
        x = F.col(c).cast("double")
        aggs += [F.min(x).alias(f"{c}|min"), F.max(x).alias(f"{c}|max"), F.avg(x).alias(f"{c}|mean"),
                 F.stddev_samp(x).alias(f"{c}|std"), F.stddev_pop(x).alias(f"{c}|std0"), F.count(x).alias(f"{c}|n")]
    return df.agg(*aggs).first().asDict()


def outlier_flag(c: str, stats: dict, limit: float = 3.0, least: int = 10) -> Column:
    """|z| > 3 with the population deviation; too few values or none varying -> none."""
    mean, dev, n = stats[f"{c}|mean"], stats[f"{c}|std0"], stats[f"{c}|n"]
    if n < least or not dev:
        return F.lit(False)
    return F.coalesce(F.abs((F.col(c) - mean) / dev) > limit, F.lit(False))


def duplicate_rows(df: DataFrame) -> int:
    """Copies beyond the first, by counting per distinct row (copies merge before the shuffle)."""
    row = df.groupBy(*df.columns).count().agg(F.sum(F.col("count") - 1).alias("d")).first()
    return row["d"] or 0


def quality_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, nulls, range, mean, deviation, outliers."""
    stats, numbers = profile_row(df), numeric_columns(df)
    counts = {}
    if numbers:
        counts = df.agg(*[F.count_if(outlier_flag(c, stats)).alias(c) for c in numbers]).first().asDict()
    rows = [
        (c, dict(df.dtypes)[c], stats["_rows"], stats[f"{c}|nulls"], *[stats.get(f"{c}|{k}") for k in ("min", "max", "mean", "std")],
         counts.get(c))
        for c in df.columns
    ]
    return df.sparkSession.createDataFrame(
        rows, "column string, type string, rows bigint, nulls bigint, low double, high double, mean double, std double, outliers bigint")


def quality_score(df: DataFrame) -> DataFrame:
    """0.5 (1 - missing) + 0.3 (1 - duplicates) + 0.2 (1 - outliers), each as a share, within [0, 1]."""
    profile = quality_profile(df)
    copies, width = duplicate_rows(df), len(df.columns)
    total = profile.agg(
        F.max("rows").alias("rows"), F.sum("nulls").alias("missing"), F.sum("outliers").alias("outliers"))
    cells = F.col("rows") * width
    score = (
        (1 - F.try_divide("missing", cells)) * 0.5
        + (1 - F.try_divide(F.lit(copies), F.col("rows"))) * 0.3
        + (1 - F.try_divide(F.coalesce("outliers", F.lit(0)), cells)) * 0.2
    )
    return total.withColumns({
        "duplicates": F.lit(copies).cast("bigint"),
        "score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)),
    })


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, all in one pass over the rows."""
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs]).first()
    return df.sparkSession.createDataFrame(
        [(a, b, row[f"{a}|{b}"]) for a, b in pairs], "left string, right string, correlation double")


def recommendations(df: DataFrame) -> DataFrame:
    """Rules over the profile and the correlations, one row per finding."""
    profile = {r["column"]: r for r in quality_profile(df).collect()}  # one row per column of the schema
    numbers, texts = numeric_columns(df), text_columns(df)
    rows = max((r["rows"] for r in profile.values()), default=0)
    out = []
    for c, r in profile.items():
        share = r["nulls"] / rows if rows else 0.0
        if share > 0.3:
            out.append(("high_missing", c, share))
        elif share > 0:
            out.append(("impute", c, share))
        if r["outliers"] and rows and r["outliers"] / rows > 0.1:
            out.append(("outliers", c, r["outliers"] / rows))
    copies = duplicate_rows(df)
    if copies:
        out.append(("duplicates", "*", float(copies)))
    out += [("encode", c, None) for c in texts]
    if rows < 1000:
        out.append(("few_rows", "*", float(rows)))
    if len(numbers) > 1:
        for r in correlation_pairs(df, numbers).collect():
            if r["correlation"] is not None and abs(r["correlation"]) > 0.9:
                out.append(("correlated", f"{r['left']},{r['right']}", abs(r["correlation"])))
    return df.sparkSession.createDataFrame(out, "rule string, column string, detail double")


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact number of distinct non-null values per column; copies merge before each shuffle."""
    parts = [
        df.where(F.col(c).isNotNull()).select(c).distinct().agg(F.count("*").alias("distinct_values"))
        .select(F.lit(c).alias("column"), "distinct_values") for c in columns]
    return reduce(DataFrame.unionByName, parts)


def redundant_features(df: DataFrame, columns: Sequence[str], limit: float = 0.95) -> list[str]:
    """Columns kept when each is dropped that correlates with an earlier kept one."""
    corr = {(r["left"], r["right"]): r["correlation"] for r in correlation_pairs(df, columns).collect()}
    kept: list[str] = []
    for c in columns:
        if all(abs(corr[(k, c)] or 0.0) <= limit for k in kept):
            kept.append(c)
    return kept
