import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tradewind.functions import quantiles
from tradewind.functions.quantiles import exact_quantiles, modes


@pytest.mark.parametrize("kind", ["spread", "ties", "skewed"])
def test_narrowed_quantiles_are_exact(spark, kind):
    rng = random.Random(3)
    make = {"spread": lambda: rng.gauss(0, 1), "ties": lambda: float(rng.randint(0, 4)),
            "skewed": lambda: 1.0 if rng.random() < 0.4 else rng.expovariate(1) * 100}[kind]
    values = [make() for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, ["x"], probs, small=60)["x"]
    assert got == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)
    assert exact_quantiles(df, ["x"], probs)["x"] == pytest.approx(got)


@pytest.mark.parametrize("small", [5, 40, 10_000])
def test_columns_together_with_gaps_and_heavy_values(spark, small):
    """NaN and NULL are skipped on every path; one value may fill most of a column."""
    rng = random.Random(8)
    rows = []
    for i in range(2500):
        a = float("nan") if i % 7 == 0 else None if i % 11 == 0 else rng.gauss(0, 1)
        b = 3.0 if rng.random() < 0.97 else rng.uniform(2.9, 3.1)
        rows.append((a, b, 5 if i % 2 else -5, None, 1.0 if i == 0 else None))
    df = spark.createDataFrame(rows, "a double, b double, c int, d double, e double").repartition(7)
    probs = [i / 20 for i in range(21)]
    got = exact_quantiles(df, ["a", "b", "c", "d", "e"], probs, small=small)
    for k, c in enumerate("abc"):
        held = [float(r[k]) for r in rows if r[k] is not None and r[k] == r[k]]
        assert got[c] == pytest.approx(list(np.quantile(held, probs)), rel=1e-12)
    assert got["d"] == [None] * 21 and got["e"] == [1.0] * 21


def test_no_bracket_exceeds_its_bound(spark, monkeypatch):
    """What one task sorts stays within the bound, whatever the number of probabilities."""
    seen = []
    plain = quantiles._ranked
    monkeypatch.setattr(quantiles, "_ranked", lambda values, rest: seen.extend(b.n for b in rest) or plain(values, rest))
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).cast("double").alias("x"))
    got = exact_quantiles(df, ["x"], [i / 100 for i in range(101)], small=300)["x"]
    assert got == pytest.approx(list(np.quantile(np.arange(20_000.0), [i / 100 for i in range(101)])))
    assert seen and max(seen) <= 300


def test_empty_column_and_modes(spark):
    df = spark.createDataFrame([(None, "b", 2), (None, "a", 2), (None, "a", 1), (None, "b", 1), (None, None, None)], "x double, s string, n int")
    assert exact_quantiles(df, ["x"], [0.5])["x"] == [None]
    assert modes(df, ["x", "s", "n"]) == {"x": None, "s": "a", "n": 1}
