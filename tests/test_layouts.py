"""The split layouts give what the plain windows give."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import same, series_frame
from tradewind.operators import clean, series, strategy, vessels
from tradewind.plans import blocks
from tradewind.plans.blocks import is_hot, over_blocks, running, with_position

HOT = {"hot_rows": 70}


@pytest.fixture(scope="module")
def frame(spark):
    return series_frame(spark).persist()


CASES = {
    "lags": lambda d, **k: series.lag_features(d, ["price", "volume"], **k),
    "rolling": lambda d, **k: series.rolling_features(d, ["price"], (7, 30), **k),
    "rolling_full": lambda d, **k: series.rolling_features(d, ["volume"], (7, 60), ("mean", "std"), only_full=True, **k),
    "sma": lambda d, **k: series.moving_averages(d, "volume", **k),
    "rsi": lambda d, **k: series.rsi(d, "volume", **k),
    "bollinger": lambda d, **k: series.bollinger(d, "volume", **k),
    "change": lambda d, **k: series.change_features(d, "volume", **k),
    "padded": lambda d, **k: series.padded_change(d, "price", (1, 5), **k),
    "volume": lambda d, **k: series.volume_features(d, "price", "volume", **k),
    "decompose": lambda d, **k: series.decompose(d, "volume", **k),
    "diff": lambda d, **k: series.differences(d, "price", 3, **k),
    "lead": lambda d, **k: series.lead_labels(d, "volume", 7, **k),
    "forward": lambda d, **k: series.fill(d, "price", "filled", **k),
    "backward": lambda d, **k: series.fill(d, "price", "filled", backward=True, **k),
    "change_volatility": lambda d, **k: series.change_volatility(d, "volume", **k),
    "ema": lambda d, **k: series.ema(d, "price", (5, 10), **k),
    "macd": lambda d, **k: series.macd(d, "volume", **k),
    "percentile": lambda d, **k: series.percentile_ranks(d, "price", **k),
    "interpolate": lambda d, **k: clean.interpolate(d, "price", "filled", **k),
}


@pytest.mark.parametrize("name", CASES)
def test_split_layout_equals_plain(frame, name):
    plain, split = CASES[name](frame), CASES[name](frame, **HOT)
    same(plain, split, ["id"], 1e-9)


def test_hotness_is_measured(frame):
    assert is_hot(frame, ["series_id"], 70) and not is_hot(frame, ["series_id"], 1000)
    assert is_hot(frame, [], 900) and not is_hot(frame, [], 2000)


@pytest.mark.parametrize("keys", [[], ["series_id"]])
def test_positions_and_totals(frame, keys):
    order = ["ts", "id"]
    for kw in ({"hot_rows": 10_000}, {"hot_rows": 60}):
        got = {r["id"]: r["p"] for r in with_position(frame, keys, order, out="p", **kw).collect()}
        pdf = frame.toPandas().sort_values(order)
        want = (pdf.groupby("series_id").cumcount() if keys else pd.Series(range(len(pdf)), index=pdf.index))
        assert got == dict(zip(pdf["id"], want))
        out = running(frame, keys, order, {"s": ("sum", F.col("price")), "m": ("max", F.col("volume")), "l": ("last", F.col("price"))}, **kw)
        got = {r["id"]: (r["s"], r["m"], r["l"]) for r in out.collect()}
        g = pdf.groupby("series_id") if keys else pdf
        total = (g["price"].apply(lambda s: s.fillna(0).cumsum()).droplevel(0) if keys else pdf["price"].fillna(0).cumsum())
        top, last = g["volume"].cummax(), g["price"].ffill()
        for i, idx in zip(pdf["id"], pdf.index):
            assert (got[i][0] or 0.0) == pytest.approx(total[idx])
            assert got[i][1] == top[idx]
            assert got[i][2] == last[idx] or (got[i][2] is None and pd.isna(last[idx]))


def test_one_long_series_without_key(frame):
    cols = lambda w: {"m": F.avg("volume").over(w.rowsBetween(-59, 0)), "n": F.lead("volume", 2).over(w)}
    same(over_blocks(frame, [], ["ts", "id"], cols, back=59, ahead=2, hot_rows=5000),
         over_blocks(frame, [], ["ts", "id"], cols, back=59, ahead=2, hot_rows=100), ["id"])


def test_ema_matches_pandas(frame):
    got = {r["id"]: r["price_ema_5"] for r in series.ema(frame, "price", (5, 50)).collect()}
    got50 = {r["id"]: r["price_ema_50"] for r in series.ema(frame, "price", (50,)).collect()}
    for _, g in frame.toPandas().sort_values(["ts", "id"]).groupby("series_id"):
        for span, values in ((5, got), (50, got50)):
            for i, want in zip(g["id"], g["price"].ewm(span=span).mean()):
                assert values[i] is None if pd.isna(want) else values[i] == pytest.approx(want, rel=1e-9)


def test_ema_blocks_longer_than_one(frame):
    long = frame.sparkSession.range(5000).select(
        F.lit("x").alias("series_id"), F.col("id").alias("ts"), "id", (F.col("id") * 37 % 101).cast("double").alias("price"))
    got = [r["e"] for r in series.ema(long, "price", (5,), {5: "e"}).orderBy("id").collect()]
    want = pd.Series([float(i * 37 % 101) for i in range(5000)]).ewm(span=5).mean()
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-9


def test_time_frames_in_blocks(frame):
    spans = {"minute": 60, "hour": 3600}
    same(vessels.requests_before(frame, ["series_id"], "ts", spans, hot_rows=10_000),
         vessels.requests_before(frame, ["series_id"], "ts", spans, hot_rows=70), ["id"])


def test_booking_in_blocks(spark):
    orders = spark.range(400).select(
        F.concat(F.lit("S"), F.col("id") % 3).alias("symbol"), F.col("id").alias("seq"),
        ((F.col("id") * 7 % 11 - 5) / 100.0).alias("target_weight"), (F.lit(10.0) + F.col("id") % 5).alias("price"))
    held = spark.createDataFrame([("S1", 50, 9.0)], "symbol string, shares bigint, entry_price double")
    same(strategy.book_orders(orders, held, 1e6), strategy.book_orders(orders, held, 1e6, hot_rows=50), ["seq"])


def test_order_booking_carries_no_derived_columns(spark, monkeypatch):
    """Shuffles and stored rows hold what the orders need; sizes, action, turnover and gains come after them, and the rows are counted once."""
    carried, counted = [], []
    cut = blocks.with_chunks
    monkeypatch.setattr(blocks, "with_chunks", lambda df, *a, **kw: carried.append(df.columns) or counted.append(kw.get("rows")) or cut(df, *a, **kw))
    orders = spark.range(300).select(
        F.concat(F.lit("s"), F.col("id") % 5).alias("symbol"), F.col("id").alias("seq"), ((F.col("id") % 4 + 1) / 100.0).alias("target_weight"), (F.col("id") % 9 + 1.0).alias("price"))
    held = spark.createDataFrame([("s1", 10, 2.0)], "symbol string, shares bigint, entry_price double")
    out = strategy.book_orders(orders, held, 1e6, hot_rows=50)
    assert not {"action", "turnover", "unrealized_pnl", "dollars", "sized_weight", "shares"} & set(carried[-1]) and counted[-1]
    assert out.columns == ["symbol", "seq", "target_weight", "price", "dollars", "sized_weight", "target_shares", "action", "traded", "turnover", "unrealized_pnl", "cash"]
