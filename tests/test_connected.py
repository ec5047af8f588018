"""The chain from models to orders: stored stages, other models, broken runs, and the manifest behind it."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from tradewind.operators import ml, outlook
from tradewind.plans.chain import Chain
from tradewind.session import shared_folder
from tradewind.sources.adapters import Tables
from tradewind.sources.manifest import Conflict, Manifest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def folder(spark):
    return f"{shared_folder(spark)}/test-{uuid.uuid4().hex}"


def test_manifest_moves_as_a_whole(spark):
    one = Manifest(spark, folder(spark))
    assert one.read() == (0, {})
    assert one.publish({"a": "x"}, 0) == 1 and one.read() == (1, {"a": "x"})
    with pytest.raises(Conflict):
        one.publish({"a": "y"}, 0)
    assert one.publish({"b": "é"}, 1) == 2 and Manifest(spark, one.root).read() == (2, {"b": "é"})


def test_stages_are_written_once_and_survive_a_break(spark):
    chain, built = Chain(spark, folder(spark)), []

    def first():
        built.append("first")
        return spark.range(5).withColumn("u", F.rand())

    def second(fail):
        built.append("second")
        rows = chain.table("first", first)
        if fail:
            raise RuntimeError("lost")
        return rows.agg(F.sum("u").alias("s"))

    with pytest.raises(RuntimeError):
        chain.table("second", lambda: second(True))
    assert chain.stages() == ["first"]
    again = Chain(spark, chain.folder)
    total = again.table("second", lambda: second(False)).first()["s"]
    assert built == ["second", "first", "second"]
    assert total == sum(r["u"] for r in again.table("first", first).collect()) and built.count("first") == 1
    empty = chain.table("empty", lambda: spark.range(0).withColumn("x", F.array(F.lit(1.5))))
    assert empty.count() == 0 and dict(empty.dtypes)["x"] == "array<double>"


def test_other_models_take_the_lines_place(spark):
    """Forests and boosting run the same chain; every stage stands on the stored one before it."""
    models = {
        "congestion": ml.forest_regressor(["congestion_index"], "next_congestion", 5, 4),
        "route": ml.boosted_classifier(["load"], "dropped", 3, 3),
        "volatility": ml.forest_regressor(["wobble"], "next_wobble", 5, 4)}
    out = outlook.Outlook(Tables(spark, SF), "2001-11-26", models)
    orders = out.orders()
    scores = out.scores().collect()
    assert scores and all(0 <= r["route_p"] <= 1 for r in scores) and len({r["route_p"] for r in scores}) > 1
    assert all(r["probability"] > 0.3 for r in out.predictions().collect())
    stages = out.chain.stages()
    assert {"scores", "predictions", "company_impacts", "sector_impacts", "rotation_signals", "trade_signals", "esg_signals", "orders"} <= set(stages)
    assert out.esg_signals().count() == out.trade_signals().count()
    assert orders.where("traded = 0").count() == 0
    booked = {(r["scenario"], r["origin"], r["symbol"]) for r in orders.collect()}
    traded = {(r["scenario"], r["origin"], r["symbol"]) for r in out.trade_signals().collect()}
    assert booked <= traded


def test_missing_months_and_figures_have_defaults(spark):
    rows = spark.createDataFrame([("A", "A/x", "2001-01-01 00:00:00", 4, None, 1.0, None, None), ("B", "B/x", "2001-01-01 00:00:00", 4, 0.2, 1.0, 1.0, 0.3), ("C", "C/x", "2001-01-01 00:00:00", 6, 0.4, 2.0, 0.0, 0.5)],
                                 "scenario string, location string, month string, shipments long, wobble double, load double, dropped double, next_wobble double").withColumn("month", F.col("month").cast("timestamp_ntz"))
    ports = spark.createDataFrame([("B", "2001-01-01 00:00:00", 0.5, 0.6), ("C", "2001-01-01 00:00:00", 0.7, 0.8)], "port_name string, ts string, congestion_index double, next_congestion double")
    got = {r["scenario"]: r for r in outlook.scores(ports, rows, outlook.default_models(), "2001-01-20").collect()}
    assert abs(got["A"]["congestion"] - 0.7) < 1e-9 and abs(got["B"]["congestion"] - 0.6) < 1e-9
    assert abs(got["A"]["volatility"] - 0.15) < 1e-9 and abs(got["C"]["volatility"] - 0.5) < 1e-9  # 0.1 + wobble, 0.05 where unknown
    assert got["A"]["route_p"] == pytest.approx(1.0) and got["C"]["route_p"] == pytest.approx(0.0) and got["A"]["opens_in"] == 12
