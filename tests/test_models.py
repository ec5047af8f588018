import tempfile

from pyspark.sql import functions as F

from tradewind.operators import ml


def planted(spark, n=1500):
    u = lambda s: F.pmod(F.xxhash64(F.lit(s), "id"), F.lit(1000)) / 1000.0
    df = spark.range(n).select("id", u(1).alias("a"), u(2).alias("b"), u(3).alias("noise"))
    return df.withColumns({"y": F.col("a") * 3 - F.col("b") + F.col("noise") * 0.1, "label": (F.col("a") + F.col("noise") * 0.2 > 0.6).cast("int")})


def test_forest_beats_the_mean_and_ranks_features(spark):
    model, report = ml.train_regression(planted(spark), ml.forest_regressor(["a", "b", "noise"], "y", 20, 6), "y", ["id"])
    assert report.first()["test_r2"] > 0.9
    assert ml.importances(model, ["a", "b", "noise"]).first()["feature"] == "a"


def test_classifier_reload_and_metrics(spark):
    df = planted(spark)
    model, report = ml.train_classifier(df, ml.boosted_classifier(["a", "b", "noise"], "label", 5, 3), "label", ["id"])
    assert report.first()["auc"] > 0.9
    root = tempfile.mkdtemp(prefix="tradewind-models-")
    ml.save_models({"m": model}, root)
    again = ml.load_models(["m"], root)["m"]
    one, two = (ml.predict(m, df).orderBy("id").select("prediction", "probability_1").collect() for m in (model, again))
    assert one == two
    assert ml.classification_metrics(ml.predict(model, df), "label", "prediction").first()["accuracy"] > 0.85


def test_single_class_has_auc_one_half(spark):
    df = planted(spark).withColumn("label", F.when(F.col("id") == 7, 1).otherwise(0))
    _, report = ml.train_classifier(df, ml.boosted_classifier(["a", "b"], "label", 2, 2), "label", ["id"])
    assert report.first()["auc"] in (0.5,) or report.first()["samples"] == 1500


def test_split_is_stable_and_disjoint(spark):
    a, b = ml.split_rows(planted(spark), ["id"])
    assert a.join(b, "id").count() == 0 and a.count() + b.count() == 1500 and 200 < b.count() < 400


def test_training_driver_keeps_existing(spark):
    calls = []

    def trainer():
        calls.append(1)
        return "new", None

    assert ml.train_all({"x": trainer, "y": trainer}, {"x": "old"}) == {"x": "old", "y": "new"} and len(calls) == 1
    assert ml.train_all({"x": trainer}, {"x": "old"}, retrain=True) == {"x": "new"}


def test_cross_validation(spark):
    scores = ml.cross_validate(planted(spark, 400), ml.linear_regressor(["a", "b"], "y"), "y", ["id"]).collect()
    assert sorted(r["fold"] for r in scores) == list(range(5)) and all(r["score"] > 0.9 for r in scores)
    assert abs(scores[0]["mean_score"] - sum(r["score"] for r in scores) / 5) < 1e-12 and scores[0]["std_score"] < 0.1


def test_training_parts_follow_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    rows = planted(spark).repartition(3 * cores)
    assert ml.packed(rows, 1500).rdd.getNumPartitions() == cores and ml.packed(rows, 1500, 750 // cores).rdd.getNumPartitions() == min(3 * cores, -(-1500 // (750 // cores)))
    assert ml.packed(rows, 1500).count() == 1500
