"""Wall time of the headline queries; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import tradewind.catalog.all  # noqa: E402,F401
from tradewind.catalog import QUERIES  # noqa: E402
from tradewind.session import local_session  # noqa: E402

HEADLINE = [
    "lane_volatility", "route_volatility_overall", "lane_forecast", "area_congestion", "port_congestion_index", "latest_position",
    "vessel_dedup_first_feed", "lag_features", "rolling_features", "exponential_moving_averages", "macd", "bollinger_bands",
    "seasonal_decomposition", "forward_fill", "group_percentile_rank", "requests_in_window", "calendar_parts", "cyclic_encodings",
    "quality_profile", "correlation_pairs", "impute_median", "outlier_capping", "cleaning_chain", "scale_standard", "select_by_f_test",
    "mutual_information", "position_feed_upper", "port_page_numbers", "text_congestion", "upsert", "all_disruptions", "company_impact",
    "shipment_disruption_labels", "sector_impact", "cross_sector_impact", "rotation_signals", "company_trade_signals", "order_booking",
    "mark_to_market", "portfolio_metrics", "performance_metrics", "backtest", "return_covariance", "provider_merge", "composite_scores",
    "esg_adjusted_signals", "operation_timing", "unit_root_test", "level_stationarity_test", "feature_engineering_full", "outliers_isolation_forest",
    "series_forest_anomalies", "impute_nearest", "pipeline_orders", "stream_upsert", "train_rate_volatility", "sector_correlation",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "tradewind-bench")
    QUERIES["operation_timing"].run(spark, sf_dir).collect()  # start-up is not part of any query
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
        "lineitem_rows": lines}))
    spark.stop()


if __name__ == "__main__":
    main()
