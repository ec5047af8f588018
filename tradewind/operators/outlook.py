"""From trained models to booked orders: predictions, impacts, rotation, trades, sustainability, orders."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind import dims
from tradewind.functions.rowwise import clip
from tradewind.operators import disruption as D
from tradewind.operators import esg, ml, ports, sector, strategy
from tradewind.operators.vessels import latest
from tradewind.plans.chain import Chain

#: What a feature is where a port or lane has no figure for its last month.
DEFAULTS = {"congestion_index": D.PORT_DEFAULTS["congestion_index"], "load": 1.0, "wobble": D.LANE_DEFAULTS["rate_trend"]}
#: Stored scores and impacts keep so many places: the last bits of a sum depend on the order of its rows and shall not decide a later threshold.
PLACES = 9
#: A month counts as a disruption of its lane if shipments fall below this share of the month before.
DROP = 0.9


def default_models() -> dict[str, Pipeline]:
    """One line per score; any regressor or classifier of ``ml`` takes their place."""
    return {
        "congestion": ml.linear_regressor(["congestion_index"], "next_congestion"),
        "route": ml.linear_regressor(["load"], "dropped"),
        "volatility": ml.linear_regressor(["wobble"], "next_wobble"),
    }


def port_months(metrics: DataFrame) -> DataFrame:
    """Congestion of each port and month beside that of its next one. A port has one row a month."""
    rows = metrics.select("port_name", "ts", ports.congestion_index().alias("congestion_index"))
    return rows.withColumn("next_congestion", F.lead("congestion_index").over(Window.partitionBy("port_name").orderBy("ts")))


def lane_months(rates: DataFrame, regions: DataFrame) -> DataFrame:
    """Shipments, load against the lane's mean, spread of rates, and what the next month brings, per lane and month.

    Rates shrink to a row a month before any window; a lane has as many rows as months.
    """
    monthly = rates.groupBy("origin", "region_key", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month")).agg(
        F.count("*").alias("shipments"), F.avg("rate_40ft").alias("rate"), F.stddev_samp("rate_40ft").alias("spread"))
    named = monthly.join(regions.select(F.col("r_regionkey").alias("region_key"), "r_name"), "region_key")
    lane = Window.partitionBy("location")
    ahead = lane.orderBy("month")
    rows = named.select(
        F.col("origin").alias("scenario"), F.concat_ws("/", "origin", "r_name").alias("location"), "month", "shipments", (F.col("spread") / F.col("rate")).alias("wobble"))
    after = F.lead("shipments").over(ahead)
    return rows.withColumns({
        "load": F.col("shipments") / F.avg("shipments").over(lane),
        "dropped": F.when(after.isNotNull(), (after < F.col("shipments") * DROP).cast("double")),
        "next_wobble": F.lead("wobble").over(ahead)})


def _last(rows: DataFrame, key: str, ts: str, feature: str) -> DataFrame:
    """The last month of each key with its feature, or the feature's default."""
    return latest(rows, [key], [ts]).withColumn(feature, F.coalesce(feature, F.lit(DEFAULTS[feature])))


def _scored(train: DataFrame, label: str, feature: str, rows: DataFrame, model: Pipeline, out: str) -> DataFrame:
    """Rows with the model's answer: its probability where it is a classifier, else its value."""
    fitted = model.fit(train.where(F.col(label).isNotNull() & F.col(feature).isNotNull()))
    scored = ml.predict(fitted, rows, out)
    return scored.withColumn(out, F.col("probability_1")).drop("probability_1") if "probability_1" in scored.columns else scored


def scores(ports_by_month: DataFrame, lanes_by_month: DataFrame, models: Mapping[str, Pipeline], as_of: str) -> DataFrame:
    """Next month's congestion, disruption probability and volatility of every lane, from fitted models.

    ``opens_in`` is the number of days from ``as_of`` to the month that is predicted.
    """
    port = _scored(ports_by_month, "next_congestion", "congestion_index", _last(ports_by_month, "port_name", "ts", "congestion_index"), models["congestion"], "congestion")
    lanes = _last(_last(lanes_by_month, "location", "month", "load"), "location", "month", "wobble")
    lanes = _scored(lanes_by_month, "dropped", "load", lanes, models["route"], "route_p")
    lanes = _scored(lanes_by_month, "next_wobble", "wobble", lanes, models["volatility"], "volatility")
    joined = lanes.join(port.select(F.col("port_name").alias("scenario"), "congestion"), "scenario", "left")
    return joined.select(
        "scenario", "location", F.coalesce("congestion", F.lit(DEFAULTS["congestion_index"])).alias("congestion"), clip(F.col("route_p"), 0.0, 1.0).alias("route_p"), "volatility",
        F.datediff(F.add_months(F.to_date("month"), 1), F.lit(as_of).cast("date")).alias("opens_in"))


def predictions(scored: DataFrame) -> DataFrame:
    """Disruption records of the scores, each with the day it starts."""
    return D.predicted_disruptions(scored).select(
        "scenario", "location", "disruption_type", "probability", "severity_score", "duration_days", (F.col("opens_in") + F.col("lead_days")).alias("start_in_days"))


def company_rows(companies: DataFrame, impacts: DataFrame, predicted: DataFrame, sectors: DataFrame) -> DataFrame:
    """What the trade signals read of each company: its impact, the strongest probability of its scenario, its sector's recovery."""
    strongest = predicted.groupBy("scenario").agg(F.max("probability").alias("probability"))
    felt = impacts.select("symbol", F.col("predicted_impact_score").alias("impact_score"), F.col("key_risk_factors").alias("risk_factors"))
    recovery = sectors.select("scenario", "sector", F.col("recovery_time_estimate").alias("recovery_days"))
    return companies.join(felt, "symbol").join(strongest, "scenario", "left").join(recovery, ["scenario", "sector"], "left").withColumn(
        "probability", F.coalesce("probability", F.lit(0.0)))


TRADE = ["scenario", "origin", "symbol", "sector", "signal_type", "strength", "target_weight", "expected_return", "confidence", "risk_level", "entry_price",
         "stop_loss", "take_profit", "esg_note", "time_horizon"]


def trade_signals(rows: DataFrame, sectors: DataFrame, rotations: DataFrame, companies: DataFrame) -> DataFrame:
    """Company signals and the leaders and laggards of rotated sectors in one table, told apart by ``origin``."""
    own = strategy.company_signals(rows, sectors.select("scenario", "sector", "vulnerability_score")).withColumn("origin", F.lit("company"))
    none = F.lit(None).cast("string")
    rotated = strategy.sector_trade_signals(rotations, companies).withColumns({"origin": F.lit("sector"), "esg_note": none, "time_horizon": none})
    return own.select(*TRADE).unionByName(rotated.select(*TRADE))


ORDER = ["priority", "scenario", "origin", "symbol"]


def orders(trades: DataFrame, positions: DataFrame, capital: float) -> DataFrame:
    """Approved signals booked by adjusted strength x confidence x return, against an account without exposure."""
    worth = F.col("esg_adjusted_strength") * F.col("confidence") * F.abs("expected_return")
    approved = strategy.check_signals(trades, F.lit(0.0), F.lit(0.0)).where("approved")
    return strategy.book_orders(
        approved.withColumns({"priority": -F.round(worth, 9), "price": F.col("entry_price")}), positions, capital, ORDER)


class Outlook:
    """The stages in order, each stored under its name; ``tables`` gives the views they start from."""

    def __init__(self, tables, as_of: str, models: Mapping[str, Pipeline] | None = None, chain: Chain | None = None):
        self.t, self.as_of, self.models = tables, as_of, models or default_models()
        self.chain = chain or Chain(tables.spark)

    def _sums(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        def rounded() -> DataFrame:
            df = build()
            return df.withColumns({c: F.round(c, PLACES) for c, kind in df.dtypes if kind == "double"})

        return self.chain.table(name, rounded)

    def scores(self) -> DataFrame:
        def build():
            lanes = self.chain.table("lane_months", lambda: lane_months(self.t.lane_rates, self.t.region))
            harbours = self.chain.table("port_months", lambda: port_months(self.t.port_metrics))
            return scores(harbours, lanes, self.models, self.as_of)

        return self._sums("scores", build)

    def predictions(self) -> DataFrame:
        return self._sums("predictions", lambda: predictions(self.scores()))

    def companies(self) -> DataFrame:
        return self.chain.table("companies", lambda: self.t.companies)

    def company_impacts(self) -> DataFrame:
        return self._sums("company_impacts", lambda: D.company_impact(self.companies(), self.predictions()))

    def sector_impacts(self) -> DataFrame:
        def build():
            caps = self.companies().groupBy("sector_code").agg((F.sum(F.floor("market_cap").cast("bigint")) / 1e9).alias("market_cap"))
            return sector.sector_impact(self.predictions(), self.t.sectors, self.t.sensitivity, self.t.edges, caps)

        return self._sums("sector_impacts", build)

    def rotation_signals(self) -> DataFrame:
        def build():
            impacts = self.sector_impacts()
            return sector.rotation_signals(impacts, sector.propagate(impacts, self.t.sectors, self.t.edges))

        return self.chain.table("rotation_signals", build)

    def trade_signals(self) -> DataFrame:
        def build():
            rows = company_rows(self.companies(), self.company_impacts(), self.predictions(), self.sector_impacts())
            return trade_signals(rows, self.sector_impacts(), self.rotation_signals(), self.companies())

        return self.chain.table("trade_signals", build)

    def esg_signals(self) -> DataFrame:
        return self.chain.table("esg_signals", lambda: esg.adjust_signals(self.trade_signals(), self.t.esg_rated.drop("custkey"), self.t.sustainability))

    def orders(self) -> DataFrame:
        return self.chain.table("orders", lambda: orders(self.esg_signals(), self.t.positions, dims.LIMITS["capital"]))
