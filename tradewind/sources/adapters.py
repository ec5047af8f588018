"""Domain views over the given tables.

Each view exists twice: as a DataFrame built by :class:`Tables` and as the text
of a SQL view in ``VIEWS`` for the twin queries. Column formulas that both
dialects read alike are written once. Views derive columns from every row of
their tables; none samples or cuts rows.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind import dims

EVENTS_AS_OF = "2024-01-31 00:00:00"
RATES_AS_OF = "1998-06-01 00:00:00"
RATES_DAYS = 365

# Formulas read alike by both dialects --------------------------------------
SERIES = {
    "series_id": "user_id",
    "ts": "ts",
    "id": "event_id",
    "price": "value",
    "volume": "event_id % 97 + 1",
}
GAPS = {
    "id": "event_id",
    "series_id": "user_id",
    "ts": "ts",
    "price": "CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 211 = 0 THEN value * 20 ELSE value END",
    "volume": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id % 97 + 1 AS DOUBLE) END",
    "ratio": "value / (event_id % 7 + 1)",
    "kind": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_type END",
}
VESSELS = {
    "mmsi": "user_id",
    "seq": "event_id",
    "source": "CAST(event_id % 2 AS INT)",
    "ts": "ts",
    "area_hint": "CAST(event_id % 5 AS INT)",
    "latitude": (
        "CASE event_id % 5 WHEN 0 THEN 29.0 + (event_id % 31) / 10.0 WHEN 1 THEN 8.0 + (event_id % 21) / 10.0 "
        "WHEN 2 THEN (event_id % 71) / 10.0 WHEN 3 THEN 33.25 + (event_id % 10) / 10.0 "
        "ELSE -80.0 + event_id % 180 END"
    ),
    "longitude": (
        "CASE event_id % 5 WHEN 0 THEN 31.5 + (event_id % 21) / 10.0 WHEN 1 THEN -80.5 + (event_id % 19) / 10.0 "
        "WHEN 2 THEN 99.0 + (event_id % 67) / 10.0 WHEN 3 THEN -118.75 + (event_id % 9) / 10.0 "
        "ELSE -170.0 + event_id % 360 END"
    ),
    "speed": "CAST(event_id % 13 AS DOUBLE) - 1.0",
    "vessel_name": "CASE WHEN event_id % 19 = 0 THEN '' ELSE concat('Vessel ', CAST(user_id AS STRING)) END",
    "vessel_type": "event_type",
}
COMPANIES = {
    "custkey": "c_custkey",
    "symbol": "concat('C', CAST(c_custkey AS STRING))",
    "company_name": "c_name",
    "scenario": "n_name",
    "sector_code": "CAST(10 + 5 * (c_custkey % 11) AS STRING)",
    "supply_chain_complexity": "(c_custkey % 10) / 10.0",
    "international_exposure": "(c_custkey % 7) / 6.0",
    "inventory_turnover": "(c_custkey % 23) / 2.0",
    "market_cap": "(c_acctbal + 1000.0) * 100000000.0",
    "data_quality": "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE (c_custkey % 9) / 9.0 END",
    "liquidity_score": "CASE WHEN c_custkey % 14 = 0 THEN NULL ELSE (c_custkey % 14) / 14.0 END",
    "beta": "0.5 + (c_custkey % 16) / 10.0",
    "debt_to_equity": "(c_custkey % 15) / 10.0",
    "current_price": "CASE WHEN c_custkey % 20 = 0 THEN NULL ELSE 20.0 + c_custkey % 180 END",
    "esg_score": "CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE CAST((c_custkey * 37) % 101 AS DOUBLE) END",
}
ESG_SECTIONS = {
    "environmental": ("carbon_emissions", "water_usage", "waste_management", "renewable_energy", "biodiversity"),
    "social": ("labor_practices", "human_rights", "community_impact", "product_safety", "supply_chain_labor"),
    "governance": (
        "board_composition", "executive_compensation", "transparency", "ethics_compliance", "shareholder_rights"),
    "supply_chain": ("supply_chain_transparency", "supplier_diversity", "conflict_minerals", "forced_labor_risk"),
    "climate": ("physical_climate_risk", "transition_climate_risk", "climate_adaptation"),
}
ESG_FIELDS = [f for fields in ESG_SECTIONS.values() for f in fields]
PROVIDERS = ("MSCI", "Sustainalytics", "Refinitiv", "CDP")
SUSTAINABILITY_FIELDS = (
    "living_wage_pct", "women_owned_pct", "low_carbon_transport_pct", "recycled_content_pct")


def _esg_formula(i: int, provider: int) -> str:
    return f"CAST((c_custkey * {2 * i + 3} + {17 * i + 29 * provider}) % 101 AS DOUBLE)"


def _esg_columns(provider: int) -> dict[str, str]:
    """One provider's row: whole sections can be missing, single fields too."""
    out = {
        "custkey": "c_custkey",
        "symbol": "concat('C', CAST(c_custkey AS STRING))",
        "provider": f"'{PROVIDERS[provider]}'",
        "provider_rank": f"{provider + 1}",
    }
    for s, (section, fields) in enumerate(ESG_SECTIONS.items()):
        out[f"has_{section}"] = f"(c_custkey + {s} + {provider}) % 3 <> 0"
        for field in fields:
            i = ESG_FIELDS.index(field)
            out[field] = (
                f"CASE WHEN (c_custkey + {i + provider}) % 8 = 0 THEN NULL ELSE {_esg_formula(i, provider)} END"
            )
    return out


# Each provider leaves one market segment out.
UNCOVERED = ("FURNITURE", "MACHINERY", "BUILDING", "AUTOMOBILE")


def _esg_present(provider: int) -> str:
    return f"c_mktsegment <> '{UNCOVERED[provider]}'"


def _esg_score_columns() -> dict[str, str]:
    out = {
        "custkey": "c_custkey",
        "symbol": "concat('C', CAST(c_custkey AS STRING))",
        "sector_code": "CAST(10 + 5 * (c_custkey % 11) AS STRING)",
        "overall": "CAST((c_custkey * 41) % 101 AS DOUBLE)",
        "environmental": "CAST((c_custkey * 43) % 101 AS DOUBLE)",
        "social": "CAST((c_custkey * 47) % 101 AS DOUBLE)",
        "governance": "CAST((c_custkey * 53) % 101 AS DOUBLE)",
    }
    for i, field in enumerate(ESG_FIELDS):
        out[field] = _esg_formula(i, 0)
    return out


def _select(columns: dict[str, str], dialect: str = "spark") -> list[str]:
    def fix(text: str) -> str:
        text = re.sub(r"\b(\d+\.\d+)\b", r"\1e0", text)  # both dialects read 1.0e0 as a double
        return text if dialect == "spark" else text.replace("AS STRING", "AS VARCHAR")

    return [f"{fix(expr)} AS {name}" for name, expr in columns.items()]


def _sql(columns: dict[str, str], rest: str) -> str:
    return "SELECT " + ", ".join(_select(columns, "duckdb")) + " " + rest


def _values(rows, columns: str) -> str:
    def lit(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


SECTOR_ROWS = [(s[0], s[1], s[3], s[4], *map(float, s[5])) for s in dims.SECTORS]
SECTOR_COLUMNS = (
    "sector_code string, sector string, delay int, recovery int, bench_e double, bench_s double, "
    "bench_g double, bench_chain double, bench_climate double")
SENSITIVITY_ROWS = [
    (s[0], kind, weight) for s in dims.SECTORS for kind, weight in zip(dims.DISRUPTION_TYPES, s[2])]

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "series": ((), _sql(SERIES, "FROM events")),
    "series_gaps": ((), _sql(GAPS, "FROM events")),
    "vessel_positions": ((), _sql(VESSELS, "FROM events")),
    "areas": ((), _values(dims.AREAS, "area, lat_lo, lat_hi, lon_lo, lon_hi")),
    "sectors": ((), _values(SECTOR_ROWS, ", ".join(c.split()[0] for c in SECTOR_COLUMNS.split(", ")))),
    "sensitivity": ((), _values(SENSITIVITY_ROWS, "sector_code, disruption_type, sensitivity")),
    "edges": ((), _values(dims.EDGES, "src, dst, weight")),
    "lane_rates": ((), """
        SELECT sn.n_name AS origin, cn.n_name AS destination, cn.n_regionkey AS region_key,
               l_extendedprice / l_quantity AS rate_40ft, l_quantity AS quantity, l_linenumber AS line,
               l_shipdate AS ts, l_orderkey AS k1, l_partkey AS k2, l_suppkey AS k3
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
        JOIN supplier ON s_suppkey = l_suppkey
        JOIN nation sn ON sn.n_nationkey = s_nationkey JOIN nation cn ON cn.n_nationkey = c_nationkey"""),
    "lane_stress": (("lane_rates",), """
        SELECT origin AS scenario, concat(origin, '/', r_name) AS location,
               (count(*) % 101) / 100.0 AS congestion,
               CAST(sum(CAST(quantity AS BIGINT)) AS BIGINT) % 97 / 96.0 AS route_p,
               CAST(sum(line) AS BIGINT) % 89 / 200.0 AS volatility,
               CAST((count(*) + CAST(sum(line) AS BIGINT)) % 46 - 5 AS INTEGER) AS start_in_days
        FROM lane_rates JOIN region ON r_regionkey = region_key GROUP BY origin, r_name"""),
    "disruptions": (("lane_stress",), """
        SELECT scenario, location, 'port_congestion' AS disruption_type,
               least(1.0, greatest(0.0, (congestion - 0.5) * 2)) AS probability,
               least(10.0, congestion * 10) AS severity_score, start_in_days
        FROM lane_stress WHERE (congestion - 0.5) * 2 > 0.3
        UNION ALL
        SELECT scenario, location, 'route_blockage', route_p, least(10.0, route_p * 8 + 2), start_in_days + 1
        FROM lane_stress WHERE route_p > 0.3
        UNION ALL
        SELECT scenario, location, 'rate_spike', least(1.0, volatility * 3), least(10.0, volatility * 20),
               start_in_days + 2
        FROM lane_stress WHERE least(1.0, volatility * 3) > 0.4"""),
    "companies": (("sectors",), "SELECT c.*, s.sector FROM (" + _sql(
        COMPANIES, "FROM customer JOIN nation ON n_nationkey = c_nationkey") + ") c JOIN sectors s USING (sector_code)"),
    "esg_raw": ((), " UNION ALL ".join(
        _sql(_esg_columns(p), f"FROM customer WHERE {_esg_present(p)}") for p in range(4))),
    "esg_scores": ((), _sql(_esg_score_columns(), "FROM customer")),
    # companies that no provider of overall scores has rated: their signals meet no score
    "esg_rated": (("esg_scores",), "SELECT e.* FROM esg_scores e JOIN customer ON c_custkey = custkey WHERE c_mktsegment <> 'FURNITURE'"),
    "sustainability": ((), _sql({
        "symbol": "concat('C', CAST(c_custkey AS STRING))",
        **{f: f"CAST((c_custkey * {7 + 4 * i}) % 101 AS DOUBLE)" for i, f in enumerate(SUSTAINABILITY_FIELDS)},
    }, "FROM customer WHERE c_acctbal > 0")),
    "port_metrics": ((), """
        SELECT n_name AS port_name, date_trunc('month', o_orderdate) AS ts, count(*) AS vessel_arrivals,
               sum(CAST(floor(o_totalprice) AS BIGINT)) / 1000.0 AS throughput,
               CASE WHEN count(*) % 7 = 0 THEN NULL ELSE (count(*) * 13 % 100) / 100.0 END AS berth_utilization,
               CASE WHEN count(*) % 5 = 0 THEN NULL ELSE CAST(count(*) * 7 % 72 AS DOUBLE) END AS avg_waiting_time,
               CASE WHEN count(*) % 4 = 0 THEN NULL ELSE CAST(count(*) * 11 % 30 AS BIGINT) END AS queue_length,
               CASE WHEN count(*) % 3 = 0 THEN NULL ELSE (count(*) * 17 % 50) / 50.0 END AS storage_utilization
        FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
        GROUP BY n_name, date_trunc('month', o_orderdate)"""),
    "sector_impacts": (("companies",), """
        SELECT scenario, sector_code, sector, avg(supply_chain_complexity) * 10 AS vulnerability_score,
               (CAST(sum(custkey) AS BIGINT) % 201) / 10.0 - 10.0 AS current_impact,
               (CAST(sum(custkey) AS BIGINT) % 187) / 10.0 - 10.0 AS predicted_impact_7d,
               (CAST(sum(custkey) AS BIGINT) % 161) / 8.0 - 10.0 AS predicted_impact_30d,
               sum(CAST(floor(market_cap) AS BIGINT)) / 1000000.0 AS market_cap, count(*) AS companies
        FROM companies GROUP BY scenario, sector_code, sector"""),
    "company_impacts": (("companies",), """
        SELECT symbol, company_name, sector, scenario, custkey,
               (custkey % 41) / 2.0 - 10.0 AS impact_score, (custkey % 21) / 20.0 AS probability,
               CASE WHEN custkey % 4 = 0 THEN 0 WHEN custkey % 4 = 1 THEN 1 WHEN custkey % 4 = 2 THEN 2 ELSE 3 END
                   AS n_factors,
               custkey % 150 AS recovery_days, data_quality, liquidity_score, esg_score, beta, debt_to_equity,
               current_price
        FROM companies"""),
    "prices": ((), """
        SELECT p_brand AS symbol, p_type AS sector, date_trunc('month', l_shipdate) AS day,
               sum(l_extendedprice) / sum(l_quantity) AS price, sum(l_quantity) AS volume
        FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL"""),
    "positions": ((), """
        SELECT concat('P', CAST(p_partkey AS VARCHAR)) AS symbol, p_type AS sector, p_brand AS book,
               CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE 1 END * CAST(p_size AS BIGINT) AS shares,
               p_retailprice AS entry_price, p_partkey
        FROM part"""),
    "ticks": ((), """
        SELECT concat('P', CAST(l_partkey AS VARCHAR)) AS symbol, l_shipdate AS ts,
               l_extendedprice / l_quantity AS price, l_orderkey AS k1, l_suppkey AS k2, l_linenumber AS k3
        FROM lineitem"""),
    "request_log": ((), """
        SELECT event_type AS service, ts, event_id AS id, value / 100 AS duration, user_id AS client,
               event_id % 29 = 0 AS failed, event_id % 3 = 0 AS cached FROM events"""),
}


def with_views(sql: str, uses: list[str]) -> str:
    """Prefix ``sql`` with the views it needs, dependencies first."""
    order: list[str] = []

    def visit(name: str):
        for parent in VIEWS[name][0]:
            visit(parent)
        if name not in order:
            order.append(name)

    for name in uses:
        visit(name)
    if not order:
        return sql
    heads = ", ".join(f"{name} AS ({VIEWS[name][1]})" for name in order)
    text = sql.strip()
    if text.upper().startswith("WITH "):
        return f"WITH {heads}, {text[5:]}"
    return f"WITH {heads} {text}"


class Tables:
    """Lazy access to the given tables and the domain views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, str(sf_dir).rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLE_NAMES:
            raise AttributeError(name)
        return self.table(name)

    def _view(self, base: DataFrame, columns: dict[str, str]) -> DataFrame:
        return base.selectExpr(*_select(columns))

    @cached_property
    def series(self) -> DataFrame:
        return self._view(self.events, SERIES)

    @cached_property
    def series_gaps(self) -> DataFrame:
        return self._view(self.events, GAPS)

    @cached_property
    def vessel_positions(self) -> DataFrame:
        return self._view(self.events, VESSELS)

    @cached_property
    def sectors(self) -> DataFrame:
        return dims.frame(self.spark, SECTOR_ROWS, SECTOR_COLUMNS)

    @cached_property
    def sensitivity(self) -> DataFrame:
        return dims.frame(
            self.spark, SENSITIVITY_ROWS, "sector_code string, disruption_type string, sensitivity double")

    @cached_property
    def edges(self) -> DataFrame:
        return dims.frame(self.spark, dims.EDGES, "src string, dst string, weight double")

    @cached_property
    def lane_rates(self) -> DataFrame:
        origin = self.nation.select(
            F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("origin"))
        destination = self.nation.select(
            F.col("n_nationkey").alias("c_nationkey"),
            F.col("n_name").alias("destination"),
            F.col("n_regionkey").alias("region_key"),
        )
        lines = self.lineitem.withColumnRenamed("l_orderkey", "o_orderkey").withColumnRenamed("l_suppkey", "s_suppkey")
        orders = self.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
        customers = self.customer.select("c_custkey", "c_nationkey")
        suppliers = self.supplier.select("s_suppkey", "s_nationkey")
        # suppliers and customers meet no nation before the lines: Spark takes the size of a join for the product of
        # both sides, would broadcast neither and shuffle the lines by supplier too; names would be shuffled with them
        return (
            lines.join(suppliers, "s_suppkey")
            .join(orders.join(customers, "c_custkey"), "o_orderkey")
            .join(origin, "s_nationkey")
            .join(destination, "c_nationkey")
            .select(
                "origin", "destination", "region_key",
                (F.col("l_extendedprice") / F.col("l_quantity")).alias("rate_40ft"),
                F.col("l_quantity").alias("quantity"), F.col("l_linenumber").alias("line"),
                F.col("l_shipdate").alias("ts"), F.col("o_orderkey").alias("k1"),
                F.col("l_partkey").alias("k2"), F.col("s_suppkey").alias("k3"),
            )
        )

    @cached_property
    def lane_stress(self) -> DataFrame:
        regions = self.region.select(F.col("r_regionkey").alias("region_key"), "r_name")
        totals = self.lane_rates.groupBy("origin", "region_key").agg(
            F.count("*").alias("n"),
            F.sum(F.col("quantity").cast("bigint")).alias("q"),
            F.sum("line").alias("s"),
        )
        return totals.join(regions, "region_key").select(
            F.col("origin").alias("scenario"),
            F.concat_ws("/", "origin", "r_name").alias("location"),
            (F.col("n") % 101 / 100.0).alias("congestion"),
            (F.col("q") % 97 / 96.0).alias("route_p"),
            (F.col("s") % 89 / 200.0).alias("volatility"),
            ((F.col("n") + F.col("s")) % 46 - 5).cast("int").alias("start_in_days"),
        )

    @cached_property
    def disruptions(self) -> DataFrame:
        from tradewind.operators.disruption import predicted_disruptions

        return predicted_disruptions(self.lane_stress).select(
            "scenario", "location", "disruption_type", "probability", "severity_score",
            (F.col("start_in_days") + F.col("lead_days") - 1).cast("int").alias("start_in_days"),
        )

    @cached_property
    def companies(self) -> DataFrame:
        home = self.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
        return self._view(self.customer.join(home, "c_nationkey"), COMPANIES).join(
            self.sectors.select("sector_code", "sector"), "sector_code")

    @cached_property
    def esg_raw(self) -> DataFrame:
        parts = [
            self._view(self.customer.where(_esg_present(p)), _esg_columns(p)) for p in range(len(PROVIDERS))]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    @cached_property
    def esg_scores(self) -> DataFrame:
        return self._view(self.customer, _esg_score_columns())

    @cached_property
    def esg_rated(self) -> DataFrame:
        return self._view(self.customer.where("c_mktsegment <> 'FURNITURE'"), _esg_score_columns())

    @cached_property
    def sustainability(self) -> DataFrame:
        return self._view(self.customer.where("c_acctbal > 0"), {
            "symbol": "concat('C', CAST(c_custkey AS STRING))",
            **{f: f"CAST((c_custkey * {7 + 4 * i}) % 101 AS DOUBLE)" for i, f in enumerate(SUSTAINABILITY_FIELDS)},
        })

    @cached_property
    def port_metrics(self) -> DataFrame:
        home = self.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("port_name"))
        buyers = self.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(home, "c_nationkey")
        n = F.col("vessel_arrivals")
        return (
            self.orders.select("o_custkey", "o_orderdate", "o_totalprice")
            .join(buyers, "o_custkey")
            .groupBy("port_name", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("ts"))
            .agg(F.count("*").alias("vessel_arrivals"),
                 (F.sum(F.floor("o_totalprice").cast("bigint")) / 1000.0).alias("throughput"))
            .select(
                "port_name", "ts", "vessel_arrivals", "throughput",
                F.when(n % 7 != 0, n * 13 % 100 / 100.0).alias("berth_utilization"),
                F.when(n % 5 != 0, (n * 7 % 72).cast("double")).alias("avg_waiting_time"),
                F.when(n % 4 != 0, n * 11 % 30).alias("queue_length"),
                F.when(n % 3 != 0, n * 17 % 50 / 50.0).alias("storage_utilization"),
            )
        )

    @cached_property
    def sector_impacts(self) -> DataFrame:
        key = F.sum("custkey")
        return self.companies.groupBy("scenario", "sector_code", "sector").agg(
            (F.avg("supply_chain_complexity") * 10).alias("vulnerability_score"),
            (key % 201 / 10.0 - 10.0).alias("current_impact"),
            (key % 187 / 10.0 - 10.0).alias("predicted_impact_7d"),
            (key % 161 / 8.0 - 10.0).alias("predicted_impact_30d"),
            (F.sum(F.floor("market_cap").cast("bigint")) / 1000000.0).alias("market_cap"),
            F.count("*").alias("companies"),
        )

    @cached_property
    def company_impacts(self) -> DataFrame:
        key = F.col("custkey")
        return self.companies.select(
            "symbol", "company_name", "sector", "scenario", "custkey",
            (key % 41 / 2.0 - 10.0).alias("impact_score"),
            (key % 21 / 20.0).alias("probability"),
            (key % 4).alias("n_factors"),
            (key % 150).alias("recovery_days"),
            "data_quality", "liquidity_score", "esg_score", "beta", "debt_to_equity", "current_price",
        )

    @cached_property
    def prices(self) -> DataFrame:
        parts = self.part.select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
        return (
            self.lineitem.select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
            .join(parts, "l_partkey")
            .groupBy(F.col("p_brand").alias("symbol"), F.col("p_type").alias("sector"),
                     F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("day"))
            .agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"),
                 F.sum("l_quantity").alias("volume"))
        )

    @cached_property
    def positions(self) -> DataFrame:
        side = F.when(F.col("p_partkey") % 3 == 0, -1).otherwise(1)
        return self.part.select(
            F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("symbol"),
            F.col("p_type").alias("sector"), F.col("p_brand").alias("book"),
            (side * F.col("p_size").cast("bigint")).alias("shares"),
            F.col("p_retailprice").alias("entry_price"), "p_partkey",
        )

    @cached_property
    def ticks(self) -> DataFrame:
        return self.lineitem.select(
            F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol"),
            F.col("l_shipdate").alias("ts"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
            F.col("l_orderkey").alias("k1"), F.col("l_suppkey").alias("k2"), F.col("l_linenumber").alias("k3"),
        )

    @cached_property
    def request_log(self) -> DataFrame:
        n = F.col("event_id")
        return self.events.select(
            F.col("event_type").alias("service"), "ts", n.alias("id"), (F.col("value") / 100).alias("duration"),
            F.col("user_id").alias("client"), (n % 29 == 0).alias("failed"), (n % 3 == 0).alias("cached"),
        )


TABLE_NAMES = frozenset(
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations".split())
