"""Fixed values of the domain, stated once and used as small dimension rows."""

from __future__ import annotations

# Sector code, name, sensitivity to the five disruption types,
# propagation delay (days), recovery (days), benchmark E / S / G / chain / climate.
SECTORS = [
    ("10", "Energy", (0.9, 0.8, 0.7, 0.8, 0.9), 1, 30, (35, 45, 55, 70, 85)),
    ("15", "Materials", (0.9, 0.9, 0.8, 0.6, 0.7), 2, 45, (40, 50, 60, 65, 75)),
    ("20", "Industrials", (0.8, 0.8, 0.7, 0.5, 0.6), 3, 60, (50, 55, 65, 60, 60)),
    ("25", "Consumer Discretionary", (0.7, 0.7, 0.8, 0.4, 0.5), 5, 90, (45, 50, 60, 75, 50)),
    ("30", "Consumer Staples", (0.6, 0.6, 0.6, 0.7, 0.4), 4, 30, (55, 60, 65, 70, 45)),
    ("35", "Health Care", (0.5, 0.5, 0.4, 0.3, 0.6), 7, 120, (60, 70, 70, 55, 40)),
    ("40", "Financials", (0.3, 0.3, 0.4, 0.2, 0.7), 1, 14, (65, 60, 75, 30, 35)),
    ("45", "Information Technology", (0.6, 0.6, 0.5, 0.3, 0.8), 2, 21, (70, 65, 75, 65, 45)),
    ("50", "Communication Services", (0.4, 0.4, 0.3, 0.3, 0.6), 3, 21, (65, 55, 70, 50, 40)),
    ("55", "Utilities", (0.5, 0.5, 0.6, 0.8, 0.5), 2, 45, (45, 60, 65, 40, 80)),
    ("60", "Real Estate", (0.4, 0.4, 0.5, 0.6, 0.3), 10, 180, (55, 55, 60, 45, 70)),
]
DISRUPTION_TYPES = ("port_congestion", "route_blockage", "rate_spike", "weather", "geopolitical")
DEFAULT_SENSITIVITY = 0.3

# Dependency edges, source code -> target code and weight.
EDGES = [
    ("10", "15", 0.8), ("10", "20", 0.7), ("10", "25", 0.6), ("10", "30", 0.5), ("10", "55", 0.9),
    ("15", "20", 0.9), ("15", "25", 0.7), ("15", "45", 0.6), ("15", "60", 0.8), ("15", "10", 0.4),
    ("20", "25", 0.8), ("20", "45", 0.7), ("20", "10", 0.6), ("20", "15", 0.5), ("20", "60", 0.6),
    ("25", "30", 0.4), ("25", "45", 0.6), ("25", "15", 0.5), ("25", "20", 0.3),
    ("30", "15", 0.6), ("30", "10", 0.5), ("30", "20", 0.4),
    ("35", "15", 0.5), ("35", "45", 0.6), ("35", "20", 0.3),
    ("40", "60", 0.7), ("40", "10", 0.4), ("40", "45", 0.5),
    ("45", "15", 0.7), ("45", "20", 0.6), ("45", "10", 0.4),
    ("50", "45", 0.8), ("50", "20", 0.4), ("50", "10", 0.3),
    ("55", "10", 0.9), ("55", "15", 0.5), ("55", "20", 0.6),
    ("60", "15", 0.8), ("60", "20", 0.7), ("60", "40", 0.6), ("60", "10", 0.5),
]
# Sector pairs taken as highly correlated, and the three constants
# of the correlation rule (pair in list, share of the edge weight, neither).
CORRELATED = [("10", "15"), ("20", "15"), ("25", "30"), ("45", "50"), ("40", "60")]
PAIR_CORRELATION, EDGE_CORRELATION_SHARE, NO_CORRELATION = 0.7, 0.7, 0.25

# Watched sea areas, latitude and longitude bounds (inclusive).
AREAS = [
    ("Suez", 29.5, 31.5, 32.0, 33.0),
    ("Panama", 8.5, 9.5, -80.0, -79.0),
    ("Malacca", 1.0, 6.0, 100.0, 105.0),
    ("Los Angeles", 33.5, 34.0, -118.5, -118.0),
]
# Distances in nautical miles, and the default.
DISTANCES = [
    ("Shanghai", "Los Angeles", 6434.0),
    ("Shanghai", "Long Beach", 6434.0),
    ("Singapore", "Rotterdam", 8288.0),
    ("Dubai", "Hamburg", 6200.0),
    ("Hong Kong", "New York", 8439.0),
    ("Busan", "Tacoma", 4500.0),
    ("Ningbo", "Savannah", 7800.0),
]
DEFAULT_DISTANCE, CRUISE_KNOTS = 5000.0, 15.0
# Port coordinates for great-circle distances (degrees).
PORTS = [
    ("Shanghai", 31.23, 121.47), ("Los Angeles", 33.74, -118.26), ("Long Beach", 33.75, -118.22),
    ("Singapore", 1.26, 103.84), ("Rotterdam", 51.95, 4.14), ("Dubai", 25.01, 55.06),
    ("Hamburg", 53.54, 9.97), ("Hong Kong", 22.34, 114.12), ("New York", 40.67, -74.04),
    ("Busan", 35.1, 129.04), ("Tacoma", 47.27, -122.41), ("Ningbo", 29.94, 121.88),
    ("Savannah", 32.13, -81.14),
]
# 40-foot rate per lane when no source has a quote, and the default.
LANE_ESTIMATES = [
    ("Shanghai", "Los Angeles", 2500.0), ("Shanghai", "Long Beach", 2500.0),
    ("Shanghai", "New York", 3500.0), ("Ningbo", "Los Angeles", 2400.0),
    ("Shenzhen", "Los Angeles", 2600.0), ("Hong Kong", "Los Angeles", 2700.0),
    ("Singapore", "Rotterdam", 1800.0), ("Singapore", "Hamburg", 1900.0),
    ("Busan", "Los Angeles", 1800.0), ("Yokohama", "Los Angeles", 2000.0),
]
DEFAULT_LANE_ESTIMATE = 2000.0
# Index level used when the page holds no quote, and the default.
INDEX_ESTIMATES = {"BDI": 1200.0, "BCI": 2000.0, "BPI": 1500.0, "BSI": 1000.0, "BHSI": 800.0}
DEFAULT_INDEX = 1000.0

# Words of the congestion lexicon (counted as substrings).
LEXICON = {
    "high": ("congestion", "delay", "waiting", "queue", "bottleneck", "backlog"),
    "medium": ("busy", "active", "operations", "traffic"),
    "low": ("smooth", "efficient", "fast", "quick", "normal"),
}
LEXICON_WEIGHT = {"high": 1.0, "medium": 0.5, "low": 0.1}

# Container terminals (name, port, operator, TEU capacity, berths, cranes),
# and the utilisation and largest vessel assumed for each.
TERMINALS = [
    ("APM Terminals Los Angeles", "Port of Los Angeles", "APM Terminals", 2_400_000.0, 8, 14),
    ("Long Beach Container Terminal", "Port of Long Beach", "LBCT", 3_300_000.0, 10, 18),
    ("Shanghai International Port", "Port of Shanghai", "SIPG", 47_000_000.0, 50, 120),
]
TERMINAL_UTILISATION, TERMINAL_MAX_VESSEL = 0.8, 24_000

# Mitigation texts per sector, for other sectors, and per risk type.
MITIGATION = {
    "Energy": ("Diversify supply sources", "Increase strategic reserves", "Invest in alternative energy"),
    "Materials": ("Build inventory buffers", "Develop local suppliers", "Implement just-in-case inventory"),
    "Industrials": ("Strengthen supplier relationships", "Invest in automation", "Develop contingency plans"),
    "Consumer Discretionary": (
        "Diversify product mix", "Focus on essential categories", "Improve demand forecasting"),
    "Consumer Staples": (
        "Secure long-term contracts", "Invest in local production", "Build distribution redundancy"),
}
MITIGATION_DEFAULT = (
    "Monitor supply chain risks", "Develop alternative suppliers", "Improve operational flexibility")
MITIGATION_BY_RISK = [
    ("port_congestion", "Diversify shipping routes and ports"),
    ("rate_spike", "Hedge freight rate exposure"),
    ("route_blockage", "Develop alternative transportation modes"),
]
# Activity -> numbers of the UN development goals it serves.
SDG = {
    "renewable_energy": (7, 13),
    "water_management": (6, 14),
    "waste_reduction": (12, 15),
    "fair_labor": (8, 10),
    "supply_chain_transparency": (8, 12, 16),
    "gender_equality": (5, 10),
    "education_training": (4, 8),
    "healthcare_access": (3,),
    "sustainable_cities": (11,),
    "climate_action": (13,),
    "biodiversity": (14, 15),
    "poverty_reduction": (1, 2),
    "innovation": (9,),
    "partnerships": (17,),
}
# Multiplier of the sustainability base score per sector (others 1.0).
SUSTAINABILITY = {
    "Information Technology": 1.2, "Health Care": 1.1, "Consumer Staples": 1.0,
    "Industrials": 0.9, "Materials": 0.8, "Energy": 0.7,
}


# Limits of the strategy and defaults of a company record.
LIMITS = {"gross": 1.0, "net": 0.3, "single": 0.05, "conviction": 0.6, "risk_budget": 0.15, "esg_floor": 30.0,
          "sector": 0.3, "capital": 1_000_000.0}
COMPANY_DEFAULTS = {"data_quality": 0.7, "liquidity_score": 0.8, "esg_score": 50.0, "beta": 1.0, "debt_to_equity": 0.5,
                    "current_price": 100.0}


def sector_row(code: str):
    return next(s for s in SECTORS if s[0] == code)


def sector_name(code: str) -> str:
    return sector_row(code)[1]


def frame(spark, rows, schema: str):
    """A literal dimension as a DataFrame (bounded by the constants above)."""
    return spark.createDataFrame(rows, schema)
