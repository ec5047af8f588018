"""JSON and text sources turned into typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind import dims
from tradewind.functions.calendar import parse_time
from tradewind.operators.freight import rate_breakdown

# Keys of the two position feeds, in the order of OUTPUT.
UPPER = ("MMSI", "IMO", "SHIPNAME", "TYPE_NAME", "FLAG", "LAT", "LON", "SPEED", "COURSE", "DESTINATION", "ETA", "DRAUGHT",
         "LENGTH", "WIDTH", "DWT")
LOWER = ("mmsi", "imo", "name", "type", "flag", "lat", "lon", "speed", "course", "destination", "eta", "draught",
         "length", "width", "dwt")
OUTPUT = ("mmsi", "imo", "vessel_name", "vessel_type", "flag", "latitude", "longitude", "speed", "course", "destination",
          "eta", "draught", "length", "width", "cargo_capacity")
TEXTS = {"mmsi", "imo", "vessel_name", "vessel_type", "flag", "destination", "eta"}
WHOLE = {"length", "width"}


def parse_positions(feeds: DataFrame, body: str, place: str, shape: int) -> DataFrame:
    """Explode the vessels of a feed document; absent texts become '', absent numbers 0."""
    root, names = ("data", UPPER) if shape == 1 else ("vessels", LOWER)
    schema = f"{root} array<struct<{', '.join(f'`{n}`: string' for n in names)}>>"
    # feed keys differ only in case between the shapes, so read them as texts and cast
    rows = feeds.withColumn("_v", F.explode(F.from_json(body, schema)[root]))
    out = []
    for source, target in zip(names, OUTPUT):
        value = F.col("_v").getField(source)
        if target == "eta":
            out.append(parse_time(value).alias("eta"))
        elif target in TEXTS:
            out.append(F.coalesce(value, F.lit("")).alias(target))
        else:
            kind = "int" if target in WHOLE else "double"
            out.append(F.coalesce(value.try_cast(kind), F.lit(0).cast(kind)).alias(target))
    return rows.select(*[c for c in feeds.columns if c != body], *out).withColumn(
        "current_port", F.col(place)).drop(*([] if place == "current_port" else [place]))


def _numbers(text: Column, pattern: str) -> Column:
    """All thousands-separated numbers before a unit word."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.transform(found, lambda s: F.replace(s, F.lit(","), F.lit("")).try_cast("double"))


# Patterns of port pages and the divisor that makes them monthly or daily.
PORT_PATTERNS = {
    "container_throughput_teu": (r"(?i)([\d,]+)\s*TEU", 12.0),
    "cargo_volume_tons": (r"(?i)([\d,]+)\s*(?:tons?|tonnes?)", 12.0),
    "vessel_arrivals": (r"(?i)([\d,]+)\s*(?:vessels?|ships?)", 365.0),
}
SINGLE_PORT_PATTERN = r"([\d,]+)\s*TEU"


def parse_port_text(df: DataFrame, text: str) -> DataFrame:
    """Largest quantity per pattern over its divisor, NULL when the page has none."""
    return df.withColumns({
        name: F.array_max(_numbers(F.col(text), pattern)) / divisor for name, (pattern, divisor) in PORT_PATTERNS.items()})


def parse_single_port_text(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("container_throughput_teu", F.array_max(_numbers(F.col(text), SINGLE_PORT_PATTERN)) / 12.0)


def _quote(text: Column, pattern: str, group: int = 1) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", F.replace(F.replace(found, F.lit(","), F.lit("")), F.lit("%"), F.lit("")).try_cast("double"))


def parse_index(df: DataFrame, text: str, index: str) -> DataFrame:
    """Index level with changes, or the estimate when the page has no quote."""
    body = F.col(text)
    level = _quote(body, rf"(?i){index}[\s:]*([\d,]+(?:\.\d+)?)")
    moves = rf"(?is){index}.*?([+-]?[\d,]+(?:\.\d+)?).*?([+-]?[\d.]+%?)"
    estimate = dims.INDEX_ESTIMATES.get(index, dims.DEFAULT_INDEX)
    known = level.isNotNull()
    return df.withColumns({
        "index_value": F.coalesce(level, F.lit(estimate)),
        "change_points": F.when(known, F.coalesce(_quote(body, moves, 1), F.lit(0.0))).otherwise(0.0),
        "change_percent": F.when(known, F.coalesce(_quote(body, moves, 2), F.lit(0.0))).otherwise(0.0),
        "estimated": ~known,
    })


def parse_container_rate(df: DataFrame, text: str) -> DataFrame:
    """First dollar amount as the 40-foot rate, with its breakdown."""
    priced = df.withColumn("rate_40ft", _quote(F.col(text), r"\$([\d,]+)")).where(F.col("rate_40ft").isNotNull())
    return rate_breakdown(priced)


def parse_fbx(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("fbx", _quote(F.col(text), r"(?i)FBX[\s:]*([\d,]+(?:\.\d+)?)"))


def _bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def congestion_from_text(text: Column) -> Column:
    """Weighted share of lexicon words (counted as substrings), none -> 0.5."""
    def hits(low, level):
        # plain substring search: the text shrinks by the word's length per occurrence
        shrunk = [(F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w) for w in dims.LEXICON[level]]
        return sum(shrunk, F.lit(0.0)).alias(level)

    def share(counts):
        total = sum((counts[level] for level in dims.LEXICON), F.lit(0.0))
        weighted = sum((counts[level] * dims.LEXICON_WEIGHT[level] for level in dims.LEXICON), F.lit(0.0))
        return F.when(total == 0, 0.5).otherwise(F.least(F.lit(1.0), F.try_divide(weighted, total)))

    return _bind(_bind(F.lower(text), lambda low: F.struct(*[hits(low, level) for level in dims.LEXICON])), share)


LOG_SCHEMA = "timestamp timestamp_ntz, level string, logger string, message string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines log; malformed lines are dropped."""
    return spark.read.schema(LOG_SCHEMA).json(path, mode="DROPMALFORMED")


def parse_log_lines(df: DataFrame, line: str) -> DataFrame:
    """The same for lines that are already rows."""
    entry = F.from_json(F.col(line), LOG_SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return df.withColumn("_e", entry).where("_e._bad IS NULL AND _e IS NOT NULL").select(
        *[c for c in df.columns if c != line], "_e.timestamp", "_e.level", "_e.logger", "_e.message")


def filter_log(log: DataFrame, start: str, end: str, level: str | None = None) -> DataFrame:
    kept = log.where(F.col("timestamp").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    return kept.where(F.col("level") == level) if level else kept


def export_log(log: DataFrame, path: str) -> None:
    log.write.mode("overwrite").json(path)
