"""Registry that pairs every Spark query with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.session import ready
from tradewind.sources.adapters import Tables, with_views


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None
    rounded: tuple[str, ...]
    places: int

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Tables(ready(spark), sf_dir))
        if self.rounded:
            df = df.withColumns({c: F.round(F.col(c) + tie_break(self.places), self.places) for c in self.rounded})
        wide = {
            f.name: f.dataType.simpleString()
            for f in df.schema.fields
            if f.dataType.simpleString() in ("int", "smallint", "tinyint", "float")
        }
        return df.select(
            *[
                F.col(c).cast("double" if wide[c] == "float" else "bigint").alias(c)
                if c in wide
                else F.col(c)
                for c in df.columns
            ]
        )


QUERIES: dict[str, Query] = {}


def tie_break(places: int) -> float:
    """A step far below the last kept place.

    Means of two-decimal amounts often end exactly on a half; moving both sides
    off it keeps their last-bit noise from deciding the rounding.
    """
    return 0.00331 * 10.0**-places


def query(name: str, sql: str | None = None, uses: str = "", rnd: str = "", places: int = 6):
    """Register a query.

    ``uses`` names the domain views the SQL twin reads, ``rnd`` the double
    columns that both sides round to ``places``.
    """
    columns = tuple(rnd.split())

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        text = None
        if sql is not None:
            text = with_views(sql, uses.split())
            if columns:
                swaps = ", ".join(f"round({c} + {tie_break(places)!r}, {places}) AS {c}" for c in columns)
                text = f"SELECT * REPLACE ({swaps}) FROM ({text}) AS twin"
        QUERIES[name] = Query(name, build, text, columns, places)
        return build

    return register
