"""Counters of outcomes, by shard and in total, and their text form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OUTCOMES = ("created", "replayed", "in_progress", "mismatch", "denied", "upstream_error", "passthrough")


def counters(decisions: DataFrame, *groups: str) -> DataFrame:
    """One column for each outcome, and requests_total: all but what was denied, or answered by the gate itself."""
    return decisions.groupBy(*groups).agg(
        F.count_if(~F.col("outcome").isin("denied", "operational")).alias("requests_total"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    )


def merged(parts: DataFrame) -> DataFrame:
    """Counters of shards as one row."""
    return parts.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("requests_total", *OUTCOMES)])


def exposition(total: DataFrame, prefix: str = "gate") -> DataFrame:
    """(line_no, line): one row of counters in the text format of metric scrapers."""
    names = [f"{prefix}_requests_total", f"{prefix}_outcomes_total"]
    lines = [
        F.lit(f"# HELP {names[0]} Requests handled."), F.lit(f"# TYPE {names[0]} counter"), F.concat(F.lit(f"{names[0]} "), F.col("requests_total").cast("string")),
        F.lit(f"# HELP {names[1]} Responses by how they came about."), F.lit(f"# TYPE {names[1]} counter"),
        *[F.concat(F.lit(f'{names[1]}{{outcome="{o}"}} '), F.col(o).cast("string")) for o in OUTCOMES],
    ]
    return total.select(F.posexplode(F.array(*lines)).alias("line_no", "line"))
