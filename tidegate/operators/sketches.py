"""Count-Min and HyperLogLog as tables of cells, so that they merge by aggregation and can be checked in SQL.

Hashes are hex digits of MD5, which other engines compute as well.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH, WIDTH, PRECISION = 5, 512, 12


def _digits(h: Column, start: int, n: int) -> Column:
    return F.conv(F.substring(h, start, n), 16, 10).cast("long")


def cms_column(row: Column, key: Column, width: int = WIDTH) -> Column:
    return _digits(F.md5(F.concat_ws(":", row.cast("string"), key).cast("binary")), 1, 8) % width


def cms_build(stream: DataFrame, key: str, count: Column | None = None, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """(row, col, cell). Counts of equal keys are summed before they are dealt to the rows."""
    sums = stream.groupBy(F.col(key).cast("string").alias("key")).agg((F.sum(count) if count is not None else F.count(F.lit(1))).alias("c"))
    cells = sums.withColumn("row", F.explode(F.array(*map(F.lit, range(depth)))))
    return cells.groupBy("row", cms_column(F.col("row"), F.col("key"), width).alias("col")).agg(F.sum("c").alias("cell"))


def cms_estimate(cells: DataFrame, keys: DataFrame, key: str = "key", depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """(key, estimate): the least cell of each key. ``cells`` has at most depth * width rows, so it is broadcast."""
    asked = keys.select(F.col(key).cast("string").alias("key")).distinct()
    asked = asked.withColumn("row", F.explode(F.array(*map(F.lit, range(depth))))).withColumn("col", cms_column(F.col("row"), F.col("key"), width))
    found = asked.join(F.broadcast(cells), ["row", "col"], "left")
    return found.groupBy("key").agg(F.min(F.coalesce("cell", F.lit(0).cast("long"))).alias("estimate"))


def cms_size(epsilon: float, delta: float) -> tuple[int, int]:
    """(depth, width) for an error of at most epsilon * total, with a probability of 1 - delta."""
    return math.ceil(math.log(1 / delta)), math.ceil(math.e / epsilon)


def heavy_hitters(estimates: DataFrame, k: int) -> DataFrame:
    return estimates.orderBy(F.desc("estimate"), "key").limit(k)


def hll_registers(stream: DataFrame, key: str, groups: list[str], precision: int = PRECISION) -> DataFrame:
    """(groups, idx, rank): the registers that are not empty. ``precision`` must be a multiple of 4."""
    if precision % 4 or not 4 <= precision <= 16:
        raise ValueError("precision must be 4, 8, 12 or 16")
    n = precision // 4
    h = F.md5(F.col(key).cast("string").cast("binary"))
    rest = F.substring(h, n + 1, 13)
    zeros = F.char_length(F.regexp_extract(rest, "^0*", 0))
    nibble = F.substr(rest, zeros + 1, F.lit(1))
    more = F.when(nibble == "", 0).when(nibble == "1", 3).when(nibble.isin("2", "3"), 2).when(nibble.isin("4", "5", "6", "7"), 1).otherwise(0)
    rows = stream.select(*groups, _digits(h, 1, n).alias("idx"), (zeros * 4 + more + 1).cast("int").alias("rank"))
    return rows.groupBy(*groups, "idx").agg(F.max("rank").alias("rank"))


def hll_merge(*registers: DataFrame, groups: list[str]) -> DataFrame:
    out = registers[0]
    for other in registers[1:]:
        out = out.unionByName(other)
    return out.groupBy(*groups, "idx").agg(F.max("rank").alias("rank"))


def hll_estimate(registers: DataFrame, groups: list[str], precision: int = PRECISION) -> DataFrame:
    """(groups, estimate): the harmonic mean, or linear counting while many registers are empty."""
    m = float(1 << precision)
    alpha = {16: 0.673, 32: 0.697, 64: 0.709}.get(1 << precision, 0.7213 / (1 + 1.079 / m))
    sums = registers.groupBy(*groups).agg(F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank"))), F.lit(0.0)).alias("__s"), F.count(F.lit(1)).alias("__n"))
    raw = F.lit(alpha * m * m) / (F.col("__s") + (F.lit(m) - F.col("__n")))
    zeros = F.lit(m) - F.col("__n")
    value = F.when((raw <= 2.5 * m) & (zeros > 0), F.lit(m) * F.ln(F.lit(m) / zeros)).otherwise(raw)
    return sums.select(*groups, value.alias("estimate"))
