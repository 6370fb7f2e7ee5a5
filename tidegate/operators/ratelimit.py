"""Sliding-window limits and ordered rules.

The count of a sliding window is estimated from two tumbling ones: the hits so far in the present one, this hit
included and whatever its verdict, and those of the one before, weighted by how much of it the window still covers.

Hits are dealt by key and cell, a cell being so short a time that it lies within one window of every rule, and at most
SLOT numbers long: a key of great traffic is spread over its cells. Cells are summed before the shuffle; what the windows
hold up to a cell are running sums over this small table, for all rules at once, joined back to the hits of the cell.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegate.schema import Rule

#: Numbers in ``seq`` that a cell covers at most, and so the hits that are put in order together.
SLOT = 1 << 20


def window_of(now_ms: str, window_ms: int) -> Column:
    return F.expr(f"{now_ms} div {window_ms}L")


def steadied(hits: DataFrame, key: str, now_ms: str = "now_ms", seq: str = "seq") -> DataFrame:
    """``hits`` with ``steady_ms``: the latest time of their key so far. For sources whose time may go back; windows
    are then those of ``steady_ms``, so that such a hit counts in the present window."""
    slot = F.expr(f"{seq} div {SLOT}L")
    tops = hits.groupBy(key, slot.alias("__slot")).agg(F.max(now_ms).alias("__top"))
    before = F.max("__top").over(W.partitionBy(key).orderBy("__slot").rowsBetween(W.unboundedPreceding, -1))
    tops = tops.select(F.col(key).alias("__key"), F.col("__slot").alias("__at"), before.alias("__before"))
    rows = hits.withColumn("__slot", slot)
    so_far = F.max(now_ms).over(W.partitionBy(key, "__slot").orderBy(seq).rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("__so_far", so_far).join(tops, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__slot") == F.col("__at")))
    return rows.select(*hits.columns, F.greatest("__so_far", "__before").alias("steady_ms"))


def counted(hits: DataFrame, key: str, windows: Sequence[int], prefixes: Sequence[str] = ("",), now_ms: str = "now_ms", seq: str = "seq", window_ms: str | None = None) -> DataFrame:
    """``hits`` with ``current``, ``previous`` and ``estimate`` for each of ``windows``, names behind its prefix.

    ``seq`` must be unique. Windows are those of the column ``window_ms``, by default ``now_ms``; its values must not
    fall with ``seq`` within a key, and the job fails if they pass into an earlier cell (see ``steadied``).
    """
    if not windows:
        return hits
    time = window_ms or now_ms
    cell = [F.expr(f"{time} div {gcd(*windows)}L").alias("__cell"), F.expr(f"{seq} div {SLOT}L").alias("__slot")]
    rows = hits.select("*", *cell)
    cells = rows.groupBy(key, "__cell", "__slot").agg(F.count(F.lit(1)).alias("__n"), F.min(seq).alias("__lo"), F.max(seq).alias("__hi"))
    order = W.partitionBy(key).orderBy("__cell", "__slot")
    steady = F.coalesce(F.lag("__hi").over(order) < F.col("__lo"), F.lit(True))
    fail = F.raise_error(F.concat(F.lit("time goes back within a key, at number "), F.col("__lo").cast("string")))
    cells = cells.withColumn("__n", F.when(steady, F.col("__n")).otherwise(fail.cast("long")))
    sums = []
    for width, prefix in zip(windows, prefixes, strict=True):
        w = F.expr(f"__cell div {width // gcd(*windows)}L")
        before = F.sum("__n").over(W.partitionBy(key, w).orderBy("__cell", "__slot").rowsBetween(W.unboundedPreceding, -1))
        previous = F.sum("__n").over(W.partitionBy(key).orderBy(w).rangeBetween(-1, -1))
        sums += [F.coalesce(before, F.lit(0)).alias(f"__{prefix}before"), F.coalesce(previous, F.lit(0)).alias(f"{prefix}previous")]
    cells = cells.select(F.col(key).alias("__key"), F.col("__cell").alias("__c"), F.col("__slot").alias("__s"), *sums)
    place = F.row_number().over(W.partitionBy(key, "__cell", "__slot").orderBy(seq)).cast("long")
    rows = rows.withColumn("__place", place).join(cells, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__cell") == F.col("__c")) & (F.col("__slot") == F.col("__s")))
    out = []
    for width, prefix in zip(windows, prefixes, strict=True):
        current = F.col("__place") + F.col(f"__{prefix}before")
        share = (F.lit(width) - F.col(now_ms) % F.lit(width)) / F.lit(float(width))
        out += [current.alias(f"{prefix}current"), F.col(f"{prefix}previous"), (current + F.col(f"{prefix}previous") * share).alias(f"{prefix}estimate")]
    return rows.select(*hits.columns, *out)


def limited(hits: DataFrame, key: str, window_ms: int, limit: int) -> DataFrame:
    """``hits`` with their counts and ``allowed``."""
    return counted(hits, key, [window_ms]).withColumn("allowed", F.col("estimate") <= limit)


def judged(hits: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    """``hits`` with ``verdict`` (allow or deny), ``rule`` and ``action``: those of the first rule in order that a hit
    goes beyond. Every rule counts every hit, whatever the others say."""
    out = counted(hits, key, [r.window_ms for r in rules], [f"__r{i}_" for i in range(len(rules))])
    tripped = [F.when(F.col(f"__r{i}_estimate") > r.limit, F.struct(F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"))) for i, r in enumerate(rules)]
    hit = F.coalesce(*tripped) if tripped else F.lit(None).cast("struct<rule:string,action:string>")
    return out.withColumn("__hit", hit).select(
        *hits.columns,
        F.when(F.col("__hit").isNull(), "allow").otherwise("deny").alias("verdict"),
        F.col("__hit.rule").alias("rule"),
        F.col("__hit.action").alias("action"),
    )


def bounded(hits: DataFrame, key: str, most: int) -> DataFrame:
    """Only the hits of the ``most`` keys seen first: what a limiter of bounded memory keeps track of."""
    first = hits.groupBy(key).agg(F.min("seq").alias("__first")).orderBy("__first", key).limit(most).select(key)
    return hits.join(first, key, "left_semi")
