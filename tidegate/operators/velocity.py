"""How many different targets an actor touches in a tumbling window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegate.operators.ratelimit import window_of

#: Numbers in ``seq`` that are counted together.
SLOT = 1 << 20


def distinct_so_far(hits: DataFrame, actor: str, target: str, window_ms: int, most: int) -> DataFrame:
    """``hits`` with ``distinct_targets`` up to and with each row, and ``allowed``: not more than ``most``. Exact.

    A target counts with its first hit, a minimum that combines before the shuffle. First hits are laid among the hits,
    which are dealt by actor, window and slot of ``seq``, so that a busy actor is spread; the slots before are running sums
    over a small table.
    """
    slot = F.expr(f"seq div {SLOT}L")
    rows = hits.withColumns({"__w": window_of("now_ms", window_ms), "__first": F.lit(0), "__slot": slot})
    firsts = rows.groupBy(actor, "__w", target).agg(F.min("seq").alias("seq")).select(actor, "__w", "seq", F.lit(1).alias("__first"), slot.alias("__slot"))
    both = rows.unionByName(firsts, allowMissingColumns=True)
    sums = both.groupBy(actor, "__w", "__slot").agg(F.sum("__first").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(actor, "__w").orderBy("__slot").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(F.col(actor).alias("__a"), F.col("__w").alias("__aw"), F.col("__slot").alias("__at"), F.coalesce(before, F.lit(0)).alias("__before"))
    order = W.partitionBy(actor, "__w", "__slot").orderBy("seq", F.desc("__first")).rowsBetween(W.unboundedPreceding, 0)
    own = F.col(actor).eqNullSafe(F.col("__a")) & (F.col("__w") == F.col("__aw")) & (F.col("__slot") == F.col("__at"))
    counted = both.withColumn("__so_far", F.sum("__first").over(order)).where("__first = 0").join(sums, own)
    return counted.withColumn("distinct_targets", F.col("__so_far") + F.col("__before")).select(*hits.columns, "distinct_targets", (F.col("distinct_targets") <= most).alias("allowed"))


def distinct_by_window(hits: DataFrame, actor: str, target: str, window_ms: int) -> DataFrame:
    """(actor, window, distinct_targets): sums that need no order and combine before the shuffle."""
    return hits.groupBy(actor, window_of("now_ms", window_ms).alias("window")).agg(F.countDistinct(target).alias("distinct_targets"))
