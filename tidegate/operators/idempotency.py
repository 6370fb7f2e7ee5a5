"""Keyed idempotency: leases, fences, stored outcomes and their time to live.

A decision depends on the decisions before it, so the rows of a key are stepped through in their order. They are dealt
by key and sorted within partitions, and a small state per key goes along with the sorted rows: nothing is collected,
and a key of any length is read in one pass. Where outcomes outlive the data and every operation succeeds,
``first_effects`` gives the same answers with windows alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidegate.schema import COMPLETED, IN_PROGRESS, Leases


@dataclass
class KeyState:
    """What is known of one key: nothing, an operation in progress, or a stored outcome.

    Fences rise over the whole life of a key, through completion and expiry, so that no old token fits again.
    """

    leases: Leases = field(default_factory=Leases)
    tag: int | None = None
    fp: str | None = None
    fence: int = 0
    until_ms: int = 0
    outcome: int | None = None
    status: int | None = None

    def begin(self, fp: str | None, now_ms: int) -> str:
        if self.tag is not None:
            if self.tag == COMPLETED and now_ms < self.until_ms:
                return "replay" if fp == self.fp else "mismatch"
            if self.tag == IN_PROGRESS:
                if fp != self.fp:
                    return "mismatch"
                if now_ms < self.until_ms:
                    return "in_progress"
        self.tag, self.fp, self.fence, self.outcome, self.status = IN_PROGRESS, fp, self.fence + 1, None, None
        self.until_ms = now_ms + self.leases.lease_ms
        return "run"

    def complete(self, fence: int | None, outcome: int, now_ms: int, status: int | None = None) -> str:
        if self.tag is None:
            return "unknown"
        if self.tag == COMPLETED:
            return "already_completed"
        if fence != self.fence:
            return "stale_fence"
        self.tag, self.until_ms, self.outcome, self.status = COMPLETED, now_ms + self.leases.ttl_ms, outcome, status
        return "ok"

    def request(self, fp: str | None, now_ms: int, status: int | None, outcome: int) -> str:
        """A request whose backend answers at once with ``status``; null is a backend that cannot be reached."""
        decision = self.begin(fp, now_ms)
        if decision != "run":
            return {"replay": "replayed"}.get(decision, decision)
        if status is None or status >= 500:
            return "upstream_error"
        self.complete(self.fence, outcome, now_ms, status)
        return "created"

    def expired(self, now_ms: int) -> bool:
        """Whether a stored outcome's time is over; what is in progress never expires, it is taken over."""
        return self.tag == COMPLETED and now_ms >= self.until_ms


#: Operations that set a key's state to one that was stored, ``now_ms`` being the time until which it holds.
RESTORED = {"restored_in_progress": IN_PROGRESS, "restored_completed": COMPLETED}
STEP = "decision string, fence long, outcome_seq long, outcome_status int, tag int, until_ms long"
DECIDED = f"key string, seq long, {STEP}"


def step(state: KeyState, seq: int, op: str, fp, now_ms: int, fence, status) -> tuple:
    """One operation on a key's state: the columns of STEP."""
    if op in RESTORED:
        state.tag, state.fp, state.fence, state.until_ms = RESTORED[op], fp, fence or 0, now_ms
        state.outcome, state.status = (seq, status) if state.tag == COMPLETED else (None, None)
        decision = "restored"
    elif op == "begin":
        decision = state.begin(fp, now_ms)
    elif op == "complete":
        decision = state.complete(fence, seq, now_ms, status)
    else:
        decision = state.request(fp, now_ms, status, seq)
    token = state.fence if decision in ("run", "created", "upstream_error", "ok") else None
    return decision, token, state.outcome, state.status, state.tag, state.until_ms


_INPUT = ("__key", "seq", "__op", "__fp", "now_ms", "__fence", "__status")
_NAMES = [f.split()[0] for f in STEP.split(", ")]
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]


def _decide(batches: Iterator[pa.RecordBatch], leases: Leases, keep: list[str]) -> Iterator[pa.RecordBatch]:
    key, state = object(), KeyState(leases)
    nothing = (None,) * len(_NAMES)
    for batch in batches:
        out = []
        for k, *row in zip(*(batch.column(c).to_pylist() for c in _INPUT), strict=True):
            if k is None:
                out.append(nothing)
                continue
            if k != key:
                key, state = k, KeyState(leases)
            out.append(step(state, *row))
        columns = zip(*out, strict=True) if out else ([] for _ in _KINDS)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(c, t) for c, t in zip(columns, _KINDS, strict=True))], [*keep, *_NAMES])


def stepped(rows: DataFrame, key: Column, op: Column, fp: Column, fence: Column, status: Column, leases: Leases) -> DataFrame:
    """``rows(seq, now_ms, ...)`` with STEP, nulls where ``key`` is null.

    Rows are dealt by key once, with all of their columns, which pass through as they are; those without a key are dealt
    by their number.
    """
    keep = rows.columns
    given = {"__key": key, "__op": op, "__fp": fp, "__fence": fence.cast("long"), "__status": status.cast("int")}
    dealt = rows.withColumns(given).repartition(F.coalesce("__key", F.col("seq").cast("string"))).sortWithinPartitions("__key", "seq")
    schema = StructType([*rows.schema.fields, *StructType.fromDDL(STEP).fields])
    return dealt.mapInArrow(partial(_decide, leases=leases, keep=keep), schema)


def decided(operations: DataFrame, leases: Leases | None = None) -> DataFrame:
    """DECIDED for ``operations(key, seq, op, fp, now_ms, fence, status)``, stepped through in the order of ``seq``.

    ``op`` is begin, complete (with the ``fence`` of the begin it belongs to), request (begin, backend ``status``,
    complete) or one of RESTORED, which puts a key into a state that a log has kept. ``outcome_seq`` and ``outcome_status`` name the operation whose outcome is stored, ``tag`` and ``until_ms``
    are the state after the step. Rows without a key are left out.
    """
    given = {"op": "__o", "fp": "__f", "fence": "__t", "status": "__s"}
    rows = operations.where("key is not null").select("key", "seq", "now_ms", *[F.col(c).alias(own) for c, own in given.items()])
    out = stepped(rows, F.col("key"), *map(F.col, given.values()), leases or Leases())
    return out.select(*[f.split()[0] for f in DECIDED.split(", ")])


def as_operations(requests: DataFrame, key: str = "idem_key", fp: str = "fp", status: str = "backend_status") -> DataFrame:
    return requests.select(
        F.col(key).alias("key"), "seq", F.lit("request").alias("op"), F.col(fp).alias("fp"), "now_ms", F.lit(None).cast("long").alias("fence"), F.col(status).alias("status")
    )


def first_effects(requests: DataFrame, key: str = "idem_key", fp: str = "fp") -> DataFrame:
    """``requests`` with ``decision`` (created, replayed or mismatch) and ``outcome_seq``, where nothing expires or
    fails: the first request of a key takes effect, and later ones replay it if their fingerprints agree."""
    first = requests.groupBy(key).agg(F.min_by(F.struct("seq", F.col(fp).alias("fp")), "seq").alias("__first"))
    out = requests.join(first, key)
    decision = F.when(F.col("seq") == F.col("__first.seq"), "created").when(F.col(fp).eqNullSafe(F.col("__first.fp")), "replayed").otherwise("mismatch")
    return out.select(*requests.columns, decision.alias("decision"), F.col("__first.seq").alias("outcome_seq"))


#: Numbers in ``seq`` that are counted together when runs are numbered.
SLOT = 1 << 20


def fences(decisions: DataFrame, shard: str, runs: tuple[str, ...] = ("run", "created", "upstream_error")) -> DataFrame:
    """``decisions`` that run, with ``shard_fence``: their number within a shard, by seq.

    Shards are few, so rows are dealt by slots of ``seq`` within them; the runs of the slots before are running sums
    over a small table.
    """
    rows = decisions.where(F.col("decision").isin(*runs)).withColumn("__slot", F.expr(f"seq div {SLOT}L"))
    sums = rows.groupBy(shard, "__slot").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(shard).orderBy("__slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col(shard).alias("__shard"), F.col("__slot").alias("__at"), before.alias("__before"))
    place = F.row_number().over(W.partitionBy(shard, "__slot").orderBy("seq"))
    rows = rows.withColumn("__place", place).join(sums, F.col(shard).eqNullSafe(F.col("__shard")) & (F.col("__slot") == F.col("__at")))
    return rows.select(*decisions.columns, (F.col("__place") + F.col("__before")).cast("long").alias("shard_fence"))


def snapshot(decisions: DataFrame) -> DataFrame:
    """The state of each key after its last operation."""
    last = decisions.groupBy("key").agg(F.max_by(F.struct("tag", "until_ms", "outcome_seq"), "seq").alias("s"))
    return last.select("key", "s.tag", "s.until_ms", "s.outcome_seq").where("tag is not null")


def pruned(states: DataFrame, now_ms: int) -> DataFrame:
    """Without stored outcomes whose time is over; what is in progress stays."""
    return states.where((F.col("tag") == IN_PROGRESS) | (F.lit(now_ms) < F.col("until_ms")))
