"""Stateful streams: the same steps as in batch, with a key's state kept between micro-batches.

Within a micro-batch a key's rows are put in the order of ``seq`` first; over micro-batches the source keeps the order.
With a ``delay`` the state of keys that are over is dropped by event-time timers, once no row can come that would see it:
stored outcomes after their time to live, counts after two windows. Without one, state is kept for good. The session
needs the RocksDB state store (``tidegate.session.SETTINGS``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidegate.functions.crypto import fingerprint
from tidegate.operators.idempotency import DECIDED, STEP, KeyState, step
from tidegate.operators.sketches import PRECISION
from tidegate.plans.pipeline import answered, is_operational
from tidegate.schema import COMPLETED, Leases, Rule


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values("seq", kind="stable")


def _none(x):
    return None if pd.isna(x) else x


def _int(x) -> int | None:
    return None if pd.isna(x) else int(x)


class _Timed(StatefulProcessor):
    """Registers timers only where the stream has an event time."""

    timed = False

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def at(self, ms: int) -> None:
        if self.timed:
            self.handle.registerTimer(ms)

    def expired(self, ms: int) -> None:
        raise NotImplementedError

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.expired(expiredTimerInfo.getExpiryTimeInMs())
        return iter([])

    def close(self) -> None:
        pass


STEP_NAMES = [f.split()[0] for f in STEP.split(", ")]
_NULLABLE = {"fence": "Int64", "outcome_seq": "Int64", "outcome_status": "Int32", "tag": "Int32", "until_ms": "Int64"}


class IdempotencyProcessor(_Timed):
    """Decisions on operations of a key, behind their columns. State in progress is kept until it is taken over, as in
    batch. A stored outcome is dropped when its time is over; the key's fence is kept for as long again, so that a token
    from before fits nothing. Rows without a key take no part."""

    def __init__(self, leases: Leases, keep: Sequence[str]):
        self.leases, self.keep = leases, list(keep)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("key", "tag int, fp string, fence long, until_ms long, outcome long, status int")

    def _load(self) -> KeyState:
        own = KeyState(self.leases)
        if self.state.exists():
            own.tag, own.fp, own.fence, own.until_ms, own.outcome, own.status = self.state.get()
        return own

    def _store(self, own: KeyState) -> None:
        self.state.update((own.tag, own.fp, own.fence, own.until_ms, own.outcome, own.status))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = _ordered(rows)
        own, out, seen = self._load(), [], False
        for r in frame.itertuples(index=False):
            if pd.isna(r.op_key):
                out.append((None,) * len(STEP_NAMES))
                continue
            before = own.tag, own.until_ms
            out.append(step(own, int(r.seq), r.op, _none(r.op_fp), int(r.now_ms), _int(r.op_fence), _int(r.op_status)))
            seen = True
            if own.tag == COMPLETED and (own.tag, own.until_ms) != before:
                self.at(own.until_ms)
        if seen and own.tag is not None:
            self._store(own)
        steps = pd.DataFrame(out, columns=STEP_NAMES).astype(_NULLABLE)
        yield pd.concat([frame[self.keep].reset_index(drop=True), steps], axis=1)

    def expired(self, ms: int) -> None:
        own = self._load()
        if own.tag == COMPLETED and own.until_ms <= ms:
            self._store(KeyState(self.leases, fence=own.fence, until_ms=own.until_ms))
            self.at(own.until_ms + self.leases.ttl_ms)
        elif own.tag is None and own.until_ms + self.leases.ttl_ms <= ms:
            self.state.clear()


def _rolled(now: int, width: int, w: int | None, current: int, previous: int) -> tuple[int, int, int]:
    """Window, hits in it with this one, and hits in the one before. Time that goes back counts in the present window."""
    index = now // width
    if w is None or index > w:
        w, current, previous = index, 0, current if w is not None and index == w + 1 else 0
    return w, current + 1, previous


def _estimate(now: int, width: int, current: int, previous: int) -> float:
    return current + previous * ((width - now % width) / width)


class LimiterProcessor(_Timed):
    """Sliding-window counts of a key."""

    def __init__(self, window_ms: int, limit: int):
        self.window_ms, self.limit = window_ms, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("counts", "w long, current long, previous long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        counts = self.state.get() if self.state.exists() else (None, 0, 0)
        began, out = counts[0], []
        for r in _ordered(rows).itertuples(index=False):
            now = int(r.now_ms)
            counts = _rolled(now, self.window_ms, *counts)
            estimate = _estimate(now, self.window_ms, *counts[1:])
            out.append((key[0], int(r.seq), *counts[1:], estimate, estimate <= self.limit))
        self.state.update(counts)
        if counts[0] != began:
            self.at((counts[0] + 2) * self.window_ms)
        yield pd.DataFrame(out, columns=["key", "seq", "current", "previous", "estimate", "allowed"])

    def expired(self, ms: int) -> None:
        if self.state.exists() and (self.state.get()[0] + 2) * self.window_ms <= ms:
            self.state.clear()


class RuleSetProcessor(_Timed):
    """Verdicts of ordered rules on the hits of a key, behind their columns. Every rule counts every hit but those for
    which ``skip`` is true."""

    def __init__(self, rules: Sequence[Rule], keep: Sequence[str]):
        self.rules, self.keep = tuple(rules), list(keep)

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.counts = handle.getMapState("counts", "rule int", "w long, current long, previous long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = _ordered(rows)
        counts = {i: self.counts.getValue((i,)) if self.counts.containsKey((i,)) else (None, 0, 0) for i in range(len(self.rules))}
        began, out = {i: c[0] for i, c in counts.items()}, []
        for r in frame.itertuples(index=False):
            hit = None
            if not r.skip:
                now = int(r.now_ms)
                for i, rule in enumerate(self.rules):
                    counts[i] = _rolled(now, rule.window_ms, *counts[i])
                    if hit is None and _estimate(now, rule.window_ms, *counts[i][1:]) > rule.limit:
                        hit = rule
            out.append(("deny", hit.name, hit.action) if hit else ("allow", None, None))
        for i, c in counts.items():
            if c[0] is not None:
                self.counts.updateValue((i,), c)
                if c[0] != began[i]:
                    self.at((c[0] + 2) * self.rules[i].window_ms)
        verdicts = pd.DataFrame(out, columns=["verdict", "rule", "action"], dtype=object)
        yield pd.concat([frame[self.keep].reset_index(drop=True), verdicts], axis=1)

    def expired(self, ms: int) -> None:
        for i, rule in enumerate(self.rules):
            if self.counts.containsKey((i,)) and (self.counts.getValue((i,))[0] + 2) * rule.window_ms <= ms:
                self.counts.removeKey((i,))


class VelocityProcessor(_Timed):
    """Distinct targets of an actor in a tumbling window. Any change of the window, also back, starts anew."""

    def __init__(self, window_ms: int, most: int):
        self.window_ms, self.most = window_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.window = handle.getValueState("window", "w long, n long")
        self.seen = handle.getMapState("seen", "target string", "first long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        w, n = self.window.get() if self.window.exists() else (None, 0)
        began, out = w, []
        for r in _ordered(rows).itertuples(index=False):
            index = int(r.now_ms) // self.window_ms
            if index != w:
                w, n = index, 0
                self.seen.clear()
            if not self.seen.containsKey((r.target,)):
                self.seen.updateValue((r.target,), (int(r.seq),))
                n += 1
            out.append((key[0], int(r.seq), n, n <= self.most))
        self.window.update((w, n))
        if w != began:
            self.at((w + 1) * self.window_ms)
        yield pd.DataFrame(out, columns=["key", "seq", "distinct_targets", "allowed"])

    def expired(self, ms: int) -> None:
        if self.window.exists() and (self.window.get()[0] + 1) * self.window_ms <= ms:
            self.window.clear()
            self.seen.clear()


def hll_add(registers: np.ndarray, target: str) -> None:
    """As ``operators.sketches.hll_registers``, for one value."""
    digits = hashlib.md5(target.encode()).hexdigest()
    n = PRECISION // 4
    idx, rest = int(digits[:n], 16), digits[n : n + 13]
    registers[idx] = max(registers[idx], 4 * len(rest) - int(rest, 16).bit_length() + 1)


def hll_value(registers: np.ndarray) -> float:
    m = float(len(registers))
    raw = 0.7213 / (1 + 1.079 / m) * m * m / np.exp2(-registers.astype(np.float64)).sum()
    zeros = int((registers == 0).sum())
    return m * np.log(m / zeros) if raw <= 2.5 * m and zeros else raw


class SketchVelocityProcessor(_Timed):
    """Distinct targets of an actor in a tumbling window, estimated by a HyperLogLog: 4 KB an actor, whatever it touches."""

    def __init__(self, window_ms: int, most: int):
        self.window_ms, self.most = window_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("sketch", "w long, registers binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        w, data = self.state.get() if self.state.exists() else (None, bytes(1 << PRECISION))
        began, registers, out = w, np.frombuffer(bytearray(data), dtype=np.uint8), []
        for r in _ordered(rows).itertuples(index=False):
            index = int(r.now_ms) // self.window_ms
            if index != w:
                w, registers = index, np.zeros(1 << PRECISION, dtype=np.uint8)
            hll_add(registers, r.target)
            estimate = float(hll_value(registers))
            out.append((key[0], int(r.seq), estimate, estimate <= self.most))
        self.state.update((w, registers.tobytes()))
        if w != began:
            self.at((w + 1) * self.window_ms)
        yield pd.DataFrame(out, columns=["key", "seq", "estimate", "allowed"])

    def expired(self, ms: int) -> None:
        if self.state.exists() and (self.state.get()[0] + 1) * self.window_ms <= ms:
            self.state.clear()


def _run(rows: DataFrame, processor: _Timed, schema: str | StructType, delay: str | None, by: str = "key") -> DataFrame:
    """``rows(now_ms, ...)`` through ``processor``; with ``delay``, rows later than that are left out."""
    processor.timed = delay is not None
    if delay and "event_time" not in rows.columns:
        rows = rows.withColumn("event_time", F.timestamp_millis("now_ms")).withWatermark("event_time", delay)
    if isinstance(schema, StructType) and "event_time" in schema.names:
        return rows.groupBy(by).transformWithStateInPandas(processor, schema, "Append", "EventTime", eventTimeColumnName="event_time")
    return rows.groupBy(by).transformWithStateInPandas(processor, schema, "Append", "EventTime" if delay else "None")


def decided(operations: DataFrame, leases: Leases | None = None, delay: str | None = None) -> DataFrame:
    """As ``operators.idempotency.decided``, for a stream. With ``delay`` stored outcomes go when their time is over; who
    completes such a key then gets unknown instead of already_completed."""
    given = {"fp": "op_fp", "fence": "op_fence", "status": "op_status"}
    rows = operations.where("key is not null").withColumnsRenamed(given).withColumn("op_key", F.col("key"))
    return _run(rows, IdempotencyProcessor(leases or Leases(), ["key", "seq"]), DECIDED, delay)


def limited(hits: DataFrame, window_ms: int, limit: int, delay: str | None = None) -> DataFrame:
    """Counts and verdicts for a stream of ``hits(key, seq, now_ms)``."""
    return _run(hits, LimiterProcessor(window_ms, limit), "key string, seq long, current long, previous long, estimate double, allowed boolean", delay)


def judged(hits: DataFrame, rules: Sequence[Rule], delay: str | None = None) -> DataFrame:
    """As ``operators.ratelimit.judged``, for a stream of ``hits(key, seq, now_ms)``."""
    rows = hits.withColumn("skip", F.lit(False))
    return _run(rows, RuleSetProcessor(rules, ["key", "seq"]), "key string, seq long, verdict string, rule string, action string", delay)


def velocity(hits: DataFrame, window_ms: int, most: int, delay: str | None = None) -> DataFrame:
    """Distinct targets for a stream of ``hits(key, seq, now_ms, target)``."""
    return _run(hits, VelocityProcessor(window_ms, most), "key string, seq long, distinct_targets long, allowed boolean", delay)


def velocity_estimate(hits: DataFrame, window_ms: int, most: int, delay: str | None = None) -> DataFrame:
    """As ``velocity``, estimated in bounded memory."""
    return _run(hits, SketchVelocityProcessor(window_ms, most), "key string, seq long, estimate double, allowed boolean", delay)


def handled(requests: DataFrame, rules: Sequence[Rule], secret: bytes, leases: Leases, delay: str | None = None) -> DataFrame:
    """As ``plans.pipeline.handled``, for a stream: rules by identity, then the state of keys. Rows that one of the two has
    no use for pass through it without leaving state."""
    rows = requests.withColumn("skip", is_operational(F.col("target")))
    columns = [*requests.columns, "skip"]
    if delay:
        rows = rows.withColumn("event_time", F.timestamp_millis("now_ms")).withWatermark("event_time", delay)
        columns.append("event_time")
    schema = StructType([*(rows.schema[c] for c in columns), *StructType.fromDDL("verdict string, rule string, action string").fields])
    rows = _run(rows, RuleSetProcessor(rules, columns), schema, delay, "identity")
    key = F.when((F.col("verdict") == "allow") & ~F.col("skip"), F.col("idem_key"))
    fp = F.hex(fingerprint(F.col("method"), F.col("target"), F.col("body"), secret))
    rows = rows.withColumns({"op_key": key, "op": F.lit("request"), "op_fp": F.when(key.isNotNull(), fp), "op_fence": F.lit(None).cast("long"), "op_status": F.col("backend_status").cast("int")})
    rows = rows.withColumn("dealt", F.coalesce(F.concat(F.lit("k"), "op_key"), F.concat(F.lit("n"), F.col("seq").cast("string"))))
    keep = [*schema.names]
    after = StructType([*schema.fields, *StructType.fromDDL(STEP).fields])
    return answered(_run(rows, IdempotencyProcessor(leases, keep), after, delay, "dealt"), requests.columns, F.col("skip"))


def deduplicated(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """The first row of each key within ``delay``: Spark's own operator, for where no outcome is replayed."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def changelog_sink(stream: DataFrame, path: str, checkpoint: str, replicas: int = 1):
    """Appends each micro-batch to ``replicas`` tables. A batch that is run again overwrites its own folder, so its rows
    are there once; a micro-batch is a group commit."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # so that all replicas get the same rows
        for r in range(replicas):
            batch.write.mode("overwrite").parquet(f"{path}/replica={r}/batch={batch_id}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
