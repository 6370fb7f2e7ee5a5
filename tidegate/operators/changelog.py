"""A changelog of keyed states: encoded, check-summed and hash-chained records, as rows of a table.

Each shard is a chain of its own: a record's link is the digest of the link before, the payload's checksum and the
payload. Writing a chain goes through a shard's records in order, as many at a time as there are shards, so that their
number should grow with the table. Checking does not: every record carries the link it was made with and its position,
so that records are dealt by slots of positions, and only the last link of each slot goes on to the next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tidegate.functions.crypto import le16, le32, le64, le_bytes, sha256
from tidegate.schema import COMPLETED, IN_PROGRESS

GENESIS = bytes(32)
HEADER = 4 + 4 + 32


def payload() -> Column:
    """The record's key and state as bytes, little-endian; strings and bytes behind their lengths."""
    pairs = F.array_sort(F.map_entries("headers"))
    headers = F.aggregate(pairs, F.lit(b"").cast("binary"), lambda out, h: F.concat(out, le_bytes(h["key"]), le_bytes(h["value"])))
    progress = F.concat(F.lit(bytes([IN_PROGRESS])), le64(F.col("fence")), F.col("fp"), le64(F.col("lease_expires_at_ms")))
    completed = F.concat(
        F.lit(bytes([COMPLETED])), F.col("fp"), le64(F.col("completed_at_ms")), le16(F.col("status")), le32(F.size("headers")), headers, le_bytes(F.col("body"))
    )
    return F.concat(le_bytes(F.col("key")), F.when(F.col("tag") == IN_PROGRESS, progress).otherwise(completed))


def link(before: Column, crc: Column, data: Column) -> Column:
    return sha256(F.concat(before, le32(crc), data))


#: Positions that are checked together.
SLOT = 1 << 16


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard, before, place = object(), GENESIS, 0
    for batch in batches:
        names = batch.schema.names
        links, places = [], []
        for s, crc, data in zip(*(batch.column(names.index(c)).to_pylist() for c in ("shard", "crc", "payload")), strict=True):
            if s != shard:
                shard, before, place = s, GENESIS, 0
            before = hashlib.sha256(before + crc.to_bytes(4, "little") + data).digest()
            links.append(before)
            places.append(place)
            place += 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(links, pa.binary()), pa.array(places, pa.int64())], [*names, "chain", "position"])


def encoded(records: DataFrame) -> DataFrame:
    """``records`` with ``payload`` and ``crc``."""
    return records.withColumn("payload", payload()).withColumn("crc", F.crc32("payload"))


def chained(rows: DataFrame, order: str = "seq") -> DataFrame:
    """``rows(shard, crc, payload, ...)`` with ``chain`` and ``position``, linked within shards in the order given."""
    schema = StructType([*rows.schema.fields, StructField("chain", BinaryType()), StructField("position", LongType())])
    return rows.repartition("shard").sortWithinPartitions("shard", order).mapInArrow(_chain, schema)


def framed() -> Column:
    """A record as it is written: length, checksum, link, payload."""
    return F.concat(le32(F.octet_length("payload")), le32(F.col("crc")), F.col("chain"), F.col("payload"))


def verified(rows: DataFrame, shard: str = "shard") -> DataFrame:
    """``rows(shard, position, crc, payload, chain)`` with ``crc_ok`` and ``chain_ok``: whether payload and link are what
    the record before leads to. A missing position breaks the chain behind it."""
    rows = rows.withColumn("__slot", F.expr(f"position div {SLOT}L"))
    ends = rows.groupBy(shard, "__slot").agg(F.max(F.struct("position", "chain")).alias("__end"))
    ends = ends.select(F.col(shard).alias("__shard"), (F.col("__slot") + 1).alias("__next"), "__end")
    own = W.partitionBy(shard, "__slot").orderBy("position")
    rows = rows.withColumn("__last", F.lag(F.struct("position", "chain")).over(own))
    rows = rows.join(ends, (F.col(shard) == F.col("__shard")) & (F.col("__slot") == F.col("__next")), "left")
    last = F.coalesce("__last", "__end")
    before = F.when(F.col("position") == 0, F.lit(GENESIS)).when(last["position"] == F.col("position") - 1, last["chain"])
    chain_ok = F.coalesce(link(before, F.col("crc"), F.col("payload")) == F.col("chain"), F.lit(False))
    rows = rows.withColumns({"crc_ok": F.crc32("payload") == F.col("crc"), "chain_ok": chain_ok})
    return rows.drop("__slot", "__last", "__shard", "__next", "__end")


def first_break(checked: DataFrame, order: str = "position") -> DataFrame:
    """(shard, position) of the first record of each shard that does not check; shards without one have none."""
    return checked.where("not crc_ok or not chain_ok").groupBy("shard").agg(F.min(order).alias("position"))


def roots(rows: DataFrame, shard: str = "shard") -> DataFrame:
    """(shard, root): the last link of each shard, which stands for all of its records. One without records has none;
    its root would be GENESIS."""
    return rows.groupBy(shard).agg(F.max_by("chain", "position").alias("root"))


def tail_class(remaining: Column, payload_len: Column) -> Column:
    """What an undecodable rest of a log is: torn, if its frame is not complete, else corrupt."""
    return F.when((remaining < HEADER) | (remaining < HEADER + payload_len), "torn").otherwise("corrupt")


def _from_le32(data: Column, at: int) -> Column:
    h = F.hex(data)
    return F.conv(F.concat(*[F.substring(h, 2 * (at + i) - 1, 2) for i in (3, 2, 1, 0)]), 16, 10).cast("long")


def tail_of(frame: Column) -> Column:
    """What a log's rest is that begins with ``frame``: null if that is a whole record, else torn or corrupt."""
    size = _from_le32(frame, 1)
    payload = F.substring(frame, F.lit(HEADER + 1), size.cast("int"))
    short = F.octet_length(frame) < HEADER
    good = ~short & (F.octet_length(frame) >= HEADER + size) & (F.crc32(payload) == _from_le32(frame, 5))
    return F.when(~F.coalesce(good, F.lit(False)), tail_class(F.octet_length(frame), F.when(short, 0).otherwise(size)))


def latest(rows: DataFrame, columns: list[str], order: str = "seq") -> DataFrame:
    """The last state of each key; sums of maxima, which combine before the shuffle."""
    last = rows.groupBy("key").agg(F.max_by(F.struct(*columns), order).alias("s"))
    return last.select("key", *[F.col(f"s.{c}").alias(c) for c in columns])


def recovered(rows: DataFrame, flushed: DataFrame) -> DataFrame:
    """``rows`` that a crash leaves: those up to ``flushed(shard, upto)``, the last record known to be written."""
    return rows.join(flushed, "shard").where("seq <= upto").drop("upto")


def fence_seed(rows: DataFrame) -> DataFrame:
    """(shard, next_fence): one more than the largest fence in progress in the last states."""
    own = latest(rows, ["shard", "tag", "fence"])
    return own.groupBy("shard").agg((F.coalesce(F.max(F.when(F.col("tag") == IN_PROGRESS, F.col("fence"))), F.lit(0)) + 1).cast("long").alias("next_fence"))


def compacted(rows: DataFrame, keep: Column) -> DataFrame:
    """The last record of each key that is to be kept, chained anew by key."""
    columns = [c for c in rows.columns if c not in ("key", "chain", "position")]
    return chained(latest(rows, columns).where(keep), order="key")


def replicated(rows: DataFrame, replicas: int) -> DataFrame:
    """Every row once for each of ``replicas`` copies; copy 0 is the primary."""
    return rows.withColumn("replica", F.explode(F.array(*map(F.lit, range(replicas)))))


def divergence(rows: DataFrame, columns: list[str], replicas: int) -> DataFrame:
    """(replica, missing, extra): how the last states of each replica differ from those of the primary."""
    own = rows.groupBy("replica", "key").agg(F.max_by(F.struct(*columns), "seq").alias("s"))
    want = own.where("replica = 0").select("key", F.col("s").alias("p")).withColumn("replica", F.explode(F.array(*map(F.lit, range(1, replicas)))))
    both = want.join(own.where("replica <> 0"), ["replica", "key"], "full")
    differs = ~F.coalesce(F.col("p") == F.col("s"), F.lit(False))
    return both.groupBy("replica").agg(
        F.count_if(F.col("p").isNotNull() & differs).alias("missing"), F.count_if(F.col("s").isNotNull() & differs).alias("extra")
    )
