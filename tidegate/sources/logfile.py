"""Log files of framed records: length, CRC-32, chain link, payload (see ``operators.changelog``)."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from struct import Struct, error, unpack_from

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.operators.changelog import HEADER, framed, verified
from tidegate.schema import COMPLETED, IN_PROGRESS

FIELDS = (
    "key string, tag int, fence long, fp binary, lease_expires_at_ms long, completed_at_ms long, status int, "
    "headers map<string,string>, body binary"
)
_NAMES = [f.split()[0] for f in FIELDS.split(", ")]
_KINDS = [pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary()]
_HEAD = Struct("<II32s")


def _sized(data: bytes, at: int) -> tuple[bytes, int]:
    (n,) = unpack_from("<I", data, at)
    if at + 4 + n > len(data):
        raise error("past the end")
    return data[at + 4 : at + 4 + n], at + 4 + n


def _fields(data: bytes) -> tuple | None:
    """The FIELDS of a payload; None if it is cut off or of an unknown kind."""
    try:
        key, at = _sized(data, 0)
        tag, at = data[at], at + 1
        if tag == IN_PROGRESS:
            fence, fp, lease = unpack_from("<Q32sQ", data, at)
            return key.decode(), tag, fence, fp, lease, None, None, None, None
        if tag != COMPLETED:
            return None
        fp, done, status, count = unpack_from("<32sQHI", data, at)
        at, headers = at + 46, {}
        for _ in range(count):
            name, at = _sized(data, at)
            value, at = _sized(data, at)
            headers[name.decode()] = value.decode()
        body, at = _sized(data, at)
        return key.decode(), tag, None, fp, None, done, status, list(headers.items()), body
    except (error, IndexError, UnicodeDecodeError):
        return None


def _frame(data: bytes, at: int) -> tuple[int, int, bytes, bytes] | None:
    """(end, crc, link, payload) of the frame at an offset, if it is all there and its checksum fits."""
    if at + HEADER > len(data):
        return None
    size, crc, link = _HEAD.unpack_from(data, at)
    payload = data[at + HEADER : at + HEADER + size]
    return (at + HEADER + size, crc, link, payload) if len(payload) == size and zlib.crc32(payload) == crc else None


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for data in batch.column(batch.num_columns - 1).to_pylist():
            found = _frame(data or b"", 0)
            rows.append((found and _fields(found[3])) or (None,) * len(_NAMES))
        columns = zip(*rows, strict=True) if rows else ([] for _ in _NAMES)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True))], [*batch.schema.names[:-1], *_NAMES])


def decoded(frames: DataFrame, keep: list[str], column: str = "frame") -> DataFrame:
    """``keep`` and FIELDS for each framed record; all FIELDS are null where a frame cannot be read."""
    schema = f"{', '.join(f'{n} {t}' for n, t in frames.select(*keep).dtypes)}, {FIELDS}"
    return frames.select(*keep, column).mapInArrow(_decode, schema)


LOG = "path string, position long, at long, crc long, chain binary, payload binary, tail string"


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows, at, position = [], 0, 0
            while found := _frame(data, at):
                rows.append((path, position, at, found[1], found[2], found[3], None))
                at, position = found[0], position + 1
            if at < len(data):
                size = _HEAD.unpack_from(data, at)[0] if at + HEADER <= len(data) else 0
                tail = "torn" if at + HEADER + size > len(data) else "corrupt"
                rows.append((path, position, at, None, None, None, tail))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string()]
            columns = zip(*rows, strict=True) if rows else ([] for _ in kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in LOG.split(", ")])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """LOG: a row for each record of each file, in order of ``position``, and one more for a rest that cannot be read:
    ``tail`` is torn where the frame is not all there (a crash), else corrupt. A log is a folder of files, each a chain of
    its own that one task reads."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_split, LOG)


def problems(log: DataFrame) -> DataFrame:
    """(path, at, problem) of what makes LOG rows unusable: a complete frame that does not check, or a record whose link
    does not follow from the one before. A torn rest is none."""
    links = verified(log.where("tail is null"), shard="path").where("not chain_ok")
    broken = links.groupBy("path").agg(F.min("at").alias("at")).withColumn("problem", F.lit("a record does not follow from the one before"))
    return broken.unionByName(log.where("tail = 'corrupt'").select("path", "at", F.lit("a complete record is corrupt").alias("problem")))


def open_log(spark: SparkSession, path: str) -> DataFrame:
    """path, position, chain and FIELDS of all records of the log files at ``path``. A torn rest, which a crash leaves, is
    left out; a log that is damaged otherwise is refused with ValueError, as cutting it there would lose what follows."""
    log = read_log(spark, path)
    if bad := problems(log).orderBy("path", "at").limit(1).collect():
        raise ValueError(f"{bad[0].path} at byte {bad[0].at}: {bad[0].problem}")
    rows = log.where("tail is null").withColumn("frame", framed())
    return decoded(rows, ["path", "position", "chain"])


def _names(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the table that the pointer file at ``path`` names; None before the first one is written."""
    _, place, fs = _names(spark, f"{path}/CURRENT")
    return f"{path}/{spark.read.text(place.toString()).first()[0]}" if fs.exists(place) else None


def replaced(table: DataFrame, path: str) -> str:
    """Writes ``table`` to a new folder under ``path`` and then swaps the pointer file, in one rename: whoever reads the
    pointer sees the old table or the new one, whenever the writer is lost. The old folder stays until it is deleted."""
    spark = table.sparkSession
    name = f"v-{uuid.uuid4().hex}"
    table.write.parquet(f"{path}/{name}")
    jvm, fresh, fs = _names(spark, f"{path}/.{name}")
    out = fs.create(fresh, True)
    out.write(bytearray(name.encode()))
    out.close()
    overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fresh, jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT"), options)
    return f"{path}/{name}"
