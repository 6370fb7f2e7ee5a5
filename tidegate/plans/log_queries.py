"""Queries on the changelog: chains, recovery, compaction, replicas."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.operators import changelog, idempotency
from tidegate.plans.common import DAY, REQUESTS, SHARDS, shard_sql
from tidegate.plans.pipeline import shard_of
from tidegate.plans.registry import query
from tidegate.schema import COMPLETED, IN_PROGRESS, Leases
from tidegate.sources.logfile import decoded
from tidegate.sources.requests import read_events

RECORDS = f"""{REQUESTS}, rec AS (
  SELECT seq, idem_key AS key, {shard_sql('idem_key')} AS shard, CASE WHEN backend_status >= 500 THEN 0 ELSE 1 END AS tag, seq AS fence, now_ms, now_ms + {DAY} AS lease_expires_at_ms, backend_status AS status, body FROM req
)"""


def records(spark, sf_dir):
    """One state written by each request: an outcome, or what its failure leaves in progress."""
    rows = read_events(spark, sf_dir)
    return rows.select(
        shard_of(F.col("idem_key"), SHARDS).alias("shard"), "seq", F.col("idem_key").alias("key"), F.when(F.col("backend_status") >= 500, IN_PROGRESS).otherwise(COMPLETED).alias("tag"),
        F.col("seq").alias("fence"), F.unhex(F.sha2("body", 256)).alias("fp"), (F.col("now_ms") + DAY).alias("lease_expires_at_ms"), F.col("now_ms").alias("completed_at_ms"),
        F.col("backend_status").alias("status"), F.create_map(F.lit("content-type"), F.lit("application/json")).alias("headers"), F.col("body").cast("binary").alias("body"),
    )


def chain(spark, sf_dir):
    return changelog.chained(changelog.encoded(records(spark, sf_dir)))


@query(f"WITH {RECORDS}, l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS back FROM rec) SELECT key, CAST(tag AS INTEGER) AS tag, fence, status FROM l WHERE back = 1")
def changelog_latest(spark, sf_dir):
    return changelog.latest(records(spark, sf_dir), ["tag", "fence", "status"])


def _le_sql(n: str, size: int) -> str:
    h = f"printf('%0{2 * size}x', {n})"
    return "unhex(" + " || ".join(f"substr({h}, {i}, 2)" for i in range(2 * size - 1, 0, -2)) + ")"


def _bytes_sql(x: str) -> str:
    return f"{_le_sql(f'octet_length({x})', 4)} || {x}"


_PAYLOAD = f"""{_bytes_sql('encode(key)')} || CASE
  WHEN tag = 0 THEN unhex('00') || {_le_sql('fence', 8)} || unhex(sha256(body)) || {_le_sql('lease_expires_at_ms', 8)}
  ELSE unhex('01') || unhex(sha256(body)) || {_le_sql('now_ms', 8)} || {_le_sql('status', 2)} || {_le_sql('1', 4)} || {_bytes_sql("encode('content-type')")} || {_bytes_sql("encode('application/json')")} || {_bytes_sql('encode(body)')} END"""

#: CRC-32 by a table that its polynomial gives, and each shard's chain step by step.
_CHAIN = f"""WITH RECURSIVE {RECORDS},
t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
p AS (SELECT shard, seq, key, row_number() OVER (PARTITION BY shard ORDER BY seq) AS n, {_PAYLOAD} AS b FROM rec),
h AS (SELECT *, hex(b) AS h, octet_length(b) AS size FROM p),
x AS (SELECT h.*, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, 2 * size, 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))), lambda c, v: xor(c >> 8, t.t[xor(c & 255, v) + 1]))) AS crc FROM h, t),
l AS (
  SELECT shard, seq, key, n, crc, size, sha256(unhex(repeat('00', 32)) || {_le_sql('crc', 4)} || b) AS chain FROM x WHERE n = 1
  UNION ALL SELECT x.shard, x.seq, x.key, x.n, x.crc, x.size, sha256(unhex(l.chain) || {_le_sql('x.crc', 4)} || x.b) FROM l JOIN x ON x.shard = l.shard AND x.n = l.n + 1
)"""


@query(f"{_CHAIN} SELECT shard, seq, key, crc, chain, CAST(size + 40 AS INTEGER) AS frame_bytes FROM l")
def changelog_chain(spark, sf_dir):
    """Links of all records."""
    return chain(spark, sf_dir).select("shard", "seq", "key", "crc", F.lower(F.hex("chain")).alias("chain"), F.octet_length(changelog.framed()).alias("frame_bytes"))


@query(f"{_CHAIN} SELECT shard, max_by(chain, n) AS root FROM l GROUP BY shard")
def changelog_roots(spark, sf_dir):
    """The last link of each shard."""
    return changelog.roots(chain(spark, sf_dir)).select("shard", F.lower(F.hex("root")).alias("root"))


@query(f"""WITH {RECORDS} SELECT shard, seq, key, CAST(tag AS INTEGER) AS tag, CASE WHEN tag = 0 THEN fence END AS fence, sha256(body) AS fp, CASE WHEN tag = 0 THEN lease_expires_at_ms END AS lease_expires_at_ms,
  CASE WHEN tag = 1 THEN now_ms END AS completed_at_ms, CASE WHEN tag = 1 THEN CAST(status AS INTEGER) END AS status, CASE WHEN tag = 1 THEN body END AS body FROM rec""")
def changelog_decode(spark, sf_dir):
    """Framed records read back."""
    frames = chain(spark, sf_dir).select("shard", "seq", changelog.framed().alias("frame"))
    rows = decoded(frames, ["shard", "seq"])
    return rows.select("shard", "seq", "key", "tag", "fence", F.lower(F.hex("fp")).alias("fp"), "lease_expires_at_ms", "completed_at_ms", "status", F.col("body").cast("string").alias("body"))


@query(f"WITH {RECORDS}, p AS (SELECT seq, {_PAYLOAD} AS b FROM rec) SELECT seq, sha256(b) AS payload_sha256, CAST(octet_length(b) AS INTEGER) AS bytes FROM p")
def changelog_payloads(spark, sf_dir):
    rows = changelog.encoded(records(spark, sf_dir))
    return rows.select("seq", F.sha2("payload", 256).alias("payload_sha256"), F.octet_length("payload").alias("bytes"))


@query(f"WITH {RECORDS} SELECT shard, min(seq) FILTER (seq % 97 = 5) AS position FROM rec GROUP BY shard HAVING count(*) FILTER (seq % 97 = 5) > 0")
def changelog_verify_tampered(spark, sf_dir):
    """Some payloads are changed and their checksums made to fit; the links still tell."""
    rows = chain(spark, sf_dir)
    other = F.concat(F.col("payload"), F.lit(b"!"))
    hit = F.col("seq") % 97 == 5
    rows = rows.withColumn("payload", F.when(hit, other).otherwise(F.col("payload"))).withColumn("crc", F.when(hit, F.crc32("payload")).otherwise(F.col("crc")))
    return changelog.first_break(changelog.verified(rows), order="seq")


@query(f"""WITH {RECORDS}, l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS back FROM rec), m AS (SELECT max(now_ms) AS now FROM rec)
SELECT shard, key, CAST(tag AS INTEGER) AS tag, row_number() OVER (PARTITION BY shard ORDER BY key) AS place, true AS linked FROM l, m WHERE back = 1 AND (tag = 0 OR m.now < now_ms + {5 * DAY})""")
def changelog_compact(spark, sf_dir):
    now = read_events(spark, sf_dir).agg(F.max("now_ms")).first()[0]
    keep = (F.col("tag") == IN_PROGRESS) | (F.lit(now) < F.col("completed_at_ms") + 5 * DAY)
    out = changelog.verified(changelog.compacted(changelog.encoded(records(spark, sf_dir)), keep))
    return out.select("shard", "key", "tag", (F.col("position") + 1).alias("place"), F.col("chain_ok").alias("linked"))


@query(f"""WITH {RECORDS}, f AS (SELECT shard, max(seq) FILTER (seq % 256 = 255) AS upto FROM rec GROUP BY shard), k AS (SELECT rec.* FROM rec JOIN f USING (shard) WHERE seq <= upto),
l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS back FROM k) SELECT key, seq, CAST(tag AS INTEGER) AS tag FROM l WHERE back = 1""")
def changelog_group_commit_recovery(spark, sf_dir):
    """Only what the last flush of a shard has reached is there after a crash."""
    rows = records(spark, sf_dir)
    flushed = rows.groupBy("shard").agg(F.max(F.when(F.col("seq") % 256 == 255, F.col("seq"))).alias("upto"))
    return changelog.latest(changelog.recovered(rows, flushed), ["seq", "tag"])


@query(f"WITH {RECORDS} SELECT seq, CASE seq % 3 WHEN 0 THEN 'torn' WHEN 1 THEN 'corrupt' END AS tail FROM rec")
def tail_classification(spark, sf_dir):
    """A third of the frames is cut off somewhere, a third has a byte changed in its payload."""
    rows = chain(spark, sf_dir).select("seq", changelog.framed().alias("frame"))
    n = F.octet_length("frame")
    cut = F.substring("frame", F.lit(1), F.pmod(F.col("seq") * 31, n).cast("int"))
    at = (changelog.HEADER + F.pmod(F.col("seq"), n - changelog.HEADER)).cast("int")
    byte = F.substring("frame", at + 1, F.lit(1))
    flipped = F.concat(F.substring("frame", F.lit(1), at), F.when(F.hex(byte) == "00", F.lit(b"\xff")).otherwise(F.lit(b"\x00")), F.substring("frame", at + 2, n))
    return rows.select("seq", changelog.tail_of(F.when(F.col("seq") % 3 == 0, cut).when(F.col("seq") % 3 == 1, flipped).otherwise(F.col("frame"))).alias("tail"))


@query(f"""WITH {RECORDS}, l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS back FROM rec)
SELECT shard, CAST(coalesce(max(fence) FILTER (tag = 0), 0) + 1 AS BIGINT) AS next_fence FROM l WHERE back = 1 GROUP BY shard""")
def fence_seed(spark, sf_dir):
    return changelog.fence_seed(records(spark, sf_dir))


@query(f"""WITH {RECORDS}, k AS (SELECT key, max(seq) AS last, max(seq) FILTER (seq % 101 <> 0) AS other FROM rec GROUP BY key)
SELECT CAST(1 AS INTEGER) AS replica, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra
UNION ALL SELECT CAST(2 AS INTEGER), count(*) FILTER (other IS NULL OR other <> last), count(*) FILTER (other IS NOT NULL AND other <> last) FROM k""")
def replica_divergence(spark, sf_dir):
    """The second replica has lost some writes; the first has all of them."""
    rows = changelog.replicated(records(spark, sf_dir).select("key", "seq", "tag", "fence"), 3).where("replica <> 2 or seq % 101 <> 0")
    return changelog.divergence(rows, ["tag", "fence"], 3)


@query(f"WITH {RECORDS}, l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS back FROM rec) SELECT CAST(1 AS INTEGER) AS replica, key, fence FROM l WHERE back = 1")
def replica_promotion(spark, sf_dir):
    """With the primary gone, a replica answers for it."""
    rows = changelog.replicated(records(spark, sf_dir).select("key", "seq", "fence"), 2).where("replica = 1")
    return changelog.latest(rows, ["replica", "fence"]).select("replica", "key", "fence")


@query(f"""WITH {RECORDS}, f AS (SELECT shard, max(seq) FILTER (seq % 256 = 255) AS upto FROM rec GROUP BY shard), k AS (SELECT rec.* FROM rec JOIN f USING (shard) WHERE seq <= upto),
l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS back FROM k), m AS (SELECT max(now_ms) AS now FROM rec),
s AS (SELECT l.*, now, CASE WHEN tag = 1 THEN now_ms + {5 * DAY} ELSE now_ms + {2 * DAY} END AS until_ms, CASE WHEN seq % 4 = 0 THEN 'other' ELSE sha256(body) END = sha256(body) AS same FROM l, m WHERE back = 1),
d AS (SELECT *, CASE WHEN tag = 1 AND now < until_ms THEN CASE WHEN same THEN 'replay' ELSE 'mismatch' END WHEN tag = 0 AND NOT same THEN 'mismatch' WHEN tag = 0 AND now < until_ms THEN 'in_progress' ELSE 'run' END AS decision FROM s)
SELECT key, decision, CASE WHEN decision = 'replay' THEN seq END AS outcome_seq,
  CASE WHEN tag = 1 AND decision <> 'run' THEN 'already_completed' WHEN decision = 'run' THEN 'stale_fence' ELSE 'ok' END AS old_token FROM d""")
def changelog_recovered_decisions(spark, sf_dir):
    """After a crash each key that was flushed is begun anew, and then a worker from before completes with its old token."""
    rows = records(spark, sf_dir)
    flushed = rows.groupBy("shard").agg(F.max(F.when(F.col("seq") % 256 == 255, F.col("seq"))).alias("upto"))
    states = changelog.latest(changelog.recovered(rows, flushed), ["seq", "tag", "fence", "fp", "completed_at_ms", "status"])
    now = read_events(spark, sf_dir).agg(F.max("now_ms")).first()[0]
    done, fp, fence = F.col("tag") == COMPLETED, F.lower(F.hex("fp")), F.col("fence")
    none = F.lit(None)
    op = lambda place, name, fp, at, fence, status: F.struct((4 * F.col("seq") + place).alias("seq"), name.alias("op"), fp.cast("string").alias("fp"), at.cast("long").alias("now_ms"), fence.cast("long").alias("fence"), status.cast("int").alias("status"))
    restored = op(0, F.when(done, "restored_completed").otherwise("restored_in_progress"), fp, F.col("completed_at_ms") + F.when(done, 5 * DAY).otherwise(2 * DAY), fence, F.col("status"))
    begun = op(1, F.lit("begin"), F.when(F.col("seq") % 4 == 0, "other").otherwise(fp), F.lit(now), none, none)
    ended = op(2, F.lit("complete"), none, F.lit(now), fence, F.lit(200))
    ops = states.select("key", F.explode(F.array(restored, begun, ended)).alias("o")).select("key", "o.*")
    got = idempotency.decided(ops, Leases(2 * DAY, 5 * DAY))
    by_key = got.groupBy("key").agg(
        F.max(F.when(F.col("seq") % 4 == 1, F.struct("decision", "outcome_seq"))).alias("b"), F.max(F.when(F.col("seq") % 4 == 2, F.col("decision"))).alias("old_token")
    )
    return by_key.select("key", "b.decision", F.when(F.col("b.decision") == "replay", F.expr("b.outcome_seq div 4")).alias("outcome_seq"), "old_token")
