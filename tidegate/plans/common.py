"""What the queries and their SQL share: parameters, the request projection, pieces of SQL."""

from __future__ import annotations

import hashlib

from tidegate.schema import Leases, Rule

DAY = 86_400_000
HOUR = 3_600_000
LIMIT = 4
RULES = (Rule("burst-per-hour", HOUR, 2, "challenge"), Rule("steady-per-day", DAY, 4, "throttle"), Rule("heavy-per-week", 7 * DAY, 14, "block"))
LEASES = Leases(lease_ms=2 * DAY, ttl_ms=5 * DAY)
SECRET = hashlib.sha256(b"an example secret").digest()
SHARDS = 32

REQUESTS = """req AS (
  SELECT event_id AS seq, epoch_us(ts) // 1000 AS now_ms, CAST(user_id AS VARCHAR) AS identity, CAST(user_id AS VARCHAR) || '-' || event_type AS idem_key,
    'POST' AS method, '/' || event_type AS target, props AS body, CASE WHEN event_type = 'error' THEN 503 ELSE 201 END AS backend_status
  FROM events
)"""


def hex_number(start: int, n: int, of: str) -> str:
    return f"CAST('0x' || substr(md5({of}), {start}, {n}) AS BIGINT)"


def shard_sql(key: str, shards: int = SHARDS) -> str:
    return f"CAST({hex_number(1, 8, key)} % {shards} AS INTEGER)"


def sliding(source: str, window_ms: int, prefix: str = "", key: str = "identity") -> str:
    """SQL for the columns of a sliding-window count over ``source``."""
    w = f"(now_ms // {window_ms})"
    cur = f"row_number() OVER (PARTITION BY {key}, {w} ORDER BY seq)"
    prev = f"count(*) OVER (PARTITION BY {key} ORDER BY {w} RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)"
    return (
        f"SELECT *, {cur} AS {prefix}current, {prev} AS {prefix}previous, "
        f"{cur} + {prev} * (CAST({window_ms} - now_ms % {window_ms} AS DOUBLE) / CAST({window_ms} AS DOUBLE)) AS {prefix}estimate FROM {source}"
    )


def hmac_sql(message: str, key: bytes = SECRET) -> str:
    """HMAC-SHA256 of a blob, as lower-case hex."""
    key = key.ljust(64, b"\0")
    inner, outer = ("unhex('" + bytes(b ^ pad for b in key).hex() + "')" for pad in (0x36, 0x5C))
    return f"sha256({outer} || unhex(sha256({inner} || {message})))"


def fingerprint_sql(*fields: str) -> str:
    return hmac_sql(" || ".join(f"unhex(printf('%08x', octet_length(encode(coalesce({f}, ''))))) || encode(coalesce({f}, ''))" for f in fields))


def steps_sql(source: str, lease_ms: int, ttl_ms: int) -> str:
    """Recursive SQL for requests whose backend answers at once: ``source(key, seq, fp, now_ms, status)``.

    Columns of st: key, rn, seq, decision, tag, fp, until_ms, fence, outcome_seq.
    """
    live = "(s.tag = 1 AND o.now_ms < s.until_ms)"
    run = f"NOT {live} AND (s.tag = 1 OR (s.fp = o.fp AND o.now_ms >= s.until_ms))"
    good = "o.status < 500"
    return f"""
ordered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn FROM {source}),
st AS (
  SELECT key, rn, seq, CASE WHEN status < 500 THEN 'created' ELSE 'upstream_error' END AS decision, CASE WHEN status < 500 THEN 1 ELSE 0 END AS tag, fp,
    now_ms + CASE WHEN status < 500 THEN {ttl_ms} ELSE {lease_ms} END AS until_ms, 1 AS fence, CASE WHEN status < 500 THEN seq END AS outcome_seq
  FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.key, o.rn, o.seq,
    CASE WHEN {run} THEN CASE WHEN {good} THEN 'created' ELSE 'upstream_error' END
      WHEN s.fp <> o.fp THEN 'mismatch' WHEN s.tag = 1 THEN 'replayed' ELSE 'in_progress' END,
    CASE WHEN {run} THEN CASE WHEN {good} THEN 1 ELSE 0 END ELSE s.tag END,
    CASE WHEN {run} THEN o.fp ELSE s.fp END,
    CASE WHEN {run} THEN o.now_ms + CASE WHEN {good} THEN {ttl_ms} ELSE {lease_ms} END ELSE s.until_ms END,
    CASE WHEN {run} THEN s.fence + 1 ELSE s.fence END,
    CASE WHEN {run} THEN CASE WHEN {good} THEN o.seq END ELSE s.outcome_seq END
  FROM st s JOIN ordered o ON o.key = s.key AND o.rn = s.rn + 1
)"""
