"""Queries on idempotency, the request path, metrics and the text form of requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.operators import idempotency, metrics
from tidegate.plans import pipeline
from tidegate.plans.common import DAY, LEASES, REQUESTS, RULES, SECRET, SHARDS, fingerprint_sql, shard_sql, sliding, steps_sql
from tidegate.plans.registry import query
from tidegate.schema import Leases
from tidegate.sources import requests as req
from tidegate.sources.requests import read_events

TTL = Leases(lease_ms=2 * DAY, ttl_ms=5 * DAY)


def _operations(spark, sf_dir, fp, status=None):
    rows = read_events(spark, sf_dir).withColumn("fp", fp)
    if status is not None:
        rows = rows.withColumn("backend_status", status)
    return idempotency.as_operations(rows)


def _thirds():
    return (F.col("seq") % 3).cast("string")


def _steps(fp: str, status: str, leases: Leases = TTL, key: str = "idem_key") -> str:
    return f"WITH RECURSIVE {REQUESTS}, o AS (SELECT {key} AS key, seq, {fp} AS fp, now_ms, {status} AS status FROM req), {steps_sql('o', leases.lease_ms, leases.ttl_ms)}"


THIRDS = "CAST(seq % 3 AS VARCHAR)"


@query(f"""WITH {REQUESTS}, f AS (SELECT *, seq % 7 AS fp, min(seq) OVER (PARTITION BY idem_key) AS outcome_seq, first_value(seq % 7) OVER (PARTITION BY idem_key ORDER BY seq) AS first_fp FROM req)
SELECT seq, idem_key, CASE WHEN seq = outcome_seq THEN 'created' WHEN fp = first_fp THEN 'replayed' ELSE 'mismatch' END AS decision, outcome_seq FROM f""")
def dedupe_first_effect(spark, sf_dir):
    rows = read_events(spark, sf_dir).withColumn("fp", F.col("seq") % 7)
    return idempotency.first_effects(rows).select("seq", "idem_key", "decision", "outcome_seq")


@query(f"{_steps(THIRDS, '201')} SELECT key, seq, decision, CAST(CASE WHEN decision = 'created' THEN fence END AS BIGINT) AS fence, outcome_seq FROM st")
def idempotency_decisions_ttl(spark, sf_dir):
    return idempotency.decided(_operations(spark, sf_dir, _thirds(), F.lit(201)), TTL).select("key", "seq", "decision", "fence", "outcome_seq")


@query(f"{_steps(THIRDS, 'CASE WHEN seq % 2 = 0 THEN 503 ELSE 201 END')} SELECT key, seq, decision, CAST(tag AS INTEGER) AS tag, until_ms FROM st")
def idempotency_lease_takeover(spark, sf_dir):
    """Half of the backends fail, so that keys stay in progress until their lease is over."""
    status = F.when(F.col("seq") % 2 == 0, 503).otherwise(201)
    return idempotency.decided(_operations(spark, sf_dir, _thirds(), status), TTL).select("key", "seq", "decision", "tag", "until_ms")


FENCE_LEASES = Leases(lease_ms=2 * DAY, ttl_ms=9 * DAY)


@query(f"""WITH RECURSIVE {REQUESTS}, n AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY seq) AS rn FROM req),
o AS (SELECT identity AS key, seq, now_ms, rn, CASE WHEN rn % 3 = 0 THEN 'complete' ELSE 'begin' END AS op, CASE WHEN rn % 2 = 0 THEN 1 ELSE 2 END + rn // 9 AS token FROM n),
st AS (
  SELECT key, rn, seq, 'run' AS decision, 0 AS tag, 1 AS fence, now_ms + {FENCE_LEASES.lease_ms} AS until_ms FROM o WHERE rn = 1
  UNION ALL
  SELECT o.key, o.rn, o.seq,
    CASE WHEN op = 'begin' THEN CASE WHEN o.now_ms >= s.until_ms THEN 'run' WHEN s.tag = 1 THEN 'replay' ELSE 'in_progress' END
      WHEN s.tag = 1 THEN 'already_completed' WHEN o.token <> s.fence THEN 'stale_fence' ELSE 'ok' END,
    CASE WHEN op = 'begin' THEN CASE WHEN o.now_ms >= s.until_ms THEN 0 ELSE s.tag END WHEN s.tag = 1 OR o.token = s.fence THEN 1 ELSE s.tag END,
    CASE WHEN op = 'begin' AND o.now_ms >= s.until_ms THEN s.fence + 1 ELSE s.fence END,
    CASE WHEN op = 'begin' AND o.now_ms >= s.until_ms THEN o.now_ms + {FENCE_LEASES.lease_ms} WHEN op = 'complete' AND s.tag = 0 AND o.token = s.fence THEN o.now_ms + {FENCE_LEASES.ttl_ms} ELSE s.until_ms END
  FROM st s JOIN o ON o.key = s.key AND o.rn = s.rn + 1
) SELECT key, seq, decision, CAST(tag AS INTEGER) AS tag FROM st""")
def idempotency_fencing(spark, sf_dir):
    """Begins and completions of their own; every third operation of a key completes with a token that may be stale."""
    from pyspark.sql import Window as W

    rows = read_events(spark, sf_dir).withColumn("rn", F.row_number().over(W.partitionBy("identity").orderBy("seq")))
    token = F.when(F.col("rn") % 2 == 0, 1).otherwise(2) + F.floor(F.col("rn") / 9)
    ops = rows.select(
        F.col("identity").alias("key"), "seq", F.when(F.col("rn") % 3 == 0, "complete").otherwise("begin").alias("op"), F.lit("x").alias("fp"), "now_ms", token.alias("fence"), F.lit(201).alias("status")
    )
    return idempotency.decided(ops, FENCE_LEASES).select("key", "seq", "decision", "tag")


@query(f"{_steps(THIRDS, '201')} SELECT key, count(*) FILTER (decision = 'mismatch') AS mismatches, count(*) FILTER (decision = 'created') AS effects FROM st GROUP BY key")
def idempotency_mismatch(spark, sf_dir):
    rows = idempotency.decided(_operations(spark, sf_dir, _thirds(), F.lit(201)), TTL)
    return rows.groupBy("key").agg(F.count_if(F.col("decision") == "mismatch").alias("mismatches"), F.count_if(F.col("decision") == "created").alias("effects"))


@query(f"""{_steps(THIRDS, '201')}, r AS (SELECT key, seq, {shard_sql('key')} AS shard FROM st WHERE decision = 'created')
SELECT shard, seq, key, row_number() OVER (PARTITION BY shard ORDER BY seq) AS shard_fence FROM r""")
def fence_assignment(spark, sf_dir):
    rows = idempotency.decided(_operations(spark, sf_dir, _thirds(), F.lit(201)), TTL).withColumn("shard", pipeline.shard_of(F.col("key"), SHARDS))
    return idempotency.fences(rows, "shard").select("shard", "seq", "key", "shard_fence")


@query(f"""{_steps(THIRDS, 'backend_status')}, l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS back FROM st), m AS (SELECT max(now_ms) AS now FROM req)
SELECT key, CAST(tag AS INTEGER) AS tag, until_ms FROM l, m WHERE back = 1 AND (tag = 0 OR m.now < until_ms)""")
def prune_expired(spark, sf_dir):
    rows = _operations(spark, sf_dir, _thirds())
    now = rows.agg(F.max("now_ms")).first()[0]
    return idempotency.pruned(idempotency.snapshot(idempotency.decided(rows, TTL)), now).select("key", "tag", "until_ms")


@query(f"""{_steps(THIRDS, '201')}, c AS (SELECT key, seq FROM st WHERE decision = 'created'), e AS (SELECT key, count(*) AS effects FROM c GROUP BY key)
SELECT count(*) AS keys, CAST(sum(effects) AS BIGINT) AS effects, CAST(0 AS BIGINT) AS broken FROM e""")
def exactly_once_audit(spark, sf_dir):
    """Replays must name an effect of their key that is not over; an effect must not fall in the time of another."""
    from pyspark.sql import Window as W

    rows = idempotency.decided(_operations(spark, sf_dir, _thirds(), F.lit(201)), TTL).join(read_events(spark, sf_dir).select("seq", "now_ms"), "seq")
    order = W.partitionBy("key").orderBy("seq")
    effect = F.when(F.col("decision") == "created", F.col("seq"))
    rows = rows.withColumns({"last": F.last(effect, ignorenulls=True).over(order), "since": F.last(F.when(F.col("decision") == "created", F.col("now_ms")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))})
    bad = ((F.col("decision") == "replayed") & (F.col("outcome_seq") != F.col("last"))) | ((F.col("decision") == "created") & (F.col("now_ms") < F.col("since") + TTL.ttl_ms))
    by_key = rows.groupBy("key").agg(F.count_if(F.col("decision") == "created").alias("effects"), F.count_if(bad).alias("broken"))
    return by_key.agg(F.count(F.lit(1)).alias("keys"), F.sum("effects").alias("effects"), F.sum("broken").alias("broken"))


# -- the whole path


def _gateway_sql() -> str:
    parts, source = [], "rest"
    for i, r in enumerate(RULES):
        parts.append(f"c{i} AS ({sliding(source, r.window_ms, f'r{i}_')})")
        source = f"c{i}"
    case = lambda what: "CASE " + " ".join(f"WHEN r{i}_estimate > {r.limit} THEN '{getattr(r, what)}'" for i, r in enumerate(RULES)) + " END"
    return f"""WITH RECURSIVE {REQUESTS}, gr AS (
  SELECT * REPLACE (CASE WHEN seq % 23 = 0 THEN '/healthz' WHEN seq % 29 = 0 THEN '/metrics?x=1' WHEN seq % 31 = 0 THEN NULL ELSE target END AS target, CASE WHEN seq % 13 <> 0 THEN '{{}}' END AS body),
    coalesce(seq % 23 = 0 OR seq % 29 = 0, false) AS own FROM req
), rest AS (SELECT * FROM gr WHERE NOT own), {', '.join(parts)},
v AS (SELECT *, {case('name')} AS rule, {case('action')} AS action, CASE WHEN seq % 10 = 0 THEN NULL ELSE idem_key END AS ik FROM {source}),
o AS (SELECT ik AS key, seq, {fingerprint_sql('method', 'target', 'body')} AS fp, now_ms, backend_status AS status FROM v WHERE rule IS NULL AND ik IS NOT NULL),
{steps_sql('o', LEASES.lease_ms, LEASES.ttl_ms)},
g AS (
  SELECT v.seq, v.identity, v.target, v.now_ms, rule, action, v.ik, CASE WHEN rule IS NOT NULL THEN 'denied' WHEN ik IS NULL THEN 'passthrough' ELSE decision END AS outcome, backend_status,
    CASE WHEN decision IN ('created', 'replayed') THEN outcome_seq END AS outcome_seq
  FROM v LEFT JOIN st ON st.seq = v.seq
), a AS (
  SELECT g.*, CAST(CASE outcome WHEN 'denied' THEN 429 WHEN 'mismatch' THEN 422 WHEN 'in_progress' THEN 409 WHEN 'replayed' THEN s.backend_status ELSE g.backend_status END AS INTEGER) AS status
  FROM g LEFT JOIN req s ON s.seq = g.outcome_seq
  UNION ALL SELECT seq, identity, target, now_ms, NULL, NULL, NULL, 'operational', backend_status, NULL, 200 FROM gr WHERE own
)"""


def _handled(spark, sf_dir):
    """Some requests ask for operational endpoints, some have no target, body or key."""
    seq = F.col("seq")
    target = F.when(seq % 23 == 0, "/healthz").when(seq % 29 == 0, "/metrics?x=1").when(seq % 31 != 0, F.col("target"))
    rows = read_events(spark, sf_dir).withColumns({"idem_key": F.when(seq % 10 != 0, F.col("idem_key")), "body": F.when(seq % 13 != 0, "{}"), "target": target})
    return pipeline.handled(rows, RULES, SECRET, LEASES)


@query(f"{_gateway_sql()} SELECT seq, identity, outcome, status, rule, action, outcome_seq FROM a")
def gateway_pipeline(spark, sf_dir):
    return _handled(spark, sf_dir).select("seq", "identity", "outcome", "status", "rule", "action", "outcome_seq")


_COUNTS = "count(*) FILTER (outcome NOT IN ('denied', 'operational')) AS requests_total, " + ", ".join(f"count(*) FILTER (outcome = '{o}') AS {o}" for o in metrics.OUTCOMES)


@query(f"{_gateway_sql()} SELECT {_COUNTS} FROM a")
def gateway_metrics(spark, sf_dir):
    return metrics.merged(metrics.counters(_handled(spark, sf_dir)))


@query(f"{_gateway_sql()} SELECT {shard_sql('identity')} AS shard, {_COUNTS} FROM a GROUP BY shard")
def metrics_by_shard(spark, sf_dir):
    return metrics.counters(_handled(spark, sf_dir).withColumn("shard", pipeline.shard_of(F.col("identity"), SHARDS)), "shard")


_TEXT = ["'# HELP gate_requests_total Requests handled.'", "'# TYPE gate_requests_total counter'", "'gate_requests_total ' || requests_total", "'# HELP gate_outcomes_total Responses by how they came about.'", "'# TYPE gate_outcomes_total counter'"] + [
    f"'gate_outcomes_total{{outcome=\"{o}\"}} ' || {o}" for o in metrics.OUTCOMES
]


@query(f"{_gateway_sql()}, t AS (SELECT {_COUNTS} FROM a) " + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS line_no, {x} AS line FROM t" for i, x in enumerate(_TEXT)))
def prometheus_text(spark, sf_dir):
    return metrics.exposition(metrics.counters(_handled(spark, sf_dir)))


_LINES = " || chr(10) || ".join(_TEXT)


@query(f"""{_gateway_sql()}, t AS (SELECT {_COUNTS} FROM a), x AS (SELECT {_LINES} || chr(10) AS text FROM t), b AS (SELECT a.*, string_split(target, '?')[1] AS path FROM a)
SELECT seq, status, array_to_string(list_filter([
    CASE WHEN outcome = 'operational' AND path = '/metrics' THEN 'Content-Type: text/plain; version=0.0.4' END,
    'Gate-Status: ' || CASE WHEN outcome = 'operational' AND path = '/healthz' THEN 'healthy' ELSE MAP {{'created': 'created', 'replayed': 'replayed', 'in_progress': 'in-progress', 'mismatch': 'mismatch', 'denied': 'denied'}}[outcome] END,
    'Gate-Rule: ' || rule, 'Gate-Action: ' || action], lambda h: h IS NOT NULL), ', ') AS headers,
  CASE WHEN outcome = 'operational' AND path = '/healthz' THEN 'ok' WHEN outcome = 'operational' THEN x.text WHEN outcome = 'replayed' THEN 'made by ' || outcome_seq
    WHEN outcome IN ('in_progress', 'mismatch', 'denied') THEN '' ELSE 'made by ' || seq END AS body FROM b, x""")
def gateway_responses(spark, sf_dir):
    """What is sent back for each request: status, headers, body."""
    rows = _handled(spark, sf_dir).withColumn("backend_body", F.concat(F.lit("made by "), F.col("seq").cast("string")))
    lines = metrics.exposition(metrics.merged(metrics.counters(rows))).orderBy("line_no").collect()  # one row of counters as text
    out = pipeline.responses(rows, "backend_body", "".join(f"{r.line}\n" for r in lines))
    return out.withColumn("headers", F.array_join(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), ", "))


@query(f"WITH {REQUESTS} SELECT {shard_sql('idem_key')} AS shard, count(*) AS n, count(DISTINCT idem_key) AS keys FROM req GROUP BY shard")
def route_by_key(spark, sf_dir):
    rows = read_events(spark, sf_dir)
    return rows.groupBy(pipeline.shard_of(F.col("idem_key"), SHARDS).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("idem_key").alias("keys"))


@query(f"WITH {REQUESTS} SELECT {shard_sql('identity')} AS shard, count(*) AS n, count(DISTINCT identity) AS actors FROM req GROUP BY shard")
def route_by_identity(spark, sf_dir):
    rows = read_events(spark, sf_dir)
    return rows.groupBy(pipeline.shard_of(F.col("identity"), SHARDS).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("identity").alias("actors"))


@query(f"WITH {REQUESTS} SELECT CAST(seq % {SHARDS} AS INTEGER) AS shard, count(*) AS n FROM req GROUP BY shard")
def route_keyless_round_robin(spark, sf_dir):
    """Arrival numbers count up, so that their remainders deal requests in turn, without an order over all rows."""
    return read_events(spark, sf_dir).groupBy((F.col("seq") % SHARDS).cast("int").alias("shard")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {REQUESTS} SELECT seq, backend_status AS status, 'passthrough' AS outcome FROM req WHERE seq % 10 = 0")
def passthrough_keyless(spark, sf_dir):
    rows = read_events(spark, sf_dir).withColumn("idem_key", F.when(F.col("seq") % 10 != 0, F.col("idem_key")))
    return pipeline.handled(rows, (), SECRET, LEASES).where("outcome = 'passthrough'").select("seq", "status", "outcome")


@query("""WITH t AS (SELECT page_id, url, CASE WHEN page_id % 9 = 0 THEN '/metrics?x=' || page_id ELSE substr(url, instr(url, '://') + 3) END AS target FROM pages)
SELECT page_id, string_split(target, '?')[1] AS path, string_split(target, '?')[1] IN ('/healthz', '/metrics') AS operational FROM t""")
def operational_bypass(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    target = F.when(F.col("page_id") % 9 == 0, F.concat(F.lit("/metrics?x="), F.col("page_id").cast("string"))).otherwise(F.substr("url", F.instr("url", "://") + 3))
    own, rest = pipeline.operational(pages.select("page_id", target.alias("target")))
    return own.withColumn("operational", F.lit(True)).unionByName(rest.withColumn("operational", F.lit(False))).select("page_id", req.path_of(F.col("target")).alias("path"), "operational")


# -- text form


def _raw(spark, sf_dir):
    rows = read_events(spark, sf_dir)
    size = F.when(F.col("seq") % 11 == 0, F.octet_length("body") + 5).otherwise(F.octet_length("body")).cast("string")
    text = F.concat(
        "method", F.lit(" "), F.when(F.col("seq") % 13 == 0, "").otherwise(F.col("target")), F.lit(" HTTP/1.1\r\nx-forwarded-for: "), "identity", F.lit(" \r\nIdempotency-Key:"), "idem_key",
        F.when(F.col("seq") % 17 == 0, F.lit("\r\nno colon")).otherwise(""), F.lit("\r\nCONTENT-LENGTH: "), size, F.lit("\r\nContent-Length: 1\r\n\r\n"), "body", F.lit("rest")
    )
    return rows.select("seq", text.alias("raw"))


@query(f"""WITH {REQUESTS}, e AS (SELECT *, CASE WHEN seq % 13 = 0 THEN 'malformed request line' WHEN seq % 17 = 0 THEN 'malformed header line' WHEN seq % 11 = 0 THEN 'body too short' END AS error FROM req)
SELECT seq, error, CASE WHEN error IS NULL THEN method END AS method, CASE WHEN error IS NULL THEN target END AS target, CASE WHEN error IS NULL THEN identity END AS identity,
  CASE WHEN error IS NULL THEN idem_key END AS idem_key, CASE WHEN error IS NULL THEN body END AS body FROM e""")
def http_parse_request(spark, sf_dir):
    rows = req.parsed(_raw(spark, sf_dir))
    h = F.col("request.headers")
    return rows.select(
        "seq", "error", F.col("request.method").alias("method"), F.col("request.target").alias("target"), req.header(h, req.IDENTITY_HEADER).alias("identity"), req.header(h, req.KEY_HEADER).alias("idem_key"), F.col("request.body").cast("string").alias("body")
    )


@query(f"""WITH {REQUESTS} SELECT seq, CASE WHEN seq % 13 = 0 THEN 'bad status line' WHEN seq % 17 = 0 THEN 'malformed header line' END AS error,
  CASE WHEN seq % 13 <> 0 AND seq % 17 <> 0 THEN CAST(backend_status AS INTEGER) END AS status, CASE WHEN seq % 13 <> 0 AND seq % 17 <> 0 THEN CASE WHEN seq % 2 = 0 THEN body ELSE body || 'rest' END END AS body FROM req""")
def http_parse_response(spark, sf_dir):
    """Every other response states its length; the others run to their end."""
    rows = read_events(spark, sf_dir)
    text = F.concat(
        F.lit("HTTP/1.1 "), F.when(F.col("seq") % 13 == 0, "x").otherwise(F.col("backend_status").cast("string")), F.lit(" Some Reason\r\nA: b"), F.when(F.col("seq") % 17 == 0, F.lit("\r\nno colon")).otherwise(""),
        F.when(F.col("seq") % 2 == 0, F.concat(F.lit("\r\ncontent-length: "), F.octet_length("body").cast("string"))).otherwise(""), F.lit("\r\n\r\n"), "body", F.lit("rest"),
    )
    got = req.parsed_response(rows.select("seq", text.alias("raw")))
    return got.select("seq", "error", F.col("response.status").alias("status"), F.col("response.body").cast("string").alias("body"))


@query("SELECT CAST(s AS INTEGER) AS status, coalesce(MAP {200: 'OK', 201: 'Created', 400: 'Bad Request', 409: 'Conflict', 422: 'Unprocessable Entity', 429: 'Too Many Requests', 500: 'Internal Server Error', 502: 'Bad Gateway'}[s], 'Status') AS reason FROM (SELECT unnest(range(100, 600)) AS s)")
def status_reasons(spark, sf_dir):
    rows = spark.range(100, 600).select(F.col("id").cast("int").alias("status"))
    return rows.select("status", req.reason(F.col("status")).alias("reason"))


@query(f"""WITH {REQUESTS} SELECT seq, 'HTTP/1.1 ' || backend_status || CASE WHEN backend_status = 201 THEN ' Created' ELSE ' Status' END || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(body)) || chr(13) || chr(10)
|| 'X-A: ' || identity || chr(13) || chr(10) || chr(13) || chr(10) || body AS text FROM req""")
def http_render_response(spark, sf_dir):
    headers = F.array(F.struct(F.lit("content-length").alias("name"), F.lit("9").alias("value")), F.struct(F.lit("X-A").alias("name"), F.col("identity").alias("value")))
    return read_events(spark, sf_dir).select("seq", req.rendered_response(F.col("backend_status"), headers, F.col("body")).alias("text"))


@query(f"""WITH {REQUESTS} SELECT seq, 'POST ' || target || ' HTTP/1.1' || chr(13) || chr(10) || 'X-A: ' || identity || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(body)) || chr(13) || chr(10)
|| 'Connection: close' || chr(13) || chr(10) || chr(13) || chr(10) || body AS text FROM req""")
def http_render_request(spark, sf_dir):
    headers = F.array(F.struct(F.lit("Connection").alias("name"), F.lit("keep-alive").alias("value")), F.struct(F.lit("X-A").alias("name"), F.col("identity").alias("value")))
    return read_events(spark, sf_dir).select("seq", req.rendered_request(F.col("method"), F.col("target"), headers, F.col("body")).alias("text"))


@query("""WITH d AS (SELECT doc_id, octet_length(encode(text)) AS n FROM documents) SELECT doc_id, CASE WHEN coalesce(n, 0) <= 4096 THEN 200 ELSE 413 END AS status FROM d""")
def body_cap_rejects(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text").alias("body"))
    fits, rest = req.within_cap(docs, 4096)
    return fits.withColumn("status", F.lit(200)).unionByName(rest).select("doc_id", "status")


@query(f"WITH {REQUESTS} SELECT seq, 'A=3,a=2,b=' || identity AS headers FROM req")
def outcome_header_map(spark, sf_dir):
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    headers = F.array(pair("b", F.lit("x")), pair("a", F.lit("1")), pair("A", F.lit("3")), pair("a", F.lit("2")), pair("b", F.col("identity")))
    entries = F.array_sort(F.map_entries(req.outcome_headers(headers)))
    return read_events(spark, sf_dir).select("seq", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("headers"))
