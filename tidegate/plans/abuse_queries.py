"""Queries on limits, rules, velocity, sketches and proof of work."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegate.functions import crypto, pow
from tidegate.operators import ratelimit, sketches, velocity
from tidegate.plans.common import DAY, LIMIT, REQUESTS, RULES, SECRET, fingerprint_sql, hex_number, hmac_sql, sliding
from tidegate.plans.registry import query
from tidegate.sources.requests import read_events


def lineitem(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


@query(f"WITH {REQUESTS}, c AS ({sliding('req', DAY)}) SELECT seq, identity, current, previous, estimate, estimate <= {LIMIT} AS allowed FROM c")
def rate_limit_decisions(spark, sf_dir):
    return ratelimit.limited(read_events(spark, sf_dir), "identity", DAY, LIMIT).select("seq", "identity", "current", "previous", "estimate", "allowed")


@query(f"""WITH {REQUESTS}, c AS ({sliding('req', DAY)})
SELECT identity, count(*) AS hits, count(*) FILTER (estimate <= {LIMIT}) AS n_allowed, max(estimate) AS peak FROM c GROUP BY identity""")
def rate_limit_summary(spark, sf_dir):
    rows = ratelimit.limited(read_events(spark, sf_dir), "identity", DAY, LIMIT)
    return rows.groupBy("identity").agg(F.count(F.lit(1)).alias("hits"), F.count_if("allowed").alias("n_allowed"), F.max("estimate").alias("peak"))


def _rules_sql() -> str:
    parts, source = [], "req"
    for i, r in enumerate(RULES):
        parts.append(f"c{i} AS ({sliding(source, r.window_ms, f'r{i}_')})")
        source = f"c{i}"
    case = lambda what: "CASE " + " ".join(f"WHEN r{i}_estimate > {r.limit} THEN '{getattr(r, what)}'" for i, r in enumerate(RULES)) + " END"
    return f"WITH {REQUESTS}, {', '.join(parts)}, v AS (SELECT *, {case('name')} AS rule, {case('action')} AS action FROM {source})"


@query(f"{_rules_sql()} SELECT seq, identity, CASE WHEN rule IS NULL THEN 'allow' ELSE 'deny' END AS verdict, rule, action FROM v")
def rule_set_verdicts(spark, sf_dir):
    return ratelimit.judged(read_events(spark, sf_dir), "identity", RULES).select("seq", "identity", "verdict", "rule", "action")


@query(f"{_rules_sql()} SELECT rule, action, count(*) AS denied, count(DISTINCT identity) AS actors FROM v WHERE rule IS NOT NULL GROUP BY rule, action")
def abuse_denied_by_action(spark, sf_dir):
    rows = ratelimit.judged(read_events(spark, sf_dir), "identity", RULES).where("verdict = 'deny'")
    return rows.groupBy("rule", "action").agg(F.count(F.lit(1)).alias("denied"), F.countDistinct("identity").alias("actors"))


@query(f"""WITH {REQUESTS}, f AS (
  SELECT *, now_ms // {DAY} AS w, CASE WHEN row_number() OVER (PARTITION BY identity, now_ms // {DAY}, body ORDER BY seq) = 1 THEN 1 ELSE 0 END AS fresh FROM req
), d AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY identity, w ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS distinct_targets FROM f)
SELECT seq, identity, distinct_targets, distinct_targets <= {LIMIT} AS allowed FROM d""")
def velocity_distinct_exact(spark, sf_dir):
    return velocity.distinct_so_far(read_events(spark, sf_dir), "identity", "body", DAY, LIMIT).select("seq", "identity", "distinct_targets", "allowed")


@query("SELECT l_suppkey, l_shipdate_month, count(DISTINCT l_partkey) AS parts FROM (SELECT *, year(l_shipdate) * 12 + month(l_shipdate) AS l_shipdate_month FROM lineitem) GROUP BY ALL")
def velocity_distinct_by_window(spark, sf_dir):
    rows = lineitem(spark, sf_dir).withColumn("l_shipdate_month", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long"))
    return rows.groupBy("l_suppkey", "l_shipdate_month").agg(F.countDistinct("l_partkey").alias("parts"))


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, true AS within FROM lineitem GROUP BY l_suppkey")
def velocity_hll_bounds(spark, sf_dir):
    rows = lineitem(spark, sf_dir).select("l_suppkey", "l_partkey")
    near = sketches.hll_estimate(sketches.hll_registers(rows, "l_partkey", ["l_suppkey"]), ["l_suppkey"])
    exact = rows.groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"))
    return exact.join(near, "l_suppkey").select("l_suppkey", "parts", (F.abs(F.col("estimate") - F.col("parts")) <= F.greatest(F.lit(5.0), 0.1 * F.col("parts"))).alias("within"))


@query(f"WITH {REQUESTS} SELECT CAST(now_ms // {DAY} AS BIGINT) AS day, count(DISTINCT identity) AS actors, count(DISTINCT idem_key) AS keys FROM req GROUP BY day")
def tracked_keys(spark, sf_dir):
    rows = read_events(spark, sf_dir).withColumn("day", ratelimit.window_of("now_ms", DAY))
    return rows.groupBy("day").agg(F.countDistinct("identity").alias("actors"), F.countDistinct("idem_key").alias("keys"))


@query(f"""WITH {REQUESTS}, k AS (SELECT identity FROM req GROUP BY identity ORDER BY min(seq), identity LIMIT 12)
SELECT seq, identity FROM req WHERE identity IN (SELECT identity FROM k)""")
def tracked_keys_bounded(spark, sf_dir):
    return ratelimit.bounded(read_events(spark, sf_dir), "identity", 12).select("seq", "identity")


# -- digests and proof of work


@query(f"WITH {REQUESTS} SELECT seq, {fingerprint_sql('method', 'target', 'body')} AS fingerprint, sha256(body) AS body_sha256 FROM req")
def request_fingerprints(spark, sf_dir):
    rows = read_events(spark, sf_dir)
    own = crypto.fingerprint(F.col("method"), F.col("target"), F.col("body"), SECRET)
    return rows.select("seq", F.lower(F.hex(own)).alias("fingerprint"), F.sha2("body", 256).alias("body_sha256"))


@query(f"WITH {REQUESTS} SELECT seq, {hmac_sql('encode(idem_key)')} AS tag FROM req")
def hmac_tags(spark, sf_dir):
    return read_events(spark, sf_dir).select("seq", F.lower(F.hex(crypto.hmac_sha256(SECRET, F.col("idem_key")))).alias("tag"))


def _le64_sql(n: str) -> str:
    h = f"printf('%016x', {n})"
    return "unhex(" + " || ".join(f"substr({h}, {i}, 2)" for i in range(15, 0, -2)) + ")"


def _challenge_sql(window: str) -> str:
    return hmac_sql(f"encode(identity) || {_le64_sql(window)} || unhex(sha256(body))")


def _zeros_sql(h: str) -> str:
    zeros = f"length(regexp_extract({h}, '^0*'))"
    nibble = f"substr({h}, {zeros} + 1, 1)"
    return f"CAST({zeros} * 4 + CASE WHEN {nibble} = '' THEN 0 WHEN {nibble} = '1' THEN 3 WHEN {nibble} IN ('2', '3') THEN 2 WHEN {nibble} IN ('4', '5', '6', '7') THEN 1 ELSE 0 END AS INTEGER)"


@query(f"WITH {REQUESTS} SELECT seq, {_challenge_sql(f'now_ms // {DAY}')} AS challenge FROM req")
def pow_challenges(spark, sf_dir):
    rows = read_events(spark, sf_dir)
    own = pow.challenge(SECRET, F.col("identity"), crypto.sha256(F.col("body")), pow.window_index(F.col("now_ms"), DAY))
    return rows.select("seq", F.lower(F.hex(own)).alias("challenge"))


@query(f"""WITH {REQUESTS}, c AS (SELECT *, seq % 64 AS nonce, {_challenge_sql(f'now_ms // {DAY}')} AS a, {_challenge_sql(f'greatest(now_ms // {DAY} - 1, 0)')} AS b FROM req),
d AS (SELECT *, sha256(unhex(a) || {_le64_sql('nonce')}) AS da, sha256(unhex(b) || {_le64_sql('nonce')}) AS db FROM c)
SELECT seq, {_zeros_sql('da')} >= 3 OR {_zeros_sql('db')} >= 3 AS accepted FROM d""")
def pow_verify(spark, sf_dir):
    rows = read_events(spark, sf_dir)
    good = pow.verify(SECRET, F.col("identity"), crypto.sha256(F.col("body")), F.lit(3), F.col("seq") % 64, DAY, F.col("now_ms"))
    return rows.select("seq", good.alias("accepted"))


@query(f"""WITH k AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS identity FROM events), n AS (SELECT unnest(range(0, 256)) AS nonce),
d AS (SELECT identity, nonce, sha256(unhex({hmac_sql('encode(identity)')}) || {_le64_sql('nonce')}) AS d FROM k, n)
SELECT identity, min(nonce) AS nonce FROM d WHERE {_zeros_sql('d')} >= 5 GROUP BY identity""")
def pow_nonce_search(spark, sf_dir):
    tasks = read_events(spark, sf_dir).select("identity").distinct().withColumn("value", crypto.hmac_sha256(SECRET, F.col("identity")))
    return pow.smallest_nonce(tasks, ["identity"], "value", F.lit(5), 256)


@query(f"""WITH {REQUESTS}, c AS ({sliding('req', DAY)})
SELECT seq, CAST(least(255, 8 + CASE WHEN estimate > {LIMIT} THEN least(20, CAST(floor(4 * ((estimate - {LIMIT}) / {LIMIT}.0)) AS BIGINT)) ELSE 0 END) AS INTEGER) AS difficulty FROM c""")
def difficulty_levels(spark, sf_dir):
    rows = ratelimit.limited(read_events(spark, sf_dir), "identity", DAY, LIMIT)
    return rows.select("seq", pow.difficulty_for(F.lit(8), (F.col("estimate") - LIMIT) / LIMIT).alias("difficulty"))


@query(f"WITH {REQUESTS}, d AS (SELECT {_zeros_sql('sha256(idem_key || body)')} AS bits FROM req) SELECT bits, count(*) AS n FROM d GROUP BY bits")
def leading_zero_bits(spark, sf_dir):
    own = crypto.leading_zero_bits(crypto.sha256(F.concat("idem_key", "body")))
    return read_events(spark, sf_dir).groupBy(own.alias("bits")).agg(F.count(F.lit(1)).alias("n"))


# -- sketches

_CMS = f"""k AS (SELECT CAST(user_id AS VARCHAR) AS key, count(*) AS c FROM events GROUP BY user_id), r AS (SELECT unnest(range(0, {sketches.DEPTH})) AS row),
p AS (SELECT key, c, row, {hex_number(1, 8, "row || ':' || key")} % {sketches.WIDTH} AS col FROM k, r),
cells AS (SELECT row, col, CAST(sum(c) AS BIGINT) AS cell FROM p GROUP BY row, col),
e AS (SELECT key, min(cell) AS estimate FROM p JOIN cells USING (row, col) GROUP BY key)"""


def _user_cells(spark, sf_dir):
    rows = read_events(spark, sf_dir)
    return rows, sketches.cms_build(rows, "identity")


@query(f"WITH {_CMS} SELECT CAST(row AS INTEGER) AS row, col, cell FROM cells")
def cms_cells(spark, sf_dir):
    return _user_cells(spark, sf_dir)[1]


@query(f"WITH {_CMS} SELECT key, estimate FROM e")
def cms_estimates(spark, sf_dir):
    rows, cells = _user_cells(spark, sf_dir)
    return sketches.cms_estimate(cells, rows, "identity")


@query(f"WITH {_CMS} SELECT key, estimate FROM e ORDER BY estimate DESC, key LIMIT 10")
def cms_heavy_hitters(spark, sf_dir):
    rows, cells = _user_cells(spark, sf_dir)
    return sketches.heavy_hitters(sketches.cms_estimate(cells, rows, "identity"), 10)


@query("SELECT count(DISTINCT l_partkey) AS keys, CAST(0 AS BIGINT) AS under, true AS within FROM lineitem")
def cms_error_bound(spark, sf_dir):
    """At most 3 * delta of the keys may be over the error that the sketch is built for; none may be under its count."""
    epsilon = delta = 0.01
    depth, width = sketches.cms_size(epsilon, delta)
    rows = lineitem(spark, sf_dir).select(F.col("l_partkey").cast("string").alias("key"))
    true = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    both = true.join(sketches.cms_estimate(sketches.cms_build(rows, "key", depth=depth, width=width), rows, "key", depth, width), "key")
    total = rows.count()
    over = F.count_if(F.col("estimate") > F.col("c") + epsilon * total)
    return both.agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("estimate") < F.col("c")).alias("under"), (over <= 3 * delta * F.count(F.lit(1))).alias("within"))


_HLL = f"""h AS (SELECT md5(CAST(l_partkey AS VARCHAR)) AS h FROM lineitem),
z AS (SELECT {hex_number(1, 3, '').replace("md5()", "h")} AS idx, {_zeros_sql('substr(h, 4, 13)')} + 1 AS rank FROM h),
r AS (SELECT idx, CAST(max(rank) AS INTEGER) AS rank FROM z GROUP BY idx)"""


@query(f"WITH {_HLL} SELECT idx, rank FROM r")
def hll_registers(spark, sf_dir):
    return sketches.hll_registers(lineitem(spark, sf_dir).select("l_partkey"), "l_partkey", [])


@query(f"""WITH {_HLL}, s AS (SELECT sum(pow(2.0, -rank)) AS s, count(*) AS n FROM r), w AS (SELECT *, CAST({0.7213 / (1 + 1.079 / 4096) * 4096 * 4096!r} AS DOUBLE) / (s + (4096 - n)) AS raw FROM s)
SELECT round(CASE WHEN raw <= 2.5 * 4096 AND n < 4096 THEN 4096 * ln(4096.0 / (4096 - n)) ELSE raw END, 4) AS estimate, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS exact FROM w""")
def hll_estimate(spark, sf_dir):
    rows = lineitem(spark, sf_dir).select("l_partkey")
    exact = rows.agg(F.countDistinct("l_partkey")).first()[0]
    near = sketches.hll_estimate(sketches.hll_registers(rows, "l_partkey", []), [])
    return near.select(F.round("estimate", 4).alias("estimate"), F.lit(exact).cast("long").alias("exact"))
