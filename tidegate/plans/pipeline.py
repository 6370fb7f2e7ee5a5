"""The whole path of a request: operational endpoints, abuse rules, idempotency, backend, response."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegate.functions.crypto import fingerprint
from tidegate.operators import idempotency, ratelimit
from tidegate.schema import Leases, Rule

OPERATIONAL = ("/healthz", "/metrics")


def shard_of(key: Column, shards: int) -> Column:
    """A key's shard from the first hex digits of its MD5, which other engines compute as well."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long") % shards).cast("int")


def is_operational(target: Column) -> Column:
    """Whether a request is for an endpoint that is answered before all else; a null target is not."""
    return F.coalesce(F.substring_index(target, "?", 1).isin(*OPERATIONAL), F.lit(False))


def operational(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests for operational endpoints, all others)."""
    own = is_operational(F.col("target"))
    return requests.where(own), requests.where(~own)


STATUS = {"operational": 200, "mismatch": 422, "in_progress": 409, "denied": 429}


def handled(requests: DataFrame, rules: Sequence[Rule], secret: bytes, leases: Leases) -> DataFrame:
    """``requests`` with outcome, status, rule, action and outcome_seq.

    Operational endpoints are answered first, and neither limits nor counters see them. Rules see all other requests, so
    that retries and replays use up limits too; only what they allow reaches the backend and the state of its key.
    Requests without a key are passed through. Rows are dealt by cell of their identity and by key, once each.
    """
    own, rest = operational(requests)
    fp = F.hex(fingerprint(F.col("method"), F.col("target"), F.col("body"), secret))
    judged = ratelimit.judged(rest, "identity", rules)
    key = F.when(F.col("verdict") == "allow", F.col("idem_key"))
    steps = idempotency.stepped(judged, key, F.lit("request"), F.when(key.isNotNull(), fp), F.lit(None), F.col("backend_status"), leases)
    return answered(steps, requests.columns).unionByName(answered(_unstepped(own), requests.columns, F.lit(True)))


def _unstepped(own: DataFrame) -> DataFrame:
    """Requests that neither rules nor keys have seen, in the columns of those that they have."""
    none = F.lit(None)
    return own.select("*", *[none.cast(t).alias(c) for c, t in {"verdict": "string", "rule": "string", "action": "string", "decision": "string", "outcome_seq": "long", "outcome_status": "int"}.items()])


def answered(steps: DataFrame, columns: Sequence[str], operational: Column | None = None) -> DataFrame:
    """``columns`` of ``steps``, with outcome, status, rule, action and outcome_seq from its verdicts and decisions."""
    own = F.lit(False) if operational is None else operational
    outcome = (
        F.when(own, "operational").when(F.col("verdict") == "deny", "denied").when(F.col("idem_key").isNotNull(), F.col("decision"))
        .when(F.col("backend_status").isNull(), "upstream_error").otherwise("passthrough")
    )
    fixed = F.create_map(*[x for k, v in STATUS.items() for x in (F.lit(k), F.lit(v))])
    status = F.coalesce(F.try_element_at(fixed, outcome), F.when(outcome == "replayed", F.col("outcome_status")), F.col("backend_status"), F.lit(502))
    return steps.select(
        *columns, outcome.alias("outcome"), status.cast("int").alias("status"), "rule", "action", F.when(outcome.isin("created", "replayed"), F.col("outcome_seq")).alias("outcome_seq")
    )


#: What the status header of a response says, by outcome; others have none.
TAGS = {"created": "created", "replayed": "replayed", "in_progress": "in-progress", "mismatch": "mismatch", "denied": "denied"}


def responses(handled: DataFrame, backend_body: str, metrics_text: str, prefix: str = "Gate") -> DataFrame:
    """(seq, status, headers, body) of ``handled(seq, ..., backend_status, backend_body)``: the responses as they are sent.

    A replayed response has the body that its first effect stored. Errors of the backend go through untouched, a backend
    that cannot be reached gives 502. Health checks say "ok", metrics are ``metrics_text``.
    """
    stored = handled.where("outcome = 'created'").select(F.col("seq").alias("__made"), F.col(backend_body).alias("__stored"))
    # rows that replay nothing have a number of their own, so that they are not dealt to one task
    made = F.when(F.col("outcome") == "replayed", F.col("outcome_seq")).otherwise(-1 - F.col("seq"))
    rows = handled.withColumn("__made", made).join(stored, "__made", "left")
    path = F.substring_index("target", "?", 1)
    lost = (F.col("outcome") == "upstream_error") & F.col("backend_status").isNull()
    tags = F.create_map(*[F.lit(x) for kv in TAGS.items() for x in kv])
    tag = F.when(path.eqNullSafe("/healthz") & (F.col("outcome") == "operational"), "healthy").when(lost, "upstream-error").otherwise(F.try_element_at(tags, F.col("outcome")))
    pair = lambda name, value: F.when(value.isNotNull(), F.struct(F.lit(name).alias("name"), value.alias("value")))
    metrics = F.when(path.eqNullSafe("/metrics") & (F.col("outcome") == "operational"), "text/plain; version=0.0.4")
    headers = F.array_compact(F.array(pair("Content-Type", metrics), pair(f"{prefix}-Status", tag), pair(f"{prefix}-Rule", F.col("rule")), pair(f"{prefix}-Action", F.col("action"))))
    body = (
        F.when(F.col("outcome") == "operational", F.when(path == "/healthz", "ok").otherwise(metrics_text))
        .when(F.col("outcome") == "replayed", F.col("__stored")).when(F.col("outcome").isin("in_progress", "mismatch", "denied") | lost, "").otherwise(F.col(backend_body))
    )
    return rows.select("seq", "status", headers.alias("headers"), F.coalesce(body, F.lit("")).alias("body"))
