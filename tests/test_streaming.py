"""Streams give what the same rows give in batch."""

import pytest
from model import operations
from pyspark.sql import functions as F

from tidegate.operators import idempotency, ratelimit, velocity
from tidegate.plans import pipeline
from tidegate.schema import Leases, Rule
from tidegate.session import SETTINGS
from tidegate.sources.requests import read_events
from tidegate.streaming import processors

OPS = "seq long, key string, op string, fp string, now_ms long, fence long, status int"


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, SETTINGS[name])
    yield
    spark.conf.unset(name)


def streamed(spark, rows, schema, run, tmp_path, chunks=3):
    """``rows`` through ``run`` in ``chunks`` micro-batches."""
    n = -(-len(rows) // chunks)
    for i in range(chunks):
        spark.createDataFrame(rows[i * n : (i + 1) * n], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sink = run(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert sink.awaitTermination(240)
    return spark.read.parquet(f"{tmp_path}/out")


def test_idempotency_stream(spark, tmp_path):
    rows = operations(11, 300)
    leases = Leases(1000, 5000)
    got = streamed(spark, rows, OPS, lambda s: processors.decided(s, leases), tmp_path)
    want = idempotency.decided(spark.createDataFrame(rows, OPS), leases)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_limiter_stream(spark, sf, tmp_path):
    rows = [tuple(r) for r in read_events(spark, sf).select(F.col("identity").alias("key"), "seq", "now_ms").orderBy("seq").limit(300).collect()]
    schema = "key string, seq long, now_ms long"
    got = streamed(spark, rows, schema, lambda s: processors.limited(s, 86_400_000, 4), tmp_path)
    want = ratelimit.limited(spark.createDataFrame(rows, schema), "key", 86_400_000, 4)
    pick = lambda df: {r.seq: (r.current, r.previous, r.estimate, r.allowed) for r in df.collect()}
    assert pick(got) == pick(want)


RULES = (Rule("hour", 3_600_000, 2, "challenge"), Rule("day", 86_400_000, 4, "block"))
REQUEST = "seq long, now_ms long, identity string, idem_key string, method string, target string, body string, backend_status int"


def requests(spark, sf, n=240):
    rows = read_events(spark, sf).orderBy("seq").limit(n)
    seq = F.col("seq")
    target = F.when(seq % 23 == 0, "/healthz").when(seq % 31 != 0, F.col("target"))
    rows = rows.withColumns({"idem_key": F.when(seq % 10 != 0, F.col("idem_key")), "body": F.when(seq % 13 != 0, "{}"), "target": target, "backend_status": F.when(seq % 17 != 0, F.col("backend_status"))})
    return [tuple(r) for r in rows.select(*[f.split()[0] for f in REQUEST.split(", ")]).collect()]


@pytest.mark.parametrize("delay", [None, "1 hour"])
def test_whole_path_stream(spark, sf, tmp_path, delay):
    rows, leases = requests(spark, sf), Leases(2 * 86_400_000, 5 * 86_400_000)
    got = streamed(spark, rows, REQUEST, lambda s: processors.handled(s, RULES, b"k" * 32, leases, delay), tmp_path)
    want = pipeline.handled(spark.createDataFrame(rows, REQUEST), RULES, b"k" * 32, leases)
    assert len({r.outcome for r in want.collect()}) >= 5
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_rule_set_stream(spark, sf, tmp_path):
    rows = [(r[2], r[0], r[1]) for r in requests(spark, sf)]
    schema = "key string, seq long, now_ms long"
    got = streamed(spark, rows, schema, lambda s: processors.judged(s, RULES), tmp_path)
    want = ratelimit.judged(spark.createDataFrame(rows, schema), "key", RULES).drop("now_ms")
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_restart_from_a_checkpoint(spark, tmp_path):
    """A query that is stopped and started anew goes on from its state."""
    rows, leases = operations(12, 200), Leases(1000, 5000)
    for part in (rows[:90], rows[90:]):
        got = streamed(spark, part, OPS, lambda s: processors.decided(s, leases), tmp_path, chunks=1)
    want = idempotency.decided(spark.createDataFrame(rows, OPS), leases)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_state_is_dropped_when_its_time_is_over(spark, tmp_path):
    """After the time to live a key is unknown, its fence still rises, and what is in progress stays."""
    leases = Leases(1000, 5000)
    one = [(0, "k", "begin", "a", 1000, None, None), (1, "k", "complete", None, 1000, 1, 201), (2, "p", "begin", "a", 1000, None, None)]
    far = [[(10 + i, "other", "begin", "a", t, None, None)] for i, t in enumerate((7000, 7500, 8000))]
    two = [(20, "k", "complete", None, 8500, 1, 201), (21, "k", "begin", "z", 8501, None, None), (22, "k", "complete", None, 8502, 1, 201), (23, "p", "begin", "a", 8502, None, None)]
    for part in (one, *far, two):
        got = streamed(spark, part, OPS, lambda s: processors.decided(s, leases, "0 seconds"), tmp_path, chunks=1)
    found = {r.seq: r for r in got.collect()}
    assert [found[i].decision for i in (20, 21, 22, 23)] == ["unknown", "run", "stale_fence", "run"] and (found[21].fence, found[23].fence) == (2, 2)


def test_limiter_drops_old_windows(spark, tmp_path):
    schema = "key string, seq long, now_ms long"
    parts = [[("k", 0, 100), ("k", 1, 200)], [("other", 2, 5000)], [("other", 3, 6000)], [("k", 4, 6500)]]
    for part in parts:
        got = streamed(spark, part, schema, lambda s: processors.limited(s, 1000, 5, "0 seconds"), tmp_path, chunks=1)
    assert {r.seq: (r.current, r.previous) for r in got.collect()}[4] == (1, 0)


def test_velocity_estimate_stream(spark, tmp_path):
    schema = "key string, seq long, now_ms long, target string"
    rows = [("a", i, 0, f"t{i}") for i in range(200)] + [("b", 200 + i, 0, "same") for i in range(100)] + [("a", 300, 5000, "x")]
    got = {r.seq: r for r in streamed(spark, rows, schema, lambda s: processors.velocity_estimate(s, 1000, 20), tmp_path, chunks=2).collect()}
    assert got[10].allowed and not got[199].allowed and abs(got[199].estimate - 200) < 10
    assert all(got[i].allowed and got[i].estimate < 2 for i in range(200, 301))


def test_velocity_stream(spark, sf, tmp_path):
    rows = [tuple(r) for r in read_events(spark, sf).select(F.col("identity").alias("key"), "seq", "now_ms", F.col("body").alias("target")).orderBy("seq").limit(300).collect()]
    schema = "key string, seq long, now_ms long, target string"
    got = streamed(spark, rows, schema, lambda s: processors.velocity(s, 86_400_000, 2), tmp_path)
    want = velocity.distinct_so_far(spark.createDataFrame(rows, schema), "key", "target", 86_400_000, 2)
    pick = lambda df: {r.seq: (r.distinct_targets, r.allowed) for r in df.collect()}
    assert pick(got) == pick(want)


def test_sink_writes_replicas_once(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
    query = processors.changelog_sink(source, f"{tmp_path}/log", f"{tmp_path}/state", replicas=2).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    rows = spark.read.parquet(f"{tmp_path}/log")
    assert rows.groupBy("replica").count().orderBy("replica").collect() == [(0, 10), (1, 10)]
