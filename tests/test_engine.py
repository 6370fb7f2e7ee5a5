"""Decisions, limits and logs on small inputs with known answers, and against the sequential model."""

import hashlib
import hmac
import struct
import zlib

import pytest
from model import Model, operations
from pyspark.sql import functions as F

from tidegate.functions import crypto, pow
from tidegate.operators import changelog, idempotency, metrics, ratelimit, sketches, velocity
from tidegate.plans import pipeline
from tidegate.schema import Leases, Rule
from tidegate.sources import requests as req

OPS = "seq long, key string, op string, fp string, now_ms long, fence long, status int"


def decide(spark, rows, leases):
    return idempotency.decided(spark.createDataFrame(rows, OPS).repartition(3), leases)


def begin(seq, now, fp="a", key="k"):
    return (seq, key, "begin", fp, now, None, None)


def complete(seq, now, fence, key="k"):
    return (seq, key, "complete", None, now, fence, 201)


CASES = {
    "run then replay": ([begin(0, 1000), complete(1, 1000, 1), begin(2, 1005)], ["run", "ok", "replay"]),
    "concurrent": ([begin(0, 1000), begin(1, 1005)], ["run", "in_progress"]),
    "mismatch": ([begin(0, 1000), begin(1, 1001, "z"), complete(2, 1001, 1), begin(3, 1002, "z")], ["run", "mismatch", "ok", "mismatch"]),
    "takeover": ([begin(0, 1000), begin(1, 31000), complete(2, 31000, 1), complete(3, 31000, 2), begin(4, 31001)], ["run", "run", "stale_fence", "ok", "replay"]),
    "immutable": ([begin(0, 1000), complete(1, 1000, 1), complete(2, 1000, 1)], ["run", "ok", "already_completed"]),
    "late but not taken over": ([begin(0, 1000), complete(1, 99000, 1)], ["run", "ok"]),
    "unknown": ([complete(0, 1000, 1)], ["unknown"]),
    "time to live": ([begin(0, 1000), complete(1, 1000, 1), begin(2, 10999), begin(3, 11000, "z")], ["run", "ok", "replay", "run"]),
    "other fingerprint outlives its lease": ([begin(0, 1000), begin(1, 99000, "z")], ["run", "mismatch"]),
    "old token after expiry": ([begin(0, 1000), complete(1, 1000, 1), begin(2, 20000), complete(3, 20001, 1)], ["run", "ok", "run", "stale_fence"]),
}


@pytest.mark.parametrize("case", CASES)
def test_engine_cases(spark, case):
    rows, want = CASES[case]
    got = decide(spark, rows, Leases(30_000, 10_000)).orderBy("seq").collect()
    assert [r.decision for r in got] == want


@pytest.mark.parametrize("seed", range(3))
def test_engine_against_model(spark, seed):
    rows = operations(seed, 1500)
    model, want, effects = Model(1000, 5000), {}, {}
    for seq, key, op, fp, now, fence, _ in rows:
        if op == "begin":
            want[seq] = model.begin(key, fp, now)[0]
        else:
            want[seq] = model.complete(key, fence, seq, now)
            if want[seq] == "ok":
                effects.setdefault(key, []).append((seq, now))
    got = decide(spark, rows, Leases(1000, 5000)).collect()
    assert {r.seq: r.decision for r in got} == want and len(set(want.values())) >= 7
    # an effect is alone until its time is over, and replays name it
    for times in effects.values():
        assert all(b[1] >= a[1] + 5000 for a, b in zip(times, times[1:], strict=False))
    last = {s: max((q for q, _ in effects[k] if q < s), default=None) for s, k, *_ in rows if want[s] == "replay"}
    assert all(r.outcome_seq == last[r.seq] for r in got if r.decision == "replay")


def test_snapshot_prune_and_fences(spark):
    rows = [begin(0, 1000), complete(1, 1000, 1), begin(2, 1000, key="p"), begin(3, 1001, key="q"), complete(4, 1001, 1, key="q")]
    decided = decide(spark, rows, Leases(30_000, 10_000))
    states = idempotency.snapshot(decided)
    assert {r.key for r in idempotency.pruned(states, 10_999).collect()} == {"k", "p", "q"}
    assert {r.key for r in idempotency.pruned(states, 11_000).collect()} == {"p", "q"}
    got = idempotency.fences(decided.withColumn("shard", F.lit(0)), "shard").orderBy("seq").collect()
    assert [(r.seq, r.shard_fence) for r in got] == [(0, 1), (2, 2), (3, 3)]


def test_first_effects_equal_steps(spark, sf):
    rows = req.read_events(spark, sf).withColumn("fp", (F.col("seq") % 3).cast("string"))
    fast = {r.seq: (r.decision, r.outcome_seq) for r in idempotency.first_effects(rows).collect()}
    slow = idempotency.decided(idempotency.as_operations(rows.withColumn("backend_status", F.lit(201))), Leases(1, 10**15)).collect()
    assert fast == {r.seq: (r.decision, r.outcome_seq) for r in slow}


def hits(spark, times, key="k"):
    return spark.createDataFrame([(i, key, t) for i, t in enumerate(times)], "seq long, key string, now_ms long")


@pytest.mark.parametrize(
    "limit, times, want",
    [
        (5, [0] * 6, [True] * 5 + [False]),
        (5, [999] * 5 + [1000], [True] * 5 + [False]),
        (5, [0] * 5 + [2000], [True] * 6),
        (10, [0] * 10 + [1500] * 10, [True] * 15 + [False] * 5),
    ],
)
def test_sliding_window(spark, limit, times, want):
    got = ratelimit.limited(hits(spark, times), "key", 1000, limit).orderBy("seq").collect()
    assert [r.allowed for r in got] == want


def test_hot_keys_in_slots(spark, monkeypatch):
    """Slots of few numbers give the same counts as one."""
    rows = spark.createDataFrame([(i, "k" if i % 3 else None, i * i * 7, f"t{i % 5}") for i in range(120)], "seq long, key string, now_ms long, target string").repartition(5)
    runs = lambda: (
        sorted(map(tuple, ratelimit.counted(rows, "key", [1000, 5000], ["a_", "b_"]).collect()), key=str),
        sorted(map(tuple, velocity.distinct_so_far(rows, "key", "target", 10_000, 2).collect()), key=str),
        sorted(map(tuple, ratelimit.steadied(rows.withColumn("now_ms", F.col("now_ms") % 1000), "key").collect()), key=str),
    )
    whole = runs()
    for module in (ratelimit, velocity):
        monkeypatch.setattr(module, "SLOT", 8)
    assert runs() == whole and len(whole[0]) == len(whole[1]) == 120
    state = {}
    for seq, key, now, _, *got in sorted(whole[0], key=lambda r: r[0]):
        for width, (current, previous, estimate) in ((1000, got[:3]), (5000, got[3:])):
            w, a, b = state.get((key, width), (now // width, 0, 0))
            a, b = (a, b) if now // width == w else (0, a if now // width == w + 1 else 0)
            state[key, width] = (now // width, a + 1, b)
            assert (current, previous, estimate) == (a + 1, b, a + 1 + b * ((width - now % width) / width))


def test_time_that_goes_back(spark):
    with pytest.raises(Exception, match="time goes back"):
        ratelimit.limited(hits(spark, [2500, 1500, 2600]), "key", 1000, 5).collect()
    rows = ratelimit.steadied(hits(spark, [2500, 1500, 2600]), "key")
    got = ratelimit.counted(rows, "key", [1000], window_ms="steady_ms").orderBy("seq").collect()
    assert [r.current for r in got] == [1, 2, 3] and [r.now_ms for r in got] == [2500, 1500, 2600]
    assert ratelimit.limited(hits(spark, [2500, 2400, 2600]), "key", 1000, 5).count() == 3


def test_rules(spark):
    rules = (Rule("lenient", 1000, 100, "throttle"), Rule("strict", 1000, 2, "block"), Rule("later", 1000, 1, "challenge"))
    got = ratelimit.judged(hits(spark, [0] * 3), "key", rules).orderBy("seq").collect()
    assert [(r.verdict, r.rule, r.action) for r in got] == [("allow", None, None), ("deny", "later", "challenge"), ("deny", "strict", "block")]
    assert {r.verdict for r in ratelimit.judged(hits(spark, [0]), "key", ()).collect()} == {"allow"}
    with pytest.raises(ValueError):
        Rule("x", 0, 1)
    with pytest.raises(ValueError):
        Rule("x", 1, 1, "explode")


def test_bounded_keys(spark):
    rows = spark.createDataFrame([(i, f"k{i % 9}") for i in range(90)], "seq long, key string")
    assert {r.key for r in ratelimit.bounded(rows, "key", 4).collect()} == {"k0", "k1", "k2", "k3"}


def test_velocity(spark):
    def last(targets, times):
        rows = spark.createDataFrame([(i, "a", t, n) for i, (t, n) in enumerate(zip(targets, times, strict=True))], "seq long, actor string, target string, now_ms long")
        return [r.allowed for r in velocity.distinct_so_far(rows, "actor", "target", 1000, 20).orderBy("seq").collect()]

    assert last([f"t{i}" for i in range(200)], [0] * 200) == [True] * 20 + [False] * 180
    assert all(last(["same"] * 500, [0] * 500))
    assert last([f"t{i}" for i in range(200)] + ["x"], [0] * 200 + [5000])[-1]


# -- digests


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize("data", [b"", b"abc", b"abcdbcdecdefdefgefghfghighijhijkijkljklmklmnlmnomnopnopq", b"a" * 64])
def test_sha256(spark, data):
    assert bytes(one(spark, d=crypto.sha256(F.lit(data))).d) == hashlib.sha256(data).digest()


@pytest.mark.parametrize("key, data", [(b"\x0b" * 20, b"Hi There"), (b"Jefe", b"what do ya want for nothing?"), (b"\xaa" * 131, b"Test Using Larger Than Block-Size Key - Hash Key First")])
def test_hmac(spark, key, data):
    assert bytes(one(spark, d=crypto.hmac_sha256(key, F.lit(data))).d) == hmac.new(key, data, hashlib.sha256).digest()


@pytest.mark.parametrize("data, bits", [(bytes(32), 256), (b"\x80", 0), (b"\x40", 1), (b"\x01", 7), (b"\x00\x0f", 12), (b"\xff", 0)])
def test_leading_zero_bits(spark, data, bits):
    assert one(spark, n=crypto.leading_zero_bits(F.lit(data))).n == bits


def test_encoders_and_crc(spark):
    r = one(spark, a=crypto.be32(F.lit(258)), b=crypto.le32(F.lit(258)), c=crypto.le64(F.lit(2**40 + 5)), d=crypto.le16(F.lit(513)), e=F.crc32(F.lit(b"123456789")))
    assert (bytes(r.a), bytes(r.b), bytes(r.c), bytes(r.d), r.e) == (struct.pack(">I", 258), struct.pack("<I", 258), struct.pack("<Q", 2**40 + 5), struct.pack("<H", 513), 0xCBF43926)


def test_fingerprints(spark):
    f = lambda m, t, b, k=b"k" * 32: bytes(one(spark, d=crypto.fingerprint(F.lit(m), F.lit(t), F.lit(b), k)).d)
    every = [f("POST", "/a", "b"), f("PUT", "/a", "b"), f("POST", "/ab", ""), f("POST", "/a", ""), f("POST", "/", "ab"), f("POST", "/a", "b", b"l" * 32)]
    assert len(set(every)) == len(every)
    data = b"".join(struct.pack(">I", len(x)) + x for x in (b"POST", b"/a", b"b"))
    assert every[0] == hmac.new(b"k" * 32, data, hashlib.sha256).digest()


def test_secret(monkeypatch):
    monkeypatch.setenv("TIDEGATE_KEY", "AB" * 32)
    assert crypto.secret("TIDEGATE_KEY", "x") == b"\xab" * 32
    monkeypatch.setenv("TIDEGATE_KEY", "short")
    with pytest.raises(ValueError):
        crypto.secret("TIDEGATE_KEY", "x")
    monkeypatch.delenv("TIDEGATE_KEY")
    assert crypto.secret("TIDEGATE_KEY", "x") == hashlib.sha256(b"x").digest()


def test_config():
    from tidegate.config import Config

    env = {"G_KEY": "ab" * 32, "G_LEASE_MS": "5", "G_SHARDS": "7", "G_RULES": "a:1000:3:block,b:60000:9:challenge"}
    got = Config.from_env("G_", env)
    assert got == Config(b"\xab" * 32, Leases(5, 86_400_000), (Rule("a", 1000, 3, "block"), Rule("b", 60_000, 9, "challenge")), 7)
    assert Config.from_env("G_", {}).secret == hashlib.sha256(b"not a secret").digest() and Config.from_env("G_", {}).shards == 32
    for name, bad in (("KEY", "xy"), ("SHARDS", "0"), ("TTL_MS", "soon"), ("RULES", "a:1:2"), ("RULES", "a:0:2:block"), ("RULES", "a:1:2:explode")):
        with pytest.raises(ValueError):
            Config.from_env("G_", {f"G_{name}": bad})


def test_proof_of_work(spark):
    secret, rhash, width, now = b"s" * 32, hashlib.sha256(b"r").digest(), 60_000, 1_000_000

    def value(identity, window, h=rhash):
        return hmac.new(secret, identity.encode() + struct.pack("<Q", window) + h, hashlib.sha256).digest()

    def solve(c):
        return next(n for n in range(10**6) if hashlib.sha256(c + struct.pack("<Q", n)).digest()[0] == 0)

    w = now // width
    nonces = [solve(value("me", w - i)) for i in range(3)]
    row = one(spark, c=pow.challenge(secret, F.lit("me"), F.lit(rhash), pow.window_index(F.lit(now), width)))
    assert bytes(row.c) == value("me", w)
    check = lambda n, who="me", h=rhash: one(spark, ok=pow.verify(secret, F.lit(who), F.lit(h), F.lit(8), F.lit(n), width, F.lit(now))).ok
    assert check(nonces[0]) and check(nonces[1]) and not check(nonces[2])
    assert not check(nonces[0], "you") and not check(nonces[0], h=hashlib.sha256(b"other").digest())


@pytest.mark.parametrize("base, over, want", [(8, 0.0, 8), (8, -1.0, 8), (8, 1e6, 28), (250, 100.0, 255), (8, 0.6, 10)])
def test_difficulty(spark, base, over, want):
    assert one(spark, d=pow.difficulty_for(F.lit(base), F.lit(over))).d == want


def test_nonces_are_searched_until_found(spark, monkeypatch):
    monkeypatch.setattr(pow, "CHUNK", 7)
    values = {f"id{i}": hashlib.sha256(b"%d" % i).digest() for i in range(40)} | {None: b"x" * 32}
    bits = lambda v, n: 256 - int.from_bytes(hashlib.sha256(v + struct.pack("<Q", n)).digest(), "big").bit_length()
    want = {k: next(n for n in range(10**7) if bits(v, n) >= 7) for k, v in values.items()}
    tasks = spark.createDataFrame([*values.items(), ("nothing", None)], "identity string, value binary")
    rows = pow.smallest_nonce(tasks, ["identity"], "value", F.lit(7), 3).collect()
    assert max(want.values()) > 256 and len(rows) == len(want) and {r.identity: r.nonce for r in rows} == want
    assert pow.smallest_nonce(tasks.limit(0), ["identity"], "value", F.lit(7), 3).collect() == []
    with pytest.raises(ValueError):
        pow.smallest_nonce(tasks, ["identity"], "value", F.lit(257), 3)


# -- sketches


def test_count_min(spark):
    rows = spark.range(40_000).select((F.pmod(F.xxhash64("id"), F.lit(600))).cast("string").alias("key"))
    true = {r.key: r["count"] for r in rows.groupBy("key").count().collect()}
    cells = sketches.cms_build(rows, "key")
    near = {r.key: r.estimate for r in sketches.cms_estimate(cells, rows, "key").collect()}
    assert near.keys() == true.keys() and all(near[k] >= true[k] for k in true)
    alone = sketches.cms_build(spark.createDataFrame([("x", 7)], "key string, n long"), "key", F.col("n"), 4, 256)
    assert sketches.cms_estimate(alone, spark.createDataFrame([("x",), ("y",)], "key string"), "key", 4, 256).orderBy("key").first().estimate == 7


@pytest.mark.parametrize("n", [1, 5000, 50000])
def test_hyperloglog(spark, n):
    rows = spark.range(n).union(spark.range(n // 2))
    near = sketches.hll_estimate(sketches.hll_registers(rows, "id", []), []).first().estimate
    assert abs(near - n) <= max(1, 0.1 * n)


def test_hyperloglog_merge(spark):
    a, b = (sketches.hll_registers(spark.range(i, i + 3000).withColumn("g", F.lit(1)), "id", ["g"]) for i in (0, 1500))
    near = sketches.hll_estimate(sketches.hll_merge(a, b, groups=["g"]), ["g"]).first().estimate
    assert abs(near - 4500) < 300


# -- changelog


def records(spark, n=30):
    rows = [(i % 2, i, f"k{i % 7}", i % 2, i, bytes([i] * 32), i + 5, i + 9, 201, {"b": "2", "a": "1"}, b"body%d" % i) for i in range(n)]
    schema = "shard int, seq long, key string, tag int, fence long, fp binary, lease_expires_at_ms long, completed_at_ms long, status int, headers map<string,string>, body binary"
    return spark.createDataFrame(rows, schema), rows


def lp(b):
    return struct.pack("<I", len(b)) + b


def test_records_and_chain(spark, monkeypatch):
    df, rows = records(spark)
    chained = changelog.chained(changelog.encoded(df)).withColumn("frame", changelog.framed())
    got = {r.seq: r for r in chained.collect()}
    before = {0: bytes(32), 1: bytes(32)}
    for shard, seq, key, tag, fence, fp, lease, done, status, headers, body in rows:
        if tag == 0:
            rest = b"\0" + struct.pack("<Q", fence) + fp + struct.pack("<Q", lease)
        else:
            pairs = b"".join(lp(k.encode()) + lp(v.encode()) for k, v in sorted(headers.items()))
            rest = b"\1" + fp + struct.pack("<QHI", done, status, len(headers)) + pairs + lp(body)
        data = lp(key.encode()) + rest
        before[shard] = hashlib.sha256(before[shard] + struct.pack("<I", zlib.crc32(data)) + data).digest()
        r = got[seq]
        assert bytes(r.payload) == data and r.crc == zlib.crc32(data) and bytes(r.chain) == before[shard]
        assert bytes(r.frame) == struct.pack("<II", len(data), zlib.crc32(data)) + before[shard] + data
    checked = changelog.verified(chained.drop("frame"))
    assert changelog.first_break(checked).count() == 0 and checked.count() == len(rows)
    assert {r.shard: bytes(r.root) for r in changelog.roots(chained).collect()} == before
    monkeypatch.setattr(changelog, "SLOT", 4)
    assert changelog.first_break(changelog.verified(chained)).count() == 0
    lost = changelog.verified(chained.where("seq not in (8, 9, 16, 17)"))
    assert sorted((r.shard, r.position) for r in changelog.first_break(lost).collect()) == [(0, 5), (1, 5)]
    patched = chained.drop("frame").withColumn("payload", F.when(F.col("seq") == 11, F.lit(b"x")).otherwise(F.col("payload"))).withColumn("crc", F.crc32("payload"))
    assert [(r.shard, r.position) for r in changelog.first_break(changelog.verified(patched), order="seq").collect()] == [(1, 11)]


def test_recovery_and_compaction(spark):
    df, rows = records(spark)
    model = {}
    for r in rows:
        model[r[2]] = r[1]
    assert {r.key: r.seq for r in changelog.latest(df, ["seq"]).collect()} == model
    flushed = spark.createDataFrame([(0, 10), (1, 3)], "shard int, upto long")
    kept = {r[2]: r[1] for r in rows if r[1] <= (10, 3)[r[0]]}
    assert {r.key: r.seq for r in changelog.latest(changelog.recovered(df, flushed), ["seq"]).collect()} == kept
    small = changelog.compacted(changelog.chained(changelog.encoded(df)), F.col("tag") == 1)
    assert changelog.first_break(changelog.verified(small)).count() == 0
    assert {r.key for r in small.collect()} == {k for k, s in model.items() if s % 2}
    assert one(spark, a=changelog.tail_class(F.lit(39), F.lit(0)), b=changelog.tail_class(F.lit(50), F.lit(20)), c=changelog.tail_class(F.lit(60), F.lit(20))) == ("torn", "torn", "corrupt")


# -- request path


def requests(spark, rows):
    schema = "seq long, now_ms long, identity string, idem_key string, method string, target string, body string, backend_status int"
    return spark.createDataFrame([(i, now, who, key, "POST", target, body, status) for i, (now, who, key, target, body, status) in enumerate(rows)], schema)


def test_operational_requests_and_nulls(spark):
    rows = [(0, "ip", "k", "/healthz", "b", 201)] * 5 + [(0, "ip", None, "/metrics?a=b", None, 200), (0, "ip", "n", None, None, 201), (1, "ip", "n", None, None, 201)]
    done = pipeline.handled(requests(spark, rows), (Rule("r", 1000, 2, "block"),), b"k" * 32, Leases())
    got = done.orderBy("seq").collect()
    assert [(r.outcome, r.status) for r in got] == [("operational", 200)] * 6 + [("created", 201), ("replayed", 201)]
    assert metrics.merged(metrics.counters(done)).first().requests_total == 2
    sent = {r.seq: r for r in pipeline.responses(done.withColumn("backend_body", F.concat(F.lit("b"), "seq")), "backend_body", "text\n").collect()}
    shown = lambda i: ([tuple(h) for h in sent[i].headers], sent[i].body)
    assert shown(0) == ([("Gate-Status", "healthy")], "ok") and shown(5) == ([("Content-Type", "text/plain; version=0.0.4")], "text\n")
    assert shown(6) == ([("Gate-Status", "created")], "b6") and shown(7) == ([("Gate-Status", "replayed")], "b6")
    caps = spark.createDataFrame([(1, None), (2, "abc"), (3, "abcd")], "i long, body string")
    fits, over = req.within_cap(caps, 3)
    assert sorted(r.i for r in fits.collect()) == [1, 2] and [(r.i, r.status) for r in over.collect()] == [(3, 413)]


def test_responses_of_denied_and_failed(spark):
    rows = [(0, "a", None, "/x", "b", 503), (0, "a", "k", "/x", "b", None), (0, "a", "k", "/x", "b", 201), (0, "a", "k", "/x", "c", 201), (0, "a", None, "/x", "b", 201)]
    done = pipeline.handled(requests(spark, rows), (Rule("r", 1000, 4, "throttle"),), b"k" * 32, Leases()).withColumn("backend_body", F.lit("own"))
    got = pipeline.responses(done, "backend_body", "").orderBy("seq").collect()
    assert [(r.status, [tuple(h) for h in r.headers], r.body) for r in got] == [
        (503, [], "own"), (502, [("Gate-Status", "upstream-error")], ""), (409, [("Gate-Status", "in-progress")], ""), (422, [("Gate-Status", "mismatch")], ""),
        (429, [("Gate-Status", "denied"), ("Gate-Rule", "r"), ("Gate-Action", "throttle")], ""),
    ]


def handle(spark, rows, rules=(), leases=None):
    got = pipeline.handled(requests(spark, rows), rules, b"k" * 32, leases or Leases(1000, 10**9)).orderBy("seq").collect()
    return [(r.outcome, r.status) for r in got]


def test_gateway(spark):
    assert handle(spark, [(0, "a", "k", "/x", "b", 201), (1, "a", "k", "/x", "b", 201), (2, "a", "k", "/x", "c", 201), (3, "a", None, "/x", "b", 200)]) == [("created", 201), ("replayed", 201), ("mismatch", 422), ("passthrough", 200)]
    failing = [(1000, "a", "k", "/x", "b", 500), (1500, "a", "k", "/x", "b", 500), (3000, "a", "k", "/x", "b", 201)]
    assert handle(spark, failing) == [("upstream_error", 500), ("in_progress", 409), ("created", 201)]
    assert handle(spark, [(0, "a", "k", "/x", "b", None), (0, "a", None, "/x", "b", None)]) == [("upstream_error", 502), ("upstream_error", 502)]
    one_ip = [(0, "ip", f"k{i}", "/x", "b", 201) for i in range(5)]
    assert [s for _, s in handle(spark, one_ip, (Rule("r", 1000, 3, "block"),))] == [201, 201, 201, 429, 429]
    totals = metrics.merged(metrics.counters(pipeline.handled(requests(spark, [(0, "a", "k", "/x", "b", 201), (1, "a", "k", "/x", "b", 201), (2, "a", None, "/x", "b", 200)]), (), b"k" * 32, Leases()))).first()
    assert (totals.requests_total, totals.created, totals.replayed, totals.passthrough) == (3, 1, 1, 1)


def test_codec(spark):
    raw = ["POST /a?x HTTP/1.1\r\nHost: h\r\nContent-Length: 3\r\n\r\nabcdef", "GET / HTTP/1.1\n\n", "", None, "BROKEN\r\n\r\n", "GET / X\r\nbad line\r\n\r\n", "GET / X\r\nContent-Length: 9\r\n\r\nabc", "GET / X\r\ncontent-length: no\r\nA: b: c\r\n\r\nabc", "GET /é X\r\nContent-Length: 2\r\n\r\né"]
    df = spark.createDataFrame(list(enumerate(raw)), "i long, raw string")
    got = {r.i: r for r in req.parsed(df).collect()}
    assert (got[0].request.method, got[0].request.target, bytes(got[0].request.body)) == ("POST", "/a?x", b"abc")
    assert got[1].request.target == "/" and got[1].request.headers == [] and bytes(got[1].request.body) == b""
    assert [(got[i].request, got[i].error) for i in (2, 3)] == [(None, None)] * 2
    assert [got[i].error for i in (4, 5, 6)] == ["malformed request line", "malformed header line", "body too short"]
    assert got[7].request.headers[1] == ("A", "b: c") and bytes(got[7].request.body) == b"" and bytes(got[8].request.body) == "é".encode()


def test_responses(spark):
    raw = ["HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nabc", "HTTP/1.1 204\n\nall of it", "", "HTTP/1.1 abc\r\n\r\n", "HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nabc", "HTTP/1.1 99999 X\n\n", None]
    got = [r for r in req.parsed_response(spark.createDataFrame(list(enumerate(raw)), "i long, raw string")).orderBy("i").collect()]
    assert (got[0].response.status, bytes(got[0].response.body)) == (200, b"ab") and bytes(got[1].response.body) == b"all of it"
    assert [r.error for r in got[2:]] == ["empty response", "bad status line", "body too short", "bad status line", "empty response"]


def test_log_files(spark, tmp_path):
    from tidegate.sources.logfile import decoded, read_log

    df, rows = records(spark)
    own = changelog.chained(changelog.encoded(df)).withColumn("frame", changelog.framed())
    frames = [bytes(r.frame) for r in own.where("shard = 1").orderBy("seq").collect()]
    whole = b"".join(frames)
    second = len(frames[0]) + 45  # in the payload of the second record
    files = {"whole": whole, "torn": whole + b"junk!", "cut": whole[:-3], "corrupt": whole[:second] + bytes([whole[second] ^ 1]) + whole[second + 1 :], "none": b""}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {}
    for r in read_log(spark, f"file://{tmp_path}").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.position, r.tail))
    n = len(frames)
    good = [(i, None) for i in range(n)]
    assert sorted(got["whole"]) == good and sorted(got["torn"], key=str) == sorted([*good, (n, "torn")], key=str)
    assert (n - 1, "torn") in got["cut"] and len(got["cut"]) == n and got["corrupt"][-1] == (1, "corrupt") and "none" not in got
    # every strict prefix of a record decodes to nothing
    cuts = spark.createDataFrame([(i, bytearray(frames[1][:i])) for i in range(len(frames[1]) + 1)], "i long, frame binary")
    assert [r.i for r in decoded(cuts, ["i"]).where("key is not null").collect()] == [len(frames[1])]
    back = {r.seq: r for r in decoded(own.select("seq", "frame"), ["seq"]).collect()}
    for _, seq, key, tag, fence, fp, lease, done, status, headers, body in rows:
        r = back[seq]
        assert (r.key, r.tag, bytes(r.fp)) == (key, tag, fp)
        assert (r.fence, r.lease_expires_at_ms) == ((fence, lease) if tag == 0 else (None, None))
        assert tag == 0 or (r.completed_at_ms, r.status, r.headers, bytes(r.body)) == (done, status, headers, body)


def test_log_is_opened_or_refused(spark, tmp_path):
    from tidegate.sources.logfile import current, open_log, replaced

    df, rows = records(spark)
    own = changelog.chained(changelog.encoded(df)).withColumn("frame", changelog.framed())
    frames = [bytes(r.frame) for r in own.where("shard = 1").orderBy("seq").collect()]
    keys = [r[2] for r in rows if r[0] == 1]

    def opened(*data):
        folder = tmp_path / f"log{len(list(tmp_path.iterdir()))}"
        folder.mkdir()
        (folder / "one").write_bytes(b"".join(data))
        return [(r.key, bytes(r.chain)) for r in open_log(spark, f"file://{folder}").orderBy("position").collect()]

    assert [k for k, _ in opened(*frames)] == keys and [k for k, _ in opened(*frames, b"junk!")] == keys
    assert [k for k, _ in opened(*frames[:-1], frames[-1][:-1])] == keys[:-1] and opened(b"") == []
    flipped = frames[1][:45] + bytes([frames[1][45] ^ 1]) + frames[1][46:]
    with pytest.raises(ValueError, match="corrupt"):
        opened(frames[0], flipped, *frames[2:])
    payload = flipped[40:]
    with pytest.raises(ValueError, match="follow"):
        opened(frames[0], struct.pack("<II", len(payload), zlib.crc32(payload)) + flipped[8:40] + payload, *frames[2:])
    with pytest.raises(ValueError, match="follow"):
        opened(frames[0], *frames[2:])
    with pytest.raises(ValueError, match="follow"):
        opened(frames[1], frames[0])
    place = f"file://{tmp_path}/table"
    assert current(spark, place) is None
    for n in (200, 3):
        assert replaced(spark.range(n), place) == current(spark, place) and spark.read.parquet(current(spark, place)).count() == n


def test_frames_of_a_log(spark):
    df, _ = records(spark, 4)
    frame = [bytes(r.frame) for r in changelog.chained(changelog.encoded(df)).withColumn("frame", changelog.framed()).collect()][0]
    cases = [(frame, None), (b"", "torn"), (frame[:39], "torn"), (frame[:-1], "torn"), (frame[:-1] + bytes([frame[-1] ^ 1]), "corrupt"), (frame + b"more", None), (b"\xff" * 60, "torn")]
    rows = spark.createDataFrame([(i, bytearray(f)) for i, (f, _) in enumerate(cases)], "i long, frame binary")
    assert [r.tail for r in rows.select("i", changelog.tail_of(F.col("frame")).alias("tail")).orderBy("i").collect()] == [w for _, w in cases]


def test_states_that_a_crash_leaves(spark):
    """Completed keys replay, what was in progress waits for its lease, and tokens from before do not fit after it."""
    restored = [(0, "done", "restored_completed", "a", 10_000, 3, 201), (0, "open", "restored_in_progress", "a", 5_000, 2, None), (0, "old", "restored_completed", "a", 500, 1, 201)]
    rows = restored + [(1, "done", "begin", "a", 1000, None, None), (2, "done", "begin", "z", 1000, None, None), (3, "open", "begin", "a", 1000, None, None), (4, "open", "begin", "a", 5000, None, None)]
    rows += [(5, "open", "complete", None, 5001, 2, 201), (6, "open", "complete", None, 5001, 3, 201), (7, "old", "begin", "z", 1000, None, None)]
    got = {r.seq: r for r in decide(spark, rows, Leases(1000, 10_000)).where("seq > 0").collect()}
    assert [got[i].decision for i in range(1, 8)] == ["replay", "mismatch", "in_progress", "run", "stale_fence", "ok", "run"]
    assert got[1].outcome_status == 201 and got[4].fence == 3 and got[7].fence == 2


def test_events_without_user(spark):
    import datetime

    rows = [(i, datetime.datetime(2024, 1, 1, 0, 0, i), user, "view", 1.0, "{}") for i, user in enumerate([None, None, 7])]
    got = req.from_events(spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")).orderBy("seq")
    assert [(r.identity, r.idem_key) for r in got.collect()] == [("anonymous", None), ("anonymous", None), ("7", "7-view")]
    done = pipeline.handled(got, (Rule("r", 86_400_000, 1, "block"),), b"k" * 32, Leases()).orderBy("seq").collect()
    assert [r.outcome for r in done] == ["passthrough", "denied", "created"]


def test_empty_inputs(spark):
    none = requests(spark, [])
    assert pipeline.handled(none, (Rule("r", 1000, 1, "block"),), b"k" * 32, Leases()).count() == 0
    assert decide(spark, [], Leases()).count() == 0
    assert metrics.merged(metrics.counters(spark.createDataFrame([], "outcome string"))).first().requests_total == 0
    assert sketches.hll_estimate(sketches.hll_registers(spark.range(0), "id", []), []).first().estimate == 0
