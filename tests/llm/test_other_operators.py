"""Search, URL, quality and preference operators; queries against their SQL."""

import math
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from oracle import same  # noqa: E402

from tidegate.llm import queries, sql  # noqa: E402


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_query_against_sql(spark, sf, name):
    same(queries.queries()[name](spark, sf), sql.ORACLE[name], sf)


# -- search


def top_k_model(rows, asked, k=10):
    known = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for i, q in known:
        if asked(i):
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in known if j != i and len(v) == len(q))
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def test_top_k(spark):
    from tidegate.llm.topk import top_k

    rnd = random.Random(3)
    rows = [(i, [float(np.float32(rnd.gauss(0, 0.4))) for _ in range(8)]) for i in range(-100, 700)]
    rows += [(i, [0.5] * 8) for i in range(700, 1000)]  # many equal vectors
    rows += [(1000, None), (1001, [1.0] * 7 + [None]), (1002, [float("nan")] * 8), (1100, [0.25, 0.5]), (1200, [0.5, 0.25]), (1300, [float("inf")] * 8), (None, [1.0] * 8), (1400, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(5)
    got = {}
    for r in top_k(df, df.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = {q: v for q, v in top_k_model(rows, lambda i: i % 100 == 0).items() if v}
    assert {q: [v[i] for i in sorted(v)] for q, v in got.items()} == want
    assert top_k(df.limit(0), df.limit(0)).collect() == []


def test_top_k_blocks(spark, monkeypatch):
    from tidegate.llm import topk

    monkeypatch.setattr(topk, "BLOCK", 16)
    rnd = random.Random(4)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 5 = 0"), k=3).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert {q: [v[i] for i in sorted(v)] for q, v in got.items()} == top_k_model(rows, lambda i: i % 5 == 0, 3)


def found_by(df, k=10):
    from tidegate.llm.topk import top_k

    got = {}
    for r in top_k(df, df.where("vec_id % 100 = 0"), k=k).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    return {q: [v[i] for i in sorted(v)] for q, v in got.items()}


@pytest.mark.parametrize("size", [1e5, 6e5])
def test_top_k_of_large_components(spark, size):
    """Inner products beyond what doubles hold are exact."""
    rnd = random.Random(5)
    base = [[rnd.choice((-1, 1)) * size * rnd.random() for _ in range(6)] for _ in range(4)]
    rows = [(i, [x + rnd.choice((0, 1 / 1024, 2 / 1024)) for x in base[i % 4]]) for i in range(300)] + [(400, [0.5] * 6), (401, [0.25] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = top_k_model(rows, lambda i: i % 100 == 0)
    assert max(abs(s) for v in want.values() for _, s in v) > 2**53
    assert found_by(df) == want


def test_top_k_beyond_64_bits(spark):
    rows = [(0, [1e10, 0.0]), (1, [1e10, 5.0]), (2, [-1e10, 1.0]), (3, [1e-3, 1.0]), (4, [3e38 * 1e200, 1.0])]
    got = found_by(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))[0]
    assert got == [(1, 2**63 - 1), (4, 2**63 - 1), (3, math.floor(1.024) * 1024 * 10**10), (2, -(2**63))]


def test_top_k_repeated_ids(spark):
    """An unusable row of an id does not stand in for a usable one."""
    rows = [(0, [None, 1.0]), (0, [1.0, 1.0]), (0, None), (1, [2.0, 2.0]), (1, [2.0, 2.0]), (2, [1.0, None])]
    assert found_by(spark.createDataFrame(rows, "vec_id long, embedding array<double>")) == {0: [(1, 4 * 1024 * 1024)] * 2}


def test_ball_tree_prunes_clusters():
    """With clustered vectors most of a shard is never scored, and what is found is the same."""
    from tidegate.llm import topk

    rng = np.random.default_rng(6)
    centres = rng.normal(0, 4000, (40, 16))
    x = np.floor(centres[rng.integers(0, 40, 8000)] + rng.normal(0, 30, (8000, 16)))
    ids = np.arange(8000)
    q = x[::400]
    search = topk._Search(ids[::400], q, np.full(len(q), -1e18), 10)
    search.shard(ids, x)
    _, v, s = search.shrink()
    scores = q @ x.T
    scores[np.arange(len(q)), ids[::400]] = -np.inf
    want = [sorted(zip(-row, ids, strict=True))[:10] for row in scores]
    assert [(-a, b) for row in want for a, b in row] == list(zip(s, v, strict=True))
    assert search.scored < 0.3 * len(q) * len(x)


# -- URLs


def url_model(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
        host, slash, tail = rest.partition("/")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = slash + tail
    best = None
    for action, rule in (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")):
        own, _, rest = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = (action, rule)
    return host, path, best


def test_urls(spark, sf):
    from tidegate.llm.urls import judged

    urls = [r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    urls += [None, "", "no scheme", "http://", "://x", "HTTP://WWW.Example.COM/en/a?b#c", "http://example.com", "http://Xcom/", "a://b://c/d", "http://é.com/ñ", "http://a.net/fr/x\ny", "http://b.org?x/y", "http://c.com#/"]
    rows = judged(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, best = url_model(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")
    assert judged(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_url_rows(spark):
    """Repeated rows, null and narrow ids, clashing columns."""
    from tidegate.llm.urls import judged

    rows = [(1, "http://a.com/x"), (1, "http://a.com/x"), (None, "http://a.net/fr/"), (2, None)]
    df = spark.createDataFrame(rows, "page_id int, url string")
    for name in ("host", "path", "rule", "verdict", "gram", "block_id", "held"):
        df = df.withColumn(name, F.lit(1))
    got = judged(df).collect()
    assert sorted(((r.page_id, r.host, r.verdict) for r in got), key=str) == [(1, "a.com", "allow"), (1, "a.com", "allow"), (2, "", "allow"), (None, "a.net", "block")]


def test_url_model_is_a_distribution_and_separates(spark):
    from tidegate.llm.urls import CharModel, judged

    m = CharModel({"a": 3, "b": 1, "aa": 2, "ab": 1})
    assert abs(sum(m.probability("a", c) for c in "ab") + 254 * m.probability("a", "z") - 1) < 1e-9
    rows = [(i, f"http://good{i}.com/wiki/article{i}") for i in range(60)] + [(100 + i, f"http://bad{i}.net/fr/casino-win{i}") for i in range(60)]
    rows += [(500, "http://other.org/wiki/article5"), (501, "http://other.org/fr/casino-win7")]
    got = {r.page_id: r.verdict for r in judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[500] == "allow" and got[501] == "block"


def test_url_models_keep_every_gram_of_whole_urls(spark, monkeypatch):
    from tidegate.llm import urls

    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcé/.-x") for _ in range(rnd.randint(1, 12)))
    texts = [f"http://{word()}.com/{word()}?{word()}" for _ in range(60)] + [f"https://{word()}.net/fr/{word()}#{word()}" for _ in range(50)]
    texts += [f"ftp://{word()}.org/{word()}" for _ in range(20)] + ["http://o.org/p", "http://o.org/p?ref=casino", "http://o.org/p#top", "no scheme", "", None, texts[0]]
    counts = {"allow": {}, "block": {}, None: {}}
    held = lambda t: zlib.crc32((t or "").encode()) % 5 == 0
    for t in texts:
        best = None if held(t) else url_model(t)[2]
        text = "\x02" * 4 + (t or "")
        for n in range(1, 6):
            for i in range(5 - n, len(text) - n + 1):
                own = counts[best and best[0]]
                own[text[i : i + n]] = own.get(text[i : i + n], 0) + 1
    accepted, rejected = urls.CharModel(counts["allow"]), urls.CharModel(counts["block"])

    def score(t):
        text = "\x02" * 4 + t
        each = [math.log(accepted.probability(text[i : i + 4], text[i + 4])) - math.log(rejected.probability(text[i : i + 4], text[i + 4])) for i in range(len(t))]
        return sum(each) / len(t) if t else 0.0

    monkeypatch.setattr(urls, "BLOCK_BITS", 3)
    rows = urls.judged(spark.createDataFrame(list(enumerate(texts)), "page_id long, url string").repartition(3)).collect()
    got = {r.page_id: r.ratio for r in rows}
    assert len(rows) == len(got) == len(texts)
    for i, t in enumerate(texts):
        assert abs(got[i] - score(t or "")) < 1e-9, t
    spread = {}
    for kind in ("allow", "block"):
        own = [score(t) for t in texts if t and held(t) and (best := url_model(t)[2]) and best[0] == kind]
        spread[kind] = np.mean(own), np.std(own)
    (a, sa), (b, sb) = spread["allow"], spread["block"]
    threshold = (a * sb + b * sa) / (sa + sb)
    for r in rows:
        t, best = texts[r.page_id], url_model(texts[r.page_id])[2]
        assert abs(score(t or "") - threshold) > 1e-6 and r.verdict == (best[0] if best else "block" if t and score(t) < threshold else "allow")
    at = {t: got[i] for i, t in enumerate(texts)}
    assert len({at[f"http://o.org/p{x}"] for x in ("", "?ref=casino", "#top")}) == 3 and at["no scheme"] != 0


# -- quality


def test_quality_edges(spark):
    from tidegate.llm.quality import judged

    rows = [(1, None, "en"), (2, "", None), (3, "a b c " * 300, "en"), (4, "x" * 100_000, "xx"), (5, "a b c d a b c", "de"), (None, "q\n\nq\n q", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("words", F.lit(1))
    got = {r.doc_id: r for r in judged(df).collect()}
    assert [(got[i].n_words, got[i].n_repeat_words, got[i].kept) for i in (1, 2, 3, 4, 5)] == [(0, 0, False), (0, 0, False), (900, 900, False), (1, 0, False), (7, 6, False)]
    assert got[None].n_dup_lines == 1 and judged(df.limit(0)).collect() == []


def test_js_distance(spark):

    from tidegate.llm.quality import js_distance

    df = spark.createDataFrame([([1, 0], [0, 5]), ([1, 1], [7, 7]), ([0, 0], [1, 1])], "p array<long>, q array<long>")
    assert [round(r[0], 9) for r in df.select(js_distance(F.col("p"), F.col("q"))).collect()] == [1.0, 0.0, 0.0]


# -- preferences


def test_preferences(spark):
    from tidegate.llm.preferences import formatted

    pairs = {
        1: ([("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "b")], [("user", "q"), ("assistant", "a"), ("user", "s")]),
        2: ([("user", "same")], [("user", "same")]),
        3: ([("user", "only one side")], []),
        4: ([("user", None), (None, "x"), ("assistant", "")], [("user", None), (None, "x"), ("assistant", None)]),
        5: ([("user", "q"), ("user", "q"), ("user", "q")], [("user", "q")]),
    }
    rows = [(p, side == 0, i, r, t) for p, both in pairs.items() for side, own in enumerate(both) for i, (r, t) in enumerate(own)]
    df = spark.createDataFrame([*rows, (None, True, 0, "user", "x")], "pair_id long, chosen boolean, turn long, role string, text string").withColumn("position", F.lit(7))
    got = {}
    for r in formatted(df).collect():
        got.setdefault((r.pair_id, r.part), []).append((r.position, r.rendered, r.learned))
    for p, (a, b) in pairs.items():
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        show = lambda own, common: [(i, f"<|{r or 'unknown'}|>\n{t or ''}\n", r == "assistant" and not common) for i, (r, t) in own]
        turns = list(enumerate(a))
        assert sorted(got.get((p, "prompt"), [])) == show(turns[:n], True)
        assert sorted(got.get((p, "chosen"), [])) == show(turns[n:], False)
        assert sorted(got.get((p, "rejected"), [])) == show(list(enumerate(b))[n:], False)


def test_exchanged_answers(spark):
    from tidegate.llm.preferences import exchanged_answers, formatted

    rows = [(4, 0, "user", "q"), (4, 1, "assistant", "a"), (4, 2, "user", "more"), (5, 0, "user", "r"), (5, 1, "assistant", "b"), (5, 2, "assistant", "c"), (6, 0, "user", "alone"), (None, 0, "user", "x")]
    got = {}
    for r in formatted(exchanged_answers(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))).collect():
        got.setdefault((r.pair_id, r.part), {})[r.position] = r.rendered.split("\n")[1]
    assert got == {
        (4, "prompt"): {0: "q"}, (4, "chosen"): {1: "a", 2: "more"}, (4, "rejected"): {1: "c"},
        (5, "prompt"): {0: "r", 1: "b"}, (5, "chosen"): {2: "c"}, (5, "rejected"): {2: "a"}, (6, "prompt"): {0: "alone"},
    }
    assert formatted(exchanged_answers(spark.createDataFrame([], "conv_id int, turn int, role string, text string"))).collect() == []


def test_assembled(spark):
    from tidegate.llm.preferences import assembled, formatted

    turns = [(1, True, 0, "user", "q"), (1, True, 1, "assistant", "a"), (1, False, 0, "user", "q"), (1, False, 1, "assistant", "b")]
    r = assembled(formatted(spark.createDataFrame(turns, "pair_id long, chosen boolean, turn long, role string, text string"))).first()
    assert r.prompt == "<|user|>\nq\n" and r.chosen == [("<|assistant|>\na\n", True)] and r.rejected == [("<|assistant|>\nb\n", True)]
