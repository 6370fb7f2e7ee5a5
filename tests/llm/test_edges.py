"""Long texts, nulls, repeated rows and clashing columns; learning and grouping against plain models."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from test_text_operators import WORD, base_model, jaccard_model, passages_model

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node string"


def long_text(seed, words=150_000):
    rnd = random.Random(seed)
    return " ".join(f"w{rnd.randrange(10**6)}" for _ in range(words))


@pytest.fixture(scope="module")
def odd():
    """Two texts over a slice of memory that share nearly all, one more, repeated rows, nulls of all kinds."""
    a = long_text(1)
    b = a.split(" ")
    b[1000], b[120_000] = "changed", "mail@example.com"
    texts = [(1, a), (2, " ".join(b)), (3, long_text(2, 140_000) + " " + " ".join(b[500:560])), (4, "é" * 600_000), (5, None), (6, ""), (7, "one two three four five six"), (7, "one two three four five six"), (None, "one two three four five six"), (8, "tail")]
    return [(d, t, None if d == 5 else "en", None if d in (5, 7) else "s", len(t) if t else None, 9, "n") for d, t in texts]


@pytest.fixture(scope="module")
def docs(spark, odd):
    return spark.createDataFrame(odd, SCHEMA).repartition(3).cache()


def test_long_texts_link(docs, odd):
    from tidegate.llm.jaccard import JaccardJoin

    want = jaccard_model([(r[0], r[1]) for r in odd if r[0]])
    got = JaccardJoin().components(docs).collect()
    assert len(got) == len(odd) and {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id} == want and want[2][1] == 1


def test_long_texts_share_passages(docs, odd):
    from tidegate.llm.suffixes import repeated_passages

    got = defaultdict(set)
    for r in repeated_passages(docs).collect():
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    assert dict(got) == passages_model([(r[0], r[1]) for r in odd if r[0]]) and len(got[3]) == 60


def test_long_texts_are_searched_for_personal_data(docs, odd):
    from tidegate.llm.pii import digest, masked, personal_data

    got = {r.doc_id: r.spans for r in digest(personal_data(docs)).collect()}
    assert len(got) == 9 and all(got[r[0]] == ",".join(s for s, _ in base_model(r[1])) for r in odd) and "email" in got[2]
    assert [r.text.count("[EMAIL]") for r in masked(docs).where("doc_id = 2").collect()] == [1]


def test_long_texts_are_packed_and_mixed(docs, odd):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from tidegate.llm.mixing import Mixer
    from tidegate.llm.packing import digest, packed

    rows = digest(packed(docs, P.path("word_bpe_49k.json"))).collect()
    reference = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    for r in odd:
        want[r[0]] += len(reference.encode(r[1] or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == want
    sizes = Counter((r[0], len(WORD.findall(r[1] or ""))) for r in odd)
    taken = Mixer().taken(docs)
    assert taken.columns == [*(c for c in docs.columns if c != "size"), "size", "source_size", "target", "taken"]
    assert Counter((r.doc_id, r.size) for r in taken.collect()) == sizes


def test_long_texts_are_judged(docs, odd):
    from tidegate.llm.quality import judged

    got = Counter((r.doc_id, r.n_words, r.word_chars) for r in judged(docs).collect())
    assert got == Counter((r[0], len(WORD.findall(r[1] or "")), sum(map(len, WORD.findall(r[1] or "")))) for r in odd)


def test_stages_on_odd_rows(spark, odd, docs, tmp_path):
    """Clean documents stay, whatever is null or repeated; columns stay as they are."""
    import corpus_pipeline

    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1000, 1060)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    more = [(i, "vile text here" if i % 4 == 0 else f"fine words {i} of {i * 7}", "en", "t", 1, 9, "n") for i in range(1000, 1060)]
    # sixty labels say nothing of hundreds of thousands of words
    kept, out = spark.createDataFrame(more, SCHEMA).unionByName(docs.where("doc_id is null or doc_id > 3")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        if name == "toxicity":
            kept = kept.unionByName(docs.where("doc_id <= 3"))
        assert kept.dtypes == docs.dtypes
        kept.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = Counter(r.doc_id for r in kept.select("doc_id").collect())
    good = {r[0] for r in more if r[0] % 4} | {1, 2, 3, 4, 5, 6, 7, 8, None}
    assert set(out["toxicity"]) == good and out["toxicity"][7] == 2
    # 2 is a near copy of 1, and of two rows of 7 one stays
    assert set(out["ngram_jaccard_join"]) == good - {2} and max(out["ngram_jaccard_join"].values()) == 1
    assert out["pii"] == out["ngram_jaccard_join"] and set(out["mixing"]) <= set(out["pii"]) - {5, 6}
    assert corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).count() > 0


# -- learning


def ftrl_model(examples, epochs, alpha, beta, l1, l2):
    """Per coordinate, in dictionaries; the last feature of each example is the intercept, without the L1 term."""
    z, n = defaultdict(float), defaultdict(float)
    free = examples[0][0][-1] if examples else None

    def weight(i):
        edge = 0.0 if i == free else l1
        return 0.0 if abs(z[i]) <= edge else -(z[i] - math.copysign(edge, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for own, label in examples:
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - label
            for i in own:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z if weight(i)}


def test_learning_against_dictionaries():
    from tidegate.llm.toxicity import BITS, ftrl

    rnd = random.Random(3)
    examples = [(np.array([*sorted(rnd.sample(range(60), rnd.randint(1, 12))), 1 << BITS], dtype=np.int32), rnd.randint(0, 1)) for _ in range(150)]
    settings = {"epochs": 3, "alpha": 1.5, "beta": 1.0, "l1": 0.4, "l2": 0.1}
    got = ftrl(examples, **settings)
    want = ftrl_model([(own.tolist(), label) for own, label in examples], **settings)
    assert np.flatnonzero(got).tolist() == sorted(want) and all(abs(got[i] - w) < 1e-9 for i, w in want.items())
    assert 0 < len(want) < 61


def test_features_are_words_and_pairs():
    from tidegate.llm.toxicity import _extract

    text = "It's a plain-text: a PLAIN, text of é words"
    words = ["it's", "a", "plain", "text", "a", "plain", "text", "of", "é", "words"]
    want = set(words) | {(gap, x, y) for gap in (1, 2, 3) for x, y in zip(words, words[gap:], strict=False)}
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, ""]), pa.array([1, 0], pa.int32())], ["doc_id", "text", "label"])
    got = [x for b in _extract(iter([batch])) for x in b.column(2).to_pylist()]
    assert [len(set(x)) for x in got] == [len(want), 0]


def test_sample_is_bounded_by_features(spark):
    from tidegate.llm.toxicity import ToxicityModel

    rnd = random.Random(4)
    rows = [(i, ("vile " if i % 3 == 0 else "") + " ".join(f"w{rnd.randrange(50)}" for _ in range(20)), int(i % 3 == 0)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    whole = ToxicityModel.fit(docs, docs)
    assert len(whole.buckets) and len(ToxicityModel.fit(docs, docs, max_features=0).buckets) == 0
    part = ToxicityModel.fit(docs, docs, max_features=9000)
    assert len(part.buckets) and not np.array_equal(part.weights, whole.weights)
    again = ToxicityModel.fit(docs.repartition(5), docs.union(docs), max_features=9000)
    assert np.array_equal(part.buckets, again.buckets) and np.array_equal(part.weights, again.weights)


# -- packing


def test_tiers_and_step_groups(spark):
    import public_tokenizers as P

    from tidegate.llm.packing import STEP, TIERS, pack, packed

    rnd = random.Random(5)
    pieces = [(rnd.randint(1, 5000), i, 0) for i in range(500)]
    done, left = pack(pieces, TIERS, last=False)
    assert all(sum(n for *_, n in own) == tier and tier in TIERS for tier, own in done) and sum(p[0] for p in left) < max(TIERS)
    # the longest piece of a sequence is what its tier was chosen for
    assert all(max(n for *_, n in own) > tier // 2 for tier, own in done if tier > min(TIERS))
    rows = [(i, "word " * rnd.randint(1, 900)) for i in range(300)]
    got = packed(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), P.path("word_bpe_49k.json")).drop("ids").collect()
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
    groups = defaultdict(list)
    for own in sequences.values():
        assert len({(r.tier, r.step_group) for r in own}) == 1
        groups[own[0].step_group].append((own[0].tier, sum(r.length**2 for r in own)))
    by_tier = defaultdict(list)
    for own in groups.values():
        assert len({t for t, _ in own}) == 1 and len(own) <= STEP
        by_tier[own[0][0]].append((len(own), sum(c for _, c in own), max(c for _, c in own)))
    for own in by_tier.values():
        full = [c for n, c, _ in own if n == max(n for n, *_ in own)]
        assert max(full) - min(full) <= max(m for *_, m in own)
