"""Each stage of the pipeline on all that its predecessor kept, against plain models."""

from collections import Counter, defaultdict

from test_text_operators import WORD, base_model, jaccard_model

from tidegate.llm.shared import Stash


def test_stages(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "pii", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stash, kept = Stash(spark), {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = stash.keep(stage(spark, docs, sf), name)
        if name != "packing":
            assert kept[name].dtypes == docs.dtypes
        docs = kept[name]
    rows = {n: df.collect() for n, df in kept.items()}

    from tidegate.llm.toxicity import scores

    good = {r.doc_id for r in scores(kept["start"], spark.read.parquet(f"{sf}/labels.parquet")).collect() if not r.predicted}
    assert sorted(r.doc_id for r in rows["toxicity"]) == sorted(good) and len(good) > 0.7 * len(rows["start"])
    named = jaccard_model([(r.doc_id, r.text) for r in rows["toxicity"]])
    assert sorted(r.doc_id for r in rows["ngram_jaccard_join"]) == sorted(d for d, (_, c) in named.items() if d == c)
    assert sorted(r.doc_id for r in rows["pii"]) == sorted(r.doc_id for r in rows["ngram_jaccard_join"])
    assert any(base_model(r.text) for r in rows["ngram_jaccard_join"])
    assert not any(base_model(r.text) for r in rows["pii"]) and all(r.n_chars == len(r.text) for r in rows["pii"])
    times, texts = Counter(r.doc_id for r in rows["mixing"]), {r.doc_id: r for r in rows["pii"]}
    assert max(times.values()) <= 2 and all(r == texts[r.doc_id] for r in rows["mixing"])
    total = sum(len(WORD.findall(r.text)) for r in rows["pii"])
    taken = sum(len(WORD.findall(r.text)) for r in rows["mixing"])
    assert abs(taken - 1.5 * total) < 0.15 * total
    tokens = defaultdict(int)
    for r in rows["packing"]:
        tokens[r.doc_id] += r.length
    each = {r.doc_id: r.doc_tokens for r in rows["packing"]}
    assert tokens == {d: n * times[d] for d, n in each.items()} and set(each) == set(times)


def test_run_on_an_empty_table(spark, sf, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
