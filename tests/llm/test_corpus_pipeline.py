"""Each stage on a small corpus with planted cases, against what brute force says."""

import corpus_pipeline

from .test_text_operators import mixture, near_brute


def test_stages(spark, documents, tmp_path):
    bench = [f"bench word number {k} alpha beta gamma delta epsilon zeta" for k in range(3)]
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    texts = [*mixture(11, 40), "12345 !!!", f"{bench[0]} and {bench[1]}", f"intro text here {bench[2]} tail end", "write to jo@site.org today"]
    docs = documents(texts)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = [f for _, f in corpus_pipeline.STAGES]
    one = stages[0](spark, docs, str(tmp_path))
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in one.collect()} == {40}
    two = stages[1](spark, one, str(tmp_path))
    ids = [r.doc_id for r in sorted(one.collect())]
    comp = near_brute([texts[k] for k in ids], 5, 80)
    assert sorted(r.doc_id for r in two.collect()) == [ids[k] for k, (_, c) in enumerate(comp) if c == k]
    three = {r.doc_id: r for r in stages[2](spark, two, str(tmp_path)).collect()}
    assert 41 not in three and three[42].text == "intro text here tail end" and three[42].n_chars == len(three[42].text)
    four = stages[3](spark, stages[2](spark, two, str(tmp_path)), str(tmp_path))
    assert four.columns == docs.columns
    assert {r.doc_id: r.text for r in four.collect()}[43] == "write to <EMAIL> today"
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == set(three)
