"""The pipeline against its stages' plain versions."""

from collections import Counter

import corpus_pipeline
from llm import brute


def test_stages_take_effect(spark, corpus, tmp_path):
    at = str(tmp_path)
    corpus.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, int(k < 190), 0) for k in range(220)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    docs, kept = spark.read.parquet(f"{at}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, at).write.parquet(f"{at}/{k}")
        after = spark.read.parquet(f"{at}/{k}")
        if k < 4:
            assert after.columns == corpus.columns, name
            kept.append({r.doc_id: r.text for r in after.collect()})
        docs = after
    start = {r.doc_id: r.text for r in corpus.collect()}
    assert all(len(brute.words(t)) >= 50 for t in kept[0].values()) and set(kept[0]) <= set(start)
    assert set(kept[1]) == {keep for i, keep, *_ in brute.exact(list(kept[0].items()))}
    assert set(kept[2]) == {c for _, _, c in brute.near(list(kept[1].items()), 5, 80)}
    assert set(kept[3]) == set(kept[2]) and not any(brute.base_spans(t) for t in kept[3].values())
    assert {r.doc_id for r in docs.collect()} == set(kept[3])
    run = corpus_pipeline.run(spark, at)
    assert run.columns == docs.columns
    pieces = lambda df: Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert pieces(run) == pieces(docs)
