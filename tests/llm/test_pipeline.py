"""The pipeline: every stage's decisions take effect on all that its predecessor kept."""

import corpus_pipeline
from llm.conftest import KINDS, texts_of
from llm.test_near_copies import kept_of

from loomql.llm import op3_toxicity, op5_pseudonyms, op7_mixing


def test_stages(spark, small, docs):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and names[1] == "simhash"
    labels = spark.read.parquet(f"{small}/labels.parquet")
    scores = {r["doc_id"]: r["predicted"] for r in op3_toxicity.score_documents(docs, op3_toxicity.train(docs, labels)).collect()}
    at, kept = docs, []
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, stage(spark, at, small).cache()
        kept.append(at)
        if name != "sentencepiece":
            assert at.dtypes == docs.dtypes
        ids = sorted(r["doc_id"] for r in at.select("doc_id").collect())
        if name == "toxicity":
            assert ids == sorted(i for i, p in scores.items() if p == 0) and len(ids) < docs.count()
        elif name == "simhash":
            assert ids == sorted(kept_of(texts_of(before)))
        elif name == "pseudonyms":
            new = {r["row"]["doc_id"]: r["text"] for r in op5_pseudonyms.pseudonymise(before).collect()}
            assert {r["doc_id"]: r["text"] for r in at.collect()} == new
            assert all(r["n_chars"] == len(r["text"]) for r in at.collect())
        elif name == "mixing":
            copies = {r["doc_id"]: r["copies"] for r in op7_mixing.mix(before).collect()}
            assert ids == sorted(i for i, n in copies.items() for _ in range(n))
        else:
            assert len(ids) == before.count() and all(r["round_trip"] and len(r["ids"]) == r["n_pieces"] for r in at.collect())
    final = corpus_pipeline.run(spark, small)
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in final.collect()) == sorted((r["doc_id"], r["ids_crc32"]) for r in kept[-1].collect())


def test_awkward_rows(spark, odd, empty, small):
    for start in (odd.select(*[c for c in odd.columns]), empty, spark.createDataFrame([(None, None, None, None, None)], KINDS)):
        at = start
        for name, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, small)
            if name != "sentencepiece":
                assert at.columns == start.columns
        at.count()
