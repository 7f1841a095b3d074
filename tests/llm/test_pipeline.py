import corpus_pipeline

from lumisift.llm import decontam, jaccard, secrets, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    labels, items = (corpus_pipeline.table(spark, SF, t) for t in ("labels", "benchmark"))
    rows = {r.doc_id: r for r in docs.collect()}
    chain = toxicity.chain_of(docs, labels)
    left = {i for i, r in rows.items() if chain.score(r.text)[-1] < chain.threshold}
    here = docs.where(docs.doc_id.isin(list(left)))
    from tests.llm.test_jaccard import brute

    left = {i for i, (c, _) in brute([(i, rows[i].text) for i in sorted(left)]).items() if c == i}
    assert {r.doc_id for r in jaccard.one_of_each(here).collect()} == left
    left -= {r.doc_id for r in decontam.leaks(docs, items).collect()}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) == left and all(r.round_trip for r in out.values())
    import hashlib

    for i in left:
        assert out[i].decoded_sha256 == hashlib.sha256((secrets.redact(rows[i].text) or "").encode()).hexdigest()


def test_filters_return_the_columns_of_documents(spark):
    docs = corpus_pipeline.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
