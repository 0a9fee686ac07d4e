import hashlib

import corpus_pipeline
from spreadlab.llm import queries
from spreadlab.llm.common import table
from tests.conftest import SF


def test_stages(spark):
    documents = table(spark, SF, "documents")
    docs, counts = documents, [documents.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.keep(stage(spark, docs, SF), name)
        assert docs.columns == documents.columns
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and counts[4] <= counts[3]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    want = sorted((r.doc_id, hashlib.sha256((r.text or "").replace("▁", " ").encode()).hexdigest()) for r in docs.collect())
    assert sorted((r.doc_id, r.decoded_sha256) for r in last.collect()) == want


def test_stages_of_an_empty_corpus(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_all_operators_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.queries()) == list(range(1, 14))
