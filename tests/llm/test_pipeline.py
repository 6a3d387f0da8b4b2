import re

import pytest

import corpus_pipeline
from millrace.llm import mixing, pii, toxicity
from millrace.session import table


@pytest.fixture(scope="module")
def steps(spark, sf, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = table(spark, sf, "documents")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append(docs)
    return out


def test_all_but_the_last_stage_keep_the_columns(steps):
    assert len(corpus_pipeline.STAGES) == 5
    for df in steps[1:5]:
        assert df.schema == steps[0].schema


def test_toxic_documents_go(spark, sf, steps):
    model = toxicity.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    scorer = toxicity._Scorer(model)
    want = {r.doc_id for r in steps[0].collect() if scorer.scores([r.text])[0] < 0.5}
    assert {r.doc_id for r in steps[1].collect()} == want


def test_one_document_of_each_group_stays(steps):
    before, after = [{r.doc_id: r.text for r in s.collect()} for s in steps[1:3]]
    assert set(after) <= set(before) and len(set(after.values())) == len(after)
    for key, text in before.items():
        if key not in after:
            assert any(other < key for other in after)
    first = {}
    for key, text in sorted(before.items()):
        first.setdefault(text, key)
    assert all(first[text] == key for key, text in after.items())


def test_no_personal_data_is_left(steps):
    before, after = [{r.doc_id: r.text for r in s.collect()} for s in steps[2:4]]
    assert set(before) == set(after)
    for key, text in after.items():
        assert text == pii.redact(before[key]) and not pii.spans(text)


def test_mix_takes_its_budgets(steps):
    want = {}
    for r in mixing.mix(steps[3]).collect():
        want[r.source] = want.get(r.source, 0) + r.taken
    got = {}
    for r in steps[4].collect():
        got[r.source] = got.get(r.source, 0) + len(re.findall(mixing.WORD, r.text))
        assert r.n_chars == len(r.text)
    assert got == {s: n for s, n in want.items() if n}


def test_encoding_is_whole(steps):
    rows = steps[5].collect()
    assert len(rows) == steps[4].count() and all(r.roundtrip and r.parity for r in rows)


def test_run_gives_the_last_stage(spark, sf, steps):
    key = lambda df: sorted((r.doc_id, r.n_tokens) for r in df.select("doc_id", "n_tokens").collect())
    assert key(corpus_pipeline.run(spark, sf)) == key(steps[5])
