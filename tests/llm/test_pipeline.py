import corpus_pipeline
from lexigrid.llm._base import stored
from tests.llm.test_line_dedup import slow as slow_lines
from tests.llm.test_simhash import expect
from tests.llm.test_tokens import check_packed

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, small):
    docs, columns = small, small.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, SMALL), name)
        after = docs.collect()
        if name == "language_id":
            assert {tuple(r) for r in after} <= {tuple(r) for r in before} and len(after) >= 0.97 * len(before)
        elif name == "line_dedup":
            want = slow_lines([(r.doc_id, r.text) for r in before])
            assert sorted(((r.doc_id, r.text, r.n_chars) for r in after), key=str) == sorted(((i, t, len(t)) for i, t, _, _ in want), key=str)
        elif name == "simhash_dedup":
            heads = {c for _, _, c in expect([(r.doc_id, r.text) for r in before])}
            assert sorted(r.doc_id for r in after) == sorted(heads)
        elif name == "source_mix":
            assert {tuple(r) for r in after} <= {tuple(r) for r in before}
            n = sum(len((r.text or "").split()) for r in before)
            assert abs(sum(len(r.text.split()) for r in after) - 1.5 * n) < 0.02 * n
        else:
            check_packed(after)
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
        assert name == "packing" or docs.columns == columns


def test_odd_rows_and_no_rows(spark, odd, empty):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stored(stage(spark, docs, SMALL), name)
            assert name == "packing" or docs.columns == columns
    assert corpus_pipeline.run(spark, SMALL).count()
