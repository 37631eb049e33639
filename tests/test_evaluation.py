from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lexigrid.operators import evaluation, ranking

RUN, QRELS = "qid string, docno string, score double", "qid string, docno string, rel int"


def measures(spark, run, qrels, **kw):
    rows = evaluation.per_query(spark.createDataFrame(run, RUN), spark.createDataFrame(qrels, QRELS), **kw).collect()
    return {r["qid"]: r.asDict() for r in rows}


def ranked(*docs):
    return [("q", d, float(-k)) for k, d in enumerate(docs)]


def test_average_precision(spark):
    found = measures(spark, ranked("a", "x", "b"), [("q", "a", 1), ("q", "b", 1), ("q", "x", 0)])["q"]
    assert found["map"] == pytest.approx((1 + 2 / 3) / 2)
    assert found["Rprec"] == 0.5 and found["recip_rank"] == 1.0


def test_relevant_document_that_is_not_found(spark):
    assert measures(spark, ranked("x", "a"), [("q", "a", 1), ("q", "b", 2)])["q"]["map"] == pytest.approx(0.25)


def test_short_run_keeps_the_denominator(spark):
    found = measures(spark, ranked("x", "a", "y"), [("q", "a", 1)])["q"]
    assert [found[m] for m in ("P_5", "P_10", "P_20")] == pytest.approx([0.2, 0.1, 0.05])


def test_nothing_relevant_found(spark):
    found = measures(spark, ranked("x", "y"), [("q", "a", 1)])["q"]
    assert all(found[m] == 0 for m in evaluation.METRICS)


def test_population(spark):
    run = [("both", "a", 1.0), ("run only", "a", 1.0)]
    qrels = [("both", "a", 1), ("qrels only", "a", 1), ("no relevant", "a", 0)]
    assert measures(spark, run, qrels).keys() == {"both"}
    complete = measures(spark, run, qrels, complete=True)
    assert complete.keys() == {"both", "qrels only"} and complete["qrels only"]["map"] == 0


def test_ties_go_to_the_larger_id_and_ranks_in_the_run_are_ignored(spark):
    run = spark.createDataFrame([("q", "a", 1.0, 1), ("q", "b", 1.0, 2), ("q", "c", 2.0, 3)], RUN + ", rank int")
    assert [r["docno"] for r in ranking.rank(run).orderBy("rank").collect()] == ["c", "b", "a"]
    assert ranking.rank(run, depth=1).count() == 1


def test_means_and_report(spark):
    run = spark.createDataFrame([("p", "a", 1.0), ("q", "x", 1.0)], RUN)
    qrels = spark.createDataFrame([("p", "a", 1), ("q", "a", 1)], QRELS)
    found = {(r["metric"], r["qid"]): r["value"] for r in evaluation.evaluate(run, qrels, by_query=True).collect()}
    assert found["map", "p"] == 1 and found["map", "q"] == 0 and found["map", "all"] == 0.5
    lines = [r["line"] for r in evaluation.report(evaluation.evaluate(run, qrels)).orderBy("nth").collect()]
    assert lines == ["map: 0.5000", "Rprec: 0.5000", "recip_rank: 0.5000", "P_5: 0.1000", "P_10: 0.0500", "P_20: 0.0250"]


def by_hand(run, qrels):
    out, relevant = {}, defaultdict(set)
    for q, d, rel in qrels:
        if rel > 0:
            relevant[q].add(d)
    for q in {q for q, _, _ in run} & relevant.keys():
        docs = [d for _, d in sorted(((s, d) for p, d, s in run if p == q), reverse=True)]
        hits = [d in relevant[q] for d in docs]
        n = len(relevant[q])
        out[q] = {
            "map": sum(sum(hits[: k + 1]) / (k + 1) for k, h in enumerate(hits) if h) / n,
            "Rprec": sum(hits[:n]) / n,
            "recip_rank": 1 / (hits.index(True) + 1) if any(hits) else 0.0,
            **{f"P_{k}": sum(hits[:k]) / k for k in (5, 10, 20)},
        }
    return out


PAIRS = st.lists(st.tuples(st.sampled_from("pqr"), st.sampled_from([f"d{k}" for k in range(12)])), unique=True, min_size=1)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(PAIRS, PAIRS, st.randoms())
def test_any_run(spark, run, qrels, random):
    run = [(q, d, float(random.randint(0, 3))) for q, d in run]
    qrels = [(q, d, random.randint(0, 2)) for q, d in qrels]
    found, want = measures(spark, run, qrels), by_hand(run, qrels)
    assert found.keys() == want.keys()
    for q in want:
        assert {m: found[q][m] for m in evaluation.METRICS} == pytest.approx(want[q])
        assert all(0 <= found[q][m] <= 1 for m in evaluation.METRICS)
