from lexigrid.operators import index, ranking, retrieval
from lexigrid.sources import collections


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_topics_are_cut_at_the_first_space(spark):
    found = collections.parse_topics(lines(spark, "19 Rivers, lakes, and drinking water", "04 a\\/b", "", "7"), unescape=True).collect()
    assert [tuple(r) for r in found] == [("19", "Rivers, lakes, and drinking water"), ("04", "a/b"), ("7", "")]


def test_qrels_and_runs(spark):
    assert [tuple(r) for r in collections.parse_qrels(lines(spark, " 1\t0  d1 2", "", "1 0 d2")).collect()] == [("1", "0", "d1", 2), ("1", "0", "d2", None)]
    (row,) = collections.parse_run(lines(spark, "1 Q0 d 3 0.5 tag")).collect()
    assert tuple(row) == ("1", "Q0", "d", 3, 0.5, "tag")


def test_corpus_files_round_trip(spark, tmp_path):
    for shard, name, text in (("00", "D-00-1", "http://x\n\nbody\n\nmore\n"), ("01", "D-01-2", "http://y"), ("01", "D-01-3", "http://z\n\n")):
        (tmp_path / shard).mkdir(exist_ok=True)
        (tmp_path / shard / name).write_text(text)
    found = {r["docno"]: tuple(r) for r in collections.read_corpus(spark, str(tmp_path)).collect()}
    assert found == {
        "D-00-1": ("D-00-1", "00", "http://x", "body\n\nmore\n"),
        "D-01-2": ("D-01-2", "01", "http://y", ""),
        "D-01-3": ("D-01-3", "01", "http://z", ""),
    }


def test_run_files_round_trip(spark, tmp_path):
    run = spark.createDataFrame([("1", "d", 1, 0.5), ("1", "e", 2, 0.25)], "qid string, docno string, rank int, score double")
    collections.write_run(run, str(tmp_path / "run"))
    back = collections.read_run(spark, str(tmp_path / "run")).orderBy("rank").collect()
    assert [(r["qid"], r["docno"], r["rank"], r["score"]) for r in back] == [tuple(r) for r in run.collect()]


def test_a_corpus_of_files(spark, tmp_path):
    rows = [("D-01-1", "01", "http://a", "one\n\ntwo"), ("D-01-2", "01", "http://b", ""), ("D-07-1", "07", "http://c", "\u00e9 x")]
    docs = spark.createDataFrame(rows, "docno string, shard string, url string, body string")
    for _ in range(2):  # overwrites
        assert collections.write_corpus(docs, str(tmp_path / "docs")).count() == 3
    assert sorted(map(tuple, collections.read_corpus(spark, str(tmp_path / "docs")).collect())) == rows


def test_a_collection_from_files_to_a_ranking(spark, tmp_path):
    """Documents and topics are read from files, indexed and ranked; equal texts have equal scores, the larger id first."""
    texts = {"D-01-1": "mining of gold and coal", "D-01-2": "gold mining gold mining", "D-02-7": "gold mining gold mining", "D-02-9": "cake", "D-03-1": ""}
    rows = [(name, name[2:4], f"http://{name}", text) for name, text in texts.items()]
    collections.write_corpus(spark.createDataFrame(rows, "docno string, shard string, url string, body string"), str(tmp_path / "docs")).count()
    (tmp_path / "topics").write_text("1 mining gold\n\n2 cake\\/pie\n3 none of these\n")
    docs = collections.read_corpus(spark, str(tmp_path / "docs"))
    topics = collections.read_topics(spark, str(tmp_path / "topics"), unescape=True)
    assert sorted(map(tuple, topics.collect())) == [("1", "mining gold"), ("2", "cake/pie"), ("3", "none of these")]
    run = ranking.rank(retrieval.bm25(index.tokenized(docs, "docno", "body"), topics)).collect()
    got = {(r["qid"], r["rank"]): r["docno"] for r in run}
    assert got == {("1", 1): "D-02-7", ("1", 2): "D-01-2", ("1", 3): "D-01-1", ("2", 1): "D-02-9", ("3", 1): "D-01-1"}
    assert len({r["score"] for r in run if r["docno"] in ("D-02-7", "D-01-2")}) == 1


def test_ranking_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    topics = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").selectExpr("item_id qid", "text title")
    runs = [sorted(map(tuple, retrieval.bm25(index.tokenized(d), topics).collect())) for d in (docs.repartition(7), docs.coalesce(1))]
    assert runs[0] == runs[1]


def test_passages_with_few_words_and_case(spark):
    docs = spark.createDataFrame([(1, "say one two three four five now"), (2, "x one two THREE four five"), (3, "one"), (4, None), (5, "one two three four fiver")], "doc_id long, text string")
    topics = spark.createDataFrame([(1, "one two three four five"), (2, "one")], "qid long, title string")
    found = {(r["qid"], r["docno"]) for r in retrieval.containing(docs, topics).collect()}
    assert found == {(1, 1), (1, 5), (2, 1), (2, 2), (2, 3), (2, 5)}
