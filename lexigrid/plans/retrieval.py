"""Queries on the collection: scans, index, retrieval, evaluation. Documents are the corpus, benchmark passages the topics; a document
is relevant to a passage that it contains. Ids are numbers here, so the descending order of ties is numeric."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize as words
from ..operators import evaluation, index, ranking, retrieval
from ..session import shared_dir, spread
from ..sources import collections

DEPTH = 1000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("title"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.tokenized(_docs(spark, sf_dir))


def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    files = pages.select(F.concat_ws("\n\n", "url", "html").alias("value"), F.concat(F.lit("/pages/"), F.lpad((F.col("page_id") % 100).cast("string"), 2, "0"), F.lit("/"), F.col("page_id").cast("string")).alias("path"))
    return collections.parse_corpus(files).select("docno", "shard", "url", F.length("body").alias("body_chars"), F.md5("body").alias("body_md5"))


CORPUS_SCAN = """
SELECT CAST(page_id AS VARCHAR) AS docno, lpad(CAST(page_id % 100 AS VARCHAR), 2, '0') AS shard, url,
  CAST(length(ltrim(html, chr(10))) AS INTEGER) AS body_chars, md5(ltrim(html, chr(10))) AS body_md5 FROM pages"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    shard = F.lpad((F.col("page_id") % 100).cast("string"), 2, "0")
    return _table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("docno"), shard.alias("shard"), "url", F.col("html").alias("body"))


def corpus_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as files in folders, written and read back: the same rows as corpus_scan."""
    folder = f"{shared_dir(spark)}/lexigrid/corpus-{uuid.uuid4().hex}"
    collections.write_corpus(_pages(spark, sf_dir), folder).count()
    return collections.read_corpus(spark, folder).select("docno", "shard", "url", F.length("body").alias("body_chars"), F.md5("body").alias("body_md5"))


def topics_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _topics(spark, sf_dir).select(F.concat_ws(" ", "qid", F.regexp_replace("title", "\n", " ")).alias("value"))
    return collections.parse_topics(lines)


def topics_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topics as a file, written and read back: the same rows as topics_scan."""
    path = f"{shared_dir(spark)}/lexigrid/topics-{uuid.uuid4().hex}"
    _topics(spark, sf_dir).select(F.concat_ws(" ", "qid", F.regexp_replace("title", "\n", " ")).alias("value")).write.text(path)
    return collections.read_topics(spark, path)


TOPICS_SCAN = "SELECT CAST(item_id AS VARCHAR) AS qid, trim(replace(text, chr(10), ' ')) AS title FROM benchmark"


def qrels_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    return collections.parse_qrels(labels.select(F.concat_ws(" ", F.col("doc_id") % 40, F.lit("0"), "doc_id", "quality").alias("value")))


QRELS_SCAN = "SELECT CAST(doc_id % 40 AS VARCHAR) AS qid, '0' AS iter, CAST(doc_id AS VARCHAR) AS docno, CAST(quality AS INTEGER) AS rel FROM labels"


def _formula_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run with many ties: topic and score follow from the id."""
    ids = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("docno"))
    return ids.select((F.col("docno") % 40).alias("qid"), "docno", (F.col("docno") * 7919 % 17 / F.lit(4.0)).alias("score"))


_RUN = "run AS (SELECT doc_id % 40 AS qid, doc_id AS docno, (doc_id * 7919 % 17) / CAST(4 AS DOUBLE) AS score FROM documents)"


def run_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collections.parse_run(collections.run_lines(ranking.rank(_formula_run(spark, sf_dir))))


RUN_SCAN = f"""WITH {_RUN} SELECT CAST(qid AS VARCHAR) AS qid, 'Q0' AS q0, CAST(docno AS VARCHAR) AS docno,
  CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno DESC) AS INTEGER) AS rank, score, 'lexigrid' AS tag FROM run"""


def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run as files, written and read back: the same rows as run_scan."""
    path = f"{shared_dir(spark)}/lexigrid/run-{uuid.uuid4().hex}"
    collections.write_run(ranking.rank(_formula_run(spark, sf_dir)), path)
    return collections.read_run(spark, path)


def run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collections.run_lines(ranking.rank(_formula_run(spark, sf_dir)))


RUN_LINES = f"SELECT concat_ws(' ', qid, q0, docno, rank, score, tag) AS value FROM ({RUN_SCAN})"


def run_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(_formula_run(spark, sf_dir))


RUN_RANK = f"WITH {_RUN} SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno DESC) AS INTEGER) AS rank FROM run"


def run_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(_formula_run(spark, sf_dir), depth=10)


RUN_TOPK = f"SELECT * FROM ({RUN_RANK}) WHERE rank <= 10"


def run_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    qrels = _table(spark, sf_dir, "labels").select((F.col("doc_id") % 40).alias("qid"), F.col("doc_id").alias("docno"), F.col("quality").cast("int").alias("rel"))
    return ranking.judged(_formula_run(spark, sf_dir), qrels)


RUN_JUDGED = f"""WITH {_RUN} SELECT qid, docno, score, CAST(coalesce(quality, 0) AS INTEGER) AS rel FROM run LEFT JOIN labels ON doc_id = docno"""


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("tokens_md5"))


_TOKENS = """tok AS (SELECT doc_id AS docno, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS tokens FROM documents)"""
TOKENIZE = f"WITH {_TOKENS} SELECT docno AS doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens, md5(coalesce(array_to_string(tokens, ' '), '')) AS tokens_md5 FROM tok"


def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(_tokens(spark, sf_dir))


_INDEX = f"{_TOKENS}, idx AS (SELECT term, docno, count(*) AS tf FROM (SELECT docno, unnest(tokens) AS term FROM tok) GROUP BY ALL)"
INVERTED_INDEX = f"WITH {_INDEX} SELECT * FROM idx"


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.term_statistics(index.postings(_tokens(spark, sf_dir)))


TERM_STATS = f"WITH {_INDEX} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM idx GROUP BY term"


def doc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.document_lengths(_tokens(spark, sf_dir))


DOC_LENGTH = f"WITH {_TOKENS} SELECT docno, CAST(len(tokens) AS BIGINT) AS length FROM tok"


def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(retrieval.bm25(_tokens(spark, sf_dir), _topics(spark, sf_dir)), DEPTH)


def retrieve_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bm25(spark, sf_dir)


_TERMS = """asked AS (
  SELECT qid, term, count(*) AS qtf FROM (
    SELECT item_id AS qid, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY ALL)"""
_RANKED = "SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docno DESC) AS INTEGER) AS rank FROM scored QUALIFY rank <= 1000"
_BM25 = f"""{_INDEX}, {_TERMS},
stats AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM tok),
dfs AS (SELECT term, count(*) AS df FROM idx GROUP BY term),
scored AS (
  SELECT qid, idx.docno, round(CAST(sum(CAST(floor(
    ln(1 + (n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * tf * CAST(2.2 AS DOUBLE)
    / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len(tokens) / avgdl)) * CAST(1e12 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)) AS DOUBLE) / CAST(1e12 AS DOUBLE), 6) AS score
  FROM idx JOIN asked USING (term) JOIN dfs USING (term) JOIN tok ON tok.docno = idx.docno CROSS JOIN stats GROUP BY qid, idx.docno),
run AS ({_RANKED})"""
RETRIEVE_BM25 = f"WITH {_BM25} SELECT * FROM run"


def retrieve_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(retrieval.tf_idf(_tokens(spark, sf_dir), _topics(spark, sf_dir)), DEPTH)


RETRIEVE_TFIDF = f"""WITH {_INDEX}, {_TERMS},
lengths AS (SELECT docno, CAST(len(tokens) AS BIGINT) AS n FROM tok),
words AS (SELECT qid, CAST(sum(qtf) AS BIGINT) AS n FROM asked GROUP BY qid),
idf AS (SELECT term, ln(CAST((SELECT count(*) FROM tok) AS DOUBLE) / count(*)) AS idf FROM idx GROUP BY term),
w AS (SELECT term, docno, tf * idf / n AS w FROM idx JOIN idf USING (term) JOIN lengths USING (docno)),
norms AS (SELECT docno, sqrt(CAST(sum(CAST(floor(w * w * CAST(1e15 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)) AS DOUBLE) / CAST(1e15 AS DOUBLE)) AS norm FROM w GROUP BY docno),
qw AS (SELECT qid, term, qtf * idf / n AS qw FROM asked JOIN idf USING (term) JOIN words USING (qid)),
qnorms AS (SELECT qid, sqrt(CAST(sum(CAST(floor(qw * qw * CAST(1e15 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)) AS DOUBLE) / CAST(1e15 AS DOUBLE)) AS qnorm FROM qw GROUP BY qid),
dots AS (SELECT qid, docno, CAST(sum(CAST(floor(w * qw * CAST(1e15 AS DOUBLE) + CAST(0.5 AS DOUBLE)) AS BIGINT)) AS DOUBLE) / CAST(1e15 AS DOUBLE) AS dot FROM w JOIN qw USING (term) GROUP BY qid, docno),
scored AS (SELECT qid, docno, round(dot / norm / qnorm, 6) AS score FROM dots JOIN norms USING (docno) JOIN qnorms USING (qid) WHERE norm > 0 AND qnorm > 0)
{_RANKED}"""


def retrieve_boolean_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.boolean(_tokens(spark, sf_dir), _topics(spark, sf_dir))


def retrieve_boolean_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.boolean(_tokens(spark, sf_dir), _topics(spark, sf_dir), all_terms=False)


RETRIEVE_OR = f"WITH {_INDEX}, {_TERMS} SELECT qid, docno, count(*) AS matched FROM idx JOIN asked USING (term) GROUP BY ALL"
RETRIEVE_AND = f"""WITH {_INDEX}, {_TERMS}, hits AS (SELECT qid, docno, count(*) AS matched FROM idx JOIN asked USING (term) GROUP BY ALL)
SELECT hits.* FROM hits JOIN (SELECT qid, count(*) AS wanted FROM asked GROUP BY qid) USING (qid) WHERE matched = wanted"""


def passage_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.containing(_docs(spark, sf_dir), _topics(spark, sf_dir))


_QRELS = "qrels AS (SELECT item_id AS qid, doc_id AS docno, 1 AS rel FROM documents JOIN benchmark ON contains(documents.text, benchmark.text))"
PASSAGE_JUDGMENTS = f"WITH {_QRELS} SELECT * FROM qrels"


def _per_query(spark: SparkSession, sf_dir: str, complete: bool = False) -> DataFrame:
    run = _bm25(spark, sf_dir).select("qid", "docno", "score")
    return evaluation.per_query(run, passage_judgments(spark, sf_dir), complete)


def trec_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = _per_query(spark, sf_dir)
    return measures.select("qid", *[F.round(m, 6).alias(m.lower()) for m in evaluation.METRICS])


def trec_per_query_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    measures = _per_query(spark, sf_dir, complete=True)
    return measures.select("qid", *[F.round(m, 6).alias(m.lower()) for m in evaluation.METRICS])


_EACH = f"""{_BM25}, {_QRELS},
nrel AS (SELECT qid, count(*) AS r FROM qrels GROUP BY qid),
marked AS (SELECT run.qid, rank, r, CASE WHEN rel > 0 THEN 1 ELSE 0 END AS hit FROM run JOIN nrel USING (qid) LEFT JOIN qrels ON qrels.qid = run.qid AND qrels.docno = run.docno),
counted AS (SELECT *, sum(hit) OVER (PARTITION BY qid ORDER BY rank) AS hits FROM marked),
each AS (SELECT qid,
  sum(CASE WHEN hit = 1 THEN CAST(hits AS DOUBLE) / rank ELSE 0 END) / max(r) AS map,
  CAST(sum(CASE WHEN rank <= r THEN hit ELSE 0 END) AS DOUBLE) / max(r) AS rprec,
  coalesce(CAST(1 AS DOUBLE) / min(CASE WHEN hit = 1 THEN rank END), 0) AS recip_rank,
  CAST(sum(CASE WHEN rank <= 5 THEN hit ELSE 0 END) AS DOUBLE) / 5 AS p_5,
  CAST(sum(CASE WHEN rank <= 10 THEN hit ELSE 0 END) AS DOUBLE) / 10 AS p_10,
  CAST(sum(CASE WHEN rank <= 20 THEN hit ELSE 0 END) AS DOUBLE) / 20 AS p_20
  FROM counted GROUP BY qid)"""
_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in ("map", "rprec", "recip_rank", "p_5", "p_10", "p_20"))
TREC_PER_QUERY = f"WITH {_EACH} SELECT qid, {_ROUNDED} FROM each"
_ZEROS = ", ".join(f"round(coalesce({m}, 0), 6) AS {m}" for m in ("map", "rprec", "recip_rank", "p_5", "p_10", "p_20"))
TREC_PER_QUERY_COMPLETE = f"WITH {_EACH} SELECT nrel.qid, {_ZEROS} FROM nrel LEFT JOIN each USING (qid)"


def trec_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six means. The flagship: tokenize, index, score, rank, judge, measure."""
    each = evaluation.long_form(_per_query(spark, sf_dir))
    return each.groupBy("metric").agg(F.round(F.avg("value"), 6).alias("value"))


def trec_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report as it is printed."""
    means = evaluation.long_form(_per_query(spark, sf_dir)).groupBy("metric").agg(F.avg("value").alias("value"))
    return evaluation.report(means.withColumn("qid", F.lit("all"))).select("nth", "metric", "line")


_MEANS = " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m.lower()}), 6) AS value FROM each" for m in evaluation.METRICS)
TREC_REPORT = f"WITH {_EACH} {_MEANS}"


_LINES = " UNION ALL ".join(f"SELECT CAST({k} AS BIGINT) AS nth, '{m}' AS metric, printf('%s: %.4f', '{m}', avg({m.lower()})) AS line FROM each" for k, m in enumerate(evaluation.METRICS, 1))
TREC_REPORT_LINES = f"WITH {_EACH} {_LINES}"


def _single(metric: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _per_query(spark, sf_dir).agg(F.round(F.avg(metric), 6).alias("value"))

    return query


_KEYS = {"trec_map": "map", "trec_rprec": "Rprec", "trec_recip_rank": "recip_rank", "trec_p5": "P_5", "trec_p10": "P_10", "trec_p20": "P_20"}

QUERIES = {
    "corpus_scan": corpus_scan,
    "corpus_files": corpus_files,
    "topics_scan": topics_scan,
    "topics_files": topics_files,
    "qrels_scan": qrels_scan,
    "run_scan": run_scan,
    "run_files": run_files,
    "run_lines": run_lines,
    "run_rank": run_rank,
    "run_topk": run_topk,
    "run_judged": run_judged,
    "tokenize": tokenize,
    "inverted_index": inverted_index,
    "term_stats": term_stats,
    "doc_length": doc_length,
    "retrieve_bm25": retrieve_bm25,
    "retrieve_tfidf": retrieve_tfidf,
    "retrieve_boolean_and": retrieve_boolean_and,
    "retrieve_boolean_or": retrieve_boolean_or,
    "passage_judgments": passage_judgments,
    "trec_report": trec_report,
    "trec_report_lines": trec_report_lines,
    "trec_per_query": trec_per_query,
    "trec_per_query_complete": trec_per_query_complete,
    **{key: _single(m) for key, m in _KEYS.items()},
}

ORACLE_SQL = {
    "corpus_scan": CORPUS_SCAN,
    "corpus_files": CORPUS_SCAN,
    "topics_scan": TOPICS_SCAN,
    "topics_files": TOPICS_SCAN,
    "qrels_scan": QRELS_SCAN,
    "run_scan": RUN_SCAN,
    "run_files": RUN_SCAN,
    "run_lines": RUN_LINES,
    "run_rank": RUN_RANK,
    "run_topk": RUN_TOPK,
    "run_judged": RUN_JUDGED,
    "tokenize": TOKENIZE,
    "inverted_index": INVERTED_INDEX,
    "term_stats": TERM_STATS,
    "doc_length": DOC_LENGTH,
    "retrieve_bm25": RETRIEVE_BM25,
    "retrieve_tfidf": RETRIEVE_TFIDF,
    "retrieve_boolean_and": RETRIEVE_AND,
    "retrieve_boolean_or": RETRIEVE_OR,
    "passage_judgments": PASSAGE_JUDGMENTS,
    "trec_report": TREC_REPORT,
    "trec_report_lines": TREC_REPORT_LINES,
    "trec_per_query": TREC_PER_QUERY,
    "trec_per_query_complete": TREC_PER_QUERY_COMPLETE,
    **{key: f"WITH {_EACH} SELECT round(avg({m.lower()}), 6) AS value FROM each" for key, m in _KEYS.items()},
}
