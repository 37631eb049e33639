"""Ad-hoc retrieval. Topics (qid, title) are a stated query set; documents are tokenized once, cut down to the topics' words before
anything moves, and then moved once, to be summed where they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..session import kept, small
from .index import collection_statistics, postings_by_document, term_statistics

#: Sums are of whole multiples of a small unit, so that the order of summing does not show; scores are rounded before they are ranked.
BM25_UNIT, COSINE_UNIT, _PLACES = 1e12, 1e15, 6


def _units(value: Column, unit: float) -> Column:
    return F.floor(value * F.lit(unit) + F.lit(0.5))


def topic_terms(topics: DataFrame) -> DataFrame:
    """(qid, term, qtf)."""
    return topics.select("qid", F.explode(tokenize(F.col("title"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def bm25(tokens: DataFrame, topics: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, docno, score) of all documents with a word of the topic (Robertson and Zaragoza, 2009); each word of a topic counts once."""
    terms = topic_terms(topics)
    index = kept(postings_by_document(tokens, terms))
    facts = collection_statistics(tokens)  # one row
    weighted = terms.join(term_statistics(index), "term").join(F.broadcast(facts)).select("qid", "term", "avg_length", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    gain = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc.length") / F.col("avg_length")))
    found = index.join(small(weighted), "term").groupBy("qid", "doc").agg(F.sum(_units(gain, BM25_UNIT)).alias("units"))
    return found.select("qid", "doc.docno", F.round(F.col("units") / F.lit(BM25_UNIT), _PLACES).alias("score"))


def tf_idf(tokens: DataFrame, topics: DataFrame) -> DataFrame:
    """(qid, docno, score): cosine of tf * ln(N / df) vectors of documents and topics, for documents with a word of the topic.

    A document's norm takes all its words, so the whole vocabulary's document frequencies are counted. Vectors are divided by the number
    of words first, which leaves the cosine and bounds the sums.
    """
    n_docs = collection_statistics(tokens).select("n_docs")
    index = kept(postings_by_document(tokens))
    idf = kept(term_statistics(index).join(F.broadcast(n_docs)).select("term", F.log(F.col("n_docs") / F.col("df")).alias("idf")))
    weights = index.join(idf, "term").select("doc", "term", (F.col("tf") * F.col("idf") / F.col("doc.length")).alias("w"))
    words = F.size(tokenize(F.col("title")))
    asked = topic_terms(topics).join(topics.select("qid", words.alias("words")).groupBy("qid").agg(F.sum("words").alias("words")), "qid")
    asked = asked.join(idf, "term").select("qid", "term", (F.col("qtf") * F.col("idf") / F.col("words")).alias("qw"))
    square = lambda c: F.sqrt(F.sum(_units(F.col(c) * F.col(c), COSINE_UNIT)) / F.lit(COSINE_UNIT))
    norms = weights.groupBy("doc").agg(square("w").alias("norm"))
    asked_norms = asked.groupBy("qid").agg(square("qw").alias("qnorm"))
    dots = weights.join(small(asked), "term").groupBy("qid", "doc").agg((F.sum(_units(F.col("w") * F.col("qw"), COSINE_UNIT)) / F.lit(COSINE_UNIT)).alias("dot"))
    scored = dots.join(norms, "doc").join(small(asked_norms), "qid")
    return scored.where((F.col("norm") > 0) & (F.col("qnorm") > 0)).select("qid", "doc.docno", F.round(F.col("dot") / F.col("norm") / F.col("qnorm"), _PLACES).alias("score"))


def boolean(tokens: DataFrame, topics: DataFrame, all_terms: bool = True) -> DataFrame:
    """(qid, docno, matched): documents with all of the topic's different words, or with any; matched is how many they have."""
    terms = topic_terms(topics).select("qid", "term")
    wanted = terms.groupBy("qid").agg(F.count("*").alias("wanted"))
    hits = postings_by_document(tokens, terms).join(small(terms), "term").groupBy("qid", "doc").agg(F.count("*").alias("matched"))
    hits = hits.select("qid", "doc.docno", "matched")
    return hits.join(small(wanted), "qid").where(F.col("matched") == F.col("wanted")).drop("wanted") if all_terms else hits


def containing(docs: DataFrame, topics: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Judgments (qid, docno, rel = 1) for the documents whose text contains the topic's whole text.

    Not every pair is looked at: a text that contains another has its inner words in a row, so the second to fourth word of a topic are
    joined, by a hash, with the documents' runs of three words. Only ids go through this join; what meets there gets its text back and
    is compared outright. Topics of fewer than five words, which have no such run, are compared with all documents.
    """
    words = tokenize(F.col("title"))
    asked = topics.select("qid", "title", F.when(F.size(words) >= 5, F.xxhash64(words[1], words[2], words[3])).alias("anchor"))
    long, short = asked.where(F.col("anchor").isNotNull()), asked.where(F.col("anchor").isNull())
    texts = docs.select(F.col(id_col).alias("docno"), F.col(text_col).alias("text"))
    tokens = texts.select("docno", tokenize(F.col("text")).alias("w")).where(F.size("w") >= 3)
    runs = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get(F.col("w"), i), F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2)))
    met = tokens.select("docno", F.explode(runs).alias("anchor")).join(small(long.select("qid", "title", "anchor")), "anchor")
    both = texts.join(kept(met.select("qid", "docno", "title").distinct()), "docno").select("qid", "docno", "text", "title")
    if not short.isEmpty():
        both = both.unionByName(texts.crossJoin(short).select("qid", "docno", "text", "title"))  # a stated query set, few words each
    return both.where(F.contains("text", "title")).select("qid", "docno", F.lit(1).alias("rel")).distinct()
