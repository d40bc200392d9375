"""Sparse vectors and their inverted index: token counts, weighted by how rare a token is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sparse_tokens
from .ids import spread
from .lexical import sparse_vectors, top_k, vocabulary
from .scan import scan_topk


@dataclass
class SparseIndex:
    """postings(doc, tok, tf) and idf(tok, df, idf), both by token.

    With ``tokens`` (doc, toks), one row for each document, few queries are scored by a scan.
    """

    postings: DataFrame
    idf: DataFrame
    tokens: DataFrame | None = None


def build_sparse_index(docs: DataFrame, id_col: str, text_col: str = "text", settle=lambda df: df) -> SparseIndex:
    """The inverted index of all documents; ``settle`` writes the postings, so that texts are tokenised once.

    A token in n of N documents weighs ln(1 + (N - n + 0.5) / (n + 0.5)).
    """
    postings = settle(sparse_vectors(docs, id_col, text_col).select("doc", "tok", "tf"))
    n = docs.where(F.col(id_col).isNotNull()).agg(F.count(F.lit(1)).alias("n")).scalar()
    df = F.col("df")
    idf = postings.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).select("tok", "df", F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("idf"))
    return SparseIndex(postings, idf)


def scanned_sparse_index(docs: DataFrame, id_col: str, text_col: str = "text", settle=lambda df: df) -> SparseIndex:
    """The index over documents of one row each, of which only the vocabulary is written, by ``settle``."""
    tokens = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("doc"), sparse_tokens(text_col).alias("toks"))
    counts = settle(vocabulary(tokens))
    # documents without an id don't count
    n = docs.where(F.col(id_col).isNotNull()).agg(F.count(F.lit(1)).alias("n")).scalar()
    df = F.col("df")
    idf = counts.where("tok is not null").select("tok", "df", F.log(1 + (n - df + 0.5) / (df + 0.5)).alias("idf"))
    return SparseIndex(sparse_vectors(docs, id_col, text_col).select("doc", "tok", "tf"), idf, tokens)


def _wanted(index: SparseIndex, queries: DataFrame) -> DataFrame:
    asked = sparse_vectors(queries, "q_id", "query").select(F.col("doc").alias("q_id"), "tok", F.col("tf").alias("times"))
    return asked.join(index.idf.select("tok", "idf"), "tok")


def sparse_scores(index: SparseIndex, queries: DataFrame) -> DataFrame:
    """q_id, doc, score: the inner product of (q_id, query)'s token counts with each document's, tokens weighted."""
    wanted = _wanted(index, queries)
    product = F.sum(F.col("times") * F.col("idf") * F.col("tf"))
    return index.postings.join(wanted, "tok").groupBy("q_id", "doc").agg(F.round(product, 6).alias("score"))


def sparse_topk(index: SparseIndex, queries: DataFrame, k: int = 50) -> DataFrame:
    if index.tokens is not None:
        wanted = _wanted(index, queries).select("q_id", "tok", (F.col("times") * F.col("idf")).alias("weight"))
        found = scan_topk(index.tokens, wanted, k, lambda tf, dl: tf.astype(float))
        if found is not None:
            return top_k(found, k, "doc")
    return top_k(sparse_scores(index, queries), k, "doc")
