"""Terms of texts, vocabularies by document frequency, and the words that mark out sources."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presslens.functions.tokens import bound
from presslens.operators import matrix as M
from presslens.storage import materialize


def term_list(text: Column, sizes: Iterable[int] = (1, 2), stop: Iterable[str] = ()) -> Column:
    """All n-grams of the lower-cased words of letters; stop words are left out before the n-grams are made."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    stop = list(stop)
    kept = F.filter(words, lambda w: ~w.isin(*stop)) if stop else words

    def grams(w, n):
        if n == 1:
            return w
        at = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(w, i, n), " "))

    return bound(kept, lambda w: F.concat(*(grams(w, n) for n in sizes)))


def term_counts(docs: DataFrame, key: str, text: str, sizes: Iterable[int] = (1, 2), stop: Iterable[str] = ()) -> DataFrame:
    """``(key, term, tf)``; a null text has no terms."""
    return docs.select(key, F.explode(term_list(F.col(text), sizes, stop)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def vectorize(docs: DataFrame, key: str, text: str, sizes: Iterable[int] = (1, 2), min_df: int = 5, max_df: float = 0.85, stop: Iterable[str] = ()) -> DataFrame:
    """``(key, term, tf)`` of the terms in at least ``min_df`` documents and at most a share ``max_df`` of all with text."""
    counts = materialize(term_counts(docs, key, text, sizes, stop), "terms")  # read twice
    n = docs.where(F.col(text).isNotNull()).agg(F.count("*").alias("n"))
    kept = counts.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * n.scalar())).select("term")
    return counts.join(kept, "term", "left_semi").select(key, "term", "tf")


def bias_terms(counts: DataFrame, allowed: DataFrame, threshold: float = 0.5, strict_reference: bool = False) -> DataFrame:
    """Rows of ``counts(..., source, term, tf)`` whose term is in ``allowed(term)`` and not made redundant by a longer one.

    With ``strict_reference`` nothing is redundant, as the original's purge looked terms up where none are.
    """
    kept = counts.join(allowed.select("term").distinct(), "term", "left_semi")
    if strict_reference:
        return kept
    cells = kept.where("source is not null").groupBy("term", F.col("source").alias("domain")).agg(F.sum("tf").alias("n"))
    return kept.join(M.redundant(cells, threshold, "term"), "term", "left_anti")


def article_words(terms: DataFrame, key: str) -> DataFrame:
    """``(key, bias_words)``: the sorted terms of each article."""
    return terms.groupBy(key).agg(F.array_sort(F.collect_set("term")).alias("bias_words"))


def source_words(terms: DataFrame, ignored: Iterable[str] | DataFrame = ()) -> DataFrame:
    """``(source, word, n)`` without the ignored words, which need not occur."""
    counts = terms.where("source is not null").groupBy("source", F.col("term").alias("word")).agg(F.sum("tf").alias("n"))
    if isinstance(ignored, DataFrame):
        return counts.join(ignored.select(F.col(ignored.columns[0]).alias("word")), "word", "left_anti").select("source", "word", "n")
    ignored = list(ignored)
    return counts.where(~F.col("word").isin(*ignored)) if ignored else counts
