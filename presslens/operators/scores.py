"""Association scores over long matrices ``(row, domain, n)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _only(cells: DataFrame, row: str, only: DataFrame | None) -> DataFrame:
    """All cells, or those of the rows in ``only``."""
    return cells if only is None else cells.join(only.select(row), row, "left_semi")


def _shares(matrix: DataFrame, row: str, only: DataFrame | None = None) -> DataFrame:
    """Cells, of all rows or of those in ``only``, with the sums of their row, their domain and everything, as doubles.

    Row sums come from a window on the cells' own key; domain sums are one row a
    domain, joined. An empty matrix gives an empty result.
    """
    by_domain = matrix.groupBy("domain").agg(F.sum("n").cast("double").alias("col_sum"))
    everything = matrix.agg(F.sum("n").cast("double"))
    cells = _only(matrix, row, only).withColumn("row_sum", F.sum("n").over(Window.partitionBy(row)).cast("double"))
    return cells.join(by_domain, "domain").withColumn("all_sum", everything.scalar()).withColumn("n", F.col("n").cast("double"))


def pmi(matrix: DataFrame, row: str = "phrase") -> DataFrame:
    """``(row, domain, pmi)`` of every non-zero cell: log2 of observed over expected."""
    s = _shares(matrix.where("n > 0"), row)
    return s.select(row, "domain", F.log2(F.col("n") * F.col("all_sum") / (F.col("row_sum") * F.col("col_sum"))).alias("pmi"))


def require_nonzero(matrix: DataFrame) -> DataFrame:
    """The matrix itself; running it raises an error where all cells are zero."""
    total = matrix.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t"))
    return matrix.where(F.when(total.scalar() > 0, F.lit(True)).otherwise(F.raise_error(F.lit("the matrix has no counts")).cast("boolean")))


def mi(matrix: DataFrame, row: str = "phrase", only: DataFrame | None = None) -> DataFrame:
    """``(row, mi)``: what each row, or each in ``only``, adds to the mutual information; rows of zeros add nothing and score 0."""
    s = _shares(matrix, row, only)
    p = F.col("n") / F.col("all_sum")
    part = F.when(F.col("n") > 0, p * F.log2(F.col("n") * F.col("all_sum") / (F.col("row_sum") * F.col("col_sum")))).otherwise(0.0)
    return s.groupBy(row).agg(F.sum(part).alias("mi"))


def total_mi(matrix: DataFrame, row: str = "phrase") -> DataFrame:
    return mi(matrix, row).agg(F.sum("mi").alias("total_mi"))


def tf_idf(matrix: DataFrame, row: str = "phrase", only: DataFrame | None = None) -> DataFrame:
    """``(row, domain, tfidf)``, of all rows or of those in ``only``, with domains as documents: idf = ln((1 + N) / (1 + df)) + 1, unit length per domain."""
    n_domains = matrix.select("domain").distinct().agg(F.count("*").cast("double"))
    df = F.count("*").over(Window.partitionBy(row))
    w = matrix.where("n > 0").withColumn("w", F.col("n") * (F.ln((1 + n_domains.scalar()) / (1 + df)) + 1))
    norms = w.groupBy("domain").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return _only(w, row, only).join(norms, "domain").select(row, "domain", (F.col("w") / F.col("norm")).alias("tfidf"))


def max_tf_idf(matrix: DataFrame, row: str = "phrase", only: DataFrame | None = None) -> DataFrame:
    return tf_idf(matrix, row, only).groupBy(row).agg(F.max("tfidf").alias("max_tfidf"))


def class_tf_idf(counts: DataFrame, group: str, term: str = "term", bm25: bool = True, reduce_frequent: bool = True) -> DataFrame:
    """``(group, term, score)`` from counts ``(group, term, tf)``: term share of the class (its root, if frequent words are reduced) times idf.

    A = mean words of a class, f = total of the term; idf is ln(1 + (A - f + 0.5) / (f + 0.5)) with ``bm25``, else ln(1 + A / f).
    Sums of a class are one row a class, joined; a term has at most one row a class.
    """
    classes = counts.groupBy(group).agg(F.sum("tf").alias("w"))
    f = F.sum("tf").over(Window.partitionBy(term))
    share = F.col("tf") / F.col("w")
    share = F.sqrt(share) if reduce_frequent else share
    scored = counts.withColumn("f", f).join(classes, group).select(group, term, share.alias("share"), "f").withColumn("a", classes.agg(F.avg("w")).scalar())
    # 1 + (A - f + 0.5) / (f + 0.5), in one fraction
    idf = (F.col("a") + 1) / (F.col("f") + 0.5) if bm25 else 1 + F.col("a") / F.col("f")
    return scored.select(group, term, (F.col("share") * F.ln(idf)).alias("score"))
