"""Phrase-by-domain and entity-by-domain counts, in long form, and their pruning.

A matrix is a table ``(row, domain, n)`` without zero cells. Wide forms are made
at the edge only (``pivot_matrix``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presslens.functions import tokens as K
from presslens.session import spread


def phrase_matrix(docs: DataFrame, text: str, domain: str, stop=(), min_words: int = 30, sizes=(1, 2, 3), min_total: int = 0) -> DataFrame:
    """``(phrase, domain, n)``: documents of a domain that contain a phrase; texts of at most ``min_words`` words are left out.

    Rows without text or domain are left out; a phrase counts once a document.
    """
    kept = docs.select(F.col(text).alias("text"), F.col(domain).alias("domain")).na.drop().where(F.size(F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))) > min_words)
    kept = kept if kept.isStreaming else spread(kept)
    grams = kept.select("domain", F.explode(K.phrase_set(K.tokens(F.col("text")), sizes, stop)).alias("phrase"))
    cells = grams.groupBy("phrase", "domain").agg(F.count("*").alias("n"))
    if min_total:
        big = cells.groupBy("phrase").agg(F.sum("n").alias("t")).where(F.col("t") >= min_total).select("phrase")
        cells = cells.join(big, "phrase", "left_semi")
    return cells


def entity_matrix(articles: DataFrame, url: str = "url", domain: str = "source_domain", entities: str = "ner") -> DataFrame:
    """``(entity, domain, n)``: distinct articles of a domain that name an entity; rows with a null are dropped."""
    each = articles.select(F.col(url).alias("url"), F.col(domain).alias("domain"), F.explode(entities).alias("entity")).na.drop().dropDuplicates(["url", "domain", "entity"])
    return each.groupBy("entity", "domain").agg(F.count("*").alias("n"))


def totals(matrix: DataFrame, row: str) -> DataFrame:
    """Row sum, greatest cell and number of domains of each row."""
    return matrix.groupBy(row).agg(F.sum("n").alias("total"), F.max("n").alias("top"), F.count("*").alias("domains"))


def too_good(matrix: DataFrame, row: str = "phrase", threshold: float = 0.9) -> DataFrame:
    """Rows that one domain dominates, with ``dominance_ratio``."""
    return totals(matrix, row).select(row, "total", (F.col("top") / F.col("total")).alias("dominance_ratio")).where(F.col("dominance_ratio") > threshold)


def ubiquitous(matrix: DataFrame, width: DataFrame, row: str = "phrase", threshold: float = 0.9) -> DataFrame:
    """Rows in more than a share of the domains. ``width``: one row ``(width)``, the domains before any pruning."""
    t = totals(matrix, row)
    return t.select(row, "total", (F.col("domains") / width.scalar()).alias("phrase_ubiquity")).where(F.col("phrase_ubiquity") > threshold)


def domain_count(matrix: DataFrame) -> DataFrame:
    return matrix.select("domain").distinct().agg(F.count("*").alias("width"))


def sub_grams(c, longer: int, shorter: int):
    """The shorter n-grams inside a longer one."""
    w = F.split(c, " ")
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(longer - shorter + 1)), lambda i: F.array_join(F.slice(w, i, F.lit(shorter)), " ")))


def _compared(matrix: DataFrame, row: str, sizes=(1, 2, 3)) -> DataFrame:
    """``(row, total, top, domains, long_total)``: the sums of each row, and the greatest total of a longer one that contains it.

    One aggregation over the rows themselves and the sub-phrases of the longer
    ones: no pair is formed, and only sub-phrases are sent beside the rows.
    """
    nothing = F.lit(None).cast("bigint")
    size, parts = K.gram_size(F.col(row)), F.array().cast("array<string>")
    for longer in sizes:
        shorter = [s for s in sizes if s < longer]
        if shorter:
            parts = F.when(size == longer, F.concat(*(sub_grams(F.col(row), longer, s) for s in shorter))).otherwise(parts)
    own = F.struct(F.col(row).alias("_row"), "total", "top", "domains", nothing.alias("long_total"))
    held = F.transform(parts, lambda x: F.struct(x.alias("_row"), nothing.alias("total"), nothing.alias("top"), nothing.alias("domains"), F.col("total").alias("long_total")))
    own = totals(matrix, row).select(F.inline(F.concat(F.array(own), held))).withColumnRenamed("_row", row)
    merged = own.groupBy(row).agg(*(F.max(c).alias(c) for c in ("total", "top", "domains", "long_total")))
    return merged.where("total is not null")


def find_redundant(matrix: DataFrame, shorter: int, longer: int, threshold: float = 0.7, row: str = "phrase") -> DataFrame:
    """Shorter phrases of which one longer phrase that contains them has a share of ``threshold`` of the total."""
    c = _compared(matrix.where(K.gram_size(F.col(row)).isin(shorter, longer)), row, (shorter, longer))
    return c.where((K.gram_size(F.col(row)) == shorter) & (F.col("long_total") >= threshold * F.col("total"))).select(row)


def redundant(matrix: DataFrame, threshold: float = 0.7, row: str = "phrase") -> DataFrame:
    """Phrases made redundant by longer ones; all comparisons are against the same unpruned matrix, so nothing cascades."""
    return _compared(matrix, row).where(F.col("long_total") >= threshold * F.col("total")).select(row)


def prune(matrix: DataFrame, redundancy: float = 0.7, dominance: float = 0.9, ubiquity: float = 0.9, row: str = "phrase") -> DataFrame:
    """Without redundant, then dominated, then ubiquitous rows: whole rows are dropped, so all are told from the same sums."""
    width = domain_count(matrix)
    stays = F.coalesce(F.col("long_total") < redundancy * F.col("total"), F.lit(True)) & (F.col("top") / F.col("total") <= dominance) & (F.col("domains") / width.scalar() <= ubiquity)
    return matrix.join(_compared(matrix, row).where(stays).select(row), row, "left_semi")


def pivot_matrix(matrix: DataFrame, row: str, domains: list[str] | None = None) -> DataFrame:
    """Wide form with a column for each domain, zero-filled."""
    wide = matrix.groupBy(row).pivot("domain", domains).agg(F.first("n"))
    return wide.na.fill(0)


def unpivot_matrix(wide: DataFrame, row: str) -> DataFrame:
    """Long form of a wide matrix, without zero cells."""
    cols = [F.col(f"`{c}`") for c in wide.columns if c != row]
    return wide.unpivot([row], cols, "domain", "n").where("n > 0")
