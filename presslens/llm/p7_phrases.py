"""Frequency of every distinct phrase (problem 7).

Method: vertical layout. Articles get dense identifiers, in the order of their
sources; every phrase has a bitmap of the articles that contain it, compressed
to its words of 64 bits that are not zero, beside a counter of occurrences.
Bitmaps are merged by union (a bitwise or, before and after the shuffle), and
the number of articles is read from their cardinality. A word is a group of its
own, so a phrase that a third of all articles have is many small groups, and
one of few articles costs as many words.

Phrases are trimmed, inner blanks collapsed, lower-cased; phrases empty after
that are left out. Rows without url take no part; null and empty lists count as
articles without phrases; repeated rows of a url count once (the greatest list,
should they differ). Articles without source count for no source. Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.session import norm_source, table

SHUFFLED = "romanian_political_articles_v2_shuffled"
RARE_BELOW = 3
COMMON_SHARE = 20  # common: in more than one of COMMON_SHARE articles
WORD_BITS = 6


def numbered_articles(rows: DataFrame) -> DataFrame:
    """``(id, source, phrases)``; identifiers are dense within a partition and the same on every attempt of a task."""
    arts = rows.where("url is not null").groupBy("url").agg(F.max("all_ngrams").alias("all_ngrams"), F.max(norm_source(F.col("source_domain"))).alias("source"))
    return arts.sortWithinPartitions("source", "url").select(F.monotonically_increasing_id().alias("id"), "source", "all_ngrams")


def tidy(c):
    return F.lower(F.trim(F.regexp_replace(c, r"[\s\x1c-\x1f\x85\xA0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+", " ")))


def bitmap_words(arts: DataFrame) -> DataFrame:
    """``(ngram, source, word, occurrences, bits)``: the words of the bitmaps that are not zero, by source."""
    each = arts.select("id", "source", F.explode("all_ngrams").alias("raw")).select("id", "source", tidy(F.col("raw")).alias("ngram")).where("ngram <> ''")
    bit = F.expr(f"shiftleft(1L, cast(id & {(1 << WORD_BITS) - 1} as int))")
    return each.groupBy("ngram", "source", F.shiftright("id", WORD_BITS).alias("word")).agg(F.count("*").alias("occurrences"), F.bit_or(bit).alias("bits"))


def phrase_counts(rows: DataFrame) -> DataFrame:
    """``(ngram, occurrences, articles, sources, share, rare, common)`` of every distinct phrase."""
    arts = numbered_articles(rows)
    n = arts.where("size(all_ngrams) > 0").agg(F.count("*").alias("n"))
    by_source = bitmap_words(arts).groupBy("ngram", "source").agg(F.sum("occurrences").alias("o"), F.sum(F.bit_count("bits")).alias("a"))
    counts = by_source.groupBy("ngram").agg(F.sum("o").alias("occurrences"), F.sum("a").alias("articles"), F.count("source").alias("sources")).withColumn("n", n.scalar())
    return counts.select("ngram", "occurrences", "articles", "sources", (F.col("articles") < RARE_BELOW).alias("rare"), (F.col("articles") * COMMON_SHARE > F.col("n")).alias("common"))


def p7_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_counts(table(spark, sf_dir, SHUFFLED).select("url", "all_ngrams", "source_domain"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.array_compact(F.array(F.when(F.col("rare"), F.lit("rare")), F.when(F.col("common"), F.lit("common"))))
    return p7_terms(spark, sf_dir).select("ngram", F.explode(marks).alias("mark"))


_SQL = r"""
WITH a AS (SELECT url, max(all_ngrams) AS g, max(nullif(regexp_replace(lower(trim(source_domain)), '^www\.', ''), '')) AS s
  FROM romanian_political_articles_v2_shuffled WHERE url IS NOT NULL GROUP BY url),
e AS (SELECT url, s, lower(trim(regexp_replace(x, '[\s\x{85}\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) AS ngram FROM (SELECT url, s, unnest(g) AS x FROM a)),
c AS (SELECT ngram, count(*) AS occurrences, count(DISTINCT url) AS articles, count(DISTINCT s) AS sources FROM e WHERE ngram <> '' GROUP BY ngram),
m AS (SELECT *, articles < 3 AS rare, articles * 20 > (SELECT count(*) FROM a WHERE len(g) > 0) AS common FROM c)
"""

QUERIES = {"p7_found": p7_found, "p7_terms": p7_terms}
ORACLES = {
    "p7_found": _SQL + "SELECT ngram, 'rare' AS mark FROM m WHERE rare UNION ALL SELECT ngram, 'common' FROM m WHERE common",
    "p7_terms": _SQL + "SELECT * FROM m",
}
