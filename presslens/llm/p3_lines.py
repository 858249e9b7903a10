"""Lines repeated across one source's articles (problem 3).

Method: every line is folded and masked (numbers and dates to one token, runs
of capitalised words to another), lines are clustered within each source by
locality-sensitive hashing (min-hash bands over the masked words), clusters
with a high document frequency are kept (a line counts there with all its spellings,
however they are masked), and an exact check on the letters of
each line follows: a line counts as repeated if at least ``MIN_ARTICLES``
articles of its source and at least a twentieth of them have it.

Nulls: rows without url or maintext take no part; a url without any source has
no repeated lines. An empty text has one line without letters, which never
counts. Repeated rows of a url count once. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presslens.llm import textvec as tv
from presslens.session import norm_source, table
from presslens.storage import materialize

SHUFFLED = "romanian_political_articles_v2_shuffled"
MIN_ARTICLES = 5
SHARE = 20  # a line is in at least one of SHARE articles
BANDS, ROWS = 2, 2

# Romanian month names, folded.
MONTHS = "ianuarie februarie martie aprilie mai iunie iulie august septembrie octombrie noiembrie decembrie".split()


def _word_hash(w: str) -> int:
    f = np.array([ord(c) for c in w], np.int32)
    return int(tv.words_of(f, np.array([0, len(f)]))[0][0])


_month_hashes = np.array(sorted(_word_hash(m) for m in MONTHS), np.uint64)
_upper = tv._Lazy(np.int8, lambda c: int(chr(c).isupper() or chr(c).istitle()))
_NUMBER, _NAME = np.uint64(1), np.uint64(2)


def line_bounds(folded: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every line; a row has one line more than line feeds."""
    feeds = np.flatnonzero(folded == 10)
    row_of_feed = np.searchsorted(offsets, feeds, side="right") - 1
    starts = np.concatenate([offsets[:-1], feeds + 1])
    rows = np.concatenate([np.arange(len(offsets) - 1), row_of_feed])
    ends = np.concatenate([offsets[1:], feeds])
    order = np.lexsort((starts, rows))
    starts, rows = starts[order], rows[order]
    ends = np.sort(ends)
    return starts, ends, rows


def line_keys(folded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the letters of each line; 0 where a line has none."""
    letter = tv.kinds(folded) == 1
    upto = np.concatenate([[0], np.cumsum(letter)])
    first, last = upto[starts], upto[ends]
    some = last > first
    keys = np.zeros(len(starts), np.uint64)
    keys[some] = tv.run_hashes(folded[letter], first[some], (last - first)[some]) | np.uint64(1)
    return keys


def line_bands(codes, offsets, starts, ends) -> np.ndarray:
    """LSH bands of the masked words of each line, and a hash of the masked line itself (masks that follow each other count as one), as (lines, BANDS + 1) of 32 bits."""
    folded, fo, upper = fold_with_upper(codes, offsets)
    words, row, ws, _ = tv.words_of(folded, fo)
    out = np.zeros((len(starts), BANDS + 1), np.uint32)
    if len(words) == 0:
        return out
    masked = words.copy()
    number = tv.kinds(folded[ws]) == 2
    month = _month_hashes[np.minimum(np.searchsorted(_month_hashes, words), len(_month_hashes) - 1)] == words
    masked[number | month] = _NUMBER
    line = np.searchsorted(starts, ws, side="right") - 1
    opening = np.concatenate([[True], line[1:] != line[:-1]])
    masked[upper[ws] & ~opening & ~(number | month)] = _NAME
    first = np.flatnonzero(opening)
    values = []
    with np.errstate(over="ignore"):
        for k in range(BANDS * ROWS):
            values.append(np.minimum.reduceat(tv.mix(masked * np.uint64(2 * k + 3) + np.uint64(0x51ED270B * (k + 1))), first))
        for b in range(BANDS):
            h = values[b * ROWS]
            for v in values[b * ROWS + 1 : (b + 1) * ROWS]:
                h = tv.mix(h * np.uint64(31) + v)
            out[line[first], b] = (h >> np.uint64(32)).astype(np.uint32)
        new = opening.copy()
        new[1:] |= masked[1:] != masked[:-1]
        begin = np.flatnonzero(opening[new])
        whole = tv.run_hashes(masked[new], begin, np.diff(np.append(begin, new.sum())))
        out[line[first], BANDS] = (whole >> np.uint64(32)).astype(np.uint32)
    return out


def fold_with_upper(codes, offsets):
    """Folded text with a flag on characters that were capitals."""
    folded, fo = tv.fold_codes(codes, offsets)
    if len(folded) == len(codes):
        return folded, fo, _upper(codes) == 1
    f = tv._fold(codes)
    n = np.where(f > 0, 1, 0)
    many = np.flatnonzero(f == tv._MANY)
    n[many] = [len(tv._many[int(c)]) for c in codes[many]]
    return folded, fo, np.repeat(_upper(codes) == 1, n)


def _scan_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(2)
        for b, e in tv.chunks(text):
            part = text.slice(b, e - b)
            codes, offsets = tv.codes_of(part)
            folded, fo = tv.fold_codes(codes, offsets)
            starts, ends, rows = line_bounds(folded, fo)
            keys = line_keys(folded, starts, ends)
            bands = line_bands(codes, offsets, starts, ends)
            at = pa.array(np.searchsorted(rows, np.arange(len(part) + 1)).astype(np.int32))
            lines = pa.StructArray.from_arrays(
                [pa.array(keys.view(np.int64)), *(pa.array(bands[:, k].copy().view(np.int32)) for k in range(BANDS + 1))], ["key", *(f"band{k}" for k in range(BANDS)), "mask"]
            )
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(b, e - b), batch.column(1).slice(b, e - b), pa.ListArray.from_arrays(at, lines)], ["url", "source", "lines"])


LINE = "struct<key: bigint, " + ", ".join(f"band{k}: int" for k in range(BANDS)) + ", mask: int>"


def article_lines(rows: DataFrame, url: str = "url", text: str = "maintext", source: str = "source_domain") -> DataFrame:
    """``(url, source, lines)``: one row per article with text; its lines as keys and LSH bands."""
    src = rows.where(F.col(url).isNotNull() & F.col(text).isNotNull()).select(F.col(url).alias("url"), norm_source(F.col(source)).alias("source"), F.col(text).alias("maintext"))
    scanned = src.mapInArrow(_scan_lines, f"url string, source string, lines array<{LINE}>")
    # a source may stand on a row of the url that lacks the text
    named = rows.where(F.col(url).isNotNull() & F.col(text).isNull()).select(F.col(url).alias("url"), norm_source(F.col(source)).alias("source"), F.lit(None).cast(f"array<{LINE}>").alias("lines"))
    return scanned.unionByName(named).groupBy("url").agg(F.max("source").alias("source"), F.max("lines").alias("lines")).where("lines is not null")


def repeated_keys(arts: DataFrame) -> DataFrame:
    """``(source, key, articles)``: the line keys repeated in each source, found through LSH clusters."""
    sourced = arts.where("source is not null")
    totals = sourced.groupBy("source").agg(F.count("*").alias("total"))
    lines = sourced.select("source", "url", F.explode("lines").alias("l")).where("l.key <> 0").select("source", "url", "l.*")
    kinds = lines.groupBy("source", "key", *(f"band{k}" for k in range(BANDS))).agg(F.count("*").alias("n"))
    # a key counts in each bucket with the occurrences of all its spellings: clustering can only admit too much, never lose a line
    whole = kinds.withColumn("n", F.sum("n").over(Window.partitionBy("source", "key")))
    banded = whole.select("source", "key", "n", F.posexplode(F.array(*(f"band{k}" for k in range(BANDS)))).alias("band", "bucket"))
    enough = lambda c: (F.col(c) >= MIN_ARTICLES) & (F.col(c) * SHARE >= F.col("total"))
    clusters = banded.groupBy("source", "band", "bucket").agg(F.sum("n").alias("size")).join(totals, "source").where(enough("size")).select("source", "band", "bucket")
    members = banded.where(F.col("n") >= MIN_ARTICLES).join(clusters, ["source", "band", "bucket"], "left_semi").select("source", "key").distinct()
    exact = lines.join(members, ["source", "key"], "left_semi").select("source", "key", "url").distinct().groupBy("source", "key").agg(F.count("*").alias("articles"))
    return exact.join(totals, "source").where(enough("articles")).select("source", "key", "articles")


def repeated_lines(arts: DataFrame) -> DataFrame:
    """``(url, line_no)`` of every repeated line, counted from 0."""
    lines = arts.where("source is not null").select("source", "url", F.posexplode("lines").alias("line_no", "l")).where("l.key <> 0")
    found = lines.select("source", "url", F.col("line_no").cast("bigint").alias("line_no"), F.col("l.key").alias("key"))
    return found.join(repeated_keys(arts).select("source", "key"), ["source", "key"], "left_semi").select("url", "line_no")


def line_clusters(arts: DataFrame) -> DataFrame:
    """``(source, band, bucket, lines, spellings)``: near-duplicate clusters of masked lines that pass the frequency bounds."""
    sourced = arts.where("source is not null")
    totals = sourced.groupBy("source").agg(F.count("*").alias("total"))
    lines = sourced.select("source", F.explode("lines").alias("l")).where("l.key <> 0").select("source", "l.*")
    kinds = lines.groupBy("source", "key", *(f"band{k}" for k in range(BANDS))).agg(F.count("*").alias("n"))
    banded = kinds.select("source", "n", F.posexplode(F.array(*(f"band{k}" for k in range(BANDS)))).alias("band", "bucket"))
    sizes = banded.groupBy("source", "band", "bucket").agg(F.sum("n").alias("lines"), F.count("*").alias("spellings"))
    return sizes.join(totals, "source").where(f"lines >= {MIN_ARTICLES} and lines * {SHARE} >= total").drop("total")


def near_repeated_lines(arts: DataFrame) -> DataFrame:
    """``(url, line_no)`` of lines that are repeated but for their numbers, dates and names: members of frequent clusters whose masked form enough articles of the source have."""
    sourced = arts.where("source is not null")
    totals = sourced.groupBy("source").agg(F.count("*").alias("total"))
    clusters = line_clusters(arts).select("source", "band", "bucket")
    lines = sourced.select("source", "url", F.posexplode("lines").alias("line_no", "l")).where("l.key <> 0")
    each = lines.select("source", "url", F.col("line_no").cast("bigint").alias("line_no"), F.col("l.mask").alias("mask"), F.posexplode(F.array(*(f"l.band{k}" for k in range(BANDS)))).alias("band", "bucket"))
    members = each.join(clusters, ["source", "band", "bucket"], "left_semi").select("source", "url", "line_no", "mask").distinct()
    often = members.select("source", "mask", "url").distinct().groupBy("source", "mask").agg(F.count("*").alias("articles")).join(totals, "source")
    often = often.where(f"articles >= {MIN_ARTICLES} and articles * {SHARE} >= total").select("source", "mask")
    return members.join(often, ["source", "mask"], "left_semi").select("url", "line_no")


def clean(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``(url, maintext)``: each article once, without its repeated lines; other lines stay as they are."""
    drop = found.groupBy("url").agg(F.collect_set(F.col("line_no").cast("int")).alias("gone"))
    texts = rows.where("url is not null and maintext is not null").groupBy("url").agg(F.max("maintext").alias("maintext"))
    pieces = F.split("maintext", "\n", -1)
    kept = F.filter(pieces, lambda x, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    return texts.join(drop, "url", "left").select("url", F.array_join(kept, "\n").alias("maintext"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, SHUFFLED).select("url", "maintext", "source_domain")
    return repeated_lines(article_lines(rows))


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, SHUFFLED).select("url", "maintext", "source_domain")
    return clean(rows, repeated_lines(article_lines(rows)))


def p3_clean_near(spark: SparkSession, sf_dir: str, near: bool = True) -> DataFrame:
    """``p3_clean`` that removes near-duplicate lines too (``near``)."""
    rows = table(spark, sf_dir, SHUFFLED).select("url", "maintext", "source_domain")
    arts = materialize(article_lines(rows), "p3-lines")
    found = repeated_lines(arts)
    return clean(rows, found.union(near_repeated_lines(arts)) if near else found)


def p3_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, SHUFFLED).select("url", "maintext", "source_domain")
    return line_clusters(article_lines(rows))


QUERIES = {"p3_found": p3_found, "p3_clean": p3_clean, "p3_clean_near": p3_clean_near, "p3_clusters": p3_clusters}
