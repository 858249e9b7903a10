"""Readers and writers of the pipeline's file formats.

Parquet is the store; CSV, line and JSON files are read with explicit schemas.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presslens.functions import text as X
from presslens.storage import materialize

ARTICLE = "url string, title string, date_publish string, description string, maintext string, source_domain string, authors string"
FIELDS = [f.split()[0] for f in ARTICLE.split(", ")]


def read_articles_csv(spark: SparkSession, path, schema: str = ARTICLE) -> DataFrame:
    """Articles with quoted, multi-line text; dates that do not parse become null."""
    df = spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', nullValue="\\N", emptyValue="")
    return df.withColumn("date_publish", F.try_to_timestamp("date_publish")) if "date_publish" in df.columns else df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", index_label: str | None = None) -> None:
    """CSV that ``read_articles_csv`` reads back unchanged; times as text. ``index_label`` names the first column, as labelled matrices have it."""
    if index_label is not None:
        df = df.withColumnRenamed(df.columns[0], index_label)
    times = {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c, t in df.dtypes if t.startswith("timestamp")}
    df.withColumns(times).write.mode(mode).csv(path, header=True, quote='"', escape='"', quoteAll=True, nullValue="\\N", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_matrix_csv(spark: SparkSession, path: str, row: str) -> DataFrame:
    """A wide labelled matrix; the first column holds the row labels."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"', nullValue="\\N", emptyValue="")
    first = df.columns[0]
    return df.select(F.col(first).alias(row), *(F.col(f"`{c}`").try_cast("double").alias(c) for c in df.columns[1:]))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value)``: stripped lines that are not empty."""
    return spark.read.text(path).select(X.collapse_blanks(F.col("value")).alias("value")).where("value <> ''")


def read_query(spark: SparkSession, path: str) -> DataFrame:
    """A whole file as one string."""
    return spark.read.text(path, wholetext=True)


def read_json_map(spark: SparkSession, path: str) -> DataFrame:
    """``(raw, canonical)`` of a JSON object of strings; empty where the file is missing or broken."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "raw string, canonical string")
    got = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    return got.select(F.explode("m").alias("raw", "canonical"))


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in its file system, local or shared."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_patterns(path: str) -> list[str]:
    """Literal patterns of a dictionary file, in their order."""
    with open(path, encoding="utf-8") as f:
        return X.load_patterns(f)


def merge_articles(frames: list[DataFrame], key: str = "url") -> DataFrame:
    """Rows of all inputs, one a key: the first input that has it wins, then the first row by content; rows without key are dropped."""
    union = None
    for i, f in enumerate(frames):
        f = f.withColumn("_input", F.lit(i))
        union = f if union is None else union.unionByName(f, allowMissingColumns=True)
    return keep_first(union.where(F.col(key).isNotNull()), [key], ["_input"]).drop("_input")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order; ties fall to the least remaining columns, so the result is fixed."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    w = Window.partitionBy(*keys).orderBy(*order, *rest)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


BROADCAST_KEYS = 200_000


def one_row(df: DataFrame, key: str = "url") -> DataFrame:
    """One row a key: the greatest value of each column. Keys that stand once pass as they are; only the others' rows are sent around."""
    df = df.where(F.col(key).isNotNull())
    often = materialize(df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key), "repeated")
    often = F.broadcast(often) if often.count() <= BROADCAST_KEYS else often
    merged = df.join(often, key, "left_semi").groupBy(key).agg(*(F.max(c).alias(c) for c in df.columns if c != key))
    return df.join(often, key, "left_anti").unionByName(merged)


def duplicate_keys(df: DataFrame, key: str = "url") -> DataFrame:
    """Values that occur more than once, with their number."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def exportable(articles: DataFrame) -> DataFrame:
    """Articles fit for export: with url and text that is not blank, and the fixed columns."""
    kept = articles.where(F.col("url").isNotNull() & ~X.is_blank(F.col("maintext")))
    authors = F.concat_ws("; ", "authors") if dict(articles.dtypes)["authors"].startswith("array") else F.col("authors")
    return kept.withColumn("authors", authors).select(*FIELDS)


def export_articles(articles: DataFrame, path: str) -> dict[str, int]:
    """Write the exportable articles; returns how many were valid, without text, or invalid."""
    empty = X.is_blank(F.col("maintext"))
    counts = articles.agg(F.count_if(F.col("url").isNotNull() & ~empty).alias("valid"), F.count_if(F.col("url").isNotNull() & empty).alias("empty"), F.count_if(F.col("url").isNull()).alias("invalid")).first()
    exportable(articles).write.mode("overwrite").parquet(path)
    return counts.asDict()


def append_lines(df: DataFrame, path: str) -> None:
    df.select(F.col(df.columns[0]).cast("string")).write.mode("append").text(path)


def rewrite_lines(spark: SparkSession, path: str) -> None:
    """Replace a line file (a folder of text) by its distinct lines in first order: written beside, then renamed; the old one is kept aside until the new one is in its place."""
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    kept = lines.where("trim(value) <> ''").groupBy("value").agg(F.min("_at").alias("_at")).orderBy("_at").select("value")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    kept.write.text(beside.toString())
    fs = target.getFileSystem(conf)
    aside = jvm.org.apache.hadoop.fs.Path(f"{path}.old-{uuid.uuid4().hex}")
    fs.rename(target, aside)
    if not fs.rename(beside, target):
        fs.rename(aside, target)
        raise OSError(f"{path} could not be replaced")
    fs.delete(aside, True)


def write_parts(df: DataFrame, path: str, part: str = "part") -> None:
    """One folder a part under a root of its own."""
    df.write.mode("overwrite").partitionBy(part).parquet(path)


def append_batch(df: DataFrame, path: str, batch: int) -> None:
    """Checkpoint of one batch."""
    df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(path)


def read_batches(spark: SparkSession, path: str, key: str, value: str, schema: str) -> DataFrame:
    """The latest value of each key over all batches; empty where there is none yet."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path).groupBy(key).agg(F.max_by(value, F.struct("batch", value)).alias(value))
