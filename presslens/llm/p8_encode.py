"""The whole corpus as token ids (problem 8).

Method: distinct-word table. Spark splits the texts into words (the
vocabulary's own pattern), each distinct word is encoded once, and the ids are
joined back by position. Where the word table is small (its size is measured)
it is broadcast and looked up column-wise; beyond that, blocks of documents
join it on their own distinct words, which shuffles each word once a block.
Decoding joins the ids to the pieces, whose number is the vocabulary's.

Null and empty texts give an empty list of ids. Null identifiers and repeated
texts keep their rows. Strings of special tokens are ordinary text. Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.llm import bpe
from presslens.session import table
from presslens.storage import materialize, table_bytes

BROADCAST_BYTES = 24_000_000
BLOCK_ROWS_BITS = 10
LOOKUP_WORDS = 4_000_000


def words_column(text):
    return F.regexp_extract_all(text, F.lit(bpe.JAVA_PATTERN), F.lit(0))


def word_encoder(path: str, name: str):
    """mapInArrow function: (word) -> (word, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = bpe.encoding(path, name)._encode_single_piece
        for batch in batches:
            ids = pa.array([encode(w) for w in batch.column(0).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["word", "ids"])

    return run


def word_table(docs: DataFrame, path: str = bpe.TOKENIZERS, name: str = bpe.VOCABULARY) -> DataFrame:
    """``(word, ids)`` of every distinct word, written once."""
    words = docs.select(F.explode(words_column(F.col("text"))).alias("word")).groupBy("word").agg(F.lit(1).alias("x")).select("word")
    return materialize(words.mapInArrow(word_encoder(path, name), "word string, ids array<int>"), "p8-words")


def _lookup(words: pa.Array, table_words: pa.Array, table_ids: pa.Array) -> pa.Array:
    """Ids of each list of words, by position."""
    flat = words.flatten()
    place = pc.index_in(flat, value_set=table_words)
    if place.null_count:
        raise ValueError("a word is not in the word table")
    place = np.asarray(place, np.int64)
    starts, ids = np.asarray(table_ids.offsets, np.int64), np.asarray(table_ids.values, np.int32)
    n = np.diff(starts)[place]
    upto = np.concatenate([[0], np.cumsum(n)])
    out = ids[np.repeat(starts[place] - upto[:-1], n) + np.arange(upto[-1])]
    word_at = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(words), 0), np.int64))])
    return pa.ListArray.from_arrays(pa.array(upto[word_at].astype(np.int32)), pa.array(out, pa.int32()))


def joiner(known):
    """mapInArrow function: (doc_id, words) -> (doc_id, ids) by a broadcast word table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with pa.ipc.open_stream(known.value) as f:
            words = f.read_all().combine_chunks()
        tw, ti = words.column(0).combine_chunks(), words.column(1).combine_chunks()
        for batch in batches:
            # each lookup builds the table's hash anew, so it serves as many rows as memory allows
            upto = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(batch.column(1)), 0), np.int64))
            b = 0
            while b < len(batch):
                e = max(b + 1, int(np.searchsorted(upto, (upto[b - 1] if b else 0) + LOOKUP_WORDS, side="right")))
                part, b = batch.slice(b, e - b), e
                yield pa.RecordBatch.from_arrays([part.column(0), _lookup(part.column(1), tw, ti)], ["doc_id", "ids"])

    return run


def _join_block(docs: pa.Table, words: pa.Table) -> pa.Table:
    d, w = docs.combine_chunks(), words.combine_chunks()
    lists = d.column("words").combine_chunks() if len(d) else pa.array([], pa.list_(pa.string()))
    if not len(w):
        ids = pa.array([[]] * len(d), pa.list_(pa.int32()))
    else:
        ids = _lookup(lists, w.column("word").combine_chunks(), w.column("ids").combine_chunks())
    return pa.table({"doc_id": d.column("doc_id"), "ids": ids})


def encode(documents: DataFrame, path: str = bpe.TOKENIZERS, name: str = bpe.VOCABULARY, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(doc_id, ids)`` of each row of ``documents(doc_id, text)``."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    words = word_table(docs, path, name)
    if table_bytes(words) <= broadcast_bytes:
        sink = pa.BufferOutputStream()
        made = words.toArrow().combine_chunks()
        with pa.ipc.new_stream(sink, made.schema) as f:
            f.write_table(made)
        known = documents.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes())
        return docs.select("doc_id", words_column(F.col("text")).alias("words")).mapInArrow(joiner(known), "doc_id bigint, ids array<int>")
    blocked = materialize(docs.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_ROWS_BITS)), "p8-blocks")
    split = blocked.select("block", "doc_id", words_column(F.col("text")).alias("words"))
    used = split.select(F.col("block").alias("of_block"), F.explode("words").alias("word")).distinct().join(words, "word")
    return split.groupBy("block").cogroup(used.groupBy("of_block")).applyInArrow(_join_block, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str = bpe.TOKENIZERS, name: str = bpe.VOCABULARY) -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)``; an empty list gives the empty text. Identifiers must be unique."""
    spark = encoded.sparkSession
    pieces = spark.createDataFrame([(i, bytearray(b)) for b, i in bpe.ranks(path, name).items()], "id int, piece binary")
    each = encoded.select("doc_id", F.posexplode("ids").alias("at", "id")).join(F.broadcast(pieces), "id")  # bounded by the vocabulary
    # hex keeps the pieces as they are, though some end within a character
    joined = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", F.hex("piece").alias("h")))).alias("l"))
    texts = joined.select("doc_id", F.decode(F.unhex(F.array_join(F.transform("l", lambda x: x.h), "")), "UTF-8").alias("text"))
    return encoded.select("doc_id").join(texts, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word table as text and number of ids."""
    return word_table(table(spark, sf_dir, "documents").select("text").where("text is not null")).select("word", F.size("ids").alias("n_ids"))


def p8_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode(p8_ids(spark, sf_dir))


QUERIES = {"p8_ids": p8_ids, "p8_words": p8_words, "p8_decoded": p8_decoded}
ORACLES = {"p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
