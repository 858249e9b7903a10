"""Evaluation texts inside the training documents (problem 9).

Method: training suffix arrays. The documents are cut into shards; in each
shard the word-level suffixes are ranked by prefix doubling together with the
words of the test items, and sorted on their first ``MATCH`` words; every test
suffix is then found in that order by binary search, matches are extended to
the longest verbatim run, and their places give the documents. Items are
handled in blocks of at most ``BLOCK_WORDS`` words, each block against all
documents, so what is broadcast is bounded.

Words are runs of letters and digits, folded. Null, empty and short texts (of
fewer than ``MATCH`` words) match nothing; a null id is kept as null; repeated
texts are reported under each id. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.llm import textvec as tv
from presslens.session import table

MATCH = 12
BLOCK_WORDS = 1_000_000
SHARD_CHARS = 6_000_000


def _ranks(first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """Ranks from 1 of the values, or of the pairs of ranks."""
    key = first if second is None else first * np.int64(2**31) + second
    order = np.argsort(key, kind="stable")
    s = key[order]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(np.concatenate([[1], s[1:] != s[:-1]]))
    return out


def _after(r: np.ndarray, room: np.ndarray, n: int) -> np.ndarray:
    """``r`` at ``n`` places on; 0 beyond the end of the text."""
    out = np.zeros_like(r)
    out[:-n] = r[n:]
    out[room < n + 1] = 0
    return out


def suffix_order(words: np.ndarray, room: np.ndarray) -> np.ndarray:
    """A key for each suffix that orders the suffixes by their first twelve words. ``room``: words from here to the end of the text."""
    one = _ranks(words)
    two = _ranks(one, _after(one, room, 1))
    four = _ranks(two, _after(two, room, 2))
    eight = _ranks(four, _after(four, room, 4))
    return eight * np.int64(2**31) + _after(four, room, 8)


def _room(row: np.ndarray) -> np.ndarray:
    last = np.append(np.flatnonzero(row[1:] != row[:-1]), len(row) - 1)
    return last[np.searchsorted(last, np.arange(len(row)))] - np.arange(len(row)) + 1


def _before(rank: np.ndarray, row: np.ndarray, none: int) -> np.ndarray:
    """The rank of the word before each place; ``none`` at the beginning of a row."""
    out = np.concatenate([[none], rank[:-1]]).astype(np.int64)
    out[1:][row[1:] != row[:-1]] = none
    return out


def text_words(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and rows of a column."""
    words, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for b, e in tv.chunks(array):
        codes, offsets = tv.codes_of(array.slice(b, e - b))
        w, r, _, _ = tv.words_of(*tv.fold_codes(codes, offsets))
        words.append(w)
        rows.append(r + b)
    return np.concatenate(words), np.concatenate(rows)


def find_matches(words, row, test_words, test_row, test_room):
    """(document row, item row, longest run, place in the document, place in the item) of every document and item with a common run."""
    nothing = tuple(np.zeros(0, np.int64) for _ in range(5))
    if len(words) == 0 or len(test_words) == 0:
        return nothing
    room = _room(row)
    every = np.concatenate([test_words, words])
    key = suffix_order(every, np.concatenate([test_room, room]))
    test_key, key = key[: len(test_words)], key[len(test_words) :]
    # the word before each place: 0 at the beginning of a document, -1 at that of a test item
    rank = _ranks(every)
    test_before, before = _before(rank[: len(test_words)], test_row, -1), _before(rank[len(test_words) :], row, 0)
    at = np.flatnonzero(room >= MATCH)
    array = at[np.lexsort((before[at], key[at]))]  # the suffix array, equal beginnings by the word before
    ordered = key[array]
    t = np.flatnonzero(test_room >= MATCH)
    low, high = np.searchsorted(ordered, test_key[t], "left"), np.searchsorted(ordered, test_key[t], "right")
    hit = high > low
    t, low, high = t[hit], low[hit], high[hit]
    if len(t) == 0:
        return nothing
    # only where a run begins: where the words before are the same the suffixes lie within a longer run, and such places are never listed
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    group = np.searchsorted(first, np.arange(len(array)), side="right")
    width = np.int64(rank.max() + 2)
    placed, wanted = group * width + before[array] + 1, group[low] * width + test_before[t] + 1
    same_low, same_high = np.searchsorted(placed, wanted, "left"), np.searchsorted(placed, wanted, "right")
    # at the beginning of a test item every place begins a run (no document has -1 before, so the range of the same is empty)
    begin, end, t = np.concatenate([low, same_high]), np.concatenate([same_low, high]), np.concatenate([t, t])
    n = end - begin
    q = np.repeat(t, n)
    p = array[np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
    length = np.full(len(p), MATCH, np.int64)
    growing = np.arange(len(p))
    while len(growing):
        k = length[growing]
        inside = (room[p[growing]] > k) & (test_room[q[growing]] > k)
        growing, k = growing[inside], k[inside]
        same = words[p[growing] + k] == test_words[q[growing] + k]
        growing = growing[same]
        length[growing] += 1
    doc, item = row[p], test_row[q]
    start = np.searchsorted(row, doc)
    best = np.lexsort((p, -length, item, doc))
    first = np.concatenate([[True], (doc[best][1:] != doc[best][:-1]) | (item[best][1:] != item[best][:-1])])
    best = best[first]
    return doc[best], item[best], length[best], (p - start)[best], (q - np.searchsorted(test_row, item))[best]


def searcher(tests):
    """mapInArrow function: (doc_id, text) -> matches against the broadcast block of test items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, test_words, test_row = tests.value
        test_room = _room(test_row) if len(test_row) else test_row
        for shard in _shards(batches):
            words, row = text_words(shard.column(1))
            d, i, n, p, q = find_matches(words, row, test_words, test_row, test_room)
            yield pa.RecordBatch.from_arrays(
                [shard.column(0).take(pa.array(d)), pa.array(ids[i]), pa.array(n), pa.array(p), pa.array(q)], ["doc_id", "item_id", "words", "doc_at", "item_at"]
            )

    return run


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together, or cut, to shards of bounded text."""
    held, size = [], 0
    for batch in batches:
        for b, e in tv.chunks(batch.column(1), SHARD_CHARS):
            part = batch.slice(b, e - b)
            held.append(part)
            size += part.column(1).nbytes
            if size >= SHARD_CHARS:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id, words, doc_at, item_at)``: for each document and item with a common run, the longest one."""
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").where("text is not null")
    found = None
    for block in _blocks(items):
        part = docs.mapInArrow(searcher(spark.sparkContext.broadcast(block)), "doc_id bigint, item_id bigint, words bigint, doc_at bigint, item_at bigint")
        found = part if found is None else found.unionByName(part)
    return found


def _blocks(items: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The words of the test items in blocks; rows come to the driver one partition at a time."""
    ids, texts, size, some = [], [], 0, False
    for r in items.where("text is not null").select("item_id", "text").orderBy("item_id").toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1])
        if size >= BLOCK_WORDS * 4:
            yield (np.array(ids, np.int64), *text_words(pa.array(texts, pa.string())))
            ids, texts, size, some = [], [], 0, True
    if ids or not some:
        yield (np.array(ids, np.int64), *text_words(pa.array(texts, pa.string())))


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir).select("doc_id", "item_id").distinct()


def p9_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir)


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of the documents that contain no test passage."""
    return table(spark, sf_dir, "documents").select("doc_id").join(p9_found(spark, sf_dir).select("doc_id").distinct(), "doc_id", "left_anti")


QUERIES = {"p9_found": p9_found, "p9_matches": p9_matches, "p9_clean": p9_clean}
