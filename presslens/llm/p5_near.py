"""Near-duplicate articles with small edits (problem 5).

Method: min-max hashing. Each article is the set of its runs of three words
(folded, without the repeated lines of its source); under each of ``PERMS``
permutations both the least and the greatest hash are kept, so that one
evaluation gives two values. Values are banded (``ROWS`` to a band, from
different permutations), and articles with a common band are candidates.

Bands see the likeness of whole articles. That a small article stands within a
large one is seen by a second index, which covers every article too: anchors,
the least of each ``WINDOW`` consecutive runs of ``LONG`` words, so that every
passage of ``LONG + WINDOW - 1`` words that two articles share gives them a
common anchor. Articles with two common anchors are candidates. An anchor of
more than ``MOST`` articles is told apart by the 9, then the 16 words (``FINER``)
that begin at it; only common passages that are shorter than 9 words and stand
in so many articles give no candidates.

Where more than ``MOST`` articles have one band, or 16 words from an anchor on,
each is paired with the least one first, and then all that are still in
different components. By such anchors an article is paired only if they are a
fifth of its anchors or more: whoever shares a fifth of another's anchors shares
rarer ones too. Articles of fewer words than an anchor needs are looked up by
each of their runs in all others.

Candidates are checked exactly on the sets, and the groups are the connected
components.

Nulls: rows without url or maintext take no part. Texts of fewer than three
words have no runs and belong to no group; identical texts are collapsed before
anything is paired. Repeated rows of a url count once. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.llm import textvec as tv
from presslens.llm.p3_lines import SHUFFLED, article_lines, line_bounds, line_keys, repeated_keys, repeated_lines
from presslens.operators.graph import connected_components
from presslens.session import norm_source, table
from presslens.storage import discard, materialize

RUN = 3
SHARE = 0.45
PERMS, BANDS = 64, 32  # 4 rows a band: two minima and two maxima
LONG, WINDOW, FINER = 5, 8, (9, 16)  # words of an anchor; anchors of which the least is kept; words that tell frequent anchors apart
MOST = 16
BROADCAST_KEYS = 500_000
BUCKET_POSTINGS = 2_000_000
SALTS = 16
HOME, PART_PAIRS = 4096, 50_000

_rng = np.random.default_rng(20240501)
_A = _rng.integers(0, 2**63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, PERMS, dtype=np.uint64)


def minmax(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(sets, 2 * PERMS): minima then maxima of the hashed sets that start at ``first``."""
    out = np.empty((len(first), 2 * PERMS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(PERMS):
            x = hashes * _A[k] + _B[k]
            out[:, k] = np.minimum.reduceat(x, first)
            out[:, PERMS + k] = np.maximum.reduceat(x, first)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(sets, BANDS): band b is made of two minima and two maxima, all of different permutations."""
    half = PERMS // 2
    cols = [np.arange(half), np.arange(half) + half, PERMS + (np.arange(half) + 11) % half, PERMS + half + (np.arange(half) + 23) % half]
    h = np.zeros((len(signature), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for c in cols:
            h = tv.mix(h * np.uint64(0x9FB21C651E98DF25) + signature[:, c])
        return tv.mix(h + np.arange(BANDS, dtype=np.uint64))


def source_key(source: np.ndarray | list) -> np.ndarray:
    """64-bit hashes of source names."""
    codes, offsets = tv.codes_of(pa.array(source, pa.string()))
    out = np.zeros(len(offsets) - 1, np.uint64)
    some = np.diff(offsets) > 0
    out[some] = tv.run_hashes(codes, offsets[:-1][some], np.diff(offsets)[some])
    return out


def signer(repeated):
    """mapInArrow function: (url, source, maintext[, gone]) -> signatures. ``repeated``: broadcast sorted hashes of (source, line key), or None where ``gone`` lists the numbers of the lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone_all = repeated.value if repeated is not None else None
        for batch in batches:
            for b, e in tv.chunks(batch.column(2)):
                part = batch.slice(b, e - b)
                codes, offsets = tv.codes_of(part.column(2))
                folded, fo = tv.fold_codes(codes, offsets)
                starts, ends, rows = line_bounds(folded, fo)
                keys = line_keys(folded, starts, ends)
                if gone_all is not None:
                    src = source_key(part.column(1))[rows]
                    with np.errstate(over="ignore"):
                        gone = (keys != 0) & (src != 0) & _among(tv.mix(src * np.uint64(3) + keys), gone_all)
                else:
                    lists = part.column(3)
                    owner = np.repeat(np.arange(len(part)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
                    gone = np.zeros(len(rows), bool)
                    gone[np.searchsorted(rows, owner) + np.asarray(lists.flatten(), np.int64)] = True
                words, row, at, _ = tv.words_of(folded, fo)
                if gone.any():
                    keep = ~gone[np.searchsorted(starts, at, side="right") - 1]
                    words, row = words[keep], row[keep]
                yield from _signed(part.column(0), words, row)

    return run


def _among(x: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if len(sorted_values) == 0:
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def _distinct(h: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) if len(h) else np.zeros(0, bool)
    return h[new], r[new]


def anchors(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, finer keys, row) of the anchors of rows of words, in the order of the rows. A row of fewer words than an anchor has one of all its words."""
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    count = np.diff(np.append(first, len(row)))
    m = max(0, len(words) - LONG + 1)
    with np.errstate(over="ignore"):
        h = np.zeros(m, np.uint64)
        for k in range(LONG):
            h = h * np.uint64(0x9FB21C651E98DF25) + words[k : k + m]
        h = tv.mix(h)
    at = np.flatnonzero(row[:m] == row[LONG - 1 :]) if m else np.zeros(0, np.int64)
    short = count < LONG
    h = np.concatenate([h[at], tv.run_hashes(words, first, count)[short]])
    at = np.concatenate([at, first[short]])
    order = np.argsort(at, kind="stable")
    h, at = h[order], at[order]
    r = row[at]
    keep = np.zeros(len(h), bool)
    if len(h) >= WINDOW:
        least = np.lib.stride_tricks.sliding_window_view(h, WINDOW).argmin(1) + np.arange(len(h) - WINDOW + 1)
        keep[least[r[: len(h) - WINDOW + 1] == r[WINDOW - 1 :]]] = True
    begin = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    size = np.diff(np.append(begin, len(r)))
    keep |= np.repeat(size < WINDOW, size) & (h == np.repeat(np.minimum.reduceat(h, begin), size))
    h, at, r = h[keep], at[keep], r[keep]
    end = (first + count)[np.searchsorted(first, at, side="right") - 1]
    finer, grown = np.zeros((len(at), len(FINER)), np.uint32), np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(FINER[-1]):
            grown = grown * np.uint64(0xD6E8FEB86659FD93) + np.where(at + k < end, words[np.minimum(at + k, len(words) - 1)], np.uint64(k))
            if k + 1 in FINER:
                finer[:, FINER.index(k + 1)] = tv.mix(grown) >> np.uint64(32)
    return h, finer, r


def _blobs(values: np.ndarray, size: np.ndarray, width: int) -> pa.Array:
    """Binary column of rows of ``size`` values of ``width`` bytes."""
    at = np.concatenate([[0], np.cumsum(size * width)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(values.tobytes())])


def _signed(urls: pa.Array, words: np.ndarray, row: np.ndarray) -> Iterator[pa.RecordBatch]:
    count = np.bincount(row, minlength=len(urls)) if len(row) else np.zeros(len(urls), np.int64)
    long_enough = (count >= RUN)[row] if len(row) else np.zeros(0, bool)
    words, row = words[long_enough], row[long_enough]
    if len(words) == 0:
        return
    first_word = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    present = row[first_word]
    n_words = np.diff(np.append(first_word, len(words)))
    text_key = tv.run_hashes(words, first_word, n_words)
    key, finer, owner = anchors(words, row)
    anchor = np.empty(len(key), ANCHOR)
    anchor["key"], anchor["finer"] = key, finer
    h, r = tv.shingle_hashes(words, row, RUN)
    h, r = _distinct(h, r)
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    bands = band_keys(minmax(h, first))
    small = (h >> np.uint64(32)).astype(np.uint32)
    small = small[np.lexsort((small, r))]
    yield pa.RecordBatch.from_arrays(
        [
            urls.take(pa.array(present)), pa.array(text_key.view(np.int64)), pa.array(n_words.astype(np.int32)), _blobs(bands, np.full(len(present), BANDS), 8),
            _blobs(anchor, np.bincount(np.searchsorted(present, owner), minlength=len(present)), ANCHOR.itemsize), _blobs(small, np.diff(np.append(first, len(h))), 4),
        ],
        ["url", "text_key", "words", "bands", "anchors", "runs"],
    )


ANCHOR = np.dtype([("key", np.uint64), ("finer", np.uint32, len(FINER))])
SIGNED = "url string, text_key bigint, words int, bands binary, anchors binary, runs binary"


def _flat(blobs: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column, and the rows they are of."""
    blobs = blobs.cast(pa.large_binary())
    at = np.frombuffer(blobs.buffers()[1], np.int64)[blobs.offset : blobs.offset + len(blobs) + 1]
    dtype = np.dtype(dtype)
    values = np.frombuffer((blobs.buffers()[2] or b"")[at[0] : at[-1]], dtype) if len(blobs) else np.zeros(0, dtype)
    return values, np.repeat(np.arange(len(blobs)), np.diff(at) // dtype.itemsize)


POSTING = np.dtype([("key", np.uint32), ("finer", np.uint32, len(FINER)), ("row", np.uint16)])
BAND_POSTING = np.dtype([("key", np.uint32), ("row", np.uint16)])
POSTINGS = "bucket int, ids binary, bands binary, anchors binary"


def poster(buckets: int):
    """mapInArrow function: (id, bands, anchors) -> packed postings, one row for each bucket of keys. Within a bucket a key keeps 32 bits: a chance hit is refused by the check of the pair."""

    def parts(values, keys, dtype, row, fill):
        made = np.empty(len(values), dtype)
        fill(made)
        made["key"], made["row"] = keys.astype(np.uint32), row
        bucket = (keys >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        return made[order], np.searchsorted(bucket[order], np.arange(buckets + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, len(batch), 1 << 16):
                part = batch.slice(b, 1 << 16)
                ids = np.asarray(part.column(0), np.int64)
                band, band_row = _flat(part.column(1), np.uint64)
                anchor, anchor_row = _flat(part.column(2), ANCHOR)
                bands, band_at = parts(band, band, BAND_POSTING, band_row, lambda made: None)

                def finer(made, anchor=anchor):
                    made["finer"] = anchor["finer"]

                posts, at = parts(anchor, anchor["key"], POSTING, anchor_row, finer)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(buckets, dtype=np.int32)), pa.array([ids.tobytes()] * buckets, pa.binary()),
                        _blobs(bands, np.diff(band_at), BAND_POSTING.itemsize), _blobs(posts, np.diff(at), POSTING.itemsize),
                    ],
                    ["bucket", "ids", "bands", "anchors"],
                )

    return run


def _grouped(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, id) in order, and the sizes of the keys' groups, at each member."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])]) if len(keys) else np.zeros(0, bool)
    keys, ids = keys[new], ids[new]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(keys)))
    return keys, ids, np.repeat(size, size)


def _pairs_within(ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs within groups of at most ``MOST`` members, least id first; members stand one after the other."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in range(2, MOST + 1):
        of = ids[size == n].reshape(-1, n)
        i, j = np.triu_indices(n, 1)
        left.append(of[:, i].ravel())
        right.append(of[:, j].ravel())
    return np.concatenate(left), np.concatenate(right)


BAND, PASSAGE = -1, -2
MET = "a bigint, b bigint, n int"


def meet(postings: pa.Table) -> pa.Table:
    """The postings of one bucket -> pairs ``(a, b, n)`` that meet in it, by n anchors (a band counts as two); and members a of groups b of more than ``MOST``, with n = BAND or PASSAGE."""
    band_keys_, band_ids, keys, finers, ids = ([] for _ in range(5))
    for some, bands, posts in zip(*(postings.column(c) for c in ("ids", "bands", "anchors"))):
        some = np.frombuffer(some.as_buffer(), np.int64)
        bands, posts = np.frombuffer(bands.as_buffer(), BAND_POSTING), np.frombuffer(posts.as_buffer(), POSTING)
        band_keys_.append(bands["key"])
        band_ids.append(some[bands["row"]])
        keys.append(posts["key"])
        finers.append(posts["finer"])
        ids.append(some[posts["row"]])
    bucket = np.uint64(postings.column("bucket")[0].as_py())
    bk, bi, bn = _grouped(np.concatenate(band_keys_), np.concatenate(band_ids))
    key, finer, ident = np.concatenate(keys).astype(np.uint64), np.concatenate(finers), np.concatenate(ids)
    a, b, w = [], [], []

    def met(members, size, weight):
        x, y = _pairs_within(members, size)
        a.append(x)
        b.append(y)
        w.append(np.full(len(x), weight))

    met(bi, bn, 2)
    pk, pi, pn = _grouped(key, ident)
    for level in range(len(FINER)):
        met(pi, pn, 1)
        frequent = np.isin(key, pk[pn > MOST])
        finer, ident = finer[frequent], ident[frequent]
        with np.errstate(over="ignore"):
            key = tv.mix(key[frequent]) + finer[:, level]
        pk, pi, pn = _grouped(key, ident)
    met(pi, pn, 1)
    a, b, w = np.concatenate(a), np.concatenate(b), np.concatenate(w)
    order = np.lexsort((b, a))
    a, b, w = a[order], b[order], w[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    w = np.add.reduceat(w, first) if len(first) else w
    a, b, w = [a[first]], [b[first]], [w]
    with np.errstate(over="ignore"):
        for members, group, size, kind in ((bi, bk.astype(np.uint64), bn, BAND), (pi, pk, pn, PASSAGE)):
            large = size > MOST
            a.append(members[large])
            b.append(tv.mix(tv.mix(group[large] + bucket * np.uint64(0x9E3779B97F4A7C15)) + np.uint64(-kind)).view(np.int64))
            w.append(np.full(large.sum(), kind))
    return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "n": np.concatenate(w).astype(np.int32)})


def overlaps(pairs: pa.Table, articles: pa.Table) -> pa.Table:
    """(part, a, b) and the (part, id, runs) of all articles of these pairs -> the pairs (a, b) that share enough runs of either."""
    runs = {i: np.frombuffer(x, np.uint32) for i, x in zip(articles.column("id").to_pylist(), articles.column("runs").to_pylist())}
    keep = np.zeros(len(pairs), bool)
    for i, (a, b) in enumerate(zip(pairs.column("a").to_pylist(), pairs.column("b").to_pylist())):
        x, y = runs[a], runs[b]
        both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
        keep[i] = both >= SHARE * min(len(x), len(y)) and both > 0
    return pairs.select(["a", "b"]).filter(pa.array(keep))


def signatures(rows: DataFrame) -> DataFrame:
    """Signature of each row with text, with the repeated lines of its source left out."""
    spark = rows.sparkSession
    arts = materialize(article_lines(rows), "p5-lines")
    gone = materialize(repeated_keys(arts).select("source", "key"), "p5-gone")
    text = rows.where("url is not null and maintext is not null").select("url", norm_source(F.col("source_domain")).alias("source"), "maintext")
    if gone.count() > BROADCAST_KEYS:
        lists = repeated_lines(arts).groupBy("url").agg(F.collect_list("line_no").alias("gone"))
        return text.join(lists, "url", "left").select("url", "source", "maintext", "gone").mapInArrow(signer(None), SIGNED)
    # a row without source gets that of another row of its url
    lacking = text.where("source is null").drop("source").join(arts.select("url", "source"), "url").select("url", "source", "maintext")
    text = text.where("source is not null").unionByName(lacking)
    pdf = gone.toPandas()
    with np.errstate(over="ignore"):
        hashes = np.sort(tv.mix(source_key(list(pdf["source"])) * np.uint64(3) + pdf["key"].to_numpy(np.int64).view(np.uint64)))
    return text.mapInArrow(signer(spark.sparkContext.broadcast(hashes)), SIGNED)


def _few(df: DataFrame) -> DataFrame:
    """A written table of identifiers, marked for broadcast where it is small; any size is joined right."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _homes(pairs: DataFrame, parts: int) -> DataFrame:
    """``(part, a, b)``, a < b: a pair is checked in the part of b's least partner, where most of b's other partners are checked too; partners of more than ``HOME`` are spread."""
    least = pairs.groupBy("b").agg(F.min("a").alias("least"))
    sizes = least.groupBy("least").agg(F.count("*").alias("n"))
    salt = F.pmod(F.xxhash64("b"), F.floor(F.col("n") / HOME) + 1)
    home = least.join(sizes, "least").select("b", F.pmod(F.xxhash64("least", salt), F.lit(parts)).cast("int").alias("part"))
    return pairs.join(home, "b").select("part", "a", "b")


def _checked(signed: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` that share enough runs. The runs of an article are sent once to each part that needs them, not once for each pair."""
    parts = max(signed.sparkSession.sparkContext.defaultParallelism * 2, pairs.count() // PART_PAIRS)
    placed = materialize(_homes(pairs, parts), "p5-homes")
    needed = materialize(placed.select("part", F.col("a").alias("id")).union(placed.select("part", "b")).distinct(), "p5-needed")
    articles = signed.select("id", "runs").join(_few(needed), "id").select("part", "id", "runs")
    return placed.groupBy("part").cogroup(articles.groupBy("part")).applyInArrow(overlaps, "a bigint, b bigint")


def _large_groups(signed: DataFrame, met: DataFrame) -> DataFrame | None:
    """``(group, id, asks)``: members of groups of more than ``MOST``; those that ask are to be paired with all others. None where there is no such group."""
    large = met.where("n < 0")
    if large.isEmpty():
        return None
    passages = large.where(F.col("n") == PASSAGE).groupBy("a").agg(F.count("*").alias("frequent"))
    all_anchors = signed.select(F.col("id").alias("a"), (F.octet_length("anchors") / ANCHOR.itemsize).alias("anchors"))
    heavy = passages.join(all_anchors, "a").where("frequent * 5 >= anchors").select("a", F.lit(True).alias("heavy"))
    asks = (F.col("n") == BAND) | F.coalesce("heavy", F.lit(False))
    members = large.join(heavy, "a", "left").select(F.col("b").alias("group"), F.col("a").alias("id"), asks.alias("asks"))
    some = members.where("asks").groupBy("group").agg(F.min("id").alias("least"))
    return materialize(members.join(some, "group"), "p5-large")


def _unsettled(members: DataFrame, comps: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: the pairs within a group, one of which asks, whose ends are in different components."""
    placed = members.join(comps.select(F.col("node").alias("id"), "component"), "id", "left").select("group", "id", "asks", F.coalesce("component", "id").alias("c"))
    mixed = placed.groupBy("group").agg(F.min("c").alias("one"), F.max("c").alias("most")).where("one <> most").select("group")
    placed = materialize(placed.join(mixed, "group", "left_semi"), "p5-mixed")
    # those that ask are sent to every part of their group, so that no group is one task's
    asking = placed.where("asks").select("group", F.col("id").alias("x"), F.col("c").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    others = placed.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    return asking.join(others, ["group", "part"]).where("c <> d").select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()


def _short_ones(signed: DataFrame) -> DataFrame | None:
    """Pairs ``(a, b)`` of an article too short for anchors and any that shares a run with it; None where there is none."""
    short = signed.where(F.col("words") < LONG + WINDOW - 1)
    if short.isEmpty():
        return None
    runs = lambda df, name: df.select("id", "runs").mapInArrow(_each_run, "id bigint, run bigint").withColumnRenamed("id", name)
    return runs(short, "x").join(runs(signed, "y"), "run").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _each_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        run, row = _flat(batch.column(1), np.uint32)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(run.astype(np.int64))], ["id", "run"])


def near_groups(rows: DataFrame) -> DataFrame:
    """``(url, group)`` for every article that belongs with another; the group is named by its least url."""
    signed = materialize(signatures(rows).withColumn("id", F.monotonically_increasing_id()), "p5-signed")
    same = signed.groupBy("text_key").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("text_key", "rep")
    copies = materialize(signed.select("text_key", "id").join(same, "text_key").where("id <> rep").select("id", "rep"), "p5-copies")
    alone = signed.join(_few(copies.select("id")), "id", "left_anti")
    buckets = max(rows.sparkSession.sparkContext.defaultParallelism * 2, signed.count() * 80 // BUCKET_POSTINGS)
    met = materialize(alone.select("id", "bands", "anchors").mapInArrow(poster(buckets), POSTINGS).groupBy("bucket").applyInArrow(meet, MET), "p5-met")
    pairs = met.where("n > 0").groupBy("a", "b").agg(F.sum("n").alias("n")).where("n >= 2").select("a", "b")
    large, short = _large_groups(signed, met), _short_ones(alone)
    if large is not None:
        pairs = pairs.union(large.where("id <> least").select(F.least("id", "least"), F.greatest("id", "least")))
    if short is not None:
        pairs = pairs.union(short)
    pairs = materialize(pairs.distinct(), "p5-pairs")
    discard(met)
    linked = _checked(signed, pairs)
    if large is not None:
        linked = materialize(linked, "p5-linked")
        rest = materialize(_unsettled(large, connected_components(linked)).join(pairs, ["a", "b"], "left_anti"), "p5-rest")
        linked = linked.union(_checked(signed, rest))
    comps = connected_components(linked).select(F.col("node").alias("rep"), "component")
    named = signed.select("url", "id").join(_few(copies), "id", "left").select("url", F.coalesce("rep", "id").alias("rep"))
    named = named.join(comps, "rep", "left").select("url", F.coalesce("component", "rep").alias("c")).distinct()
    sized = named.groupBy("c").agg(F.min("url").alias("group"), F.count("*").alias("n")).where("n > 1").select("c", "group")
    return named.join(sized, "c").select("url", "group")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, SHUFFLED).select("url", "maintext", "source_domain"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = materialize(p5_groups(spark, sf_dir), "p5-groups")
    other = groups.withColumnRenamed("url", "url_b")
    return groups.withColumnRenamed("url", "url_a").join(other, "group").where("url_a < url_b").select("url_a", "url_b").distinct()


QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups}
