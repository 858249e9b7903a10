"""Oversized documents cut into pieces at natural boundaries (problem 10).

Method: lexical-cohesion segmentation. For every boundary (section, paragraph,
sentence, word) the likeness of the ``BLOCK`` words before and after it is
measured; a valley's depth is how far it lies below the peaks on both sides.
Within each size window the highest kind of boundary that occurs is taken, and
of these the deepest valley; the next piece begins about ``OVERLAP`` tokens
before the cut, at a boundary again. A run without any boundary (one endless
word) is cut between characters.

Only a text of more than ``LIMIT`` bytes can have more than ``LIMIT`` tokens,
as every token has a byte; the others are not tokenized. Null, empty and small
texts give no piece; repeated texts give pieces under each id. Extra columns
are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.llm import bpe
from presslens.session import table

LIMIT, OVERLAP = 2048, 128
SLACK = 16  # tokens that the ends of a piece may add when it is encoded by itself; doubled where that is not enough
BLOCK, STEP = 60, 20  # words on each side of a boundary; words between measured places
WORD, SENTENCE, PARAGRAPH, SECTION = 1, 2, 3, 4

_SPLIT = regex.compile(bpe.PATTERN)
_SECTION = regex.compile(r"(?<=\n)(?=#{1,6} |[^\n]{1,80}\n[=-]{3,}(?:\n|$))|(?<=\n\s*\n)(?=\p{Lu}[\p{Lu}\s]{3,60}\n)")
_PARAGRAPH = regex.compile(r"(?<=\n)(?=\S)")
_SENTENCE = regex.compile(r"(?<=[.!?…;][\"”»’)]?)\s+(?=\S)")
_WORDS = regex.compile(r"\p{L}{3,}")


def boundaries(text: str) -> dict[int, int]:
    """Places in a text where it may be cut, with their kinds; a place is where the next piece begins."""
    found: dict[int, int] = {}
    for m in _SENTENCE.finditer(text):
        found[m.end()] = SENTENCE
    for m in _PARAGRAPH.finditer(text):
        found[m.start()] = PARAGRAPH
    for m in _SECTION.finditer(text):
        found[m.start()] = SECTION
    found.pop(0, None)
    return found


class Cohesion:
    """Depth of the valley in the likeness of neighbouring blocks of words, by place in the text."""

    def __init__(self, text: str):
        words = [(m.start(), m[0].casefold()) for m in _WORDS.finditer(text)]
        self.at = [a for a, _ in words[STEP::STEP]]
        groups = [Counter(w for _, w in words[i : i + STEP]) for i in range(0, len(words), STEP)]
        k = BLOCK // STEP
        like = []
        for i in range(1, len(groups)):
            left, right = Counter(), Counter()
            for g in groups[max(0, i - k) : i]:
                left.update(g)
            for g in groups[i : i + k]:
                right.update(g)
            dot = sum(n * right[w] for w, n in left.items())
            like.append(dot / (sqrt(sum(n * n for n in left.values()) * sum(n * n for n in right.values())) or 1.0))
        self.depth = []
        for i, s in enumerate(like):
            a = b = i
            while a > 0 and like[a - 1] >= like[a]:
                a -= 1
            while b + 1 < len(like) and like[b + 1] >= like[b]:
                b += 1
            self.depth.append(like[a] + like[b] - 2 * s)

    def __call__(self, place: int) -> float:
        if not self.at:
            return 0.0
        i = bisect_left(self.at, place)
        near = [j for j in (i - 1, i) if 0 <= j < len(self.at)]
        return self.depth[min(near, key=lambda j: abs(self.at[j] - place))]


def pieces_of(text: str, count, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """(begin, end, tokens) of the pieces of a text; each is counted by itself, and the text is cut again with more slack if one has too many."""
    slack = min(SLACK, limit // 8)
    while True:
        made = [(b, e, count(text[b:e])) for b, e in cut(text, count, limit, overlap, slack)]
        if slack >= limit // 2 or all(n <= limit for _, _, n in made):
            return made
        slack = min(2 * slack + 1, limit // 2)


def cut(text: str, count, limit: int = LIMIT, overlap: int = OVERLAP, slack: int = SLACK) -> list[tuple[int, int]]:
    """(begin, end) of the pieces of a text. ``count``: tokens of a string."""
    slack = min(slack, limit // 2)
    places, sizes, known = [0], [], {}
    for m in _SPLIT.finditer(text):
        w = m[0]
        if w not in known:
            known[w] = count(w)
        if known[w] <= limit // 4:
            places.append(m.end())
            sizes.append(known[w])
        else:  # an endless word: steps of a few characters, counted by themselves
            for b in range(m.start(), m.end(), 8):
                e = min(b + 8, m.end())
                places.append(e)
                sizes.append(count(text[b:e]))
    upto = np.concatenate([[0], np.cumsum(sizes)])
    kinds = np.zeros(len(places), np.int8)
    for i, p in enumerate(places[1:-1], 1):
        if text[p].isspace() or text[p - 1].isspace():
            kinds[i] = WORD
    for p, k in boundaries(text).items():
        i = bisect_left(places, p)
        if 0 < i < len(places) - 1:
            # a boundary lies before the blank that the next word carries, or at the word
            i = i if places[i] == p else i - 1
            kinds[i] = max(kinds[i], k) if i else 0
    depth = Cohesion(text)
    pieces, begin, least = [], 0, 0
    last = len(places) - 1
    while upto[last] - upto[begin] > limit - slack:
        top = bisect_right(upto, upto[begin] + limit - slack) - 1
        low = max(least + 1, bisect_left(upto, upto[begin] + (limit - slack) // 2))
        low = min(low, top)
        window = range(low, top + 1)
        best = max(kinds[i] for i in window)
        ends = [i for i in window if kinds[i] == best]
        end = max(ends, key=lambda i: (depth(places[i]), i)) if best else top
        end = max(end, begin + 1)
        pieces.append((places[begin], places[end]))
        least = end
        # the next piece begins about ``overlap`` tokens before the cut
        wanted = upto[end] - overlap
        near = [i for i in range(begin + 1, end) if wanted - overlap // 2 <= upto[i] <= wanted + overlap // 2]
        kind = max((kinds[i] for i in near), default=0)
        near = [i for i in near if kinds[i] == kind]
        begin = min(near, key=lambda i: (abs(upto[i] - wanted), i)) if near else max(begin + 1, bisect_right(upto, wanted) - 1)
        begin = min(begin, end)
    pieces.append((places[begin], places[last]))
    return pieces


def cutter(path: str, name: str, limit: int, overlap: int):
    """mapInArrow function: (doc_id, text) -> pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.encoding(path, name)
        count = lambda s: len(coder.encode_ordinary(s))
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if count(text) <= limit:
                    continue
                before = 0
                for k, (b, e, n) in enumerate(pieces_of(text, count, limit, overlap)):
                    rows.append((doc, k, b, e, n, count(text[b:before]) if b < before else 0, text[b:e]))
                    before = e
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], PIECE_NAMES)

    return run


PIECE_NAMES = ["doc_id", "piece", "begin_char", "end_char", "tokens", "overlap", "text"]
PIECES = "doc_id bigint, piece int, begin_char bigint, end_char bigint, tokens int, overlap int, text string"


def pieces(documents: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, path: str = bpe.TOKENIZERS, name: str = bpe.VOCABULARY) -> DataFrame:
    """Pieces of every document of more than ``limit`` tokens; each of at most ``limit``, sharing ``overlap`` or so with the one before."""
    large = documents.where(F.octet_length("text") > limit).select("doc_id", "text")
    return large.mapInArrow(cutter(path, name, limit, overlap), PIECES)


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "documents"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_pieces(spark, sf_dir).where("piece = 0").select("doc_id").distinct()


QUERIES = {"p10_found": p10_found, "p10_pieces": p10_pieces}
