"""One consistent written form for texts that look alike (problem 6).

Method: strings and code points that look alike (compatibility forms, a letter
with a separate combining mark and the composed letter, cedilla and comma
letters, look-alikes of other alphabets, the kinds of blanks, invisible
characters) are joined into classes by union-find, transitively; the
representative of a class is its most frequent regular member in the corpus;
an Aho-Corasick automaton over the irregular members rewrites each text
greedily, longest match first. Letters of another alphabet are rewritten, by a
second automaton, only within words that also have Latin letters. A text is
irregular where the rewriting has found something: a member of a class, a word
of several alphabets, or a mark that stays separate as no composed letter
stands for it.

Corpus counts are bounded by the code space: one counter for a code point and
one for each pair of letter and mark that Unicode composes. Only texts that
have a character which can begin an irregularity reach the automaton; that
test looks at every character of every text.

Nulls stay null and are never found; the empty text is regular. Repeated rows
of a url count once. Extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presslens.llm import textvec as tv
from presslens.session import table

SHUFFLED, NER = "romanian_political_articles_v2_shuffled", "romanian_political_articles_v2_ner"
PLAIN_BLANKS = " \t\n\r"

# S and t with cedilla, and the comma letters meant by them.
CEDILLA = dict(zip("şŞţŢ", "șȘțȚ", strict=True))
_CEDILLA_SPELT = {"ş": "ș", "Ş": "Ș", "ţ": "ț", "Ţ": "Ț"}


@lru_cache(maxsize=None)
def single(c: str) -> str | None:
    """Plain form of a character that is irregular by itself; None for a regular one."""
    kind = unicodedata.category(c)
    if c in CEDILLA:
        return CEDILLA[c]
    if kind in ("Cf", "Cc") and c not in PLAIN_BLANKS:
        return " " if c in "\x0b\x0c\x1c\x1d\x1e\x1f\x85" else ""
    if kind in ("Zs", "Zl", "Zp"):
        return None if c == " " else " "
    tag = unicodedata.decomposition(c).partition(" ")[0]
    plain = unicodedata.normalize("NFKC", c)
    if plain == c or kind[0] == "M" or plain.startswith(" "):
        return None
    if kind[0] == "P" and tag not in ("<wide>", "<narrow>", "<small>", "<vertical>"):
        return None
    return plain


@lru_cache(maxsize=None)
def alphabet(c: str) -> str:
    """``LATIN``, ``GREEK`` ... for a letter; empty for all else."""
    if unicodedata.category(c) not in ("Lu", "Ll", "Lt", "Lo"):
        return ""
    return unicodedata.name(unicodedata.normalize("NFKC", c)[0], "").partition(" ")[0] or "?"


def _trigger(c: int) -> int:
    """1 irregular by itself, 2 mark, 4 letter of another alphabet, 8 letter."""
    if 0xD800 <= c < 0xE000:
        return 0
    x = chr(c)
    k = unicodedata.category(x)
    a = alphabet(x)
    return (single(x) is not None) + 2 * (k == "Mn") + 4 * (a not in ("", "LATIN")) + 8 * (k[0] == "L")


_triggers = tv._Lazy(np.int8, _trigger)


class Classes:
    """Union-find over strings."""

    def __init__(self):
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: str, y: str) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.up):
            out.setdefault(self.find(x), []).append(x)
        return out


def regular(s: str) -> bool:
    return not any(single(c) is not None for c in s) and not (len(s) > 1 and any(unicodedata.category(c) == "Mn" for c in s))


def build_rules(counts: dict[str, int]) -> tuple[dict[str, str], dict[str, str]]:
    """From corpus counts of code points and letter-mark pairs: rewrites of irregular strings, and of letters of other alphabets."""
    near, foreign = Classes(), Classes()
    units = set(counts) | set(CEDILLA) | set(_CEDILLA_SPELT)
    for u in units:
        plain = _CEDILLA_SPELT.get(u)
        if plain is None:
            plain = unicodedata.normalize("NFC", u) if len(u) > 1 else single(u)
        if plain is not None and plain != u:
            near.join(u, plain)
            if len(u) == 1 and len(plain) == 1 and u in CEDILLA:
                near.join(u, unicodedata.normalize("NFD", u))
    rewrites = {}
    for members in near.members().values():
        good = [m for m in members if regular(m)] or [unicodedata.normalize("NFKC", min(members))]
        best = min(good, key=lambda m: (-counts.get(m, 0), m))
        rewrites |= {m: best for m in members if m != best and not regular(m)}
    for x, y in tv.LOOKALIKE.items():
        foreign.join(x, y)
    letters = {}
    for members in foreign.members().values():
        latin = [m for m in members if alphabet(m) == "LATIN"]
        best = min(latin, key=lambda m: (-counts.get(m, 0), m))
        letters |= {m: best for m in members if alphabet(m) != "LATIN"}
    return rewrites, letters


_WORD = regex.compile(r"[\p{L}\p{M}]+")


class Rewriter:
    """Rewrites texts; made once in each worker from the rules."""

    def __init__(self, rewrites: dict[str, str], letters: dict[str, str]):
        import ahocorasick

        self.machine, self.letters = (self._made(ahocorasick.Automaton(), x) for x in (rewrites, letters))

    @staticmethod
    def _made(machine, rules):
        for x, y in rules.items():
            machine.add_word(x, (len(x), y))
        if rules:
            machine.make_automaton()
        return machine if rules else None

    def __call__(self, text: str) -> tuple[str, bool]:
        """(text in the one form, whether anything irregular was found in it)."""
        text, first = self._plain(self.machine, text)
        text, second = self._plain(self.machine, unicodedata.normalize("NFC", text))
        touched = first or second

        def word(m):
            nonlocal touched
            touched |= any(unicodedata.category(c) == "Mn" for c in m[0][1:])
            kinds = {a for c in m[0] if (a := alphabet(c))}
            if len(kinds) > 1 and "LATIN" in kinds:
                touched = True
                return unicodedata.normalize("NFC", self._plain(self.letters, m[0])[0])
            return m[0]

        return _WORD.sub(word, text), touched

    @staticmethod
    def _plain(machine, text: str) -> tuple[str, bool]:
        out, done = [], 0
        if machine is not None:
            for end, (n, plain) in machine.iter_long(text):
                out += (text[done : end - n + 1], plain)
                done = end + 1
        if not done:
            return text, False
        out.append(text[done:])
        return "".join(out), True


def _row_any(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(flag)])
    return upto[offsets[1:]] > upto[offsets[:-1]]


def rewriter(rules, keep_all: bool):
    """mapInArrow function: (item, text) -> (item, text, irregular); without ``keep_all`` irregular rows only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = Rewriter(*rules)
        for batch in batches:
            for b, e in tv.chunks(batch.column(1)):
                item, text = batch.column(0).slice(b, e - b), batch.column(1).slice(b, e - b)
                codes, offsets = tv.codes_of(text)
                t = _triggers(codes)
                mark = (t & 2) > 0
                if mark.any():
                    mark[1:] &= (t[:-1] & 10) > 0
                    if len(mark):
                        mark[0] = False
                    mark[offsets[:-1][offsets[:-1] < len(mark)]] = False
                bad = _row_any((t & 1) > 0, offsets) | _row_any(mark, offsets)
                look = bad | _row_any((t & 4) > 0, offsets)
                plain, irregular = (text.to_pylist() if keep_all else [None] * len(text)), np.zeros(len(text), bool)
                for i in np.flatnonzero(look):
                    plain[i], irregular[i] = write(text[i].as_py())
                made = pa.RecordBatch.from_arrays([item, pa.array(plain, pa.string()), pa.array(irregular)], ["item", "text", "irregular"])
                yield made if keep_all else made.filter(pa.array(irregular))

    return run


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, pairs = np.zeros(0x110000, np.int64), {}
    for batch in batches:
        for b, e in tv.chunks(batch.column(0)):
            codes, offsets = tv.codes_of(batch.column(0).slice(b, e - b))
            if len(codes) == 0:
                continue
            n = np.bincount(codes)
            total[: len(n)] += n
            at = np.flatnonzero((_triggers(codes) & 2) > 0)
            at = at[at > 0]
            both, k = np.unique(codes[at - 1].astype(np.uint64) << np.uint64(32) | codes[at], return_counts=True)
            for x, m in zip(both.tolist(), k.tolist()):
                s = chr(x >> 32) + chr(x & 0xFFFFFFFF)
                if len(unicodedata.normalize("NFC", s)) == 1:
                    pairs[s] = pairs.get(s, 0) + m
    seen = np.flatnonzero(total)
    units = [chr(c) for c in seen] + list(pairs)
    yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array([*total[seen].tolist(), *pairs.values()], pa.int64())], ["unit", "n"])


def corpus_rules(texts: list[DataFrame]):
    """Rules from the counts over all given one-column tables of text."""
    counted = None
    for t in texts:
        part = t.toDF("text").mapInArrow(_count_units, "unit string, n bigint")
        counted = part if counted is None else counted.unionByName(part)
    rows = counted.groupBy("unit").agg(F.sum("n").alias("n")).collect()  # at most the code space and its composed pairs
    return build_rules({r["unit"]: r["n"] for r in rows})


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    texts = table(spark, sf_dir, SHUFFLED).where("url is not null and maintext is not null").select(F.col("url").alias("item"), F.col("maintext").alias("text"))
    names = table(spark, sf_dir, NER).select(F.explode("ner").alias("item")).where("item is not null").distinct().withColumn("text", F.col("item"))
    return texts, names


def _forms(spark: SparkSession, sf_dir: str, keep_all: bool) -> DataFrame:
    texts, names = _inputs(spark, sf_dir)
    rules = corpus_rules([texts.select("text"), names.select("text")])
    made = [
        part.mapInArrow(rewriter(rules, keep_all), "item string, text string, irregular boolean").select(F.lit(field).alias("field"), "item", "text", "irregular")
        for field, part in (("maintext", texts), ("ner", names))
    ]
    return made[0].unionByName(made[1])


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir, keep_all=False).select("field", "item").distinct()


def p6_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(field, item, text)``: every article and name in the one form."""
    return _forms(spark, sf_dir, keep_all=True).groupBy("field", "item").agg(F.max("text").alias("text"))


QUERIES = {"p6_found": p6_found, "p6_forms": p6_forms}
