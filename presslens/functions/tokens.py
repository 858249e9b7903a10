"""Tokens and n-grams as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frequent Romanian function words, chosen by us.
ROMANIAN_STOP_WORDS = (
    "a acea aceasta această aceea acei aceia acel acela acele acelea acest acesta aceste acestea acestei acestor acestui acești aceștia acolo acum ai aia al ale alt alta alte altul am ar are as asta astfel asupra au avea avem aveți azi aș ați "
    "ba bine ca care cat ce cea cei cel cele celor chiar cine ci cu cum cât când către da dacă dar de deci decât deja despre din dintr dintre doar după ea ei el ele era erau este eu fi fie fiecare fiind foarte fost fără face i ia iar ii il imi in "
    "insa intre isi iti la le li lor lui lângă mai mea mei mele mereu meu mi mult multe mulți mă ne nici niciun nimic niște noastre noi nostru nu o ori orice pe pentru peste poate pot prea prin printr sa sau se sunt suntem spre sub să săi său sale "
    "te ti toate tot totul totuși toți tu un una unde unei unele unii unor unu unui unul va vom vor voi vreo vă ăla ăsta îi îl îmi împotriva în încă înainte îns însă între îți și ți"
).split()

TOKEN = r"[\p{L}\p{N}\-]+"


def tokens(c: Column) -> Column:
    """Words made of letters and hyphens, with a letter at least; the case stays."""
    return F.filter(F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0)), lambda x: F.replace(x, F.lit("-"), F.lit("")).rlike(r"^\p{L}+$"))


def bound(c: Column, use) -> Column:
    """``use(c)`` with ``c`` evaluated once a row, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(c), use), 1)


def _flagged(words: Column, stop: Iterable[str]) -> Column:
    """Words with a flag on those that are stop words, looked up once a word."""
    stop = list(stop)
    return F.transform(words, lambda w: F.struct(w.alias("w"), (F.lower(w).isin(*stop) if stop else F.lit(False)).alias("s")))


def _ngrams(flagged: Column, n: int) -> Column:
    last = F.size(flagged) - n
    grams = F.transform(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), lambda i: F.slice(flagged, i + 1, n))
    return F.array_distinct(F.transform(F.filter(grams, lambda g: F.array_contains(g["s"], False)), lambda g: F.array_join(g["w"], " ")))


def ngrams(words: Column, n: int, stop: Iterable[str] = ()) -> Column:
    """Distinct n-grams over an array of words; those of stop words only are left out."""
    return bound(_flagged(words, stop), lambda w: _ngrams(w, n))


def phrase_set(words: Column, sizes: Iterable[int] = (1, 2, 3), stop: Iterable[str] = (), barrier: str | None = "PERIOD") -> Column:
    """The set of n-grams of the given sizes; those that hold the sentence barrier are left out."""
    out = bound(_flagged(words, stop), lambda w: F.flatten(F.array(*(_ngrams(w, n) for n in sizes))))
    return out if barrier is None else F.filter(out, lambda g: ~F.contains(g, F.lit(barrier)))


def gram_size(c: Column) -> Column:
    return F.size(F.split(c, " "))


def chunk_sentences(sents: Column, cap: int) -> Column:
    """Greedy chunks of sentences under a cap of words; a first sentence beyond it leaves an empty first chunk."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))

    def step(a, s):
        n = F.size(F.regexp_extract_all(s, F.lit(r"[^\s]+"), F.lit(0)))
        over = a.n + n > cap
        return F.struct(
            F.when(over, F.concat(a.done, F.array(a.open))).otherwise(a.done).alias("done"),
            F.when(over, s).otherwise(F.when(a.open == "", s).otherwise(F.concat(a.open, F.lit(" "), s))).alias("open"),
            F.when(over, n).otherwise(a.n + n).alias("n"),
        )

    return F.aggregate(sents, start, step, lambda a: F.when(a.open != "", F.concat(a.done, F.array(a.open))).otherwise(a.done))


def sentence_prefix(sents: Column, cap: int) -> Column:
    """The longest prefix of sentences within a cap of words."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(a, s):
        n = F.size(F.regexp_extract_all(s, F.lit(r"[^\s]+"), F.lit(0)))
        fits = a.open & (a.n + n <= cap)
        return F.struct(F.when(fits, F.concat(a.kept, F.array(s))).otherwise(a.kept).alias("kept"), F.when(fits, a.n + n).otherwise(a.n).alias("n"), fits.alias("open"))

    return F.aggregate(sents, start, step, lambda a: a.kept)
