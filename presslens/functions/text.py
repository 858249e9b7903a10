"""Text cleaning as column expressions.

The steps of ``clean_nlp`` keep a fixed order, since later ones see what earlier
ones left: boilerplate, cedilla, tags, links, file names, quotations, numbers,
symbols, blanks. Null and blank texts give the empty string.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions that make a word a file reference.
FILE_EXTENSIONS = "pdf png jpg jpeg gif svg doc docx xls xlsx ppt pptx zip rar 7z mp4 mp3 txt exe".split()
# Characters that open or close a quotation, and symbols that are deleted.
QUOTES = "\"'„”‘’«»"
SYMBOLS = "*•·@~^_`+=\\|"

SPACE = r"(?U)[\s\x1c-\x1f]"
QUOTATION = f"(?s)[{QUOTES}]{{1,10}}[^{QUOTES}]{{1,1000}}?[{QUOTES}]{{1,10}}"


def load_patterns(lines: Iterable[str]) -> list[str]:
    """Patterns of a dictionary file: stripped lines, without blanks and ``#`` comments."""
    stripped = (x.strip() for x in lines)
    return [x for x in stripped if x and not x.startswith("#")]


def strip_boilerplate(c: Column, patterns: Iterable[str], fast: bool = False) -> Column:
    """Delete literal patterns, ignoring case, one after the other; ``fast`` uses one alternation instead."""
    quoted = ["\\Q" + p.replace("\\E", "\\E\\\\E\\Q") + "\\E" for p in patterns]
    if fast and quoted:
        return F.regexp_replace(c, "(?iu)" + "|".join(quoted), "")
    for q in quoted:
        c = F.regexp_replace(c, f"(?iu){q}", "")
    return c


def comma_letters(c: Column) -> Column:
    return F.translate(c, "ţşŢŞ", "țșȚȘ")


def strip_tags(c: Column) -> Column:
    """Delete ``<...>``; a tag that spans a line feed stays."""
    return F.regexp_replace(c, "(?d)<.*?>", "")


def strip_links(c: Column) -> Column:
    return F.regexp_replace(c, r"(?iuU)(https?://[^\s\x1c-\x1f]+|www\.[^\s\x1c-\x1f]+)", "")


def strip_files(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?iuU)\b[^\s\x1c-\x1f]+\.(?:{'|'.join(FILE_EXTENSIONS)})\b", "")


def _unescape(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    """Resolve HTML entities; only texts with an ampersand leave the JVM's own path."""
    resolve = F.pandas_udf(_unescape, "string")
    return F.when(F.contains(c, F.lit("&")), resolve(F.when(F.contains(c, F.lit("&")), c))).otherwise(c)


def strip_quotations(c: Column) -> Column:
    return F.regexp_replace(c, QUOTATION, "")


def strip_numbers(c: Column) -> Column:
    """Delete runs of digits that are words by themselves, unless they begin like a year from 2000 on."""
    return F.regexp_replace(c, r"(?U)\b(?!20\d{2})\d+\b", "")


def strip_symbols(c: Column) -> Column:
    return F.translate(c, SYMBOLS, "")


def collapse_blanks(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(r"(?U)[^\s\x1c-\x1f]")


def clean_nlp(c: Column, patterns: Iterable[str] = (), fast: bool = False, entities: bool = True) -> Column:
    """The cleaned text for models. ``entities=False`` leaves HTML entities, which saves the only Python step."""
    t = comma_letters(strip_boilerplate(c, patterns, fast))
    t = strip_files(strip_links(strip_tags(t)))
    if entities:
        t = unescape(t)
    t = collapse_blanks(strip_symbols(strip_numbers(strip_quotations(t))))
    return F.when(is_blank(c), "").otherwise(t)


def sentences(c: Column) -> Column:
    """Sentences by rule: a blank after ``. ! ? …``; pieces are trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?…])\s+"), lambda x: F.trim(x)), lambda x: x != "")


def mark_sentences(c: Column) -> Column:
    """Sentences with a lower-case first word, joined by ``PERIOD``."""

    def one(s: Column) -> Column:
        w = F.regexp_extract_all(s, F.lit(r"[^\s]+"), F.lit(0))
        return F.array_join(F.transform(w, lambda x, i: F.when(i == 0, F.lower(x)).otherwise(x)), " ")

    return F.array_join(F.transform(sentences(c), one), " PERIOD ")


def clean_ml(c: Column, patterns: Iterable[str] = (), fast: bool = False, entities: bool = True) -> Column:
    return mark_sentences(clean_nlp(c, patterns, fast, entities))


def word_count(c: Column) -> Column:
    """Words between blanks; 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(c, F.lit(r"[^\s]+"), F.lit(0))), F.lit(0))


def term_count(c: Column) -> Column:
    """Runs of letters, digits and underscores in any alphabet."""
    return F.coalesce(F.size(F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0))), F.lit(0))


def count_of(c: Column, part: str | Column) -> Column:
    """Occurrences of a substring, not overlapping; 0 for an empty one."""
    p = F.lit(part) if isinstance(part, str) else part
    return F.coalesce(((F.length(c) - F.length(F.replace(c, p, F.lit("")))) / F.nullif(F.length(p), F.lit(0))).cast("int"), F.lit(0))


def avg_sentence_length(c: Column) -> Column:
    """Mean words of the pieces between full stops that are not blank; 0 without any."""
    pieces = F.filter(F.split(c, r"\."), lambda x: x.rlike(r"[^\s]"))
    words = F.aggregate(pieces, F.lit(0), lambda a, x: a + F.size(F.regexp_extract_all(x, F.lit(r"[^\s]+"), F.lit(0))))
    return F.coalesce(F.try_divide(words.cast("double"), F.size(pieces)), F.lit(0.0))


def stance_word(c: Column) -> Column:
    """The stance that an answer names, in capitals; UNKNOWN without one."""
    found = F.regexp_extract(c, r"(?iuU)\b(pozitiv|negativ|neutru)\b", 1)
    return F.coalesce(F.upper(F.nullif(found, F.lit(""))), F.lit("UNKNOWN"))


def sentiment_label(c: Column) -> Column:
    found = F.regexp_extract(c, r"(?iuU)Sentiment:\s*(pozitiv|negativ|neutru)", 1)
    return F.coalesce(F.lower(F.nullif(found, F.lit(""))), F.lit("unknown"))


def sentiment_confidence(c: Column) -> Column:
    """The confidence of an answer; a bare 0 or 1 counts as none and gives 0."""
    found = F.regexp_extract(c, r"(?iuU)[îi]ncredere:\s*(0\.\d+|1\.0+)", 1)
    return F.coalesce(found.try_cast("double"), F.lit(0.0))


def tidy_token(c: Column) -> Column:
    """A model's token without punctuation around it and word-piece marks."""
    return F.replace(F.btrim(c, F.lit(" .,;:!?\"'()[]{}„”«»-")), F.lit("##"), F.lit(""))


def mentions(text: Column, entity: Column) -> Column:
    """Whether a text has an entity as whole words, ignoring case."""
    quoted = F.concat(F.lit(r"(?iuU)\b\Q"), F.replace(entity, F.lit("\\E"), F.lit("")), F.lit(r"\E\b"))
    return F.regexp_like(text, quoted)


def strip_fence(c: Column) -> Column:
    """An answer without Markdown code fences."""
    return F.trim(F.regexp_replace(c, r"(?m)^\s*```(?:json)?\s*|```\s*$", ""))


def first_json_map(c: Column) -> Column:
    """The longest ``{...}`` block of an answer that parses as a map of strings; keys and values trimmed."""
    blocks = F.array_sort(F.regexp_extract_all(strip_fence(c), F.lit(r"(?s)\{.*?\}"), F.lit(0)), lambda a, b: F.length(b) - F.length(a))
    parsed = F.filter(F.transform(blocks, lambda b: F.from_json(b, "map<string,string>")), lambda m: m.isNotNull() & (F.size(m) > 0))
    first = F.try_element_at(parsed, F.lit(1))
    pairs = F.transform(F.map_entries(first), lambda e: F.struct(F.trim(e.key).alias("k"), F.trim(e.value).alias("v")))
    # of keys that are one when trimmed, the last counts
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda x: x.k == e.k))
    return F.map_from_entries(last)


def parse_list(c: Column) -> Column:
    """A list of strings written as a Python literal; an empty list where it does not parse."""
    s = F.regexp_replace(c, r"(?<=[\[,]\s{0,3})None(?=\s{0,3}[,\]])", "null")
    return F.coalesce(F.from_json(s, "array<string>", {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}), F.array().cast("array<string>"))


def parse_stances(c: Column) -> Column:
    """A list of ``{entity, stance}`` written as a Python literal; tuples and records without a key are dropped."""
    s = F.regexp_replace(c, r"\((['\"])(.*?)\1, (['\"])(NO_ENTITY)\3\)", "{}")
    s = F.regexp_replace(s, r"(?<=: )None", "null")
    kind = "array<struct<entity: string, stance: string>>"
    got = F.from_json(s, kind, {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})
    return F.coalesce(F.filter(got, lambda x: x.entity.isNotNull() & x.stance.isNotNull()), F.array().cast(kind))


def url_slug(c: Column) -> Column:
    return F.replace(c, F.lit("."), F.lit("_"))


def truncate(c: Column, n: int = 7800) -> Column:
    """The first characters of a text on one line, as a prompt takes them."""
    return F.translate(F.substring(c, 1, n), "\n", " ")


def prompt(template: str, **values: Column) -> Column:
    """``{name}`` in a template replaced by columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.coalesce(values[p], F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def html_text(c: Column) -> Column:
    """Readable text of a page: scripts, styles, comments and tags off, entities resolved, block tags as line ends."""
    t = F.regexp_replace(c, r"(?is)<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr)\b[^>]*>", "\n")
    t = unescape(F.regexp_replace(t, r"(?s)<[^>]*>", ""))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\xA0]+", " "), r"\s*\n\s*", "\n")
    return F.coalesce(F.btrim(t, F.lit(" \n\t\r")), F.lit(""))
