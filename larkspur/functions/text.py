"""Columns over texts: words, sentences, statistics, readability, cleaning, summaries, chunks.

Words are runs of Unicode letters, digits and ``_``. Null texts are taken as empty. Rounding is
floor(x * 10**n + 0.5) / 10**n, the same in every engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
BLANK = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"
#: Words that are no common words, word lists and phrases of the language helpers.
STOP = ("the", "and", "a", "an", "in", "on", "at", "to", "for", "of", "is", "are")
INDICATORS = {
    "en": ("the", "and", "is", "to", "of"),
    "es": ("el", "la", "y", "en", "de"),
    "fr": ("le", "la", "et", "en", "de"),
    "de": ("der", "die", "das", "und", "in"),
}
PHRASES = {
    "hello": {"es": "hola", "fr": "bonjour", "de": "hallo", "it": "ciao", "pt": "olá"},
    "goodbye": {"es": "adiós", "fr": "au revoir", "de": "auf wiedersehen", "it": "arrivederci", "pt": "adeus"},
    "thank you": {"es": "gracias", "fr": "merci", "de": "danke", "it": "grazie", "pt": "obrigado"},
}
LANGUAGES = ("en", "es", "fr", "de", "it", "pt", "ru", "zh", "ja", "ko", "ar")


def given(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def rnd(x: Column, n: int) -> Column:
    scale = F.lit(float(10**n))
    return F.floor(x * scale + F.lit(0.5)) / scale


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(given(text), F.lit(WORD), F.lit(0))


def tokens(text: Column) -> Column:
    """Whitespace-separated tokens."""
    return F.regexp_extract_all(given(text), F.lit(r"[^\s\p{Z}\x0b\x1c-\x1f\x85]+"), F.lit(0))


def sentences(text: Column) -> Column:
    pieces = F.transform(F.split(given(text), r"[.!?]+"), strip)
    return F.filter(pieces, lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(given(text), rf"\n{BLANK}*\n"), lambda p: strip(p) != "")


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def lengths(ws: Column) -> Column:
    return F.transform(ws, F.length)


def per(a: Column, b: Column) -> Column:
    """a / b as doubles, 0 where b is 0."""
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def syllables(ws: Column) -> Column:
    """Runs of lower-case vowels in each word, one at least, summed."""
    return total(F.transform(ws, lambda w: F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouy]+")))))


def reading_level(flesch: Column) -> Column:
    bands = ((90, "Very Easy (5th grade)"), (80, "Easy (6th grade)"), (70, "Fairly Easy (7th grade)"), (60, "Standard (8th-9th grade)"), (50, "Fairly Difficult (10th-12th grade)"), (30, "Difficult (College)"))
    return reduce(lambda rest, b: F.when(flesch >= b[0], b[1]).otherwise(rest), reversed(bands), F.lit("Very Difficult (Graduate)"))


def clean(text: Column) -> Column:
    """Blanks collapsed; punctuation spacing and repeats mended only where that changed the length.

    A stripped text keeps its length if each of its blanks stands alone.
    """
    squeezed = strip(F.regexp_replace(given(text), f"{BLANK}+", " "))
    out = F.regexp_replace(squeezed, r" ([.,!?;:])", "$1")
    out = F.regexp_replace(F.regexp_replace(out, r"\( ", "("), r" \)", ")")
    out = F.regexp_replace(out, r"([.,!?])\1+", "$1")
    return F.when(strip(given(text)).rlike(BLANK + "{2}"), out).otherwise(squeezed)


def ingest_clean(text: Column) -> Column:
    out = F.replace(F.replace(given(text), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    for pattern, by in ((r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n"), (r"[^\x00-\x7F]+", " "), (r"[^A-Za-z0-9_ \t\f.,!?;:()\-/\n]+", "")):
        out = F.regexp_replace(out, pattern, by)
    return F.btrim(out, F.lit(" \t\n\x0b\f\r\x1c\x1d\x1e\x1f"))


def first_n(text: Column, n: int) -> Column:
    """The first n characters, cut after the last sentence end in them unless that is the first."""
    head = F.substring(given(text), 1, n)
    cut = F.regexp_extract(head, r"(?s)^(.*[.!?])", 1)
    return F.when(F.length(given(text)) <= n, head).otherwise(F.when(F.length(cut) > 1, cut).otherwise(head))


def strategy(text: Column) -> Column:
    low = F.lower(given(text))
    research = reduce(lambda a, w: a | low.contains(w), ("research", "data", "analysis"), low.contains("study"))
    return F.when(F.size(tokens(text)) < 50, "first_n").otherwise(F.when(research, "extractive").otherwise("key_sentences"))


def retention(original: Column, summary: Column) -> Column:
    o, s = (F.array_distinct(F.transform(words(c), F.lower)) for c in (original, summary))
    return rnd(per(F.size(F.array_intersect(o, s)), F.greatest(F.size(o), F.lit(1))), 3)


def language_scores(text: Column) -> dict[str, Column]:
    low = F.lower(given(text))
    return {lang: reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in ws]) for lang, ws in INDICATORS.items()}


def detected_language(text: Column) -> tuple[Column, Column]:
    """(language, confidence): most indicators contained, the first of equals."""
    scores = language_scores(text)
    best = F.greatest(*scores.values())
    lang = reduce(lambda rest, kv: F.when(kv[1] == best, kv[0]).otherwise(rest), reversed(list(scores.items())), F.lit("en"))
    return lang, F.least(best.cast("double") / F.lit(5.0), F.lit(1.0))


def translate_mock(text: Column, target: str) -> Column:
    """The first phrase contained is looked up, and left as it is without an entry; else a mark goes before the text."""
    low = F.lower(strip(given(text)))
    mark = given(text) if target == "en" else F.concat(F.lit(f"[{target.upper()}: "), given(text), F.lit("]"))
    return reduce(lambda rest, p: F.when(low.contains(p), F.lit(PHRASES[p][target]) if target in PHRASES[p] else given(text)).otherwise(rest), reversed(list(PHRASES)), mark)


def chunks_fixed(text: Column, size: int = 800, overlap: int = 100, least: int = 50) -> Column:
    """Fixed windows of a stripped text that reach back by ``overlap``; the last ends with the text, short ones go."""
    t = text
    n = F.length(t)
    last = F.greatest(F.ceil(n / F.lit(float(size))).cast("int") - 1, F.lit(0))

    def piece(i: Column) -> Column:
        a = F.greatest(i * size - overlap, F.lit(0))
        return strip(F.substring(t, a + 1, F.when(i == last, n - a).otherwise((i + 1) * size - a)))

    return F.filter(F.transform(F.sequence(F.lit(0), last), piece), lambda c: F.length(c) >= least)


def sanitize(text: Column) -> Column:
    return strip(F.translate(text, "<>&\"'", ""))


def clean_filename(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r'[<>:"/\\|?*]', "_"), r"^ +| +\z", ""), r"^\.+|\.+\z", "")


def at_least(summary: Column, text: Column, n: int) -> Column:
    """The summary, or the text's first n sentences where the summary has fewer than n."""
    return F.when(F.size(sentences(summary)) < n, F.array_join(F.slice(sentences(text), 1, n), " ")).otherwise(given(summary))


def merge(left: Column, right: Column) -> Column:
    """Both maps in one; where both have a key, the right one's value counts. A null map is empty."""
    own = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    return F.when(right.isNull(), left).when(left.isNull(), right).otherwise(F.map_concat(own, right))


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and no more; null and empty texts are not.

    The parser stops after a first value, so the text is parsed inside an array and inside an object:
    no text with a remainder is whole in both.
    """
    inside = [F.try_parse_json(F.concat(F.lit(a), given(text), F.lit(b))).isNotNull() for a, b in (("[", "]"), ('{"v":', "}"))]
    return inside[0] & inside[1] & (F.trim(given(text)) != "")
