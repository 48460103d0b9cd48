"""Titles, words and bigrams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_WORD = r"[^\p{L}\p{N}]+"
TITLE_KEY_CHARS, TITLE_CHARS = 5, 4


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def ellipsis(text: Column, most: int = 130) -> Column:
    """Squeezed text, cut after so many characters with '…' at the end."""
    flat = squeeze(text)
    return F.when(F.char_length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def clean_title(title: Column) -> Column:
    """Squeezed title without a comment count like [12] or (3) at its end."""
    return F.trim(F.regexp_replace(squeeze(title), r"\s*[\[(]\s*[0-9,]+\s*[\])]\s*$", ""))


def title_key(source: Column, title: Column) -> Column:
    """'source|letters and digits in lower case', empty if under five characters are left."""
    plain = F.lower(F.regexp_replace(F.coalesce(title, F.lit("")), NOT_WORD, ""))
    return F.when(F.char_length(plain) >= TITLE_KEY_CHARS, F.concat(F.coalesce(source, F.lit("None")), F.lit("|"), plain)).otherwise("")


def bracket_tags(title: Column) -> Column:
    """Texts in square brackets, in order."""
    return F.regexp_extract_all(title, F.lit(r"\[([^\[\]]+)\]"), F.lit(1))


def bigrams(text: Column) -> Column:
    """Sorted distinct pairs of neighbouring Hangul, Latin letters and digits, in lower case; empty for shorter texts."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^0-9a-z가-힣]", "")
    n = F.char_length(plain)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(plain, i, F.lit(2)))
    return F.when(n >= 2, F.array_sort(F.array_distinct(pairs))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / union).otherwise(0.0)


def words(text: Column, least: int = 2) -> Column:
    """Distinct lower-case words of at least so many letters or digits."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD)
    return F.array_distinct(F.filter(parts, lambda w: F.char_length(w) >= least))


def headings(markdown: Column, most: int = 3) -> Column:
    """First '## ' headings of a Markdown text."""
    return F.slice(F.regexp_extract_all(markdown, F.lit(r"(?m)^##[ \t]+([^\n]+)$"), F.lit(1)), 1, most)
