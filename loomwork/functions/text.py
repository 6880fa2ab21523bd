"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that white-space trimming removes besides the zero-width ones.
ZERO_WIDTH = "​‌‍﻿"
WHITE = " \t\n\x0b\x0c\r "


def normalized_words(text: Column) -> Column:
    """Lower-case words of Latin and Cyrillic letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-zа-яё0-9]+"), 0)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once: inside lambdas Spark would evaluate it again for each element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def windows(items: Column, k: int, separator: str) -> Column:
    """Each k items in a row, joined; none where there are fewer."""
    return let(
        items,
        lambda a: F.when(F.size(a) < k, F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(a) - k), lambda i: F.array_join(F.slice(a, i + 1, k), separator))
        ),
    )


def trigrams(text: Column) -> Column:
    """Distinct word trigrams."""
    return F.array_distinct(windows(normalized_words(text), 3, " "))


def line_shingles(text: Column, k: int = 10) -> Column:
    """Each k lines in a row, blank lines left out."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: F.btrim(s, F.lit(WHITE))), lambda s: s != "")
    return windows(lines, k, "\n")


def normalized_lines(text: Column) -> Column:
    """Lines in lower case with dates and numbers masked and white space collapsed; blank lines left out."""

    def clean(s: Column) -> Column:
        s = F.regexp_replace(F.lower(s), "[0-9]+(?:[./:-][0-9]+)+", "<date>")
        s = F.regexp_replace(s, "[0-9]+", "<num>")
        return F.btrim(F.regexp_replace(s, "[ \t\r\x0b\x0c]+", " "))

    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), clean), lambda s: s != "")


def content_shingles(text: Column, k: int = 3) -> Column:
    """Distinct runs of k normalized lines, or the distinct lines where there are fewer."""
    return let(normalized_lines(text), lambda a: F.array_distinct(F.when(F.size(a) < k, a).otherwise(windows(a, k, "\n"))))


def jaccard(left: Column, right: Column) -> Column:
    """Of two arrays as sets: 1 if both are empty, 0 if one is."""
    return F.when((F.size(left) == 0) & (F.size(right) == 0), 1.0).otherwise(F.size(F.array_intersect(left, right)) / F.size(F.array_union(left, right)))


def effectively_unchanged(old: Column, new: Column, least: float = 0.9) -> Column:
    """Equal, or alike in lines; a blank side is a change."""
    blank = lambda c: F.coalesce(F.btrim(c, F.lit(WHITE)), F.lit("")) == ""
    return F.when(blank(old) | blank(new), False).otherwise((old == new) | (jaccard(content_shingles(old), content_shingles(new)) >= least))


def chunk_hash(text: Column) -> Column:
    """SHA-256 of a chunk's text without zero-width characters and outer white space."""
    return F.sha2(F.btrim(F.translate(F.coalesce(text, F.lit("")), ZERO_WIDTH, ""), F.lit(WHITE)), 256)


def low_content(text: Column, most_words: int = 40, most_chars: int = 250) -> Column:
    """Few words and few characters; an empty text is not low but missing."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return (t != "") & (F.size(F.split(t, "[ \t\n\x0b\x0c\r]+")) <= most_words) & (F.length(t) <= most_chars)


def cache_question(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[ \t\n\x0b\x0c\r]+", " "))


def preview(text: Column, most: int = 150) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("...")))


def word_preview(text: Column, most: int = 500) -> Column:
    """At most so many characters, cut at the last space where there is one."""
    head = F.substring(text, 1, most)
    cut = F.regexp_extract(head, "(?s)^(.*)[ \n\t]", 1)
    return F.when(F.length(text) <= most, text).when(cut != "", F.rtrim(cut)).otherwise(head)


def safe_cell(value: Column) -> Column:
    """A CSV cell that no spreadsheet takes for a formula."""
    return F.when(value.rlike("^[=+\\-@\t\r\n]"), F.concat(F.lit("'"), value)).otherwise(value)


def bytes_text(n: Column) -> Column:
    """A size in B, KB, MB or GB with one decimal."""
    f = lambda d, unit: F.concat(F.format_string("%.1f", n / d), F.lit(unit))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, f(1024.0, " KB")).when(n < 1 << 30, f(float(1 << 20), " MB")).otherwise(f(float(1 << 30), " GB"))


def uniqueness_percent(overlap: Column, total: Column) -> Column:
    """100 where there is nothing to compare; half to even."""
    return F.when(total == 0, F.lit(100)).otherwise(F.bround(100.0 * (1 - overlap / total), 0).cast("int"))


def citations(answer: Column) -> Column:
    """Numbers n of [[citation:n]] in order."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[\[citation:([0-9]+)\]\]"), 1), lambda s: s.cast("int"))


def snippet(text: Column, most: int = 2600) -> Column:
    """One line without backquotes and role prefixes."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), "[ \t\n\x0b\x0c\r]+", " ")
    s = F.translate(s, "`", '"')
    s = F.regexp_replace(s, "(?i)^ *(system|assistant|user|developer) *: *", "")
    return F.substring(F.btrim(s), 1, most)


def entity_terms(text: Column, most: int = 12) -> Column:
    """Capitalised words and words with a digit, dot, underscore or hyphen inside, lower-cased, first ones first."""
    found = F.regexp_extract_all(F.substring(F.coalesce(text, F.lit("")), 1, 24_000), F.lit(r"([A-Z][A-Za-z]{2,}|[A-Za-z]+[0-9._-][A-Za-z0-9._-]*[A-Za-z0-9])"), 1)
    return F.slice(F.array_distinct(F.transform(found, lambda s: F.lower(s))), 1, most)


def trivial_query(text: Column) -> Column:
    """A greeting, thanks or farewell that needs no retrieval."""
    return F.coalesce(text, F.lit("")).rlike(r"(?i)^\s*(hi|hello|hey|thanks|thank you|ok|okay|bye|goodbye)[\s!.?]*$")
