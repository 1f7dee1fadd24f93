"""Text functions and predicates as Column expressions.

Those of books work like C functions in the "C" locale: letters, digits and
case are ASCII only, white space is blank, tab, line feed, vertical tab, form
feed and carriage return. Those of concepts (``slug``, ``node_name``) are
Unicode-aware. All of them are JVM expressions, so scans keep their pushdown.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r" \t\n\x0B\f\r"
BANNED = ("download", "wowebook", "copyright", "page")
TOC_WORDS = ("tableofcontents", "contents", "toc")
UPPER_CAP = 0.6


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Plain text


def lower_ascii(s) -> Column:
    return F.translate(_c(s), UPPER, LOWER)


def upper_ascii(s) -> Column:
    return F.translate(_c(s), LOWER, UPPER)


def has_letters(s) -> Column:
    return _c(s).rlike("[A-Za-z]")


def _count(s, outside: str) -> Column:
    return F.length(F.regexp_replace(_c(s), outside, ""))


def upper_ratio(s) -> Column:
    """Capitals among the letters; 0 without letters."""
    letters = _count(s, "[^A-Za-z]")
    return F.when(letters == 0, F.lit(0.0)).otherwise(_count(s, "[^A-Z]") / letters)


def is_space(s) -> Column:
    return _c(s).rlike(rf"\A[{SPACE}]\z")


def trim(s) -> Column:
    return F.regexp_replace(_c(s), rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def collapse(s) -> Column:
    """Runs of white space become one blank; none is left at either end."""
    return F.trim(F.regexp_replace(_c(s), f"[{SPACE}]+", " "))


def normalize(s) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(lower_ascii(s), "[^a-z0-9]", "")


def normalize_all(lines) -> Column:
    return F.transform(_c(lines), normalize)


def holds(haystack, needle) -> Column:
    """Whether the collapsed haystack has the collapsed needle in it; an empty needle is in nothing."""
    n = collapse(needle)
    return (n != "") & F.contains(collapse(haystack), n)


def page_number_like(s) -> Column:
    """Digits or letters of Roman numerals alone; words such as "mix" count."""
    return _c(s).rlike(rf"\A(?i)[{SPACE}]*[0-9ivxlcdm]+[{SPACE}]*\z")


def lines(text) -> Column:
    """Lines of a text; a last line end starts no further line, and an empty text has none."""
    parts = F.split(_c(text), "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


# Titles and file names


def replace_all(s, what: str, by: str) -> Column:
    return F.replace(_c(s), F.lit(what), F.lit(by)) if what else _c(s)


def without_chapter_tag(s) -> Column:
    return F.regexp_replace(_c(s), rf"\A(?i)(chapter|ch)[{SPACE}]+([0-9]+|[ivxlcdm]+)[{SPACE}]*[:.\-]?[{SPACE}]*", "")


def without_the(s) -> Column:
    s = _c(s)
    return F.when(s.startswith("The "), F.substring(s, 5, 1 << 30)).otherwise(s)


def key_without_the(s) -> Column:
    """As ``without_the``, or else without the letters "the", a word of their own or not."""
    s = _c(s)
    return F.when(s.startswith("The "), F.substring(s, 5, 1 << 30)).when(s.startswith("the"), F.substring(s, 4, 1 << 30)).otherwise(s)


def file_slug(s) -> Column:
    """Every byte other than ASCII letters and digits becomes an underscore."""
    s = F.regexp_replace(_c(s), r"[\x{10000}-\x{10FFFF}]", "____")
    s = F.regexp_replace(s, r"[\x{800}-\x{FFFF}]", "___")
    s = F.regexp_replace(s, r"[\x{80}-\x{7FF}]", "__")
    return F.regexp_replace(s, "[^A-Za-z0-9]", "_")


def stem(path) -> Column:
    """File name without its last extension."""
    name = F.regexp_extract(_c(path), r"([^/]*)\z", 1)
    return F.when(name.isin(".", ".."), name).otherwise(F.regexp_replace(name, r"(?s)\A(.+)\.[^.]*\z", "$1"))


def chapter_title(path) -> Column:
    """Title that a chapter file's name stands for."""
    name = F.regexp_replace(stem(path), r"\A[0-9]+_", "")
    name = F.translate(replace_all(name, "__", "_"), "_", " ")
    return without_chapter_tag(collapse(lower_ascii(name)))


def title_case(s) -> Column:
    pieces = F.regexp_extract_all(_c(s), F.lit(f"([{SPACE}]+|[^{SPACE}]+)"), 1)
    return F.array_join(F.transform(pieces, lambda w: F.concat(upper_ascii(F.substring(w, 1, 1)), lower_ascii(F.substring(w, 2, 1 << 30)))), "")


def file_title(path, cased: bool = True) -> Column:
    base = collapse(F.translate(stem(path), "_-.", "   "))
    return title_case(base) if cased else base


# Predicates


def contains_any(s, words) -> Column:
    found = [F.contains(_c(s), F.lit(w)) for w in words if w]
    return reduce(Column.__or__, found) if found else F.lit(False)


def has_banned_word(s) -> Column:
    return contains_any(s, BANNED)


def is_toc_label(s) -> Column:
    return contains_any(normalize(s), TOC_WORDS)


def is_subtitle(toc_line, chapter_line) -> Column:
    return holds(chapter_line, without_the(toc_line))


def has_chapter_name(s, title) -> Column:
    """An empty title is in everything."""
    return F.contains(collapse(lower_ascii(s)), _c(title))


def has_weird_chars(s) -> Column:
    return F.contains(_c(s), F.lit("()")) | F.contains(_c(s), F.lit("//"))


def mostly_upper(s) -> Column:
    """upper_ratio >= 0.6, in whole numbers."""
    return _count(s, "[^A-Z]") * 10 >= _count(s, "[^A-Za-z]") * int(UPPER_CAP * 10)


def is_noisy(s, title) -> Column:
    # The cheap tests first: what they tell needs no pattern.
    return has_weird_chars(s) | has_banned_word(lower_ascii(s)) | has_chapter_name(s, title) | ~has_letters(s) | mostly_upper(s)


def bad_metadata_title(s) -> Column:
    s = _c(s)
    alnum, digits, one_word = _count(s, "[^A-Za-z0-9]"), _count(s, "[^0-9]"), ~F.contains(s, F.lit(" "))
    numeric = one_word & (alnum > 0) & (digits * 10 >= alnum * 7)
    return (s == "") | lower_ascii(s).isin("untitled", "unknown", "null") | numeric | (one_word & (F.octet_length(s) <= 6))


def first_metadata_title(info, low, high) -> Column:
    """The first of three metadata titles that isn't empty, cleaned, or an empty string."""
    clean = [F.nullif(collapse(F.substring(F.coalesce(_c(x), F.lit("")), 1, 1023)), F.lit("")) for x in (info, low, high)]
    return F.coalesce(*clean, F.lit(""))


def book_title(info, low, high, path) -> Column:
    """struct(value, from_metadata, source). Only the first title that isn't empty is judged; if it is bad, the file name serves."""
    names = ("info:Title", "title", "Title")
    clean = [F.nullif(collapse(F.substring(F.coalesce(_c(x), F.lit("")), 1, 1023)), F.lit("")) for x in (info, low, high)]
    first = F.coalesce(*clean)
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for c, n in zip(clean, names)])
    good = F.coalesce(~bad_metadata_title(first), F.lit(False))
    return F.struct(
        F.when(good, first).otherwise(file_title(path)).alias("value"), good.alias("from_metadata"), F.when(good, source).otherwise(F.lit("filename")).alias("source"),
    )


def title_source(title) -> Column:
    """How a book's title is labelled in stored sections."""
    t = _c(title)
    return F.when(t["from_metadata"], F.concat(F.lit("metadata:"), t["source"])).otherwise(F.lit("filename"))


# Unicode-aware


def strip(s) -> Column:
    return F.regexp_replace(_c(s), r"(?U)\A[\s\x1C-\x1F]+|[\s\x1C-\x1F]+\z", "")


def slug(s) -> Column:
    joined = F.regexp_replace(F.lower(strip(F.coalesce(_c(s), F.lit("")))), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(joined, r"\A-+|-+\z", ""), F.lit("")), F.lit("book"))


def node_name(s) -> Column:
    return F.lower(strip(F.coalesce(_c(s), F.lit(""))))
