"""Text functions against hand-made vectors."""

import pytest
from pyspark.sql import functions as F

from folium.functions import text as X

CASES = [
    (X.file_slug, "Chapter 1: Intro", "Chapter_1__Intro"), (X.file_slug, "Café", "Caf__"), (X.file_slug, "漢😀", "_______"),
    (X.slug, "Head First: Design Patterns!", "head-first-design-patterns"), (X.slug, "  ", "book"), (X.slug, "Café 2", "caf-2"), (X.slug, None, "book"),
    (X.chapter_title, "03_Chapter_1__Welcome_Aboard.txt", "welcome aboard"), (X.chapter_title, "07_Chapter_Introduction.txt", "ntroduction"),
    (X.chapter_title, "04_Ch_12___The_End.txt", "the end"), (X.chapter_title, "a/b/10_Civil_Law.txt", "civil law"),
    (X.is_toc_label, "02_Protocols.txt", True), (X.is_toc_label, "05_Observer_Pattern", False), (X.is_toc_label, "Table of Contents", True),
    (X.page_number_like, "xiv", True), (X.page_number_like, "civil", True), (X.page_number_like, "12", True), (X.page_number_like, " 7 ", True), (X.page_number_like, "12a", False), (X.page_number_like, "", False),
    (X.lower_ascii, "ÀB", "Àb"), (X.trim, "\v a b\n\r", "a b"), (X.trim, "\xa0a\xa0", "\xa0a\xa0"), (X.collapse, "\t a \v\n b ", "a b"), (X.normalize, "A-1 é!", "a1"),
    (X.has_letters, "12é", False), (X.has_letters, "1a", True), (X.upper_ratio, "ABc", 2 / 3), (X.upper_ratio, "123", 0.0), (X.is_space, "\v", True), (X.is_space, "\xa0", False),
    (X.without_the, "The Observer", "Observer"), (X.without_the, "the observer", "the observer"), (X.key_without_the, "theory", "ory"), (X.key_without_the, "other", "other"),
    (X.without_chapter_tag, "Chapter IV: Law", "Law"), (X.without_chapter_tag, "ch 3 - x", "x"), (X.file_title, "/x/head-first_java.v2.pdf", "Head First Java V2"),
    (X.title_case, "a bC\tdE", "A Bc\tDe"), (X.has_weird_chars, "f()", True), (X.has_weird_chars, "a/b", False), (X.mostly_upper, "THE BIG Idea", True), (X.mostly_upper, "ABC def", False),
    (X.bad_metadata_title, "", True), (X.bad_metadata_title, "Untitled", True), (X.bad_metadata_title, "0321125215", True), (X.bad_metadata_title, "GoBook", True), (X.bad_metadata_title, "v2-20240101", True),
    (X.bad_metadata_title, "Refactoring", False), (X.bad_metadata_title, "A B", False), (X.node_name, " A b\x1f", "a b"), (X.lines, "a\n\nb\n", ["a", "", "b"]), (X.lines, "", []), (X.lines, "a\r\nb", ["a\r", "b"]), (X.lines, "\n", [""]),
]
TWO = [
    (X.is_noisy, "The Observer Pattern defined", "welcome aboard", False), (X.is_noisy, "Welcome   Aboard again", "welcome aboard", True), (X.is_noisy, "Turn the Page", "x", True), (X.is_noisy, "call foo()", "x", True),
    (X.is_noisy, "42", "x", True), (X.is_noisy, "THE BIG Idea", "x", True), (X.is_noisy, "ABC def", "zz", False), (X.is_noisy, "Anything", "", True),
    (X.holds, "a  b", "a b", True), (X.holds, "ab", " ", False), (X.holds, "Ab", "ab", False), (X.is_subtitle, "The Cat", "a Cat here", False), (X.is_subtitle, "a Cat here", "The Cat", False),
]


@pytest.fixture(scope="module")
def answers(spark):
    one = spark.range(1)
    cols = [f(F.lit(a).cast("string")).alias(f"c{i}") for i, (f, a, _) in enumerate(CASES)]
    cols += [f(F.lit(a), F.lit(b)).alias(f"t{i}") for i, (f, a, b, _) in enumerate(TWO)]
    return one.select(*cols).first()


@pytest.mark.parametrize("i", range(len(CASES)))
def test_one_argument(answers, i):
    f, a, want = CASES[i]
    assert answers[f"c{i}"] == want, (f.__name__, a)


@pytest.mark.parametrize("i", range(len(TWO)))
def test_two_arguments(answers, i):
    f, a, b, want = TWO[i]
    if f is X.is_subtitle:
        want = " ".join(a.removeprefix("The ").split()) in " ".join(b.split())
    assert answers[f"t{i}"] == want, (f.__name__, a, b)


def test_book_titles(spark):
    rows = [("Refactoring", "", "", "x.pdf"), ("Untitled", "Good Title Here", "", "my_book.pdf"), ("", "", " A  Title ", "x.pdf"), (None, None, None, "/d/the-end.pdf")]
    df = spark.createDataFrame(rows, "i string, l string, h string, p string")
    got = [(r.t.value, r.t.from_metadata, r.s) for r in df.select(X.book_title("i", "l", "h", "p").alias("t")).select("t", X.title_source("t").alias("s")).collect()]
    assert got == [("Refactoring", True, "metadata:info:Title"), ("My Book", False, "filename"), ("A Title", True, "metadata:Title"), ("The End", False, "filename")]


def test_replace_and_any(spark):
    r = spark.range(1).select(X.replace_all(F.lit("aaab"), "aa", "x").alias("a"), X.replace_all(F.lit("ab"), "", "x").alias("b"), X.contains_any(F.lit("abc"), ("", "bc")).alias("c"), X.contains_any(F.lit("abc"), ("",)).alias("d"), X.normalize_all(F.array(F.lit("A b"))).alias("e")).first()
    assert tuple(r) == ("xab", "ab", True, False, ["ab"])
