"""Schemas of the tables that stages hand on."""

from pyspark.sql import types as T

OUTLINE = "book string, pos int, depth int, title string, page_index int"
PAGES = "book string, page_index int, text string"
CHAPTERS = "book string, chapter_no int, title string, page_start int, page_end int, page_count int"
CHAPTER_FILES = "book string, file string, text string"
SEGMENT = "struct<content string, endline int, startline int, title string>"
SECTIONS = (
    "book_title string, book_title_src string, book_path string, chapter_file string, chapter string, chapter_title string, "
    "section_index int, title string, startline int, endline int, content string"
)
SECTIONS_MIN = "id string, book_title string, chapter string, section_index int, content string"
SECTION_CONCEPTS = "book_title string, chapter string, section_index int, pos int, concept string"
PREREQS = "concept string, noisy boolean, prerequisites array<string>"
EDGES = "pos long, concept string, prerequisite string"


def as_struct(spec) -> T.StructType:
    return spec if isinstance(spec, T.StructType) else T._parse_datatype_string(spec)
