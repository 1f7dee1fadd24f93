"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folium.functions import answers
from folium.functions import text as X
from folium.operators import chapters, concepts, graph, prereqs, runs, segment, store, toc
from folium.plans import sql as Q
from folium.plans import stand_ins as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(*ctes: str, select: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if select is not None:
            ORACLE_SQL[f.__name__] = Q.query(*ctes, select=select) if ctes else select
        return f

    return register


# Text


@_add(Q.LINES, select="SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, line FROM ln")
def text_lines(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.lines("text")).alias("line_no", "line"))


@_add(select=f"SELECT doc_id, {Q.lower('text')} AS low, {Q.trim('text')} AS trimmed, {Q.collapse('text')} AS collapsed, {Q.normalize('text')} AS normal, regexp_matches(text, '[A-Za-z]') AS letters FROM documents")
def text_normalize(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", X.lower_ascii("text").alias("low"), X.trim("text").alias("trimmed"), X.collapse("text").alias("collapsed"), X.normalize("text").alias("normal"), X.has_letters("text").alias("letters"))


@_add(select=f"SELECT doc_id, {Q.file_slug('text')} AS file_slug, {Q.slug('text')} AS slug FROM documents")
def text_slug(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", X.file_slug(F.col("text")).alias("file_slug"), X.slug(F.col("text")).alias("slug"))


@_add(select=f"SELECT doc_id, CASE WHEN {Q.count('text', '[^A-Za-z]')} = 0 THEN 0.0::DOUBLE ELSE {Q.count('text', '[^A-Z]')}::DOUBLE / {Q.count('text', '[^A-Za-z]')} END AS ratio FROM documents")
def text_upper_ratio(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", X.upper_ratio("text").alias("ratio"))


@_add(select=f"SELECT doc_id, {Q.title_case('text')} AS title FROM documents")
def text_title_case(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", X.title_case(F.col("text")).alias("title"))


@_add(select=f"SELECT doc_id, contains({Q.collapse('text')}, {Q.collapse('source')}) AND {Q.collapse('source')} <> '' AS has_source, replace(text, 'the', '') AS without_the, regexp_matches({Q.lower('text')}, 'license|apache') AS any_of FROM documents")
def text_contains(spark, sf_dir):
    return S.table(spark, sf_dir, "documents").select("doc_id", X.holds("text", "source").alias("has_source"), X.replace_all("text", "the", "").alias("without_the"), X.contains_any(X.lower_ascii("text"), ("license", "apache", "")).alias("any_of"))


@_add(Q.FILES, select=f"SELECT page_id, file, {Q.chapter_title('file')} AS title, {Q.normalize(Q.chapter_title('file'))} AS key FROM fl")
def chapter_title(spark, sf_dir):
    return S.file_names(spark, sf_dir).select("page_id", "file", X.chapter_title("file").alias("title"), X.normalize(X.chapter_title("file")).alias("key"))


@_add(Q.FILES, select=f"SELECT page_id, file FROM fl WHERE NOT {Q.toc_label('file')}")
def toc_label_filter(spark, sf_dir):
    return S.file_names(spark, sf_dir).where(~X.is_toc_label("file")).select("page_id", "file")


@_add(
    Q.LINES, "wd AS (SELECT doc_id, line_no, unnest(ws) AS word, unnest(range(0, len(ws))) AS word_no FROM (SELECT doc_id, line_no, string_split(line, ' ') AS ws FROM ln))",
    select=f"SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(word_no AS INTEGER) AS word_no, word FROM wd WHERE {Q.page_number('word')}",
)
def page_no_filter(spark, sf_dir):
    """All words of all lines, each as a line of its own."""
    words = text_lines(spark, sf_dir).select("doc_id", "line_no", F.posexplode(F.split("line", " ")).alias("word_no", "word"))
    return words.where(X.page_number_like("word"))


@_add(Q.LINES, select=f"SELECT ln.doc_id, CAST(line_no AS INTEGER) AS line_no, {Q.noisy('line', Q.lower(Q.collapse(Q.first_line('d.text'))))} AS noisy FROM ln JOIN documents d ON d.doc_id = ln.doc_id")
def noise_filter(spark, sf_dir):
    titled = segment.pinned(S.table(spark, sf_dir, "documents").select("doc_id", "text"), "title", X.lower_ascii(X.collapse(S.first_line())))
    lines = titled.select("doc_id", "title", F.posexplode(X.lines("text")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", X.is_noisy("line", "title").alias("noisy"))


_INFO = "CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN regexp_extract(html, '<title>([^<]*)', 1) ELSE substr(regexp_extract(html, '<title>([^<]*)', 1), 1, CAST(page_id % 9 AS INTEGER)) END"
_LOW = "CASE WHEN page_id % 5 = 0 THEN 'Untitled' WHEN page_id % 5 = 1 THEN '  ' ELSE '' END"


@_add(
    f"m AS (SELECT page_id, url, {Q.collapse(_INFO)} AS a, {Q.collapse(_LOW)} AS b, printf('v%d', page_id * 1001) AS c FROM pages)",
    "f AS (SELECT *, CASE WHEN a <> '' THEN a WHEN b <> '' THEN b ELSE c END AS first, CASE WHEN a <> '' THEN 'info:Title' WHEN b <> '' THEN 'title' ELSE 'Title' END AS src FROM m)",
    select=f"SELECT page_id, CASE WHEN {Q.bad_title('first')} THEN {Q.file_title('url')} ELSE first END AS value, NOT {Q.bad_title('first')} AS from_metadata, CASE WHEN {Q.bad_title('first')} THEN 'filename' ELSE 'metadata:' || src END AS label, first AS first_title FROM f",
)
def book_title(spark, sf_dir):
    p = S.table(spark, sf_dir, "pages").select("page_id", "url", F.expr(_INFO).alias("info"), F.expr(_LOW).alias("low"), F.expr("concat('v', cast(page_id * 1001 as string))").alias("high"))
    t = p.select("page_id", X.book_title("info", "low", "high", "url").alias("t"), X.first_metadata_title("info", "low", "high").alias("first_title"))
    return t.select("page_id", "t.value", "t.from_metadata", X.title_source("t").alias("label"), "first_title")


# Chapters and tables of contents


@_add(Q.PAGES, Q.OUTLINE, Q.RANGES, select="SELECT book, chapter_no, title, page_start, page_end, page_end - page_start + 1 AS page_count FROM rg")
def chapter_ranges(spark, sf_dir):
    return S.chapter_table(spark, sf_dir)


@_add(
    Q.PAGES, Q.OUTLINE,
    "ov AS (SELECT book, pos, title, page_index, greatest(coalesce(lead(page_index) OVER (PARTITION BY book ORDER BY pos), (SELECT count(*) FROM pg p WHERE p.book = ol.book)) - 1, page_index) AS e FROM ol)",
    select="SELECT book, pos, '''' || title || ''': pages ' || (page_index + 1) || '-' || (e + 1) || ' (' || (e - page_index + 1) || ' pages)' AS line FROM ov",
)
def outline_view(spark, sf_dir):
    return chapters.outline_view(S.outline(spark, sf_dir), S.page_totals(spark, sf_dir))


@_add(
    Q.PAGES, Q.OUTLINE, Q.RANGES,
    select=f"SELECT rg.book, chapter_no, printf('%02d_', chapter_no) || {Q.file_slug('any_value(title)')} || '.txt' AS file, CAST(sum(length(text) + 1) AS BIGINT) AS chars, md5(string_agg(text || chr(10), '' ORDER BY pg.page_index)) AS digest "
    "FROM rg JOIN pg ON pg.book = rg.book AND pg.page_index + 1 BETWEEN page_start AND page_end GROUP BY rg.book, chapter_no",
)
def chapter_text_stats(spark, sf_dir):
    full = chapters.with_text(S.chapter_table(spark, sf_dir), S.pages(spark, sf_dir).select("book", "page_index", "text"))
    return full.select("book", "chapter_no", "file", F.length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


_BOOKED = "fb AS (SELECT *, printf('book%d', page_id % 5) AS book FROM fl)"


@_add(Q.FILES, _BOOKED, select=f"SELECT book, file, {Q.normalize(Q.chapter_title('file'))} AS key FROM fb WHERE NOT {Q.toc_label('file')}")
def toc_catalog(spark, sf_dir):
    return toc.catalog(S.file_names(spark, sf_dir)).select("book", "file", "key")


@_add(Q.FILES, _BOOKED, select=f"SELECT book, min(file) AS file FROM fb WHERE {Q.toc_label('file')} GROUP BY book")
def toc_find(spark, sf_dir):
    return toc.toc_file(S.file_names(spark, sf_dir))


@_add(Q.FILES, _BOOKED, select=f"SELECT book, {Q.chapter_title('file')} AS title, min(file) AS file FROM fb WHERE NOT {Q.toc_label('file')} GROUP BY 1, 2")
def toc_lookup(spark, sf_dir):
    return toc.title_lookup(S.file_names(spark, sf_dir))


@_add(Q.PAGES, Q.OUTLINE, Q.TOC, Q.POSITIONS, select="SELECT y.book, y.file, y.key, CAST(p.pos AS INTEGER) AS pos FROM ky y JOIN ps p ON p.book = y.book AND p.k = y.k")
def toc_positions(spark, sf_dir):
    return S.toc_positions(spark, sf_dir)


@_add(
    Q.PAGES, Q.OUTLINE, Q.TOC, Q.POSITIONS, Q.SLICES,
    select=f"""SELECT sl.book, sl.file, CAST("start" AS INTEGER) AS first_line, CAST("end" AS INTEGER) AS next_line, coalesce((SELECT string_agg({Q.trim('line')}, chr(10) ORDER BY line_no) FROM tl WHERE tl.book = sl.book AND line_no >= "start" AND line_no < "end" AND {Q.trim('line')} <> '' AND NOT {Q.page_number(Q.trim('line'))}), '') AS lines FROM sl""",
)
def toc_slices(spark, sf_dir):
    cut = toc.slice_lines(toc.slices(S.toc_positions(spark, sf_dir)), S.toc_lines(spark, sf_dir))
    return cut.select("book", "file", F.col("start").alias("first_line"), F.col("end").alias("next_line"), F.array_join("lines", "\n").alias("lines"))


_LOOK = (
    f"lk AS (SELECT book, {Q.chapter_title('file')} AS title, min(file) AS slice FROM sl WHERE NOT {Q.toc_label('file')} AND NOT {Q.toc_label(Q.chapter_title('file'))} GROUP BY 1, 2)",
    f"cc AS (SELECT book, file, {Q.chapter_title('file')} AS title FROM ch WHERE NOT {Q.toc_label('file')})",
)


def _lookup(spark, sf_dir, how):
    cut = toc.slices(S.toc_positions(spark, sf_dir)).select("book", "file", F.array(F.col("file")).alias("lines"))
    return runs.with_slices(S.toc_chapters(spark, sf_dir).select("book", "file"), cut, how)


@_add(Q.PAGES, Q.OUTLINE, Q.TOC, Q.POSITIONS, Q.SLICES, *_LOOK, select="SELECT cc.book, cc.title, file, slice FROM cc JOIN lk ON lk.book = cc.book AND lk.title = cc.title")
def slice_lookup(spark, sf_dir):
    return _lookup(spark, sf_dir, "inner").select("book", "title", "file", F.get("toc_lines", F.lit(0)).alias("slice"))


@_add(Q.PAGES, Q.OUTLINE, Q.TOC, Q.POSITIONS, Q.SLICES, *_LOOK, select="SELECT cc.book, cc.title, file FROM cc WHERE NOT EXISTS (SELECT 1 FROM lk WHERE lk.book = cc.book AND lk.title = cc.title)")
def slice_lookup_miss(spark, sf_dir):
    return _lookup(spark, sf_dir, "left_anti")


# Sections


@_add(Q.LINES, Q.HEADS, select="SELECT doc_id, toc, line FROM mt")
def toc_first_match(spark, sf_dir):
    d = segment.matched(S.headed(spark, sf_dir)).select("doc_id", F.explode("_matches").alias("m"))
    return d.select("doc_id", "m.toc", "m.line")


@_add(Q.LINES, Q.HEADS, Q.STARTS, select="SELECT doc_id, line AS start FROM st")
def min_gap_starts(spark, sf_dir):
    d = segment.matched(S.headed(spark, sf_dir))
    return d.select("doc_id", F.explode(segment.pick_starts(F.col("_matches"))).alias("s")).select("doc_id", F.col("s.line").alias("start"))


@_add(
    Q.LINES, Q.HEADS, Q.STARTS,
    f"tt AS (SELECT doc_id, ls, CAST(len(ls) AS INTEGER) AS total FROM (SELECT doc_id, {Q.lines('text')} AS ls FROM documents))",
    "sg AS (SELECT doc_id, 0 AS startline, coalesce((SELECT min(line) FROM st WHERE st.doc_id = tt.doc_id), total) - 1 AS endline, true AS intro FROM tt WHERE coalesce((SELECT min(line) FROM st WHERE st.doc_id = tt.doc_id), -1) <> 0 "
    "UNION ALL SELECT st.doc_id, line, coalesce(lead(line) OVER (PARTITION BY st.doc_id ORDER BY line), total) - 1, false FROM st JOIN tt ON tt.doc_id = st.doc_id)",
    select="SELECT sg.doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS section_index, CASE WHEN intro THEN 'introduction' ELSE 'subsection' || (sum(CASE WHEN intro THEN 0 ELSE 1 END) OVER w)::BIGINT END AS title, "
    f"CAST(startline AS INTEGER) AS startline, CAST(endline AS INTEGER) AS endline, {Q.trim('array_to_string(ls[startline + 1:endline + 1], chr(10))')} AS content FROM sg JOIN tt ON tt.doc_id = sg.doc_id WINDOW w AS (PARTITION BY sg.doc_id ORDER BY startline)",
)
def sections(spark, sf_dir):
    return segment.explode_sections(segment.segment(S.headed(spark, sf_dir)), "doc_id")


@_add(
    Q.PAGES, Q.OUTLINE, Q.RANGES, Q.TOC, Q.POSITIONS, Q.SLICES, _LOOK[0], *Q.BOOK,
    select="SELECT book, file, chapter AS title, CAST(row_number() OVER w - 1 AS INTEGER) AS section_index, CASE WHEN intro THEN 'introduction' ELSE 'subsection' || (sum(CASE WHEN intro THEN 0 ELSE 1 END) OVER w)::BIGINT END AS name, "
    f"CAST(startline AS INTEGER) AS startline, CAST(endline AS INTEGER) AS endline, {Q.trim('array_to_string(ls[startline + 1:endline + 1], chr(10))')} AS content FROM bg WINDOW w AS (PARTITION BY book, file ORDER BY startline)",
)
def book_sections(spark, sf_dir):
    """Outline, pages and contents to sections, in one run."""
    outline = S.outline(spark, sf_dir).select("book", "pos", "depth", "title", "page_index")
    return runs.run_book(outline, S.page_totals(spark, sf_dir), S.pages(spark, sf_dir).select("book", "page_index", "text"), S.toc_lines(spark, sf_dir))


@_add(select="SELECT CAST(doc_id AS VARCHAR) AS id, source AS book_title, lang AS chapter, CAST(doc_id % 20 AS INTEGER) AS section_index, text AS content FROM documents WHERE source = 'src3' AND length(coalesce(text, '')) >= 100")
def section_scan(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("book_title"), F.col("lang").alias("chapter"), (F.col("doc_id") % 20).alias("section_index"), F.col("text").alias("content"))
    return store.scan(d, "src3")


@_add(select="SELECT count(*) AS n FROM documents WHERE source = 'src3' AND length(coalesce(text, '')) >= 100")
def section_count(spark, sf_dir):
    return store.count(S.table(spark, sf_dir, "documents").select(F.col("source").alias("book_title"), F.col("text").alias("content")), "src3")


_OLD = "old AS (SELECT source AS book_title, printf('%04d', CAST(doc_id // 20 AS INTEGER)) AS chapter, 'subsection' || (doc_id % 20) AS title, lang AS chapter_title, text AS content, doc_id FROM documents)"
_NEW = "new AS (SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN 'new ' || title ELSE title END AS title, CASE WHEN doc_id % 4 = 0 THEN content || ' revised' ELSE content END AS content) FROM old)"
_K = "o.book_title = n.book_title AND o.chapter = n.chapter AND o.title = n.title"
_CHANGED = f"SELECT n.book_title, n.chapter, n.title FROM new n LEFT JOIN old o ON {_K} WHERE o.title IS NULL OR o.content IS DISTINCT FROM n.content OR o.chapter_title IS DISTINCT FROM n.chapter_title"


@_add(_OLD, _NEW, select=f"SELECT coalesce(n.book_title, o.book_title) AS book_title, coalesce(n.chapter, o.chapter) AS chapter, coalesce(n.title, o.title) AS title, CASE WHEN n.title IS NULL THEN o.chapter_title ELSE n.chapter_title END AS chapter_title, CASE WHEN n.title IS NULL THEN o.content ELSE n.content END AS content FROM old o FULL JOIN new n ON {_K}")
def upsert_merge(spark, sf_dir):
    return store.merge(*S.stored(spark, sf_dir))


@_add(_OLD, _NEW, select=_CHANGED)
def upsert_changed(spark, sf_dir):
    return store.changed(*S.stored(spark, sf_dir))


@_add(_OLD, _NEW, select=f"SELECT (SELECT count(*) FROM ({_CHANGED})) AS sections_changed, (SELECT count(*) FROM new) AS sections_total, (SELECT count(DISTINCT chapter) FROM new) AS files")
def ingest_totals(spark, sf_dir):
    old, new = S.stored(spark, sf_dir)
    return store.ingest_totals(new.withColumn("chapter_file", F.col("chapter")), store.changed(old, new))


_VERSIONS = "vs AS (SELECT source AS book_title, lang AS chapter, 's' || (n_chars % 7) AS title, text AS content, doc_id AS version FROM documents)"


@_add(_VERSIONS, select="SELECT book_title, chapter, title, arg_max(content, version) AS content FROM vs GROUP BY 1, 2, 3")
def upsert_last_wins(spark, sf_dir):
    """Of sections that share a key the last one written stays."""
    v = S.versions(spark, sf_dir)
    return store.merge(v.drop("version").limit(0), v, order="version")


@_add(_VERSIONS, select="SELECT book_title, chapter, title FROM (SELECT *, lag(content) OVER w AS before, row_number() OVER w AS n FROM vs WINDOW w AS (PARTITION BY book_title, chapter, title ORDER BY version)) WHERE n = 1 OR content IS DISTINCT FROM before")
def upsert_changed_in_order(spark, sf_dir):
    """Writes that change something, when sections that share a key are written one after the other."""
    v = S.versions(spark, sf_dir)
    return store.changed(v.drop("version").limit(0), v, order="version")


@_add(select="SELECT source AS book_title, lang AS chapter, CAST(n_chars % 7 AS INTEGER) AS section_index, count(*) AS n FROM documents GROUP BY 1, 2, 3 HAVING count(*) > 1")
def key_collision(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents").select(F.col("source").alias("book_title"), F.col("lang").alias("chapter"), (F.col("n_chars") % 7).cast("int").alias("section_index"))
    return store.collisions(d, concepts.KEYS)


@_add(select="SELECT source AS book_title, lang AS chapter, CAST(n_chars % 7 AS INTEGER) AS section_index, max(doc_id) AS id, arg_max(text, doc_id) AS content FROM documents GROUP BY 1, 2, 3")
def key_latest(spark, sf_dir):
    d = S.table(spark, sf_dir, "documents").select(F.col("source").alias("book_title"), F.col("lang").alias("chapter"), (F.col("n_chars") % 7).cast("int").alias("section_index"), F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return store.latest(d, concepts.KEYS)


# Concepts


def _found(spark, sf_dir):
    return concepts.extract(S.sections(spark, sf_dir))


_C = (Q.PAGES, Q.SECTIONS, Q.FOUND)


@_add(*_C, select="SELECT doc_id AS id, book AS book_title, chapter, section_index, pos, concept FROM fd")
def concept_extract(spark, sf_dir):
    return _found(spark, sf_dir)[0]


@_add(*_C, select="SELECT count(*) AS sections_parsed, CAST(0 AS BIGINT) AS errors FROM sc WHERE length(content) >= 100")
def concept_metrics(spark, sf_dir):
    return _found(spark, sf_dir)[1]


@_add(*_C, select='SELECT lower, count(*) AS "count" FROM fd GROUP BY lower')
def concept_counts(spark, sf_dir):
    return concepts.counts(concept_extract(spark, sf_dir))


@_add(*_C, select="SELECT n_name AS concept, coalesce((SELECT count(*) FROM fd WHERE fd.lower = lower(n_name)), 0) AS \"count\" FROM nation UNION ALL SELECT concept, n FROM (SELECT DISTINCT concept, lower FROM fd) f JOIN cn ON cn.lower = f.lower")
def concept_frequency(spark, sf_dir):
    """Of all surface forms, and of names that may stand nowhere."""
    found = concept_extract(spark, sf_dir)
    names = S.table(spark, sf_dir, "nation").select(F.col("n_name").alias("concept")).unionByName(found.select("concept").distinct())
    return concepts.frequency(names, concepts.counts(found))


@_add(*_C, Q.PASSES, select="SELECT count(*) AS concepts, CAST(0 AS BIGINT) AS errors, count(*) FILTER (noisy) AS noisy, count(*) FILTER (rechecked) AS rechecked FROM pf")
def prereq_metrics(spark, sf_dir):
    s, canon, counts = _passes(spark, sf_dir)
    return prereqs.assess(canon, counts, s)[1]


@_add(*_C, select="SELECT lower, arg_min(concept, (doc_id, pos)) AS concept FROM fd GROUP BY lower")
def concept_unique(spark, sf_dir):
    return concepts.surface_forms(concept_extract(spark, sf_dir))


@_add(*_C, select="SELECT lower, canon, k[1] AS book_title, k[2] AS chapter, k[3] AS section_index, n AS occurrences FROM cn")
def concept_index(spark, sf_dir):
    return concepts.index(concept_extract(spark, sf_dir))


@_add(*_C, select="SELECT lower, arg_min(concept, (book, chapter, section_index, pos)) AS canon, count(*) AS occurrences FROM fd WHERE lower IN (SELECT lower FROM fd WHERE length(lower) % 2 = 0) GROUP BY lower")
def concept_allowed(spark, sf_dir):
    found = concept_extract(spark, sf_dir)
    some = found.select(F.lower("concept").alias("lower")).distinct().where("length(lower) % 2 = 0")
    return concepts.index(found, some).select("lower", "canon", "occurrences")


@_add(*_C, select="SELECT canon, book AS book_title, chapter, section_index, pos FROM fd JOIN cn USING (lower)")
def concept_occurrences(spark, sf_dir):
    found = concept_extract(spark, sf_dir)
    return concepts.occurrences(found, concepts.index(found))


def _passes(spark, sf_dir):
    s = S.sections(spark, sf_dir)
    found = concepts.extract(s)[0]
    canon = concepts.index(found)
    return s, canon, concepts.counts(found)


def _flat(df):
    return df.select("concept", "noisy", F.array_join("prerequisites", "|").alias("prerequisites"), *[c for c in df.columns if c == "rechecked"])


@_add(*_C, Q.PASSES, select="SELECT concept, noisy, array_to_string(pre, '|') AS prerequisites FROM p1")
def prereq_pass1(spark, sf_dir):
    _, canon, counts = _passes(spark, sf_dir)
    return _flat(prereqs.first_pass(canon, counts))


@_add(*_C, Q.PASSES, select="SELECT concept, book AS book_title, chapter, context FROM cx WHERE context <> ''")
def prereq_context(spark, sf_dir):
    s, canon, counts = _passes(spark, sf_dir)
    return prereqs.contexts(prereqs.first_pass(canon, counts).where("noisy"), canon, s)


@_add(*_C, Q.PASSES, select="SELECT concept, noisy, array_to_string(pre, '|') AS prerequisites, rechecked FROM pf")
def prereq_final(spark, sf_dir):
    s, canon, counts = _passes(spark, sf_dir)
    return _flat(prereqs.assess(canon, counts, s)[0])


@_add(*_C, Q.PASSES, select="SELECT concept FROM pf WHERE noisy")
def prereq_noise(spark, sf_dir):
    return prereq_final(spark, sf_dir).where("noisy").select("concept")


@_add(*_C, Q.PASSES, select="SELECT concept, unnest(pre) AS prerequisite FROM pf WHERE NOT noisy")
def edges(spark, sf_dir):
    s, canon, counts = _passes(spark, sf_dir)
    return graph.build_edges(prereqs.assess(canon, counts, s)[0])


@_add(*_C, Q.PASSES, select="SELECT (SELECT count(DISTINCT n) FROM (SELECT concept AS n FROM pf WHERE NOT noisy AND len(pre) > 0 UNION ALL SELECT unnest(pre) FROM pf WHERE NOT noisy)) AS nodes, (SELECT CAST(sum(len(pre)) AS BIGINT) FROM pf WHERE NOT noisy) AS edges")
def edge_counts(spark, sf_dir):
    return graph.edge_counts(edges(spark, sf_dir))


# The graph


@_add(Q.GRAPH, select="SELECT id, name FROM nm")
def graph_nodes(spark, sf_dir):
    return graph.nodes(S.supply_edges(spark, sf_dir))


def _degrees(spark, sf_dir):
    e = S.supply_edges(spark, sf_dir)
    return graph.degrees(graph.nodes(e), graph.proper(e))


@_add(Q.GRAPH, select="SELECT id, name, out_degree, in_degree FROM dg")
def graph_degrees(spark, sf_dir):
    return _degrees(spark, sf_dir)


@_add(
    Q.GRAPH,
    select="SELECT count(*) AS nodes, CAST(sum(out_degree) AS BIGINT) AS edges, count(*) FILTER (out_degree = 0) AS foundations_count, count(*) FILTER (in_degree = 0) AS targets_count, max(out_degree) AS max_out_degree, max(in_degree) AS max_in_degree, "
    "CAST(CASE WHEN EXISTS (SELECT 1 FROM pe a JOIN pe b ON a.prerequisite = b.concept) THEN 2 ELSE 1 END AS BIGINT) AS longest_prereq_chain FROM dg",
)
def graph_stats(spark, sf_dir):
    return graph.statistics(_degrees(spark, sf_dir), graph.proper(S.supply_edges(spark, sf_dir)))


@_add(Q.GRAPH, select="SELECT name, in_degree AS degree FROM dg ORDER BY in_degree DESC, id LIMIT 5")
def graph_topk(spark, sf_dir):
    return graph.top(_degrees(spark, sf_dir), "in_degree")


@_add(Q.GRAPH, select="SELECT concept, prerequisite FROM pe UNION SELECT a.concept, b.prerequisite FROM pe a JOIN pe b ON b.concept = a.prerequisite")
def graph_prereqs_transitive(spark, sf_dir):
    return graph.closure(graph.proper(S.supply_edges(spark, sf_dir)))


@_add(Q.GRAPH, select="SELECT prerequisite AS name FROM pe WHERE concept = (SELECT lower(n_name) FROM nation WHERE n_nationkey = 7)")
def graph_prereqs_direct(spark, sf_dir):
    edges_ = graph.proper(S.supply_edges(spark, sf_dir))
    name = S.table(spark, sf_dir, "nation").where("n_nationkey = 7").first()["n_name"]
    return graph.direct(edges_, f" {name.upper()} ")


@_add(Q.GRAPH, select="SELECT concept AS name FROM pe WHERE prerequisite = 'asia'")
def graph_dependents(spark, sf_dir):
    return graph.dependents(graph.proper(S.supply_edges(spark, sf_dir)), "Asia")


@_add(Q.TALK, "rc AS (SELECT concept, prerequisite FROM te UNION SELECT rc.concept, te.prerequisite FROM rc JOIN te ON te.concept = rc.prerequisite)", select="SELECT concept, prerequisite FROM rc")
def graph_closure_chains(spark, sf_dir):
    return graph.closure(S.talk_edges(spark, sf_dir))


@_add(Q.TALK, "rc AS (SELECT concept, 1 AS d FROM te UNION SELECT te.concept, d + 1 FROM rc JOIN te ON te.prerequisite = rc.concept)", select="SELECT CAST(coalesce(max(d), 0) AS INTEGER) AS longest, true AS acyclic FROM rc")
def graph_longest_chain(spark, sf_dir):
    length, acyclic = graph.peel(S.talk_edges(spark, sf_dir))
    return spark.range(1).select(F.lit(length).alias("longest"), F.lit(acyclic).alias("acyclic"))


@_add()
def graph_dag_insert(spark, sf_dir):
    """Edges between users whose events of a type follow each other; they form cycles, and the order decides which stay.

    No SQL: whether an edge stays depends on all that were kept before it.
    """
    return graph.insert_acyclic(S.event_edges(spark, sf_dir), "event_type")


# Answers of models


def _bodies(spark, sf_dir):
    props = F.when(F.col("event_id") % 5 == 0, F.expr("left(props, length(props) - 1)")).otherwise(F.col("props"))
    return S.table(spark, sf_dir, "events").select("event_id", "event_type", "props", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("so: "), props, F.lit(" -- done"))).otherwise(props).alias("body"))


@_add(select="SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
def json_recover(spark, sf_dir):
    def run(batches):
        for b in batches:
            found = [answers.as_object(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f.get("k", -1) for f in found], pa.int64())], ["event_id", "k"])

    return _bodies(spark, sf_dir).select("event_id", "body").mapInArrow(run, "event_id long, k long")


@_add(select="SELECT event_id, event_type || '|None|True|' || CAST(json_extract(props, '$.k') AS BIGINT) AS concepts FROM events")
def json_list_normalize(spark, sf_dir):
    body = F.concat(F.lit('{"concepts": [" '), "event_type", F.lit(' ", "'), F.upper("event_type"), F.lit('", null, "", true, '), F.get_json_object("props", "$.k"), F.lit("]}"))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["|".join(answers.concepts_of(x)) for x in b.column(1).to_pylist()], pa.string())], ["event_id", "concepts"])

    return S.table(spark, sf_dir, "events").select("event_id", body.alias("body")).mapInArrow(run, "event_id long, concepts string")
