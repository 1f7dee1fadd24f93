"""Pieces of DuckDB SQL that say what the text functions say."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
W = r"[ \t\n\x0B\f\r]"
NOT_W = r"[^ \t\n\x0B\f\r]"


def lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def upper(x: str) -> str:
    return f"translate({x}, '{LOWER}', '{UPPER}')"


def sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def trim(x: str) -> str:
    return sub(x, rf"\A{W}+|{W}+\z")


def collapse(x: str) -> str:
    return f"trim({sub(x, f'{W}+', ' ')}, ' ')"


def normalize(x: str) -> str:
    return sub(lower(x), "[^a-z0-9]")


def count(x: str, outside: str) -> str:
    return f"length({sub(x, outside)})"


def lines(x: str) -> str:
    return f"CASE WHEN {x} = '' OR suffix({x}, chr(10)) THEN string_split({x}, chr(10))[:-2] ELSE string_split({x}, chr(10)) END"


def first_line(x: str) -> str:
    return f"split_part({x}, chr(10), 1)"


def without_the(x: str) -> str:
    return f"CASE WHEN starts_with({x}, 'The ') THEN substr({x}, 5) ELSE {x} END"


def file_slug(x: str) -> str:
    for low, high, by in (("10000", "10FFFF", "____"), ("800", "FFFF", "___"), ("80", "7FF", "__")):
        x = sub(x, rf"[\x{{{low}}}-\x{{{high}}}]", by)
    return sub(x, "[^A-Za-z0-9]", "_")


def slug(x: str) -> str:
    joined = sub(f"lower({sub(x, r'^\s+|\s+$')})", "[^a-z0-9]+", "-")
    return f"coalesce(nullif(trim({joined}, '-'), ''), 'book')"


def stem(x: str) -> str:
    return rf"regexp_replace(regexp_extract({x}, '[^/]*$'), '^(.+)\.[^.]*$', '\1')"


def chapter_title(x: str) -> str:
    name = f"regexp_replace({stem(x)}, '^[0-9]+_', '')"
    name = f"replace(replace({name}, '__', '_'), '_', ' ')"
    return rf"regexp_replace({collapse(lower(name))}, '^(chapter|ch){W}+([0-9]+|[ivxlcdm]+){W}*[:.\-]?{W}*', '', 'i')"


def title_case(x: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({x}, '{W}+|{NOT_W}+'), lambda w: {upper('substr(w, 1, 1)')} || {lower('substr(w, 2)')}), '')"


def file_title(x: str) -> str:
    return title_case(collapse(f"translate({stem(x)}, '_-.', '   ')"))


def toc_label(x: str) -> str:
    return f"regexp_matches({normalize(x)}, 'tableofcontents|contents|toc')"


def page_number(x: str) -> str:
    return rf"regexp_matches({x}, '\A(?i:{W}*[0-9ivxlcdm]+{W}*)\z')"


def noisy(x: str, title: str) -> str:
    return (
        f"(contains({collapse(lower(x))}, {title}) OR regexp_matches({lower(x)}, 'download|wowebook|copyright|page') "
        f"OR contains({x}, '()') OR contains({x}, '//') OR NOT regexp_matches({x}, '[A-Za-z]') "
        f"OR {count(x, '[^A-Z]')} * 10 >= {count(x, '[^A-Za-z]')} * 6)"
    )


def bad_title(x: str) -> str:
    alnum, digits = count(x, "[^A-Za-z0-9]"), count(x, "[^0-9]")
    return (
        f"({x} = '' OR {lower(x)} IN ('untitled', 'unknown', 'null') OR (NOT contains({x}, ' ') AND "
        f"(({alnum} > 0 AND {digits} * 10 >= {alnum} * 7) OR octet_length(encode({x})) <= 6)))"
    )


#: Documents as pages of books, labelled ones as chapters.
PAGES = "pg AS (SELECT source AS book, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS INTEGER) AS page_index, doc_id, text FROM documents)"
OUTLINE = f"ol AS (SELECT book, page_index, page_index AS pos, doc_id, text, {first_line('text')} AS title FROM pg WHERE doc_id IN (SELECT doc_id FROM labels))"
RANGES = (
    "rg AS (SELECT book, title, page_index, CAST(row_number() OVER w AS INTEGER) AS chapter_no, page_index + 1 AS page_start, "
    "CAST(greatest(coalesce(lead(page_index) OVER w, (SELECT count(*) FROM pg p WHERE p.book = ol.book)) - 1, page_index) + 1 AS INTEGER) AS page_end "
    "FROM ol WINDOW w AS (PARTITION BY book ORDER BY page_index, pos))"
)
LINES = f"ln AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS line_no FROM (SELECT doc_id, {lines('text')} AS ls FROM documents))"
HEADS = (
    f"hd AS (SELECT ln.doc_id, CAST(line_no AS INTEGER) AS toc, {trim('line')} AS line FROM ln), "
    f"nd AS (SELECT hd.doc_id, toc, {collapse(without_the('line'))} AS needle FROM hd JOIN documents d ON d.doc_id = hd.doc_id "
    f"WHERE NOT {noisy('line', lower(collapse(first_line('d.text'))))}), "
    f"mt AS (SELECT nd.doc_id, toc, CAST(min(line_no) AS INTEGER) AS line FROM nd JOIN ln ON ln.doc_id = nd.doc_id AND needle <> '' AND contains({collapse('ln.line')}, needle) GROUP BY nd.doc_id, toc)"
)
STARTS = (
    "st AS (SELECT doc_id, min(line) AS line FROM mt GROUP BY doc_id UNION ALL "
    "SELECT st.doc_id, min(mt.line) FROM st JOIN mt ON mt.doc_id = st.doc_id AND mt.line >= st.line + 5 GROUP BY st.doc_id, st.line)"
)
TOC = (
    # A book's contents: all lines of its labelled documents, in document order.
    f"tl AS (SELECT book, CAST(row_number() OVER (PARTITION BY book ORDER BY doc_id, i) - 1 AS INTEGER) AS line_no, line FROM "
    f"(SELECT book, doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS i FROM (SELECT book, doc_id, ({lines('text')}) AS ls FROM ol))), "
    f"ch AS (SELECT book, doc_id, text, printf('%02d_', CAST(row_number() OVER (PARTITION BY book ORDER BY doc_id) AS INTEGER)) || {file_slug('title')} || '.txt' AS file, {normalize('title')} AS key FROM ol), "
    "ky AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY file, key) AS k, CASE WHEN starts_with(key, 'the') THEN substr(key, 4) ELSE key END AS key2 FROM ch), "
    f"tn AS (SELECT book, line_no, {normalize('line')} AS norm FROM tl)"
)
POSITIONS = (
    "ps AS (SELECT book, CAST(0 AS BIGINT) AS k, 0 AS cur, -1 AS pos FROM (SELECT DISTINCT book FROM ky) UNION ALL "
    "SELECT book, k, CASE WHEN f IS NULL THEN cur ELSE f + 1 END, coalesce(f, -1) FROM ("
    "SELECT p.book, y.k, p.cur, coalesce(min(t.line_no) FILTER (contains(t.norm, y.key)), min(t.line_no) FILTER (contains(t.norm, y.key2))) AS f "
    "FROM ps p JOIN ky y ON y.book = p.book AND y.k = p.k + 1 LEFT JOIN tn t ON t.book = p.book AND t.line_no >= p.cur AND t.norm <> '' "
    "GROUP BY p.book, y.k, p.cur))"
)
SLICES = (
    'sl AS (SELECT * FROM (SELECT y.book, y.file, p.pos AS "start", lead(p.pos) OVER (PARTITION BY y.book ORDER BY y.file, y.key) AS "end" FROM ky y JOIN ps p ON p.book = y.book AND p.k = y.k) '
    'WHERE "start" >= 0 AND "end" - "start" >= 5)'
)
BOOK = (
    # Whole runs: chapters' texts, the lines of each chapter's slice, first matches, starts, bounds.
    f"bk AS (SELECT book, file, {chapter_title('file')} AS chapter, {lines('text')} AS ls FROM (SELECT rg.book, printf('%02d_', chapter_no) || {file_slug('any_value(title)')} || '.txt' AS file, string_agg(text || chr(10), '' ORDER BY pg.page_index) AS text "
    f"FROM rg JOIN pg ON pg.book = rg.book AND pg.page_index + 1 BETWEEN page_start AND page_end GROUP BY rg.book, chapter_no) WHERE NOT {toc_label('file')})",
    "bl AS (SELECT book, file, unnest(ls) AS line, unnest(range(0, len(ls))) AS line_no FROM bk)",
    f"bn AS (SELECT bk.book, bk.file, {collapse(without_the(trim('tl.line')))} AS needle FROM bk JOIN lk ON lk.book = bk.book AND lk.title = bk.chapter JOIN sl ON sl.book = lk.book AND sl.file = lk.slice "
    f'JOIN tl ON tl.book = sl.book AND tl.line_no >= sl."start" AND tl.line_no < sl."end" WHERE {trim("tl.line")} <> \'\' AND NOT {page_number(trim("tl.line"))} AND NOT {noisy(trim("tl.line"), "bk.chapter")})',
    f"bm AS (SELECT bn.book, bn.file, needle, CAST(min(line_no) AS INTEGER) AS line FROM bn JOIN bl ON bl.book = bn.book AND bl.file = bn.file AND needle <> '' AND contains({collapse('bl.line')}, needle) GROUP BY 1, 2, 3)",
    "bs AS (SELECT book, file, min(line) AS line FROM bm GROUP BY 1, 2 UNION ALL SELECT bs.book, bs.file, min(bm.line) FROM bs JOIN bm ON bm.book = bs.book AND bm.file = bs.file AND bm.line >= bs.line + 5 GROUP BY bs.book, bs.file, bs.line)",
    "bt AS (SELECT bk.*, CAST(len(ls) AS INTEGER) AS total FROM bk JOIN lk ON lk.book = bk.book AND lk.title = bk.chapter)",
    "bg AS (SELECT book, file, chapter, ls, 0 AS startline, coalesce((SELECT min(line) FROM bs WHERE bs.book = bt.book AND bs.file = bt.file), total) - 1 AS endline, true AS intro FROM bt WHERE coalesce((SELECT min(line) FROM bs WHERE bs.book = bt.book AND bs.file = bt.file), -1) <> 0 "
    "UNION ALL SELECT bs.book, bs.file, chapter, ls, line, coalesce(lead(line) OVER (PARTITION BY bs.book, bs.file ORDER BY line), total) - 1, false FROM bs JOIN bt ON bt.book = bs.book AND bt.file = bs.file)",
)
SECTIONS = "sc AS (SELECT doc_id, book, printf('%04d', CAST(page_index // 10 AS INTEGER)) AS chapter, CAST(page_index % 10 AS INTEGER) AS section_index, text AS content FROM pg)"
FOUND = (
    "rw AS (SELECT doc_id, book, chapter, section_index, unnest(cs) AS c, unnest(range(0, len(cs))) AS o FROM (SELECT *, regexp_extract_all(content, '[A-Za-z]{9,}') AS cs FROM sc WHERE length(content) >= 100)), "
    "fd AS (SELECT doc_id, book, chapter, section_index, lower(c) AS lower, arg_min(c, o) AS concept, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY min(o)) - 1 AS INTEGER) AS pos FROM rw GROUP BY 1, 2, 3, 4, 5), "
    "cn AS (SELECT lower, count(*) AS n, arg_min(concept, (book, chapter, section_index, pos)) AS canon, min((book, chapter, section_index, pos)) AS k FROM fd GROUP BY lower)"
)
PASSES = (
    "p1 AS (SELECT canon AS concept, n <= 1 AND length(canon) % 3 = 0 AS noisy, CASE WHEN lower(substr(canon, 1, 5)) = lower(right(canon, 5)) THEN [substr(canon, 1, 5)] ELSE [substr(canon, 1, 5), right(canon, 5)] END AS pre, k FROM cn), "
    "cx AS (SELECT p1.concept, sc.book, sc.chapter, p1.pre, left(trim(content, ' ' || chr(9) || chr(10) || chr(13)), 2000) AS context FROM p1 JOIN sc ON (sc.book, sc.chapter, sc.section_index) = (p1.k[1], p1.k[2], p1.k[3]) WHERE p1.noisy), "
    "p2 AS (SELECT concept, NOT contains(replace(lower(context), lower(concept), ''), right(lower(concept), 4)) AS noisy FROM cx WHERE context <> ''), "
    "pf AS (SELECT p1.concept, coalesce(p2.noisy, p1.noisy) AS noisy, pre, coalesce(NOT p2.noisy, false) AS rechecked FROM p1 LEFT JOIN p2 USING (concept))"
)
GRAPH = (
    "eg AS (SELECT s_suppkey AS pos, s_name AS concept, n_name AS prerequisite FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL "
    "SELECT 1000000000 + n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey), "
    "pe AS (SELECT lower(trim(concept)) AS concept, lower(trim(prerequisite)) AS prerequisite, min(pos) AS pos FROM eg WHERE lower(trim(concept)) <> lower(trim(prerequisite)) GROUP BY 1, 2), "
    "nm AS (SELECT name, CAST(row_number() OVER (ORDER BY min(seen)) - 1 AS BIGINT) AS id FROM (SELECT lower(trim(concept)) AS name, 2 * pos AS seen FROM eg UNION ALL SELECT lower(trim(prerequisite)), 2 * pos + 1 FROM eg) GROUP BY name), "
    "dg AS (SELECT id, name, (SELECT count(*) FROM pe WHERE concept = name) AS out_degree, (SELECT count(*) FROM pe WHERE prerequisite = name) AS in_degree FROM nm)"
)
TALK = "tk AS (SELECT DISTINCT conv_id, turn FROM conversations), te AS (SELECT printf('c%dt%d', a.conv_id, a.turn) AS concept, printf('c%dt%d', b.conv_id, b.turn) AS prerequisite FROM tk a JOIN tk b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1)"
FILES = (
    r"fl AS (SELECT page_id, printf('%02d_Chapter_%d__', CAST(page_id % 100 AS INTEGER), CAST(page_id % 30 AS INTEGER)) || regexp_replace(url, '[^A-Za-z0-9]', '_', 'g') || "
    r"CASE WHEN page_id % 7 = 0 THEN '_Table_of_Contents' ELSE '' END || '.txt' AS file FROM pages)"
)


def query(*ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {', '.join(ctes)} {select}"
