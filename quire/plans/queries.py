"""Queries over the test tables that apply each operator to a whole table, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quire.functions import paths as P, text as T
from quire.functions.markdown import markdown_html
from quire.operators import archive as A, batch as B, chapters as C, epub as E, metadata as M, packages as C_, pages as G
from quire.session import Staged
from quire.sources import archives as Z, books as K, providers as V

from . import views as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- SQL pieces -------------------------------------------------------------------------------------------


def trim(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def squeeze(x: str) -> str:
    return trim(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def clean(x: str, *unknown: str) -> str:
    words = ", ".join(f"'{u}'" for u in ("", "unknown", *unknown))
    return f"CASE WHEN lower({squeeze(x)}) IN ({words}) THEN NULL ELSE {squeeze(x)} END"


def slug(x: str) -> str:
    return f"coalesce(nullif(trim(lower(regexp_replace({x}, '[^A-Za-z0-9]+', '-', 'g')), '-'), ''), 'chapter')"


def heading(x: str) -> str:
    return trim(f"trim({trim(x)}, '#')")


def escape(x: str) -> str:
    for a, b in T.XML_ENTITIES:
        x = f"replace({x}, '{a.replace(chr(39), chr(39) * 2)}', '{b}')"
    return x


def unescape(x: str) -> str:
    for a, b in reversed(T.XML_ENTITIES):
        x = f"replace({x}, '{b}', '{a.replace(chr(39), chr(39) * 2)}')"
    return x


ATX = r"^\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$"
FULL = f"docs AS (SELECT doc_id, string_agg(md, chr(10) || chr(10) ORDER BY page_index) FILTER (md <> '') AS markdown, count(*) AS n_pages FROM (SELECT doc_id, page_index, {trim('markdown')} AS md FROM pages) GROUP BY doc_id)"
LINES = r"lines AS (SELECT doc_id, unnest(range(len(l))) AS line_no, regexp_replace(unnest(l), '\r$', '') AS line FROM (SELECT doc_id, string_split(regexp_replace(markdown, '\n$', ''), chr(10)) AS l FROM docs WHERE regexp_matches(markdown, '\S')))"
HEADED = rf"""h1 AS (SELECT *, CASE WHEN regexp_matches(line, '{ATX}') THEN nullif({heading(f"regexp_extract(line, '{ATX}', 2)")}, '') END AS atx,
    regexp_extract(coalesce(lead(line) OVER (PARTITION BY doc_id ORDER BY line_no), ''), '^\s{{0,3}}(=+|-+)\s*$', 1) AS mark FROM lines),
h2 AS (SELECT *, atx IS NULL AND {heading('line')} <> '' AND mark <> '' AS may FROM h1),
h3 AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id, may ORDER BY line_no) AS run FROM h2),
h4 AS (SELECT *, may AND row_number() OVER (PARTITION BY doc_id, may, run ORDER BY line_no) % 2 = 1 AS under FROM h3),
headed AS (SELECT doc_id, line_no, line, CASE WHEN atx IS NOT NULL THEN length(regexp_extract(line, '{ATX}', 1)) WHEN under THEN CASE WHEN mark LIKE '=%' THEN 1 ELSE 2 END END::INT AS level,
    coalesce(atx, CASE WHEN under THEN {heading('line')} END) AS title FROM h4)"""
CHAPTERS = rf"""{FULL}, {LINES}, {HEADED},
b1 AS (SELECT *, {trim('line')} <> '' AND length({trim('line')}) <= 90 AND regexp_matches(line, '(?i)^\s*(chapter|part)\s+([0-9ivxlcdm]+)\b.*$') AND {trim("coalesce(lag(line) OVER (PARTITION BY doc_id ORDER BY line_no), '')")} = '' AS said FROM headed),
b2 AS (SELECT *, count(*) FILTER (level = 1) OVER d AS n1, count(*) FILTER (level = 2) OVER d AS n2, count(*) FILTER (said) OVER d AS ns FROM b1 WINDOW d AS (PARTITION BY doc_id)),
b3 AS (SELECT *, CASE WHEN n1 > 0 THEN CASE WHEN level = 1 THEN title END WHEN n2 >= 2 THEN CASE WHEN level = 2 THEN title END WHEN ns >= 2 THEN CASE WHEN said THEN {heading('line')} END END AS boundary FROM b2),
b4 AS (SELECT *, coalesce(max(CASE WHEN boundary IS NOT NULL THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no), -1) AS seg FROM b3),
b5 AS (SELECT doc_id, seg, max(boundary) AS boundary, {trim('string_agg(line, chr(10) ORDER BY line_no)')} AS markdown FROM b4 GROUP BY ALL),
b6 AS (SELECT *, coalesce(boundary, CASE WHEN max(seg) OVER (PARTITION BY doc_id) >= 0 THEN 'Introduction' ELSE 'Document' END) AS title FROM b5),
b7 AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seg) AS no, count(*) OVER (PARTITION BY doc_id) AS n FROM b6 WHERE markdown <> ''),
b8 AS (SELECT *, CASE WHEN n >= 3 AND no = n AND length(markdown) < 400 THEN no - 1 ELSE no END::INT AS chapter_no FROM b7),
chapters AS (SELECT doc_id, chapter_no, arg_min(title, no) AS title, string_agg(markdown, chr(10) || chr(10) ORDER BY no) AS markdown FROM b8 GROUP BY ALL)"""
NAMED = f"""slugged AS (SELECT *, {slug('title')} AS base FROM chapters),
named AS (SELECT *, CASE WHEN r = 1 THEN base ELSE base || '-' || r END AS slug, printf('chapter-%03d', chapter_no) AS chapter_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY chapter_no) AS r FROM slugged)),
filed AS (SELECT *, chapter_id || '-' || slug || '.xhtml' AS file_name FROM named)"""
_CHAPTER_COLUMNS = "doc_id, chapter_no, title, md5(markdown) AS body_md5, length(markdown)::BIGINT AS n_chars"


def chapter_rows(chapters: DataFrame) -> DataFrame:
    return chapters.select("doc_id", "chapter_no", "title", F.md5("markdown").alias("body_md5"), F.length("markdown").cast("long").alias("n_chars"))


def conversation_chapters(spark: SparkSession, sf_dir: str, heading_: str = "# ") -> DataFrame:
    return C.chapters(G.full_text(X.pages(spark, sf_dir, heading_)))


# --- chapters ---------------------------------------------------------------------------------------------


@query(f"WITH {X.pages_sql()}, {CHAPTERS} SELECT {_CHAPTER_COLUMNS} FROM chapters")
def chapterize(spark, d):
    return chapter_rows(conversation_chapters(spark, d))


@query(f"WITH {X.pages_sql('## ')}, {CHAPTERS} SELECT {_CHAPTER_COLUMNS} FROM chapters")
def chapterize_second_level(spark, d):
    return chapter_rows(conversation_chapters(spark, d, "## "))


@query(f"WITH {X.pages_sql('Chapter ')}, {CHAPTERS} SELECT {_CHAPTER_COLUMNS} FROM chapters")
def chapter_line_fallback(spark, d):
    return chapter_rows(conversation_chapters(spark, d, "Chapter "))


@query(f"WITH {X.pages_sql()}, {CHAPTERS}, {NAMED} SELECT doc_id, chapter_no, slug, chapter_id, file_name FROM filed")
def chapter_slugs(spark, d):
    return C.file_names(conversation_chapters(spark, d)).select("doc_id", "chapter_no", "slug", "chapter_id", "file_name")


@query(f"WITH docs AS (SELECT doc_id, replace(text, chr(10), chr(10) || '===' || chr(10)) || chr(10) || '# end' AS markdown FROM documents), {LINES}, {HEADED} SELECT doc_id, line_no::INT AS line_no, level, title FROM headed WHERE level IS NOT NULL")
def heading_candidates(spark, d):
    docs = X.read(spark, d, "documents").select("doc_id", F.concat(F.replace(F.col("text"), F.lit("\n"), F.lit("\n===\n")), F.lit("\n# end")).alias("markdown"))
    return C.headings(C.explode_lines(docs)).where("level is not null").select("doc_id", "line_no", "level", "title")


@query(rf"""WITH f AS (SELECT page_id, unnest(range(len(h))) AS ordinal, unnest(h) AS h FROM (SELECT page_id, regexp_extract_all(html, '(?s)<h[1-6]>.*?</h[1-6]>') AS h FROM pages)),
g AS (SELECT page_id, ordinal, substr(h, 3, 1)::INT AS level, {squeeze(unescape("regexp_replace(h, '<[^>]+>', '', 'g')"))} AS title, {slug("regexp_replace(h, '<[^>]+>', '', 'g')")} AS base FROM f)
SELECT page_id, ordinal::INT AS ordinal, level, CASE WHEN r = 1 THEN base ELSE base || '-' || r END AS anchor, title FROM (SELECT *, row_number() OVER (PARTITION BY page_id, base ORDER BY ordinal) AS r FROM g)""")
def heading_anchors(spark, d):
    return C.heading_anchors(X.read(spark, d, "pages"))


# --- pages ------------------------------------------------------------------------------------------------


@query(f"WITH {X.pages_sql()}, {FULL} SELECT doc_id, md5(coalesce(markdown, '')) AS body_md5, n_pages FROM docs")
def document_fulltext(spark, d):
    return G.full_text(X.pages(spark, d)).select("doc_id", F.md5("markdown").alias("body_md5"), "n_pages")


@query(f"""WITH p AS (SELECT doc_id, text, {trim("string_split(text, chr(10))[1]")} AS h, {trim("string_split(text, chr(10))[-1]")} AS f FROM documents),
l AS (SELECT *, regexp_replace(text, '^\\s+', '') AS t FROM p),
m AS (SELECT *, CASE WHEN h <> '' AND starts_with(t, h) THEN regexp_replace(substr(t, length(h) + 1), '^\\n+', '') ELSE text END AS x FROM l),
n AS (SELECT *, regexp_replace(x, '\\s+$', '') AS r FROM m)
SELECT doc_id, md5(CASE WHEN f <> '' AND ends_with(r, f) THEN regexp_replace(substr(r, 1, length(r) - length(f)), '\\n+$', '') ELSE x END) AS body_md5 FROM n""")
def strip_running_matter(spark, d):
    ends = F.split("text", "\n")
    x = X.read(spark, d, "documents").select("doc_id", F.col("text").alias("markdown"), ends[0].alias("header"), F.element_at(ends, -1).alias("footer"))
    return G.without_running_matter(x).select("doc_id", F.md5("markdown").alias("body_md5"))


_EMITTED = """e AS (SELECT *, page_index = min(page_index) OVER (PARTITION BY doc_id) AS on_first FROM images),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, image_id ORDER BY page_index, img_pos) AS nth FROM e WHERE payload IS NOT NULL) WHERE nth = 1),
emitted AS (SELECT doc_id, page_index, img_pos, image_id, on_first AND row_number() OVER (PARTITION BY doc_id, on_first ORDER BY page_index, img_pos) = 1 AS is_cover FROM u)"""


@query(f"WITH {X.IMAGES_SQL}, {_EMITTED} SELECT * FROM emitted")
def image_dedupe(spark, d):
    return G.emitted_images(X.images(spark, d)).select("doc_id", "page_index", "img_pos", "image_id", "is_cover")


@query(f"WITH {X.IMAGES_SQL}, {_EMITTED} SELECT doc_id, page_index, img_pos, image_id FROM emitted WHERE is_cover")
def cover_pick(spark, d):
    return G.emitted_images(X.images(spark, d), include=False).select("doc_id", "page_index", "img_pos", "image_id")


_SAFE = "trim(regexp_replace(image_id, '[^A-Za-z0-9_.-]', '-', 'g'), '-')"


@query(f"""WITH a AS (SELECT p_size AS doc_id, p_partkey AS asset_no, p_type || CASE WHEN p_partkey % 2 = 0 THEN '.png' ELSE '' END AS image_id, p_partkey % 7 AS page_index, p_partkey % 5 AS img_pos FROM part),
s AS (SELECT *, CASE WHEN {_SAFE} = '' THEN 'image.bin' WHEN NOT contains({_SAFE}, '.') THEN {_SAFE} || '.bin' ELSE {_SAFE} END AS safe FROM a),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, safe ORDER BY asset_no) AS r FROM s),
f AS (SELECT doc_id, asset_no, CASE WHEN r = 1 THEN safe ELSE regexp_replace(safe, '\\.[^.]*$', '') || '-p' || printf('%04d', page_index + 1) || '-' || printf('%02d', img_pos + 1) || '.' || regexp_extract(safe, '[^.]*$') END AS file_name FROM n)
SELECT *, CASE WHEN lower(file_name) LIKE '%.png' THEN 'image/png' ELSE 'application/octet-stream' END AS media_type FROM f""")
def asset_names(spark, d):
    p = X.read(spark, d, "part")
    a = p.select(F.col("p_size").alias("doc_id"), F.col("p_partkey").alias("asset_no"), F.concat("p_type", F.when(F.col("p_partkey") % 2 == 0, ".png").otherwise("")).alias("image_id"), (F.col("p_partkey") % 7).alias("page_index"), (F.col("p_partkey") % 5).alias("img_pos"))
    return G.asset_names(a).select("doc_id", "asset_no", "file_name", T.media_type("file_name").alias("media_type"))


_LINKED = "linked AS (SELECT doc_id, page_index, markdown || chr(10) || '![x](img-' || page_index || ') and ![y](img-' || (page_index + 1) || ')' AS markdown FROM pages)"


def _linked(spark, d):
    t = F.col("page_index").cast("string")
    link = F.concat(F.lit("\n![x](img-"), t, F.lit(") and ![y](img-"), (F.col("page_index") + 1).cast("string"), F.lit(")"))
    return X.pages(spark, d).withColumn("markdown", F.concat("markdown", link))


@query(f"""WITH {X.pages_sql()}, {_LINKED}, m AS (SELECT doc_id, 'img-' || page_index AS image_id, '../images/' || page_index || '.png' AS path FROM pages),
one AS (SELECT l.doc_id, l.page_index, l.markdown, a.path AS p0, b.path AS p1 FROM linked l LEFT JOIN m a ON a.doc_id = l.doc_id AND a.image_id = 'img-' || l.page_index LEFT JOIN m b ON b.doc_id = l.doc_id AND b.image_id = 'img-' || (l.page_index + 1)),
two AS (SELECT *, CASE WHEN p0 IS NULL THEN markdown ELSE replace(markdown, '](img-' || page_index || ')', '](' || p0 || ')') END AS x FROM one)
SELECT doc_id, page_index, md5(CASE WHEN p1 IS NULL THEN x ELSE replace(x, '](img-' || (page_index + 1) || ')', '](' || p1 || ')') END) AS body_md5 FROM two""")
def resolve_images(spark, d):
    t = F.col("page_index").cast("string")
    m = X.pages(spark, d).select("doc_id", F.concat(F.lit("img-"), t).alias("image_id"), F.concat(F.lit("../images/"), t, F.lit(".png")).alias("path"))
    return G.resolve_images(_linked(spark, d), m).select("doc_id", "page_index", F.md5("markdown").alias("body_md5"))


@query(f"""WITH {X.pages_sql()}, m AS (SELECT doc_id, 'img-' || page_index AS image_id, '../images/' || page_index || '.png' AS path FROM pages WHERE page_index % 2 = 0)
SELECT p.doc_id, p.page_index, coalesce(a.path, b.path) AS path FROM pages p LEFT JOIN m a ON a.doc_id = p.doc_id AND a.image_id = 'img-' || (p.page_index + 1) LEFT JOIN m b ON b.doc_id = p.doc_id AND b.image_id = 'img-' || p.page_index WHERE coalesce(a.path, b.path) IS NOT NULL""")
def comic_page_images(spark, d):
    t = F.col("page_index").cast("string")
    m = X.pages(spark, d).where("page_index % 2 = 0").select("doc_id", F.concat(F.lit("img-"), t).alias("image_id"), F.concat(F.lit("../images/"), t, F.lit(".png")).alias("path"))
    p = _linked(spark, d).withColumn("image_ids", F.array(F.lit("none"), F.concat(F.lit("img-"), (F.col("page_index") + 1).cast("string"))))
    return G.first_mapped_image(p, m)


_CONTENT = "replace(chr(10) || content || chr(10), chr(92), chr(92) || chr(92))"


@query(rf"""WITH {X.pages_sql()}, t AS (SELECT doc_id, page_index, 'tbl-' || page_index || '.html' AS id, '<table>' || markdown || ' $1 \1</table>' AS content, markdown FROM pages),
s AS (SELECT *, markdown || chr(10) || '[see](./' || id || '#a) and ![x](' || id || ' "t") <' || id || '>' || chr(10) || ' [' || id || '] ' || chr(10) || id || chr(10) || 'not ' || id AS x, replace(id, '.', '\.') AS q FROM t),
s1 AS (SELECT *, regexp_replace(x, '!?\[[^\]]*\]\((?:\./)?' || q || '(?:#[^)\s]*)?(?:\s+"[^"]*")?\)', {_CONTENT}, 'g') AS x1 FROM s),
s2 AS (SELECT *, regexp_replace(x1, '<' || q || '>', {_CONTENT}, 'g') AS x2 FROM s1),
s3 AS (SELECT *, regexp_replace(x2, '(?m)^[ \t]*\[' || q || '\][ \t]*$', {_CONTENT}, 'g') AS x3 FROM s2)
SELECT doc_id, page_index, md5(regexp_replace(x3, '(?m)^[ \t]*' || q || '[ \t]*$', {_CONTENT}, 'g')) AS body_md5 FROM s3""")
def resolve_tables(spark, d):
    i = F.concat(F.lit("tbl-"), F.col("page_index").cast("string"), F.lit(".html"))
    content = F.concat(F.lit("<table>"), F.col("markdown"), F.lit(" $1 \\1</table>"))
    shown = F.concat("markdown", F.lit("\n[see](./"), i, F.lit("#a) and ![x]("), i, F.lit(' "t") <'), i, F.lit(">\n ["), i, F.lit("] \n"), i, F.lit("\nnot "), i)
    p = X.pages(spark, d).withColumn("tables", F.array(F.struct(F.when(F.col("page_index") % 2 == 0, i).alias("id"), content.alias("html"), F.lit("| never |").alias("markdown"), F.lit(None).cast("string").alias("content"), F.when(F.col("page_index") % 2 == 1, i).alias("file_name")))).withColumn("markdown", shown)
    return G.resolve_tables(p).select("doc_id", "page_index", F.md5("markdown").alias("body_md5"))


@query(rf"WITH {X.pages_sql()}, {_LINKED} SELECT doc_id, page_index, md5(regexp_replace(markdown, '!\[[^\]]*\]\([^\)]+\)', '', 'g')) AS body_md5, nullif(regexp_extract(markdown, '!\[[^\]]*\]\(([^\)\s]+)', 1), '') AS target FROM linked")
def strip_images(spark, d):
    return _linked(spark, d).select("doc_id", "page_index", F.md5(T.strip_images("markdown")).alias("body_md5"), T.first_image_target("markdown").alias("target"))


@query(rf"""WITH {X.pages_sql()}, o AS (SELECT doc_id, page_index, row_number() OVER (PARTITION BY doc_id ORDER BY page_index) AS nth, {trim("coalesce(markdown, '')")} AS md FROM pages),
k AS (SELECT doc_id, nth, 'Page ' || (page_index + 1) || ':' || chr(10) || md || chr(10) || chr(10) AS part FROM o WHERE nth <= 8 AND md <> ''),
b AS (SELECT *, coalesce(sum(strlen(part)) OVER (PARTITION BY doc_id ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k),
s AS (SELECT doc_id, {trim("string_agg(part, '' ORDER BY nth)")} AS x FROM b WHERE before < 12000 GROUP BY doc_id)
SELECT doc_id, md5(CASE WHEN strlen(x) <= 12000 THEN x ELSE left(x, list_max(list_filter(range(3000, 12001), lambda n: strlen(left(x, n)) <= 12000))) END) AS sample_md5 FROM s""")
def metadata_sample(spark, d):
    return G.metadata_sample(X.pages(spark, d)).select("doc_id", F.md5("sample").alias("sample_md5"))


@query("""WITH v AS (SELECT doc_id, doc_id % 4 AS kind, to_base64(encode(text)) AS b FROM documents),
w AS (SELECT doc_id, kind, b, CASE kind WHEN 3 THEN false ELSE true END AS ok FROM v)
SELECT w.doc_id, ok, CASE WHEN ok THEN strlen(text)::BIGINT END AS n_bytes, CASE WHEN ok THEN md5(text) END AS body_md5 FROM w JOIN documents USING (doc_id)""")
def base64_decode(spark, d):
    b = F.regexp_replace(F.base64(F.col("text").cast("binary")), r"\s", "")
    shown = F.when(F.col("doc_id") % 4 == 0, b).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("data:image/png;base64,"), b)).when(F.col("doc_id") % 4 == 2, F.concat(F.lit(" \n"), F.regexp_replace(b, "(.{60})", "$1\r\n"), F.lit("\t"))).otherwise(F.concat(F.lit("!"), b))
    x = X.read(spark, d, "documents").select("doc_id", T.decode_base64(shown).alias("bytes"))
    return x.select("doc_id", F.col("bytes").isNotNull().alias("ok"), F.octet_length("bytes").cast("long").alias("n_bytes"), F.md5("bytes").alias("body_md5"))


# --- markup -----------------------------------------------------------------------------------------------

_AMP = "replace(replace(regexp_replace({x}, '&((?:#[xX][0-9a-fA-F]+|#[0-9]+|[A-Za-z0-9]+);)', chr(1) || '\\1', 'g'), '&', '&amp;'), chr(1), '&')"


def void(x: str) -> str:
    for tag in T.VOID_ELEMENTS:
        x = rf"replace(regexp_replace({x}, '(?i)<{tag}\b\s*([^<>]*?)\s*/?>', '<{tag} \1 />', 'g'), '<{tag}  />', '<{tag} />')"
    return x


@query(f"SELECT doc_id, md5({_AMP.format(x='text')}) AS body_md5 FROM documents")
def escape_ampersands(spark, d):
    return X.read(spark, d, "documents").select("doc_id", F.md5(T.escape_ampersands("text")).alias("body_md5"))


@query(f"SELECT page_id, md5({_AMP.format(x=void('html'))}) AS body_md5 FROM pages")
def xhtml_fragment(spark, d):
    return X.read(spark, d, "pages").select("page_id", F.md5(T.xhtml_fragment("html")).alias("body_md5"))


@query(f"SELECT doc_id, md5({escape('text')}) AS escaped_md5, {unescape(escape('text'))} = text AS round_trip FROM documents")
def xml_escape(spark, d):
    return X.read(spark, d, "documents").select("doc_id", F.md5(T.xml_escape("text")).alias("escaped_md5"), (T.xml_unescape(T.xml_escape("text")) == F.col("text")).alias("round_trip"))


@query(f"SELECT page_id, md5({unescape('html')}) AS body_md5 FROM pages")
def xml_unescape(spark, d):
    return X.read(spark, d, "pages").select("page_id", F.md5(T.xml_unescape("html")).alias("body_md5"))


@query()
def markdown_to_html(spark, d):
    return X.pages(spark, d).select("doc_id", "page_index", markdown_html("markdown").alias("xhtml"))


# --- metadata ---------------------------------------------------------------------------------------------

_COVER_LINE = squeeze(r"regexp_replace(CASE WHEN regexp_extract(y, '^\[([^\]]+)\]\(', 1) <> '' THEN regexp_extract(y, '^\[([^\]]+)\]\(', 1) ELSE y END, '<[^>]+>', '', 'g')")
_Y1 = trim("regexp_replace(x, '^#+', '')")
_Y2 = trim(rf"regexp_replace({_Y1}, '^[>\-*+\s]+', '')")
_Y3 = trim(rf"regexp_replace({_Y2}, '^[*_`]+|[*_`]+$', '', 'g')")
_COVER = rf"""c0 AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS raw FROM (SELECT doc_id, string_split(regexp_replace(markdown, '\n$', ''), chr(10)) AS l FROM covers)),
c1 AS (SELECT doc_id, pos, {trim('raw')} AS x FROM c0), c2 AS (SELECT doc_id, pos, x, {_Y3} AS y FROM c1),
c3 AS (SELECT doc_id, pos, {_COVER_LINE} AS line FROM c2 WHERE x <> '' AND NOT starts_with(x, '![') AND NOT starts_with(x, '|')),
cover_lines AS (SELECT * FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth, line FROM c3 WHERE line <> '') WHERE nth <= 24)"""
_COVERS = "covers AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '# **' || source || '**' || chr(10) || 'by ' || lang || ' Writer' || chr(10) WHEN 1 THEN 'Contents' || chr(10) || '> [A Title](x)' || chr(10) || 'Anna van Dyk-Lee' || chr(10) WHEN 2 THEN '12' || chr(10) || '![i](j)' || chr(10) || '<b>Some: Title</b>' || chr(10) || 'Edited by  unknown ' || chr(10) || 'JOHN Q. PUBLIC' || chr(10) ELSE '' END || text AS markdown FROM documents)"
_NOISE = "((regexp_matches(lower({x}), '^[0-9]*$') AND strlen({x}) <= 2) OR starts_with(lower({x}), 'isbn') OR starts_with(lower({x}), 'chapter ') OR lower({x}) IN ('contents', 'table of contents') OR regexp_matches(lower({x}), 'all rights reserved|copyright|©|www\\.|http://|https://'))"
_NAME = rf"""(NOT {_NOISE.format(x='line')} AND NOT contains(line, ':') AND NOT regexp_matches(line, '[?!]$') AND len(ws) BETWEEN 2 AND 6 AND len(list_filter(ws, lambda w: NOT (w <> '' AND NOT regexp_matches(w, '[0-9]') AND (lower(w) IN ('de', 'del', 'da', 'van', 'von', 'la', 'le') OR regexp_matches(w, '^[A-Z]') OR (upper(w) = w AND lower(w) <> w))))) = 0)"""
_MARKED = "CASE " + " ".join(f"WHEN starts_with(lower(line), '{m}') THEN {clean(f'substr(line, {len(m) + 1})')}" for m in T.AUTHOR_MARKERS) + " END"


def _covers(spark, d):
    k = F.col("doc_id") % 4
    top = F.when(k == 0, F.concat(F.lit("# **"), "source", F.lit("**\nby "), "lang", F.lit(" Writer\n"))).when(k == 1, "Contents\n> [A Title](x)\nAnna van Dyk-Lee\n").when(k == 2, "12\n![i](j)\n<b>Some: Title</b>\nEdited by  unknown \nJOHN Q. PUBLIC\n").otherwise("")
    return X.read(spark, d, "documents").select("doc_id", F.lit(0).alias("page_index"), F.concat(top, "text").alias("markdown"))


@query(f"WITH {_COVERS}, {_COVER} SELECT doc_id, nth::INT AS nth, line FROM cover_lines")
def cover_lines(spark, d):
    return M.cover_lines(_covers(spark, d))


@query(rf"""WITH {_COVERS}, {_COVER},
m AS (SELECT *, {_MARKED} AS marked, {_NOISE.format(x='line')} AS noise, list_transform(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> ''), lambda w: regexp_replace(w, '^[,.\-’'']+|[,.\-’'']+$', '', 'g')) AS ws FROM cover_lines),
t AS (SELECT *, min(CASE WHEN marked IS NULL AND NOT noise THEN nth END) OVER (PARTITION BY doc_id) AS at0 FROM m),
n AS (SELECT *, CASE WHEN {_NAME} AND nth - coalesce(at0, 1) BETWEEN 1 AND 6 THEN line END AS named FROM t)
SELECT doc_id, max(CASE WHEN nth = at0 THEN line END) AS title, coalesce(arg_min(marked, nth) FILTER (marked IS NOT NULL), arg_min(named, nth) FILTER (named IS NOT NULL)) AS author FROM n GROUP BY doc_id""")
def cover_title_author(spark, d):
    return M.cover_metadata(M.cover_lines(_covers(spark, d)))


def _first(*xs: str) -> str:
    return "coalesce(" + ", ".join(xs) + ")"


@query(f"""WITH j AS (SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS cfg_title, CASE WHEN c_custkey % 5 = 0 THEN ' ' END AS cfg_author, CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END AS cfg_publisher, CASE c_custkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS cfg_language FROM customer),
c AS (SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN n_name END AS title, 'Unknown' AS author FROM customer JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT s_suppkey AS doc_id, s_name AS title, '  ' || s_name || '  Smith ' AS author, CASE WHEN s_suppkey % 2 = 0 THEN 'unknown' ELSE 'House' END AS publisher, NULL::VARCHAR AS description, CASE WHEN s_suppkey % 4 = 0 THEN 'fr' END AS language FROM supplier),
g AS (SELECT c_custkey AS doc_id, 'null' AS title, 'Gen ' || c_custkey AS author, 'Gen House' AS publisher, 'About' AS description, 'es' AS language FROM customer WHERE c_custkey % 7 <> 0)
SELECT j.doc_id, {_first(clean('cfg_title'), clean('c.title'), clean('p.title'), clean('g.title', 'null'))} AS title, {_first(clean('cfg_author'), clean('c.author'), clean('p.author'), clean('g.author', 'null'))} AS author,
{_first(clean('cfg_publisher'), clean('p.publisher'), clean('g.publisher', 'null'))} AS publisher, {_first(clean('p.description'), clean('g.description', 'null'))} AS description,
CASE WHEN lower({clean('cfg_language')}) <> 'en' THEN {clean('cfg_language')} ELSE coalesce({clean('p.language')}, {clean('g.language', 'null')}, {clean('cfg_language')}, 'en') END AS language
FROM j LEFT JOIN c USING (doc_id) LEFT JOIN p USING (doc_id) LEFT JOIN g USING (doc_id)""")
def metadata_merge(spark, d):
    cust, k = X.read(spark, d, "customer"), F.col("c_custkey")
    jobs = cust.select(k.alias("doc_id"), F.when(k % 3 == 0, F.col("c_name")).alias("title"), F.when(k % 5 == 0, " ").alias("author"), F.when(k % 4 == 0, F.col("c_mktsegment")).alias("publisher"), F.when(k % 3 == 0, "en").when(k % 3 == 1, "de").alias("language"))
    cover = cust.join(X.read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(k.alias("doc_id"), F.when(k % 2 == 0, F.col("n_name")).alias("title"), F.lit("Unknown").alias("author"))
    s = F.col("s_suppkey")
    pdf = X.read(spark, d, "supplier").select(s.alias("doc_id"), F.col("s_name").alias("title"), F.concat(F.lit("  "), "s_name", F.lit("  Smith ")).alias("author"), F.when(s % 2 == 0, "unknown").otherwise("House").alias("publisher"), F.lit(None).cast("string").alias("description"), F.when(s % 4 == 0, "fr").alias("language"))
    gen = cust.where(k % 7 != 0).select(k.alias("doc_id"), F.lit("null").alias("title"), F.concat(F.lit("Gen "), k.cast("string")).alias("author"), F.lit("Gen House").alias("publisher"), F.lit("About").alias("description"), F.lit("es").alias("language"))
    return M.merge(jobs, cover, pdf, gen)


@query(f"""WITH s AS (SELECT doc_id, 0 AS src, regexp_split_to_array(replace(text, ' ', ';'), '[,;\\n]') AS k FROM documents UNION ALL SELECT doc_id, 1, [upper(lang), source, 'unknown', ' ' || source || ' '] FROM documents),
e AS (SELECT doc_id, src, unnest(range(len(k))) AS pos, unnest(k) AS raw FROM s), c AS (SELECT doc_id, src, pos, {clean('raw')} AS s FROM e),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(s) ORDER BY src, pos) AS nth FROM c WHERE s IS NOT NULL)
SELECT doc_id, string_agg(s, '|' ORDER BY src, pos) AS subjects FROM u WHERE nth = 1 GROUP BY doc_id""")
def subjects_union(spark, d):
    x = X.read(spark, d, "documents")
    own = x.select("doc_id", F.lit(0).alias("src"), F.split(F.replace(F.col("text"), F.lit(" "), F.lit(";")), r"[,;\n]").alias("subjects"))
    more = x.select("doc_id", F.lit(1).alias("src"), F.array(F.upper("lang"), F.col("source"), F.lit("unknown"), F.concat(F.lit(" "), "source", F.lit(" "))).alias("subjects"))
    return M.subjects(own.unionAll(more)).select("doc_id", F.array_join("subjects", "|").alias("subjects"))


@query("""SELECT doc_id, (lang = 'en' AND doc_id % 2 = 0) OR doc_id % 5 = 0 OR doc_id % 7 = 0 AS needs_generation FROM documents""")
def metadata_missing(spark, d):
    i = F.col("doc_id")
    x = X.read(spark, d, "documents").select("doc_id", F.lit("T").alias("title"), F.when(i % 5 == 0, " unknown").otherwise("A").alias("author"), F.lit("P").alias("publisher"), F.lit("D").alias("description"), F.col("lang").alias("language"), F.when(i % 2 != 0, "en").alias("pdf_language"), F.when(i % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("s"))).alias("subjects"))
    return M.missing(x).select("doc_id", "needs_generation")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 <> 2 THEN source END AS title, CASE WHEN doc_id % 3 <> 2 THEN 'A, ' || lang END AS author, CASE WHEN doc_id % 3 <> 2 THEN lang || '|x|2|3|4|5|6|7' ELSE '' END AS subjects FROM documents""")
def generated_metadata(spark, d):
    fields = F.struct(F.col("source").alias("title"), F.array(F.lit("A"), F.col("lang")).alias("author"), F.lit("null").alias("publisher"), F.array("lang", F.lit(" "), F.lit("x"), *[F.lit(str(i)) for i in range(2, 10)]).alias("subjects"))
    content = F.when(F.col("doc_id") % 3 == 0, F.to_json(fields)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("```json\n"), F.to_json(fields), F.lit("\n```"))).otherwise("no object")
    x = X.read(spark, d, "documents").select("doc_id", M.parse_generated(content).alias("m"))
    return x.select("doc_id", "m.title", "m.author", F.array_join("m.subjects", "|").alias("subjects"))


# --- archives ---------------------------------------------------------------------------------------------

_UNITS = "list_transform(string_split(source_path, '/'), lambda p: {'u': list_transform(regexp_extract_all(p, '[0-9]+|[^0-9]'), lambda x: {'c': CASE WHEN regexp_matches(x, '^[0-9]') THEN '0' ELSE lower(x) END, 'n': CASE WHEN regexp_matches(x, '^[0-9]') THEN length(regexp_replace(x, '^0+(.)', '\\1')) ELSE 0 END, 'v': CASE WHEN regexp_matches(x, '^[0-9]') THEN regexp_replace(x, '^0+(.)', '\\1') ELSE '' END, 'z': CASE WHEN regexp_matches(x, '^[0-9]') THEN length(x) ELSE 0 END}), 'raw': p})"
_ORDERED = f"ordered AS (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY {_UNITS}, source_index) - 1 AS page_no FROM archive_pages)"


@query(f"WITH {X.ARCHIVE_SQL}, {_ORDERED} SELECT archive, source_path, source_index, page_no::INT AS page_no FROM ordered")
def natural_order(spark, d):
    return A.ordered(X.archive_pages(spark, d)).select("archive", "source_path", "source_index", F.col("page_no").cast("int").alias("page_no"))


@query(f"""WITH {X.ARCHIVE_SQL}, {_ORDERED},
i AS (SELECT DISTINCT p_brand AS archive, unnest(range(20)) AS info_no FROM part),
m AS (SELECT archive, info_no, CASE WHEN info_no % 4 = 1 THEN info_no ELSE info_no * 2 END AS page_no, info_no % 5 = 0 AS deleted, info_no % 6 = 3 AS front FROM i),
k AS (SELECT o.* FROM ordered o WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.deleted AND m.archive = o.archive AND m.page_no = o.page_no)),
c AS (SELECT archive, page_no, min(info_no) AS cover_no FROM m WHERE front GROUP BY ALL),
r AS (SELECT k.*, cover_no, min(cover_no) OVER (PARTITION BY k.archive) AS best, row_number() OVER (PARTITION BY k.archive ORDER BY k.page_no) AS kept_no FROM k LEFT JOIN c ON c.archive = k.archive AND c.page_no = k.page_no)
SELECT archive, source_index, kept_no::INT AS kept_no, CASE WHEN best IS NULL THEN kept_no = 1 ELSE coalesce(cover_no = best, false) END AS is_cover, printf('page-%04d', kept_no) AS page_id FROM r""")
def comic_retained_pages(spark, d):
    pages = X.archive_pages(spark, d)
    n = F.col("info_no")
    info = pages.select("archive").distinct().select("archive", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("info_no")).select("archive", "info_no", F.when(n % 4 != 1, n * 2).alias("image"), (n % 5 == 0).alias("deleted"), (n % 6 == 3).alias("front_cover"))
    return A.retained(pages, info).select("archive", "source_index", "kept_no", "is_cover", "page_id")


_ENTRIES = X.LINES_SQL + """, entries AS (SELECT l_orderkey AS archive, l_linenumber AS entry_index, CASE l_partkey % 11 WHEN 0 THEN '../up.png' WHEN 1 THEN '__MACOSX/a.png' WHEN 2 THEN 'ComicInfo.xml' WHEN 3 THEN 'c:/x.png' WHEN 4 THEN 'notes.txt' WHEN 5 THEN 'a/._b.PNG' ELSE 'p/' || l_linenumber || '.JPG' END AS path,
    l_partkey % 13 = 0 AS is_dir, CASE WHEN l_partkey % 17 = 0 THEN 40960 ELSE 33188 END AS unix_mode, l_partkey % 19 = 0 AS encrypted, (l_quantity * CASE WHEN l_partkey % 23 = 0 THEN 3000000 ELSE 1000 END)::BIGINT AS declared_size, (l_partkey % 29)::BIGINT AS compressed_size FROM order_lines)"""
_CHECKED = """w AS (SELECT *, sum(CASE WHEN is_dir THEN 0 ELSE declared_size END) OVER (PARTITION BY archive ORDER BY entry_index ROWS UNBOUNDED PRECEDING) AS running, NOT is_dir AND lower(path) = 'comicinfo.xml' AS info, count(*) OVER (PARTITION BY archive) AS n,
    regexp_matches(path, '(?i)(^|/)(__macosx|\\.ds_store|thumbs\\.db)(/|$)') OR regexp_matches(path, '(^|/)\\._') AS junk, regexp_matches(path, '(?i)\\.(jpg|jpeg|png)$') AS img FROM entries),
v AS (SELECT *, count(*) FILTER (info) OVER (PARTITION BY archive) AS infos, count(*) FILTER (NOT is_dir AND img AND NOT junk) OVER (PARTITION BY archive) AS imgs FROM w),
checked AS (SELECT archive, entry_index, CASE WHEN is_dir THEN 'directory' WHEN junk THEN 'ignored' WHEN lower(path) = 'comicinfo.xml' THEN 'info' WHEN img THEN 'image' ELSE 'ignored' END AS kind, running::BIGINT AS running_size,
    CASE WHEN n > 10000 THEN 'too_many_entries' WHEN regexp_matches(path, '^/|^.:|(^|/)\\.\\.(/|$)') THEN 'unsafe_path' WHEN unix_mode = 40960 THEN 'irregular_entry' WHEN encrypted THEN 'encrypted' WHEN NOT is_dir AND declared_size > 104857600 THEN 'entry_too_large'
    WHEN NOT is_dir AND running > 2147483648 THEN 'total_too_large' WHEN NOT is_dir AND declared_size > 0 AND (compressed_size = 0 OR declared_size > compressed_size * 1000) THEN 'ratio_exceeded' WHEN info AND infos > 1 THEN 'duplicate_info' WHEN info AND declared_size > 1048576 THEN 'info_too_large' WHEN imgs > 2000 THEN 'too_many_pages' END AS broken FROM v)"""


def _entries(spark, d):
    k = F.col("l_partkey")
    path = F.when(k % 11 == 0, "../up.png").when(k % 11 == 1, "__MACOSX/a.png").when(k % 11 == 2, "ComicInfo.xml").when(k % 11 == 3, "c:/x.png").when(k % 11 == 4, "notes.txt").when(k % 11 == 5, "a/._b.PNG").otherwise(F.concat(F.lit("p/"), F.col("l_linenumber").cast("string"), F.lit(".JPG")))
    return X.order_lines(spark, d).select(F.col("l_orderkey").alias("archive"), F.col("l_linenumber").alias("entry_index"), path.alias("path"), (k % 13 == 0).alias("is_dir"), F.when(k % 17 == 0, 40960).otherwise(33188).alias("unix_mode"), (k % 19 == 0).alias("encrypted"), (F.col("l_quantity") * F.when(k % 23 == 0, 3_000_000).otherwise(1000)).cast("long").alias("declared_size"), (k % 29).alias("compressed_size"))


@query(f"WITH {_ENTRIES}, {_CHECKED} SELECT * FROM checked")
def archive_checks(spark, d):
    return A.checked(_entries(spark, d)).select("archive", "entry_index", "kind", "running_size", "broken")


@query(f"WITH {_ENTRIES}, {_CHECKED} SELECT archive, count(*) AS n_entries, count(*) FILTER (kind = 'image') AS n_pages, coalesce(arg_min(broken, entry_index) FILTER (broken IS NOT NULL), CASE WHEN count(*) FILTER (kind = 'image') = 0 THEN 'no_pages' END) AS broken FROM checked GROUP BY archive")
def archive_verdicts(spark, d):
    return A.verdicts(_entries(spark, d))


@query("SELECT p_partkey, w <= 0 OR h <= 0 OR w > 100000 OR h > 100000 OR w * h > 100000000 OR w * h * 4 > 536870912 AS broken FROM (SELECT p_partkey, (p_partkey * 37 % 110000)::BIGINT AS w, (p_size * 997)::BIGINT AS h FROM part)")
def image_limits(spark, d):
    x = X.read(spark, d, "part").select("p_partkey", (F.col("p_partkey") * 37 % 110000).alias("w"), (F.col("p_size") * 997).cast("long").alias("h")).withColumn("n", F.col("w") * F.col("h") * 4)
    return x.select("p_partkey", A.image_limits_broken("w", "h", "n").alias("broken"))


@query(r"SELECT url, page_id, regexp_matches(p, '(?i)\.(pdf|cbz)$') AS is_book, array_to_string(list_filter(string_split(replace(p, '\', '/'), '/'), lambda x: x NOT IN ('', '.')), '/') AS normal, regexp_extract(p, '[^/\\]*$') AS base FROM (SELECT *, replace(url, '//', '/./') || CASE page_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '\b.CBZ' ELSE '' END AS p FROM pages)")
def path_functions(spark, d):
    p = F.concat(F.replace(F.col("url"), F.lit("//"), F.lit("/./")), F.when(F.col("page_id") % 3 == 0, ".pdf").when(F.col("page_id") % 3 == 1, "\\b.CBZ").otherwise(""))
    x = X.read(spark, d, "pages").select("url", "page_id", p.alias("p"))
    return x.select("url", "page_id", P.is_book("p").alias("is_book"), P.normalized("p").alias("normal"), P.basename("p").alias("base"))


# --- batches ----------------------------------------------------------------------------------------------


@query(f"WITH {X.JOBS_SQL} SELECT count(*) FILTER (status = 'done') AS successes, count(*) FILTER (status = 'error') AS failures, coalesce(sum(pages) FILTER (status = 'done'), 0)::BIGINT AS pages, coalesce(sum(chapters) FILTER (status = 'done'), 0)::BIGINT AS chapters, coalesce(sum(images) FILTER (status = 'done'), 0)::BIGINT AS images, count(*) FILTER (status = 'done' AND cache_hit) AS cache_hits FROM jobs")
def batch_summary(spark, d):
    return B.summary(X.jobs(spark, d))


@query(f"WITH {X.JOBS_SQL} SELECT kind, CASE kind WHEN 'BadArgs' THEN 2 WHEN 'Api' THEN 3 WHEN 'OcrSchema' THEN 4 WHEN 'Epub' THEN 5 WHEN 'Validation' THEN 6 ELSE 1 END::INT AS exit_code, failures FROM (SELECT arg_min(kind, input_order) AS kind, count(*) AS failures FROM jobs WHERE status = 'error') WHERE failures > 0")
def batch_first_failure(spark, d):
    return B.first_failure(X.jobs(spark, d))


@query(f"WITH {X.JOBS_SQL} SELECT folder, status, count(*) AS n FROM jobs GROUP BY ALL")
def job_status_counts(spark, d):
    return B.status_counts(X.jobs(spark, d))


@query(f"WITH {X.JOBS_SQL} SELECT DISTINCT path FROM (SELECT path FROM jobs WHERE status = 'pending') WHERE path NOT IN (SELECT path FROM jobs WHERE status = 'done')")
def queue_new(spark, d):
    x = X.jobs(spark, d)
    return B.queue(x.where("status = 'done'"), x.where("status = 'pending'").select("path"))


@query(f"""WITH {X.JOBS_SQL}, c AS (SELECT doc_id, input_order, regexp_replace(path, '([^/])\\.[^./]*$', '\\1') AS stem FROM jobs)
SELECT doc_id, CASE WHEN r = 1 THEN stem || '.epub' ELSE stem || '-' || r || '.epub' END AS output_path FROM (SELECT *, row_number() OVER (PARTITION BY lower(stem) ORDER BY input_order) AS r FROM c)""")
def output_paths(spark, d):
    return B.output_paths(X.jobs(spark, d)).select("doc_id", "output_path")


@query(f"""WITH {X.JOBS_SQL}, c AS (SELECT doc_id, input_order, regexp_replace(path, '[.][^.]*$', '') AS stem FROM jobs), n AS (SELECT *, row_number() OVER (PARTITION BY lower(stem) ORDER BY input_order) AS n FROM c)
SELECT doc_id, stem || CASE WHEN n = 1 THEN '' ELSE '-' || n END || '.epub' AS output_path FROM n""")
def output_paths_probed(spark, d):
    return B.unique_paths(X.jobs(spark, d).select("doc_id", "path", "input_order")).select("doc_id", "output_path")


_KEY = "sha256(text || 'model-1' || 'html' || CASE WHEN doc_id % 2 = 0 THEN '1' ELSE '0' END || '0' || '1' || '0.1')"


@query(f"SELECT doc_id, {_KEY} AS cache_key FROM documents")
def cache_key(spark, d):
    return X.read(spark, d, "documents").select("doc_id", _key().alias("cache_key"))


def _key():
    return T.cache_key("text", F.lit("model-1"), F.lit("html"), F.col("doc_id") % 2 == 0, F.lit(False), "0.1")


_CACHE = f"keyed AS (SELECT doc_id, {_KEY} AS cache_key FROM documents), cache AS (SELECT DISTINCT cache_key, CASE WHEN quality = 1 THEN 'held' END AS payload FROM keyed JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) USING (doc_id) WHERE quality = 1)"


def _cached(spark, d):
    jobs = X.read(spark, d, "documents").select("doc_id", _key().alias("cache_key"))
    q = X.read(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    cache = jobs.join(q, "doc_id").select("cache_key", F.when(F.col("quality") == 1, "held").alias("payload")).distinct()
    return jobs, cache


@query(f"WITH {_CACHE} SELECT doc_id, payload, payload IS NOT NULL AS cache_hit FROM keyed LEFT JOIN cache USING (cache_key)")
def cache_lookup(spark, d):
    return B.cached(*_cached(spark, d)).select("doc_id", "payload", "cache_hit")


@query(f"WITH {_CACHE} SELECT doc_id FROM keyed WHERE cache_key NOT IN (SELECT cache_key FROM cache)")
def cache_miss(spark, d):
    return B.to_recognise(*_cached(spark, d)).select("doc_id")


@query("SELECT event_id, len(regexp_extract_all(raw, 'WARNING'))::BIGINT AS warnings, len(regexp_extract_all(raw, 'ERROR'))::BIGINT AS errors, event_id % 3 <> 0 AND len(regexp_extract_all(raw, 'WARNING')) = 0 AS passed FROM (SELECT event_id, replace(replace(event_type || ' ' || props, 'click', 'WARNING WARNING'), 'view', 'ERROR') AS raw FROM events)")
def validation_counts(spark, d):
    raw = F.replace(F.replace(F.concat("event_type", F.lit(" "), "props"), F.lit("click"), F.lit("WARNING WARNING")), F.lit("view"), F.lit("ERROR"))
    x = X.read(spark, d, "events").select("event_id", raw.alias("raw"), (F.col("event_id") % 3 != 0).alias("exit_ok"))
    return B.validation(x, fail_on_warnings=True).select("event_id", "warnings", "errors", "passed")


@query("SELECT user_id AS doc, arg_max(event_type, event_id) AS stage, max(event_id) AS seq, count(*) AS n_events FROM events GROUP BY user_id")
def job_progress(spark, d):
    return B.progress(X.read(spark, d, "events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("stage"), F.col("event_id").alias("seq")))


@query(f"WITH {X.pages_sql()}, {CHAPTERS}, {X.IMAGES_SQL} SELECT p.doc_id, p.n AS pages, coalesce(c.n, 0) AS chapters, coalesce(i.n, 0) AS images FROM (SELECT doc_id, count(*) AS n FROM pages GROUP BY 1) p LEFT JOIN (SELECT doc_id, count(*) AS n FROM chapters GROUP BY 1) c USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM images GROUP BY 1) i USING (doc_id)")
def document_counts(spark, d):
    return B.counts(X.pages(spark, d), conversation_chapters(spark, d), X.images(spark, d))


@query("""SELECT event_id, CASE status WHEN 429 THEN true ELSE status BETWEEN 500 AND 599 END AS retry, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN 'E ' || event_type ELSE 'plain ' || event_id END AS message FROM (SELECT *, 420 + event_id % 190 AS status FROM events)""")
def provider_errors(spark, d):
    body = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("event_type").alias("message")))).when(F.col("event_id") % 3 == 1, F.to_json(F.struct(F.lit(" ").alias("message"), F.struct(F.concat(F.lit("E "), "event_type").alias("message")).alias("error")))).otherwise(F.concat(F.lit(" plain "), F.col("event_id").cast("string"), F.lit("\n")))
    return X.read(spark, d, "events").select("event_id", V.is_retryable(420 + F.col("event_id") % 190).alias("retry"), T.error_message(body).alias("message"))


@query("""WITH v AS (SELECT p_partkey, p_size % 4 AS a, p_partkey % 12 AS b, p_partkey % 5 AS c FROM part) SELECT p_partkey, a > 1 OR (a = 1 AND (b > 6 OR (b = 6 AND CASE WHEN c = 4 THEN 0 ELSE c END > 2))) AS newer FROM v""")
def version_compare(spark, d):
    k = F.col("p_partkey")
    third = F.when(k % 5 == 4, "x").otherwise((k % 5).cast("string"))
    v = F.concat(F.when(k % 2 == 0, "v").otherwise(""), (F.col("p_size") % 4).cast("string"), F.lit("."), (k % 12).cast("string"), F.lit("."), third, F.when(k % 3 == 0, "-rc.9").otherwise(""))
    return X.read(spark, d, "part").select("p_partkey", P.is_newer(v, F.lit("1.6.2")).alias("newer"))


@query("SELECT page_id, CASE page_id % 6 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS allowed FROM pages")
def release_url_filter(spark, d):
    k = F.col("page_id") % 6
    t = F.col("page_id").cast("string")
    u = F.when(k == 0, F.concat(F.lit("https://github.com/a/b/"), t)).when(k == 1, F.lit("https://GitHub.com/a/b")).when(k == 2, F.lit("http://github.com/a/b/x")).when(k == 3, F.lit("https://me:pw@github.com/a/b/x")).when(k == 4, F.lit("https://github.com/a/bc")).otherwise(F.col("url"))
    return X.read(spark, d, "pages").select("page_id", P.is_release_url(u, root="/a/b").alias("allowed"))


# --- packages ---------------------------------------------------------------------------------------------

MODIFIED = "2024-01-02T03:04:05Z"
_BOOKS = "books AS (SELECT doc_id, sha256(doc_id::VARCHAR) AS source_hash, min(title) AS title, CASE WHEN doc_id % 2 = 0 THEN 'A & B' END AS author, 'en' AS language, CASE WHEN doc_id % 3 = 0 THEN 'image-1.png' END AS cover_image FROM chapters GROUP BY doc_id)"


def _package(spark, d):
    chapters = Staged(spark, "package").put(C.file_names(conversation_chapters(spark, d))).withColumn("xhtml", E.page(F.col("title"), T.xml_escape("markdown"), F.lit("en")))
    i, no = F.col("doc_id"), F.lit(None).cast("string")
    books = chapters.groupBy("doc_id").agg(F.min("title").alias("title")).select("doc_id", F.sha2(i.cast("string").cast("binary"), 256).alias("source_hash"), "title", F.when(i % 2 == 0, "A & B").alias("author"), F.lit("en").alias("language"), no.alias("publisher"), no.alias("description"), F.array(F.lit("s<1>")).alias("subjects"), F.when(i % 3 == 0, "image-1.png").alias("cover_image"), F.lit("ltr").alias("direction"))
    assets = books.where("doc_id % 3 <> 2").select("doc_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("asset_no")).select("doc_id", "asset_no", F.format_string("image-%d.png", "asset_no").alias("file_name"), F.lit("image/png").alias("media_type"), F.lit(b"\x89PNG").alias("bytes"))
    return books, chapters, assets


@query(f"""WITH {X.pages_sql()}, {CHAPTERS}, {NAMED}, {_BOOKS}, i AS (SELECT doc_id, string_agg('<li><a href="text/' || {escape('file_name')} || '">' || {escape('title')} || '</a></li>', '' ORDER BY chapter_no) AS items FROM filed GROUP BY doc_id)
SELECT doc_id, md5('<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<!DOCTYPE html>' || chr(10) || '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="' || language || '" xml:lang="' || language || '"><head><title>Contents</title><link rel="stylesheet" type="text/css" href="styles/book.css"/></head><body><nav epub:type="toc" id="toc"><h1>Contents</h1><ol>' || items || '</ol></nav></body></html>' || chr(10)) AS nav_md5 FROM i JOIN books USING (doc_id)""")
def nav_document(spark, d):
    books, chapters, _ = _package(spark, d)
    return E.nav(chapters, books).select("doc_id", F.md5("nav").alias("nav_md5"))


@query(f"""WITH {X.pages_sql()}, {CHAPTERS}, {NAMED}, {_BOOKS},
c AS (SELECT doc_id, string_agg('<item id="' || chapter_id || '" href="text/' || file_name || '" media-type="application/xhtml+xml"/>', '' ORDER BY chapter_no) AS items, string_agg('<itemref idref="' || chapter_id || '"/>', '' ORDER BY chapter_no) AS refs FROM filed GROUP BY doc_id)
SELECT doc_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">urn:sha256:' || source_hash || '</dc:identifier><dc:title>' || {escape('title')} || '</dc:title><dc:language>en</dc:language>' || CASE WHEN author IS NULL THEN '' ELSE '<dc:creator>A &amp; B</dc:creator>' END || '<dc:subject>s&lt;1&gt;</dc:subject><meta property="dcterms:modified">{MODIFIED}</meta></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="css" href="styles/book.css" media-type="text/css"/>' || CASE WHEN cover_image IS NULL THEN '' ELSE '<item id="cover" href="text/cover.xhtml" media-type="application/xhtml+xml"/>' END || items ||
CASE WHEN doc_id % 3 = 2 THEN '' ELSE '<item id="img-0001" href="images/image-1.png" media-type="image/png"' || CASE WHEN cover_image IS NULL THEN '' ELSE ' properties="cover-image"' END || '/><item id="img-0002" href="images/image-2.png" media-type="image/png"/>' END || '</manifest><spine>' || CASE WHEN cover_image IS NULL THEN '' ELSE '<itemref idref="cover"/>' END || refs || '</spine></package>' || chr(10) AS opf FROM books JOIN c USING (doc_id)""")
def opf_manifest(spark, d):
    books, chapters, assets = _package(spark, d)
    return E.opf(books, chapters, assets, MODIFIED)


@query(f"""WITH {X.pages_sql()}, {CHAPTERS}, {NAMED}, {_BOOKS}, f AS (SELECT unnest(['mimetype', 'META-INF/container.xml', 'OEBPS/styles/book.css', 'OEBPS/nav.xhtml', 'OEBPS/content.opf', 'OEBPS/text/cover.xhtml']) AS path, unnest(range(6)) AS entry_no)
SELECT doc_id, entry_no::BIGINT AS entry_no, path, CASE WHEN entry_no = 0 THEN 'stored' ELSE 'deflated' END AS method FROM books, f WHERE entry_no < 5 OR cover_image IS NOT NULL
UNION ALL SELECT doc_id, chapter_no + 5, 'OEBPS/text/' || file_name, 'deflated' FROM filed UNION ALL SELECT doc_id, 4294967296 + n, 'OEBPS/images/image-' || n || '.png', 'stored' FROM books, (VALUES (1), (2)) v(n) WHERE doc_id % 3 <> 2""")
def epub_entries(spark, d):
    return E.entries(*_package(spark, d), MODIFIED).select("doc_id", "entry_no", "path", "method")


@query(f"""WITH {X.pages_sql()}, {CHAPTERS}, {NAMED}, {_BOOKS}, opf AS (SELECT doc_id, 'OEBPS/content.opf' AS path FROM books)
SELECT doc_id::VARCHAR AS doc_id, path, 'item_missing' AS rule, 'images/image-2.png' AS detail FROM opf WHERE doc_id % 5 = 1 AND doc_id % 3 <> 2
UNION ALL SELECT doc_id::VARCHAR, path, 'item_missing', 'nav.xhtml' FROM opf WHERE doc_id % 7 = 2
UNION ALL SELECT doc_id::VARCHAR, path, 'no_nav', NULL FROM opf WHERE doc_id % 7 = 2
UNION ALL SELECT doc_id::VARCHAR, 'OEBPS/text/extra.xhtml', 'undeclared', NULL FROM opf WHERE doc_id % 11 = 3
UNION ALL SELECT doc_id::VARCHAR, 'OEBPS/text/extra.xhtml', 'link_missing', 'none.xhtml' FROM opf WHERE doc_id % 11 = 3""")
def package_faults(spark, d):
    """Packages of all conversations, some of which lack a file or have one too many."""
    entries = E.entries(*_package(spark, d), MODIFIED)
    k = F.col("doc_id")
    gone = ((k % 5 == 1) & F.col("path").endswith("/image-2.png")) | ((k % 7 == 2) & F.col("path").endswith("/nav.xhtml"))
    more = entries.where((k % 11 == 3) & (F.col("path") == "mimetype")).select("doc_id", F.lit(1 << 40).alias("entry_no"), F.lit("OEBPS/text/extra.xhtml").alias("path"), "method", F.lit(b'<html><a href="none.xhtml">x</a></html>').alias("bytes"))
    return C_.faults(entries.where(~gone).unionByName(more))


# --- archives that a sink has written from documents --------------------------------------------------------

_ARCHIVES = """docs AS (SELECT DISTINCT ON (doc_id) doc_id, text, lang, source FROM documents WHERE doc_id >= 0 ORDER BY doc_id, text, lang, source),
a AS (SELECT *, printf('book-%04d.cbz', (doc_id // 40)::BIGINT) AS archive, doc_id % 40 AS n, octet_length(encode(coalesce(text, ''))) AS size FROM docs),
broken AS (SELECT archive, bool_or(doc_id % 277 = 5 AND doc_id % 2 = 1) AS broken FROM a GROUP BY archive)"""


@query(f"""WITH {_ARCHIVES}, e AS (SELECT archive, n AS entry_index, CASE WHEN doc_id % 2 = 0 THEN 'texts/' || doc_id || '.txt' ELSE 'pages/' || doc_id || '.png' END AS path, CASE WHEN doc_id % 2 = 0 THEN size END AS declared_size, doc_id FROM a)
SELECT archive, path, declared_size::BIGINT AS declared_size, false AS is_dir, false AS encrypted, 33188 AS unix_mode, (row_number() OVER (PARTITION BY archive ORDER BY entry_index))::INT AS entry_index FROM e WHERE path LIKE 'texts/%'
UNION ALL SELECT archive, 'ComicInfo.xml', NULL, false, false, 33188, 0 FROM broken""")
def zip_entries(spark, d):
    """Directories of archives that hold every document; the ratio of deflated texts is no SQL's business, so sizes are compared alone."""
    x = Z.read(spark, X.archives(spark, d)).where("path LIKE 'texts/%' OR path = 'ComicInfo.xml'").where("compressed_size > 0")
    name = F.regexp_extract("archive", "[^/]*$", 0).alias("archive")
    n = F.row_number().over(W.partitionBy("archive").orderBy("entry_index")) - 1
    return x.select(name, "path", F.when(F.col("path") != "ComicInfo.xml", F.col("declared_size")).alias("declared_size"), "is_dir", "encrypted", "unix_mode", n.alias("entry_index"))


@query(f"""WITH {_ARCHIVES} SELECT archive, 'Book & ' || arg_min(coalesce(source, 'none'), doc_id) AS title, 'W' || count(*) AS writer, NULL::VARCHAR AS publisher, NULL::VARCHAR AS summary, arg_min(coalesce(lang, 'xx'), doc_id) AS language, min(doc_id) % 80 = 0 AS right_to_left, NULL::VARCHAR AS error FROM a GROUP BY archive""")
def comicinfo_parse(spark, d):
    files = Z.read(spark, X.archives(spark, d), "content").where("path = 'ComicInfo.xml'")
    info = K.comic_info(files.select("archive", "path", "bytes")).drop("pages")
    return info.withColumn("archive", F.regexp_extract("archive", "[^/]*$", 0))


@query(f"""WITH {_ARCHIVES} SELECT archive, 'pages/' || doc_id || '.png' AS path, 'image/png' AS media_type, CASE WHEN doc_id % 277 <> 5 THEN 1 + doc_id % 7 END::INT AS width, CASE WHEN doc_id % 277 <> 5 THEN 1 + size % 5 END::INT AS height, CASE WHEN doc_id % 277 = 5 THEN 'no end' END AS probe_error FROM a WHERE doc_id % 2 = 1""")
def png_probe(spark, d):
    files = Z.read(spark, X.archives(spark, d), "content").where(F.col("path").startswith("pages/"))
    return K.probed(files.select("archive", "path", "bytes")).select(F.regexp_extract("archive", "[^/]*$", 0).alias("archive"), "path", "media_type", "width", "height", "probe_error")


@query(f"""WITH {_ARCHIVES}, p AS (SELECT archive, row_number() OVER (PARTITION BY archive ORDER BY doc_id) AS page FROM a JOIN broken USING (archive) WHERE doc_id % 2 = 1 AND NOT broken),
kept AS (SELECT archive, page - 1 AS page FROM p WHERE page > 1), books AS (SELECT DISTINCT archive FROM kept), f AS (SELECT unnest(['mimetype', 'META-INF/container.xml', 'OEBPS/styles/book.css', 'OEBPS/nav.xhtml', 'OEBPS/content.opf']) AS path, unnest(range(5)) AS entry_no)
SELECT archive AS doc_id, entry_no::BIGINT AS entry_no, path, CASE WHEN entry_no = 0 THEN 'stored' ELSE 'deflated' END AS method FROM books, f
UNION ALL SELECT archive, page + 5, printf('OEBPS/text/page-%04d.xhtml', page), 'deflated' FROM kept UNION ALL SELECT archive, 4294967296 + page, printf('OEBPS/images/page-%04d.png', page), 'stored' FROM kept""")
def comic_packages(spark, d):
    """Packages of those archives whose pages are all sound; the first page of each is marked as deleted.

    What is used more than once is written first: as one plan, each use would open and probe all archives again.
    """
    from quire.plans.convert import comics

    folder, staged = X.archives(spark, d), Staged(spark, "comics")
    probed = K.probed(Z.read(spark, folder, "content").select("archive", "entry_index", "path", "bytes", "error"))
    used = F.col("media_type").isNotNull() | (F.lower("path") == "comicinfo.xml")
    files = staged.put(probed.withColumn("bytes", F.when(used, F.col("bytes"))))
    bad = files.where("error is not null or probe_error is not null").select("archive").distinct()
    sound = files.join(bad, "archive", "left_anti")
    pages = sound.where("media_type is not null").select("archive", F.col("entry_index").alias("source_index"), F.col("path").alias("source_path"), "media_type", "extension", "width", "height", "bytes")
    books = staged.put(Z.read(spark, folder, "files").select(F.col("path").alias("archive"), "source_hash")).join(bad, "archive", "left_anti")
    info = staged.put(K.comic_info(sound.select("archive", "path", "bytes")))
    out = comics(books, pages, info, staged=staged)["entries"]
    return out.select(F.regexp_extract("doc_id", "[^/]*$", 0).alias("doc_id"), "entry_no", "path", "method")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of all conversations with their file names."""
    x = C.file_names(conversation_chapters(spark, sf_dir))
    return x.select("doc_id", "chapter_no", "title", "file_name", F.length("markdown").alias("n_chars"))
