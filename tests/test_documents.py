"""Document operators on literals: chapters, pages, markup, metadata."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.markdown import anchored, render
from quire.operators import chapters as C, metadata as M, pages as G

LONG = "x" * 500


def chapters(spark, markdown):
    rows = C.chapters(spark.createDataFrame([(1, markdown)], "doc_id long, markdown string")).orderBy("chapter_no").collect()
    return [(r.title, r.markdown) for r in rows]


@pytest.mark.parametrize(
    ("markdown", "titles"),
    [
        ("# One\na\n\n# Two\nb", ["One", "Two"]),
        ("## First\na\n## Second\nb", ["First", "Second"]),
        ("One\n===\na\n\nTwo\n===\nb", ["One", "Two"]),
        ("CHAPTER 1\na\n\nCHAPTER 2\nb", ["CHAPTER 1", "CHAPTER 2"]),
        ("## Only\na", ["Document"]),
        ("# Top\n## Sub\na\n## Sub2\nb", ["Top"]),
        ("before\n# One\na", ["Introduction", "One"]),
        ("", []),
        (" \n ", []),
        ("plain", ["Document"]),
        ("# One\na\nCHAPTER 1\nb", ["One"]),
        ("CHAPTER 1 " + "y" * 90 + "\na\n\nCHAPTER 2\nb", ["Document"]),
        ("text\nCHAPTER 1\na\n\nCHAPTER 2\nb", ["Document"]),
        ("A\n---\n---\n---\nB\n---", ["A", "---", "B"]),
        ("# \ntext\n====\nmore", ["Introduction", "text"]),
        ("```\n# code\n```\n# real", ["Introduction", "code", "real"]),
    ],
)
def test_titles(spark, markdown, titles):
    got = [t for t, _ in chapters(spark, markdown)]
    assert got == titles or (len(titles) >= 3 and got == titles[:-1])  # a short last chapter goes to the one before


def test_short_tail(spark):
    got = chapters(spark, f"# A\n{LONG}\n# B\n{LONG}\n# C\nshort")
    assert [t for t, _ in got] == ["A", "B"] and got[1][1].endswith("# C\nshort")
    assert [t for t, _ in chapters(spark, f"# A\n{LONG}\n# B\nb\n# C\n{LONG}")] == ["A", "B", "C"]


def test_file_names(spark):
    x = C.file_names(spark.createDataFrame([(1, 1, "A b"), (1, 2, "a-B"), (1, 3, "Ж"), (2, 1, "a b")], "doc_id long, chapter_no int, title string"))
    assert {(r.doc_id, r.file_name) for r in x.collect()} == {(1, "chapter-001-a-b.xhtml"), (1, "chapter-002-a-b-2.xhtml"), (1, "chapter-003-chapter.xhtml"), (2, "chapter-001-a-b.xhtml")}


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    v = lambda c: value(spark, c)
    lit = F.lit
    assert v(T.trim(lit("  a b \n"))) == "a b"
    assert v(T.clean_value(lit(" Un known "))) == "Un known" and v(T.clean_value(lit(" UNKNOWN"))) is None and v(T.clean_generated(lit("null"))) is None
    assert [v(T.slug(lit(s))) for s in ("Héllo, World!", "--", "A_b")] == ["h-llo-world", "chapter", "a-b"]
    assert [v(T.asset_name(lit(s))) for s in ("a b!.png", "---", "x")] == ["a-b-.png", "image.bin", "x.bin"]
    assert [v(T.media_type(lit(s))) for s in ("a.JPG", "b.svg", "c", "d.xyz")] == ["image/jpeg", "image/svg+xml", "application/octet-stream", "application/octet-stream"]
    assert [v(T.file_stem(lit(s))) for s in ("a/b.c.pdf", ".pdf", "x")] == ["b.c", ".pdf", "x"]
    assert [v(T.decode_base64(lit(s))) for s in ("aGk=", "data:image/png;base64,aG\nk=", "aGk", "a!k=", "")] == [b"hi", b"hi", None, None, b""]
    assert v(T.strip_running(lit("  Head\n\nbody\n\nFoot "), lit("Head"), lit("Foot"))) == "body"
    assert v(T.strip_running(lit(" body "), lit("Head"), lit(None).cast("string"))) == " body "
    assert v(T.escape_ampersands(lit("a & b &amp; &#12; &#xAf; &x &; AT&T;"))) == "a &amp; b &amp; &#12; &#xAf; &amp;x &amp;; AT&T;"
    assert v(T.close_void_elements(lit('<BR><img src="a"><hr/><colgroup><col width="1">'))) == '<br /><img src="a" /><hr /><colgroup><col width="1" />'
    assert v(T.xml_unescape(lit("&amp;lt; &lt;"))) == "&lt; <"
    assert [v(T.marked_author(lit(s))) for s in ("By A B", "author: C", "none", "by unknown")] == ["A B", "C", None, None]
    assert v(T.keywords(lit("a, b;; unknown\nc"))) == ["a", "b", "c"]
    assert [v(T.language(lit(a), lit(b).cast("string"), lit(c).cast("string"))) for a, b, c in (("de", "fr", "es"), ("en", "fr", "es"), ("en", None, "es"), ("en", None, None))] == ["de", "fr", "es", "en"]
    assert v(T.lines(lit("a\r\nb\n"))) == ["a", "b"]
    assert [v(T.exit_code(lit(k))) for k in ("BadArgs", "Api", "OcrSchema", "Epub", "Validation", "Internal", "x")] == [2, 3, 4, 5, 6, 1, 1]


def test_cache_key_depends_on_options(spark):
    key = lambda *a: value(spark, T.cache_key(F.lit(a[0]), F.lit(a[1]), F.lit(a[2]), F.lit(a[3]), F.lit(a[4]), "1"))
    keys = {key("b", "m", "html", True, True), key("b", "m2", "html", True, True), key("b", "m", "markdown", True, True), key("b", "m", "html", False, True), key("b2", "m", "html", True, True)}
    assert len(keys) == 5


def test_tables(spark):
    more = [(1, 0, "[x](f.html) <p> [tbl-0-0.html](tbl-0-0.html) <id>", [("id", "A", None, None, "f.html", " p ")])]
    u = "struct<id:string,html:string,markdown:string,content:string,file_name:string,placeholder:string>"
    assert G.resolve_tables(spark.createDataFrame(more, f"doc_id long, page_index long, markdown string, tables array<{u}>")).first().markdown == "\nA\n \nA\n \nA\n \nA\n"
    t = "struct<id:string,html:string,markdown:string,content:string>"
    rows = [(1, 0, "[t1](t1) and ![x](./t1#f \"n\")\n[t1]\nt1\n<t1> not t1", [("t1", "<b>$5 \\1</b>", "m", "c")]), (1, 1, "[tbl-1-0.html](tbl-1-0.html)", [(None, None, "| m |", "c")]), (2, 0, "[b]", [("b", " ", "m", None)]), (3, 0, None, None)]
    got = {(r.doc_id, r.page_index): r.markdown for r in G.resolve_tables(spark.createDataFrame(rows, f"doc_id long, page_index long, markdown string, tables array<{t}>")).collect()}
    assert got[1, 0].count("<b>$5 \\1</b>") == 5 and got[1, 0].endswith("not t1") and got[1, 1] == "\nc\n" and got[2, 0] == "[b]" and got[3, 0] is None


def test_images(spark):
    rows = [(1, 0, 0, 0, "a", None), (1, 0, 0, 1, "b", "x"), (1, 1, 1, 0, "a", "y"), (1, 2, 2, 0, "b", "z"), (2, 0, 0, None, None, None), (2, 1, 1, 0, "c", "w")]
    images = spark.createDataFrame(rows, "doc_id long, page_index long, page_pos int, img_pos int, image_id string, payload string")
    assert {(r.doc_id, r.image_id, r.payload, r.is_cover) for r in G.emitted_images(images).collect()} == {(1, "b", "x", True), (1, "a", "y", False), (2, "c", "w", False)}
    assert [r.image_id for r in G.emitted_images(images, include=False).collect()] == ["b"]


def test_cover(spark):
    pages = spark.createDataFrame([(1, 0, "# The Title\nby Jane Doe"), (2, 0, "The Title\nJane Q. Doe\nCopyright 2001"), (3, 0, "ISBN 1\n12\nWhy?\n- Ludwig van Beethoven"), (4, 0, "")], "doc_id long, page_index long, markdown string")
    got = {r.doc_id: (r.title, r.author) for r in M.cover_metadata(M.cover_lines(pages)).collect()}
    assert got == {1: ("The Title", "Jane Doe"), 2: ("The Title", "Jane Q. Doe"), 3: ("Why?", "Ludwig van Beethoven")}


def test_generated(spark):
    said = '```json\n{"title": "T", "author": ["A", "B"], "language": "null", "publisher": "unknown", "subjects": "x; y, x"}\n```'
    m = value(spark, M.parse_generated(F.lit(said)))
    assert (m.title, m.author, m.language, m.publisher, m.description, m.subjects) == ("T", "A, B", None, None, None, ["x", "y", "x"])
    assert value(spark, M.parse_generated(F.lit("nothing"))).subjects == []


def test_markdown():
    assert render("# A *b*\n\ntext **c** `d<`\nmore  \nend") == "<h1>A <em>b</em></h1>\n<p>text <strong>c</strong> <code>d&lt;</code>\nmore<br />\nend</p>"
    assert render("- a\n- [x] b\n  - c\n\n1. d") .startswith("<ul>\n<li>a</li>\n<li><input type=\"checkbox\" disabled=\"disabled\" checked=\"checked\" /> b\n<ul>\n<li>c</li>\n</ul></li>")
    assert render("| a | b |\n|---|---|\n| 1 | ~~2~~ |") == "<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td><del>2</del></td></tr></tbody></table>"
    assert render("> q & r") == '<aside class="callout">\n<p>q &amp; r</p>\n</aside>'
    assert render("```\n<x>\n```") == "<pre><code>&lt;x&gt;</code></pre>" and render(None) == "" and render("a[^1]\n\n[^1]: note").endswith('<li id="fn-1">note</li></ol></section>')
    assert render("T\n===\n![i](a.png) [l](b)") == '<h1>T</h1>\n<p><img src="a.png" alt="i" /> <a href="b">l</a></p>'
    assert anchored("<h1>A</h1><h2>a</h2><h2>B <em>c</em></h2>") == '<h1 id="a">A</h1><h2 id="a-2">a</h2><h2 id="b-c">B <em>c</em></h2>'


@pytest.mark.parametrize(("text", "shown"), [
    ('[the site][1], [Other], [none][x] ![pic][1]\n\n[1]: https://e.org/?b=1&c=2 "T"\n[other]: <o.html>', '<p><a href="https://e.org/?b=1&amp;c=2">the site</a>, <a href="o.html">Other</a>, [none][x] <img src="https://e.org/?b=1&amp;c=2" alt="pic" /></p>'),
    ("[A  b][]\n\n> [a B]\n\n[a b]: one\n[A B]: two", '<p><a href="one">A  b</a></p>\n<aside class="callout">\n<p><a href="one">a B</a></p>\n</aside>'),
    ("a &nbsp;b &copy; &amp; &unknown; & &#65; &lt;", "<p>a \u00a0b © &amp; &amp;unknown; &amp; &#65; &lt;</p>"),
    ("text\n\n    code <x>\n\n      more\n\nend", "<p>text</p>\n<pre><code>code &lt;x&gt;\n\n  more\n</code></pre>\n<p>end</p>"),
    ("```\n[a]: b\n```\n[a]", "<pre><code>[a]: b</code></pre>\n<p>[a]</p>"),
    ("- [x] done [l][r]\n\n[r]: u", '<ul>\n<li><input type="checkbox" disabled="disabled" checked="checked" /> done <a href="u">l</a></li>\n</ul>'),
])
def test_markdown_links_code_and_entities(text, shown):
    assert render(text) == shown


def test_sample_is_cut(spark):
    rows = [(1, 0, "a" * 7000), (1, 1, "  \n"), (1, 2, "é" * 2000), (1, 3, "b" * 3000), (1, 4, "never"), (2, 9, "one"), (3, 0, " ")]
    rows += [(4, i, "x") for i in range(10)] + [(5, 0, "🙂" * 4000), (6, 0, "a" + "🙂" * 4000)]
    got = {r.doc_id: r.sample for r in G.metadata_sample(spark.createDataFrame(rows, "doc_id long, page_index long, markdown string")).collect()}
    whole = "Page 1:\n" + "a" * 7000 + "\n\nPage 3:\n" + "é" * 2000 + "\n\nPage 4:\n" + "b" * 3000
    assert got[1] == whole.encode()[:12_000].decode() and got[2] == "Page 10:\none" and 3 not in got
    assert got[4].count("Page") == 8
    for i, text in ((5, rows[-2][2]), (6, rows[-1][2])):
        assert got[i] == ("Page 1:\n" + text).encode()[:12_000].decode(errors="ignore")


def test_names_of_assets_on_late_pages(spark):
    rows = [(1, n, 999 + 9001 * n, 0, "x.png") for n in range(3)]
    got = G.asset_names(spark.createDataFrame(rows, "doc_id long, asset_no int, page_index int, img_pos int, image_id string")).collect()
    assert sorted(r.file_name for r in got) == ["x-p10001-01.png", "x-p19002-01.png", "x.png"]


def test_noise_is_about_the_edition(spark):
    noise = lambda s: value(spark, M.is_noise(F.lit(s)))
    assert not noise("The Rights of Man") and noise("ALL RIGHTS RESERVED") and noise("see http://x") and noise("© 2020") and noise("7")
