"""Chapters of markdown documents: headings, boundaries, segments, slugs.

One exchange by document carries the whole chain: each step is a projection, an explode or a window of that document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions import text as T

# Patterns of headings, and the numbers that bound chapters.
ATX = r"(?U)^\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*\z"
SETEXT = r"(?U)^\s{0,3}(=+|-+)\s*\z"
CHAPTER_LINE = r"(?iU)^\s*(chapter|part)\s+([0-9ivxlcdm]+)\b.*\z"
#: A chapter line's most characters; a last chapter of fewer than TAIL is joined to the one before, from MANY chapters on.
LONGEST, TAIL, MANY = 90, 400, 3


def _doc() -> W:
    return W.partitionBy("doc_id")


def _by_line() -> W:
    return _doc().orderBy("line_no")


def _title(x: Column) -> Column:
    return T.trim(F.btrim(T.trim(x), F.lit("#")))


def explode_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) from (doc_id, markdown); null and blank documents have none."""
    return docs.where(T.trim("markdown") != "").select("doc_id", F.posexplode(T.lines("markdown")).alias("line_no", "line"))


def headings(lines: DataFrame) -> DataFrame:
    """Adds level and title to lines that begin a heading: hashes, or a line underlined by the next.

    An underlined line takes the next with it. So in a run of lines that could each be underlined by the
    one after, every other is, beginning with the first.
    """
    atx = _title(F.regexp_extract("line", ATX, 2))
    x = lines.withColumn("atx", F.when(F.col("line").rlike(ATX) & (atx != ""), atx))
    mark = F.regexp_extract(F.coalesce(F.lead("line").over(_by_line()), F.lit("")), SETEXT, 1)
    x = x.withColumn("mark", mark).withColumn("may", F.col("atx").isNull() & (_title(F.col("line")) != "") & (F.col("mark") != ""))
    x = x.withColumn("run", F.col("line_no") - F.row_number().over(W.partitionBy("doc_id", "may").orderBy("line_no")))
    nth = F.row_number().over(W.partitionBy("doc_id", "may", "run").orderBy("line_no"))
    x = x.withColumn("under", F.col("may") & (nth % 2 == 1))
    level = F.when(F.col("atx").isNotNull(), F.length(F.regexp_extract("line", ATX, 1))).when(F.col("under"), F.when(F.startswith("mark", F.lit("=")), 1).otherwise(2))
    title = F.coalesce("atx", F.when(F.col("under"), _title(F.col("line"))))
    return x.select(*lines.columns, level.cast("int").alias("level"), title.alias("title"))


def boundaries(headed: DataFrame) -> DataFrame:
    """Adds `boundary`, the title of a line that begins a chapter.

    First-level headings if there are any; else two or more of the second level; else two or more lines such as
    "Chapter 4", each at the start or after a blank line.
    """
    line = T.trim("line")
    before = T.trim(F.coalesce(F.lag("line").over(_by_line()), F.lit("")))
    said = (line != "") & (F.length(line) <= LONGEST) & F.col("line").rlike(CHAPTER_LINE) & (before == "")
    count = lambda c: F.count_if(c).over(_doc())
    x = headed.withColumn("said", said).withColumn("n1", count(F.coalesce(F.col("level") == 1, F.lit(False)))).withColumn("n2", count(F.coalesce(F.col("level") == 2, F.lit(False)))).withColumn("ns", count(F.col("said")))
    pick = F.when(F.col("n1") > 0, F.when(F.col("level") == 1, F.col("title"))).when(F.col("n2") >= 2, F.when(F.col("level") == 2, F.col("title"))).when(F.col("ns") >= 2, F.when(F.col("said"), _title(F.col("line"))))
    return x.select(*headed.columns, pick.alias("boundary"))


def chapters(docs: DataFrame) -> DataFrame:
    """(doc_id, chapter_no, title, markdown) from (doc_id, markdown); chapter_no from 1.

    Text before the first boundary is an introduction; a document without boundaries is one chapter.
    """
    x = boundaries(headings(explode_lines(docs)))
    x = x.withColumn("seg", F.coalesce(F.max(F.when(F.col("boundary").isNotNull(), F.col("line_no"))).over(_by_line().rowsBetween(W.unboundedPreceding, 0)), F.lit(-1)))
    by = x.groupBy("doc_id", "seg").agg(F.max("boundary").alias("boundary"), F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("own"))
    by = by.select("doc_id", "seg", "boundary", T.trim(F.array_join(F.col("own.line"), "\n")).alias("markdown"))
    some = F.max("seg").over(_doc()) >= 0
    by = by.withColumn("title", F.coalesce("boundary", F.when(some, F.lit("Introduction")).otherwise(F.lit("Document")))).where("markdown <> ''")
    order = _doc().orderBy("seg")
    by = by.withColumn("no", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(_doc()))
    last = (F.col("n") >= MANY) & (F.col("no") == F.col("n")) & (F.length("markdown") < TAIL)
    by = by.withColumn("chapter_no", F.when(last, F.col("no") - 1).otherwise(F.col("no")).cast("int"))
    out = by.groupBy("doc_id", "chapter_no").agg(F.min_by("title", "no").alias("title"), F.sort_array(F.collect_list(F.struct("no", "markdown"))).alias("own"))
    return out.select("doc_id", "chapter_no", "title", F.array_join(F.col("own.markdown"), "\n\n").alias("markdown"))


def numbered(name: Column, within: list[str], order: list[str]) -> Column:
    """name, name-2, name-3 ... in this order."""
    n = F.row_number().over(W.partitionBy(*within, name).orderBy(*order))
    return F.when(n == 1, name).otherwise(F.concat(name, F.lit("-"), n.cast("string")))


def file_names(chapters_: DataFrame) -> DataFrame:
    """Adds chapter_id, slug and file_name to chapters."""
    x = chapters_.withColumn("slug", T.slug("title")).withColumn("slug", numbered(F.col("slug"), ["doc_id"], ["chapter_no"]))
    return x.withColumn("chapter_id", F.format_string("chapter-%03d", "chapter_no")).withColumn("file_name", F.concat("chapter_id", F.lit("-"), "slug", F.lit(".xhtml")))


def heading_anchors(html: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, ordinal, level, anchor, title) of the attribute-less headings of HTML fragments; anchors are numbered within a fragment."""
    found = html.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<h[1-6]>.*?</h[1-6]>"), F.lit(0))).alias("ordinal", "h"))
    title = T.squeeze(T.xml_unescape(T.strip_tags("h")))
    x = found.select(key, "ordinal", F.substring("h", 3, 1).cast("int").alias("level"), title.alias("title"), T.slug(T.strip_tags("h")).alias("slug"))
    return x.select(key, "ordinal", "level", numbered(F.col("slug"), [key], ["ordinal"]).alias("anchor"), "title")
