"""Pages of recognised documents: order, running matter, images, tables, full text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions import text as T


def quoted(c: Column) -> Column:
    """As a regular expression that means just itself."""
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def full_text(pages: DataFrame) -> DataFrame:
    """(doc_id, markdown, n_pages): pages that aren't blank, in order of page_index and then page_pos, a blank line between.

    n_pages counts blank pages too. Only pages need be together, by document.
    """
    pos = F.col("page_pos") if "page_pos" in pages.columns else F.lit(0)
    own = F.struct(F.col("page_index"), pos.alias("pos"), T.trim("markdown").alias("md"))
    by = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(own)).alias("own"), F.count(F.lit(1)).alias("n_pages"))
    kept = F.filter(F.col("own.md"), lambda x: x != "")
    return by.select("doc_id", F.array_join(kept, "\n\n").alias("markdown"), "n_pages")


def without_running_matter(pages: DataFrame) -> DataFrame:
    """Pages (markdown, header, footer) without their headers and footers."""
    return pages.withColumn("markdown", T.strip_running("markdown", "header", "footer"))


def normalised(pages: DataFrame, images: bool = True) -> DataFrame:
    """Pages ready to be joined: no running matter, no images unless wanted, no blank ones."""
    x = without_running_matter(pages) if {"header", "footer"} <= set(pages.columns) else pages
    x = x if images else x.withColumn("markdown", T.strip_images("markdown"))
    return x.where(T.trim("markdown") != "")


def emitted_images(images: DataFrame, include: bool = True) -> DataFrame:
    """Of (doc_id, page_index, page_pos, img_pos, image_id, payload): those that become assets, with is_cover.

    An image without payload is none; of the others with one id the first of the document counts; the cover is the first of
    the document's first page. Without images in the text only the cover is kept.
    """
    order = ["page_index", "page_pos", "img_pos"]
    # pages without images count for which is first, so the caller gives them with a null image_id
    first = F.col("page_index") == F.min("page_index").over(W.partitionBy("doc_id"))
    x = images.withColumn("on_first", first).where("payload is not null and image_id is not null")
    x = x.withColumn("nth", F.row_number().over(W.partitionBy("doc_id", "image_id").orderBy(*order))).where("nth = 1").drop("nth")
    x = x.withColumn("is_cover", F.col("on_first") & (F.row_number().over(W.partitionBy("doc_id", "on_first").orderBy(*order)) == 1)).drop("on_first")
    return x if include else x.where("is_cover")


def asset_names(assets: DataFrame, within: str = "doc_id", order: tuple[str, ...] = ("asset_no",)) -> DataFrame:
    """Adds file_name: the sanitised id, or stem-pPPPP-II.ext for all but the first of its name."""
    x = assets.withColumn("safe", T.asset_name("image_id"))
    nth = F.row_number().over(W.partitionBy(within, "safe").orderBy(*order))
    stem, ext = F.regexp_replace("safe", r"\.[^.]*\z", ""), F.regexp_extract("safe", r"[^.]*\z", 0)
    other = F.concat(stem, F.lit("-p"), F.format_string("%04d-%02d", F.col("page_index") + 1, F.col("img_pos") + 1), F.lit("."), ext)
    return x.withColumn("file_name", F.when(nth == 1, F.col("safe")).otherwise(other)).drop("safe")


def resolve_images(pages: DataFrame, image_map: DataFrame) -> DataFrame:
    """Pages with targets `](id)` exchanged for `](path)`; image_map: (doc_id, image_id, path).

    The map of a document is one row; ids go in their order, so that the outcome is the same on every run.
    """
    by = image_map.groupBy(F.col("doc_id").alias("_doc")).agg(F.sort_array(F.collect_list(F.struct("image_id", "path"))).alias("_map"))
    x = pages.join(by, F.col("doc_id") == F.col("_doc"), "left")
    new = F.aggregate(F.coalesce("_map", F.array().cast("array<struct<image_id:string,path:string>>")), F.col("markdown"), lambda m, e: F.replace(m, F.concat(F.lit("]("), e["image_id"], F.lit(")")), F.concat(F.lit("]("), e["path"], F.lit(")"))))
    return x.withColumn("markdown", new).drop("_doc", "_map")


def first_mapped_image(pages: DataFrame, image_map: DataFrame) -> DataFrame:
    """(doc_id, page_index, path): the first of a page's image ids that is mapped, else its first markdown image's target if mapped or already among the images; pages with neither fall out."""
    m = image_map.select(F.col("doc_id").alias("_doc"), "image_id", "path")
    ids = pages.select("doc_id", "page_index", F.posexplode("image_ids").alias("pos", "image_id"))
    by_id = ids.join(m, (F.col("doc_id") == F.col("_doc")) & (ids["image_id"] == m["image_id"])).groupBy("doc_id", "page_index").agg(F.min_by("path", "pos").alias("by_id"))
    target = pages.select("doc_id", "page_index", T.first_image_target("markdown").alias("target"))
    t = target.join(m, (F.col("doc_id") == F.col("_doc")) & (F.col("target") == F.col("image_id")), "left").select("doc_id", "page_index", F.coalesce("path", F.when(F.startswith("target", F.lit("../images/")), F.col("target"))).alias("by_target"))
    return t.join(by_id, ["doc_id", "page_index"], "left").select("doc_id", "page_index", F.coalesce("by_id", "by_target").alias("path")).where("path is not null")


def table_content(table: Column, prefer: str = "html") -> Column:
    """The first of a table's forms that is there, in order of preference; null if that one is blank."""
    forms = ("html", "content", "markdown") if prefer == "html" else ("markdown", "content", "html")
    chosen = F.coalesce(*[table[f] for f in forms])
    return F.when(T.trim(chosen) != "", chosen)


def table_identifiers(t: Column, page_index: Column, i: Column, fields: list[str]) -> Column:
    """What a table's placeholders may call it: its id and the other names it has, none blank, each once, then tbl-PAGE-NUMBER.html, which it always has."""
    names = [t[k] for k in ("id", "table_id", "file_name", "path", "placeholder") if k in fields]
    fallback = F.concat(F.lit("tbl-"), page_index.cast("string"), F.lit("-"), i.cast("string"), F.lit(".html"))
    own = F.filter(F.array(*[T.trim(n) for n in names]), lambda n: n.isNotNull() & (n != ""))
    return F.array_distinct(F.concat(own, F.array(fallback)))


def resolve_tables(pages: DataFrame, prefer: str = "html") -> DataFrame:
    """Pages whose placeholders for their own tables (array<struct<id, html, markdown, content>>, and table_id, file_name, path or placeholder if they are there) are exchanged for the tables.

    A placeholder is a link or image to one of a table's identifiers, that in angle brackets, or in brackets or bare alone on a line.
    Content is put in as it is: signs that mean something in a replacement mean nothing here.
    """

    fields = pages.schema["tables"].dataType.elementType.names

    def named(md: Column, name: Column, safe: Column) -> Column:
        q = quoted(name)
        # The shapes of a placeholder.
        shapes = [
            F.concat(F.lit(r"!?\[[^\]]*\]\((?:\./)?"), q, F.lit(r"(?:#[^)\s]*)?(?:\s+\"[^\"]*\")?\)")),
            F.concat(F.lit("<"), q, F.lit(">")),
            F.concat(F.lit(r"(?m)^[ \t]*\["), q, F.lit(r"\][ \t]*$")),
            F.concat(F.lit(r"(?m)^[ \t]*"), q, F.lit(r"[ \t]*$")),
        ]
        return reduce(lambda m, s: F.regexp_replace(m, s, safe), shapes, md)

    def one(md: Column, t: Column, i: Column) -> Column:
        content = F.concat(F.lit("\n"), table_content(t, prefer), F.lit("\n"))
        safe = F.replace(F.replace(content, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        every = F.aggregate(table_identifiers(t, F.col("page_index"), i, fields), md, lambda m, name: named(m, name, safe))
        return F.when(safe.isNotNull(), every).otherwise(md)

    indexed = F.transform("tables", lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    return pages.withColumn("markdown", F.coalesce(F.aggregate(indexed, F.col("markdown"), lambda m, e: one(m, e["t"], e["i"])), "markdown"))


def cut_bytes(c: Column, most: int) -> Column:
    """The longest beginning of a text that has at most so many bytes of UTF-8 and ends with a whole character."""
    b = c.cast("binary")
    inside = F.hex(F.substring(b, most + 1, 1)).rlike("^[89AB]")  # the next byte continues a character
    cut = F.make_valid_utf8(F.substring(b, 1, most).cast("string"))
    return F.when(F.octet_length(b) <= most, c).when(inside, F.regexp_replace(cut, "\ufffd\\z", "")).otherwise(cut)


def metadata_sample(pages: DataFrame, most_pages: int = 8, most_bytes: int = 12_000) -> DataFrame:
    """(doc_id, sample): the first pages but blank ones, each under its number, until there are `most_bytes`, at which the sample is cut."""
    order = W.partitionBy("doc_id").orderBy("page_index")
    text = T.trim(F.coalesce("markdown", F.lit("")))
    x = pages.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most_pages).withColumn("text", text).where("text <> ''")
    x = x.withColumn("part", F.concat(F.lit("Page "), (F.col("page_index") + 1).cast("string"), F.lit(":\n"), F.col("text"), F.lit("\n\n")))
    x = x.withColumn("before", F.coalesce(F.sum(F.octet_length("part")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < most_bytes)
    by = x.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("nth", "part"))).alias("own"))
    return by.select("doc_id", cut_bytes(T.trim(F.array_join(F.col("own.part"), "")), most_bytes).alias("sample"))
