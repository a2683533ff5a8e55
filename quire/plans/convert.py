"""Whole conversions: recognised documents, or archives of page images, to package entries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from quire.functions import text as T
from quire.functions.markdown import markdown_html
from quire.operators import archive as A, chapters as C, epub as E, metadata as M, pages as G
from quire.session import Staged, reachable
from quire.sources import payloads as Y


@dataclass
class Options:
    """What holds for a whole batch; what differs by document are columns of its jobs."""

    include_images: bool = True
    table_format: str = "html"
    comic: bool = False
    language: str = "en"
    modified: str = "2000-01-01T00:00:00Z"


def assets(pages: DataFrame, include: bool = True) -> DataFrame:
    """(doc_id, asset_no, image_id, file_name, media_type, is_cover, bytes, error): an image that can't be decoded is told, not passed over."""
    x = G.emitted_images(Y.images(pages), include)
    x = x.withColumn("asset_no", F.row_number().over(W.partitionBy("doc_id").orderBy("page_index", "page_pos", "img_pos")))
    x = G.asset_names(x).withColumn("bytes", T.decode_base64("payload"))
    return x.select("doc_id", "asset_no", "image_id", "file_name", T.media_type("file_name").alias("media_type"), "is_cover", "bytes", F.when(F.col("bytes").isNull(), F.lit("image is not base64")).alias("error"))


def comic_chapters(pages: DataFrame, image_map: DataFrame) -> DataFrame:
    """Pages as chapters that are one image each: (doc_id, chapter_no, title, chapter_id, file_name, image). Pages without an image fall out."""
    ids = pages.withColumn("image_ids", F.transform("images", lambda i: i["id"]))
    own = G.first_mapped_image(ids, image_map).withColumn("chapter_no", F.row_number().over(W.partitionBy("doc_id").orderBy("page_index")).cast("int"))
    page_id = F.format_string("page-%04d", "chapter_no")
    return own.select("doc_id", "chapter_no", F.concat(F.lit("Page "), F.col("chapter_no").cast("string")).alias("title"), page_id.alias("chapter_id"), F.concat(page_id, F.lit(".xhtml")).alias("file_name"), F.col("path").alias("image"), F.lit("").alias("markdown"))


def recognised(jobs: DataFrame, options: Options | None = None, pdf: DataFrame | None = None, generated: DataFrame | None = None) -> dict[str, DataFrame]:
    """books, chapters, assets, entries and errors of jobs (doc_id, path, source_hash, payload, title, author, publisher, language).

    pdf and generated: metadata by doc_id (operators.metadata.FIELDS, subjects), if there is any. A document whose images are
    broken, or that has nothing to read, is a row of errors; the others go on.
    """
    options = options or Options()
    reachable(jobs.sparkSession)
    pages = Y.pages(jobs)
    images = assets(pages, options.include_images)
    bad = images.where("error is not null").groupBy("doc_id").agg(F.first("error").alias("message"))
    images = images.where("error is null")
    image_map = images.select("doc_id", "image_id", F.concat(F.lit("../images/"), "file_name").alias("path"))
    ready = G.resolve_tables(G.without_running_matter(pages), options.table_format)
    ready = G.resolve_images(ready, image_map) if options.include_images else ready.withColumn("markdown", T.strip_images("markdown"))
    chapters = comic_chapters(pages, image_map) if options.comic else C.file_names(C.chapters(G.full_text(ready)))
    chapters = chapters.join(bad.select("doc_id"), "doc_id", "left_anti")
    empty = jobs.select("doc_id").join(chapters.select("doc_id").distinct(), "doc_id", "left_anti").join(bad.select("doc_id"), "doc_id", "left_anti").withColumn("message", F.lit("no readable content"))
    errors = bad.select("doc_id", F.lit("OcrSchema").alias("kind"), "message").unionByName(empty.select("doc_id", F.lit("OcrSchema").alias("kind"), "message"))
    cover = M.cover_metadata(M.cover_lines(pages.select("doc_id", "page_index", "markdown")))
    none = jobs.select("doc_id", *[F.lit(None).cast("string").alias(f) for f in M.FIELDS], F.array().cast("array<string>").alias("subjects"))
    pdf, generated = none if pdf is None else pdf, none if generated is None else generated
    merged = M.merge(jobs.fillna({"language": options.language}), cover, pdf, generated)
    topics = M.subjects(pdf.select("doc_id", F.lit(0).alias("src"), "subjects").unionByName(generated.select("doc_id", F.lit(1).alias("src"), "subjects")))
    first = chapters.where("chapter_no = 1").select("doc_id", F.col("title").alias("_first"))
    covers = images.where("is_cover").select("doc_id", F.col("file_name").alias("cover_image"))
    books = jobs.select("doc_id", "path", "source_hash", F.col("title").alias("_cfg")).join(merged, "doc_id").join(first, "doc_id").join(covers, "doc_id", "left").join(topics, "doc_id", "left")
    named = M.resolved_title(F.col("_cfg"), F.col("title"), F.lit(None) if options.comic else F.col("_first"), T.file_stem("path"))
    books = books.withColumn("title", named).withColumn("subjects", F.coalesce("subjects", F.array().cast("array<string>"))).withColumn("direction", F.lit("ltr")).drop("_cfg", "_first")
    lang = books.select("doc_id", "language")
    body = F.concat(F.lit('<img src="'), T.xml_escape("image"), F.lit('" alt=""/>')) if options.comic else markdown_html("markdown")
    shown = E.page(F.col("title"), body, F.col("language"))
    chapters = chapters.join(lang, "doc_id").withColumn("xhtml", shown).drop("language")
    return {"books": books, "chapters": chapters, "assets": images, "errors": errors, "entries": E.entries(books, chapters, images, options.modified, fixed=options.comic)}


def comics(books: DataFrame, pages: DataFrame, info: DataFrame, options: Options | None = None, staged: Staged | None = None) -> dict[str, DataFrame]:
    """books, chapters, assets and entries of archives: books (archive, source_hash, and path if that is another name); pages (archive, source_index, source_path, media_type, extension, width, height, bytes); info as sources.books.COMIC_INFO.

    With `staged`, kept pages and books are written once, and packages read these tables; without it, each of their dozen uses is in one plan with
    all that pages and info come from.
    """
    options = options or Options()
    put = staged.put if staged else lambda x: x
    marks = info.select("archive", F.posexplode("pages").alias("info_no", "p")).select("archive", "info_no", "p.image", "p.deleted", "p.front_cover")
    kept = A.retained(pages, marks)
    x = books.join(info.drop("pages", "error"), "archive", "left").withColumn("language", F.coalesce(T.clean_value("language"), F.lit(options.language))).withColumnRenamed("archive", "doc_id")
    own = kept.select(F.col("archive").alias("doc_id"), F.col("kept_no").alias("chapter_no"), F.col("page_id").alias("chapter_id"), "title", F.concat("page_id", F.lit(".xhtml")).alias("file_name"), F.concat("page_id", F.lit("."), "extension").alias("image"), "width", "height", "media_type", "bytes", "is_cover")
    # merged: pages compress so well that a table of them looks small enough to be sent to every task
    own = put(own.hint("merge").join(x.select("doc_id", "language"), "doc_id"))
    cover = own.where("is_cover").select("doc_id", F.col("image").alias("cover_image"))
    made = put(x.select("doc_id", "source_hash", F.coalesce(T.clean_value("title"), T.file_stem("path" if "path" in books.columns else "doc_id", "Comic")).alias("title"), T.clean_value("writer").alias("author"), "language", T.clean_value("publisher").alias("publisher"), T.clean_value("summary").alias("description"), F.array().cast("array<string>").alias("subjects"), F.when(F.col("right_to_left"), "rtl").otherwise("ltr").alias("direction")).join(cover, "doc_id"))
    chapters = own.drop("bytes").withColumn("xhtml", E.comic_page(F.col("title"), F.concat(F.lit("../images/"), "image"), F.col("language"), F.col("width"), F.col("height")))
    assets_ = own.select("doc_id", F.col("chapter_no").alias("asset_no"), F.col("image").alias("file_name"), "media_type", "bytes")
    return {"books": made, "chapters": chapters, "assets": assets_, "entries": E.entries(made, chapters, assets_, options.modified, fixed=True)}
