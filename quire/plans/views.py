"""What the test tables stand for: recognised pages, lines, jobs, archives. Headings and links are made up; the texts are the tables'."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.plans.samples import png
from quire.session import Staged, reachable
from quire.sinks.files import write_packages


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str, heading: str = "# ") -> DataFrame:
    """Turns of conversations as pages; every third under a heading."""
    t = F.col("turn").cast("string")
    name = F.concat(F.lit("Chapter "), F.col("turn") + 1) if heading == "Chapter " else F.concat(F.lit(heading), "role", F.lit(" "), t)
    headed = F.concat(name, F.lit("\n\n"), "text")
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_index"), F.when(F.col("turn") % 3 == 0, headed).otherwise(F.col("text")).alias("markdown"))


def pages_sql(heading: str = "# ") -> str:
    name = "'Chapter ' || (turn + 1)" if heading == "Chapter " else f"'{heading}' || role || ' ' || turn"
    return f"pages AS (SELECT conv_id AS doc_id, turn AS page_index, CASE WHEN turn % 3 = 0 THEN {name} || chr(10) || chr(10) || text ELSE text END AS markdown FROM conversations)"


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines, one for each number: some numbers of an order recur in the table."""
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_quantity", "l_returnflag", "l_linestatus")])


LINES_SQL = "order_lines AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY ALL)"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as images on pages of three; returned ones have no payload."""
    x = order_lines(spark, sf_dir)
    return x.select(F.col("l_orderkey").alias("doc_id"), F.floor(F.col("l_linenumber") / 3).cast("int").alias("page_index"), F.lit(0).alias("page_pos"), F.col("l_linenumber").alias("img_pos"), F.concat(F.lit("img-"), (F.col("l_partkey") % 3).cast("string")).alias("image_id"), F.when(F.col("l_returnflag") != "R", F.col("l_linestatus")).alias("payload"))


IMAGES_SQL = LINES_SQL + ", images AS (SELECT l_orderkey AS doc_id, (l_linenumber // 3)::INT AS page_index, l_linenumber AS img_pos, l_linestatus, 'img-' || (l_partkey % 3) AS image_id, CASE WHEN l_returnflag <> 'R' THEN l_linestatus END AS payload FROM order_lines)"


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as jobs: good ones are done, bad ones failed, unlabelled ones wait."""
    d, q = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    status = F.when(F.col("quality") == 1, "done").when(F.col("quality") == 0, "error").otherwise("pending")
    kinds = F.element_at(F.array(*map(F.lit, ("BadArgs", "Api", "OcrSchema", "Epub", "Validation", "Internal"))), (F.col("doc_id") % 6 + 1).cast("int"))
    return d.join(q, "doc_id", "left").select("doc_id", F.col("doc_id").alias("input_order"), F.col("source").alias("folder"), F.concat("source", F.lit("/Book "), (F.col("doc_id") % 50).cast("string"), F.when(F.col("doc_id") % 3 == 0, ".PDF").otherwise(".cbz")).alias("path"), status.alias("status"), kinds.alias("kind"), (F.col("doc_id") % 7).alias("pages"), (F.col("doc_id") % 5).alias("chapters"), (F.col("doc_id") % 3).alias("images"), (F.col("doc_id") % 2 == 0).alias("cache_hit"), "text")


JOBS_SQL = """jobs AS (SELECT d.doc_id, d.doc_id AS input_order, source AS folder, source || '/Book ' || (d.doc_id % 50) || CASE WHEN d.doc_id % 3 = 0 THEN '.PDF' ELSE '.cbz' END AS path,
    CASE quality WHEN 1 THEN 'done' WHEN 0 THEN 'error' ELSE 'pending' END AS status, ['BadArgs', 'Api', 'OcrSchema', 'Epub', 'Validation', 'Internal'][d.doc_id % 6 + 1] AS kind,
    d.doc_id % 7 AS pages, d.doc_id % 5 AS chapters, d.doc_id % 3 AS images, d.doc_id % 2 = 0 AS cache_hit, text
    FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) q USING (doc_id))"""


def archive_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages of archives, with numbers in their paths."""
    p = read(spark, sf_dir, "part")
    path = F.concat(F.lit("Ch"), (F.col("p_size") % 12).cast("string"), F.lit("/"), F.when(F.col("p_partkey") % 2 == 0, "Page").otherwise("page"), F.when(F.col("p_partkey") % 3 == 0, "0").otherwise(""), (F.col("p_partkey") % 120).cast("string"), F.lit(".png"))
    return p.select(F.col("p_brand").alias("archive"), F.col("p_partkey").alias("source_index"), path.alias("source_path"))


ARCHIVE_SQL = "archive_pages AS (SELECT p_brand AS archive, p_partkey AS source_index, 'Ch' || (p_size % 12) || '/' || CASE WHEN p_partkey % 2 = 0 THEN 'Page' ELSE 'page' END || CASE WHEN p_partkey % 3 = 0 THEN '0' ELSE '' END || (p_partkey % 120) || '.png' AS source_path FROM part)"


def archives(spark: SparkSession, sf_dir: str) -> str:
    """A folder of archives that a sink has written, forty documents to each: even ones as texts, odd ones as pages of a size that their text gives, cut short here and there, and comic info."""
    docs = read(spark, sf_dir, "documents").where("doc_id >= 0").select("doc_id", "text", "lang", "source").dropDuplicates(["doc_id"])
    archive = F.format_string("book-%04d.cbz", F.floor(F.col("doc_id") / 40).cast("long"))
    own = docs.select(archive.alias("name"), "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), "lang", "source")

    def pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = zip(b.column("doc_id").to_pylist(), b.column("size").to_pylist(), strict=True)
            images = [png(1 + i % 7, 1 + n % 5)[: -12 if i % 277 == 5 else None] for i, n in sizes]
            yield pa.RecordBatch.from_arrays([b.column("name"), b.column("doc_id"), pa.array(images, pa.binary())], ["name", "doc_id", "bytes"])

    number = (F.col("doc_id") % 40 + 1).alias("entry_no")
    text = own.where("doc_id % 2 = 0").select("name", number, F.concat(F.lit("texts/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.lit("deflated").alias("method"), F.col("text").alias("bytes"))
    image = own.where("doc_id % 2 = 1").select("name", "doc_id", F.octet_length("text").alias("size")).mapInArrow(pages, "name string, doc_id long, bytes binary")
    image = image.select("name", number, F.concat(F.lit("pages/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"), F.lit("stored").alias("method"), "bytes")
    by = own.groupBy("name").agg(F.min_by(F.coalesce("source", F.lit("none")), "doc_id").alias("source"), F.min_by(F.coalesce("lang", F.lit("xx")), "doc_id").alias("lang"), F.count(F.lit(1)).cast("string").alias("n"), (F.min("doc_id") % 80 == 0).alias("rtl"))
    said = F.concat(F.lit('<?xml version="1.0"?><ComicInfo><Title>Book &amp; '), "source", F.lit("</Title><Writer>W"), "n", F.lit("</Writer><LanguageISO>"), "lang", F.lit("</LanguageISO><Manga>"), F.when(F.col("rtl"), "YesAndRightToLeft").otherwise("Yes"), F.lit('</Manga><Pages><Page Image="0" Type="Deleted"/></Pages></ComicInfo>'))
    info = by.select("name", F.lit(0).cast("long").alias("entry_no"), F.lit("ComicInfo.xml").alias("path"), F.lit("deflated").alias("method"), said.cast("binary").alias("bytes"))
    folder = f"{Staged(spark, 'archives').root}/books"
    write_packages(text.unionByName(image).unionByName(info), folder)
    return folder
