"""Recognition payloads, from JSON columns or cached files: never with inferred schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .schemas import METADATA, PAYLOAD


def parsed(c: Column | str) -> Column:
    """The payload in a JSON text; null where it is broken, a page has no index or an image no id."""
    x = F.from_json(F.col(c) if isinstance(c, str) else c, PAYLOAD)
    pages = F.coalesce(x["pages"], F.array())
    sound = F.forall(pages, lambda p: p["index"].isNotNull() & F.forall(F.coalesce(p["images"], F.array()), lambda i: i["id"].isNotNull()))
    return F.when(x.isNotNull() & (F.get_json_object(F.col(c) if isinstance(c, str) else c, "$").isNotNull()) & sound, x)


def pages(payloads: DataFrame) -> DataFrame:
    """(doc_id, page_pos, page_index, markdown, header, footer, images, tables) from (doc_id, payload)."""
    x = payloads.select("doc_id", F.posexplode("payload.pages").alias("page_pos", "p"))
    return x.select("doc_id", "page_pos", F.col("p.index").alias("page_index"), F.coalesce("p.markdown", F.lit("")).alias("markdown"), "p.header", "p.footer", "p.images", "p.tables")


def images(pages_: DataFrame) -> DataFrame:
    """One row for each image of each page; pages without images give one with null image_id."""
    x = pages_.select("doc_id", "page_index", "page_pos", F.posexplode_outer("images").alias("img_pos", "i"))
    return x.select("doc_id", "page_index", "page_pos", "img_pos", F.col("i.id").alias("image_id"), F.col("i.image_base64").alias("payload"))


def read_cache(spark: SparkSession, folder: str, kind: str = "ocr") -> DataFrame:
    """(cache_key, payload) of a folder of <key>.<kind>.json files; what can't be read has a null payload."""
    files = spark.read.option("pathGlobFilter", f"*.{kind}.json").text(folder, wholetext=True).select("value", F.input_file_name().alias("file"))
    key = F.regexp_extract("file", rf"([^/]*)\.{kind}\.json\z", 1)
    payload = parsed("value") if kind == "ocr" else F.from_json("value", METADATA)
    return files.select(key.alias("cache_key"), payload.alias("payload"))


def cache_file(key: Column | str, kind: str = "ocr") -> Column:
    return F.concat(F.col(key) if isinstance(key, str) else key, F.lit(f".{kind}.json"))


def write_cache(answers: DataFrame, folder: str, kind: str = "ocr") -> None:
    """Each answer (cache_key, json) as a file <key>.<kind>.json of the folder, which read_cache() and other programs read. A failed task leaves none."""
    from quire.sinks.files import write_files

    write_files(answers.select(cache_file("cache_key", kind).alias("name"), F.col("json").alias("bytes")), folder)
