"""Archives of page images: safety rules as declared checks, natural order, retained pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions import paths as P

# The limits of an archive.
MAX_ENTRIES, MAX_PAGES, MAX_ENTRY, MAX_TOTAL, MAX_INFO = 10_000, 2_000, 100 << 20, 2 << 30, 1 << 20
# The limits of an image.
MAX_AXIS, MAX_PIXELS, MAX_DECODED = 100_000, 100_000_000, 512 << 20


def _all() -> W:
    return W.partitionBy("archive")


def is_irregular(mode: Column | str) -> Column:
    """A unix mode of anything but a file or folder; none, or 0, is let pass."""
    kind = F.col(mode).bitwiseAND(0o170000) if isinstance(mode, str) else mode.bitwiseAND(0o170000)
    return F.coalesce(~kind.isin(0, 0o100000, 0o040000), F.lit(False))


def entry_rules() -> list[tuple[str, Column]]:
    """(rule, broken) in order of precedence, for rows (archive, entry_index, path, is_dir, unix_mode, encrypted, declared_size, compressed_size)."""
    low = F.lower("path")
    root_info = low == "comicinfo.xml"
    file = ~F.col("is_dir")
    return [
        ("too_many_entries", F.count(F.lit(1)).over(_all()) > MAX_ENTRIES),
        ("unsafe_path", P.is_unsafe("path")),
        ("irregular_entry", is_irregular("unix_mode")),
        ("encrypted", F.coalesce(F.col("encrypted"), F.lit(False))),
        ("entry_too_large", file & (F.col("declared_size") > MAX_ENTRY)),
        ("total_too_large", file & (F.sum(F.when(file, F.col("declared_size")).otherwise(0)).over(_all().orderBy("entry_index").rowsBetween(W.unboundedPreceding, 0)) > MAX_TOTAL)),
        ("ratio_exceeded", file & P.ratio_exceeded("declared_size", "compressed_size")),
        ("duplicate_info", file & root_info & (F.count_if(file & root_info).over(_all()) > 1)),
        ("info_too_large", file & root_info & (F.col("declared_size") > MAX_INFO)),
        ("too_many_pages", F.count_if(file & P.has_image_extension("path") & ~P.is_junk("path")).over(_all()) > MAX_PAGES),
    ]


def checked(entries: DataFrame) -> DataFrame:
    """Adds kind (image, info, ignored, directory), running_size and broken, the first rule that an entry breaks, or null."""
    rules = entry_rules()
    x = entries
    for name, broken in rules:
        x = x.withColumn(f"_{name}", broken)
    first = reduce(lambda w, r: w.when(F.col(f"_{r[0]}"), r[0]), rules[1:], F.when(F.col(f"_{rules[0][0]}"), rules[0][0]))
    kind = F.when(F.col("is_dir"), "directory").when(P.is_junk("path"), "ignored").when(F.lower("path") == "comicinfo.xml", "info").when(P.has_image_extension("path"), "image").otherwise("ignored")
    running = F.sum(F.when(F.col("is_dir"), 0).otherwise(F.col("declared_size"))).over(_all().orderBy("entry_index").rowsBetween(W.unboundedPreceding, 0))
    return x.select(*entries.columns, kind.alias("kind"), running.alias("running_size"), first.alias("broken"))


def verdicts(entries: DataFrame) -> DataFrame:
    """(archive, n_entries, n_pages, broken): the first broken rule of an archive's entries, in their order."""
    by = checked(entries).groupBy("archive").agg(F.count(F.lit(1)).alias("n_entries"), F.count_if(F.col("kind") == "image").alias("n_pages"), F.min_by("broken", F.when(F.col("broken").isNotNull(), F.col("entry_index"))).alias("broken"))
    return by.withColumn("broken", F.coalesce("broken", F.when(F.col("n_pages") == 0, F.lit("no_pages"))))


def ordered(pages: DataFrame) -> DataFrame:
    """Adds page_no from 0: the natural order of source_path, then source_index."""
    return pages.withColumn("_key", P.natural_key("source_path")).withColumn("page_no", F.row_number().over(_all().orderBy("_key", "source_index")) - 1).drop("_key")


def retained(pages: DataFrame, info_pages: DataFrame) -> DataFrame:
    """Ordered pages without those that the info deletes, numbered anew, with is_cover and file names.

    info_pages: (archive, info_no, image, deleted, front_cover); image is null where it can't be read, and the entry's own place
    counts. The cover is the first front cover that stays, else the first page.
    """
    info = info_pages.select("archive", "info_no", F.coalesce("image", "info_no").alias("page_no"), "deleted", "front_cover")
    gone = info.where("deleted").select("archive", "page_no").distinct()
    kept = ordered(pages).join(gone, ["archive", "page_no"], "left_anti")
    cover = info.where("front_cover").groupBy("archive", "page_no").agg(F.min("info_no").alias("cover_no"))
    x = kept.join(cover, ["archive", "page_no"], "left").withColumn("best", F.min("cover_no").over(_all()))
    x = x.withColumn("kept_no", F.row_number().over(_all().orderBy("page_no")).cast("int"))
    is_cover = F.when(F.col("best").isNull(), F.col("kept_no") == 1).otherwise(F.coalesce(F.col("cover_no") == F.col("best"), F.lit(False)))
    return x.select(*[c for c in pages.columns], "page_no", "kept_no", is_cover.alias("is_cover"), F.format_string("page-%04d", "kept_no").alias("page_id"), F.concat(F.lit("Page "), F.col("kept_no").cast("string")).alias("title"))


def image_limits_broken(width: Column | str, height: Column | str, decoded: Column | str) -> Column:
    w, h = F.col(width).cast("bigint"), F.col(height).cast("bigint")
    return (w <= 0) | (h <= 0) | (w > MAX_AXIS) | (h > MAX_AXIS) | (w * h > MAX_PIXELS) | (F.col(decoded) > MAX_DECODED)
