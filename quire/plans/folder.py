"""A folder of books, from scan to files: one plan for each format, one row for each book in the end."""

from __future__ import annotations

import os
import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quire.functions import paths as P, text as T
from quire.operators import archive as A, batch as B, epub as E, metadata as M, packages as C
from quire.operators.pages import metadata_sample
from quire.session import Staged, make_folder
from quire.sinks import epub as S
from quire.sinks.files import write_files
from quire.sources import archives as Z, books as K, payloads as Y, providers as V

from . import convert

VERSION = "1"
OUTCOME = ("path", "output_path", "status", "kind", "exit_code", "message", "pages", "chapters", "images", "cache_hit", "input_order")


@dataclass
class Settings(convert.Options):
    """convert.Options, what a recognition depends on, and a batch's own choices."""

    model: str = "default"
    extract_header: bool = True
    extract_footer: bool = True
    title: str | None = None
    author: str | None = None
    publisher: str | None = None
    recursive: bool = False
    no_cache: bool = False
    delete_sources: bool = False
    check_packages: bool = False
    debug: str | None = None


def _answers(keyed: DataFrame, contents: DataFrame, cache: str, provider: Callable[[bytes, dict], str] | None, settings: Settings, staged: Staged) -> DataFrame:
    """keyed (doc_id, cache_key ...) with payload and cache_hit. What no cache holds goes to the provider; its answers are in the cache before anything reads them, so no retry of a later step pays twice."""
    spark = keyed.sparkSession
    place = f"{staged.root}/answers" if settings.no_cache else cache
    make_folder(spark, place)
    held = lambda: Y.read_cache(spark, place).where("payload is not null")
    hits = staged.put(B.cached(keyed, held()).select("doc_id", "cache_key", "cache_hit"))
    if provider is not None:
        missing = hits.where("not cache_hit").join(contents.select("doc_id", "content"), "doc_id")
        answers = V.recognised(missing, provider, {"model": settings.model, "table_format": settings.table_format, "extract_header": settings.extract_header, "extract_footer": settings.extract_footer})
        Y.write_cache(answers.where("json is not null").select("cache_key", "json"), place)
    return staged.put(keyed.join(held(), "cache_key", "left").join(hits.select("doc_id", "cache_hit"), "doc_id"))


def _settled(out: dict[str, DataFrame], settings: Settings, fixed: bool, staged: Staged) -> dict[str, DataFrame]:
    """The same, written once: packages and counts read these tables instead of converting again."""
    own = {k: staged.put(v) for k, v in out.items() if k != "entries"}
    return own | {"entries": E.entries(own["books"], own["chapters"], own["assets"], settings.modified, fixed)}


def _generated(known: DataFrame, info: DataFrame, cache: str, model: Callable[[bytes, dict], str], settings: Settings, staged: Staged) -> DataFrame:
    """Metadata by doc_id that the model, or what is kept of its answers, gives for documents that lack some; answers are kept before anything reads them."""
    spark = known.sparkSession
    pages = Y.pages(known)
    cover = M.cover_metadata(M.cover_lines(pages.select("doc_id", "page_index", "markdown")))
    none = known.select("doc_id", *[F.lit(None).cast("string").alias(f) for f in M.FIELDS])
    record = M.merge(known.fillna({"language": settings.language}), cover, info, none).join(info.select("doc_id", F.col("language").alias("pdf_language"), "subjects"), "doc_id", "left")
    jobs = staged.put(M.missing(record).select("doc_id", "needs_generation").join(known.select("doc_id", "cache_key"), "doc_id").where("needs_generation"))

    place = f"{staged.root}/metadata" if settings.no_cache else cache
    make_folder(spark, place)
    held = lambda: Y.read_cache(spark, place, "metadata").where("payload is not null")
    said = with_generated(jobs.join(held(), "cache_key", "left_anti"), pages, model).join(jobs.select("doc_id", "cache_key"), "doc_id")
    Y.write_cache(said.select("cache_key", F.to_json(F.struct(*M.FIELDS, "subjects")).alias("json")), place, "metadata")
    return staged.put(jobs.join(held(), "cache_key").select("doc_id", "payload.*"))


def plain_path(uri: Column | str) -> Column:
    return F.regexp_replace(uri, "^[a-z]+:/*", "/")


def book_id(uri: Column | str, root: str) -> Column:
    """A book's id: of its path below the root alone, so that nothing is joined to its bytes for it."""
    return F.sha2(relative(uri, root).cast("binary"), 256)


def relative(uri: Column | str, root: str) -> Column:
    return F.substring(plain_path(uri), len(re.sub("^[a-z]+:/*", "/", root)) + 2, 2**31 - 1)


def rooted(folder: str) -> str:
    return folder.rstrip("/") if "://" in folder else os.path.abspath(folder)


def queue(spark: SparkSession, folder: str, settings: Settings, staged: Staged) -> DataFrame:
    """The books of a folder as jobs: (uri, path, source_hash, format, why, input_order, candidate, output_path, doc_id, source_path); why says what stands against one."""
    root = rooted(folder)
    pdfs = K.scan(spark, root, settings.recursive, "[pP][dD][fF]")
    found = K.detected(pdfs.unionByName(Z.read(spark, root, "files", settings.recursive, extensions=".cbz").select("path", "content", "source_hash")))
    refused = F.when((F.col("format") == "cbz") & settings.comic, F.lit("comic mode is for PDF files alone: archives are always rendered as page images"))
    rows = found.select(F.col("path").alias("uri"), relative("path", root).alias("path"), "source_hash", "format", F.coalesce("error.message", refused).alias("why"))
    named = B.numbered(rows, P.path_key("uri"), "input_order", staged)
    return staged.put(B.unique_paths(named).withColumn("doc_id", book_id("uri", root)).withColumn("source_path", plain_path("uri")))


def convert_folder(spark: SparkSession, folder: str, out: str, cache: str, provider: Callable[[bytes, dict], str] | None = None, settings: Settings | None = None, check: Callable[[str], str | None] | None = None, model: Callable[[bytes, dict], str] | None = None) -> DataFrame:
    """OUTCOME rows, one for each book of a folder. Files are written below `out` at their places in the folder; one bad book stops no other.

    provider recognises a file that no cache holds; model is asked for what metadata a recognised book lacks.
    """
    settings, staged = settings or Settings(), Staged(spark, "folder")
    return convert_jobs(spark, folder, queue(spark, folder, settings, staged), out, cache, provider, settings, check, model)


def convert_file(spark: SparkSession, path: str, out: str, cache: str, provider: Callable[[bytes, dict], str] | None = None, settings: Settings | None = None, formats: tuple[str, ...] = ("pdf", "cbz"), model: Callable[[bytes, dict], str] | None = None, check: Callable[[str], str | None] | None = None) -> DataFrame:
    """OUTCOME's one row for one book, which is written to the file `out`. A book of another format than `formats` is refused; a path that is there but is no book, too."""
    settings, staged = settings or Settings(), Staged(spark, "folder")
    folder, name = os.path.split(rooted(path))
    place, target = os.path.split(rooted(out))
    refused = F.when(F.col("why").isNull() & ~F.col("format").isin(*formats), F.concat(F.lit(" or ".join(formats)), F.lit(" is expected")))
    jobs = queue(spark, folder, replace(settings, recursive=False), staged).where(F.col("path") == name)
    jobs = staged.put(jobs.withColumn("output_path", F.lit(target)).withColumn("why", F.coalesce("why", refused)))
    return convert_jobs(spark, folder, jobs, place, cache, provider, settings, check, model)


def convert_jobs(spark: SparkSession, folder: str, jobs: DataFrame, out: str, cache: str, provider: Callable[[bytes, dict], str] | None = None, settings: Settings | None = None, check: Callable[[str], str | None] | None = None, model: Callable[[bytes, dict], str] | None = None) -> DataFrame:
    """OUTCOME rows for jobs that queue() gave, or some of them. Only their files are converted."""
    settings, staged, root = settings or Settings(), Staged(spark, "folder"), rooted(folder)
    doc_id = lambda c: book_id(c, root)
    pdfs = K.scan(spark, root, settings.recursive, "[pP][dD][fF]").join(jobs.where("why IS NULL").select(F.col("uri").alias("path")), "path", "left_semi")

    pdf = K.detected(pdfs).where("format = 'pdf'").select(doc_id("path").alias("doc_id"), relative("path", root).alias("path"), "source_hash", "content")
    blank = [F.lit(getattr(settings, f)).cast("string").alias(f) for f in ("title", "author", "publisher", "language")]
    key = T.cache_key("content", F.lit(settings.model), F.lit(settings.table_format), F.lit(settings.extract_header), F.lit(settings.extract_footer), VERSION)
    ready = _answers(staged.put(pdf.select("doc_id", "path", "source_hash", *blank, key.alias("cache_key"))), pdf, cache, provider, settings, staged)
    known = ready.where("payload is not null").drop("cache_hit")
    info = staged.put(K.pdf_metadata(pdf.select(F.col("doc_id").alias("path"), "content")).withColumnRenamed("path", "doc_id"))
    generated = None if model is None else _generated(known, info, cache, model, settings, staged)
    texts = _settled(convert.recognised(known.drop("cache_key"), settings, info, generated), settings, settings.comic, staged)

    wanted = jobs.where("format = 'cbz' AND why IS NULL").select(F.col("doc_id").alias("archive"))
    named_ = lambda x: x.withColumn("archive", doc_id("archive")).join(wanted, "archive", "left_semi")
    entries = staged.put(named_(Z.read(spark, root, "directory", settings.recursive, extensions=".cbz")))
    verdicts = A.verdicts(entries.where("path is not null"))
    contents = named_(Z.read(spark, root, "content", settings.recursive, extensions=".cbz").where("path is not null"))
    contents = contents.join(verdicts.where("broken is not null").select("archive"), "archive", "left_anti")
    files = staged.put(K.probed(contents.select("archive", "entry_index", "path", "bytes", "error")))
    fault = F.coalesce("error", "probe_error")
    broken = files.groupBy("archive").agg(F.min_by(fault, F.when(fault.isNotNull(), F.col("entry_index"))).alias("why"))
    sound = files.join(broken.where("why is null").select("archive"), "archive", "left_semi")
    pages = sound.where("media_type is not null").select("archive", F.col("entry_index").alias("source_index"), F.col("path").alias("source_path"), "media_type", "extension", "width", "height", "bytes")
    sources = jobs.where("format = 'cbz' AND why IS NULL").select(F.col("doc_id").alias("archive"), "source_hash", "path")
    info = staged.put(K.comic_info(sound))
    bad = info.where("error is not null").select(F.col("archive").alias("doc_id"), F.lit("BadArgs").alias("kind"), F.concat(F.lit("ComicInfo: "), "error").alias("message"))
    sources = sources.join(bad.select(F.col("doc_id").alias("archive")), "archive", "left_anti")
    pages = pages.join(bad.select(F.col("doc_id").alias("archive")), "archive", "left_anti")
    comics = convert.comics(sources, pages, info, settings, staged)

    both = texts["entries"].unionByName(comics["entries"]).join(jobs.select("doc_id", "output_path", "source_path"), "doc_id")
    faults = None
    if settings.check_packages:  # what a package refers to and hasn't got, before anything is written
        both = staged.put(both)
        faults = staged.put(C.faults(both).groupBy("doc_id").agg(F.min(F.concat_ws(": ", "rule", "path", "detail")).alias("message")))
        both = both.join(faults.select("doc_id"), "doc_id", "left_anti")
    written = staged.put(S.write_books(both, out, check).select("doc_id", F.col("error").alias("_error")))

    def counted(name: str, *tables: DataFrame) -> DataFrame:
        ids = reduce(DataFrame.unionByName, [t.select("doc_id") for t in tables])
        return ids.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))

    told = [
        texts["errors"].select("doc_id", "kind", "message"),
        ready.where("payload is null").select("doc_id", F.lit("Api").alias("kind"), F.lit("not recognised").alias("message")),
        verdicts.where("broken is not null").select(F.col("archive").alias("doc_id"), F.lit("BadArgs").alias("kind"), F.col("broken").alias("message")),
        entries.where("path is null").select(F.col("archive").alias("doc_id"), F.lit("BadArgs").alias("kind"), F.lit("no archive").alias("message")),
        broken.where("why is not null").select(F.col("archive").alias("doc_id"), F.lit("BadArgs").alias("kind"), F.col("why").alias("message")),
        bad,
        pages.select(F.col("archive").alias("doc_id")).distinct().join(comics["chapters"].select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit("BadArgs").alias("kind"), F.lit("the comic info marks every page as deleted").alias("message")),
    ] + ([] if faults is None else [faults.select("doc_id", F.lit("Validation").alias("kind"), "message")])
    errors = reduce(DataFrame.unionByName, told).groupBy("doc_id").agg(F.min("kind").alias("kind"), F.min("message").alias("message"))
    x = jobs
    for part in (written, errors, counted("pages", Y.pages(known), comics["chapters"]), counted("chapters", texts["chapters"], comics["chapters"]), counted("images", texts["assets"], comics["assets"]), ready.select("doc_id", "cache_hit")):
        x = x.join(part, "doc_id", "left")
    done = F.col("_error").isNull() & F.col("message").isNull() & F.col("why").isNull() & F.col("chapters").isNotNull()
    message = F.when(~done, F.coalesce("why", "message", "_error", F.lit("nothing was written")))
    kind = F.when(~done, F.when(F.col("why").isNotNull(), "BadArgs").otherwise(F.coalesce("kind", F.when(F.col("_error").isNotNull(), F.lit("Validation")), F.lit("Internal"))))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    shown = x.select("path", F.when(done, F.col("output_path")).alias("output_path"), F.when(done, "done").otherwise("error").alias("status"), kind.alias("kind"), F.when(~done, T.exit_code(kind)).otherwise(0).alias("exit_code"), message.alias("message"), zero("pages"), zero("chapters"), zero("images"), F.coalesce("cache_hit", F.lit(False)).alias("cache_hit"), "input_order", "source_path")
    result = staged.put(shown)
    if settings.debug:
        write_files(S.dumps(texts["chapters"], known, jobs), settings.debug)
    if settings.delete_sources:
        for r in result.where("status = 'done'").select("source_path").toLocalIterator():
            try:
                os.unlink(unquote(r.source_path))
            except OSError as e:  # the book is written: this stops no other
                warnings.warn(f"{r.source_path} was not deleted: {e}", stacklevel=2)
    return result.drop("source_path")


def with_generated(jobs: DataFrame, pages: DataFrame, provider: Callable[[bytes, dict], str]) -> DataFrame:
    """Metadata by doc_id from a model's reading of each document's first pages (jobs with needs_generation only); failures leave it out."""
    sample = pages.join(jobs.where("needs_generation").select("doc_id"), "doc_id", "left_semi")
    asked = metadata_sample(sample).select(F.col("doc_id").cast("string").alias("cache_key"), F.col("sample").cast("binary").alias("content"))
    said = V.recognised(asked, provider).where("json is not null")
    return said.select(F.col("cache_key").alias("doc_id"), M.parse_generated("json").alias("m")).select("doc_id", "m.*")
