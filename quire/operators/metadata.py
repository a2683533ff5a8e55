"""Metadata of documents: what covers and files say, and which source is believed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions import text as T

#: Lines of a first page that count, lines after the title that may name an author, and lines that are cleaned first, in the hope that they suffice.
COVER_LINES, AUTHOR_WITHIN, FIRST_LINES = 24, 6, 64
# Parts of names that need no capital.
PARTICLES = ("de", "del", "da", "van", "von", "la", "le")
# What lines about the edition hold.
NOISE = r"all rights reserved|copyright|©|www\.|http://|https://"
FIELDS = ("title", "author", "publisher", "description", "language")


def is_noise(line: Column | str) -> Column:
    """Of a cover line: a page number or nothing, or a line about the edition."""
    x = F.lower(T.col(line))
    starts = F.startswith(x, F.lit("isbn")) | F.startswith(x, F.lit("chapter ")) | x.isin("contents", "table of contents")
    return (x.rlike("^[0-9]*\\z") & (F.octet_length(x) <= 2)) | starts | x.rlike(NOISE)


def is_name(line: Column | str) -> Column:
    """Whether a line looks like a person's name: two to six words, each with a capital or a particle."""
    x = T.col(line)
    words = F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")

    def fits(w: Column) -> Column:
        w = F.regexp_replace(w, r"^[,.\-’']+|[,.\-’']+\z", "")
        return (w != "") & ~w.rlike(r"(?U)\d") & (F.lower(w).isin(*PARTICLES) | w.rlike("^[A-Z]") | ((F.upper(w) == w) & (F.lower(w) != w)))

    return ~is_noise(x) & ~x.contains(":") & ~x.rlike(r"[?!]\z") & F.size(words).between(2, 6) & F.forall(words, fits)


def cover_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, nth, line): the first lines of a document's first page, cleaned; nth from 1."""
    first = pages.withColumn("_r", F.row_number().over(W.partitionBy("doc_id").orderBy("page_index"))).where("_r = 1")
    cleaned = lambda lines: F.slice(F.filter(F.transform(lines, lambda x: T.cover_line(x)), lambda x: x.isNotNull()), 1, COVER_LINES)
    first = first.select("doc_id", T.lines("markdown").alias("_all")).select("doc_id", F.when(F.size("_all") > FIRST_LINES, F.col("_all")).alias("_all"), cleaned(F.slice("_all", 1, FIRST_LINES)).alias("_some"))
    kept = F.when((F.size("_some") == COVER_LINES) | F.col("_all").isNull(), F.col("_some")).otherwise(cleaned(F.col("_all")))
    return first.select("doc_id", F.posexplode(kept).alias("pos", "line")).select("doc_id", (F.col("pos") + 1).alias("nth"), "line")


def cover_metadata(lines: DataFrame) -> DataFrame:
    """(doc_id, title, author): the first line that is neither noise nor names an author; the author whom any line names, else the first name soon after the title."""
    x = lines.withColumn("marked", T.marked_author("line")).withColumn("noise", is_noise("line"))
    at = F.min(F.when(F.col("marked").isNull() & ~F.col("noise"), F.col("nth"))).over(W.partitionBy("doc_id"))
    x = x.withColumn("at", at)
    after = F.col("nth") - F.coalesce("at", F.lit(1))
    name = F.when(is_name("line") & after.between(1, AUTHOR_WITHIN), F.col("line"))
    by = x.groupBy("doc_id").agg(F.max(F.when(F.col("nth") == F.col("at"), F.col("line"))).alias("title"), F.min_by("marked", F.when(F.col("marked").isNotNull(), F.col("nth"))).alias("marked"), F.min_by(name, F.when(name.isNotNull(), F.col("nth"))).alias("named"))
    return by.select("doc_id", "title", F.coalesce("marked", "named").alias("author"))


def merge(jobs: DataFrame, cover: DataFrame, pdf: DataFrame, generated: DataFrame) -> DataFrame:
    """(doc_id and FIELDS): each field from the source that is believed most.

    Each source has a row for a document at most. Title and author: configured, cover, file, generated; publisher: configured, file,
    generated; description: file, generated; language as functions.text.language says.
    """
    own = jobs.select("doc_id", *[F.col(c).alias(f"cfg_{c}") for c in ("title", "author", "publisher", "language")])
    parts = [("cover", cover, ("title", "author")), ("pdf", pdf, FIELDS), ("gen", generated, FIELDS)]
    for name, df, fields in parts:
        own = own.join(df.select("doc_id", *[F.col(f).alias(f"{name}_{f}") for f in fields]), "doc_id", "left")
    c = F.col
    gen = {f: T.clean_generated(f"gen_{f}") for f in FIELDS}
    return own.select(
        "doc_id",
        *[F.coalesce(*map(T.clean_value, (c(f"cfg_{f}"), c(f"cover_{f}"), c(f"pdf_{f}"))), gen[f]).alias(f) for f in ("title", "author")],
        F.coalesce(T.clean_value("cfg_publisher"), T.clean_value("pdf_publisher"), gen["publisher"]).alias("publisher"),
        F.coalesce(T.clean_value("pdf_description"), gen["description"]).alias("description"),
        T.language("cfg_language", "pdf_language", "gen_language").alias("language"),
    )


def subjects(sources: DataFrame) -> DataFrame:
    """(doc_id, subjects) from (doc_id, src, subjects array): in order of src and place, each once whatever its case, as first spelled; documents with none fall out.

    What is alike is dropped within a source first, so that rows are as short as they can be when a document's sources meet.
    """
    alike = F.array_compact(F.transform("subjects", lambda s: T.clean_value(s)))

    def once(every: Column) -> Column:
        """Each text's first spelling, in the order of their places: sorted, what equals the one before goes."""
        placed = F.sort_array(F.transform(every, lambda s, i: F.struct(F.lower(s).alias("low"), i.alias("at"), s.alias("text"))))
        none = F.array(F.lit(None).cast("struct<low:string,at:int,text:string>"))
        met = F.arrays_zip(placed.alias("own"), F.concat(none, F.slice(placed, 1, F.greatest(F.size(every) - 1, F.lit(0)))).alias("before"))
        first = F.filter(met, lambda m: ~m["own"]["low"].eqNullSafe(m["before"]["low"]))
        return F.transform(F.sort_array(F.transform(first, lambda m: F.struct(m["own"]["at"].alias("at"), m["own"]["text"].alias("text")))), lambda m: m["text"])

    x = sources.select("doc_id", "src", alike.alias("own")).where(F.size("own") > 0)
    by = x.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("src", "own"))).alias("of"))
    return by.select("doc_id", F.flatten("of.own").alias("own")).select("doc_id", once(F.col("own")).alias("subjects"))


def missing(record: DataFrame) -> DataFrame:
    """Adds needs_generation: whether a field that a model could give is absent; "en" alone is no language if the file names none."""
    lacks = lambda f: T.clean_value(f).isNull()
    some = lacks("title") | lacks("author") | lacks("publisher") | lacks("description") | (F.lower("language") == "en") & lacks("pdf_language") | (F.coalesce(F.size("subjects"), F.lit(0)) <= 0)
    return record.withColumn("needs_generation", F.coalesce(some, F.lit(True)))


def resolved_title(configured: Column, metadata: Column, chapter: Column, stem: Column) -> Column:
    """A configured title even if blank, then metadata's, the first chapter's, the file's."""
    return F.coalesce(configured, metadata, chapter, stem)


def parse_generated(content: Column | str) -> Column:
    """struct of FIELDS and subjects from a model's answer: the JSON object in it, each field text or a list of texts, at most 8 subjects."""
    obj = T.json_object(content)

    def one(name: str) -> Column:
        raw = F.get_json_object(obj, f"$.{name}")
        listed = F.from_json(raw, "array<string>", {"mode": "PERMISSIVE"})
        return T.clean_generated(F.when(F.startswith(raw, F.lit("[")), F.array_join(listed, ", ")).otherwise(raw)).alias(name)

    raw = F.get_json_object(obj, "$.subjects")
    split = F.when(F.startswith(raw, F.lit("[")), F.from_json(raw, "array<string>")).otherwise(F.split(raw, r"[,;\n]"))
    kept = F.slice(F.filter(F.transform(split, T.clean_generated), lambda s: s.isNotNull()), 1, 8)
    return F.struct(*map(one, FIELDS), F.coalesce(kept, F.array().cast("array<string>")).alias("subjects"))
