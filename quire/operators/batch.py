"""Batches of conversions: jobs, caches, outcomes, progress, output paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.functions import paths as P, text as T
from quire.session import Staged


def cached(jobs: DataFrame, cache: DataFrame) -> DataFrame:
    """Jobs (cache_key) with what the cache holds for them, and cache_hit; unreadable entries (null payload) count as none."""
    held = cache.where("payload is not null").select(F.col("cache_key").alias("_key"), "payload")
    return jobs.join(held, F.col("cache_key") == F.col("_key"), "left").withColumn("cache_hit", F.col("_key").isNotNull()).drop("_key")


def to_recognise(jobs: DataFrame, cache: DataFrame) -> DataFrame:
    """Jobs that the cache holds nothing for."""
    return jobs.join(cache.where("payload is not null").select("cache_key"), "cache_key", "left_anti")


def summary(outcomes: DataFrame) -> DataFrame:
    """One row of totals over (status, pages, chapters, images, cache_hit); zeros for an empty batch."""
    done = F.col("status") == "done"
    total = lambda c: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).cast("long").alias(c)
    return outcomes.agg(F.count_if(done).alias("successes"), F.count_if(F.col("status") == "error").alias("failures"), total("pages"), total("chapters"), total("images"), F.count_if(done & F.col("cache_hit")).alias("cache_hits"))


def first_failure(outcomes: DataFrame) -> DataFrame:
    """(kind, exit_code, failures): the batch ends as its first failure in input order does; no row without one."""
    bad = outcomes.where("status = 'error'").agg(F.min_by("kind", "input_order").alias("kind"), F.count(F.lit(1)).alias("failures"))
    return bad.where("failures > 0").select("kind", T.exit_code("kind").cast("int").alias("exit_code"), "failures")


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("folder", "status").agg(F.count(F.lit(1)).alias("n"))


def queue(jobs: DataFrame, new: DataFrame) -> DataFrame:
    """The paths of `new` (path) that are in no job yet, each once."""
    return new.join(jobs.select("path"), "path", "left_anti").dropDuplicates(["path"])


def numbered(rows: DataFrame, order: Column, out: str, staged: Staged) -> DataFrame:
    """Adds `out`, from 1 in the order: rows are dealt by ranges of it, and counts by partition, a row for each, give what comes before."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = rows.withColumn("_order", order).repartitionByRange(n, "_order").sortWithinPartitions("_order").drop("_order").withColumn("_at", F.monotonically_increasing_id())
    x = staged.put(x.withColumn("_part", F.shiftright("_at", 33)))
    counts = x.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", (before - F.col("_first") + 1).alias("_shift"))
    return x.join(F.broadcast(offsets), "_part").withColumn(out, (F.col("_at") + F.col("_shift")).cast("int")).drop("_at", "_part", "_shift")


def output_paths(jobs: DataFrame) -> DataFrame:
    """Adds output_path, unique in the batch whatever its case: candidate, candidate-2, candidate-3 ... in input order.

    Candidates that already look numbered could meet a number given here; `unique_paths` settles those exactly.
    """
    x = jobs.withColumn("candidate", P.with_extension("path")).withColumn("_low", F.lower("candidate"))
    n = F.row_number().over(W.partitionBy("_low").orderBy("input_order"))
    numbered = F.concat(F.regexp_replace("candidate", r"\.epub\z", ""), F.lit("-"), n.cast("string"), F.lit(".epub"))
    return x.withColumn("output_path", F.when(n == 1, F.col("candidate")).otherwise(numbered)).drop("_low")


def unique_paths(jobs: DataFrame) -> DataFrame:
    """As output_paths, but probing past names that other jobs have taken before: each job, in input order (which must be unique), takes the first of candidate, candidate-2, candidate-3 ... that is free.

    Found by rounds over tables: each job asks for a name, the earliest in input order holds it, and the others ask for a later one. As all names prefer
    the same jobs, that ends where taking turns would. A job starts at its place among those of its own candidate, which no
    turn can undercut, and skips whole runs of numbers that earlier jobs hold, so rounds are few. Only names that could meet take part.
    """
    staged = Staged(jobs.sparkSession, "paths")
    x = jobs.withColumn("candidate", P.with_extension("path")).withColumn("_low", F.lower(F.regexp_replace("candidate", r"\.epub\z", "")))
    x = staged.put(x.withColumn("_root", F.regexp_replace("_low", r"(-[0-9]+)+\z", "")))
    shared = x.groupBy("_root", "_low").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_root").distinct()
    own = W.partitionBy("low").orderBy("at")
    state = x.join(shared, "_root", "left_semi").select(F.col("input_order").alias("at"), F.col("_low").alias("low"))
    state = staged.put(state.withColumn("n", F.row_number().over(own).cast("long")))
    while True:
        asked = state.withColumn("name", F.when(F.col("n") == 1, F.col("low")).otherwise(F.concat("low", F.lit("-"), F.col("n").cast("string"))))
        asked = staged.put(asked.withColumn("holder", F.min("at").over(W.partitionBy("name"))))
        lost = asked.where("at <> holder")
        if lost.isEmpty():
            break
        # runs of numbers that are held by jobs before all of a name's losers
        least = lost.groupBy("low").agg(F.min("at").alias("least"))
        held = asked.where("at = holder").select("at", F.regexp_extract("name", r"^(.*)-([1-9][0-9]{0,17})\z", 1).alias("low"), F.regexp_extract("name", r"-([1-9][0-9]{0,17})\z", 1).try_cast("long").alias("k")).where("k > 1")
        held = held.join(least, "low").where("at < least").select("low", "k").withColumn("run", F.col("k") - F.row_number().over(W.partitionBy("low").orderBy("k")))
        runs = held.groupBy(F.col("low").alias("_l"), "run").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
        moved = lost.join(runs, (F.col("low") == F.col("_l")) & (F.col("n") + 1 >= F.col("lo")) & (F.col("n") + 1 <= F.col("hi")), "left").select("at", "low", (F.coalesce("hi", "n") + 1).alias("n"))
        after = asked.where("at = holder").select("at", "low", "n").unionByName(moved)
        rank = F.row_number().over(own)
        after = staged.put(after.select("at", "low", (rank + F.max(F.col("n") - rank).over(own.rowsBetween(W.unboundedPreceding, 0))).alias("n")))
        staged.drop(state)
        staged.drop(asked)
        state = after
    numbered = F.concat(F.regexp_replace("candidate", r"\.epub\z", ""), F.lit("-"), F.col("n").cast("string"), F.lit(".epub"))
    met = x.join(state.select(F.col("at").alias("input_order"), "n"), "input_order", "left")
    return met.withColumn("output_path", F.when(F.coalesce("n", F.lit(1)) == 1, F.col("candidate")).otherwise(numbered)).select(*jobs.columns, "candidate", "output_path")


def validation(reports: DataFrame, fail_on_warnings: bool = False) -> DataFrame:
    """Adds warnings, errors and passed to (raw, exit_ok): errors alone don't fail a report whose program ended well."""
    x = reports.withColumn("warnings", F.regexp_count("raw", F.lit("WARNING")).cast("long")).withColumn("errors", F.regexp_count("raw", F.lit("ERROR")).cast("long"))
    return x.withColumn("passed", F.col("exit_ok") & ~(F.lit(fail_on_warnings) & (F.col("warnings") > 0)))


def progress(events: DataFrame) -> DataFrame:
    """(doc, stage, seq, n_events): where each document is now."""
    return events.groupBy("doc").agg(F.max_by("stage", "seq").alias("stage"), F.max("seq").alias("seq"), F.count(F.lit(1)).alias("n_events"))


#: Stages of a conversion in order; archives need no recognition, and validation is left out unless asked for.
STAGES = ("reading_input", "ocr", "normalize", "package_epub", "validate", "complete")


def progress_plan(jobs: DataFrame, validate: bool = False) -> DataFrame:
    """(doc_id, seq, stage, step, total_steps) of jobs (doc_id, format): the stages that each will go through."""
    stages = F.filter(F.array(*map(F.lit, STAGES)), lambda s: (F.lit(validate) | (s != "validate")) & ((F.col("format") == "pdf") | (s != "ocr")))
    x = jobs.select("doc_id", stages.alias("s")).select("doc_id", F.posexplode("s").alias("seq", "stage"), F.size("s").alias("total_steps"))
    return x.select("doc_id", "seq", "stage", (F.col("seq") + 1).alias("step"), "total_steps")


def sorted_queue(jobs: DataFrame, column: str = "file", ascending: bool = True) -> DataFrame:
    """Adds place from 1: by status (pending, running, done, error), or by file, output or message in natural order without case; ties by file name."""
    text = {"file": P.basename("path"), "output": F.coalesce("output_path", F.lit("")) if "output_path" in jobs.columns else F.lit(""), "message": F.coalesce("message", F.lit("")) if "message" in jobs.columns else F.lit("")}
    rank = F.array_position(F.array(*map(F.lit, ("pending", "running", "done", "error"))), F.col("status"))
    own = rank if column == "status" else P.natural_key(F.lower(text[column]))
    name = P.natural_key(F.lower(P.basename("path")))
    turn = lambda c, up: c.asc() if up else c.desc()
    order = W.orderBy(turn(own, ascending), turn(name, ascending or column != "status"), "path", "input_order")
    return jobs.withColumn("place", F.row_number().over(order))


def report(outcomes: DataFrame) -> list[str]:
    """Lines for a console, from the totals."""
    r = summary(outcomes).first()
    return [f"{r.successes} converted, {r.failures} failed", f"{r.pages} pages, {r.chapters} chapters, {r.images} images, {r.cache_hits} from cache"]


def counts(pages: DataFrame, chapters: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, pages, chapters, images); pages count whether blank or not."""
    n = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    x = n(pages, "pages").join(n(chapters, "chapters"), "doc_id", "left").join(n(images, "images"), "doc_id", "left")
    return x.select("doc_id", "pages", F.coalesce("chapters", F.lit(0)).alias("chapters"), F.coalesce("images", F.lit(0)).alias("images"))
