"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .util import Staged, columns, md5_number, rank_within, running_sums, unused

#: Words are what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows for which there is one bucket, by a hash of doc_id, in the order of documents of one size.
BUCKET = 50_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, target) of every source of `sizes` (source, size).

    Sources by code point, null last, take the weights in turn and share the whole size by them. No
    target exceeds `most` times its source's size; what is cut off goes to the others by weight, until
    none is above. With sources in order of size over weight, those cut off come first, so running sums
    over this table of one row for each source find them at once. It may have any number of sources: they are dealt by ranges.
    """
    staged = Staged(sizes.sparkSession, "targets")
    first = lambda df, *aggs: [x or 0 for x in df.agg(*aggs).first()]
    name = F.col("source").asc_nulls_last()
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by = running_sums(by, [name], {"_turn": F.lit(1)}, staged)
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_turn") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * most)
    by = running_sums(by.drop("_turn").withColumn("_by", F.col("source_size") / F.col("w")), [F.col("_by").asc(), name], {"_caps": F.col("cap"), "_ws": F.col("w")}, staged)
    by = staged.put(by)
    total, whole_w = first(by, F.sum("source_size"), F.sum("w"))
    cut = (F.lit(total) - F.col("_caps")).cast("double") * F.col("w") > F.col("cap").cast("double") * (F.lit(whole_w) - F.col("_ws"))
    by = by.withColumn("cut", cut)
    gone, rest_w = first(by, F.sum(F.when(F.col("cut"), F.col("cap"))), F.sum(F.when(~F.col("cut"), F.col("w"))))
    target = F.when(F.col("cut"), F.col("cap").cast("double")).otherwise(F.lit(float(total - gone)) * F.col("w") / F.lit(max(rest_w, 1)))
    return by.select("source", "source_size", target.alias("target"))


def copies(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, the columns of `keep`) for every row of `docs` (doc_id, text, source).

    Each document of a source is expected target / source_size times. Down the source, largest documents
    first, those of a size by a hash of doc_id, the expectations are summed and one offset for the source is added; a document is taken once
    for each integer that its sum crosses. Neighbours have like sizes, so a source's taken words differ
    from its target by its largest document at most. The offset is fixed by source and seed: reruns agree.

    Texts are read once, whole, of any length. Null texts have size 0; null sources are one source. Rows that repeat a doc_id count one by one. A
    source without words has target 0. An empty table gives an empty result. Other columns are ignored, whatever their names, but
    those of `keep`, which aren't named as a column above, part rows that are alike in source, size and doc_id; rows alike in all of these, of which any
    number is ranked in parts too, are taken in any order.
    """
    staged = Staged(docs.sparkSession, "mixing")
    key = unused(["doc_id", "source", "size", *keep], "_row_number")
    sizes = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *columns(keep))
    sizes = staged.put(sizes.withColumn(key, F.monotonically_increasing_id()))
    goals = targets(sizes, weights, most)
    goals = goals.withColumn("_seeded", F.concat(F.coalesce("source", F.lit("")), F.lit(f"#{seed}"))).withColumn("_u", md5_number("_seeded") / F.lit(float(1 << 32)))
    goals = goals.select(F.col("source").alias("_source"), "source_size", "target", "_u")
    buckets = max(1, -(-sizes.count() // BUCKET))
    down = sizes.withColumn("_down", -F.col("size")).withColumn("_bucket", md5_number("doc_id") % buckets)
    ranked = rank_within(down, ["source"], ["_down", "_bucket", "doc_id", *keep, key], "_rank", staged)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor((F.col("_rank") + 1) * rate + F.col("_u")) - F.floor(F.col("_rank") * rate + F.col("_u"))
    met = ranked.join(goals, F.col("source").eqNullSafe(F.col("_source")))
    return met.select("doc_id", "source", "size", "source_size", "target", F.least(crossed, F.lit(most)).alias("copies"), *columns(keep))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 1) -> DataFrame:
    """`docs`, with all of its columns, each row as many times as its own crossings say, whether or not its doc_id is null or repeated (see copies)."""
    key, taken, times, each = (unused(docs.columns, x) for x in ("_row_key", "_taken", "_times", "_each"))
    keyed = Staged(docs.sparkSession, "mixing").put(docs.withColumn(key, F.monotonically_increasing_id()))
    rows = keyed.select("doc_id", "text", "source", F.xxhash64("text").alias("_text_hash"), F.col(key).alias("_row"))
    goals = copies(rows, weights, most, seed, ("_text_hash", "_row")).where("copies > 0").select(F.col("_row").alias(taken), F.col("copies").alias(times))
    met = keyed.join(goals, F.col(key) == F.col(taken)).withColumn(each, F.explode(F.sequence(F.lit(1), F.col(times).cast("int"))))
    return met.select(*columns(docs.columns))


SQL = """
WITH sizes AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
by0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
by1 AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w, source_size * 3 AS cap, sum(source_size) OVER () AS total FROM by0),
by2 AS (SELECT *, total - coalesce(sum(cap) OVER o, 0) AS rest0, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS rest_w0 FROM by1
        WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
by3 AS (SELECT *, rest0::DOUBLE * w > cap::DOUBLE * rest_w0 AS cut FROM by2),
by4 AS (SELECT source, source_size, CASE WHEN cut THEN cap::DOUBLE ELSE (total - sum(CASE WHEN cut THEN cap ELSE 0 END) OVER ())::DOUBLE * w / sum(CASE WHEN cut THEN 0 ELSE w END) OVER () END AS target,
        ('0x' || substr(md5(coalesce(source, '') || '#1'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM by3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size DESC, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % greatest(1, (SELECT (count(*) + 49999) // 50000 FROM documents)), doc_id) - 1 AS r FROM sizes),
rated AS (SELECT doc_id, size, source_size, target, r, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM ranked JOIN by4 ON ranked.source IS NOT DISTINCT FROM by4.source)
SELECT doc_id, size, source_size, target, (size * least(3, floor((r + 1) * rate + u) - floor(r * rate + u)))::BIGINT AS taken FROM rated
"""
