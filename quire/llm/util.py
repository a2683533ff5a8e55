"""What several operators share: tables, ranks, components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quire.session import Staged, reachable

def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reachable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: list[str], name: str) -> str:
    """`name`, or with underscores after it, so that it is none of `columns` whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns(names: list[str], of: str = "") -> list["F.Column"]:
    """Columns by name, whatever signs the names hold."""
    return [F.col(of + "`" + c.replace("`", "``") + "`") for c in names]


def crc32_text(column: str) -> "F.Column":
    """crc32 of a number written as text; null counts as no text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def md5_number(column: str) -> "F.Column":
    """The first 32 bits of a value's md5, as any SQL engine can compute them."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def rank_within(df: DataFrame, group: list[str], order: list[str], out: str, staged: Staged) -> DataFrame:
    """Adds `out`, each row's rank from 0 within `group` by `order`, ascending, null first. Staged.

    Rows are dealt by ranges of all these columns, so that a group, and a value, may hold any share of them; the
    numbers that rows get in their sorted partitions, less a group's first in each, are its ranks there, and counts by
    partition give what came before. Rows equal in all these columns are ranked in any order.
    """
    at, part, first, n, before = (unused(df.columns, x) for x in ("_at", "_part", "_first", "_n", "_before"))
    keys = columns([*group, *order])
    spread = df.repartitionByRange(parts(df.sparkSession), *keys).sortWithinPartitions(*keys)
    ranked = staged.put(spread.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftright(at, 33)))
    runs = ranked.groupBy(*columns(group), part).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(n))
    earlier = F.sum(n).over(W.partitionBy(*columns(group)).orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    runs = runs.withColumn(before, F.coalesce(earlier, F.lit(0)) - F.col(first))
    same = reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(columns([*group, part], "l."), columns([*group, part], "r."), strict=True)])
    met = ranked.alias("l").join(runs.alias("r"), same)
    return met.select(*columns(df.columns, "l."), (F.col(f"l.{at}") + F.col(f"r.{before}")).cast("long").alias(out))


def running_sums(df: DataFrame, order: list["F.Column"], sums: dict[str, "F.Column"], staged: Staged) -> DataFrame:
    """Adds each name of `sums`: what its values add up to over the rows before, in `order`, 0 for the first.

    Rows are dealt by ranges of the order, and the ranges' totals, a row for each, give what came before: no task sees all rows. Rows equal in the order come in any.
    """
    part = unused(df.columns, "_part")
    dealt = staged.put(df.repartitionByRange(parts(df.sparkSession), *order).withColumn(part, F.spark_partition_id()))
    within = W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy(part).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    totals = totals.select(F.col(part).alias("_of"), *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"_{k}_before") for k in sums])  # a row for each range
    met = dealt.withColumns({k: F.coalesce(F.sum(v).over(within), F.lit(0)) for k, v in sums.items()}).join(F.broadcast(totals), F.col(part) == F.col("_of"))
    return met.select(*columns(df.columns), *[(F.col(k) + F.col(f"_{k}_before")).alias(k) for k in sums])


def connected_components(edges: DataFrame, staged: Staged) -> DataFrame:
    """(node, component) for every node of `edges` (a long, b long); the component is its smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until the edges no longer change.
    Edges stay a table; minima are written and joined back, so that a node with very many
    edges can be split over tasks by adaptive execution.
    """
    edges = staged.put(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())

    def digest(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())

    was = digest(edges)
    while was[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = staged.put(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = staged.put(both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct())
        low = staged.put(large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")))
        small = large.join(low, large["hi"] == low["u"]).select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        after = staged.put(small.select("e.hi", "e.lo").where("hi <> lo").distinct())
        for old in (edges, least, large, low):
            staged.drop(old)
        edges, now = after, digest(after)
        if now == was:
            break
        was = now
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionAll(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).distinct()
