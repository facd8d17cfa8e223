"""Mixing sources to target weights, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Hash-random keys fall into so many ranges (three hex digits), each a sort of its own.
RANGES = 16**3


def words(text: Column) -> Column:
    """The number of words [^\\x20\\x09-\\x0D]+ in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, source_size and target for a table (source, source_size) with one row per source.

    Sources in code point order, null last, have the weights in turn. They share the sum of all sizes by weight. A target stops
    at ``most`` times its source's size, and the excess goes to the others by weight until none is above. That end is a
    level: target = least(most * size, level * weight). With sources by rising size / weight and the first k of them at their
    stop, the level that shares the rest is greatest for the right k. The windows without keys run over a row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.lit(list(weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = sizes.withColumn("weight", cycle.cast("double")).withColumn("stop", (F.lit(most) * F.col("source_size")).cast("double"))
    by_ratio = Window.orderBy((F.col("stop") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(every)
    stopped, used = F.coalesce(F.sum("stop").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (total - stopped) / (F.sum("weight").over(every) - used)
    leveled = capped.withColumn("level", level)
    return leveled.withColumn("at", F.max("level").over(every)).select("source", "source_size", F.least("stop", F.col("at") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size (words), source_size, target (the source's) and taken (words the mix takes, repeats counted), source, and the columns ``keep`` of each row.

    Every document has a hash-random key, of its id or, where that is null, of its text. Within its source the keys are sorted in ranges; sums over ranges, then over the
    rows of a range, give each document the words before it. A target of e whole epochs and a rest takes every document
    e times and cuts the last epoch at the exact word. Sums are over (source, range), so a source with a third of all rows is as
    many sorts as RANGES. Null texts and texts without words have size 0 and give 0. A null source is a source. Repeated rows count each
    by itself; among rows alike it is open which one is cut, which gives the same rows. An empty table gives no rows.
    The result depends on seed and rows only, not on how they are partitioned."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.col(text_col))), F.lit(""))))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), key.alias("key"), *keep)
    sized = written(sized.withColumn("range", F.substring("key", 1, 3)))
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    goals = targets(ranges.groupBy("source").agg(F.sum("in_range").alias("source_size")), weights, most)
    earlier = F.sum("in_range").over(Window.partitionBy("source").orderBy("range")) - F.col("in_range")
    ranges = ranges.select("source", "range", earlier.alias("earlier"))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("in_order", F.sum("size").over(within) - F.col("size"))
    same = placed["source"].eqNullSafe(ranges["source"]) & (placed["range"] == ranges["range"])
    placed = placed.join(ranges, same).select("doc_id", placed["source"], "size", *keep, (F.col("earlier") + F.col("in_order")).alias("before"))
    joined = placed.join(goals, placed["source"].eqNullSafe(goals["source"])).select("doc_id", placed["source"], "size", "source_size", "target", "before", *keep)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *keep)


ORACLE = """
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5('mix:' || CAST(doc_id AS VARCHAR)) AS k FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS stop FROM totals),
leveled AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(stop) OVER w, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0)) AS level
  FROM weighed WINDOW w AS (ORDER BY stop / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (SELECT source, source_size, least(stop, (max(level) OVER ()) * weight) AS target FROM leveled),
placed AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS earlier FROM sized)
SELECT p.doc_id, p.size, g.source_size, g.target,
  CAST(CASE WHEN g.source_size > 0 THEN CAST(floor(g.target) AS BIGINT) // g.source_size ELSE 0 END * p.size
    + greatest(0, least(p.size, CAST(floor(g.target) AS BIGINT) - CASE WHEN g.source_size > 0 THEN CAST(floor(g.target) AS BIGINT) // g.source_size ELSE 0 END * g.source_size - p.earlier)) AS BIGINT) AS taken
FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source
"""
