"""Joins in time: the last row at or before a moment, and rows whose intervals meet. Work is dealt by key and stretch of time, so that the history of one key is many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def stretch(ts: Column, seconds: int) -> Column:
    """The number of the stretch of so many seconds since the epoch in which a moment lies."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")


def asof(left: DataFrame, right: DataFrame, key: tuple[str, ...], at: str, right_at: str, tie: tuple[str, ...] = (), name: str = "found", forward: bool = False, seconds: int = DAY, within: int | None = None) -> DataFrame:
    """left with a column ``name``: STRUCT of the other columns of the last right row of its key at or before ``at``, or with ``forward`` of the first at or after it; null if there is none.

    Of right rows of one moment the one of greatest ``tie`` counts, forward that of the smallest, and among those alike the greatest or smallest row. ``within``: the row found is at most so many seconds away.
    Rows of left without a key or moment find nothing, those of right are not found; repeated rows of left stay.
    Both sides meet, sorted, in stretches of ``seconds`` by key. What a stretch has to take from earlier ones is one row a key and stretch, carried on among these few rows:
    neither a key with a third of all rows nor a history of decades is one task's, and no pair is built that isn't found."""
    values = [c for c in right.columns if c not in key]
    row = F.struct(F.col(right_at).alias("_at"), *(F.col(c).alias(f"_tie_{k}") for k, c in enumerate(tie)), F.struct(*values).alias("_row"))
    known = F.lit(True)
    for k in key:
        known = known & F.col(k).isNotNull()
    r = right.where(known & F.col(right_at).isNotNull()).select(*key, stretch(F.col(right_at), seconds).alias("_b"), row.alias("_r"))
    of = left.select("*", F.struct(*left.columns).alias("_left"))
    l = of.where(known & F.col(at).isNotNull()).select(*key, stretch(F.col(at), seconds).alias("_b"), F.col(at).alias("_t"), "_left")
    best = F.min if forward else F.max
    ends = r.groupBy(*key, "_b").agg(best("_r").alias("_end"))
    wanted = l.select(*key, "_b").distinct()
    towards = F.col("_b").desc() if forward else F.col("_b").asc()
    # a stretch that is wanted stands as a row without an end in front of its own end, so that only earlier ones reach it
    before = Window.partitionBy(*key).orderBy(towards, F.col("_end").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    both = ends.unionByName(wanted.withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType)))
    carried = both.withColumn("_carried", F.last("_end", True).over(before)).where("_end is null").drop("_end")
    none = F.lit(None).cast(l.schema["_left"].dataType)
    here = r.select(*key, "_b", F.col("_r._at").alias("_t"), "_r", none.alias("_left")).unionByName(l.withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType)))
    first = F.col("_left").isNotNull()  # right rows of the same moment come first
    order = [F.col("_t").desc(), first, F.col("_r").desc()] if forward else [F.col("_t"), first, F.col("_r")]
    upto = Window.partitionBy(*key, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    met = here.withColumn("_here", F.last("_r", True).over(upto)).where(first)
    met = met.join(carried, [*key, "_b"], "left").withColumn("_best", F.coalesce("_here", "_carried"))
    near = F.col("_best._row")
    if within is not None:
        apart = F.abs(F.unix_micros(F.col("_best._at").cast("timestamp")) - F.unix_micros(F.col("_t").cast("timestamp")))
        near = F.when(apart <= within * 1_000_000, near)
    out = met.select("_left.*", near.alias(name))
    rest = of.where(~(known & F.col(at).isNotNull())).select("_left.*", F.lit(None).cast(out.schema[name].dataType).alias(name))
    return out.unionByName(rest)


def meeting(left: DataFrame, right: DataFrame, key: tuple[str, ...], start: str, end: str, right_start: str, right_end: str | None = None, seconds: int = DAY) -> DataFrame:
    """Pairs of a left and a right row of one key whose closed intervals meet: columns of left, then those of right but the key. Without ``right_end`` right rows are moments.

    Each interval stands in every stretch of ``seconds`` that it meets, so the join is an equi-join on key and stretch, in which Spark can split skewed ones. A pair that shares several
    stretches is kept in the first of them. Rows without a key or bound, and intervals that end before they start, meet nothing. ``seconds`` should be about the usual length of an
    interval: shorter ones repeat long intervals, longer ones let more pairs be looked at that don't meet."""
    over = {c for c in right.columns if c not in key} & set(left.columns)
    if over:
        raise ValueError(f"columns {sorted(over)} stand on both sides")
    right_end = right_end or right_start

    def dealt(df: DataFrame, a: str, b: str, mark: str) -> DataFrame:
        first, last = stretch(F.col(a), seconds), stretch(F.col(b), seconds)
        return df.where(F.col(a) <= F.col(b)).withColumn(f"_{mark}", first).withColumn("_b", F.explode(F.sequence(first, last)))

    pairs = dealt(left, start, end, "l").join(dealt(right, right_start, right_end, "r"), [*key, "_b"])
    meet = (F.col(start) <= F.col(right_end)) & (F.col(right_start) <= F.col(end)) & (F.col("_b") == F.greatest("_l", "_r"))
    return pairs.where(meet).select(*left.columns, *(c for c in right.columns if c not in key))
