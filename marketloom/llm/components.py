"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and component (the smallest id reachable) for every id in the edges; loops and repeated edges do no harm.

    Each round gives every id the least label among its neighbours', then the label of that label, so that paths halve.
    The labels of a round are written in the shared folder, which cuts the lineage. Rows with a null end are left out."""
    one = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    both = written(one.union(one.select("v", "u")).distinct())
    labels = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("label"), F.lit(True).alias("moved")))
    while labels.agg(F.count_if("moved").alias("n")).first()["n"]:
        now = labels.select("id", "label")
        near = both.join(now.withColumnRenamed("id", "v"), "v").groupBy("u").agg(F.min("label").alias("near")).withColumnRenamed("u", "id")
        low = now.join(near, "id").select("id", "label", F.least("label", "near").alias("low"))
        of = now.select(F.col("id").alias("low"), F.col("label").alias("jump"))
        labels = written(low.join(of, "low", "left").select("id", F.coalesce("jump", "low").alias("new"), (F.coalesce("jump", "low") < F.col("label")).alias("moved")).withColumnRenamed("new", "label"))
    return labels.select("id", F.col("label").alias("component"))
