"""JSON payloads as VARIANT: parsed once, asked by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(df: DataFrame, column: str, name: str = "payload") -> DataFrame:
    """df with ``name``, the VARIANT of a JSON text; null where the text is null or damaged. What follows a whole value isn't looked at."""
    return df.withColumn(name, F.try_parse_json(column))


def at_paths(df: DataFrame, paths: dict[str, tuple[str, str]], variant: str = "payload") -> DataFrame:
    """df with a column per entry, name -> (path, Spark type): null where the path leads nowhere or to something that is no such type."""
    return df.withColumns({n: F.try_variant_get(variant, path, kind) for n, (path, kind) in paths.items()})


def damage(df: DataFrame, column: str, variant: str = "payload", key: tuple[str, ...] = ()) -> DataFrame:
    """How many texts there are, how many are missing and how many are damaged, by key."""
    text, value = F.col(column), F.col(variant)
    return df.groupBy(*key).agg(F.count("*").alias("texts"), F.count_if(text.isNull()).alias("missing"), F.count_if(text.isNotNull() & value.isNull()).alias("damaged"))


def kinds(df: DataFrame, variant: str = "payload") -> Column:
    """The schema that all values of a column fit in, as text: an aggregate."""
    return F.schema_of_variant_agg(variant)
