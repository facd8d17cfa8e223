"""Sinks that insert, update or leave rows, as joins on the key."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.symbols import provider_name

CANDLE_KEY = ("asset_id", "provider_id", "timeframe", "open_time")
CANDLE_VALUES = ("close_time", "open", "high", "low", "close", "volume", "quote_volume", "trade_count")


def last_wins(incoming: DataFrame, key: tuple[str, ...], seq: str | None = None) -> DataFrame:
    """One delivery of every key: the last by ``seq``, or without one, and among equals, the greatest row. An aggregate, so that repeats are combined before the shuffle."""
    rest = [c for c in incoming.columns if c not in key]
    if not rest:
        return incoming.distinct()
    last = incoming.groupBy(*key).agg(F.max(F.struct(*([F.col(seq).alias("_order")] if seq else []), *rest)).alias("_last"))
    return last.select(*(F.col(k) if k in key else F.col(f"_last.{k}").alias(k) for k in incoming.columns))


def upsert(stored: DataFrame, incoming: DataFrame, key: tuple[str, ...] = CANDLE_KEY, values: tuple[str, ...] = CANDLE_VALUES, seq: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """All rows after the upsert, with action: insert, update (a value differs), same, or kept (not delivered). One full outer join on the key.

    Of deliveries that repeat a key the last by ``seq`` counts, or the greatest. A null in a key is a value like any other. ``carry`` are columns
    of the delivery that are shown and not compared. Stored columns outside key and values stay as they are, and are null in new rows."""
    rest = [c for c in stored.columns if c not in (*key, *values)]
    if clash := {*rest} & {*carry, "action"}:
        raise ValueError(f"columns {sorted(clash)} stand in both the stored table and the result")
    a = stored.select(*key, *values, *rest, F.lit(True).alias("_here")).alias("a")
    b = last_wins(incoming.select(*dict.fromkeys([*key, *values, *carry, *([seq] if seq else [])])), key, seq).withColumn("_here", F.lit(True)).alias("b")
    on = reduce(and_, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key))
    here, there = F.col("b._here").isNotNull(), F.col("a._here").isNotNull()
    differs = reduce(or_, (~F.col(f"a.{v}").eqNullSafe(F.col(f"b.{v}")) for v in values), F.lit(False))
    action = F.when(~there, "insert").when(~here, "kept").when(differs, "update").otherwise("same")
    new = [F.when(here, F.col(f"b.{v}")).otherwise(F.col(f"a.{v}")).alias(v) for v in values]
    return a.join(b, on, "full_outer").select(*(F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in key), *new, *(F.col(f"a.{c}").alias(c) for c in rest), *(F.col(f"b.{c}").alias(c) for c in carry), action.alias("action"))


def counts(upserted: DataFrame) -> DataFrame:
    return upserted.agg(F.count_if(F.col("action") == "insert").alias("inserted"), F.count_if(F.col("action") == "update").alias("updated"))


def absent(stored: DataFrame, incoming: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Incoming rows whose key is not stored, once each (of several the greatest): what get-or-create, seeds and mappings append."""
    return last_wins(incoming, key).join(stored.select(*key), list(key), "left_anti")


def with_stored_id(rows: DataFrame, by: Column, stored: DataFrame, key: str, name: str) -> DataFrame:
    """rows with a column ``name``: the id of the stored row whose ``key`` is ``by``, the least if there are several, or the hash that a new row will have.

    One equi-join with a row a key of the stored table, which Spark broadcasts while that is small."""
    ids = stored.groupBy(F.col(key).alias("_key")).agg(F.min("id").alias("_id"))
    return rows.withColumn("_by", by).join(ids, F.col("_by") == F.col("_key"), "left").withColumn(name, F.coalesce("_id", F.sha2("_by", 256))).drop("_by", "_key", "_id")


def provider_rows(codes: DataFrame, category: str) -> DataFrame:
    """Rows of providers as get-or-create makes them, from a column code."""
    code = F.col("code")
    return codes.select(F.sha2("code", 256).alias("id"), code, provider_name(code).alias("name"), F.lit(category).alias("category"), F.lit(True).alias("is_active"))


def asset_rows(symbols: DataFrame, symbol: str = "symbol") -> DataFrame:
    """Rows of assets as get-or-create makes them, from a column of normalized symbols."""
    s = F.col(symbol)
    return symbols.select(F.sha2(s["normalized"], 256).alias("id"), s["normalized"].alias("normalized_symbol"), s["display"].alias("display_symbol"), F.concat_ws(" / ", s["base"], s["quote"]).alias("name"),
                          s["base"].alias("base_currency"), s["quote"].alias("quote_currency"), s["asset_class"].alias("asset_class"), F.lit(True).alias("is_active"))


def match_news(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming with match_id: the stored item of equal url or of equal (dedup_key, source_name), the least id if there are several, null if none.

    The OR is a union of two equi-joins. Stored items are brought down to the least id of each url and of each key before,
    so that an incoming item meets at most one row a join, however many share its url or key. Empty urls match each other, as any other text does."""
    s = stored.select(F.col("id").alias("match_id"), "url", "dedup_key", "source_name")
    by_url = incoming.select("seq", "url").join(s.groupBy("url").agg(F.min("match_id").alias("match_id")), "url").select("seq", "match_id")
    by_key = incoming.select("seq", "dedup_key", "source_name").join(s.groupBy("dedup_key", "source_name").agg(F.min("match_id").alias("match_id")), ["dedup_key", "source_name"]).select("seq", "match_id")
    best = by_url.unionByName(by_key).groupBy("seq").agg(F.min("match_id").alias("match_id"))
    return incoming.join(best, "seq", "left")


def news_groups(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming with match_id and the id of the item that each row meets: the match, or the hash of its url, or without one of its key."""
    key = F.when(F.coalesce("url", F.lit("")) != "", F.col("url")).otherwise(F.concat_ws("|", "dedup_key", "source_name"))
    return match_news(stored, incoming).withColumn("id", F.coalesce(F.col("match_id").cast("string"), F.sha2(key, 256)))


def upsert_news(stored: DataFrame, incoming: DataFrame, grouped: DataFrame | None = None) -> DataFrame:
    """The stored columns of all items after the upsert, with action. A match is overwritten but for its source_name and what the delivery doesn't have; a new item's id is the hash of its url, or of its key.

    Rows of one batch that meet the same item, or share a new url or key, give one item: the last delivery by seq wins. Values take the stored columns' types."""
    groups = news_groups(stored, incoming) if grouped is None else grouped
    brought = [c for c in stored.columns if c in groups.columns and c not in ("id", "source_name")]
    rest = [c for c in stored.columns if c not in ("id", "source_name", *brought)]
    latest = last_wins(groups.select("id", "seq", "match_id", "source_name", *(F.col(c).cast(stored.schema[c].dataType).alias(c) for c in brought)), ("id",), "seq")
    old = stored.select(F.col("id").cast("string").alias("id"), F.col("source_name").alias("_source"), *rest)
    new = latest.join(old, "id", "left").withColumns({"source_name": F.coalesce("_source", "source_name"), "action": F.when(F.col("match_id").isNull(), "insert").otherwise("update")})
    kept = stored.withColumns({"id": F.col("id").cast("string"), "action": F.lit("kept")}).join(latest.select("id"), "id", "left_anti")
    return new.select(*stored.columns, "action").unionByName(kept.select(*stored.columns, "action"))


def upsert_links(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Links by (news_item_id, asset_id), relevance of the delivery over the stored one; stale links stay."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return last_wins(both, ("news_item_id", "asset_id"), "_new").drop("_new")


def run_record(provider: Column, job: str, status: Column, details: Column, started: Column, finished: Column) -> list[Column]:
    """The columns of a row of ingestion_runs; details is a struct, kept as JSON."""
    return [provider.alias("provider_id"), F.lit(job).alias("job_name"), status.alias("status"), started.alias("started_at"), finished.alias("finished_at"), F.to_json(details).alias("details")]
