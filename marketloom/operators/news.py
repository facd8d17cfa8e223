"""News: first-seen dedup, labels, tags and importance, and the feed with its contradiction signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.exprs import in_range


def with_keys(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("dedup_key", T.dedup_key(F.col("source_name"), F.col("title"), F.col("published_at")))


def first_seen(candidates: DataFrame, seq: str = "seq") -> DataFrame:
    """The first row of every dedup key in order of arrival, of equal ones the least row. An aggregate, so that repeats are combined before the shuffle."""
    rest = [c for c in candidates.columns if c != "dedup_key"]
    first = candidates.groupBy("dedup_key").agg(F.min_by(F.struct(*rest), F.struct(seq, *(F.col(c) for c in rest if c != seq))).alias("_first"))
    return first.select(*("dedup_key" if c == "dedup_key" else F.col(f"_first.{c}").alias(c) for c in candidates.columns))


def labelled(candidates: DataFrame, title: Column | None = None, summary: Column | None = None, label: Column | None = None, score: Column | None = None, positive=T.POSITIVE, negative=T.NEGATIVE) -> DataFrame:
    """candidates with sentiment_label and sentiment_score. The text is made plain once, then its terms are counted, then the label is chosen: three steps of which each reads the last one's columns."""
    of = lambda x, name: F.col(name) if x is None else x
    df = candidates.withColumn("_plain", T.plain(T.headline_text(of(title, "title"), of(summary, "summary"))))
    df = df.withColumns({"_up": T.hits(F.col("_plain"), positive), "_down": T.hits(F.col("_plain"), negative)})
    df = df.withColumn("_s", T.sentiment(F.col("_up"), F.col("_down"), of(label, "provider_label"), of(score, "provider_score")))
    return df.withColumns({"sentiment_label": F.col("_s.label"), "sentiment_score": F.col("_s.score")}).drop("_plain", "_up", "_down", "_s")


def tags(candidates: DataFrame, assets: DataFrame, seq: str = "seq") -> DataFrame:
    """seq, asset symbol and relevance of every pair over the threshold 0.35.

    Headlines and assets meet in one equi-join on what may match: tickers, words, pairs of words with a slash, and the parts of words that are
    as long as some symbol. So the work grows with the texts and the matches, not with texts times assets; Spark broadcasts the registry while it is small.
    The join keeps headlines' keys without a match, which the threshold drops after the aggregate: Spark can't broadcast the side that an outer join keeps, and it
    takes exploded keys for as small as the file of the headlines."""
    names = assets.select(F.col("normalized_symbol").alias("symbol"), F.explode(T.asset_keys(F.col("normalized_symbol"), F.col("base_currency"), F.col("display_symbol"))).alias("k"))
    keys = names.select("symbol", "k.*").groupBy("kind", "key", "symbol").agg(F.max("relevance").alias("relevance"))
    lengths = keys.where("kind = 'inside'").agg(F.collect_set(F.length("key"))).scalar()
    read = candidates.withColumns({"_text": T.tag_text(F.col("title"), F.col("summary")), "_lengths": lengths})
    asked = read.select(seq, F.explode(T.headline_keys(F.col("_text"), F.col("tickers"), F.col("_lengths"))).alias("k"))
    found = asked.select(seq, "k.*").where("key is not null").join(keys, ["kind", "key"], "left")
    best = found.groupBy(seq, "symbol").agg(F.max("relevance").alias("relevance"))
    return best.where("relevance >= 0.35").select(seq, "symbol", F.round("relevance", 2).alias("relevance"))


def with_tags(items: DataFrame, links: DataFrame, item_id: str = "seq") -> DataFrame:
    """items with tags, ARRAY(STRUCT(relevance, symbol)) by falling relevance, then symbol; empty without links."""
    ranked = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("relevance")).alias("low"), "symbol"))), lambda x: F.struct((-x["low"]).alias("relevance"), x["symbol"].alias("symbol")))
    of = links.groupBy(item_id).agg(ranked.alias("tags"))
    return items.join(of, item_id, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<struct<relevance:double,symbol:string>>")))


def links(items: DataFrame, item_id: str = "seq") -> DataFrame:
    """The links of tagged items: item, symbol and relevance."""
    return items.select(item_id, F.explode("tags").alias("t")).select(item_id, "t.symbol", "t.relevance")


def with_importance(items: DataFrame, as_of: Column) -> DataFrame:
    """Tagged items with importance_score."""
    most = F.get("tags", F.lit(0))["relevance"]
    age = (F.unix_micros(as_of) - F.unix_micros(F.col("published_at").cast("timestamp"))) / 3.6e9
    return items.withColumn("importance_score", T.importance(age, F.col("sentiment_score"), most, F.col("provider_importance")))


def ingest(candidates: DataFrame, assets: DataFrame, as_of: Column) -> DataFrame:
    """Items of a batch, labelled, tagged and with importance, repeated headlines left out. Tags stay a column until links are asked for."""
    first = first_seen(with_keys(candidates))
    return with_importance(with_tags(labelled(first), tags(first, assets)), as_of)


def signals(items: DataFrame, changes: DataFrame, item_id: str = "id") -> DataFrame:
    """item, symbol, price_change_pct_24h and is_contradiction for tags of items with assets that have a price change."""
    each = items.select(item_id, "sentiment_label", F.explode("tags.symbol").alias("symbol")).join(changes, "symbol")
    return each.select(item_id, "symbol", F.round("change_pct", 4).alias("price_change_pct_24h"), T.contradicts(F.col("sentiment_label"), F.col("change_pct")).alias("is_contradiction"))


def recent(items: DataFrame, as_of: Column, hours: int = 72) -> DataFrame:
    return items.where(F.col("published_at") >= as_of - F.make_dt_interval(F.lit(0), F.lit(in_range("hours", hours, 1, 720))))


def feed(items: DataFrame, changes: DataFrame, as_of: Column, hours: int = 72, limit: int | None = 20, symbol: str | Column | None = None, item_id: str = "id", stored_links: DataFrame | None = None) -> DataFrame:
    """The newest items of the last ``hours``, with the symbols linked to them and their contradiction signals; items without links have empty arrays.

    With a symbol, only items linked to it. Links are the items' tags, or those of a stored table (item, symbol, relevance). The page of items is
    chosen before anything is joined to it, and only its links meet the price changes."""
    page = recent(items, as_of, hours)
    if symbol is not None:
        page = page.where(F.exists("tags", lambda t: t["symbol"] == symbol)) if stored_links is None else page.join(stored_links.where(F.col("symbol") == symbol).select(item_id), item_id, "left_semi")
    if limit is not None:
        page = page.orderBy(F.col("published_at").desc(), F.col(item_id)).limit(in_range("limit", limit, 1, 200))
    if stored_links is not None:
        page = with_tags(page, stored_links.join(page.select(item_id), item_id, "left_semi"), item_id)
    rest = [c for c in page.columns if c not in (item_id, "tags")]
    each = page.select(item_id, F.struct(*rest).alias("_rest"), F.explode_outer("tags").alias("_t")).withColumn("symbol", F.col("_t.symbol")).join(changes, "symbol", "left")
    signal = F.struct(F.col("symbol").alias("asset_symbol"), F.round("change_pct", 4).alias("price_change_pct_24h"), T.contradicts(F.col("_rest.sentiment_label"), F.col("change_pct")).alias("is_contradiction"))
    found = each.groupBy(item_id).agg(F.any_value("_rest").alias("_rest"), F.array_sort(F.collect_list("symbol")).alias("asset_symbols"), F.array_sort(F.collect_list(F.when(F.col("change_pct").isNotNull(), signal))).alias("contradiction_signals"))
    return found.select(item_id, "_rest.*", "asset_symbols", "contradiction_signals").withColumns({"summary": F.coalesce("summary", F.lit("")), "url": F.coalesce("url", F.lit(""))})


def newest_of_symbols(items: DataFrame, as_of: Column, hours: int = 72, limit: int = 20, item_id: str = "id") -> DataFrame:
    """The rows (symbol, item, sentiment_label, tags) of every symbol's newest items, as its own feed would show them. Spark cuts each partition to ``limit`` rows a symbol before the shuffle."""
    each = recent(items, as_of, hours).select(item_id, "published_at", "sentiment_label", "tags", F.explode("tags.symbol").alias("symbol"))
    newest = Window.partitionBy("symbol").orderBy(F.col("published_at").desc(), item_id)
    return each.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= in_range("limit", limit, 1, 200)).drop("_rank")
