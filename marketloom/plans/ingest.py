"""Ingestion as whole plans: requests and payloads in, the stored tables after them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import in_range
from ..functions.symbols import normalize_symbol, provider_symbol, timeframe_minutes
from ..operators import news as N
from ..operators import upsert as U
from ..operators.candles import latest_n
from ..sources import parsers
from ..sources.schemas import VOLUME, active

#: Asset classes that a request may name.
CLASSES = ("crypto", "forex")
PRICES = ("open", "high", "low", "close", "volume")


def _wrong(payload: Column) -> Column:
    """Why a request gives no candles, else null; known before its payload is parsed."""
    provider, routed = F.col("provider_code"), parsers.route(F.col("s.asset_class"), F.col("timeframe"), strict=False)
    return (
        F.when(provider_symbol(F.col("s"), provider, strict=False).isNull(), F.concat(F.lit("not a provider: "), provider))
        .when(timeframe_minutes(F.col("timeframe"), strict=False).isNull(), F.concat(F.lit("not a timeframe: "), F.col("timeframe")))
        .when((provider == "alpha_vantage") & routed.isNull(), F.concat_ws(" ", F.lit("no route for"), F.col("s.asset_class"), F.col("timeframe")))
        .when(provider == "alpha_vantage", F.coalesce(parsers.failure(payload), parsers.no_series(payload)))
        .when(F.from_json(payload, "array<array<double>>").isNull(), F.lit("not an array of rows"))
    )


def ohlcv(requests: DataFrame, stored: dict[str, DataFrame], started: Column, finished: Column | None = None) -> dict[str, DataFrame]:
    """Candles of many requests into the stored tables: normalise, find or make provider, asset and mapping, parse, upsert, and write a run each.

    requests: request_id, provider_code, raw_symbol, asset_class (null, crypto or forex), timeframe, row_limit (1 to 1000), payload (JSON text), and if they have it since,
    a timestamp before which an exchange's candles are left out (null: none are; the other provider's series have no such bound).
    stored: providers, assets, asset_provider_symbols and candles, whatever their ids look like: a stored row's id stands for its code or symbol, and only new rows get a hash. Returns these four after the batch (candles with action), and
    runs: provider_id, job_name, status (success or failed), started_at, finished_at, details (JSON, with duration_ms), with request_id; and rejected: request_id and error.
    A request whose symbol, class or limit is no good is rejected and writes nothing. One whose payload is, is a failed run and writes nothing but its provider and run,
    while the others go on. Of candles of one key the one of the greatest request_id counts, and its request has it in its counts."""
    finished = started if finished is None else finished
    if "since" not in requests.columns:
        requests = requests.withColumn("since", F.lit(None).cast("timestamp"))
    named = requests.withColumn("s", normalize_symbol(F.col("raw_symbol"), F.col("asset_class"), strict=False))
    no_good = (
        F.when(F.col("s").isNull(), F.concat(F.lit("not a symbol: "), F.coalesce("raw_symbol", F.lit("null"))))
        .when(F.col("asset_class").isNotNull() & ~F.col("asset_class").isin(*CLASSES), F.concat(F.lit("not an asset class: "), F.col("asset_class")))
        .when(~F.coalesce(F.col("row_limit").between(1, 1000), F.lit(False)), F.lit("limit must be 1..1000"))
    )
    named = named.withColumn("refused", no_good)
    taken = named.where("refused is null").withColumn("error", _wrong(F.col("payload")))
    taken = U.with_stored_id(taken, F.col("provider_code"), stored["providers"], "code", "provider_id")
    taken = U.with_stored_id(taken, F.col("s.normalized"), stored["assets"], "normalized_symbol", "asset_id")
    good = taken.where("error is null")
    carried = ("request_id", "asset_id", "provider_id", "timeframe", "row_limit", "since", "payload")
    rows = good.where("provider_code = 'ccxt'").select(*carried)
    series = good.where("provider_code = 'alpha_vantage'").select(*carried)
    shown = ("request_id", "asset_id", "provider_id", "timeframe", "open_time", "close_time", *PRICES)
    exchange = parsers.exchange_rows(rows, "payload", limit=F.col("row_limit"), since=F.col("since"))
    fetched = exchange.select(*shown).unionByName(parsers.time_series(series, limit=F.col("row_limit")).select(*shown))
    fetched = fetched.withColumns({"quote_volume": F.lit(None).cast(VOLUME), "trade_count": F.lit(None).cast("int")})
    candles = U.upsert(stored["candles"], fetched, seq="request_id", carry=("request_id",))
    counts = candles.where("request_id is not null").groupBy("request_id").agg(F.count_if(F.col("action") == "insert").alias("inserted_count"), F.count_if(F.col("action") == "update").alias("updated_count"))
    of = fetched.groupBy("request_id").agg(F.count("*").alias("fetched_count"))
    runs = taken.select("request_id", "provider_code", F.col("provider_id").alias("provider"), F.col("s.normalized").alias("symbol"), "timeframe", "error").join(of, "request_id", "left").join(counts, "request_id", "left")
    number = {c: F.when(F.col("error").isNull(), F.coalesce(c, F.lit(0))) for c in ("fetched_count", "inserted_count", "updated_count")}
    took = (F.unix_millis(finished) - F.unix_millis(started)).alias("duration_ms")
    details = F.struct("provider_code", "symbol", "timeframe", *(x.alias(c) for c, x in number.items()), took, "error")
    status = F.when(F.col("error").isNull(), "success").otherwise("failed")
    run = U.run_record(F.col("provider"), "ohlcv_ingestion", status, details, started, finished)
    mapping = good.select("asset_id", "provider_id", provider_symbol(F.col("s"), F.col("provider_code")).alias("provider_symbol"), F.lit(True).alias("is_primary"))
    return {
        "providers": _appended(stored["providers"], U.provider_rows(taken.select(F.col("provider_code").alias("code")), "market_data"), ("code",)),
        "assets": _appended(stored["assets"], U.asset_rows(good, "s"), ("normalized_symbol",)),
        "asset_provider_symbols": _appended(stored["asset_provider_symbols"], mapping, ("asset_id", "provider_id", "provider_symbol")),
        "candles": candles, "runs": runs.select("request_id", *run), "rejected": named.where("refused is not null").select("request_id", F.col("refused").alias("error")),
    }


def _appended(stored: DataFrame, rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    return stored.unionByName(U.absent(stored, rows.select(*[c for c in stored.columns if c in rows.columns]), key), allowMissingColumns=True)


def news(candidates: DataFrame, stored: dict[str, DataFrame], as_of: Column, provider: str = "alpha_vantage") -> dict[str, DataFrame]:
    """A provider's batch of news into the stored tables: first-seen dedup, labels, tags of active assets, importance, provider row, upsert of items and links, and counters.

    candidates: what ``parsers.news_feed`` gives (seq, source_name, title, summary, url, published_at, provider_label, provider_score, provider_importance, tickers, and external_id if they have it).
    stored: providers, assets, news_items and news_asset_links. Returns providers, items (news_items after the upsert, with action), links (news_item_id, asset_id,
    relevance_score) and counters, one row: fetched, deduplicated, inserted, updated, tagged_links. An item's metadata is JSON of provider_sentiment_score, provider_sentiment_label, provider_tickers and tagged_assets.
    Of candidates that meet one item, or share a new url, the first inserts and the others update it, and the last one's values stay."""
    registry = active(stored["assets"])
    if "external_id" not in candidates.columns:
        candidates = candidates.withColumn("external_id", F.lit(None).cast("string"))
    code = candidates.sparkSession.createDataFrame([(provider,)], "code string")
    own = U.with_stored_id(code, F.col("code"), stored["providers"], "code", "provider_id").select("provider_id").scalar()
    metadata = F.struct(F.col("provider_score").alias("provider_sentiment_score"), F.col("provider_label").alias("provider_sentiment_label"), F.col("tickers").alias("provider_tickers"), F.col("tags.symbol").alias("tagged_assets"))
    fresh = N.ingest(candidates, registry, as_of).withColumns({"provider_id": own, "metadata": F.to_json(metadata, {"ignoreNullFields": "false"})})
    grouped = U.news_groups(stored["news_items"], fresh)
    items = U.upsert_news(stored["news_items"], fresh, grouped)
    ids = registry.select(F.col("normalized_symbol").alias("symbol"), F.col("id").alias("asset_id"))
    found = grouped.select(F.col("id").alias("news_item_id"), "seq", F.explode("tags").alias("t")).select("news_item_id", "seq", "t.symbol", F.col("t.relevance").alias("relevance_score")).join(ids, "symbol")
    latest = U.last_wins(found.select("news_item_id", "asset_id", "seq", "relevance_score"), ("news_item_id", "asset_id"), "seq").drop("seq")
    latest = latest.withColumn("relevance_score", F.col("relevance_score").cast(stored["news_asset_links"].schema["relevance_score"].dataType))
    kept = grouped.agg(F.count("*").alias("kept"), F.count_distinct(F.when(F.col("match_id").isNull(), F.col("id"))).alias("inserted"), F.coalesce(F.sum(F.size("tags")), F.lit(0)).cast("long").alias("tagged_links"))
    fetched = candidates.agg(F.count("*")).scalar()
    counters = kept.select(fetched.alias("fetched"), (fetched - F.col("kept")).alias("deduplicated"), "inserted", (F.col("kept") - F.col("inserted")).alias("updated"), "tagged_links")
    providers = _appended(stored["providers"], U.provider_rows(code, "news_context"), ("code",))
    return {"providers": providers, "items": items, "links": U.upsert_links(stored["news_asset_links"], latest), "counters": counters}


def read_feed(items: DataFrame, changes: DataFrame, as_of: Column, hours: int = 72, limit: int = 20, symbol: str | None = None, asset_class: str | None = None, links: DataFrame | None = None, item_id: str = "id") -> DataFrame:
    """The feed as a reader asks for it: a raw symbol, of a class or none, is normalised first, and one that is none raises an error."""
    if asset_class is not None and asset_class not in CLASSES:
        raise ValueError(f"asset_class must be one of {CLASSES}")
    named = None if symbol is None else normalize_symbol(F.lit(symbol), F.lit(asset_class).cast("string"))["normalized"]
    return N.feed(items, changes, as_of, hours, limit, named, item_id, links)


def read_candles(candles: DataFrame, raw_symbol: str, timeframe: str, limit: int = 200, asset_class: str | None = None) -> DataFrame:
    """The newest ``limit`` (1 to 1000) candles of one symbol, as a reader of the stored table asks for them."""
    if asset_class is not None and asset_class not in CLASSES:
        raise ValueError(f"asset_class must be one of {CLASSES}")
    symbol = normalize_symbol(F.lit(raw_symbol), F.lit(asset_class).cast("string"))["normalized"]
    return latest_n(candles.where((F.col("symbol") == symbol) & (F.col("timeframe") == timeframe)), in_range("limit", limit, 1, 1000))
