"""The market queries, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import payloads as V
from ..functions import symbols as Y
from ..functions import text as T
from ..functions.ewm import KEY
from ..operators import candles as C
from ..operators import indicators as I
from ..operators import joins as J
from ..operators import levels as L
from ..operators import news as N
from ..operators import rules as R
from ..operators import series as S
from ..operators import sketches as K
from ..operators import thesis as H
from ..operators import upsert as U
from ..session import shared_folder
from ..sources import landing, parsers, schemas
from ..streaming.candles import stream_candles
from ..streaming.sessions import sessions
from . import analysis as A
from . import ingest as G

AS_OF, SPLIT = "2024-01-31 00:00:00", "2024-01-16 00:00:00"
#: Headlines that stand in for a news provider: an event's id chooses one.
HEADLINES = (
    ("BTC rally extends as growth beats", "Optimistic desks see a breakout for BTC/USDT"), ("ETH selloff deepens", "Lawsuit and fraud risk weigh on ETHUSDT"),
    ("Euro steady before data", "EUR/USD holds its range against the dollar"), ("  Markets   wrap - Tuesday!! ", "Nothing moved"),
    ("Downgrade hits miners", "A loss and a drop for BTC holders"), ("Upgrade for EURUSD outlook", "Surge expected, say analysts"), ("ETH gain, EUR loss", "Mixed session"),
)
LABELS = (None, "Somewhat-Bullish", None, "Bearish", "Neutral")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_candles(spark: SparkSession, sf_dir: str, unit: str = "hour", timeframe: str = "1h") -> DataFrame:
    ticks = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.col("event_id").alias("id"))
    return C.resample(ticks, unit, timeframe)


def order_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("id"))
    return C.resample(ticks, "day", "1d")


def walk_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event candles whose closes are summed to a walk around 1000, so that trends and ranges both occur."""
    w = Window.partitionBy("symbol").orderBy("open_time")
    df = event_candles(spark, sf_dir).withColumn("mean", F.avg("close").over(Window.partitionBy("symbol")))
    df = df.withColumn("walk", F.round(1000 + F.sum(F.col("close") - F.col("mean")).over(w.rowsBetween(Window.unboundedPreceding, 0)) / 37, 4)).withColumn("from", F.coalesce(F.lag("walk").over(w), F.lit(1000.0)))
    spread = (F.col("high") - F.col("low")) / 400
    return df.select("symbol", "timeframe", "open_time", F.col("from").alias("open"), F.round(F.greatest("from", "walk") + spread, 6).alias("high"), F.round(F.least("from", "walk") - spread, 6).alias("low"), F.col("walk").alias("close"), "volume")


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def candle_resample(spark, sf_dir):
    return rounded(event_candles(spark, sf_dir), "open", "high", "low", "close")


def candles_latest_n(spark, sf_dir):
    return C.latest_n(order_candles(spark, sf_dir), 200).select("symbol", "open_time", F.round("close", 6).alias("close"))


def candles_joined_dims(spark, sf_dir):
    assets = schemas.assets(spark).select(F.col("normalized_symbol").alias("asset_id"), "display_symbol", "asset_class")
    providers = schemas.providers(spark).select(F.col("code").alias("provider_id"), "rate_limit_per_minute")
    stored = event_candles(spark, sf_dir).withColumns({"asset_id": F.when(F.col("symbol") == "click", "BTCUSDT").when(F.col("symbol") == "view", "ETHUSDT").otherwise("EURUSD"), "provider_id": F.when(F.col("symbol").isin("click", "view"), "ccxt").otherwise("alpha_vantage")})
    return C.with_dimensions(stored, assets, providers).where("timeframe = '1h'").select("symbol", "display_symbol", "asset_class", "rate_limit_per_minute", "open_time", F.round("close", 6).alias("close"))


def _frame(spark, sf_dir):
    return C.series_frame(event_candles(spark, sf_dir))


def _shown(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.select("symbol", "open_time", *(F.round(n, places).alias(n) for n in names))


def sma_volume_sma(spark, sf_dir):
    return _shown(I.averages(_frame(spark, sf_dir)), "sma_20", "volume_sma_20")


def bollinger(spark, sf_dir):
    return _shown(I.bollinger(_frame(spark, sf_dir)), "bb_middle", "bb_upper", "bb_lower", "bb_width")


def true_range(spark, sf_dir):
    return _shown(I.movements(_frame(spark, sf_dir)), "true_range", "gain", "loss")


def directional_movement(spark, sf_dir):
    return _shown(I.movements(_frame(spark, sf_dir)), "plus_dm", "minus_dm")


def ema_20_50_200(spark, sf_dir):
    return _shown(I.emas(C.series_frame(order_candles(spark, sf_dir))), "ema_20", "ema_50", "ema_200", places=4)


def macd(spark, sf_dir):
    return _shown(I.macd(_frame(spark, sf_dir)), "macd_line", "macd_signal", "macd_hist")


def atr_rsi(spark, sf_dir):
    return _shown(I.strength(I.movements(_frame(spark, sf_dir))), "atr_14", "atr_pct", "rsi_14")


def adx(spark, sf_dir):
    return _shown(I.strength(I.movements(C.series_frame(walk_candles(spark, sf_dir)))), "plus_di", "minus_di", "adx_14")


def swing_points(spark, sf_dir):
    return L.swings(C.series_frame(walk_candles(spark, sf_dir))).where("swing_high is not null or swing_low is not null").select("symbol", "open_time", "swing_high", "swing_low")


def support_resistance(spark, sf_dir):
    found = L.levels(C.series_frame(walk_candles(spark, sf_dir), 300))
    side = lambda c: found.select("symbol", F.lit(c).alias("side"), F.posexplode(c).alias("pos", "x"))
    both = side("supports").union(side("resistances"))
    return both.select("symbol", "side", F.col("pos").cast("long").alias("pos"), F.col("x.level").alias("level"), F.col("x.touches").cast("long").alias("touches"), F.round("x.distance_pct", 4).alias("distance_pct"))


def _latest(spark, sf_dir):
    return A.latest_rows(walk_candles(spark, sf_dir))


def trend_regime(spark, sf_dir):
    return _latest(spark, sf_dir).select("symbol", F.col("regime.label").alias("label"), *(F.round(f"regime.{c}", 6).alias(c) for c in ("confidence", "adx", "ema_gap_pct", "ema_slope_pct", "bb_width")))


def _setup_columns(df: DataFrame, setup: Column) -> DataFrame:
    df = df.withColumn("s", setup)
    return df.select("symbol", F.col("open_time"), F.col("s.direction").alias("direction"), *(F.round(f"s.{c}", 6).alias(c) for c in ("score", "trigger_price", "stop_hint", "target_hint")), F.array_join("s.reasons", " ").alias("reasons"))


def _every_row(spark, sf_dir) -> DataFrame:
    """Indicators of every row, with the values before it, as the rules read them."""
    df = I.indicators(C.series_frame(walk_candles(spark, sf_dir)))
    lag = lambda c, n=1: F.lag(c, n).over(Window.partitionBy(*KEY).orderBy("t"))
    return df.withColumns({f"prev_{c}": lag(c) for c in ("close", "low", "high", "ema_20")} | {"ema_50_before": lag("ema_50", 5), "n": F.col("t")}).withColumn("regime", R.regime())


def setups_mean_reversion(spark, sf_dir):
    df = _every_row(spark, sf_dir).where("t >= 25")
    return _setup_columns(df, R.mean_reversion(F.col("regime.label"))).where("direction is not null")


def setups_pullback(spark, sf_dir):
    df = _every_row(spark, sf_dir).where("t >= 25")
    return _setup_columns(df, R.pullback(F.col("regime.label"), F.col("regime.confidence"))).where("direction is not null")


def setups_breakout_given_levels(spark, sf_dir):
    """Levels given: the extremes of the twenty rows before the previous one."""
    before = Window.partitionBy(*KEY).orderBy("t").rowsBetween(-21, -2)
    df = _every_row(spark, sf_dir).withColumns({"support": F.min("close").over(before), "resistance": F.max("close").over(before)}).where("t >= 25")
    return _setup_columns(df, R.breakout(F.col("support"), F.col("resistance"))).where("direction is not null")


def score_breakdown(spark, sf_dir):
    df = _every_row(spark, sf_dir).where("t >= 60")
    df = df.withColumn("s", R.scores(F.col("regime.label"), F.array_compact(F.array(R.mean_reversion(F.col("regime.label"))))))
    return df.select("symbol", "open_time", *(F.col(f"s.{c}_score").alias(f"{c}_score") for c in ("trend", "momentum", "volatility", "setup", "total")))


def analyze_all(spark, sf_dir):
    df = A.analyze(walk_candles(spark, sf_dir))
    near = lambda c: F.get(F.col(c), F.lit(0))["level"]
    return df.select("symbol", F.col("n").cast("long").alias("n"), "close", F.col("regime.label").alias("regime"), F.size("setups").cast("long").alias("n_setups"), F.size("supports").cast("long").alias("n_supports"), F.size("resistances").cast("long").alias("n_resistances"),
                     near("supports").alias("support"), near("resistances").alias("resistance"), F.col("score.trend_score").alias("trend_score"), F.col("score.momentum_score").alias("momentum_score"), F.col("score.volatility_score").alias("volatility_score"), F.col("score.total_score").alias("total_score"), F.round("rsi_14", 6).alias("rsi_14"), F.round("macd_hist", 6).alias("macd_hist"), F.round("adx_14", 6).alias("adx_14"))


def rejected_series(spark, sf_dir):
    return A.rejected(event_candles(spark, sf_dir, "day", "1d").union(event_candles(spark, sf_dir))).select("symbol", "timeframe", "n")


SYMBOLS = (("btc/usdt", "crypto"), ("eurusd", None), ("ETHUSDT", "crypto"), ("BTCUSD", None), ("EURUSD", "crypto"), ("sol-usdc", None), ("ADABTC", None), ("gbp_jpy", None), ("x", None), ("XAUEUR", "forex"), ("QQQQQQ", None), ("BTC/USD/T", None), ("BTC//USDT", None), ("EURUSDT", "forex"), ("/EURUSD", None), ("EUR-USD", "forex"))


def raw_symbols(spark, sf_dir) -> DataFrame:
    """raw and class, once each: for every customer a symbol of two currencies in some writing, and one of SYMBOLS."""
    k = F.col("c_custkey")
    at = lambda values, n: F.get(F.array(*(F.lit(v).cast("string") for v in values)), F.pmod(n, F.lit(len(values))).cast("int"))
    made = F.concat(at(Y.FOREX, k), at(("/", "-", "_", ""), F.floor(k / 8)), at(Y.QUOTES, F.floor(k / 32)))
    customers = table(spark, sf_dir, "customer")
    mixed = customers.select(F.when(k % 2 == 0, made).otherwise(F.lower(made)).alias("raw"), at((None, "crypto", "forex"), k).alias("class"))
    return mixed.union(customers.select(at([x[0] for x in SYMBOLS], k), at([x[1] for x in SYMBOLS], k))).distinct()


def symbol_normalize(spark, sf_dir):
    s = Y.normalize_symbol(F.col("raw"), F.col("class"), strict=False)
    return raw_symbols(spark, sf_dir).withColumn("s", s).select("raw", "class", F.col("s.normalized").alias("normalized"), F.col("s.base").alias("base"), F.col("s.quote").alias("quote"), F.col("s.asset_class").alias("asset_class"), Y.provider_symbol(F.col("s"), F.lit("ccxt")).alias("at_ccxt"))


def timeframe_interval(spark, sf_dir):
    """For every event a timeframe, its minutes and the close of a candle that opens with the event; "2h" is none."""
    names = F.array(*(F.lit(x) for x in (*Y.TIMEFRAMES, "2h")))
    df = table(spark, sf_dir, "events").select("event_id", "ts", F.get(names, F.pmod("event_id", F.lit(len(Y.TIMEFRAMES) + 1)).cast("int")).alias("timeframe"))
    minutes = Y.timeframe_minutes(F.col("timeframe"), strict=False)
    return df.select("event_id", "timeframe", minutes.alias("minutes"), (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0))).alias("close_time"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News candidates made of events."""
    e, k = table(spark, sf_dir, "events"), len(HEADLINES)
    at = lambda values, n: F.get(F.array(*(F.lit(v) for v in values)), F.pmod("event_id", F.lit(n)).cast("int"))
    tickers = F.when(F.pmod("event_id", F.lit(3)) == 0, F.array(F.lit("BTC"))).when(F.pmod("event_id", F.lit(3)) == 1, F.array(F.lit("ETHUSDT"), F.lit("eur"))).otherwise(F.array().cast("array<string>"))
    return e.select(
        F.col("event_id").alias("seq"), F.col("event_type").alias("source_name"), at([h[0] for h in HEADLINES], k).alias("title"), at([h[1] for h in HEADLINES], k).alias("summary"),
        F.concat(F.lit("https://news.example/"), F.pmod("event_id", F.lit(50)).cast("string")).alias("url"), F.col("ts").alias("published_at"), at(LABELS, len(LABELS)).alias("provider_label"),
        F.when(F.pmod("event_id", F.lit(10)) == 1, 0.4).otherwise(F.lit(None)).cast("double").alias("provider_score"), F.when(F.pmod("event_id", F.lit(4)) == 0, F.col("value") / 500).cast("double").alias("provider_importance"), tickers.alias("tickers"),
    )


def news_dedup_key(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("at", F.lit("2024-01-05 06:30:00").cast("timestamp_ntz"))
    return docs.select("doc_id", T.dedup_key(F.col("source"), F.col("text"), F.col("at")).alias("dedup_key"))


def news_batch_dedup(spark, sf_dir):
    return N.first_seen(N.with_keys(candidates(spark, sf_dir))).select("seq", "dedup_key")


def news_sentiment(spark, sf_dir):
    return N.labelled(candidates(spark, sf_dir)).select("seq", "sentiment_label", F.round("sentiment_score", 6).alias("sentiment_score"))


def sentiment_lexicon(spark, sf_dir):
    """The lexicon as a parameter, over documents."""
    docs = table(spark, sf_dir, "documents")
    found = N.labelled(docs, F.col("text"), F.lit(""), F.lit(None).cast("string"), F.lit(None).cast("double"), ("the", "der", "ion"), ("idiot", "scum", "le ", "que"))
    return found.select("doc_id", F.col("sentiment_label").alias("label"), F.round("sentiment_score", 6).alias("score"))


def _assets(spark):
    return schemas.active(schemas.assets(spark))


def news_tagging(spark, sf_dir):
    return N.tags(candidates(spark, sf_dir), _assets(spark))


def _ingested(spark, sf_dir) -> DataFrame:
    return N.ingest(candidates(spark, sf_dir), _assets(spark), F.lit(AS_OF).cast("timestamp"))


def news_importance(spark, sf_dir):
    return _ingested(spark, sf_dir).select("seq", "importance_score")


def news_ingest_counts(spark, sf_dir):
    all_rows, items = candidates(spark, sf_dir), _ingested(spark, sf_dir)
    kept = items.agg(F.count("*").alias("kept"), F.sum(F.size("tags")).cast("long").alias("tagged_links"))
    fetched = all_rows.agg(F.count("*")).scalar()
    return kept.select(fetched.alias("fetched"), (fetched - F.col("kept")).alias("deduplicated"), "tagged_links")


def _deliveries(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    base = event_candles(spark, sf_dir)
    base = base.select(F.col("symbol").alias("asset_id"), F.lit("ccxt").alias("provider_id"), "timeframe", "open_time", *(F.col(c).cast(schemas.PRICE).alias(c) for c in ("open", "high", "low", "close")), F.col("volume").cast(schemas.VOLUME).alias("volume"))
    hour = F.hour("open_time")
    stored = base.where(hour < 18)
    incoming = base.where(hour >= 6).withColumn("close", F.when(F.hour("open_time") == 9, F.col("close") + F.lit(1).cast(schemas.PRICE)).otherwise(F.col("close")).cast(schemas.PRICE))
    return stored, incoming


CANDLE_VALUES = ("open", "high", "low", "close", "volume")


def candle_upsert(spark, sf_dir):
    stored, incoming = _deliveries(spark, sf_dir)
    return U.upsert(stored, incoming, values=CANDLE_VALUES).select("asset_id", "open_time", F.col("close").cast("double").alias("close"), "action")


def candle_upsert_counts(spark, sf_dir):
    stored, incoming = _deliveries(spark, sf_dir)
    return U.counts(U.upsert(stored, incoming, values=CANDLE_VALUES))


def news_upsert_match(spark, sf_dir):
    """All news up to a day are stored, all later ones come in."""
    keyed = N.with_keys(candidates(spark, sf_dir))
    stored = keyed.where(F.col("published_at") < SPLIT).select(F.col("seq").alias("id"), "url", "dedup_key", "source_name")
    return U.match_news(stored, keyed.where(F.col("published_at") >= SPLIT).select("seq", "url", "dedup_key", "source_name")).select("seq", "match_id")


def _foreign(df: DataFrame, prefix: str, of: str) -> DataFrame:
    """A stored table whose ids are no hashes."""
    return df.withColumn("id", F.concat(F.lit(prefix), F.col(of)))


def _news_batch(spark, sf_dir) -> dict[str, DataFrame]:
    """All later news against the items that all earlier ones have left, the last one of every url; the later ones have some urls of their own."""
    everything = candidates(spark, sf_dir)
    last = N.with_keys(everything.where(F.col("published_at") < SPLIT)).groupBy("url").agg(F.max(F.struct("seq", "source_name", "title", "summary", "published_at", "dedup_key")).alias("x"))
    kept = F.concat(F.lit("e-"), F.col("x.seq").cast("string"))
    items = last.select(F.concat(F.lit("item "), F.substring_index("url", "/", -1)).alias("id"), F.lit("p-7").alias("provider_id"), kept.alias("external_id"), "x.source_name", "x.title", "x.summary", "url", F.col("x.published_at").cast("timestamp").alias("published_at"),
                        F.lit(None).cast("string").alias("sentiment_label"), F.lit(None).cast("decimal(5,2)").alias("importance_score"), "x.dedup_key", F.lit("{}").alias("metadata"))
    links = items.select(F.col("id").alias("news_item_id"), F.lit("a-EURUSD").alias("asset_id"), F.lit(0.11).cast("decimal(5,2)").alias("relevance_score"))
    providers = schemas.providers(spark).withColumn("id", F.when(F.col("code") == "alpha_vantage", "p-7").otherwise(F.col("id")))
    stored = {"providers": providers, "assets": _foreign(schemas.assets(spark), "a-", "normalized_symbol"), "news_items": items, "news_asset_links": links}
    later = everything.where(F.col("published_at") >= SPLIT).withColumn("url", F.concat(F.lit("https://news.example/"), F.pmod("seq", F.lit(80)).cast("string")))
    return G.news(later, stored, F.lit(AS_OF).cast("timestamp"))


def news_ingest(spark, sf_dir):
    """The counters of a batch of all later news against the items stored from all earlier ones."""
    return _news_batch(spark, sf_dir)["counters"]


def news_items_upsert(spark, sf_dir):
    """The stored items after that batch, with what their metadata says."""
    of = lambda c: F.get_json_object("metadata", f"$.{c}")
    listed = lambda c: F.array_join(F.from_json(of(c), "array<string>"), ",")
    items = _news_batch(spark, sf_dir)["items"]
    return items.select("id", "provider_id", "external_id", "source_name", "title", "url", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "sentiment_label", F.col("importance_score").cast("double").alias("importance_score"), "dedup_key",
                        of("provider_sentiment_label").alias("label"), of("provider_sentiment_score").cast("double").alias("score"), listed("provider_tickers").alias("tickers"), listed("tagged_assets").alias("tagged"), "action")


def news_links_upsert(spark, sf_dir):
    """The stored links after that batch."""
    return _news_batch(spark, sf_dir)["links"].select("news_item_id", "asset_id", F.col("relevance_score").cast("double").alias("relevance_score"))


def ohlcv_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for the candles of every event type and day, and some that go wrong."""
    symbol = F.when(F.col("symbol") == "click", "btc/usdt").when(F.col("symbol") == "view", "ETHUSDT").when(F.col("symbol") == "error", "SOL-USDC").otherwise(F.concat(F.upper(F.substring("symbol", 1, 3)), F.lit("/USDT")))
    day, hour = F.to_date("open_time"), F.unix_millis(F.col("open_time").cast("timestamp"))
    row = F.concat(F.lit("["), F.concat_ws(",", hour, *(F.round(c, 4).cast("decimal(20,4)") for c in ("open", "high", "low", "close")), F.col("volume")), F.lit("]"))
    sent = event_candles(spark, sf_dir).groupBy(symbol.alias("raw_symbol"), day.alias("day")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(row)), ","), F.lit("]")).alias("payload"))
    good = sent.select(F.concat_ws(" ", "raw_symbol", "day").alias("request_id"), F.lit("ccxt").alias("provider_code"), "raw_symbol", F.lit(None).cast("string").alias("asset_class"), F.lit("1h").alias("timeframe"), F.lit(20).alias("row_limit"), "payload")
    bad = spark.createDataFrame(list(BAD_REQUESTS), "request_id string, provider_code string, raw_symbol string, asset_class string, timeframe string, row_limit int, payload string")
    return good.unionByName(bad)


#: Requests that are rejected, fail, or bring one daily candle.
BAD_REQUESTS = (
    ("bad 1", "ccxt", "x", None, "1h", 10, "[]"), ("bad 2", "ccxt", "BTC/USD/T", None, "1h", 10, "[]"), ("bad 3", "ccxt", "BTCUSDT", "stock", "1h", 10, "[]"), ("bad 4", "ccxt", "BTCUSDT", None, "1h", 0, "[]"),
    ("failed 1", "nobody", "BTCUSDT", None, "1h", 10, "[]"), ("failed 2", "ccxt", "BTCUSDT", None, "2h", 10, "[]"), ("failed 3", "alpha_vantage", "EURUSD", None, "1h", 10, '{"Note": null}'),
    ("failed 4", "alpha_vantage", "EURUSD", None, "1h", 10, '{"Meta Data": {}}'), ("failed 5", "alpha_vantage", "BTCUSDT", None, "1h", 10, "{}"), ("failed 6", "ccxt", "BTCUSDT", None, "1h", 10, "no JSON"),
    ("fine", "alpha_vantage", "EURUSD", None, "1d", 1, '{"Time Series FX (Daily)": {"2025-01-02": {"1. open": "1", "2. high": "2", "3. low": "1", "4. close": "2"}, "2025-01-01": {"1. open": "1", "2. high": "3", "3. low": "1", "4. close": "2"}}}'),
)


def _ohlcv_batch(spark, sf_dir, requests: DataFrame | None = None) -> dict[str, DataFrame]:
    """Half of the hours are stored before, some with another close; the stored assets' and provider's ids are no hashes, and candles have a quality."""
    requests = ohlcv_requests(spark, sf_dir) if requests is None else requests
    before = event_candles(spark, sf_dir).where(F.hour("open_time") < 12)
    raw = F.when(F.col("symbol") == "click", "BTCUSDT").when(F.col("symbol") == "view", "ETHUSDT").when(F.col("symbol") == "error", "SOLUSDC").otherwise(F.concat(F.upper(F.substring("symbol", 1, 3)), F.lit("USDT")))
    at, price = F.col("open_time").cast("timestamp"), lambda c: F.round(c, 4).cast(schemas.PRICE)
    close = F.when(F.hour("open_time") == 3, price("close") + F.lit(1).cast(schemas.PRICE)).otherwise(price("close")).cast(schemas.PRICE)
    asset = F.when(raw.isin("BTCUSDT", "ETHUSDT"), F.concat(F.lit("a-"), raw)).otherwise(F.sha2(raw, 256))
    candles = before.select(asset.alias("asset_id"), F.lit("p-1").alias("provider_id"), "timeframe", at.alias("open_time"), Y.close_time(at, F.col("timeframe")).alias("close_time"), *(price(c).alias(c) for c in ("open", "high", "low")), close.alias("close"), F.col("volume").cast(schemas.VOLUME).alias("volume"),
                            F.lit(None).cast(schemas.VOLUME).alias("quote_volume"), F.lit(None).cast("int").alias("trade_count"), F.hour("open_time").cast("decimal(5,2)").alias("quality_score"))
    stored = {"providers": schemas.providers(spark).withColumn("id", F.when(F.col("code") == "ccxt", "p-1").otherwise(F.col("id"))), "assets": _foreign(schemas.assets(spark), "a-", "normalized_symbol"), "asset_provider_symbols": spark.createDataFrame([], schemas.SCHEMAS["asset_provider_symbols"]), "candles": candles}
    return G.ohlcv(requests, stored, F.lit(AS_OF).cast("timestamp"))


def _requests_and_runs(out: dict[str, DataFrame]) -> DataFrame:
    of = lambda c: F.get_json_object("details", f"$.{c}")
    runs = out["runs"].select("request_id", "status", of("symbol").alias("symbol"), *(of(f"{c}_count").cast("long").alias(c) for c in ("fetched", "inserted", "updated")), of("error").alias("error"))
    return runs.unionByName(out["rejected"].withColumn("status", F.lit("rejected")), allowMissingColumns=True)


def ohlcv_ingest(spark, sf_dir):
    """A row per request: whether it was rejected, failed or brought candles, and how many."""
    return _requests_and_runs(_ohlcv_batch(spark, sf_dir))


def landed(spark: SparkSession, sf_dir: str) -> str:
    """The folder where the same requests land by provider and day."""
    requests, path = ohlcv_requests(spark, sf_dir), shared_folder(spark)
    day = F.coalesce(F.to_date(F.try_to_timestamp(F.substring_index("request_id", " ", -1))), F.lit("2025-01-01").cast("date"))
    landing.land(requests.withColumn("day", day), path)
    return path


def ohlcv_landed(spark, sf_dir):
    """ohlcv_ingest from a landing zone: what one provider sent from a day on, and all that the other did."""
    path = landed(spark, sf_dir)
    asked = landing.payloads(spark, path, provider="ccxt", since=SPLIT[:10]).unionByName(landing.payloads(spark, path, provider="alpha_vantage"))
    return _requests_and_runs(_ohlcv_batch(spark, sf_dir, asked.drop("day", "file", "at", "since")))


def ohlcv_candles(spark, sf_dir):
    """The stored candles after that batch, with the symbols of their assets."""
    out = _ohlcv_batch(spark, sf_dir)
    named = out["candles"].join(out["assets"].select(F.col("id").alias("asset_id"), "normalized_symbol"), "asset_id").join(out["providers"].select(F.col("id").alias("provider_id"), "code"), "provider_id")
    return named.select("asset_id", "normalized_symbol", "code", "timeframe", F.col("open_time").cast("timestamp_ntz").alias("open_time"), *(F.col(c).cast("double").alias(c) for c in ("open", "close", "volume", "quality_score")), "action")


def provider_mappings(spark, sf_dir):
    """What that batch maps assets to: the symbol that a provider knows them by, once each."""
    return _ohlcv_batch(spark, sf_dir)["asset_provider_symbols"]


def insert_if_absent(spark, sf_dir):
    """The assets of customers' symbols that the stored ones lack."""
    named = raw_symbols(spark, sf_dir).select(Y.normalize_symbol(F.col("raw"), F.col("class"), strict=False).alias("s")).where("s is not null")
    return U.absent(schemas.assets(spark), U.asset_rows(named, "s"), ("normalized_symbol",)).select("normalized_symbol", "display_symbol", "name")


def link_upsert(spark, sf_dir):
    tagged = N.tags(candidates(spark, sf_dir), _assets(spark)).select(F.col("seq").alias("news_item_id"), F.col("symbol").alias("asset_id"), F.col("relevance").alias("relevance_score"))
    stored = tagged.where("news_item_id % 3 <> 0").withColumn("relevance_score", F.lit(0.1))
    return U.upsert_links(stored, tagged.where("news_item_id % 3 <> 1"))


def asset_listing(spark, sf_dir):
    """The active assets after that batch of candles."""
    return schemas.active(_ohlcv_batch(spark, sf_dir)["assets"]).select("id", "normalized_symbol", "display_symbol", "name", "base_currency", "quote_currency", "asset_class", "is_active")


def _changes(spark, sf_dir) -> DataFrame:
    symbol = F.when(F.col("symbol") == "click", "BTCUSDT").when(F.col("symbol") == "view", "ETHUSDT").when(F.col("symbol") == "error", "EURUSD").otherwise(F.col("symbol"))
    return C.price_change(event_candles(spark, sf_dir).withColumn("symbol", symbol))


def price_change_30(spark, sf_dir):
    return C.price_change(event_candles(spark, sf_dir)).select("symbol", F.round("change_pct", 4).alias("change_pct"))


def _news(spark, sf_dir) -> DataFrame:
    return _ingested(spark, sf_dir).withColumnRenamed("seq", "id")


def contradiction_signals(spark, sf_dir):
    return N.signals(_news(spark, sf_dir), _changes(spark, sf_dir))


def _feed(spark, sf_dir, limit: int | None = 20, symbol: str | None = None):
    return N.feed(_news(spark, sf_dir), _changes(spark, sf_dir), F.lit(AS_OF).cast("timestamp_ntz"), 72, limit, symbol)


def _flat_feed(df: DataFrame) -> DataFrame:
    said = F.transform("contradiction_signals", lambda s: F.concat_ws(":", s["asset_symbol"], s["is_contradiction"].cast("string")))
    return df.select("id", "published_at", "sentiment_label", "importance_score", F.array_join("asset_symbols", ",").alias("asset_symbols"), F.array_join(said, ",").alias("signals"))


def news_feed(spark, sf_dir):
    return _flat_feed(_feed(spark, sf_dir))


def news_feed_symbol(spark, sf_dir):
    return _flat_feed(_feed(spark, sf_dir, 50, "EURUSD"))


def _theses(spark, sf_dir):
    names = F.when(F.col("symbol") == "click", "BTCUSDT").when(F.col("symbol") == "view", "ETHUSDT").when(F.col("symbol") == "error", "EURUSD").otherwise(F.col("symbol"))
    analysis = A.analyze(walk_candles(spark, sf_dir).withColumn("symbol", names))
    newest = N.newest_of_symbols(_news(spark, sf_dir), F.lit(AS_OF).cast("timestamp_ntz"))
    return H.theses(analysis, H.news_counts(newest, _changes(spark, sf_dir)))


def thesis_confidence(spark, sf_dir):
    return _theses(spark, sf_dir).select("symbol", "direction", "setup_type", F.col("confidence.label").alias("label"), F.col("confidence.score").alias("score"), F.size("supporting_factors").cast("long").alias("n_for"), F.size("contradictory_factors").cast("long").alias("n_against"))


def thesis_invalidation(spark, sf_dir):
    return _theses(spark, sf_dir).select("symbol", F.round("invalidation.level", 6).alias("level"), F.col("invalidation.condition").alias("condition"))


def thesis_text(spark, sf_dir):
    return _theses(spark, sf_dir).select("symbol", "timeframe", F.array_join("supporting_factors", " | ").alias("supporting"), F.array_join("contradictory_factors", " | ").alias("contradicting"), "summary", "disclaimer")


def _headlines(spark, sf_dir) -> DataFrame:
    return candidates(spark, sf_dir).select("seq", F.col("source_name").alias("symbol"), "published_at")


def headline_returns(spark, sf_dir):
    """Every headline with the last candle that had closed by then and the first that opens a day later or after, and the change between them."""
    c = event_candles(spark, sf_dir).withColumn("close_time", Y.close_time(F.col("open_time"), F.col("timeframe")))
    met = J.asof(_headlines(spark, sf_dir), c.select("symbol", "close_time", "close"), ("symbol",), "published_at", "close_time", name="before")
    met = met.withColumn("later", F.col("published_at") + F.expr("INTERVAL 1 DAY"))
    met = J.asof(met, c.select("symbol", "open_time", "open"), ("symbol",), "later", "open_time", name="after", forward=True)
    change = (F.col("after.open") - F.col("before.close")) / F.nullif(F.col("before.close"), F.lit(0.0)) * 100
    return met.select("seq", "symbol", F.col("before.close_time").alias("closed_at"), F.col("after.open_time").alias("opened_at"), F.round(change, 6).alias("change_pct"))


def headline_windows(spark, sf_dir):
    """The candles of a headline's symbol that open within six hours of it: how many, their extremes and volume."""
    h = _headlines(spark, sf_dir).select("seq", "symbol", *((F.col("published_at") + F.expr(f"INTERVAL {n} HOUR")).alias(c) for n, c in ((-6, "first"), (6, "last"))))
    c = event_candles(spark, sf_dir).select("symbol", "open_time", "high", "low", "volume")
    met = J.meeting(h, c, ("symbol",), "first", "last", "open_time", seconds=6 * 3600)
    return met.groupBy("seq", "symbol").agg(F.count("*").alias("candles"), F.round(F.max("high"), 6).alias("highest"), F.round(F.min("low"), 6).alias("lowest"), F.sum("volume").alias("volume"))


def news_sessions(spark, sf_dir):
    """Bursts of headlines of a source, whose gap is ten minutes for one of them and half an hour for the others."""
    gap = F.when(F.col("source_name") == "click", 600).otherwise(1800)
    found = sessions(N.labelled(candidates(spark, sf_dir)), gap, "source_name", "published_at", "seq")
    return found.withColumn("net_sentiment", F.round("net_sentiment", 6))


def candle_cascade(spark, sf_dir):
    """Four-hour and daily candles from hourly ones, with gaps filled."""
    out = S.filled(S.cascade(event_candles(spark, sf_dir)))
    return rounded(out, "open", "high", "low", "close").select("symbol", "timeframe", "open_time", "open", "high", "low", "close", "volume", "candles", "filled")


def timeframe_trends(spark, sf_dir):
    """For every symbol the trends of three timeframes, and whether they agree."""
    hourly = walk_candles(spark, sf_dir)
    coarse = S.cascade(hourly).select(*hourly.columns)
    of = lambda n: F.try_element_at("trends", F.lit(n))
    return S.trends(hourly.unionByName(coarse)).select("symbol", of("1h").alias("trend_1h"), of("4h").alias("trend_4h"), of("1d").alias("trend_1d"), "alignment")


def drawdown_episodes(spark, sf_dir):
    found = S.drawdowns(walk_candles(spark, sf_dir), seconds=3 * J.DAY)
    return rounded(found, "peak", "trough", "depth_pct").drop("timeframe")


def structure_breaks(spark, sf_dir):
    """Every row's structure as it was known then."""
    out = S.structure(C.series_frame(walk_candles(spark, sf_dir)))
    return out.select("symbol", "open_time", "last_high", "last_low", "state", "event", "reversal")


def volatility_ranks(spark, sf_dir):
    """The rank of every row's volatility among the last 250."""
    frame = I.strength(I.movements(_frame(spark, sf_dir))).withColumn("atr_pct", F.round("atr_pct", 9))
    return S.volatility_regime(frame).select("symbol", F.col("t").cast("long").alias("t"), "atr_pct", F.round("rank_pct", 6).alias("rank_pct"), "volatility")


def score_bands(spark, sf_dir):
    """The bands of scores over the last half of the month, from stored sketches of its days; so few rows are kept whole by the sketches, and bands are exact."""
    path, scores = shared_folder(spark), score_breakdown(spark, sf_dir)
    K.daily(scores, ("total_score", "trend_score"), key=("symbol",)).write.partitionBy("day").parquet(path)
    days = spark.read.parquet(path)
    out = K.bands(K.span(days, F.lit(SPLIT).cast("date"), F.lit(AS_OF).cast("date"), ("symbol",)), key=("symbol",))
    return out.select("symbol", "n", *(F.round(F.get(c, F.lit(k)), 2).alias(f"{c}_p{p}") for c in ("total_score", "trend_score") for k, p in enumerate((10, 50, 90))))


def sketch_errors(spark, sf_dir):
    """Merged sketches of the days of all events against the events themselves: whether ranks and distinct users are within their bounds."""
    events = table(spark, sf_dir, "events")
    days, shares = K.daily(events, ("value",), ("user_id",), ("event_type",), "ts", k=200), (0.05, 0.25, 0.5, 0.75, 0.95)
    merged = K.bands(K.span(days, F.lit("2000-01-01").cast("date"), F.lit("2100-01-01").cast("date"), ("event_type",)), shares, ("event_type",))
    each = merged.select("event_type", "n", "distinct_user_id", F.posexplode("value").alias("k", "q"))
    both = events.select("event_type", "value", "user_id").join(each, "event_type")
    below = both.groupBy("event_type", "k").agg(F.any_value("n").alias("n"), F.any_value("distinct_user_id").alias("estimate"), F.count_if(F.col("value") < F.col("q")).alias("less"), F.count_if(F.col("value") <= F.col("q")).alias("upto"), F.count_distinct("user_id").alias("users"))
    share, error = F.get(F.array(*(F.lit(p) for p in shares)), "k"), F.lit(K.rank_error(200))
    near = (F.col("less") / F.col("n") - error <= share) & (F.col("upto") / F.col("n") + error >= share)
    return below.select("event_type", share.alias("share"), "n", near.alias("rank_within"), "users", (F.abs(F.col("estimate") - F.col("users")) <= F.lit(K.distinct_error()) * F.col("users")).alias("distinct_within"))


def payload_paths(spark, sf_dir):
    """The payloads of events by path; of every tenth the end is missing."""
    text = F.when(F.pmod("event_id", F.lit(10)) == 3, F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.concat(F.lit('{"type":"'), F.col("event_type"), F.lit('","props":'), F.col("props"), F.lit(',"tags":["a",'), F.col("user_id").cast("string"), F.lit("]}")))
    df = V.parsed(table(spark, sf_dir, "events").select("event_id", text.alias("text")), "text")
    return V.at_paths(df, {"kind": ("$.type", "string"), "k": ("$.props.k", "int"), "user_id": ("$.tags[1]", "long"), "odd": ("$.tags[0]", "long"), "nothing": ("$.no.where", "string")}).drop("text", "payload")


def payload_damage(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_type", F.when(F.pmod("event_id", F.lit(7)) == 1, F.lit(None)).when(F.pmod("event_id", F.lit(10)) == 3, F.expr("substr(props, 1, length(props) - 1)")).otherwise(F.col("props")).alias("text"))
    return V.damage(V.parsed(df, "text"), "text", key=("event_type",))


def exchange_payloads(spark, sf_dir):
    rows = F.concat(F.lit("[["), F.concat_ws(",", F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), F.lit("1.5"), F.lit("2"), F.lit("1"), F.col("event_id").cast("string"), F.lit("null")), F.lit("],[1,2]]"))
    df = table(spark, sf_dir, "events").select("event_id", F.lit("1h").alias("timeframe"), rows.alias("rows"))
    out = parsers.exchange_rows(df)
    return out.select("event_id", F.col("open_time").cast("timestamp_ntz").alias("open_time"), F.col("close_time").cast("timestamp_ntz").alias("close_time"), F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume"))


def stream_hourly(spark, sf_dir):
    """Candles by the streaming plan, run here over the table as a batch: its windows and aggregates are the same."""
    ticks = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.col("event_id").alias("id"))
    out = stream_candles(ticks)
    return out.select("symbol", F.col("open_time").cast("timestamp_ntz").alias("open_time"), *(F.round(c, 6).alias(c) for c in ("open", "high", "low", "close")), "volume")


ALL = (
    candle_resample, candles_latest_n, candles_joined_dims, sma_volume_sma, bollinger, true_range, directional_movement, ema_20_50_200, macd, atr_rsi, adx, swing_points, support_resistance, trend_regime,
    setups_mean_reversion, setups_pullback, setups_breakout_given_levels, score_breakdown, analyze_all, rejected_series, symbol_normalize, timeframe_interval, news_dedup_key, news_batch_dedup, news_sentiment,
    sentiment_lexicon, news_tagging, news_importance, news_ingest_counts, candle_upsert, candle_upsert_counts, news_upsert_match, news_ingest, news_items_upsert, news_links_upsert, ohlcv_ingest, ohlcv_landed, ohlcv_candles, provider_mappings, insert_if_absent, link_upsert, asset_listing, price_change_30, contradiction_signals,
    news_feed, news_feed_symbol, thesis_confidence, thesis_invalidation, thesis_text, headline_returns, headline_windows, news_sessions, candle_cascade, timeframe_trends, drawdown_episodes, structure_breaks, volatility_ranks, score_bands, sketch_errors, payload_paths, payload_damage, exchange_payloads, stream_hourly,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in ALL}
