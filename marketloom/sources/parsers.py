"""Provider payloads to rows. Payloads are read from a landing zone as JSON text, one per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import in_range, number
from ..functions.symbols import base_currencies, close_time
from .schemas import PRICE, VOLUME

#: Keys of a payload that tell of a failure, and the minutes of the intraday routes.
FAILURES = ("Error Message", "Information", "Note")
INTRADAY = {"1m": "1min", "5m": "5min", "15m": "15min", "30m": "30min", "1h": "60min"}


def exchange_rows(payloads: DataFrame, rows: str = "rows", timeframe: str = "timeframe", limit: Column | None = None, since: Column | None = None) -> DataFrame:
    """Candles from arrays [epoch ms, open, high, low, close, volume]; rows of under six fields are skipped, a null volume stays null.

    ``since`` (null: no bound) leaves out what opens before it, then ``limit`` keeps the first rows of each payload."""
    parsed = F.from_json(rows, "array<array<double>>")
    if since is not None:
        parsed = F.filter(parsed, lambda r: since.isNull() | (F.get(r, F.lit(0)) >= F.unix_millis(since)))
    each = payloads.withColumn("r", F.explode(parsed if limit is None else F.slice(parsed, F.lit(1), limit))).where(F.size("r") >= 6)
    at = F.timestamp_millis(F.col("r")[0].cast("long"))
    each = each.withColumn("open_time", at).withColumn("close_time", close_time(F.col("open_time"), F.col(timeframe)))
    fields = {n: F.col("r")[k].cast(PRICE if k < 5 else VOLUME) for k, n in enumerate(("open", "high", "low", "close", "volume"), 1)}
    return each.withColumns(fields).drop("r", rows)


def failure(payload: Column) -> Column:
    """What the provider says if the payload has the key of a failure, whatever its value, else null."""
    fields = F.from_json(payload, "map<string,string>")
    said = [F.when(F.array_contains(F.map_keys(fields), k), F.concat(F.lit(f"{k}: "), F.coalesce(fields[k], F.lit("null")))) for k in FAILURES]
    return F.coalesce(*said)


def checked(payload: Column, other: Column | None = None) -> Column:
    """The payload. One that tells of a failure raises an error, and so does one for which ``other`` has a message."""
    wrong = failure(payload) if other is None else F.coalesce(failure(payload), other)
    return F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(payload)


def route(asset_class: Column, timeframe: Column, strict: bool = True) -> Column:
    """The provider function of a request: forex daily or intraday, crypto daily; anything else raises an error if strict, else gives null."""
    other = F.raise_error(F.concat(F.lit("no route for "), asset_class, F.lit(" "), timeframe)) if strict else F.lit(None)
    return (
        F.when((asset_class == "forex") & (timeframe == "1d"), "FX_DAILY").when((asset_class == "forex") & timeframe.isin(*INTRADAY), "FX_INTRADAY")
        .when((asset_class == "crypto") & (timeframe == "1d"), "DIGITAL_CURRENCY_DAILY").otherwise(other)
    )


def series_time(text: Column) -> Column:
    return F.when(F.length(text) == 10, F.to_timestamp(text, "yyyy-MM-dd")).otherwise(F.to_timestamp(text, "yyyy-MM-dd HH:mm:ss"))


def no_series(payload: Column) -> Column:
    """A message if the payload has no time series, else null."""
    names = F.filter(F.map_keys(F.from_json(payload, "map<string,string>")), lambda k: F.lower(k).startswith("time series"))
    return F.when(F.coalesce(F.size(names), F.lit(0)) < 1, F.lit("no time series in the payload"))


def time_series(payloads: DataFrame, payload: str = "payload", timeframe: str = "timeframe", limit: Column | int | None = None) -> DataFrame:
    """Candles from the object under the first key that starts with "time series", a row per timestamp. A payload that tells of a failure raises.

    Fields are found as "1. open", "1a. open", "open", or any key that contains the name; volume may be missing. ``limit`` keeps the earliest rows of each payload."""
    named = F.map_filter(F.from_json(checked(F.col(payload)), "map<string,string>"), lambda k, _: F.lower(k).startswith("time series"))
    series = F.from_json(F.map_values(named)[0], "map<string,map<string,string>>")
    entries = F.transform(F.array_sort(F.map_keys(series)), lambda k: F.struct(k.alias("key"), series[k].alias("value")))
    each = payloads.withColumn("e", F.explode(entries if limit is None else F.slice(entries, F.lit(1), F.lit(limit) if isinstance(limit, int) else limit)))

    def field(name: str, k: int) -> Column:
        m = F.transform_keys(F.col("e")["value"], lambda key, _: F.lower(key))
        near = F.map_values(F.map_filter(m, lambda key, _: key.contains(name)))
        return F.coalesce(m[f"{k}. {name}"], m[f"{k}a. {name}"], m[name], F.get(near, F.lit(0)))

    opened = each.withColumn("open_time", series_time(F.col("e")["key"]))
    opened = opened.withColumn("close_time", close_time(F.col("open_time"), F.col(timeframe)))
    fields = {n: number(field(n, k)).cast(PRICE if k < 5 else VOLUME) for k, n in enumerate(("open", "high", "low", "close", "volume"), 1)}
    return opened.withColumns(fields).drop("e", payload)


def published_time(text: Column, as_of: Column) -> Column:
    """yyyyMMddTHHmmss, else yyyyMMdd, else as_of."""
    t = F.trim(text)
    return F.coalesce(F.try_to_timestamp(F.substring(t, 1, 15), F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(F.substring(t, 1, 8), F.lit("yyyyMMdd")), as_of)


def no_feed(payload: Column) -> Column:
    """A message if the payload has no array of news, else null."""
    return F.when(~F.coalesce(F.get_json_object(payload, "$.feed"), F.lit("")).startswith("["), F.lit("no feed array in the payload"))


def news_feed(payloads: DataFrame, as_of: Column, payload: str = "payload", limit: int | None = None, symbols: Column | None = None, asset_class: Column | None = None) -> DataFrame:
    """News candidates from the array under "feed", with raw_payload, the item's JSON: trimmed, blank titles and non-objects skipped, empty id and label null, source "unknown" by default.

    A payload that tells of a failure or has no such array raises an error. ``symbols``, an array of raw symbols (null or empty: no filter), keeps items with a ticker that is,
    or of which the part behind a colon is, the base currency of one of them. Of the items that are left, ``limit`` (1 to 200) keeps the first ones of each payload."""
    item = "struct<id:string,title:string,summary:string,url:string,source:string,time_published:string,overall_sentiment_score:string,overall_sentiment_label:string,ticker_sentiment:string>"
    good = checked(F.col(payload), no_feed(F.col(payload)))
    items = F.transform(F.from_json(F.get_json_object(good, "$.feed"), "array<string>"), lambda t: F.struct(t.alias("text"), F.from_json(t, item).alias("i")))
    items = F.filter(items, lambda x: F.trim(x["i"]["title"]) != "")
    if symbols is not None:
        wanted = base_currencies(symbols, asset_class)
        told = lambda x: F.transform(F.coalesce(F.from_json(x["i"]["ticker_sentiment"], "array<string>"), F.array().cast("array<string>")), lambda t: F.substring_index(F.upper(F.trim(F.get_json_object(t, "$.ticker"))), ":", -1))
        items = F.filter(items, lambda x: wanted.isNull() | (F.size(wanted) == 0) | F.coalesce(F.arrays_overlap(told(x), wanted), F.lit(False)))
    if limit is not None:
        items = F.slice(items, 1, in_range("limit", limit, 1, 200))
    each = payloads.select(F.posexplode(items).alias("seq", "x")).select("seq", "x.text", "x.i")
    named = F.transform(F.from_json("i.ticker_sentiment", "array<string>"), lambda t: F.upper(F.trim(F.get_json_object(t, "$.ticker"))))
    tickers = F.filter(F.coalesce(named, F.array().cast("array<string>")), lambda x: x != "")
    blank = lambda c: F.nullif(F.trim(f"i.{c}"), F.lit(""))
    return each.select(
        "seq", blank("id").alias("external_id"), F.coalesce(blank("source"), F.lit("unknown")).alias("source_name"), F.trim("i.title").alias("title"), F.coalesce(F.trim("i.summary"), F.lit("")).alias("summary"),
        F.coalesce(F.trim("i.url"), F.lit("")).alias("url"), published_time(F.col("i.time_published"), as_of).alias("published_at"), number(F.col("i.overall_sentiment_score")).alias("provider_score"),
        blank("overall_sentiment_label").alias("provider_label"), F.lit(None).cast("double").alias("provider_importance"), tickers.alias("tickers"), F.col("text").alias("raw_payload"),
    )
