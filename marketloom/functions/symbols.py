"""Symbols and timeframes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import once

# Currencies that make a pair forex, and quote currencies of compact crypto symbols in the order they are tried.
FOREX = ("USD", "EUR", "GBP", "JPY", "CHF", "CAD", "AUD", "NZD")
QUOTES = ("USDT", "USDC", "USD", "BTC", "ETH", "EUR", "GBP", "JPY")
# Timeframes and their minutes.
TIMEFRAMES = {"1m": 1, "5m": 5, "15m": 15, "30m": 30, "1h": 60, "4h": 240, "1d": 1440}


def normalize_symbol(raw: Column, asset_class: Column | None = None, strict: bool = True) -> Column:
    """STRUCT(raw, normalized, base, quote, asset_class, display).

    A symbol with one of / - _ must be two parts around it and is split there, parts as they are; else six letters of two forex currencies are
    cut in half, and so is any symbol of class forex, which must have six; else the first quote currency that ends it is cut off. Without a class, forex quotes make it forex.
    Symbols under six letters or digits, or that can't be split so, raise an error if strict, else give null."""
    read = F.struct(raw.alias("raw"), F.upper(F.regexp_replace(raw, "[^A-Za-z0-9]", "")).alias("clean"), F.split(F.upper(raw), "[/_-]").alias("parts"), (F.lit(None).cast("string") if asset_class is None else asset_class).alias("class"))
    return once(read, lambda x: once(_split(x), lambda s: _symbol(s, strict)))


def _split(x: Column) -> Column:
    """STRUCT(raw, base, quote, class): base and quote are null where the symbol can't be split."""
    clean, parts, none = x["clean"], x["parts"], F.lit(None).cast("string")
    delimited, named, six = F.size(parts) > 1, F.coalesce(x["class"] == "forex", F.lit(False)), F.length(clean) == 6
    split = (F.size(parts) == 2) & (parts[0] != "") & (F.element_at(parts, -1) != "")
    pair = six & (named | clean.substr(1, 3).isin(*FOREX) & clean.substr(4, 3).isin(*FOREX))
    base = F.when(F.length(clean) < 6, none).when(split, parts[0]).when(delimited, none).when(pair, clean.substr(1, 3)).when(named, none)
    quote = F.when(F.length(clean) < 6, none).when(split, F.element_at(parts, -1)).when(delimited, none).when(pair, clean.substr(4, 3)).when(named, none)
    for q in QUOTES:
        ends = clean.endswith(q) & (F.length(clean) > len(q))
        base, quote = base.when(ends, F.substring(clean, F.lit(1), F.length(clean) - len(q))), quote.when(ends, F.lit(q))
    return F.struct(x["raw"].alias("raw"), base.alias("base"), quote.alias("quote"), x["class"].alias("class"))


def _symbol(s: Column, strict: bool) -> Column:
    base, quote = s["base"], s["quote"]
    kind = F.coalesce(s["class"], F.when(quote.isin(*FOREX), "forex").otherwise("crypto"))
    out = F.struct(s["raw"].alias("raw"), F.concat(base, quote).alias("normalized"), base.alias("base"), quote.alias("quote"), kind.alias("asset_class"), F.concat_ws("/", base, quote).alias("display"))
    return F.when(quote.isNotNull(), out).otherwise(F.raise_error(F.concat(F.lit("not a symbol: "), F.coalesce(s["raw"], F.lit("null")))) if strict else F.lit(None))


def provider_symbol(symbol: Column, provider: Column, strict: bool = True) -> Column:
    """The form that a provider takes: BASE/QUOTE for ccxt, compact for alpha_vantage. Other providers raise an error if strict, else give null."""
    other = F.raise_error(F.concat(F.lit("not a provider: "), provider)) if strict else F.lit(None)
    return F.when(provider == "ccxt", symbol["display"]).when(provider == "alpha_vantage", symbol["normalized"]).otherwise(other)


def provider_name(code: Column) -> Column:
    """The name shown for a provider's code: its own, or the code in upper case."""
    return F.when(code == "ccxt", "CCXT").when(code == "alpha_vantage", "Alpha Vantage").otherwise(F.upper(code))


def base_currencies(symbols: Column, asset_class: Column | None = None) -> Column:
    """The base currencies of an array of raw symbols, once each, sorted: what a news source is asked for."""
    return F.array_sort(F.array_distinct(F.transform(symbols, lambda s: normalize_symbol(s, asset_class)["base"])))


def timeframe_minutes(timeframe: Column, strict: bool = True) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, minutes in TIMEFRAMES.items():
        out = out.when(timeframe == name, F.lit(minutes))
    return out.otherwise(F.raise_error(F.concat(F.lit("not a timeframe: "), timeframe)) if strict else F.lit(None).cast("int"))


def close_time(open_time: Column, timeframe: Column) -> Column:
    return open_time + F.make_dt_interval(F.lit(0), F.lit(0), timeframe_minutes(timeframe), F.lit(0))
