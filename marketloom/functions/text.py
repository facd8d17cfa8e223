"""Text rules of headlines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import clamp, squeeze

# Sentiment terms.
POSITIVE = ("bullish", "surge", "rally", "breakout", "upgrade", "beats", "optimistic", "growth", "gain")
NEGATIVE = ("bearish", "selloff", "drop", "downgrade", "misses", "lawsuit", "fraud", "risk", "loss")


def plain(text: Column) -> Column:
    """Trimmed, lower case, single spaces, then only a-z, 0-9 and space: "a - b" keeps two spaces."""
    return F.regexp_replace(squeeze(F.lower(text)), "[^a-z0-9 ]", "")


def dedup_key(source: Column, title: Column, published_at: Column) -> Column:
    """32 hex digits over source, title and UTC hour."""
    return F.substring(F.sha2(F.concat_ws("|", plain(source), plain(title), F.date_format(published_at, "yyyyMMddHH")), 256), 1, 32)


def headline_text(title: Column, summary: Column) -> Column:
    return F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit("")))


def hits(text: Column, terms) -> Column:
    """How many of the terms a plain text contains, inside words too."""
    return sum((F.contains(text, F.lit(t)).cast("int") for t in terms), F.lit(0))


def sentiment(up: Column, down: Column, label: Column, score: Column) -> Column:
    """STRUCT(label, score): the provider's label if there is one, else the share of positive less negative hits.

    A provider score of null or 0 gives +-0.25 or 0. The hits are columns, so that texts are gone through once and not for every case."""
    own = (up - down).cast("double") / F.greatest(up + down, F.lit(1))
    low = F.lower(F.coalesce(label, F.lit("")))
    given = lambda default: F.coalesce(F.nullif(score, F.lit(0.0)), F.lit(default))
    pair = lambda name, value: F.struct(F.lit(name).alias("label"), value.cast("double").alias("score"))
    return (
        F.when(low.contains("bull") | low.contains("positive"), pair("positive", given(0.25)))
        .when(low.contains("bear") | low.contains("negative"), pair("negative", given(-0.25)))
        .when(low != "", pair("neutral", given(0.0)))
        .when(own >= 0.2, pair("positive", own)).when(own <= -0.2, pair("negative", own)).otherwise(pair("neutral", own))
    )


def tag_text(title: Column, summary: Column) -> Column:
    return F.regexp_replace(squeeze(F.upper(headline_text(title, summary))), "[^A-Z0-9/]", " ")


#: How much a headline is about an asset, by what of the asset it has: kinds of keys and their relevance. A pair takes the greatest.
RULES = (("ticker", "symbol", 0.95), ("inside", "symbol", 0.9), ("inside", "compact", 0.9), ("ticker", "base", 0.82), ("word", "display", 0.8), ("word", "base", 0.6))


def asset_keys(symbol: Column, base: Column, display: Column) -> Column:
    """ARRAY(STRUCT(kind, key, relevance)) of an asset, in upper case."""
    of = {"symbol": symbol, "base": base, "display": display, "compact": F.replace(display, F.lit("/"), F.lit(""))}
    every = F.array(*(F.struct(F.lit(kind).alias("kind"), F.upper(of[part]).alias("key"), F.lit(score).alias("relevance")) for kind, part, score in RULES))
    return F.filter(every, lambda x: x["key"].isNotNull() & (x["key"] != ""))


def headline_keys(text: Column, tickers: Column, lengths: Column) -> Column:
    """ARRAY(STRUCT(kind, key)), once each, of a tag text: its tickers; its words, and words joined by slashes; the parts of ``lengths`` letters and digits inside words.

    Symbols consist of letters and digits, so one that stands inside a text stands inside a word of it."""
    pair = lambda kind, x: F.struct(F.lit(kind).alias("kind"), x.alias("key"))
    runs = F.filter(F.split(text, " +"), lambda x: x != "")
    joined = lambda parts: F.flatten(F.transform(parts, lambda _, i: F.transform(F.sequence(i + 1, F.size(parts)), lambda j: F.array_join(F.slice(parts, i + 1, j - i), "/"))))
    words = F.flatten(F.transform(runs, lambda r: joined(F.split(r, "/"))))
    every = F.flatten(F.transform(runs, lambda r: F.split(r, "/")))
    inside = F.flatten(F.flatten(F.transform(every, lambda w: F.transform(F.filter(lengths, lambda n: n <= F.length(w)), lambda n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda k: F.substring(w, k, n))))))
    given = F.transform(F.coalesce(tickers, F.array().cast("array<string>")), F.upper)
    return F.array_distinct(F.concat(F.transform(given, lambda x: pair("ticker", x)), F.transform(words, lambda x: pair("word", x)), F.transform(inside, lambda x: pair("inside", x))))


def importance(age_hours: Column, score: Column, most_relevant: Column, provider: Column) -> Column:
    """0 to 100 from age, sentiment, relevance and the provider's own importance (8 points without one)."""
    fresh = F.greatest(F.lit(0.0), 25.0 - F.greatest(age_hours, F.lit(0.0)) * 1.1)
    own = F.when(provider.isNull(), 8.0).otherwise(clamp(provider, 0, 1) * 20.0)
    return F.round(clamp(20.0 + fresh + F.least(F.abs(score) * 30.0, F.lit(25.0)) + F.least(F.coalesce(most_relevant, F.lit(0.0)) * 25.0, F.lit(25.0)) + own, 0, 100), 2)


def contradicts(label: Column, change_pct: Column) -> Column:
    return F.coalesce(((label == "positive") & (change_pct <= -1.0)) | ((label == "negative") & (change_pct >= 1.0)), F.lit(False))
