"""A trade thesis from an analysis and what the news say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contradicts
from .rules import LOOSE, RANGES

# The texts of a thesis are part of its contract.
DISCLAIMER = "Informational only. This thesis is a probabilistic interpretation of historical data and current context, not financial advice."


def _say(template: str, *values: Column) -> Column:
    return F.format_string(template, *values)


def primary_setup(setups: Column) -> Column:
    """The triggered setup of the highest score, the first in order if several; null if there is none."""
    score = lambda s: s["score"]
    live = F.filter(setups, lambda s: s["triggered"])
    among = F.when(F.size(live) > 0, live).otherwise(setups)
    return F.get(F.filter(among, lambda s: s["score"] == F.array_max(F.transform(among, score))), F.lit(0))


def direction(setup: Column, label: Column) -> Column:
    return F.coalesce(setup["direction"], F.when(label == "bull_trend", "bullish").when(label == "bear_trend", "bearish").otherwise("neutral"))


def news_counts(newest: DataFrame, changes: DataFrame, item_id: str = "id") -> DataFrame:
    """symbol, positive, negative, labelled and contradictions over each symbol's newest items (news.newest_of_symbols) and all their tags."""
    tag = newest.select("symbol", item_id, "sentiment_label", F.posexplode("tags.symbol").alias("_at", "_other"))
    each = tag.join(changes.withColumnRenamed("symbol", "_other"), "_other", "left").withColumn("_label", F.when(F.col("_at") == 0, F.col("sentiment_label")))
    label, against = F.col("_label"), contradicts(F.col("sentiment_label"), F.col("change_pct"))
    return each.groupBy("symbol").agg(F.count_if(label == "positive").alias("positive"), F.count_if(label == "negative").alias("negative"), F.count_if(label.isNotNull()).alias("labelled"), F.count_if(against).alias("contradictions"))


def supporting(way: Column, setup: Column) -> Column:
    label, up, down = F.col("regime.label"), way == "bullish", way == "bearish"
    e20, e50, e200 = F.col("ema_20"), F.col("ema_50"), F.col("ema_200")
    pos, neg = F.col("positive"), F.col("negative")
    news = (
        F.when(F.coalesce("labelled", F.lit(0)) == 0, F.lit(None).cast("string"))
        .when(up & (pos > neg), _say("Recent news sentiment leans positive (%d positive vs %d negative items).", pos, neg))
        .when(down & (neg > pos), _say("Recent news sentiment leans negative (%d negative vs %d positive items).", neg, pos))
        .otherwise(_say("Recent news sentiment is mixed (%d positive, %d negative).", pos, neg))
    )
    lines = F.array(
        F.when(up & (label == "bull_trend"), _say("Trend regime is bullish with confidence %.2f.", F.col("regime.confidence"))).when(down & (label == "bear_trend"), _say("Trend regime is bearish with confidence %.2f.", F.col("regime.confidence"))).when(label.isin(*RANGES), "Range regime supports selective mean-reversion setups."),
        F.when(up & (e20 > e50) & (e50 > e200), "EMA alignment (20 > 50 > 200) supports upside structure.").when(down & (e20 < e50) & (e50 < e200), "EMA alignment (20 < 50 < 200) supports downside structure."),
        F.when(F.col("rsi_14").isNotNull(), _say("RSI(14) at %.2f is incorporated into momentum context.", F.col("rsi_14"))),
        F.when(F.col("macd_hist").isNotNull(), _say("MACD histogram currently %.4f.", F.col("macd_hist"))),
        news,
    )
    first = F.coalesce(F.slice(setup["reasons"], 1, 2), F.array().cast("array<string>"))
    return F.slice(F.array_compact(F.concat(first, lines)), 1, 6)


def contradicting(way: Column, setup: Column) -> Column:
    label, rsi = F.col("regime.label"), F.col("rsi_14")
    other = F.get(F.filter("setups", lambda s: s["triggered"] & (s["direction"] != way) & ~s["setup_type"].eqNullSafe(setup["setup_type"])), F.lit(0))
    lines = F.array(
        F.when(label.isin(*LOOSE), _say("Regime is %s, which can weaken directional follow-through.", label)),
        F.when(other.isNotNull(), _say("Opposing %s setup is also triggered (%s).", other["setup_type"], other["direction"])),
        F.when((way == "bullish") & (rsi >= 70), "RSI is in overbought territory, raising pullback risk.").when((way == "bearish") & (rsi <= 30), "RSI is in oversold territory, raising squeeze risk."),
        F.when(F.col("contradictions") > 0, _say("%d recent news items show sentiment/price contradiction signals.", F.col("contradictions"))),
        F.when((way == "bullish") & (F.col("negative") > 0), _say("%d negative news item(s) oppose the bullish thesis.", F.col("negative"))).when((way == "bearish") & (F.col("positive") > 0), _say("%d positive news item(s) oppose the bearish thesis.", F.col("positive"))),
    )
    return F.slice(F.array_compact(lines), 1, 6)


def invalidation(way: Column, setup: Column, supports: Column, resistances: Column) -> Column:
    """STRUCT(level, condition): the setup's stop, else the nearest level on the losing side, else both sides, else nothing."""
    support, resistance, stop = F.get(supports, F.lit(0))["level"], F.get(resistances, F.lit(0))["level"], setup["stop_hint"]
    side = F.when(way == "bullish", "below").when(way == "bearish", "above").otherwise("beyond")
    out = lambda level, condition: F.struct(level.alias("level"), condition.alias("condition"))
    none = F.lit(None).cast("double")
    return (
        F.when(stop.isNotNull(), out(F.round(stop, 8), _say("Invalidate if price closes %s %.6f.", side, stop)))
        .when((way == "bullish") & support.isNotNull(), out(support, _say("Invalidate if price loses support near %.6f.", support)))
        .when((way == "bearish") & resistance.isNotNull(), out(resistance, _say("Invalidate if price reclaims resistance near %.6f.", resistance)))
        .when(support.isNotNull() & resistance.isNotNull(), out(none, _say("No directional thesis until price breaks above %.6f or below %.6f.", resistance, support)))
        .otherwise(out(none, F.lit("Insufficient structure for a precise invalidation level.")))
    )


def confidence(total: Column, setup_score: Column, against: Column, label: Column) -> Column:
    """STRUCT(label, score, explanation) from the rounded total, the primary setup's score (or null), the number of contradicting factors and the regime."""
    base = F.coalesce(0.7 * total + 0.3 * setup_score, total)
    penalty = against * 6.0 + F.when(label.isin(*LOOSE), 6.0).otherwise(0.0) + F.when(label == "insufficient_data", 18.0).otherwise(0.0)
    score = F.greatest(F.lit(10.0), F.least(base - penalty, F.lit(84.0)))
    name = F.when(score < 45, "low").when(score < 70, "medium").otherwise("high")
    text = _say("Confidence is %s (%.1f/100) based on deterministic technical and context signals; %d contradiction factor(s) reduce certainty.", name, score, against)
    return F.struct(name.alias("label"), F.round(score, 2).alias("score"), text.alias("explanation"))


def theses(analysis: DataFrame, counts: DataFrame) -> DataFrame:
    """A row per series: direction, primary setup, factors for and against, invalidation, confidence, summary. Series without news have none for or against."""
    df = analysis.join(counts, "symbol", "left").withColumn("primary", primary_setup(F.col("setups")))
    df = df.withColumn("direction", direction(F.col("primary"), F.col("regime.label")))
    df = df.withColumns({"supporting_factors": supporting(F.col("direction"), F.col("primary")), "contradictory_factors": contradicting(F.col("direction"), F.col("primary")), "invalidation": invalidation(F.col("direction"), F.col("primary"), F.col("supports"), F.col("resistances"))})
    against = F.size("contradictory_factors")
    df = df.withColumn("confidence", confidence(F.col("score.total_score"), F.col("primary.score"), against, F.col("regime.label")))
    summary = _say("%s %s: %s thesis from %s with %s confidence. View this as a conditional scenario, not a prediction, and monitor %d opposing signal(s).", F.col("symbol"), F.col("timeframe"), F.col("direction"), F.coalesce("primary.setup_type", F.lit("no clear setup")), F.col("confidence.label"), against)
    return df.select("symbol", "timeframe", "direction", F.coalesce("primary.setup_type", F.lit("none")).alias("setup_type"), "supporting_factors", "contradictory_factors", "invalidation", "confidence", summary.alias("summary"), F.lit(DISCLAIMER).alias("disclaimer"))


def document(theses: DataFrame, generated_at: Column) -> DataFrame:
    """symbol, timeframe and the thesis as JSON, with the time it was made."""
    whole = F.struct(*theses.columns, F.date_format(generated_at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at"))
    return theses.select("symbol", "timeframe", F.to_json(whole, {"ignoreNullFields": "false"}).alias("document"))
