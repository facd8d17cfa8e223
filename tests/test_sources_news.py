"""Parsers, news rules, upserts, the thesis rules and the streaming plan."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketloom.functions import symbols as Y
from marketloom.functions import text as T
from marketloom.operators import news as N
from marketloom.operators import thesis as H
from marketloom.operators import upsert as U
from marketloom.sources import parsers, resilience, schemas


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_symbols(spark):
    s = one(spark, a=Y.normalize_symbol(F.lit("btc/usdt"), F.lit("crypto")), b=Y.normalize_symbol(F.lit("BTCUSD")), c=Y.normalize_symbol(F.lit("x"), strict=False))
    assert (s.a.normalized, s.a.base, s.b.asset_class, s.c) == ("BTCUSDT", "BTC", "forex", None)
    bad = [("x", None), ("BTC/USD/T", None), ("BTC//USDT", None), ("/EURUSD", None), ("EURUSDT", "forex"), ("QQQQQQ", None), (None, None)]
    df = spark.createDataFrame(bad, "raw string, class string")
    assert df.where(Y.normalize_symbol(F.col("raw"), F.col("class"), strict=False).isNotNull()).count() == 0
    for raw, kind in bad:
        with pytest.raises(Exception, match="not a symbol"):
            df.where(F.col("raw").eqNullSafe(raw) & F.col("class").eqNullSafe(kind)).select(Y.normalize_symbol(F.col("raw"), F.col("class"))).collect()
    six = one(spark, a=Y.normalize_symbol(F.lit("xaueur"), F.lit("forex")))
    assert (six.a.base, six.a.quote, six.a.asset_class) == ("XAU", "EUR", "forex")
    with pytest.raises(Exception, match="not a provider"):
        one(spark, a=Y.provider_symbol(Y.normalize_symbol(F.lit("BTCUSDT")), F.lit("nobody")))
    names = one(spark, a=Y.provider_name(F.lit("ccxt")), b=Y.provider_name(F.lit("other")), c=Y.base_currencies(F.array(F.lit("eth/usdt"), F.lit("BTCUSDT"), F.lit("BTC-USD"))))
    assert (names.a, names.b, names.c) == ("CCXT", "OTHER", ["BTC", "ETH"])


def test_exchange_rows(spark):
    df = spark.createDataFrame([("1h", "[[1735689600000,1,2,0.5,1.5,null],[1735693200000,1,2,0.5,1.7,9],[1]]"), ("1h", None)], "timeframe string, rows string")
    got = parsers.exchange_rows(df).orderBy("open_time").collect()
    assert [float(r.close) for r in got] == [1.5, 1.7] and got[0].volume is None
    assert got[0].close_time - got[0].open_time == dt.timedelta(hours=1)


def test_time_series(spark):
    text = '{"Meta Data": {"a": "b"}, "Time Series FX (60min)": {"2025-01-01 01:00:00": {"1. open": "1.12", "2. high": "1.13", "3. low": "1.11", "4. close": "1.118"}, "2025-01-01 00:00:00": {"1. open": "1.1", "2. high": "1.2", "3. low": "1.0", "4. close": "1.15"}}}'
    df = spark.createDataFrame([("1h", text)], "timeframe string, payload string")
    got = parsers.time_series(df).collect()
    assert [float(r.open) for r in got] == [1.1, 1.12] and got[1].volume is None and float(got[1].close) == 1.118
    assert parsers.time_series(df, limit=1).count() == 1
    with pytest.raises(Exception, match="slow down"):
        parsers.time_series(df.withColumn("payload", F.lit('{"Note": "slow down"}'))).collect()
    with pytest.raises(Exception, match="Information: null"):
        parsers.time_series(df.withColumn("payload", F.lit('{"Information": null}'))).collect()
    assert one(spark, a=parsers.route(F.lit("forex"), F.lit("5m")), b=parsers.route(F.lit("crypto"), F.lit("1d")), c=parsers.route(F.lit("crypto"), F.lit("5m"), strict=False))[:3] == ("FX_INTRADAY", "DIGITAL_CURRENCY_DAILY", None)
    with pytest.raises(Exception, match="no route for crypto 5m"):
        one(spark, a=parsers.route(F.lit("crypto"), F.concat(F.lit("5"), F.lit("m"))))


def test_news_feed_payload(spark):
    text = '{"feed": [{"title": " A ", "source": "", "time_published": "20250101T101500", "overall_sentiment_score": "x", "ticker_sentiment": [7, {"ticker": " btc "}, {"ticker": ""}, "x", {"a": 1}]}, {"title": " "}, 5, {"title": "B", "time_published": "bad"}]}'
    df = spark.createDataFrame([(text,)], "payload string")
    got = parsers.news_feed(df, F.lit("2025-02-01 00:00:00").cast("timestamp")).orderBy("seq").collect()
    assert [(r.title, r.source_name, r.tickers) for r in got] == [("A", "unknown", ["BTC"]), ("B", "unknown", [])]
    assert got[0].published_at == dt.datetime(2025, 1, 1, 10, 15) and got[1].published_at == dt.datetime(2025, 2, 1) and got[0].provider_score is None
    assert '"title":" A "' in got[0].raw_payload.replace(": ", ":")
    assert [r.title for r in parsers.news_feed(df, F.lit("2025-02-01 00:00:00").cast("timestamp"), limit=1).collect()] == ["A"]
    for bad, said in (('{"Note": "slow down"}', "slow down"), ('{"Note": null}', "Note"), ("{}", "no feed array"), ('{"feed": {"a": 1}}', "no feed array"), ("no JSON", "no feed array")):
        with pytest.raises(Exception, match=said):
            parsers.news_feed(df.withColumn("payload", F.lit(bad)), F.current_timestamp()).collect()
    with pytest.raises(ValueError):
        parsers.news_feed(df, F.current_timestamp(), limit=201)


def test_text_rules(spark):
    at = F.lit("2025-01-01 10:00:00").cast("timestamp")
    r = one(spark, a=T.dedup_key(F.lit("S"), F.lit(" BTC  up!"), at), b=T.dedup_key(F.lit("s"), F.lit("btc up"), at), i=T.importance(F.lit(4.0), F.lit(-0.4), F.lit(0.7), F.lit(0.6)), old=T.importance(F.lit(99.0), F.lit(0.0), F.lit(None).cast("double"), F.lit(None).cast("double")))
    assert r.a == r.b and r.i == 82.1 and r.old == 28.0
    said = [(1, "bullish breakout", "growth against", None, None), (2, "x", None, "Bearish", 0.0), (3, "a rally, a drop", "", "", None), (4, None, None, "Neutral", 0.3), (5, "x", "y", "somewhat positive", None)]
    got = N.labelled(spark.createDataFrame(said, "seq int, title string, summary string, provider_label string, provider_score double")).orderBy("seq").collect()
    assert [(x.sentiment_label, x.sentiment_score) for x in got] == [("positive", 1.0), ("negative", -0.25), ("neutral", 0.0), ("neutral", 0.3), ("positive", 0.25)]
    pairs = [("positive", -1.2, True), ("negative", 1.3, True), ("positive", 2.1, False), ("neutral", -5.0, False), (None, 3.0, False)]
    df = spark.createDataFrame(pairs, "label string, change double, want boolean")
    assert df.where(T.contradicts(F.col("label"), F.col("change")) != F.col("want")).count() == 0


def test_upserts(spark):
    key, values = ("k",), ("v",)
    stored = spark.createDataFrame([(1, "a"), (2, "b"), (4, None)], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c"), (4, None)], "k int, v string")
    got = {r.k: (r.v, r.action) for r in U.upsert(stored, new, key, values).collect()}
    assert got == {1: ("a", "kept"), 2: ("B", "update"), 3: ("c", "insert"), 4: (None, "same")}
    doubled = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (None, "n", 3), (None, "m", 4), (5, None, 5)], "k int, v string, seq int")
    got = {r.k: (r.v, r.action) for r in U.upsert(stored.union(spark.createDataFrame([(None, "old")], "k int, v string")), doubled, key, values, "seq").collect()}
    assert got == {1: ("c", "update"), 2: ("b", "kept"), 4: (None, "kept"), 5: (None, "insert"), None: ("m", "update")}
    assert {(r.k, r.v) for r in U.absent(stored, doubled.select("k", "v").where("k is not null"), key).collect()} == {(5, None)}
    assert U.absent(stored.select("k"), doubled.select("k"), key).count() == 2
    again = U.upsert(U.upsert(stored, new, key, values).drop("action"), new, key, values)
    assert U.counts(again).first().asDict() == {"inserted": 0, "updated": 0}


def test_news_upsert(spark):
    cols = "id string, url string, dedup_key string, source_name string, title string"
    stored = spark.createDataFrame([("1", "u1", "k1", "s", "old")], cols)
    new = spark.createDataFrame([(1, "u1", "k9", "t", "by url"), (2, "u2", "k1", "s", "by key"), (3, "", "k3", "s", "new"), (4, "u5", "k4", "s", "also new")], "seq int, url string, dedup_key string, source_name string, title string")
    got = {r.title: (r.action, r.source_name) for r in U.upsert_news(stored, new).collect()}
    assert got == {"by key": ("update", "s"), "new": ("insert", "s"), "also new": ("insert", "s")}


def test_match_against_a_whole_stored_side(spark):
    """1,000 stored items on few urls and keys: the least match, and each side of the OR joined with one row a url or key."""
    of = lambda ids: [(i, f"u{i % 3}" if i % 2 else f"v{i}", f"k{i % 5}", "s" if i % 4 else "r") for i in ids]
    stored, incoming = of(range(1000)), of(range(1000, 1400))
    a = spark.createDataFrame(stored, "id long, url string, dedup_key string, source_name string")
    b = spark.createDataFrame(incoming, "seq long, url string, dedup_key string, source_name string")
    found = U.match_news(a, b)
    want = {r[0]: min((s[0] for s in stored if s[1] == r[1] or s[2:] == r[2:]), default=None) for r in incoming}
    assert {r.seq: r.match_id for r in found.collect()} == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [url" in plan and "Aggregate [dedup_key" in plan


def test_thesis_confidence(spark):
    c = one(spark, c=H.confidence(F.lit(72.6), F.lit(78.5), F.lit(2), F.lit("bull_trend"))).c
    assert (c.label, c.score) == ("medium", 62.37)


def relevance(title, summary, tickers, symbol, base, display):
    """The five rules asked one by one."""
    text = re.sub("[^A-Z0-9/]", " ", re.sub(r"\s+", " ", f"{title} {summary}".upper()))
    given, score = {t.upper() for t in tickers}, 0.0
    for test, value in ((symbol in given, 0.95), (base in given, 0.82), (symbol in text or display.replace("/", "") in text, 0.9), (re.search(rf"\b{re.escape(base)}\b", text), 0.6), (re.search(rf"\b{re.escape(display)}\b", text), 0.8)):
        score = max(score, value if test else 0.0)
    return score


def test_tags_against_every_pair(spark):
    assets = [("BTCUSDT", "BTC", "BTC/USDT"), ("ETHUSDT", "ETH", "ETH/USDT"), ("EURUSD", "EUR", "EUR/USD"), ("AB", "A", "A/B"), ("1INCHUSDT", "1INCH", "1INCH/USDT")]
    words, rng = ["BTC", "btc/usdt", "xBTCUSDTx", "eth", "ETH/USDT/X", "eur/usd", "EURUSD.", "a/b", "A", "ab", "1inch", "the", "BTC-USDT", "//", "EUR /USD", "usdt"], random.Random(7)
    news = [(i, " ".join(rng.choices(words, k=rng.randint(0, 4))), " ".join(rng.choices(words, k=2)), rng.choices(["BTC", "ethusdt", "EUR", "x"], k=rng.randint(0, 2))) for i in range(300)]
    a = spark.createDataFrame(assets, "normalized_symbol string, base_currency string, display_symbol string")
    b = spark.createDataFrame(news, "seq int, title string, summary string, tickers array<string>")
    want = {(i, s): r for i, t, u, k in news for s, base, d in assets if (r := relevance(t, u, k, s, base, d)) >= 0.35}
    found = N.tags(b, a)
    assert {(r.seq, r.symbol): r.relevance for r in found.collect()} == want
    tagged = {r.seq: [(x.symbol, x.relevance) for x in r.tags] for r in N.with_tags(b, found).collect()}
    assert len(tagged) == 300 and all(v == sorted(((s, r) for (j, s), r in want.items() if j == i), key=lambda x: (-x[1], x[0])) for i, v in tagged.items())
    assert N.tags(b, a.limit(0)).count() == 0


def test_tags_never_broadcast_the_headlines(spark, tmp_path):
    """The file of the headlines is small, their exploded keys aren't. A registry of unknown size is shuffled, one of a known small size is broadcast."""
    news = [(i, "BTC/USDT and EURUSD", "the eth", [None, "btc"]) for i in range(50)]
    spark.createDataFrame(news, "seq int, title string, summary string, tickers array<string>").write.parquet(str(tmp_path / "news"))
    read, seeds = spark.read.parquet(str(tmp_path / "news")), schemas.assets(spark)
    unknown = spark.createDataFrame(seeds.collect(), seeds.schema)
    plans = [N.tags(read, registry)._jdf.queryExecution().executedPlan().toString() for registry in (unknown, seeds)]
    assert "BroadcastHashJoin" not in plans[0]
    assert "LeftOuter, BuildRight" in plans[1] and "BuildLeft" not in plans[1]
    found = [{tuple(r) for r in N.tags(read, registry).collect()} for registry in (unknown, seeds)]
    assert found[0] == found[1] == {(i, s, r) for i in range(50) for s, r in (("BTCUSDT", 0.82), ("EURUSD", 0.9), ("ETHUSDT", 0.6))}


def test_feed(spark):
    items = spark.createDataFrame([(1, dt.datetime(2025, 1, 1), "positive", None, None, []), (2, dt.datetime(2025, 1, 1, 1), "negative", "s", "u", [(0.9, "B"), (0.8, "A")])], "id int, published_at timestamp_ntz, sentiment_label string, summary string, url string, tags array<struct<relevance:double,symbol:string>>")
    changes = spark.createDataFrame([("A", 2.0)], "symbol string, change_pct double")
    as_of = F.lit("2025-01-02 00:00:00").cast("timestamp_ntz")
    rows = {r.id: r for r in N.feed(items, changes, as_of).collect()}
    assert rows[1].asset_symbols == [] and rows[1].contradiction_signals == [] and rows[1].summary == ""
    assert rows[2].asset_symbols == ["A", "B"] and [tuple(x) for x in rows[2].contradiction_signals] == [("A", 2.0, True)]
    assert [r.id for r in N.feed(items, changes, as_of, limit=1).collect()] == [2] and N.feed(items, changes, as_of, 1).count() == 0
    links = N.links(items, "id")
    again = {r.id: r for r in N.feed(items.drop("tags"), changes, as_of, symbol="B", stored_links=links).collect()}
    assert list(again) == [2] and again[2].contradiction_signals == rows[2].contradiction_signals
    with pytest.raises(ValueError):
        N.feed(items, changes, as_of, 721)


def test_thesis_counts_the_newest_items_of_a_symbol(spark):
    day = dt.datetime(2025, 1, 1)
    rows = [(i, day + dt.timedelta(minutes=i), "positive" if i < 30 else "negative", [(0.9, "A"), (0.8, "B")] if i % 2 else [(0.9, "A")]) for i in range(40)]
    items = spark.createDataFrame(rows, "id int, published_at timestamp_ntz, sentiment_label string, tags array<struct<relevance:double,symbol:string>>")
    changes = spark.createDataFrame([("A", 3.0), ("B", -3.0)], "symbol string, change_pct double")
    got = {r.symbol: r for r in H.news_counts(N.newest_of_symbols(items, F.lit("2025-01-02 00:00:00").cast("timestamp_ntz")), changes).collect()}
    assert (got["A"].positive, got["A"].negative, got["A"].labelled) == (10, 10, 20) and (got["B"].positive, got["B"].negative) == (15, 5)
    assert got["A"].contradictions == 10 + 5  # ten falling items against A's rise, five rising ones against B's fall
    theses = spark.createDataFrame([("A", "1h", None)], "symbol string, timeframe string, setup_type string")
    assert '"setup_type":null' in H.document(theses, F.lit("2025-01-02 00:00:00").cast("timestamp")).first().document


def test_ohlcv_tables(spark):
    from marketloom.plans import ingest as G

    rows = [("r1", "ccxt", "btc/usdt", None, "1h", 2, "[[0,1,2,1,2,5],[3600000,2,3,2,3,null],[7200000,3,3,3,3,1]]"), ("r2", "ccxt", "BTCUSDT", None, "1h", 9, "[[0,1,2,1,9,5]]"), ("r3", "other", "BTCUSDT", None, "1h", 9, "[]")]
    requests = spark.createDataFrame(rows, "request_id string, provider_code string, raw_symbol string, asset_class string, timeframe string, row_limit int, payload string")
    empty = lambda t: spark.createDataFrame([], schemas.SCHEMAS[t])
    stored = {"providers": schemas.providers(spark), "assets": schemas.assets(spark).limit(0), "asset_provider_symbols": empty("asset_provider_symbols"), "candles": empty("candles")}
    out = G.ohlcv(requests, stored, F.lit("2025-01-01 00:00:00").cast("timestamp"))
    candles = sorted((r.open_time.timestamp(), float(r.close), r.action, r.request_id) for r in out["candles"].collect())
    assert candles == [(0.0, 9.0, "insert", "r2"), (3600.0, 3.0, "insert", "r1")]  # the third is beyond the limit, the last delivery of the first wins
    assert sorted((r.request_id, r.status) for r in out["runs"].collect()) == [("r1", "success"), ("r2", "success"), ("r3", "failed")]
    assert [(r.normalized_symbol, r.name, r.asset_class) for r in out["assets"].collect()] == [("BTCUSDT", "BTC / USDT", "crypto")]
    assert [(r.provider_symbol, r.is_primary) for r in out["asset_provider_symbols"].collect()] == [("BTC/USDT", True)]
    assert sorted((r.code, r.name) for r in out["providers"].collect()) == [("alpha_vantage", "Alpha Vantage"), ("ccxt", "CCXT"), ("other", "OTHER")]
    again = G.ohlcv(requests, stored | {"candles": out["candles"].drop("request_id", "action")}, F.lit("2025-01-01 00:00:00").cast("timestamp"))
    assert U.counts(again["candles"]).first().asDict() == {"inserted": 0, "updated": 0} and again["candles"].where("action = 'same'").count() == 2


def empty(spark, table):
    return spark.createDataFrame([], schemas.SCHEMAS[table])


CANDIDATE = "seq long, source_name string, title string, summary string, url string, published_at timestamp_ntz, provider_label string, provider_score double, provider_importance double, tickers array<string>"


def test_news_tables(spark):
    """Into the engine's own tables, with ids that are no hashes."""
    from marketloom.plans import ingest as G

    at = dt.datetime(2025, 1, 1)
    rows = [(1, "s", "BTC rally", "", "u1", at, None, None, None, ["BTC"]), (2, "s", "btc  RALLY!", "again", "u9", at, None, None, None, []), (3, "s", "ETH drop", "", "u1", at, "Bearish", -0.4, None, []), (4, "s", "Old news", "", "u0", at, None, None, None, ["EURUSD"])]
    candidates = spark.createDataFrame(rows, CANDIDATE).withColumn("external_id", F.concat(F.lit("x"), "seq"))
    items = spark.createDataFrame([("7", "p-old", "e", "first", "t", None, "u0", at, None, None, "k", "{}"), ("8", "p-old", "e8", "s", "t", None, "u8", at, "neutral", None, "k8", '{"a":1}')], schemas.SCHEMAS["news_items"])
    links = spark.createDataFrame([("7", "gone")], "news_item_id string, asset_id string").withColumn("relevance_score", F.lit(0.5).cast("decimal(5,2)"))
    assets = schemas.assets(spark).withColumns({"is_active": F.col("base_currency") != "ETH", "id": F.concat(F.lit("uuid-"), "normalized_symbol")})
    stored = {"providers": schemas.providers(spark).where("code = 'ccxt'"), "assets": assets, "news_items": items, "news_asset_links": links}
    out = G.news(candidates, stored, F.lit("2025-01-01 01:00:00").cast("timestamp"))
    assert out["counters"].first().asDict() == {"fetched": 4, "deduplicated": 1, "inserted": 1, "updated": 2, "tagged_links": 2}
    assert out["items"].columns == [*items.columns, "action"] and out["items"].drop("action").dtypes == items.dtypes
    made = {r.code: (r.id, r.category) for r in out["providers"].collect()}
    assert made["alpha_vantage"][1] == "news_context" and len(made) == 2
    found = {r.url: r for r in out["items"].collect()}
    assert (found["u0"].id, found["u0"].action, found["u0"].source_name, found["u0"].title, found["u0"].external_id) == ("7", "update", "first", "Old news", "x4") and (found["u1"].action, found["u1"].title) == ("insert", "ETH drop")
    assert found["u0"].provider_id == found["u1"].provider_id == made["alpha_vantage"][0]
    assert json.loads(found["u1"].metadata) == {"provider_sentiment_score": -0.4, "provider_sentiment_label": "Bearish", "provider_tickers": [], "tagged_assets": []} and json.loads(found["u0"].metadata)["tagged_assets"] == ["EURUSD"]
    assert (found["u8"].provider_id, found["u8"].external_id, found["u8"].metadata, found["u8"].action) == ("p-old", "e8", '{"a":1}', "kept")
    assert sorted((r.asset_id, float(r.relevance_score)) for r in out["links"].collect()) == [("gone", 0.5), ("uuid-BTCUSDT", 0.82), ("uuid-EURUSD", 0.95)]
    again = G.news(candidates, {"providers": out["providers"], "assets": assets, "news_items": out["items"].drop("action"), "news_asset_links": out["links"]}, F.lit("2025-01-01 01:00:00").cast("timestamp"))
    assert again["counters"].first().inserted == 0 and again["providers"].count() == 2 and again["items"].count() == 3
    none = G.news(candidates.limit(0), {**stored, "news_items": empty(spark, "news_items"), "news_asset_links": empty(spark, "news_asset_links")}, F.lit("2025-01-01 01:00:00").cast("timestamp"))
    assert none["items"].count() == none["links"].count() == 0 and none["counters"].first().fetched == 0


def test_ohlcv_keeps_ids_and_columns(spark):
    """A stored asset and provider keep their ids, candles and mapping are filed under them, other stored columns stay."""
    from marketloom.plans import ingest as G

    requests = spark.createDataFrame([("r1", "ccxt", "btc/usdt", None, "1h", 9, "[[0,1,2,1,9,5],[3600000,2,3,2,3,1]]", None), ("r2", "ccxt", "ETHUSDT", None, "1h", 1, "[[0,1,2,1,2,5],[3600000,2,3,2,3,1],[7200000,3,3,3,3,1]]", dt.datetime(1970, 1, 1, 1))],
                                     "request_id string, provider_code string, raw_symbol string, asset_class string, timeframe string, row_limit int, payload string, since timestamp")
    assets = schemas.assets(spark).where("base_currency = 'BTC'").withColumn("id", F.lit("uuid-BTC"))
    providers = schemas.providers(spark).withColumn("id", F.concat(F.lit("uuid-"), "code"))
    t = dt.datetime(1970, 1, 1)
    candles = empty(spark, "candles").unionByName(spark.createDataFrame([("uuid-BTC", "uuid-ccxt", "1h", t, t, 4.5), ("other", "uuid-ccxt", "1h", t, t, 1.5)], "asset_id string, provider_id string, timeframe string, open_time timestamp, close_time timestamp, quality_score double").withColumn("quality_score", F.col("quality_score").cast("decimal(5,2)")), allowMissingColumns=True)
    out = G.ohlcv(requests, {"providers": providers, "assets": assets, "asset_provider_symbols": empty(spark, "asset_provider_symbols"), "candles": candles}, F.lit("2025-01-01 00:00:00").cast("timestamp"), F.lit("2025-01-01 00:00:02").cast("timestamp"))
    ids = {r.normalized_symbol: r.id for r in out["assets"].collect()}
    assert ids["BTCUSDT"] == "uuid-BTC" and set(ids) == {"BTCUSDT", "ETHUSDT"}
    got = sorted((r.asset_id, r.open_time.hour, r.action, None if r.quality_score is None else float(r.quality_score)) for r in out["candles"].collect())
    assert got == sorted([("uuid-BTC", 0, "update", 4.5), ("uuid-BTC", 1, "insert", None), ("other", 0, "kept", 1.5), (ids["ETHUSDT"], 1, "insert", None)])  # since leaves out the first hour, the limit the third
    assert {r.provider_id for r in out["candles"].collect()} == {"uuid-ccxt"} == {r.provider_id for r in out["runs"].collect()}
    assert sorted((r.asset_id, r.provider_id) for r in out["asset_provider_symbols"].collect()) == sorted([("uuid-BTC", "uuid-ccxt"), (ids["ETHUSDT"], "uuid-ccxt")])
    assert {json.loads(r.details)["duration_ms"] for r in out["runs"].collect()} == {2000}
    assert set(out["candles"].columns) == {*candles.columns, "request_id", "action"}
    with pytest.raises(ValueError):
        U.upsert(candles.withColumn("request_id", F.lit("x")), out["candles"], carry=("request_id",))


def test_news_request_filters(spark):
    from marketloom.plans import ingest as G

    item = lambda n, *t: {"title": f"n{n}", "url": f"u{n}", "time_published": "20250101T000000", "ticker_sentiment": [{"ticker": x} for x in t]}
    payload = json.dumps({"feed": [item(1, "CRYPTO:BTC"), item(2, "FOREX:EUR", "AAPL"), item(3), item(4, "btc"), item(5, "BTCX")]})
    df, as_of = spark.createDataFrame([(payload,)], "payload string"), F.lit("2025-01-02 00:00:00").cast("timestamp")
    titles = lambda symbols, **k: [r.title for r in parsers.news_feed(df, as_of, symbols=symbols, **k).collect()]
    assert titles(F.array(F.lit("btc/usdt"))) == ["n1", "n4"] and titles(F.array(F.lit("BTCUSDT"), F.lit("eurusd"))) == ["n1", "n2", "n4"] and titles(F.array(F.lit("BTCUSDT")), limit=1) == ["n1"]
    assert titles(None) == titles(F.array().cast("array<string>")) == titles(F.lit(None).cast("array<string>")) == ["n1", "n2", "n3", "n4", "n5"]
    items = spark.createDataFrame([(1, dt.datetime(2025, 1, 1), "positive", None, None, [(0.9, "EURUSD")])], "id int, published_at timestamp, sentiment_label string, summary string, url string, tags array<struct<relevance:double,symbol:string>>")
    changes = spark.createDataFrame([], "symbol string, change_pct double")
    assert G.read_feed(items, changes, as_of, symbol="eur/usd", asset_class="forex").count() == G.read_feed(items, changes, as_of).count() == 1 and G.read_feed(items, changes, as_of, symbol="btc-usdt").count() == 0
    with pytest.raises(ValueError):
        G.read_feed(items, changes, as_of, asset_class="stock")


def test_read_candles(spark):
    from marketloom.plans import ingest as G

    df = spark.createDataFrame([("BTCUSDT", "1h", dt.datetime(2025, 1, 1, h)) for h in range(5)] + [("BTCUSDT", "1d", dt.datetime(2025, 1, 1))], "symbol string, timeframe string, open_time timestamp_ntz")
    assert sorted(r.open_time.hour for r in G.read_candles(df, "btc/usdt", "1h", 2).collect()) == [3, 4]
    for bad in (dict(limit=0), dict(limit=1001), dict(asset_class="stock")):
        with pytest.raises(ValueError):
            G.read_candles(df, "btc/usdt", "1h", **bad)


def test_resilience():
    now = [0.0]
    cache = resilience.TtlCache(lambda: now[0])
    cache.put("a", 1, 5)
    assert cache.get("a") == 1
    now[0] = 5
    assert cache.get("a") is None
    calls = iter([ValueError(), ValueError(), 7])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert resilience.retry(call, 3, sleep=lambda s: None) == 7
    window = resilience.SlidingWindow(10, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(3):
        window.acquire("p", 2)
    assert now[0] == 15
    count = []
    caller = resilience.Caller(resilience.TtlCache(), window)
    assert [caller.run("p", "k", lambda: count.append(1) or 3) for _ in range(2)] == [3, 3] and len(count) == 1
    assert resilience.Registry({"b": 1, "a": 2}).codes() == ["a", "b"]


def test_stream(spark, tmp_path):
    from marketloom.streaming.candles import into_store, read_store, stream_candles

    rows = [("A", dt.datetime(2025, 1, 1, h, m), float(h * 60 + m), h * 60 + m) for h in range(5) for m in (0, 20, 40)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, price double, id int")
    df.write.parquet(str(tmp_path / "in"))
    ticks = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = stream_candles(ticks).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(into_store(str(tmp_path / "out"), ("symbol", "open_time"), ("open", "high", "low", "close", "volume"))).trigger(availableNow=True).start()
    q.awaitTermination(120)
    stored = sorted((r.open_time, r.open, r.close) for r in read_store(spark, str(tmp_path / "out"), STORED).collect())
    assert stored == sorted((r.open_time, r.open, r.close) for r in stream_candles(df).collect()) and len(stored) == 5


STORED = "symbol string, open_time timestamp, open double, high double, low double, close double, volume double"


def test_store_by_days(spark, tmp_path):
    from marketloom.streaming.candles import into_store, read_store

    path, write = str(tmp_path / "s"), into_store(str(tmp_path / "s"), ("symbol", "open_time"), ("close",))
    of = lambda *rows: spark.createDataFrame([("A", dt.datetime(2025, 1, d, h), c) for d, h, c in rows], "symbol string, open_time timestamp, close double")
    assert read_store(spark, path, "symbol string, open_time timestamp, close double").count() == 0
    batches = [of((1, 1, 1.0), (2, 1, 2.0)), of((2, 1, 9.0), (2, 2, 3.0)), of((3, 1, 4.0))]
    for k, b in enumerate(batches):
        write(b, k)
    write(batches[1], 1)  # a batch that runs again
    got = sorted((r.open_time.day, r.open_time.hour, r.close) for r in read_store(spark, path, "symbol string, open_time timestamp, close double").collect())
    assert got == [(1, 1, 1.0), (2, 1, 9.0), (2, 2, 3.0), (3, 1, 4.0)]
    assert not list(tmp_path.glob("s/day=2025-01-01/version=1")) and list(tmp_path.glob("s/day=2025-01-02/version=1"))


def test_stream_headlines(spark, tmp_path):
    from marketloom.streaming.candles import stream_headlines

    at = dt.datetime(2025, 1, 1)
    schema = "dedup_key string, published_at timestamp, n int"
    for k, rows in enumerate([[("a", at, 1), ("a", at, 2), ("b", at, 3)], [("a", at + dt.timedelta(minutes=5), 4), ("c", at, 5)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = stream_headlines(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.option("checkpointLocation", str(tmp_path / "cp")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(r.dedup_key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_tables(spark, tmp_path):
    schemas.create_tables(spark, str(tmp_path))
    try:
        schemas.create_tables(spark, str(tmp_path))
        for table, fields in schemas.SCHEMAS.items():
            assert {f.name for f in spark.table(table).schema} == {x.split()[0] for x in re.split(", (?![0-9])", fields)}
        spark.createDataFrame([], schemas.SCHEMAS["candles"]).select(*spark.table("candles").columns).write.insertInto("candles")
        assert spark.table("candles").count() == 0
    finally:
        for table in schemas.SCHEMAS:
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_seeds(spark):
    assert schemas.assets(spark).count() == 3 and schemas.providers(spark).count() == 2
