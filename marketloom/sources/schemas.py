"""Schemas of the stored tables, and the rows they start with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PRICE, VOLUME = "decimal(20,8)", "decimal(28,8)"
SCHEMAS = {
    "providers": "id string, code string, name string, category string, is_active boolean, rate_limit_per_minute int, metadata string",
    "assets": "id string, normalized_symbol string, display_symbol string, name string, base_currency string, quote_currency string, asset_class string, is_active boolean",
    "asset_provider_symbols": "asset_id string, provider_id string, provider_symbol string, is_primary boolean",
    "candles": f"asset_id string, provider_id string, timeframe string, open_time timestamp, close_time timestamp, open {PRICE}, high {PRICE}, low {PRICE}, close {PRICE}, volume {VOLUME}, quote_volume {VOLUME}, trade_count int, quality_score decimal(5,2)",
    "ingestion_runs": "provider_id string, job_name string, status string, started_at timestamp, finished_at timestamp, details string",
    "news_items": "id string, provider_id string, external_id string, source_name string, title string, summary string, url string, published_at timestamp, sentiment_label string, importance_score decimal(5,2), dedup_key string, metadata string",
    "news_asset_links": "news_item_id string, asset_id string, relevance_score decimal(5,2)",
}

#: Columns that the files of a table are laid out by: readers of few series, or of few days, then read few files.
PARTITIONS = {"candles": ("timeframe",), "ingestion_runs": ("job_name",)}


def ddl(table: str, location: str, database: str = "default") -> str:
    """The statement that creates a stored table as Parquet under ``location``, if it isn't there."""
    by = f" PARTITIONED BY ({', '.join(PARTITIONS[table])})" if table in PARTITIONS else ""
    return f"CREATE TABLE IF NOT EXISTS {database}.{table} ({SCHEMAS[table]}) USING parquet{by} LOCATION '{location.rstrip('/')}/{table}'"


def create_tables(spark: SparkSession, location: str, database: str = "default") -> None:
    """All stored tables, empty where they are new."""
    for table in SCHEMAS:
        spark.sql(ddl(table, location, database))


# The rows that the tables are seeded with.
PROVIDERS = [("ccxt", "CCXT", "market_data", 60), ("alpha_vantage", "Alpha Vantage", "market_data", 5)]
ASSETS = [("BTCUSDT", "BTC/USDT", "BTC", "USDT", "crypto"), ("ETHUSDT", "ETH/USDT", "ETH", "USDT", "crypto"), ("EURUSD", "EUR/USD", "EUR", "USD", "forex")]


def _seeded(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """Rows whose size Spark knows when it plans; a DataFrame from a Python list counts as larger than any table in joins."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, rows))} AS t({names})")


def providers(spark: SparkSession) -> DataFrame:
    return _seeded(spark, PROVIDERS, "code, name, category, rate_limit_per_minute").selectExpr("sha2(code, 256) AS id", "*", "true AS is_active")


def assets(spark: SparkSession) -> DataFrame:
    return _seeded(spark, ASSETS, "normalized_symbol, display_symbol, base_currency, quote_currency, asset_class").selectExpr("sha2(normalized_symbol, 256) AS id", "*", "concat(base_currency, ' / ', quote_currency) AS name", "true AS is_active")


def active(assets: DataFrame) -> DataFrame:
    """The assets that headlines are tagged with."""
    return assets.where("is_active")
