"""A training-data pipeline over documents: language, quality, near duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm import language, mixing, packing, quality, simhash, toxicity
from marketloom.llm.common import row_key, swept, written
from marketloom.llm.queries import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: those without a letter, or with no language above 0.5, go. lang becomes the predicted one."""
    pieces = vocabulary("piece_bpe_32k.model")
    model = language.train(docs.where(~toxicity.held_out(F.col("doc_id"), 4, 2)), pieces)
    found = language.identify(docs, model, pieces, keep=COLUMNS).where("lang_pred <> 'und' and score > 0.5")
    return found.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def judged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.judge(docs, keep=COLUMNS).where("kept").select(*COLUMNS)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the one with the least doc_id.

    A document is a row: rows of one id with different texts are two, rows without an id count as well, and of rows alike in all columns one stays."""
    docs = docs.select(*COLUMNS)
    kept = simhash.similar_documents(docs).where("stays").select("row").distinct()
    return docs.withColumn("row", row_key(docs)).join(kept, "row", "left_semi").dropDuplicates(["row"]).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document stands in it once for every whole epoch, and once more with its first words where the last epoch is cut inside it.

    What is taken belongs to its row, also where ids are null or repeated; rows alike in all columns share theirs out by number."""
    docs = docs.select(*COLUMNS)
    docs = docs.withColumn("row", row_key(docs))
    taken = mixing.mix(docs, keep=("row",)).where("taken > 0").groupBy("row").agg(F.max("size").alias("size"), F.sort_array(F.collect_list("taken"), False).alias("all_taken"))
    numbered = docs.withColumn("number", F.row_number().over(Window.partitionBy("row").orderBy("row")))
    rows = numbered.join(taken, "row").withColumn("taken", F.get("all_taken", F.col("number") - 1)).where("taken is not null")
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    copies = copies.withColumn("left", F.least("size", F.col("taken") - F.col("copy") * F.col("size")).cast("int"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))
    text = F.when(F.col("left") == F.col("size"), F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("left")), " "))
    return copies.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in sequences of at most 2048 tokens, a row per piece."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), 1)


STAGES = [("language", identified), ("quality", judged), ("near_duplicates", single), ("mixing", mixed), ("packing", packed)]

#: Language, quality, SimHash and packing can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. Of their tables under spark.checkpoint.dir the last one stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with swept(spark):
        for _, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir))
    return docs
