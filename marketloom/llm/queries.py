"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, html_text, language, lexical, mixing, nearest, packing, quality, simhash, spelling, token_count, token_files, toxicity
from .common import shared_folder, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edited(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), 2)
    return token_files.read_token_files(spark, path, with_ids=False)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 1, with_ids=False)


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pieces = table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")
    out = toxicity.held_out(F.col("doc_id"), 4, 2)
    model = language.train(docs.where(~out), pieces)
    return language.identify(docs, model, pieces).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), toxicity.held_out(F.col("doc_id"), 5, 0)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~out))
    return toxicity.score(docs, model).select("doc_id", out.alias("held_out"), "score", "predicted")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(nearest.index(table(spark, sf_dir, "embeddings")), F.col("id") % 100 == 0)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


def queries() -> dict:
    ops = (op1_fingerprints, op2_simhash, op3_token_files, op4_packing, op5_main_text, op6_language, op7_token_counts, op8_quality, op9_toxicity, op10_mixing, op11_lexical, op12_nearest, op13_spelling)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op10_mixing": mixing.ORACLE, "op11_lexical": lexical.ORACLE, "op13_spelling": spelling.ORACLE}
