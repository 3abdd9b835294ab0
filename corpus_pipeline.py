"""The corpus pipeline: each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import bpe, decontaminate, minhash, repeats, toxicity
from nearfield.llm.common import table, written
from nearfield.llm.queries import toxic_model
from nearfield.plans.ship import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL cannot express the stages (a fitted model, byte passages, a tokenizer); tests hold them against brute force.
ORACLE_SQL = None


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go."""
    ship(spark)
    return toxicity.score(docs, toxic_model(spark, sf_dir), [*COLUMNS]).where("score < 0.3").select(*COLUMNS)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the document with the smallest id stays."""
    ship(spark)
    gone = minhash.near_duplicates(docs, width=5).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def repeats_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 200 bytes are cut from the texts, at whole characters; every document stays."""
    ship(spark)
    keep = [c for c in COLUMNS if c not in ("text", "n_chars")]
    done = repeats.remove_repeats(docs, keep=keep)
    return done.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    ship(spark)
    gone = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as ids."""
    ship(spark)
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", toxic_out), ("minhash_near_dedup", near_duplicates_out), ("suffix_array_dedup", repeats_out), ("benchmark_decontamination", contaminated_out), ("bpe", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{k}-{name}")
    return docs
