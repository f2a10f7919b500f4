"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from rankwright.llm import (
    chat, collocations, decontaminate, licences, mixing, near_dup, oracles, pii, resample, secrets, substring, toxicity, vptree, warc,
)
from rankwright.llm.tuning import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = dict(oracles.SQL)


def query(run: Query) -> Query:
    QUERIES[run.__name__] = lambda spark, folder: run(tune(spark), folder)
    return run


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, folder, "documents"), near_dup.NearDup(words=2))


@query
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, folder, "labels"))
    return toxicity.score_toxicity(docs, model).select(
        "doc_id",
        (~toxicity.in_training()).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


@query
def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.remove_repeats(table(spark, folder, "documents"))


@query
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op9_chat(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.lit(said).alias("text"),
    )
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    messages = rows.select("conv_id", "turn", "role", chat.text_parts().alias("parts"))
    return chat.format_and_read(messages).select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )


@query
def op10_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.find_secrets(table(spark, folder, "documents"))


@query
def op7_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_and_read(table(spark, folder, "pages"))


@query
def op5_vptree(spark: SparkSession, folder: str) -> DataFrame:
    return vptree.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.replace_pii(table(spark, folder, "documents")).select("doc_id", "n_entities", "text")


@query
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.find_collocations(table(spark, folder, "documents"))


@query
def op12_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.find_licences(table(spark, folder, "documents"))


@query
def op13_resample(spark: SparkSession, folder: str) -> DataFrame:
    drawn = resample.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
