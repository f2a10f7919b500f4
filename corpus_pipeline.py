"""The corpus pipeline: from raw documents to a training mix, stage by stage.

Each stage takes the documents that its predecessor kept and returns a DataFrame with the columns
of ``documents``; the last one repeats documents and adds the number of the repetition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankwright.llm.decontaminate import remove_leaks
from rankwright.llm.mixing import mix
from rankwright.llm.near_dup import keep_one_of_each
from rankwright.llm.pii import replace_pii
from rankwright.llm.toxicity import drop_toxic, fit_toxicity
from rankwright.llm.tuning import tune
from rankwright.session import write_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half."""
    return drop_toxic(docs, fit_toxicity(docs, _table(tune(spark), sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id."""
    tune(spark)
    return keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an item of the benchmark."""
    return remove_leaks(docs, _table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts with surrogates for personal data, and their new lengths."""
    replaced = replace_pii(docs)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        replaced = replaced.withColumn("n_chars", F.length("text").cast(kind))
    return replaced.select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training mix: each document as often as it is taken, numbered from 1 in ``repetition``."""
    mixed = mix(docs).filter("copies > 0")
    names = [c for c in docs.columns if c != "repetition"]
    return mixed.select(*names, F.explode(F.expr("sequence(1L, copies)")).alias("repetition"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii),
    ("mixing", mixing),
]

#: SQL can't express the learned score of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return docs
