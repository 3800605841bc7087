"""The corpus pipeline: stages applied one after the other to `documents`.

Each stage takes what its predecessor kept, all but the last return the columns of `documents`.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourgrid.llm import decontaminate, langid, mixing, ngram_join, secrets, storage


def _measured(docs: DataFrame) -> DataFrame:
    """`docs` with n_chars of the text as it is now."""
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected; learned from the training fold of `docs`."""
    found = langid.identify(docs, langid.fit(langid.training_rows(docs)))
    return found.filter("accepted").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents."""
    return ngram_join.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items; mostly benchmark text: no document."""
    return _measured(decontaminate.decontaminate(docs, storage.table(spark, sf_dir, "benchmark")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by the kind."""
    return _measured(secrets.redact_secrets(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus in shuffled order."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
]

ORACLE_SQL = None  # the language model is trained; tests hold the pipeline against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = storage.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = storage.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
