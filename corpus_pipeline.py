"""A training corpus from the documents: language, quality, near duplicates, repeated passages, packing."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import jaccard, language, packing, repetition, substrings
from plumbline.plans.staging import scratch_path

# Least score of a predicted language. The stage drops text that fits no language, not text that is merely short.
SURE = 0.35


def _beside(operator: Callable[[DataFrame], DataFrame], docs: DataFrame) -> DataFrame:
    """``operator`` on the documents, with their columns, whatever their names, set aside in ``__own``."""
    text = F.col("text")
    return operator(docs.select(F.col("doc_id"), text, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__own")))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: not ``und``, and a score of at least ``SURE``.

    The machines are fitted on labelled documents of the input. If no language is labelled, none can be
    recognised, and only documents without a letter go.
    """
    model = language.fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = _beside(lambda rows: language.predict(rows, model), docs)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= SURE)).select("__own.*")


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules."""
    return _beside(repetition.repetition, docs).where("kept").select("__own.*")


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates; a repeated row stays once.

    Rows without an id are in no class and stay.
    """
    found = _beside(jaccard.similarity_classes, docs).where("is_kept").withColumn("__row", F.xxhash64("text"))
    named = found.where(F.col("doc_id").isNotNull()).dropDuplicates(["doc_id", "__row"])
    return named.unionByName(found.where(F.col("doc_id").isNull())).select("__own.*")


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; ``n_chars`` is brought up to date, empty ones go."""
    found = _beside(substrings.repeated_spans, docs)
    changed = F.col("n_removed") > 0
    found = found.where((F.col("n_removed") < F.col("n_words")) | ~changed)
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast(docs.schema["n_chars"].dataType)}
    return found.select(*[
        (F.when(changed, new[c]).otherwise(F.col("__own")[c]) if c in new else F.col("__own")[c]).alias(c) for c in docs.columns
    ])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4,096 tokens."""
    pieces = packing.pack(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", keep_known_language),
    ("quality_rules", keep_good_quality),
    ("near_duplicates", keep_one_of_each_class),
    ("substring_dedup", remove_repeated_passages),
    ("packing", pack_sequences),
]

# A learned language model cannot be told in SQL; tests compare the other stages with SQL and brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
