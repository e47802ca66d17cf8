"""From raw documents to packed training sequences, a stage at a time.

Each stage takes (spark, docs, sf_dir) and returns what the next one works on, with the
columns of documents; the last returns the pieces of all documents with their place in the
sequences. ``run`` writes every stage's result as Parquet into the shared folder and reads
it again, so a stage that is lost starts from the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from honorlens.llm import common, cuckoo, decontam, langid, packing, partenum
from honorlens.session import ship_package
from honorlens.sources.tables import read_table

#: Share of a text's n-grams that its language must account for; below, it is in no learned language.
LEAST_SCORE = 0.3
SEQUENCE_TOKENS = 2048


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in no learned language: null, without a letter, or scored under ``LEAST_SCORE``.

    Without labelled rows nothing can be learned; then only texts without a letter go.
    """
    model = langid.learn(docs.filter(langid.in_training()))
    found = langid.predict(docs.select(F.struct("*").alias("row")), model, "row.text")  # the text once a row, not twice
    if model.languages:
        keep = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    else:
        keep = F.col("text").rlike(r"\p{L}")
    return found.filter(keep).select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (but for the case of A-Z) the row with the largest doc_id stays."""
    return cuckoo.keep_last(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by a similarity of 0.75 or more the one with the smallest doc_id stays."""
    return partenum.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a test item, edited ones too, go."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    benchmark = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    return decontam.with_copies(rows, benchmark).filter(F.size("copies") == 0).select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in sequences of 2048 tokens: a row a piece."""
    return packing.pack_documents(docs, common.tokenizer_path("byte_bpe_50k.json"), packing.Capacity(SEQUENCE_TOKENS))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("pack", pack),
]

#: No SQL can learn the languages or run the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
