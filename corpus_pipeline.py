"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellshift.llm import decontaminate, jaccard, lines, packing, toxicity
from cellshift.llm.queries import TOXIC_FROM, tokenizer, toxicity_model
from cellshift.llm.shared import materialise

# None: SQL expresses neither a trained score nor the packing.
ORACLE_SQL = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the bar go. Learnt from labels that are not held out."""
    return toxicity.drop_toxic(docs, toxicity_model(spark, docs, sf_dir), TOXIC_FROM)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document or line has go, and documents that lose all words so.

    n_chars, where there is one, counts the new text. Texts without repeated lines stay
    as they are; null texts become empty.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    kept = lines.dedup_lines(docs, keep=[whole]).where((F.col("n_removed") == 0) | F.col("kept").rlike(jaccard.WORD))
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return kept.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 the one with the least id stays."""
    return jaccard.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids, each with its sequence and its place there."""
    return packing.pack_documents(docs, tokenizer()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", without_toxic),
    ("line dedup", without_repeated_lines),
    ("n-gram jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; each writes its result, the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
