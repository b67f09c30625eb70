"""From raw documents to subword ids: the stages of a training-data pipeline.

Each stage takes (spark, docs, sf_dir) and returns the documents it kept, with their
columns; the last returns the ids. Stages are written to the shared folder and read again,
so a lost executor costs a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codehistory.llm import decontam, ngrams, pieces, substrings, toxicity
from codehistory.llm.common import stored


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression, fitted on the labels, finds toxic go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, the one with the smallest id."""
    return ngrams.drop_near_copies(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that repeat a passage of a document with a smaller id go; every document stays."""
    cut = substrings.cut_repeats(docs)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))) if "n_chars" in cut.columns else cut


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more stands in the benchmark go."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def subwords(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Subword ids of each text, with digests of the ids and of what they decode to."""
    import public_tokenizers

    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), arrays=("ids",))


STAGES = [
    ("toxicity", toxic),
    ("ngram_jaccard_join", near_copies),
    ("substring_dedup", repeats),
    ("benchmark_decontamination", contaminated),
    ("sentencepiece", subwords),
]

#: A fitted model and a tokenizer are not SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
