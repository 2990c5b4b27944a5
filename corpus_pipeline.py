"""Documents to packed training sequences.

Quality rules, language identification, near-duplicate removal, mixing of sources to target weights,
packing. Each stage is one operator of trawlspark.llm over all rows that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlspark.llm import langid, mixing, neardup, packing, quality
from trawlspark.llm.stage import written
from trawlspark.llm.tokens import vocabulary_path
from trawlspark.session import prepare

#: Packing in particular has no form in SQL.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are close to a language reference."""
    prepare(spark)
    return quality.assess(docs).where("kept").select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is not in doubt."""
    prepare(spark)
    found = langid.identify(docs, langid.learn(docs.select("doc_id", "text", "lang")))
    return found.where(~F.col("ambiguous")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group; shingles of five words, similarity 0.8."""
    prepare(spark)
    return neardup.distinct(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the mix: repeated for whole copies, cut to the words taken at a source's border."""
    prepare(spark)
    return mixing.materialise(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of up to 2048 ids, with the ids."""
    prepare(spark)
    return packing.pack(docs, vocabulary_path("byte_bpe_50k.json"), end_id=1, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
