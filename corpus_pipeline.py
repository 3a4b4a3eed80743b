"""A training-data pipeline over ``documents``: five stages, each one operator.

Quality rules drop documents and frequent lines, the n-gram Jaccard join keeps one
document of each class, secret scans mask what they find, mixing brings the
sources to their target weights, and packing cuts the tokens into fixed windows.

A stage reads the table that the one before it has written.  It keeps its
intermediate tables in the scratch folder that it is given, or in one of its own;
``run`` removes each stage's folder and input once its output is written.  Stages
share no state, so results may be built in any order and live side by side.

In all stages rows that repeat an id, or have none, are separate documents; extra
columns stay as they are, whatever their names; an empty table gives an empty
table; texts of any length are handled whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinelake.llm import mixing, ngram_join, packing, quality, secret_scan
from kinelake.llm.storage import Scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """The documents that the quality rules keep, without their frequent lines.

    The limit of a line is the same number of documents on a host of any size; the
    host's first document keeps it, so that one of many copies reaches the next
    stage.  Null and empty texts fail the rules; a null source is a host.
    """
    return quality.texts(docs, keep_first=True, scratch=scratch or Scratch(spark)).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """One document of each class of near copies (five words, 0.8): that with the smallest id, null last.

    Repeated rows are copies; null and wordless texts are copies of nothing.
    """
    return ngram_join.keep_one(docs, n=5, percent=80, scratch=scratch or Scratch(spark))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """All documents, with secrets masked; null and empty texts stay so."""
    return secret_scan.mask_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """What the mix takes of each document, at most twice; null and wordless texts are not taken, a null source is a source."""
    return mixing.mixed_texts(docs, scratch=scratch or Scratch(spark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Boundary records of the packed windows; null and empty texts are the end id alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), scratch=scratch or Scratch(spark))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("source_mix", source_mix),
    ("packed", packed),
]

#: Token ids, hash permutations and link classes are not expressible in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables, before = Scratch(spark), None
    for name, stage in STAGES[:-1]:
        own = Scratch(spark)
        docs = tables.table(stage(spark, docs, sf_dir, own), name)
        own.delete()
        if before:
            tables.drop(before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir, tables)
