"""The training-data pipeline: five stages over ``documents``, each written before the next.

1. quality classifier: documents that are rather of the lowest grade go;
2. near-dedup: of each group of near copies (five-word shingles, Jaccard 0.8 or more; met by SimHash
   first, then by the shingles) the document of the smallest id stays;
3. exact substring dedup: passages of 400 bytes or more that occur elsewhere are cut out;
4. benchmark decontamination: documents that hold ten consecutive words of an item go;
5. mixing: every source gives the words of its target, as ``taken`` says for each document.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``docs``, extra
ones of any name included. Null and empty texts are documents without words: the classifier decides
on them as on others, of those it keeps near-dedup leaves one, and the later stages let it pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hexatlas.llm import decontamination, mixing, near_copies, quality, substrings
from hexatlas.llm.base import table, word_count
from hexatlas.session import scratch_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group; texts without words are one group.

    A document is an id and a text, so rows that repeat both stay; ids come before null, then the smallest text hash.
    """
    return near_copies.kept(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` that the mix takes, with ``size, weight, source_size, target, taken``.

    Columns of ``docs`` of these names are replaced. Documents without words are never taken.
    """
    sized = mixing.quality_weighted(docs.withColumn("size", word_count(F.col("text"))), table(spark, sf_dir, "labels"))
    return mixing.mix(sized, weight="weight").where(F.col("taken") > 0)


STAGES = [("quality classifier", good), ("near-dedup", distinct), ("suffix-array dedup", unrepeated),
          ("benchmark decontamination", uncontaminated), ("mixing to target weights", mixed)]

#: Hashing, fitting and sampling have no equal in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
