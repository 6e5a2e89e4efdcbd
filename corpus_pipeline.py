"""A corpus pipeline of the operators in llm/: from documents to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import read
from llm.lines import dedup_lines
from llm.mixing import mix
from llm.packing import pack
from llm.quality import keep_good
from llm.queries import REST, SHARES
from llm.shingles import keep_one
from placemap.sources.storage import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents the classifier scores 0.5 or more; it learns from the labelled ones that are not held out."""
    return keep_good(docs.select(*COLUMNS), read(spark, folder, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without lines of three or more documents but in the last one; n_chars follows the text."""
    return dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are linked by a similarity of 0.8 or more."""
    return keep_one(docs.select(*COLUMNS), words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents in the order of the mix, file by file; all of them stay."""
    mixed = mix(docs.select(*COLUMNS), SHARES, rest=REST)
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All pieces of the documents' ids, packed in the order of the mix, which a scan of several files does not keep."""
    mixed = mix(docs.select(*COLUMNS), SHARES, rest=REST)
    return pack(mixed.repartitionByRange("position").sortWithinPartitions("position"))


STAGES = [
    ("quality", quality), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mix_sources), ("packing", pack_sequences),
]
#: A classifier and a tokeniser cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages one after the other; each reads what the one before it has written."""
    docs = read(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
