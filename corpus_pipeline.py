"""The corpus pipeline: quality classifier, exact dedup, near-duplicate removal, mixing and BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the columns of
documents. A stage's result is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsieve.llm import bpe, exact_dedup, jaccard, mixing, quality
from labelsieve.llm.common import WORD, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more stay; null text is scored as empty.

    Rows that repeat are judged alike. An empty table gives an empty result; other columns don't change a score.
    """
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.withColumn("quality_score", quality.quality_score(trees, F.col("text")))
    return scored.filter("quality_score >= 0.7").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the one with the smallest identifier stays; null text is empty, null identifiers come last.

    Of rows that repeat identifier and text one stays. An empty table gives an empty result; other columns aren't read.
    """
    return exact_dedup.without_copies(docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a Jaccard similarity of 0.8 or more, the smallest identifier stays.

    Rows are told apart by identifier and text: null identifiers come last, of rows that share an identifier the smaller
    hash of the text stays, and of rows that repeat both one stays. Documents without words are linked with nothing, and
    all of them stay. An empty table gives an empty result; other columns aren't read.
    """
    row_key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("h"))
    keyed = docs.select(*COLUMNS, row_key.alias("row_key"), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("worded"))
    worded = keyed.filter("worded")
    groups = jaccard.jaccard_groups(worded, n=5, percent=80, doc_id="row_key")
    kept = stored(groups.filter("doc_id = component_id").groupBy(F.col("doc_id").alias("kept_key")).agg(F.count(F.lit(1)).alias("times")), "kept")
    # Only repeated rows are shuffled with their texts; after exact dedup there are none.
    once = worded.join(kept.filter("times = 1"), F.col("row_key") == F.col("kept_key"), "left_semi")
    again = worded.join(kept.filter("times > 1"), F.col("row_key") == F.col("kept_key"), "left_semi").dropDuplicates(["row_key"])
    return once.unionByName(again).unionByName(keyed.filter("not worded")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says; null text has no words, and null is a source of its own.

    Rows that repeat get equal copies. An empty table gives an empty result; other columns aren't read.
    """
    return mixing.mixed(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document and the text they decode to, one row per copy in the mix; null text is empty and has no ids.

    An empty table gives an empty result; other columns aren't read.
    """
    coded = bpe.encode_docs(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", reject_low_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

#: The classifier and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, "stage")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
