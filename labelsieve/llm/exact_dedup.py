"""Exact dedup by content sort.

Spark samples splitters and range-partitions the normalised texts, its external sort puts equal ones side by side, and
one pass compares each whole text with its neighbour. A run of equal texts may cross partitions, because the
identifier is part of the range key and so splits a large group; only the first and last run of each partition can, and
those few rows are put together at the end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from labelsieve.llm.common import SEPARATORS, stored, unused

#: Leading characters of the normalised text in a splitter. The whole text's hash follows, so splitters stay small.
SPLITTER_CHARS = 64
#: Groups at partition ends that are broadcast; more of them are joined by a shuffle, each dealt over SALTS tasks.
MOST_ENDS, SALTS = 100_000, 64


def _runs(key_type: pa.DataType):
    names = ["doc_id", "run_keep", "run_first", "run_rows", "sha", "part", "edge"]

    def emit(ids: list, sha: str, part: int, edge: bool) -> pa.RecordBatch:
        n = sum(map(len, ids))
        keep = ids[0].slice(0, 1).to_pylist()[0]
        cols = [pa.concat_arrays(ids), pa.array([keep] * n, key_type), pa.array(np.arange(n) == 0), pa.array(np.full(n, n)), pa.array([sha] * n, pa.string()), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, edge))]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def compare(batches):
        part = TaskContext.get().partitionId()
        held: list = []  # the identifiers of the open run; identifiers only, not texts
        text, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, texts = batch.column(0), batch.column(1)
            same = pc.equal(texts.slice(1), texts.slice(0, len(texts) - 1)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(~same.astype(bool)) + 1).tolist(), len(texts)]
            ready = []
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                own = texts[a].as_py()
                if held and not (i == 0 and own == text):
                    ready.append(emit(held, hashlib.sha256(text.encode()).hexdigest(), part, first))
                    held, first = [], False
                text = own
                held.append(ids.slice(a, b - a))
            if ready:
                yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
        if held:
            yield emit(held, hashlib.sha256(text.encode()).hexdigest(), part, True)

    return compare


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so after every run of separators has become one space. Null counts as empty. Of a
    group the row with the smallest identifier stays, null identifiers last; of rows that repeat identifier and text,
    one stays. An empty table gives an empty result. Other columns are not read.
    """
    norm = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SEPARATORS, " ")
    rows = docs.select(F.col(doc_id).alias("doc_id"), norm.alias("norm"))
    kind = dict(rows.dtypes)["doc_id"]
    keyed = rows.withColumn("lead", F.substring("norm", 1, SPLITTER_CHARS)).withColumn("h", F.xxhash64("norm"))
    order = ["lead", "h", "norm", F.col("doc_id").asc_nulls_last()]
    ranged = keyed.repartitionByRange("lead", "h", F.col("doc_id").asc_nulls_last()).sortWithinPartitions(*order)
    arrow = to_arrow_type(rows.schema["doc_id"].dataType)
    schema = f"doc_id {kind}, run_keep {kind}, run_first boolean, run_rows bigint, sha string, part int, edge boolean"
    runs = stored(ranged.select("doc_id", "norm").mapInArrow(_runs(arrow), schema), "exact-runs")
    # First and last runs of partitions: at most two a partition, whatever the input.
    ends = runs.filter("edge and run_first").groupBy("sha").agg(F.sum("run_rows").alias("all_rows"), F.min(F.struct("part", "run_keep")).alias("least"))
    ends = ends.select(F.col("sha").alias("edge_sha"), "all_rows", F.col("least.part").alias("least_part"), F.col("least.run_keep").alias("least_keep"))
    inner = runs.filter("not edge").select("doc_id", F.col("run_keep").alias("keep_id"), F.col("run_rows").alias("group_size"), F.col("run_first").alias("kept"), F.col("sha").alias("text_sha256"))
    ends = stored(ends, "exact-ends")
    outer = _with_ends(runs.filter("edge"), ends).select(
        "doc_id", F.col("least_keep").alias("keep_id"), F.col("all_rows").alias("group_size"), (F.col("run_first") & (F.col("part") == F.col("least_part"))).alias("kept"), F.col("sha").alias("text_sha256")
    )
    return inner.unionByName(outer)


def _with_ends(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows of the runs at partition ends with what is known of their groups. One group may hold most of these rows, so
    they aren't dealt by group alone."""
    if ends.count() <= MOST_ENDS:
        return edges.join(F.broadcast(ends), F.col("sha") == F.col("edge_sha"))
    salted = ends.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = edges.withColumn("row_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, (F.col("sha") == F.col("edge_sha")) & (F.col("row_salt") == F.col("salt")))


def without_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all columns of `docs`, whatever their names; nulls, ties and empty tables as in exact_groups."""
    key, kept_id, kept_sha = unused(docs, "kept_key", "kept_id", "kept_sha")
    kept = exact_groups(docs, doc_id, text).filter("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha))
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SEPARATORS, " "), 256)
    numbered = docs.withColumn(key, sha)
    joined = numbered.join(kept, F.col(doc_id).eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_sha)), "left_semi")
    # Rows that repeat both identifier and text: one of them.
    return joined.dropDuplicates([doc_id, key]).select(*docs.columns)
