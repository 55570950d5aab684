"""Filter interaction audit: what each order of some filters keeps, removes and hides.

One pass over the texts gives each document a mask of the conditions it fails. Only repeats need other documents: a
counting Bloom sketch over all texts (counts per task, added up by the cluster) clears every text of which some counter is
at most one. The others, possible repeats, are shuffled with their whole texts for the smallest identifier of each. The
flags are joined by document and counted by part and mask; all orders follow from these additive counts.
"""

from __future__ import annotations

import re
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsieve.llm.common import SEPARATORS, modest_batches, stored

FILTERS = "ABCDE"
#: Counters of the sketch for each document, and the bounds of their number; beyond the upper one more texts are shuffled.
COUNTERS_PER_TEXT, LEAST_COUNTERS, MOST_COUNTERS = 16, 1 << 16, 1 << 27
HASHES = 3
#: Bytes of one text whose words are split at once.
PIECE_BYTES = 4_000_000

_SEPARATOR = re.compile(SEPARATORS.encode())
_UPPER, _MARKS, _CONTINUED = bytes(range(ord("A"), ord("Z") + 1)), b"#$%&*|", bytes(range(0x80, 0xC0))


def _distinct_words(data: bytes) -> tuple[int, int]:
    """Number of words and of different words; bytes.split() cuts at the six ASCII separators."""
    if len(data) <= PIECE_BYTES:
        own = data.split()
        return len(own), len(set(own))
    seen, n, at = set(), 0, 0
    while at < len(data):
        cut = _SEPARATOR.search(data, min(at + PIECE_BYTES, len(data)))
        end = cut.start() if cut else len(data)
        own = data[at:end].split()
        n += len(own)
        seen.update(own)
        at = end
    return n, len(seen)


def failed(data: bytes) -> int:
    """Bits 1, 2, 4 and 8 for the conditions A to D that a text (UTF-8) fails."""
    n, distinct = _distinct_words(data)
    upper = len(data) - len(data.translate(None, _UPPER))
    points = len(data.translate(None, _CONTINUED))
    marked = len(data.translate(None, _MARKS)) < len(data)
    return (n < 50) | (100 * distinct < 65 * n) << 1 | (100 * upper > 5 * points) << 2 | marked << 3


def _masks(batches):
    for batch in batches:
        texts = batch.column(3).cast(pa.binary())
        mask = pa.array([failed(x.as_py()) for x in texts], pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], mask], names=["doc_id", "part", "text_hash", "mask"])


def _counters(text_hash: Column, m: int) -> Column:
    return F.array_distinct(F.array(*[F.pmod(F.xxhash64(text_hash, F.lit(k)), F.lit(m)) + 1 for k in range(HASHES)]))


def possible_repeats(hashes: DataFrame, text_hash: str, counters: int | None = None):
    """A filter on a column of text hashes: false only for texts that occur once.

    Counts are partial sums of each task, added by counter; what travels is three small rows a text. The counters of two
    and more become a bitmap, put together by the cluster, of fixed size: at most MOST_COUNTERS bits.
    """
    if counters is None:
        counters = min(max(1 << (COUNTERS_PER_TEXT * max(1, hashes.count()) - 1).bit_length(), LEAST_COUNTERS), MOST_COUNTERS)
    met = hashes.select(F.explode(_counters(F.col(text_hash), counters)).alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts = met.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    marked = np.zeros(-(-counters // 32768) * 4096, np.uint8)
    for r in parts.collect():  # at most MOST_COUNTERS / 32768 rows of 4 KB
        marked[(r["part"] - 1) * 4096 : r["part"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    shared = hashes.sparkSession.sparkContext.broadcast(marked)

    @F.pandas_udf("boolean")
    def maybe(*at):
        bits, out = shared.value, True
        for c in at:
            c = c.to_numpy() - 1
            out = out & ((bits[c >> 3] >> (c & 7).astype(np.uint8)) & 1).astype(bool)
        return type(at[0])(out)

    return lambda h: maybe(*[F.pmod(F.xxhash64(h, F.lit(k)), F.lit(counters)) + 1 for k in range(HASHES)])


def repeated_rows(docs: DataFrame, maybe) -> DataFrame:
    """(doc_id, text_hash) of each row whose text a smaller identifier has too. docs: doc_id, body, text_hash.

    The whole texts of possible repeats are grouped, with the smallest identifier and the number of rows taken in each task
    before the shuffle, so a text in very many rows sends one row a task. Rows find their text's minimum by its digest; two
    texts of one digest would be seen among the grouped texts, and are an error.
    """
    possible = docs.filter(maybe(F.col("text_hash")))
    groups = possible.groupBy("body").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).select(F.sha2("body", 256).alias("digest"), "least", "n")
    met = groups.groupBy("digest").agg(F.first("least").alias("least"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")).filter("n > 1")
    single = met.filter(F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts of one SHA-256"))).otherwise(True)).select("digest", "least")
    rows = possible.select("doc_id", "text_hash", F.sha2("body", 256).alias("digest"))
    return rows.join(single, "digest").filter("doc_id > least").select("doc_id", "text_hash").distinct()


def mask_counts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those of quality 1 and toxic 1 among them, by part and failed conditions.

    Null text is empty, a null part is the empty string, a null identifier has no label and is no repeat. Rows of one
    identifier and one text are no repeats of each other, and each counts. Of several labels of an identifier any 1 counts.
    An empty table gives an empty result; other columns aren't read.
    """
    modest_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.xxhash64(body).alias("text_hash"), body.alias("body"))
    kind = dict(rows.dtypes)["doc_id"]
    flagged = stored(rows.mapInArrow(_masks, f"doc_id {kind}, part string, text_hash long, mask int"), "flags")
    again = repeated_rows(rows.select("doc_id", "body", "text_hash"), possible_repeats(flagged, "text_hash")).withColumn("again", F.lit(True))
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    marks = labels.select(F.col("doc_id").alias("label_of"), F.col("quality").alias("is_good"), F.col("toxic").alias("is_toxic")).groupBy("label_of").agg(one("is_good"), one("is_toxic"))
    joined = flagged.join(again, ["doc_id", "text_hash"], "left").join(marks, F.col("doc_id") == F.col("label_of"), "left")
    mask = F.col("mask") + F.when(F.col("again"), 16).otherwise(0)
    return joined.groupBy("part", mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"), F.count_if("is_good").alias("good"), F.count_if("is_toxic").alias("toxic"))


def orders(filters: str = FILTERS) -> list[tuple[int, str, int, int, int, int, int, int]]:
    """For each mask, order and step: whether it is kept after the step, removed in it, redundant there, failing there only; and its share in the Shapley sum."""
    bit, out = {f: 1 << k for k, f in enumerate(filters)}, []
    for order in map("".join, permutations(filters)):
        before = 0
        for step, f in enumerate(order, 1):
            for mask in range(1 << len(filters)):
                fails, earlier = bool(mask & bit[f]), bool(mask & before)
                share = factorial(len(filters)) // mask.bit_count() if fails else 0
                out.append((mask, order, step, int(not mask & (before | bit[f])), int(fails and not earlier), int(fails and earlier), int(mask == bit[f]), share))
            before |= bit[f]
    return out


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, filter_order and step, from counts by part and mask.

    shapley needs no orders: a mask of k failed conditions is removed first by each of them in 1/k of all orders.
    """
    table = counts.sparkSession.createDataFrame(orders(), "mask int, filter_order string, step int, k int, r int, d int, u int, share int")
    met = counts.join(F.broadcast(table), "mask")  # a table of fixed size: 32 masks in 600 steps
    total = lambda of, flag: F.sum(F.col(of) * F.col(flag)).cast("long")
    return met.groupBy("part", "filter_order", "step").agg(
        total("n", "k").alias("kept"), total("n", "r").alias("removed"), total("n", "d").alias("redundant"), total("n", "u").alias("unique_fails"),
        total("good", "r").alias("good_lost"), total("toxic", "r").alias("toxic_lost"), total("n", "share").alias("shapley"),
    )
