"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from whole texts with numpy over Arrow buffers. The trees are grown on a bounded sample of the
labelled rows and flattened into arrays; scoring walks all trees of a batch level by level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsieve.llm.common import id_crc32, slices, text_buffers, word_hashes, words

#: Labelled rows that the trees are fitted on, about: the documented bound on what the driver reads.
TRAINING_ROWS = 20_000

_CLASSES = 11
_CLASS = np.full(256, 9, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = 3
_CLASS[0x0A] = 4
_CLASS[[ord("."), ord(",")]] = 5
_CLASS[ord("!")] = 6
_CLASS[ord("|")] = 7
_CLASS[[ord(c) for c in "#$%&*@~^<>{}"]] = 8
_CLASS[128:] = 10


def _distinct(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Number of different hashes in each text."""
    if not len(doc):
        return np.zeros(n)
    key = (doc.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24))
    key.sort()
    return np.bincount((key[np.concatenate([[True], key[1:] != key[:-1]])] >> np.uint64(40)).astype(np.int64), minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers per text: lengths, shares of character classes, of word shapes, and of repeats."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    kind = _CLASS[data]
    doc = np.repeat(np.arange(n), size)
    chars = np.bincount(doc * _CLASSES + kind, minlength=n * _CLASSES).reshape(n, _CLASSES)
    starts, ends, at = words(data, offsets)
    count = np.diff(at)
    owner = np.repeat(np.arange(n), count)
    length = ends - starts
    first = np.bincount(owner * _CLASSES + kind[starts], minlength=n * _CLASSES).reshape(n, _CLASSES) if len(starts) else np.zeros((n, _CLASSES))
    last = np.bincount(owner * _CLASSES + kind[ends - 1], minlength=n * _CLASSES).reshape(n, _CLASSES) if len(starts) else np.zeros((n, _CLASSES))
    mean = np.bincount(owner, length, minlength=n) / np.maximum(count, 1)
    square = np.bincount(owner, length.astype(float) ** 2, minlength=n) / np.maximum(count, 1)
    short = np.bincount(owner, length <= 3, minlength=n)
    different = _distinct(owner, word_hashes(data, starts, ends), n) if len(starts) else np.zeros(n)
    # Lines are what stands between line feeds and text ends.
    edge = np.unique(np.concatenate([offsets, np.flatnonzero(data == 0x0A) + 1])) if len(data) else offsets[:1]
    line_start, line_end = edge[:-1], edge[1:]
    line_doc = np.searchsorted(offsets, line_start, side="right") - 1
    lines = np.bincount(line_doc, minlength=n)[:n]
    line_kinds = _distinct(line_doc, word_hashes(data, line_start, line_end), n)[:n] if len(line_start) else np.zeros(n)
    per_byte, per_word = np.maximum(size, 1)[:, None], np.maximum(count, 1)[:, None]
    columns = [
        np.log1p(size)[:, None], np.log1p(count)[:, None], mean[:, None], np.sqrt(np.maximum(square - mean**2, 0))[:, None],
        chars / per_byte, first[:, [1, 2, 8, 9]] / per_word, last[:, [1, 2, 5, 6, 7, 8, 9]] / per_word,
        short[:, None] / per_word, different[:, None] / per_word, np.log1p(lines)[:, None], line_kinds[:, None] / np.maximum(lines, 1)[:, None],
    ]
    return np.concatenate(columns, axis=1).astype(np.float32)


def text_statistics(column: pa.Array) -> np.ndarray:
    data, offsets = text_buffers(column)
    parts = [statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, statistics(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]), np.float32)


@dataclass
class Trees:
    """Complete binary trees of one depth in flat arrays: node k has its children at 2k+1 and 2k+2."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        trees, nodes = self.feature.shape
        depth = (nodes + 1).bit_length() - 1
        at, tree, row = np.zeros((len(x), trees), np.int64), np.arange(trees), np.arange(len(x))[:, None]
        for _ in range(depth):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return self.base + self.value[tree, at - nodes].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 100, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Boosted trees for a 0/1 target under logistic loss; splits are sought among quantile bins."""
    n, f = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    mean = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    out = Trees(float(np.log(mean / (1 - mean))), np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf, np.float32), np.zeros((trees, leaves)))
    if n == 0 or y.min() == y.max():
        return out
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for k in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)])
    margin = np.full(n, out.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width = 2**level
            best, split = np.full(width, 1e-6), [(0, bins)] * width
            for k in range(f):
                sums = [np.bincount(node * bins + binned[k], v, minlength=width * bins).reshape(width, bins).cumsum(axis=1) for v in (g, h)]
                (gl, hl), (gt, ht) = sums, (s[:, -1:] for s in sums)
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < least) | (ht - hl < least)] = -1
                top = gain.argmax(axis=1)
                for w in np.flatnonzero(gain[np.arange(width), top] > best):
                    best[w], split[w] = gain[w, top[w]], (k, int(top[w]))
            right = np.zeros(n, bool)
            for w, (k, b) in enumerate(split):
                at = width - 1 + w
                out.feature[t, at] = k
                if b < len(edges[k]):
                    out.threshold[t, at] = edges[k][b]
                    own = node == w
                    right[own] = binned[k][own] > b
            node = 2 * node + right
        gs, hs = np.bincount(node, g, minlength=leaves), np.bincount(node, h, minlength=leaves)
        out.value[t] = -rate * gs / (hs + ridge)
        margin += out.value[t][node]
    return out


def _sample_statistics(batches):
    for batch in batches:
        x = text_statistics(batch.column(1))
        flat = pa.array(x.reshape(-1), pa.float32())
        rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), rows, batch.column(2)], names=["doc_id", "x", "y"])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAINING_ROWS) -> Trees:
    """Trees from labelled documents whose crc32(identifier as text) mod 4 is not 2.

    At most about `rows` of them are used: beyond that an even share by the identifier's hash. Rows without a label or
    with a null identifier are left out; of repeated labels the least counts. Without both classes the score is
    constant. Only the text enters the score; other columns aren't read, and identifiers may be of any plain type.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (id_crc32(F.col(doc_id)) % 4 != 2))
    known = known.groupBy(F.col(doc_id).alias("known_id")).agg(F.min(F.col(label).cast("int")).alias("known_label"))
    share = min(1.0, rows / max(1, known.count()))
    sample = known.filter(F.pmod(F.xxhash64("known_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # The sample has a fixed bound, so it may be broadcast.
    chosen = docs.select(F.col(doc_id).alias("known_id"), F.col(text).alias("body")).join(F.broadcast(sample), "known_id").select("known_id", "body", "known_label")
    found = chosen.mapInArrow(_sample_statistics, f"doc_id {dict(chosen.dtypes)['known_id']}, x array<float>, y int").orderBy("doc_id", "x").collect()
    width = statistics(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    x = np.array([r["x"] for r in found], np.float32).reshape(len(found), width)
    return grow(x, np.array([r["y"] for r in found], float))


def quality_score(trees: Trees, text: Column) -> Column:
    """Score in [0, 1] of each text as a double; null is scored as the empty text."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(trees.score(text_statistics(column)))

    return score(text)
