"""Substring dedup with difference-cover anchors.

A set C of residues covers the differences modulo v if any two positions i, j have a shift d < v that puts both on C.
Grams of k = window - v + 1 words are therefore hashed only at positions in C modulo v: two equal windows share one such
aligned anchor. Anchors that occur once are dropped; around the others every window that holds one is hashed whole,
and a window that occurs again anywhere is a repeat.

Hashes travel in packed buckets (see `common`): a bucket stands for a fixed amount of text, equal hashes of one chunk
are put together before the shuffle, and so a passage found in very many documents sends one row a chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from labelsieve.llm.common import NO_ID, bucket_count, gram_hashes, gram_positions, joined_words, packed, slices, text_buffers, unpacked, unsigned_mod, word_hashes, words

#: Perfect difference sets: every difference modulo v occurs, with the fewest residues.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 6, 8, 18)}
_PACKED = "bucket int, h binary, id binary, pos binary, many binary"


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The widest cover that leaves anchors of at least two fifths of the window."""
    fitting = [v for v in COVERS if window - v + 1 >= max(1, 2 * window // 5)]
    return (max(fitting), COVERS[max(fitting)]) if fitting else (1, (0,))


def _send(hashes: np.ndarray, bucket_hash: np.ndarray, ids: np.ndarray, pos: np.ndarray, buckets: int, narrow: bool) -> pa.RecordBatch | None:
    """Packed rows of one chunk. Of equal hashes the first carries 1 in `many`; the others, already known to be repeats, carry 2."""
    if not len(hashes):
        return None
    order = np.argsort(hashes, kind="stable")
    sorted_hashes = hashes[order]
    equal = sorted_hashes[1:] == sorted_hashes[:-1]
    many = np.zeros(len(hashes), np.uint8)
    many[order[:-1][equal]] = 1
    many[order[1:][equal]] = 2
    bucket = (bucket_hash % np.uint64(buckets)).astype(np.int32)
    out = pos.astype(np.uint32)
    return packed(bucket, {"h": (hashes >> np.uint64(32)).astype(np.uint32) if narrow else hashes, "id": ids, "pos": out, "many": many})


def _found(table: pa.Table, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers and positions of the hashes of a bucket that occur more than once."""
    h, _ = unpacked(table["h"], "u8" if wide else "u4")
    ids, pos, many = (unpacked(table[c], k)[0] for c, k in (("id", "i8"), ("pos", "u4"), ("many", "u1")))
    open_ = np.flatnonzero(many < 2)
    order = open_[np.argsort(h[open_], kind="stable")]
    s = h[order]
    equal = s[1:] == s[:-1]
    hit = many > 0
    hit[order[1:][equal]] = True
    hit[order[:-1][equal]] = True
    return ids[hit], pos[hit]


def _repeats(buckets: int, wide: bool):
    """From a bucket of hashes to packed (identifier, position) pairs by the identifier's bucket."""

    def run(table: pa.Table) -> pa.Table:
        ids, pos = _found(table, wide)
        batch = packed((ids.view(np.uint64) % np.uint64(buckets)).astype(np.int32), {"id": ids, "pos": pos})
        empty = pa.schema([("bucket", pa.int32()), ("id", pa.binary()), ("pos", pa.binary())])
        return pa.Table.from_batches([batch] if batch is not None else [], empty)

    return run


def _anchors(window: int, buckets: int):
    v, cover = cover_for(window)
    k = window - v + 1
    on_cover = np.zeros(v, bool)
    on_cover[list(cover)] = True

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets):
                own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, word_at = words(own, at)
                place, doc, local = gram_positions(word_at, k)
                # A text shorter than the window holds no window, so it needs no anchor.
                use = on_cover[local % v] & (np.diff(word_at) >= window)[doc]
                place, doc, local = place[use], doc[use], local[use]
                if len(place):
                    hashed = word_hashes(own, starts, ends)
                    h = gram_hashes(hashed, place, k)
                    out = _send(h, h, ids[a:b][doc], local, buckets, True)
                    if out is not None:
                        yield out

    return run


def _positions(table: pa.Table, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of `ids` and position for each packed pair. Rows that repeat an identifier all get its positions."""
    if not table.num_rows or not len(ids):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    told, pos = unpacked(table["id"], "i8")[0], unpacked(table["pos"], "u4")[0].astype(np.int64)
    order = np.argsort(ids, kind="stable")
    s = ids[order]
    low, high = np.searchsorted(s, told, "left"), np.searchsorted(s, told, "right")
    n = high - low
    row = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return order[row], np.repeat(pos, n)


def _windows(window: int, buckets: int):
    v, _ = cover_for(window)

    def run(key, docs: pa.Table, hits: pa.Table) -> pa.Table:
        ids = docs["id"].to_numpy()
        row, pos = _positions(hits, ids)
        out = []
        if len(row):
            data, offsets = text_buffers(docs["body"])
            marked = np.unique((row << 32) | pos)
            row, pos = marked >> 32, marked & 0xFFFFFFFF
            for a, b in slices(offsets):
                own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                low, high = np.searchsorted(row, [a, b])
                if low == high:
                    continue
                starts, ends, word_at = words(own, at)
                # Windows that hold a marked anchor begin at most v - 1 words before it.
                flag = np.zeros(int(word_at[-1]) + v + 1, np.int32)
                anchor_doc = row[low:high] - a
                anchor = word_at[anchor_doc] + pos[low:high]
                np.add.at(flag, np.maximum(anchor - (v - 1), word_at[anchor_doc]), 1)
                np.add.at(flag, anchor + 1, -1)
                place, doc, local = gram_positions(word_at, window)
                use = np.cumsum(flag)[place] > 0
                place, doc, local = place[use], doc[use], local[use]
                if len(place):
                    hashed = word_hashes(own, starts, ends)
                    batch = _send(gram_hashes(hashed, place, window), gram_hashes(hashed, place, window, 2), ids[a:b][doc], local, buckets, False)
                    if batch is not None:
                        out.append(batch)
        empty = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("h", "id", "pos", "many"))])
        return pa.Table.from_batches(out, empty)

    return run


def _cut(window: int, kind: pa.DataType):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(key, docs: pa.Table, hits: pa.Table) -> pa.Table:
        ids = docs["id"].to_numpy()
        row, pos = _positions(hits, ids)
        order = np.argsort(row, kind="stable")
        row, pos = row[order], pos[order]
        data, offsets = text_buffers(docs["body"])
        named = docs["doc_id"].combine_chunks()
        out = []
        for a, b in slices(offsets):
            own, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            starts, ends, word_at = words(own, at)
            low, high = np.searchsorted(row, [a, b])
            flag = np.zeros(int(word_at[-1]) + 1, np.int32)
            begin = word_at[row[low:high] - a] + pos[low:high]
            np.add.at(flag, begin, 1)
            np.add.at(flag, begin + window, -1)
            gone = np.cumsum(flag)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            # Spans of removed words, as word numbers in their text.
            edge = np.concatenate([[True], gone[1:] != gone[:-1]]) if len(gone) else np.zeros(0, bool)
            edge[word_at[:-1][word_at[:-1] < len(gone)]] = True
            first = np.flatnonzero(edge)
            last = np.concatenate([first[1:], [len(gone)]]) if len(first) else first
            first, last = first[gone[first]], last[gone[first]]
            owner = np.searchsorted(word_at, first, side="right") - 1
            spans = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=b - a))]), pa.int32()),
                pa.StructArray.from_arrays([pa.array(first - word_at[owner], pa.int64()), pa.array(last - word_at[owner], pa.int64())], names=["start", "end"]),
            )
            removed = np.diff(total[word_at])
            cols = [named.slice(a, b - a), pa.array(np.diff(word_at)), pa.array(removed), joined_words(own, starts, ends, ~gone, word_at), spans]
            out.append(pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_text", "removed_spans"]))
        empty = pa.schema([("doc_id", kind), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("removed_spans", span)])
        return pa.Table.from_batches(out, empty)

    return run


def remove_repeats(docs: DataFrame, window: int = 35, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text, removed_spans (word numbers, half open).

    A word goes if any window of `window` words that covers it has the same words as a window that starts elsewhere, in
    the same text or another; windows are judged on the input. Words keep their case. Null, empty and short texts lose
    nothing. Rows that repeat, identifier included, are occurrences of their own and get equal results. Null identifiers
    are kept, and identifiers may be of any plain type. An empty table gives an empty result; other columns are not read.
    """
    buckets = buckets or bucket_count(docs, text)
    body = F.coalesce(F.col(text), F.lit(""))
    # A row is known by a hash of identifier and text, so that an identifier used twice does no harm.
    keyed = docs.select(F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit(str(NO_ID))), body).alias("id"), F.col(doc_id).alias("doc_id"), body.alias("body"))
    kind = to_arrow_type(keyed.schema["doc_id"].dataType)
    hits = "bucket int, id binary, pos binary"
    anchors = keyed.select("id", "body").mapInArrow(_anchors(window, buckets), _PACKED)
    marked = anchors.groupBy("bucket").applyInArrow(_repeats(buckets, False), hits)
    by_id = keyed.withColumn("bucket", unsigned_mod("id", buckets))
    windows = by_id.groupBy("bucket").cogroup(marked.groupBy("bucket")).applyInArrow(_windows(window, buckets), _PACKED)
    repeats = windows.groupBy("bucket").applyInArrow(_repeats(buckets, True), hits)
    return by_id.groupBy("bucket").cogroup(repeats.groupBy("bucket")).applyInArrow(
        _cut(window, kind), f"doc_id {dict(keyed.dtypes)['doc_id']}, n_words long, n_removed long, kept_text string, removed_spans array<struct<start: long, end: long>>"
    )
