"""What several of the operators share: word rules, hashes over Arrow buffers, packed buckets, shared storage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII separators.
WORD = r"[^\x20\x09-\x0D]+"
SEPARATORS = r"[\x20\x09-\x0D]+"
#: Text that one step of a vectorised pass holds in memory; a longer single text is taken alone.
CHUNK_BYTES = 1_000_000
#: Text that one bucket of a packed shuffle stands for, in bytes.
BUCKET_BYTES = 8_000_000
#: Null identifiers in packed keys.
NO_ID = -(2**63)

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def count_words(text: Column) -> Column:
    """Number of words of a text as a long; null counts as no words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_crc32(column: Column) -> Column:
    """crc32 of an identifier written as text; null as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir; unset, a local one on a local master, else an error."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="labelsieve-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: a cut of the lineage that survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names with underscores behind them until df has no such columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def modest_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send fewer rows at a time to Python than Spark's default: whole texts may be long, and a batch is held in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def bucket_count(docs: DataFrame, text: str, bytes_per_bucket: int = BUCKET_BYTES) -> int:
    """Buckets for a packed shuffle, in proportion to all bytes of text, so that one bucket's size stays the same."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(8, int(total // bytes_per_bucket) + 1)


# ---- numpy over the byte buffers of Arrow text columns -----------------------------------------------------------


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and its n+1 offsets; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges of at most `limit` bytes each; a row of more is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and n+1 offsets of each text's words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    sep = _SEP[data]
    inside = ~sep
    start, end = inside.copy(), inside.copy()
    start[1:] &= sep[:-1]
    end[:-1] &= sep[1:]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    start[first] = inside[first]
    end[last] = inside[last]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes unchanged."""
    return _LOWER[data]


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASES = tuple(int(x) | 1 for x in mix64(np.array([11, 23, 47], dtype=np.uint64)))
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or of its inverse; kept for the next call unless a text longer than a chunk asked for them."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        step = pow(base, -1, 2**64) if inverse else base
        have = np.full(max(n, 1 << 16), step, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if len(have) <= CHUNK_BYTES + (1 << 16):
            _powers[base, inverse] = have
    return have[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    base = _BASES[0]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers(base, len(data)), out=total[1:])
    return mix64((total[ends] - total[starts]) * powers(base, len(data) + 1, True)[starts])


def gram_hashes(hashes: np.ndarray, at: np.ndarray, n: int, which: int = 1) -> np.ndarray:
    """64-bit hash of the n words from each position of `at`; `which` 1 or 2 gives independent ones."""
    base = _BASES[which]
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(base, len(hashes)), out=total[1:])
    return mix64((total[at + n] - total[at]) * powers(base, len(hashes) + 1, True)[at])


def gram_positions(word_offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every run of n words inside one text: position among all words, the text's number, position in the text."""
    counts = np.maximum(np.diff(word_offsets) - n + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    local = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    return word_offsets[:-1][doc] + local, doc, local


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray, word_offsets: np.ndarray) -> pa.Array:
    """One text per row again: its kept words with one space between them."""
    kept = np.concatenate([[0], np.cumsum(keep)])[word_offsets]
    source, length = starts[keep], (ends - starts)[keep]
    room = length + 1
    full = kept[1:] > kept[:-1]
    room[kept[1:][full] - 1] -= 1
    target = np.concatenate([[0], np.cumsum(room)])
    out = np.full(int(target[-1]), 0x20, np.uint8)
    before = np.cumsum(length) - length
    step = np.arange(int(length.sum()))
    out[step + np.repeat(target[:-1] - before, length)] = data[step + np.repeat(source - before, length)]
    return pa.Array.from_buffers(pa.large_string(), len(kept) - 1, [None, pa.py_buffer(target[kept].astype(np.int64)), pa.py_buffer(out)]).cast(pa.string())


def unsigned_mod(column: str, n: int) -> Column:
    """A long read as unsigned, modulo n: what numpy has for uint64."""
    half = 2**32
    c = F.col(column)
    high, low = F.shiftrightunsigned(c, 32), c.bitwiseAND(F.lit(half - 1))
    return ((high % n * (half % n) + low) % n).cast("int")


# ---- packed buckets ----------------------------------------------------------------------------------------------


def packed(bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch | None:
    """One row per bucket that holds anything: its number and, as binaries, the values of each column in turn."""
    if not len(bucket):
        return None
    order = np.argsort(bucket, kind="stable")
    which = bucket[order]
    cut = np.concatenate([[0], np.flatnonzero(which[1:] != which[:-1]) + 1, [len(which)]])
    arrays = [pa.array(which[cut[:-1]].astype(np.int32))]
    for values in columns.values():
        body = np.ascontiguousarray(values[order])
        arrays.append(pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer((cut * body.itemsize).astype(np.int32)), pa.py_buffer(body)]))
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", *columns])


def unpacked(column: pa.ChunkedArray | pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a packed column, and how many each row had."""
    data, offsets = text_buffers(column.cast(pa.large_binary()) if not isinstance(column, pa.ChunkedArray) else column.cast(pa.large_binary()).combine_chunks())
    values = np.frombuffer(data.tobytes(), kind)
    return values, np.diff(offsets) // np.dtype(kind).itemsize
