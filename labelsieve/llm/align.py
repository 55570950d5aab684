"""Alignment of two tokenizers over the same text, and how firmly each link between their tokens holds corpus-wide.

Both token lists of a text are turned into lists of end offsets in bytes. The shorter list drives a galloping search
(exponential, then binary) into the longer; the ends in both cut the tokens into groups, and the differences of their
ranks say which tokens of one list meet which of the other. The first pass stores each text's token ids (two bytes each)
and counts, summed in each task and then by buckets of pairs, in how many documents a pair of ids is linked. The second pass
aligns the stored ids again and looks up those counts. Pairs above a count are broadcast, as many as KNOWN_PAIRS allows;
the others have few documents each by that, and meet theirs by an equi-join of packed buckets.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsieve.llm.bpe import byte_symbols
from labelsieve.llm.common import bucket_count, modest_batches, packed, shared_path, slices, stored, text_buffers, unpacked

#: Most id pairs whose counts are sent to all tasks (12 bytes each), links laid out at once, pairs a task holds back.
KNOWN_PAIRS, LINKS, HELD_PAIRS = 4_000_000, 4_000_000, 4_000_000
#: Beyond these code points libraries may follow different Unicode versions; such texts take the library that reads the file.
SETTLED = re.compile("[Ͱ-\U0010ffff]")
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteBpe:
    """A byte-level BPE read from a tokenizers file. Texts of settled characters take the quicker library if ids follow the order of merges, so that both must agree."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab, value = told["model"]["vocab"], {c: b for b, c in enumerate(byte_symbols())}
        spelled = {i: bytes(value[c] for c in t) if all(c in value for c in t) else t.encode() for t, i in vocab.items()}
        self.bytes = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        merges = [x if isinstance(x, list) else x.split(" ") for x in told["model"]["merges"]]
        made = [vocab[a + b] for a, b in merges]
        plain = told.get("normalizer") is None and told["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": told["pre_tokenizer"].get("trim_offsets"), "use_regex": True}
        ordered = all(a < b for a, b in zip(made, made[1:])) and (not made or made[0] > max(vocab[c] for c in byte_symbols()))
        self.quick = None
        if plain and ordered:
            ranks = {x: i for i, x in spelled.items() if len(x) == 1} | {spelled[i]: i for i in made}
            self.quick = tiktoken.Encoding("file", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        slow = [k for k, t in enumerate(texts) if self.quick is None or SETTLED.search(t)]
        for k, e in zip(slow, self.tokenizer.encode_batch([texts[k] for k in slow], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, np.int64)
        return [self.quick.encode_to_numpy(t, disallowed_special=()) if o is None else o for t, o in zip(texts, out, strict=True)]


class PieceBpe:
    """A sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        byte = re.compile(r"<0x([0-9A-Fa-f]{2})>")
        self.bytes = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.model.encode(texts, num_threads=1)]


@cache
def _readers(path_a: str, path_b: str) -> tuple[ByteBpe, PieceBpe]:
    return ByteBpe(path_a), PieceBpe(path_b)


def _reached(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each entry of a sorted list the position in another of the first entry not below it.

    Each entry gallops from a guess, in steps that double until its value is passed, and then halves what lies between; all
    entries take their steps together. Every 32nd entry is placed first, from the start on, and says where the others guess.
    """
    n, m = len(short), len(long)
    guess = np.zeros(n, np.int64) if n <= 32 else np.interp(np.arange(n), np.arange(0, n, 32), _reached(short[::32], long)).astype(np.int64)
    guess = np.minimum(guess, m - 1)
    right = long[guess] < short
    # What is sought is in (low, high].
    low, high = np.where(right, guess, -1), np.where(right, m, guess)
    live, step = np.arange(n), 1
    while len(live):
        at = np.where(right[live], guess[live] + step, guess[live] - step)
        inside = (at >= 0) & (at < m)
        live, at = live[inside], at[inside]
        below = long[at] < short[live]
        low[live[below]], high[live[~below]] = at[below], at[~below]
        live, step = live[below == right[live]], step * 2
    live = np.flatnonzero(high - low > 1)
    while len(live):
        mid = (low[live] + high[live]) >> 1
        below = long[mid] < short[live]
        low[live[below]], high[live[~below]] = mid[below], mid[~below]
        live = live[high[live] - low[live] > 1]
    return high


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in both sorted lists of the values that both hold; the shorter list drives."""
    if not len(short) or not len(long):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = _reached(short, long)
    met = at < len(long)
    met[met] = long[at[met]] == short[met]
    return np.flatnonzero(met), at[met]


class Aligned:
    """Token groups of some texts: ids in turn and, by group, where its tokens begin and its text.

    a, b: all ids; at_a, at_b: n+1 offsets of each text's ids. Each text's tokens spell the same bytes in both lists.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, bytes_a: np.ndarray, bytes_b: np.ndarray):
        self.a, self.b, self.at_a, self.at_b, self.bytes_b = a, b, at_a, at_b, bytes_b
        ends_a, ends_b = np.cumsum(bytes_a[a]), np.cumsum(bytes_b[b])
        swap = len(a) > len(b)
        i, j = gallop(*((ends_b, ends_a) if swap else (ends_a, ends_b)))
        last_a, last_b = (j, i) if swap else (i, j)
        self.from_a, self.to_a = np.concatenate([[0], last_a[:-1] + 1])[: len(last_a)], last_a + 1
        self.from_b, self.to_b = np.concatenate([[0], last_b[:-1] + 1])[: len(last_b)], last_b + 1
        self.size_a, self.size_b = self.to_a - self.from_a, self.to_b - self.from_b
        self.text = np.searchsorted(at_a, self.from_a, side="right") - 1

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of each group by text, in whole numbers."""
        total = np.concatenate([[0], np.cumsum(values)])
        cut = np.searchsorted(self.text, np.arange(len(self.at_a)))
        return total[cut[1:]] - total[cut[:-1]]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times): how often each pair of ids is linked in each text, ordered by pair; a pair is a * (ids of B) + b.

        Links are laid out by the million and put together at once; of a group of more its different ids are.
        """
        texts, wide = len(self.at_a) - 1, len(self.bytes_b)
        size, parts = self.size_a * self.size_b, []
        for g in np.flatnonzero(size > LINKS):
            (ids_a, n_a), (ids_b, n_b) = np.unique(self.a[self.from_a[g] : self.to_a[g]], return_counts=True), np.unique(self.b[self.from_b[g] : self.to_b[g]], return_counts=True)
            parts.append((((ids_a[:, None] * wide + ids_b) * texts + self.text[g]).reshape(-1), (n_a[:, None] * n_b).reshape(-1)))
        rest = np.flatnonzero(size <= LINKS)
        first, total = 0, np.concatenate([[0], np.cumsum(size[rest])])
        while first < len(rest):
            last = max(first + 1, int(np.searchsorted(total, total[first] + LINKS, side="right")) - 1)
            own = rest[first:last]
            group = np.repeat(np.arange(len(own)), size[own])
            i, j = np.divmod(np.arange(len(group)) - (total[first:last] - total[first])[group], self.size_b[own][group])
            pair = self.a[self.from_a[own][group] + i] * wide + self.b[self.from_b[own][group] + j]
            parts.append(np.unique(pair * texts + self.text[own][group], return_counts=True))
            first = last
        if not parts:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        key, times = parts[0]
        if len(parts) > 1:
            key, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            times = np.zeros(len(key), np.int64)
            np.add.at(times, where, np.concatenate([t for _, t in parts]))
        return key % texts, key // texts, times

    def written(self, shown: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts' groups, `a1,a2|b1;a3|b2`, and n+1 offsets; each text ends with a `;`. shown: each id with the three marks."""
        place = np.empty(len(self.a) + len(self.b), np.int64)
        of_a = np.repeat(np.arange(len(self.size_a)), self.size_a)
        of_b = np.repeat(np.arange(len(self.size_b)), self.size_b)
        mark_a, mark_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        mark_a[self.to_a - 1], mark_b[self.to_b - 1] = 1, 2
        place[np.arange(len(self.a)) + self.from_b[of_a]] = self.a * 3 + mark_a
        place[np.arange(len(self.b)) + self.to_a[of_b]] = self.b * 3 + mark_b
        data, offsets = text_buffers(shown.take(pa.array(place)))
        return data, offsets[self.at_a + self.at_b]


def _encoded(texts: pa.Array, a_reader: ByteBpe, b_reader: PieceBpe, tables: tuple) -> tuple:
    """Ids of both lists, empty where a text has none or its bytes are not spelled; and offsets of both."""
    given = [x or "" for x in texts.to_pylist()]
    use = [k for k, t in enumerate(given) if t]
    a, b = a_reader.encode([" " + given[k] for k in use]), b_reader.encode([given[k] for k in use])
    flat_a, flat_b = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (a, b))
    ends_a, ends_b = np.cumsum([0, *map(len, a)]), np.cumsum([0, *map(len, b)])
    (spelled_a, bytes_a), (spelled_b, bytes_b) = (text_buffers(t.take(pa.array(x))) for t, x in zip(tables, (flat_a, flat_b), strict=True))
    keep_a, keep_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    n_a, n_b = np.zeros(len(given), np.int64), np.zeros(len(given), np.int64)
    for k, i in enumerate(use):
        whole = b" " + given[i].encode()
        if spelled_a[bytes_a[ends_a[k]] : bytes_a[ends_a[k + 1]]].tobytes() == whole and spelled_b[bytes_b[ends_b[k]] : bytes_b[ends_b[k + 1]]].tobytes() == whole:
            keep_a.append(flat_a[ends_a[k] : ends_a[k + 1]])
            keep_b.append(flat_b[ends_b[k] : ends_b[k + 1]])
            n_a[i], n_b[i] = len(keep_a[-1]), len(keep_b[-1])
    return np.concatenate(keep_a), np.concatenate(keep_b), np.concatenate([[0], np.cumsum(n_a)]), np.concatenate([[0], np.cumsum(n_b)])


def _lengths(path_a: str, path_b: str) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.array([len(x) for x in r.bytes], np.int64) for r in _readers(path_a, path_b))


def _binary(ids: np.ndarray, at: np.ndarray, kind: str) -> pa.Array:
    body = ids.astype(kind)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * body.itemsize).astype(np.int32)), pa.py_buffer(body)])


def _bucket(pair: np.ndarray, buckets: int) -> np.ndarray:
    return ((pair.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def _align(path_a: str, path_b: str, kind: str, buckets: int):
    """Rows of the texts, and after them the task's pair counts as rows of packed buckets (bucket not null)."""

    def run(batches):
        a_reader, b_reader = _readers(path_a, path_b)
        bytes_a, bytes_b = _lengths(path_a, path_b)
        tables = pa.array(a_reader.bytes, pa.large_binary()), pa.array(b_reader.bytes, pa.large_binary())
        shown = pa.array([f"{i}{mark}" for i in range(max(len(bytes_a), len(bytes_b))) for mark in ",|;"], pa.large_string())
        held, held_n, schema = [], 0, None

        def counts():
            nonlocal held, held_n
            if not held or schema is None:
                return None
            pair, n = np.concatenate([p for p, _ in held]), np.concatenate([c for _, c in held])
            pair, where = np.unique(pair, return_inverse=True)
            n = np.bincount(where, weights=n, minlength=len(pair)).astype(np.int64)
            held, held_n = [(pair, n)], len(pair)
            return pair, n

        def told():
            nonlocal held, held_n
            found = counts()
            if found is None:
                return None
            pair, n = found
            out = packed(_bucket(pair, buckets), {"pair": pair, "n": n})
            held, held_n = [], 0
            if out is None:
                return None
            nulls = [pa.nulls(out.num_rows, f.type) for f in schema]
            return pa.RecordBatch.from_arrays([*nulls, *out.columns], names=[*[f.name for f in schema], "bucket", "pair", "n"])

        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            _, offsets = text_buffers(text)
            schema = [*batch.schema][:-1] + [pa.field("ids_a", pa.binary()), pa.field("ids_b", pa.binary()), *[pa.field(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.field("groups_sha256", pa.string())]
            for lo, hi in slices(offsets):
                a, b, at_a, at_b = _encoded(text.slice(lo, hi - lo), a_reader, b_reader, tables)
                found = Aligned(a, b, at_a, at_b, bytes_a, bytes_b)
                data, cut = found.written(shown)
                whole = memoryview(data.tobytes())
                sha = [hashlib.sha256(whole[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                pair = found.links()[1]
                new = np.flatnonzero(np.diff(pair, prepend=-1))
                held.append((pair[new], np.diff(np.append(new, len(pair)))))
                held_n += len(new)
                arrays = [c.slice(lo, hi - lo) for c in batch.columns[:-1]]
                arrays += [_binary(a, at_a, kind), _binary(b, at_b, kind), pa.array(np.diff(at_a)), pa.array(np.diff(at_b)), pa.array(found.per_text(np.ones(len(found.text), np.int64))), pa.array(found.per_text(found.size_a * found.size_b)), pa.array(sha)]
                empty = [pa.nulls(hi - lo, k) for k in (pa.int32(), pa.binary(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*arrays, *empty], names=[*[f.name for f in schema], "bucket", "pair", "n"])
                if held_n > HELD_PAIRS:
                    counts()
                    if held_n > HELD_PAIRS // 2:
                        yield told()
        out = told()
        if out is not None:
            yield out

    return run


def _add_pairs(table: pa.Table) -> pa.Table:
    """One bucket's pairs with their numbers of documents."""
    pair, n = unpacked(table["pair"], "i8")[0], unpacked(table["n"], "i8")[0]
    pair, where = np.unique(pair, return_inverse=True)
    total = np.zeros(len(pair), np.int64)
    np.add.at(total, where, n)
    return pa.table({"bucket": table["bucket"].slice(0, 1), "pair": pa.array([pair.tobytes()], pa.binary()), "n": pa.array([total.tobytes()], pa.binary())})


def _highest(wide: int):
    """(a, most): the highest count of each first id in a bucket."""

    def run(batches):
        for batch in batches:
            for pair, n in zip(batch.column(1), batch.column(2), strict=True):
                pair, n = np.frombuffer(pair.as_py(), "i8"), np.frombuffer(n.as_py(), "i8")
                a, at = np.unique(pair // wide, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.maximum.reduceat(n, at))], names=["a", "most"])

    return run


def _sizes(batches):
    """(power, pairs): how many pairs have a count of up to 2 ** power but over half of that."""
    for batch in batches:
        power, times = np.unique(np.ceil(np.log2(unpacked(batch.column(2), "i8")[0])).astype(np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(power), pa.array(times)], names=["power", "pairs"])


def _above(least: int):
    def run(batches):
        for batch in batches:
            pair, n = unpacked(batch.column(1), "i8")[0], unpacked(batch.column(2), "i8")[0]
            use = n > least
            yield pa.RecordBatch.from_arrays([pa.array([pair[use].tobytes()], pa.binary()), pa.array([n[use].astype(np.int64).tobytes()], pa.binary())], names=["pair", "n"])

    return run


def _sums(path_a: str, path_b: str, kind: str, known, light: int | None):
    """The rows with n_best and count_sum of the broadcast pairs; or, with `light` buckets, packed rows of the other pairs.

    The columns end with row, ids_a and ids_b.
    """

    def run(batches):
        pairs, counts, most = known.value
        bytes_a, bytes_b = _lengths(path_a, path_b)
        for batch in batches:
            (a, n_a), (b, n_b) = (unpacked(batch.column(batch.num_columns + c), kind) for c in (-2, -1))
            rows = batch.column(batch.num_columns - 3).to_numpy()
            at_a, at_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
            best, total = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            for lo, hi in slices(at_a, 400_000):
                found = Aligned(a[at_a[lo] : at_a[hi]].astype(np.int64), b[at_b[lo] : at_b[hi]].astype(np.int64), at_a[lo : hi + 1] - at_a[lo], at_b[lo : hi + 1] - at_b[lo], bytes_a, bytes_b)
                text, pair, times = found.links()
                at = np.searchsorted(pairs, pair)
                met = at < len(pairs)
                met[met] = pairs[at[met]] == pair[met]
                if light is None:
                    text, pair, times, n = text[met] + lo, pair[met], times[met], counts[at[met]].astype(np.int64)
                    np.add.at(total, text, n * times)
                    np.add.at(best, text, (n == most[pair // len(bytes_b)]) * times)
                elif not met.all():
                    pair = pair[~met]
                    yield packed(_bucket(pair, light), {"row": rows[text[~met] + lo], "pair": pair, "times": times[~met]})
            if light is None:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best), pa.array(total)], names=[*batch.schema.names, "n_best", "count_sum"])

    return run


def _met(most, wide: int):
    """Sums of one bucket's links with the bucket's counts, by row."""

    def run(links: pa.Table, counts: pa.Table) -> pa.Table:
        row, pair, times = (unpacked(links[c], "i8")[0] for c in ("row", "pair", "times"))
        known, n = (unpacked(counts[c], "i8")[0] for c in ("pair", "n"))
        n = n[np.searchsorted(known, pair)] if len(pair) else np.zeros(0, np.int64)
        rows, where = np.unique(row, return_inverse=True)
        best, total = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        np.add.at(best, where, (n == most.value[pair // wide]) * times)
        np.add.at(total, where, n * times)
        return pa.table({"row": rows, "more_best": best, "more_sum": total})

    return run


def aligned_docs(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None, known_pairs: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and the ids as packed binaries.

    Null and empty texts, and texts that some tokenizer doesn't spell byte for byte, have no tokens: zeros, and '' for the
    digest. Rows that repeat an identifier are documents of their own. An empty table gives an empty result; other
    columns aren't read. Very long texts are taken alone; a group of very many tokens is laid out by its different ids.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    known_pairs = KNOWN_PAIRS if known_pairs is None else known_pairs
    a_reader, b_reader = _readers(path_a, path_b)
    kind = "u2" if max(len(a_reader.bytes), len(b_reader.bytes)) <= 1 << 16 else "u4"
    buckets = buckets or bucket_count(docs, text)
    wide = len(b_reader.bytes)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("body"))
    own = f"row long, doc_id {dict(rows.dtypes)['doc_id']}, ids_a binary, ids_b binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    schema = f"{own}, bucket int, pair binary, n binary"
    path = shared_path(spark, "aligned")
    rows.mapInArrow(_align(path_a, path_b, kind, buckets), schema).write.option("compression", "zstd").parquet(path)
    told = spark.read.schema(schema).parquet(path)
    counted = stored(told.filter("bucket is not null").select("bucket", "pair", "n").groupBy("bucket").applyInArrow(_add_pairs, "bucket int, pair binary, n binary"), "pairs")
    most = np.zeros(len(a_reader.bytes), np.int64)
    for r in counted.mapInArrow(_highest(wide), "a long, most long").groupBy("a").agg(F.max("most").alias("most")).collect():  # one row per id of a vocabulary
        most[r["a"]] = r["most"]
    # The least power of two above which there are few enough pairs; those of at most as many documents are no hot keys.
    least, above = 0, 0
    for r in counted.mapInArrow(_sizes, "power long, pairs long").groupBy("power").agg(F.sum("pairs").alias("pairs")).orderBy(F.desc("power")).collect():  # at most 64 rows
        above += r["pairs"]
        if above > known_pairs:
            least = 2 ** r["power"]
            break
    frequent = counted.mapInArrow(_above(least), "pair binary, n binary").toArrow()  # at most known_pairs pairs
    pairs, n = unpacked(frequent["pair"], "i8")[0], unpacked(frequent["n"], "i8")[0]
    order = np.argsort(pairs)
    counts = n[order].astype(np.int32 if n.max(initial=0) < 2**31 else np.int64)
    known = spark.sparkContext.broadcast((pairs[order], counts, most))
    out = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "ids_a", "ids_b"]
    texts = told.filter("bucket is null").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "row", "ids_a", "ids_b")
    sums = texts.mapInArrow(_sums(path_a, path_b, kind, known, None), ", ".join(f"{c} {t}" for c, t in texts.dtypes) + ", n_best long, count_sum long")
    if not least:
        return sums.select(*out)
    links = texts.select("row", "ids_a", "ids_b").mapInArrow(_sums(path_a, path_b, kind, known, buckets), "bucket int, row binary, pair binary, times binary")
    rest = links.groupBy("bucket").cogroup(counted.groupBy("bucket")).applyInArrow(_met(spark.sparkContext.broadcast(most), wide), "row long, more_best long, more_sum long")
    more = rest.groupBy("row").agg(F.sum("more_best").alias("more_best"), F.sum("more_sum").alias("more_sum"))
    added = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))}
    return sums.join(more, "row", "left").withColumns(added).select(*out)
