"""Scoring with a probabilistic suffix tree over words, whose rare words are spelled by one over bytes.

Frequent contexts, sent to all tasks: words above HOT_SHARE of all training tokens are symbols of their own, and so are the
end of a text, which also stands before its first word, and the escape to any other word. A context of up to `CONTEXT`
symbols is retained if it makes up at least HOT_SHARE of the tokens and the distribution of its next symbol diverges from
that of its longest retained suffix by at least `LEAST_DIVERGENCE`; each token, hot or not, is scored in the longest
retained suffix of what is before it. Distributions are smoothed towards the suffix's by the number of different
successors; successors below HOT_SHARE are left to that smoothing with the mass they have. Counts of longer runs are taken
only where the runs one shorter, at both ends, are frequent, and are summed in each task before they are sent. HOT_SHARE
bounds this part: 1 / HOT_SHARE runs of each length.

A word behind the escape is one of the training words below HOT_SHARE, by their counts, with the probability that a rare
training token is of a word seen more than once (what leaving one out says of meeting a known word), or else spelled in bytes with a space behind it; unknown words are
only spelled, so the probabilities of all texts together are at most 1. The byte tree keeps a context (up to `DEPTH` bytes of
the lower-cased text, across words) if it makes up at least `LEAST_SHARE` of the spelled bytes and its next-byte
distribution diverges from that of its suffix by at least `LEAST_DIVERGENCE`; each byte is scored in the longest retained
suffix. There are at most DEPTH / LEAST_SHARE contexts.

Rare contexts, which grow with the corpus and stay distributed: the word before, if it isn't frequent. All its occurrences
meet in one packed bucket, in which its successors are counted, as symbols: a frequent word, the end or the escape. It is
retained if leaving each occurrence out shows that it predicts better than the suffix, and then smoothed towards that. Longer runs that aren't frequent are no contexts: to
send one row a token there and back takes more disk than the limits of the check tool leave.

The unigram base needs the count of every word; those of rare words are found in the same buckets.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from labelsieve.llm.common import NO_ID, bucket_count, id_crc32, lowered, mix64, modest_batches, packed, slices, stored, text_buffers, unpacked, unsigned_mod, word_hashes, words

DEPTH = 6
LEAST_SHARE = 5e-5
LEAST_DIVERGENCE = 0.01
HOT_SHARE = 2e-6
#: Symbols of the longest frequent context.
CONTEXT = 3
#: Weight of the other parts against the occurrences of a rare context, and what leaving one out must gain in all (log10).
SMOOTHING, LEAST_GAIN = 5.0, 1e-3
#: Different hashes, and occurrences of rare words, that a task gathers before it sends them.
_GATHERED, _SENT_AT_ONCE = 1_500_000, 400_000
_SEGMENT = 256
_END = 0x0A
#: Symbols of words: the escape, the end of a text, then hot words in the order of their hashes; fewer than 2^_BITS.
_ESCAPE, _STOP, _FIRST, _BITS = 0, 1, 2, 20


def symbols(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, word_offsets: np.ndarray, spelled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one row of bytes, each behind DEPTH line feeds; where each begins (n+1); and which bytes belong to words that are spelled."""
    n = len(word_offsets) - 1
    room = ends - starts + 1
    before = np.concatenate([[0], np.cumsum(room)])
    begin = before[word_offsets] + (DEPTH + 1) * np.arange(n + 1)
    owner = np.repeat(np.arange(n), np.diff(word_offsets))
    target = before[:-1] + (DEPTH + 1) * owner + DEPTH
    out = np.full(int(begin[-1]), _END, np.uint8)
    length = ends - starts
    step = np.arange(int(length.sum()))
    cum = np.cumsum(length) - length
    out[step + np.repeat(target - cum, length)] = data[step + np.repeat(starts - cum, length)]
    out[target + length] = 0x20
    flag = np.zeros(len(out) + 1, np.int32)
    flag[target[spelled]] = 1
    flag[(target + length + 1)[spelled]] -= 1
    return out, begin, np.cumsum(flag[:-1]) > 0


def _squeezed(batch: pa.RecordBatch | None, rising: str | None = None) -> pa.RecordBatch | None:
    """The packed batch with each of its cells compressed byte by byte of the values; those of one column as steps, since they rise."""
    if batch is None:
        return None
    coder, columns = zstandard.ZstdCompressor(level=1), [batch.column(0)]
    for name in batch.schema.names[1:]:
        cells = []
        for cell in batch.column(name):
            values = np.frombuffer(cell.as_buffer(), _KIND[name])
            if name == rising:
                values = np.diff(values, prepend=values.dtype.type(0))
            cells.append(coder.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()))
        columns.append(pa.array(cells, pa.binary()))
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names)


def _opened(table: pa.Table, name: str, rising: bool = False) -> np.ndarray:
    """All values of a column that _squeezed has made; rows without any are null or empty."""
    coder, kind, out = zstandard.ZstdDecompressor(), np.dtype(_KIND[name]), []
    for cell in table[name].drop_null():
        body = cell.as_py()
        if body:
            values = np.ascontiguousarray(np.frombuffer(coder.decompress(body), np.uint8).reshape(kind.itemsize, -1).T).view(kind).reshape(-1)
            out.append(np.cumsum(values, dtype=kind) if rising else values)
    return np.concatenate(out) if out else np.zeros(0, kind)


def _merge(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes in order and the sums of their counts."""
    if not len(hashes):
        return hashes, counts
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[cut], np.add.reduceat(counts[order], cut)


class _Gather:
    """Sums of counts by hash, sent as packed buckets when many have been gathered."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.n = buckets, [], 0

    def add(self, hashes: np.ndarray, counts: np.ndarray):
        self.parts.append((hashes, counts))
        self.n += len(hashes)
        if self.n > _GATHERED:
            merged = _merge(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
            self.parts, self.n = [merged], len(merged[0])
            if self.n > _GATHERED // 2:
                yield from self.rest()

    def rest(self):
        if self.parts:
            h, c = _merge(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
            batch = _squeezed(packed((mix64(h) % np.uint64(self.buckets)).astype(np.int32), {"h": h, "n": c}), "h")
            if batch is not None:
                yield batch
        self.parts, self.n = [], 0


def _chunks(batch: pa.RecordBatch, column: int):
    data, offsets = text_buffers(batch.column(column))
    for a, b in slices(offsets):
        own, at = lowered(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
        yield a, b, own, *words(own, at)


def _unique(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = np.sort(values)
    cut = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]])) if len(found) else np.zeros(0, np.int64)
    return found[cut], np.diff(np.concatenate([cut, [len(found)]]))


def _count_words(buckets: int):
    def run(batches):
        held = _Gather(buckets)
        for batch in batches:
            for _, _, own, starts, ends, _ in _chunks(batch, 0):
                yield from held.add(*_unique(word_hashes(own, starts, ends)))
        yield from held.rest()

    return run


def _count_grams(hot: np.ndarray, buckets: int):
    def run(batches):
        held = _Gather(buckets)
        for batch in batches:
            for _, _, own, starts, ends, word_at in _chunks(batch, 0):
                spelled = ~_among(word_hashes(own, starts, ends), hot)
                row, _, counted = symbols(own, starts, ends, word_at, spelled)
                gram = np.zeros(max(len(row) - DEPTH, 0), np.uint64)
                for j in range(DEPTH + 1):
                    gram = (gram << np.uint64(8)) | row[j : j + len(gram)]
                yield from held.add(*_unique(gram[counted[DEPTH:]]))
        yield from held.rest()

    return run


def _summed(table: pa.Table) -> pa.Table:
    h, n = _merge(_opened(table, "h", True), _opened(table, "n"))
    batch = packed(np.full(len(h), table["bucket"][0].as_py(), np.int32), {"h": h, "n": n})
    return pa.Table.from_batches([batch])


def _summed_rows(table: pa.Table) -> pa.Table:
    h, n = _merge(_opened(table, "h", True), _opened(table, "n"))
    return pa.table({"gram": h.astype(np.int64), "n": n})


class Tree:
    """The suffix tree as an automaton: the state after a symbol, and log10 of each symbol's probability in a state."""

    def __init__(self, roots: np.ndarray, contexts: list[tuple[int, int]], symbols_: np.ndarray, counts: np.ndarray, owners: np.ndarray):
        """roots: counts of the 256 symbols; contexts: (length, bytes as a number), with the counts of their successors."""
        states = {(0, 0)}
        for d, v in contexts:
            # Closed under prefixes and suffixes, so that the longest suffix can be followed from symbol to symbol.
            for i in range(d + 1):
                states.update((m, (v >> (8 * (d - i))) & ((1 << (8 * m)) - 1)) for m in range(i + 1))
        order = sorted(states)
        at = {s: k for k, s in enumerate(order)}
        p = np.empty((len(order), 256), np.float64)
        p[0] = (roots + 0.5) / (roots.sum() + 128)
        follow = np.zeros((len(order), 256), np.int32)
        own: dict[int, slice] = {}
        if len(owners):
            cut = np.flatnonzero(np.concatenate([[True], owners[1:] != owners[:-1]])).tolist()
            own = {int(owners[a]): slice(a, b) for a, b in zip(cut, [*cut[1:], len(owners)], strict=True)}
        number = {c: k for k, c in enumerate(contexts)}
        for k, (d, v) in enumerate(order):
            if d:
                back = at[d - 1, v & ((1 << (8 * (d - 1))) - 1)]
                p[k], follow[k] = p[back], follow[back]
                s = own.get(number.get((d, v), -1))
                if s is not None:
                    n, kinds = counts[s].sum(), s.stop - s.start
                    p[k] *= kinds / (n + kinds)
                    p[k, symbols_[s]] += counts[s] / (n + kinds)
            children = [(a, at[d + 1, (v << 8) | a]) for a in range(256) if (d + 1, (v << 8) | a) in at]
            for a, c in children:
                follow[k, a] = c
        self.follow, self.log = follow.reshape(-1), np.log10(p).astype(np.float32).reshape(-1)

    def logs(self, row: np.ndarray) -> np.ndarray:
        """log10 probability of each byte. Segments are walked side by side, each after DEPTH bytes that set its state."""
        n = -(-len(row) // _SEGMENT)
        padded = np.full((n + 1) * _SEGMENT + DEPTH, _END, np.uint8)
        padded[DEPTH : DEPTH + len(row)] = row
        state, log = np.zeros(n, np.int64), np.empty((_SEGMENT, n))
        for t in range(_SEGMENT + DEPTH):
            at = state * 256 + padded[t : t + n * _SEGMENT : _SEGMENT]
            if t >= DEPTH:
                log[t - DEPTH] = self.log[at]
            state = self.follow[at]
        return log.T.reshape(-1)[: len(row)]


def learn(texts: DataFrame, text: str, hot: np.ndarray, buckets: int) -> Tree:
    """The byte tree, from root counts and the retained contexts with their successors' counts."""
    packs = texts.select(text).mapInArrow(_count_grams(hot, buckets), "bucket int, h binary, n binary")
    grams = stored(packs.groupBy("bucket").applyInArrow(_summed_rows, "gram long, n long"), "lm-grams")
    level = F.explode(F.sequence(F.lit(0), F.lit(DEPTH)))
    mask = F.expr("shiftleft(1L, 8 * d) - 1")
    counts = grams.select("gram", "n", level.alias("d")).select("d", F.shiftright("gram", 8).bitwiseAND(mask).alias("ctx"), F.col("gram").bitwiseAND(F.lit(255)).cast("int").alias("sym"), "n")
    counts = stored(counts.groupBy("d", "ctx", "sym").agg(F.sum("n").alias("n")), "lm-counts")
    roots = np.zeros(256)
    for r in counts.filter("d = 0").collect():  # at most 256 rows
        roots[r["sym"]] = r["n"]
    total = roots.sum()
    frequent = counts.filter("d > 0").groupBy("d", "ctx").agg(F.sum("n").alias("all")).filter(F.col("all") >= max(2.0, LEAST_SHARE * total))
    own = counts.join(frequent, ["d", "ctx"])
    suffix = counts.groupBy("d", "ctx").agg(F.sum("n").alias("s_all")).join(counts, ["d", "ctx"]).select((F.col("d") + 1).alias("d"), F.col("ctx").alias("s_ctx"), "sym", F.col("n").alias("s_n"), "s_all")
    paired = own.withColumn("s_ctx", F.col("ctx").bitwiseAND(F.expr("shiftleft(1L, 8 * (d - 1)) - 1"))).join(suffix, ["d", "s_ctx", "sym"])
    gain = F.sum(F.col("n") / F.col("all") * F.log((F.col("n") / F.col("all")) / (F.col("s_n") / F.col("s_all"))))
    kept = paired.groupBy("d", "ctx").agg(gain.alias("kl")).filter(F.col("kl") >= LEAST_DIVERGENCE)
    # At most DEPTH / LEAST_SHARE contexts.
    rows = own.join(kept, ["d", "ctx"]).select("d", "ctx", "sym", "n").orderBy("d", "ctx", "sym").toPandas()
    contexts, owners = [], np.zeros(len(rows), np.int64)
    if len(rows):
        key = rows[["d", "ctx"]].to_numpy()
        new = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])
        contexts, owners = [(int(d), int(c)) for d, c in key[new]], np.cumsum(new) - 1
    return Tree(roots, contexts, rows["sym"].to_numpy(np.int64), rows["n"].to_numpy(np.float64), owners)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the values are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _found(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where each of the values is among the sorted known ones, -1 if it isn't."""
    if not len(known):
        return np.full(len(values), -1, np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def _sequence(h: np.ndarray, word_at: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbols of all texts with the end before and behind each, every symbol's place in its text, and where each word is."""
    n = np.diff(word_at)
    begin = np.concatenate([[0], np.cumsum(n + 2)])
    at = np.arange(len(h)) + 2 * np.repeat(np.arange(len(n)), n) + 1
    seq = np.full(int(begin[-1]), _STOP, np.int64)
    order = np.argsort(h, kind="stable")
    found = np.empty(len(h), np.int64)
    found[order] = _found(h[order], hot)
    seq[at] = np.where(found >= 0, found + _FIRST, _ESCAPE)
    return seq, np.arange(len(seq)) - np.repeat(begin[:-1], n + 2), at


def _runs(keys: list[np.ndarray], seq: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """For each length from 1: which frequent run of so many symbols ends at each place, -1 for none.

    A run's key is the number of the run without its last symbol, followed by that symbol.
    """
    out = [seq]
    for m, known in enumerate(keys, 2):
        shorter, found = out[-1], np.full(len(seq), -1, np.int64)
        use = np.flatnonzero((place[1:] >= m - 1) & (shorter[:-1] >= 0) & (shorter[1:] >= 0)) + 1
        found[use] = _found((shorter[use - 1] << _BITS) | seq[use], known)
        out.append(found)
    return out


def _count_runs(hot: np.ndarray, keys: list[np.ndarray], buckets: int):
    """Counts of the runs one symbol longer than the last of `keys`, where both runs one shorter are frequent."""
    size = len(keys) + 2

    def run(batches):
        held = _Gather(buckets)
        for batch in batches:
            for _, _, own, starts, ends, word_at in _chunks(batch, 0):
                seq, place, _ = _sequence(word_hashes(own, starts, ends), word_at, hot)
                last = _runs(keys, seq, place)[-1]
                use = np.flatnonzero((place[1:] >= size - 1) & (last[:-1] >= 0) & (last[1:] >= 0)) + 1
                yield from held.add(*_unique(((last[use - 1] << _BITS) | seq[use]).view(np.uint64)))
        yield from held.rest()

    return run


def _frequent_rows(least: float):
    def run(table: pa.Table) -> pa.Table:
        h, n = _merge(_opened(table, "h", True), _opened(table, "n"))
        return pa.table({"gram": h[n >= least].astype(np.int64), "n": n[n >= least]})

    return run


class Words:
    """The frequent contexts: `weights[d]` leaves that much to the suffix of a context of d + 1 symbols, and `values[d]` is what it adds for a run of d + 2."""

    def __init__(self, single: np.ndarray, keys: list[np.ndarray], counts: list[np.ndarray]):
        """single: counts of the symbols; keys and counts: the frequent runs of 2, 3, ... symbols, by key."""
        self.keys, self.weights, self.values = keys, [], []
        smoothed = single.astype(np.float64)
        smoothed[:_FIRST] += 1
        self.single = smoothed / smoothed.sum()
        total, before, suffix = single.astype(np.float64), self.single, None
        for d, (key, n) in enumerate(zip(keys, counts, strict=True)):
            context, last = key >> _BITS, key & ((1 << _BITS) - 1)
            # The same run without its first symbol is frequent as well.
            suffix = last if d == 0 else _found((suffix[context] << _BITS) | last, keys[d - 1])
            p, n = before[suffix], n.astype(np.float64)
            size = len(total)
            listed, kinds = np.bincount(context, n, minlength=size), np.bincount(context, minlength=size)
            share, rest = n / total[context], 1 - np.bincount(context, p, minlength=size)
            left = np.maximum(total - listed, 0) / np.maximum(total, 1)
            gain = np.bincount(context, share * np.log(share / p), minlength=size) + left * np.log(np.maximum(left, 1e-12) / np.maximum(rest, 1e-12))
            kept = (kinds > 0) & (gain >= LEAST_DIVERGENCE)
            whole = np.maximum(total, listed) + kinds
            self.weights.append(np.where(kept, (whole - listed) / np.maximum(whole, 1), 1.0).astype(np.float32))
            self.values.append(np.where(kept[context], n / whole[context], 0.0).astype(np.float32))
            total, before = n, self.values[-1] + self.weights[-1][context] * p

    def probabilities(self, runs: list[np.ndarray], place: np.ndarray) -> np.ndarray:
        """Of each symbol in the longest retained suffix of what is before it; not for the ends before texts."""
        p = self.single[runs[0]]
        for d, (weight, value) in enumerate(zip(self.weights, self.values, strict=True)):
            use = np.flatnonzero((place[1:] >= 1) & (runs[d][:-1] >= 0)) + 1
            p[use] *= weight[runs[d][use - 1]]
            hit = np.flatnonzero(runs[d + 1] >= 0)
            p[hit] += value[runs[d + 1][hit]]
        return p


def learn_words(texts: DataFrame, text: str, hot: np.ndarray, single: np.ndarray, buckets: int, hot_share: float = HOT_SHARE) -> Words:
    """The frequent contexts of the training texts."""
    least, keys, counts = max(2.0, hot_share * float(single.sum())), [], []
    for _ in range(CONTEXT):
        packs = texts.select(text).mapInArrow(_count_runs(hot, keys, buckets), "bucket int, h binary, n binary")
        # At most 1 / HOT_SHARE runs.
        found = packs.groupBy("bucket").applyInArrow(_frequent_rows(least), "gram long, n long").toPandas().sort_values("gram")
        keys, counts = [*keys, found["gram"].to_numpy(np.int64)], [*counts, found["n"].to_numpy(np.int64)]
    return Words(single, keys, counts)


#: What a text's own row and a rare word's bucket add to the text.
_DELTA = ("id", "tokens", "known", "log", "score")
_KIND = {"h": "u8", "n": "i8", "id": "i8", "next": "u8", "local": "f4", "own": "f4", "tokens": "i8", "known": "i4", "log": "f8", "score": "f8"}
_HELD = {"h": "u8", "id": "i8", "next": "u8", "local": "f4", "own": "f4"}
_SENT = "bucket int, " + ", ".join(f"{c} binary" for c in [*_HELD, *_DELTA[1:]])
_SUMS = "bucket int, " + ", ".join(f"{c} binary" for c in _DELTA)
#: A successor is known by 46 bits of its hash, above two marks: whether it is no escape, and whether this is a training text.
_HOT, _TRAIN, _NEXT = np.uint64(1), np.uint64(2), np.uint64(((1 << 46) - 1) << 2)


class Model(NamedTuple):
    """What all tasks need to score texts."""

    tree: Tree
    contexts: Words
    hot: np.ndarray
    hot_counts: np.ndarray
    end_count: int
    odds: Rare


class Rare(NamedTuple):
    """Rare training tokens, and how many of them are of a word seen once."""

    tokens: int
    once: int

    @property
    def known(self) -> float:
        """Probability of a training word behind the escape; never 1."""
        return max(0.0, (self.tokens - self.once) / (self.tokens + 1))

    def gain(self, count: np.ndarray, spelling: np.ndarray) -> np.ndarray:
        """log10 of a word's probability behind the escape, less that of its spelling alone."""
        with np.errstate(divide="ignore"):
            listed = np.log(self.known / (1 - self.known) * count / max(1, self.tokens))
        return np.logaddexp(0.0, listed - spelling * np.log(10.0)) / np.log(10.0)


def _own_sums(model: Model, taught: np.ndarray, ids: np.ndarray, own: np.ndarray, starts: np.ndarray, ends: np.ndarray, word_at: np.ndarray) -> tuple[dict, dict]:
    """Of some texts: their sums by all contexts that are known everywhere, and the occurrences of rare words with their
    spelling, their successors as symbols, and those' log10 probabilities so far."""
    tree, contexts, hot = model.tree, model.contexts, model.hot
    n = np.diff(word_at)
    doc = np.repeat(np.arange(len(n)), n)
    h = word_hashes(own, starts, ends)
    seq, place, at = _sequence(h, word_at, hot)
    is_hot = seq[at] >= _FIRST
    row, _, _ = symbols(own, starts, ends, word_at, ~is_hot)
    byte_logs = np.concatenate([[0], np.cumsum(tree.logs(row))])
    target = np.cumsum(ends - starts + 1) - (ends - starts + 1) + (DEPTH + 1) * doc + DEPTH
    spelling = byte_logs[target + (ends - starts) + 1] - byte_logs[target]
    local = np.log10(contexts.probabilities(_runs(contexts.keys, seq, place), place))
    stops = word_at[1:] + 2 * np.arange(len(n)) + 1
    score = local[stops] + np.bincount(doc, local[at] + np.where(is_hot, 0.0, spelling + np.log10(1 - model.odds.known)), minlength=len(n))
    base = np.log10(model.end_count + 0.5) + np.bincount(doc[is_hot], np.log10(model.hot_counts + 0.5)[seq[at[is_hot]] - _FIRST], minlength=len(n))
    known = (int(model.end_count > 0) + np.bincount(doc[is_hot], minlength=len(n))).astype(np.int32)
    sums = {"id": ids, "tokens": n + 1, "known": known, "log": base, "score": score}
    following = np.ones(len(seq), np.uint64)
    following[at] = h
    use = np.flatnonzero(~is_hot)
    next_ = at[use] + 1
    mark = np.where(seq[next_] != _ESCAPE, ((following[next_] >> np.uint64(16)) & _NEXT) | _HOT, np.uint64(0)) | np.where(taught[doc[use]], _TRAIN, np.uint64(0))
    return sums, {"h": h[use], "id": ids[doc[use]], "next": mark, "local": local[next_].astype(np.float32), "own": spelling[use].astype(np.float32)}


def _padded(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with nulls for the columns of the other kind of rows."""
    names = [*_HELD, *_DELTA[1:]]
    nothing = pa.nulls(batch.num_rows, pa.binary())
    return pa.RecordBatch.from_arrays([batch["bucket"], *[batch[c] if c in batch.schema.names else nothing for c in names]], names=["bucket", *names])


def _rows(sums: dict[str, np.ndarray], buckets: int) -> pa.RecordBatch | None:
    """Sums of texts, packed by the bucket of the text."""
    return _squeezed(packed((sums["id"].view(np.uint64) % np.uint64(buckets)).astype(np.int32), {c: x.astype(_KIND[c]) for c, x in sums.items()}), "id")


def _occurrences(model, buckets: int):
    """From texts to two kinds of packed rows: a text's sums so far, by its own bucket, and the occurrences of rare words,
    by the word's bucket."""

    def sent(held: list[dict]):
        if held:
            whole = {c: np.concatenate([x[c] for x in held]) for c in _HELD}
            order = np.argsort(whole["h"])
            whole = {c: x[order] for c, x in whole.items()}
            out = _squeezed(packed((whole["h"] % np.uint64(buckets)).astype(np.int32), whole), "h")
            if out is not None:
                yield _padded(out)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            ids, taught = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            for a, b, own, starts, ends, word_at in _chunks(batch, 1):
                sums, rare = _own_sums(model.value, taught[a:b], ids[a:b], own, starts, ends, word_at)
                yield _padded(_rows(sums, buckets))
                held.append(rare)
                n += len(rare["h"])
                if n > _SENT_AT_ONCE:
                    yield from sent(held)
                    held, n = [], 0
        yield from sent(held)

    return run


def _met(h: np.ndarray, mark: np.ndarray, local: np.ndarray, own: np.ndarray, odds: Rare) -> tuple[np.ndarray, ...]:
    """What the occurrences of a bucket's rare words, in the order of h and successor, add to their texts: known words, base log, and the gain of the contexts and of words that are known."""
    word = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
    following = mark & (_NEXT | _HOT)
    pair = np.concatenate([[0], np.cumsum((h[1:] != h[:-1]) | (following[1:] != following[:-1]))])
    train = (mark & _TRAIN) > 0
    c, c_pair = np.bincount(word, train)[word], np.bincount(pair, train)[pair]
    p = 10.0**local
    mixed = (c_pair + SMOOTHING * p) / (c + SMOOTHING)
    # Leaving one out: what the other occurrences would have said of each training occurrence.
    without = np.log10((c_pair - 1 + SMOOTHING * p) / (c - 1 + SMOOTHING), where=train, out=np.zeros(len(p))) - np.where(train, local, 0)
    kept = (np.bincount(word, without) > LEAST_GAIN)[word]
    return (c > 0).astype(np.int32), np.log10(c + 0.5), np.where(kept, np.log10(mixed) - local, 0.0) + odds.gain(c, own)


def _deltas(buckets: int, odds: Rare):
    empty = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in _DELTA)])

    def run(table: pa.Table) -> pa.Table:
        is_own = table["h"].is_null()
        batches = table.filter(is_own).select(["bucket", *_DELTA]).combine_chunks().to_batches()
        told = table.filter(table["h"].is_valid())
        if told.num_rows:
            h, ids, mark = _opened(told, "h", True), _opened(told, "id"), _opened(told, "next")
            local, spelling = _opened(told, "local").astype(np.float64), _opened(told, "own").astype(np.float64)
            order = np.lexsort((mark & (_NEXT | _HOT), h))
            ids = ids[order]
            added = _met(h[order], mark[order], local[order], spelling[order], odds)
            order = np.argsort(ids, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], ids[order][1:] != ids[order][:-1]]))
            sums = {"id": ids[order][cut]} | {c: np.add.reduceat(x[order], cut) for c, x in zip(_DELTA[2:], added, strict=True)}
            out = _rows(sums, buckets)
            batches.append(pa.RecordBatch.from_arrays([out["bucket"], *[out[c] if c != "tokens" else pa.nulls(out.num_rows, pa.binary()) for c in _DELTA]], schema=empty))
        return pa.Table.from_batches([b.cast(empty) for b in batches], empty)

    return run


def _total(lost: float, tokens: int, kind: pa.DataType):
    """One row per text: its sums, and the base divided by its mass."""

    def run(key, docs: pa.Table, sums: pa.Table) -> pa.Table:
        kinds, inverse, rows = np.unique(docs["id"].to_numpy(), return_inverse=True, return_counts=True)
        at = np.searchsorted(kinds, _opened(sums, "id", True))
        own = np.searchsorted(kinds, _opened(sums.filter(sums["tokens"].is_valid()), "id", True))
        # Rows that repeat identifier and text have each sent the same, so each gets an equal part.
        n = np.rint((np.bincount(own, _opened(sums, "tokens"), minlength=len(kinds)) / rows)[inverse]).astype(np.int64)
        known, log, score = ((np.bincount(at, _opened(sums, c), minlength=len(kinds)) / rows)[inverse] for c in _DELTA[2:])
        return pa.table({"doc_id": docs["doc_id"].cast(kind), "n_tokens": n, "n_known": np.rint(known).astype(np.int64), "train_tokens": np.full(len(n), tokens), "base_score": log - n * lost, "score": score})

    return run


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", train: Column | None = None, buckets: int | None = None, hot_share: float = HOT_SHARE) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Trained on the rows where `train` holds (by default crc32(identifier as text) mod 5 is not 1). Null text counts as
    empty and has the end token alone. Rows that repeat are counted and scored one by one; null identifiers stay, and
    identifiers may be of any plain type. hot_share is the least share of a frequent word. Without training rows every word is unknown and the tree is uniform. An empty
    table gives an empty result; other columns aren't read, unless `train` does.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    buckets = buckets or bucket_count(docs, text)
    chosen = (id_crc32(F.col(doc_id)) % 5 != 1) if train is None else train
    body = F.coalesce(F.col(text), F.lit(""))
    kind = to_arrow_type(docs.schema[doc_id].dataType)
    taught = docs.filter(chosen).select(body.alias("body"))
    packs = taught.mapInArrow(_count_words(buckets), "bucket int, h binary, n binary")
    counts = stored(packs.groupBy("bucket").applyInArrow(_summed, "bucket int, h binary, n binary"), "lm-words")
    ends = taught.count()

    def totals(batches):
        for batch in batches:
            n, _ = unpacked(batch.column(0), "i8")
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (len(n), int(n.sum()), int((n == 1).sum()))], names=["v", "n", "once"])

    found = counts.select("n").mapInArrow(totals, "v long, n long, once long").agg(F.sum("v"), F.sum("n"), F.sum("once")).first()
    kinds, tokens = (found[0] or 0) + int(ends > 0), (found[1] or 0) + ends

    def above(batches):
        for batch in batches:
            h, n = unpacked(batch.column(0), "u8")[0], unpacked(batch.column(1), "i8")[0]
            use = n >= max(2.0, hot_share * tokens)
            yield pa.RecordBatch.from_arrays([pa.array(h[use].astype(np.int64)), pa.array(n[use])], names=["h", "n"])

    # At most 1 / HOT_SHARE words.
    frame = counts.select("h", "n").mapInArrow(above, "h long, n long").toPandas()
    hot, hot_counts = frame["h"].to_numpy(np.int64).view(np.uint64), frame["n"].to_numpy(np.float64)
    order = np.argsort(hot)
    hot, hot_counts = hot[order], hot_counts[order]
    single = np.concatenate([[tokens - ends - hot_counts.sum(), ends], hot_counts])
    odds = Rare(int(single[0]), found[2] or 0)
    # Every part of it is bounded by LEAST_SHARE or HOT_SHARE.
    model = spark.sparkContext.broadcast(Model(learn(taught, "body", hot, buckets), learn_words(taught, "body", hot, single, buckets, hot_share), hot, hot_counts, ends, odds))
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(doc_id).cast("string"), F.lit(str(NO_ID))), body).alias("id"), body.alias("body"), F.coalesce(chosen, F.lit(False)).alias("taught"))
    sent = keyed.select("id", "body", "taught").mapInArrow(_occurrences(model, buckets), _SENT)
    sums = sent.groupBy("bucket").applyInArrow(_deltas(buckets, odds), _SUMS)
    rows = keyed.select("doc_id", "id", unsigned_mod("id", buckets).alias("bucket"))
    lost = float(np.log10(tokens + 0.5 * (kinds + 1)))
    return rows.groupBy("bucket").cogroup(sums.groupBy("bucket")).applyInArrow(
        _total(lost, tokens, kind), f"doc_id {dict(keyed.dtypes)['doc_id']}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
