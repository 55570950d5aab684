"""N-gram Jaccard join: a size-aware heavy-light join over word shingles.

Equal sets are put together first. Small (light) sets enumerate their subsets of each size that a partner must share;
two of them that meet in a subset are judged by their sizes alone. Large (heavy) sets go into inverted lists of their
rarest shingles (as many as a partner can't miss all of), and the lists are scanned. The boundary between the two is
chosen by cost from the sizes of all sets.

Of lists that hold the same sets one is scanned. A list keeps a set only if it has a partner there of a fitting size, the smaller of the two with the shingle among so few
first ones that the overlap can still be reached. A scan rejects pairs by sizes and by a sketch: for each of some cells
whether it holds an odd number of members, which differs in no more cells than the sets differ in members; the wider of two
is folded. First each set is paired with one partner of a list, by sketches of at most SKETCH cells; what whole sets
confirm as links makes components, and the last scan only looks at pairs of different components, by whole sketches, as
wide as a set's size needs. It looks at all of those inside a task and gives those that are left possible, so no link between components is lost,
and many unlinked near copies give few pairs, however long they are. Lists of more than TILE sets are cut into tiles.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsieve.llm.common import bucket_count, gram_hashes, lowered, mix64, modest_batches, packed, slices, stored, text_buffers, unpacked, unsigned_mod, word_hashes, words
from labelsieve.llm.components import components

#: Counters of the shingle frequency table; its size is fixed, and it only orders shingles.
COUNTERS = 1 << 22
_SLICES = 64
#: Most cells of a sketch that goes with every list, sets of one side of a tile, and the list length up to which all pairs are looked at at once.
SKETCH, TILE, SHORT = 1024, 2000, 64
#: Scans that pair each set of a list with one partner, before the one that looks at all pairs between components.
PARTNER_ROUNDS = 2


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each different shingle, ordered by both. A text of fewer words has one shingle, all of them."""
    own = lowered(data)
    starts, ends, word_at = words(own, offsets)
    hashed = word_hashes(own, starts, ends)
    count = np.diff(word_at)
    grams = np.maximum(count - n + 1, 0)
    doc = np.repeat(np.arange(len(count)), grams)
    place = word_at[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(grams) - grams, grams)
    docs, hashes = [doc], [gram_hashes(hashed, place, n)]
    for k in range(1, n):
        few = np.flatnonzero(count == k)
        docs.append(few)
        hashes.append(gram_hashes(hashed, word_at[:-1][few], k))
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(doc) else np.zeros(0, bool)
    return doc[new], h[new]


def _set_keys(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size of each text's set and a hash of the whole set."""
    size = np.bincount(doc, minlength=n)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix64(h), out=total[1:])
    at = np.concatenate([[0], np.cumsum(size)])
    return size, mix64((total[at[1:]] - total[at[:-1]]) ^ size.astype(np.uint64)).view(np.int64)


class Rule:
    """Link when percent / 100 * union <= intersection, in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def least_size(self, size):
        """Smallest partner of a set, and least overlap with any."""
        return -(-self.percent * size // 100)

    def missing(self, size):
        """Most members of a set that a partner may lack."""
        return size - self.least_size(size)

    def apart(self, total):
        """Most members in which two linked sets of `total` members together differ."""
        return total - 2 * -(-self.percent * total // (100 + self.percent))

    def cells(self, size: np.ndarray) -> np.ndarray:
        """Width of a set's whole sketch: a power of two, 16 times what a partner of the same size may differ in, 64 at least."""
        need = np.maximum(16 * self.apart(2 * size), 64)
        return (1 << np.ceil(np.log2(need)).astype(np.int64)).astype(np.int64)

    def holds(self, overlap, a, b):
        return 100 * overlap >= self.percent * (a + b - overlap)


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Rows of single bits to packed sketches of fewer cells: neighbouring cells are added."""
    return np.packbits(np.bitwise_xor.reduce(bits.reshape(len(bits), width, -1), axis=2), axis=1)


def _sketch(n: int, rule: Rule):
    """Narrow rows of all texts, and the task's share of the frequency table in slices."""
    width = COUNTERS // _SLICES

    def run(batches):
        table = np.zeros(COUNTERS, np.int32)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets):
                doc, h = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                size, key = _set_keys(doc, h, b - a)
                cell, times = np.unique(h % np.uint64(COUNTERS), return_counts=True)
                table[cell] += times.astype(np.int32)
                ids = batch.column(0).slice(a, b - a)
                cell = rule.cells(size)
                begin = np.concatenate([[0], np.cumsum(cell)])
                power = np.log2(cell).astype(np.uint64)
                bits = (np.bincount(begin[doc] + (h >> (np.uint64(64) - power[doc])).astype(np.int64), minlength=begin[-1]) & 1).astype(np.uint8)
                short = np.minimum(cell, SKETCH)
                at = np.concatenate([[0], np.cumsum(short // 8)])
                body = np.zeros(at[-1], np.uint8)
                for w in np.unique(cell):
                    for own in np.array_split(np.flatnonzero(cell == w), max(1, int(w * (cell == w).sum()) >> 24)):
                        parity = bits[begin[own][:, None] + np.arange(w)]
                        body[at[own][:, None] + np.arange(min(w, SKETCH) // 8)] = _fold(parity, min(w, SKETCH))
                sketch = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(body)])
                # Sets of more cells have their whole sketch too, for the last scan.
                long = cell > SKETCH
                whole = np.packbits(bits[np.repeat(long, cell)])
                long_at = np.concatenate([[0], np.cumsum(np.where(long, cell // 8, 0))])
                wide = pa.Array.from_buffers(pa.binary(), b - a, [pa.py_buffer(np.packbits(long, bitorder="little")), pa.py_buffer(long_at.astype(np.int32)), pa.py_buffer(whole)])
                yield pa.RecordBatch.from_arrays([ids, pa.array(size), pa.array(key), pa.nulls(b - a, pa.int32()), sketch, wide], names=["doc_id", "n", "key", "slice", "counts", "wide"])
        kind = ids.type if table.any() else pa.int64()
        if table.any():
            rows = [np.minimum(table[k * width : (k + 1) * width], 65535).astype(np.uint16).tobytes() for k in range(_SLICES)]
            yield pa.RecordBatch.from_arrays([pa.nulls(_SLICES, kind), pa.nulls(_SLICES, pa.int64()), pa.nulls(_SLICES, pa.int64()), pa.array(range(_SLICES), pa.int32()), pa.array(rows, pa.binary()), pa.nulls(_SLICES, pa.binary())], names=["doc_id", "n", "key", "slice", "counts", "wide"])

    return run


def _rank_slices(table: pa.Table) -> pa.Table:
    """Ranks of a slice's shingles, one byte each: they follow the counts of all tasks, ever more coarsely; any fixed order gives the same links."""
    total = np.zeros(COUNTERS // _SLICES, np.int64)
    for row in table["counts"]:
        total += np.frombuffer(row.as_py(), np.uint16)
    counts = np.minimum(total, 2**31 - 1).astype(np.float64)
    ranks = np.minimum(255, np.where(counts < 64, counts, 64 + 16 * np.log2(np.maximum(counts, 64) / 64))).astype(np.uint8)
    return pa.table({"slice": table["slice"].slice(0, 1), "ranks": pa.array([ranks.tobytes()], pa.binary())})


def light_boundary(sizes: dict[int, int], rule: Rule, list_cost: float = 8.0) -> int:
    """Largest light size: the one with the least cost of subsets below and of postings and list scans above."""

    def subsets(a: int) -> int:
        total, choose = 0, 1
        for d in range(int(rule.missing(a)) + 1):
            total += choose
            choose = choose * (a - d) // (d + 1)
        return total

    top = 29
    light, heavy = 0.0, sum(c * (rule.missing(a) + 1) * list_cost for a, c in sizes.items())
    best, at = heavy, 0
    for a in range(1, top + 1):
        c = sizes.get(a, 0)
        light += c * subsets(a)
        heavy -= c * (rule.missing(a) + 1) * list_cost
        # Light sets within reach of heavy ones are listed too.
        near = sum(x * (rule.missing(s) + 1) * list_cost for s, x in sizes.items() if rule.least_size(a + 1) <= s <= a)
        if light + heavy + near <= best:
            best, at = light + heavy + near, a
    return at


def _postings(n: int, rule: Rule, boundary: int, rank, buckets: int):
    """Packed (h, key, size): subsets of light sets, marked in the lowest bit of h, and rarest shingles of heavy ones."""
    least = int(rule.least_size(boundary + 1))

    def run(batches):
        ranks = rank.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for a, b in slices(offsets):
                doc, h = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                if not len(h):
                    continue
                size, key = _set_keys(doc, h, b - a)
                order = np.argsort((doc << 8) | ranks[(h % np.uint64(COUNTERS)).astype(np.int64)], kind="stable")
                at = np.cumsum(size) - size
                prefix = np.where(size >= least, rule.missing(size) + 1, 0)
                take = np.arange(len(h)) - at[doc] < prefix[doc]  # doc is the same in either order
                # Marked in the lowest bit: early enough for the smaller set of a pair.
                early = np.arange(len(h)) - at[doc] <= rule.apart(2 * size)[doc] // 2
                hs, ks, ss = [h[order][take] & ~np.uint64(1)], [key[doc][take]], [(size[doc] << 1 | early)[take]]
                for i in np.flatnonzero((size > 0) & (size <= boundary)):
                    own = h[at[i] : at[i] + size[i]]
                    for d in range(int(rule.missing(size[i])) + 1):
                        left = np.array(list(combinations(range(int(size[i])), int(size[i]) - d)), np.int64)
                        sums = mix64(mix64(own)[left].sum(axis=1, dtype=np.uint64) + np.uint64(size[i] - d))
                        hs.append(sums | np.uint64(1))
                        ks.append(np.full(len(sums), key[i]))
                        ss.append(np.full(len(sums), (int(size[i]) << 8) | (int(size[i]) - d)))
                hs, ks, ss = np.concatenate(hs), np.concatenate(ks), np.concatenate(ss)
                # Copies in this chunk have the same postings: one of them goes on.
                order = np.lexsort((ks, hs))
                hs, ks, ss = hs[order], ks[order], ss[order]
                new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (ks[1:] != ks[:-1])])
                hs, ks, ss = hs[new], ks[new], ss[new]
                out = packed((hs % np.uint64(buckets)).astype(np.int32), {"h": hs, "key": ks, "size": ss.astype(np.uint32)})
                if out is not None:
                    yield out

    return run


def _lists(rule: Rule):
    """From a bucket's postings to lists of two sets or more. Long lists are cut into tiles, one for each two parts. Light groups become stars around their smallest set, which links with every set that links at all."""

    def several(group: np.ndarray) -> np.ndarray:
        _, inverse, count = np.unique(group, return_inverse=True, return_counts=True)
        return count[inverse] > 1

    def run(table: pa.Table) -> pa.Table:
        h, key, size = unpacked(table["h"], "u8")[0], unpacked(table["key"], "i8")[0], unpacked(table["size"], "u4")[0].astype(np.int64)
        order = np.lexsort((key, h))
        h, key, size = h[order], key[order], size[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])]) if len(h) else np.zeros(0, bool)
        h, key, size = h[new], key[new], size[new]
        if len(h):
            many = several(h)
            h, key, size = h[many], key[many], size[many]
        light = (h & np.uint64(1)) > 0
        ls, lk, lh = size[light] >> 8, key[light], h[light]
        overlap = size[light] & 255
        order = np.lexsort((lk, ls, lh))
        ls, lk, lh, overlap = ls[order], lk[order], lh[order], overlap[order]
        first = np.flatnonzero(np.concatenate([[True], lh[1:] != lh[:-1]])) if len(lh) else np.zeros(0, np.int64)
        hub = np.repeat(first, np.diff(np.concatenate([first, [len(lh)]])))
        joined = rule.holds(overlap, ls, ls[hub]) & (lk != lk[hub])
        hh, hk, hs, early = h[~light], key[~light], size[~light] >> 1, (size[~light] & 1) > 0
        # In order of size the partner that fits best is the next one or the last early one before.
        order = np.lexsort((hk, hs, hh))
        hh, hk, hs, early = hh[order], hk[order], hs[order], early[order]
        if len(hh):
            fits = np.zeros(len(hh), bool)
            fits[:-1] = early[:-1] & (hh[1:] == hh[:-1]) & (hs[:-1] * 100 >= rule.percent * hs[1:])
            before = np.full(len(hh), -1)
            before[1:] = np.maximum.accumulate(np.where(early, np.arange(len(hh)), -1))[:-1]
            use = fits | ((before >= 0) & (hh[before] == hh) & (hs[before] * 100 >= rule.percent * hs))
            hh, hk, hs = hh[use], hk[use], hs[use]
        first = np.flatnonzero(np.concatenate([[True], hh[1:] != hh[:-1]])) if len(hh) else np.zeros(0, np.int64)
        length = np.diff(np.concatenate([first, [len(hh)]]))
        # Near copies share many shingles: lists of the same sets get the same name, and one of them is enough.
        named = mix64(np.add.reduceat(mix64(hk.view(np.uint64)), first) + length.astype(np.uint64)) if len(hh) else np.zeros(0, np.uint64)
        new = np.zeros(len(named), bool)
        new[np.unique(named, return_index=True)[1]] = True
        keep = np.repeat(new, length)
        leading = np.minimum.reduceat(hk, first)[new] if len(hk) else hk
        hk, hs, hh, length = hk[keep], hs[keep], np.repeat(named, length)[keep], length[new]
        parts = np.repeat(-(-length // TILE), length)
        row = np.repeat(np.arange(len(hh)), parts)
        other = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        salt = (mix64(hk.view(np.uint64)) % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64)[row]
        low, high = np.minimum(salt, other), np.maximum(salt, other)
        token = mix64(hh[row] + ((low << 32) | high).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        side = np.where(low == high, 2, (salt == high).astype(np.int64))
        # Lists of the same near copies mostly have the same smallest set; the last scan deals them by it.
        lead = mix64(np.repeat(leading, length)[row].view(np.uint64) + ((low << 32) | high).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        n, m = len(token), int(joined.sum())
        return pa.table({
            "light": np.arange(n + m) >= n, "token": np.concatenate([token, lk[hub][joined]]), "side": np.concatenate([side, np.full(m, 2)]).astype(np.int32),
            "key": np.concatenate([hk[row], lk[joined]]), "size": np.concatenate([hs[row], ls[joined]]).astype(np.int32),
            "lead": np.concatenate([lead.astype(np.int32), np.zeros(m, np.int32)]),
        })

    return run


def _narrowed(sketch: np.ndarray, begin: np.ndarray, width: np.ndarray, rows: np.ndarray, to: int) -> np.ndarray:
    """Sketches of some rows, all `to` cells wide. sketch: all rows' cells in longs, row k's from begin[k] on."""
    out = np.empty((len(rows), to // 64), np.uint64)
    for w in np.unique(width[rows]):
        at = np.flatnonzero(width[rows] == w)
        own = sketch[begin[rows[at]][:, None] + np.arange(w // 64)]
        out[at] = own if w == to else _fold(np.unpackbits(own.view(np.uint8), axis=1), to).view(np.uint64)
    return out


class _Sketches:
    """Packed sketches of rows, and a test of pairs of them by sizes and sketches."""

    def __init__(self, column, size: np.ndarray, rule: Rule):
        self.cells, longs = unpacked(column, "u8")
        self.begin, self.width, self.size, self.rule = np.cumsum(longs) - longs, longs * 64, size, rule

    def possible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs (a, b) of rows sizes and sketches leave possible."""
        most = self.rule.apart(self.size[a] + self.size[b])
        out = (most >= 0) & (np.abs(self.size[a] - self.size[b]) <= most)
        at = np.flatnonzero(out)
        least = np.minimum(self.width[a[at]], self.width[b[at]])
        for w in np.unique(least):
            own, step = at[least == w], max(1, 50_000_000 // int(w))
            for k in range(0, len(own), step):
                part = own[k : k + step]
                apart = np.bitwise_count(self._of(a[part], w) ^ self._of(b[part], w)).sum(axis=1, dtype=np.int64)
                out[part] = apart <= most[part]
        return out

    def _of(self, rows: np.ndarray, to: int) -> np.ndarray:
        if (self.width[rows] == to).all():
            return self.cells[self.begin[rows][:, None] + np.arange(to // 64)]
        kinds, where = np.unique(rows, return_inverse=True)
        return _narrowed(self.cells, self.begin, self.width, kinds, to)[where]


def _scan_bucket(rule: Rule, first_scan: bool):
    """Pairs each set of a bucket's lists with one partner: rows (0, a, b) are pairs to compare, (1, key, 0) sets with any possible partner, (2, token, 0)
    lists with more possible pairs than were given. Only the first scan's rows of the last two kinds are used; others give none."""

    def run(table: pa.Table) -> pa.Table:
        token, key, comp = (table[c].to_numpy() for c in ("token", "key", "comp"))
        size, side = table["size"].to_numpy().astype(np.int64), table["side"].to_numpy()
        sketches = _Sketches(table["sketch"], size, rule)
        order = np.lexsort((key, token))
        cut = np.flatnonzero(np.concatenate([[True], token[order][1:] != token[order][:-1]]))
        length = np.diff(np.concatenate([cut, [len(order)]]))
        out_a, out_b, out_t = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        opened, alive = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def consider(a: np.ndarray, b: np.ndarray) -> None:
            use = comp[a] != comp[b]
            a, b = a[use], b[use]
            use = sketches.possible(a, b)
            out_a.append(a[use])
            out_b.append(b[use])

        short = length <= SHORT
        for n in np.unique(length[short]):
            at = cut[short & (length == n)]
            i, j = np.triu_indices(int(n), 1)
            for k in range(0, len(at), max(1, 200_000 // max(1, len(i)))):
                base = at[k : k + max(1, 200_000 // max(1, len(i)))][:, None]
                a, b = order[(base + i).reshape(-1)], order[(base + j).reshape(-1)]
                use = (side[a] == 2) | (side[a] != side[b])
                consider(a[use], b[use])
        for begin, n in zip(cut[~short], length[~short], strict=True):
            own = order[begin : begin + n]
            alive.append(key[own])
            opened.append(token[own[:1]])
            left, right = own[side[own] != 1], own[side[own] != 0]
            pairs = ((np.repeat(h, len(x)), x) for h in own[:16] for x in (left if side[h] == 1 else right,))
            for a, b in pairs:
                consider(a, b)
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        # Of a set's possible partners in a list, the one with the smallest key.
        x, y = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((key[y], x))
        x, y = x[order], y[order]
        first = np.concatenate([[True], x[1:] != x[:-1]]) if len(x) else np.zeros(0, bool)
        chosen_a, chosen_b = x[first], y[first]
        # A list of which not all possible pairs were given stays open.
        given = np.unique(np.minimum(chosen_a, chosen_b) * len(token) + np.maximum(chosen_a, chosen_b)) // max(1, len(token))
        per, told = np.unique(token[a], return_counts=True)
        gave, times = np.unique(token[given], return_counts=True)
        have = np.zeros(len(per), np.int64)
        have[np.searchsorted(per, gave)] = times
        opened.append(per[told > have])
        alive.append(np.concatenate([key[a], key[b]]))
        low, high = np.minimum(key[chosen_a], key[chosen_b]), np.maximum(key[chosen_a], key[chosen_b])
        both = np.unique(np.stack([low, high], axis=1), axis=0) if len(low) else np.zeros((0, 2), np.int64)
        keys, tokens = np.unique(np.concatenate(alive)), np.unique(np.concatenate(opened))
        if not first_scan:
            keys, tokens = keys[:0], tokens[:0]
        kind = np.repeat(np.array([0, 1, 2], np.int32), [len(both), len(keys), len(tokens)])
        return pa.table({"kind": kind, "a": np.concatenate([both[:, 0], keys, tokens]), "b": np.concatenate([both[:, 1], np.zeros(len(keys) + len(tokens), np.int64)])})

    return run


def _scan_rest(rule: Rule):
    """All pairs of sets of different components that meet in some list of a group and that whole sketches leave possible, each once: (a, b).

    Sets are taken in turn. In each list the largest component is passed over, since the others meet its sets. A list's
    rows name their component; the group's sketches come once for each set.
    """

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        known = told["set_key"].to_numpy()
        order = np.argsort(known)
        keys = known[order]
        at = np.searchsorted(keys, table["key"].to_numpy())
        token, side = table["token"].to_numpy(), table["side"].to_numpy()
        size, comp = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        size[at], comp[at] = table["size"].to_numpy(), table["comp"].to_numpy()
        sketches = _Sketches(told["sketch"].take(pa.array(order)), size, rule)
        by = np.argsort(token, kind="stable")
        cut = np.flatnonzero(np.concatenate([[True], token[by][1:] != token[by][:-1]])) if len(by) else by
        lists, open_to = [], {}
        for rows in np.split(by, cut[1:]):
            own, sides = at[rows], side[rows]
            kinds, where, counts = np.unique(comp[own], return_inverse=True, return_counts=True)
            if len(kinds) < 2:
                continue
            odd = where != counts.argmax()
            # What sets of side 0, 1 and 2 meet: members in the largest component, and others.
            lists.append([(own[met & ~odd], own[met & odd]) for met in (sides != 0, sides != 1, sides >= 0)])
            for x, s in zip(own[odd].tolist(), sides[odd].tolist(), strict=True):
                open_to.setdefault(x, []).append((len(lists) - 1, s))
        out, mark = [np.zeros((0, 2), np.int64)], np.zeros(len(keys), np.uint8)
        for x in sorted(open_to):
            mark[:] = 0
            for no, s in open_to[x]:
                large, others = lists[no][s]
                mark[large] |= 1
                mark[others] |= 2
            # Two odd ones of a list meet from either side; the smaller one takes the pair.
            y = np.flatnonzero(((mark == 1) | ((mark > 1) & (np.arange(len(keys)) > x))) & (comp != comp[x]))
            y = y[sketches.possible(np.full(len(y), x), y)]
            out.append(np.sort(np.stack([np.full(len(y), keys[x]), keys[y]], axis=1), axis=1))
        both = np.unique(np.concatenate(out), axis=0)
        return pa.table({"a": both[:, 0], "b": both[:, 1]})

    return run


def _sets(n: int, slots):
    """Whole sets of the rows whose identifier's slot is marked."""

    def run(batches):
        marked = slots.value
        for batch in batches:
            use = marked[batch.column(2).to_numpy()]
            batch = batch.filter(pa.array(use))
            if not batch.num_rows:
                continue
            data, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets):
                doc, h = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
                at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=b - a))])
                _, key = _set_keys(doc, h, b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(key), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(h.view(np.int64)))], names=["doc_id", "set_key", "members"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Of pairs (a, b) of set keys those that link, by their whole sets."""
    first = pairs.join(sets.select(F.col("key").alias("a"), F.col("members").alias("of_a")), "a")
    both = first.join(sets.select(F.col("key").alias("b"), F.col("members").alias("of_b")), "b")
    overlap = F.size(F.array_intersect("of_a", "of_b"))
    return both.select("a", "b", overlap.alias("o"), F.size("of_a").alias("na"), F.size("of_b").alias("nb")).filter(100 * F.col("o") >= rule.percent * (F.col("na") + F.col("nb") - F.col("o"))).select("a", "b")


def jaccard_groups(docs: DataFrame, n: int = 3, percent: int = 90, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest identifier reachable by links, itself included).

    Sets are the different n-word shingles of the lower-cased text; with fewer words, all of them as one; without words
    or text, empty and linked with nothing. Two link when 100 * intersection >= percent * union. Documents with equal
    sets are one class, so copies are never paired. Rows that repeat, identifier included, are equal sets; a null
    identifier is no smallest one unless it is alone. An empty table gives an empty result; other columns aren't read.
    """
    rule, spark = Rule(percent), docs.sparkSession
    modest_batches(spark)
    buckets = buckets or bucket_count(docs, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    kind = dict(rows.dtypes)["doc_id"]
    told = stored(rows.mapInArrow(_sketch(n, rule), f"doc_id {kind}, n long, key long, slice int, counts binary, wide binary"), "sets")
    narrow = told.filter("slice is null").select("doc_id", "n", "key", F.col("counts").alias("sketch"), "wide")
    ranks = np.zeros(COUNTERS, np.uint8)
    width = COUNTERS // _SLICES
    for r in told.filter("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(_rank_slices, "slice int, ranks binary").collect():  # a fixed number of rows of fixed size
        ranks[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["ranks"], np.uint8)
    rank = spark.sparkContext.broadcast(ranks)
    sizes = {r[0]: r[1] for r in narrow.filter("n > 0").groupBy(F.least("n", F.lit(64)).alias("n")).agg(F.count(F.lit(1))).collect()}  # at most 64 rows
    boundary = light_boundary(sizes, rule)
    packs = rows.select("body").mapInArrow(_postings(n, rule, boundary, rank, buckets), "bucket int, h binary, key binary, size binary")
    lists = stored(packs.groupBy("bucket").applyInArrow(_lists(rule), "light boolean, token long, side int, key long, size int, lead int").distinct(), "lists")
    links = lists.filter("light").select(F.col("token").alias("a"), F.col("key").alias("b"))
    classes = narrow.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("copies"))
    sketches = narrow.filter("n > 0").groupBy("key").agg(F.first("sketch").alias("sketch"))
    whole = narrow.filter("n > 0").groupBy("key").agg(F.first(F.coalesce("wide", "sketch")).alias("sketch"))
    listed = lists.filter("not light").select("token", "side", "key", "size", unsigned_mod("token", buckets).alias("bucket"), F.pmod("lead", F.lit(buckets)).alias("group"))
    found = _scan(rows, narrow.select("doc_id", "key"), listed, sketches, whole, rule, links, n)
    comp = components(found)
    roots = comp.join(classes, comp["node"] == classes["key"]).groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = comp.join(roots, "component").select(F.col("node").alias("key"), "component_id")
    # A set that is alone and has no link needs no look-up.
    shared = classes.join(named, "key", "left").filter("copies > 1 OR component_id IS NOT NULL").select("key", F.coalesce("component_id", "least_id").alias("component_id"))
    return narrow.join(shared, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _members(rows: DataFrame, narrow: DataFrame, alive: DataFrame, n: int) -> DataFrame:
    """key, members: the whole set of each key in `alive`, from one of its documents.

    The identifiers' slots, a table of fixed size, keep most other documents out before anything is shuffled.
    """
    spark = rows.sparkSession
    chosen = stored(narrow.join(alive, "key", "left_semi").groupBy("key").agg(F.min(F.struct("doc_id")).alias("one")).select("key", F.col("one.doc_id").alias("one_id")), "chosen")
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(COUNTERS))
    number = (slot("one_id") + 1).cast("long")
    # Bitmaps are put together by the cluster: a fixed number of rows of 4 KB, whatever the input.
    parts = chosen.groupBy(F.bitmap_bucket_number(number).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))
    marked = np.zeros(COUNTERS, bool)
    for r in parts.collect():
        bits = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
        marked[(r["part"] - 1) * len(bits) : r["part"] * len(bits)] = bits
    given = rows.select("doc_id", "body", slot("doc_id").cast("int").alias("slot")).mapInArrow(_sets(n, spark.sparkContext.broadcast(marked)), f"doc_id {dict(rows.dtypes)['doc_id']}, set_key long, members array<long>")
    same = F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("set_key") == F.col("key"))
    return stored(given.join(chosen, same).select("key", "members"), "members")


def _scan(rows: DataFrame, narrow: DataFrame, listed: DataFrame, sketches: DataFrame, whole: DataFrame, rule: Rule, links: DataFrame, n: int) -> DataFrame:
    """Links enough to connect what the lists connect: sets with their components so far, and what the last scan found.

    Lists get their sketches just before a scan. The last scan is over lists dealt by their smallest set: near copies meet
    in few groups, each with one whole sketch of a set.
    """
    state = listed.join(sketches, "key").withColumn("comp", F.col("key"))
    sets = tested = None
    for k in range(PARTNER_ROUNDS + 1):
        last = k == PARTNER_ROUNDS
        if last:
            wide = state.select(F.col("group").alias("of_group"), F.col("key").alias("set_key")).distinct().join(whole.withColumnRenamed("key", "set_key"), "set_key")
            pairs = state.groupBy("group").cogroup(wide.groupBy("of_group")).applyInArrow(_scan_rest(rule), "a long, b long").distinct()
        else:
            said = stored(state.groupBy("bucket").applyInArrow(_scan_bucket(rule, k == 0), "kind int, a long, b long"), "scan")
            pairs = said.filter("kind = 0").select("a", "b").distinct()
        if sets is None:
            sets = _members(rows, narrow, said.filter("kind = 1").select(F.col("a").alias("key")).distinct(), n)
            listed = stored(listed.join(said.filter("kind = 2").select(F.col("a").alias("token")), "token", "left_semi"), "open")
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = links.unionByName(stored(_verified(pairs, sets, rule), "verified"))
        if last:
            break
        known = components(links)
        # Components stand for the links they came from: what is known isn't connected anew after each scan.
        links = known.select(F.col("node").alias("a"), F.col("component").alias("b"))
        comp = known.select(F.col("node").alias("key"), F.col("component").alias("to"))
        near = listed if k + 1 == PARTNER_ROUNDS else listed.join(sketches, "key")
        state = near.join(comp, "key", "left").withColumn("comp", F.coalesce("to", "key")).drop("to")
    return links
