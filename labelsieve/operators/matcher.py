"""Many terms sought at once over the code points of Arrow text columns.

All texts of a piece of a batch are one array of code points. A table of fixed size says, by a position's first two characters, how
long the terms are that may begin there; positions with any keep a running hash, which is looked up among the hashes of
the terms of each length, and what is found is compared character by character. Only occurrences are given back.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa

#: Characters kept before and behind an occurrence.
BEFORE, AFTER = 6, 10
#: Places of the table of openings, by two characters and by one.
OPENINGS = 1 << 16
#: Characters of one step; longer texts are read in parts that overlap by the longest term.
STEP = 1_000_000
ENTRY_TYPES = {"kind": pa.string(), "ord": pa.int32(), "term": pa.string(), "status": pa.string(), "en": pa.string(), "py": pa.string(), "category": pa.string(), "note": pa.string()}

#: An occurrence: where it is, its entry, and what stands around it.
FIELDS = ["start", "neg_len", "ord", "term", "status", "en", "py", "category", "note", "kind", "before", "after"]

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def folded(points: np.ndarray) -> np.ndarray:
    """A-Z to a-z."""
    return np.where((points >= 65) & (points <= 90), points + 32, points).astype(np.uint32)


def _letter(points: np.ndarray) -> np.ndarray:
    low = points | 32
    return (low >= 97) & (low <= 122)


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first * 31 + second) % OPENINGS


class Matcher:
    """Terms made ready to be sought: entries by length and hash. terms: columns term, exact and those of an entry; empty terms are never found.

    An entry that isn't exact and all ASCII is loose: it matches in any case, as a whole word. All others match as they are.
    """

    def __init__(self, terms: pa.Table):
        words = terms["term"].to_pylist()
        exact = terms["exact"].to_pylist()
        use = [k for k, w in enumerate(words) if w]
        entries = terms.select(list(ENTRY_TYPES)).cast(pa.schema(ENTRY_TYPES)).take(pa.array(use, pa.int64()))
        self.columns = {c: pa.concat_arrays(entries[c].chunks) if entries[c].num_chunks else pa.array([], t) for c, t in ENTRY_TYPES.items()}
        self.ords = self.columns["ord"].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        kinds = self.columns["kind"].to_pylist()
        self.kind_names = sorted(set(kinds))
        self.kinds = np.array([self.kind_names.index(k) for k in kinds], np.int64)
        points = [code_points(words[k]) for k in use]
        loose = np.array([words[k].isascii() and not exact[k] for k in use], bool)
        self.lengths = length = np.array([len(p) for p in points], np.int64)
        self.longest = int(length.max(initial=1))
        # Bit k: a term of k + 1 characters, bit 63 any longer one; loose terms begin no word in its middle.
        self.pairs, self.singles = (np.zeros((2, OPENINGS), np.uint64) for _ in range(2))
        self.by_length: dict[int, tuple] = {}
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            raw = np.stack([points[k] for k in own])
            low = folded(raw)
            hashed = np.zeros(len(own), np.uint64)
            for k in range(n):
                hashed = hashed * _FACTOR + low[:, k]
            order = np.argsort(hashed, kind="stable")
            own, raw, low, hashed = own[order], raw[order], low[order], hashed[order]
            kinds, first, count = np.unique(hashed, return_index=True, return_counts=True)
            self.by_length[int(n)] = kinds, first, count, own, np.where(loose[own][:, None], low, raw), loose[own]
            bit = np.uint64(1) << np.uint64(min(int(n), 64) - 1)
            table, at = (self.pairs, _pair(low[:, 0], low[:, 1])) if n > 1 else (self.singles, low[:, 0] % OPENINGS)
            np.bitwise_or.at(table[0], at, bit)
            np.bitwise_or.at(table[1], at[~loose[own]], bit)

    def _sought(self, raw: np.ndarray, ends: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position and entry of every occurrence. raw: code points of several texts in turn, which end at `ends`; text: each position's text."""
        low = folded(raw)
        following = np.append(low[1:], np.uint32(0))
        letter = _letter(raw)
        inner = np.zeros(len(raw), np.int64)
        inner[1:] = letter[:-1]
        begins = ends[:-1][ends[:-1] < len(raw)]
        inner[begins] = 0
        mask = self.pairs[inner, _pair(low, following)] | self.singles[inner, low % OPENINGS]
        at = np.flatnonzero(mask)
        mask, room = mask[at], ends[text[at] + 1] - at
        hashed, found_at, found = np.zeros(len(at), np.uint64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n in range(1, self.longest + 1):
            more = (room >= n) & ((mask >> np.uint64(min(n, 64) - 1)) > 0)
            at, mask, room, hashed = at[more], mask[more], room[more], hashed[more]
            if not len(at):
                break
            hashed = hashed * _FACTOR + low[at + (n - 1)]
            if n not in self.by_length:
                continue
            kinds, first, count, own, spelled, loose = self.by_length[n]
            here = np.flatnonzero(mask >> np.uint64(min(n, 64) - 1) & np.uint64(1))
            place = np.minimum(np.searchsorted(kinds, hashed[here]), len(kinds) - 1)
            met = kinds[place] == hashed[here]
            here, place = here[met], place[met]
            times = count[place]
            row = first[place].repeat(times) + np.arange(times.sum()) - (np.cumsum(times) - times).repeat(times)
            start = at[here].repeat(times)
            span = start[:, None] + np.arange(n)
            same = (np.where(loose[row][:, None], low[span], raw[span]) == spelled[row]).all(axis=1)
            behind = np.minimum(start + n, len(raw) - 1)
            inside = letter[behind] & (start + n < ends[text[start] + 1])
            same &= ~loose[row] | ~(inside | (inner[start] > 0))
            found_at.append(start[same])
            found.append(own[row[same]])
        return np.concatenate(found_at), np.concatenate(found)

    def _part(self, texts: list[str], number: list[int], skip: list[int], around: bool) -> tuple:
        """Of some texts or parts of texts: number of the text, start, entry, and what stands before and behind, if it is asked for."""
        whole = "".join(texts)
        ends = np.cumsum([0, *map(len, texts)])
        owner = np.repeat(np.arange(len(texts)), np.diff(ends))
        at, entry = self._sought(code_points(whole), ends, owner)
        own = owner[at]
        before, after = [], []
        for p, n, k in zip(at.tolist(), self.lengths[entry].tolist(), own.tolist(), strict=True) if around else ():
            begin, end = int(ends[k]), int(ends[k + 1])
            before.append(whole[max(begin, p - BEFORE) : p])
            after.append(whole[p + n : min(end, p + n + AFTER)])
        return np.array(number)[own] if len(own) else own, at - ends[own] + np.array(skip, np.int64)[own], entry, before, after

    def parts(self, texts: Sequence[str | None], around: bool = True) -> Iterator[tuple]:
        """Occurrences in texts, some texts at a time, in parts where they are long."""
        some, number, skip, size = [], [], [], 0
        for k, t in enumerate(texts):
            if not t:
                continue
            if len(t) > STEP:
                # A part holds the starts of STEP characters, with what an occurrence and its surroundings need on both sides.
                for begin in range(0, len(t), STEP):
                    low = max(0, begin - BEFORE)
                    number_of, start, entry, before, after = self._part([t[low : begin + STEP + self.longest + AFTER]], [k], [low], around)
                    use = np.flatnonzero((start >= begin) & (start < begin + STEP))
                    yield number_of[use], start[use], entry[use], [before[i] for i in use] if around else [], [after[i] for i in use] if around else []
                continue
            if size + len(t) > STEP:
                yield self._part(some, number, skip, around)
                some, number, skip, size = [], [], [], 0
            some.append(t)
            number.append(k)
            skip.append(0)
            size += len(t)
        if some:
            yield self._part(some, number, skip, around)

    def places(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, start and entry of all occurrences, ordered by text, start, longest first, then ord."""
        parts, none = list(self.parts(texts, False)), np.zeros(0, np.int64)
        number, start, entry = (np.concatenate([none, *[p[k] for p in parts]]) for k in range(3))
        order = np.lexsort((self.ords[entry], -self.lengths[entry], start, number))
        return number[order], start[order], entry[order]

    def seek(self, texts: Sequence[str | None]) -> Found:
        """All occurrences in texts, ordered by text, start, longest first, then ord."""
        parts, none = list(self.parts(texts)), np.zeros(0, np.int64)
        number, start, entry = (np.concatenate([none, *[p[k] for p in parts]]) for k in range(3))
        order = np.lexsort((self.ords[entry], -self.lengths[entry], start, number))
        before, after = (pa.array([x for p in parts for x in p[k]], pa.string()).take(pa.array(order)) for k in (3, 4))
        return Found(self, len(texts), number[order], start[order], entry[order], before, after)


class Found:
    """Occurrences in some texts, to be given out as list columns."""

    def __init__(self, matcher: Matcher, texts: int, number: np.ndarray, start: np.ndarray, entry: np.ndarray, before: pa.Array, after: pa.Array):
        self.matcher, self.texts, self.number, self.start, self.entry, self.before, self.after = matcher, texts, number, start, entry, before, after

    def column(self, kinds: Sequence[str] | None = None, which: str = "all") -> pa.ListArray:
        """One list per text of its occurrences of some kinds.

        which: all; longest, those that a scan from left to right takes, the longest at each position and no overlaps; first,
        of each entry's the first one in a text.
        """
        use = np.arange(len(self.entry)) if kinds is None else np.flatnonzero(np.isin(self.matcher.kinds[self.entry], [self.matcher.kind_names.index(k) for k in kinds if k in self.matcher.kind_names]))
        if which == "first" and len(use):
            _, at = np.unique(np.stack([self.number[use], self.entry[use]]), axis=1, return_index=True)
            use = use[np.sort(at)]
        if which == "longest":
            use = use[leftmost_longest(self.number[use], self.start[use], self.matcher.lengths[self.entry[use]])]
        number, start, entry = self.number[use], self.start[use], self.entry[use]
        size, taken, rows = self.matcher.lengths[entry], pa.array(entry), pa.array(use)
        fields = [self.matcher.columns[c].take(taken) for c in ("ord", "term", "status", "en", "py", "category", "note", "kind")]
        values = [pa.array(start.astype(np.int32)), pa.array(-size.astype(np.int32)), *fields, self.before.take(rows), self.after.take(rows)]
        cut = np.searchsorted(number, np.arange(self.texts + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(cut), pa.StructArray.from_arrays(values, names=FIELDS))


def leftmost_longest(number: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[int]:
    """Of occurrences in order those that are taken."""
    kept, last, end = [], -1, 0
    for i, (k, s, n) in enumerate(zip(number.tolist(), start.tolist(), size.tolist(), strict=True)):
        if k != last or s >= end:
            kept.append(i)
            last, end = k, s + n
    return kept
