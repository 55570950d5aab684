"""BPE encoding and decoding with a pair occurrence index.

The different words of a batch are laid out as one array of symbols. An index maps each mergeable pair to all its
positions; the active ranks are applied in ascending order, each to all its positions at once, and only the lists of
the pairs that arise beside a merge are updated.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsieve.llm.common import slices, text_buffers

#: White space as Unicode has it.
_SPACE = r"\t-\r " + "".join(map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_ANY = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
#: Different words whose encodings a task keeps between batches.
KEPT_WORDS = 200_000
_OUT_BYTES = 4_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    shown = set(plain)
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A byte-level BPE with word ends, lower case and white space dropped, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab: dict[str, int] = told["model"]["vocab"]
        suffix = told["model"]["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.tokens = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.inner = np.array([vocab[c] for c in byte_symbols()], np.int64)
        self.last = np.array([vocab[c + suffix] for c in byte_symbols()], np.int64)
        pairs = [x if isinstance(x, list) else x.split(" ") for x in told["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = (self.left << 32) | self.right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def split(self, text: str) -> list[str]:
        """Words of a text; a special token's string in it is a word that begins with a space."""
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text) if self.cut and "<|" in text else [text]):
            if k % 2:
                out.append(" " + part)
            elif part.isascii():
                out += _ASCII.findall(part.lower())
            else:
                out += _ANY.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return out

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, or -1."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has. Words aren't empty."""
        size = np.array([len(w) for w in words], np.int64)
        if not len(size):
            return np.zeros(0, np.int64), size
        end = np.cumsum(size)
        data = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.inner[data]
        symbol[end - 1] = self.last[data[end - 1]]
        n = len(symbol)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        after[end - 1] = -1
        before[end - size] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            """Put the pairs that begin at these positions into the index."""
            rank = self.rank_of(symbol[at], symbol[after[at]])
            known = rank >= 0
            at, rank = at[known], rank[known]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.concatenate([[0], np.flatnonzero(rank[1:] != rank[:-1]) + 1, [len(rank)]]).tolist()
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                r = int(rank[a])
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(at[a:b])

        add(np.flatnonzero(after >= 0))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            at = at[alive[at] & (symbol[at] == self.left[r])]
            at = at[after[at] >= 0]
            at = at[symbol[after[at]] == self.right[r]]
            if not len(at):
                continue
            if self.left[r] == self.right[r] and len(at) > 1:
                # In a row of equal symbols every other pair from the left is taken.
                begins = np.concatenate([[True], after[at[:-1]] != at[1:]])
                run = np.cumsum(begins) - 1
                at = at[(np.arange(len(at)) - np.flatnonzero(begins)[run]) % 2 == 0]
            gone = after[at]
            then = after[gone]
            symbol[at] = self.merged[r]
            alive[gone] = False
            after[at] = then
            before[then[then >= 0]] = at[then >= 0]
            previous = before[at]
            add(np.unique(np.concatenate([previous[previous >= 0], at[then >= 0]])))
        word = np.repeat(np.arange(len(size)), size)
        return symbol[alive], np.bincount(word[alive], minlength=len(size))

    def decode(self, ids) -> str:
        """Tokens with a space between them, special ones included."""
        return " ".join([self.tokens[int(i)] for i in ids])


class _Memo(dict):
    """Number of each different word; new ones are numbered in turn."""

    def __missing__(self, word: str) -> int:
        self[word] = len(self)
        return len(self) - 1


def _encode(path: str):
    def run(batches):
        model = WordBpe(path)
        memo, flat, begin, count, shown = _Memo(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        for batch in batches:
            if len(memo) > KEPT_WORDS:
                memo, flat, begin, count, shown = _Memo(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
            texts, known = batch.column(1), len(memo)
            number = memo.__getitem__
            docs = [np.fromiter(map(number, model.split(t.as_py() or "")), np.int32) for t in texts]
            new = list(memo)[known:] if len(memo) > known else []
            plain = [w.encode() for w in new if w[0] != " "]
            ids, sizes = model.encode_words(plain)
            if len(plain) < len(new):
                each = iter(np.split(ids, np.cumsum(sizes)[:-1]))
                parts = [np.array([model.special[w[1:]]]) if w[0] == " " else next(each) for w in new]
                ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
            begin = np.concatenate([begin, len(flat) + np.cumsum(sizes) - sizes])
            flat, count = np.concatenate([flat, ids]), np.concatenate([count, sizes])
            stops = np.cumsum(sizes).tolist()
            named = [model.tokens[i] for i in ids.tolist()]
            shown += [" ".join(named[a:b]) for a, b in zip([0, *stops[:-1]], stops, strict=True)] if new else []
            _, offsets = text_buffers(texts)
            for a, b in slices(offsets, _OUT_BYTES):
                lengths = np.array([len(d) for d in docs[a:b]])
                seen = np.concatenate(docs[a:b])
                n = count[seen]
                upto = np.cumsum(n)
                tokens = flat[np.arange(int(n.sum())) + np.repeat(begin[seen] - (upto - n), n)]
                ends = np.concatenate([[0], np.concatenate([[0], upto])[np.cumsum(lengths)]])
                out = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens, pa.int32()))
                text = pa.array([" ".join([shown[i] for i in d.tolist()]) for d in docs[a:b]], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), out, text], names=["doc_id", "ids", "decoded"])

    return run


def encode_docs(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, ids (array of int) and decoded (the ids turned back into text).

    Null text counts as empty and has no ids. Rows that repeat stay, null identifiers too; an empty table gives an empty
    result; other columns are not read. `path` is the tokenizer file, which every executor can open.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("bpe_text"))
    return rows.mapInArrow(_encode(path), f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>, decoded string")
