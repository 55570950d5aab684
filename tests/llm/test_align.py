"""Token alignment against the libraries themselves and a walk over both end lists."""

import hashlib
import random
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st

from labelsieve.llm import align
from labelsieve.llm.bpe import byte_symbols

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, row int, pair string, n_a int, ids_a string, bucket int"


def texts():
    rng = random.Random(7)
    words = ["the", "ciónasmimente", "The", "état", "of", "<|endoftext|>", "</s>", "日本", "😀", "Ωmega", "12345", "'s", "…", "x" * 50, "\t", "\n\n", "  "]
    out = [" ".join(rng.choices(words, k=rng.choice([1, 2, 5, 30, 100]))) for _ in range(60)]
    return [*out, out[3], out[3], None, "", " ", "\n", "a▁b", " x", "ab cd", "­", "à", "\x00\x01", "ab" * 3000, "z" * 20_000, " leading", "trailing "]


def rows():
    return [*enumerate(texts()), (4, "the same id again"), (None, "no id here"), (None, "no id here")]


def tokens():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    value = {c: bytes([b]) for b, c in enumerate(byte_symbols())}
    spell_b = lambda p: bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode()
    for doc_id, text in rows():
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        in_a, in_b = [b"".join(value[c] for c in first.id_to_token(i)) for i in a], [spell_b(second.id_to_piece(i)) for i in b]
        whole = (" " + (text or "")).encode()
        yield (doc_id, a, b, in_a, in_b) if text and b"".join(in_a) == whole and b"".join(in_b) == whole else (doc_id, [], [], [], [])


def brute():
    docs, count = [], Counter()
    for doc_id, a, b, in_a, in_b in tokens():
        ends_a, ends_b = np.cumsum([len(x) for x in in_a]).tolist(), np.cumsum([len(x) for x in in_b]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
        links = Counter()
        for g, h in groups:
            for x, n in Counter(g).items():
                for y, k in Counter(h).items():
                    links[x, y] += n * k
        count.update(links.keys())
        docs.append((doc_id, len(a), len(b), groups, links))
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, n_a, n_b, groups, links in docs:
        said = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        sha = hashlib.sha256(said.encode()).hexdigest() if groups else ""
        out.append((doc_id, n_a, n_b, len(groups), sum(links.values()), sum(n for p, n in links.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in links.items()), sha))
    return sorted(out, key=repr)


@pytest.mark.parametrize("known_pairs", [None, 40, 0])
def test_alignment_equals_brute_force(spark, known_pairs):
    docs = spark.createDataFrame([(*r, 1, "p", 2, "i", 3) for r in rows()], SCHEMA).repartition(3)
    got = align.aligned_docs(docs, A, B, known_pairs=known_pairs).drop("ids_a", "ids_b").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute()


def test_alignment_of_an_empty_table(spark):
    assert align.aligned_docs(spark.createDataFrame([], SCHEMA), A, B).count() == 0


@given(st.lists(st.integers(0, 300), unique=True), st.lists(st.integers(0, 300), unique=True))
def test_gallop_finds_what_both_hold(a, b):
    a, b = np.array(sorted(a), np.int64), np.array(sorted(b), np.int64)
    i, j = align.gallop(a, b)
    assert a[i].tolist() == b[j].tolist() == sorted(set(a.tolist()) & set(b.tolist()))


@pytest.mark.parametrize("most", [1, 5, 1000])
def test_links_laid_out_by_parts(monkeypatch, most):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(align, "LINKS", most)
    size_a, size_b = np.array([1, 2, 3, 1]), np.array([1, 2, 1, 2, 3])
    a, b, at_a, at_b = [], [], [0], [0]
    for total in (0, 30, 7, 0, 60):
        for ids, at, size in ((a, at_a, size_a), (b, at_b, size_b)):
            left = total
            while left:
                ids.append(int(rng.choice(np.flatnonzero(size <= left))))
                left -= size[ids[-1]]
            at.append(len(ids))
    found = align.Aligned(np.array(a), np.array(b), np.array(at_a), np.array(at_b), size_a, size_b)
    expected = Counter()
    for g in range(len(found.text)):
        for x, y in product(found.a[found.from_a[g] : found.to_a[g]], found.b[found.from_b[g] : found.to_b[g]]):
            expected[int(found.text[g]), int(x * 5 + y)] += 1
    text, pair, times = found.links()
    assert {(t, p): n for t, p, n in zip(text.tolist(), pair.tolist(), times.tolist(), strict=True)} == expected


def test_both_byte_encoders_agree():
    reader, rng = align.ByteBpe(A), random.Random(1)
    assert reader.quick is not None
    settled = [chr(c) for c in range(0x370)]
    given = ["".join(rng.choices(settled, k=300)) for _ in range(200)] + ["".join(rng.choices("aé 1'\n\t \u0085s", k=200)) for _ in range(200)]
    quick = [x.tolist() for x in reader.encode(given)]
    reader.quick = None
    assert quick == [x.tolist() for x in reader.encode(given)]
