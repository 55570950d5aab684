"""The filter audit against a count of every order, document by document."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

from labelsieve.llm import audit

SCHEMA = "doc_id long, text string, source string, mask int, n int, part string, body string"
LABELS = "doc_id long, quality int, toxic int"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    rng = random.Random(3)
    out = []
    for k in range(90):
        words = rng.choices(["Alpha", "beta", "été", "x", "$5", "日本", "ONE"], k=rng.choice([0, 1, 49, 50, 51, 120])) if k % 3 else [f"w{i}" for i in range(k + 20)]
        out.append((k, rng.choice([" ", "\x0b", "\n"]).join(words), f"s{k % 3}" if k % 5 else None))
    out += [(200 + k, out[2 * k][1], "s1") for k in range(20)] + [(300, None, ""), (301, "", None), (302, None, "s0"), (303, "A#" * 400_000 + " b" * 40, "s2")]
    out += [out[3], out[3], (None, out[3][1], "s0"), (5, "another text of a known id", "s0"), (400, "\xa0  \x1c \x85", "s0"), (401, "ABCDE" + "é" * 95, "s0"), (402, "ABCDEF" + "é" * 94, "s0")]
    return out


def failed(text):
    words = WORDS.findall(text)
    upper = len(re.findall("[A-Z]", text))
    return (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * upper > 5 * len(text)) << 2 | bool(re.search(r"[#$%&*|]", text)) << 3


def brute(given, labels):
    docs = [(i, t or "", s or "") for i, t, s in given]
    marks = defaultdict(lambda: [False, False])
    for i, q, t in labels:
        marks[i][0] |= q == 1
        marks[i][1] |= t == 1
    ids = defaultdict(set)
    for i, t, _ in docs:
        if i is not None:
            ids[t].add(i)
    full = [(s, {f for k, f in enumerate("ABCD") if failed(t) >> k & 1} | ({"E"} if i is not None and i > min(ids[t]) else set()), marks[i] if i is not None else [False, False]) for i, t, s in docs]
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for step, f in enumerate(order, 1):
            for part in {s for s, _, _ in full}:
                own = [(fails, m) for s, fails, m in full if s == part]
                gone = [(fails, m) for fails, m in own if f in fails and not fails & set(order[: step - 1])]
                shapley[part, f] += len(gone)
                out[part, order, step] = [
                    sum(not fails & set(order[:step]) for fails, _ in own), len(gone), sum(f in fails and bool(fails & set(order[: step - 1])) for fails, _ in own),
                    sum(fails == {f} for fails, _ in own), sum(m[0] for _, m in gone), sum(m[1] for _, m in gone),
                ]
    return {k: tuple(v) + (shapley[k[0], k[1][k[2] - 1]],) for k, v in out.items()}


def test_audit_equals_brute_force(spark):
    given, labels = rows(), [(k, k % 2, (k + 1) % 3 % 2) for k in range(0, 320, 3)] + [(3, 1, None), (3, 0, 1), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, 2, "x", "y") for r in given], SCHEMA).repartition(3)
    got = audit.audit(audit.mask_counts(docs, spark.createDataFrame(labels, LABELS))).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == brute(given, labels)
    assert len(got) == 600 * 4


def test_audit_of_an_empty_table(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert audit.audit(audit.mask_counts(docs, labels)).count() == 0


def test_sketch_passes_every_repeat_and_clears_most_others(spark):
    hashes = spark.range(3000).selectExpr("xxhash64(case when id < 500 then id % 100 else id end) as h").cache()
    kept = hashes.filter(audit.possible_repeats(hashes, "h")(hashes.h)).groupBy("h").count().collect()
    assert sum(r["count"] > 1 for r in kept) == 100
    assert sum(r["count"] == 1 for r in kept) < 300
    tight = hashes.filter(audit.possible_repeats(hashes, "h", 1 << 10)(hashes.h)).groupBy("h").count().filter("count > 1").count()
    assert tight == 100  # a sketch that is too small only clears less


def test_long_texts_are_split_at_separators(monkeypatch):
    text = b"a bb  a\tccc\n" * 50
    monkeypatch.setattr(audit, "PIECE_BYTES", 7)
    assert audit._distinct_words(text) == (200, 3)
