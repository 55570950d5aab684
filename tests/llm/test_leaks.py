"""Benchmark passages found by the positional index against a plain search of every position."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from labelsieve.llm import leaks

SCHEMA = "doc_id long, text string, phrase string, row int, term string, n int, item string"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def tables():
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "é", "日本", "The", "the", "ö x"]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 9, 10, 11, 30])))) for k in range(12)]
    items += [(12, items[5][1]), (13, None), (14, ""), (15, "?!"), (16, "same " * 14), (17, "nowhere w1 w2 w3 w4 w5 w6 w7 w8 w9"), (7, "w1, W2"), (None, "w5 w6 w7")]
    docs = []
    for k in range(80):
        own = rng.choices(vocabulary, k=rng.choice([0, 1, 5, 30, 90]))
        said = items[k % 13][1].split()
        if k % 3 == 0:
            own[len(own) // 2 : len(own) // 2] = said
        elif k % 3 == 1 and len(said) > 3:
            del said[len(said) // 2]
            own[:0] = said
        docs.append((k, rng.choice([" ", "\n", ". "]).join(own).upper() if k % 5 == 0 else "  ".join(own)))
    docs += [(90, None), (91, ""), (92, "..."), (93, "same " * 40), (94, "x" * 200_000 + " w5 w6 w7 " + "y " * 30_000), (3, "another w1 w2"), docs[6], docs[6], (None, items[4][1]), (None, "w1 w2")]
    return docs, items


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(item)
    lengths, out = {len(w) for w in windows}, []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found.update(str(x) for x in own if x is not None)
        out.append((doc_id, len(w), len(hit), len(found), sorted(found)))
    return sorted(out, key=repr)


def frames(spark):
    docs, items = tables()
    return spark.createDataFrame([(*d, "p", 1, "t", 2, "i") for d in docs], SCHEMA).repartition(3), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("limit", [leaks.SMALL_ROWS, 0])
def test_contamination_equals_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(leaks, "BLOCK", 16)  # windows cross blocks
    docs, items = frames(spark)
    got = leaks.contamination(docs, items, limit=limit).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(*tables())
    assert sum(r["n_items"] > 0 for r in got) > 30


def test_proximity_equals_brute_force(spark):
    docs, items = frames(spark)
    index = leaks.Index(docs, items, reach=14)
    rarest = {(r["phrase"], r["t1"]) for r in index.anchors.collect()}
    expected = set()
    for doc_id, text in tables()[0]:
        w = words(text)
        for phrase, term in rarest:
            expected |= {(doc_id, k, phrase) for k, x in enumerate(w) if x == term and set(phrase.split()) <= set(w[max(0, k - 14) : k + 15])}
    of = {}
    for r in index.windows.collect():
        of.setdefault(r["phrase"], set()).add(r["item"])
    got = {(r["row"]["id"], r["pos"], r["item"]) for r in index.near().collect()}
    assert got == {(d, k, i) for d, k, phrase in expected for i in of[phrase]}
    exact = {(r["row"]["id"], r["item"]) for r in index.phrases().collect()}
    assert exact <= {(d, i) for d, _, i in got} and len({(d, i) for d, _, i in got}) > len(exact)


def test_empty_tables(spark):
    docs, items = frames(spark)
    none_docs, none_items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "item_id long, text string")
    assert leaks.contamination(none_docs, items).count() == 0
    assert leaks.contamination(docs, none_items).agg({"n_hit": "max", "n_items": "max"}).first()[:] == (0, 0)


def test_words_are_the_contracts(spark):
    """The classes hold the same characters as the contract's negated ones, lower-cased or not."""
    every = "".join(f" {chr(c)} a{chr(c)}b" for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    df = spark.createDataFrame([(every,)], "text string")
    lower, same = leaks.lowered(F.col("text")), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    found = lambda text, pattern: F.sha2(F.array_join(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), " "), 256)
    row = df.select(found(lower, leaks.TERM), found(lower, same), found(F.col("text"), leaks.RUN), found(F.col("text"), r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).first()
    assert row[0] == row[1] and row[2] == row[3] != row[0]


def test_words_are_split_once_and_quickly(spark):
    """A pass splits each text once, in about the time of a plain class: negated ones took ten times as long."""
    docs, _ = frames(spark)
    plan = leaks._blocks(leaks.keyed(docs, "doc_id", "text"), 9)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
    df = spark.range(16).select(F.repeat(F.concat(F.lit("some invented words of prose "), F.col("id").cast("string"), F.lit(", ")), 8_000).alias("text")).cache()

    def took(pattern):
        times = []
        for _ in range(4):
            began = time.time()
            df.agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))))).first()
            times.append(time.time() - began)
        return min(times)

    plain = took("[0-9a-z]+")
    assert max(took(leaks.TERM), took(leaks.RUN)) < 4 * plain
    df.unpersist()
