"""The pipeline's stages against what brute force keeps."""

import hashlib
import math
import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp

D = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    kept = cp.reject_low_quality(spark, docs, D).cache()
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == cp.COLUMNS
    judged = [k for k in labels if labels[k] is not None]
    assert sum((k in ids) == (labels[k] == 1) for k in judged) / len(judged) > 0.9

    unique = cp.drop_copies(spark, kept, D).cache()
    norm = {}
    for r in sorted(kept.collect(), key=lambda r: r["doc_id"]):
        norm.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or ""), r["doc_id"])
    assert {r["doc_id"] for r in unique.collect()} == set(norm.values())

    single = cp.drop_near_copies(spark, unique, D).cache()
    sets = {}
    for r in unique.collect():
        w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r["text"] or ""))
        sets[r["doc_id"]] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {r["doc_id"] for r in single.collect()} == {k for k in sets if find(k) == k}

    mixed = cp.mix_sources(spark, single, D).cache()
    assert {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in single.collect()}
    coded = cp.encode(spark, mixed, D)
    assert coded.count() == mixed.count()
    assert all(r["n_tokens"] == len(r["ids"]) for r in coded.collect())


def test_near_copies_of_repeated_and_null_identifiers(spark):
    long = " ".join(f"word{k}" for k in range(60))
    near, other = long + " more", " ".join(f"other{k}" for k in range(40))
    rows = [(7, long), (7, near), (7, long.upper()), (3, other), (3, other), (None, other + " end"), (None, "one alone"), (None, "two alone"), (5, ""), (5, ""), (6, None)]
    docs = spark.createDataFrame([(k, t, "en", None, 1, 2) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row_key int")
    kept = cp.drop_near_copies(spark, docs, D)
    assert kept.columns == cp.COLUMNS
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    same = [t for k, t in got if k == 7]
    assert len(same) == 1 and same[0] in (long, near, long.upper())
    assert sorted(map(str, (x for x in got if x[0] != 7))) == sorted(map(str, [(3, other), (None, "one alone"), (None, "two alone"), (5, ""), (5, ""), (6, None)]))


def test_stages_on_an_empty_table(spark):
    empty = spark.read.parquet(f"{D}/documents.parquet").filter("false")
    for name, stage in cp.STAGES:
        assert stage(spark, empty, D).collect() == [], name


def copies(rows):
    """How often each (doc_id, source, words) is in the mix: shares of 5, 2 and 1 in turn, at most 3 times a source's words, what is left over shared again."""
    own = Counter()
    for _, source, n in rows:
        own[source] += n
    names = sorted(own, key=lambda x: (x is None, x or ""))
    weight = {x: (5, 2, 1)[k % 3] for k, x in enumerate(names)}
    total, open_, target = sum(own.values()), set(names), {}
    while open_:
        left = total - sum(target.values())
        share = {x: left * weight[x] / sum(weight[y] for y in open_) for x in open_}
        full = {x for x in open_ if share[x] > 3 * own[x]}
        target |= {x: 3 * own[x] for x in full} if full else share
        open_ = open_ - full if full else set()
    out = {}
    for doc_id, source, _ in rows:
        rate = target[source] / own[source] if own[source] else 0.0
        u = int(hashlib.md5(f"mix:{doc_id}".encode()).hexdigest()[:8], 16) / 2**32
        out[doc_id] = math.floor(rate) + (u < rate - math.floor(rate))
    return out


def test_run_mixes_and_encodes_what_the_first_stages_keep(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for _, stage in cp.STAGES[:3]:
        docs = stage(spark, docs, D)
    kept = docs.collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer.no_padding()
    tokenizer.no_truncation()
    times = copies([(r["doc_id"], r["source"], len(WORDS.findall(r["text"] or ""))) for r in kept])
    want = Counter()
    for r in kept:
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want[r["doc_id"], len(ids), tuple(ids), hashlib.sha256(decoded.encode()).hexdigest()] += times[r["doc_id"]]
    got = Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded_sha256"]) for r in cp.run(spark, D).collect())
    assert got == +want and len(got) > 50


def test_stages_with_clashing_columns(spark):
    """Columns named like those that operators use inside change nothing; the stages give the columns of documents."""
    plain = spark.read.parquet(f"{D}/documents.parquet").limit(60).cache()
    names = ["row_key", "key", "bucket", "size", "h", "n", "id", "mix_size", "quality_score", "component_id", "keep_id", "ids", "decoded"]
    from pyspark.sql import functions as F

    clashing = plain.select("*", *[F.lit("x").alias(c) for c in names])
    for name, stage in cp.STAGES:
        a, b = stage(spark, plain, D), stage(spark, clashing, D)
        assert a.columns == b.columns, name
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())), name
