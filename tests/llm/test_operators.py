"""Each operator against brute force, on rows with nulls, empties, ties, repeats, clashing columns, and on an empty table."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelsieve.llm import bpe, chat, embed, exact_dedup, jaccard, lm, mixing, quality, sharding, substring
from labelsieve.llm.components import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, bucket int, id long, key string, n int, h string, size int"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def texts():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)] + ["É", "日本", "a", "The", "the"]
    passage = " ".join(rng.choices(vocabulary, k=60))
    out = []
    for k in range(60):
        words = rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 9, 10, 15, 19, 25, 80, 200]))
        if k % 4 == 0:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        out.append(" ".join(words))
    for k in range(20):  # near copies
        words = out[8 + k].split()
        if words:
            words[rng.randrange(len(words))] = "changed"
        out.append("  ".join(words) + "\n")
    out += [out[4], out[4].replace(" ", "\t"), out[4], None, None, "", "   ", "x " * 3000, passage + " " + passage]
    return out


def rows(spark):
    data = [(k, t, f"s{k % 4}" if k % 7 else None, 1, 2, "k", 3, "h", 4) for k, t in enumerate(texts())]
    data += [data[4], data[4], (None, "only one without id here", None, 1, 2, "k", 3, "h", 4)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    rows(spark).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substring(docs, plain, empty):
    for window in (35, 3):
        words = [WORDS.findall(t or "") for _, t in plain]
        seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
        want = []
        for (k, _), w in zip(plain, words, strict=True):
            gone = [False] * len(w)
            for i in range(len(w) - window + 1):
                if seen[tuple(w[i : i + window])] > 1:
                    gone[i : i + window] = [True] * window
            want.append((k, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
        got = substring.remove_repeats(docs, window).collect()
        order = lambda r: (r[0] is None, r[0] or 0, r[3])
        assert sorted([tuple(r)[:4] for r in got], key=order) == sorted(want, key=order)
        assert all(sum(s["end"] - s["start"] for s in r["removed_spans"]) == r["n_removed"] for r in got)
    assert substring.remove_repeats(empty).collect() == []


def shingles(t, n):
    w = WORDS.findall(lower(t or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 80)])
def test_jaccard(docs, plain, empty, n, percent):
    sets = [(k, shingles(t, n)) for k, t in plain]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(sets):
        least[find(i)] = min(x for x in (least.get(find(i)), k) if x is not None) if k is not None or least.get(find(i)) is not None else None
    want = sorted(((k, len(s), least[find(i)]) for i, (k, s) in enumerate(sets)), key=str)
    assert sorted((tuple(r) for r in jaccard.jaccard_groups(docs, n, percent).collect()), key=str) == want
    if n == 3:
        assert jaccard.jaccard_groups(empty).collect() == []


def test_light_boundary_follows_cost():
    rule = jaccard.Rule(90)
    assert jaccard.light_boundary({}, rule) >= 0
    assert jaccard.light_boundary({500: 1000}, rule) <= 29
    assert jaccard.light_boundary({9: 10**6}, rule) >= 9


def test_components(spark):
    edges = spark.createDataFrame([(1, 4), (4, 9), (9, 2), (7, 8), (8, 7), (5, 5), (20, 21), (21, 22), (22, 23), (23, 24)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {1: 1, 4: 1, 9: 1, 2: 1, 7: 7, 8: 7, 20: 20, 21: 20, 22: 20, 23: 20, 24: 20}
    assert components(edges.limit(0)).collect() == []


def counted(monkeypatch):
    """The names under which components() stores tables from now on: one for the links and one for each round."""
    names, real = [], sys.modules[components.__module__].stored
    monkeypatch.setattr(sys.modules[components.__module__], "stored", lambda df, name: names.append(name) or real(df, name))
    return names


def test_stars_take_no_round(spark, monkeypatch):
    names = counted(monkeypatch)
    stars = spark.createDataFrame([(1, 4), (1, 9), (9, 1), (7, 8), (5, 5)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(stars).collect()} == {1: 1, 4: 1, 9: 1, 7: 7, 8: 7}
    assert len(names) == 1
    path = spark.createDataFrame([(1, 2), (3, 2), (1, 4), (4, 9)], "a long, b long")
    assert {r["node"]: r["component"] for r in components(path).collect()} == dict.fromkeys([1, 2, 3, 4, 9], 1)
    assert len(names) <= 4


def test_ranks_reach_the_driver_as_bytes(monkeypatch):
    """The driver gets one byte of each counter, and the ranks are those of the counts of all tasks."""
    monkeypatch.setattr(jaccard, "COUNTERS", 8 * jaccard._SLICES)
    parts = np.array([[0, 1, 63, 64, 65, 128, 65535, 65535], [0, 0, 0, 0, 62, 0, 65535, 0]], np.uint16)
    got = jaccard._rank_slices(pa.table({"slice": pa.array([3, 3], pa.int32()), "counts": pa.array([x.tobytes() for x in parts], pa.binary())}))
    assert got["slice"].to_pylist() == [3]
    assert list(got["ranks"][0].as_py()) == [0, 1, 63, 64, 79, 80, 239, 223]


def test_known_components_are_not_connected_anew(spark, monkeypatch):
    """Near copies are connected after the first scan; later scans start from their components."""
    names, rng = counted(monkeypatch), random.Random(8)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    texts = []
    for k in range(40):
        own = list(base)
        own[rng.randrange(400)] = f"x{k}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in jaccard.jaccard_groups(docs, 5, 80).collect()} == {0}
    assert len(names) <= 5



def test_quality(spark, docs, empty):
    rng = random.Random(1)
    good = [" ".join(rng.choices(["the", "and", "rain", "falls", "on", "hills."], k=40)) for _ in range(300)]
    bad = ["!!".join(rng.choices(["BUY", "NOW", "CHEAP", "|"], k=40)) for _ in range(100)]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(good + bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 300)) for k in range(400)] + [(None, 1), (3, None)], "doc_id long, quality int")
    trees = quality.train(table, labels)
    got = {r[0]: r[1] for r in table.select("doc_id", quality.quality_score(trees, F.col("text"))).collect()}
    held = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum((got[k] >= 0.7) == (k < 300) for k in held) / len(held) > 0.95
    scores = [r[0] for r in docs.select(quality.quality_score(trees, F.col("text"))).collect()]
    assert all(0 <= s <= 1 for s in scores)
    again = quality.train(table, labels)
    assert (again.value == trees.value).all() and (again.feature == trees.feature).all()
    constant = quality.train(empty, labels)
    assert empty.select(quality.quality_score(constant, F.col("text"))).collect() == []


def test_flat_trees_are_walked_like_nested_ones():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 30, (400, 6)).astype(np.float32)
    y = ((x[:, 1] > 12) ^ (x[:, 4] > 20)).astype(float)
    trees = quality.grow(x, y, trees=20)

    def walk(t, node, row):
        inner = trees.feature.shape[1]
        if node >= inner:
            return trees.value[t, node - inner]
        return walk(t, 2 * node + (2 if row[trees.feature[t, node]] > trees.threshold[t, node] else 1), row)

    want = [1 / (1 + math.exp(-(trees.base + sum(walk(t, 0, row) for t in range(20))))) for row in x]
    assert np.allclose(trees.score(x), want)
    assert ((trees.score(x) > 0.5) == (y > 0)).mean() > 0.95


@pytest.mark.parametrize("seed", range(5))
def test_a_split_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 9, (80, 5)).astype(np.float32)
    y = (x[:, seed % 5] + rng.integers(0, 6, 80) > 7).astype(float)
    tree = quality.grow(x, y, trees=1, depth=1)
    p = 1 / (1 + math.exp(-tree.base))
    g, h = p - y, np.full(80, p * (1 - p))

    def gain(right):
        if h[right].sum() < 1 or h[~right].sum() < 1:
            return -1.0
        return sum(g[k].sum() ** 2 / (h[k].sum() + 1) for k in (right, ~right)) - g.sum() ** 2 / (h.sum() + 1)

    best = max(gain(x[:, k] > v) for k in range(5) for v in range(9))
    right = x[:, tree.feature[0, 0]] > tree.threshold[0, 0]
    assert math.isclose(gain(right), best)
    for side, value in ((~right, tree.value[0, 0]), (right, tree.value[0, 1])):
        assert math.isclose(value, -0.15 * g[side].sum() / (h[side].sum() + 1))


def test_bpe(docs, plain, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    got = sorted(((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in bpe.encode_docs(docs, path).collect()), key=str)
    want = []
    for k, t in plain:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((k, tuple(ids), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=str)
    for t in ["aaaaaaaa 'sAAAA it's ΣΑΣ İx ﬁ <|endoftext|>ok <|startoftext|>", "\x1ca\x1db　c\xa0d​e ٣٤ x²½ 한국어 🙂🙂", "a\x00\x00b", "<|x", "ée" * 50, "ab" * 5000]:
        ids = [i for w in own.split(t) for i in ([own.special[w[1:]]] if w[0] == " " else own.encode_words([w.encode()])[0].tolist())]
        assert ids == library.encode(t, add_special_tokens=False).ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_docs(empty, path).collect() == []


def test_sharding(spark, docs, plain, empty):
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    files = sharding.reshard_files(docs, F.pmod(crc, F.lit(8)))
    out = sharding.with_slots(files.select("doc_id", "text", "shard", "shard_old", "shard_block"), ["doc_id"]).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted(plain, key=str)
    size = lambda t: len((t or "").encode()) + 1
    held = Counter()
    for r in out:
        held[r["shard"]] += size(r["text"])
    assert max(held.values()) - min(held[k] for k in range(8)) <= 3 * max(size(t) for _, t in plain)
    for k in range(8):
        assert sorted(r["slot"] for r in out if r["shard"] == k) == list(range(sum(r["shard"] == k for r in out)))
    assert sharding.reshard_files(empty, F.lit(0)).collect() == []


def test_only_affected_files_are_rewritten(spark, tmp_path):
    # Shards 0 and 1 are unequal, 2 and 3 are exact: only the first two may be written.
    rows = [(k, "x" * 9, 0) for k in range(30)] + [(100 + k, "x" * 9, 1) for k in range(10)] + [(200 + k, "x" * 9, s) for k in range(20) for s in (2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, at int")
    dealt, flow = sharding.reshard(docs, F.col("at"), 4, 4)
    assert sharding.affected(flow) == [0, 1]
    sharding.write_shards(dealt, str(tmp_path / "new"), sharding.affected(flow))
    assert sorted(p.name for p in (tmp_path / "new").glob("shard=*")) == ["shard=0", "shard=1"]
    files = sharding.reshard_files(docs, F.col("at"), 4, 4)
    named = {(r["shard"], "/new/" in r["f"]) for r in files.select("shard", F.input_file_name().alias("f")).collect()}
    assert named == {(0, True), (1, True), (2, False), (3, False)}
    assert sorted((r["doc_id"], r["at"]) for r in files.collect()) == sorted((k, s) for k, _, s in rows)
    assert Counter(r["shard"] for r in files.collect()) == {0: 20, 1: 20, 2: 20, 3: 20}


def test_cheapest_flow_moves_least():
    rng = random.Random(3)
    for _ in range(50):
        supply = [rng.randrange(100) for _ in range(rng.randrange(1, 7))]
        capacity = sharding.even_capacities(sum(supply), rng.randrange(1, 7))
        flow = sharding.cheapest_flow(supply, capacity)
        assert [sum(r) for r in flow] == supply
        assert [sum(r[j] for r in flow) for j in range(len(capacity))] == capacity
        stay = sum(min(supply[k], capacity[k]) for k in range(min(len(supply), len(capacity))))
        assert sum(flow[k][k] for k in range(min(len(supply), len(capacity)))) == stay
    assert sharding.affected([[5, 0], [2, 3]]) == [0, 1] and sharding.affected([[5, 0], [0, 3]]) == []


def test_exact_dedup(docs, plain, empty):
    norm = [(k, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for k, t in plain]
    got = exact_dedup.exact_groups(docs).collect()
    count = Counter(t for _, t in norm)
    keep = {t: min((k for k, x in norm if x == t and k is not None), default=None) for _, t in norm}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=str) == sorted([(k, keep[t], count[t], sha(t)) for k, t in norm], key=str)
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter({sha(t): 1 for t in count})
    most = exact_dedup.MOST_ENDS
    try:
        exact_dedup.MOST_ENDS = -1  # the join of very many groups
        assert sorted(exact_dedup.exact_groups(docs).collect(), key=str) == sorted(got, key=str)
    finally:
        exact_dedup.MOST_ENDS = most
    assert exact_dedup.without_copies(docs).count() == len(count)
    assert exact_dedup.without_copies(docs).columns == docs.columns
    assert exact_dedup.exact_groups(empty).collect() == []


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    data = []
    for label in (0, 1):
        centres = rng.standard_normal((12, 16))
        for k in range(220):
            data.append((len(data), (centres[k % 12] + rng.standard_normal(16) * (0.11 if k % 3 else 0.02)).tolist(), label))
    data += [(len(data) + k, v, lab) for k, (v, lab) in enumerate([(None, 0), ([0.0] * 16, 0), ([1.0, None] * 8, 0), ([float("nan")] * 16, 1), (data[0][1], 0), (data[0][1], None), ([2 * x for x in data[0][1]], 0), ([1.0, 0.0], 0), ([2.0, 0.0], 0), ([], 0)])]
    table = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("cls", F.lit(1))
    good = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    use = [(k, np.array(v), lab) for k, v, lab in data if good(v) and lab is not None]
    links, parent = Counter(), {k: k for k, *_ in data}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (k, v, lab) in enumerate(use):
        for m, w, other in use[:i]:
            if lab == other and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links[k] += 1
                links[m] += 1
                a, b = find(k), find(m)
                parent[max(a, b)] = min(a, b)
    assert sum(links.values()) > 100
    want = [(k, links[k], find(k), find(k) == k) for k, *_ in data]
    tile, one_axis = embed.TILE, embed.ONE_AXIS
    try:
        for embed.TILE, embed.ONE_AXIS in ((tile, one_axis), (7, one_axis), (tile, 1)):
            assert sorted(tuple(r) for r in embed.embedding_groups(table).collect()) == want
    finally:
        embed.TILE, embed.ONE_AXIS = tile, one_axis
    # Text identifiers, single precision.
    near = [("b", [1.0, 2.0, 3.0], 0), ("a", [1.0, 2.0, 3.05], 0), ("c", [3.0, -2.0, 1.0], 0), (None, [1.0, 2.0, 3.0], 0)]
    few = spark.createDataFrame(near, "vec_id string, embedding array<float>, label int")
    told = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embed.embedding_groups(few).collect()}
    assert told == {"a": (1, "a", True), "b": (1, "a", False), "c": (0, "c", True), None: (0, None, True)}
    assert embed.embedding_groups(table.limit(0)).collect() == []


def test_lm(docs, plain, empty):
    words = [WORDS.findall(lower(t or "")) for _, t in plain]
    train = [k is None or zlib.crc32(str(k).encode()) % 5 != 1 for k, _ in plain]
    count = Counter(w for ws, t in zip(words, train, strict=True) if t for w in ws)
    ends = sum(train)
    tokens, kinds = sum(count.values()) + ends, len(count) + 1
    mass = math.log10(tokens + 0.5 * (kinds + 1))
    want = sorted([(str(k), len(w) + 1, sum(x in count for x in w) + 1, tokens, round(sum(math.log10(count[x] + 0.5) - mass for x in w) + math.log10(ends + 0.5) - mass, 6)) for (k, _), w in zip(plain, words, strict=True)])
    got = lm.score_texts(docs).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert lm.score_texts(empty).collect() == []
    assert all(r["n_known"] == 0 for r in lm.score_texts(docs, train=F.lit(False)).collect())


def test_lm_frequent_words_have_contexts(spark):
    """Three frequent words, of which the next one follows from the two before but from neither alone."""
    rng = random.Random(5)

    def said():
        w = [rng.randrange(3), rng.randrange(3)]
        while len(w) < 200:
            w.append((w[-1] + w[-2]) % 3)
        return " ".join("abc"[x] for x in w)

    docs = spark.createDataFrame([(k, said()) for k in range(60)], "doc_id long, text string")
    held_out = [r for r in lm.score_texts(docs, train=F.col("doc_id") % 5 != 1).collect() if r["doc_id"] % 5 == 1]
    n = sum(r["n_tokens"] for r in held_out)
    assert sum(r["base_score"] for r in held_out) / n < -0.45
    assert sum(r["score"] for r in held_out) / n > -0.1


def brute_lm(rows, train, share=0.0):
    """score of each (text, taught): the same model with dictionaries, one token at a time."""
    texts = [WORDS.findall(lower(t or "")) for t in rows]
    count = Counter(w for ws, t in zip(texts, train, strict=True) if t for w in ws)
    ends = sum(train)
    least = max(2, share * (sum(count.values()) + ends))
    hot = {w for w, n in count.items() if n >= least}
    seqs = [["END", *(w if w in hot else "ESC" for w in ws), "END"] for ws in texts]
    single = Counter(x for q, t in zip(seqs, train, strict=True) if t for x in q[1:])
    mass = sum(single.values()) + 2
    first = lambda x: (single[x] + (x in ("END", "ESC"))) / mass
    runs = Counter(tuple(q[i : i + m]) for q, t in zip(seqs, train, strict=True) if t for m in range(2, lm.CONTEXT + 2) for i in range(len(q) - m + 1))
    runs = {r: n for r, n in runs.items() if n >= least}
    nexts = defaultdict(list)
    for r in runs:
        nexts[r[:-1]].append(r)
    size = lambda c: single[c[0]] if len(c) == 1 else runs[c]

    @cache
    def kept(c):
        mine, total = nexts.get(c, []), size(c)
        if not mine:
            return False
        left = max(total - sum(runs[r] for r in mine), 0) / total
        rest = 1 - sum(p(r[1:-1], r[-1]) for r in mine)
        gain = sum(runs[r] / total * math.log(runs[r] / total / p(r[1:-1], r[-1])) for r in mine)
        return gain + left * math.log(max(left, 1e-12) / max(rest, 1e-12)) >= lm.LEAST_DIVERGENCE

    @cache
    def p(c, x):
        if not c:
            return first(x)
        known = len(c) == 1 or c in runs
        back = p(c[1:], x)
        if not known or not kept(c):
            return back
        mine = nexts[c]
        listed = sum(runs[r] for r in mine)
        whole = max(size(c), listed) + len(mine)
        return back * (whole - listed) / whole + runs.get((*c, x), 0) / whole

    grams = Counter()
    for ws, t in zip(texts, train, strict=True):
        said = b"\n" * lm.DEPTH
        for w in ws:
            for byte in w.encode() + b" ":
                if t and w not in hot:
                    grams.update((said[len(said) - d :], byte) for d in range(lm.DEPTH + 1))
                said += bytes([byte])
    all_of = Counter()
    for (c, _), n in grams.items():
        all_of[c] += n
    after = defaultdict(dict)
    for (c, b), n in grams.items():
        after[c][b] = n

    @cache
    def spelled(c, b):
        if not c:
            return (grams[b"", b] + 0.5) / (all_of[b""] + 128)
        back, n = spelled(c[1:], b), all_of[c]
        if n < max(2, lm.LEAST_SHARE * all_of[b""]) or sum(x / n * math.log(x / n / (after[c[1:]][k] / all_of[c[1:]])) for k, x in after[c].items()) < lm.LEAST_DIVERGENCE:
            return back
        return (back * len(after[c]) + after[c].get(b, 0)) / (n + len(after[c]))

    rare = [n for w, n in count.items() if w not in hot]
    listed = (sum(rare) - rare.count(1)) / (sum(rare) + 1)
    scores, met = [], []
    for k, (ws, q, t) in enumerate(zip(texts, seqs, train, strict=True)):
        total, said = 0.0, b"\n" * lm.DEPTH
        for i, x in enumerate(q[1:], 1):
            local = math.log10(p(tuple(q[max(0, i - lm.CONTEXT) : i]), x))
            if i <= len(ws):
                body = ws[i - 1].encode() + b" "
                if x == "ESC":
                    full = said + body
                    spell = math.prod(spelled(full[j - lm.DEPTH : j], full[j]) for j in range(len(said), len(full)))
                    total += math.log10((1 - listed) * spell + listed * count[ws[i - 1]] / max(1, sum(rare)))
                said += body
            total += local
            if i > 1 and q[i - 1] == "ESC":
                met.append((k, ws[i - 2], (x, ws[i - 1]) if i <= len(ws) and x != "ESC" else (x, None), t, local))
        scores.append(total)
    of, pair = Counter(m[1] for m in met if m[3]), Counter(m[1:3] for m in met if m[3])
    gain = Counter()
    for _, w, x, t, local in met:
        if t:
            gain[w] += math.log10((pair[w, x] - 1 + lm.SMOOTHING * 10**local) / (of[w] - 1 + lm.SMOOTHING)) - local
    for k, w, x, _, local in met:
        if gain[w] > lm.LEAST_GAIN:
            scores[k] += math.log10((pair[w, x] + lm.SMOOTHING * 10**local) / (of[w] + lm.SMOOTHING)) - local
    return scores


@pytest.mark.parametrize("share", [0.0, 0.004])
def test_lm_scores_match_brute_force(docs, plain, share):
    train = [k is None or zlib.crc32(str(k).encode()) % 5 != 1 for k, _ in plain]
    want = sorted(zip((str(k) for k, _ in plain), brute_lm([t for _, t in plain], train, share), strict=True))
    got = sorted((str(r["doc_id"]), r["score"]) for r in lm.score_texts(docs, buckets=5, hot_share=share).collect())
    assert [k for k, _ in got] == [k for k, _ in want]
    assert all(abs(a - b) < 1e-4 * max(1, abs(b)) for (_, a), (_, b) in zip(got, want, strict=True))


@pytest.mark.parametrize("share", [0.0, 0.05])
def test_lm_probabilities_sum_to_at_most_one(spark, share):
    """All texts of no word or one, known and unknown, and all continuations of a text by one word, frequent or rare."""
    rng = random.Random(9)
    kinds = ["the", "of", "cat", "dog", *[a + b for a in "abcde" for b in "xyz"]]
    taught = [" ".join(rng.choices(kinds, [40, 20, 8, 4] + [1] * 15, k=rng.randrange(0, 9))) for _ in range(120)]
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = sorted({*kinds, *letters, *(a + b for a in letters for b in letters)})
    begins = ["", "the ", "ax ", "of ax "]
    docs = [(k, t) for k, t in enumerate(taught)] + [(1000 + k, None if not b else b.strip()) for k, b in enumerate(begins)] + [(10_000 * (k + 1) + i, b + w) for k, b in enumerate(begins) for i, w in enumerate(words)]
    got = {r["doc_id"]: r["score"] for r in lm.score_texts(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), train=F.col("doc_id") < 1000, hot_share=share).collect()}
    for k, _ in enumerate(begins):
        total = 10 ** got[1000 + k] + sum(10 ** got[10_000 * (k + 1) + i] for i in range(len(words)))
        # The text itself, and the text and one word more, are different texts.
        assert 0 < total <= 1.0
    assert 10 ** got[1000] + sum(10 ** got[10_000 + i] for i in range(len(words))) > 0.05


def test_words_are_distributions():
    rng = np.random.default_rng(3)
    seq = np.concatenate([np.r_[1, np.where(rng.random(30) < 0.7, 2 + np.arange(30) % 4, rng.integers(0, 6, 30)), 1] for _ in range(80)])
    seq[(np.arange(len(seq)) % 32 % 31 > 0) & (seq == 1)] = 0
    place, keys, counts = np.arange(len(seq)) % 32, [], []
    for m in range(2, 2 + lm.CONTEXT):
        last = lm._runs(keys, seq, place)[-1]
        use = np.flatnonzero((place[1:] >= m - 1) & (last[:-1] >= 0) & (last[1:] >= 0)) + 1
        key, n = np.unique((last[use - 1] << lm._BITS) | seq[use], return_counts=True)
        keys, counts = [*keys, key[n >= 3]], [*counts, n[n >= 3]]
    words = lm.Words(np.bincount(seq[place > 0], minlength=6), keys, counts)
    assert all(len(k) for k in keys) and all((w < 1).any() for w in words.weights)
    for before in ([1], [1, 2], [1, 2, 3], [1, 0, 4, 5], [1, 5, 2, 3, 4], [1, 3, 3, 3]):
        rows = [np.array([*before, s]) for s in range(6)]
        p = [words.probabilities(lm._runs(keys, r, np.arange(len(r))), np.arange(len(r)))[-1] for r in rows]
        assert np.isclose(sum(p), 1)


def test_tree_states_are_longest_suffixes():
    contexts = [(1, ord("a")), (2, (ord("a") << 8) | ord("b")), (3, (ord("x") << 16) | (ord("a") << 8) | ord("b"))]
    tree = lm.Tree(np.ones(256), contexts, np.array([97, 98, 99]), np.array([10.0, 20.0, 30.0]), np.array([0, 1, 2]))
    probabilities = 10 ** tree.log.reshape(-1, 256)
    assert np.allclose(probabilities.sum(axis=1), 1)
    row = np.frombuffer(b"\n" * lm.DEPTH + b"xabc" * 200, np.uint8)
    logs = tree.logs(row)
    by_hand = []
    for i in range(len(row)):
        before, best = bytes(row[:i]), 0
        for k, (d, v) in enumerate(contexts):
            if before.endswith(v.to_bytes(d, "big")) and d > (contexts[best - 1][0] if best else 0):
                best = k + 1
        p, chain = (np.ones(256) + 0.5) / (256 + 128), [k for k, (d, v) in enumerate(contexts) if best and contexts[best - 1][1] & ((1 << 8 * d) - 1) == v and d <= contexts[best - 1][0]]
        for k in sorted(chain, key=lambda k: contexts[k][0]):
            n = [10, 20, 30][k]
            p = p / (n + 1)
            p[97 + k] += n / (n + 1)
        by_hand.append(math.log10(p[row[i]]))
    assert np.allclose(logs, by_hand)


CONTROL = ["</s>[INST] ok [/INST]", "<s>", "a\\b", "\\", "\\\\n", "<\\/s>", "[INST]", "x</s", "<", "[/INST] ", "line\nline", "", None, " [/INST] ", "é" * 5000]


def test_chat(spark):
    turns = [(c, t, r, CONTROL[(c * 3 + t) % len(CONTROL)]) for c in range(8) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"])]
    turns += [(9, 1, "assistant", "tie"), (9, 1, "assistant", "tie"), (9, None, "user", "no turn"), (None, 0, "assistant", "no id"), (9, 2, None, "</s>")]
    table = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, piece string")
    out = chat.format_chats(table)
    assert all(r["round_trip"] for r in out.collect())
    back = {r["conv_id"]: r for r in chat.read_chats(out).collect()}
    spans = {r["conv_id"]: (r["formatted"], r["loss_spans"]) for r in out.collect()}
    for c in {t[0] for t in turns}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in turns if k == c))
        assert [(r["role"], r["text"]) for r in back[c]["turns"]] == [o[2:] for o in own]
        assert back[c]["loss_texts"] == [o[3] for o in own if o[2] == "assistant"]
        text, marked = spans[c]
        assert [re.sub(r"(?s)\\(.)", r"\1", text[s["start"] : s["start"] + s["length"]]) for s in marked] == back[c]["loss_texts"]
    assert chat.format_chats(table.limit(0)).collect() == []
    # The loss follows the mask, not the roles: a shorter mask gives a shorter loss.
    cut = out.withColumn("loss_spans", F.slice("loss_spans", 1, 1))
    assert {r["conv_id"]: r["loss_texts"] for r in chat.read_chats(cut).collect()} == {c: r["loss_texts"][:1] for c, r in back.items()}
    assert chat.read_chats(chat.proven(out)).count() == out.count()
    with pytest.raises(Exception, match="no round trip"):
        chat.proven(out.withColumn("round_trip", F.lit(False))).collect()


OWN_NAMES = ["kept_key", "kept_id", "kept_sha", "mix_source", "mix_size", "mix_copies", "mix_key", "mix_row", "target", "source_size", "known_id", "known_label",
    "shard", "shard_old", "shard_new", "shard_size", "d_old", "lead", "norm", "body", "doc", "sketch", "key", "bucket", "taught"]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_clashing_names_and_text_identifiers(spark, kind):
    texts_ = ["a b c d e f", "a b c d e f", "long " * 1_000_000, None, "", "g h i j k l m n o p"]
    rows = [(k if kind == "long" else f"id{k}", t, "s", *[7] * len(OWN_NAMES)) for k, t in enumerate(texts_)]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string, source string, " + ", ".join(f"{c} int" for c in OWN_NAMES))
    labels = spark.createDataFrame([(r[0], k % 2) for k, r in enumerate(rows)], f"doc_id {kind}, quality int")
    assert len(exact_dedup.without_copies(docs).collect()) == 4  # null and empty are equal, too
    assert exact_dedup.without_copies(docs).columns == docs.columns
    assert mixing.mixed(docs).columns == docs.columns
    assert {r["mix_row"] for r in mixing.mixed(docs).collect()} == {7}
    assert mixing.mix_plan(docs).count() == 6
    assert sharding.reshard_files(docs, F.lit(0)).count() == 6
    assert quality.train(docs, labels) is not None
    assert substring.remove_repeats(docs).count() == 6
    assert lm.score_texts(docs).count() == 6
    assert jaccard.jaccard_groups(docs).select("component_id").distinct().count() == 5


def targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    capped, left = {}, sum(sizes.values())
    open_ = set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] >= 3 * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in open_}
        for s in over:
            capped[s] = 3 * sizes[s]
            left -= 3 * sizes[s]
            open_.discard(s)
    return capped


def test_mixing(docs, plain, empty):
    plan = mixing.mix_plan(docs).collect()
    sizes = Counter()
    for r in docs.collect():
        sizes[r["source"]] += len(WORDS.findall(r["text"] or ""))
    want = targets(sizes)
    for r in plan:
        assert r["mix_size"] == len(WORDS.findall(r["text"] or "")) and r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9)
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert math.floor(rate) <= r["mix_copies"] <= math.floor(rate) + 1 and r["mix_copies"] <= 3
    assert mixing.mixed(docs).count() == sum(r["mix_copies"] for r in plan)
    assert mixing.mixed(docs).columns == docs.columns
    assert mixing.mix_plan(empty).collect() == []


def test_queries_are_whole(spark):
    from labelsieve.llm import queries as q

    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    for name in ("op1_substring", "op3_quality", "op4_bpe", "op5_sharding", "op6_exact_dedup", "op10_mixing"):
        assert q.queries()[name](spark, d).count() == n


@pytest.mark.parametrize("percent", [80, 90])
def test_jaccard_lists_keep_every_link(percent):
    """Random sets with near copies of all sizes: no linking pair lacks a list that keeps both, or is rejected by its sketches."""
    rule, rng = jaccard.Rule(percent), np.random.default_rng(percent)
    sets = []
    for size in [30, 45, 78, 85, 150, 310, 330, 700, 1300, 2600]:
        own = rng.integers(0, 2**63, size)
        for drop, add in [(0, 0), (size // 12, 0), (0, size // 11), (size // 20, size // 20), (size // 9, 0), (0, size // 5)]:
            sets.append(np.unique(np.concatenate([own[drop:], rng.integers(0, 2**63, add)])).astype(np.uint64))
    size, key = np.array([len(s) for s in sets]), np.arange(len(sets))
    packed_h, packed_k, packed_s = [], [], []
    for i, s in enumerate(sets):
        for at, h in enumerate(s[: rule.missing(len(s)) + 1]):
            packed_h.append(int(h) & ~1)
            packed_k.append(i)
            packed_s.append(len(s) << 1 | (at <= rule.apart(2 * len(s)) // 2))
    table = pa.table({"h": [np.array(packed_h, np.uint64).tobytes()], "key": [np.array(packed_k, np.int64).tobytes()], "size": [np.array(packed_s, np.uint32).tobytes()]})
    lists = jaccard._lists(rule)(table).to_pandas()
    together = {(a, b) for _, g in lists.groupby("token") for a in g["key"] for b in g["key"]}
    width = rule.cells(size)
    cells = []
    for s, w in zip(sets, width, strict=True):
        parity = (np.bincount((s >> np.uint64(64 - int(np.log2(w)))).astype(np.int64), minlength=w) & 1).astype(np.uint8)
        cells.append(np.packbits(parity).tobytes())
    sketches = jaccard._Sketches(pa.chunked_array([pa.array(cells, pa.binary())]), size, rule)
    links = [(i, j) for i in key for j in key if i < j and rule.holds(len(np.intersect1d(sets[i], sets[j])), size[i], size[j])]
    assert len(links) > 20 and any(width[i] != width[j] for i, j in links)
    assert set(links) <= together
    a, b = np.array(links).T
    assert sketches.possible(a, b).all()
    a, b = np.array([(i, j) for i in key for j in key if i < j and not len(np.intersect1d(sets[i], sets[j]))]).T
    assert sketches.possible(a, b).mean() < 0.01


def templates(n, slots=500, words=6000):
    """Long texts that are alike but for `slots` places with two ways each; none links with another."""
    rng = random.Random(n)
    base = [f"w{k}" for k in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for k in range(slots):
            own[k * (words // slots)] = f"s{k}{rng.choice('ab')}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_many_long_unlinked_near_copies_give_few_pairs(spark, monkeypatch, n, percent):
    """Rows that the scans give, and pairs compared whole, don't grow with the square of a group."""
    told = []
    keep = jaccard.stored

    def watched(df, name):
        out = keep(df, name)
        if name in ("scan", "pairs"):
            told.append((name, out.count()))
        return out

    monkeypatch.setattr(jaccard, "stored", watched)
    counts = []
    for k in (40, 80, 160):
        told.clear()
        docs = spark.createDataFrame(list(enumerate(templates(k))), "doc_id long, text string")
        got = jaccard.jaccard_groups(docs, n, percent).collect()
        assert all(r["doc_id"] == r["component_id"] for r in got) and len(got) == k
        counts.append([x for _, x in told])
    for a, b in zip(counts, counts[1:]):
        assert all(y <= max(2.5 * x, 20) for x, y in zip(a, b, strict=True)), counts
    assert counts[-1][-1] == 0  # the last scan's pairs


def test_long_near_copies_link_across_components(spark, monkeypatch):
    """Links that no partner scan has to find are found by the last one, tiles and folded sketches included."""
    monkeypatch.setattr(jaccard, "TILE", 10)
    rng, out = random.Random(2), []
    for t in range(3):
        for text in templates(20, 4, 1200 + 900 * t):
            own = text.split()
            for _ in range(rng.randrange(5, 35 + 30 * t)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(own[: len(own) - rng.randrange(0, 30)]))
    sets = [shingles(x, 3) for x in out]
    parent = list(range(len(out)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(out)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    docs = spark.createDataFrame(list(enumerate(out)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_groups(docs).collect()}
    assert got == {k: find(k) for k in range(len(out))} and 3 < len(set(got.values())) < len(out)
