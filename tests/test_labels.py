"""Label operators on golden cases, against brute force, and streaming against batch."""

import random
import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelsieve.functions import text as tx
from labelsieve.operators import codes, judge, matcher, scan
from labelsieve.operators import findings as fi
from labelsieve.operators import history as hi
from labelsieve.operators import lines as ln
from labelsieve.operators import segments as sg
from labelsieve.operators import stitch as st
from labelsieve.operators.scan import scan_dictionary
from labelsieve.operators.stitch import line_overlap, overlap_candidates, stitch_lines
from labelsieve.plans import packs
from labelsieve.plans.screen import screen_columns, screen_labels
from labelsieve.sources.seeds import lexicon
from labelsieve.sources.tables import Settings, build_nonfood_dictionary, load_dictionary, load_products, union_dictionaries, write_results
from labelsieve.streaming import live


@pytest.fixture(scope="module")
def words(spark):
    return lexicon(spark)


CASES = {
    "配料:鱿鱼肉松、白砂糖": {"level": "clean", "terms": ["鱿鱼", "肉松"], "status": ["seafood", "seafood"]},
    "配料:鱼肉丸、水": {"level": "clean", "terms": []},
    "配料:鸭肉松": {"level": "doubtful", "terms": ["鸭肉松"]},
    "配料:水、不添加酒精、不含猪肉、零添加香精": {"level": "clean", "terms": [], "positives": ["不添加酒精", "不含猪肉", "零添加香精"]},
    "配料:水,乳化剂(471,322),增稠剂(INS 407、412)": {"terms": ["INS 471 单双甘油脂肪酸酯"], "codes": {"471", "322", "407", "412"}},
    "规格(428,441)克": {"codes": set(), "found": False},
    "【配料】生牛乳": {"found": True, "level": "clean"},
    "配料:生牛乳": {"found": True},
    "配料:某某": {"found": False},
    "营养成份表 能量100kJ": {"found": False},
    "主要原料来源地：中国": {"found": False},
    "配料:100%椰子水": {"coverage": 1.0},
    "巧克力味云石切片面包": {"product": "面包", "level": "caution"},
    "酒仙桥路1号 骨干企业 配料:水、白砂糖": {"terms": [], "elsewhere": [], "level": "clean"},
    "CUSTARD pie 点心": {"product": "CUSTARD PIE"},
    "湿巾 180mm×180mm 净含量：1张": {"kind": "nonfood"},
    "配料:肉桂、果肉、蛇果、驴打滚": {"terms": []},
    "配料:水 E120 E124": {"terms": ["INS 120 胭脂虫红"], "level": "doubtful"},
    "小猪佩奇 湿巾 成分:水": {"kind": "nonfood", "terms": []},
    "皮肤": {"kind": "nonfood"},
    "配料:单，双甘油脂肪酸酯、水": {"terms": ["单,双甘油脂肪酸酯"]},
    "halal 配料:水": {"positives": ["HALAL"]},
    "产品名称:香辣猪肉脯\n配料:水、白砂糖": {"level": "haram", "name": "香辣猪肉脯"},
    "白酒 酒精度38%vol": {"level": "haram", "alcoholic": True},
    "火腿肠": {"level": "likely", "terms": ["火腿肠"]},
    "": {"level": "unknown", "found": False},
}


def test_golden_cases(spark, words):
    table = spark.createDataFrame([*enumerate(CASES), (99, None)], "label_id long, text string")
    screened = screen_labels(table, words)
    got = {r["label_id"]: r for r in screened.collect()}
    assert len(got) == len(CASES) + 1 and got[99]["verdict"]["level"] == "unknown"
    for k, (text, want) in enumerate(CASES.items()):
        r = got[k]
        seen = {
            "level": r["verdict"]["level"], "kind": r["kind"], "found": r["section"]["found"], "terms": [f["term"] for f in r["findings"]], "status": [f["status"] for f in r["findings"]], "elsewhere": [f["term"] for f in r["elsewhere"]],
            "positives": [p["term"] for p in r["positives"]], "codes": {c["code"] for c in r["codes"]}, "coverage": r["quality"]["coverage"], "product": r["product"] and r["product"]["name"], "name": r["name"] and r["name"]["zh"], "alcoholic": r["alcoholic"],
        }
        for key, value in want.items():
            assert seen[key] == value, (text, key, seen[key], value)
        for f in r["findings"]:
            s = f["snippet"]
            if f["source"] in ("dict", "rule"):
                assert s["text"][s["offset"] : s["offset"] + s["length"]] == f["term"]
        assert 0 <= r["quality"]["coverage"] <= 1
    strict = screen_labels(spark.createDataFrame([(1, "配料:虾、食用香精")], "label_id long, text string"), words, Settings(seafood_strict=True, flag_flavourings=True)).first()
    assert [f["status"] for f in strict["findings"]] == ["school", "caution"]


ODD = [
    "配料", "配料:", "配料表", "【配料】", "营养", "主要成分", "成分:", "Ingredients", "净含量", "净含量:100克", "地址:", "酒仙桥路1号", "产品名称:", "品名 ", "名称", "猪肉", "肉松", "肉丸", "鱿鱼", "鸭", "果", "肉", "骨", "血", "胶囊", "胶", "酒", "驴打滚",
    "蛇", "狗", "鸡", "蛋", "牛", "halal", "HALAL", "Halal", "x", "L-肉碱", "单,双甘油脂肪酸酯", "虾", "甲壳素", "食用香精", "酵母", "清真", "素食", "白砂糖", "水", "甘油", "胶原蛋白", "不含", "零添加", "未添加", "无",
    "乳化剂(471,322)", "增稠剂(INS 407、412)", "色素(E120)", "(428,441)克", "E124", "E472e", "E 100a", "INS-999", "E100ml", "(", ")", "GB(471)", "（322）", "湿巾", "香皂", "皮肤", "清洁", "羊绒皂", "羊毛脂", "180mm×180mm", "净含量：1张", "绿茶", "火腿肠", "火腿", "CUSTARD PIE",
    "啤酒", "面包", "巧克力", "酒精度", "38%vol", "ABV", "alc.5", "[unreadable]", "、", "，", "；", "。", "·", "：", ":", " ", "  ", "\t", "\n", "\n\n\n", "\r\n", "\r", "\u2028", "\x85", "\u3000", "\xa0", "１２３", "Ａ", "‘", "”", "é", "某", "来源", "12", "3.5%", "SC123456789012", "食用方法",
]


def odd_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices(ODD, k=rng.randrange(0, rng.choice([4, 12, 40])))) for _ in range(n)]


def test_screen_in_tasks_equals_columns(spark, words):
    """Each label is judged where it is read, with the results that the columns for large lexicons give; nothing is joined or shuffled."""
    rng = random.Random(8)
    rows = [(k, t, rng.choice([None, 10, 60, 90]), rng.choice([None, None, None, "food", "nonfood"]), rng.choice([None, None, True, False]), rng.choice([None, None, "", "site"])) for k, t in enumerate([*CASES, None, *odd_texts(17, 3000)])]
    table = spark.createDataFrame(rows, "label_id long, text string, ocr_confidence int, product_kind string, ai_read boolean, web_source string")
    for settings in (Settings(), Settings(seafood_strict=True, flag_flavourings=True, max_chars=20)):
        own, columns = screen_labels(table, words, settings), screen_columns(table, words, settings)
        assert "Exchange" not in own._jdf.queryExecution().executedPlan().toString()
        assert own.dtypes == columns.dtypes
        got, want = ({r["label_id"]: r.asDict(True) for r in df.collect()} for df in (own, columns))
        assert len(got) == len(rows)
        for k, _, *given in rows:
            assert got[k] == want[k], (rows[k], {c: (got[k][c], want[k][c]) for c in want[k] if got[k][c] != want[k][c]})
        if settings == Settings():
            assert {r["kind"] for r in got.values()} == {"food", "nonfood"} and len({r["verdict"]["title"] for r in got.values()}) > 20
    some = screen_labels(table, words, columns=["verdict", "kind"]).collect()
    assert {r["label_id"]: (r["kind"], r["verdict"]["level"]) for r in some} == {r["label_id"]: (r["kind"], r["verdict"]["level"]) for r in screen_labels(table, words).collect()}


def test_a_report_computes_no_more_than_it_asks_for(spark, words, monkeypatch):
    """The gaps of the dictionary need no findings, codes or verdict; what is left out changes no other column."""
    table = spark.createDataFrame(list(enumerate(odd_texts(23, 500))), "label_id long, text string")
    whole = {r["label_id"]: r.asDict(True) for r in screen_labels(table, words).collect()}
    for some in (["segments"], ["kind", "verdict"], ["findings"], ["section", "name", "product"]):
        got = screen_labels(table, words, columns=some)
        assert got.columns == ["label_id", *some]
        assert {r["label_id"]: r.asDict(True) for r in got.collect()} == {k: {c: r[c] for c in got.columns} for k, r in whole.items()}
    matcher_ = scan.Terms(words.terms()).shared.value
    one = judge.Screener(matcher_, {}, [], Settings(), ["segments"])
    monkeypatch.setattr(one, "_roles", None)
    monkeypatch.setattr(judge, "food_verdict", None)
    assert [x[1] for x in one.screen(["配料:水、某某某某、猪肉"])[0].segments] == ["水", "某某某某", "猪肉"]


def test_normalized_text_is_that_of_the_column(spark):
    texts = odd_texts(5, 2000)
    got = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", tx.normalize_text("t").alias("n")).collect()
    assert {r["id"]: r["n"] for r in got} == {k: judge.normalized(t) for k, t in enumerate(texts)}


def test_scan_is_leftmost_longest(spark, words):
    entries = [(r["ord"], r["term"]) for r in words.dictionary.collect()]
    rng = random.Random(4)
    pieces = [t for _, t in entries] + ["a", "x", "、", "\n", "halalx", "的", "1"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(0, 30))) for _ in range(80)] + ["", None]
    got = {}
    for r in scan_dictionary(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), ["id"], "t", words.dictionary).collect():
        got.setdefault(r["id"], []).append((r["start"], r["end"], r["term"]))
    ordered = sorted(entries, key=lambda e: (-len(e[1]), e[0]))
    for k, t in enumerate(texts):
        t, i, want = t or "", 0, []
        while i < len(t):
            for _, term in ordered:
                piece = t[i : i + len(term)]
                if term.isascii():
                    fits = piece.lower() == term.lower() and not re.match("[A-Za-z]", t[i - 1 : i] if i else "") and not re.match("[A-Za-z]", t[i + len(term) : i + len(term) + 1])
                else:
                    fits = piece == term
                if fits:
                    want.append((i, i + len(term), term))
                    i += len(term)
                    break
            else:
                i += 1
        assert sorted(got.get(k, [])) == want, t


def test_text_functions(spark):
    df = spark.createDataFrame([("ＡＢ　１、 猪 肉\r\n\n\n\nx  y", "zhūròu Lǜ", "产品名称")], "t string, py string, name string")
    r = df.select(tx.normalize_text("t").alias("n"), tx.strip_tones("py").alias("py"), tx.squash_ws("t").alias("q"), tx.ocr_post_process("t").alias("o"), tx.cjk_count("t").alias("c"), tx.ai_text_usable(F.lit("配料: 水糖盐油[unreadable]")).alias("u")).first()
    assert r["n"] == "AB 1、猪肉\n\nx y" and r["py"] == "zhurou lv" and r["c"] == 2 and r["u"] is False
    assert r["q"] == "ＡＢ１、猪肉xy" and r["o"].startswith("AB 1、猪肉")
    snip = df.select(tx.snippet(F.lit("0123456789" * 5), F.lit(20), F.lit(3)).alias("s")).select("s", tx.mark_snippet(F.col("s"), F.lit("012")).alias("m")).first()
    assert snip["s"]["text"][snip["s"]["offset"] :][:3] == "012" and "<mark>012</mark>" in snip["m"]
    guess = df.select(tx.lookup_name_guess(F.lit(""), F.lit("x" * 30 + "香脆大面包干"), F.lit("面包")).alias("a"), tx.lookup_name_guess(F.lit(None), F.lit("短名"), F.lit(None)).alias("b")).first()
    assert guess["a"] == "香脆大面包干" and guess["b"] == "短名"


def test_dictionaries(spark, words):
    schema = "ord int, term string, status string, en string, py string, category string, note string"
    base = load_dictionary(spark.createDataFrame([(0, "料酒", "haram", None, "", "alcohol", ""), (1, "牛肉", "meat", "beef", "", "", ""), (2, "", "ok", "", "", "", ""), (3, "水", None, "", "", "", "")], schema))
    assert [(r["term"], r["status"], r["en"]) for r in base.orderBy("ord").collect()] == [("料酒", "haram", ""), ("牛肉", "meat", "beef"), ("水", "ok", "")]
    over = load_dictionary(spark.createDataFrame([(0, "牛肉", "ok", "", "", "", ""), (1, "新", "animal", "", "", "", "")], schema))
    assert [(r["term"], r["status"]) for r in build_nonfood_dictionary(base, over).orderBy("ord").collect()] == [("料酒", "alcohol"), ("牛肉", "ok"), ("水", "ok"), ("新", "animal")]
    assert union_dictionaries(base, over).count() == 5
    products = load_products(spark.createDataFrame([(0, "派|饼", "caution", "pie", "", "")], "ord int, names string, level string, en string, typical string, note string"))
    assert [r["alias"] for r in products.orderBy("ord").collect()] == ["派", "饼"]
    assert {r["term"] for r in hi.lookup(words.dictionary, "ZHU").collect()} == {"猪肉", "猪油"} and hi.lookup(words.dictionary, " ").count() == 0
    assert {r["term"] for r in hi.glossary_filter(words.dictionary, "haram", "wine").collect()} == {"料酒"}
    assert [r["ord"] for r in hi.page(words.dictionary, 2, 1).collect()] == [1, 2]


def test_results_of_a_day_are_written_once(spark, words, tmp_path):
    schema, out = "label_id long, text string", str(tmp_path / "out")
    first = spark.createDataFrame([(1, "配料:猪肉"), (2, "配料:水(E120)")], schema)
    owner = spark.createDataFrame([(1, 7, 100), (2, 8, 101)], "label_id long, user_id long, ts long")
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    write_results(screen_labels(first, words), out, "2024-05-01", owner)
    write_results(screen_labels(spark.createDataFrame([(3, "配料:水、食用盐")], schema), words), out, "2024-05-02")
    # The day runs again, and a label's level has changed.
    write_results(screen_labels(spark.createDataFrame([(1, "配料:水、食用盐"), (2, "配料:水(E120)")], schema), words), out, "2024-05-01", owner)
    assert sorted((str(r["day"]), r["label_id"], r["level"]) for r in read("labels").collect()) == [("2024-05-01", 1, "clean"), ("2024-05-01", 2, "doubtful"), ("2024-05-02", 3, "clean")]
    assert [(r["label_id"], r["code"]) for r in read("codes").collect()] == [(2, "120")]
    assert sorted((r["label_id"], r["no"], r["zh"]) for r in read("segments").filter("label_id <> 2").collect()) == [(1, 0, "水"), (1, 1, "食用盐"), (3, 0, "水"), (3, 1, "食用盐")]
    history = read("history")
    assert sorted((r["user_id"], r["ts"], r["verdict_level"]) for r in history.collect()) == [(7, 100, "clean"), (8, 101, "doubtful")]
    assert hi.history_preview(history).count() == hi.latest_history(history).count() == 2


def test_lookups_by_stretches(spark):
    rng = random.Random(17)
    entries = [(k, "".join(rng.choices("猪肉油水ab", k=rng.randrange(1, 6))), "".join(rng.choices("abc de", k=rng.randrange(0, 9))), "".join(rng.choices("zhū āi", k=rng.randrange(0, 7)))) for k in range(80)]
    dictionary = spark.createDataFrame(entries, "ord int, term string, en string, py string")
    asked = [(k, "".join(rng.choices("猪肉油abc zhuai", k=rng.randrange(0, 5)))) for k in range(300)] + [(1000 + k, " 猪肉 ") for k in range(50)] + [(2000, None)]
    got = {tuple(r) for r in hi.lookup_many(spark.createDataFrame(asked, "query_id long, query string"), dictionary).collect()}
    plain = {r["ord"]: r["p"] for r in dictionary.select("ord", tx.strip_tones("py").alias("p")).collect()}
    want = {(k, o, t) for k, q in asked if q and q.strip() for o, t, e, _ in entries if any(q.strip().lower() in x for x in (t.lower(), e.lower(), plain[o]))}
    assert got == want and len(want) > 300


def test_stitching(spark):
    assert line_overlap("甲乙丙丁", "乙丙丁戊") == 3 and line_overlap("甲乙丙丁", "xxx乙丙丁戊") is None and line_overlap("abcdef", "bcdefg") is None
    assert stitch_lines(["配料:水、白砂糖、小麦", "白砂糖、小麦粉、盐", None]) == ("配料:水、白砂糖、小麦粉、盐", 1)
    assert stitch_lines([]) == ("", 0)


def chained(texts, rounds=20):
    """Every free line is tried for every chain, in order."""
    free = [(i, x) for i, t in enumerate(texts) for line in (t or "").split("\n") if len(x := line.strip()) >= 2]
    out, joins = [], 0
    while free:
        photo, chain = free.pop(0)
        for _ in range(rounds):
            fit = next((k for k, (i, line) in enumerate(free) if i != photo and line_overlap(chain, line) is not None), None)
            if fit is None:
                break
            line = free.pop(fit)[1]
            chain, joins = chain + line[line_overlap(chain, line) :], joins + 1
        out.append(chain)
    return "\n".join(out), joins


def test_stitching_by_index_equals_trying_all_lines(spark):
    rng = random.Random(12)
    packs = []
    for _ in range(150):
        long = "".join(rng.choices("水盐糖油米面粉豆奶ab", k=60))
        cuts = [long[a : a + rng.randrange(1, 14)] for a in rng.choices(range(55), k=rng.randrange(2, 16))]
        packs.append(["\n".join(cuts[k::3]) for k in range(3)] + [None, ""])
    assert [stitch_lines(p) for p in packs] == [chained(p) for p in packs] and sum(stitch_lines(p)[1] for p in packs) > 100
    rows = [(k, n, t) for k, p in enumerate(packs) for n, t in enumerate(p)]
    got = {tuple(r) for r in overlap_candidates(spark.createDataFrame(rows, "pack_id long, photo_no int, text string")).collect()}
    lines = [(k, n, i, x) for k, n, t in rows for i, x in enumerate(y for y in ((z.strip() for z in (t or "").split("\n"))) if len(y) >= 2)]
    assert got == {(k, n, i, m, j, end) for k, n, i, x in lines for q, m, j, y in lines if k == q and n != m and (end := line_overlap(x, y)) is not None}


def test_stitching_with_and_without_an_index(monkeypatch):
    """Packs of a few lines are looked through, others by an index; both give the same chains."""
    rng = random.Random(31)
    long = "".join(rng.choices("水盐糖油米面粉豆奶ab", k=400))
    packs_ = [["\n".join(long[a : a + rng.randrange(1, 14)] for a in rng.choices(range(390), k=rng.randrange(1, 15))) for _ in range(4)] for _ in range(60)]
    assert {len("\n".join(p).split("\n")) > st.FEW_LINES for p in packs_} == {True, False}
    got = [stitch_lines(p) for p in packs_]
    for few in (0, 1000):
        monkeypatch.setattr(st, "FEW_LINES", few)
        assert [stitch_lines(p) for p in packs_] == got
    assert got == [chained(p) for p in packs_] and sum(joins for _, joins in got) > 50


def test_stitching_many_lines_is_linear():
    rng = random.Random(13)
    lines = ["".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(30)) for _ in range(20_000)]
    began = time.time()
    assert stitch_lines(["\n".join(lines[:10_000]), "\n".join(lines[10_000:])])[1] < 20
    assert time.time() - began < 20


def test_packs(spark, words):
    photos = spark.createDataFrame(
        [(1, 1, "配料:水、白砂糖、小麦粉、植物", None), (1, 2, "、小麦粉、植物油、猪肉、食用盐", None), (2, 1, "配料:水", 80), (3, 1, "配料:水、酵母", None), (3, 2, "清真 生产者某某 猪油", None)], "pack_id long, photo_no int, text string, ocr_confidence int"
    )
    got = {r["pack_id"]: r for r in packs.pack_verdict(photos, words).collect()}
    assert (got[1]["primary_no"], got[1]["joins"], got[1]["verdict"]["level"]) == (-1, 1, "haram") and got[1]["section"]["text"].endswith("猪肉、食用盐")
    assert got[2]["primary_no"] == 1 and got[2]["verdict"]["level"] == "clean"
    assert got[3]["verdict"]["level"] == "haram" and [(f["term"], f["from_photo"]) for f in got[3]["findings"]] == [("猪油", 2), ("酵母", 0)]
    assert {r["pack_id"]: r["text"] for r in packs.combined_text(photos).collect()}[3] == "配料:水、酵母\n\n[photo 2]\n清真 生产者某某 猪油"


def test_pack_results_in_full(spark, words):
    """Elsewhere of primary and others, a name from another photo, codes, segments and quality."""
    photos = spark.createDataFrame(
        [
            (1, 1, "肉丸 配料:水、白砂糖、乳化剂(471)", 90), (1, 2, "产品名称:香脆饼干\n明胶 配料:水、食用盐", 90), (1, 3, "乱码", 90),
            (2, 1, "产品名称:绿茶\n配料:水", 90), (2, 2, None, None), (3, 1, None, None), (3, 2, "", None),
        ], "pack_id long, photo_no int, text string, ocr_confidence int",
    )
    got = {r["pack_id"]: r for r in packs.pack_verdict(photos, words).collect()}
    assert len(got) == 3 and got[1]["primary_no"] == 1
    assert [(f["term"], f["from_photo"]) for f in got[1]["elsewhere"]] == [("肉丸", 0), ("明胶", 2)]
    assert got[1]["name"]["zh"] == "香脆饼干" and got[2]["name"]["zh"] == "绿茶" and got[3]["name"] is None
    assert [c["code"] for c in got[1]["codes"]] == ["471"] and [x["zh"] for x in got[1]["segments"]] == ["水", "白砂糖", "乳化剂", "471"][: len(got[1]["segments"])]
    assert got[1]["quality"]["ocr_confidence"] == 90 and got[3]["verdict"]["level"] == "unknown"


def test_packs_in_tasks_equal_columns(spark, words):
    """Packs are screened, stitched and merged behind one shuffle, with the results that the columns for large lexicons give."""
    rng, rows = random.Random(12), []
    for pack in range(700):
        texts, line = odd_texts(100 + pack, rng.randrange(1, 6)), "".join(rng.choices(ODD[:60], k=8)).replace("\n", "")
        if rng.random() < 0.5:  # a list that goes on on the next photo
            texts[:2] = ["配料:水、白砂糖、" + line, line[-6:] + "、猪肉、食用盐"]
        rows += [(pack, no + 1, rng.choice([t, t, t, t, None]), rng.choice([None, 20, 90])) for no, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "pack_id long, photo_no int, text string, ocr_confidence int").repartition(5)
    for settings in (Settings(), Settings(max_chars=30, seafood_strict=True)):
        own, columns = packs.pack_verdict(table, words, settings), packs.pack_columns(table, words, settings)
        assert own._jdf.queryExecution().sparkPlan().toString().count("Window ") == 1 and "Join" not in own._jdf.queryExecution().executedPlan().toString()
        assert own.dtypes == columns.dtypes
        got, want = ({r["pack_id"]: r.asDict(True) for r in df.collect()} for df in (own, columns))
        assert len(got) == len({r[0] for r in rows}) and len([1 for r in got.values() if r["primary_no"] == -1]) > 10
        for k, r in want.items():
            assert got[k] == r, ([x for x in rows if x[0] == k], {c: (got[k][c], r[c]) for c in r if got[k][c] != r[c]})
    some = packs.pack_verdict(table, words, columns=["joins", "verdict"])
    assert some.columns == ["pack_id", "joins", "verdict"] and some.count() == len(got)


def test_packs_go_over_batches():
    rows = [(k, n + 1, "x", None, n + 1) for k in range(700) for n in range(k % 4 + 1)] + [(700, n + 1, "x", None, n + 1) for n in range(5000)]
    table = pa.table({c: [r[k] for r in rows] for k, c in enumerate(("pack_id", "photo_no", "text", "conf", "turn"))})
    for size in (1, 7, 1000):
        steps = list(packs.whole_packs(table.to_batches(max_chunksize=size)))
        assert [r for some in steps for pack in some for r in pack] == [r[:4] for r in rows]
        assert [len({r[0] for r in pack}) for some in steps for pack in some] == [1] * 701 and len(steps) > 1


def test_product_findings_are_counted_where_they_stand(spark, words):
    from labelsieve.sources.tables import Lexicon

    dictionary = load_dictionary(spark.createDataFrame([(0, "火腿", "likely", "ham", "", "meat", ""), (1, "水", "ok", "water", "", "", "")], "ord int, term string, status string, en string, py string, category string, note string"))
    products = load_products(spark.createDataFrame([(0, "火腿", "likely", "ham", "pork", "")], "ord int, names string, level string, en string, typical string, note string"))
    own = Lexicon(dictionary, dictionary, words.codes, products, words.products_nonfood)
    rows = [(1, "产品名称: 火腿\n配料: 水", "site"), (2, "火腿", None), (3, "火腿 火腿", None), (4, "产品名称: 火腿\n配料: 水", None)]
    got = {r["label_id"]: r for r in screen_labels(spark.createDataFrame(rows, "label_id long, text string, web_source string"), own).collect()}
    told = lambda k, c: [(f["term"], f["source"], f["count"]) for f in got[k][c]]
    assert told(1, "findings") == [] and told(1, "elsewhere") == [("火腿", "dict", 2)] and got[1]["verdict"]["level"] == "likely"
    assert told(2, "findings") == [("火腿", "dict", 2)] and told(3, "findings") == [("火腿", "dict", 3)]
    assert told(4, "elsewhere") == [("火腿", "dict", 1)] and got[4]["verdict"]["level"] == "clean"


def test_segments_from_the_labels_own_scan(spark, words):
    """Pieces of a part of a text, words cut by its ends included, have the hits of a scan of their own."""
    rng = random.Random(21)
    parts = ["猪肉", "白砂糖", "halal", "HALAL", "x", "、", "，", "(", ")", " ", "12", "%", "鱿鱼肉松", "\n", "·", "单,双甘油脂肪酸酯"]
    rows = []
    for k in range(300):
        text = "".join(rng.choices(parts, k=rng.randrange(0, 25)))
        a, b = sorted((rng.randrange(len(text) + 1), rng.randrange(len(text) + 1)))
        rows.append((k, text, a, b))
    terms = scan.food_terms(words.dictionary)
    table = spark.createDataFrame(rows, "label_id long, norm string, a int, b int")
    seen = scan.with_occurrences(table, ["label_id"], "norm", terms, {"food": (["food"], "all")})
    cut = sg.label_pieces(terms)(F.col("norm"), F.col("a"), F.col("b"), F.transform("food", lambda h: h["start"]), F.transform("food", lambda h: -h["neg_len"]))
    own = seen.withColumn("cut", cut).withColumn("cut", sg.label_segments(F.col("cut"), F.col("food"))).select("label_id", F.explode(sg.judged_segments(F.col("cut"))).alias("s")).select("label_id", "s.*")
    scanned = sg.segment(table.withColumn("scope", F.expr("substring(norm, a + 1, b - a)")), ["label_id"], "scope", terms)
    got, want = (sorted(tuple(r) for r in df.select("label_id", "seg_no", "zh", "en", "status", "coverage").collect()) for df in (own, scanned))
    assert got == want and len(got) > 300


def test_dedupe_is_linear(spark):
    found = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(9_999)), lambda k: F.struct(F.concat(F.lit("t"), (k % 3000).cast("string")).alias("term"), *[F.lit("").alias(c) for c in ("en", "py")], F.when(k % 2 == 0, "haram").otherwise("ok").alias("status"), *[F.lit("").alias(c) for c in ("category", "note")], k.alias("index"), F.lit("dict").alias("source"))).alias("f"))
    began = time.time()
    out = fi.dedupe_findings(found, "f", "f").first()["f"]
    assert time.time() - began < 30
    first = {}
    for k in range(10_000):
        first.setdefault((k % 3000, k % 2), []).append(k)
    assert [(x["index"], x["count"]) for x in out] == [(v[0], len(v)) for v in first.values()]


def test_long_texts_are_read_in_parts(monkeypatch):
    rows = pa.table({"kind": ["food"] * 4, "ord": pa.array([0, 1, 2, 3], pa.int32()), "term": ["猪肉", "halal", "猪肉松", "肉"], "exact": [False] * 4} | {c: [""] * 4 for c in ("status", "en", "py", "category", "note")})
    rng = random.Random(3)
    text = "".join(rng.choices(["猪肉", "松", "halal", " ", "x", "HALAL ", "肉"], k=400))
    whole = matcher.Matcher(rows).seek([text, None, "猪肉"]).column().to_pylist()
    monkeypatch.setattr(matcher, "STEP", 17)
    assert matcher.Matcher(rows).seek([text, None, "猪肉"]).column().to_pylist() == whole
    assert len(whole[0]) > 200 and whole[1] == [] and [h["term"] for h in whole[2]] == ["猪肉", "肉"]


def test_web_lists(spark, words):
    bare = screen_labels(spark.createDataFrame([(1, "绿茶"), (2, "火腿肠")], "label_id long, text string"), words)
    catalogue = spark.createDataFrame([("绿茶", "site", "水、茶叶"), ("火腿肠", "site", "水、淀粉")], "product_name string, site string, list_text string")
    again = {r["label_id"]: r["verdict"]["level"] for r in screen_labels(packs.web_list_join(bare, catalogue), words).collect()}
    assert again == {1: "caution", 2: "likely"}


def bubble(boxes):
    s = sorted(boxes)
    for i in range(len(s) - 1):
        for j in range(i, -1, -1):
            if abs(s[j + 1][0] - s[j][0]) < 10 and s[j + 1][1] < s[j][1]:
                s[j], s[j + 1] = s[j + 1], s[j]
            else:
                break
    return [b[2] for b in s]


def test_box_order(spark):
    rng = random.Random(6)
    rows = [(p, k, float(rng.randrange(100)), float(rng.randrange(60))) for p in range(20) for k in range(12)]
    got = {}
    for r in ln.box_order(spark.createDataFrame(rows, "photo_id long, box_id int, x double, y double")).orderBy("photo_id", "place").collect():
        got.setdefault(r["photo_id"], []).append(r["box_id"])
    assert got == {p: bubble([(y, x, k) for q, k, x, y in rows if q == p]) for p in range(20)}


def by_hand(frames):
    last, best, taken, held = -1200, 0.0, [], []
    for _, no, ms, sharp, text in sorted(frames, key=lambda f: (f[2], f[1])):
        if ms - last < 1200:
            continue
        best = max(best, sharp)
        if sharp < max(25, 0.45 * best):
            continue
        last = ms
        taken.append(no)
        t = text.strip()
        if len(t) >= 6 and re.sub(r"\s", "", t) not in [re.sub(r"\s", "", x) for x in held]:
            held = [*held, t][-24:]
    return taken, held


FRAMES = "session_id long, frame_no long, frame_ms long, sharpness double, text string, signal string"


def some_frames():
    rng = random.Random(8)
    out = [(s, k, k * rng.choice([300, 700, 900]), float(rng.randrange(10, 90)), f" 配料:水 第{rng.randrange(40)}号 ", None) for s in range(3) for k in range(120)]
    return out + [(7, 0, 0, 50.0, "配料:水、食用盐", None), (7, 1, 2000, 50.0, "水、食用盐、猪肉", "cancel"), (7, 2, 4000, 60.0, "净含量:100克 地址", "finish"), (7, 3, 4000 + live.IDLE_MS, 60.0, "配料:小麦粉、水", None), (7, 4, 4000 + 2 * live.IDLE_MS, None, None, None), (7, 5, None, 60.0, "no time", None)]


def reads_of(rows):
    return sorted((r["session_id"], r["started_ms"], r["seq"], r["version"], r["frame_no"], r["text"], r["kept"], r["ended"], tuple(r["buffer"])) for r in rows)


def test_live_batch(spark):
    frames = some_frames()
    reads = live.live_intake(spark.createDataFrame(frames, FRAMES)).collect()
    for s in range(3):
        taken, held = by_hand([f[:5] for f in frames if f[0] == s])
        assert [r["frame_no"] for r in sorted((r for r in reads if r["session_id"] == s and not r["ended"]), key=lambda r: r["seq"])] == taken
        assert [r["buffer"] for r in reads if r["session_id"] == s and r["ended"]] == [held]
    # A cancelled session tells no end; a finished one does, and so does one that was idle.
    assert [(r["started_ms"], r["buffer"]) for r in reads if r["session_id"] == 7 and r["ended"]] == [(4000, ["净含量:100克 地址"]), (4000 + live.IDLE_MS, ["配料:小麦粉、水"]), (4000 + 2 * live.IDLE_MS, [])]
    assert live.live_intake(spark.createDataFrame([], FRAMES)).count() == 0


def test_live_intake_is_linear(spark):
    frames = spark.range(100_000).selectExpr("1 as session_id", "id as frame_no", "id * 1200 as frame_ms", "cast(50 as double) as sharpness", "concat('配料:水 第', id, '号') as text")
    began = time.time()
    assert live.live_intake(frames).agg(F.count("*"), F.max("version"), F.max(F.size("buffer"))).first()[:] == (100_001, 100_000, live.KEPT)
    assert time.time() - began < 60


def run_stream(spark, folder, state, frames, names):
    """Files of frames one after another, each a batch; ends when all are read and timers are done."""
    stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = live.live_reads(stream).writeStream.format("memory").queryName(names).outputMode("append").option("checkpointLocation", str(state)).trigger(availableNow=True).start()
    query.awaitTermination(240)
    return query


def test_live_stream_equals_its_batch_twin(spark, tmp_path):
    """Frames come in several batches, out of order and across sessions; frames behind the watermark are dropped and counted."""
    # A stream's watermark begins at the time 0.
    frames = [(*f[:2], f[2] + 1, *f[3:]) for f in some_frames() if f[2] is not None and f[2] < 200_000]
    end = (99, 0, 200_000 + 3 * live.IDLE_MS, 0.0, None, None)
    rng = random.Random(4)
    early = [f for f in frames if f[2] < 60_000 or rng.random() < 0.3]
    rest = [f for f in frames if f not in early]
    first = max(f[2] for f in early)
    # What the second batch brings is folded in order with what waits; in the third the first batch's watermark has passed.
    late = [f for f in rest if f[2] <= first - 10_000][::2]
    for part in (early, [f for f in rest if f not in late], late, [end]):
        spark.createDataFrame(rng.sample(part, len(part)), FRAMES).coalesce(1).write.mode("append").parquet(str(tmp_path / "frames"))
        time.sleep(1.1)
    query = run_stream(spark, tmp_path / "frames", tmp_path / "state", FRAMES, "reads_twin")
    assert query.exception() is None
    kept = [f for f in frames if f not in late]
    twin = live.live_intake(spark.createDataFrame(kept, FRAMES)).collect()
    got = spark.table("reads_twin").filter("session_id < 99").collect()
    assert reads_of(got) == reads_of(twin) and len(got) > 30
    assert late and live.dropped_frames(query) + sum(r["late"] for r in got if r["ended"]) == len(late)


def test_live_verdict_after_each_read_and_once(spark, tmp_path, monkeypatch):
    """As many verdicts as reads with a buffer, each over the buffer of its read; a batch that runs again adds none."""
    monkeypatch.setattr(live, "pack_verdict", lambda photos, lexicon, settings: photos.groupBy("pack_id").agg(F.array_sort(F.collect_list(F.struct("photo_no", "text"))).alias("seen")))
    frames = [(s, k, 2000 * k + 1, 50.0, "配料:水、第%d号" % (k - k % 2), None) for s in (1, 2) for k in range(6)]
    for part in (frames[:8], frames[8:], [(99, 0, 10**7, 0.0, None, None)]):
        spark.createDataFrame(part, FRAMES).coalesce(1).write.mode("append").parquet(str(tmp_path / "frames"))
        time.sleep(1.1)

    def run():
        stream = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "frames"))
        query = live.live_verdict(live.live_reads(stream, "20 seconds"), None, live.verdict_files(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None

    def told():
        return sorted((r["session_id"], r["seq"], r["version"], r["ended"], r["combined"], len(r["seen"])) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    run()
    first = told()
    assert [x[:4] for x in first if x[0] == 1] == [(1, 1, 1, False), (1, 2, 1, False), (1, 3, 2, False), (1, 4, 2, False), (1, 5, 3, False), (1, 6, 3, False), (1, 6, 3, True)]
    assert [x[5] for x in first if x[0] == 2] == [1, 1, 2, 2, 3, 3, 3]
    assert first[2][4] == "配料:水、第0号\n\n[frame 2]\n配料:水、第2号"
    # As after a crash between the sink and the commit of the last batch with verdicts.
    last = max(int(p.name) for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit())
    for p in (tmp_path / "state" / "commits").iterdir():
        if p.name.strip(".").split(".")[0] == str(last):
            p.unlink()
    run()
    assert told() == first


def test_code_lists_of_any_length(spark):
    plain = re.compile(r"^\s*(?:(?:INS|E)?\s*\d{3,4}[a-z]?\s*[,，、;；/和及]?\s*)+$", re.I)
    inner = ["471、1234567890123", "471、322", "12345", "471INS322", "471E322", "E471a/INS 407", "471b322", " 322 ，471 ", "47", "471I", "123456", "1234567", "471EINS407", "471,,322", "471x y"]
    shown = spark.createDataFrame([(x,) for x in inner], "x string").select("x", F.col("x").rlike(codes._LIST).alias("hit")).collect()
    assert {r["x"]: r["hit"] for r in shown} == {x: bool(plain.match(x)) for x in inner}
    table = spark.createDataFrame([(1, "乳化剂(471、1234567890123)")], "label_id long, norm string")
    assert "471" in {r["code"] for r in codes.parse_codes(table, ["label_id"], "norm", lexicon(spark).codes).collect()}


def test_large_lexicons_scan_alike(spark, words, monkeypatch):
    texts_ = ["配料:猪肉、halal、HALAL x", "the Halalx halal", "", None, "水鱿鱼肉松 L-肉碱", "é halal É猪"]
    table = spark.createDataFrame(list(enumerate(texts_)), "label_id long, text string")
    got = []
    for bound in (scan.BROADCAST_ROWS, 3):
        monkeypatch.setattr(scan, "BROADCAST_ROWS", bound)
        got.append(sorted(tuple(r) for r in scan.occurrences(table, ["label_id"], "text", words.terms()).collect()))
    assert got[0] == got[1] and len(got[0]) > 10
