"""W2: several photos of one pack. W4: recognised lines to texts. J5: lists from elsewhere."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from labelsieve.functions.text import cjk_count
from labelsieve.operators import judge
from labelsieve.operators.lines import choose_read, kept_lines, photo_texts
from labelsieve.operators.stitch import stitch_lines, stitch_texts
from labelsieve.operators.verdict import food_verdict, nonfood_verdict
from labelsieve.plans.screen import screen_labels, screener
from labelsieve.sources.tables import Lexicon, Settings, stored


def photo_score(section: Column, quality: Column, findings: Column) -> Column:
    """2 for a list, its coverage, 1 for a grave finding."""
    grave = F.exists(findings, lambda f: f["severity"] >= 5)
    return 2.0 * section["found"].cast("int") + quality["coverage"] + grave.cast("int")


def best_photo(scored: DataFrame) -> DataFrame:
    """The photo of each pack with the highest score, the first on ties."""
    first = Window.partitionBy("pack_id").orderBy(F.col("score").desc(), "photo_no")
    return scored.withColumn("rank", F.row_number().over(first)).filter("rank = 1").drop("rank")


def usable_photos(screened: DataFrame) -> DataFrame:
    return screened.filter(~F.col("quality.unreadable"))


def photo_summary(screened: DataFrame, primary: DataFrame) -> DataFrame:
    """pack_id, photo_no, what was read, and whether the verdict rests on it."""
    n = cjk_count("normalized")
    what = F.when(F.col("section.found"), "list found").when(n >= 60, "no list on this side").when(n > 0, "not readable").otherwise("nothing read")
    used = primary.select("pack_id", F.col("photo_no").alias("used_no"))
    joined = screened.join(used, "pack_id", "left")
    return joined.select("pack_id", "photo_no", what.alias("what"), F.coalesce((F.col("photo_no") == F.col("used_no")) & F.col("section.found"), F.lit(False)).alias("used"))


def combined_text(photos: DataFrame, tag: str = "photo") -> DataFrame:
    """pack_id, text: the first text, then each other one under its number."""
    order = F.array_sort(F.collect_list(F.struct("photo_no", F.coalesce("text", F.lit("")).alias("text"))))
    part = F.transform(order, lambda x, i: F.when(i == 0, x["text"]).otherwise(F.concat(F.lit(f"\n\n[{tag} "), (i + 1).cast("string"), F.lit("]\n"), x["text"])))
    return photos.groupBy("pack_id").agg(F.array_join(part, "").alias("text"))


def distinct_positives(screened: DataFrame) -> DataFrame:
    """First positive of each term over a pack's usable photos, in photo order."""
    rows = screened.select("pack_id", "photo_no", F.posexplode("positives").alias("no", "p")).select("pack_id", "photo_no", "no", "p.*")
    first = Window.partitionBy("pack_id", "term").orderBy("photo_no", "no")
    return rows.withColumn("k", F.row_number().over(first)).filter("k = 1").drop("k")


def best_photo_merge(primary: DataFrame, others: DataFrame) -> DataFrame:
    """pack_id, findings: the primary's, then what the others add: findings in a list, and forbidden terms of 2 characters or more.

    primary: pack_id, findings; others: pack_id, photo_no, findings of the other usable photos.
    """
    add = (F.col("f.in_section")) | ((F.col("f.source") == "dict") & (F.col("f.status") == "haram") & (F.length("f.term") >= 2))
    own = primary.select("pack_id", F.lit(0).alias("from_photo"), F.posexplode("findings").alias("no", "f"))
    more = others.select("pack_id", F.col("photo_no").alias("from_photo"), F.posexplode("findings").alias("no", "f")).filter(add)
    rows = own.unionByName(more)
    first = Window.partitionBy("pack_id", F.col("f.term"), F.col("f.status")).orderBy("from_photo", "no")
    kept = rows.withColumn("k", F.row_number().over(first)).filter("k = 1")
    order = F.struct((-F.col("f.severity")).alias("s"), F.col("f.index").alias("i"), "from_photo", "no", F.col("f").alias("f"))
    return kept.groupBy("pack_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["f"].withField("from_photo", x["from_photo"])).alias("findings"))


def merge_elsewhere(primary: DataFrame, others: DataFrame) -> DataFrame:
    """pack_id, elsewhere: what stands outside the list on the primary, then on the other usable photos in their order, each with its photo (0: the primary).

    primary: pack_id, elsewhere; others: pack_id, photo_no, elsewhere.
    """
    own = primary.select("pack_id", F.lit(0).alias("from_photo"), "elsewhere")
    parts = own.unionByName(others.select("pack_id", F.col("photo_no").alias("from_photo"), "elsewhere"))
    marked = parts.select("pack_id", F.struct("from_photo", F.transform("elsewhere", lambda f: f.withField("from_photo", F.col("from_photo"))).alias("e")).alias("x"))
    return marked.groupBy("pack_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["e"])).alias("elsewhere"))


def first_name(screened: DataFrame) -> DataFrame:
    """pack_id, any_name: the first photo's name that was read."""
    named = screened.filter("name is not null")
    return named.groupBy("pack_id").agg(F.min_by("name", "photo_no").alias("any_name"))


#: What a pack takes from its primary photo, or from the stitched text.
_PRIMARY = ["kind", "section", "quality", "findings", "elsewhere", "product", "name", "codes", "segments"]


def _array(df: DataFrame, *names: str) -> DataFrame:
    """df with empty arrays for nulls."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: F.coalesce(F.col(c), F.array().cast(types[c])) for c in names})


def screened_photos(photos: DataFrame, lexicon: Lexicon, settings: Settings | None) -> DataFrame:
    """Each photo's screen with pack_id, photo_no and score; the two keys go through the screen as one identifier."""
    keyed = photos.select(F.struct("pack_id", "photo_no").alias("label_id"), "text", "ocr_confidence")
    screened = screen_labels(keyed, lexicon, settings).select("label_id.pack_id", "label_id.photo_no", "*").drop("label_id")
    return screened.withColumn("score", photo_score(F.col("section"), F.col("quality"), F.col("findings")))


def stitched_packs(photos: DataFrame, lexicon: Lexicon, settings: Settings | None) -> DataFrame:
    """The screen of each pack's stitched text, where lines were joined: s_pack, joins, s_score, s."""
    # The chains are read several times, so they are written once.
    joined = stored(stitch_texts(photos.filter("text is not null")).filter("joins > 0"), "stitched")
    screened = screen_labels(joined.select(F.struct("pack_id", "joins").alias("label_id"), "text"), lexicon, settings)
    score = photo_score(F.col("section"), F.col("quality"), F.col("findings"))
    return screened.select(F.col("label_id.pack_id").alias("s_pack"), F.col("label_id.joins").alias("joins"), score.alias("s_score"), F.struct(*_PRIMARY).alias("s"))


#: Columns of a pack and their types besides those of a screen; {no} and {photo_no}: a photo's number, widened to an int and as it is.
PACK_TYPES = {
    "photos": "bigint", "primary_no": "{no}", "joins": "int", **{c: judge.TYPES[c] for c in ("kind", "name", "section", "quality", "verdict")},
    **{c: f"array<struct<{judge.FINDING}, from_photo: {{no}}>>" for c in ("findings", "elsewhere")},
    "positives": "array<struct<photo_no: {photo_no}, no: int, term: string, en: string, note: string, index: int, kind: string>>",
    "codes": judge.TYPES["codes"], "segments": judge.TYPES["segments"], "alcoholic": "boolean",
}


def merged_pack(photos: list[tuple[int, judge.Screened]], stitched: judge.Screened | None, joins: int) -> dict:
    """One pack's row of pack_verdict() from its screened photos, in order, and its stitched text if lines were joined."""
    best_no, best = max(photos, key=lambda x: x[1].score())  # the first on ties
    p, wins = best, False
    if stitched is not None and len(photos) > 1:
        longer = stitched.section[0] and best.section[0] and len(stitched.section[1]) > len(best.section[1])
        wins = stitched.score() > best.score() or longer
        p = stitched if wins else best
    usable = [(no, s) for no, s in photos if not s.quality[3]]
    # The best single photo adds nothing of its own even where the stitched text has won.
    others = [(no, s) for no, s in usable if no is not None and best_no is not None and no != best_no]
    adds = lambda f: f[judge.IN_SECTION] or (f[judge.SOURCE] == "dict" and f[judge.STATUS] == "haram" and len(f[judge.TERM]) >= 2)
    rows = [(0, k, f) for k, f in enumerate(p.findings)] + [(no, k, f) for no, s in others for k, f in enumerate(s.findings) if adds(f)]
    first: dict[tuple, tuple] = {}
    for row in sorted(rows, key=lambda x: x[:2]):
        first.setdefault((row[2][judge.TERM], row[2][judge.STATUS]), row)
    findings = sorted(first.values(), key=lambda x: (-x[2][judge.SEVERITY], x[2][judge.INDEX], x[0], x[1]))
    aside = sorted([(0, p.elsewhere), *((no, s.elsewhere) for no, s in others)], key=lambda x: x[0])
    marks: dict[str, tuple] = {}
    counted = [(no, s) for no, s in photos if not s.quality[3] or s is best]
    for mark in ((no, k, *x) for no, s in counted for k, x in enumerate(s.positives)):
        marks.setdefault(mark[2], mark)
    found, alcoholic = [f for _, _, f in findings], any(s.alcoholic for _, s in photos)
    noise = p.quality[3] and not any(s.section[0] for _, s in usable)
    if len(photos) == 1:
        verdict = best.verdict
    elif p.kind == "nonfood":
        verdict = judge.nonfood_verdict(found, p.section[0], noise, p.product)
    else:
        verdict = judge.food_verdict(found, any(m[6] == "halal" for m in marks.values()), p.section[0], alcoholic, noise, p.quality[0], any(s.had_chinese for _, s in photos), None)
    return {
        "photos": len(photos), "primary_no": -1 if wins else best_no, "joins": joins if wins else 0, "kind": p.kind, "name": p.name or next((s.name for _, s in photos if s.name), None),
        "section": p.section, "quality": p.quality, "verdict": verdict, "findings": [(f, no) for no, _, f in findings], "elsewhere": [(f, no) for no, e in aside for f in e],
        "positives": list(marks.values()), "codes": p.codes, "segments": p.segments, "alcoholic": alcoholic,
    }


def merged_packs(one: judge.Screener, packs: Sequence[list[tuple]], settings: Settings) -> list[dict]:
    """merged_pack() of packs, whose rows are (pack_id, photo_no, text, ocr_confidence) in order."""
    cut, kinds = slice(settings.max_chars), lambda n: [settings.product_kind] * n
    rows = [r for pack in packs for r in pack]
    screened = iter(one.screen([(r[2] or "")[cut] for r in rows], [r[3] for r in rows], kinds(len(rows))))
    chains = [stitch_lines(texts) if len(texts) > 1 else ("", 0) for texts in ([r[2] for r in pack if r[2] is not None] for pack in packs)]
    joined = [text[cut] for text, joins in chains if joins]
    stitched = iter(one.screen(joined, None, kinds(len(joined))))
    return [merged_pack([(r[1], next(screened)) for r in pack], next(stitched) if joins else None, joins) for pack, (_, joins) in zip(packs, chains, strict=True)]


def whole_packs(batches: Iterable[pa.RecordBatch]) -> Iterator[list[list[tuple]]]:
    """Packs, some at a time, from batches of rows that end with their number in the pack; a pack may go over several batches."""
    some, size = [], 0
    for batch in batches:
        for *row, turn in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if turn == 1:
                if size >= judge.STEP:
                    yield some
                    some, size = [], 0
                some.append([])
            some[-1].append(tuple(row))
            size += 1
    if some:
        yield some


def pack_verdict(photos: DataFrame, lexicon: Lexicon, settings: Settings | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per pack: pack_id, photos, primary_no, joins, kind, name, section, quality, verdict, findings, elsewhere, positives, codes, segments, alcoholic.

    photos: pack_id, photo_no, text, ocr_confidence. A pack of one photo keeps that photo's result. The best photo decides,
    or the stitched text if it scores higher or has the longer list; primary_no is then -1. The name is the primary's or
    else the first that any photo has. columns: those to be given besides pack_id, if not all.

    A pack's photos are put side by side by one shuffle and a sort, and screened, stitched and merged where they are read.
    """
    settings, wanted, of = settings or Settings(), list(columns or PACK_TYPES), dict(photos.dtypes)
    make = screener(lexicon, settings, [c for c in judge.TYPES if c != "name" or c in wanted])
    if make is None or of["photo_no"] not in ("tinyint", "smallint", "int", "bigint"):
        return pack_columns(photos, lexicon, settings).select("pack_id", *wanted)
    kinds = {"no": "bigint" if of["photo_no"] == "bigint" else "int", "photo_no": of["photo_no"], "confidence": of["ocr_confidence"]}
    schema = StructType([StructField("pack_id", photos.schema["pack_id"].dataType), *StructType.fromDDL(", ".join(f"{c} {PACK_TYPES[c].format(**kinds)}" for c in wanted)).fields])
    types = {f.name: f.type for f in to_arrow_schema(schema)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for some in whole_packs(batches):
            with judge.uncollected():
                rows = merged_packs(one, some, settings)
                values = {c: [[(*judge.shown(f), no) for f, no in r[c]] for r in rows] if c in ("findings", "elsewhere") else [r[c] for r in rows] for c in wanted}
                out = [pa.array([pack[0][0] for pack in some], types["pack_id"]), *[judge.arrow(values[c], types[c]) for c in wanted]]
                del rows, values
            yield pa.RecordBatch.from_arrays(out, names=list(types))

    turn = F.row_number().over(Window.partitionBy("pack_id").orderBy("photo_no"))
    # The window leaves a pack's rows side by side and in order.
    rows = photos.filter("pack_id is not null").select("pack_id", "photo_no", "text", "ocr_confidence", turn.alias("turn"))
    return rows.mapInArrow(run, schema)


def pack_columns(photos: DataFrame, lexicon: Lexicon, settings: Settings | None = None) -> DataFrame:
    """pack_verdict() by columns, for word tables of any size."""
    photos = stored(photos.select("pack_id", "photo_no", "text", "ocr_confidence"), "pack-photos")
    screened = stored(screened_photos(photos, lexicon, settings), "photos")
    best = best_photo(screened)
    facts = screened.groupBy("pack_id").agg(
        F.count(F.lit(1)).alias("photos"), F.bool_or("alcoholic").alias("any_alcoholic"), F.bool_or("had_chinese").alias("any_chinese"), F.bool_or(F.col("section.found") & ~F.col("quality.unreadable")).alias("any_list")
    )
    stitched = stitched_packs(photos, lexicon, settings)
    row = best.join(facts, "pack_id").join(stitched, F.col("pack_id") == F.col("s_pack"), "left").join(first_name(screened), "pack_id", "left")
    longer = F.col("s.section.found") & F.col("section.found") & (F.length("s.section.text") > F.length("section.text"))
    wins = F.coalesce((F.col("photos") > 1) & ((F.col("s_score") > F.col("score")) | longer), F.lit(False))
    row = row.withColumn("p", F.when(wins, F.col("s")).otherwise(F.struct(*_PRIMARY))).withColumn("wins", wins)
    # Several results build on these rows.
    row = stored(row.select("pack_id", "photos", "photo_no", "joins", "wins", "p", "any_name", "any_alcoholic", "any_chinese", "any_list", F.col("verdict").alias("own_verdict")), "packs")
    # The best single photo adds nothing of its own even where the stitched text has won.
    others = usable_photos(screened).join(best.select("pack_id", F.col("photo_no").alias("best_no")), "pack_id").filter("photo_no <> best_no")
    merged = best_photo_merge(row.select("pack_id", F.col("p.findings").alias("findings")), others.select("pack_id", "photo_no", "findings"))
    aside = merge_elsewhere(row.select("pack_id", F.col("p.elsewhere").alias("elsewhere")), others.select("pack_id", "photo_no", "elsewhere"))
    counted = usable_photos(screened).unionByName(best.filter(F.col("quality.unreadable")))
    marks = distinct_positives(counted).groupBy("pack_id").agg(F.array_sort(F.collect_list(F.struct("photo_no", "no", "term", "en", "note", "index", "kind"))).alias("positives"))
    out = _array(row.join(merged, "pack_id", "left").join(aside, "pack_id", "left").join(marks, "pack_id", "left"), "findings", "elsewhere", "positives")
    noise = F.when(F.col("any_list"), F.lit(False)).otherwise(F.col("p.quality.unreadable"))
    nothing = F.lit(None).cast(out.select("p.product").schema[0].dataType)
    food = food_verdict(F.col("findings"), F.col("positives"), F.col("p.section"), F.col("any_alcoholic"), noise, F.col("p.quality.coverage"), F.col("any_chinese"), nothing)
    nonfood = nonfood_verdict(F.col("findings"), F.col("p.section"), noise, F.col("p.product"))
    verdict = F.when(F.col("photos") == 1, F.col("own_verdict")).when(F.col("p.kind") == "nonfood", nonfood).otherwise(food)
    return out.select(
        "pack_id", "photos", F.when(F.col("wins"), -1).otherwise(F.col("photo_no")).alias("primary_no"), F.when(F.col("wins"), F.col("joins")).otherwise(0).alias("joins"),
        F.col("p.kind").alias("kind"), F.coalesce("p.name", "any_name").alias("name"), F.col("p.section").alias("section"), F.col("p.quality").alias("quality"), verdict.alias("verdict"),
        "findings", "elsewhere", "positives", F.col("p.codes").alias("codes"), F.col("p.segments").alias("segments"), F.col("any_alcoholic").alias("alcoholic"),
    )


def texts_from_lines(lines: DataFrame) -> DataFrame:
    """W4: lines of one or two reads of each photo to its text and confidence."""
    return photo_texts(choose_read(kept_lines(lines)))


def web_list_join(screened: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Labels without a list whose name is in a catalogue: label_id, text to screen again, web_source.

    catalogue: product_name, site, list_text, one row per name.
    """
    bare = screened.filter(~F.col("section.found")).select("label_id", F.coalesce(F.col("name.zh"), F.col("product.name")).alias("product_name"))
    text = F.concat(F.lit("产品名称: "), F.col("product_name"), F.lit("\n配料: "), F.col("list_text"))
    return bare.join(catalogue, "product_name").select("label_id", text.alias("text"), F.col("site").alias("web_source"))


def corpus_report(screened: DataFrame) -> DataFrame:
    """Labels by kind and verdict level, with totals."""
    return screened.rollup("kind", F.col("verdict.level").alias("level")).agg(F.count(F.lit(1)).alias("labels"))


def unknown_chunks(screened: DataFrame) -> DataFrame:
    """Segments that no dictionary term covers, by frequency: gaps of the dictionary."""
    rows = screened.select(F.explode("segments").alias("s")).filter(F.col("s.coverage") == 0)
    return rows.groupBy(F.col("s.zh").alias("zh")).agg(F.count(F.lit(1)).alias("n"))


def top_flagged(screened: DataFrame) -> DataFrame:
    rows = screened.select("label_id", F.explode("findings").alias("f"))
    return rows.groupBy(F.col("f.term").alias("term"), F.col("f.status").alias("status")).agg(F.countDistinct("label_id").alias("labels"), F.sum("f.count").alias("hits"))


def status_rollup(hits: DataFrame) -> DataFrame:
    """Dictionary matches and labels with any by category and status, with totals."""
    return hits.rollup("category", "status").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("label_id").alias("labels"))
