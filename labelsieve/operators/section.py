"""Kind of label, ingredient section and product name, from a label's text and its occurrences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelsieve.functions.text import CJK, HAN, SPACE, cjk_count, trim
from labelsieve.sources import fixed


def accepts_start(term: Column, before: Column, after: Column) -> Column:
    """Whether an occurrence of a start marker is a list header, by what stands around it."""
    nutrition = before.rlike("(营养|營養)$")
    opens_line = before.rlike("(^|[\n ])$") & after.rlike(f"^{CJK}") & ~F.substring(after, 1, 2).rlike("^(来源|产地|说明|标准|信息|含量|比例|中的|均|为)")
    header = after.rlike("^[:：表】\\]）)]") | term.rlike("表$") | term.rlike("^[A-Za-z]") | opens_line
    return ~nutrition & header


def find_section(text: Column, starts: Column, ends: Column) -> Column:
    """Struct (found, text, start, end) of the list behind the first accepted marker, the longest one on ties.

    starts: array of (start, neg_len); ends: array of end-marker positions. A body without Chinese is no list, and a
    body of less than 4 Chinese characters is for the caller to confirm. Not found means the whole text.
    """
    best = F.array_min(starts)
    behind = best["start"] - best["neg_len"]
    skip = F.length(F.regexp_extract(F.substring(text, behind + 1, F.length(text)), f"^(?:[:：】\\]）)]|{SPACE})*", 0))
    start = behind + skip
    end = F.coalesce(F.array_min(F.filter(ends, lambda e: e >= start)), F.length(text))
    body = F.substring(text, start + 1, end - start)
    listed = F.struct(F.lit(True).alias("found"), body.alias("text"), start.cast("int").alias("start"), end.cast("int").alias("end"))
    whole = F.struct(F.lit(False).alias("found"), text.alias("text"), F.lit(0).alias("start"), F.length(text).cast("int").alias("end"))
    return F.when(best.isNotNull() & (cjk_count(body) >= 1), listed).otherwise(whole)


def in_section(section: Column, index: Column) -> Column:
    return section["found"] & (index >= section["start"]) & (index < section["end"])


def detect_kind(text: Column, raw: Column, strong: Column, weak: Column, words: Sequence[str], override: Column) -> Column:
    """food or nonfood: an override wins, then strong words, a telling name or pack size, then two weak words.

    strong, weak: number of detect rows found in the text; words: all of them, for the name.
    """
    plain = F.replace(raw, F.lit("\r"), F.lit(""))
    first = trim(F.substring_index(plain, "\n", 1))
    name = F.regexp_extract(plain, f"(?:产品名称|品名|名称)[:：]?{SPACE}*([^\n]{{2,30}})", 1)
    name = F.when(name != "", name).when(F.length(first) <= 16, first).otherwise("")
    told = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(name, w)) if words else F.lit(False)
    score = strong + told.cast("int") + plain.rlike(fixed.PACK_SIZE).cast("int")
    mark = text.rlike(fixed.FOOD_MARK)
    own = F.when(mark & (score == 0), "food").when(score > 0, "nonfood").when((weak >= 2) & ~mark, "nonfood").otherwise("food")
    return F.when(override.isin("food", "nonfood"), override).otherwise(own)


def detect_name(raw: Column, found: Column, product: Column) -> Column:
    """Struct (zh, en) of the product name, or null: a name field, else a line with the product type, else a name-like first line."""
    plain = F.replace(F.coalesce(raw, F.lit("")), F.lit("\r"), F.lit(""))
    field = F.regexp_extract(plain, f"(?:产品名称|食品名称|商品名称|品名){SPACE}*[:：]?{SPACE}*([^\n:：]{{2,40}})", 1)
    field = trim(F.split(field, f"{SPACE}{{2,}}|净含量|规格|配料|主要成分|产地|价格|保质期|生产|储存|贮存")[0])
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda x: trim(x)), lambda x: x != "")
    typed = F.filter(lines, lambda x: F.contains(x, product) & (cjk_count(x) >= 2) & (F.length(x) <= 24) & ~x.rlike("[:：]") & ~x.rlike(fixed.FIELD_START))
    first = F.try_element_at(lines, F.lit(1))
    dense = cjk_count(first) / F.length(F.regexp_replace(first, SPACE, "")) >= 0.6
    looks = (cjk_count(first) >= 2) & (F.length(first) <= 24) & dense & ~first.rlike("[:：\\d]") & ~first.rlike(fixed.FIELD_START)
    ground = found | plain.rlike(fixed.STRUCTURED) | (F.size(lines) == 1)
    zh = F.coalesce(F.when(field != "", field), F.when(F.coalesce(product, F.lit("")) != "", F.try_element_at(typed, F.lit(1))), F.when(looks & ground, first))
    at = F.array_position(lines, zh)
    following = F.when(at > 0, F.try_element_at(lines, (at + 1).cast("int")))
    latin = F.when(following.rlike("^[A-Za-z][A-Za-z0-9 &'’.,\\-]{2,40}$"), following).otherwise("")
    return F.when(zh.isNotNull(), F.struct(zh.alias("zh"), F.coalesce(latin, F.lit("")).alias("en")))


def known_share(text: Column, hits: Column) -> Column:
    """Share of a short text's Chinese characters that its hits cover."""
    known = F.aggregate(hits, F.lit(0), lambda a, h: a + F.regexp_count(h["term"], F.lit(HAN)))
    return known.cast("double") / cjk_count(text)
