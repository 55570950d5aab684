"""Segments of a list: pieces between separators, their gloss, status and coverage."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsieve.functions.text import HAN, SPACE, cjk_count, severity, trim
from labelsieve.operators.scan import Terms, candidate, food_terms, leftmost_longest, occurrences
from labelsieve.sources import fixed

#: Segments of a label at most; a feature of the view.
SEGMENT_LIMIT = 150
_CUT = "[" + "".join("\\" + c if c in "[]-\\^|()./" else c for c in fixed.SEPARATORS) + "]"


def pieces(text: Column, limit: int = SEGMENT_LIMIT) -> Column:
    """The first pieces of a text that say more than numbers."""
    cut = F.transform(F.split(text, _CUT), lambda x: trim(x))
    return F.slice(F.filter(cut, lambda x: (x != "") & ~x.rlike(f"^(?:[\\d.%,\\-+:/]|{SPACE})+$")), 1, limit)


def segment_status(hits: Column) -> Column:
    """Status of the gravest hit; without grave ones the first that isn't ok."""
    grave = F.array_max(F.transform(hits, lambda h: severity(h["status"])))
    at_top = F.filter(hits, lambda h: severity(h["status"]) == grave)
    mild = F.filter(hits, lambda h: h["status"] != "ok")
    return F.when(grave > 0, F.try_element_at(at_top, F.lit(1))["status"]).otherwise(F.coalesce(F.try_element_at(mild, F.lit(1))["status"], F.lit("ok")))


def gloss(text: Column, hits: Column) -> Column:
    """The piece with its hits in English and its gaps as they are."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, h["start"] - acc["at"])
        parts = F.concat(acc["out"], F.when(h["start"] > acc["at"], F.array(gap)).otherwise(F.array().cast("array<string>")), F.array(F.when(h["en"] != "", h["en"]).otherwise(h["term"])))
        return F.struct((h["start"] - h["neg_len"]).alias("at"), parts.alias("out"))

    joined = F.aggregate(hits, start, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.length(text)))), " "))
    return trim(F.regexp_replace(joined, f"{SPACE}+", " "))


def piece_coverage(text: Column, hits: Column) -> Column:
    """Share of the Chinese characters that hits cover; 1 for a known piece without Chinese."""
    known = F.aggregate(hits, F.lit(0), lambda a, h: a + F.regexp_count(h["term"], F.lit(HAN)))
    n = cjk_count(text)
    return F.when(n > 0, F.least(F.lit(1.0), known.cast("double") / n)).otherwise((F.size(hits) > 0).cast("double"))


def segment(df: DataFrame, ids: Sequence[str], text: str, dictionary: DataFrame | Terms) -> DataFrame:
    """One row per segment: ids, seg_no, zh, en, status, coverage."""
    rows = df.select(*ids, F.posexplode(pieces(F.col(text))).alias("seg_no", "zh"))
    terms = dictionary if isinstance(dictionary, Terms) else food_terms(dictionary)
    keys = [*ids, "seg_no"]
    found = occurrences(rows, keys, "zh", terms).groupBy(*keys).agg(F.collect_list(candidate()).alias("c"))
    met = rows.join(found, keys, "left")
    hits = leftmost_longest(F.coalesce(F.col("c"), F.array().cast(found.schema["c"].dataType)))
    full = met.withColumn("hits", hits)
    return full.select(*keys, "zh", gloss(F.col("zh"), F.col("hits")).alias("en"), segment_status(F.col("hits")).alias("status"), piece_coverage(F.col("zh"), F.col("hits")).alias("coverage"))


_TRIMMED = " \t\n\x0b\f\r\xa0\u3000\ufeff"
_BETWEEN = re.compile(f"[{re.escape(fixed.SEPARATORS)}]")
_NUMBERS = re.compile(f"[0-9.%,\\-+:/{_TRIMMED}]+")
PIECES = "array<struct<zh:string,at:int,hits:array<int>,own:array<struct<start:int,neg_len:int,term:string,status:string,en:string>>>>"


def _bounds(text: str, begin: int, end: int, limit: int = SEGMENT_LIMIT) -> list[tuple[int, int]]:
    """Where the first pieces of text[begin:end] that say more than numbers begin and end; the same pieces as pieces() gives."""
    out, at = [], begin
    for cut in [*(m.start() for m in _BETWEEN.finditer(text, begin, end)), end]:
        piece = text[at:cut]
        low = at + len(piece) - len(piece.lstrip(_TRIMMED))
        high = max(low, cut - (len(piece) - len(piece.rstrip(_TRIMMED))))
        at = cut + 1
        if high > low and not _NUMBERS.fullmatch(text, low, high):
            out.append((low, high))
            if len(out) == limit:
                break
    return out


def _stabbed(bounds: list[tuple[int, int]], starts: list[int], sizes: list[int]) -> list[list[int]]:
    """Of each piece the leftmost longest occurrences inside it, as places in a list ordered by start and longest first.

    Both lists are walked once; an occurrence across a bound is passed over, so a shorter one behind it may be taken.
    """
    out, k = [], 0
    for low, high in bounds:
        while k < len(starts) and starts[k] < low:
            k += 1
        taken, end = [], low
        while k < len(starts) and starts[k] < high:
            if starts[k] >= end and starts[k] + sizes[k] <= high:
                taken.append(k)
                end = starts[k] + sizes[k]
            k += 1
        out.append(taken)
    return out


def label_pieces(terms: Terms, kind: str = "food"):
    """A function of (text, begin, end, starts, lengths) to the pieces of text[begin:end] with their hits.

    starts and lengths: the text's own occurrences in order; hits are places among them. A word that `begin` or `end` cuts is
    a whole word in the piece but not in the text: such a piece is scanned on its own, and has its hits as `own`, else null.
    """
    shared = terms.shared
    letter = re.compile("[A-Za-z]")
    one = pa.struct([("start", pa.int32()), ("neg_len", pa.int32()), ("term", pa.string()), ("status", pa.string()), ("en", pa.string())])
    kinds = pa.list_(pa.struct([("zh", pa.string()), ("at", pa.int32()), ("hits", pa.list_(pa.int32())), ("own", pa.list_(one))]))

    @F.arrow_udf(PIECES)
    def split(text: pa.Array, begin: pa.Array, end: pa.Array, starts: pa.Array, sizes: pa.Array) -> pa.Array:
        rows = []
        for t, lo, hi, s, n in zip(*(x.to_pylist() for x in (text, begin, end, starts, sizes)), strict=True):
            bounds = _bounds(t, lo, hi)
            row = [{"zh": t[a:b], "at": a, "hits": h, "own": None} for (a, b), h in zip(bounds, _stabbed(bounds, s, n), strict=True)]
            for x, (a, b) in ((x, y) for x, y in zip(row, bounds, strict=True) if y[0] == lo or y[1] == hi):
                inner = (a == lo and lo > 0 and letter.match(t[lo - 1]) and letter.match(t[lo])) or (b == hi and hi < len(t) and letter.match(t[hi]) and letter.match(t[hi - 1]))
                if inner:
                    x["own"] = [{c: h[c] for c in ("start", "neg_len", "term", "status", "en")} for h in shared.value.seek([t[a:b]]).column([kind], "longest")[0].as_py()]
            rows.append(row)
        return pa.array(rows, kinds)

    return split


def label_segments(found: Column, occurrences_: Column) -> Column:
    """Segments of a label from its pieces, as label_pieces() gives them, and its occurrences: array of (seg_no, zh, en, status, coverage)."""

    def one(p: Column, i: Column) -> Column:
        def hit(k: Column) -> Column:
            h = F.get(occurrences_, k)
            return F.struct((h["start"] - p["at"]).alias("start"), h["neg_len"].alias("neg_len"), h["term"].alias("term"), h["status"].alias("status"), h["en"].alias("en"))

        hits = F.coalesce(p["own"], F.transform(p["hits"], hit))
        return F.struct(i.alias("seg_no"), p["zh"].alias("zh"), hits.alias("hits"))

    return F.transform(found, one)


def judged_segments(cut: Column) -> Column:
    """Pieces with hits as segments: seg_no, zh, en, status, coverage."""
    return F.transform(cut, lambda p: F.struct(p["seg_no"].alias("seg_no"), p["zh"].alias("zh"), gloss(p["zh"], p["hits"]).alias("en"), segment_status(p["hits"]).alias("status"), piece_coverage(p["zh"], p["hits"]).alias("coverage")))


def segments_coverage(segments: Column) -> tuple[Column, Column]:
    """coverage and cjk_chars of a label over its segments."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("known"))
    summed = F.aggregate(segments, start, lambda a, s: F.struct((a["n"] + cjk_count(s["zh"])).alias("n"), (a["known"] + F.round(cjk_count(s["zh"]) * s["coverage"])).alias("known")))
    return F.when(summed["n"] > 0, summed["known"] / summed["n"]).otherwise(F.lit(0.0)), summed["n"].cast("int")


def coverage(segments: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Per label: coverage and cjk_chars over its segments; the segments as an array too."""
    n = cjk_count("zh")
    return segments.groupBy(*ids).agg(
        F.sum(n).cast("int").alias("cjk_chars"),
        F.sum(F.round(n * F.col("coverage"))).alias("known_chars"),
        F.array_sort(F.collect_list(F.struct("seg_no", "zh", "en", "status", "coverage"))).alias("segments"),
    ).withColumn("coverage", F.when(F.col("cjk_chars") > 0, F.col("known_chars") / F.col("cjk_chars")).otherwise(F.lit(0.0))).drop("known_chars")


def unreadable(kind: Column, confidence: Column, found: Column, cjk: Column, covered: Column) -> Column:
    """Whether a read is noise: low confidence, or too few known words for its length."""
    poor, sure = F.coalesce(confidence < 40, F.lit(False)), F.coalesce(confidence >= 80, F.lit(False))
    food = (poor & (covered < 0.6)) | (~sure & ~found & (cjk >= 20) & (covered < 0.25)) | (found & (cjk >= 8) & (covered < 0.3))
    return F.when(kind == "nonfood", poor).otherwise(food)
