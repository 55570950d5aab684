"""Rules on dictionary hits and on the characters that no term covers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelsieve.functions.text import CJK
from labelsieve.sources import fixed
from labelsieve.sources.rules import rule_rows


def prev_match_guard(hit: Column, previous: Column) -> Column:
    """Status of a hit after a look at the hit that ends where it begins; null: the hit is dropped.

    A generic meat compound glued to seafood or a species belongs to that word (squid floss, fish balls, duck floss).
    """
    generic = (hit["status"] == "likely") & (hit["category"] == "meat") & hit["term"].startswith("肉")
    glued = generic & previous.isNotNull() & (previous["start"] - previous["neg_len"] == hit["start"])
    species = F.substring(previous["term"], -1, 1).isin(*fixed.SPECIES)
    return (
        F.when(~F.coalesce(glued, F.lit(False)), hit["status"])
        .when((previous["category"] == "seafood") & (previous["status"] == "ok"), F.lit(None).cast("string"))
        .when(previous["category"] == "seafood", "seafood")
        .when(species, "meat")
        .otherwise(hit["status"])
    )


def declared_free(before: Column) -> Column:
    """The negation that ends right before a term, or an empty string."""
    return F.regexp_extract(before, f"({fixed.NEGATIONS})$", 1)


def apply_settings(status: Column, category: Column, nonfood: Column, seafood_strict: bool, flag_flavourings: bool) -> Column:
    strict = F.when(~nonfood & (status == "seafood") & F.lit(seafood_strict), "school").otherwise(status)
    return F.when(~nonfood & (strict == "caution") & (category == "flavour") & ~F.lit(flag_flavourings), "note").otherwise(strict)


def generic_rules(text: Column, matches: Column, hits: Column) -> Column:
    """Findings of the character rules, left to right: array of (start, end, status, category, en, note).

    matches: occurrences of the rule table's patterns; hits: the dictionary's matches, which no rule looks into. At a
    character the first matching row counts. A word is cut at other than Chinese characters and at hits. A found word
    uses up its characters, so the fold keeps the end of the last word and the last character looked at. Words near an
    address character are dropped, except pork, and use up nothing.
    """
    rows = rule_rows()
    place_of, back_of, ahead_of = (F.array(*[F.lit(getattr(r, c)) for r in rows]) for c in ("place", "back", "ahead"))

    def placed(m: Column) -> Column:
        place = F.get(place_of, m["ord"])
        before, after = F.concat(m["before"], F.substring(m["term"], F.lit(1), place)), F.concat(F.substring(m["term"], place + 2, F.length(m["term"])), m["after"])
        return F.struct((m["start"] + place).alias("at"), *[m[c].alias(c) for c in ("ord", "status", "category", "en", "note")], before.alias("before"), after.alias("after"))

    free = F.filter(F.transform(matches, placed), lambda x: ~F.exists(hits, lambda h: (h["start"] <= x["at"]) & (x["at"] < h["start"] - h["neg_len"])))

    def reach(x: Column) -> Column:
        left = F.coalesce(F.array_max(F.transform(F.filter(hits, lambda h: h["start"] - h["neg_len"] <= x["at"]), lambda h: h["start"] - h["neg_len"])), F.lit(0))
        right = F.coalesce(F.array_min(F.transform(F.filter(hits, lambda h: h["start"] > x["at"]), lambda h: h["start"])), F.length(text))
        run_back, run_ahead = F.length(F.regexp_extract(x["before"], f"({CJK}*)$", 1)), F.length(F.regexp_extract(x["after"], f"^({CJK}*)", 1))
        start = x["at"] - F.least(F.get(back_of, x["ord"]), run_back, x["at"] - left)
        end = x["at"] + 1 + F.least(F.get(ahead_of, x["ord"]), run_ahead, right - x["at"] - 1)
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), *[x[c].alias(c) for c in ("status", "category", "en", "note")], x["at"].alias("at"))

    sized = F.transform(F.array_sort(free), reach)
    found = lambda x, start: F.struct(start.cast("int").alias("start"), *[x[c].alias(c) for c in ("end", "status", "category", "en", "note")])
    none = F.transform(F.filter(sized, lambda x: F.lit(False)), lambda x: found(x, x["start"]))

    def step(acc: Column, x: Column) -> Column:
        start = F.greatest(x["start"], acc["end"])
        near = F.substring(text, F.greatest(start - 2, F.lit(0)) + 1, x["end"] - start + 4)
        drop = (x["status"] == "") | (x["at"] < acc["end"]) | ((x["category"] != "pork") & near.rlike(fixed.ADDRESS))
        seen = F.struct(acc["end"].alias("end"), x["at"].alias("last"), acc["out"].alias("out"))
        taken = F.struct(x["end"].alias("end"), x["at"].alias("last"), F.concat(acc["out"], F.array(found(x, start))).alias("out"))
        return F.when(x["at"] == acc["last"], acc).when(drop, seen).otherwise(taken)

    return F.aggregate(sized, F.struct(F.lit(0).alias("end"), F.lit(-1).alias("last"), none.alias("out")), step, lambda acc: acc["out"])
