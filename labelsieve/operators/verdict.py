"""Verdicts as ladders over findings, section, product type and read quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelsieve.functions.text import level_color
from labelsieve.operators.findings import max_severity, top_terms
from labelsieve.sources import fixed


def _verdict(level, title, summary) -> Column:
    return F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in (("level", level), ("title", title), ("summary", summary))])


def _say(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _colored(v: Column) -> Column:
    color = F.when(v["title"].startswith("usually fine"), fixed.BY_TYPE_COLOR).otherwise(level_color(v["level"]))
    return F.struct(v["level"].alias("level"), v["title"].alias("title"), v["summary"].alias("summary"), color.alias("color"))


def food_verdict(findings: Column, positives: Column, section: Column, alcoholic: Column, unreadable: Column, covered: Column, chinese: Column, product: Column, web_source: Column | None = None, ai_read: Column | None = None, ai_partial: Column | None = None) -> Column:
    """Struct (level, title, summary, color) of a food label; findings are ordered gravest first."""
    mark = F.exists(positives, lambda p: p["kind"] == "halal")
    top = max_severity(findings)
    first = F.try_element_at(findings, F.lit(1))
    certain = F.coalesce(alcoholic | ((top >= 6) & (first["source"] == "dict")), F.lit(False))
    at = lambda s, n=3: top_terms(findings, lambda f: f["severity"] == s, n)
    above = lambda s, n: top_terms(findings, lambda f: f["severity"] >= s, n)
    by_type = F.when(product["level"] == "clean", "caution").when(product["level"] == "meat", "doubtful").otherwise(product["level"])
    type_title = F.when(by_type == "haram", "forbidden by product type").when(by_type == "likely", "probably forbidden by product type").when(by_type == "doubtful", "doubtful by product type").when(by_type == "caution", "usually fine by product type").otherwise("judged by product type")
    ladder = (
        F.when(unreadable & ~certain, _verdict("unknown", "text unreadable", _say("Only ", F.round(covered * 100).cast("int"), "% of the characters form known words; read the label again.")))
        .when(alcoholic | (top >= 6), _verdict("haram", "forbidden", F.when(top >= 6, _say("Contains ", at(6), ".")).otherwise(F.lit("States an alcohol content."))))
        .when((top == 5) & mark, _verdict("doubtful", "marked halal, but check", _say("Carries a mark, yet lists ", at(5), ".")))
        .when(top == 5, _verdict("likely", "probably forbidden", _say("Lists ", at(5), ".")))
        .when((top >= 3) & mark, _verdict("caution", "marked halal, doubtful items covered", _say("Contains ", above(3, 3), ".")))
        .when(top >= 3, _verdict("doubtful", "doubtful, verify", _say("Contains ", above(3, 3), ".")))
        .when(top >= 1, _verdict("caution", "probably fine, minor points", _say("Minor points: ", above(1, 4), ".")))
        .when(section["found"], _verdict("clean", "nothing forbidden found", "The list was read."))
        .when(~chinese, _verdict("unknown", "no Chinese text", "Nothing to judge."))
        .when(product.isNotNull(), _verdict(by_type, type_title, _say("No list; judged by the name ", product["name"], ", usually made of ", product["typical"], ".")))
        .otherwise(_verdict("unknown", "no ingredient list", "No list was found and nothing was flagged."))
    )
    if web_source is not None:
        ladder = F.when(F.coalesce(web_source, F.lit("")) != "", web_adjust(ladder, product, web_source)).otherwise(ladder)
    if ai_read is not None:
        ladder = F.when(F.coalesce(ai_read, F.lit(False)), ai_adjust(ladder, ai_partial)).otherwise(ladder)
    return _colored(ladder)


def web_adjust(verdict: Column, product: Column, source: Column) -> Column:
    """A list from elsewhere never makes a label clean, and a product name that is worse than it wins."""
    rank = F.create_map(*[F.lit(x) for p in fixed.LEVEL_RANK.items() for x in p])
    worse = product["level"].isin("haram", "likely") & (rank[product["level"]] > F.coalesce(rank[verdict["level"]], F.lit(0)))
    return (
        F.when(F.coalesce(worse, F.lit(False)), _verdict(product["level"], "by product type, against the web list", _say("The name says ", product["en"], "; the list of ", source, " does not show it.")))
        .when(verdict["level"].isin("clean", "caution"), _verdict("caution", "web list shows nothing, confirm on the pack", _say("List of ", source, ".")))
        .otherwise(_verdict(verdict["level"], _say(verdict["title"], " (web list)"), _say("List of ", source, ". ", verdict["summary"])))
    )


def ai_adjust(verdict: Column, partial: Column) -> Column:
    return F.when(partial & (verdict["level"] != "haram"), _verdict("unknown", "list partly unreadable", "Part of the list could not be read.")).otherwise(
        _verdict(verdict["level"], _say(verdict["title"], " (machine-read)"), _say("Transcribed by a vision model; compare with the pack. ", verdict["summary"]))
    )


def nonfood_verdict(findings: Column, section: Column, unreadable: Column, product: Column) -> Column:
    """Struct (level, title, summary, color) of a non-food label: animal material decides, alcohol is a remark."""
    has = lambda s: F.exists(findings, lambda f: f["status"] == s)
    top = lambda s, n=4: top_terms(findings, lambda f: f["status"] == s, n)
    alcohol = F.when(has("alcohol"), _say(" Contains alcohol (", top("alcohol", 3), "), accepted in non-food.")).otherwise(F.lit(""))
    level = F.when(product["level"] == "haram", "haram").when(product["level"] == "animal", "likely").otherwise("caution")
    title = F.when(product["level"] == "haram", "non-food: forbidden by product type").when(product["level"] == "animal", "non-food: usually from animals by product type").when(product["level"] == "clean", "usually fine by product type (non-food)").otherwise("non-food: check the list, by product type")
    ladder = (
        F.when(unreadable, _verdict("unknown", "text unreadable", "Read the label again."))
        .when(has("haram"), _verdict("haram", "non-food: from pigs", _say("Lists ", top("haram"), ".", alcohol)))
        .when(has("animal"), _verdict("likely", "non-food: from animals", _say("Lists ", top("animal"), ".", alcohol)))
        .when(has("unsure"), _verdict("doubtful", "non-food: source unstated", _say("Contains ", top("unsure"), ".", alcohol)))
        .when(section["found"], _verdict("clean", "non-food: nothing from animals found", _say("The list was read.", alcohol)))
        .when(product.isNotNull(), _verdict(level, title, _say("Judged by the name ", product["name"], ".")))
        .otherwise(_verdict("unknown", "non-food: no ingredient list", "No list was found."))
    )
    return _colored(ladder)
