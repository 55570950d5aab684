"""Judgement by product type, for labels without a list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelsieve.functions.text import CJK
from labelsieve.sources import fixed


def _guess(mentions: Column, levels: dict[str, int], by_level: bool) -> Column:
    """Best of the product mentions: head match, longer name, graver level (food), dictionary order. Struct (name, head, level, sev, en, typical, note, index) or null.
    """
    named = F.create_map(*[F.lit(x) for p in levels.items() for x in p])

    def ranked(m: Column) -> Column:
        sev = F.coalesce(named[m["status"]], F.lit(0))
        # A Chinese product name ends with its head noun: a mention where the Chinese run ends beats modifiers.
        head = ~m["after"].rlike(f"^{CJK}")
        order = F.struct(head.cast("int").alias("h"), (-m["neg_len"]).alias("n"), (sev if by_level else F.lit(0)).alias("s"), (-m["ord"]).alias("o"))
        row = F.struct(m["term"].alias("name"), head.alias("head"), m["status"].alias("level"), sev.alias("sev"), m["en"].alias("en"), m["py"].alias("typical"), m["note"].alias("note"), m["start"].cast("int").alias("index"))
        return F.struct(order.alias("order"), row.alias("row"))

    return F.array_max(F.transform(mentions, ranked))["row"]


def product_guess(mentions: Column) -> Column:
    """mentions: the first occurrence of each name."""
    return _guess(mentions, fixed.PRODUCT_SEVERITY, True)


def nonfood_product_guess(mentions: Column) -> Column:
    return _guess(mentions, fixed.PRODUCT_SEVERITY_NONFOOD, False)
