"""Additive codes: explicit E / INS numbers and bracketed lists behind additive names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsieve.functions.text import SPACE
from labelsieve.operators.scan import occurrences
from labelsieve.sources import fixed
from labelsieve.sources.tables import phrases, small

#: A list of codes. Digits in a row are codes of 3 or 4 if they are 3, 4, 6 or more; nothing is tried twice, so any length is cheap.
_LIST = r"(?i)^\s*+(?:(?:(?:INS|E)\s*+)?+(?:\d{6,}+|\d{3,4}+(?!\d))(?:(?!INS)[a-z])?+\s*+[,，、;；/和及]?+\s*+)++$"


def code_mentions(text: Column, marks: Column, parens: Column) -> Column:
    """All mentions: array of (group, at, no, code, explicit) in the order of precedence.

    marks: array of (start, term, before, after) of E and INS; parens: array of (start) of opening brackets.
    """
    number = r"^[-\s]?(\d{3,4}[a-z]?)(?![\dA-Za-z])"

    def explicit(m: Column) -> Column:
        code = F.regexp_extract(m["after"], number, 1)
        rest = F.regexp_replace(m["after"], number, "")
        good = (code != "") & ~m["before"].rlike("[A-Za-z]$") & ~rest.rlike(fixed.UNIT_AFTER)
        return F.when(good, F.struct(F.lit(0).alias("group"), F.greatest(m["start"] - 1, F.lit(0)).cast("int").alias("at"), F.lit(0).alias("no"), F.lower(code).alias("code"), F.lit(True).alias("explicit")))

    def bracket(p: Column) -> Column:
        at = p["start"]
        inner = F.regexp_extract(F.substring(text, at + 1, F.lit(82)), r"^\(([^()]{1,80})\)", 1)
        before = F.regexp_replace(F.substring(text, F.greatest(at - 10, F.lit(0)) + 1, F.least(F.lit(10), at)), f"{SPACE}+$", "")
        tail = F.substring(text, at + F.length(inner) + 3, F.lit(12))
        prefixed = inner.rlike(r"(?i)(?:INS|E)\s*\d")
        bare = before.rlike("(剂|色素|添加|香料|INS|E)$") & ~before.rlike("(?i)净含量|规格|克|毫升|ml|kg") & ~tail.rlike(fixed.UNIT_AFTER)
        good = (inner != "") & ~before.rlike("GB|/T|Q/") & inner.rlike(_LIST) & (prefixed | bare)
        codes = F.regexp_extract_all(inner, F.lit(r"(?i)\d{3,4}[a-z]?"), F.lit(0))
        each = F.transform(codes, lambda c, k: F.struct(F.lit(1).alias("group"), at.cast("int").alias("at"), k.alias("no"), F.lower(c).alias("code"), F.lit(False).alias("explicit")))
        return F.when(good, each)

    first = F.filter(F.transform(marks, explicit), lambda x: x.isNotNull())
    second = F.flatten(F.filter(F.transform(parens, bracket), lambda x: x.isNotNull()))
    return F.array_sort(F.concat(F.coalesce(first, F.array().cast("array<struct<group:int,at:int,no:int,code:string,explicit:boolean>>")), F.coalesce(second, F.array().cast("array<struct<group:int,at:int,no:int,code:string,explicit:boolean>>"))))


def join_codes(mentions: DataFrame, codes: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Mentions (ids, group, at, no, code, explicit) with their entries, first mention of each code only.

    A code that is not in the table falls back to itself without the last letter; unknown explicit ones are for review,
    unknown bracketed ones go.
    """
    table = codes.select("code", F.struct("name_zh", "name_en", "status", "note").alias("entry"))
    own = small(table.select(F.col("code").alias("own_code"), F.col("entry").alias("own")))
    base = small(table.select(F.col("code").alias("base_code"), F.col("entry").alias("base")))
    met = mentions.join(own, F.col("code") == F.col("own_code"), "left").join(base, F.regexp_replace("code", "[a-z]$", "") == F.col("base_code"), "left")
    unknown = F.struct(F.lit("").alias("name_zh"), F.lit("code not in the table").alias("name_en"), F.lit("review").alias("status"), F.lit("unknown additive code").alias("note"))
    entry = F.coalesce("own", "base", F.when(F.col("explicit"), unknown))
    order = F.struct("group", "at", "no")
    rows = met.withColumn("entry", entry).filter("entry is not null").groupBy(*ids, "code").agg(F.min_by(F.struct("group", "at", "no", "entry"), order).alias("m"))
    return rows.select(*ids, F.upper("code").alias("code"), F.col("m.group").alias("group"), F.col("m.at").alias("index"), F.col("m.no").alias("no"), *[F.col(f"m.entry.{c}").alias(c) for c in ("name_zh", "name_en", "status", "note")])


def parse_codes(df: DataFrame, ids: Sequence[str], text: str, codes: DataFrame) -> DataFrame:
    """Codes of each text: ids, code, index and the entry. The text is taken as already normalised."""
    spark = df.sparkSession
    gap = F.lit("")
    terms = phrases(spark, "code", ["E", "INS"]).unionByName(phrases(spark, "paren", ["("])).select("kind", "ord", "term", F.lit(True).alias("exact"), *[gap.alias(c) for c in ("status", "en", "py", "category", "note")])
    seen = occurrences(df, ids, text, terms)
    per = seen.groupBy(*ids).agg(
        F.collect_list(F.when(F.col("kind") == "code", F.struct("start", "term", "before", "after"))).alias("marks"), F.collect_list(F.when(F.col("kind") == "paren", F.struct("start"))).alias("parens")
    )
    said = df.select(*ids, text).join(per, list(ids)).select(*ids, F.explode(code_mentions(F.col(text), F.col("marks"), F.col("parens"))).alias("c")).select(*ids, "c.*")
    return join_codes(said, codes, ids)
