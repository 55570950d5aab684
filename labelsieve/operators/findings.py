"""Findings of a label as an array column: dedupe, severity, order, the part outside the list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsieve.functions.text import severity, snippet, status_label
from labelsieve.operators.section import in_section


def finding(term, en, py, status, category, note, index, source: str) -> Column:
    """A finding before it is judged; all sources have this shape."""
    cols = {"term": term, "en": en, "py": py, "status": status, "category": category, "note": note}
    return F.struct(*[(c if isinstance(c, Column) else F.lit(c)).alias(k) for k, c in cols.items()], index.cast("int").alias("index"), F.lit(source).alias("source"))


def dedupe_findings(df: DataFrame, found: str, into: str) -> DataFrame:
    """df with one finding for each term and status of the array `found`, the first in order, with the number of occurrences.

    Entries are sorted by key, so equal ones stand together and a count is the distance to the next key's first place. The
    steps are columns of their own, because an array inside a lambda is else computed for every element.
    """
    keyed = F.array_sort(F.transform(found, lambda x, i: F.struct(x["term"].alias("term"), x["status"].alias("status"), i.alias("i"), x.alias("x"))))
    same = lambda a, b: a["term"].eqNullSafe(b["term"]) & a["status"].eqNullSafe(b["status"])
    begins = F.filter(F.transform("dedupe_keyed", lambda y, k: F.when((k == 0) | ~same(y, F.get("dedupe_keyed", k - 1)), k)), lambda k: k.isNotNull())
    out = df.withColumn("dedupe_keyed", keyed).withColumn("dedupe_begins", begins)
    fields = ("term", "en", "py", "status", "category", "note", "index", "source")

    def one(k: Column, n: Column) -> Column:
        y, following = F.get("dedupe_keyed", k), F.coalesce(F.get("dedupe_begins", n + 1), F.size("dedupe_keyed"))
        return F.struct(y["i"].alias("i"), F.struct(*[y["x"][c].alias(c) for c in fields], (following - k).alias("count")).alias("x"))

    out = out.withColumn(into, F.transform(F.array_sort(F.transform("dedupe_begins", one)), lambda z: z["x"]))
    return out.drop("dedupe_keyed", "dedupe_begins")


def judged(found: Column, text: Column, section: Column) -> Column:
    """Findings with in_section, severity, label and snippet."""
    return F.transform(found, lambda x: F.struct(
        *[x[c].alias(c) for c in ("term", "en", "py", "status", "category", "note", "index", "source", "count")],
        in_section(section, x["index"]).alias("in_section"), severity(x["status"]).alias("severity"), status_label(x["status"]).alias("label"),
        snippet(text, x["index"], F.length(x["term"])).alias("snippet"),
    ))


def order_findings(found: Column) -> Column:
    """Gravest first, then by place; ties keep their order."""
    keyed = F.transform(found, lambda x, i: F.struct((-x["severity"]).alias("s"), x["index"].alias("a"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def drives_verdict(x: Column, found: Column) -> Column:
    """With a list, only findings in it and forbidden dictionary terms anywhere decide."""
    return ~found | x["in_section"] | ((x["source"] == "dict") & (x["status"] == "haram"))


def split_elsewhere(found: Column, section: Column) -> tuple[Column, Column]:
    """Findings that decide, and the others, which are for display only."""
    return F.filter(found, lambda x: drives_verdict(x, section["found"])), F.filter(found, lambda x: ~drives_verdict(x, section["found"]))


def push_product(found: Column, aside: Column, extra: Column) -> tuple[Column, Column]:
    """Findings and those outside the list with a product name's finding, or null: a known term and status is counted once more where it stands, else it joins the findings."""
    same = lambda f: (f["term"] == extra["term"]) & (f["status"] == extra["status"])
    counted = lambda all_: F.transform(all_, lambda f: f.withField("count", f["count"] + same(f).cast("int")))
    known = F.exists(found, same) | F.exists(aside, same)
    joined = F.when(known, counted(found)).otherwise(order_findings(F.concat(found, F.array(extra))))
    return F.when(extra.isNull(), found).otherwise(joined), F.when(extra.isNull(), aside).otherwise(counted(aside))


def union_findings(*parts: Column) -> Column:
    """Dictionary, rule, code and product findings in that order."""
    return F.concat(*parts)


def max_severity(found: Column) -> Column:
    return F.coalesce(F.try_element_at(found, F.lit(1))["severity"], F.lit(0))


def top_terms(found: Column, severities, n: int) -> Column:
    """The first n findings of some severities, written out."""
    chosen = F.slice(F.filter(found, lambda f: severities(f)), 1, n)
    return F.array_join(F.transform(chosen, lambda f: F.concat(f["term"], F.lit(" ("), f["en"], F.lit(")"))), ", ")
