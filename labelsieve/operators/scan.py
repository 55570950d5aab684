"""Term occurrences and their leftmost-longest resolution.

Up to BROADCAST_ROWS terms are sent to all tasks, which look for them over the code points of whole batches; a row gets its
occurrences as arrays, and nothing is shuffled. More terms stay distributed and meet windows of the texts in an equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from labelsieve.operators.matcher import AFTER, BEFORE, FIELDS, OPENINGS, Matcher
from labelsieve.sources.tables import BROADCAST_ROWS

#: What an occurrence is, as an element of an array; neg_len is the length below zero, so that structs sort longest first.
SEEN = StructType([StructField(c, IntegerType() if c in ("start", "neg_len", "ord") else StringType()) for c in FIELDS])


def _code(char: Column) -> Column:
    """Code point of a character's lower case; 0 for no character."""
    return F.ascii(F.lower(char))


class Terms:
    """Terms made ready for any number of scans; read and sent once. columns: kind, ord, term, exact, status, en, py, category, note."""

    def __init__(self, terms: DataFrame):
        rows, self.terms = terms.limit(BROADCAST_ROWS + 1).toArrow(), terms
        self.local = rows.num_rows <= BROADCAST_ROWS
        self.shared = terms.sparkSession.sparkContext.broadcast(Matcher(rows)) if self.local else None


def with_occurrences(df: DataFrame, ids: Sequence[str], text: str, terms: DataFrame | Terms, columns: dict[str, tuple[Sequence[str] | None, str]]) -> DataFrame:
    """df with array columns of occurrences in the column `text`: name -> (kinds, any if None; all, longest or first, as Found.column() has it).

    Terms that are not `exact` and all ASCII match in any case and as whole words. Arrays are ordered by start, the longest
    first, then by ord; a text without occurrences, or null, has empty ones. ids, which name a row, are used for large lexicons only.
    """
    ready = terms if isinstance(terms, Terms) else Terms(terms)
    if not ready.local:
        return _joined(df, ids, text, ready.terms, columns)
    shared, at, names = ready.shared, df.columns.index(text), [*df.columns, *columns]

    def run(batches):
        for batch in batches:
            found = shared.value.seek(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *[found.column(*how) for how in columns.values()]], names=names)

    return df.mapInArrow(run, StructType([*df.schema.fields, *[StructField(c, ArrayType(SEEN)) for c in columns]]))


def _joined(df: DataFrame, ids: Sequence[str], text: str, terms: DataFrame, columns: dict) -> DataFrame:
    whole = F.array_sort(F.collect_list(F.struct(*SEEN.names)))
    found = _windows(df, ids, text, terms).withColumn("neg_len", -F.col("len")).groupBy(*ids).agg(whole.alias("scan_seen"))
    met = df.join(found, list(ids), "left").withColumn("scan_seen", F.coalesce("scan_seen", F.array().cast(ArrayType(SEEN))))
    of = lambda kinds: F.col("scan_seen") if kinds is None else F.filter("scan_seen", lambda x: x["kind"].isin(*kinds))
    return met.withColumns({c: _CHOICES[which](of(kinds)) for c, (kinds, which) in columns.items()}).drop("scan_seen")


def occurrences(df: DataFrame, ids: Sequence[str], text: str, terms: DataFrame | Terms) -> DataFrame:
    """All occurrences of all terms as rows: ids, start, len, kind, ord, term, the entry's fields, before, after."""
    ready = terms if isinstance(terms, Terms) else Terms(terms)
    if not ready.local:
        return _windows(df, ids, text, ready.terms)
    rows = with_occurrences(df.select(*ids, F.col(text).alias("scan_text")), ids, "scan_text", ready, {"scan_seen": (None, "all")})
    return rows.select(*ids, F.explode("scan_seen").alias("x")).select(*ids, "x.start", (-F.col("x.neg_len")).alias("len"), *[f"x.{c}" for c in ("kind", "ord", "term", "status", "en", "py", "category", "note", "before", "after")])


def _code(char: Column) -> Column:
    """Code point of a character's lower case; 0 for no character."""
    return F.ascii(F.lower(char))


def _windows(df: DataFrame, ids: Sequence[str], text: str, terms: DataFrame) -> DataFrame:
    """occurrences() for terms that are too many to be sent.

    Inside each text, positions are kept whose two characters may open a term, by a table of fixed size; only those become
    rows, each with a window as wide as the longest term and its surroundings. The lengths of the first character's terms
    give the keys, and the keys meet the terms in an equi-join. Outside the text the window holds NUL.
    """
    ascii_term = F.col("term").rlike("^[\\x00-\\x7f]+$")
    keyed = terms.withColumn("loose", ascii_term & ~F.col("exact")).withColumn("key", F.when(ascii_term, F.lower("term")).otherwise(F.col("term"))).withColumn("len", F.length("term"))
    first_code, second_code = _code(F.substring("key", 1, 1)), _code(F.substring("key", 2, 1))
    place = F.when(F.col("len") > 1, (first_code * 31 + second_code) % OPENINGS).otherwise(first_code % OPENINGS + OPENINGS)
    openings = bytearray(2 * OPENINGS)
    # 1: only at the start of a word, 2: anywhere; a term of one character by that alone, in the second half.
    for r in keyed.groupBy(place.alias("at")).agg(F.max(F.when(F.col("loose"), 1).otherwise(2)).alias("mark")).collect():  # at most 2 * OPENINGS rows
        openings[r["at"]] = r["mark"]
    longest, table = keyed.agg(F.max("len")).first()[0] or 1, F.lit(bytes(openings))
    width = BEFORE + longest + AFTER
    padded = F.concat(F.lit("\0" * BEFORE), F.coalesce(F.col(text), F.lit("")), F.lit("\0" * (longest + AFTER)))
    chars = df.select(*ids, F.split(padded, "").alias("scan_chars"))
    count = F.size("scan_chars") - (BEFORE + longest + AFTER)

    def may_open(i: Column) -> Column:
        char = lambda k: F.get("scan_chars", i + k)
        first = _code(char(BEFORE - 1))
        pair, single = F.substring(table, (first * 31 + _code(char(BEFORE))) % OPENINGS + 1, F.lit(1)), F.substring(table, first % OPENINGS + (OPENINGS + 1), F.lit(1))
        inner = char(BEFORE - 2).rlike("[A-Za-z]")
        return (pair == F.lit(b"\2")) | (single == F.lit(b"\2")) | (((pair == F.lit(b"\1")) | (single == F.lit(b"\1"))) & ~inner)

    places = F.filter(F.sequence(F.lit(1), count), may_open)
    windows = F.when(count > 0, F.transform(places, lambda i: F.struct((i - 1).alias("start"), F.array_join(F.slice("scan_chars", i, width), "").alias("window"))))
    at = chars.select(*ids, F.explode(windows).alias("w")).select(*ids, "w.*")
    firsts = keyed.groupBy(F.lower(F.substring("key", 1, 1)).alias("first")).agg(F.collect_set("len").alias("lens"))
    seen = at.join(firsts, F.lower(F.substring("window", BEFORE + 1, 1)) == F.col("first")).select(*ids, "start", "window", F.explode("lens").alias("scan_len"))
    piece = F.substring("window", F.lit(BEFORE + 1), F.col("scan_len"))
    probed = seen.withColumn("piece", piece).withColumn("probe", F.when(F.col("piece").rlike("^[\\x00-\\x7f]+$"), F.lower("piece")).otherwise(F.col("piece")))
    met = probed.join(keyed, (F.col("probe") == F.col("key")) & (F.col("scan_len") == F.col("len")))
    after = F.substring("window", F.lit(BEFORE + 1) + F.col("scan_len"), F.lit(AFTER))
    before = F.substring("window", 1, BEFORE)
    whole = ~F.substring("window", BEFORE, 1).rlike("[A-Za-z]") & ~F.substring(after, 1, 1).rlike("[A-Za-z]")
    right = F.when(F.col("loose"), whole).otherwise(F.col("piece") == F.col("term"))
    return met.filter(right).select(*ids, "start", F.col("len"), "kind", "ord", "term", "status", "en", "py", "category", "note", F.regexp_replace(before, "\0", "").alias("before"), F.regexp_replace(after, "\0", "").alias("after"))


def find_phrases(df: DataFrame, ids: Sequence[str], text: str, phrases: DataFrame) -> DataFrame:
    """All occurrences of (kind, ord, term) phrases, overlapping ones too; case counts."""
    gap = F.lit("")
    terms = phrases.select("kind", "ord", "term", F.lit(True).alias("exact"), *[gap.alias(c) for c in ("status", "en", "py", "category", "note")])
    return occurrences(df, ids, text, terms).select(*ids, "kind", "ord", "term", "start", "len")


def candidate() -> Column:
    """An occurrence as a struct that sorts by start, longest first, dictionary order on ties."""
    return F.struct("start", (-F.col("len")).alias("neg_len"), "ord", "term", "status", "en", "py", "category", "note", "before", "after")


def leftmost_longest(candidates: Column) -> Column:
    """Of candidates those that a scan from left to right takes: the longest at each position, no overlaps."""
    start = F.struct(F.lit(0).alias("at"), F.filter(candidates, lambda x: F.lit(False)).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        taken = F.struct((x["start"] - x["neg_len"]).alias("at"), F.concat(acc["out"], F.array(x)).alias("out"))
        return F.when(x["start"] >= acc["at"], taken).otherwise(acc)

    return F.aggregate(F.array_sort(candidates), start, step, lambda acc: acc["out"])


def first_mentions(mentions: Column) -> Column:
    """The first occurrence of each entry; for lexicons that are joined, elsewhere the scan gives these alone."""
    return F.filter(mentions, lambda m: ~F.exists(mentions, lambda o: (o["kind"] == m["kind"]) & (o["ord"] == m["ord"]) & (o["start"] < m["start"])))


_CHOICES = {"all": lambda x: x, "longest": leftmost_longest, "first": first_mentions}


def food_terms(dictionary: DataFrame) -> Terms:
    """A dictionary's entries made ready for scans."""
    return Terms(dictionary.select(F.lit("food").alias("kind"), "ord", "term", F.lit(False).alias("exact"), "status", "en", "py", "category", "note"))


def scan_dictionary(df: DataFrame, ids: Sequence[str], text: str, dictionary: DataFrame | Terms) -> DataFrame:
    """Leftmost-longest matches: ids, start, end, and the entry's fields. Texts without a match give no rows."""
    terms = dictionary if isinstance(dictionary, Terms) else food_terms(dictionary)
    rows = with_occurrences(df.select(*ids, F.col(text).alias("scan_text")), ids, "scan_text", terms, {"scan_hits": (None, "longest")})
    hits = rows.select(*ids, F.explode("scan_hits").alias("h"))
    return hits.select(*ids, F.col("h.start").alias("start"), (F.col("h.start") - F.col("h.neg_len")).alias("end"), *[F.col(f"h.{c}").alias(c) for c in ("ord", "term", "status", "en", "py", "category", "note")])
