"""Benchmark decontamination by a positional inverted index, with DataFrame functions only.

The benchmark's windows are its test phrases. All training tokens that are test terms are counted; each window's two
rarest terms are its anchors, and the training postings (document, position) of all anchors are stored, those of a rarest
one with the words around it. A window is sought from its rarest term: that term's list, moved by the distance of the two
anchors, meets the second one's list in an equi-join of document, position and term; what is left is compared word by word.
A window with a term that no document holds is given up before anything is indexed.

Postings are dealt by document and position, so neither a frequent term nor a passage in very many documents is a hot key.
Test terms are broadcast only where their measured number and bytes are below a bound, and else joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsieve.llm.common import stored

#: Words after A-Z is lower-cased, and the same runs in texts as they are: all characters but [\x00-\x2F\x3A-\x60\x7B-\x7F], and
#: but [\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]. Java takes ten times as long for these classes when they are negated.
TERM = r"[0-9a-z\x{80}-\x{10FFFF}]+"
RUN = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
#: Rows and bytes up to which a table is broadcast.
SMALL_ROWS, SMALL_BYTES = 500_000, 64_000_000
#: Words of one block of a document: what a row holds while its words are looked up.
BLOCK = 512


def lowered(text: Column) -> Column:
    """A-Z to a-z only; lower() does that for texts of ASCII alone, which are the quick case."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def terms_of(text: Column) -> Column:
    """The words of a text in order; null has none."""
    return F.regexp_extract_all(lowered(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def small(df: DataFrame, text: str, limit: int) -> DataFrame:
    """df, marked for broadcast if its rows and its bytes of text are few."""
    rows, size = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    return F.broadcast(df) if rows <= limit and (size or 0) <= SMALL_BYTES else df


def test_windows(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(phrase, item): the different windows of each item, words joined by spaces; items without words have none."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), terms_of(F.col(text)).alias("words")).filter(F.size("words") > 0)
    last = F.greatest(F.size("words") - window, F.lit(0))
    phrases = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice("words", i + 1, window), " "))
    return items.select(F.explode(phrases).alias("phrase"), "item").distinct()


def _blocks(rows: DataFrame, reach: int) -> DataFrame:
    """(row, first, body): documents' words in blocks with `reach` words around, first being the position of the body's first word."""
    worded = rows.select("row", terms_of(F.col("text")).alias("words"))
    count = F.size("words")
    block = lambda b: F.struct(b.alias("base"), F.greatest(b - reach, F.lit(0)).alias("first"), F.slice("words", F.greatest(b - reach, F.lit(0)) + 1, F.least(b, F.lit(reach)) + BLOCK + reach).alias("body"))
    # No filter on the number of words: it would be pushed below, and every text be split once more for it.
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1, F.lit(BLOCK)))
    return worded.select("row", F.explode(F.transform(starts, block)).alias("b")).select("row", "b.*")


def term_counts(rows: DataFrame, windows: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """(term, n): how often each test term occurs in all documents; terms that don't occur have no row."""
    sought = stored(windows.select(F.explode(F.split("phrase", " ")).alias("term")).distinct(), "terms")
    given = rows.select(F.explode(terms_of(F.col("text"))).alias("term"))
    return stored(given.join(small(sought, "term", limit), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n")), "counts")


def anchored(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(phrase, words, t1, o1, t2, o2): the two rarest terms of each window that can occur, and their places in it."""
    placed = windows.select("phrase").distinct().select("phrase", F.posexplode(F.split("phrase", " ")).alias("place", "term"))
    ranked = placed.join(counts, "term").groupBy("phrase").agg(F.array_sort(F.collect_list(F.struct("n", "term", "place"))).alias("r"))
    able = ranked.filter(F.size("r") == F.size(F.split("phrase", " ")))
    second = F.when(F.size("r") > 1, F.get("r", F.lit(1))).otherwise(F.get("r", F.lit(0)))
    return able.select("phrase", F.size("r").alias("words"), F.get("r", F.lit(0)).alias("a"), second.alias("b")).select(
        "phrase", "words", F.col("a.term").alias("t1"), F.col("a.place").alias("o1"), F.col("b.term").alias("t2"), F.col("b.place").alias("o2")
    )


def posting_lists(rows: DataFrame, anchors: DataFrame, reach: int, limit: int = SMALL_ROWS) -> DataFrame:
    """(row, pos, term, first, near): all postings of the anchors' terms in all documents.

    near: for a term that is some window's rarest, the words from position `first` to `reach` words behind pos, else null.
    """
    roles = anchors.select(F.explode(F.array(F.struct(F.col("t1").alias("term"), F.lit(True).alias("rarest")), F.struct(F.col("t2").alias("term"), F.lit(False).alias("rarest")))).alias("x")).select("x.*")
    sought = stored(roles.groupBy("term").agg(F.max("rarest").alias("rarest")), "anchors")
    each = _blocks(rows, reach).select("row", "base", "first", "body", F.posexplode("body").alias("i", "term"))
    met = each.join(small(sought, "term", limit), "term")
    pos, begin = F.col("first") + F.col("i"), F.greatest(F.col("i") - reach, F.lit(0))
    near = F.when(F.col("rarest"), F.array_join(F.slice("body", begin + 1, F.col("i") - begin + reach + 1), " "))
    own = (pos >= F.col("base")) & (pos < F.col("base") + BLOCK)
    return stored(met.filter(own).select("row", pos.alias("pos"), "term", (F.col("first") + begin).alias("first"), near.alias("near")), "postings")


def phrase_matches(postings: DataFrame, anchors: DataFrame, windows: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """(row, start, words, item): every occurrence of every window in the documents."""
    distance = F.col("o2") - F.col("o1")
    shapes = anchors.groupBy("t1", "t2", distance.alias("distance")).agg(F.collect_set(F.struct("o1", "words")).alias("shapes"))
    shapes = stored(shapes, "shapes")
    first = postings.filter("near is not null").join(small(shapes, "t1", limit), F.col("term") == F.col("t1"))
    moved = first.select("row", "pos", "first", "near", "t2", "shapes", (F.col("pos") + F.col("distance")).alias("at"))
    second = postings.select("row", F.col("pos").alias("at"), F.col("term").alias("t2"))
    both = moved.join(second, ["row", "at", "t2"]).select("row", "pos", "first", "near", F.explode("shapes").alias("s"))
    start, size = F.col("pos") - F.col("s.o1"), F.col("s.words")
    cut = both.withColumn("around", F.split("near", " ")).withColumn("from", start - F.col("first"))
    cut = cut.filter((F.col("from") >= 0) & (F.col("from") + size <= F.size("around")))
    read = cut.select("row", start.alias("start"), size.alias("words"), F.array_join(F.slice("around", F.col("from") + 1, size), " ").alias("phrase"))
    return read.join(small(windows, "phrase", limit), "phrase").select("row", "start", "words", "item")


def proximity_matches(postings: DataFrame, anchors: DataFrame, windows: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """(row, pos, item): windows all of whose different words stand among the words kept around a posting of their rarest term.

    The reach given to posting_lists says how far. The list of the rarest term meets the second's by the words around.
    """
    pairs = anchors.select("t1", "t2", "phrase")
    around = postings.filter("near is not null").select("row", "pos", "near", F.col("term").alias("t1"), F.explode(F.array_distinct(F.split("near", " "))).alias("t2"))
    met = around.join(small(pairs, "phrase", limit), ["t1", "t2"])
    close = met.filter(F.size(F.array_except(F.split("phrase", " "), F.split("near", " "))) == 0).select("row", "pos", "phrase")
    return close.join(small(windows, "phrase", limit), "phrase").select("row", "pos", "item").distinct()


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, text): documents are told apart by identifier and a hash of the text, so rows that repeat both are one."""
    return docs.select(F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h")).alias("row"), F.col(text).alias("text"))


class Index:
    """The benchmark's windows and the stored postings of the documents; reach: words kept on each side of a rarest term."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, reach: int | None = None, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", limit: int = SMALL_ROWS):
        self.limit, self.rows = limit, keyed(docs, doc_id, text)
        self.windows = stored(test_windows(benchmark, item_id, item_text, window), "windows")
        self.anchors = stored(anchored(self.windows, term_counts(self.rows, self.windows, limit)), "anchored")
        self.postings = posting_lists(self.rows, self.anchors, max(window - 1, reach or 0), limit)

    def phrases(self) -> DataFrame:
        return phrase_matches(self.postings, self.anchors, self.windows, self.limit)

    def near(self) -> DataFrame:
        return proximity_matches(self.postings, self.anchors, self.windows, self.limit)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", limit: int = SMALL_ROWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside any occurrence of a window), n_items, items (ids as sorted strings).

    Null and empty texts have no words and no hits; items without words have no window, an item of fewer words than a
    window is one. Windows in several items count for each. Rows that repeat an identifier with another text are judged
    by their own text. Null item identifiers give hits, but are no item. An empty table gives an empty result, an empty
    benchmark no hits. Other columns aren't read.
    """
    found = Index(docs, benchmark, window, None, doc_id, text, item_id, item_text, limit).phrases()
    per = found.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "words"))).alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    begin = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def cover(acc: Column, x: Column) -> Column:
        end = x["start"] + x["words"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(end - F.greatest(acc["end"], x["start"]), F.lit(0))).alias("n"))

    hits = per.select("row", F.aggregate("spans", begin, cover, lambda acc: acc["n"]).alias("n_hit"), "items")
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(RUN)), F.lit(0)).cast("long")
    told = docs.select(F.col(doc_id).alias("doc_id"), words.alias("n_words"), F.struct(F.col(doc_id).alias("id"), F.xxhash64(text).alias("h")).alias("row"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return told.join(hits, "row", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"))
