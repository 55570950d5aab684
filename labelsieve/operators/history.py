"""History per user, glossary and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelsieve.functions.text import strip_tones, trim
from labelsieve.sources.tables import small


def latest_history(history: DataFrame, n: int = 50) -> DataFrame:
    """The newest n entries of each user; text breaks ties of time."""
    newest = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), "text", "verdict_level")
    return history.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= n)


def delete_history(history: DataFrame, keys: DataFrame) -> DataFrame:
    return history.join(keys, ["user_id", "ts"], "left_anti")


def history_preview(history: DataFrame) -> DataFrame:
    head = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.when(F.col("verdict_level") != "", F.col("verdict_level")), F.lit("result"))
    named = F.concat(F.when(F.coalesce("name", F.lit("")) != "", F.concat("name", F.lit(" — "))).otherwise(""), head)
    return history.select("user_id", "ts", named.alias("heading"), F.substring(F.coalesce("text", F.lit("")), 1, 120).alias("preview"))


def page(df: DataFrame, n: int = 200, skip: int = 0) -> DataFrame:
    """n rows in dictionary order."""
    return df.orderBy("ord").offset(skip).limit(n)


def glossary_filter(dictionary: DataFrame, status: str = "all", q: str = "") -> DataFrame:
    """Entries of a status that have q in term, translation or romanisation, in any case."""
    rows = dictionary if status == "all" else dictionary.filter(F.col("status") == status)
    sought = q.strip().lower()
    return rows.filter(_has(F.lit(sought), plain=False)) if sought else rows


def _has(sought: Column, plain: bool) -> Column:
    py = strip_tones("py") if plain else F.lower("py")
    return F.contains(F.lower("term"), sought) | F.contains(F.lower("en"), sought) | F.contains(py, sought)


def lookup(dictionary: DataFrame, query: str) -> DataFrame:
    """Entries with the query in term, translation or romanisation without tones; an empty query finds nothing."""
    sought = query.strip().lower()
    return dictionary.filter(_has(F.lit(sought), plain=True)) if sought else dictionary.limit(0)


#: Characters of the longest stretch by which a query is looked for.
GRAM = 3


def _grams(text: Column, size: Column) -> Column:
    """The different stretches of `size` characters of a text, none if it is shorter."""
    last = F.length(text) - size + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def gram_postings(dictionary: DataFrame) -> DataFrame:
    """(gram, ord, term, fields): the stretches of 1 to GRAM characters of each entry's term, translation and romanisation without tones."""
    fields = F.array(F.lower("term"), F.lower("en"), strip_tones("py"))
    named = dictionary.select("ord", "term", F.transform(fields, lambda x: F.coalesce(x, F.lit(""))).alias("fields"))
    grams = F.array_distinct(F.flatten(F.transform("fields", lambda x: F.flatten(F.array(*[_grams(x, F.lit(n)) for n in range(1, GRAM + 1)])))))
    return named.select("ord", "term", "fields", F.explode(grams).alias("gram"))


def lookup_many(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """`lookup` for a table of (query_id, query): query_id, ord, term.

    An inverted list of the dictionary's stretches is met by each different query's rarest one of GRAM characters (all of
    it, if it is shorter), and what is met is compared whole; a query with a stretch that no entry has is given up before.
    Equal queries are looked up once, so neither a frequent query nor a frequent character makes a hot key.
    """
    asked = queries.withColumn("q", F.lower(trim("query"))).filter("q <> ''").select("query_id", "q")
    postings = gram_postings(dictionary)
    lists = small(postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    own = asked.select("q").distinct().withColumn("grams", _grams(F.col("q"), F.least(F.lit(GRAM), F.length("q"))))
    met = own.select("q", F.size("grams").alias("of"), F.explode("grams").alias("gram")).join(lists, "gram")
    rarest = met.groupBy("q").agg(F.count(F.lit(1)).alias("has"), F.first("of").alias("of"), F.min(F.struct("n", "gram")).alias("r")).filter("has = of").select("q", "r.gram")
    found = rarest.join(small(postings), "gram").filter(F.exists("fields", lambda x: F.contains(x, F.col("q")))).select("q", "ord", "term").distinct()
    return asked.join(found, "q").select("query_id", "ord", "term").distinct()
