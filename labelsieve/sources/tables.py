"""Readers, dictionaries as DataFrames, settings and result writers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from labelsieve.sources import fixed
from labelsieve.sources.rules import rule_rows

#: A lexicon up to this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000
ENTRY = ["ord", "term", "status", "en", "py", "category", "note"]


@dataclass
class Settings:
    """Job parameters: defaults that rows may override (`product_kind` and the like)."""

    seafood_strict: bool = False
    flag_flavourings: bool = False
    product_kind: str | None = None
    max_chars: int | None = None

    def merged(self, **over) -> Settings:
        return Settings(**{**self.__dict__, **{k: v for k, v in over.items() if v is not None}})


def small(df: DataFrame) -> DataFrame:
    """Hint a lexicon for broadcast if its measured size is within the bound."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from Python rows that needs no job to be made."""
    fields = StructType.fromDDL(schema)
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(fields.names, r, strict=True)) for r in rows], to_arrow_schema(fields)), fields)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the folder that driver and executors share and read it back, where several results build on it."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="labelsieve-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def load_dictionary(entries: DataFrame) -> DataFrame:
    """Entries with defaults: no status means ok, other gaps are empty; rows without a term go; order by ord."""
    filled = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("en", "py", "category", "note")]
    status = F.when(F.coalesce(F.col("status"), F.lit("")) == "", "ok").otherwise(F.col("status"))
    rows = entries.filter(F.coalesce(F.col("term"), F.lit("")) != "")
    return rows.select(F.col("ord").cast("int").alias("ord"), "term", status.alias("status"), *filled, F.length("term").alias("len"))


def union_dictionaries(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both lists as one, the second's order behind the first's."""
    after = (first.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]) + 1
    return first.unionByName(second.withColumn("ord", (F.col("ord") + after).cast("int")))


def override_union(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides take the place of entries with the same term; new ones follow."""
    over = overrides.select("term", F.struct(*[c for c in overrides.columns if c != "term"]).alias("o"))
    old = base.select("term", F.struct(*[c for c in base.columns if c != "term"]).alias("b"))
    last = base.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0] + 1
    both = old.join(over, "term", "full")
    place = F.coalesce(F.col("b.ord"), F.col("o.ord") + last).cast("int")
    return both.select(place.alias("ord"), "term", *[F.when(F.col("o").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in ("status", "en", "py", "category", "note", "len")])


def remap_nonfood(status: Column, category: Column, term: Column) -> Column:
    """Status of a food entry when it is seen on a non-food label."""
    alcohol = (category == "alcohol") | term.rlike("[酒醇]")
    return (
        F.when(status == "haram", F.when(alcohol, "alcohol").otherwise("haram"))
        .when(status.isin("likely", "meat", "seafood", "school"), "animal")
        .when(status.isin("doubtful", "caution", "review"), "unsure")
        .otherwise("ok")
    )


def build_nonfood_dictionary(base: DataFrame, overrides: DataFrame) -> DataFrame:
    remapped = base.withColumn("status", remap_nonfood(F.col("status"), F.col("category"), F.col("term")))
    return override_union(remapped, overrides)


def load_products(rows: DataFrame) -> DataFrame:
    """One row per alias of (names, level, en, typical, note); ord is the order of rows, then of aliases."""
    split = rows.select(F.col("ord").alias("row_ord"), F.posexplode(F.split("names", r"\|")).alias("pos", "alias"), "level", "en", "typical", "note")
    return split.filter("alias <> ''").select((F.col("row_ord") * 1000 + F.col("pos")).cast("int").alias("ord"), "alias", "level", "en", "typical", "note")


def load_codes(rows: DataFrame) -> DataFrame:
    return rows.select(F.lower("code").alias("code"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("name_zh", "name_en", "note")], F.coalesce("status", F.lit("ok")).alias("status"))


def phrases(spark: SparkSession, kind: str, words: list[str]) -> DataFrame:
    return local_table(spark, [(kind, k, w) for k, w in enumerate(words)], "kind string, ord int, term string")


def rule_terms(spark: SparkSession) -> DataFrame:
    """The character rules as terms to be sought with all others; ord is a row's place, the order of precedence."""
    rows = [("rule", k, r.pattern, True, r.status, r.en, "", r.category, r.note) for k, r in enumerate(rule_rows())]
    return local_table(spark, rows, "kind string, ord int, term string, exact boolean, status string, en string, py string, category string, note string")


@dataclass
class Lexicon:
    """All word tables of a screening job."""

    dictionary: DataFrame
    nonfood: DataFrame
    codes: DataFrame
    products: DataFrame
    products_nonfood: DataFrame
    detect_strong: list[str] = field(default_factory=list)
    detect_weak: list[str] = field(default_factory=list)
    _ready: dict = field(default_factory=dict, repr=False, compare=False)

    def ready(self, name: str, make: Callable):
        """What is made from the word tables once and used by every later scan."""
        if name not in self._ready:
            self._ready[name] = make()
        return self._ready[name]

    def terms(self) -> DataFrame:
        """Everything that is sought in a label, in one table: one pass over the text finds all kinds."""
        spark = self.dictionary.sparkSession
        gap = F.lit("")

        def plain(kind: str, words: list[str]) -> DataFrame:
            return phrases(spark, kind, words).select("kind", "ord", "term", F.lit(True).alias("exact"), *[gap.alias(c) for c in ("status", "en", "py", "category", "note")])

        def entries(kind: str, df: DataFrame) -> DataFrame:
            return df.select(F.lit(kind).alias("kind"), "ord", "term", F.lit(False).alias("exact"), "status", "en", "py", "category", "note")

        def named(kind: str, df: DataFrame, exact: bool) -> DataFrame:
            return df.select(F.lit(kind).alias("kind"), "ord", F.col("alias").alias("term"), F.lit(exact).alias("exact"), F.col("level").alias("status"), "en", F.col("typical").alias("py"), gap.alias("category"), "note")

        parts = [
            entries("food", self.dictionary), entries("nonfood", self.nonfood), named("product", self.products, False), named("product_nonfood", self.products_nonfood, True),
            plain("start", fixed.SECTION_STARTS), plain("start_nonfood", fixed.SECTION_STARTS_NONFOOD), plain("end", fixed.SECTION_ENDS),
            plain("strong", self.detect_strong), plain("weak", self.detect_weak), rule_terms(spark), plain("code", ["E", "INS"]), plain("paren", ["("]),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def read_labels(spark: SparkSession, path: str, max_chars: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Label texts from parquet, json or text files (lines numbered by hash of the line there), optionally cut to max_chars."""
    rows = spark.read.format(fmt).load(path)
    if fmt == "text":
        rows = rows.select(F.xxhash64("value").alias("label_id"), F.col("value").alias("text"))
    return rows if max_chars is None else rows.withColumn("text", F.substring("text", 1, max_chars))


def read_photos(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path).select("pack_id", "photo_no", "text", "ocr_confidence")


def read_lines(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


#: Child tables of a result, one row per element of an array.
CHILDREN = ["findings", "elsewhere", "positives", "codes", "segments"]


def write_results(screened: DataFrame, path: str, day: str, labels: DataFrame | None = None) -> None:
    """The results of one day's run: wide labels by verdict level, the child tables, and history rows.

    Every table is partitioned by day, and a run writes its day's folders only: a run that is repeated leaves one copy, also
    of labels whose level has changed, and other days stay as they are. History (user_id, ts, text, verdict_level, title,
    name) is written where `labels` says whose labels they are (label_id, user_id, ts).
    """
    top = path.rstrip("/")
    own = lambda df, name: df.write.mode("overwrite").parquet(f"{top}/{name}/day={day}")
    screened.withColumn("level", F.col("verdict.level")).write.mode("overwrite").partitionBy("level").parquet(f"{top}/labels/day={day}")
    for child in CHILDREN:
        own(screened.select("label_id", F.posexplode(child).alias("no", "x")).select("label_id", "no", *[F.col(f"x.{c}").alias("place" if c == "no" else c) for c in screened.schema[child].dataType.elementType.names]), child)
    if labels is not None:
        told = screened.select("label_id", F.col("normalized").alias("text"), F.col("verdict.level").alias("verdict_level"), F.col("verdict.title").alias("title"), F.col("name.zh").alias("name"))
        own(labels.select("label_id", "user_id", "ts").join(told, "label_id").select("user_id", "ts", "text", "verdict_level", "title", "name"), "history")
