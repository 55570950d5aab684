"""Label tables derived from the given ones by arithmetic, in Spark and, as SQL text, for the comparison.

The given tables hold no Chinese, so orders become labels: each line item picks a piece of text by its part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values.
PIECES = [
    "水", "白砂糖", "食用盐", "猪肉", "不添加酒精", "乳化剂(471,322)", "明胶", "未知词条", "鱿鱼肉松", "植物油", "E120", "小麦粉", "牛肉", "食用香精", "猪脚", "果肉",
    "清真", "虾", "增稠剂(INS 407、412)", "鸡蛋", "halal", "羊排", "酵母", "大骨汤", "料酒", "椰子水", "肉丸", "胶原蛋白", "巧克力", "不含猪肉", "甘油",
]
NAMES = ["香脆面包", "橡皮糖", "牛肉干", "巧克力派", "清风湿巾", "绿茶", "火腿肠"]
#: Pieces whose characters meet all kinds of character rules, side by side.
RULE_PIECES = [
    "果", "肉", "桂", "牛", "猪", "骨", "骨干", "血", "血糖", "鸭", "酒", "酒店", "胶", "胶囊", "蛇果", "驴打滚", "驴", "狗", "鸡蛋", "鸡", "村", "路", "、", "a", "鱼", "水", "糖", "松",
]
LATIN = ["the", "of", "and", "that", "der", "die", "und", "les", "que", "del", "trash", "stupid"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label_id, text: one label per order; every fifth has no list header, every third is written in full width."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("item"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda x: _pick(PIECES, x["l_partkey"])), "、")
    per = items.groupBy(F.col("l_orderkey").alias("label_id")).agg(body.alias("body"))
    head = F.when(F.col("label_id") % 5 == 0, F.lit("\n")).otherwise(F.lit("\n配料:"))
    whole = F.concat(F.lit("产品名称:"), _pick(NAMES, F.col("label_id")), head, F.col("body"), F.lit("\n净含量:100克\n地址:酒仙桥路1号"))
    wide = F.replace(F.replace(F.translate(whole, "0123456789():", "０１２３４５６７８９（）："), F.lit("、"), F.lit("、 ")), F.lit("肉"), F.lit(" 肉"))
    return per.select("label_id", F.when(F.col("label_id") % 3 == 0, wide).otherwise(whole).alias("text"))


def rule_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label_id, text: the pieces of an order without anything between."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("item"))
    each = F.transform(F.array_sort(F.collect_list("item")), lambda x: F.concat(_pick(RULE_PIECES, x["l_partkey"]), _pick(RULE_PIECES, x["l_suppkey"])))
    return items.groupBy(F.col("l_orderkey").alias("label_id")).agg(F.array_join(each, "").alias("text"))


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


RULE_TEXTS_SQL = f"""
texts AS (SELECT l_orderkey AS label_id, string_agg({_list(RULE_PIECES)}[CAST(l_partkey % {len(RULE_PIECES)} AS INT) + 1] || {_list(RULE_PIECES)}[CAST(l_suppkey % {len(RULE_PIECES)} AS INT) + 1], ''
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS text FROM lineitem GROUP BY l_orderkey)
"""

#: CTEs `labels` and `norm` (normalised text) in DuckDB.
LABELS_SQL = f"""
bodies AS (SELECT l_orderkey AS label_id, string_agg({_list(PIECES)}[CAST(l_partkey % {len(PIECES)} AS INT) + 1], '、' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS body FROM lineitem GROUP BY l_orderkey),
whole AS (SELECT label_id, '产品名称:' || {_list(NAMES)}[CAST(label_id % {len(NAMES)} AS INT) + 1] || chr(10) || CASE WHEN label_id % 5 = 0 THEN '' ELSE '配料:' END || body || chr(10) || '净含量:100克' || chr(10) || '地址:酒仙桥路1号' AS w FROM bodies),
labels AS (SELECT label_id, CASE WHEN label_id % 3 = 0 THEN replace(replace(translate(w, '0123456789():', '０１２３４５６７８９（）：'), '、', '、 '), '肉', ' 肉') ELSE w END AS text FROM whole),
half AS (SELECT label_id, translate(text, '０１２３４５６７８９（）：　', '0123456789(): ') AS t FROM labels),
near AS (SELECT label_id, regexp_replace(regexp_replace(t, '([㐀-鿿豈-﫿、，。])[ \\t\\n]+([㐀-鿿豈-﫿、，。])', '\\1\\2', 'g'), '([㐀-鿿豈-﫿、，。])[ \\t\\n]+([㐀-鿿豈-﫿、，。])', '\\1\\2', 'g') AS t FROM half),
norm AS (SELECT label_id, regexp_replace(regexp_replace(regexp_replace(t, '([㐀-鿿豈-﫿])[ \\t]+', '\\1', 'g'), '[ \\t]+([㐀-鿿豈-﫿])', '\\1', 'g'), '[ \\t]{{2,}}', ' ', 'g') AS norm FROM near)
"""


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_id, photo_no, text, ocr_confidence: an order's pieces on up to three photos, each repeating the end of the one before."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("item"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda x: _pick(PIECES, x["l_partkey"])), "、")
    parts = items.groupBy("l_orderkey", (F.col("l_linenumber") % 3 + 1).alias("photo_no")).agg(text.alias("part"))
    per = parts.groupBy(F.col("l_orderkey").alias("pack_id")).agg(F.array_sort(F.collect_list(F.struct("photo_no", "part"))).alias("p"))
    shown = F.transform("p", lambda x, i: F.concat(F.when(i == 0, "配料:").otherwise(F.right(F.try_element_at("p", F.greatest(i, F.lit(1)))["part"], F.lit(6))), x["part"]))
    rows = per.select("pack_id", F.posexplode(shown).alias("k", "text"))
    return rows.select("pack_id", (F.col("k") + 1).cast("int").alias("photo_no"), "text", (F.col("pack_id") % 60 + 40).cast("int").alias("ocr_confidence"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, frame_no, frame_ms, sharpness, text from the events of each user."""
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit("配料:"), _pick(PIECES, F.col("event_id")), F.lit("、"), _pick(PIECES, F.col("event_id") * 7))
    return e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("frame_no"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 30000000).cast("long").alias("frame_ms"), F.col("value").alias("sharpness"), text.alias("text"))


def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised lines from line items; line_id numbers the rows of an order."""


    i = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return i.select(
        F.col("l_orderkey").alias("photo_id"), (F.col("l_partkey") % 2).cast("int").alias("read_no"), F.row_number().over(order).alias("line_id"), _pick(PIECES, F.col("l_partkey")).alias("text"),
        F.round(F.col("l_discount") * 10, 2).alias("conf"), (F.col("l_suppkey") * 7).cast("double").alias("x"), (F.col("l_suppkey") * 7 + 60).cast("double").alias("x2"),
        (F.col("l_linenumber") * 20 + F.col("l_partkey") % 9 - 6).cast("double").alias("top"), (F.col("l_linenumber") * 20 + F.col("l_partkey") % 9 + 6).cast("double").alias("bot"),
        (F.col("l_linenumber") * 20 + F.col("l_partkey") % 9).cast("double").alias("y"), (F.lit(12) + F.col("l_suppkey") % 8).cast("double").alias("h"),
        (F.col("l_partkey") % 5 == 0).alias("tall"), (F.col("l_partkey") % 3 > 0).alias("up"),
    )


LINES_SQL = f"""
lines AS (SELECT l_orderkey AS photo_id, CAST(l_partkey % 2 AS INT) AS read_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS line_id,
  {_list(PIECES)}[CAST(l_partkey % {len(PIECES)} AS INT) + 1] AS text, round(l_discount * 10, 2) AS conf, CAST(l_suppkey * 7 AS DOUBLE) AS x, CAST(l_suppkey * 7 + 60 AS DOUBLE) AS x2,
  CAST(l_linenumber * 20 + l_partkey % 9 - 6 AS DOUBLE) AS top, CAST(l_linenumber * 20 + l_partkey % 9 + 6 AS DOUBLE) AS bot,
  CAST(l_linenumber * 20 + l_partkey % 9 AS DOUBLE) AS y, CAST(12 + l_suppkey % 8 AS DOUBLE) AS h, l_partkey % 5 = 0 AS tall, l_partkey % 3 > 0 AS up FROM lineitem)
"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    level = _pick(["haram", "likely", "doubtful", "caution", "clean", "unknown"], F.col("event_id"))
    return e.select("user_id", "ts", F.col("props").alias("text"), level.alias("verdict_level"), F.when(F.col("event_id") % 4 > 0, F.col("event_type")).alias("title"), F.when(F.col("event_id") % 3 == 0, _pick(NAMES, F.col("event_id"))).alias("name"))


HISTORY_SQL = f"""
history AS (SELECT user_id, ts, props AS text, {_list(["haram", "likely", "doubtful", "caution", "clean", "unknown"])}[CAST(event_id % 6 AS INT) + 1] AS verdict_level,
  CASE WHEN event_id % 4 > 0 THEN event_type END AS title, CASE WHEN event_id % 3 = 0 THEN {_list(NAMES)}[CAST(event_id % {len(NAMES)} AS INT) + 1] END AS name FROM events)
"""
