"""Recognised text lines: choice of a read, region re-reads, reading order, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelsieve.functions.text import ocr_post_process
from labelsieve.sources import fixed

#: Lines below this confidence are not text.
TEXT_SCORE = 0.5


def kept_lines(lines: DataFrame, least: float = TEXT_SCORE) -> DataFrame:
    return lines.filter(F.col("conf") >= least)


def _weight() -> Column:
    return F.col("conf") * F.length(F.coalesce("text", F.lit("")))


def read_score(lines: DataFrame) -> DataFrame:
    """photo_id, read_no, score: confidence times length, summed over a read's lines."""
    return lines.groupBy("photo_id", "read_no").agg(F.sum(_weight()).alias("score"))


def sideways_angle(lines: DataFrame) -> DataFrame:
    """photo_id, angle, tall_share: 0 where a list anchor was read or tall lines weigh too little, else 90 or 270."""
    tall = F.coalesce(F.col("tall"), F.lit(False))
    vote = F.when(tall, F.when(F.col("up"), _weight()).otherwise(-_weight())).otherwise(0.0)
    per = lines.groupBy("photo_id").agg(
        F.bool_or(F.col("text").rlike(fixed.ANCHOR)).alias("anchor"), F.sum(_weight()).alias("all"), F.sum(F.when(tall, _weight()).otherwise(0.0)).alias("tall"), F.sum(vote).alias("vote")
    )
    share = F.when(F.col("all") > 0, F.col("tall") / F.col("all")).otherwise(0.0)
    flat = F.coalesce("anchor", F.lit(False)) | (F.col("all") == 0) | (F.col("tall") < 0.12 * F.col("all"))
    return per.select("photo_id", F.when(flat, 0).when(F.col("vote") >= 0, 90).otherwise(270).alias("angle"), share.alias("tall_share"))


def choose_read(lines: DataFrame, upright: int = 0, turned: int = 1) -> DataFrame:
    """The lines of the better read of each photo: the turned one must do as well, and clearly better on weak evidence."""
    scores = read_score(lines).groupBy("photo_id").agg(F.max(F.when(F.col("read_no") == upright, F.col("score"))).alias("s0"), F.max(F.when(F.col("read_no") == turned, F.col("score"))).alias("s1"))
    angle = sideways_angle(lines.filter(F.col("read_no") == upright))
    factor = F.when(F.round("tall_share", 2) >= 0.2, 1.0).otherwise(1.25)
    better = (F.col("angle") > 0) & (F.col("s1") >= factor * F.col("s0"))
    picked = scores.join(angle, "photo_id", "left").select("photo_id", F.when(F.coalesce(better, F.lit(False)) | F.col("s0").isNull(), turned).otherwise(upright).alias("read_no"), F.when(F.coalesce(better, F.lit(False)), F.col("angle")).otherwise(0).alias("rotated"))
    return lines.join(picked, ["photo_id", "read_no"])


def read_merge(old: DataFrame, new: DataFrame, regions: DataFrame) -> DataFrame:
    """Lines inside a re-read region (a margin of 0.3 line heights aside) give way to the re-read.

    regions: photo_id, x0, y0, x1, y1, lh, one per photo. A re-read that is empty or has fewer confidently read characters
    is not used.
    """
    margin = 0.3 * F.col("lh")
    outside = (F.col("bot") <= F.col("y0") + margin) | (F.col("top") >= F.col("y1") - margin) | (F.col("x2") <= F.col("x0") + margin) | (F.col("x") >= F.col("x1") - margin)
    placed = old.join(regions, "photo_id", "left").withColumn("inside", F.coalesce(~outside, F.lit(False))).drop("x0", "y0", "x1", "y1", "lh")
    good = F.sum(F.when(F.col("conf") >= 0.7, F.length("text")).otherwise(0))
    before = placed.filter("inside").groupBy("photo_id").agg(good.alias("old_good"))
    used = new.groupBy("photo_id").agg(good.alias("new_good")).join(before, "photo_id", "left").filter(F.col("new_good") >= F.coalesce("old_good", F.lit(0))).select("photo_id", F.lit(True).alias("used"))
    kept = placed.join(used, "photo_id", "left").filter(~(F.col("inside") & F.coalesce("used", F.lit(False)))).select(*old.columns)
    return kept.unionByName(new.join(used.select("photo_id"), "photo_id", "left_semi").select(*old.columns))


def reading_order(lines: DataFrame) -> DataFrame:
    """Lines with band and place: by centre height in bands, left to right inside a band; line_id breaks ties."""
    down = Window.partitionBy("photo_id").orderBy("y", "line_id")
    height = F.greatest(F.lit(8.0), F.least("h", F.lag("h").over(down)))
    opens = F.coalesce((F.col("y") - F.lag("y").over(down) > 0.3 * height).cast("int"), F.lit(0))
    banded = lines.withColumn("opens", opens).withColumn("band", F.sum("opens").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("opens")
    return banded.withColumn("place", F.row_number().over(Window.partitionBy("photo_id").orderBy("band", "x", "y", "line_id")))


def photo_texts(lines: DataFrame) -> DataFrame:
    """photo_id, text (lines in reading order), confidence (rounded mean in percent)."""
    ordered = reading_order(lines)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n")
    return ordered.groupBy("photo_id").agg(text.alias("text"), F.round(F.round(100 * F.avg("conf"), 6)).cast("int").alias("confidence"))


def text_confidence(lines: DataFrame) -> DataFrame:
    return kept_lines(lines).groupBy("photo_id").agg(F.round(F.round(100 * F.avg("conf"), 6)).cast("int").alias("confidence"))


def box_order(boxes: DataFrame) -> DataFrame:
    """photo_id, box_id, place: by top-left corner, then each box bubbles left past higher ones less than 10 apart in height.

    The boxes of one photo are few; the insertion is a fold over the sorted array.
    """
    per = boxes.groupBy("photo_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "box_id"))).alias("b"))

    def insert(acc: Column, new: Column) -> Column:
        # The new box moves left while its left neighbour is level with it and further right.
        n = F.size(acc)
        stop = F.aggregate(F.reverse(acc), F.struct(F.lit(0).alias("moves"), F.lit(True).alias("on")), lambda s, b: F.when(s["on"] & (F.abs(new["y"] - b["y"]) < 10) & (new["x"] < b["x"]), F.struct((s["moves"] + 1).alias("moves"), F.lit(True).alias("on"))).otherwise(F.struct(s["moves"].alias("moves"), F.lit(False).alias("on"))))
        keep = n - stop["moves"]
        return F.concat(F.slice(acc, F.lit(1), keep), F.array(new), F.slice(acc, keep + 1, stop["moves"]))

    ordered = per.select("photo_id", F.aggregate(F.slice("b", 2, F.size("b")), F.slice("b", 1, 1), insert).alias("b"))
    return ordered.select("photo_id", F.posexplode("b").alias("pos", "x")).select("photo_id", F.col("x.box_id").alias("box_id"), (F.col("pos") + 1).alias("place"))


def fallback_read(reads: DataFrame, order: tuple[str, ...] = ("server", "phone", "basic")) -> DataFrame:
    """The text of the first engine that answered; basic reads are post-processed."""
    rank = F.coalesce(*[F.when(F.col("engine") == e, F.lit(k)) for k, e in enumerate(order)], F.lit(len(order)))
    first = Window.partitionBy("photo_id").orderBy(rank, "engine")
    text = F.when(F.col("engine") == "basic", ocr_post_process("text")).otherwise(F.col("text"))
    return reads.filter("text is not null").withColumn("k", F.row_number().over(first)).filter("k = 1").select("photo_id", "engine", text.alias("text"), "confidence")
