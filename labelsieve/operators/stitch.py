"""Joins wrapped lines across the photos of one pack."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

_HAN = re.compile(f"[{chr(0x4E00)}-{chr(0x9FFF)}]")
_SPACE = " \t\r\f\v" + chr(0xA0) + chr(0x3000) + chr(0xFEFF)

#: Lines of a pack up to which an index costs more than it saves.
FEW_LINES = 32


def line_overlap(a: str, b: str) -> int | None:
    """Where line b goes on from the end of line a, or None.

    The shared stretch has 3 to 40 characters, two of them Chinese; one under 5 must stand within 2 of b's start.
    """
    for k in range(min(len(a), len(b), 40), 2, -1):
        tail = a[-k:]
        if len(_HAN.findall(tail)) >= 2:
            at = b.find(tail)
            if at >= 0 and (k >= 5 or at <= 2):
                return at + k
    return None


def _grams(line: str) -> set[str]:
    return {line[k : k + 3] for k in range(len(line) - 2)}


def stitch_lines(texts: list[str | None], rounds: int = 20) -> tuple[str, int]:
    """The texts' lines, chained where they overlap, and the number of joins.

    Lines are walked in order; a chain takes the first fitting unused line of another photo, up to `rounds` times. A line
    that goes on from a chain holds its last three characters, so only lines that an inverted index of three-character
    stretches has under those are tried; lines without overlap are never compared. A few lines are looked through without one.
    """
    photos = [[x for x in (line.strip(_SPACE) for line in (t or "").split("\n")) if len(x) >= 2] for t in texts]
    places = [(i, line) for i, lines in enumerate(photos) for line in lines]
    index: dict[str, list[int]] = {}
    few = len(places) <= FEW_LINES
    for k, (_, line) in enumerate(places):
        for gram in () if few else _grams(line):
            index.setdefault(gram, []).append(k)
    used, out, joins = [False] * len(places), [], 0
    for k, (photo, chain) in enumerate(places):
        if used[k]:
            continue
        used[k] = True
        for _ in range(rounds):
            tail = chain[-3:]
            if few:
                able = [n for n, (_, line) in enumerate(places) if not used[n] and len(tail) == 3 and tail in line]
            else:
                able = index[tail] = [n for n in index.get(tail, ()) if not used[n]]
            fit = next(((n, end) for n in able if places[n][0] != photo and (end := line_overlap(chain, places[n][1])) is not None), None)
            if fit is None:
                break
            used[fit[0]] = True
            chain, joins = chain + places[fit[0]][1][fit[1] :], joins + 1
        out.append(chain)
    return "\n".join(out), joins


def overlap_candidates(photos: DataFrame) -> DataFrame:
    """Which line of a pack may go on from which: pack_id, photo_no, line_no, next_photo_no, next_line_no, at (where the next one goes on).

    An equi-join inside the pack of each line's last three characters with the stretches of the other photos' lines.
    """
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(_SPACE))), lambda x: F.length(x) >= 2)
    rows = photos.select("pack_id", "photo_no", F.posexplode(lines).alias("line_no", "line"))
    tails = rows.filter(F.length("line") >= 3).withColumn("gram", F.right("line", F.lit(3)))
    starts = F.sequence(F.lit(1), F.length("line") - 2)
    heads = rows.filter(F.length("line") >= 3).select("pack_id", F.col("photo_no").alias("next_photo_no"), F.col("line_no").alias("next_line_no"), F.col("line").alias("next"), F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("line", i, F.lit(3))))).alias("gram"))
    met = tails.join(heads, ["pack_id", "gram"]).filter("photo_no <> next_photo_no")
    longest = F.least(F.length("line"), F.length("next"), F.lit(40))

    def end(k: Column) -> Column:
        tail = F.right("line", k)
        at = F.instr(F.col("next"), tail)
        return F.when((F.regexp_count(tail, F.lit(_HAN.pattern)) >= 2) & (at > 0) & ((k >= 5) | (at <= 3)), at - 1 + k)

    ends = F.filter(F.transform(F.sequence(longest, F.lit(3), F.lit(-1)), end), lambda x: x.isNotNull())
    return met.withColumn("at", F.try_element_at(ends, F.lit(1))).filter("at is not null").select("pack_id", "photo_no", "line_no", "next_photo_no", "next_line_no", "at")


def stitch_texts(photos: DataFrame) -> DataFrame:
    """pack_id, text, joins of every pack with a text of two photos or more, or of one.

    The chain is greedy over all photos of a pack. Packs of one photo need none: their lines are cleaned by column functions.
    The others are put side by side by a shuffle and a sort, and read batch by batch; a pack may go over several batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, held = None, []
        for batch in batches:
            out = []
            for pack, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and pack != open_id:
                    out.append((open_id, *stitch_lines(held)))
                    held = []
                open_id = pack
                held.append(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (arrow, pa.string(), pa.int32()), strict=True)], names=["pack_id", "text", "joins"])
        if held:
            text, joins = stitch_lines(held)
            yield pa.RecordBatch.from_arrays([pa.array([open_id], arrow), pa.array([text]), pa.array([joins], pa.int32())], names=["pack_id", "text", "joins"])

    kind, arrow = dict(photos.dtypes)["pack_id"], to_arrow_type(photos.schema["pack_id"].dataType)
    rows = photos.select("pack_id", "photo_no", "text")
    counted = rows.withColumn("of", F.count(F.lit(1)).over(Window.partitionBy("pack_id")))
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(_SPACE))), lambda x: F.length(x) >= 2)
    alone = counted.filter("of = 1").select("pack_id", F.array_join(lines, "\n").alias("text"), F.lit(0).alias("joins"))
    # The window has put a pack's rows into one partition; the sort keeps them there.
    several = counted.filter("of > 1").sortWithinPartitions("pack_id", "photo_no").select("pack_id", "text")
    return several.mapInArrow(run, f"pack_id {kind}, text string, joins int").unionByName(alone)
