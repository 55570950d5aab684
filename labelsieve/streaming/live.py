"""Live frames: rate limit and sharpness gate, a bounded buffer of texts per session, a verdict after every read.

One fold (`Session`) takes a session's frames in the order of their times. The stream keeps frames until the watermark has
passed them and then folds them in order, so the reads are those of the batch twin, whatever order frames come in; the batch
twin folds sorted partitions row by row. Frames behind the watermark are dropped and counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from labelsieve.functions.text import squash_ws, trim
from labelsieve.plans.packs import combined_text, pack_verdict
from labelsieve.sources.tables import Lexicon, Settings, stored

#: Milliseconds between accepted frames, least sharpness, its share of the session's best, texts kept, idle time.
GAP_MS, LEAST_SHARP, SHARP_SHARE, KEPT, IDLE_MS = 1200, 25.0, 0.45, 24, 10 * 60 * 1000
#: How long the stream waits for frames that come late.
LATE = "10 seconds"

_OUT = "session_id {kind}, started_ms long, seq long, version long, frame_no long, frame_ms long, text string, kept boolean, ended boolean, late long, buffer array<string>"
_COLUMNS = ["session_id", "started_ms", "seq", "version", "frame_no", "frame_ms", "text", "kept", "ended", "late", "buffer"]
_FRAME = ["frame_ms", "frame_no", "sharpness", "text", "squashed", "signal"]


class Session:
    """One session so far: first and last frame's time, last accepted time, best sharpness, reads, buffer versions, late frames, texts held."""

    def __init__(self, started: int | None = None, latest: int = 0, last: int = 0, best: float = 0.0, seq: int = 0, version: int = 0, late: int = 0, held: list[tuple[str, str]] | None = None):
        self.started, self.latest, self.last, self.best, self.seq, self.version, self.late, self.held = started, latest, last, best, seq, version, late, held or []

    def row(self, key, no: int, ms: int, text: str, kept: bool, ended: bool) -> tuple:
        return (key, self.started, self.seq, self.version, no, ms, text, kept, ended, self.late, [t for t, _ in self.held])

    def end(self, key) -> list[tuple]:
        """The last row of a session that has begun; the next frame begins a new one."""
        out = [] if self.started is None else [self.row(key, -1, self.latest, "", False, True)]
        self.__init__()
        return out

    def take(self, key, ms: int, no: int, sharp: float, text: str, squashed: str, signal: str | None) -> list[tuple]:
        """Rows that a frame gives: one if it is read, and the end of a session that was idle or is finished by it.

        Frames inside the gap don't touch the best sharpness. A `cancel` forgets the session, and no end is told.
        """
        out = self.end(key) if self.started is not None and ms - self.latest >= IDLE_MS else []
        if self.started is None:
            self.started, self.last = ms, ms - GAP_MS
        self.latest = ms
        if signal == "cancel":
            self.__init__()
            return out
        if ms - self.last >= GAP_MS:
            self.best = max(self.best, sharp)
            if sharp >= max(LEAST_SHARP, SHARP_SHARE * self.best):
                self.last, self.seq = ms, self.seq + 1
                kept = len(text) >= 6 and squashed not in {s for _, s in self.held}
                if kept:
                    self.held, self.version = [*self.held, (text, squashed)][-KEPT:], self.version + 1
                out.append(self.row(key, no, ms, text, kept, False))
        return out + (self.end(key) if signal == "finish" else [])


class Live(StatefulProcessor):
    """State of one session: its fold, the texts held, and the frames that the watermark has not passed. A row per read with its buffer, and one at the end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "started long, latest long, last long, best double, seq long, version long, late long, done long")
        self.texts = handle.getListState("texts", "text string, squashed string")
        self.waiting = handle.getListState("waiting", "frame_ms long, frame_no long, sharpness double, text string, squashed string, signal string")

    def _load(self) -> tuple[Session, int, list[tuple]]:
        told = self.session.get()
        values, done = (list(told[:7]), told[7]) if told else ([None, 0, 0, 0.0, 0, 0, 0], -1)
        return Session(*values, held=[(t[0], t[1]) for t in self.texts.get()]), done, [tuple(f) for f in self.waiting.get()]

    def _fold(self, key, session: Session, waiting: list[tuple], timers) -> pd.DataFrame:
        """Folds the frames that the watermark has passed, keeps the rest, and sets the time of the next look."""
        now, out = int(timers.getCurrentWatermarkInMs()), []
        waiting = sorted(waiting, key=lambda f: (f[0], f[1]))
        for ms, no, sharp, text, squashed, signal in [f for f in waiting if f[0] <= now]:
            out += session.take(key, ms, no, sharp, text, squashed, signal)
        waiting = [f for f in waiting if f[0] > now]
        if session.started is not None and not waiting and now >= session.latest + IDLE_MS:
            out += session.end(key)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if session.started is None and not waiting:
            for state in (self.session, self.texts, self.waiting):
                state.clear()
        else:
            s = session
            self.session.update((s.started, int(s.latest), int(s.last), float(s.best), int(s.seq), int(s.version), int(s.late), now))
            self.texts.put(s.held) if s.held else self.texts.clear()
            self.waiting.put(waiting) if waiting else self.waiting.clear()
            self.handle.registerTimer(max(now + 1, min([f[0] for f in waiting], default=s.latest + IDLE_MS)))
        return pd.DataFrame(out, columns=_COLUMNS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session, done, waiting = self._load()
        for ms, no, sharp, text, squashed, signal in pd.concat(list(rows))[_FRAME].itertuples(index=False):
            if ms <= done:  # Spark drops such frames before; they never change what has been told
                session.late += 1
            else:
                waiting.append((int(ms), int(no), float(sharp), text, squashed, signal if isinstance(signal, str) else None))
        yield self._fold(key[0], session, waiting, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        session, _, waiting = self._load()
        yield self._fold(key[0], session, waiting, timerValues)

    def close(self) -> None:
        pass


def prepared(frames: DataFrame) -> DataFrame:
    """session_id, frame_no, frame_ms, sharpness, the trimmed text with and without white space, signal (finish, cancel or null). Frames without a time are left out, no sharpness is 0."""
    text, signal = trim("text"), F.col("signal") if "signal" in frames.columns else F.lit(None).cast("string")
    sharp = F.coalesce(F.col("sharpness").cast("double"), F.lit(0.0))
    rows = frames.filter("frame_ms is not null")
    return rows.select("session_id", F.coalesce("frame_no", F.lit(0)).cast("long").alias("frame_no"), F.col("frame_ms").cast("long").alias("frame_ms"), sharp.alias("sharpness"), text.alias("text"), squash_ws(text).alias("squashed"), signal.alias("signal"))


def _schema(frames: DataFrame) -> str:
    return _OUT.format(kind=dict(frames.dtypes)["session_id"])


def live_reads(frames: DataFrame, late: str = LATE) -> DataFrame:
    """The reads of a stream of frames (session_id, frame_no, frame_ms, sharpness, text and perhaps signal), in append mode and by event time.

    A read comes out once the watermark, `late` behind the newest frame of all sessions, has passed its frame. How many frames came later
    is told by the query's progress (see dropped_frames). An idle session ends by event time too.
    """
    timed = prepared(frames).withColumn("frame_ts", F.timestamp_millis("frame_ms")).withWatermark("frame_ts", late)
    return timed.groupBy("session_id").transformWithStateInPandas(Live(), outputStructType=_schema(frames), outputMode="Append", timeMode="EventTime")


def dropped_frames(query) -> int:
    """Frames that a query's batches have dropped because the watermark had passed them."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def live_intake(frames: DataFrame) -> DataFrame:
    """Batch twin of live_reads: the same rows. All sessions are over at the end of the table.

    Sessions are dealt over partitions and sorted; a task goes through its frames once and holds one session's buffer, so
    time is linear in the frames and no session is gathered.
    """
    rows = prepared(frames).repartition("session_id").sortWithinPartitions(F.col("session_id"), "frame_ms", "frame_no")
    columns = ["session_id", *_FRAME]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, current = Session(), None
        for batch in batches:
            out = []
            for key, ms, no, sharp, text, squashed, signal in batch[columns].itertuples(index=False):
                if key != current:
                    out += session.end(current)
                    current = key
                out += session.take(key, ms, no, sharp, text, squashed, signal if isinstance(signal, str) else None)
            yield pd.DataFrame(out, columns=_COLUMNS)
        yield pd.DataFrame(session.end(current), columns=_COLUMNS)

    return rows.select(*columns).mapInPandas(fold, _schema(frames))


def live_buffer(reads: DataFrame) -> DataFrame:
    """The buffer that each session has ended with: session_id, started_ms, seq, buffer (the last texts of 6 characters or more that were not in it)."""
    return reads.filter("ended").select("session_id", "started_ms", "seq", "buffer")


def sharp_frames(frames: DataFrame) -> DataFrame:
    """The sharpness gate alone, without the rate limit: frames of at least LEAST_SHARP and SHARP_SHARE of the session's best so far."""
    so_far = Window.partitionBy("session_id").orderBy("frame_ms", "frame_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = prepared(frames).withColumn("best", F.max("sharpness").over(so_far))
    return rows.filter(F.col("sharpness") >= F.greatest(F.lit(LEAST_SHARP), SHARP_SHARE * F.col("best"))).select("session_id", "frame_no", "frame_ms", "sharpness", "text")


def buffer_photos(buffers: DataFrame, key: str = "session_id") -> DataFrame:
    """The buffered texts as the photos of a pack per session, numbered from 1."""
    rows = buffers.select(F.col(key).alias("pack_id"), F.posexplode("buffer").alias("photo_no", "x"))
    return rows.select("pack_id", (F.col("photo_no") + 1).cast("int").alias("photo_no"), F.col("x").alias("text"), F.lit(None).cast("int").alias("ocr_confidence"))


def live_top(verdicts: DataFrame, n: int = 12) -> DataFrame:
    """What a session shows: title, whether a list was found, joins, the first findings, all positives."""
    return verdicts.select("pack_id", F.col("verdict.title").alias("title"), F.col("section.found").alias("found"), "joins", F.slice("findings", 1, n).alias("findings"), "positives")


def session_end(buffers: DataFrame, lexicon: Lexicon, settings: Settings | None = None, key: str = "session_id") -> DataFrame:
    """What a finished session leaves: pack_id, its combined text, and the columns of its final verdict."""
    photos = buffer_photos(buffers, key)
    return combined_text(photos, "frame").join(pack_verdict(photos, lexicon, settings), "pack_id")


def read_verdicts(reads: DataFrame, lexicon: Lexicon, settings: Settings | None = None) -> DataFrame:
    """One row per read with a buffer, and one per end: session_id, started_ms, seq, version, ended, and the columns of session_end.

    Reads that leave the buffer as it was share its version, which is screened once.
    """
    told = stored(reads.filter(F.size("buffer") > 0).withColumn("pack", F.concat_ws("/", F.col("session_id").cast("string"), "started_ms", "version")), "reads")
    versions = stored(told.groupBy("pack").agg(F.first("buffer").alias("buffer")), "versions")
    judged = session_end(versions, lexicon, settings, "pack").withColumnRenamed("text", "combined")
    own = told.select("session_id", "started_ms", "seq", "version", "ended", F.col("pack").alias("pack_id"))
    return own.join(judged, "pack_id").drop("pack_id")


def live_verdict(reads: DataFrame, lexicon: Lexicon, emit: Callable[[DataFrame, int], None], settings: Settings | None = None):
    """Start a query that judges a session's buffer after each read and at its end. `emit` gets read_verdicts of a batch and the batch's number."""

    def each(batch: DataFrame, no: int) -> None:
        # The batch is read once: what follows goes over it several times.
        held = stored(batch, "batch")
        if not held.filter(F.size("buffer") > 0).isEmpty():
            emit(read_verdicts(held, lexicon, settings), no)

    return reads.writeStream.outputMode("append").foreachBatch(each)


def verdict_files(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for live_verdict: parquet folders `batch=<number>` under path. A batch that runs again writes its own folder anew, so no verdict is there twice."""

    def emit(verdicts: DataFrame, no: int) -> None:
        verdicts.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={no}")

    return emit
