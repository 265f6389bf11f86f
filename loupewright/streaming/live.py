"""The pulse log as a stream, and notices of silent devices.

Notices wait an hour for late pulses (the watermark); what comes later is written beside them and
corrects them when they are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from loupewright.sources.tables import SCHEMAS
from loupewright.streaming.meters import SILENCE_MINUTES

#: How late a pulse may come before a silence is announced.
WATERMARK = "1 hour"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, folder: str, name: str = "events", files_per_batch: int | None = None) -> DataFrame:
    """The event table, one file or a folder of part files, as a file stream.

    Part files are in no order of time. Day counts take them in batches of any size; for alerts and
    silences, which depend on what is known at a time, all files that are there are one batch. The path
    is written as a pattern that only it matches: a stream takes a plain path for a folder.
    """
    reader = spark.readStream.schema(SCHEMAS[name])
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{folder}/[{name[0]}]{name[1:]}.parquet")


def stamped(pulses: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Pulses with an event time that watermarks accept; the log itself has no time zone."""
    return pulses.withColumn("transDate", F.col("transDate").cast("timestamp")).withWatermark("transDate", watermark)


NOTICE = T.StructType(
    [
        T.StructField("device", T.StringType()),
        T.StructField("notice", T.StringType()),
        T.StructField("at", T.TimestampType()),
    ]
)


class SilenceWatch(StatefulProcessor):
    """Per device: slots that may still grow, the last pulse before them, and whether its silence was announced.

    Input is one row per device, slot of the silence length and Arrow batch, so a busy device sends few
    rows here. A slot counts when the watermark has passed it. What comes later than that is given out
    as ``late``, and the first pulse of a device as ``first``: with both, :func:`corrected_silences`
    restores what a job over the whole log finds.
    """

    def __init__(self, minutes: int = SILENCE_MINUTES):
        self.gap = minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # The open slots are one packed value: (slot, first, last) each, read and written at once.
        self.state = handle.getValueState("silence", "last_us bigint, offline boolean, slots binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        notices: list[tuple[str, int]] = []
        new: dict[int, tuple[int, int]] = {}
        for frame in rows:
            for slot, first, last in zip(frame["slot"], frame["first_us"], frame["last_us"]):
                if first < reached:
                    notices.append(("late", int(first)))
                    if last < reached:
                        if last > first:
                            notices.append(("late", int(last)))
                        continue
                    first = last
                known = new.get(int(slot), (first, last))
                new[int(slot)] = int(min(first, known[0])), int(max(last, known[1]))
        yield from self._advance(key, reached, notices, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1000, [], {})

    def _advance(
        self, key, reached: int, notices: list[tuple[str, int]], new: dict[int, tuple[int, int]]
    ) -> Iterator[pd.DataFrame]:
        """Notices of all that the watermark has passed; one timer for what comes next."""
        last, offline, packed = self.state.get() if self.state.exists() else (None, False, b"")
        open_slots = {slot: (first, final) for slot, first, final in struct.iter_unpack("<3q", packed)}
        for slot, (first, final) in new.items():
            known = open_slots.get(slot, (first, final))
            open_slots[slot] = min(first, known[0]), max(final, known[1])
        slots = sorted((first, final, slot) for slot, (first, final) in open_slots.items())
        done = [s for s in slots if (s[2] + 1) * self.gap <= reached]
        for first, final, _ in done:
            if last is None:
                notices.append(("first", first))
            elif not offline and first - last >= self.gap:
                notices.append(("offline", last))
                offline = True
            if offline:
                notices.append(("online", first))
            last, offline = final, False
        waiting = slots[len(done) :]
        if last is not None and not offline and reached >= last + self.gap and (not waiting or waiting[0][0] - last >= self.gap):
            notices.append(("offline", last))
            offline = True
        self.state.update((last, offline, b"".join(struct.pack("<3q", slot, first, final) for first, final, slot in waiting)))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        following = [(waiting[0][2] + 1) * self.gap] if waiting else []
        if last is not None and not offline and last + self.gap > reached:  # a timer of the past would fire without end
            following.append(last + self.gap)
        if following:
            self.handle.registerTimer(-(-min(following) // 1000))
        if notices:
            yield pd.DataFrame({"device": [key[0]] * len(notices), "notice": [kind for kind, _ in notices],
                                "at": pd.to_datetime([us for _, us in notices], unit="us")})

    def close(self) -> None:
        pass


def slot_ends(pulses: DataFrame, minutes: int = SILENCE_MINUTES) -> DataFrame:
    """deviceCode, slot, first_us, last_us: the ends of each slot in each Arrow batch, without a shuffle."""
    gap = minutes * 60_000_000

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.table({"deviceCode": batch.column(0), "us": batch.column(1)}).drop_null()
            slot = pa.array(rows["us"].to_numpy() // gap, pa.int64())
            found = rows.append_column("slot", slot).group_by(["deviceCode", "slot"]).aggregate([("us", "min"), ("us", "max")])
            yield from found.rename_columns(["deviceCode", "slot", "first_us", "last_us"]).to_batches()

    times = pulses.select("deviceCode", F.unix_micros("transDate").alias("us"))
    return times.mapInArrow(ends, "deviceCode string, slot long, first_us long, last_us long")


CLOSING = T.StructType([T.StructField("deviceCode", T.StringType()), T.StructField("transDate", T.TimestampNTZType())])


def closing_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Pulses of no device that :func:`close_log` writes when a log has ended; until then nothing."""
    spark.createDataFrame([], CLOSING).write.mode("ignore").parquet(folder)
    return spark.readStream.schema(CLOSING).option("maxFilesPerTrigger", 1).parquet(folder)


def close_log(spark: SparkSession, folder: str, after: datetime) -> None:
    """Let time pass in a log that gets no more pulses, so that the last silences are noticed.

    Each operator of a chain sees the time that the one before it had in the last batch, so there is a
    batch for each and one more.
    """
    for days in range(1, 4):
        pulse = [("", after + timedelta(days=days))]
        spark.createDataFrame(pulse, CLOSING).coalesce(1).write.mode("append").parquet(folder)


def stream_silences(pulses: DataFrame, minutes: int = SILENCE_MINUTES) -> DataFrame:
    """Notices of each device: offline, online, and for corrections first and late; write it in append mode."""
    return slot_ends(stamped(pulses), minutes).groupBy("deviceCode").transformWithStateInPandas(
        SilenceWatch(minutes), outputStructType=NOTICE, outputMode="Append", timeMode="EventTime"
    )


def corrected_silences(notices: DataFrame, minutes: int = SILENCE_MINUTES) -> DataFrame:
    """device, silent_since, back_at (null while silent): the notices with what late pulses change.

    A late pulse splits the silence in which it falls, or comes before the first pulse known; one in a
    time of pulses changes nothing. Windows see notices and late pulses only, one device at a time.
    """
    points = notices.withColumn("_rank", F.when(F.col("notice") == "late", 0).when(F.col("notice") != "offline", 1).otherwise(2))
    in_order = Window.partitionBy("device").orderBy("at", "_rank")
    marker = F.last(F.when(F.col("notice") != "late", F.col("notice")), ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    silent = points.withColumn("_silent", F.coalesce(marker, F.lit("offline")) == "offline")
    paired = silent.where("_silent or notice in ('first', 'online')").withColumn("back_at", F.lead("at").over(in_order))
    long_enough = F.col("back_at").isNull() | (F.unix_micros("back_at") - F.unix_micros("at") >= minutes * 60_000_000)
    return paired.where(F.col("_silent") & long_enough).select("device", F.col("at").alias("silent_since"), "back_at")


def write_notices(notices: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append notices to a parquet dataset and stop when the input is read."""
    writer = notices.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).format("parquet").option("path", path).start()
