"""Day counts and limit alerts as keyed state of a stream; nothing that comes late is lost.

Pulses are counted per (meter, day) inside each task before they are shuffled, so a meter that sends a
third of all pulses costs a few rows per task. The counts of the latest days are kept as state. A pulse
of a day that has left the state goes to the correction rows of the same sink; totals are the last
running total of a day plus its corrections. No watermark is used, so no row is dropped, and files may
be read in any order and in batches of any size.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from datetime import date

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: Days of a meter, up to its newest, whose totals run in the state; pulses of older days are corrections.
OPEN_DAYS = 30
#: Days of a meter, up to its newest, that can alert.
ALERT_DAYS = 40

_EPOCH = date(1970, 1, 1).toordinal()


def day_counts(pulses: DataFrame) -> DataFrame:
    """deviceCode, day (days since 1970), pulses: counts per Arrow batch, without a shuffle.

    Pulses without a meter or a time count nowhere. Works on streams and on tables.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            day = pc.cast(pc.cast(batch.column(1), pa.date32()), pa.int32())
            rows = pa.table({"deviceCode": batch.column(0), "day": day}).drop_null()
            found = rows.group_by(["deviceCode", "day"]).aggregate([([], "count_all")])
            yield from found.rename_columns(["deviceCode", "day", "pulses"]).to_batches()

    times = pulses.select(F.col("deviceCode").cast("string"), F.col("transDate").cast("timestamp_ntz"))
    return times.mapInArrow(counted, "deviceCode string, day int, pulses long")


class DayLedger(StatefulProcessor):
    """Per meter: the counts of its latest days. Gives running totals of days touched, and corrections."""

    def __init__(self, open_days: int = OPEN_DAYS):
        self.open_days = open_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "day int")
        self.days = handle.getMapState("days", "day int", "pulses bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        added: dict[int, int] = defaultdict(int)
        for frame in rows:
            for day, pulses in zip(frame["day"], frame["pulses"]):
                added[int(day)] += int(pulses)
        before = self.newest.get()[0] if self.newest.exists() else None
        newest = max(added) if before is None else max(before, *added)
        closed = min(added) - 1 if before is None else before - self.open_days  # days up to here are closed
        out = []
        for day, pulses in sorted(added.items()):
            if day <= closed:
                out.append((day, pulses, True))
                continue
            total = pulses + (self.days.getValue((day,))[0] if self.days.containsKey((day,)) else 0)
            out.append((day, total, False))
            if day > newest - self.open_days:
                self.days.updateValue((day,), (total,))
        if before is None or newest > before:
            self.newest.update((newest,))
            for (day,) in list(self.days.keys()):
                if day <= newest - self.open_days:
                    self.days.removeKey((day,))
        yield pd.DataFrame({"deviceCode": [key[0]] * len(out), "day": [d for d, _, _ in out],
                            "pulses": [p for _, p, _ in out], "late": [late for _, _, late in out]})

    def close(self) -> None:
        pass


LEDGER = "deviceCode string, day int, pulses long, late boolean"


def day_ledger(pulses: DataFrame, open_days: int = OPEN_DAYS) -> DataFrame:
    """deviceCode, day, pulses, late: running totals, and where ``late`` corrections to closed days.

    A day that is closed and was never seen has corrections only.
    """
    return day_counts(pulses).groupBy("deviceCode").transformWithStateInPandas(
        DayLedger(open_days), outputStructType=LEDGER, outputMode="Update", timeMode="None"
    )


def write_ledger(ledger: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write totals and corrections of each micro-batch to a folder of its own, and stop when the input is read.

    A batch that is run again after a failure overwrites its folder, so nothing is counted twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("late", F.col("late").cast("int")).write.mode("overwrite").partitionBy("late").parquet(f"{path}/batch={number}")

    writer = ledger.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).foreachBatch(write).start()


_STORED = "deviceCode string, day int, pulses long, batch long, late int"


def corrections(spark: SparkSession, path: str) -> DataFrame:
    """deviceCode, day, pulses, batch: what came after its day was closed."""
    rows = spark.read.schema(_STORED).parquet(path).where("late = 1")
    return rows.select("deviceCode", F.date_from_unix_date("day").alias("day"), "pulses", "batch")


def ledger_totals(spark: SparkSession, path: str) -> DataFrame:
    """deviceCode, day, pulses: the last running total of each day and its corrections."""
    rows = spark.read.schema(_STORED).parquet(path)
    late = F.col("late") == 1
    found = rows.groupBy("deviceCode", "day").agg(
        F.coalesce(F.max_by(F.when(~late, F.col("pulses")), F.when(~late, F.col("batch"))), F.lit(0)).alias("_total"),
        F.coalesce(F.sum(F.when(late, F.col("pulses"))), F.lit(0)).alias("_late"),
    )
    return found.select("deviceCode", F.date_from_unix_date("day").alias("day"), (F.col("_total") + F.col("_late")).alias("pulses"))


ALERT = T.StructType(
    [
        T.StructField("deviceCode", T.StringType()),
        T.StructField("day", T.DateType()),
        T.StructField("armed_at", T.TimestampNTZType()),
        T.StructField("pulses", T.LongType()),
        T.StructField("position", T.StringType()),
        T.StructField("rateLimit", T.IntegerType()),
    ]
)
_WATCHED = "deviceCode string, day int, armed_us bigint, pulses bigint, position string, rateLimit int"
#: The limit a meter starts with has no time of edit.
_FIRST = -(1 << 62)


class LimitWatch(StatefulProcessor):
    """Per meter: its limit, and for each day the count and whether its alert was given.

    An edit of the limit arms the day of the edit and later ones again, and is judged at once, also
    without a new pulse. Of several edits the latest counts; an edit that is older than the known one,
    or the same, changes nothing. Days leave the state when a meter's newest day is ``kept_days`` later;
    pulses that come for them after that alert no more. The age is counted in days of the log, not of the
    clock: a replay forgets as the first run did, and a clock would keep a run to the end of its input
    from ever ending.
    """

    def __init__(self, kept_days: int = ALERT_DAYS):
        self.kept_days = kept_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.limit = handle.getValueState("limit", "exrate int, rateLimit int, position string, armed_us bigint")
        self.newest = handle.getValueState("newest", "day int")
        self.days = handle.getMapState("days", "day int", "pulses bigint, alerted boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        added: dict[int, int] = defaultdict(int)
        limit = self.limit.get() if self.limit.exists() else None
        known = limit[3] if limit else None
        for frame in rows:
            edits = frame[frame["edit"]]
            for exrate, rate_limit, position, armed in zip(edits["exrate"], edits["rateLimit"], edits["position"], edits["armed_us"]):
                if limit is None or armed > limit[3]:
                    limit = (int(exrate), int(rate_limit), position, int(armed))
            counts = frame[~frame["edit"]]
            for day, pulses in zip(counts["day"], counts["pulses"]):
                added[int(day)] += int(pulses)
        before = self.newest.get()[0] if self.newest.exists() else None
        if before is not None:
            added = {day: pulses for day, pulses in added.items() if day > before - self.kept_days}
        judged = set(added)
        armed_day = None
        if limit is not None and limit[3] != known:
            self.limit.update(limit)
            armed_day = limit[3] // 86_400_000_000
            judged |= {day for (day,) in self.days.keys() if day >= armed_day}
        out = []
        for day in sorted(judged):
            pulses, alerted = self.days.getValue((day,)) if self.days.containsKey((day,)) else (0, False)
            pulses, told = pulses + added.get(day, 0), alerted
            alerted = alerted and not (armed_day is not None and day >= armed_day)
            if limit is not None and not alerted and pulses * limit[0] >= limit[1]:
                out.append((day, pulses))
                alerted = True
            if day in added or alerted != told:
                self.days.updateValue((day,), (pulses, alerted))
        newest = max([before, *added] if before is not None else added, default=None)
        if newest != before:
            self.newest.update((newest,))
            for (day,) in list(self.days.keys()):
                if day <= newest - self.kept_days:
                    self.days.removeKey((day,))
        if out:
            yield pd.DataFrame({"deviceCode": [key[0]] * len(out), "day": [d for d, _ in out], "armed_us": [limit[3]] * len(out),
                                "pulses": [p for _, p in out], "position": [limit[2]] * len(out), "rateLimit": [limit[1]] * len(out)})

    def close(self) -> None:
        pass


def alert_stream(pulses: DataFrame, edits: DataFrame, formulas: DataFrame, kept_days: int = ALERT_DAYS) -> DataFrame:
    """Alerts (as :data:`ALERT`) of meters, also derived ones, whose count of a day reaches the limit.

    ``edits`` is a stream of limits: deviceCode, exrate, rateLimit, position, armed_at (time of the edit,
    null for the first). ``formulas`` is a table (meter, deviceCode, factor) of derived meters; each meter
    counts for itself besides. Each meter and day alerts once, until an edit arms it again.
    """
    counts = day_counts(pulses)
    derived = counts.withColumnRenamed("deviceCode", "meter").join(formulas, "meter")
    shares = derived.select("deviceCode", "day", (F.col("pulses") * F.col("factor")).cast("bigint").alias("pulses")).union(counts)
    nothing = lambda kind: F.lit(None).cast(kind)
    armed = F.coalesce(F.unix_micros(F.col("armed_at").cast("timestamp")), F.lit(_FIRST))
    counted = shares.select(
        "deviceCode", "day", "pulses", F.lit(0).alias("exrate"), F.lit(0).alias("rateLimit"), nothing("string").alias("position"),
        F.lit(0).cast("bigint").alias("armed_us"), F.lit(False).alias("edit"),
    )
    edited = edits.select(
        "deviceCode", F.lit(0).alias("day"), F.lit(0).cast("bigint").alias("pulses"), F.col("exrate").cast("int"), F.col("rateLimit").cast("int"),
        F.col("position").cast("string"), armed.alias("armed_us"), F.lit(True).alias("edit"),
    )
    found = counted.union(edited).groupBy("deviceCode").transformWithStateInPandas(
        LimitWatch(kept_days), outputStructType=_WATCHED, outputMode="Update", timeMode="None"
    )
    at = F.when(F.col("armed_us") != _FIRST, F.timestamp_micros("armed_us")).cast("timestamp_ntz")
    return found.select("deviceCode", F.date_from_unix_date("day").alias("day"), at.alias("armed_at"), "pulses", "position", "rateLimit")


def write_alerts(alerts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write each micro-batch of alerts to its own folder; earlier ones are never read."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = alerts.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).foreachBatch(write).start()


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ALERT).parquet(path)
