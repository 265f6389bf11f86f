"""Streams over several files against their batch forms, and the batch forms against brute force."""

from __future__ import annotations

import os
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from loupewright.streaming import ledger, live, meters
from tests.util import rows, table

START = datetime(2024, 1, 1)
SCHEMA = "deviceCode string, transDate timestamp_ntz"


def pulses(n=1500, seed=3, days=3):
    rng = random.Random(seed)
    return sorted(
        (f"WT-{rng.choice([5, 5, 5, 5, 6, 7, 9, 10, 11]):02d}", START + timedelta(seconds=rng.randint(0, days * 86400 - 1)))
        for _ in range(n)
    )


def limits(spark, rate=260):
    data = [(f"WT-{n:02d}", 10, rate, f"place {n}", None) for n in range(1, 15)]
    return spark.createDataFrame(data, "deviceCode string, exrate int, rateLimit int, position string, armed_at timestamp_ntz")


def in_files(spark, data, folder, parts):
    """Write the pulses in time order, one file per part, so that the stream reads them one by one."""
    ordered = sorted(data, key=lambda r: r[1])
    step = -(-len(ordered) // parts)
    for i in range(parts):
        chunk = ordered[i * step : (i + 1) * step]
        spark.createDataFrame(chunk, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_limit_alerts_find_the_crossing_pulse(spark):
    data = pulses() + [("WT-05", START + timedelta(hours=30))] * 40  # many pulses at one instant
    got = meters.limit_alerts(spark.createDataFrame(data, SCHEMA), limits(spark))
    want, count = set(), defaultdict(int)
    for device, at in sorted(data, key=lambda r: (r[0], r[1])):
        count[(device, at.date())] += 1
        if count[(device, at.date())] == 26:
            want.add((device, at.date(), at))
    assert {(r.device, r.day, r.reached_at) for r in got.collect()} == want


def test_silences(spark):
    data = pulses(300)
    now = START + timedelta(days=3)
    by_device = defaultdict(list)
    for device, at in data:
        by_device[device].append(at)
    want = set()
    for device, times in by_device.items():
        times.sort()
        for a, b in zip(times, [*times[1:], None]):
            if (b or now) - a >= timedelta(minutes=25):
                want.add((device, a, b))
    got = meters.silences(spark.createDataFrame(data, SCHEMA), now)
    assert {tuple(r) for r in got.collect()} == want


def test_usage_totals_by_year(spark):
    log = table(
        spark, SCHEMA,
        ("WT-05", datetime(2024, 1, 20, 23, 59)), ("WT-05", datetime(2023, 1, 20)), ("WT-05", datetime(2024, 1, 2)), ("WT-06", datetime(2024, 1, 20)),
        ("WT-06", datetime(2024, 1, 20)),
    )
    as_of = datetime(2024, 1, 20).date()
    pick = lambda **k: {r.device: (r.total_month, r.total_day) for r in meters.usage_totals(log, limits(spark), as_of, **k).collect()}
    same, every = pick(), pick(same_year=False)
    assert same["WT-05"] == (20, 10) and every["WT-05"] == (30, 20)
    assert same["WT-13"] == (0, 0) and every["WT-13"] == (10, 0)
    assert same["WT-01"] == (0, 0)


def test_month_matrix_has_all_days_and_clamps(spark):
    log = table(spark, SCHEMA, ("WT-06", datetime(2024, 2, 29, 1)), ("WT-09", datetime(2024, 2, 29, 1)), ("WT-09", datetime(2024, 3, 1)))
    got = {r.day: r for r in meters.month_matrix(log, limits(spark), 2024, 2).collect()}
    assert sorted(got) == list(range(1, 30))
    assert (got[29].v06, got[29].v09, got[29].v13, got[29].v14) == (10, 10, 0, 10)
    assert got[1].v09 == 0


def test_daily_usage_stream_equals_batch(spark, tmp_path):
    data = pulses()
    stream = in_files(spark, data, str(tmp_path / "in"), 4)
    state = totals(spark, stream, tmp_path)
    batch = meters.daily_usage(spark.createDataFrame(data, SCHEMA), limits(spark))
    assert rows(state, "deviceCode", "day", "pulses") == rows(batch, "deviceCode", "day", "pulses")


def totals(spark, stream, folder):
    written = ledger.write_ledger(ledger.day_ledger(stream), str(folder / "out"), str(folder / "cp"))
    written.awaitTermination()
    return ledger.ledger_totals(spark, str(folder / "out"))


def add_file(spark, data, folder):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def test_pulses_forty_days_late_are_corrections_and_nothing_is_lost(spark, tmp_path):
    folder = tmp_path / "in"
    early, later = pulses(400, seed=1, days=2), [(d, at + timedelta(days=60)) for d, at in pulses(400, seed=2, days=40)]
    late = [(d, at + timedelta(days=20)) for d, at in pulses(300, seed=4, days=2)] + [("WT-08", START)] * 5
    for part in (early, later, late, [("WT-05", START + timedelta(days=120))]):
        add_file(spark, part, folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    state = totals(spark, stream, tmp_path)
    data = early + later + late + [("WT-05", START + timedelta(days=120))]
    wanted = sorted(Counter((d, at.date()) for d, at in data).items())
    assert [((r[0], r[1]), r[2]) for r in rows(state, "deviceCode", "day", "pulses")] == wanted
    corrected = ledger.corrections(spark, str(tmp_path / "out"))
    # A meter seen before has closed those days; one never seen (WT-08) has no closed days.
    assert corrected.agg(F.sum("pulses")).first()[0] == len(late) - 5
    assert {r.batch for r in corrected.collect()} == {2}
    # A restart goes on where the last run ended, and counts what is new only.
    add_file(spark, [("WT-05", START), ("WT-05", START + timedelta(days=119))], folder)
    again = {(r.deviceCode, r.day): r.pulses for r in totals(spark, stream, tmp_path).collect()}
    wanted = Counter((d, at.date()) for d, at in [*data, ("WT-05", START), ("WT-05", START + timedelta(days=119))])
    assert again == wanted


def test_state_keeps_the_open_days_only(spark, tmp_path):
    folder = tmp_path / "in"
    for k in range(4):
        add_file(spark, [("WT-01", START + timedelta(days=40 * k + d)) for d in range(3)], folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    assert totals(spark, stream, tmp_path).count() == 12
    state = spark.read.format("statestore").option("stateVarName", "days").load(str(tmp_path / "cp"))
    assert state.count() == 3


def test_a_thirteenth_meter_and_a_third_formula_are_data(spark):
    own = [*meters.FORMULAS, ("WT-20", "WT-21", 3), ("WT-05", "WT-21", -1)]
    formulas = spark.createDataFrame(own, meters.FORMULA)
    more = [(f"WT-{n:02d}", 10, 30, "x", None) for n in (20, 21)]
    known = limits(spark).union(spark.createDataFrame(more, limits(spark).schema))
    log = spark.createDataFrame([("WT-20", START)] * 4 + [("WT-05", START)] * 2 + [("WT-20", START + timedelta(days=1))], SCHEMA)
    matrix = {r.day: r for r in meters.month_matrix(log, known, 2024, 1, formulas).collect()}
    assert (matrix[1].v20, matrix[1].v21, matrix[1].v05, matrix[1].v13, matrix[2].v21, matrix[3].v21) == (40, 100, 20, 20, 30, 0)
    summary = meters.daily_summary(log, known, START + timedelta(days=1), formulas).first()
    assert (summary.v20, summary.v21, summary.v14) == (40, 100, 0)
    total = {r.device: r for r in meters.usage_totals(log, known, START.date(), formulas=formulas).collect()}
    assert (total["WT-21"].total_day, total["WT-21"].total_month) == (100, 130)
    days = {(r.device, r.day.day) for r in meters.derived_limit_days(log, known, formulas).collect()}
    assert days == {("WT-20", 1), ("WT-21", 1), ("WT-21", 2)}
    daily = log.groupBy("deviceCode", F.to_date("transDate").alias("day")).agg(F.count("*").alias("pulses"))
    found = {(r.deviceCode, r.day.day): (r.raw, r.clamped, r.pulses) for r in meters.derived_days(daily, known, formulas).collect()}
    assert found == {("WT-13", 1): (20, 20, 2), ("WT-14", 1): (0, 0, 0), ("WT-21", 1): (100, 100, 10),
                     ("WT-13", 2): (0, 0, 0), ("WT-14", 2): (0, 0, 0), ("WT-21", 2): (30, 30, 3)}


def test_replay_of_many_unsorted_part_files_loses_nothing(spark, tmp_path):
    days = [START + timedelta(days=d) for d in range(0, 200, 2)]
    order = sorted(days, reverse=True) * 22  # the newest pulses are in the oldest files
    folder = tmp_path / "events.parquet"
    folder.mkdir()
    for i, at in enumerate(order):
        one = {"event_id": [i], "ts": [at], "user_id": [4], "event_type": ["x"], "value": [1.0], "props": [""]}
        schema = pa.schema([("event_id", pa.int64()), ("ts", pa.timestamp("us")), ("user_id", pa.int64()), ("event_type", pa.string()),
                            ("value", pa.float64()), ("props", pa.string())])
        part = folder / f"part-{i:05d}.parquet"
        pq.write_table(pa.table(one, schema), part)
        os.utime(part, (10**9 + i, 10**9 + i))
    stream = live.event_stream(spark, str(tmp_path), files_per_batch=700).select(F.lit("WT-05").alias("deviceCode"), F.col("ts").alias("transDate"))
    state = totals(spark, stream, tmp_path)
    assert rows(state, "day", "pulses") == [(d.date(), 22) for d in days]


def edits_in(spark, folder, *edits):
    """Edits of limits, one file each, as a stream that reads them one by one."""
    schema = limits(spark).schema
    for edit in edits:
        spark.createDataFrame(edit, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run_alerts(spark, stream, edits, folder, **options):
    alerts = ledger.alert_stream(stream, edits, meters.formula_table(spark), **options)
    ledger.write_alerts(alerts, str(folder / "out"), str(folder / "cp")).awaitTermination()
    return ledger.read_alerts(spark, str(folder / "out"))


def test_alert_stream_alerts_once_and_rearms(spark, tmp_path):
    data = pulses()
    stream = in_files(spark, data, str(tmp_path / "in"), 5)
    edits = edits_in(spark, tmp_path / "limits", limits(spark).collect())
    alerts = run_alerts(spark, stream, edits, tmp_path)
    found = [(r.deviceCode, r.day) for r in alerts.collect()]
    assert len(found) == len(set(found))
    # A derived meter can drop below its limit again, so only the plain ones must agree with the final counts.
    plain = F.col("device").isin(*meters.METERS)
    final = meters.derived_limit_days(spark.createDataFrame(data, SCHEMA), limits(spark))
    assert {d for d in found if d[0] in meters.METERS} == {tuple(r) for r in final.where(plain).select("device", "day").collect()}
    assert {d for d in found} >= {tuple(r) for r in final.select("device", "day").collect()}
    # A restart repeats nothing; an edited limit is judged at once, without a new pulse, for its day and later ones.
    at = START + timedelta(days=2, hours=23)
    edits_in(spark, tmp_path / "limits", [("WT-05", 10, 100, "place 5", at)], [("WT-05", 10, 90, "older", START)])
    again = run_alerts(spark, stream, edits, tmp_path)
    new = [r for r in again.collect() if r.armed_at is not None]
    assert [(r.deviceCode, r.day, r.armed_at, r.rateLimit) for r in new] == [("WT-05", at.date(), at, 100)]
    assert again.count() == len(found) + 1


def test_an_edit_in_the_middle_of_a_run(spark, tmp_path):
    """Batch 0 has the first limits and pulses, batch 1 an edit, batch 2 more pulses, all of one run."""
    for n in (5, 1, 1):
        add_file(spark, [("WT-01", START + timedelta(hours=k)) for k in range(n)], tmp_path / "in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    first, edit = [("WT-01", 10, 40, "a", None)], [("WT-01", 10, 70, "b", START + timedelta(hours=9))]
    edits = edits_in(spark, tmp_path / "limits", first, edit)
    found = run_alerts(spark, stream, edits, tmp_path).collect()
    assert sorted((r.pulses, r.rateLimit, r.position) for r in found) == [(5, 40, "a"), (7, 70, "b")]


def test_days_leave_the_alert_state(spark, tmp_path):
    for k in (0, 50, 0):
        add_file(spark, [("WT-01", START + timedelta(days=k))] * 3, tmp_path / "in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = run_alerts(spark, stream, edits_in(spark, tmp_path / "limits", [("WT-01", 10, 30, "a", None)]), tmp_path, kept_days=40)
    assert [r.day for r in found.orderBy("day").collect()] == [START.date(), (START + timedelta(days=50)).date()]
    state = spark.read.format("statestore").option("stateVarName", "days").load(str(tmp_path / "cp"))
    assert state.count() == 1


def test_silence_stream_equals_batch(spark, tmp_path):
    data = pulses(400, days=2)
    # A last pulse much later pushes the watermark past everything before it.
    stream = in_files(spark, [*data, ("WT-01", START + timedelta(days=9))], str(tmp_path / "in"), 3)
    live.write_notices(live.stream_silences(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.schema(live.NOTICE).parquet(str(tmp_path / "out")).where("notice <> 'first'")
    want = []
    for r in meters.silences(spark.createDataFrame(data, SCHEMA), START + timedelta(days=8)).collect():
        want.append((r.device, "offline", r.silent_since))
        if r.back_at is not None:
            want.append((r.device, "online", r.back_at))
    found = got.select("device", "notice", F.col("at").cast("timestamp_ntz")).collect()
    assert sorted(tuple(r) for r in found) == sorted(want)


def test_late_pulses_correct_the_silences(spark, tmp_path):
    """Pulses beyond the watermark split a silence, precede the first pulse, or change nothing."""
    at = lambda minutes: START + timedelta(minutes=minutes)
    first = [("WT-01", at(m)) for m in (0, 10, 200, 215, 400)] + [("WT-02", at(300))]
    late = [("WT-01", at(m)) for m in (5, 100, 110, 190, 205)] + [("WT-02", at(m)) for m in (100, 120, 290)]
    for part in (first, [("WT-09", at(3000))], late, [("WT-09", at(9000))]):
        add_file(spark, part, tmp_path / "in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.write_notices(live.stream_silences(stream), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    notices = spark.read.schema(live.NOTICE).parquet(str(tmp_path / "out"))
    assert notices.where("notice = 'late'").count() == len(late)
    found = live.corrected_silences(notices).where("device <> 'WT-09'")
    wanted = meters.silences(spark.createDataFrame(first + late, SCHEMA), at(9000)).select("device", "silent_since", "back_at")
    cast = [F.col("device"), *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("silent_since", "back_at")]]
    assert rows(found.select(*cast)) == rows(wanted)
