"""Meter jobs on the driver's event table, batch and streaming."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import functions as F

from loupewright.catalog.registry import METER_NOW, NOW, query
from loupewright.sources.session import shared_folder
from loupewright.streaming import ledger, live, meters

_DAILY = """select deviceCode as device, day, n as pulses, cast(n * exrate as bigint) as litres from (
    select l.deviceCode, cast(l.transDate as date) as day, w.exrate, count(*) as n from $water_log l
    join $water_limit w on l.deviceCode = w.deviceCode group by 1, 2, 3) a"""


@query("daily_usage", _DAILY)
def daily_usage(t):
    return meters.daily_usage(t.water_log, t.water_limit).withColumnRenamed("deviceCode", "device")


def _pulses(t, files_per_batch=None):
    """The pulse log as a stream over the event files."""
    events = live.event_stream(t.spark, t.folder, files_per_batch=files_per_batch)
    code = F.concat(F.lit("WT-"), F.lpad((F.col("user_id") % 12 + 1).cast("string"), 2, "0"))
    return events.select(code.alias("deviceCode"), F.col("ts").alias("transDate"))


def _run_folder(t):
    return f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"


@contextmanager
def _state_store(t):
    """Keyed state needs the state store that knows several states for a key."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(key)
    t.spark.conf.set(key, live.STATE_STORE)
    try:
        yield
    finally:
        t.spark.conf.set(key, before)


#: Part files of the event table that one batch of a replay reads.
FILES = 1000


def _ledger(t):
    """deviceCode, day, pulses, from a stream that has run to the end of its input."""
    folder = _run_folder(t)
    with _state_store(t):
        ledger.write_ledger(ledger.day_ledger(_pulses(t, FILES)), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return ledger.ledger_totals(t.spark, f"{folder}/out")


@query("stream_daily_usage", _DAILY)
def stream_daily_usage(t):
    """Running totals and corrections of the stream, read back and added up."""
    counted = _ledger(t).join(t.water_limit.select("deviceCode", "exrate"), "deviceCode")
    return counted.select(F.col("deviceCode").alias("device"), "day", "pulses", (F.col("pulses") * F.col("exrate")).alias("litres"))


_COLUMNS = {code: f"v{code[-2:]}" for code in meters.METERS}
_WIDE = "select cast(transDate as date) as day, " + ", ".join(
    f"count(case when deviceCode = '{c}' then 1 end) as {n}" for c, n in _COLUMNS.items()
)
_WIDE += " from $water_log group by 1"
_RAW_13, _RAW_14 = "v05 - v06 - v07", "v09 + v10 - v11"


@query(
    "stream_derived_meters",
    f"""select day, 10 * ({_RAW_13}) as raw13, 10 * ({_RAW_14}) as raw14, greatest(10 * ({_RAW_13}), 0) as clamped13,
      greatest(10 * ({_RAW_14}), 0) as clamped14, {_RAW_13} as pulses13, {_RAW_14} as pulses14 from ({_WIDE}) a""",
)
def derived(t):
    """The three definitions of the derived meters over the day counts of a stream."""
    found = meters.derived_days(_ledger(t), t.water_limit, meters.formula_table(t.spark))
    kinds = ("raw", "clamped", "pulses")
    shown = [F.max(F.when(F.col("deviceCode") == code, F.col(kind))).alias(f"{kind}{code[-2:]}") for kind in kinds for code in meters.PLUS_MINUS]
    return found.groupBy("day").agg(*shown)


_LIMIT_DAYS = f"""select c.device, c.day, cast(c.n as bigint) as pulses, w.rateLimit as rate_limit from (
    select day, unnest(['WT-01', 'WT-02', 'WT-03', 'WT-04', 'WT-05', 'WT-06', 'WT-07', 'WT-08', 'WT-09', 'WT-10', 'WT-11', 'WT-12', 'WT-13', 'WT-14']) as device,
      unnest([v01, v02, v03, v04, v05, v06, v07, v08, v09, v10, v11, v12, {_RAW_13}, {_RAW_14}]) as n from ({_WIDE}) x) c
    join $water_limit w on c.device = w.deviceCode where c.n * w.exrate >= w.rateLimit"""


@query("stream_threshold_alert", _LIMIT_DAYS)
def threshold_alert(t):
    """Alerts written by the stream, read back from its sink. The limits come in as a second stream."""
    folder = _run_folder(t)
    t.water_limit.withColumn("armed_at", F.lit(None).cast("timestamp_ntz")).write.parquet(f"{folder}/limits")
    edits = t.spark.readStream.schema(t.spark.read.parquet(f"{folder}/limits").schema).parquet(f"{folder}/limits")
    with _state_store(t):
        alerts = ledger.alert_stream(_pulses(t), edits, meters.formula_table(t.spark))
        ledger.write_alerts(alerts, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    alerts = ledger.read_alerts(t.spark, f"{folder}/out")
    return alerts.select(F.col("deviceCode").alias("device"), "day", "pulses", F.col("rateLimit").alias("rate_limit"))


@query("threshold_alert_days", _LIMIT_DAYS)
def limit_days(t):
    return meters.derived_limit_days(t.water_log, t.water_limit)


@query(
    "threshold_alert_batch",
    """select device, day, reached_at, position, rate_limit from (
      select l.deviceCode as device, cast(l.transDate as date) as day, l.transDate as reached_at, w.position, w.rateLimit as rate_limit, w.exrate,
        row_number() over (partition by l.deviceCode, cast(l.transDate as date) order by l.transDate) as n
      from $water_log l join $water_limit w on l.deviceCode = w.deviceCode) a
    where n * exrate >= rate_limit and (n - 1) * exrate < rate_limit""",
)
def limit_alerts(t):
    return meters.limit_alerts(t.water_log, t.water_limit)


_GAPS = f"""select device, pulse as silent_since, following as back_at from (select deviceCode as device, transDate as pulse,
      lead(transDate) over (partition by deviceCode order by transDate) as following from $water_log where transDate <= {NOW}) a
    where coalesce(following, {NOW}) - interval 25 minute >= pulse"""


@query("offline_device_batch", _GAPS)
def silences(t):
    return meters.silences(t.water_log, METER_NOW)


_FOLLOWED = """(select deviceCode as device, transDate as pulse,
        lead(transDate) over (partition by deviceCode order by transDate) as following from $water_log) a"""


@query(
    "stream_offline_device",
    f"""select device, 'offline' as notice, pulse as noticed_at from {_FOLLOWED}
      where following is null or following - interval 25 minute >= pulse
    union all select device, 'online', following from {_FOLLOWED} where following - interval 25 minute >= pulse""",
)
def offline(t):
    """All notices of the stateful stream: it reads the log, and then the passing of time after its end."""
    folder = _run_folder(t)
    with _state_store(t):
        pulses = _pulses(t).unionByName(live.closing_stream(t.spark, f"{folder}/closing"))
        for ended in (False, True):
            if ended:
                live.close_log(t.spark, f"{folder}/closing", datetime(2100, 1, 1))
            live.write_notices(live.stream_silences(pulses), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    notices = t.spark.read.schema(live.NOTICE).parquet(f"{folder}/out").where("device <> '' and notice in ('offline', 'online')")
    return notices.select("device", "notice", F.col("at").cast("timestamp_ntz").alias("noticed_at"))


@query(
    "monthly_usage_matrix",
    "select cast(d as int) as day, "
    + ", ".join(f"cast(coalesce({n}, 0) * 10 as bigint) as {n}" for n in _COLUMNS.values())
    + f""", cast(greatest(coalesce({_RAW_13}, 0) * 10, 0) as bigint) as v13, cast(greatest(coalesce({_RAW_14}, 0) * 10, 0) as bigint) as v14
    from generate_series(1, 31) g(d) left join ({_WIDE}) w on day(w.day) = d and year(w.day) = 2024 and month(w.day) = 1""",
)
def month_matrix(t):
    return meters.month_matrix(t.water_log, t.water_limit, 2024, 1)


def _totals(day: str, month: str) -> str:
    count = "(select count(*) from $water_log l where {p} and l.deviceCode = {d})"

    def pulses(p: str) -> str:
        one = lambda d: count.format(p=p, d=d)
        return (
            f"case w.deviceCode when 'WT-13' then {one(chr(39) + 'WT-05' + chr(39))} - {one(chr(39) + 'WT-06' + chr(39))} - {one(chr(39) + 'WT-07' + chr(39))} "
            f"when 'WT-14' then {one(chr(39) + 'WT-09' + chr(39))} + {one(chr(39) + 'WT-10' + chr(39))} - {one(chr(39) + 'WT-11' + chr(39))} "
            f"else {one('w.deviceCode')} end"
        )

    return f"""select device, exrate, rate_limit, position, cast(case when m < 0 then 0 else m * exrate end as bigint) as total_month,
      cast(case when d < 0 then 0 else d * exrate end as bigint) as total_day, last_seen
    from (select w.deviceCode as device, w.exrate, w.rateLimit as rate_limit, w.position, {pulses(month)} as m, {pulses(day)} as d,
      (select cast(max(l.transDate) as date) from $water_log l where l.deviceCode = w.deviceCode) as last_seen from $water_limit w) a"""


@query(
    "usage_day_month",
    _totals("cast(l.transDate as date) = date '2024-01-20'", "year(l.transDate) = 2024 and month(l.transDate) = 1"),
)
def usage_totals(t):
    return meters.usage_totals(t.water_log, t.water_limit, METER_NOW.date())


@query("usage_day_month_all_years", _totals("dayofyear(l.transDate) = 20", "month(l.transDate) = 1"))
def usage_totals_all_years(t):
    return meters.usage_totals(t.water_log, t.water_limit, METER_NOW.date(), same_year=False)


@query(
    "daily_summary_row",
    "select '19/01/2024' as day, "
    + ", ".join(f"cast(coalesce(sum(case when deviceCode = '{c}' then 10 end), 0) as bigint) as {n}" for c, n in _COLUMNS.items())
    + """, cast(coalesce(sum(case when deviceCode = 'WT-05' then 10 when deviceCode in ('WT-06', 'WT-07') then -10 end), 0) as bigint) as v13,
      cast(coalesce(sum(case when deviceCode in ('WT-09', 'WT-10') then 10 when deviceCode = 'WT-11' then -10 end), 0) as bigint) as v14
    from $water_log where cast(transDate as date) = date '2024-01-19'""",
)
def daily_summary(t):
    return meters.daily_summary(t.water_log, t.water_limit, METER_NOW)
