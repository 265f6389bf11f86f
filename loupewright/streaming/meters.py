"""Meter usage, limit alerts and silence, as batch jobs over the pulse log.

The log has one row per pulse. Devices are few and may each hold a large part of the log, so every
job first counts pulses per (device, day) or (device, short slot); windows only see those counts.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loupewright.functions.dates import moment, month_start
from loupewright.functions.numbers import clamp_at_zero
from loupewright.operators.aggregates import count_where, pivot_zero
from loupewright.operators.filters import date_between
from loupewright.operators.generators import day_series
from loupewright.operators.joins import left_default

# Meter codes, and which meters make up the two derived ones.
METERS = tuple(f"WT-{n:02d}" for n in range(1, 13))
PLUS_MINUS = {
    "WT-13": (("WT-05",), ("WT-06", "WT-07")),
    "WT-14": (("WT-09", "WT-10"), ("WT-11",)),
}
SILENCE_MINUTES = 25

#: The same as rows (meter, derived meter, factor).
FORMULAS = [(m, code, f) for code, (plus, minus) in PLUS_MINUS.items() for f, some in ((1, plus), (-1, minus)) for m in some]
FORMULA = "meter string, deviceCode string, factor int"


def formula_table(spark: SparkSession) -> DataFrame:
    """The derived meters of the factory. Any table of these columns serves: more meters, other factors."""
    return spark.createDataFrame(FORMULAS, FORMULA)


def with_targets(usage: DataFrame, formulas: DataFrame, *values: str) -> DataFrame:
    """Add the rows of derived meters: the sums of their meters' values times the factors.

    ``usage`` has deviceCode, the values, and other columns as keys, each key once. A derived meter gets
    a row where any of its meters has one; rows that ``usage`` has for it are left out.
    """
    keys = [c for c in usage.columns if c not in values and c != "deviceCode"]
    shares = usage.withColumnRenamed("deviceCode", "meter").join(formulas, "meter")
    derived = shares.groupBy("deviceCode", *keys).agg(*[F.sum(F.col(v) * F.col("factor")).alias(v) for v in values])
    own = usage.join(formulas.select("deviceCode").distinct(), "deviceCode", "left_anti")
    return own.select(*usage.columns).union(derived.select(*usage.columns))


def meter_columns(limits: DataFrame, formulas: DataFrame) -> tuple[dict[str, str], dict[str, str]]:
    """Column names by code, of the plain and of the derived meters. Meters are few: one row and column each."""
    tagged = limits.select("deviceCode", F.lit(False).alias("d")).union(formulas.select("meter", F.lit(False))).union(formulas.select("deviceCode", F.lit(True)))
    found = tagged.groupBy("deviceCode").agg(F.max("d").alias("d")).collect()
    derived, codes = {r.deviceCode for r in found if r.d}, sorted(r.deviceCode for r in found)
    name = lambda code: f"v{code.rsplit('-', 1)[-1]}"
    return {c: name(c) for c in codes if c not in derived}, {c: name(c) for c in codes if c in derived}


def daily_usage(log: DataFrame, limits: DataFrame) -> DataFrame:
    """Litres per device and day: pulses times the device's rate."""
    counted = log.groupBy("deviceCode", F.to_date("transDate").alias("day")).agg(F.count(F.lit(1)).alias("pulses"))
    rates = limits.select("deviceCode", "exrate")
    return counted.join(rates, "deviceCode").withColumn("litres", F.col("pulses") * F.col("exrate")).drop("exrate")


def wide_usage(usage: DataFrame, limits: DataFrame, formulas: DataFrame, keys: list[str], value: str, clamped: bool) -> DataFrame:
    """One column per meter, plain and derived, 0 for gaps; derived ones raw, or with negative values as 0."""
    plain, derived = meter_columns(limits, formulas)
    finish = clamp_at_zero if clamped else (lambda c: c)
    wide = pivot_zero(with_targets(usage, formulas, value), keys, "deviceCode", {**plain, **derived}, value)
    return wide.select(*keys, *plain.values(), *[finish(F.col(c)).alias(c) for c in derived.values()])


def month_matrix(log: DataFrame, limits: DataFrame, year: int, month: int, formulas: DataFrame | None = None) -> DataFrame:
    """Day of month by meter in litres, all days and all derived meters, which are not below 0."""
    formulas = formula_table(log.sparkSession) if formulas is None else formulas
    first = month_start(year, month)
    last = date(year + month // 12, month % 12 + 1, 1)
    stamp = F.col("transDate")
    rows = log.where((stamp >= moment(first).cast("timestamp_ntz")) & (stamp < moment(last).cast("timestamp_ntz")))
    usage = daily_usage(rows, limits).withColumn("day", F.day("day")).drop("pulses")
    wide = wide_usage(usage, limits, formulas, ["day"], "litres", clamped=True)
    days = day_series(log.sparkSession, year, month)
    return left_default(days, wide, ["day"], {c: 0 for c in wide.columns if c != "day"})


def daily_summary(log: DataFrame, limits: DataFrame, as_of: datetime, formulas: DataFrame | None = None) -> DataFrame:
    """One row with the usage of every meter on the day before, derived meters not clamped."""
    formulas = formula_table(log.sparkSession) if formulas is None else formulas
    yesterday = date.fromordinal(as_of.date().toordinal() - 1)
    usage = daily_usage(log.where(date_between(F.col("transDate"), yesterday, yesterday)), limits).drop("day", "pulses")
    shown = F.date_format(F.lit(yesterday), "dd/MM/yyyy").alias("day")
    return wide_usage(usage, limits, formulas, [], "litres", clamped=False).select(shown, "*")


def usage_totals(
    log: DataFrame, limits: DataFrame, as_of: date, same_year: bool = True, formulas: DataFrame | None = None
) -> DataFrame:
    """Each meter's usage of the day and the month, and when it was last seen.

    Derived meters are differences of pulse counts times their own rate, not below 0. With
    ``same_year`` off, the day of the year and the month of all years are added up.
    """
    formulas = formula_table(log.sparkSession) if formulas is None else formulas
    stamp = F.col("transDate")
    if same_year:
        in_day = date_between(stamp, as_of, as_of)
        following = date(as_of.year + as_of.month // 12, as_of.month % 12 + 1, 1)
        in_month = (stamp >= moment(as_of.replace(day=1)).cast("timestamp_ntz")) & (stamp < moment(following).cast("timestamp_ntz"))
    else:
        in_day = F.dayofyear(stamp) == as_of.timetuple().tm_yday
        in_month = F.month(stamp) == as_of.month
    totals = log.groupBy("deviceCode").agg(count_where(in_day).alias("day_pulses"), count_where(in_month).alias("month_pulses"))
    seen = log.groupBy("deviceCode").agg(F.max(stamp).alias("last_seen"))
    combined = with_targets(totals, formulas, "day_pulses", "month_pulses").join(seen, "deviceCode", "left")
    rows = left_default(limits, combined, ["deviceCode"], {"day_pulses": 0, "month_pulses": 0})
    litres = lambda c: clamp_at_zero(F.col(c)) * F.col("exrate")
    return rows.select(
        F.col("deviceCode").alias("device"),
        "exrate",
        F.col("rateLimit").alias("rate_limit"),
        "position",
        litres("month_pulses").alias("total_month"),
        litres("day_pulses").alias("total_day"),
        F.to_date("last_seen").alias("last_seen"),
    )


def limit_alerts(log: DataFrame, limits: DataFrame) -> DataFrame:
    """The pulse with which a device reached its daily limit, at most one per device and day.

    Pulses are counted per minute; a running total over at most 1,440 minutes finds the minute of the
    crossing, and only the pulses of that minute are put in order to find the one.
    """
    need = F.greatest(F.ceil(F.col("rateLimit") / F.col("exrate")), F.lit(1))
    needed = limits.where(F.col("exrate") > 0).select("deviceCode", "position", "rateLimit", need.alias("_need"))
    minute = F.date_trunc("minute", F.col("transDate"))
    slots = log.groupBy("deviceCode", minute.alias("_minute")).agg(F.count(F.lit(1)).alias("_n"))
    day = Window.partitionBy("deviceCode", F.to_date("_minute")).orderBy("_minute")
    before = F.coalesce(F.sum("_n").over(day.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    crossing = (
        slots.withColumn("_before", before)
        .join(needed, "deviceCode")
        .where((F.col("_before") < F.col("_need")) & (F.col("_before") + F.col("_n") >= F.col("_need")))
    )
    inside = (
        log.withColumn("_minute", minute)
        .join(crossing, ["deviceCode", "_minute"])
        .groupBy("deviceCode", "_minute", "transDate", "position", "rateLimit", "_before", "_need")
        .agg(F.count(F.lit(1)).alias("_at"))
    )
    upto = Window.partitionBy("deviceCode", "_minute").orderBy("transDate").rowsBetween(Window.unboundedPreceding, 0)
    reached = inside.withColumn("_total", F.col("_before") + F.sum("_at").over(upto))
    first = (F.col("_total") >= F.col("_need")) & (F.col("_total") - F.col("_at") < F.col("_need"))
    return reached.where(first).select(
        F.col("deviceCode").alias("device"),
        F.to_date("transDate").alias("day"),
        F.col("transDate").alias("reached_at"),
        "position",
        F.col("rateLimit").alias("rate_limit"),
    )


def derived_limit_days(log: DataFrame, limits: DataFrame, formulas: DataFrame | None = None) -> DataFrame:
    """Days on which a meter, also a derived one, reached its limit."""
    formulas = formula_table(log.sparkSession) if formulas is None else formulas
    daily = log.groupBy("deviceCode", F.to_date("transDate").alias("day")).agg(F.count(F.lit(1)).alias("pulses"))
    rows = with_targets(daily, formulas, "pulses").join(limits, "deviceCode").where(F.col("pulses") * F.col("exrate") >= F.col("rateLimit"))
    return rows.select(F.col("deviceCode").alias("device"), "day", "pulses", F.col("rateLimit").alias("rate_limit"))


def derived_days(daily: DataFrame, limits: DataFrame, formulas: DataFrame) -> DataFrame:
    """deviceCode, day, raw, clamped (litres by the meters' own rates), pulses: each derived meter by day.

    ``daily`` has deviceCode, day and pulses. A day on which any meter sent pulses has a row for each.
    """
    litres = daily.join(limits.select("deviceCode", "exrate"), "deviceCode").withColumn("litres", F.col("pulses") * F.col("exrate"))
    derived = with_targets(litres.drop("exrate"), formulas, "pulses", "litres")
    codes = F.array_sort(F.collect_set("deviceCode")).alias("_codes")
    every = daily.select("day").distinct().join(F.broadcast(formulas.agg(codes)), how="cross").select("day", F.explode("_codes").alias("deviceCode"))
    filled = left_default(every, derived, ["deviceCode", "day"], {"pulses": 0, "litres": 0})
    return filled.select("deviceCode", "day", F.col("litres").alias("raw"), clamp_at_zero(F.col("litres")).alias("clamped"), "pulses")


def silences(log: DataFrame, as_of: datetime, minutes: int = SILENCE_MINUTES) -> DataFrame:
    """Times a device was silent for at least ``minutes``; still silent at ``as_of`` when ``back_at`` is NULL.

    Two pulses in one slot of that length are closer than it, so only the first and last pulse of each
    slot matter: a window over slots sees at most one row per slot, however many pulses there are.
    """
    slot = F.window("transDate", f"{minutes} minutes")
    slots = log.where(F.col("transDate") <= moment(as_of)).groupBy("deviceCode", slot.alias("_slot"))
    ends = slots.agg(F.min("transDate").alias("_first"), F.max("transDate").alias("_last"))
    following = F.lead("_first").over(Window.partitionBy("deviceCode").orderBy("_first"))
    gap = F.expr(f"INTERVAL '{int(minutes)}' MINUTE")
    rows = ends.withColumn("back_at", following)
    return rows.where(F.coalesce(F.col("back_at"), moment(as_of)) - gap >= F.col("_last")).select(
        F.col("deviceCode").alias("device"), F.col("_last").alias("silent_since"), "back_at"
    )
