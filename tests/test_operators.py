"""Operators against brute force in plain Python, also on one key that holds most rows."""

from __future__ import annotations

import random
from collections import defaultdict
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loupewright.operators import aggregates, allocation, changes, generators, joins, nesting, ranked, sorting
from loupewright.operators.bundle import report_bundle
from loupewright.operators.ranked import Descending, number_rows, running_total
from loupewright.sources import session, sinks
from tests.util import rows, table


def skewed(n=3000, seed=1):
    """Rows (key, order, value) of which most have one key; keys may be NULL."""
    rng = random.Random(seed)
    data = []
    for i in range(n):
        key = "hot" if rng.random() < 0.7 else rng.choice(["a", "b", "c", None])
        data.append((key, i * 7919 % n, rng.randint(0, 9)))
    return data


def test_running_total_and_row_number_on_a_hot_key(spark):
    data = skewed()
    want, count, total = {}, defaultdict(int), defaultdict(int)
    for key, order, value in sorted(data, key=lambda r: r[1]):
        count[key] += 1
        total[key] += value
        want[(key, order)] = (count[key], total[key])
    df = spark.createDataFrame(data, "k string, o bigint, v bigint").repartition(5)
    numbered = number_rows(df, ["k"], ["o"], "n", slices=7)
    both = running_total(numbered, ["k"], ["o"], "v", "t", slices=3)
    got = {(r.k, r.o): (r.n, r.t) for r in both.collect()}
    assert got == want


def test_row_number_without_key_and_descending(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 10).alias("g"))
    got = {r.id: r.n for r in number_rows(df, [], ["g", Descending("id")], "n", slices=6).collect()}
    order = sorted(range(1000), key=lambda i: (i % 10, -i))
    assert got == {i: n + 1 for n, i in enumerate(order)}


@pytest.mark.parametrize("kind", ["bigint", "double", "string", "date", "timestamp_ntz", "boolean", "decimal(10,2)"])
def test_falling_orders_of_every_type_and_nulls(spark, kind):
    values = {"boolean": ["true", "false"], "date": ["1969-12-31", "2024-02-29", "2024-03-01"], "timestamp_ntz": ["1960-01-01 01:02:03", "2024-01-01"],
              "string": ["", "a", "ab", "abc", "b", "ñ", "Z"], "bigint": ["-9223372036854775808", "-5", "0", "7", "9223372036854775807"]}
    some = values.get(kind, ["-3.5", "0", "2.25", "100"])
    df = spark.createDataFrame([(v, i) for i, v in enumerate([*some, None] * 40)], "v string, i int").withColumn("v", F.col("v").cast(kind))
    order = Window.orderBy(F.col("v").desc(), "i")
    wanted = rows(df.withColumn("n", F.row_number().over(order).cast("bigint")), "i", "n")
    assert rows(number_rows(df, [], [Descending("v"), "i"], "n", slices=9), "i", "n") == wanted


def test_numbering_runs_no_job_before_it_is_asked_for_and_spreads_a_hot_key(spark):
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("numbering"))
    df = spark.range(40_000).select(F.lit("hot").alias("k"), "id")
    spark.sparkContext.setJobGroup("numbering", "no job while the plan is built")
    try:
        frame = number_rows(df, ["k"], ["id"], "n", slices=16)
        assert jobs() == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert frame.where("n <> id + 1").count() == 0 and frame.count() == 40_000
    sizes = [r["count"] for r in ranked._sliced(df, ["k"], ["id"], 16).groupBy("_slice").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 40_000 / 16


def test_numbering_of_few_rows_and_none(spark):
    df = spark.range(3).select(F.lit(None).cast("string").alias("k"), "id")
    assert rows(number_rows(df, ["k"], [Descending("id")], "n", slices=50), "id", "n") == [(0, 3), (1, 2), (2, 1)]
    assert number_rows(df.limit(0), ["k"], ["id"], "n", slices=50).count() == 0
    assert rows(number_rows(df, ["k"], ["id"], "n", slices=1), "n") == [(1,), (2,), (3,)]


def fifo_by_hand(receipts, lines):
    left = defaultdict(int)
    for key, q in receipts:
        left[key] += q
    given = {}
    for key, order, need, got in sorted(lines):
        take = min(max(need - got, 0), left[key])
        left[key] -= take
        given[(key, order)] = take
    return given, {k: v for k, v in left.items() if v > 0}


@pytest.mark.parametrize("seed", range(4))
def test_fifo_allocate(spark, seed):
    rng = random.Random(seed)
    lines = [(rng.choice("hhhhhab"), i, rng.randint(0, 8), rng.randint(0, 5)) for i in range(400)]
    receipts = [(rng.choice("habz"), rng.randint(0, 600)) for _ in range(5)]
    given, rest = fifo_by_hand(receipts, lines)
    out = allocation.fifo_allocate(
        spark.createDataFrame(receipts, "k string, received bigint"),
        spark.createDataFrame(lines, "k string, o bigint, qty_req bigint, qty_to_fact bigint"),
        ["k"], ["o"],
    )
    got = {(r.k, r.o): r for r in out["lines"].collect()}
    assert {k: r.allocated for k, r in got.items()} == given
    assert all(r.new_delivered == r.qty_to_fact + r.allocated and r.new_balance == r.qty_req - r.new_delivered for r in got.values())
    assert {r.k: r.rest for r in out["rest"].collect()} == rest
    assert out["history"].count() == sum(1 for v in given.values() if v > 0)
    total = {k: sum(q for key, q in receipts if key == k) for k in "habz"}
    used = {k: sum(v for (key, _), v in given.items() if key == k) for k in "habz"}
    assert all(used[k] + rest.get(k, 0) == total[k] for k in "habz")


def test_count_between_both_directions(spark):
    holidays = [date(2024, 1, 1) + timedelta(days=7 * i) for i in range(20)]
    days = table(spark, "d date", *[(h,) for h in holidays])
    cumulative = joins.cumulative_days(days, "d")
    as_of = date(2024, 2, 5)
    dues = [as_of + timedelta(days=k) for k in (-9999, -40, -7, -1, 0, 1, 7, 30, 9999)]
    df = table(spark, "due date", *[(d,) for d in dues])
    got = {r.due: r.n for r in joins.count_between(df, cumulative, F.lit(as_of), F.col("due"), "n").collect()}
    assert got == {d: sum(min(d, as_of) <= h <= max(d, as_of) for h in holidays) for d in dues}


def test_cum_upto_counts_ties_and_missing_keys(spark):
    day = lambda n: date(2024, 1, n)
    targets = table(spark, "k string, d date, id int", ("a", day(3), 1), ("a", day(3), 2), ("a", day(9), 3), ("b", day(1), 4))
    facts = table(spark, "k string, f date, v bigint", ("a", day(1), 5), ("a", day(3), 2), ("a", day(4), 1), ("c", day(1), 9))
    got = joins.cum_upto(targets, "k", "d", {"t": (facts, "f", "v"), "u": (facts.where("v > 1"), "f", "v")})
    assert rows(got, "id", "t", "u") == [(1, 7, 7), (2, 7, 7), (3, 8, 7), (4, 0, 0)]


def test_densify_and_latest_and_first(spark):
    left = table(spark, "k string", ("a",), ("b",))
    facts = table(spark, "k string, c string, q bigint", ("a", "01", 2), ("a", "01", 3), ("b", "99", 7))
    got = joins.densify(left, table(spark, "c string", ("01",), ("02",)), "c", facts, ["k"], ["q"])
    assert rows(got, "k", "c", "q") == [("a", "01", 5), ("a", "02", 0), ("b", "01", 0), ("b", "02", 0)]
    revisions = table(spark, "k string, rev int, x int", ("a", 1, 1), ("a", 2, 2), ("a", 2, 3), ("b", 1, 4))
    assert rows(joins.latest(revisions, ["k"], "rev"), "x") == [(2,), (3,), (4,)]
    first = joins.lookup_first(left, revisions, ["k"], "x", ["rev", "x"], "first")
    assert rows(first, "k", "first") == [("a", 1), ("b", 4)]


def test_nest_gives_one_row_per_parent_of_any_size(spark):
    children = [("big", i) for i in range(2500)] + [("equal", 7)] * 9 + [("small", 1)]
    parent = table(spark, "k string", ("big",), ("equal",), ("small",), ("none",))
    child = spark.createDataFrame(children, "k string, v bigint").repartition(7)
    got = nesting.nest(parent, child, ["k"], ["v"], "items")
    assert got.columns == ["k", "items"]
    found = {r.k: [e.v for e in r["items"]] for r in got.collect()}
    assert found == {"big": list(range(2500)), "equal": [7] * 9, "small": [1], "none": []}
    assert got.count() == 4
    ordinals = sorted((r.k, r.ordinal, r.v) for r in nesting.long_form(child, ["k"], ["v"]).collect())
    assert ordinals == sorted((k, i + 1, v) for k in found for i, v in enumerate(found[k]))


def test_nest_reads_each_child_once(spark, tmp_path):
    spark.range(50).selectExpr("id % 5 as k", "id as v").write.parquet(str(tmp_path / "child"))
    child = spark.read.parquet(str(tmp_path / "child"))
    nested = nesting.nest(spark.range(5).toDF("k"), child, ["k"], ["v"], "items")
    assert nested._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_nest_many_gives_each_child_its_array(spark):
    parent = table(spark, "k int", (1,), (2,))
    a = spark.createDataFrame([(1, i) for i in range(30)], "k int, v int")
    b = spark.createDataFrame([(1, 5), (2, 6)], "k int, w int")
    got = nesting.nest_many(parent, [(a, ["v"], "a"), (b, ["w"], "b")], ["k"]).collect()
    assert {r.k: ([e.v for e in r.a], [e.w for e in r.b]) for r in got} == {1: (list(range(30)), [5]), 2: ([], [6])}


def test_row_span_and_sorting(spark):
    df = table(spark, "a array<int>, b array<int>", ([1, 2], []), ([], []))
    assert [r[0] for r in df.select(nesting.row_span(F.col("a"), F.col("b"))).collect()] == [2, 1]
    status = table(spark, "s string", ("3",), ("",), ("2",), (None,))
    assert [r[0] for r in status.select(sorting.status_rank(F.col("s"), ("", "2"))).collect()] == [3, 1, 2, 3]
    codes = table(spark, "c string", ("A100",), ("A9",))
    assert [r[0] for r in codes.select(sorting.numeric_suffix(F.col("c"))).collect()] == [100, 9]
    many = spark.range(150)
    assert sorting.top_n(many, [F.col("id")], limit=100).count() == 100
    assert sorting.top_n(many, [F.col("id")], limit=None).count() == 150


def test_aggregates(spark):
    df = table(spark, "k string, c string, v bigint", ("a", "01", 2), ("a", "02", None), ("a", "09", 4), ("b", None, 1))
    wide = aggregates.pivot_zero(df, ["k"], "c", {"01": "p1", "02": "p2"}, "v")
    assert rows(wide, "k", "p1", "p2") == [("a", 2, 0), ("b", 0, 0)]
    sums = table(spark, "r bigint, g bigint", (5, 5), (5, 4), (None, 4), (5, None))
    assert [r[0] for r in sums.select(aggregates.is_finish(F.col("r"), F.col("g"))).collect()] == [1, 0, 1, 1]
    days = table(spark, "d date, t string", (date(2024, 2, 1), "x"), (date(2024, 2, 9), "y"))
    months = aggregates.month_counts(days, F.col("d"), {"x": F.col("t") == "x"})
    assert rows(months, "month", "x") == [(m, 1 if m == 2 else 0) for m in range(1, 13)]


def test_revision_stats(spark):
    at = lambda n: datetime(2024, 1, n, 10)
    df = table(
        spark, "k string, rev int, q int, at timestamp_ntz",
        ("a", 1, 5, at(1)), ("a", 2, 0, at(2)), ("a", 3, 5, at(3)), ("a", 3, 5, at(4)),
        ("b", 1, 5, at(5)), ("c", 1, 0, at(6)),
    )
    got = aggregates.revision_stats(df, "k", "rev", "q", "at")
    assert rows(got) == [("a", 1, date(2024, 1, 1), date(2024, 1, 4)), ("b", 0, date(2024, 1, 5), None)]


def test_running_balance(spark):
    df = table(spark, "k string, d date, q bigint", ("a", date(2024, 1, 2), 4), ("a", date(2024, 1, 1), 3), ("a", date(2024, 1, 1), 1))
    starts = table(spark, "k string, s bigint", ("a", 10))
    got = allocation.running_balance(df, starts, "k", "d", "q", "s")
    assert rows(got, "d", "q", "balance", "total") == [(date(2024, 1, 1), 4, 6, 8), (date(2024, 1, 2), 4, 2, 8)]


def test_calendars(spark):
    assert generators.day_series(spark, 1996, 2).count() == 29
    weekend = generators.calendar(spark, 2024, 1).where("is_weekend = 1")
    assert [r[0] for r in rows(weekend, "day")] == [6, 7, 13, 14, 20, 21, 27, 28]
    a = table(spark, "k string, d date", ("x", date(2024, 1, 2)))
    b = table(spark, "k string, d date", ("x", date(2024, 1, 4)), ("y", date(2024, 1, 1)))
    assert rows(generators.order_days([a, b], "k", "d"), "k", "day") == [
        ("x", date(2024, 1, 2)), ("x", date(2024, 1, 3)), ("x", date(2024, 1, 4)), ("y", date(2024, 1, 1)),
    ]


# --- change application ------------------------------------------------------------------------


def test_upserts_and_updates(spark):
    snapshot = table(spark, "k int, v string, w int", (1, "a", 1), (2, "b", 2))
    edits = table(spark, "k int, v string, w int, seq int", (2, "x", 5, 1), (2, "y", 6, 2), (3, None, 7, 1))
    assert rows(changes.apply_upserts(snapshot, edits, ["k"], ["seq"])) == [(1, "a", 1), (2, "y", 6), (3, None, 7)]
    partial = table(spark, "k int, v string, seq int", (2, None, 1), (9, "z", 1))
    assert rows(changes.apply_updates(snapshot, partial, ["k"], ["seq"], ["v"])) == [(1, "a", 1), (2, None, 2)]
    left = changes.cascade_delete({"m": snapshot, "d": edits}, table(spark, "k int", (2,)), ["k"])
    assert {n: rows(d, "k") for n, d in left.items()} == {"m": [(1,)], "d": [(3,)]}
    added = changes.apply_increments(snapshot, table(spark, "k int, q int", (1, 4), (1, 5), (7, 1)), ["k"], "w", "q")
    assert rows(added) == [(1, "a", 10), (2, "b", 2)]


def repair_tables(spark):
    headers = table(spark, "qaRepair_ID int, qaRepairStatus string", (1, "2"), (2, "2"), (3, "1"))
    details = table(
        spark, "qaRepair_ID int, repair_Item int, Qty bigint, ToQa bigint, RepairFinish bigint",
        (1, 1, 5, 5, 0), (1, 2, 3, 0, 3), (2, 1, 4, 2, 0), (3, 1, 2, 0, 0),
    )
    return headers, details


def test_repair_states(spark):
    headers, details = repair_tables(spark)
    events = table(spark, "qaRepair_ID int, repair_Item int", (1, 1), (1, 2), (2, 1), (3, 1))
    got = changes.repair_receive(headers, details, events)
    assert rows(got["headers"]) == [(1, "3"), (2, "1"), (3, "1")]
    assert rows(got["details"]) == [(1, 1, 5, 0, 5), (1, 2, 3, 0, 3), (2, 1, 4, 0, 2), (3, 1, 2, 0, 0)]
    sent = changes.repair_send(headers, details, table(spark, "qaRepair_ID int, repair_Item int, sent bigint", (3, 1, 2), (2, 1, 0)))
    assert rows(sent["headers"]) == [(1, "2"), (2, "2"), (3, "2")]
    assert rows(sent["details"].where("qaRepair_ID > 1")) == [(2, 1, 4, 2, 0), (3, 1, 2, 2, 0)]
    back = changes.repair_cancel(headers, details, table(spark, "qaRepair_ID int", (2,)))
    assert rows(back["headers"]) == [(1, "2"), (2, "1"), (3, "1")]
    assert rows(back["details"].where("qaRepair_ID = 2")) == [(2, 1, 4, 0, 0)]


def revisions_by_hand(history, edits, today):
    """The rule one change at a time: write, then look at the history again."""
    log = defaultdict(list)
    for key, no, day in history:
        log[key].append((no, day))
    out = {}
    for key, seq, kind in sorted(edits, key=lambda e: e[1]):
        seen = log[key]
        if any(day == today and no != 1 for no, day in seen):
            last = max(no for no, day in seen if day == today)
        else:
            last = max([no for no, _ in seen], default=0) + 1
        number = 1 if kind == "first" else last
        seen.append((number, today))
        out[(key, seq)] = number
    return out


@pytest.mark.parametrize("seed", range(5))
def test_next_revision(spark, seed):
    rng, today = random.Random(seed), date(2024, 5, 5)
    history = [(k, no, today - timedelta(days=rng.randint(0, 2))) for k in "abcd" for no in range(1, rng.randint(1, 4))]
    edits = [(rng.choice("abcdef"), i, rng.choice(["first", "last", "last"])) for i in range(25)]
    past = table(spark, "OrderNumber string, HistoryNo int, HistoryDate date", *(history or [("zz", 1, today)]))
    got = changes.next_revision(table(spark, "OrderNumber string, seq int, target string", *edits), past, today)
    assert {(r.OrderNumber, r.seq): r.revision for r in got.collect()} == revisions_by_hand(history, edits, today)


def test_transition(spark):
    snapshot = table(spark, "o string, i int, st string", ("A", 1, "01"), ("B", 1, "01"))
    history = table(spark, "o string, i int, UpdateNo bigint", ("A", 1, 4))
    edits = table(spark, "o string, i int, t int, to string", ("A", 1, 2, "03"), ("A", 1, 1, "02"))
    got = changes.transition(snapshot, edits, history, ["o", "i"], ["t"], "st", "to")
    assert rows(got["snapshot"]) == [("A", 1, "03"), ("B", 1, "01")]
    assert rows(got["history"], "t", "UpdateNo") == [(1, 5), (2, 6)]


def test_assign_numbers_is_gap_free_and_unique(spark):
    existing = table(spark, "p string, document string", ("RD2401", "RD240100007"), ("RD2402", "RD240299999"))
    new = spark.createDataFrame([(f"RD240{1 + i % 3}", i) for i in range(300)], "p string, seq bigint")
    got = changes.assign_numbers(new, existing, "p", ["seq"], "document", 5)
    by_prefix = defaultdict(list)
    for r in got.orderBy("seq").collect():
        by_prefix[r.p].append(int(r.document[6:]))
    assert by_prefix["RD2401"] == list(range(8, 108))
    assert by_prefix["RD2402"] == list(range(100000, 100100))
    assert by_prefix["RD2403"] == list(range(1, 101))
    assert got.where("p = 'RD2403'").orderBy("seq").first().document == "RD240300001"


def test_shred(spark):
    text = '{"document_id":1,"order_number":"CH-1","sender":7,"items":[{"product_id":5,"qty":2,"reasons":[{"type_id":1,"reason_no":2,"qty":2}]},{"product_id":6,"qty":1}]}'
    got = changes.shred(table(spark, "j string", (text,)), "j")
    assert rows(got["master"]) == [(1, "CH-1", 7, 2)]
    assert rows(got["detail"]) == [(1, 1, "CH-1", 5, 2), (1, 2, "CH-1", 6, 1)]
    assert rows(got["reason"]) == [(1, 1, 1, 2, 2)]


def test_a_document_is_shredded_or_quarantined_as_a_whole(spark):
    good = '{"document_id":1,"order_number":"A","sender":1,"items":[{"product_id":5,"qty":2,"reasons":[{"type_id":1,"reason_no":2,"qty":3}]}]}'
    texts = {
        good: None, '{"document_id":2,"order_number":"B","items":[]}': None, good[:50]: changes.NOT_JSON, "": changes.EMPTY, None: changes.EMPTY,
        good.replace("5", '"x"'): changes.WRONG_TYPE, good.replace(":1,", ':"x1",', 1): changes.WRONG_TYPE, "[1]": changes.WRONG_TYPE,
        good.replace('"order_number"', '"order"'): changes.MISSING, '{"document_id":3,"order_number":"A"}': changes.MISSING,
        good.replace('"qty":2', '"n":2'): changes.INCOMPLETE_ITEM, '{"document_id":4,"order_number":"A","items":[null]}': changes.INCOMPLETE_ITEM,
        good.replace('"reason_no":2', '"n":2'): changes.INCOMPLETE_REASON,
    }
    got = changes.shred(table(spark, "n int, j string", *enumerate(texts)), "j")
    wanted = [(n, text, reason) for n, (text, reason) in enumerate(texts.items()) if reason is not None]
    assert rows(got["quarantine"], "n", "j", "reason") == wanted
    assert rows(got["master"]) == [(1, "A", 1, 1), (2, "B", None, 0)]
    assert rows(got["detail"]) == [(1, 1, "A", 5, 2)] and rows(got["reason"]) == [(1, 1, 1, 2, 3)]


def test_documents_are_lines_of_json(spark, tmp_path):
    df = table(spark, "d date, v int", (date(2024, 1, 1), 1), (date(2024, 1, 2), 2))
    sinks.to_documents(df, str(tmp_path / "json"))
    assert spark.read.schema("d date, v int").json(str(tmp_path / "json")).count() == 2


def test_a_bundle_is_one_scan_and_one_shuffle(spark, tmp_path):
    data = table(spark, "a string, b int, v int", ("x", 1, 10), ("x", 2, 20), (None, 1, 30), (None, None, 40))
    data.write.parquet(str(tmp_path / "base"))
    base = spark.read.parquet(str(tmp_path / "base"))
    parts = {"all": [], "a": ["a"], "b": ["b"], "both": ["b", "a"]}
    found = report_bundle(base, parts, {"n": F.count(F.lit(1)), "v": F.sum("v")})
    assert rows(found) == sorted([
        ("all", None, None, 4, 100), ("a", "x", None, 2, 30), ("a", None, None, 2, 70), ("b", None, 1, 2, 40), ("b", None, 2, 1, 20),
        ("b", None, None, 1, 40), ("both", "x", 1, 1, 10), ("both", "x", 2, 1, 20), ("both", None, 1, 1, 30), ("both", None, None, 1, 40),
    ], key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan") == 1
    again = report_bundle(base, parts, {"n": F.count(F.lit(1)), "v": F.sum("v")})
    assert again._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    with pytest.raises(ValueError):
        report_bundle(base, {"one": ["a"], "two": ["a"]}, {"n": F.count(F.lit(1))})


def test_shared_folder_reads_the_session(spark):
    assert session.shared_folder(spark) == spark.sparkContext.getCheckpointDir() or spark.sparkContext.getCheckpointDir()
