"""Scans, sinks, filters, sorts, calendars and scalar functions on the driver's tables."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import functions as F

from loupewright.catalog.registry import AS_OF, D, METER_NOW, NOW, case_sql, query
from loupewright.functions import dates as fd
from loupewright.functions import labels as L
from loupewright.functions import numbers as fn
from loupewright.functions import text as ft
from loupewright.operators import filters as flt
from loupewright.operators import generators as gen
from loupewright.operators import sorting
from loupewright.operators.bundle import report_bundle
from loupewright.operators.joins import left_default, restrict
from loupewright.operators.nesting import children_text, column_to_array, nest
from loupewright.operators.ranked import Descending, number_rows
from loupewright.sources.session import shared_folder
from loupewright.sources.ledgers import append_history, read_history
from loupewright.sources.sinks import document_column

_LIVE = "o.Status = '2' and left(o.OrderNumber, 3) = 'CH-' and left(o.OrderNumber, 5) <> 'CH-M-'"
_LIVE_NO_TEST = _LIVE + " and left(o.OrderNumber, 7) <> 'CH-TEST'"

# --- scans, sources, sinks ---------------------------------------------------------------------


@query("scan_table", "select c_custkey, c_name, c_nationkey, c_mktsegment from $customer")
def scan_table(t):
    return t.customer.select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").orderBy("c_nationkey", "c_custkey")


@query(
    "report_bundle",
    """with base as (select * from orders where o_orderdate >= timestamp '1998-01-01' and o_orderdate < timestamp '1999-01-01')
    select 'total' as part, '' as code, count(*) as n from base
    union all select 'status', o_orderstatus, count(*) from base group by 2
    union all select 'priority', o_orderpriority, count(*) from base group by 2
    union all select 'month', strftime(o_orderdate, '%m'), count(*) from base group by 2""",
)
def bundle(t):
    base = t.orders.where(flt.date_between(F.col("o_orderdate"), date(1998, 1, 1), date(1998, 12, 31)))
    base = base.select(
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.date_format("o_orderdate", "MM").alias("month")
    )
    parts = {"total": [], "status": ["status"], "priority": ["priority"], "month": ["month"]}
    found = report_bundle(base, parts, {"n": F.count(F.lit(1))})
    return found.select("part", F.coalesce("status", "priority", "month", F.lit("")).alias("code"), "n")


@query(
    "key_set_restrict",
    f"""select l_returnflag as flag, count(*) as n_lines, cast(sum(cast(l_quantity as int)) as bigint) as qty
    from lineitem where l_orderkey in (select o.OrderKey from $order_master o where {_LIVE_NO_TEST} and year(o.DueDate) >= 1998)
    group by 1""",
)
def key_set_restrict(t):
    keys = flt.live_orders(t.order_master, due_year_floor=1998).select(F.col("OrderKey").alias("l_orderkey"))
    lines = restrict(t.lineitem, keys, ["l_orderkey"])
    quantity = F.sum(F.col("l_quantity").cast("int")).alias("qty")
    return lines.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n_lines"), quantity)


@query(
    "column_to_array",
    """select l_returnflag as flag, count(*) as n_days, string_agg(cast(day as string), ',' order by day) as days
    from (select distinct l_returnflag, cast(l_shipdate as date) as day from lineitem) a group by 1""",
)
def to_array(t):
    days = t.lineitem.select(F.col("l_returnflag").alias("flag"), F.to_date("l_shipdate").alias("day"))
    arrays = column_to_array(days, ["flag"], "day", "days")
    return arrays.select("flag", F.size("days").alias("n_days"), F.array_join(F.col("days").cast("array<string>"), ",").alias("days"))


@query(
    "json_document_sink",
    """select o.OrderNumber as order_number, to_json({'order_number': o.OrderNumber, 'team': o.ProductionTeam, 'items':
      (select list({'ItemNo': d.ItemNo, 'ProductID': d.ProductID, 'Qty': d.Qty} order by d.ItemNo) from $order_detail d
        where d.OrderNumber = o.OrderNumber)})::varchar as document
    from $order_master o where exists (select 1 from $order_detail d where d.OrderNumber = o.OrderNumber)""",
)
def json_documents(t):
    orders = t.order_master.select("OrderNumber", F.col("ProductionTeam").alias("team"))
    nested = nest(orders, t.order_detail, ["OrderNumber"], ["ItemNo", "ProductID", "Qty"], "items")
    filled = nested.where(F.size("items") > 0).select(F.col("OrderNumber").alias("order_number"), "team", "items")
    return document_column(filled, ["order_number"])


@query(
    "append_history",
    """select cast(date_trunc('month', HistoryDate) as date) as HistoryMonth, HistoryTypeCode as type_code, count(*) as n,
      cast(sum(Qty) as bigint) as qty, max(HistoryDate) as last_date, cast(sum(sequence) as bigint) as sequences
    from (select *, row_number() over (partition by OrderNumber order by HistoryTypeCode, HistoryDate, MP_ItemNo, InvCode, EmpCode, Qty) as sequence
      from $purchase_history) numbered group by 1, 2""",
)
def history(t):
    """The history is appended in two batches, the first of them twice, to a new folder, read back, and counted."""
    path = f"{shared_folder(t.spark)}/history-{uuid.uuid4().hex}"
    rows = t.purchase_history.withColumn("HistoryMonth", F.trunc("HistoryDate", "month"))
    order = ["HistoryDate", "MP_ItemNo", "InvCode", "EmpCode", "Qty"]
    for type_code in ("03", "03", "05"):
        batch = rows.where(F.col("HistoryTypeCode") == type_code)
        append_history(batch, path, f"type {type_code}", ["OrderNumber"], order, "HistoryMonth")
    back = read_history(t.spark, path, rows.schema)
    return back.groupBy("HistoryMonth", F.col("HistoryTypeCode").alias("type_code")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("Qty").alias("qty"), F.max("HistoryDate").alias("last_date"), F.sum("sequence").alias("sequences")
    )


# --- projections, filters, predicates ----------------------------------------------------------


@query(
    "project_const",
    """select o_orderkey as order_key, o_orderstatus as status, 0 as checkbox, 0 as qty_send, cast(null as string) as reason, '' as remark
    from orders""",
)
def project_const(t):
    return t.orders.select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_orderstatus").alias("status"),
        F.lit(0).alias("checkbox"),
        F.lit(0).alias("qty_send"),
        F.lit(None).cast("string").alias("reason"),
        F.lit("").alias("remark"),
    )


@query(
    "in_list_padded",
    """select 'two' as list, ProductionTeam as team, count(*) as n from $order_master where ProductionTeam in ('1', '3', '', '') group by 2
    union all select 'all', ProductionTeam, count(*) from $order_master where ProductionTeam in ('1', '2', '3', '4') group by 2
    union all select 'none', ProductionTeam, count(*) from $order_master where ProductionTeam in ('') group by 2""",
)
def in_list(t):
    result = None
    for name, values in {"two": ["1", "3", None, None], "all": ["0"], "none": [None, None]}.items():
        kept = t.order_master.where(flt.in_padded(F.col("ProductionTeam"), values, {"0": flt.ALL_TEAMS}))
        part = kept.groupBy(F.lit(name).alias("list"), F.col("ProductionTeam").alias("team")).agg(F.count(F.lit(1)).alias("n"))
        result = part if result is None else result.union(part)
    return result


@query(
    "date_between",
    """select 'raw' as mode, count(*) as n, max(ts) as last_ts from events where ts between timestamp '2024-01-05' and timestamp '2024-01-20'
    union all select 'day', count(*), max(ts) from events where cast(ts as date) between date '2024-01-05' and date '2024-01-20'
    union all select 'end_of_day', count(*), max(ts) from events where ts between timestamp '2024-01-05' and timestamp '2024-01-20 23:59:59'""",
)
def date_range(t):
    result = None
    for mode in ("raw", "day", "end_of_day"):
        kept = t.events.where(flt.date_between(F.col("ts"), date(2024, 1, 5), date(2024, 1, 20), mode))
        part = kept.agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_ts")).select(F.lit(mode).alias("mode"), "n", "last_ts")
        result = part if result is None else result.union(part)
    return result


@query(
    "open_or_in_range",
    """select o_orderstatus as status, count(*) as n, min(cast(o_orderdate as date)) as first_day from orders
    where cast(o_orderdate as date) between date '1998-01-01' and date '1998-06-30' or o_orderstatus in ('O') group by 1""",
)
def open_or_in_range(t):
    in_range = flt.date_between(F.col("o_orderdate"), date(1998, 1, 1), date(1998, 6, 30))
    kept = t.orders.where(flt.open_or_between(in_range, F.col("o_orderstatus"), ["O"]))
    return kept.groupBy(F.col("o_orderstatus").alias("status")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.to_date("o_orderdate")).alias("first_day")
    )


@query(
    "live_order_filter",
    f"select o.OrderNumber as order_number, o.DueDate as due_date from $order_master o where {_LIVE_NO_TEST} and year(o.DueDate) >= 1997",
)
def live_order_filter(t):
    live = flt.live_orders(t.order_master, due_year_floor=1997)
    return live.select(F.col("OrderNumber").alias("order_number"), F.col("DueDate").alias("due_date"))


@query(
    "contains_filter",
    """select p_partkey as part_key, p_name as name, 'widget' as search from part where upper(p_name) like '%WIDGET%'
    union all select p_partkey, p_name, '' from part where p_name like '%%'
    union all select p_partkey, p_name, '100%' from part where strpos(upper(p_name), '100%') > 0""",
)
def contains_filter(t):
    result = None
    for text in ("widget", "", "100%"):
        part = t.part.where(flt.contains_text(F.col("p_name"), text))
        part = part.select(F.col("p_partkey").alias("part_key"), F.col("p_name").alias("name"), F.lit(text).alias("search"))
        result = part if result is None else result.union(part)
    return result


@query(
    "rolling_window_filter",
    f"""select days, count(*) as n, count(ReturnDate) as n_closed from (
      select 30 as days, ReturnDate from $mould_loan where coalesce(ReturnDate, {D}) > {D} - 30
      union all select 7, ReturnDate from $mould_loan where coalesce(ReturnDate, {D}) > {D} - 7) a group by 1""",
)
def rolling_window(t):
    result = None
    for days in (30, 7):
        kept = t.mould_loan.where(flt.recent(F.col("ReturnDate"), AS_OF, days))
        part = kept.agg(F.count(F.lit(1)).alias("n"), F.count("ReturnDate").alias("n_closed"))
        part = part.select(F.lit(days).alias("days"), "n", "n_closed")
        result = part if result is None else result.union(part)
    return result


@query(
    "year_filter",
    """select '=' as op, count(*) as n from orders where year(o_orderdate) = 1998
    union all select '>=', count(*) from orders where year(o_orderdate) >= 1998
    union all select '>', count(*) from orders where year(o_orderdate) > 1998""",
)
def year_filter(t):
    result = None
    for op in ("=", ">=", ">"):
        part = t.orders.where(flt.year_cmp(F.col("o_orderdate"), op, 1998)).agg(F.count(F.lit(1)).alias("n"))
        part = part.select(F.lit(op).alias("op"), "n")
        result = part if result is None else result.union(part)
    return result


_MODES = {
    1: ("qa_bill_detail", "QCPerson", "qaBill_ID", 7),
    2: ("qa_bill_master", "SenderNew", "qaBill_ID", 5),
    3: ("qa_repair_master", "ReceiverNew", "qaBill_ID", 3),
}


@query(
    "lookup_by_mode",
    " union all ".join(
        f"select distinct {mode} as mode, {key} as bill_id from ${table} where {column} = {value}"
        for mode, (table, column, key, value) in _MODES.items()
    ),
)
def lookup(t):
    tables = {mode: (getattr(t, table), column, key) for mode, (table, column, key, _) in _MODES.items()}
    result = None
    for mode, (*_, value) in _MODES.items():
        part = flt.lookup_by_mode(tables, mode, value).select(F.lit(mode).alias("mode"), F.col("qaBill_ID").alias("bill_id"))
        result = part if result is None else result.union(part)
    return result


@query("distinct_project", "select distinct l_partkey as part_key, l_suppkey as supp_key from lineitem")
def distinct_project(t):
    return t.lineitem.select(F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supp_key")).distinct()


# --- sorts, limits -----------------------------------------------------------------------------


@query(
    "sort_multi",
    """select o_orderkey as order_key, row_number() over (order by o_orderstatus, o_orderdate desc, o_orderkey) as place from orders""",
)
def sort_multi(t):
    order = ["o_orderstatus", Descending("o_orderdate"), "o_orderkey"]
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate")
    return number_rows(rows, [], order, "place").select(F.col("o_orderkey").alias("order_key"), "place")


@query(
    "sort_case_priority",
    """select o_orderkey as order_key, row_number() over (
      order by case o_orderstatus when 'O' then 1 when 'P' then 2 else 3 end, o_orderdate, o_orderkey) as place from orders""",
)
def sort_case_priority(t):
    rows = t.orders.select("o_orderkey", "o_orderdate", sorting.status_rank(F.col("o_orderstatus"), ("O", "P")).alias("rank"))
    return number_rows(rows, [], ["rank", "o_orderdate", "o_orderkey"], "place").select(F.col("o_orderkey").alias("order_key"), "place")


@query(
    "sort_numeric_suffix",
    """select p_partkey as part_key, cast(regexp_extract(p_brand, '^.{6}(\\d+)', 1) as bigint) as brand_no,
      row_number() over (order by cast(regexp_extract(p_brand, '^.{6}(\\d+)', 1) as bigint), p_partkey) as place from part""",
)
def sort_numeric_suffix(t):
    rows = t.part.select(F.col("p_partkey").alias("part_key"), sorting.numeric_suffix(F.col("p_brand"), 7).alias("brand_no"))
    return number_rows(rows, [], ["brand_no", "part_key"], "place")


@query(
    "top_n_when_unfiltered",
    """select 'none' as filter, order_number, due_date from (select OrderNumber as order_number, DueDate as due_date
      from $order_master order by DueDate, OrderNumber limit 100) a
    union all select 'text', OrderNumber, DueDate from $order_master where OrderNumber like '%77%'""",
)
def top_n(t):
    columns = [F.col("OrderNumber").alias("order_number"), F.col("DueDate").alias("due_date")]
    order = [F.col("DueDate"), F.col("OrderNumber")]
    first = sorting.top_n(t.order_master, order, limit=100).select(F.lit("none").alias("filter"), *columns)
    found = t.order_master.where(flt.contains_text(F.col("OrderNumber"), "77"))
    return first.union(sorting.top_n(found, order, limit=None).select(F.lit("text").alias("filter"), *columns))


@query(
    "sort_in_array",
    """select d.OrderNumber as order_number, count(*) as n,
      string_agg(d.Qty || ':' || d.ItemNo, ',' order by d.Qty, d.ItemNo) as by_qty,
      string_agg(d.ItemNo || ':' || d.Qty, ',' order by d.ItemNo) as by_item
    from $order_detail d group by 1""",
)
def sort_in_array(t):
    heads = t.order_detail.select("OrderNumber").distinct()
    nested = nest(heads, t.order_detail, ["OrderNumber"], ["ItemNo", "Qty"], "items")
    by_quantity = sorting.sort_children(F.col("items"), "Qty")
    return nested.select(
        F.col("OrderNumber").alias("order_number"),
        F.size("items").alias("n"),
        children_text(F.transform(by_quantity, lambda e: e["_row"]), "Qty", "ItemNo").alias("by_qty"),
        children_text(F.col("items"), "ItemNo", "Qty").alias("by_item"),
    )


# --- calendars ---------------------------------------------------------------------------------


@query(
    "day_series",
    """select cast(d as int) as day, (select count(*) from orders where year(o_orderdate) = 1996 and month(o_orderdate) = 2
      and day(o_orderdate) = d) as n_orders from generate_series(1, 29) g(d)""",
)
def day_series(t):
    days = gen.day_series(t.spark, 1996, 2)
    stamp = F.col("o_orderdate")
    counted = t.orders.where(flt.date_between(stamp, date(1996, 2, 1), date(1996, 2, 29))).groupBy(F.day(stamp).alias("day"))
    return left_default(days, counted.agg(F.count(F.lit(1)).alias("n_orders")), ["day"], {"n_orders": 0})


@query(
    "calendar_weekend",
    f"""select cast(day(d) as int) as day, cast(d as date) as date, dayofweek(d) + 1 as dow,
      case when dayofweek(d) in (0, 6) then 1 else 0 end as is_weekend,
      case when dayofweek(d) in (0, 6) then '{L.WEEKEND_COLOUR}' else '{L.WEEKDAY_COLOUR}' end as colour,
      (select count(*) from events where cast(ts as date) = cast(d as date)) as n_events
    from generate_series(date '2024-01-01', date '2024-01-31', interval 1 day) g(d)""",
)
def calendar_weekend(t):
    days = gen.calendar(t.spark, 2024, 1)
    counted = t.events.groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n_events"))
    return left_default(days, counted, ["date"], {"n_events": 0})


@query(
    "order_day_calendar",
    """select k as order_key, count(*) as n_days, min(day) as first_day, max(day) as last_day,
      count(case when dayofweek(day) in (0, 6) then 1 end) as n_weekend
    from (select l_orderkey as k, unnest(generate_series(cast(min(l_shipdate) as date), cast(max(l_shipdate) as date), interval 1 day)) as day
      from lineitem group by 1) a group by 1""".replace("min(day)", "cast(min(day) as date)").replace("max(day)", "cast(max(day) as date)"),
)
def order_day_calendar(t):
    shipped = t.lineitem.select("l_orderkey", F.to_date("l_shipdate").alias("d"))
    days = gen.order_days([shipped], "l_orderkey", "d")
    return days.groupBy(F.col("l_orderkey").alias("order_key")).agg(
        F.count(F.lit(1)).alias("n_days"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.count(F.when(F.col("dow").isin(1, 7), 1)).alias("n_weekend"),
    )


# --- scalar functions --------------------------------------------------------------------------


@query(
    "fn_string",
    """select c_custkey as k, left(c_name, 8) as a, right(c_name, 4) as b, substring(c_name, 10, 3) as c,
      length(rtrim(c_name || '  ')) as d, replace(c_name, '#', '-') as e, c_name || ' / ' || c_mktsegment as f,
      coalesce(case when c_custkey % 3 = 0 then c_mktsegment end, '') || '|' as g,
      case when c_custkey % 3 = 0 then c_mktsegment end || '|' as h, upper(c_name) as i,
      c_mktsegment like 'BUILD%' as j, upper(rtrim(c_name || ' ')) = upper(rtrim(lower(c_name))) as same
    from customer""",
)
def fn_string(t):
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    sometimes = F.when(F.col("c_custkey") % 3 == 0, segment)
    return t.customer.select(
        F.col("c_custkey").alias("k"),
        F.left(name, F.lit(8)).alias("a"),
        F.right(name, F.lit(4)).alias("b"),
        F.substring(name, 10, 3).alias("c"),
        ft.trimmed_length(F.concat(name, F.lit("  "))).alias("d"),
        F.replace(name, F.lit("#"), F.lit("-")).alias("e"),
        F.concat(name, F.lit(" / "), segment).alias("f"),
        ft.concat_skip_null(sometimes, F.lit("|")).alias("g"),
        F.concat(sometimes, F.lit("|")).alias("h"),
        F.upper(name).alias("i"),
        segment.startswith("BUILD").alias("j"),
        ft.same_text(F.concat(name, F.lit(" ")), F.lower(name)).alias("same"),
    )


_URL = "'https://pictures.example/' || replace(replace(substring({c}, 4), chr(92), '/'), '#', '%23')"


@query(
    "fn_picture_url",
    f"""select ProductID as k, {_URL.format(c="NewPict")} as link,
      case when p is null or p = '' then 'https://pictures.example/avatar.png' else {_URL.format(c="p")} end as link_or_default
    from (select *, case when ProductID % 3 = 0 then null when ProductID % 3 = 1 then '' else NewPict end as p from $product_master) a""",
)
def fn_picture_url(t):
    key = F.col("ProductID") % 3
    sometimes = F.when(key == 1, "").when(key == 2, F.col("NewPict"))
    return t.product_master.select(
        F.col("ProductID").alias("k"),
        ft.picture_url(F.col("NewPict")).alias("link"),
        ft.picture_url(sometimes, default=ft.DEFAULT_PICTURE).alias("link_or_default"),
    )


@query(
    "fn_time_string",
    """select event_id as k, strftime(ts, '%H:%M') as hh_mm, strftime(ts, '%H%M%S') as digits,
      strftime(ts, '%H') || ':' || strftime(ts, '%M') || ':' || strftime(ts, '%S') as clock from events""",
)
def fn_time_string(t):
    digits = ft.clock_digits(F.col("ts"))
    return t.events.select(
        F.col("event_id").alias("k"), ft.clock_minutes(F.col("ts")).alias("hh_mm"), digits.alias("digits"), ft.clock_text(digits).alias("clock")
    )


@query(
    "fn_zero_pad",
    """select o_orderkey as k, lpad(o_orderkey::varchar, greatest(5, length(o_orderkey::varchar))::int, '0') as five,
      right('000' || o_orderkey, 3) as three from orders""",
)
def fn_zero_pad(t):
    key = F.col("o_orderkey")
    return t.orders.select(key.alias("k"), ft.zero_pad(key, 5).alias("five"), ft.zero_pad(key, 3, cut=True).alias("three"))


@query("fn_display_name", "select EmpCode as k, EmpFName || ' (' || NickName || ')' as name from $employee")
def fn_display_name(t):
    return t.employee.select(F.col("EmpCode").alias("k"), ft.display_name(F.col("EmpFName"), F.col("NickName")).alias("name"))


@query(
    "fn_date_parts",
    """select o_orderkey as k, year(o_orderdate) as y, month(o_orderdate) as m, day(o_orderdate) as d, dayofyear(o_orderdate) as doy,
      dayofweek(o_orderdate) + 1 as dow, cast(last_day(o_orderdate) as date) as month_end,
      make_date(year(o_orderdate), month(o_orderdate), 1) as month_start from orders""",
)
def fn_date_parts(t):
    day = F.col("o_orderdate")
    return t.orders.select(
        F.col("o_orderkey").alias("k"),
        F.year(day).alias("y"),
        F.month(day).alias("m"),
        F.day(day).alias("d"),
        F.dayofyear(day).alias("doy"),
        F.dayofweek(day).alias("dow"),
        F.last_day(day).alias("month_end"),
        F.make_date(F.year(day), F.month(day), F.lit(1)).alias("month_start"),
    )


@query(
    "fn_date_arith",
    f"""select event_id as k, ts - interval 7 hour as shifted, ts - interval 25 minute as earlier, cast(ts as date) as day,
      cast(ts as date) - 9 as nine_before, cast(cast(ts as date) - interval 543 year as date) as years_before,
      date_diff('day', cast({NOW} as date), cast(ts as date)) as days_left from events""",
)
def fn_date_arith(t):
    stamp, day = F.col("ts"), F.to_date("ts")
    return t.events.select(
        F.col("event_id").alias("k"),
        fd.shift_hours(stamp, -7).alias("shifted"),
        (stamp - F.expr("INTERVAL '25' MINUTE")).alias("earlier"),
        day.alias("day"),
        F.date_add(day, -9).alias("nine_before"),
        F.add_months(day, -12 * fd.BUDDHIST_OFFSET).alias("years_before"),
        fd.days_until(METER_NOW.date(), day).alias("days_left"),
    )


@query(
    "fn_buddhist_year",
    """select BillID as k, case when year(DueDate) >= 2564 then cast(DueDate - interval 543 year as date) else DueDate end as due,
      right(cast(year(JobDate) + 543 as string), 2) || strftime(JobDate, '%m') as prefix from $repair_document""",
)
def fn_buddhist_year(t):
    return t.repair_document.select(
        F.col("BillID").alias("k"), fd.gregorian(F.col("DueDate")).alias("due"), fd.buddhist_prefix(F.col("JobDate")).alias("prefix")
    )


@query(
    "fn_date_format",
    """select event_id as k, strftime(ts, '%y%m') as year_month, strftime(ts, '%d/%m/%Y') as day, strftime(ts, '%H:%M:%S') as clock from events""",
)
def fn_date_format(t):
    stamp = F.col("ts")
    return t.events.select(
        F.col("event_id").alias("k"),
        F.date_format(stamp, "yyMM").alias("year_month"),
        F.date_format(stamp, "dd/MM/yyyy").alias("day"),
        F.date_format(stamp, "HH:mm:ss").alias("clock"),
    )


@query(
    "fn_code_labels",
    f"""select o.OrderNumber as k, {case_sql("dayofweek(o.DueDate) + 1", L.WEEKDAYS)} as weekday, {case_sql("month(o.DueDate)", L.MONTHS, None)} as month,
      {case_sql("o.ProductionTeam", L.TEAMS, L.NO_TEAM)} as team, {case_sql("c.CusStatus", L.MANAGERS, L.NO_DATA)} as manager,
      {case_sql("o.Status", L.REPAIR_STATUS, L.NO_DATA)} as status,
      case when i.PriceType = 'Q' or i.PriceType = '' then i.QtyUnit else i.WgUnitName end as unit
    from $order_master o join $customer_master c on o.CusCode = c.CusCode left join $inv_master i on i.InvCode = o.CusCode""",
)
def fn_code_labels(t):
    rows = t.order_master.join(t.customer_master, "CusCode").join(t.inv_master, F.col("CusCode") == F.col("InvCode"), "left")
    return rows.select(
        F.col("OrderNumber").alias("k"),
        L.weekday_label(F.col("DueDate")).alias("weekday"),
        L.month_label(F.col("DueDate")).alias("month"),
        L.label(F.col("ProductionTeam"), L.TEAMS, L.NO_TEAM).alias("team"),
        L.label(F.col("CusStatus"), L.MANAGERS, L.NO_DATA).alias("manager"),
        L.label(F.col("Status"), L.REPAIR_STATUS, L.NO_DATA).alias("status"),
        L.unit_of_price(F.col("PriceType"), F.col("QtyUnit"), F.col("WgUnitName")).alias("unit"),
    )


@query(
    "fn_conditional",
    """select OrderNumber as n, MP_ItemNo as line_no, case when QtyToFact >= QtyReq then 'done' when QtyToFact > 0 then 'part' else 'open' end as state,
      case when balance < 0 then 0 else balance end as clamped, coalesce(balance, 0) as filled,
      case when SupDueDate < date '1950-01-01' then 1 else 0 end as unset
    from (select *, case when MP_ItemNo = 5 then null else QtyToFact - 20 end as balance from $purchase_status) a""",
)
def fn_conditional(t):
    balance = F.when(F.col("MP_ItemNo") != 5, F.col("QtyToFact") - 20)
    return t.purchase_status.select(
        F.col("OrderNumber").alias("n"),
        F.col("MP_ItemNo").alias("line_no"),
        F.when(F.col("QtyToFact") >= F.col("QtyReq"), "done").when(F.col("QtyToFact") > 0, "part").otherwise("open").alias("state"),
        fn.clamp_at_zero(balance).alias("clamped"),
        fn.zero_if_null(balance).alias("filled"),
        fd.unset_before(F.col("SupDueDate"), 1950).cast("int").alias("unset"),
    )


@query(
    "fn_numeric_cast",
    """select OrderNumber as n, MP_ItemNo as line_no, cast(right(OrderNumber, 8) as int) as number, cast(QtyReq as string) as text,
      round(cast(QtyToFact as double) / nullif(QtyPurchase, 0), 6) as ratio,
      case when QtyPurchase = 0 then 0 else QtyToFact * 100 // QtyPurchase end as percent
    from $purchase_status""",
)
def fn_numeric_cast(t):
    return t.purchase_status.select(
        F.col("OrderNumber").alias("n"),
        F.col("MP_ItemNo").alias("line_no"),
        F.right("OrderNumber", F.lit(8)).cast("int").alias("number"),
        F.col("QtyReq").cast("string").alias("text"),
        F.round(fn.guarded_ratio(F.col("QtyToFact"), F.col("QtyPurchase")), 6).alias("ratio"),
        fn.int_percent(F.col("QtyToFact"), F.col("QtyPurchase")).alias("percent"),
    )
