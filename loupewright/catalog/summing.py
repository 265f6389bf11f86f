"""Aggregations and windows on the driver's tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from loupewright.catalog.registry import query
from loupewright.functions.numbers import int_percent
from loupewright.operators import aggregates as agg
from loupewright.operators.allocation import fifo_allocate, running_balance
from loupewright.operators.changes import next_revision
from loupewright.operators.filters import year_cmp
from loupewright.operators.joins import left_default
from loupewright.operators.ranked import number_rows, running_total



def _count():
    return F.count(F.lit(1))


def _qty():
    return F.col("l_quantity").cast("int")



@query(
    "group_sum",
    """select l_partkey as part_key, l_suppkey as supp_key, cast(sum(cast(l_quantity as int)) as bigint) as qty from lineitem group by 1, 2""",
)
def group_sum(t):
    return t.lineitem.groupBy(F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supp_key")).agg(F.sum(_qty()).alias("qty"))


@query(
    "group_min_max_count",
    """select l_returnflag as flag, year(l_shipdate) as y, month(l_shipdate) as m, min(cast(l_shipdate as date)) as first_day,
      max(cast(l_shipdate as date)) as last_day, count(*) as n from lineitem group by 1, 2, 3""",
)
def group_min_max_count(t):
    day = F.to_date("l_shipdate")
    return t.lineitem.groupBy(F.col("l_returnflag").alias("flag"), F.year(day).alias("y"), F.month(day).alias("m")).agg(
        F.min(day).alias("first_day"), F.max(day).alias("last_day"), _count().alias("n")
    )


@query(
    "global_count",
    """select count(case when qaBillStatus = '' then 1 end) as to_receive, count(case when qaBillStatus = '3' then 1 end) as finished,
      count(*) as bills from $qa_bill_master""",
)
def global_count(t):
    status = F.col("qaBillStatus")
    return t.qa_bill_master.agg(
        agg.count_where(status == "").alias("to_receive"), agg.count_where(status == "3").alias("finished"), _count().alias("bills")
    )


@query(
    "conditional_sum",
    """select l_partkey as part_key, cast(coalesce(sum(case when l_returnflag in ('A', 'N') then cast(l_quantity as int) end), 0) as bigint) as kept,
      cast(coalesce(sum(case when l_returnflag in ('R') then cast(l_quantity as int) end), 0) as bigint) as returned
    from lineitem group by 1""",
)
def conditional_sum(t):
    flag = F.col("l_returnflag")
    return t.lineitem.groupBy(F.col("l_partkey").alias("part_key")).agg(
        agg.sum_where(flag.isin("A", "N"), _qty()).alias("kept"), agg.sum_where(flag == "R", _qty()).alias("returned")
    )


_LINES = {n: f"p{n}" for n in range(1, 8)}


@query(
    "pivot_sum_zero",
    "select l_orderkey as order_key, "
    + ", ".join(f"cast(coalesce(sum(case when l_linenumber = {n} then cast(l_quantity as int) end), 0) as bigint) as p{n}" for n in _LINES)
    + " from lineitem group by 1",
)
def pivot_sum_zero(t):
    rows = t.lineitem.select(F.col("l_orderkey").alias("order_key"), "l_linenumber", _qty().alias("qty"))
    return agg.pivot_zero(rows, ["order_key"], "l_linenumber", _LINES, "qty")


@query(
    "pivot_count_status",
    """select count(case when o_orderstatus = 'F' then 1 end) as finished, count(case when o_orderstatus = 'O' then 1 end) as open,
      count(case when o_orderstatus = 'P' then 1 end) as partial, count(case when o_orderstatus = 'X' then 1 end) as unknown from orders""",
)
def pivot_count_status(t):
    return agg.count_by_status(t.orders, "o_orderstatus", {"F": "finished", "O": "open", "P": "partial", "X": "unknown"})


@query(
    "distinct_then_count",
    """select OrderNumber as order_number, count(distinct HistoryNo) - 1 as postponements from $due_fac_to_qa where Qty > 0 group by 1""",
)
def distinct_then_count(t):
    stats = agg.revision_stats(t.due_fac_to_qa, "OrderNumber", "HistoryNo", "Qty", "HistoryDate")
    return stats.select(F.col("OrderNumber").alias("order_number"), "postponements")


@query(
    "two_level_rollup",
    """select OrderNumber as order_number, cast(sum(q) as bigint) as qty, count(*) as n_items,
      case when sum(r) = 0 then 'none' when sum(r) < sum(q) then 'part' else 'all' end as state
    from (select j.OrderNumber, j.OrderItemNo, j.JobQty as q, coalesce((select sum(x.ReturnQty) from $cast_repair x where x.JobNumber = j.JobNumber), 0) as r
      from $job_order j) a group by 1""",
)
def two_level_rollup(t):
    returned = t.cast_repair.groupBy("OrderNumber").agg(F.sum("ReturnQty").alias("r"))
    items = t.job_order.groupBy("OrderNumber").agg(F.sum("JobQty").alias("qty"), _count().alias("n_items"))
    rows = left_default(items, returned, ["OrderNumber"], {"r": 0})
    state = F.when(F.col("r") == 0, "none").when(F.col("r") < F.col("qty"), "part").otherwise("all")
    return rows.select(F.col("OrderNumber").alias("order_number"), "qty", "n_items", state.alias("state"))


@query(
    "percent_int",
    """select l_orderkey as order_key, case when total = 0 then 0 else kept * 100 // total end as percent from (select l_orderkey,
      cast(coalesce(sum(case when l_returnflag = 'A' then cast(l_quantity as int) end), 0) as bigint) as kept,
      cast(coalesce(sum(case when l_returnflag <> 'N' then cast(l_quantity as int) end), 0) as bigint) as total from lineitem group by 1) a""",
)
def percent_int(t):
    flag = F.col("l_returnflag")
    sums = t.lineitem.groupBy(F.col("l_orderkey").alias("order_key")).agg(
        agg.sum_where(flag == "A", _qty()).alias("kept"), agg.sum_where(flag != "N", _qty()).alias("total")
    )
    return sums.select("order_key", int_percent(F.col("kept"), F.col("total")).alias("percent"))


@query(
    "completion_flag",
    """select OrderNumber as order_number, case when sum(QtyReq) > sum(case when MP_ItemNo < 7 then QtyToFact end) then 0 else 1 end as is_finish
    from $purchase_status group by 1""",
)
def completion_flag(t):
    delivered = F.sum(F.when(F.col("MP_ItemNo") < 7, F.col("QtyToFact")))
    return t.purchase_status.groupBy(F.col("OrderNumber").alias("order_number")).agg(
        agg.is_finish(F.sum("QtyReq"), delivered).alias("is_finish")
    )


@query(
    "calendar_month_counts",
    """select cast(m as int) as month, (select count(*) from orders where year(o_orderdate) = 2001 and month(o_orderdate) = m and o_orderstatus = 'F') as finished,
      (select count(*) from orders where year(o_orderdate) = 2001 and month(o_orderdate) = m and o_orderstatus = 'O') as open
    from generate_series(1, 12) g(m)""",
)
def calendar_month_counts(t):
    rows = t.orders.where(year_cmp(F.col("o_orderdate"), "=", 2001))
    status = F.col("o_orderstatus")
    return agg.month_counts(rows, F.col("o_orderdate"), {"finished": status == "F", "open": status == "O"})


@query(
    "fanout_sum_guard",
    """select a.day, o.ProductionTeam as team, cast(sum(d.Qty) as bigint) as total_qty, count(distinct a.OrderNumber) as n_orders
    from (select cast(m.billDate as date) as day, m.OrderNumber from $qa_bill_master m group by 1, 2) a
    join $order_master o on o.OrderNumber = a.OrderNumber join $order_detail d on d.OrderNumber = a.OrderNumber group by 1, 2""",
)
def fanout_sum_guard(t):
    days = t.qa_bill_master.select(F.to_date("billDate").alias("day"), "OrderNumber").distinct()
    ordered = t.order_detail.groupBy("OrderNumber").agg(F.sum("Qty").alias("qty"))
    teams = t.order_master.select("OrderNumber", F.col("ProductionTeam").alias("team"))
    rows = days.join(ordered, "OrderNumber").join(teams, "OrderNumber")
    return rows.groupBy("day", "team").agg(F.sum("qty").alias("total_qty"), _count().alias("n_orders"))


# --- windows -----------------------------------------------------------------------------------

_TOTAL_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


@query(
    "row_number_display",
    f"""select l_orderkey as order_key, l_partkey as part_key, l_suppkey as supp_key, l_linenumber as line_no,
      row_number() over (partition by l_orderkey order by {", ".join(_TOTAL_ORDER)}) as display_no from lineitem""",
)
def row_number_display(t):
    rows = t.lineitem.select("l_orderkey", *_TOTAL_ORDER)
    return number_rows(rows, ["l_orderkey"], _TOTAL_ORDER, "display_no").select(
        F.col("l_orderkey").alias("order_key"), F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supp_key"),
        F.col("l_linenumber").alias("line_no"), "display_no",
    )


@query(
    "running_balance",
    """select order_key, day, qty, (select cast(sum(cast(l_quantity as int)) as bigint) from lineitem where l_orderkey = order_key)
        - cast(sum(qty) over (partition by order_key order by day) as bigint) as balance,
      cast(sum(qty) over (partition by order_key) as bigint) as total
    from (select l_orderkey as order_key, cast(l_shipdate as date) as day, cast(sum(cast(l_quantity as int)) as bigint) as qty
      from lineitem where l_returnflag <> 'N' group by 1, 2) a""",
)
def balance(t):
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("order_key"), F.to_date("l_shipdate").alias("day"), _qty().alias("qty"), "l_returnflag"
    )
    starts = lines.groupBy("order_key").agg(F.sum("qty").alias("ordered"))
    return running_balance(lines.where(F.col("l_returnflag") != "N"), starts, "order_key", "day", "qty", "ordered")


_FIFO_ORDER = ["order_key", *_TOTAL_ORDER[:1], *_TOTAL_ORDER[2:]]
_FIFO = """select *, greatest(0, least(open, coalesce(received, 0) - (upto - open))) as allocated from (
    select l.*, cast(sum(open) over (partition by part_key order by order_key, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_shipdate
        rows between unbounded preceding and current row) as bigint) as upto from (
      select l_partkey as part_key, l_orderkey as order_key, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_shipdate,
        cast(l_quantity as bigint) as qty_req, cast(l_quantity as bigint) * (l_linenumber % 3) // 2 as qty_to_fact,
        greatest(0, cast(l_quantity as bigint) - cast(l_quantity as bigint) * (l_linenumber % 3) // 2) as open from lineitem) l) a
    left join (select l_partkey as p, cast(sum(cast(l_quantity as int)) as bigint) // 2 as received from lineitem
      where l_returnflag = 'R' group by 1) r on part_key = p"""


def _fifo(t):
    lines = t.lineitem.select(
        F.col("l_partkey").alias("part_key"), F.col("l_orderkey").alias("order_key"), "l_linenumber", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_shipdate", F.col("l_quantity").cast("bigint").alias("qty_req"),
        F.call_function("div", F.col("l_quantity").cast("bigint") * (F.col("l_linenumber") % 3), F.lit(2)).alias("qty_to_fact"),
    )
    returned = t.lineitem.where(F.col("l_returnflag") == "R").groupBy(F.col("l_partkey").alias("part_key"))
    receipts = returned.agg(F.call_function("div", F.sum(_qty()), F.lit(2)).alias("received"))
    return fifo_allocate(receipts, lines, ["part_key"], _FIFO_ORDER)


@query(
    "fifo_allocate",
    f"""select part_key, order_key, l_linenumber as line_no, l_suppkey as supp_key, qty_req, qty_to_fact, allocated,
      qty_to_fact + allocated as new_delivered, qty_req - (qty_to_fact + allocated) as new_balance from ({_FIFO}) z""",
)
def fifo(t):
    return _fifo(t)["lines"].select(
        "part_key", "order_key", F.col("l_linenumber").alias("line_no"), F.col("l_suppkey").alias("supp_key"), "qty_req",
        "qty_to_fact", "allocated", "new_delivered", "new_balance",
    )


@query(
    "fifo_allocate_rest",
    f"""select part_key, count(case when allocated > 0 then 1 end) as n_history, cast(sum(allocated) as bigint) as allocated,
      greatest(coalesce(max(received), 0) - cast(sum(allocated) as bigint), 0) as rest from ({_FIFO}) z group by 1""",
)
def fifo_rest(t):
    result = _fifo(t)
    touched = result["history"].groupBy("part_key").agg(_count().alias("n_history"), F.sum("allocated").alias("allocated"))
    parts = t.lineitem.select(F.col("l_partkey").alias("part_key")).distinct()
    rows = left_default(parts, touched, ["part_key"], {"n_history": 0, "allocated": 0})
    return left_default(rows, result["rest"], ["part_key"], {"rest": 0})


@query(
    "next_revision",
    """with h as (select l_orderkey as k, l_linenumber as n, cast(l_shipdate as date) as d from lineitem where l_returnflag <> 'N'),
    c as (select l_orderkey as k, l_partkey * 1000 + l_suppkey as seq, case when l_linenumber = 1 then 'first' else 'last' end as target,
      min(l_partkey * 1000 + l_suppkey) over (partition by l_orderkey) as first_seq from lineitem where l_returnflag = 'N')
    select k as order_key, seq, target, case when target = 'first' then 1
      when not exists (select 1 from h where h.k = c.k) then case when seq = first_seq then 1 else 2 end
      when exists (select 1 from h where h.k = c.k and d = date '1998-06-15' and n <> 1)
        then (select max(n) from h where h.k = c.k and d = date '1998-06-15')
      else (select max(n) + 1 from h where h.k = c.k) end as revision from c""",
)
def revisions(t):
    history = t.lineitem.where(F.col("l_returnflag") != "N").select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("HistoryNo"), F.col("l_shipdate").alias("HistoryDate")
    )
    changes = t.lineitem.where(F.col("l_returnflag") == "N").select(
        F.col("l_orderkey").alias("order_key"),
        (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("seq"),
        F.when(F.col("l_linenumber") == 1, "first").otherwise("last").alias("target"),
    )
    return next_revision(changes, history, date(1998, 6, 15), key="order_key")


@query(
    "running_total",
    f"""select l_returnflag as flag, l_orderkey as order_key, l_linenumber as line_no, l_partkey as part_key, l_suppkey as supp_key,
      cast(sum(cast(l_quantity as int)) over (partition by l_returnflag order by l_orderkey, {", ".join(_TOTAL_ORDER)}
        rows between unbounded preceding and current row) as bigint) as upto from lineitem""",
)
def running(t):
    rows = t.lineitem.select("l_returnflag", "l_orderkey", *_TOTAL_ORDER)
    return running_total(rows, ["l_returnflag"], ["l_orderkey", *_TOTAL_ORDER], _qty(), "upto").select(
        F.col("l_returnflag").alias("flag"), F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supp_key"), "upto",
    )
