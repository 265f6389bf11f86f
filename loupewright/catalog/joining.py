"""Join operators on the driver's tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from loupewright.catalog.materials import HOLIDAYS, holidays
from loupewright.catalog.registry import AS_OF, D, query
from loupewright.operators import joins
from loupewright.operators.nesting import children_text, nest, nest_many, row_span



@query(
    "join_inner",
    """select o_orderkey as order_key, c_name as customer, n_name as nation, r_name as region
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
    join region on n_regionkey = r_regionkey""",
)
def join_inner(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(
        F.col("o_orderkey").alias("order_key"), F.col("c_name").alias("customer"),
        F.col("n_name").alias("nation"), F.col("r_name").alias("region"),
    )


@query(
    "join_left_default",
    """select o_orderkey as order_key, coalesce(n, 0) as n_lines, coalesce(last_flag, '-') as last_flag
    from orders left join (select l_orderkey, count(*) as n, max(l_returnflag) as last_flag from lineitem group by 1) a
      on o_orderkey = l_orderkey""",
)
def join_left_default(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("order_key")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.max("l_returnflag").alias("last_flag")
    )
    heads = t.orders.select(F.col("o_orderkey").alias("order_key"))
    return joins.left_default(heads, lines, ["order_key"], {"n_lines": 0, "last_flag": "-"})


@query(
    "join_composite_key",
    """select l_orderkey as order_key, l_linenumber as line_no, l_partkey as part_key, l_suppkey as supp_key, n as pair_lines,
      cast(l_quantity as int) as qty, pair_qty
    from lineitem join (select l_partkey as p, l_suppkey as s, count(*) as n, cast(sum(cast(l_quantity as int)) as bigint) as pair_qty
      from lineitem group by 1, 2) a on l_partkey = p and l_suppkey = s""",
)
def join_composite_key(t):
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"), F.col("l_quantity").cast("int").alias("qty"),
    )
    pairs = lines.groupBy("part_key", "supp_key").agg(F.count(F.lit(1)).alias("pair_lines"), F.sum("qty").alias("pair_qty"))
    return lines.join(pairs, ["part_key", "supp_key"])


@query(
    "join_role_playing",
    """select l_orderkey as order_key, l_linenumber as line_no, l_partkey as part_key, l_suppkey as supp_key,
      cn.n_name as customer_nation, sn.n_name as supplier_nation
    from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
    left join nation cn on c_nationkey = cn.n_nationkey left join nation sn on s_nationkey = sn.n_nationkey""",
)
def join_role_playing(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    name = F.col("n_name")
    roles = {"c": ("c_nationkey", {"customer_nation": name}), "s": ("s_nationkey", {"supplier_nation": name})}
    return joins.role_join(rows, t.nation, "n_nationkey", roles).select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"), "customer_nation", "supplier_nation",
    )


@query(
    "join_on_expression",
    """select d.BillID as bill_id, p.PDProcessName as process, n as bills_of_day from $repair_document d
    join $pd_process p on p.PDProcessCode = substring(d.RepairBillNo, 2, 2)
    join (select cast(JobDate as date) as day, count(*) as n from $repair_document group by 1) a on cast(d.JobDate as date) = a.day""",
)
def join_on_expression(t):
    rows = t.repair_document.select(
        "BillID", F.substring("RepairBillNo", 2, 2).alias("PDProcessCode"), F.to_date("JobDate").alias("day")
    )
    daily = t.repair_document.groupBy(F.to_date("JobDate").alias("day")).agg(F.count(F.lit(1)).alias("bills_of_day"))
    return rows.join(t.pd_process, "PDProcessCode").join(daily, "day").select(
        F.col("BillID").alias("bill_id"), F.col("PDProcessName").alias("process"), "bills_of_day"
    )


@query(
    "densify_cross",
    """select o_orderkey as order_key, c.code, coalesce(q, 0) as qty
    from orders cross join (values ('A'), ('N'), ('R')) c(code)
    left join (select l_orderkey, l_returnflag, cast(sum(cast(l_quantity as int)) as bigint) as q from lineitem group by 1, 2) a
      on l_orderkey = o_orderkey and l_returnflag = c.code""",
)
def densify_cross(t):
    facts = t.lineitem.select(
        F.col("l_orderkey").alias("order_key"), F.col("l_returnflag").alias("code"), F.col("l_quantity").cast("int").alias("qty")
    )
    heads = t.orders.select(F.col("o_orderkey").alias("order_key"))
    flags = t.spark.createDataFrame([("A",), ("N",), ("R",)], "code string")
    return joins.densify(heads, flags, "code", facts, ["order_key"], ["qty"])


@query(
    "join_preaggregated",
    """select o_orderkey as order_key, o_orderstatus as status, q as total_qty, d as last_ship
    from orders join (select l_orderkey, cast(sum(cast(l_quantity as int)) as bigint) as q, cast(max(l_shipdate) as date) as d
      from lineitem group by 1) a on o_orderkey = l_orderkey""",
)
def join_preaggregated(t):
    totals = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.col("l_quantity").cast("int")).alias("total_qty"), F.to_date(F.max("l_shipdate")).alias("last_ship")
    )
    rows = t.orders.join(totals, "o_orderkey")
    return rows.select(F.col("o_orderkey").alias("order_key"), F.col("o_orderstatus").alias("status"), "total_qty", "last_ship")


@query(
    "correlated_agg",
    """select o_orderkey as order_key,
      cast(coalesce((select sum(cast(l_quantity as int)) from lineitem where l_orderkey = o_orderkey), 0) as bigint) as total,
      coalesce((select count(*) from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R'), 0) as n_returned,
      (select cast(min(l_shipdate) as date) from lineitem where l_orderkey = o_orderkey) as first_ship,
      (select cast(max(l_shipdate) as date) from lineitem where l_orderkey = o_orderkey) as last_ship from orders""",
)
def correlated_agg(t):
    heads = t.orders.select(F.col("o_orderkey").alias("order_key"))
    lines = t.lineitem.withColumnRenamed("l_orderkey", "order_key")
    aggregates = {
        "total": F.sum(F.col("l_quantity").cast("int")),
        "n_returned": F.count(F.when(F.col("l_returnflag") == "R", 1)),
        "first_ship": F.to_date(F.min("l_shipdate")),
        "last_ship": F.to_date(F.max("l_shipdate")),
    }
    return joins.lookup_agg(heads, lines, ["order_key"], aggregates, {"total": 0, "n_returned": 0})


@query(
    "correlated_lookup_first",
    """select p_partkey as part_key, (select s_name from lineitem join supplier on l_suppkey = s_suppkey
      where l_partkey = p_partkey order by l_shipdate, l_suppkey limit 1) as supplier from part""",
)
def correlated_lookup_first(t):
    offers = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    offers = offers.select(F.col("l_partkey").alias("part_key"), "s_name", "l_shipdate", "l_suppkey")
    parts = t.part.select(F.col("p_partkey").alias("part_key"))
    return joins.lookup_first(parts, offers, ["part_key"], "s_name", ["l_shipdate", "l_suppkey"], "supplier")


@query(
    "range_count_join",
    f"""select OrderNumber as order_number, DueDate as due_date, (select count(*) from $holiday h
      where h.HolidayDate between least(o.DueDate, {D}) and greatest(o.DueDate, {D})) as n_holidays from $order_master o""",
    HOLIDAYS,
)
def range_count_join(t):
    cumulative = joins.cumulative_days(holidays(t.spark), "HolidayDate")
    rows = t.order_master.select(F.col("OrderNumber").alias("order_number"), F.col("DueDate").alias("due_date"))
    return joins.count_between(rows, cumulative, F.lit(AS_OF), F.col("due_date"), "n_holidays")


@query(
    "cumulative_asof_sum",
    """select t.OrderNumber as order_number, t.DueDate as due_date, t.HistoryNo as revision, t.Qty as qty,
      cast((select sum(cast(l_quantity as int)) from lineitem join $order_master m on m.OrderKey = l_orderkey
        where m.OrderNumber = t.OrderNumber and l_returnflag = 'R' and cast(l_shipdate as date) <= t.DueDate) as bigint) as returned
    from $due_fac_to_qa t""".replace("cast((select", "coalesce(cast((select").replace("as bigint) as returned", "as bigint), 0) as returned"),
)
def cumulative_asof_sum(t):
    lines = t.lineitem.where(F.col("l_returnflag") == "R").join(t.order_master, F.col("l_orderkey") == F.col("OrderKey"))
    facts = lines.select("OrderNumber", F.to_date("l_shipdate").alias("day"), F.col("l_quantity").cast("int").alias("v"))
    targets = t.due_fac_to_qa.select("OrderNumber", "DueDate", "HistoryNo", "Qty")
    return joins.cum_upto(targets, "OrderNumber", "DueDate", {"returned": (facts, "day", "v")}).select(
        F.col("OrderNumber").alias("order_number"), F.col("DueDate").alias("due_date"),
        F.col("HistoryNo").alias("revision"), F.col("Qty").alias("qty"), "returned",
    )


@query(
    "latest_revision_join",
    """select l_orderkey as order_key, l_linenumber as revision, l_partkey as part_key, l_suppkey as supp_key from lineitem a
    where l_linenumber = (select max(l_linenumber) from lineitem b where b.l_orderkey = a.l_orderkey)""",
)
def latest_revision_join(t):
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("revision"),
        F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supp_key"),
    )
    return joins.latest(rows, ["order_key"], "revision")


@query(
    "semi_join_in",
    """select c_custkey as customer, c_name as name from customer
    where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT' and o_orderstatus = 'O')""",
)
def semi_join_in(t):
    urgent = t.orders.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O"))
    customers = t.customer.select(F.col("c_custkey").alias("customer"), F.col("c_name").alias("name"))
    return joins.restrict(customers, urgent.select(F.col("o_custkey").alias("customer")), ["customer"])


@query(
    "nest_children",
    """select o_orderkey as order_key, (select count(*) from lineitem where l_orderkey = o_orderkey) as n,
      coalesce((select string_agg(l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || cast(l_quantity as int), ','
        order by l_linenumber, l_partkey, l_suppkey, cast(l_quantity as int)) from lineitem where l_orderkey = o_orderkey), '') as lines
    from orders""",
)
def nest_children(t):
    heads = t.orders.select(F.col("o_orderkey").alias("order_key"))
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("order_key"), "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("qty")
    )
    fields = ["l_linenumber", "l_partkey", "l_suppkey", "qty"]
    nested = nest(heads, lines, ["order_key"], fields, "lines")
    return nested.withColumns({"n": F.size("lines"), "lines": children_text(F.col("lines"), *fields)})


@query(
    "row_span",
    """select o_orderkey as order_key, a, n, r, greatest(a, n, r, 1) as span from (select o_orderkey,
      count(case when l_returnflag = 'A' then 1 end) as a, count(case when l_returnflag = 'N' then 1 end) as n,
      count(case when l_returnflag = 'R' then 1 end) as r from orders left join lineitem on l_orderkey = o_orderkey group by 1) x""",
)
def spans(t):
    heads = t.orders.select(F.col("o_orderkey").alias("order_key"))
    lines = t.lineitem.select(F.col("l_orderkey").alias("order_key"), "l_linenumber", "l_partkey", "l_returnflag")
    children = [(lines.where(F.col("l_returnflag") == f), ["l_linenumber", "l_partkey"], f.lower()) for f in ("A", "N", "R")]
    nested = nest_many(heads, children, ["order_key"])
    arrays = [F.col(c) for c in ("a", "n", "r")]
    return nested.select("order_key", *[F.size(c).alias(n) for c, n in zip(arrays, ("a", "n", "r"))], row_span(*arrays).alias("span"))
