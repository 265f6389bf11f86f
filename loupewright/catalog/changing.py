"""Change application on the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loupewright.catalog.registry import query
from loupewright.operators import changes as C
from loupewright.operators.nesting import nest
from loupewright.sources.bucketed import BucketedSnapshot
from loupewright.sources.session import shared_folder



def _count():
    return F.count(F.lit(1))



@query(
    "apply_upserts",
    """select o_orderkey, o_custkey, o_orderstatus, cents from (
      select o_orderkey, o_custkey, o_orderstatus, cast(round(o_totalprice * 100) as bigint) as cents from orders
        where o_orderstatus <> 'P' and o_orderpriority <> '1-URGENT'
      union all select o_orderkey, o_custkey, 'C', cast(round(o_totalprice * 100) as bigint) + 200 from orders
        where o_orderstatus = 'P' or o_orderpriority = '1-URGENT'
      union all select -o_orderkey - 1, o_custkey, 'I', cast(round(o_totalprice * 100) as bigint) from orders where o_orderpriority = '5-LOW') a""",
)
def upserts(t):
    snapshot, updates, inserts = _order_changes(t)
    return C.apply_upserts(snapshot, updates.unionByName(inserts), ["o_orderkey"], ["seq"])


def _order_changes(t):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    snapshot = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", cents.alias("cents"))
    touched = t.orders.where((F.col("o_orderstatus") == "P") | (F.col("o_orderpriority") == "1-URGENT"))
    updates = touched.select("o_orderkey", "o_custkey", F.lit("C").alias("o_orderstatus"), cents.alias("cents"))
    updates = updates.withColumn("seq", F.explode(F.array(F.lit(1), F.lit(2))))
    updates = updates.withColumn("cents", F.col("cents") + F.col("seq") * 100)
    inserts = t.orders.where(F.col("o_orderpriority") == "5-LOW").select(
        (-F.col("o_orderkey") - 1).alias("o_orderkey"), "o_custkey", F.lit("I").alias("o_orderstatus"),
        cents.alias("cents"), F.lit(1).alias("seq"),
    )
    return snapshot, updates, inserts


@query(
    "apply_changes_stored",
    """select o_orderkey, o_custkey, o_orderstatus, cents from (
      select o_orderkey, o_custkey, o_orderstatus, cast(round(o_totalprice * 100) as bigint) as cents from orders
        where o_orderstatus <> 'P' and o_orderpriority <> '1-URGENT'
      union all select o_orderkey, o_custkey, 'C', cast(round(o_totalprice * 100) as bigint) + 200 from orders
        where o_orderstatus = 'P' or o_orderpriority = '1-URGENT'
      union all select -o_orderkey - 1, o_custkey, 'I', cast(round(o_totalprice * 100) as bigint) from orders where o_orderpriority = '5-LOW') a
    where o_custkey not in (select c_custkey from customer where c_nationkey = 7)""",
)
def stored_changes(t):
    """A stored snapshot in buckets: written, changed, added to, and cut, each batch at the buckets it touches."""
    snapshot, updates, inserts = _order_changes(t)
    table = BucketedSnapshot(t.spark, f"{shared_folder(t.spark)}/orders-{uuid.uuid4().hex}", snapshot.schema, ["o_orderkey"])
    table.upsert(snapshot.withColumn("seq", F.lit(0)), ["seq"], "first")
    for name, batch in (("updates", updates), ("inserts", inserts), ("updates", updates)):
        table.upsert(batch, ["seq"], name)
    of_nation = t.spark.read.parquet(f"{t.folder}/customer.parquet").where("c_nationkey = 7").select(F.col("c_custkey").alias("o_custkey"))
    table.delete(table.read().join(of_nation, "o_custkey", "left_semi"), "nation 7")
    return table.read()


@query(
    "apply_upserts_partial",
    """select o_orderkey, o_custkey, case when o_orderpriority = '3-MEDIUM' then 'D' else o_orderstatus end as o_orderstatus,
      case when o_orderpriority = '3-MEDIUM' then null else o_orderpriority end as o_orderpriority from orders""",
)
def updates(t):
    snapshot = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    touched = snapshot.where(F.col("o_orderpriority") == "3-MEDIUM").select(
        "o_orderkey", F.lit("D").alias("o_orderstatus"), F.lit(None).cast("string").alias("o_orderpriority"), F.lit(1).alias("seq")
    )
    return C.apply_updates(snapshot, touched, ["o_orderkey"], ["seq"], ["o_orderstatus", "o_orderpriority"])


@query(
    "apply_deletes_cascade",
    """with gone as (select o_orderkey as k from orders where o_orderstatus = 'F' and o_orderpriority in ('1-URGENT', '2-HIGH'))
    select 'master' as part, count(*) as n, cast(sum(o_orderkey) as bigint) as key_sum from orders where o_orderkey not in (select k from gone)
    union all select 'detail', count(*), cast(sum(l_orderkey) as bigint) from lineitem where l_orderkey not in (select k from gone)
    union all select 'returned', count(*), cast(sum(l_orderkey) as bigint) from lineitem where l_returnflag = 'R' and l_orderkey not in (select k from gone)""",
)
def deletes(t):
    gone = t.orders.where((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    detail = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    tables = {"master": t.orders, "detail": detail, "returned": detail.where(F.col("l_returnflag") == "R")}
    result = None
    for name, kept in C.cascade_delete(tables, gone, ["o_orderkey"]).items():
        part = kept.agg(_count().alias("n"), F.sum("o_orderkey").alias("key_sum")).select(F.lit(name).alias("part"), "n", "key_sum")
        result = part if result is None else result.union(part)
    return result


@query(
    "apply_increments",
    """select m.OrderNumber as order_number, m.OrderItemNo as item_no, m.InvCode as inv_code,
      cast(m.QtyFacReceive + coalesce((select sum(x.SendQty) from $bill_master b join $bill_detail d on b.Bill_ID = d.Bill_ID
        join $bill_material x on b.Bill_ID = x.Bill_ID and d.ItemNo = x.ItemNo join $job_order j on d.JobNumber = j.JobNumber
        where b.OrderNumber = m.OrderNumber and j.OrderItemNo = m.OrderItemNo and x.InvCode = m.InvCode), 0) as bigint) as qty
    from $mpp_status_product m""",
)
def increments(t):
    keys = ["OrderNumber", "OrderItemNo", "InvCode"]
    deltas = (
        t.bill_master.select("Bill_ID", "OrderNumber")
        .join(t.bill_detail.select("Bill_ID", "ItemNo", "JobNumber"), "Bill_ID")
        .join(t.bill_material.select("Bill_ID", "ItemNo", "InvCode", "SendQty"), ["Bill_ID", "ItemNo"])
        .join(t.job_order.select("JobNumber", "OrderItemNo"), "JobNumber")
    )
    target = t.mpp_status_product.select(*keys, "QtyFacReceive")
    result = C.apply_increments(target, deltas, keys, "QtyFacReceive", "SendQty")
    return result.select(
        F.col("OrderNumber").alias("order_number"), F.col("OrderItemNo").alias("item_no"), F.col("InvCode").alias("inv_code"),
        F.col("QtyFacReceive").alias("qty"),
    )


_HEADER = "select 'header' as part, m.qaRepair_ID as id, 0 as item, {state} as status, cast(0 as bigint) as done, cast(0 as bigint) as to_qa from $qa_repair_master m"
_DETAIL = "select 'detail' as part, d.qaRepair_ID as id, d.repair_Item as item, '' as status, {done} as done, {to_qa} as to_qa from $qa_repair_detail d"


def _roll(headers, details):
    top = headers.select(
        F.lit("header").alias("part"), F.col("qaRepair_ID").alias("id"), F.lit(0).alias("item"), F.col("qaRepairStatus").alias("status"),
        F.lit(0).cast("bigint").alias("done"), F.lit(0).cast("bigint").alias("to_qa"),
    )
    below = details.select(
        F.lit("detail").alias("part"), F.col("qaRepair_ID").alias("id"), F.col("repair_Item").alias("item"), F.lit("").alias("status"),
        F.col("RepairFinish").alias("done"), F.col("ToQa").alias("to_qa"),
    )
    return top.unionByName(below)


_SENT_BACK = "(select x.qaRepairStatus from $qa_repair_master x where x.qaRepair_ID = {a}.qaRepair_ID) = '2'"


@query(
    "status_rollup",
    _HEADER.format(
        state=f"""case when m.qaRepairStatus = '2' and exists (select 1 from $qa_repair_detail d where d.qaRepair_ID = m.qaRepair_ID and d.ToQa > 0)
          then case when (select sum(d.Qty) = sum(d.RepairFinish + d.ToQa) from $qa_repair_detail d where d.qaRepair_ID = m.qaRepair_ID)
            then '3' else '1' end else m.qaRepairStatus end"""
    )
    + " union all "
    + _DETAIL.format(
        done=f"case when {_SENT_BACK.format(a='d')} then d.RepairFinish + d.ToQa else d.RepairFinish end",
        to_qa=f"case when {_SENT_BACK.format(a='d')} then 0 else d.ToQa end",
    ),
)
def receive(t):
    back = t.qa_repair_master.where(F.col("qaRepairStatus") == "2").select("qaRepair_ID")
    events = t.qa_repair_detail.join(back, "qaRepair_ID", "left_semi")
    result = C.repair_receive(t.qa_repair_master, t.qa_repair_detail, events)
    return _roll(result["headers"], result["details"])


@query(
    "status_rollup_send",
    _HEADER.format(state="case when m.qaRepairStatus = '1' then '2' else m.qaRepairStatus end")
    + " union all "
    + _DETAIL.format(
        done="d.RepairFinish",
        to_qa="""d.ToQa + case when (select x.qaRepairStatus from $qa_repair_master x where x.qaRepair_ID = d.qaRepair_ID) = '1'
          then greatest(d.Qty - d.RepairFinish - d.ToQa, 0) else 0 end""",
    ),
)
def send(t):
    repairing = t.qa_repair_master.where(F.col("qaRepairStatus") == "1").select("qaRepair_ID")
    events = t.qa_repair_detail.join(repairing, "qaRepair_ID", "left_semi").select(
        "qaRepair_ID", "repair_Item", (F.col("Qty") - F.col("RepairFinish") - F.col("ToQa")).alias("sent")
    )
    result = C.repair_send(t.qa_repair_master, t.qa_repair_detail, events)
    return _roll(result["headers"], result["details"])


@query(
    "status_rollup_cancel",
    _HEADER.format(state="case when m.qaRepairStatus = '2' then '1' else m.qaRepairStatus end")
    + " union all "
    + _DETAIL.format(done="d.RepairFinish", to_qa=f"case when {_SENT_BACK.format(a='d')} then 0 else d.ToQa end"),
)
def cancel(t):
    bills = t.qa_repair_master.where(F.col("qaRepairStatus") == "2")
    result = C.repair_cancel(t.qa_repair_master, t.qa_repair_detail, bills)
    return _roll(result["headers"], result["details"])


_TRANSITIONS = """with known as (select OrderNo, ItemNo, count(*) as n from $mold_history where StatusFrom < 3 group by 1, 2),
    log as (select h.OrderNo, h.ItemNo, h.StatusTo, h.Reference, h.Updater, h.Qty, h.UpdateDate, coalesce(k.n, 0) + row_number() over (
      partition by h.OrderNo, h.ItemNo order by h.UpdateDate, h.Reference, h.Updater, h.Qty) as no
      from $mold_history h left join known k on h.OrderNo = k.OrderNo and h.ItemNo = k.ItemNo where h.StatusFrom >= 3)"""


def _transition(t):
    keys = ["OrderNo", "ItemNo"]
    old = t.mold_history.where(F.col("StatusFrom") < 3).groupBy(*keys).agg(_count().alias("UpdateNo"))
    new = t.mold_history.where(F.col("StatusFrom") >= 3)
    snapshot = t.mpp_status.select(F.col("OrderNumber").alias("OrderNo"), F.col("OrderItemNo").alias("ItemNo"), "MoldStatus")
    return C.transition(snapshot, new, old, keys, ["UpdateDate", "Reference", "Updater", "Qty"], "MoldStatus", "StatusTo")


@query(
    "status_transition_log",
    "select * from (" + _TRANSITIONS + " select OrderNo as order_number, ItemNo as item_no, StatusTo as status, Reference as reference, no as update_no from log) a",
)
def transition_log(t):
    return _transition(t)["history"].select(
        F.col("OrderNo").alias("order_number"), F.col("ItemNo").alias("item_no"), F.col("StatusTo").alias("status"),
        F.col("Reference").alias("reference"), F.col("UpdateNo").alias("update_no"),
    )


@query(
    "status_transition_log_snapshot",
    "select * from ("
    + _TRANSITIONS
    + """ select s.OrderNumber as order_number, s.OrderItemNo as item_no, coalesce(l.StatusTo, s.MoldStatus) as status from $mpp_status s
      left join log l on l.OrderNo = s.OrderNumber and l.ItemNo = s.OrderItemNo
        and l.no = (select max(x.no) from log x where x.OrderNo = s.OrderNumber and x.ItemNo = s.OrderItemNo)) a""",
)
def transition_snapshot(t):
    return _transition(t)["snapshot"].select(
        F.col("OrderNo").alias("order_number"), F.col("ItemNo").alias("item_no"), F.col("MoldStatus").alias("status")
    )


@query(
    "assign_document_numbers",
    """with d as (select BillID, DocPrefix, Status, JobDate from $repair_document),
    used as (select DocPrefix, max(BillID % 1000) as n from d where Status = '3' group by 1),
    numbered as (select d.BillID, d.DocPrefix, cast(coalesce(u.n, 0) + row_number() over (partition by d.DocPrefix order by d.JobDate, d.BillID) as string) as x
      from d left join used u on d.DocPrefix = u.DocPrefix where d.Status <> '3')
    select BillID as bill_id, DocPrefix || lpad(x, cast(greatest(5, length(x)) as int), '0') as document from numbered""".replace(
        "with d as", "select * from (with d as"
    )
    + ") z",
)
def document_numbers(t):
    documents = t.repair_document.select("BillID", "DocPrefix", "Status", "JobDate")
    old = documents.where(F.col("Status") == "3").select(
        "DocPrefix", F.concat("DocPrefix", F.lpad((F.col("BillID") % 1000).cast("string"), 5, "0")).alias("document")
    )
    new = documents.where(F.col("Status") != "3")
    numbered = C.assign_numbers(new, old, "DocPrefix", ["JobDate", "BillID"], "document", 5)
    return numbered.select(F.col("BillID").alias("bill_id"), "document")


@query(
    "assign_document_numbers_parallel",
    """select * from (with d as (select BillID, DocPrefix, Status, JobDate from $repair_document),
    used as (select DocPrefix, max(BillID % 1000) as n from d where Status = '3' group by 1),
    numbered as (select d.BillID, d.DocPrefix, cast(coalesce(u.n, 0) + row_number() over (partition by d.DocPrefix order by d.Status, d.JobDate, d.BillID) as string) as x
      from d left join used u on d.DocPrefix = u.DocPrefix where d.Status <> '3')
    select BillID as bill_id, DocPrefix || lpad(x, cast(greatest(5, length(x)) as int), '0') as document from numbered) z""",
)
def document_numbers_parallel(t):
    """A batch for each status but the last, which reserve their numbers in a ledger; the first one is run again."""
    path = f"{shared_folder(t.spark)}/numbers-{uuid.uuid4().hex}"
    documents = t.repair_document.select("BillID", "DocPrefix", "Status", "JobDate")
    old = documents.where(F.col("Status") == "3").select(
        "DocPrefix", F.concat("DocPrefix", F.lpad((F.col("BillID") % 1000).cast("string"), 5, "0")).alias("document")
    )
    batches = {}
    for status in ("0", "1", "2", "0"):
        new = documents.where(F.col("Status") == status)
        batches[status] = C.number_documents(new, path, f"status {status}", "DocPrefix", ["JobDate", "BillID"], 5, old)
    return batches["0"].union(batches["1"]).union(batches["2"]).select(F.col("BillID").alias("bill_id"), "document")


@query(
    "explode_document_quarantine",
    """select o_orderkey as order_key, case o_orderkey % 9 when 0 then 'not JSON' when 1 then 'wrong type' when 2 then 'missing field'
        when 3 then 'incomplete item' when 4 then 'empty' when 5 then 'incomplete reason' end as reason,
      case when o_orderkey % 9 >= 6 then 1 else 0 end as masters, case when o_orderkey % 9 >= 6 then 2 else 0 end as details
    from orders""",
)
def quarantine(t):
    """Six of nine documents are broken, each kind in its own way; every document comes out once, whole or rejected."""
    key = F.col("o_orderkey").cast("string")
    whole = F.concat(F.lit('{"document_id":'), key, F.lit(',"order_number":"A","items":[{"product_id":1,"qty":2},{"product_id":2,"qty":1,"reasons":[]}]}'))
    kind = F.col("o_orderkey") % 9
    text = (
        F.when(kind == 0, F.substring(whole, 1, 40))
        .when(kind == 1, F.replace(whole, F.lit('"qty":1'), F.lit('"qty":"one"')))
        .when(kind == 2, F.replace(whole, F.lit('"order_number"'), F.lit('"order"')))
        .when(kind == 3, F.replace(whole, F.lit(',"qty":2'), F.lit("")))
        .when(kind == 4, F.lit(" "))
        .when(kind == 5, F.replace(whole, F.lit('"reasons":[]'), F.lit('"reasons":[{"type_id":1,"qty":1}]')))
        .otherwise(whole)
    )
    parts = C.shred(t.orders.select("o_orderkey", text.alias("text")), "text")
    masters = parts["master"].select(F.col("document_id").alias("order_key"), F.lit(1).alias("masters"), F.lit(0).alias("details"), F.lit(None).cast("string").alias("reason"))
    details = parts["detail"].select("document_id", F.lit(0), F.lit(1), F.lit(None).cast("string"))
    rejected = parts["quarantine"].select("o_orderkey", F.lit(0), F.lit(0), "reason")
    counted = masters.union(details).union(rejected).groupBy("order_key")
    whole_int = lambda c: F.sum(c).cast("int").alias(c)
    return counted.agg(F.max("reason").alias("reason"), whole_int("masters"), whole_int("details"))


@query(
    "explode_document",
    """select * from (with i as (select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint)) as item_no,
      l_partkey as p, l_suppkey as s, cast(l_quantity as bigint) as q from lineitem)
    select 'master' as part, k as document_id, cast(count(*) as int) as item_no, cast(null as bigint) as product_id, cast(null as bigint) as qty,
        cast(null as int) as type_id, cast(null as int) as reason_no from i group by k
    union all select 'detail', k, cast(item_no as int), p, q, null, null from i
    union all select 'reason', k, cast(item_no as int), null, q, cast(p % 5 + 1 as int), cast(s % 6 + 1 as int) from i
    union all select 'reason', k, cast(item_no as int), null, q - 25, cast(p % 5 + 1 as int), 9 from i where q > 25) z""",
)
def explode_document(t):
    quantity = F.col("l_quantity").cast("bigint")
    reason = lambda no, amount: F.struct(
        (F.col("l_partkey") % 5 + 1).cast("int").alias("type_id"), no.cast("int").alias("reason_no"), amount.alias("qty")
    )
    single = F.array(reason(F.col("l_suppkey") % 6 + 1, quantity))
    both = F.array(reason(F.col("l_suppkey") % 6 + 1, quantity), reason(F.lit(9), quantity - 25))
    items = t.lineitem.select(
        F.col("l_orderkey").alias("document_id"), "l_linenumber", F.col("l_partkey").alias("product_id"), "l_suppkey",
        quantity.alias("qty"), F.when(quantity > 25, both).otherwise(single).alias("reasons"),
    )
    heads = t.lineitem.select(F.col("l_orderkey").alias("document_id")).distinct()
    heads = heads.withColumns({"order_number": F.lit("CH-1"), "sender": F.lit(1).cast("bigint")})
    fields = ["l_linenumber", "product_id", "l_suppkey", "qty", "reasons"]
    documents = nest(heads, items, ["document_id"], fields, "items")
    parts = C.shred(documents.select(F.to_json(F.struct("document_id", "order_number", "sender", "items")).alias("text")), "text")
    none_long, none_int = F.lit(None).cast("bigint"), F.lit(None).cast("int")
    master = parts["master"].select(
        F.lit("master").alias("part"), "document_id", F.col("n_items").alias("item_no"), none_long.alias("product_id"),
        none_long.alias("qty"), none_int.alias("type_id"), none_int.alias("reason_no"),
    )
    detail = parts["detail"].select(
        F.lit("detail").alias("part"), "document_id", "item_no", "product_id", "qty", none_int.alias("type_id"), none_int.alias("reason_no")
    )
    reasons = parts["reason"].select(
        F.lit("reason").alias("part"), "document_id", "item_no", none_long.alias("product_id"), "qty", "type_id", "reason_no"
    )
    return master.union(detail).union(reasons)
