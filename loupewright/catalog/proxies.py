"""Domain tables derived from the driver's tables.

The driver has no factory tables, so each is a plain derivation of ``orders``, ``lineitem``,
``part`` and so on, written in SQL that Spark and DuckDB both run. ``$name`` stands for a table.
Line items are grouped to the key a domain table has (order, item, bill, process, material), so the
derived tables keep the size and the skew of the data they come from.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loupewright.sources.session import configure
from loupewright.sources.tables import SCHEMAS, load


def order_number(key: str) -> str:
    """Order number text of an order key: four classes by the last digit, and fifteen digits.

    Adding 10^15 gives the leading zeros with a single cast; this text is built for every line item.
    """
    digits = f"substring(cast({key} + 1000000000000000 as string), 2)"
    prefix = f"case {key} % 10 when 0 then 'CH-M-' when 1 then 'CH-TEST' when 2 then 'XX-' else 'CH-' end"
    return f"concat({prefix}, {digits})"


_QTY = "cast(l_quantity as int)"
_BILL = "l_orderkey * 4 + l_suppkey % 4"
_ON = order_number("l_orderkey")
_JOB = "concat('J', cast(l_orderkey as string), '-', cast(l_linenumber as string))"


def _sum(condition: str = "true") -> str:
    return f"cast(coalesce(sum(case when {condition} then {_QTY} end), 0) as bigint)"


_CLOCK = "concat(lpad(cast({h} % 24 as string), 2, '0'), lpad(cast({m} % 60 as string), 2, '0'), '07')"

PROXIES: dict[str, str] = {
    "order_master": f"""
        select {order_number("o_orderkey")} as OrderNumber, o_orderkey as OrderKey,
               cast(o_orderdate as date) as OrderDate,
               cast(o_orderdate as date) + cast(30 + o_orderkey % 45 as int) as DueDate,
               cast(o_orderdate as date) + cast(23 + o_orderkey % 45 as int) as FactoryDue,
               o_custkey as CusCode, left(o_orderpriority, 1) as ProductionTeam,
               case o_orderstatus when 'O' then '2' when 'P' then '1' else '3' end as Status
        from $orders""",
    "order_detail": f"""
        select {_ON} as OrderNumber, l_linenumber as ItemNo, min(l_partkey) as ProductID,
               {_sum()} as Qty, min(l_suppkey) % 3 as ForSort
        from $lineitem group by l_orderkey, l_linenumber""",
    "order_product_detail": f"""
        select {_ON} as OrderNumber, l_partkey as InvCode,
               case l_partkey % 4 when 0 then '07' when 1 then '12' when 2 then '15' else '02' end as InvGroupCode,
               {_sum()} as Qty
        from $lineitem group by l_orderkey, l_partkey""",
    "job_order": f"""
        select {_JOB} as JobNumber, {_ON} as OrderNumber, l_linenumber as OrderItemNo,
               min(l_partkey) as ProductID, {_sum()} as JobQty
        from $lineitem group by l_orderkey, l_linenumber""",
    "job_status": f"""
        select {_JOB} as JobNumber, lpad(cast((l_partkey + l_suppkey) % 22 + 1 as string), 2, '0') as PDProcessCode,
               {_sum("l_returnflag = 'A'")} as In_Q, {_sum("l_returnflag = 'N'")} as Out_Q,
               {_sum("l_returnflag = 'R' and l_linestatus = 'F'")} as Send_Q, count(*) as Receive_Q
        from $lineitem
        group by l_orderkey, l_linenumber, lpad(cast((l_partkey + l_suppkey) % 22 + 1 as string), 2, '0')""",
    "customer_master": """
        select c_custkey as CusCode,
               case c_mktsegment when 'AUTOMOBILE' then '1' when 'BUILDING' then '2' when 'MACHINERY' then '3'
                    else '4' end as CusStatus
        from $customer""",
    "product_master": """
        select p_partkey as ProductID, concat('P', cast(p_partkey as string)) as ProductCode, p_name as ProductDesc,
               concat('D:', chr(92), p_brand, chr(92), p_type, '.jpg') as NewPict,
               case when p_size % 5 = 0 then '' else concat(p_type, '-', cast(p_size as string)) end as CastingNo,
               cast(p_size as double) as NetWeightCal,
               cast(p_size + 1 as double) as CastingCost, cast(p_size + 2 as double) as PolishingCost,
               cast(p_size + 3 as double) as PlattingCost, cast(p_size + 4 as double) as SandCost,
               cast(p_size + 5 as double) as RhodiumCost, cast(p_size + 6 as double) as OtherCost,
               cast(p_size + 7 as double) as PackingCost, cast(p_size + 8 as double) as QcCost,
               cast(p_size + 9 as double) as AdminCost
        from $part""",
    "product_detail": """
        select l_partkey as ProductID, l_suppkey as InvCode, count(*) as Qty,
               concat('S', cast((l_partkey + l_suppkey) % 2 as string)) as SettingTypeCode
        from $lineitem group by l_partkey, l_suppkey""",
    "inv_master": """
        select p_partkey as InvCode, p_name as InvDescE,
               case p_partkey % 8 when 0 then '02' when 1 then '03' when 2 then '04' when 3 then '05' when 4 then '06'
                    when 5 then '07' when 6 then '12' else '15' end as InvGroupCode,
               case p_partkey % 3 when 0 then 'Q' when 1 then 'W' else '' end as PriceType,
               cast(p_size as double) as WgUnit, 'gram' as WgUnitName, 'piece' as QtyUnit, p_brand as StoneShapeCode,
               concat('Z', cast(p_size % 3 as string)) as StoneSizeCode,
               concat('D:', chr(92), p_brand, chr(92), 'stone.jpg') as InvPict
        from $part""",
    "inv_cost": """
        select p_partkey as InvCode, cast(p_partkey % 90 + 1 as double) as StdPrice,
               cast(p_partkey % 90 + 3 as double) as StdPrice2
        from $part where p_partkey % 10 <> 9""",
    "stone_setting_cost": """
        select distinct p_brand as StoneShapeCode, concat('Z', cast(p_size % 3 as string)) as StoneSizeCode,
               'S0' as SettingTypeCode, cast(p_size % 3 + 1 as double) as Cost
        from $part""",
    "supplier_master": "select s_suppkey as SupplierCode, s_name as SupplierName from $supplier",
    "employee": """
        select s_suppkey as EmpCode, s_name as EmpFName, s_name as EmpFullName,
               case when s_suppkey % 11 = 0 then null else concat('N', cast(s_suppkey % 7 as string)) end as NickName,
               concat('D:', chr(92), 'staff', chr(92), cast(s_suppkey as string), '#.jpg') as EmpPict,
               s_nationkey as DepartmentCode, s_suppkey % 5 as PositionCode
        from $supplier""",
    "purchase_status": f"""
        select {_ON} as OrderNumber, l_linenumber as MP_ItemNo, min(l_partkey) as InvCode,
               min(l_suppkey) as SupplierCode, {_sum()} as QtyReq, {_sum("l_returnflag <> 'A'")} as QtyPurchase,
               {_sum("l_returnflag = 'R'")} as QtyPcReceive,
               {_sum(f"l_linenumber % 3 = 1 and {_QTY} % 2 = 0")}
                 + case when l_linenumber % 3 = 2 then {_sum()} else 0 end as QtyToFact,
               case when l_linenumber = 7 then date '1900-01-01' else cast(max(l_shipdate) as date) end as SupDueDate,
               cast(max(l_shipdate) as date) + 3 as FactDueDate, l_orderkey * 10 + l_linenumber as PcID
        from $lineitem group by l_orderkey, l_linenumber""",
    "pc_master": """
        select o_orderkey * 10 + 1 as PcID, concat('PC', cast(o_orderkey as string)) as PcDocNumber,
               cast(o_orderdate as date) as DocDate
        from $orders""",
    "material_plan": f"""
        select {_ON} as OrderNumber, l_partkey as InvCode, min(l_suppkey) as SupplierSelect, {_sum()} as QtyReq
        from $lineitem group by l_orderkey, l_partkey""",
    "purchase_history": f"""
        select {_ON} as OrderNumber, l_linenumber as MP_ItemNo, l_partkey as InvCode, l_suppkey as EmpCode,
               case l_returnflag when 'R' then '03' else '05' end as HistoryTypeCode,
               cast(l_shipdate as date) as HistoryDate, {_CLOCK.format(h="l_partkey", m="l_suppkey")} as HistoryTime,
               cast(l_shipdate as date) - 9 as SupFromDate, cast(l_shipdate as date) - 2 as SupToDate,
               cast(l_shipdate as date) - 5 as FacFromDate, cast(l_shipdate as date) as FacToDate,
               cast(l_suppkey % 30 as int) as SupReasonItemNo, cast(l_partkey % 30 as int) as FacReasonItemNo,
               {_QTY} as Qty
        from $lineitem""",
    "plan_reason": "select n_nationkey as ItemNo, n_name as Description from $nation",
    "mpp_status": f"""
        select {_ON} as OrderNumber, l_linenumber as OrderItemNo, min(l_partkey) as ProductID, {_sum()} as Qty,
               case when l_linenumber > 5 then 99 else l_linenumber end as Piority,
               cast(min(l_suppkey) % 6 as int) as MoldStatus
        from $lineitem group by l_orderkey, l_linenumber""",
    "mold_status": "select r_regionkey as StatusCode, r_name as StatusName, 9 - r_regionkey as SortBy from $region",
    "mold_history": f"""
        select {_ON} as OrderNo, l_linenumber as ItemNo, cast(l_suppkey % 6 as int) as StatusFrom,
               cast(l_partkey % 6 as int) as StatusTo, l_suppkey as Updater, cast(l_shipdate as date) as UpdateDate,
               l_partkey as Reference, {_QTY} as Qty
        from $lineitem""",
    "mpp_status_product": f"""
        select {_ON} as OrderNumber, l_linenumber as OrderItemNo, l_partkey as InvCode, count(*) as QtyReq,
               {_sum("l_returnflag = 'R'")} as QtyReceive, {_sum("l_returnflag <> 'N'")} as QtyFacReceive,
               case when l_partkey % 2 = 0 then '1' else '' end as IsWaxSet
        from $lineitem group by l_orderkey, l_linenumber, l_partkey""",
    "bill_master": f"""
        select {_BILL} as Bill_ID, concat('B', cast({_BILL} as string)) as BillNumber,
               cast(min(l_shipdate) as date) as BillDate, {_CLOCK.format(h="l_orderkey", m="min(l_suppkey)")} as BillTime,
               {_ON} as OrderNumber,
               case l_suppkey % 4 when 3 then 'W' else cast(l_suppkey % 4 + 1 as string) end as FactoryTeam,
               min(l_suppkey) as Sender,
               case when l_suppkey % 4 = 0 then null else max(l_suppkey) end as Receiver,
               case when l_suppkey % 4 = 0 then null else cast(max(l_shipdate) as date) end as ReceiveDate,
               case when l_suppkey % 4 = 0 then '' else '101500' end as ReceiveTime,
               case l_suppkey % 4 when 0 then '' when 1 then '1' when 2 then '2' else '3' end as BillStatus
        from $lineitem group by l_orderkey, l_suppkey % 4""",
    "bill_detail": f"""
        select {_BILL} as Bill_ID, l_linenumber as ItemNo, {_JOB} as JobNumber, min(l_partkey) % 3 as forSort
        from $lineitem group by l_orderkey, l_suppkey % 4, l_linenumber""",
    "bill_material": f"""
        select {_BILL} as Bill_ID, l_linenumber as ItemNo, l_partkey as InvCode,
               {_sum("l_returnflag <> 'N'")} as SendQty, min(l_linestatus) as MatStatus
        from $lineitem group by l_orderkey, l_suppkey % 4, l_linenumber, l_partkey""",
    "batch_purchase": f"""
        select {_ON} as OrderNumber, l_partkey as InvCode, l_linenumber as LotNumber,
               min(l_suppkey) as PurchasePerson
        from $lineitem group by l_orderkey, l_partkey, l_linenumber""",
    "batch_detail": f"""
        select {_ON} as OrderNumber, l_partkey as InvCode, l_linenumber as LotNumber, l_suppkey as Source,
               concat('BT', cast(l_suppkey % 50 as string)) as BatchNumber, {_QTY} as BatchQty,
               cast(l_shipdate as date) as PackDate, l_linestatus as BatchStatus
        from $lineitem""",
    "qa_bill_master": f"""
        select {_BILL} as qaBill_ID, concat('QB', cast({_BILL} as string)) as qaDocNumber,
               min(l_shipdate) as billDate, {_ON} as OrderNumber,
               case l_suppkey % 4 when 0 then '' when 3 then '3' else '1' end as qaBillStatus,
               min(l_suppkey) as SenderNew, case when l_suppkey % 4 = 0 then null else max(l_suppkey) end as ReceiverNew,
               case when l_suppkey % 4 = 0 then null else max(l_shipdate) end as receiveDate
        from $lineitem group by l_orderkey, l_suppkey % 4""",
    "qa_bill_detail": f"""
        select {_BILL} as qaBill_ID, l_linenumber as bill_Item, {_ON} as OrderNumber, l_linenumber as OrderItemNo,
               min(l_partkey) as ProductID, {_sum()} as Qty, min(l_suppkey) as QCPerson,
               concat('BQ', cast({_BILL} as string), '-', cast(l_linenumber as string)) as qaJobNumber
        from $lineitem group by l_orderkey, l_suppkey % 4, l_linenumber""",
    "qa_finish_master": f"""
        select {_BILL} as qaFinish_ID, {_BILL} as qaBill_ID, {_ON} as OrderNumber, min(l_shipdate) as finishDate
        from $lineitem where l_returnflag = 'A' group by l_orderkey, l_suppkey % 4""",
    "qa_finish_detail": f"""
        select {_BILL} as qaFinish_ID, l_linenumber as bill_Item, {_sum()} as Qty, max(l_suppkey) as QAPerson
        from $lineitem where l_returnflag = 'A' group by l_orderkey, l_suppkey % 4, l_linenumber""",
    "qa_repair_master": f"""
        select {_BILL} as qaRepair_ID, concat('QR', cast({_BILL} as string)) as repairDocNumber, {_BILL} as qaBill_ID,
               {_ON} as OrderNumber, min(l_shipdate) as repairDate, max(l_shipdate) as receiveDate,
               case (l_orderkey + l_suppkey % 4) % 4 when 0 then '' when 1 then '1' when 2 then '2' else '3' end
                 as qaRepairStatus,
               min(l_suppkey) as SenderNew, max(l_suppkey) as ReceiverNew
        from $lineitem where l_returnflag = 'N' group by l_orderkey, l_suppkey % 4""",
    "qa_repair_detail": f"""
        select {_BILL} as qaRepair_ID, l_linenumber as repair_Item, l_linenumber as bill_Item, {_sum()} as Qty,
               {_sum("l_linestatus = 'F'")} as RepairFinish,
               {_sum(f"l_linestatus = 'O' and {_QTY} % 2 = 0")} as ToQa,
               concat('BQ', cast({_BILL} as string), '-', cast(l_linenumber as string)) as qaJobNumber
        from $lineitem where l_returnflag = 'N' group by l_orderkey, l_suppkey % 4, l_linenumber""",
    "qa_repair_reason": f"""
        select {_BILL} as qaRepair_ID, l_linenumber as repair_Item, cast(l_partkey % 5 + 1 as int) as type_ID,
               cast(l_suppkey % 6 + 1 as int) as reason_No, {_sum()} as Qty
        from $lineitem where l_returnflag = 'N'
        group by l_orderkey, l_suppkey % 4, l_linenumber, cast(l_partkey % 5 + 1 as int), cast(l_suppkey % 6 + 1 as int)""",
    "qa_repair_type": "select r_regionkey + 1 as type_ID, r_name as repairType from $region",
    "qa_repair_type_detail": """
        select n_regionkey + 1 as type_ID, cast((n_nationkey - n_nationkey % 5) / 5 + 1 as int) as reason_No,
               n_name as reasonType
        from $nation""",
    "due_fac_to_qa": f"""
        select {_ON} as OrderNumber, l_linenumber as HistoryNo, cast(l_shipdate as date) as DueDate,
               case when {_QTY} % 10 = 0 then 0 else {_QTY} end as Qty, l_shipdate as HistoryDate,
               l_suppkey as EmpCode
        from $lineitem""",
    "order_remark": f"""
        select {order_number("o_orderkey")} as OrderNumber, concat('plan ', o_orderpriority) as PlanDes,
               cast(null as string) as QaDes
        from $orders where o_orderkey % 3 = 0""",
    "order_finish": f"""
        select {order_number("o_orderkey")} as OrderNumber, 1 as isFinish,
               cast(o_orderdate as date) + cast(o_orderkey % 60 as int) as FinishDate
        from $orders where o_orderkey % 4 = 0""",
    "casting_output": f"""
        select {_ON} as OrderNumber, {_JOB} as JobNumber, cast((l_partkey + l_suppkey) % 8 as string) as OutputType,
               {_QTY} as Qty
        from $lineitem""",
    "cast_repair": f"""
        select {_ON} as OrderNumber, {_JOB} as JobNumber, {_QTY} as SendQty,
               case when l_linestatus = 'F' then {_QTY} else 0 end as ReturnQty
        from $lineitem where l_returnflag = 'R'""",
    "worker_bill": """
        select o_orderkey as Bill_ID, concat('WB', cast(o_orderkey as string)) as BillNumber,
               cast(o_orderdate as date) as BillDate, o_custkey % 40 as Receiver
        from $orders""",
    "worker_bill_material": """
        select l_orderkey as Bill_ID, min(l_partkey) as InvCode, count(*) as MatTotalWeight
        from $lineitem where l_linenumber < 4 group by l_orderkey""",
    "worker_bill_detail": f"""
        select l_orderkey as Bill_ID, l_linenumber as ItemNo, {_JOB} as JobNumber, {_sum()} as SendQty,
               {_sum("l_returnflag <> 'N'")} as SendWeight
        from $lineitem group by l_orderkey, l_linenumber""",
    "worker_bill_return": f"""
        select l_orderkey as Bill_ID, l_linenumber as ItemNo, {_QTY} as RvTotalWeight
        from $lineitem where l_linestatus = 'F'""",
    "job_type": """
        select concat('0', cast(r_regionkey + 1 as string)) as JobTypeCode, r_name as JobTypeName from $region""",
    "category": """
        select concat('0', cast(n_regionkey + 1 as string)) as JobTypeCode,
               concat('A', lpad(cast(n_nationkey as string), 2, '0')) as CategoryCode, n_name as CategoryName
        from $nation""",
    "floor": "select r_regionkey as FloorCode, r_name as FloorName from $region",
    "room": "select n_regionkey as FloorCode, n_nationkey as RoomCode, n_name as RoomName from $nation",
    "device": """
        select c_custkey as ID, concat('0', cast(c_nationkey % 5 + 1 as string)) as JobTypeCode,
               concat('A', lpad(cast(c_nationkey as string), 2, '0')) as CategoryCode,
               concat('D', cast(c_custkey as string)) as DeviceNo, c_nationkey % 5 as FloorCode,
               cast((c_custkey % 30) as int) as RoomCode, cast(c_custkey % 2 as string) as Status1, c_name as Owner
        from $customer""",
    "repair_document": """
        select o_orderkey as BillID,
               concat('RD', lpad(cast(year(o_orderdate) % 100 as string), 2, '0'),
                      lpad(cast(month(o_orderdate) as string), 2, '0')) as DocPrefix,
               concat('0', cast(o_custkey % 5 + 1 as string)) as JobTypeCode,
               concat('A', lpad(cast(o_custkey % 25 as string), 2, '0')) as CategoryCode,
               cast(o_custkey % 5 as int) as FloorCode, cast(o_custkey % 30 as int) as RoomCode,
               case when o_orderkey % 6 = 0 then 'null' else concat('D', cast(o_custkey as string)) end as DeviceNo,
               o_custkey % 60 as ContactPerson, o_custkey % 70 as Approver, o_orderkey % 130 as Notifier,
               case when o_orderkey % 2 = 0 then o_orderdate + interval '5' hour
                    else o_orderdate + interval '23' hour end as JobDate,
               case when o_orderkey % 4 = 0
                    then make_date(year(o_orderdate) + 543, month(o_orderdate), least(day(o_orderdate), 28))
                    else cast(o_orderdate as date) + 30 end as DueDate,
               case when o_orderstatus = 'F' then cast(o_orderdate as date) + cast(o_orderkey % 9 as int) end as FinishDate,
               o_orderpriority as BrokenDes,
               case when o_orderkey % 3 = 0 then ''
                    else concat('B', lpad(cast(o_orderkey % 25 as string), 2, '0'), '-1') end as RepairBillNo,
               case o_orderstatus when 'F' then '3' when 'P' then '2' else cast(o_orderkey % 2 as string) end as Status,
               o_orderkey % 500 as RepairPrice, o_custkey % 300 as PartPrice
        from $orders""",
    "pd_process": """
        select lpad(cast(n_nationkey as string), 2, '0') as PDProcessCode, n_name as PDProcessName,
               100 - n_nationkey as PDProcessSortBy
        from $nation where n_nationkey between 1 and 22""",
    "mould_loan": """
        select o_orderkey as ID, cast(o_orderdate as date) as BillDate, o_custkey % 60 as Owner,
               concat('M', cast(o_custkey % 200 as string)) as ModelNo, o_orderkey % 9 + 1 as Qty,
               cast(o_custkey % 5 as int) as JobType, cast(o_custkey % 25 as int) as DepartCode,
               case when o_orderkey % 13 = 0 then null else cast(o_orderdate as date) + 30 end as DueDate,
               cast(o_orderdate as date) + 1 as PrepareDate,
               case when o_orderkey % 5 = 0 then null else cast(o_orderdate as date) + 2 end as ReceiveDate,
               case when o_orderstatus = 'F' then cast(o_orderdate as date) + cast(o_orderkey % 60 as int) end as ReturnDate,
               o_custkey % 70 as PreparePerson, o_custkey % 80 as Receiver, o_orderkey % 90 as ReturnPerson,
               case o_orderstatus when 'F' then '04' when 'P' then '02' else '01' end as Status
        from $orders""",
    "loan_job_type": "select r_regionkey as JobType, r_name as JobTypeName from $region",
    "loan_department": "select n_nationkey as DepartCode, n_name as DepartName from $nation",
    "model_picture": """
        select concat(p_type, '-', cast(p_size as string)) as ModelNumber,
               min(concat('D:', chr(92), 'models', chr(92), p_type, '.jpg')) as ModelPicture
        from $part where p_size % 7 <> 0 group by p_type, p_size""",
    "purchase_bill": """
        select o_orderkey as Purchase_Bill_ID, concat('PB', cast(o_orderkey as string)) as Purchase_Bill_Doc,
               o_custkey % 60 as Request_ID, cast(o_custkey % 25 as int) as Section_Code,
               cast(o_custkey % 5 as int) as Position_Code, o_custkey % 130 as Inspactor_ID, o_orderdate as Bill_Date,
               case when o_orderstatus = 'F' then cast(o_orderdate as date) + cast(o_orderkey % 40 as int) end as Receive_Date,
               case o_orderstatus when 'F' then '5' when 'P' then '4' else '0' end as Status_Code
        from $orders""",
    "purchase_bill_detail": f"""
        select l_orderkey as Purchase_Bill_ID, l_linenumber as ITEM_NO, min(l_partkey) as ITEM_ID,
               {_sum()} as ITEM_Qty, cast(min(l_suppkey) % 5 as int) as ITEM_UNIT_ID,
               concat('remark ', cast(l_linenumber as string)) as Remark
        from $lineitem group by l_orderkey, l_linenumber""",
    "inventory_new": """
        select p_partkey as ITEM_ID, case when p_partkey % 10 = 0 then 'อื่นๆ' else p_name end as ITEM_NAME,
               cast(p_size % 5 as int) as INV_TYPE_ID, cast(p_size % 5 as int) as UNIT_ID,
               cast(round(p_retailprice * 100) as bigint) as PRICE
        from $part""",
    "item_type": "select r_regionkey as INV_TYPE_ID, r_name as INV_TYPE_NAME from $region",
    "item_unit": "select r_regionkey as UNIT_ID, r_name as UNIT_NAME from $region",
    "section": "select n_nationkey as SectionCode, n_name as SectionName from $nation",
    "position": """
        select n_nationkey as section_code, r_regionkey as position_code, concat(n_name, '/', r_name) as position_name
        from $nation join $region on n_regionkey = r_regionkey""",
    "department": "select n_nationkey as DepartmentCode, n_name as DepartmentName from $nation",
    "staff_position": "select r_regionkey as PositionCode, r_name as PositionName from $region",
    "water_limit": """
        select concat('WT-', lpad(cast(n_nationkey as string), 2, '0')) as deviceCode, 10 as exrate,
               260 + 10 * n_nationkey as rateLimit, concat('floor ', cast(n_nationkey % 8 as string)) as position
        from $nation where n_nationkey between 1 and 14""",
    "water_log": """
        select concat('WT-', lpad(cast(user_id % 12 + 1 as string), 2, '0')) as deviceCode, ts as transDate
        from $events""",
}

#: Spark deals the line items of these tables by one column that reports join on, so that their
#: grouping and the joins on that column share one shuffle. The rows are those of the statement.
DEALT_BY: dict[str, dict[str, str]] = {
    _ON: dict.fromkeys(
        ("order_detail", "order_product_detail", "job_order", "purchase_status", "material_plan", "mpp_status", "mpp_status_product",
         "batch_purchase"),
        "OrderNumber",
    ),
    _JOB: {"job_status": "JobNumber"},
    _BILL: {
        "bill_master": "Bill_ID", "bill_detail": "Bill_ID", "bill_material": "Bill_ID",
        "qa_bill_master": "qaBill_ID", "qa_bill_detail": "qaBill_ID", "qa_finish_master": "qaFinish_ID", "qa_finish_detail": "qaFinish_ID",
        "qa_repair_master": "qaRepair_ID", "qa_repair_detail": "qaRepair_ID", "qa_repair_reason": "qaRepair_ID",
    },
}
_DEALT = {name: (key, column) for key, tables in DEALT_BY.items() for name, column in tables.items()}
#: Tables that :meth:`Workshop.dealt` can also deal by the order they name, since their rows go there first.
ALSO_DEALT = {(name, "OrderNumber"): _ON for name in ("qa_bill_master", "qa_bill_detail")}

BASE_TABLES = tuple(SCHEMAS)
_NAME = re.compile(r"\$(\w+)")


def names_in(text: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(text)))


def duckdb_sql(body: str, extra: dict[str, str] | None = None) -> str:
    """A DuckDB statement with the derived tables that ``body`` uses as leading common tables."""
    known = {**PROXIES, **(extra or {})}
    ordered: dict[str, str] = {}

    def add(name: str) -> None:
        if name in known and name not in ordered:
            for inner in names_in(known[name]):
                add(inner)
            ordered[name] = known[name]

    for name in names_in(body):
        add(name)
    plain = lambda text: _NAME.sub(r"\1", text).strip()
    tables = ",\n".join(f"{name} as ({plain(text)})" for name, text in ordered.items())
    return f"with {tables}\n{plain(body)}" if tables else plain(body)


class Workshop:
    """Tables of one data folder; raw and derived ones are attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:
            if name in SCHEMAS:
                self._frames[name] = load(self.spark, self.folder, name)
            elif name in PROXIES:
                self._frames[name] = self._derived(name, _DEALT[name][0] if name in _DEALT else None)
            else:
                raise AttributeError(name)
        return self._frames[name]

    def _derived(self, name: str, key: str | None) -> DataFrame:
        text = PROXIES[name].strip()
        inputs = {n: getattr(self, n) for n in names_in(text)}
        if key is not None:
            # The key depends on the grouping columns alone, so one more grouping column changes no group.
            # It is not moved: each side of the shuffle works it out.
            text += f", {key}"
            inputs["lineitem"] = inputs["lineitem"].repartition(F.expr(key))
        return self.spark.sql(_NAME.sub(r"{\1}", text), **inputs)

    def dealt(self, name: str, column: str) -> DataFrame:
        """A derived table whose line items are dealt by another of its columns than usual; the same rows."""
        return self._derived(name, ALSO_DEALT[name, column])
