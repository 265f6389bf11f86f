"""Change application: a snapshot and a change set in, the new snapshot (and history) out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loupewright.operators.joins import left_default
from loupewright.operators.ranked import number_rows
from loupewright.sources.ledgers import Numbers, numbered_once

# States of a repair bill.
REPAIRING, SENT_BACK, FINISHED = "1", "2", "3"


def latest_change(changes: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """The last change of each key. An aggregate, so a key with many changes is reduced before the shuffle."""
    rest = [c for c in changes.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def apply_upserts(snapshot: DataFrame, changes: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Replace or insert whole rows by key; the last change of a key wins."""
    last = latest_change(changes, keys, seq).select(*snapshot.columns)
    return snapshot.join(last.select(*keys), list(keys), "left_anti").unionByName(last)


def apply_updates(
    snapshot: DataFrame, changes: DataFrame, keys: Sequence[str], seq: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Set some columns of existing rows by key, also to NULL; other rows stay as they are."""
    last = latest_change(changes, keys, seq).select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = snapshot.join(last, list(keys), "left")
    updated = joined.withColumns({c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in columns})
    return updated.select(*snapshot.columns)


def cascade_delete(tables: Mapping[str, DataFrame], deleted: DataFrame, on: Sequence[str]) -> dict[str, DataFrame]:
    """Remove the keys from a master and all its detail tables."""
    keys = deleted.select(*on)
    return {name: table.join(keys, list(on), "left_anti") for name, table in tables.items()}


def apply_increments(target: DataFrame, deltas: DataFrame, keys: Sequence[str], column: str, delta: str) -> DataFrame:
    """Add the sum of all deltas of a key to a column."""
    summed = deltas.groupBy(*keys).agg(F.sum(delta).alias("_delta"))
    joined = left_default(target, summed, keys, {"_delta": 0})
    return joined.withColumn(column, F.col(column) + F.col("_delta")).drop("_delta")


def repair_receive(headers: DataFrame, details: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
    """Take the pieces sent back into stock: move them to finished and set the bill state.

    ``events`` names (repair bill, item). Items with nothing on the way are ignored. A touched bill is
    finished when all its pieces are, and back in repair otherwise.
    """
    item = ["qaRepair_ID", "repair_Item"]
    hit = events.select(*item).distinct().withColumn("_hit", F.lit(True))
    marked = details.join(hit, item, "left").withColumn("_hit", F.col("_hit") & (F.col("ToQa") > 0))
    moved = marked.withColumns(
        {
            "RepairFinish": F.when(F.col("_hit"), F.col("RepairFinish") + F.col("ToQa")).otherwise(F.col("RepairFinish")),
            "ToQa": F.when(F.col("_hit"), F.lit(0).cast("bigint")).otherwise(F.col("ToQa")),
        }
    )
    states = (
        moved.groupBy("qaRepair_ID")
        .agg(F.max(F.col("_hit")).alias("_touched"), F.sum("Qty").alias("_qty"), F.sum("RepairFinish").alias("_done"))
        .where(F.col("_touched"))
        .select("qaRepair_ID", F.when(F.col("_qty") == F.col("_done"), FINISHED).otherwise(REPAIRING).alias("_state"))
    )
    return {"headers": _set_state(headers, states), "details": moved.select(*details.columns)}


def _set_state(headers: DataFrame, states: DataFrame) -> DataFrame:
    joined = headers.join(states, "qaRepair_ID", "left")
    return joined.withColumn("qaRepairStatus", F.coalesce("_state", "qaRepairStatus")).select(*headers.columns)


def repair_send(headers: DataFrame, details: DataFrame, events: DataFrame, quantity: str = "sent") -> dict[str, DataFrame]:
    """Send repaired pieces back: every named bill is marked as sent, positive quantities are added."""
    states = events.select("qaRepair_ID").distinct().withColumn("_state", F.lit(SENT_BACK))
    positive = events.where(F.col(quantity) > 0)
    added = apply_increments(details, positive, ["qaRepair_ID", "repair_Item"], "ToQa", quantity)
    return {"headers": _set_state(headers, states), "details": added.select(*details.columns)}


def repair_cancel(headers: DataFrame, details: DataFrame, bills: DataFrame) -> dict[str, DataFrame]:
    """Take a return back: the bill is in repair again and nothing is on the way."""
    keys = bills.select("qaRepair_ID").distinct()
    cleared = details.join(keys.withColumn("_hit", F.lit(True)), "qaRepair_ID", "left").withColumn(
        "ToQa", F.when(F.col("_hit"), F.lit(0).cast("bigint")).otherwise(F.col("ToQa"))
    )
    states = keys.withColumn("_state", F.lit(REPAIRING))
    return {"headers": _set_state(headers, states), "details": cleared.select(*details.columns)}


def next_revision(
    changes: DataFrame, history: DataFrame, as_of: date, key: str = "OrderNumber", kind: str = "target", seq: str = "seq"
) -> DataFrame:
    """The revision number each promise change is to be written under.

    A change of the first promise is revision 1. Any other change joins the revision already opened
    today, if there is one besides the first, and opens the next one otherwise. All changes of a key
    in one batch end in the same revision, but for a key without history: there the first change
    written makes revision 1, and the others follow in revision 2.
    """
    changed_today = F.to_date("HistoryDate") == F.lit(as_of)
    known = history.groupBy(key).agg(
        F.max("HistoryNo").alias("_max"),
        F.max(F.when(changed_today & (F.col("HistoryNo") != 1), F.col("HistoryNo"))).alias("_today"),
    )
    first = changes.groupBy(key).agg(F.min(seq).alias("_first"))
    joined = changes.join(known, key, "left").join(first, key)
    fresh = F.col("_max").isNull()
    opened = F.when(fresh, F.when(F.col(seq) == F.col("_first"), 1).otherwise(2)).otherwise(
        F.coalesce(F.col("_today"), F.col("_max") + 1)
    )
    return joined.withColumn("revision", F.when(F.col(kind) == "first", 1).otherwise(opened)).drop("_max", "_today", "_first")


def transition(
    snapshot: DataFrame,
    changes: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    status: str,
    new_status: str,
    number: str = "UpdateNo",
) -> dict[str, DataFrame]:
    """Apply status changes by key, and number them after the history of the key.

    The last change in ``order`` (a total order within a key) sets the status.
    """
    known = history.groupBy(*keys).agg(F.max(number).alias("_max"))
    numbered = left_default(number_rows(changes, keys, order, "_n"), known, keys, {"_max": 0})
    rows = numbered.withColumn(number, F.col("_max") + F.col("_n")).drop("_max", "_n")
    last = rows.groupBy(*keys).agg(F.max_by(new_status, number).alias("_status"))
    updated = snapshot.join(last, list(keys), "left").withColumn(status, F.coalesce("_status", status))
    return {"snapshot": updated.select(*snapshot.columns), "history": rows}


def assign_numbers(
    new: DataFrame,
    existing: DataFrame,
    prefix: str,
    order: Sequence[str | Column],
    document: str,
    width: int,
    name: str = "document",
) -> DataFrame:
    """Number a batch of documents, per prefix, after the highest number in use.

    ``existing`` has the prefix and the document number text. Numbers have at least ``width`` digits;
    beyond that they grow, so that no number is given twice.
    """
    digits = F.col(document).substr(F.length(F.col(prefix)) + 1, F.length(F.col(document))).cast("bigint")
    used = existing.groupBy(prefix).agg(F.max(digits).alias("_max"))
    numbered = left_default(number_rows(new, [prefix], order, "_n"), used, [prefix], {"_max": 0})
    text = (F.col("_max") + F.col("_n")).cast("string")
    padded = F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))
    return numbered.withColumn(name, F.concat(F.col(prefix), padded)).drop("_n", "_max")


def number_documents(
    new: DataFrame,
    path: str,
    batch: str,
    prefix: str,
    order: Sequence[str | Column],
    width: int,
    existing: DataFrame | None = None,
    document: str = "document",
    name: str = "document",
) -> DataFrame:
    """Number a batch of documents, per prefix, safe beside other batches that do so at the same time.

    Each batch reserves a block of numbers per prefix in the ledger under ``path``; run again it gets
    the same. ``existing`` documents are taken into account when the ledger is new.
    """
    if existing is not None:
        digits = F.col(document).substr(F.length(F.col(prefix)) + 1, F.length(F.col(document))).cast("bigint")
        keys = T.StructType([new.schema[prefix]])
        used = existing.groupBy(prefix).agg(F.max(digits).alias("count"))
        Numbers(new.sparkSession, path, keys).reserve(used, "documents before the ledger")
    numbered = numbered_once(new, path, batch, [prefix], order, "_n")
    text = F.col("_n").cast("string")
    padded = F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))
    return numbered.withColumn(name, F.concat(F.col(prefix), padded)).drop("_n")


#: A repair document as it comes in: header, items, reasons of each item.
DOCUMENT = T.StructType(
    [
        T.StructField("document_id", T.LongType()),
        T.StructField("order_number", T.StringType()),
        T.StructField("sender", T.LongType()),
        T.StructField(
            "items",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("product_id", T.LongType()),
                        T.StructField("qty", T.LongType()),
                        T.StructField(
                            "reasons",
                            T.ArrayType(
                                T.StructType(
                                    [
                                        T.StructField("type_id", T.IntegerType()),
                                        T.StructField("reason_no", T.IntegerType()),
                                        T.StructField("qty", T.LongType()),
                                    ]
                                )
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)


#: Why a document is rejected; the first that applies.
EMPTY, NOT_JSON, WRONG_TYPE, MISSING, INCOMPLETE_ITEM, INCOMPLETE_REASON = (
    "empty", "not JSON", "wrong type", "missing field", "incomplete item", "incomplete reason",
)


def parse_documents(documents: DataFrame, column: str, schema: T.StructType = DOCUMENT) -> DataFrame:
    """The columns of ``documents``, the parsed document ``_d``, and ``_reason`` why it is rejected, or null.

    A document needs its id, its order number and a list of items, which may be empty; an item its
    product and quantity; a reason all its fields. A value that does not fit its type rejects the document.
    """
    text = F.col(column)
    parsed = F.from_json(column, T.StructType([*schema.fields, T.StructField("_bad", T.StringType())]), {"columnNameOfCorruptRecord": "_bad"})

    def empty(struct: Column, *fields: str) -> Column:
        found = struct[fields[0]].isNull()
        for f in fields[1:]:
            found = found | struct[f].isNull()
        return found

    def judged(d: Column) -> Column:
        bad_reason = lambda r: r.isNull() | empty(r, "type_id", "reason_no", "qty")
        bad_item = lambda i: i.isNull() | empty(i, "product_id", "qty")
        reason = (
            F.when(text.isNull() | (F.trim(text) == ""), EMPTY)
            .when(d["_bad"].isNotNull() & F.try_parse_json(text).isNull(), NOT_JSON)
            .when(d["_bad"].isNotNull(), WRONG_TYPE)
            .when(empty(d, "document_id", "order_number", "items"), MISSING)
            .when(F.exists(d["items"], bad_item), INCOMPLETE_ITEM)
            .when(F.exists(d["items"], lambda i: F.coalesce(F.exists(i["reasons"], bad_reason), F.lit(False))), INCOMPLETE_REASON)
        )
        return F.struct(d.alias("_d"), reason.alias("_reason"))

    # A lambda takes the parsed document as a value and a generator keeps filters above it, so each text is parsed once.
    return documents.select("*", F.inline(F.transform(F.array(parsed), judged)))


def shred(documents: DataFrame, column: str, schema: T.StructType = DOCUMENT) -> dict[str, DataFrame]:
    """Split JSON documents into master, item and reason rows; items are numbered from 1.

    A document goes as a whole either there or, with the reason, to ``quarantine``, which keeps its text
    and the other columns.
    """
    judged = parse_documents(documents, column, schema)
    parsed = judged.where("_reason is null").select("_d.*")
    items = parsed.select("document_id", "order_number", F.posexplode("items").alias("_pos", "_item"))
    items = items.withColumn("item_no", F.col("_pos") + 1)
    reasons = items.select("document_id", "item_no", F.explode("_item.reasons").alias("_reason"))
    return {
        "master": parsed.select("document_id", "order_number", "sender", F.size("items").alias("n_items")),
        "detail": items.select("document_id", "item_no", "order_number", "_item.product_id", "_item.qty"),
        "reason": reasons.select("document_id", "item_no", "_reason.type_id", "_reason.reason_no", "_reason.qty"),
        "quarantine": judged.where("_reason is not null").select(*documents.columns, F.col("_reason").alias("reason")),
    }
