"""Stored snapshots of which a change rewrites only the buckets it touches."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from loupewright.operators import changes
from loupewright.sources import ledgers
from loupewright.sources.bucketed import BucketedSnapshot
from tests.util import rows


def files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{path}/rows") for f in names if f.endswith(".parquet")}


@pytest.fixture
def stored(spark, tmp_path):
    base = spark.range(5000).select("id", (F.col("id") % 7).alias("v"))
    snapshot = BucketedSnapshot(spark, str(tmp_path), base.schema, ["id"], buckets=100)
    assert snapshot.upsert(base.withColumn("seq", F.lit(0)), ["seq"], "first") == 100
    return base, snapshot, str(tmp_path)


def test_a_change_of_one_bucket_rewrites_one_file_of_a_hundred(spark, stored):
    base, snapshot, path = stored
    before = files(path)
    assert len(before) == 100
    one = base.where(snapshot._bucket() == 42).limit(3)
    edits = one.select("id", F.lit(-1).cast("bigint").alias("v"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"))
    assert snapshot.upsert(edits, ["seq"], "edit") == 1
    assert len(files(path) - before) == 1
    assert rows(snapshot.read()) == rows(changes.apply_upserts(base, edits, ["id"], ["seq"]))
    assert snapshot.upsert(edits, ["seq"], "edit") == -1 and len(files(path)) == 101


def test_deletes_and_empty_buckets(spark, stored):
    base, snapshot, _ = stored
    gone = base.where((snapshot._bucket() == 7) | (F.col("id") < 20))
    assert snapshot.delete(gone, "gone") > 1
    assert rows(snapshot.read()) == rows(base.join(gone.select("id"), "id", "left_anti"))
    assert snapshot.delete(base.limit(0), "nothing") == 0
    assert snapshot.upsert(gone.withColumn("seq", F.lit(1)), ["seq"], "back") > 1
    assert rows(snapshot.read()) == rows(base)


def test_a_change_that_comes_second_is_applied_to_what_the_first_left(spark, stored, monkeypatch):
    base, snapshot, _ = stored
    add, raced = ledgers.Commits.add, []
    edit = lambda value: spark.createDataFrame([(value, value, 1)], "id long, v long, seq int")

    def other_first(self, name, entry):
        if entry["batch"] == "slow" and not raced:
            raced.append(1)
            snapshot.delete(base.where("id < 4000"), "fast")
        return add(self, name, entry)

    monkeypatch.setattr(ledgers.Commits, "add", other_first)
    assert snapshot.upsert(edit(100), ["seq"], "slow") == 1
    found = {r.id: r.v for r in snapshot.read().collect()}
    assert len(found) == 1001 and found[100] == 100
