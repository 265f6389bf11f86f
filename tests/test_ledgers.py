"""Appends that happen once and numbers that are given once, also for batches side by side."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import date

import pytest
from pyspark.sql import functions as F

from loupewright.operators import changes
from loupewright.sources import ledgers
from tests.util import rows, table

SCHEMA = "key string, day date, v int"


def batch(spark, *data):
    return table(spark, SCHEMA, *data)


def appended(spark, path, frame, name):
    return ledgers.append_history(frame, path, name, ["key"], ["day", "v"], "day")


def history(spark, path):
    return rows(ledgers.read_history(spark, path, batch(spark).schema), "key", "sequence", "v")


def test_a_repeated_batch_changes_nothing_and_numbers_go_on(spark, tmp_path):
    path = str(tmp_path / "history")
    assert history(spark, path) == []
    first = batch(spark, ("a", date(2024, 1, 2), 2), ("a", date(2024, 1, 1), 1), (None, date(2024, 1, 1), 9))
    assert appended(spark, path, first, "one") and not appended(spark, path, first, "one")
    assert history(spark, path) == [(None, 1, 9), ("a", 1, 1), ("a", 2, 2)]
    second = batch(spark, ("a", date(2024, 1, 1), 3), ("b", date(2024, 1, 1), 4), (None, date(2024, 1, 3), 5))
    assert appended(spark, path, second, "two/../2")
    assert history(spark, path) == [(None, 1, 9), (None, 2, 5), ("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 1, 4)]


def test_a_batch_that_died_before_its_commit_is_not_seen_and_keeps_its_numbers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "history")
    lost = batch(spark, ("a", date(2024, 1, 1), 1))
    with monkeypatch.context() as broken:
        broken.setattr(ledgers.Commits, "add", lambda self, name, entry, add=ledgers.Commits.add: name != "one" and add(self, name, entry))
        assert not appended(spark, path, lost, "one")
    assert history(spark, path) == []
    assert appended(spark, path, batch(spark, ("a", date(2024, 1, 1), 2)), "two")
    assert appended(spark, path, lost, "one")
    assert history(spark, path) == [("a", 1, 1), ("a", 2, 2)]


def test_a_commit_is_made_once(spark, tmp_path):
    commits = ledgers.Commits(spark, str(tmp_path / "commits"))
    with ThreadPoolExecutor(2) as pool:
        made = list(pool.map(lambda k: commits.add("n", {"batch": k, "folder": "f", "whole": False}), range(2)))
    assert True in made
    assert not commits.add("n", {"batch": 5}) and commits.has("n") and not commits.has("m")
    assert [e["batch"] in (0, 1) for e in commits.entries()] == [True]


@pytest.mark.parametrize("whole_every", [2, 32])
def test_a_batch_that_loses_its_place_takes_the_next_numbers(spark, tmp_path, monkeypatch, whole_every):
    monkeypatch.setattr(ledgers, "WHOLE_EVERY", whole_every)
    keys = spark.createDataFrame([], "p string").schema
    path = str(tmp_path / "numbers")
    counts = lambda *pairs: table(spark, "p string, count long", *pairs)
    add, raced = ledgers.Commits.add, []

    def other_first(self, name, entry):
        """Another batch commits between the reading and the commit of this one."""
        if entry["batch"] == "slow" and not raced:
            raced.append(name)
            ledgers.Numbers(spark, path, keys).reserve(counts(("x", 3), ("y", 1)), "fast")
        return add(self, name, entry)

    monkeypatch.setattr(ledgers.Commits, "add", other_first)
    numbers = ledgers.Numbers(spark, path, keys)
    assert rows(numbers.reserve(counts(("x", 2)), "zero")) == [("x", 1, 2)]
    assert rows(numbers.reserve(counts(("x", 5), ("z", 2)), "slow")) == [("x", 6, 10), ("z", 1, 2)]
    assert rows(numbers.reserve(counts(("x", 1)), "fast")) == [("x", 3, 5), ("y", 1, 1)]
    assert rows(numbers.reserve(counts(("y", 4)), "last")) == [("y", 2, 5)]
    assert rows(numbers.last_numbers()) == [("x", 10), ("y", 5), ("z", 2)]
    assert rows(numbers.reserve(counts(("x", 7)), "zero")) == [("x", 1, 2)]


def test_document_numbers_of_two_batches_at_once_differ(spark, tmp_path):
    new = lambda k: spark.range(20).select(F.lit("RD2402").alias("prefix"), (F.col("id") + 100 * k).alias("doc"))
    numbered = lambda k: changes.number_documents(new(k), str(tmp_path), f"batch {k}", "prefix", ["doc"], 5)
    with ThreadPoolExecutor(3) as pool:
        found = [r for frame in pool.map(numbered, range(3)) for r in frame.collect()]
    assert sorted(r.document for r in found) == [f"RD2402{n:05d}" for n in range(1, 61)]
    assert {r.document for r in numbered(1).collect()} == {r.document for r in found if r.doc // 100 == 1}
