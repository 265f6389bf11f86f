"""The corpus pipeline, stage by stage, against brute force on a small table with planted cases."""

from __future__ import annotations

import base64
import hashlib
import random
from array import array
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from loupewright.llm import mixing, prefix_bpe, quality
from loupewright.llm.common import stored
from tests.llm.test_llm_operators import print_of, prose, repeats, union_find

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    clean = [prose(rng, 150) for _ in range(30)]
    passage = prose(rng, 80)
    near = []
    for k in (1, 2, 4):  # one word in fifty, twenty-five and a dozen
        words = clean[0].split(" ")
        for i in range(k):
            words[20 + 30 * i] = f"other{k}{i}"
        near.append(" ".join(words))
    shared = [prose(rng, 90) + passage + prose(rng, 60) for _ in range(4)]
    junk = ["few words", "again and again " * 80, "a$$ b## c** " * 60, None, ""]
    texts = clean + [clean[1], clean[2], clean[2]] + near + shared + junk
    return [(i, t, "en", f"src{i % 3}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("documents"))
    spark.createDataFrame(rows, SCHEMA).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_copies", "repeated_passages", "source_mix", "token_ids",
    ]


def test_quality_rules_drop_junk_and_keep_the_rest(spark, rows, docs):
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    assert kept.schema == docs.schema
    junk = {i for i, t, *_ in rows if i >= len(rows) - 5}
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - junk
    assert all(quality.measure(t)[0] >= 50 for i, t, *_ in rows if i not in junk)


def test_near_copies_leave_one_of_each_group(spark, rows, docs):
    kept = corpus_pipeline.near_copies(spark, docs, "")
    assert kept.schema == docs.schema
    ids = {r.doc_id for r in kept.collect()}
    prints = [print_of(t) for _, t, *_ in rows]
    roots = union_find(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert ids == set(roots)  # ids are places here
    assert {30, 31, 32} & ids == set()  # exact copies of 1 and 2 go
    assert set(range(30)) <= ids  # clean documents stay


def test_repeated_passages_are_cut(spark, rows, docs):
    cut = corpus_pipeline.repeated_passages(spark, docs, "")
    assert cut.schema == docs.schema
    found = {r.doc_id: r for r in cut.collect()}
    assert set(found) == {r[0] for r in rows}
    for (i, n, removed, *_), _ in repeats(rows).items():
        text = found[i].text
        assert found[i].n_chars == len(text or "")
        if not removed:
            assert text == next(t for j, t, *_ in rows if j == i)
        else:
            assert n - removed - 6 <= len(text.encode()) <= n - removed


def test_source_mix_repeats_documents(spark, docs):
    mixed = corpus_pipeline.source_mix(spark, docs, "")
    assert mixed.schema == docs.schema
    wanted = Counter({r.doc_id: r.copies for r in mixing.with_copies(docs).collect() if r.copies})
    assert Counter(r.doc_id for r in mixed.collect()) == wanted
    assert max(wanted.values()) <= 3


def test_token_ids_are_those_of_the_library(spark, rows, docs):
    with open(public_tokenizers.path(prefix_bpe.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {i: t or "" for i, t, *_ in rows}
    for r in corpus_pipeline.token_ids(spark, docs, "").collect():
        assert array("I", r.ids).tolist() == library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(r.ids) // 4


def test_token_ids_are_decoded_and_held_against_the_text(spark, rows, docs, monkeypatch):
    found = corpus_pipeline.token_ids(spark, docs, "").select("doc_id", "decoded_sha256").collect()
    assert {r.doc_id: r.decoded_sha256 for r in found} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t, *_ in rows}
    right = prefix_bpe.encode_and_decode
    monkeypatch.setattr(prefix_bpe, "encode_and_decode", lambda frame: right(frame).withColumn("decoded", F.lit(b"other")))
    with pytest.raises(Exception, match="do not decode"):
        corpus_pipeline.token_ids(spark, docs, "").collect()


def test_run_equals_the_stages_one_by_one(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    step = docs
    for _, stage in corpus_pipeline.STAGES:
        step = stored(stage(spark, step, str(tmp_path)), "stage")
    columns = ["doc_id", "source", "n_tokens", F.hex("ids").alias("ids")]
    assert Counter(map(tuple, step.select(*columns).collect())) == Counter(
        map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select(*columns).collect())
    )


def test_an_empty_table_goes_through(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
