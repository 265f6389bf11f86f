"""The training-data operators against brute force, on a table with every awkward case."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from array import array
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from loupewright.llm import (
    components,
    hpylm,
    mixing,
    neighbours,
    pieces,
    prefix_bpe,
    quality,
    seating,
    simhash,
    suffix_dedup,
    token_counts,
    token_files,
    toxicity,
)
from loupewright.llm.common import packed_batch, sizes_of, unpacked, work_folder

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size int, row string, ids string, "
    "kept int, print int, score string, copies int, target int, n_words string, failures string, text_2 string"
)


def prose(rng: random.Random, n: int) -> str:
    known = ["the", "of", "and", "Der", "die", "día", "niño"]
    made = lambda: "".join(rng.choice(["an", "ti", "or", "sch", "ñe", "ß", "lo", "e"]) for _ in range(rng.randint(1, 4)))
    words = [rng.choice(known) if rng.random() < 0.4 else made() for _ in range(n)]
    return "".join(w + (".\n" if rng.random() < 0.1 else " ") for w in words)


def texts() -> list[tuple]:
    """(doc_id, text, source): nulls, empty and long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(5)
    passage, base = prose(rng, 90), prose(rng, 300)
    found = [prose(rng, rng.choice([3, 40, 120, 300])) for _ in range(30)]
    near = base.split(" ")
    near[150] = "changed"
    found += [base, base, " ".join(near), "x " + passage + prose(rng, 60), prose(rng, 60) + passage, passage + passage]
    found += ["", "   \n\t", "a", "ñ" * 900, "word " * 400, "don't   stop <|endoftext|> 😀 ½ 12３ \x1c\x85 'll", prose(rng, 16_000)]
    rows = [(i, t, f"src{i % 4}") for i, t in enumerate(found)]
    return rows + [(500, None, "src1"), (501, prose(rng, 70), None), (None, prose(rng, 80), "src2"), rows[3], rows[3]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", s, len(t or ""), 7, "r", "i", 1, 2, "s", 3, 4, "w", "f", "t2") for i, t, s in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


# --- 5: quality rules --------------------------------------------------------------------------


def test_ledger_matches_sql_with_nulls_and_repeats(docs):
    duck = duckdb.connect()
    plain = docs.select("doc_id", "text").toArrow()  # noqa: F841 - read by the statement
    wanted = Counter(duck.execute(quality.ORACLE.replace("documents", "plain")).fetchall())
    ledger = quality.ledger(docs)
    assert ledger.columns.count("n_words") == 1
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (F.col("failures").bitwiseAND(F.lit(quality.mask(quality.BASE))) != 0).alias("base_failed")
    assert Counter(map(tuple, ledger.select(*columns, failed, quality.allowed(), "failures").collect())) == wanted


def test_keep_returns_the_rows_as_they_were(docs, empty):
    kept = quality.keep(docs)
    assert kept.schema == docs.schema
    good = [t for _, t, _ in texts() if len(words_of(t)) >= 50 and 2 * quality.measure(t)[4] <= len(words_of(t))]
    assert kept.count() == len(good)
    assert quality.keep(empty).count() == 0


def test_ablation_counts_each_rule_by_its_bits(docs):
    rows = quality.ledger(docs).select("failures").collect()
    by_rule = {r.rule: r for r in quality.ablation(quality.ledger(docs)).collect()}
    bit = quality.mask(["few_words"])
    assert by_rule["few_words"].failed == sum(1 for r in rows if r.failures & bit)
    assert by_rule["few_words"].failed_alone == sum(1 for r in rows if r.failures == bit)
    assert by_rule["few_words"].kept_without == sum(1 for r in rows if r.failures & ~bit == 0)


def test_repeated_words_with_very_many_different_words():
    words = [b"w%d" % i for i in range(1_200_000)]
    assert quality.repeated_words(words + words[:3]) == 6


# --- 10: mixing --------------------------------------------------------------------------------


def test_mix_matches_sql_and_keeps_clashing_columns(spark, docs, empty):
    duck = duckdb.connect()
    plain = docs.select("doc_id", "text", "source").toArrow()  # noqa: F841
    wanted = Counter(duck.execute(mixing.ORACLE.replace("from documents", "from plain")).fetchall())
    counted = mixing.with_copies(docs)
    taken = (F.col("size") * F.col("copies")).alias("taken")
    assert Counter(map(tuple, counted.select("doc_id", "size", "source_size", "target", taken).collect())) == wanted
    mixed = mixing.mix(docs)
    assert [f.name for f in mixed.schema] == docs.columns
    assert mixed.count() == counted.agg(F.sum("copies")).first()[0]
    assert {r.size for r in mixed.select("size").collect()} == {7}
    assert mixing.mix(empty).count() == 0
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5}, {None: 4, "z": 4, "é": 4, "a": 100, "b": 0}, {"a": 0}, {"a": 9}])
def test_targets_match_repeated_resharing(spark, sizes):
    rows = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    found = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight, total = {k: i % 3 + 1 for i, k in enumerate(names)}, sum(sizes.values())
    target, full = {}, set()
    while True:
        rest, share = total - sum(3 * sizes[k] for k in full), sum(weight[k] for k in names if k not in full)
        target = {k: 3 * sizes[k] if k in full else weight[k] * rest / share for k in names}
        above = {k for k in names if target[k] > 3 * sizes[k]} - full
        if not above:
            break
        full |= above
    assert found == pytest.approx(target)


# --- 2: prefix BPE -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path(prefix_bpe.VOCABULARY), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return prefix_bpe.PrefixCoder(public_tokenizers.path(prefix_bpe.VOCABULARY))


ALPHABET = list("ab'srelv  \n\t.1²½é_Ωж中😀\x85\x1c<|>") + ["<|endoftext|>", "'re", " the", "   ", "endoftext"]


def noise(n: int, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def test_ids_match_the_library_and_decode(coder, reference):
    for text in noise(3000, 1):
        packed = coder.encode(text)
        assert array("I", packed).tolist() == reference.encode_ordinary(text), text
        assert coder.decode(packed) == text.encode()


def test_appends_and_edits_equal_a_fresh_state(coder):
    rng = random.Random(2)
    for text in noise(400, 3):
        data = text.encode()
        state = prefix_bpe.PrefixState(coder, data[:7])
        state.append(data[7:])
        at = rng.randint(0, len(data))
        state.replace(at, min(len(data), at + rng.randint(0, 9)), b"xyz")
        assert state.last == prefix_bpe.PrefixState(coder, state.data).last
        edited = prefix_bpe.EncodedText(coder, text)
        for _ in range(3):
            at = rng.randint(0, len(edited.text))
            edited.replace(at, min(len(edited.text), at + rng.randint(0, 5)), rng.choice(["", "'", "r", " a", "1", "\n "]))
            assert edited.pieces == pieces.split(edited.text)


def test_an_edit_of_a_long_text_stays_near_its_place(coder):
    text = prose(random.Random(8), 9000)
    assert prefix_bpe.PrefixState(coder, text.encode()).replace(5000, 5003, b"other") < 200
    assert prefix_bpe.EncodedText(coder, text).replace(5000, 5003, "other") < 100


def test_encode_and_decode_jobs(docs, empty, reference):
    encoded = prefix_bpe.encode_texts(docs)
    assert encoded.columns == [c for c in docs.columns if c != "ids"] + ["ids"]
    for row in prefix_bpe.decode_ids(encoded).collect():
        assert array("I", row.ids).tolist() == reference.encode_ordinary(row.text or "")
        assert bytes(row.decoded) == (row.text or "").encode()
    assert prefix_bpe.decode_ids(prefix_bpe.encode_texts(empty)).count() == 0


# --- 3 and 4: token counts and files -----------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_pieces_give_the_ids_of_the_library(library):
    mine = pieces.LibraryCoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text in noise(3000, 4):
        split, packed = mine.encode(text)
        assert "".join(split) == text
        assert array("I", b"".join(packed)).tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("size, overlap", [(7, 3), (30, 20), (64, 40)])
def test_spliced_counts_equal_whole_counts(library, size, overlap):
    mine = pieces.LibraryCoder(public_tokenizers.path("byte_bpe_50k.json"))
    for text in noise(600, 5) + ["a" * 500, " " * 300 + "b", "<|endoftext|>" * 40, "don't" * 60]:
        whole = len(library.encode(text, add_special_tokens=False).ids)
        assert token_counts.count_spliced(mine, text, size, overlap) == whole, text


@pytest.mark.parametrize("size, overlap", [(token_counts.CHUNK, token_counts.OVERLAP), (50, 20)])
def test_count_job(docs, empty, library, size, overlap):
    wanted = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in texts())
    assert Counter(map(tuple, token_counts.count_tokens(docs, size=size, overlap=overlap).collect())) == wanted
    assert token_counts.count_tokens(empty).count() == 0


def test_token_files(spark, docs, empty, library):
    folder = work_folder(spark, "token-files")
    manifest = token_files.write_ids(docs, folder, files=3)
    ids = {t: np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes() for _, t, _ in texts()}
    by_id = sorted(((i is not None, i or 0), ids[t]) for i, t, _ in texts())
    rows = sorted(token_files.read_ids(manifest).collect(), key=lambda r: r.start)
    assert [((r.doc_id is not None, r.doc_id or 0)) for r in rows] == [k for k, _ in by_id]
    at = 0
    for row in rows:
        assert row.start == at
        at += row.n_tokens
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((i, len(ids[t]) // 4, zlib.crc32(ids[t])) for i, t, _ in texts())
    (found,) = [d for r in manifest.collect() for d in token_files.documents_in(r.path, [501])]
    assert found[2] == ids[next(t for i, t, _ in texts() if i == 501)]
    assert token_files.read_ids(token_files.write_ids(empty, work_folder(spark, "token-files"))).count() == 0


def test_a_reader_takes_only_the_frames_it_needs_and_finds_damage(tmp_path):
    import zstandard

    path = tmp_path / "ids"
    writer = token_files.Writer(open(path, "wb"))
    texts_ = [np.arange(i, dtype="<u4").tobytes() for i in (0, 5, 3000)]
    for i, ids in enumerate(texts_):
        writer.add(i, ids)
    writer.close()
    plain = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read()
    assert plain == b"".join(texts_)

    class Source:
        def __init__(self, data):
            self.data, self.at, self.taken = data, 0, 0

        def size(self):
            return len(self.data)

        def seek(self, at):
            self.at = at

        def read(self, n):
            self.taken += n
            return self.data[self.at : self.at + n]

    data = path.read_bytes()
    source = Source(data)
    reader = token_files.Reader(source)
    tables = source.taken
    assert reader.packed_ids(1) == texts_[1]
    assert source.taken - tables == int(reader.entries["packed"][1])
    spoilt = bytearray(data)
    spoilt[int(reader.starts[2]) + 30] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.Reader(Source(bytes(spoilt))).packed_ids(2)


# --- 6: SimHash --------------------------------------------------------------------------------


def print_of(text: str | None, width: int = 4) -> int:
    words = words_of(text)
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union_find(n: int, pairs) -> list[int]:
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_components(docs, empty):
    rows = sorted(((i, t) for i, t, _ in texts()), key=lambda r: (r[0] is None, r[0] or 0))
    prints = [print_of(t) for _, t in rows]
    roots = union_find(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    wanted = Counter((i, f"{p:016x}", rows[r][0]) for (i, _), p, r in zip(rows, prints, roots))
    assert Counter(map(tuple, simhash.components(docs).collect())) == wanted
    assert simhash.components(empty).count() == 0


@pytest.mark.parametrize("tile", [4, 2048])
def test_links_are_complete_also_where_keys_are_split(spark, tile):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    prints = list(centre)
    for _ in range(300):
        flips = np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 8), replace=False)))
        prints.append(prints[rng.integers(0, len(prints))] ^ flips)
    prints = list(dict.fromkeys(int(p) for p in prints))
    nodes = spark.createDataFrame([(i, p.to_bytes(8, "little")) for i, p in enumerate(prints)], "node long, print binary")
    edges = simhash.links(nodes, 4, tile).collect()
    assert all((prints[e.u] ^ prints[e.v]).bit_count() >= 1 for e in edges)
    brute = [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4]
    assert union_find(len(prints), [(e.u, e.v) for e in edges]) == union_find(len(prints), brute)


def test_near_copies_are_the_components_of_fingerprints(docs, empty):
    kept = simhash.drop_copies(docs)
    assert kept.schema == docs.schema
    rows = sorted(((i, t) for i, t, _ in texts()), key=lambda r: (r[0] is None, r[0] or 0))
    prints = [print_of(t) for _, t in rows]
    roots = union_find(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter(rows[r][0] for r in set(roots))
    assert simhash.drop_copies(empty).count() == 0


def test_connected_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (3, 2), (300, 200)]
    found = dict(map(tuple, components.connected(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert found == {**{i: 0 for i in range(1, 41)}, **{k: 100 for k in range(101, 140)}, 300: 200}
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 7: toxicity -------------------------------------------------------------------------------


def test_toxicity_learns_words_and_keeps_extra_columns(spark, docs, empty):
    rng = random.Random(6)
    rows = [(i, prose(rng, 60) + (" vile horrid scoundrel " if i % 5 == 0 else " ") + prose(rng, 20), int(i % 5 == 0)) for i in range(400)]
    labelled = spark.createDataFrame(rows + [(900, None, 0), (901, "vile", None)], "doc_id long, text string, toxic int")
    weights = toxicity.learn(labelled.select("doc_id", "text"), labelled.where("doc_id % 4 <> 1").select("doc_id", "toxic"))
    assert 0 < len(weights) < 5000  # the L1 term leaves few coordinates
    scored = toxicity.score(labelled, weights).where("doc_id % 4 = 1 and doc_id < 900").collect()
    right = sum((r.score >= 0.5) == (r.toxic == 1) for r in scored)
    assert right / len(scored) > 0.95
    every = toxicity.score(docs, weights)
    assert every.columns == [c for c in docs.columns if c != "score"] + ["score"]
    assert all(0 <= r.score <= 1 for r in every.collect())
    assert toxicity.score(empty, weights).count() == 0
    assert toxicity.learn(empty, labelled.where("false").select("doc_id", "toxic")) == {}
    assert {r.score for r in toxicity.score(docs, {}).collect()} == {0.0}


# --- 8: suffix sorts ---------------------------------------------------------------------------


def repeats(rows: list[tuple]) -> Counter:
    count = Counter()
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    for _, b in data:
        count.update(b[s : s + 200] for s in range(len(b) - 199))
    found = Counter()
    for i, b in data:
        hit = np.zeros(len(b) + 1, int)
        for s in range(len(b) - 199):
            if count[b[s : s + 200]] > 1:
                hit[s] += 1
                hit[s + 200] -= 1
        covered = np.cumsum(hit)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~covered].tobytes()
        found[(i, len(b), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest())] += 1
    return found


@pytest.mark.parametrize("group", [1, 4096])
def test_repeated_passages(docs, empty, group):
    # group = 1 sends every passage along the way for passages with very many places
    found = suffix_dedup.without_repeats(docs, group)
    rows = found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, rows)) == repeats(texts())
    assert suffix_dedup.without_repeats(empty).count() == 0


def test_remove_repeats_keeps_rows_and_columns(docs):
    cut = suffix_dedup.remove_repeats(docs)
    assert [f.name for f in cut.schema] == docs.columns
    assert cut.count() == docs.count()
    assert {r.kept for r in cut.select("kept").collect()} == {1}


def test_suffix_sort_orders_within_groups():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    starts = rng.integers(0, 2700, 400)
    lengths = np.minimum(rng.integers(0, 200, 400), len(data) - starts)
    groups = np.sort(rng.integers(0, 9, 400))
    order, common = suffix_dedup.suffix_sort(data, starts, lengths, groups)
    strings = [data[s : s + n].tobytes() for s, n in zip(starts, lengths)]
    assert [(groups[i], strings[i]) for i in order] == sorted(zip(groups, strings))
    for k in range(1, 400):
        a, b = strings[order[k - 1]], strings[order[k]]
        same = next((p for p, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[k] == (same if groups[order[k - 1]] == groups[order[k]] else -1)


def test_alike_surroundings_are_sorted_once(monkeypatch):
    # Copies of a passage used to be sorted one by one, so the work per byte grew with their number.
    rng = random.Random(6)
    core = prose(rng, 60).encode()[:240]
    other = core[:100] + b"#" + core[101:]  # the k-gram at 120 is the same, the windows over place 100 are not
    short = core[40:]
    rows = [(core, 120)] * 500 + [(other, 120)] + [(short, 80)] * 3 + [(prose(rng, 60).encode()[:240], 50)]
    hashes = [7] * 504 + [9]
    sorted_ = []
    sort = suffix_dedup.suffix_sort
    monkeypatch.setattr(suffix_dedup, "suffix_sort", lambda data, starts, *rest: sorted_.append(len(starts)) or sort(data, starts, *rest))
    got = {
        "hash": np.array(hashes, np.uint64), "row": np.arange(len(rows)), "low": np.arange(len(rows)) % 5,
        "before": np.array([b for _, b in rows], np.int16),
        "after": np.array([b - (len(t) - 200) for t, b in rows], np.int16),
        "data": np.frombuffer(b"".join(t for t, _ in rows), np.uint8),
    }
    count = Counter()
    for (text, _), h in zip(rows, hashes):
        count.update((h, text[s : s + 200]) for s in range(len(text) - 199))
    wanted = Counter(
        (i, i % 5 + s) for i, ((text, _), h) in enumerate(zip(rows, hashes)) for s in range(len(text) - 199) if count[(h, text[s : s + 200])] > 1
    )
    found = Counter()
    for batch in suffix_dedup.sorted_groups(got, 4096):
        for row, low, high in zip(*(c.to_pylist() for c in batch.columns)):
            found.update((row, at) for at in range(low, high + 1))
    assert found == wanted
    assert sorted_ == [3, 3]


def test_hashes_of_all_places_and_runs():
    data = np.random.default_rng(3).integers(0, 256, 1000).astype(np.uint8)
    hashes = suffix_dedup.PrefixHash(data)
    assert (hashes.of_all(40) == hashes.of(np.arange(961), 40)).all()
    found = np.array([[1, 1, 0, 1], [0, 0, 0, 0], [1, 1, 1, 1], [1, 0, 0, 1], [0, 1, 1, 0]], bool)
    runs = list(zip(*(c.tolist() for c in suffix_dedup._runs(found))))
    assert runs == [(0, 0, 1), (0, 3, 3), (2, 0, 3), (3, 0, 0), (3, 3, 3), (4, 1, 2)]
    assert not len(suffix_dedup._runs(np.zeros((0, 4), bool))[0])


def test_hash_collisions_are_found_by_their_bytes(monkeypatch):
    monkeypatch.setattr(suffix_dedup.PrefixHash, "of", lambda self, start, length: np.zeros(len(start), np.uint64))
    data = np.frombuffer(b"bananabandana", np.uint8)
    starts = np.arange(len(data))
    order, _ = suffix_dedup.suffix_sort(data, starts, len(data) - starts, np.zeros(len(data), np.int64))
    assert [data[s:].tobytes() for s in order] == sorted(data[s:].tobytes() for s in starts)


def test_anchors_agree_over_segment_ends(monkeypatch):
    data = np.frombuffer(prose(random.Random(9), 3000).encode(), np.uint8)
    whole = suffix_dedup.anchors(data)
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 1000)
    for a, b in zip(whole, suffix_dedup.anchors(data)):
        assert (a == b).all()


# --- 9: nearest neighbours ---------------------------------------------------------------------


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(7)
    vectors = rng.standard_normal((600, 16)).round(3)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[5].tolist(), "x") for i in range(40)] + [rows[8], rows[8]]
    odd = [(2000, None, "x"), (2020, [0.0] * 16, "x"), (2040, [float("nan")] + [1.0] * 15, "x"), (2060, [1.0, 2.0], "x"), (None, vectors[1].tolist(), "x")]
    odd.append((2080, [float("inf")] + [1.0] * 15, "x"))
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank string")
    asked = frame.where("vec_id % 20 = 0")
    for probes in (neighbours.PROBES, len(neighbours._STEPS)):
        found: dict[int, list] = {}
        for r in neighbours.nearest(frame, asked, probes=probes, shard=200, block=16).collect():
            found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        ids = np.array([i for i, _, _ in {r[0]: r for r in rows}.values()])
        matrix = np.array([v for _, v, _ in {r[0]: r for r in rows}.values()])
        hit = total = 0
        for i, v, _ in {r[0]: r for r in rows if r[0] % 20 == 0}.values():
            exact = sorted((-float((w * np.array(v)).sum()), int(j)) for j, w in zip(ids, matrix) if j != i)[:20]
            got = sorted(found[i])
            assert [r for r, _, _ in got] == list(range(1, len(got) + 1))
            assert [(-s, j) for _, j, s in got] == sorted((-s, j) for _, j, s in got)
            hit += len({j for _, j in exact} & {j for _, j, _ in got})
            total += len(exact)
        assert hit / total >= 0.9
    assert neighbours.nearest(frame.where("false"), asked.where("false")).count() == 0
    assert len(neighbours.nearest(frame.where("vec_id < 5"), frame.where("vec_id = 0")).collect()) == 4


@pytest.mark.parametrize("count", [40, len(neighbours._STEPS)])
def test_queries_looked_up_together_visit_what_each_visits_alone(monkeypatch, count):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((400, 6))
    tables = neighbours.Tables(6, float(np.sqrt((vectors**2).sum(axis=1)).max()), vectors)
    base = pd.DataFrame({"vector": list(vectors), "ids": [[i] for i in range(400)]})
    asked = pd.DataFrame({"query": range(30), "vector": list(vectors[:30])})
    codes = tables.codes(np.floor(tables.places(tables.lift(vectors))))
    wanted = tables.probes(vectors[:30], count)
    assert wanted.shape == (30, neighbours.TABLES, count)
    near = []  # for each query the best of the vectors in its buckets, or of all where these are few
    for i in range(30):
        at = [v for v in range(400) if any(codes[v, t] in wanted[i, t] for t in range(neighbours.TABLES))]
        scored = sorted((-(vectors[v] * vectors[i]).sum(), v) for v in (at if len(at) >= 5 else range(400)))
        near += [(i, v, -s) for s, v in scored[:5]]
    for dense in (0.0, 2.0):
        monkeypatch.setattr(neighbours, "DENSE", dense)
        for together in (1, 7, 100):
            monkeypatch.setattr(neighbours, "TOGETHER", together)
            found = neighbours._in_shard(tables, base, asked, 5, count)
            assert found[["query", "vec_id"]].values.tolist() == [[q, v] for q, v, _ in near]
            assert found["score"].tolist() == pytest.approx([s for _, _, s in near])


# --- 1: hierarchical Pitman-Yor ----------------------------------------------------------------


def test_scores_and_base(spark, docs, empty):
    train = docs.where("doc_id is null or doc_id % 5 <> 1")
    model = hpylm.fit(train)
    counts = Counter()
    for i, t, _ in texts():
        if i is None or i % 5 != 1:
            counts.update([*words_of(t), None])
    total, kinds = sum(counts.values()), len(counts)
    assert (model.totals.tokens, model.totals.vocabulary) == (total, kinds)
    found = hpylm.score(docs, model).collect()
    wanted = Counter()
    for i, t, _ in texts():
        tokens = [*words_of(t), None]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens)
        wanted[(i, len(tokens), sum(counts[w] > 0 for w in tokens), round(base, 6))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in found) == wanted
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    assert sum(r.score for r in found) > sum(r.base_score for r in found)
    assert hpylm.score(empty, model).count() == 0
    assert all(math.isfinite(r.score) for r in hpylm.score(docs, hpylm.fit(empty)).collect())


def test_copies_of_frequent_tokens_change_no_score(docs):
    model = hpylm.fit(docs)
    assert model.copies
    plain = hpylm.Model(model.seats, model.totals, {}, model.parts)
    one, two = (sorted((str(r.doc_id), round(r.score, 9)) for r in hpylm.score(docs, m).collect()) for m in (model, plain))
    assert one == two


def test_probabilities_add_up_to_one(docs):
    model = hpylm.fit(docs)
    seats = hpylm._Seats(unpacked(iter(model.seats.toArrow().combine_chunks().to_batches()), hpylm._KINDS), model.totals)
    unknown = np.uint64(12345)
    for context in (int(hpylm._tokens_of(b"the of")[1][1]), 7, 99_999):
        tokens = np.append(seats.token, unknown)
        p, _ = seats.probabilities(tokens, np.full(len(tokens), context))
        assert p.sum() == pytest.approx(1.0)


def test_seats_take_less_memory_than_their_values(docs):
    """Packed values pass through an executor's memory as they are, whatever their file's own compression."""
    rows = hpylm.fit(docs).seats.select(*hpylm._ARRAYS).collect()
    packed = sum(len(value) for row in rows for value in row)
    seats = hpylm.fit(docs).seats.toArrow().combine_chunks().to_batches()
    got = unpacked(iter(seats), hpylm._KINDS)
    assert 2 * packed < sum(x.nbytes for x in got.values())
    assert got["pairs"].sum() == len(got["context"]) == len(got["n"]) and got["n"].min() > 0


def test_jobs_of_a_fit_do_not_grow_with_the_partitions(spark, docs):
    names, jobs = {"spark.sql.shuffle.partitions": None, "spark.sql.adaptive.coalescePartitions.enabled": None}, []
    tracker = spark.sparkContext.statusTracker()
    for partitions in ("2", "12"):
        names = {key: names[key] or spark.conf.get(key) for key in names}
        group = f"fit-{partitions}"
        spark.sparkContext.setJobGroup(group, "")
        try:
            for key, value in zip(names, (partitions, "false")):
                spark.conf.set(key, value)
            hpylm.fit(docs.limit(20))
            jobs.append(len(tracker.getJobIdsForGroup(group)))
        finally:
            for key, value in names.items():
                spark.conf.set(key, value)
            spark.sparkContext._jsc.sc().clearJobGroup()
    assert jobs[1] <= jobs[0] + 7


def test_texts_put_together_have_the_tokens_of_each():
    some = [b"The of  the\x0bOF", b"", b" ", "été the \u00a0x".encode(), b"a b a b the of"]
    tokens, pair, number = hpylm._put_together(some)
    token, context = hpylm._apart(tokens, pair)
    hashes = {}
    for k, text in enumerate(some):
        words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text.decode().translate({c: c + 32 for c in range(65, 91)}))]
        hashes[k] = [hpylm.xxh64_intdigest(w, hpylm.SEED) for w in [*words, b" end"]]
        alone = hpylm._tokens_of(text)
        assert token[number == k].tolist() == hashes[k] == alone[0].tolist()
        assert context[number == k].tolist() == alone[1].tolist()
    # A context is that of the word before, in whatever text.
    before = [h for k in hashes for h in [hashes[k][-1], *hashes[k][:-1]]]
    assert len(set(zip(before, context.tolist()))) == len(set(before)) and (np.diff(tokens.astype(object)) > 0).all()


def test_zipped_values_come_back():
    rows = [(3, [np.arange(5000), np.zeros(0, np.int32)]), (1, [np.zeros(7, np.int64), np.ones(2, np.int32)])]
    kinds = {"x": np.int64, "y": np.int32}
    plain, zipped = (packed_batch(rows, list(kinds), zipped=z) for z in (False, True))
    assert zipped.nbytes < plain.nbytes and sizes_of(zipped, "y") == [0, 8]
    for k in kinds:
        assert unpacked(iter([zipped]), kinds)[k].tolist() == unpacked(iter([plain]), kinds)[k].tolist()


def test_ties_of_many_distinct_vectors_go_to_the_smaller_ids(spark):
    # 80 distinct vectors of zeros and ones have an inner product of 1 with the query, none has more.
    rows = [(1000, [1.0] + [0.0] * 80)]
    ids = list(range(80))
    random.Random(3).shuffle(ids)
    rows += [(i, [1.0] + [float(j == place) for j in range(80)]) for place, i in enumerate(ids)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.nearest(frame, frame.where("vec_id = 1000"), k=5).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [0, 1, 2, 3, 4]


def test_scores_do_not_depend_on_how_tasks_share_the_tokens(spark, docs):
    """Each sweep uses the totals over all tokens, so tasks that have one part or all parts seat alike."""
    key, found = "spark.sql.adaptive.coalescePartitions.enabled", []
    parts = hpylm.parts_of(spark)
    for coalesced in ("true", "false"):
        spark.conf.set(key, coalesced)
        try:
            model = hpylm.fit(docs)
            found.append(sorted((str(r.doc_id), round(r.score, 9)) for r in hpylm.score(docs, model).collect()))
        finally:
            spark.conf.unset(key)
        assert model.parts == parts
    assert found[0] == found[1]


def test_a_sweep_takes_the_totals_of_all_tokens():
    rng = np.random.default_rng(2)
    token, context = (x.ravel() for x in np.meshgrid(np.arange(40, dtype=np.uint64), np.arange(8), indexing="ij"))
    n = rng.integers(1, 30, len(token))
    whole = hpylm.Share(token, context, n)
    halves = [hpylm.Share(token[on], context[on], n[on]) for on in (token < 20, token >= 20)]
    ones = lambda s: [np.ones(len(x), np.int64) for x in (s.n, s.parent_key, s.first)]
    together, apart = hpylm.Sums(), hpylm.Sums()
    together.add(whole, *ones(whole))
    for half in halves:
        apart.add(half, *ones(half))
    for name in ("size", "tables_a", "tables_b", "ones", "tables_r", "vocabulary", "tokens"):
        assert np.array_equal(getattr(together, name), getattr(apart, name))
    wide = {k: whole.sweep(*ones(whole), together, np.random.default_rng(k))[0].sum() for k in range(200)}
    split = {k: sum(h.sweep(*ones(h), apart, np.random.default_rng([k, i]))[0].sum() for i, h in enumerate(halves)) for k in range(200)}
    assert np.mean(list(wide.values())) == pytest.approx(np.mean(list(split.values())), rel=0.01)


def test_seats_stay_between_one_and_the_customers():
    rng = np.random.default_rng(1)
    customers = np.array([1, 2, 5, 70, 10_000, 3_000_000])
    found = []
    for pull in (0.01, 50.0):
        tables = seating.draw(customers, np.ones(6, np.int64), seating.seatings(0.7), lambda i, a: np.full(len(a), math.log(pull)), rng)
        assert (tables >= 1).all() and (tables <= customers).all() and tables[0] == 1
        found.append(tables)
    assert (found[1][2:] > found[0][2:]).all()
    least = np.array([1, 2, 5, 60, 9_990, 2_999_000])
    tables = seating.draw(customers, least, seating.seatings(0.7), lambda i, a: np.full(len(a), -3.0), rng)
    assert (tables >= least).all() and (tables <= customers).all()


@pytest.mark.parametrize("discount", [0.05, 0.5, 0.95])
def test_numbers_of_seatings_beyond_the_table_follow_the_recurrence(discount):
    """Ratios at 2,000 customers against the recurrence S(n + 1, a) = S(n, a - 1) + (n - d a) S(n, a)."""
    n, log = 2000, np.full(2003, -np.inf)
    log[1] = 0.0
    rows = {}
    for m in range(1, n + 1):
        a = np.arange(1, m + 2)
        rows = {m: log.copy(), m - 1: rows.get(m - 1, log)}
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(a <= m, np.log(np.maximum(m - discount * a, 1e-300)) + log[1 : m + 2], -np.inf)
        log[1 : m + 2] = np.logaddexp(log[: m + 1], stay)
    last, a = rows[n], np.arange(1, n - 50)  # closer to n the saddle point is off by 1 / (2 (n - a))
    own = seating.seatings(discount)
    assert np.abs(own.one_more_table(np.full(len(a), n), a) - (last[2 : n - 49] - last[1 : n - 50])).max() < 0.02
    assert np.abs(own.one_more_customer(np.full(len(a), n), a) - (log[1 : n - 50] - last[1 : n - 50])).max() < 0.02


def test_large_dishes_are_drawn_by_their_chances():
    """Means of draws for 600 customers (windows) against chances summed over all numbers of tables."""
    n, pull, own = 600, math.log(3.0), seating.seatings(0.6)
    a = np.arange(1, n)
    log = np.concatenate([[0.0], np.cumsum(own.one_more_table(np.full(n - 1, n), a) + pull)])
    chance = np.exp(log - log.max()) / np.exp(log - log.max()).sum()
    mean = (np.arange(1, n + 1) * chance).sum()
    spread = math.sqrt((np.arange(1, n + 1) ** 2 * chance).sum() - mean**2)
    drawn = seating.draw(np.full(4000, n), np.ones(4000, np.int64), own, lambda i, k: np.full(len(k), pull), np.random.default_rng(4))
    assert drawn.mean() == pytest.approx(mean, rel=0.02) and drawn.std() == pytest.approx(spread, rel=0.06)


class OneByOne:
    """Seats customers one at a time, with every table kept: the plain Gibbs sampler."""

    def __init__(self, discounts, vocabulary, seed):
        self.d, self.vocabulary, self.rng = discounts, vocabulary, random.Random(seed)
        self.tables = {}  # (level, restaurant) -> dish -> sizes of its tables

    def chance(self, level, place, dish):
        if level == 3:
            return 1 / (self.vocabulary + 1)
        here = self.tables.get((level, place), {})
        served, n, t = here.get(dish, []), sum(map(sum, here.values())), sum(map(len, here.values()))
        theta, d = hpylm.THETA[level], self.d[level]
        above = self.chance(level + 1, self.over(level, place), dish)
        return (sum(served) - d * len(served) + (theta + d * t) * above) / (theta + n)

    def over(self, level, place):
        return place >> hpylm._WITHIN if level == 0 else 0

    def add(self, level, place, dish):
        if level == 3:
            return
        here = self.tables.setdefault((level, place), {})
        served, t = here.setdefault(dish, []), sum(map(len, here.values()))
        new = (hpylm.THETA[level] + self.d[level] * t) * self.chance(level + 1, self.over(level, place), dish)
        at = self.rng.choices(range(len(served) + 1), [s - self.d[level] for s in served] + [new])[0]
        if at < len(served):
            served[at] += 1
        else:
            served.append(1)
            self.add(level + 1, self.over(level, place), dish)

    def remove(self, level, place, dish):
        if level == 3:
            return
        served = self.tables[level, place][dish]
        at = self.rng.choices(range(len(served)), served)[0]
        served[at] -= 1
        if not served[at]:
            del served[at]
            self.remove(level + 1, self.over(level, place), dish)

    def count(self, level):
        return sum(len(s) for (k, _), dishes in self.tables.items() if k == level for s in dishes.values())


def swept(token, context, n, discounts, times):
    """Mean tables of contexts, parents and root over many sweeps."""
    share, rng = hpylm.Share(token, context, n), np.random.default_rng(3)
    tables = [np.ones(len(x), np.int64) for x in (share.n, share.parent_key, share.first)]
    found = []
    for _ in range(times):
        sums = hpylm.Sums()
        sums.add(share, *tables)
        tables = share.sweep(*tables, sums, rng, discounts)
        found.append([x.sum() for x in tables])
    return np.mean(found[100:], axis=0)


def test_a_token_alone_has_the_tables_of_the_exact_distribution():
    """One token with 30 customers: the chances of all (contexts', parents', root's) tables, added up."""
    discounts, n = (0.7, 0.6, 0.5), 30
    ways = []
    for d in discounts:
        s = np.zeros((n + 1, n + 2))
        s[1, 1] = 1
        for m in range(1, n):
            for a in range(1, m + 2):
                s[m + 1, a] = s[m, a - 1] + (m - d * a) * s[m, a]
        ways.append(s)
    rise = lambda start, step, times: math.prod(start + step * j for j in range(times))
    theta, total, mean = hpylm.THETA, 0.0, np.zeros(3)
    for a in range(1, n + 1):
        for b in range(1, a + 1):
            for c in range(1, b + 1):
                p = ways[0][n, a] * rise(theta[0], discounts[0], a) / rise(theta[1], 1, a)
                p *= ways[1][a, b] * rise(theta[1], discounts[1], b) / rise(theta[2], 1, b)
                p *= ways[2][b, c] * rise(theta[2], discounts[2], c) * 0.5**c
                total, mean = total + p, mean + p * np.array([a, b, c])
    found = swept(np.array([5], np.uint64), np.array([3]), np.array([n]), discounts, 6000)
    assert found == pytest.approx(mean / total, rel=0.03)


def test_seatings_agree_with_customers_moved_one_at_a_time():
    """Tokens that share contexts and parents, against the plain sampler with the same discounts."""
    discounts = (0.7, 0.6, 0.5)
    token = np.array([1, 1, 1, 2, 2, 3, 3, 4], np.uint64)
    context, n = np.array([3, 4, 700, 3, 700, 4, 5, 700]), np.array([9, 4, 6, 1, 12, 2, 3, 1])
    plain = OneByOne(discounts, len(set(token.tolist())), 1)
    customers = [(int(c), int(t)) for t, c, k in zip(token, context, n) for _ in range(k)]
    for c, t in customers:
        plain.add(0, c, t)
    wanted = []
    for _ in range(5000):
        for c, t in customers:
            plain.remove(0, c, t)
            plain.add(0, c, t)
        wanted.append([plain.count(level) for level in range(3)])
    assert swept(token, context, n, discounts, 5000) == pytest.approx(np.mean(wanted[100:], axis=0), rel=0.05)
