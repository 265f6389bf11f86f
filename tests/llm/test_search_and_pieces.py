"""SentencePiece encoding, whitening and ranked search against the public library and brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from array import array
from collections import Counter
from decimal import Decimal

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from loupewright.llm import lexical, sentence_pieces, whitening
from loupewright.llm.common import table

MODEL = public_tokenizers.path(sentence_pieces.MODEL)
SIGNS = "abetionsr ▁  ..,,²³'\"-()\n\t\r\x00日本語かな한국éñß😀Я́न्0123456789<>|#s"


@pytest.fixture(scope="module")
def coder():
    return sentence_pieces.PieceCoder(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def ids_of(coder, text):
    return array("i", coder.encode(text)).tolist()


# SentencePiece


def test_ids_and_decoded_texts_are_those_of_the_library(coder, library):
    rng = random.Random(1)
    for _ in range(4000):
        text = "".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 60)))
        ids = library.encode(text)
        assert ids_of(coder, text) == ids
        assert coder.decode(ids) == library.decode(ids)


def test_long_segments_without_a_cut(coder, library):
    rng = random.Random(2)
    for text in ("ab" * 30_000, "日本" * 5000, "".join(rng.choice("abcdefgh") for _ in range(20_000)), " " * 5000, "²." * 3000):
        assert ids_of(coder, text) == library.encode(text)


def test_positions_that_lead_nowhere_are_taken_back(coder):
    """Some words of the vocabulary's letters need it: the longest token first is not what merging gives."""
    rng = random.Random(3)
    turned = 0
    for _ in range(3000):
        word = "▁" + "".join(rng.choice("etaoinshr") for _ in range(12))
        found = coder.tokens(word)
        assert found == coder.merge(word)
        longest = max((word[:n] for n in range(1, len(word) + 1) if word[:n] in coder.ids), key=len)
        turned += found[0] != longest
    assert turned > 100


def test_pairs_are_judged_by_merging_again(coder):
    assert coder.fits("", "▁the") and not coder.fits("▁t", "he") and not coder.fits("t", "h")


def test_any_ids_decode_as_the_library_decodes_them(coder, library):
    rng = random.Random(4)
    size = library.get_piece_size()
    for _ in range(2000):
        ids = [rng.randrange(300 if rng.random() < 0.6 else size) for _ in range(rng.randint(0, 8))]
        assert coder.decode(ids) == library.decode(ids)


def test_a_worker_remembers_a_bounded_number(coder, library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "SEGMENTS", 3)
    monkeypatch.setattr(sentence_pieces, "PAIRS", 3)
    text = " ".join(f"word{i} niño{i}" for i in range(50)) + "x" * 100
    fresh = sentence_pieces.PieceCoder(MODEL)
    assert ids_of(fresh, text) == library.encode(text)
    assert len(fresh) <= 3 and len(fresh._fits) <= 3


def test_the_operator_on_nulls_empty_texts_repeats_and_other_columns(spark, library):
    rows = [(1, None, "a", 7), (2, "", "b", 7), (3, " ", None, 7), (3, " ", None, 7), (None, "niño ▁ 日本", "c", 7), (5, "wort " * 20_000, "d", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, `text_2` int").repartition(3)
    found = sentence_pieces.encode_texts(docs)
    assert found.columns == ["doc_id", "text", "text_2", "ids", "decoded"]
    wanted = Counter((i, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for i, t, *_ in rows)
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in found.collect()) == wanted
    again = sentence_pieces.decode_ids(found.drop("decoded"))
    assert Counter((r.doc_id, tuple(r.ids), r.decoded) for r in again.collect()) == wanted
    assert sentence_pieces.encode_texts(docs.limit(0)).count() == 0


def test_the_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in table(spark, folder, "documents").collect()}
    found = sentence_pieces.op11_sentence_pieces(spark, folder).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    wanted = {}
    for i, text in texts.items():
        ids = library.encode(text)
        wanted[i] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found} == wanted


# Whitening


def whole_rows(vectors):
    return [v for v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def expected(vectors):
    """Integer rows of the commonest length, their distinct list, and the exact n^2 * covariance."""
    rows = [[min(max(math.floor(256 * c), -(1 << 63)), (1 << 63) - 1) for c in v] for v in whole_rows(vectors)]
    fit = sorted(set(map(tuple, rows)))
    n, d = len(fit), len(fit[0])
    total = [sum(r[k] for r in fit) for k in range(d)]
    scatter = [[n * sum(r[i] * r[j] for r in fit) - total[i] * total[j] for j in range(d)] for i in range(d)]
    return rows, n, total, scatter


@pytest.mark.parametrize("block", [5, 64, 1 << 15])
def test_the_scatter_matrix_is_exact(spark, block):
    rng = np.random.default_rng(5)
    vectors = [list(map(float, v)) for v in rng.normal(size=(150, 7)) * [1, 3, 0.001, 40, 0, 1e6, 2e13]]
    vectors += [vectors[0]] * 60 + [[0.0] * 7, None, [1.0, None, 2.0, 3.0, 4.0, 5.0, 6.0], [float("nan")] * 7, [1.0, float("inf"), 2.0, 3.0, 4.0, 5.0, 6.0]]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(5)
    made, listed, width = whitening.fit(frame, block=block)
    rows, n, total, scatter = expected(vectors)
    assert (made.n, list(made.total), width, listed.count()) == (n, total, 7, n)
    value, vector = np.linalg.eigh(np.array([[float(x / (n * n)) for x in row] for row in scatter]))
    assert np.array_equal(made.value, value[::-1][:4])
    found = whitening.whiten(frame).collect()
    assert len(found) == 4 * len(rows)
    deviations = Counter(Decimal(sum((n * x - s) ** 2 for x, s in zip(r, total))) for r in rows)
    assert Counter(r.deviation for r in found if r.component == 1) == deviations


def test_whitened_values_against_plain_algebra(spark):
    rng = np.random.default_rng(6)
    plain = rng.normal(size=(400, 12)) @ rng.normal(size=(12, 12)) * 0.3
    frame = spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(plain)], "vec_id long, embedding array<float>")
    x = np.floor(256 * plain.astype(np.float32).astype(float))
    value, vector = np.linalg.eigh(np.cov(np.unique(x, axis=0).T, bias=True))
    wanted = (x - np.unique(x, axis=0).mean(axis=0)) @ vector[:, ::-1][:, :4] / np.sqrt(value[::-1][:4])
    found = whitening.whiten(frame).toPandas().pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    turn = np.sign((found * wanted).sum(axis=0))
    assert np.allclose(found * turn, wanted, atol=1e-9)
    rows = whitening.whiten(frame).select("component", "explained", "identity_error").distinct().orderBy("component").collect()
    assert np.allclose([r.explained for r in rows], value[::-1][:4] / value.sum(), rtol=1e-9)
    assert len({r.identity_error for r in rows}) == 1 and 0 <= rows[0].identity_error < 1e-9


def test_whitening_of_awkward_tables(spark):
    kind = "vec_id string, embedding array<double>, x int, component int"
    whiten = lambda rows: whitening.whiten(spark.createDataFrame(rows, kind)).collect()
    assert whiten([]) == [] and whiten([("a", None, 1, 1), ("b", [], 1, 1)]) == []
    same = whiten([("a", [1.0, 2.0], 1, 1)] * 3 + [(None, [1.0, 2.0], 1, 1)])  # one distinct vector: nothing varies
    assert len(same) == 8 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, None, None, None)}
    line = whiten([(str(i), [float(i), 2.0 * i, 3.0], 1, 1) for i in range(9)])  # one component has variance
    assert {r.component for r in line if r.whitened is None} == {2, 3} and {r.component for r in line} == {1, 2, 3}
    assert all(r.identity_error < 1e-9 for r in line)
    mixed = whiten([(str(i), [float(i), float(i * i)], 1, 1) for i in range(6)] + [("odd", [1.0, 2.0, 3.0], 1, 1)])
    assert {(r.deviation, r.whitened, r.n) for r in mixed if r.vec_id == "odd"} == {(None, None, 6)}
    huge = whiten([(str(i), [s * 1e300, float(i)], 1, 1) for i, s in enumerate((1, -1, 1, -1, 1))])  # at the ends of a long
    assert len(huge) == 10 and all(r.identity_error < 1e-9 for r in huge)


# Ranked search


def brute(docs, items, k=20):
    """Rows by the formula, one document and item at a time; documents are (id, text), items (id, text)."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), t or ""))
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [(i, bag) for i, bag in bags if bag]
    documents, total = len(bags), sum(sum(bag.values()) for _, bag in bags)
    df = Counter(t for _, bag in bags for t in bag)
    rows = []
    for item, text in items:
        scored = []
        for i, bag in bags:
            m = 100 - 25 + (25 * sum(bag.values()) * documents) // total
            s = sum(
                math.floor(1000 * math.log((2 * documents + 2) / (2 * df[t] + 1))) * ((1000000000 * bag[t]) // (1000 * bag[t] + 12 * m))
                for t in words(text)
            )
            if s > 0:
                scored.append((-s, i is None, i))
        scored.sort(key=lambda e: (e[0], e[1], e[2] or 0))
        rows += [(item, place, i, -s) for place, (s, _, i) in enumerate(scored[:k], 1)]
    return Counter(rows)


def collection(rng):
    words = [f"w{n}" for n in range(60)] + ["Über", "niño", "日本", "x9", "A"]
    weights = [1 / (n + 1) for n in range(len(words))]
    made = lambda n: " ".join(rng.choices(words, weights, k=n))
    docs = [(i, made(rng.randint(1, 60))) for i in range(300)]
    copy = made(30)
    docs += [(1000 + i, copy) for i in range(200)] + [(5, copy), (5, copy), (None, copy), (None, None), (7000, ""), (7001, "-- ! --")]
    docs += [(8000 + i, " ".join(words[: i + 1])) for i in range(40)]  # paths that leave one document at a time
    docs.append((9000, made(20_000)))
    items = [(i, made(rng.randint(1, 25))) for i in range(30)] + [(3, "w1 w1 W1 über"), (3, "w1 w1 W1 über"), (None, copy)]
    return docs, items + [(50, None), (51, ""), (52, "nowhere to be found"), (53, "w40-w41_w42")]


@pytest.mark.parametrize("block, shard, leaf", [(1 << 18, 1 << 14, 64), (60, 50, 4), (1 << 18, 120, 1)])
def test_ranking_equals_brute_force(spark, monkeypatch, block, shard, leaf):
    monkeypatch.setattr(lexical.Tree.__init__, "__defaults__", (leaf,))
    docs, items = collection(random.Random(7))
    frame = spark.createDataFrame([(i, t, "n", 1) for i, t in docs], "doc_id long, text string, terms string, row int").repartition(3)
    asked = spark.createDataFrame([(i, t, 1, 0.5) for i, t in items], "item_id int, text string, rank int, score double")
    found = lexical.rank(frame, asked, block=block, shard=shard)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, found.collect())) == brute(docs, items)


def test_a_tree_searched_by_itself_leaves_out_subtrees():
    rng = random.Random(8)
    docs, _ = collection(rng)
    ids = {w: n for n, w in enumerate(sorted({w for _, t in docs for w in (t or "").split()}))}
    bags = [Counter(ids[w] for w in t.split()) for _, t in docs if t and t[0] != "-"]
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    ranks, tf = np.array([t for b in bags for t in b]), np.array([c for b in bags for c in b.values()])
    m = lexical.measures([sum(b.values()) for b in bags], len(bags), sum(sum(b.values()) for b in bags))
    tree = lexical.Tree(starts, ranks, tf, m, np.arange(len(bags)), leaf=4)
    assert len(tree.begin) > 20 and (tree.begin[0], tree.end[0]) == (0, len(bags))
    for k in range(len(tree.begin)):
        if tree.last[k]:  # children cover their parent, and its bounds cover theirs
            below = range(tree.first[k], tree.last[k])
            assert [tree.begin[c] for c in below] == [tree.begin[k]] + [tree.end[c] for c in below][:-1]
            assert tree.end[below[-1]] == tree.end[k]
            assert (tree.bounds[k] >= tree.bounds[list(below)].max(axis=0)).all()
    seen = []
    tree.last = type("Seen", (list,), {"__getitem__": lambda self, n: seen.append(n) or list.__getitem__(self, n)})(tree.last)
    asked = np.array([ids["w50"], ids["w59"]])
    weights = np.array([7000, 9000])
    exact = sorted((-sum(w * lexical.gain(np.int64(b[t]), m[i]) for t, w in zip(asked, weights)), i) for i, b in enumerate(bags))
    assert [(-s, i) for s, i in tree.search(asked, weights, 5, 1)] == [(s, i) for s, i in exact[:5] if s < 0]
    assert len(set(seen)) < len(tree.begin) / 2


def test_ranking_of_empty_tables_and_text_ids(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), (None, "one")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "one")], "item_id string, text string")
    assert [(r["rank"], r.doc_id) for r in lexical.rank(docs, items).orderBy("rank").collect()] == [(1, None), (2, "a"), (3, "b")]
    assert lexical.rank(docs.limit(0), items).count() == lexical.rank(docs, items.limit(0)).count() == 0
    assert lexical.rank(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
