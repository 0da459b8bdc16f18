"""Hard negatives, fingerprints and the prefix trie against plain versions, over whole small tables and odd input."""

import hashlib
import random

import brute
import numpy as np
import pytest
from oracle_check import compare, duck
from pyspark.sql import functions as F

from surveyloom.llm import hard_negatives, prefix_trie, simhash
from surveyloom.llm.queries import QUERIES, SQL

SMALL = "/root/testdata/sf0.01"
VECTORS = "vec_id long, embedding array<double>, label int"
TURNS = "conv_id long, turn long, role string, text string"
SHIFTED = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


@pytest.mark.parametrize("name", ["op11_bond_negatives", "op13_prefix_trie"])
def test_query_matches_sql(spark, name):
    ok, note = compare(QUERIES[name](spark, SMALL), duck(SMALL), SQL[name])
    assert ok, note


def mined(spark, rows, schema=VECTORS, **options):
    found = hard_negatives.mine(spark.createDataFrame(rows, schema), F.expr("vec_id % 100 = 0"), F.expr(SHIFTED), **options)
    return sorted(tuple(r) for r in found.collect())


def test_negatives_over_many_segments_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-3, 4, 6) / 5).tolist(), int(rng.integers(0, 3))) for i in range(-300, 900)]  # many equal scores
    rows += [(1000, None, 1), (1100, [], 1), (1200, [0.1, None, 0.0, 0.0, 0.0, 0.0], 1), (1300, [float("nan")] * 6, 1), (1400, [float("inf")] * 6, 0)]
    rows += [(1500, [0.5] * 6, None), (None, [0.5] * 6, 1), (1600, [0.2, 0.1], 0), (1601, [0.2, 0.2], 0), (1602, [0.12, 0.1], 2), (1700, [0.0] * 6, 1)]
    want = brute.hard_negatives(rows)
    assert mined(spark, rows, segment=64) == want
    clashing = [(*r, 5, "x") for r in rows]
    assert mined(spark, clashing, f"{VECTORS}, row int, segment string") == want
    assert mined(spark, rows + rows) == want  # repeated rows count once
    assert mined(spark, []) == []


def test_negatives_large_components_and_equal_vectors(spark):
    rows = [(100, [3e5, -2e5, 1e5], 0), (1, [2e5, -2e5, 1e5], 0), (2, [1e5, -1e5, 9e4], 1), (3, [1.3e5, -1e5, 1e5], 1)]
    assert mined(spark, rows) == brute.hard_negatives(rows) != []
    assert mined(spark, [(i, [1e300, 1.0], i % 2) for i in (100, 2, 4, 1)]) is not None
    same = [(i, [0.5, 0.5], 0) for i in range(300)] + [(1000 + i, [0.4, 0.4], 1) for i in range(300)]
    assert mined(spark, same, segment=50) == brute.hard_negatives(same)
    twice = [(100, [0.5, 0.5], 0), (100, [0.5, 0.5], 1), (1, [0.5, 0.5], 0), (2, [0.3, 0.3], 1), (3, [0.2, 0.2], 0)]  # two rows under one id are two anchors
    assert {(r[0], r[1]) for r in mined(spark, twice)} == {(100, 1), (100, 2)}


def test_scan_prunes_and_keeps_the_first(spark):
    rng = np.random.default_rng(4)
    q = np.floor(256 * rng.normal(0, 0.125, (64, 2000)))
    low, high = q.min(axis=1), q.max(axis=1)
    anchor = q[:, 0] * np.exp(-np.arange(64) / 6)
    at, score = hard_negatives.scan(q, low, high, anchor, np.arange(2000) > 0, [(-np.inf, np.inf)], 5)
    exact = anchor @ q
    assert np.allclose(score, exact[at]) and len(at) < 200
    assert set(np.argsort(-exact[1:])[:5] + 1) <= set(at.tolist())


def next_documents(rows):
    order = sorted(rows, key=lambda r: -r[0])
    return [(a, b) for a, b in zip(order, order[1:] + order[:1], strict=True)]


def test_simhash_query(spark):
    rows = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    found = {r.doc_id: r for r in QUERIES["op12_simhash"](spark, SMALL).collect()}
    assert len(found) == len(rows)
    pairs = next_documents(rows)
    for (i, text), (j, following) in pairs:
        n = len(text) // 3
        new = text[: len(text) - n] + following[:n]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        assert r.near_next == pytest.approx(alike(r.fingerprint, found[j].fingerprint))
        assert r.near_edited == pytest.approx(alike(r.fingerprint, r.edited_fingerprint))
    for (i, text), (_, following) in pairs[::20]:
        n = len(text) // 3
        assert found[i].fingerprint == brute.simhash(text).hex()
        assert found[i].edited_fingerprint == brute.simhash(text[: len(text) - n] + following[:n]).hex()
    apart = [r for (i, t), (_, f) in pairs if t != f for r in [found[i]]]
    assert np.mean([r.near_edited > r.near_next for r in apart]) > 0.99
    want = brute.near_prints([(i, bytes.fromhex(r.fingerprint)) for i, r in found.items()], simhash.RADIUS)
    assert {i: (r.n_links, r.class_id) for i, r in found.items()} == want


def alike(a, b):
    share = bin(int(a, 16) ^ int(b, 16)).count("1") / (4 * len(a))
    return max(0.0, float(np.cos(np.pi * share)))


def test_simhash_odd_documents(spark):
    long = "".join(random.Random(1).choices("ab \n", k=300_000))
    rows = [(5, None, "x"), (3, "", "y"), (4, "ab", "z"), (1, long, None), (2, "\U0001f600 Ärger", None), (7, "same text here", ""), (6, "same text here", "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    found = {r.doc_id: r for r in simhash.beside_next(frame.repartition(3)).collect()}
    texts = [(r[0], r[1] or "") for r in rows]
    for (i, text), (j, following) in next_documents(texts):
        n = len(text) // 3
        assert found[i].edited_sha256 == hashlib.sha256((text[: len(text) - n] + following[:n]).encode()).hexdigest()
        assert found[i].fingerprint == brute.simhash(text).hex()
        assert found[i].near_next == pytest.approx(alike(found[i].fingerprint, found[j].fingerprint))
    assert found[3].fingerprint == found[5].fingerprint == "0" * 32 and found[6].fingerprint == found[7].fingerprint
    one = simhash.beside_next(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.beside_next(empty).count() == 0 and simhash.classes(simhash.fingerprints(empty)).count() == 0
    none = simhash.beside_next(spark.createDataFrame([(None, "a b c")] * 4 + [(1, "a b c")], "doc_id long, text string"))
    assert none.count() == 5 and none.where("near_next = 1").count() == 5
    top = simhash.classes(none).collect()
    assert [(r.n_links, r.class_id) for r in top] == [(4, 1)]


@pytest.mark.parametrize(("radius", "blocks"), [(3, 4), (3, 5), (1, 3), (0, 1)])
def test_block_tables_find_all_pairs(spark, radius, blocks):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 62, (12, 2), dtype=np.uint64)
    prints = []
    for k in range(600):  # one centre holds a third of all rows
        words = base[0 if k % 3 == 0 else rng.integers(12)].copy()
        for bit in rng.integers(0, 128, rng.integers(0, 4)):
            words[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
        prints.append((k, words.tobytes()))
    frame = spark.createDataFrame([(i, f.hex()) for i, f in prints], "doc_id long, fingerprint string")
    found = frame.join(simhash.classes(frame, radius, blocks, part=16), "fingerprint").collect()
    assert {r.doc_id: (r.n_links, r.class_id) for r in found} == brute.near_prints(prints, radius)


def grown(spark, rows, schema=TURNS, **options):
    found = prefix_trie.trie(spark.createDataFrame(rows, schema), **options)
    return sorted((tuple(r) for r in found.collect()), key=lambda r: (r[1], r[0]))


@pytest.mark.parametrize(("thin", "band"), [(1 << 20, 1 << 20), (1 << 20, 30), (20, 40), (3, 7), (0, 1)])
def test_trie_by_levels_and_bands(spark, thin, band):
    rng = random.Random(5)
    rows = []
    for c in range(-45, 90):
        n = 0 if c % 11 == 0 else rng.randint(1, 6)
        rows += [(c, None if t == 0 and c % 5 == 0 else t, rng.choice(["user", None]), rng.choice(["a b", "a  b c", "", None])) for t in range(n)]
    rows += [(7000 + k, t, "user", f"hot {t}") for k in range(40) for t in range(4)]  # copies
    rows += [(9000, t, "user", f"w{t} x") for t in range(60)] + [(9020, t, "user", f"w{min(t, 50)} x") for t in range(55)]
    rows += [(None, 1, "user", "gone")]
    assert grown(spark, rows, thin=thin, band=band) == brute.trie(rows)


def test_trie_odd_tables(spark):
    assert grown(spark, []) == [] == grown(spark, [(None, 1, "user", "x")])
    rows = [(1, 5, "user", "a"), (1, 5, "user", "a"), (1, None, None, None)]  # repeated rows are turns of their own
    assert [r[1] for r in grown(spark, rows)] == sorted(range(len(grown(spark, rows))))
    rows = [(20, 0, "user", "x " * 200_000), (21, 0, "user", "y")]
    wide = [(*r, 1, "z") for r in rows]
    assert grown(spark, wide, f"{TURNS}, depth int, words string") == brute.trie(rows)
    short = [(c, 0, "user", "only") for c in range(1, 8) if brute.crc(c, 4)]  # no base, one turn that is cut: nothing is left but the root
    assert grown(spark, short) == brute.trie(short) and len(brute.trie(short)) == 1


def test_trie_long_conversation_takes_many_runs(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 16)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = [(40, t, "user", f"t{t}") for t in range(150)] + [(41 + 20 * k, 0, "user", f"t{k % 2}") for k in range(60)]
    assert grown(spark, rows, thin=2, band=50) == brute.trie(rows)


def test_bands_cover_every_depth():
    for totals, floor, size in [([9, 9, 3], -1, 4), ([5], 2, 1), ([1000, 2], -1, 300), ([4, 4, 4], 3, 1), ([], -1, 5)]:
        found = prefix_trie.bands(totals, floor, size)
        depths = [d for low, high in found for d in range(high, low, -1)]
        assert depths == list(range(max(totals, default=floor), floor, -1))
        for low, high in found:
            rows = sum(sum(t >= d for t in totals) for d in range(low + 1, high + 1))
            assert rows <= size or high - low == 1
