"""Each query over the whole small tables against a plain version of it."""

import brute
import pytest

from surveyloom.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()]


def rows(spark, name):
    return QUERIES[name](spark, SMALL).collect()


def test_op3(spark):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    want = brute.warc(pages)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows(spark, "op3_warc")}
    assert got == want


def test_op5(spark, documents):
    want = brute.lm_base([d[:2] for d in documents])
    found = rows(spark, "op5_lattice_lm")
    assert len(found) == len(documents)
    for r in found:
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert r.base_score == pytest.approx(w[3], rel=1e-9)
        assert r.held_out == (brute.crc(r.doc_id, 7) == 2)
        assert r.score < 0

def test_op7(spark, documents):
    lang = {d[0]: d[2] for d in documents}
    text = {d[0]: d[1] for d in documents}
    found = rows(spark, "op7_language_id")
    assert len(found) == len(documents)
    judged = [r for r in found if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in judged) / len(judged) > 0.97
    for r in found:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id] or ""))


def test_op8(spark, documents):
    import hashlib

    text = {d[0]: d[1] for d in documents}
    for r in rows(spark, "op8_pii"):
        want = brute.pii(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert r.spans == want or r.spans.startswith(want)


def test_op10(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    want = brute.links(vectors)
    got = {r.vec_id: (r.n_links, r.component_id) for r in rows(spark, "op10_e8_lattice")}
    assert got == want


def test_op2(spark, documents):
    want = brute.repeats([d[:2] for d in documents])
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows(spark, "op2_suffix_dedup")}
    assert got == want


def test_op4(spark, documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    want = brute.contamination([d[:2] for d in documents], items)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows(spark, "op4_decontamination")}
    assert got == want


def test_op6(spark, documents):
    import base64
    import hashlib
    import struct

    import public_tokenizers as public
    import tiktoken

    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    reference = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = {d[0]: d[1] or "" for d in documents}
    for r in rows(spark, "op6_byte_bpe"):
        ids = reference.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_op9(spark, documents):
    """Every pair of clearly similar texts is in one class, no class holds texts without a chain of similar ones."""
    import re
    from collections import defaultdict

    shingles = {}
    for i, t, _ in documents:
        w = re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    own = {r.doc_id: r.class_id for r in rows(spark, "op9_weighted_minhash")}
    members = defaultdict(list)
    for i, s in shingles.items():
        for x in s:
            members[x].append(i)
    shared = defaultdict(int)
    for held in members.values():
        for a in held if len(held) < 300 else ():
            for b in held:
                if a < b:
                    shared[a, b] += 1
    near = {p: n / len(shingles[p[0]] | shingles[p[1]]) for p, n in shared.items()}
    assert sum(j >= 0.85 for j in near.values()) > 50
    assert all(own[a] == own[b] for (a, b), j in near.items() if j >= 0.85)
    assert not [p for p, j in near.items() if own[p[0]] == own[p[1]] and j < 0.5]
