"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and extra columns with clashing names."""

import base64
import hashlib

import brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from surveyloom.llm import bpe, chat, decontaminate, langid, lattice, lattice_lm, pii, suffix_dedup, warc, weighted_minhash

LONG = "wort " * 30_000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again until night falls.", "en"),
    (2, "The quick brown fox jumps over the lazy dog again and again until night falls.", "en"),
    (2, "The quick brown fox jumps over the lazy dog again and again until night falls.", "en"),
    (3, None, None),
    (4, "", "en"),
    (5, "12345 !!", None),
    (None, "no id here but some words to read", "en"),
    (6, LONG, "de"),
    (7, "mail a.b@c.de or +49 30 1234567", "de"),
]
CLASH = ["g", "b", "s", "e", "w", "doc", "keys", "cell", "t", "d1", "d2", "k1", "k2", "_k1", "_k2", "places", "c", "n", "block", "h", "score", "spans", "label", "part", "piece"]


@pytest.fixture(scope="module")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    return frame.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def by_id(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_suffix_dedup(docs, empty):
    got = by_id(suffix_dedup.remove(docs))
    assert sum(map(len, got.values())) == len(ROWS)
    want = brute.repeats([(i, t) for i, t, _ in dict.fromkeys(ROWS) if i is not None])
    for i, w in want.items():
        for r in got[i]:
            assert (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) == w
    assert got[None][0].n_removed == 0
    assert suffix_dedup.remove(empty).count() == 0


def test_suffix_dedup_in_small_shards(spark):
    import random

    rng = random.Random(3)
    text = lambda n, letters="abcdefgh ": "".join(rng.choice(letters) for _ in range(n))
    passages, line, rows = [text(400) for _ in range(6)], text(130), []
    for i in range(120):
        t = text(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            a = rng.randint(0, 250)
            t += rng.choice([rng.choice(passages)[a : a + rng.randint(50, 400)], line, rng.choice(["a", "ab", "é"]) * rng.randint(40, 200)]) + text(rng.randint(0, 150))
        rows.append((i, t))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute.repeats(rows)
    for shard in (8192, 20):  # the small one spreads the line's ends over shards that are merged
        assert {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in suffix_dedup.remove(frame, shard=shard).collect()} == want


def test_warc(spark):
    rows = [(1, "http://a/x?y#z", "<p>\r\n\r\nWARC/1.1\r\n</p>"), (2, None, "<p>\r\n\r\nWARC/1.1\r\n</p>"), (3, "odd\nurl", None), (4, "u", ""), (5, "v", "é" * 100_000), (5, "v", "é" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("first_page", "copies", "payload_digest", "record_type")})
    got = warc.round_trip(spark, pages).select(F.col("metadata.fields")["page-id"].cast("long").alias("page_id"), "response", "request").collect()
    assert len(got) == len(rows)
    want = brute.warc([(p, h) for p, _, h in rows])
    for r in got:
        assert (r.response.payload_bytes, r.response.payload_digest, r.response.record_type) == want[r.page_id][:3]
        assert r.request is not None
        if r.response.record_type == "response":
            html = next(h for p, _, h in rows if p == r.page_id) or ""
            assert bytes(r.response.payload).decode() == html
            assert base64.b32encode(hashlib.sha1(html.encode()).digest()).decode() == r.response.payload_digest
    assert warc.round_trip(spark, pages.where("false")).count() == 0


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, "brown fox jumps"), (1, "brown fox jumps"), (2, None), (3, ""), (4, "words to read"), (None, "lazy dog")], "item_id int, text string")
    items = items.withColumns({c: F.lit("x") for c in ("iw", "n", "size", "item")})
    got = by_id(decontaminate.contamination(docs, items))
    assert [r.n_hit for r in got[2]] == [5, 5] and got[2][0].item_ids == ["1"]
    assert got[None][0].item_ids == ["4"] and got[None][0].contaminated
    assert got[3][0].n_words == got[4][0].n_words == 0 and not got[3][0].contaminated
    assert got[6][0].n_words == 30_000
    assert decontaminate.contamination(empty, items).count() == 0
    assert not decontaminate.contamination(docs, items.where("false")).where("contaminated").count()


def test_lattice_lm(docs, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = by_id(lattice_lm.score(docs, path))
    want = brute.lm_base([(i, t) for i, t, _ in ROWS if i is not None and i != 2])
    assert got[3][0].n_tokens == got[4][0].n_tokens == 1
    assert got[None][0].held_out
    assert got[2][0] == got[2][1]
    assert got[6][0].n_tokens == want[6][0]
    assert all(r.score < 0 for rs in got.values() for r in rs)
    assert lattice_lm.score(empty, path).count() == 0


def test_lattice_sums_all_segmentations():
    import numpy as np

    own = lattice_lm.pieces(public_tokenizers.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(0)
    log_p = np.log(rng.random(own.size) / own.size)
    names = {own.tokenizer.id_to_piece(i): i for i in range(own.size) if own.piece_of is not None and not own.tokenizer.is_byte(i) and not own.tokenizer.is_control(i) and not own.tokenizer.is_unknown(i)}

    def total(word):
        if not word:
            return 1.0
        p = sum(np.exp(log_p[names[word[:k]]]) * total(word[k:]) for k in range(1, len(word) + 1) if word[:k] in names)
        if word[0] not in names:
            p += np.exp(log_p[own.byte_ids[list(word[0].encode())]].sum()) * total(word[1:])
        return p

    words = ["▁the", "▁another", "▁ère", "▁x丂y", "▁" + "the" * 4]
    got = lattice_lm.forward(words, own, log_p)
    assert np.allclose(got, [np.log(total(w)) for w in words])


def test_trained_words_are_edges(spark):
    import numpy as np

    found = lattice_lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model")).where("held_out").agg(F.sum("score")).first()
    assert found[0] > -280_000  # -322,582 by pieces alone
    count = np.array([5, 1, 1, 0])
    p = np.exp(lattice_lm.with_edges(np.log(np.full(4, 0.25)), count, 7, 0.375))
    assert p.sum() == pytest.approx(1) and p[0] == pytest.approx(0.625 * 5 / 7 + 0.375 / 4)


def test_bpe(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = by_id(bpe.encode_decode(docs, path, public_tokenizers.PATTERN, ("ids", "decoded", "digests")))
    assert got[3][0].n_tokens == got[4][0].n_tokens == 0
    assert got[6][0].decoded == LONG
    assert got[2][0].ids == got[2][1].ids == got[1][0].ids
    assert bpe.encode_decode(empty, path, public_tokenizers.PATTERN).count() == 0


def test_language_id(docs, empty):
    model = langid.fit(docs)
    got = by_id(langid.predict(docs, model, ["doc_id"]))
    assert got[3][0].lang_pred == got[4][0].lang_pred == got[5][0].lang_pred == "und"
    assert got[1][0].lang_pred == "en" and got[6][0].lang_pred == "de"
    assert got[2][0] == got[2][1]
    none = langid.fit(empty)
    assert {r.lang_pred for r in langid.predict(docs, none, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(empty, model, ["doc_id"]).count() == 0


def test_language_codes_correct_errors():
    code = langid.code_matrix(9)
    apart = (code.shape[1] - code @ code.T) / 2
    assert apart[~(apart == 0)].min() >= 5 and len({tuple(c) for c in code}) == 9


def test_personal_data(docs, empty):
    got = by_id(pii.find(docs))
    assert got[7][0].base == brute.pii(ROWS[8][1]) and got[7][0].n_email == got[7][0].n_phone == 1
    assert got[3][0].spans == got[4][0].spans == "" and len(got[2]) == 2
    clean = by_id(pii.sanitise(docs, ["doc_id", "text", "g"]))
    assert clean[7][0].text == "mail [EMAIL] or [PHONE]" and clean[7][0].g == "x"
    assert clean[3][0].text is None and clean[6][0].text == LONG
    assert pii.find(empty).count() == 0 and pii.sanitise(empty, ["doc_id", "text"]).count() == 0


@pytest.mark.parametrize("text", ["a@b@c.d", "x" * 50_000, "1" * 50_000, "a.b@c.d.e@f.g", "1.2.3.4.5.6.7.8 256.1.1.1", "4111 1111-1111 1111 +1 (2", "+49-30-123456.78", "@@a@.b", "0001.02.3.004", "+1(((((" * 500])
def test_patterns(text):
    if len(text) < 40_000 or text[0] == "x":
        assert ",".join(f"{k}:{a}:{b}" for k, a, b in pii.base_spans(text)) == (brute.pii(text) if len(text) < 40_000 else "")
    else:
        assert pii.base_spans(text) == []


def test_terms_that_disclose(spark):
    rows = [(i, f"{'abcdefghij'[i % 10]} colour number today zanzibar wrote x{i} from jo@site.org about thing{'abcdefghij'[i % 10]}") for i in range(6)]
    rows += [(100 + i, "today a thing was wrote about a colour from a number of people " + str(i)) for i in range(200)]
    rows += [(400 + i, f"contact p{i}@else.org today") for i in range(800)]
    got = by_id(pii.find(spark.createDataFrame(rows, "doc_id long, text string")))
    for i in range(6):
        terms = [s for s in got[i][0].spans.split(",") if s.startswith("term:")]
        assert [rows[i][1][int(a) : int(b)] for _, a, b in (t.split(":") for t in terms)] == ["zanzibar"]
    assert not any("term:" in r.spans for i, rs in got.items() if i >= 100 for r in rs)


def _terms(spark, rows):
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = dict(rows)
    return {r.doc_id: [text[r.doc_id][int(a) : int(b)] for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k == "term"] for r in found}


def _about_jo(number):
    return [(i, f"{'abcdefghij'[i]} colour today zanzibar {number} wrote{i} from jo@site.org about thing{i}") for i in range(6)]


def test_terms_of_copied_texts(spark):
    others = [(400 + i, f"contact p{i}@else.org today") for i in range(800)]
    others += [(2000 + i, f"today a colour about from {i} people") for i in range(200)]
    rows = [(10 * c + i, t) for c in range(5) for i, t in _about_jo("then")] + others
    got = _terms(spark, rows)
    assert all(got[10 * c + i] == ["zanzibar", "then"] for c in range(5) for i in range(6))
    assert not any(terms for i, terms in got.items() if i >= 400)


def test_terms_are_spans_in_every_text(spark):
    rows = _about_jo("KD-48213") + [(400 + i, f"contact p{i}@else.org today") for i in range(800)]
    rows += [(2000 + i, f"today a colour about from {i} people") for i in range(200)]
    rows += [(3000, "No address here, but Zanzibar. " + "word " * 50 + "(kd-48213)"), (3001, "jo@site.org " + "filler " * 40 + "zanzibar")]
    got = _terms(spark, rows)
    assert all(got[i] == ["zanzibar", "KD-48213"] for i in range(6))
    assert got[3000] == ["Zanzibar", "kd-48213"] and got[3001] == ["zanzibar"]
    assert not any(terms for i, terms in got.items() if 400 <= i < 3000)
    clean = by_id(pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id", "text"]))
    assert not any(w in r.text.lower() for rs in clean.values() for r in rs for w in ("zanzibar", "kd-48213"))


def test_contexts_end_at_words():
    long = "x" * 200
    text = f"one two {long} three name<a.b@c.de> four, 1.2.3.4 five"
    held = pii.mentions(text, pii.base_spans(text))
    first = {m["t"] for m in held if m["e"] == held[0]["e"]}
    assert first == {pii._hash(t) for t in ("one", "two", long, "three", "name", "four", "five")}


def test_weighted_minhash(spark, docs, empty):
    got = by_id(weighted_minhash.classes(docs))
    assert {r.class_id for r in got[2]} == {1} and got[1][0].kept
    assert got[3][0].class_id == 3 and got[4][0].class_id == 4 and got[None][0].kept
    assert weighted_minhash.classes(empty).count() == 0
    kept = by_id(weighted_minhash.keep_one(docs, ["doc_id", "text", "g"]))
    assert set(kept) == {1, 3, 4, 5, 6, 7, None}


def test_a_large_group_is_one_class(spark):
    import random

    rng = random.Random(4)
    base = [f"w{rng.randint(0, 999)}" for _ in range(200)]
    rows = []
    for i in range(60):
        own = list(base)
        own[rng.randrange(200)] = f"new{i}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, " ".join(f"w{rng.randint(0, 999)}" for _ in range(100))) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (256, 8):  # the small one goes by the central member and blocks
        got = {r.doc_id: r.class_id for r in weighted_minhash.classes(frame, block=block).collect()}
        assert {got[i] for i in range(60)} == {0}
        assert all(got[1000 + i] == 1000 + i for i in range(40))


def _template_rows():
    """A template of 200 words that a third of the rows hold as it is, its near copies with two and three words changed, and other texts."""
    import random

    rng = random.Random(8)
    draw = lambda n: [f"w{rng.randint(0, 4999)}" for _ in range(n)]
    template = draw(200)
    rows = [(i, " ".join(template)) for i in range(300)]
    for i in range(300, 340):
        own = list(template)
        for k, place in enumerate((50, 100) if i % 2 else (40, 90, 150)):
            own[place + rng.randint(0, 9)] = f"new{i}x{k}"
        rows.append((i, " ".join(own)))
    return rows + [(i, " ".join(draw(200))) for i in range(340, 900)]


def test_near_copies_of_a_frequent_template(spark):
    rows = _template_rows()
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    got = {r.doc_id: r.class_id for r in weighted_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, own in sets.items():
        similar = len(own & sets[0]) / len(own | sets[0])
        assert similar > 0.85 or similar < 0.5
        assert (got[i] == 0) == (similar > 0.85)


def test_document_frequencies_count_a_text_once(spark):
    import numpy as np

    rows = _template_rows()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    once = spark.createDataFrame([(0, t) for t in dict.fromkeys(t for _, t in rows)], "doc_id long, text string")
    assert np.array_equal(weighted_minhash.rarity(frame), weighted_minhash.rarity(once))
    weights = weighted_minhash.rarity(frame)
    assert weights.max() <= weighted_minhash.RARE * (1 + 1e-6) and weights.min() >= 1


def test_embeddings(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    rows = [(i, (centre + rng.normal(size=16) * 0.05).tolist()) for i in range(80)]
    rows += [(100 + i, rng.normal(size=16).tolist()) for i in range(100)]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [1.0, None] * 8), (304, []), (305, rows[0][1]), (306, rows[0][1]), (307, [float("inf")] * 16), (308, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("cell", "t", "own", "id", "x", "digest")})
    want = brute.links([r for r in rows if r[0] not in (308,)])
    want[308] = (0, 308)
    for block, held in ((512, 4096), (16, 8)):
        monkeypatch.setattr(lattice, "HELD_ROWS", held)
        got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_duplicates(frame, block=block).collect()}
        assert got == want
    assert lattice.near_duplicates(frame.where("false")).count() == 0


def test_lattice_points_are_nearest():
    import numpy as np

    y = np.random.default_rng(2).normal(size=(300, 8)) * 2
    p = lattice.nearest_point(y)
    around = p[:, None, :] + np.vstack([lattice.roots(), 2 * np.eye(8), -2 * np.eye(8)])[None]
    assert (((y - p) ** 2).sum(axis=1)[:, None] <= ((y[:, None, :] - around) ** 2).sum(axis=2) + 1e-9).all()


def test_recall_near_the_threshold():
    import numpy as np

    rng = np.random.default_rng(3)
    a = lattice.units(rng.normal(size=(4000, 64)).tolist())
    other = rng.normal(size=a.shape)
    other -= (other * a).sum(axis=1, keepdims=True) * a
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * other
    for more in ({}, {"points": 3, "tables": 40, "scale": 0.6}):
        (own_a, near_a), (own_b, near_b) = lattice.cells(a, **more), lattice.cells(b, **more)
        met = (own_a == own_b) | (near_a == own_b[:, :, None]).any(axis=2) | (near_b == own_a[:, :, None]).any(axis=2)
        assert met.any(axis=1).mean() > 0.998


def test_unrelated_vectors_seldom_meet():
    import numpy as np

    for rows in (2000, 8000, 32000):
        own, near = lattice.cells(lattice.units(np.random.default_rng(rows).normal(size=(rows, 64)).tolist()))
        met = 0
        for t in range(own.shape[1]):
            keys, sizes = np.unique(own[:, t], return_counts=True)
            met += int((sizes * (sizes - 1) // 2).sum())
            at = np.minimum(np.searchsorted(keys, near[:, t].ravel()), len(keys) - 1)
            met += int(sizes[at][keys[at] == near[:, t].ravel()].sum())
        assert met / rows < 1.5  # candidates per vector; 31 at 32,000 rows with one point of eight projections


def test_a_step_less_is_nearer():
    """The probed cells are the ones with the least added distance among all single steps and pairs of steps."""
    import numpy as np

    x = lattice.units(np.random.default_rng(4).normal(size=(50, 24)).tolist())
    own, near = lattice.cells(x, tables=1, probes=5)
    blocks = lattice.projections(24, 1, 2, 5)[0]
    moves = np.vstack([np.zeros(8), lattice.roots()])
    for i, row in enumerate(x):
        y = [(r @ row) * lattice.SCALE for r in blocks]
        reached = [lattice.nearest_point(v[None])[0] + moves for v in y]
        far = [((v - p) ** 2).sum(axis=1) for v, p in zip(y, reached, strict=True)]
        first = np.argsort((far[0][:, None] + far[1][None, :]).ravel())[:6]
        keys = [int(lattice._key(np.concatenate([reached[0][f // 241], reached[1][f % 241]])[None], 0, 24)[0]) for f in first]
        assert keys[0] == own[i, 0] and set(keys[1:]) == set(near[i, 0].tolist())


def test_transcripts(spark):
    rows = [(1, 0, "user", "Hello?"), (1, 1, "assistant", "Good day.\n\nWhat now?"), (1, 2, None, "Nothing"), (2, 0, "user", None), (2, None, "system", ""), (None, 0, "user", "x"), (None, 0, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({k: F.lit(1) for k in ("c", "t", "piece", "lines", "m")})
    lines = chat.conversation_lines(frame, style=F.lit(0))
    model = chat.fit(lines)
    got = chat.recover(lines, model).orderBy("conv_id", "turn").collect()
    first = [(r.role, r.text) for r in got if r.conv_id == 1][:2]
    assert first == [("user", "Hello?"), ("assistant", "Good day.\n\nWhat now?")]
    assert sum(r.n_lines for r in got) == 9
    assert chat.recover(lines.where("false"), model).count() == 0
    blank = chat.fit(lines.where("false"))
    assert chat.recover(lines, blank).count() >= 1
    plain = chat.transcript_lines(spark.createDataFrame([(9, "User: hi\nAssistant: hello\nthere"), (8, None)], "conv_id long, text string"))
    assert [(r.role, r.text) for r in chat.recover(plain, model).where("conv_id = 9").orderBy("turn").collect()] == [("user", "hi"), ("assistant", "hello\nthere")]


def test_transcripts_in_pieces(spark, monkeypatch):
    frame = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").where("conv_id < 60")
    frame = frame.unionByName(spark.range(700).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("line one\nline two "), "id").alias("text")), allowMissingColumns=True)
    lines = chat.conversation_lines(frame)
    model = chat.fit(lines)
    key = lambda f: sorted((r.conv_id, r.turn, r.role, r.text) for r in f.collect())
    whole = key(chat.recover(lines.drop("role"), model))
    monkeypatch.setattr(chat, "PIECE_TURNS", 4)
    monkeypatch.setattr(chat, "FAN", 4)
    assert key(chat.recover(chat.conversation_lines(frame).drop("role"), model)) == whole


def test_shingles_of_one_go_take_little_memory():
    import tracemalloc

    from surveyloom.llm import weighted_minhash
    from surveyloom.llm.shingles import shingles

    shingles(["warm up"])
    text = " ".join(f"w{i % 9973}" for i in range(weighted_minhash.CHARACTERS // 6))
    tracemalloc.start()
    shingles([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
