"""Terms counted inside their rows: against plain counting, in many pieces, without a shuffle, and with keys that repeat or are missing."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from surveyloom.functions import cells
from surveyloom.operators import features

TEXTS = ["a b a", "", "\U0001f600x  x ý a", "b", "word " * 40 + "end", "a b a"]


def char_counts(text, low, high):
    padded = [f" {w} " for w in text.split()]
    return Counter(p[i : i + n] for p in padded for n in range(low, high + 1) for i in range(len(p) - n + 1))


def word_counts(words, low, high):
    return Counter(" ".join(words[i : i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1))


@pytest.mark.parametrize("piece", [1, 3, 50_000])
def test_cells_are_plain_counts(monkeypatch, piece):
    monkeypatch.setattr(cells, "PIECE", piece)
    words = [t.split() for t in TEXTS]
    for family, batch, want in (
        ("char_ngram", pa.array(TEXTS), [char_counts(t, 2, 5) for t in TEXTS]),
        ("tfidf", pa.array(words, pa.list_(pa.string())), [word_counts(w, 1, 3) for w in words]),
    ):
        got, ends = [Counter() for _ in TEXTS], 0
        for first, end, terms, row, term, tf in cells.cells(batch, family, *((2, 5) if family == "char_ngram" else (1, 3))):
            assert first == ends and (np.diff(row) >= 0).all()
            ends = end
            for r, t, n in zip(row, term, tf, strict=True):
                assert terms[int(t)].as_py() not in got[first + r]
                got[first + r][terms[int(t)].as_py()] = int(n)
        assert ends == len(TEXTS) and got == want


def test_own_keys_shuffle_no_terms(spark, tmp_path):
    path = str(tmp_path / "texts")
    spark.createDataFrame(list(enumerate(TEXTS)), "k bigint, t string").write.parquet(path)
    docs = spark.read.parquet(path)
    vocab = features.with_idf(features.vocabulary(features.word_terms(docs, "k", "t"), "k", 100), docs)
    for found in (features.char_terms(docs, "k", "t"), features.word_terms(docs, "k", "t"), features.tfidf_bags(docs, "k", "t", "tfidf", vocab, 100), features.sparse_texts(docs, "k", "t", "tfidf", vocab, 100)):
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r["k"], r["term"]): r["tf"] for r in features.char_terms(docs, "k", "t").collect()}
    assert got == {(k, g): n for k, t in enumerate(TEXTS) for g, n in char_counts(t, 2, 5).items()}


def test_shared_and_missing_keys_are_merged(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "b b"), (2, "c"), (None, "a"), (None, "a"), (3, None)], "k bigint, t string")
    got = {(r["k"], r["term"]): r["tf"] for r in features.word_terms(docs, "k", "t", 1, 1).collect()}
    assert got == {(1, "a"): 1, (1, "b"): 3, (2, "c"): 1, (None, "a"): 2}
    vocab = features.with_idf(features.vocabulary(features.word_terms(docs, "k", "t"), "k", 100), docs)
    want = {(r["k"], r["term"]): r["weight"] for r in features.tfidf(features.word_terms(docs, "k", "t"), vocab, "k", 100).collect()}
    bags = features.tfidf_bags(docs, "k", "t", "tfidf", vocab, 100).collect()
    found = {(r["k"], e["term"]): e["weight"] for r in bags for e in r["entries"]}
    assert set(found) == set(want) and all(np.isclose(found[c], want[c]) for c in want)
    rows = features.sparse_texts(docs, "k", "t", "tfidf", vocab, 100).collect()
    plain = features.sparse_rows(features.tfidf(features.word_terms(docs, "k", "t"), vocab, "k", 100), docs, "k").collect()
    assert sorted(str((r["k"], r["indices"])) for r in rows) == sorted(str((r["k"], r["indices"])) for r in plain)


def test_grams_of_words_are_numbered_together():
    words = ["ab", "b", "\U0001f600b", "abab"]
    for low, high in ((1, 3), (2, 5), (4, 4)):
        terms, places, count = cells._grams(words, low, high)
        assert len(set(terms.to_pylist())) == len(terms) and count.sum() == len(places)
        for word, own in zip(words, np.split(places, np.cumsum(count)[:-1]), strict=True):
            assert Counter(terms.take(pa.array(own)).to_pylist()) == char_counts(word, low, high)
    assert [len(x) for x in cells._grams([], 2, 5)] == [0, 0, 0]


def test_tokens_of_texts_are_those_of_the_expression(spark):
    from pyspark.sql import functions as F

    from surveyloom.functions.ngrams import word_tokens

    odd = ["", None, "--A-b-- 'c'   (d)...e ... _x_ \U0001d7d8\U0001f600", "İ ² ࡰࡱ \U000323af กิ Straße\u001fx"]
    docs = spark.createDataFrame(list(enumerate([*TEXTS, *odd])), "k bigint, t string")
    want = Counter()
    for r in docs.select(word_tokens(F.coalesce("t", F.lit(""))).alias("words")).collect():
        want += word_counts(r["words"], 1, 2)
    from surveyloom.operators.scoring import counted_terms

    found = counted_terms(docs, "t", "tfidf")
    assert {r["term"]: r["total"] for r in found.collect()} == dict(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan  # a token is cut out of each distinct word, not out of every text
