"""Language identification by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary n-gram classifier tells the languages with a one from those with a zero: its
weights are log ratios of hashed byte n-gram frequencies, each language counting alike, learned from all training rows in one pass that
merges counts per task before a small shuffle. A text's bit scores are decoded against all codewords by logistic loss; the codeword
with the least loss wins, and a text whose runner-up is close is flagged as ambiguous.

The model's size is languages x buckets, whatever the corpus; only that leaves the executors. Whole texts are read, in training and prediction.

Defined results: a null text or one without a letter is ``und`` with score 0; without any training row every text is ``und``; ties between codewords go to
the language that sorts first; repeated rows count as often as they occur; rows with a null id are predicted and never learned from;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import chunks, crc_bucket, released

UNDETERMINED = "und"
BUCKETS = 1 << 13
LETTER = regex.compile(r"\p{L}")


def buckets_of(text: str) -> np.ndarray:
    """Bucket of every one-, two- and three-byte gram of the lower-cased text, with a space at either end."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)
    b = np.where(b <= 64, np.uint32(32), b)  # digits and ASCII marks tell no language
    two = b[:-1] | b[1:] << np.uint32(8)
    three = two[:-1] | b[2:] << np.uint32(16)
    grams = np.concatenate([two + np.uint32(1 << 24), three])
    return (grams * np.uint32(2654435761)) >> np.uint32(32 - 13)


def code_matrix(n: int, bits: int | None = None) -> np.ndarray:
    """+1/-1 codewords of ``n`` languages: all splits while these are few, else fixed pseudo-random columns with the best distance of a few draws."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        masks = range(1, 1 << (n - 1))
        return np.array([[1 if m >> k & 1 else -1 for m in masks] for k in range(n)], float)
    bits = bits or max(15, int(np.ceil(10 * np.log2(n))))
    rng = np.random.default_rng(7)
    best, score = None, -1
    for _ in range(64):
        draw = rng.permuted(np.where(np.arange(n)[:, None] % 2 == 0, 1.0, -1.0) * np.ones((n, bits)), axis=0)
        apart = (bits - draw @ draw.T) / 2 + np.eye(n) * bits
        if apart.min() > score:
            best, score = draw, apart.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits

    def decode(self, counts: np.ndarray) -> tuple[int, float, float]:
        """Place of the nearest codeword, its probability and its lead over the next, for one text's bucket counts."""
        n = counts.sum()
        margins = counts @ self.weights / np.sqrt(n)
        loss = np.logaddexp(0, -self.code * np.clip(margins, -30, 30)).sum(axis=1)
        p = np.exp(loss.min() - loss)
        p /= p.sum()
        order = np.argsort(-p, kind="stable")
        lead = p[order[0]] - (p[order[1]] if len(p) > 1 else 0.0)
        return int(order[0]), float(p[order[0]]), float(lead)


def fit(training: DataFrame) -> Model:
    """Learn from the (text, lang) rows with a language; all of them, in one pass."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for text, lang in chunks(batches, ["text", "lang"]):
            for t, name in zip(text, lang, strict=True):
                if t and LETTER.search(t):
                    own = found.setdefault(name, np.zeros(BUCKETS, np.int64))
                    own += np.bincount(buckets_of(t), minlength=BUCKETS)
        for name, own in found.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(used), "bucket": used, "n": own[used]})

    rows = training.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = rows.mapInArrow(released(count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # at most one row per language, however many buckets it fills
    per_language = counts.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")).collect()
    per_language = sorted(per_language, key=lambda r: r["lang"])
    languages = [r["lang"] for r in per_language]
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((BUCKETS, 1)))
    p = np.zeros((len(languages), BUCKETS))
    for k, r in enumerate(per_language):
        p[k, r["b"]] = r["n"]
    p = (p + 0.5) / (p.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    code = code_matrix(len(languages))
    ones, zeros = code > 0, code < 0
    mean = lambda part: np.log((part.T @ p) / np.maximum(1, part.sum(axis=0))[:, None] + 1e-300)
    weights = (mean(ones) - mean(zeros)).T if len(languages) > 1 else np.ones((BUCKETS, 1))
    return Model(languages, code, np.ascontiguousarray(weights))


def predict(docs: DataFrame, model: Model, keep: list[str], ambiguous_below: float = 0.5) -> DataFrame:
    """``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` beside the columns to keep; ``text`` may be one of them."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # languages x buckets: bounded
    names = list(dict.fromkeys([*keep, "text"]))
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for columns in chunks(batches, names):
            held = dict(zip(names, columns, strict=True))
            out = []
            for t in held["text"]:
                if not own.languages or not t or not LETTER.search(t):
                    out.append((UNDETERMINED, 0.0, True))
                else:
                    k, p, lead = own.decode(np.bincount(buckets_of(t), minlength=BUCKETS))
                    out.append((own.languages[k], p, lead < ambiguous_below))
            pred, score, flag = zip(*out, strict=True)
            yield pa.RecordBatch.from_pydict({c: held[c] for c in keep} | {"lang_pred": pred, "score": score, "ambiguous": flag})

    return docs.select(*names).mapInArrow(released(run), f"{kinds}, lang_pred string, score double, ambiguous boolean")


def held_out(id_column: Column) -> Column:
    """Rows the model does not learn from: a third, by the checksum of the id's text."""
    return F.coalesce(crc_bucket(id_column, 3) == 1, F.lit(True))
