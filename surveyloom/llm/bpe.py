"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct words of a batch of documents lie behind each other in flat arrays. An inverted index from token pair to word positions is
kept; merges are applied in rank order, each to all its positions at once, and only the two neighbours of a merged pair are looked up
again. A document's ids are its words' ids put together, so a word is merged once however often it occurs.

Defined results: a null or empty text has no tokens; a repeated row is encoded again and alike; other columns are not read. Very long
words cost in proportion to their length. A null id stays null.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from surveyloom.llm.common import chunks, id_and_text, released

#: Distinct words after which a task starts a new word index, so that its memory stays bounded.
WORDS_HELD = 100_000
NO_PAIR = np.int32(2**31 - 1)


class Vocabulary:
    """Ranks of a byte-level vocabulary and, for every token, each way to put it together from two others."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, merged = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.merged = np.array(merged, np.int32)[order]
        size = max(ranks.values()) + 1
        token_of = [b""] * size
        for token, rank in ranks.items():
            token_of[rank] = token
        self.token_of = token_of

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.merged[at], NO_PAIR)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def replay(words: Sequence[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after the other, and where each word's ids begin (one more entry closes the last)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    n = int(lengths.sum())
    if not n:
        return np.empty(0, np.int32), np.zeros(len(words) + 1, np.int64)
    symbol = vocab.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    following = np.arange(1, n + 1, dtype=np.int32)
    following[np.cumsum(lengths)[lengths > 0] - 1] = -1
    preceding = np.arange(-1, n - 1, dtype=np.int32)
    preceding[(np.cumsum(lengths) - lengths)[lengths > 0]] = -1
    alive = np.ones(n, bool)
    pair = np.full(n, NO_PAIR, np.int32)
    merged_now = np.zeros(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def enter(places: np.ndarray) -> None:
        """Look the pairs that begin at these places up, and index them by rank."""
        found = vocab.rank(symbol[places], symbol[following[places]])
        pair[places] = found
        known = found != NO_PAIR
        places, found = places[known], found[known]
        if not len(places):
            return
        order = np.argsort(found, kind="stable")
        places, found = places[order], found[order]
        starts = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
        for rank, own in zip(found[starts].tolist(), np.split(places, starts[1:]), strict=True):
            if rank in index:
                index[rank].append(own)
            else:
                index[rank] = [own]
                heapq.heappush(waiting, rank)

    enter(np.flatnonzero(following >= 0).astype(np.int32))
    while waiting:
        rank = heapq.heappop(waiting)
        lists = index.pop(rank)
        at = np.sort(lists[0] if len(lists) == 1 else np.concatenate(lists))
        at = at[alive[at] & (pair[at] == rank)]
        at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
        if len(at) > 1:
            run = np.r_[False, following[at[:-1]] == at[1:]]
            if run.any():  # overlapping occurrences of a doubled token: every second one, from the left
                first = np.maximum.accumulate(np.where(run, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
        if not len(at):
            continue
        gone = following[at]
        after = following[gone]
        symbol[at] = rank
        alive[gone] = False
        pair[gone] = NO_PAIR
        pair[at] = NO_PAIR
        following[at] = after
        has_after = after >= 0
        preceding[after[has_after]] = at[has_after]
        before = preceding[at]
        merged_now[at] = True
        before = before[(before >= 0) & ~merged_now[before]]
        merged_now[at] = False
        touched = np.concatenate([at[has_after], before])
        if len(touched):
            enter(touched)
    owner = np.repeat(np.arange(len(words)), lengths)[alive]
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=len(words)), out=starts[1:])
    return symbol[alive].astype(np.int32), starts


class _Index(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Encoder:
    """Encodes lists of texts; keeps the ids of words it has met, up to a bound."""

    def __init__(self, path: str, pattern: str):
        self.vocab = vocabulary(path)
        self.split = regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.index = _Index()
        self.ids, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        if len(self.index) > WORDS_HELD:
            self._forget()
        known = len(self.index)
        numbers = []
        for text in texts:
            words = self.split(text) if text else ()
            numbers.append(np.fromiter(map(self.index.__getitem__, words), np.int32, len(words)))
        if len(self.index) > known:
            fresh = [w.encode("utf-8", "surrogatepass") for w in list(self.index)[known:]]
            ids, starts = replay(fresh, self.vocab)
            self.starts = np.concatenate([self.starts, starts[1:] + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
        lengths = np.diff(self.starts)
        out = []
        for own in numbers:
            n = lengths[own]
            shift = self.starts[own] - (np.cumsum(n) - n)
            out.append(self.ids[np.repeat(shift, n) + np.arange(int(n.sum()))])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocab.token_of.__getitem__, ids.tolist()))


def encode_decode(docs: DataFrame, path: str, pattern: str, outputs: Sequence[str] = ("digests",), keep: Sequence[str] = ()) -> DataFrame:
    """Encode every text and decode the ids again.

    ``outputs``: ``ids`` (array of int), ``decoded`` (string) and ``digests`` (``ids_sha256`` of the ids as little-endian 32-bit numbers,
    ``decoded_sha256`` of the decoded bytes). ``keep`` names further columns to carry along. One pass over the texts, no shuffle.
    """
    kind = {"doc_id": docs.schema["doc_id"].dataType.simpleString()}
    fields = [f"doc_id {kind['doc_id']}", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_tokens long"]
    wanted = {"ids": ["ids array<int>"], "decoded": ["decoded string"], "digests": ["ids_sha256 string", "decoded_sha256 string"]}
    fields += [f for name in ("ids", "decoded", "digests") if name in outputs for f in wanted[name]]
    frame = docs.select("doc_id", "text", *keep) if keep else id_and_text(docs)
    carried = ["doc_id", *keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        columns = ["text", *carried]
        for text, *rest in chunks(batches, columns, limit=2 << 20):
            found = encoder.encode(text)
            out: dict[str, list] = dict(zip(carried, rest, strict=True))
            out["n_tokens"] = [len(ids) for ids in found]
            if "ids" in outputs:
                out["ids"] = found
            if "decoded" in outputs or "digests" in outputs:
                decoded = [encoder.decode(ids) for ids in found]
            if "decoded" in outputs:
                out["decoded"] = [d.decode("utf-8", "replace") for d in decoded]
            if "digests" in outputs:
                out["ids_sha256"] = [hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest() for ids in found]
                out["decoded_sha256"] = [hashlib.sha256(d).hexdigest() for d in decoded]
            yield pa.RecordBatch.from_pydict(out)

    return frame.mapInArrow(released(run), ", ".join(fields))
