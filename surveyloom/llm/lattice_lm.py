"""Language-model scores from a lattice of subwords.

A text is a sequence of words, each the mark of a word's start and its characters, and an end. Every segmentation of a word into pieces of an
existing vocabulary counts: the forward recursion sums their probabilities in log space, so a text's score is its marginal probability.
Piece probabilities are relative frequencies in the training texts, as the vocabulary's own tokenizer cuts them; characters without a piece fall back
to byte pieces. Each word of the training texts is one more edge from its start to its end, with its relative frequency there, so what scoring
knows grows with the corpus. The edge and the pieces share the probability: the pieces get the share of training tokens that occur once
(Good and Turing's estimate of new words), and the forward sum stays that of one distribution.

Spark counts words first: each task merges its words before the shuffle, so a frequent word is one row per task. Texts are dealt into blocks by a hash of their id; a block asks only
for the counts of its distinct words, by 64-bit hashes, and runs the recursion once for each of them, so no (document, word) row is ever
shuffled and no word table is broadcast.

Defined results: a null or empty text is the end alone; repeated rows count as often as they occur; a null id is held out; with no training text
every piece is equally likely, there are no word edges, and the base score is over an empty count table; a very long word is one row; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import chunks, crc_bucket, id_and_text
from surveyloom.session import settle

START = "▁"
#: Characters of text in a block.
BLOCK_CHARS = 10 << 20
#: Distinct words a task gathers before it passes them on.
WORDS_HELD = 500_000


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def name_of(word: bytes) -> int:
    """Spark's ``xxhash64`` of the word: what blocks ask by."""
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


def held_out(id_column: Column) -> Column:
    return F.coalesce(crc_bucket(id_column, 7) == 2, F.lit(True))


class Pieces:
    """The vocabulary as a trie in flat arrays; node 0 is the root."""

    def __init__(self, path: str):
        import sentencepiece

        self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
        t = self.tokenizer
        self.size = t.get_piece_size()
        self.byte_ids = np.zeros(256, np.int64)
        edges: dict[tuple[int, int], int] = {}
        piece_at: dict[int, int] = {}
        n = 1
        for i in range(self.size):
            if t.is_control(i) or t.is_unknown(i) or t.is_unused(i):
                continue
            piece = t.id_to_piece(i)
            if t.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                continue
            node = 0
            for c in map(ord, piece):
                following = edges.get((node, c))
                if following is None:
                    edges[node, c] = following = n
                    n += 1
                node = following
            piece_at[node] = i
        keys = np.array([a << 21 | c for a, c in edges], np.uint64)
        self.bits = 20
        while 1 << self.bits < 4 * len(keys):
            self.bits += 1
        self.slot_key = np.full(1 << self.bits, -1, np.int64).view(np.uint64)
        self.slot_node = np.zeros(1 << self.bits, np.int32)
        self.reach = 1
        at = self._slot(keys).astype(np.int64)
        for key, node, slot in zip(keys, edges.values(), at, strict=True):
            steps = 1
            while self.slot_node[slot]:
                slot = (slot + 1) & ((1 << self.bits) - 1)
                steps += 1
            self.slot_key[slot], self.slot_node[slot] = key, node
            self.reach = max(self.reach, steps)
        self.piece_of = np.full(n, -1, np.int64)
        self.piece_of[list(piece_at)] = list(piece_at.values())

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The child of each node by a character; 0 where there is none."""
        keys = nodes.astype(np.uint64) << np.uint64(21) | chars.astype(np.uint64)
        slot = self._slot(keys).astype(np.int64)
        found = np.where(self.slot_key[slot] == keys, self.slot_node[slot], 0)
        open_ = np.flatnonzero((found == 0) & (self.slot_node[slot] != 0))
        for k in range(1, self.reach):
            if not len(open_):
                break
            at = (slot[open_] + k) & ((1 << self.bits) - 1)
            hit = self.slot_key[at] == keys[open_]
            found[open_[hit]] = self.slot_node[at[hit]]
            open_ = open_[~hit & (self.slot_node[at] != 0)]
        return found


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def forward(words: list[str], vocabulary: Pieces, log_p: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability, over all its segmentations; ``log_p`` by piece."""
    out = np.zeros(len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    node_p = np.where(vocabulary.piece_of >= 0, log_p[vocabulary.piece_of], -np.inf)
    order = np.argsort(lengths, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        n = int(lengths[own[0]]) if len(own) else 0
        if not n:
            continue
        chars = np.frombuffer("".join([words[k] for k in own.tolist()]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(own), n)
        alpha = np.full((n + 1, len(own)), -np.inf)
        alpha[0] = 0
        for i in range(n):
            active, node, before = np.arange(len(own)), np.zeros(len(own), np.int32), alpha[i]
            for j in range(i, n):
                node = vocabulary.step(node, chars[active, j])
                if j == i:
                    _bytes_of(chars[:, i], np.flatnonzero(~np.isfinite(node_p[node])), alpha, i, vocabulary, log_p)
                alive = node > 0
                active, node = active[alive], node[alive]
                if not len(active):
                    break
                p = node_p[node]
                ends = np.isfinite(p)
                at = active[ends]
                alpha[j + 1, at] = np.logaddexp(alpha[j + 1, at], before[at] + p[ends])
        out[own] = alpha[n]
    return out


def _bytes_of(chars: np.ndarray, rows: np.ndarray, alpha: np.ndarray, i: int, vocabulary: Pieces, log_p: np.ndarray) -> None:
    """Characters without a piece of their own are their bytes' pieces."""
    if not len(rows):
        return
    codes, back = np.unique(chars[rows], return_inverse=True)
    p = np.array([log_p[vocabulary.byte_ids[list(chr(c).encode("utf-8", "replace"))]].sum() for c in codes.tolist()])
    alpha[i + 1, rows] = np.logaddexp(alpha[i + 1, rows], alpha[i, rows] + p[back])


def with_edges(pieces_log: np.ndarray, count: np.ndarray, n_train: int, escape: float) -> np.ndarray:
    """Natural log of each word's probability: its own edge by its training count, and the sum over its segmentations."""
    with np.errstate(divide="ignore"):
        edge = np.log(count) + np.log1p(-escape) - np.log(max(n_train, 1))
    return np.logaddexp(edge, pieces_log + np.log(escape))


def score(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10), one row per document."""
    docs = id_and_text(docs).withColumn("held_out", held_out(F.col("doc_id")))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.binary()), "n": list(found.values())})
            found.clear()

        found: Counter = Counter()
        for text, out in chunks(batches, ["text", "held_out"]):
            for t, skip in zip(text, out, strict=True):
                if skip:
                    for word in words_of(t):
                        found[word] += 0
                else:
                    found.update(words_of(t))
            if len(found) > WORDS_HELD:
                yield from rows()
        if found:
            yield from rows()

    words = docs.select("text", "held_out").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))
    words = settle(words, "words")
    size = docs.agg(F.sum(F.length("text")).alias("chars"), F.count_if(~F.col("held_out")).alias("ends")).first()
    known = words.where("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("c") == 1)).first()
    ends = size["ends"]
    n_train, v_train = known[0] + ends, known[1] + (ends > 0)
    escape = (known[2] + (ends == 1) + 1) / (n_train + 1)

    def count_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(vocabulary_path)
        total = np.zeros(own.size, np.int64)
        for batch in batches:
            held = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
            c = batch.column("c").to_numpy(zero_copy_only=False)
            ids = own.tokenizer.encode(held, num_threads=1)
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int64, int(n.sum()))
            total += np.bincount(flat, np.repeat(c, n), own.size).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": used, "n": total[used]})

    counted = words.where("c > 0").mapInArrow(count_pieces, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    counted = counted.collect()  # as many rows as the vocabulary has pieces
    own = pieces(vocabulary_path)
    c = np.full(own.size + 1, 0.5)
    for row in counted:
        c[row["piece"]] += row["n"]
    c[own.size] += ends
    log_p = np.log(c / c.sum())
    log_end = float(with_edges(log_p[own.size :], np.array([ends]), n_train, escape)[0])
    shipped = docs.sparkSession.sparkContext.broadcast(log_p)  # one number per piece

    blocks = max(1, math.ceil((size["chars"] or 0) / BLOCK_CHARS))
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")).repartition("block")

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[pa.RecordBatch]:
            for block, found in wanted.items():
                yield pa.RecordBatch.from_pydict({"block": pa.array([block] * len(found), pa.int32()), "h": pa.array(map(name_of, found), pa.int64())})
            wanted.clear()

        wanted: dict[int, set] = {}
        for text, block in chunks(batches, ["text", "block"]):
            for t, k in zip(text, block, strict=True):
                wanted.setdefault(k, set()).update(words_of(t))
            if sum(map(len, wanted.values())) > WORDS_HELD:
                yield from rows()
        yield from rows()

    # reads the very columns the texts' own exchange has, so that exchange is made once
    counts_of = words.where("c > 0").select(F.xxhash64("word").alias("h"), "c")
    answers = dealt.mapInArrow(ask, "block int, h long").join(counts_of, "h").select("block", "h", "c")
    log10 = math.log(10)

    def add_up(texts: pa.Table, found: pa.Table) -> pa.Table:
        count_of = dict(zip(found["h"].to_pylist(), found["c"].to_pylist(), strict=True))
        held = [words_of(t) for t in texts["text"].to_pylist()]
        own = list({w for ws in held for w in ws})
        c = np.array([count_of.get(name_of(w), 0) for w in own], np.int64)
        p = forward([START + w.decode("utf-8", "replace") for w in own], pieces(vocabulary_path), shipped.value)
        p = with_edges(p, c, n_train, escape)
        base = np.log10((c + 1) / (n_train + v_train + 1))
        per_word = dict(zip(own, zip(base.tolist(), p.tolist(), (c > 0).tolist(), strict=True), strict=True))
        end = (math.log10((ends + 1) / (n_train + v_train + 1)), log_end, ends > 0)
        out: dict[str, list] = {"doc_id": texts["doc_id"].to_pylist(), "held_out": texts["held_out"].to_pylist()}
        out |= {"n_tokens": [], "n_known": [], "train_tokens": [n_train] * len(held), "base_score": [], "score": []}
        for ws in held:
            base, p, seen = zip(*[per_word[w] for w in ws], end, strict=True)
            out["n_tokens"].append(len(p))
            out["n_known"].append(sum(seen))
            out["base_score"].append(math.fsum(base))
            out["score"].append(math.fsum(p) / log10)
        return pa.Table.from_pydict(out)

    fields = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, fields)
