"""Term counts of whole batches of texts: (row, term, count) cells as flat arrays, made inside a task.

Words are numbered once per batch, so a word is cut into its character n-grams, or to its token, once however often it occurs, and cells are merged by sorting
numbers in pieces of bounded size. Lower-casing is a built-in expression; ``str.split`` parts a text at the same characters as ``BLANK`` of ``text``. Which
characters words consist of is asked of the JVM's ``WORD_CHAR``, whose Unicode version may differ from Python's, so tokens are those of ``ngrams.word_tokens``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from surveyloom.functions.ngrams import WORD_CHAR

#: Words of consecutive rows whose cells are sorted at once; a longer text is a piece of its own.
PIECE = 50_000
#: Shortest and longest n-grams of the two families.
LENGTHS = {"tfidf": (1, 2), "char_ngram": (2, 5)}


def source(text: Column) -> Column:
    """What :func:`cells` reads: the lower-case form of a text."""
    return F.lower(F.coalesce(text, F.lit("")))


@lru_cache(maxsize=1)
def _letters(spark: SparkSession) -> str:
    """All characters a word may begin and end with."""
    points = spark.range(0x110000).where((F.col("id") < 0xD800) | (F.col("id") >= 0xE000))
    character = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    return "".join(map(chr, points.where(character.rlike(f"^{WORD_CHAR}$")).toArrow()["id"].to_pylist()))


def letters(spark: SparkSession, family: str) -> Broadcast | None:
    """What :func:`cells` needs to know of characters, shared with all tasks; nothing for character n-grams."""
    return spark.sparkContext.broadcast(_letters(spark)) if family == "tfidf" else None


def cells(
    batch: pa.Array, family: str, low: int, high: int, letters: Broadcast | None = None
) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces (first row, end row, distinct terms, row from the first, place of the term, count), ordered by row and place.

    Word n-grams come from texts with the ``letters`` of the session, or from lists of tokens.
    """
    if family != "tfidf":
        return _char_cells(batch, low, high)
    return _word_cells(*(_listed(batch) if pa.types.is_list(batch.type) else _tokens(batch, letters.value)), low, high)


def _pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of at most ``PIECE`` words, or of one row."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = ends[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(ends, before + PIECE, side="right")))
        yield first, end
        first = end


def _merged(cell: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells in order, and the sum of the counts of each."""
    if not len(cell):
        return cell, n
    bits = int(n.max()).bit_length()
    if int(cell.max()).bit_length() + bits < 63:
        both = np.sort((cell << bits) | n)  # plain numbers sort far faster than places do
        cell, n = both >> bits, both & ((1 << bits) - 1)
    else:
        order = np.argsort(cell, kind="stable")
        cell, n = cell[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    return cell[first], np.add.reduceat(n, first)


class _Numbers(dict):
    """Words and their numbers, in the order they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


def _grams(words: list[str], low: int, high: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct n-grams of the padded words, the places of each word's n-grams there, and how many each word has.

    An n-gram is the number of the (n - 1)-gram it starts with and a letter, so those of all words are numbered by sorting plain numbers.
    """
    text = "".join([f" {w} " for w in words])
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    begin = np.cumsum(size) - size
    word, at = np.repeat(np.arange(len(words)), size), np.arange(len(text))
    left = (begin + size)[word] - at  # letters from each place to the end of its word
    letters, first, code = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_index=True, return_inverse=True)
    count = sum(np.maximum(size - n + 1, 0) for n in range(low, high + 1))
    free = np.cumsum(count) - count - begin
    places, terms, gram = np.empty(int(count.sum()), np.int32), [], code
    for n in range(1, high + 1):
        if n > 1:
            keep = left[at] >= n
            at, gram = at[keep], gram[keep]
            _, first, gram = np.unique(gram * len(letters) + code[at + n - 1], return_index=True, return_inverse=True)
            first = at[first]
        if n >= low:
            places[free[word[at]] + at] = gram + len(terms)
            terms += [text[i : i + n] for i in first.tolist()]
            free += np.maximum(size - n + 1, 0)
    return pa.array(terms, pa.string()), places, count


def _char_cells(texts: pa.Array, low: int, high: int):
    known = _Numbers()
    sizes, words = np.zeros(len(texts), np.int64), []
    for i, text in enumerate(texts.to_pylist()):
        found = (text or "").split()
        sizes[i] = len(found)
        words.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
    terms, flat, count = _grams(list(known), low, high)
    start = np.cumsum(count) - count
    wide, known_words = max(1, len(terms)), max(1, len(known))
    for first, end in _pieces(sizes):
        row = np.repeat(np.arange(end - first), sizes[first:end])
        cell, n = np.unique(row * known_words + np.concatenate(words[first:end]), return_counts=True)
        row, word = np.divmod(cell, known_words)
        each = count[word]
        at = np.arange(each.sum()) + np.repeat(start[word] - (np.cumsum(each) - each), each)
        cell, tf = _merged(np.repeat(row, each) * wide + flat[at], np.repeat(n, each))
        yield first, end, terms, *np.divmod(cell, wide), tf


def _listed(tokens: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Tokens per row, distinct tokens, and the number of each token."""
    sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = pc.dictionary_encode(tokens.flatten())
    return sizes, coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _tokens(texts: pa.Array, letters: str) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The same from texts: of each stretch without blanks, what lies from its first to its last letter."""
    known, single, parts, letters = _Numbers(), _Numbers(), [np.zeros(0, np.int64)], frozenset(letters)
    sizes = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts.to_pylist()):
        found = (text or "").split()
        sizes[i] = len(found)
        parts.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
    code = np.full(max(1, len(known)), -1, np.int64)
    for stretch, number in known.items():
        first, end = 0, len(stretch)
        while first < end and stretch[first] not in letters:
            first += 1
        while first < end and stretch[end - 1] not in letters:
            end -= 1
        if first < end:
            code[number] = single[stretch[first:end]]
    flat = code[np.concatenate(parts)]
    row, held = np.repeat(np.arange(len(texts)), sizes), flat >= 0
    return np.bincount(row[held], minlength=len(texts)), pa.array(list(single), pa.string()), flat[held]


def _word_cells(sizes: np.ndarray, single: pa.Array, flat: np.ndarray, low: int, high: int):
    ends = np.cumsum(sizes)
    for first, end in _pieces(sizes):
        word = flat[ends[first] - sizes[first] : ends[end - 1]]
        row = np.repeat(np.arange(end - first), sizes[first:end])
        terms, code, at = single, word, row  # the n-grams that start at each place
        parts, numbers, rows, shift = [], [], [], 0
        for n in range(1, high + 1):
            if n > 1:
                keep = row[n - 1 :] == at[: max(0, len(row) - n + 1)]
                pair = code[: len(keep)] * max(1, len(single)) + word[n - 1 :]
                pair = np.where(keep, pair, -1)  # a place whose n-gram would leave its row
                distinct, code = np.unique(pair, return_inverse=True)
                old, new = np.divmod(np.maximum(distinct, 0), max(1, len(single)))
                terms = pc.binary_join_element_wise(terms.take(pa.array(old)), single.take(pa.array(new)), " ")
                at = np.where(keep, at[: len(keep)], -1)
            if n >= low:
                held = at >= 0
                parts.append(terms)
                numbers.append(code[held] + shift)
                rows.append(at[held])
                shift += len(terms)
        wide = max(1, shift)
        cell, tf = np.unique(np.concatenate(rows) * wide + np.concatenate(numbers), return_counts=True)
        yield first, end, pa.concat_arrays(parts), *np.divmod(cell, wide), tf
