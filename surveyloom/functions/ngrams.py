"""Word tokens, word n-grams and word-bounded character n-grams as array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from surveyloom.functions.text import NOT_BLANK

# A token runs from the first to the last word character of a stretch without blanks.
WORD_CHAR = r"[\p{L}\p{N}_]"
TOKEN = rf"{WORD_CHAR}(?:[{NOT_BLANK}]*{WORD_CHAR})?"


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), 0)


def word_ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All n-grams of an array of tokens for n in [low, high], in one array. Pass a stored column, not an expression."""
    grams, parts = tokens, [tokens] if low == 1 else []
    for n in range(2, high + 1):
        count = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
        following = F.slice(tokens, F.lit(n), count)
        grams = F.zip_with(F.slice(grams, F.lit(1), count), following, lambda a, b: F.concat(a, F.lit(" "), b))
        if n >= low:
            parts.append(grams)
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def blank_separated(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"[{NOT_BLANK}]+"), 0)


def padded(word: Column) -> Column:
    return F.concat(F.lit(" "), word, F.lit(" "))


def padded_char_ngrams(padded_word: Column, low: int = 2, high: int = 5) -> Column:
    """Character n-grams inside one padded word; a short word is not repeated for longer n."""
    size = F.length(padded_word)
    return F.flatten(
        F.transform(
            F.sequence(F.lit(low), F.least(F.lit(high), size)),
            lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(padded_word, i, n)),
        )
    )
