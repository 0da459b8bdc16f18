"""Text cleaning, redaction and length features.

Everything but NFC is a built-in expression; NFC sends only the texts it could change to Python.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from surveyloom.functions.numbers import blank_to_empty, rounded

# The characters and patterns cleaning and redaction are defined by.
QUOTES = "“”‘’«»„‚"
STRAIGHT_QUOTES = "\"\"''\"\"\"'"
DASHES = "‒–—―−"
ELLIPSIS = r"\x{2026}|\.{4,}"
# Blank characters as the unicode standard and the information separators have them.
BLANK = r"\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# All other characters, spelled out: Java's regular expressions match a long negated class several times slower than its complement.
NOT_BLANK = (
    r"\x{21}-\x{84}\x{86}-\x{9f}\x{a1}-\x{167f}\x{1681}-\x{1fff}\x{200b}-\x{2027}\x{202a}-\x{202e}"
    r"\x{2030}-\x{205e}\x{2060}-\x{2fff}\x{3001}-\x{10ffff}\x{0}-\x{8}\x{e}-\x{1b}"
)
INVISIBLE = r"\x{200b}\x{200c}\x{200d}\x{feff}"
REDACTED = "[REDACTED]"
EMAIL = r"(?i)[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}"
PHONE = (
    r"(?U)(?:\+7|8)[\s\-\(]?\d{3}[\s\-\)]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}"
    r"|\b\d{3}[\s\-]\d{2}[\s\-]\d{2}\b"
)
STUDENT_ID = r"(?U)\b(?:[А-ЯA-Z]{1,3}[-\s]?\d{5,8}|[Ii][Dd]\s*[:=]?\s*\d{4,10})\b"
URL = rf"https?://[^{BLANK}]+|www\.[^{BLANK}]+"
REDACTIONS = {"email": EMAIL, "phone": PHONE, "student_id": STUDENT_ID, "url": URL}
PREPROCESS_SPEC_ID = "preprocess_v1"

# Outside the ranges in which no character changes under NFC by itself: Latin without combining marks, Cyrillic, plain punctuation.
_NFC_MAY_CHANGE = r"[\x{300}-\x{3ff}\x{483}-\x{489}\x{530}-\x{200f}\x{2028}-\x{10ffff}]"


@F.pandas_udf(StringType())
def _nfc_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def nfc(c: Column) -> Column:
    """Unicode NFC. Only texts that may change cross into Python; the others travel as null and keep their value."""
    risky = F.when(~is_ascii(c) & c.rlike(_NFC_MAY_CHANGE), c)
    return F.coalesce(_nfc_batch(risky), c)


def straighten_quotes(c: Column) -> Column:
    return F.translate(c, QUOTES, STRAIGHT_QUOTES)


def unify_dashes(c: Column) -> Column:
    return F.translate(c, DASHES, "-" * len(DASHES))


def unify_ellipsis(c: Column) -> Column:
    return F.regexp_replace(c, ELLIPSIS, "...")


def _characters(ranges: str) -> str:
    """The characters of a regular expression class, one by one."""
    return "".join(chr(i) for i in range(0x10000) if re.match(f"[{_python_class(ranges)}]", chr(i)))


def _python_class(ranges: str) -> str:
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", ranges)


_BLANKS = _characters(BLANK)
_INVISIBLES = _characters(INVISIBLE)


def _single_spaced(c: Column, blanks: str) -> Column:
    """One space for every run of blanks, none at the ends. Characters are mapped first; then only " " is searched."""
    return F.trim(F.regexp_replace(F.translate(c, blanks, " " * len(blanks)), " {2,}", " "))


def collapse_blanks(c: Column) -> Column:
    """Runs of blank and invisible characters become one space; ends are trimmed."""
    return _single_spaced(c, _BLANKS + _INVISIBLES)


def normalize_text(c: Column) -> Column:
    """NFC, quotes, dashes, ellipsis, blanks; null becomes the empty string.

    The single characters are disjoint from the ellipsis, so one pass maps them all.
    """
    blanks = _BLANKS + _INVISIBLES
    mapped = F.translate(
        nfc(blank_to_empty(c)), QUOTES + DASHES + blanks, STRAIGHT_QUOTES + "-" * len(DASHES) + " " * len(blanks)
    )
    return F.trim(F.regexp_replace(unify_ellipsis(mapped), " {2,}", " "))


#: What every text with such a match holds. Most texts hold none of it, and looking for it costs a fraction of the search.
_NEEDED = {
    "email": lambda t: t.contains("@"),
    "phone": lambda t: t.rlike(r"(?U)\d{3}"),
    "student_id": lambda t: t.rlike(r"(?U)\d{4}"),
    "url": lambda t: t.contains("http") | t.contains("www."),
}


def _where(c: Column, needed: Callable[[Column], Column], change: Callable[[Column], Column]) -> Column:
    """``change`` of the texts that hold what it needs. The text is bound to a name, so it is made once however often it is looked at."""
    return F.transform(F.array(c.cast("string")), lambda t: F.when(needed(t), change(t)).otherwise(t))[0]


def _search(kind: str) -> str:
    """An address always starts where its run of characters starts, so the search skips the middle of words."""
    return r"(?<![a-zA-Z0-9._%+\-])" + EMAIL if kind == "email" else REDACTIONS[kind]


def redact(c: Column, kinds: list[str] | None = None) -> Column:
    """Replace personal data in the order e-mail, phone, student id, URL."""
    for kind in kinds or list(REDACTIONS):
        c = _where(c, _NEEDED[kind], lambda t, kind=kind: F.regexp_replace(t, _search(kind), REDACTED))
    return c


def redaction_count(c: Column) -> Column:
    """Number of replacements :func:`redact` makes, each kind counted on the text the earlier kinds left."""
    total = F.lit(0)
    for kind in REDACTIONS:
        total = total + F.regexp_count(c, F.lit(_search(kind)))
        c = F.regexp_replace(c, _search(kind), REDACTED)
    return total


def is_blank(c: Column) -> Column:
    """Null, empty or nothing but blank characters."""
    return ~F.coalesce(c.cast("string"), F.lit("")).rlike(f"[^{BLANK}]")


def strip(c: Column) -> Column:
    """Trim every blank character, not only spaces."""
    return F.regexp_replace(c, f"^[{BLANK}]+|[{BLANK}]+$", "")


def _words(single: Column) -> Column:
    return F.length(single) - _letters(single) + (single != "").cast("int")


def _letters(single: Column) -> Column:
    return F.length(F.replace(single, F.lit(" "), F.lit("")))


def word_count(c: Column) -> Column:
    """Stretches without blanks: spaces of the single-spaced text plus one."""
    return _words(_single_spaced(c, _BLANKS))


def sentence_count(c: Column) -> Column:
    """Non-blank stretches between . ! ?, at least one for a non-empty text."""
    stretches = F.regexp_count(c, F.lit(f"[^.!?{BLANK}][^.!?]*"))
    return F.when(c == "", F.lit(0)).otherwise(F.greatest(F.lit(1), stretches))


def mean_word_length(c: Column) -> Column:
    return _mean_length(_single_spaced(c, _BLANKS))


def _mean_length(single: Column) -> Column:
    return F.coalesce(rounded(F.try_divide(_letters(single).cast("double"), _words(single).cast("double")), 2), F.lit(0.0))


def length_features(c: Column, single_spaced: bool = False) -> dict[str, Column]:
    """Character, word and sentence count and mean word length; cheaper for text whose blanks are already collapsed."""
    return {
        "char_count": F.length(c),
        "word_count": _words(c) if single_spaced else word_count(c),
        "sentence_count": sentence_count(c),
        "avg_word_length": _mean_length(c) if single_spaced else mean_word_length(c),
    }


def spread(df: DataFrame) -> DataFrame:
    """Share out a table of few small files before costly text work; larger tables already have a task per core.

    Only file names and lengths are looked at, so nothing runs.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not files or len(files) >= cores:
        return df
    configuration = spark._jsc.hadoopConfiguration()
    size = 0
    for name in files:  # fewer than there are cores
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        size += path.getFileSystem(configuration).getFileStatus(path).getLen()
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if size < cores * split else df


def preprocess(df: DataFrame, text_col: str = "text_feedback") -> DataFrame:
    """Add text_processed, the length features and the id of the cleaning rules to a frame (batch or streaming).

    Cleaning leaves single spaces and redaction puts in none, so word counts are differences of lengths. Store the
    result before filtering by a new column: Spark moves such a filter below the cleaning and cleans twice.
    """
    out = df.withColumn("text_processed", redact(normalize_text(F.col(text_col))))
    features = length_features(F.col("text_processed"), single_spaced=True)
    return out.withColumns({**features, "preprocess_spec_id": F.lit(PREPROCESS_SPEC_ID)})
