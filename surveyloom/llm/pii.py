"""Personal data: patterns, and terms whose co-occurrence with them gives protected entities away.

Base spans are e-mail addresses, IP addresses, card numbers and telephone numbers. The entities they name are protected. For the words around an
entity the corpus tells how strongly they reveal it: with n(e, t) texts that hold term t in a context of entity e, n(t) texts that hold t, and
p(e) the share of e among all contexts, a term discloses e if p(e | t) = n(e, t) / n(t) and the information log2(p(e | t) / p(e)) reach their
thresholds, in at least ``support`` contexts. Equal texts and equal contexts count once. Such a term is a span of its own wherever it occurs, in
any text: generalised to its kind, or removed where it all but names an entity.

Counts cover every text: words are merged per task, contexts and pairs are merged before they are shuffled, and an entity or a word that
a third of all texts hold is an ordinary row in each step. Only filters of a fixed size are broadcast: they tell which words may be terms that matter,
and a text's places of such a term are one row of the join that decides.

Defined results: a null or empty text has no spans and stays as it is; repeated rows get the same spans; a null id is kept; very long texts are
scanned in linear time; an empty table gives an empty result; other columns are kept by ``sanitise`` and not read otherwise.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import chunks, distinct_texts, in_slots, released, slots_of
from surveyloom.session import settle

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: Words on either side of an entity that are its context.
WINDOW = 6
SUPPORT = 3
#: p(e | t) from which a term is generalised, and from which it is removed; and the bits it must tell about the entity.
DISCLOSURE, REMOVAL, BITS = 0.5, 0.9, 6.0
TERMS_HELD = 500_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"\S+")
EDGES = ".,;:!?()[]{}<>\"'|*_-"

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """An at sign with the longest run of name characters before it, not reaching into an earlier match, and a dotted domain after it."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            floor = found.end()
        at = text.find("@", found.end() if found else at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(map(int, reversed(digits))):
        total += d if place % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str | None) -> list[Span]:
    """Spans of the four kinds, by kind and start; offsets are code points."""
    if not text:
        return []
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(map(_small, m[0].split("."))):
                out.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return out


def term_of(word: str) -> str | None:
    """The term of a word between white space: lower case, without marks at its edges; None if it has fewer than three characters."""
    word = word.strip(EDGES).lower()
    return word if len(word) >= 3 else None


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def tokens(text: str, spans: list[Span]) -> list[tuple[int, int, bool]]:
    """Start, end and whether it is a word: entities (overlapping ones as one), and the words between white space and entities."""
    out: list[tuple[int, int, bool]] = []
    done = 0
    for a, b in sorted((a, b) for _, a, b in spans):
        if out and not out[-1][2] and a < done:
            out[-1] = (out[-1][0], max(done, b), False)
        else:
            out += [(*m.span(), True) for m in WORD.finditer(text, done, a)]
            out.append((a, b, False))
        done = max(done, b)
    return out + [(*m.span(), True) for m in WORD.finditer(text, done)]


def mentions(text: str, spans: list[Span], window: int = WINDOW) -> list[dict]:
    """Terms around each entity: entity, term, and the context they share."""
    out = []
    held = tokens(text, spans)
    starts, ends = [x for x, _, _ in held], [y for _, y, _ in held]
    for kind, a, b in spans:
        before, after = bisect_right(ends, a), bisect_left(starts, b)
        left, right = held[max(0, before - window) : before], held[after : after + window]
        entity = _hash(kind + ":" + text[a:b].lower())
        context = _hash("\x00".join(" ".join(text[x:y] for x, y, _ in side) for side in (left, right)))
        terms = {term_of(text[x:y]) for x, y, word in (*left, *right) if word} - {None}
        out += [{"e": entity, "t": t, "c": context} for t in map(_hash, sorted(terms))]
    return out


def _joined(spans: Iterable[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


PLACES = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
MENTIONS = pa.list_(pa.struct([("e", pa.int64()), ("t", pa.int64()), ("c", pa.int64())]))


def _keyed(docs: DataFrame) -> DataFrame:
    """k1, k2: 128 bits of id and text; rows with equal keys have equal spans."""
    return docs.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit("other"), "text", "doc_id")})


def find_base(docs: DataFrame) -> DataFrame:
    """Counts and spans of the base kinds for every row of (doc_id, text), and the mentions around them."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, text, k1, k2 in chunks(batches, ["doc_id", "text", "k1", "k2"]):
            out: dict[str, list] = {"doc_id": ids, "k1": k1, "k2": k2, **{f"n_{k}": [] for k in KINDS}, "d": [], "base": [], "mentions": []}
            for t in text:
                spans = base_spans(t)
                n = Counter(k for k, _, _ in spans)
                for k in KINDS:
                    out[f"n_{k}"].append(n[k])
                out["d"].append(_hash(t) if spans else None)
                out["base"].append(_joined(spans))
                out["mentions"].append(mentions(t, spans) if spans else [])
            arrays = [pa.array(v, {"mentions": MENTIONS, "d": pa.int64()}.get(c)) for c, v in out.items()]
            yield pa.RecordBatch.from_arrays(arrays, names=list(out))

    fields = f"doc_id {kind}, k1 long, k2 long, " + ", ".join(f"n_{k} long" for k in KINDS)
    fields += ", d long, base string, mentions array<struct<e:long,t:long,c:long>>"
    return _keyed(docs.select("doc_id", F.col("text").cast("string").alias("text"))).mapInArrow(released(run), fields)


class Wanted:
    """Hashes of the words whose terms may be in a filter."""

    def __init__(self, slots: np.ndarray):
        self.slots, self.known = slots, {}

    def of(self, words: set[str]) -> dict[str, int]:
        if len(self.known) > TERMS_HELD:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        if new:
            h = [None if t is None else _hash(t) for t in map(term_of, new)]
            may = in_slots(self.slots, np.array([x or 0 for x in h], np.int64))
            self.known.update((w, x if ok else None) for w, x, ok in zip(new, h, may.tolist(), strict=True))
        return {w: h for w in words if (h := self.known[w]) is not None}


def texts_with(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(t, n): the number of distinct texts each term is in, over all texts; for the given terms (t) and some others."""
    slots = docs.sparkSession.sparkContext.broadcast(slots_of(terms, "t"))  # a fixed number of bits

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"t": pa.array(list(found), pa.int64()), "n": pa.array(list(found.values()), pa.int64())})
            found.clear()
            return out

        found: Counter = Counter()
        wanted = Wanted(slots.value)
        for (text,) in chunks(batches, ["text"]):
            for t in text:
                if t:
                    spans = base_spans(t)
                    words = {t[a:b] for a, b, word in tokens(t, spans) if word} if spans else set(t.split())
                    found.update(set(wanted.of(words).values()))
            if len(found) > TERMS_HELD:
                yield rows()
        yield rows()

    return distinct_texts(docs).mapInArrow(released(run), "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))


def disclosing(base: DataFrame, docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE, bits: float = BITS) -> DataFrame:
    """(e, t, p): terms that disclose an entity, and p(e | t)."""
    found = base.where(F.size("mentions") > 0).select("d", F.explode("mentions").alias("m"))
    contexts = settle(found.select("m.e", "m.c", "m.t", "d").distinct(), "contexts")
    per_entity = contexts.select("e", "c").distinct().groupBy("e").agg(F.count(F.lit(1)).alias("n_e"))
    total = contexts.select("e", "c").distinct().count()
    supported = contexts.select("e", "t", "c").distinct().groupBy("e", "t").agg(F.count(F.lit(1)).alias("n_c")).where(F.col("n_c") >= support)
    in_texts = contexts.select("e", "t", "d").distinct().groupBy("e", "t").agg(F.count(F.lit(1)).alias("n_et"))
    pairs = settle(supported.join(in_texts, ["e", "t"]).select("e", "t", "n_et"), "pairs")
    if pairs.isEmpty():
        return pairs.select("e", "t", F.lit(1.0).alias("p"))
    scored = pairs.join(texts_with(docs, pairs), "t").join(per_entity, "e")
    p = F.col("n_et") / F.greatest("n", "n_et")
    scored = scored.select("e", "t", p.alias("p"), F.log2(p * total / F.col("n_e")).alias("told"))
    return scored.where((F.col("p") >= disclosure) & (F.col("told") >= bits)).select("e", "t", "p")


def term_spans(docs: DataFrame, shown: DataFrame) -> DataFrame:
    """(k1, k2, terms): every occurrence of a disclosing term in each text of (doc_id, text), as start, stop and p in order."""
    terms = settle(shown.groupBy("t").agg(F.max("p").alias("p")), "terms")
    slots = docs.sparkSession.sparkContext.broadcast(slots_of(terms, "t"))  # a fixed number of bits

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Wanted(slots.value)
        for text, k1, k2 in chunks(batches, ["text", "k1", "k2"]):
            out: dict[str, list] = {"k1": [], "k2": [], "t": [], "places": []}
            for t, a, b in zip(text, k1, k2, strict=True):
                # a word beside an entity without white space is a word of its own only where the text has entities
                spans = base_spans(t)
                cut = [t[x:y] for x, y, word in tokens(t, spans) if word] if spans else t.split()
                hits = wanted.of(set(cut))
                if not hits:
                    continue
                places: dict[int, list] = {}
                for x, y, word in tokens(t, spans):
                    h = hits.get(t[x:y]) if word else None
                    if h is not None:
                        start = y - len(t[x:y].lstrip(EDGES))
                        places.setdefault(h, []).append({"start": start, "stop": start + len(t[x:y].strip(EDGES))})
                for h, at in places.items():
                    for column, value in zip(out.values(), (a, b, h, at), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_pydict({c: pa.array(v, PLACES if c == "places" else pa.int64()) for c, v in out.items()})

    own = _keyed(docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text <> ''"))
    if terms.isEmpty():
        own = own.where("false")
    found = own.mapInArrow(released(run), "k1 long, k2 long, t long, places array<struct<start:int,stop:int>>")
    hit = found.join(terms, "t").select("k1", "k2", "p", F.explode("places").alias("x")).groupBy("k1", "k2", "x.start", "x.stop").agg(F.max("p").alias("p"))
    return hit.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "p"))).alias("terms"))


def find(docs: DataFrame) -> DataFrame:
    """One row per document: counts per base kind, ``base`` and ``spans`` as kind:start:end, and the number of disclosing terms."""
    base = settle(find_base(docs), "base-spans")
    terms = term_spans(docs, disclosing(base, docs))
    joined = base.drop("mentions", "d").join(terms, ["k1", "k2"], "left")
    written = F.array_join(F.transform("terms", lambda s: F.concat_ws(":", F.lit(TERM), s["start"], s["stop"])), ",")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), written)
    return joined.select("doc_id", *[f"n_{k}" for k in KINDS], "base", spans.alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term"))


def redact(text: str | None, terms: list[dict] | None, removal: float = REMOVAL) -> str | None:
    """Entities become their kind in brackets; terms are removed, or become [TERM] below the removal threshold. Where spans overlap the first decides."""
    if not text:
        return text
    spans = sorted([(a, b, f"[{k.upper()}]") for k, a, b in base_spans(text)] + [(s["start"], s["stop"], "" if s["p"] >= removal else "[TERM]") for s in terms or ()])
    out, done = [], 0
    for a, b, put in spans:
        if a >= done:
            out += [text[done:a], put]
        done = max(done, b)
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with entities and disclosing terms replaced in ``text``; ``n_chars``, where it is a column, follows."""
    own = docs.select(*columns)
    base = settle(find_base(own).where(F.size("mentions") > 0), "base-spans")
    terms = settle(term_spans(own, disclosing(base, own)), "term-spans")
    joined = _keyed(own).join(terms, ["k1", "k2"], "left")
    schema = own.schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [redact(t, s) for t, s in zip(batch.column("text").to_pylist(), batch.column("terms").to_pylist(), strict=True)]
            held = {c: batch.column(c) for c in columns}
            held["text"] = pa.array(text, pa.string())
            if "n_chars" in held:
                kind = held["n_chars"].type
                held["n_chars"] = pa.array([None if t is None else len(t) for t in text], kind)
            yield pa.RecordBatch.from_arrays(list(held.values()), names=list(held))

    return joined.select(*columns, "terms").mapInArrow(released(run), schema)


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
