"""Removal of repeated byte strings by suffix arrays.

Every byte of a ``length``-byte string that also starts earlier is removed. The method is a suffix array with common prefixes; before it, the
input is compacted to what can repeat at all:

1. Each string of ``length`` bytes has an anchor, the gram of ``GRAM`` bytes in it with the least hash (the leftmost of equals), so equal strings have equal
   anchors at equal places. Neighbouring strings with one anchor form a stretch. One scan emits a stretch as its anchor's hash, its
   content's hash and its place: about one row per 38 bytes, and never text. Stretches that occur earlier in the same batch are settled there.
2. Rows meet by anchor. Of stretches with equal content all but the first are repeats as a whole. An anchor with one content only has no further
   repeats; the distinct contents of the others are contested.
3. Contested contents are dealt into shards of bounded size. A shard's suffix array is built by Larsson-Sadakane refinement: suffixes are sorted by seven
   symbols, then only groups that still tie are sorted by the rank of the suffix behind, doubling the depth. Common prefixes follow by Kasai's rule, each
   stretch a lane: the next suffix shares at least one symbol less. Neighbours that share ``length`` bytes are one string, whose earliest place stays.
4. The contents of an anchor too frequent for one shard are spread over several; each shard returns its strings in order, and shards are merged by binary
   search of one order in the other.

Nothing whole passes through the driver. A line that a third of all documents hold is one row per batch inside, and spread shards at its ends.

Defined results: a null or empty text has nothing to remove; ids are row keys, a row that is repeated whole gets the same result; rows without an id are
neither searched nor changed; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import chunks, sorted_runs
from surveyloom.llm.shingles import mix, prefix_hashes
from surveyloom.session import settle

LENGTH = 100
GRAM = 24
PLACE_BITS = 28
#: Stretches of a shard.
SHARD = 8192
INTERVAL = ("doc", "s", "e")


def anchors(b: np.ndarray, total: np.ndarray, inverse: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the gram at each place, and for each string of ``length`` bytes the place of its anchor."""
    n = len(b) - gram + 1
    g = mix((total[gram:] - total[:-gram]) * inverse[:n])
    width = length - gram + 1
    order = (g >> np.uint64(PLACE_BITS)) << np.uint64(PLACE_BITS) | np.arange(n, dtype=np.uint64)
    rows = -(-n // width)
    grid = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = order
    grid = grid.reshape(rows, width)
    from_left = np.minimum.accumulate(grid, axis=1).ravel()
    from_right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    strings = len(b) - length + 1
    least = np.minimum(from_right[:strings], from_left[width - 1 : width - 1 + strings])
    return g, (least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)


def stretches(ids: np.ndarray, texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Stretches of all texts: anchor hash g, content hash b, doc, start s and number of strings w."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    b = np.frombuffer(b"".join(texts), np.uint8)
    none = {"g": np.empty(0, np.int64), "b": np.empty(0, np.int64), "doc": np.empty(0, np.int64), "s": np.empty(0, np.int64), "w": np.empty(0, np.int64)}
    if len(b) < length:
        return none
    total, inverse = prefix_hashes(b)
    g, anchor = anchors(b, total, inverse, length, gram)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
    inside = np.arange(len(anchor)) + length <= ends[owner]
    start = inside & np.r_[True, (anchor[1:] != anchor[:-1]) | ~inside[:-1] | (owner[1:] != owner[:-1])]
    stop = inside & np.r_[start[1:] | ~inside[1:], True]
    s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
    if not len(s):
        return none
    content = (total[e + length - 1] - total[s]) * inverse[s]
    key = mix(content ^ mix((e - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    own = owner[s]
    return {"g": g[anchor[s]].view(np.int64), "b": key.view(np.int64), "doc": ids[own], "s": s - (ends - sizes)[own], "w": e - s}


def _merged(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of intervals of each document; overlapping and touching ones become one."""
    if not len(doc):
        return doc, s, e
    order = np.lexsort((s, doc))
    doc, s, e = doc[order], s[order], e[order]
    new_doc = np.r_[True, doc[1:] != doc[:-1]]
    number = np.cumsum(new_doc)
    reach = np.maximum.accumulate(e + number * (1 << 40)) - number * (1 << 40)
    new = new_doc | np.r_[True, s[1:] > reach[:-1]]
    at = np.flatnonzero(new)
    return doc[at], s[at], reach[np.r_[at[1:] - 1, len(doc) - 1]]


def _scan(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Stretches (w > 0) that are the first of their content in a batch, and intervals (w < 0, of -w bytes) settled already."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [stretches(np.array(ids, np.int64), [(t or "").encode("utf-8", "replace") for t in text], length, gram) for ids, text in chunks([batch], ["doc_id", "text"], limit=1 << 20)]
            found = {c: np.concatenate([p[c] for p in parts]) for c in ("g", "b", "doc", "s", "w")} if parts else {}
            if not parts or not len(found["g"]):
                continue
            order = np.lexsort((found["s"], found["doc"], found["b"], found["g"]))
            found = {c: v[order] for c, v in found.items()}
            first = np.r_[True, (found["g"][1:] != found["g"][:-1]) | (found["b"][1:] != found["b"][:-1])]
            head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
            same_place = (found["doc"] == found["doc"][head]) & (found["s"] == found["s"][head])
            later = ~first & ~same_place
            doc, s, e = _merged(found["doc"][later], found["s"][later], (found["s"] + found["w"])[later] + length - 1)
            out = {c: v[first] for c, v in found.items()}
            settled = {"g": mix(doc.view(np.uint64)).view(np.int64), "b": np.zeros(len(doc), np.int64), "doc": doc, "s": s, "w": s - e}
            yield pa.RecordBatch.from_pydict({c: np.concatenate([out[c], settled[c]]).astype(np.int32 if c in "sw" else np.int64) for c in out})

    return docs.select("doc_id", "text").mapInArrow(run, "g long, b long, doc long, s int, w int")


def _by_anchor(rows: DataFrame, length: int, shard: int) -> DataFrame:
    """Intervals (kind 0, w bytes) and contested stretches (kind 1), the latter with their number among those of their anchor cut into pieces."""

    def settle_run(c: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        plain = c["w"] < 0
        intervals = {k: v[plain] for k, v in c.items()}
        c = {k: v[~plain] for k, v in c.items()}
        n = len(c["g"])
        new_g = np.r_[True, c["g"][1:] != c["g"][:-1]] if n else np.empty(0, bool)
        first = new_g | np.r_[True, c["b"][1:] != c["b"][:-1]] if n else new_g
        head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        later = ~first & ((c["doc"] != c["doc"][head]) | (c["s"] != c["s"][head]))
        of_g = np.cumsum(new_g) - 1
        contents = np.bincount(of_g[first], minlength=int(new_g.sum())) if n else np.empty(0, np.int64)
        contested = first & (contents[of_g] > 1) if n else first
        number = np.cumsum(first) - 1
        number = number - number[np.flatnonzero(new_g)][of_g] if n else number
        piece = np.where(contents[of_g] > shard, number // shard, -1)[contested] if n else np.empty(0, np.int64)
        doc, s, e = _merged(
            np.concatenate([intervals["doc"], c["doc"][later]]),
            np.concatenate([intervals["s"], c["s"][later]]).astype(np.int64),
            np.concatenate([intervals["s"] - intervals["w"], c["s"][later] + c["w"][later] + length - 1]).astype(np.int64),
        )
        k = int(contested.sum())
        if not k + len(doc):
            return None
        return pa.RecordBatch.from_pydict(
            {
                "kind": np.repeat(np.array([0, 1], np.int8), [len(doc), k]),
                "g": np.concatenate([np.zeros(len(doc), np.int64), c["g"][contested]]),
                "piece": np.concatenate([np.zeros(len(doc)), piece]).astype(np.int32),
                "doc": np.concatenate([doc, c["doc"][contested]]),
                "s": np.concatenate([s, c["s"][contested]]).astype(np.int32),
                "w": np.concatenate([e - s, c["w"][contested]]).astype(np.int32),
            }
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("g", "b", "doc", "s", "w")
        held = None
        for batch in batches:
            c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
            if held is not None:
                c = {k: np.concatenate([held[k], c[k]]) for k in names}
            if not len(c["g"]):
                continue
            cut = int(np.searchsorted(c["g"], c["g"][-1]))  # the last anchor may go on in the next batch
            held = {k: v[cut:] for k, v in c.items()}
            if cut and (out := settle_run({k: v[:cut] for k, v in c.items()})) is not None:
                yield out
        if held is not None and len(held["g"]) and (out := settle_run(held)) is not None:
            yield out

    dealt = rows.repartition("g").sortWithinPartitions("g", "b", "doc", "s")
    return dealt.mapInArrow(run, "kind byte, g long, piece int, doc long, s int, w int")


def suffix_array(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first ``depth`` symbols, and each suffix's place in it; 0 ends a string, other symbols are up to 256.

    Larsson-Sadakane: a suffix's rank is the first place of its group, so sorting a group never touches other groups, and groups of one are left alone.
    """
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(7, symbols.dtype)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    open_ = np.ones(n, bool)
    for k in range(7):
        here = np.where(open_, padded[k : k + n], np.uint64(0))
        open_ &= here > 0
        key = key << np.uint64(9) | here
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    h = 7
    size = np.diff(np.r_[np.flatnonzero(new), n])
    # strings that ended tie for good, in the order of the text, as Kasai's rule wants
    left = np.minimum.accumulate(np.where(symbols == 0, np.arange(n), n)[::-1])[::-1] - np.arange(n)
    tied = np.flatnonzero(np.repeat(size > 1, size) & (left[order] >= h))
    while h < depth and len(tied):
        suffix = order[tied]
        behind = suffix + h
        second = np.where(behind < n, rank[np.minimum(behind, n - 1)], -1)
        first = rank[suffix]
        by = np.lexsort((second, first))
        suffix, first, second = suffix[by], first[by], second[by]
        order[tied] = suffix
        new = np.r_[True, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]
        heads = np.flatnonzero(new)
        rank[suffix] = tied[np.repeat(heads, np.diff(np.r_[heads, len(new)]))]
        size = np.diff(np.r_[heads, len(new)])
        h *= 2
        tied = tied[np.repeat(size > 1, size) & (left[suffix] >= h)]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def common_prefixes(symbols: np.ndarray, order: np.ndarray, place: np.ndarray, starts: np.ndarray, counts: np.ndarray, cap: int) -> np.ndarray:
    """By place in the order, how many symbols (``cap`` at most) a suffix shares with the one before it, for the first ``counts`` suffixes of each lane.

    Kasai: the suffix that follows in the text shares at least one symbol less. All lanes advance together, one suffix a step.
    """
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(cap + 16, symbols.dtype)])
    shared = np.zeros(n, np.int64)
    lane = np.zeros(len(starts), np.int64)
    for step in range(int(counts.max(initial=0))):
        on = np.flatnonzero(counts > step)
        i = starts[on] + step
        at = place[i]
        before = np.where(at > 0, order[np.maximum(at - 1, 0)], n)
        h = np.maximum(lane[on] - 1, 0)
        going = np.flatnonzero(before < n)
        while len(going):
            a, b = padded[i[going] + h[going]], padded[before[going] + h[going]]
            going = going[(a == b) & (a > 0)]
            h[going] += 1
            going = going[h[going] < cap]
        h[before == n] = 0
        lane[on] = h
        shared[at] = h
    return shared


def first_places(doc: np.ndarray, s: np.ndarray, w: np.ndarray, contents: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """All strings of a shard in suffix order: stretch, offset, group number, and whether it is the earliest of its group."""
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    symbols = np.zeros(int(sizes.sum()) + len(sizes), np.int16)
    begins = np.cumsum(sizes + 1) - sizes - 1
    inside = np.ones(len(symbols), bool)
    inside[begins + sizes] = False
    symbols[inside] = np.frombuffer(b"".join(contents), np.uint8).astype(np.int16) + 1
    order, place = suffix_array(symbols, int(sizes.max(initial=0)))  # to the end: Kasai's rule needs the whole order
    shared = common_prefixes(symbols, order, place, begins, w, length)
    own = np.repeat(np.arange(len(contents)), sizes + 1)[order]
    offset = order - begins[own]
    string = offset < w[own]
    shared, own, offset = shared[string], own[string], offset[string]
    group = np.cumsum(shared < length) - 1
    at = s[own] + offset
    by_place = np.lexsort((at, doc[own], group))
    first = np.zeros(len(own), bool)
    first[by_place[np.r_[True, group[by_place][1:] != group[by_place][:-1]]]] = True
    same = np.zeros(len(own), bool)  # the same place twice, of a repeated row, is no repeat
    if len(own):
        g, d, a = group[by_place], doc[own][by_place], at[by_place]
        head = np.maximum.accumulate(np.where(np.r_[True, g[1:] != g[:-1]], np.arange(len(g)), 0))
        same[by_place] = (d == d[head]) & (a == a[head])
    return own, offset, group, first | same


def _contents(docs: DataFrame, contested: DataFrame, length: int, shards: int) -> DataFrame:
    """Contested stretches with their bytes, dealt into shards: a frequent anchor's pieces are shards of their own."""
    per_doc = contested.groupBy("doc").agg(F.collect_list(F.struct("g", "piece", "s", "w")).alias("own"))
    texts = docs.join(per_doc, docs.doc_id == per_doc.doc).select("doc", "text", "own")
    kinds = pa.schema([("g", pa.int64()), ("piece", pa.int32()), ("doc", pa.int64()), ("s", pa.int32()), ("w", pa.int32()), ("content", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, text, own in chunks(batches, ["doc", "text", "own"]):
            rows = []
            for d, t, places in zip(doc, text, own, strict=True):
                b = t.encode("utf-8", "replace")
                rows += [(p["g"], p["piece"], d, p["s"], p["w"], b[p["s"] : p["s"] + p["w"] + length - 1]) for p in places]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    rows = texts.mapInArrow(run, "g long, piece int, doc long, s int, w int, content binary")
    light = F.col("piece") < 0
    return rows.withColumn("shard", F.when(light, F.pmod(F.xxhash64("g"), F.lit(shards))).otherwise(F.col("g")))


def _in_shards(rows: DataFrame, length: int) -> DataFrame:
    """Intervals (kind 0) of repeats within a shard; of spread shards also the strings to merge (kind 1), each with 128 bits of its content."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in sorted_runs(batches, ["shard", "piece"]):
            doc, s, w = (shard[c].to_numpy().astype(np.int64) for c in ("doc", "s", "w"))
            contents = shard["content"].to_pylist()
            own, offset, group, keep = first_places(doc, s, w, contents, length)
            again = ~keep
            d, a, e = _merged(doc[own[again]], s[own[again]] + offset[again], s[own[again]] + offset[again] + length)
            out = {"kind": np.zeros(len(d), np.int8), "g": np.zeros(len(d), np.int64), "piece": np.zeros(len(d), np.int32), "h1": np.zeros(len(d), np.int64)}
            out |= {"h2": np.zeros(len(d), np.int64), "doc": d, "s": a.astype(np.int32), "e": e.astype(np.int32)}
            piece = shard["piece"][0].as_py()
            if piece >= 0 and keep.any():
                k_own, k_off = own[keep], offset[keep]
                digests = [hashlib.blake2b(contents[x][o : o + length], digest_size=16).digest() for x, o in zip(k_own.tolist(), k_off.tolist(), strict=True)]
                h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                n = len(h)
                more = {"kind": np.ones(n, np.int8), "g": np.full(n, shard["g"][0].as_py()), "piece": np.full(n, piece, np.int32), "h1": h[:, 0], "h2": h[:, 1]}
                more |= {"doc": doc[k_own], "s": (s[k_own] + k_off).astype(np.int32), "e": (s[k_own] + k_off + length).astype(np.int32)}
                out = {c: np.concatenate([v, more[c]]) for c, v in out.items()}
            if len(out["kind"]):
                yield pa.RecordBatch.from_pydict(out)

    dealt = rows.repartition("shard", "piece").sortWithinPartitions("shard", "piece")
    return dealt.mapInArrow(run, "kind byte, g long, piece int, h1 long, h2 long, doc long, s int, e int")


def _merge_shards(strings: DataFrame) -> DataFrame:
    """Intervals of strings that an earlier place of another shard holds too: every shard's order is searched in the order merged so far."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sorted_runs(batches, ["g", "bucket"]):
            c = {k: part[k].to_numpy().astype(np.int64) for k in ("piece", "h1", "h2", "doc", "s", "e")}
            cuts = np.flatnonzero(np.r_[True, c["piece"][1:] != c["piece"][:-1]]).tolist()
            merged: dict[str, np.ndarray] | None = None
            again = []
            for a, b in zip(cuts, [*cuts[1:], len(c["piece"])], strict=True):
                own = {k: v[a:b] for k, v in c.items()}
                if merged is None:
                    merged = own
                    continue
                at = np.searchsorted(merged["h1"], own["h1"])
                near = np.minimum(at, len(merged["h1"]) - 1)
                equal = (merged["h1"][near] == own["h1"]) & (merged["h2"][near] == own["h2"])
                i, j = near[equal], np.flatnonzero(equal)
                earlier = (own["doc"][j] < merged["doc"][i]) | ((own["doc"][j] == merged["doc"][i]) & (own["s"][j] < merged["s"][i]))
                same = (own["doc"][j] == merged["doc"][i]) & (own["s"][j] == merged["s"][i])
                again += [(own["doc"][j[~earlier & ~same]], own["s"][j[~earlier & ~same]], own["e"][j[~earlier & ~same]])]
                swap_i, swap_j = i[earlier], j[earlier]
                again += [(merged["doc"][swap_i].copy(), merged["s"][swap_i].copy(), merged["e"][swap_i].copy())]
                for k in ("doc", "s", "e"):
                    merged[k] = merged[k].copy()
                    merged[k][swap_i] = own[k][swap_j]
                fresh = ~equal
                merged = {k: np.insert(v, at[fresh], own[k][fresh]) for k, v in merged.items()}
            if again:
                doc, s, e = _merged(*(np.concatenate(x) for x in zip(*again, strict=True)))
                if len(doc):
                    yield pa.RecordBatch.from_pydict({"doc": doc, "s": s.astype(np.int32), "e": e.astype(np.int32)})

    parts = strings.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / (32 * SHARD)).alias("parts"))
    dealt = strings.join(parts, "g").withColumn("bucket", F.pmod("h1", F.col("parts")))
    dealt = dealt.repartition("g", "bucket").sortWithinPartitions("g", "bucket", "piece", "h1")
    return dealt.select("g", "bucket", "piece", "h1", "h2", "doc", "s", "e").mapInArrow(run, "doc long, s int, e int")


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """(doc, s, e): byte intervals that repeats cover; they may overlap."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    met = settle(_by_anchor(_scan(own, length, gram), length, shard), "stretches")
    whole = met.where("kind = 0").select("doc", "s", (F.col("s") + F.col("w")).alias("e"))
    contested = met.where("kind = 1").drop("kind")
    shards = max(1, -(-contested.where("piece < 0").count() // shard))
    sharded = settle(_in_shards(_contents(own, contested, length, shards), length), "shards")
    found = whole.unionByName(sharded.where("kind = 0").select(*INTERVAL))
    strings = sharded.where("kind = 1").drop("kind")
    return found if strings.isEmpty() else found.unionByName(_merge_shards(strings).select(*INTERVAL))


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed byte ranges, maximal), and the SHA-256 of the bytes kept, one row per row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    cover = repeated(docs, length, gram, shard).groupBy("doc").agg(F.collect_list(F.struct("s", "e")).alias("cover"))
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(cover, F.col("doc_id").cast("long") == cover.doc, "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, text, cover in chunks(batches, ["doc_id", "text", "cover"]):
            out: dict[str, list] = {"doc_id": ids, "n_bytes": [], "n_removed": [], "spans": [], "kept_sha256": []}
            for t, c in zip(text, cover, strict=True):
                b = (t or "").encode("utf-8", "replace")
                spans, kept, done = [], hashlib.sha256(), 0
                if c:
                    s, e = (np.array([x[k] for x in c], np.int64) for k in ("s", "e"))
                    _, s, e = _merged(np.zeros(len(s), np.int64), s, e)
                    spans = list(zip(s.tolist(), e.tolist(), strict=True))
                for a, z in spans:
                    kept.update(b[done:a])
                    done = z
                kept.update(b[done:])
                out["n_bytes"].append(len(b))
                out["n_removed"].append(sum(z - a for a, z in spans))
                out["spans"].append([{"s": a, "e": z} for a, z in spans])
                out["kept_sha256"].append(kept.hexdigest())
            spans = pa.array(out["spans"], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))
            yield pa.RecordBatch.from_pydict(out | {"spans": spans})

    return joined.select("doc_id", "text", "cover").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, spans array<struct<s:int,e:int>>, kept_sha256 string")
