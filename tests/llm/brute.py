"""Plain versions the operators are held against."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


def lm_base(rows):
    """(n_tokens, n_known, train_tokens, base_score) by doc_id."""
    tokens = {i: re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) + [None] for i, t in rows}
    c = Counter(w for i, ws in tokens.items() if crc(i, 7) != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    return {i: (len(ws), sum(c[w] > 0 for w in ws), n, math.fsum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens.items()}


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(d):
    d = [int(x) for x in d][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def pii(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and _luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def links(vectors, threshold=0.95):
    """(n_links, component) by id."""
    ids = [i for i, _ in vectors]
    good = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v in vectors]
    n = defaultdict(int)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    at = [k for k in range(len(ids)) if good[k]]
    x = np.array([np.asarray(vectors[k][1], float) / np.linalg.norm(np.asarray(vectors[k][1], float)) for k in at]) if at else np.zeros((0, 1))
    for a in range(len(at)):
        for b in np.flatnonzero(x[a] @ x.T >= threshold).tolist():
            if b != a:
                n[ids[at[a]]] += 1
                r, s = sorted((root(ids[at[a]]), root(ids[at[b]])))
                parent[s] = r
    return {i: (n[i], root(i)) for i in ids}


def warc(rows):
    digest = {p: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for p, h in rows}
    first = {}
    for p, d in digest.items():
        first[d] = min(first.get(d, p), p)
    return {p: (len((h or "").encode()), digest[p], "response" if first[digest[p]] == p else "revisit", None if first[digest[p]] == p else first[digest[p]]) for p, h in rows}


def repeats(rows, length=100):
    """(n_bytes, n_removed, n_spans, kept sha256) by doc_id."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for a in range(len(b) - length + 1):
            s = b[a : a + length]
            if s in seen:
                gone[a] += 1
                gone[a + length] -= 1
            else:
                seen.add(s)
        gone = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def contamination(docs, items, width=13):
    windows = defaultdict(set)
    sizes = set()
    for item, t in items:
        w = WORD.findall(low(t))
        if w:
            n = min(width, len(w))
            sizes.add(n)
            for a in range(len(w) - n + 1):
                windows[tuple(w[a : a + n])].add(item)
    out = {}
    for i, t in docs:
        w = WORD.findall(low(t))
        hit, found = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                own = windows.get(tuple(w[a : a + n]))
                if own:
                    hit |= set(range(a, a + n))
                    found |= own
        names = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out[i] = (len(w), len(hit), len(found), names, bool(hit) and 20 * len(hit) >= len(w))
    return out


def hard_negatives(rows, low=(30, 100), high=(90, 100)):
    """Rows of the mining contract from (vec_id, embedding, label) with unique ids; labels shift where the id is divisible by 7."""
    good = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        good[i] = ([math.floor(256 * c) for c in v], (label + 1) % 10 if i % 7 == 0 else label)
    out = []
    for a, (x, label) in good.items():
        if a % 100:
            continue
        score = {i: sum(p * q for p, q in zip(x, y, strict=True)) for i, (y, _) in good.items() if i != a and len(y) == len(x)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if good[i][1] == label][:5]:
            fit = [i for i in order if good[i][1] != label and low[0] * score[p] <= low[1] * score[i] and high[1] * score[i] <= high[0] * score[p]]
            out += [(a, p, r, i, score[p], score[i]) for r, i in enumerate(fit[:10], 1)]
    return sorted(out)


def simhash(text, bits=128, width=7):
    """The fingerprint by plain integers, one vote at a time."""
    mask = (1 << 64) - 1

    def mix(h):
        h ^= h >> 31
        h = h * 0xBF58476D1CE4E5B9 & mask
        h ^= h >> 29
        h = h * 0x94D049BB133111EB & mask
        return h ^ (h >> 32)

    padded = [0] * (width - 1) + [ord(c) + 1 for c in text.lower()] + [0] * (width - 1)
    count = Counter(tuple(padded[i : i + width]) for i in range(len(padded) - width + 1)) if text else Counter()
    votes = [0.0] * bits
    for term, n in count.items():
        h = 0
        for c in term:
            h = (h * (0x9E3779B97F4A7C15 | 1) + c) & mask
        h = mix(h)
        raw = b"".join((h if w == 0 else mix(h ^ (w * 0x9E3779B97F4A7C15 & mask))).to_bytes(8, "little") for w in range(bits // 64))
        for b in range(bits):
            votes[b] += (1 if raw[b // 8] >> (7 - b % 8) & 1 else -1) * (1 + math.log(n))
    return np.packbits(np.array(votes) > 0).tobytes()


def near_prints(rows, radius):
    """(n_links, class) by id of (id, fingerprint bytes) with unique ids."""
    ids = [i for i, _ in rows]
    x = np.frombuffer(b"".join(f for _, f in rows), np.uint64).reshape(len(rows), -1)
    near = [np.flatnonzero(np.bitwise_count(x ^ v).sum(axis=1) <= radius).tolist() for v in x]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, found in enumerate(near):
        for b in found:
            r, s = root(a), root(b)
            if r != s:
                parent[max(r, s, key=lambda k: ids[k])] = min(r, s, key=lambda k: ids[k])
    return {i: (len(near[k]) - 1, ids[root(k)]) for k, i in enumerate(ids)}


def trie(rows):
    """Nodes of the trie contract from (conv_id, turn, role, text); equal turns must not occur."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = crc(c, 4)
        built[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, below = [], {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        kids = [below[k] for k in children[node]]
        below[node] = (sum(k[0] for k in kids) or 1, (len(members[node]) - 1) * words + sum(k[1] for k in kids))
        ends = ",".join(str(c) for c in sorted(c for c in members[node] if built[c] == node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(kids), *below[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))
