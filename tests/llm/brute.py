"""Plain versions of the operators, straight from their definitions."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def substring_dedup(docs, width=13):
    """docs: (doc_id, text). Rows (doc_id, n_words, n_removed, kept_sha256)."""
    first = {}
    far = float("inf")
    for doc, text in docs:
        w = words(text)
        for i in range(len(w) - width + 1):
            key = tuple(w[i:i + width])
            first[key] = min(first.get(key, far), far if doc is None else doc)
    out = []
    for doc, text in docs:
        w, own = words(text), far if doc is None else doc
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i:i + width])] < own:
                gone.update(range(i, i + width))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def bytes_dedup(docs, width=100):
    first = {}
    far = float("inf")
    order = sorted(range(len(docs)), key=lambda i: (far if docs[i][0] is None else docs[i][0], i))
    rows = {}
    seen: dict[bytes, float] = {}
    for i in order:
        doc, text = docs[i]
        own, data = far if doc is None else doc, (text or "").encode()
        gone, mine = bytearray(len(data)), set()
        for p in range(len(data) - width + 1):
            s = data[p:p + width]
            if s in mine or seen.get(s, far) < own:
                gone[p:p + width] = b"\1" * width
            mine.add(s)
        for s in mine:
            seen[s] = min(seen.get(s, far), own)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        rows[i] = (doc, len(data), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), sha(kept))
    return [rows[i] for i in range(len(docs))]


def quality(text, min_repeat=10, max_covered=0.5, max_repeat=200):
    text = text or ""
    w = words(text)

    def covered(size):
        at = {}
        for i in range(len(w) - size + 1):
            at.setdefault(tuple(w[i:i + size]), []).append(i)
        return len({p for x in at.values() if len(x) > 1 for i in x for p in range(i, i + size)})

    longest = 0
    while longest < len(w) and covered(longest + 1):
        longest += 1
    seen, lines = set(), 0
    for line in text.split("\n"):
        if words(line):
            lines += line in seen
            seen.add(line)
    repeat, cover = covered(3), covered(min_repeat)
    base = len(w) < 50 or 100 * repeat > 50 * len(w)
    kept = not base and cover <= max_covered * len(w) and longest <= max_repeat
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), lines, repeat, cover, longest,
            base, kept)


def simhash(text, shingle=4):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    width = min(shingle, len(w))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i:i + width]).encode(), 42) for i in range(len(w) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(docs, radius=4):
    """Rows (doc_id, fingerprint, component_id)."""
    fps = [simhash(t) for _, t in docs]
    distinct = sorted(set(fps))
    up = {f: f for f in distinct}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= radius:
                up[root(a)] = root(b)
    least = {}
    for (doc, _), f in zip(docs, fps):
        if doc is not None:
            r = root(f)
            least[r] = min(least.get(r, doc), doc)
    return [(doc, f"{f:016x}", least.get(root(f))) for (doc, _), f in zip(docs, fps)]


def token_pieces(docs, tokenizer, capacity=2048, end=0):
    out = []
    for doc, text in docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end]
        first = len(ids) % capacity or capacity
        at = number = 0
        while at < len(ids):
            size = capacity if at else first
            raw = b"".join(x.to_bytes(4, "little") for x in ids[at:at + size])
            out.append((doc, number, at, size, zlib.crc32(raw)))
            at, number = at + size, number + 1
    return out


def best_packing(lengths, capacity):
    """The fewest sequences, by trying everything (small inputs)."""
    best = [len(lengths)]

    def put(rest, bins):
        if len(bins) >= best[0]:
            return
        if not rest:
            best[0] = len(bins)
            return
        tried = set()
        for i, room in enumerate(bins):
            if rest[0] <= room and room not in tried:
                tried.add(room)
                put(rest[1:], bins[:i] + [room - rest[0]] + bins[i + 1:])
        put(rest[1:], bins + [capacity - rest[0]])

    put(sorted(lengths, reverse=True), [])
    return best[0]


def counted(rows):
    return Counter(rows)


TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def audit(docs, least, top):
    """docs: (text, lang, source). Rows (lang, source, part, item, value, rank)."""
    docs = [(t or "", lang or "", s or "") for t, lang, s in docs]
    lower = {c: c + 32 for c in range(65, 91)}
    found = [(TERM.findall(t.translate(lower)), lang, s) for t, lang, s in docs]
    out = []
    for lang in {d[1] for d in docs}:
        own = [(Counter(t), s) for t, g, s in found if g == lang]
        df = Counter(w for t, _ in own for w in t)
        kept = [w for w, n in df.items() if n >= least]
        sums = {s: Counter() for _, s in own}
        for t, s in own:
            sums[s].update(t)

        def shares(count):
            total = sum(count[w] for w in kept) + 5 * len(kept)
            return {w: 1 + 10**9 * (count[w] + 5) // total for w in kept}

        p = {s: shares(c) for s, c in sums.items()}
        q = shares(sum(sums.values(), Counter()))
        for s in sums:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sums if o != s]
            over = [(p[s][w] - q[w], w) for w in kept if sums[s][w] and p[s][w] > q[w]]
            for part, rows, n in (("pair", pairs, len(pairs)), ("term", over, top)):
                rows = sorted(rows, key=lambda r: (-r[0], r[1].encode()))[:n]
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(rows)]
    return out


def align(docs, a, a_bytes, b):
    """docs: (doc_id, text); a(text) ids, their bytes, b(text) (id, bytes).
    Rows as of ``token_alignment.align``, and each document's groups as text."""
    rows, pairs = [], Counter()
    for doc, text in docs:
        whole = (" " + text).encode() if text else b""
        left = [(k, a_bytes[k]) for k in a(" " + text)] if text else []
        right = b(text) if text else []
        if b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
            left = right = []

        def places(tokens):
            at, out = 0, []
            for k, x in tokens:
                out.append((k, at, at + len(x)))
                at += len(x)
            return out

        left, right = places(left), places(right)
        ends = sorted({e for _, _, e in left} & {e for _, _, e in right})
        shown = []
        first = i = j = 0
        own = []
        for e in ends:
            x = [t for t in left[i:i + e - first + 1] if t[2] <= e]
            y = [t for t in right[j:j + e - first + 1] if t[2] <= e]
            i, j, first = i + len(x), j + len(y), e
            shown.append(",".join(str(t[0]) for t in x) + "|" + ",".join(str(t[0]) for t in y))
            own += [(u[0], v[0]) for u in x for v in y if u[1] < v[2] and v[1] < u[2]]
        pairs.update(set(own))
        rows.append((doc, len(left), len(right), len(ends), own, ";".join(shown)))
    highest = Counter()
    for (u, _), n in pairs.items():
        highest[u] = max(highest[u], n)
    return [(doc, na, nb, ng, len(own), sum(pairs[x] == highest[x[0]] for x in own), sum(pairs[x] for x in own),
             sha(text) if text else "", text) for doc, na, nb, ng, own, text in rows]


def exact(docs):
    """docs: (doc_id, text). Rows (doc_id, keep_id, group_size, kept, sha); of rows that
    repeat the id too, one is kept."""
    far = float("inf")
    plain = [re.sub("[\x20\x09-\x0D]+", " ", t or "") for _, t in docs]
    groups = {}
    for k, text in enumerate(plain):
        groups.setdefault(text, []).append(k)
    out = []
    for text, rows in groups.items():
        rows.sort(key=lambda k: far if docs[k][0] is None else docs[k][0])
        out += [(docs[k][0], docs[rows[0]][0], len(rows), k == rows[0], sha(text)) for k in rows]
    return out


def imatch(docs, low, high, subsets, rates, per_rate, hash_of, mix):
    """docs: (doc_id, text) in their order. Per document (own, edited, near_edited, near_next):
    fingerprints as lists. ``hash_of`` and ``mix`` are the operator's random functions."""
    full = (1 << 48) - 1

    def terms(text):
        found = "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in text)
        return {hash_of(w.encode()) & full for w in found.split(" ") if w}

    def fold(some):
        if not some:
            return 0
        total = sum(mix((t + mix(k, 41)) % 2**64, 42) for k, t in enumerate(sorted(some))) % 2**64
        return max(mix(total, 43) >> 32, 1)

    texts = [t or "" for _, t in docs]
    df = Counter(t for text in texts for t in terms(text))
    lexicon = {t for t, n in df.items() if low * len(texts) <= n <= high * len(texts)}

    def fingerprint(text):
        own = terms(text)
        own = own & lexicon or own
        out = [fold(own)] + [0] * (subsets - 1)
        for seed in range(per_rate):
            for rate in range(rates):
                out[1 + rate * per_rate + seed] = fold(
                    [t for t in own if mix(t, 50 + seed) >> (64 - 2 * (rate + 1)) == 0])
        return out

    def likeness(a, b):
        if a == b:
            return 1.0
        same = [x == y and x != 0 for x, y in zip(a[1:], b[1:])]
        return max(sum(same[r * per_rate:(r + 1) * per_rate]) / per_rate for r in range(rates))

    out = []
    for k, text in enumerate(texts):
        following = texts[(k + 1) % len(texts)]
        size = len(text) // 4
        edited = text[:len(text) - size] + following[:size]
        own, changed = fingerprint(text), fingerprint(edited)
        out.append((docs[k][0], own, changed, likeness(own, changed), likeness(own, fingerprint(following))))
    return out
