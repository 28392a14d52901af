"""Plain versions of the operators' contracts, one text at a time."""
import hashlib
import math
import re
from collections import Counter

import numpy as np
import xxhash
import zlib

LOW = {c: c + 32 for c in range(65, 91)}
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(x):
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def fold(doc_id, n=5):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii(text):
    out = []
    for kind, p in PII.items():
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) \
                    or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


def redacted(text, spans):
    """The text with its (start, end, kind) spans replaced; overlapping ones are one, named after the first."""
    at, out = 0, ""
    for a, b, k in sorted(spans, key=lambda x: (x[0], x[1], list(PII).index(x[2]))):
        if a >= at:
            out += text[at:a] + f"[{k.upper()}]"
        at = max(at, b)
    return out + text[at:]


def quality(text):
    text = text or ""
    w = SPACE_WORD.findall(text)
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def fingerprint(text):
    w = SPACE_WORD.findall((text or "").translate(LOW))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, radius=3):
    """A number per row that names its component."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    f = np.array(fps, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= radius):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def least(ids, group):
    """Smallest id of each group; None only where there is no other."""
    out = {}
    for d, g in zip(ids, group):
        known = [x for x in (d, out.get(g)) if x is not None]
        out[g] = min(known) if known else None
    return out


def components(ids, fps, radius=3):
    """Smallest id of each row's component."""
    group = groups(fps, radius)
    first = least(ids, group)
    return [first[g] for g in group]


def windows(items, width=10):
    out = {}
    for item, text in items:
        w = BENCH_WORD.findall((text or "").translate(LOW))
        for i in range(max(1, len(w) - width + 1)) if w else ():
            out.setdefault(tuple(w[i:i + width]), set()).add(str(item))
    return out


def hits(text, found):
    w = BENCH_WORD.findall((text or "").translate(LOW))
    hit, items = set(), set()
    for n in {len(k) for k in found}:
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in found:
                hit.update(range(i, i + n))
                items |= found[tuple(w[i:i + n])]
    return len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)


def lm(rows, held=1):
    """Per row (held_out, n_tokens, n_known, train_tokens, base_score, exact interpolated score)."""
    words = [[*SPACE_WORD.findall((t or "").translate(LOW)), None] for _, t in rows]
    train = [w for (d, _), w in zip(rows, words) if fold(d) != held]
    one = Counter(x for w in train for x in w)
    two = Counter(p for w in train for p in zip([0, *w], w))
    n, z = sum(one.values()), sum(one.values()) + 0.5 * (len(one) + 1)
    out = []
    for (d, _), w in zip(rows, words):
        exact = 0.0
        for a, b in zip([0, *w], w):
            before = one[None] if a == 0 else one[a]
            share = 0.4 if before else 0.0
            exact += math.log10(share * two[a, b] / max(before, 1) + (1 - share) * (one[b] + 0.5) / z)
        out.append((fold(d) == held, len(w), sum(one[x] > 0 for x in w), n, sum(math.log10((one[x] + 0.5) / z) for x in w), exact))
    return out
