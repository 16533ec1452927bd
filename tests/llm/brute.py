"""Plain versions of the operators: one document, one window, one pair at a time."""

import hashlib
import re

import xxhash

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def simhash(text):
    words = split_words((text or "").translate(UPPER))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(fps):
    """``fps``: {doc_id: fingerprint}; the smallest doc_id within reach over links of two bits."""
    root = {d: d for d in fps}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    items = sorted(fps.items())
    for i, (a, x) in enumerate(items):
        for b, y in items[i + 1:]:
            if (x ^ y).bit_count() <= 2:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {d: find(d) for d in fps}


def repeated_words(docs, size=13):
    """``docs``: (doc_id, text); per document its words and whether each is removed."""
    first = {}
    for d, text in docs:
        words = split_words(text)
        for i in range(len(words) - size + 1):
            w = tuple(words[i:i + size])
            if d is not None and (w not in first or d < first[w]):
                first[w] = d
    out = []
    for d, text in docs:
        words = split_words(text)
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            if d is not None and first[tuple(words[i:i + size])] < d:
                gone[i:i + size] = [True] * size
        out.append((d, words, gone))
    return out


def benchmark_hits(docs, items, size=10):
    """Per document: words, hit flags, ids of the items found."""
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: pattern.findall((t or "").translate(UPPER))
    wanted = {}
    for item, text in items:
        words = cut(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            wanted.setdefault(tuple(words[i:i + size]), set()).add(str(item))
    sizes = {len(w) for w in wanted}
    out = []
    for d, text in docs:
        words = cut(text)
        hit, found = [False] * len(words), set()
        for k in sizes:
            for i in range(len(words) - k + 1):
                own = wanted.get(tuple(words[i:i + k]))
                if own:
                    hit[i:i + k] = [True] * k
                    found |= own
        out.append((d, words, hit, found))
    return out


def base_spans(text):
    """Base kinds of personal data, as kind -> list of (start, end)."""
    text = text or ""
    out = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]}
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
                 if all(int(p) <= 255 for p in m.group().split("."))]

    def card(s):
        digits = [int(c) for c in s if c.isdigit()]
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0

    out["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if card(m.group())]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
                    if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out
