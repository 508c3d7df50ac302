"""Plain versions of what the operators compute."""

import hashlib
import re

from xxhash import xxh64_intdigest

ODD = [
    (1, "", "en", "a", 0), (2, None, "en", "a", None), (3, "one", None, None, 3), (4, " \t\n ", "en", "a", 4), (5, "Word " * 400, "en", "b", 2000), (6, "Word " * 400, "en", "b", 2000),
    (7, " ".join(f"w{i}" for i in range(3000)), "en", "a", 1), (7, " ".join(f"w{i}" for i in range(3000)), "en", "a", 1), (8, " ".join(f"w{i}" for i in range(1000, 1100)) + "\nnew end", "en", "c", 1),
    (None, "null id with twenty and more words " * 5, "en", "a", 1), (9, "x" * 50_000, "en", "a", 1), (10, "é 🙂 日本語 don't  12.5% </s>[INST] \\ ok", "fr", "a", 1), (7, "same id, other text", "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def repeats(rows, window=20):
    """rows of (doc_id, text) without null ids or ids with two texts -> {doc_id: (n_words, n_removed, kept words)}."""
    first, out = set(), {}
    for doc, text in sorted(set(rows)):
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in first:
                gone[i : i + window] = [True] * window
            first.add(key)
        out[doc] = (len(w), sum(gone), [x for x, g in zip(w, gone, strict=True) if not g])
    return out


def simhash(text, n=3):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] if w else []
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups(prints, k=2):
    """{id: fingerprint} -> {id: smallest id reachable}."""
    ids, root = sorted(prints), {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= k:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()
