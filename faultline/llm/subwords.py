"""Character n-grams of words, for whole batches of texts, as numbered buckets."""

from __future__ import annotations

import numpy as np

SIZES = (3, 4, 5)                 # with the word's two borders
BITS = 18
CHUNK = 1 << 19                   # code points worked on at a time
_table: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Lower-cased code point of each letter or digit, 0 of anything else."""
    if not _table:
        t = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalnum():
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _table.append(t)
    return _table[0]


def chunks(texts: list[str], size: int = CHUNK):
    """Ranges of texts with about ``size`` code points; a longer text stands alone."""
    lo = total = 0
    for i, t in enumerate(texts):
        if i > lo and total + len(t) > size:
            yield lo, i
            lo, total = i, 0
        total += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def grams(texts: list[str]):
    """For each n: (buckets, valid), by the place where an n-gram starts; and where texts start.

    Every text is preceded by a border, at which its first n-grams start.
    """
    joined = "\n" + "\n".join(texts) + "\n\n\n\n"
    code = letters()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    n = len(code) - max(SIZES)
    begin = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    h, ok, out = code.copy(), None, []
    for k in range(2, max(SIZES) + 1):
        h[:-k + 1] = h[:-k + 1] * np.uint32(0x01000193) + code[k - 1:]
        if k > 2:
            inner = code[k - 2:][:n] != 0
            ok = inner if ok is None else ok & inner
        if k in SIZES:
            x = (h[:n] ^ (h[:n] >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * k)
            out.append((((x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)) >> np.uint32(32 - BITS), ok))
    return out, begin


def totals(texts: list[str], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the weights of each text's n-grams, and their number."""
    s, m = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for lo, hi in chunks(texts):
        out, begin = grams(texts[lo:hi])
        if not len(out[0][0]):
            continue
        begin = np.minimum(begin, len(out[0][0]) - 1)
        for b, ok in out:
            s[lo:hi] += np.add.reduceat(np.where(ok, weight[b], 0).astype(np.float64), begin)
            m[lo:hi] += np.add.reduceat(ok.astype(np.int64), begin)
    empty = np.array([not t for t in texts], bool)
    s[empty], m[empty] = 0, 0
    return s, m


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and how often each occurs."""
    found = []
    for b, ok in grams([text])[0]:
        found.append(b[ok])
    return np.unique(np.concatenate(found), return_counts=True)
