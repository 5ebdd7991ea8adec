"""Words and word shingles of whole batches of texts, as 64-bit hashes (numpy)."""

from __future__ import annotations

import numpy as np

from faultline.llm.bpe import ODD, mix, powers

CHUNK = 1 << 19                   # bytes worked on at a time; a longer text stands alone
_kept: dict[str, np.ndarray] = {}


def _tables(n: int):
    if "fold" not in _kept:
        fold = np.zeros(256, np.uint8)                # 0: between words
        for b in range(256):
            if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80:
                fold[b] = b
            elif 0x41 <= b <= 0x5A:
                fold[b] = b + 32
        _kept["fold"] = fold
        _kept["salt"] = mix(np.arange(1, 257, dtype=np.uint64) * ODD)
    if len(_kept.get("pow", ())) < n:
        _kept["pow"], _kept["inv"] = powers(n)
    return _kept["fold"], _kept["salt"], _kept["pow"], _kept["inv"]


def chunks(texts: list[str], size: int = CHUNK):
    lo = total = 0
    for i, t in enumerate(texts):
        if i > lo and total + len(t) > size:
            yield lo, i
            lo, total = i, 0
        total += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every word.

    Words are runs of ASCII letters and digits and of all other non-ASCII
    characters, with A-Z lower-cased.
    """
    raw = [t.encode("utf-8", "replace") for t in texts]
    fold = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n", np.uint8)
    table, salt, pw, inv = _tables(len(fold) + 1)
    fold = table[fold]
    inside = fold != 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    s, e = edge[::2], edge[1::2]
    h = np.zeros(len(fold) + 1, np.uint64)
    np.cumsum(salt[fold] * pw[:len(fold)], out=h[1:])
    begin = np.cumsum([1] + [len(r) + 1 for r in raw[:-1]])
    owner = np.searchsorted(begin, s, "right") - 1
    return owner, mix((h[e] - h[s]) * inv[s] + (e - s).astype(np.uint64) * ODD)


def shingles(texts: list[str], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of every run of ``size`` words; a text of fewer words gives one of all it has."""
    owner, w = words(texts)
    n = len(w)
    count = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(count) - count
    k = np.minimum(count, size)
    total = count - k + (count > 0)
    own = np.repeat(np.arange(len(texts)), total)
    at = np.arange(len(own)) - np.repeat(np.cumsum(total) - total, total) + first[own]
    h = np.zeros(len(own), np.uint64)
    for j in range(size):
        there = j < k[own]
        h = np.where(there, mix(h + w[np.minimum(at + j, max(n - 1, 0))] * ODD), h) if n else h
    return own, h


def bags(texts: list[str], size: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle, how often) of each distinct shingle of each text, by text."""
    own, h = shingles(texts, size)
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (own[1:] != own[:-1]))) if len(h) else np.empty(0, np.int64)
    return own[new], h[new], np.diff(np.append(new, len(h)))


def overlap(a: list[str], b: list[str], size: int = 5) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle multisets of a[i] and b[i]; 0 where both have no word."""
    n = len(a)
    out = np.zeros(n)
    for lo, hi in chunks([x if len(x) > len(y) else y for x, y in zip(a, b, strict=True)], CHUNK // 2):
        m = hi - lo
        own, h, w = bags(a[lo:hi] + b[lo:hi], size)
        left = own < m
        _, key = np.unique(mix(h + (own % m).astype(np.uint64) * ODD), return_inverse=True)
        both = np.zeros((2, key.max() + 1 if len(key) else 0), np.int64)
        both[0, key[left]] = w[left]
        both[1, key[~left]] = w[~left]
        pair = np.zeros(both.shape[1], np.int64)
        pair[key] = own % m
        low, high = np.bincount(pair, both.min(0), m), np.bincount(pair, both.max(0), m)
        out[lo:hi] = low / np.maximum(high, 1)
    return out
