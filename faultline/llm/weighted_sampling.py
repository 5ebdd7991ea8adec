"""Consistent weighted sampling (numpy).

For every sample k a term of weight w has gamma-distributed r, c and a uniform
b, drawn from the term and k alone; with t = floor(ln w / r + b) its value is
ln a = ln c - r (t - b + 1), and the sample is the term (and t) of the least
value.  Two weighted sets have a sample in common with probability
sum(min weights) / sum(max weights), the generalised Jaccard similarity.

The draws of (term, k) are a 64-bit mix of the term's hash and k, and further
mixes of that one.  They give three exponential E, F, G: s = ln((E + F) / E) is
exponential as well and independent of c = E + F, so that r = s + G and
b = G / r have the wanted distributions.  Then t = floor((ln w + G) / r) and
a = E exp(-r t), which at weight 1 is E alone: there the least mix decides.
"""

from __future__ import annotations

import numpy as np

from faultline.llm import shingles
from faultline.llm.bpe import ODD, mix

MOST = 1024                       # samples of one fingerprint, at most
BLOCK = 1 << 17                   # (term, sample) values worked on at a time
NAME = np.uint64(0xFFFF)          # bits of a value that name its sample; the others order it
STEP = np.arange(3, dtype=np.uint64) * ODD


def _unit(x: np.ndarray) -> np.ndarray:
    """Within (0, 1), growing with x."""
    return np.minimum((x.astype(np.float64) + 0.5) * 2.0 ** -64, 1 - 2.0 ** -53)


def _weighted(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Values of terms of weight ``w`` whose values at weight 1 are ``x``."""
    e = -np.log1p(-_unit(x))
    f, g = (-np.log(_unit(mix(x + STEP[i]))) for i in (1, 2))
    r = np.log1p(f / e) + g
    t = np.floor((np.log(w)[:, None] + g) / r)
    order = (-np.expm1(-e * np.exp(-r * t)) * 2.0 ** 64).astype(np.uint64)
    named = (order & ~NAME) | (mix(x + ODD * (t.astype(np.uint64) + np.uint64(2))) >> np.uint64(48))
    return np.where(t > 0, named, x)


def samples(own: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int = 128) -> np.ndarray:
    """n x k sample names (uint16, 0 for a set without terms) of sets given as (set, term hash, weight), in the order of sets."""
    if not 0 < k <= MOST:
        raise ValueError(f"1 to {MOST} samples")
    least = np.full((n, k), ~np.uint64(0))
    salt = mix(np.arange(1, k + 1, dtype=np.uint64) * ODD)
    size = max(1, BLOCK // k)
    for lo in range(0, len(own), size):
        o, w = own[lo:lo + size], weight[lo:lo + size]
        a = mix(term[lo:lo + size, None] + salt)
        more = np.flatnonzero(w > 1)
        if len(more):
            a[more] = _weighted(a[more], w[more])
        edge = np.flatnonzero(np.append(True, o[1:] != o[:-1]))
        sets = o[edge]
        least[sets] = np.minimum(least[sets], np.minimum.reduceat(a, edge, axis=0))
    some = np.zeros((n, 1), bool)
    some[own] = True
    return np.where(some, np.maximum(least & NAME, np.uint64(1)), np.uint64(0)).astype(np.uint16)


def fingerprints(texts: list[str], k: int = 128, size: int = 3) -> np.ndarray:
    """Samples of the multisets of ``size``-word shingles of whole texts."""
    out = [np.zeros((0, k), np.uint16)]
    for lo, hi in shingles.chunks(texts):
        own, h, w = shingles.bags(texts[lo:hi], size)
        out.append(samples(own, h, w, hi - lo, k))
    return np.concatenate(out)
