"""BagMinHash signatures of weighted sets.

Each element has, over its weight axis, a Poisson process of points (time,
register).  A set of weights sees the points that lie below its weights, and
its signature is, for each register, the earliest time seen; two signatures
agree in a register with probability sum(min weights) / sum(max weights).

The axis is discretised in units and cut into the blocks [0,1), [1,2), [2,4),
[4,8), ...; the process of a block is split in two halves, again and again, only
as far as points can still matter, so an element of weight w costs about
log(w) steps, not w.  A point's time and place follow from the element and the
place in this tree alone, so all sets see the same points.
"""

from __future__ import annotations

import numpy as np

from faultline.llm.bpe import ODD, mix

STEP = 8                          # points that a unit cell adds at a time, after the first


def _draw(seed: np.ndarray, salt: int) -> np.ndarray:
    return mix(seed + np.uint64((salt * int(ODD)) & 0xFFFFFFFFFFFFFFFF))


def _exp(seed: np.ndarray, salt: int) -> np.ndarray:
    """Exponentially distributed numbers from seeds."""
    return -np.log(((_draw(seed, salt) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53)


def _register(seed: np.ndarray, m: int) -> np.ndarray:
    return ((_draw(seed, 2) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)


def signatures(own: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int = 128) -> np.ndarray:
    """Earliest times, n x m, of sets 0..n-1 given as (set, element hash, positive integer weight); inf if a set is empty."""
    reg = np.full(n * m, np.inf)
    top = np.frexp(weight.astype(np.float64))[1]                  # 2**(top-1) <= weight < 2**top
    count = top + (weight != np.left_shift(1, top - 1))           # whole blocks, and one begun
    src = np.repeat(np.arange(len(own)), count)
    j = np.arange(len(src)) - np.repeat(np.cumsum(count) - count, count)
    lo = np.where(j == 0, 0, np.left_shift(1, np.maximum(j - 1, 0)))
    size = np.maximum(lo, 1)
    node = mix(element[src] + (j + 1).astype(np.uint64) * ODD)
    set_, w = own[src], weight[src]
    t, r, eaten = _exp(node, 1) / size, _register(node, m), np.zeros(len(src), bool)
    while len(set_):
        whole = lo + size <= w
        hit = whole & ~eaten
        np.minimum.at(reg, set_[hit] * m + r[hit], t[hit])
        limit = reg.reshape(n, m).max(1)
        live = t < limit[set_]
        unit = live & (size == 1)
        wide = live & (size > 1)
        # A unit cell goes on: its next points, one after another.
        u, un, ut = set_[unit], node[unit], t[unit]
        nxt = [(u, un, lo[unit], size[unit], w[unit], ut, r[unit], eaten[unit])][:0]
        for k in range(STEP):
            ut = ut + _exp(un, 3)
            un = _draw(un, 4)
            ur = _register(un, m)
            if k < STEP - 1:
                near = ut < limit[u]
                np.minimum.at(reg, u[near] * m + ur[near], ut[near])
        nxt.append((u, un, lo[unit], size[unit], w[unit], ut, ur, np.zeros(len(u), bool)))
        # A wider node is halved: one half has the point, the other one its own first.
        s, half = node[wide], size[wide] // 2
        side = (_draw(s, 5) >> np.uint64(63)).astype(np.int64)
        for c in (0, 1):
            child = _draw(s, 6 + c)
            has = side == c
            nxt.append((set_[wide], child, lo[wide] + c * half, half, w[wide],
                        np.where(has, t[wide], t[wide] + _exp(child, 1) / half),
                        np.where(has, r[wide], _register(child, m)), has & (eaten | whole)[wide]))
        set_, node, lo, size, w, t, r, eaten = (np.concatenate(x) for x in zip(*nxt, strict=True))
        limit = reg.reshape(n, m).max(1)
        keep = (lo < w) & (t < limit[set_])
        set_, node, lo, size, w, t, r, eaten = (x[keep] for x in (set_, node, lo, size, w, t, r, eaten))
    return reg.reshape(n, m)


def packed(times: np.ndarray) -> np.ndarray:
    """32 bits of each register, enough to compare two signatures."""
    return (mix(times.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)
