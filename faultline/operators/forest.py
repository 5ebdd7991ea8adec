"""Decision trees of many models grown together (L3, L4), and scored from packed arrays.

Rows are keyed by (model, node).  A round of ``grow`` takes all open nodes of all
models at once: a node of at most ``SMALL`` rows goes to one task, which grows the rest
of its subtree (``grow_batch``); a larger one is reduced to a histogram in every task that holds
some of its rows, the histograms are added up, and its split sends its rows to
two nodes of the next round.  Both use ``best_split`` on the same bins, so where a
node is grown does not change the tree.  Trees are a long table of nodes.

Features are cut into at most 256 bins at quantiles of their distinct values (every
value, where there are no more); NULL and NaN are in the lowest bin.  The split of a node is
that of the largest decrease of the weighted Gini impurity among ``mtry`` of the features
that vary in it, drawn by a hash of the node and the feature; ties go to the first
feature and the lowest cut.  Nodes are named by a hash of their path, so any depth is possible.

Boosting runs in lockstep: one ``grow`` per round for all models, then one grouped pass
for their errors and weights.  ``votes="discrete"`` is SAMME, ``votes="probability"`` its
variant with class log-probabilities (Zhu et al. 2009).
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.operators import sampling
from faultline.session import cut_lineage

SMALL = 1 << 20                   # rows of a bag or node that one task grows on its own
NEAR = 512 << 20                  # bytes of binned training rows that a task holds to draw its bags from
CHUNK = 1 << 19                   # rows times features that are sorted at a time
DENSE = 1 << 14                    # rows times features from which a node's features of many bins are counted into bins instead of sorted
BINS = 256
FEW = 64                          # bins up to which a feature is always counted
SLICE = 1 << 16                   # rows times columns that are counted at a time
KEPT = 2048                       # rows of a node whose counts are kept for its children
TOGETHER = 1 << 17                # rows of trees that a task grows together
TIE = 1e-9                        # shares this close are equal
PACK = 48 << 20                   # bytes of packed trees that are broadcast at a time
SCORED = 1 << 16                  # rows that meet a piece of trees at a time
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


@dataclass(frozen=True)
class Model:
    """One model of a plan: the bag it learns from, and how its trees grow.

    ``depth`` None is without limit.  ``mtry`` features are looked at in a node, of all but ``without``.
    ``weights`` are the classes' in the trees' impurity; they stay out of the boosting error.
    ``bootstrap`` is the seed with which the bag's rows are drawn again (``sampling.exact_bootstrap``), or None.
    """

    model: int
    bag: int
    ensemble: int = 0
    seed: int = 0
    depth: int | None = None
    mtry: int = 1
    min_leaf: int = 1
    min_split: int = 2
    weights: tuple = ()
    without: int | None = None
    rounds: int = 1
    bootstrap: int | None = None


def mixed(x: np.ndarray, y) -> np.ndarray:
    """A 64-bit hash of two numbers each."""
    with np.errstate(over="ignore"):
        z = (np.asarray(x).astype(np.uint64) * np.uint64(MIX[0])) ^ (np.asarray(y).astype(np.uint64) + np.uint64(MIX[0]))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(MIX[1])
        z = (z ^ (z >> np.uint64(27))) * np.uint64(MIX[2])
        return z ^ (z >> np.uint64(31))


def root(seed: int) -> int:
    return int(mixed(np.uint64(seed), np.uint64(1)).astype(np.int64))


def child(node, right) -> np.ndarray:
    return mixed(np.asarray(node, np.int64).view(np.uint64) if np.ndim(node) else np.int64(node).astype(np.uint64), np.asarray(right) + 2).astype(np.int64)


def mtry_of(max_features, n: int) -> int:
    """Features per node: a share, "sqrt", "all" or None, or a number."""
    if max_features in (None, "all"):
        return n
    if max_features == "sqrt":
        return max(1, int(n ** 0.5))
    x = float(max_features)
    return max(1, int(x * n)) if x <= 1 else min(n, int(x))


# ---- bins ----------------------------------------------------------------------

def fit_bins(df: DataFrame, features: list[str]) -> list[np.ndarray]:
    """Cut values per feature, rising; a value is in the bin of the number of cuts below it.

    One pass: the distinct values of each feature, then their quantiles (at most 255 numbers per feature).
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in features]).unpivot([], list(features), "c", "v")
    values = long.where("v IS NOT NULL AND NOT isnan(v)").select("c", "v").distinct()
    probs = [(i + 1) / BINS for i in range(BINS)]
    rows = values.groupBy("c").agg(F.percentile_approx("v", probs, 100_000).alias("q"), F.max("v").alias("top")).collect()
    found = {r.c: np.array(sorted({q for q in r.q if q < r.top}), float) for r in rows}
    return [found.get(c, np.empty(0)) for c in features]


def binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(values.shape, np.uint8)
    for f, c in enumerate(cuts):
        v = values[:, f]
        out[:, f] = np.where(np.isnan(v), 0, np.searchsorted(c, v, "left"))
    return out


def feature_array(features: list[str]):
    nan = F.lit(float("nan"))
    return F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), nan) for c in features])


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if len(column) else np.empty((0, width))


def bin_rows(rows: DataFrame, keep: list[str], features: list[str], cuts: list[np.ndarray]) -> DataFrame:
    """``keep`` and ``x``, a byte per feature."""
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("x", T.BinaryType())])
    width = len(features)

    def work(batches):
        import pyarrow as pa
        for b in batches:
            x = binned(_matrix(b.column(b.num_columns - 1), width), cuts)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([r.tobytes() for r in x], pa.binary())], names=schema.names)

    return rows.select(*keep, feature_array(features).alias("v")).mapInArrow(work, schema)


# ---- splits ----------------------------------------------------------------------

class Bins:
    """Where each feature's bins lie in one flat histogram: features of more than two bins in rows of one width, then the others in pairs."""

    def __init__(self, cuts: list[np.ndarray]):
        self.size = size = np.array([len(c) + 1 for c in cuts], np.int64)
        wide = size > 2
        self.rows, self.width, self.pairs = int(wide.sum()), int(size.max(initial=1)), int((~wide).sum())
        self.start = np.where(wide, (np.cumsum(wide) - 1) * self.width, self.rows * self.width + (np.cumsum(~wide) - 1) * 2)
        self.total = self.rows * self.width + self.pairs * 2
        of = np.empty(self.total, np.int64)
        for f, (at, n) in enumerate(zip(self.start, np.where(wide, self.width, 2), strict=True)):
            of[at:at + n] = f
        self.feature = of
        self.bin = np.arange(self.total) - self.start[of]
        self.order = of * BINS + self.bin
        self.n = len(cuts)

    def sides(self, hist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the bins before each bin of a feature, and of it and those after it; no sum is a difference."""
        left, right = np.zeros_like(hist), np.empty_like(hist)
        for lo, n, width in ((0, self.rows, self.width), (self.rows * self.width, self.pairs, 2)):
            own = slice(lo, lo + n * width)
            h = hist[:, own].reshape(len(hist), n, width)
            before = np.zeros_like(h)
            np.cumsum(h[..., :-1], -1, out=before[..., 1:])
            left[:, own] = before.reshape(len(hist), -1)
            right[:, own] = np.cumsum(h[..., ::-1], -1)[..., ::-1].reshape(len(hist), -1)
        return left, right

    def histogram(self, keys: np.ndarray, label: np.ndarray, weight: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
        """Counts, then weights by class, per bin; ``keys`` are ``start + bin`` per row and feature."""
        flat, width = keys.ravel(), keys.shape[1]
        out = [np.bincount(flat, np.repeat(copies, width), self.total)]
        for c in range(k):
            own = label == c
            out.append(np.bincount(keys[own].ravel(), np.repeat(weight[own], width), self.total) if own.any() else np.zeros(self.total))
        return np.stack(out)


def best_split(hist: np.ndarray, total: np.ndarray, bins: Bins, node: int, m: Model) -> tuple[int, int] | None:
    """(feature, bin) such that bins from it on go right, or None for a leaf; ``total``: count and weights of the node."""
    if total[0] < max(m.min_split, 2) or (total[1:] > 0).sum() < 2:
        return None
    left, right = bins.sides(hist)
    ok = (bins.bin > 0) & (hist[0] > 0) & (left[0] > 0)
    if m.without is not None:
        ok &= bins.feature != m.without
    at = np.flatnonzero(ok)
    vary = np.unique(bins.feature[at])
    if not len(vary):
        return None
    if len(vary) > m.mtry:
        drawn = np.zeros(bins.n, bool)
        drawn[vary[np.argsort(mixed(np.full(len(vary), np.int64(node).astype(np.uint64)), vary + 7), kind="stable")[:m.mtry]]] = True
        at = at[drawn[bins.feature[at]]]
    at = at[(left[0, at] >= m.min_leaf) & (right[0, at] >= m.min_leaf)]
    if not len(at):
        return None
    a, b = left[1:, at], right[1:, at]
    gain = (a * a).sum(0) / np.maximum(a.sum(0), 1e-300) + (b * b).sum(0) / np.maximum(b.sum(0), 1e-300)
    top = at[gain >= gain.max() * (1 - 1e-9)]
    t = top[bins.order[top].argmin()]
    return int(bins.feature[t]), int(bins.bin[t])


def _class_rates(label: np.ndarray, weight: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray | None:
    """The weight of one copy of a row of each class, or None where rows of a class differ in it (as boosted ones do)."""
    rates = np.zeros(k)
    for c in range(k):
        own = label == c
        if own.any():
            rates[c] = weight[own][0] / copies[own][0]
    return rates if np.array_equal(weight, copies * rates[label]) else None


class Layout:
    """Binned rows as few columns: a feature of more than two bins has its own, and features of two bins that no row holds together share one.

    ``together`` counts the rows that hold two such features both (``held_together``); without it each has its own column.
    Feature ``f`` is in column ``col[f]``: as its bin where ``val[f]`` is 0, else it is in its upper bin where the column is ``val[f]``.
    Columns of at most ``FEW`` bins come first (features', then shared ones), wide ones last; ``off`` is where a column's bins start.
    """

    def __init__(self, bins: Bins, together: np.ndarray | None = None):
        self.n, self.two = bins.n, np.flatnonzero(bins.size <= 2)
        more = np.flatnonzero(bins.size > 2)
        few, wide = more[bins.size[more] <= FEW], more[bins.size[more] > FEW]
        shared: list[list[int]] = []
        busy = np.zeros((0, len(self.two)), np.int64)
        for i in range(len(self.two)):
            free = [] if together is None else [j for j in range(len(shared)) if len(shared[j]) < BINS - 1 and not busy[j, i]]
            if free:
                shared[free[0]].append(i)
                busy[free[0]] += together[i]
            else:
                shared.append([i])
                busy = np.vstack([busy, together[i] if together is not None else np.ones(len(self.two), np.int64)])
        self.col, self.val = np.zeros(bins.n, np.int64), np.zeros(bins.n, np.int64)
        self.few, self.wide, self.shared = few, wide, [self.two[v] for v in shared]
        for c, f in enumerate(few):
            self.col[f] = c
        for c, own in enumerate(self.shared, len(few)):
            self.col[own], self.val[own] = c, np.arange(1, len(own) + 1)
        self.narrow = len(few) + len(self.shared)
        for c, f in enumerate(wide, self.narrow):
            self.col[f] = c
        width = [*bins.size[few], *(len(v) + 1 for v in self.shared), *bins.size[wide]]
        self.off = np.append(0, np.cumsum(width)).astype(np.int64)
        self.columns = len(width)
        #: Of each bin of a column: the column, its feature (-1: none of those that share it), its bin, whether the column is shared, and both.
        self.cell_column = np.repeat(np.arange(self.columns), width)
        self.cell_shared = (self.cell_column >= len(few)) & (self.cell_column < self.narrow)
        self.cell_bin = np.arange(self.off[-1]) - self.off[self.cell_column]
        self.cell_feature = np.full(self.off[-1], -1)
        for f in (*few, *wide):
            self.cell_feature[self.off[self.col[f]]:self.off[self.col[f] + 1]] = f
        self.cell_feature[self.off[self.col[self.two]] + self.val[self.two]] = self.two
        self.cell_two = self.cell_shared & (self.cell_bin > 0)

    def encode(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.columns), np.uint8)
        for f in (*self.few, *self.wide):
            out[:, self.col[f]] = x[:, f]
        for own in self.shared:
            column = out[:, self.col[own[0]]]
            for f in own:
                column += x[:, f] * np.uint8(self.val[f])
        return out


def held_together(x: np.ndarray, bins: Bins) -> np.ndarray:
    """How many rows hold two features of two bins both in their upper one."""
    two = np.flatnonzero(bins.size <= 2)
    out = np.zeros((len(two), len(two)), np.int64)
    for lo in range(0, len(x), 1 << 14):
        own = x[lo:lo + (1 << 14), two].astype(np.float32)
        out += (own.T @ own).astype(np.int64)                                     # whole numbers below 2 ** 24
    return out


class Coded:
    """Rows in a ``Layout``, as codes."""

    def __init__(self, layout: Layout, codes: np.ndarray):
        self.layout, self.codes = layout, codes

    def right(self, rows: np.ndarray, sizes: np.ndarray, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Do rows, which lie one node of ``sizes`` after the other, go right at the splits of ``f`` before bin ``b``?"""
        lay, val = self.layout, self.layout.val[f]
        low = np.where(val > 0, val, b).astype(np.uint8)
        span = np.where(val > 0, 0, 255 - low).astype(np.uint8)
        code = self.codes.ravel()[rows * lay.columns + np.repeat(lay.col[f], sizes)]
        return code - np.repeat(low, sizes) <= np.repeat(span, sizes)             # a code below ``low`` wraps around


@dataclass
class Job:
    """One tree to grow, or those of models that differ in the feature they go without: places of its rows in a ``Coded``, their labels, weights and copies."""

    models: list[Model]
    row: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    copies: np.ndarray
    node: int
    depth: int = 0


class Batch:
    """Jobs that are grown together, a level of all their trees at a time: their rows one job after the other, and what holds for each job.

    All have ``rates`` (weight per copy and class), which spare the sums of weights, or none has.  ``shared``: jobs are of several models each.
    """

    def __init__(self, rows: Coded, jobs: list[Job], k: int, rates: list[np.ndarray] | None):
        self.rows, self.jobs, self.k, self.layout = rows, jobs, k, rows.layout
        self.row, self.label, self.weight, self.copies = (np.concatenate([getattr(j, c) for j in jobs]) for c in ("row", "label", "weight", "copies"))
        self.once = bool((self.copies == 1).all())
        self.rates = None if rates is None else np.stack(rates)
        first = [j.models[0] for j in jobs]
        self.shared = any(len(j.models) > 1 for j in jobs)
        self.mtry, self.min_leaf, self.min_split = (np.array([getattr(m, c) for m in first], np.int64) for c in ("mtry", "min_leaf", "min_split"))
        self.depth = np.array([np.iinfo(np.int64).max if m.depth is None else m.depth for m in first])
        self.without = np.array([[-1 if m.without is None else m.without for m in j.models] + [-1] * (max(len(j.models) for j in jobs) - len(j.models))
                                 for j in jobs])


def _gain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * a).sum(0) / np.maximum(a.sum(0), 1e-300) + (b * b).sum(0) / np.maximum(b.sum(0), 1e-300)


def _drawn(vary: np.ndarray, node: np.ndarray, mtry: np.ndarray, without: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The features (of those that vary) that are looked at in each node, and the next one in the draw (-1: none)."""
    if without is not None:
        own = np.flatnonzero(without >= 0)
        vary[own, without[own]] = False
    more = np.full(len(vary), -1)
    many = np.flatnonzero(vary.sum(1) > mtry)
    if len(many):
        h = mixed(node[many].view(np.uint64)[:, None], np.arange(vary.shape[1])[None, :] + 7)
        h[~vary[many]] = np.iinfo(np.uint64).max
        place = np.argsort(h, 1, kind="stable")
        drawn, n = np.zeros(h.shape, bool), mtry[many]
        np.put_along_axis(drawn, place, np.arange(h.shape[1])[None, :] < n[:, None], 1)
        more[many] = place[np.arange(len(many)), n]
        vary[many] &= drawn
    return vary, more


def _count(batch: Batch, own: np.ndarray, of: np.ndarray, j: int, columns: int, values: np.ndarray | None) -> np.ndarray:
    """Sums of ``values`` (None: rows) per node, class and bin of the first ``columns``; nodes ``of`` of the places ``own`` rise from 0 to below ``j``."""
    lay, k, cells = batch.layout, batch.k, int(batch.layout.off[columns])
    step = max(1, min(CHUNK, SLICE) // max(1, columns))
    out, off = np.zeros((j, k * cells)), lay.off[:columns]
    codes, keys = np.empty((min(step, len(own)), lay.columns), np.uint8), np.empty(min(step, len(own)) * columns, np.int64)
    for lo in range(0, len(own), step):
        hi = min(lo + step, len(own))
        first, last, here = int(of[lo]), int(of[hi - 1]), own[lo:hi]
        np.take(batch.rows.codes, batch.row[here], 0, out=codes[:hi - lo], mode="clip")
        key = keys[:(hi - lo) * columns]
        two = key.reshape(hi - lo, columns)
        np.add(codes[:hi - lo, :columns], off, out=two)
        two += (((of[lo:hi] - first) * k + batch.label[here]) * cells)[:, None]
        w = None if values is None else np.repeat(values[lo:hi], columns)
        out[first:last + 1] += np.bincount(key, w, (last - first + 1) * k * cells).reshape(-1, k * cells)
    return out.reshape(j, k, cells)


def _choose(batch: Batch, hist: np.ndarray, held: np.ndarray, of: np.ndarray | None, own: np.ndarray | None, node: np.ndarray, job: np.ndarray,
            scale: np.ndarray, big: bool, found: list, which: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Candidates for the splits of nodes from ``hist`` (whole numbers per node, class and bin, which ``scale`` turns into weights) and the
    counts ``held``, added to ``found``; of all columns but the wide ones, unless ``big``.  Gives the drawn features (and in ``more`` the next ones).

    Only bins that hold rows are looked at, as one list over all nodes and columns.
    """
    lay, (j, _, cells) = batch.layout, hist.shape
    count = held.sum(1)
    at, cell = np.divmod(np.flatnonzero(count), cells)
    c, column = count[at, cell], lay.cell_column[cell]
    edge = np.flatnonzero(np.append(True, (column[1:] != column[:-1]) | (at[1:] != at[:-1])))
    length = np.diff(np.append(edge, len(at)))
    start = np.repeat(edge, length)
    feature, two = lay.cell_feature[cell], lay.cell_two[cell]
    run = np.cumsum(c)
    n = (run[edge + length - 1] - run[edge] + c[edge])[np.searchsorted(at[edge], np.arange(j))]
    low = np.where(two, n[at] - c, run - c - (run - c)[start])                    # rows that go left
    vary = np.zeros((j, lay.n), bool)
    own_two = two & (c < n[at])
    vary[at[own_two], feature[own_two]] = True
    whole = ~lay.cell_shared[cell[edge]] & (length > 1)
    vary[at[edge[whole]], feature[edge[whole]]] = True
    if not big and len(lay.wide):
        codes, begin = batch.rows.codes[batch.row[own], lay.narrow:], np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        vary[:, lay.wide] = np.maximum.reduceat(codes, begin) > np.minimum.reduceat(codes, begin)
    drawn, more[which] = _drawn(vary, node, batch.mtry[job], None if batch.shared else batch.without[job, 0])
    look = drawn
    if batch.shared:
        look = drawn.copy()
        extra = np.flatnonzero(more[which] >= 0)
        look[extra, more[which][extra]] = True
    least = np.maximum(batch.min_leaf[job], 1)[at]
    ok = np.flatnonzero((feature >= 0) & look[at, feature] & (low >= least) & (n[at] - low >= least))
    if len(ok):
        h = hist[at, :, cell].T.astype(np.int64)                                  # exact, as are the sums
        before = np.cumsum(h, 1) - h
        at_ok, is_two = at[ok], two[ok]
        total = hist[:, :, :lay.off[1]].sum(2).astype(np.int64).T[:, at_ok]
        left = np.where(is_two, total - h[:, ok], before[:, ok] - before[:, start[ok]])
        rate = scale.T[:, at_ok]
        _add(batch, found, which, at_ok, feature[ok], np.where(is_two, 1, lay.cell_bin[cell[ok]]), _gain(left * rate, (total - left) * rate))
    return drawn


def _add(batch: Batch, found: list, which: np.ndarray, at: np.ndarray, feature: np.ndarray, bin_: np.ndarray, gain: np.ndarray):
    """Keeps what is within 1e-9 of its node's largest gain (of its node and feature, where models go without different ones); nodes rise."""
    key = at * batch.layout.n + feature if batch.shared else at
    top = _top(key, gain)
    found.append((which[at[top]], feature[top], bin_[top], gain[top]))


def _top(key: np.ndarray, gain: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    best = np.repeat(np.maximum.reduceat(gain, edge), np.diff(np.append(edge, len(key))))
    return np.flatnonzero(gain >= best * (1 - 1e-9))


def _counted(batch: Batch, own: np.ndarray, node: np.ndarray, job: np.ndarray, sizes: np.ndarray, sums: np.ndarray, big: bool, found: list,
             which: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Splits of nodes, whose places ``own`` lie one node after the other, from counts per bin and class of every column (of all but
    the wide ones, unless ``big``).  Counts and weights are whole numbers of doubles, so sums are exact in any order."""
    lay, drawn = batch.layout, np.zeros((len(sizes), batch.layout.n), bool)
    columns = lay.columns if big else max(1, lay.narrow)
    most = max(1, CHUNK // max(1, int(lay.off[columns]) * batch.k))
    end, unit = np.append(0, np.cumsum(sizes)), 2.0 ** 44
    for at in range(0, len(sizes), most):
        to = min(at + most, len(sizes))
        here = own[end[at]:end[to]]
        of = np.repeat(np.arange(to - at), sizes[at:to])
        held = hist = _count(batch, here, of, to - at, columns, None if batch.once else batch.copies[here])
        if batch.rates is not None:
            scale = batch.rates[job[at:to]]
        else:
            share = sums[at:to].sum(1) / unit
            hist, scale = _count(batch, here, of, to - at, columns, np.rint(batch.weight[here] / share[of])), np.repeat(share[:, None], batch.k, 1)
        drawn[at:to] = _choose(batch, hist, held, of, here, node[at:to], job[at:to], scale, big, found, which[at:to], more)
    return drawn


def _sorted(batch: Batch, own: np.ndarray, job: np.ndarray, sizes: np.ndarray, sums: np.ndarray, look: np.ndarray, found: list, which: np.ndarray):
    """Splits of nodes by wide features: the rows of each node and feature of ``look`` are sorted by bin, at most ``CHUNK`` of them at a time (or one
    node and feature); weights are whole multiples of a tiny share of their node's, so that running sums are exact."""
    lay, k = batch.layout, batch.k
    start = np.cumsum(sizes) - sizes
    of, i = np.nonzero(look[:, lay.wide])
    if not len(of):
        return
    feature, col = lay.wide[i], lay.col[lay.wide[i]]
    label, copies = batch.label[own], batch.copies[own]
    n_rows = sizes[of]
    end = np.cumsum(n_rows)
    parts, at = [], 0
    while at < len(of):
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + CHUNK, "right")))
        parts.append((at, to))
        at = to
    unit = 2.0 ** (62 - max([to - at for at, to in parts], default=1).bit_length())
    whole = np.rint(batch.weight[own] * np.repeat(unit / sums.sum(1), sizes)).astype(np.int64)
    by_class = [np.where(label == c, whole, 0) for c in range(k)]
    total = np.stack([np.add.reduceat(w, start) for w in by_class])
    held, raw, least = np.add.reduceat(copies, start), sums.sum(1) / unit, batch.min_leaf[job]
    bits = len(own).bit_length()
    codes = batch.rows.codes[batch.row[own]]
    for at, to in parts:
        n = n_rows[at:to]
        first = np.cumsum(n) - n
        seg_of = np.repeat(np.arange(to - at), n)
        place = np.arange(len(seg_of)) - np.repeat(first - start[of[at:to]], n)
        key = (((seg_of << 8) | codes[place, col[at:to][seg_of]]) << bits) | place
        key.sort()
        place, cell = key & ((1 << bits) - 1), key >> bits
        cut = np.flatnonzero((cell[1:] != cell[:-1]) & (seg_of[1:] == seg_of[:-1])) + 1
        if not len(cut):
            continue
        seg = seg_of[cut]
        here = of[at:to][seg]

        def before(values):
            run = np.append(0, np.cumsum(values[place]))
            return run[cut] - run[first[seg]]

        ok = slice(None)
        if least.max() > 1:
            low = before(copies)
            ok = (low >= least[here]) & (held[here] - low >= least[here])
        a = [before(w) for w in by_class]
        b = [t[here] - v for t, v in zip(total, a, strict=True)]
        a, b = np.stack(a)[:, ok].astype(float), np.stack(b)[:, ok].astype(float)
        if a.shape[1]:
            _add(batch, found, which, here[ok], feature[at:to][seg[ok]], cell[cut[ok]] & 255, _gain(a, b) * raw[here[ok]])


def _level_splits(batch: Batch, order: np.ndarray, node: np.ndarray, job: np.ndarray, sizes: np.ndarray, sums: np.ndarray, kept: dict, mask: np.ndarray):
    """``best_split`` of many nodes at once, whose places ``order`` lie one node after the other: arrays (node, feature, bin, models), feature -1 where
    there is none; a node comes once for each split that some of its models (bits of ``mask``) take.

    Rows are counted per node, column, bin and class; columns of many bins are sorted instead in nodes of less than ``DENSE`` rows times
    features.  ``kept`` has the counts of some nodes by their place.
    """
    lay, j = batch.layout, len(sizes)
    found, more, drawn = [], np.full(j, -1), np.zeros((j, lay.n), bool)
    kind = np.where(sizes * np.minimum(batch.mtry[job], lay.n) >= DENSE, 1, 0)
    if kept:
        at = np.array(sorted(kept))
        kind[at] = 2
        most = max(1, CHUNK // (int(lay.off[-1]) * batch.k))
        for lo in range(0, len(at), most):
            own = at[lo:lo + most]
            hist = np.stack([kept[i] for i in own.tolist()])
            drawn[own] = _choose(batch, hist, hist, None, None, node[own], job[own], batch.rates[job[own]], True, found, own, more)
    for big in (1, 0):
        which = np.flatnonzero(kind == big)
        if not len(which):
            continue
        own = order if len(which) == j else order[np.repeat(kind == big, sizes)]
        drawn[which] = _counted(batch, own, node[which], job[which], sizes[which], sums[which], big == 1, found, which, more)
        if not big:
            look = drawn[which]
            if batch.shared:
                extra = np.flatnonzero(more[which] >= 0)
                look[extra, more[which][extra]] = True
            _sorted(batch, own, job[which], sizes[which], sums[which], look, found, which)
    split, split_bin = np.full(j, -1), np.zeros(j, np.int64)
    if not found:
        return np.arange(j), split, split_bin, mask
    here, feat, cell, gain = (np.concatenate(c) for c in zip(*found, strict=True))
    by = np.lexsort((cell, feat, here))
    here, feat, cell, gain = here[by], feat[by], cell[by], gain[by]
    top = _top(here * lay.n + feat if batch.shared else here, gain)
    here, feat, cell, gain = here[top], feat[top], cell[top], gain[top]
    if not batch.shared:
        one = np.flatnonzero(np.append(True, here[1:] != here[:-1]))
        split[here[one]], split_bin[here[one]] = feat[one], cell[one]
        return np.arange(j), split, split_bin, mask
    one = np.flatnonzero(np.append(True, (here[1:] != here[:-1]) | (feat[1:] != feat[:-1])))
    best, bin_of = np.full((j, lay.n), -1.0), np.zeros((j, lay.n), np.int64)
    best[here[one], feat[one]] = np.maximum.reduceat(gain, one)
    bin_of[here[one], feat[one]] = cell[one]
    nodes, codes, bits = [], [], []
    for q in range(batch.without.shape[1]):
        own = np.flatnonzero((mask >> np.uint64(q)) & np.uint64(1))
        g, without = best[own], batch.without[job[own], q]
        place = np.arange(len(own))
        # The next feature of the draw comes in for the one that is left out.
        out = np.flatnonzero((more[own] >= 0) & ~((without >= 0) & drawn[own, without]))
        g[out, more[own][out]] = -1.0
        gone = np.flatnonzero(without >= 0)
        g[gone, without[gone]] = -1.0
        most = g.max(1)
        f = (g >= (most * (1 - 1e-9))[:, None]).argmax(1)
        nodes.append(own)
        codes.append(np.where(most > 0, f * BINS + bin_of[own, f], -1))
        bits.append(np.full(len(own), 1 << q, np.uint64))
    nodes, codes, bits = np.concatenate(nodes), np.concatenate(codes), np.concatenate(bits)
    by = np.lexsort((codes, nodes))
    nodes, codes, bits = nodes[by], codes[by], bits[by]
    edge = np.flatnonzero(np.append(True, (nodes[1:] != nodes[:-1]) | (codes[1:] != codes[:-1])))
    nodes, codes, bits = nodes[edge], codes[edge], np.bitwise_or.reduceat(bits, edge)
    return nodes, np.where(codes >= 0, codes // BINS, -1), np.where(codes >= 0, codes % BINS, 0), bits


def _keep(batch: Batch, order: np.ndarray, sizes: np.ndarray, can: np.ndarray, parent: dict) -> dict:
    """Counts of the nodes that can be split and have ``KEPT`` rows, whose places ``order`` lie one node after the other: of each pair of children the smaller
    is counted and the other is the rest of its ``parent`` (by the place of the pair; roots and others without one are counted)."""
    large = np.flatnonzero(can & (sizes >= KEPT))
    count, rest = [], {}
    for i in large.tolist():
        if i // 2 not in parent:
            count.append(i)
        else:
            small = i if sizes[i] < sizes[i ^ 1] or (sizes[i] == sizes[i ^ 1] and i % 2 == 0) else i ^ 1
            count.append(small)
            if small != i:
                rest[i] = small
    if not count:
        return {}
    count, end = np.unique(count), np.append(0, np.cumsum(sizes))
    own = np.concatenate([order[end[i]:end[i + 1]] for i in count.tolist()])
    hist = _count(batch, own, np.repeat(np.arange(len(count)), sizes[count]), len(count), batch.layout.columns, None if batch.once else batch.copies[own])
    out = dict(zip(count.tolist(), hist, strict=True))
    out |= {i: parent[i // 2] - out[small] for i, small in rest.items()}
    return {i: out[i] for i in large.tolist()}


def grow_batch(batch: Batch) -> tuple[list[list[tuple]], np.ndarray, list[np.ndarray]]:
    """Trees of all jobs of a batch, a level at a time: per job and model its nodes as arrays (node, feature, bin, left, right, weights), per place the
    weights of its leaf (where jobs have one model each), and per job which models have a leaf of several classes."""
    k, jobs, rows = batch.k, batch.jobs, batch.rows
    leaf, mixed_ = np.zeros((len(batch.row) if not batch.shared else 0, k)), np.zeros(len(jobs), np.uint64)
    levels, depth = [], np.array([j.depth for j in jobs])
    order, ids, sizes = np.arange(len(batch.row)), np.array([j.node for j in jobs], np.int64), np.array([len(j.row) for j in jobs])
    job, mask = np.arange(len(jobs)), np.array([(1 << len(j.models)) - 1 for j in jobs], np.uint64)
    parent: dict = {}
    while len(ids):
        j = len(ids)
        of = np.repeat(np.arange(j), sizes)
        sums = np.bincount(of * k + batch.label[order], batch.weight[order], j * k).reshape(-1, k)
        held = sizes if batch.once else np.bincount(of, batch.copies[order], j)
        can = (held >= np.maximum(batch.min_split[job], 2)) & ((sums > 0).sum(1) >= 2) & (depth[job] < batch.depth[job])
        kept = _keep(batch, order, sizes, can, parent) if batch.rates is not None else {}
        node, f, b, bits = np.arange(j), np.full(j, -1), np.zeros(j, np.int64), mask
        if can.any():
            own, place, at = order if can.all() else order[np.repeat(can, sizes)], np.cumsum(can) - 1, np.flatnonzero(can)
            got = _level_splits(batch, own, ids[can], job[can], sizes[can], sums[can], {int(place[i]): h for i, h in kept.items()}, mask[can])
            rest = np.flatnonzero(~can)
            node, f, b, bits = np.append(at[got[0]], rest), np.append(got[1], f[rest]), np.append(got[2], b[rest]), np.append(got[3], mask[rest])
            if len(rest):
                by = np.argsort(node, kind="stable")
                node, f, b, bits = node[by], f[by], b[by], bits[by]
        inner = f >= 0
        lo, hi = np.where(inner, child(ids[node], 0), 0), np.where(inner, child(ids[node], 1), 0)
        levels.append((job[node], bits, ids[node], f, b, lo, hi, sums[node]))
        ends = node[~inner]
        if batch.shared:
            several = (sums[ends] > 0).sum(1) > 1
            np.bitwise_or.at(mixed_, job[ends][several], bits[~inner][several])
            start = np.cumsum(sizes) - sizes
            n = sizes[node[inner]]
            own = order[np.arange(n.sum()) + np.repeat(start[node[inner]] - (np.cumsum(n) - n), n)]
        else:
            goes = np.repeat(inner, sizes)
            leaf[order[~goes]] = sums[of[~goes]]
            own, n = order[goes], sizes[inner]
        to = 2 * np.repeat(np.arange(len(n)), n) + rows.right(batch.row[own], n, f[inner], b[inner])
        order = own[np.argsort(to, kind="stable")]
        parent = {p: kept[i] for p, i in enumerate(node[inner].tolist()) if i in kept}
        sizes = np.bincount(to, minlength=2 * len(n))
        job, mask = np.repeat(job[node[inner]], 2), np.repeat(bits[inner], 2)
        ids = np.stack([lo[inner], hi[inner]], 1).ravel()
        depth += 1
    job, bits, *tree = (np.concatenate(c) for c in zip(*levels, strict=True))
    by = np.argsort(job, kind="stable")
    job, bits, tree = job[by], bits[by], [c[by] for c in tree]
    edge, out = np.searchsorted(job, np.arange(len(jobs) + 1)), []
    for i, one in enumerate(jobs):
        own, own_bits = [c[edge[i]:edge[i + 1]] for c in tree], bits[edge[i]:edge[i + 1]]
        out.append([tuple(own)] if len(one.models) == 1 else [tuple(c[(own_bits >> np.uint64(q)) & np.uint64(1) > 0] for c in own) for q in range(len(one.models))])
    return out, leaf, [[bool(int(v) >> q & 1) for q in range(len(one.models))] for v, one in zip(mixed_, jobs, strict=True)]


def coded(x: np.ndarray, bins: Bins) -> Coded:
    layout = Layout(bins, held_together(x, bins))
    return Coded(layout, layout.encode(x))


def grow_here(x: np.ndarray, label: np.ndarray, weight: np.ndarray, copies: np.ndarray, node: int, depth: int, bins: Bins, m: Model, k: int):
    """The subtree of one node: its nodes as arrays (node, feature, bin, left, right, weights), and each row's leaf weights."""
    rates = _class_rates(label, weight, copies, k)
    batch = Batch(coded(x, bins), [Job([m], np.arange(len(label)), label, weight, copies, node, depth)], k, None if rates is None else [rates])
    trees, leaf, _ = grow_batch(batch)
    return trees[0][0], leaf


def grow_models(rows: Coded, todo: list[tuple], k: int, boosted: bool, votes: str, roots: dict):
    """(model, round, alpha, tree) of the voting trees of models, ``todo``: (model, places of its rows, labels, copies); lockstep in batches of ``TOGETHER`` rows.

    The first trees of models that differ only in the feature they go without are grown as one, as far as they are equal; of those that go on to a second round
    the first is grown again on its own.
    """
    groups: dict = {}
    for i, (m, row, label, copies) in enumerate(todo):
        same = (id(row), id(copies), m.seed, m.depth, m.mtry, m.min_leaf, m.min_split, m.weights) if m.without is not None else i
        groups.setdefault(same, []).append((m, row, label, copies))
    waiting = [([m for m, *_ in own[at:at + 60]], *own[0][1:]) for own in groups.values() for at in range(0, len(own), 60)]
    waiting.sort(key=lambda e: len(e[0]) > 1)                                      # those of one model last in, first out: batches are of one kind
    while waiting:
        alive, held = [], 0
        while waiting and (not alive or (held + len(waiting[-1][1]) <= TOGETHER and (len(alive[0][0]) > 1) == (len(waiting[-1][0]) > 1))):
            models, row, label, copies = waiting.pop()
            alive.append((models, row, label, copies, copies.astype(float), root(models[0].seed)))
            held += len(row)
        r = 0
        while alive:
            jobs = [Job(models, row, label, w * _weights(models[0], k)[label], copies, node) for models, row, label, copies, w, node in alive]
            rates = [_class_rates(j.label, j.weight, j.copies, k) for j in jobs]
            going = []
            for known in (True, False):
                own = [i for i, v in enumerate(rates) if (v is not None) == known and len(jobs[i].row)]
                if not own:
                    continue
                trees, leaf, several = grow_batch(Batch(rows, [jobs[i] for i in own], k, [rates[i] for i in own] if known else None))
                at = 0
                for i, grown, mixed_ in zip(own, trees, several, strict=True):
                    models, row, label, copies, w, _ = alive[i]
                    at, here = at + len(row), slice(at, at + len(row))
                    if len(models) > 1:
                        for m, tree, again in zip(models, grown, mixed_, strict=True):
                            if boosted and again:
                                waiting.append(([m], row, label, copies))
                            else:
                                yield m, 0, 1.0, tree                              # a tree without error, or one that is not boosted
                        continue
                    m = models[0]
                    alpha, keep, go, w = _vote_here(leaf[here], label, w, k, r == 0, votes) if boosted else (1.0, True, False, w)
                    if keep:
                        yield m, r, alpha, grown[0]
                    if go and r + 1 < m.rounds:
                        going.append((models, row, label, copies, w, roots[m.seed][r]))
            alive, r = going, r + 1


# ---- growing -----------------------------------------------------------------------

ROWS = "model int, node long, rid long, label int, copies double, w double, x binary"
NODE = "model int, node long, f int, b int, lo long, hi long, sums array<double>"
OUT = f"model int, node long, f int, b int, lo long, hi long, sums array<double>, rid long, label int, copies double, w double, x binary"


def _read(table):
    model = table.column("model").to_numpy()
    label = table.column("label").to_numpy()
    x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.uint8).reshape(len(model), -1)
    w, copies = table.column("w").to_numpy(), table.column("copies").to_numpy()
    return model, label, w, copies, x


def _lists(rows: np.ndarray):
    """The rows of a matrix as a column of lists."""
    import pyarrow as pa
    at = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(rows.ravel(), pa.float64()))


def _weights(m: Model, k: int) -> np.ndarray:
    return np.array(m.weights, float) if m.weights else np.ones(k)


def grow(rows: DataFrame, plan: list[Model], cuts: list[np.ndarray], k: int) -> tuple[DataFrame, DataFrame]:
    """One tree per model from ``rows`` (``ROWS``: node names the root, x as in ``bin_rows``, w are the boosting weights).

    Gives the nodes (``NODE``; f is -1 at a leaf) and the rows with ``p``, the shares of
    the classes at each row's leaf.
    """
    by, bins = {m.model: m for m in plan}, Bins(cuts)
    schema = T.StructType.fromDDL(OUT)
    open_ = rows.select("model", "node", "rid", "label", "copies", "w", "x")
    parts, depth = [], 0
    while True:
        at_depth = depth                                                     # functions below are sent with this number
        size = open_.groupBy("model", "node").agg(F.count(F.lit(1)).alias("n"))
        large = cut_lineage(size.where(F.col("n") > SMALL).select("model", "node"))
        none = large.isEmpty()
        small = open_ if none else open_.join(large, ["model", "node"], "left_anti")

        def here(key, table):
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_schema
            kind, m, node = to_arrow_schema(schema), by[key[0].as_py()], key[1].as_py()
            table = table.sort_by("rid")
            _, label, w, copies, x = _read(table)
            tree, leaf = grow_here(x, label, w * _weights(m, k)[label], copies, node, at_depth, bins, m, k)
            n, t = len(x), len(tree[0])
            first = [pa.array(np.full(n + t, m.model), pa.int32())]
            for c, typ in zip(tree[:5], (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()), strict=True):
                first.append(pa.concat_arrays([pa.array(c).cast(typ), pa.nulls(n, typ)]))
            first.append(_lists(np.concatenate([tree[5], leaf])))
            for c in ("rid", "label", "copies", "w", "x"):
                own = table.column(c).combine_chunks()
                first.append(pa.concat_arrays([pa.nulls(t, own.type), own]))
            return pa.Table.from_arrays(first, schema=kind)

        parts.append(cut_lineage(small.groupBy("model", "node").applyInArrow(here, schema)))
        if none:
            break
        big = cut_lineage(open_.join(large, ["model", "node"], "left_semi"))

        def partial(batches):
            """A histogram of each node's rows in this task, which come one node after the other."""
            import pyarrow as pa
            now = total = None

            def told():
                return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int64()), pa.array([total.tobytes()], pa.binary())],
                                                  names=["model", "node", "h"])

            for b in batches:
                model, label, w, copies, x = _read(b)
                node = b.column("node").to_numpy()
                edge = np.flatnonzero(np.append(True, (model[1:] != model[:-1]) | (node[1:] != node[:-1]))) if len(model) else []
                for lo, hi in zip(edge, [*edge[1:], len(model)], strict=True):
                    key, own = (int(model[lo]), int(node[lo])), slice(lo, hi)
                    tw = w[own] * _weights(by[key[0]], k)[label[own]]
                    hist = bins.histogram(x[own] + bins.start[None, :], label[own], tw, copies[own], k)
                    whole = np.concatenate([[copies[own].sum()], np.bincount(label[own], tw, k), hist.ravel()])
                    if key == now:
                        total = total + whole
                        continue
                    if now is not None:
                        yield told()
                    now, total = key, whole
            if now is not None:
                yield told()

        def added(key, table):
            import pyarrow as pa
            from pyspark.sql.pandas.types import to_arrow_schema
            m, node = by[key[0].as_py()], key[1].as_py()
            whole = sum(np.frombuffer(h, float) for h in sorted(table.column("h").to_pylist()))
            total, hist = whole[:k + 1], whole[k + 1:].reshape(k + 1, -1)
            split = best_split(hist, total, bins, node, m) if m.depth is None or at_depth < m.depth else None
            f, b = split or (-1, 0)
            lo, hi = (int(child(node, 0)), int(child(node, 1))) if split else (0, 0)
            row = {"model": m.model, "node": node, "f": f, "b": b, "lo": lo, "hi": hi, "sums": total[1:].tolist()}
            return pa.Table.from_pylist([row], schema=to_arrow_schema(node_schema))

        node_schema = T.StructType.fromDDL(NODE)
        splits = cut_lineage(big.sortWithinPartitions("model", "node").mapInArrow(partial, T.StructType.fromDDL("model int, node long, h binary"))
                             .groupBy("model", "node").applyInArrow(added, node_schema))
        routed = big.join(splits, ["model", "node"])
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[7:]]
        parts.append(splits.select(*[f.name for f in schema.fields[:7]], *empty))
        leaves = routed.where("f < 0").select("model", *[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[1:6]], "sums",
                                              "rid", "label", "copies", "w", "x")
        parts.append(leaves)
        right = F.conv(F.hex(F.substring("x", F.col("f") + 1, F.lit(1))), 16, 10).cast("int") >= F.col("b")
        open_ = cut_lineage(routed.where("f >= 0").select("model", F.when(right, F.col("hi")).otherwise(F.col("lo")).alias("node"),
                                                          "rid", "label", "copies", "w", "x"))
        depth += 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    share = F.transform("sums", lambda s: s / F.aggregate("sums", F.lit(0.0), lambda a, v: a + v))
    return (out.where("node IS NOT NULL").select(*[f.name for f in schema.fields[:7]]),
            out.where("rid IS NOT NULL").select("model", "rid", "label", "copies", "w", "x", share.alias("p")))


# ---- ensembles ---------------------------------------------------------------------

@dataclass
class Forest:
    """Grown trees: ``grown`` (``NODE`` with ``round``) or ``packed`` (``PACKED``), or some of each; ``alphas`` (model, round, alpha) of the trees that vote."""

    plan: list[Model]
    features: list[str]
    cuts: list[np.ndarray]
    k: int
    grown: DataFrame | None
    alphas: DataFrame
    boosted: bool = False
    votes: str = "discrete"
    packed: DataFrame | None = None

    @cached_property
    def nodes(self) -> DataFrame:
        """``NODE`` with ``round`` of all trees."""
        own = None if self.packed is None else unpacked_trees(self.packed, self.k)
        return self.grown if own is None else own if self.grown is None else self.grown.unionByName(own)


@dataclass
class Dealt:
    """Bags that are not drawn yet: ``rows`` (rid: their places by the keys, strt, label, fold, x), written once, and who draws how many of them.

    ``quotas``: ``{(stratum,) or (fold, stratum): (rows, [(bag, n, seeds), ...])}`` as of ``sampling.draw_groups``; a fold's bags are drawn from the rows of the others.
    ``full``: trees are kept with their nodes' names and weights, not only as they vote.
    """

    rows: DataFrame
    quotas: dict
    seed: int
    full: bool = False

    @cached_property
    def bags(self) -> dict:
        """``{bag: [(group, rows, n, seeds), ...]}``"""
        out: dict = {}
        for g, (total, own) in sorted(self.quotas.items()):
            for bag, n, seeds in own:
                out.setdefault(bag, []).append((g, total, n, seeds))
        return out

    def size(self, bag: int) -> int:
        return sum(n for _, _, n, _ in self.bags.get(bag, []))

    @cached_property
    def n(self) -> int:
        return self.rows.count()

    def layout(self, bins: Bins) -> Layout:
        schema = T.StructType.fromDDL("h binary")

        def work(batches):
            import pyarrow as pa
            out = 0
            for b in batches:
                if b.num_rows:
                    out = out + held_together(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, -1), bins)
            if not np.isscalar(out):
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["h"])

        n = int((bins.size <= 2).sum())
        told = [np.frombuffer(r.h, np.int64) for r in self.rows.select("x").mapInArrow(work, schema).collect()]           # a small matrix per task
        return Layout(bins, sum(told, np.zeros(n * n, np.int64)).reshape(n, n))

    def near(self, bins: Bins) -> bool:
        """Do all rows fit one task?"""
        return self.n * (bins.n + 3) <= NEAR or self.n * (self.layout(bins).columns + 3) <= NEAR

    def drawn(self, bags) -> DataFrame:
        """``(bag, rid, label, copies, x)`` of some bags, written once."""
        own, folds = set(bags), {g[0] for g in self.quotas if len(g) > 1}
        quotas = {g: (total, [d for d in draws if d[0] in own]) for g, (total, draws) in self.quotas.items()}
        rows, group = self.rows.drop("fold"), ["strt"]
        if folds:
            rows, group = self.rows.withColumn("for", F.explode(F.filter(F.sequence(F.lit(0), F.lit(max(folds))), lambda f: f != F.col("fold")))).drop("fold"), ["for", "strt"]
        return cut_lineage(sampling.draw_groups(rows, group, quotas, self.seed, ["rid"]).where("label IS NOT NULL").select(
            "bag", "rid", "label", F.lit(1).cast("long").alias("copies"), "x"))


def _run(table):
    """(rid, label, x) of packed runs (``bag, label, n, rid, x``; see ``sampling.draw_groups``), one run after the other."""
    n = table.column("n").to_numpy()
    rid = np.frombuffer(b"".join(table.column("rid").to_pylist()), np.int64)
    return rid, np.repeat(table.column("label").to_numpy(), n), np.frombuffer(b"".join(table.column("x").to_pylist()), np.uint8).reshape(len(rid), -1)


def unpacked(bags: DataFrame) -> DataFrame:
    """``(bag, rid, label, copies, x)`` of packed runs; other bags as they are."""
    if "n" not in bags.columns:
        return bags
    schema = T.StructType.fromDDL("bag int, rid long, label int, copies long, x binary")

    def work(batches):
        import pyarrow as pa
        for b in batches:
            rid, label, x = _run(b)
            bag = np.repeat(b.column("bag").to_numpy(), b.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(bag, pa.int32()), pa.array(rid), pa.array(label, pa.int32()), pa.array(np.ones(len(rid), np.int64)),
                                              pa.array([r.tobytes() for r in x], pa.binary())], names=schema.names)

    return bags.select("bag", "label", "n", "rid", "x").mapInArrow(work, schema)


def start_rows(bags: DataFrame, plan: list[Model]) -> DataFrame:
    """``ROWS`` of every model from the binned rows of the bags ``(bag, rid, label, copies, x)``, or their packed runs."""
    out = None
    for seed in sorted({m.bootstrap for m in plan}, key=lambda v: (v is not None, v or 0)):
        of = {}
        for m in plan:
            if m.bootstrap == seed:
                of.setdefault(m.bag, []).append((m.model, root(m.seed)))
        rows = unpacked(bags.where(F.col("bag").isin(sorted(of))))
        if seed is not None:
            rows = sampling.exact_bootstrap(cut_lineage(rows.drop("copies")), ["bag"], seed, ["rid"])
        models = bags.sparkSession.createDataFrame(sorted(of.items()), "bag int, models array<struct<model int, node long>>")
        # A row per bag of the plan, whatever the data.
        dealt = rows.join(F.broadcast(models), "bag").select(F.explode("models").alias("m"), "*").select(
            "m.model", "m.node", "rid", "label", F.col("copies").cast("double").alias("copies"), F.col("copies").cast("double").alias("w"), "x")
        out = dealt if out is None else out.unionByName(dealt)
    return out


def _vote_here(leaf: np.ndarray, label: np.ndarray, w: np.ndarray, k: int, first: bool, votes: str):
    """What ``fit_boosted`` does after a round, for one model's rows in order: (alpha, does the tree vote, go on, next weights)."""
    p = leaf / leaf.sum(1, keepdims=True)
    miss = (p >= p.max(1, keepdims=True) - TIE).argmax(1) != label
    err = float(w[miss].sum() / w.sum())
    fine, worse = err <= 0, err >= 1 - 1 / k - TIE
    if votes == "discrete":
        alpha = 1.0 if fine or worse else float(np.log((1 - err) / err) + np.log(k - 1))
        return alpha, first or not worse, not fine and not worse, w * np.where(miss, np.exp(alpha), 1.0) / (w.sum() * (1 - err + err * np.exp(alpha)))
    logs = np.log(np.maximum(p, np.finfo(float).eps))
    own = logs[np.arange(len(label)), label]
    up = w * np.exp(-(k - 1) / k * (own - (logs.sum(1) - own) / (k - 1)))
    return 1.0, True, not fine, up / up.sum()


def _later(spark, plan: list[Model], top: int) -> dict:
    """Roots of the rounds after the first, per seed."""
    if top < 2:
        return {}
    seeds = spark.createDataFrame(sorted({(m.seed,) for m in plan}), "seed long")
    later = F.transform(F.sequence(F.lit(1), F.lit(top - 1)), lambda r: F.xxhash64("seed", r))
    return {r.seed: r.later for r in seeds.select("seed", later.alias("later")).collect()}                # numbers of models and rounds


def _todo(models: list[Model], bag: int, row: np.ndarray, label: np.ndarray, copies: np.ndarray) -> list[tuple]:
    """What ``grow_models`` takes, for the models of a bag; bootstrapped ones learn from the rows that are drawn again."""
    out, again = [], {}
    for m in models:
        if m.bootstrap is None:
            out.append((m, row, label, copies))
            continue
        if m.bootstrap not in again:
            n = sampling.bootstrap_copies(str(bag), len(label), m.bootstrap).astype(float)
            again[m.bootstrap] = row[n > 0], label[n > 0], n[n > 0]
        out.append((m, *again[m.bootstrap]))
    return out


def fit_here(bags: DataFrame, plan: list[Model], cuts: list[np.ndarray], k: int, boosted: bool, votes: str) -> DataFrame:
    """``NODE`` with ``round`` and ``alpha`` of all models of bags of at most ``SMALL`` rows: a bag is in one task, which
    grows its models, so its rows are dealt out once, however many models learn from them."""
    models, bins = {}, Bins(cuts)
    for m in plan:
        models.setdefault(m.bag, []).append(m)
    roots = _later(bags.sparkSession, plan, max(m.rounds for m in plan) if boosted else 1)
    schema = T.StructType.fromDDL(NODE + ", round int, alpha double")

    def work(key, table):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        kind, out, bag = to_arrow_schema(schema), [], key[0].as_py()
        if packed:
            rid, label, x = _run(table)
            order = np.argsort(rid, kind="stable")
            label, x, copies = label[order], x[order], np.ones(len(rid))
        else:
            table = table.sort_by("rid")
            label, copies = table.column("label").to_numpy(), table.column("copies").to_numpy()
            x = np.frombuffer(b"".join(table.column("x").to_pylist()), np.uint8).reshape(len(label), -1)
        for m, r, alpha, tree in grow_models(coded(x, bins), _todo(models[bag], bag, np.arange(len(label)), label, copies), k, boosted, votes, roots):
            n = len(tree[0])
            cols = [np.full(n, m.model), *tree[:5], np.full(n, r), np.full(n, alpha)]
            cols = [pa.array(c).cast(t.type) for c, t in zip(cols, [*list(kind)[:6], *list(kind)[7:]], strict=True)]
            out.append(pa.Table.from_arrays([*cols[:6], _lists(tree[5]), *cols[6:]], schema=kind))
        return pa.concat_tables(out) if out else kind.empty_table()

    packed = "n" in bags.columns
    rows = bags.select("bag", "rid", "label", F.col("n") if packed else F.col("copies").cast("double").alias("copies"), "x").where(
        F.col("bag").isin(sorted(models)))
    return cut_lineage(rows.repartition(min(len(models), 2000), "bag").groupBy("bag").applyInArrow(work, schema))


def fit_near(bags: Dealt, plan: list[Model], cuts: list[np.ndarray], k: int, boosted: bool, votes: str) -> DataFrame:
    """``PACKED`` trees of all models of bags of at most ``SMALL`` rows, where a task can hold all rows: each task gets them once, draws its bags from
    them and grows their models, so what is written does not grow with the number of bags."""
    spark, bins = bags.rows.sparkSession, Bins(cuts)
    layout, n_rows, seed, full = bags.layout(bins), bags.n, bags.seed, bags.full
    models: dict = {}
    for m in plan:
        models.setdefault(m.bag, []).append(m)
    roots = _later(spark, plan, max(m.rounds for m in plan) if boosted else 1)
    strata = sorted({g[-1] for g in bags.quotas})
    # The bags that cost most first, each to the task that has least to do; a task takes the bags of a fold one after the other.
    tasks = max(1, min(len(models), 2 * spark.sparkContext.defaultParallelism))
    load, mine = [(0, t) for t in range(tasks)], [[] for _ in range(tasks)]
    for bag in sorted(models, key=lambda v: (-len(models[v]) * bags.size(v), v)):
        cost, t = heapq.heappop(load)
        mine[t].append(bag)
        heapq.heappush(load, (cost + len(models[bag]) * (bags.size(bag) + 1), t))
    todo = [[(bag, bags.bags.get(bag, []), models[bag]) for bag in sorted(own, key=lambda v: ([g for g, *_ in bags.bags.get(v, [])], v))] for own in mine]
    columns, blocks = layout.columns, T.StructType.fromDDL("start long, n int, rows binary")

    def pack(batches):
        import pyarrow as pa
        size = max(1, sampling.RUN // (columns + 3))
        for b in batches:
            if not b.num_rows:
                continue
            rid, strt = b.column(0).to_numpy(), b.column(1).to_numpy()
            label, fold = (b.column(i).cast(pa.int64()).fill_null(255).to_numpy() for i in (2, 3))
            codes = layout.encode(np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(b.num_rows, -1))
            wide = np.concatenate([np.stack([np.searchsorted(strata, strt), label, fold], 1).astype(np.uint8), codes], 1)
            edge = np.flatnonzero(np.append(True, np.diff(rid) != 1))
            cuts_ = sorted({c for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(rid)], strict=True) for c in range(lo, hi, size)})
            ends = [*cuts_[1:], len(rid)]
            yield pa.RecordBatch.from_arrays([pa.array(rid[cuts_]), pa.array(np.subtract(ends, cuts_).astype(np.int32)),
                                              pa.array([wide[lo:hi].tobytes() for lo, hi in zip(cuts_, ends, strict=True)], pa.binary())], names=blocks.names)

    schema = T.StructType.fromDDL(PACKED)

    def work(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        task, got, head, codes = None, 0, np.empty((n_rows, 3), np.uint8), np.empty((n_rows, columns), np.uint8)
        for b in batches:
            for t, start, n, data in zip(*(b.column(i) for i in range(4)), strict=True):
                start, n = start.as_py(), n.as_py()
                own = np.frombuffer(data.as_buffer(), np.uint8).reshape(n, columns + 3)
                head[start:start + n], codes[start:start + n] = own[:, :3], own[:, 3:]
                task, got = t.as_py(), got + n
        if task is None:
            return
        if got != n_rows:
            raise ValueError(f"{got} rows of {n_rows} came to a task")
        strt, label, fold = head[:, 0].copy(), head[:, 1].copy(), head[:, 2].copy()
        del head
        rows, known, kind = Coded(layout, codes), {}, to_arrow_schema(schema)

        def grown(some):
            out = [packed_tree(m.model, r, alpha, tree, full) for m, r, alpha, tree in grow_models(rows, some, k, boosted, votes, roots)]
            for at in range(0, len(out), 64):
                yield pa.RecordBatch.from_pylist(out[at:at + 64], schema=kind)

        some, held = [], 0
        for bag, draws, own in todo[task]:
            parts = []
            for g, total, n, seeds in draws:
                if g not in known:
                    known = {v: known[v] for v in known if v[:-1] == g[:-1]}       # places of one fold at a time
                    is_in = strt == np.searchsorted(strata, g[-1])
                    if len(g) > 1:
                        is_in &= fold != g[0]
                    known[g] = np.flatnonzero(is_in).astype(np.int32)
                if len(known[g]) != total:
                    raise ValueError(f"{len(known[g])} rows of the {total} of group {g} came to a task")
                parts.append(known[g][sampling.drawn_places(total, n, seed, g, seeds)])
            row = np.sort(np.concatenate(parts)) if parts else np.empty(0, np.int32)
            row = row[label[row] != 255].astype(np.int64)
            if not len(row):
                continue
            some += _todo(own, bag, row, label[row].astype(np.int64), np.ones(len(row)))
            held += len(row) * len(own)
            if held >= TOGETHER:
                yield from grown(some)
                some, held = [], 0
        if some:
            yield from grown(some)

    packed = bags.rows.select("rid", "strt", "label", "fold", "x").mapInArrow(pack, blocks)
    spread = packed.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "start", "n", "rows")
    return cut_lineage(spread.repartitionById(tasks, F.col("task")).mapInArrow(work, schema))


def by_size(bags: DataFrame | Dealt, plan: list[Model]) -> tuple[list[Model], list[Model]]:
    """The models of bags that fit one task, and the others."""
    if isinstance(bags, Dealt):
        large = {m.bag for m in plan if bags.size(m.bag) > SMALL}
    else:
        n = F.sum("n") if "n" in bags.columns else F.count(F.lit(1))
        large = {r["bag"] for r in bags.groupBy("bag").agg(n.alias("rows")).where(F.col("rows") > SMALL).select("bag").collect()}       # numbers of bags
    return [m for m in plan if m.bag not in large], [m for m in plan if m.bag in large]


def _fit_small(bags: DataFrame | Dealt, plan: list[Model], features: list[str], cuts: list[np.ndarray], k: int, boosted: bool, votes: str) -> Forest | None:
    if not plan:
        return None
    if isinstance(bags, Dealt):
        # Strata, labels and folds go as a byte each.
        if max(len({g[-1] for g in bags.quotas}), k, *(g[0] for g in bags.quotas if len(g) > 1)) < 255 and bags.near(Bins(cuts)):
            packed = fit_near(bags, plan, cuts, k, boosted, votes)
            return Forest(plan, features, cuts, k, None, packed.select("model", "round", "alpha"), boosted, votes, packed)
        bags = bags.drawn({m.bag for m in plan})
    trees = fit_here(bags, plan, cuts, k, boosted, votes)
    return Forest(plan, features, cuts, k, trees.drop("alpha"), trees.select("model", "round", "alpha").distinct(), boosted, votes)


def fit_forest(bags: DataFrame | Dealt, plan: list[Model], features: list[str], cuts: list[np.ndarray], k: int) -> Forest:
    """One unboosted tree per model (L3)."""
    here, far = by_size(bags, plan)
    own = _fit_small(bags, here, features, cuts, k, False, "discrete")
    if not far:
        return own
    rows = bags.drawn({m.bag for m in far}) if isinstance(bags, Dealt) else bags
    grown = grow(start_rows(rows, far), far, cuts, k)[0].withColumn("round", F.lit(0))
    alphas = grown.select("model", "round").distinct().withColumn("alpha", F.lit(1.0))
    return _both(Forest(plan, features, cuts, k, grown, alphas), own)


def _both(far: Forest, own: Forest | None) -> Forest:
    if own is not None:
        far.grown = far.grown if own.grown is None else far.grown.unionByName(own.grown)
        far.alphas, far.packed = far.alphas.unionByName(own.alphas), own.packed
    return far


def fit_boosted(bags: DataFrame | Dealt, plan: list[Model], features: list[str], cuts: list[np.ndarray], k: int, votes: str = "discrete") -> Forest:
    """L4 + L5: boosted trees of all models in lockstep, a round of all of them at a time.

    A model stops at its first tree without error (which votes with weight 1), after ``rounds``
    trees, and, with discrete votes, before a tree that is no better than chance (the first stays,
    with weight 1).
    """
    if votes not in ("discrete", "probability"):
        raise ValueError(f"unknown votes {votes!r}")
    here, far = by_size(bags, plan)
    own = _fit_small(bags, here, features, cuts, k, True, votes)
    if not far:
        if own is not None:
            own.plan = plan
        return own
    if isinstance(bags, Dealt):
        bags = bags.drawn({m.bag for m in far})
    # A row per model of the plan, whatever the data.
    of = F.broadcast(bags.sparkSession.createDataFrame([(m.model, m.rounds, m.seed) for m in far], "model int, rounds int, seed long"))
    rows = start_rows(bags, far)
    nodes, states, alive, r = [], [], far, 0
    top, chance, eps = max(m.rounds for m in far), 1 - 1 / k, float(np.finfo(float).eps)
    logs = F.transform("p", lambda s: F.log(F.greatest(s, F.lit(eps))))
    mine = F.element_at(logs, F.col("label") + 1)
    others = F.aggregate(logs, F.lit(0.0), lambda a, v: a + v) - mine
    trusted = F.exp(-(k - 1) / k * (mine - others / (k - 1)))
    # The class with most weight at the leaf, the first of (nearly) equal ones.
    top_share = F.array_max("p") - float(TIE)
    miss = (F.array_position(F.transform("p", lambda s: s >= top_share), True) - 1 != F.col("label")).cast("double")
    while True:
        grown, told = grow(rows, alive, cuts, k)
        told = told.withColumn("miss", miss)
        err = told.groupBy("model").agg((F.sum(F.col("w") * F.col("miss")) / F.sum("w")).alias("err"),
                                        F.sum("w").alias("total"), F.sum(F.col("w") * trusted).alias("moved"))
        fine, worse = F.col("err") <= 0, F.col("err") >= chance - TIE
        if votes == "discrete":
            alpha = F.when(fine | worse, 1.0).otherwise(F.log((1 - F.col("err")) / F.col("err")) + float(np.log(k - 1)))
            keep, go = ~worse | F.lit(r == 0), ~fine & ~worse
            norm = F.col("total") * (1 - F.col("err") + F.col("err") * F.exp(alpha))
        else:
            alpha, keep, go, norm = F.lit(1.0), F.lit(True), ~fine, F.col("moved")
        state = cut_lineage(err.join(of, "model").select(
            "model", F.lit(r).alias("round"), alpha.alias("alpha"), keep.alias("keep"), (go & (F.col("rounds") > r + 1)).alias("go"),
            norm.alias("norm"), F.xxhash64("seed", F.lit(r + 1)).alias("node")))
        nodes.append(grown.withColumn("round", F.lit(r)))
        states.append(state)
        r += 1
        going = {row.model for row in state.where("go").select("model").collect()} if r < top else set()   # numbers of models
        if not going:
            break
        alive = [m for m in alive if m.model in going]
        up = F.when(F.col("miss") > 0, F.exp("alpha")).otherwise(1.0) if votes == "discrete" else trusted
        rows = told.join(F.broadcast(state.where("go").select("model", "alpha", "norm", "node")), "model").select(
            "model", "node", "rid", "label", "copies", (F.col("w") * up / F.col("norm")).alias("w"), "x")
    all_nodes, all_state = nodes[0], states[0]
    for n, s in zip(nodes[1:], states[1:], strict=True):
        all_nodes, all_state = all_nodes.unionByName(n), all_state.unionByName(s)
    alphas = all_state.where("keep").select("model", "round", "alpha")
    return _both(Forest(plan, features, cuts, k, all_nodes, alphas, True, votes), own)


# ---- scoring -------------------------------------------------------------------------

PACKED = "model int, round int, alpha double, size long, f binary, b binary, lo binary, hi binary, share binary, names binary, sums binary"


def packed_tree(model: int, round_: int, alpha: float, tree: tuple, full: bool = False) -> dict:
    """A row of ``PACKED``: a tree's nodes as arrays, the root first; a child is a place in them, a leaf's left one the place of its class shares.

    With ``full`` also the nodes' names and weights, which no vote needs.
    """
    by = np.argsort(tree[0], kind="stable")
    node, f, b, lo, hi, sums = (c[by] for c in tree)
    inner, n = f >= 0, len(node)
    left, right = np.searchsorted(node, lo[inner]), np.searchsorted(node, hi[inner])
    top = np.ones(n, bool)
    top[left] = top[right] = False
    order = np.argsort(~top, kind="stable")
    place = np.empty(n, np.int32)
    place[order] = np.arange(n)
    share = sums[~inner] / sums[~inner].sum(1, keepdims=True)
    kinds, which = np.unique(share, axis=0, return_inverse=True)
    at, to = np.empty(n, np.int32), np.zeros(n, np.int32)
    at[inner], to[inner], at[~inner] = place[left], place[right], which.ravel()
    parts = [f[order].astype(np.int16), b[order].astype(np.int16), at[order], to[order], kinds]
    row = {"model": int(model), "round": int(round_), "alpha": float(alpha), "size": sum(v.nbytes for v in parts)}
    row |= {c: v.tobytes() for c, v in zip(("f", "b", "lo", "hi", "share"), parts, strict=True)}
    return row | {"names": node[order].tobytes() if full else None, "sums": sums[order].tobytes() if full else None}


def unpacked_trees(packed: DataFrame, k: int) -> DataFrame:
    """``NODE`` with ``round`` of ``PACKED`` trees that are full."""
    schema = T.StructType.fromDDL(NODE + ", round int")

    def work(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        kind = to_arrow_schema(schema)
        for batch in batches:
            for r in batch.to_pylist():
                if r["names"] is None:
                    raise ValueError("these trees were kept only as they vote")
                node, f, b = np.frombuffer(r["names"], np.int64), np.frombuffer(r["f"], np.int16), np.frombuffer(r["b"], np.int16)
                inner, names = f >= 0, np.zeros((2, len(f)), np.int64)
                for i, c in enumerate(("lo", "hi")):
                    names[i, inner] = node[np.frombuffer(r[c], np.int32)[inner]]
                cols = [np.full(len(f), r["model"]), node, f, b, *names]
                cols = [pa.array(c).cast(t.type) for c, t in zip(cols, list(kind)[:6], strict=True)]
                yield pa.RecordBatch.from_arrays([*cols, _lists(np.frombuffer(r["sums"], float).reshape(-1, k)), pa.array(np.full(len(f), r["round"]), pa.int32())], schema=kind)

    return packed.mapInArrow(work, schema)


def pack_trees(forest: Forest) -> DataFrame:
    """A row per voting tree; see ``packed_tree``."""
    k, schema = forest.k, T.StructType.fromDDL(PACKED)
    if forest.grown is None:
        return forest.packed

    def work(key, table):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        tree = [table.column(c).to_numpy() for c in ("node", "f", "b", "lo", "hi")]
        sums = table.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, k)
        row = packed_tree(key[0].as_py(), key[1].as_py(), table.column("alpha")[0].as_py(), (*tree, sums))
        return pa.Table.from_pylist([row], schema=to_arrow_schema(schema))

    voting = cut_lineage(forest.grown.join(forest.alphas, ["model", "round"]).groupBy("model", "round").applyInArrow(work, schema))
    return voting if forest.packed is None else voting.unionByName(forest.packed)


class Packed:
    """Trees as arrays: feature (-1 at a leaf), bin, both children, class shares."""

    def __init__(self, table, k: int):
        table = table.sort_by([("model", "ascending"), ("round", "ascending")])
        f, b, lo, hi, share = ([np.frombuffer(v, t) for v in table.column(c).to_pylist()] for c, t in (
            ("f", np.int16), ("b", np.int16), ("lo", np.int32), ("hi", np.int32), ("share", float)))
        n, shares = np.array([len(v) for v in f], np.int64), np.array([len(v) // k for v in share], np.int64)
        self.root = np.cumsum(n) - n
        self.f, self.b, self.right = np.concatenate(f), np.concatenate(b), np.concatenate([v + np.int32(at) for v, at in zip(hi, self.root, strict=True)])
        self.left = np.concatenate([v + np.where(g >= 0, at, sh).astype(np.int32) for v, g, at, sh in zip(lo, f, self.root, np.cumsum(shares) - shares, strict=True)])
        self.shares = np.concatenate(share).reshape(-1, k)
        self.tree_model, self.alpha = table.column("model").to_numpy(), table.column("alpha").to_numpy()

    def share(self, tree: int, x: np.ndarray) -> np.ndarray:
        """Class shares of the rows of ``x`` at their leaves."""
        at, going = np.full(len(x), self.root[tree]), np.arange(len(x))
        while True:
            f = self.f[at[going]]
            going, f = going[f >= 0], f[f >= 0]
            if not len(going):
                return self.shares[self.left[at]]
            now = at[going]
            at[going] = np.where(x[going, f] >= self.b[now], self.right[now], self.left[now])


def pieces(trees: DataFrame) -> list[tuple[int, int]]:
    """First and last model of each piece of at most ``PACK`` bytes (a larger model alone)."""
    sizes = sorted((r.model, r.n) for r in trees.groupBy("model").agg(F.sum("size").alias("n")).collect())           # a row per model
    out, held = [], 0
    for model, n in sizes:
        if out and held + n <= PACK:
            out[-1], held = (out[-1][0], model), held + n
        else:
            out.append((model, model))
            held = n
    return out


def score_forest(forest: Forest, df: DataFrame, keep: list[str], fold: str | None = None, folds: dict | None = None) -> DataFrame:
    """``keep``, ``ensemble`` and ``p0`` ..: the mean of the models' class shares per ensemble of the plan.

    A boosted model's shares are the softmax of its decision.  With ``fold``, an ensemble scores only
    the rows of its own fold (``folds[ensemble]``).  The rows are read once, ``SCORED`` of them at a time; trees are broadcast
    in pieces of a checked size, of which a task holds one at a time.  Of several pieces the scores are written at once, and the pieces go.
    """
    k, width, cuts = forest.k, len(forest.features), forest.cuts
    ensemble = {m.model: m.ensemble for m in forest.plan}
    names = sorted({m.ensemble for m in forest.plan})
    models = {e: sum(1 for m in forest.plan if m.ensemble == e) for e in names}
    n_keep = len(keep)
    inner = [f"c{i}" for i in range(n_keep)]
    fields = [T.StructField(n, df.schema[c].dataType) for n, c in zip(inner, keep, strict=True)]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, inner, strict=True)],
                     (F.col(fold).cast("long") if fold else F.lit(None).cast("long")).alias("fold"), feature_array(forest.features).alias("v"))
    trees = pack_trees(forest).select("model", "round", "alpha", "size", "f", "b", "lo", "hi", "share")
    todo, sc = pieces(trees), df.sparkSession.sparkContext
    shared = [sc.broadcast(Packed(trees.where(F.col("model").between(lo, hi)).toArrow(), k)) for lo, hi in todo]
    boosted, votes = forest.boosted, forest.votes
    # The ensembles that score a row, by its fold.
    of = {None: names} if not fold else {f: [e for e in names if folds[e] == f] for f in set(folds.values())}
    place = {e: i for own in of.values() for i, e in enumerate(own)}
    out = T.StructType([*fields, T.StructField("ensemble", T.IntegerType()), *[T.StructField(f"p{c}", T.DoubleType()) for c in range(k)]])

    def scored(kept, own_fold, x):
        """The rows of ``kept`` (arrays) with their bins ``x``."""
        import pyarrow as pa
        rows_of = {f: np.flatnonzero(own_fold == f) for f in of} if fold else {None: np.arange(len(x))}
        seen = {f: x[i] for f, i in rows_of.items()}
        total = {f: np.zeros((len(of[f]), len(i), k)) for f, i in rows_of.items()}
        for piece in shared:
            p, t = piece.value, 0
            while t < len(p.root):
                last = int(np.searchsorted(p.tree_model, p.tree_model[t], "right"))
                e = ensemble[int(p.tree_model[t])]
                f = folds[e] if fold else None
                if len(rows_of[f]):
                    total[f][place[e]] += _vote(p, range(t, last), seen[f], k, boosted, votes)
                t = last
            if len(shared) > 1 and getattr(piece, "_path", None):
                del p, piece._value                                               # the next rows read it again from the worker's file
        for f, i in rows_of.items():
            take = pa.array(i)
            for e in of[f] if len(i) else []:
                yield pa.RecordBatch.from_arrays([*[c.take(take) for c in kept], pa.array(np.full(len(i), e), pa.int32()),
                                                  *[pa.array(total[f][place[e]][:, c] / models[e]) for c in range(k)]], names=out.names)

    def work(batches):
        import pyarrow as pa
        held, n = [], 0

        def flush():
            table = pa.Table.from_batches([pa.RecordBatch.from_arrays([*b.columns[:n_keep + 1]], names=[*inner, "fold"]) for b, _ in held]).combine_chunks()
            kept = [pa.concat_arrays(table.column(i).chunks) for i in range(n_keep)]
            yield from scored(kept, table.column(n_keep).fill_null(-1).to_numpy() if fold else None, np.concatenate([x for _, x in held]))

        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.select(range(n_keep + 1)), binned(_matrix(b.column(n_keep + 1), width), cuts)))
            n += b.num_rows
            if n >= SCORED:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()

    if len(todo) > 1:
        rows = rows.repartition(2 * sc.defaultParallelism)                        # dealt evenly: each meets all trees
    told = rows.mapInArrow(work, out)
    if len(todo) > 1:
        told = cut_lineage(told)
        for piece in shared:
            piece.unpersist()
    return told.select(*[F.col(n).alias(c) for n, c in zip(inner, keep, strict=True)], "ensemble", *[f"p{c}" for c in range(k)])


def _vote(p: Packed, trees, x: np.ndarray, k: int, boosted: bool, votes: str) -> np.ndarray:
    """Class shares of one model."""
    if not boosted:
        return p.share(trees[0], x)
    score = np.zeros((len(x), k))
    for t in trees:
        share = p.share(t, x)
        if votes == "discrete":
            score[np.arange(len(x)), (share >= share.max(1, keepdims=True) - TIE).argmax(1)] += p.alpha[t]
        else:
            logs = np.log(np.maximum(share, np.finfo(float).eps))
            score += (k - 1) * (logs - logs.mean(1, keepdims=True))
    score /= (sum(p.alpha[t] for t in trees) if votes == "discrete" else len(trees)) * max(1, k - 1)
    e = np.exp(score - score.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)
