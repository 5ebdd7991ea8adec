"""Toxicity scores (5): averaged subword bags in a linear softmax.

Every character n-gram (3 to 5, with word borders) of every word has a vector;
a text is the mean of its n-grams' vectors, and a linear softmax over this mean
gives the two classes.  Vectors and softmax are trained jointly, in numpy, on a
bounded sample of labelled rows.  As both are linear, each n-gram's share in
the difference of the logits can be added up on its own, so a worker needs one
number for each bucket (1 MB), whatever the text's length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm import subwords
from faultline.llm.arrow import pieces, trim

SAMPLE = (4500, 1500)             # labelled rows of class 0 and 1 that are learnt from, at most


@dataclass
class ToxicityModel:
    weight: np.ndarray            # by bucket: share in the logits' difference
    bias: float
    threshold: float = 0.3

    def score(self, texts: list[str]) -> np.ndarray:
        s, m = subwords.totals(texts, self.weight)
        z = s / np.maximum(m, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt from: crc32 of the id as text mod 4 is 2 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Bags:
    """Labelled rows as flat arrays: row i has label ``y[i]`` and the buckets ``start[i]`` to ``start[i + 1]``."""

    y: np.ndarray
    start: np.ndarray
    bucket: np.ndarray
    count: np.ndarray
    order: np.ndarray             # one order of the rows, however they arrived

    @staticmethod
    def of(rows: list) -> "Bags":
        """From a list of (label, buckets, counts)."""
        size = [len(b) for _, b, _ in rows]
        flat = [np.concatenate([np.asarray(r[k]) for r in rows]) if rows else np.empty(0) for k in (1, 2)]
        return Bags(np.array([r[0] for r in rows], np.int64), np.append(0, np.cumsum(size)).astype(np.int64),
                    flat[0].astype(np.int32), flat[1].astype(np.uint16), np.arange(len(rows)))

    def row(self, i: int) -> slice:
        return slice(self.start[i], self.start[i + 1])


def labelled_bags(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                  sample: tuple[int, int]) -> Bags:
    """At most ``sample[y]`` rows of class y, in the order of a hash of the id.

    The ids are chosen from the labels alone (a top-k), so only that many rows,
    a bounded number, are broadcast.  Of the rows of one id one is learnt from, that of
    the least bag by hash, so only ``sum(sample)`` bags come to the driver.
    """
    own = labels.where(~held_out(id_col) & F.col(id_col).isNotNull())
    order = (F.xxhash64(id_col), F.col(id_col))
    some = [own.where(F.col(label_col) == y).select(id_col, F.lit(y).alias("__y")).distinct().orderBy(*order).limit(sample[y])
            for y in (0, 1)]
    chosen = some[0].unionByName(some[1])
    rows = (docs.select(F.col(id_col).alias("__id"), F.coalesce(text_col, F.lit("")).alias("__t"))
            .join(F.broadcast(chosen.select(F.col(id_col).alias("__id"), "__y")), "__id").select("__id", "__y", "__t"))

    def bags(batches):
        import hashlib

        import pyarrow as pa
        for b in pieces(batches):
            got = [subwords.bag(t) for t in b.column(2).to_pylist()]
            own = [(x.astype("<i4").tobytes(), np.minimum(c, 65535).astype("<u2").tobytes()) for x, c in got]
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array([hashlib.sha256(x + c).digest() for x, c in own], pa.binary()),
                pa.array([x for x, _ in own], pa.binary()), pa.array([c for _, c in own], pa.binary())], names=["id", "y", "k", "b", "c"])

    bag_type = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("y", T.IntegerType()),
                             *[T.StructField(n, T.BinaryType()) for n in "kbc"]])
    one = rows.mapInArrow(bags, bag_type).groupBy("id", "y").agg(F.min(F.struct("k", "b", "c")).alias("m"))
    table = one.select("y", "m.k", "m.b", "m.c").toArrow().combine_chunks()
    if not table.num_rows:
        return Bags.of([])

    def flat(name, kind):
        import pyarrow as pa
        column = table.column(name).chunk(0).cast(pa.large_binary())
        at = np.frombuffer(column.buffers()[1], "<i8")[column.offset:column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2], np.uint8)[at[0]:at[-1]].view(kind), (at - at[0]) // np.dtype(kind).itemsize

    y = table.column("y").to_numpy().astype(np.int64)
    key = np.array([k[:8] for k in table.column("k").to_pylist()], "S8")
    (bucket, start), (count, _) = flat("b", "<i4"), flat("c", "<u2")
    return Bags(y, start, bucket, count, np.lexsort((key, y)))


def train(bags: Bags | list, prior: float | None = None, dim: int = 4, steps: int = 400, rate: float = 0.1, gain: float = 50.0,
          least: int = 5, decay: float = 5e-5, batch: int = 256, seed: int = 7) -> ToxicityModel:
    """Joint Adagrad on the vectors and the softmax.

    ``steps`` minibatches are seen at least, in whole epochs.  N-grams in fewer than ``least`` of the rows get no vector.  ``prior`` is the
    share of label 1 among all labelled rows; the sample's own is corrected to it.
    """
    bags = bags if isinstance(bags, Bags) else Bags.of(bags)
    n_bucket = 1 << subwords.BITS
    weight = np.zeros(n_bucket, np.float32)
    pos = float(bags.y.mean()) if len(bags.y) else 0.0
    prior = pos if prior is None else prior
    odds = np.log(max(prior, 1e-4) / max(1 - prior, 1e-4))
    if not 0 < pos < 1:
        return ToxicityModel(weight, float(odds))
    rng = np.random.default_rng(seed)
    kept = np.flatnonzero(np.bincount(bags.bucket, minlength=n_bucket) >= least)
    place = np.full(n_bucket, -1, np.int32)
    place[kept] = np.arange(len(kept))
    # A batch is kept once, in the order of its n-grams: the n-grams, where each begins, and rows and shares.
    sets = []
    order = bags.order[rng.permutation(len(bags.order))]
    for lo in range(0, len(order), batch):
        own = order[lo:lo + batch]
        col, row, val = [], [], []
        for k, i in enumerate(own):
            c = bags.count[bags.row(i)]
            p = place[bags.bucket[bags.row(i)]]
            col.append(p[p >= 0])
            val.append((c * np.float32(gain / max(c.sum(dtype=np.int64), 1)))[p >= 0])
            row.append(np.full(len(col[-1]), k, np.uint16))
        col = np.concatenate(col)
        by = np.argsort(col, kind="stable")
        col = col[by]
        edge = np.flatnonzero(np.append(True, col[1:] != col[:-1])) if len(col) else np.empty(0, np.int64)
        sets.append((col[edge], np.append(edge, len(col)), np.concatenate(row)[by], np.concatenate(val)[by], bags.y[own]))
    del bags
    vec = rng.normal(0, 0.01, (len(kept), dim)).astype(np.float32)
    soft, bias = rng.normal(0, 0.5, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    sq_vec, sq_soft, sq_bias = np.full((len(kept), dim), 1e-8, np.float32), np.full((dim, 2), 1e-8), np.full(2, 1e-8)
    for _ in range(-(-steps // len(sets))):
        for k in rng.permutation(len(sets)):
            cols, edge, row, val, want = sets[k]
            m, here = len(want), vec[cols]
            mean = np.stack([np.bincount(row, val * np.repeat(here[:, d], np.diff(edge)), m) for d in range(dim)], 1)
            z = mean @ soft + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(m), want] -= 1
            p /= m
            back = (p @ soft.T).astype(np.float32)
            if len(cols):
                g = np.stack([np.add.reduceat(val * back[row, d], edge[:-1]) for d in range(dim)], 1)
                g += np.float32(decay) * here
                sq_vec[cols] += g * g
                vec[cols] -= np.float32(rate) * g / np.sqrt(sq_vec[cols])
            g = mean.T @ p
            sq_soft += g * g
            soft -= (rate * g / np.sqrt(sq_soft)).astype(np.float32)
            g = p.sum(0)
            sq_bias += g * g
            bias -= (rate * g / np.sqrt(sq_bias)).astype(np.float32)
    weight[kept] = gain * (vec @ (soft[:, 1] - soft[:, 0]))
    del sets
    trim()
    return ToxicityModel(weight, float(bias[1] - bias[0] + odds - np.log(pos / (1 - pos))))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 label_col: str = "toxic", sample: tuple[int, int] = SAMPLE, **how) -> ToxicityModel:
    """A model from the labelled rows that aren't held out; see ``labelled_bags`` for the bounded sample."""
    own = labels.where(~held_out(id_col) & F.col(id_col).isNotNull())
    share = own.agg(F.avg((F.col(label_col) == 1).cast("double")).alias("p")).first()["p"]
    return train(labelled_bags(docs, labels, id_col, text_col, label_col, sample), share or 0.0, **how)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text",
                   keep: list[str] | None = None) -> DataFrame:
    """``keep`` (by default the id) and ``score``, ``predicted`` of each row, from its whole text alone.

    Null and empty texts, and texts without a letter or digit, get the score of
    the bias alone.  Repeated rows are scored each; columns that aren't in
    ``keep`` are not read; an empty table gives no rows.
    """
    keep = [id_col] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(model)      # 1 MB, whatever the input
    read = keep if text_col in keep else [*keep, text_col]
    at, inner = read.index(text_col), [f"c{i}" for i in range(len(read))]
    schema = T.StructType([T.StructField(n, docs.schema[c].dataType) for n, c in zip(inner, keep, strict=False)]
                          + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def score(batches):
        import pyarrow as pa
        m = shared.value
        for b in pieces(batches):
            s = m.score([t or "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(keep)], pa.array(s), pa.array((s >= m.threshold).astype(np.int32))], names=schema.names)

    out = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(inner, read, strict=True)]).mapInArrow(score, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(inner, keep, strict=False)], "score", "predicted")
