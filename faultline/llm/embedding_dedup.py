"""Near-duplicate embeddings (9): PCA-ordered tiled comparison.

1. Equal vectors are one node.
2. The second moments of all unit vectors, summed in the tasks, give principal
   axes; vectors are turned onto them and dealt into tiles by their first
   coordinate.  Two unit vectors of cosine t differ by at most sqrt(2 - 2t) in
   any coordinate, so tiles further apart than this never meet.
3. A pair of tiles is one group of bounded size.  In it, products of leading
   coordinates are added up block by block; what the rest can still add is at
   most the product of the norms of the two suffixes, and a block of pairs of
   which none can reach the threshold is left.  What is not ruled out is decided
   by the cosine of the original vectors in double precision.
4. A tile pair returns, for each vector, how many vectors it links with and one
   link of a spanning forest, so a group of copies gives rows, not pairs.
5. Components of these links.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.graph import components
from faultline.session import cut_lineage

TILE = 4096                       # distinct vectors of a tile, about
BLOCK = 512
SLACK = 1e-4                      # far above the rounding of single precision products


def _vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``(id, h, d, v)``: h is null for a vector that links with nothing; v are doubles."""
    schema = T.StructType([T.StructField("id", rows.schema[id_col].dataType), T.StructField("h", T.BinaryType()),
                           T.StructField("d", T.IntegerType()), T.StructField("v", T.BinaryType())])

    def read(batches):
        import hashlib

        import pyarrow as pa
        for b in batches:
            h, v, d = [], [], []
            for x in b.column(1):
                own = None
                if x.is_valid and not x.values.null_count:
                    a = x.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0      # no negative zero
                    norm = math.sqrt(float(a @ a)) if len(a) else 0.0
                    if np.isfinite(a).all() and (a != 0).any():
                        own = a if 1e-100 < norm < 1e100 else a / np.abs(a).max()
                v.append(None if own is None else own.tobytes())
                h.append(None if own is None else hashlib.sha256(v[-1]).digest()[:16])
                d.append(None if own is None else len(own))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(h, pa.binary()), pa.array(d, pa.int32()), pa.array(v, pa.binary())],
                                             names=schema.names)

    return rows.select(id_col, vec_col).mapInArrow(read, schema)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def principal_axes(nodes: DataFrame, d: int) -> np.ndarray:
    """Axes (columns) by falling share of the second moment of all unit vectors of d numbers."""
    one = T.StructType([T.StructField("m", T.BinaryType())])

    def moments(batches):
        import pyarrow as pa
        m = np.zeros((d, d))
        for b in batches:
            if b.num_rows:
                x = _unit(_matrix(b.column(0)))
                m += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary())], names=["m"])

    def add(batches):
        import pyarrow as pa
        m = np.zeros(d * d)
        for b in batches:
            for x in b.column(0).to_pylist():
                m += np.frombuffer(x, "<f8")
        yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary())], names=["m"])

    # d x d numbers per task, added up in 8 tasks before the driver gets them.
    parts = nodes.where(F.col("d") == d).select("v").mapInArrow(moments, one).repartition(8).mapInArrow(add, one).collect()
    total = sum((np.frombuffer(bytes(p.m), "<f8").reshape(d, d) for p in parts), np.zeros((d, d)))
    return np.linalg.eigh(total)[1][:, ::-1]


def _linked(a: dict, b: dict, same: bool, threshold: float, stops: list[int]):
    """Pairs (row of a, row of b) that link, block by block."""
    for i in range(0, len(a["x"]), BLOCK):
        for j in range(i if same else 0, len(b["x"]), BLOCK):
            p, q = slice(i, i + BLOCK), slice(j, j + BLOCK)
            part, at = None, 0
            for stop, ra, rb in zip(stops, a["rest"], b["rest"], strict=True):
                more = a["x"][p, at:stop] @ b["x"][q, at:stop].T
                part = more if part is None else part + more
                at = stop
                open_ = part + ra[p, None] * rb[None, q] >= threshold - SLACK
                if not open_.any():
                    break
            else:
                u, v = np.nonzero(open_)
                u, v = u + i, v + j
                if same:
                    u, v = u[u < v], v[u < v]
                for lo in range(0, len(u), 1 << 16):
                    s, t = u[lo:lo + (1 << 16)], v[lo:lo + (1 << 16)]
                    ok = (a["raw"][s] * b["raw"][t]).sum(1) / (a["norm"][s] * b["norm"][t]) >= threshold
                    yield s[ok], t[ok]


def _compare(nodes: DataFrame, d: int, threshold: float, tile: int) -> DataFrame:
    """``(h, links, up)`` of the linked vectors of d numbers, once per tile pair."""
    axes = principal_axes(nodes, d)
    main = np.ascontiguousarray(axes[:, 0])
    own = nodes.where(F.col("d") == d)

    def first(batches):
        import pyarrow as pa
        for b in batches:
            x = _unit(_matrix(b.column(1))) @ main if b.num_rows else np.empty(0)
            # Ties are broken by the hash, so that no tile gets more than its share.
            tie = np.array([int.from_bytes(h[:4], "big") for h in b.column(0).to_pylist()], np.float64) * 1e-19
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x + tie), b.column(1), b.column(2)], names=["h", "x", "v", "n"])

    placed = cut_lineage(own.select("h", "v", "n").mapInArrow(first, T.StructType([
        T.StructField("h", T.BinaryType()), T.StructField("x", T.DoubleType()), T.StructField("v", T.BinaryType()), T.StructField("n", T.LongType())])))
    n = placed.count()
    tiles = max(1, -(-n // tile))
    inner = [i / tiles for i in range(1, tiles)]
    cuts = placed.agg(F.percentile_approx("x", inner, max(10_000, 20 * tiles)).alias("c")).first()["c"] if inner else []
    cuts = np.unique(np.array(cuts or [], float))
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    low, high = np.append(-np.inf, cuts), np.append(cuts, np.inf)

    def deal(batches):
        """Each vector once for each tile that its own may link with."""
        import pyarrow as pa
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                c = b.slice(lo, 1024)
                at = np.searchsorted(cuts, c.column(1).to_numpy(), "right")
                j0, j1 = np.searchsorted(high, low[at] - reach), np.searchsorted(low, high[at] + reach, "right")
                k = j1 - j0
                row = np.repeat(np.arange(len(at)), k)
                other = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k) + j0[row]
                i, j, take = np.minimum(at[row], other), np.maximum(at[row], other), pa.array(row)
                yield pa.RecordBatch.from_arrays([
                    pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(at[row] > other),
                    c.column(0).take(take), c.column(2).take(take), c.column(3).take(take)], names=["i", "j", "far", "h", "v", "n"])

    pairs = placed.mapInArrow(deal, T.StructType([
        T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("far", T.BooleanType()),
        T.StructField("h", T.BinaryType()), T.StructField("v", T.BinaryType()), T.StructField("n", T.LongType())]))
    stops = sorted({min(d, s) for s in (8, 16, 32, 64, 128, 256, 512, 1024, d)} & {s for s in range(1, d + 1)} | {d})
    out = T.StructType([T.StructField("h", T.BinaryType()), T.StructField("links", T.LongType()), T.StructField("up", T.BinaryType())])

    def side(table) -> dict:
        raw = _matrix(table.column("v")) if table.num_rows else np.empty((0, d))
        x = (_unit(raw) @ axes).astype(np.float32)
        sq = np.cumsum(x[:, ::-1].astype(np.float64) ** 2, 1)[:, ::-1]
        rest = [np.sqrt(sq[:, s] if s < d else np.zeros(len(x))).astype(np.float32) for s in stops]
        return {"raw": raw, "norm": np.sqrt((raw * raw).sum(1)), "x": x, "rest": rest, "n": table.column("n").to_numpy(), "h": table.column("h")}

    def compare(key, table):
        import pyarrow as pa
        same = key[0].as_py() == key[1].as_py()
        far = table.column("far").to_numpy()
        a = side(table.filter(pa.array(~far)))
        b = a if same else side(table.filter(pa.array(far)))
        shift = 0 if same else len(a["x"])
        size = shift + len(b["x"])
        links, root = np.zeros(size, np.int64), np.arange(size)
        for s, t in _linked(a, b, same, threshold, stops):
            links += np.bincount(s, b["n"][t], size).astype(np.int64) + np.bincount(t + shift, a["n"][s], size).astype(np.int64)
            u, v = root[s], root[t + shift]
            while len(u):                                         # join the two trees at their least rows
                np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
                while (root[root] != root).any():
                    root = root[root]
                u, v = root[u], root[v]
                u, v = u[u != v], v[u != v]
        h = a["h"].to_pylist() + ([] if same else b["h"].to_pylist())
        got = np.flatnonzero(links)
        return pa.table({"h": pa.array([h[i] for i in got], pa.binary()), "links": links[got],
                         "up": pa.array([h[root[i]] for i in got], pa.binary())})

    return pairs.groupBy("i", "j").applyInArrow(compare, out)


def near_embeddings(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95,
                    tile: int = TILE) -> DataFrame:
    """``(id, n_links, component_id, kept)``, one row per vector.

    Vectors whose cosine, in double precision, reaches ``threshold`` are linked;
    vectors of different length never are, and null or zero vectors and ones
    with a null or non-finite number link with nothing.  ``n_links`` counts
    rows, copies included.  ``component_id`` is the least id of a component (null
    if none of it has an id).  Other columns are not read; an empty table gives
    no rows.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold in (0, 1]")
    vectors = cut_lineage(_vectors(rows, id_col, vec_col))
    nodes = cut_lineage(vectors.where("h IS NOT NULL").groupBy("h").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("d").alias("d"), F.first("v").alias("v")))
    dims = [r.d for r in nodes.select("d").distinct().collect()]  # lengths of vectors: a handful
    found = None
    for d in sorted(dims):
        part = _compare(nodes, d, threshold, tile)
        found = part if found is None else found.union(part)
    ids = vectors.select("id", "h")
    if found is None:
        return ids.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"),
                          F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut_lineage(found)
    links = found.groupBy("h").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("h").alias("a"), F.col("up").alias("b"))).withColumnsRenamed({"node": "h"})
    linked = nodes.select("h", "id").join(comp, "h")
    least = linked.groupBy("root").agg(F.min("id").alias("least"))
    named = (nodes.select("h", "id", "n").join(links, "h", "left").join(linked.join(least, "root").select("h", "least"), "h", "left")
             .select("h", F.coalesce("least", "id").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    # Vectors that link with nothing have no h; they go round the join, in which they would be one key.
    alone = ids.where("h IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = ids.where("h IS NOT NULL").join(named, "h").select("id", F.col("n_links").cast("long").alias("n_links"),
                                                              F.col("component").alias("component_id")).unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
