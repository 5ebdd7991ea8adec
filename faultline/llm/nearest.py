"""Approximate nearest neighbours (13): randomly rotated one-bit codes.

1. Equal vectors are one node with its least ids, so copies are compared once.
2. A unit vector o is turned by a random rotation and kept as one bit per
   coordinate, o' = sign(Ro) / sqrt(d), with the correction scalar <o', Ro>.
3. A query's turned vector is rounded to ``PLANES`` bits per coordinate.  The inner product
   with a code is then a weighted count of common bits, bit plane by bit plane, and
   divided by the correction scalar an unbiased estimate of the cosine, whose error
   is about sqrt((1 - s^2) / (s^2 (d - 1))) for the scalar s.
4. In a tile of candidates, the best estimates of a query are measured first; a
   candidate is measured as well if its estimate plus ``BOUND`` such errors reaches
   what the k-th best of them has.  Measured is the cosine in double precision.

Every node is in the index and every query node meets every tile, in blocks of
``QUERIES`` by ``TILE`` numbers; a tile returns a query's best few, so neither the copies of
one vector nor a dense cluster leave a tile as pairs.  Vectors are copied once per
block of queries.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.embedding_dedup import _matrix, _vectors
from faultline.session import cut_lineage

QUERIES, TILE = 1 << 19, 1 << 21  # numbers in the vectors of a block of queries, and of a tile
ROWS = 128                        # queries worked on at a time
PLANES = 6                        # bits of a query's coordinate
BOUND = 2.5                       # errors that an estimate may be off before a neighbour is missed
SEED = 13


def rotation(d: int) -> np.ndarray:
    """A random rotation of d dimensions, the same wherever it is drawn."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, d]).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits packed into 64-bit words."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view("<u8")


def codes(turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits of turned unit vectors, and the correction scalars."""
    return words(turned > 0), np.abs(turned).sum(1) / np.sqrt(turned.shape[1])


class Queries:
    """Turned unit vectors as bit planes: coordinate = low + step * (sum of 2^p * bit p)."""

    def __init__(self, turned: np.ndarray):
        top = (1 << PLANES) - 1
        self.d = turned.shape[1]
        self.low = turned.min(1)
        self.step = np.maximum((turned.max(1) - self.low) / top, 1e-12)
        level = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.total = level.sum(1, dtype=np.int64)
        self.planes = [words((level >> p) & 1) for p in range(PLANES)]

    def estimates(self, own: slice, code: np.ndarray, scalar: np.ndarray) -> np.ndarray:
        """Estimated cosines of the queries ``own`` with all codes."""
        common = np.zeros((own.stop - own.start, len(code)), np.int32)
        for p, plane in enumerate(self.planes):
            for j in range(code.shape[1]):
                common += np.bitwise_count(plane[own, j, None] & code[None, :, j]).astype(np.int32) << p
        ones = np.bitwise_count(code).sum(1, dtype=np.int64)
        # <o', q> = sum over set bits minus sum over the others, over sqrt(d).
        signed = self.step[own, None] * (2 * common - self.total[own, None]) + self.low[own, None] * (2 * ones - self.d)[None]
        return signed / (np.sqrt(self.d) * scalar)[None]

    def errors(self, own: slice, scalar: np.ndarray) -> np.ndarray:
        """Size of the estimates' error: that of the code, and that of the rounded query."""
        code = (1 - scalar ** 2).clip(0) / (scalar ** 2 * max(self.d - 1, 1))
        rounded = self.step[own, None] ** 2 / 12 / scalar[None] ** 2
        return np.sqrt(code[None] + rounded)


def best_in_tile(query: np.ndarray, vectors: np.ndarray, least: np.ndarray, k: int, turn: np.ndarray):
    """For each query (row of ``query``) the k best rows of ``vectors``: (query row, row, cosine).

    Cosines are of the given vectors, in double precision; ties go to the smaller ``least``.
    Yields arrays, for a few hundred queries at a time.
    """
    norm_q, norm_v = np.sqrt((query * query).sum(1)), np.sqrt((vectors * vectors).sum(1))
    code, scalar = codes(unit(vectors) @ turn)
    asked = Queries(unit(query) @ turn)

    def cosines(i, j):
        out = np.empty(len(i))
        for lo in range(0, len(i), 1 << 15):
            p, q = i[lo:lo + (1 << 15)], j[lo:lo + (1 << 15)]
            out[lo:lo + (1 << 15)] = (query[p] * vectors[q]).sum(1) / (norm_q[p] * norm_v[q])
        return out

    n = len(vectors)
    for lo in range(0, len(query), ROWS):
        own = slice(lo, min(lo + ROWS, len(query)))
        m = own.stop - lo
        upper = asked.estimates(own, code, scalar)
        top = min(2 * k, n)
        some = np.argpartition(-upper, top - 1, axis=1)[:, :top]
        known = cosines(np.repeat(np.arange(lo, own.stop), top), some.ravel()).reshape(m, top)
        floor = -np.partition(-known, min(k, top) - 1, axis=1)[:, min(k, top) - 1] if n > k else np.full(m, -2.0)
        upper += BOUND * asked.errors(own, scalar)
        upper[np.repeat(np.arange(m), top), some.ravel()] = 3.0             # measured ones stay
        for a in range(0, m, 16):                                          # a dense cluster's pairs, a few queries at a time
            i, j = np.nonzero(upper[a:a + 16] >= floor[a:a + 16, None])
            i += lo + a
            cos = cosines(i, j)
            order = np.lexsort((least[j], -cos, i))
            i, j, cos = i[order], j[order], cos[order]
            first = np.searchsorted(i, i, "left")
            keep = np.arange(len(i)) - first < k
            yield i[keep], j[keep], cos[keep]


def _nodes(vectors: DataFrame, k: int) -> DataFrame:
    """``(h, d, v, ids)``: distinct vectors with their k + 1 least ids.

    A row number that is cut at k + 1 is limited before the shuffle too, so a vector that
    many rows share brings a few rows of each task.
    """
    w = Window.partitionBy("h").orderBy("id")
    few = vectors.where("h IS NOT NULL AND id IS NOT NULL").select("h", "id", "d", "v").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    return few.groupBy("h").agg(F.first("d").alias("d"), F.first("v").alias("v"), F.sort_array(F.collect_list("id")).alias("ids"))


def nearest(rows: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, <id_col>, score)``: the k nearest rows found of each row that ``queries`` selects.

    ``queries`` is a condition on the column ``id``.  Nearest is the largest cosine in double
    precision; ties go to the smaller id; a query's own id is no candidate.  Fewer
    candidates than k give fewer rows.  Vectors of another length than the query's,
    null and zero vectors, vectors with a null or non-finite number, and rows without id
    take no part.  Rows of one id and vector count once; an id with two vectors asks twice and
    can be found twice.  Other columns are not read; an empty table gives no rows.
    """
    vectors = cut_lineage(_vectors(rows, id_col, vec_col)).where("h IS NOT NULL AND id IS NOT NULL").dropDuplicates(["id", "h"])
    nodes = cut_lineage(_nodes(vectors, k))
    asked = vectors.where(queries).select(F.col("id").alias("query_id"), "h")
    asking = cut_lineage(nodes.join(asked.select("h").distinct(), "h", "left_semi").select("h", "d", "v"))
    kind = rows.schema[id_col].dataType
    sizes = {r.d: (r.n, r.m) for r in nodes.groupBy("d").agg(F.count(F.lit(1)).alias("n")).join(
        asking.groupBy("d").agg(F.count(F.lit(1)).alias("m")), "d").collect()}      # lengths of vectors: a handful
    out = T.StructType([T.StructField("h", T.BinaryType()), T.StructField("score", T.DoubleType()), T.StructField("ids", T.ArrayType(kind))])
    parts = []
    for d, (n, m) in sorted(sizes.items()):
        tiles, blocks = -(-n * d // TILE), -(-m * d // QUERIES)
        place = F.pmod(F.xxhash64("h"), F.lit(tiles)).cast("int")
        block = F.pmod(F.xxhash64("h"), F.lit(blocks)).cast("int")
        q = asking.where(F.col("d") == d).select("h", "v", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile"))
        c = nodes.where(F.col("d") == d).select("ids", "v", place.alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

        def search(left, right):
            import pyarrow as pa
            if not left.num_rows or not right.num_rows:
                return pa.table({"h": pa.array([], pa.binary()), "score": pa.array([], pa.float64()), "ids": right.column("ids").slice(0, 0)})
            asks, own = _matrix(left.column("v")), _matrix(right.column("v"))
            ids = right.column("ids").combine_chunks()
            flat, start = ids.flatten(), np.asarray(ids.offsets)[:-1] - ids.offsets[0].as_py()
            least = np.argsort(np.argsort(flat.take(pa.array(start)).to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
            got = list(best_in_tile(asks, own, least, k + 1, rotation(asks.shape[1])))
            i, j, cos = (np.concatenate(x) for x in zip(*got, strict=True))
            return pa.table({"h": left.column("h").combine_chunks().take(pa.array(i)), "score": cos, "ids": ids.take(pa.array(j))})

        parts.append(q.groupBy("block", "tile").cogroup(c.groupBy("block", "tile")).applyInArrow(search, out))
    answer = T.StructType([T.StructField("query_id", kind), T.StructField("rank", T.IntegerType()),
                           T.StructField(id_col, kind), T.StructField("score", T.DoubleType())])
    if not parts:
        return rows.sparkSession.createDataFrame([], answer)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    # k + 1 of each query vector, whose own id is among them; then each query leaves itself out.
    order = Window.partitionBy("h").orderBy(F.desc("score"), F.asc("id"))
    best = cut_lineage(found.select("h", "score", F.explode("ids").alias("id")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1))
    # Rows that ask with one vector may be many: its answers are dealt to several keys.
    salts = 16
    answers = best.select("h", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"), "id", "score", "r")
    salted = asked.withColumn("s", F.pmod(F.xxhash64("query_id"), F.lit(salts)).cast("int"))
    pairs = salted.join(answers, ["h", "s"]).where(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id", "h").orderBy("r")).alias("rank")
    return pairs.select("query_id", rank, F.col("id").alias(id_col), "score").where(F.col("rank") <= k)
