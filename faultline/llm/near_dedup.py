"""Near-duplicate documents by BagMinHash (1).

1. Equal texts are one node (a hash of the text); its signature is taken once
   per row on the map side, and one small row per node is shuffled.
2. 32 bands of 4 registers each: nodes that agree in a band share its bucket
   (a pair of similarity 0.8 is missed once in 2e7).
3. Rounds over the buckets.  In each, the member that shares most buckets with
   others leads its bucket, and the others of it are verified against it: as
   many pairs as members.  What is verified in a bucket is one component then.
4. Members of a bucket that are still in different components are compared by
   signature in tiles of bounded size, each pair in the first band it shares.
   Members with a partner whose estimate is close enough to the threshold get
   their texts, and the same tile verifies its pairs and returns one link for
   each two components that it joins: rows, not pairs, however large a bucket
   is.  So no link is lost among the candidates, and none is looked for inside
   a component.
5. Components of all links; the class is the least id of its documents.

Verification is the weighted Jaccard similarity of the multisets of five-word
shingles of the two whole texts.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm import shingles
from faultline.llm.arrow import pieces, trim
from faultline.llm.bagminhash import packed, signatures
from faultline.llm.graph import extended
from faultline.session import cut_lineage

BANDS, ROWS = 32, 4
TILE = 2048                       # members of a bucket compared with as many others in one go
SLACK = 0.15                      # over four standard errors of an estimate at 0.8


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("h"), text.alias("t"))


def _nodes(rows: DataFrame) -> DataFrame:
    """``(h, id, sig)``: one row per distinct text, with its least id."""
    id_type = rows.schema["id"].dataType

    def sign(batches):
        import pyarrow as pa
        for b in pieces(batches):
            texts = b.column(2).to_pylist()
            sig = []
            for lo, hi in shingles.chunks(texts):
                own, h, w = shingles.bags(texts[lo:hi])
                s = signatures(own, h, w, hi - lo, BANDS * ROWS)
                some = np.isfinite(s).all(1).tolist()
                sig += [x.tobytes() if ok else None for x, ok in zip(packed(s), some, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sig, pa.binary())], names=["id", "h", "sig"])

    out = rows.mapInArrow(sign, T.StructType([
        T.StructField("id", id_type), T.StructField("h", T.BinaryType()), T.StructField("sig", T.BinaryType())]))
    return out.groupBy("h").agg(F.min("id").alias("id"), F.first("sig").alias("sig"))


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of ``pairs (a, b)`` whose texts are similar enough.

    A node with many partners is met in up to 64 salted groups, so its pairs
    don't gather in one task.
    """
    salted = pairs.withColumn("s", F.pmod(F.xxhash64("b"), F.lit(64)))
    left = salted.select("a", "s").distinct().join(texts.select(F.col("h").alias("a"), F.col("t").alias("ta")), "a")
    full = (salted.join(texts.select(F.col("h").alias("b"), F.col("t").alias("tb")), "b")
            .join(left, ["a", "s"]).select("a", "b", "ta", "tb"))

    def check(batches):
        import pyarrow as pa
        for b in pieces(batches):
            ok = pa.array(shingles.overlap(b.column(2).to_pylist(), b.column(3).to_pylist()) >= threshold)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    return full.mapInArrow(check, T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())]))


def _open(members: DataFrame, comp: DataFrame) -> DataFrame:
    """``members`` with their components ``c``, without buckets that lie in one component."""
    now = cut_lineage(members.join(comp.withColumnsRenamed({"node": "h", "root": "c2"}), "h", "left")
                      .withColumn("c", F.coalesce("c2", "h")).drop("c2"))
    split = now.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("key")
    return cut_lineage(now.join(split, "key", "left_semi"))


TILED = "band int, key long, i int, j int, far boolean, h binary, c binary, sig binary"


def _by_tile(batches, work):
    """``work(table)`` of each run of rows of one tile; a tile may go on in the next batch."""
    import pyarrow as pa

    def keys(t):
        return [t.column(c).to_numpy() for c in ("key", "i", "j")]

    held = None
    for batch in batches:
        held = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch]).combine_chunks()
        if not held.num_rows:
            continue
        k = keys(held)
        edge = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in k])) + 1
        for lo, hi in zip([0, *edge[:-1].tolist()], edge.tolist(), strict=False):
            yield from work(held.slice(lo, hi - lo))
        if len(edge):
            held = held.slice(int(edge[-1]))
    if held is not None and held.num_rows:
        yield from work(held)
    trim()


class _Tile:
    """Signatures, components and sides of the rows of one tile."""

    def __init__(self, table):
        self.sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)
        self.comp = np.unique(np.array(table.column("c").to_pylist(), object), return_inverse=True)[1]
        self.band = table.column("band")[0].as_py()
        n, far = table.num_rows, table.column("far").to_numpy()
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        self.left = range(n - 1) if same else np.flatnonzero(~far).tolist()
        self.right = None if same else np.flatnonzero(far)

    def partners(self, p: int, threshold: float) -> np.ndarray:
        """Rows of other components, close by estimate, that meet p in this band first."""
        q = np.arange(p + 1, len(self.sig)) if self.right is None else self.right
        q = q[self.comp[q] != self.comp[p]]
        if not len(q):
            return q
        same = self.sig[q] == self.sig[p]
        near = same.sum(1) >= (threshold - SLACK) * BANDS * ROWS
        q, same = q[near], same[near]
        return q[same.reshape(-1, BANDS, ROWS).all(2).argmax(1) == self.band]


def _tile_links(members: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links ``(a, b)`` that join the components of each open bucket; ``members (band, key, h, c)``."""
    count = members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("nb"))
    rows = (members.join(count, "key").withColumn("x", F.pmod(F.xxhash64("h"), F.col("nb")).cast("int"))
            .withColumn("y", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
            .select("band", "key", F.least("x", "y").cast("int").alias("i"), F.greatest("x", "y").cast("int").alias("j"),
                    (F.col("x") > F.col("y")).alias("far"), "h", "c")
            .join(nodes.select("h", "sig"), "h"))

    def involved(batches):
        def work(table):
            tile, met = _Tile(table), np.zeros(table.num_rows, bool)
            for p in tile.left:
                q = tile.partners(p, threshold)
                met[q] = True
                met[p] |= len(q) > 0
            if met.any():
                yield from table.take(np.flatnonzero(met)).combine_chunks().to_batches()
        return _by_tile(batches, work)

    def dealt(df):
        return df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    names = [c.split()[0] for c in TILED.split(", ")]
    close = cut_lineage(dealt(rows.select(*names)).mapInArrow(involved, TILED))

    def verified(batches):
        import pyarrow as pa

        def work(table):
            tile = _Tile(table)
            own, h, w = shingles.bags(table.column("t").to_pylist())
            ids = np.unique(h, return_inverse=True)[1]
            size = np.bincount(own, minlength=table.num_rows)
            first, total = np.cumsum(size) - size, np.bincount(own, w, table.num_rows)
            have, found = np.zeros(ids.max() + 1, np.int64), []
            for p in tile.left:
                q = tile.partners(p, threshold)
                if not len(q):
                    continue
                mine = slice(first[p], first[p] + size[p])
                have[ids[mine]] = w[mine]
                begin = np.cumsum(size[q]) - size[q]
                at = np.arange(size[q].sum()) + np.repeat(first[q] - begin, size[q])
                both = np.add.reduceat(np.minimum(have[ids[at]], w[at]), begin)
                have[ids[mine]] = 0
                for r in q[both / (total[p] + total[q] - both) >= threshold].tolist():
                    if tile.comp[r] != tile.comp[p]:
                        found.append((p, r))
                        tile.comp[tile.comp == tile.comp[r]] = tile.comp[p]
            if found:
                name = table.column("h").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([name[x[k]] for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])
        return _by_tile(batches, work)

    full = dealt(close.join(texts, "h").select(*names, "t"))
    return full.mapInArrow(verified, "a binary, b binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8,
                    hub_rounds: int = 2) -> DataFrame:
    """``(id, class_id, kept)``, one row per document.

    Documents are linked when their texts are equal, or the weighted Jaccard
    similarity of their five-word shingles reaches ``threshold``; a class is a
    connected component, named by its least id, whose document is ``kept``.  A
    text of one to four words is one shingle.  Null texts are empty; texts
    without words are linked when equal.  Rows with a null id get the class of
    their text and are never kept; a text that has no other rows is linked with
    equal ones only, and its class is null.  Repeated rows are one document, returned as often as given.  Other
    columns are not read; an empty table gives no rows.
    """
    rows = _keyed(docs, id_col, text_col)
    nodes = cut_lineage(_nodes(rows))
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                       lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * (4 * ROWS) + 1, F.lit(4 * ROWS))))
    keys = nodes.where("sig IS NOT NULL").select(F.posexplode(band).alias("band", "key"), "h")
    size = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = cut_lineage(keys.join(size, "key"))
    reach = shared.groupBy("h").agg(F.sum("size").alias("reach"))
    members = cut_lineage(shared.join(reach, "h").select("band", "key", "h", "reach", F.col("h").alias("c")))
    texts = cut_lineage(rows.join(nodes.join(reach.select("h"), "h", "left_semi").select("h", "id"), ["h", "id"])
                        .select("h", "t").dropDuplicates(["h"]))
    comp = None
    for _ in range(hub_rounds):
        top = members.groupBy("key").agg(F.max(F.struct("reach", "h", "c")).alias("top"))
        led = members.join(top, "key").where("h <> top.h")
        asked = led.where("c <> top.c").select(F.col("top.h").alias("a"), F.col("h").alias("b")).distinct()
        comp = extended(comp, cut_lineage(_verify(asked, texts, threshold)))
        members = _open(led.select("band", "key", "h", "reach"), comp)
    comp = extended(comp, cut_lineage(_tile_links(members, nodes, texts, threshold))).withColumnsRenamed({"node": "h"})
    linked = nodes.select("h", "id").join(comp, "h")
    least = linked.groupBy("root").agg(F.min("id").alias("class"))
    classes = linked.join(least, "root").select("h", F.col("class").alias("linked"))
    named = nodes.select("h", "id").join(classes, "h", "left").select("h", F.coalesce("linked", "id").alias("class"))
    return (rows.select("id", "h").join(named, "h")
            .select(F.col("id").alias(id_col), F.col("class").alias("class_id"),
                    F.coalesce(F.col("id") == F.col("class"), F.lit(False)).alias("kept")))
