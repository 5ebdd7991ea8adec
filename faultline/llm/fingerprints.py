"""Document fingerprints by consistent weighted sampling (8).

``fingerprint`` takes rows one by one.  ``compare_with_next`` sets every
document beside the following one, in the order of ids: rows are dealt once into
ranges of (id, hash of the text), whose bounds come from ids and hashes alone, the first row of each
range is also given to the range before it, and each range is read in order.
No task holds more than a piece of a range; the driver sees range bounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.arrow import pieces
from faultline.llm.weighted_sampling import fingerprints

RANGE_BYTES = 24 << 20            # text of one id range, about
MOST_RANGES = 1_000_000           # beyond 24 TB ranges grow; a task reads its range in pieces, whatever its length


def _hex(samples: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in samples.astype(">u2")]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = 128) -> DataFrame:
    """``(id, fingerprint)``: the samples of the text's weighted three-word shingles, four hex digits each.

    The share of equal groups of digits of two fingerprints estimates the
    generalised Jaccard similarity of the texts.  Null and empty texts, and
    texts without words, have zeros.  Repeated rows and null ids are kept; other
    columns are not read; an empty table gives no rows.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fingerprint", T.StringType())])

    def sign(batches):
        import pyarrow as pa
        for b in pieces(batches):
            x = fingerprints([t or "" for t in b.column(1).to_pylist()], samples)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_hex(x), pa.string())], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(sign, schema)


def _ranges(rows: DataFrame, range_bytes: int) -> list[tuple]:
    """Least (not null, id, hash of the text) of each range that has rows, in order.

    Spark deals ids and hashes, without texts, into as many ranges as the texts need,
    so rows of one id, or of none, are spread by their texts.
    """
    total = rows.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    n = min(int(total // range_bytes) + 1, MOST_RANGES)
    key = F.struct(F.col("id").isNotNull().alias("known"), "id", "o")
    light = rows.select("id", "o").repartitionByRange(n, F.col("id").asc_nulls_first(), F.col("o")).withColumn("r", F.spark_partition_id())
    return sorted((_key(f["first"]["id"], f["first"]["o"]) for f in light.groupBy("r").agg(F.min(key).alias("first")).collect()))


def _key(i, o) -> tuple:
    return (0, 0, o) if i is None else (1, i, o)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = 128,
                      share: int = 4, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Each text beside its edited text and the next document.

    The edited text has its last floor(n_chars / ``share``) code points replaced
    by the first as many (or all) of the next document's: the next greater id,
    after the last the first.  ``(id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next)``.  Ids are of any type with an order (texts by
    code point); rows without id come first, rows of equal ids in the order of a hash of their
    text.  A null text is empty.  A table of one row has itself as its next.
    Other columns are not read; an empty table gives no rows.
    """
    from bisect import bisect_left, bisect_right
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).withColumn("o", F.xxhash64("t"))
    first = _ranges(rows, range_bytes)
    place_type = T.StructType([T.StructField("own", T.IntegerType()), T.StructField("edge", T.IntegerType())])

    @F.arrow_udf(place_type)
    def place(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        """The row's range, and the range that it follows, if it is the first of its own (after the first, the last)."""
        own, edge = [], []
        for i, o in zip(ids.to_pylist(), hashes.to_pylist(), strict=True):
            k = _key(i, o)
            r = max(bisect_right(first, k) - 1, 0)
            own.append(r)
            edge.append((r - 1) % len(first) if first[r] == k else -1)
        return pa.StructArray.from_arrays([pa.array(own, pa.int32()), pa.array(edge, pa.int32())], names=["own", "edge"])

    dealt = (rows.withColumn("p", place("id", "o"))
             .select("id", "t", "o", F.explode(F.array(
                 F.struct(F.col("p.own").alias("r"), F.lit(0).alias("edge")),
                 F.struct(F.col("p.edge").alias("r"), F.lit(1).alias("edge")))).alias("p"))
             .where("p.r >= 0").select("id", "t", "o", "p.r", "p.edge")
             .repartitionById(max(len(first), 1), F.col("r"))     # one range each
             .sortWithinPartitions("r", "edge", F.col("id").asc_nulls_first(), "o", "t")
             .select("id", "t", "r", "edge"))
    schema = T.StructType([
        T.StructField("id", kind), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()), T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])

    def compare(batches):
        import hashlib

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type
        id_type = to_arrow_type(kind)
        ids, texts, edge, prints = [], [], [], np.zeros((0, samples), np.uint16)
        for b in pieces(batches):
            new = b.column(1).to_pylist()
            ids, texts, edge = ids + b.column(0).to_pylist(), texts + new, edge + b.column(3).to_pylist()
            prints = np.concatenate([prints, fingerprints(new, samples)])
            # A range's rows end with the first of the next one, so a row that is no edge has its next after it.
            at = [i for i in range(len(ids) - 1) if not edge[i]]
            edited = []
            for i in at:
                cut = len(texts[i]) // share
                edited.append(texts[i][:len(texts[i]) - cut] + texts[i + 1][:cut])
            other = fingerprints(edited, samples)
            own, nxt = prints[at], prints[np.array(at, np.int64) + 1]
            yield pa.RecordBatch.from_arrays([
                pa.array([ids[i] for i in at], id_type), pa.array([len(texts[i]) for i in at], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
                pa.array(_hex(own), pa.string()), pa.array(_hex(other), pa.string()),
                pa.array((own == other).mean(1)), pa.array((own == nxt).mean(1))], names=schema.names)
            ids, texts, edge, prints = ids[-1:], texts[-1:], edge[-1:], prints[-1:]

    out = dealt.mapInArrow(compare, schema)
    return out.withColumnRenamed("id", id_col)
