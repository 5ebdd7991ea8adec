"""Concatenate-and-cut packing (6).

All documents, each followed by a separator id, form one long run of ids which
is cut every ``width`` ids, so only the last sequence is padded.  Two passes:

1. tokenise, and write one narrow row per document with its ids and the running
   sum of ids inside its partition;
2. add the partition's global offset (prefix sums over one total per
   partition), and cut each document at the windows' borders.

No row is shuffled.  The first pass is written to the shared checkpoint folder,
so the order that the offsets rest on can't change when an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.arrow import pieces
from faultline.session import cut_lineage


def token_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                tokenizer: str = "byte_bpe_50k.json", separator: int | None = 0) -> DataFrame:
    """``(part, before, id, n, ids)``: each document's ids and its place in its partition.

    ``ids`` are little-endian unsigned, of 16 bits if the vocabulary allows it
    (``length(ids) / n`` tells), else 32.
    """
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("before", T.LongType()),
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n", T.LongType()),
        T.StructField("ids", T.BinaryType())])

    def encode(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from faultline.llm.bpe import ByteBpe, token_path
        bpe = ByteBpe.get(token_path(tokenizer))
        kind = "<u2" if max(bpe.lib.get_vocab_size() - 1, separator or 0) < 1 << 16 else "<u4"
        tail = b"" if separator is None else np.array([separator], kind).tobytes()
        part, done = TaskContext.get().partitionId(), 0
        for b in pieces(batches):
            ids = bpe.encode([t or "" for t in b.column(1).to_pylist()])
            n = np.array([len(x) for x in ids], np.int64) + (separator is not None)
            upto = done + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(n), part, np.int32)), pa.array(upto - n), b.column(0), pa.array(n),
                pa.array([x.astype(kind).tobytes() + tail for x in ids], pa.binary())],
                names=["part", "before", id_col, "n", "ids"])
            done = int(upto[-1]) if len(n) else done

    return docs.select(id_col, text_col).mapInArrow(encode, schema)


def pack_concat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                tokenizer: str = "byte_bpe_50k.json", separator: int | None = 0, width: int = 1024) -> DataFrame:
    """``(id, start, length, ids, doc_tokens, sequence_id, offset)``, one row per piece.

    ``start`` counts the document's ids before the piece, ``offset`` the
    sequence's ids before it; ``ids`` are little-endian unsigned 32-bit.  Pieces
    of a sequence fill it without gaps; every sequence but the last is full.
    Null and empty texts hold the separator only (no piece without one).
    Repeated rows are packed each; null ids are kept; other columns are not
    read; an empty table gives no rows.
    """
    table = cut_lineage(token_table(docs, id_col, text_col, tokenizer, separator))
    # One row per partition of the first pass: a few dozen bytes for each of its tasks, so the
    # one-task window and the broadcast are bounded by the number of tasks, not of documents.
    parts = table.groupBy("part").agg(F.sum("n").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    placed = (table.where("n > 0").join(F.broadcast(base), "part")
              .select(id_col, "n", "ids", (F.col("base") + F.col("before")).alias("at")))
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
        T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType())])

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        for b in pieces(batches):
            n, at = b.column(1).to_numpy(), b.column(3).to_numpy()
            first, last = at // width, (at + n - 1) // width
            k = last - first + 1
            row = np.repeat(np.arange(len(n)), k)
            seq = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k) + first[row]
            lo = np.maximum(seq * width, at[row])
            hi = np.minimum((seq + 1) * width, (at + n)[row])
            start = lo - at[row]
            wide = []
            for x, m in zip(b.column(2), n.tolist(), strict=True):
                raw = x.as_buffer()
                wide.append(np.frombuffer(raw, f"<u{raw.size // m}").astype("<u4").tobytes())
            ids = [wide[r][4 * a:4 * (a + m)] for r, a, m in zip(row.tolist(), start.tolist(), (hi - lo).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(row)), pa.array(start), pa.array(hi - lo), pa.array(ids, pa.binary()),
                pa.array(n[row]), pa.array(seq), pa.array(lo - seq * width)], names=schema.names)

    return placed.mapInArrow(cut, schema)
