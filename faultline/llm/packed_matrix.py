"""Packed id matrices (7): best-fit-decreasing with a segment tree over capacities.

Each task fills sequences from its own documents, in blocks of at most
``block`` ids (and one document), so memory is bounded and nothing is shuffled;
a lost task is run again on its own.  A document longer than a sequence gives
full sequences of its own and a rest that is packed with the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from faultline.llm.arrow import pieces


def best_fit(sizes: list[int], width: int) -> list[list[int]]:
    """Items of each bin: largest first, each into the fullest bin that has room.

    The tree counts the open bins by free capacity (its leaves), so that the
    least capacity that is enough is found in log2(width) steps.
    """
    leaves = 1 << width.bit_length()
    tree = [0] * (2 * leaves)
    open_bins: list[list[int]] = [[] for _ in range(width + 1)]
    bins: list[list[int]] = []

    def change(free: int, by: int) -> None:
        node = leaves + free
        while node:
            tree[node] += by
            node >>= 1

    def least(need: int) -> int | None:
        node = leaves + need
        if tree[node]:
            return need
        while node > 1:
            if not node & 1 and tree[node + 1]:
                node += 1
                while node < leaves:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
                return node - leaves
            node >>= 1
        return None

    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        free = least(sizes[i])
        if free is None:
            free, k = width, len(bins)
            bins.append([])
        else:
            k = open_bins[free].pop()
            change(free, -1)
        bins[k].append(i)
        free -= sizes[i]
        if free:
            open_bins[free].append(k)
            change(free, 1)
    return bins


def pack_matrix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                tokenizer: str = "byte_bpe_50k.json", separator: int | None = 0, width: int = 1024,
                pad: int = 0, block: int = 1 << 22) -> DataFrame:
    """One row per sequence: a row of the id matrix and what is needed to read it.

    ``sequence_id`` (unique, not gapless), ``n_tokens`` (without padding),
    ``input_ids`` (``width`` little-endian unsigned 32-bit ids), ``position_ids``
    (16-bit if ``width`` allows, else 32; they restart at 0 with every segment),
    ``cu_seqlens`` (0 and the end of each segment), ``resets`` (where positions
    restart), ``doc_ids`` and ``starts`` (the document of each segment, and its
    ids before it).  Joining a document's segments by ``starts`` gives its ids.
    A null or empty text is the separator alone (nothing without one); repeated
    rows are packed each; other columns are not read; an empty table gives no rows.
    """
    if not 0 < width < 1 << 31:
        raise ValueError("width must be positive")
    kind = docs.schema[id_col].dataType
    ints, longs = T.ArrayType(T.IntegerType()), T.ArrayType(T.LongType())
    schema = T.StructType([
        T.StructField("sequence_id", T.LongType()), T.StructField("n_tokens", T.IntegerType()),
        T.StructField("input_ids", T.BinaryType()), T.StructField("position_ids", T.BinaryType()),
        T.StructField("cu_seqlens", ints), T.StructField("resets", ints),
        T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("starts", longs)])

    def pack(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from faultline.llm.bpe import ByteBpe, token_path
        bpe = ByteBpe.get(token_path(tokenizer))
        tail = np.array([] if separator is None else [separator], np.uint32)
        ramp = np.arange(width, dtype="<u2" if width <= 1 << 16 else "<u4")
        done = TaskContext.get().partitionId() << 40

        def rows(held, id_type):
            nonlocal done
            segments = [(d, at, x[at:at + width]) for d, x in held for at in range(0, len(x), width)]
            bins = best_fit([len(s[2]) for s in segments], width)
            for lo in range(0, len(bins), 2048):
                out = {n: [] for n in schema.names}
                for items in bins[lo:lo + 2048]:
                    own = [segments[i] for i in items]
                    ends = np.cumsum([len(s[2]) for s in own], dtype=np.int32)
                    ids, pos = np.full(width, pad, "<u4"), np.zeros(width, ramp.dtype)
                    for (_, _, x), e in zip(own, ends.tolist(), strict=True):
                        ids[e - len(x):e] = x
                        pos[e - len(x):e] = ramp[:len(x)]
                    cu = [0, *ends.tolist()]
                    row = (done, cu[-1], ids.tobytes(), pos.tobytes(), cu, cu[:-1], [s[0] for s in own], [s[1] for s in own])
                    for n, v in zip(schema.names, row, strict=True):
                        out[n].append(v)
                    done += 1
                types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()),
                         pa.list_(id_type), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=schema.names)

        held, size, id_type = [], 0, None
        for b in pieces(batches):
            id_type = b.schema.field(0).type
            for d, x in zip(b.column(0).to_pylist(), bpe.encode([t or "" for t in b.column(1).to_pylist()]), strict=True):
                held.append((d, np.concatenate([x, tail])))
                size += len(x) + len(tail)
                if size >= block:
                    yield from rows(held, id_type)
                    held, size = [], 0
        if held:
            yield from rows(held, id_type)

    return docs.select(id_col, text_col).mapInArrow(pack, schema)
