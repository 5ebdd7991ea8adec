"""Token counts of whole texts (4): whole-token shortcut.

Which vocabulary strings become one token when they stand alone is proved once
in each worker, by encoding them; pre-tokens that are such strings count one
without merging, and only the rest is merged, each distinct one once
(``bpe.ByteBpe``).  Rows are independent: no shuffle, memory is bounded by one
Arrow batch, a lost task is simply run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from faultline.llm.arrow import pieces


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit, n_whole)`` of each row.

    ``tokenizer`` is a path, or the name of an installed public file, of a
    ``tokenizers`` JSON file.  Special strings inside a text count as this
    library's default has it.  ``n_whole`` counts the pre-tokens that needed no
    merging (0 for a text with special strings).  Null and empty texts have 0
    bytes and tokens; repeated rows and null ids are kept as they are; other
    columns, whatever their names, are not read; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField(id_col, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("over_limit", T.BooleanType()), T.StructField("n_whole", T.LongType())])

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        from faultline.llm.bpe import ByteBpe, token_path
        bpe = ByteBpe.get(token_path(tokenizer))
        for b in pieces(batches):
            texts = pc.fill_null(b.column(1), "")
            n, whole = bpe.count(texts.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n), pa.array(n > limit), pa.array(whole)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit", "n_whole"])

    return docs.select(id_col, text_col).mapInArrow(count, schema)
