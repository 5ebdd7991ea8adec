"""Main text of HTML pages (10): text blocks classified by a decision tree (``html_blocks``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` of each page.

    Markup is tolerated as it comes: open tags, cut pages, stray brackets.
    Character references are decoded, white space in a block becomes one blank,
    blocks are joined by one blank in the page's order.  A null or empty page,
    and one without article text, has an empty text.  Repeated rows and nulls in
    other columns are kept; columns not named are not read; an empty table gives
    no rows.  Rows are independent: no shuffle.
    """
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField(url_col, pages.schema[url_col].dataType),
                           T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def extract(batches):
        import pyarrow as pa

        from faultline.llm.html_blocks import main_texts
        for b in batches:
            texts = []
            for lo in range(0, b.num_rows, 256):
                texts += main_texts([h or "" for h in b.column(2).slice(lo, 256).to_pylist()])
            # A reference to a lone surrogate has no UTF-8 form.
            texts = [t if t.isascii() else t.encode("utf-8", "replace").decode() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select(id_col, url_col, html_col).mapInArrow(extract, schema)
