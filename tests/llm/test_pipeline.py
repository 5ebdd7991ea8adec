"""The pipeline's stages, each against its operator, and the whole on a small table."""

from collections import Counter

import corpus_pipeline as cp
import numpy as np
import pytest
from conftest import SF01
from faultline.llm.near_dedup import near_duplicates
from faultline.llm.mixing import mix_sources
from faultline.llm.toxicity import fit_toxicity, score_toxicity


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{SF01}/documents.parquet").where("doc_id < 400")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    docs.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    return str(d)


def key(r):
    return tuple(r)


def test_stages_in_a_row(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_dedup", "mixing", "packing"]
    one = cp.drop_toxic(spark, docs, tables)
    model = fit_toxicity(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    clean = {r.doc_id for r in score_toxicity(docs, model).where("predicted = 0").collect()}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == clean and 0 < len(clean) < 400
    two = cp.drop_near_copies(spark, one, tables)
    kept = {r.doc_id for r in near_duplicates(one).where("kept").collect()}
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == kept and len(kept) < len(clean)
    three = cp.mix(spark, two, tables)
    want = Counter({r.row.doc_id: r.taken // r["size"] for r in mix_sources(two).collect() if r["size"]})
    assert three.columns == docs.columns and Counter(r.doc_id for r in three.collect()) == +want
    four = cp.pack(spark, three, tables).collect()
    assert sum(r.length for r in four) == sum({(r.doc_id): r.doc_tokens for r in four}[i] * n for i, n in want.items() if n)
    last = Counter((r.doc_id, r.length) for r in cp.run(spark, tables).collect())
    assert sum(n * k for (_, n), k in last.items()) == sum(r.length for r in four)
    assert all(len(r.ids) == 4 * r.length and np.frombuffer(bytes(r.ids), "<u4").max() < 50257 for r in four)


def test_odd_rows_go_through(spark, tmp_path):
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (None, "no id", "en", "a", 5), (3, "same same same", None, None, 5),
            (3, "same same same", None, None, 5), (4, "word " * 30_000, "en", "b", 1)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size int, predicted int")
    labels = spark.createDataFrame([(1, 0, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    for name, d in (("some", docs), ("none", docs.where("false"))):
        at = str(tmp_path / name)
        d.write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        cur = spark.read.parquet(f"{at}/documents.parquet")
        for i, (_, stage) in enumerate(cp.STAGES):
            cur = stage(spark, cur, at)
            if i < 3:
                assert cur.columns == docs.columns
            cur.write.parquet(f"{at}/{i}")
            cur = spark.read.parquet(f"{at}/{i}")
        assert (cur.count() > 0) == (name == "some")


def test_near_copies_go_by_row(spark):
    a = " ".join(f"w{i}" for i in range(60))
    near, other = a + " more", " ".join(f"v{i}" for i in range(60))
    rows = [(1, a, "x"), (2, a, "x"), (2, other, "x"), (3, near, "x"), (None, other, "y"), (None, "lone text", "y"), (None, "lone text", "z"), (7, "own", "x"), (7, "own", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    got = cp.drop_near_copies(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted([("1", a), ("2", other), ("None", "lone text"), ("7", "own")])
    assert cp.drop_near_copies(spark, docs.where("false"), "").count() == 0
