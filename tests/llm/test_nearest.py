"""Nearest neighbours (13) against brute force."""

import numpy as np
import pytest
from conftest import SF01
from faultline.llm import nearest as nn
from faultline.llm.catalog import op13_nearest_neighbours
from pyspark.sql import functions as F


def brute(rows, k=5, every=50):
    """(query id, rank) -> (id, cosine) of all rows (id, vector)."""
    ok = [(i, np.array(v, float)) for i, v in dict.fromkeys((i, None if v is None else tuple(v)) for i, v in rows)
          if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float) != 0)]
    out = {}
    for q, a in ok:
        if q % every == 0:
            cand = sorted((-(a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())), i) for i, b in ok if i != q and len(a) == len(b))
            for r, (s, i) in enumerate(cand[:k], 1):
                out[q, r] = (i, -s)
    return out


def found(df, col="vec_id"):
    return {(r["query_id"], r["rank"]): (r[col], r["score"]) for r in df.collect()}


def recall(got, want):
    by = {}
    for (q, _), (i, _) in got.items():
        by.setdefault(q, set()).add(i)
    return sum(i in by.get(q, ()) for (q, _), (i, _) in want.items()) / len(want)


@pytest.mark.parametrize("tile", [1 << 21, 24 * 70])
def test_neighbours_of_clustered_and_equal_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(nn, "TILE", tile)                 # 70 vectors
    monkeypatch.setattr(nn, "QUERIES", tile // 20)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 24))
    rows = [(base[rng.integers(12)] + rng.choice([0.05, 0.5, 2]) * rng.normal(size=24)).astype(np.float32).tolist() for _ in range(500)]
    rows += [rows[0]] * 300 + [[2 * x for x in rows[0]]] * 3 + [rows[1]] * 4
    rows += [None, [], [0.0] * 24, [float("nan")] * 24, [1.0, None, *[0.0] * 22], [float("inf"), *[1.0] * 23], [1.0, 0.0], [0.5, 0.1]]
    ids = rng.permutation(len(rows)).tolist()
    pairs = [*zip(ids, rows, strict=True), (None, rows[3]), (ids[5], rows[5]), (1000, rows[0]), (1050, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(i, v, 1, b"z", 0.5) for i, v in pairs],
                               "vec_id long, embedding array<float>, id int, h binary, score double").repartition(4)
    got, want = found(nn.nearest(df, F.col("id") % 50 == 0)), brute(pairs)
    assert set(got) == set(want) and recall(got, want) > 0.97
    assert all(abs(s - want[k][1]) < 1e-12 for k, (i, s) in got.items() if want[k][0] == i)
    ties = {k: v for k, v in want.items() if v[1] > 1 - 1e-9}             # copies: the smaller ids first
    assert ties and all(got[k][0] == v[0] for k, v in ties.items() if abs(v[1] - 1) < 1e-15)


@pytest.mark.parametrize("d", [1, 2, 7, 64, 65, 300])
def test_estimates_stay_in_their_bounds(d):
    rng = np.random.default_rng(d)
    x, q = nn.unit(rng.normal(size=(400, d))), nn.unit(rng.normal(size=(60, d)))
    turn = nn.rotation(d)
    assert np.allclose(turn @ turn.T, np.eye(d), atol=1e-9)
    code, scalar = nn.codes(x @ turn)
    asked, all_ = nn.Queries(q @ turn), slice(0, 60)
    est, true = asked.estimates(all_, code, scalar), q @ x.T
    # The same estimate without packed bits.
    bits = [np.unpackbits(np.ascontiguousarray(p).view(np.uint8), axis=1, bitorder="little")[:, :d] for p in asked.planes]
    rounded = asked.low[:, None] + asked.step[:, None] * sum(b.astype(int) << p for p, b in enumerate(bits))
    plain = rounded @ np.where(x @ turn > 0, 1, -1).T / np.sqrt(d) / scalar
    assert np.allclose(est, plain, atol=1e-9)
    assert (np.abs(est - true) <= nn.BOUND * asked.errors(all_, scalar) + 1e-6).mean() > 0.97


def test_recall_of_the_query(spark):
    rows = [(r.vec_id, tuple(r.embedding)) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    got, want = found(op13_nearest_neighbours(spark, SF01)), brute(rows)
    assert set(got) == set(want) and recall(got, want) > 0.97


def test_uncorrelated_vectors(spark):
    rng = np.random.default_rng(11)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 64)))]
    got, want = found(nn.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 50 == 0)), brute(rows)
    assert recall(got, want) > 0.95


def test_edges(spark):
    kind = "vec_id long, embedding array<float>"
    every = F.col("id") % 50 == 0
    assert nn.nearest(spark.createDataFrame([], kind), every).count() == 0
    assert nn.nearest(spark.createDataFrame([(0, None), (50, [0.0]), (None, [1.0])], kind), every).count() == 0
    assert nn.nearest(spark.createDataFrame([(0, [1.0])], kind), every).count() == 0
    few = nn.nearest(spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])], kind), every)
    assert sorted((r["rank"], r.vec_id, round(r.score, 6)) for r in few.collect()) == [(1, 1, 0.707107), (2, 2, -1.0)]
    named = nn.nearest(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.1])], "vec_id string, embedding array<float>"), F.col("id") == "a")
    assert [(r.query_id, r.vec_id) for r in named.collect()] == [("a", "b")]
