"""Near-duplicate embeddings (9) against all pairs."""

import numpy as np
import pytest
from faultline.llm.embedding_dedup import near_embeddings


def brute(ids, rows, t=0.95):
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if a is None or b is None or len(a) != len(b) or None in a or None in b:
                continue
            a, b = np.array(a, float), np.array(b, float)
            if np.isfinite(a).all() and np.isfinite(b).all() and a.any() and b.any():
                link[i, j] = link[j, i] = (a @ b) / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= t
    lab = np.arange(n)
    while True:
        new = np.array([min(lab[i], *lab[link[i]], n) if link[i].any() else lab[i] for i in range(n)])
        if (new == lab).all():
            break
        lab = new
    least = {k: min(ids[i] for i in range(n) if lab[i] == k) for k in set(lab.tolist())}
    return {ids[i]: (int(link[i].sum()), least[lab[i]], ids[i] == least[lab[i]]) for i in range(n)}


@pytest.mark.parametrize("tile", [16, 4096])
def test_links_and_components(spark, tile):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 24))
    rows = [x.astype(np.float32).tolist() for x in base]
    for scale in (0.01, 0.05, 0.06, 0.07, 0.2):
        rows += [(b + scale * np.sqrt(b @ b) * rng.normal(size=24) / 5).astype(np.float32).tolist() for b in base[:30]]
    rows += [rows[0]] * 40 + [[2 * v for v in rows[1]]] * 3                           # copies, and a multiple
    rows += [None, [], [0.0] * 24, [float("nan")] * 24, [1.0, None, *[0.0] * 22], [float("inf"), *[1.0] * 23], [1.0, 0.0], [0.99, 0.01]]
    ids = rng.permutation(len(rows)).tolist()
    df = spark.createDataFrame([(i, r, 1, b"z") for i, r in zip(ids, rows, strict=True)],
                               "vec_id long, embedding array<float>, n int, h binary").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_embeddings(df, tile=tile).collect()}
    assert got == brute(ids, rows)


def test_edges(spark):
    kind = "vec_id long, embedding array<float>"
    assert near_embeddings(spark.createDataFrame([], kind)).count() == 0
    only = near_embeddings(spark.createDataFrame([(1, None), (2, [0.0])], kind)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in only) == [(1, 0, 1, True), (2, 0, 2, True)]
    twice = near_embeddings(spark.createDataFrame([(5, [1.0, 2.0]), (5, [1.0, 2.0]), (None, [1.0, 2.0])], kind)).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in twice) == [("5", 2, 5, True), ("5", 2, 5, True), ("None", 2, 5, False)]
