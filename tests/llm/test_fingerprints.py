"""Consistent weighted sampling and the comparison with the next document (8)."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from faultline.llm.bpe import mix
from faultline.llm.fingerprints import compare_with_next, fingerprint
from faultline.llm.weighted_sampling import fingerprints, samples


def test_samples_agree_as_often_as_weights_overlap():
    rng = random.Random(2)
    for most in (1, 4, 300):
        got, want = [], []
        for _ in range(12):
            a = {k: rng.randint(1, most) for k in rng.sample(range(10 ** 6), 50)}
            b = {k: v if rng.random() < .6 else rng.randint(1, most) for k, v in a.items() if rng.random() < .9}
            own = np.repeat([0, 1], [len(a), len(b)])
            s = samples(own, mix(np.array([*a, *b], np.uint64)), np.array([*a.values(), *b.values()]), 2, 1024)
            got.append((s[0] == s[1]).mean())
            want.append(sum((Counter(a) & Counter(b)).values()) / sum((Counter(a) | Counter(b)).values()))
        assert abs(np.mean(got) - np.mean(want)) < 0.02 and max(abs(np.array(got) - want)) < 0.1


def test_long_texts_without_a_common_word_are_not_alike():
    a, b = (" ".join(f"{c}{i}" for i in range(10 ** 6)) for c in "ab")
    f, g = fingerprints([a, b])
    assert (f == g).mean() < 0.02
    own, term = np.repeat([0, 1], 200_000), mix(np.arange(1, 400_001, dtype=np.uint64))
    f, g = samples(own, term, 1 + np.arange(400_000) % 3, 2)
    assert (f == g).mean() < 0.02


def test_long_texts_agree_as_often_as_they_overlap():
    term = mix(np.arange(1, 30_001, dtype=np.uint64))
    own = np.repeat([0, 1], 20_000)
    for wa, wb in ((1, 1), (2, 5), (7, 7)):
        f, g = samples(own, np.concatenate([term[:20_000], term[10_000:]]), np.repeat([wa, wb], 20_000), 2, 1024)
        assert abs((f == g).mean() - min(wa, wb) / (wa + wb + max(wa, wb))) < 0.06


def want_rows(rows):
    """Rows in order beside their next one."""
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        e = t[:len(t) - cut] + nxt[:cut]
        f, g, h = fingerprints([t, e, nxt])
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f.astype(">u2").tobytes().hex(),
                    g.astype(">u2").tobytes().hex(), (f == g).mean(), (f == h).mean()))
    return out


def run(df, **how):
    return sorted(map(tuple, compare_with_next(df, **how).collect()), key=str)


def test_every_range_size_gives_the_same(spark):
    rng = random.Random(1)
    rows = [(i * 3 - 50, " ".join(rng.choice(["é", "ab", "c𝄞d", "xyz"]) for _ in range(rng.randint(0, 40)))) for i in range(120)]
    want = sorted(want_rows(rows), key=str)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rng.sample(rows, len(rows))], "doc_id long, text string, r int, edge int").repartition(3)
    for size in (1 << 30, 2000, 50):
        assert run(df, range_bytes=size) == want


def test_edges(spark):
    kind = "doc_id long, text string"
    assert compare_with_next(spark.createDataFrame([], kind)).count() == 0
    one = run(spark.createDataFrame([(1, "a b c d e f")], kind))
    assert one == want_rows([(1, "a b c d e f")])
    rows = [(None, ""), (2, "x y z w"), (2, "x y z w"), (5, ""), (9, "long text " * 2000)]
    df = spark.createDataFrame([(i, t or None) for i, t in rows], kind).repartition(2)
    assert run(df, range_bytes=10) == run(df) == sorted(want_rows(rows), key=str)


def test_fingerprint(spark):
    df = spark.createDataFrame([(1, "same text here now"), (2, "same text here now"), (3, None), (4, "!")], "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in fingerprint(df).collect()}
    assert got[1] == got[2] and got[3] == got[4] == "0" * 512 and len(got[1]) == 512


@pytest.mark.parametrize("range_bytes", [1 << 30, 40])
def test_ids_of_any_type_and_one_id_for_all(spark, range_bytes):
    texts = [f"word{i} and some more text {i * 7 % 11} of document {i}" for i in range(30)]
    named = spark.createDataFrame([(f"n{i:02d}", t) for i, t in enumerate(texts)], "doc_id string, text string").repartition(5)
    got = {r.doc_id: r for r in compare_with_next(named, range_bytes=range_bytes).collect()}
    for i, t in enumerate(texts):
        cut, nxt = len(t) // 4, texts[(i + 1) % 30]
        edited = t[:len(t) - cut] + nxt[:cut]
        assert got[f"n{i:02d}"].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    for one in (None, 7):
        same = spark.createDataFrame([(one, t) for t in texts] + [(one, texts[0])] * 3, "doc_id long, text string").repartition(4)
        rows = compare_with_next(same, range_bytes=range_bytes).collect()
        assert len(rows) == 33 and {r.doc_id for r in rows} == {one}
        order = [r[1] for r in sorted((r.h, r.t) for r in same.selectExpr("xxhash64(text) AS h", "text AS t").collect())]
        want = sorted(hashlib.sha256((a[:len(a) - len(a) // 4] + b[:len(a) // 4]).encode()).hexdigest() for a, b in zip(order, [*order[1:], order[0]], strict=True))
        assert sorted(r.edited_sha256 for r in rows) == want
