"""Toxicity (5): held-out quality, unseen spellings, and edges."""

import random
import zlib

import numpy as np
import pytest
from conftest import SF01
from faultline.llm import subwords
from faultline.llm.catalog import op5_toxicity
from faultline.llm.toxicity import fit_toxicity, labelled_bags, score_toxicity, train


def auc(score, y):
    score, y = np.asarray(score), np.asarray(y)
    a, b = score[y == 1], score[y == 0]
    return ((a[:, None] > b).mean() + (a[:, None] == b).mean() / 2)


def text(rng, bad=()):
    words = ["".join(rng.choice(["la", "te", "ri", "mo", "sun", "ker"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 80))]
    for w in bad:
        words.insert(rng.randrange(len(words)), w)
    return " ".join(words)


@pytest.fixture(scope="module")
def planted(spark):
    rng, rows = random.Random(3), []
    for i in range(900):
        toxic = i % 5 == 0
        bad = [rng.choice(["zgroxik", "zgroxat", "zgroxel"]) for _ in range(3)] if toxic else ()
        rows.append((i, text(rng, bad), int(toxic)))
    docs = spark.createDataFrame([(i, t, "c") for i, t, _ in rows], "doc_id long, text string, c0 string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    return docs, labels, rows


def test_held_out_rows_and_unseen_spellings(planted):
    docs, labels, rows = planted
    model = fit_toxicity(docs, labels)
    out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert auc(model.score([t for _, t, _ in out]), [y for *_, y in out]) > 0.98
    rng = random.Random(9)
    clean, unseen = [text(rng) for _ in range(100)], [text(rng, ["zgroximmo", "zgroxu", "zgroxans"]) for _ in range(100)]
    s = model.score(unseen + clean)
    assert (s[:100] >= 0.3).mean() > 0.9 and (s[100:] >= 0.3).mean() < 0.1
    got = {r.doc_id: r for r in score_toxicity(docs, model, keep=["doc_id", "c0"]).collect()}
    want = dict(zip([i for i, *_ in rows], model.score([t for _, t, _ in rows]), strict=True))
    assert all(abs(got[i].score - want[i]) < 1e-9 and got[i].predicted == int(got[i].score >= 0.3) and got[i].c0 == "c" for i in want)


def test_a_reordered_table_gives_the_same_model(planted):
    docs, labels, _ = planted
    a, b = (fit_toxicity(d, labels) for d in (docs, docs.repartition(7)))
    assert np.array_equal(a.weight, b.weight) and a.bias == b.bias


def test_totals_equal_plain_counting():
    rng = random.Random(4)
    texts = [text(rng), "", "é", "A b", "..", "ÀB12 xyz!"]
    weight = np.arange(1 << subwords.BITS, dtype=np.float32) % 7
    s, m = subwords.totals(texts, weight)
    for t, x, n in zip(texts, s, m, strict=True):
        b, c = subwords.bag(t)
        assert n == c.sum() and x == (weight[b] * c).sum()
    border = sum(len(w) + 2 - n + 1 for w in ["a", "b"] for n in subwords.SIZES if len(w) + 2 >= n)
    assert m[3] == border


def test_query(spark):
    got = op5_toxicity(spark, SF01).collect()
    assert len(got) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_edges(spark, planted):
    docs, labels, _ = planted
    model = fit_toxicity(docs, labels.where("false"))
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "!!"), (2, "!!"), (3, "x" * 3_000_000)], "doc_id long, text string")
    assert len({r.score for r in score_toxicity(odd, model).collect()}) == 1
    full = fit_toxicity(docs, labels.unionByName(labels.selectExpr("cast(NULL AS long) AS doc_id", "toxic")).unionByName(
        labels.selectExpr("doc_id", "cast(NULL AS int) AS toxic")))
    assert len({r.score for r in score_toxicity(odd.where("doc_id IS NULL OR doc_id < 3"), full).collect()}) == 1
    assert score_toxicity(odd.where("false"), full).count() == 0
    assert train([]).score([""]).shape == (1,)


def test_one_row_of_an_id_is_learnt_from(spark, planted):
    docs, labels, _ = planted
    again = docs.unionByName(docs.where("doc_id < 3")).unionByName(docs.where("doc_id = 5"))
    some, more = (labelled_bags(d, labels, "doc_id", "text", "toxic", (50, 20)) for d in (docs, again))
    assert len(some.y) == len(more.y) == 70 and some.y.sum() == more.y.sum() == 20
    many = docs.selectExpr("doc_id", "text", "explode(sequence(1, 40)) AS n").selectExpr("doc_id", "concat(text, ' ', n) AS text")
    assert len(labelled_bags(many, labels, "doc_id", "text", "toxic", (50, 20)).y) == 70


def plain_bag(text):
    """Character n-grams of a text's words, with borders, without the library's arrays."""
    out, word = [], ""
    for ch in text + " ":
        if ch.isalnum():
            low = ch.lower()
            word += low if len(low) == 1 else ch
        elif word:
            w = "\0" + word + "\0"
            out += [w[i:i + n] for n in subwords.SIZES for i in range(len(w) - n + 1)]
            word = ""
    return out


def plain_bucket(gram):
    n, h = len(gram), 0
    for k, ch in enumerate(gram):
        h = ord(ch) if k == 0 else (h * 0x01000193 + ord(ch)) & 0xFFFFFFFF
    x = ((h ^ (h >> 15)) * (0x85EBCA6B + 2 * n)) & 0xFFFFFFFF
    return (((x ^ (x >> 13)) * 0xC2B2AE35) & 0xFFFFFFFF) >> (32 - subwords.BITS)


def test_bags_and_scores_equal_a_plain_version(planted):
    docs, labels, rows = planted
    model = fit_toxicity(docs, labels)
    texts = [t for _, t, _ in rows[:20]] + ["", "!?", "Éa ßx", "a", "AB cd, ef-gh 12"]
    for t, s in zip(texts, model.score(texts), strict=True):
        got = [plain_bucket(g) for g in plain_bag(t)]
        b, c = subwords.bag(t)
        assert sorted(got) == np.repeat(b, c).tolist()
        z = (sum(float(model.weight[g]) for g in got) / max(len(got), 1)) + model.bias
        assert s == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_training_step_equals_a_plain_gradient_step():
    rng = np.random.default_rng(0)
    bags = [(i % 2, np.sort(rng.choice(30, 8, False)).astype(np.int32), rng.integers(1, 4, 8).astype(np.uint16)) for i in range(12)]
    model = train(bags, steps=3, least=1, batch=12, dim=2, seed=5)
    # The same three Adagrad steps on dense arrays.
    draw = np.random.default_rng(5)
    seen = sorted({int(x) for _, b, _ in bags for x in b})
    order = draw.permutation(12)
    x = np.zeros((12, len(seen)))
    for k, i in enumerate(order):
        for b, c in zip(bags[i][1], bags[i][2], strict=True):
            x[k, seen.index(b)] = 50 * c / bags[i][2].sum()
    y = np.array([bags[i][0] for i in order])
    vec, soft, bias = draw.normal(0, 0.01, (len(seen), 2)), draw.normal(0, 0.5, (2, 2)), np.zeros(2)
    sums = [np.full_like(v, 1e-8) for v in (vec, soft, bias)]
    for _ in range(3):
        draw.permutation(1)
        mean = x @ vec
        z = mean @ soft + bias
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        p[np.arange(12), y] -= 1
        p /= 12
        grads = [x.T @ (p @ soft.T) + 5e-5 * vec, mean.T @ p, p.sum(0)]
        for v, s, g in zip((vec, soft, bias), sums, grads, strict=True):
            s += g * g
            v -= 0.1 * g / np.sqrt(s)
    want = np.zeros(1 << subwords.BITS)
    want[seen] = 50 * (vec @ (soft[:, 1] - soft[:, 0]))
    assert np.allclose(model.weight, want, rtol=2e-3, atol=2e-3) and model.bias == pytest.approx(bias[1] - bias[0], abs=1e-3)
