"""BagMinHash near-duplicates (1) and components against brute force."""

import random
from collections import Counter, defaultdict
import re

import numpy as np
from faultline.llm import shingles
from faultline.llm.bagminhash import signatures
from faultline.llm.bpe import mix
from faultline.llm.graph import components
from faultline.llm.near_dedup import near_duplicates

FOLD = {i: i + 32 for i in range(65, 91)}


def bag(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    return Counter([tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def classes(rows):
    """Least id of each row's component, rows given as (id, text) with ids."""
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    bags = [bag(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] or "") == (rows[j][1] or "") or jaccard(bags[i], bags[j]) >= 0.8:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    return [min(least[find(k)]) for k in range(len(rows))]


def test_registers_agree_as_often_as_weights_overlap():
    rng = random.Random(2)
    for most in (1, 3, 9, 200, 5000):
        a = {k: rng.randint(1, most) for k in rng.sample(range(60), 40)}
        b = {k: v if rng.random() < .6 else rng.randint(1, most) for k, v in a.items()}
        own = np.repeat([0, 1], [len(a), len(b)])
        s = signatures(own, mix(np.array([*a, *b], np.uint64) + np.uint64(9)), np.array([*a.values(), *b.values()]), 2, 4096)
        want = jaccard(Counter(a), Counter(b))
        assert abs((s[0] == s[1]).mean() - want) < 5 * (want * (1 - want) / 4096) ** .5 + 1e-9


def test_overlap_equals_multisets():
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["", "x", "Three Words Here", "é ü ß."]
    got = shingles.overlap(texts, texts[::-1])
    assert np.allclose(got, [jaccard(bag(x), bag(y)) for x, y in zip(texts, texts[::-1], strict=True)])


def test_components(spark):
    rng = random.Random(6)
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(200, 400)]
    some = [(rng.randint(1000, 1200), rng.randint(1000, 1200)) for _ in range(120)]
    links = path + star + some + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            up[find(a)] = find(b)
    assert set(got) == set(up)
    pairs = {(find(n), r) for n, r in got.items()}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def planted(rng):
    def words(n):
        return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]

    def edited(w, k):
        w = list(w)
        for i in rng.sample(range(len(w)), k):
            w[i] = "".join(rng.choice("klmnop") for _ in range(5))
        return w

    rows, n = [], 0
    shared = words(30)
    for size in (6, 12, 40, 150, 400):
        for _ in range(4):
            base = words(size)
            for k in (0, 0, 1, 2, size // 40, size // 25, size // 10):
                rows.append((rng.randint(1, 10 ** 6) * 10 + n % 10, " ".join(edited(base, min(k, size)))))
                n += 1
    hub = words(200)                                  # many copies of one text that differ from each other
    rows += [(10 ** 8 + i, " ".join(edited(hub, rng.randint(1, 6)))) for i in range(120)]
    rows += [(2 * 10 ** 8 + i, " ".join(shared + words(20))) for i in range(40)]       # a passage in common, no copies
    rows += [(3 * 10 ** 8 + i, "spam " * (500 + i)) for i in range(10)]                # weights decide
    return rows


def test_classes_equal_brute_force(spark):
    rows = planted(random.Random(8))
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    want = dict(zip([i for i, _ in rows], classes(rows), strict=True))
    assert len(got) == len(rows) and {i: r.class_id for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())


def test_tiles_and_rounds_give_the_same(spark, monkeypatch):
    import faultline.llm.near_dedup as nd
    rows = planted(random.Random(9))[-170:]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = dict(zip([i for i, _ in rows], classes(rows), strict=True))
    monkeypatch.setattr(nd, "TILE", 8)
    assert {r.doc_id: r.class_id for r in near_duplicates(df, hub_rounds=1).collect()} == want


def test_edges(spark):
    text = "one two three four five six seven eight"
    rows = [(4, None), (3, ""), (9, "!!"), (8, "!!"), (7, text), (7, text), (None, text), (6, text.upper()), (None, "alone here"), (2, "a b"), (1, "A, b")]
    df = spark.createDataFrame([(i, t, b"x", "y") for i, t in rows], "doc_id long, text string, h binary, key string")
    got = Counter((r.doc_id, r.class_id, r.kept) for r in near_duplicates(df).collect())
    assert got == Counter({(4, 3, False): 1, (3, 3, True): 1, (9, 8, False): 1, (8, 8, True): 1, (7, 6, False): 2, (None, 6, False): 1,
                           (6, 6, True): 1, (None, None, False): 1, (2, 1, False): 1, (1, 1, True): 1})
    assert near_duplicates(df.where("false")).count() == 0
