"""Conversation prefix trie (12) against all beginnings, counted one by one."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF01
from faultline.llm import conversation_trie as ct
from faultline.llm.catalog import op12_conversation_trie

FIELDS = "conv_id long, turn int, role string, text string"


def plain(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {}
    for c, v in convs.items():
        v.sort(key=lambda y: (y[:3], hashlib.sha256(f"{len(y[2])}:{y[2]}{y[3]}".encode()).hexdigest()))
        own[c] = [(y[2], y[3]) for y in v]
    built = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + x[h:]
    members = {}
    for c, x in built.items():
        for d in range(len(x) + 1):
            members.setdefault(tuple(x[:d]), []).append(c)
    cost = {k: (len(m) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0) for k, m in members.items()}
    kids, leaves, saved = ({k: 0 for k in members} for _ in range(3))
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k in members:
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += cost[k]
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def trie(df):
    return ct.prefix_trie(ct.rebuilt(ct.conversation_paths(df)))


def rows_of(seed, convs):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(convs * 2), convs):
        hot = rng.random() < 0.3
        for t in range(3 if hot else rng.randint(1, 7)):
            text = f"hot {t}" if hot else rng.choice(["a b", "a b", "c", "", None, "ü x y"])
            rows.append((c, rng.choice([t, t, None]) if not hot else t, rng.choice(["user", "assistant", None]) if not hot else "user", text))
    return rows + [(None, 1, "user", "x"), rows[0], rows[0]]


@pytest.mark.parametrize("paths", [4096, 8])
def test_every_beginning(spark, monkeypatch, paths):
    monkeypatch.setattr(ct, "PATHS", paths)               # 8: several levels of spines
    monkeypatch.setattr(ct, "LEAST_PATHS", 2)
    monkeypatch.setattr(ct, "IDS", 5)
    rows = rows_of(paths, 220)
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], FIELDS + ", c string, w int").repartition(5)
    assert found(trie(df)) == plain(rows)


def test_small_shards_by_nodes(spark, monkeypatch):
    monkeypatch.setattr(ct, "PATHS", 16)
    monkeypatch.setattr(ct, "LEAST_PATHS", 4)
    monkeypatch.setattr(ct, "NODES", 10)
    rows = [(c, t, "user", f"{t}" if t < 30 else f"{c}") for c in range(40) for t in range(30 + c % 4)]
    assert found(trie(spark.createDataFrame(rows, FIELDS))) == plain(rows)


def test_find_close_against_a_stack():
    rng = np.random.default_rng(2)
    for n in (1, 2, 31, 33, 64, 1000, 5000):
        for top in (1, 3, 50, 10_000):
            depth = [0]
            for _ in range(n - 1):
                depth.append(int(rng.integers(max(1, depth[-1] + 1 - rng.integers(1, 4)), min(top, depth[-1] + 1) + 1)) if top > 1 else 1)
            depth = np.array(depth)
            want = [next((j for j in range(i + 1, n) if depth[j] <= depth[i]), n) - i for i in range(n)]
            assert ct.subtree_sizes(depth).tolist() == want


def test_edges(spark):
    assert trie(spark.createDataFrame([], FIELDS)).count() == 0
    assert trie(spark.createDataFrame([(None, 0, "user", "a")], FIELDS)).count() == 0
    rows = [(1, None, None, None), (2, 1, "user", "word " * 500_000)]
    assert found(trie(spark.createDataFrame(rows, FIELDS))) == plain(rows)
    # 21 begins with turns of 20; 41's are missing, as 40 is absent.
    rows = [(20, t, "user", f"x{t}") for t in range(2)] + [(c, t, "user", f"{c} {t}") for c in (21, 22, 23, 24, 41, 42, 43, 44, 45) for t in range(2)]
    assert found(trie(spark.createDataFrame(rows, FIELDS))) == plain(rows)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF01}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(op12_conversation_trie(spark, SF01)) == plain(rows)
