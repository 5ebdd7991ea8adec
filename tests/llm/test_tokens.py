"""Token counts (4), concatenate-and-cut packing (6) and packed matrices (7) against the library's own ids."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from faultline.llm.bpe import ByteBpe, token_path
from faultline.llm.packed_matrix import best_fit, pack_matrix
from faultline.llm.packing import pack_concat
from faultline.llm.token_counts import count_tokens
from pyspark.sql import functions as F
from tokenizers import Tokenizer

NAME = "byte_bpe_50k.json"
ROWS = [(1, "The cat's don't we'll  I'VE\n\n x"), (2, None), (3, ""), (4, "é中 ½ 1234 ###$$$"), (None, "no id"), (5, "same"), (5, "same"),
        (6, "a <|endoftext|> b"), (7, "word " * 3000), (8, "x" * 5000), (9, " \t\r\n ")]


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(token_path(NAME))


def frame(spark, rows):
    # further columns with names that the operators use themselves
    return (spark.createDataFrame([(i, t, "k", 7) for i, t in rows], "doc_id long, text string, ids string, n int")
            .withColumn("part", F.lit(1)).repartition(3))


def ids(lib, t):
    return lib.encode(t or "", add_special_tokens=False).ids


def test_ids_equal_the_library(lib):
    rng, bpe = random.Random(5), ByteBpe.get(token_path(NAME))
    assert bpe.fast
    near = " '\n\t  sstmdrevlla A1²½é中ͤ\u0085\x1c!?'"
    texts = ["".join(rng.choice(near) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF), 32, 97, 39])) for _ in range(20)) for _ in range(500)]
    texts += ["x" * 20000, " " * 20000, "ab " * 500_000, "<|endoftext|>"]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in bpe.encode(texts)] == want
    assert bpe.count(texts)[0].tolist() == [len(w) for w in want]


def test_every_whole_entry_is_one_token(lib):
    bpe = ByteBpe.get(token_path(NAME))
    some = random.Random(1).sample(sorted(bpe.whole), 500)
    assert all(lib.encode(s, add_special_tokens=False).ids == [bpe.whole[s]] for s in some)


def test_another_kind_of_file_is_left_to_the_library():
    path = token_path("word_bpe_49k.json")
    other, bpe = Tokenizer.from_file(path), ByteBpe.get(path)
    texts = ["Hello World", "", "don't 12"]
    assert not bpe.fast
    assert [x.tolist() for x in bpe.encode(texts)] == [other.encode(t, add_special_tokens=False).ids for t in texts]


def test_counts(spark, lib):
    got = count_tokens(frame(spark, ROWS)).collect()
    want = sorted((str(i), len((t or "").encode()), len(ids(lib, t)), len(ids(lib, t)) > 1024) for i, t in ROWS)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert all(0 <= r.n_whole <= r.n_tokens for r in got)
    assert count_tokens(frame(spark, ROWS).where("false")).count() == 0


@pytest.mark.parametrize("width", [7, 1024])
def test_concat_round_trip(spark, lib, width):
    got = pack_concat(frame(spark, ROWS), width=width).collect()
    seqs = defaultdict(list)
    for r in got:
        assert len(r.ids) == 4 * r.length
        seqs[r.sequence_id].append((r.offset, r.length))
    fill = {}
    for s, parts in seqs.items():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        fill[s] = end
    assert sorted(fill) == list(range(len(fill)))
    assert all(fill[s] == width for s in list(range(len(fill)))[:-1])
    docs = defaultdict(list)
    for r in got:
        docs[r.doc_id].append((r.start, bytes(r.ids), r.doc_tokens))
    for i, t in ROWS:
        want = np.array([*ids(lib, t), 0], "<u4").tobytes()
        copies = sum(x == i for x, _ in ROWS)
        assert b"".join(x for _, x, _ in sorted(docs[i]))[:len(want)] == want or copies > 1
        assert sum(len(x) for _, x, _ in docs[i]) == len(want) * copies and {n for *_, n in docs[i]} == {len(want) // 4}
    assert pack_concat(frame(spark, ROWS).where("false")).count() == 0


def test_pack_query_columns(spark, lib):
    from conftest import SF001
    from faultline.llm.catalog import op6_packing
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    for r in op6_packing(spark, SF001).collect():
        own = np.array([*ids(lib, text[r.doc_id]), 0], "<u4")
        assert zlib.crc32(own[r.start:r.start + r.length].tobytes()) == r.ids_crc32 and len(own) == r.doc_tokens


def test_best_fit_against_a_plain_search():
    rng = random.Random(3)
    for _ in range(50):
        width = rng.randint(1, 40)
        sizes = [rng.randint(1, width) for _ in range(rng.randint(0, 60))]
        bins = best_fit(sizes, width)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        free = []
        for n in sorted(sizes, reverse=True):
            fit = [f for f in free if f >= n]
            if fit:
                free.remove(min(fit))
                free.append(min(fit) - n)
            else:
                free.append(width - n)
        assert sorted(width - sum(sizes[i] for i in b) for b in bins) == sorted(free)


@pytest.mark.parametrize("width,block", [(16, 1 << 22), (1024, 500)])
def test_matrix_round_trip(spark, lib, width, block):
    got = pack_matrix(frame(spark, ROWS), width=width, block=block, pad=9).collect()
    assert len({r.sequence_id for r in got}) == len(got)
    docs = defaultdict(list)
    for r in got:
        row, pos = np.frombuffer(bytes(r.input_ids), "<u4"), np.frombuffer(bytes(r.position_ids), "<u2")
        assert len(row) == width and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and (row[r.n_tokens:] == 9).all()
        assert r.resets == r.cu_seqlens[:-1]
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert pos[a:b].tolist() == list(range(b - a))
            docs[d].append((s, row[a:b].tolist()))
    for i, t in ROWS:
        want = [*ids(lib, t), 0]
        if sum(x == i for x, _ in ROWS) == 1:
            assert [x for _, p in sorted(docs[i]) for x in p] == want
        else:
            assert sorted(p for _, p in docs[i]) == [want, want]
    assert pack_matrix(frame(spark, ROWS).where("false")).count() == 0
