"""Conversation repair (11) against all edit sequences of small conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from conftest import SF01
from faultline.llm import conversation_repair as cr
from faultline.llm.catalog import op11_conversation_repair

SHAPE = re.compile(r"(s?(ua)+)?")
FIELDS = "conv_id long, turn int, role string, text string"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        inner = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not inner else "duplicate" if (role, text) in seen else "" if inner[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def every_repair(rows):
    """Least (cost, audit, turns) over all ways of editing ``rows``, inserting at most two turns at a place."""
    best, bad = None, faults(rows)
    gap = ["", "u", "a", "ua", "au"]
    choices = [["D"] if b in ("blank", "duplicate") else ["D", "K", "u", "a"] for b in bad]
    for gaps in itertools.product(gap, repeat=len(rows) + 1):
        for edits in itertools.product(*choices):
            cost, audit, turns = 0, "", []
            for i, g in enumerate(gaps):
                cost, audit = cost + 3 * len(g), audit + "I" * len(g)
                turns += [({"u": "user", "a": "assistant"}[x], "") for x in g]
                if i < len(rows):
                    e = edits[i]
                    cost += {"D": 4, "K": 0}.get(e, 3) + (3 if e != "D" and bad[i] == "truncated" else 0)
                    audit += e if e in "DK" else "R"
                    if e != "D":
                        turns.append(({"u": "user", "a": "assistant"}.get(e, rows[i][0]), rows[i][1]))
            if SHAPE.fullmatch("".join(r[:1] for r, _ in turns)) and all(r for r, _ in turns) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, turns)
    return best


def dynamic(rows):
    """The same by plain dynamic programming over the four states, for longer conversations."""
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def closed(layer):
        out = dict(layer)
        for _ in range(4):
            for q, (c, a) in list(out.items()):
                for r in "ua":
                    if (q, r) in step:
                        new = (c + 3, a + "I")
                        if step[q, r] not in out or new < out[step[q, r]]:
                            out[step[q, r]] = new
        return out

    layer = closed({"0": (0, "")})
    for (role, _), b in zip(rows, faults(rows), strict=True):
        nxt = {}

        def put(q, v):
            if q not in nxt or v < nxt[q]:
                nxt[q] = v
        for q, (c, a) in layer.items():
            put(q, (c + 4, a + "D"))
            if b not in ("blank", "duplicate"):
                c += 3 if b == "truncated" else 0
                if (q, role[:1]) in step:
                    put(step[q, role[:1]], (c, a + "K"))
                for r in "ua":
                    if (q, r) in step:
                        put(step[q, r], (c + 3, a + "R"))
        layer = closed(nxt)
    return min(layer[q] for q in "0a" if q in layer)


def report(rows):
    """Expected row of a conversation from its rows (turn, role, text) after damage, in order."""
    bad = faults([r[1:] for r in rows])
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = dynamic([r[1:] for r in rows])
    text = "\n".join(f"{r}:{t}" for _, r, t in cr.rewritten([r[1:] for r in rows], audit))
    return (gaps, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"), illegal, cost, audit,
            hashlib.sha256(text.encode()).hexdigest())


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        out += [(conv, turn, "user" if n == 4 else role, text)] * (0 if n == 0 else 2 if n == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def expected(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    return {c: report([r[1:] for r in damaged(own)]) for c, own in convs.items()}


ROLES = ["user", "assistant", "system", "tool", "u", "", "Admin"]
TEXTS = ["Yes.", "no", "Hm?", "", " \t", "x. ", "Yes.", "é!"]


def test_lightest_repair_equals_all_edit_sequences():
    rng = random.Random(5)
    for _ in range(150):
        rows = [(rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(rng.randint(0, 3))]
        cost, audit, turns = every_repair(rows)
        light = [(r[:1], {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}[b]) for (r, _), b in zip(rows, faults(rows), strict=True)]
        assert cr.best_repair(light) == (cost, audit) == dynamic(rows)
        assert [x[1:] for x in cr.rewritten(rows, audit)] == turns


@pytest.mark.parametrize("span", [1, 2, 7])
def test_spans_give_the_same_repair(monkeypatch, span):
    monkeypatch.setattr(cr, "SPAN", span)
    monkeypatch.setattr(cr, "FAN", 3)
    rng = random.Random(span)
    for n in [0, 1, 5, 23, 60]:
        rows = [(rng.choice(ROLES[:4]), f"{i}{rng.choice(['.', '', '?'])}") for i in range(n)]
        light = [(r[:1], 0 if t[-1] in ".?" else 3) for r, t in rows]
        assert cr.best_repair(light) == dynamic(rows)


def rows_of(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, longest)):
            turn = rng.choice([t, t, t, t + 1, None])
            rows.append((c, turn, rng.choice(ROLES + [None]), rng.choice(TEXTS + [f"{c} {t}.", f"{t} {c}!", None])))
    rows += [(None, 1, "user", "a."), (None, None, None, None), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize("limit", [4096, 3])
def test_query_equals_plain_version(spark, monkeypatch, limit):
    monkeypatch.setattr(cr, "ROWS", limit)                # 3: nearly all go by spans
    monkeypatch.setattr(cr, "FAN", 2)
    rows = rows_of(1, 40, 9)
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], FIELDS + ", copies int, c string").repartition(3)
    got = {r.conv_id: tuple(r)[1:] for r in cr.repair_conversations(cr.damage(df)).collect()}
    assert got == expected(rows)


def test_repaired_turns_and_long_conversations(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(1, i, rng.choice(ROLES[:3]), rng.choice(["Same.", f"{i} ok.", f"{i} cut", ""])) for i in range(3000)]
    rows += [(2, i, "user" if i % 2 == 0 else "assistant", "Fine.") for i in range(3)]
    df = spark.createDataFrame(rows, FIELDS)
    whole = {r.conv_id: tuple(r)[1:] for r in cr.repair_conversations(cr.undamaged(df)).collect()}
    assert whole == {c: report([r[1:] for r in rows if r[0] == c]) for c in (1, 2)}
    monkeypatch.setattr(cr, "ROWS", 100)
    cut = {r.conv_id: tuple(r)[1:] for r in cr.repair_conversations(cr.undamaged(df)).collect()}
    assert cut == whole
    for limit in (100, 9999):
        monkeypatch.setattr(cr, "ROWS", limit)
        turns = sorted((r.conv_id, r.place, r.edit, r.role, r.text) for r in cr.repair_conversations(cr.undamaged(df), turns=True).collect())
        for c in (1, 2):
            own = [r[2:] for r in turns if r[0] == c]
            assert own == list(cr.rewritten([r[2:] for r in rows if r[0] == c], whole[c][6]))


def test_empty_and_dropped(spark):
    assert cr.repair_conversations(cr.damage(spark.createDataFrame([], FIELDS))).count() == 0
    gone = next(t for t in range(100) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    got = cr.repair_conversations(cr.damage(spark.createDataFrame([(7, gone, "user", "a.")], FIELDS))).collect()
    assert [tuple(r) for r in got] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    long = "word " * 2_000_000
    got = cr.repair_conversations(cr.undamaged(spark.createDataFrame([(1, 0, "user", long + "end."), (1, 1, "assistant", "Yes.")], FIELDS))).first()
    assert got.audit == "KK" and got.repaired_sha256 == hashlib.sha256(f"user:{long}end.\nassistant:Yes.".encode()).hexdigest()


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF01}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in op11_conversation_repair(spark, SF01).collect()}
    assert got == expected(rows)
