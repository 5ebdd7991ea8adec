"""Conversation structure repair (11): Knuth's lightest derivations.

A repaired conversation's role initials read ``(s?(ua)+)?``.  Repairing is a
weighted deduction system: an item ``(rows read, state of the role pattern)``
costs ``(cost, audit)``, the sum of its edits' costs and their initials in order;
keeping, reroling, deleting or inserting leads from one item to another.  These
functions are monotone and superior (equal costs of one item never go with an
audit that begins the other, as each edit has its cost), so an agenda that pops
the least ``(cost, audit)`` finalises each item once, and the first goal popped
is the lightest repair.

Conversations of more than ``ROWS`` rows or ``CHARS`` characters are cut into
spans of ``SPAN`` rows.  A span's items are ``state -> state``; spans are joined
by the same agenda, ``FAN`` at a time, round by round, so no task holds more than
a few spans, and the result does not depend on the cut.  What a long
conversation's last step streams, row by row, are its texts; the audit is one value.
"""

from __future__ import annotations

import hashlib
import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.arrow import pieces
from faultline.session import cut_lineage

SPACE = " \t\n\x0b\x0c\r"
SPAN = 512                        # a power of two
FAN = 16
ROWS, CHARS = 4096, 1 << 23       # beyond, a conversation is cut into spans
# Fixed values of the repair: costs of the edits, and the role pattern's states.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
GOALS = (START, ASSISTANT)
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}
GOOD, BLANK, DUPLICATE, CUT = range(4)


def wanted(state: int) -> str:
    """The role that an inserted or reroled turn gets after ``state``."""
    return "assistant" if state == USER else "user"


def fault(text: str, seen: bool) -> int:
    """First fault of a row: blank, duplicate, truncated or none."""
    end = text.rstrip(SPACE)
    return BLANK if not end else DUPLICATE if seen else GOOD if end[-1] in ".!?" else CUT


def lightest(rows: list[tuple[str, int]], start: int = START, goal: bool = False) -> dict:
    """``{state: (cost, audit)}`` of the lightest ways through ``rows`` (role initial, fault) from ``start``.

    With ``goal`` the agenda stops at the first goal item and gives it alone.
    """
    done, ends = set(), {}
    agenda = [(0, "", 0, start)]
    while agenda:
        cost, audit, i, q = heapq.heappop(agenda)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == len(rows):
            if goal and q in GOALS:
                return {q: (cost, audit)}
            ends[q] = (cost, audit)
        else:
            first, bad = rows[i]
            heapq.heappush(agenda, (cost + DELETE, audit + "D", i + 1, q))
            if bad not in (BLANK, DUPLICATE):
                more = TRUNCATED if bad == CUT else 0
                if q in AFTER.get(first, ()):
                    heapq.heappush(agenda, (cost + more, audit + "K", i + 1, AFTER[first][q]))
                heapq.heappush(agenda, (cost + more + REROLE, audit + "R", i + 1, AFTER[wanted(q)[0]][q]))
        heapq.heappush(agenda, (cost + INSERT, audit + "I", i, AFTER[wanted(q)[0]][q]))
    return ends


def joined(spans: list[dict]) -> dict:
    """``{(start, end): (cost, audit)}`` of spans in a row, each such a dictionary itself."""
    out = {}
    for start in sorted({q for q, _ in spans[0]}):
        done, agenda = set(), [(0, "", 0, start)]
        while agenda:
            cost, audit, k, q = heapq.heappop(agenda)
            if (k, q) in done:
                continue
            done.add((k, q))
            if k == len(spans):
                out[start, q] = (cost, audit)
                continue
            for (p, end), (more, letters) in spans[k].items():
                if p == q and (k + 1, end) not in done:
                    heapq.heappush(agenda, (cost + more, audit + letters, k + 1, end))
    return out


def whole_span(rows: list[tuple[str, int]]) -> dict:
    """All items ``state -> state`` of one span."""
    return {(q, p): v for q in (START, SYSTEM, USER, ASSISTANT) for p, v in lightest(rows, q).items()}


def best_repair(rows: list[tuple[str, int]]) -> tuple[int, str]:
    if len(rows) <= SPAN:
        ends = lightest(rows, goal=True)
        return min(ends.values())
    parts = [whole_span(rows[lo:lo + SPAN]) for lo in range(0, len(rows), SPAN)]
    while len(parts) > 1:
        parts = [joined(parts[lo:lo + FAN]) for lo in range(0, len(parts), FAN)]
    return min(v for (q, p), v in parts[0].items() if q == START and p in GOALS)


def rewritten(rows, audit: str):
    """The repaired ``(edit, role, text)`` of ``rows`` (role, text), as the edits of ``audit`` say."""
    state, at = START, 0

    def inserted():
        nonlocal state, at
        while audit[at:at + 1] == "I":
            role = wanted(state)
            state, at = AFTER[role[0]][state], at + 1
            yield "I", role, ""

    for role, text in rows:
        yield from inserted()
        edit, at = audit[at], at + 1
        if edit == "D":
            continue
        role = role if edit == "K" else wanted(state)
        state = AFTER[role[:1]][state]
        yield edit, role, text
    yield from inserted()


@dataclass
class Tally:
    """Counts of rows in order; two in a row can be joined."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None       # role initials at both ends
    last: str | None = None
    low: int | None = None         # turns at both ends, nulls left out
    high: int | None = None
    turns: int = 0                 # distinct ones
    items: dict = field(default_factory=dict)

    def add(self, turn, initial: str, bad: int) -> None:
        self.blank += bad == BLANK
        self.duplicate += bad == DUPLICATE
        self.truncated += bad == CUT
        self.illegal += self.last is not None and self.last + initial not in LEGAL
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None:
            self.turns += turn != self.high or self.low is None
            self.low, self.high = turn if self.low is None else self.low, turn

    def join(self, o: "Tally") -> None:
        if o.first is None:
            return
        self.illegal += o.illegal + (self.last is not None and self.last + o.first not in LEGAL)
        self.blank, self.duplicate, self.truncated = self.blank + o.blank, self.duplicate + o.duplicate, self.truncated + o.truncated
        self.first, self.last = o.first if self.first is None else self.first, o.last
        if o.low is not None:
            self.turns += o.turns - (self.low is not None and self.high == o.low)
            self.low, self.high = o.low if self.low is None else self.low, o.high

    def counts(self) -> list[int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal]


REPORT = [T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
REPORT += [T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]
TURNS = [T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()),
         T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]


def digest(turns) -> str:
    """SHA-256 of ``role:text`` lines joined by newlines, read once."""
    h, first = hashlib.sha256(), True
    for _, role, text in turns:
        h.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
        first = False
    return h.hexdigest()


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(c, t, role, text, copies)``: rows with the faults that the checksum of ``conv:turn`` names.

    Null conversation, turn, role or text stand as one space in the checksum and in the
    texts; conversation and turn themselves stay null.
    """
    blank = F.lit(" ")
    n = F.crc32(F.concat(F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"),
                         F.coalesce(F.col(turn).cast("string"), blank)).cast("binary")) % 20
    own = F.coalesce(F.col(text), blank)
    return rows.select(
        F.col(conv).alias("c"), F.col(turn).alias("t"),
        F.when(n == 4, F.lit("user")).otherwise(F.coalesce(F.col(role), blank)).alias("role"),
        F.when(n == 1, F.lit("")).when(n == 2, F.regexp_replace(own, "[.!?]", "")).otherwise(own).alias("text"),
        F.when(n == 0, 0).when(n == 3, 2).otherwise(1).alias("copies"))


def undamaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(c, t, role, text, copies)`` of rows as they are; null role or text is one space."""
    return rows.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                       F.coalesce(F.col(text), F.lit(" ")).alias("text"), F.lit(1).alias("copies"))


def _outcome(schema, turns: bool, key, tally: Tally, cost: int, audit: str, rows):
    if turns:
        for place, (edit, role, text) in enumerate(rewritten(rows, audit)):
            yield (key, place, edit, role, text)
    else:
        yield (key, *tally.counts(), cost, audit, digest(rewritten(rows, audit)))


def _batches(rows, schema: T.StructType, size: int = 1 << 22):
    """Arrow batches of row tuples, each of about ``size`` characters at most."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    kind, held, total = to_arrow_schema(schema), [], 0

    def batch():
        cols = list(zip(*held, strict=True)) or [()] * len(kind)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind, strict=True)], schema=kind)

    for r in rows:
        held.append(r)
        total += 64 + sum(len(x) for x in r if isinstance(x, str))
        if total > size:
            yield batch()
            held, total = [], 0
    yield batch()


def _short(rows: DataFrame, schema: T.StructType, turns: bool) -> DataFrame:
    """Conversations of at most ``ROWS`` rows: one bounded group each, streamed from a sorted partition."""
    sorted_ = rows.repartition("c").sortWithinPartitions("c", "t", "role", "text").select("c", "t", "role", "text", "copies")

    def one(key, own):
        tally, seen, light, kept = Tally(), set(), [], []
        for t, role, text, copies in own:
            for _ in range(copies):
                bad = fault(text, (role, text) in seen)
                seen.add((role, text))
                tally.add(t, role[:1], bad)
                light.append((role[:1], bad))
                kept.append((role, text))
        cost, audit = best_repair(light)
        yield from _outcome(schema, turns, key, tally, cost, audit, kept)

    def stream(batches):
        def rows_out():
            key, own, any_ = None, [], False
            for b in pieces(batches):
                for c, *row in zip(*(col.to_pylist() for col in b.columns), strict=True):
                    if any_ and c != key:
                        yield from one(key, own)
                        own = []
                    key, any_ = c, True
                    own.append(row)
            if any_:
                yield from one(key, own)
        yield from _batches(rows_out(), schema)

    return sorted_.mapInArrow(stream, schema)


ITEMS = "array<struct<q int, p int, cost long, audit string>>"
SPANS = ("blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, "
         f"items {ITEMS}")


def _span_row(tally: Tally, head: list) -> list:
    items = [{"q": q, "p": p, "cost": c, "audit": a} for (q, p), (c, a) in tally.items.items()]
    return [*head, tally.blank, tally.duplicate, tally.truncated, tally.illegal, tally.first, tally.last,
            tally.low, tally.high, tally.turns, items]


def _span(row: dict) -> Tally:
    t = Tally(row["blank"], row["duplicate"], row["truncated"], row["illegal"], row["first"], row["last"], row["low"], row["high"], row["turns"])
    t.items = {(x["q"], x["p"]): (x["cost"], x["audit"]) for x in row["items"]}
    return t


def _long(rows: DataFrame, schema: T.StructType, turns: bool) -> DataFrame:
    """Conversations of any length: ranges of rows, spans of a range, joined round by round."""
    kind = rows.schema["c"].dataType
    each = rows.where("copies > 0").select("c", "t", "role", "text", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    order = ["c", "t", "role", "text", "copy"]
    placed = cut_lineage(each.repartitionByRange(*order).sortWithinPartitions(*order)
                         .select("c", "t", "role", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("i")))
    # The first of equal rows: the least place, one partially aggregated minimum per distinct row.
    firsts = placed.groupBy("c", "role", F.sha2("text", 256).alias("h")).agg(F.min("i").alias("i")).select("i", F.lit(True).alias("new"))
    end = F.regexp_extract(F.col("text"), r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    light = placed.select("c", "t", "part", "i", F.substring("role", 1, 1).alias("first"), end.alias("end")).join(firsts, "i", "left").select(
        "c", "part", F.shiftright(F.col("i").bitwiseAND((1 << 33) - 1), SPAN.bit_length() - 1).alias("span"), "i", "t", "first",
        F.when(F.col("end") == "", BLANK).when(F.col("new").isNull(), DUPLICATE).when(F.col("end").isin(".", "!", "?"), GOOD)
        .otherwise(CUT).alias("bad"))

    fields = T.StructType([T.StructField("c", kind), *T.StructType.fromDDL("part int, span long, " + SPANS).fields])

    def out(tally, *head):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        return pa.Table.from_pylist([dict(zip(fields.names, _span_row(tally, list(head)), strict=True))], schema=to_arrow_schema(fields))

    def read(key, table):
        tally, own = Tally(), []
        for r in table.sort_by("i").to_pylist():
            tally.add(r["t"], r["first"], r["bad"])
            own.append((r["first"], r["bad"]))
        tally.items = whole_span(own)
        return out(tally, *(k.as_py() for k in key))

    spans = cut_lineage(light.groupBy("c", "part", "span").applyInArrow(read, fields))

    def fold(key, table):
        own = [_span(r) for r in table.sort_by([("part", "ascending"), ("span", "ascending")]).to_pylist()]
        tally = own[0]
        for o in own[1:]:
            tally.join(o)
        tally.items = joined([o.items for o in own]) if len(own) > 1 else own[0].items
        part, up = key[1].as_py(), key[2].as_py()
        return out(tally, key[0].as_py(), up if part < 0 else part, 0 if part < 0 else up)

    # Spans of a range first (span // FAN until one is left), then ranges.
    top = spans.agg(F.max("span").alias("s"), F.max("part").alias("p")).first()
    n = top["s"] or 0
    while n:
        spans = cut_lineage(spans.groupBy("c", "part", F.expr(f"span div {FAN}").alias("up")).applyInArrow(fold, fields))
        n //= FAN
    n = top["p"] or 0
    while n:
        spans = cut_lineage(spans.groupBy("c", F.lit(-1).alias("_"), F.expr(f"part div {FAN}").alias("up"))
                            .applyInArrow(fold, fields))
        n //= FAN

    goal = F.array_min(F.transform(F.filter("items", lambda x: (x["q"] == START) & x["p"].isin(*GOALS)),
                                   lambda x: F.struct(x["cost"], x["audit"])))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    ready = cut_lineage(spans.withColumn("g", goal).select("c", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal",
                                                           F.col("g.cost").alias("cost"), F.col("g.audit").alias("audit")))
    # A conversation's audit, then its rows in order, streamed.
    head = ready.select("c", F.lit(-1).cast("long").alias("i"), "audit", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    told = head.unionByName(placed.select("c", "i", F.lit(None).cast("string").alias("audit"), "role", "text"))
    last = T.StructType([schema.fields[0], *(TURNS if turns else [T.StructField("repaired_sha256", T.StringType())])])

    def stream(batches):
        rows_in = ((b, r) for b in pieces(batches) for r in zip(*(col.to_pylist() for col in b.columns), strict=True))

        def rows_out():
            nxt = next(rows_in, None)
            while nxt is not None:
                key, _, audit, _, _ = nxt[1]
                nxt = None

                def own():
                    nonlocal nxt
                    for item in rows_in:
                        if item[1][2] is not None:
                            nxt = item
                            return
                        yield item[1][3], item[1][4]

                if turns:
                    for place, (edit, role, text) in enumerate(rewritten(own(), audit)):
                        yield (key, place, edit, role, text)
                else:
                    yield (key, digest(rewritten(own(), audit)))
        yield from _batches(rows_out(), last)

    done = told.repartition("c").sortWithinPartitions("c", "i").select("c", "i", "audit", "role", "text").mapInArrow(stream, last)
    if turns:
        return done
    hashes = cut_lineage(done).withColumnRenamed(schema.fields[0].name, "c2")
    return ready.join(hashes, F.col("c").eqNullSafe(F.col("c2"))).select(F.col("c").alias(schema.fields[0].name), *[f.name for f in REPORT])


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turns: bool = False) -> DataFrame:
    """Lightest repair of each conversation; ``rows`` are those of ``damage`` or ``undamaged``.

    One row per conversation: gaps in its turns, blank, duplicate and truncated rows (the
    first fault of each), adjacent role initials that the pattern forbids, cost and
    audit of the lightest repair (ties: the least audit by code point), and the SHA-256 of the repaired
    ``role:text`` lines.  With ``turns`` the repaired rows themselves: ``(place, edit, role, text)``.

    Rows stand by turn (nulls first), then role, then text.  A null id is a
    conversation of its own; one whose rows have all been dropped has zeros, an
    empty audit and the empty text's hash.  An empty role fits nowhere and is
    reroled or deleted.  Further columns are not read; an empty table gives no rows.
    """
    # One column called conv of the input's type, however it is called inside.
    schema = T.StructType([T.StructField(conv, rows.schema["c"].dataType), *(TURNS if turns else REPORT)])
    size = rows.groupBy("c").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.length("text")).alias("chars"))
    big = cut_lineage(size.where((F.col("n") > ROWS) | (F.col("chars") > CHARS)).select(F.col("c").alias("big")))
    if big.isEmpty():
        return _short(rows, schema, turns)
    same = F.col("c").eqNullSafe(F.col("big"))
    return _short(rows.join(big, same, "left_anti"), schema, turns).unionByName(_long(rows.join(big, same, "left_semi"), schema, turns))
