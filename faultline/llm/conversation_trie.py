"""Conversation prefix trie (12): balanced parentheses per shard, shared spines merged.

1. Turns are hashed; a conversation's path is the array of its turns' hashes and
   word counts, and equal paths are one row with a number of conversations.
2. Paths in order stand in the trie's depth-first order.  Spark deals them into
   ranges, and a task cuts its range into shards of at most ``PATHS`` paths.  A
   shard's trie is a sequence of parentheses; ``findclose`` over blocks of least
   excess delimits each subtree, leaves are opening parentheses that close at
   once, counted by rank, and conversations and savings are differences of
   cumulative arrays.
3. Only nodes on a shard's first or last path, its spines, can continue in another
   shard.  All others are finished there; a spine goes on as a path whose nodes
   carry what hangs below them, and the spines of all shards are the paths of the next
   level, until one shard is left.
4. Children of a spine node get their parent's id by a join on (shard, node), so no
   key of the join has more rows than a shard.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.arrow import pieces
from faultline.session import cut_lineage

PATHS = 4096                      # paths of a shard
LEAST_PATHS, NODES = 64, 1 << 20  # a shard ends earlier at so many nodes, but not before so many paths
BLOCK = 64                        # parentheses of a block of the range min-max table
IDS = 1 << 16                     # ids of a piece of a member list
NONE = hashlib.sha256(b"").hexdigest()
NO_ID = np.iinfo(np.int64).max


def find_close(excess: np.ndarray, opened: np.ndarray) -> np.ndarray:
    """Place of the closing parenthesis of each opening one: the first later place of lower excess.

    In the block of the opening one every place is looked at; beyond, the tree of
    the blocks' least excess is climbed to the first block that goes lower, and that
    block is read.
    """
    n = len(excess)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, NO_ID, np.int64)
    padded[:n] = excess
    want, close = excess[opened], np.full(len(opened), -1, np.int64)

    def scan(which: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Looks from ``start`` to the end of its block; gives those not found."""
        at, end = start.copy(), (start // BLOCK + 1) * BLOCK
        while len(which):
            live = at < end
            left, which, at, end = which[~live], which[live], at[live], end[live]
            missing.append(left)
            hit = padded[at] < want[which]
            close[which[hit]] = at[hit]
            which, at, end = which[~hit], at[~hit] + 1, end[~hit]

    missing: list[np.ndarray] = []
    scan(np.arange(len(opened)), opened + 1)
    rest = np.concatenate(missing) if missing else np.empty(0, np.int64)
    if not len(rest):
        return close
    tree = [padded.reshape(blocks, BLOCK).min(1)]
    while len(tree[-1]) > 1:
        low = tree[-1]
        low = np.append(low, NO_ID) if len(low) % 2 else low
        tree[-1] = low
        tree.append(low.reshape(-1, 2).min(1))
    node, level = (opened[rest] + 1) // BLOCK, np.zeros(len(rest), np.int64)
    found = np.full(len(rest), -1, np.int64)
    going = np.arange(len(rest))
    for up in range(len(tree)):
        right = node[going] + 1
        ok = (node[going] % 2 == 0) & (right < len(tree[up]))
        ok[ok] = tree[up][right[ok]] < want[rest[going[ok]]]
        found[going[ok]], level[going[ok]] = right[ok], up
        going = going[~ok]
        node[going] //= 2
        if not len(going):
            break
    for up in range(len(tree) - 1, 0, -1):
        deep = np.flatnonzero(level == up)
        left = found[deep] * 2
        found[deep] = np.where(tree[up - 1][left] < want[rest[deep]], left, left + 1)
        level[deep] = up - 1
    missing.clear()
    scan(rest, found * BLOCK)
    return close


def subtree_sizes(depth: np.ndarray) -> np.ndarray:
    """Nodes of each subtree, of nodes in depth-first order, by their parentheses."""
    n = len(depth)
    opened = 2 * np.arange(n) - depth
    step = np.full(2 * n, -1, np.int64)
    step[opened] = 1
    close = find_close(np.cumsum(step), opened)
    return (close - opened + 1) // 2


VALUE = "struct<depth int, convs long, kids long, leaves long, saved long, least long, ends string>"
LEVEL = f"h array<string>, w array<int>, vals array<{VALUE}>"
OUT = ("shard long, depth long, conv_id long, parent long, pkey string, key string, n_convs long, n_children long, "
           f"n_leaves long, saved_tokens long, ends_sha256 string, {LEVEL}")


class Shard:
    """The trie of paths in order: ``add`` each, then ``rows`` of the finished nodes and of the spines."""

    def __init__(self, keys: bool):
        self.depth, self.parent, self.words, self.own, self.ends = [0], [-1], [0], {}, {}
        self.path: list[str] = []
        self.cur = [0]
        self.hashes = [hashlib.sha256()] if keys else None
        self.key = [self.hashes[0].hexdigest()[:32]] if keys else None
        self.first: tuple | None = None
        self.paths, self.last_words = 0, []

    def add(self, h: list[str], w: list[int], vals: list) -> None:
        same, top = 0, min(len(h), len(self.path))
        while same < top and h[same] == self.path[same]:
            same += 1
        del self.cur[same + 1:]
        if self.hashes is not None:
            del self.hashes[same + 1:]
        for d in range(same, len(h)):
            self.depth.append(d + 1)
            self.parent.append(self.cur[-1])
            self.words.append(w[d])
            self.cur.append(len(self.depth) - 1)
            if self.hashes is not None:
                x = self.hashes[-1].copy()
                x.update(h[d].encode())
                self.hashes.append(x)
                self.key.append(x.hexdigest()[:32])
        self.path, self.last_words = h, w
        for v in vals:
            i = self.cur[v["depth"]]
            o = self.own.setdefault(i, [0, 0, 0, 0, NO_ID])
            for k, name in enumerate(("convs", "kids", "leaves", "saved")):
                o[k] += v[name]
            if v["least"] is not None:
                o[4] = min(o[4], v["least"])
            if v["ends"] is not None:
                self.ends[i] = v["ends"]
        if self.first is None:
            self.first = (h, w, list(self.cur))
        self.paths += 1

    def rows(self, shard: int, last: bool):
        """Tuples of ``OUT``: finished nodes, a mark per spine node (its key alone), spines as paths."""
        n = len(self.depth)
        depth, parent, words = np.array(self.depth), np.array(self.parent), np.array(self.words, np.int64)
        own = np.zeros((5, n), np.int64)
        own[4] = NO_ID
        for i, o in self.own.items():
            own[:, i] = o
        spine = np.zeros(n, bool)
        ways = []
        if not last:
            ways = [self.first]
            if self.cur != self.first[2]:
                ways.append((self.path, self.last_words, list(self.cur)))
            for *_, nodes in ways:
                spine[nodes] = True
        size = subtree_sizes(depth)

        def under(x):
            total = np.append(0, np.cumsum(x))
            return total[np.arange(n) + size] - total[:n]

        local = np.zeros(n, np.int64)
        np.add.at(local, parent[1:], 1)
        kids = own[1] + local
        convs = under(own[0])
        leaf = (size == 1) & (kids == 0) & ~spine             # "()" with nothing finished below it elsewhere
        leaves = under(own[2] + leaf)
        saved = under(own[3] + np.where(spine, 0, (convs - 1) * words))
        least = own[4].copy()
        by_depth = np.argsort(depth, kind="stable")
        edges = np.searchsorted(depth[by_depth], np.arange(depth.max() + 2))
        for d in range(depth.max(), 0, -1):
            at = by_depth[edges[d]:edges[d + 1]]
            np.minimum.at(least, parent[at], least[at])

        spine_key = {}
        for h, _, nodes in ways:
            x = hashlib.sha256()
            spine_key[nodes[0]] = x.hexdigest()[:32]
            for t, i in zip(h, nodes[1:], strict=True):
                x.update(t.encode())
                spine_key[i] = x.copy().hexdigest()[:32]
        blank = (None,) * 3
        for i in np.flatnonzero(~spine).tolist():
            p = int(parent[i])
            pkey = spine_key.get(p)
            yield (shard, int(depth[i]), int(least[i]), int(least[p]) if p >= 0 and pkey is None else None, pkey,
                   self.key[i] if self.key else None, int(convs[i]), int(kids[i]), int(leaves[i]), int(saved[i]),
                   self.ends.get(i, NONE), *blank)
        if last:
            return
        # What hangs below a spine node: all of its subtree but what is below its children on a spine.
        hang = {i: [int(convs[i]), int(kids[i]), int(leaves[i]), int(saved[i]), int(own[4, i])] for i in spine_key}
        for i in spine_key:
            p = int(parent[i])
            if p >= 0:
                for k, x in enumerate((convs, None, leaves, saved)):
                    hang[p][k] -= 1 if x is None else int(x[i])
        child = np.flatnonzero(~spine)
        child = child[spine[parent[child]]] if len(child) else child
        for i in child.tolist():
            h = hang[int(parent[i])]
            h[4] = min(h[4], int(least[i]))
        done = set()
        for h, w, nodes in ways:
            vals = []
            for d, i in enumerate(nodes):
                if i in done:
                    continue
                done.add(i)
                c, k, le, s, m = hang[i]
                if c or k or le or s or m != NO_ID or i in self.ends:
                    vals.append({"depth": d, "convs": c, "kids": k, "leaves": le, "saved": s, "least": None if m == NO_ID else m,
                                 "ends": self.ends.get(i)})
            yield (shard, *(None,) * 10, h, w, vals)
        for i in sorted(set(parent[child].tolist())):
            yield (shard, *(None,) * 4, spine_key[i], *(None,) * 8)


def _level(paths: DataFrame, n: int, upper: bool) -> DataFrame:
    """One round: shards of ``paths`` (``LEVEL``), n of them."""
    last = n <= PATHS
    if last:
        dealt = paths.coalesce(1)                             # at most PATHS rows
    else:
        usual = int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = paths.repartitionByRange(min(-(-n // PATHS), max(usual, n // 250_000)), "h")
    schema = T.StructType.fromDDL(OUT)

    def stream(batches):
        from pyspark import TaskContext
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema
        kind, part, k = to_arrow_schema(schema), TaskContext.get().partitionId(), 0
        shard = None

        def tables(rows):
            held = []
            for r in rows:
                held.append(r)
                if len(held) >= 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kind, strict=True)], schema=kind)
                    held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kind, strict=True)], schema=kind)

        for b in pieces(batches):
            for h, w, vals in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if shard is None:
                    shard = Shard(upper)
                shard.add(h, w, vals)
                if not last and (shard.paths >= PATHS or shard.paths >= LEAST_PATHS and len(shard.depth) >= NODES):
                    yield from tables(shard.rows(part << 32 | k, False))
                    shard, k = None, k + 1
        if shard is not None:
            yield from tables(shard.rows(part << 32 | k, last))

    return cut_lineage(dealt.sortWithinPartitions("h").select("h", "w", "vals").mapInArrow(stream, schema))


def conversation_paths(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(c, turns)``: each conversation's turns in order, as (hash of role and text, words).

    Null role or text is empty.  Turns of one number (nulls first) stand by role, then hash.
    Rows without an id belong to no conversation and are left out.
    """
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    h = F.substring(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t).cast("binary"), 256), 1, 32)
    each = rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("c"), F.col(turn).alias("t"), r.alias("r"), h.alias("h"),
        F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("int").alias("w"))
    whole = each.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("t", "r", "h", "w"))).alias("x"))
    return whole.select("c", F.transform("x", lambda x: F.struct(x["h"].alias("h"), x["w"].alias("w"))).alias("turns"))


def rebuilt(paths: DataFrame, every: int = 20, most: int = 3) -> DataFrame:
    """Conversations of which the first crc32(c) % (most + 1) turns are those of the one before c that ``every`` divides."""
    n = F.crc32(F.col("c").cast("string").cast("binary")) % (most + 1)
    heads = paths.where(F.col("c") % every == 0).select(F.col("c").alias("b"), F.slice("turns", 1, most).alias("head"))
    empty = F.array().cast(paths.schema["turns"].dataType)
    both = paths.withColumn("b", F.col("c") - F.pmod("c", F.lit(every))).withColumn("n", n.cast("int")).join(heads, "b", "left")
    front = F.slice(F.coalesce("head", empty), F.lit(1), F.col("n"))
    rest = F.slice("turns", F.col("n") + 1, F.greatest(F.size("turns") - F.col("n"), F.lit(0)))
    return both.select("c", F.concat(front, rest).alias("turns"))


def _member_hashes(members: DataFrame) -> DataFrame:
    """``(k, ends)``: SHA-256 of the ids of each k, ascending and comma-joined.

    Ranges of (k, c) are joined to pieces of at most ``IDS`` ids in parallel; then a
    k's pieces are read in order, one at a time.
    """
    pieces_schema = T.StructType.fromDDL("k string, lo long, ids string")
    hashes = T.StructType.fromDDL("k string, ends string")

    def cut(batches):
        import pyarrow as pa

        def batch(k, lo, ids):
            return pa.RecordBatch.from_pydict({"k": [k], "lo": pa.array([lo], pa.int64()), "ids": [",".join(map(str, ids))]})

        key, own = None, []
        for b in batches:
            for k, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if own and (k != key or len(own) >= IDS):
                    yield batch(key, own[0], own)
                    own = []
                key = k
                own.append(c)
        if own:
            yield batch(key, own[0], own)

    def fold(batches):
        import pyarrow as pa
        key, h = None, None
        for b in batches:
            out = []
            for k, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != key:
                    if h is not None:
                        out.append((key, h.hexdigest()))
                    key, h = k, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["k", "ends"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])], names=["k", "ends"])

    cuts = members.repartitionByRange("k", "c").sortWithinPartitions("k", "c").select("k", "c").mapInArrow(cut, pieces_schema)
    return cuts.repartition("k").sortWithinPartitions("k", "lo").mapInArrow(fold, hashes)


def prefix_trie(paths: DataFrame) -> DataFrame:
    """One row per distinct beginning of the conversations ``(c, turns)``, the textless root included.

    ``conv_id`` is the least member's id, ``parent_conv_id`` the parent's (null for the root);
    ``n_convs`` members, ``n_children``, ``n_leaves`` childless nodes of the subtree;
    ``saved_tokens``, over the subtree, words of a node's last text times members less
    one; ``ends_sha256`` of the ids that end at the node.  A conversation's row is an array
    of 36 bytes a turn.  No conversation, no row; equal conversations are members of the same nodes.
    """
    keyed = cut_lineage(paths.select("c", F.transform("turns", lambda x: x["h"]).alias("h"), F.transform("turns", lambda x: x["w"]).alias("w"))
                        .withColumn("k", F.substring(F.sha2(F.array_join("h", ""), 256), 1, 32)))
    counts = cut_lineage(keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least")))
    many = counts.where("n > 1").select("k")
    ends = _member_hashes(keyed.select("k", "c").join(many, "k", "left_semi"))
    # The least member's row stands for a path, so arrays are not aggregated.
    known = counts.join(ends, "k", "left").select(F.col("least").alias("c"), "n", F.coalesce(
        "ends", F.sha2(F.col("least").cast("string").cast("binary"), 256)).alias("ends"))
    zero = F.lit(0).cast("long")
    value = F.struct(F.size("h").alias("depth"), F.col("n").alias("convs"), zero.alias("kids"), zero.alias("leaves"), zero.alias("saved"),
                     F.col("c").cast("long").alias("least"), F.col("ends").alias("ends"))
    level = cut_lineage(keyed.join(known, "c").select("h", "w", F.array(value).alias("vals")))
    rounds, n = [], level.count()
    while True:
        out = _level(level, n, bool(rounds))
        rounds.append(out)
        if n <= PATHS:
            break
        level = out.where("h IS NOT NULL").select("h", "w", "vals")
        n = level.count()

    names = ["conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    found = rounds[-1].where("depth IS NOT NULL").select(*names)
    ids = rounds[-1].where("depth IS NOT NULL").select("key", F.col("conv_id").alias("parent"))
    for out in reversed(rounds[:-1]):
        nodes, marks = out.where("depth IS NOT NULL"), out.where("depth IS NULL AND key IS NOT NULL")
        parents = cut_lineage(marks.select("shard", "key").join(ids, "key").select("shard", F.col("key").alias("pkey"), "parent"))
        found = found.unionByName(nodes.where("pkey IS NULL").select(*names)).unionByName(
            nodes.where("pkey IS NOT NULL").drop("parent").join(parents, ["shard", "pkey"]).select(*names))
        ids = ids.unionByName(nodes.where("key IS NOT NULL").select("key", F.col("conv_id").alias("parent")))
    return found
