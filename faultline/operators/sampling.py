"""Sampling and splitting (M1-M9).

Random order is a seeded hash of the row key, ``md5('seed:key')`` as hex text,
so a sample is a pure function of (seed, key): stable under repartitioning,
re-execution after executor loss, and reproducible in SQL.

``take_smallest`` selects exactly ``n`` rows per group by that order without a
per-group sort of the whole group: a histogram over the first five hex digits
(about a million buckets) locates each group's cut bucket, rows below it are
taken as they stream by, and only the rows inside the cut bucket (about
1/1,000,000 of the group) are ranked.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.functions import hash_fraction, hash_order
from faultline.operators.prefix import running_sums
from faultline.session import cut_lineage

PREFIX_DIGITS = 5


def quota_frame(spark, counts: dict, group: str, name: str = "n") -> DataFrame:
    """Small driver-built quota table ``(group, n)`` (one row per stratum)."""
    return spark.createDataFrame([(int(k), int(v)) for k, v in counts.items()], f"{group} int, {name} long")


def undersample_counts(df: DataFrame, strt: str, strata_p: dict, cv: bool = False) -> DataFrame:
    """M1: rows to keep per stratum, ``(strt, n_rows, n)``.

    The smallest stratum anchors: ``n_s = int(min(p_s * n_min / p_min, n_s))``
    (float product, then division, then truncation); ``cv`` keeps 80 %.
    A stratum that is present but absent from ``strata_p`` fails the query.
    """
    pmap = F.create_map(*[x for k, v in strata_p.items() for x in (F.lit(int(k)), F.lit(float(v)))])
    counts = df.where(F.col(strt).isNotNull()).groupBy(strt).agg(F.count(F.lit(1)).alias("n_rows"))
    # counts has one row per stratum: a window over it is a few rows in one task.
    key = F.struct(F.col("n_rows"), F.col(strt))
    j = counts.withColumn("__a", F.min(key).over(Window.partitionBy())).select(
        "*", F.col("__a.n_rows").alias("n_min"), F.col(f"__a.{strt}").alias("s_min"))
    def share(s):
        p = F.try_element_at(pmap, s.cast("int"))
        return F.when(p.isNotNull(), p).otherwise(
            F.raise_error(F.concat(F.lit("no proportion is given for stratum "), s.cast("string"))).cast("double"))

    p, p_min = share(F.col(strt)), share(F.col("s_min"))
    n = F.floor(F.least(p * F.col("n_min") / p_min, F.col("n_rows").cast("double")))
    if cv:
        n = F.floor(n * F.lit(0.8))
    return j.select(strt, "n_rows", n.cast("long").alias("n"))


def ratio_counts(df: DataFrame, y: str, p: float) -> DataFrame:
    """M3: binary under-sample to a minority share ``p``: majority -> int(n_min / r), r = p / (1 - p)."""
    r = p / (1 - p)
    counts = df.where(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("n_rows"))
    w = Window.partitionBy()
    n_min = F.min("n_rows").over(w)
    n = F.when(F.col("n_rows") == n_min, F.col("n_rows")).otherwise(F.floor(n_min / F.lit(r)))
    return counts.select(y, "n_rows", F.least(n, F.col("n_rows")).cast("long").alias("n"))


def take_smallest(df: DataFrame, groups: list[str], order: Column, quota: DataFrame | int,
                  ties: list[str] | None = None) -> DataFrame:
    """Exactly ``quota.n`` rows per group with the smallest hex ``order`` key.

    ``quota`` has one row per group (its size is the number of groups, chosen by
    the caller), so it is broadcast; a number is the same quota for all groups
    of the data, however many.  Groups with n >= rows keep every row.
    """
    ties = ties or []
    x = df.withColumn("__h", order).withColumn(
        "__b", F.conv(F.substring("__h", 1, PREFIX_DIGITS), 16, 10).cast("long"))
    hist = x.groupBy(*groups, "__b").agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy(*groups).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    if isinstance(quota, int):
        quota, small = hist.select(*groups).distinct().withColumn("n", F.lit(quota).cast("long")), lambda t: t
    else:
        small = F.broadcast
    h2 = hist.join(small(quota), groups).withColumn("__cum", F.sum("__c").over(w))
    cut = h2.where((F.col("__cum") - F.col("__c") < F.col("n")) & (F.col("__cum") >= F.col("n"))) \
            .select(*groups, F.col("__b").alias("__cut"),
                    (F.col("n") - (F.col("__cum") - F.col("__c"))).alias("__need"))
    plan = quota.join(cut, groups, "left")            # one row per group
    j = x.join(small(plan), groups)
    take_all = F.col("__cut").isNull() & (F.col("n") > 0)
    sure = j.where(take_all | (F.col("__b") < F.col("__cut")))
    we = Window.partitionBy(*groups).orderBy("__h", *ties)
    edge = (j.where(F.col("__b") == F.col("__cut"))
            .withColumn("__rn", F.row_number().over(we))
            .where(F.col("__rn") <= F.col("__need")).drop("__rn"))
    return sure.unionByName(edge).drop("__h", "__b", "__cut", "__need", "n")


def stratified_undersample(df: DataFrame, strt: str, counts: DataFrame, seed: int,
                           key_cols: list[str]) -> DataFrame:
    """M2: exactly ``counts.n`` rows per stratum, without replacement, seeded."""
    quota = counts.select(F.col(strt).cast("int").alias(strt), "n")
    return take_smallest(df.withColumn(strt, F.col(strt).cast("int")), [strt],
                         hash_order(seed, *key_cols), quota, ties=key_cols)


def smallest_share(df: DataFrame, order: Column, share: float) -> str | None:
    """The ceil(share x rows)-th smallest hex ``order`` of all rows, None for no row.

    A histogram of the first hex digits (a million buckets at most, whatever the data) finds the
    bucket, and only its rows are sorted.
    """
    h = df.select(order.alias("h")).withColumn("b", F.substring("h", 1, PREFIX_DIGITS))
    hist = h.groupBy("b").agg(F.count(F.lit(1)).alias("c"))
    w = Window.orderBy("b")
    cut = (hist.withColumn("upto", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
           .withColumn("k", F.ceil(F.sum("c").over(Window.partitionBy()) * F.lit(float(share))))
           .where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("c") < F.col("k")))
           .select("b", (F.col("k") - F.col("upto") + F.col("c")).cast("long").alias("place")).first())
    if cut is None:
        return None
    rows = h.where(F.col("b") == cut["b"]).withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("h")))
    return rows.where(F.col("r") == cut["place"]).first()["h"]


def train_test_split(df: DataFrame, key_cols: list[str], test_size: float = 0.2,
                     seed: int = 42, name: str = "split") -> DataFrame:
    """M4: ``split`` = 'test' for ceil(test_size x rows) rows, those of the smallest seeded key hashes, else 'train'.

    Not stratified; the rows are not shuffled; rows of one key land on the same side.
    """
    h = hash_order(seed, *key_cols)
    cut = smallest_share(df, h, test_size)
    return df.withColumn(name, F.when(h <= F.lit(cut), "test").otherwise("train"))


def split_balance(df: DataFrame, var: str, split: str = "split") -> DataFrame:
    """Per value of ``var``: train / test counts and shares of the full count.

    Values absent from train are dropped; a value absent from test has NULL test cells.
    """
    g = df.where(F.col(var).isNotNull()).groupBy(var).agg(
        F.count_if(F.col(split) == "train").alias("train_cnt"),
        F.count_if(F.col(split) == "test").alias("test_cnt"),
        F.count(F.lit(1)).alias("cnt"))
    test = F.when(F.col("test_cnt") > 0, F.col("test_cnt"))
    return g.where(F.col("train_cnt") > 0).select(
        F.lit(var).alias("var"), F.col(var).cast("int").alias("value"),
        "train_cnt", (F.col("train_cnt") / F.col("cnt")).alias("train_pct"),
        test.alias("test_cnt"), (test / F.col("cnt")).alias("test_pct"))


def estimators_proxy(full_counts: DataFrame, sample_counts: DataFrame, strt: str, stratum: int = 1) -> DataFrame:
    """M6: int(round(N_s(full) / n_s(sample))) with round half to even."""
    a = full_counts.where(F.col(strt) == stratum).select(strt, F.col("n_rows").alias("N"))
    b = sample_counts.where(F.col(strt) == stratum).select(strt, F.col("n").alias("n_s"))
    return a.join(b, strt).select(
        strt, F.bround(F.col("N") / F.col("n_s"), 0).cast("int").alias("estimators"))


def fold_of(seed: int, key_cols: list[str], k: int = 5, prefix: str = "fold") -> Column:
    """M8: fold number 0..k-1 from the seeded key hash (balanced in expectation)."""
    h = hash_order(f"{prefix}{seed}", *key_cols)
    return F.pmod(F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.lit(k)).cast("int")


def stratified_folds(df: DataFrame, strt: str, seed: int, key_cols: list[str], k: int = 5, name: str = "fold",
                     prefix: str = "fold") -> DataFrame:
    """M8: exact stratified folds: a row's place in its stratum by the seeded key hash, modulo ``k``.

    Fold sizes differ by at most one per stratum.  Places are running counts over ranges of
    (stratum, hash), so no stratum is sorted in one task.  Rows of one key share their hash and are
    told apart by their other columns; rows that are equal in all of them are counted one by one.
    """
    x = df.withColumn("__h", hash_order(f"{prefix}{seed}", *key_cols))
    narrow = x.groupBy(strt, "__h").agg(F.count(F.lit(1)).alias("__n"))
    known = running_sums(narrow.where(F.col(strt).isNotNull()), "__h", ["__n"], by=[strt])
    one = known.where("__n = 1").select(F.col(strt).alias("__s"), F.col("__h").alias("__g"), F.col("before___n").alias("__b"))
    fold = F.pmod(F.col("__b"), F.lit(k)).cast("int").alias(name)
    single = x.join(one, (F.col(strt) == F.col("__s")) & (F.col("__h") == F.col("__g"))).select(*df.columns, fold)
    more = known.where("__n > 1").select(F.col(strt).alias("__s"), F.col("__h").alias("__g"), F.col("before___n").alias("__o"))
    others = [F.col(c) for c in df.columns]
    place = F.col("__o") + F.row_number().over(Window.partitionBy(strt, "__h").orderBy(*others)) - 1
    several = x.join(more, (F.col(strt) == F.col("__s")) & (F.col("__h") == F.col("__g"))).withColumn("__b", place).select(*df.columns, fold)
    none = df.where(F.col(strt).isNull()).withColumn(name, F.lit(None).cast("int"))
    return single.unionByName(several).unionByName(none)


def bag_membership(df: DataFrame, strt: str, counts: DataFrame, bags: int | None, seed: int,
                   key_cols: list[str]) -> DataFrame:
    """M7: ``bags`` independent exact stratified under-samples by key hashes, long ``(bag, ...)``.

    Each row is expanded only into the bags whose hash fraction falls under the
    stratum's keep rate ``min(1, n_s / N_s + 10 / sqrt(N_s))``, at least twenty standard
    deviations above what is needed, and ``take_smallest`` trims every (bag, stratum) to exactly ``n_s``.
    ``bags`` None reads the number from the column ``bags`` of ``counts``.  Nothing runs before
    the result is asked for.  ``draw_bags`` needs no hash per bag and row, but has no SQL.
    """
    per = counts.select(F.col(strt).cast("int").alias(strt), "n", (F.col("bags") if bags is None else F.lit(bags)).cast("int").alias("__bags"),
                        F.least(F.lit(1.0), F.col("n") / F.col("n_rows") + 10.0 / F.sqrt("n_rows")).alias("__q"))     # a row per stratum
    x = df.withColumn(strt, F.col(strt).cast("int")).join(F.broadcast(per.select(strt, "__bags", "__q")), strt)
    hashed = F.transform(F.sequence(F.lit(0), F.col("__bags") - 1), lambda b: F.struct(b.alias("bag"), hash_order(seed, b, *key_cols).alias("h")))
    cand = x.withColumn("__b", F.explode(F.filter(hashed, lambda t: hash_fraction(t["h"]) < F.col("__q")))).select(
        *df.columns, "__b.bag", F.col("__b.h").alias("__key"))
    quota = per.select(F.explode(F.sequence(F.lit(0), F.col("__bags") - 1)).alias("bag"), strt, F.col("n").cast("long").alias("n"))
    return take_smallest(cand, ["bag", strt], F.col("__key"), quota, ties=key_cols).drop("__key")


BLOCK = 1 << 16                   # rows of a stratum that one draw is made from
RUNS = 4 << 20                    # bytes of packed runs that go out at a time
RUN = 4 << 10                     # bytes of a packed run: thousands of them are read at a time


def _numbered(df: DataFrame, group: list[str], key_cols: list[str]) -> DataFrame:
    """``df`` with ``__place``, the place of a row in its group by its keys: ranges, counted, and a running count."""
    order = [*[F.col(c) for c in group], *[F.col(c) for c in key_cols], F.xxhash64(*df.columns)]
    x = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id()))
    n = x.groupBy(*group, "__p").agg(F.count(F.lit(1)).alias("__n"), F.min("__i").alias("__f"))
    before = Window.partitionBy(*group).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = n.withColumn("__o", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")       # a row per group and range
    return x.join(F.broadcast(base), [*group, "__p"]).withColumn("__place", F.col("__o") + F.col("__i") - F.col("__f")).drop(
        "__p", "__i", "__f", "__o")


def row_numbers(df: DataFrame, key_cols: list[str], name: str) -> DataFrame:
    """``df`` with the place of each row by its keys as ``name``."""
    return _numbered(df, [], key_cols).withColumnRenamed("__place", name)


def _hypergeometric(rng, good: int, bad: int, draws: int) -> int:
    """Draws that fall on ``good`` rows; of a billion rows or more (numpy's limit) by the normal distribution, whose error is far below one part in 10 000."""
    if good + bad < 10 ** 9:
        return int(rng.hypergeometric(good, bad, draws))
    n, p = good + bad, good / (good + bad)
    x = rng.normal(draws * p, math.sqrt(draws * p * (1 - p) * (n - draws) / (n - 1)))
    return int(min(max(round(x), draws - bad, 0), good, draws))


def block_quotas(total: int, n: int, rng, size: int) -> "np.ndarray":
    """How many of ``n`` rows drawn from ``total`` fall into each block of ``size``: the tree of halves is split by hypergeometric draws."""
    import numpy as np
    blocks = max(1, -(-total // size))
    out = np.zeros(blocks, np.int64)
    work = [(0, blocks, n)]
    while work:
        lo, hi, m = work.pop()
        if hi - lo == 1 or m == 0:
            out[lo] += m
            continue
        mid = (lo + hi) // 2
        took = _hypergeometric(rng, (mid - lo) * size, min(hi * size, total) - mid * size, m)
        work += [(lo, mid, took), (mid, hi, m - took)]
    return out


def undersample_numbers(n_rows: dict, strata_p: dict, cv: bool = False) -> dict:
    """M1 on known counts ``{stratum: rows}``: rows to keep per stratum, as ``undersample_counts``."""
    if missing := set(n_rows) - set(strata_p):
        raise ValueError(f"no proportion is given for stratum {sorted(missing)}")
    n_min, s_min = min((n, s) for s, n in n_rows.items())
    kept = {s: int(min(strata_p[s] * n_min / strata_p[s_min], n)) for s, n in n_rows.items()}
    return {s: int(n * 0.8) for s, n in kept.items()} if cv else kept


def _seeded(seed: int, g: tuple, *more: int):
    import numpy as np
    return np.random.default_rng([seed & 0xFFFFFFFF, *(x & 0xFFFFFFFF for x in g), *more])


def drawn_places(total: int, n: int, seed: int, g: tuple, own: tuple) -> "np.ndarray":
    """What ``draw_groups`` draws for one bag from the ``total`` rows of group ``g``: places in the group, rising."""
    import numpy as np
    quota = block_quotas(total, n, _seeded(seed, g, *own, 0), BLOCK)
    return np.concatenate([np.sort(_seeded(seed, g, *own, 1 + i).choice(min(BLOCK, total - i * BLOCK), q, replace=False)) + i * BLOCK
                           for i, q in enumerate(quota.tolist()) if q] or [np.empty(0, np.int64)])


def draw_groups(df: DataFrame, group: list[str], quotas: dict, seed: int, key_cols: list[str], pack: list[str] | None = None) -> DataFrame:
    """Exact samples without replacement, long ``(bag, ...)``: of the rows of each group (a tuple of whole numbers) as
    many for each bag as ``quotas[group] = (rows, [(bag, n, seeds), ...])`` says (seeds: whole numbers, one draw per tuple).

    Rows are numbered inside their group once.  A bag's quota is split over blocks of ``BLOCK``
    rows (hypergeometric draws down a tree of halves, seeded by bag and group), and a block's rows
    are drawn where they are, so a row costs something in the bags that it is in.  Quotas
    are exact, nothing is counted again, and the partitioning changes nothing.  Rows of a group without quotas are left out.

    With ``pack`` (whole numbers, or byte strings of one length) the result has a row per bag and run of its rows of a group:
    the group, ``bag``, ``n`` and the run's values of each packed column, one after the other, as bytes.
    """
    import numpy as np
    rows = _numbered(df, group, key_cols)
    packed = T.StructType([*[rows.schema[g] for g in group], T.StructField("bag", T.IntegerType()), T.StructField("n", T.IntegerType()),
                           *[T.StructField(c, T.BinaryType()) for c in pack or []]])
    own_at = [df.columns.index(c) for c in pack or []]
    schema = T.StructType([*[rows.schema[c] for c in df.columns], T.StructField("bag", T.IntegerType())])
    at, place, size = [df.columns.index(g) for g in group], len(df.columns), BLOCK

    def seeded(g: tuple, *more: int):
        return _seeded(seed, g, *more)

    def draw(batches):
        import pyarrow as pa
        of, drawn, here_is = {}, [], None

        def told(g, runs):
            n = len(runs)
            cols = [*[pa.array([x] * n, kind.type) for x, kind in zip(g, kinds, strict=True)], pa.array([r[0] for r in runs], pa.int32()),
                    pa.array([r[1] for r in runs], pa.int32()), *[pa.array(list(c), pa.binary()) for c in zip(*(r[2] for r in runs), strict=True)]]
            return pa.RecordBatch.from_arrays(cols, names=packed.names)

        for b in batches:
            kinds = [b.schema.field(i) for i in at]
            values = [np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) if pa.types.is_binary(b.column(i).type)
                      else b.column(i).to_numpy() for i in own_at if b.num_rows]
            keys = list(zip(*(b.column(i).to_pylist() for i in at), b.column(place).to_numpy() // size, strict=True))
            p = b.column(place).to_numpy() % size
            edge = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for lo, hi in zip(edge, [*edge[1:], len(keys)], strict=True):
                g, block = tuple(keys[lo][:-1]), int(keys[lo][-1])
                if g not in quotas:
                    continue
                total, bags = quotas[g]
                if g not in of:
                    of = {g: [block_quotas(total, n, seeded(g, *own, 0), size) for _, n, own in bags]}
                if here_is != (g, block):
                    here_is, m = (g, block), min(size, total - block * size)
                    drawn = [(bag, np.sort(seeded(g, *own, 1 + block).choice(m, q[block], replace=False)))
                             for (bag, _, own), q in zip(bags, of[g], strict=True) if q[block]]
                inside, runs, held = p[lo:hi], [], 0
                for bag, places in drawn:
                    near = places[np.searchsorted(places, inside[0]):np.searchsorted(places, inside[-1], "right")]
                    if len(near) and pack:
                        take = lo + np.searchsorted(inside, near)
                        step = max(1, RUN // sum(v[0].nbytes for v in values))
                        for i in range(0, len(take), step):
                            runs.append((bag, len(take[i:i + step]), [v[take[i:i + step]].tobytes() for v in values]))
                            held += sum(map(len, runs[-1][2]))
                        if held > RUNS:
                            yield told(g, runs)
                            runs, held = [], 0
                    elif len(near):
                        take = pa.array(lo + np.searchsorted(inside, near))
                        yield pa.RecordBatch.from_arrays([*[c.take(take) for c in b.columns[:place]], pa.array([bag] * len(near), pa.int32())],
                                                         names=schema.names)
                if runs:
                    yield told(g, runs)

    order = [*group, "__place"]
    return rows.select(*df.columns, "__place").sortWithinPartitions(*order).mapInArrow(draw, packed if pack else schema)


def draw_bags(df: DataFrame, strt: str, counts: DataFrame, bags: int, seed: int, key_cols: list[str]) -> DataFrame:
    """M7 without a hash per bag and row: ``bags`` independent exact under-samples, long ``(bag, ...)``; see ``draw_groups``."""
    quotas = {(int(r[strt]),): (int(r["n_rows"]), [(b, int(r["n"]), (b,)) for b in range(bags)]) for r in counts.collect()}   # one row per stratum
    return draw_groups(df.where(F.col(strt).isNotNull()).withColumn(strt, F.col(strt).cast("int")), [strt], quotas, seed, key_cols)


def _block_draws(group: int, n: int, seed: int, size: int) -> "np.ndarray":
    """How many of ``n`` draws with replacement from ``n`` rows fall into each block."""
    import numpy as np
    blocks = -(-n // size)
    rng, out, work = np.random.default_rng([seed & 0xFFFFFFFF, group, 0]), np.zeros(blocks, np.int64), [(0, blocks, n)]
    while work:
        lo, hi, m = work.pop()
        if hi - lo == 1 or m == 0:
            out[lo] += m
            continue
        mid = (lo + hi) // 2
        took = int(rng.binomial(m, (mid - lo) * size / (min(hi * size, n) - lo * size)))
        work += [(lo, mid, took), (mid, hi, m - took)]
    return out


def _block_copies(group: int, n: int, seed: int, size: int, block: int, draws: int) -> "np.ndarray":
    """How often each row of a block is drawn."""
    import numpy as np
    m = min(size, n - block * size)
    rng = np.random.default_rng([seed & 0xFFFFFFFF, group, 1 + block])
    return np.bincount(rng.integers(0, m, draws), minlength=m)


def bootstrap_copies(group: str, n: int, seed: int) -> "np.ndarray":
    """M9: what ``exact_bootstrap`` draws for the ``n`` rows of the group of this name, in order, where they are in one task."""
    import numpy as np
    g = zlib.crc32(group.encode())
    return np.concatenate([_block_copies(g, n, seed, BLOCK, block, d) for block, d in enumerate(_block_draws(g, n, seed, BLOCK))])


def exact_bootstrap(df: DataFrame, groups: list[str], seed: int, key_cols: list[str]) -> DataFrame:
    """M9: per group as many draws with replacement as it has rows, ``copies`` per row (rows never drawn are left out).

    Draws are split over blocks of ``BLOCK`` rows down a tree of halves (binomial draws, seeded by
    the group), and a block's draws fall on its rows evenly, so a group's copies add up to its rows exactly, without a sort of the group
    in one task.
    """
    import numpy as np
    rows = _numbered(df, groups, key_cols)
    total = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n"))
    name = F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in groups])
    keyed = rows.join(F.broadcast(total), groups).withColumn("__g", F.crc32(name.cast("binary")))       # a row per group
    schema = T.StructType([*[rows.schema[c] for c in df.columns], T.StructField("copies", T.LongType())])
    n_cols = len(df.columns)

    def draw(batches):
        import pyarrow as pa
        draws, known = {}, (None, None)
        for b in batches:
            place, n, g = (b.column(n_cols + i).to_numpy() for i in range(3))
            copies = np.zeros(b.num_rows, np.int64)
            for group, rows_of in sorted(set(zip(g.tolist(), n.tolist(), strict=True))):
                if (group, rows_of) not in draws:
                    draws = {(group, rows_of): _block_draws(group, rows_of, seed, BLOCK)}
                own = (g == group) & (n == rows_of)
                for block in np.unique(place[own] // BLOCK).tolist():
                    if known[0] != (group, rows_of, block):
                        known = ((group, rows_of, block), _block_copies(group, rows_of, seed, BLOCK, block, draws[group, rows_of][block]))
                    here = own & (place // BLOCK == block)
                    copies[here] = known[1][place[here] - block * BLOCK]
            take = pa.array(np.flatnonzero(copies))
            yield pa.RecordBatch.from_arrays([*[c.take(take) for c in b.columns[:n_cols]], pa.array(copies[copies > 0])], names=schema.names)

    return keyed.select(*df.columns, "__place", "__n", "__g").mapInArrow(draw, schema)


def rug_sample(df: DataFrame, cols: list[str], y: str, n: int, seed: int, key_cols: list[str]) -> DataFrame:
    """At most ``n`` seeded rows per (metric, class), long ``(m, y, keys.., x)``.

    Groups smaller than ``n`` keep every row (the study samples only when the
    group is larger).
    """
    long = (df.select(*key_cols, y, *[F.col(c).cast("double").alias(c) for c in cols])
            .unpivot([*key_cols, y], list(cols), "m", "x").where(F.col(y).isNotNull()))
    return take_smallest(long, ["m", y], hash_order(seed, F.col("m"), *key_cols), int(n), ties=list(key_cols))


def _poisson1_cdf() -> list:
    """P(K <= k) = e^-1 * sum_{i<=k} 1/i! for k = 0, 1, ... as far as a double differs from 1."""
    acc, out = 0.0, []
    while not out or out[-1] < 1.0 and len(out) < 18:
        acc += 1.0 / math.factorial(len(out))
        out.append(acc * math.exp(-1.0))
    return out


def bootstrap_weights(df: DataFrame, bags: int, seed: int, key_cols: list[str]) -> DataFrame:
    """M9: sampling with replacement as a Poisson(1) count per (bag, row).

    The count is the inverse CDF of a seeded hash fraction, so each bag is a
    pure function of (seed, bag, key); rows with count 0 are not emitted.
    """
    cdf = _poisson1_cdf()
    def count_of(u):
        k = F.lit(0)
        for c in cdf:
            k = k + (u > F.lit(c)).cast("int")
        return k
    x = df.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1))))
    u = hash_fraction(hash_order(f"boot{seed}", "bag", *key_cols))
    return x.withColumn("weight", count_of(u)).where(F.col("weight") > 0)
