"""DuckDB-runnable SQL for each catalogue query (same column names and types)."""

from __future__ import annotations

import math

ORACLE: dict = {}

# The panel view on `events`, written for DuckDB on its own (not taken from the code that it checks).
PANEL_SQL = """
SELECT concat('S', CAST(user_id % 3 AS VARCHAR), 'F', CAST(user_id % 4 AS VARCHAR),
              CASE WHEN user_id < 1000 THEN right(concat('000', CAST(user_id AS VARCHAR)), 4)
                   ELSE CAST(user_id AS VARCHAR) END) AS device,
       CAST(ts AS DATE) AS date,
       CAST(sum(c) AS BIGINT) AS m1,
       count(*) FILTER (event_type = 'signup') AS m2,
       count(*) FILTER (event_type = 'purchase') AS m3,
       count(*) FILTER (event_type = 'view' AND c > 5000) AS m4,
       count(*) AS m5,
       max(c) AS m6,
       CAST(coalesce(sum(c) FILTER (event_type = 'click' AND c > 5000), 0) AS BIGINT) AS m7,
       CAST(coalesce(sum(c) FILTER (event_type = 'click' AND c > 5000), 0) AS BIGINT) AS m8,
       count(*) FILTER (event_type = 'view' AND c <= 2000) AS m9,
       CASE WHEN count(*) FILTER (event_type = 'error') >= 3 THEN 1 ELSE 0 END AS failure
FROM (SELECT user_id, ts, event_type, CAST(round(value * 100) AS BIGINT) AS c FROM events) e
GROUP BY user_id, CAST(ts AS DATE)
"""

PANEL_CTE = f"panel AS (SELECT DISTINCT * FROM ({PANEL_SQL}) p)"


def sql(name: str, body: str, ctes: str = ""):
    more = f", {ctes}" if ctes else ""
    ORACLE[name] = f"WITH RECURSIVE {PANEL_CTE}{more}\n{body}"


def r6(expr: str) -> str:
    """numpy-style rounding to 6 digits, identical arithmetic to ``np_round``."""
    return f"(round_even(({expr}) * 1000000e0, 0) / 1000000e0)"


def r2(expr: str) -> str:
    return f"(round_even(({expr}) * 100e0, 0) / 100e0)"


METRICS = [f"m{i}" for i in range(1, 10)]


def unpivot(src: str, ids: list[str], cols: list[str], name: str, value: str, cast: str = "") -> str:
    parts = []
    for c in cols:
        v = f"cast({c} AS {cast})" if cast else c
        parts.append(f"SELECT {', '.join(ids + [f'{chr(39)}{c}{chr(39)} AS {name}', f'{v} AS {value}'])} FROM {src}")
    return "\nUNION ALL\n".join(parts)


sql("q_panel", "SELECT * FROM panel")

sql("q_target_share", """
SELECT failure, count(*) AS count,
       round_even((count(*) / sum(count(*)) OVER ()) * 100e0 * 100e0, 0) / 100e0 AS proportion
FROM panel WHERE failure IS NOT NULL GROUP BY failure""")

CONTROLS = """ctl AS (
  SELECT *, CASE WHEN failure = 1 THEN 2 WHEN failure = 0 AND f0 = 0 THEN 1 ELSE 0 END AS strt
  FROM (SELECT *, CAST((coalesce(m2,0) + coalesce(m3,0) + coalesce(m4,0) + coalesce(m7,0)
                       + coalesce(m8,0) + coalesce(m9,0)) = 0 AS INTEGER) AS f0 FROM panel) z)"""

sql("q_strata_share", """
SELECT strt, count(*) AS cnt, count(*) / sum(count(*)) OVER () AS pct
FROM ctl GROUP BY strt""", CONTROLS)

sql("q_zero_pct", "SELECT failure, m, pct FROM (\n" + "\nUNION ALL\n".join(
    f"SELECT failure, '{m}' AS m, {r2(f'avg(CAST(coalesce({m} = 0, false) AS INTEGER)) * 100e0')} AS pct "
    f"FROM panel GROUP BY failure" for m in METRICS) + ") t")

sql("q_full_zero_pct", f"""
SELECT failure, 'f0' AS m, {r2('avg(CAST(coalesce(f0 = 1, false) AS INTEGER)) * 100e0')} AS pct
FROM ctl GROUP BY failure""", CONTROLS)

_moments = []
for m in METRICS:
    x = f"CAST({m} AS DOUBLE)"
    pos = f"CASE WHEN {x} > 0 THEN {x} END"
    for stat, expr in (("mean", f"avg({x})"), ("std", f"stddev_samp({x})"),
                       ("mean_nz", f"avg({pos})"), ("std_nz", f"stddev_samp({pos})")):
        _moments.append(f"SELECT failure, '{stat}' AS stat, '{m}' AS m, {r6(expr)} AS value "
                        f"FROM panel WHERE failure IS NOT NULL GROUP BY failure")
sql("q_nonzero_stats", "SELECT * FROM (\n" + "\nUNION ALL\n".join(_moments) + ") t")

sql("q_filter_any", "SELECT * FROM panel WHERE m2 IS DISTINCT FROM 0 OR m3 IS DISTINCT FROM 0")
sql("q_filter_all", "SELECT * FROM panel WHERE m2 IS DISTINCT FROM 0 AND m3 IS DISTINCT FROM 0")

DEVICE_COLS = ("substring(device, 1, 2) AS L1, substring(device, 3, 2) AS L2, "
               "substring(device, 1, 4) AS L12")
DATE_COLS = ("CAST(quarter(date) AS INTEGER) AS Q, CAST(month(date) AS INTEGER) AS M, "
             "CAST(day(date) AS INTEGER) AS D, CAST(floor(day(date) / 8) + 1 AS INTEGER) AS MW, "
             "CAST(isodow(date) - 1 AS INTEGER) AS WD, CAST(isodow(date) - 1 > 4 AS INTEGER) AS WE")

sql("q_device_features", f"SELECT *, {DEVICE_COLS} FROM panel")
sql("q_date_features", f"SELECT *, {DATE_COLS} FROM panel")

sql("q_category_share", """
SELECT v.col, v.value, c.failure, coalesce(n.cnt, 0) / c.ycnt AS pct
FROM (SELECT DISTINCT col, value FROM lng) v
CROSS JOIN (SELECT failure, count(*) AS ycnt FROM feat GROUP BY failure) c
LEFT JOIN (SELECT col, value, failure, count(*) AS cnt FROM lng GROUP BY col, value, failure) n
  ON n.col = v.col AND n.value = v.value AND n.failure = c.failure""",
    f"""feat AS (SELECT *, {DEVICE_COLS}, {DATE_COLS} FROM panel WHERE failure IS NOT NULL),
lng AS ({unpivot('feat', ['failure'], ['L1', 'L2', 'WD'], 'col', 'value', 'VARCHAR')})""")


# ---- per-device windows ------------------------------------------------------
M_NODUP = [m for m in METRICS if m != "m8"]
NODUP_COLS = ", ".join(["device", "date"] + M_NODUP + ["failure"])
NODUP = f"nd AS (SELECT {NODUP_COLS} FROM panel)"
W_DEV = "PARTITION BY device ORDER BY date"

ELAPSED = f"""g AS (SELECT *, CAST(date - lag(date) OVER (PARTITION BY device ORDER BY date) AS INTEGER) AS gap
               FROM panel)"""
sql("q_elapsed", f"""
SELECT * EXCLUDE (gap), coalesce(gap, lead(gap) OVER ({W_DEV})) AS elapsed FROM g""", ELAPSED)
sql("q_elapsed_global_fill", """
SELECT * EXCLUDE (gap), first_value(gap IGNORE NULLS) OVER (ORDER BY device, date
       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS elapsed FROM g""", ELAPSED)


def change_ctes(src: str, metrics: list[str], keep_inf: bool) -> str:
    cur = ", ".join(f"last_value({m} IGNORE NULLS) OVER ({W_DEV} ROWS BETWEEN UNBOUNDED PRECEDING "
                    f"AND CURRENT ROW) AS c_{m}" for m in metrics)
    prev = ", ".join(f"lag(c_{m}) OVER ({W_DEV}) AS p_{m}" for m in metrics)
    jump = "'infinity'::DOUBLE" if keep_inf else "0e0"
    chg = ", ".join(
        f"CASE WHEN p_{m} IS NULL OR c_{m} IS NULL THEN 0e0 WHEN p_{m} = 0 THEN "
        f"(CASE WHEN c_{m} = 0 THEN 0e0 ELSE {jump} END) "
        f"ELSE abs(CAST(c_{m} AS DOUBLE) / CAST(p_{m} AS DOUBLE) - 1e0) END AS {m.replace('m', 'ch', 1)}"
        for m in metrics)
    drop = ", ".join([f"c_{m}" for m in metrics] + [f"p_{m}" for m in metrics])
    return (f"c1 AS (SELECT *, {cur} FROM {src}), c2 AS (SELECT *, {prev} FROM c1), "
            f"chg AS (SELECT * EXCLUDE ({drop}), {chg} FROM c2)")


CH_KEEP = ["ch1", "ch2", "ch4", "ch5", "ch6", "ch7"]
sql("q_change", f"SELECT {NODUP_COLS}, {', '.join(CH_KEEP)} FROM chg",
    NODUP + ", " + change_ctes("nd", M_NODUP, keep_inf=False))

CH_ALL = ["elapsed"] + [m.replace("m", "ch", 1) for m in M_NODUP]
sql("q_change_inf_pct", "SELECT failure, m, pct FROM (\n" + "\nUNION ALL\n".join(
    f"SELECT failure, '{c}' AS m, "
    f"{r2(f'avg(CAST(coalesce(CAST({c} AS DOUBLE) = {chr(39)}infinity{chr(39)}::DOUBLE, false) AS INTEGER)) * 100e0')}"
    f" AS pct FROM chx GROUP BY failure" for c in CH_ALL) + ") t",
    NODUP + ", " + change_ctes("nd", M_NODUP, keep_inf=True) + f""",
chx AS (SELECT *, first_value(gap IGNORE NULLS) OVER (ORDER BY device, date
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS elapsed
        FROM (SELECT *, CAST(date - lag(date) OVER ({W_DEV}) AS INTEGER) AS gap FROM chg) x)""")

SW = ", ".join(f"CAST((CAST(({m} IS DISTINCT FROM 0) AS INTEGER)) - coalesce(lag(CAST(({m} IS DISTINCT FROM 0) AS INTEGER)) "
               f"OVER ({W_DEV}), CAST(({m} IS DISTINCT FROM 0) AS INTEGER)) AS INTEGER) AS {m.replace('m', 'sw', 1)}"
               for m in M_NODUP)
sql("q_switch", f"SELECT *, {SW} FROM nd", NODUP)
SW_COLS = [m.replace("m", "sw", 1) for m in M_NODUP]
sql("q_switch_pct", "SELECT failure, m, pct FROM (\n" + "\nUNION ALL\n".join(
    f"SELECT failure, '{c}' AS m, {r2(f'avg(CAST(coalesce({c} IN (-1, 1), false) AS INTEGER)) * 100e0')} AS pct "
    f"FROM sw GROUP BY failure" for c in SW_COLS) + ") t",
    NODUP + f", sw AS (SELECT *, {SW} FROM nd)")

SR = ", ".join(f"CASE WHEN {m} IS NULL THEN NULL ELSE CAST(rank() OVER (ORDER BY {m}) - 1 AS BIGINT) "
               f"/ count(*) OVER () END AS {m.replace('m', 'sr', 1)}" for m in M_NODUP)
SR_COLS = [m.replace("m", "sr", 1) for m in M_NODUP]
RANKED = (NODUP + f", rk AS (SELECT *, {SR} FROM nd), "
          f"rk2 AS (SELECT *, ({' + '.join(SR_COLS)}) / {len(SR_COLS)} AS srav FROM rk), "
          f"rk3 AS (SELECT *, greatest({', '.join(SR_COLS)}, srav) AS srmx FROM rk2)")
sql("q_rank", f"SELECT {NODUP_COLS}, sr2, sr3, sr4, sr7, sr9, srmx FROM rk3", RANKED)
sql("q_rank_aggs", "SELECT * FROM rk3", RANKED)


# ---- correlation, distributions ---------------------------------------------

def _corr_sql(src: str, cols: list[str]) -> str:
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            x = f"CAST(CASE WHEN {b} IS NOT NULL THEN {a} END AS DOUBLE)"
            y = f"CAST(CASE WHEN {a} IS NOT NULL THEN {b} END AS DOUBLE)"
            expr = (f"CASE WHEN stddev_pop({x}) * stddev_pop({y}) = 0 THEN NULL "
                    f"ELSE covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) END")
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, {expr} AS corr FROM {src}")
            if a != b:
                parts.append(f"SELECT '{b}' AS a, '{a}' AS b, {expr} AS corr FROM {src}")
    return "\nUNION ALL\n".join(parts)


sql("q_corr", f"SELECT a, b, {r6('corr')} AS corr FROM ({_corr_sql('panel', METRICS)}) t")
_pos = "CASE {c} " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(METRICS)) + " END"
sql("q_corr_display", f"""
SELECT a, b, CAST(trunc({r2('corr')} * 100) AS INTEGER) AS corr100,
       abs(CAST(trunc({r2('corr')} * 100) AS INTEGER)) AS abs100
FROM ({_corr_sql('nz', METRICS)}) t
WHERE {_pos.format(c='a')} > {_pos.format(c='b')}""", CONTROLS + ", nz AS (SELECT * FROM ctl WHERE f0 = 0)")

sql("q_dup_columns", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS a, '{b}' AS b, CAST(coalesce(sum(CAST({a} IS DISTINCT FROM {b} AS BIGINT)), 0) AS BIGINT)"
    f" AS n_diff FROM panel" for i, a in enumerate(METRICS) for b in METRICS[i + 1:]))

LONG_M = f"lm AS ({unpivot('panel', ['failure'], METRICS, 'm', 'v', 'DOUBLE')})"
sql("q_dist_summary", f"""
SELECT m, failure, count(v) AS n, {r6('avg(v)')} AS mean, {r6('stddev_samp(v)')} AS std,
       CAST(sum(count(v)) OVER (PARTITION BY m) AS BIGINT) AS n_total
FROM lm WHERE NOT coalesce(v IN (0), false) AND failure IS NOT NULL GROUP BY m, failure""", LONG_M)

sql("q_density", f"""
SELECT g.m, g.failure, g.k, {r6('g.x')} AS x,
       {r6('sum(exp(-0.5e0 * ((g.x - l.v) / g.h) * ((g.x - l.v) / g.h)) / (g.h * g.n * sqrt(2e0 * pi())))')} AS density
FROM grid g JOIN lm l ON l.m = g.m AND l.failure = g.failure
GROUP BY g.m, g.failure, g.k, g.x""", LONG_M + """,
st AS (SELECT m, failure, count(*) AS n, min(v) AS vmin, max(v) AS vmax,
              stddev_samp(v) * pow(count(*), -0.2e0) AS h
       FROM lm WHERE v IS NOT NULL AND failure IS NOT NULL GROUP BY m, failure),
st2 AS (SELECT *, vmin - 3e0 * h AS lo, (vmax - vmin + 2e0 * 3e0 * h) / 199e0 AS step FROM st WHERE h > 0),
grid AS (SELECT st2.*, r.k, lo + r.k * step AS x FROM st2, (SELECT CAST(range AS INTEGER) AS k FROM range(200)) r)""")


# ---- sampling and splitting --------------------------------------------------
MD5KEY = "md5('42:' || device || ':' || CAST(date AS VARCHAR))"
PROPS = "props(strt, p) AS (VALUES (0, 0.1e0), (1, 0.6e0), (2, 0.3e0))"


def counts_sql(src: str, name: str = "cnts") -> str:
    return f"""{name}_c AS (SELECT strt, count(*) AS n_rows FROM {src} GROUP BY strt),
{name}_a AS (SELECT n_rows AS n_min, strt AS s_min FROM {name}_c ORDER BY n_rows, strt LIMIT 1),
{name} AS (SELECT c.strt, c.n_rows,
     CAST(floor(least(p.p * a.n_min / pm.p, CAST(c.n_rows AS DOUBLE))) AS BIGINT) AS n
   FROM {name}_c c JOIN props p ON p.strt = c.strt CROSS JOIN {name}_a a JOIN props pm ON pm.strt = a.s_min)"""


sql("q_undersample_counts", "SELECT * FROM cnts", CONTROLS + ", " + PROPS + ", " + counts_sql("ctl"))
sql("q_undersample_counts_cv", "SELECT strt, n_rows, CAST(floor(n * 0.8e0) AS BIGINT) AS n FROM cnts", CONTROLS + ", " + PROPS + ", " + counts_sql("ctl"))
sql("q_undersample", f"""
SELECT * EXCLUDE (rn, n_rows, n) FROM (
  SELECT ctl.*, row_number() OVER (PARTITION BY strt ORDER BY {MD5KEY}) AS rn FROM ctl) r
JOIN cnts USING (strt) WHERE rn <= n""", CONTROLS + ", " + PROPS + ", " + counts_sql("ctl"))
sql("q_undersample_ratio", f"""
SELECT * EXCLUDE (rn, n) FROM (
  SELECT panel.*, row_number() OVER (PARTITION BY failure ORDER BY {MD5KEY}) AS rn FROM panel) r
JOIN q USING (failure) WHERE rn <= n""", """fc AS (SELECT failure, count(*) AS n_rows FROM panel GROUP BY failure),
q AS (SELECT failure, CAST(least(CASE WHEN n_rows = min(n_rows) OVER () THEN n_rows
        ELSE floor(min(n_rows) OVER () / (0.3e0 / (1e0 - 0.3e0))) END, n_rows) AS BIGINT) AS n FROM fc)""")

SPLIT = f"CASE WHEN row_number() OVER (ORDER BY {MD5KEY}) <= ceil(0.2e0 * count(*) OVER ()) THEN 'test' ELSE 'train' END"
sql("q_split", f"SELECT *, {SPLIT} AS split FROM panel")


def _balance(var: str) -> str:
    return f"""SELECT '{var}' AS var, CAST({var} AS INTEGER) AS value,
  CAST(count_if(split = 'train') AS BIGINT) AS train_cnt, count_if(split = 'train') / count(*) AS train_pct,
  CAST(CASE WHEN count_if(split = 'test') > 0 THEN count_if(split = 'test') END AS BIGINT) AS test_cnt,
  CASE WHEN count_if(split = 'test') > 0 THEN count_if(split = 'test') END / count(*) AS test_pct
FROM sp WHERE {var} IS NOT NULL GROUP BY {var} HAVING count_if(split = 'train') > 0"""


SPLIT_CTE = CONTROLS + f", sp AS (SELECT *, {SPLIT} AS split FROM ctl)"
sql("q_split_balance", _balance("failure") + "\nUNION ALL\n" + _balance("strt"), SPLIT_CTE)
sql("q_folds", "SELECT *, CAST((row_number() OVER (PARTITION BY strt ORDER BY md5('fold42:' || device || ':' || CAST(date AS VARCHAR))) - 1) % 5"
               " AS INTEGER) AS fold FROM ctl", CONTROLS)

BAGS = (SPLIT_CTE + ", " + PROPS + ", tr AS (SELECT * FROM sp WHERE split = 'train'), " + counts_sql("tr")
        + """, full_c AS (SELECT strt, count(*) AS n_rows FROM ctl GROUP BY strt),
est AS (SELECT CAST(round_even(f.n_rows / t.n, 0) AS INTEGER) AS estimators FROM full_c f JOIN cnts t ON f.strt = t.strt WHERE f.strt = 1), bg AS (SELECT * EXCLUDE (rn, n_rows, n) FROM (
  SELECT CAST(b.range AS INTEGER) AS bag, tr.*, row_number() OVER (PARTITION BY b.range, strt
         ORDER BY md5('42:' || CAST(b.range AS VARCHAR) || ':' || device || ':' || CAST(date AS VARCHAR))) AS rn
  FROM tr CROSS JOIN (SELECT unnest(range(greatest(estimators, 1))) AS range FROM est) b) r JOIN cnts USING (strt) WHERE rn <= n)""")
sql("q_bags", "SELECT bag, device, date, strt FROM bg", BAGS)
sql("q_bag_coverage", """
SELECT c.strt, c.n_rows, c.n, coalesce(v.covered, 0) AS covered, coalesce(v.covered, 0) / c.n_rows AS coverage,
       CASE WHEN c.strt = 1 THEN e.estimators END AS estimators
FROM cnts c LEFT JOIN (SELECT strt, count(*) AS covered FROM (SELECT DISTINCT strt, device, date FROM bg) d
                       GROUP BY strt) v USING (strt)
CROSS JOIN est e""", BAGS)


# ---- transforms -----------------------------------------------------------------
import numpy as _np  # noqa: E402

from faultline.functions import columns as _cols  # noqa: E402

CH_KEEP_COLS = ["ch1", "ch2", "ch4", "ch5", "ch6", "ch7"]
NRM = ["m2", "m3", "m4", "m7", "m9"]
QT = ["m1", "m5", "m6"]
REFS = [float(v) for v in _np.linspace(0, 1, 500)]
REFS_SQL = "[" + ", ".join(f"{v!r}e0" if "e" not in repr(v) else repr(v) for v in REFS) + "]"


def probit_sql(p: str) -> str:
    """AS 241 as DuckDB SQL text (the text generator the Spark plan uses)."""
    return _cols.probit_text(p, num=lambda v: f"{float(v)!r}" if "e" in repr(float(v)) else f"{float(v)!r}e0")


def quantile_sql(src: str, cols: list[str], keep: list[str]) -> str:
    """CTEs ``qk`` (knots), ``qu`` (uniform value), ``qz`` (normal scores) over ``src``."""
    knots = ", ".join(f"quantile_cont(CAST({c} AS DOUBLE), {REFS_SQL}) AS k_{c}" for c in cols)
    us = []
    for c in cols:
        x, q = f"CAST(s.{c} AS DOUBLE)", f"qk.k_{c}"
        lt = f"len(list_filter({q}, lambda v: v < {x}))"
        le = f"len(list_filter({q}, lambda v: v <= {x}))"
        r = REFS_SQL
        on_knot = f"(({r})[greatest({le}, 1)] + ({r})[least({lt} + 1, 500)]) / 2"
        j = f"greatest({lt}, 1)"
        j1 = f"least({j} + 1, 500)"
        between = (f"({r})[{j}] + ({x} - {q}[{j}]) * ((({r})[{j1}] - ({r})[{j}]) / "
                   f"nullif({q}[{j1}] - {q}[{j}], 0))")
        us.append(f"CASE WHEN {x} - 1e-7 < {q}[1] THEN 0e0 WHEN {x} + 1e-7 > {q}[500] THEN 1e0 "
                  f"WHEN {le} > {lt} THEN {on_knot} ELSE {between} END AS u_{c}")
    zs = []
    for c in cols:
        z = (f"CASE WHEN u_{c} <= 0 THEN {_cols_clip('min')} WHEN u_{c} >= 1 THEN {_cols_clip('max')} "
             f"ELSE {probit_sql(f'u_{c}')} END")
        zs.append(f"least(greatest({z}, {_cols_clip('min')}), {_cols_clip('max')}) AS {c}")
    keep_s = ", ".join(f"s.{k}" for k in keep)
    return (f"qk AS (SELECT {knots} FROM {src}), "
            f"qu AS (SELECT {keep_s}, {', '.join(us)} FROM {src} s, qk), "
            f"qz AS (SELECT {', '.join(keep)}, {', '.join(zs)} FROM qu)")


def _cols_clip(which: str) -> str:
    from faultline.operators.transforms import CLIP_MAX, CLIP_MIN
    return f"{(CLIP_MIN if which == 'min' else CLIP_MAX)!r}"


def minmax_sql(c: str) -> str:
    return (f"(CAST({c} AS DOUBLE) - min(CAST({c} AS DOUBLE)) OVER ()) / (CASE WHEN max({c}) OVER () - "
            f"min({c}) OVER () = 0 THEN 1e0 ELSE max(CAST({c} AS DOUBLE)) OVER () - min(CAST({c} AS DOUBLE)) OVER () END)")


def standard_sql(c: str) -> str:
    return (f"(CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) / (CASE WHEN stddev_pop(CAST({c} AS DOUBLE)) "
            f"OVER () = 0 THEN 1e0 ELSE stddev_pop(CAST({c} AS DOUBLE)) OVER () END)")


sql("q_minmax", "SELECT device, date, " + ", ".join(f"{r6(minmax_sql(c))} AS {c}" for c in CH_KEEP_COLS)
    + " FROM chg", NODUP + ", " + change_ctes("nd", M_NODUP, keep_inf=False))
sql("q_standard", "SELECT device, date, " + ", ".join(f"{r6(standard_sql(c))} AS {c}" for c in NRM)
    + " FROM panel")
sql("q_quantile", "SELECT device, date, " + ", ".join(f"{r6(c)} AS {c}" for c in QT) + " FROM qz",
    quantile_sql("panel", QT, ["device", "date"]))


def ranked_ctes(src: str) -> str:
    sr = ", ".join(f"CASE WHEN {m} IS NULL THEN NULL ELSE CAST(rank() OVER (ORDER BY {m}) - 1 AS BIGINT) "
                   f"/ count(*) OVER () END AS {m.replace('m', 'sr', 1)}" for m in M_NODUP)
    return (f"rk AS (SELECT *, {sr} FROM {src}), "
            f"rk2 AS (SELECT *, ({' + '.join(SR_COLS)}) / {len(SR_COLS)} AS srav FROM rk), "
            f"rk3 AS (SELECT *, greatest({', '.join(SR_COLS)}, srav) AS srmx FROM rk2)")


FEATURE_COLS = (["device", "date"] + M_NODUP + ["failure", "L1", "L2", "L12", "Q", "M", "D", "MW", "WD", "WE"]
                + CH_KEEP_COLS + ["sr2", "sr3", "sr4", "sr7", "sr9", "srmx", "f0", "strt"])
FEATURES = (NODUP + f", f1 AS (SELECT *, {DEVICE_COLS}, {DATE_COLS} FROM nd), "
            + change_ctes("f1", M_NODUP, keep_inf=False) + ", " + ranked_ctes("chg")
            + """, fz AS (SELECT *, CAST((coalesce(m2,0) + coalesce(m3,0) + coalesce(m4,0) + coalesce(m7,0)
                        + coalesce(m9,0)) = 0 AS INTEGER) AS f0 FROM rk3),
fin AS (SELECT """ + ", ".join(FEATURE_COLS[:-1]) + """,
        CASE WHEN failure = 1 THEN 2 WHEN failure = 0 AND f0 = 0 THEN 1 ELSE 0 END AS strt FROM fz)""")
sql("q_features", "SELECT * FROM fin", FEATURES)

PLAN_SR = ["sr2", "sr3", "sr4", "sr7", "sr9", "srmx"]
sql("q_transform", "SELECT f.device, f.date, " + ", ".join(
    [f"{r6('qz.' + c)} AS {c}" for c in QT] + [f"{r6(standard_sql('f.' + c))} AS {c}" for c in NRM]
    + [f"{r6(minmax_sql('f.' + c))} AS {c}" for c in CH_KEEP_COLS] + [f"{r6('f.' + c)} AS {c}" for c in PLAN_SR])
    + " FROM fin f JOIN qz ON qz.device = f.device AND qz.date = f.date",
    FEATURES + ", " + quantile_sql("fin", QT, ["device", "date"]))

# A principal component analysis keeps the trace: all variances add up to those of its columns.
_PCA_COLS = ([(c, f"qz.{c}") for c in QT] + [(c, standard_sql(f"f.{c}")) for c in NRM]
             + [(c, minmax_sql(f"f.{c}")) for c in CH_KEEP_COLS] + [(c, f"f.{c}") for c in PLAN_SR])
sql("q_pca_trace", f"SELECT CAST({len(_PCA_COLS)} AS INTEGER) AS components, "
    + r6(" + ".join(f"var_samp({c})" for c, _ in _PCA_COLS)) + " AS total, 1e0 AS share FROM (SELECT "
    + ", ".join(f"{e} AS {c}" for c, e in _PCA_COLS) + " FROM fin f JOIN qz ON qz.device = f.device AND qz.date = f.date) t",
    FEATURES + ", " + quantile_sql("fin", QT, ["device", "date"]))

# Principal components by classical Jacobi rotations of the covariance (row-major lists), the largest element beside the diagonal first.
_D = len(_PCA_COLS)
PCA_CTES = (
    FEATURES + ", " + quantile_sql("fin", QT, ["device", "date"])
    + ", tr AS (SELECT f.*, " + ", ".join(f"{e} AS t_{c}" for c, e in _PCA_COLS) + " FROM fin f JOIN qz ON qz.device = f.device AND qz.date = f.date), "
    "pcov AS (SELECT [" + ", ".join(f"covar_samp(t_{a}, t_{b})" for a, _ in _PCA_COLS for b, _ in _PCA_COLS) + "] AS m, ["
    + ", ".join(f"avg(t_{c})" for c, _ in _PCA_COLS) + "] AS mu FROM tr), "
    f"""jac(it, m, v) AS (
  SELECT 0, m, list_transform(range({_D * _D}), lambda k: CASE WHEN k // {_D} = k % {_D} THEN 1e0 ELSE 0e0 END) FROM pcov
  UNION ALL
  SELECT it + 1,
    list_transform(range({_D * _D}), lambda k: CASE
      WHEN k // {_D} = k % {_D} THEN CASE WHEN k // {_D} = p THEN m[k + 1] - t * apq WHEN k // {_D} = q THEN m[k + 1] + t * apq ELSE m[k + 1] END
      WHEN (k // {_D} = p AND k % {_D} = q) OR (k // {_D} = q AND k % {_D} = p) THEN 0e0
      WHEN k % {_D} = p THEN cs * m[(k // {_D}) * {_D} + p + 1] - sn * m[(k // {_D}) * {_D} + q + 1]
      WHEN k % {_D} = q THEN sn * m[(k // {_D}) * {_D} + p + 1] + cs * m[(k // {_D}) * {_D} + q + 1]
      WHEN k // {_D} = p THEN cs * m[(k % {_D}) * {_D} + p + 1] - sn * m[(k % {_D}) * {_D} + q + 1]
      WHEN k // {_D} = q THEN sn * m[(k % {_D}) * {_D} + p + 1] + cs * m[(k % {_D}) * {_D} + q + 1]
      ELSE m[k + 1] END),
    list_transform(range({_D * _D}), lambda k: CASE
      WHEN k % {_D} = p THEN cs * v[k + 1] - sn * v[(k // {_D}) * {_D} + q + 1]
      WHEN k % {_D} = q THEN sn * v[(k // {_D}) * {_D} + p + 1] + cs * v[k + 1]
      ELSE v[k + 1] END)
  FROM (SELECT *, 1e0 / sqrt(1 + t * t) AS cs, t / sqrt(1 + t * t) AS sn FROM (
    SELECT *, (CASE WHEN th < 0 THEN -1e0 ELSE 1e0 END) / (abs(th) + sqrt(1 + th * th)) AS t FROM (
      SELECT *, m[p * {_D} + q + 1] AS apq, (m[q * {_D} + q + 1] - m[p * {_D} + p + 1]) / (2 * m[p * {_D} + q + 1]) AS th FROM (
        SELECT *, least(pos // {_D}, pos % {_D}) AS p, greatest(pos // {_D}, pos % {_D}) AS q FROM (
          SELECT it, m, v, off, list_position(off, list_max(off)) - 1 AS pos FROM (
            SELECT it, m, v, list_transform(range({_D * _D}), lambda k: CASE WHEN k // {_D} = k % {_D} THEN 0e0 ELSE abs(m[k + 1]) END) AS off FROM jac
            WHERE it < 20000) o WHERE list_max(off) > 1e-17) a) b) c) d) e),
eig AS (SELECT m, v FROM jac ORDER BY it DESC LIMIT 1),
comp AS (SELECT row_number() OVER (ORDER BY val DESC, k) AS pc, val, CASE WHEN abs(list_min(vec)) > list_max(vec) THEN list_transform(vec, lambda x: -x) ELSE vec END AS vec
         FROM (SELECT k, greatest(m[k * {_D} + k + 1], 0e0) AS val, list_transform(range({_D}), lambda i: v[i * {_D} + k + 1]) AS vec
               FROM eig, (SELECT unnest(range({_D})) AS k) ks) e),
vecs AS (SELECT list(vec ORDER BY pc) AS vs FROM comp)""")
_CENTRED = "[" + ", ".join(f"t_{c} - mu[{i + 1}]" for i, (c, _) in enumerate(_PCA_COLS)) + "]"
PCA_SCORES = ", ".join(f"{r6(f'list_dot_product({_CENTRED}, vs[{k + 1}])')} + 0e0 AS pc{k + 1}" for k in range(_D))
sql("q_pca", f"SELECT device, date, {PCA_SCORES} FROM tr, vecs, pcov", PCA_CTES)
sql("q_scree", f"""SELECT 'pc' || pc AS component, CAST(pc AS INTEGER) AS k, {r6("val / sum(val) OVER ()")} AS var,
       {r6("sum(val) OVER (ORDER BY pc) / sum(val) OVER ()")} AS cumvar FROM comp""", PCA_CTES)

_enc = ["L1", "L2", "L12", "Q", "M", "D", "MW", "WD", "WE"]
_num_enc = {"Q", "M", "D", "MW", "WD", "WE"}
sql("q_one_hot", """
SELECT l.device, l.date, l.c || '_' || l.v AS feature FROM lng l JOIN firsts f ON f.c = l.c WHERE l.v <> f.first""",
    f"fe AS (SELECT device, date, {DEVICE_COLS}, {DATE_COLS} FROM panel), "
    f"lng AS ({unpivot('fe', ['device', 'date'], _enc, 'c', 'v', 'VARCHAR')}), "
    "firsts AS (SELECT c, CASE WHEN c IN (" + ", ".join(f"'{c}'" for c in _num_enc) + ") "
    "THEN CAST(min(TRY_CAST(v AS BIGINT)) AS VARCHAR) ELSE min(v) END AS first FROM lng GROUP BY c)")
# The model table: a column per category but the first, however many the data have.
sql("q_prepared", f"""SELECT t.device, t.date, coalesce(COLUMNS('^(L1|L2|L12|Q|M|D|MW|WD|WE)_.*'), 0)::INTEGER, {PCA_SCORES}, f0, strt, failure
FROM (SELECT * FROM tr, vecs, pcov) t LEFT JOIN (PIVOT (SELECT l.device, l.date, l.c || '_' || l.v AS feature FROM lng l JOIN firsts f ON f.c = l.c
  WHERE l.v <> f.first) ON feature USING count(*) GROUP BY device, date) e ON e.device = t.device AND e.date = t.date""",
    PCA_CTES + f", lng AS ({unpivot('fin', ['device', 'date'], _enc, 'c', 'v', 'VARCHAR')}), "
    "firsts AS (SELECT c, CASE WHEN c IN (" + ", ".join(f"'{c}'" for c in _num_enc) + ") "
    "THEN CAST(min(TRY_CAST(v AS BIGINT)) AS VARCHAR) ELSE min(v) END AS first FROM lng GROUP BY c)")

# Yeo-Johnson: the likelihood of 41 lambdas over the distinct values, the grid narrowed around the best (widened while it lies at an end).
def _yj(x: str, lam: str) -> str:
    return (f"CASE WHEN {x} >= 0 THEN CASE WHEN abs({lam}) < 1e-12 THEN ln(1 + {x}) ELSE (pow({x} + 1, {lam}) - 1) / {lam} END "
            f"ELSE CASE WHEN abs({lam} - 2) < 1e-12 THEN -ln(1 - {x}) ELSE -(pow(1 - {x}, 2 - {lam}) - 1) / (2 - {lam}) END END")


sql("q_yeo_johnson", "SELECT p.device, p.date, " + ", ".join(
    r6(f"({_yj(f'CAST(p.{c} AS DOUBLE)', f'w.{c}.lam')} - w.{c}.mean) / (CASE WHEN w.{c}.std = 0 THEN 1e0 ELSE w.{c}.std END)") + f" AS {c}"
    for c in M_NODUP + ["m8"]) + " FROM panel p, wide w",
    f"yv AS (SELECT c, CAST(x AS DOUBLE) AS x FROM ({unpivot('panel', ['device', 'date'], METRICS, 'c', 'x', 'DOUBLE')}) u WHERE x IS NOT NULL), "
    f"""yr(c, a, b, inside, rounds, best) AS (
  SELECT DISTINCT c, -4e0, 4e0, false, 4, 0e0 FROM yv
  UNION ALL
  SELECT c, CASE WHEN wider THEN 2 * a ELSE lam - (b - a) / 40 END, CASE WHEN wider THEN 2 * b ELSE lam + (b - a) / 40 END,
         inside OR NOT wider, CASE WHEN wider THEN rounds ELSE rounds - 1 END, lam
  FROM (SELECT *, NOT inside AND (i IN (0, 40)) AND b - a < 4096 AS wider FROM (
    SELECT c, a, b, inside, rounds, arg_max(i, llf) AS i, arg_max(lam, llf) AS lam FROM (
      SELECT c, a, b, inside, rounds, i, lam,
             -count(x) / 2e0 * ln(nullif(var_pop({_yj('x', 'lam')}), 0)) + (lam - 1) * sum(sign(x) * ln(1 + abs(x))) AS llf
      FROM (SELECT r.*, i, a + i * ((b - a) / 40) AS lam FROM yr r, (SELECT unnest(range(41)) AS i) g WHERE rounds > 0) l JOIN yv USING (c)
      GROUP BY c, a, b, inside, rounds, i, lam) x GROUP BY c, a, b, inside, rounds) y) z),
yb AS (SELECT c, best FROM yr WHERE rounds = 0),
ys AS (SELECT c, best AS lam, avg({_yj('x', 'best')}) AS mean, stddev_pop({_yj('x', 'best')}) AS std FROM yv JOIN yb USING (c) GROUP BY c, best),
wide AS (SELECT """ + ", ".join(f"max(CASE WHEN c = '{c}' THEN {{'lam': lam, 'mean': mean, 'std': std}} END) AS {c}" for c in METRICS) + " FROM ys)")


# ---- evaluation on a deterministic score ---------------------------------------
SCORED = ("sc AS (SELECT *, least(1e0, (2 * failure + m5 + m2) / 16e0) AS y_proba, "
          "least(1e0, (failure + m3 + m9) / 8e0) AS y_proba2 FROM panel)")


def conf_sql(src: str, score: str, t: str, extra: str = "") -> str:
    return (f"SELECT {extra}CAST(count_if(failure = 0 AND NOT ({score} >= {t})) AS BIGINT) AS TN, "
            f"CAST(count_if(failure = 0 AND {score} >= {t}) AS BIGINT) AS FP, "
            f"CAST(count_if(failure = 1 AND NOT ({score} >= {t})) AS BIGINT) AS FN, "
            f"CAST(count_if(failure = 1 AND {score} >= {t}) AS BIGINT) AS TP FROM {src}")


def curve_ctes(score: str = "y_proba", src: str = "sc") -> str:
    return f"""g AS (SELECT {score} AS s, count_if(failure = 1) AS pos, count_if(failure <> 1) AS neg
       FROM {src} WHERE {score} IS NOT NULL GROUP BY {score}),
gc AS (SELECT *, coalesce(sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bp,
              coalesce(sum(neg) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bn
       FROM g),
tot AS (SELECT sum(pos) AS P, min(CASE WHEN pos > 0 THEN s END) AS tmin FROM g),
pts AS (SELECT CAST(s AS DOUBLE) AS threshold,
               coalesce((bp + pos) / nullif(bp + pos + bn + neg, 0), 0e0) AS precision,
               (bp + pos) / nullif(P, 0) AS recall FROM gc, tot WHERE s >= tmin),
curve AS (SELECT *, 2 * precision * recall / nullif(precision + recall, 0) AS f1 FROM pts
          UNION ALL SELECT NULL, 1e0, 0e0, 0e0),
best AS (SELECT threshold, f1 FROM curve WHERE f1 IS NOT NULL AND NOT isnan(f1)
         ORDER BY f1 DESC, threshold ASC NULLS LAST LIMIT 1)"""


sql("q_confusion", conf_sql("sc", "y_proba", "0.5e0"), SCORED)


def auc_sql(score: str, src: str = "sc") -> str:
    c = curve_ctes(score, src).split(",\ntot AS")[0]
    return (c, "(SELECT sum(neg * (bp + 0.5e0 * pos)) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) FROM gc)")


_a1, _a2 = curve_ctes("y_proba").split(",\ntot AS")[0], curve_ctes("y_proba2").split(",\ntot AS")[0]
sql("q_auc", f"SELECT {r6('sum(neg * (bp + 0.5e0 * pos)) / (CAST(sum(pos) AS DOUBLE) * sum(neg))')} AS auroc FROM gc",
    SCORED + ", " + _a1)
_conf_rates = """SELECT model, coalesce(2 * pr * rc / nullif(pr + rc, 0), 0e0) AS f1, rc AS recall, pr AS precision,
       {auc} AS auroc, TN, FP, FN, TP FROM (
  SELECT *, coalesce(TP / nullif(TP + FP, 0), 0e0) AS pr, coalesce(TP / nullif(TP + FN, 0), 0e0) AS rc FROM ({conf}) c) x"""
sql("q_scores", "\nUNION ALL\n".join(
    _conf_rates.format(auc=f"(SELECT {r6('sum(neg * (bp + 0.5e0 * pos)) / (CAST(sum(pos) AS DOUBLE) * sum(neg))')} FROM {gc})",
                       conf=conf_sql("sc", s, "0.95e0", f"'{m}' AS model, "))
    for m, s, gc in (("s1", "y_proba", "gc1"), ("s2", "y_proba2", "gc2"))),
    SCORED + ", " + _a1.replace("g AS", "g1 AS", 1).replace("FROM g)", "FROM g1)").replace("gc AS", "gc1 AS", 1)
    + ", " + _a2.replace("g AS", "g2 AS", 1).replace("FROM g)", "FROM g2)").replace("gc AS", "gc2 AS", 1))
sql("q_pr_curve", "SELECT * FROM curve", SCORED + ", " + curve_ctes())
sql("q_best_threshold", "SELECT * FROM best", SCORED + ", " + curve_ctes())
sql("q_threshold_sweep", """
SELECT t.threshold, CAST(count_if(failure = 0 AND NOT (y_proba >= t.threshold)) AS BIGINT) AS TN,
       CAST(count_if(failure = 0 AND y_proba >= t.threshold) AS BIGINT) AS FP,
       CAST(count_if(failure = 1 AND NOT (y_proba >= t.threshold)) AS BIGINT) AS FN,
       CAST(count_if(failure = 1 AND y_proba >= t.threshold) AS BIGINT) AS TP
FROM sc, ts t GROUP BY t.threshold, t.i""", SCORED + ", " + curve_ctes() + """,
ts AS (SELECT * FROM (VALUES (0, 0.8e0), (1, 0.85e0), (2, 0.9e0), (3, 0.95e0), (4, 0.965e0)) v(i, threshold)
       UNION ALL SELECT 5, threshold FROM best WHERE threshold IS NOT NULL)""")


# ---- a tree's first split: cuts at 256 quantiles of the distinct values, every one tried -----------
_NUMS = M_NODUP + CH_KEEP_COLS + PLAN_SR
_W = {0: "0.1e0", 1: "0.6e0", 2: "0.3e0"}
sql("q_tree_stump", f"""SELECT feature, cut, side, {r6("w0")} AS w0, {r6("w1")} AS w1, {r6("w2")} AS w2 FROM (
  SELECT feature, cut, 'left' AS side, l0 AS w0, l1 AS w1, l2 AS w2 FROM best UNION ALL SELECT feature, cut, 'right', r0, r1, r2 FROM best) b""",
    FEATURES + f""", trn AS (SELECT * FROM (SELECT *, {SPLIT} AS split FROM fin) s WHERE split = 'train'),
lf AS ({unpivot('trn', ['device', 'date', 'strt'], _NUMS, 'feature', 'v', 'DOUBLE')}),
dv AS (SELECT feature, list(v ORDER BY v) AS vs FROM (SELECT DISTINCT feature, v FROM lf WHERE v IS NOT NULL) d GROUP BY feature),
ct AS (SELECT DISTINCT feature, vs[CAST(ceil((i + 1) / 256e0 * len(vs)) AS BIGINT)] AS cut, vs[len(vs)] AS top FROM dv, (SELECT unnest(range(256)) AS i) g),
sides AS (SELECT ct.feature, cut, """ + ", ".join(
        f"{_W[c]} * count_if(strt = {c} AND NOT coalesce(v > cut, false)) AS l{c}, {_W[c]} * count_if(strt = {c} AND v > cut) AS r{c}" for c in range(3))
    + """ FROM ct JOIN lf USING (feature) WHERE cut < top GROUP BY ct.feature, cut),
gains AS (SELECT *, (l0*l0 + l1*l1 + l2*l2) / (l0 + l1 + l2) + (r0*r0 + r1*r1 + r2*r2) / (r0 + r1 + r2) AS gain,
          list_position([""" + ", ".join(f"'{c}'" for c in _NUMS) + """], feature) AS place FROM sides),
best AS (SELECT * FROM gains WHERE gain >= (SELECT max(gain) FROM gains) * (1 - 1e-9) ORDER BY place, cut LIMIT 1)""")


# ---- small report aggregates -----------------------------------------------------
sql("q_distinct_levels", f"SELECT DISTINCT L12 FROM (SELECT {DEVICE_COLS} FROM panel) d")
sql("q_score_range", 'SELECT max(y_proba) AS "max", min(y_proba) AS "min", max(y_proba) - min(y_proba) AS "range" FROM sc', SCORED)
sql("q_best_day_metric", """SELECT m5, share FROM (SELECT m5, avg(CAST(failure AS DOUBLE)) AS share FROM panel GROUP BY m5)
ORDER BY share DESC, m5 LIMIT 1""")
sql("q_shape", "SELECT count(*) AS n_rows, CAST(12 AS BIGINT) AS n_cols FROM panel")


# ---- rug sample, bootstrap -------------------------------------------------------
# Poisson(1): P(K <= k) for k = 0, 1, ... while a double tells it from 1.
POISSON_CDF = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(18)]

sql("q_rug_sample", """
SELECT device, date, failure, m, x FROM (
  SELECT *, row_number() OVER (PARTITION BY m, failure
         ORDER BY md5('42:' || m || ':' || device || ':' || CAST(date AS VARCHAR))) AS rn
  FROM lk WHERE failure IS NOT NULL) r WHERE rn <= 2500""",
    f"lk AS ({unpivot('panel', ['device', 'date', 'failure'], METRICS, 'm', 'x', 'DOUBLE')})")

_u = ("(('0x' || substr(md5('boot42:' || CAST(b.range AS VARCHAR) || ':' || device || ':' || CAST(date AS VARCHAR)), 1, 13))"
      "::BIGINT / 4503599627370496e0)")
_w = " + ".join(f"CAST({_u} > {c!r} AS INTEGER)" for c in POISSON_CDF)
sql("q_bootstrap", f"""
SELECT bag, device, date, strt, weight FROM (
  SELECT CAST(b.range AS INTEGER) AS bag, device, date, strt, CAST({_w} AS INTEGER) AS weight
  FROM sp CROSS JOIN range(3) b WHERE split = 'train') t WHERE weight > 0""", SPLIT_CTE)


# ---- names, keys, files ------------------------------------------------------------
sql("q_rename", "SELECT device, date, " + " + ".join(f"CAST({m} = 0 AS INTEGER)" for m in METRICS) + " AS n_zero, "
    + ", ".join(f"{m} AS {m.replace('m', 'metric_')}" for m in METRICS) + ", failure FROM panel")
sql("q_rows_for_keys", "SELECT * FROM panel WHERE device IN (SELECT device FROM panel WHERE failure = 1)")


def _short(c: str) -> str:
    k = " + ".join(f"CAST(abs({c}) >= 1e{3 * i} AS INTEGER)" for i in range(1, 6))
    unit = f"CAST(pow(10, 3 * ({k}) - 2) AS BIGINT)"                   # hundredths of the suffix; halves are rounded up
    q = f"(({c} + {unit} // 2) // {unit})"
    return (f"CASE WHEN {c} < 1000 THEN CAST({c} AS VARCHAR) ELSE CAST({q} // 100 AS VARCHAR) || '.' || lpad(CAST({q} % 100 AS VARCHAR), 2, '0') || "
            f"['', 'K', 'M', 'G', 'T', 'P'][{k} + 1] END AS {c}")


sql("q_abbreviated", f"SELECT device, {_short('m1')}, {_short('m6')}, strftime(last, '%Y%m%d_%H%M') AS last FROM per",
    "per AS (SELECT device, CAST(sum(m1) AS BIGINT) AS m1, CAST(sum(m6) AS BIGINT) AS m6, CAST(max(date) AS TIMESTAMP) AS last FROM panel GROUP BY device)")
sql("q_strata_scores", f"""SELECT {r6("2e0 * tp / (2 * tp + fp + fn)")} AS value, 'f1' AS score FROM (
  SELECT count_if(strt = 2 AND p >= 0.5e0) AS tp, count_if(strt <> 2 AND p >= 0.5e0) AS fp, count_if(strt = 2 AND p < 0.5e0) AS fn FROM ps) c
UNION ALL SELECT {r6("sum(neg * (before + 0.5e0 * pos)) / (CAST(sum(pos) AS DOUBLE) * sum(neg))")}, 'auroc' FROM (
  SELECT count_if(strt = 2) AS pos, count_if(strt <> 2) AS neg,
         coalesce(sum(count_if(strt = 2)) OVER (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ps GROUP BY p) g""",
    CONTROLS + ", ps AS (SELECT strt, least(1e0, (2 * failure + m5 + m2) / 16e0) AS p FROM ctl)")
sql("q_pr_points", """SELECT threshold, 'precision' AS metric, precision AS value FROM curve
UNION ALL SELECT threshold, 'recall', recall FROM curve""", SCORED + ", " + curve_ctes())
sql("q_csv_panel", "SELECT * FROM panel")
ORACLE["q_csv_results"] = ORACLE["q_strata_share"]
