"""Panel column groups and explicit Spark schemas.

The analysis keeps its column groups in an immutable ``PanelSchema`` that each
stage receives and returns (a new instance) instead of mutable globals.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

# Fixed values of the problem (must equal the analysed study for equal results).
KEY_COLS = ("device", "date")
METRIC_COLS = ("m1", "m2", "m3", "m4", "m5", "m6", "m7", "m8", "m9")
TARGET_COL = "failure"
ZERO_DENSE_COLS = ("m2", "m3", "m4", "m7", "m8", "m9")
DUPLICATE_COLS = ("m8",)
CHANGE_DROP = ("elapsed", "ch3", "ch9")
RANK_DROP = ("sr1", "sr5", "sr6", "srav")
DEVICE_LEVELS = {"L1": (1, 2), "L2": (3, 2), "L12": (1, 4)}   # name -> (start, length)
DATE_PARTS = ("Q", "M", "D", "MW", "WD", "WE")
STRATA_P = {0: 0.1, 1: 0.6, 2: 0.3}
BEST_STRATA_P = {0: 0.05, 1: 0.75, 2: 0.2}
# Grid of the study's first random search: strata proportions, and parameters of the balanced forest.
STRATA_GRID = [{0: 0.05, 1: 0.8, 2: 0.15}, {0: 0.1, 1: 0.75, 2: 0.15}, {0: 0.05, 1: 0.75, 2: 0.2}, {0: 0.1, 1: 0.7, 2: 0.2},
               {0: 0.1, 1: 0.65, 2: 0.25}, {0: 0.1, 1: 0.6, 2: 0.3}, {0: 0.05, 1: 0.65, 2: 0.3}, {0: 0.05, 1: 0.6, 2: 0.35}]
FOREST_GRID = {"bootstrap": [True, False], "bags": [250, 350, 450], "depth": [10, 30, 40, None],
               "max_features": ["0.5", "0.8", "sqrt"], "min_samples_leaf": [1, 2, 3], "min_samples_split": [2, 3]}
# Grid of the second search: bagged boosted trees.
BOOST_GRID = {"max_features": ["0.5", "0.8", "sqrt"], "depth": [10, 20, 30, 40, None], "rounds": [10, 15, 20, 30],
              "bootstrap": [True, False], "bags": [200, 250, 300, 350, 400, 450]}
RANDOM_STATE = 42
# Transformation plan per numeric feature: yj, qt, nrm, mnmx or none.
TRANSFORM_PLAN = {
    "m1": "qt", "m2": "nrm", "m3": "nrm", "m4": "nrm",
    "m5": "qt", "m6": "qt", "m7": "nrm", "m9": "nrm",
    "ch1": "mnmx", "ch2": "mnmx", "ch4": "mnmx",
    "ch5": "mnmx", "ch6": "mnmx", "ch7": "mnmx",
    "sr2": "none", "sr3": "none", "sr4": "none",
    "sr7": "none", "sr9": "none", "srmx": "none",
}

RAW_FIELDS = [T.StructField("device", T.StringType()), T.StructField("date", T.DateType())]
RAW_FIELDS += [T.StructField(f"attribute{i}", T.LongType()) for i in range(1, 10)]
RAW_FIELDS += [T.StructField("failure", T.IntegerType())]
# Column order of the raw CSV is not documented; the reader maps by header name.
RAW_CSV_SCHEMA = T.StructType(RAW_FIELDS)

PANEL_SCHEMA = T.StructType(
    [T.StructField("device", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(m, T.LongType()) for m in METRIC_COLS]
    + [T.StructField("failure", T.IntegerType())]
)


@dataclass(frozen=True)
class PanelSchema:
    """Column groups of a panel DataFrame as it moves through the stages."""

    cat_cols: tuple = KEY_COLS
    num_cols: tuple = METRIC_COLS
    target_col: str = TARGET_COL
    zdense_cols: tuple = ()
    f0_col: str | None = None
    strt_col: str | None = None
    dev_cols: tuple = ()
    date_cols: tuple = ()
    chng_cols: tuple = ()
    rnk_cols: tuple = ()
    enc_cols: tuple = ()
    pca_cols: tuple = ()
    pca_variance: tuple = ()
    transforms: dict = field(default_factory=dict)

    def with_(self, **kw) -> "PanelSchema":
        return replace(self, **kw)

    @property
    def ncat_cols(self) -> tuple:
        return tuple(self.cat_cols) + tuple(self.dev_cols) + tuple(self.date_cols)

    @property
    def nnum_cols(self) -> tuple:
        return tuple(self.num_cols) + tuple(self.chng_cols) + tuple(self.rnk_cols)

    @property
    def cntr_cols(self) -> tuple:
        return tuple(c for c in (self.f0_col, self.strt_col) if c)
