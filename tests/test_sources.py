"""CSV panel source, result CSV sink/source, number abbreviation."""

import os
import tempfile

import pytest

from pyspark.sql import functions as F

from conftest import SF001


def test_csv_panel_roundtrip(spark):
    from faultline.plans.catalog import panel
    from faultline.sources import load_panel
    df, _ = panel(spark, SF001)
    raw = df.withColumnsRenamed({f"m{i}": f"attribute{i}" for i in range(1, 10)})
    raw = raw.select("failure", "date", "device", *[f"attribute{i}" for i in range(9, 0, -1)])
    path = os.path.join(tempfile.mkdtemp(prefix="faultline-csv-"), "device_failure")
    raw.unionByName(raw.limit(5)).coalesce(1).write.option("header", True).csv(path)   # with duplicates
    back, schema = load_panel(spark, path)
    assert back.columns == ["device", "date"] + [f"m{i}" for i in range(1, 10)] + ["failure"]
    assert schema.num_cols[0] == "m1"
    assert back.count() == df.count()
    assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0


def test_result_csv_sink_and_source(spark):
    from faultline.sources import read_result_csv, write_result_csv
    df = spark.createDataFrame([(0, "m1", 0.25), (1, "m2", 0.3)], "idx int, col string, f1 double")
    base = tempfile.mkdtemp(prefix="faultline-out-")
    path = write_result_csv(df, base, "BBB_feature_scores", stamp="20240101_0000")
    assert path.endswith("BBB_feature_scores_20240101_0000")
    back = read_result_csv(spark, path, schema="idx int, col string, f1 double")
    assert back.columns == ["col", "f1"]
    assert sorted(map(tuple, back.collect())) == [("m1", 0.25), ("m2", 0.3)]


def test_number_abbreviation(spark):
    from faultline.functions import abbreviate
    ints = spark.createDataFrame([(5,), (999,), (1234,), (-5000,), (2500000,)], "n long")
    got = [r[0] for r in ints.select(abbreviate("n", True)).collect()]
    assert got == ["5", "999", "1.23K", "-5000", "2.50M"]
    dbl = spark.createDataFrame([(5.0,), (1234.5,)], "n double")
    assert [r[0] for r in dbl.select(abbreviate("n", False)).collect()] == ["5.00", "1.23K"]


def test_long_ids_stay_apart(spark):
    import datetime

    import duckdb
    from faultline.plans.oracle import PANEL_SQL
    from faultline.sources.panel import panel_from_events
    day = datetime.datetime(2024, 1, 1)
    users = [7, 1000, 9999, 10000, 123456]
    events = spark.createDataFrame([(u, day, "view", 60.0) for u in users], "user_id long, ts timestamp, event_type string, value double")
    got = sorted(r.device for r in panel_from_events(events).collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT unnest([7, 1000, 9999, 10000, 123456])::BIGINT AS user_id, "
                "TIMESTAMP '2024-01-01' AS ts, 'view' AS event_type, 60e0 AS value")
    assert got == sorted(r[0] for r in con.execute(f"SELECT device FROM ({PANEL_SQL})").fetchall())
    assert got == ["S0F0123456", "S0F39999", "S1F01000", "S1F010000", "S1F30007"]


def test_nan_metrics_become_null(spark):
    from faultline.sources.panel import tidy_panel
    row = spark.createDataFrame([("d", None, float("nan"), *[1.0] * 8, 0)],
                                "device string, date date, " + ", ".join(f"attribute{i} double" for i in range(1, 10)) + ", failure int")
    assert tidy_panel(row)[0].first().m1 is None


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    import faultline.session as session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, *a):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_decimals_are_found_if_asked_for(spark, tmp_path):
    from faultline.sources.panel import read_panel_csv, tidy_panel
    path = str(tmp_path / "panel.csv")
    head = "date,device,failure," + ",".join(f"attribute{i}" for i in range(1, 10))
    rows = ["2015-01-01,S1F0,0,5,0.5,3,4,5,6,7,8,9", "2015-01-02,S1F0,1,-6,2,,4,5,6,7,8,9"]
    with open(path, "w", encoding="latin-1") as f:
        f.write("\n".join([head, *rows, ""]))
    with pytest.raises(Exception):
        read_panel_csv(spark, path).collect()
    got = read_panel_csv(spark, path, infer=True)
    types = dict(got.dtypes)
    assert types["attribute1"] == "bigint" and types["attribute2"] == "double" and types["attribute3"] == "bigint"
    panel, _ = tidy_panel(got)
    assert sorted((r.m1, r.m2, r.m3) for r in panel.collect()) == [(-6, 2.0, None), (5, 0.5, 3)]
