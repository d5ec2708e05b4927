"""Operators on small hand-made tables."""

import json
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratafold.functions import scalars
from stratafold.operators import alerts, associate, daily, graph, relations, resample, windows
from stratafold.sources import catalog, sinks
from stratafold.streaming import monitor

T0 = datetime(2024, 1, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


def events(spark, rows):
    return spark.createDataFrame([(str(i), at(h), 1.0 * la, 1.0 * lo, 5.0, float(m)) for i, (h, la, lo, m) in enumerate(rows)], "event_id string, ts timestamp, latitude double, longitude double, depth_km double, magnitude double")


def test_window_is_left_open_and_right_closed(spark):
    table = windows.features(events(spark, [(6, 0, 0, 1), (12, 0, 0, 2)]), {"6h": "6 hours"}, "6 hours").orderBy("endpoint").collect()
    assert [(r["endpoint"], r["event_count"], r["maximum_magnitude"]) for r in table] == [(at(6), 1, 1.0), (at(12), 1, 2.0)]


def test_empty_window_counts_nothing(spark):
    rows = {r["endpoint"]: r for r in windows.features(events(spark, [(1, 0, 0, 1), (20, 0, 0, 2)]), {"6h": "6 hours"}, "6 hours").collect()}
    assert rows[at(12)]["event_count"] == 0 and rows[at(12)]["cumulative_energy"] == 0.0 and rows[at(12)]["median_magnitude"] is None


def test_daily_gap_and_constant_series(spark):
    days = daily.daily(events(spark, [(0, 0, 0, 1), (72, 0, 0, 1)])).orderBy("day").collect()
    assert [r["n_events"] for r in days] == [1, 0, 0, 1]
    one = daily.daily(events(spark, [(0, 0, 0, 1)])).collect()
    assert one[0]["mag_n"] == 0.0 and daily.with_memory(daily.daily(events(spark, []))).count() == 0


def test_episode_survives_two_normal_rows_not_three(spark):
    levels = "attention normal normal anomaly normal normal normal attention".split()
    found = alerts.episodes(spark.createDataFrame([(at(i), x) for i, x in enumerate(levels)], "endpoint timestamp, level string")).orderBy("start").collect()
    assert [(r["start"], r["end"], r["maximum_level"], r["duration_hours"]) for r in found] == [(at(0), at(3), "anomaly", 3.0), (at(7), at(7), "attention", 0.0)]


def test_cluster_gap_is_exclusive_and_largest_represents(spark):
    found = associate.clusters(events(spark, [(0, 0, 0, 1), (24, 0, 0, 3), (48.5, 0, 0, 3)])).orderBy("start").collect()
    assert [(r["event_count"], r["representative_id"], r["cluster_id"]) for r in found] == [(2, "1", 1), (1, "2", 2)]


def test_association_classes(spark):
    episodes = spark.createDataFrame([(1, at(0), at(2)), (2, at(10), at(11)), (3, at(30), at(31)), (4, at(90), at(91))], "episode_id int, start timestamp, end timestamp")
    targets = spark.createDataFrame([(1, at(2)), (2, at(15)), (3, at(80))], "cluster_id int, ts timestamp")
    got = {r["episode_id"]: (r["association"], r["n_targets"]) for r in associate.associate(episodes, targets, 6).collect()}
    assert got == {1: ("overlapping", 1), 2: ("associated", 1), 3: ("remote", 0), 4: ("unassociated", 0)}


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    got = {r["i"]: r["q_value"] for r in associate.benjamini_hochberg(spark.createDataFrame([("a", i, x) for i, x in enumerate(p)], "k string, i int, p_value double"), ["k"]).collect()}
    assert [round(got[i], 6) for i in range(4)] == [0.04, 0.053333, 0.053333, 0.5]


def test_spearman_against_pandas_with_ties_and_missing(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": "w", "a": rng.integers(0, 9, 60).astype(float), "b": rng.normal(size=60), "c": 1.0})
    pdf.loc[::7, "b"] = np.nan
    got = {r["pair_id"]: r for r in relations.spearman(relations.pairs(spark.createDataFrame(pdf), ["a", "b", "c"], ["k"]), ["k"]).collect()}
    some = pdf.dropna()
    assert got["a--b"]["n"] == len(some) and abs(got["a--b"]["strength"] - some["a"].rank().corr(some["b"].rank())) < 1e-12
    assert got["a--c"]["estimability"] == "constant_component" and got["a--c"]["strength"] is None
    assert abs(resample.spearman_of(some["a"].to_numpy(), some["b"].to_numpy()) - got["a--b"]["strength"]) < 1e-12


def test_resampling_repeats(spark):
    pdf = pd.DataFrame({"k": "w", "t": range(80), "b": [i // 20 for i in range(80)], "source": "a", "target": "b", "x": np.arange(80.0), "y": np.arange(80.0) + np.sin(np.arange(80.0)) * 9})
    rows = spark.createDataFrame(pdf)
    one, two = (resample.bootstrap(rows, ["k"], "t", reps=20, block=8).collect()[0] for _ in range(2))
    assert one == two and one["ci_low"] <= one["strength"] <= 1 and one["sign_support"] == 1
    null = {r["null_model"]: r["p_value"] for r in resample.nulls(rows, ["k"], "t", "b", reps=40).collect()}
    assert null["value_permutation"] == pytest.approx(1 / 41)


def test_communities():
    edges = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("d", "e", 1.0), ("e", "f", 1.0), ("d", "f", 1.0), ("c", "d", 0.1)]
    assert graph.greedy_modularity(edges) == [["a", "b", "c"], ["d", "e", "f"]] == graph.label_propagation(edges)


def test_sources(spark, tmp_path):
    (tmp_path / "feed.csv").write_text("#EventID,Time,Latitude,Longitude,Depth,MD\n1,2024-01-01T00:00:00,40,14,2,1.5\n2,bad,40,14,2,1\n3,2024-01-02 00:00:00,x,14,2,2\n")
    feed = catalog.read_feed(spark, str(tmp_path / "feed.csv")).orderBy("event_id").collect()
    assert [(r["event_id"], r["latitude"]) for r in feed] == [("1", 40.0), ("3", None)]
    (tmp_path / "fdsn.txt").write_text("#EventID|Time|Latitude|Longitude|Depth/Km|Magnitude\n7|2024-01-01T00:00:00|40.5|14.1|3|1.1\n")
    assert catalog.read_pipe_text(spark, str(tmp_path / "fdsn.txt")).first()["depth_km"] == 3.0
    (tmp_path / "fdsn.txt").write_text("#EventID|Time|Latitude|Longitude|Depth/Km|Magnitude\n7|2024-01-01T00:00:00|40.5\n")
    with pytest.raises(Exception, match="ragged"):
        catalog.read_pipe_text(spark, str(tmp_path / "fdsn.txt")).collect()
    feature = {"id": "u", "properties": {"mag": 2.5, "place": "p", "time": 1704067200000}, "geometry": {"coordinates": [14.0, 40.0, 1.0]}}
    (tmp_path / "g.json").write_text(json.dumps({"features": [feature]}))
    row = catalog.read_geojson(spark, str(tmp_path / "g.json")).first()
    assert (row["ts"], row["latitude"], row["magnitude"]) == (T0, 40.0, 2.5)
    assert [b for _, b in catalog.time_chunks(T0, T0 + timedelta(days=40))] == [T0 + timedelta(days=30), T0 + timedelta(days=40)]


def test_cleaning_counts(spark):
    rows = events(spark, [(0, 0, 0, 1), (1, 0, 0, 1), (2, 80, 0, 1)]).withColumn("event_id", F.when(F.col("event_id") == "1", "").otherwise(F.col("event_id")))
    good, counters = catalog.cleaned(rows.union(rows), F.lit(at(5)), (0.0, 0.0), 100.0)
    c = counters.first()
    assert good.count() == 1 and (c["rows"], c["empty_id"], c["outside_radius"], c["valid"], c["distinct_ids"]) == (6, 2, 2, 2, 1)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, 1 / 3, None, T0), (1, 2.0, "a,b", T0)], "k int, x double, s string, t timestamp")
    digest = sinks.write_csv(df, str(tmp_path / "o.csv"), ["k"])
    assert (tmp_path / "o.csv").read_text() == 'k,x,s,t\n1,2,"a,b",2024-01-01T00:00:00Z\n2,0.3333333333,,2024-01-01T00:00:00Z\n'
    assert catalog.verify_digest(str(tmp_path / "o.csv")) == digest
    assert sinks.compatible({"a": float("nan"), "d": date(2024, 1, 1)}) == {"a": None, "d": "2024-01-01"}
    assert 'source="a" target="b"' in sinks.graphml(spark.createDataFrame([("b", "a", 0.5)], "source string, target string, weight double"))


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.seed_of(F.lit("t")).alias("seed"), scalars.window_days(F.lit("30d")).alias("d"), scalars.window_days(F.lit("d")).alias("n"), scalars.pair_id(F.lit("b"), F.lit("a")).alias("p"),
        scalars.iso_utc(F.lit(T0).cast("timestamp")).alias("iso"), scalars.directional(F.lit(None).cast("double"), "upper").alias("null_side"), scalars.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("km"),
    ).first()
    assert row["seed"] == resample.seed_of("t") and (row["d"], row["n"], row["p"], row["iso"], row["null_side"]) == (30, None, "a--b", "2024-01-01T00:00:00Z", None)
    assert abs(row["km"] - 10007.557) < 0.01


def test_stream_episodes(spark, tmp_path):
    levels = "attention normal structural normal normal normal".split()
    spark.createDataFrame([("s", at(i), x) for i, x in enumerate(levels)], "stream string, endpoint timestamp, level string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream string, endpoint timestamp, level string").parquet(str(tmp_path / "in"))
    q = monitor.episodes(stream).writeStream.outputMode("append").format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["start"], r["end"], r["maximum_level"]) for r in spark.sql("SELECT * FROM closed").collect()] == [(at(0), at(2), "structural")]


def test_p_values_and_outcomes(spark):
    from stratafold.operators import audit

    assert audit.spearman_p(0.5, 20) == pytest.approx(0.024769, abs=1e-5) and audit.spearman_p(0.0, 9) == pytest.approx(1.0) and audit.spearman_p(None, 9) is None
    nulls = spark.createDataFrame([("a", 0.01, 0.3), ("a", 0.04, 0.2), ("b", 0.5, -0.1), ("c", None, None)], "k string, p_value double, effect double")
    assert {r["k"]: r["null_outcome"] for r in audit.null_outcome(nulls, ["k"]).collect()} == {"a": "exceeds_null", "b": "equivalent_to_null", "c": "not_admissible"}
