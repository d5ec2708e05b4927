"""Queries against their SQL on the driver's smallest tables."""

import inspect
import math
import os

import duckdb
import pytest

from stratafold.plans import event_queries, selection_queries  # noqa: F401
from stratafold.plans.event_queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
CHECKED = [
    "daily_activity", "daily_instability", "daily_alerts", "status_trend", "state_diff", "grid_phase", "radar_risk", "trailing_features", "robust_z", "window_alerts", "global_alerts", "alert_episodes",
    "event_clusters", "episode_association", "event_detection", "asof_next_event", "circular_shift_null", "spearman_pairs", "relation_status", "affine_flags", "bh_correction", "multiscale_pivot", "relational_transitions",
    "shift_null", "dropped_rows", "conditional_redundancy", "relation_membership", "representative_states", "topological_continuity",
]


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    return round(float(x), 5) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "lineitem", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    a = sorted((tuple(cell(r[c]) for c in columns) for r in got.collect()), key=str)
    b = sorted((tuple(cell(x) for x in r) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=str)
    assert len(a) == len(b) and a == b


def test_nothing_outside_needs_llm():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, names in os.walk(os.path.join(root, "stratafold")):
        if os.sep + "llm" in folder:
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(folder, n), encoding="utf-8") as f:
                    assert "llm" not in f.read(), n


def test_queries_have_the_reference_repetitions(monkeypatch):
    """Repetitions, block and history that each registered query hands on."""
    got = {}

    class Any:
        def __getattr__(self, name):
            return lambda *a, **k: self

    def spy(module, name):
        kind = inspect.signature(getattr(module, name))

        def call(*a, **k):
            bound = kind.bind(*a, **k)
            bound.apply_defaults()
            got[name] = {x: bound.arguments[x] for x in ("reps", "block", "rows", "least") if isinstance(bound.arguments.get(x), int)}
            return Any()

        monkeypatch.setattr(module, name, call)

    for name in ("pair_rows", "feature_table", "full_relations", "snapshots"):
        monkeypatch.setattr(event_queries, name, lambda *_: Any())
    for module, name in ((event_queries.resample, "bootstrap"), (event_queries.resample, "nulls"), (event_queries.resample, "correlation_distance"), (event_queries.graph, "families"), (event_queries.audit, "snapshot_nulls")):
        spy(module, name)
    for name in ("null_outcome", "continuity_outcome"):
        monkeypatch.setattr(event_queries.audit, name, lambda *_: None)
    monkeypatch.setattr(event_queries.relations, "transitions", lambda *_: None)
    want = {"bootstrap": {"reps": 500, "block": 24}, "nulls": {"reps": 300}, "correlation_distance": {"rows": 120, "least": 56}, "families": {"reps": 300}, "snapshot_nulls": {"reps": 1000}}
    for name, operator in (("bootstrap_ci", "bootstrap"), ("permutation_null", "nulls"), ("null_outcomes", "nulls"), ("crm_distance", "correlation_distance"), ("relation_families", "families"), ("continuity_nulls", "snapshot_nulls"), ("continuity_outcome", "snapshot_nulls")):
        got.clear()
        QUERIES[name](None, "")
        assert got == {operator: want[operator]}, name


#: Seconds of the events, and copies of each: gaps of zero, one endpoint, as many events in each day's window.
UNDEFINED = {
    "repeated": ([1800 * i + 7 * (i % 5) ** 3 for i in range(1, 200)], 3),
    "one endpoint": ([60, 200, 900], 1),
    "constant control": ([60, 200, 900, 4 * 21600 + 60, 4 * 21600 + 2000, 4 * 21600 + 9000], 1),
}


@pytest.mark.parametrize("name", UNDEFINED)
def test_partial_spearman_equals_sql_where_undefined(spark, tmp_path, name):
    """NaN is not NULL here: strings of the values are compared, not cells."""
    seconds, copies = UNDEFINED[name]
    con = duckdb.connect()
    rows = ", ".join(f"({k}, {s}, {s % 11 + 1 + s % 7})" for s in seconds for k in range(copies))
    con.sql(f"""COPY (SELECT row_number() OVER () AS event_id, TIMESTAMP '2024-01-01' + to_seconds(s) AS ts, s % 50 AS user_id, 'view' AS event_type, v::DOUBLE AS value, '{{"k": 7}}' AS props
      FROM (VALUES {rows}) r(k, s, v)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got, want = QUERIES["partial_spearman"](spark, str(tmp_path)), con.sql(ORACLE["partial_spearman"])
    a, b = (sorted(tuple(str(x) for x in r) for r in rows) for rows in (got.collect(), want.select(*got.columns).fetchall()))
    assert a == b and any("nan" in r for r in a)
