"""Requests through a session: progressive results, viewport changes, every clustering and bundling choice."""

import json
from datetime import datetime
from functools import partial

import pytest

from flowloom.config import EngineConfig
from flowloom.operators import bundling, edges, store
from flowloom.plans.session import EngineSession
from flowloom.sources import derived

FIRST, LAST = datetime(1995, 1, 1), datetime(2001, 8, 1)


@pytest.fixture(scope="module")
def session(spark, sf):
    return EngineSession(derived.flights(spark, sf), EngineConfig(fixed_days=1300), FIRST, LAST, fixed_interval=True)


def test_progressive_query(session, spark, sf):
    got = list(session.handle({"clustering": 0, "edgeStatus": 0}))
    assert [r.flag for r in got] == ["N", "Y"]
    whole = edges.counters(edges.weighted(derived.flights(spark, sf))).first()
    assert got[-1].counters["repliesCnt"] == whole["replies_cnt"] and got[-1].counters["pointsCnt"] == whole["points_cnt"]


def test_viewport_refresh_with_tree_cut_and_bundling(session):
    view = {"newQuery": False, "clustering": 1, "clusteringAlgorithm": 0, "zoom": 1, "treeCut": 1, "edgeStatus": 1, "lowerLongitude": -60, "upperLongitude": 60, "lowerLatitude": -40, "upperLatitude": 40, "radius": 80}
    (plain,) = session.handle(view)
    body = json.loads(session.to_json(plain))
    assert body["flag"] == "Y" and len(json.loads(body["edges"])) == 2 * body["edgesCnt"] and json.loads(body["points"])
    (bent,) = session.handle({"bundling": 1})
    assert bent.edges.count() > 0 and bent.counters["isolatedEdgesCnt"] <= bent.counters["edgesCnt"]
    assert list(session.handle("")) == []


@pytest.mark.parametrize("algorithm,answers", [(1, 2), (2, 1)])
def test_kmeans_queries(spark, sf, algorithm, answers):
    s = EngineSession(derived.flights(spark, sf), EngineConfig(fixed_days=1300, k=4), FIRST, LAST, fixed_interval=True)
    got = list(s.handle({"clustering": 1, "clusteringAlgorithm": algorithm}))
    assert len(got) == answers and got[-1].points.count() == 4 and got[-1].edges.count() > 0


def test_keyword_query(spark, sf):
    s = EngineSession(derived.replies(spark, sf), EngineConfig(fixed_days=400), datetime(2024, 1, 1), datetime(2024, 6, 1), fixed_interval=True)
    some = list(s.handle({"query": "question | answer", "edgeStatus": 0}))[-1].counters["repliesCnt"]
    everything = list(s.handle({"query": ""}))[-1].counters["repliesCnt"]
    assert 0 <= some <= everything and everything > 0


def test_components_above_the_block_are_bundled_whole(spark, monkeypatch):
    """Three far groups of three parallel edges each: in blocks of two or in one task, all edges bend, and in the same way."""
    monkeypatch.setattr(bundling, "fdeb", partial(bundling.fdeb, cycles=2, iterations=4))
    rows = [(10 * g + i, FIRST, 40.0 * g - 60, 0.2 * i, 40.0 * g - 40, 0.2 * i) for g in range(3) for i in range(3)] + [(99, FIRST, 0.0, -60.0, 0.5, -70.0)]
    source = spark.createDataFrame(rows, "id long, ts timestamp, from_lon double, from_lat double, to_lon double, to_lat double")
    drawn = []
    for block in (20000, 2):
        s = EngineSession(source, EngineConfig(fixed_days=3000, bundling_block=block), FIRST, LAST, fixed_interval=True)
        got = list(s.handle({"bundling": 1, "edgeStatus": 1}))[-1]
        assert (got.counters["edgesCnt"], got.counters["isolatedEdgesCnt"]) == (10, 1) and "unbundledEdgesCnt" not in got.counters
        assert got.edges.where("x1 = x2 - 20").isEmpty()
        drawn.append(sorted(tuple(round(r[c], 9) for c in ("x1", "y1", "x2", "y2")) for r in got.edges.collect()))
    assert drawn[0] == drawn[1] and len(drawn[0]) > 30


def test_compatibility_below_the_join_is_an_error(spark, sf):
    s = EngineSession(derived.flights(spark, sf), EngineConfig(fixed_days=3000, compatibility=0.4), FIRST, LAST, fixed_interval=True)
    with pytest.raises(ValueError):
        list(s.handle({"bundling": 1, "clustering": 1, "zoom": 0, "radius": 80}))


def test_incremental_bundling_above_the_bound(spark, sf):
    """Above incremental_above distinct edges, algorithm 1 folds slices into the tree; below it, it bundles at once."""
    ask = {"clustering": 1, "clusteringAlgorithm": 0, "zoom": 0, "radius": 80, "bundling": 1, "bundlingAlgorithm": 1, "pointStatus": 0}
    s = EngineSession(derived.flights(spark, sf), EngineConfig(fixed_days=1300, incremental_above=10), FIRST, LAST, fixed_interval=True)
    got = list(s.handle(ask))
    assert len(got) == 2 and got[-1].edges.count() > got[-1].counters["edgesCnt"] > 0
    shown = s.drawn_edges()
    assert s.bundler.leaves.count() >= shown.count() == s.bundler.paths(shown).count()
    assert s.bundler.tree.total() == s.bundler.leaves.agg({"weight": "sum"}).first()[0]
    kept = s.bundler
    list(s.handle({"newQuery": False, "lowerLongitude": -100}))
    assert s.bundler is kept
    list(s.handle({"zoom": 1, "lowerLongitude": -20, "upperLongitude": 20}))
    assert s.bundler is not kept
    s = EngineSession(derived.flights(spark, sf), EngineConfig(fixed_days=1300, incremental_above=10**9), FIRST, LAST, fixed_interval=True)
    list(s.handle(ask))
    assert s.bundler is None


def test_hierarchy_over_pairs(spark):
    """Two groups of edges and a far one: clusters of the pair hierarchy, edges between them, an off-screen end raised to its ancestor."""
    rows = [(i, FIRST, -60 + 0.1 * i, 0.2 * i, 40 + 0.1 * i, 10.0) for i in range(6)] + [(20 + i, FIRST, -61.0, 2.0 * i, 150.0, 60.0 - i) for i in range(3)]
    source = spark.createDataFrame(rows, "id long, ts timestamp, from_lon double, from_lat double, to_lon double, to_lat double")
    s = EngineSession(source, EngineConfig(fixed_days=3000, hierarchy="pairs", max_zoom=4), FIRST, LAST, fixed_interval=True)
    got = list(s.handle({"clustering": 1, "zoom": 3, "radius": 40, "treeCut": 0}))[-1]
    places, found, members = s.hierarchy()
    assert got.points.agg({"size": "sum"}).first()[0] == found.where("zoom = 3").agg({"num_points": "sum"}).first()[0] == 18
    assert s.drawn_edges().agg({"weight": "sum"}).first()[0] == 9 and s.hierarchy()[1] is found
    few = s.drawn_edges().count()
    assert 2 <= few < 9
    cut = {"newQuery": False, "treeCut": 1, "lowerLongitude": -90, "upperLongitude": 90, "lowerLatitude": -40, "upperLatitude": 40}
    (view,) = s.handle(cut)
    drawn = s.drawn_edges().collect()
    assert sum(r["weight"] for r in drawn) == 9 and view.counters["edgesCnt"] == len(drawn)
    far = [r for r in drawn if max(r["from_lon"], r["to_lon"]) > 90]
    plain = {(round(r["lon"], 6), round(r["lat"], 6)) for r in got.points.collect()}
    assert far and s.drawn_edges().columns[0] == "id"
    assert all((round(r["from_lon"], 6), round(r["from_lat"], 6)) in plain for r in far)


def test_settings_are_read_for_each_new_query(spark, tmp_path):
    rows = [(1, datetime(2016, 5, 1), 0.0, 0.0, 5.0, 5.0), (2, datetime(2018, 5, 1), 9.0, 0.0, 5.0, 5.0)]
    source = spark.createDataFrame(rows, "id long, ts timestamp, from_lon double, from_lat double, to_lon double, to_lat double")
    path = tmp_path / "engine.properties"
    path.write_text("# dates\nfirstDate=20160101000000\nlastDate = 20170101000000\nfixedInterval=400\nunknown=1\n!k=3\n")
    s = EngineSession(source, properties=str(path), fixed_interval=True)
    assert list(s.handle({"edgeStatus": 0}))[-1].counters["repliesCnt"] == 1
    path.write_text("firstDate=20160101000000\nlastDate=20190101000000\nk=5\nhierarchy=pairs\n")
    list(s.handle({"newQuery": False}))
    assert s.config.last_date == datetime(2017, 1, 1) and s.config.fixed_days == 400
    got = list(s.handle({"newQuery": True}))
    assert len(got) == 3 and got[-1].counters["repliesCnt"] == 2 and (s.config.k, s.config.hierarchy, s.config.fixed_days) == (5, "pairs", 400)
    path.unlink()
    assert list(s.handle({"newQuery": True}))[-1].counters["repliesCnt"] == 2


def test_a_closed_session_leaves_no_tables(spark, tmp_path, monkeypatch):
    """Steps of an operator go when it is done, the rest when the session ends; tables of others stay."""
    monkeypatch.setattr(store, "shared_dir", lambda spark: str(tmp_path))
    rows = [(i, FIRST, -60 + 0.1 * i, 0.2 * i, 40 + 0.1 * i, 10.0) for i in range(6)]
    source = store.settle(spark.createDataFrame(rows, "id long, ts timestamp, from_lon double, from_lat double, to_lon double, to_lat double"))
    s = EngineSession(source, EngineConfig(fixed_days=3000, hierarchy="pairs", max_zoom=1), FIRST, LAST, fixed_interval=True)
    got = list(s.handle({"clustering": 1, "zoom": 1, "bundling": 0}))[-1]
    assert got.edges.count() >= 0 and 1 < len(list(tmp_path.iterdir())) < 40
    s.close()
    assert len(list(tmp_path.iterdir())) == 1 and source.count() == 6
    from flowloom.operators.graph import components

    links = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "a long, b long")
    found = components(links)
    assert len(list(tmp_path.iterdir())) == 2 and {tuple(r) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
