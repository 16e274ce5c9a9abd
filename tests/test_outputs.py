"""Percentiles, seeded data, and what a run leaves: logs, distances, images, JSON."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairn.config import EngineConfig
from kairn.functions import analysis as A
from kairn.functions import generators as G
from kairn.operators.cluster import cluster
from kairn.operators.knn import Search, knn, knn_telemetry, padded
from kairn.sources import files, sinks


@pytest.fixture(scope="module")
def model(spark):
    return cluster(G.spiral(spark, 300), EngineConfig(rlim=0.3))


@pytest.mark.parametrize("most", [10, 10**6])
def test_percentiles_are_exact(spark, monkeypatch, most):
    monkeypatch.setattr(A, "EXACT_ROWS", most)
    monkeypatch.setattr(A, "BINS", 7)
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=400), np.repeat([1.0, 2.0, 5.0], 60), rng.integers(0, 5, 200).astype(float), np.array([4.0]), np.append(rng.normal(size=300), 1e12)):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
        at = [0.0, 0.01, 0.2, 0.5, 0.8, 0.99, 1.0]
        assert np.allclose(A.percentiles(df, "v", at), np.quantile(x, at), rtol=1e-12)
    assert A.percentiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


def test_a_seed_fixes_the_data(spark):
    for make in (lambda: G.random_ball(spark, 500, 2, 1), lambda: G.random_ball(spark, 500, 5, 1), lambda: G.random_gauss(spark, 200, 2), lambda: G.sphere(spark, 300, 3), lambda: G.prototype_images(spark, 50, 4)):
        rows = []
        for parts in ("1", "7"):
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", parts)
            rows.append(sorted((r.frame_id, tuple(r.data)) for r in make().collect()))
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        assert rows[0] == rows[1]
    ball = np.array([r.data for r in G.random_ball(spark, 4000, 3, 1).collect()])
    assert (np.linalg.norm(ball, axis=1) <= 1).all() and np.abs(ball.mean(axis=0)).max() < 0.05
    cloud = np.array([r.data for r in G.random_gauss(spark, 3000, 5).collect()])
    assert np.abs(cloud.mean(axis=0)).max() < 0.05 and 0.25 < cloud.std() < 0.33


def test_run_log(spark, model, tmp_path):
    lines = sinks.run_log_lines(model)
    path = tmp_path / "run.log"
    path.write_text("\n".join(lines))
    frames = {r.row[0]: r.row[1] for r in files.read_log_histogram(spark, str(path), "DIST_HIST").collect()}
    assert frames == {r.n_evals: r.frames for r in A.probe_statistics(model.membership, 0.3)[0].collect()} and sum(frames.values()) == 300
    failed = {r.row[0]: r.row[1] for r in files.read_log_histogram(spark, str(path), "CLUSTER_QUERIES").collect()}
    assert failed == {r.cluster_id: r.failed for r in A.probe_statistics(model.membership, 0.3)[1].collect()}
    assert {r.key: r.value for r in files.read_run_log(spark, str(path)).collect()}["STATS_FRAMES"] == "300"
    depth = {r.depth: (r.probes, r.pruned_fraction) for r in A.pruned_by_depth(model.membership).collect()}
    assert depth[0] == (299, 0.0) and all(0 < depth[d][1] < 1 for d in depth if d)


def test_all_distances(model):
    rows = model.all_distances().collect()
    t, k = model.telemetry().first(), model.counts().count()
    assert sum(r.cluster_id >= 0 for r in rows) == t.sample_distances
    new = {r.frame_id for r in model.membership.where("is_new").collect()}
    assert sum(r.frame_id in new for r in rows) == k * (k - 1) // 2
    data = {r.frame_id: np.array(r.data) for r in model.frames.collect()}
    for r in rows:
        assert abs(np.linalg.norm(data[r.frame_id] - data[r.other_id]) - r.dist) < 1e-9 and abs(r.ratio - r.dist / 0.3) < 1e-9
        assert (0 < r.prob <= 1) == (r.cluster_id >= 0)


def test_images(spark, tmp_path):
    images = spark.createDataFrame([(k, [float((k * 7 + i) % 256) for i in range(12)]) for k in range(3)], "cluster_id long, anchor array<double>")
    for kind, decode in (("png", files.decode_png), ("fits", files.decode_fits)):
        sinks.write_anchor_images(images, str(tmp_path / kind), 4, 3, kind)
        for r in images.collect():
            x = decode((tmp_path / kind / f"anchor_{r.cluster_id:05d}.{kind}").read_bytes())
            assert np.array_equal(x.reshape(-1), r.anchor)
    listed = tmp_path / "list"
    listed.write_text("".join(f"{tmp_path}/png/anchor_{k:05d}.png # image\n" for k in (2, 0)))
    got = {r.frame_id: r.data[0] for r in files.read_png_list(spark, str(listed)).collect()}
    assert got == {0: 14.0, 1: 0.0}
    assert {r.frame_id: r.data[0] for r in files.read_png(spark, f"{tmp_path}/png").collect()} == {0: 0.0, 1: 7.0, 2: 14.0}


def test_knn_fits(spark, model):
    wide = padded(knn(model.frames, model.membership, model.anchors(), Search(k=3)), model.frames, 3)
    cubes = [files.decode_fits(bytes(r.content)) for r in sinks.knn_fits(wide).orderBy("name").collect()]
    near, dist = np.concatenate([c[0] for c in cubes]), np.concatenate([c[1] for c in cubes])
    rows = wide.orderBy("query_id").collect()
    assert near.tolist() == [r.neighbors for r in rows] and np.array_equal(dist, np.array([r.dists for r in rows]))


def test_analysis_json(model):
    one = json.loads(sinks.analysis_json(model).first().json)
    assert one["params"]["rlim"] == 0.3 and one["stats"]["frames"] == 300 and len(one["clusters"]) == model.counts().count()
    assert sum(c["size"] for c in one["clusters"]) == 300 and one["topology"]["min_dist"] >= 0.3 and one["top_transitions"][0]["n"] >= 1
    assert {"p_stay", "mean_dist", "birth_frame"} <= set(one["clusters"][0])


def test_streams_in_one_task(spark):
    """Streams that share a task don't share state, and a long one passes in parts."""
    from kairn.operators import cluster as C

    rows = [(k, i, [float((i * (k + 1)) % 17), float(k)]) for k in range(5) for i in range(120)]
    frames = spark.createDataFrame(rows, "who int, frame_id long, data array<double>").coalesce(1)
    by_part = C.STEPS
    try:
        C.STEPS = 7
        both = {(r.who, r.frame_id): (r.cluster_id, r.dist) for r in C.fit(frames, EngineConfig(rlim=2.0), ["who"]).collect()}
    finally:
        C.STEPS = by_part
    assert len(both) == 600
    for k in range(5):
        own = frames.where(F.col("who") == k).drop("who")
        assert {r.frame_id: (r.cluster_id, r.dist) for r in C.fit(own, EngineConfig(rlim=2.0)).collect()} == {i: v for (w, i), v in both.items() if w == k}


def test_streams_of_other_lengths(spark):
    from kairn.operators.cluster import fit

    rows = [(k, i, [float(i % 3)] * (k + 1)) for k in range(3) for i in range(30)]
    got = fit(spark.createDataFrame(rows, "who int, frame_id long, data array<double>").coalesce(1), EngineConfig(rlim=0.5), ["who"]).collect()
    assert len(got) == 90 and all(r.cluster_id == r.frame_id % 3 for r in got)


def test_sparse_orders(spark, monkeypatch):
    """Sparse, negative and dense order values give the same previous rows, in few spans."""
    from kairn.functions import ordered as O

    monkeypatch.setattr(O, "SPAN", 10)
    rng = np.random.default_rng(5)
    for values in (np.arange(200), np.sort(rng.choice(10**12, 200, replace=False)) - 10**11, np.array([5])):
        df = spark.createDataFrame([(int(v), i) for i, v in enumerate(values)], "frame_id long, n int")
        assert len(values) / 10 - 1 <= (int(values[-1]) - int(values[0])) // O.span_width(df, "frame_id") + 1 <= len(values) / 10 + 2
        assert [r.p for r in O.lagged(df, {"n": "p"}).orderBy("frame_id").collect()] == [None, *range(len(values) - 1)]
        assert [r.s for r in O.running_sum(df, F.col("n"), "s").orderBy("frame_id").collect()] == np.cumsum(np.arange(len(values))).tolist()
    assert O.lagged(df.limit(0), {"n": "p"}).count() == 0


@pytest.mark.parametrize("search", [Search(k=2), Search(k=2, dtmin=5, past=True), Search(k=3, rlim=0.1)])
def test_knn_counters(model, search):
    t = knn_telemetry(model.frames, model.membership, model.anchors(), search).first()
    k = model.counts().count()
    assert t.queries == 300 and t.visits + t.clusters_pruned == 300 * k and 0 < t.visits
    assert t.pairs == t.temporal_pruned + t.annular_pruned + t.distances and t.distances >= knn(model.frames, model.membership, model.anchors(), search).count()
    assert t.distances < 300 * 299 and t.temporal_pruned >= 300 * (search.dtmin == 0)
