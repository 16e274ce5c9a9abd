"""Spark operators of the library: fits, streams, files, neighbours, sequences."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairn.config import EngineConfig
from kairn.functions import analysis as A
from kairn.functions import generators as G
from kairn.functions import ordered
from kairn.operators.cluster import cluster, fit
from kairn.operators.knn import Search, knn, knn_brute
from kairn.operators.leader import assign, leader_anchors
from kairn.operators.tiles import History, JointStepper, fit_tiles, tuples
from kairn.plans import queries as Q
from kairn.sources import files, sinks
from kairn.streaming.fit import STORE, fit_stream, missed_frames

D = "/root/testdata/sf0.001"


def points(spark, n=300, seed=1):
    x = np.random.default_rng(seed).uniform(-1, 1, (n, 2))
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "frame_id long, data array<double>")


@pytest.mark.parametrize("block", [7, 100, 10_000])
def test_leader_blocks(spark, block):
    f = points(spark)
    got = [(r.cluster_id, r.anchor_id) for r in leader_anchors(f, 0.25, block).collect()]
    want = fit(f, EngineConfig(rlim=0.25)).where("is_new").select("cluster_id", "frame_id").orderBy("frame_id").collect()
    assert got == [tuple(r) for r in want]
    assert leader_anchors(f.limit(0), 0.25).count() == 0
    with pytest.raises(ValueError):
        leader_anchors(f, 0.01, max_anchors=5)


def test_lag_and_running_sum_over_spans(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SPAN", 7)
    df = spark.createDataFrame([(i, i * i) for i in range(0, 200, 3)], "frame_id long, v long")
    rows = ordered.lagged(df, {"v": "b"}).orderBy("frame_id").collect()
    assert [r.b for r in rows] == [None, *[r.v for r in rows[:-1]]]
    total = ordered.running_sum(df, F.col("v"), "s").orderBy("frame_id").collect()
    assert [r.s for r in total] == np.cumsum([r.v for r in total]).tolist()


@pytest.mark.parametrize("search", [Search(k=4), Search(k=3, dtmin=5, past=True), Search(k=3, rlim=0.1), Search(k=2, future=True)])
def test_knn(spark, search):
    f = points(spark)
    anchors = leader_anchors(f, 0.3)
    got = knn(f, assign(f, anchors), anchors, search)
    assert got.exceptAll(knn_brute(f, search)).count() == 0 and got.count() == knn_brute(f, search).count()


def test_knn_eps(spark):
    f = points(spark)
    anchors = leader_anchors(f, 0.3)
    best = {(r.query_id, r.rank): r.dist for r in knn_brute(f, Search(k=3)).collect()}
    got = knn(f, assign(f, anchors), anchors, Search(k=3, eps=0.5)).collect()
    assert len(got) == len(best) and all(r.dist <= 1.5 * best[r.query_id, r.rank] + 1e-12 for r in got)


def test_model_and_sinks(spark, tmp_path):
    m = cluster(points(spark), EngineConfig(rlim=0.3, trace=True))
    sinks.write_run(m, str(tmp_path / "run"), clusters=True, averages=True, all_distances=True, clustered=True)
    k = m.anchors().count()
    assert spark.read.parquet(str(tmp_path / "run/dcc")).count() == k * k
    assert spark.read.parquet(str(tmp_path / "run/cluster_counts")).agg(F.sum("n")).first()[0] == 300
    assert spark.read.parquet(str(tmp_path / "run/clusters")).count() == 300
    assert m.dcc().where("dist < 0.3").count() == 0
    sinks.write_text(m.membership, str(tmp_path / "m"), "frame_id", ["frame_id", "cluster_id", "dist"])
    assert files.read_membership(spark, str(tmp_path / "m")).count() == 300
    assert sinks.clustered_lines(m).count() == 301 + k
    assert '"evenness"' in sinks.analysis_json(m).first()[0]
    assert m.telemetry().first().clusters_made == k


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    config = EngineConfig(rlim=0.3, te4=True, tm=0.3)
    rows = points(spark, 200).withColumn("stream", (F.col("frame_id") % 2).cast("string")).cache()
    want = {(r.stream, r.frame_id): r.uid for r in fit(rows, config, ["stream"]).collect()}
    for k, (a, b) in enumerate([(0, 30), (30, 31), (31, 200)]):
        rows.where((F.col("frame_id") >= a) & (F.col("frame_id") < b)).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = fit_stream(source, config, "stream").writeStream.format("memory").queryName("online").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("online").where("NOT late").collect()
    assert {(r.stream, r.frame_id): r.cluster_id for r in got} == want
    assert missed_frames(spark.table("online"), "stream").count() == 198


def test_tiles_by_group(spark):
    f = points(spark, 150)
    for options in ({}, {"pass2": True}, {"xtile": 2}):
        member = fit_tiles(f, EngineConfig(rlim=0.4, **options), {0: [0], 1: [1]})
        assert A.unique_tuples(tuples(member)).agg(F.sum("n")).first()[0] == 150


def test_files(spark, tmp_path):
    (tmp_path / "v.txt").write_text("# head\n1 2.5\n\n3  4\n5 6\n")
    got = files.read_frames(spark, str(tmp_path / "v.txt")).orderBy("frame_id").collect()
    assert [(r.frame_id, r.data) for r in got] == [(0, [1, 2.5]), (1, [3, 4]), (2, [5, 6])]
    cube = np.random.default_rng(0).uniform(0, 255, (3, 4, 5))
    (tmp_path / "c.fits").write_bytes(files.encode_fits(cube))
    got = files.read_frames(spark, str(tmp_path / "c.fits")).orderBy("frame_id").collect()
    assert np.allclose([r.data for r in got], cube.reshape(3, -1)) and got[0].width == 5
    for k in range(3):
        (tmp_path / f"{k}.png").write_bytes(files.encode_png(cube[k]))
    (tmp_path / "list").write_text("\n".join(str(tmp_path / f"{k}.png") for k in (2, 0, 1)))
    got = files.read_png_list(spark, str(tmp_path / "list")).orderBy("frame_id").collect()
    assert np.allclose([r.data for r in got], np.round(cube[[2, 0, 1]]).reshape(3, -1))
    with pytest.raises(NotImplementedError):
        files.read_frames(spark, "x.mp4")


def test_generators(spark):
    for f, dims in ((G.spiral(spark, 50, dims=3), 3), (G.random_ball(spark, 50, 3, 1), 3), (G.random_gauss(spark, 50, 1), 3), (G.sphere(spark, 50, 1), 3), (G.star(spark, 50), 3), (G.concentric(spark, 50), 3),
                    (G.tree(spark, 200), 5), (G.lissajous(spark, 50), 2), (G.torus(spark, 50), 3), (G.lorenz(spark, 50), 3), (G.fibonacci_sphere(spark, 50), 3), (G.earth(spark, 5, 8), 64), (G.bouncing_balls(spark, 20, 16), 256)):
        rows = f.collect()
        assert all(len(r.data) == dims for r in rows)
    x = G.shuffled(G.circle(spark, 100), 3)
    assert sorted(r.frame_id for r in x.collect()) == list(range(100))
    assert G.prototype_images(spark, 20).count() == 20
    assert sinks.render_spot(np.array([0.0, 0.0]), 16, 0.1).shape == (16, 16)


@pytest.mark.parametrize("name", ["gen_walk", "tune_radius", "embedding_from_distances", "stepper_by_stream", "tile_joint", "tile_leader", "probe_histogram", "failed_probes", "run_telemetry", "stepper_discard"])
def test_queries_run(spark, name):
    assert Q.QUERIES[name](spark, D).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_embedding_has_all_anchors(spark):
    assert Q.QUERIES["embedding_from_distances"](spark, "/root/testdata/sf0.01").count() == 163


def test_tune_takes_the_whole_table(spark):
    frames = Q.frames(spark, "/root/testdata/sf0.01")
    median = Q.A.scan_statistics(frames).first()["d_median"]
    got = {r.tiles: r.rlim for r in Q.QUERIES["tune_radius"](spark, "/root/testdata/sf0.01").collect()}
    assert got["1x1"] == pytest.approx(1.5 * median)


@pytest.mark.parametrize("name", ["stepper_default", "stepper_merge", "probe_histogram", "tile_leader"])
def test_no_limit_on_frame_ids(spark, monkeypatch, name):
    near = Q.frames
    want = Q.QUERIES[name](spark, D).count()
    monkeypatch.setattr(Q, "frames", lambda s, d: near(s, d).withColumn("frame_id", F.col("frame_id") + 200_000))
    assert Q.QUERIES[name](spark, D).count() == want > 0


def test_tuple_scores_are_products_of_exact_matches():
    joint = JointStepper(EngineConfig(rlim=0.5, xtile=2), {0: [0], 1: [1]})
    for x in ([0.0, 0.0], [10.0, 10.0]):
        joint.step(np.array(x))
    joint.window.clear()
    joint.window.extend([(0, 0), (1, 1), (1, 0), (0, 0)])
    assert joint._scores(1, {0: 1}) == pytest.approx([0.01 / 1.02, 1.01 / 1.02])
    joint.window.extend([(1, 0), (1, 1)])
    assert joint._scores(1, {0: 0}) == pytest.approx([1.01 / 1.02, 0.01 / 1.02])
    joint.window.append((0, 1))
    assert joint._scores(0, {1: 7}) is None


def test_joint_history():
    """The index and the ring give what a plain list gives."""
    rng, h, rows = np.random.default_rng(2), History(3, 50), []
    for n in range(400):
        row = tuple(int(v) for v in rng.integers(0, 4, 3))
        h.append(row), rows.append(row)
        low = max(0, n + 1 - 50)
        assert h.low <= low and len(h) == n + 1
        assert [tuple(r) for r in h.at(np.arange(low, n + 1)).tolist()] == rows[low:]
        m, u = n % 3, n % 4
        assert h.places(m, u, low) == [i for i in range(low, n + 1) if rows[i][m] == u]


def test_joint_prediction_weighs_near_stretches():
    """A stretch one cluster off weighs by anchor distances; what followed it is the likeliest next state."""
    c = EngineConfig(rlim=0.5, pred=(2, 100, 2))
    joint = JointStepper(c, {0: [0], 1: [1]})
    for x in ([0.0, 0.0], [0.6, 0.6], [5.0, 5.0], [9.0, 9.0]):
        joint.step(np.array(x))
    joint.window.clear()
    past = [(0, 0), (1, 0), (2, 2), (3, 3), (3, 3), (0, 0), (0, 0)]
    joint.window.extend(past)
    got = joint._predicted()
    high = [s.high for s in joint.steppers.values()]
    total = np.zeros((2, 4))
    for s in range(2, len(past) - 2):
        if high[0][past[-1][0], past[s - 1][0]] > 1.0:
            continue
        e = sum(0.5 ** (1 - j) * sum(high[m][past[-2 + j][m], past[s - 2 + j][m]] / 0.5 for m in range(2)) for j in range(2))
        for m in range(2):
            total[m, past[s][m]] += np.exp(-e / (2 * (1 - np.exp(-1)))) * (e <= 10)
    for m in range(2):
        assert np.allclose(got[m][0], (total[m] + 0.01) / (total[m] + 0.01).sum()) and got[m][1][0] == 2


def test_joint_prediction_of_a_cycle():
    """Two tiles that go round together: once the cycle is known, the first probe is right."""
    t = np.arange(400) % 8
    x = np.c_[np.cos(t), np.sin(t), np.cos(3 * t), np.sin(3 * t)]
    plain, known = (JointStepper(EngineConfig(rlim=0.05, **o), {0: [0, 1], 1: [2, 3]}) for o in ({}, {"pred": (2, 200, 1)}))
    probes = [[sum(len(o.evals) for o in j.step(r).values()) for r in x] for j in (plain, known)]
    assert sum(probes[1][100:]) == 2 * 300 < sum(probes[0][100:])


def test_brute_force_in_blocks(spark, monkeypatch):
    """Cells, copies, null vectors and the rules of a search, against loops."""
    import kairn.operators.knn as N

    monkeypatch.setattr(N, "BLOCK", 7)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3)).round(1)
    x[10:30:2] = x[0]
    f = spark.createDataFrame([(i, None if i % 13 == 5 else v.tolist()) for i, v in enumerate(x)], "frame_id long, data array<double>")
    for search in (Search(k=3), Search(k=4, dtmin=7, past=True), Search(k=6, rlim=0.9), Search(k=2, future=True)):
        want = set()
        for q in range(60):
            near = []
            for c in range(60):
                d = 0.0
                for a, b in zip(x[q].tolist(), x[c].tolist(), strict=True):
                    d += (a - b) * (a - b)
                d = math.sqrt(d)
                timely = c != q and abs(c - q) >= search.dtmin and (not search.past or c <= q) and (not search.future or c >= q)
                if timely and q % 13 != 5 and c % 13 != 5 and (search.rlim <= 0 or d <= search.rlim):
                    near.append((d, c))
            want |= {(q, rank, c, d) for rank, (d, c) in enumerate(sorted(near)[: search.k], 1)}
        assert {tuple(r) for r in knn_brute(f, search).collect()} == want


def test_brute_force_needs_one_length(spark):
    f = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (2, [3.0])], "frame_id long, data array<double>")
    with pytest.raises(Exception, match="one length"):
        knn_brute(f, Search(k=1)).collect()
