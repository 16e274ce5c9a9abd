"""The session and the functions of the api."""

import numpy as np
from pyspark.sql import functions as F

from kairn import api
from kairn.sources.files import encode_fits


def frames(spark, n=120):
    x = np.random.default_rng(4).uniform(-1, 1, (n, 4))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "frame_id long, data array<double>")


def test_session():
    s = api.Session(api.EngineConfig(rlim=0.5))
    assert s.process_batch([(0, 0), (0.1, 0), (3, 3), (3, 3.1), (0, 0.1)]) == [0, 0, 1, 1, 0]
    assert s.num_clusters() == 2 and s.capacity() >= 2 and s.anchors().tolist() == [[0, 0], [3, 3]]
    assert abs(s.dcc()[0, 1] - 18**0.5) < 1e-12 and s.transition_matrix().tolist() == [[1, 1], [1, 1]]
    assert s.telemetry()["same_as_last"] == 2 and s.evaluations()[-1][0] == 0 and len(s.probabilities()) == 2
    s.reset()
    assert s.num_clusters() == 0
    t = api.Session(api.EngineConfig(rlim=0.5), {0: [0], 1: [1]})
    assert t.process_batch([(0, 0), (3, 0), (0, 3)]) == [(0, 0), (1, 0), (0, 1)]


def test_runs(spark, tmp_path):
    x, f = frames(spark)
    member = api.run(f, api.EngineConfig(rlim=0.6, tiles="2x1"), width=2)
    assert member.count() == 240
    joint = api.joint_metrics(member).first()
    d = {(r.frame_id, r.tile_id): r.dist for r in member.collect()}
    assert abs(joint.max_dist - max(np.hypot(d[i, 0], d[i, 1]) for i in range(120))) < 1e-9
    model = api.cluster(f, api.EngineConfig(rlim=0.6))
    tables = api.analyze(model)
    assert all(t.count() > 0 for t in tables.values())
    assert tables["lifetimes"].agg(F.sum("size")).first()[0] == 120
    (tmp_path / "map.fits").write_bytes(encode_fits(np.array([[[0.0, 1], [1, 0]]])))
    assert api.read_tile_map(str(tmp_path / "map.fits"), 2, 2) == {0: [0, 3], 1: [1, 2]}
    (tmp_path / "tiles").write_text("# tile rlim maxcl\n1 0.2 5\n")
    assert api.read_tile_config(str(tmp_path / "tiles"), api.EngineConfig(rlim=1.0))[1].maxcl == 5
    assert api.scandist(f)[1].first().n == 119
