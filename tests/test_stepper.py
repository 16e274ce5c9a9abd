"""The state machine: golden cases, anchors in every mode, bounds, capacity, streams, tiles."""

import numpy as np
import pytest

from kairn.config import EngineConfig
from kairn.functions import metric as M
from kairn.operators.stepper import FrameStepper, Stopped
from kairn.operators.tiles import JointStepper, axis_tiles, grid_tiles, map_tiles
from kairn.plans.queries import _MODES


def leader(points, r):
    anchors = []
    for i, x in enumerate(points):
        if not any(np.linalg.norm(x - points[a]) < r for a in anchors):
            anchors.append(i)
    return anchors


def run(points, **options):
    s, out = FrameStepper(EngineConfig(**options)), []
    for x in points:
        try:
            out.append(s.step(x))
        except Stopped:
            break
    return s, out


def test_two_groups():
    pts = np.array([(0, 0), (0.1, 0), (0, 0.1), (10, 10), (10.1, 10), (10, 10.1)])
    assert [o.cluster for o in run(pts, rlim=0.5, maxcl=5)[1]] == [0, 0, 0, 1, 1, 1]


def test_probe_lists():
    _, out = run(np.array([(0, 0), (0.5, 0.5), (0.52, 0.51)]), rlim=0.3)
    assert out[0].new and out[1].new and not out[2].new
    assert out[1].evals[0][0] == 0 and abs(out[1].evals[0][1] - 0.7071) < 1e-4
    assert out[2].evals[-1][0] == 1 and abs(out[2].evals[-1][1] - 0.0224) < 1e-4


def test_growth():
    pts = np.array([((i % 20) * 0.1, (i // 20) * 0.1) for i in range(200)])
    assert run(pts, rlim=0.01)[0].k == 200


@pytest.mark.parametrize("mode", list(_MODES))
def test_anchors_do_not_depend_on_the_mode(mode):
    rng = np.random.default_rng(3)
    t = np.arange(400)
    pts = np.c_[np.cos(t / 7), np.sin(t / 7)] * (1 + t[:, None] / 400) + rng.normal(0, 0.02, (400, 2))
    want = leader(pts, 0.3)
    s, out = run(pts, rlim=0.3, **_MODES[mode])
    assert [i for i, o in enumerate(out) if o.new] == want
    for i, o in enumerate(out):
        assert o.new or (o.dist < 0.3 and abs(np.linalg.norm(pts[i] - pts[want[o.cluster]]) - o.dist) < 1e-12)
    low, high = s.low[: s.k, : s.k], s.high[: s.k, : s.k]
    true = M.distances(pts[want], pts[want])
    assert (low <= true + 1e-9).all() and (true <= high + 1e-9).all()


def test_bounds_are_sound():
    rng = np.random.default_rng(5)
    for _ in range(500):
        p = rng.normal(size=(5, 6))
        d = M.distances(p, p)
        assert M.bound_4pt_np(d[0, 1], d[0, 2], d[1, 2], d[0, 3], d[1, 3]) <= d[2, 3] + 1e-9
        assert M.bound_5pt_np(d[0, 1], d[0, 2], d[1, 2], d[0, 3], d[1, 3], d[2, 3], d[0, 4], d[1, 4], d[2, 4]) <= d[3, 4] + 1e-9


@pytest.mark.parametrize("strategy", ["stop", "discard", "merge"])
def test_capacity(strategy):
    pts = np.random.default_rng(1).uniform(-1, 1, (300, 2))
    s, out = run(pts, rlim=0.2, maxcl=10, maxcl_strategy=strategy)
    assert s.k == 10
    final = [s.final(o.cluster) for o in out]
    if strategy == "stop":
        assert len(out) < 300 and min(final) >= 0
    else:
        assert len(out) == 300 and max(final) == 9
        assert (min(final) >= 0) == (strategy == "merge")


def test_prediction_of_a_recurring_circle():
    t = np.arange(600) % 10
    pts = np.c_[np.cos(2 * np.pi * t / 10), np.sin(2 * np.pi * t / 10)]
    plain = sum(len(o.evals) for o in run(pts, rlim=0.1)[1][100:])
    known = sum(len(o.evals) for o in run(pts, rlim=0.1, pred=(5, 100, 1))[1][100:])
    assert known == 500 < plain


def test_tiles():
    assert grid_tiles(5, 4, "2x2")[3] == [12, 13, 14, 17, 18, 19] and len(grid_tiles(6, 6, "5")) == 9
    assert axis_tiles(3) == {0: [0], 1: [1], 2: [2]} and map_tiles([0, 2, 0]) == {0: [0, 2], 1: [], 2: [1]}
    pts = np.random.default_rng(2).uniform(-1, 1, (200, 4))
    for options in ({}, {"pass2": True}, {"xtile": 1, "xtile_decay": 0.9}, {"xtile": 2}, {"pred": (2, 100, 2)}):
        j = JointStepper(EngineConfig(rlim=0.5, **options), {0: [0, 1], 1: [2, 3]})
        rows = [j.step(x) for x in pts]
        for t, own in ((0, pts[:, :2]), (1, pts[:, 2:])):
            assert [i for i, r in enumerate(rows) if r[t].new] == leader(own, 0.5)
            assert all(r[t].dist <= 0.5 for r in rows)


def test_config(tmp_path):
    c = EngineConfig.parse("-rlim 0.3 -te4 -pred[5,100,1] -maxcl 50 -maxcl_strategy merge -tiles 2x2 -xtile".split())
    assert (c.rlim, c.te4, c.pred, c.maxcl, c.maxcl_strategy, c.tiles, c.xtile) == (0.3, True, (5, 100, 1), 50, "merge", "2x2", 2)
    c.to_file(str(tmp_path / "c"))
    assert EngineConfig.from_file(str(tmp_path / "c")) == c
    assert EngineConfig.parse(["a1.5"]).auto_factor == 1.5
    for bad in (["-nonsense"], ["-maxcl"], ["-tm", "2"]):
        with pytest.raises(ValueError):
            EngineConfig.parse(bad)
