"""The state machine against a plain second implementation: lists, loops and no shortcuts."""

import itertools
import math

import numpy as np
import pytest

from kairn.config import EngineConfig
from kairn.operators import stepper as S
from kairn.operators.stepper import FrameStepper


def corner(e, a, b):
    """(x, y) of a point at distances a and b from (0, 0) and (e, 0)."""
    x = (a * a - b * b + e * e) / (2 * e)
    return x, math.sqrt(max(0.0, a * a - x * x))


def least_4(e, a, b, c, d):
    """Least distance of two points with distances (a, b) and (c, d) from two points e apart."""
    if e < 1e-9:
        return abs(a - c)
    (x, y), (u, v) = corner(e, a, b), corner(e, c, d)
    return math.hypot(x - u, y - v)


def least_5(d12, d13, d23, one, two):
    """The same from three points; 0 where these are on a line."""
    if d12 < 1e-9:
        return 0.0
    x3 = (d13 * d13 - d23 * d23 + d12 * d12) / (2 * d12)
    if d13 * d13 - x3 * x3 < 1e-9:
        return 0.0
    y3 = math.sqrt(d13 * d13 - x3 * x3)

    def place(a, b, c):
        x = (a * a - b * b + d12 * d12) / (2 * d12)
        y = (a * a - c * c + x3 * x3 + y3 * y3 - 2 * x3 * x) / (2 * y3)
        return x, y, math.sqrt(max(0.0, a * a - x * x - y * y))

    return math.dist(place(*one), place(*two))


class Plain:
    def __init__(self, c):
        self.c, self.anchors, self.p, self.visits, self.uid, self.moves = c, [], [], [], [], {}
        self.prev, self.made, self.heir = None, 0, {}

    def far(self, i, j):
        return float(np.linalg.norm(self.anchors[i] - self.anchors[j]))

    def excluded(self, probes, j):
        r = self.c.rlim
        if any(abs(self.far(t, j) - d) > r for t, d in probes):
            return True
        if self.c.te4 and any(least_4(self.far(s, t), ds, dt, self.far(s, j), self.far(t, j)) > r for (s, ds), (t, dt) in itertools.combinations(probes, 2)):
            return True
        if self.c.te5:
            for order in itertools.combinations(probes, 3):
                # the machine takes the latest probe as origin, then the second latest
                (a, da), (b, db), (c, dc) = order[::-1]
                if least_5(self.far(a, b), self.far(a, c), self.far(b, c), (da, db, dc), (self.far(a, j), self.far(b, j), self.far(c, j))) > r:
                    return True
        return False

    def step(self, x):
        k, probes, found = len(self.anchors), [], None
        if k:
            total = sum(self.p)
            self.p = [v / total for v in self.p]
            prior = list(self.p)
            row = [self.moves.get((self.prev, u), 0) for u in self.uid]
            if self.c.tm and self.prev in self.uid and sum(row):
                prior = [(1 - self.c.tm) * a + self.c.tm * b / sum(row) for a, b in zip(prior, row, strict=True)]
            for t in sorted(range(k), key=lambda j: (-prior[j], j)):
                if self.excluded(probes, t):
                    continue
                d = float(np.linalg.norm(x - self.anchors[t]))
                probes.append((t, d))
                self.visits[t] += 1
                if d < self.c.rlim:
                    found = t
                    self.p[t] += self.c.dprob
                    break
        evals = [(self.uid[t], round(d, 9)) for t, d in probes]
        if found is None:
            if k >= self.c.maxcl:
                self.make_room()
            self.anchors.append(x), self.p.append(1.0), self.visits.append(1), self.uid.append(self.made)
            self.made += 1
            found = len(self.anchors) - 1
            evals.append((self.uid[found], 0.0))
        u = self.uid[found]
        if self.prev is not None:
            self.moves[self.prev, u] = self.moves.get((self.prev, u), 0) + 1
        self.prev = u
        return u, evals

    def make_room(self):
        k = len(self.anchors)
        if self.c.maxcl_strategy == "discard":
            first = int(k * self.c.discard_frac) or k
            gone = min(range(first), key=lambda j: (self.visits[j], j))
            self.heir[self.uid[gone]] = None
        else:
            _, i, j = min((self.far(i, j), i, j) for i, j in itertools.combinations(range(k), 2))
            keep, gone = (i, j) if self.visits[i] >= self.visits[j] else (j, i)
            self.visits[keep] += self.visits[gone]
            self.p[keep] += self.p[gone]
            self.heir[self.uid[gone]] = self.uid[keep]
            old, new = self.uid[gone], self.uid[keep]
            moves = {}
            for (a, b), n in self.moves.items():
                key = (new if a == old else a, new if b == old else b)
                moves[key] = moves.get(key, 0) + n
            self.moves = moves
        if self.prev == self.uid[gone]:
            self.prev = self.heir[self.uid[gone]]
        for own in (self.anchors, self.p, self.visits, self.uid):
            del own[gone]

    def final(self, u):
        while u in self.heir:
            u = self.heir[u]
        return -1 if u is None else self.uid.index(u)


def points(kind):
    rng = np.random.default_rng(11)
    if kind == "disc":
        return rng.uniform(-1, 1, (300, 2)), 0.3
    if kind == "walk":
        return np.cumsum(rng.normal(0, 0.1, (300, 3)), axis=0), 0.4
    return rng.normal(size=(120, 6)), 2.2


@pytest.mark.parametrize("kind", ["disc", "walk", "cloud"])
@pytest.mark.parametrize("options", [{}, {"te4": True}, {"te4": True, "te5": True}, {"te5": True}, {"tm": 0.5}, {"maxcl": 9, "maxcl_strategy": "discard"}, {"maxcl": 9, "maxcl_strategy": "merge"}, {"tm": 0.3, "maxcl": 7, "maxcl_strategy": "merge"}], ids=str)
def test_second_implementation(kind, options):
    data, rlim = points(kind)
    c = EngineConfig(rlim=rlim, **options)
    fast, plain = FrameStepper(c), Plain(c)
    for i, x in enumerate(data):
        got, (u, evals) = fast.step(x), plain.step(x)
        assert (got.cluster, [(k, round(d, 9)) for k, d in got.evals]) == (u, evals), i
    assert [fast.final(u) for u in range(plain.made)] == [plain.final(u) for u in range(plain.made)]


def unit(n, dims=16, seed=2):
    x = np.random.default_rng(seed).normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_visitors_of_a_probe_are_weighed_at_once(monkeypatch):
    from kairn.operators import stepper as S

    calls, plain = [], S.fmatch_np
    monkeypatch.setattr(S, "fmatch_np", lambda *a: calls.append(1) or plain(*a))
    s = FrameStepper(EngineConfig(rlim=1.0, unlimited=True, gprob=True))
    probes = sum(len(s.step(x).probes) for x in unit(200))
    assert 0 < len(calls) <= probes


def test_visits_keep_the_last_ones():
    from kairn.operators.stepper import Visits

    v, every = Visits(6, 0), [(0, 0.0)]
    for i in range(1, 100):
        v.add(3 * i, i / 2)
        every.append((3 * i, i / 2))
        frame, dist = v.before(5)
        assert list(zip(frame.tolist(), dist.tolist(), strict=True)) == every[-6:-1] and len(v.frame) <= 16


@pytest.mark.parametrize("fast", [False, True])
def test_probes_that_tell_nothing_apart_need_no_masks(fast):
    """All distances of unit vectors are within 2 rlim here."""
    import sys

    s, seen = FrameStepper(EngineConfig(rlim=1.1, unlimited=True, entropy=True, entropy_fast=fast, entropy_gate=0.1, entropy_first_gate=0.1)), []
    sys.setprofile(lambda frame, event, _: seen.append(1) if event == "call" and frame.f_code.co_name == "masks" else None)
    try:
        steps = [s.step(x) for x in unit(80)]
    finally:
        sys.setprofile(None)
    assert any(len(p.probes) > 3 for p in steps) and not seen


def test_four_points_at_once_are_those_of_the_bound():
    from kairn.functions.metric import bound_4pt_np

    x = unit(60, 4)
    s = FrameStepper(EngineConfig(rlim=0.3, unlimited=True, te4=True))
    for v in x:
        s.step(v)
    q, k = unit(1, 4, 9)[0], s.k
    measured = [(i, float(np.linalg.norm(q - s.anchors[i]))) for i in range(6)]
    active = np.ones(k, bool)
    active[:6] = False
    want, (c, d) = active.copy(), measured[-1]
    for a in np.flatnonzero(active):
        near = abs(s.low[c, a] - d) <= 0.3
        want[a] = near and all(bound_4pt_np(s.low[p, c], e, d, s.low[p, a], s.low[c, a]) <= 0.3 for p, e in measured[:-1])
    s._prune(measured, active)
    assert (active == want).all() and not want[6:].all()


def counted(monkeypatch, options, *names):
    """Probes of 120 frames, and how often these numpy functions were called."""
    calls = dict.fromkeys(names, 0)

    def counts(name, plain):
        def run(*a, **k):
            calls[name] += 1
            return plain(*a, **k)

        return run

    s, x = FrameStepper(EngineConfig(rlim=1.1, unlimited=True, **options)), unit(120)
    with monkeypatch.context() as m:
        for name in names:
            m.setattr(np, name, counts(name, getattr(np, name)))
        probes = sum(len(s.step(v).probes) for v in x)
    return probes, calls


@pytest.mark.parametrize("leader", [False, True])
def test_blunt_probes_are_not_sorted(monkeypatch, leader):
    probes, calls = counted(monkeypatch, {"entropy": True, "entropy_leader": leader, "entropy_gate": 0.1, "entropy_first_gate": 0.1}, "argsort")
    assert probes > 400 and not calls["argsort"]


def test_later_blunt_probes_need_no_entropy(monkeypatch):
    probes, calls = counted(monkeypatch, {"entropy": True, "entropy_fast": True, "entropy_gate": 0.1, "entropy_first_gate": 0.1}, "frexp")
    assert probes > 400 and 2 * calls["frexp"] < probes


@pytest.mark.parametrize("soft", [False, True])
def test_a_belief_looks_at_visitors_once(monkeypatch, soft):
    probes, calls = counted(monkeypatch, {"gprob": True, "soft_bayesian": soft}, "where")
    assert probes > 400 and 0 < calls["where"] <= (1 + soft) * probes


@pytest.mark.parametrize("cap", [2, 3, 9])
def test_first_of_the_likeliest(cap):
    rng = np.random.default_rng(cap)
    for n in (1, 5, 30, 80):
        p, active = rng.integers(0, 6, n).astype(float), rng.integers(0, 4, n) > 0
        active[-1] = True
        at = np.flatnonzero(active)
        assert FrameStepper._first_likely(p, active, cap) == at[np.sort(np.argsort(-p[at], kind="stable")[: 4 * cap])[0]]


def called(s, name):
    """Counts the calls of this method of s."""
    calls, plain = [], getattr(s, name)
    setattr(s, name, lambda *a: calls.append(1) or plain(*a))
    return calls


@pytest.mark.parametrize("options", [{"entropy_fast": True, "entropy_gate": 1.0}, {"entropy_leader": True}, {"entropy_gate": 1.0, "entropy_first_gate": 1.0}, {"entropy_leader": True, "te4": True}], ids=str)
def test_blunt_clusters_are_ranked_once_a_frame(options):
    c = EngineConfig(rlim=1.1, unlimited=True, entropy=True, **options)
    ranked, plain = FrameStepper(c), FrameStepper(c)
    looks, probes, x = called(ranked, "_entropy_target"), 0, unit(80, 32)
    for i, v in enumerate(np.concatenate([x, x + 0.05 * unit(80, 32, 3)])):
        # as if some probe could tell clusters apart: each target is looked for by itself
        plain.widest = np.inf
        got, want = ranked.step(v), plain.step(v)
        assert (got.evals, got.probes, got.pruned, got.entropy) == (want.evals, want.probes, want.pruned, want.entropy), i
        probes += len(got.probes)
    assert probes > 4 * 160 and len(looks) <= 160


def test_visitors_are_not_filtered_for_each_probe(monkeypatch):
    probes, calls = counted(monkeypatch, {"gprob": True}, "flatnonzero", "count_nonzero")
    assert probes > 400 and not any(calls.values())


def test_visitors_of_merged_clusters_weigh_their_heirs():
    s, x = FrameStepper(EngineConfig(rlim=1.1, maxcl=8, maxcl_strategy="merge", gprob=True)), unit(60)
    found = []
    for v in x:
        found.append(s.step(v).cluster)
        for own in s.visitors:
            assert own.cluster[: own.n].tolist() == [s.final(found[i]) for i in own.frame[: own.n]]
    assert s.merged


def test_probes_of_a_batch():
    from kairn.operators.cluster import member_batch

    s = FrameStepper(EngineConfig(rlim=1.1, unlimited=True, gprob=True))
    steps = [s.step(v) for v in unit(60)]
    got = member_batch([(i, o, o.cluster) for i, o in enumerate(steps)]).column("evals").to_pylist()
    for row, o in zip(got, steps, strict=True):
        assert [tuple(p.values()) for p in row] == [(*e, *p) for e, p in zip(o.evals, [*o.probes, (0.0, 0.0, 1.0)] if o.new else o.probes, strict=True)]


def plain_beside_guesses(monkeypatch, options, x, rlim, method):
    """Steps with and without bounds tried for whole frames: all records and the state are equal. Calls of the method, probes, pruned."""
    c = EngineConfig(rlim=rlim, te4=True, trace=True, **options)
    quick, plain = FrameStepper(c), FrameStepper(c)
    looks, probes, pruned = called(quick, method), 0, 0
    for i, v in enumerate(x):
        got = quick.step(v)
        with monkeypatch.context() as m:
            m.setattr(S, "TRUST", -1)
            want = plain.step(v)
        assert (got.cluster, got.evals, got.probes, got.pruned, got.trace) == (want.cluster, want.evals, want.probes, want.pruned, want.trace), i
        assert (quick.visits == plain.visits).all() and (quick.prob == plain.prob).all() and quick.calls == plain.calls
        probes, pruned = probes + len(got.probes), pruned + int(got.pruned)
    return len(looks), probes, pruned


@pytest.mark.parametrize("options", [{}, {"gprob": True, "sparse_dcc": True}], ids=str)
def test_bounds_of_a_frame_are_tried_at_once(monkeypatch, options):
    looks, probes, _ = plain_beside_guesses(monkeypatch, {"unlimited": True} | options, unit(200, 64), 1.2, "_prune_4pt")
    assert probes > 1000 and looks < 40


@pytest.mark.parametrize("dim", [2, 3, 6])
@pytest.mark.parametrize("options", [{"unlimited": True}, {"unlimited": True, "gprob": True, "sparse_dcc": True}, {"maxcl": 12, "maxcl_strategy": "discard"}, {"maxcl": 12, "maxcl_strategy": "merge"}], ids=str)
def test_bounds_that_drop_clusters(monkeypatch, options, dim):
    monkeypatch.setattr(S, "TRUST", 10**9)
    x = np.concatenate([np.random.default_rng(dim).random((150, dim)), [[0.5] * dim] * 3])
    looks, _, pruned = plain_beside_guesses(monkeypatch, options, x, 0.15 * dim**0.5, "_prune_4pt")
    assert looks and pruned


def test_5pt_bounds_of_a_frame_are_tried_at_once(monkeypatch):
    monkeypatch.setattr(S, "THREES", 30)
    monkeypatch.setattr(S, "_THREES", [])
    looks, probes, _ = plain_beside_guesses(monkeypatch, {"unlimited": True, "te5": True}, unit(120, 64), 1.2, "_prune_5pt")
    assert probes > 1000 and looks < 40


@pytest.mark.parametrize("dim", [3, 6])
@pytest.mark.parametrize("options", [{"unlimited": True}, {"maxcl": 12, "maxcl_strategy": "discard"}, {"maxcl": 12, "maxcl_strategy": "merge"}], ids=str)
def test_5pt_bounds_that_drop_clusters(monkeypatch, options, dim):
    monkeypatch.setattr(S, "TRUST", 10**9)
    tried = []
    plain = FrameStepper._prune_5pt
    monkeypatch.setattr(FrameStepper, "_prune_5pt", lambda self, *a: (tried.append(a[-1].sum()), plain(self, *a), tried.append(a[-1].sum())))
    x = np.concatenate([np.random.default_rng(dim).random((150, dim)), [[0.5] * dim] * 3])
    plain_beside_guesses(monkeypatch, options | {"te5": True}, x, 0.15 * dim**0.5, "_prune_5pt")
    assert any(a > b for a, b in zip(tried[::2], tried[1::2], strict=True))
