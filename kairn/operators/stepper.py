"""The ordered clustering state machine of one stream: one frame at a time, all probe-order modes.

A frame is compared with anchors until one is under rlim, in an order that the mode decides; every
miss removes the anchors that bounds prove to be too far. The anchors found don't depend on the mode;
which of several matching anchors takes a frame does.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from ..config import EngineConfig
from ..functions.metric import fmatch_np, rough_log2, soft_exp_np

FAR = 1e18
#: rough_log2 is at most so much below log2.
ROUGH = 0.0861
#: A call for one distance takes as long as so many numbers in one call for all.
CALL = 1500
#: With so many clusters at most, 4-point bounds are tried for a whole frame at once. A frame where that
#: was in vain counts WRONG, others take one off; from TRUST on bounds are worked out probe by probe.
BOXED, WRONG, TRUST = 1024, 8, 64


_PAIRS = [np.zeros(0, np.int64), np.zeros(0, np.int64)]


def _pairs_of(n: int) -> list[np.ndarray]:
    """Each two of n numbers, the larger one first."""
    if len(_PAIRS[0]) < n * (n - 1) // 2:
        most = np.arange(2 * n)
        _PAIRS[:] = np.repeat(most, most), np.concatenate([most[:i] for i in most])
    return [x[: n * (n - 1) // 2] for x in _PAIRS]


#: Three of so many probes are taken at once.
THREES = 80


def _threes_of(n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each three of n numbers, the largest first; in parts."""
    if not _THREES:
        own = [_pairs_of(c) for c in range(THREES)]
        _THREES[:] = np.repeat(np.arange(THREES), [len(i) for i, _ in own]), *(np.concatenate(x) for x in zip(*own, strict=True))
    few = min(n, THREES)
    yield tuple(x[: few * (few - 1) * (few - 2) // 6] for x in _THREES)
    for c in range(THREES, n):
        i, j = _pairs_of(c)
        yield np.full(len(i), c), i, j


_THREES: list[np.ndarray] = []


class Stopped(Exception):
    """The number of clusters is used up and the strategy is to stop."""


@dataclass
class Step:
    """What happened to one frame. cluster is a creation number that is never given again."""

    cluster: int
    dist: float
    evals: list[tuple[int, float]]
    pruned: int
    new: bool
    predicted: bool = False
    hit: bool = False
    entropy: float = 0.0
    #: For each probe: the cluster's prior, its geometric weight, and the share of clusters excluded before it.
    probes: list[tuple[float, float, float]] = field(default_factory=list)
    trace: list[tuple[str, int, float]] = field(default_factory=list)


class Visits:
    """The last visits of a cluster: frame numbers, distances and the frames' clusters, `keep` of them at least."""

    def __init__(self, keep: int, frame: int, cluster: int = -1):
        self.keep, self.n = keep, 1
        self.frame, self.dist, self.cluster = np.full(8, frame, np.int64), np.zeros(8), np.full(8, cluster, np.int64)

    def add(self, frame: int, dist: float, cluster: int = -1) -> None:
        n = self.n
        if n == len(self.frame):
            own = slice(max(0, n - self.keep), n)
            self.n = n = own.stop - own.start
            self.frame, self.dist, self.cluster = (np.append(v[own], np.zeros(n, v.dtype)) for v in (self.frame, self.dist, self.cluster))
        self.frame[n], self.dist[n], self.cluster[n] = frame, dist, cluster
        self.n = n + 1

    def last(self, most: int, kept: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances and clusters of the last visits, at most so many, of frames from `kept` on (frames are in order)."""
        n = self.n
        start = max(0, n - most)
        if self.frame[start] < kept:
            start += int(self.frame[start:n].searchsorted(kept))
        return self.dist[start:n], self.cluster[start:n]

    def before(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """The visits before the last one, at most so many."""
        own = slice(max(0, self.n - 1 - most), self.n - 1)
        return self.frame[own], self.dist[own]


class Ranked:
    """The clusters that are left for a frame in an entropy mode, where no probe tells two of them apart.

    A miss takes one cluster out and leaves the others' odds, so they are put in order once, and the
    exact entropy follows from two sums. Only where the rough entropy could decide otherwise are the
    beliefs brought up to date, miss by miss, and looked at.
    """

    def __init__(self, post: np.ndarray, active: np.ndarray, c: EngineConfig):
        self.c, self.p, self.post, self.active, self.missed = c, post, post.copy(), active, []
        at = np.flatnonzero(active)
        self.up = iter(at.tolist())
        self.first = next(self.up)
        self.rest = at[(-post[at]).argsort(kind="stable")].tolist()
        self._count()

    def _count(self) -> None:
        own = self.p[self.rest]
        some = own[own > 0]
        self.total = self.counted = float(own.sum())
        self.logs = float((some * np.log2(some)).sum())

    def _cap(self, h: float) -> int:
        return min(self.c.entropy_max_targets, max(2, int(2 * h + 1)))

    def _rough(self) -> tuple[float, float]:
        """The rough entropy, and the likeliest cluster's belief."""
        post = self.post
        for t in self.missed:
            post[t] = 0
            post /= post.sum()
        self.missed = []
        q = post[self.active]
        q /= q.sum()
        some = q if q.min() > 0 else q[q > 0]
        return -float((some * rough_log2(some)).sum()), float(q.max())

    def target(self) -> int | None:
        """The next cluster to probe; None if those that are left have no belief."""
        c, rest = self.c, self.rest
        if len(rest) == 1:
            return rest[0]
        if self.total < 0.5 * self.counted:
            self._count()
        if self.total <= 0:
            return None
        share = float(self.p[rest[0]]) / self.total
        h = math.log2(self.total) - self.logs / self.total - 1e-6
        most = h + ROUGH + 2e-6
        if h < c.entropy_gate <= most or (c.entropy_leader and abs(share - c.entropy_leader_cutoff) < 1e-9) or not (c.entropy_fast or self._cap(h) == self._cap(most)):
            h, share = self._rough()
        if h < c.entropy_gate or (c.entropy_leader and share >= c.entropy_leader_cutoff):
            return rest[0]
        if c.entropy_fast:
            while not self.active[self.first]:
                self.first = next(self.up)
            return self.first
        return min(rest[: 4 * self._cap(h)])

    def miss(self, t: int) -> None:
        self.rest.remove(t)
        self.missed.append(t)
        own = float(self.p[t])
        self.total -= own
        if own > 0:
            self.logs -= own * math.log2(own)


class FrameStepper:
    def __init__(self, config: EngineConfig):
        self.c = config
        self.k = 0
        self.uid: list[int] = []
        self.next_uid = 0
        self.anchors: np.ndarray | None = None
        self.prob = np.zeros(0)
        self.low, self.high = np.zeros((0, 0)), np.zeros((0, 0))
        self.moves = np.zeros((0, 0), np.int64)
        self.visitors: list[Visits] = []
        self.visits = np.zeros(0, np.int64)
        self.prev = -1
        keep = max((p[1] for p in (config.pred, config.predf) if p), default=0) + max((p[0] for p in (config.pred, config.predf) if p), default=0) + 1
        self.history: deque[tuple[int, float]] = deque(maxlen=max(keep, 2))
        #: The visitors of frames from here on count (gprob).
        self.kept = 0
        self.frames = 0
        self.calls = {"dfc": 0, "dcc": 0}
        self.merged: dict[int, int] = {}
        self.boost: np.ndarray | None = None
        #: The largest and the least distance of each cluster to others (of lower bounds, those of one frame), and the largest of all.
        self.reach, self.near, self.widest = np.zeros(0), np.zeros(0), 0.0
        self.joint: list[int] = []
        #: For clusters c and i: their distance, and the least and largest x and y of all others in a plane
        #: where c is the origin and i lies on the x axis.
        self.box = np.zeros((5, 0, 0))
        #: Beside the boxes, the least and largest distance of each cluster to others.
        self.span = np.zeros((2, 0))
        self.wrong = 0
        #: Priors from a joint prediction, in place of the stepper's own.
        self.given: np.ndarray | None = None

    # growth

    def _grow(self, dim: int) -> None:
        size = len(self.prob)
        if self.k < size:
            return
        new = max(64, 2 * size)

        def wider(a: np.ndarray, fill: float = 0) -> np.ndarray:
            out = np.full((new,) * a.ndim, fill, a.dtype)
            out[tuple(slice(0, n) for n in a.shape)] = a
            return out

        anchors = np.zeros((new, dim))
        if self.anchors is not None:
            anchors[: len(self.anchors)] = self.anchors
        self.anchors, self.prob, self.moves, self.visits = anchors, wider(self.prob), wider(self.moves), wider(self.visits)
        self.low, self.high = wider(self.low), wider(self.high, FAR)
        self.reach, self.near = wider(self.reach), wider(self.near, FAR)

    def _distance(self, a: np.ndarray, b: np.ndarray, kind: str) -> float:
        self.calls[kind] += 1
        d = a - b
        return math.sqrt(d @ d)

    # priors

    def _priors(self) -> np.ndarray:
        k, c = self.k, self.c
        total = self.prob[:k].sum()
        self.prob[:k] = self.prob[:k] / total if total > 0 else 1 / k
        p = self.prob[:k].copy()
        if c.predf:
            seq = self._fuzzy()
            if (p * seq).sum() > 0:
                p = p * seq / (p * seq).sum()
        if c.tm and self.prev >= 0 and (row := self.moves[self.prev, :k]).sum() > 0:
            p = (1 - c.tm) * p + c.tm * row / row.sum()
        return p

    def _fuzzy(self) -> np.ndarray:
        """Weights of the successors of stretches of history that resemble the last one."""
        length, horizon, _ = self.c.predf
        h, out = list(self.history), np.zeros(self.k)
        n = len(h)
        if n <= length:
            return out
        r = self.c.rlim
        for t in range(max(length, n - horizon), n):
            total = 0.0
            for j in range(length):
                (ca, da), (cb, db) = h[n - 1 - j], h[t - 1 - j]
                if ca < 0 or cb < 0:
                    break
                apart = da + db + (self.high[ca, cb] if ca != cb else 0.0)
                if apart > r:
                    break
                total += (1 - 1 / length) ** j * apart / r
            else:
                if h[t][0] >= 0:
                    out[h[t][0]] += np.exp(-total / ((1 - (1 - 1 / length) ** length) * length))
        return out

    def _predicted(self) -> list[int]:
        """Most frequent successors of earlier occurrences of the last states."""
        spec = self.c.pred or self.c.predf
        if not spec:
            return []
        length, horizon, n = spec
        h = [s for s, _ in self.history]
        if len(h) <= length:
            return []
        last, found = h[-length:], Counter()
        for t in range(max(length, len(h) - horizon), len(h)):
            if h[t - length : t] == last and h[t] >= 0:
                found[h[t]] += 1
        return [s for s, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:n]]

    def _candidates(self) -> list[int]:
        own, joint = self._predicted(), [j for j in self.joint if j < self.k]
        merged = [*own, *joint] if len(own) == 1 else [*joint, *own]
        spec = self.c.pred or self.c.predf
        return list(dict.fromkeys(merged))[: spec[2] if spec else len(merged)]

    # bounds

    def _boxed(self, n: int) -> None:
        """Boxes with cluster n, the last one."""
        if n >= BOXED:
            self.box = np.zeros((5, 0, 0))
            return
        size = self.box.shape[1]
        if n >= size:
            box = np.full((5, 2 * size or 64, 2 * size or 64), np.inf)
            box[0], box[2], box[4] = 1.0, -np.inf, -np.inf
            box[:, :size, :size] = self.box
            self.box = box
            self.span = np.hstack([self.span, np.full((2, len(box[0]) - size), [[FAR], [0.0]])])
        apart = self.anchors[:n] - self.anchors[n]
        to = np.sqrt(np.vecdot(apart, apart))
        self.span[0, :n], self.span[1, :n] = np.minimum(self.span[0, :n], to), np.maximum(self.span[1, :n], to)
        self.span[:, n] = to.min(initial=FAR), to.max(initial=0)
        e, x_low, x_high, y_low, y_high = own = self.box[:, :n, :n]
        # n as a target of the others
        x = ((to * to)[:, None] - to * to + e * e) / (2 * e)
        y = np.sqrt(np.maximum(0, (to * to)[:, None] - x * x))
        others = ~np.eye(n, dtype=bool)
        for low, high, v in ((x_low, x_high, x), (y_low, y_high, y)):
            np.minimum(low, v, out=low, where=others)
            np.maximum(high, v, out=high, where=others)
        # n as the origin, row by row with another cluster on the x axis; two at one place have no plane
        axis = np.where(to < 1e-6, 1.0, to)[:, None]
        far = np.where(others, own[0], to[:, None])
        x = (to * to - far * far + axis * axis) / (2 * axis)
        y = np.sqrt(np.maximum(0, to * to - x * x))
        ends = [f(v, axis=1, initial=i, where=others) for v in (x, y) for f, i in ((np.min, np.inf), (np.max, -np.inf))]
        self.box[:, n, :n] = [axis[:, 0], *ends]
        self.box[:, :n, n] = [axis[:, 0], axis[:, 0] - ends[1], axis[:, 0] - ends[0], *ends[2:]]
        self.box[:, n, n] = [1.0, np.inf, -np.inf, np.inf, -np.inf]
        at = np.flatnonzero(to < 1e-6)
        self.box[2, n, at] = self.box[2, at, n] = np.inf

    def _none_pruned(self, missed: list[tuple[int, float]]) -> bool:
        """Whether no 4-point bound of these probes can exceed rlim, wherever in its box a cluster is."""
        if len(missed) < 2:
            return True
        at, d = np.array([i for i, _ in missed]), np.array([d for _, d in missed])
        one, two = _pairs_of(len(at))
        at, d = at[one] * self.box.shape[1] + at[two], d * d
        to, other = d[one], d[two]
        e, x_low, x_high, y_low, y_high = (b.take(at) for b in self.box.reshape(5, -1))
        x = (to - other + e * e) / (2 * e)
        y = np.sqrt(np.maximum(0, to - x * x))
        x = np.maximum(np.maximum(x - x_low, x_high - x), 0)
        y = np.maximum(np.maximum(y - y_low, y_high - y), 0)
        return bool((x * x + y * y <= self.c.rlim**2 * (1 - 1e-9)).all())

    def _none_pruned_5pt(self, missed: list[tuple[int, float]]) -> bool:
        """Whether no 5-point bound of these probes exceeds rlim for a cluster that is left after them.

        The boxes bound how far a cluster and the frame are apart along each side of the triangle of three
        probes, and so in its plane: at most as far as at a corner of what the three bounds leave. Where
        that and the heights leave it open, bounds are worked out.
        """
        m, rr = len(missed), self.c.rlim**2 * (1 - 1e-9)
        if m < 3:
            return True
        at, d = np.array([i for i, _ in missed]), np.array([d for _, d in missed])
        d *= d
        e, x_low, x_high = self.box[:3, at[:, None], at]
        x = (d[:, None] - d + e * e) / (2 * e)
        with np.errstate(invalid="ignore"):
            e, x, low, high = (v.ravel() for v in (e, x, x_low - x, x_high - x))
            near, far = self.span[:, at] ** 2
            for c, i, j in _threes_of(m):
                ci, cj = c * m + i, c * m + j
                one, two = e.take(ci), e.take(cj)
                x3 = (two * two - e.take(i * m + j) ** 2 + one * one) / (2 * one)
                yy = two * two - x3 * x3
                y3 = np.sqrt(np.maximum(yy, 1e-4))
                x5, by_one, by_y = x.take(ci), 1 / one, 1 / y3
                y5 = (two * x.take(cj) - x3 * x5) * by_y
                z5 = np.sqrt(np.maximum(0, d.take(c) - x5 * x5 - y5 * y5))
                flat = rho = np.zeros(len(c))
                # along the sides from c, and so, by their difference, along the third side
                sides = [(one * low.take(ci), one * high.take(ci)), (two * low.take(cj), two * high.take(cj))]
                third = j * m + i
                g_low, g_high = (e.take(third) * v.take(third) for v in (low, high))
                corners = [(v, f(w, v - g)) for v in sides[0] for f, w, g in ((np.maximum, sides[1][0], g_high), (np.minimum, sides[1][1], g_low))]
                corners += [(f(v, w + g), w) for w in sides[1] for f, v, g in ((np.maximum, sides[0][0], g_low), (np.minimum, sides[0][1], g_high))]
                least, most = near.take(c), far.take(c)
                over = np.zeros(len(c))
                for u, w in corners:
                    u = u * by_one
                    v = (w - x3 * u) * by_y
                    own, to = u * u + v * v, (x5 + u) ** 2 + (y5 + v) ** 2
                    flat, rho = np.maximum(flat, own), np.maximum(rho, to)
                    # for one distance from c the bound is convex in the plane, and in one place convex in that distance
                    z = np.maximum(np.sqrt(np.maximum(0, most - to)) - z5, z5 - np.sqrt(np.maximum(0, least - to)))
                    over = np.maximum(over, own + z * z)
                # beyond the least distance a cluster may be in the plane
                over = np.where(rho > least, np.maximum(over, flat + z5 * z5), over)
                open_ = np.flatnonzero(~((over <= rr) & (yy >= 1e-4)))
                if len(open_) and self._over_5pt(at, d, c[open_], i[open_], j[open_], rr):
                    return False
        return True

    def _over_5pt(self, at: np.ndarray, d: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray, rr: float) -> bool:
        """Whether a bound (bound_5pt_np, in squares) from probes c, i and j exceeds rr for a cluster that is no earlier probe; d: squares of distances."""
        k = self.k
        rank, some = np.full(k, k), max(1, (1 << 18) // k)
        rank[at] = np.arange(len(at))
        squares = self.low[at, :k] ** 2
        for a in range(0, len(c), some):
            f, g, h = c[a : a + some], i[a : a + some], j[a : a + some]
            ee, own = squares[f, at[g]], squares[f, at[h]]
            e = np.sqrt(ee)
            x3 = (own - squares[g, at[h]] + ee) / (2 * e)
            yy = own - x3 * x3
            fit = (e >= 1e-9) & (yy >= 0.9e-9)
            scale = 0.5 / np.sqrt(np.maximum(yy, 0.9e-9))
            x5 = (d[f] - d[g] + ee) / (2 * e)
            y5 = (d[f] - d[h] + own - 2 * x3 * x5) * scale
            z5 = np.sqrt(np.maximum(0, d[f] - x5 * x5 - y5 * y5))
            to = squares[f]
            x4 = (to - squares[g] + ee[:, None]) * (0.5 / e)[:, None]
            y = (own[:, None] - 2 * x3[:, None] * x4 - squares[h] + to) * scale[:, None]
            z = np.sqrt(np.maximum(0, to - x4 * x4 - y * y)) - z5[:, None]
            y -= y5[:, None]
            x4 -= x5[:, None]
            if ((x4 * x4 + y * y + z * z > rr) & fit[:, None] & (rank > f[:, None])).any():
                return True
        return False

    def _prune(self, measured: list[tuple[int, float]], active: np.ndarray, sure: bool = True) -> int:
        """Drop clusters that are proven to be beyond rlim; returns how many. Not sure: only by their distances to the last probe."""
        k, r = self.k, self.c.rlim
        c, d = measured[-1]
        if not sure and self.span[1, c] - d <= r * (1 - 1e-9) and d - self.span[0, c] <= r * (1 - 1e-9):
            # bounds are no sharper than the distances themselves
            return 0
        if not (self.c.sparse_dcc or (sure and (self.c.te4 or self.c.te5))) and self.reach[c] - d <= r and d - self.near[c] <= r:
            return 0
        before = np.count_nonzero(active)
        low, high = self.low[c, :k], self.high[c, :k]
        if self.c.sparse_dcc:
            active &= ~((low - d > r) | ((high < FAR) & (d - high > r)))
        else:
            active &= np.abs(low - d) <= r
        if sure and (self.c.te4 or self.c.te5) and len(measured) > 1 and active.any():
            # the earlier probes whose distance to this one is known, latest first
            known = measured[-2::-1] if not self.c.sparse_dcc else [(i, e) for i, e in measured[-2::-1] if low[i] == high[i]]
            probes, dist = np.array([i for i, _ in known], np.int64), np.array([e for _, e in known])
            at = np.flatnonzero(active & (low == high))
            if self.c.te4 and len(probes):
                at = self._prune_4pt(c, d, probes, dist, at, active)
            if self.c.te5 and len(probes) > 1:
                self._prune_5pt(c, d, probes, dist, at, active)
        return before - np.count_nonzero(active)

    def _prune_4pt(self, c: int, d: float, probes: np.ndarray, dist: np.ndarray, at: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Bounds from probe c with each earlier one, for all of `at` in one call; returns those of `at` that stay."""
        # bound_4pt_np in squares: the probe is the origin and probe c lies on the x axis
        to, e, rr = self.low[np.ix_(probes, at)], self.low[probes, c], self.c.rlim**2
        if self.c.sparse_dcc:
            open_ = to != self.high[np.ix_(probes, at)]
        same = e < 1e-9
        e = np.where(same, 1.0, e)
        x3 = (dist * dist - d * d + e * e) / (2 * e)
        y3 = np.sqrt(np.maximum(0, dist * dist - x3 * x3))
        if same.any():
            apart = np.abs(to[same] - dist[same, None]) > self.c.rlim
        to *= to
        x = to - self.low[c, at] ** 2
        x += (e * e)[:, None]
        x *= (0.5 / e)[:, None]
        to -= x * x
        np.maximum(to, 0, out=to)
        np.sqrt(to, out=to)
        to -= y3[:, None]
        to *= to
        x -= x3[:, None]
        x *= x
        x += to
        over = x > rr
        if same.any():
            over[same] = apart
        if self.c.sparse_dcc:
            over &= ~open_
        gone = over.any(axis=0)
        active[at[gone]] = False
        return at[~gone]

    def _prune_5pt(self, c: int, d: float, probes: np.ndarray, dist: np.ndarray, at: np.ndarray, active: np.ndarray) -> None:
        """Bounds from probe c with each two earlier ones (bound_5pt_np, in squares).

        Probe c is the origin and an earlier one, c2, lies on the x axis; all others as the third point
        and all of `at` as the target are one call.
        """
        low, high, rr = self.low, self.high, self.c.rlim**2
        sparse = self.c.sparse_dcc
        own, far = low[c, probes] ** 2, low[np.ix_(probes, at)] ** 2
        for i in range(len(probes) - 1):
            if not len(at):
                return
            e, third = low[c, probes[i]], np.arange(i + 1, len(probes))
            if e < 1e-9:
                continue
            x3 = (own[third] - low[probes[i], probes[third]] ** 2 + e * e) / (2 * e)
            yy = own[third] - x3 * x3
            fit = yy >= 1e-9
            if sparse:
                fit &= low[probes[i], probes[third]] == high[probes[i], probes[third]]
            third, x3, scale = third[fit], x3[fit], 0.5 / np.sqrt(yy[fit])
            to = low[c, at] ** 2
            x5, x4 = (d * d - dist[i] ** 2 + e * e) / (2 * e), (to - far[i] + e * e) / (2 * e)
            y5 = (d * d - dist[third] ** 2 + own[third] - 2 * x3 * x5) * scale
            z5 = np.sqrt(np.maximum(0, d * d - x5 * x5 - y5 * y5))
            y = np.multiply.outer(-2 * x3, x4)
            y += own[third][:, None]
            y -= far[third]
            y += to
            y *= scale[:, None]
            z = (to - x4 * x4) - y * y
            np.maximum(z, 0, out=z)
            np.sqrt(z, out=z)
            z -= z5[:, None]
            y -= y5[:, None]
            z *= z
            y *= y
            y += z
            over = y > rr - (x4 - x5) ** 2
            if sparse:
                over &= low[np.ix_(probes[third], at)] == high[np.ix_(probes[third], at)]
                over &= low[probes[i], at] == high[probes[i], at]
            gone = over.any(axis=0)
            if gone.any():
                active[at[gone]] = False
                at, far = at[~gone], far[:, ~gone]

    # targets

    def _entropy_target(self, p: np.ndarray, active: np.ndarray, first: bool, step: Step) -> int:
        c = self.c
        at = np.flatnonzero(active)
        own = p[at]
        best = at[own.argmax()]
        if len(at) == 1:
            return int(best)
        total = own.sum()
        q = own / total if total > 0 else np.full(len(at), 1 / len(at))
        some = q > 0
        if some.all():
            logs = rough_log2(q)
        else:
            logs = np.zeros(len(at))
            logs[some] = rough_log2(q[some])
        h = float(-(q * logs).sum())
        if first:
            step.entropy = h
        if h < (c.entropy_first_gate if first else c.entropy_gate) or (c.entropy_leader and q.max() >= c.entropy_leader_cutoff):
            return int(best)
        if c.sparse_dcc and first:
            self.reach[: self.k] = self.low[: self.k, : self.k].max(axis=1)
        # a probe whose distances to all clusters differ by 2 rlim at most tells no two of them apart
        blunt = self.reach[at] <= 2 * c.rlim
        every_blunt = blunt.all()
        if c.entropy_fast and every_blunt:
            return int(at[0])
        cap = min(c.entropy_max_targets, max(2, int(2 * h + 1)))
        if every_blunt and cap > 1:
            return self._first_likely(p, active, cap)
        likely = np.flatnonzero(q >= max(0.01 * q.max(), c.entropy_min_prob))
        order = np.argsort(-q, kind="stable")
        chosen = list(order[: max(1, cap // 2)])
        hyp = likely[np.argsort(-q[likely], kind="stable")][:32]

        def masks(i: int, js: np.ndarray) -> np.ndarray:
            """For truths js: which clusters stay possible after a probe of i."""
            lo, hi = self.low[at[i], at], self.high[at[i], at]
            gap = np.maximum(lo[None, :] - hi[js][:, None], lo[js][:, None] - hi[None, :])
            return gap <= 2 * c.rlim

        every = len(hyp) * len(at)
        counts = {int(i): every if blunt[i] else int(masks(i, hyp).sum()) for i in (order if c.entropy_fast else order[cap // 2 : 4 * cap])}
        if c.entropy_fast:
            return int(at[min(counts, key=lambda i: (counts[i], at[i]))])
        chosen += sorted(counts, key=lambda i: (counts[i], at[i]))[: cap - len(chosen)]
        chosen = list(dict.fromkeys(map(int, chosen)))
        if blunt[chosen].all():
            return int(at[min(chosen)])
        scores, of_blunt = {}, None
        for i in chosen:
            if blunt[i] and of_blunt is not None:
                scores[i] = of_blunt
                continue
            m = masks(i, likely)
            mass = m @ q
            rest = np.log2(np.maximum(mass, 1e-300)) - (m @ (q * logs)) / np.maximum(mass, 1e-300)
            scores[i] = float((q[likely] * rest).sum())
            if blunt[i]:
                of_blunt = scores[i]
        return int(at[min(scores, key=lambda i: (scores[i], at[i]))])

    @staticmethod
    def _first_likely(p: np.ndarray, active: np.ndarray, cap: int) -> int:
        """The first of the 4 cap likeliest clusters, ties by number, without sorting them."""
        at = np.flatnonzero(active)
        if len(at) <= 4 * cap:
            return int(at[0])
        q, total = p[at], p[at].sum()
        q = q / total if total > 0 else np.full(len(at), 1 / len(at))
        return int(at[(q >= np.partition(q, len(q) - 4 * cap)[len(q) - 4 * cap]).argmax()])

    # one frame

    def _search(self, x: np.ndarray, sure: bool) -> tuple[Step, int, list[tuple[int, float]]]:
        """The cluster that takes x, or -1, and the probes up to it."""
        c, out = self.c, Step(-1, 0.0, [], 0, False)
        measured: list[tuple[int, float]] = []
        found = -1
        if self.k:
            prior = self._priors()
            if self.given is not None and len(self.given) == self.k:
                prior = self.given.copy()
            if self.boost is not None and len(self.boost) == self.k:
                prior = prior * self.boost
                prior = prior / prior.sum() if prior.sum() > 0 else self.prob[: self.k].copy()
            listed = self._candidates()
            out.predicted = bool(listed)
            # beliefs change with each miss in these modes only; else the prior's order is all there is
            belief = c.entropy or c.gprob or c.xtile
            active, post, left, alive = np.ones(self.k, bool), prior.copy(), prior if belief else prior.copy(), self.k
            weight = np.ones(self.k) if c.gprob else None
            # where clusters aren't told apart and beliefs only lose those missed, these are ranked once
            plain = c.entropy and not (c.gprob or c.soft_bayesian or c.sparse_dcc) and self.widest <= 2 * c.rlim and (c.entropy_fast or c.entropy_max_targets > 1)
            ranked, dists = None, None
            while True:
                listed = [j for j in listed if active[j]]
                if listed:
                    t = listed.pop(0)
                elif not belief:
                    # the static order, best first and ties to the lowest number, without sorting it all
                    t = int(left.argmax())
                    if left[t] < 0:
                        break
                elif not alive:
                    break
                elif c.entropy:
                    if plain and measured and ranked is None:
                        ranked = Ranked(post, active, c)
                    t = ranked.target() if ranked else None
                    if t is None:
                        if ranked:
                            plain, ranked, post = False, None, active / alive
                        t = self._entropy_target(post, active, not measured, out)
                else:
                    # those that are dropped have no belief
                    t = int(post.argmax())
                    if not active[t]:
                        t = int(active.argmax())
                if dists is None and self.anchors[: self.k].size <= CALL * len(measured):
                    # after many misses, many may follow
                    apart = self.anchors[: self.k] - x
                    dists = np.sqrt(np.vecdot(apart, apart))
                if dists is None:
                    d = self._distance(x, self.anchors[t], "dfc")
                else:
                    d = float(dists[t])
                    self.calls["dfc"] += 1
                measured.append((t, d))
                out.probes.append((float(prior[t]), 1.0 if weight is None else float(weight[t]), 1 - alive / self.k))
                self.visits[t] += 1
                if c.trace:
                    out.trace.append(("probe", self.uid[t], d))
                if d < c.rlim:
                    found = t
                    out.hit = out.predicted and len(measured) == 1
                    break
                active[t] = False
                gone = self._prune(measured, active, sure)
                out.pruned += gone
                alive -= 1 + gone
                if c.trace and gone:
                    out.trace.append(("prune", gone, d))
                if not belief:
                    left[t] = -1
                    if gone:
                        left[~active] = -1
                    continue
                if ranked:
                    ranked.miss(t)
                    if not gone:
                        continue
                    # what is left is ranked anew
                    ranked, post = None, prior.copy()
                if c.gprob:
                    dk, of = self.visitors[t].last(c.maxvis, self.kept)
                    if self.merged:
                        dk, of = dk[of >= 0], of[of >= 0]
                    apart = d - dk
                    np.abs(apart, out=apart)
                    apart /= c.rlim
                    factor = fmatch_np(apart, c.fmatcha, c.fmatchb)
                    # one by one in order, also where visitors share a cluster; those dropped stay at 0
                    np.multiply.at(post, of, factor)
                    np.multiply.at(weight, of, factor)
                if c.soft_bayesian:
                    sigma, low = c.soft_bayesian_sigma * c.rlim, self.low[t, : self.k]
                    on = np.flatnonzero(active & (low == self.high[t, : self.k]) if c.sparse_dcc else active)
                    post[on] *= soft_exp_np((d - low[on]) ** 2 / (2 * sigma**2))
                post[t] = 0
                if weight is not None:
                    weight[t] = 0
                if gone:
                    post[~active] = 0
                    if weight is not None:
                        weight[~active] = 0
                total = post.sum()
                if alive and total > 0:
                    post /= total
                elif alive:
                    post = active / alive
        return out, found, measured

    def step(self, x: np.ndarray) -> Step:
        x, c, k = np.asarray(x, float), self.c, self.k
        if 1 < k <= len(self.box[0]) and self.wrong < TRUST:
            # bounds rarely drop a cluster where there are many dimensions: as if they didn't, and then whether they could
            prob, calls = self.prob[:k].copy(), self.calls["dfc"]
            out, found, measured = self._search(x, False)
            missed = measured if found < 0 else measured[:-1]
            if (not c.te4 or self._none_pruned(missed)) and (not c.te5 or self._none_pruned_5pt(missed)):
                self.wrong = max(0, self.wrong - 1)
            else:
                self.wrong += WRONG
                self.prob[:k], self.calls["dfc"] = prob, calls
                np.subtract.at(self.visits, [i for i, _ in measured], 1)
                out, found, measured = self._search(x, True)
        else:
            self.wrong = max(0, self.wrong - 1)
            out, found, measured = self._search(x, True)
        out.new = found < 0
        # by creation numbers, before a probed cluster is evicted
        out.evals = [(self.uid[i], d) for i, d in measured]
        if out.new:
            found = self._create(x, measured)
            out.evals.append((self.uid[found], 0.0))
        elif not (c.pred or c.predf):
            self.prob[found] += c.dprob
        out.dist = 0.0 if out.new else measured[-1][1]
        out.cluster = self.uid[found]
        if c.gprob:
            for i, d in measured:
                self.visitors[i].add(self.frames, d, found)
        self._record(found, out.dist)
        if c.sparse_dcc and c.sparse_dcc_extra_evals:
            self._refine(c.sparse_dcc_extra_evals)
        if c.trace:
            out.trace.append(("new" if out.new else "match", out.cluster, out.dist))
            out.trace = out.trace[-c.trace_rows :]
        return out

    def _record(self, found: int, dist: float) -> None:
        c, k = self.c, self.k
        if self.prev >= 0:
            self.moves[self.prev, found] += 1
        self.prev = found
        self.history.append((found, dist))
        if c.gprob:
            self.kept = max(self.kept, self.frames + 1 - 2 * c.maxvis * max(1, k))
        self.frames += 1
        if c.pred or c.predf:
            p = self.prob[:k]
            p[found] += 0.3
            p /= p.sum()
            p += 0.2 / k
            p /= p.sum()

    def _create(self, x: np.ndarray, measured: list[tuple[int, float]]) -> int:
        c = self.c
        if self.k >= c.maxcl and not c.unlimited:
            if c.maxcl_strategy == "stop":
                raise Stopped
            measured[:] = self._make_room(measured)
        self._grow(len(x))
        n = self.k
        self.anchors[n] = x
        self.low[n, : n + 1], self.high[n, : n + 1] = 0.0, FAR
        known = dict(measured)
        if c.sparse_dcc:
            for j, d in known.items():
                self.low[n, :n] = np.maximum(self.low[n, :n], np.maximum(self.low[j, :n] - d, np.where(self.high[j, :n] < FAR, d - self.high[j, :n], 0)))
                self.high[n, :n] = np.minimum(self.high[n, :n], np.where(self.high[j, :n] < FAR, d + self.high[j, :n], FAR))
            for j, d in known.items():
                self.low[n, j] = self.high[n, j] = d
        else:
            apart = self.anchors[:n] - x
            self.low[n, :n] = np.sqrt(np.einsum("ij,ij->i", apart, apart))
            self.low[n, list(known)] = list(known.values())
            self.high[n, :n] = self.low[n, :n]
            self.calls["dcc"] += n - len(known)
        self.low[n, n] = self.high[n, n] = 0.0
        self.low[: n + 1, n], self.high[: n + 1, n] = self.low[n, : n + 1], self.high[n, : n + 1]
        self.prob[n], self.visits[n] = 1.0, 1
        self.moves[n, : n + 1] = self.moves[: n + 1, n] = 0
        if not c.sparse_dcc:
            row = self.low[n, :n]
            self.reach[:n], self.near[:n] = np.maximum(self.reach[:n], row), np.minimum(self.near[:n], row)
            self.reach[n], self.near[n] = row.max(initial=0), row.min(initial=FAR)
            self.widest = max(self.widest, float(self.reach[n]))
        if (c.te4 or c.te5) and not (c.entropy or (c.te5 and c.sparse_dcc)) and (len(self.box[0]) or not n):
            self._boxed(n)
        self.visitors.append(Visits(c.maxvis + 1, self.frames, n))
        self.uid.append(self.next_uid)
        self.next_uid += 1
        self.k += 1
        return n

    def _make_room(self, measured: list[tuple[int, float]]) -> list[tuple[int, float]]:
        """Evict or merge one cluster; returns measured with the numbers after that."""
        c, k = self.c, self.k
        if c.maxcl_strategy == "discard":
            first = int(k * c.discard_frac)
            gone = int(np.argmin(self.visits[: first if first >= 1 else k]))
            self.merged[self.uid[gone]] = -1
            target = -1
        else:
            exact = np.triu(self.low[:k, :k] == self.high[:k, :k], 1)
            if not exact.any():
                raise Stopped
            pair = np.where(exact, self.low[:k, :k], np.inf)
            i, j = divmod(int(np.argmin(pair)), k)
            target, gone = (i, j) if self.visits[i] >= self.visits[j] else (j, i)
            self.merged[self.uid[gone]] = self.uid[target]
            self.visits[target] += self.visits[gone]
            self.prob[target] += self.prob[gone]
            self.moves[target, :k] += self.moves[gone, :k]
            self.moves[:k, target] += self.moves[:k, gone]
        keep = np.delete(np.arange(k), gone)
        new = {int(o): n for n, o in enumerate(keep)} | {gone: target if target < gone else target - 1}
        n = k - 1
        self.anchors[:n], self.prob[:n], self.visits[:n] = self.anchors[keep], self.prob[keep], self.visits[keep]
        for m in (self.low, self.high, self.moves):
            m[:n, :n] = m[np.ix_(keep, keep)]
        if len(self.box[0]):
            # those of the cluster that goes may be larger than need be
            self.box[:, :n, :n], self.span[:, :n] = self.box[:, keep[:, None], keep], self.span[:, keep]
            self.box[:, n:] = self.box[:, :, n:] = np.array([1.0, np.inf, -np.inf, np.inf, -np.inf])[:, None, None]
        self.prob[n] = self.visits[n] = 0
        del self.visitors[gone], self.uid[gone]
        self.k = n
        self.prev = new.get(self.prev, -1)
        self.history = deque([(new.get(s, -1), d) for s, d in self.history], maxlen=self.history.maxlen)
        own = self.low[:n, :n]
        self.reach[:n], self.near[:n] = own.max(axis=1, initial=0), np.where(np.eye(n, dtype=bool), FAR, own).min(axis=1, initial=FAR)
        self.widest = float(self.reach[:n].max(initial=0))
        if c.gprob:
            # -1 stays -1: it is the last entry
            heir = np.array([*[new.get(i, -1) for i in range(k)], -1])
            for v in self.visitors:
                v.cluster = heir[v.cluster]
        return [(new[i], d) for i, d in measured if i != gone]

    def _refine(self, extra: int) -> None:
        """Measure the anchor pairs that may be closest and are not known, and carry the bounds on."""
        k = self.k
        open_ = np.triu(self.low[:k, :k] < self.high[:k, :k], 1)
        pairs = np.argwhere(open_)
        if not len(pairs):
            return
        order = np.lexsort((pairs[:, 1], pairs[:, 0], self.low[pairs[:, 0], pairs[:, 1]]))[:extra]
        for i, j in pairs[order]:
            d = self._distance(self.anchors[i], self.anchors[j], "dcc")
            self.low[i, j] = self.low[j, i] = self.high[i, j] = self.high[j, i] = d
            for a, b in ((i, j), (j, i)):
                low = np.maximum(self.low[a, :k], np.maximum(self.low[b, :k] - d, np.where(self.high[b, :k] < FAR, d - self.high[b, :k], 0)))
                high = np.minimum(self.high[a, :k], np.where(self.high[b, :k] < FAR, d + self.high[b, :k], FAR))
                self.low[a, :k] = self.low[:k, a] = low
                self.high[a, :k] = self.high[:k, a] = high

    def final(self, uid: int) -> int:
        """The number that a cluster has at the end: -1 if it was evicted, its heir's if it was merged."""
        while uid in self.merged:
            uid = self.merged[uid]
        return self.uid.index(uid) if uid >= 0 else -1

    def posterior(self, found: int) -> np.ndarray:
        """Belief after a frame: 0.9 on its cluster, the rest by frequency."""
        p = self.prob[: self.k].copy()
        p[found] = 0
        p = 0.1 * p / p.sum() if p.sum() > 0 else p
        p[found] = 0.9 if self.k > 1 else 1.0
        return p
