"""Tiles: parts of an image that are clustered on their own, and joint states of all tiles."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from .cluster import MEMBER, member_batch
from .leader import matrix
from .stepper import FrameStepper, Step, Stopped

Tiles = dict[int, list[int]]


def grid_tiles(width: int, height: int, spec: str) -> Tiles:
    """Pixels of each tile of a grid of columns x rows; the last ones take the remainder.

    A number n alone is a square grid of side ceil(sqrt(n)).
    """
    cols, rows = (int(v) for v in spec.lower().split("x")) if "x" in spec.lower() else (math.ceil(math.sqrt(int(spec))),) * 2
    if not (1 <= cols <= width and 1 <= rows <= height):
        raise ValueError("a grid needs at least a pixel for each tile")
    tiles: Tiles = {t: [] for t in range(cols * rows)}
    for p in range(width * height):
        x, y = p % width, p // width
        tiles[min(x // (width // cols), cols - 1) + cols * min(y // (height // rows), rows - 1)].append(p)
    return tiles


def axis_tiles(dims: int) -> Tiles:
    """Each coordinate a tile."""
    return {m: [m] for m in range(dims)}


def map_tiles(tile_of_pixel: list[int]) -> Tiles:
    """From a tile id for each pixel; ids are 0, 1, ... without gaps needed."""
    if any(t < 0 for t in tile_of_pixel):
        raise ValueError("tile ids have to be at least 0")
    tiles: Tiles = {t: [] for t in range(max(tile_of_pixel, default=-1) + 1)}
    for p, t in enumerate(tile_of_pixel):
        tiles[t].append(p)
    return tiles


def scatter(frames: DataFrame, tiles: Tiles) -> DataFrame:
    """(frame_id, tile_id, data): each frame's values of each tile, in pixel order; no shuffle."""
    parts = [
        F.struct(F.lit(t).alias("tile_id"), F.transform(F.array(*[F.lit(p) for p in px]), lambda p: F.get(F.col("data"), p)).alias("data"))
        for t, px in tiles.items()
    ]
    return frames.select("frame_id", F.inline(F.array(*parts)))


def tuples(states: DataFrame) -> DataFrame:
    """(frame_id, tuple): cluster ids of all tiles in order, from (frame_id, tile_id, cluster_id)."""
    each = F.array_sort(F.collect_list(F.struct("tile_id", "cluster_id")))
    return states.groupBy("frame_id").agg(F.transform(each, lambda s: s["cluster_id"].cast("long")).alias("tuple"))


class History:
    """The last joint states of a stream, and where each tile had each cluster: an inverted index."""

    def __init__(self, tiles: int, keep: int):
        self.tiles, self.keep = tiles, keep
        self.clear()

    def clear(self) -> None:
        self.n, self.low, self._rows = 0, 0, np.zeros((64, self.tiles), np.int64)
        self._places: dict[tuple[int, int], list[int]] = {}

    def append(self, row: Iterable[int]) -> None:
        if self.n - self.low == len(self._rows):
            gone = max(0, self.n - self.keep - self.low)
            rows = np.zeros((max(64, 2 * (self.n - self.low - gone)), self.tiles), np.int64)
            rows[: self.n - self.low - gone] = self._rows[gone : self.n - self.low]
            self._rows, self.low = rows, self.low + gone
            self._places = {k: left for k, v in self._places.items() if (left := v[bisect.bisect_left(v, self.low) :])}
        self._rows[self.n - self.low] = row
        for m, u in enumerate(row):
            self._places.setdefault((m, int(u)), []).append(self.n)
        self.n += 1

    def extend(self, rows: Iterable[Iterable[int]]) -> None:
        for row in rows:
            self.append(row)

    def __len__(self) -> int:
        return self.n

    def at(self, places: np.ndarray) -> np.ndarray:
        """The states at these places, which have to be among the last `keep`."""
        return self._rows[places - self.low]

    def places(self, tile: int, cluster: int, start: int) -> list[int]:
        """Where a tile had a cluster, from `start` on, in order."""
        found = self._places.get((tile, cluster), [])
        return found[bisect.bisect_left(found, start) :]


class JointStepper:
    """All tiles of one stream, frame by frame, with joint prediction, second pass and cross-tile priors.

    Tiles are taken in order of their ids, so results don't depend on timing.
    """

    #: Below this share of its tile's frames, the rarest of the last clusters makes a search of the whole
    #: horizon worth its while; else SHORT states are searched. Exponents over FAR count as no match.
    RARE, SHORT, FAR = 0.08, 100, 10.0

    def __init__(self, config: EngineConfig, tiles: Tiles, overrides: dict[int, EngineConfig] | None = None):
        self.c, self.tiles = config, {t: np.array(px) for t, px in tiles.items()}
        self.steppers = {t: FrameStepper((overrides or {}).get(t, config)) for t in tiles}
        length, horizon, _ = config.pred or (0, 0, 0)
        self.window = History(len(tiles), max(config.retrieval_window, horizon) + length + 1)
        self.cpt: dict[tuple[int, int, int, int], float] = {}
        self.scale = 1.0

    def _scores(self, tile: int, known: dict[int, int]) -> np.ndarray | None:
        """Weights of a tile's clusters from past tuples that agree with all known tiles and follow a tuple equal to the last one.

        The rarest of the clusters that have to agree gives the places to look at.
        """
        s, order, past = self.steppers[tile], list(self.tiles), self.window
        start = max(past.low, len(past) - self.c.retrieval_window)
        if not len(past):
            return None
        last = past.at(np.array([len(past) - 1]))[0]
        lists = [past.places(order.index(t), c, start) for t, c in known.items()]
        lists += [[p + 1 for p in past.places(m, int(u), max(start - 1, past.low)) if p + 1 < len(past)] + [0] * (start == 0) for m, u in enumerate(last)]
        at = np.array(sorted(set(min(lists, key=len))), np.int64)
        rows = past.at(at)
        for t, c in known.items():
            at, rows = at[rows[:, order.index(t)] == c], rows[rows[:, order.index(t)] == c]
        before = past.at(np.maximum(at - 1, past.low))
        rows = rows[(at == 0) | (before == last).all(axis=1)]
        weight = np.zeros(s.k)
        for u, n in zip(*np.unique(rows[:, order.index(tile)], return_counts=True), strict=True):
            if u in s.uid:
                weight[s.uid.index(u)] = n
        if not weight.any():
            return None
        return (weight + 0.01) / (weight.sum() + 0.01 * s.k)

    def _cross(self, tile: int, known: dict[int, int]) -> np.ndarray | None:
        s = self.steppers[tile]
        p = np.ones(s.k)
        for t, c in known.items():
            row = np.array([self.cpt.get((t, c, tile, u), 0.0) for u in s.uid])
            if row.sum() > 0:
                p *= (row + 0.01) / (row.sum() + 0.01 * s.k)
        return p / p.sum() if len(known) and p.sum() > 0 else None

    def _predicted(self) -> dict[int, tuple[np.ndarray, list[int]]]:
        """For each tile: priors of its clusters and the likeliest ones, from what followed stretches of states like the last.

        A stretch of L states weighs exp(-e / (0.632 L)), where e sums the distances of its anchors to
        the last stretch's in radii, over all tiles; older states count less, by 1 - 1 / L a step. Only
        stretches are looked at whose last state is near in the tile with the rarest cluster: the index
        gives their places. Too short a history gives uniform priors.
        """
        length, horizon, n = self.c.pred
        past, order, steppers = self.window, list(self.tiles), list(self.steppers.values())
        if len(past) < length:
            return {t: (np.full(s.k, 1 / s.k), []) for t, s in self.steppers.items() if s.k}
        number = [np.full(s.next_uid + 1, -1) for s in steppers]
        for own, s in zip(number, steppers, strict=True):
            own[s.uid] = np.arange(s.k)
        recent = past.at(np.arange(len(past) - length, len(past)))
        recent = np.stack([number[m][recent[:, m]] for m in range(len(order))], axis=1)
        share = [s.prob[i] / s.prob[: s.k].sum() if i >= 0 else 0.0 for s, i in zip(steppers, recent[-1], strict=True)]
        best = int(np.argmin([v if i >= 0 else 2.0 for v, i in zip(share, recent[-1], strict=True)]))
        horizon = self.SHORT if min(share) > self.RARE else horizon
        stop, start = len(past) - length, max(length, past.low + length, min(len(past) - horizon, len(past) - length))
        at = np.arange(start, stop)
        if recent[-1, best] >= 0 and len(at):
            s = steppers[best]
            near = np.flatnonzero(s.high[recent[-1, best], : s.k] <= 2 * s.c.rlim)
            at = np.array(sorted(p + 1 for i in near for p in past.places(best, s.uid[i], start - 1) if p + 1 < stop), np.int64)
        exponent = np.zeros(len(at))
        for j in range(length):
            row, each = past.at(at - length + j) if len(at) else np.zeros((0, len(order)), np.int64), np.zeros(len(at))
            for m, s in enumerate(steppers):
                own = number[m][row[:, m]]
                if recent[j, m] >= 0 and s.k:
                    far = s.high[recent[j, m], np.maximum(own, 0)]
                    each += np.where(own >= 0, far / s.c.rlim, 0.0)
            exponent += (1 - 1 / length) ** (length - 1 - j) * each
        score = np.where(exponent <= self.FAR, np.exp(-exponent / (length * (1 - math.exp(-1)))), 0.0)
        after, out = past.at(at) if len(at) else np.zeros((0, len(order)), np.int64), {}
        for m, (t, s) in enumerate(self.steppers.items()):
            if not s.k:
                continue
            own = number[m][after[:, m]]
            total = np.bincount(own[own >= 0], score[own >= 0], s.k)
            listed = np.lexsort((np.arange(s.k), -total))[:n]
            out[t] = ((total + 0.01) / (total + 0.01).sum(), listed.tolist())
        return out

    def step(self, x: np.ndarray) -> dict[int, Step]:
        out: dict[int, Step] = {}
        known: dict[int, int] = {}
        ahead = self._predicted() if self.c.pred else {}
        for t, px in self.tiles.items():
            s = self.steppers[t]
            s.given, s.joint = ahead.get(t, (None, []))
            s.boost = (self._cross(t, known) if self.c.xtile == 1 else self._scores(t, known)) if self.c.xtile and s.k else None
            out[t] = s.step(x[px])
            known[t] = out[t].cluster
        if self.c.pass2:
            self._second_pass(x, out)
        row = tuple(out[t].cluster for t in self.tiles)
        self.window.append(row)
        # weights are kept divided by a common factor, so that decay touches only the new pairs
        self.scale *= self.c.xtile_decay
        if self.scale < 1e-100:
            self.cpt = {k: v * self.scale for k, v in self.cpt.items()}
            self.scale = 1.0
        for a, ca in zip(self.tiles, row, strict=True):
            for b, cb in zip(self.tiles, row, strict=True):
                if a != b:
                    self.cpt[a, ca, b, cb] = self.cpt.get((a, ca, b, cb), 0.0) + 1 / self.scale
        return out

    def _second_pass(self, x: np.ndarray, out: dict[int, Step]) -> None:
        """Give a tile the cluster that the joint state makes likeliest, if that is within rlim too."""
        first = {t: o.cluster for t, o in out.items()}
        for t, o in out.items():
            s = self.steppers[t]
            weight = self._scores(t, {u: c for u, c in first.items() if u != t})
            if o.new or weight is None or o.cluster not in s.uid:
                continue
            own = s.uid.index(o.cluster)
            best = int(np.argmax(s.posterior(own) * weight))
            if best != own:
                d = s._distance(x[self.tiles[t]], s.anchors[best], "dfc")
                if d <= s.c.rlim:
                    s.history[-1] = (best, d)
                    s.prev = best
                    o.cluster, o.dist = s.uid[best], d
                    o.evals.append((s.uid[best], d))


def fit_tiles(frames: DataFrame, config: EngineConfig, tiles: Tiles, overrides: dict[int, EngineConfig] | None = None, stream: str | None = None) -> DataFrame:
    """Membership with tile_id: MEMBER's columns for each frame and tile.

    Without joint options every (stream, tile) is a group of its own, spread over tasks. With the
    second pass, cross-tile priors or joint prediction, the tiles of a stream wait for each other
    at every frame, and a stream is one group.
    """
    joint = config.pass2 or config.xtile or config.pred
    from .cluster import fit

    by = [stream] if stream else []
    keyed = frames.select(*by, "frame_id", "data")
    if not joint and not overrides:
        parts = [
            F.struct(F.lit(t).alias("tile_id"), F.transform(F.array(*[F.lit(p) for p in px]), lambda p: F.get(F.col("data"), p)).alias("data"))
            for t, px in tiles.items()
        ]
        return fit(keyed.select(*by, "frame_id", F.inline(F.array(*parts))), config, [*by, "tile_id"])
    key = F.col(stream).cast("string") if stream else F.lit("")

    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(group)).sort_by("frame_id")
        ids, x = table.column("frame_id").to_pylist(), matrix(table.column("data"))
        joint_stepper, rows = JointStepper(config, tiles, overrides), []
        for i, row in zip(ids, x, strict=True):
            try:
                rows += [(i, t, o) for t, o in joint_stepper.step(row).items()]
            except Stopped:
                break
        final = {t: s.final for t, s in joint_stepper.steppers.items()}
        batch = member_batch([(i, o, final[t](o.cluster)) for i, t, o in rows])
        yield pa.RecordBatch.from_arrays(
            [pa.array([table.column("stream")[0].as_py()] * len(rows), pa.string()), pa.array([t for _, t, _ in rows], pa.int32()), *batch.columns],
            names=["stream", "tile_id", *batch.schema.names],
        )

    def whole(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(run(iter(table.to_batches()))))

    out = keyed.select(key.alias("stream"), "frame_id", "data").groupBy("stream").applyInArrow(whole, f"stream string, tile_id int, {MEMBER}")
    return out.withColumnRenamed("stream", stream) if stream else out.drop("stream")
