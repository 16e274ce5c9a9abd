"""Ordered clustering of whole sequences: one group for each stream, in order of frame_id."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import analysis as A
from ..functions.metric import l2
from .leader import matrix
from .stepper import FrameStepper, Step, Stopped

EVALS = "array<struct<cluster_id:bigint,dist:double,prob:double,gprob:double,excluded:double>>"
TRACE = "array<struct<event:string,cluster_id:bigint,value:double>>"
MEMBER = f"frame_id long, cluster_id long, dist double, uid long, is_new boolean, predicted boolean, hit boolean, pruned long, entropy double, evals {EVALS}, trace {TRACE}"


#: What a new cluster's own entry in evals has: it was not probed.
_CREATED = (0.0, 0.0, 1.0)


def member_batch(rows: list[tuple[int, Step, int]]) -> pa.RecordBatch:
    """Rows (frame, step, final cluster) with the columns of MEMBER."""
    probe = pa.list_(pa.struct([("cluster_id", pa.int64()), *[(c, pa.float64()) for c in ("dist", "prob", "gprob", "excluded")]]))
    event = pa.list_(pa.struct([("event", pa.string()), ("cluster_id", pa.int64()), ("value", pa.float64())]))
    steps = [s for _, s, _ in rows]
    offsets = pa.array(accumulate((len(s.evals) for s in steps), initial=0), pa.int32())
    pairs = list(chain.from_iterable(s.evals for s in steps))
    beliefs = list(chain.from_iterable((*s.probes, *[_CREATED] * (len(s.evals) - len(s.probes))) for s in steps))
    evals = [pa.array([i for i, _ in pairs], pa.int64()), *(pa.array([v[k] for v in of], pa.float64()) for of, k in ((pairs, 1), (beliefs, 0), (beliefs, 1), (beliefs, 2)))]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, _, _ in rows], pa.int64()), pa.array([c for _, _, c in rows], pa.int64()), pa.array([s.dist for s in steps], pa.float64()),
            pa.array([s.cluster for s in steps], pa.int64()), pa.array([s.new for s in steps], pa.bool_()), pa.array([s.predicted for s in steps], pa.bool_()),
            pa.array([s.hit for s in steps], pa.bool_()), pa.array([s.pruned for s in steps], pa.int64()), pa.array([s.entropy for s in steps], pa.float64()),
            pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(evals, fields=list(probe.value_type)), probe),
            pa.array([[{"event": e, "cluster_id": c, "value": v} for e, c, v in s.trace] for s in steps], event),
        ],
        names=["frame_id", "cluster_id", "dist", "uid", "is_new", "predicted", "hit", "pruned", "entropy", "evals", "trace"],
    )


#: Steps that a task holds before it passes them on.
STEPS = 2000


def fit(frames: DataFrame, config: EngineConfig, by: list[str] | None = None) -> DataFrame:
    """Membership of every frame (MEMBER's columns), in the mode that config asks for.

    by: keys of independent streams, which run in parallel; a stream is inherently sequential and is
    one task, whatever its length (leader_anchors finds the same anchors of one long stream in
    parallel). Streams are sorted by Spark, which spills, and go through a task batch by batch; only
    the strategies `discard` and `merge` hold a stream's steps, as a cluster's number is known at the
    end. Clusters evicted later are -1, merged ones have the number of their heir; evals and uid keep
    creation numbers. With the strategy `stop`, the run of a stream ends where maxcl is reached.
    Frames from maxim on are left out, and so are null vectors.
    """
    by = by or []
    if config.auto_factor:
        if by:
            raise ValueError("an automatic radius needs one sequence")
        config = config.with_radius(A.auto_radius(frames, config.auto_factor).first()[0])
    rows = frames.where((F.col("frame_id") < config.maxim) & F.col("data").isNotNull()).select(*by, "frame_id", "data")
    kinds = dict(rows.dtypes)
    held_back = not config.unlimited and config.maxcl_strategy != "stop"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stepper, key, stopped, steps = None, None, False, []

        def made() -> pa.RecordBatch:
            final = {u: stepper.final(u) for u in {s.cluster for _, s in steps}}
            batch = member_batch([(i, s, final[s.cluster]) for i, s in steps])
            keys = [pa.array([v] * len(steps), t) for v, t in zip(key, key_types, strict=True)]
            return pa.RecordBatch.from_arrays([*keys, *batch.columns], names=[*by, *batch.schema.names])

        for batch in batches:
            if not batch.num_rows:
                continue
            key_types = [batch.schema.field(b).type for b in by]
            owners = list(zip(*[batch.column(b).to_pylist() for b in by], strict=True)) if by else [()] * batch.num_rows
            ids, cut = batch.column("frame_id").to_pylist(), [k for k in range(batch.num_rows) if not k or owners[k] != owners[k - 1]]
            # vectors have one length in a stream, not in all streams of a task
            for a, b in zip(cut, [*cut[1:], batch.num_rows], strict=True):
                if stepper is None or owners[a] != key:
                    if steps:
                        yield made()
                    stepper, key, stopped, steps = FrameStepper(config), owners[a], False, []
                for i, x in zip(ids[a:b], matrix(batch.column("data").slice(a, b - a)), strict=True):
                    if stopped:
                        break
                    try:
                        steps.append((i, stepper.step(x)))
                    except Stopped:
                        stopped = True
                    if len(steps) >= STEPS and not held_back:
                        yield made()
                        steps = []
        if steps:
            yield made()

    if by:
        streams = rows.repartition(*by).sortWithinPartitions(*by, "frame_id")
    else:
        streams = rows.repartition(1).sortWithinPartitions("frame_id")
    return streams.mapInArrow(run, ", ".join([*(f"`{b}` {kinds[b]}" for b in by), MEMBER]))


@dataclass
class Model:
    """Results of a fit: membership, and the tables that follow from it."""

    frames: DataFrame
    membership: DataFrame
    config: EngineConfig

    def anchors(self) -> DataFrame:
        """(cluster_id, anchor_id, anchor): the first member of each cluster that is left."""
        first = self.membership.where("cluster_id >= 0").groupBy("cluster_id").agg(F.min("uid").alias("uid"))
        new = self.membership.where("is_new").select(F.col("uid"), F.col("frame_id").alias("anchor_id"))
        return first.join(new, "uid").join(self.frames.select(F.col("frame_id").alias("anchor_id"), F.col("data").alias("anchor")), "anchor_id").select("cluster_id", "anchor_id", "anchor")

    def counts(self) -> DataFrame:
        return A.cluster_counts(self.membership)

    def radii(self) -> DataFrame:
        return A.cluster_radii(self.membership)

    def transitions(self) -> DataFrame:
        return A.transitions(self.membership)

    def dcc(self) -> DataFrame:
        return A.anchor_distances(self.anchors())

    def metrics(self) -> DataFrame:
        return A.cluster_metrics(self.membership)

    def all_distances(self) -> DataFrame:
        """Every measured distance: frame_id, other_id (the anchor's frame), dist, ratio (dist / rlim), cluster_id, prob, gprob.

        cluster_id is a creation number, -1 for a new anchor against the older ones, which the dense
        mode measures unless a probe has; prob and gprob belong to probes.
        """
        r = self.config.rlim
        new = self.membership.where("is_new").select(F.col("uid").alias("cluster_id"), F.col("frame_id").alias("other_id"))
        probes = self.membership.select("frame_id", "is_new", F.inline("evals")).where("NOT (is_new AND excluded = 1 AND prob = 0)")
        probes = probes.join(new, "cluster_id").select("frame_id", "other_id", "dist", "cluster_id", "prob", "gprob")
        if not self.config.sparse_dcc:
            at = new.join(self.frames.select(F.col("frame_id").alias("other_id"), "data"), "other_id")
            one, two = at.alias("one"), at.alias("two")
            between = one.join(two, F.col("one.cluster_id") > F.col("two.cluster_id")).select(
                F.col("one.other_id").alias("frame_id"), F.col("two.other_id").alias("other_id"), l2(F.col("one.data"), F.col("two.data")).alias("dist")
            )
            between = between.join(probes.select("frame_id", "other_id"), ["frame_id", "other_id"], "left_anti")
            probes = probes.unionByName(between.select("*", F.lit(-1).cast("long").alias("cluster_id"), F.lit(0.0).alias("prob"), F.lit(0.0).alias("gprob")))
        return probes.withColumn("ratio", F.col("dist") / r if r > 0 else F.lit(-1.0))

    def discarded(self) -> DataFrame:
        """Frames whose cluster was evicted."""
        return self.membership.where("cluster_id < 0").select("frame_id", "uid")

    def telemetry(self) -> DataFrame:
        """One row of run counters."""
        probes = F.size("evals") - F.col("is_new").cast("int")
        return self.membership.agg(
            F.count("*").alias("frames"), F.sum(F.col("is_new").cast("long")).alias("clusters_made"), F.sum(probes).alias("sample_distances"),
            F.sum("pruned").alias("pruned"), F.sum(F.col("predicted").cast("long")).alias("predictions"), F.sum(F.col("hit").cast("long")).alias("hits"),
            F.sum("entropy").alias("entropy_sum"), F.max("entropy").alias("entropy_max"),
        )

    def clustered(self) -> DataFrame:
        """Frames beside their clusters, in the order of the clustered file."""
        return self.frames.select("frame_id", "data").join(self.membership.select("frame_id", "cluster_id"), "frame_id")


def cluster(frames: DataFrame, config: EngineConfig) -> Model:
    if config.auto_factor:
        config = config.with_radius(A.auto_radius(frames, config.auto_factor).first()[0])
    return Model(frames, fit(frames, config), config)


def merge_join(points: DataFrame, membership: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A clustered table made again from points and membership, and its anchors (first members)."""
    both = points.join(membership.select("frame_id", "cluster_id"), "frame_id")
    return both, both.where("cluster_id >= 0").groupBy("cluster_id").agg(F.min_by("data", "frame_id").alias("anchor"))


