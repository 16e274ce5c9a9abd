"""Statistics of clustering results. Membership has frame_id, cluster_id and dist (to the anchor)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .metric import l2
from .ordered import lagged, running_sum, span_width


def sequential_distances(frames: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(f1, f2, d) for consecutive frames."""
    pairs = lagged(frames.select(*(by or []), "frame_id", "data"), {"frame_id": "f1", "data": "before"}, by=by)
    return pairs.where("f1 IS NOT NULL").select(*(by or []), "f1", F.col("frame_id").alias("f2"), l2(F.col("before"), F.col("data")).alias("d"))


def scan_statistics(frames: DataFrame) -> DataFrame:
    """min, p20, median, p80, max of consecutive distances (linear interpolation), and their number."""
    d = sequential_distances(frames)
    values = percentiles(d, "d", [0.0, 0.2, 0.5, 0.8, 1.0])
    names = ("d_min", "d_p20", "d_median", "d_p80", "d_max")
    return d.agg(*[F.lit(v).cast("double").alias(c) for c, v in zip(names, values, strict=True)], F.count("*").alias("n"))


def auto_radius(frames: DataFrame, factor: float) -> DataFrame:
    """factor times the median consecutive distance."""
    return scan_statistics(frames).select((F.col("d_median") * factor).alias("rlim"))


def cluster_counts(membership: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Frames of each cluster; with clusters given, empty ones have 0."""
    n = membership.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("n"))
    if clusters is None:
        return n
    return clusters.select("cluster_id").join(n, "cluster_id", "left").select("cluster_id", F.coalesce("n", F.lit(0)).alias("n"))


def cluster_radii(membership: DataFrame) -> DataFrame:
    return membership.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("n"), F.max("dist").alias("max_radius"))


def cluster_metrics(membership: DataFrame) -> DataFrame:
    """One row for a run: clusters, sizes, distances and the entropy of sizes among assigned frames."""
    each = membership.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("n"), F.sum(F.col("dist") * F.col("dist")).alias("sq"), F.max("dist").alias("far"))
    total = F.sum("n")
    return each.agg(
        F.count("*").alias("active_clusters"),
        total.alias("assigned"),
        F.sqrt(F.sum("sq") / total).alias("global_rms"),
        F.avg(F.sqrt(F.col("sq") / F.col("n"))).alias("mean_rms"),
        F.max("far").alias("max_dist"),
        F.min("n").alias("min_size"),
        F.max("n").alias("max_size"),
        F.avg("n").alias("mean_size"),
        (F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("entropy"),
    )


def cluster_entropy(membership: DataFrame) -> DataFrame:
    """Entropy with probabilities over all rows, assigned or not, and its share of log2(clusters)."""
    rows = membership.agg(F.count("*").alias("rows"))
    each = membership.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("n")).crossJoin(rows)
    p = F.col("n") / F.col("rows")
    one = each.agg(F.count("*").alias("k"), F.coalesce(F.sum(-p * F.log2(p)), F.lit(0.0)).alias("entropy"))
    return one.select("k", "entropy", F.when(F.col("k") > 1, F.col("entropy") / F.log2("k")).otherwise(0.0).alias("evenness"))


def lifetimes(membership: DataFrame) -> DataFrame:
    """Birth and death frames, span and duty (percent of the span) of each cluster."""
    each = membership.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("size"), F.min("frame_id").alias("birth_frame"), F.max("frame_id").alias("death_frame"))
    span = F.col("death_frame") - F.col("birth_frame") + 1
    return each.withColumns({"span": span, "duty": 100 * F.col("size") / span})


def transitions(membership: DataFrame, state: str = "cluster_id", order: str = "frame_id", by: list[str] | None = None) -> DataFrame:
    """(src, dst, n) over consecutive frames that both have a state (not null, not -1)."""
    pairs = lagged(membership.select(*(by or []), order, state), {state: "src"}, order, by).withColumnRenamed(state, "dst")
    return pairs.where("src IS NOT NULL AND dst IS NOT NULL AND string(src) <> '-1' AND string(dst) <> '-1'").groupBy("src", "dst").agg(F.count("*").alias("n"))


def dwell(moves: DataFrame) -> DataFrame:
    """Of each source state: probability to stay, and mean dwell 1 / (1 - p); null: stable."""
    stay = F.sum(F.when(F.col("src") == F.col("dst"), F.col("n")).otherwise(0))
    one = moves.groupBy("src").agg(F.sum("n").alias("total"), stay.alias("stay"))
    p = F.col("stay") / F.col("total")
    return one.select("src", "total", p.alias("p_stay"), F.when(F.col("stay") < F.col("total"), F.col("total") / (F.col("total") - F.col("stay"))).alias("dwell"))


def top_transitions(moves: DataFrame, rows: int, n: int = 5) -> DataFrame:
    """The n most frequent moves between different states; ties by source, then target."""
    return moves.where("src <> dst").orderBy(F.desc("n"), "src", "dst").limit(n).withColumn("pct", 100 * F.col("n") / rows)


def markov_matrix(membership: DataFrame, top: int, state: str = "cluster_id", order: str = "frame_id") -> DataFrame:
    """Row-normalised moves among the `top` most frequent states; other frames are left out first."""
    often = membership.groupBy(state).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), state).limit(top).select(state)
    moves = transitions(membership.join(F.broadcast(often), state, "left_semi"), state, order)
    return moves.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("src")))


def transition_graph(membership: DataFrame, top: int = 10, least: float = 0.05, state: str = "cluster_id", order: str = "frame_id") -> DataFrame:
    """Moves of the whole sequence among the `top` states, at least `least` of their source's moves."""
    often = membership.groupBy(state).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), state).limit(top).select(state)
    moves = transitions(membership, state, order).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("src")))
    moves = moves.join(F.broadcast(often.withColumnRenamed(state, "src")), "src", "left_semi").join(F.broadcast(often.withColumnRenamed(state, "dst")), "dst", "left_semi")
    return moves.where((F.col("p") >= least) & (F.col("src") != F.col("dst"))).select("src", "dst", "n", "p")


def anchor_distances(anchors: DataFrame) -> DataFrame:
    """(i, j, dist), i < j, of all anchors. Anchors are at most maxcl many, so all pairs are wanted."""
    a, b = anchors.alias("a"), anchors.alias("b")
    return a.join(b, F.col("a.cluster_id") < F.col("b.cluster_id")).select(
        F.col("a.cluster_id").alias("i"), F.col("b.cluster_id").alias("j"), l2(F.col("a.anchor"), F.col("b.anchor")).alias("dist")
    )


def topology(dcc: DataFrame, rlim: float) -> DataFrame:
    """Mean, least and greatest anchor distance with their pairs, and whether any is under rlim."""
    low, high = F.struct("dist", "i", "j"), F.struct(F.col("dist"), -F.col("i"), -F.col("j"))
    one = dcc.agg(F.avg("dist").alias("mean_dist"), F.min(low).alias("lo"), F.max(high).alias("hi"), F.count("*").alias("pairs"))
    return one.select(
        "pairs", "mean_dist", F.col("lo.dist").alias("min_dist"), F.col("lo.i").alias("min_i"), F.col("lo.j").alias("min_j"),
        F.col("hi.dist").alias("max_dist"), (-F.col("hi.col2")).alias("max_i"), (-F.col("hi.col3")).alias("max_j"),
        (F.col("lo.dist") < rlim).alias("too_close"),
    )


def spread(frames: DataFrame, membership: DataFrame, anchors: DataFrame) -> DataFrame:
    """Mean, greatest and standard deviation of the distances of a cluster's points to its anchor."""
    d = l2(F.col("data"), F.col("anchor"))
    joined = frames.select("frame_id", "data").join(membership.select("frame_id", "cluster_id"), "frame_id").join(anchors, "cluster_id")
    return joined.groupBy("cluster_id").agg(F.avg(d).alias("mean_dist"), F.max(d).alias("max_dist"), F.stddev_pop(d).alias("std_dist"))


def centroids(frames: DataFrame, membership: DataFrame) -> DataFrame:
    """Element-wise means of clusters: (cluster_id, mean)."""
    each = frames.select("frame_id", F.posexplode("data").alias("pos", "v")).join(membership.select("frame_id", "cluster_id").where("cluster_id >= 0"), "frame_id")
    means = each.groupBy("cluster_id", "pos").agg(F.avg("v").alias("m"))
    return means.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))


def cumulative_clusters(membership: DataFrame, order: str = "frame_id") -> DataFrame:
    """K(t): how many clusters have appeared up to each frame."""
    first = membership.where("cluster_id >= 0").groupBy("cluster_id").agg(F.min(order).alias(order)).select(order, F.lit(1).alias("_new"))
    return running_sum(membership.join(first, order, "left"), F.coalesce("_new", F.lit(0)), "k", order).drop("_new")


def rank_spectrum(membership: DataFrame, state: str = "cluster_id") -> DataFrame:
    """States by falling frequency with the cumulative percentage of frames."""
    n = membership.where(f"{state} IS NOT NULL").groupBy(state).agg(F.count("*").alias("n"))
    w = Window.orderBy(F.desc("n"), state)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    total = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(0))
    return n.select(state, "n", F.row_number().over(w).alias("rank"), (100 * F.sum("n").over(up) / F.sum("n").over(total)).alias("cum_pct"))


def first_members(membership: DataFrame) -> DataFrame:
    return membership.where("cluster_id >= 0").groupBy("cluster_id").agg(F.min("frame_id").alias("frame_id"))


def pattern_successors(membership: DataFrame, length: int, horizon: int, order: str = "frame_id") -> DataFrame:
    """For each frame, the states that followed earlier occurrences of its last `length` states.

    Occurrences start at most `horizon` frames back. Returns frame, successor and count.
    """
    ids = [f"_p{k}" for k in range(1, length + 1)]
    df = membership.select(order, "cluster_id")
    last, width = "cluster_id", span_width(df, order)
    for name in ids:
        df = lagged(df, {last: name}, order, width=width)
        last = name
    gram = df.where(F.col(ids[-1]).isNotNull()).select(order, "cluster_id", F.concat_ws(",", *[F.col(c) for c in ids]).alias("gram"))
    # Occurrences meet by stretch of `horizon` frames, the own and the one before: pairs grow with the input, not its square.
    stretch = F.floor(F.col(order) / horizon).cast("long")
    past = gram.select(F.col(order).alias("at"), F.col("cluster_id").alias("successor"), "gram", stretch.alias("stretch"))
    gram = gram.withColumn("stretch", F.explode(F.array(stretch, stretch - 1)))
    hits = gram.join(past, ["gram", "stretch"]).where((F.col("at") < F.col(order)) & (F.col("at") >= F.col(order) - horizon))
    return hits.groupBy(order, "successor").agg(F.count("*").alias("n"))


def voronoi(centres: DataFrame, side: int, low: float, high: float) -> DataFrame:
    """Nearest centre (cluster_id, x, y) of each point of a side x side grid; ties to the lowest id."""
    spark = centres.sparkSession
    step = (high - low) / (side - 1)
    grid = spark.range(side * side).select((F.col("id") % side).alias("gx"), F.floor(F.col("id") / side).alias("gy"))
    d = (F.col("gx") * step + low - F.col("x")) * (F.col("gx") * step + low - F.col("x")) + (F.col("gy") * step + low - F.col("y")) * (F.col("gy") * step + low - F.col("y"))
    return grid.join(F.broadcast(centres)).groupBy("gx", "gy").agg(F.min(F.struct(F.round(d, 9).alias("d"), "cluster_id")).alias("m")).select("gx", "gy", F.col("m.cluster_id").alias("cluster_id"))


def photocenter(images: DataFrame, width: int) -> DataFrame:
    """Flux and intensity-weighted centre of each image of rows of `width` pixels."""
    px = images.select("frame_id", F.posexplode("data").alias("pos", "v"))
    x, y = F.col("pos") % width, F.floor(F.col("pos") / width)
    flux = F.sum("v")
    return px.groupBy("frame_id").agg(flux.alias("flux"), (F.sum(F.col("v") * x) / flux).alias("x"), (F.sum(F.col("v") * y) / flux).alias("y"))


def unique_tuples(tuples: DataFrame, parts: str = "tuple") -> DataFrame:
    """Distinct joint states with their counts and last frames; tuples with a -1 are left out."""
    return tuples.where(~F.array_contains(parts, -1)).groupBy(parts).agg(F.count("*").alias("n"), F.max("frame_id").alias("last_active"))


def cross_tile_weights(tiles: DataFrame, decay: float, last_frame: int | None = None) -> DataFrame:
    """Co-occurrence of clusters of different tiles in a frame, weighted decay ** age (from the last frame, if none is given)."""
    if last_frame is None:
        last_frame = tiles.agg(F.max("frame_id")).first()[0]
    a, b = tiles.alias("a"), tiles.alias("b")
    pair = a.join(b, (F.col("a.frame_id") == F.col("b.frame_id")) & (F.col("a.tile_id") != F.col("b.tile_id")))
    return pair.groupBy(
        F.col("a.tile_id").alias("src_tile"), F.col("a.cluster_id").alias("src_cl"), F.col("b.tile_id").alias("dst_tile"), F.col("b.cluster_id").alias("dst_cl")
    ).agg(F.sum(F.pow(F.lit(decay), F.lit(last_frame) - F.col("a.frame_id"))).alias("weight"))


def probe_statistics(evals: DataFrame, rlim: float) -> tuple[DataFrame, DataFrame]:
    """From membership with evals: frames by number of probes, and failed probes of each cluster."""
    by_count = evals.groupBy(F.size("evals").alias("n_evals")).agg(F.count("*").alias("frames"), F.sum("pruned").alias("pruned"))
    each = evals.select(F.explode("evals").alias("e")).where(F.col("e.dist") >= rlim)
    return by_count, each.groupBy(F.col("e.cluster_id").alias("cluster_id")).agg(F.count("*").alias("failed"))


def pruned_by_depth(evals: DataFrame) -> DataFrame:
    """(depth, probes, pruned_fraction): the mean share of clusters excluded before the first, second, ... probe of a frame."""
    each = evals.select("is_new", F.size("evals").alias("n"), F.posexplode("evals").alias("depth", "e")).where("NOT (is_new AND depth = n - 1)")
    return each.groupBy("depth").agg(F.count("*").alias("probes"), F.avg("e.excluded").alias("pruned_fraction"))


def centroid_distances(means: DataFrame, counts: DataFrame, top: int = 40) -> DataFrame:
    """(i, j, dist) between the centroids of the `top` largest clusters, in both orders and with the diagonal."""
    often = counts.orderBy(F.desc("n"), "cluster_id").limit(top).select("cluster_id")
    few = means.join(F.broadcast(often), "cluster_id")
    a, b = few.alias("a"), few.alias("b")
    return a.crossJoin(b).select(F.col("a.cluster_id").alias("i"), F.col("b.cluster_id").alias("j"), l2(F.col("a.mean"), F.col("b.mean")).alias("dist"))


#: Up to so many values, one aggregation buffer holds them all; beyond, they are counted into bins.
EXACT_ROWS, BINS = 1_000_000, 4096


def percentiles(df: DataFrame, column: str, at: list[float]) -> list[float | None]:
    """Exact percentiles by linear interpolation.

    Of many values, bins around each rank are counted and narrowed until few values are left; a pass
    returns BINS counts, whatever the size of the table.
    """
    low, high, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n:
        return [None] * len(at)
    if n <= EXACT_ROWS:
        return list(df.agg(F.percentile(column, F.array(*[F.lit(p) for p in at])).alias("p")).first()[0])
    found: dict[int, float] = {}
    for rank in sorted({k for p in at for k in (int(p * (n - 1)), min(n - 1, int(p * (n - 1)) + 1))}):
        lo, hi, before = float(low), float(high), 0
        while rank not in found:
            v = F.col(column)
            inside = df.where((v >= lo) & (v <= hi))
            width = (hi - lo) / BINS
            count = inside.count()
            if count <= EXACT_ROWS or width <= 0 or lo + width <= lo:
                found[rank] = float(inside.agg(F.sort_array(F.collect_list(column)).alias("v")).select(F.get("v", F.lit(rank - before))).first()[0]) if count <= EXACT_ROWS else lo
                break
            part = F.least(F.lit(BINS - 1), F.floor((v - lo) / width)).cast("int")
            bins = {r["b"]: (r["n"], r["least"], r["most"]) for r in inside.groupBy(part.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("least"), F.max(column).alias("most")).collect()}
            for b in sorted(bins):
                size, least, most = bins[b]
                if rank < before + size:
                    lo, hi = float(least), float(most)
                    break
                before += size
            if lo == hi:
                found[rank] = lo
    out = []
    for p in at:
        k, part = int(p * (n - 1)), p * (n - 1) - int(p * (n - 1))
        one, two = found[k], found[min(n - 1, k + 1)]
        out.append(one + part * (two - one))
    return out


def normalised(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99, floor: float = 0.05) -> DataFrame:
    """column stretched so that its low and high percentiles become floor and 1, and clipped."""
    least, most = percentiles(df, column, [low, high])
    if least is None:
        return df.withColumn(f"{column}_norm", F.lit(None).cast("double"))
    v = F.lit(floor) + (1 - floor) * (F.col(column) - F.lit(least)) / F.lit(most - least)
    return df.withColumn(f"{column}_norm", F.least(F.lit(1.0), F.greatest(F.lit(floor), v)))
