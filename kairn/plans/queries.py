"""The library's queries over the test tables, each with SQL for an independent engine where it can say it.

Frames: `embeddings` by vec_id; ordered states: `events` by event_id; low-dimensional points: `part`
and `lineitem`. Derived doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import analysis as A
from ..functions import generators as G
from ..functions import metric as M
from ..operators import leader as L
from ..operators import tiles as TL
from ..operators.cluster import cluster, fit
from ..operators.embed import embed, tune
from ..operators.knn import Search, knn, knn_brute, knn_telemetry, padded
from ..sources.tables import column_frames, first_frames, vector_frames

RLIM = 1.2
#: No limit on frames or clusters: queries take the whole table.
WHOLE = {"maxim": 2**62, "unlimited": True}
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, d: str) -> DataFrame:
    return vector_frames(table(spark, d, "embeddings"), "vec_id", "embedding")


def labelled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frames, membership by label with the distance to the first member, and those anchors."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("frame_id"), M.doubles("embedding").alias("data"), F.col("label").cast("long").alias("cluster_id"))
    anchors = e.groupBy("cluster_id").agg(F.min_by("data", "frame_id").alias("anchor"))
    member = e.join(F.broadcast(anchors), "cluster_id").select("frame_id", "cluster_id", M.l2(F.col("data"), F.col("anchor")).alias("dist"))
    return e.select("frame_id", "data"), member, anchors


def _exploded(df: DataFrame) -> DataFrame:
    """The column data as rows (pos, v)."""
    rest = [c for c in df.columns if c != "data"]
    return rounded(df.select(*rest, F.posexplode("data").alias("pos", "v")), "v").withColumn("pos", F.col("pos").cast("long"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


_E = "SELECT vec_id AS frame_id, embedding::DOUBLE[] AS data, label AS cluster_id FROM embeddings"
_LEAD = f"""
WITH RECURSIVE near AS (SELECT b.vec_id AS i, list(a.vec_id) AS js FROM embeddings a JOIN embeddings b
  ON a.vec_id < b.vec_id WHERE list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) < {RLIM} GROUP BY 1),
seq AS (SELECT e.vec_id AS i, coalesce(n.js, []) AS js FROM embeddings e LEFT JOIN near n ON n.i = e.vec_id),
run(i, anchors) AS (SELECT 0::BIGINT, [0::BIGINT] UNION ALL
  SELECT s.i, CASE WHEN list_has_any(r.anchors, s.js) THEN r.anchors ELSE list_append(r.anchors, s.i) END
  FROM run r JOIN seq s ON s.i = r.i + 1),
lead_ids AS (SELECT unnest(anchors) AS a FROM run WHERE i = (SELECT max(i) FROM run)),
anc AS (SELECT row_number() OVER (ORDER BY a) - 1 AS cluster_id, a AS anchor_id, e.embedding::DOUBLE[] AS anchor
        FROM lead_ids JOIN embeddings e ON e.vec_id = a),
dist AS (SELECT e.vec_id AS frame_id, c.cluster_id, list_distance(e.embedding::DOUBLE[], c.anchor) AS d FROM embeddings e, anc c),
near1 AS (SELECT frame_id, arg_min(cluster_id, (d, cluster_id)) AS cluster_id, min(d) AS dist FROM dist GROUP BY 1)
"""
_LABELLED = f"""
WITH e AS ({_E}), anc AS (SELECT cluster_id, arg_min(data, frame_id) AS anchor FROM e GROUP BY 1),
member AS (SELECT frame_id, cluster_id, list_distance(data, anchor) AS dist FROM e JOIN anc USING (cluster_id))
"""


# Sequences and radius


@query(f"""WITH e AS ({_E}), p AS (SELECT frame_id, data, lag(frame_id) OVER (ORDER BY frame_id) AS f1, lag(data) OVER (ORDER BY frame_id) AS b FROM e)
SELECT f1, frame_id AS f2, round(list_distance(b, data), 6) AS d FROM p WHERE f1 IS NOT NULL""")
def seq_distance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.sequential_distances(frames(spark, d)), "d")


_SCAN = f"""WITH e AS ({_E}), p AS (SELECT data, lag(data) OVER (ORDER BY frame_id) AS b FROM e),
s AS (SELECT list_distance(b, data) AS d FROM p WHERE b IS NOT NULL)"""


@query(f"""{_SCAN} SELECT round(min(d), 6) AS d_min, round(quantile_cont(d, 0.2), 6) AS d_p20, round(quantile_cont(d, 0.5), 6) AS d_median,
round(quantile_cont(d, 0.8), 6) AS d_p80, round(max(d), 6) AS d_max, count(*) AS n FROM s""")
def scandist_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.scan_statistics(frames(spark, d)), "d_min", "d_p20", "d_median", "d_p80", "d_max")


@query(f"{_SCAN} SELECT round(0.85 * quantile_cont(d, 0.5), 6) AS rlim FROM s")
def auto_rlim(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.auto_radius(frames(spark, d), 0.85), "rlim")


@query("SELECT vec_id AS frame_id, generate_subscripts(embedding, 1) - 1 AS pos, round(unnest(embedding::DOUBLE[]), 6) AS v FROM embeddings WHERE vec_id < 100")
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(first_frames(frames(spark, d), 100))


# Leader clustering


@query(f"{_LEAD} SELECT cluster_id, anchor_id FROM anc")
def leader_anchors(spark: SparkSession, d: str) -> DataFrame:
    return L.leader_anchors(frames(spark, d), RLIM).select("cluster_id", "anchor_id")


def _nearest(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = frames(spark, d)
    anchors = L.leader_anchors(f, RLIM)
    return f, anchors, L.assign(f, anchors)


@query(f"{_LEAD} SELECT frame_id, cluster_id, round(dist, 6) AS dist FROM near1")
def leader_nearest_assign(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_nearest(spark, d)[2], "dist")


@query(f"{_LEAD} SELECT frame_id, min(cluster_id) AS cluster_id, round(arg_min(d, cluster_id), 6) AS dist FROM dist WHERE d < {RLIM} GROUP BY 1")
def leader_first_assign(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d)
    return rounded(L.assign(f, L.leader_anchors(f, RLIM), RLIM, "first"), "dist")


@query(f"{_LEAD} SELECT cluster_id, count(frame_id) AS n FROM anc LEFT JOIN near1 USING (cluster_id) GROUP BY 1")
def leader_counts(spark: SparkSession, d: str) -> DataFrame:
    _, anchors, member = _nearest(spark, d)
    return A.cluster_counts(member, anchors)


@query(f"{_LEAD} SELECT cluster_id, count(*) AS n, round(max(dist), 6) AS max_radius FROM near1 GROUP BY 1")
def leader_radii(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.cluster_radii(_nearest(spark, d)[2]), "max_radius")


@query(f"{_LEAD} SELECT a.cluster_id AS i, b.cluster_id AS j, round(list_distance(a.anchor, b.anchor), 6) AS dist FROM anc a JOIN anc b ON a.cluster_id < b.cluster_id")
def dcc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.anchor_distances(_nearest(spark, d)[1]), "dist")


@query(f"""{_LEAD}, p AS (SELECT a.cluster_id AS i, b.cluster_id AS j, list_distance(a.anchor, b.anchor) AS dist FROM anc a JOIN anc b ON a.cluster_id < b.cluster_id)
SELECT count(*) AS pairs, round(avg(dist), 6) AS mean_dist, round(min(dist), 6) AS min_dist, arg_min(i, (dist, i, j)) AS min_i, arg_min(j, (dist, i, j)) AS min_j,
round(max(dist), 6) AS max_dist, arg_max(i, (dist, -i, -j)) AS max_i, arg_max(j, (dist, -i, -j)) AS max_j, min(dist) < {RLIM} AS too_close FROM p""")
def dcc_topology(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.topology(A.anchor_distances(_nearest(spark, d)[1]), RLIM), "mean_dist", "min_dist", "max_dist")


# Neighbours


def _knn_sql(rule: str, k: int) -> str:
    return f"""WITH e AS ({_E}), p AS (SELECT q.frame_id AS query_id, c.frame_id AS neighbor_id, list_distance(q.data, c.data) AS d
    FROM e q JOIN e c ON c.frame_id <> q.frame_id WHERE {rule}),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, neighbor_id) AS rank FROM p)
    SELECT query_id, rank, neighbor_id, round(d, 6) AS dist FROM r WHERE rank <= {k}"""


def _pruned(spark: SparkSession, d: str, search: Search) -> DataFrame:
    f, anchors, member = _nearest(spark, d)
    return rounded(knn(f, member, anchors, search), "dist")


@query(_knn_sql("true", 5))
def knn_exact(spark: SparkSession, d: str) -> DataFrame:
    return _pruned(spark, d, Search(k=5))


@query(_knn_sql("true", 3))
def knn_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(knn_brute(frames(spark, d), Search(k=3)), "dist")


@query(_knn_sql("c.frame_id <= q.frame_id AND abs(c.frame_id - q.frame_id) >= 7", 4))
def knn_dtmin_past(spark: SparkSession, d: str) -> DataFrame:
    return _pruned(spark, d, Search(k=4, dtmin=7, past=True))


@query(_knn_sql("c.frame_id >= q.frame_id", 4))
def knn_future(spark: SparkSession, d: str) -> DataFrame:
    return _pruned(spark, d, Search(k=4, future=True))


@query(_knn_sql("list_distance(q.data, c.data) <= 1.25", 6))
def knn_rlim(spark: SparkSession, d: str) -> DataFrame:
    return _pruned(spark, d, Search(k=6, rlim=1.25))


@query("SELECT count(*) AS queries FROM embeddings")
def knn_queries(spark: SparkSession, d: str) -> DataFrame:
    """Of a search's counters, the number of queries; the others depend on rounding and have a test."""
    f, anchors, member = _nearest(spark, d)
    return knn_telemetry(f, member, anchors, Search(k=5)).select("queries")


@query()
def knn_eps(spark: SparkSession, d: str) -> DataFrame:
    return _pruned(spark, d, Search(k=5, eps=0.1))


@query(f"""WITH p AS ({_knn_sql("list_distance(q.data, c.data) <= 1.2", 3)})
SELECT vec_id AS query_id, k AS rank, coalesce(neighbor_id, -1) AS neighbor_id, coalesce(dist, -1) AS dist
FROM embeddings CROSS JOIN range(1, 4) r(k) LEFT JOIN p ON query_id = vec_id AND rank = k""")
def knn_padded(spark: SparkSession, d: str) -> DataFrame:
    wide = padded(_pruned(spark, d, Search(k=3, rlim=1.2)), frames(spark, d), 3)
    return wide.select("query_id", F.inline(F.arrays_zip("neighbors", "dists", F.array(*[F.lit(k) for k in (1, 2, 3)]).alias("rank"))).alias("neighbor_id", "dist", "rank"))


# Statistics of ordered states


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("frame_id"), F.col("event_type").alias("state"), "user_id")


_MOVES = "WITH l AS (SELECT event_type AS dst, lag(event_type) OVER (ORDER BY event_id) AS src FROM events), m AS (SELECT src, dst, count(*) AS n FROM l WHERE src IS NOT NULL GROUP BY 1, 2)"


@query(f"{_MOVES} SELECT src, dst, n FROM m")
def transition_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.transitions(_events(spark, d), "state")


@query("""WITH l AS (SELECT event_type AS dst, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS src FROM events)
SELECT src, dst, count(*) AS n FROM l WHERE src IS NOT NULL GROUP BY 1, 2""")
def transition_counts_by_stream(spark: SparkSession, d: str) -> DataFrame:
    return A.transitions(_events(spark, d), "state", by=["user_id"])


@query(f"{_MOVES} SELECT src, sum(n)::BIGINT AS total, round(coalesce(sum(n) FILTER (src = dst), 0) / sum(n), 6) AS p_stay, round(sum(n) / nullif(coalesce(sum(n) FILTER (src <> dst), 0), 0), 6) AS dwell FROM m GROUP BY 1")
def dwell(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.dwell(A.transitions(_events(spark, d), "state")), "p_stay", "dwell")


@query(f"{_MOVES} SELECT src, dst, n, round(100.0 * n / (SELECT count(*) FROM events), 6) AS pct FROM m WHERE src <> dst ORDER BY n DESC, src, dst LIMIT 5")
def top_transitions(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    return rounded(A.top_transitions(A.transitions(e, "state"), e.count()), "pct")


@query("""WITH top AS (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3),
l AS (SELECT event_type AS dst, lag(event_type) OVER (ORDER BY event_id) AS src FROM events WHERE event_type IN (SELECT event_type FROM top)),
m AS (SELECT src, dst, count(*) AS n FROM l WHERE src IS NOT NULL GROUP BY 1, 2)
SELECT src, dst, n, round(n / sum(n) OVER (PARTITION BY src), 6) AS p FROM m""")
def markov_rows(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.markov_matrix(_events(spark, d), 3, "state"), "p")


@query(f"""{_MOVES}, p AS (SELECT src, dst, n, n / sum(n) OVER (PARTITION BY src) AS p FROM m), top AS (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 4)
SELECT src, dst, n, round(p, 6) AS p FROM p WHERE p >= 0.05 AND src <> dst AND src IN (SELECT event_type FROM top) AND dst IN (SELECT event_type FROM top)""")
def transition_graph(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.transition_graph(_events(spark, d), 4, 0.05, "state"), "p")


@query("""WITH g AS (SELECT event_type AS state, count(*) AS n FROM events GROUP BY 1)
SELECT state, n, row_number() OVER (ORDER BY n DESC, state) AS rank, round(100 * sum(n) OVER (ORDER BY n DESC, state) / sum(n) OVER (), 6) AS cum_pct FROM g""")
def rank_spectrum(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.rank_spectrum(_events(spark, d), "state"), "cum_pct")


# Statistics of clusterings


@query(f"""{_LABELLED}, g AS (SELECT cluster_id, count(*) AS n, sum(dist * dist) AS sq, max(dist) AS far FROM member GROUP BY 1)
SELECT count(*) AS active_clusters, sum(n)::BIGINT AS assigned, round(sqrt(sum(sq) / sum(n)), 6) AS global_rms, round(avg(sqrt(sq / n)), 6) AS mean_rms, round(max(far), 6) AS max_dist,
min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) AS mean_size, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM g""")
def cluster_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.cluster_metrics(labelled(spark, d)[1]), "global_rms", "mean_rms", "max_dist", "mean_size", "entropy")


@query("""WITH g AS (SELECT count(*) / (SELECT count(*) FROM embeddings) AS p FROM embeddings GROUP BY label)
SELECT count(*) AS k, round(-sum(p * log2(p)), 6) AS entropy, round(-sum(p * log2(p)) / log2(count(*)), 6) AS evenness FROM g""")
def entropy_evenness(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.cluster_entropy(labelled(spark, d)[1]), "entropy", "evenness")


@query("""SELECT label::BIGINT AS cluster_id, count(*) AS size, min(vec_id) AS birth_frame, max(vec_id) AS death_frame, max(vec_id) - min(vec_id) + 1 AS span,
round(100 * count(*) / (max(vec_id) - min(vec_id) + 1), 6) AS duty FROM embeddings GROUP BY 1""")
def lifetime(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.lifetimes(labelled(spark, d)[1]), "duty")


@query(f"{_LABELLED} SELECT cluster_id::BIGINT AS cluster_id, round(avg(dist), 6) AS mean_dist, round(max(dist), 6) AS max_dist, round(stddev_pop(dist), 6) AS std_dist FROM member GROUP BY 1")
def spread(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.spread(*labelled(spark, d)), "mean_dist", "max_dist", "std_dist")


@query("SELECT label::BIGINT AS cluster_id, min(vec_id) AS frame_id FROM embeddings GROUP BY 1")
def first_members(spark: SparkSession, d: str) -> DataFrame:
    return A.first_members(labelled(spark, d)[1])


@query("""WITH f AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1 AS new FROM embeddings)
SELECT vec_id AS frame_id, sum(new::INT) OVER (ORDER BY vec_id)::BIGINT AS k FROM f""")
def cum_discovery(spark: SparkSession, d: str) -> DataFrame:
    return A.cumulative_clusters(labelled(spark, d)[1]).select("frame_id", F.col("k").cast("long").alias("k"))


@query("""WITH x AS (SELECT label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(v) AS m FROM x GROUP BY 1, 2)
SELECT label::BIGINT AS cluster_id, pos - 1 AS pos, round(m, 6) AS mean FROM m""")
def centroids(spark: SparkSession, d: str) -> DataFrame:
    f, member, _ = labelled(spark, d)
    return rounded(A.centroids(f, member).select("cluster_id", F.posexplode("mean").alias("pos", "mean")), "mean").withColumn("pos", F.col("pos").cast("long"))


@query("""WITH s AS (SELECT event_id AS f, event_type AS c, lag(event_type, 1) OVER w AS a, lag(event_type, 2) OVER w AS b FROM events WINDOW w AS (ORDER BY event_id)),
g AS (SELECT * FROM s WHERE b IS NOT NULL)
SELECT x.f AS frame_id, y.c AS successor, count(*) AS n FROM g x JOIN g y ON x.a = y.a AND x.b = y.b AND y.f < x.f AND y.f >= x.f - 200 GROUP BY 1, 2""")
def pattern_successors(spark: SparkSession, d: str) -> DataFrame:
    return A.pattern_successors(_events(spark, d).withColumnRenamed("state", "cluster_id"), 2, 200)


@query("""WITH p AS (SELECT p_size::DOUBLE AS x FROM part), q AS (SELECT quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.99) AS hi FROM p)
SELECT p_partkey, round(least(1.0, greatest(0.05, 0.05 + 0.95 * (p_size - lo) / (hi - lo))), 6) AS p_size_norm FROM part, q""")
def percentile_stretch(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.normalised(table(spark, d, "part"), "p_size"), "p_size_norm").select("p_partkey", "p_size_norm")


@query("""WITH x AS (SELECT label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(v) AS m FROM x GROUP BY 1, 2),
c AS (SELECT label::BIGINT AS label, list(m ORDER BY pos) AS c FROM m GROUP BY 1)
SELECT a.label AS i, b.label AS j, round(list_distance(a.c, b.c), 6) AS dist FROM c a, c b""")
def centroid_distances(spark: SparkSession, d: str) -> DataFrame:
    f, member, _ = labelled(spark, d)
    return rounded(A.centroid_distances(A.centroids(f, member), A.cluster_counts(member)), "dist")


@query("""WITH c AS (SELECT label AS cluster_id, avg(embedding[1])::DOUBLE AS x, avg(embedding[2])::DOUBLE AS y FROM (SELECT label, embedding::DOUBLE[] AS embedding FROM embeddings) GROUP BY 1),
g AS (SELECT i % 40 AS gx, i // 40 AS gy FROM range(1600) r(i)), s AS (SELECT gx, gy, cluster_id, round((gx * (2.0::DOUBLE / 39) - 1 - x) * (gx * (2.0::DOUBLE / 39) - 1 - x) + (gy * (2.0::DOUBLE / 39) - 1 - y) * (gy * (2.0::DOUBLE / 39) - 1 - y), 9) AS d FROM g, c)
SELECT gx, gy, arg_min(cluster_id, (d, cluster_id))::BIGINT AS cluster_id FROM s GROUP BY 1, 2""")
def voronoi_label(spark: SparkSession, d: str) -> DataFrame:
    f, member, _ = labelled(spark, d)
    two = A.centroids(f, member).select("cluster_id", F.col("mean")[0].alias("x"), F.col("mean")[1].alias("y"))
    return A.voronoi(two, 40, -1.0, 1.0)


@query("""WITH x AS (SELECT vec_id, abs(unnest(embedding::DOUBLE[])) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
SELECT vec_id AS frame_id, round(sum(v), 6) AS flux, round(sum(v * (pos % 8)) / sum(v), 6) AS x, round(sum(v * (pos // 8)) / sum(v), 6) AS y FROM x GROUP BY 1""")
def photocenter(spark: SparkSession, d: str) -> DataFrame:
    f = frames(spark, d).withColumn("data", F.transform("data", lambda v: F.abs(v)))
    return rounded(A.photocenter(f, 8), "flux", "x", "y")


# Bounds and weights, on four points of `part`


_FIVE = "WITH s AS (SELECT i, x FROM (SELECT vec_id AS i, embedding::DOUBLE[] AS x FROM embeddings)), r AS (SELECT a.i, " + ", ".join(
    f"list_distance({p}.x, {q}.x) AS d{m}{n}" for (m, p), (n, q) in [((1, "a"), (2, "b")), ((1, "a"), (3, "c")), ((2, "b"), (3, "c")), ((1, "a"), (4, "e")), ((2, "b"), (4, "e")), ((3, "c"), (4, "e")), ((1, "a"), (5, "f")), ((2, "b"), (5, "f")), ((3, "c"), (5, "f")), ((4, "e"), (5, "f"))]
) + " FROM s a JOIN s b ON b.i = a.i + 1 JOIN s c ON c.i = a.i + 2 JOIN s e ON e.i = a.i + 3 JOIN s f ON f.i = a.i + 4)"


def _five(spark: SparkSession, d: str) -> DataFrame:
    """Ten distances of five consecutive frames."""
    f = frames(spark, d)
    sets = f
    for n, name in enumerate("bcef", 1):
        sets = sets.join(f.select((F.col("frame_id") - n).alias("frame_id"), F.col("data").alias(name)), "frame_id")
    points = dict(zip((1, 2, 3, 4, 5), ("data", "b", "c", "e", "f"), strict=True))
    return sets.select(F.col("frame_id").alias("i"), *[M.l2(F.col(points[m]), F.col(points[n])).alias(f"d{m}{n}") for m in points for n in points if m < n])


@query(f"{_FIVE} SELECT i, round(abs(d13 - d12), 6) AS low, abs(d13 - d12) <= 0.05 AS possible FROM r")
def bound_3pt(spark: SparkSession, d: str) -> DataFrame:
    r = _five(spark, d)
    return r.select("i", F.round(F.abs(F.col("d13") - F.col("d12")), 6).alias("low"), M.within_3pt(F.col("d12"), F.col("d13"), 0.05).alias("possible"))


@query(f"""{_FIVE}, p AS (SELECT *, (d13*d13 - d23*d23 + d12*d12) / (2*d12) AS x3, (d14*d14 - d24*d24 + d12*d12) / (2*d12) AS x4 FROM r),
q AS (SELECT *, sqrt(greatest(0, d13*d13 - x3*x3)) AS y3, sqrt(greatest(0, d14*d14 - x4*x4)) AS y4 FROM p),
b AS (SELECT i, d34, sqrt((x3-x4)*(x3-x4) + (y3-y4)*(y3-y4)) AS low FROM q)
SELECT i, round(low, 6) AS low, low <= d34 + 1e-9 AS sound FROM b""")
def bound_4pt(spark: SparkSession, d: str) -> DataFrame:
    low = M.bound_4pt(*[F.col(c) for c in ("d12", "d13", "d23", "d14", "d24")])
    return _five(spark, d).select("i", F.round(low, 6).alias("low"), (low <= F.col("d34") + 1e-9).alias("sound"))


@query(f"""{_FIVE}, p AS (SELECT *, (d13*d13 - d23*d23 + d12*d12) / (2*d12) AS x3, (d14*d14 - d24*d24 + d12*d12) / (2*d12) AS x4, (d15*d15 - d25*d25 + d12*d12) / (2*d12) AS x5 FROM r),
q AS (SELECT *, sqrt(d13*d13 - x3*x3) AS y3 FROM p),
w AS (SELECT *, (d14*d14 - d34*d34 + x3*x3 + y3*y3 - 2*x3*x4) / (2*y3) AS y4, (d15*d15 - d35*d35 + x3*x3 + y3*y3 - 2*x3*x5) / (2*y3) AS y5 FROM q),
b AS (SELECT i, d45, sqrt((x4-x5)*(x4-x5) + (y4-y5)*(y4-y5) + (sqrt(greatest(0, d14*d14-x4*x4-y4*y4)) - sqrt(greatest(0, d15*d15-x5*x5-y5*y5)))**2) AS low FROM w)
SELECT i, round(low, 6) AS low, low <= d45 + 1e-9 AS sound FROM b""")
def bound_5pt(spark: SparkSession, d: str) -> DataFrame:
    low = M.bound_5pt(*[F.col(c) for c in ("d12", "d13", "d23", "d14", "d24", "d34", "d15", "d25", "d35")])
    return _five(spark, d).select("i", F.round(low, 6).alias("low"), (low <= F.col("d45") + 1e-9).alias("sound"))


@query(f"{_FIVE}, x AS (SELECT i, abs(d13 - d12) / 0.05 AS dr FROM r) SELECT i, round(CASE WHEN dr > 2 THEN 0 ELSE 2 - 1.5 * dr / 2 END, 6) AS weight FROM x")
def fmatch_weight(spark: SparkSession, d: str) -> DataFrame:
    return _five(spark, d).select("i", F.round(M.fmatch(F.abs(F.col("d13") - F.col("d12")) / 0.05), 6).alias("weight"))


@query(f"{_FIVE}, x AS (SELECT i, (d13 - d12) * (d13 - d12) / (2 * 0.05 * 0.05) AS v FROM r) SELECT i, round(CASE WHEN v <= 2 THEN 1 - v * (0.978371 - v * (0.419481 - 0.073231 * v)) ELSE 0 END, 6) AS weight FROM x")
def soft_likelihood(spark: SparkSession, d: str) -> DataFrame:
    diff = F.col("d13") - F.col("d12")
    return _five(spark, d).select("i", F.round(M.soft_exp(diff * diff / (2 * 0.05 * 0.05)), 6).alias("weight"))


# Tiles


@query("""WITH t AS (SELECT i AS pixel_idx, least(i % 8 // 4, 1) + 2 * least(i // 8 // 4, 1) AS tile_id FROM range(64) r(i))
SELECT vec_id AS frame_id, tile_id::INT AS tile_id, row_number() OVER (PARTITION BY vec_id, tile_id ORDER BY pixel_idx) - 1 AS pos, round(embedding[pixel_idx + 1]::DOUBLE, 6) AS v FROM embeddings, t""")
def tile_scatter(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(TL.scatter(frames(spark, d), TL.grid_tiles(8, 8, "2x2")))


def _tile_states(spark: SparkSession, d: str) -> DataFrame:
    """Four tiles of sixteen dimensions; the state of a tile is the sign pattern of its first two values."""
    tiles = TL.scatter(frames(spark, d), TL.grid_tiles(8, 8, "2x2"))
    return tiles.select("frame_id", "tile_id", F.expr("CAST((data[0] > 0) AS BIGINT) + 2 * CAST((data[1] > 0) AS BIGINT)").alias("cluster_id"))


_TILES = """WITH t AS (SELECT unnest([0, 4, 32, 36]) AS p, unnest([0, 1, 2, 3]) AS tile_id),
s AS (SELECT vec_id AS frame_id, tile_id, (embedding[p + 1] > 0)::BIGINT + 2 * (embedding[p + 2] > 0)::BIGINT AS cluster_id FROM embeddings, t)"""


@query(f"{_TILES}, u AS (SELECT frame_id, string_agg(cluster_id::VARCHAR, ',' ORDER BY tile_id) AS tuple FROM s GROUP BY 1) SELECT tuple, count(*) AS n, max(frame_id) AS last_active FROM u GROUP BY 1")
def tuple_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.unique_tuples(TL.tuples(_tile_states(spark, d))).withColumn("tuple", F.array_join("tuple", ","))


@query(f"""{_TILES} SELECT a.tile_id::INT AS src_tile, a.cluster_id AS src_cl, b.tile_id::INT AS dst_tile, b.cluster_id AS dst_cl, round(sum(pow(0.99, (SELECT max(vec_id) FROM embeddings) - a.frame_id)), 6) AS weight
FROM s a JOIN s b ON a.frame_id = b.frame_id AND a.tile_id <> b.tile_id GROUP BY 1, 2, 3, 4""")
def cpt_decay(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.cross_tile_weights(_tile_states(spark, d), 0.99), "weight")


# Generated sequences


def _generated(rule: str, n: int, columns: int) -> str:
    cols = ", ".join(f"round(v[{k + 1}], 6) + 0.0::DOUBLE AS x{k}" for k in range(columns))
    return f"WITH g AS (SELECT i, {rule} AS v FROM range({n}) r(i)) SELECT i AS frame_id, {cols} FROM g"


def _columns(df: DataFrame, n: int) -> DataFrame:
    return df.select("frame_id", *[(F.round(F.col("data")[k], 6) + 0.0).alias(f"x{k}") for k in range(n)])


@query(_generated("[i / 5000.0::DOUBLE * cos(4 * pi() * i / 5000), i / 5000.0::DOUBLE * sin(4 * pi() * i / 5000)]", 5000, 2))
def gen_spiral(spark: SparkSession, d: str) -> DataFrame:
    return _columns(G.spiral(spark, 5000), 2)


@query(_generated("[cos(2 * pi() * i / 10), sin(2 * pi() * i / 10)]", 1000, 2))
def gen_circle(spark: SparkSession, d: str) -> DataFrame:
    return _columns(G.circle(spark, 1000, 10), 2)


@query(_generated("[cos(2 * pi() * (i % 100) / 100), sin(2 * pi() * (i % 100) / 100)]", 300, 2))
def gen_repeat(spark: SparkSession, d: str) -> DataFrame:
    return _columns(G.repeated(G.circle(spark, 100), 3), 2)


@query()
def gen_random_disc(spark: SparkSession, d: str) -> DataFrame:
    return _columns(G.random_ball(spark, 1000, 2, seed=3), 2)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors, nearest assignment and cluster counts of the embeddings."""
    return leader_counts(spark, sf_dir)




# The ordered state machine, in its modes (not SQL: which anchor takes a frame depends on the probe order)


def _mode(**options) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        member = fit(frames(spark, d), EngineConfig(rlim=RLIM, **WHOLE, **options))
        return rounded(member, "dist").select("frame_id", "cluster_id", "dist", "is_new", F.size("evals").alias("n_evals"), "pruned")

    return run


_MODES: dict[str, dict] = {
    "default": {}, "te4": {"te4": True}, "te5": {"te4": True, "te5": True}, "tm": {"tm": 0.5}, "gprob": {"gprob": True}, "pred": {"pred": (2, 1000, 2)}, "predf": {"predf": (2, 200, 2)},
    "entropy": {"entropy": True, "entropy_gate": 1.0, "entropy_first_gate": 1.0}, "entropy_fast": {"entropy": True, "entropy_fast": True, "entropy_gate": 1.0},
    "entropy_leader": {"entropy": True, "entropy_leader": True}, "soft_bayesian": {"gprob": True, "soft_bayesian": True}, "sparse_dcc": {"sparse_dcc": True, "sparse_dcc_extra_evals": 2},
}
QUERIES |= {f"stepper_{name}": _mode(**options) for name, options in _MODES.items()}


@query(f"{_LEAD} SELECT cluster_id, anchor_id FROM anc")
def stepper_anchors(spark: SparkSession, d: str) -> DataFrame:
    """The anchors of the state machine are those of the blockwise leader, in any mode."""
    member = fit(frames(spark, d), EngineConfig(rlim=RLIM, **WHOLE, gprob=True, te4=True, sparse_dcc=True))
    return member.where("is_new").select("cluster_id", F.col("frame_id").alias("anchor_id"))


@query()
def stepper_discard(spark: SparkSession, d: str) -> DataFrame:
    return fit(frames(spark, d), EngineConfig(rlim=RLIM, maxcl=20, maxcl_strategy="discard", maxim=2**62)).select("frame_id", "cluster_id", "uid")


@query()
def stepper_merge(spark: SparkSession, d: str) -> DataFrame:
    return fit(frames(spark, d), EngineConfig(rlim=RLIM, maxcl=20, maxcl_strategy="merge", maxim=2**62)).select("frame_id", "cluster_id", "uid")


@query()
def stepper_by_stream(spark: SparkSession, d: str) -> DataFrame:
    """One stream for each user of events, values as one-dimensional frames, in parallel."""
    e = column_frames(table(spark, d, "events"), F.col("event_id"), ["value"], ["user_id"])
    return fit(e, EngineConfig(rlim=10.0, **WHOLE), ["user_id"]).select("user_id", "frame_id", "cluster_id", F.round("dist", 6).alias("dist"))


@query()
def probe_histogram(spark: SparkSession, d: str) -> DataFrame:
    return A.probe_statistics(fit(frames(spark, d), EngineConfig(rlim=RLIM, **WHOLE)), RLIM)[0]


@query()
def failed_probes(spark: SparkSession, d: str) -> DataFrame:
    return A.probe_statistics(fit(frames(spark, d), EngineConfig(rlim=RLIM, **WHOLE)), RLIM)[1]


@query()
def pruned_by_depth(spark: SparkSession, d: str) -> DataFrame:
    return rounded(A.pruned_by_depth(fit(frames(spark, d), EngineConfig(rlim=RLIM, **WHOLE))), "pruned_fraction")


@query(f"{_LEAD} SELECT (SELECT count(*) FROM anc) * ((SELECT count(*) FROM anc) - 1) // 2 AS pairs")
def dense_anchor_pairs(spark: SparkSession, d: str) -> DataFrame:
    """In dense mode each new anchor is measured against each older one, by a probe or for the table."""
    model = cluster(frames(spark, d), EngineConfig(rlim=RLIM, **WHOLE))
    new = model.membership.where("is_new").select("frame_id")
    return model.all_distances().join(new, "frame_id", "left_semi").agg(F.count("*").alias("pairs"))


@query()
def run_telemetry(spark: SparkSession, d: str) -> DataFrame:
    return cluster(frames(spark, d), EngineConfig(rlim=RLIM, **WHOLE, pred=(2, 1000, 2))).telemetry()


def _tiled(**options) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        member = TL.fit_tiles(frames(spark, d), EngineConfig(rlim=0.7, **WHOLE, **options), TL.grid_tiles(8, 8, "2x2"))
        return member.select("frame_id", "tile_id", "cluster_id", F.round("dist", 6).alias("dist"))

    return run


QUERIES |= {"tile_leader": _tiled(), "tile_joint": _tiled(pass2=True), "tile_xtile": _tiled(xtile=2), "tile_xtile_cpt": _tiled(xtile=1, xtile_decay=0.99), "tile_pred": _tiled(pred=(2, 500, 2))}


@query()
def embedding_from_distances(spark: SparkSession, d: str) -> DataFrame:
    return embed(A.anchor_distances(_nearest(spark, d)[1]), 3)


@query()
def tune_radius(spark: SparkSession, d: str) -> DataFrame:
    return tune(frames(spark, d), side=8, rows=2**62, maxcl=2**62)


@query()
def gen_walk(spark: SparkSession, d: str) -> DataFrame:
    return _columns(G.walk(spark, 500, 2, seed=1), 2)


@query()
def gen_star_shuffled(spark: SparkSession, d: str) -> DataFrame:
    return _columns(G.shuffled(G.noisy(G.star(spark, 600, 30), 0.02, 5), 7), 3)


@query()
def gen_bouncing_balls(spark: SparkSession, d: str) -> DataFrame:
    return G.bouncing_balls(spark, 50, 16, 2, collide=True).select("frame_id", F.round(F.aggregate("data", F.lit(0.0), lambda s, v: s + v), 6).alias("flux"))


# The published patterns: clusters and sample distances for each frame

#: name -> (frames of the pattern, radius)
PATTERNS: dict[str, tuple[Callable[[SparkSession, int], DataFrame], float]] = {
    "2Dspiral": (lambda s, n: G.spiral(s, n), 0.10),
    "2Dcircle_shuffle": (lambda s, n: G.shuffled(G.circle(s, n), 1), 0.10),
    "2Dspiral_shuffle": (lambda s, n: G.shuffled(G.spiral(s, n), 1), 0.10),
    "2DcircleP10n": (lambda s, n: G.noisy(G.circle(s, n, 10), 0.04, 1), 0.10),
    "2Drand": (lambda s, n: G.random_ball(s, n, 2, 1), 0.10),
    "3Dspiral": (lambda s, n: G.spiral(s, n, dims=3), 0.02),
    "3Dstar": (lambda s, n: G.shuffled(G.noisy(G.star(s, n, 30), 0.02, 1), 1), 0.10),
    "3Drand": (lambda s, n: G.random_ball(s, n, 3, 1), 0.20),
}


def pattern(name: str, n: int = 20_000) -> Query:
    make, rlim = PATTERNS[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        t = cluster(make(spark, n), EngineConfig(rlim=rlim, maxcl=2500)).telemetry()
        return t.select("frames", F.col("clusters_made").alias("clusters"), F.round(F.col("sample_distances") / F.col("frames"), 4).alias("distances_per_frame"))

    return run


QUERIES |= {f"pattern_{name}": pattern(name) for name in PATTERNS}
