"""Centroid clustering by ball-tree filtering: whole balls go to one centroid where the triangle inequality allows, leaves exactly."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import materialize, read

WIDTH, SCALE = 64, 256
CENTROIDS, ROUNDS, SEED = 40, 5, 2
#: Vectors of a tree and of a leaf.
TREE_ROWS, LEAF = 16_384, 32
#: Components beyond this have squared distances that may not fit a long; up to EXACT, products are exact in double precision.
LARGEST, EXACT = 1 << 27, 1 << 22


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number points to each of the centroids."""
    most = max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0))
    if most < EXACT:  # every product and sum stays below 2**53
        points, centroids = points.astype(float), centroids.astype(float)
    else:
        points, centroids = points.astype(np.int64), centroids.astype(np.int64)
        return np.stack([((points - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    d = (points**2).sum(axis=1)[:, None] + (centroids**2).sum(axis=1) - 2 * (points @ centroids.T)
    return d.astype(np.int64)


class Balls:
    """A metric tree over ``points``: each node has its rows as a range, so their count, their whole-number sum, so their centre, and the radius about it."""

    def __init__(self, ids: list, points: np.ndarray):
        self.order = np.arange(len(points))
        self.points = points
        self.low, self.high, self.child = [], [], []  # child: the first of two, -1 for a leaf
        self.radius, self.sums = [], []
        self._add(0, len(points))
        at = 0
        while at < len(self.low):
            self._split(at)
            at += 1
        self.points = points[self.order].astype(np.min_scalar_type(-int(np.abs(points).max(initial=0)) - 1))
        self.ids = [ids[k] for k in self.order.tolist()]
        for name in ("low", "high", "child", "radius"):
            setattr(self, name, np.array(getattr(self, name)))
        self.sums = np.stack(self.sums)

    def _add(self, low: int, high: int) -> None:
        some = self.points[self.order[low:high]]
        sums = some.sum(axis=0)
        centre = sums / (high - low)
        self.low.append(low)
        self.high.append(high)
        self.child.append(-1)
        self.sums.append(sums)
        self.radius.append(float(np.sqrt(((some - centre) ** 2).sum(axis=1).max())) * (1 + 1e-9))

    def _split(self, node: int) -> None:
        low, high = self.low[node], self.high[node]
        if high - low <= LEAF or self.radius[node] == 0:
            return
        own = self.order[low:high]
        some = self.points[own].astype(float)
        first = some[((some - self.sums[node] / (high - low)) ** 2).sum(axis=1).argmax()]
        from_first = ((some - first) ** 2).sum(axis=1)
        near = ((some - some[from_first.argmax()]) ** 2).sum(axis=1) < from_first
        if near.all() or not near.any():
            return
        self.order[low:high] = np.concatenate((own[near], own[~near]))
        self.child[node] = len(self.low)
        middle = low + int(near.sum())
        self._add(low, middle)
        self._add(middle, high)

    def assign(self, centroids: np.ndarray) -> tuple[list[tuple[int, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
        """((centroid, nodes) given away whole; rows met in leaves, their centroids and squared distances).

        A centroid is out for a ball if even the ball's nearest point may be farther from it than the ball's farthest point
        is from the best one; with one left, the ball is given away. What reaches a leaf is compared exactly, ties to the
        smaller number.
        """
        whole, leaves, masks = [], [], []
        nodes, may = np.array([0]), np.ones((1, len(centroids)), bool)
        c, centres = centroids.astype(float), self.sums / (self.high - self.low)[:, None]
        while len(nodes):
            centre = centres[nodes]
            size, reach = (centre**2).sum(axis=1), (c**2).sum(axis=1)
            d = np.sqrt(np.maximum(0, size[:, None] + reach - 2 * (centre @ c.T)))
            slack = 1e-6 * (1 + np.sqrt(size + reach.max()))
            far = np.where(may, d, np.inf).min(axis=1) + 2 * self.radius[nodes] + slack
            may = may & (d <= far[:, None])
            one, leaf = may.sum(axis=1) == 1, self.child[nodes] < 0
            whole += [(int(k), nodes[one & may[:, k]]) for k in np.flatnonzero(may[one].any(axis=0))]
            leaves.append(nodes[~one & leaf])
            masks.append(may[~one & leaf])
            down = ~one & ~leaf
            nodes = np.concatenate((self.child[nodes[down]], self.child[nodes[down]] + 1))
            may = np.concatenate((may[down], may[down]))
        leaves, masks = np.concatenate(leaves), np.concatenate(masks)
        n = self.high[leaves] - self.low[leaves]
        rows = np.repeat(self.low[leaves] - np.cumsum(n) + n, n) + np.arange(n.sum())
        d = squared(self.points[rows], centroids)
        d[~np.repeat(masks, n, axis=0)] = np.iinfo(np.int64).max
        best = d.argmin(axis=1)
        return whole, rows, best, d[np.arange(len(rows)), best] if len(rows) else np.empty(0, np.int64)

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vectors of each centroid, their whole-number sums)."""
        whole, rows, best, _ = self.assign(centroids)
        counts = np.bincount(best, minlength=len(centroids)).astype(np.int64)
        sums = np.zeros((len(centroids), self.points.shape[1]), np.int64)
        np.add.at(sums, best, self.points[rows].astype(np.int64))
        for k, nodes in whole:
            counts[k] += (self.high[nodes] - self.low[nodes]).sum()
            sums[k] += self.sums[nodes].sum(axis=0)
        return counts, sums

    def members(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each of ``ids``."""
        whole, rows, best, d = self.assign(centroids)
        cluster, distance = np.empty(len(self.points), np.int64), np.empty(len(self.points), np.int64)
        cluster[rows], distance[rows] = best, d
        for k, nodes in whole:
            n = self.high[nodes] - self.low[nodes]
            own = np.repeat(self.low[nodes] - np.cumsum(n) + n, n) + np.arange(n.sum())
            cluster[own], distance[own] = k, squared(self.points[own], centroids[k : k + 1])[:, 0]
        return cluster, distance


def whole_vectors(vectors: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, v: array<long>) of the vectors of ``width`` components, all finite, each turned to floor(scale * x)."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    base = vectors.where("embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where((F.size("v") == width) & fine)
    small = F.forall("v", lambda x: F.abs(x) * scale < LARGEST)
    held = F.when(small, F.col("v")).otherwise(F.raise_error(F.lit(f"a component times {scale} is beyond {LARGEST}: squared distances would not fit a long")))
    return base.select("vec_id", F.transform(held, lambda x: F.floor(x * scale).cast("long")).alias("v"))


def grown(rows: DataFrame) -> DataFrame:
    """(tree): a tree over every TREE_ROWS vectors of a partition, where they lie; nothing is shuffled."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, n = [], [], 0

        def tree() -> pa.RecordBatch:
            made = Balls(ids, np.concatenate(points))
            return pa.RecordBatch.from_pydict({"tree": pa.array([pickle.dumps(vars(made))], pa.binary())})

        for batch in it:
            for low in range(0, batch.num_rows, TREE_ROWS):
                some = batch.slice(low, TREE_ROWS)
                if n and n + some.num_rows > TREE_ROWS:
                    yield tree()
                    ids, points, n = [], [], 0
                v = some.column("v")
                ids = ids + some.column("vec_id").to_pylist()
                points = [*points, v.flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1)]
                n += some.num_rows
        if n:
            yield tree()

    return rows.mapInArrow(batches, "tree binary")


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[Balls]:
    for batch in batches:
        for b in batch.column("tree"):
            made = Balls.__new__(Balls)
            vars(made).update(pickle.loads(b.as_py()))
            yield made


def clusters(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector of ``vectors(vec_id, embedding)`` that is kept.

    Kept are vectors of WIDTH components, none null or not finite, as whole numbers floor(SCALE * x). The centroids start as
    the kept vectors with the smallest sha256 of ``<seed>:<vec_id>`` (rows without vec_id last, equal ones by content; all,
    if there are fewer). In each round every vector goes to its nearest centroid, ties to the smaller number, and centroids
    become the floor of their vectors' mean; one without vectors stays. The trees are built once and written; a round reads
    them and sends counts and sums of each centroid, added up by Spark, to the driver. Repeated rows are vectors of their own,
    further columns are ignored, an empty table gives no rows. A component so large that distances don't fit a long is an error.
    """
    spark = vectors.sparkSession
    kept = whole_vectors(vectors)
    turn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(turn.asc_nulls_last(), "v").limit(centroids).select("v").collect()
    at = np.array([r.v for r in first], np.int64).reshape(len(first), WIDTH)
    trees = materialize(grown(kept))
    for _ in range(rounds if len(at) else 0):  # without vectors there is nothing to move
        sent = spark.sparkContext.broadcast(at)

        def totals(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, sums = np.zeros(len(sent.value), np.int64), np.zeros(sent.value.shape, np.int64)
            for tree in _trees(it):
                n, s = tree.totals(sent.value)
                counts, sums = counts + n, sums + s
            rows = [(k, i, x) for k in np.flatnonzero(counts).tolist() for i, x in enumerate([int(counts[k]), *sums[k].tolist()])]
            yield pa.RecordBatch.from_pydict({c: pa.array([r[j] for r in rows], t) for j, (c, t) in enumerate((("k", pa.int32()), ("i", pa.int32()), ("x", pa.int64())))})

        added = trees.mapInArrow(totals, "k int, i int, x long").groupBy("k", "i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
        figures: dict[int, dict[int, int]] = {}
        for r in added:
            figures.setdefault(r.k, {})[r.i] = int(r.x)
        at = at.copy()
        for k, x in figures.items():
            at[k] = [x[i + 1] // x[0] for i in range(at.shape[1])]
    sent = spark.sparkContext.broadcast(at)

    def members(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree in _trees(it):
            cluster, distance = tree.members(sent.value)
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(tree.ids, pa.int64()), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(distance, pa.int64())})

    found = materialize(trees.mapInArrow(members, "vec_id long, cluster int, distance long"))
    inertia = {r.cluster: int(r.x) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}
    said = [(k, x, sum(inertia.values()), hashlib.sha256(",".join(map(str, at[k].tolist())).encode()).hexdigest()) for k, x in inertia.items()]
    about = spark.createDataFrame(said, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(read(spark, sf_dir, "embeddings"))


def _sql(centroids: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    def assigned(k: int) -> str:
        square = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
        each = f"d{k} AS MATERIALIZED (SELECT a.n, b.k, {square} AS d FROM kept a, c{k} b)"
        return f"{each}, a{k} AS MATERIALIZED (SELECT n, arg_min(k, (d, k)) AS k, min(d) AS d FROM d{k} GROUP BY n)"

    def moved(k: int) -> str:
        sums = f"s{k} AS (SELECT a.k, x.i, sum(e.v[x.i])::HUGEINT AS s, count(*)::HUGEINT AS m FROM a{k} a JOIN kept e USING (n), range(1, 65) x(i) GROUP BY 1, 2)"
        floor = "((s - ((s % m) + m) % m) // m)::BIGINT"
        new = f"m{k} AS (SELECT k, list({floor} ORDER BY i) AS v FROM s{k} GROUP BY k)"
        return f"{sums}, {new}, c{k + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (k))"

    steps = ",\n".join(f"{assigned(k)},\n{moved(k)}" for k in range(rounds))
    return f"""
WITH whole AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor({SCALE} * x)) AS v, embedding::DOUBLE[] AS e FROM embeddings),
kept AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, v::BIGINT[] AS v FROM whole
  WHERE len(e) = {WIDTH} AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1)::INT AS k, v FROM kept QUALIFY k < {centroids}),
{steps},
{assigned(rounds)},
i AS (SELECT k, sum(d)::BIGINT AS own FROM a{rounds} GROUP BY k)
SELECT vec_id, k::INT AS cluster, d AS distance, own AS cluster_inertia, (SELECT sum(own)::BIGINT FROM i) AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN kept USING (n) JOIN i USING (k) JOIN c{rounds} USING (k)
"""


OP13_SQL = _sql()
