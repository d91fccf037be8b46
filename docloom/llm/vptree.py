"""Nearest neighbours by vantage-point trees, one per shard, with relaxed triangle-inequality pruning."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import materialize, read

SHARD_ROWS, BLOCK_ROWS, LEAF = 8192, 4096, 96
#: Pivots of a width at most, drawn by a hash: a documented bound on what the driver holds. Every row is indexed.
MAX_PIVOTS = 2048
#: Factor by which pruning is bolder than the triangle inequality allows; 1 is exact search.
RELAX = 1.0
#: Pairs whose exact products are taken at once.
PAIRS = 20_000


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The double-precision inner product of each pair of rows, summed from the first component to the last whatever the batch."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


class Tree:
    """A vantage-point tree over the distinct ``points``, numbered by their smallest id.

    Inner products become distances by one more coordinate that gives all points the same norm: the nearest point of
    (q, 0) is then the one with the largest inner product. Of each point the ``keep`` smallest ids are held.
    """

    def __init__(self, ids: np.ndarray, points: np.ndarray, keep: int, seed: int = 17):
        order = np.argsort(ids, kind="stable")
        ids, points = ids[order], points[order]
        _, first, group = np.unique(points, axis=0, return_index=True, return_inverse=True)
        number = np.empty(len(first), np.int64)
        number[np.argsort(first, kind="stable")] = np.arange(len(first))
        group = number[group.ravel()]
        by_group = np.argsort(group, kind="stable")  # ids ascend inside a group
        starts = np.searchsorted(group[by_group], np.arange(len(first) + 1))
        held = np.minimum(np.diff(starts), keep)
        place = np.repeat(starts[:-1], held) + np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
        self.ids, self.held, self.points = ids[by_group[place]], np.concatenate(([0], np.cumsum(held))), points[np.sort(first)]
        norms = (self.points**2).sum(axis=1)
        self.top = norms.max(initial=0.0)
        self.more = np.sqrt(np.maximum(0, self.top - norms))
        self.rng = np.random.default_rng(seed)
        self.root = self._node(np.arange(len(self.points)))
        del self.rng

    def _node(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        v = int(rows[self.rng.integers(len(rows))])
        d = np.sqrt(((self.points[rows] - self.points[v]) ** 2).sum(axis=1) + (self.more[rows] - self.more[v]) ** 2)
        middle = float(np.median(d))
        inside = d < middle
        if not inside.any() or inside.all():
            return rows
        return v, middle, self._node(rows[inside]), self._node(rows[~inside])

    def search(self, queries: np.ndarray, k: int, relax: float, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of ``points``, -1 where there are fewer; their inner products) of each query: the k best, best first.

        Equal products go to the smaller row, so to the smaller id, and no tie at the last place is lost: a branch is
        left out only if its bound is below the k-th product by more than rounding. ``floor``: products that a query
        has k of elsewhere; smaller ones needn't be found.
        """
        n, q2 = len(queries), (queries**2).sum(axis=1)
        found, dots = np.full((n, k), -1), np.full((n, k), -np.inf)
        slack = 1e-12 * np.sqrt(q2 * self.top) * np.sqrt(max(1, queries.shape[1]))

        def least(at: np.ndarray) -> np.ndarray:
            return np.maximum(floor[at], dots[at, -1]) - slack[at]

        def leaf(rows: np.ndarray, at: np.ndarray) -> None:
            i, j = np.nonzero(queries[at] @ self.points[rows].T >= least(at)[:, None])
            if not len(i):
                return
            some, i = np.unique(i, return_inverse=True)
            at = at[some]
            who = np.concatenate((np.repeat(np.arange(len(at)), k), i))
            row = np.concatenate((found[at].ravel(), rows[j]))
            exact = [inner(queries[at[i[k : k + PAIRS]]], self.points[rows[j[k : k + PAIRS]]]) for k in range(0, len(i), PAIRS)]
            product = np.concatenate((dots[at].ravel(), *exact))
            order = np.lexsort((row, -product, who))
            begin = np.searchsorted(who[order], np.arange(len(at)))
            best = order[begin[:, None] + np.arange(k)]
            dots[at], found[at] = product[best], row[best]

        def near(v: int, at: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(0, q2[at] + self.top - 2 * (queries[at] @ self.points[v])))

        def descend(node, at: np.ndarray) -> None:
            if not len(at):
                return
            if isinstance(node, np.ndarray):
                return leaf(node, at)
            inside = near(node[0], at) < node[1]
            descend(node[2], at[inside])
            descend(node[3], at[~inside])
            return None

        def reach(at: np.ndarray) -> np.ndarray:
            """How far a point may be that still counts, with room for the rounding of distances."""
            return np.sqrt(np.maximum(0, q2[at] + self.top - 2 * least(at))) / relax + 1e-7 * np.sqrt(q2[at] + self.top)

        def sweep(node, at: np.ndarray, own: np.ndarray) -> None:
            """own: the queries whose first leaf lies below; they have seen that leaf."""
            if not len(at):
                return
            if isinstance(node, np.ndarray):
                return leaf(node, at[~own])
            d = near(node[0], at)
            inside = d < node[1]
            left = (d - node[1] <= reach(at)) | (own & inside)
            sweep(node[2], at[left], (own & inside)[left])
            right = (node[1] - d <= reach(at)) | (own & ~inside)
            sweep(node[3], at[right], (own & ~inside)[right])
            return None

        if len(self.points):
            descend(self.root, np.arange(n))
            sweep(self.root, np.arange(n), np.ones(n, bool))
        return found, dots

    def hits(self, query_ids: np.ndarray, queries: np.ndarray, k: int, relax: float, floor: np.ndarray) -> pd.DataFrame:
        """query_id, vec_id, score: the k best of each query but its own id, or all that there are."""
        # one more row than k: the query's own id may be one; of others only the smallest id could be pushed out
        found, dots = self.search(queries, k + 1, relax, floor)
        i, rank = np.nonzero(found >= 0)
        row, score = found[i, rank], dots[i, rank]
        held = self.held[row + 1] - self.held[row]
        i, score = np.repeat(i, held), np.repeat(score, held)
        vec = self.ids[np.repeat(self.held[row], held) + np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)]
        other = vec != query_ids[i]
        i, score, vec = i[other], score[other], vec[other]
        order = np.lexsort((vec, -score, i))
        order = order[np.arange(len(order)) - np.searchsorted(i[order], i[order]) < k]
        return pd.DataFrame({"query_id": query_ids[i[order]], "vec_id": vec[order], "score": score[order]})


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v: array<double>, width) of the vectors that take part: not null, not zero, all components finite.

    Rows that repeat a vec_id are one, the smallest of them by content; vectors are shuffled for that only if ids repeat.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    base = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    base = base.where(fine & F.exists("v", lambda x: x != 0))
    if not base.groupBy("vec_id").count().where("count > 1").isEmpty():
        base = base.groupBy("vec_id").agg(F.min("v").alias("v"))
    return base.withColumn("width", F.size("v"))


def pivots_of(rows: DataFrame) -> dict[int, np.ndarray]:
    """Pivots of each width, about one for SHARD_ROWS vectors and MAX_PIVOTS at most, drawn by a hash of vec_id; the zero vector where none is drawn."""
    sizes = {r.width: r["count"] for r in rows.groupBy("width").count().collect()}
    turn, drawn = F.pmod(F.xxhash64(F.lit(29), F.col("vec_id")), F.lit(1 << 31)), F.lit(False)
    for width, n in sizes.items():
        share = min(MAX_PIVOTS, n // SHARD_ROWS) / n
        drawn = drawn | ((F.col("width") == width) & (turn < int(share * (1 << 31))))
    found: dict[int, list] = {w: [] for w in sizes}
    for r in rows.where(drawn).select("width", "vec_id", "v").collect():
        found[r.width].append((r.vec_id, r.v))
    return {w: np.array([v for _, v in sorted(x)] or [[0.0] * w]) for w, x in found.items()}


def in_cells(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` with the cell, which is the nearest pivot of their width, and the distance to it; widths without pivots go."""
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for width, some in pdf.groupby("width"):
                p = sent.value.get(int(width))
                if p is None:
                    continue
                x = np.stack(some.v.to_numpy())
                cell = np.empty(len(x), np.int32)
                for k in range(0, len(x), 1024):
                    cell[k : k + 1024] = np.argmin((p**2).sum(axis=1) - 2 * (x[k : k + 1024] @ p.T), axis=1)
                yield some.assign(cell=cell, far=np.sqrt(((x - p[cell]) ** 2).sum(axis=1)))

    return rows.mapInPandas(batches, "vec_id long, v array<double>, width int, cell int, far double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, relax: float = RELAX) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each query with vectors other than its own.

    Vectors are dealt to the cell of their nearest pivot, a cell of over SHARD_ROWS to several shards by a hash, and each
    shard builds one tree, which is written once. Queries form blocks of about BLOCK_ROWS a shard. Each visits its own
    cell first; by the k-th product found there it leaves out every cell whose pivot, radius and the triangle
    inequality, relaxed by ``relax`` like the trees' own pruning, show that all products there are smaller.

    Ties go to the smaller vec_id. Scores are double-precision products of the original vectors. Vectors that are null,
    zero or hold null or non-finite components take no part, as query or candidate; vectors of another width than the
    query's are no candidates. Rows that repeat a vec_id count once, the smallest by content. Further columns are
    ignored. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    every = usable(vectors)
    pivots = pivots_of(every)
    dealt = materialize(in_cells(every, pivots))
    cells = {(r.width, r.cell): r for r in dealt.groupBy("width", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}
    shards = spark.createDataFrame([(w, c, -(-r.n // SHARD_ROWS)) for (w, c), r in cells.items()], "width int, cell int, shards int")
    radii = {w: np.array([cells[w, c].radius if (w, c) in cells else -np.inf for c in range(len(p))]) for w, p in pivots.items()}
    sent = spark.sparkContext.broadcast((pivots, radii))

    def index(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(pdf.vec_id.to_numpy(np.int64), np.stack(pdf.v.to_numpy()), k + 1)
        return pd.DataFrame({"width": [key[0]], "cell": [key[1]], "shard": [key[2]], "tree": [pickle.dumps(vars(tree))]})

    hashed = F.xxhash64("vec_id")
    trees = dealt.join(F.broadcast(shards), ["width", "cell"]).withColumn("shard", F.pmod(hashed, "shards").cast("int"))
    trees = materialize(trees.groupBy("width", "cell", "shard").applyInPandas(index, "width int, cell int, shard int, tree binary"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        tree = Tree.__new__(Tree)
        vars(tree).update(pickle.loads(right.tree.iloc[0]))
        return tree.hits(left.vec_id.to_numpy(np.int64), np.stack(left.v.to_numpy()), k, relax, left.floor.to_numpy(float))

    def visit(asked: DataFrame) -> DataFrame:
        """query_id, vec_id, score: what ``asked(vec_id, v, width, floor, cells)`` find in the cells they name."""
        each = asked.select("vec_id", "v", "width", "floor", F.explode("cells").alias("cell"))
        blocks = [(r.width, r.cell, -(-r["count"] // BLOCK_ROWS)) for r in each.groupBy("width", "cell").count().collect()]
        plan = F.broadcast(spark.createDataFrame(blocks, "width int, cell int, blocks int"))
        each = each.join(plan, ["width", "cell"]).join(F.broadcast(shards), ["width", "cell"])
        each = each.withColumn("block", F.pmod(hashed, "blocks").cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        met = trees.join(plan, ["width", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keys = ["width", "cell", "shard", "block"]
        return each.select("vec_id", "v", "floor", *keys).groupBy(*keys).cogroup(met.select("tree", *keys).groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")

    def others(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The cells beside a query's own that may hold a product as large as its floor."""
        for pdf in it:
            reached = []
            for q, width, own, floor in zip(pdf.v, pdf.width, pdf.cell, pdf.floor, strict=True):
                p, r = sent.value[0][width], sent.value[1][width]
                size = np.sqrt((q**2).sum())
                bound = p @ q + size * (r / relax) + 1e-9 * size * (np.abs(p).max() * len(q) + 1)
                some = (r >= 0) & (bound >= floor)
                some[own] = False
                reached.append(np.flatnonzero(some).astype(np.int32))
            yield pdf.drop(columns="cell").assign(cells=reached)

    asked = materialize(in_cells(usable(queries), pivots).select("vec_id", "v", "width", "cell"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    at_home = asked.withColumn("cells", F.array("cell")).withColumn("floor", F.lit(float("-inf")))
    first = materialize(visit(at_home).withColumn("rank", rank).where(F.col("rank") <= k))
    floors = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    rest = asked.join(floors, "vec_id", "left").select("vec_id", "v", "width", "cell", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    rest = materialize(rest.mapInPandas(others, "vec_id long, v array<double>, width int, floor double, cells array<int>"))
    both = first.drop("rank").unionByName(visit(rest))
    return both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


OP3_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, min(e) AS e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0 GROUP BY 1),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CASE WHEN len(q.e) = len(d.e) THEN list_dot_product(q.e, d.e) END AS score FROM u q JOIN u d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s WHERE score IS NOT NULL)
SELECT * FROM r WHERE rank <= 20
"""
