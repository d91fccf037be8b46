"""Duplicates, similarity and clusters of short items; repeated lines; top-k by cosine."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.sources.shared import materialize

#: Vectors of a shard and queries of a block that meet in one task.
SHARD_ROWS, BLOCK_ROWS = 16_384, 2_048
#: Columns that all tokens have in common in the smallest sketch, sets of a block that meets another, tokens counted at once, and shards, so that tables of some blocks take many tasks.
COMMON, BLOCK_SETS, COUNTED, TASK_SHARDS = 256, 2_048, 4_000_000, 10
#: Sets of a shard at most, tokens that two bytes name, and sets that are looked up at once.
SHARD_SETS, SHORT, LOOKED_UP = 32_768, 65_536, 16
#: Columns of a sketch for each token of its sets, twice; groups that are looked for at first, among so many sets, by so many tokens, and how alike groups are one.
ROOM, GROUPS, GROUPED, TOLD_BY, ALIKE = 7, 32, 8_192, 256, 0.3


def dedupe_news(items: DataFrame) -> DataFrame:
    """The item with the longest content (in bytes) of each title, the first on a tie.

    ``items``: pos, title, content and more. The key is the normalised title, else the content; items without either are
    dropped. Result: those rows, by title.
    """
    key = F.coalesce(F.nullif(T.normalize_ws(T.or_blank(F.col("title"))), F.lit("")), T.normalize_ws(T.or_blank(F.col("content"))))
    keyed = items.withColumn("_key", key).where("_key <> ''")
    best = F.max_by(F.struct(*items.columns), F.struct(F.octet_length(T.or_blank(F.col("content"))).alias("n"), (-F.col("pos")).alias("p")))
    return keyed.groupBy("_key").agg(best.alias("b")).select("b.*")


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def coded(*frames: DataFrame) -> list[DataFrame]:
    """(id, n, codes) of each frame of ``(id, tokens)``: a set's size, and a number below 0 or from SHORT on for each token that isn't null.

    Numbers are hashes under the first seed that tells all tokens of all frames apart; the SHORT tokens met most often are
    numbered from 0 instead.
    """
    sets = [materialize(f.select("id", F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>"))).alias("tokens"))) for f in frames]
    every = reduce(DataFrame.unionByName, [x.select(F.explode("tokens").alias("token")) for x in sets])
    counts = materialize(every.where("token is not null").groupBy("token").agg(F.count("*").alias("n")))
    number = lambda x, seed: F.xxhash64(F.lit(seed), x)
    clash = lambda seed: counts.groupBy(number(F.col("token"), seed).alias("code")).count().where(f"count > 1 or code between 0 and {SHORT - 1}")
    seed = next(k for k in itertools.count() if clash(k).isEmpty())
    most = counts.orderBy(F.desc("n"), "token").limit(SHORT).select(number(F.col("token"), seed).alias("code")).toPandas().code.to_numpy(np.int64)
    order = np.argsort(most)
    known = most[order]

    def short(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            codes = batch.column("codes")
            flat, bounds = codes.flatten().to_numpy(), np.concatenate(([0], np.cumsum(pc.list_value_length(codes).to_numpy())))
            at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
            often = known[at] == flat if len(known) else np.zeros(len(flat), bool)
            upto = np.concatenate(([0], np.cumsum(often)))[bounds]
            pieces = (order[at[often]].astype("<u2").tobytes(), 2 * upto), (flat[~often].astype("<i8").tobytes(), 8 * (bounds - upto))
            columns = [pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(x.astype(np.int32).tobytes()), pa.py_buffer(data)]) for data, x in pieces]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), *columns], ["id", "n", "often", "others"])

    def made(x: DataFrame) -> DataFrame:
        codes = F.sort_array(F.transform(F.filter("tokens", lambda t: t.isNotNull()), lambda t: number(t, seed)))
        kind = x.select("id", F.lit(0).alias("n"), F.lit(b"").alias("often"), F.lit(b"").alias("others")).limit(0).schema
        return materialize(x.select("id", F.size("tokens").alias("n"), codes.alias("codes")).mapInArrow(short, kind))

    return [made(x) for x in sets]


class Sets:
    """The sets of one side of a task: ids, sizes, groups, and tokens by row, named by small numbers that both sides share, and dealt by hash to 2^32 places."""

    def __init__(self, table: pa.Table, names: np.ndarray):
        table = table.combine_chunks()
        self.ids, self.n = table.column("id").combine_chunks(), table.column("n").to_numpy().astype(np.int64)
        parts = [np.frombuffer(b"".join(table.column(c).to_pylist()), kind).astype(np.int64) for c, kind in (("often", "<u2"), ("others", "<i8"))]
        sizes = [pc.binary_length(table.column(c)).to_numpy().astype(np.int64) // k for c, k in (("often", 2), ("others", 8))]
        self.bounds = np.concatenate(([0], np.cumsum(sizes[0] + sizes[1])))
        local = [parts[0], SHORT + np.searchsorted(names, parts[1])]
        self.tokens, self.place = np.empty(self.bounds[-1], np.int32), np.empty(self.bounds[-1], np.uint32)
        for k in (0, 1):
            before = self.bounds[:-1] + (sizes[0] if k else 0)
            at = np.repeat(before - np.cumsum(sizes[k]) + sizes[k], sizes[k]) + np.arange(sizes[k].sum())
            self.tokens[at] = local[k]
            self.place[at] = ((parts[k].view(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)

        self.group = np.zeros(len(self.n), np.int64)

    def arrange(self, order: np.ndarray) -> None:
        """Put the sets in this order."""
        size = np.diff(self.bounds)[order]
        ends = np.cumsum(size)
        at = np.repeat(self.bounds[order] - ends + size, size) + np.arange(len(self.tokens))
        self.tokens, self.place, self.bounds = self.tokens[at], self.place[at], np.concatenate(([0], ends))
        self.ids, self.n, self.group = self.ids.take(pa.array(order)), self.n[order], self.group[order]

    def marks(self, rows: np.ndarray) -> np.ndarray:
        """Which of the TOLD_BY most frequent tokens each set has, as vectors of length 1."""
        size = np.diff(self.bounds)[rows]
        ends = np.cumsum(size)
        tokens = self.tokens[np.repeat(self.bounds[rows] - ends + size, size) + np.arange(size.sum())]
        told = tokens < TOLD_BY
        out = np.zeros((len(rows), TOLD_BY), np.float32)
        out[np.repeat(np.arange(len(rows)), size)[told], tokens[told]] = 1
        return out / np.maximum(1, np.sqrt(out.sum(axis=1, keepdims=True)))

    def sketch(self, low: int, high: int, columns: int) -> np.ndarray:
        """How many tokens of each set between ``low`` and ``high`` fall into each column."""
        some = slice(self.bounds[low], self.bounds[high])
        column = (self.place[some].astype(np.int64) * columns) >> 32
        row = np.repeat(np.arange(high - low) * columns, np.diff(self.bounds[low : high + 1]))
        return np.bincount(row + column, minlength=(high - low) * columns).astype(np.float32).reshape(high - low, columns)


def shared_tokens(left: Sets, right: Sets, i: np.ndarray, j: np.ndarray, total: int) -> np.ndarray:
    """How many tokens set i on the left and set j on the right share; pairs are in order of i, and ``total`` bounds the tokens' numbers."""
    out, width = np.zeros(len(i), np.int64), np.diff(right.bounds)[j]
    table = np.zeros(LOOKED_UP * total, bool)
    rows, begin = np.unique(i, return_index=True)
    begin = np.append(begin, len(i))
    for k in range(0, len(rows), LOOKED_UP):
        some = rows[k : k + LOOKED_UP]
        marked = np.concatenate([left.tokens[left.bounds[r] : left.bounds[r + 1]] + slot * total for slot, r in enumerate(some.tolist())])
        table[marked] = True
        low, high = begin[k], begin[min(k + LOOKED_UP, len(rows))]
        parts = np.cumsum(width[low:high]) // COUNTED
        for pairs in np.split(np.arange(low, high), np.flatnonzero(np.diff(parts)) + 1):
            n = width[pairs]
            ends = np.cumsum(n)
            at = np.repeat(right.bounds[j[pairs]] - ends + n, n) + np.arange(ends[-1])
            hit = table[right.tokens[at] + np.repeat(np.searchsorted(some, i[pairs]) * total, n)]
            out[pairs] = np.diff(np.concatenate(([0], np.cumsum(hit)))[np.concatenate(([0], ends))])
        table[marked] = False
    return out


def group_sets(sides: list[Sets], share: float, total: int) -> None:
    """Arrange the sets by group and size, so that sets of two groups can't be similar; group -1 meets all.

    Groups (such as languages) are found among some sets by their frequent tokens, alike ones made one; each token belongs to the
    group whose sets have it most. What two sets of different groups share is foreign to one of them at least, so if foreign
    tokens are less than ``share`` of both, they share less than that of both together.
    """
    every = sides[0].marks(np.linspace(0, len(sides[0].n) - 1, min(GROUPED, len(sides[0].n))).astype(np.int64))
    centers = every[np.random.default_rng(0).permutation(len(every))[:GROUPS]]
    for _ in range(4):
        if not len(centers):  # no set has a frequent token
            break
        nearest = np.argmax(every @ centers.T, axis=1)
        sums = np.stack([every[nearest == k].sum(axis=0) for k in range(len(centers))])
        centers = (sums / np.maximum(1e-9, np.linalg.norm(sums, axis=1, keepdims=True)))[sums.any(axis=1)]
    alike = centers @ centers.T > ALIKE
    for _ in range(len(centers)):
        alike |= alike @ alike
    of = np.unique(np.argmax(alike, axis=1), return_inverse=True)[1] if len(centers) else np.zeros(1, np.int64)
    groups = int(of.max()) + 1
    times = np.zeros(total * groups, np.int64)
    for side in sides:
        if groups > 1:
            side.group = of[np.concatenate([np.argmax(side.marks(rows) @ centers.T, axis=1) for rows in np.array_split(np.arange(len(side.n)), 1 + len(side.n) // GROUPED)])]
        times += np.bincount(side.tokens.astype(np.int64) * groups + np.repeat(side.group, np.diff(side.bounds)), minlength=total * groups)
    times = times.reshape(total, groups)
    home = np.argmax(times / np.maximum(1, times.sum(axis=0)), axis=1)
    for side in sides:
        foreign = home[side.tokens] != np.repeat(side.group, np.diff(side.bounds))
        side.group[np.diff(np.concatenate(([0], np.cumsum(foreign)))[side.bounds]) >= share * side.n - 1e-9] = -1
        side.arrange(np.lexsort((side.n, side.group)))


def cuts(side: Sets) -> Iterator[tuple[int, int]]:
    """Blocks of sets of one group, smaller ones where sets are so large that their sketches would be."""
    low = 0
    while low < len(side.n):
        many = min(BLOCK_SETS, int(np.searchsorted(side.group, side.group[low], "right")) - low)
        while many > 1 and many * 5 * side.n[low + many - 1] > 8 * COMMON * BLOCK_SETS:
            many //= 2
        yield low, low + many
        low += many


def met_sets(left: Sets, right: Sets, threshold: float, once: bool, total: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row on the left, row on the right, score) of the pairs of sets that reach the threshold; ``once``: both sides are one, each pair counts once.

    Blocks of sets of one group and alike sizes meet. The product of their sketches is never less than what two sets share, and little
    more if there are some times as many columns as tokens; where it would be enough, shared tokens are counted.
    """
    share = threshold / (1 + threshold)
    group_sets([left] if once else [left, right], share, total)
    for low, high in cuts(right):
        there, most = right.n[low:high], int(right.n[high - 1])
        sketches = {}
        for top, end in cuts(left):
            here, more = left.n[top:end], int(left.n[end - 1])
            if once and top > low or -1 < left.group[top] != right.group[low] > -1 or more < threshold * there[0] - 1e-9 or most < threshold * here[0] - 1e-9:
                continue
            columns = COMMON
            while columns * (more + most) < ROOM * more * most:
                columns += max(columns // 4, 1)
            if columns not in sketches:
                sketches = {columns: right.sketch(low, high, columns)}
            upto = left.sketch(top, end, columns) @ sketches[columns].T
            upto -= (share * there).astype(np.float32)
            enough = upto >= (share * here - 1e-2)[:, None].astype(np.float32)
            if once and top == low:
                enough = np.triu(enough, 1)
            i, j = np.nonzero(enough)
            i, j = i + top, j + low
            both, sums = shared_tokens(left, right, i, j, total), left.n[i] + right.n[j]
            score = both / np.maximum(sums - both, 1)
            fine = score >= threshold
            yield i[fine], j[fine], score[fine]


def similar_pairs(left: DataFrame, right: DataFrame, threshold: float, ordered: bool = False) -> DataFrame:
    """(left_id, right_id, score) of all pairs of ``(id, tokens)`` whose Jaccard score reaches the threshold (over 0); ``ordered``: only those whose left id is smaller.

    Exact. Sets are dealt to shards, and each pair of shards meets once in a task, in blocks, so
    that only similar pairs are ever written. Time grows with the number of pairs, memory doesn't; a set is shuffled
    once for each shard of the other side. Ids are told apart.
    """
    return met_pairs(*(coded(left) * 2 if ordered else coded(left, right)), threshold, ordered)


def met_pairs(a: DataFrame, b: DataFrame, threshold: float, ordered: bool) -> DataFrame:
    """The same of sets as ``coded`` gives them."""
    a, b = a.where("n > 0"), b.where("n > 0")
    shards = lambda n: max(1, -(-n // SHARD_SETS), min(TASK_SHARDS, n // (4 * BLOCK_SETS)))
    here, there = (shards(x.count()) for x in (a, b))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    met = a.withColumns({"x": own(here), "side": F.lit(0)}).withColumn("y", others(there))
    if ordered:  # each pair of shards once; a shard meets itself with one side
        met = met.withColumn("z", F.greatest("x", "y")).withColumn("side", (F.col("x") > F.col("y")).cast("int")).withColumn("x", F.least("x", "y")).withColumn("y", F.col("z")).drop("z")
    else:
        met = met.unionByName(b.withColumns({"y": own(there), "side": F.lit(1)}).withColumn("x", others(here)))

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        names = np.unique(np.frombuffer(b"".join(table.column("others").to_pylist()), "<i8"))
        sides = [Sets(table.filter(pc.equal(table.column("side"), k)), names) for k in (0, 1)]
        once = ordered and key[0].as_py() == key[1].as_py()
        one, two = (sides[0], sides[0]) if once else sides
        found = list(met_sets(one, two, threshold, once, SHORT + len(names))) if len(one.n) and len(two.n) else []
        i, j, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        return pa.table({"left_id": one.ids.take(pa.array(i)), "right_id": two.ids.take(pa.array(j)), "score": pa.array(score)})

    kind = a.select(F.col("id").alias("left_id")).limit(0).crossJoin(b.select(F.col("id").alias("right_id")).limit(0)).withColumn("score", F.lit(0.0)).schema
    met = met.select("x", "y", "side", "id", "n", "often", "others")
    if here * there > 1:  # more parts than pairs of shards, so that few tasks get two
        met = met.repartition(4 * here * there, "x", "y")
    pairs = met.groupBy("x", "y").applyInArrow(meet, kind)
    if not ordered:
        return pairs
    return pairs.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "score").where("left_id < right_id")


def leader_clusters(items: DataFrame, threshold: float = 0.35, block: str = "block") -> DataFrame:
    """(block, id, leader, score): greedy clusters in the order of ``pos`` (then id) inside each block.

    Each item not yet taken leads a cluster and takes every later free item whose Jaccard score with it reaches the
    threshold. A cluster's score starts at 1 and is so always 1. ``items``: block, pos, id, tokens. Items of equal tokens share
    the leader of the first of them, so each set of tokens takes part once. All similar pairs are found first; then each round
    makes leaders of the open items without an open earlier neighbour and takes their neighbours, until none is open. No task
    holds a block.
    """
    node = F.struct(F.col(block).alias("block"), "pos", F.col("id").alias("item"))
    named = F.transform(F.coalesce("tokens", F.array().cast("array<string>")), lambda x: F.concat(F.to_json(F.struct(F.col(block))), x))
    (rows,) = coded(items.select(node.alias("id"), named.alias("tokens")))
    rows = materialize(rows.withColumn("key", F.when(F.col("n") > 0, F.sha2(F.concat(F.hex("often"), F.lit(" "), F.hex("others"), F.lit(" "), "n"), 256))))
    sets = materialize(rows.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), *[F.min_by(c, "id").alias(c) for c in ("n", "often", "others")]))
    edges = materialize(met_pairs(sets, sets, threshold, ordered=True).select("left_id", "right_id"))
    open_, live, leaders = materialize(edges.select(F.explode(F.array("left_id", "right_id")).alias("id")).distinct()), edges, None
    while not open_.isEmpty():
        first = materialize(open_.join(live.select(F.col("right_id").alias("id")).distinct(), "id", "left_anti"))
        leaders = first if leaders is None else leaders.unionByName(first)
        took = live.join(first.withColumnRenamed("id", "left_id"), "left_id", "left_semi").select(F.col("right_id").alias("id")).distinct()
        open_ = materialize(open_.join(first, "id", "left_anti").join(took, "id", "left_anti"))
        for end in ("left_id", "right_id"):
            live = live.join(open_.withColumnRenamed("id", end), end, "left_semi")
        live = materialize(live)
    taken = edges if leaders is None else edges.join(leaders.withColumnRenamed("id", "left_id"), "left_id", "left_semi")
    taken = taken.groupBy(F.col("right_id").alias("id")).agg(F.min("left_id").alias("leader"))
    led = sets.select("key", F.col("id").alias("first")).join(taken.withColumnRenamed("id", "first"), "first", "left").select("key", F.coalesce("leader", "first").alias("leader"))
    return rows.join(led, "key", "left").select("id.block", F.col("id.item").alias("id"), F.coalesce("leader.item", "id.item").alias("leader"), F.lit(1.0).alias("score"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors of unequal length, empty or of norm 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.coalesce(F.try_divide(dot(a, b), norm), F.lit(0.0))).otherwise(0.0)


def cosine_topk(index: DataFrame, queries: DataFrame, k: int = 12) -> DataFrame:
    """(query, path, score, rank): the k notes most similar to each query vector, ties to the smaller path.

    ``index``: path, embedding; ``queries``: query, embedding: a stated set that is compared with every note, in blocks:
    notes are dealt to shards and queries to blocks, each pair of which meets once as a matrix product. The query's own
    path, empty vectors and those with null components are left out; vectors of another length than the query's and
    vectors of norm 0 score 0. Each pair of a shard and a block keeps k notes a query.
    """
    dense = lambda c: F.transform(c, lambda x: x.cast("double"))
    fine = "size(embedding) > 0 and not exists(embedding, x -> x is null)"
    left = index.where(fine).select("path", dense(F.col("embedding")).alias("v"))
    right = queries.where(fine).select("query", dense(F.col("embedding")).alias("q"))
    shards, blocks = max(1, -(-left.count() // SHARD_ROWS)), max(1, -(-right.count() // BLOCK_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    notes = left.withColumn("shard", F.pmod(F.xxhash64("path"), F.lit(shards)).cast("int")).withColumn("block", every(blocks))
    asked = right.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).withColumn("shard", every(shards))
    kinds = dict(left.dtypes)["path"], dict(right.dtypes)["query"]

    def meet(some: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values("path", kind="stable")
        paths, sizes = some.path.to_numpy(), some.v.map(len).to_numpy()
        points = {n: np.stack(some.v[sizes == n].to_numpy()) for n in np.unique(sizes)}
        out = {"query": [], "path": [], "score": []}
        for query, q in zip(asked["query"], asked.q, strict=True):
            score = np.zeros(len(paths))
            if (x := points.get(len(q))) is not None:
                norm = np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum())
                score[sizes == len(q)] = np.divide((x * q).sum(axis=1), norm, out=np.zeros(len(x)), where=norm > 0)
            others = np.flatnonzero(paths != query)
            best = others[np.argsort(-score[others], kind="stable")[:k]]
            out["query"] += [query] * len(best)
            out["path"] += paths[best].tolist()
            out["score"] += score[best].tolist()
        return pd.DataFrame(out)

    met = notes.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(meet, f"query {kinds[1]}, path {kinds[0]}, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "path"))
    return met.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def unique_lines(rows: DataFrame, text: str = "text", least: int = 20) -> DataFrame:
    """Rows whose text lost blank lines and repeats of lines of ``least`` characters or more (case and space apart).

    A text's lines are sorted by content, so that a repeat stands behind its first, and brought back in order: no search
    through the lines for each of them, however many there are.
    """
    lines = F.filter(F.transform(F.split(T.or_blank(F.col(text)), "\n"), T.trim_ws), lambda x: x != "")
    entry = F.transform("_lines", lambda x, i: F.struct(T.normalize_ws(x).alias("key"), i.alias("at"), x.alias("line")))
    first = F.zip_with("_sorted", F.concat(F.array(F.lit(None)), F.slice("_sorted", 1, F.greatest(F.size("_sorted") - 1, F.lit(0)))), lambda x, last: F.struct(x["at"].alias("at"), x["line"].alias("line"), (~last["key"].eqNullSafe(x["key"])).alias("new")))
    kept = F.filter(first, lambda x: (F.char_length(x["line"]) < least) | x["new"])
    ordered = F.array_sort(F.transform(kept, lambda x: F.struct(x["at"].alias("at"), x["line"].alias("line"))))
    out = rows.withColumn("_lines", lines).withColumn("_sorted", F.array_sort(entry))
    return out.withColumn(text, F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")).drop("_lines", "_sorted")


def repeated_line_counts(rows: DataFrame, key: str, text: str = "text", least: int = 20) -> DataFrame:
    """(key, lines, repeats): lines of each text that aren't blank, and those that repeat an earlier long one.

    For texts with very many lines: exploded and counted rather than searched in arrays.
    """
    lines = rows.select(key, F.explode(F.split(T.or_blank(F.col(text)), "\n")).alias("line"))
    lines = lines.select(key, T.normalize_ws(F.col("line")).alias("norm"), F.char_length(T.trim_ws(F.col("line"))).alias("n")).where("n > 0")
    counted = lines.groupBy(key, "norm").agg(F.count("*").alias("c"), F.sum(F.when(F.col("n") >= least, 1).otherwise(0)).alias("long"))
    return counted.groupBy(key).agg(F.sum("c").alias("lines"), F.sum(F.greatest(F.lit(0), F.col("long") - 1)).alias("repeats"))


def dedupe_ledger(claims: DataFrame) -> DataFrame:
    """Claims once by (claim, status, path), the first by ``pos``; pending ones go once the claim is accounted for."""
    first = claims.groupBy("run_id", "claim_id", "status", "path").agg(F.min("pos").alias("pos"), F.min_by("reason", "pos").alias("reason"))
    done = first.where(F.col("status").isin("merged", "deduped")).select("run_id", "claim_id").distinct()
    pending = F.col("status") == "pending"
    return first.where(~pending).unionByName(first.where(pending).join(done, ["run_id", "claim_id"], "left_anti"))


def normalize_ledger(claims: DataFrame, default_path: str) -> DataFrame:
    """Unknown statuses become pending with a reason, blank paths the default one."""
    known = F.lower(T.trim_ws(T.or_blank(F.col("status"))))
    fine = known.isin("merged", "deduped", "pending")
    reason = F.when(~fine & T.is_blank(F.col("reason")), "unknown ledger status").otherwise(T.or_blank(F.col("reason")))
    return claims.withColumn("reason", reason).withColumn("status", F.when(fine, known).otherwise("pending")).withColumn("path", T.first_text(F.col("path"), F.lit(default_path)))


def add_missing_claims(claims: DataFrame, expected: DataFrame, reason: str = "claim was not accounted for") -> DataFrame:
    """Claims, and each expected (run_id, claim_id) without a row as pending."""
    missing = expected.select("run_id", "claim_id").distinct().join(claims, ["run_id", "claim_id"], "left_anti")
    return claims.unionByName(missing.withColumns({"status": F.lit("pending"), "path": F.lit(""), "reason": F.lit(reason), "pos": F.lit(None).cast("long")}), allowMissingColumns=True)


def required_models(required: list[str], loaded: DataFrame) -> DataFrame:
    """(model): required models that aren't loaded, without regard to case."""
    want = loaded.sparkSession.createDataFrame([(m,) for m in required if m.strip()], "model string")
    have = loaded.select(F.lower(T.trim_ws(F.col("model"))).alias("key"))
    return want.withColumn("key", F.lower(T.trim_ws(F.col("model")))).join(have, "key", "left_anti").select("model")

