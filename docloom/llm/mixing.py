"""Mixing overlapping sources to target weights by min-cost flow over membership patterns."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import WORD, connected_components, materialize, read, text_or_empty
from docloom.operators.windows import before_each

#: Cost of a word's first, second and third use: convex, so that nothing repeats while unused words are left.
REPEAT_COSTS = (0, 1, 3)
#: Rows of a pattern that share one part of the seeded order.
ROWS_A_PART = 50_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def capped_targets(sizes: dict, weights: dict, cap: float = 3.0) -> dict:
    """Share the sum of ``sizes`` by ``weights``; no key gets over ``cap`` times its size, its excess is shared anew."""
    left, open_, out = float(sum(sizes.values())), set(sizes), {}
    while open_:
        total = sum(weights[k] for k in open_)
        want = {k: left * weights[k] / total for k in open_}
        over = {k for k in open_ if want[k] > cap * sizes[k]}
        if not over:
            return out | want
        for k in sorted(over, key=str):
            out[k] = cap * sizes[k]
            left -= out[k]
        open_ -= over
    return out


def min_cost_flow(patterns: dict[str, tuple[list, int]], quotas: dict, costs=REPEAT_COSTS) -> dict[str, int]:
    """Words to take from each pattern: ``patterns`` maps a name to (its sources, its words), ``quotas`` a source to words.

    Successive shortest paths with potentials: source -> pattern (one edge per repetition, ``costs`` rising) ->
    quota -> sink. The flow is the largest possible, and the cheapest of those.
    """
    names, sources = sorted(patterns), sorted(quotas, key=lambda s: (s is None, s or ""))
    number = {s: 1 + len(names) + i for i, s in enumerate(sources)}
    sink, graph = 1 + len(names) + len(sources), [[] for _ in range(2 + len(names) + len(sources))]

    def edge(a: int, b: int, room: int, cost: int) -> list:
        forth, back = [b, room, cost, len(graph[b])], [a, 0, -cost, len(graph[a])]
        graph[a].append(forth)
        graph[b].append(back)
        return forth

    uses = {}
    for i, p in enumerate(names):
        members, words = patterns[p]
        uses[p] = [edge(0, 1 + i, words, c) for c in costs]
        for s in members:
            if s in number:
                edge(1 + i, number[s], words * len(costs), 0)
    for s in sources:
        edge(number[s], sink, quotas[s], 0)
    height = [0] * len(graph)
    while True:
        far, came, queue = [float("inf")] * len(graph), [None] * len(graph), [(0, 0)]
        far[0] = 0
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for k, (b, room, cost, _) in enumerate(graph[a]):
                if room > 0 and (n := d + cost + height[a] - height[b]) < far[b]:
                    far[b], came[b] = n, (a, k)
                    heapq.heappush(queue, (n, b))
        if came[sink] is None:
            break
        height = [h + (f if f < float("inf") else 0) for h, f in zip(height, far, strict=True)]
        path, b = [], sink
        while b:
            a, k = came[b]
            path.append(graph[a][k])
            b = a
        room = min(e[1] for e in path)
        for e in path:
            e[1] -= room
            graph[e[0]][e[3]][1] += room
    return {p: sum(patterns[p][1] - e[1] for e in uses[p]) for p in names}


def shared_targets(sizes: DataFrame, cap: float = 3.0) -> DataFrame:
    """``sizes(source, size, weight)`` with ``target``: ``capped_targets`` over any number of sources.

    A source is capped if its weight at the common rate gives more than ``cap`` times its size. The rate follows from the
    capped sources and only grows, so it is found in a few aggregates over the sources.
    """
    sizes, weight, most = materialize(sizes), F.col("weight").cast("double"), F.col("size") * F.lit(float(cap))
    rate, capped = 0.0, -1
    while True:
        over = weight * rate > most
        r = sizes.agg(F.sum("size").alias("all"), F.sum(F.when(over, most)).alias("used"), F.sum(F.when(~over, weight)).alias("open"), F.count_if(over).alias("n")).first()
        if r.n == capped or not r.open:
            return sizes.withColumn("target", F.when(over, most).otherwise(weight * rate))
        rate, capped = (r["all"] - (r.used or 0.0)) / r.open, r.n


def flows(patterns: DataFrame, targets: DataFrame, costs: tuple) -> DataFrame:
    """(pattern, taken): words to take from each pattern, by ``min_cost_flow``.

    Sources that patterns tie together, directly or through others, form a component, found by Spark; a source that no other
    shares documents with is one by itself. Each component is a flow of its own, solved by a task from figures of its patterns
    and never of documents, so neither the driver nor one task holds all patterns unless they all hang together.
    """
    key = lambda source: F.concat(F.when(source.isNull(), "n").otherwise("s"), F.coalesce(source, F.lit("")))
    named = patterns.where("size(members) > 0").withColumn("keys", F.transform("members", key))
    ties = named.where("size(keys) > 1").select(F.col("keys")[0].alias("a"), F.explode(F.slice("keys", 2, F.size("keys"))).alias("b"))
    tied = connected_components(ties)
    own = named.withColumn("node", F.col("keys")[0]).join(tied, "node", "left").withColumn("component", F.coalesce("component", "node"))
    left = own.groupBy("component").agg(F.collect_list(F.struct("pattern", "members", "words")).alias("patterns"))
    wanted = targets.select("source", F.round("target").cast("long").alias("quota"), key(F.col("source")).alias("node")).join(tied, "node", "left")
    right = wanted.groupBy(F.coalesce("component", "node").alias("component")).agg(F.collect_list(F.struct("source", "quota")).alias("quotas"))

    def solved(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = batch.to_pylist()
            taken = [x for r in rows for x in min_cost_flow({p["pattern"]: (p["members"], p["words"]) for p in r["patterns"]}, {q["source"]: q["quota"] for q in r["quotas"]}, costs).items()]
            yield pa.RecordBatch.from_pydict({"pattern": pa.array([p for p, _ in taken], pa.string()), "taken": pa.array([n for _, n in taken], pa.int64())})

    return left.join(right, "component").select("patterns", "quotas").mapInArrow(solved, "pattern string, taken long")


def mix(docs: DataFrame, sources: Column, size: Column, weigh, cap: int = 3, seed: int = 7, passing: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, pattern, size, source_size, target and taken, with the columns ``passing``, of each row of ``docs``.

    ``sources``: array of the sources that a document belongs to (nulls count as a source of their own); ``size``: its
    words; ``weigh(sizes)``: for a frame of source and size, that frame with ``weight``, or a dict of weights. Documents are
    aggregated by membership pattern; the patterns' words are routed to the sources' quotas by min-cost flow. Each pattern
    then takes whole rounds of all its documents and, for the rest, documents in an order seeded by ``seed``: the last of
    these gives only the words still needed. The order is cut into parts by a hash, so that a pattern with a third of all
    rows is summed by part, not in one window. ``source_size`` and ``target`` are those of the first source, 0 for
    documents of none, which take nothing like documents without words; repeated rows count as often as they stand; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    sized = materialize(docs.select("doc_id", *passing, F.array_sort(F.array_distinct(F.coalesce(sources, F.array().cast("array<string>")))).alias("members"), F.coalesce(size, F.lit(0)).cast("long").alias("size")))
    base = sized.withColumn("turn", F.xxhash64(F.lit(seed), F.col("doc_id"))).withColumn("pattern", F.to_json("members"))
    found = materialize(base.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("words"), F.count("*").alias("rows")))
    sizes = found.select(F.explode("members").alias("source"), "words").groupBy("source").agg(F.sum("words").alias("size"))
    weighed = weigh(sizes)
    if isinstance(weighed, dict):
        named = spark.createDataFrame([(s, float(w)) for s, w in weighed.items()], "of string, weight double")
        weighed = sizes.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    targets = materialize(shared_targets(weighed, cap))
    figures = found.agg(F.sum(F.when(F.size("members") > 0, F.col("words"))).alias("words"), F.max("rows").alias("rows")).first()
    share = (figures.words or 0) / max(1, targets.agg(F.sum("size")).first()[0] or 0)  # words in several sources count once
    targets = targets.withColumn("target", F.col("target") * share)
    taken = flows(found, targets, REPEAT_COSTS[:cap] + tuple(range(6, 3 * cap, 3))[: max(0, cap - 3)])
    first = targets.select(F.col("source").alias("of"), F.col("size").alias("source_size"), "target")
    plan = found.join(taken, "pattern", "left").join(first, (F.size("members") > 0) & F.get("members", F.lit(0)).eqNullSafe(F.col("of")), "left")
    whole, words = F.coalesce("taken", F.lit(0)), F.greatest(F.lit(1), F.col("words"))
    plan = plan.select("pattern", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), F.floor(whole / words).cast("long").alias("rounds"), (whole % words).alias("rest"))
    # the upper bits of the turn make the parts, so that parts and turns give one order
    parts = max(4096, (figures.rows or 0) // ROWS_A_PART)
    base = base.withColumn("turn", F.shiftrightunsigned("turn", 1)).withColumn("part", F.floor(F.shiftright("turn", 32) * F.lit(parts) / F.lit(1 << 31)).cast("long"))
    sums = base.groupBy("pattern", "part").agg(F.sum("size").alias("here"))
    before = sums.select("pattern", "part", (F.sum("here").over(Window.partitionBy("pattern").orderBy("part")) - F.col("here")).alias("before"))
    order = Window.partitionBy("pattern", "part").orderBy("turn", "doc_id", "size", *passing).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = base.withColumn("upto", F.sum("size").over(order))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before") - F.col("upto") + F.col("size")))
    return within.join(before.join(plan, "pattern"), ["pattern", "part"]).select("doc_id", *passing, "pattern", "size", "source_size", "target", (F.col("rounds") * F.col("size") + extra).cast("long").alias("taken"))


def weights_in_turn(sizes, turn=(5, 2, 1)):
    """Weights 5, 2, 1, repeating, over the sources by code point, null last: of a dict of sizes as a dict, of a frame as its column ``weight``."""
    if isinstance(sizes, dict):
        return {s: turn[i % len(turn)] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    placed = before_each(sizes.withColumn("none", F.col("source").isNull()), [], ["none", "source"], place=F.lit(1).cast("long"))
    return placed.select("source", "size", F.get(F.array(*[F.lit(w) for w in turn]), (F.col("place") % len(turn)).cast("int")).alias("weight"))


def mix_documents(docs: DataFrame, passing: tuple[str, ...] = ()) -> DataFrame:
    """``mix`` by ``source`` and the words of ``text``, weights 5, 2, 1 in turn; a null source is a source, a null text has no words."""
    return mix(docs, F.array("source"), word_count(text_or_empty()), weights_in_turn, passing=passing)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(read(spark, sf_dir, "documents")).drop("pattern")
