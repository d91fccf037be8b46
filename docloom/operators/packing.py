"""Order-dependent packing: next-fit by duration, note budgets, resumed parts, splits and samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.windows import before_each
from docloom.sources.shared import materialize

#: Items that one task packs, and the whole units of a size by which parts are found ahead.
BLOCK_ROWS, UNITS = 50_000, 1_000_000


def folded_in_order(rows: DataFrame, scope: str, order: str, start: Callable, step: Callable, schema: str) -> DataFrame:
    """What ``step(state, rows of one scope) -> rows`` gives, batch by batch, over each scope's rows in order.

    For folds whose every step needs the one before. A task streams the sorted rows of its scopes and holds a state and
    one batch, so a scope may be of any length; only its narrow rows meet there. ``start()`` makes a new scope's state.
    """

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, key = None, None
        for pdf in it:
            for value, some in pdf.groupby(scope, sort=False, dropna=False):
                if state is None or not (value == key or (pd.isna(value) and pd.isna(key))):
                    state, key = start(), value
                yield step(state, some)

    return rows.repartition(scope).sortWithinPartitions(scope, order).mapInPandas(batches, schema)


def schema_of(rows: DataFrame, more: str) -> str:
    return ", ".join([*(f"`{c}` {kind}" for c, kind in rows.dtypes), more])


def matching(names: list[str], other: str) -> Column:
    """Whether columns equal those with a prefix, nulls included."""
    out = F.lit(True)
    for c in names:
        out = out & F.col(c).eqNullSafe(F.col(f"{other}{c}"))
    return out


def part_starts(rows: DataFrame, scope: list[str], limit: float, block_rows: int) -> DataFrame:
    """(_of_<scope>, _of_block, last): for each block that the packing enters inside a part, the sum before the part's first row.

    ``rows``: scope, _n (place in scope from 0), _p (sum of the sizes before, in whole units), _s. Every row has a pointer to
    the first row that no longer fits a part begun with it, found by merging the sums of rows with those that each part may
    reach. Inside blocks the pointers are followed at once, so of each row by which a block can be entered only the exit is left;
    these exits are doubled by joins, a logarithmic number of times, and what the first row reaches is what packing goes through.
    """
    block = lambda n: F.floor(n / block_rows).cast("long")
    reach = rows.select(*scope, "_n", "_p", (F.col("_p") + F.lit(round(limit * UNITS))).alias("_v"), F.lit(1).alias("_kind"))
    points = reach.unionByName(rows.select(*scope, "_n", "_p", (F.col("_p") + F.col("_s")).alias("_v"), F.lit(0).alias("_kind")))
    met = before_each(points, scope, ["_v", "_kind", "_n"], _to=F.when(F.col("_kind") == 0, 1).otherwise(0).cast("long")).where("_kind = 1")
    to = materialize(met.select(*scope, "_n", "_p", F.greatest("_to", F.col("_n") + 1).alias("_to"), block(F.col("_n")).alias("_block")))
    doors = to.where(block(F.col("_to")) > F.col("_block")).select(*scope, F.col("_to").alias("_door")).unionByName(to.where("_n = 0").select(*scope, F.col("_n").alias("_door"))).distinct()
    doors = doors.withColumn("_block", block(F.col("_door")))
    kinds = dict(rows.dtypes)
    keys = ", ".join(f"`{c}` {kinds[c]}" for c in scope) + (", " if scope else "")

    def contracted(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("_n")
        low, own, sums = int(left._n.iloc[0]) if len(left) else 0, left._to.to_numpy() - (left._n.iloc[0] if len(left) else 0), left._p.to_numpy()
        last, n = np.arange(len(own)), len(own)  # the last row on the way that is still inside
        while len(own):
            inside = own[last] < n
            if not inside.any():
                break
            hop = np.where(inside, own[last], last)
            last = last[hop] if (last[hop] != hop).any() else hop
        at = right._door.to_numpy() - low
        at = at[(at >= 0) & (at < n)]
        return pd.DataFrame({**{c: pd.Series([key[i]] * len(at), dtype=object) for i, c in enumerate(scope)}, "_door": at + low, "_exit": own[last[at]] + low, "_last": sums[last[at]]})

    jump = to.groupBy(*scope, "_block").cogroup(doors.groupBy(*scope, "_block")).applyInPandas(contracted, f"{keys}_door long, _exit long, _last long")
    exits = jump = materialize(jump)
    reached = exits.where("_door = 0").select(*scope, "_door")
    n = -1
    while n != (n := reached.count()):
        ends = jump.select(*[F.col(c).alias(f"_of_{c}") for c in scope], F.col("_door").alias("_from"), F.col("_exit").alias("_next"))
        onward = reached.join(ends, matching(scope, "_of_") & (F.col("_door") == F.col("_from"))).select(*scope, F.col("_next").alias("_door"))
        reached = materialize(reached.unionByName(onward).distinct())
        jump = materialize(jump.join(ends, matching(scope, "_of_") & (F.col("_exit") == F.col("_from"))).select(*scope, "_door", F.col("_next").alias("_exit")))
    through = exits.join(reached.select(*[F.col(c).alias(f"_of_{c}") for c in scope], F.col("_door").alias("_from")), matching(scope, "_of_") & (F.col("_door") == F.col("_from")))
    through = through.select(*scope, block(F.col("_door")).alias("_block"), F.col("_last").alias("last"))
    line = Window.partitionBy(*scope).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.select(*scope, block(F.col("_n")).alias("_block"), F.lit(None).cast("long").alias("last")).distinct().unionByName(through)
    blocks = blocks.groupBy(*scope, "_block").agg(F.max("last").alias("last")).withColumn("last", F.last("last", True).over(line))
    return blocks.where("last is not null").select(*[F.col(c).alias(f"_of_{c}") for c in scope], F.col("_block").alias("_of_block"), "last")


def next_fit(items: DataFrame, scope: str | list[str], size: str, limit: float, pos: str = "pos", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Items with ``part``: in order, a new part begins when the next item would exceed the limit; the sum starts anew.

    An item over the limit has a part of its own; a limit of 0 or less makes one part; null and negative sizes count as 0;
    ``pos`` must tell a scope's items apart. Sums are doubles, added from a part's first item on.

    A scope of any length is spread over tasks by blocks. How much of a part is full where a block begins is found ahead
    by pointer jumping over sums in whole units (``part_starts``); blocks are then packed side by side, and again where what
    the block before really ended with differs, until nothing does.
    """
    scope = [scope] if isinstance(scope, str) else scope
    if limit <= 0:
        return items.withColumn("part", F.lit(0).cast("long"))
    counted = F.greatest(F.coalesce(F.col(size).cast("double"), F.lit(0.0)), F.lit(0.0))
    sized = items.withColumn("_d", counted).withColumn("_s", F.round(F.col("_d") * UNITS).cast("long"))
    rows = materialize(before_each(sized, scope, [pos], _n=F.lit(1).cast("long"), _p=F.col("_s")).withColumn("_block", F.floor(F.col("_n") / block_rows).cast("long")))
    enters = rows.where("false").select(*[F.col(c).alias(f"_of_{c}") for c in scope], F.col("_block").alias("_of_block"), F.lit(0.0).alias("_used"))
    if not rows.where(F.col("_block") > 0).isEmpty():
        starts = part_starts(rows.select(*scope, "_n", "_p", "_s"), scope, limit, block_rows)
        first = rows.where(F.col("_n") % block_rows == 0)
        enters = first.join(starts, matching(scope, "_of_") & (F.col("_block") == F.col("_of_block"))).select(*[f"_of_{c}" for c in scope], "_of_block", ((F.col("_p") - F.col("last")) / UNITS).alias("_used"))
    enters = materialize(enters)
    schema = schema_of(rows.drop("_s", "_p"), "_used double, _opens boolean")

    def packed(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used, begun = 0.0, False
        for pdf in it:
            sums, opens = [], []
            for s, n, enters_with in zip(pdf._d.tolist(), pdf._n.tolist(), pdf._used.tolist(), strict=True):
                if n % block_rows == 0:  # a block's first row
                    used, begun = (0.0, False) if n == 0 else (enters_with, True)
                fresh = not begun or used + s > limit
                used, begun = (s if fresh else used + s), True
                sums.append(used)
                opens.append(fresh)
            yield pdf.assign(_used=sums, _opens=opens)[columns]

    columns = [c for c in rows.columns if c not in ("_s", "_p")] + ["_used", "_opens"]
    while True:
        met = rows.drop("_s", "_p").join(enters, matching(scope, "_of_") & (F.col("_block") == F.col("_of_block")), "left").select(*[c for c in rows.columns if c not in ("_s", "_p")], "_used")
        done = materialize(met.repartition(*scope, "_block").sortWithinPartitions(*scope, "_block", "_n").mapInPandas(packed, schema))  # very many small scopes stream past
        blocks = done.groupBy(*scope, "_block").agg(F.max_by("_used", "_n").alias("_end"), F.sum(F.col("_opens").cast("long")).alias("_parts"))
        line = Window.partitionBy(*scope).orderBy("_block")
        told = materialize(blocks.withColumns({"_used": F.lag("_end").over(line), "_before": F.sum("_parts").over(line) - F.col("_parts")}))
        now = told.where("_block > 0").select(*[F.col(c).alias(f"_of_{c}") for c in scope], F.col("_block").alias("_of_block"), "_used")
        if now.exceptAll(enters).isEmpty():
            break
        enters = now
    told = told.select(*[F.col(c).alias(f"_of_{c}") for c in scope], F.col("_block").alias("_of_block"), "_before")
    own = F.sum(F.col("_opens").cast("long")).over(Window.partitionBy(*scope, "_block").orderBy("_n"))
    return done.withColumn("_own", own).join(told, matching(scope, "_of_") & (F.col("_block") == F.col("_of_block"))).select(*items.columns, (F.col("_before") + F.col("_own") - 1).alias("part"))


def note_budget(notes: DataFrame, scope: str, most_notes: int = 25, most_bytes: int = 120_000, least_rest: int = 1_200) -> DataFrame:
    """(scope, path, taken_bytes): notes taken in path order under a budget of notes and bytes.

    A note that doesn't fit is cut to what is left if that is at least ``least_rest`` bytes; else it is skipped and later,
    smaller ones may still fit. Blank notes are skipped. Lengths are of the trimmed content in bytes.
    """
    size = F.octet_length(T.trim_ws(T.or_blank(F.col("content")))).cast("long")
    sized = notes.select(scope, "path", size.alias("taken_bytes")).where("taken_bytes > 0")

    def step(state: dict, some: pd.DataFrame) -> pd.DataFrame:
        keep, taken = [], []
        for i, n in enumerate(some.taken_bytes.tolist()):
            if state["notes"] >= most_notes or state["left"] <= 0:
                break
            got = n if n <= state["left"] else state["left"] if state["left"] >= least_rest else 0
            if got:
                keep.append(i)
                taken.append(got)
                state["left"] -= got
                state["notes"] += 1
        return some.iloc[keep].assign(taken_bytes=taken)

    return folded_in_order(sized, scope, "path", lambda: {"notes": 0, "left": most_bytes}, step, schema_of(sized, "")[:-2])


def resume_parts(items: DataFrame, limit: float) -> DataFrame:
    """(course, pos, part): items of courses with part numbers, where some parts exist already.

    ``items``: course, pos, duration_s, done_part (null if open). Existing parts keep their numbers. Open items are packed
    next-fit in the gaps between them, never across one; each gap's parts get the smallest free numbers in order: the
    k-th new part the k-th number from 1 that no existing part has, found from the ranks of the existing ones.
    """
    rows = items.select("course", "pos", F.coalesce("duration_s", F.lit(0.0)).cast("double").alias("duration_s"), F.col("done_part").cast("long").alias("done_part"))

    runs = before_each(rows, ["course"], ["pos"], run=F.col("done_part").isNotNull().cast("long"))
    packed = next_fit(runs.where("done_part is null"), ["course", "run"], "duration_s", limit)
    counts = before_each(packed.groupBy("course", "run").agg((F.max("part") + 1).alias("n")), ["course"], ["run"], fresh_before=F.col("n"))
    counts = counts.select(F.col("course").alias("_of_course"), F.col("run").alias("_of_run"), "fresh_before")
    fresh = packed.join(counts, matching(["course", "run"], "_of_")).withColumn("fresh", F.col("fresh_before") + F.col("part") + 1)
    told = fresh.select(*rows.columns, "fresh").unionByName(rows.where("done_part is not null").withColumn("fresh", F.lit(0).cast("long")))
    line = Window.partitionBy("course").orderBy("done_part")
    free_below = rows.where("done_part > 0").select("course", "done_part").distinct().select("course", (F.col("done_part") - F.row_number().over(line)).alias("at"), F.lit(1).alias("taken"))
    wanted = told.where("fresh > 0").select("course", F.col("fresh").alias("at"), F.lit(0).alias("taken")).distinct()
    upto = Window.partitionBy("course").orderBy("at", "taken").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = (F.col("at") + F.sum("taken").over(upto)).alias("number")
    named = wanted.unionByName(free_below).select(F.col("course").alias("of"), F.col("at").alias("nth"), "taken", number).where("taken = 0")
    same = F.col("course").eqNullSafe(F.col("of")) & (F.col("fresh") == F.col("nth"))
    return told.join(named, same, "left").select("course", "pos", F.coalesce("done_part", "number").alias("part"))


def char_limit(total: Column, n: Column, floor: int = 2_500) -> Column:
    """Characters for each of n candidates, no less than the floor."""
    return F.greatest(F.lit(floor), F.floor(total / F.greatest(n, F.lit(1)))).cast("long")


def train_eval(rows: DataFrame, key: str) -> DataFrame:
    """Rows with ``split``: by the order of their hash, the first n div 20 are eval, the rest train.

    The hash's first bits deal rows to ordered parts, so ranks come from the parts' counts and not from one window over
    all rows. Rows of equal hash are ordered by nothing else: keys must be distinct.
    """
    prefix = F.conv(F.substring(key, 1, 3), 16, 10).cast("long")
    parts = rows.withColumn("_part", prefix)
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    line = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    places = counts.select("_part", F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_before"), F.sum("_n").over(every).alias("_all"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    ranked = parts.join(F.broadcast(places), "_part").withColumn("_rank", F.col("_before") + own)  # 4096 parts at most
    few = F.floor(F.col("_all") / 20)
    return ranked.withColumn("split", F.when((F.col("_rank") <= few) & (few < F.col("_all")), "eval").otherwise("train")).drop("_part", "_before", "_all", "_rank")


def sample_rows(rows: DataFrame, limit: int, key: str, seed: int | None = None) -> DataFrame:
    """The first ``limit`` rows by key, or with a seed by a hash of it: a shuffle that can be repeated."""
    order = [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)] if seed is not None else [F.col(key)]
    return rows.orderBy(*order).limit(limit) if limit > 0 else rows
