"""Best-fit packing in bulk-synchronous rounds: documents and gaps range-sorted, swept, updated, and swept again."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import materialize, read, text_or_empty
from docloom.llm.lm_scoring import by_size, spread
from docloom.llm.segments import Remembered, byte_lengths, byte_level, coded

#: A public byte-level vocabulary, read on the driver and sent to the tasks.
VOCABULARY_FILE = public_tokenizers.path("byte_bpe_50k.json")
END, CAPACITY = 2, 1024
#: Bytes of texts that are encoded at once.
ENCODED_BYTES = 4_000_000
#: Pieces that one task sweeps, in the mean.
ROWS_A_PART = 100_000
#: Lacking sequences that are opened in one round.
FEW = 8
PLACED, WAITING, GAP = 0, 1, 2
_TURNS = 1 << 31


def pieces_of(docs: DataFrame, vocabulary: str = VOCABULARY_FILE, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of the token sequences of ``docs(doc_id, text)``: ids, then END.

    Sequences of over ``capacity`` are cut into pieces of that length, the first of them shorter where they don't divide.
    A null text counts as empty and has END alone; rows that repeat a doc_id each have their pieces; further columns are
    ignored. Texts are cut into segments that are encoded once per task while remembered, so a long text takes little
    memory beside its ids.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        byte_level(spec := f.read(), plain=False)
    sent = spark.sparkContext.broadcast(spec)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(byte_level(sent.value, plain=False), byte_lengths(sent.value))
        for batch in by_size(it, ENCODED_BYTES):
            distinct, codes, sizes = coded(batch.column("text"))
            which = known.places(distinct)[codes]
            flat = spread(known.pool, known.sizes, which)
            counts = np.concatenate(([0], np.cumsum(known.sizes[which])))[np.concatenate(([0], np.cumsum(sizes)))]
            rows = []
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                ids = np.append(flat[counts[k] : counts[k + 1]], END).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                for piece, to in enumerate(range(first, len(ids) + 1, capacity)):
                    start = max(0, to - capacity) if piece else 0
                    rows.append((doc_id, piece, start, to - start, zlib.crc32(ids[start:to])))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return one.mapInArrow(batches, "doc_id long, piece int, start long, length long, ids_crc32 long")


def dealt(waiting: np.ndarray, gaps: np.ndarray, rows: int, all_open: bool) -> list[tuple]:
    """(kind, size, from turn, to turn, part, splits, quota) by the numbers of waiting pieces and of gaps of each size.

    Sizes fall into ranges from large to small of about ``rows`` pieces, a size with more is split by turn. A range takes the
    smallest gaps that fit it until they hold as much as its pieces do; what is over goes down to the next range. New sequences
    are opened for the largest pieces alone, as a range's pieces fill and half as many as the gaps lack room
    for or the pieces need that no gap fits, so that smaller pieces find gaps in the next round (``all_open``: for any piece).
    """
    top = len(waiting) - 1
    ranges, at = [], 0
    for size in range(top, 0, -1):
        if waiting[size]:
            if not ranges or at + waiting[size] > rows:
                ranges.append([])
                at = 0
            ranges[-1].append(size)
            at += int(waiting[size])
    sizes = np.arange(top + 1)
    left, free = gaps.astype(object), gaps.astype(object)
    new = math.ceil(max(0, int((sizes * waiting).sum()) - int((sizes * gaps).sum())) / top)
    widest = int(np.flatnonzero(gaps).max(initial=0))
    new = max(new, math.ceil(int((sizes * waiting)[widest + 1 :].sum()) / top))  # those fit no gap at all
    new = new if new <= FEW else -(-new // 2)
    plan, first = [], True
    for part, own in enumerate(ranges):
        pieces, volume, took = int(waiting[own].sum()), int((sizes[own] * waiting[own]).sum()), 0
        splits = -(-pieces // rows)
        takes = []
        for size in range(own[-1], top + 1):
            n = min(int(left[size]), -(-(volume - took) // size))
            if n > 0:
                takes.append((size, n))
                took += n * size
                left[size] -= n
            if took >= volume:
                break
        lacks = max(0, volume - took)
        quota = pieces if all_open else min(new, lacks // top // splits * splits or (math.ceil(lacks / top) if first else 0))
        first = first and not quota
        new -= 0 if all_open else quota
        for size in own:
            plan.append((WAITING, size, 0, _TURNS, part, splits, -(-quota // splits)))
        for size, n in takes:
            end = int(gaps[size]) - int(free[size])  # what other ranges took before
            free[size] -= n
            plan.append((GAP, size, end * _TURNS // int(gaps[size]), (end + n) * _TURNS // int(gaps[size]), part, splits, -(-quota // splits)))
    return plan


def swept(some: pa.Table, capacity: int) -> pa.Table:
    """One sweep: each waiting piece, the largest first, goes to its successor, the smallest gap that fits, which shrinks by it.

    Of pieces that want one gap the larger has it, ties by ``row``. A piece without a gap opens a sequence while the quota
    lasts; else it waits.
    """
    kind, size, seq, place, row = (some.column(c).to_numpy().copy() for c in ("kind", "size", "seq", "place", "row"))
    quota = some.column("quota")[0].as_py()
    fits: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room: places in ``rooms``
    has = 0  # bit k: there is a gap of k
    gaps = np.flatnonzero(kind == GAP)
    gaps = gaps[np.argsort(seq[gaps], kind="stable")]
    rooms = seq[gaps].tolist()
    for k, room in enumerate(size[gaps].tolist()):
        fits[room].append(k)
        has |= 1 << room
    docs = np.flatnonzero(kind == WAITING)
    docs = docs[np.lexsort((row[docs], -size[docs]))]
    opened = []
    for i, need, own in zip(docs.tolist(), size[docs].tolist(), row[docs].tolist(), strict=True):
        if above := has >> need:
            room = need + (above & -above).bit_length() - 1
            k = fits[room].pop()
            if not fits[room]:
                has ^= 1 << room
        elif quota > 0:
            quota -= 1
            room, k = capacity, len(rooms)
            rooms.append(own)
            opened.append(i)
        else:
            continue
        kind[i], seq[i], place[i] = PLACED, rooms[k], capacity - room
        if room > need:
            fits[room - need].append(k)
            has |= 1 << (room - need)
    left = np.zeros(len(rooms), size.dtype)
    for room, ks in enumerate(fits):
        left[ks] = room
    size[gaps] = left[: len(gaps)]
    rows = np.concatenate((np.arange(len(kind)), np.array(opened, np.int64)))
    kind = np.concatenate((kind, np.full(len(opened), GAP, kind.dtype)))
    state = {"kind": kind, "size": np.concatenate((size, left[len(gaps) :])), "seq": seq[rows], "place": place[rows], "row": row[rows]}
    out = some.drop_columns(["part", "split", "quota"])
    out = pa.table({c: pa.array(state[c]) if c in state else out.column(c).take(pa.array(rows)) for c in out.column_names})
    return out.filter(pa.array((kind != GAP) | (state["size"] > 0)))


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, rows: int = ROWS_A_PART) -> DataFrame:
    """``pieces`` with sequence_id and offset: rows of ``length`` up to ``capacity`` in few sequences of ``capacity`` at most.

    Every piece of over half the capacity has a sequence of its own, and what it leaves is a gap. In each round, waiting
    pieces and gaps are range-sorted by size (``dealt``), every range is swept by a task of its own (``swept``), and the gaps
    so updated meet the pieces that still wait in the next round. Only the numbers of pieces and gaps of each size, at most
    twice ``capacity``, go to the driver. A round's rows are written to the shared folder. Rows of no length or over
    ``capacity`` are refused. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    columns = pieces.columns
    fields = [F.col("kind").cast("int").alias("kind"), F.col("size").cast("int").alias("size"), "seq", F.col("place").cast("long").alias("place"), "row", *columns]
    numbered = materialize(pieces.withColumn("row", F.monotonically_increasing_id()))
    wrong = numbered.where(f"length is null or length < 1 or length > {capacity}")
    if not wrong.isEmpty():
        raise ValueError("a piece has no length or does not fit a sequence")
    alone = F.col("length") * 2 > capacity
    state = numbered.withColumns({"kind": F.when(alone, PLACED).otherwise(WAITING), "seq": F.when(alone, F.col("row")).otherwise(-1), "place": F.lit(0), "size": F.col("length")})
    left = numbered.where(alone & (F.col("length") < capacity)).withColumns({"kind": F.lit(GAP), "seq": F.col("row"), "place": F.lit(0), "size": F.lit(capacity) - F.col("length")})
    done, state, round_, before = [state.where(alone).select(fields)], state.where(~alone).select(fields).unionByName(left.select(fields)), 0, -1
    schema = state.schema
    while True:
        waiting, gaps = np.zeros(capacity + 1, np.int64), np.zeros(capacity + 1, np.int64)
        for r in state.where(F.col("kind") != PLACED).groupBy("kind", "size").count().collect():
            (waiting if r.kind == WAITING else gaps)[r["size"]] = r["count"]
        if not (now := int(waiting.sum())):
            break
        least = int(np.flatnonzero(waiting)[0])
        gaps[:least] = 0
        plan = spark.createDataFrame(dealt(waiting, gaps, rows, now == before), "kind int, size int, lo long, hi long, part int, splits int, quota int")
        before = now
        turn = F.shiftright(F.xxhash64(F.lit(round_), "row"), 33) + F.lit(_TURNS // 2)
        live = state.where((F.col("kind") == WAITING) | ((F.col("kind") == GAP) & (F.col("size") >= least))).withColumn("turn", turn)
        met = live.join(F.broadcast(plan), (live.kind == plan.kind) & (live["size"] == plan["size"]) & (F.col("turn") >= F.col("lo")) & (F.col("turn") < F.col("hi")), "left")
        met = met.select(*[live[c] for c in schema.names], "part", F.pmod(F.xxhash64("row", F.lit(round_)), "splits").cast("int").alias("split"), "quota")
        after = met.where("part is not null").groupBy("part", "split").applyInArrow(lambda some: swept(some, capacity), schema)
        later = materialize(after.unionByName(met.where("part is null").select(schema.names)))
        done.append(later.where(F.col("kind") == PLACED))
        state, round_ = later, round_ + 1
    out = done[0]
    for some in done[1:]:
        out = out.unionByName(some)
    return out.select(*columns, F.col("seq").alias("sequence_id"), F.col("place").alias("offset"))


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(pieces_of(read(spark, sf_dir, "documents")))
