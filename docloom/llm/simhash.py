"""SimHash near-duplicates by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import connected_components, materialize, read, text_or_empty, word_blocks

BITS = 64
#: Node pairs that one step of the trie walk holds at most; more are put aside on a stack.
FRONTIER = 500_000
_ONE_A_BYTE = np.uint64(0x0101010101010101)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of ``hashes`` have each bit: [bit of a byte, byte]."""
    counts = np.zeros((8, 8), np.int64)
    for at in range(0, len(hashes), 255):  # byte lanes hold up to 255
        some = hashes[at : at + 255]
        for k in range(8):
            lanes = np.add.reduce((some >> np.uint64(k)) & _ONE_A_BYTE)
            counts[k] += np.frombuffer(int(lanes).to_bytes(8, "little"), np.uint8)
    return counts


def fingerprint(text: bytes, width: int = 4) -> int:
    """The bits that over half of the shingles' hashes have; texts of any length, block by block."""
    counts, n, words, digest = np.zeros((8, 8), np.int64), 0, [], xxhash.xxh64_intdigest
    for block in word_blocks(text.lower()):
        words += block
        if len(words) < width:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
        starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
        counts += bit_counts(np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64))
        n += len(starts)
        words = words[len(words) - width + 1 :]
    if not n:
        return digest(b" ".join(words), 42) if words else 0
    return sum(1 << (8 * byte + k) for k in range(8) for byte in range(8) if 2 * counts[k, byte] > n)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp: the 64 bits as a signed long) of each row; null text counts as empty, texts without words get 0."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            fps = np.array([fingerprint(t) for t in pdf.text], np.uint64)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "fp": fps.view(np.int64)})

    return docs.select("doc_id", text_or_empty().cast("binary").alias("text")).mapInPandas(batches, "doc_id long, fp long")


def trie_pairs(fps: np.ndarray, starts: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``budget`` differing bits, inside each bucket of ``fps``.

    ``fps`` is sorted in each bucket, and bucket i spans ``starts[i]:starts[i+1]``. A trie node is a range of the array;
    the walk takes pairs of nodes of one depth (a node with itself at first), splits both by the next bit, adds one
    error where their bits differ and drops the pair beyond the budget. Pairs of single leaves are settled at once.
    """
    a, b = starts[:-1], starts[1:]
    more = b - a > 1
    a, b = a[more].astype(np.int64), b[more].astype(np.int64)
    stack = [(0, a, b, a, b, np.zeros(len(a), np.int8))]
    while stack:
        level, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(level, *(x[half:] for x in (a0, a1, b0, b1, err))), (level, *(x[:half] for x in (a0, a1, b0, b1, err)))]
            continue
        alone = (a1 - a0 == 1) & (b1 - b0 == 1)
        if alone.any():
            i, j = a0[alone], b0[alone]
            near = np.bitwise_count(fps[i] ^ fps[j]) <= budget
            near &= i != j
            if near.any():
                yield i[near], j[near]
            a0, a1, b0, b1, err = (x[~alone] for x in (a0, a1, b0, b1, err))
        if level == BITS or not len(a0):
            continue
        ones = np.concatenate(([0], np.cumsum((fps >> np.uint64(BITS - 1 - level)) & np.uint64(1)).astype(np.int64)))
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        own = a0 == b0
        parts = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1)]
        rest = ~own
        parts.append((am[rest], a1[rest], b0[rest], bm[rest], err[rest] + 1))
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
        keep = (joined[0] < joined[1]) & (joined[2] < joined[3]) & (joined[4] <= budget)
        keep &= ~((joined[0] == joined[2]) & (joined[1] - joined[0] == 1))
        stack.append((level + 1, *(x[keep] for x in joined)))


def merged(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``labels`` after joining i with j; a label is the smallest index of its set."""
    while True:
        x, y = labels[i], labels[j]
        differ = x != y
        if not differ.any():
            return labels
        np.minimum.at(labels, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while not np.array_equal(up := labels[labels], labels):
            labels = up


def forest(fps: np.ndarray, starts: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the near pairs connect: each fingerprint with the first of its set."""
    labels = np.arange(len(fps))
    for i, j in trie_pairs(fps, starts, budget):
        labels = merged(labels, i, j)
    linked = np.flatnonzero(labels != np.arange(len(fps)))
    return fps[linked], fps[labels[linked]]


def linked_fingerprints(distinct: DataFrame, budget: int = 4, rows_a_task: int = 40_000) -> DataFrame:
    """Edges (a, b) between different ``fp`` values whose connected components are those of all pairs within ``budget``.

    Two fingerprints that differ in at most ``budget`` bits agree on one of budget + 1 blocks of bits. Each is dealt
    out once for each block, by the block's value; every bucket walks its own trie against itself.
    """
    blocks = budget + 1
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    keys = [
        F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", edges[k]).bitwiseAND(F.lit((1 << (edges[k + 1] - edges[k])) - 1)).alias("value"))
        for k in range(blocks)
    ]
    dealt = distinct.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", (F.col("key.value") * blocks + F.col("key.block")).alias("key"))

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
            starts = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
            a, b = forest(fp, starts, budget)
            return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

        key, fp = np.empty(0, np.int64), np.empty(0, np.uint64)
        for pdf in it:
            key = np.concatenate((key, pdf.key.to_numpy(np.int64)))
            fp = np.concatenate((fp, pdf.unsigned.to_numpy(np.int64).view(np.uint64) ^ np.uint64(1 << 63)))
            if len(key) >= rows_a_task:  # the last bucket may go on
                done = int(np.searchsorted(key, key[-1]))
                if done:
                    yield solve(key[:done], fp[:done])
                    key, fp = key[done:], fp[done:]
        if len(key):
            yield solve(key, fp)

    # flipping the top bit makes the signed order that of the unsigned numbers
    dealt = dealt.select("key", F.col("fp").bitwiseXOR(F.lit(-(1 << 63))).alias("unsigned"))
    return dealt.repartition("key").sortWithinPartitions("key", "unsigned").mapInPandas(batches, "a long, b long")


def simhash_components(docs: DataFrame, budget: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of each row of ``docs``.

    Texts with equal fingerprints are one node; the trie self-join links different fingerprints within ``budget`` bits,
    and connected components follow. component_id is the smallest doc_id of a component. Null text counts as empty;
    texts without words share fingerprint zero; a null doc_id never names a component that has another; repeated rows
    fall together; an empty table gives no rows.
    """
    of = materialize(fingerprints(docs))
    nodes = of.groupBy("fp").agg(F.min("doc_id").alias("low"))
    edges = linked_fingerprints(of.select("fp").distinct(), budget)
    component = materialize(connected_components(edges)).select(F.col("node").alias("fp"), "component")
    named = nodes.join(component, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = named.groupBy("component").agg(F.min("low").alias("component_id"))
    by_fp = named.join(lowest, "component").select("fp", "component_id")
    return of.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))
