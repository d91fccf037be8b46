"""Repeated passages by enhanced suffix arrays: common-prefix intervals found by a stack scan."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import in_groups, materialize, read, text_or_empty

MIN_LENGTH = 50
#: Bytes of an anchor. Every passage of MIN_LENGTH bytes holds the anchor that its own bytes alone choose.
ANCHOR = 20
#: Bytes that are hashed at once, few enough for a core's cache, and bytes of texts whose anchors are sent together.
BLOCK, BATCH_BYTES = 1 << 16, 6_000_000
#: Anchors that one task compares, in the mean.
ANCHORS_A_TASK = 300_000
#: Anchors with more occurrences than this send only their distinct contexts to the scan; a key with more of those than
#: this is split by passage.
MANY = 20_000
#: So many occurrences in one batch of documents also make an anchor such a one, before anything is shuffled.
MANY_IN_BATCH = 512
#: Anchor contexts that one step of the suffix sort holds, and that one bucket holds in the mean.
ROWS_A_STEP, ROWS_A_BUCKET = 6_000, 40_000
#: Suffixes that intervals are spread out to at once.
SPREAD = 1_000_000
#: Contexts of frequent anchors whose repeats are sent to every task at most; beyond, they are joined.
SENT_PIECES = 100_000
#: Ids of whole copies that are sent to every task at most; beyond, they are joined. Bytes of contexts that are gathered at once.
SENT_IDS, GATHERED = 4_000_000, 1_000_000
#: Stands for the span of a whole text.
WHOLE = -1
_KEPT_BITS = 40
_U = np.uint64


def _rolled(b: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each ``width`` bytes of ``b``, built by doubling."""
    base, powers = 0x9E3779B97F4A7C15, {1: b.astype(np.uint64) + _U(1)}
    k = 1
    while 2 * k <= width:
        h = powers[k]
        powers[2 * k] = h[:-k] * _U(pow(base, k, 1 << 64)) + h[k:]
        k *= 2
    out, have = powers[k], k
    for k in sorted(powers, reverse=True):
        if have + k <= width:
            n = len(b) - have - k + 1
            out = out[:n] * _U(pow(base, k, 1 << 64)) + powers[k][have : have + n]
            have += k
    out = (out ^ (out >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return out ^ (out >> _U(32))


def anchors(b: np.ndarray, length: int = MIN_LENGTH, width: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, first, last): each anchor's hash, and the first and last start of the passages that choose it.

    A passage of ``length`` bytes chooses the smallest hash among its ``width``-byte substrings, the leftmost on a tie:
    a choice by its own bytes alone, so equal passages in any documents choose alike. Bytes are hashed block by
    block; a run of passages that a block's end cuts comes as two.
    """
    return text_anchors(b, np.array([0, len(b)]), length, width)[:3]


def text_anchors(b: np.ndarray, bounds: np.ndarray, length: int = MIN_LENGTH, width: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, first, last, text): the anchors of all texts of ``b``, text k between bounds k and k + 1; starts count from the start of ``b``.

    Texts are hashed together, whatever their lengths; passages that more than one text holds don't count.
    """
    found = [(np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3)]
    begins, fits = bounds[:-1], bounds[1:] - length  # first and last start of a passage of each text
    for at in range(int(bounds[0]), int(bounds[-1]) - length + 1, BLOCK):
        to = min(at + BLOCK, int(bounds[-1]) - length + 1)
        edges = [x[slice(*np.searchsorted(x, (at, to)))] - at for x in (begins, np.maximum.accumulate(fits + 1))]
        keys, first, last = _block_anchors(b[at : to + length - 1], length, width, np.concatenate(edges))
        first, last = first + at, last + at
        text = np.searchsorted(bounds, first, "right") - 1
        fine = first <= fits[text]
        found.append((keys[fine], first[fine], last[fine], text[fine]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _block_anchors(b: np.ndarray, length: int, width: int, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of ``b``; a run of passages that choose one ends before each of ``edges``."""
    h = _rolled(b, width)
    low = (1 << 24) - 1  # over BLOCK, so that positions fit below the leading bits of the hashes
    span, least = length - width + 1, (h & ~_U(low)) | np.arange(len(h), dtype=np.uint64)
    k = 1
    while 2 * k <= span:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if k < span:
        least = np.minimum(least[: len(h) - span + 1], least[span - k :])
    at = (least & _U(low)).astype(np.int64)
    new = np.concatenate(([True], at[1:] != at[:-1]))
    new[edges] = True
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    # minima are small numbers: multiplied, their leading bits deal them out evenly
    return h[at[first]] * _U(0x9E3779B97F4A7C15), first, last


def kept_bits(bits: int) -> int:
    """Bits of a key after those of its bucket: with them and one more for a flag, a key takes 64 bits at most.

    Fewer kept bits make more anchors look alike, which the bytes around them then tell apart.
    """
    return min(_KEPT_BITS, 63 - bits)


def _prefix(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bucket and the next ``kept_bits`` bits of each key."""
    return keys >> _U(64 - bits - kept_bits(bits))


def bucket_bits(total_bytes: int) -> int:
    """Bits that number the buckets of a corpus of so many bytes."""
    return max(0, int(np.ceil(np.log2(max(1, total_bytes * 0.065 / ANCHORS_A_TASK)))))


def many_in_batch(total_bytes: int) -> int:
    """Occurrences in one batch that make an anchor a frequent one: the more batches, the fewer, so that what a bucket gets of
    one anchor grows with MANY and the number of batches and not with the occurrences in each."""
    batches = max(1, total_bytes // BATCH_BYTES)
    return min(MANY_IN_BATCH, max(2, 10 * MANY // batches))


def _five(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def flat_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a column of binary without nulls: text k lies between bounds k and k + 1."""
    kind = np.dtype(np.int64 if pa.types.is_large_binary(column.type) else np.int32)
    _, bounds, data = column.buffers()
    if not len(column) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8), np.frombuffer(bounds, kind, len(column) + 1, column.offset * kind.itemsize).astype(np.int64)


def binaries(data: bytes, bounds: np.ndarray) -> pa.Array:
    """A column of binary, value k between bounds k and k + 1 of ``data``."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(data)])


def gathered(b: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of ``b`` at each of ``first``, ``size`` of them, one after the other."""
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    cuts = np.flatnonzero(np.diff(ends // GATHERED, prepend=-1))
    for i, j in zip(cuts, [*cuts[1:], len(size)], strict=True):
        low, high = ends[i] - size[i], ends[j - 1]
        out[low:high] = b[np.repeat(first[i:j] - ends[i:j] + size[i:j], size[i:j]) + np.arange(low, high)]
    return out


def without_ids(batch: pa.RecordBatch, gone: np.ndarray) -> pa.RecordBatch:
    """Rows whose doc_id is none of ``gone``, which is sorted."""
    if not len(gone):
        return batch
    ids = batch.column("doc_id").to_numpy()
    return batch.filter(pa.array(gone[np.minimum(np.searchsorted(gone, ids), len(gone) - 1)] != ids))


def by_bucket(keys: np.ndarray, owner: np.ndarray, ids: np.ndarray, bits: int, often_in_batch: int) -> Iterator[pa.RecordBatch]:
    """(dest, docs, counts, keys, many): what a batch of documents sends to each bucket; ``keys`` are prefixes in order of ``owner``, an index into ``ids``.

    Keys are sorted by bucket once, so the cost doesn't grow with the number of buckets.
    """
    kept = kept_bits(bits)
    low, names = _U((1 << kept) - 1), ["dest", "docs", "counts", "keys", "many"]
    unique, which, times = np.unique(keys, return_inverse=True, return_counts=True)
    many = times >= often_in_batch
    often = many[which]
    if often.any():  # known already; these go to any task at all
        for some in np.array_split(np.flatnonzero(often), 1 + often.sum() // 100_000):
            x = ids[owner[some]].tobytes(), b"", keys[some].astype("<u8").tobytes(), b""
            yield pa.RecordBatch.from_arrays([pa.array([-1 - int(ids[owner[some[0]]] & 0x3FF)], pa.int64()), *[pa.array([v], pa.binary()) for v in x]], names)
    rare = np.flatnonzero(~often)
    bucket = (keys[rare] >> _U(kept)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rare, bucket = rare[order], bucket[order]
    of = owner[rare]
    new = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (of[1:] != of[:-1])))[: len(of)])
    told = unique[many]
    told_bucket = (told >> _U(kept)).astype(np.int64)
    every = np.unique(np.concatenate((bucket, told_bucket)))
    upto = lambda x: np.append(np.searchsorted(x, every), len(x))
    runs, n = upto(bucket[new]), np.diff(np.append(new, len(of))).astype("<u4")
    columns = (ids[of[new]].tobytes(), 8 * runs), (n.tobytes(), 4 * runs), (_five(keys[rare] & low), 5 * upto(bucket)), (_five(told & low), 5 * upto(told_bucket))
    yield pa.RecordBatch.from_arrays([pa.array(every), *[binaries(*x) for x in columns]], names)


def shared_anchors(docs: DataFrame, length: int, total_bytes: int, copies: DataFrame | None = None) -> tuple[DataFrame, int]:
    """((doc_id, mark), bits): the anchors of each document that occur elsewhere too; mark is a key's prefix and, in the last bit, whether it has many occurrences.

    Each batch of documents sends five bytes an anchor to the anchor's bucket, so only candidates take part in what
    follows. An anchor frequent in a batch is known to be shared there: it goes to its bucket once and not for each
    occurrence, so a passage in a third of all documents burdens no bucket. ``copies``, by doc_id, are left out.
    """
    gone = np.empty(0, np.int64)
    if copies is not None and copies.count() <= SENT_IDS:
        gone = np.sort(copies.select("doc_id").toPandas().doc_id.to_numpy(np.int64))
    elif copies is not None:
        docs = docs.join(copies.select("doc_id"), "doc_id", "left_anti")
    bits, often_in_batch = bucket_bits(total_bytes), many_in_batch(total_bytes)
    kept = kept_bits(bits)

    def collect(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            batch = without_ids(batch, gone)
            flat, bounds = flat_texts(batch.column("text"))
            ids = batch.column("doc_id").to_numpy().astype(np.int64)
            for some in in_groups(np.diff(bounds).tolist(), BATCH_BYTES):
                keys, _, _, owner = text_anchors(flat, bounds[some.start : some.stop + 1], length)
                if len(keys):
                    yield from by_bucket(_prefix(keys, bits), owner, ids[some], bits, often_in_batch)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        dest = int(pdf.dest.iloc[0])
        docs = np.frombuffer(b"".join(pdf.docs), np.int64)
        if dest < 0:
            keys = np.frombuffer(b"".join(pdf["keys"]), "<u8").astype(np.uint64)
            return pd.DataFrame({"doc_id": docs, "mark": ((keys << _U(1)) | _U(1)).view(np.int64)})
        counts = np.frombuffer(b"".join(pdf.counts), "<u4").astype(np.int64)
        keys = _from_five(b"".join(pdf["keys"]))
        names, which, times = np.unique(keys, return_inverse=True, return_counts=True)
        told = np.isin(names, _from_five(b"".join(pdf.many)))
        shared, many = (told | (times > 1))[which], (told | (times > MANY))[which]
        mark = ((((_U(dest) << _U(kept)) | keys) << _U(1)) | many.astype(np.uint64))[shared]
        return pd.DataFrame({"doc_id": np.repeat(docs, counts)[shared], "mark": mark.view(np.int64)})

    sent = docs.select("doc_id", "text").mapInArrow(collect, "dest long, docs binary, counts binary, keys binary, many binary")
    return materialize(sent.groupBy("dest").applyInPandas(compare, "doc_id long, mark long")), bits


def marked(keys: np.ndarray, marks: np.ndarray, bits: int) -> np.ndarray:
    """Which of ``keys`` have a prefix of ``marks``; most have not, which a table of their last bits tells."""
    known = np.unique(marks.view(np.uint64) >> _U(1))
    table, last = np.zeros(1 << 18, bool), _U((1 << 18) - 1)
    table[(known & last).astype(np.int64)] = True
    prefix = _prefix(keys, bits)
    out = table[(prefix & last).astype(np.int64)]
    maybe = prefix[out]
    out[out] = known[np.minimum(np.searchsorted(known, maybe), len(known) - 1)] == maybe
    return out


def pieces_of(docs: DataFrame, marks: DataFrame, bits: int, length: int, many: bool, batches, schema: str) -> DataFrame:
    """``batches`` over (key, doc_id, start, size, bytes) of the marked anchors of documents: arrays, and the bytes that the anchors' passages span in a row.

    ``many``: only anchors with many occurrences; else the others. A mark that one document has for an anchor, each document
    with that anchor has, so the texts of a batch share theirs.
    """
    of_doc = marks.where(F.col("mark").bitwiseAND(F.lit(1)) == int(many)).groupBy("doc_id").agg(F.collect_set("mark").alias("marks"))

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(it):
            for batch in it:
                flat, bounds = flat_texts(batch.column("text"))
                ids = batch.column("doc_id").to_numpy().astype(np.int64)
                for some in in_groups(np.diff(bounds).tolist()):
                    here = bounds[some.start : some.stop + 1]
                    keys, first, last, text = text_anchors(flat, here, length)
                    if not len(keys):
                        continue
                    at = np.flatnonzero(marked(keys, batch.column("marks").slice(some.start, some.stop - some.start).flatten().to_numpy(), bits))
                    for a in range(0, len(at), 20_000):
                        x = at[a : a + 20_000]
                        size = last[x] - first[x] + length
                        yield keys[x], ids[some][text[x]], first[x] - here[text[x]], size, gathered(flat, first[x], size)

        yield from batches(found(it))

    return docs.join(of_doc, "doc_id").select("doc_id", "text", "marks").mapInArrow(cut, schema)


def contexts(docs: DataFrame, marks: DataFrame, bits: int, length: int, buckets: int) -> DataFrame:
    """(bucket, rows): the bytes around each marked anchor that its passages span, compressed in bundles by bucket of keys."""
    most = min(400_000, max(100_000, 100 * buckets))

    def batches(found) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for x in found:
            held.append(x)
            rows += len(x[0])
            if rows > most:
                yield bundled(held)
                held, rows = [], 0
        if rows:
            yield bundled(held)

    def bundled(held: list[tuple]) -> pa.RecordBatch:
        keys, doc, first, size, flat = (np.concatenate(x) for x in zip(*held, strict=True))
        bucket = ((keys >> _U(40)) * _U(buckets) >> _U(24)).astype(np.int64)
        order = np.lexsort((keys, bucket))
        flat = gathered(flat, (np.cumsum(size) - size)[order], size[order])
        keys, doc, first, size, bucket = (x[order] for x in (keys, doc, first, size, bucket))
        text = np.concatenate(([0], np.cumsum(size)))
        every, begin = np.unique(bucket, return_index=True)
        size, rows = size.astype("<i4"), []
        for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(keys)], strict=True):
            parts = keys[i:j], doc[i:j], first[i:j].astype("<i8"), size[i:j], flat[text[i] : text[j]]
            rows.append(zlib.compress(b"".join((np.int64(j - i).tobytes(), *[x.tobytes() for x in parts])), 1))
        return pa.RecordBatch.from_arrays([pa.array(every), pa.array(rows, pa.binary())], ["bucket", "rows"])

    return pieces_of(docs, marks, bits, length, False, batches, "bucket long, rows binary")


def unbundled(blobs) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(keys, documents, starts, pieces) of a bucket's bundles."""
    keys, docs, starts, pieces = [], [], [], []
    for blob in blobs:
        x = zlib.decompress(blob)
        n = int(np.frombuffer(x, np.int64, 1)[0])
        keys.append(np.frombuffer(x, np.int64, n, 8))
        docs.append(np.frombuffer(x, np.int64, n, 8 + 8 * n))
        starts.append(np.frombuffer(x, np.int64, n, 8 + 16 * n))
        ends = 8 + 28 * n + np.cumsum(np.frombuffer(x, "<i4", n, 8 + 24 * n))
        pieces += [x[a:b] for a, b in zip([8 + 28 * n, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    return np.concatenate(keys), np.concatenate(docs), np.concatenate(starts), pieces


def occurrences(docs: DataFrame, marks: DataFrame, bits: int, length: int) -> DataFrame:
    """(key, doc_id, start, piece): the bytes around each anchor with many occurrences that its passages span."""

    def batches(found) -> Iterator[pa.RecordBatch]:
        for keys, doc, first, size, flat in found:
            piece = binaries(flat.tobytes(), np.concatenate(([0], np.cumsum(size))))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(doc), pa.array(first), piece], ["key", "doc_id", "start", "piece"])

    return pieces_of(docs, marks, bits, length, True, batches, "key long, doc_id long, start long, piece binary")


def suffix_array(pieces: list[bytes], group: np.ndarray, length: int, repeated: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, offset, lcp) of all suffixes of ``length`` bytes or more, sorted by group and content; lcp with the one before.

    ``repeated``: only suffixes whose first ``length`` bytes another one seems to have, by their hash; the others share less
    than ``length`` bytes with any and stand in no common-prefix interval of that depth.
    """
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    most = int(sizes.max())
    words = -(-most // 8)
    flat = np.frombuffer(b"".join(pieces) + bytes(8 * words + 8), np.uint8)
    wide = flat[: len(flat) - 7].astype(np.uint64)
    for k in range(1, 8):
        wide = (wide << _U(8)) | flat[k : len(flat) - 7 + k].astype(np.uint64)
    runs = np.maximum(0, sizes - length + 1)
    piece = np.repeat(np.arange(len(pieces)), runs)
    offset = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    if repeated and len(piece):
        h = _rolled(flat, length)[(np.cumsum(sizes) - sizes)[piece] + offset]
        order = np.argsort(h)
        same = np.concatenate(([False], h[order[1:]] == h[order[:-1]], [False]))
        some = np.sort(order[same[1:] | same[:-1]])
        piece, offset = piece[some], offset[some]
    place, left = (np.cumsum(sizes) - sizes)[piece] + offset, sizes[piece] - offset
    columns = []
    for k in range(words):
        over = np.clip(8 * (k + 1) - left, 0, 8).astype(np.uint64)  # bytes of this word beyond the suffix
        w = wide[place + 8 * k]
        columns.append(np.where(over == 8, _U(0), (w >> (_U(8) * np.minimum(over, _U(7)))) << (_U(8) * np.minimum(over, _U(7)))))
    order = np.lexsort((*columns[::-1], group[piece]))
    lcp, same = np.zeros(len(order), np.int64), np.ones(max(0, len(order) - 1), bool)
    for w in columns:
        differ = w[order[1:]] ^ w[order[:-1]]
        equal = np.where(differ == 0, 8, 0)
        for k in range(1, 8):
            equal += (differ != 0) & (differ < _U(1 << (64 - 8 * k)))
        lcp[1:] += np.where(same, equal, 0)
        same &= differ == 0
    piece, offset, left = piece[order], offset[order], left[order]
    lcp[1:] = np.minimum(lcp[1:], np.minimum(left[1:], left[:-1]))
    lcp[1:][group[piece[1:]] != group[piece[:-1]]] = 0
    return piece, offset, lcp


def prefix_intervals(lcp: list[int], left: list[int], length: int) -> list[tuple[int, int, int]]:
    """(first, last, depth): intervals of suffixes that share ``depth`` >= ``length`` bytes and differ in the byte before.

    One scan with a stack: an entry is an open interval's depth, first suffix and the byte before all its suffixes, or
    -1 once those differ (a suffix at its piece's edge has -1 itself). Intervals with one byte before all of them extend
    to the left and are found there, in full.
    """
    out, stack = [], []
    for i in range(1, len(lcp) + 1):
        depth = lcp[i] if i < len(lcp) else 0
        if depth < length and not stack:
            continue
        first, before = i - 1, left[i - 1]
        while stack and stack[-1][0] > depth:
            top, first, seen = stack.pop()
            before = seen if seen == before else -1
            if before < 0:
                out.append((first, i - 1, top))
        if stack and stack[-1][0] == depth:
            if stack[-1][2] != before:
                stack[-1] = (depth, stack[-1][1], -1)
        elif depth >= length:
            stack.append((depth, first, before))
    return out


def distinct_repeats(pieces: list[bytes], key: np.ndarray, lowest: np.ndarray, length: int, later_only: bool) -> list[tuple]:
    """Repeats across the distinct ``pieces``: arrays (piece, offset, size, first_doc, repeat) of each place of each.

    ``lowest`` is the smallest document of each piece. ``later_only`` gives of each piece only what a smaller document than
    its own smallest holds too, places that overlap as one.
    """
    group = np.unique(key, return_inverse=True)[1]
    some = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1)
    if not len(some):
        return []
    chosen, parts = [pieces[i] for i in some.tolist()], []
    piece, offset, lcp = suffix_array(chosen, group[some], length, repeated=True)
    sizes = np.fromiter(map(len, chosen), np.int64, len(chosen))
    flat = np.frombuffer(b"".join(chosen), np.uint8)
    before = flat[(np.cumsum(sizes) - sizes)[piece] + offset - 1].astype(np.int64)
    before[offset == 0] = -1
    found = prefix_intervals(lcp.tolist(), before.tolist(), length)
    if not found:
        return []
    a, b, depth = np.array(found, np.int64)[np.argsort([d for _, _, d in found], kind="stable")].T
    low_at = lowest[some[piece]]
    low = np.minimum.reduceat(np.append(low_at, 0), np.stack((a, b + 1), 1).ravel())[::2]
    best, best_low = np.zeros(len(piece), np.int64), np.zeros(len(piece), np.int64)
    n = b - a + 1
    cuts = np.flatnonzero(np.diff(np.cumsum(n) // SPREAD, prepend=-1))
    for i, j in zip(cuts, [*cuts[1:], len(n)], strict=True):
        m = n[i:j]
        at = np.repeat(a[i:j], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        which = np.repeat(np.arange(i, j), m)
        if later_only:  # the deepest interval whose first document is smaller than all of the suffix's own
            more = low_at[at] > low[which]
            best[at[more]], best_low[at[more]] = depth[which[more]], low[which[more]]
        else:
            parts.append((some[piece[at]], offset[at], depth[which], low[which], which))
    if later_only and best.any():
        at = np.flatnonzero(best)
        at = at[np.lexsort((offset[at], piece[at]))]
        first = piece[at] * (1 << 40) + offset[at]
        ends = np.maximum.accumulate(first + best[at])
        new = np.flatnonzero(np.concatenate(([True], first[1:] > ends[:-1])))
        size = np.append(ends[new[1:] - 1], ends[-1]) - first[new]
        parts.append((some[piece[at[new]]], offset[at[new]], size, np.minimum.reduceat(best_low[at], new), new))
    return parts


def repeat_groups(pieces: list[bytes], key: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int, later_only: bool):
    """Repeats among ``pieces``: arrays (repeat, first_doc, doc_id, start, size), a row for each occurrence.

    Equal pieces are one in the suffix array; all their occurrences come back. ``later_only`` gives only
    occurrences beyond a repeat's smallest document, with those of a piece that overlap as one.
    """
    code, _ = pd.factorize(np.array([*pieces, None], object)[:-1])
    first_of = np.unique(code, return_index=True)[1]
    lowest, times = np.full(len(first_of), np.iinfo(np.int64).max), np.bincount(code)
    np.minimum.at(lowest, code, doc)
    by_code = np.argsort(code, kind="stable")
    begin = np.cumsum(times) - times
    size = np.fromiter((len(pieces[i]) for i in first_of), np.int64, len(first_of))
    highest = np.zeros(len(first_of), np.int64)
    np.maximum.at(highest, code, doc)
    parts = []

    def tell(codes: np.ndarray, offset: np.ndarray, sizes: np.ndarray, low: np.ndarray, name: np.ndarray) -> None:
        n = times[codes]
        rows = by_code[np.repeat(begin[codes], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        got = np.repeat(name, n), np.repeat(low, n), doc[rows], start[rows] + np.repeat(offset, n), np.repeat(sizes, n)
        if later_only:
            got = tuple(x[got[2] > got[1]] for x in got)
        parts.append(got)

    whole = np.flatnonzero((times > 1) & ((lowest < highest) | (not later_only)))
    tell(whole, np.zeros(len(whole), np.int64), size[whole], lowest[whole], whole)
    for codes, offset, sizes, low, name in distinct_repeats([pieces[i] for i in first_of], key[first_of], lowest, length, later_only):
        tell(codes, offset, sizes, low, len(first_of) + name)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def steps_of_keys(key: np.ndarray) -> Iterator[np.ndarray]:
    """Indexes of rows with whole keys, about ROWS_A_STEP at a time."""
    order = np.argsort(key, kind="stable")
    key, at = key[order], 0
    while at < len(key):
        to = int(np.searchsorted(key, key[min(at + ROWS_A_STEP, len(key)) - 1]))
        to = to if to > at else int(np.searchsorted(key, key[at], "right"))
        if at + ROWS_A_STEP >= len(key):
            to = len(key)
        yield order[at:to]
        at = to


def frequent_repeats(docs: DataFrame, marks: DataFrame, bits: int, length: int, later_only: bool) -> DataFrame:
    """The repeats around anchors with many occurrences, as ``repeated_passages`` gives them.

    Equal contexts are first made one, combined before the shuffle, so that a passage in a third of all documents is one
    row; the distinct contexts of an anchor go through the same scan as the others, and what it finds in a context holds
    for each of its occurrences. An anchor with more than MANY distinct contexts is split further: its contexts' passages
    are compared one by one, an interval of ``length`` bytes being all places of one passage.
    """
    at = materialize(occurrences(docs, marks, bits, length))
    own = at.groupBy("key", "piece").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("times"))
    own = materialize(own)
    contexts_of = own.groupBy("key").agg(F.count("*").alias("n"))
    wide = materialize(contexts_of.where(F.col("n") > MANY).select("key"))
    whole = own.where("low < high" if later_only else "times > 1").select("piece", F.col("low").alias("first_doc"), F.lit(0).cast("long").alias("offset"), F.octet_length("piece").cast("long").alias("size"), F.lit(True).alias("every"), F.xxhash64("piece").alias("repeat_id"))

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"piece": np.empty(0, object), "first_doc": np.empty(0, np.int64), "offset": np.empty(0, np.int64), "size": np.empty(0, np.int64), "repeat_id": np.empty(0, np.int64)})]
        key, low, pieces = pdf.key.to_numpy(np.int64), pdf.low.to_numpy(np.int64), pdf.piece.tolist()
        for some in steps_of_keys(key):
            for codes, offset, size, first, name in distinct_repeats([pieces[i] for i in some.tolist()], key[some], low[some], length, later_only):
                out.append(pd.DataFrame({"piece": [pieces[i] for i in some[codes].tolist()], "first_doc": first, "offset": offset, "size": size, "repeat_id": name + (int(key[some[0]]) >> 20 << 20)}))
        return pd.concat(out, ignore_index=True)

    narrow = own.join(wide, "key", "left_anti")
    buckets = max(1, narrow.count() // ROWS_A_BUCKET)
    inside = narrow.select("key", "piece", "low", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")).groupBy("bucket").applyInPandas(scan, "piece binary, first_doc long, offset long, size long, repeat_id long")
    found = whole.unionByName(inside.withColumn("every", F.lit(not later_only)))
    if not wide.isEmpty():
        starts = F.sequence(F.lit(1), F.octet_length("piece") - length + 1)
        one = own.join(wide, "key").select("piece", "low", "times", F.explode(starts).alias("from"))
        one = materialize(one.select("piece", "low", "times", (F.col("from") - 1).cast("long").alias("offset"), F.substring("piece", F.col("from"), F.lit(length)).alias("passage")))
        first = one.groupBy("passage").agg(F.min("low").alias("first_doc"), F.sum("times").alias("all"))
        split = one.join(first.where(F.col("all") > 1), "passage").where("low > first_doc" if later_only else "true")
        found = found.unionByName(split.select("piece", "first_doc", "offset", F.lit(length).cast("long").alias("size"), F.xxhash64("passage").alias("repeat_id"), F.lit(not later_only).alias("every")))
    found = materialize(found.join(own.groupBy("piece").agg(F.min("low").alias("low")), "piece"))
    met = at.join(F.broadcast(found) if found.count() <= SENT_PIECES else found, "piece")
    if later_only:  # what lies in a smaller document than all of a context's own only tells of its first; the rest goes whole
        met = met.where("doc_id > first_doc and (every or doc_id = low)")
    return met.select("repeat_id", "first_doc", "doc_id", (F.col("start") + F.col("offset")).alias("start"), "size")


def later_copies(docs: DataFrame, length: int) -> tuple[DataFrame, int]:
    """((doc_id), bytes): documents of ``length`` bytes or more whose whole text a smaller doc_id has too, and the bytes of all others."""
    named = materialize(docs.select("doc_id", F.octet_length("text").cast("long").alias("size"), F.unhex(F.sha2("text", 256)).alias("name")))
    twice = named.where(F.col("size") >= length).groupBy("name").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1").select("name", "low")
    copies = materialize(named.join(twice, "name").where("doc_id > low").select("doc_id", "size"))
    whole, less = (x.agg(F.sum("size")).first()[0] or 0 for x in (named, copies))
    return copies, whole - less


def repeated_passages(docs: DataFrame, length: int = MIN_LENGTH, later_only: bool = False, copies: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """(repeat_id, first_doc, doc_id, start, size): groups of equal passages of ``length`` bytes or more, with all occurrences.

    ``docs`` is (doc_id, text as binary). Anchors that occur twice are found first; the bytes around them meet by bucket of
    anchors, and each task sorts their suffixes and reads the common-prefix intervals off a stack scan. A group is maximal within
    its anchor's reach (passages that choose the same anchor); longer repeats come as groups that overlap. Of anchors with
    many occurrences only the distinct contexts are scanned. ``later_only`` gives only what lies beyond each group's
    smallest document. ``copies``, by doc_id, are left out; ``total`` is the bytes of the others.
    """
    if total is None:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    marks, bits = shared_anchors(docs, length, total, copies)

    buckets = max(1, marks.count() // ROWS_A_BUCKET)

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        key, doc, start, pieces = unbundled(pdf["rows"])
        out = []
        for some in steps_of_keys(key):
            repeat, low, d, a, size = repeat_groups([pieces[i] for i in some.tolist()], key[some], doc[some], start[some], length, later_only)
            out.append(pd.DataFrame({"repeat_id": repeat + (int(key[some[0]]) >> 20 << 20), "first_doc": low, "doc_id": d, "start": a, "size": size}))
        return pd.concat(out, ignore_index=True)

    schema = "repeat_id long, first_doc long, doc_id long, start long, size long"
    few = contexts(docs, marks, bits, length, buckets).groupBy("bucket").applyInPandas(scan, schema)
    if marks.where(F.col("mark").bitwiseAND(F.lit(1)) == 1).isEmpty():
        return few
    return few.unionByName(frequent_repeats(docs, marks, bits, length, later_only))


def without_repeats(docs: DataFrame, length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans of each document.

    A byte goes if a passage of ``length`` bytes that covers it also starts in a document with a smaller doc_id, judged on
    the input. ``spans`` lists the maximal removed runs as (start, size). Null text counts as empty; documents shorter than
    ``length`` lose nothing; rows that repeat a doc_id are one document, with the text first by order; rows without a
    doc_id are left out; an empty table gives no rows. A document that repeats a smaller one whole loses all its bytes
    and tells nothing of others that the smaller one doesn't, so its passages aren't looked for.
    """
    one = docs.where("doc_id is not null").select("doc_id", text_or_empty().alias("text"))
    if not one.groupBy("doc_id").count().where("count > 1").isEmpty():  # else no text is shuffled for it
        one = one.groupBy("doc_id").agg(F.min("text").alias("text"))
    one = one.select("doc_id", F.col("text").cast("binary").alias("text"))
    span = F.shiftleft("start", 20).bitwiseOR(F.col("size"))
    copies, total = later_copies(one, length)
    spans = repeated_passages(one, length, True, copies, total).groupBy("doc_id").agg(F.collect_set(span).alias("found"))
    spans = spans.unionByName(copies.select("doc_id", F.array(F.lit(WHOLE).cast("long")).alias("found")))

    def strip(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = {"n_removed": [], "n_spans": [], "kept_sha256": [], "spans": []}
            for text, found in zip(pdf.text, pdf.found, strict=True):
                runs = [(0, len(text))] if found is not None and len(found) == 1 and found[0] == WHOLE else merged_spans(found)
                digest, at = hashlib.sha256(), 0
                for a, b in runs:
                    digest.update(text[at:a])
                    at = b
                digest.update(text[at:])
                out["n_removed"].append(sum(b - a for a, b in runs))
                out["n_spans"].append(len(runs))
                out["kept_sha256"].append(digest.hexdigest())
                out["spans"].append([{"start": a, "size": b - a} for a, b in runs])
            yield pd.DataFrame({"doc_id": pdf.doc_id, "n_bytes": pdf.text.map(len)} | out)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, size: long>>"
    return one.join(spans, "doc_id", "left").mapInPandas(strip, schema)


def merged_spans(found) -> list[tuple[int, int]]:
    """Maximal runs (first, end) that spans, each start << 20 | size, cover; spans that touch are one run."""
    if found is None or not len(found):
        return []
    spans = np.asarray(found, np.int64)
    a, sizes = spans >> 20, spans & ((1 << 20) - 1)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate((a + sizes)[order])
    new = np.concatenate(([True], a[1:] > b[:-1]))
    return list(zip(a[new].tolist(), np.append(b[:-1][new[1:]], b[-1]).tolist(), strict=True))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read(spark, sf_dir, "documents")).drop("spans")


OP1_SQL = """
WITH d AS (SELECT doc_id, encode(min(coalesce(text, ''))) AS b FROM documents WHERE doc_id IS NOT NULL GROUP BY 1),
s AS (SELECT doc_id, i, b[i + 1 : i + 50] AS k FROM (SELECT doc_id, b, unnest(range(0, greatest(0, octet_length(b) - 49))) AS i FROM d)),
m AS (SELECT k, min(doc_id) AS low FROM s GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
r AS (SELECT s.doc_id, s.i, lag(s.i) OVER (PARTITION BY s.doc_id ORDER BY s.i) AS last FROM s JOIN m ON m.k = s.k WHERE s.doc_id > m.low),
n AS (SELECT doc_id, i, sum(CASE WHEN last IS NULL OR i > last + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
g AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM n GROUP BY 1, 2),
p AS (SELECT g.doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY g.doc_id ORDER BY a), 0) AS begun FROM g),
c AS (SELECT p.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(hex(d.b[begun + 1 : a]), '' ORDER BY a) AS kept, max(z) AS z FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY 1)
SELECT d.doc_id, octet_length(d.b) AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  CASE WHEN c.doc_id IS NULL THEN sha256(d.b) ELSE sha256(unhex(c.kept || hex(d.b[c.z + 1 : octet_length(d.b)]))) END AS kept_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id
"""
