"""Two tokenizers aligned corpus-wide: each distinct segment is tokenized and aligned once, and alignments are joined back."""

from __future__ import annotations

import hashlib
import json
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from docloom.llm.common import materialize, read
from docloom.llm.lm_scoring import by_size, listed, spread
from docloom.llm.segments import byte_alphabet, byte_level, coded

#: Public vocabularies, read on the driver and sent to the tasks.
BYTE_LEVEL_FILE, PIECES_FILE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Bytes of text in one chunk, whose distinct segments are numbered; a longer text is a chunk of its own.
CHUNK_BYTES = 10_000_000
#: Distinct segments that one call tokenizes or normalizes.
ALIGNED_ROWS = 4096
#: Occurrences of segments that are aligned at once, and linked pairs that a task counts before it adds them up.
GATHERED, HELD_PAIRS = 50_000, 2_000_000
#: Distinct linked id pairs that are sent to every task at once: 24 bytes each.
SENT_PAIRS = 4_000_000
SPACE = "▁"
DOCUMENT, SEGMENT = 0, 1


class Tokenizers:
    """Both tokenizers and the bytes that each of their ids stands for.

    A: byte-level BPE; B: BPE over pieces, in which U+2581 stands for a space and bytes for characters it lacks. Refused are
    vocabularies that could merge across segments (a piece with a space after another character) or lose text.
    """

    def __init__(self, byte_level_spec: str, pieces: bytes):
        self.a = byte_level(byte_level_spec, plain=True)
        of = byte_alphabet()
        vocab = json.loads(byte_level_spec)["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(of[c] for c in token)
        self.b = SentencePieceProcessor(model_proto=pieces)
        ids = range(self.b.get_piece_size())
        of_piece = [self.b.id_to_piece(i) for i in ids]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in zip(ids, of_piece, strict=True)]
        if len({self.b_bytes[i] for i in ids if self.b.is_byte(i)}) < 256 or set(self.a_bytes) < {bytes([k]) for k in range(256)}:
            raise ValueError("a vocabulary lacks bytes")
        if any(SPACE in p.lstrip(SPACE) for p in of_piece) or self.b.normalize("a  b") != f"{SPACE}a{SPACE * 2}b":
            raise ValueError("this vocabulary may merge across the segments")
        self.one_space = self.b.piece_to_id(SPACE)
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))

    def ids(self, some: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """A's and B's ids of segments, each of which begins with a space."""
        a = [e.ids for k in range(0, len(some), ALIGNED_ROWS) for e in self.a.encode_batch_fast(some[k : k + ALIGNED_ROWS], add_special_tokens=False)]
        b = self.b.encode([s[1:] for s in some], num_threads=1)  # B puts the space before a text itself, but not before none
        return a, [x or [self.one_space] for x in b]


def kept(pieces, distinct: list[str]) -> np.ndarray:
    """Whether each segment comes out of B as it went in, which its normalizer alone can change; A changes nothing."""
    same = lambda s: pieces.normalize(s).replace(SPACE, " ") == " " + s
    out = np.ones(len(distinct), bool)
    for k in range(0, len(distinct), ALIGNED_ROWS):
        some = distinct[k : k + ALIGNED_ROWS]
        if not same("".join(some)):
            out[k : k + ALIGNED_ROWS] = [same(s) for s in some]
    return out


class Sizes(NamedTuple):
    """Of each id of A and of B, the bytes that it stands for."""

    a_sizes: np.ndarray
    b_sizes: np.ndarray


class Ids:
    """A's and B's ids of segments, one segment after the other, how many each has, and where their bytes end."""

    def __init__(self, both: Tokenizers | Sizes, a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray):
        self.both, self.a, self.n_a, self.b, self.n_b = both, a, n_a, b, n_b
        self.end_a, self.end_b = np.cumsum(both.a_sizes[a]), np.cumsum(both.b_sizes[b])
        self.ends = self.end_a[np.cumsum(n_a) - 1]

    @classmethod
    def encoded(cls, both: Tokenizers, some: list[str]) -> Ids:
        found = both.ids(some)
        flat = [np.array([i for x in ids for i in x], np.int64) for ids in found]
        for of, ids in zip((both.a_bytes, both.b_bytes), flat, strict=True):
            if b"".join([of[i] for i in ids.tolist()]) != "".join(some).encode():
                raise ValueError("a tokenizer changed a segment")
        sizes = [np.fromiter(map(len, ids), np.int64, len(ids)) for ids in found]
        return cls(both, flat[0], sizes[0], flat[1], sizes[1])

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """(pairs, a << 32 | b; how many each segment has): between any two ends next to each other lies one link."""
        every = np.union1d(self.end_a, self.end_b)
        pairs = self.a[np.searchsorted(self.end_a, every)] << 32 | self.b[np.searchsorted(self.end_b, every)]
        return pairs, np.diff(np.searchsorted(every, self.ends, side="right"), prepend=0)

    def groups(self) -> list[list[str]]:
        """Of each segment the groups, as ``a1,a2|b1``: one ends where an A and a B token end together."""
        shared = np.intersect1d(self.end_a, self.end_b)
        cut_a, cut_b = (np.searchsorted(ends, shared, side="right").tolist() for ends in (self.end_a, self.end_b))
        said_a, said_b = list(map(str, self.a.tolist())), list(map(str, self.b.tolist()))
        every, i, k = [], 0, 0
        for j, m in zip(cut_a, cut_b, strict=True):
            every.append(f"{said_a[i]}|{said_b[k]}" if j == i + 1 and m == k + 1 else f"{','.join(said_a[i:j])}|{','.join(said_b[k:m])}")
            i, k = j, m
        last = np.searchsorted(shared, self.ends, side="right").tolist()
        return [every[i:j] for i, j in zip([0, *last], last, strict=False)]

    def some(self, which: np.ndarray) -> list[np.ndarray]:
        """The ids and numbers of ids of the segments ``which``, as ``Ids`` takes them, in small types."""
        return [small(x) for x in (spread(self.a, self.n_a, which), self.n_a[which], spread(self.b, self.n_b, which), self.n_b[which])]


def small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def packed(arrays: list[np.ndarray]) -> bytes:
    return zstandard.compress(pickle.dumps(arrays), 3)


def unpacked(blob: bytes) -> list[np.ndarray]:
    return [x.astype(np.int64) for x in pickle.loads(zstandard.decompress(blob))]


def in_chunks(docs: DataFrame, sent) -> DataFrame:
    """Rows of two kinds: (chunk, doc_id, codes) of each document, and (chunk, code, segment, n) of each segment that a chunk's documents hold.

    ``codes`` numbers the document's segments in order; a text that is null or empty, or that a tokenizer would change, has none.
    """
    schema = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("codes", pa.binary()), ("code", pa.int32()), ("segment", pa.string()), ("n", pa.int64())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, chunk = SentencePieceProcessor(model_proto=sent.value[1]), TaskContext.get().partitionId() << 32

        def rows(of: int, **columns) -> pa.RecordBatch:
            made = {"chunk": np.full(of, chunk), **columns}
            return pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) if f.name in made else pa.nulls(of, f.type) for f in schema], schema=schema)

        for batch in by_size(it, CHUNK_BYTES):
            words, codes, sizes = coded(batch.column("text"))
            fine, ends = kept(pieces, words), np.cumsum(sizes)
            lost = np.concatenate(([0], np.cumsum(~fine[codes])))
            whole = lost[ends] == lost[ends - sizes]
            counts = np.bincount(codes[np.repeat(whole, sizes)], minlength=len(words))
            often = np.argsort(np.argsort(-counts, kind="stable"), kind="stable")  # frequent segments have small numbers
            own = [packed([small(often[codes[e - n : e]])]) if ok and n else None for e, n, ok in zip(ends.tolist(), sizes.tolist(), whole.tolist(), strict=True)]
            yield rows(len(own), kind=np.full(len(own), DOCUMENT), doc_id=batch.column("doc_id"), codes=own)
            for k in range(0, len(words), 50_000):
                used = np.flatnonzero(counts[k : k + 50_000]) + k
                yield rows(len(used), kind=np.full(len(used), SEGMENT), code=often[used], segment=[words[i] for i in used.tolist()], n=counts[used])
            chunk += 1

    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text") != "", F.concat(F.lit(" "), "text")).otherwise("").alias("text"))
    return one.mapInArrow(batches, "chunk long, kind int, doc_id long, codes binary, code int, segment string, n long")


def aligned(held: DataFrame, sent) -> DataFrame:
    """Rows of two kinds: ``found``, the ids of a run of segments and where they occur, and (a, b, count) of linked id pairs.

    ``held(chunk, code, segment, n)`` is dealt and sorted by segment, so each distinct one is tokenized once (again only where
    a batch begins inside its run); its occurrences, one a chunk, stream past and are never gathered.
    """
    schema = pa.schema([("found", pa.binary()), ("a", pa.int32()), ("b", pa.int32()), ("count", pa.int64())])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, pairs, counts, gathered = None, [], [], []

        def counted() -> pa.RecordBatch:
            keys, at = np.unique(np.concatenate(pairs), return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, at, np.concatenate(counts))
            pairs[:], counts[:] = [keys], [sums]
            return pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.binary()), pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(sums)], schema=schema)

        def found() -> pa.RecordBatch:
            segments_of = pa.concat_arrays([x.column("segment") for x in gathered]).dictionary_encode()
            which = segments_of.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            chunk, code, n = (np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in gathered]) for c in ("chunk", "code", "n"))
            ids = Ids.encoded(both, listed(segments_of.dictionary))
            times = np.bincount(which, n, len(segments_of.dictionary)).astype(np.int64)
            links, each = ids.links()
            pairs.append(links)
            counts.append(np.repeat(times, each))
            blob = packed([*ids.some(np.arange(len(times))), small(which), chunk, small(code)])
            return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary()), *(pa.nulls(1, f.type) for f in list(schema)[1:])], schema=schema)

        rows = 0
        for batch in it:
            both = both or Tokenizers(*sent.value)
            gathered.append(batch)
            rows += batch.num_rows
            if rows >= GATHERED:
                yield found()
                gathered, rows = [], 0
                if sum(map(len, pairs)) > HELD_PAIRS:
                    out = counted()
                    if len(pairs[0]) > HELD_PAIRS // 2:
                        yield out
                        pairs, counts = [], []
        if rows:
            yield found()
        if pairs:
            yield counted()

    dealt = held.repartition("segment").sortWithinPartitions("segment")
    return dealt.mapInArrow(batches, "found binary, a int, b int, count long")


def with_best(pairs: DataFrame) -> DataFrame:
    """(a, b, count, best): the pairs' counts, and whether one is the highest of its id of B."""
    every = pairs.groupBy("a", "b").agg(F.sum("count").alias("count"))
    most = every.groupBy("b").agg(F.max("count").alias("most"))  # a row for each id of B
    return every.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def with_sums(found: DataFrame, best: DataFrame, sizes) -> DataFrame:
    """``found``, its segments with their numbers of links and of best links and their sums of counts.

    The pairs go to every task, SENT_PAIRS at a time: more of them take further passes over ``found``, each of which adds its own.
    """
    spark = found.sparkSession
    passes = max(1, -(-best.count() // SENT_PAIRS))
    for k in range(passes):
        table = best.where(F.pmod(F.xxhash64("a", "b"), F.lit(passes)) == k).toArrow()
        keys = table.column("a").to_numpy().astype(np.int64) << 32 | table.column("b").to_numpy()
        order = np.argsort(keys)
        pairs = spark.sparkContext.broadcast((keys[order], table.column("count").to_numpy()[order], table.column("best").to_numpy()[order].astype(np.int64)))

        def batches(it: Iterator[pa.RecordBatch], pairs=pairs) -> Iterator[pa.RecordBatch]:
            keys, count, best = pairs.value
            for batch in it:
                for blob in batch.column("found"):
                    arrays = unpacked(blob.as_py())
                    links, each = Ids(sizes.value, *arrays[:4]).links()
                    at = np.minimum(np.searchsorted(keys, links), len(keys) - 1)
                    hit, begin = keys[at] == links, np.cumsum(each) - each
                    sums = [np.add.reduceat(np.where(hit, x[at], 0), begin) for x in (best, count)]
                    if len(arrays) > 7:
                        sums = [x + y for x, y in zip(arrays[8:], sums, strict=True)]
                    yield pa.RecordBatch.from_pydict({"found": pa.array([packed([small(x) for x in (*arrays[:7], each, *sums)])], pa.binary())})

        found = found.mapInArrow(batches, "found binary")
        if passes > 1:
            found = materialize(found)
    return found


def by_chunk(found: DataFrame, sizes) -> DataFrame:
    """(chunk, part): for each chunk, of its segments that ``found`` holds the codes, ids, links, best links and count sums."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for blob in batch.column("found"):
                *flat, which, chunk, code, links, best, count = unpacked(blob.as_py())
                ids, order = Ids(sizes.value, *flat), np.argsort(chunk, kind="stable")
                first = np.flatnonzero(np.diff(chunk[order], prepend=-1))
                parts = []
                for own in np.split(order, first[1:]):
                    of = which[own]
                    parts.append(packed([small(code[own]), *ids.some(of), *(small(x[of]) for x in (links, best, count))]))
                yield pa.RecordBatch.from_pydict({"chunk": pa.array(chunk[order[first]]), "part": pa.array(parts, pa.binary())})

    return found.mapInArrow(batches, "chunk long, part binary")


FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def composed(docs: pa.Table, parts: pa.Table, sizes: Sizes) -> pa.Table:
    """doc_id, the sums of FIGURES and groups_sha256 of a chunk's documents, from what its segments were found to be."""
    codes, figures, said = [], [], []
    for blob in parts.column("part").to_pylist():
        code, a, n_a, b, n_b, links, best, count = unpacked(blob)
        groups = Ids(sizes, a, n_a, b, n_b).groups()
        codes.append(code)
        figures.append(np.stack((n_a, n_b, np.fromiter(map(len, groups), np.int64, len(groups)), links, best, count), axis=1))
        said += [";".join(g) for g in groups]
    code = np.concatenate(codes) if codes else np.empty(0, np.int64)
    of, text = np.zeros((code.max(initial=-1) + 1, len(FIGURES)), np.int64), [""] * (code.max(initial=-1) + 1)
    if codes:
        of[code] = np.concatenate(figures)
    for i, t in zip(code.tolist(), said, strict=True):
        text[i] = t
    sums, hashes = np.zeros((docs.num_rows, len(FIGURES)), np.int64), []
    for k, blob in enumerate(docs.column("codes").to_pylist()):
        own = unpacked(blob)[0] if blob else np.empty(0, np.int64)
        sums[k] = of[own].sum(axis=0)
        hashes.append(hashlib.sha256(";".join([text[i] for i in own.tolist()]).encode()).hexdigest() if len(own) else "")
    return pa.table({"doc_id": docs.column("doc_id"), **{c: pa.array(sums[:, k]) for k, c in enumerate(FIGURES)}, "groups_sha256": pa.array(hashes, pa.string())})


def align_documents(docs: DataFrame, byte_level_file: str = BYTE_LEVEL_FILE, pieces_file: str = PIECES_FILE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of ``docs(doc_id, text)``.

    A space and the text are encoded by a byte-level vocabulary (A) and by one of pieces (B). Texts are split before runs of
    spaces, across which neither vocabulary can merge (``Tokenizers`` verifies that), into segments; a chunk of texts is kept
    as numbered distinct segments and sequences of these numbers. The corpus's distinct segments are tokenized and aligned
    once, their linked id pairs counted by occurrences, and what was found is joined back to the chunks, which compose
    their documents. Each chunk holds a segment once, so no segment is a hot key.

    Texts that are null, empty, or that a tokenizer would change (such as those with U+2581) have no tokens: zeros, and an
    empty hash; they count nowhere. Rows that repeat a doc_id each have their row; further columns are ignored; an empty
    table gives no rows.
    """
    spark = docs.sparkSession
    with open(byte_level_file, encoding="utf-8") as f, open(pieces_file, "rb") as g:
        files = (f.read(), g.read())
    both = Tokenizers(*files)
    sent, sizes = spark.sparkContext.broadcast(files), spark.sparkContext.broadcast(Sizes(both.a_sizes, both.b_sizes))
    chunks = materialize(in_chunks(docs, sent))
    held = chunks.where(F.col("kind") == SEGMENT).select("chunk", "code", "segment", "n")
    found = materialize(aligned(held, sent))
    best = materialize(with_best(found.where("count is not null").select("a", "b", "count")))
    parts = by_chunk(with_sums(found.where("found is not null").select("found"), best, sizes), sizes)
    left = chunks.where(F.col("kind") == DOCUMENT).select(F.col("chunk").alias("own"), "doc_id", "codes")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return left.groupBy("own").cogroup(parts.groupBy("chunk")).applyInArrow(lambda own, some: composed(own, some, sizes.value), schema)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(read(spark, sf_dir, "documents"))
