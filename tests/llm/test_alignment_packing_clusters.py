"""Alignment of tokenizers, best-fit packing and centroid clustering against brute force on small tables with odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from docloom.llm import alignment, best_fit, centroids, segments

SCHEMA = "doc_id long, text string, length long, kind string, code int, size int, seq string"
PARTS = ["the", "Über", "  ", " ", "\n", "\n\n", "\t", " \n ", "don't", "<|endoftext|>", " ", "é", "漢字", "\x1c", "\x85", "1234", "...", "᠎", "​", "'s", "\r\n", "a", "🎉", "<s>", "field", " of"]


def texts(n=150, seed=2):
    rng = random.Random(seed)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]
    return [*out, None, "", " ", "  ", "a▁b c", out[3], out[3], "x" * 3000, "long words " * 900, " lead", "trail "]


def docs(spark, some):
    return spark.createDataFrame([(i if i % 9 else None, t, 1, "k", 2, 3, "s") for i, t in enumerate(some)], SCHEMA).repartition(4)


def test_segments_tokenize_like_whole_texts():
    some = [t for t in texts(3000, 5) if t is not None]
    with open(best_fit.VOCABULARY_FILE, encoding="utf-8") as f:
        spec = f.read()
    tokenizer = segments.byte_level(spec, plain=False)
    known = segments.Remembered(tokenizer, segments.byte_lengths(spec))
    distinct, codes, sizes = segments.coded(pa.array(some))
    places, at = known.places(distinct), 0
    ends = np.cumsum(known.sizes)
    for text, n in zip(some, sizes.tolist(), strict=True):
        own = codes[at : at + n]
        at += n
        assert "".join(distinct[c] for c in own) == text
        got = [i for p in places[own].tolist() for i in known.pool[ends[p] - known.sizes[p] : ends[p]].tolist()]
        assert got == tokenizer.encode(text, add_special_tokens=False).ids


def aligned(some):
    with open(alignment.BYTE_LEVEL_FILE, encoding="utf-8") as f, open(alignment.PIECES_FILE, "rb") as g:
        both = alignment.Tokenizers(f.read(), g.read())
    told, pairs = [], Counter()
    for text in some:
        own = (" " + text).encode() if text else b""
        a = both.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = both.b.encode(text) if text else []
        if b"".join(both.a_bytes[i] for i in a) != own or b"".join(both.b_bytes[i] for i in b) != own:
            a = b = []
        ends_a, ends_b = np.cumsum([len(both.a_bytes[i]) for i in a]).tolist(), np.cumsum([len(both.b_bytes[i]) for i in b]).tolist()
        links = [(x, y) for x, p, q in zip(a, [0, *ends_a], ends_a, strict=False) for y, r, s in zip(b, [0, *ends_b], ends_b, strict=False) if p < s and r < q]
        groups, last = [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            inside = lambda ids, ends: ",".join(str(i) for i, e in zip(ids, ends, strict=True) if last < e <= end)  # noqa: B023, E731
            groups.append(f"{inside(a, ends_a)}|{inside(b, ends_b)}")
            last = end
        pairs.update(links)
        told.append((a, b, groups, links))
    best = defaultdict(int)
    for (_, y), n in pairs.items():
        best[y] = max(best[y], n)
    digest = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(len(a), len(b), len(g), len(k), sum(pairs[x] == best[x[1]] for x in k), sum(pairs[x] for x in k), digest(g)) for a, b, g, k in told]


@pytest.mark.parametrize(("sent", "chunk"), [(4_000_000, 12_000_000), (40, 500)])
def test_alignment(spark, monkeypatch, sent, chunk):
    """Whole and in many chunks with several passes over the pairs; rows come back in any order, null and repeated ids included."""
    monkeypatch.setattr(alignment, "SENT_PAIRS", sent)
    monkeypatch.setattr(alignment, "CHUNK_BYTES", chunk)
    some = texts(60)[:-4] + ["long words " * 40, "trail "]
    got = alignment.align_documents(docs(spark, some))
    want = [(i if i % 9 else None, *x) for i, x in enumerate(aligned(some))]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert alignment.align_documents(docs(spark, some).limit(0)).count() == 0


def test_alignment_refuses_vocabularies_that_merge_across_spaces():
    with open(alignment.BYTE_LEVEL_FILE, encoding="utf-8") as f:
        spec = f.read()
    with pytest.raises(ValueError, match="merge"):
        segments.byte_level(spec.replace('"add_prefix_space":false', '"add_prefix_space":true').replace('"add_prefix_space": false', '"add_prefix_space": true'), plain=True)


def test_best_fit_pieces_and_sequences(spark):
    some = texts() + [t for t in texts(300, 8) if t]
    got = best_fit.best_fit(best_fit.pieces_of(docs(spark, some), capacity=64), capacity=64, rows=50).collect()
    tokenizer, want = Tokenizer.from_file(best_fit.VOCABULARY_FILE), Counter()
    for i, text in enumerate(some):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range((len(ids) - 1) % 64 + 1, len(ids) + 1, 64)]
        for k, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(i if i % 9 else None, k, low, high - low, zlib.crc32(np.array(ids[low:high], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    check_sequences(got, 64)


def check_sequences(got, capacity, slack=1.05):
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for rows in by.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= capacity
    least = math.ceil(sum(r.length for r in got) / capacity)
    free, opened = [], 0  # one after the other: the largest first, each to the smallest gap that fits
    for length in sorted((r.length for r in got), reverse=True):
        fit = min((g for g in free if g >= length), default=None)
        if fit is None:
            opened += 1
            free.append(capacity - length)
        else:
            free.remove(fit)
            free.append(fit - length)
    assert least <= len(by) <= max(opened + 1, opened * slack)


@pytest.mark.parametrize("draw", [lambda r: r.randint(1, 100), lambda r: 34, lambda r: r.choice([51, 50, 49, 1]), lambda r: r.randint(1, 9), lambda r: 100, lambda r: r.choice([70, 40, 35, 20])])
def test_best_fit_lengths(spark, draw):
    rng = random.Random(1)
    rows = spark.createDataFrame([(i, draw(rng)) for i in range(700)], "doc_id long, length long").repartition(5)
    got = best_fit.best_fit(rows, capacity=100, rows=60).collect()
    assert sorted(r.doc_id for r in got) == list(range(700))
    check_sequences(got, 100)


def test_best_fit_odd_tables(spark):
    assert best_fit.best_fit(best_fit.pieces_of(docs(spark, ["a"]).limit(0))).count() == 0
    with pytest.raises(ValueError, match="piece"):
        best_fit.best_fit(spark.createDataFrame([(1, 0)], "doc_id long, length long"))


def clustered(rows, k=40, rounds=5):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    turn = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    c = [v for _, v in sorted(kept, key=turn)[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((square(v, w), n) for n, w in enumerate(c)) for _, v in kept]
    for _ in range(rounds):
        of = defaultdict(list)
        for (_, v), (_, n) in zip(kept, assign(), strict=True):
            of[n].append(v)
        c = [[sum(x) // len(of[n]) for x in zip(*of[n], strict=True)] if n in of else w for n, w in enumerate(c)]
    found, inertia = assign(), Counter()
    for d, n in found:
        inertia[n] += d
    return [(i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(kept, found, strict=True)]


@pytest.mark.parametrize("scale", [1.0, 40_000.0])
def test_centroids(spark, scale):
    """Clustered, equal, repeated and odd vectors; the second scale leaves the range in which doubles are exact."""
    rng = random.Random(6)
    heart = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(7)]
    rows = [(i, [scale * (x + rng.gauss(0, 0.02)) for x in rng.choice(heart)]) for i in range(260)]
    rows += [(i, [scale * 0.5] * 64) for i in range(300, 340)] + [(5, rows[5][1]), (None, rows[7][1])]
    odd = [(400, None), (401, [1.0] * 63), (402, [None] * 64), (403, [float("nan")] * 64), (404, [float("inf")] * 64), (405, [])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + odd], "vec_id long, embedding array<double>, cluster int, tree string").repartition(3)
    got = sorted(map(tuple, centroids.clusters(frame).collect()), key=repr)
    assert got == sorted(clustered(rows), key=repr)


def test_centroids_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    one = centroids.clusters(spark.createDataFrame([(1, [0.25] * 64), (2, [0.25] * 64)], schema)).collect()
    assert sorted((r.vec_id, r.distance, r.inertia) for r in one) == [(1, 0, 0), (2, 0, 0)] and len({r.cluster for r in one}) == 1
    assert centroids.clusters(spark.createDataFrame([], schema)).count() == 0


def test_whole_balls_are_given_away():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.integers(-5, 6, (500, 64)) + 1000 * k for k in range(4)])
    balls = centroids.Balls(list(range(len(points))), points)
    whole, rows, _, _ = balls.assign(np.stack([np.full(64, 1000 * k) for k in range(4)]))
    assert len(rows) == 0 and sorted(k for k, _ in whole) == [0, 1, 2, 3]
