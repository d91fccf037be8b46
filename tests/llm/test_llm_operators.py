"""The ten operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import exact_dedup, language_id, lm_scoring, mixing, packing, quality, simhash, suffix_dedup, url_filter, vptree
from docloom.llm.common import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, recipe string, size int, fp double, key string, turn string"
WORDS = ["the", "of", "and", "Rain", "field", "light", "über", "straße", "naïve", "mill", "stone", "river,", "cold.", "a", "x1", "—"]


def rows(texts, start=0):
    """Documents of the given texts, with further columns whose names operators use for themselves."""
    return [(start + i, t, "en", f"s{i % 3}" if i % 7 else None, len(t or ""), "r", 1, 0.5, "k", "t") for i, t in enumerate(texts)]


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    passage = " ".join(rng.choice(WORDS) for _ in range(30))
    for i in (3, 11, 30):
        texts[i] = texts[i] + " " + passage + "\n" + texts[i][:20]
    texts += [texts[3], texts[3].replace(" ", "\t "), None, "", " ", "long " * 6000 + passage, passage[5:], texts[11] + "!"]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(corpus()), SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def removed(texts):
    seen, out = {}, {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        mask = bytearray(len(b))
        for k in range(len(b) - 49):
            if seen.setdefault(b[k : k + 50], i) < i:
                mask[k : k + 50] = b"\1" * 50
        kept = bytes(x for x, m in zip(b, mask, strict=True) if not m)
        runs = sum(1 for k in range(len(b)) if mask[k] and (k == 0 or not mask[k - 1]))
        out[i] = (len(b), sum(mask), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup(docs, empty, monkeypatch):
    want = removed(corpus())
    for many in (20_000, 2, 0):  # the second scans distinct contexts, the third splits them all by passage
        monkeypatch.setattr(suffix_dedup, "MANY", many)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.without_repeats(docs).collect()}
        assert got == want
    assert suffix_dedup.without_repeats(empty).count() == 0


@pytest.mark.parametrize(("many", "block"), [(20_000, 1 << 20), (2, 1 << 20), (0, 1 << 20), (20_000, 70)])
def test_repeated_passages_give_all_occurrences(docs, monkeypatch, many, block):
    """Every start of a 50-byte string that occurs twice anywhere is in a group, and a group's passages are equal."""
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    texts = [(t or "").encode() for t in corpus()]
    places = defaultdict(list)
    for i, b in enumerate(texts):
        for k in range(len(b) - 49):
            places[b[k : k + 50]].append((i, k))
    want = {at for some in places.values() if len(some) > 1 for at in some}
    one = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    got, groups = set(), defaultdict(list)
    for r in suffix_dedup.repeated_passages(one).collect():
        got |= {(r.doc_id, r.start + k) for k in range(r["size"] - 49)}
        groups[r.repeat_id, r["size"]].append((texts[r.doc_id][r.start : r.start + r["size"]], r.doc_id, r.first_doc))
    assert got == want
    assert all(len(g) > 1 and len({w for w, _, _ in g}) == 1 and min(d for _, d, _ in g) >= g[0][2] for g in groups.values())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.without_repeats(docs).collect()}
    assert got == removed(corpus())


def test_suffix_dedup_many_in_batch(spark, monkeypatch):
    rng = random.Random(4)
    passage = " ".join(rng.choice(WORDS) for _ in range(25))
    texts = [f"{rng.random()} {passage[: 60 + i % 40]} {rng.random()}" for i in range(80)]
    monkeypatch.setattr(suffix_dedup, "MANY_IN_BATCH", 8)
    got = suffix_dedup.without_repeats(spark.createDataFrame(rows(texts), SCHEMA).repartition(3)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == removed(texts)


@pytest.mark.parametrize("bits", [0, 4, 23, 24, 25, 30])
def test_suffix_dedup_loses_no_key_bit(spark, monkeypatch, bits):
    """At the bucket bits of corpora up to 4 PB, marks and keys agree and every repeat is found."""
    keys = np.array([0, 1, (1 << 63) | 5, (1 << 64) - 1, 0xDEADBEEF12345678], np.uint64)
    prefix = suffix_dedup._prefix(keys, bits)
    kept = suffix_dedup.kept_bits(bits)
    bucket, low = prefix >> np.uint64(kept), prefix & np.uint64((1 << kept) - 1)
    assert int(prefix.max()).bit_length() <= 63 and int(bucket.max()) == (1 << bits) - 1 and int(low.max()).bit_length() <= 40
    mark = (((bucket << np.uint64(kept)) | low) << np.uint64(1)).view(np.int64)
    assert (mark.view(np.uint64) >> np.uint64(1) == prefix).all()
    monkeypatch.setattr(suffix_dedup, "bucket_bits", lambda total: bits)
    rng = random.Random(7)
    passage = " ".join(rng.choice(WORDS) for _ in range(25))
    texts = [f"{rng.random()} {passage[i:]} {rng.random()}" for i in range(12)]
    got = suffix_dedup.without_repeats(spark.createDataFrame(rows(texts), SCHEMA).repartition(3)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == removed(texts)


def test_suffix_dedup_frequent_anchors_by_number_of_batches():
    assert suffix_dedup.many_in_batch(10**9) == suffix_dedup.MANY_IN_BATCH and suffix_dedup.many_in_batch(10**14) == 2
    assert [suffix_dedup.bucket_bits(n) for n in (0, 10**9, 39 * 10**12, 10**14)] == [0, 8, 24, 25]


def test_suffix_dedup_batches_cost_no_more_for_more_buckets():
    """Before, a batch was gathered anew for each bucket, and the buckets are as many as the corpus is large."""
    rng = np.random.default_rng(1)
    keys, owner, ids = rng.integers(0, 1 << 63, 200_000, np.uint64), np.sort(rng.integers(0, 900, 200_000)), np.arange(900) * 7
    keys[::400] = keys[0]
    seconds = {}
    for bits in (4, 16):
        kept, began = suffix_dedup.kept_bits(bits), time.process_time()
        prefix = suffix_dedup._prefix(keys << np.uint64(1), bits)
        sent = [r for batch in suffix_dedup.by_bucket(prefix, owner, ids, bits, 100) for r in batch.to_pylist()]
        seconds[bits] = time.process_time() - began
        got, often = [], []
        for r in sent:
            docs = np.frombuffer(r["docs"], np.int64)
            if r["dest"] < 0:
                often += zip(docs.tolist(), np.frombuffer(r["keys"], "<u8").tolist(), strict=True)
                continue
            low = suffix_dedup._from_five(r["keys"])
            got += zip(np.repeat(docs, np.frombuffer(r["counts"], "<u4")).tolist(), ((np.uint64(r["dest"]) << np.uint64(kept)) | low).tolist(), strict=True)
            assert [(r["dest"] << kept) | x for x in suffix_dedup._from_five(r["many"]).tolist()] == [x for x in [int(prefix[0])] if x >> kept == r["dest"]]
        every = list(zip(ids[owner].tolist(), prefix.tolist(), strict=True))
        assert sorted(often) == sorted(x for x in every if x[1] == prefix[0]) and sorted(got) == sorted(x for x in every if x[1] != prefix[0])
    assert seconds[16] < 5


def test_suffix_dedup_looks_for_no_passage_of_whole_copies(spark, monkeypatch):
    """Before, all anchors of texts that occur twice were compared; results are as before, for copies sent by id or joined."""
    rng = random.Random(11)
    texts = [" ".join(rng.choice(WORDS) + str(rng.random()) for _ in range(60)) for _ in range(6)]
    texts = texts + texts[2:] + ["short", "short", "", None] + [texts[0] + " and more"] + texts[:3]
    seen, shared = [], suffix_dedup.shared_anchors
    monkeypatch.setattr(suffix_dedup, "shared_anchors", lambda *a: seen.append(shared(*a)) or seen[-1])
    for most in (100, 2):
        monkeypatch.setattr(suffix_dedup, "SENT_IDS", most)
        got = suffix_dedup.without_repeats(spark.createDataFrame(rows(texts), SCHEMA).repartition(3)).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == removed(texts)
        assert {r.doc_id for r in seen[-1][0].collect()} == {0, 14}


def test_suffix_dedup_repeated_ids(spark):
    twice = rows(["z" * 10 + "ab" * 60, "ab" * 70])
    one = suffix_dedup.without_repeats(spark.createDataFrame(twice, SCHEMA)).collect()
    two = suffix_dedup.without_repeats(spark.createDataFrame(twice + twice + [(None, "q" * 80, *twice[0][2:])], SCHEMA)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_prefix_intervals_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        pieces = sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(3, 9))) for _ in range(6)})
        piece, offset, lcp = suffix_dedup.suffix_array(pieces, np.zeros(len(pieces), np.int64), 3)
        suffixes = [pieces[p][o:] for p, o in zip(piece, offset, strict=True)]
        assert suffixes == sorted(suffixes)
        before = [pieces[p][o - 1] if o else -1 for p, o in zip(piece, offset, strict=True)]
        got = {(suffixes[a][:d], b - a + 1) for a, b, d in suffix_dedup.prefix_intervals(lcp.tolist(), before, 3)}
        places = defaultdict(list)
        for s, c in zip(suffixes, before, strict=True):
            for k in range(3, len(s) + 1):
                places[s[:k]].append((c, s[k : k + 1]))
        edge = lambda xs: len(set(xs)) > 1 or -1 in xs or b"" in xs
        want = {(w, len(at)) for w, at in places.items() if len(at) > 1 and edge([c for c, _ in at]) and edge([n for _, n in at])}
        assert got == want


def test_mixing(docs, empty):
    out = mixing.mix_documents(docs).collect()
    assert len(out) == docs.count()
    source = {r.doc_id: r.source for r in docs.collect()}
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    taken, sizes = Counter(), Counter()
    for r in out:
        assert r["size"] == words[r.doc_id] and 0 <= r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
        sizes[source[r.doc_id]] += r["size"]
    want = mixing.capped_targets(dict(sizes), mixing.weights_in_turn(sizes))
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    assert all(math.isclose(r.target, want[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]] for r in out)
    again = mixing.mix_documents(docs.repartition(3)).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in out}
    assert mixing.mix_documents(empty).count() == 0


def test_mixing_overlaps(spark):
    rows = [(i, [["a"], ["b"], ["a", "b"], [], None][i % 5], 10) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, at array<string>, n long")
    out = mixing.mix(df, F.col("at"), F.col("n"), lambda sizes: {"a": 3, "b": 1}).collect()
    got = Counter()
    for r in out:
        got[r.doc_id % 5] += r.taken
    assert len(out) == 100 and got[3] == got[4] == 0
    assert got[0] + got[1] + got[2] == 600 and got[0] > got[1]


def test_capped_targets_reshare():
    got = mixing.capped_targets({"a": 10, "b": 1000, "c": 0}, {"a": 5, "b": 2, "c": 1})
    assert got == {"a": 30.0, "b": 980.0, "c": 0.0}


def test_shared_targets_equal_the_plain_shares(spark):
    rng = random.Random(9)
    for n in (1, 2, 7, 40):
        sizes = {f"s{i}" if i else None: rng.choice([0, 1, 10, 100, 5000]) for i in range(n)}
        rows = mixing.weights_in_turn(spark.createDataFrame(list(sizes.items()), "source string, size long"))
        weights = mixing.weights_in_turn(sizes)
        assert {r.source: r.weight for r in rows.collect()} == weights
        got = {r.source: r.target for r in mixing.shared_targets(rows).collect()}
        want = mixing.capped_targets(sizes, weights)
        assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-6) for s in want)


def test_mixing_of_very_many_sources(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.concat(F.lit("s"), "id").alias("source"))
    out = mixing.mix_documents(rows)
    got = out.agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.sum("size").alias("size"), F.max(F.abs(F.col("taken") - F.col("target"))).alias("off")).first()
    assert (got.n, got.size) == (30_000, 90_000) and got.off <= 0.5 + 1e-9 and abs(got.taken - 90_000) <= 15_000


def test_min_cost_flow_against_enumeration():
    """Over all ways to take words in overlapping patterns: the most words, and of those the fewest repeats."""
    from itertools import product

    costs = mixing.REPEAT_COSTS
    spend = lambda taken, words: sum(c * max(0, min(words, taken - k * words)) for k, c in enumerate(costs))

    def fits(taken, members, quotas):  # max flow by trying all splits of two sources
        for a in range(taken[1] + 1) if len(taken) > 1 else [0]:
            if taken[0] + a <= quotas["a"] and taken[2] + taken[1] - a <= quotas["b"]:
                return True
        return False

    rng = random.Random(4)
    for _ in range(25):
        words = [rng.randint(0, 3) for _ in range(3)]
        quotas = {"a": rng.randint(0, 9), "b": rng.randint(0, 9)}
        patterns = {"a": (["a"], words[0]), "ab": (["a", "b"], words[1]), "b": (["b"], words[2])}
        got = mixing.min_cost_flow(patterns, quotas)
        every = [t for t in product(*(range(3 * w + 1) for w in words)) if fits(t, None, quotas)]
        best = max((sum(t), -sum(spend(x, w) for x, w in zip(t, words, strict=True))) for t in every)
        mine = [got[p] for p in ("a", "ab", "b")]
        assert fits(mine, None, quotas) and (sum(mine), -sum(spend(x, w) for x, w in zip(mine, words, strict=True))) == best


def test_mixing_takes_what_the_flow_says(docs, monkeypatch):
    """The query's own path: a flow that takes nothing leaves nothing taken, single-source patterns included."""
    assert sum(r.taken for r in mixing.mix_documents(docs).collect()) > 0
    monkeypatch.setattr(mixing, "min_cost_flow", lambda patterns, quotas, costs: dict.fromkeys(patterns, 0))
    assert sum(r.taken for r in mixing.mix_documents(docs).collect()) == 0


def test_flows_by_component(spark):
    """Sources tied by patterns, null among them, are solved together; many patterns never meet on the driver."""
    patterns = [("p0", ["a"], 10), ("p1", ["a", "b"], 20), ("p2", ["b", None], 5), ("p3", ["c"], 7), ("p4", [None], 4), ("p5", [], 9)] + [(f"q{i}", [f"x{i}"], 3) for i in range(50)]
    quotas = {"a": 25, "b": 12, None: 9, "c": 30} | {f"x{i}": i for i in range(50)}
    got = mixing.flows(
        spark.createDataFrame(patterns, "pattern string, members array<string>, words long"), spark.createDataFrame([(s, float(q)) for s, q in quotas.items()], "source string, target double"), (0, 1, 3)
    )
    want = mixing.min_cost_flow({p: (m, w) for p, m, w in patterns if m}, quotas)
    got = {r.pattern: r.taken for r in got.collect()}
    assert got.keys() == want.keys() and sum(got.values()) == sum(want.values())
    assert {p: n for p, n in got.items() if p[0] == "q" or p == "p3"} == {p: n for p, n in want.items() if p[0] == "q" or p == "p3"}


def test_min_cost_flow_overlap():
    patterns = {"a": (["a"], 10), "ab": (["a", "b"], 10), "b": (["b"], 10)}
    got = mixing.min_cost_flow(patterns, {"a": 20, "b": 10})
    assert got == {"a": 10, "ab": 10, "b": 10}  # no repeats while unused words are left
    assert sum(mixing.min_cost_flow(patterns, {"a": 200, "b": 10}).values()) == 70


def test_vptree(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 8)) * rng.uniform(0.2, 3, (700, 1))
    x[40:80] = x[5]
    data = [(i, [float(v) for v in row], 0) for i, row in enumerate(x)]
    odd = [(700, None, 0), (701, [0.0] * 8, 0), (702, [float("nan")] * 8, 0), (703, [1.0, None] * 4, 0), (704, [1.0, 2.0], 0), (None, [1.0] * 8, 0), data[60]]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>, score int")
    out = vptree.nearest(df, df.where("vec_id % 20 = 0"), k=20).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: r["rank"]):
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    assert set(got) == set(range(0, 700, 20))
    for q, found in got.items():
        dots = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(700), -dots)) if i != q][:20]
        assert [i for i, _ in found] == order
        assert np.allclose([s for _, s in found], dots[order])
    assert vptree.nearest(df.limit(0), df.limit(0)).count() == 0


def brute_nearest(x, ids, queries, k):
    want = {}
    for q in queries:
        dots = (x * x[ids.index(q)]).sum(axis=1)
        want[q] = [ids[i] for i in np.lexsort((ids, -dots)) if ids[i] != q][:k]
    return want


def found_by(out):
    found = defaultdict(list)
    for r in out.orderBy("rank").collect():
        found[r.query_id].append(r.vec_id)
    return dict(found)


def test_vptree_shards_and_relaxed_pruning(spark, monkeypatch):
    monkeypatch.setattr(vptree, "SHARD_ROWS", 150)
    monkeypatch.setattr(vptree, "BLOCK_ROWS", 10)
    monkeypatch.setattr(vptree, "LEAF", 8)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute_nearest(x, list(range(600)), range(0, 600, 20), 5)
    assert found_by(vptree.nearest(df, df.where("vec_id % 20 = 0"), k=5)) == want
    found = found_by(vptree.nearest(df, df.where("vec_id % 20 = 0"), k=5, relax=1.3))
    assert sum(len(set(found[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


def test_vptree_leaves_out_cells_without_loss(spark, monkeypatch):
    """Clusters, so that whole cells can't hold a neighbour."""
    monkeypatch.setattr(vptree, "SHARD_ROWS", 60)
    monkeypatch.setattr(vptree, "LEAF", 8)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(12, 4))[rng.integers(0, 12, 600)] + 0.05 * rng.normal(size=(600, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    assert found_by(vptree.nearest(df, df.where("vec_id % 20 = 0"), k=5)) == brute_nearest(x, list(range(600)), range(0, 600, 20), 5)


def test_vptree_ties_of_distinct_vectors(spark, monkeypatch):
    """Many distinct vectors with one product: the smaller ids win, over shards and leaves."""
    for shard, leaf in ((10_000, 96), (90, 4)):
        monkeypatch.setattr(vptree, "SHARD_ROWS", shard)
        monkeypatch.setattr(vptree, "LEAF", leaf)
        rng = np.random.default_rng(2)
        x = rng.integers(-2, 3, (400, 6)).astype(float) / 2
        x[x.any(axis=1) == 0] = 0.5
        x[0] = [1, 0, 0, 0, 0, 0]
        x[10:350:10, 0] = 1.0
        ids = rng.permutation(400).tolist()
        df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<float>").repartition(6)
        assert found_by(vptree.nearest(df, df.where("vec_id % 20 = 0"), k=5)) == brute_nearest(x, ids, range(0, 400, 20), 5)


def test_vptree_repeated_ids_and_clashing_names(spark):
    rows = [(i, [float(i % 7), 1.0, float(-i)], 1, 2) for i in range(50)]
    extra = [(20, [9.0, 9.0, 9.0], 3, 4), (20, [0.0, 1.0, -20.0], 3, 4), (3, None, 0, 0)]
    schema = "vec_id long, embedding array<float>, cell int, v int"
    df = spark.createDataFrame(rows + extra, schema)
    x = np.array([r[1] for r in rows])
    x[20] = [0.0, 1.0, -20.0]
    assert found_by(vptree.nearest(df, df.where("vec_id % 20 = 0"), k=4)) == brute_nearest(x, list(range(50)), range(0, 50, 20), 4)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_lm_base_and_model(docs, empty, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SENT_WORDS", 5)  # most words go through the join
    fold = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 5 for r in docs.collect()}
    training = docs.where(F.col("doc_id").isin([i for i, f in fold.items() if f != 1]))
    out = {r.doc_id: r for r in lm_scoring.score_texts(docs, training).collect()}
    words = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", lower(r.text)) for r in docs.collect()}
    c = Counter(w for i, ws in words.items() if fold[i] != 1 for w in ws)
    ends = sum(f != 1 for f in fold.values())
    total, distinct = sum(c.values()) + ends, len(c) + 1
    assert len(out) == len(words)
    for i, ws in words.items():
        base = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws) + math.log10((ends + 0.5) / (total + 0.5 * (distinct + 1)))
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    again = {r.doc_id: r.score for r in lm_scoring.score_texts(docs, training).collect()}
    assert all(math.isclose(again[i], out[i].score, rel_tol=1e-4) for i in out)
    assert lm_scoring.score_texts(empty, empty).count() == 0
    assert lm_scoring.score_texts(docs, empty).count() == len(words)


def test_lm_splits_each_text_once(spark, docs, monkeypatch):
    """A condition for training gives the counts that a frame of it gives, and all texts are split into subwords in one pass."""
    given = []
    monkeypatch.setattr(lm_scoring, "encoded", lambda texts, ranks, plain=lm_scoring.encoded: given.append(texts) or plain(texts, ranks))
    want = {r.doc_id: r for r in lm_scoring.score_texts(docs, docs.where("doc_id % 3 <> 1")).collect()}
    got = {r.doc_id: r for r in lm_scoring.score_texts(docs, F.col("doc_id") % 3 != 1).collect()}
    assert given[1].count() == docs.count() == len(got) and want.keys() == got.keys()
    for i, r in want.items():
        assert r[:4] == got[i][:4] and math.isclose(r.base_score, got[i].base_score, rel_tol=1e-9) and got[i].score < 0
    learned = lm_scoring.encoded(docs.select("doc_id", "text", (F.col("doc_id") % 3 != 1).alias("learn")), lm_scoring.load_ranks(lm_scoring.VOCABULARY_FILE))
    assert learned.where("text is not null").count() == docs.count()
    assert learned.where("text is not null and learn").count() == docs.where("doc_id % 3 <> 1").count()


def test_lm_weights_learn_from_every_training_document(spark):
    ranks = lm_scoring.load_ranks(lm_scoring.VOCABULARY_FILE)
    words = [(i, t[1:].decode()) for t, i in ranks.items() if re.fullmatch(rb" [a-z]{3,}", t)][:3000]
    learned = lm_scoring.encoded(spark.createDataFrame(words, "doc_id long, text string"), ranks)
    class_of, _ = lm_scoring.class_tables(np.ones(len(ranks)), ranks, len(words))
    model = lm_scoring.train(learned.where("text is not null").select("text"), ranks, class_of)
    ids = [i for i, _ in words]
    assert len(ids) == 3000 and (model.e[ids] != lm_scoring.Attention(*model.e.shape[:1], model.b.size).e[ids]).any(axis=1).all()
    counted = {r.word: r.n for r in learned.where("word is not null").collect()}
    assert counted == {w: 1 for _, w in words}


def test_lm_training_windows_hold_each_token_once():
    texts = [np.arange(n) % 7 for n in (0, 5, 15, 16, 31, 40, 200)]
    for turn in (0, 1, 5, 12):
        keys, at, goals = lm_scoring.windows_of(texts, 9, np.full(len(texts), turn))
        inputs, targets, _, _ = lm_scoring.laid_out(texts, 9)
        assert (goals >= 0).all() and at.shape == goals.shape == (len(keys), lm_scoring.TARGETS)
        assert (keys < 9).sum() >= 0.8 * sum(map(len, texts)) - 16
        for row, places, wanted in zip(keys, at, goals, strict=True):
            for p, g in zip(places, wanted, strict=True):  # the goal of a place is the next id, or the end of the text
                after = row[lm_scoring.STRIDE + p + 1] if p + 1 < lm_scoring.STRIDE else None
                assert g == 9 or after in (g, None)


def test_lm_training_asks_at_every_place_once():
    """Over the rounds: all blocks, each with the block before it, at all places that have a target."""
    n, texts = lm_scoring.STRIDE, [np.arange(n) % 7 for n in (0, 5, 15, 16, 17, 31, 40, 200)]
    inputs, targets, starts, _ = lm_scoring.laid_out(texts, 9)
    every = Counter((tuple(inputs[s : s + 2 * n].tolist()), p, int(targets[s + n + p])) for s in starts.tolist() for p in range(n) if targets[s + n + p] >= 0)
    for turn in (0, 1, 6):
        asked = Counter()
        for nth in range(lm_scoring.ROUNDS):
            for row, at, goals in zip(*(x.tolist() for x in lm_scoring.windows_of(texts, 9, np.full(len(texts), turn + nth))), strict=True):
                asked.update({(tuple(row), p, g) for p, g in zip(at, goals, strict=True)})
        assert asked == every


def test_lm_gradient_beside_paddings_and_past_the_end():
    model, rng = lm_scoring.Attention(12, 4), np.random.default_rng(4)
    for name in ("e", "a", "r", "u", "b"):
        setattr(model, name, getattr(model, name).astype(float))
    keys, goal = rng.integers(0, 11, (3, 32)), rng.integers(0, 4, (3, 16))
    keys[0, :16], goal[1, 9:] = 11, -1
    real = goal.ravel() >= 0

    def loss():
        p, _ = model.forward(keys, 11)
        return -np.log(p[real, goal.ravel()[real]]).mean()

    before, slopes = model.e.copy(), {}
    for at in [(int(keys[0, 20]), 3), (int(keys[1, 2]), 0), (int(keys[1, 24]), 7), (11, 1)]:
        model.e[at] += 1e-5
        up = loss()
        model.e[at] -= 2e-5
        slopes[at] = (up - loss()) / 2e-5
        model.e[at] += 1e-5
    memory = {}
    model.step(keys, goal, 11, memory, 1e-3)
    for at, slope in slopes.items():
        moved = 1e-3 * slope / math.sqrt(memory["e"][at[0]])
        assert math.isclose(before[at] - model.e[at], moved, rel_tol=1e-3, abs_tol=1e-9)


def test_lm_logs_equal_forward():
    """The fast scoring pass against the plain forward pass, also where attention scores are large."""
    rng = np.random.default_rng(2)
    ids = [rng.integers(0, 9, n) for n in (0, 5, 15, 16, 17, 40, 333)]
    inputs, targets, starts, owner = lm_scoring.laid_out(ids, 9)
    for scale in (1, 12):
        model = lm_scoring.Attention(11, 5)
        model.e *= np.float32(scale)
        model.r[:] = rng.normal(size=model.r.shape)
        class_of = np.append(rng.integers(0, 5, 9), 4)
        logs = model.logs(inputs, class_of[targets], 10)
        p, _ = model.forward(inputs[starts[:, None] + np.arange(2 * lm_scoring.STRIDE)], 10)
        goal = targets[starts[:, None] + lm_scoring.STRIDE + np.arange(lm_scoring.STRIDE)]
        real = goal.ravel() >= 0
        want = np.log(p[np.flatnonzero(real), class_of[goal.ravel()[real]]])
        got = logs[(starts[:, None] + lm_scoring.STRIDE + np.arange(lm_scoring.STRIDE)).ravel()[real]]
        assert np.allclose(got, want, rtol=1e-3, atol=1e-4)
        each = lm_scoring.scores(model, class_of, np.zeros(10), ids, 9)
        assert np.allclose(each, [want[np.repeat(owner, lm_scoring.STRIDE)[real] == k].sum() / np.log(10) for k in range(len(ids))], rtol=1e-3, atol=1e-3)


def test_lm_groups_of_classes():
    """Slopes beside differences, scoring beside the plain forward pass; classes of a group that no place asks for don't move."""
    model, rng = lm_scoring.Attention(12, 40), np.random.default_rng(6)
    keys, goal = rng.integers(0, 11, (3, 32)), rng.integers(0, 40, (3, 16))
    goal[(goal >= 16) & (goal < 32)] -= 16
    goal[1, 9:] = -1
    real = goal.ravel() >= 0
    inputs, targets = keys.ravel().copy(), np.full(96, -1)
    targets[16:32] = goal[0]
    p, _ = model.forward(keys, 11)
    assert p.shape == (48, 40) and np.allclose(p.sum(axis=1), 1, atol=1e-5)
    assert np.allclose(model.logs(inputs, targets, 11)[16:32], np.log(p[np.arange(16), goal[0]]), atol=1e-5)
    for name in ("e", "a", "r", "u", "b"):
        setattr(model, name, getattr(model, name).astype(float))

    def loss():
        p, _ = model.forward(keys, 11)
        return -np.log(p[real, goal.ravel()[real]]).mean()

    before, slopes = {name: getattr(model, name).copy() for name in ("e", "u", "b")}, {}
    for name, at in (("u", (5, 1)), ("u", (3, 35)), ("u", (20, 41)), ("b", (2,)), ("b", (42,)), ("e", (int(keys[0, 20]), 3)), ("e", (int(keys[1, 2]), 0))):
        own = getattr(model, name)
        own[at] += 1e-5
        up = loss()
        own[at] -= 2e-5
        slopes[name, at] = (up - loss()) / 2e-5
        own[at] += 1e-5
    memory = {}
    model.step(keys, goal, 11, memory, 1e-3)
    for (name, at), slope in slopes.items():
        moved = 1e-3 * slope / math.sqrt(memory[name][at[0] if name == "e" else at])
        assert math.isclose(before[name][at] - getattr(model, name)[at], moved, rel_tol=1e-3, abs_tol=1e-9)
    assert (model.u[:, 16:32] == before["u"][:, 16:32]).all() and (model.u[:, :16] != before["u"][:, :16]).any()


def test_lm_words_and_subwords():
    import pyarrow as pa

    texts = ["  The cat\x0bSAT  ", "", "the\u00a0x é\r\n the", "\t"]
    distinct, which, counts = lm_scoring.split_words(pa.array(texts))
    words = distinct.to_pylist()
    assert [words[i] for i in which] == ["the", "cat", "sat", "the\u00a0x", "é", "the"] and counts.tolist() == [3, 0, 3, 0]
    ranks = lm_scoring.load_ranks(lm_scoring.VOCABULARY_FILE)
    subwords = lm_scoring.Subwords(ranks)
    ids, sizes = subwords.ids(words)
    token = {i: t for t, i in ranks.items()}
    parts = np.split(ids, np.cumsum(sizes)[:-1])
    assert [b"".join(token[i] for i in p.tolist()) for p in parts] == [b" " + w.encode() for w in words]
    flat = lm_scoring.spread(ids, sizes, which)
    assert flat.tolist() == [i for w in which for i in parts[w].tolist()]


def test_lm_windows_score_each_token_once_and_causally():
    ids = [np.arange(n) % 7 for n in (0, 5, 16, 40)]
    inputs, targets, starts, owner = lm_scoring.laid_out(ids, 9)
    own = np.arange(lm_scoring.STRIDE, 2 * lm_scoring.STRIDE)
    seen = targets[starts[:, None] + own]
    for k, t in enumerate(ids):
        assert [x for x in seen[owner == k].ravel() if x >= 0] == [*t, 9]
    model = lm_scoring.Attention(11, 5)
    keys = inputs[starts[:, None] + np.arange(2 * lm_scoring.STRIDE)]
    p, _ = model.forward(keys, 10)
    other = keys.copy()
    other[:, -1] = 3  # the last token changes nothing before it
    q, _ = model.forward(other, 10)
    n = lm_scoring.STRIDE
    assert np.allclose(p.reshape(-1, n, 5)[:, : n - 1], q.reshape(-1, n, 5)[:, : n - 1])
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)


def test_lm_gradient():
    model, rng = lm_scoring.Attention(12, 4), np.random.default_rng(1)
    for name in ("e", "a", "r", "u", "b"):
        setattr(model, name, getattr(model, name).astype(float))
    model.r[:] = rng.normal(size=model.r.shape)
    keys, goal = rng.integers(0, 11, (3, 32)), rng.integers(0, 4, (3, 16))

    def loss():
        p, _ = model.forward(keys, 11)
        return -np.log(p[np.arange(48), goal.ravel()]).mean()

    before = {k: getattr(model, k).copy() for k in ("e", "a", "r", "u", "b")}
    slopes = {}
    for name, at in (("a", (2, 3)), ("r", (4,)), ("u", (5, 1)), ("b", (2,)), ("e", (int(keys[0, 20]), 3))):
        own = getattr(model, name)
        own[at] += 1e-5
        up = loss()
        own[at] -= 2e-5
        slopes[name] = (at, (up - loss()) / 2e-5)
        own[at] += 1e-5
    memory = {}
    model.step(keys, goal, 11, memory, 1e-3)
    for name, (at, slope) in slopes.items():
        moved = getattr(model, name)[at] - before[name][at]
        assert moved * slope < 0 or abs(slope) < 1e-7
        if name in ("a", "u", "b", "r"):
            assert math.isclose(math.sqrt(memory[name][at]), math.sqrt(slope**2 + 1e-6), rel_tol=1e-3)


def fp(t):
    w = [x for x in re.split(rb"[\x20\x09-\x0D]+", lower(t).encode()) if x]
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash(docs, empty):
    out = {r.doc_id: r for r in simhash.simhash_components(docs).collect()}
    fps = {r.doc_id: fp(r.text) for r in docs.collect()}
    assert {i: r.fingerprint for i, r in out.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    linked = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 4]
    assert {i: r.component_id for i, r in out.items()} == components(fps, linked)
    assert simhash.simhash_components(empty).count() == 0


def test_trie_links_lose_nothing(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(150)]
    for f in base[:60]:
        for _ in range(3):
            for b in rng.sample(range(64), rng.randint(1, 6)):
                f ^= 1 << b
            base.append(f)
    fps = sorted(set(base))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    edges = simhash.linked_fingerprints(spark.createDataFrame([(signed(f),) for f in fps], "fp long"), rows_a_task=64).collect()
    got = components(fps, [(e.a % (1 << 64), e.b % (1 << 64)) for e in edges])
    assert got == components(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])
    assert all((e.a ^ e.b) != 0 for e in edges)


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 70)] + [(100, i) for i in range(101, 160)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(90)]
    edges = [e for e in edges if e[0] != e[1]]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 3), (5, 5)], "a long, b long")).collect()}
    assert got == components({n for e in edges for n in e}, edges)


def test_packing(docs, empty):
    out = packing.pack(docs, mixing.word_count(F.coalesce("text", F.lit(""))), budget=200, buckets=4).collect()
    assert len(out) == docs.count()
    batches = defaultdict(list)
    for r in out:
        assert r["size"] <= r.bucket_length
        batches[r.batch_id].append(r)
    for some in batches.values():
        assert len({r.bucket_length for r in some}) == 1 and sorted(r.slot for r in some) == list(range(len(some)))
        assert len(some) == 1 or len(some) * some[0].bucket_length <= 200
    assert packing.pack_documents(empty).count() == 0


def test_best_boundaries_are_optimal():
    from itertools import combinations

    rng = random.Random(3)
    for _ in range(30):
        lengths = sorted(rng.sample(range(1, 60), 7))
        n = [rng.randint(1, 9) for _ in lengths]
        cost = lambda ends, lengths=lengths, n=n: sum(k * (min(e for e in ends if e >= x) - x) for x, k in zip(lengths, n, strict=True))
        best = min(cost([*c, lengths[-1]]) for c in combinations(lengths[:-1], 2))
        assert cost(packing.best_boundaries(np.array(lengths), np.array(n), 3)) == best


def test_best_boundaries_of_long_lengths_equal_plain_dynamic_programming():
    rng = random.Random(5)
    for n, buckets in ((1, 3), (4, 9), (60, 5), (150, 12)):
        lengths = sorted(rng.sample(range(0, 50_000), n))
        rows = [rng.randint(1, 40) for _ in lengths]
        cost = lambda i, j, lengths=lengths, rows=rows: sum(k * (lengths[j - 1] - x) for x, k in zip(lengths[i:j], rows[i:j], strict=True))
        least = [0] + [math.inf] * n
        every = []
        for _ in range(min(buckets, n)):
            least = [math.inf] + [min(least[i] + cost(i, j) for i in range(j)) for j in range(1, n + 1)]
            every.append(least[n])
        ends = packing.best_boundaries(np.array(lengths), np.array(rows), buckets)
        assert ends[-1] == lengths[-1] and len(ends) <= buckets and set(ends) <= set(lengths)
        assert sum(k * (min(e for e in ends if e >= x) - x) for x, k in zip(lengths, rows, strict=True)) == min(every)


def test_packing_of_long_texts_is_optimal(spark):
    sizes = [600, 601, 640, 999, 1000, 1003, 5000, 5001, 0, 3, 1003, 700]
    df = spark.createDataFrame([(i, " ".join(["w"] * n), "x", 5) for i, n in enumerate(sizes)], "doc_id long, text string, bucket_length string, part int")
    out = packing.pack(df, mixing.word_count(F.coalesce("text", F.lit(""))), budget=4000, buckets=4).collect()
    ends = sorted({r.bucket_length for r in out})
    assert set(ends) <= set(sizes) and len(out) == len(sizes)
    pad = lambda ends: sum(min(e for e in ends if e >= x) - x for x in sizes)
    from itertools import combinations

    assert pad(ends) == min(pad([*c, 5001]) for k in range(4) for c in combinations(sorted(set(sizes) - {5001}), k))


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, empty, weak):
    """weak: a hash with few values, so that chunks must be told apart by their content."""
    hashed = (lambda c: F.xxhash64(c) % 3) if weak else F.xxhash64
    out = {r.doc_id: r for r in exact_dedup.exact_groups(docs, hashed).collect()}
    norm = {r.doc_id: re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in docs.collect()}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    for i, t in norm.items():
        r = out[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs).count() == len(groups)
    assert exact_dedup.drop_exact_duplicates(docs.unionByName(docs)).count() == len(groups)


def speech(lang, rng):
    vocabulary = {"en": "the rain falls on old stone and green fields while people walk home", "de": "der regen fällt auf alte steine während menschen über straßen nach hause gehen", "fr": "la pluie tombe sur les vieilles pierres pendant que les gens rentrent chez eux où"}
    return " ".join(rng.choice(vocabulary[lang].split()) for _ in range(rng.randint(3, 40)))


def test_language_id(spark, empty):
    rng = random.Random(1)
    data = [(i, speech(lang := rng.choice(["en", "de", "fr"]), rng), lang) for i in range(400)] + [(900, None, "en"), (901, "", "en"), (902, "12 34 !?", "en"), (903, "rain " * 5000, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language_id.identify(df, df.where("doc_id % 3 <> 1")).collect()}
    assert len(out) == len(data) and all(out[i].lang_pred == "und" and out[i].score == 0 for i in (900, 901, 902))
    held = [(i, lang) for i, _, lang in data if i % 3 == 1 and i < 400]
    assert sum(out[i].lang_pred == lang for i, lang in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in out.values()) and out[903].lang_pred == "en"
    assert language_id.identify(empty, empty).count() == 0
    assert {r.lang_pred for r in language_id.identify(df, df.limit(0)).collect()} == {"und"}


def test_quality(spark, empty):
    rng = random.Random(2)
    good = lambda: speech(rng.choice(["en", "de"]), rng) + "."
    junk = lambda: " ".join(w.upper() + "!!" for w in good().split()) if rng.random() < 0.5 else " | ".join(good().split())
    data = [(i, (good if i % 3 else junk)()) for i in range(500)] + [(900, None), (901, ""), (902, "word " * 20_000)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(500)] + [(901, None, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.score_quality(df, labels.where("doc_id % 5 <> 0")).collect()}
    held = [i for i in range(0, 500, 5)]
    assert len(out) == len(data) and sum(out[i].predicted == int(i % 3 > 0) for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    none = quality.score_quality(df, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score_quality(empty, labels).count() == 0


def plain_buckets(text: bytes) -> list[int]:
    """The n-gram buckets of language identification, one by one in plain integers."""
    low = [32 if c < 33 or 48 <= c < 58 else c + 32 if 65 <= c < 91 else c for c in text]
    out = []
    for n in (2, 3, 4):
        for k in range(len(low) - n + 1):
            h = low[k]
            for c in low[k + 1 : k + n]:
                h = (h * 0x01000193 ^ c) % (1 << 32)
            mixed = h * 0x9E3779B1 % (1 << 32)
            out.append((mixed ^ mixed >> 15) >> 2 & (language_id.BUCKETS - 1))
    return out


@pytest.mark.parametrize("block", [1 << 18, 7])
def test_language_scores_equal_a_plain_computation(monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK", block)
    rng, at = random.Random(3), np.random.default_rng(4)
    texts = [speech(lang, rng).encode() for lang in ("en", "de", "fr") for _ in range(8)] + [b"a", b"", "É 12".encode()]
    table = at.normal(size=(language_id.BUCKETS, 3))
    for text in texts:
        plain = plain_buckets(text)
        found = sorted(np.concatenate([np.empty(0, np.uint32), *language_id.subwords(text)]).tolist())
        assert found == sorted(plain)
        want = np.mean([table[b] for b in plain], axis=0) if plain else 0
        assert np.allclose(language_id.mean_row(text, table), want, atol=1e-6)
        places, share = language_id.shares(text)
        assert {b: round(float(x), 6) for b, x in zip(places, share, strict=True)} == {b: round(n / len(plain), 6) for b, n in Counter(plain).items()}
    # averaging embeddings and a linear layer is what the fitted table stands for: a softmax over means separates the sample
    labelled = [(language_id.shares(speech(lang, rng).encode()), k) for k, lang in enumerate(("en", "de", "fr")) for _ in range(150)]
    scores, bias, heat = language_id.fit([d for d, _ in labelled], np.array([y for _, y in labelled]), 3)
    said = [int(np.argmax(np.mean([scores[b] for b in plain_buckets(x)], axis=0) + bias)) for x in texts[:24]]
    assert heat > 0 and sum(a == k // 8 for k, a in enumerate(said)) >= 22


def test_quality_scores_equal_a_plain_computation(monkeypatch):
    """The folded network over blocks of a text against pooled vectors and both layers in plain numpy."""
    from docloom.llm import common

    rng = random.Random(6)
    texts = [(speech("en", rng) + ("." if k % 2 else " !!! AA11")).encode() for k in range(40)] + [b"", b"one", b"word word  Word"]
    y = np.array([k % 2 for k in range(40)] + [0, 1, 0], float)
    vectors = quality.Vectors(texts)

    def pooled(text):
        words = text.split()
        rows = lambda table, known, key: np.mean([table[known.get(key(w), len(known))] for w in words], axis=0) if words else np.zeros(quality.DIMENSIONS)
        c = Counter(words)
        n = len(words)
        figures = [sum(a == b for a, b in zip(words[1:], words, strict=False)) / (n - 1) if n > 1 else 0, len(c) / n, max(c.values()) / n, np.log1p(n) / 10, len(text) / n / 10, 1] if n else [0] * 6
        return np.concatenate((rows(vectors.word_rows, vectors.words, bytes), rows(vectors.shape_rows, vectors.shapes, quality.shape), figures))

    x = np.array([pooled(t) for t in texts])
    network = quality.Network(x, y, 0.4)
    scaled = (x - network.mean) / network.scale
    hidden = np.maximum(scaled @ network.p[0] + network.p[1], 0)
    want = 1 / (1 + np.exp(-((hidden @ network.p[2] + network.p[3]) / network.heat + network.shift)))
    model = network.folded(vectors)
    for most in (1 << 20, 9):
        monkeypatch.setattr(quality, "word_blocks", lambda text, most=most: common.word_blocks(text, most))
        assert np.allclose(quality.scores(model, quality.Reader(model["words"], model["shapes"]), texts), want, atol=1e-4)


def test_fingerprints_block_by_block(monkeypatch):
    from docloom.llm import common

    rng = random.Random(8)
    texts = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (0, 1, 3, 4, 5, 40, 300)]
    for most in (1, 5, 64, 1 << 20):
        monkeypatch.setattr(simhash, "word_blocks", lambda text, most=most: common.word_blocks(text, most))
        assert [simhash.fingerprint(t.encode()) for t in texts] == [fp(t) for t in texts]
    assert [w for b in common.word_blocks(b" ab  c\x0bd e", 2) for w in b] == [b"ab", b"c", b"d", b"e"]


def test_very_long_texts_stay_small_in_memory():
    """Bytes held at once beside a text of 12 MB, for what the operators make of a single document."""
    import tracemalloc

    rng = random.Random(1)
    text = " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(1000)).encode() * 1200
    text = text[:12_000_000]
    table = np.zeros((language_id.BUCKETS, 4), np.float32)
    reader = quality.Reader({}, {})
    for name, work, most in (
        ("anchors", lambda: suffix_dedup.anchors(np.frombuffer(text, np.uint8)), 100e6),
        ("language", lambda: language_id.mean_row(text, table), 40e6),
        ("fingerprint", lambda: simhash.fingerprint(text), 80e6),
        ("quality", lambda: reader(text), 80e6),
    ):
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < most, (name, peak)


def test_classifiers_with_clashing_names_and_repeated_rows(spark):
    rng = random.Random(5)
    rows = [(i, speech("en" if i % 2 else "de", rng) + ("." if i % 3 else " ||| ##"), "en" if i % 2 else "de", 0.5, "p", 1, "x") for i in range(120)]
    schema = "doc_id long, text string, lang string, score double, predicted string, letters int, quality string"
    df = spark.createDataFrame(rows + rows[:5] + [(None, None, None, None, None, None, None)], schema)
    out = language_id.identify(df, df.where("doc_id % 3 <> 1")).collect()
    assert len(out) == 126 and all(len({(r.lang_pred, r.score) for r in out if r.doc_id == i}) == 1 for i in range(5))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(120)], "doc_id long, quality int")
    out = quality.score_quality(df, labels).collect()
    assert len(out) == 126 and all(len({r.score for r in out if r.doc_id == i}) == 1 for i in range(5))


def test_sample_per_class_keeps_small_classes_whole(spark):
    from docloom.llm.sampling import sample_per_class

    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, "rare").when(F.col("id") % 3 == 0, "some").otherwise("most").alias("lang"))
    got = {r.lang: r["count"] for r in sample_per_class(rows, "lang", 500).groupBy("lang").count().collect()}
    assert got["rare"] == 200 and all(350 < got[c] < 650 for c in ("some", "most"))
    assert sample_per_class(rows.limit(0), "lang", 5).count() == 0


def test_url_rules_of_one_host_and_long_urls(spark):
    rules = [("h.com", f"/{k}/", "block" if k % 2 else "allow") for k in range(300)] + [("h.com", "/", "block"), ("com", "/7/x", "allow"), ("a.h.com", "/7/", "block")]
    urls = ["http://h.com/7/x", "http://a.h.com/7/xy", "http://h.com/700/x", "http://b.com/7/xx", "http://b.com/7/", "http://h.com/8/" + "y" * 100_000, "http://" + "s." * 200 + "h.com/1/"]
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate([*urls, *urls[:2]])], "page_id long, url string, html string")
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, frame).collect()}
    want = {}
    for i, u in enumerate([*urls, *urls[:2]]):
        host, _, path = u.split("://")[1].partition("/")
        fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        want[i] = max(fits)[2:] if fits else (None, "allow")
    assert got == want


def test_url_filter(spark):
    urls = [
        "http://a.net/x", "https://WWW.Example.NET/en/1?q#f", "http://example.net/de/1", "http://www.example.com/de/2", "http://example.com/de", "http://x.org/fr/1", "http://x.org/en/1",
        None, "no-scheme", "http://", "http://Net/", "http://b.com/alias", "http://c.com/start", "http://d.com/far", "http://e.org/fr/ok", "http://notnet/x", "http://a.net?x", "http://a.net/x",
    ]
    html = {11: '<link rel="canonical" href="http://bad.net/p">', 12: '<meta http-equiv="refresh" content="0; url=//d.com/far">', 13: "<link href='http://b.com/alias' rel=canonical>", 14: '<link rel="canonical" href="http://bad.net/p">'}
    pages = spark.createDataFrame([(i, u, html.get(i), "x", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, host string, address int")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    out = {r.page_id: r for r in url_filter.judge_urls(pages, rules).collect()}
    assert len(out) == len(urls)
    assert [(out[i].rule, out[i].verdict) for i in range(11)] == [
        ("net/", "block"), ("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), (None, "allow"), ("org/fr/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("net/", "block"),
    ]
    assert (out[1].host, out[1].path) == ("www.example.net", "/en/1") and (out[7].host, out[7].path) == ("", "")
    # 14 is an explicitly allowed alias of the blocked page, so its class is allowed
    assert [out[i].verdict for i in (11, 12, 13, 14)] == ["allow"] * 4 and len({out[i].component for i in (11, 12, 13, 14)}) == 1
    some = {r.page_id: r for r in url_filter.judge_urls(pages.where("page_id <> 14"), rules).collect()}
    assert [some[i].verdict for i in (11, 12, 13)] == ["block"] * 3
    assert out[15].rule is None and out[16].rule is None and out[17].verdict == "block"
    moved = spark.createDataFrame([("http://x.org/en/1", "http://q.net/z")], "from_url string, to_url string")
    assert {r.page_id: r.verdict for r in url_filter.judge_urls(pages, rules, moved).collect()}[6] == "block"
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
