"""Containment joins and the matches found by them, against brute force."""

import random
import time
from datetime import datetime, timedelta

import pyarrow as pa
import pytest

from docloom.operators import search


def test_containing(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abé_%𝒳 ") for _ in range(n))
    texts = [(i, word(rng.randint(0, 30))) for i in range(80)] + [(80, None), (81, "ab"), (81, "ab"), (82, "a%b_c")]
    needles = [word(rng.randint(1, 5)) for _ in range(60)] + ["", None, "a", "a", "%b_", "zzz", "ab\nc"]
    got = search.containing(spark.createDataFrame([(n,) for n in needles], "needle string"), spark.createDataFrame(texts, "text_id long, text string")).collect()
    want = {(n, i) for n in needles if n for i, t in texts if t is not None and n in t}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    none = spark.createDataFrame([], "needle string")
    assert search.containing(none, spark.createDataFrame(texts, "text_id long, text string")).count() == 0


def test_long_texts_are_cut_in_linear_time(spark):
    n = 3_000_000  # a cut of characters from the start each took the square of this
    texts = spark.createDataFrame([(1, "x" * n + " the needle here" + "y" * n), (2, "the needl"), (3, "z" * n)], "text_id long, text string")
    needles = spark.createDataFrame([("the needle here",), ("needl",), ("zzzz" * 10,), ("xz",)], "needle string")
    began = time.monotonic()
    assert {tuple(r) for r in search.containing(needles, texts).collect()} == {("the needle here", 1), ("needl", 1), ("needl", 2), ("zzzz" * 10, 3)}
    assert time.monotonic() - began < 60


def test_grams_across_cuts(monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 40))) for _ in range(50)]
    number = lambda b: int.from_bytes(b, "little") | (len(b) << 56 if len(b) < 8 else 0)
    want = sorted({(i, number(t.encode()[k : k + n])) for i, t in enumerate(texts) for n in (2, 8) for k in range(len(t.encode()) - n + 1)})
    for step in (7, 100, 10_000):
        monkeypatch.setattr(search, "CUT_BYTES", step)
        owner, code = search.grams(pa.array(texts), [2, 8])
        assert list(zip(owner.tolist(), code.tolist(), strict=True)) == want


def test_search_each(spark):
    queries = spark.createDataFrame([(1, " Fog ", ""), (2, "fog", "ready"), (3, "x%", None), (4, " ", ""), (5, "none", "")], "query_id long, query string, status string")
    rows = spark.createDataFrame([(10, "fog.pdf", "x", "ready"), (11, None, "dense FOG", "draft"), (12, "x%y", "fo g", "draft")], "id long, name string, text string, status string")
    got = {tuple(r) for r in search.search_each(queries, rows, "id", ["name", "text"], status=True).collect()}
    assert got == {(1, 10), (1, 11), (2, 10), (3, 12)}


def brute(wanted, offered, with_status, apart):
    out = {}
    for w, path, name in wanted:
        path = (path or "").strip().lower()
        own = ((name or "").strip() or path.rstrip("/").rsplit("/", 1)[-1]).lower()
        best = None
        for o, opath, oname, more, status, at in offered:
            opath, oname = (opath or "").strip().lower(), (oname or "").strip().lower()
            oname = oname or opath.rstrip("/").rsplit("/", 1)[-1]
            if not own or (apart and o == w) or not any(own in x for x in (oname, opath, (more or "").lower())) or (path and opath and path != opath):
                continue
            rank = 8 * bool(path and path == opath) + 4 * (own == oname) + 2 * (with_status and (status or "").lower() == "ready")
            turn = (-rank, -at.timestamp(), o)
            if rank and (best is None or turn < best):
                best = turn
        if best:
            out[w] = (best[2], -best[0])
    return out


@pytest.mark.parametrize(("with_status", "apart"), [(True, False), (False, True), (True, True)])
def test_best_found(spark, with_status, apart):
    rng = random.Random(8)
    paths, names = ["", None, "/a/Fog.pdf", "/b/rain.pdf", " /A/fog.pdf "], ["", None, "fog.pdf", "Rain.pdf", "ra", "mist"]
    wanted = [(i, rng.choice(paths), rng.choice(names)) for i in range(60)]
    t = datetime(2024, 1, 1)
    more = ["", None, "about rain.pdf", "FOG.PDF and mist", "nothing"]
    offered = [(i, rng.choice(paths), rng.choice(names), rng.choice(more), rng.choice(["ready", "Ready", "draft", None]), t + timedelta(hours=rng.randint(0, 3))) for i in range(40)]
    got = search.best_found(
        spark.createDataFrame(wanted, "wanted_id long, source_path string, pdf_name string"),
        spark.createDataFrame(offered, "offered_id long, source_path string, pdf_name string, search_text string, status string, updated_at timestamp"),
        with_status,
        apart,
    )
    assert {r.wanted_id: (r.offered_id, r["rank"]) for r in got.collect()} == brute(wanted, offered, with_status, apart)
