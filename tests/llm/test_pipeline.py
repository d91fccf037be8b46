"""The pipeline's stages against brute force on a small table, and the driver's tables end to end."""

import os
import random
import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline
from docloom.llm import mixing, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    vocabulary = "the rain falls on old stone and green fields while people walk home near a quiet river".split()
    good = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    rows, labels = [], []
    for i in range(160):
        junk = i % 4 == 0
        text = " ".join(w.upper() + "!!" for w in good(30).split()) if junk else good(rng.randint(20, 120))
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(not junk), 0))
    rows += [(200 + i, rows[1][1].replace(" ", "  "), "en", "s0", 1) for i in range(3)]
    rows += [(300, rows[2][1] + " quiet", "en", None, 1), (301, None, "en", "s1", 0), (302, "", None, "s1", 0)]
    where = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    kept = pipeline.quality(spark, docs, folder)
    assert kept.columns == names
    ids = {r.doc_id for r in kept.collect()}
    assert sum(i in ids for i in range(160) if i % 4) >= 0.97 * 120 and sum(i in ids for i in range(160) if i % 4 == 0) <= 2
    exact = pipeline.exact(spark, docs, folder)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for r in docs.orderBy("doc_id").collect():
        first.setdefault(norm(r.text), r.doc_id)
    assert exact.columns == names and {r.doc_id for r in exact.collect()} == set(first.values())
    near = pipeline.near(spark, docs, folder)
    of = {r.doc_id: r.component_id for r in simhash.simhash_components(docs).collect()}
    assert near.columns == names and {r.doc_id for r in near.collect()} == set(of.values())
    mixed = pipeline.mixing(spark, docs, folder)
    taken = {r.doc_id: (r["size"], r.taken) for r in mixing.mix_documents(docs).collect() if r.taken}
    texts = {r.doc_id: r.text for r in docs.collect()}
    copies = Counter()
    for r in mixed.collect():
        assert r.text == texts[r.doc_id]  # whole, never cut
        copies[r.doc_id] += 1
    assert mixed.columns == names and copies == {i: (2 * t + s) // (2 * s) for i, (s, t) in taken.items() if 2 * t >= s}
    assert pipeline.packing(spark, mixed, folder).count() == mixed.count()


def test_rows_of_null_and_repeated_ids_stay(spark):
    words = [[f"w{k}x{i}" for i in range(40)] for k in range(5)]
    texts = [" ".join(w) for w in words]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (1, texts[2]), (2, texts[2]), (2, texts[3]), (3, texts[4])]
    docs = spark.createDataFrame([(i, t, "en", "s0", 1) for i, t in rows], SCHEMA)
    want = Counter([(None, texts[0]), (None, texts[1]), (1, texts[2]), (2, texts[3]), (3, texts[4])])
    exact = pipeline.exact(spark, docs, "")
    assert Counter((r.doc_id, r.text) for r in exact.collect()) == want
    near = pipeline.near(spark, exact, "")
    assert Counter((r.doc_id, r.text) for r in near.collect()) == want
    assert Counter((r.doc_id, r.text) for r in pipeline.mixing(spark, near, "").collect()) == want


def test_quality_stage_passes_columns_of_any_name(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = docs.selectExpr("*", "'a' as score", "2 as predicted", "3 as _bytes", "4 as _kept0")
    kept = pipeline.quality(spark, more, folder)
    assert kept.columns == more.columns and kept.count() == pipeline.quality(spark, docs, folder).count()
    assert {(r.score, r.predicted, r._bytes, r._kept0) for r in kept.collect()} == {("a", 2, 3, 4)}


def test_run(spark, folder):
    out = pipeline.run(spark, folder)
    assert out.count() > 50 and set(out.columns) == {"doc_id", "size", "bucket_length", "batch_id", "slot"}
    assert [name for name, _ in pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "mixing", "packing"]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables aren't here")
def test_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
