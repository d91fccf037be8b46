"""Files, sinks and streams."""

import io
import zipfile
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from docloom.sources import files, sinks, tables
from docloom.streaming import quota


def df(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_notes(spark, tmp_path):
    for name in ("a.md", "x/b.md", ".git/c.md", "x/_pending/d.md", "x/_processed/e.md", "f.txt", "x/with space+plus.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("note " + name)
    got = {r.path: r.content for r in files.notes(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.md", "x/b.md", "x/_pending/d.md", "x/_processed/e.md", "x/with space+plus.md"} and got["a.md"] == "note a.md"
    assert {r.path for r in files.notes(spark, str(tmp_path), "x", inbox=True).collect()} == {"x/b.md", "x/with space+plus.md"}


def test_json(spark, tmp_path):
    lines = df(spark, "value string", ('[{"title": "a"}, {"title": "b"}]',), ('{"items": [{"title": "c"}]}',), ('{"other": 1}',))
    assert sorted(r.title for r in files.json_items(lines, "title: string").collect()) == ["a", "b", "c"]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{bad\n')
    got = files.json_lines(spark, str(tmp_path / "x.jsonl"), "a long").collect()
    assert sorted((r.a or 0, r.malformed) for r in got) == [(0, True), (1, False)]
    issue = lambda v: df(spark, "v string", (v,)).select(files.strict_issue(F.col("v"), "a long, b string", ["a"], ["a", "b"]).alias("i")).first().i
    assert [issue(v) for v in ('{"a": 1}', '{"a": 1, "z": 2}', '{"b": "x"}', "{", '{"a": "x"}')] == [None, "unknown field", "missing field", "malformed", "wrong type"]


def test_artifacts(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "review.json").write_text('{\n "name": "x"\n}')
    (tmp_path / "other.json").write_text('{"name": "y"}')
    assert [tuple(r) for r in files.artifacts(spark, str(tmp_path), "name string").collect()] == [("a b/review.json", "x")]


def test_subtitles(spark):
    content = "\ufeff1\r\n00:00:01,000 --> 00:00:02,500\r\nHello\r\nthere\r\n\r\nbroken\r\n\r\n3\r\n00:01:00.000 --> 00:01:01.000\r\nBye\r\n"
    blocks = files.subtitles(df(spark, "file string, content string", ("f", content)))
    assert [(r.start_ms, r.end_ms, r.text) for r in blocks.orderBy("pos").collect()] == [(1000, 2500, "Hello\nthere"), (60000, 61000, "Bye")]
    back = files.subtitle_text(blocks).first().content
    assert back.startswith("1\n00:00:01,000 --> 00:00:02,500\nHello") and "2\n00:01:00,000" in back


def test_archives_and_workbooks(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name in ("B.png", "a.JPG", "x.txt"):
            z.writestr(name, name)
    rows = files.archive_images(df(spark, "path string, content binary", ("z", bytearray(out.getvalue())))).orderBy("pos").collect()
    assert [r.name for r in rows] == ["a.JPG", "B.png"] and bytes(rows[0].content) == b"a.JPG"
    book = files.workbook(pd.DataFrame({"Title": ["a & b", ""], "content": ["x", ""], "Source": ["s", ""]}))
    got = files.workbook_rows(df(spark, "path string, content binary", ("w", bytearray(book))), ["title", "content", "source", "date"]).collect()
    assert [(r.title, r.content, r.source, r.date) for r in got] == [("a & b", "x", "s", "a & b")]  # a missing header reads the first column


def test_small_readers(spark):
    probe = '{"format": {"duration": "12.5"}, "streams": [{"codec_type": "video", "codec_name": "h264"}, {"codec_type": "audio"}]}'
    assert tuple(df(spark, "p string", (probe,)).select(files.media_summary(F.col("p")).alias("m")).first().m) == (12.5, "video:h264, audio")
    assert df(spark, "p string", ("Title: x\nPages:   12\n",)).select(files.pdf_pages(F.col("p")).alias("n")).first().n == 12
    listed = df(spark, "name string, is_dir boolean", ("b", False), ("A", True), ("..", True), ("a", False))
    assert [r.name for r in files.listing(listed).collect()] == ["..", "A", "a", "b"]
    pdfs = files.distinct_pdfs(df(spark, "pos long, path string", (0, "b.PDF"), (1, "x.txt")), df(spark, "pos long, path string", (0, "a.pdf"), (1, "b.PDF")))
    assert [r.path for r in pdfs.collect()] == ["b.PDF", "a.pdf"]
    videos = files.course_videos(df(spark, "path string", ("x/a.mp4",), ("cache/b.mp4",), ("x/merged.mp4",), ("c.txt",), ("Trash/d.mkv",)))
    assert [r.path for r in videos.collect()] == ["x/a.mp4"]
    assert files.by_ending(spark, "A.XLSX") == "xlsx"
    issues = {r.issue for r in files.manifest_issues(df(spark, "id string, path string", ("a", "x.pdf"), ("a", "y.pdf"), ("b", "z.txt"))).collect()}
    assert issues == {"duplicate id", "not a pdf"}


def test_upsert(spark):
    t = [datetime(2024, 1, d) for d in (1, 2, 3)]
    schema = "id string, v long, created_at timestamp, updated_at timestamp"
    old = df(spark, schema, ("a", 1, t[0], t[0]), ("b", 2, t[0], t[0]))
    changes = df(spark, schema + ", seq long", ("a", 5, t[1], t[1], 1), ("a", 6, t[1], t[1], 2), ("c", 7, t[1], t[1], 0), ("b", None, t[1], t[1], 0))
    got = {r.id: (r.v, r.created_at, r.updated_at) for r in sinks.upsert(old, changes, "id", F.lit(t[2]).cast("timestamp")).collect()}
    assert got == {"a": (6, t[0], t[2]), "b": (None, t[0], t[2]), "c": (7, t[1], t[2])}


def test_sinks(spark, tmp_path):
    new, conflicts = sinks.immutable_put(sinks.immutable_put(df(spark, "address string, body string"), df(spark, "id string, body string", ("a", "1"), ("b", "2")))[0].select("address", "body"), df(spark, "id string, body string", ("a", "1"), ("b", "9"), ("c", "3")))
    assert [r.id for r in new.collect()] == ["c"] and [r.id for r in conflicts.collect()] == ["b"]
    log = df(spark, "path string, before string, pos long", ("a", "old", 0), ("a", "mid", 1), ("new", None, 2), ("gone", "was", 3))
    now = df(spark, "path string, content string", ("a", "now"), ("new", "x"), ("other", "y"))
    assert {tuple(r) for r in sinks.rolled_back(now, log).collect()} == {("a", "old"), ("other", "y"), ("gone", "was")}
    rows = df(spark, "copy_id string, v long", ("a", 1), ("b", 2))
    sinks.save(rows, str(tmp_path / "t"), ["copy_id"])
    sinks.save(df(spark, "copy_id string, v long", ("a", 9)), str(tmp_path / "t"), ["copy_id"])
    assert {(r.copy_id, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 9), ("b", 2)}
    kids = sinks.replace_children(rows, df(spark, "copy_id string, v long", ("a", 7)), "copy_id", rows.select("copy_id"))
    assert {tuple(r) for r in kids.collect()} == {("a", 7)}
    assert tables.point(rows, "copy_id", "a").first().v == 1
    for missing in (lambda: tables.point(rows, "copy_id", "z"), lambda: sinks.update_one(rows, "copy_id", "z", {})):
        try:
            missing()
        except KeyError:
            continue
        raise AssertionError("a missing row must raise")


def events(spark, n=60):
    t0 = datetime(2024, 1, 1, 23, 59)
    return df(spark, "key string, event_id long, ts timestamp, tokens long", *[("ab"[i % 2], i, t0 + timedelta(seconds=7 * i), 10 + i % 5) for i in range(n)])


def run(stream, name, spark):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_admission_streams_like_it_replays(spark, tmp_path):
    rows = events(spark)
    rows.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    limits = {"per_minute": 3, "tokens_per_minute": 30, "per_day": 12}
    want = {r.event_id: (r.admitted, r.reason) for r in quota.admitted_batch(rows, **limits).collect()}
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    got = {r.event_id: (r.admitted, r.reason) for r in run(quota.admitted(stream, **limits), "admission", spark).collect()}
    assert got == want and {r for _, r in want.values()} >= {"", "tokens"}


def test_ready_prefix(spark, tmp_path):
    df(spark, "course string, part long", ("a", 1), ("a", 3), ("a", 0), ("b", 1)).write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema("course string, part long").parquet(str(tmp_path / "p"))
    got = sorted((r.course, r.part) for r in run(quota.released(stream), "ready", spark).collect())
    assert got == [("a", 0), ("a", 1)]


def test_admission_keeps_one_quota_a_key_over_midnight(spark, tmp_path):
    from docloom.plans.registry import QUERIES

    # the last requests of a day, one every 20 seconds over midnight for three days, and a busy hour each day
    at = [86_400 * d + 20 * k for d in range(1, 4) for k in range(-9, 9)] + [86_400 * d + 43_200 + 60 * k for d in range(4) for k in range(60)]
    rows = [(i, "click", s, 9.5) for i, s in enumerate(at)]
    events = spark.createDataFrame(rows, "event_id long, event_type string, s long, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    events.write.parquet(f"{tmp_path}/events.parquet")
    want, kept, used = {}, [], {}
    for s, i in sorted((s, i) for i, s in enumerate(at)):
        day, near = s // 86_400, sum(k > s - 60 for k in kept)
        want[i] = "day" if used.get(day, 0) >= 40 else "minute" if near >= 2 else ""
        if not want[i]:
            kept.append(s)
            used[day] = used.get(day, 0) + 1
    got = {r.event_id: (r.admitted, r.reason) for r in QUERIES["admission"](spark, str(tmp_path)).collect()}
    assert got == {i: (not r, r) for i, r in want.items()} and {"day", "minute", ""} == set(want.values())
