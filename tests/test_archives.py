"""Archives and workbooks as data sources: members by partition, filters that choose what is opened."""

import io
import zipfile

import pandas as pd
import pytest

from docloom.sources import archives, files


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members:
            z.writestr(name, body)
    return out.getvalue()


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.zip").write_bytes(zipped([("B.png", b"1"), ("a.JPG", b"22"), ("note.txt", b"x"), ("dir/", b""), ("c.gif", b"333")]))
    (tmp_path / "sub/b.ZIP").write_bytes(zipped([(f"{i:03}.png", bytes([i]) * 1000) for i in range(200)]))
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    return tmp_path


def test_members(spark, folder):
    rows = archives.read_archives(spark, str(folder), [("archive", "in", ["a.zip", "sub/b.ZIP"])], split_bytes=20_000)
    got = {(r.archive, r.pos): (r.name, r.size, bytes(r.content)) for r in rows.collect()}
    assert {k: v for k, v in got.items() if k[0] == "a.zip"} == {("a.zip", 0): ("a.JPG", 2, b"22"), ("a.zip", 1): ("B.png", 1, b"1"), ("a.zip", 2): ("c.gif", 3, b"333")}
    assert {v[2] for k, v in got.items() if k[0] == "sub/b.ZIP"} == {bytes([i]) * 1000 for i in range(200)}
    assert rows.rdd.getNumPartitions() > 5  # the larger archive is split


def test_filters_choose_archives_and_members(spark, folder):
    some = lambda *filters: archives.read_archives(spark, str(folder), list(filters))
    assert [r.name for r in some(("archive", "=", "a.zip"), ("size", ">", 1)).orderBy("pos").collect()] == ["a.JPG", "c.gif"]
    assert some(("archive", "starts", "sub/"), ("name", "ends", "7.png")).count() == 20
    assert some(("archive", "=", "none.zip")).count() == 0
    shared = some(("archive", "<", "b"))
    assert (shared.where("size > 1").count(), shared.count()) == (2, 3)
    with pytest.raises(Exception, match="zip"):
        some().count()  # without a filter the broken one is opened
    with pytest.raises(Exception, match="no filter"):
        some(("content", "=", 1)).count()
    with pytest.raises(ValueError, match="mounted"):
        archives.mounted("hdfs://host/x")


def test_same_as_whole_files(spark, folder):
    (folder / "bad.zip").unlink()
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(folder)).where("lower(path) like '%.zip'")
    want = {(r.pos, r.name, bytes(r.content)) for r in files.archive_images(whole).collect()}
    assert {(r.pos, r.name, bytes(r.content)) for r in archives.read_archives(spark, str(folder), split_bytes=9000).collect()} == want


def test_workbooks(spark, tmp_path):
    rows = pd.DataFrame({"Title ": [f"t{i}" for i in range(5000)] + [""], "content": ["x & y"] * 5000 + [" "], "Source": [str(i) for i in range(5000)] + [""]})
    (tmp_path / "one.xlsx").write_bytes(files.workbook(rows))
    (tmp_path / "two.xlsx").write_bytes(b"broken")
    got = archives.read_workbooks(spark, str(tmp_path), ["title", "source", "date"], [("path", "=", "one.xlsx")]).orderBy("pos").collect()
    assert [(r.pos, r.title, r.source, r.date) for r in got] == [(i, f"t{i}", str(i), f"t{i}") for i in range(5000)]


def test_notes_list_their_scope_alone(spark, tmp_path):
    for name in ("x/a.md", "x/_own/b.md", "xy/c.md", "x/.hid/d.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    assert {r.path for r in files.notes(spark, str(tmp_path), "x").collect()} == {"x/a.md", "x/_own/b.md"}
    assert {r.path for r in files.notes(spark, str(tmp_path), "x/a.md").collect()} == {"x/a.md"}
    assert files.notes(spark, str(tmp_path), "none").count() == 0


def test_many_small_archives_share_partitions(spark, tmp_path):
    """Before, each of them was a task of its own."""
    for i in range(3000):
        with zipfile.ZipFile(tmp_path / f"{i}.zip", "w") as z:
            z.writestr("a.png", str(i))
    rows = archives.read_archives(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() <= 2 * archives.OWN_PARTITIONS
    assert sorted((r.archive, r.pos, bytes(r.content)) for r in rows.collect()) == sorted((f"{i}.zip", 0, str(i).encode()) for i in range(3000))
