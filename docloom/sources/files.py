"""Readers of notes, JSON, JSON lines, subtitles, archives and workbooks, as Spark file sources and Python data sources."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T

#: Images in an archive are read up to this size in bytes.
MOST_IMAGE = 50 * 1024 * 1024
IMAGE_ENDINGS = [".png", ".jpg", ".jpeg", ".webp", ".gif", ".bmp", ".tif", ".tiff"]
VIDEO_ENDINGS = [".mp4", ".mkv", ".mov", ".avi", ".webm", ".m4v"]


def relative(path: Column, root: str) -> Column:
    """A file's path under ``root``, whatever scheme its URL has."""
    bare = F.regexp_replace(path, "^[a-z]+:/+", "/")
    inside = F.lit(root.rstrip("/") + "/")
    at = F.instr(bare, root.rstrip("/") + "/") if root else F.lit(1)
    return F.url_decode(F.regexp_replace(F.substr(bare, at + F.length(inside)), r"\+", "%2B"))


def underscored(spark: SparkSession, root: str, depth: int = 6) -> list[str]:
    """Folders under ``root`` whose name starts with an underscore: Spark's listing passes over them unless they are named."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    fs, out = at.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for k in range(depth):
        found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/*" * k + "/_*"))
        out += [f.getPath().toString() for f in found or [] if f.isDirectory()]
    return out


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def notes(spark: SparkSession, root: str, scope: str = "", inbox: bool = False) -> DataFrame:
    """(path, content) of the markdown files under ``root``: no dot folders, and with ``inbox`` no processed or pending ones."""
    at = f"{root.rstrip('/')}/{scope.strip('/')}" if scope.strip("/") else root
    if at != root and not exists(spark, at):
        return spark.createDataFrame([], "path string, content string")
    folders = [at] if inbox else [at, *underscored(spark, at)]  # a scope's files alone are listed
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,MD,Md}").text(folders, wholetext=True)
    rows = files.select(relative(F.col("_metadata.file_path"), root).alias("path"), F.col("value").alias("content"))
    rows = rows.where(~F.col("path").rlike(r"(^|/)\."))
    if scope:
        rows = rows.where((F.col("path") == scope) | F.col("path").startswith(scope.strip("/") + "/"))
    return rows.where(~F.concat(F.lit("/"), "path").rlike("/_(processed|pending)/")) if inbox else rows


def json_items(lines: DataFrame, item: str) -> DataFrame:
    """Items of JSON documents (``value``): an array, or an object with ``items``; neither gives nothing."""
    found = F.when(T.trim_ws(F.col("value")).startswith("["), F.from_json("value", f"array<struct<{item}>>")).otherwise(F.from_json("value", f"items array<struct<{item}>>")["items"])
    return lines.select(F.posexplode(found).alias("pos", "i")).select("pos", "i.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines with ``malformed``; blank lines are left out, malformed ones are rows of nulls."""
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = spark.read.text(path).where(~T.is_blank(F.col("value"))).select(parsed.alias("r"))
    return rows.select("r.*", F.col("r._bad").isNotNull().alias("malformed")).drop("_bad")


def artifacts(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Review documents (``review.json``) in the folders under ``root``, with their path."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "review.json").json(root)
    return rows.select(relative(F.col("_metadata.file_path"), root).alias("path"), *rows.columns)


def training_logs(spark: SparkSession, root: str) -> DataFrame:
    """(path, value): lines of every run's training log."""
    lines = spark.read.text(f"{root}/inbox-runs/*/training/zettel-inbox-chat.jsonl")
    return lines.select(F.col("_metadata.file_path").alias("path"), "value")


def subtitles(files: DataFrame) -> DataFrame:
    """(file, pos, start_ms, end_ms, text) of subtitle files (file, content); malformed blocks are passed over."""
    clean = F.regexp_replace(F.regexp_replace(T.or_blank(F.col("content")), "^\ufeff", ""), r"\r\n?", "\n")
    blocks = files.select("file", F.posexplode(F.split(clean, r"\n\s*\n")).alias("pos", "block"))
    pattern = r"(?s)(?:^|\n)\s*([\d:]+[,.]\d+)\s*-->\s*([\d:]+[,.]\d+)[^\n]*\n?(.*)$"
    part = lambda k: F.regexp_extract("block", pattern, k)
    rows = blocks.select("file", "pos", T.parse_time(part(1)).alias("start_ms"), T.parse_time(part(2)).alias("end_ms"), T.trim_ws(part(3)).alias("text"))
    return rows.where("start_ms is not null and end_ms is not null and text <> ''")


def subtitle_text(blocks: DataFrame) -> DataFrame:
    """(file, content): subtitle files of blocks in order, numbered anew."""
    parts = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "text")))
    line = lambda b, i: F.format_string("%d\n%s --> %s\n%s\n\n", i + 1, T.style_time(b["start_ms"]), T.style_time(b["end_ms"]), b["text"])
    return blocks.groupBy("file").agg(F.array_join(F.transform(parts, line), "").alias("content"))


def archive_images(files: DataFrame) -> DataFrame:
    """(archive, pos, name, content): images in ZIP files (path, content: binary) by lower-case name; larger ones and links out of it are left out."""

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf.path, pdf.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    found = [i for i in z.infolist() if not i.is_dir() and any(i.filename.lower().endswith(e) for e in IMAGE_ENDINGS) and i.file_size <= MOST_IMAGE]
                    for k, i in enumerate(sorted(found, key=lambda i: (i.filename.lower(), i.filename))):
                        yield pd.DataFrame({"archive": [path], "pos": [k], "name": [i.filename], "content": [z.read(i)]})

    return files.select("path", "content").mapInPandas(read, "archive string, pos long, name string, content binary")


def sheet_rows(z: zipfile.ZipFile, columns: list[str]) -> Iterator[list[str]]:
    """The rows of a workbook's first sheet by normalised header, blank ones left out, parsed as a stream.

    Only the shared strings are held. A column whose header is missing reads the sheet's first column.
    """
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

    def elements(name: str, tag: str) -> Iterator[ElementTree.Element]:
        with z.open(name) as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag == ns + tag:
                    yield e
                    e.clear()

    def index(ref: str) -> int:
        n = 0
        for c in ref:
            if not c.isalpha():
                break
            n = n * 26 + ord(c.upper()) - 64
        return n - 1

    names = z.namelist()
    shared = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in elements("xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in names else []
    at = None
    for row in elements(min(n for n in names if n.startswith("xl/worksheets/") and n.endswith(".xml")), "row"):
        cells: dict[int, str] = {}
        for k, c in enumerate(row.iter(f"{ns}c")):
            raw = "".join(t.text or "" for t in c.iter(f"{ns}t")) if c.get("t") == "inlineStr" else (c.findtext(f"{ns}v") or "")
            cells[index(c.get("r")) if c.get("r") else k] = shared[int(raw)] if c.get("t") == "s" and raw else raw
        if at is None:
            header = {v.strip().lower(): k for k, v in cells.items()}
            at = [header.get(c.lower(), 0) for c in columns]
            continue
        values = [cells.get(k, "").strip() for k in at]
        if any(values):
            yield values


def workbook_rows(files: DataFrame, columns: list[str]) -> DataFrame:
    """(path, pos, columns): rows of the first sheet of XLSX files (path, content: binary), by normalised header.

    Headers are compared in lower case without white space around. A column whose header is missing reads the sheet's first
    column. Blank rows are left out.
    """
    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for path, content in zip(pdf.path, pdf.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows = sheet_rows(z, columns)
                    for first in range(0, 1 << 62, 4096):
                        some = list(islice(rows, 4096))
                        if not some:
                            break
                        yield pd.DataFrame([[path, first + i, *r] for i, r in enumerate(some)], columns=["path", "pos", *columns])

    return files.select("path", "content").mapInPandas(read, "path string, pos long, " + ", ".join(f"`{c}` string" for c in columns))


def workbook(rows: pd.DataFrame) -> bytes:
    """A small table as an XLSX file of one sheet with inline strings: a report for people, not a sink for large data."""
    from xml.sax.saxutils import escape

    cell = lambda v: f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'
    lines = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [list(rows.columns), *rows.values.tolist()])
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{lines}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in files.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + body)
    return out.getvalue()


def workbooks(rows: DataFrame, scope: str, *order: str) -> DataFrame:
    """(scope, content): an XLSX file of each scope's other columns, its rows in ``order``; a sheet holds 1,048,575 rows at most by its format."""
    columns = [c for c in rows.columns if c != scope]

    def book(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({scope: [pdf[scope].iloc[0]], "content": [workbook(pdf.sort_values(list(order), kind="stable")[columns])]})

    return rows.groupBy(scope).applyInPandas(book, f"{scope} {dict(rows.dtypes)[scope]}, content binary")


def by_ending(spark: SparkSession, path: str) -> str:
    """Which reader a path needs, by its ending without regard to case."""
    ending = path.lower().rpartition(".")[2]
    kinds = {"json": "json", "jsonl": "jsonl", "xlsx": "xlsx", "md": "notes", "srt": "subtitles", "zip": "archive", "pdf": "pdf"}
    if ending not in kinds:
        raise ValueError(f"unsupported file type: {path}")
    return kinds[ending]


def distinct_pdfs(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(path): listed and then found PDF files, each once, in order. Both: pos, path."""
    both = listed.select(F.lit(0).alias("list"), "pos", "path").unionByName(found.select(F.lit(1).alias("list"), "pos", "path"))
    fine = both.where(T.extension(F.col("path")) == ".pdf")
    return fine.groupBy("path").agg(F.min(F.struct("list", "pos")).alias("at")).orderBy("at").select("path")


def course_videos(files: DataFrame) -> DataFrame:
    """(path): video files outside cache, course and trash folders whose names aren't slideshows or merged files."""
    low = F.lower("path")
    fine = T.extension(F.col("path")).isin(VIDEO_ENDINGS) & ~low.rlike(r"(^|/)(\.[^/]+|cache|courses?|trash)/") & ~F.lower(T.base_name(F.col("path"))).rlike("slideshow|merged")
    return files.where(fine).select("path")


def listing(entries: DataFrame) -> DataFrame:
    """Folder entries (name, is_dir) as shown: ``..`` first, then folders, then by name without regard to case."""
    return entries.orderBy((F.col("name") != "..").cast("int"), F.desc("is_dir"), F.lower("name"), "name")


def media_summary(probe: Column) -> Column:
    """struct<duration_s, codecs> of a media probe's JSON; codecs in order, blanks left out."""
    p = F.from_json(probe, "format struct<duration: string>, streams array<struct<codec_type: string, codec_name: string>>")
    codecs = F.filter(F.transform(p["streams"], lambda s: F.concat_ws(":", s["codec_type"], s["codec_name"])), lambda x: x != "")
    return F.struct(p["format"]["duration"].try_cast("double").alias("duration_s"), F.array_join(F.coalesce(codecs, F.array().cast("array<string>")), ", ").alias("codecs"))


def pdf_pages(info: Column) -> Column:
    """The page count of a PDF tool's output; null without one."""
    return F.regexp_extract(T.or_blank(info), r"(?m)^Pages:\s*(\d+)", 1).try_cast("long")


def manifest_issues(entries: DataFrame) -> DataFrame:
    """(id, issue): manifest entries (id, path) with blank or repeated ids or paths, or another file type."""
    n = entries.groupBy("id").agg(F.count("*").alias("ids"))
    m = entries.groupBy("path").agg(F.count("*").alias("paths"))
    both = entries.join(n, "id").join(m, "path")
    issue = F.when(T.is_blank(F.col("id")), "blank id").when(F.col("ids") > 1, "duplicate id").when(T.is_blank(F.col("path")), "blank path").when(F.col("paths") > 1, "duplicate path").when(T.extension(F.col("path")) != ".pdf", "not a pdf")
    return both.select("id", issue.alias("issue")).where("issue is not null").distinct()


def strict_issue(value: Column, schema: str, required: list[str], allowed: list[str]) -> Column:
    """Why a JSON object isn't accepted: malformed, an unknown field, a missing one or a wrong type; null if it is fine."""
    keys = F.json_object_keys(value)
    types = F.from_json(value, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    one = F.json_array_length(F.concat(F.lit("["), value, F.lit("]"))) == 1  # also tells what follows an object
    bad = ~F.coalesce(one, F.lit(False)) | F.try_parse_json(value).isNull() | keys.isNull()
    return (
        F.when(bad, "malformed")
        .when(F.size(F.array_except(keys, F.array(*[F.lit(a) for a in allowed]))) > 0, "unknown field")
        .when(F.size(F.array_except(F.array(*[F.lit(r) for r in required]), keys)) > 0, "missing field")
        .when(types["_bad"].isNotNull(), "wrong type")
    )


def suite_issues(suites: DataFrame) -> DataFrame:
    """(suite_id, issue) of benchmark suites: version 1, cases, distinct ids, pages and expected questions on known pages."""
    rows = suites.select("suite_id", "version", "cases")
    top = F.when(F.col("version") != 1, "unknown version").when(F.coalesce(F.size("cases"), F.lit(0)) <= 0, "no cases")
    cases = rows.select("suite_id", F.explode("cases").alias("c"))
    numbers = F.transform("c.pages", lambda p: p["number"])
    asked = F.flatten(F.transform("c.expected_questions", lambda q: q["source_pages"]))
    issue = (
        F.when(T.is_blank(F.col("c.id")), "blank case id")
        .when(F.size("c.pages") <= 0, "no pages")
        .when(F.size(F.array_distinct(numbers)) < F.size(numbers), "duplicate page")
        .when(F.size(F.array_except(asked, numbers)) > 0, "question on unknown page")
    )
    repeated = cases.groupBy("suite_id", "c.id").count().where("count > 1").select("suite_id", F.lit("duplicate case id").alias("issue"))
    return rows.select("suite_id", top.alias("issue")).where("issue is not null").unionByName(cases.select("suite_id", issue.alias("issue")).where("issue is not null")).unionByName(repeated).distinct()
