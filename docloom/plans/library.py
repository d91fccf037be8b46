"""Files, stored results, model calls and their replies, made up from the driver's tables and read back."""

import os
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from docloom import inference
from docloom.functions import text as T
from docloom.operators import aggregates, filters, models, notes
from docloom.plans.registry import query
from docloom.sources import archives, files, immutable, shared, sinks


@query("""
SELECT (page_id % 7)::VARCHAR AS path, row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) - 1 AS pos, url AS title, 'p & <' || page_id || '>' AS content, '' AS source FROM pages""")
def workbook_round_trip(t):
    """News sheets as XLSX files, and read back."""
    i = F.col("page_id")
    items = t("pages").select((i % 7).cast("string").alias("path"), i.alias("at"), F.col("url").alias("title"), F.concat(F.lit("p & <"), i, F.lit(">")).alias("content"), F.lit(None).cast("string").alias("source"), F.lit("d").alias("date"))
    sheet = items.select("path", "at", *[T.or_blank(F.col(c)).alias(c) for c in sinks.news_sheet(items).columns])
    books = files.workbooks(sheet, "path", "at")
    return files.workbook_rows(books, ["title", "content", "source"]).select("path", "pos", "title", "content", "source")


@query("SELECT source || ':' || doc_id AS id, sha256(text) AS body_sha256, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS put FROM documents")
def immutable_results(t):
    """Results put twice: half of the documents, then all of them, of which the first half are no-ops."""
    d = t("documents")
    spark, path = d.sparkSession, shared.scratch_path(d.sparkSession)
    rows = d.select("doc_id", F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("body"))
    immutable.put_results(rows.where("doc_id % 2 = 0").select("id", "body"), path)
    immutable.put_results(rows.select("id", "body"), path)
    first = immutable.stored_results(spark, path, 1).select("address", F.lit(1).alias("put"))
    every = immutable.stored_results(spark, path).join(first, "address", "left")
    return every.select("id", F.sha2("body", 256).alias("body_sha256"), F.coalesce("put", F.lit(2)).alias("put"))


@query("""
WITH m AS (SELECT (doc_id // 100) || '.zip' AS archive, CASE WHEN doc_id % 3 = 0 THEN doc_id || '.PNG' ELSE 'x' || doc_id || '.jpg' END AS name, text, doc_id FROM documents WHERE doc_id % 4 <> 1)
SELECT archive, row_number() OVER (PARTITION BY archive ORDER BY lower(name)) - 1 AS pos, name, strlen(text)::BIGINT AS size, md5(text) AS digest FROM m """)
def archive_members(t):
    """Documents as members of ZIP files of a hundred ids each, written by tasks and read back member by member."""
    d = t("documents").select("doc_id", "text", F.floor(F.col("doc_id") / 100).alias("of"))
    path = shared.scratch_path(d.sparkSession)
    folder = archives.mounted(path)

    def written(pdf: pd.DataFrame) -> pd.DataFrame:
        os.makedirs(folder, exist_ok=True)
        name = f"{folder}/{pdf.of.iloc[0]}.zip"
        with zipfile.ZipFile(f"{name}.{uuid.uuid4().hex}", "w", zipfile.ZIP_DEFLATED) as z:
            for i, text in zip(pdf.doc_id, pdf.text, strict=True):
                ending = "txt" if i % 4 == 1 else "PNG" if i % 3 == 0 else "jpg"
                z.writestr(f"{i}.{ending}" if i % 3 == 0 else f"x{i}.{ending}", text)
        os.replace(z.filename, name)
        return pd.DataFrame({"n": [len(pdf)]})

    d.groupBy("of").applyInPandas(written, "n long").write.format("noop").mode("overwrite").save()
    return archives.read_archives(d.sparkSession, path, split_bytes=65_536).select("archive", "pos", "name", "size", F.md5("content").alias("digest"))


@query("""
SELECT 'lines' AS source, CASE WHEN turn % 5 < 4 THEN conv_id END AS conv_id, CASE WHEN turn % 5 < 4 THEN turn END AS turn, turn % 5 = 4 AS malformed FROM conversations
UNION ALL SELECT 'items', conv_id, turn, false FROM conversations""")
def json_archives(t):
    """JSON lines written and read back, malformed ones marked, and items of JSON documents."""
    c = t("conversations").select("conv_id", "turn")
    spark, path = c.sparkSession, shared.scratch_path(c.sparkSession)
    line = F.when(F.col("turn") % 5 == 4, "{bad").otherwise(F.to_json(F.struct("conv_id", "turn")))
    sinks.append_lines(c.select(line.alias("value")), path)
    lines = files.json_lines(spark, path, "conv_id long, turn long").select(F.lit("lines").alias("source"), "conv_id", "turn", "malformed")
    array = F.to_json(F.collect_list(F.struct("conv_id", "turn")))
    documents = c.groupBy("conv_id").agg(array.alias("value")).select(F.when(F.col("conv_id") % 2 == 0, F.col("value")).otherwise(F.concat(F.lit('{"items": '), "value", F.lit("}"))).alias("value"))
    items = files.json_items(documents, "conv_id: bigint, turn: bigint").select(F.lit("items").alias("source"), "conv_id", "turn", F.lit(False).alias("malformed"))
    return lines.unionByName(items)


@query("""
WITH p AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'x/a' || doc_id || '.PDF' WHEN 1 THEN 'x/b' || doc_id || '.mp4' WHEN 2 THEN 'cache/c.mp4' WHEN 3 THEN 'x/merged' || doc_id || '.mkv' ELSE '' END AS path FROM documents)
SELECT 'pdf' AS list, path FROM p WHERE doc_id % 5 = 0 UNION ALL SELECT 'video', path FROM p WHERE doc_id % 5 = 1
UNION ALL SELECT 'blank path', path FROM p WHERE doc_id = 4 UNION ALL SELECT 'not a pdf', path FROM p WHERE doc_id = 1 UNION ALL SELECT 'duplicate path', 'cache/c.mp4' UNION ALL SELECT 'listed', source FROM documents GROUP BY source""")
def listings(t):
    """PDF and video files among paths, what is wrong with manifest entries, and a folder's listing."""
    i = F.col("doc_id")
    path = F.coalesce(F.when(i % 5 == 0, F.concat(F.lit("x/a"), i, F.lit(".PDF"))), F.when(i % 5 == 1, F.concat(F.lit("x/b"), i, F.lit(".mp4"))), F.when(i % 5 == 2, "cache/c.mp4"), F.when(i % 5 == 3, F.concat(F.lit("x/merged"), i, F.lit(".mkv"))), F.lit(""))
    p = t("documents").select(i.alias("pos"), path.alias("path"), "source")
    row = lambda rows, name, c="path": rows.select(F.lit(name).alias("list") if isinstance(name, str) else name.alias("list"), F.col(c).alias("path"))
    pdfs = row(files.distinct_pdfs(p.where("pos % 2 = 0"), p), "pdf")
    entries = p.where("pos in (0, 1, 2, 4, 7)").withColumn("id", F.col("pos").cast("string"))
    wrong = files.manifest_issues(entries).join(entries, "id").select(F.col("issue").alias("list"), "path").distinct()
    names = files.listing(p.groupBy(F.col("source").alias("name")).agg(F.max(F.col("pos") % 2 == 0).alias("is_dir")))
    return pdfs.unionByName(row(files.course_videos(p), "video")).unionByName(wrong).unionByName(row(names, "listed", "name"))


@query("""
WITH d AS (SELECT doc_id, lang FROM documents), changed AS (SELECT doc_id FROM d WHERE doc_id % 4 = 0)
SELECT 'put' AS step, doc_id, lang AS value FROM d WHERE doc_id % 3 > 0 UNION ALL SELECT 'conflict', doc_id, '' FROM d WHERE doc_id % 3 = 0 AND doc_id % 2 = 0
UNION ALL SELECT 'child', doc_id, CASE WHEN doc_id % 5 = 0 THEN 'fresh' ELSE lang END FROM d WHERE doc_id % 10 <> 0
UNION ALL SELECT 'restored', doc_id, CASE WHEN doc_id % 4 = 0 THEN 'was' ELSE lang END FROM d WHERE doc_id % 4 <> 1 UNION ALL SELECT 'undo', (SELECT max(doc_id) FROM d WHERE doc_id % 7 = 0 AND doc_id % 2 = 1), ''""")
def stored_results(t):
    """Immutable results, replaced children, notes rolled back and the run to undo."""
    i = F.col("doc_id")
    d = t("documents").select("doc_id", "lang")
    results = d.select(i.cast("string").alias("id"), F.col("lang").alias("body"))
    stored = results.where("id % 3 = 0").select(F.sha2("id", 256).alias("address"), F.when(F.col("id") % 2 == 0, "other").otherwise(F.col("body")).alias("body"))
    new, conflicts = sinks.immutable_put(stored, results)
    row = lambda rows, step, key, value: rows.select(F.lit(step).alias("step"), F.col(key).cast("long").alias("doc_id"), value.alias("value"))
    children = sinks.replace_children(d, d.where("doc_id % 10 = 5").withColumn("lang", F.lit("fresh")), "doc_id", d.where("doc_id % 5 = 0"))
    # of four notes one was changed twice, one was created and the others stay
    now = d.select("doc_id", i.cast("string").alias("path"), F.when(i % 4 == 0, "mid").otherwise(F.col("lang")).alias("content"))
    log = now.where("doc_id % 4 < 2").select("path", F.when(i % 4 == 0, "was").alias("before"), F.lit(0).alias("pos"))
    log = log.unionByName(now.where("doc_id % 4 = 0").select("path", F.lit("mid").alias("before"), F.lit(1).alias("pos")))
    runs = d.select(i.alias("run_id"), F.when(i % 7 == 0, 1).otherwise(0).alias("changes"), F.when(i % 2 == 0, F.lit("2024-01-01").cast("timestamp")).alias("restored_at"), F.lit(None).cast("timestamp").alias("completed_at"), F.timestamp_seconds(i).alias("created_at"))
    out = row(new, "put", "id", F.col("body")).unionByName(row(conflicts, "conflict", "id", F.lit(""))).unionByName(row(children, "child", "doc_id", F.col("lang")))
    return out.unionByName(row(sinks.rolled_back(now, log), "restored", "path", F.col("content"))).unionByName(row(sinks.latest_restorable(runs), "undo", "run_id", F.lit("")))


@query("""
SELECT doc_id, doc_id % 3 = 0 AS substantive, doc_id % 4 = 0 AS complete, CASE doc_id % 6 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS allowed, doc_id % 5 = 0 AS failed FROM documents""")
def note_checks(t):
    """Which notes have substance and complete metadata, which paths are inside their scope, and which pages failed."""
    i, lang = F.col("doc_id"), F.col("lang")
    note = F.concat(F.lit("---\ntitle: x\n---\n# Head\n- \n\n**Points:**\n"), F.when(i % 3 == 0, F.concat(F.lit("- "), lang)).when(i % 3 == 1, "*").otherwise(""))
    whole = F.concat(F.lit("---\r\ntitle: "), F.when(i % 4 == 1, "").otherwise(lang), F.lit("\r\nsummary_keywords: k\r\nrecall_questions:\r\n"), F.when(i % 4 == 2, "").otherwise("  - a -> b\r\n"), F.when(i % 4 == 3, "x").otherwise("---"), F.lit("\r\nbody"))
    path = F.coalesce(*[F.when(i % 6 == k, v) for k, v in enumerate(["notes/a.md", "notes/b/c.MD", "/notes/a.md", "notes/../a.md", "other/a.md", "notes/a.txt"])])
    text = F.when(i % 5 == 0, F.concat(F.lit("\n> OCR failed for this page: "), lang)).otherwise(F.concat(lang, F.lit(" > OCR failed for this page: ")))
    return t("documents").select("doc_id", filters.substantive(note).alias("substantive"), filters.complete_metadata(whole).alias("complete"), filters.path_allowed(path, "notes", ".md").alias("allowed"), T.ocr_failed(text).alias("failed"))


@query("""
WITH d AS (SELECT doc_id, lang, doc_id % 4 AS k FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN 'answer' WHEN 2 THEN 'question_paper' ELSE 'unknown' END AS kind, CASE WHEN k = 3 THEN 0 ELSE 1.0 END::DOUBLE AS confidence, CASE WHEN k = 3 THEN [] ELSE ['blur'] END AS issues, CASE k WHEN 0 THEN 2 ELSE 0 END::INT AS blocks,
  CASE k WHEN 0 THEN 'Page ' || doc_id || ' block 1, Q2' ELSE '' END AS labels, k <> 3 AS valid, CASE k WHEN 3 THEN 'invalid reply' WHEN 2 THEN 'printed questions omitted' END AS retry FROM d""")
def page_splits(t):
    """Split replies with their aliases and defaults, and which pages are asked again."""
    i = F.col("doc_id")
    k = i % 4
    blocks = '[{"boundary": "NEW", "answer": " text "}, {"boundary": "x", "question": "Q2", "answer_markdown": "more", "boundary_confidence": 7}, {"boundary": "new", "answer": " "}]'
    reply = F.coalesce(
        F.when(k == 0, F.concat(F.lit('```{"page_kind": " Answer", "page_kind_confidence": 3, "ocr_issues": ["blur", " blur "], "questions": '), F.lit(blocks), F.lit("}```"))),
        F.when(k == 1, '{"page_kind": "odd", "page_kind_confidence": 1, "ocr_issues": ["blur"]}'), F.when(k == 2, '{"page_kind": "question_paper", "page_kind_confidence": 1, "ocr_issues": ["blur"], "printed_questions": []}'), F.lit("no JSON"),
    )
    split = models.page_split(t("documents").select(i.alias("copy_id"), i.alias("page_number"), reply.alias("reply")))
    again = models.needs_retry(split).select("copy_id", F.col("reason").alias("retry"))
    labels = F.array_join(F.transform("questions", lambda q: q["label"]), ", ")
    rows = split.select("copy_id", "kind", F.col("kind_confidence").alias("confidence"), F.col("ocr_issues").alias("issues"), F.size("questions").alias("blocks"), labels.alias("labels"), "valid")
    return rows.join(again, "copy_id", "left").withColumnRenamed("copy_id", "doc_id")


@query("""
WITH d AS (SELECT doc_id AS i FROM documents),
f AS (SELECT i, CASE WHEN i % 2 = 0 THEN 100 ELSE 0 END AS classified, CASE WHEN i % 2 = 0 THEN 0.8 ELSE 0 END AS sure, CASE WHEN i % 3 > 0 THEN 100 ELSE 0 END AS ocr, CASE i % 3 WHEN 1 THEN 0.5 WHEN 2 THEN 0.9 ELSE 0 END AS clear, CASE WHEN i % 5 > 0 THEN 100 ELSE 0 END AS prompted,
  CASE WHEN i % 7 = 0 OR i % 4 <> 1 THEN 100 ELSE 0 END AS analysed, CASE WHEN i % 7 = 0 OR (i % 4 <> 1 AND i % 6 <> 2) THEN 100 ELSE 0 END AS backed, (i % 4) * 25.0 AS unclear FROM d)
SELECT i AS copy_id, ocr::BIGINT AS ocr_coverage, classified::BIGINT AS classified, prompted::BIGINT AS prompt_match, analysed::BIGINT AS analysis_coverage, backed::BIGINT AS evidence_coverage, unclear::DOUBLE AS unclear_percent,
  round((round(classified * sure) * 10 + round(ocr * clear) * 10 + prompted * 25 + analysed * 30 + backed * 25) / 100)::BIGINT AS overall, CASE WHEN i % 3 < 2 THEN 1 ELSE 0 END::INT AS to_review,
  list_filter([CASE WHEN classified < 90 THEN 'pages unclassified' END, CASE WHEN ocr < 90 THEN 'ocr unassessed' END, CASE WHEN i % 3 < 2 THEN 'ocr pages to review' END, CASE WHEN prompted < 80 THEN 'prompts unmatched' END, CASE WHEN analysed < 90 THEN 'analysis missing' END,
    CASE WHEN backed < 80 THEN 'evidence thin' END, CASE WHEN unclear > 2 THEN 'ocr unclear' END, CASE WHEN i % 8 = 0 THEN 'boundaries uncertain' END], lambda x: x IS NOT NULL) AS warnings FROM f""")
def analysis_figures(t):
    """Coverage, score and warnings of copies of one page and one question each."""
    i = F.col("doc_id")
    d = t("documents")
    pages = d.select(
        i.alias("copy_id"), F.lit(1).cast("long").alias("number"), F.lit("a b c d").alias("text"), F.when(i % 2 == 0, "answer").otherwise("odd").alias("kind"), F.lit(0.8).alias("kind_confidence"), (i % 4).alias("unclear_count"),
        F.when(i % 3 == 1, 0.5).when(i % 3 == 2, 0.9).alias("ocr_confidence"), F.array().cast("array<string>").alias("ocr_issues"),
    )
    point = F.array(F.struct(F.when(i % 6 == 2, " ").otherwise("seen").alias("evidence")))
    dimensions = F.when(i % 4 != 1, F.struct(point.alias("strengths"), F.array().cast("array<struct<evidence: string>>").alias("gaps")))
    questions = d.select(i.alias("copy_id"), F.when(i % 5 == 0, " ").otherwise("t").alias("title"), F.when(i % 7 == 0, "Unanswered").otherwise("answered").alias("status"), F.when(i % 8 == 0, "odd").otherwise("new").alias("boundary"), F.lit(0.9).alias("boundary_confidence"), dimensions.alias("dimensions"))
    out = aggregates.analysis_quality(pages, questions)
    return out.select("copy_id", "ocr_coverage", "classified", "prompt_match", "analysis_coverage", "evidence_coverage", "unclear_percent", "overall", F.size("ocr_review_pages").alias("to_review"), "warnings")


@query(r"""
SELECT conv_id, turn AS number, role AS name, sha256(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS text_hash FROM conversations""")
def markdown_pages(t):
    """Conversations as markdown of marked pages, and read back."""
    c = t("conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("number"), F.col("role").alias("name"), "text")
    back = notes.page_sections(notes.markdown_of_pages(c))
    return back.select(F.col("doc").alias("conv_id"), "number", "name", F.sha2("text", 256).alias("text_hash"))


@query("""
WITH b AS (SELECT user_id, (epoch_us(ts) // 1000 - 1704067200000)::BIGINT AS a, event_id FROM events)
SELECT user_id AS file, a AS start_ms, a + 1500 AS end_ms, 'e' || event_id AS text FROM b""")
def subtitle_files(t):
    """Events of each user as a subtitle file, and read back."""
    start = F.unix_millis(F.col("ts").cast("timestamp")) - 1_704_067_200_000
    blocks = t("events").select(F.col("user_id").alias("file"), start.alias("start_ms"), (start + 1500).alias("end_ms"), F.concat(F.lit("e"), "event_id").alias("text"))
    return files.subtitles(files.subtitle_text(blocks)).select("file", "start_ms", "end_ms", "text")


class Refusing(inference.HashModel):
    """A model that refuses prompts that end in the digit given."""

    def __init__(self, digit: str):
        super().__init__()
        self.digit = digit

    def complete(self, prompts):
        if any(p.endswith(self.digit) for p in prompts):
            raise RuntimeError(f"no {self.digit}")
        return super().complete(prompts)


@query("""
WITH p AS (SELECT doc_id, 'ask ' || doc_id AS prompt, doc_id % 10 AS d FROM documents)
SELECT doc_id, CASE WHEN d = 3 THEN NULL ELSE 'reply ' || left(sha256(prompt), 12) END AS reply, CASE WHEN d = 3 THEN 'no 3' ELSE '' END AS error, CASE WHEN d IN (3, 5) THEN 2 ELSE 1 END::INT AS attempts,
  CASE WHEN d = 3 THEN '> OCR failed for this page: no 3' ELSE 'reply ' || left(sha256(prompt), 12) END AS text FROM p""")
def model_replies(t):
    """Replies of the first target that answers, one by one where a batch fails, and as page text."""
    d = t("documents").select("doc_id", F.concat(F.lit("ask "), "doc_id").alias("prompt"))
    first, second = Refusing("5"), Refusing("3")
    first.complete = lambda prompts, own=first.complete: second.complete(prompts) and own(prompts)
    got = inference.ocr_text(inference.complete(d, "doc_id", "prompt", [("a", first), ("b", second)], batch=7))
    return got.select("doc_id", "reply", "error", F.size("attempts").alias("attempts"), "text")


@query("""
WITH r AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0.0 WHEN doc_id % 3 = 1 THEN doc_id / 10.0 END AS relevance_score, CASE WHEN doc_id % 2 = 0 THEN 0.5 END AS score FROM documents)
SELECT doc_id, coalesce(nullif(relevance_score, 0), score, 0)::DOUBLE AS final_score, CASE WHEN doc_id % 4 = 0 THEN 'old' ELSE 'new' END AS vector, CASE WHEN doc_id % 5 = 0 THEN 'ab' ELSE 'a' || lang END AS streamed FROM r JOIN documents USING (doc_id)""")
def index_and_streams(t):
    """Rerank scores, which vectors of an index are reused, and texts of captured event streams."""
    i = F.col("doc_id")
    d = t("documents")
    scores = inference.rerank_scores(d.select("doc_id", F.when(i % 3 == 0, 0.0).when(i % 3 == 1, i / 10.0).alias("relevance_score"), F.when(i % 2 == 0, 0.5).alias("score"))).select("doc_id", F.col("final_score").cast("double").alias("final_score"))
    n = d.select(i.cast("string").alias("path"), F.concat(F.lit("c"), "doc_id").alias("content"))
    cache = n.select("path", F.when(F.col("path") % 8 == 4, T.hash_text(F.lit("c").cast("string"))).otherwise(T.hash_text(F.col("content"))).alias("hash"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"), F.when(F.col("path") % 2 == 1, "other").otherwise("m").alias("model"))
    cache = cache.where("path % 4 = 0 or path % 4 = 1").withColumn("hash", F.when(F.col("path") % 8 == 4, T.hash_text(F.concat(F.lit("c"), "path"))).otherwise(F.col("hash")))
    index = inference.refresh_index(n, cache, inference.HashModel(), "m").select(F.col("path").cast("long").alias("doc_id"), F.when(F.size("embedding") == 2, "old").otherwise("new").alias("vector"))
    delta = lambda text: F.concat(F.lit('data: {"choices": [{"delta": {"content": "'), text, F.lit('"}}]}'))
    parts = F.array(F.lit("event: x"), delta(F.lit("a")), F.when(i % 5 == 0, delta(F.lit("b"))).otherwise(delta(F.col("lang"))), F.lit("data: {bad"), F.lit("data: [DONE]"), delta(F.lit("late")))
    streams = inference.stream_text(d.select(i.alias("id"), F.posexplode(parts).alias("pos", "line")))
    return scores.join(index, "doc_id").join(streams.select(F.col("id").alias("doc_id"), F.col("text").alias("streamed")), "doc_id")
