"""Stored records: scans, writes, joins and aggregates of jobs, pages, questions and notes, made up from the driver's tables."""

from pyspark.sql import functions as F

from docloom.functions import numbers as N
from docloom.functions import text as T
from docloom.operators import aggregates, dedup, filters, joins, models, packing, study
from docloom.plans.registry import query
from docloom.sources import sinks, tables


@query("""
WITH u AS (SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00'), c AS (SELECT l_linenumber FROM lineitem WHERE l_orderkey = 33), p AS (SELECT n_name FROM nation WHERE n_nationkey = 7)
SELECT 'usage' AS scan, event_id AS at FROM u UNION ALL SELECT 'child', l_linenumber FROM c UNION ALL SELECT 'point', strlen(n_name) FROM p""")
def scans(t):
    """Usage since a time, the children of a key, and the row of a key."""
    usage = tables.usage_since(t("events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("occurred_at")), F.lit("2024-01-15 12:00:00").cast("timestamp"))
    child = tables.children(t("lineitem"), "l_orderkey", 33, F.col("l_linenumber"))
    point = tables.point(t("nation"), "n_nationkey", 7)
    row = lambda rows, kind, at: rows.select(F.lit(kind).alias("scan"), at.cast("long").alias("at"))
    return row(usage, "usage", F.col("id")).unionByName(row(child, "child", F.col("l_linenumber"))).unionByName(row(point, "point", F.octet_length("n_name")))


_JOBS = "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'queued' END AS status, '' AS error, o_totalprice AS units FROM orders"


def _jobs(t):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("queued")
    return t("orders").select(F.col("o_orderkey").alias("id"), status.alias("status"), F.lit("").alias("error"), F.col("o_totalprice").alias("units"), F.lit(None).cast("timestamp").alias("finished_at"))


@query(f"""
WITH j AS ({_JOBS}), m AS (SELECT id, CASE WHEN status = 'completed' THEN status ELSE 'failed' END AS status, CASE WHEN status = 'completed' THEN '' ELSE 'interrupted' END AS error, CASE WHEN id = 7 THEN -1.0 WHEN units > 200000 THEN 0.0 ELSE units END AS units FROM j)
SELECT 'updated' AS step, id, status, error, round(units, 2) AS units FROM m UNION ALL SELECT 'kept', id, status, error, round(units, 2) FROM j WHERE status <> 'completed'""")
def job_updates(t):
    """Jobs after an update of many rows, of one, and after a stopped process; and those left when finished ones are deleted."""
    jobs = _jobs(t)
    changed = sinks.update_one(sinks.update(jobs, F.col("units") > 200_000, {"units": F.lit(0.0)}), "id", 7, {"units": F.lit(-1.0)})
    now = F.lit("2024-01-01").cast("timestamp")
    row = lambda rows, step: rows.select(F.lit(step).alias("step"), "id", "status", "error", F.round("units", 2).alias("units"))
    return row(sinks.interrupted(changed, now), "updated").unionByName(row(sinks.delete_finished(jobs), "kept"))


@query(f"""
WITH j AS ({_JOBS}), o AS (SELECT id, CASE WHEN id % 3 = 0 THEN '' WHEN id % 3 = 1 THEN 'context canceled' ELSE 'HTTP 500' END AS said FROM j WHERE id % 2 = 0)
SELECT j.id, CASE WHEN o.id IS NULL THEN status WHEN said = '' THEN 'completed' WHEN said = 'context canceled' THEN 'cancelled' ELSE 'failed' END AS status,
  CASE WHEN said = '' THEN 1.0 ELSE 0.25 END AS progress, CASE WHEN said = '' THEN 8 ELSE 2 END::BIGINT AS units_done, coalesce(said, '') AS error FROM j LEFT JOIN o USING (id)""")
def job_finishes(t):
    """Jobs after the outcome of every second one."""
    jobs = _jobs(t).select("id", "status", F.lit(0.25).alias("progress"), F.lit(2).cast("long").alias("units_done"), F.lit(8).cast("long").alias("units_total"), "error")
    said = F.when(F.col("id") % 3 == 0, "").when(F.col("id") % 3 == 1, "context canceled").otherwise("HTTP 500")
    return study.finished_jobs(jobs, jobs.where("id % 2 = 0").select("id", said.alias("error"))).drop("units_total")


_KEY = "sha256('v1' || chr(10) || sha256(source) || chr(10) || lang || chr(10) || sha256({prompt}) || chr(10) || doc_id)"


@query(f"""
WITH c AS (SELECT doc_id, {_KEY.format(prompt="'ask'")} AS fingerprint FROM documents), s AS (SELECT {_KEY.format(prompt="CASE WHEN doc_id % 6 = 0 THEN 'other' ELSE 'ask' END")} AS f FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id, fingerprint FROM c WHERE fingerprint NOT IN (SELECT f FROM s)""")
def chunks_to_run(t):
    """Chunks whose result isn't cached under their source, model and prompt."""
    d = t("documents")
    key = lambda prompt: sinks.checkpoint_key(F.lit("v1"), F.col("source"), F.col("lang"), prompt, F.col("doc_id").cast("string")).alias("fingerprint")
    cache = d.where("doc_id % 3 = 0").select(key(F.when(F.col("doc_id") % 6 == 0, "other").otherwise("ask")))
    return sinks.missing_chunks(d.select("doc_id", key(F.lit("ask"))), cache)


@query("""
WITH b AS (SELECT doc_id, text AS before FROM documents WHERE doc_id % 3 <> 0), a AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS after FROM documents WHERE doc_id % 4 <> 0)
SELECT doc_id AS path, CASE WHEN before IS NULL THEN 'created' WHEN after IS NULL THEN 'deleted' ELSE 'changed' END AS action, strlen(before)::BIGINT AS was, strlen(after)::BIGINT AS now
FROM (SELECT doc_id FROM documents) LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id) WHERE before IS DISTINCT FROM after""")
def audits(t):
    """What a run created, changed and deleted."""
    d = t("documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    after = d.where("path % 4 <> 0").withColumn("content", F.when(F.col("path") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    out = sinks.audit(d.select(F.lit("r").alias("run_id"), "path"), d.where("path % 3 <> 0"), after)
    return out.select("path", "action", F.octet_length("before").cast("long").alias("was"), F.octet_length("after").cast("long").alias("now"))


@query("""SELECT '{"documents":' || count(*) || ',"last":' || max(doc_id) || ',"sources":' || count(DISTINCT source) || '}' AS value FROM documents""")
def manifests(t):
    return sinks.run_manifest(t("documents"), {"documents": F.count("*"), "last": F.max("doc_id"), "sources": F.count_distinct("source")})


@query("""
WITH p AS (SELECT doc_id, list('page ' || l.quality ORDER BY l.toxic, l.quality) AS pages FROM labels l GROUP BY 1)
SELECT doc_id AS review_id, lower(source || chr(10) || lang || chr(10) || coalesce(array_to_string(pages, chr(10)), '') || chr(10) || 'Q' || doc_id || ' Why' || chr(10) || 'Report') AS search_text,
  coalesce(len(pages), 0)::INT AS page_count, 1 AS question_count FROM documents LEFT JOIN p USING (doc_id)""")
def review_records(t):
    """Archive rows of reviews: counts and everything they can be searched by."""
    pages = t("labels").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("toxic", "quality"))).alias("p"))
    pages = pages.select("doc_id", F.transform("p", lambda x: F.struct(F.concat(F.lit("page "), x["quality"]).alias("text"))).alias("pages"))
    d = t("documents").join(pages, "doc_id", "left").withColumn("pages", F.coalesce("pages", F.array().cast("array<struct<text: string>>")))
    asked = F.array(F.struct(F.concat(F.lit("Q"), "doc_id").alias("label"), F.lit("Why").alias("title")))
    rows = d.select(F.col("doc_id").alias("review_id"), F.col("source").alias("name"), F.col("lang").alias("metadata"), "pages", asked.alias("questions"), F.lit("Report").alias("report"))
    made = study.review_record(rows)
    same = filters.search_text(F.col("name"), F.col("metadata"), F.transform("pages", lambda p: p["text"]), F.transform("questions", lambda q: F.concat_ws(" ", q["label"], q["title"])), F.col("report"))
    return made.join(rows.select("review_id", same.alias("again")), "review_id").where("again = search_text").select("review_id", "search_text", "page_count", "question_count")


@query("""
WITH p AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'answer' WHEN 1 THEN ' Question_Paper ' WHEN 2 THEN 'cover' WHEN 3 THEN 'BLANK' WHEN 4 THEN 'weird' END AS kind, doc_id % 7 = 0 AS failed, n_chars % 4 AS questions FROM documents),
k AS (SELECT *, CASE WHEN lower(trim(kind)) IN ('answer', 'question_paper', 'cover', 'blank') THEN lower(trim(kind)) ELSE 'unknown' END AS known FROM p)
SELECT doc_id, known, NOT failed AND known IN ('answer', 'unknown') AS answers, NOT failed AND known IN ('answer', 'unknown', 'question_paper') AS splits, CASE WHEN questions > 1 THEN 'ready' ELSE 'pending' END AS state,
  CASE WHEN lower(trim(kind)) IN ('cover', 'weird') THEN lower(trim(kind)) ELSE 'other' END AS choice, questions > 0 AND doc_id % 2 = 0 AND doc_id % 3 = 0 AS skip, doc_id % 2 = 0 AND questions > 0 AND lower(trim(kind)) IS NOT NULL AS complete FROM k""")
def page_states(t):
    """Kinds of pages, which of them can hold answers, and what is ready, skipped or complete."""
    i, asked = F.col("doc_id"), F.col("n_chars") % 4
    kind = F.coalesce(*[F.when(i % 6 == k, v) for k, v in enumerate(["answer", " Question_Paper ", "cover", "BLANK", "weird"])])
    p = t("documents").select("doc_id", kind.alias("kind"), asked.alias("asked"), F.when(i % 7 == 0, "\n> OCR failed for this page: x").otherwise("fine").alias("text"))
    kept = lambda rows, name: rows.select("doc_id", F.lit(True).alias(name))
    both = p.join(kept(filters.answer_pages(p), "answers"), "doc_id", "left").join(kept(filters.answer_pages(p, with_paper=True), "splits"), "doc_id", "left")
    status = lambda n: F.when(F.col("doc_id") % n == 0, "ready").otherwise("draft")
    question = F.struct(F.when(F.col("kind").isNotNull(), F.lit(1)).alias("dimensions"))
    questions = F.when(F.col("asked") > 0, F.array(question)).otherwise(F.array().cast("array<struct<dimensions: int>>"))
    return both.select(
        "doc_id", filters.page_kind(F.col("kind")).alias("known"), F.coalesce("answers", F.lit(False)).alias("answers"), F.coalesce("splits", F.lit(False)).alias("splits"),
        filters.ready_status(F.col("asked") > 1).alias("state"), filters.enum(F.col("kind"), ["cover", "weird"], "other").alias("choice"),
        filters.skip_ready(F.col("asked"), status(2), status(3)).alias("skip"), filters.complete_review(F.upper(status(2)), F.array(F.lit(1)), questions, F.lit("r")).alias("complete"),
    )


@query("""
WITH c AS (SELECT doc_id AS copy_id, CASE WHEN doc_id % 5 = 0 THEN doc_id + 1 END AS preferred_id, source AS source_path, lang || n_chars % 7 AS pdf_name FROM documents),
r AS (SELECT doc_id AS review_id, source AS path, lang || n_chars % 7 AS name, n_chars AS seen FROM documents WHERE doc_id % 3 = 1 AND doc_id % 4 <> 0),
m AS (SELECT copy_id, review_id, 0 AS turn, seen FROM c JOIN r ON preferred_id = review_id UNION ALL SELECT copy_id, review_id, 1, seen FROM c JOIN r ON source_path = path UNION ALL SELECT copy_id, review_id, 2, seen FROM c JOIN r ON pdf_name = name)
SELECT copy_id, arg_max(review_id, (-least(turn, 1), seen, -review_id)) AS review_id FROM m GROUP BY 1""")
def reused_reviews(t):
    """The review that each copy reuses: its preferred one, else the latest of its path or name, of the mode and readable."""
    d = t("documents").withColumn("pdf_name", F.concat("lang", (F.col("n_chars") % 7).cast("string")))
    copies = d.select(F.col("doc_id").alias("copy_id"), F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") + 1).alias("preferred_id"), F.col("source").alias("source_path"), "pdf_name")
    mode = F.when(F.col("doc_id") % 3 == 1, "full").otherwise("ocr-only")
    reviews = d.select(F.col("doc_id").alias("review_id"), F.col("source").alias("source_path"), "pdf_name", mode.alias("mode"), (F.col("doc_id") % 4 != 0).alias("decodes"), F.col("n_chars").alias("updated_at"))
    return joins.reviews_to_reuse(copies, reviews, "full")


@query("""
WITH l AS (SELECT 'lane-' || s_suppkey AS id, s_suppkey AS lane FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT 'lane-x', NULL UNION ALL SELECT 'lane-x', NULL)
SELECT id, lane FROM l WHERE id <> 'lane-x'""")
def provider_lanes(t):
    """Providers of a lane with their numbers."""
    return filters.lanes(t("supplier").select(F.concat(F.when(F.col("s_suppkey") % 4 == 0, "other-").otherwise("lane-"), "s_suppkey").alias("id")), "lane-")


@query("""
WITH q AS (SELECT doc_id AS number, 'kind' || doc_id % 3 AS kind, 'Q' || (doc_id % 40) || '.' AS label, CASE WHEN doc_id % 2 = 0 THEN 'own' ELSE '' END AS title, 'id' || doc_id AS id FROM documents),
c AS (SELECT doc_id AS number, arg_max('new' || quality, toxic * 10 + quality) AS kind FROM labels GROUP BY 1), p AS (SELECT (item_id % 25)::VARCHAR AS ref, arg_min('asked ' || item_id, item_id) AS prompt FROM benchmark GROUP BY 1),
m1 AS (SELECT 'id' || item_id AS id, 'm' || item_id AS metadata FROM benchmark WHERE item_id % 2 = 0), m2 AS (SELECT 'q' || item_id % 30 AS ref, arg_min('l' || item_id, item_id) AS metadata FROM benchmark GROUP BY 1)
SELECT q.number, coalesce(c.kind, q.kind) AS kind, coalesce(p.prompt, q.title) AS title, coalesce(m1.metadata, m2.metadata, 'none') AS metadata
FROM q LEFT JOIN c ON c.number = q.number LEFT JOIN p ON p.ref = (q.number % 40)::VARCHAR LEFT JOIN m1 ON m1.id = q.id LEFT JOIN m2 ON m2.ref = 'q' || (q.number % 40)""")
def question_lookups(t):
    """Pages with their last classification, questions with the first printed prompt of their number and metadata by id or label."""
    i, at = F.col("doc_id"), F.col("item_id")
    q = t("documents").select(i.alias("number"), F.concat(F.lit("kind"), i % 3).alias("kind"), F.concat(F.lit("Q"), i % 40, F.lit(".")).alias("label"), F.when(i % 2 == 0, "own").otherwise("").alias("title"), F.concat(F.lit("id"), i).alias("id"), F.lit("none").alias("metadata"))
    kinds = t("labels").select(i.alias("number"), F.concat(F.lit("new"), "quality").alias("kind"), (F.col("toxic") * 10 + F.col("quality")).alias("pos"))
    b = t("benchmark")
    prompts = b.select(F.concat(F.lit("Question "), at % 25).alias("label"), F.concat(F.lit("asked "), at).alias("title"), at.alias("pos"))
    by_id = b.select(F.when(at % 2 == 0, F.concat(F.lit("id"), at)).otherwise("").alias("id"), F.lit("").alias("label"), F.concat(F.lit("m"), at).alias("metadata"), at.alias("pos"))
    by_label = b.select(F.lit("").alias("id"), F.concat(F.lit(" q"), at % 30, F.lit(":")).alias("label"), F.concat(F.lit("l"), at).alias("metadata"), at.alias("pos"))
    out = joins.metadata_by_id_or_label(joins.printed_prompts(joins.classify_pages(q, kinds), prompts), by_id.unionByName(by_label))
    return out.select("number", "kind", "title", "metadata")


@query("""
WITH n AS (SELECT vec_id AS path, md5(label::VARCHAR) AS hash, embedding FROM embeddings)
SELECT path, path % 3 = 0 AND path % 5 <> 0 AS reuse, CASE WHEN path % 3 = 0 AND path % 5 <> 0 THEN len(embedding) END::INT AS size FROM n""")
def cached_vectors(t):
    """Notes whose vector is cached under an equal hash and isn't empty."""
    e = t("embeddings").select(F.col("vec_id").alias("path"), F.md5(F.col("label").cast("string")).alias("hash"), "embedding")
    cache = e.where("path % 3 = 0").withColumn("embedding", F.when(F.col("path") % 5 == 0, F.array().cast("array<float>")).otherwise(F.col("embedding"))).unionByName(e.where("path % 3 = 1").withColumn("hash", F.lit("old")))
    return joins.with_cache(e.drop("embedding"), cache).select("path", "reuse", F.size("embedding").alias("size")).withColumn("size", F.when(F.col("reuse"), F.col("size")))


@query("""
WITH q AS (SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN [] ELSE [doc_id % 50, doc_id % 50 + 1] END AS pages FROM documents), hit AS (SELECT id FROM q WHERE len(list_filter(pages, x -> x % 7 = 3)) > 0)
SELECT 'touching' AS part, id FROM q WHERE id IN (FROM hit) OR len(pages) = 0 UNION ALL SELECT 'replaced', id FROM q WHERE id NOT IN (FROM hit) UNION ALL SELECT 'replaced', -1
UNION ALL SELECT 'selected', doc_id FROM documents WHERE doc_id IN (3, 10, 17)""".replace("x -> x", "lambda x: x"))
def questions_on_pages(t):
    """Questions that touch selected pages, what is left when those are replaced, and the selected pages."""
    i = F.col("doc_id")
    pages = F.when(i % 9 == 0, F.array().cast("array<bigint>")).otherwise(F.array(i % 50, i % 50 + 1))
    q = t("documents").select(i.alias("id"), pages.alias("source_pages"))
    numbers = t("documents").select(i.alias("number")).where("number % 7 = 3")
    fresh = q.limit(1).select(F.lit(-1).cast("long").alias("id"))
    row = lambda rows, part, c="id": rows.select(F.lit(part).alias("part"), F.col(c).alias("id"))
    out = row(joins.touching(q, numbers), "touching").unionByName(row(joins.replace_on_pages(q, numbers, fresh), "replaced"))
    return out.unionByName(row(joins.selected_pages(t("documents").select(i.alias("number")), [3, 10, 17]), "selected", "number"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'pending' ELSE 'merge' END AS status, CASE WHEN doc_id % 4 = 0 THEN 'destination was not a candidate' ELSE 'fits' END AS reason, doc_id % 6 = 0 OR doc_id % 10 = 3 AS changed FROM documents""")
def note_decisions(t):
    """Decisions on notes that were candidates, and notes that changed or went since they were read."""
    d = t("documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    decided = joins.constrain_candidates(d.select("path", F.lit("merge").alias("status"), F.lit("fits").alias("reason")), d.where("path % 4 <> 0"))
    now = d.where("path % 10 <> 3").withColumn("content", F.when(F.col("path") % 6 == 0, F.concat("content", F.lit(" "))).otherwise(F.col("content")))
    changed = joins.changed_since_read(d, now).withColumn("changed", F.lit(True))
    return decided.join(changed, "path", "left").select(F.col("path").alias("doc_id"), "status", "reason", F.coalesce("changed", F.lit(False)).alias("changed"))


@query("""
SELECT conv_id AS run_id, count(*) FILTER (turn % 3 = 0) AS matches, count(*) AS checks, bool_and(turn % 2 = 0) AS same FROM conversations WHERE role = 'user' GROUP BY 1""")
def benchmark_labels(t):
    """Labels that an observed question on the same pages shares, and whether the pages are grouped alike."""
    c = t("conversations").where("role = 'user'")
    row = lambda label: c.select(F.col("conv_id").alias("run_id"), F.array("turn").alias("source_pages"), label.alias("label"))
    scores = joins.label_scores(row(F.lit("a")), row(F.when(F.col("turn") % 3 == 0, "a").otherwise("b")), "label")
    group = lambda pages: F.transform(F.array_sort(F.collect_list("turn")), lambda x: F.struct(F.array(pages(x)).alias("source_pages")))
    same = c.groupBy(F.col("conv_id").alias("run_id")).agg(joins.same_groups(group(lambda x: x), group(lambda x: x - x % 2)).alias("same"))
    return scores.join(same, "run_id")


@query("""
WITH a AS (SELECT source, arg_min(doc_id, doc_id) AS doc_id, 0 AS list FROM documents WHERE doc_id % 2 = 0 GROUP BY 1), b AS (SELECT source, min(doc_id) AS doc_id, 1 AS list FROM documents WHERE doc_id % 2 = 1 GROUP BY 1)
SELECT source, arg_min(doc_id, list) AS pos FROM (FROM a UNION ALL FROM b) GROUP BY 1""")
def merged_listings(t):
    """Two lists of sources in one, each source once, the first list's entry first."""
    d = t("documents").select("source", F.col("doc_id").alias("pos"))
    return joins.merged_lists(d.where("pos % 2 = 0"), d.where("pos % 2 = 1")).select("source", "pos")


@query("""
WITH f AS (SELECT url AS source, page_id FROM pages) SELECT page_id FROM f WHERE regexp_extract(source, '([^/]+)/*$', 1) IN (SELECT regexp_extract(url, '([^/]+)/*$', 1) FROM pages WHERE page_id % 3 = 0)""")
def transcribed_files(t):
    """Files that a log says are transcribed."""
    p = t("pages")
    log = p.where("page_id % 3 = 0").select(F.concat(F.lit("12:00 Transcribed: /x/"), T.base_name(F.col("url")), F.lit("  ")).alias("line")).unionByName(p.limit(1).select(F.lit("nothing").alias("line")))
    files = p.select(F.col("url").alias("source"), "page_id")
    return files.join(models.transcribed(log, files).distinct(), "source", "left_semi").select("page_id")


@query("""
WITH g AS (SELECT l_orderkey AS plan_id, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'R') AS u, count(*) AS n, sum(greatest(0, l_linenumber - 3)) AS unclear, count(*) FILTER (l_tax > 0.04) AS backed FROM lineitem GROUP BY 1)
SELECT plan_id, unclear::BIGINT AS unclear, backed * 100 >= n * 75 AS backed, (n < 2) OR (backed * 100 >= n * 70) AS covered, a <> 1 OR u <> 1 OR n <> 4 AS issue,
  CASE WHEN u = 0 AND a = 0 THEN 'completed' WHEN n - a - u > 0 THEN 'partial' WHEN a > 0 THEN 'pending' ELSE 'failed' END AS status FROM g""")
def plan_figures(t):
    """Unclear pages, backed points, coverage, declared counts and status of plans, which orders stand for."""
    li = t("lineitem").withColumn("plan_id", F.col("l_orderkey"))
    unclear = aggregates.unclear_total(li.withColumn("unclear_count", F.col("l_linenumber") - 3), ["plan_id"])
    groups = li.select("plan_id", F.when(F.col("l_returnflag") == "A", "answered").when(F.col("l_returnflag") == "R", "unanswered").otherwise("x").alias("status"))
    declared = li.select("plan_id").distinct().select("plan_id", F.lit(1).alias("answered"), F.lit(1).alias("unanswered"), F.lit(4).alias("visible_question_slots"))
    issues = aggregates.inventory_issues(groups, declared).select("plan_id", F.lit(True).alias("issue"))
    point = F.struct(F.when(F.col("l_tax") > 0.04, "e").otherwise(" ").alias("evidence"))
    n = li.groupBy("plan_id").agg(
        F.collect_list(point).alias("points"), F.count_if(F.col("l_tax") > 0.04).alias("e"), F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") == "R").alias("u")
    )
    n = n.select("plan_id", aggregates.evidence_backed(F.col("points")).alias("backed"), aggregates.coverage_ok(F.col("e"), F.col("n")).alias("covered"), aggregates.run_status(F.col("n") - F.col("a") - F.col("u"), F.col("a"), F.col("u")).alias("status"))
    return n.join(unclear, "plan_id").join(issues, "plan_id", "left").withColumn("issue", F.coalesce("issue", F.lit(False)))


@query("""
WITH u AS (SELECT event_type, CASE WHEN event_id % 5 > 0 THEN floor(value)::BIGINT END AS i FROM events)
SELECT event_type, coalesce(sum(i), 0)::BIGINT AS input_tokens, coalesce(sum(i // 2), 0)::BIGINT AS cached_input_tokens, coalesce(sum(i + 1), 0)::BIGINT AS output_tokens, 0::BIGINT AS reasoning_output_tokens, coalesce(sum(2 * i + 1), 0)::BIGINT AS total_tokens,
  round((coalesce(sum(i), 0) * 3.0 + coalesce(sum(i + 1), 0) * 15.0) / 1e6, 6) AS cost, greatest(max(coalesce(i, 0)), 7)::BIGINT AS memory FROM u GROUP BY 1""")
def usage_totals(t):
    """Tokens, their price and the largest device of each kind of call; every fifth has no usage."""
    i = F.when(F.col("event_id") % 5 > 0, F.floor("value").cast("long"))
    usage = F.when(i.isNotNull(), F.struct(i.alias("input_tokens"), F.floor(i / 2).cast("long").alias("cached_input_tokens"), (i + 1).alias("output_tokens"), F.lit(0).cast("long").alias("reasoning_output_tokens"), (2 * i + 1).alias("total_tokens")))
    e = t("events").select("event_type", usage.alias("usage"), F.coalesce(i, F.lit(0)).alias("mb"))
    memory = e.groupBy("event_type").agg(F.max("mb").alias("mb")).select("event_type", aggregates.most_memory(F.array(F.struct(F.col("mb").alias("memory_mb")), F.struct(F.lit(7).cast("long").alias("memory_mb")))).alias("memory"))
    out = aggregates.token_usage(e, ["event_type"]).withColumn("cost", F.round(N.token_cost(F.col("input_tokens"), F.col("output_tokens"), 3.0, 15.0), 6))
    return out.join(memory, "event_type")


@query("""
WITH q AS (SELECT conv_id, turn, 'Q' || turn AS label, CASE WHEN turn % 2 = 0 THEN role ELSE ' ' END AS title, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS answer FROM conversations)
SELECT conv_id, sha256(string_agg('## ' || label || CASE WHEN trim(title) = '' THEN '' ELSE '. ' || title END || chr(10) || chr(10) || answer, chr(10) || chr(10) ORDER BY turn)) AS report,
  sha256(string_agg('## ' || label || chr(10) || chr(10) || answer, chr(10) || chr(10) ORDER BY turn) FILTER (answer <> '')) AS transcript FROM q GROUP BY 1""")
def reports(t):
    """Conversations as reports of questions and as course transcripts."""
    c = t("conversations").select("conv_id", F.col("turn").alias("pos"), F.concat(F.lit("Q"), "turn").alias("label"), F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(" ").alias("title"), F.col("text").alias("answer_markdown"))
    made = aggregates.report(c, "conv_id").select("conv_id", F.sha2("report", 256).alias("report"))
    whole = study.course_transcript(c.select(F.col("conv_id").alias("course"), "pos", F.col("label").alias("name"), F.col("answer_markdown").alias("text")))
    return made.join(whole.select(F.col("course").alias("conv_id"), F.sha2("text", 256).alias("transcript")), "conv_id", "left")


@query("""
WITH f AS (SELECT 'first' AS sample, doc_id, NULL::BIGINT AS share FROM documents ORDER BY doc_id LIMIT 25) FROM f UNION ALL SELECT 'all', doc_id, greatest(2500, 60000 // greatest(n_chars % 40, 1)) FROM documents""")
def inbox_samples(t):
    """The first notes of an inbox, all of them, and the characters that each of n candidates gets."""
    d = t("documents").select("doc_id", packing.char_limit(F.lit(60_000), F.col("n_chars") % 40).alias("share"))
    first = packing.sample_rows(d, 25, "doc_id").select(F.lit("first").alias("sample"), "doc_id", F.lit(None).cast("long").alias("share"))
    return first.unionByName(packing.sample_rows(d, 0, "doc_id").select(F.lit("all").alias("sample"), "doc_id", "share"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
n AS (SELECT doc_id, pos, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS norm FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, norm ORDER BY pos) AS nth FROM n WHERE line <> '')
SELECT doc_id, sha256(string_agg(line, chr(10) ORDER BY pos)) AS text_hash FROM k WHERE nth = 1 GROUP BY 1""")
def tile_lines(t):
    """Texts of overlapping tiles with every line once."""
    return dedup.unique_lines(t("documents").select("doc_id", "text"), least=0).where("text <> ''").select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query("SELECT unnest(['absent-model', 'src3']) AS model")
def missing_models(t):
    """Models that are asked for and not loaded, without regard to case."""
    return dedup.required_models(["SRC1", "absent-model", " ", "src3"], t("documents").where("source <> 'src3'").select(F.concat(F.lit(" "), F.initcap("source")).alias("model")))
