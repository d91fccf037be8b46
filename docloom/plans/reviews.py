"""Page decisions, notes, ledgers, sync and settings over the driver's tables as stand-ins."""

from pyspark.sql import functions as F

from docloom.functions import dates
from docloom.functions import numbers as N
from docloom.functions import text as T
from docloom.operators import aggregates, dedup, joins, models, notes, packing, review, study, windows
from docloom.plans.registry import query
from docloom.sources import files, sinks


@query("""
WITH d AS (SELECT doc_id, source AS copy_id, text, regexp_extract(text, '([A-Za-z]+)', 1) AS w FROM documents),
c AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN w WHEN 1 THEN 'zzzz' ELSE '' END AS label, CASE doc_id % 4 WHEN 0 THEN w WHEN 1 THEN 'zzzz' ELSE '' END AS evidence,
  CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'continuation' END AS b, CASE WHEN doc_id % 10 = 0 THEN 0.5 ELSE 0.9 END AS conf FROM d),
g AS (SELECT *, (label <> '' OR evidence <> '') AS claims, NOT (label <> '' OR evidence <> '') OR (label <> '' AND evidence <> '' AND contains(text, evidence) AND contains(evidence, label)) AS grounded FROM c),
k AS (SELECT *, CASE WHEN grounded THEN label ELSE '' END AS kept, CASE WHEN NOT grounded OR (b = 'continuation' AND claims) OR conf < 0.7 THEN 'uncertain' ELSE b END AS bound FROM g)
SELECT doc_id, bound AS boundary, CASE WHEN bound = 'uncertain' OR (bound = 'new' AND kept = '') THEN 'needs review' ELSE 'detected' END AS status,
  CASE WHEN kept <> '' THEN kept WHEN bound = 'continuation' THEN 'Page ' || doc_id || ' continuation' ELSE 'Page ' || doc_id || ' block' END AS label FROM k""")
def grounded_decisions(t):
    """Decisions on documents as pages: a label counts only if the text holds it."""
    d = t("documents")
    word, i = F.regexp_extract("text", "([A-Za-z]+)", 1), F.col("doc_id")
    claim = F.when(i % 4 == 0, word).when(i % 4 == 1, "zzzz").otherwise("")
    decisions = d.select(
        i.alias("page_number"), claim.alias("visible_label"), claim.alias("label_evidence"), F.when(i % 2 == 0, "new").otherwise("continuation").alias("boundary"), F.when(i % 10 == 0, 0.5).otherwise(0.9).alias("boundary_confidence")
    )
    out = review.grounded_decisions(decisions, d.select(i.alias("page_number"), "text"), ["page_number"])
    return out.select(F.col("page_number").alias("doc_id"), "boundary", "status", "label")


@query("""
WITH k AS (SELECT o_custkey AS run_id, 'c' || (o_orderkey % 7) AS claim_id, CASE o_orderstatus WHEN 'F' THEN 'merged' WHEN 'O' THEN 'deduped' ELSE 'pending' END AS status, 'p' || (o_orderkey % 3) AS path, o_orderkey AS pos FROM orders),
f AS (SELECT run_id, claim_id, status, path, min(pos) AS pos FROM k GROUP BY ALL), done AS (SELECT DISTINCT run_id, claim_id FROM f WHERE status <> 'pending'),
u AS (SELECT f.* FROM f LEFT JOIN done d ON d.run_id = f.run_id AND d.claim_id = f.claim_id WHERE f.status <> 'pending' OR d.run_id IS NULL),
a AS (SELECT run_id, claim_id, arg_min(status, pos) AS s FROM u WHERE status <> 'pending' GROUP BY 1, 2)
SELECT u.run_id, count(*) FILTER (status = 'pending') AS pending, (SELECT count(*) FILTER (s = 'merged') FROM a WHERE a.run_id = u.run_id) AS merged, (SELECT count(*) FILTER (s = 'deduped') FROM a WHERE a.run_id = u.run_id) AS deduped FROM u GROUP BY u.run_id""")
def claim_ledger(t):
    """Orders as claims of runs: deduplicated, accounted for and counted."""
    k = t("orders")
    status = F.when(F.col("o_orderstatus") == "F", "merged").when(F.col("o_orderstatus") == "O", "deduped").otherwise("odd")
    claims = k.select(F.col("o_custkey").alias("run_id"), F.format_string("c%d", F.col("o_orderkey") % 7).alias("claim_id"), status.alias("status"), F.format_string("p%d", F.col("o_orderkey") % 3).alias("path"), F.lit("").alias("reason"), F.col("o_orderkey").alias("pos"))
    return aggregates.ledger_status(dedup.dedupe_ledger(dedup.normalize_ledger(claims, "x"))).select("run_id", "pending", "merged", "deduped")


@query("""
SELECT a.doc_id, min(b.doc_id) AS twin FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id <> b.doc_id GROUP BY 1""")
def exact_twins(t):
    """Documents that have a byte-identical one."""
    d = t("documents").select("doc_id", F.format_string("%012d.md", "doc_id").alias("path"), F.col("text").alias("content"))
    out = joins.exact_twins(d, d)
    number = lambda c: F.regexp_extract(c, r"(\d+)", 1).cast("long")
    return out.select(number("path").alias("doc_id"), number("twin").alias("twin"))


@query(r"""
SELECT doc_id, 'n' || doc_id || '.md' AS path, sha256(regexp_replace(regexp_replace(text, '^\n+', ''), '\n+$', '') || chr(10)) AS note_hash FROM documents WHERE doc_id % 3 <> 0 AND regexp_matches(text, '\S')""")
def note_blocks(t):
    """Every document as a note of a reply; each third one's block never ends and gives nothing."""
    d = t("documents")
    end = F.when(F.col("doc_id") % 3 != 0, "\nEND_NOTE\ntail").otherwise("")
    replies = d.select(F.col("doc_id").alias("reply_id"), F.concat(F.lit("talk\nBEGIN_NOTE n"), F.col("doc_id").cast("string"), F.lit(".md\n"), "text", end).alias("text"))
    return notes.note_blocks(replies).select(F.col("reply_id").alias("doc_id"), "path", F.sha2("note", 256).alias("note_hash"))


@query("""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'malformed' WHEN event_id % 5 = 1 THEN 'unknown field' WHEN event_id % 5 = 2 THEN 'missing field' END AS issue FROM events""")
def strict_json(t):
    """Event properties under a strict schema, some of them spoilt."""
    i = F.col("event_id") % 5
    v = F.when(i == 0, F.concat("props", F.lit("}"))).when(i == 1, F.lit('{"k": 1, "z": 2}')).when(i == 2, F.lit('{"j": 1}')).otherwise(F.col("props"))
    return t("events").select("event_id", files.strict_issue(v, "k long, j long", ["k"], ["k", "j"]).alias("issue"))


@query("SELECT event_id, epoch_us(date_trunc('second', ts)) - 19800000000 AS at_us, epoch_us(date_trunc('minute', ts)) - 19800000000 AS minute_us, 'x?at=' || event_id || '%3A' || user_id AS link FROM events")
def schedules(t):
    """Local times in two layouts as instants, and links with encoded values."""
    ts = F.col("ts")
    a, b = dates.scheduled_at(F.date_format(ts, "yyyy-MM-dd HH:mm:ss")), dates.scheduled_at(F.date_format(ts, "yyyy-MM-dd'T'HH:mm"))
    link = dates.query_link("x", at=F.concat_ws(":", "event_id", "user_id"))
    return t("events").select("event_id", N.micros(a).alias("at_us"), N.micros(b).alias("minute_us"), link.alias("link"))


@query("""
SELECT user_id, (epoch_us(ts) // 1000) % 86400000 AS start_ms, (epoch_us(ts) // 1000) % 86400000 + 1500 AS end_ms, event_type AS text FROM events""")
def subtitles_read(t):
    """Each user's events written as a subtitle file and read back."""
    at = (N.micros(F.col("ts")) / 1000).cast("long") % 86_400_000
    blocks = t("events").select(F.col("user_id").alias("file"), at.alias("start_ms"), (at + 1500).alias("end_ms"), F.col("event_type").alias("text"))
    back = files.subtitles(files.subtitle_text(blocks))
    return back.select(F.col("file").alias("user_id"), "start_ms", "end_ms", "text")


@query("""
WITH r AS (SELECT source AS copy_id, doc_id AS pos, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END AS subject, lang FROM documents)
SELECT copy_id, coalesce(arg_min(subject, pos) FILTER (subject <> ''), '') AS subject, (SELECT count(DISTINCT lang) FROM r x WHERE x.copy_id = r.copy_id) AS topics, arg_min(lang, pos) AS first_topic FROM r GROUP BY copy_id""")
def merge_metadata(t):
    """The first non-blank field and the union of lists of each source."""
    r = t("documents").select(F.col("source").alias("copy_id"), F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("subject"), F.array("lang").alias("topics"))
    out = aggregates.merge_metadata(r, "copy_id", ["subject"], ["topics"])
    return out.select("copy_id", "subject", F.size("topics").cast("long").alias("topics"), F.col("topics")[0].alias("first_topic"))


@query("""
WITH c AS (SELECT c_custkey AS copy_id, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 3 END AS cp, CASE WHEN c_custkey % 6 = 0 THEN 'imported' ELSE 'ready' END AS cs FROM customer)
SELECT copy_id, cp = 0 OR cs = 'imported' OR copy_id % 9 = 0 AS sync, CASE WHEN copy_id % 2 = 0 THEN 'Customer' ELSE c_name END AS name FROM c JOIN customer ON c_custkey = copy_id""")
def sync_decisions(t):
    """Which copies take over their review, and under what name."""
    k = F.col("c_custkey")
    base = F.lit("2024-01-01").cast("timestamp")
    newer = F.when(k % 9 == 0, F.lit("2024-01-02").cast("timestamp")).otherwise(base)
    sync = study.should_sync(F.when(k % 4 == 0, 0).otherwise(3), F.lit(2), F.when(k % 6 == 0, "Imported").otherwise("ready"), base, F.lit(3), F.lit(2), F.lit("ready"), newer)
    name = study.sync_name(F.when(k % 2 == 0, F.lit("A.pdf")).otherwise(F.col("c_name")), F.lit("/x/a.pdf"), F.lit("Customer"))
    return t("customer").select(k.alias("copy_id"), sync.alias("sync"), name.alias("name"))


@query("""
WITH g AS (SELECT o_orderkey // 4 AS copy_id, o_orderkey % 4 AS pos, o_orderkey, o_totalprice, o_custkey FROM orders), b AS (SELECT copy_id, arg_max(o_orderkey, (o_totalprice, -pos)) AS best, count(*) AS n, list_sort(list_distinct(list(1 + o_custkey % 9))) AS pages FROM g GROUP BY 1)
SELECT copy_id, 'order ' || best AS label, pages AS source_pages, CASE WHEN copy_id % 5 = 0 THEN 'unanswered' WHEN copy_id % 5 = 1 THEN 'needs review' ELSE 'answered' END AS status FROM b""")
def reconcile_groups(t):
    """Groups of four orders as candidates of one question: the dearest is canonical."""
    o = t("orders")
    k = F.col("o_orderkey")
    rows = o.select(
        F.floor(k / 4).alias("copy_id"), F.concat(F.lit("c"), (k % 4).cast("string")).alias("candidate_id"), F.lit(0).alias("chunk"), (k % 4).alias("pos"), F.concat(F.lit("order "), k.cast("string")).alias("label"),
        F.lit("").alias("title"), F.lit("").alias("answer_markdown"), F.array(1 + F.col("o_custkey") % 9).alias("source_pages"), F.lit("detected").alias("status"), F.col("o_totalprice").alias("confidence"),
    )
    i = F.col("copy_id") % 5
    plan = rows.groupBy("copy_id").agg(F.collect_set("candidate_id").alias("candidate_ids")).select(
        "copy_id", F.lit(1).alias("group_pos"), F.lit("q").alias("id"), F.when(i == 0, "unanswered").otherwise("answered").alias("status"), "candidate_ids", F.lit("").alias("canonical_candidate_id"),
        F.lit("").alias("label"), F.lit("").alias("title"), F.array().cast("array<long>").alias("source_pages"), F.lit("").alias("merged_answer_markdown"), F.when(i == 1, 0.5).otherwise(0.9).alias("confidence"),
    )
    return review.reconcile(rows, plan).select("copy_id", "label", "source_pages", "status")


@query("""
WITH s AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE s_name || '!' END AS name, s_acctbal FROM supplier) SELECT s.id, CASE WHEN s.name = '' THEN x.s_name ELSE s.name END AS name, s.s_acctbal FROM s JOIN supplier x ON x.s_suppkey = s.id""")
def secrets_restored(t):
    """Blank secrets come back from the stored rows."""
    stored = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_acctbal")
    changed = stored.withColumn("name", F.when(F.col("id") % 2 == 0, "").otherwise(F.concat("name", F.lit("!"))))
    return study.restored(changed, stored, ["name"])


@query("""
WITH i AS (SELECT 'f' || (p_partkey % 5) AS folder, p_partkey AS pos, p_name || '.txt' AS name FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY pos) AS n FROM i)
SELECT folder, pos, CASE WHEN n = 1 THEN name ELSE regexp_replace(name, '\\.txt$', '') || '-' || n || '.txt' END AS saved_as FROM n""".replace("\\\\", "\\"))
def upload_names(t):
    p = t("part").select(F.format_string("f%d", F.col("p_partkey") % 5).alias("folder"), F.col("p_partkey").alias("pos"), F.concat("p_name", F.lit(".txt")).alias("name"))
    return models.upload_names(p).select("folder", "pos", "saved_as")


@query("""
WITH n AS (SELECT max(o_orderdate) AS now FROM orders) SELECT o_orderpriority AS kind, count(*) AS rows FROM orders, n WHERE o_orderdate >= now - INTERVAL 48 HOUR GROUP BY 1""")
def retention(t):
    """Orders of the last 48 hours of the table."""
    o = t("orders").withColumnRenamed("o_orderdate", "occurred_at")
    now = o.agg(F.max("occurred_at").alias("now"))
    return sinks.retained(o.crossJoin(F.broadcast(now)), F.col("now")).groupBy(F.col("o_orderpriority").alias("kind")).agg(F.count("*").alias("rows"))  # one row


@query("""
SELECT doc_id, CASE WHEN x NOT BETWEEN 1 AND 3 OR y NOT BETWEEN 1 AND 3 THEN 'page out of window' WHEN x = y THEN 'duplicate page' ELSE 'missing page' END AS issue FROM (SELECT doc_id, 1 + doc_id % 4 AS x, 1 + n_chars % 3 AS y FROM documents)""")
def chunk_issues(t):
    """Chunks of three pages that report two: what is wrong with each."""
    c = t("documents").select(F.col("doc_id").alias("copy_id"), F.lit(0).alias("chunk"), F.lit(1).alias("first"), F.lit(3).alias("last"), F.array(1 + F.col("doc_id") % 4, 1 + F.col("n_chars") % 3).alias("pages"))
    return review.chunk_page_issues(c).select(F.col("copy_id").alias("doc_id"), "issue")


@query("""
WITH RECURSIVE e AS (SELECT user_id AS course, event_id AS pos, coalesce(value, 0)::DOUBLE AS v, CASE WHEN event_id % 37 = 0 THEN event_id // 37 END AS done, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r AS (SELECT DISTINCT course, 0::BIGINT AS pos, 0::BIGINT AS n, NULL::BIGINT AS done, false AS open, 0.0::DOUBLE AS used, 0::BIGINT AS fresh FROM e
  UNION ALL SELECT e.course, e.pos, e.n, e.done, e.done IS NULL, CASE WHEN e.done IS NOT NULL THEN 0 WHEN NOT r.open OR r.used + e.v > 120 THEN e.v ELSE r.used + e.v END, r.fresh + (e.done IS NULL AND (NOT r.open OR r.used + e.v > 120))::BIGINT
  FROM r JOIN e ON e.course = r.course AND e.n = r.n + 1),
free AS (SELECT c.course, i AS part, row_number() OVER (PARTITION BY c.course ORDER BY i) AS fresh FROM (SELECT course, max(fresh) + count(done) AS most FROM r GROUP BY 1) c, LATERAL (SELECT unnest(generate_series(1, most)) AS i) WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.course = c.course AND e.done = i))
SELECT r.course, r.pos, coalesce(r.done, free.part)::BIGINT AS part FROM r LEFT JOIN free ON free.course = r.course AND free.fresh = r.fresh WHERE r.n > 0""")
def resumed_parts(t):
    """Each user's events as course items of which some have a part already."""
    e = t("events").select(F.col("user_id").alias("course"), F.col("event_id").alias("pos"), F.col("value").alias("duration_s"), F.when(F.col("event_id") % 37 == 0, F.floor(F.col("event_id") / 37).cast("int")).alias("done_part"))
    return packing.resume_parts(e, 120.0)


@query("""
SELECT user_id, (sum(greatest(1, ceil(value))) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT AS before, event_id FROM events""")
def running_units(t):
    e = t("events").select("user_id", F.col("event_id").alias("pos"), F.col("value").alias("duration_s"))
    out = windows.running_units(e, "user_id")
    return out.select("user_id", F.when(F.col("units_before") > 0, F.col("units_before")).alias("before"), F.col("pos").alias("event_id"))
