"""Curation of conversations."""

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import curation as C
from docloom.operators import filters, notes, windows
from docloom.plans.registry import query

_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '^\s+', ''), '\s+$', '')"
_EXAMPLES = rf"""
WITH turns AS (SELECT conv_id, turn, lower(role) AS role, {_CLEAN} AS content FROM conversations WHERE text IS NOT NULL),
kept AS (SELECT * FROM turns WHERE role <> '' AND content <> ''),
ex AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || content, chr(10) ORDER BY turn) AS body,
       arg_max(role, turn) AS last_role, coalesce(arg_min(content, turn) FILTER (role = 'system'), '') AS sys,
       coalesce(arg_min(content, turn) FILTER (role = 'user'), '') AS usr,
       coalesce(arg_max(content, turn) FILTER (role = 'assistant'), '') AS asst FROM kept GROUP BY conv_id),
judged AS (SELECT *, sha256(body) AS hash, CASE WHEN n < 2 THEN 'empty-messages' WHEN last_role <> 'assistant' THEN 'empty-response' ELSE '' END AS reason FROM ex)
"""


@query(
    _EXAMPLES
    + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY conv_id) AS nth FROM judged WHERE reason = ''),
final AS (SELECT conv_id, hash, CASE WHEN nth > 1 THEN 'duplicate' ELSE '' END AS reason FROM numbered),
ranked AS (SELECT *, row_number() OVER (ORDER BY hash) AS r, count(*) OVER () AS total FROM final WHERE reason = '')
SELECT conv_id, hash, reason, CASE WHEN r <= total // 20 THEN 'eval' ELSE 'train' END AS split FROM ranked
UNION ALL SELECT conv_id, hash, reason, '' FROM final WHERE reason <> ''
UNION ALL SELECT conv_id, hash, reason, '' FROM judged WHERE reason <> ''"""
)
def training_export_split(t):
    """Chat examples with why they are left out, or their split."""
    out = C.export(C.examples_from_turns(t("conversations")), hashed=C.plain_hash, pos="conv_id")
    return out.select("conv_id", "hash", "reason", "split")


@query(
    _EXAMPLES
    + """, fine AS (SELECT *, strlen(usr) AS u, strlen(asst) AS a FROM judged WHERE reason = ''),
modes AS (SELECT sha256(sys) AS h, count(*) AS c FROM fine GROUP BY 1)
SELECT count(*) AS examples, (SELECT count(*) FROM modes) AS system_prompt_variants, (SELECT max(c) FROM modes) AS primary_system_prompt_count,
  count(*) FILTER (usr LIKE '%SEMANTIC DESTINATION CANDIDATES:%') AS with_semantic_candidates,
  count(*) FILTER (usr NOT LIKE '%SEMANTIC DESTINATION CANDIDATES:%') AS without_semantic_candidates,
  count(*) FILTER (asst LIKE '%```%') AS with_code_fences, count(*) FILTER (a < 500) AS short_assistant, count(*) FILTER (a > 20000) AS long_assistant,
  min(u)::BIGINT AS min_user_chars, max(u)::BIGINT AS max_user_chars, min(a)::BIGINT AS min_assistant_chars, max(a)::BIGINT AS max_assistant_chars,
  (sum(u) // count(*))::BIGINT AS average_user_chars, (sum(a) // count(*))::BIGINT AS average_assistant_chars FROM fine"""
)
def training_quality_report(t):
    """Counts, extremes and integer averages over all chat examples."""
    out = C.quality_report(C.with_quality(C.examples_from_turns(t("conversations")).where("reason = ''")))
    names = "examples system_prompt_variants primary_system_prompt_count with_semantic_candidates without_semantic_candidates with_code_fences short_assistant long_assistant"
    sizes = [f"{f}_{c}" for c in ("user_chars", "assistant_chars") for f in ("min", "max", "average")]
    return out.select(*names.split(), *sizes)


@query(_EXAMPLES + "SELECT reason, count(*) AS rows FROM judged WHERE reason <> '' GROUP BY reason")
def skip_reasons(t):
    from docloom.operators.aggregates import reason_histogram

    return reason_histogram(C.examples_from_turns(t("conversations")))


@query(
    _EXAMPLES
    + """, c AS (SELECT role, sha256(content) AS h, count(*) AS n FROM kept GROUP BY 1, 2)
SELECT role, arg_min(h, (-n, h)) AS value, arg_min(n, (-n, h)) AS n FROM c GROUP BY role"""
)
def common_turn(t):
    """The most common turn of each role."""
    from docloom.operators.aggregates import mode

    rows = t("conversations").where("text is not null").select(F.lower("role").alias("role"), T.newlines(F.col("text")).alias("content")).where("content <> '' and role <> ''")
    return mode(rows.select("role", T.hash_text(F.col("content")).alias("h")), "h", ["role"])


@query(
    """
WITH b AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, role,
  CASE role WHEN 'user' THEN 1.0 WHEN 'system' THEN 0.6 ELSE 0.8 END AS conf FROM conversations),
i AS (SELECT *, sum(CASE WHEN role <> 'assistant' OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM b)
SELECT conv_id, island::BIGINT AS island, count(*) AS blocks, min(conf) AS confidence, list(turn ORDER BY turn) AS source_pages,
  CASE WHEN bool_or(conf < 0.7 OR (role = 'assistant' AND rn = 1) OR role = 'system') THEN 'needs review' ELSE 'detected' END AS status,
  sha256(regexp_replace(regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY turn), '^\\s+', ''), '\\s+$', '')) AS text_hash
FROM i GROUP BY 1, 2""".replace("\\\\", "\\")
)
def islands_merge(t):
    """Each answer joins the question before; a system turn counts as an uncertain block."""
    c = t("conversations")
    role = F.col("role")
    blocks = c.select(
        F.col("conv_id").alias("doc_id"),
        F.col("turn").alias("pos"),
        F.concat(F.lit("t"), "turn").alias("label"),
        F.lit("").alias("title"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.array("turn").alias("source_pages"),
        F.lit("detected").alias("status"),
        F.when(role == "assistant", "continuation").when(role == "user", "new").otherwise("uncertain").alias("boundary"),
        F.when(role == "user", 1.0).when(role == "system", 0.6).otherwise(0.8).alias("confidence"),
    )
    out = windows.merge_islands(blocks)
    return out.select(F.col("doc_id").alias("conv_id"), "island", F.size("source_pages").cast("long").alias("blocks"), "confidence", "source_pages", "status", F.sha2("text", 256).alias("text_hash"))


@query(
    """
WITH n AS (SELECT conv_id, max(turn) + 2 AS top FROM conversations GROUP BY 1), g AS (SELECT conv_id, unnest(generate_series(0, top)) AS turn FROM n)
SELECT g.conv_id, g.turn, coalesce(c.role, 'unknown') AS role, c.conv_id IS NULL AS made FROM g LEFT JOIN conversations c ON c.conv_id = g.conv_id AND c.turn = g.turn"""
)
def densify_turns(t):
    """Every turn number up to two past a conversation's last, missing ones made up."""
    c = t("conversations")
    every = c.groupBy("conv_id").agg((F.max("turn") + 2).alias("top")).select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("turn"))
    have = c.select("conv_id", "turn", "role", F.lit(True).alias("there"))
    return every.join(have, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.col("there").isNull().alias("made"))


@query(
    """
SELECT a.conv_id, printf('c%03d-q%03d', a.conv_id, a.turn + 1) AS candidate_id, strlen(a.text)::BIGINT AS answer_bytes
FROM conversations a WHERE a.role = 'assistant'"""
)
def reconcile_candidates(t):
    """Candidate ids of every answer, numbers padded to three digits and never cut."""
    c = t("conversations").where("role = 'assistant'")
    return c.select("conv_id", F.format_string("c%03d-q%03d", F.col("conv_id"), F.col("turn") + 1).alias("candidate_id"), F.octet_length("text").cast("long").alias("answer_bytes"))


@query(r"""
WITH m AS (SELECT conv_id, turn, regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '^`+|`+$', '', 'g') AS v FROM conversations),
f AS (SELECT *, lower(v) AS low, regexp_replace(regexp_extract(lower(v), '(\S+)', 1), '^["''`.,:;]+|["''`.,:;]+$', '', 'g') AS first,
  list_filter(['source:', 'source metadata', 'note status', 'status:', 'study iq', 'rs sharma', 'history optional', 'part number', 'part ', 'course', 'series'], lambda x: contains(lower(v), x)) AS leaks,
  list_intersect(regexp_split_to_array(lower(v), '[^\p{L}\p{Nd}]+'), ['note', 'text', 'content', 'description', 'described', 'discussed', 'according', 'source', 'status']) AS meta FROM m)
SELECT conv_id, turn, len(leaks) > 0 AS leak, CASE WHEN contains(low, '?') THEN 'question-mark' WHEN first IN ('what', 'how', 'why', 'when', 'where', 'which', 'who', 'whom') THEN 'question-word'
  WHEN len(leaks) > 0 OR len(meta) > 0 THEN 'metadata' END AS issue, CASE WHEN len(leaks) > 0 THEN 'summary_keywords' WHEN length(v) > 320 THEN 'too-long' END AS as_keywords FROM f""".replace("\\\\", "\\"))
def metadata_issues(t):
    """What would be wrong with each turn as a recall prompt and as keywords."""
    v = F.regexp_replace(T.trim_ws(F.regexp_replace(T.or_blank(F.col("text")), T.SPACES, " ")), "^`+|`+$", "")
    m = t("conversations").select("conv_id", "turn", v.alias("v"))
    none = F.array().cast("array<string>")
    return m.select("conv_id", "turn", filters.metadata_leak(F.col("v")).alias("leak"), filters.recall_prompt_issue(F.col("v")).alias("issue"), filters.metadata_issue(F.lit(""), F.col("v"), none).alias("as_keywords"))


@query(
    """
WITH u AS (SELECT conv_id, arg_min(text, turn) AS before, arg_max(text, turn) AS after FROM conversations WHERE role = 'assistant' GROUP BY 1),
a AS (SELECT conv_id, unnest(string_split(before, chr(10))) AS line, generate_subscripts(string_split(before, chr(10)), 1) - 1 AS at FROM u),
b AS (SELECT conv_id, unnest(string_split(after, chr(10))) AS line, generate_subscripts(string_split(after, chr(10)), 1) - 1 AS at FROM u)
SELECT conv_id, count(*) FILTER (x IS NOT NULL) AS removed, count(*) FILTER (y IS NOT NULL) AS added FROM (
  SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, a.line AS x, b.line AS y FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.at = b.at
) WHERE x IS DISTINCT FROM y GROUP BY 1"""
)
def answer_diff(t):
    """Lines that differ, place by place, between a conversation's first and last answer."""
    c = t("conversations").where("role = 'assistant'").groupBy(F.col("conv_id").alias("id")).agg(F.min_by("text", "turn").alias("before"), F.max_by("text", "turn").alias("after"))
    rows = notes.positional_diff(c)
    return rows.groupBy(F.col("id").alias("conv_id")).agg(F.count_if(F.col("kind") == "-").alias("removed"), F.count_if(F.col("kind") == "+").alias("added"))


@query()
def line_diffs(t):
    """Two-column line diffs between a conversation's first and last answer."""
    c = t("conversations").where("role = 'assistant'").groupBy(F.col("conv_id").alias("id")).agg(F.min_by("text", "turn").alias("before"), F.max_by("text", "turn").alias("after"))
    return notes.line_diff(c)
