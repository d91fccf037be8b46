"""Documents, pages, benchmark passages and vectors."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from docloom.functions import numbers as N
from docloom.functions import text as T
from docloom.operators import aggregates, dedup, filters, joins, packing, search, windows
from docloom.plans.registry import query

_NORM = r"trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g'))"


@query(f"""
WITH k AS (SELECT doc_id, source, strlen(text) AS n, {_NORM} AS key FROM documents)
SELECT doc_id, source, n::BIGINT AS n_bytes FROM k WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, doc_id) = 1""")
def dedup_longest(t):
    """The longest document of each normalised text."""
    d = t("documents").select(F.col("doc_id").alias("pos"), F.lit("").alias("title"), F.col("text").alias("content"), "source")
    return dedup.dedupe_news(d).select(F.col("pos").alias("doc_id"), "source", F.octet_length("content").cast("long").alias("n_bytes"))


@query("""
WITH l AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3)) AS a FROM documents),
b AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3)) AS b FROM benchmark),
s AS (SELECT doc_id, item_id, len(list_intersect(a, b)) AS i, len(a) AS na, len(b) AS nb FROM l, b)
SELECT doc_id, item_id, round(i / (na + nb - i), 6) AS score FROM s WHERE i > 0 AND i / (na + nb - i) >= 0.35""")
def jaccard_pairs(t):
    """Documents and benchmark passages whose token sets share 35 %."""
    d = t("documents").select(F.col("doc_id").alias("id"), T.token_set(F.col("text")).alias("tokens"))
    b = t("benchmark").select(F.col("item_id").alias("id"), T.token_set(F.col("text")).alias("tokens"))
    out = dedup.similar_pairs(d, b, 0.35)
    return out.select(F.col("left_id").alias("doc_id"), F.col("right_id").alias("item_id"), F.round("score", 6).alias("score"))


@query("""
WITH d AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT * FROM d WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS query, d.vec_id AS path, list_dot_product(q.e, d.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(d.e, d.e))) AS score FROM q, d WHERE q.vec_id <> d.vec_id)
SELECT query, path, round(score, 6) AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, path) AS rank FROM s QUALIFY rank <= 12""")
def cosine_topk(t):
    """The twelve vectors most similar to each whose id is divisible by twenty: a top-k report."""
    e = t("embeddings").select(F.col("vec_id").alias("path"), "embedding")
    out = dedup.cosine_topk(e, e.where("path % 20 = 0").withColumnRenamed("path", "query"))
    return out.select("query", "path", F.round("score", 6).alias("score"), "rank")


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
n AS (SELECT doc_id, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS norm, length(regexp_replace(regexp_replace(line, '^\s+', ''), '\s+$', '')) AS n FROM l),
c AS (SELECT doc_id, norm, count(*) AS c, count(*) FILTER (n >= 20) AS long FROM n WHERE n > 0 GROUP BY 1, 2)
SELECT doc_id, sum(c)::BIGINT AS lines, sum(greatest(0, long - 1))::BIGINT AS repeats FROM c GROUP BY 1""")
def repeated_lines(t):
    return dedup.repeated_line_counts(t("documents").select("doc_id", "text"), "doc_id")


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
n AS (SELECT doc_id, pos, regexp_replace(regexp_replace(line, '^\s+', ''), '\s+$', '') AS line, trim(regexp_replace(lower(line), '\s+', ' ', 'g')) AS norm FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, norm ORDER BY pos) AS nth FROM n WHERE line <> '')
SELECT doc_id, sha256(string_agg(line, chr(10) ORDER BY pos)) AS text_hash FROM k WHERE length(line) < 20 OR nth = 1 GROUP BY 1""")
def ocr_line_dedup(t):
    """Texts without repeated long lines and blank lines."""
    d = t("documents").select("doc_id", "text")
    return dedup.unique_lines(d).where("text <> ''").select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query("""
SELECT doc_id, greatest(1, ceil(strlen(text) / 3.0))::BIGINT + CASE WHEN n_chars % 9000 < 4096 THEN greatest(4096, floor(greatest(1, ceil(strlen(text) / 3.0)) * 15 / 100)) ELSE n_chars % 9000 END::BIGINT AS tokens,
  sha256(text) AS hash, 'doc-' || left(sha256(source || ':' || doc_id), 16) AS scoped FROM documents""")
def token_estimate(t):
    """Tokens to reserve for each document, its hash and its id."""
    d = t("documents")
    size, asked = F.octet_length("text"), F.col("n_chars") % 9000
    return d.select("doc_id", N.request_tokens(size, asked).alias("tokens"), T.hash_text(F.col("text")).alias("hash"), T.hash_id("doc", F.col("source"), F.col("doc_id").cast("string")).alias("scoped"))


@query("""
WITH m AS (SELECT d.doc_id, d.source, b.quality, b.toxic FROM documents d LEFT JOIN labels b ON b.doc_id = d.doc_id)
SELECT source, count(*) AS documents, count(quality) AS labelled, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic,
  round(count(*) FILTER (quality = 1) / nullif(count(quality), 0)::DOUBLE, 6) AS good_rate, CAST(round(100.0 * count(quality) / count(*)) AS BIGINT) AS labelled_percent
FROM m GROUP BY source""")
def label_coverage(t):
    """Labels by source: left join, conditional counts, rates that are null without a denominator."""
    both = joins.left_first(t("documents").select("doc_id", "source"), t("labels"), ["doc_id"], F.col("quality"))
    n = both.groupBy("source").agg(F.count("*").alias("documents"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))
    return n.withColumn("good_rate", F.round(N.rate(F.col("good"), F.col("labelled")), 6)).withColumn("labelled_percent", N.percent(F.col("labelled"), F.col("documents")))


@query("""
WITH c AS (SELECT doc_id, true AS known FROM documents WHERE doc_id % 3 <> 0), a AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1)
SELECT coalesce(c.doc_id, a.doc_id) AS id, CASE WHEN known IS NULL THEN 'unknown' WHEN n IS NULL THEN 'missing' ELSE 'duplicate' END AS issue
FROM c FULL JOIN a ON a.doc_id = c.doc_id WHERE known IS NULL OR n IS NULL OR n > 1""")
def assignment_check(t):
    """Unknown, missing and duplicated assignments of labels to the candidates, which by definition leave out every third id."""
    d = t("documents").select(F.col("doc_id").alias("id"))
    labels = t("labels")
    assigned = labels.select(F.col("doc_id").alias("id")).unionByName(labels.where("toxic = 1").select(F.col("doc_id").alias("id")))
    return joins.assignment_issues(d.where(F.col("id") % 3 != 0), assigned)


@query("""
WITH b AS (SELECT d.doc_id AS copy_id, b.doc_id AS review_id, 8 + CASE WHEN d.n_chars = b.n_chars THEN 4 ELSE 0 END + CASE WHEN b.lang = 'en' THEN 2 ELSE 0 END AS rank
  FROM documents d JOIN documents b ON md5(d.text) = md5(b.text))
SELECT copy_id, review_id, rank::BIGINT AS rank FROM b QUALIFY row_number() OVER (PARTITION BY copy_id ORDER BY rank DESC, review_id) = 1""")
def best_match(t):
    """Each document's best match among documents: by path (here its text's hash), name and readiness."""
    d = t("documents").select("doc_id", F.md5("text").alias("source_path"), F.col("n_chars").cast("string").alias("pdf_name"), F.when(F.col("lang") == "en", "ready").otherwise("draft").alias("status"))
    copies = d.select(F.col("doc_id").alias("copy_id"), "source_path", "pdf_name")
    reviews = d.select(F.col("doc_id").alias("review_id"), "source_path", "pdf_name", "status", F.lit(0).cast("timestamp").alias("updated_at"))
    reviews = joins.one_per_key(reviews, ["source_path", "pdf_name", "status"], F.col("review_id"))
    return joins.best_match(copies, reviews)


_FOUND = r"""
WITH w AS (SELECT item_id AS id, lower(regexp_extract(text, '\S+ \S+ \S+')) AS name, CASE WHEN item_id % 2 = 0 THEN '/b/' || item_id % 40 ELSE '' END AS path FROM benchmark),
i AS (SELECT id, path, CASE WHEN name <> '' THEN name ELSE regexp_extract(path, '[^/]*$') END AS name, '' AS more, 'draft' AS status, 0 AS seen FROM w),
d AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN '/b/' || doc_id % 40 ELSE '' END AS path, lower(regexp_extract(text, '\S+ \S+ \S+')) AS n, lower(text) AS more, CASE WHEN lang = 'en' THEN 'ready' ELSE 'draft' END AS status, n_chars AS seen FROM documents),
j AS (SELECT id, path, CASE WHEN n <> '' THEN n ELSE regexp_extract(path, '[^/]*$') END AS name, more, status, seen FROM d),
"""


def _found(t):
    words = F.regexp_extract("text", r"\S+ \S+ \S+", 0)
    path = lambda c, k: F.when(F.col(c) % k == 0, F.concat(F.lit("/b/"), (F.col(c) % 40).cast("string"))).otherwise("")
    items = t("benchmark").select(F.col("item_id").alias("id"), path("item_id", 2).alias("source_path"), words.alias("pdf_name"), F.lit("").alias("search_text"), F.lit("draft").alias("status"), F.lit(0).cast("timestamp").alias("updated_at"))
    ready = F.when(F.col("lang") == "en", "ready").otherwise("draft")
    docs = t("documents").select(F.col("doc_id").alias("id"), path("doc_id", 3).alias("source_path"), words.alias("pdf_name"), F.col("text").alias("search_text"), ready.alias("status"), F.timestamp_seconds("n_chars").alias("updated_at"))
    return items, docs


@query(
    _FOUND
    + """
r AS (SELECT i.id AS copy_id, j.id AS review_id, j.seen, CASE WHEN i.path <> '' AND j.path <> '' AND i.path <> j.path THEN 0 ELSE
    CASE WHEN i.path <> '' AND i.path = j.path THEN 8 ELSE 0 END + CASE WHEN i.name = j.name THEN 4 ELSE 0 END + CASE WHEN j.status = 'ready' THEN 2 ELSE 0 END END AS rank
  FROM i JOIN j ON i.name <> '' AND (contains(j.name, i.name) OR contains(j.path, i.name) OR contains(j.more, i.name)))
SELECT copy_id, review_id, rank::BIGINT AS rank FROM r WHERE rank > 0 QUALIFY row_number() OVER (PARTITION BY copy_id ORDER BY rank DESC, seen DESC, review_id) = 1"""
)
def reviews_found(t):
    """The best review (a document) of each copy (a benchmark item) whose path, name or whole search text holds the copy's name."""
    items, docs = _found(t)
    out = search.best_found(items.withColumnRenamed("id", "wanted_id"), docs.withColumnRenamed("id", "offered_id"))
    return out.select(F.col("wanted_id").alias("copy_id"), F.col("offered_id").alias("review_id"), "rank")


@query(
    _FOUND
    + """
r AS (SELECT j.id AS review_id, i.id AS copy_id, CASE WHEN i.path <> '' AND j.path <> '' AND i.path <> j.path THEN 0 ELSE
    CASE WHEN i.path <> '' AND i.path = j.path THEN 8 ELSE 0 END + CASE WHEN i.name = j.name THEN 4 ELSE 0 END END AS rank
  FROM j JOIN i ON j.name <> '' AND i.id <> j.id AND (contains(i.name, j.name) OR contains(i.path, j.name) OR contains(lower(i.body), j.name)))
SELECT review_id, copy_id, rank::BIGINT AS rank FROM r WHERE rank > 0 QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY rank DESC, copy_id) = 1""".replace("JOIN i ON", "JOIN (SELECT i.*, b.text AS body FROM i JOIN benchmark b ON b.item_id = i.id) i ON")
)
def copies_found(t):
    """The best copy of each review the other way round: by the review's name, never of its own id."""
    items, docs = _found(t)
    items = items.drop("search_text").join(t("benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("search_text")), "id")
    out = search.best_found(docs.withColumnRenamed("id", "wanted_id"), items.withColumnRenamed("id", "offered_id"), with_status=False, apart=True)
    return out.select(F.col("wanted_id").alias("review_id"), F.col("offered_id").alias("copy_id"), "rank")


@query(r"""
SELECT item_id, doc_id FROM (SELECT item_id, lower(regexp_extract(text, '\S+ \S+')) AS q FROM benchmark) JOIN documents ON q <> '' AND (contains(lower(text), q) OR contains(lower(source), q))""")
def searches(t):
    """The documents that a search for the first two words of each benchmark item finds."""
    asked = t("benchmark").select(F.col("item_id").alias("query_id"), F.regexp_extract("text", r"\S+ \S+", 0).alias("query")).where("query <> ''")
    return search.search_each(asked, t("documents").select("doc_id", "text", "source"), "doc_id", ["text", "source"]).select(F.col("query_id").alias("item_id"), "doc_id")


@query(r"""
WITH h AS (SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS link FROM pages), n AS (SELECT DISTINCT regexp_extract(link, '([^/]+)/*$', 1) AS name FROM h),
a AS (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)/*$', 1) AS name FROM pages)
SELECT page_id, name FROM a WHERE name NOT IN (SELECT name FROM n)""")
def unreferenced_pages(t):
    """Pages whose last path part no page links to."""
    p = t("pages")
    assets = p.select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("path"))
    out = joins.unreferenced(assets, p.select(F.col("html").alias("text")), 'href="([^"]*)"')
    return out.select("page_id", T.base_name(F.col("path")).alias("name"))


@query(r"""
SELECT doc_id, word_count AS n_words, CASE WHEN word_count = 0 THEN '' ELSE first END AS first_word, lower(source) || '-' || doc_id AS label, left(sha1(source), 12) AS folder,
 contains(lower(text), '<html') OR contains(lower(text), '</body>') OR contains(lower(text), 'internal server error') AS error_page
FROM (SELECT *, len(regexp_extract_all(text, '\S+')) AS word_count, regexp_extract(text, '(\S+)', 1) AS first FROM documents)""")
def text_fields(t):
    """Scalar text functions over every document."""
    d = t("documents")
    words = F.regexp_extract(T.or_blank(F.col("text")), r"(?U)(\S+)", 1)
    return d.select("doc_id", T.word_count(F.col("text")).alias("n_words"), words.alias("first_word"), T.label_norm(F.concat_ws(" ", "source", "doc_id")).alias("label"), T.hash_folder(F.col("source")).alias("folder"), T.error_page(F.col("text")).alias("error_page"))


@query("""
WITH b AS (SELECT source, doc_id, lang || '-' || (n_chars % 10) AS base FROM documents)
SELECT doc_id, base, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS unique_id FROM (SELECT *, row_number() OVER (PARTITION BY source, base ORDER BY doc_id) AS n FROM b)""")
def unique_suffix(t):
    d = t("documents").select("doc_id", "source", F.concat_ws("-", "lang", (F.col("n_chars") % 10).cast("string")).alias("base"))
    return windows.unique_suffix(d, "base", ["source"], F.col("doc_id")).select("doc_id", "base", "unique_id")


@query("""
WITH h AS (SELECT doc_id, sha256(doc_id::VARCHAR) AS hash FROM documents), r AS (SELECT *, row_number() OVER (ORDER BY hash) AS r, count(*) OVER () AS n FROM h)
SELECT doc_id, CASE WHEN r <= n // 20 THEN 'eval' ELSE 'train' END AS split FROM r""")
def hash_split(t):
    """A train/eval split of all documents by hash order."""
    return packing.train_eval(t("documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("hash")), "hash").select("doc_id", "split")


@query("""
WITH f AS (SELECT lower(trim(source)) AS key, arg_min(trim(source), doc_id) AS value FROM documents WHERE trim(source) <> '' GROUP BY 1) SELECT value FROM f""")
def facet_values(t):
    return filters.facet_values(t("documents"), "source", "doc_id")


@query("""
WITH p AS (SELECT source AS copy_id, doc_id, CASE WHEN lang = 'en' THEN 'answer' WHEN lang = 'de' THEN 'question_paper' ELSE 'other' END AS kind, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE (doc_id % 11) / 10.0 END AS conf, n_chars % 5 AS unclear FROM documents)
SELECT copy_id, count(*) AS pages, count(*) FILTER (kind <> 'other') AS classified_pages, count(conf) AS ocr_assessed_pages, sum(unclear)::BIGINT AS unclear_count,
  round(coalesce(sum(conf), 0), 6) AS ocr_confidence, least(1.0, min(conf))::DOUBLE AS minimum_ocr_confidence, count(*) FILTER (conf IS NULL OR conf < 0.7) AS to_review FROM p GROUP BY 1""")
def page_quality(t):
    """Page figures by source, with made-up OCR confidences."""
    i = F.col("doc_id")
    p = t("documents").select(
        F.col("source").alias("copy_id"), i.alias("number"), "text",
        F.when(F.col("lang") == "en", "answer").when(F.col("lang") == "de", "question_paper").otherwise("other").alias("kind"),
        F.lit(0.9).alias("kind_confidence"), (F.col("n_chars") % 5).alias("unclear_count"),
        F.when(i % 7 != 0, (i % 11) / 10.0).alias("ocr_confidence"), F.array().cast("array<string>").alias("ocr_issues"),
    )
    q = aggregates.page_quality(p)
    return q.select("copy_id", "pages", "classified_pages", "ocr_assessed_pages", F.col("unclear_count").cast("long"), F.round("ocr_confidence", 6).alias("ocr_confidence"), "minimum_ocr_confidence", F.size("ocr_review_pages").cast("long").alias("to_review"))


@query("""
WITH c AS (SELECT unnest([1, 3, 5, 7, 9, 11]) AS first) SELECT doc_id, first::BIGINT AS first, least(first + 3, n)::BIGINT AS last
FROM (SELECT doc_id, 1 + doc_id % 12 AS n FROM documents), c WHERE first <= greatest(n - 2, 1)""")
def page_chunks(t):
    """Overlapping windows of four pages over documents of one to twelve pages."""
    d = t("documents").select("doc_id", (1 + F.col("doc_id") % 12).alias("n"))
    return d.select("doc_id", F.explode(windows.page_chunks(F.col("n"))).alias("c")).select("doc_id", "c.first", "c.last")


@query("""
WITH b AS (SELECT doc_id, source, lang, text FROM documents) SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS rank FROM b WHERE contains(lower(text), 'the') AND lower(lang) = 'en' ORDER BY doc_id DESC LIMIT 30 OFFSET 10""")
def search_paged(t):
    """The second page of a search: literal text, a facet, newest first."""
    rows = filters.facets(filters.search(t("documents").withColumn("status", F.lit("")), "The", ["text"]), "text", "", {"lang": "EN"})
    few = filters.page(rows.select("doc_id"), [F.desc("doc_id")], 30, 10)
    return few.select("doc_id", (F.col("rank") + 10).alias("rank"))


@query("""
WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 3)) AS a FROM documents),
w AS MATERIALIZED (SELECT doc_id, unnest(a) AS token, len(a) AS n FROM l),
p AS (SELECT x.doc_id AS one, y.doc_id AS two FROM w x JOIN w y ON x.token = y.token AND x.doc_id < y.doc_id GROUP BY 1, 2, x.n, y.n HAVING count(*) / (x.n + y.n - count(*)) >= 0.35),
o AS MATERIALIZED (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, coalesce(b.before, []) AS before FROM l LEFT JOIN (SELECT two, list(one) AS before FROM p GROUP BY two) b ON b.two = doc_id),
r AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS leaders
  UNION ALL SELECT o.k, CASE WHEN list_has_any(r.leaders, o.before) THEN r.leaders ELSE list_append(r.leaders, o.doc_id) END FROM r JOIN o ON o.k = r.k + 1),
e AS (SELECT leaders FROM r ORDER BY k DESC LIMIT 1)
SELECT '' AS block, doc_id AS id, coalesce(list_min(list_intersect(before, leaders)), doc_id) AS leader, 1.0::DOUBLE AS score FROM o, e""")
def leader_clusters(t):
    """Greedy clusters of all documents."""
    d = t("documents").select(F.lit("").alias("block"), F.col("doc_id").alias("pos"), F.col("doc_id").alias("id"), T.token_set(F.col("text")).alias("tokens"))
    return dedup.leader_clusters(d)


@query(r"""
WITH RECURSIVE e AS (SELECT source AS shelf, printf('%012d.md', doc_id) AS path, strlen(regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '\s+$', ''))::BIGINT AS n FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY shelf ORDER BY path) AS k FROM e WHERE n > 0),
r AS (SELECT DISTINCT shelf, NULL::VARCHAR AS path, 0::BIGINT AS taken, 0::BIGINT AS k, 0::BIGINT AS notes, 120000::BIGINT AS room FROM o
  UNION ALL SELECT r.shelf, o.path, x.got, o.k, r.notes + (x.got > 0)::BIGINT, r.room - x.got FROM r JOIN o ON o.shelf IS NOT DISTINCT FROM r.shelf AND o.k = r.k + 1,
    LATERAL (SELECT CASE WHEN r.notes >= 25 THEN 0 WHEN o.n <= r.room THEN o.n WHEN r.room >= 1200 THEN r.room ELSE 0 END AS got) x WHERE r.notes < 25 AND r.room > 0)
SELECT shelf, path, taken AS taken_bytes FROM r WHERE taken > 0""")
def note_budget(t):
    """Documents taken as notes under the budget of each source's shelf."""
    d = t("documents").select(F.col("source").alias("shelf"), F.format_string("%012d.md", "doc_id").alias("path"), F.col("text").alias("content"))
    return packing.note_budget(d, "shelf")


@query("""
WITH s AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS n FROM documents) SELECT doc_id, (n // 128)::BIGINT AS batch FROM s""")
def row_batches(t):
    return windows.row_batches(t("documents").select("doc_id", "source"), 128, ["source"], ["doc_id"]).select("doc_id", "batch")


@query("""
SELECT source, min(doc_id) AS first_doc, max(strlen(text))::BIGINT AS best_bytes, arg_max(doc_id, (strlen(text), -doc_id)) AS best_doc FROM documents GROUP BY source""")
def best_page(t):
    """The longest document of each source, the first on a tie."""
    d = t("documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("best_bytes"))
    first = d.groupBy(F.col("source").alias("of")).agg(F.min("doc_id").alias("first_doc"))
    best = aggregates.canonical(d.withColumnRenamed("doc_id", "best_doc"), ["source"], "best_bytes", "best_doc")
    return best.join(first, F.col("source").eqNullSafe(F.col("of"))).select("source", "first_doc", "best_bytes", "best_doc")


@query(r"""
WITH n AS (SELECT page_id, html, regexp_replace(lower(trim(coalesce(url, ''))), '\.[^./]*$', '') AS stem FROM pages),
s AS (SELECT *, regexp_replace(regexp_replace(stem, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM n)
SELECT page_id, regexp_replace(left(slug, 96), '^-+|-+$', '', 'g') AS stem, contains(lower(coalesce(html, '')), '<html') OR contains(lower(coalesce(html, '')), '</body>') OR contains(lower(coalesce(html, '')), 'internal server error') AS error_page FROM s""")
def page_names(t):
    """Slugs of the pages' addresses, and whether their HTML looks like an error page."""
    return t("pages").select("page_id", T.safe_stem(F.col("url")).alias("stem"), T.error_page(F.col("html")).alias("error_page"))


@query("""
WITH d AS (SELECT doc_id, 3 + doc_id % 1777 AS w, 2 + n_chars % 1301 AS h FROM documents), s AS (SELECT *, least(w, ceil(w * 0.42))::BIGINT AS tw, least(h, ceil(h * 0.42))::BIGINT AS th FROM d)
SELECT doc_id, r::INT AS row, c::INT AS col, CASE c WHEN 0 THEN 0 WHEN 1 THEN (w - tw) // 2 ELSE w - tw END::BIGINT AS x0, CASE r WHEN 0 THEN 0 WHEN 1 THEN (h - th) // 2 ELSE h - th END::BIGINT AS y0,
  (CASE c WHEN 0 THEN 0 WHEN 1 THEN (w - tw) // 2 ELSE w - tw END + tw)::BIGINT AS x1, (CASE r WHEN 0 THEN 0 WHEN 1 THEN (h - th) // 2 ELSE h - th END + th)::BIGINT AS y1
FROM s, (SELECT unnest([0, 1, 2]) AS r), (SELECT unnest([0, 1, 2]) AS c)""")
def page_tiles(t):
    """Nine overlapping tiles of page images whose sides are made up from the documents' figures."""
    d = t("documents").select("doc_id", F.explode(N.tile_boxes(3 + F.col("doc_id") % 1777, 2 + F.col("n_chars") % 1301)).alias("b"))
    return d.select("doc_id", "b.*")
