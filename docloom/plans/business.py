"""Orders, parts and customers as stand-ins for jobs, copies and settings."""

from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators import aggregates, filters, joins, study, windows
from docloom.plans.registry import query
from docloom.sources import sinks


@query("""
WITH c AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority, 1 AS v FROM orders WHERE o_orderkey % 10 = 3),
n AS (SELECT o_orderkey + 1000000000 AS o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 100 = 7)
SELECT o.o_orderkey, o.o_custkey, CASE WHEN c.v = 1 THEN 'X' ELSE o.o_orderstatus END AS o_orderstatus, CASE WHEN c.v = 1 THEN o.o_totalprice + 2 ELSE o.o_totalprice END AS o_totalprice,
  o.o_orderdate AS created_at, CASE WHEN c.v = 1 THEN TIMESTAMP '2030-01-01' ELSE o.o_orderdate END AS updated_at FROM orders o LEFT JOIN c USING (o_orderkey)
UNION ALL SELECT o_orderkey, o_custkey, 'X', o_totalprice + 2, TIMESTAMP '2029-01-01', TIMESTAMP '2030-01-01' FROM n""")
def upsert_latest(t):
    """Orders after two rounds of changes to some and some new ones: the last change wins, creation times stay."""
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))
    touched = o.where("o_orderkey % 10 = 3").unionByName(o.where("o_orderkey % 100 = 7").withColumn("o_orderkey", F.col("o_orderkey") + 1_000_000_000))
    touched = touched.withColumns({"created_at": F.lit("2029-01-01").cast("timestamp"), "o_orderstatus": F.lit("X")})
    changes = touched.withColumns({"o_totalprice": F.col("o_totalprice") + 1, "seq": F.lit(1)}).unionByName(touched.withColumns({"o_totalprice": F.col("o_totalprice") + 2, "seq": F.lit(2)}))
    return sinks.upsert(o, changes, "o_orderkey", F.lit("2030-01-01").cast("timestamp"))


@query("""
SELECT o_orderpriority AS batch, count(*) AS items, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS open, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1""")
def status_agg(t):
    o = filters.by_status(t("orders").withColumn("status", F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "failed").otherwise("running")), "finished")
    n = o.groupBy(F.col("o_orderpriority").alias("batch"))
    return n.agg(F.count("*").alias("items"), F.count_if(F.col("status") == "completed").alias("finished"), F.count_if(F.col("status") == "failed").alias("open"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
SELECT l_orderkey, l_linenumber, k AS dimension_key, v AS value FROM (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, CASE WHEN l_quantity > 25 THEN 'large' ELSE '' END AS size_text, l_partkey FROM lineitem)
UNPIVOT (v FOR k IN (l_returnflag, l_linestatus, size_text)) WHERE v <> ''""")
def unpivot_dims(t):
    """Three columns as rows, blanks dropped."""
    li = t("lineitem").withColumn("size_text", F.when(F.col("l_quantity") > 25, "large").otherwise(""))
    out = study.unpivot_dimensions(li, ["l_orderkey", "l_linenumber"], ["l_returnflag", "l_linestatus", "size_text"])
    return out.select("l_orderkey", "l_linenumber", "dimension_key", F.col("text").alias("value"))


@query("""
WITH g AS (SELECT DISTINCT l_partkey AS page, l_returnflag AS status, l_orderkey AS pos FROM lineitem)
SELECT a.page, a.status, a.pos, count(*) AS links, min(b.pos) AS first_other FROM g a JOIN g b ON a.page = b.page AND a.status <> b.status GROUP BY 1, 2, 3""")
def overlap_self(t):
    """Orders with lines of one flag and a part that lines of another flag share: how many, and the first of them."""
    g = t("lineitem").select(F.col("l_orderkey").alias("pos"), F.col("l_returnflag").alias("status"), F.array("l_partkey").alias("source_pages"))
    return joins.overlapping(g)


@query("""
SELECT p_partkey, trim(regexp_replace(lower(p_name), '\\s+', '-', 'g')) AS label, p_brand AS brand, coalesce(nullif(CASE WHEN p_size < 10 THEN '' ELSE p_type END, ''), p_brand) AS named, CASE WHEN p_size <> 0 THEN p_size ELSE 1 END AS size FROM part""")
def coalesce_blank(t):
    p = t("part")
    some = F.when(F.col("p_size") < 10, "").otherwise(F.col("p_type"))
    return p.select("p_partkey", T.label_norm(F.col("p_name")).alias("label"), F.col("p_brand").alias("brand"), T.first_text(some, F.col("p_brand")).alias("named"), T.first_number(F.col("p_size"), F.lit(1)).alias("size"))


@query("""
WITH r AS (SELECT p_brand, p_partkey, p_size // 10 AS priority, p_partkey AS pos FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand, priority ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY p_brand, priority) AS n FROM r)
SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY priority, ((i - 3) % n + n) % n) AS place FROM k""")
def round_robin(t):
    """Parts as targets of a brand: by priority, rotated by three inside each."""
    p = t("part").select("p_brand", "p_partkey", F.floor(F.col("p_size") / 10).alias("priority"), F.col("p_partkey").alias("pos"))
    return windows.round_robin(p, 3, ["p_brand"]).select("p_partkey", "place")


@query("""
SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer WHERE lower(c_mktsegment) = 'building' AND contains(lower(c_name), '1') ORDER BY c_acctbal DESC, c_custkey LIMIT 80""")
def facets(t):
    """The first page of customers of a segment: a listing of 80."""
    from docloom.functions.numbers import LIMITS, page_limit

    rows = filters.facets(t("customer"), "c_name", "1", {"c_mktsegment": "Building"})
    return filters.page(rows.select("c_custkey", "c_mktsegment", "c_acctbal"), [F.desc("c_acctbal"), F.col("c_custkey")], page_limit(None, *LIMITS["copies"])).drop("c_acctbal")


@query("""
WITH d AS (SELECT n_nationkey AS id, n_name AS name, n_regionkey AS region FROM nation), o AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE s_name END AS name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_nationkey END AS region FROM supplier)
SELECT coalesce(o.id, d.id)::BIGINT AS id, coalesce(nullif(o.name, ''), d.name) AS name, coalesce(o.region, d.region)::INTEGER AS region FROM o FULL JOIN d ON d.id = o.id""")
def settings_merge(t):
    """Stored rows with blanks filled from defaults, and the defaults that aren't stored."""
    d = t("nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    s = t("supplier")
    k = F.col("s_suppkey")
    o = s.select(k.alias("id"), F.when(k % 2 != 0, F.col("s_name")).otherwise("").alias("name"), F.when(k % 3 != 0, F.col("s_nationkey")).alias("region"))
    return study.merged_settings(d, o)


@query("""
SELECT o_custkey AS copy_id, count(*) AS questions, max(o_totalprice) AS dearest, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS canonical,
  list_sort(list_distinct(list((o_orderkey % 50)) FILTER (o_orderkey % 50 > 0))) AS pages FROM orders GROUP BY 1""")
def canonical_orders(t):
    """Each customer's dearest order, the first on a tie, and the union of page numbers."""
    o = t("orders").select(F.col("o_custkey").alias("copy_id"), "o_orderkey", "o_totalprice")
    n = o.groupBy("copy_id").agg(F.count("*").alias("questions"), F.max("o_totalprice").alias("dearest"), T.page_union(F.collect_set(F.col("o_orderkey") % 50)).alias("pages"))
    best = aggregates.canonical(o, ["copy_id"], "o_totalprice", "o_orderkey").select("copy_id", F.col("o_orderkey").alias("canonical"))
    return n.join(best, "copy_id").withColumn("pages", F.when(F.size("pages") > 0, F.col("pages")))


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders), l AS (SELECT l_orderkey, l_shipdate, l_linenumber, l_quantity FROM lineitem)
SELECT o.o_orderkey, arg_min(l_linenumber, (l_shipdate, l_linenumber, l_quantity)) AS first_line FROM o LEFT JOIN l ON l.l_orderkey = o.o_orderkey GROUP BY 1""")
def first_match(t):
    """Each order with its line shipped first."""
    li = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate", "l_linenumber", "l_quantity")
    out = joins.left_first(t("orders").select("o_orderkey"), li, ["o_orderkey"], F.col("l_shipdate"), F.col("l_linenumber"), F.col("l_quantity"))
    return out.select("o_orderkey", F.col("l_linenumber").alias("first_line"))


@query("""
SELECT c_custkey, count(o_orderkey) > 0 AS has_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def semi_anti(t):
    """Customers with and without orders: a semi and an anti join."""
    c, o = t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("has_orders", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("has_orders", F.lit(False)))


@query("""
WITH s AS (SELECT o_orderkey, 1 + o_orderkey % 20 AS doc, o_custkey % 3 AS kind FROM orders), k AS (SELECT doc, kind, min(o_orderkey) AS pos, count(*) AS n FROM s GROUP BY 1, 2)
SELECT doc, count(*) AS kinds, sum(n)::BIGINT AS rows, count(*) FILTER (kind = 0) AS zero FROM k GROUP BY 1""")
def ledger_counts(t):
    """Distinct claims by document."""
    s = t("orders").select((1 + F.col("o_orderkey") % 20).alias("doc"), (F.col("o_custkey") % 3).alias("kind"))
    k = s.groupBy("doc", "kind").agg(F.count("*").alias("n"))
    return k.groupBy("doc").agg(F.count("*").alias("kinds"), F.sum("n").alias("rows"), F.count_if(F.col("kind") == 0).alias("zero"))
