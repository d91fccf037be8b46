"""Page decisions, reconciliation of overlapping chunks, and checked plans."""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import numbers as N
from docloom.functions import text as T
from docloom.operators.aggregates import merge_metadata


def ledger_issues(decisions: DataFrame, pages: DataFrame, scope: str = "copy_id") -> DataFrame:
    """(scope, page_number, issue): decisions and pages that aren't one to one, or whose values are out of range."""
    n = decisions.groupBy(scope, "page_number").agg(F.count("*").alias("n"), F.max(~F.col("boundary").isin("new", "continuation", "uncertain")).alias("bad"), F.max(~F.coalesce(F.col("boundary_confidence").between(0, 1), F.lit(False))).alias("out"))
    both = n.join(pages.select(scope, F.col("number").alias("page_number")).distinct().withColumn("known", F.lit(True)), [scope, "page_number"], "full")
    issue = (
        F.when(F.col("known").isNull(), "unknown page").when(F.col("n").isNull(), "missing page").when(F.col("n") > 1, "duplicate page").when(F.col("bad"), "invalid boundary").when(F.col("out"), "invalid confidence")
    )
    return both.select(scope, "page_number", issue.alias("issue")).where("issue is not null")


def grounded_decisions(decisions: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """A question block of each page, from its decision: labels count only if the page's text bears them out.

    A label stays if the page holds its evidence and the evidence holds the label; otherwise, for a continuation that claims
    a label, and below 0.7 the boundary is uncertain. Uncertain blocks and new ones without a label need review.
    """
    label, evidence = T.or_blank(F.col("visible_label")), T.or_blank(F.col("label_evidence"))
    text = T.or_blank(F.col("text"))
    claims = (label != "") | (evidence != "")
    grounded = ~claims | ((label != "") & (evidence != "") & F.contains(text, evidence) & F.contains(evidence, label))
    kept = F.when(grounded, label).otherwise("")
    bound = (
        F.when(~grounded, "uncertain").when((F.col("boundary") == "continuation") & claims, "uncertain").when(F.col("boundary_confidence") < 0.7, "uncertain").otherwise(F.col("boundary"))
    )
    made = decisions.join(pages, keys).withColumns({"_label": kept, "_bound": bound})
    number = F.col("page_number").cast("string")
    name = F.when(F.col("_label") != "", F.col("_label")).when(F.col("_bound") == "continuation", F.concat(F.lit("Page "), number, F.lit(" continuation"))).otherwise(F.concat(F.lit("Page "), number, F.lit(" block")))
    review = (F.col("_bound") == "uncertain") | ((F.col("_bound") == "new") & (F.col("_label") == ""))
    return made.select(
        *keys,
        T.label_norm(name).alias("id"),
        name.alias("label"),
        T.trim_ws(text).alias("answer_markdown"),
        F.array("page_number").alias("source_pages"),
        F.when(review, "needs review").otherwise("detected").alias("status"),
        F.col("_bound").alias("boundary"),
        F.col("boundary_confidence"),
    )


def candidates(chunks: DataFrame) -> DataFrame:
    """Each question of each chunk with a candidate id. ``chunks``: copy_id, chunk, questions: array<struct<...>>."""
    rows = chunks.select("copy_id", "chunk", F.posexplode("questions").alias("pos", "q"))
    return rows.select("copy_id", F.format_string("c%03d-q%03d", F.col("chunk"), F.col("pos") + 1).alias("candidate_id"), "chunk", "pos", "q.*")


def candidate_score(answer: Column, status: Column, title: Column, confidence: Column) -> Column:
    """What makes a candidate canonical: an answer, its length, a title, its confidence."""
    return F.when(F.lower(status) == "answered", 1000.0).otherwise(0.0) + F.least(F.octet_length(T.or_blank(answer)), F.lit(100_000)) / 100.0 + F.when(T.is_blank(title), 0.0).otherwise(10.0) + F.coalesce(confidence, F.lit(0.0))


def reconcile(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Questions from candidates (copy_id, candidate_id, chunk, pos, label, title, answer_markdown, source_pages, status, confidence).

    ``plan``: copy_id, group_pos, id, status, candidate_ids, canonical_candidate_id, label, title, source_pages,
    merged_answer_markdown, confidence. A group's fields come from the plan, else from its canonical candidate: the named one,
    else that of the best score, the first on a tie. Unanswered groups have no answer. Below 0.75 a question needs review.
    """
    member = plan.select("copy_id", "group_pos", "canonical_candidate_id", F.explode("candidate_ids").alias("candidate_id"))
    joined = member.join(rows, ["copy_id", "candidate_id"])
    score = candidate_score(F.col("answer_markdown"), F.col("status"), F.col("title"), F.col("confidence"))
    order = F.struct((F.col("candidate_id") == F.col("canonical_candidate_id")).alias("named"), score.alias("score"), (-F.col("chunk")).alias("c"), (-F.col("pos")).alias("p"))
    best = joined.groupBy("copy_id", "group_pos").agg(
        F.max_by(F.struct("label", "title", "answer_markdown"), order).alias("c"), F.flatten(F.collect_list("source_pages")).alias("pages")
    )
    out = plan.join(best, ["copy_id", "group_pos"])
    unanswered = F.lower("status") == "unanswered"
    return out.select(
        "copy_id",
        "group_pos",
        "id",
        T.first_text(F.col("label"), F.col("c.label"), F.col("id")).alias("label"),
        T.first_text(F.col("title"), F.col("c.title")).alias("title"),
        F.when(unanswered, "").otherwise(T.first_text(F.col("merged_answer_markdown"), F.col("c.answer_markdown"))).alias("answer_markdown"),
        T.page_union(F.col("pages"), F.col("source_pages")).alias("source_pages"),
        F.when(unanswered, "unanswered").when(F.col("confidence") < 0.75, "needs review").otherwise("answered").alias("status"),
        "confidence",
    )


def plan_issues(plan: DataFrame, rows: DataFrame, n_pages: Column) -> DataFrame:
    """(copy_id, id, issue): groups of a plan that can't stand. ``plan`` also has reason; n_pages may use its columns."""
    pages = F.coalesce("source_pages", F.array().cast("array<long>"))
    issue = (
        F.when(T.is_blank(F.col("id")), "blank id")
        .when(F.size(F.coalesce("candidate_ids", F.array().cast("array<string>"))) == 0, "no candidates")
        .when(F.exists("candidate_ids", T.is_blank), "blank candidate id")
        .when(F.size(pages) == 0, "no source pages")
        .when(F.exists(pages, lambda p: (p < 1) | (p > n_pages)), "page out of range")
        .when(F.size(F.array_distinct(pages)) < F.size(pages), "duplicate page")
        .when(T.is_blank(F.col("reason")), "no reason")
        .when(~N.in_range(F.col("confidence"), 0, 1), "invalid confidence")
        .when((F.lower("status") == "unanswered") & ~(T.is_blank(F.col("canonical_candidate_id")) & T.is_blank(F.col("merged_answer_markdown"))), "unanswered with answer")
    )
    own = plan.select("copy_id", "id", issue.alias("issue")).where("issue is not null")
    used = plan.select("copy_id", F.explode("candidate_ids").alias("id")).groupBy("copy_id", "id").agg(F.count("*").alias("n"))
    both = used.join(rows.select("copy_id", F.col("candidate_id").alias("id")).distinct().withColumn("known", F.lit(True)), ["copy_id", "id"], "full")
    assigned = F.when(F.col("known").isNull(), "unknown candidate").when(F.col("n").isNull(), "missing candidate").when(F.col("n") > 1, "duplicated candidate")
    return own.unionByName(both.select("copy_id", "id", assigned.alias("issue")).where("issue is not null"))


def finish_issue(reason: Column) -> Column:
    """Error of a model's finish reason; null for none or a stop."""
    low = F.upper(T.trim_ws(T.or_blank(reason)))
    return F.when(low.isin("", "STOP"), F.lit(None).cast("string")).when(low == "MAX_TOKENS", "output limit reached").otherwise(F.concat(F.lit("stopped: "), low))


def merge_warnings(*warnings: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.concat(*warnings), T.trim_ws), lambda w: w != ""))


def global_pages(local: Column, first: Column) -> Column:
    """A chunk's page numbers as the document's."""
    return F.transform(local, lambda p: p + first - 1)


def chunk_page_issues(chunks: DataFrame) -> DataFrame:
    """(copy_id, chunk, issue): chunks whose pages aren't exactly their window. ``chunks``: first, last, pages (local)."""
    size = F.col("last") - F.col("first") + 1
    whole = F.sequence(F.lit(1), size.cast("int"))
    got = F.transform("pages", lambda p: p.cast("int"))
    issue = F.when(F.exists(got, lambda p: (p < 1) | (p > size)), "page out of window").when(F.size(F.array_distinct(got)) < F.size(got), "duplicate page").when(F.size(F.array_except(whole, got)) > 0, "missing page")
    return chunks.select("copy_id", "chunk", issue.alias("issue")).where("issue is not null")


def merge_fallback(parts: DataFrame) -> DataFrame:
    """Sub-chunks joined to their chunk: pages and questions in order; ``complete`` if every page of the chunk is there."""
    rows = parts.groupBy("copy_id", "chunk", "first", "last").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("pages")))).alias("pages"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "questions"))), lambda p: p["questions"])).alias("questions"),
    )
    return rows.withColumn("complete", F.size("pages") == F.col("last") - F.col("first") + 1)


def fallback_questions(pages: DataFrame) -> DataFrame:
    """One question for each page, to be reviewed."""
    number = F.col("number").cast("string")
    return pages.select(
        "copy_id",
        F.concat(F.lit("page-"), number).alias("id"),
        F.concat(F.lit("Page "), number).alias("label"),
        F.lit("").alias("title"),
        T.trim_ws(T.or_blank(F.col("text"))).alias("answer_markdown"),
        F.array("number").alias("source_pages"),
        F.lit("needs review").alias("status"),
    )


def evidence(questions: DataFrame) -> DataFrame:
    """Questions without their answers, as evidence for reconciling."""
    return questions.select("copy_id", "candidate_id", "label", "title", "source_pages", "status", "confidence", F.octet_length(T.or_blank(F.col("answer_markdown"))).alias("answer_bytes"))


def pages_of_questions(questions: DataFrame) -> DataFrame:
    return questions.select("copy_id", F.explode("source_pages").alias("number")).where("number > 0").distinct()


def review_spans(questions: DataFrame) -> DataFrame:
    """(copy_id, id, first, last): page spans of the questions flagged for another analysis."""
    flagged = F.lower("status").isin("needs review", "needs_review") | F.col("dimensions").isNull()
    return questions.where(flagged & (F.size("source_pages") > 0)).select("copy_id", "id", F.array_min("source_pages").alias("first"), F.array_max("source_pages").alias("last"))


def merged_copy_metadata(rows: DataFrame) -> DataFrame:
    return merge_metadata(rows, "copy_id", ["subject", "paper", "candidate"], ["topics"])


def _value_text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, list):
        return "; ".join(t for t in map(_value_text, value) if t)
    if isinstance(value, dict):
        return "; ".join(f"{k}: {t}" for k, t in ((k, _value_text(value[k])) for k in sorted(value)) if t)
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        x = float(value)
        return format(Decimal(repr(x)).normalize(), "f") if x == 0 or 1e-4 <= abs(x) < 1e21 else repr(x)
    return value.strip()


def dimensions_text(value: Column) -> Column:
    """A JSON value of any depth as text: lists joined by ``; ``, objects as ``key: value`` in order of their keys, blanks left out; null if it isn't JSON."""

    def text(value: str | None) -> str | None:
        try:
            return _value_text(json.loads(value)) if value is not None else ""
        except ValueError:
            return None

    def texts(values: pd.Series) -> pd.Series:
        return values.map(text)

    return F.pandas_udf(texts, "string")(value)
