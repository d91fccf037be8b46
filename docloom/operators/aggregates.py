"""Counts, rates, coverage and merged fields over jobs, pages, questions and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import numbers as N
from docloom.functions import text as T
from docloom.operators.filters import page_kind
from docloom.operators.windows import before_each, boundary


def totals(copies: DataFrame) -> DataFrame:
    """(copies, pages, questions) of a study table."""
    return copies.agg(F.count("*").alias("copies"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"), F.coalesce(F.sum("question_count"), F.lit(0)).alias("questions"))


def unclear_total(pages: DataFrame, scope: list[str]) -> DataFrame:
    return pages.groupBy(*scope).agg(F.sum(F.greatest(F.lit(0), "unclear_count")).alias("unclear"))


def reason_histogram(rows: DataFrame, reason: str = "reason") -> DataFrame:
    """(reason, rows) of the rows that were skipped."""
    return rows.where(F.col(reason) != "").groupBy(reason).agg(F.count("*").alias("rows"))


def mode(rows: DataFrame, value: str, scope: list[str]) -> DataFrame:
    """The most common value of each scope, the smallest on a tie, and its count."""
    counts = rows.groupBy(*scope, value).agg(F.count("*").alias("n"))
    best = F.min_by(F.struct(F.col(value).alias("value"), "n"), F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias("b")
    return counts.groupBy(*scope).agg(best).select(*scope, "b.value", "b.n")


def exact_percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, names of ``shares``): interpolated percentiles of ``value``, as ``percentile`` has them, with no key's values in one buffer.

    Equal values are counted first; their running counts, range by range, tell which values stand at the ranks wanted. A key
    with most of the rows is so spread over tasks, and what is held doesn't grow with it. Nulls are left out; a key of nulls
    alone has null percentiles.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = before_each(counts, keys, ["_v"], _low=F.col("_n"))
    every = rows.groupBy(*keys).agg(F.count(value).alias("_all"))
    spots = F.array(*[F.struct(F.lit(name).alias("name"), F.floor((F.col("_all") - 1) * q).alias("low"), F.ceil((F.col("_all") - 1) * q).alias("high"), ((F.col("_all") - 1) * q).alias("at")) for name, q in shares.items()])
    named = every.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.explode(spots).alias("s"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    inside = lambda rank: (F.col("_low") <= rank) & (rank < F.col("_low") + F.col("_n"))
    met = placed.join(named if keys else F.broadcast(named), same & (inside(F.col("s.low")) | inside(F.col("s.high"))))
    low, high = F.max(F.when(inside(F.col("s.low")), F.col("_v"))), F.max(F.when(inside(F.col("s.high")), F.col("_v")))
    found = met.groupBy(*keys, "s.name", "s.low", "s.high", "s.at").agg(low.alias("_a"), high.alias("_b"))
    mixed = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((F.col("high") - F.col("at")) * F.col("_a") + (F.col("at") - F.col("low")) * F.col("_b"))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, mixed)).alias(name) for name in shares])
    if not keys:
        return wide
    out = every.select(*[F.col(k).alias(f"_of_{k}") for k in keys]).join(wide, same, "left")
    return out.select(*[F.col(f"_of_{k}").alias(k) for k in keys], *shares)


def benchmark_summary(runs: DataFrame, cases: DataFrame, runs_per_case: int) -> DataFrame:
    """One row of a boundary benchmark: counts, rates (null without a denominator), stable cases and latencies.

    Schema validity is over successful requests, exact grouping over attempts, stability over cases; latencies count every
    run, failed ones too. A case is stable if all its runs are valid and agree.
    """
    valid = F.col("schema_valid")
    some = lambda c: F.coalesce(F.sum(F.when(valid, F.col(c))), F.lit(0))
    one = runs.agg(
        F.count("*").alias("attempted_runs"),
        F.count_if("request_succeeded").alias("successful_requests"),
        F.count_if(valid).alias("schema_valid_runs"),
        F.count_if(valid & F.col("grouping_exact")).alias("exact_grouping_runs"),
        *[some(c).alias(c) for c in ("label_matches", "label_checks", "status_matches", "status_checks")],
        F.avg("latency_ms").alias("mean_latency_ms"),
    )
    one = one.crossJoin(exact_percentiles(runs, [], "latency_ms", {"median_latency_ms": 0.5, "p95_latency_ms": 0.95}))  # one row each
    per_case = runs.where(valid).groupBy("case_id").agg(F.count("*").alias("n"), F.count_distinct(F.xxhash64(F.to_json("observed_questions")), F.to_json("observed_questions")).alias("outputs"))
    stable = cases.select("case_id").distinct().join(per_case, "case_id", "left").agg(
        F.count_if((F.col("n") == runs_per_case) & (F.col("outputs") == 1)).alias("stable_cases"), F.count("*").alias("cases")
    )
    out = one.crossJoin(stable)  # one row each
    rates = {
        "request_success_rate": ("successful_requests", "attempted_runs"),
        "schema_valid_rate": ("schema_valid_runs", "successful_requests"),
        "exact_grouping_rate": ("exact_grouping_runs", "attempted_runs"),
        "label_accuracy": ("label_matches", "label_checks"),
        "status_accuracy": ("status_matches", "status_checks"),
        "stability_rate": ("stable_cases", "cases"),
    }
    return out.withColumns({k: N.rate(F.col(a), F.col(b)) for k, (a, b) in rates.items()})


def stability(runs: DataFrame, case: str, output: str, valid: Column) -> DataFrame:
    """(case, runs, outputs, stable): whether all runs of a case are valid and gave one output."""
    some = runs.groupBy(case).agg(F.count("*").alias("runs"), F.count_if(valid).alias("valid_runs"), F.count_distinct(F.when(valid, F.col(output))).alias("outputs"))
    return some.select(case, "runs", "outputs", ((F.col("runs") == F.col("valid_runs")) & (F.col("outputs") == 1)).alias("stable"))


def page_quality(pages: DataFrame, scope: str = "copy_id") -> DataFrame:
    """Classification and OCR figures of each copy's pages, and the numbers of the pages to review.

    A page without an OCR confidence always needs review, and so does one with an issue or below 0.7; the least
    confidence starts at 1.
    """
    classified = page_kind(F.col("kind")) != "unknown"
    issue = F.coalesce(F.exists("ocr_issues", lambda x: ~T.is_blank(x)), F.lit(False))
    sure = N.clamp(F.col("ocr_confidence"), 0.0, 1.0)
    review = F.col("ocr_confidence").isNull() | issue | F.coalesce(sure < 0.7, F.lit(False))
    return pages.groupBy(scope).agg(
        F.count("*").alias("pages"),
        F.count_if(classified).alias("classified_pages"),
        F.coalesce(F.sum(F.when(classified, N.clamp(F.col("kind_confidence"), 0.0, 1.0))), F.lit(0.0)).alias("classification_confidence"),
        F.sum(F.greatest(F.lit(0), "unclear_count")).alias("unclear_count"),
        F.sum(T.word_count(F.col("text"))).alias("word_count"),
        F.count(sure).alias("ocr_assessed_pages"),
        F.coalesce(F.sum(sure), F.lit(0.0)).alias("ocr_confidence"),
        F.least(F.lit(1.0), F.min(sure)).alias("minimum_ocr_confidence"),
        F.array_sort(F.collect_list(F.when(review, F.col("number")))).alias("ocr_review_pages"),
    )


def evidence_backed(points: Column) -> Column:
    """Whether at least 75 % of the points carry evidence; no points are not enough."""
    with_evidence = F.filter(points, lambda p: ~T.is_blank(p["evidence"]))
    return F.coalesce((F.size(points) > 0) & (F.size(with_evidence) * 100 >= F.size(points) * 75), F.lit(False))


def analysis_quality(pages: DataFrame, questions: DataFrame, scope: str = "copy_id") -> DataFrame:
    """Coverage percentages, a weighted score and warnings of each copy.

    ``questions``: scope, title, status, boundary, boundary_confidence, dimensions: struct<strengths, gaps> of points with
    evidence, or null. Unanswered questions leave the denominators of analysis and evidence, which are 100 without any.
    """
    answered = F.lower(T.trim_ws(T.or_blank(F.col("status")))) != "unanswered"
    analysed = answered & F.col("dimensions").isNotNull()
    points = F.concat(F.coalesce("dimensions.strengths", F.expr("array()")), F.coalesce("dimensions.gaps", F.expr("array()")))
    bounded = ~T.is_blank(F.col("boundary"))
    doubt = F.lower(T.trim_ws(T.or_blank(F.col("status")))).isin("needs review", "needs_review") | (bounded & ((boundary(F.col("boundary")) == "uncertain") | (F.col("boundary_confidence") < 0.7)))
    q = questions.groupBy(scope).agg(
        F.count("*").alias("questions"),
        F.count_if(~T.is_blank(F.col("title"))).alias("prompted"),
        F.count_if(answered).alias("answered"),
        F.count_if(analysed).alias("analysed"),
        F.count_if(analysed & evidence_backed(points)).alias("backed"),
        F.count_if(doubt).alias("doubtful"),
    )
    both = page_quality(pages, scope).join(q, scope, "full").na.fill(0)
    mean = lambda total, n: F.when(F.col(n) > 0, N.round_to(F.col(total) / F.col(n), 2)).otherwise(0.0)
    covered = lambda a: F.when(F.col("answered") == 0, F.lit(100)).otherwise(N.percent(F.col(a), F.col("answered"))).cast("long")
    both = both.withColumns({
        "ocr_coverage": N.percent(F.col("ocr_assessed_pages"), F.col("pages")),
        "ocr_average": mean("ocr_confidence", "ocr_assessed_pages"),
        "ocr_minimum": F.when(F.col("ocr_assessed_pages") > 0, N.round_to(F.col("minimum_ocr_confidence"), 2)).otherwise(0.0),
        "classified": N.percent(F.col("classified_pages"), F.col("pages")),
        "classification_average": mean("classification_confidence", "classified_pages"),
        "prompt_match": N.percent(F.col("prompted"), F.col("questions")),
        "analysis_coverage": covered("analysed"),
        "evidence_coverage": covered("backed"),
        "unclear_percent": N.round_to(F.col("unclear_count") * 100.0 / F.greatest(F.lit(1), "word_count"), 2),
    })
    weighted = F.round(F.col("classified") * F.col("classification_average")) * 10 + F.round(F.col("ocr_coverage") * F.col("ocr_average")) * 10
    weighted = weighted + F.col("prompt_match") * 25 + F.col("analysis_coverage") * 30 + F.col("evidence_coverage") * 25
    asked, paged = F.col("questions") > 0, F.col("pages") > 0
    warned = [
        (~paged, "no pages"),
        (paged & (F.col("classified") < 90), "pages unclassified"),
        (paged & (F.col("classified") >= 90) & (F.col("classification_average") < 0.7), "classification unsure"),
        (paged & (F.col("ocr_coverage") < 90), "ocr unassessed"),
        (F.size("ocr_review_pages") > 0, "ocr pages to review"),
        (~asked, "no answers"),
        (asked & (F.col("prompt_match") < 80), "prompts unmatched"),
        (asked & (F.col("analysis_coverage") < 90), "analysis missing"),
        (asked & (F.col("evidence_coverage") < 80), "evidence thin"),
        (asked & (F.col("unclear_percent") > 2), "ocr unclear"),
        (F.col("doubtful") > 0, "boundaries uncertain"),
    ]
    warnings = F.filter(F.array(*[F.when(c, F.lit(w)) for c, w in warned]), lambda w: w.isNotNull())
    return both.select(
        scope, "ocr_coverage", "ocr_average", "ocr_minimum", "classified", "classification_average", "prompt_match", "analysis_coverage", "evidence_coverage", "unclear_percent",
        F.greatest(F.lit(0), F.least(F.lit(100), F.round(weighted / 100))).cast("long").alias("overall"),
        F.coalesce("ocr_review_pages", F.expr("array()").cast("array<long>")).alias("ocr_review_pages"),
        warnings.alias("warnings"),
        (F.size(warnings) > 0).alias("requires_review"),
    )


def coverage_ok(extracted: Column, detected: Column) -> Column:
    """Whether enough was extracted: 70 % of what was detected, or less than two detected."""
    return (detected < 2) | (extracted * 100 >= detected * 70)


def inventory_issues(groups: DataFrame, declared: DataFrame, scope: str = "plan_id") -> DataFrame:
    """Plans whose answered, unanswered or total groups differ from the declared numbers."""
    found = groups.groupBy(scope).agg(F.count_if(F.col("status") == "answered").alias("a"), F.count_if(F.col("status") == "unanswered").alias("u"), F.count("*").alias("n"))
    both = declared.join(found, scope, "left").na.fill(0, ["a", "u", "n"])
    return both.where("a <> answered or u <> unanswered or n <> visible_question_slots").select(scope, "a", "u", "n")


def batch_outcome(items: DataFrame, scope: str = "batch_id") -> DataFrame:
    """Each batch's counts and status: completed, failed or partial_failed, running while items are open, and its duration."""
    n = items.groupBy(scope).agg(
        F.count("*").alias("items"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.min("started_at").alias("started_at"),
        F.max("finished_at").alias("finished_at"),
    )
    status = (
        F.when(F.col("completed") + F.col("failed") < F.col("items"), "running").when(F.col("failed") == 0, "completed").when(F.col("completed") == 0, "failed").otherwise("partial_failed")
    )
    seconds = (N.micros(F.col("finished_at")) - N.micros(F.col("started_at"))) / 1e6
    return n.select(scope, "items", "completed", "failed", status.alias("status"), seconds.alias("seconds"))


def run_status(processed: Column, pending: Column, failed: Column) -> Column:
    return F.when((failed == 0) & (pending == 0), "completed").when((processed > 0), "partial").when(pending > 0, "pending").otherwise("failed")


def api_calls(calls: DataFrame, key: str) -> DataFrame:
    """Calls and errors of each provider and, in the row whose key is null, of all."""
    return calls.rollup(key).agg(F.count("*").alias("calls"), F.count_if("failed").alias("errors"))


def token_usage(rows: DataFrame, scope: list[str], usage: str = "usage") -> DataFrame:
    """Sums of the token fields; a missing usage counts as zero."""
    fields = ["input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens"]
    return rows.groupBy(*scope).agg(*[F.coalesce(F.sum(f"{usage}.{f}"), F.lit(0)).alias(f) for f in fields])


def merge_metadata(rows: DataFrame, scope: str, texts: list[str], lists: list[str], pos: str = "pos") -> DataFrame:
    """The first non-blank of each text field by position, and the union of each list field in order."""
    first = [F.coalesce(F.min_by(F.when(~T.is_blank(F.col(c)), T.trim_ws(F.col(c))), F.when(~T.is_blank(F.col(c)), F.col(pos))), F.lit("")).alias(c) for c in texts]

    def union(c: str) -> Column:
        parts = F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct(pos, c))))
        return F.array_distinct(F.flatten(F.transform(parts, lambda s: s[c]))).alias(c)

    joined = [union(c) for c in lists]
    return rows.groupBy(scope).agg(*first, *joined)


def canonical(rows: DataFrame, scope: list[str], score: str, pos: str = "pos") -> DataFrame:
    """The row of the highest score of each scope, the first on a tie."""
    rest = [c for c in rows.columns if c not in scope]
    best = rows.groupBy(*scope).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), (-F.col(pos)).alias("p"))).alias("b"))
    return best.select(*scope, "b.*").select(rows.columns)


def report(questions: DataFrame, scope: str = "copy_id") -> DataFrame:
    """(scope, report): a markdown section for each question, in order."""
    part = F.concat(F.lit("## "), F.col("label"), F.when(T.is_blank(F.col("title")), "").otherwise(F.concat(F.lit(". "), F.col("title"))), F.lit("\n\n"), T.trim_ws(F.col("answer_markdown")))
    parts = F.array_sort(F.collect_list(F.struct("pos", part.alias("part"))))
    return questions.groupBy(scope).agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n").alias("report"))


def ledger_status(claims: DataFrame, scope: str = "run_id") -> DataFrame:
    """(scope, merged, deduped, pending): distinct claims by their first accounted status, and pending rows."""
    accounted = claims.where(F.col("status").isin("merged", "deduped")).groupBy(scope, "claim_id").agg(F.min_by("status", "pos").alias("status"))
    done = accounted.groupBy(scope).agg(F.count_if(F.col("status") == "merged").alias("merged"), F.count_if(F.col("status") == "deduped").alias("deduped"))
    open_ = claims.groupBy(scope).agg(F.count_if(F.col("status") == "pending").alias("pending"))
    return open_.join(done, scope, "left").na.fill(0)


def most_memory(devices: Column) -> Column:
    """The largest memory of an array of devices; 0 for none."""
    return F.coalesce(F.array_max(F.transform(devices, lambda d: d["memory_mb"])), F.lit(0))
