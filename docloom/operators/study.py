"""Study copies and reviews: sync, patches, checkpoints, reshaping, settings and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T

#: The text dimensions that become rows, fixed list in order.
DIMENSIONS = ["introduction", "body", "conclusion", "structure", "content", "presentation", "value_addition"]


def unpivot_dimensions(questions: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """(ids, dimension_key, text): a row for each dimension that isn't blank."""
    rows = questions.unpivot(ids, columns, "dimension_key", "text")
    return rows.where(~T.is_blank(F.col("text"))).withColumn("text", T.trim_ws(F.col("text")))


def review_pages(reviews: DataFrame) -> DataFrame:
    """Page rows of reviews (copy_id, pages: array<struct<...>>), in order."""
    return reviews.select("copy_id", F.posexplode("pages").alias("pos", "p")).select("copy_id", "pos", "p.*")


def review_questions(reviews: DataFrame) -> DataFrame:
    return reviews.select("copy_id", F.posexplode("questions").alias("pos", "q")).select("copy_id", "pos", "q.*")


def nested_copies(copies: DataFrame, pages: DataFrame, questions: DataFrame) -> DataFrame:
    """Copies with their pages and questions as ordered arrays; empty ones where there are none."""
    page = F.struct("page_number", "text")
    asked = F.struct("pos", "label", "title")
    p = pages.groupBy("copy_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    q = questions.groupBy("copy_id").agg(F.array_sort(F.collect_list(asked)).alias("questions"))
    out = copies.join(p, "copy_id", "left").join(q, "copy_id", "left")
    return out.withColumn("pages", F.coalesce("pages", F.array().cast("array<struct<page_number: long, text: string>>"))).withColumn(
        "questions", F.coalesce("questions", F.array().cast("array<struct<pos: long, label: string, title: string>>"))
    )


def chips(labels: Column, most: int) -> Column:
    """An ordered list of distinct labels that aren't blank, at most so many."""
    return F.slice(T.strings_distinct_ci(labels), 1, most)


def should_sync(copy_pages: Column, copy_questions: Column, copy_status: Column, copy_updated: Column, pages: Column, questions: Column, status: Column, updated: Column) -> Column:
    """Whether a copy takes over its review: it lacks pages or questions, was only imported, or is older."""
    low = lambda c: F.lower(T.or_blank(c))
    return ((copy_pages == 0) & (pages > 0)) | ((copy_questions == 0) & (questions > 0)) | ((low(copy_status) == "imported") & (low(status) != "imported")) | F.coalesce(updated > copy_updated, F.lit(False))


def sync_name(current: Column, raw_file: Column, suggested: Column) -> Column:
    """A suggested name replaces a blank or raw file name only."""
    raw = T.base_name(raw_file)
    replace = T.is_blank(current) | (F.lower(T.trim_ws(current)) == F.lower(raw))
    return F.when(replace, T.first_text(suggested, current, raw)).otherwise(T.trim_ws(current))


def patch(rows: DataFrame, patches: DataFrame, key: str, texts: list[str], numbers: list[str]) -> DataFrame:
    """Rows with a patch's fields where they aren't blank or zero."""
    few = patches.select(key, *[F.col(c).alias(f"_{c}") for c in [*texts, *numbers]])
    out = rows.join(few, key, "left")
    for c in texts:
        out = out.withColumn(c, F.when(~T.is_blank(F.col(f"_{c}")), T.trim_ws(F.col(f"_{c}"))).otherwise(F.col(c)))
    for c in numbers:
        out = out.withColumn(c, F.when(F.coalesce(F.col(f"_{c}"), F.lit(0)) != 0, F.col(f"_{c}")).otherwise(F.col(c)))
    return out.select(rows.columns)


def prepare_batch(asked: DataFrame, copies: DataFrame, batch_id: str) -> tuple[DataFrame, DataFrame]:
    """(queued items, one for each distinct copy that exists; ids that don't)."""
    ids = asked.select("copy_id").distinct()
    items = ids.join(copies.select("copy_id"), "copy_id", "left_semi")
    return items.select(F.lit(batch_id).alias("batch_id"), "copy_id", F.lit("queued").alias("status")), ids.join(copies, "copy_id", "left_anti")


def usable_checkpoints(copies: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Copies with ``usable``: a checkpoint of status ocr_ready or needs_review, the same source and pages."""
    fine = checkpoints.where(F.col("status").isin("ocr_ready", "needs_review") & (F.size("pages") > 0))
    keys = fine.select("copy_id", "source_path").distinct().withColumn("usable", F.lit(True))
    return copies.join(keys, ["copy_id", "source_path"], "left").withColumn("usable", F.coalesce("usable", F.lit(False)))


def metadata_complete(questions: DataFrame, scope: str = "copy_id") -> DataFrame:
    """(scope, complete, any_text): whether every question has metadata, and any has text."""
    return questions.groupBy(scope).agg(F.bool_and(~T.is_blank(F.col("metadata_json"))).alias("complete"), F.bool_or(~T.is_blank(F.col("text"))).alias("any_text"))


def clean_metadata(texts: dict[str, Column], lists: dict[str, Column], numbers: dict[str, Column]) -> Column:
    """A metadata struct of trimmed texts, distinct lists and numbers of at least 0; null if all are empty."""
    fields = [T.trim_ws(T.or_blank(c)).alias(k) for k, c in texts.items()]
    fields += [F.coalesce(T.strings_distinct_ci(c), F.array().cast("array<string>")).alias(k) for k, c in lists.items()]
    fields += [F.greatest(F.lit(0), F.coalesce(c, F.lit(0))).alias(k) for k, c in numbers.items()]
    filled = F.lit(False)
    for c in texts.values():
        filled = filled | ~T.is_blank(c)
    for c in lists.values():
        filled = filled | F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda x: ~T.is_blank(x))
    for c in numbers.values():
        filled = filled | (F.coalesce(c, F.lit(0)) > 0)
    return F.when(filled, F.struct(*fields))


def review_record(reviews: DataFrame) -> DataFrame:
    """Archive rows: counts and search text derived from reviews (review_id, name, metadata, pages, questions, report)."""
    text = F.lower(F.concat_ws("\n", "name", "metadata", F.array_join(F.transform("pages", lambda p: p["text"]), "\n"), F.array_join(F.transform("questions", lambda q: F.concat_ws(" ", q["label"], q["title"])), "\n"), "report"))
    return reviews.select("review_id", "name", F.size("pages").alias("page_count"), F.size("questions").alias("question_count"), text.alias("search_text"))


def jobs_to_reviews(jobs: DataFrame) -> DataFrame:
    """Review rows from the JSON output of finished jobs of kind analyze or ocr; jobs without pages give none."""
    shape = "review struct<pdf_name: string, source_path: string, pages: array<struct<number: bigint, text: string>>>, pages array<struct<number: bigint, text: string>>, source_path string"
    out = jobs.where("status = 'completed'").withColumn("o", F.from_json("output_json", shape))
    pages = F.coalesce("o.review.pages", "o.pages")
    rows = out.where(F.col("kind").isin("analyze", "ocr")).select(
        F.concat(F.lit("job-"), F.col("id").cast("string")).alias("review_id"),
        T.first_text(F.col("o.review.pdf_name"), T.base_name(F.coalesce("o.review.source_path", "o.source_path"))).alias("pdf_name"),
        F.when(F.col("kind") == "ocr", "ocr-only").otherwise("ready").alias("status"),
        pages.alias("pages"),
    )
    return rows.where(F.size("pages") > 0)


def merged_settings(defaults: DataFrame, own: DataFrame, key: str = "id") -> DataFrame:
    """Stored settings with blanks filled from the defaults of the same id, and the defaults that aren't stored."""
    rest = [c for c in defaults.columns if c != key]
    base = defaults.select(key, *[F.col(c).alias(f"_{c}") for c in rest])
    both = own.join(base, key, "full")
    kinds = dict(defaults.dtypes)
    pick = lambda c: F.coalesce(F.when(~T.is_blank(F.col(c)), F.col(c)), F.col(f"_{c}")) if kinds[c] == "string" else F.coalesce(F.col(c), F.col(f"_{c}"))
    return both.select(key, *[pick(c).alias(c) for c in rest])


def masked(rows: DataFrame, secrets: list[str]) -> DataFrame:
    return rows.withColumns({c: F.lit("") for c in secrets})


def restored(rows: DataFrame, stored: DataFrame, secrets: list[str], key: str = "id") -> DataFrame:
    """Rows whose blank secrets come back from the stored rows."""
    kept = stored.select(key, *[F.col(c).alias(f"_{c}") for c in secrets])
    out = rows.join(kept, key, "left")
    return out.withColumns({c: F.when(T.is_blank(F.col(c)), T.or_blank(F.col(f"_{c}"))).otherwise(F.col(c)) for c in secrets}).select(rows.columns)


def profile_issues(profiles: DataFrame, providers: DataFrame) -> DataFrame:
    """(id, issue): profiles with a repeated id, unknown capability, strategy or provider, or negative limits."""
    known = providers.select(F.col("id").alias("provider_id")).distinct().withColumn("known", F.lit(True))
    repeated = profiles.groupBy("id").agg(F.count("*").alias("n"))
    both = profiles.join(known, "provider_id", "left").join(repeated, "id")
    issue = (
        F.when(F.col("n") > 1, "duplicate id")
        .when(~F.col("capability").isin("chat", "vision", "embedding", "rerank"), "unknown capability")
        .when(~F.col("strategy").isin("priority", "round_robin"), "unknown strategy")
        .when(F.col("known").isNull(), "unknown provider")
        .when(F.least("requests_per_minute", "tokens_per_minute", "requests_per_day") < 0, "negative limit")
    )
    return both.select("id", issue.alias("issue")).where("issue is not null").distinct()


def routed(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """Requests with ``issue``: profile missing, disabled, or of another capability; null if it can run."""
    p = profiles.select(F.col("id").alias("profile_id"), "enabled", F.col("capability").alias("offers"))
    issue = F.when(F.col("offers").isNull(), "missing").when(~F.col("enabled"), "disabled").when(F.col("offers") != F.col("capability"), "capability mismatch")
    return requests.join(p, "profile_id", "left").withColumn("issue", issue).drop("enabled", "offers")


def finished_jobs(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Jobs after their outcome: success has progress 1 and full units; an error of cancelling is cancelled, else failed."""
    out = jobs.join(outcomes.select("id", F.col("error").alias("_error"), F.lit(True).alias("_over")), "id", "left")
    fine, gone = F.col("_over") & T.is_blank(F.col("_error")), F.lower(T.or_blank(F.col("_error"))).contains("cancel")
    status = F.when(F.col("_over").isNull(), F.col("status")).when(fine, "completed").when(gone, "cancelled").otherwise("failed")
    return out.withColumns({
        "status": status,
        "progress": F.when(fine, F.lit(1.0)).otherwise(F.col("progress")),
        "units_done": F.when(fine, F.col("units_total")).otherwise(F.col("units_done")),
        "error": F.coalesce("_error", "error"),
    }).drop("_error", "_over")


def latest_state(progress: DataFrame, key: str = "job_id", at: str = "ts") -> DataFrame:
    rest = [c for c in progress.columns if c != key]
    return progress.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(at)).alias("b")).select(key, "b.*")


def course_parts(packed: DataFrame) -> DataFrame:
    """(course, part, items, name): artifact names of packed course items."""
    parts = packed.groupBy("course", "part").agg(F.count("*").alias("items"), F.sum("duration_s").alias("seconds"))
    return parts.withColumn("name", F.format_string("%s_part_%02d", F.col("course"), F.col("part") + 1))


def partition_ready(items: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Course items with ``ready``: whether their transcript is there."""
    have = transcripts.select("source").distinct().withColumn("ready", F.lit(True))
    return items.join(have, "source", "left").withColumn("ready", F.coalesce("ready", F.lit(False)))


def complete_parts(artifacts: DataFrame) -> DataFrame:
    """(course, part, complete): whether a part's three artifacts exist and aren't empty."""
    return artifacts.groupBy("course", "part").agg(((F.count_distinct("kind") >= 3) & F.bool_and(F.col("size") > 0)).alias("complete"))


def course_transcript(segments: DataFrame) -> DataFrame:
    """(course, text): transcripts in order, each under its header."""
    part = F.concat(F.lit("## "), F.col("name"), F.lit("\n\n"), T.trim_ws(F.col("text")))
    parts = F.array_sort(F.collect_list(F.struct("pos", part.alias("part"))))
    return segments.where(~T.is_blank(F.col("text"))).groupBy("course").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n").alias("text"))
