"""What surrounds model calls: prompts, parsed replies with their defaults, retries, and routing of the outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import numbers as N
from docloom.functions import text as T
from docloom.inference import Model, complete
from docloom.operators.filters import metadata_issue, page_kind
from docloom.operators.windows import boundary

SPLIT = """page_kind string, page_kind_confidence double, classification_reason string, ocr_confidence double, ocr_issues array<string>,
printed_questions array<struct<label: string, title: string>>, questions array<struct<boundary: string, boundary_confidence: double,
visible_label: string, label: string, question: string, title: string, answer_markdown: string, answer: string, status: string>>"""


def page_split(replies: DataFrame) -> DataFrame:
    """(copy_id, page_number, kind, kind_confidence, ocr_confidence, ocr_issues, printed_questions, questions, valid) of split replies.

    Fields have aliases and defaults: a block's text is answer_markdown or answer, its label visible_label, label or question,
    else made from the page; blocks without text go. A reply without a JSON object is of kind unknown and not valid.
    """
    p = F.from_json(T.json_object(F.col("reply")), SPLIT)
    number = F.col("page_number").cast("string")

    def block(q: Column, i: Column) -> Column:
        bound = boundary(q["boundary"])
        made = F.when(bound == "continuation", F.concat(F.lit("Page "), number, F.lit(" continuation"))).otherwise(F.concat(F.lit("Page "), number, F.lit(" block "), (i + 1).cast("string")))
        return F.struct(
            T.first_text(q["visible_label"], q["label"], q["question"], made).alias("label"),
            T.trim_ws(T.or_blank(q["title"])).alias("title"),
            T.first_text(q["answer_markdown"], q["answer"]).alias("answer_markdown"),
            bound.alias("boundary"),
            F.coalesce(N.clamp(q["boundary_confidence"], 0.0, 1.0), F.lit(0.0)).alias("boundary_confidence"),
            T.first_text(q["status"], F.lit("detected")).alias("status"),
        )

    blocks = F.filter(F.transform(F.coalesce(p["questions"], F.from_json(F.lit("[]"), "array<struct<boundary: string, boundary_confidence: double, visible_label: string, label: string, question: string, title: string, answer_markdown: string, answer: string, status: string>>")), block), lambda b: b["answer_markdown"] != "")
    return replies.select(
        "copy_id",
        "page_number",
        page_kind(p["page_kind"]).alias("kind"),
        F.coalesce(N.clamp(p["page_kind_confidence"], 0.0, 1.0), F.lit(0.0)).alias("kind_confidence"),
        N.clamp(p["ocr_confidence"], 0.0, 1.0).alias("ocr_confidence"),
        T.strings_distinct(F.coalesce(p["ocr_issues"], F.array().cast("array<string>"))).alias("ocr_issues"),
        p["printed_questions"].alias("printed_questions"),
        blocks.alias("questions"),
        p.isNotNull().alias("valid"),
    )


def needs_retry(splits: DataFrame) -> DataFrame:
    """Pages whose split is asked for once more, and why."""
    empty_paper = (F.col("kind") == "question_paper") & (F.coalesce(F.size("printed_questions"), F.lit(0)) <= 0)
    reason = F.when(~F.col("valid"), "invalid reply").when(empty_paper, "printed questions omitted")
    return splits.select("copy_id", "page_number", reason.alias("reason")).where("reason is not null")


def split_pages(pages: DataFrame, prompt: Column, targets: list[tuple[str, Model]]) -> DataFrame:
    """Splits of pages, with one focused retry for those that need it; the retry's result stands if it is valid."""
    keyed = pages.withColumn("key", F.concat_ws("#", "copy_id", "page_number")).withColumn("prompt", prompt)
    back = lambda r: r.join(keyed.select("key", "copy_id", "page_number"), "key")
    first = page_split(back(complete(keyed, "key", "prompt", targets)))
    again = keyed.join(needs_retry(first), ["copy_id", "page_number"]).withColumn("prompt", F.concat("prompt", F.lit("\n\nRetry: "), "reason"))
    second = page_split(back(complete(again, "key", "prompt", targets))).where("valid")
    return first.join(second.select("copy_id", "page_number"), ["copy_id", "page_number"], "left_anti").unionByName(second)


def parsed_metadata(replies: DataFrame) -> DataFrame:
    """(id, title, summary_keywords, recall_questions, issue) of metadata replies: at most three prompts, cleaned and checked."""
    m = F.from_json(T.json_object(F.col("reply")), "title string, summary_keywords string, recall_questions array<string>")
    clean = lambda c: T.trim_ws(F.regexp_replace(F.regexp_replace(T.trim_ws(T.or_blank(c)), "^`+|`+$", ""), T.SPACES, " "))
    asked = F.slice(F.filter(F.transform(F.coalesce(m["recall_questions"], F.array().cast("array<string>")), clean), lambda q: q != ""), 1, 3)
    title, keywords = clean(m["title"]), clean(m["summary_keywords"])
    issue = F.when(m.isNull(), "no JSON").when(title == "", "no title").when(keywords == "", "no keywords").when(F.size(asked) == 0, "no questions").otherwise(metadata_issue(title, keywords, asked))
    return replies.select("id", title.alias("title"), keywords.alias("summary_keywords"), asked.alias("recall_questions"), issue.alias("issue"))


def dimension_prompts(questions: DataFrame, header: str) -> DataFrame:
    """(copy_id, id, prompt) of the questions to analyse: those with an answer that don't need review."""
    fine = questions.where(~T.is_blank(F.col("answer_markdown")) & ~F.lower("status").isin("needs review", "needs_review", "unanswered"))
    return fine.select("copy_id", "id", F.concat(F.lit(header + "\n\nQUESTION: "), F.col("title"), F.lit("\n\nANSWER:\n"), T.trim_ws(F.col("answer_markdown"))).alias("prompt"))


def with_dimensions(questions: DataFrame, replies: DataFrame, schema: str) -> DataFrame:
    """Questions with the dimensions of valid replies; others keep what they had."""
    got = replies.select("copy_id", "id", F.from_json(T.json_object(F.col("reply")), schema).alias("_new"))
    return questions.join(got, ["copy_id", "id"], "left").withColumn("dimensions", F.coalesce("_new", "dimensions")).drop("_new")


def merge_prompts(sources: DataFrame, ranked: DataFrame, notes: DataFrame, total_chars: int = 60_000, floor: int = 2_500) -> DataFrame:
    """(query, prompt): a source note and its ranked candidates, each cut to its share of the budget but no less than the floor."""
    n = ranked.groupBy("query").agg(F.count("*").alias("n"))
    each = ranked.join(n, "query").join(notes.select("path", "content"), "path")
    limit = F.greatest(F.lit(floor), F.floor(F.lit(total_chars) / F.col("n"))).cast("int")
    part = F.concat(F.format_string("%d. %s\n", F.col("rank"), F.col("path")), F.left(T.trim_ws(F.col("content")), limit))
    parts = each.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("parts"))
    text = F.array_join(F.transform(F.coalesce("parts", F.array().cast("array<struct<rank: long, part: string>>")), lambda p: p["part"]), "\n\n")
    return sources.select(F.col("path").alias("query"), "content").join(parts, "query", "left").select("query", F.concat(F.lit("SOURCE NOTE:\n"), T.trim_ws(F.col("content")), F.lit("\n\nSEMANTIC DESTINATION CANDIDATES:\n"), text).alias("prompt"))


def routed_runs(runs: DataFrame) -> DataFrame:
    """(status, runs): inbox results as processed, pending (partial too) or failed."""
    to = F.when(F.col("status") == "processed", "processed").when(F.col("status").isin("partial", "pending"), "pending").otherwise("failed")
    return runs.groupBy(to.alias("status")).agg(F.count("*").alias("runs"))


def metadata_payload(copy: Column, questions: Column, quality: Column) -> Column:
    """The wrapped form of a copy's metadata."""
    return F.to_json(F.struct(copy.alias("copy"), questions.alias("questions"), quality.alias("analysis_quality")))


def payload_copy(value: Column, schema: str) -> Column:
    """A copy's metadata from the wrapped form, else from the bare one."""
    return F.coalesce(F.from_json(value, f"copy struct<{schema}>")["copy"], F.from_json(value, schema))


def batch_size(kind: Column, asked: Column) -> Column:
    """Pages a call may take: 1 for local models, 5 by default for one hosted kind, and 10 at most."""
    default = F.when(kind == "local", 1).when(kind == "gemini", 5).otherwise(10)
    return F.when(kind == "local", 1).otherwise(F.least(F.lit(10), F.when(F.coalesce(asked, F.lit(0)) > 0, asked).otherwise(default))).cast("long")


def readable(items: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(readable course items, (source, message) of the others); with ``strict`` an unreadable one raises."""
    bad = F.col("error").isNotNull() & (F.col("error") != "")
    messages = items.where(bad).select("source", F.concat("source", F.lit(": "), "error").alias("message"))
    if strict and not messages.isEmpty():
        raise ValueError(messages.first().message)
    return items.where(~bad), messages


def transcribed(log: DataFrame, files: DataFrame) -> DataFrame:
    """(source): files whose name a log line says is transcribed."""
    named = log.select(T.base_name(F.regexp_extract("line", r"(?i)transcribed:?\s+(.+?)\s*$", 1)).alias("name")).where("name <> ''").distinct()
    return files.withColumn("name", T.base_name(F.col("source"))).join(named, "name", "left_semi").select("source")


def units_done(items: DataFrame, done: DataFrame, course: str = "course") -> DataFrame:
    """(course, units): whole seconds of the items that are done."""
    fine = items.join(done.select("source").distinct(), "source", "left_semi")
    return fine.groupBy(course).agg(F.sum(F.greatest(F.lit(1), F.ceil(F.coalesce("duration_s", F.lit(0.0))))).cast("long").alias("units"))


def observed_questions(questions: DataFrame) -> DataFrame:
    """(case_id, run, observed_questions): a run's questions as a benchmark compares them, in order."""
    q = F.struct("pos", "label", "source_pages", "boundary", "boundary_confidence", "status")
    return questions.groupBy("case_id", "run").agg(F.array_sort(F.collect_list(q)).alias("observed_questions"))


def upload_names(uploads: DataFrame) -> DataFrame:
    """Uploads with a safe name that is unique in their folder: ``name-n.ext`` for the n-th of a name."""
    from docloom.operators.windows import unique_suffix

    safe = T.sanitize_name(T.base_name(F.col("name")))
    parts = uploads.withColumn("stem", F.regexp_replace(safe, r"\.[^.]*$", "")).withColumn("ending", F.regexp_extract(safe, r"(\.[^.]*)$", 1))
    keyed = parts.withColumn("_key", F.concat("stem", "ending"))
    out = unique_suffix(keyed, "_key", ["folder"], F.col("pos"))
    n = F.regexp_extract("unique_id", r"-(\d+)$", 1)
    own = F.col("unique_id") == F.col("_key")
    return out.withColumn("saved_as", F.when(own, F.col("_key")).otherwise(F.concat("stem", F.lit("-"), n, "ending"))).drop("stem", "ending", "_key", "unique_id")
