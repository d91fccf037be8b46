"""Filters, search and projections over job, review and page tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T

FINISHED = ("completed", "failed", "cancelled")


def by_status(rows: DataFrame, status: str, column: str = "status") -> DataFrame:
    """Blank, recent and all keep everything, finished the three final states, else equality."""
    wanted = (status or "").strip().lower()
    if wanted in ("", "recent", "all"):
        return rows
    return rows.where(F.col(column).isin(*FINISHED) if wanted == "finished" else F.col(column) == wanted)


def search(rows: DataFrame, query: str, columns: list[str], status: str = "") -> DataFrame:
    """Rows one of whose columns contains the query in lower case, and whose status equals ``status`` if given.

    The query is taken literally: ``%`` and ``_`` are no wildcards.
    """
    needle = (query or "").strip().lower()
    if needle:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.contains(F.lower(T.or_blank(F.col(c))), F.lit(needle))
        rows = rows.where(hit)
    return rows.where(F.col("status") == status) if status else rows


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of a listing with its row number ``rank`` in it; a negative offset is 0. ``order`` must end in a unique column."""
    few = rows.orderBy(*order).offset(max(0, offset)).limit(limit)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def search_text(name: Column, metadata: Column, pages: Column, questions: Column, report: Column) -> Column:
    """Everything a review can be searched by, in lower case, a line each; ``pages`` and ``questions`` are arrays of text."""
    return F.lower(F.concat_ws("\n", name, metadata, F.array_join(pages, "\n"), F.array_join(questions, "\n"), report))


def facets(rows: DataFrame, text_column: str, text: str, equal: dict[str, str]) -> DataFrame:
    """Rows whose text contains ``text`` and whose facets equal the given ones, without regard to case; blanks pass."""
    if text.strip():
        rows = rows.where(F.contains(F.lower(T.or_blank(F.col(text_column))), F.lit(text.strip().lower())))
    for column, value in equal.items():
        if value.strip():
            rows = rows.where(F.lower(T.trim_ws(T.or_blank(F.col(column)))) == value.strip().lower())
    return rows


def facet_values(rows: DataFrame, column: str, order: str) -> DataFrame:
    """(value): distinct values without regard to case; the first spelling by ``order`` stays."""
    value = T.trim_ws(F.col(column))
    base = rows.where(~T.is_blank(F.col(column))).select(value.alias("value"), F.col(order).alias("at"))
    return base.groupBy(F.lower("value").alias("key")).agg(F.min_by("value", "at").alias("value")).select("value")


def answer_pages(pages: DataFrame, with_paper: bool = False) -> DataFrame:
    """Pages that can hold answers: without an OCR failure, of kind answer or unknown (and question_paper, to split)."""
    kinds = ["answer", "unknown"] + ["question_paper"] * with_paper
    return pages.where(~T.ocr_failed(F.col("text")) & page_kind(F.col("kind")).isin(kinds))


def page_kind(kind: Column) -> Column:
    known = F.lower(T.trim_ws(T.or_blank(kind)))
    return F.when(known.isin("answer", "question_paper", "cover", "blank"), known).otherwise("unknown")


def enum(value: Column, allowed: list[str], default: str) -> Column:
    low = F.lower(T.trim_ws(T.or_blank(value)))
    return F.when(low.isin(allowed), low).otherwise(default)


def ready_status(done: Column) -> Column:
    """ready where ``done``, else pending."""
    return F.when(done, "ready").otherwise("pending")


def skip_ready(question_count: Column, metadata_status: Column, analysis_status: Column) -> Column:
    return (question_count > 0) & (metadata_status == "ready") & (analysis_status == "ready")


def complete_review(status: Column, pages: Column, questions: Column, report: Column) -> Column:
    """A review to sync: ready, with pages, questions, a report, and a question that has dimensions."""
    return (F.lower(status) == "ready") & (F.size(pages) > 0) & (F.size(questions) > 0) & ~T.is_blank(report) & F.exists(questions, lambda q: q["dimensions"].isNotNull())


def substantive(note: Column) -> Column:
    """Whether a note's body has a line that is more than structure: not blank, a heading, an empty item or a caption with a colon."""
    lines = F.transform(F.split(F.regexp_replace(T.without_front_matter(note), "\r\n", "\n"), "\n"), T.trim_ws)

    def structural(line: Column) -> Column:
        bare = T.trim_ws(F.regexp_replace(F.regexp_replace(line, "^-", ""), r"^\*", ""))
        return (bare == "") | line.startswith("#") | F.regexp_replace(bare, r"^[*_` ]+|[*_` ]+$", "").endswith(":")

    return F.exists(lines, lambda x: ~structural(x))


def complete_metadata(note: Column) -> Column:
    """Whether the front matter has a title, summary keywords and at least one recall question, as indented items."""
    block = F.concat(F.lit("\n"), F.regexp_replace(T.front_matter(note), "\r\n", "\n"), F.lit("\n"))
    questions = r"\n\s*recall_questions:[^\n]*\n(?:[ \t]+[^\n]*\n|[ \t]*\n)*?[ \t]+- [ \t]*\S"
    return block.rlike(r"\n[ \t]*title:[ \t]*\S") & block.rlike(r"\n[ \t]*summary_keywords:[ \t]*\S") & block.rlike(questions)


#: First words of a grammatical question; fixed list.
QUESTION_WORDS = ["what", "how", "why", "when", "where", "which", "who", "whom"]
#: Terms that give away where a note comes from, wherever they stand; fixed list.
SOURCE_TERMS = ["source:", "source metadata", "note status", "status:", "study iq", "rs sharma", "history optional", "part number", "part ", "course", "series"]
#: Words by which a prompt speaks of its note instead of its matter; fixed list.
META_WORDS = ["note", "text", "content", "description", "described", "discussed", "according", "source", "status"]
LONGEST_KEYWORDS = 320


def metadata_leak(value: Column) -> Column:
    """Whether a title, keywords or a prompt name the note's source, status or course."""
    return T.contains_any(F.lower(T.or_blank(value)), SOURCE_TERMS)


def recall_prompt_issue(prompt: Column) -> Column:
    """Why a recall prompt is refused, null if it is fine.

    ``question-mark``: it holds one; ``question-word``: it starts with one; ``metadata``: it gives away its source or speaks
    of its note. Prompts are telegraphic, not questions.
    """
    low = F.lower(T.or_blank(prompt))
    first = F.regexp_replace(F.regexp_extract(low, r"(?U)(\S+)", 1), "^[\"'`.,:;]+|[\"'`.,:;]+$", "")
    words = F.split(low, r"[^\p{L}\p{Nd}]+")
    meta = metadata_leak(prompt) | F.arrays_overlap(words, F.array(*[F.lit(w) for w in META_WORDS]))
    return F.when(low.contains("?"), "question-mark").when(first.isin(QUESTION_WORDS), "question-word").when(meta, "metadata")


def metadata_issue(title: Column, keywords: Column, prompts: Column) -> Column:
    """Why generated metadata is refused: ``title``, ``summary_keywords``, ``too-long`` or a prompt's issue; null if it is fine."""
    asked = F.filter(F.transform(prompts, recall_prompt_issue), lambda x: x.isNotNull())
    return (
        F.when(metadata_leak(title), "title")
        .when(metadata_leak(keywords), "summary_keywords")
        .when(F.char_length(T.or_blank(keywords)) > LONGEST_KEYWORDS, "too-long")
        .otherwise(F.get(asked, F.lit(0)))
    )


def lanes(providers: DataFrame, prefix: str) -> DataFrame:
    """Providers of a lane prefix in natural order of their number."""
    rows = providers.where(F.col("id").startswith(prefix))
    return rows.withColumn("lane", F.regexp_extract("id", r"(\d+)$", 1).try_cast("long")).orderBy(F.col("lane").asc_nulls_last(), "id")


def path_allowed(path: Column, root: str, ending: str = "") -> Column:
    """Whether a vault-relative path stays inside its root and scope: no absolute path, no ``..``, the right extension."""
    inside = ~path.startswith("/") & ~path.rlike(r"(^|/)\.\.(/|$)") & ~path.contains("\\")
    scope = root.strip("/")
    if scope:
        inside = inside & ((path == scope) | path.startswith(scope + "/"))
    return inside & (F.lower(path).endswith(ending) if ending else F.lit(True))
