"""Schemas of the stored tables, and reads of whole tables, rows and children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "jobs": "id string, kind string, status string, progress double, units_done long, units_total long, input_json string, output_json string, error string, created_at timestamp, started_at timestamp, finished_at timestamp",
    "reviews": "review_id string, pdf_name string, source_path string, status string, page_count long, question_count long, review_json string, search_text string, created_at timestamp, updated_at timestamp",
    "study_copies": "copy_id string, pdf_name string, source_path string, candidate_name string, exam_code string, paper string, status string, page_count long, question_count long, metadata_status string, analysis_status string, metadata_json string, created_at timestamp, updated_at timestamp",
    "study_pages": "copy_id string, page_number long, text string, kind string, unclear_count long, verified boolean, updated_at timestamp",
    "study_questions": "id string, copy_id string, question_no long, label string, title string, answer_markdown string, source_pages array<long>, marks double, marks_limit double, metadata_json string, updated_at timestamp",
    "study_analyses": "id string, copy_id string, scope_type string, dimension_key string, text string, updated_at timestamp",
    "study_batches": "id string, stage string, status string, total long, completed long, failed long, created_at timestamp, finished_at timestamp",
    "study_batch_items": "batch_id string, copy_id string, stage string, status string, error string, started_at timestamp, finished_at timestamp",
    "usage_events": "id long, profile_id string, provider_id string, model string, occurred_at timestamp, reserved_tokens long",
}


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table; an empty one of its schema where nothing is stored is up to the caller to write."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def point(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key; raises KeyError if there is none."""
    found = rows.where(F.col(key) == value).limit(1)
    if found.isEmpty():
        raise KeyError(f"{key} {value!r} not found")
    return found


def children(rows: DataFrame, key: str, value, *order: Column) -> DataFrame:
    return rows.where(F.col(key) == value).orderBy(*order)


def usage_since(events: DataFrame, since: Column) -> DataFrame:
    return events.where(F.col("occurred_at") >= since).orderBy("occurred_at", "id")
