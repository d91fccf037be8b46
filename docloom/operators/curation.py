"""Curation of chat examples from logged exchanges: cleaning, dedup, strict filters, quality report and split."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.operators.aggregates import mode
from docloom.operators.packing import train_eval
from docloom.sources.shared import materialize

#: Schema of a logged exchange.
EXCHANGE = """run_id string, workflow string, step string, source_path string, provider_id string, model string, created_at timestamp,
request struct<model: string, messages: array<struct<role: string, content: string>>, temperature: double, max_tokens: bigint>,
response struct<content: string, finish_reason: string, usage: struct<input_tokens: bigint, cached_input_tokens: bigint,
output_tokens: bigint, reasoning_output_tokens: bigint, total_tokens: bigint>>, error string, parsed_format string"""


def parse_exchanges(lines: DataFrame) -> DataFrame:
    """Exchanges of JSON lines (``value``, ``pos``), blank lines left out; ``malformed`` marks those that aren't JSON."""
    parsed = F.from_json("value", f"{EXCHANGE}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    rows = lines.where(~T.is_blank(F.col("value"))).select("pos", parsed.alias("e"))
    return rows.select("pos", "e.*", F.col("e._bad").isNotNull().alias("malformed")).drop("_bad")


def clean_messages(messages: Column) -> Column:
    """Messages with lower-case roles and trimmed content of LF lines; those without either go."""
    made = F.transform(messages, lambda m: F.struct(F.lower(T.trim_ws(T.or_blank(m["role"]))).alias("role"), T.newlines(m["content"]).alias("content")))
    return F.filter(made, lambda m: (m["role"] != "") & (m["content"] != ""))


def clean_exchanges(exchanges: DataFrame, workflow: str, step: str, parsed_format: str) -> DataFrame:
    """(pos, messages, reason): chat examples, and for the rest the first reason that holds."""
    cleaned = F.coalesce(clean_messages(F.col("request.messages")), F.array().cast("array<struct<role: string, content: string>>"))
    reply = T.newlines(F.col("response.content"))
    reason = (
        F.when(F.col("malformed"), "malformed-json")
        .when(~T.is_blank(F.col("error")), "failed-exchange")
        .when(~T.or_blank(F.col("workflow")).eqNullSafe(workflow), "not-target-workflow")
        .when(~T.or_blank(F.col("step")).eqNullSafe(step), "not-target-step")
        .when(~T.or_blank(F.col("parsed_format")).eqNullSafe(parsed_format), "not-target-format")
        .when(F.size(cleaned) == 0, "empty-messages")
        .when(reply == "", "empty-response")
        .otherwise("")
    )
    return exchanges.select("pos", F.concat(cleaned, F.array(F.struct(F.lit("assistant").alias("role"), reply.alias("content")))).alias("messages"), reason.alias("reason"))


def examples_from_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, messages, reason): conversations as chat examples; one needs a message before a last assistant turn."""
    turn = F.struct("turn", "role", F.col("text").alias("content"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    cleaned = clean_messages(F.col("turns"))
    made = grouped.select("conv_id", cleaned.alias("messages"))
    last = F.element_at("messages", -1)["role"]
    reason = F.when(F.size("messages") < 2, "empty-messages").when(last != "assistant", "empty-response").otherwise("")
    return made.select("conv_id", "messages", reason.alias("reason"))


def example_hash(messages: Column) -> Column:
    """SHA-256 of the example's JSON, in the escaping that also covers ``<``, ``>`` and ``&``."""
    parts = F.transform(messages, lambda m: F.concat(F.lit('{"role":'), T.json_escaped(m["role"]), F.lit(',"content":'), T.json_escaped(m["content"]), F.lit("}")))
    return F.sha2(F.concat(F.lit('{"messages":['), F.array_join(parts, ","), F.lit("]}")), 256)


def plain_hash(messages: Column) -> Column:
    """SHA-256 of roles and contents, a line each: a hash that SQL can repeat."""
    return F.sha2(F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit("\n"), m["content"])), "\n"), 256)


def of_role(messages: Column, role: str, last: bool = False) -> Column:
    """Content of the first (or last) message of a role; blank if there is none."""
    some = F.filter(messages, lambda m: m["role"] == role)
    return F.coalesce(F.try_element_at(some, F.lit(-1 if last else 1))["content"], F.lit(""))


def note_boundaries(text: str) -> tuple[int, bool]:
    """(complete notes before the first fault, whether the BEGIN_NOTE / END_NOTE structure is bad)."""
    count, inside, body = 0, False, 0
    for line in map(str.strip, text.split("\n")):
        if line.startswith("BEGIN_NOTE "):
            if inside:
                return count, True
            inside, body = True, 0
        elif line == "END_NOTE":
            if not inside or not body:
                return count, True
            inside, count = False, count + 1
        elif inside:
            body += line != ""
        elif line:
            return count, True
    return count, inside or count == 0


def with_quality(examples: DataFrame) -> DataFrame:
    """Examples with the flags and sizes (in bytes) that the strict filters and the report use."""

    def boundaries(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([note_boundaries(t) for t in texts], columns=["notes", "bad"])

    m = F.col("messages")
    base = examples.withColumn("assistant", of_role(m, "assistant", last=True)).withColumn("user", of_role(m, "user"))
    upper = F.upper("assistant")
    flagged = base.withColumns({
        "system_hash": T.hash_text(of_role(m, "system")),
        "semantic_candidates": F.col("user").contains("SEMANTIC DESTINATION CANDIDATES:"),
        "code_fence": F.col("assistant").contains("```"),
        "duplicate_front_matter": F.col("assistant").rlike(r"(?m)BEGIN_NOTE [^\n]*\n+[ \t]*---[ \t]*\n(?:(?![ \t]*---[ \t]*$).*\n)*?[ \t]*---[ \t]*\n[ \t]*---[ \t]*(?:\n|\z)"),
        "status_or_json": (F.col("assistant") == "") | upper.rlike(r"^(?:[{\[]|PENDING|FAILED|ERROR)"),
        "user_chars": F.octet_length("user").cast("long"),
        "assistant_chars": F.octet_length("assistant").cast("long"),
    })
    found = F.pandas_udf(boundaries, "notes long, bad boolean")("assistant")  # the one text that Python reads
    return flagged.withColumn("_found", found).withColumn("final_notes", F.col("_found.notes")).withColumn("bad_boundaries", F.col("_found.bad")).drop("assistant", "user", "_found")


def strict_reason(primary: Column) -> Column:
    return (
        F.when(~F.col("system_hash").eqNullSafe(primary), "non-primary-system-prompt")
        .when(~F.col("semantic_candidates"), "missing-semantic-candidates")
        .when(F.col("code_fence"), "assistant-code-fence")
        .when(F.col("duplicate_front_matter"), "duplicate-frontmatter")
        .when(F.col("bad_boundaries"), "bad-note-boundaries")
        .when(F.col("status_or_json"), "assistant-status-or-json")
        .otherwise("")
    )


def export(examples: DataFrame, strict: bool = False, hashed=example_hash, pos: str = "pos") -> DataFrame:
    """Examples (pos, messages, reason) with their final ``reason`` (duplicate and strict ones too), hash and split.

    The first of equal examples stays. The primary system prompt is the most common one after dedup and before the strict
    filters. The split is by the order of hashes: the first twentieth of what is exported is eval; other rows have none.
    """
    rows = materialize(examples.withColumn("hash", hashed(F.col("messages"))))  # read by each of the steps below
    fine = rows.where("reason = ''")
    first = fine.groupBy("hash").agg(F.min(pos).alias("_first"))
    judged = fine.join(first, "hash").withColumn("reason", F.when(F.col(pos) == F.col("_first"), "").otherwise("duplicate")).drop("_first")
    if strict:
        kept = with_quality(judged.where("reason = ''"))
        primary = mode(kept.withColumn("_all", F.lit(1)), "system_hash", ["_all"]).select(F.col("value").alias("_primary"))
        kept = kept.crossJoin(F.broadcast(primary)).withColumn("reason", strict_reason(F.col("_primary")))  # one row
        judged = judged.where("reason <> ''").unionByName(kept.select(judged.columns))
    out = train_eval(judged.where("reason = ''"), "hash")
    rest = rows.where("reason <> ''").unionByName(judged.where("reason <> ''"))
    return out.unionByName(rest.withColumn("split", F.lit("")))


def quality_report(examples: DataFrame) -> DataFrame:
    """One row of counts, sums, extremes and integer averages of ``with_quality`` rows; zeros for none."""
    flag = lambda c: F.count_if(F.col(c))
    n = F.count("*")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    hashes = mode(examples.withColumn("_all", F.lit(1)), "system_hash", ["_all"])
    primary = hashes.agg(zero(F.max("n")).alias("primary_system_prompt_count"))
    out = examples.agg(
        n.alias("examples"),
        F.count_distinct("system_hash").alias("system_prompt_variants"),
        flag("semantic_candidates").alias("with_semantic_candidates"),
        (n - flag("semantic_candidates")).alias("without_semantic_candidates"),
        flag("code_fence").alias("with_code_fences"),
        flag("duplicate_front_matter").alias("with_duplicate_front_matter"),
        flag("bad_boundaries").alias("with_bad_note_boundaries"),
        flag("status_or_json").alias("with_status_or_json"),
        F.count_if(F.col("assistant_chars") < 500).alias("short_assistant"),
        F.count_if(F.col("assistant_chars") > 20_000).alias("long_assistant"),
        zero(F.sum("final_notes")).alias("total_final_notes"),
        zero(F.max("final_notes")).alias("max_final_notes"),
        *[zero(f(c)).alias(f"{name}_{c}") for c in ("user_chars", "assistant_chars") for name, f in (("min", F.min), ("max", F.max))],
        *[zero(F.expr(f"sum({c}) div nullif(count(*), 0)")).alias(f"average_{c}") for c in ("user_chars", "assistant_chars")],
    )
    return out.crossJoin(primary)  # one row each


def chat_lines(examples: DataFrame) -> DataFrame:
    """(value): ``{"messages": [...]}`` lines."""
    return examples.select(F.to_json(F.struct("messages")).alias("value"))


def sharegpt_lines(examples: DataFrame) -> DataFrame:
    """(value): lines of ``conversations`` with user as human and assistant as gpt."""
    name = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    turns = F.transform("messages", lambda m: F.struct(name(m["role"]).alias("from"), m["content"].alias("value")))
    return examples.select(F.to_json(F.struct(turns.alias("conversations"))).alias("value"))
