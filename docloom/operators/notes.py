"""Notes: destination blocks, claim ledgers, line diffs and front matter, over many notes at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions import text as T


def note_blocks(replies: DataFrame) -> DataFrame:
    """(reply_id, pos, path, note): complete BEGIN_NOTE ... END_NOTE blocks that have a path and a body.

    ``replies``: reply_id, text. A reply with a block that never ends gives none. Marks are case-sensitive at the start and
    not at the end; a note ends in one line feed.
    """
    lines = F.transform(F.split(F.regexp_replace(T.or_blank(F.col("text")), "\r\n", "\n"), "\n"), lambda x: x)
    rows = replies.select("reply_id", F.posexplode(lines).alias("at", "line")).withColumn("bare", T.trim_ws(F.col("line")))
    turn = Window.partitionBy("reply_id").orderBy("at")
    event = F.when(F.lower("bare") == "end_note", "end").when(F.col("bare").startswith("BEGIN_NOTE "), "begin")
    rows = rows.withColumn("event", event)
    # a begin inside an open block is text: only the first begin after an end (or the start) opens
    ends = F.sum(F.when(F.col("event") == "end", 1).otherwise(0)).over(turn.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("run", F.coalesce(ends, F.lit(0)))
    begun = F.min(F.when(F.col("event") == "begin", F.col("at"))).over(Window.partitionBy("reply_id", "run"))
    ended = F.max(F.when(F.col("event") == "end", F.col("at"))).over(Window.partitionBy("reply_id", "run"))
    rows = rows.withColumn("begun", begun).withColumn("ended", ended).where("at >= begun")
    open_ = rows.where("ended is null").select("reply_id").distinct()
    body = F.when((F.col("at") > F.col("begun")) & (F.col("at") < F.col("ended")), F.struct("at", "line"))
    blocks = rows.groupBy("reply_id", "run").agg(
        F.max(F.when(F.col("at") == F.col("begun"), T.trim_ws(F.regexp_replace("bare", "^BEGIN_NOTE ", "")))).alias("path"),
        F.array_join(F.transform(F.array_sort(F.collect_list(body)), lambda b: b["line"]), "\n").alias("body"),
    )
    note = F.concat(F.regexp_replace("body", r"^\n+|\n+$", ""), F.lit("\n"))
    fine = blocks.join(open_, "reply_id", "left_anti").where(~T.is_blank(F.col("body")) & (F.col("path") != ""))
    return fine.select("reply_id", F.row_number().over(Window.partitionBy("reply_id").orderBy("run")).cast("long").alias("pos"), "path", note.alias("note"))


def pending_reason(text: Column) -> Column:
    """The reason of the last ``PENDING:`` line; null without one."""
    found = F.regexp_extract_all(T.or_blank(text), F.lit(r"(?im)^[ \t]*PENDING:[ \t]*(.*?)[ \t\r]*$"), F.lit(1))
    return F.try_element_at(found, F.lit(-1))


def page_sections(documents: DataFrame) -> DataFrame:
    """(doc, pos, number, name, text): sections of markdown after ``<!-- Page n name -->`` marks; rules between go."""
    parts = F.slice(F.split(T.or_blank(F.col("text")), r"(?=<!-- Page \d+)"), 1, 1 << 30)
    rows = documents.select("doc", F.posexplode(parts).alias("pos", "part")).where(F.col("part").rlike(r"^<!-- Page \d+"))
    body = F.regexp_replace(F.regexp_replace("part", r"(?s)^<!-- Page \d+.*?-->", ""), r"(?s)\n---\s*$", "")
    return rows.select("doc", "pos", F.regexp_extract("part", r"^<!-- Page (\d+)", 1).cast("long").alias("number"), T.trim_ws(F.regexp_extract("part", r"^<!-- Page \d+(.*?)-->", 1)).alias("name"), T.trim_ws(body).alias("text"))


def markdown_of_pages(pages: DataFrame) -> DataFrame:
    """(doc, text): pages joined by rules, each under its mark."""
    part = F.concat(F.lit("<!-- Page "), F.col("number").cast("string"), F.lit(" "), F.col("name"), F.lit(" -->\n\n"), T.trim_ws(F.col("text")))
    parts = F.array_sort(F.collect_list(F.struct("number", part.alias("part"))))
    return pages.groupBy("doc").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n---\n\n").alias("text"))


def positional_diff(pairs: DataFrame) -> DataFrame:
    """(id, at, kind, line): lines that differ at the same place, the old one (-) before the new one (+). ``pairs``: id, before, after."""
    side = lambda c, sign: pairs.select("id", F.posexplode(T.split_lines(F.col(c))).alias("at", f"line_{sign}"))
    both = side("before", "old").join(side("after", "new"), ["id", "at"], "full").where("not (line_old <=> line_new)")
    rows = both.select("id", "at", F.explode(F.array(F.struct(F.lit("-").alias("kind"), F.col("line_old").alias("line")), F.struct(F.lit("+").alias("kind"), F.col("line_new").alias("line")))).alias("r"))
    return rows.select("id", "at", "r.kind", "r.line").where("line is not null")


def common_lines(a: list[str], b: list[str]) -> list[tuple[str, int, int]]:
    """Steps ("same", "delete" or "insert", line in ``a``, line in ``b``) along a longest common subsequence; on a tie a line is inserted first."""
    longest = [[0] * (len(b) + 1)]
    for x in reversed(a):
        below, row = longest[-1], [0]
        for j in range(len(b) - 1, -1, -1):
            row.append(below[j + 1] + 1 if x == b[j] else max(below[j], row[-1]))
        longest.append(row[::-1])
    longest.reverse()
    steps, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            steps.append(("same", i, j))
            i, j = i + 1, j + 1
        elif j < len(b) and (i == len(a) or longest[i][j + 1] >= longest[i + 1][j]):
            steps.append(("insert", i, j))
            j += 1
        else:
            steps.append(("delete", i, j))
            i += 1
    return steps


def lines_by_place(a: list[str], b: list[str]) -> list[tuple[str, int, int]]:
    """The same steps, comparing only lines at the same place."""
    steps = []
    for k in range(max(len(a), len(b))):
        if k < min(len(a), len(b)) and a[k] == b[k]:
            steps.append(("same", k, k))
        else:
            steps += [("delete", k, k)] * (k < len(a)) + [("insert", k, k)] * (k < len(b))
    return steps


def line_diff(pairs: DataFrame, most_cells: int = 500_000) -> DataFrame:
    """(id, pos, type, before_number, after_number, before_text, after_text): the rows of a two-column diff of ``pairs(id, before, after)``.

    Lines of a longest common subsequence are ``same``. Between them, the k-th removed and the k-th added line stand in one
    ``changed`` row; what is left of either is ``deleted`` or ``inserted``. Numbers are from 1, null where a side has no
    line. Pairs with more than ``most_cells`` line pairs are compared place by place instead.
    """

    def rows_of(a: list[str], b: list[str]) -> Iterator[tuple]:
        gone: list[int] = []
        come: list[int] = []

        def block() -> Iterator[tuple]:
            for k in range(max(len(gone), len(come))):
                i, j = gone[k] if k < len(gone) else None, come[k] if k < len(come) else None
                yield "inserted" if i is None else "deleted" if j is None else "changed", i, j
            gone.clear()
            come.clear()

        for kind, i, j in (lines_by_place if len(a) * len(b) > most_cells else common_lines)(a, b):
            if kind == "same":
                yield from block()
                yield "same", i, j
            else:
                (gone if kind == "delete" else come).append(i if kind == "delete" else j)
        yield from block()

    def diff(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["id", "pos", "type", "before_number", "after_number", "before_text", "after_text"]
        for pdf in it:
            rows = []
            for key, before, after in zip(pdf.id, pdf.before, pdf.after, strict=True):
                a, b = before.split("\n"), after.split("\n")
                for k, (kind, i, j) in enumerate(rows_of(a, b)):
                    rows.append((key, k, kind, None if i is None else i + 1, None if j is None else j + 1, "" if i is None else a[i], "" if j is None else b[j]))
            yield pd.DataFrame(rows, columns=names).astype({"before_number": "Int64", "after_number": "Int64"})

    base = pairs.select("id", *[F.regexp_replace(T.or_blank(F.col(c)), r"\n\z", "").alias(c) for c in ("before", "after")])
    return base.mapInPandas(diff, f"id {dict(pairs.dtypes)['id']}, pos long, type string, before_number long, after_number long, before_text string, after_text string")


def apply_final_notes(finals: DataFrame, current: DataFrame) -> DataFrame:
    """(run_id, path, status): what a final note does: merged if it differs from the note there, else deduped."""
    now = current.select("path", F.col("content").alias("now"))
    same = T.trim_ws(F.col("note")) == T.trim_ws(T.or_blank(F.col("now")))
    return finals.join(now, "path", "left").select("run_id", "path", F.when(same, "deduped").otherwise("merged").alias("status"), "note")


def excerpt(text: Column, limit: int) -> Column:
    """Whole lines from the start within ``limit`` characters, numbered; a mark where lines are left out."""
    lines = T.split_lines(text)
    sums = F.transform(lines, lambda _, i: F.aggregate(F.slice(lines, 1, i + 1), F.lit(0), lambda s, x: s + F.char_length(x) + 1))
    kept = F.size(F.filter(sums, lambda s: s <= limit))
    shown = F.transform(F.slice(lines, 1, F.greatest(kept, F.lit(1))), lambda x, i: F.format_string("%4d | %s", i + 1, x))
    return F.concat(F.array_join(shown, "\n"), F.when(kept < F.size(lines), "\n...").otherwise(""))


def candidate_prompt(ranked: DataFrame) -> DataFrame:
    """(query, prompt): a numbered list of candidates with their similarity, in order of rank."""
    line = F.format_string("%d. %s (similarity %.4f)", F.col("rank"), F.col("path"), F.col("score"))
    parts = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return ranked.groupBy("query").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("prompt"))


def archive_target(path: Column, day: Column, taken: Column) -> Column:
    """Where a processed note moves: a dated folder, with ``-n`` before the extension if n notes took the name."""
    name = T.base_name(path)
    stem, ending = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"(\.[^.]*)$", 1)
    unique = F.when(taken > 0, F.concat(stem, F.lit("-"), (taken + 1).cast("string"), ending)).otherwise(name)
    return F.concat_ws("/", F.lit("_processed"), F.date_format(day, "yyyy-MM-dd"), unique)


def without_managed(notes: DataFrame, fields: list[str]) -> DataFrame:
    """Notes whose front matter lost the managed fields and the indented lines under them."""
    names = "|".join(fields)
    block = F.concat(F.lit("\n"), T.front_matter(F.col("content")))
    left = F.regexp_replace(block, rf"(?m)\n(?:{names}):[^\n]*(?:\n(?:[ \t]+|- )[^\n]*)*", "")
    left = F.regexp_replace(left, r"^\n+", "")
    body = T.without_front_matter(F.col("content"))
    return notes.withColumn("content", F.when(T.is_blank(left), body).otherwise(F.concat(F.lit("---\n"), left, F.lit("\n---\n"), body)))
