"""Lookups between tables: first or last match, best match, coverage and overlap checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T


def one_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``, as an aggregate: each task sends one row a key at most."""
    rest = [c for c in rows.columns if c not in keys]
    whole = F.struct(*rest)
    turn = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    best = rows.groupBy(*keys).agg(F.min_by(whole, turn).alias("_row"))
    return best.select(*keys, "_row.*").select(rows.columns)


def left_first(left: DataFrame, right: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Left join with the first row by ``order`` of each key on the right."""
    return left.join(one_per_key(right, keys, *order), keys, "left")


def classify_pages(pages: DataFrame, classifications: DataFrame) -> DataFrame:
    """Pages with the kind of their last classification by ``pos``; a page without one keeps its own."""
    last = one_per_key(classifications.select("number", F.col("kind").alias("new_kind"), "pos"), ["number"], -F.col("pos")).drop("pos")
    return pages.join(last, "number", "left").withColumn("kind", F.coalesce("new_kind", "kind")).drop("new_kind")


def printed_prompts(questions: DataFrame, prompts: DataFrame) -> DataFrame:
    """Questions titled by the first printed prompt of their number, where there is one."""
    first = prompts.select(T.question_ref(F.col("label")).alias("ref"), F.col("title").alias("prompt"), "pos").where("ref <> '' and prompt <> ''")
    first = one_per_key(first, ["ref"], F.col("pos")).drop("pos")
    named = questions.withColumn("ref", T.question_ref(F.col("label")))
    return named.join(first, "ref", "left").withColumn("title", F.coalesce("prompt", "title")).drop("ref", "prompt")


def metadata_by_id_or_label(questions: DataFrame, metadata: DataFrame) -> DataFrame:
    """Questions with metadata by id, else by normalised label, else their own."""
    by_id = one_per_key(metadata.where("id <> ''").select("id", F.col("metadata").alias("m1"), "pos"), ["id"], F.col("pos")).drop("pos")
    label = metadata.select(T.label_norm(F.col("label")).alias("ref"), F.col("metadata").alias("m2"), "pos").where("ref <> ''")
    by_label = one_per_key(label, ["ref"], F.col("pos")).drop("pos")
    named = questions.withColumn("ref", T.label_norm(F.col("label")))
    out = named.join(by_id, "id", "left").join(by_label, "ref", "left")
    return out.withColumn("metadata", F.coalesce("m1", "m2", "metadata")).drop("m1", "m2", "ref")


def with_cache(notes: DataFrame, cache: DataFrame) -> DataFrame:
    """Notes with ``embedding`` and ``reuse``: the cached vector where path and hash are equal and it isn't empty."""
    kept = cache.where("size(embedding) > 0").select("path", "hash", "embedding")
    return notes.join(kept, ["path", "hash"], "left").withColumn("reuse", F.col("embedding").isNotNull())


def two_least(rows: DataFrame, keys: list[str], value: str, names: tuple[str, str]) -> DataFrame:
    """(keys, names): the least and the second least distinct ``value`` of each key, by aggregates alone."""
    first = rows.groupBy(*keys).agg(F.min(value).alias(names[0]))
    second = rows.join(first, keys).where(F.col(value) != F.col(names[0])).groupBy(*keys).agg(F.min(value).alias(names[1]))
    return first.join(second, keys, "left")


def exact_twins(sources: DataFrame, notes: DataFrame) -> DataFrame:
    """(path, twin): for each source note another byte-identical note; one of the same file name first, then the smallest path.

    Content is compared by its SHA-256. Each group of equal notes brings its two least paths, of which one isn't the
    source's own, so a group of many copies makes no pairs.
    """
    keyed = lambda rows, name: rows.select(F.col("path").alias(name), F.sha2("content", 256).alias("hash"), T.base_name(F.col("path")).alias("name"))
    left, right = keyed(sources, "path"), keyed(notes, "twin")
    named, any_ = two_least(right, ["hash", "name"], "twin", ("n1", "n2")), two_least(right, ["hash"], "twin", ("a1", "a2"))
    other = lambda one, two: F.when(F.col(one) != F.col("path"), F.col(one)).otherwise(F.col(two))
    both = left.join(named, ["hash", "name"], "left").join(any_, "hash", "left")
    return both.select("path", F.coalesce(other("n1", "n2"), other("a1", "a2")).alias("twin")).where("twin is not null").distinct()


def best_match(copies: DataFrame, reviews: DataFrame, with_status: bool = True) -> DataFrame:
    """(copy_id, review_id, rank): the review of highest rank for each copy, the latest on a tie, then the smallest id.

    ``copies``: copy_id, source_path, pdf_name; ``reviews``: review_id, source_path, pdf_name, status, updated_at. Ranks: 8 for
    the path, 4 for the name, 2 if ready (``with_status``), none if both paths are set and differ; of these only an equal path
    or name makes a candidate. Reviews are reduced to the best of each path, name and both before copies join them, so a name
    or path in a third of the rows makes no pairs. Reviews that only their search text names: ``search.best_found``.
    """
    low = lambda c: F.lower(T.trim_ws(T.or_blank(F.col(c))))
    name = F.lower(T.first_text(F.col("pdf_name"), T.base_name(F.col("source_path"))))
    left = copies.select("copy_id", low("source_path").alias("path"), name.alias("name"))
    ready = F.when(F.lower("status") == "ready", 2).otherwise(0) if with_status else F.lit(0)
    right = reviews.select("review_id", low("source_path").alias("path"), name.alias("name"), ready.alias("ready"), "updated_at")

    def ranked(some: DataFrame, keys: list[str], base: int, wanted: DataFrame) -> DataFrame:
        turn = F.struct((F.col("ready") + base).cast("long").alias("rank"), "updated_at", (-F.col("review_id")).alias("low"))
        return wanted.join(some.groupBy(*keys).agg(F.max(turn).alias("b")), keys).select("copy_id", "b")

    pathless, placed = F.col("path") == "", F.col("path") != ""
    named = F.col("name") != ""
    every = [
        ranked(right.where(placed & named), ["path", "name"], 12, left.where(placed & named)),
        ranked(right.where(placed), ["path"], 8, left.where(placed)),
        ranked(right.where(named & pathless), ["name"], 4, left.where(named & placed)),
        ranked(right.where(named), ["name"], 4, left.where(named & pathless)),
    ]
    best = reduce(DataFrame.unionByName, every).groupBy("copy_id").agg(F.max("b").alias("b"))
    return best.select("copy_id", (-F.col("b.low")).alias("review_id"), "b.rank")


def touching(questions: DataFrame, pages: DataFrame, keep_unplaced: bool = True) -> DataFrame:
    """Questions on at least one of ``pages(number)``; those without pages too, if ``keep_unplaced``."""
    placed = questions.select("id", F.explode("source_pages").alias("number")).join(pages.select("number"), "number", "left_semi")
    hit = questions.join(placed.select("id").distinct(), "id", "left_semi")
    return hit.unionByName(questions.where("coalesce(size(source_pages), 0) = 0")) if keep_unplaced else hit


def replace_on_pages(questions: DataFrame, pages: DataFrame, fresh: DataFrame) -> DataFrame:
    """Questions off the selected pages, and the fresh ones."""
    hit = touching(questions, pages, keep_unplaced=False).select("id")
    return questions.join(hit, "id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def selected_pages(pages: DataFrame, numbers: list[int]) -> DataFrame:
    """The selected pages; all of them for an empty selection."""
    return pages.where(F.col("number").isin(numbers)) if numbers else pages


def unreferenced(assets: DataFrame, documents: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    """Assets (path) whose file name no document's ``text`` refers to by ``pattern``."""
    found = documents.select(F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).alias("link"))
    named = found.select(T.base_name(F.col("link")).alias("name")).distinct()
    return assets.withColumn("name", T.base_name(F.col("path"))).join(named, "name", "left_anti").drop("name")


def assignment_issues(candidates: DataFrame, assigned: DataFrame) -> DataFrame:
    """(id, issue): ids that are assigned but unknown, assigned more than once, or not assigned."""
    times = assigned.groupBy("id").agg(F.count("*").alias("times"))
    both = candidates.select("id").distinct().withColumn("known", F.lit(True)).join(times, "id", "full")
    issue = F.when(F.col("known").isNull(), "unknown").when(F.col("times").isNull(), "missing").when(F.col("times") > 1, "duplicate")
    return both.select("id", issue.alias("issue")).where("issue is not null")


def constrain_candidates(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Decisions on candidate paths as they are; all others as pending."""
    known = candidates.select("path").distinct().withColumn("known", F.lit(True))
    out = decisions.join(known, "path", "left")
    pending = F.col("known").isNull()
    reason = F.when(pending, "destination was not a candidate").otherwise(F.col("reason"))
    return out.withColumn("status", F.when(pending, "pending").otherwise(F.col("status"))).withColumn("reason", reason).drop("known")


def changed_since_read(read: DataFrame, now: DataFrame) -> DataFrame:
    """(path): notes that changed or went away since they were read."""
    current = now.select("path", F.col("content").alias("now"))
    return read.join(current, "path", "left").where("not (content <=> now)").select("path")


def overlapping(groups: DataFrame) -> DataFrame:
    """(page, status, pos, links, first_other): each group on each page that groups of another status share.

    ``groups``: pos, status, source_pages. ``links`` counts the groups of another status on the page, ``first_other`` is the
    first of them: a page's rows tell every pair that clashes there, and a page that all groups share gives one row a
    group and not one a pair.
    """
    on = groups.select("status", "pos", F.explode("source_pages").alias("page")).distinct()
    own = on.groupBy("page", "status").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    firsts = F.array_sort(F.collect_list(F.struct("first", "status")))
    every = own.groupBy("page").agg(F.sum("n").alias("all"), F.slice(firsts, 1, 2).alias("firsts")).where("size(firsts) > 1")
    other = F.when(F.col("firsts")[0]["status"] == F.col("status"), F.col("firsts")[1]["first"]).otherwise(F.col("firsts")[0]["first"])
    both = on.join(own.select("page", "status", "n"), ["page", "status"]).join(every, "page")
    return both.select("page", "status", "pos", (F.col("all") - F.col("n")).alias("links"), other.alias("first_other"))


def densified(n_pages: int, pages: DataFrame) -> DataFrame:
    """Pages 1 to n, each with its best row by ``score``; missing ones are made with kind unknown and score 0."""
    spark = pages.sparkSession
    best = pages.groupBy("number").agg(F.max_by(F.struct("text", "kind", "score"), F.struct("score", (-F.col("pos")).alias("p"))).alias("b"))
    every = spark.range(1, n_pages + 1).select(F.col("id").alias("number"))
    return every.join(best, "number", "left").select(
        "number", T.or_blank(F.col("b.text")).alias("text"), F.coalesce("b.kind", F.lit("unknown")).alias("kind"), F.coalesce("b.score", F.lit(0)).alias("score"), F.col("b").isNull().alias("made")
    )


def label_scores(expected: DataFrame, observed: DataFrame, field: str) -> DataFrame:
    """(run_id, matches, checks): expected questions with a ``field`` that an observed one on the same pages shares."""
    wanted = expected.where(F.col(field) != "").select("run_id", "source_pages", field).withColumn("pos", F.monotonically_increasing_id())
    hits = observed.select("run_id", "source_pages", field).distinct().withColumn("hit", F.lit(1))
    return wanted.join(hits, ["run_id", "source_pages", field], "left").groupBy("run_id").agg(F.count("hit").alias("matches"), F.count("*").alias("checks"))


def same_groups(expected: Column, observed: Column) -> Column:
    """Whether two lists of questions group the same pages in the same order."""
    pages = lambda q: F.transform(q, lambda x: x["source_pages"])
    return pages(expected).eqNullSafe(pages(observed))


def merged_lists(first: DataFrame, second: DataFrame, key: str = "source") -> DataFrame:
    """Both lists, without the rows of the second whose key the first has, and keys once each."""
    return one_per_key(first.withColumn("_list", F.lit(0)).unionByName(second.withColumn("_list", F.lit(1))), [key], F.col("_list"), F.col("pos")).drop("_list")


def reviews_to_reuse(copies: DataFrame, reviews: DataFrame, mode: str) -> DataFrame:
    """(copy_id, review_id): the preferred review, else the latest of equal path or name, that is of the mode.

    Reviews are reduced to the latest of each path and of each name before copies join them, so a path or name that very many
    rows share makes no pairs.
    """
    fine = reviews.where((F.col("mode") == mode) & F.col("decodes"))
    turn = lambda nth: F.struct(F.lit(nth).alias("t"), "updated_at", (-F.col("review_id")).alias("r"), "review_id")
    best = lambda key, nth: fine.where(F.col(key) != "").groupBy(F.col(key).alias("_key")).agg(F.max(turn(nth)).alias("b"))
    wanted = [("preferred_id", fine.groupBy(F.col("review_id").alias("_key")).agg(F.max(turn(0)).alias("b"))), ("source_path", best("source_path", -1)), ("pdf_name", best("pdf_name", -1))]
    every = [copies.select("copy_id", F.col(c).alias("_key")).join(some, "_key").select("copy_id", "b") for c, some in wanted]
    return reduce(DataFrame.unionByName, every).groupBy("copy_id").agg(F.max("b").alias("b")).select("copy_id", "b.review_id")
