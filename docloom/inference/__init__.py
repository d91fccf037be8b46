"""Model calls behind a small interface: any object with the method a capability needs, used inside ``mapInPandas``."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text as T


class Model(Protocol):
    """A provider. Each method takes a batch and returns as many results, in order; it may raise."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def complete(self, prompts: list[str]) -> list[str]: ...

    def rerank(self, query: str, documents: list[str]) -> list[float]: ...


class HashModel:
    """A model that needs no network: vectors and replies derived from hashes of the input."""

    def __init__(self, dimensions: int = 16, reply: Callable[[str], str] | None = None):
        self.dimensions, self.reply = dimensions, reply or (lambda prompt: f"reply {hashlib.sha256(prompt.encode()).hexdigest()[:12]}")

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            rng = np.random.default_rng(int(hashlib.sha256(t.encode()).hexdigest()[:15], 16))
            v = rng.normal(size=self.dimensions)
            out.append((v / np.linalg.norm(v)).tolist())
        return out

    def complete(self, prompts: list[str]) -> list[str]:
        return [self.reply(p) for p in prompts]

    def rerank(self, query: str, documents: list[str]) -> list[float]:
        words = set(query.lower().split())
        return [len(words & set(d.lower().split())) / max(1, len(words)) for d in documents]


#: What an error says when a target has had enough: fixed values.
LIMIT_WORDS = ("429", "rate limit", "quota", "timed out")
COOLING = "cooling down"


def said_by(error: Exception) -> str:
    said = str(error)
    return f"timed out: {said}" if isinstance(error, TimeoutError) and "timed out" not in said.lower() else said


def is_rate_limit(error: str) -> bool:
    return any(w in error.lower() for w in LIMIT_WORDS)


def with_fallback(calls: list[tuple[str, Callable]], rows: list, cooling: set[str] | None = None) -> tuple[list, list[list[dict]]]:
    """Results of the first target that answers each batch, or each row where a batch fails; and the attempts made.

    Targets in ``cooling`` are passed over, which an attempt says. With that set given, a target that refuses a call for a
    rate limit joins it and isn't asked for the other rows.
    """
    attempts: list[list[dict]] = [[] for _ in rows]
    results: list = [None] * len(rows)
    open_ = list(range(len(rows)))
    for name, call in calls:
        if not open_:
            break
        for group in [[open_], [[i] for i in open_]][: 1 + (len(open_) > 1)]:  # the batch at once, then one by one
            left = []
            for some in group:
                if cooling and name in cooling:
                    left += some
                    for i in some:
                        if not attempts[i] or attempts[i][-1]["target"] != name:
                            attempts[i].append({"target": name, "error": COOLING})
                    continue
                try:
                    got = call([rows[i] for i in some])
                    for i, r in zip(some, got, strict=True):
                        results[i] = r
                        attempts[i].append({"target": name, "error": ""})
                except Exception as e:  # noqa: BLE001  providers raise what they like; the attempt says what
                    left += some
                    limited = cooling is not None and is_rate_limit(said_by(e))
                    if limited:
                        cooling.add(name)
                    if len(some) == 1 or limited:
                        for i in some:
                            attempts[i].append({"target": name, "error": said_by(e)[:500]})
            open_ = left
            if not open_:
                break
    return results, attempts


def complete(rows: DataFrame, key: str, prompt: str, targets: list[tuple[str, Model]], batch: int = 10, cooling: set[str] | None = None) -> DataFrame:
    """(key, reply, error, attempts): the reply of the first target that answers; error is that of the last one if none does.

    With ``cooling`` (names of targets to pass over), a target that meets a rate limit is passed over by the task from then on.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        passed = None if cooling is None else set(cooling)
        for pdf in it:
            for at in range(0, len(pdf), batch):
                some = pdf[at : at + batch]
                replies, attempts = with_fallback([(n, m.complete) for n, m in targets], some[prompt].tolist(), passed)
                errors = ["" if r is not None else (a[-1]["error"] if a else "no target") for r, a in zip(replies, attempts, strict=True)]
                yield pd.DataFrame({key: some[key].to_numpy(), "reply": replies, "error": errors, "attempts": attempts})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, prompt).mapInPandas(run, f"{key} {kind}, reply string, error string, attempts array<struct<target: string, error: string>>")


def newly_limited(replies: DataFrame) -> DataFrame:
    """(target): the targets that refused a call of these replies for a rate limit; a row for each target at most."""
    a = replies.select(F.explode("attempts").alias("a")).select("a.target", F.lower("a.error").alias("said"))
    hit = F.lit(False)
    for w in LIMIT_WORDS:
        hit = hit | F.col("said").contains(w)
    return a.where(hit).select("target").distinct()


class CoolingCompletions:
    """``complete`` over the micro-batches of a stream, with cooldowns that batches hand on.

    For ``foreachBatch``. What a batch met (a row for each limited target, with the time until which it is passed over) is
    written under ``path`` before the next begins, as are replies and the rows that found every target cooling, which the
    next batch asks again. A batch that runs anew after a restart reads what the one before left and overwrites its own.
    """

    def __init__(self, path: str, key: str, prompt: str, targets: list[tuple[str, Model]], cooldown_s: int = 14_400, batch: int = 10, clock: Callable[[], float] = time.time):
        self.path, self.key, self.prompt, self.targets, self.cooldown_s, self.batch, self.clock = path.rstrip("/"), key, prompt, targets, cooldown_s, batch, clock

    def _read(self, spark: SparkSession, what: str, schema: str, number: int) -> DataFrame:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}/{number}")
        there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
        return spark.read.schema(schema).parquet(at.toString()) if there else spark.createDataFrame([], schema)

    def __call__(self, rows: DataFrame, number: int) -> None:
        spark, now = rows.sparkSession, self.clock()
        kind = dict(rows.dtypes)[self.key]
        held = self._read(spark, "cooling", "target string, until double", number - 1).where(F.col("until") > now)
        asked = rows.select(self.key, self.prompt).unionByName(self._read(spark, "deferred", f"`{self.key}` {kind}, `{self.prompt}` string", number - 1))
        cooling = {r.target: r.until for r in held.collect()}  # targets are few: they are given with the call
        got = complete(asked, self.key, self.prompt, self.targets, self.batch, set(cooling)).withColumn("asked_at", F.lit(now))
        written = f"{self.path}/all/{number}"
        got.write.mode("overwrite").parquet(written)
        got = spark.read.parquet(written)
        met = {r.target for r in newly_limited(got).collect()}
        until = cooling | dict.fromkeys(met, now + self.cooldown_s)
        later = got.where((F.col("error") != "") & F.forall("attempts", lambda a: a["error"] == COOLING))
        asked.join(later.select(self.key).distinct(), self.key, "left_semi").write.mode("overwrite").parquet(f"{self.path}/deferred/{number}")
        spark.createDataFrame(list(until.items()), "target string, until double").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cooling/{number}")

    def replies(self, spark: SparkSession) -> DataFrame:
        """(key, reply, error, attempts, asked_at, number) of all batches, without rows that were asked again later."""
        every = spark.read.parquet(f"{self.path}/all/*").withColumn("number", F.regexp_extract("_metadata.file_path", "/all/([0-9]+)/", 1).cast("long"))
        return every.where(~((F.col("error") != "") & F.forall("attempts", lambda a: a["error"] == COOLING)))


def ocr_text(rows: DataFrame) -> DataFrame:
    """Replies as page text; a failed page says so and why."""
    failed = F.concat(F.lit("> OCR failed for this page: "), F.col("error"))
    return rows.withColumn("text", F.when(F.col("error") != "", failed).otherwise(T.ocr_clean(F.col("reply"))))


def embed(notes: DataFrame, model: Model, batch: int = 128) -> DataFrame:
    """(path, hash, embedding) of ``notes(path, hash, content)``; an empty vector is an error."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for at in range(0, len(pdf), batch):
                some = pdf[at : at + batch]
                vectors = model.embed(some.content.tolist())
                if len(vectors) != len(some) or not all(len(v) for v in vectors):
                    raise ValueError("the model returned no vector for some notes")
                yield pd.DataFrame({"path": some.path.to_numpy(), "hash": some.hash.to_numpy(), "embedding": vectors})

    return notes.select("path", "hash", "content").mapInPandas(run, "path string, hash string, embedding array<double>")


def refresh_index(notes: DataFrame, cache: DataFrame, model: Model, name: str) -> DataFrame:
    """The index of ``notes(path, content)``: cached vectors of the same model, path and hash, and new ones for the rest.

    Vectors of notes that are gone fall out; a cache of another model counts for nothing.
    """
    hashed = notes.select("path", "content", T.hash_text(F.col("content")).alias("hash"))
    fine = cache.where((F.col("model") == name) & (F.size("embedding") > 0)).select("path", "hash", "embedding").dropDuplicates(["path", "hash"])
    reused = fine.join(hashed.select("path", "hash"), ["path", "hash"], "left_semi")
    fresh = embed(hashed.join(fine, ["path", "hash"], "left_anti"), model)
    return reused.unionByName(fresh).withColumn("model", F.lit(name))


def rerank_scores(results: DataFrame) -> DataFrame:
    """Scores of rerank replies: relevance_score, else score where that is missing or 0."""
    return results.withColumn("final_score", F.coalesce(F.when(F.col("relevance_score") != 0, F.col("relevance_score")), F.col("score"), F.lit(0.0)))


def stream_text(lines: DataFrame) -> DataFrame:
    """(id, text) of captured event-stream lines (id, pos, line): deltas of ``data:`` lines before ``[DONE]``; bad JSON is passed over."""
    data = T.trim_ws(F.regexp_extract("line", r"^data:(.*)$", 1))
    rows = lines.select("id", "pos", data.alias("data")).where("data <> ''")
    end = rows.where("data = '[DONE]'").groupBy("id").agg(F.min("pos").alias("end"))
    parsed = F.from_json("data", "choices array<struct<delta: struct<content: string>>>")
    some = rows.join(end, "id", "left").where("end is null or pos < end").select("id", "pos", F.get(parsed["choices"], F.lit(0))["delta"]["content"].alias("part"))
    return some.where("part is not null").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda p: p["part"]), "").alias("text"))
