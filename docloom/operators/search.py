"""Literal containment joins by an inverted index of byte n-grams, and the matches of records that need them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as T
from docloom.sources.shared import materialize

#: Bytes of a gram. A needle of fewer is a gram itself.
GRAM = 8
#: Bits of the filter of the needles' grams, as a power of 2 (8 MB), and how many one row of Spark's bitmaps holds.
FILTER_BITS, ROW_BITS = 26, 32_768
#: Bytes of texts that are cut into grams at once.
CUT_BYTES = 2_000_000


def grams(texts: pa.Array, widths: list[int], passes=None) -> tuple[np.ndarray, np.ndarray]:
    """(place of a text, gram): the distinct runs of as many bytes as ``widths`` say of each text, as numbers; only those that ``passes`` lets through.

    A number holds up to eight bytes, fewer with their width. Bytes are cut CUT_BYTES at a time, wherever texts end.
    """
    data = pc.fill_null(texts, "").cast(pa.large_binary())
    ends = np.cumsum(pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64))
    every = np.frombuffer(b"".join(data.to_pylist()), np.uint8)
    owners, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for low in range(0, len(every), CUT_BYTES):
        code = np.zeros(min(CUT_BYTES, len(every) - low), np.uint64)
        for k in range(max(widths)):
            more = every[low + k : low + k + len(code)].astype(np.uint64)
            code = code[: len(more)] | more << np.uint64(8 * k)
            if k + 1 in widths:
                own = code | np.uint64((k + 1) << 56) if k < 7 else code
                at = np.arange(len(own)) if passes is None else np.flatnonzero(passes(own))
                owner = np.searchsorted(ends, at + low, side="right")
                whole = at + low + k < ends[owner]
                owners.append(owner[whole])
                codes.append(own[at[whole]])
    owner, code = np.concatenate(owners), np.concatenate(codes)
    order = np.lexsort((code, owner))
    owner, code = owner[order], code[order]
    first = np.ones(len(code), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])
    return owner[first], code[first]


def bit_of(code: np.ndarray) -> np.ndarray:
    """The bit of the filter that stands for a gram."""
    return (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)


def postings_of(texts: DataFrame, key: str, text: str, widths: list[int], sent=None) -> DataFrame:
    """(key, gram, bit): each text's distinct grams; with ``sent``, a filter's bits, those that it lets through."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if sent is None else np.frombuffer(sent.value, np.uint8)

        def passes(code: np.ndarray) -> np.ndarray:
            bit = bit_of(code)
            return bits[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1

        for batch in it:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(sizes) // CUT_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                some = batch.slice(low, high - low)
                owner, code = grams(some.column(1), widths, None if bits is None else passes)
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(owner)), pa.array(code.view(np.int64)), pa.array(bit_of(code).astype(np.int64))], ["key", "gram", "bit"])

    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = rows.mapInArrow(batches, rows.select("key").limit(0).withColumns({"gram": F.lit(0).cast("long"), "bit": F.lit(0).cast("long")}).schema)
    return found.withColumnRenamed("key", key)


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """(needle, text_id): each distinct ``needles(needle)`` with every one of ``texts(text_id, text)`` that contains it, literally.

    Postings of the grams that needles hold are counted, and a needle meets only the texts of its rarest gram, among which
    it is then looked for. A needle with a gram that no text has meets none. Texts are cut into grams in tasks, and a filter of
    fixed size, which may let others through, spares most of those that no needle holds. Case is the caller's; null or
    empty needles and null texts match nothing; rows that repeat a text_id count once, with what any of them contains.
    """
    wanted = needles.select("needle").where("needle <> ''").distinct()
    fits = F.least(F.octet_length("needle"), F.lit(GRAM))
    sizes = sorted(r.n for r in wanted.select(fits.alias("n")).distinct().collect())  # eight at most
    if not sizes:
        return texts.where("false").select(F.lit("").alias("needle"), "text_id")
    cut = [postings_of(wanted.where(fits == n), "needle", "needle", [n]) for n in sizes]
    own = cut[0]
    for some in cut[1:]:
        own = own.unionByName(some)
    own = materialize(own)
    place = F.col("bit") + 1
    rows = own.groupBy(F.bitmap_bucket_number(place).alias("row")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()  # 2048 at most
    bits = np.zeros(((1 << FILTER_BITS) // ROW_BITS, ROW_BITS // 8), np.uint8)
    for r in rows:
        bits[r.row - 1] = np.frombuffer(bytes(r.bits), np.uint8)
    sent = texts.sparkSession.sparkContext.broadcast(bits.tobytes())
    texts = texts.where("text is not null").select("text_id", "text")
    postings = materialize(postings_of(texts, "text_id", "text", sizes, sent).select("text_id", "gram"))
    counts = postings.groupBy("gram").count()
    rare = own.join(counts, "gram", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    rare = rare.groupBy("needle").agg(F.min(F.struct("count", "gram")).alias("r")).where("r.count > 0").select("needle", F.col("r.gram").alias("gram"))
    met = rare.join(postings, "gram").select("needle", "text_id").distinct()
    return met.join(texts, "text_id").where(F.contains("text", "needle")).select("needle", "text_id").distinct()


def search_each(queries: DataFrame, rows: DataFrame, key: str, columns: list[str], status: bool = False) -> DataFrame:
    """(query_id, key): the rows that each of ``queries(query_id, query, status)`` finds.

    As in ``filters.search``, a row is found if one of its columns contains the trimmed query in lower case; with ``status``,
    a query's status, where set, must equal the row's. Queries of equal text are looked up once, and equal columns of a row are
    one text. A blank query, which there finds every row, finds none here: it asks for the table itself.
    """
    needle = F.lower(T.trim_ws(T.or_blank(F.col("query"))))
    asked = queries.select("query_id", needle.alias("needle"), (F.col("status") if status else F.lit("")).alias("asked_status"))
    own = rows.select(F.struct(F.col(key).alias("key"), (F.col("status") if status else F.lit("")).alias("status")).alias("text_id"), *[F.lower(T.or_blank(F.col(c))).alias(f"_{i}") for i, c in enumerate(columns)])
    texts = own.select("text_id", F.explode(F.array_distinct(F.array(*[f"_{i}" for i in range(len(columns))]))).alias("text")).where("text <> ''")
    found = containing(asked, texts).select("needle", F.col("text_id.key").alias(key), F.col("text_id.status").alias("_status"))
    some = asked.join(found, "needle")
    return some.where("asked_status is null or asked_status = '' or asked_status = _status").select("query_id", key)


def _low(c: str) -> Column:
    return F.lower(T.trim_ws(T.or_blank(F.col(c))))


def best_found(wanted: DataFrame, offered: DataFrame, with_status: bool = True, apart: bool = False) -> DataFrame:
    """(wanted_id, offered_id, rank): for each record the best of those that a search for its name finds.

    ``wanted``: wanted_id, source_path, pdf_name; ``offered``: offered_id, source_path, pdf_name, search_text, status,
    updated_at. A record's name is its pdf_name, else its path's last part; found is what has it in its name, path or search
    text, without regard to case. Ranks: 8 for an equal path, 4 for an equal name, 2 if ready (``with_status``), none if
    both paths are set and differ. The latest wins a tie, then the smallest id; with ``apart`` a record isn't its own match.

    Only an equal path or a path that is blank on one side can rank, so records meet by path, and by the index where a side
    is blank. What a name finds is reduced to the two best of each path before records are joined, so that neither many records of
    one name nor many finds make pairs of both.
    """
    name = F.lower(T.first_text(F.col("pdf_name"), T.base_name(F.col("source_path"))))
    left = wanted.select("wanted_id", _low("source_path").alias("path"), name.alias("needle")).where("needle <> ''")
    ready = F.when(F.lower("status") == "ready", 2).otherwise(0) if with_status else F.lit(0)
    right = offered.select("offered_id", _low("source_path").alias("o_path"), name.alias("o_name"), ready.alias("ready"), "updated_at", F.lower(T.or_blank(F.col("search_text"))).alias("more"))
    says = F.concat_ws("\n", "o_name", "o_path", "more")
    # by path: each distinct name of a path against that path's records
    asked = left.where("path <> ''").select("path", "needle").distinct()
    same = asked.join(right, F.col("path") == F.col("o_path")).where(F.contains(F.col("o_name"), F.col("needle")) | F.contains(F.col("o_path"), F.col("needle")) | F.contains(F.col("more"), F.col("needle")))
    same = same.select("needle", F.col("path").alias("meets"), "offered_id", "o_name", F.lit(8).alias("base"), "ready", "updated_at")
    # by the index: names of records without a path against all, the others' names against those without a path
    texts = right.select(F.col("offered_id").alias("text_id"), "o_path", says.alias("text"))
    blank = containing(left.where("path = ''"), texts.select("text_id", "text")).select("needle", "text_id", F.lit(True).alias("any"))
    other = containing(left.where("path <> ''"), texts.where("o_path = ''").select("text_id", "text")).select("needle", "text_id", F.lit(False).alias("any"))
    found = blank.unionByName(other).join(right, F.col("text_id") == F.col("offered_id"))
    # the texts are joined by line breaks, which a name can't match across
    found = found.where(F.contains(F.col("o_name"), F.col("needle")) | F.contains(F.col("o_path"), F.col("needle")) | F.contains(F.col("more"), F.col("needle")))
    found = found.select("needle", F.when(F.col("any"), "blank").otherwise("set").alias("meets"), "offered_id", "o_name", F.lit(0).alias("base"), "ready", "updated_at")
    rank = (F.col("base") + F.when(F.col("o_name") == F.col("needle"), 4).otherwise(0) + F.col("ready")).cast("long")
    ranked = same.withColumn("kind", F.lit("path")).unionByName(found.withColumn("kind", F.lit("side"))).withColumn("rank", rank).where("rank > 0")
    turn = F.struct((-F.col("rank")).alias("r"), (-F.coalesce(F.unix_micros("updated_at"), F.lit(-(1 << 62)))).alias("t"), "offered_id")
    keys = ["needle", "kind", "meets"]
    first = ranked.groupBy(*keys).agg(F.min(turn).alias("b"))
    best = first.select(*keys, F.col("b").alias("one"))
    if apart:  # the second best too, for the one record that is itself the best
        next_ = ranked.join(first, keys).where(F.col("offered_id") != F.col("b.offered_id")).groupBy(*keys).agg(F.min(turn).alias("two"))
        best = best.join(next_, keys, "left")
    else:
        best = best.withColumn("two", F.lit(None).cast(best.schema["one"].dataType))
    sides = [
        left.where("path <> ''").select("wanted_id", "needle", F.lit("path").alias("kind"), F.col("path").alias("meets")),
        left.select("wanted_id", "needle", F.lit("side").alias("kind"), F.when(F.col("path") == "", "blank").otherwise("set").alias("meets")),
    ]
    both = sides[0].unionByName(sides[1]).join(best, keys)
    pick = F.when(F.col("one.offered_id") == F.col("wanted_id"), F.col("two")).otherwise(F.col("one")) if apart else F.col("one")
    out = both.select("wanted_id", pick.alias("p")).where("p is not null").groupBy("wanted_id").agg(F.min("p").alias("p"))
    return out.select("wanted_id", F.col("p.offered_id").alias("offered_id"), (-F.col("p.r")).alias("rank"))
