"""Scalar functions: the traps of white space, bytes, rounding and formats."""

import hashlib

import pytest
from pyspark.sql import functions as F

from docloom.functions import numbers as N
from docloom.functions import text as T


@pytest.fixture
def value(spark):
    def run(expression, **columns):
        row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()]) if columns else spark.range(1)
        return row.select(expression.alias("x")).first().x

    return run


c = F.col


@pytest.mark.parametrize(
    ("expression", "want"),
    [
        (lambda: T.normalize_ws(F.lit("  A Big\n\tStory ")), "a big story"),
        (lambda: T.trim_ws(F.lit(" \n x ")), "x"),
        (lambda: T.first_text(F.lit(None).cast("string"), F.lit("  "), F.lit(" b ")), "b"),
        (lambda: T.first_number(F.lit(0), F.lit(None).cast("int"), F.lit(3)), 3),
        (lambda: T.token_set(F.lit("The cat, THE dog's x ab abc9 é")), ["the", "cat", "dog", "abc9"]),
        (lambda: T.label_norm(F.lit(" Q.1 (a):- ")), "q.1-(a)"),
        (lambda: T.question_ref(F.lit("Question 2(b)")), "2b"),
        (lambda: T.question_ref(F.lit("q")), ""),
        (lambda: T.question_no(F.lit("see Q. 12"), F.lit(5)), 12),
        (lambda: T.question_no(F.lit("none"), F.lit(5)), 5),
        (lambda: T.scoped_id(F.lit("c1"), F.lit("c1-a b")), "c1-a-b"),
        (lambda: T.scoped_id(F.lit("c1"), F.lit("a b")), "c1-a-b"),
        (lambda: T.safe_stem(F.lit(" Scan_1 (Ä) b.PNG")), "scan-1-b"),
        (lambda: T.safe_stem(F.lit("x" * 95 + "..yy.jpg")), "x" * 95),
        (lambda: T.safe_stem(F.lit("ä.png")), ""),
        (lambda: T.slug_words(F.lit("The Map of an Old Town"), ["the", "of", "an"], 2), "map-old"),
        (lambda: T.compact_note(F.lit("p.md"), F.lit("äb"), 2), "PATH: p.md\nä\n[truncated]"),
        (lambda: T.numbered(F.lit("a\nb\n")), "   1 | a\n   2 | b"),
        (lambda: T.newlines(F.lit("a\r\nb\rc\n")), "a\nb\nc"),
        (lambda: T.front_matter(F.lit("---\ntitle: x\n---\nbody")), "title: x"),
        (lambda: T.without_front_matter(F.lit("---\ntitle: x\n---\nbody")), "body"),
        (lambda: T.without_front_matter(F.lit("no")), "no"),
        (lambda: T.json_object(F.lit('```json\n{"a": {"b": 1}}\n```')), '{"a": {"b": 1}}'),
        (lambda: T.json_object(F.lit("{broken")), None),
        (lambda: T.tagged_blocks(F.lit("<!-- OCR_PAGE a -->\none<!-- OCR_PAGE b -->two<!-- OCR_PAGE a -->three")), {"b": "two", "a": "three"}),
        (lambda: T.phone(F.lit("+44 (20) 1234-567")), "44201234567"),
        (lambda: T.phone(F.lit("12ab34567890")), None),
        (lambda: T.prompt_halves(F.lit("say hi say hi")), "say hi"),
        (lambda: T.prompt_halves(F.lit("abcd")), "abcd"),
        (lambda: T.json_escaped(F.lit('a<b>&"\n\\  ')), '"a\\u003cb\\u003e\\u0026\\"\\n\\\\ \\u2028"'),
        (lambda: T.style_time(F.lit(3_723_004).cast("long")), "01:02:03,004"),
        (lambda: T.parse_time(F.lit("01:02:03.5")), 3_723_500),
        (lambda: T.parse_time(F.lit("x")), None),
        (lambda: T.subtitle_plain(F.lit("1\n00:00:00,000 --> 00:00:01,000\nhello\n\n2\n00:00:01,000 --> 00:00:02,000\nworld")), "hello world"),
        (lambda: T.strings_distinct_ci(F.array(F.lit(" A "), F.lit("a"), F.lit(""), F.lit("B"))), ["A", "B"]),
        (lambda: T.page_union(F.array(F.lit(3), F.lit(0), F.lit(1)), F.array(F.lit(3), F.lit(-2), F.lit(2))), [1, 2, 3]),
        (lambda: T.contains_all(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2))), True),
        (lambda: T.first_forbidden(F.lit("we can Not do bad things"), ["bad"], ["not do"]), "not do"),
        (lambda: T.ocr_failed(F.lit("\n> OCR failed for this page: x")), True),
        (lambda: T.failure_kind(F.lit("HTTP 503 unavailable")), "transient"),
        (lambda: T.failure_kind(F.lit("bad key")), "permanent"),
        (lambda: T.failure_kind(F.lit("HTTP 500")), "transient"),
        (lambda: T.failure_kind(F.lit("Too Many Requests")), "transient"),
        (lambda: T.failure_kind(F.lit("connection refused")), "permanent"),
        (lambda: T.failure_kind(F.lit("context deadline exceeded")), "cancelled"),
        (lambda: T.error_page(F.lit("ok <HTML lang=en>")), True),
        (lambda: T.error_page(F.lit("x</body>")), True),
        (lambda: T.error_page(F.lit("<!doctype html>")), False),
        (lambda: T.failure_kind(F.lit(" ")), None),
        (lambda: N.clamp(F.lit(None).cast("double"), 0, 1), None),
        (lambda: N.clamp(F.lit(2.0), 0, 1), 1.0),
        (lambda: N.round_to(F.lit(1.005), 2), 1.0),
        (lambda: N.percent(F.lit(2), F.lit(3)), 67),
        (lambda: N.percent(F.lit(2), F.lit(0)), 0),
        (lambda: N.rate(F.lit(1), F.lit(0)), None),
        (lambda: N.request_tokens(F.lit(0), F.lit(0)), 4097),
        (lambda: N.request_tokens(F.lit(300_000), F.lit(0)), 115_000),
        (lambda: N.request_tokens(F.lit(10), F.lit(5_000)), 5_004),
        (lambda: N.eta_seconds(F.lit(0.5), F.lit(100.0), F.lit(3)), 100),
        (lambda: N.eta_seconds(F.lit(0.5), F.lit(10.0), F.lit(3)), None),
        (lambda: N.duration_text(F.lit(3_725)), "1h 2m"),
        (lambda: N.duration_text(F.lit(65)), "1m 5s"),
        (lambda: N.duration_close(F.lit(100_000.0), F.lit(100_450.0)), True),
        (lambda: N.score_number(F.lit("7.5"), 0, 10), 8.0),
        (lambda: N.score_number(F.lit("nan"), 0, 10), None),
        (lambda: N.in_range(F.lit(None).cast("double")), False),
    ],
)
def test_scalars(value, expression, want):
    assert value(expression()) == want


def test_hashes(value):
    assert value(T.hash_id("study", F.lit("a"), F.lit("5"))) == "study-" + hashlib.sha256(b"a:5").hexdigest()[:16]
    assert value(T.hash_folder(F.lit("/x"))) == hashlib.sha1(b"/x").hexdigest()[:12]


def test_limits():
    assert [N.page_limit(x, *N.LIMITS["jobs"]) for x in (None, 0, -3, 7, 999)] == [20, 20, 20, 7, 200]


def test_tiles(value):
    tiles = value(N.tile_boxes(F.lit(100), F.lit(50)))
    assert len(tiles) == 9 and (tiles[0].x0, tiles[0].x1, tiles[8].x0, tiles[8].x1, tiles[8].y1) == (0, 42, 58, 100, 50)
    odd = value(N.tile_boxes(F.lit(101), F.lit(3)))
    assert [(t.x0, t.x1, t.y0, t.y1) for t in (odd[0], odd[4], odd[8])] == [(0, 43, 0, 2), (29, 72, 0, 2), (58, 101, 1, 3)]
