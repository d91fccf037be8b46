"""Text as column expressions. White space is Unicode white space, and lengths are bytes, unless a name says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)\s+"


def trim_ws(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_ws(text: Column) -> Column:
    """Lower case, each run of white space as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), SPACES, " "))


def or_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def is_blank(text: Column) -> Column:
    return trim_ws(or_blank(text)) == ""


def first_text(*texts: Column) -> Column:
    """The first that isn't blank, trimmed; else the empty string."""
    return F.coalesce(*[F.when(~is_blank(t), trim_ws(t)) for t in texts], F.lit(""))


def first_number(*numbers: Column) -> Column:
    """The first that is neither null nor zero; else zero."""
    return F.coalesce(*[F.when(n != 0, n) for n in numbers], F.lit(0))


def token_set(text: Column) -> Column:
    """Distinct lower-case runs of a-z and 0-9 of three characters or more."""
    return F.array_distinct(F.filter(F.split(F.lower(or_blank(text)), "[^a-z0-9]+"), lambda t: F.length(t) >= 3))


def word_count(text: Column) -> Column:
    return F.regexp_count(or_blank(text), F.lit(r"(?U)\S+")).cast("long")


def label_norm(label: Column) -> Column:
    """Lower case without ``.:;-_`` and blanks at the ends, white space as a hyphen."""
    return F.regexp_replace(F.regexp_replace(F.lower(or_blank(label)), r"^[.:;\-_ ]+|[.:;\-_ ]+$", ""), SPACES, "-")


def question_ref(label: Column) -> Column:
    """A label's number: letters and digits only, without a leading "question" or "q"; blank unless it starts with a digit."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(or_blank(label)), r"[^\p{L}\p{Nd}]", ""), "^(question|q)", "")
    return F.when(bare.rlike(r"^\p{Nd}"), bare).otherwise("")


def question_no(label: Column, otherwise: Column) -> Column:
    found = F.regexp_extract(or_blank(label), r"(?i)q\.?\s*([0-9]+)", 1)
    return F.coalesce(found.try_cast("long"), otherwise.cast("long"))


def scoped_id(scope: Column, name: Column) -> Column:
    """``name`` made safe and prefixed by ``scope`` once, however often it is applied."""
    safe = F.regexp_replace(trim_ws(or_blank(name)), "[^A-Za-z0-9_-]+", "-")
    prefix = F.concat(scope, F.lit("-"))
    return F.when(safe.startswith(prefix), safe).otherwise(F.concat(prefix, safe))


def safe_stem(name: Column) -> Column:
    """A file name without its last extension as a lower-case slug of at most 96 bytes, without hyphens at its ends; may be empty."""
    stem = F.regexp_replace(F.lower(trim_ws(or_blank(name))), r"\.[^./]*$", "")
    bare = lambda c: F.regexp_replace(c, "^-+|-+$", "")
    return bare(F.left(bare(F.regexp_replace(stem, "[^a-z0-9]+", "-")), F.lit(96)))


def slug_words(text: Column, forbidden: list[str], most: int = 8) -> Column:
    """The first ``most`` lower-case words that aren't forbidden, joined by hyphens."""
    words = F.filter(F.split(F.lower(or_blank(text)), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(forbidden))
    return F.array_join(F.slice(words, 1, most), "-")


def sanitize_name(name: Column) -> Column:
    return trim_ws(F.regexp_replace(or_blank(name), r"[\\/:*?\"<>|\x00-\x1f]", ""))


def first_bytes(text: Column, n: int) -> Column:
    """The first n bytes; a code point cut in two becomes the replacement character."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), 1, n), "UTF-8")


def compact_note(path: Column, content: Column, limit: int) -> Column:
    """``PATH: path`` and the content, cut to ``limit`` bytes with a mark."""
    body = trim_ws(or_blank(content))
    cut = F.when(F.octet_length(body) > limit, F.concat(first_bytes(body, limit), F.lit("\n[truncated]"))).otherwise(body)
    return F.concat(F.lit("PATH: "), path, F.lit("\n"), cut)


def split_lines(text: Column) -> Column:
    return F.split(F.regexp_replace(or_blank(text), r"\n\z", ""), "\n")


def numbered(text: Column) -> Column:
    """Each line after its number, four wide."""
    return F.array_join(F.transform(split_lines(text), lambda line, i: F.format_string("%4d | %s", i + 1, line)), "\n")


def newlines(text: Column) -> Column:
    return trim_ws(F.regexp_replace(or_blank(text), r"\r\n?", "\n"))


def front_matter(text: Column) -> Column:
    """The YAML block between the first two ``---`` lines; blank if there is none."""
    return F.regexp_extract(or_blank(text), r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)", 1)


def without_front_matter(text: Column) -> Column:
    return F.regexp_replace(or_blank(text), r"(?s)\A---[ \t]*\r?\n(?:.*?\r?\n)?---[ \t]*(?:\r?\n|\z)", "")


def plain_style(text: Column) -> Column:
    """``**x**::`` as ``**x**:``, and snake_case words as separate words."""
    return F.regexp_replace(F.regexp_replace(or_blank(text), r"(\*\*[^*\n]+\*\*)::", "$1:"), r"(?<=[A-Za-z0-9])_(?=[A-Za-z0-9])", " ")


def json_object(text: Column) -> Column:
    """The outermost ``{...}`` of a reply, fences stripped, if it is valid JSON; else null."""
    body = F.regexp_extract(or_blank(text), r"(?s)\{.*\}", 0)
    return F.when((body != "") & F.try_parse_json(body).isNotNull(), body)


def ocr_clean(text: Column) -> Column:
    """OCR output without detector tags, boxes and the truncation mark."""
    out = F.regexp_replace(or_blank(text), r"(?s)<\|(?:ref|det)\|>.*?<\|/(?:ref|det)\|>", "")
    out = F.regexp_replace(out, r"\[\[\s*\d+(?:\s*,\s*\d+){3}\s*\]\]", "")
    out = F.regexp_replace(F.regexp_replace(out, r"\$?\\rightarrow\$?|→", "->"), r"(?i)\[truncated\]\s*$", "")
    return trim_ws(out)


def layout_block(line: Column) -> Column:
    """struct<kind, x0, y0, x1, y1, text> of a line ``kind[[x0, y0, x1, y1]] text``; null fields where it isn't one."""
    pattern = r"^\s*(\w+)\s*\[\[\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\]\]\s*(.*)$"
    part = lambda k: F.nullif(F.regexp_extract(or_blank(line), pattern, k), F.lit(""))
    numbers = [part(k).try_cast("long").alias(name) for k, name in zip(range(2, 6), ("x0", "y0", "x1", "y1"), strict=True)]
    return F.struct(part(1).alias("kind"), *numbers, part(6).alias("text"))


def tagged_blocks(text: Column, tag: str = "OCR_PAGE") -> Column:
    """map<name, body> of the text between ``<!-- TAG name -->`` marks; of equal names the last stays."""
    parts = F.slice(F.split(or_blank(text), rf"<!--\s*{tag}\s+"), 2, 1 << 30)
    entry = lambda p: F.struct(F.regexp_extract(p, r"(?s)^(.*?)\s*-->", 1), trim_ws(F.regexp_replace(p, r"(?s)^.*?-->", "")))
    entries = F.transform(parts, entry)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, 1 << 30), lambda other: other["col1"] == e["col1"]))
    return F.map_from_entries(last)


def hash_text(text: Column) -> Column:
    return F.sha2(or_blank(text), 256)


def hash_id(prefix: str, *parts: Column) -> Column:
    """``prefix-`` and the first 16 hex digits of the SHA-256 of the parts, joined by colons."""
    return F.concat(F.lit(prefix + "-"), F.left(F.sha2(F.concat_ws(":", *parts), 256), F.lit(16)))


def hash_folder(path: Column) -> Column:
    return F.left(F.sha1(path), F.lit(12))


def folder_key(path: Column) -> Column:
    """A data folder's name: the path's last part, made safe, and 16 hex digits of its hash."""
    name = F.regexp_replace(F.regexp_extract(path, r"([^/]+)/*$", 1), "[^A-Za-z0-9._-]+", "-")
    return F.concat(name, F.lit("-"), F.left(F.sha2(path, 256), F.lit(16)))


def base_name(path: Column) -> Column:
    return F.regexp_extract(or_blank(path), r"([^/]+)/*$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(or_blank(path), r"(\.[^./]*)$", 1))


def phone(number: Column) -> Column:
    """Digits of a phone number; null unless there are 8 to 15 and nothing but digits, ``+ - ( )`` and blanks."""
    digits = F.regexp_replace(or_blank(number), "[^0-9]", "")
    fine = or_blank(number).rlike(r"^[0-9+\-() ]*$") & F.length(digits).between(8, 15)
    return F.when(fine, digits)


def prompt_halves(text: Column) -> Column:
    """A template whose two halves are equal, as one half."""
    whole = trim_ws(or_blank(text))
    half = (F.length(whole) / 2).cast("int")
    left, right = trim_ws(F.left(whole, half)), trim_ws(F.substr(whole, half + 1))
    return F.when((F.length(whole) > 1) & (left == right), left).otherwise(whole)


def json_escaped(text: Column) -> Column:
    """Text as a JSON string literal in the form that also escapes ``<``, ``>``, ``&``, U+2028 and U+2029."""
    out = F.regexp_replace(text, r"\\", r"\\\\")
    for raw, escaped in (('"', r'\\"'), ("\n", r"\\n"), ("\r", r"\\r"), ("\t", r"\\t"), ("\b", r"\\b"), ("\f", r"\\f")):
        out = F.regexp_replace(out, raw if raw != "\b" else "\\x08", escaped)
    for raw in ("<", ">", "&", " ", " ", *map(chr, [*range(8), 11, *range(14, 32)])):
        out = F.regexp_replace(out, f"\\x{{{ord(raw):04x}}}", f"\\\\u{ord(raw):04x}")
    return F.concat(F.lit('"'), out, F.lit('"'))


def style_time(ms: Column) -> Column:
    """Milliseconds as ``HH:MM:SS,mmm``."""
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, (ms % 1000).cast("long"))


def parse_time(text: Column) -> Column:
    """Milliseconds of ``HH:MM:SS,mmm`` (or with a point); null if it is neither."""
    part = lambda k: F.nullif(F.regexp_extract(or_blank(text), r"^\s*(\d+):(\d{1,2}):(\d{1,2})[,.](\d{1,3})\s*$", k), F.lit(""))
    fraction = F.rpad(part(4), 3, "0").try_cast("long")
    return ((part(1).try_cast("long") * 60 + part(2).try_cast("long")) * 60 + part(3).try_cast("long")) * 1000 + fraction


def subtitle_plain(text: Column) -> Column:
    """A subtitle file's words: lines that are neither a counter, a time range nor blank, joined by blanks."""
    lines = F.transform(F.split(or_blank(text), r"\r?\n"), trim_ws)
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^\d+$") & ~x.contains("-->")), " ")


def strings_distinct(values: Column) -> Column:
    """Trimmed, blanks dropped, distinct in order."""
    return F.array_distinct(F.filter(F.transform(values, trim_ws), lambda v: v != ""))


def strings_distinct_ci(values: Column, most: int | None = None) -> Column:
    """Like ``strings_distinct`` without regard to case; the first spelling stays."""
    trimmed = F.filter(F.transform(values, trim_ws), lambda v: v != "")
    lowered = F.transform(trimmed, F.lower)
    first = F.filter(trimmed, lambda v, i: F.array_position(lowered, F.lower(v)) == i + 1)
    return first if most is None else F.slice(first, 1, most)


def page_union(*pages: Column) -> Column:
    """Sorted distinct positive page numbers."""
    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.array(*pages)), lambda p: p > 0)))


def contains_all(a: Column, b: Column) -> Column:
    return F.size(F.array_except(b, a)) == 0


def first_forbidden(text: Column, words: list[str], pairs: list[str]) -> Column:
    """The first forbidden word or pair of neighbouring words; null if there is none."""
    tokens = F.filter(F.split(F.lower(or_blank(text)), r"[^\p{L}\p{Nd}]+"), lambda t: t != "")
    two = F.zip_with(tokens, F.slice(tokens, 2, 1 << 30), lambda a, b: F.concat_ws(" ", a, b))
    hits = F.flatten(F.transform(F.arrays_zip(tokens.alias("t"), two.alias("p")), lambda z: F.array(z["t"], z["p"])))
    return F.get(F.filter(hits, lambda h: h.isin([*words, *pairs])), F.lit(0))


def ocr_failed(text: Column) -> Column:
    return trim_ws(or_blank(text)).startswith("> OCR failed for this page:")


#: What marks a server's error page, wherever it stands; fixed list.
ERROR_PAGE = ["<html", "</body>", "internal server error"]
#: What marks an error that another try may mend; fixed list.
TRANSIENT = ["429", "too many requests", "rate limit", "500", "502", "503", "504", "timeout", "temporarily unavailable"]
#: How the end of a job by its caller or by its deadline is worded; fixed list.
CANCELLED = ["context canceled", "context deadline exceeded"]


def contains_any(low: Column, terms: list[str]) -> Column:
    """Whether a lower-case text contains one of ``terms``."""
    hit = F.lit(False)
    for term in terms:
        hit = hit | low.contains(term)
    return hit


def error_page(text: Column) -> Column:
    return contains_any(F.lower(or_blank(text)), ERROR_PAGE)


def failure_kind(error: Column) -> Column:
    """cancelled (by the caller or a deadline), transient or permanent; null for no error."""
    low = F.lower(or_blank(error))
    return (
        F.when(is_blank(error), F.lit(None).cast("string"))
        .when(contains_any(low, CANCELLED), "cancelled")
        .when(contains_any(low, TRANSIENT), "transient")
        .otherwise("permanent")
    )
