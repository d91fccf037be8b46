"""Texts cut where no tokenizer of the kind used here can merge across, so that each distinct segment is tokenized once."""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docloom.llm.lm_scoring import listed, spread

#: Before a run of spaces that follows a character which no tokenizer takes for white space.
CUT = re.compile(r"(?<=[^\s\u180e])(?= )")
#: A space before other white space or the end. In texts without one, every space can be cut before.
_UNEVEN = " (?:[\t-\r\x1c-\x20\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|\\z)"
#: Segments whose ids a task remembers before it begins anew.
REMEMBERED = 1_000_000
#: Segments that are encoded in one call's text, between which nothing merges.
JOINED = 200


def segments(text: str) -> list[str]:
    """The segments of a text in order; joined, they are the text. An empty text has none."""
    return CUT.split(text) if text else []


def coded(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(segments, the index of each segment of all texts in order, segments of each text); a segment is listed twice at most.

    Where each space precedes something else than white space, texts are split at spaces with Arrow; the others by ``segments``.
    """
    uneven = pc.match_substring_regex(texts, _UNEVEN)
    parts = pc.split_pattern(texts.filter(pc.invert(uneven)), " ")
    bounds = parts.offsets.to_numpy().astype(np.int64)
    words, begin, n = parts.flatten(), bounds[:-1] - bounds[0], np.diff(bounds)
    own = np.ones(len(words), bool)
    own[begin] = False  # what stands before a text's first space
    after = words.filter(pa.array(own)).dictionary_encode()
    first = listed(words.take(pa.array(begin)))
    there = np.array([s != "" for s in first], bool)
    slow = [segments(t) for t in texts.filter(uneven).to_pylist()]
    other = pa.array([*filter(None, first), *(s for some in slow for s in some)], texts.type).dictionary_encode()
    distinct = [" " + s for s in listed(after.dictionary)] + listed(other.dictionary)
    late = other.indices.to_numpy(zero_copy_only=False).astype(np.int64) + len(after.dictionary)
    codes = np.full(len(words), -1, np.int64)
    codes[own], codes[begin[there]] = after.indices.to_numpy(zero_copy_only=False), late[: there.sum()]
    flat = np.concatenate((codes[codes >= 0], late[there.sum() :]))
    sizes = np.concatenate((n - ~there, np.fromiter(map(len, slow), np.int64, len(slow))))
    place = np.argsort(np.argsort(uneven.to_numpy(zero_copy_only=False), kind="stable"), kind="stable")
    return distinct, spread(flat, sizes, place), sizes[place]


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others for U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def byte_level(spec: str, plain: bool):
    """The byte-level tokenizer of a JSON file's content; ``plain``: the strings of special tokens are ordinary text.

    Cutting is safe if the split pattern is the usual one, in which nothing but white space takes in white space, and
    nothing is normalized or put before a text; a file that differs is refused.
    """
    from tokenizers import Tokenizer

    own = json.loads(spec)
    split = own["pre_tokenizer"] or {}
    if own["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError("this vocabulary may merge across the segments")
    if any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in own["added_tokens"]):
        raise ValueError("a special token takes in white space")
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks
    out = Tokenizer.from_str(spec)
    out.encode_special_tokens = plain
    return out


def byte_lengths(spec: str) -> np.ndarray:
    """Of each id of a byte-level vocabulary, the bytes that it stands for."""
    own = json.loads(spec)
    sizes = {i: len(t) for t, i in own["model"]["vocab"].items()} | {t["id"]: len(t["content"].encode()) for t in own["added_tokens"]}
    out = np.zeros(max(sizes) + 1, np.int64)
    out[list(sizes)] = list(sizes.values())
    return out


class Remembered:
    """Segments to the ids of a byte-level tokenizer, each distinct one encoded once while it is remembered."""

    def __init__(self, tokenizer, lengths: np.ndarray):
        self.tokenizer, self.lengths = tokenizer, lengths
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.pool, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64)

    def encoded(self, fresh: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments in order, how many each has). Those of a space and no more white space are encoded many in one text."""
        joins = [s[0] == " " and len(s) > 1 and not (s[1].isspace() or s[1] == "\u180e") for s in fresh]
        order, groups, k = [k for k, x in enumerate(joins) if x] + [k for k, x in enumerate(joins) if not x], [], sum(joins)
        of = [fresh[i] for i in order]
        groups = ["".join(of[i : min(i + JOINED, k)]) for i in range(0, k, JOINED)] + of[k:]
        flat = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(groups, add_special_tokens=False)]
        ids = np.concatenate(flat)
        ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(s.encode()) for s in of])) + 1
        sizes = np.diff(ends, prepend=0)
        back = np.argsort(order)
        return spread(ids, sizes, back), sizes[back]

    def places(self, distinct: list[str]) -> np.ndarray:
        """The place of each of the ``distinct`` segments among those remembered, whose ids ``pool`` and ``sizes`` hold."""
        if len(self.at) > REMEMBERED:
            self.forget()
        which = np.fromiter((self.at.get(s, -1) for s in distinct), np.int64, len(distinct))
        fresh = [distinct[k] for k in np.flatnonzero(which < 0).tolist()]
        if fresh:
            ids, sizes = self.encoded(fresh)
            new = np.arange(len(self.sizes), len(self.sizes) + len(fresh))
            which[which < 0] = new
            self.at.update(zip(fresh, new.tolist(), strict=True))
            self.pool, self.sizes = np.concatenate((self.pool, ids)), np.concatenate((self.sizes, sizes))
        return which
