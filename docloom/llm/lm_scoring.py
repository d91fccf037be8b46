"""Language-model scores: causal self-attention over subword ids, trained in numpy, and a unigram base over words."""

from __future__ import annotations

import base64
import copy
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import discard, fold, in_groups, materialize, read, text_or_empty

#: Public byte-level BPE vocabulary: lines of a base64 token and its rank. Read on the driver, sent to the tasks.
VOCABULARY_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Each block of STRIDE tokens is scored once, seeing itself and the STRIDE tokens before.
STRIDE, DIMENSIONS = 16, 16
#: The most frequent subwords have a class each; the others share classes by their first bytes.
OWN_CLASSES, SHARED_CLASSES = 160, 48
#: Classes of a group: a class's probability is that of its group times its own within the group.
GROUP_CLASSES = 16
#: Averaged passes, each over its own share of each training document's blocks and from the weights of the one before.
ROUNDS = 2
#: Windows of one step, targets of each (all), and windows that a trainer holds and shuffles at once.
STEP_WINDOWS, TARGETS, HELD_WINDOWS = 256, STRIDE, 16_384
EMBEDDING_PARTS = 16
#: Tokens of a trainer, in the mean, by which the salts of the averages are chosen.
TOKENS_A_TRAINER = 4_000_000
#: Bytes of texts that are split at once, into subwords and to be scored.
LEARNED_BYTES, SCORED_BYTES = 8_000_000, 4_000_000
#: Frequent words sent to every task at most; the other words' counts are joined.
SENT_WORDS = 300_000
#: Words whose subwords a task remembers before it begins anew.
REMEMBERED = 200_000


class Subwords:
    """Words to subword ids, remembered; the id past the vocabulary ends a text, and the next one pads."""

    def __init__(self, ranks: dict[bytes, int]):
        self.encoding = tiktoken.Encoding("words", pat_str=" [^ ]+", mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.opens = np.zeros(self.end, bool)
        self.opens[[i for t, i in ranks.items() if t.startswith(b" ")]] = True
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.pool, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all ``words`` in order, how many each has); a word is encoded with a space before it, and holds none."""
        if len(self.at) > REMEMBERED:
            self.forget()
        which = np.fromiter((self.at.get(w, -1) for w in words), np.int64, len(words))
        fresh = [words[i] for i in np.flatnonzero(which < 0).tolist()]
        if fresh:
            flat = self.encoding.encode_to_numpy(" " + " ".join(fresh), disallowed_special=()).astype(np.int64)
            first = np.flatnonzero(self.opens[flat])
            which[which < 0] = new = np.arange(len(self.sizes), len(self.sizes) + len(fresh))
            self.at.update(zip(fresh, new.tolist(), strict=True))
            self.pool, self.sizes = np.concatenate((self.pool, flat)), np.concatenate((self.sizes, np.diff(np.append(first, len(flat)))))
        return spread(self.pool, self.sizes, which), self.sizes[which]


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, their index for each word of all ``texts`` in order, words of each text), A-Z lower-cased."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, owner = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.not_equal(words, "")
    coded = words.filter(some).dictionary_encode()
    counts = np.bincount(owner.filter(some).to_numpy(zero_copy_only=False), minlength=len(texts))
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), counts


def listed(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


def spread(values: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of ``values`` (of ``sizes``, one after the other) that ``which`` names, one after the other."""
    n = sizes[which]
    ends = np.cumsum(n)
    return values[np.repeat((np.cumsum(sizes) - sizes)[which] - ends + n, n) + np.arange(n.sum())]


def by_size(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of their column ``text``, a longer text alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
        for some in in_groups(sizes, most):
            yield batch.slice(some.start, some.stop - some.start)


def laid_out(texts: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, block starts, owner of each block) of texts of ids.

    A text's inputs are a start, which is the end id, and its ids; its targets are its ids and the end. STRIDE paddings
    (id end + 1) go before each text and up to STRIDE after; a block's keys start at its block start, its queries STRIDE on.
    """
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    blocks = -(-sizes // STRIDE)
    room = (blocks + 1) * STRIDE
    begin = np.cumsum(room) - room
    inputs = np.full(room.sum(), end + 1, np.int64)
    targets = np.full(room.sum(), -1, np.int64)
    for b, t in zip((begin + STRIDE).tolist(), texts, strict=True):
        inputs[b] = end
        inputs[b + 1 : b + 1 + len(t)] = t
        targets[b : b + len(t)] = t
        targets[b + len(t)] = end
    owner = np.repeat(np.arange(len(texts)), blocks)
    starts = np.repeat(begin, blocks) + STRIDE * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    return inputs, targets, starts, owner


def exponents(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exp of ``s``, sums of its rows); rows are shifted by their maximum where exp would leave its range without it."""
    each = np.ones(s.shape[-1], s.dtype)
    with np.errstate(over="ignore"):
        p = np.exp(s)
        total = p.reshape(-1, len(each)) @ each
    if len(total) and not (total.min() > 1e-30 and total.max() < 1e30):
        np.exp(s - s.max(axis=-1, keepdims=True), out=p)
        total = p.reshape(-1, len(each)) @ each
    return p, total


def in_shares(s: np.ndarray) -> np.ndarray:
    """exp of ``s`` as shares of its rows."""
    p, total = exponents(s)
    p *= (1 / total).reshape(*s.shape[:-1], 1)
    return p


class Attention:
    """One head of causal self-attention with distance biases, and a softmax over groups of subword classes, then over a group's.

    The probability of a class is that of its group times its own within the group, so a place costs the groups and one
    group's classes, not all. Columns of ``u`` and ``b``: the classes, GROUP_CLASSES a group, then the groups.
    """

    def __init__(self, ids: int, classes: int, seed: int = 23):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.classes, self.groups = classes, -(-classes // GROUP_CLASSES)
        self.e = rng.normal(0, 0.3, (ids, DIMENSIONS)).astype(f)
        self.a = (np.eye(DIMENSIONS) + rng.normal(0, 0.1, (DIMENSIONS, DIMENSIONS))).astype(f)
        self.r = np.zeros(2 * STRIDE, f)
        self.u = rng.normal(0, 0.1, (2 * DIMENSIONS, classes + self.groups)).astype(f)
        self.b = np.zeros(classes + self.groups, f)
        i, j = np.arange(STRIDE)[:, None] + STRIDE, np.arange(2 * STRIDE)[None]
        self.distance, self.mask = np.clip(i - j, 0, None), np.where(j <= i, 0, -1e9).astype(f)

    def columns(self, group: int) -> slice:
        """The columns of a group's classes; the last group may have fewer than GROUP_CLASSES."""
        return slice(group * GROUP_CLASSES, min((group + 1) * GROUP_CLASSES, self.classes))

    def by_group(self, classes: np.ndarray):
        """(places of ``classes`` by group, groups and classes within them in that order, the run of each group and its columns)."""
        group = np.maximum(classes, 0).astype(np.uint16) // np.uint16(GROUP_CLASSES)
        order = np.argsort(group, kind="stable")
        ends = [0, *np.cumsum(np.bincount(group, minlength=self.groups)).tolist()]
        runs = [(slice(at, to), self.columns(k)) for k, (at, to) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if to > at]
        return order, group.take(order), classes.take(order) % GROUP_CLASSES, runs

    def within(self, wide: np.ndarray, last: np.ndarray, runs: list[tuple[slice, slice]]) -> np.ndarray:
        """What the classes of its own group get at each place of ``wide``; a class that a group hasn't gets as good as no share."""
        z = np.empty((len(wide), GROUP_CLASSES), wide.dtype)
        for own, columns in runs:
            n = columns.stop - columns.start
            np.matmul(wide[own], last[:, columns], out=z[own, :n])
            z[own, n:] = -1e9
        return z

    def seen(self, keys: np.ndarray, pad: int):
        """(vectors, those of the places, queries, exp of attention, its sums, what is seen) for ``keys``: the ids a block sees, 2 * STRIDE each."""
        x = self.e.take(keys, axis=0)
        own = x[:, STRIDE:].reshape(-1, DIMENSIONS)
        q = (own @ (self.a * x.dtype.type(DIMENSIONS**-0.5))).reshape(-1, STRIDE, DIMENSIONS)
        s = q @ x.transpose(0, 2, 1)
        s += self.r[self.distance] + self.mask
        s[keys[:, 0] == pad, :, :STRIDE] = -1e9  # paddings before a text fill the first half of its first block
        p, total = exponents(s)
        seen = (p @ x).reshape(-1, DIMENSIONS)
        seen /= total[:, None]
        return x, own, q, p, total, seen

    def forward(self, keys: np.ndarray, pad: int):
        """(probabilities of all classes at each place, and what ``seen`` finds) for ``keys``."""
        found = self.seen(keys, pad)
        z = np.concatenate((found[1], found[-1]), axis=1) @ self.u + self.b
        of_group = in_shares(z[:, self.classes :])
        return np.concatenate([in_shares(z[:, self.columns(k)]) * of_group[:, k, None] for k in range(self.groups)], axis=1), found

    def logs(self, inputs: np.ndarray, classes: np.ndarray, pad: int, step: int = 128) -> np.ndarray:
        """Natural log of the probability of each target class along ``inputs``; that of -1 means nothing.

        ``inputs`` are texts as ``laid_out`` puts them; every STRIDE of them is a block that sees itself and the STRIDE before,
        so blocks are views of one array, and each target is scored once. The first STRIDE have no block of their own.
        """
        n, blocks = STRIDE, len(inputs) // STRIDE - 1
        padded = inputs[: -n : n] == pad  # paddings before a text fill the STRIDE before its first block
        bias = self.r[self.distance] + self.mask
        out = np.zeros(len(inputs))
        wide = np.ones((step * n, 2 * DIMENSIONS + 1), np.float32)  # the last column is the bias's
        rows = np.arange(step * n)
        last, each_key = np.vstack((self.u, self.b)), np.ones(2 * n, np.float32)
        of_group, each_group, each_class = last[:, self.classes :].copy(), np.ones(self.groups, np.float32), np.ones(GROUP_CLASSES, np.float32)
        asked = self.a * np.float32(DIMENSIONS**-0.5)

        def log_shares(z: np.ndarray, which: np.ndarray, each: np.ndarray) -> np.ndarray:
            if z.max() > 80:
                z -= z.max(axis=1, keepdims=True)
            got = z[rows[: len(z)], which]
            return got - np.log(np.exp(z, out=z) @ each)

        for k in range(0, blocks, step):
            to = min(k + step, blocks)
            x = self.e.take(inputs[k * n : (to + 1) * n], axis=0)  # a step's vectors at a time, which stay in the cache
            keys = np.lib.stride_tricks.sliding_window_view(x, 2 * n, axis=0)[::n].transpose(0, 2, 1)
            q = x[n:] @ asked
            for shifted in (False, True):  # by the row's maximum, where exp would leave its range without it
                s = q.reshape(to - k, n, DIMENSIONS) @ keys.transpose(0, 2, 1)
                s += bias
                s[padded[k:to], :, :n] = -1e9
                if shifted:
                    s -= s.max(axis=2, keepdims=True)
                elif s.max() > 80:
                    continue
                np.exp(s, out=s)
                shares = s.reshape(-1, 2 * n) @ each_key
                if shifted or shares.min() > 1e-30:
                    break
            seen = (s @ keys).reshape(-1, DIMENSIONS)
            seen /= shares[:, None]
            order, group, place, runs = self.by_group(classes[(k + 1) * n : (to + 1) * n])
            both = wide[: len(seen)]
            both[:, :DIMENSIONS], both[:, DIMENSIONS:-1] = x[n:].take(order, axis=0), seen.take(order, axis=0)
            out[(k + 1) * n + order] = log_shares(both @ of_group, group, each_group) + log_shares(self.within(both, last, runs), place, each_class)
        return out

    def step(self, keys: np.ndarray, classes: np.ndarray, pad: int, memory: dict, rate: float) -> None:
        """One Adagrad step on blocks ``keys`` with the target ``classes`` of all their places (-1: none)."""
        x, own, q, p, total, seen = self.seen(keys, pad)
        goal = classes.ravel()
        order, group, place, runs = self.by_group(goal)
        wide = np.ones((len(order), 2 * DIMENSIONS + 1), x.dtype)  # places by group; the last column is the bias's
        wide[:, :DIMENSIONS], wide[:, DIMENSIONS:-1] = own.take(order, axis=0), seen.take(order, axis=0)
        last, every = np.vstack((self.u, self.b)), np.arange(len(order))
        d_group, d = in_shares(wide @ last[:, self.classes :].copy()), in_shares(self.within(wide, last, runs))
        d_group[every, group] -= 1
        d[every, place] -= 1
        none = goal.take(order) < 0
        if none.any():
            d_group[none] = d[none] = 0
        each = 1 / max(1, len(goal) - np.count_nonzero(none))
        slope = np.zeros_like(last)
        slope[:, self.classes :] = (d_group.T @ wide).T
        sorted_back = d_group @ self.u[:, self.classes :].T
        for some, columns in runs:
            d_own = d[some, : columns.stop - columns.start]
            slope[:, columns] = (d_own.T @ wide[some]).T
            sorted_back[some] += d_own @ self.u[:, columns].T
        back = np.empty_like(sorted_back)
        back[order] = sorted_back
        d_seen = (back[:, DIMENSIONS:] / total[:, None]).reshape(q.shape)
        d_s = d_seen @ x.transpose(0, 2, 1)
        d_s -= np.einsum("wid,wid->wi", d_seen, seen.reshape(q.shape))[:, :, None]
        d_s *= p
        d_q = (d_s @ x).reshape(-1, DIMENSIONS)
        d_x = p.transpose(0, 2, 1) @ d_seen
        d_x += d_s.transpose(0, 2, 1) @ q
        unit = x.dtype.type(DIMENSIONS**-0.5)
        d_own = d_q @ (self.a.T * unit)
        d_own += back[:, :DIMENSIONS]
        d_x[:, STRIDE:] += d_own.reshape(q.shape)
        slope_r = np.bincount(self.distance.ravel(), d_s.sum(axis=0).ravel(), minlength=2 * STRIDE)
        for name, g in {"u": slope[:-1], "b": slope[-1], "a": own.T @ d_q * unit, "r": slope_r}.items():
            g = g * each
            memory[name] = memory.get(name, 1e-6) + g * g
            setattr(self, name, (getattr(self, name) - rate * g / np.sqrt(memory[name])).astype(self.e.dtype))
        met = np.zeros(len(self.e), bool)
        met[keys] = True
        some = np.flatnonzero(met)
        slot = np.empty(len(self.e), np.int64)
        slot[some] = np.arange(len(some)) * (DIMENSIONS // 2)
        cell = slot.take(keys)[:, :, None] + np.arange(DIMENSIONS // 2)
        g = np.zeros(len(some) * DIMENSIONS, x.dtype)
        pairs = np.result_type(x.dtype, np.complex64)  # two numbers are added at once
        np.add.at(g.view(pairs), cell.ravel(), d_x.ravel().view(pairs))
        g = g.reshape(-1, DIMENSIONS) * x.dtype.type(each)
        if "e" not in memory:
            memory["e"] = np.full(len(self.e), 1e-6, np.float32)
        memory["e"][some] += (g * g).mean(axis=1)
        self.e[some] -= rate * g / np.sqrt(memory["e"][some])[:, None]

    @property
    def rest(self) -> np.ndarray:
        """All weights but the embeddings, in a row."""
        return np.concatenate([getattr(self, name).ravel() for name in ("a", "r", "u", "b")])

    @rest.setter
    def rest(self, values: np.ndarray) -> None:
        k = 0
        for name in ("a", "r", "u", "b"):
            own = getattr(self, name)
            setattr(self, name, values[k : k + own.size].reshape(own.shape).astype(np.float32))
            k += own.size


def scores(model: Attention, class_of: np.ndarray, inside: np.ndarray, texts: list[np.ndarray], end: int) -> np.ndarray:
    """log10 probability of each text of ids: that of each token's class, and of the token within its class."""
    inputs, targets, starts, owner = laid_out(texts, end)
    real = np.flatnonzero(targets >= 0)
    logs = model.logs(inputs, class_of[targets], end + 1)[real] / np.log(10) + inside[targets[real]]
    block = np.full(len(inputs) // STRIDE, -1)
    block[starts // STRIDE + 1] = owner
    return np.bincount(np.repeat(block, STRIDE)[real], logs, minlength=len(texts))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def narrow_type(end: int):
    return np.uint16 if end + 2 <= 1 << 16 else np.int32


def encoded(texts: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(word, id, n, text, learn, row, doc_id, whole): ``texts(doc_id, text)`` in words and subwords, read once and written.

    Rows with a word: how often a batch of texts to learn from has it. Rows with an id: how often a task has that subword in
    such texts. Rows with a text: a text's subword ids, whether to learn from it, and its row, doc_id and whole text as
    given. ``texts`` may have columns ``learn`` (all without it) and ``row`` (null without it).
    """
    sent, end = texts.sparkSession.sparkContext.broadcast(ranks), len(ranks)
    learn = F.coalesce(F.col("learn"), F.lit(False)) if "learn" in texts.columns else F.lit(True)
    row_of = F.col("row") if "row" in texts.columns else F.lit(None)
    doc_id = texts.schema["doc_id"].dataType

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = Subwords(sent.value)
        total, kind = np.zeros(end, np.int64), narrow_type(end)
        types = {"word": pa.string(), "id": pa.int64(), "n": pa.int64(), "text": pa.binary(), "learn": pa.bool_(), "row": pa.int64(), "doc_id": pa.null(), "whole": pa.string()}
        rows = lambda size, **columns: pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size, t) for c, t in types.items()], list(types))
        for batch in by_size(it, LEARNED_BYTES):
            types["doc_id"] = batch.column("doc_id").type
            distinct, which, counts = split_words(batch.column("text"))
            learned = batch.column("learn").to_numpy(zero_copy_only=False)
            ids, sizes = subwords.ids(listed(distinct))
            flat, owner = spread(ids, sizes, which), np.repeat(np.arange(len(counts)), counts)
            own = np.bincount(owner, sizes[which], minlength=len(counts)).astype(np.int64)
            n = np.bincount(which[learned[owner]], minlength=len(distinct))
            met = np.flatnonzero(n)
            yield rows(len(met), word=distinct.take(pa.array(met)), n=pa.array(n[met]))
            total += np.bincount(flat[np.repeat(learned, own)], minlength=len(total))
            parts = [x.astype(kind).tobytes() for x in np.split(flat, np.cumsum(own)[:-1])]
            yield rows(len(counts), text=pa.array(parts, pa.binary()), learn=batch.column("learn"), row=batch.column("row"), doc_id=batch.column("doc_id"), whole=batch.column("text"))
        some = np.flatnonzero(total)
        if len(some):
            yield rows(len(some), id=pa.array(some), n=pa.array(total[some]))

    given = texts.select(text_or_empty().alias("text"), learn.alias("learn"), row_of.cast("long").alias("row"), "doc_id")
    return materialize(given.mapInArrow(batches, f"word string, id long, n long, text binary, learn boolean, row long, doc_id {doc_id.simpleString()}, whole string"))


def class_tables(n: np.ndarray, ranks: dict[bytes, int], texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(class, log10 of the share within its class) of each subword and of the end."""
    first = np.zeros(len(n), np.int64)
    for token, i in ranks.items():
        some = token.lstrip(b" ")[:2]
        first[i] = (len(token) - len(token.lstrip(b" "))) * 7 + sum(c * 31**k for k, c in enumerate(some))
    class_of = np.append(OWN_CLASSES + first % SHARED_CLASSES, 0)
    frequent = np.lexsort((np.arange(len(n)), -n))[: OWN_CLASSES - 1]
    class_of[frequent] = 1 + np.arange(len(frequent))
    share = np.append(n, texts) + 0.5
    return class_of, np.log10(share / np.bincount(class_of, share)[class_of])


def windows_of(texts: list[np.ndarray], end: int, turn: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, places, goals) of a round's training windows: blocks that ask, each with the block before it.

    A text's blocks take turns over the ``rounds``, from its ``turn`` on, which grows by one a round: after all rounds each
    block has asked once. A window asks at all places; those past the end of its text repeat the last that has a target.
    """
    inputs, targets, starts, owner = laid_out(texts, end)
    nth = np.arange(len(starts)) - np.searchsorted(owner, np.arange(len(texts)))[owner]
    starts = starts[nth % rounds == turn[owner] % rounds]
    keys = inputs[starts[:, None] + np.arange(2 * STRIDE)]
    goals = targets[starts[:, None] + STRIDE + np.arange(STRIDE)]
    at = np.minimum(np.arange(TARGETS), (goals >= 0).sum(axis=1)[:, None] - 1)
    return keys, at, np.take_along_axis(goals, at, 1)


def train(encoded_texts: DataFrame, ranks: dict, class_of: np.ndarray, rounds: int = ROUNDS) -> Attention:
    """Attention weights from all of ``encoded_texts(text)``, texts of ids.

    Each round trains on its own share of each text's blocks, by turns that begin at a hash, and starts from the weights of
    the round before; the rounds together ask at every place of every text once. Each task is a trainer that streams the windows of its texts, so nothing is shuffled but weights; Spark averages them in
    parts and salts, embeddings by how often a trainer saw the subword.
    """
    spark, classes, end = encoded_texts.sparkSession, OWN_CLASSES + SHARED_CLASSES, len(ranks)
    kind = narrow_type(end)
    tokens = encoded_texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    salts = max(1, math.isqrt(tokens // np.dtype(kind).itemsize // TOKENS_A_TRAINER))
    model = Attention(end + 2, classes)

    def round_of(model: Attention, nth: int) -> Attention:
        sent = spark.sparkContext.broadcast(cloudpickle.dumps((model, class_of)))  # classes travel by value

        def fit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, class_of = pickle.loads(sent.value)
            memory, rng = {}, np.random.default_rng(31 + nth)
            seen, n, held = np.zeros(end + 2), 0, []

            def learn() -> None:
                keys, at, goals = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                classes = np.where(at == np.arange(TARGETS), class_of[goals], -1)  # a place that is repeated counts once
                for some in np.array_split(rng.permutation(len(keys)), -(-len(keys) // STEP_WINDOWS)):
                    own.step(keys[some], classes[some], end + 1, memory, 0.2 / (1 + nth))
                np.add(seen, np.bincount(keys.ravel(), minlength=len(seen)), out=seen)

            waiting = 0
            for batch in it:
                texts, turns = batch.column("text").to_pylist(), batch.column("turn").to_numpy()
                for some in in_groups([len(t) for t in texts], 2_000_000):
                    found = windows_of([np.frombuffer(t, kind).astype(np.int64) for t in texts[some]], end, turns[some] + nth, rounds)
                    held.append(found)
                    waiting += len(found[0])
                    n += len(found[0])
                    if waiting >= HELD_WINDOWS:
                        learn()
                        waiting = 0
            if waiting:
                learn()
            salt, out = TaskContext.get().partitionId() % salts, []
            if n:
                for k in range(EMBEDDING_PARTS):  # only what was seen moved
                    at = np.flatnonzero(seen[k::EMBEDDING_PARTS]).astype(np.int32)
                    w = seen[k::EMBEDDING_PARTS][at].astype(np.float32)[:, None]
                    out.append((k, salt, at.tobytes(), (own.e[k::EMBEDDING_PARTS][at] * w).tobytes(), w.tobytes()))
                out.append((EMBEDDING_PARTS, salt, np.zeros(1, np.int32).tobytes(), (own.rest * np.float32(n)).tobytes(), np.float32([n]).tobytes()))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "salt", "at", "sum", "weight"])

        def added(pdf: pd.DataFrame) -> pd.DataFrame:
            at = np.concatenate([np.frombuffer(a, np.int32) for a in pdf["at"]])
            every, place = np.unique(at, return_inverse=True)
            total = []
            for c in ("sum", "weight"):
                x = np.concatenate([np.frombuffer(b, np.float32) for b in pdf[c]]).astype(float).reshape(len(at), -1) if len(at) else np.zeros((0, 1))
                out = np.zeros((len(every), x.shape[1]))
                np.add.at(out, place, x)
                total.append(out.astype(np.float32).tobytes())
            return pd.DataFrame({"part": [pdf.part.iloc[0]], "salt": [int(pdf.salt.iloc[0])], "at": [every.astype(np.int32).tobytes()], "sum": [total[0]], "weight": [total[1]]})

        schema = "part int, salt int, at binary, sum binary, weight binary"
        turn = F.xxhash64("text").bitwiseAND(F.lit((1 << 31) - 1))
        fitted = encoded_texts.select("text", turn.alias("turn")).mapInArrow(fit, schema).groupBy("part", "salt").applyInPandas(added, schema)
        after = copy.deepcopy(model)
        for r in fitted.groupBy("part").applyInPandas(added, schema).collect():
            at, w = np.frombuffer(bytes(r["at"]), np.int32), np.frombuffer(bytes(r["weight"]), np.float32)[:, None]
            if not len(at):
                continue
            x = np.frombuffer(bytes(r["sum"]), np.float32).reshape(len(w), -1) / w
            if r.part < EMBEDDING_PARTS:
                after.e[r.part + EMBEDDING_PARTS * at] = x
            else:
                after.rest = x[0]
        return after

    for nth in range(rounds):
        model = round_of(model, nth)
    return model


def frequent_words(counts: DataFrame) -> dict[str, int]:
    """The most frequent words, SENT_WORDS at most: those above the lowest count, in steps of an eighth of an octave, that so many reach."""
    step = F.floor(F.log2("c") * 8).cast("int")
    reach = least = 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        reach += r["count"]
        if reach > SENT_WORDS:
            least = r.step + 1
            break
    return {r.word: r.c for r in counts.where(step >= least).collect()}


def score_texts(docs: DataFrame, training: DataFrame | Column, vocabulary_file: str = VOCABULARY_FILE) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each row of ``docs(doc_id, text)``.

    Texts are lower-cased (A-Z) and split into words; an end follows each. ``base_score`` sums log10((c + 0.5) /
    (N + 0.5 (V + 1))) over words and end by their counts in all of ``training(doc_id, text)``. ``score`` is the log10
    probability under the attention model: a class by attention over the subwords before, then the subword within its
    class by its count in all training texts. Null text counts as empty, which is an end only. With nothing to learn
    from, counts are zero and the model is as it starts. Repeated rows are scored alike, and each row of ``training``
    counts; further columns are ignored; an empty table gives no rows. Where ``training`` is a condition on ``docs``, each
    text is split into subwords once, to be learned from and to be scored.
    """
    spark, ranks = docs.sparkSession, load_ranks(vocabulary_file)
    end, among = len(ranks), isinstance(training, Column)
    given = docs.select("doc_id", "text", (training if among else F.lit(False)).alias("learn"), F.monotonically_increasing_id().alias("row"))
    if not among:
        given = given.unionByName(training.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", F.lit(True).alias("learn"), F.lit(None).cast("long").alias("row")))
    learned = encoded(given, ranks)
    counts = materialize(learned.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")))
    figures = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    ids = learned.where("text is not null and learn").select("text")
    texts = ids.count()
    total, distinct = (figures.n or 0) + texts, figures.v + (texts > 0)
    of_id = np.zeros(len(ranks), np.int64)
    for r in learned.where("id is not null").groupBy("id").agg(F.sum("n").alias("n")).collect():
        of_id[r.id] = r.n
    class_of, inside = class_tables(of_id, ranks, texts)
    model = train(ids, ranks, class_of)
    known = frequent_words(counts)
    all_known = len(known) == figures.v
    sent = spark.sparkContext.broadcast(cloudpickle.dumps((model, class_of, inside, known)))

    def logs(c):
        return np.log10((c + 0.5) / (total + 0.5 * (distinct + 1)))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, class_of, inside, known = pickle.loads(sent.value)
        kind = narrow_type(end)
        for batch in by_size(it, SCORED_BYTES):
            distinct, which, counts = split_words(batch.column("text"))
            words, n = listed(distinct), len(counts)
            c = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))  # -1: counted elsewhere, or nowhere
            if all_known:
                c = np.maximum(c, 0)
            owner, own = np.repeat(np.arange(n), counts), c[which]
            base = np.bincount(owner, np.where(own >= 0, logs(np.maximum(own, 0)), 0.0), minlength=n) + logs(texts)
            seen = np.bincount(owner, own > 0, minlength=n).astype(np.int64) + (texts > 0)
            pair, times = np.unique(owner[own < 0] * max(1, len(words)) + which[own < 0], return_counts=True)
            cuts = np.searchsorted(pair, np.arange(n + 1) * max(1, len(words))).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(cuts), distinct.take(pa.array(pair % max(1, len(words)))))
            often = pa.ListArray.from_arrays(pa.array(cuts), pa.array(times.astype(np.int64)))
            score = scores(model, class_of, inside, [np.frombuffer(x, kind) for x in batch.column("ids").to_pylist()], end)
            columns = [batch.column("doc_id"), batch.column("row"), pa.array(counts.astype(np.int64) + 1), pa.array(seen), pa.array(base), rare, often, pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n_tokens", "n_known", "base", "rare", "times", "score"])

    base = learned.where("row is not null").select("doc_id", "row", F.col("whole").alias("text"), F.col("text").alias("ids"))
    first = materialize(base.mapInArrow(batches, f"doc_id {dict(docs.dtypes)['doc_id']}, row long, n_tokens long, n_known long, base double, rare array<string>, times array<long>, score double"))
    discard(learned)
    here = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / (total + 0.5 * (distinct + 1)))
    # a rare word's row is met by at most one count; words frequent in the corpus never come here
    rest = first.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), F.col("r.times").alias("times"))
    rest = rest.join(counts, "word", "left").groupBy("row").agg(F.sum(F.col("times") * here).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times"))).alias("seen"))
    return first.join(rest, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = score_texts(docs, fold(5) != 1)
    return found.select("doc_id", (fold(5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
