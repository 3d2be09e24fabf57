"""Language-model scoring with a gated recurrent network in numpy.

Tokens are lower-cased words and an end. The output is class-factored: P(token) = P(class | state) P(slot | class,
state), with CLASSES classes of up to SLOTS - 1 frequent words; the last slot stands for the class's other words, which
follow their smoothed counts, so that all words and one unknown per class share a probability of one. A word's class
depends on its ending only; endings are dealt to classes by which documents they occur in together.

Counts are taken over all training documents. The most frequent words, at most FREQUENT, reach the executors by
broadcast, the counts of all others by a join over the rare tokens only, whatever their number. Every text is parted into
words twice: to count them, and to write them as codes of 16 bits (a frequent word, or the ending of a rare one), which
all later passes read. Weights start at the counts' unigram model; then each input partition runs truncated
backpropagation over its training documents, and the partitions' weights are averaged. That happens ROUNDS times, each
time with another of ROUNDS even parts of the training documents, so every one of them is learnt from once.
Documents are scored whole, many at a time in lanes; a document's state is carried across windows to its end. A chunk
of documents takes memory in proportion to its tokens (CHUNK, or one longer text), not to its longest text times lanes.

What is learnt depends on how the input is parted, since each partition learns by itself; on the same files it is the same.
Edge cases: null and empty texts are their end token; a null doc_id counts as an empty text in the hash; without
training documents every token is unknown; repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

CLASSES, SLOTS, HIDDEN, ENDINGS = 64, 32, 16, 4096
#: Codes of frequent words and of endings fit in 16 bits together.
FREQUENT = 60_000
ROUNDS = 2
#: Adam's step falls with the root of the number of updates over DECAY.
WINDOW, TRAIN_LANES, STEP, DECAY = 32, 256, 0.03, 10
LANES, SCORE_WINDOW, CHUNK = 512, 64, 2_000_000
#: Distinct words that a task counts before it passes them on.
COUNTED = 1 << 19
#: Partial sums of the partitions' weights that a task folds into one, and that reach the driver at once.
FOLD, AVERAGES = 16, 8
PROFILE = 64
#: Documents whose counts by ending are in memory at once.
PROFILED = 256
SEED = 9
END = b"\n"
_RARE = 0xFFFF
#: Tokens of a softmax at a time.
BLOCK = 1024
_PLACES, _ONES = np.arange(BLOCK), {c: np.ones(BLOCK, dtype=c) for c in "fd"}


def ending(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def tokens(text: str | None) -> list[bytes]:
    """bytes.lower() and bytes.split() know ASCII letters and white space only, as the contract does."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


@dataclass
class Vocabulary:
    """What is known of the counts: frequent words, and totals by ending."""

    words: list[bytes]
    counts: np.ndarray
    mass: np.ndarray  # training tokens by ending
    kinds: np.ndarray  # distinct training tokens by ending
    least: int  # words of this count or more are listed

    @property
    def total(self) -> int:
        return int(self.mass.sum())

    def endings(self) -> np.ndarray:
        """Ending of each code."""
        return np.concatenate([np.array([ending(w) for w in self.words], dtype=np.int64), np.arange(ENDINGS)])


class Encoder:
    """Words to codes; one per task. Rare words hardly come twice in a task, so nothing is kept of them."""

    def __init__(self, words: list[bytes]) -> None:
        self.get, self.first = dict(zip(words, range(len(words)))).get, len(words)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Codes, and the hashes of the rare words in order."""
        codes = np.fromiter(map(self.get, words, repeat(_RARE)), dtype=np.uint16, count=len(words))
        places = np.flatnonzero(codes == _RARE)
        rare = [words[i] for i in places.tolist()]
        codes[places] = self.first + np.fromiter(map(ending, rare), dtype=np.int64, count=len(rare))
        return codes, np.fromiter(map(xxhash.xxh64_intdigest, rare, repeat(42)), dtype=np.uint64, count=len(rare)).view(np.int64)


class Tables:
    """By code: slot, and log10 shares of all tokens and within the slot; a rare word's log10(c + 0.5) comes later."""

    def __init__(self, v: Vocabulary, class_of: np.ndarray) -> None:
        size, endings = len(v.words), v.endings()
        classes = class_of[endings]
        fold = lambda a: np.bincount(class_of, weights=a, minlength=CLASSES)
        rest, kinds, used = fold(v.mass), fold(v.kinds), np.zeros(CLASSES, dtype=np.int64)
        self.slot = (classes * SLOTS + SLOTS - 1).astype(np.int16)
        self.slot_count = np.zeros(CLASSES * SLOTS)
        own = np.zeros(size, dtype=bool)
        for i, c in enumerate(classes[:size]):
            if used[c] < SLOTS - 1:
                self.slot[i] = c * SLOTS + used[c]
                self.slot_count[self.slot[i]] = v.counts[i]
                own[i] = True
                used[c] += 1
                rest[c] -= v.counts[i]
                kinds[c] -= 1
        self.slot_count[SLOTS - 1 :: SLOTS] = rest
        self.open_slots = (np.arange(SLOTS) < used[:, None]) | (np.arange(SLOTS) == SLOTS - 1)
        log_rest = np.log10(np.maximum(rest, 0) + 0.5 * (np.maximum(kinds, 0) + 1))[classes]
        log_all = math.log10(v.total + 0.5 * (v.kinds.sum() + 1))
        log = np.concatenate([np.log10(v.counts + 0.5), np.zeros(ENDINGS)])
        self.base = log - log_all
        self.within = log - log_rest
        self.within[:size][own] = 0.0
        self.end = int(self.slot[v.words.index(END) if END in v.words else size + ending(END)])


class Network:
    """Gated recurrent unit with a two-level softmax; weights are float32 arrays by name.

    Rows are tokens, but features come first in memory: what is done to one feature of all tokens runs over contiguous
    numbers, while rows of 16 or 32 numbers cost numpy more for each row than for its numbers.
    """

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = {**weights, "input": np.asfortranarray(weights["input"])}

    @staticmethod
    def initial(t: Tables) -> Network:
        rng, n = np.random.default_rng(SEED), CLASSES * SLOTS
        counts = t.slot_count.reshape(CLASSES, SLOTS)
        slot_bias = np.where(t.open_slots, np.log(np.maximum(counts, 0) + 0.5), -30.0)
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        return Network(
            {
                "input": draw(n, 3 * HIDDEN),
                "state": draw(HIDDEN, 3 * HIDDEN) * 3,
                "class": draw(HIDDEN, CLASSES),
                "class_bias": np.log(np.maximum(counts.sum(axis=1), 0) + 0.5).astype(np.float32),
                "slot": draw(CLASSES, HIDDEN, SLOTS) * 0.1,
                "slot_bias": slot_bias.astype(np.float32),
            }
        )

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """Rows of `input`; all x are within it, and numpy gathers faster where it needn't check."""
        return self.w["input"].T.take(x.astype(np.intp), axis=1, mode="clip").T

    def step(self, i: np.ndarray, h: np.ndarray, out: np.ndarray | None = None):
        """State after the inputs (rows of `input`), and what backpropagation needs (features first)."""
        i, h = i.T, h.T
        a = self.w["state"].T @ h
        gates = i[: 2 * HIDDEN] + a[: 2 * HIDDEN]
        gates *= 0.5  # the logistic function, by the hyperbolic tangent
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        z, r, an = gates[:HIDDEN], gates[HIDDEN:], a[2 * HIDDEN :]
        n = r * an
        n += i[2 * HIDDEN :]
        np.tanh(n, out=n)
        out = np.subtract(h, n, out=None if out is None else out.T)
        out *= z
        out += n
        return out.T, (z, r, n, an)

    @staticmethod
    def _choices(h: np.ndarray, w: np.ndarray, parts: list[tuple[int, int, int]], loose: bool, s: np.ndarray, dw: np.ndarray | None):
        """Log probability of the choices s after the states h (features first, then ones) by weights w[k], whose last row is the
        bias, in each part (k, from, to); with dw, the gradient is added to it, and d/dh comes second."""
        e, at = np.empty((w.shape[-1], len(s)), dtype=h.dtype), s * len(s) + _PLACES[: len(s)]
        for k, a, z in parts:
            np.matmul(w[k].T, h[:, a:z], out=e[:, a:z])
        if loose:
            e -= e.max(axis=0)
        flat = e.reshape(-1)
        picked = flat.take(at)
        np.exp(e, out=e)
        total = _ONES[e.dtype.char][: len(e)] @ e
        logs = picked - np.log(total)
        if dw is None:
            return logs, None
        flat[at] -= total
        by = -1 / total
        scaled, dh = h * by, np.empty((HIDDEN, len(s)), dtype=h.dtype)
        for k, a, z in parts:
            dw[k] += scaled[:, a:z] @ e[:, a:z].T
            np.matmul(w[k, :HIDDEN], e[:, a:z], out=dh[:, a:z])
        dh *= by
        return logs, dh

    def log_probs(self, h: np.ndarray, y: np.ndarray, grads: dict[str, np.ndarray] | None = None):
        """Natural log probability of the slots y after the states h; with grads, these are added to, and d/dh comes second.

        States lie within (-1, 1), which bounds the logits, so no maximum by token is needed unless that bound is loose.
        """
        order = np.argsort((y // SLOTS).astype(np.int16), kind="stable")
        c, s = (a.astype(np.intp) for a in divmod(y[order], SLOTS))
        states = np.ones((HIDDEN + 1, len(y)), dtype=h.dtype)
        np.take(h.T, order, axis=1, out=states[:HIDDEN], mode="clip")
        out, dh = np.zeros(len(y), dtype=h.dtype), None if grads is None else np.zeros((HIDDEN, len(y)), dtype=h.dtype)
        bounds = np.searchsorted(c, np.arange(CLASSES + 1)).tolist()
        for name, chosen in (("class", c), ("slot", s)):
            w, bias = (self.w[x].reshape(-1, *self.w[x].shape[-d:]) for x, d in ((name, 2), (f"{name}_bias", 1)))
            bound = (np.abs(w).sum(axis=1) + bias).max(axis=1, keepdims=True)
            loose = bool((bound[:, 0] - bias.max(axis=1) > 40).any())
            w = np.concatenate([w, (bias - bound)[:, None]], axis=1)
            dw = None if grads is None else np.zeros_like(w)
            for a in range(0, len(y), BLOCK):  # small blocks stay in the cache
                z = min(a + BLOCK, len(y))
                own = range(c[a], c[z - 1] + 1)
                parts = [(0, 0, z - a)] if name == "class" else [(k, max(bounds[k] - a, 0), min(bounds[k + 1], z) - a) for k in own if bounds[k] < bounds[k + 1]]
                logs, slopes = self._choices(states[:, a:z], w, parts, loose, chosen[a:z], dw)
                out[a:z] += logs
                if grads is not None:
                    dh[:, a:z] += slopes
            if grads is not None:
                grads[name] += dw[:, :HIDDEN].reshape(grads[name].shape)
                grads[f"{name}_bias"] += dw[:, HIDDEN].reshape(grads[f"{name}_bias"].shape)
        back = np.empty_like(order)
        back[order] = np.arange(len(y))
        return out[back], None if grads is None else dh.take(back, axis=1, mode="clip").T


def _lanes(length: np.ndarray, lanes: int) -> tuple[list[list[int]], np.ndarray]:
    """Documents dealt to lanes, the longest first to the emptiest lane; lanes by falling length."""
    heap = [(0, i) for i in range(min(lanes, max(1, len(length))))]
    dealt: list[list[int]] = [[] for _ in heap]
    for d in np.argsort(-length, kind="stable").tolist():
        n, i = heapq.heappop(heap)
        dealt[i].append(d)
        heapq.heappush(heap, (n + int(length[d]), i))
    total = np.zeros(len(dealt), dtype=np.int64)
    for n, i in heap:
        total[i] = n
    order = np.argsort(-total, kind="stable")
    return [dealt[i] for i in order], total[order]


class Streams:
    """Documents behind each other in lanes, kept flat: targets y, inputs x (the token before, the end at a start), and
    whether a document starts; `doc` is the place's document. Lanes run in step, by falling length."""

    def __init__(self, docs: list[np.ndarray], lanes: int, end: int) -> None:
        size = np.array([len(d) for d in docs], dtype=np.int64)
        dealt, self.length = _lanes(size, lanes)
        order = [d for own in dealt for d in own]
        self.y = np.concatenate([docs[d] for d in order]).astype(np.int32) if order else np.zeros(0, dtype=np.int32)
        self.doc = np.repeat(np.array(order, dtype=np.int32), size[order]) if order else np.zeros(0, dtype=np.int32)
        begin = np.cumsum(size[order]) - size[order] if order else np.zeros(0, dtype=np.int64)
        self.x = np.empty_like(self.y)
        self.x[1:] = self.y[:-1]
        self.x[begin[begin < len(self.x)]] = end
        self.fresh = np.zeros(len(self.y), dtype=bool)
        self.fresh[begin[begin < len(self.x)]] = True
        self.start = np.cumsum(self.length) - self.length
        self.steps = int(self.length[0]) if len(self.length) else 0

    def windows(self, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of a window's tokens, step by step, and the bounds of the steps."""
        for t0 in range(0, self.steps, steps):
            t = np.arange(t0, min(t0 + steps, self.steps))
            active = np.searchsorted(-self.length, -t, side="left")  # lanes that are longer than the step
            yield np.concatenate([self.start[:k] + u for u, k in zip(t, active)]), np.concatenate([[0], np.cumsum(active)])


def _started(h: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """States before a step: none where a document starts."""
    return np.where(fresh, h.dtype.type(0), h.T).T if fresh.any() else h


def score_slots(net: Network, docs: list[np.ndarray], end: int) -> np.ndarray:
    """Natural log probability of each document's slots."""
    out = np.zeros(len(docs))
    s = Streams(docs, LANES, end)
    h = np.zeros((len(s.length), HIDDEN), dtype=np.float32)
    for place, cuts in s.windows(SCORE_WINDOW):
        x, fresh = s.x[place], s.fresh[place]
        states = np.empty((HIDDEN, len(place)), dtype=np.float32)
        for a, z in zip(cuts.tolist(), cuts[1:].tolist()):
            h, _ = net.step(net.inputs(x[a:z]), _started(h[: z - a], fresh[a:z]), states[:, a:z].T)
        logs, _ = net.log_probs(states.T, s.y[place])
        out += np.bincount(s.doc[place], weights=logs, minlength=len(docs))
    return out


def gradients(net: Network, inputs: np.ndarray, fresh: np.ndarray, y: np.ndarray, cuts: np.ndarray, h: np.ndarray):
    """Of one window from the states h: gradients of the summed log probability (those of `input` by token), and the states after it."""
    states, before, by_n = (np.empty((HIDDEN, len(y)), dtype=h.dtype) for _ in range(3))
    factors = np.empty((4, HIDDEN, len(y)), dtype=h.dtype)
    steps = list(zip(cuts.tolist(), cuts[1:].tolist()))
    for a, z in steps:
        h = _started(h[: z - a], fresh[a:z])
        before[:, a:z] = h.T
        h, (zg, r, n, an) = net.step(inputs[a:z], h, states[:, a:z].T)
        # what slopes are multiplied by, worked out for all lanes here; only the sum of later slopes waits for the way back
        own, keep, slope = factors[:, :, a:z], 1 - zg, n * n
        np.subtract(1, slope, out=slope)
        np.multiply(slope, keep, out=by_n[:, a:z])
        np.multiply(by_n[:, a:z], r, out=own[2])
        np.multiply(own[2], an, out=own[1])
        own[1] *= 1 - r
        np.multiply(h.T - n, keep, out=own[0])
        own[3] = zg
    grads = {k: np.zeros_like(a) for k, a in net.w.items() if k != "input"}
    dhs = net.log_probs(states.T, y, grads)[1].T
    later, di = np.zeros((HIDDEN, 0), dtype=h.dtype), factors[:3].reshape(3 * HIDDEN, -1)
    starts = np.add.reduceat(fresh, cuts[:-1], dtype=np.int64).tolist()
    for (a, z), any_fresh in zip(reversed(steps), reversed(starts)):
        dh, own = dhs[:, a:z], factors[:, :, a:z]
        dh[:, : later.shape[1]] += later
        own *= dh  # the factors become the slopes
        later = net.w["state"] @ di[:, a:z]
        later += own[3]
        if any_fresh:
            later[:, fresh[a:z]] = 0
    grads["state"] += before @ di.T
    np.multiply(dhs, by_n, out=di[2 * HIDDEN :])
    grads["input"] = di.T
    return grads, h


class Trainer:
    """Truncated backpropagation with Adam; its moments are carried from chunk to chunk."""

    def __init__(self, net: Network, end: int) -> None:
        self.net, self.end, self.number = Network({k: v.copy(order="K") for k, v in net.w.items()}), end, 0
        self.m, self.v = ({k: np.zeros_like(a) for k, a in net.w.items()} for _ in range(2))
        self.closed = net.w["slot_bias"] < -20  # slots without a word stay without probability

    def __call__(self, docs: list[np.ndarray]) -> None:
        """One pass over the documents."""
        s, w = Streams(docs, TRAIN_LANES, self.end), self.net.w
        h = np.zeros((len(s.length), HIDDEN), dtype=np.float32)
        for place, cuts in s.windows(WINDOW):
            x = s.x[place].astype(np.intp)
            grads, h = gradients(self.net, self.net.inputs(x), s.fresh[place], s.y[place], cuts, h)
            grads["input"] = np.array([np.bincount(x, weights=g, minlength=len(w["input"])) for g in grads["input"].T], dtype=np.float32).T
            grads["slot_bias"][self.closed] = 0
            self.number += 1
            fade_m, fade_v = 1 - 0.9**self.number, 1 - 0.99**self.number
            step = STEP / (1 + self.number / DECAY) ** 0.5
            for k, a in w.items():
                g, m, v = grads[k], self.m[k], self.v[k]
                g /= np.float32(len(place))
                m *= np.float32(0.9)
                m += np.float32(0.1) * g
                g *= g
                g *= np.float32(0.01)
                v *= np.float32(0.99)
                v += g
                np.divide(v, np.float32(fade_v), out=g)
                np.sqrt(g, out=g)
                g += np.float32(1e-6)
                np.divide(m, g, out=g)
                g *= np.float32(step / fade_m)
                a += g


def _pack(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def _unpack(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def given(counts: Counter) -> pd.DataFrame:
        return pd.DataFrame({"word": list(counts.keys()), "c": np.fromiter(counts.values(), dtype=np.int64, count=len(counts))})

    counts: Counter = Counter()
    for pdf in batches:
        for text in pdf["text"]:
            counts.update(tokens(text))
            if len(counts) >= COUNTED:
                yield given(counts)
                counts = Counter()
    if counts:
        yield given(counts)


def word_counts(docs: DataFrame) -> DataFrame:
    """word (bytes), c over docs (text); the end token is the word of one line feed."""
    return docs.select("text").mapInPandas(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def class_map(profiles: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Class of each ending: halves of equal mass along the leading components of the profiles (endings x features), in turn."""
    x = np.sqrt(profiles / np.maximum(profiles.sum(axis=1, keepdims=True), 1e-9))
    weight = np.sqrt(mass + 1e-9)[:, None]
    x = (x - (x * weight**2).sum(axis=0) / (weight**2).sum()) * weight
    values, vectors = np.linalg.eigh(x.T @ x)
    axes = (x / weight) @ vectors[:, ::-1][:, :3]
    classes = np.zeros(len(mass), dtype=np.int64)
    for level in range(CLASSES.bit_length() - 1):
        finer = classes * 2
        for k in range(1 << level):
            own = np.flatnonzero(classes == k)
            own = own[np.argsort(axes[own, level % axes.shape[1]], kind="stable")]
            half = np.cumsum(mass[own]) > mass[own].sum() / 2
            finer[own[half]] += 1
        classes = finer
    return classes


def profile(docs: list[np.ndarray], ending_of: np.ndarray) -> np.ndarray:
    """Counts of endings by which endings (folded to PROFILE) their documents hold, as shares of each document."""
    out = np.zeros((ENDINGS, PROFILE))
    size = np.array([len(d) for d in docs], dtype=np.int64)
    if not size.sum():
        return out
    for at in range(0, len(docs), PROFILED):
        own = slice(at, at + PROFILED)
        e, d = ending_of[np.concatenate(docs[own])], np.repeat(np.arange(len(size[own])), size[own])
        folded = np.bincount(d * PROFILE + e % PROFILE, minlength=len(size[own]) * PROFILE).reshape(-1, PROFILE) / np.maximum(size[own], 1)[:, None]
        counts = np.bincount(e * len(size[own]) + d, minlength=ENDINGS * len(size[own])).reshape(ENDINGS, -1)
        out += counts.astype(np.float32) @ folded.astype(np.float32)
    return out


def _coded(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u2") for b in pdf["codes"]]


def _profiles(ending_of):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((ENDINGS, PROFILE))
        for pdf in batches:
            total += profile(_coded(pdf), ending_of.value)
        yield pd.DataFrame({"profile": [total.astype("<f8").tobytes()]})

    return run


def _sum_arrays(df: DataFrame, schema: str, add) -> list:
    """Rows of `df`, one a partition, folded by `add` (pandas frame to one-row frame) in a tree of FOLD branches; the driver gets at most AVERAGES."""
    rows = C.materialise(df.withColumn("__g", F.spark_partition_id().cast("long")), "partial-sums")
    left = (rows.agg(F.max("__g")).first()[0] or 0) + 1

    def folded(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return add(pdf.drop(columns="__g")).assign(__g=key[0])

    while left > AVERAGES:
        groups = rows.withColumn("__g", F.floor(F.col("__g") / FOLD)).groupBy("__g")
        rows, left = groups.applyInPandas(folded, f"{schema}, __g long"), -(-left // FOLD)
    return rows.drop("__g").collect()


def frequent_from(counts: DataFrame) -> int:
    """The least count such that at most FREQUENT words reach it, from the number of words by count (logarithmic steps)."""
    step = F.floor(F.log2("c") * 32)
    total, least = 0, None
    for r in counts.groupBy(step.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).orderBy(F.desc("s")).collect():
        total += r["n"]
        if total > FREQUENT:
            break
        least = r["c"]
    return 1 << 62 if least is None else int(least)


def vocabulary(counts: DataFrame) -> Vocabulary:
    least = frequent_from(counts)
    frequent = counts.where(F.col("c") >= least).orderBy(F.desc("c"), "word").toPandas()
    by = counts.groupBy(F.pmod(F.crc32(F.substring("word", -3, 3)), F.lit(ENDINGS)).alias("e")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
    mass, kinds = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in by:
        mass[r["e"]], kinds[r["e"]] = r["c"], r["v"]
    return Vocabulary([bytes(w) for w in frequent["word"]], frequent["c"].to_numpy(dtype=np.int64), mass, kinds, least)


def encoded(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """docs (doc_id, held_out, text) with the text as codes: row, doc_id, held_out, codes, rare (hashes of rare words)."""
    words = docs.sparkSession.sparkContext.broadcast(v.words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, number = Encoder(words.value), TaskContext.get().partitionId() << 33
        for pdf in batches:
            codes, rare = [], []
            for text in pdf["text"]:
                own, hashes = encode(tokens(text))
                codes.append(own.astype("<u2").tobytes())
                rare.append(hashes)
            yield pd.DataFrame({"row": np.arange(number, number + len(pdf)), "doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "codes": codes, "rare": rare})
            number += len(pdf)

    return docs.select("doc_id", "held_out", "text").mapInPandas(run, "row long, doc_id long, held_out boolean, codes binary, rare array<long>")


def classes(train: DataFrame, v: Vocabulary) -> np.ndarray:
    """Class of each ending, by the profiles over train (codes)."""
    shared = train.sparkSession.sparkContext.broadcast(v.endings())

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"profile": [sum(np.frombuffer(p, "<f8") for p in pdf["profile"]).tobytes()]})

    parts = _sum_arrays(train.select("codes").mapInPandas(_profiles(shared), "profile binary"), "profile binary", add)
    return class_map(sum((np.frombuffer(r["profile"], "<f8") for r in parts), np.zeros(ENDINGS * PROFILE)).reshape(ENDINGS, PROFILE), v.mass)


def train_network(train: DataFrame, tables, net: Network) -> Network:
    """ROUNDS times: a pass over a part of train (row, codes) in every partition from the shared weights, then the mean of the results by tokens."""
    spark, like = train.sparkSession, net.w

    def run_with(shared):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            t = tables.value
            learn, docs, held, n = Trainer(Network(_unpack(shared.value, like)), t.end), [], 0, 0
            for pdf in batches:
                for codes in _coded(pdf):
                    docs.append(t.slot[codes])
                    held += len(codes)
                    if held >= CHUNK:
                        learn(docs)
                        n, docs, held = n + held, [], 0
            if held:
                learn(docs)
            if n + held:
                yield pd.DataFrame({"weights": [(_pack(learn.net.w).astype("<f8") * (n + held)).tobytes()], "n": [n + held]})

        return run

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(w, "<f8") for w in pdf["weights"])
        return pd.DataFrame({"weights": [total.tobytes()], "n": [pdf["n"].sum()]})

    for k in range(ROUNDS):
        part = train.where(F.pmod(F.xxhash64("row"), F.lit(ROUNDS)) == k)
        shared = spark.sparkContext.broadcast(_pack(net.w))
        parts = _sum_arrays(part.select("codes").mapInPandas(run_with(shared), "weights binary, n long"), "weights binary, n long", add)
        if n := sum(p["n"] for p in parts):
            net = Network(_unpack(sum(np.frombuffer(p["weights"], "<f8") for p in parts) / n, like))
    return net


def _score(tables, shared, like):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, net = tables.value, Network(_unpack(shared.value, like))
        frames, docs, held = [], [], 0

        def flush() -> pd.DataFrame:
            pdf, size = pd.concat(frames, ignore_index=True), np.array([len(d) for d in docs], dtype=np.int64)
            flat, d = np.concatenate(docs), np.repeat(np.arange(len(docs)), size)
            fold = lambda a: np.bincount(d, weights=a[flat], minlength=len(docs))
            logs = score_slots(net, [t.slot[c] for c in docs], t.end) / math.log(10)
            return pd.DataFrame({"row": pdf["row"], "doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "n_tokens": size, "n_rare": pdf["n_rare"], "base": fold(t.base), "score": fold(t.within) + logs})

        for pdf in batches:
            frames.append(pdf.drop(columns="codes"))
            docs += _coded(pdf)
            held += sum(map(len, docs[-len(pdf) :])) if len(pdf) else 0
            if held >= CHUNK:
                yield flush()
                frames, docs, held = [], [], 0
        if docs:
            yield flush()

    return run


def score(docs: DataFrame) -> DataFrame:
    """For docs (doc_id, held_out, text), with a model of those that aren't held out."""
    spark = docs.sparkSession
    C.small_batches(spark)
    counts = C.materialise(word_counts(docs.where(~F.col("held_out"))), "word-counts")
    v = vocabulary(counts)
    coded = C.materialise(encoded(docs, v), "lm-codes")
    train = coded.where(~F.col("held_out"))
    t = Tables(v, classes(train, v))
    tables = spark.sparkContext.broadcast(t)
    net = train_network(train, tables, Network.initial(t))
    shared = spark.sparkContext.broadcast(_pack(net.w))
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_rare long, base double, score double"
    scored = coded.select("row", "doc_id", "held_out", "codes", F.size("rare").cast("long").alias("n_rare")).mapInPandas(_score(tables, shared, net.w), schema)
    # rarer than the frequent words, so no key is hot
    rare_counts = counts.where(F.col("c") < v.least).select(F.xxhash64("word").alias("h"), "c")
    rare = coded.select("row", F.explode("rare").alias("h"))
    log = F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))
    sums = rare.join(rare_counts, "h", "left").groupBy("row").agg(F.sum(log).alias("log"), F.count("c").alias("known"))
    joined = scored.join(sums, "row", "left")
    more = F.coalesce("log", F.lit(0.0))
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_tokens") - F.col("n_rare") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("score") + more).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return score(docs.withColumn("held_out", F.pmod(crc, F.lit(5)) == 1))
