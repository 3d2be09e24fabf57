"""Mixture-controlled packing: deficit round-robin over source queues.

Documents are dealt over the partitions, and ordered within, by a hash, so that each partition and any stretch of it has
every source's share, however the input is ordered. A partition tokenises its documents as they come and queues them by
source. A window of WINDOW tokens is
filled in turns: every source's deficit grows by its share of the window, and each source in turn gets the tokens that it is
owed, in one piece where its document has so many. A source is served once it is owed most of its share of a window, so with shares
of LEAST tokens and more every window holds every source; a smaller one waits until LEAST tokens or the rest of a document
are due. What a source got too much or too little is carried to the next window. A partition packs windows while its queues hold
sources of most of the shares, and hands on the rest (at most REST tokens) with the deficits; in a second pass the rests of up to GATHER
partitions are packed on by the same rule, with shares of what is left, so that all sources end together; only there a sequence can end short. Sequences are
gapless, and every token lies in exactly one piece.

Targets are each source's share of the bytes (pass `targets` to ask for others; a source that runs dry leaves its
share to the rest, since everything is packed). The MAX_QUEUES largest sources have queues of their own; smaller ones, whose
shares are under a token a window, share one. So memory is bounded: a partition holds at most HOLD queued tokens and one batch of texts.
Texts are shuffled once, tokens only in the rests; a recomputed task gives the same pieces.

Edge cases: a null or empty text is its end token only; a null source is a source of its own; a text of any length is cut over
as many sequences as it needs; repeated rows are packed as rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WINDOW, LEAST = 1024, 32
END = 0
HOLD = 1 << 18
#: A partition's rest, and the share of the targets whose sources must be at hand to pack windows from no more than that.
REST, AT_HAND = 1 << 17, 0.9
GATHER, MAX_QUEUES = 64, WINDOW
CACHED_WORDS = 400_000
SPECIAL = "<|endoftext|>"
_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, sequence long, offset long, queue int, rest binary, deficit double"


@lru_cache(maxsize=1)
def _encoders(tokens: str, ranks: str):
    """The vocabulary as tokenizers reads it, and the same as ranks, which encodes plain text several times faster."""
    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    with open(P.path(ranks), "rb") as file:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return Tokenizer.from_file(P.path(tokens)), tiktoken.Encoding("packing", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={})


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit.

    Where white space is single, the pattern parts a text at line feeds and before spaces, so words are encoded with
    the space before them and remembered, up to CACHED_WORDS; the new words of a text are encoded in one call, parted
    by line feeds, which are tokens of their own there. Other texts are encoded whole.
    """

    def __init__(self, tokens: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> None:
        self.whole, self.fast = _encoders(tokens, ranks)
        self.words: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {}
        self.feed_id = int(self._encode("\n")[0])
        self.feed = self._encode("\n").tobytes()

    def _encode(self, text: str) -> np.ndarray:
        return self.fast.encode_to_numpy(text, disallowed_special=())

    def _first(self, word: str) -> bytes:
        """Ids of a line's first word, which has no space before it."""
        ids = self.firsts.get(word)
        if ids is None:
            ids = self._encode(word).tobytes()
            if len(word) <= 64 and len(self.firsts) < CACHED_WORDS:
                self.firsts[word] = ids
        return ids

    def _learn(self, words: list[str]) -> None:
        ids = self._encode(" " + "\n ".join(words))
        ends = np.flatnonzero(ids == self.feed_id).tolist()
        raw = ids.tobytes()
        self.words.update(zip(words, [raw[4 * a : 4 * b] for a, b in zip([0, *(e + 1 for e in ends)], [*ends, len(ids)])]))

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if SPECIAL in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        lines = []
        for line in text.split("\n"):
            words = line.split(" ")
            if words != line.split():  # other white space, or several in a row
                return self._encode(text).tobytes()
            lines.append(words)
        firsts = [words[0] for words in lines]
        rest = lines[0][1:] if len(lines) == 1 else [w for words in lines for w in words[1:]]
        new = list(set(rest).difference(self.words))
        if new:
            self._learn(new)
        of = self.words.__getitem__
        out = self.feed.join([self._first(first) + b"".join(map(of, words[1:])) for first, words in zip(firsts, lines)])
        if len(self.words) > CACHED_WORDS:
            for w in new:
                del self.words[w]
        return out


@lru_cache(maxsize=1)
def worker_encoder() -> Encoder:
    """One for all tasks of a Python worker, so that words are learnt once."""
    return Encoder()


class Mixer:
    """Queues of (doc_id, start, ids, doc_tokens), their deficits, and the pieces of full windows."""

    def __init__(self, shares: dict[int, float]) -> None:
        self.shares, self.queues, self.deficit = shares, {}, {}
        self.queued, self.sequence, self.pieces, self.turn = 0, 0, [], 0

    def add(self, queue: int, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        if queue not in self.queues:
            self.queues[queue] = deque()
            self.deficit.setdefault(queue, 0.0)
        self.queues[queue].append((doc_id, start, memoryview(ids), doc_tokens))
        self.queued += len(ids) // 4

    def _take(self, queue: int, most: int, offset: int) -> int:
        docs = self.queues[queue]
        doc_id, start, ids, doc_tokens = docs[0]
        n = min(most, len(ids) // 4)
        piece = ids[: 4 * n]
        if 4 * n < len(ids):
            docs[0] = (doc_id, start + n, ids[4 * n :], doc_tokens)
        else:
            docs.popleft()
        self.pieces.append((doc_id, start, n, zlib.crc32(piece), doc_tokens, self.sequence, offset))
        self.deficit[queue] -= n
        self.queued -= n
        return n

    def at_hand(self) -> float:
        """Share of the targets whose sources have something queued."""
        return sum(self.shares.get(q, 0.0) for q, docs in self.queues.items() if docs)

    def window(self) -> None:
        """Fill the next sequence, as far as the queues go."""
        live = [q for q, docs in self.queues.items() if docs]
        whole = sum(self.shares.get(q, 0.0) for q in live)
        own = {q: WINDOW * (self.shares.get(q, 0.0) / whole if whole else 1 / len(live)) for q in live}
        at, n = 0, len(live)
        for k in range(n):
            q = live[(self.turn + k) % n]
            self.deficit[q] += own[q]
            due, room = round(self.deficit[q]), WINDOW - at
            if due < min(max(LEAST, int(own[q] * 0.75)), len(self.queues[q][0][2]) // 4):
                continue
            if due > room or (k == n - 1 and room - due <= LEAST):  # what rounding has left goes to the last in turn
                due = room
            while due > 0 and self.queues[q]:
                taken = self._take(q, due, at)
                at, due = at + taken, due - taken
        while at < WINDOW and self.queued:  # nothing is due: who is owed most goes first, and owes it later
            q = max((q for q in live if self.queues[q]), key=self.deficit.__getitem__)
            at += self._take(q, min(WINDOW - at, max(LEAST, int(self.deficit[q]))), at)
        self.turn += 1
        self.sequence += 1
        lost, rest = 0.0, 0.0
        for q in live:
            if self.queues[q]:
                rest += own[q]
            elif self.deficit[q] > 0:  # an idle queue keeps what it owes; what it is owed goes to those that have served for it
                lost, self.deficit[q] = lost + self.deficit[q], 0.0
        if lost and rest:
            for q in live:
                if self.queues[q]:
                    self.deficit[q] += lost * own[q] / rest


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence", "offset"]


def _frame(mixer: Mixer, part: int) -> pd.DataFrame:
    columns = dict(zip(_NAMES, zip(*mixer.pieces))) if mixer.pieces else {c: () for c in _NAMES}
    mixer.pieces = []
    ids = columns.pop("doc_id")
    whole = pd.array(ids, dtype="Int64") if None in ids else np.array(ids, dtype=np.int64)
    pdf = pd.DataFrame({"doc_id": whole, **{c: np.array(v, dtype=np.int64) for c, v in columns.items()}})
    return pdf.assign(part=part, queue=None, rest=None, deficit=None)[[f.split()[0] for f in _SCHEMA.split(", ")]]


def _rests(mixer: Mixer, part: int) -> pd.DataFrame:
    """What is left; an empty queue's row has no ids, only what the queue owes."""
    rows = [(d, s, len(ids) // 4, None, n, part, None, i, q, bytes(ids), mixer.deficit[q]) for q, docs in mixer.queues.items() for i, (d, s, ids, n) in enumerate(docs or [(None, 0, b"", 0)])]
    pdf = pd.DataFrame(rows, columns=[f.split()[0] for f in _SCHEMA.split(", ")])
    return pdf.astype({c: "Int64" for c in ("doc_id", "ids_crc32", "sequence")})


def _pack(shares: dict[int, float], queue_of: dict):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, encode, mixer = TaskContext.get().partitionId(), worker_encoder(), Mixer(shares)
        end = np.array([END], dtype="<u4").tobytes()
        for pdf in batches:
            for doc_id, source, text in zip(pdf["doc_id"].tolist(), pdf["source"].tolist(), pdf["text"].tolist()):
                ids = encode(text or "") + end
                mixer.add(queue_of.get(source if isinstance(source, str) else None, len(queue_of)), None if pd.isna(doc_id) else int(doc_id), 0, ids, len(ids) // 4)
                if mixer.queued > HOLD:
                    while mixer.queued > HOLD // 2:
                        mixer.window()
                    yield _frame(mixer, part)
        while mixer.queued >= REST or (mixer.queued >= WINDOW and mixer.at_hand() >= AT_HAND):
            mixer.window()
        yield _frame(mixer, part)
        yield _rests(mixer, part)

    return run


def _gather(first: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "queue", "offset"], ignore_index=True)
        left = pdf.groupby("queue")["length"].sum()
        mixer, group = Mixer((left / max(1, left.sum())).to_dict()), first + int(pdf["part"].iat[0]) // GATHER
        for (_, queue), own in pdf.groupby(["part", "queue"], sort=True):
            mixer.deficit[queue] = mixer.deficit.get(queue, 0.0) + float(own["deficit"].iat[0])
        for r in pdf[pdf["length"] > 0].itertuples():
            mixer.add(r.queue, None if pd.isna(r.doc_id) else int(r.doc_id), r.start, r.rest, r.doc_tokens)
        while mixer.queued:
            mixer.window()
        return _frame(mixer, group)

    return run


def pack(docs: DataFrame, targets: dict | None = None) -> DataFrame:
    """One row per piece of docs (doc_id, source, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    targets: token share by source (null source: None), the shares of the bytes unless given.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text"))
    shared = 1e-4 * sum(targets.values()) if targets else 0.0  # sources without a target of their own
    if targets is None:
        weights = C.materialise(rows.groupBy("source").agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("b")), "source-bytes")
        targets = {r["source"]: float(r["b"]) for r in weights.orderBy(F.desc("b"), "source").limit(MAX_QUEUES).collect()}
        shared = max(0.0, float(weights.agg(F.sum("b")).first()[0] or 0) - sum(targets.values()))
    queue_of = {source: i for i, source in enumerate(targets)}
    whole = sum(targets.values()) + shared or 1.0
    shares = {queue_of[s]: w / whole for s, w in targets.items()} | {len(queue_of): shared / whole}
    rows = rows.withColumn("at", F.xxhash64("doc_id", F.monotonically_increasing_id())).repartition("at").sortWithinPartitions("at")
    packed = C.materialise(rows.mapInPandas(_pack(shares, queue_of), _SCHEMA), "packed")
    rest = packed.where(F.col("rest").isNotNull())
    first = 1 << 20  # gathered sequences are numbered after every partition's own
    gathered = rest.withColumn("__g", F.floor(F.col("part") / GATHER)).groupBy("__g")
    names = [f.split()[0] for f in _SCHEMA.split(", ")]
    ends = gathered.applyInPandas(lambda pdf: _gather(first)(pdf[names]), _SCHEMA)
    done = packed.where(F.col("rest").isNull()).unionByName(ends)
    return done.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.shiftleft("part", 32) + F.col("sequence")).alias("sequence_id"), "offset")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: the pieces."""
    return pack(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
