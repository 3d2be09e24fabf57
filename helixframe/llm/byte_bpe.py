"""Byte-level BPE by monoid tree reduction: halves are encoded, neighbours joined by encoding a window around their boundary again.

A text is parted by the vocabulary's pattern and each part is encoded by itself. A part of over LEAF bytes is halved again and
again; leaves are encoded by merging, and two neighbours' tokens are joined by encoding the bytes of the last w tokens of one
and the first w of the other, for w = 1, 2, 4... until the window's outer tokens are stable. Decoding concatenates the tokens'
bytes up a tree.

Why the join is exact. Encoding merges the adjacent pair of lowest rank, the leftmost of equals, while there is one. Call two tokens
x, y a *seam* if encoding their bytes gives x, y again. (1) Tokens that are all adjacent by seams are the encoding of
their bytes: as long as no merge crosses from a token into the next, the merges inside x and y happen in the same order as
in encoding xy alone, since both take the lowest of what is left; the first merge across would be the lowest of all, so
encoding xy would take it as well, against the seam. (2) Adjacent tokens of any encoding are seams, by the same argument. So
the kept tokens of both sides and those of the window are stable inside by (2), and with a seam at each of the window's two
ends the whole is the encoding by (1). Once no token is left outside the window, it is the encoding itself, so doubling ends.

Parts of at most KEEP bytes are remembered, up to REMEMBERED of them a worker; they only save time. Memory is bounded by
the texts of an Arrow batch of common.BATCH_ROWS rows.

Edge cases: a null or empty text has no ids and no bytes; strings of special tokens are ordinary text; bytes that aren't UTF-8 are
read as the replacement character; an id that the vocabulary lacks is an error when decoding; rows are encoded one by one, so repeated rows and
further columns don't matter, and a result column replaces an input column of its name.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

VOCABULARY = "byte_bpe_50k.tiktoken"
LEAF, KEEP, REMEMBERED = 8, 64, 300_000
#: Above every rank.
NONE = 1 << 62


class Memo(dict):
    """A function's results, remembered up to a number of them; then it starts anew."""

    def __init__(self, compute, most: int = REMEMBERED) -> None:
        super().__init__()
        self.compute, self.most = compute, most

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) >= self.most:
            self.clear()
        if len(key) <= KEEP:
            self[key] = value
        return value


class Encoder:
    """ranks: id of every token's bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.parts = ranks, regex.compile(pattern)
        self.bytes_of = {i: token for token, i in ranks.items()}
        self.packed = {token: i.to_bytes(4, "little") for token, i in ranks.items()}
        self.seams: dict[tuple[bytes, bytes], bool] = {}
        self.short, self.known = Memo(self.merge), Memo(self._part)

    def _part(self, part: str) -> bytes:
        """Packed ids of a part; one that is a token as a whole is that token, whatever merges would give."""
        raw = part.encode()
        return self.packed.get(raw) or b"".join(map(self.packed.__getitem__, self.tokens(raw)))

    def merge(self, part: bytes) -> list[bytes]:
        """Tokens of a few bytes: the adjacent pair of lowest rank becomes one while there is such a pair."""
        tokens = [part[i : i + 1] for i in range(len(part))]
        find = self.ranks.get
        pairs = [find(part[i : i + 2], NONE) for i in range(len(part) - 1)]
        while pairs and (best := min(pairs)) != NONE:
            i = pairs.index(best)
            tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = find(tokens[i - 1] + tokens[i], NONE)
            if i < len(pairs):
                pairs[i] = find(tokens[i] + tokens[i + 1], NONE)
        return tokens

    def seam(self, x: bytes, y: bytes) -> bool:
        """Whether x, y is the encoding of its bytes."""
        known = self.seams.get((x, y))
        if known is None:
            if len(self.seams) >= REMEMBERED:
                self.seams.clear()
            known = self.seams[x, y] = self.merge_long(x + y) == [x, y]
        return known

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """Tokens of the bytes of two encodings' tokens."""
        if not left or not right or self.seam(left[-1], right[0]):
            return left + right
        w = 1
        while True:
            head, tail = left[:-w], right[w:]
            inner = self.merge_long(b"".join(left[-w:] + right[:w]))
            if (not head or self.seam(head[-1], inner[0])) and (not tail or self.seam(inner[-1], tail[0])):
                return head + inner + tail
            w *= 2

    def merge_long(self, part: bytes) -> list[bytes]:
        """As merge, for any number of bytes, in n log n: candidates wait in a heap, tokens are a linked list."""
        if len(part) <= KEEP:
            return self.short[part]
        n, find = len(part), self.ranks.get
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the token that starts at a place
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := find(part[i : i + 2])) is not None]
        heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            rank, start, end = heappop(heap)
            middle = ends[start]
            if not alive[start] or middle >= n or ends[middle] != end or middle == end:
                continue  # one of the two has been merged since
            alive[middle], ends[start] = 0, end
            if end < n:
                before[end] = start
                if (r := find(part[start : ends[end]])) is not None:
                    heappush(heap, (r, start, ends[end]))
            if (p := before[start]) >= 0 and (r := find(part[p:end])) is not None:
                heappush(heap, (r, p, end))
        return [part[i : ends[i]] for i in range(n) if alive[i]]

    def tokens(self, part: bytes) -> list[bytes]:
        """Tokens of one part's bytes. Halves end at multiples of a power of two, so that repetitive halves agree."""
        if len(part) <= LEAF:
            return self.short[part]
        middle = 1 << (len(part) - 1).bit_length() - 1
        return self.join(self.tokens(part[:middle]), self.tokens(part[middle:]))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        return b"".join(map(self.known.__getitem__, self.parts.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        level = list(map(self.bytes_of.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))
        while len(level) > 1:
            level = [b"".join(level[i : i + 64]) for i in range(0, len(level), 64)]
        return level[0] if level else b""


@lru_cache(maxsize=4)
def worker_encoder(vocabulary: str) -> Encoder:
    """One for all tasks of a Python worker."""
    import public_tokenizers as P

    with open(P.path(vocabulary), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return Encoder(ranks, P.PATTERN)


def encode(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Ids of a text (null: none) as a binary of little-endian unsigned 32-bit numbers."""

    @F.pandas_udf("binary")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = worker_encoder(vocabulary).encode
        for batch in batches:
            yield pd.Series([of(t.decode("utf-8", "replace")) if t else b"" for t in batch], dtype=object)

    return ids(text.cast("binary"))


def decode(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """The bytes of packed ids (null: none)."""

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = worker_encoder(vocabulary).decode
        for batch in batches:
            yield pd.Series([of(b) if b else b"" for b in batch], dtype=object)

    return decoded(ids)


def unpack(ids: Column) -> Column:
    """Packed ids as an array of integers."""

    @F.pandas_udf("array<int>")
    def listed(batch: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b or b"", dtype="<u4").astype("int32") for b in batch], dtype=object)

    return listed(ids)


def round_trip(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """docs with ids (packed) and decoded (bytes)."""
    C.small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in ("ids", "decoded")]
    source = docs.select(*[F.col(c) for c in kept], encode(F.col(text), vocabulary).alias("ids"))
    return source.withColumn("decoded", decode(F.col("ids"), vocabulary))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids, decoded = F.col("ids"), F.col("decoded")
    return round_trip(docs).select(
        "doc_id", F.floor(F.octet_length(ids) / 4).alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(decoded, 256).alias("decoded_sha256")
    )
