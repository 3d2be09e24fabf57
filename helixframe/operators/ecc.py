"""Error-correcting codecs and sequential searches, in Arrow-batched Python where SQL has no form for them.

Codecs work message by message (whole payloads), and reading strands back is grouped by message and group of strands,
so no task holds more than a message.
"""

from __future__ import annotations

import difflib
import functools
import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dna as D
from ..functions import draws as R
from ..functions.galois import field, reed_solomon
from ..sources.tables import table
from . import noise as N
from . import strands as S

# Fixed values of the concatenated code: inner symbols (index, payload, parity), strands (data, parity), outer symbols.
INDEX, PAYLOAD, PARITY = 4, 16, 8
DATA, SPARE, OUTER = 10, 2, 6
# Fixed values of the matrix code: rows, bases of index and symbol, percentage of parity columns.
ROWS, NT, REDUNDANCY = 14, 8, 15.0
#: Bytes of payloads, and strands, that a task codes at a time.
SLICE, STRANDS = 1 << 20, 1 << 15
# Fixed values of the block code: output table, order of bases, data symbols, check symbols, state symbols, error budgets.
STEP = np.array([[1, 2, 3, 0], [0, 1, 3, 2], [2, 3, 1, 0], [3, 0, 2, 1]])
BLOCK_BASES, BLOCK, CHECK, STATE, BUDGETS, CANDIDATES = "ATGC", 70, 4, 3, (0, 1, 2, 3), 128
# Fixed values of the searches: candidates tried, dimer in front of a message.
TRIES, FIRST_DIMER = 5000, "TA"

_CODE = {b: i for i, b in enumerate(D.BASES)}


def _digits(dna: str, order: str = D.BASES) -> np.ndarray:
    return np.array([order.index(c) for c in dna], dtype=np.int64)


def _letters(values, order: str = D.BASES) -> str:
    return "".join(order[int(v)] for v in values)


def _regroup(values: np.ndarray, width: int, to: int) -> np.ndarray:
    """Symbols of `width` bits as symbols of `to` bits, padded with zero bits."""
    bits = (np.asarray(values, dtype=np.int64)[:, None] >> np.arange(width - 1, -1, -1) & 1).ravel()
    bits = np.concatenate([bits, np.zeros(-len(bits) % to, dtype=np.int64)]).reshape(-1, to)
    return bits @ (1 << np.arange(to - 1, -1, -1))


# Concatenated Reed-Solomon code: GF(2^6) within a strand, GF(2^14) across the strands of a group.


def concatenated_encode(data: bytes) -> list[tuple[int, int, str]]:
    """(group, strand, core bases): length and payload in 14-bit symbols, ten strands of six a group and two spare ones."""
    symbols = _regroup(np.frombuffer(len(data).to_bytes(4, "big") + data, np.uint8), 8, 14)
    per = DATA * OUTER
    groups = max(1, -(-len(symbols) // per))
    symbols = np.concatenate([symbols, np.zeros(groups * per - len(symbols), dtype=np.int64)]).reshape(groups, DATA, OUTER)
    f, inner = field(14), reed_solomon(6, PARITY)
    spare = f.interpolation(np.arange(1, DATA + 1), np.arange(DATA + 1, DATA + SPARE + 1))
    out = []
    for g, own in enumerate(symbols):
        for s, payload in enumerate(np.concatenate([own, f.matmul(spare, own)])):
            index = _regroup(np.array([(g * (DATA + SPARE) + s) ^ D.INDEX_MASK]), 24, 6)
            payload = _regroup(payload, 14, 6)
            word = inner.encode(np.concatenate([index, payload, np.zeros(PAYLOAD - len(payload), dtype=np.int64)]))
            out.append((g, s, _letters(_regroup(word, 6, 2))))
    return out


def concatenated_decode_strand(core: str) -> tuple[int, int, list[int]] | None:
    """Group, strand and outer symbols of a core with at most four wrong inner symbols, else None."""
    if len(core) != 3 * (INDEX + PAYLOAD + PARITY):
        return None
    message = reed_solomon(6, PARITY).decode(_regroup(_digits(core), 2, 6))
    if message is None:
        return None
    index = int(_regroup(message[:INDEX], 6, 24)[0]) ^ D.INDEX_MASK
    bits = _regroup(message[INDEX:], 6, 1)[: 14 * OUTER]
    return index // (DATA + SPARE), index % (DATA + SPARE), _regroup(bits, 1, 14).tolist()


def concatenated_recover(found: dict[int, list[int]]) -> np.ndarray | None:
    """The data symbols of a group from any ten of its strands."""
    if len(found) < DATA:
        return None
    have = sorted(found)[:DATA]
    m = field(14).interpolation(np.array(have) + 1, np.arange(1, DATA + 1))
    return field(14).matmul(m, np.array([found[s] for s in have]))


def _slices(sizes, most: int) -> Iterator[slice]:
    """Runs of items that begin within `most` of each other, by the sum of their sizes."""
    sizes = np.asarray(sizes, dtype=np.int64)
    step = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(sizes)]
    return (slice(a, z) for a, z in zip(cuts, cuts[1:]) if z > a)


def _encode_frame(encode, key: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for own in _slices(pdf["payload"].map(len), SLICE):
                rows = [(k, *row) for k, p in zip(pdf[key][own], pdf["payload"][own]) for row in encode(bytes(p))]
                yield pd.DataFrame(rows, columns=[key, "grp", "no", "core"])

    return run


def rs_strands(df: DataFrame, key: str) -> DataFrame:
    """key, grp, no, core, full strand of each payload."""
    made = df.select(key, "payload").mapInPandas(_encode_frame(concatenated_encode, key), f"{key} long, grp int, no int, core string")
    return made.withColumn("full_strand", F.concat(F.lit(D.FORWARD_PRIMER), "core", F.lit(D.REVERSE_PRIMER)))


def rs_decode(read: DataFrame, key: str) -> DataFrame:
    """Payloads of read strands (key, core): key, decoded, strands_ok, strands_failed, groups_failed. Groups recover apart."""

    @F.pandas_udf("grp int, no int, symbols array<int>")
    def strand(cores: pd.Series) -> pd.DataFrame:
        got = [concatenated_decode_strand(c) or (None, None, None) for c in cores]
        return pd.DataFrame(got, columns=["grp", "no", "symbols"]).astype({"grp": "Int32", "no": "Int32"})

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        symbols = concatenated_recover({int(n): list(s) for n, s in zip(pdf["no"], pdf["symbols"])})
        out = None if symbols is None else symbols.ravel().astype("<i4").tobytes()
        return pd.DataFrame({key: [pdf[key].iat[0]], "grp": [pdf["grp"].iat[0]], "symbols": [out], "ok": [len(pdf)]})

    @F.pandas_udf("binary")
    def message(parts: pd.Series) -> pd.Series:
        def one(p) -> bytes | None:
            if any(x is None for x in p):
                return None
            raw = _regroup(np.concatenate([np.frombuffer(x, "<i4") for x in p]), 14, 8).astype(np.uint8).tobytes()
            return raw[4 : 4 + int.from_bytes(raw[:4], "big")]

        return parts.map(one)

    found = read.select(key, strand("core").alias("s")).select(key, "s.*")
    failed = found.groupBy(key).agg(F.count_if(F.col("grp").isNull()).alias("strands_failed"), F.count("grp").alias("strands_ok"))
    first = found.where("grp IS NOT NULL").groupBy(key, "grp", "no").agg(F.min("symbols").alias("symbols"))
    groups = first.groupBy(key, "grp").applyInPandas(group, f"{key} long, grp int, symbols binary, ok long")
    ordered = groups.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("grp", "symbols"))), lambda x: x["symbols"]).alias("parts"), F.count_if(F.col("symbols").isNull()).alias("groups_failed"))
    return ordered.select(key, message("parts").alias("decoded"), "groups_failed").join(failed, key)


def rs_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark payloads through the concatenated code, with two strands of each group lost and two bases of the others wrong."""
    df = table(spark, sf_dir, "benchmark").select("item_id", F.encode("text", "UTF-8").alias("payload"))
    kept = rs_strands(df, "item_id").where((F.col("no") + F.col("grp") + F.col("item_id")) % 6 != 0)
    flip = lambda c, at: F.concat(F.substring(c, 1, at - 1), F.translate(F.substring(c, at, 1), "ACGT", "CGTA"), F.substring(c, at + 1, 200))
    read = kept.withColumn("core", flip(flip(F.col("core"), 17), 50))
    out = rs_decode(read, "item_id").join(df, "item_id")
    return out.select("item_id", "strands_ok", "strands_failed", "groups_failed", F.octet_length("payload").alias("bytes"), (F.col("decoded") == F.col("payload")).alias("same"))


# Matrix Reed-Solomon code: 14 rows of 16-bit symbols, one column a strand, parity columns against lost strands.


def parity_columns(columns: int, percent: float = REDUNDANCY) -> int:
    r = min(95.0, max(0.0, percent)) / 100
    return max(1, math.ceil(columns * r / (1 - r))) if r > 0 else 0


def _matrix(data: bytes) -> np.ndarray:
    """Columns of a payload, with zero bytes behind it."""
    columns = max(1, -(-len(data) // (2 * ROWS)))
    return np.frombuffer(data.ljust(columns * 2 * ROWS, b"\0"), ">u2").reshape(columns, ROWS)


def _matrix_words(payloads: list[bytes], percent: float) -> Iterator[tuple[list[int], np.ndarray]]:
    """For payloads of as many columns each: their places, and index and symbols of every strand (payload, column, symbol)."""
    f, alike = field(16), {}
    for i, p in enumerate(payloads):
        alike.setdefault(-(-len(p) // (2 * ROWS)), []).append(i)
    for own in alike.values():
        data = np.stack([_matrix(payloads[i]) for i in own], axis=1).astype(np.int64)
        columns = len(data)
        xs = f.power(np.arange(columns + parity_columns(columns, percent)))
        words = np.empty((len(own), len(xs), 1 + ROWS), dtype=np.int64)
        words[:, :, 0] = np.arange(len(xs))
        words[:, :columns, 1:] = data.swapaxes(0, 1)
        words[:, columns:, 1:] = f.interpolated(xs[:columns], xs[columns:], data).swapaxes(0, 1)
        yield own, words


@functools.lru_cache(maxsize=None)
def _word_bases() -> np.ndarray:
    """The eight bases of each 16-bit symbol."""
    return np.frombuffer(D.BASES.encode(), dtype=np.uint8)[np.arange(1 << 16)[:, None] >> np.arange(2 * NT - 2, -2, -2) & 3]


def _base_words(flat: np.ndarray) -> np.ndarray:
    """16-bit symbols of bases, strand by strand."""
    two = np.zeros(256, dtype=np.int32)
    two[list(D.BASES.encode())] = range(4)
    return (two[flat].reshape(-1, NT) @ (1 << np.arange(2 * NT - 2, -2, -2, dtype=np.int32))).reshape(-1, 1 + ROWS)


def matrix_encode(data: bytes, percent: float = REDUNDANCY) -> list[tuple[int, int, str]]:
    """(0, column, strand of 120 bases)."""
    ((_, words),) = _matrix_words([data], percent)
    return [(0, c, bases.tobytes().decode()) for c, bases in enumerate(_word_bases()[words[0] & 0xFFFF])]


def matrix_strands(df: DataFrame, key: str, percent: float = REDUNDANCY) -> DataFrame:
    """key, grp, no, core of each payload as matrix_encode has them; payloads of as many columns are coded together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, payloads = batch.column(0), batch.column(1).to_pylist()
            for part in _slices([len(p) for p in payloads], SLICE):
                for own, words in _matrix_words(payloads[part], percent):
                    n, columns = words.shape[:2]
                    of = pa.array(np.repeat(np.array(own) + part.start, columns))
                    core = R.to_strings(_word_bases()[words & 0xFFFF].reshape(-1), np.full(n * columns, NT * (1 + ROWS)))
                    no = np.tile(np.arange(columns, dtype=np.int32), n)
                    yield pa.RecordBatch.from_arrays([keys.take(of), pa.array(np.zeros(len(no), dtype=np.int32)), pa.array(no), core], names=[key, "grp", "no", "core"])

    return df.select(F.col(key).cast("long").alias(key), "payload").mapInArrow(run, f"{key} long, grp int, no int, core string")


def _matrix_recover(words: np.ndarray, of: np.ndarray, sizes: list[int], percent: float) -> list[bytes | None]:
    """Payloads of so many bytes from the words of their strands (index, symbols); of: each strand's payload, in rising order.

    As many columns as a payload has are enough; erasures only, the first strand of a column counts. Payloads that lack the same
    columns are recovered together.
    """
    f, alike, out = field(16), {}, [None] * len(sizes)
    columns = np.array([max(1, -(-n // (2 * ROWS))) for n in sizes], dtype=np.int64)
    total = np.array([c + parity_columns(c, percent) for c in columns.tolist()], dtype=np.int64)
    known = np.flatnonzero(words[:, 0] < total[of])
    _, first = np.unique(of[known] << 16 | words[known, 0], return_index=True)
    known = known[first]  # by payload and column
    bounds = np.searchsorted(of[known], np.arange(len(sizes) + 1)).tolist()
    for i, (a, z) in enumerate(zip(bounds, bounds[1:])):
        have = words[known[a:z], 0]
        if len(have) >= columns[i]:
            alike.setdefault((int(columns[i]), have[: columns[i]].tobytes()), []).append(i)
    for (n, _), own in alike.items():
        rows = known[np.array([bounds[i] for i in own])[:, None] + np.arange(n)]
        use = words[rows[0], 0]
        missing = np.setdiff1d(np.arange(n), use)
        values, matrix = words[rows, 1:].swapaxes(0, 1), np.empty((n, len(own), ROWS), dtype=np.int64)
        matrix[use[use < n]] = values[use < n]
        if len(missing):
            matrix[missing] = f.interpolated(f.power(use), f.power(missing), values)
        for i, m in zip(own, matrix.swapaxes(0, 1).astype(">u2")):
            out[i] = m.tobytes()[: sizes[i]]
    return out


def matrix_decode(strands: list[str], size: int, percent: float = REDUNDANCY) -> bytes | None:
    """Payload of so many bytes from as many columns as it has; erasures only, the first strand of a column counts."""
    words = np.array([_regroup(_digits(s), 2, 16) for s in strands], dtype=np.int64).reshape(-1, 1 + ROWS)
    return _matrix_recover(words, np.zeros(len(words), dtype=np.int64), [size], percent)[0]


def matrix_payload(cores: Column, size: Column, percent: float = REDUNDANCY) -> Column:
    """Binary of size bytes from an array of strands, as matrix_decode has it; a strand of another length counts as lost."""

    @F.arrow_udf("binary")
    def decoded(listed: pa.Array, sizes: pa.Array) -> pa.Array:
        counts, sizes, out = listed.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), sizes.to_pylist(), []
        for part in _slices(counts, STRANDS):
            flat, lengths = R.strings(listed[part].flatten())
            of = np.repeat(np.arange(part.stop - part.start), counts[part])
            whole = lengths == NT * (1 + ROWS)
            words = _base_words(flat[np.repeat(whole, lengths)])
            out += _matrix_recover(words, of[whole], sizes[part], percent)
        return pa.array(out, type=pa.binary())

    return decoded(cores, size)


def matrix_rs_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns through the matrix code with every tenth column lost (a lone data column keeps its spare)."""
    df = table(spark, sf_dir, "conversations", spread=True).select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"))
    read = matrix_strands(df, "msg").where(F.col("no") % 10 != 3)
    listed = read.groupBy("msg").agg(F.array_sort(F.collect_list(F.struct("no", "core"))).alias("l"))  # a message's strands, no more
    met = listed.join(df, "msg").select("msg", F.octet_length("payload").alias("bytes"), "l", "payload")
    decoded = matrix_payload(F.transform("l", lambda x: x["core"]), F.col("bytes"))
    return met.select("msg", "bytes", F.size("l").alias("columns"), F.coalesce(decoded == F.col("payload"), F.lit(False)).alias("same"))


# Block code: three chained four-state machines, a CRC-8 and the final states in every block.

_NEXT = (STEP + np.arange(4)[:, None]) % 4


def _chain() -> tuple[np.ndarray, np.ndarray]:
    """Next state (of 64) and output by state and input."""
    after, out = np.zeros((64, 4), dtype=np.int64), np.zeros((64, 4), dtype=np.int64)
    for s in range(64):
        for x in range(4):
            states, y = [s >> 4, s >> 2 & 3, s & 3], x
            for k in range(3):
                states[k], y = int(_NEXT[states[k], y]), int(STEP[states[k], y])
            after[s, x], out[s, x] = states[0] << 4 | states[1] << 2 | states[2], y
    return after, out


AFTER, OUT = _chain()


def _crc8(values) -> int:
    crc = 0
    for v in values:
        crc ^= int(v)
        for _ in range(8):
            crc = (crc << 1 ^ (7 if crc & 128 else 0)) & 255
    return crc


def block_encode(data: bytes, size: int = BLOCK) -> list[str]:
    values = _regroup(np.frombuffer(data, np.uint8), 8, 2)
    out = []
    for at in range(0, len(values), size):
        own = values[at : at + size]
        own = np.concatenate([own, _regroup(np.array([_crc8(own)]), 8, 2)])
        state, word = 0, []
        for x in own:
            word.append(OUT[state, x])
            state = AFTER[state, x]
        out.append(_letters([*word, state >> 4, state >> 2 & 3, state & 3], BLOCK_BASES))
    return out


def block_candidates(block: str, errors: int) -> list[tuple[int, list[int]]]:
    """(distance, data) of what the block may have been with at most so many wrong symbols, by distance and data.

    The least number of errors from each state to the end bounds the search; a final state off the stored one costs
    its differing symbols, and other final states are tried only if the stored one gives nothing.
    """
    seen = _digits(block, BLOCK_BASES)
    word, stored = seen[:-STATE], seen[-STATE:]
    ends = np.array([sum(int(a != b) for a, b in zip(stored, (s >> 4, s >> 2 & 3, s & 3))) for s in range(64)])
    wrong = OUT[None, :, :] != word[:, None, None]
    found: list[tuple[int, int, list[int]]] = []
    for gap in range(min(errors, STATE) + 1):
        for end in np.flatnonzero(ends == gap):
            least = np.full((len(word) + 1, 64), 99)
            least[-1, end] = 0
            for i in range(len(word) - 1, -1, -1):
                least[i] = (least[i + 1][AFTER] + wrong[i]).min(axis=1)
            todo, n = [(0, 0, 0, [])], 0
            while todo and n < CANDIDATES:
                i, state, cost, path = todo.pop()
                if i == len(word):
                    data, check = path[:-CHECK], path[-CHECK:]
                    if _crc8(data) == int(_regroup(np.array(check), 2, 8)[0]):
                        found.append((cost + gap, gap, data))
                        n += 1
                    continue
                for x in range(3, -1, -1):
                    c, s = cost + int(wrong[i, state, x]), int(AFTER[state, x])
                    if c + least[i + 1, s] + gap <= errors:
                        todo.append((i + 1, s, c, [*path, x]))
        if found and gap == 0:
            break
    return [(d, data) for d, _, data in sorted(found)[:CANDIDATES]]


def block_decode(dna: str, size: int = BLOCK, beam: int = 24) -> tuple[bytes, int] | None:
    """Nearest payload and its distance: the whole message at each error budget in turn, joined by a beam."""
    full = size + CHECK + STATE
    blocks = [dna[at : at + full] for at in range(0, len(dna), full)]
    blocks = [b for b in blocks if len(b) > CHECK + STATE]
    for errors in BUDGETS:
        sets = [block_candidates(b, errors) for b in blocks]
        if all(sets):
            front: list[tuple[int, list[int]]] = [(0, [])]
            for own in sets:
                front = sorted(((d + e, v + w) for d, v in front for e, w in own[:beam]), key=lambda t: t[0])[:beam]
            values = np.array(front[0][1])
            return _regroup(values[: len(values) // 4 * 4], 2, 8).astype(np.uint8).tobytes(), front[0][0]
    return None


def block_fsm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark payloads through the block code with one wrong base in each block."""

    @F.pandas_udf("bases int, blocks int, distance int, same boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            data = (t or "").encode()
            blocks = block_encode(data)
            read = "".join(b[:9] + BLOCK_BASES[(BLOCK_BASES.index(b[9]) + 1) % 4] + b[10:] if len(b) > 9 else b for b in blocks)
            got = block_decode(read) if blocks else (b"", 0)
            rows.append((len(read), len(blocks), got[1] if got else None, bool(got) and got[0] == data))
        return pd.DataFrame(rows, columns=["bases", "blocks", "distance", "same"]).astype({"distance": "Int32"})

    return table(spark, sf_dir, "benchmark").select("item_id", run("text").alias("r")).select("item_id", "r.*")


# Constrained dimer codes of 15, 12 and 9 values a dimer: radix conversion of the whole message.


def allowed(scheme: str, before: str) -> list[str]:
    """Dimers that may follow; r2: not twice the last base; r1: no dimer of one base; r0: no base twice in a row."""
    last = before[1]
    rule = {"r2": lambda d: d != last + last, "r1": lambda d: d[0] != d[1], "r0": lambda d: d[0] != last and d[0] != d[1]}[scheme]
    return [d for d in D.DIMERS if rule(d)]


#: What may follow each dimer, and each follower's place among these: two small tables a scheme, made once.
_CHOICES = {s: {before: allowed(s, before) for before in D.DIMERS} for s in ("r2", "r1", "r0")}
_PLACES = {s: {before: {d: i for i, d in enumerate(of)} for before, of in own.items()} for s, own in _CHOICES.items()}


@functools.cache
def _fours(base: int) -> list[tuple[int, ...]]:
    """The four digits of every number that has no more."""
    return list(itertools.product(range(base), repeat=4))


def _to_digits(n: int, base: int) -> list[int]:
    """Digits by halving, which takes quasi-linear instead of quadratic time."""
    four = _fours(base)
    powers = [base**4]
    while powers[-1] <= n:
        powers.append(powers[-1] ** 2)

    def split(x: int, k: int, out: list[int]) -> None:
        if k < 0:
            out += four[x]
            return
        high, low = divmod(x, powers[k])
        split(high, k - 1, out)
        split(low, k - 1, out)

    out: list[int] = []
    split(n, len(powers) - 1, out)
    lead = next((i for i, d in enumerate(out) if d), len(out) - 1)
    return out[lead:]


def _from_digits(digits: list[int], base: int) -> int:
    while len(digits) > 1:
        if len(digits) % 2:
            digits = [0, *digits]
        digits, base = [a * base + b for a, b in zip(digits[::2], digits[1::2])], base * base
    return digits[0] if digits else 0


def constrained_encode(data: bytes, scheme: str) -> str:
    base = {"r2": 15, "r1": 12, "r0": 9}[scheme]
    n = (1 << 8 * len(data)) | int.from_bytes(data, "big") if data else 2  # the empty payload is the one bit 0
    choices, out, before = _CHOICES[scheme], [], FIRST_DIMER
    for d in _to_digits(n, base):
        before = choices[before][d]
        out.append(before)
    return "".join(out)


def constrained_decode(dna: str, scheme: str) -> bytes | None:
    places, digits, before = _PLACES[scheme], [], FIRST_DIMER
    for at in range(0, len(dna) - 1, 2):
        dimer = dna[at : at + 2]
        digit = places[before].get(dimer)
        if digit is None:
            return None
        digits.append(digit)
        before = dimer
    n = _from_digits(digits, {"r2": 15, "r1": 12, "r0": 9}[scheme])
    bits = n.bit_length() - 1
    return None if bits < 0 else (n - (1 << bits)).to_bytes(-(-bits // 8), "big")


def _long_run(dna: str) -> int:
    """The longest run of one base in a sequence of thousands."""
    values = np.frombuffer(dna.encode(), dtype=np.uint8)
    ends = np.flatnonzero(values[1:] != values[:-1])
    return int(np.diff(np.concatenate([[-1], ends, [len(values) - 1]])).max())


def constrained_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations through the constrained codes: bases, longest run, whether they decode to the payload."""
    schema = ", ".join(f"{s}_bases int, {s}_run int, {s}_same boolean" for s in ("r2", "r1", "r0"))

    @F.pandas_udf(schema)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            data, row = (t or "").encode(), []
            for s in ("r2", "r1", "r0"):
                dna = constrained_encode(data, s)
                row += [len(dna), _long_run(dna), constrained_decode(dna, s) == (data or b"\0")]
            rows.append(row)
        return pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])

    return table(spark, sf_dir, "conversations", spread=True).select("conv_id", "turn", run("text").alias("r")).select("conv_id", "turn", "r.*")


# Full strand design: hashed searches for unique indices and fillers.


def hashed_bases(seed: str, length: int) -> str:
    """Bases from SHA-256 of the seed, two bits each; beyond 128 from one further digest over and over."""
    digits = _regroup(np.frombuffer(hashlib.sha256(seed.encode()).digest(), np.uint8), 8, 2)
    if length > len(digits):
        more = _regroup(np.frombuffer(hashlib.sha256(f"{seed}|{len(digits)}".encode()).digest(), np.uint8), 8, 2)
        digits = np.concatenate([digits, *[more] * (length // len(digits))])
    return _letters(digits[:length])


def _run(dna: str) -> int:
    return max((len(r[0]) for r in re.finditer("A+|C+|G+|T+", dna)), default=0)


def sequence_score(seq: str, left: str, right: str) -> float:
    """Penalty of runs over two within and across the neighbours, of GC off one half, and of equal bases at the seams."""
    if not seq:
        return 0.0
    gc = (seq.count("G") + seq.count("C")) / len(seq)
    seams = bool(left and left[-1] == seq[0]) + bool(right and right[0] == seq[-1])
    return 100.0 * max(0, _run(left + seq + right) - 2) + 80.0 * max(0, _run(seq) - 2) + 20.0 * abs(gc - 0.5) + 10.0 * seams


def search(name: str, no: int, length: int, left: str, right: str, used: set[str] | None = None) -> str:
    """The best of TRIES hashed sequences, at once where nothing is wrong with one; none that is used."""
    best, least = "", math.inf
    for salt in range(TRIES if length > 0 else 0):
        seq = hashed_bases(f"{name}|{no}|{length}|{salt}", length)
        if used is not None and seq in used:
            continue
        score = sequence_score(seq, left, right)
        if score < least:
            best, least = seq, score
        if score <= 1e-9 and _run(left + seq + right) <= 2:
            break
    if used is not None:
        used.add(best)
    return best


def design(dna: str, total: int = 125, index: int = S.INDEX_LENGTH) -> list[tuple]:
    """no, index, payload, filler, full strand of a message."""
    f, r = D.FORWARD_PRIMER, D.REVERSE_PRIMER
    capacity = total - len(f) - len(r) - index
    used, out = set(), []
    for no, at in enumerate(range(0, len(dna), capacity), start=1):
        payload = dna[at : at + capacity]
        own = search("strand_index", no, index, f[-8:], payload[:8], used)
        filler = search("filler", no, capacity - len(payload), payload[-8:], r[:8])
        out.append((no, own, payload, filler, f + own + payload + filler + r))
    return out


def strand_design_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strands of equal length for the benchmark texts, with GC and runs."""
    df = table(spark, sf_dir, "benchmark").select("item_id", D.simple(F.coalesce("text", F.lit(""))).alias("dna"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *row) for k, dna in zip(pdf["item_id"], pdf["dna"]) for row in design(dna)]
            yield pd.DataFrame(rows, columns=["item_id", "no", "strand_index", "payload", "filler", "full_strand"])

    made = df.mapInPandas(run, "item_id long, no int, strand_index string, payload string, filler string, full_strand string")
    full = F.col("full_strand")
    return made.withColumns({"total_len": F.length(full), "gc_content": F.round(D.gc(full), 4), "longest_hp": D.longest_run(full), "hp_count": F.size(F.filter(D.runs(full), lambda r: r >= 2))})


# Alignments.


def align(a: list, b: list) -> list[tuple[int | None, int | None]]:
    """Pairs of places of a least-edit alignment, read from the end: a pair where it is as good, then a gap in b, then in a."""
    cost = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32)
    cost[0] = np.arange(len(b) + 1)
    places = np.arange(1, len(b) + 1)
    codes: dict = {}
    ca = np.array([codes.setdefault(x, len(codes)) for x in a], dtype=np.int64)
    cb = np.array([codes.setdefault(x, len(codes)) for x in b], dtype=np.int64)
    for i in range(1, len(a) + 1):
        cost[i, 0] = i
        best = np.minimum(cost[i - 1, :-1] + (cb != ca[i - 1]), cost[i - 1, 1:] + 1)
        # gaps in a run along the row: the least of what stands to the left, plus the way
        cost[i, 1:] = np.minimum(np.minimum.accumulate(np.concatenate([[i], best - places]))[1:] + places, best)
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (ca[i - 1] != cb[j - 1]):
            i, j = i - 1, j - 1
            out.append((i, j))
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
            out.append((i, None))
        else:
            j -= 1
            out.append((None, j))
    return out[::-1]


_WORD = re.compile("[A-Za-zÀ-ỹ0-9]+(?:[-'][A-Za-zÀ-ỹ0-9]+)?|[一-鿿]+")


def word_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each turn aligned with those of the turn before: counts by status, error rate, similarity of the texts."""
    t = table(spark, sf_dir, "conversations")
    before = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("before"))

    @F.pandas_udf("matches int, substitutions int, deletions int, insertions int, word_error_rate double, similarity double")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(a, b):
            u, v = ([w.lower() for w in _WORD.findall(s)] for s in (x, y))
            pairs = align(u, v)
            same = sum(i is not None and j is not None and u[i] == v[j] for i, j in pairs)
            both = sum(i is not None and j is not None for i, j in pairs)
            dele, ins = sum(j is None for _, j in pairs), sum(i is None for i, _ in pairs)
            rows.append((same, both - same, dele, ins, round((both - same + dele + ins) / max(1, len(u)), 6), round(difflib.SequenceMatcher(None, x, y).ratio(), 6)))
        return pd.DataFrame(rows, columns=["matches", "substitutions", "deletions", "insertions", "word_error_rate", "similarity"])

    return t.join(before, ["conv_id", "turn"]).select("conv_id", "turn", run("before", "text").alias("r")).select("conv_id", "turn", "r.*")


def consensus_indel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus from reads with insertions and deletions: reads of the strand's length vote place by place, the others
    through an alignment with it."""
    strands = S.strands(table(spark, sf_dir, "benchmark").select("item_id", D.simple(F.coalesce("text", F.lit(""))).alias("dna")))
    read = N.reads(strands, ["item_id", "no"], ins=0.01, dele=0.01)

    @F.pandas_udf("string")
    def calls(seqs: pd.Series, templates: pd.Series) -> pd.Series:
        def one(s: str, t: str) -> str:
            if len(s) == len(t):
                return s
            out = ["-"] * len(t)
            for i, j in align(list(s), list(t)):
                if i is not None and j is not None:
                    out[j] = s[i]
            return "".join(out)

        return pd.Series([one(s, t) for s, t in zip(seqs, templates)])

    joined = N.vote(read.select("item_id", "no", calls("seq", "template").alias("calls")), strands, ["item_id", "no"])
    joined = joined.join(strands.select("item_id", "no", "full_strand"), ["item_id", "no"])
    used = read.groupBy("item_id", "no").agg(F.count(F.lit(1)).alias("reads_used"), F.sum(F.col("n_ins") + F.col("n_del")).alias("indels"))
    return joined.join(used, ["item_id", "no"]).select("item_id", "no", "reads_used", "indels", "reconstructed_full", N.hamming(F.col("full_strand"), F.col("reconstructed_full")).alias("full_mismatches"))


QUERIES = {
    "rs_roundtrip": (rs_roundtrip, None),
    "matrix_rs_erasure": (matrix_rs_erasure, None),
    "block_fsm_roundtrip": (block_fsm_roundtrip, None),
    "constrained_roundtrip": (constrained_roundtrip, None),
    "strand_design_full": (strand_design_full, None),
    "word_alignment": (word_alignment, None),
    "consensus_indel": (consensus_indel, None),
}
