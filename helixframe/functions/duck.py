"""The same expressions in DuckDB's SQL, for the oracle."""

from __future__ import annotations

from .dna import DIMERS

HEX = "0123456789abcdef"
NIBBLES = [f"{i:04b}" for i in range(16)]

LETTERS = "ghijklmnopqrstuv"


def replaced(sql: str, pairs) -> str:
    for old, new in pairs:
        sql = f"replace({sql}, '{old}', '{new}')"
    return sql


def plain(text: str) -> str:
    return replaced(f"lower(hex(encode({text})))", zip(HEX, DIMERS))


def simple(text: str) -> str:
    return f"CASE WHEN {text} = '' THEN 'CA' ELSE 'A' || {plain(text)} END"


def unconstrained(text: str) -> str:
    return f"CASE WHEN {text} = '' THEN 'AG' ELSE 'AC' || {plain(text)} END"


def unplain_hex(dna: str) -> str:
    pairs = f"regexp_replace({dna}, '([ACGT]{{2}})', '\\1 ', 'g')"
    return replaced(pairs, ((d + " ", h) for d, h in zip(DIMERS, HEX)))


def bits(text: str) -> str:
    return replaced(f"translate(lower(hex(encode({text}))), '{HEX}', '{LETTERS}')", zip(LETTERS, NIBBLES))


def runs(dna: str) -> str:
    return f"list_transform(regexp_extract_all({dna}, '(A+|C+|G+|T+)'), lambda r: length(r))"


def base4(value: str, digits: int, alphabet: str = "ACGT") -> str:
    return f"array_to_string(list_transform(range({digits}), lambda i: substr('{alphabet}', ((({value})::BIGINT >> (2 * ({digits} - 1 - i))::BIGINT) & 3)::INT + 1, 1)), '')"


def _crc32_of(byte: int) -> int:
    for _ in range(8):
        byte = byte >> 1 ^ 0xEDB88320 * (byte & 1)
    return byte


def crc32(byte_list: str) -> str:
    """CRC-32 of a list of numbers below 256. Its byte step is linear, so the low bits' shares are added up."""
    low = "0"
    for j in range(8):
        low = f"xor({low}, ((xor(c, b) >> {j}) & 1) * {_crc32_of(1 << j)}::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte_list}), lambda c, b: xor(xor(c, b) >> 8, {low})), 4294967295::BIGINT)"


def ascii_bytes(text: str) -> str:
    return f"list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT)"


def utf8_bytes(text: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"


def uniform(seed: int, keys: str, at: int) -> str:
    return f"('0x' || substr(md5('{seed}|' || {keys}), {at}, 8))::BIGINT"
