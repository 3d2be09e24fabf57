"""Column expressions over bytes, bits and bases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base order, primers of a strand, mask of a strand's index.
BASES = "ACGT"
FORWARD_PRIMER = "ACACGACGCTCTTCCGATCT"
REVERSE_PRIMER = "AGATCGGAAGAGCACACGTCT"
INDEX_MASK = 0x1B2D3C

DIMERS = [a + b for a in BASES for b in BASES]
#: A text is recoded by hexadecimal digits twice over: the character _PAIRS[n] has n's two high bits in its first digit (from
#: 4) and its two low bits in its second, so one translation of digits and one of their digits part a nibble into dimers.
HEX = "0123456789ABCDEF"
_PAIRS = "".join(chr(0x40 + 16 * (n >> 2) + (n & 3)) for n in range(16))
_HALVES = "".join(chr(0x40 + 16 * (n >> 1) + (n & 1)) for n in range(4))
#: The same characters with their second digit from 4 as well, as unhex makes them of digits from 4 on.
_READ_PAIRS = "".join(chr(0x44 + 16 * (n >> 2) + (n & 3)) for n in range(16))
_READ_HALVES = "".join(chr(0x44 + 16 * (n >> 1) + (n & 1)) for n in range(4))


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often the body and its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rounded(value: Column, digits: int) -> Column:
    """A double at so many decimals as SQL engines of binary arithmetic say: the product with 10**digits decides, not the
    shortest decimal number that reads as the double (41 / 40 is below 1.025, so it is 1.02)."""
    return F.round(value * F.lit(10.0**digits), 0) / F.lit(10.0**digits)


def _digits(payload: Column) -> Column:
    """Two digits a nibble: its high bits plus 4, its low bits."""
    return F.hex(F.translate(F.hex(payload.cast("binary")), HEX, _PAIRS))


def _empty(payload: Column) -> Column:
    return F.octet_length(payload.cast("binary")) == 0


def plain(payload: Column) -> Column:
    """Two bits a base, no header."""
    return F.translate(_digits(payload), "01234567", BASES + BASES)


def simple(payload: Column) -> Column:
    """Header base A, then two bits a base. The empty payload counts as the one bit 0: CA."""
    return F.when(_empty(payload), "CA").otherwise(F.concat(F.lit("A"), plain(payload)))


def unconstrained(payload: Column) -> Column:
    """Radix 16 with a guard digit in front, which makes AC for whole bytes; AG for the empty payload."""
    return F.when(_empty(payload), "AG").otherwise(F.concat(F.lit("AC"), plain(payload)))


def _nibbles(digits: Column) -> Column:
    """Binary of two digits from 4 to 7 a nibble."""
    return F.unhex(F.translate(F.unhex(digits).cast("string"), _READ_PAIRS, HEX))


def unplain(dna: Column) -> Column:
    """Binary of a header-less sequence of an even number of dimers; null where it isn't one."""
    return F.when((F.length(dna) % 4 == 0) & ~F.rlike(dna, F.lit("[^ACGT]")), _nibbles(F.translate(dna, BASES, "4567")))


def whole_bytes(dna: Column) -> Column:
    """Binary of a header-less sequence of any length, with bases of 0 behind it up to a whole byte."""
    return unplain(F.rpad(dna, (F.ceil(F.length(dna) / 4) * 4).cast("int"), F.lit(BASES[0])))


def unsimple(dna: Column) -> Column:
    """Binary behind a Simple header; CA is one zero byte, other headers and odd lengths are null."""
    return F.when(dna == "CA", F.unhex(F.lit("00"))).when(F.startswith(dna, F.lit("A")), unplain(F.substring(dna, F.lit(2), F.length(dna))))


def ununconstrained(dna: Column) -> Column:
    """Binary behind the guard digit of whole bytes; AG is one zero byte."""
    return F.when(dna == "AG", F.unhex(F.lit("00"))).when(F.startswith(dna, F.lit("AC")), unplain(F.substring(dna, F.lit(3), F.length(dna))))


def bits(payload: Column) -> Column:
    """Bit string, most significant bit first."""
    return F.translate(F.hex(F.translate(_digits(payload), "01234567", _HALVES + _HALVES)), "45", "01")


def bit_pairs(bit_string: Column, letters: str) -> Column:
    """Every two bits of an even bit string as one of four letters."""
    return F.translate(F.unhex(F.translate(bit_string, "01", "45")).cast("string"), _READ_HALVES, letters)


def unbits(bit_string: Column, pad: bool = True) -> Column:
    """Binary of a bit string, padded with zeros to whole bytes, or cut to them."""
    whole = (F.ceil if pad else F.floor)(F.length(bit_string) / 8) * 8
    fitted = F.rpad(F.substring(bit_string, F.lit(1), whole.cast("int")), whole.cast("int"), F.lit("0"))
    return _nibbles(bit_pairs(fitted, "4567"))


def clean(text: Column) -> Column:
    """Bases of raw, FASTA or JSON-headed text: a first line of either header goes, then all but ACGT."""
    lines = F.filter(F.transform(F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), F.trim), lambda x: x != "")
    first = F.get(lines, F.lit(0))
    headed = F.startswith(first, F.lit(">")) | (F.startswith(first, F.lit("{")) & F.endswith(first, F.lit("}")))
    body = F.when(headed, F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    return F.upper(F.regexp_replace(F.array_join(body, ""), "[^ACGTacgt]", ""))


def bases_only(dna: Column) -> Column:
    return F.regexp_replace(F.upper(dna), "[^ACGT]", "")


def gc(dna: Column) -> Column:
    """Share of G and C; 0 for the empty sequence."""
    return F.when(F.length(dna) == 0, 0.0).otherwise(F.length(F.translate(dna, "AT", "")) / F.length(dna))


def runs(dna: Column) -> Column:
    """Lengths of the runs of one base."""
    return F.transform(F.regexp_extract_all(dna, F.lit("(A+|C+|G+|T+)"), F.lit(1)), lambda r: F.length(r))


def longest_run(dna: Column) -> Column:
    return F.coalesce(F.array_max(runs(dna)), F.lit(0))


def base4(value: Column, digits: int, alphabet: str = BASES) -> Column:
    """A number as so many base-4 digits in the letters of an alphabet."""
    return F.translate(F.lpad(F.conv(value.cast("string"), 10, 4), digits, "0"), "0123", alphabet)


def masked_index(index: Column) -> Column:
    """A strand's index as 12 bases, whitened by a mask."""
    return base4(index.bitwiseXOR(F.lit(INDEX_MASK)).bitwiseAND(F.lit(0xFFFFFF)), 12)


def crc8(bit_string: Column) -> Column:
    """CRC-8 with polynomial 0x07 over single bits."""
    step = lambda crc, bit: F.shiftleft(crc, 1).bitwiseXOR(
        F.when(F.shiftrightunsigned(crc, 7).bitwiseAND(F.lit(1)).bitwiseXOR(bit.cast("int")) == 1, 7).otherwise(0)
    ).bitwiseAND(F.lit(255))
    return F.aggregate(F.filter(F.split(bit_string, ""), lambda b: b != ""), F.lit(0), step)


def hash_uniform(seed: int, *keys: Column) -> tuple[Column, Column]:
    """Two numbers below 2**32 from MD5 of a seed and keys; SQL engines agree on them."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    return (F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))
