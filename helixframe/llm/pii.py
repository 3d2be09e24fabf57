"""Format-preserving pseudonyms by a keyed Feistel permutation.

Card numbers (Luhn), IBANs (mod 97), IPv4 addresses, US social security numbers, phone numbers (10 to 15 digits),
calendar dates and e-mail addresses are found and validated; what fails validation stays as it is. A valid value is
numbered within the set of valid values of its format, the number is permuted by a Feistel network keyed per kind
(walking the cycle until it falls within the set), and the result is written in the same format: separators, letter
case and the place of digits stay, and a pseudonym passes the same validation. The permutation depends on key, kind and
format only, so equal values stay equal across documents, and whoever has the key can undo it (`restore`).

The key comes from the session (KEY_SETTING). Letters outside ASCII are permuted among the letters of their case in their
block of 256 characters. A local part of more than PART letters and digits is permuted in parts of that many, forwards and then
backwards, each part tweaked by a digest of those done before it, so that every character depends on all of them. Dates that name the month before the day (12/31/1999) and identifiers joined to letters are no
values of these formats and stay.
Edge cases: null and empty texts stay; values within longer words or numbers are no values; long texts and long addresses are handled
whole, in time linear in their length; repeated rows get the same pseudonyms; columns of the input that share a result's name are replaced.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Where the session names no key in KEY_SETTING. It is public: pseudonyms made with it can be undone by anyone.
KEY = b"pseudonyms, round one"
KEY_SETTING = "spark.helixframe.pseudonym.key"
ROUNDS = 10
#: Letters and digits that are permuted as one number, and the longest value whose pseudonym a worker remembers.
PART, REMEMBERED = 64, 256
KINDS = ("card", "iban", "ip", "ssn", "phone", "date", "email")

_DIGIT = re.compile(r"[0-9]")
_DOMAIN = re.compile(r"@[^\W_][\w-]*(?:\.[\w-]+)*\.[^\W\d_]{2,}")
_NOT_LOCAL = re.compile(r"[^\w.%+-]")
_NUMBER = re.compile(
    r"(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
    r"|(?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])"
    r"|(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9]|\.[0-9])"
    r"|(?P<card>[0-9]{4}([ -])[0-9]{4}\5[0-9]{4}\5[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9])"
    r"|(?P<phone>\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])"
    r"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])"
)


class Permutation:
    """Keyed permutation of 0 .. n-1: a Feistel network over Z_a x Z_b with a * b >= n, with cycle walking."""

    def __init__(self, n: int, key: bytes, tweak: str) -> None:
        self.n, self.a = n, math.isqrt(max(n - 1, 0)) + 1
        self.b = -(-n // self.a)
        self.key, self.tweak = hashlib.blake2b(key, digest_size=32).digest(), f"{tweak}:{n}:".encode()

    def _f(self, i: int, x: int, m: int) -> int:
        size = m.bit_length() // 8 + 9
        out = b"".join(hashlib.blake2b(self.tweak + b"%d:%d:%d" % (i, part, x), key=self.key, digest_size=64).digest() for part in range(-(-size // 64)))
        return int.from_bytes(out[:size], "big") % m

    def _once(self, x: int, back: bool) -> int:
        l, r = divmod(x, self.b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                r = (r + sign * self._f(i, l, self.b)) % self.b
            else:
                l = (l + sign * self._f(i, r, self.a)) % self.a
        return l * self.b + r

    def __call__(self, x: int, back: bool = False) -> int:
        while True:
            x = self._once(x, back)
            if x < self.n:
                return x


@lru_cache(maxsize=256)
def _permutation(n: int, key: bytes, tweak: str) -> Permutation:
    return Permutation(n, key, tweak)


def _fill(shape: str, digits: str) -> str:
    """`shape` with its digits replaced in turn."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in shape)


def _luhn(digits: str) -> int:
    """Sum that is a multiple of ten for a valid number."""
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(digits)))


@lru_cache(maxsize=4096)
def _alphabet(c: str) -> tuple[str, str]:
    """The characters that may take the place of c, and their name: digits, ASCII letters of its case, or the letters of its
    case in its block of 256 characters."""
    if c.isascii():
        return ("0123456789", "0") if c.isdigit() else (C.LOWER, "1") if c.islower() else (C.UPPER, "1")
    kind = lambda x: (x.isalpha(), x.isdigit(), x.islower(), x.isupper())
    block = ord(c) >> 8
    return "".join(x for x in map(chr, range(max(128, block << 8), block + 1 << 8)) if x.isalnum() and kind(x) == kind(c)), f"[{block}{kind(c)}]"


def _part(characters: str, key: bytes, tweak: str, back: bool) -> str:
    """Letters and digits permuted as one mixed-radix number; each keeps its class."""
    places = [(c, *_alphabet(c)) for c in characters]
    x, n = 0, 1
    for c, letters, _ in places:
        x, n = x * len(letters) + letters.index(c), n * len(letters)
    y, out = _permutation(n, key, tweak + "".join(name for _, _, name in places))(x, back), []
    for _, letters, _ in reversed(places):
        y, d = divmod(y, len(letters))
        out.append(letters[d])
    return "".join(reversed(out))


def _pass(parts: list[str], key: bytes, tweak: str, back: bool) -> list[str]:
    """Each part permuted under a digest of the parts before it, as they are once permuted."""
    out, state = [], b""
    for part in parts:
        new = _part(part, key, f"{tweak}:{state.hex()}:", back)
        out.append(new)
        state = hashlib.blake2b(state + (part if back else new).encode(), key=key[:64], digest_size=16).digest()
    return out


def _characters(text: str, key: bytes, kind: str, back: bool) -> str:
    """Letters and digits permuted within their classes, the others kept."""
    bare = "".join(c for c in text if c.isalnum())
    if len(bare) <= PART:
        new = iter(_part(bare, key, kind, back))
    else:
        parts = [bare[i : i + PART] for i in range(0, len(bare), PART)]
        forth, backwards = (lambda x: _pass(x, key, kind + ">", back)), (lambda x: _pass(x[::-1], key, kind + "<", back)[::-1])
        new = iter("".join(forth(backwards(parts)) if back else backwards(forth(parts))))
    return "".join(next(new) if c.isalnum() else c for c in text)


def _card(v: str, key: bytes, back: bool) -> str | None:
    digits = re.sub("[^0-9]", "", v)
    if _luhn(digits) % 10 or not digits.strip("0"):
        return None
    body = f"{_permutation(10 ** (len(digits) - 1), key, 'card')(int(digits[:-1]), back):0{len(digits) - 1}d}"
    return _fill(v, body + str(-_luhn(body + "0") % 10))


def _iban(v: str, key: bytes, back: bool) -> str | None:
    bare = v.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(bare) <= 34 or number(bare[4:] + bare[:4]) % 97 != 1:
        return None
    body = _characters(bare[4:], key, f"iban{bare[:2]}", back)
    whole = iter(f"{bare[:2]}{98 - number(body + bare[:2] + '00') % 97:02d}{body}")
    return "".join(c if c == " " else next(whole) for c in v)


def _ip(v: str, key: bytes, back: bool) -> str | None:
    octets = v.split(".")
    if any(int(o) > 255 or str(int(o)) != o for o in octets):
        return None
    x = _permutation(1 << 32, key, "ip")(int.from_bytes(bytes(map(int, octets)), "big"), back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ssn(v: str, key: bytes, back: bool) -> str | None:
    valid = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
    digits = v.replace("-", "")
    if not valid(digits):
        return None
    while True:
        digits = f"{_permutation(10**9, key, 'ssn')(int(digits), back):09d}"
        if valid(digits):
            return _fill(v, digits)


def _phone(v: str, key: bytes, back: bool) -> str | None:
    country = re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+1|", v)[0]
    rest = v[len(country) :]
    digits = re.sub("[^0-9]", "", rest)
    if not 10 <= len(digits) + len(country) - (country != "") <= 15 or len(digits) < 6:
        return None
    return country + _fill(rest, f"{_permutation(10 ** len(digits), key, 'phone' + country)(int(digits), back):0{len(digits)}d}")


_FIRST = dt.date(1000, 1, 1).toordinal()


def _date(v: str, key: bytes, back: bool) -> str | None:
    form = next(f for f, p in (("%Y-%m-%d", "....-"), ("%Y/%m/%d", "..../"), ("%d.%m.%Y", r"..\."), ("%d/%m/%Y", "../")) if re.match(p, v))
    try:
        day = dt.datetime.strptime(v, form).date()
    except ValueError:
        return None
    if day.year < 1000:
        return None
    # days of one century, so that a date stays in its era
    century = day.year // 100 * 100
    lo = dt.date(century, 1, 1).toordinal()
    hi = dt.date(century + 99, 12, 31).toordinal() + 1
    return dt.date.fromordinal(lo + _permutation(hi - lo, key, f"date{lo}")(day.toordinal() - lo, back)).strftime(form)


def _email(v: str, key: bytes, back: bool) -> str:
    local, _, domain = v.partition("@")
    return f"{_characters(local, key, 'email', back)}@{domain}"


_BY_KIND = {"card": _card, "iban": _iban, "ip": _ip, "ssn": _ssn, "phone": _phone, "date": _date, "email": _email}


@lru_cache(maxsize=4096)
def _remembered(kind: str, value: str, key: bytes, back: bool) -> str | None:
    return _BY_KIND[kind](value, key, back)


def permuted(kind: str, value: str, key: bytes = KEY, back: bool = False) -> str | None:
    """The pseudonym of a value, or None where it isn't valid."""
    return _remembered(kind, value, key, back) if len(value) <= REMEMBERED else _BY_KIND[kind](value, key, back)


def _addresses(text: str) -> list[tuple[int, int]]:
    """Begin and end of e-mail addresses: from each @ the domain forwards and the local part backwards, so time is linear in the text."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        if domain:
            begin = at
            while begin > done and not _NOT_LOCAL.match(text[begin - 1]):
                begin -= 1
            while begin < at and not text[begin].isalnum():
                begin += 1
            if begin < at:
                found.append((begin, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return found


def pseudonymise(text: str, key: bytes = KEY, back: bool = False) -> tuple[str, Counter]:
    """The text with valid values permuted, and their number by kind."""
    seen: Counter = Counter()
    if not _DIGIT.search(text) and "@" not in text:
        return text, seen

    def changed(kind: str, value: str) -> str:
        new = permuted(kind, value, key, back)
        if new is None:
            return value
        seen[kind] += 1
        return new

    def number(m: re.Match) -> str:
        before = m.string[m.start() - 1] if m.start() else " "
        if before.isalnum() or before == "_" or (m.lastgroup == "ip" and before == "."):
            return m[0]
        return changed(m.lastgroup, m[0])

    out, at = [], 0
    for begin, end in _addresses(text):  # numbers within addresses are theirs
        out += [_NUMBER.sub(number, text[at:begin]), changed("email", text[begin:end])]
        at = end
    out.append(_NUMBER.sub(number, text[at:]))
    return "".join(out), seen


def restore(text: str, key: bytes = KEY) -> str:
    """The text before `pseudonymise`, where no pseudonym has met other characters."""
    return pseudonymise(text, key, back=True)[0]


def pseudonyms(text: Column, key: bytes = KEY) -> Column:
    """Struct of the text and the number of values of each kind."""

    @F.pandas_udf(", ".join(["text string", *[f"n_{k} int" for k in KINDS]]))
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [(None, {}) if t is None else pseudonymise(t, key) for t in texts]
        return pd.DataFrame({"text": [t for t, _ in rows]} | {f"n_{k}": [int(n.get(k, 0)) for _, n in rows] for k in KINDS})

    return run(text)


def pseudonymise_documents(docs: DataFrame, text: str = "text", key: bytes = KEY) -> DataFrame:
    """docs with the text replaced and n_<kind> columns."""
    C.small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != text and c not in [f"n_{k}" for k in KINDS]]
    done = docs.select(*kept, pseudonyms(F.col(text), key).alias("__p"))
    return done.select(*kept, F.col("__p.text").alias(text), *[f"__p.n_{k}" for k in KINDS])


def session_key(spark: SparkSession) -> bytes:
    """The key that the session names, else the public one."""
    return spark.conf.get(KEY_SETTING, KEY.decode()).encode()


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: columns of docs, with pseudonyms in the text and n_chars counted again where it is there."""
    done = pseudonymise_documents(docs, key=session_key(spark))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return done.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise_documents(docs, key=session_key(spark))
