"""PII pseudonyms: keyed Feistel permutations within a value's own format.

Found values that pass their check (Luhn, IBAN remainder, octets, calendar and area rules) are mapped to
another value of the same format: same length, separators, letter case and character classes, and
again valid. The map is one keyed permutation for each kind and shape, so equal values
stay linked across documents and different ones stay different. It is p(p^-1(x) + 1) for a Feistel
permutation p over the numbers of the shape, walked until valid: a single cycle, so no value stays as it is.

Formats: addresses name@host.tld; IBANs; card numbers of 13 to 19 digits that pass Luhn; ddd-dd-dddd numbers; IPv4;
phone numbers that begin with + and a country code (national forms are not told apart from other numbers);
dates yyyy-mm-dd, dd/dd/yyyy and dd.mm.yyyy with two-digit parts; hexadecimal secrets of 32 to 128 digits and two token formats.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels, shared

ROUNDS = 8
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), 73049
KINDS = ("email", "iban", "secret", "ssn", "date", "ip", "phone", "card")

_PATTERN = re.compile(
    r"""
    (?P<email>(?<![\w.+%-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![A-Za-z0-9]))
    |(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
    |(?P<secret>(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36})(?![A-Za-z0-9]))
    |(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))
    |(?P<date>(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\w/-]))
    |(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9]))
    |(?P<phone>(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9]))
    |(?P<card>(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9]|[A-Za-z]))
    """,
    re.VERBOSE,
)


def luhn_ok(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_remainder(compact: str) -> int:
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


@lru_cache(1 << 14)
def _round(key: bytes, tweak: str, k: int, value: int, modulus: int) -> int:
    h = hashlib.blake2b(f"{tweak}|{k}|{value}".encode(), key=key, digest_size=24).digest()
    return int.from_bytes(h, "big") % modulus if modulus < 1 << 128 else int.from_bytes(h * (modulus.bit_length() // 192 + 1), "big") % modulus


def feistel(x: int, size: int, key: bytes, tweak: str, forward: bool = True) -> int:
    """A keyed permutation of range(size), or its inverse: alternating Feistel, walked back into the range."""
    low = 1 << ((size - 1).bit_length() // 2 or 1)
    high = -(-size // low)
    while True:
        a, b = divmod(x, low)
        for k in range(ROUNDS) if forward else reversed(range(ROUNDS)):
            sign = 1 if forward else -1
            if k % 2:
                a = (a + sign * _round(key, tweak, k, b, high)) % high
            else:
                b = (b + sign * _round(key, tweak, k, a, low)) % low
        x = a * low + b
        if x < size:
            return x


def cycled(x: int, size: int, key: bytes, tweak: str, valid=None) -> int:
    """Where the single keyed cycle over range(size) goes next from x, at the next valid number."""
    at = feistel(x, size, key, tweak, forward=False)
    while True:
        at = (at + 1) % size
        y = feistel(at, size, key, tweak)
        if valid is None or valid(y):
            return y


#: far above the 64 characters of a real address's local part
_WIDE = 512
_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _by_class(text: str, classes, key: bytes, tweak: str) -> str:
    """text with each character permuted within its class, all as one number; other characters stay. Texts of more than
    _WIDE characters are permuted in pieces, each with its place and the length of the whole as tweak."""
    if len(text) > _WIDE:
        return "".join(_by_class(text[k : k + _WIDE], classes, key, f"{tweak}:{k}:{len(text)}") for k in range(0, len(text), _WIDE))
    places = [(k, c, next((s for s in classes if c in s), None)) for k, c in enumerate(text)]
    places = [(k, s.index(c), s) for k, c, s in places if s]
    size, value = 1, 0
    for _, digit, s in places:
        value, size = value * len(s) + digit, size * len(s)
    if size < 2:
        return text
    shape = "".join("0aA?"[classes.index(s) if len(classes) > 1 else 3] for _, _, s in places)
    value = cycled(value, size, key, f"{tweak}:{shape}")
    out = list(text)
    for k, _, s in reversed(places):
        value, digit = divmod(value, len(s))
        out[k] = s[digit]
    return "".join(out)


def _refill(shape: str, chars: str, alphabet=str.isdigit) -> str:
    it = iter(chars)
    return "".join(next(it) if alphabet(c) else c for c in shape)


def _date(text: str, key: bytes) -> str | None:
    y, m, d = (text[:4], text[5:7], text[8:]) if text[4] == "-" else (text[6:], text[3:5], text[:2])
    american = text[2] == "/" and int(m) > 12
    if american:
        m, d = d, m
    try:
        n = datetime.date(int(y), int(m), int(d)).toordinal() - FIRST_DAY
    except ValueError:
        return None
    if not 0 <= n < DAYS:
        return None
    form = "iso" if text[4] == "-" else text[2] + ("a" if american else "e")

    def same_reading(k):  # a date written month first must still read so
        return not american or datetime.date.fromordinal(FIRST_DAY + k).day > 12

    new = datetime.date.fromordinal(FIRST_DAY + cycled(n, DAYS, key, f"date:{form}", same_reading))
    if form == "iso":
        return new.isoformat()
    first, second = (new.month, new.day) if american else (new.day, new.month)
    return f"{first:02d}{text[2]}{second:02d}{text[2]}{new.year:04d}"


def _ssn_ok(n: int) -> bool:
    area, group, serial = n // 1_000_000, n // 10_000 % 100, n % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


@lru_cache(1 << 16)
def pseudonym(kind: str, text: str, key: bytes) -> str | None:
    """The value that text becomes; None if it fails its check and stays."""
    if kind == "email":
        local, _, domain = text.rpartition("@")
        return f"{_by_class(local, _CLASSES, key, 'email')}@{domain}"
    if kind == "secret":
        hexa = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text)
        head = 0 if hexa else 4
        classes = ("0123456789abcdef",) if hexa and text == text.lower() else ("0123456789ABCDEF",) if hexa else ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",) if text.startswith("AKIA") else _CLASSES
        return text[:head] + _by_class(text[head:], classes, key, f"secret:{text[:head]}:{len(text)}")
    if kind == "date":
        return _date(text, key)
    if kind == "ip":
        octets = [int(o) for o in text.split(".")]
        if max(octets) > 255 or any(len(o) > 1 and o[0] == "0" for o in text.split(".")):
            return None
        n = cycled(int.from_bytes(bytes(octets), "big"), 1 << 32, key, "ip")
        return ".".join(map(str, n.to_bytes(4, "big")))
    if kind == "ssn":
        n = int(text.replace("-", ""))
        return _refill(text, f"{cycled(n, 10**9, key, 'ssn', _ssn_ok):09d}") if _ssn_ok(n) else None
    if kind == "phone":
        code = re.match(r"\+[0-9]{1,3}", text).group() if re.match(r"\+[0-9]{1,3}[ .(-]", text) else text[:2]
        rest = text[len(code) :]
        digits = re.sub(r"[^0-9]", "", rest)
        if not 7 <= len(digits) + len(code) - 1 <= 15 or len(digits) < 4:
            return None
        return code + _refill(rest, f"{cycled(int(digits), 10 ** len(digits), key, f'phone:{code}:{len(digits)}'):0{len(digits)}d}")
    if kind == "card":
        digits = re.sub(r"[ -]", "", text)
        if not luhn_ok(digits) or not digits.strip("0"):
            return None
        body = f"{cycled(int(digits[:-1]), 10 ** (len(digits) - 1), key, f'card:{len(digits)}'):0{len(digits) - 1}d}"
        return _refill(text, body + next(c for c in "0123456789" if luhn_ok(body + c)))
    compact = text.replace(" ", "")
    if iban_remainder(compact) != 1:
        return None
    body = _by_class(compact[4:], _CLASSES, key, f"iban:{compact[:2]}")
    check = 98 - iban_remainder(compact[:2] + "00" + body)
    return _refill(text, f"{compact[:2]}{check:02d}{body}", str.isalnum)


def redact(text: str, key: bytes) -> tuple[str, list[int]]:
    """The text with pseudonyms, and the number of replaced values of each of KINDS."""
    counts = [0] * len(KINDS)

    def put(m):
        new = pseudonym(m.lastgroup, m.group(), key)
        if new is None:
            return m.group()
        counts[KINDS.index(m.lastgroup)] += 1
        return new

    return _PATTERN.sub(put, text), counts


def _suspects(column: pa.Array) -> np.ndarray:
    """Rows that hold a digit, @ or a secret's mark: no other row can match."""
    out = np.zeros(len(column), bool)
    kind = np.zeros(256, bool)
    kind[[*range(48, 58), 64]] = True
    for lo, hi, data, offs in kernels.chunks(column, rows=1 << 30):
        total = np.concatenate([[0], np.cumsum(kind[data])])
        out[lo:hi] = total[offs[1:]] > total[offs[:-1]]
        marks = np.flatnonzero((data[:-3] == 65) & (data[1:-2] == 75) & (data[2:-1] == 73) & (data[3:] == 65)) if len(data) > 3 else []
        marks = np.concatenate([marks, np.flatnonzero((data[:-2] == 103) & (data[1:-1] == 104) & (data[2:] >= 111))]).astype(np.int64) if len(data) > 3 else marks
        if len(marks):
            out[lo + np.searchsorted(offs, marks, side="right") - 1] = True
    # hexadecimal runs without a digit are left to the pattern only where one is long enough
    return out


def pseudonymise(docs: DataFrame, key: bytes | str, text_col: str = "text", count_col: str = "n_pii", kinds_col: str = "pii_kinds") -> DataFrame:
    """docs with text_col rewritten, count_col (long) and kinds_col (array of the kinds found).

    A clashing count or kinds column gives way. Null stays null, empty stays empty; whole texts are
    read. Repeated rows are rewritten alike. Values that fail their check stay. Runs of hexadecimal letters without any digit are no
    secrets. One pass of the workers, no shuffle.
    """
    key = (key.encode() if isinstance(key, str) else key)[:64]
    docs = docs.select([c for c in docs.columns if c not in (count_col, kinds_col)])
    place = docs.columns.index(text_col)
    fields = docs.selectExpr("*", f"cast(0 as long) as `{count_col}`", f"array('') as `{kinds_col}`").schema

    def run(batches):
        for b in batches:
            column = b.column(place)
            hit = np.flatnonzero(_suspects(column))
            texts, counts, kinds = None, np.zeros(b.num_rows, np.int64), [[] for _ in range(b.num_rows)]
            for k in hit:
                new, found = redact(column[k].as_py() or "", key)
                if any(found):
                    texts = texts if texts is not None else column.to_pylist()
                    texts[k], counts[k], kinds[k] = new, sum(found), [n for n, f in zip(KINDS, found) if f]
            columns = list(b.columns)
            if texts is not None:
                columns[place] = pa.array(texts, column.type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts), pa.array(kinds, pa.list_(pa.string()))], names=[*b.schema.names, count_col, kinds_col])

    return docs.mapInArrow(run, fields)
