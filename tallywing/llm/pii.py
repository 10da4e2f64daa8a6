"""Format-preserving pseudonyms for personal numbers, dates and mail names.

A value is taken for personal only if it is valid: cards by their check digit, IBANs by theirs, social security numbers
by the ranges of their parts, addresses by octets, dates by the calendar. For a phone number a written country code or an
area code in brackets is enough, whatever its digits; ten bare digits in groups must also have an area code and an exchange that
don't begin with 0 or 1. The value is then numbered within the set of all values of its kind (phone numbers that begin a part
with 0 or 1 are a set of their own), the number is permuted by a keyed Feistel network, and the result is written in the
format found. A pseudonym is itself valid in the same sense, equal values have equal pseudonyms in all documents, and the key gives the value
back (`back=True`; a day or month of one digit may come back with a zero in front).

Kinds: mail (the name before the @, letters and digits in place), phone (North American numbers), card, iban, ssn, ip
(IPv4), date (years 1900 to 2099; year-month-day, or day and month first with /, . or -; of these the month comes
first if it can, with / only).

Defined cases: a NULL text stays NULL and an empty one empty; overlapping finds go to the first kind of the list, at one place to
the longest; rows with equal or NULL ids are handled each; an empty table gives an empty result; texts of any length are read whole;
further columns pass through `pseudonymise` unless they have the name of a result column, which then wins.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywing.llm.spans import Texts, steps

KINDS = ["mail", "iban", "card", "phone", "ssn", "ip", "date"]

ROUNDS = 10

_FIND = re.compile(
    r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<card>(?<![\w.+-])(?:\d{13,19}|\d{4}(?P<gap>[ -])(?:\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{6}(?P=gap)\d{4,5}))(?![\w-]))"
    r"|(?P<phone>(?<![\w.])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-]))"
    r"|(?P<ssn>(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
    r"|(?P<date>(?<![\w./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}(?P<sep>[/.-])\d{1,2}(?P=sep)\d{4})(?![\w/-]|\.\d))"
)
_MAIL = re.compile(r"(?<![\w.+%-])([A-Za-z0-9][A-Za-z0-9._%+-]*)(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")


def _round(key: bytes, tweak: bytes, i: int, half: int, size: int) -> int:
    raw = half.to_bytes((half.bit_length() + 7) // 8 + 1, "big")
    digest = hashlib.blake2b(raw, key=key[:64], person=(tweak + bytes([i]))[:16], digest_size=32).digest()
    while len(digest) * 8 < size.bit_length() + 64:
        digest += hashlib.blake2b(digest, key=key[:64], digest_size=32).digest()
    return int.from_bytes(digest, "big") % size


def permute(x: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of range(size): an even Feistel network on two halves, walked until it is in range."""
    if size < 2:
        return x
    half = 1
    while half * half < size:
        half = half * 2 if half * half * 4 < size else half + 1 if size < 4 else half * 2
    while True:
        a, b = divmod(x, half)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                a, b = (b - _round(key, tweak, i, a, half)) % half, a
            else:
                a, b = b, (a + _round(key, tweak, i, b, half)) % half
        x = a * half + b
        if x < size:
            return x


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _refill(pattern: str, values: str) -> str:
    """`pattern` with its ASCII letters and digits replaced in order by `values`."""
    it = iter(values)
    return "".join(next(it) if c.isascii() and c.isalnum() else c for c in pattern)


def _mixed(s: str) -> tuple[int, int]:
    """Number of the string among those with letters and digits, small and large, at the same places; and their count."""
    x, size = 0, 1
    for c in s:
        base, at = (10, ord(c) - 48) if c.isdigit() else (26, ord(c) - (97 if c.islower() else 65))
        x, size = x * base + at, size * base
    return x, size


def _unmix(x: int, like: str) -> str:
    out = []
    for c in reversed(like):
        x, at = divmod(x, 10 if c.isdigit() else 26)
        out.append(chr(at + (48 if c.isdigit() else 97 if c.islower() else 65)))
    return "".join(reversed(out))


Move = Callable[[int, int], int]


def _swap_mail(s: str, move: Move) -> str | None:
    own = "".join(c for c in s if c.isalnum())
    x, size = _mixed(own)
    return _refill(s, _unmix(move(x, size), own))


def _luhn(digits: str) -> int:
    """The check digit behind `digits`."""
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return -total % 10


def _swap_card(s: str, move: Move) -> str | None:
    d = _digits(s)
    if not 13 <= len(d) <= 19 or _luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    body = str(move(int(d[1:-1]), 10 ** (len(d) - 2))).zfill(len(d) - 2)  # the first digit names the industry
    return _refill(s, d[0] + body + str(_luhn(d[0] + body)))


def _iban_rest(code: str, body: str) -> int:
    return int("".join(str(int(c, 36)) for c in body + code + "00")) % 97


def _swap_iban(s: str, move: Move) -> str | None:
    own = s.replace(" ", "")
    code, check, body = own[:2], own[2:4], own[4:]
    if not 15 <= len(own) <= 34 or check != str(98 - _iban_rest(code, body)).zfill(2):
        return None
    x, size = _mixed(body)
    body = _unmix(move(x, size), body)
    return _refill(s, code + str(98 - _iban_rest(code, body)).zfill(2) + body)


def _swap_phone(s: str, move: Move) -> str | None:
    d = _digits(s)
    head, d = d[:-10], d[-10:]
    if d[0] in "01" or d[3] in "01":
        if not head and "(" not in s:
            return None
        # The other numbers of ten digits: first those with a small area code, then those with only a small exchange.
        area, rest = int(d[:3]), int(d[3:])
        x = area * 10_000_000 + rest if area < 200 else 2_000_000_000 + (area - 200) * 2_000_000 + rest
        x = move(x, 3_600_000_000)
        if x < 2_000_000_000:
            return _refill(s, f"{head}{x:010d}")
        area, rest = divmod(x - 2_000_000_000, 2_000_000)
        return _refill(s, f"{head}{area + 200}{rest:07d}")
    x = ((int(d[0]) - 2) * 100 + int(d[1:3])) * 800 + (int(d[3]) - 2) * 100 + int(d[4:6])
    area, line = divmod(move(x * 10_000 + int(d[6:]), 800 * 800 * 10_000), 8_000_000)
    exchange, line = divmod(line, 10_000)
    return _refill(s, f"{head}{area + 200}{exchange + 200}{line:04d}")


def _swap_ssn(s: str, move: Move) -> str | None:
    area, group, serial = map(int, s.split("-"))
    if not 1 <= area <= 899 or area == 666 or group == 0 or serial == 0:
        return None
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(move(x, 898 * 99 * 9999), 9999)
    area, group = divmod(x, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def _swap_ip(s: str, move: Move) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    x = move(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32)
    return ".".join(map(str, x.to_bytes(4, "big")))


_DAY0, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


def _swap_date(s: str, move: Move) -> str | None:
    a, b, c = re.split(r"[/.-]", s)
    sep = s[len(a)]
    orders = [(a, b, c)] if len(a) == 4 else [(c, a, b), (c, b, a)] if sep == "/" else [(c, b, a)]
    for n, (y, m, d) in enumerate(orders):
        try:
            day = (date(int(y), int(m), int(d)) - _DAY0).days
        except ValueError:
            continue
        if not 0 <= day < _DAYS:
            return None
        while True:
            day = move(day, _DAYS)
            new = _DAY0 + timedelta(days=day)
            # A day-first date must be read day-first again, so its month can't stand in front.
            if n == 0 or new.day > 12:
                break
        short = [p for p in (a, b, c) if len(p) < 4]
        width = 2 if all(len(p) == 2 for p in short) else 1
        month, day_ = str(new.month).zfill(width), str(new.day).zfill(width)
        if len(a) == 4:
            return f"{new.year}{sep}{month}{sep}{day_}"
        first, second = (month, day_) if sep == "/" and n == 0 else (day_, month)
        return f"{first}{sep}{second}{sep}{new.year}"
    return None


_SWAP: dict[str, Callable[[str, Move], str | None]] = {
    "mail": _swap_mail, "iban": _swap_iban, "card": _swap_card, "phone": _swap_phone, "ssn": _swap_ssn, "ip": _swap_ip,
    "date": _swap_date,
}


@lru_cache(maxsize=100_000)
def swap(kind: str, value: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a value as it is written; None if it isn't valid. With `back`, the value of a pseudonym."""
    return _SWAP[kind](value, lambda x, size: permute(x, size, key, kind.encode(), back))


def swap_all(text: str, key: bytes, back: bool = False) -> tuple[str, dict[str, int]]:
    """A text with all valid values swapped, and how many of each kind there were."""
    counts = dict.fromkeys(KINDS, 0)

    def one(m: re.Match) -> str:
        kind = next(k for k in KINDS[1:] if m[k] is not None)
        new = swap(kind, m[kind], key, back)
        counts[kind] += new is not None
        return m[0] if new is None else new

    def mail(m: re.Match) -> str:
        counts["mail"] += 1
        return f"{swap('mail', m[1], key, back)}{m[2]}"

    out, at = [], 0  # what a mail address covers isn't looked at again
    for m in _MAIL.finditer(text) if "@" in text else ():
        out += [_FIND.sub(one, text[at : m.start()]), mail(m)]
        at = m.end()
    return "".join([*out, _FIND.sub(one, text[at:])]), counts


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """`docs` with pseudonyms in `text`, and the columns n_mail, n_iban and so on, and n_found. With `back`, the other way."""
    counts = [f"n_{k}" for k in KINDS]
    others = [c for c in docs.columns if c not in ("text", *counts, "n_found")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                t = Texts(part.column("text"))
                flags = np.concatenate([[0], np.cumsum((t.buf == 64) | ((t.buf >= 48) & (t.buf <= 57)))])
                some = np.flatnonzero(np.diff(flags[t.at]) > 0)
                found = np.zeros((part.num_rows, len(KINDS)), np.int32)
                texts = part.column("text")
                if len(some):
                    new = texts.to_pylist()
                    for i in some.tolist():
                        new[i], n = swap_all(new[i], key, back)
                        found[i] = [n[k] for k in KINDS]
                    texts = pa.array(new, pa.string())
                columns = [*(part.column(c) for c in others), texts, *(pa.array(found[:, j]) for j in range(len(KINDS)))]
                yield pa.record_batch([*columns, pa.array(found.sum(axis=1, dtype=np.int32))], [*others, "text", *counts, "n_found"])

    rows = docs.select(*[F.col(f"`{c}`") for c in others], F.col("text").cast("string").alias("text"))
    schema = T.StructType([*rows.schema.fields, *(T.StructField(c, T.IntegerType()) for c in (*counts, "n_found"))])
    return rows.mapInArrow(run, schema)
