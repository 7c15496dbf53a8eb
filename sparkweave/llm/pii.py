"""Personal data replaced by format-preserving pseudonyms.

A validated number, date or address is put on the whole numbers below the count of valid values of its
format, moved by a keyed Feistel network that permutes them, and written in that format again: equal
values get equal pseudonyms in every document, different ones different pseudonyms, and whoever has the
key can turn them back.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import isqrt, prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

KINDS = ("email", "card", "iban", "ssn", "phone", "ip", "date")
ROUNDS = 8
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# The two-digit country codes of the international numbering plan. 1 and 7 have one digit, all others three.
TWO_DIGIT_CODES = frozenset(
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049  # to the end of 2099


class Feistel:
    """Keyed permutations of 0 .. n - 1 for any n: two unequal halves, added to in turn, walked until below n."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, half: int, most: int) -> int:
        data = b"%d|%d|%s" % (i, half, tweak)
        width = (most.bit_length() + 7) // 8 + 8
        if width <= 64:
            return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=width).digest()) % most
        return int.from_bytes(hashlib.shake_256(self.key + data).digest(width)) % most

    def move(self, value: int, n: int, tweak: bytes, back: bool = False) -> int:
        if n < 2:
            return value
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = divmod(value, b)  # left < a, right < b
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                sign = -1 if back else 1
                if i % 2:
                    right = (right + sign * self._round(tweak, i, left, b)) % b
                else:
                    left = (left + sign * self._round(tweak, i, right, a)) % a
            value = left * b + right
            if value < n:
                return value


def luhn(digits: str) -> int:
    """The check digit for these digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


class Pseudonyms:
    def __init__(self, key: bytes):
        self.feistel = Feistel(key)

    def classes(self, text: str, tweak: bytes, back: bool) -> str:
        """Every ASCII letter and digit becomes one of its kind; all else stays."""
        kinds = [LOWER if c in LOWER else UPPER if c in UPPER else DIGITS if c in DIGITS else "" for c in text]
        value, n = 0, prod(len(k) for k in kinds if k)
        for c, k in zip(text, kinds, strict=True):
            if k:
                value = value * len(k) + k.index(c)
        value = self.feistel.move(value, n, tweak + "".join(k[:1] or c for c, k in zip(text, kinds, strict=True)).encode(), back)
        out = []
        for c, k in zip(reversed(text), reversed(kinds), strict=True):
            if k:
                value, d = divmod(value, len(k))
                c = k[d]
            out.append(c)
        return "".join(reversed(out))

    def _fill(self, text: str, digits: str) -> str:
        given = iter(digits)
        return "".join(next(given) if c in DIGITS else c for c in text)

    def email(self, text: str, back: bool = False) -> str:
        """The name and the domain up to its last dot; letters in either case are equal, and each keeps its case."""
        name, _, domain = text.lower().partition("@")
        host, _, top = domain.rpartition(".")
        moved = f"{self.classes(name, b'email', back)}@{self.classes(host, b'domain', back)}.{top}"
        return "".join(m.upper() if c in UPPER else m for c, m in zip(text, moved, strict=True))

    def card(self, text: str, back: bool = False) -> str | None:
        """The first digit stays, the check digit follows; None unless it is right."""
        digits = re.sub(r"\D", "", text)
        if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]):
            return None
        n = 10 ** (len(digits) - 2)
        body = digits[0] + str(self.feistel.move(int(digits[1:-1]), n, b"card" + digits[0].encode(), back)).zfill(len(digits) - 2)
        return self._fill(text, body + str(luhn(body)))

    def iban(self, text: str, back: bool = False) -> str | None:
        """The country stays, the check digits follow; None unless they are right."""
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
            return None
        body = self.classes(plain[4:], b"iban" + plain[:2].encode(), back)
        moved = plain[:2] + f"{98 - _mod97(body + plain[:2] + '00'):02d}" + body
        given = iter(moved)
        return "".join(c if c == " " else next(given) for c in text)

    def ssn(self, text: str, back: bool = False) -> str | None:
        """Numbers that are issued become such numbers; None for others."""
        area, group, serial = (int(x) for x in text.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        place = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        place = self.feistel.move(place, 898 * 99 * 9999, b"ssn", back)
        rest, serial = divmod(place, 9999)
        area, group = divmod(rest, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def phone(self, text: str, back: bool = False) -> str | None:
        """The country's code stays, by the numbering plan; None for fewer than 7 or more than 15 other digits.

        Marks between digits don't count, and ten digits without a plus are the same number as after +1.
        """
        digits = re.sub(r"\D", "", text)
        code = "" if text[0] != "+" else digits[:1] if digits[0] in "17" else digits[:2] if digits[:2] in TWO_DIGIT_CODES else digits[:3]
        rest = digits[len(code) :]
        if not 7 <= len(rest) <= 15:
            return None
        tweak = code or ("1" if len(rest) == 10 else "")
        moved = self.feistel.move(int(rest), 10 ** len(rest), b"phone" + tweak.encode(), back)
        return self._fill(text, code + str(moved).zfill(len(rest)))

    def ip(self, text: str, back: bool = False) -> str | None:
        parts = [int(x) for x in text.split(".")]
        if len(parts) != 4 or any(p > 255 for p in parts) or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
            return None
        value = self.feistel.move(int.from_bytes(bytes(parts)), 1 << 32, b"ip", back)
        return ".".join(map(str, value.to_bytes(4)))

    def date(self, text: str, back: bool = False) -> str | None:
        """Days of 1900 to 2099, year first or last; None for others. Day first, unless only month first is a day."""
        a, mark, b, _, c = re.match(r"(\d+)([-/.])(\d+)([-/.])(\d+)$", text).groups()
        wide = len(a) == 4
        y, m, d = (a, b, c) if wide else (c, b, a)
        month_first = False
        if not wide and int(m) > 12:
            m, d, month_first = d, m, True
        try:
            day = datetime.date(int(y), int(m), int(d)).toordinal() - _FIRST_DAY
        except ValueError:
            return None
        if not 0 <= day < _DAYS:
            return None
        to = datetime.date.fromordinal(_FIRST_DAY + self.feistel.move(day, _DAYS, b"date", back))
        if month_first and to.day <= 12:
            month_first = False  # it would be read day first
        first, last = (to.month, to.day) if month_first else (to.day, to.month)
        return f"{to.year}{mark}{to.month:02d}{mark}{to.day:02d}" if wide else f"{first:02d}{mark}{last:02d}{mark}{to.year}"

    def replace(self, text: str, counts: Counter | None = None, back: bool = False) -> str:
        """The whole text with a pseudonym for everything that is valid personal data."""

        out, at, pos = [], 0, 0
        while match := _FOUND.search(text, pos):
            kind, found = match.lastgroup, match[0]
            new = getattr(self, kind)(found, back)
            if new is None and kind == "iban":
                # the match may go on into the next words: try what ends at an earlier space
                for i in reversed([i for i, c in enumerate(found) if c == " "]):
                    if (new := self.iban(found[:i], back)) is not None:
                        found = found[:i]
                        break
            pos = match.start() + len(found)
            if new is not None:
                if counts is not None:
                    counts[kind] += 1
                out += [text[at : match.start()], new]
                at = pos
        return "".join([*out, text[at:]])


# Every alternative starts at a character that few places of a text have.
_FOUND = re.compile(
    r"""(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})
    |(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\ ?[A-Z0-9]{4}){2,7}(?:\ ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))
    |(?<![A-Za-z0-9])(?:
      (?P<date>(?:[0-9]{4}(?P<m1>[-/.])[0-9]{2}(?P=m1)[0-9]{2}|[0-9]{2}(?P<m2>[-/.])[0-9]{2}(?P=m2)[0-9]{4})(?![A-Za-z0-9]))
      |(?P<ip>(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9]))
      |(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-]))
      |(?P<card>(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![A-Za-z0-9]))
      |(?P<phone>(?:(?:\+1[ .-]?)?(?:\([0-9]{3}\)\ ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})){2,5})(?![A-Za-z0-9]))
    )""",
    re.X,
)


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, the text with pseudonyms, and n_<kind> for every kind.

    Null text stays null and empty text empty, with zero counts. Null ids and repeated rows pass through
    one to one, equal rows alike; an empty table gives none; other columns are dropped whatever their
    names. Numbers that fail their check, impossible dates and addresses stay as they are. A text takes
    one pass of a pattern whatever its length. The key is a secret of the caller's, of 8 bytes at least.
    """
    if len(key) < 8:
        raise ValueError("the key needs 8 bytes at least")
    names = Pseudonyms(key)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = [], {k: [] for k in KINDS}
            for text in batch.column(1).to_pylist():
                counts: Counter = Counter()
                texts.append(text if text is None else names.replace(text, counts))
                for k in KINDS:
                    found[k].append(counts[k])
            columns = [batch.column(0), pa.array(texts, pa.string()), *(pa.array(c, pa.int64()) for c in found.values())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text", *(f"n_{k}" for k in KINDS)])

    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    fields = ", ".join(["id long", "text string", *(f"n_{k} long" for k in KINDS)])
    return named.mapInArrow(tidied(rows), fields).withColumnsRenamed({"id": id_col, "text": text_col})
