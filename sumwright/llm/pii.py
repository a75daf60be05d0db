"""Pseudonyms that keep the format of personal data.

Validated numbers and dates are put through a keyed Feistel permutation of all values of their
format. Equal values get equal pseudonyms in every document, different ones differ, and who has the
key can turn them back.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import math
import re
import string
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumwright.llm.shared import col, packed, unpacked

ROUNDS = 10


class Permutation:
    """A keyed permutation of the numbers below ``size``.

    A Feistel network over ``a * b >= size`` cells, whose halves take turns in being added to;
    values that land at ``size`` or beyond go through it again.
    """

    def __init__(self, key: bytes, label: str, size: int):
        self.size = size
        self.a = math.isqrt(max(size - 1, 0)) + 1
        self.b = -(-size // self.a)
        self.state = hashlib.blake2b(f"{label}:{size}".encode(), key=key[:64], digest_size=16)

    def _round(self, n: int, half: int) -> int:
        state = self.state.copy()
        state.update(f"{n}:{half}".encode())
        return int.from_bytes(state.digest(), "big")

    def _once(self, x: int, back: bool) -> int:
        left, right = divmod(x, self.b)
        for n in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if n % 2:
                right = (right + sign * self._round(n, left)) % self.b
            else:
                left = (left + sign * self._round(n, right)) % self.a
        return left * self.b + right

    def __call__(self, x: int, back: bool = False) -> int:
        x = self._once(x, back)
        while x >= self.size:
            x = self._once(x, back)
        return x


# Formats: a pattern, whether a match is valid, and its digits put through a permutation.


def luhn_digit(digits: str) -> str:
    """The check digit that makes ``digits`` plus itself valid."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 if i % 2 else 2)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def iban_check(country: str, account: str) -> str:
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


def refilled(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    own = iter(digits)
    return "".join(next(own) if c.isdigit() else c for c in shape)


@lru_cache(maxsize=1)
def other_codes() -> array:
    """Area and exchange as one number, in order, where one of them does not exist."""
    real = [n >= 200 and n % 100 != 11 for n in range(1000)]
    return array("l", (n for n in range(10**6) if not (real[n // 1000] and real[n % 1000])))


class Pseudonyms:
    """Replaces what it finds in a text under a key."""

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()
        self.permutations: dict[tuple[str, int], Permutation] = {}

    def permuted(self, label: str, size: int, x: int, back: bool) -> int:
        known = self.permutations.get((label, size))
        if known is None:
            known = self.permutations[label, size] = Permutation(self.key, label, size)
        return known(x, back)

    def digits(self, label: str, digits: str, back: bool) -> str:
        if not digits:
            return digits
        return f"{self.permuted(label, 10 ** len(digits), int(digits), back):0{len(digits)}d}"

    def card(self, match: re.Match, back: bool) -> str | None:
        """13 to 19 digits with a Luhn digit; the pseudonym has one as well."""
        digits = re.sub("[ -]", "", match[0])
        if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1]:
            return None
        body = self.digits("card", digits[:-1], back)
        return refilled(match[0], body + luhn_digit(body))

    def iban(self, match: re.Match, back: bool) -> str | None:
        """A country, two check digits and an account; letters stay, check digits are made anew."""
        plain = match[0].replace(" ", "")
        country, check, account = plain[:2], plain[2:4], plain[4:]
        if not 15 <= len(plain) <= 34 or iban_check(country, account) != check or check < "02":
            return None
        own = "".join(c for c in account if c.isdigit())
        changed = refilled(account, self.digits("iban", own, back))
        digits = iban_check(country, changed) + "".join(c for c in changed if c.isdigit())
        return refilled(match[0], digits)

    def phone(self, match: re.Match, back: bool) -> str | None:
        """Ten digits with area and exchange codes that exist; a country code of 1 stays.

        Written as ``+1 (ddd) ddd-dddd``, any codes do.
        """
        area, exchange, line = match["area"] or match["bare"], match["exchange"], match["line"]
        country = "".join(c for c in match["country"] or "" if c.isdigit())
        if area[0] < "2" or exchange[0] < "2" or area[1:] == "11" or exchange[1:] == "11":
            if not (match["area"] and (match["country"] or "").startswith("+")):
                return None
            # Written as a phone without doubt: permuted among the numbers with other codes.
            others = other_codes()
            x = bisect.bisect_left(others, int(area) * 1000 + int(exchange)) * 10**4 + int(line)
            x, four = divmod(self.permuted("other phone", len(others) * 10**4, x, back), 10**4)
            return refilled(match[0], f"{country}{others[x]:06d}{four:04d}")
        codes = [n for n in range(200, 1000) if n % 100 != 11]
        place = {n: i for i, n in enumerate(codes)}
        x = (place[int(area)] * len(codes) + place[int(exchange)]) * 10**4 + int(line)
        x, four = divmod(self.permuted("phone", len(codes) ** 2 * 10**4, x, back), 10**4)
        first, second = divmod(x, len(codes))
        number = f"{codes[first]}{codes[second]}{four:04d}"
        return refilled(match[0], country + number)

    def social(self, match: re.Match, back: bool) -> str | None:
        """Three, two and four digits, none all zero, the first not 666 nor from 900 on."""
        areas = [n for n in range(1, 900) if n != 666]
        area, group, serial = (int(x) for x in match[0].split("-"))
        if area not in (place := {n: i for i, n in enumerate(areas)}) or not group or not serial:
            return None
        x = (place[area] * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(self.permuted("social", len(areas) * 99 * 9999, x, back), 9999)
        area, group = divmod(x, 99)
        return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"

    def address(self, match: re.Match, back: bool) -> str | None:
        """Four numbers up to 255 without leading zeros."""
        parts = match[0].split(".")
        if any(int(p) > 255 or str(int(p)) != p for p in parts):
            return None
        x = self.permuted("address", 2**32, int.from_bytes(map(int, parts), "big"), back)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def date(self, match: re.Match, back: bool) -> str | None:
        """A day from 1900 to 2099, by the order and signs in which it is written."""
        text = match[0]
        parts = re.split("[-./]", text)
        order = (0, 1, 2) if len(parts[0]) == 4 else (2, 0, 1) if "/" in text else (2, 1, 0)
        try:
            day = datetime.date(*(int(parts[i]) for i in order))
        except ValueError:
            return None
        first, days = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days
        if not 1900 <= day.year <= 2099:
            return None
        day = first + datetime.timedelta(self.permuted("date", days, (day - first).days, back))
        made = ["", "", ""]
        for i, x in zip(order, (f"{day.year:04d}", f"{day.month:02d}", f"{day.day:02d}"), strict=True):
            made[i] = x
        sign = next(c for c in text if not c.isdigit())
        return sign.join(made)

    def email(self, match: re.Match, back: bool) -> str | None:
        """The part before ``@``: letters and digits of ASCII become others of their class."""
        classes = [next((c for c in CLASSES if x in c), x) for x in match["local"]]
        size = math.prod(map(len, classes))
        x = 0
        for letter, of in zip(match["local"], classes, strict=True):
            x = x * len(of) + of.index(letter)
        shape = "".join(of[0] for of in classes)
        x, made = self.permuted(f"email {shape}", size, x, back), []
        for of in reversed(classes):
            x, place = divmod(x, len(of))
            made.append(of[place])
        return "".join(reversed(made)) + match[0][len(match["local"]) :]

    def replaced(self, text: str | None, back: bool = False) -> tuple[str | None, list[int]]:
        """The text with pseudonyms, and how many of each of :data:`KINDS`."""
        counts = [0] * len(KINDS)
        pieces, done = [], 0
        for match, made in self.found(text or "", back):
            counts[KINDS.index(match.lastgroup)] += 1
            pieces += [text[done : match.start()], made]
            done = match.end()
        return "".join([*pieces, text[done:]]) if pieces else text, counts

    def made(self, match: re.Match, back: bool) -> str | None:
        return getattr(self, match.lastgroup)(match, back)

    def settled(self, text: str, match: re.Match, done: int, back: bool) -> str | None:
        """The pseudonym of a match after ``done``, None if it is not valid.

        It must be what a search finds first in its place, or it could not be turned back: one that
        makes what stands before it a number is put through the permutation again.
        """
        made = self.made(match, back)
        while made is not None:
            base = max(match.start() - LONGEST, done)
            look = max(base - 4, 0)  # what the patterns look back at
            again = text[look : match.start()] + made + text[match.end() : match.end() + LONGEST]
            start = match.start() - look
            stop = start + len(made)
            mail = match.lastgroup == "email"
            first = next(self.valid(again, base - look, start if mail else start + 1), None)
            if first is None if mail else first and first.span() == (start, stop) and first.lastgroup == match.lastgroup:
                break
            made = self.made(ONE[match.lastgroup].match(again, start, len(again) if mail else stop), back)
        return made

    def valid(self, text: str, begin: int, before: int) -> Iterator[re.Match]:
        """The valid readings of the numbers that start in ``text[begin:before]``, in the order they are tried."""
        for run in RUN.finditer(text, begin, before + LONGEST):
            at = max(run.start() - 3, begin)
            while (first := NUMBER.search(text, at, run.end() + 2)) and first.start() < before:
                for match in extents(first, text):
                    if self.made(match, False) is not None:
                        yield match
                at = first.start() + 1

    def found(self, text: str, back: bool) -> Iterator[tuple[re.Match, str]]:
        """Valid matches in order, without overlaps.

        A number that starts before a mail address and reaches into it comes first, and the address
        begins where it ends. Numbers inside of an address are part of it.
        """
        done, at = 0, text.find("@")
        while True:
            # The longest local parts of mail addresses have 64 characters.
            local = LOCAL.search(text, max(at - 64, done), at) if at >= 0 else None
            mail = EMAIL.match(text, local.start()) if local else None
            if at >= 0 and not mail:
                at = text.find("@", at + 1)
                continue
            while one := next(self.valid(text, done, mail.start() if mail else len(text)), None):
                yield one, self.settled(text, one, done, back)
                done = one.end()
            if not mail:
                return
            mail = EMAIL.match(text, max(mail.start(), done))
            if mail:  # else the number was all that stood before the sign
                yield mail, self.settled(text, mail, done, back)
                done = mail.end()
            at = text.find("@", max(done, at + 1))


CLASSES = (string.digits, string.ascii_lowercase, string.ascii_uppercase)
KINDS = ("email", "iban", "date", "address", "social", "phone", "card")
PATTERNS: dict[str, str] = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9]|[./-][0-9])",
    "address": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "social": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": (
        r"(?<![0-9+])(?P<country>\+?1[ .-]?)?(?:\((?P<area>[0-9]{3})\) ?|(?P<bare>[0-9]{3})[ .-])"
        r"(?P<exchange>[0-9]{3})[ .-](?P<line>[0-9]{4})(?![0-9-])"
    ),
    "card": r"(?<![0-9])(?<![0-9]-)[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}

#: More characters than any number has.
LONGEST = 64
# Every number starts within three characters before a digit and goes on in such characters.
RUN = re.compile(r"[0-9][0-9A-Z ()./+-]{6,}")
NUMBER = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS.items()))
#: Kinds that have no length of their own, so that a match can run on into what follows.
SHORTENED = ("iban", "card")
EMAIL = re.compile(r"(?P<email>(?P<local>[\w.%+-]+)@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")
LOCAL = re.compile(r"[\w.%+-]+\Z")
ONE = {kind: re.compile(f"(?P<{kind}>{pattern})") for kind, pattern in PATTERNS.items()} | {"email": EMAIL}


def extents(first: re.Match, text: str) -> Iterator[re.Match]:
    """The ways to read a match: digits without a sign between them, all of it, then ever less of it."""
    kind = first.lastgroup
    if kind not in SHORTENED:
        yield first
        return
    ends = [first.end(), *(e for e in range(first.end() - 1, first.start(), -1) if text[e] in " -")]
    if kind == "card" and ends[-1] - first.start() >= 13:
        ends = [ends[-1], *ends[:-1]]
    for end in ends:
        match = ONE[kind].match(text, first.start(), end)
        if match and match.end() == end:
            yield match


def pseudonymize(docs: DataFrame, key: str, back: bool = False, text: str = "text") -> DataFrame:
    """All rows, values in the text replaced, with ``n_<kind>`` for each of :data:`KINDS`.

    What is not valid stays as it is: a card number without its check digit, a day that does not
    exist. Left in clear are letters beyond ASCII before the ``@`` of a mail address and all that
    follows it, IBANs in lower case and phones outside of the North American plan. A pseudonym may by
    chance be the value itself. ``back`` turns pseudonyms made with the
    same key into the values. Null and empty texts stay, with counts of 0; the new columns replace
    those of the same name.
    """
    pseudonyms = Pseudonyms(key)

    @F.pandas_udf("text string, counts array<long>")
    def swap(texts: pd.Series) -> pd.DataFrame:
        rows = [pseudonyms.replaced(t, back) for t in texts]
        return pd.DataFrame({"text": [r[0] for r in rows], "counts": [r[1] for r in rows]})

    rows = packed(docs, swapped=swap(col(text)))
    counts = {f"n_{kind}": F.col("swapped.counts")[i] for i, kind in enumerate(KINDS)}
    return unpacked(rows, docs, **{text: F.col("swapped.text")}, **counts)
