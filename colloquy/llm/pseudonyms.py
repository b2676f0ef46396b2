"""Format-preserving pseudonyms by a keyed Feistel permutation.

Personal values are found, validated, and permuted among the valid values of
their own format: a card number stays a number of as many digits whose check digit
holds, a date stays a date. The permutation depends on the key and the kind of
value alone, so equal values are equal in all documents, however they are written.
No value is its own pseudonym.

Kinds: e-mail addresses (letters of any script and digits before the @; marks where there is neither),
IBANs (mod 97), hex secrets of 32 digits or more, dates from 1900 to 2099, IPv4 and IPv6 addresses, US social
security numbers, telephone numbers (with a country code, in US grouping, or after a word such as "tel"), and
card or account numbers of 13 to 19 digits (a valid Luhn digit stays valid, another stays invalid).

Days up to the 12th and later ones are permuted apart: so a date that is written month first, which only
a later day shows, still reads so, and different dates never get one pseudonym in any format.
A telephone number's country code stays and the rest is permuted, whatever stands between its digits.

Everything happens in the row, without a shuffle. Defined results: a null text
stays null with no values; rows that repeat get the same pseudonyms; other columns,
whatever their names, are kept.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import math
import re
import string
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from .store import fields

ROUNDS = 10
FIRST_DAY = dt.date(1900, 1, 1).toordinal()
DAYS = dt.date(2099, 12, 31).toordinal() - FIRST_DAY + 1
EARLY, LATE = ([d for d in range(DAYS) if (dt.date.fromordinal(FIRST_DAY + d).day > 12) == late] for late in (False, True))
# The telephone country codes of one and two digits; all others have three.
SHORT_CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)
MONTHS = "January February March April May June July August September October November December".split()
# Addresses that name no one.
PLAIN_ADDRESSES = frozenset(("0.0.0.0", "127.0.0.1", "255.255.255.255"))

# An IBAN of this length is looked for first, then any with valid check digits.
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS",
        23: "AE GI IL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL",
        29: "BR PS QA UA", 30: "JO KW MU", 31: "MT",
    }.items()
    for country in countries.split()
}


class Permutation:
    """A keyed permutation of 0 .. n-1 without fixed points, for n > 1.

    A Feistel network permutes pairs (a, b) that number at least n; values of n or
    more are walked on until one below n comes up. With E for that, a value x goes
    to the inverse of E at E(x) + step, which is never x.
    """

    def __init__(self, key: bytes, kind: str, n: int):
        self.n = n
        self.left = max(2, math.isqrt(max(n - 1, 0)) + 1)
        self.right = max(2, -(-n // self.left))
        self.hash = hashlib.blake2b(f"{kind}/{n}".encode(), key=hashlib.blake2b(key, digest_size=32).digest(), digest_size=24)
        self.step = 1 + self._round(-1, n) % (n - 1) if n > 1 else 0

    def _round(self, number: int, value: int) -> int:
        state = self.hash.copy()
        state.update(b"%d/%d" % (number, value))
        return int.from_bytes(state.digest(), "big")

    def _forward(self, x: int) -> int:
        a, b = divmod(x, self.right)
        for k in range(ROUNDS):
            if k % 2:
                b = (b + self._round(k, a)) % self.right
            else:
                a = (a + self._round(k, b)) % self.left
        return a * self.right + b

    def _backward(self, x: int) -> int:
        a, b = divmod(x, self.right)
        for k in reversed(range(ROUNDS)):
            if k % 2:
                b = (b - self._round(k, a)) % self.right
            else:
                a = (a - self._round(k, b)) % self.left
        return a * self.right + b

    def _walk(self, step: Callable[[int], int], x: int) -> int:
        x = step(x)
        while x >= self.n:
            x = step(x)
        return x

    def __call__(self, x: int) -> int:
        if self.n < 2:
            return x
        return self._walk(self._backward, (self._walk(self._forward, x) + self.step) % self.n)


def luhn_digit(digits: str) -> str:
    """The check digit that makes digits + it a valid number."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_digits(country: str, account: str) -> str:
    """The two check digits of an IBAN."""
    number = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(number) % 97:02d}"


MARKS = "+-._"


@lru_cache(4096)
def alphabet(c: str) -> str:
    """The characters among which a lower-case character is permuted: a-z, 0-9, or the letters of its
    part of Unicode that change case as it does; itself alone if it is no letter."""
    if "a" <= c <= "z":
        return string.ascii_lowercase
    if "0" <= c <= "9":
        return string.digits
    if not c.isalpha() or c.isupper():
        return c

    def behaviour(x: str) -> tuple:
        return x.upper() == x, x.upper().lower() == x

    block = map(chr, range(ord(c) & ~127, (ord(c) | 127) + 1))
    return "".join(x for x in block if x.isalpha() and not x.isupper() and behaviour(x) == behaviour(c))


class Pseudonyms:
    """Finds the values of a text and gives their replacements."""

    def __init__(self, key: bytes):
        self.key = key
        self.permutations: dict[tuple[str, int], Permutation] = {}

    def permuted(self, kind: str, n: int, x: int) -> int:
        found = self.permutations.get((kind, n))
        if found is None:
            if len(self.permutations) > 10_000:
                self.permutations.clear()
            found = self.permutations[kind, n] = Permutation(self.key, kind, n)
        return found(x)

    def mixed(self, kind: str, text: str) -> str:
        """Letters go to letters of their script and digits to digits; all else stays, as does case.

        A text of marks alone has these replaced.
        """
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        sets = [alphabet(c) for c in lower]
        if not any(len(x) > 1 for x in sets):
            sets = [MARKS if c in MARKS else x for c, x in zip(lower, sets)]
        value, size = 0, 1
        for c, letters in zip(lower, sets):
            value, size = value * len(letters) + letters.index(c), size * len(letters)
        value = self.permuted(kind + "/" + "".join(x[0] if len(x) > 1 else c for c, x in zip(lower, sets)), size, value)
        out = []
        for c, letters in zip(reversed(text), reversed(sets)):
            value, place = divmod(value, len(letters))
            new = letters[place]
            out.append(new.upper() if c.isupper() and len(new.upper()) == 1 else new)
        return "".join(reversed(out))

    def digits(self, kind: str, digits: str, valid: Callable[[str], bool] | None = None) -> str:
        """Digits go to as many digits; with ``valid``, walked on until they are so."""
        n, x = 10 ** len(digits), int(digits)
        start = x
        while True:
            x = self.permuted(kind, n, x)
            new = f"{x:0{len(digits)}d}"
            if valid is None or valid(new) or x == start:
                return new

    @staticmethod
    def in_place(text: str, digits: str) -> str:
        """The digits of the text replaced one by one."""
        new = iter(digits)
        return re.sub("[0-9]", lambda _: next(new), text)

    # Each kind: the replacement of a match, or None if the value is not valid.

    def email(self, m: re.Match) -> str:
        local, at, domain = m[0].partition("@")
        return self.mixed("email@" + domain.lower(), local) + at + domain

    def iban(self, m: re.Match) -> str | None:
        """As long as the IBAN, which upper-case words may follow in the match."""
        ends = [k.start() for k in re.finditer(" |$", m[0])]
        usual = IBAN_LENGTHS.get(m[0][:2].upper())
        for end in sorted(ends, key=lambda end: (end - m[0].count(" ", 0, end) != usual, -end)):
            value = m[0][:end].replace(" ", "").upper()
            country, check, account = value[:2], value[2:4], value[4:]
            if 11 <= len(account) <= 30 and iban_digits(country, account) == check:
                account = self.mixed("iban" + country, account)
                new = iter(country + iban_digits(country, account) + account)
                return "".join(c if c == " " else next(new).lower() if c.islower() or (c.isdigit() and m[0].islower()) else next(new) for c in m[0][:end])
        return None

    def secret(self, m: re.Match) -> str | None:
        value = m[0].lower()
        if value.isdigit() or value.isalpha():
            return None
        new = f"{self.permuted('secret', 16 ** len(value), int(value, 16)):0{len(value)}x}"
        return new.upper() if m[0] == m[0].upper() else new

    def _day(self, year: int, month: int, day: int) -> dt.date | None:
        try:
            ordinal = dt.date(year, month, day).toordinal() - FIRST_DAY
        except ValueError:
            return None
        if not 0 <= ordinal < DAYS:
            return None
        kind, days = ("late day", LATE) if day > 12 else ("early day", EARLY)
        return dt.date.fromordinal(days[self.permuted(kind, len(days), bisect_left(days, ordinal))] + FIRST_DAY)

    def iso_date(self, m: re.Match) -> str | None:
        day = self._day(int(m["y"]), int(m["m"]), int(m["d"]))
        return day and f"{day.year}{m['s1']}{day.month:02d}{m['s1']}{day.day:02d}"

    def day_first(self, m: re.Match) -> str | None:
        a, b = int(m["d2"]), int(m["m2"])
        day, swapped = self._day(int(m["y2"]), b, a), False
        if day is None:  # month first
            day, swapped = self._day(int(m["y2"]), a, b), True
        if day is None:
            return None
        # A date that was swapped has a day after the 12th, as has its pseudonym.
        first, second = (day.month, day.day) if swapped else (day.day, day.month)
        return f"{first:02d}{m['s2']}{second:02d}{m['s2']}{day.year}"

    def named_date(self, m: re.Match) -> str | None:
        month = m["n1"] or m["n2"]
        number = next(k for k, name in enumerate(MONTHS) if name.lower().startswith(month.lower()[:3]))
        day = self._day(int(m["y3"] or m["y4"]), number + 1, int(m["d3"] or m["d4"]))
        if day is None:
            return None
        # May is as long as its short form, so a short form is told by the rest of the match.
        name = MONTHS[day.month - 1] if month.capitalize() in MONTHS else MONTHS[day.month - 1][:3]
        name = name.upper() if month.isupper() else name.lower() if month.islower() else name
        ordinal = "" if not (m["o3"] or m["o4"]) else "th" if 10 < day.day < 14 else {1: "st", 2: "nd", 3: "rd"}.get(day.day % 10, "th")
        if m["n1"]:
            return f"{day.day}{ordinal} {m['of'] or ''}{name}{m['p1'] or ''} {day.year}"
        return f"{name}{m['p2'] or ''} {day.day}{ordinal}{m['c4']} {day.year}"

    def address6(self, m: re.Match) -> str | None:
        try:
            value = ipaddress.IPv6Address(m[0])
        except ValueError:
            return None
        if int(value) < 2:
            return None
        new = ipaddress.IPv6Address(self.permuted("ip6", 1 << 128, int(value))).compressed
        return new.upper() if m[0] != m[0].lower() else new

    def labelled(self, m: re.Match) -> str:
        return m[0][: m.start("bare") - m.start()] + self.digits("phone", m["bare"])

    def address(self, m: re.Match) -> str | None:
        parts = m[0].split(".")
        if m[0] in PLAIN_ADDRESSES or any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        x = self.permuted("ip", 1 << 32, int.from_bytes(bytes(map(int, parts)), "big"))
        return ".".join(map(str, x.to_bytes(4, "big")))

    def social(self, m: re.Match) -> str | None:
        def valid(d):
            return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

        digits = m[0].replace("-", "")
        return self.in_place(m[0], self.digits("social", digits, valid)) if valid(digits) else None

    def phone(self, m: re.Match) -> str | None:
        digits = re.sub("[^0-9]", "", m[0])
        size = 0
        if m[0][0] == "+":
            size = next((n for n in (1, 2) if digits[:n] in SHORT_CODES), 3)
        rest = digits[size:]
        return self.in_place(m[0], digits[:size] + self.digits("phone", rest)) if 7 <= len(rest) <= 12 else None

    def number(self, m: re.Match) -> str:
        digits = re.sub("[^0-9]", "", m[0])
        if luhn_digit(digits[:-1]) == digits[-1]:
            body = self.digits("card", digits[:-1])
            return self.in_place(m[0], body + luhn_digit(body))
        return self.in_place(m[0], self.digits("account", digits, lambda d: luhn_digit(d[:-1]) != d[-1]))

    def others(self, text: str, at: int, end: int) -> Iterator[tuple[int, int, str]]:
        """The values but e-mail addresses; what is not valid may hold another, or be one of another kind."""
        while m := _OTHERS.search(text, at, end):
            kind, start = m.lastgroup, m.start()
            new = getattr(self, kind)(m)
            for other in _AFTER[kind] if new is None else ():
                m = _EACH[other].match(text, start, end)
                new = m and getattr(self, other)(m)
                if new is not None:
                    kind = other
                    break
            at = start + 1
            if new is not None:
                at = start + len(new) if kind == "iban" else m.end()
                yield start, at, new

    def replacements(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, replacement) of the values, in order, none overlapping."""
        found = []
        if "@" in text:
            found += [(m.start(), m.end(), self.email(m)) for m in _EMAIL.finditer(text)]
        taken = iter(sorted(found))
        held = next(taken, None)
        for value in (x for start, end in windows(text) for x in self.others(text, start, end)):
            while held and held[1] <= value[0]:
                yield held
                held = next(taken, None)
            if not (held and held[0] < value[1]):
                yield value
        while held:
            yield held
            held = next(taken, None)

    def replaced(self, text: str) -> tuple[str, int]:
        parts, done, n = [], 0, 0
        for start, end, new in self.replacements(text):
            parts += (text[done:start], new)
            done, n = end, n + 1
        return ("".join(parts) + text[done:], n) if n else (text, 0)


def windows(text: str) -> Iterator[tuple[int, int]]:
    """The stretches around digits, which all kinds but the first hold: the
    longest value fits on both sides, and a stretch ends at white space."""
    start = end = -1
    for m in _DIGITS.finditer(text):
        if m.start() <= end:
            if m.end() + REACH > end:
                end = _stretch(text, m.end() + REACH)
            continue
        if end >= 0:
            yield start, end
        start, end = max(0, m.start() - REACH, end), _stretch(text, m.end() + REACH)
    if end >= 0:
        yield start, end


def _stretch(text: str, at: int) -> int:
    gap = _SPACE.search(text, at)
    return gap.start() if gap else len(text)


REACH = 140
_DIGITS = re.compile("[0-9]+")
_SPACE = re.compile(r"\s")
_EMAIL = re.compile(r"(?<![\w.+-])[\w.+-]{1,64}@(?:[\w-]{1,63}\.)+[^\W\d_]{2,24}(?![\w-])")
_NAMES = "|".join([*MONTHS, *(name[:3] for name in MONTHS), "Sept"])
_LABELS = "telephone|phone|tel|mobile|cell|fax|fon|telefon|tél|móvil"
# The last group that matched names the kind, so a kind's group closes last.
_KINDS = (
    r"(?P<iban>\b(?:[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?|[a-z]{2}[0-9]{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?)\b)",
    r"(?P<secret>\b(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{32,128}\b)",
    r"(?P<iso_date>\b(?P<y>(?:19|20)[0-9]{2})(?P<s1>[-/.])(?P<m>[0-9]{1,2})(?P=s1)(?P<d>[0-9]{1,2})(?![0-9])(?![.-][0-9]))",
    r"(?P<day_first>(?<![\w.])(?P<d2>[0-9]{1,2})(?P<s2>[-/.])(?P<m2>[0-9]{1,2})(?P=s2)(?P<y2>(?:19|20)[0-9]{2})(?![0-9]))",
    rf"(?P<named_date>\b(?:(?P<d3>[0-9]{{1,2}})(?P<o3>st|nd|rd|th)? (?P<of>of )?(?P<n1>(?i:{_NAMES}))(?P<p1>\.)? (?P<y3>(?:19|20)[0-9]{{2}})"
    rf"|(?P<n2>(?i:{_NAMES}))(?P<p2>\.)? (?P<d4>[0-9]{{1,2}})(?P<o4>st|nd|rd|th)?(?P<c4>,?) (?P<y4>(?:19|20)[0-9]{{2}}))\b)",
    r"(?P<address6>(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{3,39}(?![\w:.]))",
    r"(?P<address>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9]))",
    r"(?P<social>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))",
    r"(?P<phone>(?<![\w+])(?:\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}"
    r"|\+[0-9]{1,3}(?:[ .-]?[0-9]{1,4}){2,5}"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])(?!\.[0-9]))",
    rf"(?P<labelled>\b(?i:{_LABELS})\b[.:]{{0,2}} ?(?P<bare>[0-9]{{7,12}})(?![0-9])(?![.-][0-9]))",
    r"(?P<number>(?<![\w.])(?:[0-9]{13,19}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?)(?![0-9]))",
)
_OTHERS = re.compile("|".join(_KINDS))
_EACH = {kind[4 : kind.index(">")]: re.compile(kind) for kind in _KINDS}
_AFTER = {kind: list(_EACH)[k + 1 :] for k, kind in enumerate(_EACH)}


def pseudonymise(
    docs: DataFrame, key: bytes, *, text: str = "text", n_values: str | None = "n_values"
) -> DataFrame:
    """The documents with their personal values replaced, and how many there were: in a column
    ``n_values``, with underscores after it if the documents have one of that name."""
    names = list(docs.columns)
    at = names.index(text)
    while n_values in names:
        n_values += "_"
    added = [n_values] if n_values else []

    def run(batches):
        import pyarrow as pa

        pseudonyms = Pseudonyms(key)
        for batch in batches:
            texts, counts = [], []
            for value in batch.column(at):
                value = value.as_py()
                new, n = (None, 0) if value is None else pseudonyms.replaced(value)
                texts.append(new)
                counts.append(n)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, columns[at].type)
            more = [pa.array(counts, pa.int64())] if added else []
            yield pa.RecordBatch.from_arrays([*columns, *more], [*names, *added])

    return docs.mapInArrow(run, fields(docs, *((c, "bigint") for c in added)))
