"""Format-preserving pseudonyms by keyed Feistel permutations.

Numbers and dates that pass their own check (Luhn, modulo 97, calendar, octets, area codes)
and e-mail addresses and secrets are replaced by others of the same format. A value is
read as a pair of numbers; each round adds to one a keyed hash of the other, modulo its own
range, so the whole is a permutation of the format's values: equal values get equal
pseudonyms in all documents, different values different ones, and the key holder can
undo it. Where a format has gaps (calendar days, check digits), the permutation is
walked until it falls on a valid value, or the check digit is computed anew.

Defined cases: a null text stays null; numbers that fail their check stay; overlapping finds
go to the first kind in the order of ``KINDS``, then to the leftmost.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paneltide.llm.batches import append_columns

ROUNDS = 10
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HEX = _DIGITS + "abcdef"
_FIRST = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST
# fixed values: English month names
_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


class Feistel:
    """A keyed permutation of pairs of numbers below (a, b)."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, kind: str, i: int, a: int, b: int, half: int) -> int:
        text = f"{kind}|{i}|{a}|{b}|{half}".encode()
        return int.from_bytes(hashlib.blake2b(text, key=self.key, digest_size=32).digest(), "big")

    def pair(self, kind: str, x: int, y: int, a: int, b: int, back: bool = False) -> tuple[int, int]:
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if i % 2:
                y = (y + sign * self._round(kind, i, a, b, x)) % b
            else:
                x = (x + sign * self._round(kind, i, a, b, y)) % a
        return x, y

    def walk(self, kind: str, value: int, size: int, fits: Callable[[int], bool], back: bool = False) -> int:
        """A permutation of the numbers below ``size`` that fit."""
        side = int(size**0.5) + 1
        while True:
            x, y = self.pair(kind, *divmod(value, side), side, side, back)
            value = x * side + y
            if value < size and fits(value):
                return value

    def signs(self, kind: str, text: str, alphabets: list[str], back: bool = False) -> str:
        """``text`` with each sign permuted inside its alphabet; an empty alphabet keeps it."""
        places = [i for i, a in enumerate(alphabets) if len(a) > 1]
        half = len(places) // 2
        numbers, sizes = [], []
        for part in (places[:half], places[half:]):
            value, size = 0, 1
            for i in part:
                value = value * len(alphabets[i]) + alphabets[i].index(text[i])
                size *= len(alphabets[i])
            numbers.append(value)
            sizes.append(size)
        numbers = list(self.pair(kind + "".join(str(len(a)) + "," for a in alphabets), *numbers, *sizes, back))
        out = list(text)
        for value, part in zip(numbers, (places[:half], places[half:])):
            for i in reversed(part):
                value, k = divmod(value, len(alphabets[i]))
                out[i] = alphabets[i][k]
        return "".join(out)

    def signs_while(self, kind: str, text: str, alphabets: list[str], outside, back: bool = False) -> str:
        """``signs``, walked on while the result is ``outside`` the class that ``text`` belongs to."""
        while True:
            text = self.signs(kind, text, alphabets, back)
            if not outside(text):
                return text


def _classes(text: str) -> list[str]:
    return [_DIGITS if c in _DIGITS else _LOWER if c in _LOWER else _UPPER if c in _UPPER else "" for c in text]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> int:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97


def _refill(shape: str, new: str) -> str:
    """``new`` with the separators of ``shape``."""
    signs = iter(new)
    return "".join(next(signs) if c.isalnum() else c for c in shape)


def _card(f: Feistel, m: re.Match, back: bool) -> str | None:
    digits = "".join(c for c in m[0] if c in _DIGITS)
    if not 13 <= len(digits) <= 19 or digits[0] == "0" or not luhn(digits) or len(set(digits)) == 1:
        return None
    keep = [""] + [_DIGITS] * (len(digits) - 2)
    body = f.signs("card", digits[:-1], keep, back)
    return _refill(m[0], body + next(c for c in _DIGITS if luhn(body + c)))


def _iban(f: Feistel, m: re.Match, back: bool) -> str | None:
    groups = m[0].split(" ")
    for n in range(len(groups), 0, -1):  # what follows the number may look like one more group
        shape = " ".join(groups[:n])
        plain = shape.replace(" ", "")
        if 15 <= len(plain) <= 34 and mod97(plain) == 1:
            body = f.signs("iban" + plain[:2], plain[4:], _classes(plain[4:]), back)
            new = f"{plain[:2]}{98 - mod97(plain[:2] + '00' + body):02d}{body}"
            return _refill(shape, new) + m[0][len(shape) :]
    return None


def _ssn(f: Feistel, m: re.Match, back: bool) -> str | None:
    area, group, serial = (int(x) for x in re.findall("[0-9]+", m[0]))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    areas = [x for x in range(1, 900) if x != 666]
    x, y = f.pair("ssn", areas.index(area), (group - 1) * 9999 + serial - 1, len(areas), 99 * 9999, back)
    return _refill(m[0], f"{areas[x]:03d}{y // 9999 + 1:02d}{y % 9999 + 1:04d}")


_AMERICAN = re.compile("1[2-9][0-9]{2}[2-9][0-9]{6}")


def _phone(f: Feistel, m: re.Match, back: bool) -> str | None:
    digits = "".join(c for c in m[0] if c in _DIGITS)
    plus = m[0].startswith("+")
    american = re.fullmatch(("1" if plus else "1?") + "[2-9][0-9]{2}[2-9][0-9]{6}", digits)
    if plus and not american and digits[0] == "1" and len(digits) == 11:  # no such area: a format of its own
        return _refill(m[0], f.signs_while("phone+1", digits, [""] + [_DIGITS] * 10, _AMERICAN.fullmatch, back))
    if plus and not american:
        if not 8 <= len(digits) <= 15 or digits[0] in "01":
            return None
        return _refill(m[0], f.signs("phone", digits, ["", "", ""] + [_DIGITS] * (len(digits) - 3), back))
    if not american:
        return None
    head = len(digits) - 10
    high = _DIGITS[2:]
    shape = [""] * head + [high, _DIGITS, _DIGITS, high] + [_DIGITS] * 6
    return _refill(m[0], f.signs("phone", digits, shape, back))


def _address(f: Feistel, m: re.Match, back: bool) -> str | None:
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in m[0].split(".")):
        return None
    x, y = f.pair("ip", parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], 65536, 65536, back)
    return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"


def _email(f: Feistel, m: re.Match, back: bool) -> str | None:
    local, _, domain = m[0].rpartition("@")
    return f"{f.signs('email@' + domain.lower(), local, _classes(local), back)}@{domain}"


_HEX_VALUE = re.compile("[0-9a-f]+")


def _secret(f: Feistel, m: re.Match, back: bool) -> str | None:
    start, end = next((m.span(k) for k in range(1, m.re.groups + 1) if m[k]), m.span())
    at = m.start()
    value = m.string[start:end]
    if not _ANY_DIGIT.search(value):
        return None
    if _HEX_VALUE.fullmatch(value):  # the pseudonym has a digit too
        new = f.signs_while("hex", value, [_HEX] * len(value), lambda v: not _ANY_DIGIT.search(v), back)
    else:  # nor is that of another value hexadecimal
        new = f.signs_while("secret", value, _classes(value), _HEX_VALUE.fullmatch, back)
    return m[0][: start - at] + new + m[0][end - at :]


def _day(value: int) -> datetime.date:
    return datetime.date.fromordinal(_FIRST + value)


def _date(f: Feistel, m: re.Match, back: bool) -> str | None:
    g = m.groupdict()
    words = g["name"] or g["name2"]
    if words:
        month = next(i for i, n in enumerate(_MONTHS, 1) if n.lower() == words.lower())
        year, day = int(g["year_n"] or g["year_n2"]), int(g["day_n"] or g["day_n2"])
        style = "words"
    elif g["iso"]:
        year, month, day = (int(x) for x in re.findall("[0-9]+", g["iso"]))
        style = "iso"
    else:
        first, second, year = (int(x) for x in re.findall("[0-9]+", g["parts"]))
        style = "dmy" if "." in g["parts"] or first > 12 else "mdy"
        month, day = (second, first) if style == "dmy" else (first, second)
        if style == "dmy" and "." not in g["parts"]:
            style = "late"  # a day that cannot be read as a month
    try:
        value = datetime.date(year, month, day).toordinal() - _FIRST
    except ValueError:
        return None
    if not 0 <= value < _DAYS:
        return None
    parts = re.findall("[0-9]+", m[0])
    short = style != "words" and any(len(x) == 1 for x in parts)

    def fits(v: int) -> bool:
        d = _day(v)
        return (style != "late" or d.day > 12) and (not short or d.day < 10 or d.month < 10)

    new = _day(f.walk(f"date{style}{short}", value, _DAYS, fits, back))
    wide = "" if short else "02"
    if style == "words":
        name = _MONTHS[new.month - 1]
        name = name.upper() if words.isupper() else name.lower() if words.islower() else name
        numbers = iter([str(new.day), f"{new.year:04d}"])
        return re.sub(r"[0-9]+|" + words, lambda x: name if x[0] == words else next(numbers), m[0])
    order = {"iso": (new.year, new.month, new.day), "mdy": (new.month, new.day, new.year)}.get(style, (new.day, new.month, new.year))
    numbers = iter(f"{x:{wide}d}" for x in order)
    return re.sub("[0-9]+", lambda x: next(numbers), m[0])


_NAMES = "|".join(_MONTHS)
#: Kinds in their order of preference: a test that a text must pass, the pattern, the replacement.
KINDS: list[tuple[str, str, re.Pattern, Callable]] = [
    (
        "secret",
        "",
        re.compile(
            r"(?<![A-Za-z0-9])(?:AKIA|ASIA)([0-9A-Z]{16})(?![A-Za-z0-9])"
            r"|(?<![A-Za-z0-9])(?:ghp_|gho_|ghs_|xox[bp]-|sk-|sk_live_|AIza)([A-Za-z0-9_-]{16,})"
            r"|(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?([^\s\"']{6,})"
        ),
        _secret,
    ),
    ("email", "@", re.compile(r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), _email),
    ("iban", "0", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _iban),
    ("ip", "0", re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])"), _address),
    (
        "date",
        "0",
        re.compile(
            r"(?<![\w/.-])(?:(?P<iso>[0-9]{4}(?P<s>[-/.])[0-9]{1,2}(?P=s)[0-9]{1,2})"
            r"|(?P<parts>[0-9]{1,2}(?P<t>[-/.])[0-9]{1,2}(?P=t)[0-9]{4})"
            rf"|(?P<name>(?i:{_NAMES})) (?P<day_n>[0-9]{{1,2}}),? (?P<year_n>[0-9]{{4}})"
            rf"|(?P<day_n2>[0-9]{{1,2}}) (?P<name2>(?i:{_NAMES})) (?P<year_n2>[0-9]{{4}}))(?![\w/]|[.-][0-9])"
        ),
        _date,
    ),
    (
        "card",
        "0",
        re.compile(
            r"(?<![\w.-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})"
            r"(?![\w]|[.-][0-9])"
        ),
        _card,
    ),
    ("ssn", "0", re.compile(r"(?<![\w-])[0-9]{3}([- ])[0-9]{2}\1[0-9]{4}(?![\w]|-[0-9])"), _ssn),
    (
        "phone",
        "0",
        re.compile(
            r"(?<![\w.])(?:(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
            r"|\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4})(?![\w]|[.-][0-9])"
        ),
        _phone,
    ),
]
NAMES = [k for k, *_ in KINDS]
_ANY_DIGIT = re.compile("[0-9]")
_MAYBE_SECRET = re.compile(r"AKIA|ASIA|gh[pos]_|xox[bp]-|sk[-_]|AIza|(?i:password|passwd|pwd|secret|token|api[_-]?key)")


def pseudonymized(text: str, feistel: Feistel, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with every found value permuted, and how many of each kind."""
    digits = bool(_ANY_DIGIT.search(text))
    counts: dict[str, int] = {}
    taken: list[tuple[int, int, str]] = []
    covered = bytearray()
    for kind, sign, pattern, replace in KINDS:
        if sign == "0" and not digits or sign == "@" and "@" not in text or not sign and not _MAYBE_SECRET.search(text):
            continue
        for m in pattern.finditer(text):
            if covered and any(covered[m.start() : m.end()]):
                continue
            new = replace(feistel, m, back)
            if new is not None:
                taken.append((m.start(), m.end(), new))
                covered = covered or bytearray(len(text))
                covered[m.start() : m.end()] = b"\1" * (m.end() - m.start())
                counts[kind] = counts.get(kind, 0) + 1
    if not taken:
        return text, counts
    out, at = [], 0
    for s, e, new in sorted(taken):
        out += [text[at:s], new]
        at = e
    return "".join(out) + text[at:], counts


def pseudonymize(docs: DataFrame, key: bytes, *, text: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with personal values in its text permuted under ``key``; ``back`` undoes it.

    Adds n_replaced and a column n_<kind> for each kind.
    """
    fields = [T.StructField(text, T.StringType()), T.StructField("n_replaced", T.LongType())]
    fields += [T.StructField(f"n_{k}", T.LongType()) for k in NAMES]

    def compute():
        feistel = Feistel(key)

        def apply(texts):
            found = [(None, {}) if t is None else pseudonymized(t, feistel, back) for t in texts]
            out = {text: [t for t, _ in found], "n_replaced": [sum(c.values()) for _, c in found]}
            return out | {f"n_{k}": [c.get(k, 0) for _, c in found] for k in NAMES}

        return apply

    return append_columns(docs, text, fields, compute)


def report(docs: DataFrame, key: bytes, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, the text with pseudonyms, and the counts."""
    return pseudonymize(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), key)
