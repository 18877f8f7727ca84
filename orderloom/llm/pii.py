"""Pseudonyms for personal data: values are found, validated, and permuted within their own format.

A keyed Feistel network permutes the values of each format: card numbers keep their length, grouping
and check digit, phone numbers their punctuation, addresses stay addresses, dates stay dates of the
same writing. The permutation depends on the key and the format only, so equal values stay equal in
every document without any table being shared, and the holder of the key can undo it.

Cards and IBANs are looked for in every part of a run of groups, so an expiry date, a running number
or a word in capitals beside one hides nothing. The value alone gives its pseudonym, whatever stands
beside it. Undoing reads a run by the same rules; where a pseudonym and a number beside it happen to
read as another value that comes first (one in ten of those that could), that one is undone instead.

A date becomes another that is read in the same order and has day and month in the same number of
digits. Long runs of hexadecimal digits are permuted whole, in parts of ``PART`` digits.

In the local part of an address, letters and digits are exchanged within their script and case;
combining marks stay, and so does a character that is alone of its kind. Dates are those from 1900 to
2099, alone or followed by T and a time, which stays; others are left as they are. A value that the
permutation leaves as it was is not counted.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import math
import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 10


class Feistel:
    """Keyed permutation of the integers below a size."""

    def __init__(self, key: bytes, inverse: bool = False):
        self.key, self.inverse = hashlib.blake2b(key).digest()[:64], inverse

    def _noise(self, tweak: str, turn: int, half: int, base: int) -> int:
        """A keyed number below the base, from as many digests as it takes to fill it and 128 bits more."""
        width = base.bit_length() // 8 + 1
        message = f"{tweak}|{width}|{turn}|".encode() + base.to_bytes(width, "big") + half.to_bytes(width, "big")
        blocks = -(-(width + 16) // 64)
        noise = b"".join(hashlib.blake2b(message, key=self.key, salt=k.to_bytes(16, "big")).digest() for k in range(blocks))
        return int.from_bytes(noise, "big") % base

    def permute(self, value: int, size: int, tweak: str) -> int:
        if size < 2:
            return value
        base = math.isqrt(size - 1) + 1
        while True:  # values outside the size are walked on until they fall inside
            left, right = divmod(value, base)
            for turn in reversed(range(ROUNDS)) if self.inverse else range(ROUNDS):
                if self.inverse:
                    left, right = (right - self._noise(tweak, turn, left, base)) % base, left
                else:
                    left, right = right, (left + self._noise(tweak, turn, right, base)) % base
            value = left * base + right
            if value < size:
                return value

    def digits(self, text: str, tweak: str) -> str:
        n = len(text)
        return str(self.permute(int(text), 10**n, f"{tweak}{n}")).zfill(n) if n else ""


# Alphabets within which characters are exchanged.
ALPHABETS = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
)
_PLACE = {c: (a, k) for a in ALPHABETS for k, c in enumerate(a)}


@functools.cache
def _scripts() -> dict[str, tuple[str, int]]:
    """Every other letter and digit with the alphabet of its script and case, and its place there."""
    alphabets = defaultdict(list)
    for c in map(chr, range(sys.maxunicode + 1)):
        kind = unicodedata.category(c)
        if kind[0] in "LN" and c not in _PLACE and c.isalnum():
            alphabets[*unicodedata.name(c, "?").split()[:2], kind].append(c)  # as HANGUL SYLLABLE, GREEK SMALL
    return {c: (a, k) for a in map("".join, alphabets.values()) if len(a) > 1 for k, c in enumerate(a)}


def _place(c: str) -> tuple[str, int] | None:
    return _PLACE.get(c) or (None if c.isascii() else _scripts().get(c))


HEX = ("0123456789abcdef", "0123456789ABCDEF")


def _spelled(f: Feistel, text: str, places: list[tuple[str, int] | None], tweak: str) -> str:
    """Permute a text as one number whose digits run over each character's own alphabet."""
    size, value = 1, 0
    for place in places:
        if place:
            size, value = size * len(place[0]), value * len(place[0]) + place[1]
    shape = "".join(str(len(p[0])) + "," if p else "-" for p in places)
    value = f.permute(value, size, f"{tweak}{shape}")
    out = []
    for character, place in zip(reversed(text), reversed(places)):
        if place:
            value, k = divmod(value, len(place[0]))
            character = place[0][k]
        out.append(character)
    return "".join(reversed(out))


def _regroup(pattern: str, digits: str) -> str:
    """The digits put in the places of the pattern's digits."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in pattern)


def luhn(digits: str) -> int:
    """Luhn sum modulo 10; 0 for a valid number."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10


def _is_card(text: str) -> bool:
    digits = re.sub(r"\D", "", text)
    return not luhn(digits) and len(set(digits)) > 1


def _card(f: Feistel, text: str) -> str:
    digits = re.sub(r"\D", "", text)
    body = f.digits(digits[:-1], "card")
    return _regroup(text, body + str(-luhn(body + "0") % 10))


def _phone(f: Feistel, text: str) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 10 <= len(digits) <= 15:
        return None
    keep = len(digits) - 10  # the country code stays
    return _regroup(text, digits[:keep] + f.digits(digits[keep:], "phone"))


def _social(f: Feistel, text: str) -> str | None:
    area, group, serial = text.split("-")
    if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
        return None
    areas = [a for a in range(1, 900) if a != 666]
    value = (areas.index(int(area)) * 99 + int(group) - 1) * 9999 + int(serial) - 1
    value, serial = divmod(f.permute(value, len(areas) * 99 * 9999, "social"), 9999)
    area, group = divmod(value, 99)
    return f"{areas[area]:03}-{group + 1:02}-{serial + 1:04}"


def _address(f: Feistel, text: str) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255:
        return None
    value = f.permute(int.from_bytes(bytes(octets), "big"), 1 << 32, "ipv4")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _is_iban(text: str) -> bool:
    code = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _iban(f: Feistel, text: str) -> str:
    code = text.replace(" ", "")
    body = _spelled(f, code[4:], [_PLACE[c] for c in code[4:]], "iban" + code[:2])
    check = 98 - int("".join(str(int(c, 36)) for c in body + code[:2] + "00")) % 97
    rest = iter(f"{code[:2]}{check:02}{body}")
    return "".join(c if c == " " else next(rest) for c in text)


FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


@functools.cache
def _days(order: str, widths: tuple[int, int]) -> list[int]:
    """Days that are read in this order if day and month are written in so many digits.

    A date is read day first where it can be, so month first are those of days past the twelfth.
    """
    fits = dict(zip(order.replace("y", ""), widths))
    days = map(datetime.date.fromordinal, range(FIRST_DAY, LAST_DAY + 1))
    return [
        day.toordinal()
        for day in days
        if (order != "mdy" or day.day > 12) and (fits["d"] == 2 or day.day < 10) and (fits["m"] == 2 or day.month < 10)
    ]


def _date(f: Feistel, text: str) -> str | None:
    """Another date of the same order, its day and month in the same number of digits."""
    a, mark, b, _, c = re.split(r"([-/.])", text)
    for order in ("ymd",) if len(a) == 4 else ("dmy", "mdy"):
        written = dict(zip(order, (a, b, c)))
        try:
            day = datetime.date(int(written["y"]), int(written["m"]), int(written["d"])).toordinal()
        except ValueError:
            continue
        if FIRST_DAY <= day <= LAST_DAY:
            widths = tuple(len(written[x]) for x in order if x != "y")
            days = _days(order, widths)
            place = f.permute(bisect.bisect_left(days, day), len(days), f"date{order}{widths}")
            new = datetime.date.fromordinal(days[place])
            part = {"y": new.year, "m": new.month, "d": new.day}
            return mark.join(f"{part[x]:0{len(written[x])}}" for x in order)
    return None


PART = 512  # characters of a long run that are permuted as one number


def _secret(f: Feistel, text: str) -> str | None:
    alphabet = HEX[text.upper() == text]
    if not all(c in alphabet for c in text) or len(set(text)) < 6:
        return None
    parts = [text[k : k + PART] for k in range(0, len(text), PART)]
    return "".join(_spelled(f, part, [(alphabet, alphabet.index(c)) for c in part], f"hex{k or ''}") for k, part in enumerate(parts))


def _email(f: Feistel, text: str) -> str | None:
    local, _, domain = text.rpartition("@")
    return _spelled(f, local, [_place(c) for c in local], "email") + "@" + domain


# How cards are printed, and the lengths of IBANs by country.
PRINTED = frozenset([(4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4), (4, 3, 3, 3), (6, 13), (8, 8)])
IBAN_LENGTHS = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
_GROUP = re.compile(r"(?<!\w)\d+(?!\w)")
_CODE = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?= ?[A-Z0-9])")
_PIECE = re.compile(r" ?[A-Z0-9]+")
_DECIMALS = re.compile(r"\.\d")


def _cards(text: str, low: int, high: int) -> list[tuple[int, int]]:
    """Ranges of 13 to 19 digits at borders of groups: those as printed first, then by start, longest first.

    A range with groups of one or two digits before its last is more likely a list of numbers, and
    only counts where it is the longest one from the first group behind the last such range.
    """
    groups = [m.span() for m in _GROUP.finditer(text, low, high + 2)]  # what follows may rule out the last
    found, unread = [], 0
    for i, (start, _) in enumerate(groups):
        if start > 1 and text[start - 1] == "." and text[start - 2].isdigit():
            continue
        sizes, ranges, total = [], [], 0
        for k in range(i, len(groups)):
            first, end = groups[k]
            if k > i and not (first - groups[k - 1][1] == 1 and text[first - 1] in " -"):
                break
            sizes.append(end - first)
            total += end - first
            if total > 19:
                break
            if total >= 13 and not _DECIMALS.match(text, end):
                ranges.append((k, end, tuple(sizes)))
        for k, end, shape in ranges:
            printed = len(shape) == 1 or shape in PRINTED
            if printed or min(shape[:-1]) > 2 or i >= unread and k == ranges[-1][0]:
                found.append((not printed, start, -end))
        if ranges and i >= unread:
            unread = ranges[-1][0] + 1
    return [(start, -end) for _, start, end in sorted(found)]


def _ibans(text: str, low: int, high: int) -> list[tuple[int, int]]:
    """Ranges as long as their country's IBANs first; then, longest first, any of an unlisted country, or else the longest."""
    found = []
    for code in _CODE.finditer(text, low, high):
        ends, size, at = [], 4, code.end()
        while piece := _PIECE.match(text, at, high):
            at, size = piece.end(), size + len(piece[0].lstrip())
            if size > 34:
                break
            if size >= 12 and not re.match(r"\w", text[at : at + 1]):
                ends.append((size, at))
        length = IBAN_LENGTHS.get(code[0][:2])
        for size, end in ends:
            if length in (size, None) or end == ends[-1][1]:
                found.append((size != length, code.start(), -end))
    return [(start, -end) for _, start, end in sorted(found)]


def _replaced(f: Feistel, text: str, ranges: list[tuple[int, int]], holds: Callable, permuter: Callable) -> Iterator[tuple[int, int, str]]:
    """The ranges that hold a value and overlap no earlier one that does, with the new values."""
    low, high = min(a for a, _ in ranges), max(b for _, b in ranges)
    covered = bytearray(high - low)
    for a, b in ranges:
        if 1 not in covered[a - low : b - low] and holds(text[a:b]):
            covered[a - low : b - low] = bytes([1]) * (b - a)
            yield a, b, permuter(f, text[a:b])


# The written forms looked for.
DETECTORS: tuple[tuple[str, re.Pattern, Callable], ...] = (
    ("secret", re.compile(r"(?<!\w)(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?!\w)"), _secret),
    ("date", re.compile(r"(?<![\w./-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?:(?=[Tt]\d{2})|(?![\w/-]|\.\d))"), _date),
    ("social", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), _social),
    ("ipv4", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"), _address),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])"), _phone),
    ("phone", re.compile(r"(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}(?![\w-])"), _phone),
)
RUNS: tuple[tuple[str, re.Pattern, Callable, Callable, Callable], ...] = (
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9])+"), _ibans, _is_iban, _iban),
    ("card", re.compile(r"(?<!\w)\d(?:[ -]?\d)+"), _cards, _is_card, _card),
)
_DIGITS = re.compile(r"\d(?:\D{0,64}\d)*")
_LOCAL = re.compile(r"(?:[^\W_][\w.+%-]*)\Z")
_DOMAIN = re.compile(r"(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}")


def find(text: str, f: Feistel) -> Iterator[tuple[int, int, str, str]]:
    """Start, end, kind and new value of everything that holds personal data; some may overlap."""
    at = text.find("@")
    while at >= 0:
        local, domain = _LOCAL.search(text, max(0, at - 64), at), _DOMAIN.match(text, at + 1, at + 256)
        if local and domain:
            yield local.start(), domain.end(), "email", _email(f, text[local.start() : domain.end()])
        at = text.find("@", at + 1)
    for cluster in _DIGITS.finditer(text):  # every other form has digits, so look around those only
        low, high = max(0, cluster.start() - 64), cluster.end() + 64
        inner = bytearray(high - low + 1)  # places inside values found; a range from or to one would cut the value
        for kind, pattern, permuter in DETECTORS:
            for found in pattern.finditer(text, low, high):
                new = permuter(f, found[0])
                if new is not None:
                    start, end = found.span()
                    yield start, end, kind, new
                    inner[start + 1 - low : end - low] = bytes([1]) * (end - start - 1)
        for kind, pattern, parts, holds, permuter in RUNS:
            for found in pattern.finditer(text, low, high):
                ranges = [(a, b) for a, b in parts(text, *found.span()) if not inner[a - low] and not inner[b - low]]
                for start, end, new in _replaced(f, text, ranges, holds, permuter) if ranges else ():
                    yield start, end, kind, new
                    inner[start + 1 - low : end - low] = bytes([1]) * (end - start - 1)


def pseudonymous(text: str, f: Feistel) -> tuple[str, list[str]]:
    """The text with validated values permuted, and the kinds replaced, in order."""
    taken = [(start, -end, kind, new) for start, end, kind, new in find(text, f)]
    out, kinds, done = [], [], 0
    for start, end, kind, new in sorted(taken):
        if start >= done:
            out += [text[done:start], new]
            if new != text[start:-end]:
                kinds.append(kind)
            done = -end
    return "".join([*out, text[done:]]), kinds


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", inverse: bool = False) -> DataFrame:
    """All rows and columns, with the text's personal data permuted, plus pii_count and pii_kinds.

    ``inverse`` undoes the permutation. Null texts stay null and count 0; every text is read whole;
    repeated rows stay repeated; columns named pii_count or pii_kinds are replaced; an empty table
    stays empty. Rows are independent of each other, so there is nothing to shuffle or to skew.
    """
    rows = docs.drop("pii_count", "pii_kinds").withColumn(text, F.col(text).cast("string"))
    place = rows.columns.index(text)
    names = [*rows.columns, "pii_count", "pii_kinds"]

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key, inverse)
        for batch in batches:
            column = batch.column(place)
            suspect = pc.fill_null(pc.match_substring_regex(column, "[0-9@]"), False).to_pylist()
            counts, kinds = [0] * len(column), [""] * len(column)
            changed, places = [], []
            for row, look in enumerate(suspect):
                if look:
                    new, found = pseudonymous(column[row].as_py(), f)
                    if found:
                        changed.append(new)
                        places.append(row)
                        counts[row], kinds[row] = len(found), ",".join(sorted(set(found)))
            if places:
                mask = [False] * len(column)
                for row in places:
                    mask[row] = True
                column = pc.replace_with_mask(column, pa.array(mask), pa.array(changed, column.type))
            columns = [column if k == place else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32()), pa.array(kinds, pa.string())], names)

    extra = [T.StructField("pii_count", T.IntegerType()), T.StructField("pii_kinds", T.StringType())]
    return rows.mapInArrow(replace, T.StructType([*rows.schema.fields, *extra]))
