"""Personal data: validated matches, replaced by keyed permutations within their format."""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gapwright.llm.common import slices

#: Feistel rounds of the permutation.
ROUNDS = 8
DIGITS = "0123456789"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Dates are permuted among the days of these years.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)


class Keyed:
    """Keyed permutations of range(size); ``back`` undoes them."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = bytes([len(key)]) + key, back

    def __call__(self, value: int, size: int, tweak: str) -> int:
        """A balanced Feistel network over two halves of bits, whose round function
        is as wide as a half, walked along its cycle until it is below ``size``."""
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        mask, width = (1 << half) - 1, (half + 7) // 8
        head = self.key + f"{tweak}|{size}|".encode()

        def said(i: int, x: int) -> int:
            return int.from_bytes(hashlib.shake_256(head + bytes([i]) + x.to_bytes(width, "big")).digest(width), "big") & mask

        while True:
            left, right = value >> half, value & mask
            if self.back:
                for i in reversed(range(ROUNDS)):
                    left, right = right ^ said(i, left), left
            else:
                for i in range(ROUNDS):
                    left, right = right, left ^ said(i, right)
            value = left << half | right
            if value < size:
                return value

    def among(self, value: int, size: int, tweak: str, member: Callable[[int], bool]) -> int:
        """A permutation of those values below ``size`` that are members, as ``value`` is one."""
        value = self(value, size, tweak)
        while not member(value):
            value = self(value, size, tweak)
        return value


def permute_text(text: str, key: Keyed, tweak: str) -> str:
    """Letters become letters of the same case, digits digits; all else stays in place."""
    radix = [10 if c in DIGITS else 26 if c.lower() in LETTERS else 1 for c in text]
    value, size = 0, 1
    for c, r in zip(text, radix, strict=True):
        if r > 1:
            value = value * r + (DIGITS.index(c) if r == 10 else LETTERS.index(c.lower()))
            size *= r
    if size == 1:
        return text
    value = key(value, size, tweak)
    out = []
    for c, r in zip(reversed(text), reversed(radix), strict=True):
        if r == 1:
            out.append(c)
            continue
        value, x = divmod(value, r)
        new = DIGITS[x] if r == 10 else LETTERS[x]
        out.append(new.upper() if c.isupper() else new)
    return "".join(reversed(out))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _luhn_digit(body: str) -> str:
    return next(c for c in DIGITS if luhn(body + c))


def _fill(shape: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c in DIGITS else c for c in shape)


def _number(found: str, key: Keyed) -> tuple[str, str] | None:
    """13 to 19 digits with a right check digit: the others are permuted, the check digit follows."""
    digits = re.sub(r"\D", "", found)
    if not luhn(digits):
        return None
    body = f"{key(int(digits[:-1]), 10 ** (len(digits) - 1), 'card'):0{len(digits) - 1}d}"
    return "card", _fill(found, body + _luhn_digit(body))


def _iban(found: str, key: Keyed) -> tuple[str, str] | None:
    flat = found.replace(" ", "").upper()
    if not 15 <= len(flat) <= 34 or int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 != 1:
        return None
    body = permute_text(flat[4:], key, "iban" + flat[:2])
    check = 98 - int("".join(str(int(c, 36)) for c in body + flat[:2] + "00")) % 97
    rest = iter(f"{flat[:2]}{check:02d}{body}")
    return "iban", "".join(" " if c == " " else next(rest) for c in found)


def _ip(found: str, key: Keyed) -> tuple[str, str] | None:
    octets = [int(x) for x in found.split(".")]
    if any(x > 255 for x in octets) or any(len(x) > 1 and x[0] == "0" for x in found.split(".")):
        return None
    value = key(int.from_bytes(bytes(octets), "big"), 1 << 32, "ip")
    return "ip", ".".join(str(b) for b in value.to_bytes(4, "big"))


def _phone(found: str, key: Keyed) -> tuple[str, str] | None:
    """The country code stays; the other digits are permuted together."""
    lead = re.match(r"\+\d{1,3}(?=[ .(-])|\+\d{1,2}", found)
    head = lead.group() if lead else ""
    digits = re.sub(r"\D", "", found[len(head) :])
    if not 7 <= len(digits) <= 12:
        return None
    return "phone", head + _fill(found[len(head) :], f"{key(int(digits), 10 ** len(digits), 'phone' + head):0{len(digits)}d}")


def _ssn(found: str, key: Keyed) -> tuple[str, str] | None:
    """Areas 001-899 without 666, groups 01-99, serials 0001-9999: permuted among such numbers."""
    area, group, serial = (int(x) for x in found.split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    rank = (area - 1 - (area > 666)) * 99 * 9999 + (group - 1) * 9999 + serial - 1
    rank, serial = divmod(key(rank, 898 * 99 * 9999, "ssn"), 9999)
    area, group = divmod(rank, 99)
    return "ssn", f"{area + 1 + (area + 1 >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def _day(year: int, month: int, day: int) -> datetime.date | None:
    try:
        found = datetime.date(year, month, day)
    except ValueError:
        return None
    return found if FIRST_DAY <= found <= LAST_DAY else None


def _date(found: str, key: Keyed) -> tuple[str, str] | None:
    """Year first, or day and month first (the month where only one reading is a date).

    Days up to the 12th and later ones are permuted apart, so that a pseudonym
    is read in the order of its original; the notation plays no part, so equal
    dates in several notations stay linked.
    """
    a, mark, b, c = re.match(r"(\d+)([-/.])(\d+)[-/.](\d+)", found).groups()
    if len(a) == 4:
        then, order = _day(int(a), int(b), int(c)), "ymd"
    else:
        then, order = _day(int(c), int(b), int(a)), "dmy"
        if then is None:
            then, order = _day(int(c), int(a), int(b)), "mdy"
    if then is None:
        return None
    day = lambda x: FIRST_DAY + datetime.timedelta(x)
    late = then.day > 12
    new = day(key.among((then - FIRST_DAY).days, (LAST_DAY - FIRST_DAY).days + 1, "date", lambda x: (day(x).day > 12) == late))
    return "date", mark.join({"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}[x] for x in order)


def _email(found: str, key: Keyed) -> tuple[str, str] | None:
    """Local part and host labels are permuted; the top-level domain stays."""
    local, host = found.rsplit("@", 1)
    labels, top = host.rsplit(".", 1)
    return "email", f"{permute_text(local, key, 'local')}@{permute_text(labels.lower(), key, 'host')}.{top}"


def _secret(found: str, key: Keyed) -> tuple[str, str] | None:
    """Long hexadecimal strings with digits and letters are permuted among those of their length."""
    n = len(found)
    if found.isdigit() or found.isalpha():
        return None
    mixed = lambda x: not (f"{x:0{n}x}".isdigit() or f"{x:0{n}x}".isalpha())
    new = f"{key.among(int(found, 16), 16**n, 'secret', mixed):0{n}x}"
    return "secret", new.upper() if found.isupper() else new


#: What each named group of the pattern is taken to be.
KINDS: dict[str, Callable[[str, Keyed], tuple[str, str] | None]] = {
    "email": _email, "secret": _secret, "iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "number": _number, "phone": _phone,
}
PARTS = (
    r"(?P<email>[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24})",
    r"(?<![0-9A-Za-z])(?P<secret>[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z])(?P<iban>[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,4})?)(?![0-9A-Za-z])",
    r"(?<![\d./-])(?P<date>(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}[-/.]\d{2}[-/.]\d{4}))(?![\d/-]|\.\d)",
    r"(?<![\d.])(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?!\d|\.\d)",
    r"(?<![\d-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\d-])",
    r"(?<![\d.])(?P<number>\d(?:[ -]?\d){12,18})(?!\d|\.\d)",
    r"(?<![\w.+])(?P<phone>\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\d]|[.-]\d)",
)
PATTERN = re.compile("|".join(PARTS))
#: Each kind alone, for a place where an earlier kind of the pattern failed validation.
ALONE = dict(zip(KINDS, map(re.compile, PARTS), strict=True))
TOKEN = re.compile(r"[^0-9A-Za-z]*[0-9A-Za-z]+")
#: Ends of digit groups, and of groups of digits and capitals.
GROUP, IBAN_GROUP = re.compile(r"\d(?!\d)"), re.compile(r"[0-9A-Z](?![0-9A-Za-z])")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {k[:2]: int(k[2:]) for k in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 "
    "HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 "
    "QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()}


def readings(kind: str, found: str) -> list[str]:
    """What a match may be: itself, then what is left without its last groups.

    An IBAN of its country's length and a number of the North American plan
    (+1 and ten digits) come first, since what follows them is no part of them.
    """
    if kind not in ("number", "iban", "phone"):
        return [found]
    ends = [m.end() for m in (IBAN_GROUP if kind == "iban" else GROUP).finditer(found)]
    parts = [found[:e] for e in reversed(ends)]
    if kind == "number":
        return [x for x in parts if sum(c in DIGITS for c in x) >= 13]
    if kind == "iban":
        first = [x for x in parts if len(x.replace(" ", "")) == IBAN_LENGTHS.get(found[:2])]
    else:
        first = [x for x in parts if x.startswith("+1") and sum(c in DIGITS for c in x) == 11]
    return first + [x for x in parts if x not in first]


def pseudonyms(text: str, key: bytes, remember: Callable | None = None, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with every validated match replaced (``back``: put back); matches by kind."""
    counts: dict[str, int] = {}
    keyed = Keyed(key, back)
    ask = remember or (lambda kind, found: KINDS[kind](found, keyed))

    def read(m: re.Match) -> tuple[str, tuple[str, str]] | None:
        """The first valid reading at the place of a match, of its kind or a later one."""
        kinds = list(KINDS)
        for kind in kinds[kinds.index(m.lastgroup) :]:
            at = m if kind == m.lastgroup else ALONE[kind].match(text, m.start())
            for found in readings(kind, at.group()) if at else ():
                said = ask(kind, found)
                if said is not None:
                    return found, said
        return None

    out, done, at = [], 0, 0
    while (m := PATTERN.search(text, at)) is not None:
        valid = read(m)
        if valid is None:
            # what is no match as a whole may begin one at its next token
            at = TOKEN.match(text, m.start()).end()
            continue
        found, (kind, new) = valid
        counts[kind] = counts.get(kind, 0) + 1
        out += [text[done : m.start()], new]
        done = at = m.start() + len(found)
    return "".join([*out, text[done:]]), counts


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", counts_col: str | None = None, back: bool = False) -> DataFrame:
    """``docs`` with every column, ``text_col`` rewritten; ``counts_col`` adds matches by kind.

    Each validated value is permuted under the key within its own format, so
    equal values get equal pseudonyms in all texts, and different values
    different ones.  Dates are linked across notations; a phone number with
    and without its country code is taken for two values.  A permutation may
    map a value of a tiny format to itself, as chance has it.  ``back`` gives
    the holder of the key the original values of pseudonyms that are matched
    as they were written.  Matches that fail validation stay.  A null text stays
    null; texts without digits or @ are passed on as they are.  One pass, no
    shuffle; repeated rows, null ids and further columns go through unchanged.
    """
    if not 1 <= len(key.encode()) <= 64:
        raise ValueError("the key must have 1 to 64 bytes")
    if counts_col in docs.columns:
        raise ValueError(f"column {counts_col} is there already")
    secret = key.encode()
    schema = docs.schema
    if counts_col:
        from pyspark.sql import types as T

        schema = T.StructType([*schema.fields, T.StructField(counts_col, T.MapType(T.StringType(), T.IntegerType()))])
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = Keyed(secret, back)
        known = lru_cache(maxsize=1 << 16)(lambda kind, found: KINDS[kind](found, keyed))
        for part in slices(batches, text_col):
            texts = part.column(place)
            some = pc.fill_null(pc.match_substring_regex(texts, "[0-9@]"), False).to_pylist()
            values = texts.to_pylist()
            counts: list[dict[str, int] | None] = [None if v is None else {} for v in values]
            for i, yes in enumerate(some):
                if yes:
                    values[i], counts[i] = pseudonyms(values[i], secret, known)
            arrays = [*part.columns]
            arrays[place] = pa.array(values, texts.type)
            names = list(part.schema.names)
            if counts_col:
                arrays.append(pa.array([None if c is None else list(c.items()) for c in counts], pa.map_(pa.string(), pa.int32())))
                names.append(counts_col)
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.mapInArrow(run, schema)
