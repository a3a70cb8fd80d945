"""Personal data by format-preserving Feistel pseudonyms.

Values are found by pattern and validated (Luhn, mod 97, calendar, octets, number
plans).  Each is a number within its format: digits of a card without the check
digit, an address as 32 bits, a date as a day of its part of the month, letters
and digits of an e-mail name as mixed radix.  A keyed Feistel network over that many bits, walked until
it is back in range, permutes the format, so a value has one pseudonym in every
document, another value has another one, and the key's holder can undo it.
Separators, letter case, check digits and lengths (but for octets) are kept.
Only ASCII digits make values; numbers in other scripts stay.

Kinds: email, card, iban, ip, phone, ssn, date, secret.

Edge cases: a null text stays null, an empty one empty; text without a valid
value is returned as it is; where finds overlap, the earlier kind of the list
above wins, and of a secret the rest is replaced too; repeated rows are rewritten alike; an empty table gives an empty
result; other columns are kept by ``rewrite`` and its new ones replace columns
of the same name.
"""

from __future__ import annotations

import calendar
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("email", "card", "iban", "ip", "phone", "ssn", "date", "secret")


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False, rounds: int = 8) -> int:
    """A keyed permutation of range(size): a Feistel network over an even number of bits, walked into range."""
    if size < 2:
        return value
    half = (max(size - 1, 1).bit_length() + 1) // 2
    mask, n = (1 << half) - 1, (half + 7) // 8

    def f(i: int, x: int) -> int:
        h = hashlib.shake_256(b"%b|%b|%d|%d|" % (key, tweak.encode(), size.bit_length(), i) + x.to_bytes(n, "big"))
        return int.from_bytes(h.digest(n), "big") & mask

    while True:
        a, b = value >> half, value & mask
        if back:
            for i in reversed(range(rounds)):
                a, b = b ^ f(i, a), a
        else:
            for i in range(rounds):
                a, b = b, a ^ f(i, b)
        value = a << half | b
        if value < size:
            return value


_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _mixed(text: str, key: bytes, tweak: str, back: bool, alphabets: tuple[str, ...] = (_DIGITS, _LOWER, _UPPER)) -> str:
    """Permute the characters that are in an alphabet, each within its own; the rest stays."""
    of = {c: (a, i) for a in reversed(alphabets) for i, c in enumerate(a)}
    places = [of.get(c) for c in text]
    size = value = 0
    size = 1
    for p in places:
        if p:
            value, size = value * len(p[0]) + p[1], size * len(p[0])
    value = permute(value, size, key, tweak, back)
    out = []
    for c, p in zip(reversed(text), reversed(places)):
        if p:
            value, i = divmod(value, len(p[0]))
            c = p[0][i]
        out.append(c)
    return "".join(reversed(out))


def _with_digits(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c in _DIGITS else c for c in shape)


def _only_digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def luhn_digit(body: str) -> str:
    total = 0
    for k, c in enumerate(reversed(body)):
        x = int(c) * (2 - k % 2)
        total += x - 9 * (x > 9)
    return str(-total % 10)


def _iban_rest(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def _email(s: str, key: bytes, back: bool) -> str:
    name, _, host = s.partition("@")
    labels, _, top = host.rpartition(".")
    return f"{_mixed(name, key, 'email', back)}@{_mixed(labels, key, 'host', back)}.{top}"


def _card(s: str, key: bytes, back: bool) -> str:
    d = _only_digits(s)
    body = _mixed(d[:-1], key, "card", back)
    return _with_digits(s, body + luhn_digit(body))


def _iban(s: str, key: bytes, back: bool) -> str:
    flat = s.replace(" ", "")
    body = _mixed(flat[4:], key, "iban" + flat[:2], back)
    new = iter(f"{flat[:2]}{98 - _iban_rest(flat[:2] + '00' + body):02d}{body}")
    return "".join(c if c == " " else next(new) for c in s)


def _ip(s: str, key: bytes, back: bool) -> str:
    x = 0
    for part in s.split("."):
        x = x << 8 | int(part)
    x = permute(x, 1 << 32, key, "ip", back)
    return ".".join(str(x >> k & 255) for k in (24, 16, 8, 0))


def _phone(s: str, key: bytes, back: bool) -> str:
    """The country code stays, as do separators."""
    head = re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+[0-9]", s)
    at = head.end() if head else 0
    return s[:at] + _with_digits(s[at:], _mixed(_only_digits(s[at:]), key, "phone", back))


def _ssn(s: str, key: bytes, back: bool) -> str:
    """Areas 1 to 899 without 666, groups 1 to 99, serials 1 to 9999."""
    a, g, n = map(int, s.split("-"))
    x = ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + n - 1
    x, n = divmod(permute(x, 898 * 99 * 9999, key, "ssn", back), 9999)
    a, g = divmod(x, 99)
    return f"{a + 1 + (a + 1 >= 666):03d}-{g + 1:02d}-{n + 1:04d}"


_YEARS = range(1900, 2100)
#: Days after the twelfth before each month since 1900, and in all.
_LATE = np.concatenate(([0], np.cumsum([calendar.monthrange(y, m)[1] - 12 for y in _YEARS for m in range(1, 13)])))


def _day(s: str) -> tuple[dict[str, int], str] | None:
    """Year, month and day, and the layout, if this is a day of 1900 to 2099; what reads both ways is day, month."""
    parts = re.split(r"[-/.]", s)
    for layout in ("ymd",) if len(parts[0]) == 4 else ("dmy", "mdy"):
        x = dict(zip(layout, map(int, parts)))
        if x["y"] in _YEARS and 1 <= x["m"] <= 12 and 1 <= x["d"] <= calendar.monthrange(x["y"], x["m"])[1]:
            return x, layout
    return None


def _date(s: str, key: bytes, back: bool) -> str:
    """A day up to the twelfth becomes another such one, a later day a later one: so every layout reads as before, and all have one permutation."""
    x, layout = _day(s)
    month = (x["y"] - _YEARS[0]) * 12 + x["m"] - 1
    if x["d"] <= 12:
        month, day = divmod(permute(month * 12 + x["d"] - 1, len(_YEARS) * 144, key, "date", back), 12)
        day += 1
    else:
        at = permute(int(_LATE[month]) + x["d"] - 13, int(_LATE[-1]), key, "late date", back)
        month = int(np.searchsorted(_LATE, at, "right")) - 1
        day = at - int(_LATE[month]) + 13
    at = {"y": f"{_YEARS[0] + month // 12:04d}", "m": f"{month % 12 + 1:02d}", "d": f"{day:02d}"}
    sep = re.search(r"[-/.]", s)[0]
    return sep.join(at[c] for c in layout)


#: Longest run of characters that is permuted as one number.
BLOCK = 256


def _chained(text: str, key: bytes, tweak: str, back: bool, alphabets: tuple[str, ...]) -> str:
    """As ``_mixed`` for any length: blocks, each tweaked by the one before it, then once more from the end."""
    if len(text) <= BLOCK:
        return _mixed(text, key, tweak, back, alphabets)
    blocks = [text[at : at + BLOCK] for at in range(0, len(text), BLOCK)]
    for turn in (1, 0) if back else (0, 1):
        blocks, last, out = blocks[::-1] if turn else blocks, "", []
        for b in blocks:
            own = f"{tweak}|{turn}|{hashlib.sha256(last.encode()).hexdigest()}"
            out.append(_mixed(b, key, own, back, alphabets))
            last = b if back else out[-1]
        blocks = out[::-1] if turn else out
    return "".join(blocks)


def _hex(s: str) -> tuple[str, ...]:
    for alphabet in ("0123456789abcdef", "0123456789ABCDEF"):
        if not set(s) - set(alphabet):
            return (alphabet,)
    return ()


def _secret(s: str, key: bytes, back: bool) -> str:
    """Hexadecimal stays so, and what is not does not become so: the permutation is walked until it reads alike."""
    own = _hex(s)
    while True:
        s = _chained(s, key, "hex" + own[0][-1] if own else "secret", back, own or (_DIGITS, _LOWER, _UPPER))
        if _hex(s) == own:
            return s


_PSEUDONYM: dict[str, Callable[[str, bytes, bool], str]] = {
    "email": _email, "card": _card, "iban": _iban, "ip": _ip, "phone": _phone, "ssn": _ssn, "date": _date, "secret": _secret,
}

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_HOST = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])")
_CARD = re.compile(r"(?<![A-Za-z0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![A-Za-z0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_IP = re.compile(r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![\w]|\.[0-9])")
_PHONE = re.compile(r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4})(?![\w])")
_SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
_DATE = re.compile(r"(?<![\w/.-])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![\w/-])")
_SECRET = re.compile(r"""(?<![A-Za-z0-9])(?i:(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|key)\b["']?\s{0,3}[:=]\s{0,3}["']?)([A-Za-z0-9_+/=.-]{16,})""")


def _emails(t: str) -> Iterator[tuple[int, int]]:
    at = t.find("@")
    while at >= 0:
        name, host = _LOCAL.search(t[max(0, at - 65) : at]), _HOST.match(t, at + 1)
        if name and host and name[0].strip("."):
            yield at - len(name[0].lstrip(".")), host.end()
        at = t.find("@", at + 1)


def _valid(kind: str, s: str) -> bool:
    d = _only_digits(s)
    if kind == "card":
        return luhn_digit(d[:-1]) == d[-1] and len(set(d)) > 1
    if kind == "iban":
        flat = s.replace(" ", "")
        return 15 <= len(flat) <= 34 and 2 <= int(flat[2:4]) <= 98 and _iban_rest(flat) == 1
    if kind == "ip":
        return all(int(p) < 256 and (p == "0" or p[0] != "0") for p in s.split("."))
    if kind == "phone":
        return 7 <= len(d) <= 15
    if kind == "ssn":
        return s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000"
    if kind == "date":
        return _day(s) is not None
    return True


_DIGIT_KINDS = (("card", _CARD), ("iban", _IBAN), ("ip", _IP), ("phone", _PHONE), ("ssn", _SSN), ("date", _DATE))
_TWO_DIGITS = re.compile(r"[0-9][0-9 .()/-]?[0-9]|\.[0-9]")


def find(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of validated values, in order and apart."""
    taken: list[tuple[int, int, str]] = []
    if "@" in text:
        taken = _merged(taken, _emails(text), "email")
    if _TWO_DIGITS.search(text):
        for kind, pattern in _DIGIT_KINDS:
            taken = _merged(taken, [m.span() for m in pattern.finditer(text) if _valid(kind, m[0])], kind)
    if "=" in text or ":" in text:
        taken = _merged(taken, [m.span(1) for m in _SECRET.finditer(text) if any(c in _DIGITS for c in m[1])], "secret")
    return taken


def _merged(taken: list[tuple[int, int, str]], new: Iterable[tuple[int, int]], kind: str) -> list[tuple[int, int, str]]:
    """Both lists, each in order, in one pass: a new span that meets a taken one goes; of a secret the parts between them stay."""
    out, k = [], 0
    for a, b in new:
        while k < len(taken) and taken[k][1] <= a:
            out.append(taken[k])
            k += 1
        if kind == "secret":
            while k < len(taken) and taken[k][0] < b:
                if a < taken[k][0]:
                    out.append((a, taken[k][0], kind))
                out.append(taken[k])
                a, k = taken[k][1], k + 1
            if a < b:
                out.append((a, b, kind))
        elif (k == len(taken) or b <= taken[k][0]) and (not out or out[-1][1] <= a):
            out.append((a, b, kind))
    return out + taken[k:]


@lru_cache(1 << 14)
def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str:
    """The pseudonym of a valid value, or with ``back`` the value of a pseudonym."""
    return _PSEUDONYM[kind](value, key, back)


def replace(text: str | None, key: bytes) -> tuple[str | None, list[tuple[int, int, str]]]:
    """The text with pseudonyms in place of values, and where in the input they were."""
    spans = find(text) if text else []
    if not spans:
        return text, spans
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], pseudonym(kind, text[a:b], key)]
        at = b
    return "".join([*out, text[at:]]), spans


def rewrite(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the text rewritten, and pii, the found spans (kind, start, length)."""
    small_batches(docs.sparkSession)
    docs = docs.drop("pii")
    schema = docs.schema
    at = schema.fieldNames().index(text_col)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [replace(t.as_py(), key) for t in b.column(at)]
            cols = b.columns
            cols[at] = pa.array([t for t, _ in new], pa.string())
            spans = pa.array([[{"kind": k, "start": a, "length": z - a} for a, z, k in s] for _, s in new], span)
            yield pa.RecordBatch.from_arrays([*cols, spans], [*b.schema.names, "pii"])

    out = docs.limit(0).withColumn("pii", F.lit(None).cast("array<struct<kind:string,start:int,length:int>>")).schema
    return docs.mapInArrow(run, out)
