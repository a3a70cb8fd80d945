"""Partition transforms: text form, column expression, literal value, inclusive projection of predicates."""

from __future__ import annotations

import datetime
import re
import struct
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH = datetime.date(1970, 1, 1)
_MASK = 0xFFFFFFFF


@dataclass(frozen=True)
class Transform:
    kind: str  # identity, void, year, month, day, hour, bucket, truncate
    width: int | None = None

    def __str__(self) -> str:
        return f"{self.kind}[{self.width}]" if self.width is not None else self.kind

    @staticmethod
    def parse(text: str) -> Transform:
        """``bucket[4]`` or a bare name."""
        m = re.fullmatch(r"\s*([a-z]+)\s*(?:\[\s*(\d+)\s*\])?\s*", text.lower())
        if not m:
            raise ValueError(f"not a transform: {text!r}")
        kind, width = m[1], int(m[2]) if m[2] else None
        if kind not in ("identity", "void", "year", "month", "day", "hour", "bucket", "truncate"):
            raise ValueError(f"unknown transform {kind!r}")
        if (kind in ("bucket", "truncate")) != (width is not None) or width == 0:
            raise ValueError(f"{kind} with width {width}")
        return Transform(kind, width)

    def result_type(self, source: T.DataType) -> T.DataType:
        if self.kind in ("identity", "truncate"):
            return source
        return T.IntegerType()

    # -- columns

    def column(self, c: Column, source: T.DataType) -> Column:
        """The value as a Spark expression; null stays null."""
        if self.kind == "identity":
            return c
        if self.kind == "void":
            return F.lit(None).cast("int")
        if self.kind == "year":
            return F.year(c) - 1970
        if self.kind == "month":  # counted from 1: January 1970 is month 1
            return (F.year(c) - 1970) * 12 + F.month(c)
        if self.kind == "day":
            return F.unix_date(c.cast("date"))
        if self.kind == "hour":
            return F.floor(F.expr("double(1)") * _micros(c, source) / F.lit(3_600_000_000)).cast("int")
        if self.kind == "truncate":
            if isinstance(source, (T.StringType, T.BinaryType)):
                return F.substring(c, 1, self.width)
            return c - F.pmod(c, F.lit(self.width).cast(source))
        return (F.expr("1") * (_murmur(c, source).bitwiseAND(0x7FFFFFFF) % self.width)).cast("int")

    # -- literals

    def value(self, v, source: T.DataType):
        """The same for one Python value."""
        if v is None or self.kind == "void":
            return None
        if self.kind == "identity":
            return v
        if self.kind == "year":
            return v.year - 1970
        if self.kind == "month":
            return (v.year - 1970) * 12 + v.month
        if self.kind == "day":
            return ((v.date() if isinstance(v, datetime.datetime) else v) - _EPOCH).days
        if self.kind == "hour":
            d = v.replace(tzinfo=None) - datetime.datetime(1970, 1, 1)
            return (d.days * 86400 + d.seconds) // 3600
        if self.kind == "truncate":
            return v[: self.width] if isinstance(v, (str, bytes)) else v - v % self.width
        return (murmur3(_bytes_of(v, source)) & 0x7FFFFFFF) % self.width

    def project(self, op: str, v, source: T.DataType) -> tuple[str, object] | None:
        """A predicate on the partition value that holds wherever ``source op v`` does; None if there is none.

        Strict bounds become inclusive, as neighbours share a partition; ``<>``
        only carries over for identity.
        """
        if self.kind == "void" or op not in ("=", "<", "<=", ">", ">=", "in", "<>"):
            return None
        if self.kind == "identity":
            return op, v
        if op == "<>" or self.kind == "bucket" and op not in ("=", "in"):
            return None
        if op == "in":
            return "in", tuple(self.value(x, source) for x in v)
        return {"<": "<=", ">": ">="}.get(op, op), self.value(v, source)


def parse_field(text: str) -> tuple[str, Transform]:
    """(column, transform) of ``month(c)``, ``bucket(c, 4)``, ``bucket(4, c)`` or ``c``."""
    text = text.strip().strip('"`').strip()
    m = re.fullmatch(r"(\w+)\s*\(\s*([^,()]+?)\s*(?:,\s*([^,()]+?)\s*)?\)", text)
    if not m:
        return text, Transform("identity")
    kind, a, b = m[1].lower(), m[2].strip('"`'), m[3].strip('"`') if m[3] else None
    if b is not None and a.isdigit():
        a, b = b, a
    kind = {"years": "year", "months": "month", "days": "day", "hours": "hour", "date": "day"}.get(kind, kind)
    return a, Transform.parse(f"{kind}[{b}]" if b is not None else kind)


def field_name(column: str, t: Transform) -> str:
    return column if t.kind == "identity" else f"{column}_{t.kind}"


def _micros(c: Column, source: T.DataType) -> Column:
    """Microseconds since the epoch of the wall clock, whatever the session's zone."""
    if isinstance(source, T.TimestampType):
        return F.unix_micros(c)
    day = F.unix_date(c.cast("date")).cast("long") * F.lit(86_400_000_000)
    if isinstance(source, T.DateType):
        return day
    clock = F.hour(c) * F.lit(3600) + F.minute(c) * F.lit(60)
    return day + (clock.cast("long") + F.floor(F.extract(F.lit("SECOND"), c))) * F.lit(1_000_000)


def date_transform(unit: str, c: Column, source: T.DataType) -> Column:
    """year, month, day or hour number of a date or timestamp."""
    return Transform.parse(unit).column(c, source)


# -- murmur3, 32 bit, seed 0 (the table format's bucket hash; Spark's own hash has another seed)

_C1, _C2 = 0xCC9E2D51, 0x1B873593


def murmur3(data: bytes) -> int:
    def mix(k: int) -> int:
        k = k * _C1 & _MASK
        return ((k << 15 | k >> 17) & _MASK) * _C2 & _MASK

    h = 0
    whole = len(data) // 4 * 4
    for at in range(0, whole, 4):
        h ^= mix(int.from_bytes(data[at : at + 4], "little"))
        h = ((h << 13 | h >> 19) & _MASK) * 5 + 0xE6546B64 & _MASK
    if len(data) > whole:
        h ^= mix(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, c in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * c & _MASK
    return h ^ h >> 16


def _bytes_of(v, source: T.DataType) -> bytes:
    if isinstance(v, bool):
        raise TypeError("booleans have no bucket")
    if isinstance(v, str):
        return v.encode("utf-8")
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, datetime.datetime):
        d = v.replace(tzinfo=None) - datetime.datetime(1970, 1, 1)
        return struct.pack("<q", (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds)
    if isinstance(v, datetime.date):
        return struct.pack("<q", (v - _EPOCH).days)
    if isinstance(v, Decimal):
        n = int(v.scaleb(source.scale))
        return n.to_bytes(max(1, (n if n >= 0 else ~n).bit_length() // 8 + 1), "big", signed=True)
    return struct.pack("<q", v)


def _let(x: Column, f) -> Column:
    """f of x, with x evaluated once: a tree that names x often would grow with every step."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _times(x: Column, c: int) -> Column:
    """x * c modulo 2^32 for 0 <= x < 2^32, without leaving 64 bits."""
    return _let(x, lambda v: (v.bitwiseAND(0xFFFF) * F.lit(c) + (F.shiftright(v, 16) * F.lit(c)).bitwiseAND(0xFFFF) * F.lit(65536)).bitwiseAND(_MASK))


def _turn(x: Column, n: int) -> Column:
    return _let(x, lambda v: (F.shiftleft(v, n).bitwiseAND(_MASK)).bitwiseOR(F.shiftright(v, 32 - n)))


def _mix(h: Column, k: Column) -> Column:
    k = _times(_turn(_times(k, _C1), 15), _C2)
    return (_times(_turn(h.bitwiseXOR(k), 13), 5) + F.lit(0xE6546B64)).bitwiseAND(_MASK)


def _end(h: Column, length: Column) -> Column:
    down = lambda x, n: _let(x, lambda v: v.bitwiseXOR(F.shiftright(v, n)))
    h = _times(down(h.bitwiseXOR(length), 16), 0x85EBCA6B)
    return down(_times(down(h, 13), 0xC2B2AE35), 16)


def _murmur(c: Column, source: T.DataType) -> Column:
    """The hash as a long in [0, 2^32), from built-in functions only."""
    if isinstance(source, (T.StringType, T.BinaryType)):
        b = c.cast("binary")
        byte = lambda i: F.coalesce(F.conv(F.hex(F.substring(b, i, F.lit(1))), 16, 10).cast("long"), F.lit(0).cast("long"))
        n = F.octet_length(b)
        word = lambda i: byte(i) + byte(i + 1) * 256 + byte(i + 2) * 65536 + byte(i + 3) * 16777216
        starts = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(4)), lambda i: i + 3 <= n)
        h = F.aggregate(starts, F.lit(0).cast("long"), lambda a, i: _mix(a, word(i)))
        at = F.floor(n / 4).cast("int") * 4 + 1
        tail = F.aggregate(
            F.sequence(F.lit(0), F.lit(2)), F.lit(0).cast("long"),
            lambda a, j: a + F.when(at + j <= n, byte(at + j) * F.pow(F.lit(256), j).cast("long")).otherwise(F.lit(0).cast("long")),
        )
        h = h.bitwiseXOR(_times(_turn(_times(tail, _C1), 15), _C2))
        return F.when(c.isNotNull(), _end(h, n.cast("long")))
    if isinstance(source, (T.TimestampType, T.TimestampNTZType)):
        x = _micros(c, source) if isinstance(source, T.TimestampType) else F.unix_micros(F.to_utc_timestamp(c.cast("timestamp"), "UTC"))
    elif isinstance(source, T.DateType):
        x = F.unix_date(c).cast("long")
    elif isinstance(source, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        x = c.cast("long")
    else:
        raise TypeError(f"no bucket for {source.simpleString()}")
    low, high = x.bitwiseAND(_MASK), F.shiftrightunsigned(x, 32)
    return _end(_mix(_mix(F.lit(0).cast("long"), low), high), F.lit(8).cast("long"))
