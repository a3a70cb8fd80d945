"""Schemas and values in the public table format: JSON types with field ids, and single values as bytes."""

from __future__ import annotations

import datetime
import re
import struct
from decimal import Decimal

from pyspark.sql import types as T

_SIMPLE = {
    T.BooleanType: "boolean", T.ByteType: "int", T.ShortType: "int", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double",
    T.DateType: "date", T.TimestampNTZType: "timestamp", T.TimestampType: "timestamptz", T.StringType: "string", T.VarcharType: "string", T.CharType: "string", T.BinaryType: "binary",
}
_BACK = {
    "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "date": T.DateType(),
    "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "string": T.StringType(), "binary": T.BinaryType(),
}
#: Elements of lists and maps have ids of their own, above those of fields.
_INNER = 1_000_000
_ID = "parquet.field.id"
_EPOCH = datetime.datetime(1970, 1, 1)


def type_json(t: T.DataType, inner: list[int]):
    def own() -> int:
        inner[0] += 1
        return inner[0]

    if isinstance(t, T.DecimalType):
        return f"decimal({t.precision}, {t.scale})"
    if isinstance(t, T.StructType):
        return {"type": "struct", "fields": [_field(f, inner) for f in t.fields]}
    if isinstance(t, T.ArrayType):
        return {"type": "list", "element-id": own(), "element": type_json(t.elementType, inner), "element-required": not t.containsNull}
    if isinstance(t, T.MapType):
        return {"type": "map", "key-id": own(), "key": type_json(t.keyType, inner), "value-id": own(), "value": type_json(t.valueType, inner), "value-required": not t.valueContainsNull}
    for kind, name in _SIMPLE.items():
        if type(t) is kind:
            return name
    raise ValueError(f"no table type for {t.simpleString()}")


def _field(f: T.StructField, inner: list[int]) -> dict:
    out = {"id": int(f.metadata[_ID]), "name": f.name, "required": not f.nullable, "type": type_json(f.dataType, inner)}
    if type(f.dataType) in (T.ByteType, T.ShortType, T.VarcharType, T.CharType):
        out["spark-type"] = f.dataType.simpleString()  # more than the format can say
    return out


def type_of(j) -> T.DataType:
    if isinstance(j, str):
        m = re.fullmatch(r"decimal\(\s*(\d+)\s*,\s*(\d+)\s*\)", j)
        return T.DecimalType(int(m[1]), int(m[2])) if m else _BACK[j]
    if j["type"] == "struct":
        return schema_of(j)
    if j["type"] == "list":
        return T.ArrayType(type_of(j["element"]), not j.get("element-required", False))
    return T.MapType(type_of(j["key"]), type_of(j["value"]), not j.get("value-required", False))


def schema_json(schema: T.StructType, schema_id: int = 0) -> dict:
    return {"type": "struct", "schema-id": schema_id, "fields": [_field(f, inner) for inner in [[_INNER]] for f in schema.fields]}


def schema_of(j: dict) -> T.StructType:
    fields = []
    for f in j["fields"]:
        kind = _spark_type(f["spark-type"]) if "spark-type" in f else type_of(f["type"])
        fields.append(T.StructField(f["name"], kind, not f["required"], {_ID: f["id"]}))
    return T.StructType(fields)


def _spark_type(text: str) -> T.DataType:
    name, _, n = text.rstrip(")").partition("(")
    return {"tinyint": T.ByteType, "smallint": T.ShortType}[name]() if not n else {"varchar": T.VarcharType, "char": T.CharType}[name](int(n))


def micros(v: datetime.datetime) -> int:
    d = v - _EPOCH
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


def to_bytes(v, kind: str) -> bytes | None:
    """A bound as bytes; moments are UTC without a zone."""
    if v is None:
        return None
    if kind == "boolean":
        return b"\x01" if v else b"\x00"
    if kind == "int":
        return struct.pack("<i", v)
    if kind == "long":
        return struct.pack("<q", v)
    if kind in ("float", "double"):
        return struct.pack("<f" if kind == "float" else "<d", v)
    if kind == "date":
        return struct.pack("<i", (v - _EPOCH.date()).days)
    if kind.startswith("timestamp"):
        return struct.pack("<q", micros(v))
    if kind == "string":
        return v.encode("utf-8", "surrogatepass")
    if kind == "binary":
        return bytes(v)
    if kind.startswith("decimal"):
        n = int(v.scaleb(int(re.findall(r"\d+", kind)[1])))
        return n.to_bytes(max(1, (n.bit_length() + 8) // 8), "big", signed=True)
    return None


def from_bytes(raw: bytes | None, kind: str):
    if raw is None:
        return None
    if kind == "boolean":
        return raw != b"\x00"
    if kind in ("int", "date"):
        n = struct.unpack("<i", raw)[0]
        return n if kind == "int" else _EPOCH.date() + datetime.timedelta(days=n)
    if kind == "long" or kind.startswith("timestamp"):
        n = struct.unpack("<q", raw)[0]
        return n if kind == "long" else _EPOCH + datetime.timedelta(microseconds=n)
    if kind in ("float", "double"):
        return struct.unpack("<f" if kind == "float" else "<d", raw)[0]
    if kind == "string":
        return raw.decode("utf-8", "surrogatepass")
    if kind.startswith("decimal"):
        return Decimal(int.from_bytes(raw, "big", signed=True)).scaleb(-int(re.findall(r"\d+", kind)[1]))
    return raw
