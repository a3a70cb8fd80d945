import datetime as dt
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.functions.transforms import Transform, field_name, murmur3, parse_field
from tarnlake.plans.predicates import may_hold

D, TS = T.DateType(), T.TimestampNTZType()


def test_text_forms():
    for text in ("identity", "void", "year", "month", "day", "hour", "bucket[16]", "truncate[4]"):
        assert str(Transform.parse(text)) == text
    for bad in ("bucket", "bucket[0]", "year[3]", "week", "truncate[]"):
        with pytest.raises(ValueError):
            Transform.parse(bad)
    assert parse_field('"month(L_SHIPDATE)"') == ("L_SHIPDATE", Transform("month"))
    assert parse_field("bucket(id, 4)") == parse_field("bucket( 4 , id )") == ("id", Transform("bucket", 4))
    assert parse_field("days(ts)")[1] == Transform("day") and parse_field("c") == ("c", Transform("identity"))
    assert field_name("d", Transform("day")) == "d_day" and field_name("d", Transform("identity")) == "d"


def test_fixed_values():
    days = [dt.date(2023, 5, 1), dt.date(2023, 6, 15), dt.date(2024, 1, 1)]
    assert [Transform("day").value(d, D) for d in days] == [19478, 19523, 19723]
    assert [Transform("month").value(d, D) for d in days] == [641, 642, 649]
    assert [Transform("year").value(d, D) for d in days] == [53, 53, 54]
    assert Transform("hour").value(dt.datetime(2023, 5, 1, 10, 30), TS) == 467482
    assert Transform("hour").value(dt.datetime(1969, 12, 31, 22, 30), TS) == -2
    assert Transform("truncate", 10).value(42, T.IntegerType()) == 40 and Transform("truncate", 10).value(-1, T.IntegerType()) == -10
    assert Transform("truncate", 5).value("Hello, World!", T.StringType()) == "Hello"
    # hashes that the public table specification lists
    assert murmur3((34).to_bytes(8, "little")) == 2017239379 and murmur3(b"hello, world") == 0x149BBB7F
    assert Transform("bucket", 1 << 30).value(Decimal("14.20"), T.DecimalType(9, 2)) == -500754589 % 2**31 % (1 << 30)


def test_columns_equal_values(spark):
    rows = [(i, t, d, ts) for i, t, d, ts in [
        (0, "", dt.date(1970, 1, 1), dt.datetime(1970, 1, 1)), (-7, "a", dt.date(1969, 12, 31), dt.datetime(1969, 12, 31, 22, 30)),
        (2**40 + 3, "héllo wörld", dt.date(2023, 5, 1), dt.datetime(2023, 5, 1, 10, 30, 5, 123456)), (34, "glacial", dt.date(1900, 2, 28), dt.datetime(1901, 1, 1, 0, 0, 1)),
        (None, None, None, None), (-(2**62), "abcd", dt.date(2400, 2, 29), dt.datetime(2399, 12, 31, 23, 59, 59, 999999)),
    ]]
    df = spark.createDataFrame(rows, "i long, t string, d date, ts timestamp_ntz")
    cases = [("i", k) for k in ("identity", "bucket[16]", "truncate[10]", "void")] + [("t", k) for k in ("bucket[7]", "truncate[3]")]
    cases += [("d", k) for k in ("year", "month", "day", "bucket[9]")] + [("ts", k) for k in ("year", "month", "day", "hour", "bucket[9]")]
    out = df.select(*[Transform.parse(k).column(F.col(c), df.schema[c].dataType).alias(f"x{n}") for n, (c, k) in enumerate(cases)]).collect()
    for n, (c, k) in enumerate(cases):
        want = [Transform.parse(k).value(r["itdts".index(c) if c != "ts" else 3], df.schema[c].dataType) for r in rows]
        assert [r[f"x{n}"] for r in out] == want, (c, k)


@settings(max_examples=400, deadline=None)
@given(some.dates(dt.date(1950, 1, 1), dt.date(2050, 1, 1)), some.dates(dt.date(1950, 1, 1), dt.date(2050, 1, 1)), some.sampled_from(["=", "<", "<=", ">", ">=", "<>"]), some.sampled_from(["identity", "year", "month", "day", "bucket[5]"]))
def test_projection_never_loses_a_row(value, bound, op, kind):
    t = Transform.parse(kind)
    holds = {"=": value == bound, "<": value < bound, "<=": value <= bound, ">": value > bound, ">=": value >= bound, "<>": value != bound}[op]
    projected = t.project(op, bound, D)
    if holds and projected:
        v = t.value(value, D)
        assert may_hold(*projected, v, v, 0, 1)
