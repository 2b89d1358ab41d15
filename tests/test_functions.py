"""Scalar functions on golden inputs."""

import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from freshet.functions import codes, dates, jsontext as J, notation as N, values as V
from freshet.functions.constants import FLOOD_ROOT, MEASURE_PREFIX, NA_TOKENS

GUID = "7f20b9d3-4a1f-42c6-9d07-5be0c3f7721a"

VALUES = [
    ("1.5", 1.5, 0), (None, None, 1), ("NAN", None, 2), (" nan ", None, 2), ("+nan", None, 3), ("-NaN", None, 3),
    ("abc", None, 5), ("", None, 5), ("1.5|2.5", 2.5, 6), ("a|b| 3 ", 3.0, 6), ("0|99999999", None, 7), ("1|x", None, 8),
    ("1|", None, 8), ("1|nan", None, 7), ("1|-inf", None, 7), ("1|9999999", 9999999.0, 6), ("inf", math.inf, 0),
    ("-Infinity", -math.inf, 0), ("1_000", 1000.0, 0), ("1__0", None, 5), ("_1", None, 5), ("1d", None, 5),
    ("1f", None, 5), ("0x10", None, 5), (" 12 ", 12.0, 0), ("\t12\n", 12.0, 0), (".5", 0.5, 0), ("1.", 1.0, 0),
    ("1e3", 1000.0, 0), ("1E-2", 0.01, 0), ("+5", 5.0, 0), ("1e400", math.inf, 0), ("1 2", None, 5), (".", None, 5),
    ("1_0.0_1e1_0", 10.01e10, 0),
]


def test_measured_value(column):
    got = column(V.measured_value, [text for text, _, _ in VALUES])
    assert [(row.value, row.status) for row in got] == [(value, status) for _, value, status in VALUES]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="0123456789.eE+-_| nainfINFxd\t", max_size=8), min_size=60, max_size=120))
def test_measured_value_follows_float_rules(column, texts):
    for text, row in zip(texts, column(V.measured_value, texts), strict=True):
        assert row.status in (0, 2, 3, 5, 6, 7, 8)
        assert (row.value is not None) == (row.status in (0, 6))
        if row.status == 0:
            assert row.value == float(text)
        if row.status == 6:
            assert row.value == float(text.rpartition("|")[2]) and abs(row.value) <= 9999999
        if row.status in (5, 8):
            with pytest.raises(ValueError):
                float(text)


def test_missing_tokens(spark):
    rows = spark.createDataFrame([(text, 1) for text in (*NA_TOKENS, "nan ", "0", "none")], "t string, n int")
    kept = [row.t for row in V.normalise_missing(rows).collect()]
    assert kept[: len(NA_TOKENS)] == [None] * len(NA_TOKENS)
    assert kept[len(NA_TOKENS):] == ["nan ", "0", "none"]


def test_stored_value(spark):
    rows = spark.createDataFrame([(1.0005,), (-2.3455,), (math.inf,), (1e15,), (None,)], "v double")
    got = [row[0] for row in rows.select(V.stored_value(F.col("v"))).collect()]
    assert [None if value is None else float(value) for value in got] == [1.001, -2.346, None, None, None]


def test_period_and_defaults(column):
    texts = ["900", "900.0", "3600.7", "-1.5", "", "x", None, "nan", "inf", "1e12"]
    assert column(V.period_seconds, texts) == [900, 900, 3600, -1, 0, 0, 0, 0, 0, 0]
    assert column(V.number_or_zero, ["1.5", "", None, "x"]) == [1.5, 0.0, 0.0, 0.0]
    assert column(V.integer_or_zero, ["7", "7.9", "", None]) == [7, 7, 0, 0]
    assert [None if v is None else float(v) for v in column(V.meta_version, ["0.9", "x", None])] == [0.9, None, None]


NOTATIONS = [
    ("K40017B-ph-i-subdaily", ("K40017B", "ph", None, "i", "subdaily", None, None)),
    ("K50938C-bga-i-subdaily-rfu", ("K50938C", "bga", None, "i", "subdaily", "rfu", None)),
    (
        "5d9e03b7-1c48-4be6-8f12-90a7c4d2e6b1-level-i-900-m-qualified",
        ("5d9e03b7-1c48-4be6-8f12-90a7c4d2e6b1", "level", None, "i", "900", "m", "qualified"),
    ),
    (
        "b6402f8e-73da-4c15-a2e9-0d4f61c8937a_TQ17KDM4AB-gw-dipped-i-mAOD-qualified",
        ("b6402f8e-73da-4c15-a2e9-0d4f61c8937a_TQ17KDM4AB", "gw", "dipped", "i", None, "mAOD", "qualified"),
    ),
    (f"{GUID}-gw-logged-i-subdaily-mAOD-qualified", (GUID, "gw", "logged", "i", "subdaily", "mAOD", "qualified")),
    (f"x-y-{GUID}-gw-logged-i-subdaily-mAOD-qualified", (f"x-y-{GUID}", "gw", "logged", "i", "subdaily", "mAOD", "qualified")),
    ("a--c-", ("a", "", None, "c", "", None, None)),
    ("a-b", (None,) * 7),
    ("a-b-c-d-e-f", (None,) * 7),
    ("", (None,) * 7),
    (None, (None,) * 7),
]


def test_notation_layouts(column):
    got = column(N.parse_notation, [text for text, _ in NOTATIONS])
    assert [(None,) * 7 if row is None else tuple(row) for row in got] == [fields for _, fields in NOTATIONS]
    assert got[-1] is None and got[-4] is None


def test_uris(column):
    assert column(N.notation_of, [MEASURE_PREFIX + " a-b ", "a\t", "", None]) == ["a-b", "a", "", None]
    got = column(lambda c: N.root_templated(c, FLOOD_ROOT), [FLOOD_ROOT + "/id/1", "x", None])
    assert got == ["{root}/id/1", "x", ""]


def test_codes(column):
    assert column(codes.datum_type, ["mAOD", "?", None]) == ["{root}/def/core/datumAOD", None, None]
    assert column(codes.period_text, ["15_min", "Unspecified", "weekly", None]) == ["900", "0", "weekly", None]
    assert column(codes.period_in_seconds, ["1_h", "weekly"]) == [3600, None]
    assert column(codes.value_type, ["i", "Cumulative_Total", "z"]) == ["instantaneous", "cumulative total", "z"]
    assert column(codes.qualifier, ["wet_bulb", "Dry"]) == ["Wet Bulb", "Dry"]
    pick = lambda field: column(lambda c: codes.field_value(F.lit(field), c), ["i", "mASD"])
    assert pick(" ValueType ") == ["instantaneous", "mASD"]
    assert pick("DATUMTYPE") == [None, "{root}/def/core/datumASD"]
    assert pick("other") == [None, None]


def test_dates(column, spark):
    days = column(dates.parse_date, ["2024-01-05", "2024-1-5", "24-01-05", "2024-02-30", "2024-01-05x", "", None])
    assert days == [dt.date(2024, 1, 5), dt.date(2024, 1, 5), None, None, None, None, None]
    moments = column(dates.parse_datetime, ["2024-01-05T06:07:08", "2024-01-05T06:07:08Z", "2024-01-05", "soon", "", None])
    assert moments[:3] == [dt.datetime(2024, 1, 5, 6, 7, 8)] * 2 + [dt.datetime(2024, 1, 5)]
    assert moments[3:] == [None, None, None]
    row = spark.range(1).select(
        dates.day_start(F.lit(dt.date(2024, 1, 5))).alias("a"), dates.day_end(F.lit(dt.date(2024, 1, 5))).alias("b")
    ).first()
    assert row.a == dt.datetime(2024, 1, 5) and row.b == dt.datetime(2024, 1, 5, 23, 59, 59, 999999)


def test_calendar_does_not_count_down(spark):
    a, b = F.lit(dt.date(2024, 1, 3)), F.lit(dt.date(2024, 1, 1))
    row = spark.range(1).select(dates.calendar(a, b).alias("down"), dates.calendar(b, a).alias("up")).first()
    assert row.down == [] and len(row.up) == 3
    chunks = spark.range(1).select(dates.chunks(b, a, 2).alias("c"), dates.chunks(a, b, 2).alias("d")).first()
    assert [tuple(c) for c in chunks.c] == [
        (dt.date(2024, 1, 1), dt.date(2024, 1, 2)), (dt.date(2024, 1, 3), dt.date(2024, 1, 3))
    ]
    assert chunks.d == []


def test_validated_date():
    day = dt.date(2024, 1, 5)
    assert dates.validated_date(day) == day
    assert dates.validated_date(dt.datetime(2024, 1, 5, 3)) == day
    assert dates.validated_date(" 2024-01-05 ") == day
    assert dates.validated_date("") is None and dates.validated_date(None) is None
    with pytest.raises(ValueError):
        dates.validated_date("05/01/2024")
    assert dates.required_date("2024-01-05") == day
    with pytest.raises(ValueError):
        dates.required_date("")


def test_json_shapes(column):
    assert column(J.list_or_text, ['["a","b"]', "a", "[]", None]) == ["a,b", "a", "", None]
    links = ['{"@id":"x"}', '[{"@id":"x"},{"a":1}]', "[]", None]
    assert column(J.link_ids, links) == ["x", "x,", None, None]
    assert column(J.first_text, ['[null,"","c"]', '[""]', "[]", "s", "", None]) == ["c", None, None, "s", "", None]
    assert column(J.first_number, ["[null,1.5]", "2", '["x"]', "1d", None]) == [1.5, 2.0, None, None, None]
    assert column(lambda c: J.member(c, "@id"), ['{"@id":"x"}', '"text"', "[1]", None]) == ["x", None, None, None]
    assert column(J.id_or_text, ['{"@id":"x"}', "plain", None]) == ["x", "plain", None]
    assert column(J.accepted_geojson, ['{"a":1}', "{", None]) == ['{"a":1}', None, None]
