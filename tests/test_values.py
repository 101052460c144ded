"""Numbers, compact dates and camera values read from text."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import images, values


def test_numbers_follow_python(rows):
    texts = ["1", "-2.5", "+.5", "1.", "1e5", "1E-3", "1_000", "1__0", "_1", "1_", " 7\t", "inf", "-Infinity", "nan",
             "+nan", "1.0d", "2f", "0x10", "", " ", "1,5", "1 2", "e5", ".", "١"]

    def python(text):
        try:
            return float(text)
        except ValueError:
            return None

    got = rows([(t,) for t in texts], "t string").select("t", values.parse_number(F.col("t")).alias("n")).collect()
    for r in got:
        if r["t"] != "١":  # digits of other scripts are not read as numbers
            assert repr(r["n"]) == repr(python(r["t"])), r["t"]


def test_compact_dates(rows):
    cases = {
        "D:20201231235959+00'00'": datetime(2020, 12, 31, 23, 59, 59), "20200229000000": datetime(2020, 2, 29),
        "D:20210229000000": None, "D:2020123123595": None, "D:20201331000000": None, "x": None, "": None,
        "00000101000000": None, "20200101000060": None, "20200101246000": None,
    }
    df = rows(list(cases), "string").select("value", values.parse_compact_date(F.col("value")).alias("at"))
    assert {r["value"]: r["at"] for r in df.collect()} == cases


@pytest.mark.parametrize(
    ("value", "expected"), [("1/200", "0.005"), ("28/10", "2.8"), ("50/0", "50"), ("abc\x00\x00", "abc"), ("400", "400")]
)
def test_exif_values(rows, value, expected):
    assert rows([(value,)], "v string").select(images.exif_value(F.col("v")).alias("e")).head()["e"] == expected


def test_gps_and_geometry(rows):
    r = rows([(10.0, 30.0, 36.0, "S", 0, 0)], "d double, m double, s double, h string, w int, z int").select(
        images.gps_decimal(F.col("d"), F.col("m"), F.col("s"), F.col("h")).alias("p"),
        images.aspect_ratio(F.col("w"), F.col("z")).alias("ratio"),
        images.gps_altitude(F.lit(905), F.lit(10), F.lit(1)).alias("alt"),
        images.hex_color(F.lit(1), F.lit(171), F.lit(255)).alias("hex"),
        images.brightness(F.lit(255), F.lit(255), F.lit(255)).alias("bright"),
    ).head()
    assert (r["p"], r["ratio"], r["alt"], r["hex"], r["bright"]) == (-10.51, None, -90.5, "#01abff", 1.0)
