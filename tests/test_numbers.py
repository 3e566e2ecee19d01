"""Numbers as reports write them."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.operators import texts

WRITTEN = {
    "$1,347.42": (1347.42, None, None),
    "6,968": (6968.0, 69.68, 6968.0),
    "35.06%": (None, 0.3506, None),
    "< 10%": (None, None, None),
    "No data": (None, None, None),
    "": (None, None, None),
    "--": (None, None, None),
    "0": (0.0, None, 0.0),
    None: (None, None, None),
}


def test_numbers_of_reports(spark):
    df = spark.createDataFrame([(x,) for x in WRITTEN], "x string")
    x = F.col("x")
    found = {r["x"]: tuple(None if v is None else round(v, 6) for v in r[1:]) for r in df.select("x", texts.parse_currency(x), texts.parse_percent(x), texts.parse_number(x)).collect()}
    assert found == WRITTEN
