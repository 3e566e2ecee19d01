"""CSV sources: strict exports, and ad reports with a preamble."""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a report's header or title holds, first match first.
REPORT_TYPES = [
    ("time_series", ["date", "time series"]),
    ("auction_insights", ["advertiser name", "auction insights"]),
    ("search_keywords", ["search keyword", "keywords"]),
    ("search_terms", ["search", "searches"]),
    ("demographics", ["age range", "gender", "demographics"]),
    ("devices", ["device", "devices"]),
    ("networks", ["network", "networks"]),
    ("ad_groups", ["ad group", "ad groups"]),
    ("campaigns", ["campaign name", "campaign"]),
]


def read_csv(spark: SparkSession, path: str, required: list[str] = ()) -> DataFrame:
    """Quoted CSV with a header; missing cells are empty strings; a quoted line break
    ends the row.  Raises if a required column is missing."""
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", False).csv(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.na.fill("")


def report_type(header: Column, title: Column) -> Column:
    """By the header, else by the title, else unknown."""
    out = F.lit("unknown")
    for text in (title, header):
        for name, words in reversed(REPORT_TYPES):
            hit = F.lit(False)
            for w in words:
                hit = hit | F.contains(F.lower(text), F.lit(w))
            out = F.when(hit, name).otherwise(out)
    return out


def _table(text: str) -> tuple[str, list[str], list[list[str]]]:
    """Title, header and rows: a report may begin with a title, and a date range."""
    rows = [r for r in csv.reader(io.StringIO(text.lstrip("﻿"))) if any(c.strip() for c in r)]
    title = []
    while rows and len(rows) > 1 and len(rows[0]) == 1 and len(title) < 2:
        title.append(rows.pop(0)[0])
    return " ".join(title), (rows[0] if rows else []), rows[1:]


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """``(path, report_type, title, row, cells)``: one row per data row of each report;
    short rows lack cells, a report with a header alone has no rows."""

    def parse(frames):
        for frame in frames:
            out = []
            for name, text in zip(frame["path"], frame["value"], strict=True):
                title, header, rows = _table(text)
                out += [(name, ",".join(header), title, k, dict(zip(header, r, strict=False))) for k, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=["path", "header", "title", "row", "cells"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    rows = files.mapInPandas(parse, "path string, header string, title string, row int, cells map<string,string>")
    return rows.select("path", report_type(F.col("header"), F.col("title")).alias("report_type"), "title", "row", "cells")
