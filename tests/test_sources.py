from __future__ import annotations

import pytest

from loam.sources import reports


def test_strict_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"say ""hi"", now"\n\n2,\n')
    df = reports.read_csv(spark, str(tmp_path / "a.csv"), ["id"])
    assert sorted(map(tuple, df.collect())) == [("1", 'say "hi", now'), ("2", "")]
    with pytest.raises(ValueError, match="missing columns: who"):
        reports.read_csv(spark, str(tmp_path / "a.csv"), ["id", "who"])


def test_report_layouts(spark, tmp_path):
    files = {
        "titled.csv": 'Campaign performance\n"Feb 1, 2026 - Feb 7, 2026"\nCampaign Name,Cost\n"A, (x)","$1,347.42"\nB\n',
        "plain.csv": 'Date,Clicks\n"Sat, Feb 7, 2026",3\n',
        "empty.csv": "Optimization Score,Campaign Name\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    rows = [(r["path"].rsplit("/")[-1], r["report_type"], r["row"], r["cells"]) for r in reports.read_reports(spark, str(tmp_path)).collect()]
    assert sorted(rows, key=str) == [
        ("plain.csv", "time_series", 0, {"Date": "Sat, Feb 7, 2026", "Clicks": "3"}),
        ("titled.csv", "campaigns", 0, {"Campaign Name": "A, (x)", "Cost": "$1,347.42"}),
        ("titled.csv", "campaigns", 1, {"Campaign Name": "B"}),
    ]
