"""Date texts of many formats, the order of a file's dates, and compatibility forms of all characters."""

import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from creaseline.functions.text import parsed_date
from creaseline.operators.distinct import folded_names
from creaseline.sources import deliveries as src

CASES = [
    ("2026-03-31", "2026-03-31", "2026-03-31"), (" 2026-03-31T10:00:00 ", "2026-03-31", "2026-03-31"), ("2026/3/1", "2026-03-01", "2026-03-01"),
    ("20260331", "2026-03-31", "2026-03-31"), ("31/03/2026", "2026-03-31", None), ("03-31-2026", None, "2026-03-31"), ("3.4.2026 14:30", "2026-04-03", "2026-03-04"),
    ("31 Mar 2026", "2026-03-31", "2026-03-31"), ("1st-march-2026", "2026-03-01", "2026-03-01"), ("Sept 9, 2026", "2026-09-09", "2026-09-09"),
    ("March 31 2026", "2026-03-31", "2026-03-31"), ("29/02/2025", None, None), ("31 Foo 2026", None, None), ("tomorrow", None, None), ("", None, None), (None, None, None),
]


@pytest.mark.parametrize("day_first", [True, False])
def test_date_texts(spark, day_first):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "i int, t string")
    got = {r["i"]: r["d"] and str(r["d"]) for r in rows.select("i", parsed_date("t", day_first).alias("d")).collect()}
    assert got == {i: c[1] if day_first else c[2] for i, c in enumerate(CASES)}


def test_each_file_has_its_own_order(spark, tmp_path):
    head = "match_id,batter,bowler,innings,over,ball_in_over,date\n"
    files = {
        "day": ["31/03/2026", "01/04/2026"], "month": ["03/31/2026", "04/01/2026"], "both": ["31/03/2026", "03/31/2026"],
        "open": ["03/04/2026", "04/04/2026"], "same": ["04/04/2026", ""], "iso": ["2026-04-01", "2026-04-02"],
    }
    for n, (name, dates) in enumerate(files.items()):
        (tmp_path / f"{name}.csv").write_text(head + "".join(f"{n},a,b,1,0,{k},{d}\n" for k, d in enumerate(dates)))

    def loaded(**options):
        rows = src.build_deliveries(spark, [str(tmp_path)], **options).orderBy("match_id", "ball_in_over").collect()
        out = {}
        for r in rows:
            out.setdefault(list(files)[r["match_id"]], []).append(r["date"] and str(r["date"]))
        return out

    known = {"day": ["2026-03-31", "2026-04-01"], "month": ["2026-03-31", "2026-04-01"], "same": ["2026-04-04", None], "iso": ["2026-04-01", "2026-04-02"]}
    assert loaded() == known
    assert loaded(day_first=True) == {**known, "open": ["2026-04-03", "2026-04-04"]}
    rejects = src.rejected_rows(spark, [str(tmp_path)]).where("reason = 'ambiguous dates'").collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in rejects) == ["both.csv", "open.csv"]


def test_compatibility_form_of_every_character(spark):
    assigned = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) != "Cn"]
    names = ["a" + "".join(assigned[i : i + 50]) for i in range(0, len(assigned), 50)]
    rows = spark.createDataFrame([(n, "x") for n in [*names, "plain name", None]], "name string, other string").repartition(8)
    got = {r["name"]: r["form"] for r in folded_names(rows, "name", "form").collect()}
    assert got == {**{n: unicodedata.normalize("NFKC", n) for n in names}, "plain name": "plain name", None: None}
    assert folded_names(rows.where(F.lit(False)), "name", "form").count() == 0
