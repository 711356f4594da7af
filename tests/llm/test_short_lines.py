"""Lines of one or two words repeat like any other."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from creaseline.llm import lines  # noqa: E402
from creaseline.llm.queries import QUERIES  # noqa: E402


def removed(out):
    return {(r["doc_id"], int(n)) for r in out for n in r["removed_lines"].split(",") if n}


def test_short_lines_are_removed(spark):
    docs = spark.createDataFrame([(1, "Les.\nAnd ornd.\n\nfine"), (2, "And ornd.\n \nLes.  \nornd. And\nles."), (3, "Les.\tAnd ornd.")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in lines.without_repeated_lines(docs).collect()} == {
        1: "Les.\nAnd ornd.\n\nfine", 2: " \nornd. And\nles.", 3: "Les.\tAnd ornd.",
    }


def test_op5_compares_every_line_with_a_word(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    expected = brute.removed_lines(rows)
    assert removed(QUERIES["op5_line_dedup"](spark, sf_dir).collect()) == expected
    assert len(expected) > len(brute.removed_lines(rows, min_words=3))
