"""Fill-in-the-middle outputs against a plain version."""

import hashlib
import re

from compare import difference, duck

from creaseline.llm import infill
from creaseline.llm.queries import QUERIES
from creaseline.llm.sql import ORACLES

UNITS = re.compile("[A-Za-z]+|[^A-Za-z]")


def plain(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, None)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_whole_table(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    forms = set()
    for r in QUERIES["op12_infill"](spark, sf_dir).collect():
        n, form, before, middle, output = plain(r["doc_id"], texts[r["doc_id"]])
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, before, middle)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest()
        assert r["restored_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


def test_equals_sql(spark, sf_dir):
    got = QUERIES["op12_infill"](spark, sf_dir).toArrow()
    assert difference(got, duck(sf_dir).sql(ORACLES["op12_infill"]).to_arrow_table()) is None


def test_awkward_rows(spark):
    texts = [None, "", " ", "a", "ab<S>cd", "x <P", "S> y $1 \\2 \n\r\n\0", "\U0001f600é́   z", "word " * 60_000, "x" * 300_000, "1 2;" * 40_000, "<", "a<P a<S a<M >P>"]
    rows = [(i * 10 + k, t) for i, t in enumerate(texts) for k in range(6)] + [(None, "one two"), (7, "one two"), (7, "one two")]
    docs = spark.createDataFrame([(i, t, 1, "n", "f", b"o") for i, t in rows], "doc_id long, text string, n int, form string, output string, _h binary").repartition(3)
    made = infill.infilled(docs)
    out = made.withColumn("back", infill.restored(made["output"], made["form"])).collect()
    own = sorted((i or 0, *plain(i, t), t or "") for i, t in rows)
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(((r["doc_id"] or 0, r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in out), key=key) == sorted(own, key=key)
    assert infill.infilled(docs.limit(0)).count() == 0


def test_other_sentinels_and_seed(spark):
    docs = spark.createDataFrame([(i, "alpha beta $ gamma \\ delta") for i in range(200)], "doc_id long, text string")
    marks = ("$1", "\\2", "(?)")
    made = infill.infilled(docs.where("text not like '%$1%'"), seed=5, sentinels=marks, transformed=100)
    back = made.withColumn("back", infill.restored(made["output"], made["form"], marks)).collect()
    assert len(back) == 200 and all(r["back"] == "alpha beta $ gamma \\ delta" and r["form"] != "plain" for r in back)
    assert all(m in r["output"] for r in back for m in marks)
