"""Fill-in-the-middle transformation by counted-quantifier patterns (operator 12)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit of a text: a run of ASCII letters, or any other code point.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares in percent: texts that are transformed, and of these the ones written suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
SEED = 1


def draws(seed: int, doc_id: Column) -> list[Column]:
    """Four unsigned 32-bit numbers of a document, from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _quoted(sentinel: str) -> str:
    """A sentinel as literal text of a replacement."""
    return sentinel.replace("\\", r"\\").replace("$", r"\$")


def infilled(
    docs: DataFrame,
    seed: int = SEED,
    transformed: int = TRANSFORMED,
    suffix_first: int = SUFFIX_FIRST,
    sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE),
    unit: str = UNIT,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n (units), form, prefix_chars, middle_chars, output.

    A text of n units is cut after a and b units, drawn from the document's id.  One match of a pattern made for the
    row, with possessive groups of exactly a and b - a units, captures prefix, middle and suffix, and its replacement
    writes them behind their sentinels: psm as prefix, suffix, middle, spm as suffix, prefix, middle.  Possessive
    groups run in a loop without a stack, so the length of a text is not limited by them.

    A null text is an empty one.  Empty texts and texts that hold a sentinel stay plain, with null lengths, so a
    sentinel in an output always is one of ours.  A null doc_id draws as the empty text would; equal ids draw
    equally.  Other columns of `docs` are ignored.  Empty in, empty out.
    """
    first, second, third = sentinels
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumns(
        {"n": F.regexp_count("text", F.lit(unit)).cast("long"), "_h": F.array(*draws(seed, F.col("doc_id")))}
    )
    cut = lambda i: F.col("_h")[i] % (F.col("n") + 1)
    rows = rows.withColumns({"_a": F.least(cut(0), cut(1)), "_b": F.greatest(cut(0), cut(1))})
    held = F.col("text") == ""
    for s in sentinels:
        held = held | F.contains("text", F.lit(s))
    form = F.when(held | (F.col("_h")[2] % 100 >= transformed), "plain").when(F.col("_h")[3] % 100 < suffix_first, "spm").otherwise("psm")
    # Letters of a unit are possessive too: a unit is never split to make a count come out.
    one = "(?:" + unit.replace("+", "++") + ")"
    pattern = F.format_string(rf"(?s)\A({one}{{%d}}+)({one}{{%d}}+)(.*)\z", F.col("_a"), F.col("_b") - F.col("_a"))
    psm = f"{_quoted(first)}$1{_quoted(second)}$3{_quoted(third)}$2"
    spm = f"{_quoted(second)}$3{_quoted(first)}$1{_quoted(third)}$2"
    order = F.when(F.col("form") == "psm", psm).otherwise(spm)
    rows = rows.withColumn("form", form)
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order))
    rows = rows.withColumn("output", output)
    # Sentinels occur once each, so their places give the lengths.
    at = lambda s: F.locate(s, F.col("output"))
    before = F.when(F.col("form") == "psm", at(second) - 1 - len(first)).when(F.col("form") == "spm", at(third) - at(first) - len(first))
    behind = F.when(F.col("form") != "plain", F.length("output") - at(third) + 1 - len(third))
    return rows.select("doc_id", "n", "form", before.cast("long").alias("prefix_chars"), behind.cast("long").alias("middle_chars"), "output")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output was made from."""
    first, second, third = map(re.escape, sentinels)
    psm = F.regexp_replace(output, F.lit(rf"(?s)\A{first}(.*?){second}(.*?){third}(.*)\z"), F.lit("$1$3$2"))
    spm = F.regexp_replace(output, F.lit(rf"(?s)\A{second}(.*?){first}(.*?){third}(.*)\z"), F.lit("$2$3$1"))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digests(made: DataFrame) -> DataFrame:
    """`infilled` rows with digests of the output and of the text rebuilt from it in place of the output."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
