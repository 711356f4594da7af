"""Cell cleaning, name keys, slugs and similarity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing cell, and for true and false.
NULL_TOKENS = ("", "nan", "none", "<na>")
TRUE_TOKENS = ("true", "1", "yes")
FALSE_TOKENS = ("false", "0", "no")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str) -> Column:
    """Trimmed text, null for blanks and for spelled-out nulls."""
    t = F.trim(_col(c))
    return F.when(~F.lower(t).isin(*NULL_TOKENS), t)


def blank_if_null(c: Column | str) -> Column:
    return F.coalesce(clean_text(c), F.lit(""))


def number_or_zero(c: Column | str) -> Column:
    return F.coalesce(_col(c).try_cast("double"), F.lit(0.0))


def flag01(c: Column | str) -> Column:
    return F.coalesce((_col(c).try_cast("double") > 0).cast("int"), F.lit(0))


def date_or_null(c: Column | str) -> Column:
    return _col(c).try_cast("date")


# English month names, also accepted by their first three letters.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_NUMERIC_DATE = r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})(?:[ T].*)?$"


def _matched(text: Column, pattern: str, *groups: int) -> list[Column]:
    """Groups of a pattern as integers or texts; null where it does not match."""
    return [F.when(text.rlike(pattern), F.regexp_extract(text, pattern, g)) for g in groups]


def _month(name: Column) -> Column:
    name = F.lower(name)
    short = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.when(name == "sept", "sep").otherwise(name))
    full = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name)
    return F.when(short > 0, short).when(full > 0, full)


def _made_date(year: Column, month: Column, day: Column) -> Column:
    known = year.isNotNull() & month.isNotNull() & day.isNotNull()
    return F.when(known, F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")).try_cast("date"))


def date_order_evidence(c: Column | str) -> Column:
    """What a text tells about the order of its file's dates, as a struct of flags.

    ``day`` and ``month``: a day-first, or month-first, date that reads in no other order; ``open``: one that reads in
    both orders, as different days.  All are false for texts in other formats.
    """
    text = F.trim(_col(c))
    a, b = (x.cast("int") for x in _matched(text, _NUMERIC_DATE, 1, 2))
    flag = lambda x: F.coalesce(x, F.lit(False))
    return F.struct(
        flag((a > 12) & (b <= 12)).alias("day"), flag((b > 12) & (a <= 12)).alias("month"), flag((a <= 12) & (b <= 12) & (a != b)).alias("open")
    )


def parsed_date(c: Column | str, day_first: Column | bool) -> Column:
    """Date of a text: ISO, with or without a time; year first with other separators, or as eight digits; day and
    month name in either order; and numeric day and month before the year, in the order ``day_first`` names.

    Anything else, and days that do not exist, are null.
    """
    text = F.trim(_col(c))
    order = F.lit(day_first) if isinstance(day_first, bool) else day_first
    iso = F.when(text.rlike(r"^\d{4}(-\d{1,2}(-\d{1,2}([ T].*)?)?)?$"), text.try_cast("date"))
    year_first = _made_date(*_matched(text, r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})(?:[ T].*)?$", 1, 2, 3))
    digits = _made_date(*_matched(text, r"^(\d{4})(\d{2})(\d{2})$", 1, 2, 3))
    day, name, year = _matched(text, r"^(\d{1,2})(?:st|nd|rd|th)?[ \-]([A-Za-z]{3,9})\.?[ \-,]+(\d{4})$", 1, 2, 3)
    day_month = _made_date(year, _month(name), day)
    name, day, year = _matched(text, r"^([A-Za-z]{3,9})\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})$", 1, 2, 3)
    month_day = _made_date(year, _month(name), day)
    a, b, year = _matched(text, _NUMERIC_DATE, 1, 2, 3)
    numeric = _made_date(year, F.when(order, b).otherwise(a), F.when(order, a).otherwise(b))
    return F.coalesce(iso, year_first, digits, day_month, month_day, numeric)


def tri_state(c: Column | str) -> Column:
    t = F.lower(F.trim(_col(c)))
    return F.when(t.isin(*TRUE_TOKENS), F.lit(True)).when(t.isin(*FALSE_TOKENS), F.lit(False))


def slug(c: Column | str) -> Column:
    """Lower-case words joined by single dashes."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_col(c))), "[^a-z0-9]+", "-"), "^-|-$", "")


def lookup_key(c: Column | str) -> Column:
    return F.lower(F.trim(_col(c)))


def squeeze(c: Column | str) -> Column:
    """Lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), r"\s+", " "))


# Full-width forms U+FF01..U+FF5E map to ASCII U+0021..U+007E; the ideographic space maps to a space.
_FULL_WIDTH = "".join(chr(0xFF01 + i) for i in range(94)) + "　 "
_ASCII = "".join(chr(0x21 + i) for i in range(94)) + "  "


def normal_name(c: Column | str) -> Column:
    """Name key: compatibility forms folded, lower case, dots and runs of spaces to one space.

    Folds full-width forms and the commonest ligatures; tables of names go through `operators.distinct.folded_names`
    first, which folds every compatibility form.
    """
    folded = F.translate(_col(c), _FULL_WIDTH, _ASCII)
    for ligature, plain in (("ﬁ", "fi"), ("ﬂ", "fl")):
        folded = F.replace(folded, F.lit(ligature), F.lit(plain))
    return F.trim(F.regexp_replace(F.replace(F.lower(folded), F.lit("."), F.lit(" ")), r"\s+", " "))


def name_signature(c: Column | str) -> Column:
    """First initial and last token of a name of two or more tokens, else null."""
    parts = F.split(squeeze(c), " ")
    return F.when(
        F.size(parts) >= 2,
        F.concat(F.substring(F.element_at(parts, 1), 1, 1), F.lit("|"), F.element_at(parts, -1)),
    )


def similarity(a: Column | str, b: Column | str) -> Column:
    """Edit-distance similarity between 0 and 100."""
    a, b = _col(a), _col(b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(100.0)).otherwise((F.lit(1.0) - F.levenshtein(a, b) / longest) * 100.0)


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def any_contains(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def ordered_slugs_equal(a: Column | str, b: Column | str) -> Column:
    """Same length, not empty, and equal position by position after slugging."""
    a, b = _col(a), _col(b)
    return (F.size(a) > 0) & (F.size(a) == F.size(b)) & (F.transform(a, slug) == F.transform(b, slug))


def player_list(c: Column | str) -> Column:
    """Names of a comma list, or of lines where ``#`` starts a comment line."""
    lines = F.filter(F.transform(F.split(_col(c), "\n"), lambda x: F.trim(x)), lambda x: ~x.startswith("#"))
    names = F.flatten(F.transform(lines, lambda x: F.transform(F.split(x, ","), lambda x: F.trim(x))))
    return F.filter(names, lambda x: x != "")
