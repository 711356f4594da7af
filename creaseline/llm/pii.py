"""Personal data: base formats, and identifiers found by bootstrapped contexts (operator 10); DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creaseline.llm.common import cut, written

#: Kinds in the order of the results, and their formats.  Possessive repeats and the look-behinds keep
#: matching linear and free of recursion; each pattern finds what the plain format finds from left to right.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = {"email": (EMAIL, "[@]"), "ip": (IP, r"[0-9][.][0-9]"), "card": (CARD, r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), "phone": (PHONE, r"[+][0-9]")}
#: A word with a digit or an @.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*"
#: Rounds over the graph; values a pattern needs; scores from which a pattern speaks and an identifier is reported.
ROUNDS, SUPPORT, TRUST, ACCEPT = 3, 3, 0.6, 0.75
#: Characters beside an identifier in which its neighbour words are looked for.
REACH = 80
SPAN = "array<struct<s:int,e:int,v:string>>"


def located(text: Column, pattern: str) -> Column:
    """Matches of a pattern as an array of (s, e, v) in code points, in order.

    The pieces between matches and the matches add up to the text, so lengths give the places.
    """
    both = F.array(F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(x):
        def one(acc, i):
            s = acc["at"] + F.length(F.get(x["p"], i))
            v = F.get(x["m"], i)
            e = s + F.length(v)
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), v.alias("v")))).alias("out"))

        return F.when(F.size(x["m"]) > 0, F.aggregate(F.sequence(F.lit(0), F.size(x["m"]) - 1), start, one, lambda a: a["out"])).otherwise(F.array().cast(SPAN))

    return F.get(F.transform(both, step), F.lit(0))


def luhn(value: Column) -> Column:
    """Check digit of a card number, from the right."""
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))

    def add(acc, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, F.when(2 * d > 9, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return acc + twice

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.lpad(bare(p), 3, "0") <= "255"))
    if kind == "card":
        return luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def base_spans(docs: DataFrame) -> DataFrame:
    """`docs` (any columns, text) with one span array per kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = {}
    for kind, (pattern, hint) in KINDS.items():
        found = F.filter(located(text, pattern), _checker(kind))
        out[kind] = F.when(text.rlike(hint), found).otherwise(F.array().cast(SPAN))
    return docs.withColumns(out)


def _checker(kind: str):
    return lambda x: _valid(kind, x["v"])


def _neighbours(text: Column, s: Column, e: Column) -> list[Column]:
    """Lower-cased words left and right of a span, without marks at their ends."""
    before = F.substring(text, F.greatest(s - REACH, F.lit(0)) + 1, F.least(s, F.lit(REACH)))
    after = F.substring(text, e + 1, F.lit(REACH))
    left = F.regexp_extract(before, r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*$", 1)
    right = F.regexp_extract(after, r"^[^\x20\x09-\x0D]?[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)", 1)
    clean = lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return [clean(left).alias("left"), clean(right).alias("right")]


def occurrences(spans: DataFrame) -> DataFrame:
    """(rid, kind, s, e, v, left, right): base entities, and candidate words that no base span touches (kind null)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    known = F.concat(*[F.transform(k, _tagged(k)) for k in KINDS])
    words = F.when(text.rlike("[0-9@]"), located(text, CANDIDATE)).otherwise(F.array().cast(SPAN))
    trimmed = F.transform(words, lambda x: _core(x))
    rows = spans.select("rid", "text", F.inline(F.transform(F.array(F.struct(known.alias("known"), trimmed.alias("words"))), lambda b: F.struct(
        b["known"].alias("known"),
        F.filter(b["words"], lambda w: ~F.exists(b["known"], lambda k: (k["s"] < w["e"]) & (w["s"] < k["e"]))).alias("words"),
    ))))
    all_spans = F.concat("known", F.transform("words", lambda w: F.struct(F.lit(None).cast("string").alias("kind"), w["s"].alias("s"), w["e"].alias("e"), w["v"].alias("v"))))
    flat = rows.select("rid", "text", F.explode_outer(all_spans).alias("x")).where("x is not null")
    return flat.select("rid", "x.kind", "x.s", "x.e", F.lower("x.v").alias("v"), *_neighbours(text, F.col("x.s"), F.col("x.e")))


def _tagged(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"))


def _core(x: Column) -> Column:
    v = F.regexp_replace(x["v"], r"[^0-9A-Za-z]+$", "")
    skip = F.length(x["v"]) - F.length(F.regexp_replace(v, r"^[^0-9A-Za-z+]+", "")) - (F.length(x["v"]) - F.length(v))
    return F.struct((x["s"] + skip).alias("s"), (x["s"] + F.length(v)).alias("e"), F.regexp_replace(v, r"^[^0-9A-Za-z+]+", "").alias("v"))


def fits(kind: Column, v: Column) -> Column:
    """Whether an unseen word could be of a kind at all: marks and digits that the kind's entities have."""
    digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
    return (
        F.when(kind == "email", v.contains("@") | v.rlike(r"[a-z0-9][.](?:com|org|net)$"))
        .when(kind == "ip", v.rlike(r"^[0-9a-f]{1,4}([.:][0-9a-f]{0,4}){2,}$"))
        .when(kind == "card", digits >= 12)
        .otherwise(digits.between(7, 15) & v.rlike(r"^[0-9+()./-]+$"))
    )


def trusted_values(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, trust: float = TRUST, accept: float = ACCEPT) -> DataFrame:
    """(v, kind, score): unseen values that the pattern-instance graph assigns to a kind.

    A pattern is a word on one side of an identifier.  Its score for a kind is the sum of the scores of the
    different values beside it over their number plus one; base entities score 1 for their kind, unseen values what
    their patterns say (one minus the product of the complements).  Patterns with fewer than `support` values or a
    score below `trust` say nothing.  Values and patterns are counted before they are joined, so a frequent word
    is one row per value; the graph is cut by a checkpoint each round.
    """
    sides = F.array(F.concat(F.lit("l:"), F.col("left")), F.concat(F.lit("r:"), F.col("right")))
    edges = cut(
        found.where("v <> ''").select("v", "kind", F.explode(sides).alias("pattern")).where("length(pattern) > 2").groupBy("v", "kind", "pattern").agg(F.count("*").alias("n"))
    )
    totals = edges.groupBy("pattern").agg(F.count_distinct("v").alias("values")).where(F.col("values") >= support)
    seeds = edges.where("kind is not null").select("v", "kind", "pattern", F.lit(1.0).alias("score"))
    unseen = edges.where("kind is null").select("v", "pattern")
    scores = None
    for _ in range(rounds):
        votes = seeds if scores is None else seeds.unionByName(unseen.join(scores, "v").select("v", "kind", "pattern", "score"))
        patterns = (
            votes.groupBy("pattern", "kind").agg(F.sum("score").alias("total"))
            .join(totals, "pattern").withColumn("belief", F.col("total") / (F.col("values") + 1))
            .where(F.col("belief") >= trust).select("pattern", "kind", "belief")
        )
        beliefs = unseen.join(patterns, "pattern").where(fits(F.col("kind"), F.col("v")))
        scores = cut(beliefs.groupBy("v", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("belief"), F.lit(1e-9)))))).alias("score")))
    best = scores.where(F.col("score") >= accept).groupBy("v").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"), F.max("score").alias("score"))
    return cut(best)


def personal_data(docs: DataFrame, **options) -> DataFrame:
    """One row per row of `docs`: doc_id, text hash `rid`, one span array per base kind, and `more` (kind, s, e) spans.

    Base kinds are found from left to right without overlap inside a kind; formats that fail their check are dropped.
    `more` holds words that no base span touches and whose contexts were learnt from base entities.  A null text is
    empty; rows that repeat doc_id and text share their result; an empty table gives an empty table.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    spans = base_spans(rows)
    kept = written(spans.where(F.col("text").rlike("[0-9@]")).select("rid", "text", *KINDS), "spans")
    found = written(occurrences(kept), "occurrences")
    values = trusted_values(found, **options)
    more = (
        found.where("kind is null").drop("kind").join(values, "v")
        .groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("kind", "s", "e"))).alias("more"))
    )
    narrow = kept.select("rid", *KINDS).dropDuplicates(["rid"])
    out = rows.select("doc_id", "rid").join(narrow, "rid", "left").join(more, "rid", "left")
    none = F.array().cast(SPAN)
    return out.select(
        "doc_id", "rid", *[F.coalesce(k, none).alias(k) for k in KINDS],
        F.coalesce("more", F.array().cast("array<struct<kind:string,s:int,e:int>>")).alias("more"),
    )


def span_report(docs: DataFrame, **options) -> DataFrame:
    """Counts per base kind, SHA-256 of the base spans, and all spans as kind:start:end, ordered by kind and start."""
    out = personal_data(docs, **options)

    def base(kind):
        return F.transform(kind, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))

    def every(kind):
        own = F.transform(kind, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
        new = F.transform(F.filter("more", lambda x: x["kind"] == kind), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
        return F.transform(F.array_sort(F.concat(own, new)), lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))

    joined = F.array_join(F.concat(*[base(k) for k in KINDS]), ",")
    return out.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(joined, 256).alias("base_sha256"),
        F.array_join(F.concat(*[every(k) for k in KINDS]), ",").alias("spans"), F.size("more").cast("long").alias("n_learnt"),
    )
