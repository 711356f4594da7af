"""Dictionary numbers are dense, stable over loads, and never shared."""

from creaseline.operators import surrogates
from creaseline.operators.surrogates import FAR, SPAN, spaced_number, surrogate_numbers


def test_numbers_hold_over_loads(spark, tmp_path):
    path = str(tmp_path / "ids")

    def load(n, names):
        rows = spark.createDataFrame([(x, i) for i, x in enumerate(names)], "natural string, place int")
        return {r["natural"]: r["number"] for r in surrogate_numbers(rows, path, 100, n, order=("place",)).collect()}

    first = load(0, ["b", "a", "b", None])
    assert first == {"b": 100, "a": 101}
    second = load(1, ["z", "a", "c"])
    assert second == {"a": 101, "z": 102, "c": 103}
    assert load(1, ["z", "a", "c"]) == second  # the load runs again
    assert load(2, ["c", "b", "d"]) == {"c": 103, "b": 100, "d": 104}
    assert load(3, []) == {}


def test_many_keys_have_no_collision(spark, tmp_path):
    names = spark.range(200_000).selectExpr("concat('inn-', id % 150000) AS natural")
    out = surrogate_numbers(names, str(tmp_path / "many"), 920_000_000, 0)
    low, high, n, keys = out.selectExpr("min(number)", "max(number)", "count(distinct number)", "count(distinct natural)").first()
    assert (low, high, n, keys) == (920_000_000, 920_149_999, 150_000, 150_000)


def test_ranges_never_meet(spark):
    places = spark.createDataFrame([(0,), (SPAN - 1,), (SPAN,), (SPAN * 50,)], "place long")
    low = [r[0] for r in places.select(spaced_number(910_000_000, places["place"])).collect()]
    high = [r[0] for r in places.select(spaced_number(920_000_000, places["place"])).collect()]
    assert low == [910_000_000, 919_999_999, 910_000_000 * FAR + SPAN, 910_000_000 * FAR + 50 * SPAN]
    assert not set(low) & set(high) and max(low) < 920_000_000 * FAR
    assert surrogates.DICTIONARY.fieldNames() == ["natural", "number"]
