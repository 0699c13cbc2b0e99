import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cohortlens import (
    Metric,
    count_items,
    count_items_of,
    exact_gsum,
    exact_gsum_cube,
    exact_gsum_of,
    repeat_items,
    repeat_rows,
    restrict_to_keys,
    to_items,
)

from brute import gsums


def pairs_df(spark, pairs):
    return spark.createDataFrame(pairs, "key string, value string")


def as_dict(df):
    return {r["key"]: (r["entropy"], int(r["l2"]), r["l1"], r["card"]) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for key in want:
        assert got[key][0] == pytest.approx(want[key][0])
        assert got[key][1:] == want[key][1:]


def test_tiny(spark):
    got = as_dict(exact_gsum(pairs_df(spark, [("a", "x")] * 3 + [("a", "y")])))
    assert got["a"][0] == pytest.approx(3 * math.log2(3)) and got["a"][1:] == (10, 4, 2)


def test_uniform_values(spark):
    got = as_dict(exact_gsum(pairs_df(spark, [("a", str(i)) for i in range(50)])))
    assert got == {"a": (0.0, 50, 50, 50)}


def test_awkward_keys_stay_apart(spark):
    pairs = [("a:b", "c"), ("a", "b:c"), ("a|b", "c"), ("::1", "x"), ("::1", "x"), ("", "")]
    same(as_dict(exact_gsum(pairs_df(spark, pairs))), gsums(pairs))


def test_random_against_brute_force(spark):
    rng = random.Random(7)
    pairs = [(f"k{min(rng.randrange(20), rng.randrange(20))}", f"v{rng.randrange(9) ** 2}") for _ in range(5000)]
    want = gsums(pairs)
    same(as_dict(exact_gsum(pairs_df(spark, pairs))), want)
    df = pairs_df(spark, pairs)
    same(as_dict(exact_gsum_of(df, ["key"], ["value"])), want)
    same(as_dict(exact_gsum(count_items(df))), want)


def test_grouping_by_columns_equals_grouping_by_text(spark):
    df = spark.createDataFrame(
        [(1, None, 2.5, "p|q"), (1, "", 2.5, "p"), (None, "x", 0.0, "q"), (1, "", -0.0, "p")] * 3,
        "a int, b string, c double, d string",
    )
    keys, values = ["a", "b"], ["c", "d"]
    by_text = as_dict(exact_gsum(to_items(df, keys, values)))
    assert as_dict(exact_gsum_of(df, keys, values)) == by_text
    assert as_dict(exact_gsum(count_items_of(df, keys, values))) == by_text
    assert by_text["1|"][2] == 9  # null and empty text are the same


def test_second_moment_beyond_64_bits(spark):
    big = 5_000_000_000_123
    rows = spark.createDataFrame([("a", "x", big), ("a", "y", 3)], "key string, value string, f bigint")
    got = exact_gsum(rows).first()
    assert got["l2"] == Decimal(big * big + 9) and got["l1"] == big + 3


def test_global_and_empty(spark):
    pairs = [("a", "x"), ("b", "x"), ("a", "x")]
    got = exact_gsum(pairs_df(spark, pairs), by_key=False).first()
    assert (got["entropy"], int(got["l2"]), got["l1"], got["card"]) == (2.0, 5, 3, 2)
    none = exact_gsum(pairs_df(spark, []), by_key=False).first()
    assert (none["entropy"], int(none["l2"]), none["l1"], none["card"]) == (0.0, 0, 0, 0)
    assert exact_gsum(pairs_df(spark, [])).count() == 0


def test_custom_g(spark):
    rows = pairs_df(spark, [("a", "x")] * 3 + [("a", "y")])
    got = exact_gsum(rows, {"cubes": lambda f: f * f * f, "n": Metric(lambda f: F.lit(1), "bigint")}).first()
    assert (got["cubes"], got["n"]) == (28.0, 2)
    assert exact_gsum(rows, ["l1"]).columns == ["key", "l1"]


def test_repeats(spark):
    pairs = [("a", "x"), ("a", "y"), ("a", "x"), ("b", "z")]
    base = as_dict(exact_gsum(pairs_df(spark, pairs)))
    thrice = as_dict(exact_gsum(repeat_rows(pairs_df(spark, pairs), 3)))
    assert thrice == as_dict(exact_gsum(repeat_items(count_items(pairs_df(spark, pairs)), 3)))
    for key, (_, l2, l1, card) in base.items():
        assert thrice[key][1:] == (9 * l2, 3 * l1, card)


def test_restrict_to_keys(spark):
    rows = pairs_df(spark, [("1", "x"), ("2", "x"), ("3", "x"), ("1", "y")])
    keys = spark.createDataFrame([(1,), (1,), (2,), (3,)], "key int")
    assert as_dict(exact_gsum(restrict_to_keys(rows, keys, 2, ["key"]))).keys() == {"1"}
    assert as_dict(exact_gsum(restrict_to_keys(rows, keys, 3, ["key"]))).keys() == {"1", "2"}


def test_cube(spark):
    rng = random.Random(3)
    data = [(rng.choice("AB"), rng.choice(["x", None]), rng.randrange(5)) for _ in range(300)]
    df = spark.createDataFrame(data, "a string, b string, v int")
    got = {
        (r["a"], r["b"], r["grouping_id"]): (r["entropy"], int(r["l2"]), r["l1"], r["card"])
        for r in exact_gsum_cube(df, ["a", "b"], ["v"]).collect()
    }
    want = {}
    for gid in range(4):
        pairs = [
            ((None if gid & 2 else a, None if gid & 1 else b, gid), v) for a, b, v in data
        ]
        want.update(gsums(pairs))
    same(got, want)


def test_positions_and_fields(spark):
    df = spark.createDataFrame([("s", "d", "u", "1", "2", "3")], ",".join(f"c{i} string" for i in range(6)))
    row = to_items(df, [1], [0, 3, 4, 5]).first()
    assert (row["key"], row["value"]) == ("d", "s|1|2|3")
    fields = df.select(F.array(*df.columns).alias("fields"))
    assert to_items(fields, [1], [0, 3, 4, 5]).first() == row


def test_key_columns_beside_the_key(spark):
    df = spark.createDataFrame([(1, "a|b", "v"), (1, "a|b", "w")], "n int, t string, v string")
    row = exact_gsum_of(df, ["n", "t"], ["v"], ["l1", "card"], keep_columns=True).first()
    assert row.asDict() == {"n": 1, "t": "a|b", "key": "1|a\\|b", "l1": 2, "card": 2}


def test_pairs_of_weight_zero_do_not_occur(spark):
    rows = spark.createDataFrame([("a", "x", 2), ("a", "y", 0)], "key string, value string, f bigint")
    assert as_dict(exact_gsum(rows)) == {"a": (2.0, 4, 2, 1)}
