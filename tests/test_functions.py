import math

import pytest
import xxhash
from pyspark.sql import functions as F

from cohortlens.functions import hashing as H
from cohortlens.functions import metrics as M
from cohortlens.functions import text as X
from cohortlens.params import SketchParams

from brute import lanes as md5_lanes
from brute import layer_of


def test_split_quoted(spark):
    cases = {
        'a,"x,y",3,,': ["a", '"x,y"', "3", "", ""],
        "": [""],
        ",": ["", ""],
        ",a": ["", "a"],
        "a": ["a"],
        'a"b,': ['a"b,'],
        'x,a"b,c': ["x", 'a"b,c'],
        '"a","b""c,d",e': ['"a"', '"b""c,d"', "e"],
        '"",""': ['""', '""'],
        "ä,世,": ["ä", "世", ""],
    }
    df = spark.createDataFrame([(line,) for line in cases], "line string")
    got = {r[0]: r[1] for r in df.select("line", X.split_quoted(F.col("line"))).collect()}
    assert got == cases


def test_split_quoted_long_line(spark):
    line = ",".join(f'"{i},{i}"' * 3 if i % 2 else str(i) for i in range(200_000))
    quotes = 'x"a"' * 200_000
    df = spark.createDataFrame([(line,), (quotes,)], "line string")
    sizes = [r[0] for r in df.select(F.size(X.split_quoted(F.col("line")))).collect()]
    assert sizes == [200_000, 1]


def test_make_key(spark):
    df = spark.createDataFrame(
        [("a|b", "c"), ("a", "b|c"), (None, ""), ("a\\", "b|c"), ("x", "y")], "a string, b string"
    )
    keys = [r[0] for r in df.select(X.make_key(["a", "b"])).collect()]
    assert len(set(keys)) == 5
    assert keys[2] == "|" and keys[4] == "x|y"
    plain = [r[0] for r in df.select(X.make_key(["a", "b"], escape=False)).collect()]
    assert plain[0] == plain[1] == "a|b|c"
    assert [r[0] for r in df.select(X.make_key(["a", "b"], first_n=1)).collect()][0] == "a|b"
    assert X.parse_positions("1,3") == [1, 3]


def test_trailing_ones(spark):
    want = {0: 0, 1: 1, 2: 0, 3: 2, 7: 3, 65535: 16, 5: 1}
    df = spark.createDataFrame([(x,) for x in want], "x int")
    got = {r[0]: r[1] for r in df.select("x", H.item_layer(F.col("x"), 99)).collect()}
    assert got == want
    capped = df.where("x = 65535").select(H.item_layer(F.col("x"), 15)).first()[0]
    assert capped == 14


def test_wide_layer_hash(spark):
    lanes = [0xF123, 0xA456, 0x5789, 0xBEEF]
    got = spark.range(1).select(H.wide_layer_hash(*[F.lit(x) for x in lanes])).first()[0]
    assert got == 0xBEEF | 0xF << 16 | 0xA << 20 | 0x5 << 24


def test_counter_addr(spark):
    df = spark.createDataFrame([(0x8000 + 7,), (7,), (65535,)], "x int")
    for bit in (15, 0):
        pos, sign = H.counter_addr(F.col("x"), 400, bit)
        for x, p, s in df.select("x", pos, sign).collect():
            assert p == x % 400 and s == (1 if x >> bit & 1 else -1)


def test_md5_lanes(spark):
    df = spark.createDataFrame([("k", "v"), ("a:b", "c"), ("a", "b:c")], "key string, value string")
    lanes = H.hash_lanes(F.col("key"), F.col("value"), salt="item", algo="md5", n_lanes=8)
    for key, value, got in df.select("key", "value", lanes).collect():
        assert got == md5_lanes(f"item|{len(key)}|{key}|{value}")


def test_xxhash_lanes(spark):
    df = spark.createDataFrame([("k", "v"), ("10.0.0.1", "x|y"), ("", "")], "key string, value string")
    lanes = H.hash_lanes(F.col("key"), F.col("value"), salt="item")
    for key, value, got in df.select("key", "value", lanes).collect():
        h = 42  # the engine's fixed seed; every column is hashed with the last hash as seed
        for part in ("item", key, value):
            h = xxhash.xxh64_intdigest(part.encode(), h)
        assert got == [h >> 16 * i & 0xFFFF for i in range(4)]


def test_lanes_beyond_one_hash(spark):
    params = SketchParams(rows=5, w=1 << 20, d=4)
    assert len(H.item_lanes(params).columns) == 2 and H.key_lanes(params).n_lanes == 8
    df = spark.createDataFrame([("a",), ("b",)], "key string")
    attached = H.key_lanes(params).attach(df, "key").select(*H.key_grid_columns(params)).collect()
    inline = df.select(*H.grid_columns(H.key_lanes(params).of(F.col("key")), params)).collect()
    assert attached == inline
    assert all(0 <= w < 1 << 20 for row in attached for w in row)
    assert max(w for row in attached for w in row) > 65535


def test_layers_are_geometric(spark):
    params = SketchParams(levels=25)
    lanes = H.item_lanes(params, counters=False)
    df = spark.range(100_000).select(F.col("id").cast("string").alias("key"), F.lit("v").alias("value"))
    counts = dict(
        lanes.attach(df, "key", "value")
        .select(H.sketch_layer(lanes, params).alias("l"))
        .groupBy("l").count().collect()
    )
    for l in range(5):
        assert counts[l] == pytest.approx(100_000 / 2 ** (l + 1), rel=0.1)
    assert layer_of(0b0111, 15) == 3


def test_relative_error(spark):
    cases = [(5.0, 0.0, 5.0), (0.0, 1.0, 100.0), (4.0, 5.0, 25.0), (0.0, 0.0, 0.0), (3.0, 1e-7, 3.0)]
    df = spark.createDataFrame(cases, "real double, est double, want double")
    for got, want in df.select(M.relative_error_pct(F.col("real"), F.col("est")), "want").collect():
        assert got == pytest.approx(want)
    arr = spark.range(1).select(M.relative_errors_pct(F.lit(4.0), F.array(F.lit(5.0), F.lit(0.0))))
    assert arr.first()[0] == [25.0, 4.0]


def test_combine(spark):
    df = spark.createDataFrame([(3, 1, 2), (5, 5, 1)], "a int, b int, c int")
    cols = [F.col(c) for c in "abc"]
    assert [r[0] for r in df.select(M.combine_rows(cols, "min")).collect()] == [1, 1]
    assert [r[0] for r in df.select(M.combine_rows(cols, "median")).collect()] == [2, 5]
    with pytest.raises(ValueError):
        M.combine_rows(cols[:2], "median")


def test_median_keeps_small_digits(spark):
    got = spark.range(1).select(M.combine_rows([F.lit(1e18), F.lit(0.25), F.lit(-1e18)], "median"))
    assert got.first()[0] == 0.25


def test_python_udf_is_refused():
    g = F.udf(lambda x: x)
    with pytest.raises(TypeError):
        M.resolve_metrics({"mine": g})


def test_formats(spark):
    df = spark.createDataFrame([("k", 4.754, 10.0, 4, 2)], "key string, e double, l2 double, l1 long, c long")
    cols = [F.col(c) for c in df.columns]
    assert df.select(X.format_line(*cols)).first()[0] == "k,4.75,10.00,4.00,2.00"
    assert df.select(X.format_line(*cols, spaced=True)).first()[0] == "k, 4.75, 10.00, 4.00, 2.00"
    arr = spark.sql("select array(1.0d, 2.456d) a union all select null")
    assert [r[0] for r in arr.select(X.format_array(F.col("a"))).collect()] == ["[1.00, 2.46]", "null"]


def test_shannon(spark):
    df = spark.createDataFrame([(3 * math.log2(3), 4)], "e double, l1 long")
    got = df.select(M.shannon_entropy(F.col("e"), F.col("l1"))).first()[0]
    assert got == pytest.approx(-(0.75 * math.log2(0.75) + 0.25 * math.log2(0.25)))


def test_params():
    for bad in ({"d": 0}, {"algo": "crc"}, {"k": 5, "k_store": 4}, {"levels": 30}, {"sign_bit": 16}):
        with pytest.raises(ValueError):
            SketchParams(**bad)
