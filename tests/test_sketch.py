import random
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens import (
    SketchParams,
    accuracy_report,
    build_sketch,
    cell_gsum,
    count_items,
    empty_sketch,
    exact_gsum,
    heavy_hitters,
    key_errors,
    key_estimates,
    merge_sketches,
    propagate,
    query_key,
    query_keys,
    sketch_stats,
)
from cohortlens.operators.bounded import key_bounds
from cohortlens.operators.cells import cell_totals, place_items
from cohortlens.operators.counters import count_sketch_build, count_sketch_estimate, merge_counters
from cohortlens.operators.sketch import HH_COLUMNS, _counted_again, _top_of_many, top_of_cells
from cohortlens.operators.topk import split_crowded, topk_items
from cohortlens.session import write_and_read

from brute import gsums, lanes, layer_of, sketch_answers

SMALL = SketchParams(d=3, w=4, levels=6, k=5, rows=3, cols=16, algo="md5")


def skewed_pairs(n=4000, keys=30, values=400, seed=1):
    """A third of all rows belong to one key."""
    rng = random.Random(seed)
    return [
        ("hot" if rng.random() < 1 / 3 else f"k{rng.randrange(keys)}", f"v{int(rng.paretovariate(0.5)) % values}")
        for _ in range(n)
    ]


@pytest.fixture(scope="module")
def pairs():
    return skewed_pairs()


@pytest.fixture(scope="module")
def rows(spark, pairs):
    return spark.createDataFrame(pairs, "key string, value string").cache()


def as_dict(df):
    return {r["key"]: (r["entropy"], int(r["l2"]), r["l1"], r["card"]) for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for key in want:
        assert got[key][0] == pytest.approx(want[key][0])
        assert got[key][1:] == want[key][1:]


def table(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("combine", ["median", "min"])
@pytest.mark.parametrize("params", [SMALL, replace(SMALL, w=1, k=50), replace(SMALL, w=9, levels=2, k=3)])
def test_answers_against_brute_force(rows, pairs, params, combine):
    got = query_keys(build_sketch(rows, params), rows.select("key").distinct(), combine=combine)
    same(as_dict(got), sketch_answers(pairs, params, combine))


def test_layered_build_agrees_with_propagation(rows):
    for algo in ("md5", "xxhash64"):
        params = replace(SMALL, algo=algo)
        plain = propagate(build_sketch(rows, params).hh, params)
        layered = replace(params, layered=True)
        assert table(plain) == table(propagate(build_sketch(rows, layered).hh, layered))


@pytest.mark.parametrize("mode", ["exact_counts", "bounded"])
def test_large_k_is_exact(rows, pairs, mode):
    for d, w in ((1, 1), (3, 1), (3, 50)):
        params = SketchParams(d=d, w=w, k=5000)
        sketch = build_sketch(rows, params, mode, items_tracked=8192)
        same(as_dict(key_estimates(sketch)), gsums(pairs))


def test_min_is_at_most_median(rows):
    sketch = build_sketch(rows, replace(SMALL, algo="xxhash64"))
    low, mid = as_dict(key_estimates(sketch, combine="min")), as_dict(key_estimates(sketch))
    assert all(a <= b for key in mid for a, b in zip(low[key], mid[key]))


def test_prefilter_changes_nothing(rows):
    ranked = place_items(count_items(rows), SMALL, tie_break=True).withColumnRenamed("f", "cnt")
    for k in (1, 5, 40):
        fast = _top_of_many(ranked, SMALL, k)
        assert table(fast) == table(top_of_cells(ranked.select(*HH_COLUMNS), SMALL, k))


def test_counts_beyond_the_packed_score(spark):
    huge = [("a", f"v{i}", (1 << 40) + i) for i in range(200)]
    rows = spark.createDataFrame(huge, "key string, value string, f bigint")
    params = SketchParams(d=1, w=1, levels=1, k=3)
    got = {r["cnt"] for r in build_sketch(rows, params).hh.collect()}
    assert got == {(1 << 40) + i for i in (197, 198, 199)}


def test_row_order_does_not_matter(spark, pairs):
    a = spark.createDataFrame(pairs, "key string, value string").repartition(7)
    b = spark.createDataFrame(pairs[::-1], "key string, value string").coalesce(1)
    assert table(build_sketch(a, SMALL).hh) == table(build_sketch(b, SMALL).hh)


# --- top-k -------------------------------------------------------------------------------


def test_topk_and_ties(spark):
    data = [("g", f"i{i}", "v", c) for i, c in enumerate([9, 7, 7, 7, 5, 5])] + [("h", "x", "v", 1)]
    df = spark.createDataFrame(data, "g string, key string, value string, cnt bigint")
    strict = topk_items(df, ["g"], 2)
    assert table(strict.select("g", "key")) == [("g", "i0"), ("g", "i1"), ("h", "x")]
    ties = topk_items(df, ["g"], 2, ties=True)
    assert table(ties.select("key", "cnt")) == [("i0", 9), ("i1", 7), ("i2", 7), ("i3", 7), ("x", 1)]


def test_topk_beyond_the_group_limit_of_spark(spark, rows):
    placed = place_items(count_items(rows), SMALL).withColumnRenamed("f", "cnt").select(*HH_COLUMNS)
    want = table(topk_items(placed, ["d", "w", "layer"], 20))
    conf = "spark.sql.optimizer.windowGroupLimitThreshold"
    spark.conf.set(conf, "10")
    try:
        assert table(topk_items(placed, ["d", "w", "layer"], 20)) == want
    finally:
        spark.conf.unset(conf)


# --- counters ----------------------------------------------------------------------------


def test_counters_against_brute_force(rows, pairs):
    for sign_bit in (15, 0):
        params = replace(SMALL, sign_bit=sign_bit)
        want = {}
        for key, value in pairs:
            item = lanes(f"item|{len(key)}|{key}|{value}")
            for d in range(params.d):
                w = lanes(f"cell|{key}")[d] % params.w
                for r in range(params.rows):
                    at = (d, w, layer_of(item[3], params.levels), r, item[r] % params.cols)
                    want[at] = want.get(at, 0) + (1 if item[r] >> sign_bit & 1 else -1)
        got = {tuple(r)[:5]: r["c"] for r in count_sketch_build(rows, params).collect()}
        assert got == want


def test_counters_of_rows_and_items_agree_and_add_up(spark, pairs):
    schema = "key string, value string"
    a, b = spark.createDataFrame(pairs[:1500], schema), spark.createDataFrame(pairs[1500:], schema)
    whole = count_sketch_build(spark.createDataFrame(pairs, schema), SMALL)
    parts = [count_sketch_build(a, SMALL), count_sketch_build(count_items(b), SMALL)]
    assert table(whole) == table(merge_counters(*parts)) == table(merge_counters(*parts[::-1]))


def test_estimates_without_collisions_are_exact(rows):
    params = SketchParams(d=3, w=50, rows=5, cols=60_000)
    items = count_items(rows)
    est = count_sketch_estimate(items, count_sketch_build(items, params), params)
    assert est.where("cnt <> f").count() <= 0.01 * est.count()


def test_estimates_are_at_least_one_and_do_not_change_counters(rows):
    items = count_items(rows)
    counters = count_sketch_build(items, SMALL)
    est = count_sketch_estimate(items, counters, SMALL)
    assert est.agg(F.min("cnt")).first()[0] == 1
    assert table(counters) == table(count_sketch_build(items, SMALL))
    unknown = items.select(F.lit("nobody").alias("key"), "value", "f")
    assert count_sketch_estimate(unknown, counters, SMALL).count() == 3 * items.count()


# --- queries -----------------------------------------------------------------------------


def test_missing_repeated_and_distinct_keys(spark, rows):
    sketch = build_sketch(rows, SMALL)
    keys = spark.createDataFrame([("hot", 1), ("hot", 2), ("no such", 3)], "key string, n int")
    got = {(r["key"], r["n"]): r["l1"] for r in query_keys(sketch, keys).collect()}
    assert len(got) == 3 and got["no such", 3] == 0 and got["hot", 1] == got["hot", 2] > 0
    assert query_keys(sketch, keys, distinct=True).count() == 2
    pruned = query_keys(sketch, keys, distinct=True, prune_cells=True)
    assert as_dict(pruned) == as_dict(query_keys(sketch, keys, distinct=True))


def test_point_query_equals_batch_min(rows, pairs):
    sketch = build_sketch(rows, SMALL)
    want = as_dict(key_estimates(sketch, combine="min"))
    for key in ("hot", "k3"):
        same(as_dict(query_key(sketch, key)), {key: want[key]})
    assert as_dict(query_key(sketch, "no such")) == {"no such": (0.0, 0, 0, 0)}


def test_custom_metric_and_whole_cells(rows, pairs):
    params = SketchParams(d=3, w=2, k=5000)
    sketch = build_sketch(rows, params)
    cubes = {r["key"]: r["cubes"] for r in key_estimates(sketch, {"cubes": lambda f: f * f * f}).collect()}
    freq = count_items(rows).groupBy("key").agg(F.sum(F.col("f") ** 3).alias("c")).collect()
    assert cubes == {r["key"]: r["c"] for r in freq}
    assigned = propagate(sketch.hh, params)
    cells = {(r["d"], r["w"]): r["l1"] for r in cell_gsum(assigned, by="cell").collect()}
    assert cells == {(r["d"], r["w"]): r["total_count"] for r in sketch.cells.collect()}
    assert {r["l1"] for r in cell_gsum(assigned, by="table").collect()} == {len(pairs)}


# --- merging and inspection ----------------------------------------------------------------


def test_merge(spark, pairs):
    schema = "key string, value string"
    params = replace(SMALL, k_store=5000)
    parts = [spark.createDataFrame(pairs[i::3], schema) for i in range(3)]
    whole = build_sketch(spark.createDataFrame(pairs, schema), params)
    a, b, c = (build_sketch(p, params) for p in parts)
    merged = merge_sketches(a, b, c)
    assert table(merged.hh) == table(whole.hh)
    assert table(merged.cells) == table(whole.cells)
    assert as_dict(key_estimates(merged)) == as_dict(key_estimates(whole))
    assert as_dict(key_estimates(whole)) == as_dict(
        key_estimates(build_sketch(spark.createDataFrame(pairs, schema), SMALL))
    )
    cut = [build_sketch(p, SMALL) for p in parts]
    assert table(merge_sketches(*cut).hh) == table(merge_sketches(*cut[::-1]).hh)


def test_merge_with_empty_and_with_other_parameters(spark, rows):
    sketch = build_sketch(rows, SMALL)
    assert table(merge_sketches(sketch, empty_sketch(spark, SMALL)).hh) == table(sketch.hh)
    with pytest.raises(ValueError):
        merge_sketches(sketch, empty_sketch(spark, replace(SMALL, k=6)))
    nothing = build_sketch(spark.createDataFrame([], "key string, value string"), SMALL)
    assert nothing.hh.count() == 0 and key_estimates(nothing).count() == 0


def test_bounded_sketches_merge(spark, pairs):
    schema = "key string, value string"
    parts = [build_sketch(spark.createDataFrame(pairs[i::2], schema), SMALL, "bounded", 4096) for i in (0, 1)]
    got = merge_sketches(*parts)
    once = build_sketch(spark.createDataFrame(pairs, schema), SMALL)
    assert table(top_of_cells(got.hh, SMALL, SMALL.k)) == table(once.hh)
    assert got.cuts.agg(F.max("short"), F.max("cut")).first() == (0, 0)


def test_bounded_overflow_keeps_the_heavy(spark):
    pairs = [("a", f"big{i}") for i in range(4) for _ in range(500)] + [("a", f"s{i}") for i in range(3000)]
    rows = spark.createDataFrame(pairs, "key string, value string")
    params = SketchParams(d=1, w=1, levels=1, k=4)
    for given in (rows, count_items(rows)):
        sketch = build_sketch(given, params, "bounded", items_tracked=64)
        assert sketch.hh.count() == 64 and sketch.params.k_kept == 64
        assert {r["value"] for r in sketch.hh.where("cnt = 500").collect()} == {f"big{i}" for i in range(4)}
        assert [tuple(r) for r in sketch.cuts.collect()] == [(0, 0, 0, 5000, 0, 1)]
    with pytest.raises(ValueError):
        build_sketch(rows, params, "bounded", items_tracked=3)


def test_bounded_items_keep_key_and_value_apart(spark):
    pairs = [("a:b", "c"), ("a", "b:c"), ("3:x", "y"), ("世界", "é"), ("", "v"), ("k", "")]
    rows = spark.createDataFrame(pairs, "key string, value string")
    held = build_sketch(rows, SMALL, "bounded", 64).hh
    assert {(r["key"], r["value"]) for r in held.collect()} == set(pairs)


@pytest.mark.parametrize("tree", ["flat", "chain", "pairs"])
def test_bounds_hold_however_a_sketch_was_merged(spark, tree):
    """Skewed keys and values in few cells, parts of uneven size, cut hard: exact sums lie inside, and
    the error of every count within the stated bound."""
    rng = random.Random(len(tree))
    pairs = [(f"k{int(rng.paretovariate(0.7)) % 30}", f"v{int(rng.paretovariate(0.4)) % 900}") for _ in range(6000)]
    params = SketchParams(d=3, w=5, levels=4, k=3)
    cut_at = sorted(rng.sample(range(1, 6000), 5))
    parts = [pairs[a:b] for a, b in zip([0, *cut_at], [*cut_at, 6000])]
    schema, m = "key string, value string", 6
    sketches = [build_sketch(spark.createDataFrame(p, schema), params, "bounded", m) for p in parts]
    if tree == "flat":
        merged, rounds = merge_sketches(*sketches), 1
    elif tree == "chain":
        merged, rounds = sketches[0], 5
        for s in sketches[1:]:
            merged = merge_sketches(merged, s).materialize()
    else:
        halves = [merge_sketches(*sketches[i : i + 2]).materialize() for i in (0, 2, 4)]
        merged, rounds = merge_sketches(*halves), 2
    assert merged.hh.groupBy("d", "w", "layer").count().agg(F.max("count")).first()[0] <= m
    keys = spark.createDataFrame([(f"k{i}", i) for i in range(31)] + [("k0", -1)], "key string, tag int")
    exact = {r["key"]: r for r in exact_gsum(spark.createDataFrame(pairs, schema)).collect()}
    seen = key_bounds(merged, keys).collect()
    assert len(seen) == 32
    for r in seen:
        for name in ("entropy", "l2", "l1", "card"):
            real = float(exact[r["key"]][name]) if r["key"] in exact else 0.0
            assert r[f"{name}_low"] * (1 - 1e-9) - 1e-9 <= real <= r[f"{name}_high"] * (1 + 1e-9) + 1e-9
    for c in merged.cuts.collect():
        assert c["short"] <= c["cut"] <= (rounds + 1) * c["total_count"] / (m + 1)
    true = Counter(pairs)
    held = {(r["d"], r["w"], r["layer"]): r for r in merged.cuts.collect()}
    for r in merged.hh.collect():
        assert 0 <= true[r["key"], r["value"]] - r["cnt"] <= held[r["d"], r["w"], r["layer"]]["short"]


def test_bounds_are_exact_without_a_cut(rows, pairs, spark):
    sketch = build_sketch(rows, SketchParams(d=2, w=7), "bounded", 5000)
    keys = rows.select("key").distinct()
    for r in key_bounds(sketch, keys).collect():
        for name in ("entropy", "l2", "l1", "card"):
            assert r[f"{name}_low"] == pytest.approx(r[f"{name}_high"])
    with pytest.raises(ValueError):
        key_bounds(build_sketch(rows, SMALL), keys)
    nothing = build_sketch(spark.createDataFrame([], "key string, value string"), SMALL, "bounded")
    assert key_bounds(nothing, spark.createDataFrame([("x",)], "key string")).first()["l1_high"] == 0


def test_estimates_cross_one_shuffle(spark, rows):
    """Items meet their counters once; hot cells are dealt to parts."""
    items = write_and_read(count_items(rows), "items")
    counters = write_and_read(count_sketch_build(items, SMALL), "counters")
    found = count_sketch_estimate(items, counters, SMALL)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "_part" in plan
    wide = build_sketch(rows, replace(SMALL, rows=5, cols=7), "count_sketch")
    assert wide.hh.count() and wide.counters.agg(F.max("r"), F.max("pos")).first() == (4, 6)


def test_stats_and_heavy_hitters(rows, pairs):
    sketch = build_sketch(rows, SMALL)
    stats = {r["d"]: r for r in sketch_stats(sketch).collect()}
    for d in range(3):
        assert stats[d]["rows_seen"] == len(pairs)
        assert stats[d]["heavy_hitters"] == sketch.hh.where(F.col("d") == d).count()
    top = heavy_hitters(sketch).collect()
    assert top == sorted(top, key=lambda r: (r["d"], r["w"], -r["cnt"], r["key"], r["value"]))
    assert {r["layer"] for r in top} == {0}
    assert table(sketch.cells) == table(cell_totals(count_items(rows), SMALL))


def test_accuracy(rows):
    exact = exact_gsum(rows)
    full = build_sketch(rows, SketchParams(w=50, k=5000))
    report = {r["metric"]: r for r in accuracy_report(exact, key_estimates(full)).collect()}
    assert set(report) == {"entropy", "l2", "l1", "card"}
    assert all(r["max_err"] == pytest.approx(0, abs=1e-9) for r in report.values())
    none = key_errors(exact, key_estimates(full).where("key <> 'hot'"))
    hot = none.where("key = 'hot'").first()
    assert hot["err_l1"] == exact.where("key = 'hot'").first()["l1"]


def test_unknown_modes_are_refused(rows):
    with pytest.raises(ValueError):
        build_sketch(rows, SMALL, "guess")
    with pytest.raises(ValueError):
        build_sketch(rows, replace(SMALL, layered=True), "count_sketch")


def test_materialized_sketch_answers_the_same(rows):
    sketch = build_sketch(rows, SMALL, "count_sketch")
    stored = sketch.materialize()
    assert as_dict(key_estimates(stored)) == as_dict(key_estimates(sketch))
    assert table(stored.counters) == table(sketch.counters)


def test_ties_are_not_sorted(spark, rows):
    """Neither the rows nor the ones that pass are ranked; few groups get their cutoffs by broadcast."""
    placed = place_items(count_items(rows), SMALL).withColumnRenamed("f", "cnt").select(*HH_COLUMNS)
    for df in (placed, placed.withColumn("layer", F.when(F.col("layer") > 0, F.col("layer")))):
        ranked = df.withColumn("n", F.rank().over(Window.partitionBy("d", "w", "layer").orderBy(F.col("cnt").desc())))
        want = table(ranked.where("n <= 3 AND layer IS NOT NULL").drop("n"))
        for most in (None, 10**9, SMALL.d * SMALL.w * SMALL.levels):
            assert table(topk_items(df, ["d", "w", "layer"], 3, ties=True, most_groups=most)) == want
    plan = topk_items(placed, ["d", "w", "layer"], 3, ties=True, most_groups=100)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" not in plan and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_merge_adds_items_up_in_stages_of_their_own(spark, rows, tmp_path):
    """Kept items are written where they are counted, and dealt out by number when they are merged."""
    a, b = (build_sketch(rows.where(f"hash(key, value) % 2 {op} 0"), SMALL, keep_items=True) for op in ("=", "<>"))
    for sketch in (a, b):
        assert "HashAggregate" not in sketch.items._jdf.queryExecution().executedPlan().toString()
    merged = merge_sketches(a, b, a)
    twice = count_items(rows.unionByName(rows.where("hash(key, value) % 2 = 0")))
    assert table(merged.items) == table(twice)
    assert _counted_again(a.items).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_large_k_ranks_crowded_cells_only(spark, rows):
    placed = place_items(count_items(rows), SMALL, tie_break=True).withColumnRenamed("f", "cnt")
    params = replace(SMALL, k=20)
    want = table(_top_of_many(placed, SMALL, 20)), table(propagate(build_sketch(rows, params).hh, params))
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        assert table(_top_of_many(placed, SMALL, 20)) == want[0]
        assert table(propagate(build_sketch(rows, params).hh, params)) == want[1]
        answers = key_estimates(build_sketch(rows, replace(SMALL, k=100_000)))
        answers.collect()
        plan = answers._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert "Window" not in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_crowded_groups_may_be_null(spark):
    df = spark.createDataFrame([(g, i) for g, n in ((None, 3), ("a", 2), ("b", 4)) for i in range(n)], "g string, i int")
    whole, rest = split_crowded(df, ["g"], 2)
    assert [r[0] for r in whole.collect()] == ["a"] * 2
    assert Counter(r[0] for r in rest.collect()) == {None: 3, "b": 4}
