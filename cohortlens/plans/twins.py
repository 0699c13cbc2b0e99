"""SQL twins of the registered queries, for any engine with md5, windows and bit functions."""

from __future__ import annotations

from .catalog import (
    BOUNDED_ITEMS,
    CUBE_DIMS,
    CUBE_PARAMS,
    DELAY_DAYS,
    ENTROPY_DIGITS,
    MIN_GROUP_SIZE,
    MIN_PAIR_SIZE,
    PARAMS,
    POINT_KEY,
    REPEATS,
    SLIDING_DAYS,
    SMALL_K,
    TOP_KEYS,
    WIDE_PARAMS,
)

P = PARAMS

LINEITEM_ITEMS = """
items AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS key, CAST(l_partkey AS VARCHAR) AS value, count(*) AS f
  FROM lineitem GROUP BY 1, 2)"""

EVENT_TUPLE = """replace(replace(event_type, '\\', '\\\\'), '|', '\\|') || '|' ||
  replace(replace(props, '\\', '\\\\'), '|', '\\|')"""

EVENT_ITEMS = f"""
items AS (
  SELECT CAST(user_id AS VARCHAR) AS key, {EVENT_TUPLE} AS value, count(*) AS f
  FROM events GROUP BY 1, 2)"""

LINE_ITEMS = """
items AS (
  SELECT CAST(user_id AS VARCHAR) AS key,
    event_type || '|"' || event_type || ',' || event_type || '"|' ||
    replace(replace(props, '\\', '\\\\'), '|', '\\|') || '|' || event_type AS value, count(*) AS f
  FROM events GROUP BY 1, 2)"""

PAIR_KEY = """CAST(user_id AS VARCHAR) || '|"' || event_type || ',' || event_type || '"'"""

SUPPLIER_KEYS = "wanted AS (SELECT CAST(s_suppkey AS VARCHAR) AS key FROM supplier)"


def _lane(h: str, i: int) -> str:
    return f"CAST('0x' || substr({h}, {4 * i + 1}, 4) AS INTEGER)"


def _layer(lane: str, levels: int = P.levels) -> str:
    return f"least(CAST(bit_count(xor({lane}, {lane} + 1) >> 1) AS INTEGER), {levels - 1})"


WIDE_HASH = "(i3 | ((i0 >> 12) << 16) | ((i1 >> 12) << 20) | ((i2 >> 12) << 24))"


HASHED = f"""
hashed AS (
  SELECT *, md5('item|' || length(key) || '|' || key || '|' || value) AS hi, md5('cell|' || key) AS hk
  FROM items),
laned AS (
  SELECT key, value, f, hk, {", ".join(f"{_lane('hi', i)} AS i{i}" for i in range(4))} FROM hashed),
layered AS (
  SELECT *, {_layer("i3")} AS layer, (CAST(i0 AS BIGINT) << 16) | i1 AS tie FROM laned)"""

GRID = f"(SELECT unnest(range({P.d})) AS d) grid"


def _wide_cell(hk: str) -> str:
    cases = " ".join(
        f"WHEN {i} THEN {_lane(hk, 2 * i)} + 65536 * CAST({_lane(hk, 2 * i + 1)} AS BIGINT)"
        for i in range(P.d)
    )
    return f"CAST((CASE d {cases} END) % {WIDE_PARAMS.w} AS INTEGER)"


def _cell(hk: str) -> str:
    cases = " ".join(f"WHEN {i} THEN {_lane(hk, i)}" for i in range(P.d))
    return f"CAST((CASE d {cases} END) % {P.w} AS INTEGER)"


PLACED = f"""
placed AS (
  SELECT key, value, f, layer, tie, i0, i1, i2, CAST(d AS INTEGER) AS d, {_cell("hk")} AS w
  FROM layered, {GRID})"""


def _top(name: str, source: str, layer: str, k: int, cnt: str = "cnt") -> str:
    return f"""
{name} AS (
  SELECT d, w, {layer}, key, value, {cnt} AS cnt, tie FROM (
    SELECT *, row_number() OVER (
      PARTITION BY d, w, {layer} ORDER BY {cnt} DESC, tie, key, value) AS rn
    FROM {source}) WHERE rn <= {k})"""


HH = _top("hh", "placed", "layer", P.k, "f")

ASSIGNED = f"""
cand AS (SELECT hh.*, m FROM hh, (SELECT unnest(range({P.levels})) AS m) ms WHERE m <= layer),
{_top("kept", "cand", "m", P.k)},
assigned AS (
  SELECT d, w, key, value, CAST(min(m) AS INTEGER) AS m, min(cnt) AS cnt
  FROM kept GROUP BY d, w, key, value)"""

SKETCH = ",".join([LINEITEM_ITEMS, HASHED, PLACED, HH, ASSIGNED])


def _sums(freq: str = "f", weight: str = "") -> str:
    w = f"{weight} * " if weight else ""
    card = weight or "1"
    return f"""sum({w}{freq} * log2({freq})) AS entropy,
    CAST(sum({w}{freq} * {freq}) AS DOUBLE) AS l2, CAST(sum({w}{freq}) AS BIGINT) AS l1,
    CAST(sum({card}) AS BIGINT) AS card"""


WEIGHT = "CAST(1 << m AS BIGINT)"
PER_CELL = f"""
per_cell AS (
  SELECT d, w, key, {_sums("cnt", WEIGHT)} FROM assigned GROUP BY d, w, key)"""

METRICS = ("entropy", "l2", "l1", "card")
TYPES = {"entropy": "DOUBLE", "l2": "DOUBLE", "l1": "BIGINT", "card": "BIGINT"}


def _combined(how: str, keys: str = "wanted") -> str:
    """Answers per key of ``keys``; grid rows without the key count as zero."""
    if how == "min":
        pick = "CASE WHEN count(d) < {d} THEN 0 ELSE min({m}) END"
    else:
        pick = (
            "coalesce(list_sort(list_concat(coalesce(list({m}) FILTER (d IS NOT NULL), []),"
            " list_resize(CAST([] AS {t}[]), {d} - CAST(count(d) AS INTEGER), 0)))[{mid}], 0)"
        )
    picks = ", ".join(
        f"CAST({pick.format(m='p.' + m, d=P.d, mid=P.d // 2 + 1, t=TYPES[m])} AS {TYPES[m]}) AS {m}"
        for m in METRICS
    )
    return f"""
distinct_keys AS (SELECT DISTINCT key FROM {keys}),
answers AS (
  SELECT q.key, {picks} FROM distinct_keys q LEFT JOIN per_cell p ON p.key = q.key GROUP BY q.key)"""


ANSWER_COLUMNS = f"key, round(entropy, {ENTROPY_DIGITS}) AS entropy, l2, l1, card"


def _answers(how: str, wanted: str, sketch: str = SKETCH, tail: str | None = None) -> str:
    tail = tail or f"SELECT {ANSWER_COLUMNS} FROM wanted JOIN answers USING (key)"
    return f"WITH {sketch},{PER_CELL},{wanted},{_combined(how)} {tail}"


RESULT_LINES = """SELECT printf('%s,%.2f,%.2f,%.2f,%.2f', key, entropy, l2,
  CAST(l1 AS DOUBLE), CAST(card AS DOUBLE)) AS line FROM answers"""

HELD_KEYS = "wanted AS (SELECT DISTINCT key FROM assigned)"


def _updates(sign_bit: int) -> str:
    rows = " UNION ALL ".join(
        f"SELECT d, w, layer, {r} AS r, CAST(i{r} % {P.cols} AS INTEGER) AS pos, "
        f"2 * ((i{r} >> {sign_bit}) & 1) - 1 AS sign, key, value, f, tie FROM placed"
        for r in range(P.rows)
    )
    return f"updates AS ({rows})"


COUNTERS = """
counters AS (
  SELECT d, w, layer, r, pos, CAST(sum(sign * f) AS BIGINT) AS c
  FROM updates GROUP BY d, w, layer, r, pos)"""

ESTIMATED = f"""
estimated AS (
  SELECT d, w, layer, key, value, tie,
    greatest(list_sort(list(CAST(sign * c AS BIGINT)))[{P.rows // 2 + 1}], 1) AS cnt
  FROM updates JOIN counters USING (d, w, layer, r, pos) GROUP BY ALL)"""


def _counters(items: str, sign_bit: int = P.sign_bit) -> str:
    return (
        f"WITH {items},{HASHED},{PLACED},{_updates(sign_bit)},{COUNTERS} "
        "SELECT d, w, layer, r, pos, c FROM counters"
    )


COUNT_SKETCH = ",".join(
    [
        LINEITEM_ITEMS,
        HASHED,
        PLACED,
        _updates(P.sign_bit),
        COUNTERS,
        ESTIMATED,
        _top("hh", "estimated", "layer", P.k),
        ASSIGNED,
    ]
)

ERRORS = f"""
exact AS (SELECT key, {_sums()} FROM items GROUP BY key),
errors AS (
  SELECT key, {", ".join(
    f'''CASE WHEN abs(coalesce(a.{m}, 0)) < 1e-6 THEN abs(CAST(e.{m} AS DOUBLE))
        WHEN e.{m} = 0 THEN 100.0
        ELSE abs(CAST(e.{m} AS DOUBLE) - a.{m}) / e.{m} * 100 END AS err_{m}'''
    for m in METRICS
  )} FROM exact e LEFT JOIN answers a USING (key))"""


def _report() -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, count(*) AS n_keys, round(avg(err_{m}), 4) AS mean_err, "
        f"round(max(err_{m}), 4) AS max_err, round(quantile_disc(err_{m}, 0.5), 4) AS approx_p50_err, "
        f"round(quantile_disc(err_{m}, 0.95), 4) AS approx_p95_err FROM errors"
        for m in METRICS
    )
    return f"{ERRORS} {parts}"


def _merge() -> str:
    halves = LINEITEM_ITEMS.replace("count(*) AS f", "l_orderkey % 2 AS part, count(*) AS f").replace(
        "GROUP BY 1, 2", "GROUP BY 1, 2, 3"
    )
    hashed = HASHED.replace("SELECT key, value, f, hk,", "SELECT part, key, value, f, hk,")
    placed = PLACED.replace("SELECT key, value, f,", "SELECT part, key, value, f,")
    return f"""WITH {halves},{hashed},{placed},
parts AS (
  SELECT d, w, layer, key, value, tie, CAST(sum(f) AS BIGINT) AS cnt FROM (
    SELECT *, row_number() OVER (
      PARTITION BY part, d, w, layer ORDER BY f DESC, tie, key, value) AS rn
    FROM placed) WHERE rn <= {P.k} GROUP BY ALL),
{_top("hh", "parts", "layer", P.k)}
SELECT d, w, layer, key, value, cnt FROM hh"""


def _bounds() -> str:
    m = BOUNDED_ITEMS
    halves = LINEITEM_ITEMS.replace("count(*) AS f", "l_orderkey % 2 AS part, count(*) AS f").replace(
        "GROUP BY 1, 2", "GROUP BY 1, 2, 3"
    )
    hashed = HASHED.replace("SELECT key, value, f, hk,", "SELECT part, key, value, f, hk,")
    placed = PLACED.replace("SELECT key, value, f,", "SELECT part, key, value, f,")
    g = {"entropy": "cnt * log2(cnt)", "l2": "cnt * cnt", "l1": "cnt", "card": "1"}
    top = "(coalesce(heaviest, 0) + short)"
    on_kept = "short > 0 AND heaviest IS NOT NULL"
    more = {
        "entropy": f"missing * greatest(log2(greatest(cut, 1)), "
        f"CASE WHEN {on_kept} THEN log2({top}) + 1 / ln(2) ELSE 0 END)",
        "l2": f"missing * greatest(cut, CASE WHEN {on_kept} THEN 2 * {top} ELSE 0 END)",
        "l1": "missing",
        "card": "missing",
    }
    low, high = (
        ", ".join(f"sum(coalesce(g_{x}, 0){plus(x)}) AS {x}_{side}" for x in METRICS)
        for side, plus in (("low", lambda x: ""), ("high", lambda x: f" + {more[x]}"))
    )
    best = ", ".join(
        f"round(CAST(max({x}_low) AS DOUBLE), {ENTROPY_DIGITS}) AS {x}_low, "
        f"round(CAST(CASE WHEN count(*) = {P.d} THEN min({x}_high) ELSE 0 END AS DOUBLE), {ENTROPY_DIGITS}) AS {x}_high"
        for x in METRICS
    )
    cols = ", ".join(
        f"coalesce({x}_{side}, CAST(0 AS DOUBLE)) AS {x}_{side}" for x in METRICS for side in ("low", "high")
    )
    return f"""WITH {halves},{hashed},{placed},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY part, d, w, layer ORDER BY f DESC, tie, key, value) AS rn
  FROM placed),
part_cuts AS (
  SELECT part, d, w, layer, sum(f) AS total, coalesce(max(f) FILTER (rn = {m + 1}), 0) AS cut
  FROM ranked GROUP BY ALL),
summed AS (
  SELECT d, w, layer, key, value, tie, sum(f) AS cnt FROM ranked WHERE rn <= {m} GROUP BY ALL),
again AS (
  SELECT *, row_number() OVER (PARTITION BY d, w, layer ORDER BY cnt DESC, tie, key, value) AS rn FROM summed),
dropped AS (SELECT d, w, layer, cnt AS most FROM again WHERE rn = {m + 1}),
hh AS (SELECT * FROM again WHERE rn <= {m}),
held AS (SELECT d, w, layer, sum(cnt) AS held FROM hh GROUP BY ALL),
totals AS (SELECT d, w, layer, sum(total) AS total, sum(cut) AS short FROM part_cuts GROUP BY ALL),
slack AS (
  SELECT d, w, layer, CAST(total - coalesce(held, 0) AS DOUBLE) AS missing, CAST(short AS DOUBLE) AS short,
    CAST(short + coalesce(most, 0) AS DOUBLE) AS cut
  FROM totals LEFT JOIN held USING (d, w, layer) LEFT JOIN dropped USING (d, w, layer)),
kept AS (
  SELECT key, d, w, layer, {", ".join(f"CAST(sum({e}) AS DOUBLE) AS g_{x}" for x, e in g.items())},
    CAST(max(cnt) AS DOUBLE) AS heaviest
  FROM hh GROUP BY key, d, w, layer),
hashed_keys AS (SELECT CAST(s_suppkey AS VARCHAR) AS key, md5('cell|' || s_suppkey) AS hk FROM supplier),
wanted AS (SELECT key, CAST(d AS INTEGER) AS d, {_cell("hk")} AS w FROM hashed_keys, {GRID}),
grid_rows AS (
  SELECT key, d, {low}, {high}
  FROM wanted JOIN slack USING (d, w) LEFT JOIN kept USING (key, d, w, layer) GROUP BY key, d),
best AS (SELECT key, {best} FROM grid_rows GROUP BY key)
SELECT key, {cols} FROM hashed_keys LEFT JOIN best USING (key)"""


def _cube() -> str:
    dims, p = ", ".join(CUBE_DIMS), CUBE_PARAMS

    def top(name: str, source: str, groups: str, k: int) -> str:
        return f"""{name} AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY {groups} ORDER BY cnt DESC, tie, value) AS rn FROM {source})
  WHERE rn <= {k})"""

    return f"""
items AS (
  SELECT {dims}, CAST(l_partkey AS VARCHAR) AS value, count(*) AS cnt FROM lineitem GROUP BY ALL),
hashed AS (SELECT *, md5('value|' || value) AS hv FROM items),
placed AS (
  SELECT {dims}, value, cnt, {_layer(_lane("hv", 3), p.levels)} AS layer,
    (CAST({_lane("hv", 0)} AS BIGINT) << 16) | {_lane("hv", 1)} AS tie FROM hashed),
{top("finest", "placed", f"{dims}, layer", p.k_kept)},
summed AS (
  SELECT {dims}, grouping_id({dims}) AS grouping_id, layer, value, tie, CAST(sum(cnt) AS BIGINT) AS cnt
  FROM finest GROUP BY layer, value, tie, CUBE ({dims})),
{top("merged", "summed", f"grouping_id, {dims}, layer", p.k)},
cand AS (SELECT merged.*, m FROM merged, (SELECT unnest(range({p.levels})) AS m) WHERE m <= layer),
{top("kept", "cand", f"grouping_id, {dims}, m", p.k)},
assigned AS (
  SELECT grouping_id, {dims}, value, min(m) AS m, max(cnt) AS cnt FROM kept GROUP BY grouping_id, {dims}, value),
estimates AS (SELECT grouping_id, {dims}, {_sums("cnt", WEIGHT)} FROM assigned GROUP BY grouping_id, {dims})"""


def _cube_errors() -> str:
    dims = ", ".join(CUBE_DIMS)
    same = " AND ".join(f"a.{c} IS NOT DISTINCT FROM e.{c}" for c in ["grouping_id", *CUBE_DIMS])
    parts = " UNION ALL ".join(
        f"""SELECT e.grouping_id, '{m}' AS metric, count(*) AS n_groups,
          round(avg(abs(CAST(e.{m} AS DOUBLE) - coalesce(a.{m}, 0)) / e.{m} * 100), {ENTROPY_DIGITS}) AS mean_err,
          round(max(abs(CAST(e.{m} AS DOUBLE) - coalesce(a.{m}, 0)) / e.{m} * 100), {ENTROPY_DIGITS}) AS max_err
        FROM exact e LEFT JOIN estimates a ON {same} GROUP BY e.grouping_id"""
        for m in METRICS
    )
    return f"""WITH {_cube()},
counts AS (
  SELECT {dims}, l_partkey, grouping_id({dims}) AS grouping_id, count(*) AS f
  FROM lineitem GROUP BY l_partkey, CUBE ({dims})),
exact AS (SELECT grouping_id, {dims}, {_sums()} FROM counts GROUP BY grouping_id, {dims})
{parts}"""


def _gsum(groups: str) -> str:
    return (
        f"WITH {SKETCH}, sums AS (SELECT {groups}, {_sums('cnt', WEIGHT)} FROM assigned "
        f"GROUP BY {groups}) SELECT {groups}, round(entropy, {ENTROPY_DIGITS}) AS entropy, "
        "l2, l1, card FROM sums"
    )


def _exact_sql(items: str, freq: str = "f", groups: str = "key") -> str:
    columns, by = (f"{groups}, ", f" GROUP BY {groups}") if groups else ("", "")
    return (
        f"WITH {items}, sums AS (SELECT {columns}{_sums(freq)} FROM items{by}) "
        f"SELECT {columns}round(entropy, {ENTROPY_DIGITS}) AS entropy, l2, l1, card FROM sums"
    )


def _items(table: str, key: str, value: str) -> str:
    return f"items AS (SELECT {key} AS key, {value} AS value, count(*) AS f FROM {table} GROUP BY 1, 2)"


QUOTED_FIELD = """,((?:[^,"]|"[^"]*(?:"|$))*)"""


def _split(line: str) -> str:
    return f"regexp_extract_all(',' || {line}, '{QUOTED_FIELD}', 1)"


SQL: dict[str, str] = {
    "exact_gsum": _exact_sql(LINEITEM_ITEMS),
    "exact_gsum_multikey": _exact_sql(
        _items("lineitem", "l_returnflag || '|' || l_linestatus", "l_suppkey")
    ),
    "exact_gsum_heavy_repeats": _exact_sql(_items("orders", "o_orderstatus", "o_orderpriority")),
    "exact_gsum_tuple_value": _exact_sql(EVENT_ITEMS),
    "exact_gsum_prefix_key": _exact_sql(
        _items("customer", "c_mktsegment || '|' || c_nationkey", "c_custkey")
    ),
    "exact_gsum_custom_g": f"""WITH {LINEITEM_ITEMS}
      SELECT key, CAST(sum(least(f, 3)) AS BIGINT) AS capped, CAST(sum(f * f * f) AS DOUBLE) AS cubes
      FROM items GROUP BY key""",
    "exact_gsum_global": _exact_sql(LINEITEM_ITEMS, groups=""),
    "exact_gsum_cube": f"""WITH items AS (
        SELECT l_returnflag, l_linestatus, l_suppkey,
          grouping_id(l_returnflag, l_linestatus) AS grouping_id, count(*) AS f
        FROM lineitem GROUP BY l_suppkey, CUBE (l_returnflag, l_linestatus)),
      sums AS (SELECT l_returnflag, l_linestatus, grouping_id, {_sums()}
        FROM items GROUP BY ALL)
      SELECT l_returnflag, l_linestatus, grouping_id, round(entropy, {ENTROPY_DIGITS}) AS entropy,
        l2, l1, card FROM sums""",
    "shannon_entropy": f"""WITH {LINEITEM_ITEMS}, sums AS (SELECT key, {_sums()} FROM items GROUP BY key)
      SELECT key, round(log2(l1) - entropy / l1, {ENTROPY_DIGITS}) AS shannon FROM sums""",
    "repeat_ingest": _exact_sql(LINEITEM_ITEMS.replace("count(*)", f"{REPEATS} * count(*)")),
    "repeat_counted": _exact_sql(LINEITEM_ITEMS.replace("count(*)", f"{REPEATS} * count(*)")),
    "split_quoted": f"""WITH lines AS (
        SELECT event_id || ',"' || event_type || ',' || user_id || '",' || user_id AS line FROM events),
      fields AS (SELECT {_split("line")} AS x FROM lines)
      SELECT CAST(len(x) AS INTEGER) AS n_fields, x[1] AS field0, x[2] AS field1, x[3] AS field2
      FROM fields""",
    "split_quoted_documents": f"""WITH fields AS (SELECT doc_id, {_split("text")} AS x FROM documents)
      SELECT doc_id, CAST(len(x) AS INTEGER) AS n_fields,
        md5(array_to_string(x, chr(10))) AS fields_md5 FROM fields""",
    "restrict_top_keys": _exact_sql(
        LINEITEM_ITEMS.replace(
            "FROM lineitem",
            "FROM lineitem WHERE l_suppkey IN "
            f"(SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT {TOP_KEYS})",
        )
    ),
    "hash_lanes": f"""WITH {LINEITEM_ITEMS},{HASHED}
      SELECT key, value, i0 AS lane0, i1 AS lane1, i2 AS lane2, i3 AS lane3, layer,
        {WIDE_HASH} AS wide_hash
      FROM layered""",
    "layer_histogram": f"""WITH {LINEITEM_ITEMS},{HASHED}
      SELECT layer, count(*) AS n_items FROM layered GROUP BY layer""",
    "cell_assignment": f"""WITH wanted AS (
        SELECT CAST(s_suppkey AS VARCHAR) AS key, md5('cell|' || s_suppkey) AS hk FROM supplier)
      SELECT key, CAST(d AS INTEGER) AS d, {_cell("hk")} AS w FROM wanted, {GRID}""",
    "cell_assignment_wide": f"""WITH wanted AS (
        SELECT CAST(s_suppkey AS VARCHAR) AS key, md5('cell|' || s_suppkey) AS hk FROM supplier)
      SELECT key, CAST(d AS INTEGER) AS d, {_wide_cell("hk")} AS w FROM wanted, {GRID}""",
    "layer_histogram_wide": f"""WITH {LINEITEM_ITEMS},{HASHED}
      SELECT {_layer(WIDE_HASH, WIDE_PARAMS.levels)} AS layer, count(*) AS n_items
      FROM layered GROUP BY 1""",
    "count_sketch_build": _counters(LINEITEM_ITEMS),
    "count_sketch_low_sign": _counters(LINEITEM_ITEMS, sign_bit=0),
    "count_sketch_estimate": f"""WITH {LINEITEM_ITEMS},{HASHED},{PLACED},{_updates(P.sign_bit)},
      {COUNTERS},{ESTIMATED} SELECT d, w, layer, key, value, cnt FROM estimated""",
    "merge_counters": _counters(LINEITEM_ITEMS),
    "topk_items": f"""WITH {LINEITEM_ITEMS},{HASHED},{PLACED},{_top("top", "placed", "layer", SMALL_K, "f")}
      SELECT d, w, layer, key, value, cnt FROM top""",
    "topk_items_ties": f"""WITH {LINEITEM_ITEMS},{HASHED},{PLACED}
      SELECT d, w, layer, key, value, f AS cnt FROM (
        SELECT *, rank() OVER (PARTITION BY d, w, layer ORDER BY f DESC) AS rk FROM placed)
      WHERE rk <= {SMALL_K}""",
    "sketch_build": f"""WITH {LINEITEM_ITEMS},{HASHED},{PLACED},{HH}
      SELECT d, w, layer, key, value, cnt FROM hh""",
    "cell_totals": f"""WITH {LINEITEM_ITEMS},{HASHED},{PLACED}
      SELECT d, w, CAST(sum(f) AS BIGINT) AS total_count FROM placed GROUP BY d, w""",
    "sketch_stats": f"""WITH {LINEITEM_ITEMS},{HASHED},{PLACED},{HH},
      held AS (SELECT d, count(*) AS heavy_hitters FROM hh GROUP BY d),
      used AS (SELECT d, count(DISTINCT w) AS cells_used, CAST(sum(f) AS BIGINT) AS rows_seen
        FROM placed GROUP BY d)
      SELECT d, heavy_hitters, cells_used, rows_seen FROM used JOIN held USING (d)""",
    "heavy_hitters": f"""WITH {LINEITEM_ITEMS},{HASHED},{PLACED},{HH}
      SELECT d, w, layer, key, value, cnt FROM hh WHERE layer = 0""",
    "merge_sketches": _merge(),
    "merge_sketches_kept": _answers("median", HELD_KEYS),
    "propagate_layers": f"WITH {SKETCH} SELECT d, w, key, value, m, cnt FROM assigned",
    "sketch_gsum_median": _answers("median", SUPPLIER_KEYS),
    "sketch_gsum_min": _answers("min", SUPPLIER_KEYS),
    "sketch_gsum_layered": _answers("median", HELD_KEYS),
    "sketch_gsum_count_sketch": _answers("median", HELD_KEYS, COUNT_SKETCH),
    "sketch_gsum_custom_g": f"""WITH {SKETCH}, per_cell AS (
        SELECT d, key, CAST(sum({WEIGHT} * cnt * cnt * cnt) AS DOUBLE) AS s FROM assigned GROUP BY d, key)
      SELECT key, list_sort(list_concat(list(s),
        list_resize(CAST([] AS DOUBLE[]), {P.d} - CAST(count(*) AS INTEGER), 0)))[{P.d // 2 + 1}] AS cubes
      FROM per_cell GROUP BY key""",
    "cell_gsum_all": _gsum("d, w"),
    "table_gsum": _gsum("d"),
    "point_query": _answers("min", f"wanted AS (SELECT '{POINT_KEY}' AS key)"),
    "saved_point_query": _answers("min", f"wanted AS (SELECT '{POINT_KEY}' AS key)"),
    "sketch_xx_whole": _exact_sql(LINEITEM_ITEMS),
    "missing_keys": _answers(
        "median",
        """wanted AS (SELECT CAST(s_suppkey AS VARCHAR) AS key FROM supplier
        UNION ALL SELECT 'none:' || s_suppkey FROM supplier)""",
    ),
    "query_repeated": _answers(
        "median",
        """wanted AS (SELECT CAST(s_suppkey AS VARCHAR) AS key FROM supplier
        UNION ALL SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)""",
    ),
    "query_distinct": _answers(
        "median", "wanted AS (SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS key FROM lineitem)"
    ),
    "query_keys_min_group": _answers(
        "median",
        f"""wanted AS (SELECT CAST(l_suppkey AS VARCHAR) AS key FROM lineitem
        GROUP BY 1 HAVING count(*) >= {MIN_GROUP_SIZE})""",
    ),
    "sketch_bounded": _answers("median", SUPPLIER_KEYS),
    "sketch_roundtrip": _answers("median", SUPPLIER_KEYS),
    "bucketed_query": _answers("median", SUPPLIER_KEYS),
    "format_estimates": _answers("min", SUPPLIER_KEYS, tail=RESULT_LINES),
    "file_job": _answers(
        "min",
        "wanted AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key FROM events)",
        ",".join([LINE_ITEMS, HASHED, PLACED, HH, ASSIGNED]),
        tail=RESULT_LINES,
    ),
    "file_job_batch": _answers(
        "median",
        f"wanted AS (SELECT {PAIR_KEY} AS key FROM events GROUP BY 1 HAVING count(*) >= {MIN_PAIR_SIZE})",
        ",".join([_items("events", PAIR_KEY, "props"), HASHED, PLACED, HH, ASSIGNED]),
        tail=RESULT_LINES.replace("%s,%.2f,%.2f,%.2f,%.2f", "%s, %.2f, %.2f, %.2f, %.2f"),
    ),
    "format_array": f"""WITH {LINEITEM_ITEMS}, sums AS (SELECT key, {_sums()} FROM items GROUP BY key)
      SELECT key, printf('[%.2f, %.2f, %.2f, %.2f]', entropy, l2,
        CAST(l1 AS DOUBLE), CAST(card AS DOUBLE)) AS line FROM sums""",
    "errors_by_key": f"""WITH {SKETCH},{PER_CELL},{HELD_KEYS},{_combined("median")},{ERRORS}
      SELECT key, {", ".join(f"round(err_{m}, 4) AS err_{m}" for m in METRICS)} FROM errors""",
    "grid_row_errors": f"""WITH {SKETCH},{PER_CELL}, exact AS (
        SELECT key, CAST(sum(f) AS DOUBLE) AS n FROM items GROUP BY key),
      found AS (SELECT e.key, n, d, l1 FROM exact e LEFT JOIN per_cell p ON p.key = e.key)
      SELECT key, {", ".join(
        f"round(CASE WHEN max(l1) FILTER (d = {d}) IS NULL THEN any_value(n) "
        f"ELSE abs(any_value(n) - max(l1) FILTER (d = {d})) / any_value(n) * 100 END, 4) AS err{d}"
        for d in range(P.d)
      )} FROM found GROUP BY key""",
    "cube_estimates": f"""WITH {_cube()}
      SELECT grouping_id, {", ".join(CUBE_DIMS)}, round(entropy, {ENTROPY_DIGITS}) AS entropy, l2, l1, card
      FROM estimates""",
    "cube_errors": _cube_errors(),
    "accuracy_report": f"WITH {SKETCH},{PER_CELL},{HELD_KEYS},{_combined('median')},{_report()}",
    "stream_window_gsum": f"""WITH items AS (
        SELECT date_trunc('day', ts) AS day, CAST(user_id AS VARCHAR) AS key, event_type AS value,
          count(*) AS f FROM events GROUP BY 1, 2, 3),
      sums AS (SELECT day, key, {_sums()} FROM items GROUP BY day, key)
      SELECT CAST(epoch(day) AS BIGINT) AS window_start, key,
        round(entropy, {ENTROPY_DIGITS}) AS entropy, l2, l1, card
      FROM sums WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL {DELAY_DAYS} DAY""",
    "batch_window_gsum": f"""WITH items AS (
        SELECT date_trunc('day', ts) AS day, CAST(user_id AS VARCHAR) AS key, event_type AS value,
          count(*) AS f FROM events GROUP BY 1, 2, 3)
      SELECT CAST(epoch(day) AS BIGINT) AS window_start, key,
        round(entropy, {ENTROPY_DIGITS}) AS entropy, l2, l1, card
      FROM (SELECT day, key, {_sums()} FROM items GROUP BY day, key)""",
    "batch_sliding_gsum": f"""WITH items AS (
        SELECT date_trunc('day', ts) - to_days(CAST(back AS INTEGER)) AS day, CAST(user_id AS VARCHAR) AS key,
          event_type AS value, count(*) AS f
        FROM events, (SELECT unnest(range({SLIDING_DAYS})) AS back) GROUP BY 1, 2, 3)
      SELECT CAST(epoch(day) AS BIGINT) AS window_start, key,
        round(entropy, {ENTROPY_DIGITS}) AS entropy, l2, l1, card
      FROM (SELECT day, key, {_sums()} FROM items GROUP BY day, key)""",
    "merged_bounds": _bounds(),
    "bounds_hold": f"""SELECT DISTINCT CAST(l_suppkey AS VARCHAR) AS key,
      {", ".join(f"true AS {m}_inside" for m in METRICS)} FROM lineitem""",
    "stream_sketch_log": _answers(
        "median", HELD_KEYS, ",".join([EVENT_ITEMS, HASHED, PLACED, HH, ASSIGNED])
    ),
    "stream_sketch_merge": _counters(EVENT_ITEMS),
    "stream_sketch_answers": _answers(
        "median", HELD_KEYS, ",".join([EVENT_ITEMS, HASHED, PLACED, HH, ASSIGNED])
    ),
}
