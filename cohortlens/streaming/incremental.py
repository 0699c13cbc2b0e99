"""A stored sketch that follows a stream: a log of what each micro-batch adds, merged now and then."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from ..operators.counters import count_sketch_build, merge_counters
from ..operators.items import count_items
from ..operators.sketch import Sketch, build_sketch, merge_sketches
from ..params import SketchParams
from ..session import write_and_read
from ..sources import files
from ..sources.store import read_tables, tables_of, write_tables

FAN = 8
KEPT_SECONDS = 86_400.0

Segment = tuple[int, int]  # first and last batch


def _name(segment: Segment) -> str:
    return "{:012d}-{:012d}".format(*segment)


def _logged(spark: SparkSession, path: str) -> list[Segment]:
    """Segments whose mark is complete. The marks of what was merged are removed in time, so there
    are few: less than ``fan`` for each level, and the recent ones."""
    marks = files.names(spark, f"{path}/log")
    return [tuple(map(int, name.split("-"))) for name in marks if files.read_content(spark, f"{path}/log/{name}")]


def _cover(segments: list[Segment], start: int = 0, end: int | None = None) -> list[Segment]:
    """From ``start`` on, the widest segments that follow each other, up to ``end`` if given."""
    out, at = [], start
    while True:
        fitting = [s for s in segments if s[0] == at and (end is None or s[1] <= end)]
        if not fitting:
            return out
        out.append(max(fitting))
        at = out[-1][1] + 1


def _read(spark: SparkSession, path: str, segment: Segment) -> tuple[dict, dict[str, DataFrame]]:
    mark = files.read_content(spark, f"{path}/log/{_name(segment)}")
    return mark, read_tables(spark, f"{path}/segments/{mark['folder']}", mark["has"])


def _write(spark: SparkSession, path: str, segment: Segment, mark: dict, tables: dict[str, DataFrame]) -> None:
    """The tables go to a new folder; the mark comes last, and only with it does the segment count."""
    folder = f"{_name(segment)}-{uuid.uuid4().hex}"
    params = SketchParams(**mark["params"])
    write_tables(tables, params, f"{path}/segments/{folder}")
    files.write_once(spark, f"{path}/log/{_name(segment)}", {**mark, "folder": folder, "has": list(tables)})


def _merged(mark: dict, parts: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    if len(parts) == 1:
        return parts[0]
    if "items" not in parts[0]:
        params, mode = SketchParams(**mark["params"]), mark["mode"]
        return tables_of(merge_sketches(*[Sketch(params, mode=mode, **tables) for tables in parts]))
    out = {"items": count_items(reduce(DataFrame.unionByName, [p["items"] for p in parts]))}
    if "counters" in parts[0]:
        out["counters"] = merge_counters(*[p["counters"] for p in parts])
    return out


def latest_sketch(spark: SparkSession, path: str) -> Sketch:
    """The sketch after the last complete micro-batch, put together from the segments of the log."""
    cover = _cover(_logged(spark, path))
    if not cover:
        raise FileNotFoundError(f"no sketch at {path}")
    read = [_read(spark, path, s) for s in cover]
    mark, tables = read[0][0], _merged(read[0][0], [t for _, t in read])
    params, mode = SketchParams(**mark["params"]), mark["mode"]
    if "items" not in tables:
        return Sketch(params, mode=mode, **tables)
    items = write_and_read(tables["items"], "items")
    sketch = build_sketch(items, params, mode, items=items, keep_items=True)
    return replace(sketch, counters=tables["counters"]) if "counters" in tables else sketch


def _compact(spark: SparkSession, path: str, batch_id: int, fan: int) -> None:
    """Merge the last ``fan`` segments of every level that the batch has filled. The level of a segment
    follows from the batches it holds, so what a stopped run left undone is done by the next one."""
    size = fan
    while (batch_id + 1) % size == 0:
        whole = (batch_id + 1 - size, batch_id)
        logged = _logged(spark, path)
        if whole not in logged:
            read = [_read(spark, path, s) for s in _cover(logged, *whole)]
            _write(spark, path, whole, read[0][0], _merged(read[0][0], [t for _, t in read]))
        size *= fan


def remove_merged(spark: SparkSession, path: str, kept_seconds: float = KEPT_SECONDS) -> list[str]:
    """Remove segments that a wider one holds since ``kept_seconds`` at least, which is as long as a
    sketch read before can still be used. Returns their names."""
    logged, gone = _logged(spark, path), []
    for narrow in logged:
        wider = [s for s in logged if s != narrow and s[0] <= narrow[0] and narrow[1] <= s[1]]
        marks = [f"{path}/log/{_name(s)}" for s in wider]
        if any(files.age_seconds(spark, m) >= kept_seconds for m in marks):
            mark = files.read_content(spark, f"{path}/log/{_name(narrow)}")
            files.remove(spark, f"{path}/log/{_name(narrow)}")
            files.remove(spark, f"{path}/segments/{mark['folder']}")
            gone.append(_name(narrow))
    return gone


def sketch_updater(
    path: str,
    params: SketchParams,
    mode: str = "exact_counts",
    with_counters: bool = True,
    keep_items: bool = False,
    fan: int = FAN,
    kept_seconds: float = KEPT_SECONDS,
) -> Callable[[DataFrame, int], None]:
    """Function for ``foreachBatch``: adds a batch of rows(key, value) to the sketch at ``path``.

    A batch writes one segment with what it holds itself, whatever came before. Whenever ``fan``
    segments of a level are there, they are merged into one of the next level, so a row is
    rewritten once per level: n batches cost at most log_fan(n) times what they hold, and a reader
    meets fewer than ``fan`` segments per level. Merged segments are removed ``kept_seconds`` later.

    A batch that is run again, after whatever failure, counts once: a segment without its mark does
    not count, and one with a mark is not written again. One path belongs to one query.

    Segments of a bounded size cut what they hold, and what is cut is gone; what an answer may be
    short of is told by ``key_bounds`` if the mode is ``bounded``. ``keep_items`` stores counted items
    instead, so that nothing is lost; the state then grows with the distinct items.
    """
    if fan < 2:
        raise ValueError("at least two segments are merged")

    def update(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cover = _cover(_logged(spark, path))
        following = cover[-1][1] + 1 if cover else 0
        if batch_id not in (following, following - 1):
            raise ValueError(f"{path} goes on with batch {following}, not {batch_id}")
        if batch_id == following:
            # Counted once and written, so that no raw rows are held and a lost executor costs little.
            items = write_and_read(count_items(batch), "batch-items")
            shape = params
            if keep_items:
                tables = {"items": items}
            else:
                part = build_sketch(items, params, mode, items=items)
                tables, shape = tables_of(part), part.params
            if with_counters and "counters" not in tables:
                tables["counters"] = count_sketch_build(items, params)
            mark = {"params": asdict(shape), "mode": mode}
            _write(spark, path, (batch_id, batch_id), mark, tables)
        _compact(spark, path, batch_id, fan)
        remove_merged(spark, path, kept_seconds)

    return update
