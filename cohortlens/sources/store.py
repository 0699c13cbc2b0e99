"""Saved sketches and written results."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import format_line
from ..operators.sketch import Sketch
from ..params import SketchParams
from . import files

# Neighbouring cells are stored together: at least so many stretches of cells per grid row, and
# more where a stretch could hold more rows than a file should.
MIN_W_BLOCKS = 64
ROWS_PER_FILE = 1_000_000

# The tables a sketch may have, as they are stored. ``hh`` is split by grid row.
STORED = {
    "hh": "w int, layer int, key string, value string, cnt bigint, d int",
    "cells": "d int, w int, total_count bigint",
    "counters": "d int, w int, layer int, r int, pos int, c bigint",
    "items": "key string, value string, f bigint",
    "cuts": "d int, w int, layer int, total_count bigint, short bigint, cut bigint",
}


class SaveConflict(RuntimeError):
    """Another writer saved to the same path meanwhile; what it saved stands."""


def _cells_per_block(params: SketchParams) -> int:
    fitting = max(1, ROWS_PER_FILE // (params.levels * params.k_kept))
    return min(-(-params.w // MIN_W_BLOCKS), fitting)


def write_tables(tables: dict[str, DataFrame], params: SketchParams, folder: str) -> None:
    """Write some of the ``STORED`` tables to a new folder. ``hh`` is split by grid row and sorted by
    cell, so a query for one key reads little."""
    for name, table in tables.items():
        if name == "hh":
            block = F.floor(F.col("w") / F.lit(_cells_per_block(params)))
            sorted_hh = table.repartition("d", block).sortWithinPartitions("d", "w", "layer")
            writer = sorted_hh.write.option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("d")
        else:
            writer = table.write
        writer.parquet(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str, has: list[str]) -> dict[str, DataFrame]:
    """The tables of a folder; they stay on disk until a query reads the part it needs."""
    tables = {name: spark.read.schema(STORED[name]).parquet(f"{folder}/{name}") for name in has}
    if "hh" in tables:
        tables["hh"] = tables["hh"].select("d", "w", "layer", "key", "value", "cnt")
    return tables


def tables_of(sketch: Sketch) -> dict[str, DataFrame]:
    return {name: table for name in STORED if (table := getattr(sketch, name)) is not None}


def _versions(spark: SparkSession, path: str) -> list[str]:
    return files.names(spark, f"{path}/current")


def _latest(spark: SparkSession, path: str) -> tuple[str, dict] | None:
    """Name and content of the last complete save."""
    for name in reversed(_versions(spark, path)):
        if content := files.read_content(spark, f"{path}/current/{name}"):
            return name, content
    return None


_BUCKETED_BY = "CLUSTERED BY (d, w) SORTED BY (d, w, layer) INTO {} BUCKETS"


def _bucket_table(version: str) -> str:
    return f"cohortlens_{version}"


def _write_buckets(hh: DataFrame, version: str, folder: str, buckets: int) -> None:
    # one writer per bucket: shuffles deal by the same hash as buckets
    dealt = hh.repartition(buckets, "d", "w").sortWithinPartitions("d", "w", "layer")
    writer = dealt.write.format("parquet").bucketBy(buckets, "d", "w").sortBy("d", "w", "layer")
    writer.option("path", f"{folder}/hh").saveAsTable(_bucket_table(version))


def _read_buckets(spark: SparkSession, version: str, folder: str, buckets: int) -> DataFrame:
    """The buckets as a table of the session's catalog, which is what tells Spark how they lie."""
    columns, where = "d int, w int, layer int, key string, value string, cnt bigint", f"{folder}/hh".replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_bucket_table(version)} ({columns}) USING parquet "
        f"{_BUCKETED_BY.format(buckets)} LOCATION '{where}'"
    )
    return spark.table(_bucket_table(version))


def save_sketch(sketch: Sketch, path: str, mode: str = "overwrite", buckets: int | None = None) -> None:
    """Save under ``path``, by default in place of what was saved there.

    The tables (``hh``, ``cells``, and ``counters``, ``items`` and ``cuts`` if there are any) go to a
    new folder; then one small file with the next version's number names it, and from there on it
    is the sketch that is loaded. A save that stops anywhere before leaves the old sketch as it
    was, and whoever reads an older version goes on reading it: no file is ever replaced.

    Of two writers that start from the same version, the one that names its folder first wins; the
    other one's folder is removed and it gets a ``SaveConflict``, so nothing is lost unseen.

    With ``buckets`` the heavy hitters are stored in so many buckets of cells, registered as a table
    of the session's catalog, and tables of keys are answered without shuffling them; choose as
    many as the tasks that should read them. Without, one key is found with the least reading.
    """
    spark = sketch.hh.sparkSession
    if mode in ("error", "errorifexists", "ignore") and has_sketch(spark, path):
        if mode == "ignore":
            return
        raise FileExistsError(f"{path} has a sketch")
    # unfinished ones count: their writer may still be at work
    number = max((int(name) for name in _versions(spark, path)), default=0) + 1
    version = uuid.uuid4().hex
    folder = f"{path}/versions/{version}"
    tables = tables_of(sketch)
    plain = tables if buckets is None else {name: t for name, t in tables.items() if name != "hh"}
    write_tables(plain, sketch.params, folder)
    if buckets is not None:
        _write_buckets(sketch.hh.select("d", "w", "layer", "key", "value", "cnt"), version, folder, buckets)
    content = {
        "version": version, "params": asdict(sketch.params), "has": list(plain), "mode": sketch.mode, "buckets": buckets,
    }
    try:
        files.write_once(spark, f"{path}/current/{number:020d}", content)
    except FileExistsError:
        if buckets is not None:
            spark.sql(f"DROP TABLE IF EXISTS {_bucket_table(version)}")
        files.remove(spark, folder)
        raise SaveConflict(f"{path} was saved by another writer") from None


def _read_version(spark: SparkSession, path: str, content: dict) -> Sketch:
    version, buckets = content["version"], content["buckets"]
    folder = f"{path}/versions/{version}"
    tables = read_tables(spark, folder, content["has"])
    if buckets is not None:
        tables["hh"] = _read_buckets(spark, version, folder, buckets)
    return Sketch(SketchParams(**content["params"]), mode=content["mode"], bucketed=buckets is not None, **tables)


def load_sketch(spark: SparkSession, path: str) -> Sketch:
    """A saved sketch. Its tables stay on disk until a query reads the part it needs."""
    latest = _latest(spark, path)
    if latest is None:
        raise FileNotFoundError(f"no sketch at {path}")
    return _read_version(spark, path, latest[1])


def leave_catalog(spark: SparkSession, path: str) -> None:
    """Take the table of a sketch in buckets out of the session's catalog. Its files stay: what was
    loaded before goes on reading them, and ``load_sketch`` registers it again."""
    latest = _latest(spark, path)
    if latest is not None and latest[1]["buckets"] is not None:
        spark.sql(f"DROP TABLE IF EXISTS {_bucket_table(latest[1]['version'])}")


def has_sketch(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` holds a complete sketch."""
    return _latest(spark, path) is not None


@contextmanager
def held_sketch(spark: SparkSession, path: str) -> Iterator[Sketch]:
    """``load_sketch`` for the length of a ``with`` block, in which the version read is not removed."""
    while True:
        latest = _latest(spark, path)
        if latest is None:
            raise FileNotFoundError(f"no sketch at {path}")
        name, content = latest
        hold = f"{path}/holds/{name}-{uuid.uuid4().hex}"
        files.write_once(spark, hold, {})
        if name in _versions(spark, path):  # not removed before the hold was there
            break
        files.remove(spark, hold)
    try:
        yield _read_version(spark, path, content)
    finally:
        files.remove(spark, hold)


def remove_old_versions(
    spark: SparkSession, path: str, keep: int = 1, hold_seconds: float = 86_400.0
) -> list[str]:
    """Remove all versions but the last ``keep`` and those that ``held_sketch`` holds; a hold that is
    older than ``hold_seconds`` was left by a reader that died. Returns the numbers removed."""
    if keep < 1:
        raise ValueError("the last version stays")
    complete = {
        name: content
        for name in _versions(spark, path)
        if (content := files.read_content(spark, f"{path}/current/{name}"))
    }
    gone = []
    for name in sorted(complete)[:-keep]:
        marker, holds = f"{path}/current/{name}", f"{path}/holds"
        files.remove(spark, marker)  # from here on nobody starts to read it
        held = [h for h in files.names(spark, holds) if h.startswith(f"{name}-")]
        if any(files.age_seconds(spark, f"{holds}/{h}") < hold_seconds for h in held):
            files.write_once(spark, marker, complete[name])
            continue
        if complete[name]["buckets"] is not None:
            spark.sql(f"DROP TABLE IF EXISTS {_bucket_table(complete[name]['version'])}")
        files.remove(spark, f"{path}/versions/{complete[name]['version']}")
        gone.append(name)
    return gone


def without_counters(sketch: Sketch) -> Sketch:
    return replace(sketch, counters=None)


def format_estimates(estimates: DataFrame, spaced: bool = False) -> DataFrame:
    """One text column ``line`` per answer: key, entropy, l2, l1, card."""
    return estimates.select(
        format_line(*[F.col(c) for c in ("key", "entropy", "l2", "l1", "card")], spaced=spaced).alias(
            "line"
        )
    )


def write_estimates(
    estimates: DataFrame,
    path: str,
    fmt: str = "text",
    single_file: bool = False,
    spaced: bool = False,
) -> None:
    """Write answers, replacing what was there. ``text`` writes result lines, any other format
    the table itself. ``single_file`` is for results small enough for one writer."""
    out = format_estimates(estimates, spaced) if fmt == "text" else estimates
    if single_file:
        out = out.repartition(1)  # not coalesce: only the writing is done by one task
    out.write.mode("overwrite").format(fmt).save(path)
