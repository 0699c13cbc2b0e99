"""Statistics over many groups of a large table at once, exactly or from a mergeable sketch."""

from .functions.metrics import METRICS, Metric, relative_error_pct, shannon_entropy
from .functions.text import make_key, split_quoted
from .operators.estimate import cell_gsum, key_estimates, propagate, query_key, query_keys
from .operators.evaluate import accuracy_report, key_errors
from .operators.exact import exact_gsum, exact_gsum_cube, exact_gsum_of
from .operators.items import count_items, count_items_of, repeat_items, restrict_to_keys, to_items
from .operators.sketch import (
    Sketch,
    build_sketch,
    empty_sketch,
    heavy_hitters,
    merge_sketches,
    sketch_stats,
)
from .params import SketchParams
from .sources.rows import read_query_keys, read_rows, repeat_rows
from .sources.store import format_estimates, load_sketch, save_sketch, write_estimates

__all__ = [
    "METRICS",
    "Metric",
    "Sketch",
    "SketchParams",
    "accuracy_report",
    "build_sketch",
    "cell_gsum",
    "count_items",
    "count_items_of",
    "empty_sketch",
    "exact_gsum",
    "exact_gsum_cube",
    "exact_gsum_of",
    "format_estimates",
    "heavy_hitters",
    "key_errors",
    "key_estimates",
    "load_sketch",
    "make_key",
    "merge_sketches",
    "propagate",
    "query_key",
    "query_keys",
    "read_query_keys",
    "read_rows",
    "relative_error_pct",
    "repeat_items",
    "repeat_rows",
    "restrict_to_keys",
    "save_sketch",
    "shannon_entropy",
    "sketch_stats",
    "split_quoted",
    "to_items",
    "write_estimates",
]
