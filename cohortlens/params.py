"""Sketch parameters."""

from __future__ import annotations

from dataclasses import dataclass

HASH_ALGORITHMS = ("xxhash64", "md5")

# The default sketch shape.
DEFAULT_D = 3
DEFAULT_W = 800
DEFAULT_LEVELS = 15
DEFAULT_K = 30
DEFAULT_ROWS = 3
DEFAULT_COLS = 400


@dataclass(frozen=True)
class SketchParams:
    """Shape of a sketch.

    d, w       grid of cells: every key lives in one of ``w`` cells in each of ``d`` grid rows
    levels     layers per cell; an item lives in layer l with probability 2^-(l+1)
    k          heavy hitters read per cell layer
    k_store    heavy hitters kept per cell layer (>= k); keep more than ``k`` when the sketch
               will be merged, because mass cut before a merge cannot come back
    rows, cols counters per cell layer (Count-Sketch rows x columns)
    algo       ``xxhash64`` (fast) or ``md5`` (same lanes in any SQL engine)
    sign_bit   which bit of a 16-bit lane gives the counter sign
    layered    items are entered in every layer 0..layer instead of only their own
    """

    d: int = DEFAULT_D
    w: int = DEFAULT_W
    levels: int = DEFAULT_LEVELS
    k: int = DEFAULT_K
    rows: int = DEFAULT_ROWS
    cols: int = DEFAULT_COLS
    k_store: int | None = None
    algo: str = "xxhash64"
    sign_bit: int = 15
    layered: bool = False

    def __post_init__(self) -> None:
        for name in ("d", "w", "levels", "k", "rows", "cols"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.algo not in HASH_ALGORITHMS:
            raise ValueError(f"algo must be one of {HASH_ALGORITHMS}")
        if self.k_store is not None and self.k_store < self.k:
            raise ValueError("k_store must not be below k")
        if self.levels > 29:
            raise ValueError("at most 29 levels: the widest layer hash has 28 bits")
        if self.w > 1 << 31:
            raise ValueError("w must fit in 32 bits")
        if not 0 <= self.sign_bit <= 15:
            raise ValueError("sign_bit is a bit of a 16-bit lane")

    @property
    def k_kept(self) -> int:
        return self.k_store if self.k_store is not None else self.k
