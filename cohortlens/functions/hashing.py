"""Hash lanes, layers, counter addresses and grid columns.

One hash of an item gives everything the sketch needs: it is cut into 16-bit lanes, and each
lane drives one decision. ``xxhash64`` gives four lanes per hash, ``md5`` eight. When more are
needed, further hashes with a numbered salt supply them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import SketchParams

LANE_BITS = 16
LANE_MASK = (1 << LANE_BITS) - 1
LAYER_LANE = 3  # this lane of the item hash picks the layer; the others place counters
ITEM_SALT = "item"
KEY_SALT = "cell"

_LANES_PER_HASH = {"xxhash64": 4, "md5": 8}


def _hash(parts: list[Column], salt: str, algo: str) -> Column:
    if algo == "xxhash64":
        return F.xxhash64(F.lit(salt), *parts)
    # The length of every part but the last goes in front of it, so that ("a", "bc") and
    # ("ab", "c") hash different strings.
    pieces = [F.lit(salt + "|")]
    for part in parts[:-1]:
        pieces += [F.length(part).cast("string"), F.lit("|"), part, F.lit("|")]
    return F.md5(F.concat(*pieces, parts[-1]))


@dataclass(frozen=True)
class Lanes:
    """Lanes of the hash of some columns, read from helper columns of a DataFrame.

    ``attach`` adds the helper columns (one per hash), so that a hash is computed once per row
    however many lanes are read; ``lane(i)`` reads one.
    """

    salt: str
    algo: str
    n_lanes: int

    @property
    def columns(self) -> list[str]:
        per_hash = _LANES_PER_HASH[self.algo]
        return [f"_{self.salt}_hash{i}" for i in range(-(-self.n_lanes // per_hash))]

    @property
    def _salts(self) -> list[str]:
        return [self.salt] + [f"{self.salt}{i}" for i in range(1, len(self.columns))]

    def attach(self, df: DataFrame, *parts: str) -> DataFrame:
        inputs = [F.col(p) for p in parts]
        return df.withColumns(
            {
                name: _hash(inputs, salt, self.algo)
                for name, salt in zip(self.columns, self._salts)
            }
        )

    def lane(self, i: int) -> Column:
        if not 0 <= i < self.n_lanes:
            raise ValueError(f"lane {i} of {self.n_lanes}")
        per_hash = _LANES_PER_HASH[self.algo]
        return _lane_of(F.col(self.columns[i // per_hash]), i % per_hash, self.algo)

    def of(self, *parts: Column) -> list[Column]:
        """The lanes of given columns without helper columns, for constants."""
        per_hash = _LANES_PER_HASH[self.algo]
        hashes = [_hash(list(parts), salt, self.algo) for salt in self._salts]
        return [
            _lane_of(hashes[i // per_hash], i % per_hash, self.algo) for i in range(self.n_lanes)
        ]


def _lane_of(hashed: Column, i: int, algo: str) -> Column:
    if algo == "xxhash64":
        return F.shiftright(hashed, LANE_BITS * i).bitwiseAND(F.lit(LANE_MASK)).cast("int")
    return F.conv(F.substring(hashed, 4 * i + 1, 4), 16, 10).cast("int")


def hash_lanes(*parts: Column, salt: str, algo: str = "xxhash64", n_lanes: int = 4) -> Column:
    """The first ``n_lanes`` 16-bit lanes of the hash of ``parts``, as an array of int."""
    per_hash = _LANES_PER_HASH[algo]
    if n_lanes > per_hash:
        raise ValueError(f"one {algo} hash has {per_hash} lanes")
    hashed = _hash(list(parts), salt, algo)
    return F.array(*[_lane_of(hashed, i, algo) for i in range(n_lanes)])


def wide_layer_hash(lane0: Column, lane1: Column, lane2: Column, lane3: Column) -> Column:
    """28-bit layer hash: lane 3 with the top four bits of lanes 0, 1 and 2 above it."""
    value = lane3
    for i, lane in enumerate((lane0, lane1, lane2)):
        top_nibble = F.shiftright(lane, LANE_BITS - 4)
        value = value.bitwiseOR(F.shiftleft(top_nibble, LANE_BITS + 4 * i))
    return value


def item_layer(lane: Column, levels: int) -> Column:
    """Number of trailing one bits of ``lane``, at most ``levels - 1``."""
    ones = F.bit_count(F.shiftright(lane.bitwiseXOR(lane + F.lit(1)), 1))
    return F.least(ones, F.lit(levels - 1)).cast("int")


def counter_addr(lane: Column, cols: int, sign_bit: int = 15) -> tuple[Column, Column]:
    """Column and sign (+1 or -1) of the counter that a lane addresses."""
    pos = F.pmod(lane, F.lit(cols)).cast("int")
    sign = F.lit(2) * F.shiftright(lane, sign_bit).bitwiseAND(F.lit(1)) - F.lit(1)
    return pos, sign.cast("int")


# --- the lanes a sketch uses -------------------------------------------------------------


def counter_lane(r: int) -> int:
    """Lane of Count-Sketch row ``r``: every lane but the one that picks the layer."""
    return r if r < LAYER_LANE else r + 1


def item_lanes(params: SketchParams, counters: bool = True) -> Lanes:
    last = counter_lane(params.rows - 1) if counters else LAYER_LANE
    return Lanes(ITEM_SALT, params.algo, max(last, LAYER_LANE) + 1)


def key_lanes(params: SketchParams) -> Lanes:
    wide = params.w > LANE_MASK + 1
    return Lanes(KEY_SALT, params.algo, params.d * (2 if wide else 1))


def sketch_layer(lanes: Lanes, params: SketchParams) -> Column:
    """Layer of an item: 16 hash bits up to 17 levels, 28 beyond."""
    if params.levels <= LANE_BITS + 1:
        return item_layer(lanes.lane(LAYER_LANE), params.levels)
    return item_layer(wide_layer_hash(*[lanes.lane(i) for i in range(4)]), params.levels)


def grid_columns(lanes: list[Column], params: SketchParams) -> list[Column]:
    """Grid column of a key in every grid row. Two lanes are joined when ``w`` needs them."""
    if params.w > LANE_MASK + 1:
        lanes = [
            low + high.cast("bigint") * F.lit(LANE_MASK + 1)
            for low, high in zip(lanes[0::2], lanes[1::2])
        ]
    return [F.pmod(lane, F.lit(params.w)).cast("int") for lane in lanes]


def key_grid_columns(params: SketchParams) -> list[Column]:
    """Grid columns read from the helper columns that ``key_lanes(params)`` attached."""
    lanes = key_lanes(params)
    return grid_columns([lanes.lane(i) for i in range(lanes.n_lanes)], params)
