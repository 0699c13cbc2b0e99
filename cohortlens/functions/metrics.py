"""G functions, and the small formulas around estimates.

A metric is a function g of a value's frequency; a group's answer is the sum of g over the
group's values. ``l2`` is the second moment (no square root), ``entropy`` is the sum of
f*log2(f) and not yet Shannon's entropy.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# l2 needs more than 64 bits as soon as one value occurs 3e9 times.
WIDE_INT = "decimal(38,0)"
_COUNT = "decimal(19,0)"


@dataclass(frozen=True)
class Metric:
    """``g`` maps a frequency column (bigint) to a number; sums are taken in ``dtype``."""

    g: Callable[[Column], Column]
    dtype: str = "double"

    def apply(self, freq: Column) -> Column:
        out = self.g(freq)
        if not isinstance(out, Column):
            out = F.lit(out)
        return out.cast(self.dtype)

    def total(self, freq: Column) -> Column:
        return F.coalesce(F.sum(self.apply(freq)).cast(self.dtype), self.zero())

    def weighted_total(self, freq: Column, layer: Column) -> Column:
        """Sum of 2^layer * g(freq)."""
        weight = F.call_function("shiftleft", F.lit(1), layer)
        weight = weight.cast("decimal(10,0)" if self.dtype == WIDE_INT else self.dtype)
        return F.coalesce(F.sum(weight * self.apply(freq)).cast(self.dtype), self.zero())

    def zero(self) -> Column:
        return F.lit(0).cast(self.dtype)


@dataclass(frozen=True)
class SecondMoment(Metric):
    """Exact sum of f*f beyond 64 bits, from three 64-bit sums.

    With f = high * 2^20 + low, f*f = high*high * 2^40 + high*low * 2^21 + low*low. None of the
    three sums overflows for a group of up to 8e12 rows, and 64-bit sums keep the aggregation
    on Spark's fast path, which decimals do not.
    """

    def total(self, freq: Column) -> Column:
        high, low = F.shiftright(freq, 20), freq.bitwiseAND(F.lit((1 << 20) - 1))

        def part(product: Column, factor: int) -> Column:
            digits = F.lit(factor).cast(f"decimal({len(str(factor))},0)")
            return F.sum(product).cast(_COUNT) * digits

        parts = part(high * high, 1 << 40) + part(high * low, 1 << 21) + part(low * low, 1)
        return F.coalesce(parts.cast(self.dtype), self.zero())


METRICS: dict[str, Metric] = {
    "entropy": Metric(lambda f: f * F.log2(f)),
    "l2": SecondMoment(lambda f: f.cast(_COUNT) * f.cast(_COUNT), WIDE_INT),
    "l1": Metric(lambda f: f, "bigint"),
    "card": Metric(lambda f: F.lit(1), "bigint"),
}

MetricSpec = Mapping[str, Metric | Callable[[Column], Column]] | Sequence[str] | None


def resolve_metrics(spec: MetricSpec = None) -> dict[str, Metric]:
    """None: the four standard metrics. Names pick from them; callables define new ones."""
    if spec is None:
        return dict(METRICS)
    if not isinstance(spec, Mapping):
        return {name: METRICS[name] for name in spec}
    out = {}
    for name, g in spec.items():
        if hasattr(g, "evalType"):
            raise TypeError(
                f"metric {name!r} is a Python UDF; write g as a function from Column to Column"
            )
        out[name] = g if isinstance(g, Metric) else Metric(g)
    return out


def shannon_entropy(entropy: Column, l1: Column) -> Column:
    """Shannon entropy in bits from the f*log2(f) sum and the group's row count."""
    return F.when(l1 > 0, F.log2(l1) - entropy / l1).otherwise(F.lit(0.0))


def median_of(values: Column, n: int) -> Column:
    """Middle element of an array of ``n`` numbers, ``n`` odd."""
    if n % 2 == 0:
        raise ValueError("median needs an odd number of values")
    return F.get(F.sort_array(values), F.lit(n // 2))


def combine_rows(values: Sequence[Column], how: str) -> Column:
    """One answer from the grid rows' answers: ``min`` or ``median``."""
    values = list(values)
    if how == "min":
        return F.least(*values) if len(values) > 1 else values[0]
    if how == "median":
        return median_of(F.array(*values), len(values))
    raise ValueError("combine is 'min' or 'median'")


def relative_error_pct(real: Column, estimate: Column) -> Column:
    """|real - estimate| / real in percent.

    A zero estimate gives |real|; a quotient that is infinite or not a number gives 100.
    """
    real, estimate = real.cast("double"), estimate.cast("double")
    err = F.try_divide(F.abs(real - estimate), real) * F.lit(100.0)
    bad = err.isNull() | F.isnan(err) | (F.abs(err) == F.lit(float("inf")))
    return (
        F.when(F.abs(estimate) < F.lit(1e-6), F.abs(real))
        .when(bad, F.lit(100.0))
        .otherwise(err)
    )


def relative_errors_pct(real: Column, estimates: Column) -> Column:
    """``relative_error_pct`` of one real value against an array of estimates."""
    return F.transform(estimates, lambda e: relative_error_pct(real, e))
