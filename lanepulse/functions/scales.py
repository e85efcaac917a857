"""Metric catalogue and the numeric side of the map scales."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanepulse.functions.geo import clamp


@dataclass(frozen=True)
class Metric:
    column: str
    kind: str
    invert: bool
    domain: tuple[float, float] | None


# What can be mapped and on which domain; None is data-driven.
METRICS = {
    "congestion": Metric("congestion", "sequential", False, (0.0, 0.9)),
    "speed": Metric("speed", "sequential", True, (5.0, 50.0)),
    "vs_typical": Metric("vs_typical", "diverging", False, (-12.0, 12.0)),
    "volume": Metric("samples", "sequential", False, None),
}


@dataclass(frozen=True)
class Opacity:
    low: float
    high: float
    reference: float
    gamma: float


# Fixed values.
SURFACE_OPACITY = Opacity(low=0.10, high=0.85, reference=8.0, gamma=0.7)
STREET_OPACITY = Opacity(low=0.15, high=0.95, reference=1.2, gamma=0.6)


def scale_position(
    value: Column, low: Column | float, high: Column | float, *, invert: bool = False
) -> Column:
    """Where a value falls between the ends of its scale, 0 to 1; NULL stays NULL."""
    low = F.lit(low) if not isinstance(low, Column) else low
    high = F.lit(high) if not isinstance(high, Column) else high
    span = high - low
    at = F.when(span > 0, F.try_divide(value - low, span)).when(
        value.isNotNull(), F.lit(0.0)
    )
    return clamp(1 - at if invert else at, 0.0, 1.0)


def diverging_position(value: Column, limit: Column | float) -> Column:
    limit = F.lit(limit) if not isinstance(limit, Column) else limit
    limit = F.greatest(limit, F.lit(1e-6))
    return clamp((value / limit + 1) / 2, 0.0, 1.0)


def metric_position(
    metric: Metric, value: Column, low: Column | None = None, high: Column | None = None
) -> Column:
    """Position of a metric on its own scale; pass `low`/`high` when data-driven."""
    if metric.domain:
        low, high = metric.domain
    if metric.kind == "diverging":
        return diverging_position(value, max(abs(low), abs(high)))
    return scale_position(value, low, high, invert=metric.invert)


def support_opacity(
    support: Column, scale: Opacity, *, supported: Column | None = None, boost: float = 1.0
) -> Column:
    """Sublinear opacity of a support weight; unsupported rows are fully clear."""
    share = F.greatest(support, F.lit(0.0)) / F.lit(scale.reference)
    alpha = clamp(F.lit(scale.high) * F.pow(share, F.lit(scale.gamma)), scale.low, scale.high)
    if boost != 1.0:
        alpha = F.least(alpha * boost, F.lit(1.0))
    return alpha if supported is None else F.when(supported, alpha).otherwise(F.lit(0.0))
