"""Traffic-sensor analytics on Spark: DataFrame in, DataFrame out."""

from lanepulse.params import DEFAULTS, Params

__all__ = ["DEFAULTS", "Params"]
