"""Metered-flow analytics on Spark: hourly grids, quality flags, baselines, anomaly scores,
incidents, features, backtests and forecasts for fleets of paired flow meters."""

from tidemark.params import DEFAULTS, Params

__all__ = ["DEFAULTS", "Params"]
