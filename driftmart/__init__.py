"""Condition monitoring on Spark: monthly marts, signals, events, reconciliation, prediction."""

from driftmart.plans.mart import ml_ready, monitoring_core, monitoring_mart
from driftmart.spec import STATION, STATION_MODE, Metric, MonitoringSpec

__all__ = [
    "STATION",
    "STATION_MODE",
    "Metric",
    "MonitoringSpec",
    "ml_ready",
    "monitoring_core",
    "monitoring_mart",
]
