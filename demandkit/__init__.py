"""Spark-native demand-panel analytics.

Sales facts (date x location x product) are cleaned, densified into a
day x center x item panel, enriched with calendar, lag, rolling and
cyclical features, and answered with reports, forecasts, accuracy
metrics, inventory recommendations and drift reports.  Every operator is
a lazy ``DataFrame -> DataFrame`` function built from Spark SQL
expressions; nothing runs row-at-a-time in Python.
"""

from demandkit.spec import FeatureConfig, PanelSpec

__all__ = ["FeatureConfig", "PanelSpec"]
__version__ = "0.1.0"
