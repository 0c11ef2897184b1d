"""Panels, distributed lags and spatial statistics on PySpark."""
