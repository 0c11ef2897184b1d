"""Operators on panels, series, grids and regressions."""
